"""Pivot tables with totals worked out from the source rows."""
from __future__ import annotations

import functools
import operator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.cells import (TableError, canonical_text, col, date_order, free_name, is_missing, is_number, number_of, present,
                               require_columns, type_of, written_date)
from ..plans.quantiles import grouped_quantile
from ..session import setting, written
from .dedupe import same_cells
from .filters import exact_filter
from .group import whole_or_double
from .result import Result
from .sorting import numeric_columns

AGGREGATIONS = ("sum", "mean", "count", "min", "max", "median", "std", "nunique")
SHOW_AS = ("values", "row", "column", "total")
PERIODS = {"year": "yyyy", "quarter": "yyyy-'Q'q", "month": "yyyy-MM"}
TOTAL_LABELS = ("Total", "Grand Total", "Grand Total (all rows)")
MOST_COLUMNS = 10_000
_SEPARATOR = "\u0001"


def period_label(df: DataFrame, column: str, unit: str, order: str = "auto") -> Column:
    """'2024', '2024-Q1' or '2024-01' for a date, '(not a date)' for anything else, NULL for a missing cell."""
    if unit not in PERIODS:
        raise TableError(f"dates are grouped by {', '.join(PERIODS)}, not {unit!r}")
    dtype = type_of(df, column)
    when = written_date(col(column), dtype, (date_order(df, column) or "MDY") if order == "auto" else order)
    return F.when(~is_missing(col(column), dtype), F.coalesce(F.date_format(when, PERIODS[unit]), F.lit("(not a date)")))


def _aggregate(name: str, number: Column, cell: Column) -> Column:
    if name == "sum":
        return F.coalesce(F.sum(number), F.lit(0))                   # of 64-bit integers in decimals, see `pivot_cells`
    if name == "mean":
        return F.avg(number)
    if name == "min":
        return F.min(number)
    if name == "max":
        return F.max(number)
    if name == "std":
        return F.stddev_samp(number)
    return F.count(cell) if name == "count" else F.count_distinct(cell)


def _row_order(df: DataFrame, rows: list[str], labels: list[str], date_groups) -> list[Column]:
    """Totals aside, rows in the order of their values: numbers by number, text by text, blanks last."""
    out = []
    for n, x in zip(rows, labels):
        blank = F.col(x) == "(blank)"
        out += [blank] + ([F.when(~blank, F.col(x)).try_cast("decimal(38,10)"), F.when(~blank, F.col(x)).try_cast("double")]
                          if is_number(type_of(df, n)) and n not in (date_groups or {}) else []) + [F.col(x)]
    return out


def pivot_cells(df: DataFrame, rows: list[str], columns: list[str], values: list[str], aggregations: list[str],
                date_groups: dict[str, str] | None = None, order: str = "auto") -> DataFrame:
    """The pivot in long form: label columns r0.. c0.., `level`, and v<j>_<aggregation> per value.

    `level` is the grouping id: 0 for a cell; bits are set for the labels that are totalled over. All levels come from
    one pass over the source rows with GROUPING SETS, so a mean total is the mean of all rows. Sums of 64-bit integers are
    decimal(38,0), as such a sum may not fit 64 bits."""
    date_groups = date_groups or {}

    def label(n: str) -> Column:
        text = period_label(df, n, date_groups[n], order) if n in date_groups else canonical_text(col(n), type_of(df, n))
        return F.coalesce(text, F.lit("(blank)"))
    r, c = [f"r{i}" for i in range(len(rows))], [f"c{i}" for i in range(len(columns))]
    source = df.select(*[label(n).alias(x) for n, x in zip(rows + columns, r + c)],
                       *[whole_or_double(df, n).alias(f"n{j}") for j, n in enumerate(values)],
                       *[present(col(n), type_of(df, n)).alias(f"t{j}") for j, n in enumerate(values)])
    levels = [s for s in dict.fromkeys([tuple(r + c), tuple(r), tuple(c), ()])]
    plain = [a for a in aggregations if a != "median"]

    def number(j: int, aggregation: str) -> Column:
        wide = aggregation == "sum" and isinstance(source.schema[f"n{j}"].dataType, T.LongType)
        return F.col(f"n{j}").cast("decimal(28,0)") if wide else F.col(f"n{j}")
    aggregates = [_aggregate(a, number(j, a), F.col(f"t{j}")).alias(f"v{j}_{a}") for j in range(len(values)) for a in plain]
    cells = source.groupingSets([[F.col(x) for x in s] for s in levels], *[F.col(x) for x in r + c]).agg(
        F.grouping_id().alias("level"), *(aggregates or [F.count(F.lit(1)).alias("__rows")]))
    if "median" in aggregations:
        for j in range(len(values)):
            parts = []
            for s in levels:
                level = sum(1 << (len(r + c) - 1 - i) for i, x in enumerate(r + c) if x not in s)
                found = grouped_quantile(source, list(s), F.col(f"n{j}"), 0.5, f"v{j}_median")
                parts.append(found.select(*[(F.col(x) if x in s else F.lit(None).cast("string")).alias(f"m_{x}") for x in r + c],
                                          F.lit(level).cast("bigint").alias("m_level"), f"v{j}_median"))
            medians = functools.reduce(DataFrame.unionByName, parts)
            match = same_cells([(F.col(x), F.col(f"m_{x}")) for x in r + c]) & (F.col("level") == F.col("m_level"))
            cells = cells.join(medians, match, "left").drop("m_level", *[f"m_{x}" for x in r + c])
    return cells


def pivot_table(df: DataFrame, rows: list[str] | None = None, columns: list[str] | None = None, values: list[str] | None = None,
                aggregations: list[str] | str | None = None, filters: dict | None = None, show_as: str = "values",
                date_groups: dict[str, str] | None = None, order: str = "auto") -> Result:
    """Rows by columns with a total row, and a total column per value when there are columns.

    `aggregations` are one or several of AGGREGATIONS (sum for numbers, otherwise count, when none is named); several
    stand side by side as `<agg>_<name>`. `show_as` gives shares of the row, column or grand total. Sums of 64-bit integers
    are 64-bit too if all cells and totals of the value fit, else decimal(38,0).
    Metrics: per value column, the cells that are not numbers (ignored by the numeric aggregations)."""
    rows, columns, values = list(rows or []), list(columns or []), list(values or [])
    require_columns(df, [*rows, *columns, *values, *(filters or {})])
    if not values or not rows + columns:
        raise TableError("choose a value field, and a row or column field")
    if set(date_groups or {}) - set(rows + columns):
        raise TableError("only row and column fields can be grouped by date")
    if set(rows) & set(columns):
        raise TableError("a field can be in the rows or in the columns, not in both")
    aggregations = [aggregations] if isinstance(aggregations, str) else list(dict.fromkeys(aggregations or []))
    df = exact_filter(df, filters or {})
    if not aggregations:
        aggregations = ["sum" if set(values) <= numeric_columns(df, values) else "count"]
    if set(aggregations) - set(AGGREGATIONS) or show_as not in SHOW_AS:
        raise TableError(f"aggregations are {', '.join(AGGREGATIONS)}; show_as is one of {', '.join(SHOW_AS)}")
    if show_as != "values" and set(aggregations) - {"sum", "count"}:
        raise TableError("shares of a total only make sense for sum and count")
    if show_as == "row" and not columns:
        raise TableError("a share of the row total needs a column field")

    metrics = df.select(F.explode(F.array(*[
        F.struct(F.lit(n).alias("column"), (~is_missing(col(n), type_of(df, n)) & number_of(df, n).isNull()).cast("bigint").alias("bad"))
        for n in values])).alias("v")).groupBy("v.column").agg(F.sum("v.bad").alias("not_numbers"))

    # the cell table is written once: it feeds the list of columns, the totals and the result
    cells = written(pivot_cells(df, rows, columns, values, aggregations, date_groups, order))
    r, c = [f"r{i}" for i in range(len(rows))], [f"c{i}" for i in range(len(columns))]
    labels = [F.col(x) for x in r + c]
    sums = [f"v{j}_sum" for j, n in enumerate(values) if "sum" in aggregations and isinstance(type_of(df, n), T.LongType)]
    seen = cells.agg(*[F.max(F.when(F.col("level") == 0, functools.reduce(operator.or_, [x == F.lit(t) for x in labels]))) for t in TOTAL_LABELS],
                     *[F.bool_or(F.col(v).try_cast("bigint").isNull()) for v in sums]).first()
    used, beyond = seen[:len(TOTAL_LABELS)], seen[len(TOTAL_LABELS):]
    cells = cells.withColumns({v: F.col(v).cast("bigint") for v, too_large in zip(sums, beyond) if not too_large})
    total = next((t for t, taken in zip(TOTAL_LABELS, used) if not taken), free_name("Total", TOTAL_LABELS))

    measures = [(j, a) for a in aggregations for j in range(len(values))]
    zero = {(j, a): F.coalesce(F.col(f"v{j}_{a}"), F.lit(0)) if a in ("sum", "count", "nunique") else F.col(f"v{j}_{a}") for j, a in measures}
    prefix = (lambda a, name: f"{a}_{name}") if len(aggregations) > 1 else (lambda a, name: name)
    all_columns, all_rows = (1 << len(c)) - 1, ((1 << len(r)) - 1) << len(c)

    grand = cells.filter(F.col("level") == (all_rows | all_columns)).first()
    if not columns:
        wide = cells.select(*r, (F.col("level") != 0).alias("__total"), *[zero[m].alias(f"{i}") for i, m in enumerate(measures)])
        names = [prefix(a, values[j]) for j, a in measures]
        denominators = [_number(grand, m) for m in measures]
        shown = [_share(F.col(f"`{i}`"), denominators[i], show_as in ("column", "total")) for i in range(len(measures))]
    else:
        heads = cells.filter(F.col("level") == all_rows) if rows else cells.filter("level = 0")
        keys = _observed(heads, c, df, columns, date_groups, setting(df.sparkSession, "pivotColumns", MOST_COLUMNS))
        pivot_key = F.when(F.col("level").bitwiseAND(F.lit(all_columns)) == all_columns, F.lit("\u0002")) \
            .otherwise(F.concat_ws(_SEPARATOR, *[F.col(x) for x in c]))
        long = cells.select(*r, (F.col("level").bitwiseAND(F.lit(all_rows)) != 0).alias("__total"), pivot_key.alias("__head"),
                            *[zero[m].alias(f"m{i}") for i, m in enumerate(measures)])
        spelled = [_SEPARATOR.join(k[x] for x in c) for k in keys] + ["\u0002"]
        pivoted = long.groupBy(*r, "__total").pivot("__head", spelled).agg(
            *[F.first(f"m{i}").alias(f"m{i}") for i in range(len(measures))], F.count(F.lit(1)).alias("__n"))
        width = len(measures) + 1
        flat = pivoted.toDF(*r, "__total", *[f"x{k}_{i}" for k in range(len(spelled)) for i in range(width)])
        wide, names, shown = flat, [], []
        for a in aggregations:
            for j in range(len(values)):
                i = measures.index((j, a))
                empty = F.lit(0) if a in ("sum", "count", "nunique") else F.lit(None)
                for k in range(len(spelled)):
                    tail = [keys[k][x] for x in c] if k < len(keys) else [total]
                    names.append(prefix(a, "_".join([values[j], *tail])))
                    cell = F.coalesce(F.col(f"x{k}_{i}"), empty)
                    if show_as == "row":
                        cell = F.try_divide(cell.cast("double"), F.nullif(F.col(f"x{len(keys)}_{i}").cast("double"), F.lit(0.0)))
                    elif show_as == "column":
                        cell = _share(cell, _number(keys[k] if k < len(keys) else grand, (j, a)), True)
                    elif show_as == "total":
                        cell = _share(cell, _number(grand, (j, a)), True)
                    shown.append(cell)
    unique = []
    for n in names:
        unique.append(free_name(n, unique + rows))
    first_label = [F.when(F.col("__total"), F.lit(total if i == 0 else "")).otherwise(F.col(x)).alias(n) for i, (x, n) in enumerate(zip(r, rows))]
    if rows:
        wide = wide.orderBy("__total", *_row_order(df, rows, r, date_groups))
    return Result(wide.select(*first_label, *[s.alias(n) for s, n in zip(shown, unique)]), metrics=metrics)


def _number(row, measure) -> float:
    return float(row[f"v{measure[0]}_{measure[1]}"] or 0)


def _share(cell: Column, denominator: float, wanted: bool) -> Column:
    if not wanted:
        return cell
    return cell.cast("double") / F.lit(denominator) if denominator else F.lit(None).cast("double")


def _observed(heads: DataFrame, c: list[str], df: DataFrame, columns: list[str], date_groups, most: int) -> list:
    """The column labels that occur, with their totals: numbers in number order, text in text order, blanks last."""
    found = heads.limit(most + 1).collect()
    if len(found) > most:
        raise TableError(f"the column fields have more than {most:,} different labels")

    def place(row):
        key = []
        for x, n in zip(c, columns):
            label = row[x]
            numeric = is_number(type_of(df, n)) and n not in (date_groups or {}) and label != "(blank)"
            key.append((label == "(blank)", float(label) if numeric else 0.0, label))
        return key
    return sorted(found, key=place)
