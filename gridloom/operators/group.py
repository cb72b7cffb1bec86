"""Group and summarise: one row per group, one column per value column and function."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.cells import (TableError, canonical_text, col, filled, free_name, is_float, number_of, require_columns,
                               type_of)
from ..plans.order import order_value
from ..plans.quantiles import grouped_quantile
from .dedupe import same_cells
from .sorting import numeric_columns

FUNCTIONS = ("sum", "mean", "median", "min", "max", "count", "distinct", "first", "last")
NEED_NUMBERS = ("sum", "mean", "median")


def whole_or_double(df: DataFrame, name: str) -> Column:
    """Whole-number columns stay whole; everything else is summed as a double."""
    dtype = type_of(df, name)
    if isinstance(dtype, (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.DecimalType)):
        return col(name)
    return number_of(df, name)


def _function(df: DataFrame, name: str, function: str, numeric: bool, at: Column | None) -> Column:
    dtype = type_of(df, name)
    cell = filled(col(name), dtype)
    if function == "sum":
        return F.sum(whole_or_double(df, name))
    if function == "mean":
        return F.avg(whole_or_double(df, name))
    if function == "count":
        return F.count(cell)
    if function == "distinct":
        return F.count_distinct(cell if not is_float(dtype) else canonical_text(cell, dtype))
    if function in ("min", "max") and (numeric or not isinstance(dtype, T.StringType)):
        value = whole_or_double(df, name) if numeric else cell
        return F.min(value) if function == "min" else F.max(value)
    place = F.when(cell.isNotNull(), at)
    if function in ("min", "max"):
        # text without case, in its original spelling; equal texts: the first row for min, the last for max
        key = F.when(cell.isNotNull(), F.struct(F.lower(cell), at))
        return F.min_by(cell, key) if function == "min" else F.max_by(cell, key)
    return F.min_by(cell, place) if function == "first" else F.max_by(cell, place)


def group_summary(df: DataFrame, group_columns: list[str], value_columns: list[str] | None = None,
                  functions=("sum",), row_count: bool = True, order_by=None, first_appearance: bool = False) -> DataFrame:
    """One row per group, blank keys being one group; columns `rows` and `<column>_<function>`.

    Blanks are left out of every function and a function of no values is NULL. min and max are numeric when the whole
    column is, and compare text without case otherwise. `first_appearance` sorts the groups by their first row."""
    value_columns, functions = list(value_columns or []), [f for f in FUNCTIONS if f in functions]
    require_columns(df, [*group_columns, *value_columns])
    if not value_columns:
        functions = []
    if not group_columns or not (functions or row_count):
        raise TableError("choose columns to group by and something to calculate")
    overlap = [n for n in value_columns if n in group_columns]
    if overlap:
        raise TableError(f"{overlap[0]!r} is chosen both to group by and to summarise")

    asks_numbers = any(f in NEED_NUMBERS for f in functions)
    texts = {n: filled(col(n), type_of(df, n)) for n in value_columns if isinstance(type_of(df, n), T.StringType)}
    numeric = set(value_columns) - set(texts)
    if texts and (asks_numbers or {"min", "max"} & set(functions)):
        numeric |= numeric_columns(df.select(*[c.alias(n) for n, c in texts.items()]), list(texts))
    numeric = {n for n in numeric if isinstance(type_of(df, n), (T.NumericType, T.StringType, T.BooleanType))}
    if asks_numbers:
        wrong = [n for n in value_columns if n not in numeric]
        if wrong:
            raise TableError(f"{wrong[0]!r} has values that are not numbers; leave it out of sum, mean and median")

    ordered = first_appearance or {"first", "last"} & set(functions) or ({"min", "max"} & set(functions) and set(value_columns) - numeric)
    at = order_value(df, order_by) if ordered else None
    keys = [free_name(f"__key_{i}", df.columns) for i in range(len(group_columns))]
    keyed = df.select("*", *[filled(col(n), type_of(df, n)).alias(k) for n, k in zip(group_columns, keys)])
    rows_name = free_name("rows", group_columns)
    aggregates = [F.count(F.lit(1)).alias(rows_name)] if row_count else []
    aggregates += [_function(df, n, f, n in numeric, at).alias(f"{n}_{f}") for n in value_columns for f in functions if f != "median"]
    if first_appearance:
        aggregates.append(F.min(at).alias("__at"))
    out = keyed.groupBy(*keys).agg(*(aggregates or [F.count(F.lit(1)).alias("__rows")]))
    if "median" in functions:
        for n in value_columns:
            medians = grouped_quantile(keyed.select(*keys, whole_or_double(df, n).alias("__v")), keys, F.col("__v"), 0.5, f"{n}_median") \
                .select(*[F.col(k).alias(f"__m{k}") for k in keys], f"`{n}_median`")
            out = out.join(medians, same_cells([(F.col(k), F.col(f"__m{k}")) for k in keys]), "left").drop(*[f"__m{k}" for k in keys])
    if first_appearance:
        out = out.orderBy("__at")
    names = ([rows_name] if row_count else []) + [f"{n}_{f}" for n in value_columns for f in functions]
    return out.select(*[F.col(k).alias(n) for n, k in zip(group_columns, keys)], *[col(n) for n in names])
