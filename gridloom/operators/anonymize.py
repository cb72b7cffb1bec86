"""Anonymization: the same value always gets the same pseudonym, blanks stay blank."""
from __future__ import annotations

import functools
import operator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.cells import TableError, canonical_text, col, free_name, require_columns, type_of
from ..plans.order import dense_index, first_place, order_names
from .dedupe import same_cells
from .result import Result

BLANK_SHARES = 256          # tasks over which blank cells are dealt, at most

# Fixed value: name endings that say nothing about the values.
SUFFIXES = ["_name", "_code", "_id", "_number", "_num", "_date", "_amount", "_value", "_account"]


def pseudonym_prefix(column: str) -> str:
    """The column's name without such an ending, and ' - ' if it has spaces, otherwise '_'."""
    for suffix in SUFFIXES:
        if column.lower().endswith(suffix):
            column = column[:-len(suffix)]
            break
    return column + (" - " if " " in column else "_")


def _mapping(df: DataFrame, columns: list[str], prefix: str, digits: int, order_by) -> DataFrame:
    """k0.. (canonical texts), o0.. (as first written) and the pseudonym, numbered by first appearance."""
    texts = [canonical_text(col(n), type_of(df, n)) for n in columns]
    at = first_place(df, order_by)
    some = functools.reduce(operator.or_, [t.isNotNull() for t in texts])
    found = df.filter(some).groupBy(*[t.alias(f"k{i}") for i, t in enumerate(texts)]).agg(
        F.min(at).alias("__at"), *[F.min_by(col(n), at).alias(f"o{i}") for i, n in enumerate(columns)])
    numbered = dense_index(found, [F.col("__at")], "__number", ascending=True)
    number = F.col("__number").cast("string")
    padded = F.when(F.length(number) < digits, F.lpad(number, digits, "0")).otherwise(number) if digits else number
    # the numbering has written the values once, and reads them back here
    return numbered.select(*[f"k{i}" for i in range(len(columns))], *[f"o{i}" for i in range(len(columns))], F.concat(F.lit(prefix), padded).alias("pseudonym"))


def anonymize(df: DataFrame, columns: list[str], related: bool = False, order_by=None, short_prefix: bool = False) -> Result:
    """Replace the values of some columns by pseudonyms.

    Independent: each column has its own, `Vendor_1`, `Vendor_2`, ... by first appearance. `related` (two or more
    columns): one pseudonym per combination of values, shared by its columns. `short_prefix` gives `VEN_00001`.
    `side("mapping")` lists columns, original and pseudonym."""
    columns = list(dict.fromkeys(columns))
    require_columns(df, columns)
    if not columns:
        raise TableError("choose at least one column to anonymize")
    groups = [columns] if related and len(columns) > 1 else [[n] for n in columns]
    out, replaced, listed = df, {}, []
    for g, names in enumerate(groups):
        prefix = f"{names[0][:3].upper()}_" if short_prefix else pseudonym_prefix(names[0])
        mapping = _mapping(df, names, prefix, 5 if short_prefix else 0, order_by)
        listed.append(mapping.select(F.array(*[F.lit(n) for n in names]).alias("columns"),
                                     F.array(*[F.col(f"o{i}").cast("string") for i in range(len(names))]).alias("original"), "pseudonym"))
        name = free_name(f"__pseudonym_{g}", out.columns)
        side = mapping.select(*[F.col(f"k{i}").alias(f"__m{g}_{i}") for i in range(len(names))], F.col("pseudonym").alias(name))
        pairs = [(canonical_text(col(n), type_of(df, n)), F.col(f"__m{g}_{i}")) for i, n in enumerate(names)]
        spread, none = free_name(f"__spread_{g}", out.columns), f"__none_{g}"
        if len(names) == 1:
            # blanks match nothing; a second key deals them out over many tasks
            blank = F.pmod(F.xxhash64(*[col(n) for n in order_names(df, order_by)]), F.lit(BLANK_SHARES)) + 1
            out = out.withColumn(spread, F.when(pairs[0][0].isNull(), blank).otherwise(F.lit(0)).cast("int"))
            match = (pairs[0][0] == pairs[0][1]) & (F.col(spread) == F.col(none))
            side = side.withColumn(none, F.lit(0))
        else:
            match = same_cells(pairs)
        out = out.join(side, match, "left").drop(spread, none, *[f"__m{g}_{i}" for i in range(len(names))])
        for n in names:
            there: Column = canonical_text(col(n), type_of(df, n)).isNotNull()
            replaced[n] = F.when(there, F.col(name))
    result = out.select(*[(replaced[n] if n in replaced else col(n)).alias(n) for n in df.columns])
    return Result(result, {"mapping": functools.reduce(DataFrame.unionByName, listed)})


def verify_anonymized(source: DataFrame, result: DataFrame, columns: list[str], mapping: DataFrame) -> None:
    """Raise unless blanks are unchanged and every other value of the columns is a pseudonym. Run before publishing."""
    require_columns(result, columns, "the result")
    filled = lambda df: df.agg(*[F.count(canonical_text(col(n), type_of(df, n))).alias(f"n{i}") for i, n in enumerate(columns)],
                               F.count(F.lit(1)).alias("rows")).first()
    before, after = filled(source), filled(result)
    for i, n in enumerate(columns):
        if before.rows - before[f"n{i}"] != after.rows - after[f"n{i}"]:
            raise TableError(f"blank cells changed in column {n!r}; nothing was saved")
    allowed = mapping.select(F.explode("columns").alias("column"), F.col("pseudonym").alias("value")).distinct()
    cells = result.select(F.explode(F.array(*[F.struct(F.lit(n).alias("column"), col(n).cast("string").alias("value")) for n in columns])).alias("c"))
    seen = cells.select("c.column", "c.value").filter("value is not null").distinct()
    left = seen.join(allowed, ["column", "value"], "left_anti").limit(1).collect()
    if left:
        raise TableError(f"values of column {left[0].column!r} are not anonymized; nothing was saved")
