"""Column normalizer: text to numbers, dates and booleans without ever losing what could not be converted."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.cells import (TableError, canonical_text, col, date_order, free_name, is_missing, is_number, is_text,
                               present, require_columns, strip, type_of, written_date, written_integer, written_number)
from .result import Result

# Words for true and false.
TRUE_WORDS = ["true", "1", "yes", "y", "t"]
FALSE_WORDS = ["false", "0", "no", "n", "f"]
NUMBER_TYPES = ("float", "decimal", "currency", "dollar", "percentage")
TARGETS = ("text", "string", "integer", *NUMBER_TYPES, "date", "boolean")


def _as_number(c: Column, dtype: T.DataType, target: str, point: str) -> Column:
    if is_number(dtype):
        return present(c.cast("double"), T.DoubleType())
    if not is_text(dtype):
        return F.lit(None).cast("double")
    if target != "percentage":
        return written_number(c, point)
    tidy = strip(c)
    signed = written_number(F.substring(tidy, F.lit(1), F.length(tidy) - 1), point) / 100.0
    return F.when(F.endswith(tidy, F.lit("%")), signed).otherwise(written_number(c, point))


def _as_integer(c: Column, dtype: T.DataType, point: str) -> Column:
    if isinstance(dtype, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return c.cast("bigint")
    if is_number(dtype):
        return F.when((c == F.floor(c)) & (F.abs(c) < 9.2e18), c.try_cast("bigint"))
    return written_integer(c, point) if is_text(dtype) else F.lit(None).cast("bigint")


def _as_boolean(c: Column, dtype: T.DataType, point: str) -> Column:
    if isinstance(dtype, T.BooleanType):
        return c
    word = F.lower(strip(canonical_text(c, dtype)))
    return F.when(word.isin(TRUE_WORDS), True).when(word.isin(FALSE_WORDS), False) \
        .otherwise(_as_number(c, dtype, "float", point) != 0)


def converted(df: DataFrame, name: str, target: str, point: str = ".", order: str = "auto", trim: bool = False) -> Column:
    """One column in its target type, NULL where a cell does not convert."""
    if target not in TARGETS:
        raise TableError(f"unknown type {target!r}; use one of {', '.join(TARGETS)}")
    c, dtype = col(name), type_of(df, name)
    if target in ("text", "string"):
        text = canonical_text(c, dtype)
        return strip(text) if trim and is_text(dtype) else text
    if target == "integer":
        return _as_integer(c, dtype, point)
    if target == "boolean":
        return _as_boolean(c, dtype, point)
    if target == "date":
        return written_date(c, dtype, (date_order(df, name) or "MDY") if order == "auto" else order)
    return _as_number(c, dtype, target, point)


def normalize_types(df: DataFrame, targets: dict[str, str], point: str = ".", order: str = "auto", trim: bool = False,
                    keep_original: bool = True) -> Result:
    """Convert columns. Each becomes its typed value, followed by `<c>_original` (the cell as it was) and `<c>_failed`.

    Metrics: one row per column with the counts of converted and failed cells and an example of a failure."""
    require_columns(df, targets)
    taken = list(df.columns)
    original, failed = {}, {}
    for n in targets:
        original[n] = free_name(f"{n}_original", taken)
        failed[n] = free_name(f"{n}_failed", taken)
        taken += [original[n], failed[n]]
    typed = {n: converted(df, n, t, point, order, trim) for n, t in targets.items()}
    out, probe = [], []
    for n in df.columns:
        if n not in targets:
            out.append(col(n))
            continue
        there = ~is_missing(col(n), type_of(df, n))
        out.append(typed[n].alias(n))
        if keep_original:
            out.append(col(n).alias(original[n]))
        out.append((there & typed[n].isNull()).alias(failed[n]))
        probe.append(F.struct(F.lit(n).alias("column"), F.lit(targets[n]).alias("type"), there.alias("there"),
                              typed[n].isNotNull().alias("ok"), canonical_text(col(n), type_of(df, n)).alias("text")))
    bad = F.col("p.there") & ~F.col("p.ok")
    metrics = df.select(F.explode(F.array(*probe)).alias("p")).groupBy(F.col("p.column").alias("column"), F.col("p.type").alias("type")) \
        .agg(F.count_if(F.col("p.there") & F.col("p.ok")).alias("converted"), F.count_if(bad).alias("failed"),
             F.left(F.min(F.when(bad, F.col("p.text"))), F.lit(30)).alias("example")) if probe else None
    return Result(df.select(*out), metrics=metrics)
