"""Merge two tables on keys, with explicit rules for blank and repeated keys."""
from __future__ import annotations

import functools
import operator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.cells import (TableError, canonical_text, col, is_missing, is_number, is_text, present, require_columns,
                               type_of)
from ..plans.order import file_order, fits_one_task
from .result import Result

JOINS = ("inner", "left", "right", "outer", "left_only", "right_only")
DUPLICATES = ("keep_all", "keep_first", "error")


def aligned_keys(left: DataFrame, left_keys: list[str], right: DataFrame, right_keys: list[str]) -> tuple[list[Column], list[Column]]:
    """Key columns that compare across types: numbers meet text as text (123 is '123', but '00123' is not)."""
    a, b = [], []
    for x, y in zip(left_keys, right_keys):
        dx, dy = type_of(left, x), type_of(right, y)
        cx, cy = present(col(x), dx), present(col(y), dy)
        if is_number(dx) and is_text(dy):
            cx = canonical_text(cx, dx)
        elif is_text(dx) and is_number(dy):
            cy = canonical_text(cy, dy)
        elif is_text(dx) != is_text(dy) or isinstance(dx, T.BooleanType) != isinstance(dy, T.BooleanType):
            raise TableError(f"keys {x!r} and {y!r} hold values of different kinds")
        a.append(cx)
        b.append(cy)
    return a, b


def _key_columns(df: DataFrame, keys: list[str], columns: list[str] | None) -> list[str]:
    if not columns:
        return list(df.columns)
    require_columns(df, columns)
    return [k for k in keys if k not in columns] + list(columns)


@dataclass
class _Side:
    with_key: DataFrame          # k0.. the aligned keys, then the columns under the side's prefix
    without_key: DataFrame
    keys: list[str]
    unique: bool

    def key_counts(self, name: str) -> DataFrame:
        return self.with_key.groupBy(*self.keys).agg(F.count(F.lit(1)).alias(name))


def _side(df, keys, aligned, columns, prefix, duplicates, order_by) -> _Side:
    missing = functools.reduce(operator.or_, [is_missing(col(k), type_of(df, k)) for k in keys])
    names = [f"{prefix}k{i}" for i in range(len(keys))]
    chosen = [a.alias(n) for a, n in zip(aligned, names)] + [col(n).alias(f"{prefix}{i}") for i, n in enumerate(columns)]
    present_rows, keyless = df.filter(~missing), df.filter(missing).select(*chosen)
    if duplicates == "keep_first":
        # `row_number() = 1` is applied before the shuffle as well: a repeated key is one row per task
        window = W.partitionBy(*names).orderBy("__order")
        order = F.struct(*file_order(df, order_by)).alias("__order")
        first = present_rows.select(*chosen, order).withColumn("__nth", F.row_number().over(window)).filter("__nth = 1")
        return _Side(first.drop("__nth", "__order"), keyless, names, True)
    side = _Side(present_rows.select(*chosen), keyless, names, False)
    if duplicates == "error":
        repeats = side.key_counts("n").agg(F.sum(F.col("n") - 1).alias("n")).first().n or 0
        if repeats:
            raise TableError(f"{repeats:,} rows repeat a key; handle the duplicates first")
        side.unique = True
    return side


def _sides(left, right, left_keys, right_keys, duplicates, left_columns, right_columns, left_order, right_order):
    left_keys, right_keys = list(left_keys), list(right_keys)
    if not left_keys or len(left_keys) != len(right_keys):
        raise TableError("choose the same number of key columns on both sides")
    if len(set(left_keys)) < len(left_keys) or len(set(right_keys)) < len(right_keys):
        raise TableError("a key column is chosen more than once")
    require_columns(left, left_keys, "the left table")
    require_columns(right, right_keys, "the right table")
    if duplicates not in DUPLICATES:
        raise TableError(f"duplicates is one of {', '.join(DUPLICATES)}")
    a, b = aligned_keys(left, left_keys, right, right_keys)
    names_a, names_b = _key_columns(left, left_keys, left_columns), _key_columns(right, right_keys, right_columns)
    return (_side(left, left_keys, a, names_a, "l", duplicates, left_order),
            _side(right, right_keys, b, names_b, "r", duplicates, right_order), names_a, names_b)


def _on(a: _Side, b: _Side) -> Column:
    return functools.reduce(operator.and_, [F.col(x) == F.col(y) for x, y in zip(a.keys, b.keys)])


def _unmatched(a: _Side, b: _Side) -> DataFrame:
    """Rows of `a` without a partner, rows without a key included. The keys of `b` are reduced to one row each."""
    partners = b.with_key if b.unique else b.with_key.select(*b.keys).distinct()
    return a.with_key.join(partners.select(*b.keys), _on(a, b), "left_anti").unionByName(a.without_key)


def merge_tables(left: DataFrame, right: DataFrame, left_keys, right_keys=None, how: str = "inner",
                 duplicates: str = "keep_first", left_columns=None, right_columns=None,
                 left_order=None, right_order=None) -> Result:
    """Join on one or more key pairs. A key with a missing part matches nothing.

    `duplicates`: keep the first row of a repeated key, keep all rows, or refuse. Keys of the same name come out once;
    other shared names get `_left` and `_right`. `left_only` and `right_only` give the rows without a partner.
    Metrics: one row of counts of rows, matches and multiplied rows.

    Rows without a key are set aside and added back, so they never meet in one task. With repeated keys kept, the size
    of the largest key group decides how an outer join runs: Spark can split a hot key of either side of an inner join,
    but not of the side that an outer join keeps whole, so beyond one task's worth of rows the outer join is the inner
    join plus the unmatched rows of each side."""
    right_keys = left_keys if right_keys is None else right_keys
    left_keys = [left_keys] if isinstance(left_keys, str) else list(left_keys)
    right_keys = [right_keys] if isinstance(right_keys, str) else list(right_keys)
    if how not in JOINS:
        raise TableError(f"the join is one of {', '.join(JOINS)}")
    a, b, names_a, names_b = _sides(left, right, left_keys, right_keys, duplicates, left_columns, right_columns,
                                    left_order, right_order)
    metrics = _statistics(a, b, how)
    if how == "left_only":
        rows = _unmatched(a, b)
        return Result(rows.select(*[F.col(f"l{i}").alias(n) for i, n in enumerate(names_a)]), metrics=metrics)
    if how == "right_only":
        rows = _unmatched(b, a)
        return Result(rows.select(*[F.col(f"r{i}").alias(n) for i, n in enumerate(names_b)]), metrics=metrics)

    if how == "inner" or _direct(a, b, how):
        joined = a.with_key.join(b.with_key, _on(a, b), {"outer": "full"}.get(how, how))
        extra = ([a.without_key] if how in ("left", "outer") else []) + ([b.without_key] if how in ("right", "outer") else [])
    else:
        joined = a.with_key.join(b.with_key, _on(a, b), "inner")
        extra = ([_unmatched(a, b)] if how in ("left", "outer") else []) + ([_unmatched(b, a)] if how in ("right", "outer") else [])
    for rows in extra:
        joined = joined.unionByName(rows, allowMissingColumns=True)
    return Result(joined.select(*_output(names_a, names_b, left_keys, right_keys)), metrics=metrics)


def _direct(a: _Side, b: _Side, how: str) -> bool:
    """Whether the outer join can be one join: the sides it cannot split have no hot key."""
    whole = {"left": [b], "right": [a], "outer": [a, b]}[how]
    return all(side.unique or fits_one_task(side.with_key, side.keys) for side in whole)


def _output(names_a, names_b, left_keys, right_keys) -> list[Column]:
    """Left columns, then right columns. A shared key name takes its value from whichever side has the row."""
    shared = {x for x, y in zip(left_keys, right_keys) if x == y}
    overlap = (set(names_a) & set(names_b)) - shared
    out = []
    for i, n in enumerate(names_a):
        if n in shared:
            k = left_keys.index(n)
            out.append(F.coalesce(F.col(f"lk{k}"), F.col(f"rk{k}")).alias(n))
        else:
            out.append(F.col(f"l{i}").alias(f"{n}_left" if n in overlap else n))
    for j, n in enumerate(names_b):
        if n not in shared:
            out.append(F.col(f"r{j}").alias(f"{n}_right" if n in overlap else n))
    return out


def _statistics(a: _Side, b: _Side, how: str) -> DataFrame:
    """One row of counts from key-level counts of both sides; the join itself is not run for it."""
    counts = a.key_counts("na").join(b.key_counts("nb"), _on(a, b), "full") \
        .select(F.coalesce("na", F.lit(0)).alias("na"), F.coalesce("nb", F.lit(0)).alias("nb"), F.lit(0).alias("xa"), F.lit(0).alias("xb"))
    keyless = a.without_key.agg(F.count(F.lit(1)).alias("xa")).select(
        F.lit(0).alias("na"), F.lit(0).alias("nb"), "xa", F.lit(0).alias("xb")).unionByName(
        b.without_key.agg(F.count(F.lit(1)).alias("xb")).select(F.lit(0).alias("na"), F.lit(0).alias("nb"), F.lit(0).alias("xa"), "xb"))
    na, nb = F.col("na"), F.col("nb")
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("bigint")
    sums = counts.unionByName(keyless).agg(
        total(na + F.col("xa")).alias("left_rows"), total(nb + F.col("xb")).alias("right_rows"),
        total(na * nb).alias("pairs"), total(F.when(nb > 0, na).otherwise(0)).alias("left_matched"),
        total(F.when(na > 0, nb).otherwise(0)).alias("right_matched"))
    left_out = F.col("left_rows") - F.col("left_matched")
    right_out = F.col("right_rows") - F.col("right_matched")
    pairs = F.col("pairs")
    merged = {"inner": pairs, "left": pairs + left_out, "right": pairs + right_out, "outer": pairs + left_out + right_out,
              "left_only": left_out, "right_only": right_out}[how]
    matched = {"left_only": F.col("left_matched"), "right_only": F.col("right_matched")}.get(how, pairs)
    base = F.col("right_matched") if how == "right" else F.col("left_matched")
    return sums.select("left_rows", "right_rows", merged.alias("merged_rows"), matched.alias("matched_rows"),
                       left_out.alias("unmatched_left"), right_out.alias("unmatched_right"),
                       F.coalesce(F.round(F.try_divide(matched.cast("double"), base), 2), F.lit(1.0)).alias("multiplication_factor"),
                       (matched > base if not how.endswith("_only") else F.lit(False)).alias("rows_multiplied"),
                       F.lit(how.upper()).alias("join_type"))
