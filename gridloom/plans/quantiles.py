"""Exact quantiles by radix selection, so that no task holds a whole column or a whole large group.

Every number has a 64-bit key in the same order (`order_key`). Three rounds look at 16 more bits of it each: the rows are counted by
the bits seen so far, and a running sum over these at most 65,536 counters tells in which of them a rank lies. Later rounds
read only the rows that share these bits, and the last one sorts values, of which 48 common bits leave at most 65,536. Rounds
that would find few rows are left out. One set of rounds serves all columns, all groups and all ranks.
"""
from __future__ import annotations

import functools
import math
import operator
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.cells import col
from ..session import setting, written
from .order import largest_group

EXACT_VALUES = 1_000_000          # rows of a group whose distinct values the built-in percentile may hold
FEW_ROWS = 65_536                 # values that are sorted instead of counted by their bits
_BITS, _ROUNDS = 16, 3
_SMALLEST_NORMAL = 2.0 ** -1022
_N, _ROWS, _RANKS, _VALUE, _KEY, _SEEN, _STEP = "__n", "__rows", "__ranks", "__value", "__key", "__seen", "__step"


def order_key(value: Column) -> Column:
    """A bigint for each double, in the same order; NaN is the largest, as in Spark's sort.

    It is the number's layout in memory, found by arithmetic that rounds nowhere: powers of two are exact, and the quotient by
    one of them is too. The logarithm may be off by one next to a power of two, which the quotient shows."""
    size = F.abs(value)
    guess = F.greatest(F.least(F.floor(F.log2(size)), F.lit(1023)), F.lit(-1022))
    quotient = size / F.pow(F.lit(2.0), guess)
    step = F.when(quotient >= 2, F.lit(1)).when((quotient < 1) & (guess > -1022), F.lit(-1)).otherwise(F.lit(0))
    exponent = (guess + step).cast("bigint")
    fraction = (size / F.pow(F.lit(2.0), exponent) - 1) * F.lit(2.0 ** 52)
    tiny = (size * F.lit(2.0 ** 537) * F.lit(2.0 ** 537)).cast("bigint")
    plain = F.shiftleft(exponent + 1023, 52) + fraction.cast("bigint")
    key = F.when(size == 0, F.lit(0).cast("bigint")).when(size == F.lit(float("inf")), F.lit(2047 << 52)) \
        .when(size < F.lit(_SMALLEST_NORMAL), tiny).otherwise(plain)
    return F.when(F.isnan(value), F.lit(2 ** 63 - 1)).when(value < 0, -key).otherwise(key)


def _matched(df: DataFrame, live: DataFrame, names: list[str], extra: list[str], how: str) -> DataFrame:
    """`df` joined on the names, NULL equal to NULL, with the columns `extra` of `live`."""
    renamed = live.select(*[col(n).alias(f"__live{i}") for i, n in enumerate(names)], *extra)
    match = functools.reduce(operator.and_, [col(n).eqNullSafe(F.col(f"__live{i}")) for i, n in enumerate(names)])
    return df.join(renamed, match, how).drop(*[f"__live{i}" for i in range(len(names))])


def _holding_ranks(counted: DataFrame, within: list[str], step: str) -> DataFrame:
    """The steps that hold a rank, with the ranks counted from the step's first row."""
    window = W.partitionBy(*[col(n) for n in within]).orderBy(step).rowsBetween(W.unboundedPreceding, -1)
    before = F.coalesce(F.sum(_N).over(window), F.lit(0))
    placed = counted.withColumn("__before", before)
    inside = F.filter(_RANKS, lambda r: (r["at"] >= F.col("__before")) & (r["at"] < F.col("__before") + F.col(_N)))
    moved = F.transform(inside, lambda r: F.struct((r["at"] - F.col("__before")).alias("at"), r["rank"].alias("rank")))
    return placed.withColumn(_RANKS, moved).filter(F.size(_RANKS) > 0).drop("__before")


def _ranked_values(df: DataFrame, keys: list[str], ps: list[float], hold: Callable[[DataFrame], tuple[DataFrame, int]]) -> DataFrame:
    """(keys, rows, rank, value) from rows (keys, value, n). Ranks 2i and 2i+1 are the neighbours of the i-th quantile.

    `hold` keeps the steps of a round, so that the next one does not find them again, and tells the rows of the largest."""
    few = setting(df.sparkSession, "fewRows", FEW_ROWS)
    keyed, within, live = df.withColumn(_KEY, order_key(F.col(_VALUE))), list(keys), None
    for done in range(_ROUNDS):
        shift = 64 - _BITS * (done + 1)
        rows = keyed if live is None else _matched(keyed.withColumn(_SEEN, F.shiftright(_KEY, shift + _BITS)), live, within, [], "left_semi")
        counted = rows.groupBy(*[col(n) for n in within], F.shiftright(_KEY, shift).alias(_STEP)).agg(F.sum(_N).alias(_N))
        if live is None:
            total = F.sum(_N).over(W.partitionBy(*[col(k) for k in keys]))
            counted = counted.withColumn(_ROWS, total).withColumn(_RANKS, F.array(*[
                F.struct(nearest((F.col(_ROWS) - 1) * F.lit(float(p))).cast("bigint").alias("at"), F.lit(2 * i + j).alias("rank"))
                for i, p in enumerate(ps) for j, nearest in enumerate((F.floor, F.ceil))]))
        else:
            counted = _matched(counted, live, within, [_ROWS, _RANKS], "inner")
        live, most = hold(_holding_ranks(counted, within, _STEP).select(*[col(k) for k in keys], F.col(_STEP).alias(_SEEN), _N, _ROWS, _RANKS))
        within = [*keys, _SEEN]
        if most <= few:
            break
    left = _matched(keyed.withColumn(_SEEN, F.shiftright(_KEY, shift)), live, within, [], "left_semi")
    values = left.groupBy(*[col(n) for n in within], _VALUE).agg(F.sum(_N).alias(_N))
    found = _holding_ranks(_matched(values, live, within, [_ROWS, _RANKS], "inner"), within, _VALUE)
    return found.select(*[col(k) for k in keys], _ROWS, _VALUE, F.explode(_RANKS).alias("__r")).select("*", F.col("__r.rank").alias("__rank")).drop("__r")


def _hold_on_driver(live: DataFrame) -> tuple[DataFrame, int]:
    """For few groups: a list on the driver, broadcast."""
    rows = live.collect()
    return F.broadcast(live.sparkSession.createDataFrame(rows, live.schema)), max((r[_N] for r in rows), default=0)


def _hold_in_table(live: DataFrame) -> tuple[DataFrame, int]:
    """For any number of groups."""
    table = written(live)
    return table, table.agg(F.max(_N).alias("n")).first().n or 0


def _between(low, high, at, floor, ceil):
    """Linear interpolation as the built-in percentile does it; numbers and columns alike."""
    return (ceil - at) * low + (at - floor) * high


def exact_quantiles(df: DataFrame, values: dict[str, Column], ps: list[float]) -> dict[str, dict[float, float | None]]:
    """{name: {p: value}} with linear interpolation between neighbours. A round is one pass for all columns.

    Only the steps that hold a rank reach the driver: two for each column and quantile."""
    names = list(values)
    cells = [F.struct(F.lit(i).alias("__column"), values[n].cast("double").alias(_VALUE)) for i, n in enumerate(names)]
    long = df.select(F.inline(F.array(*cells))).filter(F.col(_VALUE).isNotNull()).withColumn(_N, F.lit(1).cast("bigint"))
    found = {(r["__column"], r["__rank"]): r for r in _ranked_values(long, ["__column"], ps, _hold_on_driver).collect()}
    out: dict[str, dict[float, float | None]] = {n: {p: None for p in ps} for n in names}
    for (i, rank), low in found.items():
        if rank % 2 == 0:
            high, p = found[i, rank + 1][_VALUE], ps[rank // 2]
            at = p * (low[_ROWS] - 1)
            out[names[i]][p] = low[_VALUE] if low[_VALUE] == high else _between(low[_VALUE], high, at, math.floor(at), math.ceil(at))
    return out


def grouped_quantile(df: DataFrame, keys: list[str], value: Column, p: float, name: str) -> DataFrame:
    """One row per group with the exact quantile of `value`; groups without a value are left out."""
    narrow = df.select(*[col(k) for k in keys], value.cast("double").alias(_VALUE)).filter(F.col(_VALUE).isNotNull())
    group = [col(k) for k in keys]
    if not keys:
        found = exact_quantiles(narrow, {"v": F.col(_VALUE)}, [p])["v"][p]
        return df.sparkSession.range(1).select(F.lit(found).cast("double").alias(name))
    if largest_group(narrow, keys) <= setting(df.sparkSession, "exactValues", EXACT_VALUES):
        return narrow.groupBy(*group).agg(F.percentile(_VALUE, F.lit(p)).alias(name))
    counted = written(narrow.groupBy(*group, _VALUE).agg(F.count(F.lit(1)).alias(_N)))
    ends = _ranked_values(counted, keys, [p], _hold_in_table).groupBy(*group).agg(
        F.max(_ROWS).alias(_ROWS), *[F.max(F.when(F.col("__rank") == i, F.col(_VALUE))).alias(n) for i, n in enumerate(("__low", "__high"))])
    at, low, high = (F.col(_ROWS) - 1) * F.lit(float(p)), F.col("__low"), F.col("__high")
    return ends.select(*group, F.when(low == high, low).otherwise(_between(low, high, at, F.floor(at), F.ceil(at))).alias(name))
