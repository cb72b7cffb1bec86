"""Compare two versions of a table by key, compare two schemas, and describe what a step changed."""
from __future__ import annotations

import functools
import operator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.cells import (canonical_text, col, free_name, present, require_columns,
                               type_of)
from ..plans.order import POSITION, dense_index, file_order, order_names, running_sum, tie_names
from ..session import written
from .joins import aligned_keys
from .result import Result


def same_cell(a: Column, a_type, b: Column, b_type) -> Column:
    """Equal by canonical text, missing equal to missing. Cells of one type compare directly, which is the same."""
    if a_type == b_type:
        return present(a, a_type).eqNullSafe(present(b, b_type))
    return canonical_text(a, a_type).eqNullSafe(canonical_text(b, b_type))


@dataclass
class Comparison:
    """Rows of both tables side by side, one per key and occurrence; every output is a projection of `joined`.

    `joined` holds k0.. (key), occurrence, a0.. and b0.. (compared cells), d0.. (cell differs) and status."""
    joined: DataFrame
    keyless: DataFrame
    keys: list[str]
    columns: list[str]

    def _key(self) -> list[Column]:
        return [F.col(f"k{i}").alias(n) for i, n in enumerate(self.keys)]

    def _side(self, status: str, letter: str) -> DataFrame:
        cells = [F.col(f"{letter}{j}").alias(n) for j, n in enumerate(self.columns)]
        return self.joined.filter(F.col("status") == status).select(*self._key(), *cells)

    def status(self) -> DataFrame:
        return self.joined.select(*self._key(), F.col("occurrence").alias(free_name("occurrence", self.keys)),
                                  F.col("status").alias(free_name("status", self.keys)))

    def added(self) -> DataFrame:
        return self._side("added", "b")

    def removed(self) -> DataFrame:
        return self._side("removed", "a")

    def unchanged(self) -> DataFrame:
        return self._side("unchanged", "a")

    def changed(self) -> DataFrame:
        """Per compared column: `c (Old)` and `c (New)` where the cell changed, `c` where it did not."""
        out = []
        for j, n in enumerate(self.columns):
            out += [F.when(F.col(f"d{j}"), F.col(f"a{j}")).alias(f"{n} (Old)"), F.when(F.col(f"d{j}"), F.col(f"b{j}")).alias(f"{n} (New)"),
                    F.when(~F.col(f"d{j}"), F.col(f"a{j}")).alias(n)]
        return self.joined.filter(F.col("status") == "changed").select(*self._key(), *out)

    def changed_cells(self) -> DataFrame:
        """One row per changed cell: key, occurrence, column, old and new as text."""
        schema = self.joined.schema
        cells = F.array(*[F.when(F.col(f"d{j}"), F.struct(
            F.lit(n).alias("column"), canonical_text(F.col(f"a{j}"), schema[f"a{j}"].dataType).alias("old"),
            canonical_text(F.col(f"b{j}"), schema[f"b{j}"].dataType).alias("new"))) for j, n in enumerate(self.columns)])
        listed = self.joined.filter(F.col("status") == "changed") \
            .select("*", F.explode(F.filter(cells, lambda x: x.isNotNull())).alias("__cell"))
        return listed.select(*self._key(), F.col("occurrence").alias(free_name("occurrence", self.keys)), "__cell.column", "__cell.old", "__cell.new")

    def summary(self) -> DataFrame:
        """(metric, value) rows."""
        status = F.col("status")
        both = status.isin("changed", "unchanged")
        in_1, in_2 = both | (status == "removed"), both | (status == "added")
        counts = self.joined.agg(
            F.count_if(in_1).alias("rows_1"), F.count_if(in_2).alias("rows_2"), F.count_if(both).alias("common"),
            F.count_if(status == "added").alias("added"), F.count_if(status == "removed").alias("removed"),
            F.count_if(status == "changed").alias("changed"), F.count_if(status == "unchanged").alias("unchanged"),
            F.count_if(in_1 & (F.col("occurrence") > 1)).alias("repeated_key_1"),
            F.count_if(in_2 & (F.col("occurrence") > 1)).alias("repeated_key_2"))
        keyless = self.keyless.agg(F.count_if(F.col("__file") == 1).alias("keyless_1"), F.count_if(F.col("__file") == 2).alias("keyless_2"))

        def long(row: DataFrame) -> DataFrame:
            return row.select(F.explode(F.array(*[F.struct(F.lit(n).alias("metric"), F.col(n).alias("value"))
                                                  for n in row.columns])).alias("m")).select("m.metric", "m.value")
        parts = long(counts).unionByName(long(keyless))
        totals = parts.select(F.regexp_replace("metric", "^(rows|keyless)_", "total_rows_").alias("metric"), "value") \
            .filter(F.col("metric").startswith("total_rows_")).groupBy("metric").agg(F.sum("value").alias("value"))
        return totals.unionByName(parts.filter(~F.col("metric").startswith("rows_")))

    def rows_without_key(self) -> DataFrame:
        """Rows whose key columns are all missing, with the table they come from (1 or 2)."""
        return self.keyless.select(F.col("__file").alias(free_name("file", self.keys + self.columns)), *self._key(),
                                   *[F.col(f"c{j}").alias(n) for j, n in enumerate(self.columns)])


def compare_tables(first: DataFrame, second: DataFrame, keys: list[str], columns: list[str] | None = None,
                   first_order=None, second_order=None, keep: bool = False) -> Comparison:
    """Match rows on the key and on which occurrence of that key they are, then compare the other shared columns.

    A key with one missing part is a key; a row whose key is missing altogether is set aside. Because the occurrence is
    part of the join key, each pair is unique and a repeated key spreads over tasks. `keep` writes the matched rows once,
    for when several outputs are read."""
    require_columns(first, keys, "the first table")
    require_columns(second, keys, "the second table")
    if columns:
        require_columns(first, columns, "the first table")
        require_columns(second, columns, "the second table")
        columns = [n for n in columns if n not in keys]
    else:
        columns = [n for n in first.columns if n in second.columns and n not in keys]
    key_1, key_2 = aligned_keys(first, keys, second, keys)

    def side(df, key, letter, order_by):
        names = [f"{letter}k{i}" for i in range(len(keys))]
        order = F.struct(*file_order(df, order_by)).alias("__order")
        rows = df.select(*[k.alias(n) for k, n in zip(key, names)], *[col(n).alias(f"{letter}{j}") for j, n in enumerate(columns)], order)
        none = functools.reduce(operator.and_, [F.col(n).isNull() for n in names])
        ties = [] if order_names(df, order_by) == [POSITION] else ["__order"]
        numbered = running_sum(rows.filter(~none), names, [F.col("__order")], f"{letter}_nth", ties=ties).drop("__order")
        return numbered, rows.filter(none), names

    a, keyless_a, ka = side(first, key_1, "a", first_order)
    b, keyless_b, kb = side(second, key_2, "b", second_order)
    match = functools.reduce(operator.and_, [F.col(x).eqNullSafe(F.col(y)) for x, y in zip(ka, kb)]) & (F.col("a_nth") == F.col("b_nth"))
    differs = [(~same_cell(F.col(f"a{j}"), type_of(first, n), F.col(f"b{j}"), type_of(second, n))).alias(f"d{j}")
               for j, n in enumerate(columns)]
    joined = a.join(b, match, "full").select(
        *[F.coalesce(x, y).alias(f"k{i}") for i, (x, y) in enumerate(zip(ka, kb))],
        F.coalesce("a_nth", "b_nth").alias("occurrence"), "a_nth", "b_nth",
        *[F.col(f"a{j}") for j in range(len(columns))], *[F.col(f"b{j}") for j in range(len(columns))], *differs)
    any_change = functools.reduce(operator.or_, [F.col(f"d{j}") for j in range(len(columns))]) if columns else F.lit(False)
    joined = joined.withColumn("status", F.when(F.col("a_nth").isNull(), "added").when(F.col("b_nth").isNull(), "removed")
                               .when(any_change, "changed").otherwise("unchanged")).drop("a_nth", "b_nth")

    if keep:
        joined = written(joined)

    def keyless(rows, df, letter, number):
        cells = [canonical_text(F.col(f"{letter}{j}"), type_of(df, n)).alias(f"c{j}") for j, n in enumerate(columns)]
        return rows.select(F.lit(number).alias("__file"), *[F.col(f"{letter}k{i}").cast("string").alias(f"k{i}") for i in range(len(keys))], *cells)
    return Comparison(joined, keyless(keyless_a, first, "a", 1).unionByName(keyless(keyless_b, second, "b", 2)), list(keys), columns)


def compare_schemas(first: DataFrame, second: DataFrame) -> Result:
    """Every column name of either table, sorted, with where it occurs and its declared types. Reads no data."""
    types = [dict(df.dtypes) for df in (first, second)]
    names = sorted(set(types[0]) | set(types[1]))
    yes = lambda found: "Yes" if found else "No"
    spark = first.sparkSession
    table = spark.createDataFrame([(n, yes(n in types[0]), yes(n in types[1]), types[0].get(n), types[1].get(n)) for n in names],
                                  "column string, in_first string, in_second string, first_type string, second_type string")
    common = len(set(types[0]) & set(types[1]))
    metrics = spark.createDataFrame([(len(names), len(types[0]), len(types[1]), common, len(types[0]) - common, len(types[1]) - common)],
                                    "total long, first long, second long, common long, only_first long, only_second long")
    return Result(table, metrics=metrics)


def describe_change(before: DataFrame, after: DataFrame, order_by=None, sample: int = 8) -> Result:
    """What a step changed: `metrics` has the counts, `df` up to `sample` changed rows as (position, column, before, after).

    Rows are matched on their order columns, which must be unique; cells are compared in the columns both tables have.
    When the rows are not the same on both sides, the cell counts are NULL."""
    at = order_names(before, order_by)
    require_columns(after, at)
    shared = [n for n in before.columns if n in after.columns]
    left = before.select(F.lit(1).alias("__l"), *[col(n).alias(f"p{i}") for i, n in enumerate(at)], *[col(n).alias(f"a{i}") for i, n in enumerate(shared)])
    right = after.select(F.lit(1).alias("__r"), *[col(n).alias(f"q{i}") for i, n in enumerate(at)], *[col(n).alias(f"b{i}") for i, n in enumerate(shared)])
    match = functools.reduce(operator.and_, [F.col(f"p{i}").eqNullSafe(F.col(f"q{i}")) for i in range(len(at))])
    both = left.join(right, match, "full")
    changed = [~same_cell(F.col(f"a{i}"), type_of(before, n), F.col(f"b{i}"), type_of(after, n)) for i, n in enumerate(shared)]
    cells = functools.reduce(operator.add, [c.cast("bigint") for c in changed])
    paired = both.select("*", F.when(F.col("__l").isNotNull() & F.col("__r").isNotNull(), cells).alias("__cells"))
    same_rows = F.count(F.lit(1)) == F.count("__cells")
    metrics = paired.agg(F.count("__l").alias("rows_before"), F.count("__r").alias("rows_after"),
                         F.when(same_rows, F.coalesce(F.sum("__cells"), F.lit(0))).alias("cells_changed"),
                         F.when(same_rows, F.count_if(F.col("__cells") > 0)).alias("rows_changed"))
    listed = lambda names: F.array(*[F.lit(n) for n in names]).cast("array<string>")
    metrics = metrics.select("*", listed([n for n in after.columns if n not in before.columns]).alias("columns_added"),
                             listed([n for n in before.columns if n not in after.columns]).alias("columns_removed"))
    shown = paired.filter(F.col("__cells") > 0).orderBy(*[f"p{i}" for i in range(len(at))]).limit(sample)
    entry = F.array(*[F.when(c, F.struct(F.lit(n).alias("column"), canonical_text(F.col(f"a{i}"), type_of(before, n)).alias("before"),
                                         canonical_text(F.col(f"b{i}"), type_of(after, n)).alias("after")))
                      for i, (n, c) in enumerate(zip(shared, changed))])
    rows = shown.select(F.struct(*[F.col(f"p{i}").alias(n) for i, n in enumerate(at)]).alias("position"),
                        F.explode(F.filter(entry, lambda x: x.isNotNull())).alias("c"))
    return Result(rows.select("position", "c.column", "c.before", "c.after"), metrics=metrics)


def _sums(df: DataFrame, *cells: Column) -> tuple:
    """128 bits that are equal for equal multisets of rows, whatever their order: sums of two hashes of the row."""
    return tuple(df.agg(*[F.sum(F.xxhash64(F.lit(seed), *cells).cast("decimal(38,0)")) for seed in (1, 2)], F.count(F.lit(1))).first())


def reordered(before: DataFrame, after: DataFrame, order_by=None, after_order=None, columns: list[str] | None = None) -> bool:
    """Do both hold the same rows, repeats counted, in another order?

    `order_by` says how the rows of `before` are ordered, `after_order` those of `after` (the same when None); `columns` are
    compared, all that both tables have when None, but the position. One aggregate a table compares the rows; only if they
    agree, the rows are numbered and hashed with their numbers."""
    columns = columns or [n for n in before.columns if n in after.columns and n != POSITION]
    require_columns(before, columns, "the first table")
    require_columns(after, columns, "the second table")
    cells = lambda df: [canonical_text(present(col(n), type_of(df, n)), type_of(df, n)) for n in columns]                   # noqa: E731
    hashed = lambda df: [F.xxhash64(F.lit(seed), *[x for c in cells(df) for x in (c.isNull(), c)]) for seed in (3, 4)]      # noqa: E731
    if _sums(before, *hashed(before)) != _sums(after, *hashed(after)):
        return False

    def numbered(df, order):
        at = free_name("__at", df.columns)
        rows = dense_index(df, file_order(df, order), at, ties=tie_names(df, order), ascending=True)
        return _sums(rows, F.col(at), *hashed(df))
    return numbered(before, order_by) != numbered(after, after_order or order_by)
