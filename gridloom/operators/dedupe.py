"""Duplicates: find groups of equal rows, list the ids to remove, keep one row per group, count exact copies."""
from __future__ import annotations

import functools
import operator

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.cells import (TableError, canonical_text, col, free_name, is_missing, loose_text, present,
                               require_columns, type_of)
from ..plans.order import file_order, first_place, fits_one_task, order_value, running_sum, tie_names
from .result import Result

KEEP = ("first", "last", "most_complete")
IDS_PER_PAGE = 10_000


def _cell(df: DataFrame, name: str) -> Column:
    return present(col(name), type_of(df, name))


def same_cells(pairs: list[tuple[Column, Column]]) -> Column:
    """Equality of several cells, a missing cell being equal to a missing cell."""
    return functools.reduce(operator.and_, [a.eqNullSafe(b) for a, b in pairs])


def _candidates(df: DataFrame, id_column: str, columns: list[str], blank_is_value: bool) -> DataFrame:
    require_columns(df, [id_column, *columns])
    if not columns or id_column in columns:
        raise TableError("choose columns to compare other than the id column")
    if blank_is_value:
        return df
    return df.filter(~functools.reduce(operator.or_, [is_missing(col(n), type_of(df, n)) for n in columns]))


def _groups(rows: DataFrame, id_column: str, columns: list[str], order_by) -> DataFrame:
    """__g0.. (the cells), __count, __keep and __first per group of more than one row.

    One aggregate that combines before the shuffle, so a group of any size is one row per task."""
    at = first_place(rows, order_by)
    return rows.groupBy(*[_cell(rows, n).alias(f"__g{i}") for i, n in enumerate(columns)]).agg(
        F.count(F.lit(1)).alias("__count"), F.min_by(col(id_column), at).alias("__keep"), F.min(at).alias("__first")) \
        .filter(F.col("__count") > 1)


def duplicate_groups(df: DataFrame, id_column: str, columns: list[str], blank_is_value: bool = True, order_by=None) -> DataFrame:
    """One row per group of rows equal in `columns`: row_preview, count, keep_id (the first row's) and first_position."""
    groups = _groups(_candidates(df, id_column, columns, blank_is_value), id_column, columns, order_by)
    preview = F.concat_ws(", ", *[F.concat(F.lit(f"{n}="), F.coalesce(canonical_text(F.col(f"__g{i}"), type_of(df, n)), F.lit("")))
                                  for i, n in enumerate(columns)])
    return groups.select(preview.alias("row_preview"), F.col("__count").alias("count"), F.col("__keep").alias("keep_id"),
                         F.col("__first").alias("first_position"))


def _members(df: DataFrame, id_column: str, columns: list[str], blank_is_value: bool, order_by) -> DataFrame:
    """__c0.. (the cells), __id, __nth (place in the group) and __keep (the group's first id) for groups of two and more.

    While the largest group fits a task, one window gives all three. Beyond that the rows are numbered in slices and
    joined to the groups, which are one row each: a large group is large on one side only, where Spark can split it."""
    rows = _candidates(df, id_column, columns, blank_is_value)
    keys = [f"__c{i}" for i in range(len(columns))]
    cells = rows.select(*[_cell(rows, n).alias(k) for n, k in zip(columns, keys)], col(id_column).alias("__id"), order_value(rows, order_by).alias("__at"))
    if fits_one_task(cells, keys):
        group = W.partitionBy(*keys)
        placed = group.orderBy("__at")
        return cells.select("*", F.row_number().over(placed).cast("bigint").alias("__nth"), F.first("__id").over(placed).alias("__keep"),
                            F.count(F.lit(1)).over(group).alias("__count")).filter("__count > 1").drop("__at", "__count")
    ties = ["__at"] if tie_names(df, order_by) else []
    numbered = running_sum(cells, keys, [F.col("__at")], "__nth", ties=ties, sliced=True, ascending=True)
    match = same_cells([(F.col(k), F.col(f"__g{i}")) for i, k in enumerate(keys)])
    groups = _groups(rows, id_column, columns, order_by).drop("__first", "__count")
    return numbered.join(groups, match).select(*keys, "__id", "__nth", "__keep")


def duplicate_members(df: DataFrame, id_column: str, columns: list[str], blank_is_value: bool = True, order_by=None) -> DataFrame:
    """Every row of every duplicate group: keep_id (its group), id, and `remove` (false for the row that stays)."""
    return _members(df, id_column, columns, blank_is_value, order_by) \
        .select(F.col("__keep").alias("keep_id"), F.col("__id").alias("id"), (F.col("__nth") > 1).alias("remove"))


def duplicate_id_lists(df: DataFrame, id_column: str, columns: list[str], blank_is_value: bool = True, order_by=None,
                       page_rows: int = IDS_PER_PAGE) -> DataFrame:
    """All ids of each group in file order, as arrays of at most `page_rows` ids: keep_id, page, all_ids, ids_to_remove.

    A group that fits one page is one row; a larger one goes on with page 2, so no list grows with the data."""
    keys = [f"__c{i}" for i in range(len(columns))]
    page = F.floor((F.col("__nth") - 1) / F.lit(page_rows)) + 1
    lists = _members(df, id_column, columns, blank_is_value, order_by).groupBy(*keys, "__keep", page.alias("page")) \
        .agg(F.array_sort(F.collect_list(F.struct("__nth", "__id"))).alias("ids"), F.count(F.lit(1)).alias("count"))
    repeats = F.filter("ids", lambda x: x["__nth"] > 1)
    return lists.select(F.col("__keep").alias("keep_id"), "page", "count", F.transform("ids", lambda x: x["__id"]).alias("all_ids"),
                        F.transform(repeats, lambda x: x["__id"]).alias("ids_to_remove"))


def ids_to_remove(df: DataFrame, id_column: str, columns: list[str], blank_is_value: bool = True, order_by=None) -> DataFrame:
    """The id of every repeat, one per row."""
    return _members(df, id_column, columns, blank_is_value, order_by).filter("__nth > 1").select(F.col("__id").alias("id"))


def _row_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if not isinstance(f.dataType, (T.MapType, T.VariantType))]


def remove_duplicates(df: DataFrame, columns: list[str] | None = None, keep: str = "first",
                      ignore_case_and_spaces: bool = False, order_by=None) -> Result:
    """Keep one row of each group equal in `columns` (whole rows when none are given).

    `keep` is first, last or most_complete (fewest missing cells, then the earlier row). `df` holds the kept rows,
    `side("removed")` the others. Kept rows come from a `row_number() = 1` filter, which Spark applies before the
    shuffle as well, so a group of any size shrinks to one row per task; removed rows are numbered in slices when a
    group is too large for one task."""
    if keep not in KEEP:
        raise TableError(f"keep is one of {', '.join(KEEP)}")
    columns = list(columns or _row_columns(df))
    require_columns(df, columns)
    key_names = []
    keyed = df
    for n in columns:
        name = free_name(f"__key_{len(key_names)}", df.columns)
        # a missing cell and an empty text are the same blank; other types compare as they are
        dtype = type_of(df, n)
        if ignore_case_and_spaces:
            key = loose_text(col(n), dtype)
        else:
            key = F.coalesce(col(n), F.lit("")) if isinstance(dtype, T.StringType) else _cell(df, n)
        keyed = keyed.withColumn(name, key)
        key_names.append(name)
    order = file_order(df, order_by)
    if keep == "last":
        order = [c.desc() for c in order]
    elif keep == "most_complete":
        cells = functools.reduce(operator.add, [(~is_missing(col(f.name), f.dataType)).cast("int") for f in df.schema])
        order = [cells.desc(), *order]
    nth = free_name("__nth", keyed.columns)
    window = W.partitionBy(*[F.col(k) for k in key_names]).orderBy(*order)
    kept = keyed.withColumn(nth, F.row_number().over(window)).filter(F.col(nth) == 1).drop(nth, *key_names)
    counts = keyed.groupBy(*key_names).agg(F.count(F.lit(1)).alias("n"))
    metrics = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows_in"), F.count(F.lit(1)).alias("rows_kept"),
                         F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("rows_removed"),
                         F.count_if(F.col("n") > 1).alias("groups_with_duplicates"))
    removed = lambda: running_sum(keyed, key_names, order, nth, ties=tie_names(df, order_by)).filter(F.col(nth) > 1).drop(nth, *key_names)
    return Result(kept, {"removed": removed}, metrics)


def exact_copies(df: DataFrame) -> DataFrame:
    """One row: how many rows repeat an earlier row in every column."""
    counts = df.groupBy(*[_cell(df, n).alias(f"__c{i}") for i, n in enumerate(_row_columns(df))]).agg(F.count(F.lit(1)).alias("n"))
    return counts.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicate_rows"))


def distinct_rows(df: DataFrame) -> DataFrame:
    return df.dropDuplicates()
