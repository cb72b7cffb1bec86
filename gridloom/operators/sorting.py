"""Sort, rank and sample rows; number occurrences and groups."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.cells import (TableError, col, free_name, is_number, is_text, is_time, number_of, present, require_columns,
                               text_of, type_of)
from ..plans.order import dense_index, file_order, first_place, first_rows, order_names, running_sum, tie_names

ASCENDING, DESCENDING = "ascending", "descending"


def numeric_columns(df: DataFrame, columns: list[str]) -> set[str]:
    """The columns whose filled cells are all numbers. Declared numbers need no pass; text columns share one."""
    known = {n for n in columns if is_number(type_of(df, n)) or isinstance(type_of(df, n), T.BooleanType)}
    texts = [n for n in columns if is_text(type_of(df, n))]
    if texts:
        seen = df.agg(*[e for i, n in enumerate(texts) for e in (
            F.count(col(n)).alias(f"cells{i}"), F.count(number_of(df, n)).alias(f"numbers{i}"))]).first()
        known |= {n for i, n in enumerate(texts) if seen[f"cells{i}"] == seen[f"numbers{i}"]}
    return known


def _sort_columns(df: DataFrame, by: list[tuple[str, str]], backwards: bool = False) -> list[Column]:
    """Numbers as numbers, dates as dates, other cells as text without case; blanks last in both directions.

    `backwards` gives the opposite order, from the last row to the first."""
    names = [n for n, _ in by]
    require_columns(df, names)
    if len(set(names)) < len(names):
        raise TableError("the same column is chosen twice to sort by")
    numeric = numeric_columns(df, names)
    out = []
    for n, direction in by:
        if is_number(type_of(df, n)):
            key = present(col(n), type_of(df, n))
        elif n in numeric:
            key = number_of(df, n)
        elif is_time(type_of(df, n)):
            key = col(n)
        else:
            key = F.lower(text_of(df, n))
        if backwards:
            out.append(key.asc_nulls_first() if direction == DESCENDING else key.desc_nulls_first())
        else:
            out.append(key.desc_nulls_last() if direction == DESCENDING else key.asc_nulls_last())
    return out


def _first_key(df: DataFrame, by: list[tuple[str, str]], order_by, backwards: bool = False) -> Column | None:
    """The number that the rows are ordered by first, smaller ones earlier; None if that is no number."""
    name, direction = by[0] if by else (order_names(df, order_by)[0], ASCENDING)
    if name not in df.columns or not is_number(type_of(df, name)):
        return None
    number = present(col(name), type_of(df, name)).cast("double")
    return -number if (direction == DESCENDING) != backwards else number


def _levels(by) -> list[tuple[str, str]]:
    return [(b, ASCENDING) if isinstance(b, str) else (b[0], b[1]) for b in by]


def sort_rows(df: DataFrame, by, order_by=None) -> DataFrame:
    """Sort by columns, each a name or (name, 'descending'); equal rows keep their order."""
    return df.orderBy(*_sort_columns(df, _levels(by)), *file_order(df, order_by))


def rank_rows(df: DataFrame, by, within: str | None = None, order_by=None) -> DataFrame:
    """Add `rank`: 1, 2, ... in sorted order, over the table or within each value of one column."""
    if not by:
        raise TableError("choose a column to sort by before adding a rank")
    order = _sort_columns(df, _levels(by)) + file_order(df, order_by)
    name = free_name("rank", df.columns)
    if within is None:
        return dense_index(df, order, name, ties=tie_names(df, order_by))
    require_columns(df, [within])
    return running_sum(df, [within], order, name, ties=tie_names(df, order_by))


def first_n(df: DataFrame, n: int, order_by=None, by=()) -> DataFrame:
    _check_count(n)
    order = _sort_columns(df, _levels(by)) + file_order(df, order_by)
    nulls_first = not by                                # blanks come last, but in the order of the rows itself
    return first_rows(df, order, n, tie_names(df, order_by), _first_key(df, _levels(by), order_by), nulls_first).orderBy(*order)


def last_n(df: DataFrame, n: int, order_by=None, by=()) -> DataFrame:
    _check_count(n)
    order = _sort_columns(df, _levels(by)) + file_order(df, order_by)
    backwards = _sort_columns(df, _levels(by), backwards=True) + [c.desc() for c in file_order(df, order_by)]
    nulls_first = bool(by)
    return first_rows(df, backwards, n, tie_names(df, order_by), _first_key(df, _levels(by), order_by, backwards=True), nulls_first).orderBy(*order)


def _check_count(n) -> None:
    if not isinstance(n, int) or n < 1:
        raise TableError("the number of rows must be a whole number of 1 or more")


def every_nth(df: DataFrame, n: int, order_by=None, by=()) -> DataFrame:
    """Rows 1, n+1, 2n+1, ..."""
    _check_count(n)
    name = free_name("__index", df.columns)
    numbered = dense_index(df, _sort_columns(df, _levels(by)) + file_order(df, order_by), name, start=0, ties=tie_names(df, order_by), ascending=not by)
    return numbered.filter(F.col(name) % n == 0).drop(name)


def sample_n(df: DataFrame, n: int, seed: int = 42, order_by=None) -> DataFrame:
    """Exactly n rows (all when there are fewer), the same for the same seed and rows, in their order.

    Rows go by the MD5 of the seed and their place in the order as text, `seed:a:b`, so any SQL can draw the same sample."""
    _check_count(n)
    order = file_order(df, order_by)
    places = [F.coalesce(col(x).cast("string"), F.lit("")) for x in order_names(df, order_by)]
    chance = F.md5(F.concat_ws(":", F.lit(str(seed)), *places))
    key = F.conv(F.left(chance, F.lit(13)), 16, 10).cast("double")             # 52 bits: exact, and in the order of the MD5
    return first_rows(df, [chance, *order], n, tie_names(df, order_by), key).orderBy(*order)


def occurrence(df: DataFrame, keys: list[str], name: str = "occurrence", order_by=None) -> DataFrame:
    """Add the number of each row among the rows with the same key, from 1."""
    require_columns(df, keys)
    return running_sum(df, keys, file_order(df, order_by), free_name(name, df.columns), ties=tie_names(df, order_by), ascending=True)


def group_numbers(df: DataFrame, keys: list[str], name: str = "group_number", order_by=None) -> DataFrame:
    """One row per distinct key with a number in order of first appearance."""
    require_columns(df, keys)
    firsts = df.groupBy(*[col(k) for k in keys]).agg(F.min(first_place(df, order_by)).alias("__at"))
    return dense_index(firsts, [F.col("__at")], free_name(name, keys), ascending=True).drop("__at")
