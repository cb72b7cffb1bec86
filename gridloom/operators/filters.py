"""Row filters: a list of conditions folded into one predicate, so Catalyst sees a single `filter`."""
from __future__ import annotations

import functools
import math
import operator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.cells import (TableError, canonical_text, col, is_blank, is_float, is_number, is_text, number_of,
                               require_columns, strip, text_of, type_of)

COMPARISONS = {"greater_than": operator.gt, "less_than": operator.lt, "greater_equal": operator.ge, "less_equal": operator.le}


def _or_false(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def _equals(df: DataFrame, column: str, wanted: str) -> Column:
    """The cell's canonical text is `wanted`, without case. A declared number is compared as a number, so that the test
    can reach the scan; a text that is not how such a number reads equals none."""
    dtype = type_of(df, column)
    if isinstance(dtype, (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.DoubleType)):
        try:
            number = float(wanted) if isinstance(dtype, T.DoubleType) else int(wanted)
        except ValueError:
            return F.lit(False)
        if not math.isfinite(number):                       # a missing cell is NaN and equals no text
            return F.lit(False)
        reads = str(int(number)) if float(number).is_integer() else repr(number)
        return col(column) == F.lit(number) if reads == wanted else F.lit(False)
    return F.lower(text_of(df, column)) == F.lit(wanted.lower())


def condition(df: DataFrame, column: str, test: str, value="") -> Column:
    """One test of one column, for use in a filter. Text is compared without case; blanks match only the negative tests.

    The positive tests are NULL on blanks, which a filter drops; nothing is wrapped around them that would keep a
    comparison with a declared number from being pushed down to the scan."""
    require_columns(df, [column])
    dtype = type_of(df, column)
    text = F.lower(text_of(df, column))
    wanted = F.lit(str(value).lower())
    if test == "equals":
        return _equals(df, column, str(value))
    if test == "not_equals":
        return ~_or_false(_equals(df, column, str(value)))
    if test == "contains":
        return F.contains(text, wanted)
    if test == "not_contains":
        return ~_or_false(F.contains(text, wanted))
    if test == "starts_with":
        return F.startswith(text, wanted)
    if test == "ends_with":
        return F.endswith(text, wanted)
    if test in COMPARISONS:
        try:
            limit = float(value)
        except (TypeError, ValueError):
            raise TableError(f"{value!r} is not a number, so {column!r} cannot be compared with it") from None
        cell = col(column) if is_number(dtype) else number_of(df, column)
        compared = COMPARISONS[test](cell, F.lit(limit))
        return compared & ~F.isnan(cell) if is_float(dtype) and test.startswith("greater") else compared      # NaN sorts above all
    if test == "is_empty":
        return is_blank(col(column), dtype)
    if test == "is_not_empty":
        return ~is_blank(col(column), dtype)
    if test == "in_list":
        return functools.reduce(operator.or_, [_equals(df, column, v.strip()) for v in str(value).split(",")])
    raise TableError(f"unknown test {test!r}")


def predicate(df: DataFrame, conditions: list[dict]) -> Column:
    """AND binds tighter than OR; a condition without `logic` joins the way the one before it did."""
    if not conditions:
        raise TableError("give at least one condition")
    alternatives: list[list[Column]] = []
    logic = "AND"
    for step in conditions:
        logic = (step.get("logic") or logic).upper()
        test = condition(df, step["column"], step["operator"], step.get("value", ""))
        if alternatives and logic != "OR":
            alternatives[-1].append(test)
        else:
            alternatives.append([test])
    return functools.reduce(operator.or_, [functools.reduce(operator.and_, tests) for tests in alternatives])


def row_filter(df: DataFrame, conditions: list[dict]) -> DataFrame:
    return df.filter(predicate(df, conditions))


def exact_filter(df: DataFrame, wanted: dict[str, object]) -> DataFrame:
    """Rows whose cells read exactly like the wanted text, spaces at the ends aside. Empty wishes are ignored."""
    require_columns(df, wanted)
    for column, value in wanted.items():
        if value not in (None, ""):
            text = canonical_text(col(column), type_of(df, column))
            df = df.filter((strip(text) if is_text(type_of(df, column)) else text) == F.lit(str(value).strip()))
    return df
