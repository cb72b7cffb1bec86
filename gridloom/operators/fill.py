"""Fill blank cells, or drop the rows that have them."""
from __future__ import annotations

import functools
import operator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.cells import (TableError, col, filled, free_name, is_blank, is_number, is_text, number_of, plain_number,
                               require_columns, type_of)
from ..plans.order import carry_values, file_order, first_place, tie_names
from ..plans.quantiles import exact_quantiles
from .result import Result

METHODS = ("constant", "previous", "next", "mean", "median", "mode")


def drop_blank_rows(df: DataFrame, columns: list[str]) -> Result:
    """Rows without a blank in the columns; the others are the side table `removed`."""
    require_columns(df, columns)
    blank = functools.reduce(operator.or_, [is_blank(col(n), type_of(df, n)) for n in columns])
    return Result(df.filter(~blank), {"removed": df.filter(blank)})


def _constant(df: DataFrame, name: str, value) -> Column:
    dtype = type_of(df, name)
    try:
        number = float(value) if is_number(dtype) else None
    except (TypeError, ValueError):
        raise TableError(f"{value!r} does not fit the numbers of column {name!r}") from None
    if number is None:
        return F.lit(str(value) if is_text(dtype) else value).cast(dtype)
    if not number.is_integer() and not isinstance(dtype, (T.DoubleType, T.FloatType, T.DecimalType)):
        return F.lit(number)
    return F.lit(int(number) if number.is_integer() else number).cast(dtype)


def _computed(df: DataFrame, columns: list[str], method: str) -> dict[str, Column]:
    """Mean or median of each column, in the column's own form: a number among numbers, text among text."""
    seen = df.agg(*[e for i, n in enumerate(columns) for e in (
        F.count(filled(col(n), type_of(df, n))).alias(f"cells{i}"), F.count(number_of(df, n)).alias(f"numbers{i}"),
        F.avg(number_of(df, n)).alias(f"mean{i}"))]).first()
    for i, n in enumerate(columns):
        if seen[f"cells{i}"] != seen[f"numbers{i}"] or not seen[f"numbers{i}"]:
            raise TableError(f"{n!r} is not a numeric column, so it has no {method}")
    if method == "mean":
        values = {n: seen[f"mean{i}"] for i, n in enumerate(columns)}
    else:
        found = exact_quantiles(df, {n: number_of(df, n) for n in columns}, [0.5])
        values = {n: found[n][0.5] for n in columns}
    return {n: F.lit(format(v, ".10g")) if is_text(type_of(df, n)) else F.lit(v) for n, v in values.items()}


def _most_common(df: DataFrame, name: str, order_by) -> Column:
    """The most frequent value; among equals the one that comes first in the file."""
    cell = filled(col(name), type_of(df, name))
    counts = df.select(cell.alias("v"), first_place(df, order_by).alias("at")).filter("v is not null") \
        .groupBy("v").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("at"))
    best = counts.orderBy(F.desc("n"), F.asc("at"), F.asc("v")).limit(1).select("v").first()
    return F.lit(best.v if best else None).cast(type_of(df, name))


def fill_missing(df: DataFrame, columns: list[str], method: str = "constant", value=None, flag: bool = False,
                 order_by=None) -> Result:
    """Fill blanks with a constant, the previous or next filled cell, the mean, the median or the most common value.

    `flag` adds `filled_columns`: the names of the columns filled in each row. Metrics: blanks found and filled."""
    require_columns(df, columns)
    if method not in METHODS or not columns:
        raise TableError(f"choose columns and one of {', '.join(METHODS)}")
    if method == "constant" and value in (None, ""):
        raise TableError("give the value to fill blanks with")

    names = list(df.columns)
    stand_in = {n: free_name(f"__fill_{i}", names) for i, n in enumerate(columns)}
    if method in ("previous", "next"):
        cells = {stand_in[n]: filled(col(n), type_of(df, n)) for n in columns}
        ready = carry_values(df, cells, file_order(df, order_by), forward=method == "previous", ties=tie_names(df, order_by), ascending=True)
    else:
        if method == "constant":
            source = {n: _constant(df, n, value) for n in columns}
        elif method == "mode":
            source = {n: _most_common(df, n, order_by) for n in columns}
        else:
            source = _computed(df, columns, method)
        ready = df.select("*", *[F.coalesce(filled(col(n), type_of(df, n)), source[n]).alias(stand_in[n]) for n in columns])

    blank = {n: is_blank(col(n), type_of(df, n)) for n in columns}
    was_filled = {n: blank[n] & col(stand_in[n]).isNotNull() for n in columns}
    out = [col(stand_in[n]).alias(n) if n in columns else col(n) for n in names]
    if flag:
        listed = F.concat_ws(", ", *[F.when(was_filled[n], F.lit(n)) for n in columns])
        out.append(F.nullif(listed, F.lit("")).alias(free_name("filled_columns", names)))
    total = functools.reduce(operator.add, [b.cast("bigint") for b in blank.values()])
    done = functools.reduce(operator.add, [w.cast("bigint") for w in was_filled.values()])
    metrics = ready.agg(F.coalesce(F.sum(total), F.lit(0)).alias("blank_cells"), F.coalesce(F.sum(done), F.lit(0)).alias("cells_filled"),
                        *[F.count_if(was_filled[n]).alias(f"filled_{n}") for n in columns])
    return Result(ready.select(*out), metrics=metrics)
