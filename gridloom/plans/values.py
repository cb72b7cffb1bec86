"""The value-count table: how often each value of each column occurs. It feeds several statistics."""
from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.cells import canonical_text, col, present, text_of, type_of
from .order import first_place


def long_cells(df: DataFrame, columns: list[str], at: Column | None = None) -> DataFrame:
    """(column, value as canonical text) for every cell, missing ones included, and the row's place if given."""
    cells = F.array(*[F.struct(F.lit(n).alias("column"), text_of(df, n).alias("value")) for n in columns])
    place = [] if at is None else [at.alias("at")]
    exploded = df.select(F.explode(cells).alias("cell"), *place)
    return exploded.select("cell.column", "cell.value", *(["at"] if place else []))


def value_counts(df: DataFrame, columns: list[str], order_by=None, first_seen: bool = True) -> DataFrame:
    """(column, value, n, at): rows with each value and, if asked, where it is first seen. Missing values are left out.

    Each column is grouped on its own, in its own type: that reads every column once, keeps the hash keys small, and
    only the different values are turned into text. Turning the table into one long column first is several times slower."""
    place = [first_place(df, order_by).alias("at")] if first_seen else []
    parts = []
    for n in columns:
        dtype = type_of(df, n)
        cells = df.select(present(col(n), dtype).alias("v"), *place).filter(F.col("v").isNotNull())
        counted = cells.groupBy("v").agg(F.count(F.lit(1)).alias("n"), *[F.min("at").alias("at") for _ in place])
        parts.append(counted.select(F.lit(n).alias("column"), canonical_text(F.col("v"), dtype).alias("value"), "n", *["at" for _ in place]))
    return functools.reduce(DataFrame.unionByName, parts)


def unique_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, unique): how many different values each column has, missing ones left out."""
    parts = [df.select(present(col(n), type_of(df, n)).alias("v")).filter(F.col("v").isNotNull()).distinct()
             .agg(F.lit(n).alias("column"), F.count(F.lit(1)).alias("unique")) for n in columns]
    return functools.reduce(DataFrame.unionByName, parts)
