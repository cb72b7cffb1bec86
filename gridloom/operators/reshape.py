"""Reshape: wide to long, rows to columns, and tables on top of each other."""
from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.cells import TableError, canonical_text, col, free_name, is_blank, require_columns, text_of, type_of
from ..plans.order import dense_index, file_order, tie_names
from .result import Result

MOST_TRANSPOSED_ROWS = 16_383
BLOCK_ROWS, BLOCK_CELLS = 10_000, 1_000_000         # rows and cells of a transposed block, at most


def _common_type(types: list[T.DataType]) -> T.DataType:
    """One type for several columns: the shared type, long or double among numbers, otherwise text."""
    if len({t.simpleString() for t in types}) == 1:
        return types[0]
    whole = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
    if all(isinstance(t, whole) for t in types):
        return T.LongType()
    if all(isinstance(t, (*whole, T.FloatType, T.DoubleType)) for t in types):
        return T.DoubleType()
    return T.StringType()


def _as_type(c: Column, source: T.DataType, target: T.DataType) -> Column:
    if source == target:
        return c
    return canonical_text(c, source) if isinstance(target, T.StringType) else c.cast(target)


def unpivot(df: DataFrame, id_columns: list[str], value_columns: list[str] | None = None, name_column: str = "name",
            value_column: str = "value", drop_blank: bool = False) -> Result:
    """One row per kept row and value column. No shuffle. Metrics: rows out and blanks left out."""
    value_columns = list(value_columns or [n for n in df.columns if n not in id_columns])
    require_columns(df, [*id_columns, *value_columns])
    overlap = [n for n in value_columns if n in id_columns]
    if overlap or not value_columns:
        raise TableError(f"{overlap[0]!r} is kept and unpivoted" if overlap else "there is no column left to unpivot")
    name_column, value_column = name_column.strip() or "name", value_column.strip() or "value"
    if name_column == value_column or {name_column, value_column} & set(id_columns):
        raise TableError("the two new columns need names that no other column has")
    target = _common_type([type_of(df, n) for n in value_columns])
    typed = df.select(*[col(n) for n in id_columns], *[_as_type(col(n), type_of(df, n), target).alias(n) for n in value_columns])
    long = typed.unpivot([col(n) for n in id_columns], [col(n) for n in value_columns], name_column, value_column)
    blank = is_blank(col(value_column), target)
    metrics = long.agg(F.count_if(~blank if drop_blank else F.lit(True)).alias("rows_out"), F.count_if(blank).alias("blanks"))
    return Result(long.filter(~blank) if drop_blank else long, metrics=metrics)


def transpose(df: DataFrame, order_by=None, most_rows: int = MOST_TRANSPOSED_ROWS) -> DataFrame:
    """Columns become rows: `Original Column/Row`, then one text column per row, named 0, 1, ... in row order.

    Every row becomes a column, so tables of more than `most_rows` rows are refused; `transpose_blocks` has no such limit."""
    count = df.limit(most_rows + 1).count()
    if count > most_rows:
        raise TableError(f"a table of more than {most_rows:,} rows cannot be transposed into columns; use transpose_blocks")
    at, name, value = (free_name(x, df.columns) for x in ("__at", "__column", "__value"))
    texts = dense_index(df, file_order(df, order_by), at, start=0, ascending=True).select(at, *[text_of(df, n).alias(n) for n in df.columns])
    place = F.create_map(*[x for i, n in enumerate(df.columns) for x in (F.lit(n), F.lit(i))])
    long = texts.unpivot([at], [col(n) for n in df.columns], name, value)
    wide = long.groupBy(name).pivot(at, list(range(count))).agg(F.first(value))
    return wide.orderBy(F.try_element_at(place, F.col(name))).withColumnRenamed(name, "Original Column/Row")


def transpose_blocks(df: DataFrame, order_by=None, block_rows: int | None = None) -> DataFrame:
    """Columns become rows at any length: (place, column, block, first_row, values), the column's texts for one run of rows.

    `values` holds the cells of rows first_row, first_row + 1, ... (from 0, NULL for missing ones), `place` the column's place. A block
    has `block_rows` rows, the last one what is left; one shuffle brings its rows together. By default a block is 10,000 rows,
    fewer if the table is so wide that they would be more than a million cells."""
    if block_rows is not None and block_rows < 1:
        raise TableError("a block needs at least one row")
    size = block_rows or max(1, min(BLOCK_ROWS, BLOCK_CELLS // max(len(df.columns), 1)))
    at = free_name("__at", df.columns)
    texts = dense_index(df, file_order(df, order_by), at, start=0, ties=tie_names(df, order_by), ascending=True)
    rows = texts.select(F.col(at), *[text_of(df, n).alias(f"c{i}") for i, n in enumerate(df.columns)])
    blocks = rows.groupBy(F.floor(F.col(at) / size).cast("bigint").alias("block")).agg(F.array_sort(F.collect_list(F.struct(*rows.columns))).alias("rows"))
    columns = [F.struct(F.lit(i).alias("place"), F.lit(n).alias("column"), F.col(f"rows.c{i}").alias("values")) for i, n in enumerate(df.columns)]
    return blocks.select("block", F.inline(F.array(*columns))) \
        .select("place", "column", "block", (F.col("block") * size).alias("first_row"), "values")


def _loose_name(name: str) -> str:
    return " ".join(name.split()).casefold()


def append_tables(tables: list[tuple[str, DataFrame]], renames: dict[str, dict[str, str]] | None = None, loose: bool = False,
                  source_column: bool = True) -> Result:
    """Stack tables, matching columns by name. Columns whose types differ are widened, to text if need be.

    `renames` maps a table's name to {column: new name}; `loose` takes names that differ only in case or spacing for
    one column, in the first spelling. `side("partial_columns")` lists columns some tables lack; metrics count rows."""
    if len(tables) < 2:
        raise TableError("choose at least two tables to append")
    spelling: dict[str, str] = {}
    named: list[tuple[str, DataFrame]] = []
    for source, df in tables:
        mapping = (renames or {}).get(source, {})
        require_columns(df, mapping, source)
        targets = [mapping.get(n, n) for n in df.columns]
        targets = [spelling.setdefault(_loose_name(n) if loose else n, n) for n in targets]
        repeated = [n for n in targets if targets.count(n) > 1]
        if repeated:
            raise TableError(f"in {source}, more than one column ends up as {repeated[0]!r}")
        named.append((source, df.select(*[col(o).alias(n) for o, n in zip(df.columns, targets)])))
    order = list(dict.fromkeys(n for _, df in named for n in df.columns))
    types = {n: _common_type([type_of(df, n) for _, df in named if n in df.columns]) for n in order}
    tag = free_name("source_file", order)
    parts = [df.select(F.lit(source).alias(tag), *[
        (_as_type(col(n), type_of(df, n), types[n]) if n in df.columns else F.lit(None).cast(types[n])).alias(n) for n in order])
        for source, df in named]
    stacked = functools.reduce(DataFrame.unionByName, parts)
    spark = tables[0][1].sparkSession
    partial = spark.createDataFrame([(n, s) for n in order for s, df in named if n not in df.columns], "column string, missing_in string")
    metrics = stacked.groupBy(F.col(tag).alias("source_file")).agg(F.count(F.lit(1)).alias("rows"))
    return Result(stacked if source_column else stacked.drop(tag), {"partial_columns": partial}, metrics)
