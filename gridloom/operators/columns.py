"""Column operations: reorder, rename, delete, copy, split, merge, calculate, find and replace. One projection each."""
from __future__ import annotations

import functools
import operator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import patterns
from ..functions.cells import TableError, canonical_text, col, free_name, is_text, require_columns, text_of, type_of
from .profile import infer_types
from .result import Result

MOST_PARTS = 10_000


def reorder_columns(df: DataFrame, order: list[str]) -> DataFrame:
    """The listed columns first, each once; the others keep their order after them."""
    require_columns(df, order)
    listed = list(dict.fromkeys(order))
    return df.select(*[col(n) for n in listed + [n for n in df.columns if n not in listed]])


def rename_columns(df: DataFrame, renames: dict[str, str]) -> DataFrame:
    if not renames:
        raise TableError("nothing to rename")
    require_columns(df, renames)
    names = [renames.get(n, n) for n in df.columns]
    if any(not n.strip() for n in names):
        raise TableError("a column name cannot be empty")
    clashes = sorted({n for n in names if names.count(n) > 1})
    if clashes:
        raise TableError(f"more than one column would be called: {', '.join(clashes)}")
    return df.select(*[col(old).alias(new) for old, new in zip(df.columns, names)])


def delete_columns(df: DataFrame, names: list[str]) -> DataFrame:
    if not names:
        raise TableError("nothing to delete")
    require_columns(df, names)
    return df.select(*[col(n) for n in df.columns if n not in names])


def duplicate_column(df: DataFrame, source: str, new_name: str) -> DataFrame:
    require_columns(df, [source])
    if new_name in df.columns:
        raise TableError(f"column {new_name!r} already exists")
    at = df.columns.index(source) + 1
    kept = [col(n) for n in df.columns]
    return df.select(*kept[:at], col(source).alias(new_name), *kept[at:])


def widest_split(df: DataFrame, column: str, delimiter: str) -> int:
    """Into how many parts the delimiter cuts the cell with most of them."""
    return max(df.agg(F.max(F.size(F.split(text_of(df, column), patterns.literal(delimiter), -1)))).first()[0] or 0, 1)


def split_column(df: DataFrame, column: str, delimiter: str, names: list[str] | None = None,
                 parts: int | None = None, most_parts: int = MOST_PARTS) -> DataFrame:
    """Cut text at a literal delimiter into as many columns as the widest cell needs, in place of the original.

    `parts` says how many there are and saves the pass that finds out. More than `most_parts` columns are refused; an
    array column (`F.split`) holds any number of parts."""
    require_columns(df, [column])
    if not delimiter:
        raise TableError("the delimiter is empty")
    pieces = F.split(text_of(df, column), patterns.literal(delimiter), -1)
    if parts is None:
        parts = widest_split(df, column, delimiter)
    if parts > most_parts:
        raise TableError(f"{column!r} would be cut into {parts:,} columns, more than {most_parts:,}; raise most_parts or keep the parts in one array column")
    names = [n for n in (names or []) if n.strip()]
    names = (names + [f"{column}_part{i + 1}" for i in range(len(names), parts)])[:parts]
    taken = [n for n in names if n in df.columns and n != column]
    if taken or len(set(names)) < len(names):
        raise TableError(f"column name used twice: {(taken or names)[0]!r}")
    chosen: list[Column] = []
    for n in df.columns:
        chosen += [F.get(pieces, F.lit(i)).alias(name) for i, name in enumerate(names)] if n == column else [col(n)]
    return df.select(*chosen)


def merge_columns(df: DataFrame, columns: list[str], separator: str, new_name: str) -> DataFrame:
    """Join the texts of several columns; a blank part is empty text. The new column follows the merged block."""
    if len(columns) < 2:
        raise TableError("choose at least two columns to merge")
    require_columns(df, columns)
    if new_name in df.columns:
        raise TableError(f"column {new_name!r} already exists")
    merged = F.concat_ws(separator, *[F.coalesce(text_of(df, n), F.lit("")) for n in columns]).alias(new_name)
    at = min(df.columns.index(n) for n in columns) + len(columns)
    kept = [col(n) for n in df.columns]
    return df.select(*kept[:at], merged, *kept[at:])


def calculated_column(df: DataFrame, new_name: str, expression: Column | str, infer: bool = False) -> DataFrame:
    """Add one column from an expression: a Column built with `functions.formulas`, or Spark SQL text.

    With `infer`, the expression sees text columns that hold only numbers as numbers (one aggregate finds them), while the
    table keeps its texts. Columns with other cells stay text: `ADD`, `MULTIPLY` and the like give NULL for such cells."""
    if new_name in df.columns:
        raise TableError(f"column {new_name!r} already exists")
    made = F.expr(expression) if isinstance(expression, str) else expression
    if not infer:
        return df.withColumn(new_name, made)
    names = list(df.columns)
    kept = {}
    for n in names:
        kept[n] = free_name(f"__kept_{n}", [*names, new_name, *kept.values()])
    both = infer_types(df.select("*", *[col(n).alias(k) for n, k in kept.items()]), names)
    return both.withColumn(new_name, made).select(*[col(k).alias(n) for n, k in kept.items()], col(new_name))


def find_replace(df: DataFrame, find: str, replace: str, columns: list[str] | None = None, case_sensitive: bool = False,
                 use_regex: bool = False, whole_cell: bool = False) -> Result:
    """Replace text in the given columns (all when None). A literal search replaces with the literal text.

    Columns of another type that are searched become text. Metrics: matches replaced and rows affected."""
    if not find:
        raise TableError("the text to find is empty")
    columns = list(columns or df.columns)
    require_columns(df, columns)
    search = patterns.pattern(find, not case_sensitive) if use_regex else patterns.literal(find, not case_sensitive)
    template = patterns.replacement(replace) if use_regex else patterns.literal_replacement(replace)
    if use_regex and not whole_cell:
        df.sparkSession.range(1).select(F.regexp_replace(F.lit(""), search, template)).first()   # refuses a bad template
    counts: list[Column] = []
    projected: list[Column] = []
    for n in df.columns:
        if n not in columns:
            projected.append(col(n))
            continue
        text = canonical_text(col(n), type_of(df, n))
        if whole_cell:
            hit = text.rlike(patterns.whole(search))
            counts.append(F.coalesce(hit.cast("bigint"), F.lit(0)))
            projected.append(F.when(hit, F.lit(replace)).otherwise(text).alias(n))
        else:
            counts.append(F.coalesce(F.regexp_count(text, F.lit(search)).cast("bigint"), F.lit(0)))
            if case_sensitive and not use_regex and is_text(type_of(df, n)):
                projected.append(F.replace(text, F.lit(find), F.lit(replace)).alias(n))
            else:
                projected.append(F.regexp_replace(text, search, template).alias(n))
    total = functools.reduce(operator.add, counts)
    metrics = df.select(total.alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("replacements"),
                                              F.count_if(F.col("n") > 0).alias("rows_affected"))
    return Result(df.select(*projected), metrics=metrics)
