"""Read tables: delimited text and Parquet, with positions, delimiter and encoding found from the head of the file."""
from __future__ import annotations

import csv
import io
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.cells import TableError, col, free_name, is_blank, type_of
from ..operators.profile import infer_types
from ..plans.order import POSITION, with_position
from ..session import written
from .records import quoted_records

DELIMITERS = {"comma": ",", "semicolon": ";", "tab": "\t", "pipe": "|"}
HEAD_LINES = 50
GRID_HEAD_ROWS = 30
EXTRA = "_extra_cells"
BOM = "﻿"


#: What windows-1252 has where ISO-8859-1 has control characters, from 0x80 on; five places are undefined.
WINDOWS_1252 = "€\x81‚ƒ„…†‡ˆ‰Š‹Œ\x8dŽ\x8f\x90‘’“”•–—˜™š›œ\x9džŸ"


def _known(encoding: str) -> str:
    """The encoding Spark reads it as: windows-1252 is read as ISO-8859-1, and `_decoded` changes what differs."""
    return "ISO-8859-1" if encoding.lower() in ("windows-1252", "cp1252") else encoding


def _decoded(text: Column, encoding: str) -> Column:
    if _known(encoding) == encoding:
        return text
    return F.translate(text, "".join(map(chr, range(0x80, 0xA0))), WINDOWS_1252)


def _text(value: Column, encoding: str | None) -> Column:
    """The text source hands over the bytes as they are, so other encodings are decoded here. None: each value for itself."""
    if encoding is None:
        return F.when(F.is_valid_utf8(value.cast("string")), value.cast("string")).otherwise(_text(value, "windows-1252"))
    return value.cast("string") if encoding.upper() in ("UTF-8", "UTF8") else _decoded(F.decode(value.cast("binary"), _known(encoding)), encoding)


def _lines(spark: SparkSession, path: str, encoding: str | None = "UTF-8") -> DataFrame:
    """The lines of a text file."""
    lines = spark.read.text(path)
    return lines.withColumn("value", _text(F.col("value"), encoding))


def _head(spark: SparkSession, path: str, lines: int, encoding: str | None = "UTF-8") -> list[str]:
    """The first lines of the file, in file order."""
    rows = _lines(spark, path, encoding).select(F.make_valid_utf8("value").alias("value")).limit(lines).collect()
    return [r.value.lstrip(BOM) for r in rows]


def detect_delimiter(spark: SparkSession, path: str) -> str:
    """Comma if the first non-empty line has one outside quotes, else the most frequent of semicolon, tab and pipe."""
    line = next((text for text in _head(spark, path, HEAD_LINES) if text.strip()), "")
    outside = "".join(line.split('"')[::2])
    counts = {d: outside.count(d) for d in DELIMITERS.values()}
    if counts[","]:
        return ","
    best = max(counts, key=counts.get)
    return best if counts[best] else ","


@dataclass
class Look:
    """What one pass over the files shows. files: (file, encoding, line_breaks); encodings: the different ones, three at most."""
    files: DataFrame
    encodings: list[str]
    line_breaks: bool           # does a line hold an odd number of quotes?

    @property
    def encoding(self) -> str | None:
        """The encoding of all files, None if they differ."""
        return self.encodings[0] if len(self.encodings) == 1 else None


def look_through(spark: SparkSession, path: str) -> Look:
    """A file is UTF-8 when all its lines are valid UTF-8, else windows-1252, else ISO-8859-1 if bytes are undefined there."""
    value = F.col("value")
    ascii_only = F.is_valid_utf8("value") & (F.octet_length(value) == F.length(value))
    undefined = F.when(~ascii_only, F.hex(value.cast("binary")).rlike("^(..)*(81|8D|8F|90|9D)"))
    quotes = F.when(value.contains('"'), F.octet_length(value) - F.octet_length(F.replace(value, F.lit('"'), F.lit("")))).otherwise(0)
    seen = spark.read.option("lineSep", "\n").text(path).groupBy(F.col("_metadata").getField("file_path").alias("file")).agg(
        F.bool_and(F.is_valid_utf8("value")).alias("utf8"), F.coalesce(F.bool_or(undefined), F.lit(False)).alias("odd"), F.bool_or(quotes % 2 == 1).alias("line_breaks"))
    encoding = F.when(F.col("utf8"), "UTF-8").when(F.col("odd"), "ISO-8859-1").otherwise("windows-1252")
    files = seen.select("file", encoding.alias("encoding"), "line_breaks")
    found = files.agg(F.sort_array(F.collect_set("encoding")).alias("encodings"), F.bool_or("line_breaks").alias("line_breaks")).first()
    return Look(files, found.encodings or ["UTF-8"], bool(found.line_breaks))


def detect_encoding(spark: SparkSession, path: str) -> str:
    """The encoding of the files; a folder of different ones is refused here, `look_through` names each."""
    found = look_through(spark, path)
    if found.encoding is None:
        raise TableError(f"the files have different encodings: {', '.join(found.encodings)}")
    return found.encoding


def _records(spark: SparkSession, path: str, delimiter: str, encoding: str | None, files: DataFrame | None) -> DataFrame:
    """file, block, row, head and `value`, the text of every record; `files` tells the encoding of each file if they differ."""
    records = quoted_records(spark, path, delimiter)
    if encoding is not None:
        text = _text(F.col("value"), encoding)
    else:
        records = records.join(written(files.select("file", "encoding")), "file")
        text = F.when(F.col("encoding") == "UTF-8", _text(F.col("value"), "UTF-8")).when(F.col("encoding") == "windows-1252", _text(F.col("value"), "windows-1252")) \
            .otherwise(_text(F.col("value"), "ISO-8859-1"))
    return records.select("file", "block", "row", "head", F.when(F.col("head"), F.regexp_replace(text, f"^{BOM}", "")).otherwise(text).alias("value"))


def _place() -> Column:
    return F.struct("file", "block", "row").alias(POSITION)


def read_delimited(spark: SparkSession, path: str, mode: str = "lossless", delimiter: str | None = None, encoding: str | None = None,
                   multi_line: bool | None = None, position: bool = False, ragged: str = "refuse") -> DataFrame:
    """A delimited table with a header in every file.

    `lossless`: every cell is text and only the empty cell is missing, so 00123 and NA stay as they are. `infer`: text
    columns that hold only numbers become numbers. `position` adds the file position as the row order.

    Unless `encoding` and `multi_line` are given, the files are looked through once: for bytes that are no UTF-8, file by
    file, and for lines that end inside quotes. Files of several encodings, and quoted line breaks (`multi_line`), are
    read as records that are cut and decoded here, a byte range a task. Rows with more cells than the header are refused, which
    takes another pass; with `ragged="keep"` they stay, and the column `_extra_cells` holds what follows the last named
    cell."""
    if mode not in ("lossless", "infer") or ragged not in ("refuse", "keep"):
        raise TableError("mode is lossless or infer, and ragged is refuse or keep")
    look = look_through(spark, path) if encoding is None or multi_line is None else None
    encoding = encoding or look.encoding
    delimiter = delimiter or detect_delimiter(spark, path)
    names = read_headers(spark, path, delimiter, encoding, keep_blank=True)
    extra, line = free_name(EXTRA, names), free_name("_line", [*names, EXTRA])
    if encoding is None or (look.line_breaks if multi_line is None else multi_line):
        records = _records(spark, path, delimiter, encoding, look and look.files).where(~F.col("head") & (F.length(F.trim("value")) > 0))
        places = [f"c{i}" for i in range(len(names))]
        parsed = F.from_csv("value", ", ".join(f"{n} string" for n in [*places, "extra", "line"]), {
            "sep": delimiter, "quote": '"', "escape": '"', "multiLine": "true", "mode": "PERMISSIVE", "columnNameOfCorruptRecord": "line"})
        table = lambda r: r.select(parsed.alias("p"), _place()).select("p.*", POSITION).toDF(*names, extra, line, POSITION)     # noqa: E731
        df = table(records)
        decoded = lambda c: c                           # noqa: E731
        delimiters = F.octet_length("value") - F.octet_length(F.replace("value", F.lit(delimiter), F.lit("")))
        too_long = table(records.where(delimiters >= len(names) * len(delimiter.encode())))     # no other row can have more cells than the header
    else:
        schema = T.StructType([T.StructField(n, T.StringType()) for n in [*names, extra, line]])
        reader = spark.read.option("header", True).option("sep", delimiter).option("encoding", _known(encoding)).option("quote", '"') \
            .option("escape", '"').option("multiLine", False).option("enforceSchema", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", line)
        too_long = reader.schema(schema).csv(path)
        df = with_position(too_long) if position else too_long
        decoded = lambda c: _decoded(c, encoding)       # noqa: E731
    if ragged == "refuse" and too_long.agg(F.bool_or(col(extra).isNotNull())).first()[0]:       # one job; a limit would read a few files first
        raise TableError(f"a row has more than the {len(names)} cells of the header; read it with ragged=\"keep\" to see such rows")
    cells = [decoded(col(n)).alias(n) for n in names]
    if ragged == "keep":
        after = _after_cells(decoded(col(line)), len(names), delimiter)
        cells.append(F.when(col(extra).isNotNull(), F.coalesce(after, decoded(col(extra)))).alias(extra))
    df = df.select(*cells, *([col(POSITION)] if position else []))
    return infer_types(df) if mode == "infer" else df


def _after_cells(line: Column, cells: int, delimiter: str) -> Column:
    """What follows the first `cells` cells of a raw line."""
    d = re.escape(delimiter)
    cell = rf'(?:\s*"(?:[^"]|"")*"[^{d}]*|[^{d}]*)'
    return F.regexp_replace(line, f"^(?:{cell}{d}){{{cells}}}", "")


def read_headers(spark: SparkSession, path: str, delimiter: str | None = None, encoding: str | None = "UTF-8", keep_blank: bool = False) -> list[str]:
    """Column names from the first line, stripped, blanks dropped. Reads no data rows.

    `keep_blank` names blank columns `Column i` and keeps repeats apart, as a schema needs."""
    delimiter = delimiter or detect_delimiter(spark, path)
    line = ""
    for text in _head(spark, path, HEAD_LINES, encoding):            # a quoted header may hold line breaks
        line = f"{line}\n{text}" if line else text
        if line.count('"') % 2 == 0:
            break
    names = [n.strip() for n in next(csv.reader(io.StringIO(line, newline=""), delimiter=delimiter), [])]
    if not keep_blank:
        return [n for n in names if n]
    out: list[str] = []
    for i, n in enumerate(names, 1):
        out.append(free_name(n or f"Column {i}", out))
    return out


def read_parquet(spark: SparkSession, path: str, position: bool = False) -> DataFrame:
    df = spark.read.parquet(path)
    return with_position(df) if position else df


def column_samples(df: DataFrame, rows: int = 10) -> list[dict]:
    """name, type and the filled cells among the first rows, for choosing columns."""
    head = df.limit(rows).collect()
    return [{"column": n, "type": type_of(df, n).simpleString(), "samples": [r[n] for r in head if r[n] is not None]} for n in df.columns]


def row_count(df: DataFrame) -> int:
    return df.count()


def count_records(spark: SparkSession, path: str, delimiter: str | None = None) -> int:
    """Rows below the header of each file, without parsing them. A record with quoted line breaks is one; blank ones are none."""
    if look_through(spark, path).line_breaks:
        records = quoted_records(spark, path, delimiter or detect_delimiter(spark, path))
        begin = F.hex(F.substring("value", 1, 1))
        blank = begin.isin("", "20", "09", "0D") & F.hex("value").rlike("^(20|09|0D)*$")
        return records.where(~F.col("head") & ~blank).count()
    lines = spark.read.option("lineSep", "\n").text(path).where(~F.col("value").rlike("^[ \\t\\r]*$"))
    by_file = lines.groupBy(F.col("_metadata").getField("file_path").alias("file")).agg(F.count(F.lit(1)).alias("n"))
    return by_file.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0))).first()[0]


def preview(df: DataFrame, rows: int = 20) -> dict:
    """The first rows, and how many rows and columns there are."""
    return {"rows": df.limit(rows).collect(), "total_rows": df.count(), "total_columns": len(df.columns)}


# ---- files whose table does not start in the first line -------------------------------------------------------------
def raw_grid(spark: SparkSession, path: str, delimiter: str | None = None, encoding: str | None = None, multi_line: bool | None = None) -> DataFrame:
    """Every record as an array of cells, with its position; empty cells are NULL. No header is taken.

    Encodings and quoted line breaks are found, or given, as in `read_delimited`."""
    look = look_through(spark, path) if encoding is None or multi_line is None else None
    encoding = encoding or look.encoding
    delimiter = delimiter or detect_delimiter(spark, path)
    if encoding is None or (look.line_breaks if multi_line is None else multi_line):
        lines = _records(spark, path, delimiter, encoding, look and look.files).select("value", _place())
    else:
        lines = with_position(spark.read.text(path))
        lines = lines.withColumn("value", F.regexp_replace(_text(F.col("value"), encoding), f"^{BOM}", ""))
    widest = lines.agg(F.max(F.length("value") - F.length(F.replace("value", F.lit(delimiter), F.lit(""))))).first()[0] or 0
    names = [f"c{i}" for i in range(widest + 1)]
    parsed = F.from_csv("value", ", ".join(f"{n} string" for n in names), {"sep": delimiter, "quote": '"', "escape": '"', "multiLine": "true"})
    cells = F.array(*[F.col("cells").getField(n) for n in names])
    return lines.select(parsed.alias("cells"), POSITION).select(cells.alias("cells"), POSITION)


def suggest_header_row(grid: DataFrame, rows: int = GRID_HEAD_ROWS) -> int:
    """The first of the first rows, from 1, that fills 80% of the widest of them, and two cells at least."""
    head = [r.cells for r in grid.orderBy(POSITION).limit(rows).collect()]
    filled = [sum(v is not None for v in cells) for cells in head]
    widest = max(filled, default=0)
    return next((i for i, n in enumerate(filled, 1) if widest and n >= max(2, 0.8 * widest)), 1)


def table_from_grid(grid: DataFrame, header_row: int, drop_empty: bool = True) -> DataFrame:
    """The table below the header row (0: no header). Unnamed columns are `Column i`, repeats get _2, _3.

    Blank rows are dropped, and blank columns that have no name. One aggregate finds width and blank columns."""
    lines = grid.count()
    if not 0 <= header_row <= lines:
        raise TableError(f"the header row must be between 0 and {lines}")
    width = grid.agg(F.max(F.size("cells"))).first()[0] or 0
    header: list = [None] * width
    body = grid
    if header_row:
        first = grid.orderBy(POSITION).limit(header_row).orderBy(F.desc(POSITION)).limit(1).collect()      # one row
        header = list(first[-1].cells) + [None] * (width - len(first[-1].cells))
        body = grid.filter(F.col(POSITION) > _literal(grid, first[-1][POSITION]))
    names, unnamed, seen = [], [], {}
    for i, value in enumerate(header, 1):
        name = (value or "").strip()
        unnamed.append(not name)
        name = name or f"Column {i}"
        seen[name] = seen.get(name, 0) + 1
        names.append(name if seen[name] == 1 else f"{name}_{seen[name]}")
    table = body.select(*[F.get("cells", F.lit(i)).alias(n) for i, n in enumerate(names)], POSITION)
    if not drop_empty or not names:
        return table
    blank = [is_blank(col(n), T.StringType()) for n in names]
    empty = table.agg(*[F.bool_and(b).alias(f"b{i}") for i, b in enumerate(blank)]).first()
    kept = [n for i, n in enumerate(names) if not (unnamed[i] and empty[i])]
    filled_row = F.lit(False)
    for b in blank:
        filled_row = filled_row | ~b
    return table.filter(filled_row).select(*[col(n) for n in kept], POSITION)


def _literal(grid: DataFrame, place):
    return F.struct(*[F.lit(v).cast(f.dataType).alias(f.name) for v, f in zip(place, grid.schema[POSITION].dataType.fields)])
