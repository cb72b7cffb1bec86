"""What the operators of this folder share: choosing columns, and passing rows through Python in bounded pieces."""
from __future__ import annotations

from bisect import bisect_right
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import written

PIECE_BYTES = 1_000_000     # bytes of text handled at once by one Python worker; a longer text is handled alone


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def pick(df: DataFrame, **columns: str) -> DataFrame:
    """Columns by exact name, as `new_name="old name"` or `new_name="old name:type"`; a missing column is NULL.

    Goes by position, so other columns whose names differ only in case do no harm."""
    plain = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
    out = []
    for new, old in columns.items():
        name, _, kind = old.partition(":")
        value = F.col(f"c{df.columns.index(name)}") if name in df.columns else F.lit(None)
        out.append((value.cast(kind) if kind else value).alias(new))
    return plain.select(*out)


def documents(df: DataFrame) -> DataFrame:
    return pick(df, doc_id="doc_id:bigint", text="text:string")


def fields(*specs: str) -> T.StructType:
    return T.StructType([T.StructField(s.split(":")[0], T._parse_datatype_string(s.split(":", 1)[1])) for s in specs])


def pieces(batch: pa.RecordBatch, column: str) -> Iterator[pa.RecordBatch]:
    """`batch` in slices of about PIECE_BYTES of `column`, at least one row each."""
    sizes = pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False)
    start, held = 0, 0
    for i, n in enumerate(sizes):
        if i > start and held + n > PIECE_BYTES:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += int(n)
    if len(sizes) > start:
        yield batch.slice(start)


def map_pieces(df: DataFrame, column: str, run: Callable[[pa.RecordBatch], dict | None], schema: T.StructType) -> DataFrame:
    """Apply `run` to bounded slices of the rows; it returns the values of the new columns, by name."""
    import pyspark.sql.pandas.types as kinds
    arrow = kinds.to_arrow_schema(schema)

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, column):
                values = run(piece)
                if values is not None:
                    yield pa.RecordBatch.from_arrays(
                        [v if isinstance(v, pa.Array) and v.type == f.type else pa.array(v, f.type) for f, v in ((f, values[f.name]) for f in arrow)], schema=arrow)
    return df.mapInArrow(over, schema)


def add_columns(df: DataFrame, column: str, run: Callable[[pa.Array], dict], added: T.StructType) -> DataFrame:
    """`df` with columns computed from one text column, row by row and without a shuffle; the names must be new."""
    at, import_names = df.columns.index(column), [f.name for f in added]
    inner = T.StructType([T.StructField(f"c{i}", f.dataType) for i, f in enumerate(df.schema)] + [T.StructField(f"n{i}", f.dataType) for i, f in enumerate(added)])

    def rows(piece: pa.RecordBatch) -> dict:
        new = run(piece.column(at))
        return {f"c{i}": piece.column(i) for i in range(piece.num_columns)} | {f"n{i}": new[name] for i, name in enumerate(import_names)}
    out = map_pieces(df.toDF(*[f"c{i}" for i in range(len(df.columns))]), f"c{at}", rows, inner)
    return out.toDF(*df.columns, *import_names)


def fixed_binary(rows) -> pa.Array:
    """A 2-D array of numbers as one binary value a row."""
    width = rows.shape[1] * rows.itemsize
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(width), len(rows), [None, pa.py_buffer(rows.tobytes())]).cast(pa.binary())


ID_BITS = 1 << 24           # bits of an id filter: 2 MB whatever the number of ids


def id_place(column: str):
    """The place of a bigint id in an id filter; NULL has one too."""
    return F.pmod(F.xxhash64(column), F.lit(ID_BITS))


def place_filter(places: DataFrame, bits: int = ID_BITS):
    """A broadcast bitmap of fixed size of the one column of `places`, numbers from 0 to `bits` - 1.

    Different things can share a place, so it only spares work: what passes is still joined. Built on the executors; one
    row for each 32,768 places reaches the driver."""
    place = F.col(places.columns[0]) + 1                # counted from 1: bucket k holds places 32768 * (k - 1) and on
    rows = places.groupBy(F.bitmap_bucket_number(place).alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bits")).collect()
    held = np.zeros((bits // 32768, 4096), np.uint8)
    for r in rows:
        held[r["k"] - 1] = np.frombuffer(bytes(r["bits"]), np.uint8)
    return places.sparkSession.sparkContext.broadcast(held.ravel())


def maybe_in(held, places: np.ndarray) -> np.ndarray:
    return (held.value[places >> 3] >> (places & 7).astype(np.uint8) & 1).astype(bool)


def without_ids(df: DataFrame, key: str, gone: DataFrame) -> DataFrame:
    """`df` without the rows whose `key` is in the one column of `gone` (bigint). Rows with a NULL key stay.

    Rows that a fixed-size filter of the ids rules out are not shuffled; the others, which are little more than those
    that go, are joined."""
    ids = written(gone.toDF("gone").where("gone is not null").distinct())
    held = place_filter(ids.select(id_place("gone")))
    names = [f"c{i}" for i in range(len(df.columns))]
    plain = df.toDF(*names)
    at = F.col(names[df.columns.index(key)]).cast("bigint")

    def flag(batches):
        for batch in batches:
            maybe = pa.array(maybe_in(held, batch.column(batch.num_columns - 1).to_numpy()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], maybe], names=[*names, "maybe"])
    schema = T.StructType([*plain.schema.fields, T.StructField("maybe", T.BooleanType())])
    marked = plain.withColumn("place", F.pmod(F.xxhash64(at), F.lit(ID_BITS))).mapInArrow(flag, schema)
    stay = marked.where("not maybe").select(*names)
    left = marked.where("maybe").select(*names).join(ids, at == F.col("gone"), "left_anti")
    return stay.union(left).toDF(*df.columns)


class Spans:
    """Spans of one text that do not overlap, in order; asking and adding take a search, not a pass."""

    def __init__(self, spans=()):
        self.starts, self.ends = [], []
        for start, end in sorted(spans):                # overlapping ones are taken as one
            if self.ends and start < self.ends[-1]:
                self.ends[-1] = max(self.ends[-1], end)
            else:
                self.starts.append(start)
                self.ends.append(end)

    def add(self, start: int, end: int) -> bool:
        """Add the span if it overlaps none; was it added?"""
        at = bisect_right(self.starts, start)
        if (at and self.ends[at - 1] > start) or (at < len(self.starts) and self.starts[at] < end):
            return False
        self.starts.insert(at, start)
        self.ends.insert(at, end)
        return True
