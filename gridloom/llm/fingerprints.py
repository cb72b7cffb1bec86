"""Document fingerprints: a digest of the quartiles of hashed byte triplets.

Every three neighbouring bytes of a text are hashed into one of `BUCKETS` counters. A counter's code says in which quarter of
the text's counters it is (0 to 3), so the digest depends on what is frequent, little on how long the text is. A
fingerprint is the level of the length (two hex digits, a tenth to a level), then the codes, two bits each, in hex. Equal
texts have equal fingerprints; an edit of a part moves the counters it touches.

The difference of two fingerprints is the sum of the differences of their codes, plus a bounded amount for the lengths. Codes
of unrelated texts differ by 1.25 each on average: a difference of that size or more is a likeness of 0, none is 1.

Defined results: a NULL text is empty. A text of fewer than three bytes has no triplets and all codes 0. Repeated rows
have a fingerprint each; an empty table gives none. Other columns are ignored.
"""
from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from . import words
from .codepoints import CodePoints
from .frames import documents, fields, map_pieces, pieces, table

BUCKETS = 1024
BOUND = BUCKETS * 5 // 4    # the difference at which two texts count as unrelated
LEVEL_COST, LENGTH_COST = 2, 40     # of a level of difference in length, and of all of them together
CHUNK = 4_000_000           # bytes counted at once
_MUL = np.uint64(0x9E3779B97F4A7C15)
_TOP = np.uint64(64 - BUCKETS.bit_length() + 1)


def counts(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Hashed triplets of each text by bucket."""
    n = len(bounds) - 1
    out = np.zeros(n * BUCKETS, np.int64)
    for start in range(0, len(data) - 2, CHUNK):
        part = data[start:start + CHUNK + 2].astype(np.uint32)
        triplet = (part[:-2] | part[1:-1] << 8 | part[2:] << 16).astype(np.uint64)
        bucket = (words.mix(triplet * _MUL) >> _TOP).astype(np.int64)
        at = np.arange(start, start + len(bucket))
        text = np.searchsorted(bounds, at, "right") - 1
        whole = at + 3 <= bounds[text + 1]
        first = int(text[0]) if len(text) else 0
        tally = np.bincount((text[whole] - first) * BUCKETS + bucket[whole])
        out[first * BUCKETS:first * BUCKETS + len(tally)] += tally
    return out.reshape(n, BUCKETS)


def codes(tallies: np.ndarray) -> np.ndarray:
    """The quarter, 0 to 3, of each counter among its text's counters; equal counters have the lower one."""
    at = [BUCKETS // 4 - 1, BUCKETS // 2 - 1, BUCKETS * 3 // 4 - 1]
    edges = np.partition(tallies, at, axis=1)[:, at]
    return sum((tallies > edges[:, k, None]).astype(np.uint8) for k in range(3))


def level(n_bytes: np.ndarray) -> np.ndarray:
    return np.minimum(np.round(np.log(np.asarray(n_bytes) + 1.0) / np.log(1.1)), 255).astype(np.uint8)


def written_out(quarters: np.ndarray, levels: np.ndarray) -> list[str]:
    q = quarters.reshape(len(quarters), BUCKETS // 4, 4)
    packed = np.concatenate([levels[:, None], q[:, :, 0] << 6 | q[:, :, 1] << 4 | q[:, :, 2] << 2 | q[:, :, 3]], axis=1)
    return [row.tobytes().hex() for row in packed]


def read_back(digests: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Codes and levels of written fingerprints."""
    raw = np.frombuffer(bytes.fromhex("".join(digests)), np.uint8).reshape(-1, 1 + BUCKETS // 4)
    return (raw[:, 1:, None] >> np.array([6, 4, 2, 0], np.uint8) & 3).reshape(-1, BUCKETS), raw[:, 0]


def likeness(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """0 (unrelated) to 1 (equal) for each pair of fingerprints, as (codes, levels)."""
    body = np.abs(a[0].astype(np.int8) - b[0].astype(np.int8)).sum(axis=1, dtype=np.int64)
    length = np.minimum(np.abs(a[1].astype(np.int64) - b[1].astype(np.int64)) * LEVEL_COST, LENGTH_COST)
    return np.maximum(0.0, 1.0 - (body + length) / BOUND)


def _digest(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return codes(counts(data, bounds)), level(np.diff(bounds))


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, fingerprint of each row of `docs`. One pass, no shuffle."""
    def make(piece: pa.RecordBatch) -> dict:
        data, bounds = words.text_bytes(piece.column("text"), lower=False)
        return {"doc_id": piece.column("doc_id"), "n_chars": CodePoints(data, bounds).counts, "fingerprint": written_out(*_digest(data, bounds))}
    return map_pieces(documents(docs), "text", make, fields("doc_id:bigint", "n_chars:bigint", "fingerprint:string"))


def compared(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """`pairs` with `likeness`, of the fingerprints in columns `a` and `b`; NULL where one is NULL."""
    at = [pairs.columns.index(a), pairs.columns.index(b)]
    names = [f"c{i}" for i in range(len(pairs.columns))]

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (batch.column(i).to_pylist() for i in at)
            known = [i for i in range(len(x)) if x[i] is not None and y[i] is not None]
            out = [None] * len(x)
            for i, value in zip(known, likeness(read_back([x[i] for i in known]), read_back([y[i] for i in known])).tolist()):
                out[i] = value
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.float64())], names=[*names, "likeness"])
    plain = pairs.toDF(*names)
    return plain.mapInArrow(compare, T.StructType([*plain.schema, T.StructField("likeness", T.DoubleType())])).toDF(*pairs.columns, "likeness")


# ---- how fingerprints bear an edit ----------------------------------------------------------------------------------
_RESULT = "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _edited(ids: pa.Array, texts: pa.Array, following: pa.Array) -> pa.RecordBatch:
    """One row for each text and the one that follows it."""
    own, own_bounds = words.text_bytes(texts, lower=False)
    other, other_bounds = words.text_bytes(following, lower=False)
    points, more = CodePoints(own, own_bounds), CodePoints(other, other_bounds)
    row, half = np.arange(len(texts)), points.counts // 2
    keep = points.to_bytes(row, points.counts - half).tolist()
    head = more.to_bytes(row, np.minimum(half, more.counts)).tolist()
    x, y = own.tobytes(), other.tobytes()
    edited = [x[a:b] + y[c:d] for a, b, c, d in zip(own_bounds.tolist(), keep, other_bounds.tolist(), head)]
    mine, next_one, changed = _digest(own, own_bounds), _digest(other, other_bounds), _digest(*words.text_bytes(pa.array(edited, pa.binary()), lower=False))
    values = [ids, pa.array(points.counts), pa.array([hashlib.sha256(e).hexdigest() for e in edited]), pa.array(written_out(*mine)), pa.array(written_out(*changed)),
              pa.array(likeness(mine, changed)), pa.array(likeness(mine, next_one))]
    return pa.RecordBatch.from_arrays(values, names=[c.split()[0] for c in _RESULT.split(", ")])


def _in_order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All rows of a slice but its last, each with the row that follows; one row is carried over."""
    held = None
    for batch in batches:
        for piece in pieces(batch.select(["doc_id", "text"]), "text"):
            rows = piece if held is None else pa.concat_batches([held, piece])
            if rows.num_rows > 1:
                yield _edited(rows.column(0)[:-1], rows.column(1)[:-1], rows.column(1)[1:])
            held = pa.RecordBatch.from_pylist(rows.slice(rows.num_rows - 1).to_pylist(), rows.schema)       # a copy: a slice would keep the piece


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The first and the last row of a slice, whose rows come in any order."""
    ends: dict[bool, tuple] = {}
    for batch in batches:
        if batch.num_rows:
            keys = list(zip(*[batch.column(c).to_pylist() for c in ("absent", "key", "h", "u")]))
            for is_first, pick in ((True, min), (False, max)):
                i = pick(range(len(keys)), key=keys.__getitem__)
                if is_first not in ends or pick(keys[i], ends[is_first][0]) == keys[i]:
                    ends[is_first] = keys[i], batch.column("doc_id")[i].as_py(), batch.column("text")[i].as_py()
    if ends:
        names = ["slice", "is_first", "doc_id", "text"]
        rows = [dict(zip(names, (TaskContext.get().partitionId(), is_first, doc_id, text))) for is_first, (_, doc_id, text) in ends.items()]
        yield pa.RecordBatch.from_pylist(rows, pa.schema([("slice", pa.int32()), ("is_first", pa.bool_()), ("doc_id", pa.int64()), ("text", pa.string())]))


def edit_response(docs: DataFrame) -> DataFrame:
    """For each row of `docs`, how its fingerprint bears an edit, and how it differs from a stranger's.

    doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next. The edited text has its second half
    replaced by as many first code points of the next document. Next is by doc_id, NULL last, then by a hash of the text;
    the first document follows the last.

    Texts are shuffled once, into slices by that order; equal rows are dealt over slices, so a hot id is many tasks. Each task reads
    its slice in order, one row ahead. Only the two ends of each slice are matched across slices."""
    spark = docs.sparkSession
    if spark.conf.get("spark.sql.exchange.reuse", "true").lower() != "true":
        raise RuntimeError("spark.sql.exchange.reuse must be on: both readers of the slices must see the same ones")
    order = ["absent", "key", "h", "u"]
    keyed = documents(docs).select("doc_id", "text", F.col("doc_id").isNull().alias("absent"), F.coalesce("doc_id", F.lit(0)).alias("key"),
                                   F.xxhash64("text").alias("h"), F.monotonically_increasing_id().alias("u"))
    sliced = keyed.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *order)     # a fixed number: both readers below see the same slices
    inside = sliced.sortWithinPartitions(*order).mapInArrow(_in_order, _RESULT)
    ends = sliced.mapInArrow(_ends, "slice int, is_first boolean, doc_id bigint, text string").repartition("slice")
    firsts, lasts = ends.where("is_first"), ends.where("not is_first")
    by_slice = Window.orderBy("slice")                      # one row for each slice
    steps = firsts.select("slice", F.coalesce(F.lead("slice").over(by_slice), F.min("slice").over(by_slice)).alias("next"))
    pairs = lasts.join(steps, "slice").join(firsts.select(F.col("slice").alias("next"), F.col("text").alias("following")), "next")

    def across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, "text"):
                yield _edited(*piece.columns)
    return inside.union(pairs.select("doc_id", "text", "following").mapInArrow(across, _RESULT))


def op13_fingerprints(spark, folder: str) -> DataFrame:
    return edit_response(table(spark, folder, "documents"))
