"""Near duplicates by SetSketch registers.

A document is the set of its distinct 5-word shingles. Of each distinct set, one sketch is made: register i is the
smallest of exponentially distributed values of the shingles (hash i), truncated to a power of a base a little over 1,
`floor(1 - log_b(min / a))`. Sketches of parts merge by taking the larger registers. Bands of registers are hashed, and
sets that agree in a band become candidates. How similar two candidates are is estimated by the likelihood of J given
how many registers are larger, smaller and equal; what may reach the threshold is confirmed on the full sets.

Candidates of a band are not paired with each other. Each goes to one member of its band, the hub. A set that
is no link of its hub is then compared with all sets that share this hub, in blocks inside a task, from which only
links that connect something leave. So two sets that agree in any band are compared unless a hub connects them already,
and the work of a group whose members match their hub is linear.

With 24 bands of 5 registers, a pair at the threshold of 0.85 agrees in no band with probability (1 - 0.85^5)^24 < 1e-6.

Defined results: a NULL or empty text, or one without words, has an empty set, is linked with nothing, and is kept. A
text of fewer than 5 words is one shingle. Repeated rows are equal sets. A row with a NULL doc_id
belongs to the component of its set, if another row has that set; else it is linked with nothing, its component_id is
NULL and it is kept. Other columns are ignored.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import written
from . import words
from .components import connected
from .frames import documents, fields, id_place, map_pieces, maybe_in, place_filter, table

SHINGLE = 5
BANDS, DEPTH = 24, 5
REGISTERS = BANDS * DEPTH
BASE, SCALE, TOP = 1.001, 20.0, 65535
THRESHOLD = (85, 100)       # linked if 100 * intersection >= 85 * union
MARGIN = 0.16               # an estimate lower than the threshold by this is no candidate: more than four standard deviations
BLOCK_ROWS, BLOCK_BYTES = 256, 8_000_000

_MUL = np.random.default_rng(10_01).integers(1, 1 << 63, REGISTERS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = np.random.default_rng(10_02).integers(0, 1 << 63, REGISTERS, dtype=np.uint64)


# ---- sets and sketches ----------------------------------------------------------------------------------------------
def shingle_sets(column: pa.Array) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    w = words.find_words(column, lower=True)
    hashes, first = w.hashes(), w.first()
    grams, at = words.ngrams(hashes, w.doc, SHINGLE)
    where = np.searchsorted(at, first)
    short = words.whole_hashes(hashes, first)
    counts = np.diff(first)
    return [np.unique(grams[where[d]:where[d + 1]]) if counts[d] >= SHINGLE else short[d:d + 1] if counts[d] else grams[:0] for d in range(w.n_docs)]


def minima(shingles: np.ndarray) -> np.ndarray:
    """The smallest hash of each register, over a set that is not empty."""
    least = np.full(REGISTERS, np.iinfo(np.uint64).max, np.uint64)
    for start in range(0, len(shingles), 2048):
        part = shingles[start:start + 2048]
        for i in range(REGISTERS):
            least[i] = min(least[i], (part * _MUL[i] + _ADD[i]).min())
    return least


def registers(least: np.ndarray) -> np.ndarray:
    """Exponentially spaced levels of the minima: larger where the minimum is smaller."""
    exponential = -np.log1p(-(least.astype(np.float64) + 0.5) / 2.0 ** 64)
    return np.clip(np.floor(1 - np.log(np.maximum(exponential, 1e-300) / SCALE) / np.log(BASE)), 0, TOP).astype(np.uint16)


def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The sketch of the union of two sets."""
    return np.maximum(a, b)


def band_keys(sketches: np.ndarray) -> np.ndarray:
    """One key a band for each sketch; the band's number is part of the key."""
    r = sketches.reshape(-1, BANDS, DEPTH).astype(np.uint64)
    return words.mix((words.mix(r + np.uint64(1)) * words._SPREAD[:DEPTH]).sum(axis=2) + np.arange(BANDS, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def _slope(larger, smaller, equal, share, j):
    """Derivative by J of the log-likelihood of the comparison of two sketches; share: of the first set in the sum of both sizes."""
    k = (BASE - 1) / BASE
    log = np.log(BASE)
    a, b = share - (1 - share) * j, (1 - share) - share * j             # shares of what only one of them has
    p, q = -np.log1p(-np.maximum(a, 1e-12) * k) / log, -np.log1p(-np.maximum(b, 1e-12) * k) / log
    dp, dq = -(1 - share) * k / log / (1 - np.maximum(a, 0) * k), -share * k / log / (1 - np.maximum(b, 0) * k)
    return larger * dp / p + smaller * dq / q - equal * (dp + dq) / np.maximum(1 - p - q, 1e-12)


def reaches(larger, smaller, equal, share, j: float) -> np.ndarray:
    """Is the most likely J at least `j`? The log-likelihood is concave, so its slope at `j` tells."""
    possible = np.minimum(share, 1 - share) / np.maximum(share, 1 - share) > j
    return possible & (_slope(larger, smaller, equal, share, j) >= 0)


def estimate(a: np.ndarray, b: np.ndarray, n_a: int, n_b: int) -> float:
    """The most likely Jaccard similarity of two sets, from their sketches and sizes."""
    larger, smaller = int((a > b).sum()), int((a < b).sum())
    low, high, share = 0.0, min(n_a, n_b) / max(n_a, n_b), n_a / (n_a + n_b)
    for _ in range(40):
        middle = (low + high) / 2
        low, high = (middle, high) if _slope(larger, smaller, len(a) - larger - smaller, share, middle) >= 0 else (low, middle)
    return (low + high) / 2


def _linked(shared, n_a, n_b):
    return THRESHOLD[1] * shared >= THRESHOLD[0] * (n_a + n_b - shared)


def fingerprint(shingles: np.ndarray) -> bytes | None:
    """128 bits that are equal for equal sets; None for an empty set."""
    if not len(shingles):
        return None
    return np.array([words.mix(shingles * words._SPREAD[0]).sum(), words.mix(shingles * words._SPREAD[1] + words._SPREAD[2]).sum()], np.uint64).tobytes()


def _sets(piece: pa.RecordBatch) -> dict:
    sets = shingle_sets(piece.column("text"))
    sketches = [registers(minima(s)).tobytes() if len(s) else None for s in sets]
    return {"doc_id": piece.column("doc_id"), "n_shingles": [len(s) for s in sets], "fp": [fingerprint(s) for s in sets], "sketch": sketches}


def sketched(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, fp (equal for equal sets), sketch. One pass, no shuffle."""
    return map_pieces(documents(docs), "text", _sets, fields("doc_id:bigint", "n_shingles:bigint", "fp:binary", "sketch:binary"))


# ---- candidates -----------------------------------------------------------------------------------------------------
def _bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            keys = band_keys(np.frombuffer(b"".join(batch.column("sketch").to_pylist()), np.uint16).reshape(-1, REGISTERS))
            at = np.repeat(np.arange(batch.num_rows), BANDS)
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64).ravel()), batch.column("fp").take(pa.array(at))], names=["band", "fp"])


def hub_members(distinct: DataFrame) -> DataFrame:
    """(hub, fp): for each band of each set that another set shares, the band's hub; every pair once. The hub is a member too.

    The hub is the set that meets most others over all its bands, so an original is rather the hub of its copies than they
    of each other, and the bands of a group have few hubs."""
    bands = distinct.select("fp", "sketch").mapInArrow(_bands, "band long, fp binary")
    several = bands.groupBy("band").agg(F.count("*").alias("n")).where("n > 1")
    shared = written(bands.join(several, "band"))
    met = shared.groupBy("fp").agg(F.sum("n").alias("met"))
    hubs = shared.select("band", "fp").join(met, "fp").groupBy("band").agg(F.max(F.struct("met", "fp"))["fp"].alias("hub"))
    return shared.join(hubs, "band").select("hub", "fp").distinct()


def full_sets(docs: DataFrame, involved: DataFrame) -> DataFrame:
    """fp, sets, sketch of the sets in `involved` (fp, row, sketch), each made again from the document `row`."""
    passing = place_filter(involved.select(id_place("row")))

    def make(piece: pa.RecordBatch) -> dict | None:
        piece = piece.filter(pa.array(maybe_in(passing, piece.column("place").to_numpy())))
        if not piece.num_rows:
            return None
        sets = shingle_sets(piece.column("text"))
        return {"fp": [fingerprint(s) for s in sets], "sets": [s.tobytes() for s in sets]}
    texts = documents(docs).where("doc_id is not null").select(id_place("doc_id").alias("place"), "text")
    sets = map_pieces(texts, "text", make, fields("fp:binary", "sets:binary"))
    return sets.join(involved.select("fp", "sketch"), "fp").dropDuplicates(["fp"])


def _as_set(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, np.uint64)


def _star(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Which members are links of their hub: estimated from the sketches, then confirmed on the full sets."""
    for batch in batches:
        hub, fp, a, b, u, v = (batch.column(c).to_pylist() for c in ("hub", "fp", "hub_set", "member_set", "hub_sketch", "member_sketch"))
        found = []
        if hub:
            x, y = (np.frombuffer(b"".join(s), np.uint16).reshape(-1, REGISTERS) for s in (u, v))
            larger, smaller = (x > y).sum(axis=1), (x < y).sum(axis=1)
            n, m = (np.array([len(s) // 8 for s in side], float) for side in (a, b))
            likely = reaches(larger, smaller, REGISTERS - larger - smaller, n / (n + m), THRESHOLD[0] / THRESHOLD[1] - MARGIN)
            for i, maybe in enumerate(likely.tolist()):
                found.append(bool(maybe and _linked(len(np.intersect1d(_as_set(a[i]), _as_set(b[i]), assume_unique=True)), len(a[i]) // 8, len(b[i]) // 8)))
        yield pa.RecordBatch.from_arrays([pa.array(hub, pa.binary()), pa.array(fp, pa.binary()), pa.array(found, pa.bool_())], names=["hub", "fp", "linked"])


def _shared_counts(sets: list[np.ndarray], n_rows: int) -> np.ndarray:
    """Sizes of the intersections of the first n_rows sets with all sets, as products of slices of the incidence matrix."""
    lengths = [len(s) for s in sets]
    _, code, seen = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(len(sets)), lengths)
    often = seen[code] > 1
    code, owner = code[often], owner[often]
    kept, code = np.unique(code, return_inverse=True)
    order = np.argsort(code, kind="stable")
    code, owner = code[order], owner[order]
    out = np.zeros((n_rows, len(sets)), np.float32)
    for start in range(0, len(kept), 4096):
        a, b = np.searchsorted(code, [start, start + 4096])
        part = np.zeros((len(sets), 4096), np.float32)
        part[owner[a:b], code[a:b] - start] = 1
        out += part[:n_rows] @ part.T
    return out


def block_links(rest: list[int], fps: list[bytes], sets: list[bytes], sketches: list[bytes], linked: list[bool]) -> list[tuple[bytes, bytes]]:
    """Links between the sets numbered in `rest` and all sets that connect something new; `linked`: already connected by the hub."""
    if not rest or len(fps) < 2:
        return []
    apart = set(rest)
    order = rest + [i for i in range(len(fps)) if i not in apart]
    x = np.frombuffer(b"".join(sketches[i] for i in order), np.uint16).reshape(-1, REGISTERS)
    n = np.array([len(sets[i]) // 8 for i in order], float)
    k = len(rest)
    larger, smaller = np.zeros((k, len(order)), np.int16), np.zeros((k, len(order)), np.int16)
    for r in range(REGISTERS):
        larger += x[:k, None, r] > x[None, :, r]
        smaller += x[:k, None, r] < x[None, :, r]
    likely = reaches(larger, smaller, REGISTERS - larger.astype(int) - smaller, n[:k, None] / (n[:k, None] + n[None, :]), THRESHOLD[0] / THRESHOLD[1] - MARGIN)
    likely[np.arange(k), np.arange(k)] = False
    rows = np.flatnonzero(likely.any(axis=1))
    if not len(rows):
        return []
    others = np.setdiff1d(np.flatnonzero(likely.any(axis=0)), rows)
    chosen = np.concatenate([rows, others])
    shared = _shared_counts([_as_set(sets[order[i]]) for i in chosen], len(rows))
    hit = _linked(shared, n[rows][:, None], n[chosen][None, :]) & likely[np.ix_(rows, chosen)]
    parent = list(range(len(order)))
    for i in range(k, len(order)):
        if linked[order[i]]:
            parent[i] = -1
    hubbed = [i for i in range(k, len(order)) if parent[i] < 0]
    for i in hubbed:
        parent[i] = hubbed[0]

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i
    out = []
    for r, c in zip(*np.nonzero(hit)):
        i, j = int(rows[r]), int(chosen[c])
        a, b = root(i), root(j)
        if a != b:
            parent[a] = b
            out.append((fps[order[i]], fps[order[j]]))
    return out


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by task (hub, row block, column block); one task's rows are held at a time."""
    held, rows, seen = None, [], set()

    def solve() -> pa.RecordBatch:
        links = block_links([i for i, r in enumerate(rows) if r["rest"]], *[[r[c] for r in rows] for c in ("fp", "sets", "sketch", "linked")])
        return pa.RecordBatch.from_arrays([pa.array([x[0] for x in links], pa.binary()), pa.array([x[1] for x in links], pa.binary())], names=["a", "b"])
    for batch in batches:
        for row in batch.to_pylist():
            key = (row["hub"], row["i"], row["j"])
            if key != held and rows:
                yield solve()
                rows, seen = [], set()
            held = key
            if row["fp"] not in seen:                   # a row of the block may be a column of it too
                seen.add(row["fp"])
                rows.append(row)
    if rows:
        yield solve()


def links(docs: DataFrame, distinct: DataFrame) -> DataFrame:
    """Confirmed links (a, b) between sets; enough of them to connect every pair that reaches the threshold and agrees in a band."""
    members = written(hub_members(distinct))
    asked = members.select("fp").distinct()
    full = written(full_sets(docs, written(distinct.join(asked, "fp", "left_semi"))))
    pairs = members.join(full, "fp")
    hub = full.select(F.col("fp").alias("hub"), F.col("sets").alias("hub_set"), F.col("sketch").alias("hub_sketch"))
    stars = written(pairs.withColumnsRenamed({"sets": "member_set", "sketch": "member_sketch"}).where("hub <> fp").join(hub, "hub")
                    .select("hub", "fp", "hub_set", "member_set", "hub_sketch", "member_sketch").mapInArrow(_star, "hub binary, fp binary, linked boolean"))
    # What a hub did not connect is compared with all that share the hub, in blocks of bounded size.
    groups = (stars.groupBy("hub").agg(F.count("*").alias("n"), F.sum((~F.col("linked")).cast("long")).alias("n_rest")).where("n_rest > 0 and n > 1"))
    sized = (stars.join(groups, "hub").join(full.select("fp", F.length("sets").alias("bytes")), "fp").groupBy("hub")
             .agg(F.sum("bytes").alias("bytes"), F.max("n").alias("n"), F.max("n_rest").alias("n_rest"), F.sum(F.when(~F.col("linked"), F.col("bytes"))).alias("rest_bytes")))
    up = lambda rows, size: F.ceil(F.greatest(F.col(rows) / BLOCK_ROWS, F.col(size) / BLOCK_BYTES)).cast("int")           # noqa: E731
    plan = written(sized.select("hub", up("n", "bytes").alias("columns"), up("n_rest", "rest_bytes").alias("lines")))
    placed = stars.join(plan, "hub").withColumn("place", F.abs(F.xxhash64("fp", "hub")))
    line = F.pmod("place", F.col("lines")).cast("int")
    as_column = placed.select("hub", "fp", "linked", F.lit(False).alias("rest"), F.explode(F.sequence(F.lit(0), F.col("lines") - 1)).alias("i"),
                              F.pmod("place", F.col("columns")).cast("int").alias("j"))
    as_line = placed.where("not linked").select("hub", "fp", "linked", F.lit(True).alias("rest"), line.alias("i"),
                                                F.explode(F.sequence(F.lit(0), F.col("columns") - 1)).alias("j"))
    filled = as_line.unionByName(as_column).join(full, "fp").repartition("hub", "i", "j").sortWithinPartitions("hub", "i", "j", F.desc("rest"), "fp")
    more = filled.select("hub", "i", "j", "fp", "linked", "rest", "sets", "sketch").mapInArrow(_blocks, "a binary, b binary")
    return stars.where("linked").select(F.col("hub").alias("a"), F.col("fp").alias("b")).unionByName(more)


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row of `docs`."""
    rows = written(sketched(docs))
    distinct = rows.where("fp is not null").groupBy("fp").agg(F.min("doc_id").alias("row"), F.first("sketch").alias("sketch"))
    distinct = written(distinct.where("row is not null"))
    roots = connected(links(docs, distinct), "a", "b")
    of = distinct.select("fp", "row").join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "row", F.coalesce("root", "fp").alias("root"))
    of = written(of)
    named = of.join(of.groupBy("root").agg(F.min("row").alias("component")), "root").select("fp", "component")
    out = rows.select("doc_id", "n_shingles", "fp").join(named, "fp", "left")
    component = F.when(F.col("fp").isNull(), F.col("doc_id")).otherwise(F.col("component"))
    return out.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull()))


def op10_minhash_near_dup(spark, folder: str) -> DataFrame:
    return near_duplicates(table(spark, folder, "documents"))
