"""Repeated passages, by sliding spans of sentences.

Texts are cut into sentences, and these further by winnowing: of each NEAR words in a row, the last with the smallest hash
ends a part. Which words of a passage do so is alike wherever it stands, but for its first and last NEAR words. From each
sentence (or part of one) on, the shortest run of at least two and MIN_WORDS words is hashed. Hashes are counted over all
documents; of each that occurs again, the first place (by doc_id, text, place) stays, and sentences that any other place
covers are removed. Any passage of more than 50 words that another document holds is found: a part ends within its first
7 words, the run from there on within 36 more, and the 7 behind are inside the passage too.

The parts only find; what goes are whole sentences, and those that are covered in part stay as they are. Only a sentence of more
than LONG words, and a repeated stretch that holds no whole sentence, go by their parts. The first document that holds a
passage keeps it, so of n holders n - 1 lose it.

Counting combines before the shuffle. Only runs that pass a bitmap of the repeated hashes (of fixed size) go through the
second join, and only documents that lose something are joined with what they lose.

Defined results: a NULL text stays NULL, an empty one empty. A document is a doc_id with a text (by its hash): repeated
rows are one document and lose the same, rows that share only the doc_id are several, so are rows with a NULL doc_id,
which come after all others. An empty table gives an empty result. Other
columns are ignored. A text that loses all its sentences is empty.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import written
from . import words
from .frames import documents, fields, id_place, map_pieces, maybe_in, place_filter, table

MIN_WORDS, MIN_SENTENCES = 30, 2    # what repeats in fewer words is left alone
LONG = 30                   # words from which on a sentence goes by its parts
NEAR = 7                    # words in a row of which one ends a part; 3 * NEAR + MIN_WORDS <= 53 finds all passages of 51 words
FILTER_BITS = 1 << 27       # 16 MB
LAST = (1 << 63) - 1        # order of a NULL doc_id


class Cut:
    """Sentences and runs of all texts of a column. first, last: words of a sentence or part; doc: its text; run: the part after each part's run, 0 without one; unit: number of
    the sentence, or of the part of a long one, that goes as a whole."""

    def __init__(self, column: pa.Array):
        w = self.words = words.find_words(column, lower=True)
        n = len(w.start)
        hashes = w.hashes()
        breaks = np.concatenate([[0], np.cumsum(w.data == 10)])
        ends = np.isin(w.data[w.end - 1], np.frombuffer(b".!?", np.uint8)) if n else np.zeros(0, bool)
        if n:
            ends[:-1] |= (breaks[w.start[1:]] > breaks[w.end[:-1]]) | (w.doc[1:] != w.doc[:-1])
            ends[-1] = True
        sentence = np.concatenate([[0], np.cumsum(ends)])[:-1] if n else np.zeros(0, np.int64)
        ends[_least(hashes, w.doc)] = True
        self.last = np.flatnonzero(ends)
        self.first = np.concatenate([[0], self.last[:-1] + 1]).astype(np.int64) if n else self.last
        self.doc = w.doc[self.first]
        self.sentence = sentence[self.first]
        by_parts = np.bincount(sentence)[self.sentence] > LONG if n else np.zeros(0, bool)
        new = np.concatenate([[True], (self.sentence[1:] != self.sentence[:-1]) | by_parts[1:]])[:len(self.first)]
        self.unit = np.cumsum(new)
        after = np.maximum(np.searchsorted(self.last + 1, self.first + MIN_WORDS), np.arange(len(self.first)) + MIN_SENTENCES - 1)
        inside = after < len(self.first)
        inside[inside] = self.doc[after[inside]] == self.doc[inside]
        self.run = np.where(inside, after + 1, 0)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(hashes * words.powers(words._BASE, n), out=sums[1:])
        a, b = self.first, np.where(inside, self.last[np.minimum(after, len(self.last) - 1)] + 1, 0) if n else self.last
        self.hash = words.mix((sums[b] - sums[a]) * words.powers(words._INVERSE, n + 1)[a] + (b - a).astype(np.uint64))
        self.bounds = np.searchsorted(self.doc, np.arange(w.n_docs + 1))


def _least(hashes: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """The last smallest hash of each NEAR words in a row of one text."""
    many = len(hashes) - NEAR + 1
    if many <= 0:
        return np.zeros(0, np.int64)
    best, at = hashes[:many].copy(), np.arange(many)
    for k in range(1, NEAR):
        less = hashes[k:k + many] <= best
        best[less] = hashes[k:k + many][less]
        at[less] = np.flatnonzero(less) + k
    return at[doc[:many] == doc[NEAR - 1:]]


def _keyed(docs: DataFrame) -> DataFrame:
    """`docs` with doc, print: what tells a document from the others."""
    return docs.withColumn("doc", F.coalesce("doc_id", F.lit(LAST))).withColumn("print", F.xxhash64(F.col("doc_id").isNull(), "text"))


def _runs(piece: pa.RecordBatch) -> dict:
    """Per text: the hash of the run from each sentence on, NULL where there is none."""
    cut = Cut(piece.column("text"))
    values = pa.array(cut.hash.view(np.int64), pa.int64(), mask=cut.run == 0)
    return {"doc": piece.column("doc"), "print": piece.column("print"), "runs": pa.ListArray.from_arrays(pa.array(cut.bounds.astype(np.int32)), values)}


def _whole(covered: np.ndarray, unit: np.ndarray) -> np.ndarray:
    """The parts that go: of each stretch of covered ones, the whole units, or all if it has none."""
    if not covered.any():
        return covered
    unit = unit - unit[0]
    whole = covered & (np.bincount(unit)[unit] == np.bincount(unit, covered)[unit])
    stretch = np.cumsum(np.concatenate([[True], covered[1:] != covered[:-1]])) - 1
    return whole | (covered & (np.bincount(stretch, whole)[stretch] == 0))


def _without(piece: pa.RecordBatch) -> dict:
    """The texts without the sentences that the runs beginning at `places` cover."""
    cut = Cut(piece.column("text"))
    w, out = cut.words, {"doc_id": piece.column("doc_id"), "text": [], "n_sentences": [], "n_removed": [], "removed": []}
    for d, (text, places) in enumerate(zip(piece.column("text").to_pylist(), piece.column("places").to_pylist())):
        a, b = int(cut.bounds[d]), int(cut.bounds[d + 1])
        cover = np.zeros(b - a + 1, np.int64)
        for p in places or []:
            if p < b - a and cut.run[a + p]:            # always, unless the hashes of two texts of one doc_id are equal
                cover[p] += 1
                cover[cut.run[a + p] - a] -= 1
        gone = _whole(np.cumsum(cover)[:-1] > 0, cut.unit[a:b])
        spans = []
        if gone.any():
            raw, base = text.encode(), int(w.bounds[d])
            begins = np.append(w.start[cut.first[a:b]] - base, len(raw))
            begins[0] = 0
            edges = np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(np.int8), [0]])))
            spans = [(int(begins[i]), int(begins[j])) for i, j in zip(edges[::2], edges[1::2])]
            kept, at = [], 0
            for i, j in spans:
                kept.append(raw[at:i])
                at = j
            text = b"".join([*kept, raw[at:]]).decode()
            spans = [f"{len(raw[:i].decode())}:{len(raw[:j].decode())}" for i, j in spans]
        out["text"].append(text)
        out["n_sentences"].append(len(np.unique(cut.sentence[a:b])))
        out["n_removed"].append(len(np.unique(cut.sentence[a:b][gone])))
        out["removed"].append(",".join(spans))
    return out


def deduplicated(docs: DataFrame) -> DataFrame:
    """doc_id, n_sentences, n_removed (sentences that go, or lose a part), removed (spans of code points of the old text), text without them."""
    source = documents(docs)
    runs = written(map_pieces(_keyed(source), "text", _runs, fields("doc:bigint", "print:bigint", "runs:array<bigint>")))
    each = runs.select("doc", "print", F.posexplode("runs").alias("place", "run")).where("run is not null")
    at = F.struct("doc", "print", "place")
    repeated = written(each.groupBy("run").agg(F.min(at).alias("first"), F.max(at).alias("last")).where("first <> last").select("run", "first"))
    held = place_filter(repeated.select(F.col("run").bitwiseAND(F.lit(FILTER_BITS - 1))), FILTER_BITS)

    def again(batches):
        for batch in batches:
            lists = batch.column("runs")
            offsets = lists.offsets.to_numpy()
            values = lists.values.slice(offsets[0], offsets[-1] - offsets[0])
            known = np.flatnonzero(values.is_valid().to_numpy(zero_copy_only=False))
            run = values.fill_null(0).to_numpy()[known]
            known, run = (x[maybe_in(held, run & (FILTER_BITS - 1))] for x in (known, run))
            row = np.searchsorted(offsets - offsets[0], known, "right") - 1
            place = pa.array((known - (offsets - offsets[0])[row]).astype(np.int32))
            yield pa.RecordBatch.from_arrays([batch.column("doc").take(pa.array(row)), batch.column("print").take(pa.array(row)), place, pa.array(run)],
                                             names=["doc", "print", "place", "run"])
    maybe = runs.mapInArrow(again, "doc long, print long, place int, run long")
    later = maybe.join(repeated, "run").where(at != F.col("first"))
    lost = written(later.groupBy("doc", "print").agg(F.collect_set("place").alias("places")))
    losing = place_filter(lost.select(id_place("print")))

    marked = map_pieces(_keyed(source).withColumn("place", id_place("print")), "text",
                        lambda p: {"doc_id": p.column("doc_id"), "text": p.column("text"), "maybe": maybe_in(losing, p.column("place").to_numpy())},
                        fields("doc_id:bigint", "text:string", "maybe:boolean"))
    none = marked.where("not maybe").select("doc_id", "text", F.lit(None).cast("array<int>").alias("places"))
    some = _keyed(marked.where("maybe")).join(lost, ["doc", "print"], "left").select("doc_id", "text", "places")
    schema = fields("doc_id:bigint", "text:string", "n_sentences:bigint", "n_removed:bigint", "removed:string")
    return map_pieces(none.unionByName(some), "text", _without, schema)


def op2_substring_dedup(spark, folder: str) -> DataFrame:
    return deduplicated(table(spark, folder, "documents"))
