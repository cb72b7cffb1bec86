"""Ranked lexical search by norm buckets.

The terms of the items are the coordinates. A document is the vector of its terms' impacts (integers that grow with the
occurrences and shrink with the document's length), an item the vector of its terms' weights, and a score their inner
product. Each weight is split evenly between the two sides, so that rare terms count for the length of either.

1. One pass over the texts keeps, for each document, its number of terms and the counts of the items' terms; the corpus
   counts (documents with a term, all terms, documents by term) are sums over that table.
2. Vectors are ordered by length: each belongs to a level, `LEVELS` to a doubling. The longest ones, whole levels with at
   least one document in `HEAD`, are searched first; the k-th score they give an item is its starting threshold.
3. Each task takes the levels of its other documents from the longest down. By Cauchy-Schwarz no vector of a level scores
   more than the level's greatest length times the item's: if that is under the threshold, so are all further levels. Inside a
   level, the products on the item's heaviest coordinates are added up and the rest is bounded by the lengths that are
   left; what may still reach the threshold is scored again in integers. Thresholds rise within a task.

Bounds are floating-point with a margin far above their rounding, scores are 64-bit integers, ties are never pruned: the
result is exact. A task returns at most k documents an item. No vector is shuffled, and a level that holds a third
of all rows is as many tasks as its rows came from.

Items are taken in blocks of bounded size, each with a search of its own over all documents: only a block's terms and
thresholds are sent to the tasks.

Defined results: a NULL text has no terms, is not counted and is never found. An item is a distinct row of id and text; one
without terms, or whose terms no document has, gets no rows. Repeated rows of documents are ranked each. A NULL doc_id ranks after
all others of its score. An empty table on either side gives no rows. Other columns are ignored.
"""
from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import written
from . import words
from .frames import documents, fields, map_pieces, pick, table

TOP = 10
BLOCK_ITEMS, BLOCK_CHARS = 1024, 4_000_000
LEVELS = 4                  # levels of length to a doubling
HEAD = 64                   # one document in so many is searched for the starting thresholds
FOCUS = 8                   # heaviest coordinates of an item whose products are added up before the bound is taken
MARGIN = 1 + 1e-9           # far above the rounding of sums of squares of a few thousand terms
PART_POSTINGS = 1_000_000   # postings handled at once by one Python worker
SECTION = 4_000_000         # bytes of a long text whose terms are looked for at once
TERM = re.compile("[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+")
_LOWER = {c: c + 32 for c in range(65, 91)}
FOUND = "item int, item_id bigint, doc_id bigint, score bigint"


def terms_of(text: str | None) -> list[str]:
    return TERM.findall((text or "").translate(_LOWER))


@dataclass
class Vocabulary:
    """The terms of a block of items, ordered by hash."""
    terms: list[bytes]
    hashes: np.ndarray
    data: np.ndarray            # the terms' bytes one after the other
    start: np.ndarray

    @classmethod
    def of(cls, terms: set[str]) -> Vocabulary:
        column = pa.array(sorted(terms), pa.string())
        w = words.find_words(column, gaps=words.NOT_LETTERS)
        hashes = w.hashes()
        order = np.argsort(hashes)
        if len(np.unique(hashes)) < len(hashes):
            raise ValueError("two terms of the items have one hash")
        raw = [t.encode() for t in column.to_pylist()]
        raw = [raw[i] for i in order]
        return cls(raw, hashes[order], np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in raw])]).astype(np.int64))

    def numbers(self, w: words.Words) -> tuple[np.ndarray, np.ndarray]:
        """Which words are terms, and of which number. Equal hashes are confirmed byte by byte."""
        hashes = w.hashes()
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        hit = np.flatnonzero(self.hashes[at] == hashes)
        at = at[hit]
        size = self.start[at + 1] - self.start[at]
        alike = w.end[hit] - w.start[hit] == size
        hit, at, size = hit[alike], at[alike], size[alike]
        if not len(hit):
            return hit, at
        first = np.cumsum(size) - size
        offset = np.arange(int(size.sum())) - np.repeat(first, size)
        same = w.data[np.repeat(w.start[hit], size) + offset] == self.data[np.repeat(self.start[at], size) + offset]
        whole = np.logical_and.reduceat(same, first)
        return hit[whole], at[whole]


def _sections(column: pa.Array) -> Iterator[tuple[int, pa.Array]]:
    """(number of the first text, texts): the column as it is, or its one long text in sections cut between terms."""
    data, bounds = words.text_bytes(column, lower=False)
    if len(column) != 1 or len(data) <= SECTION:
        yield 0, column
        return
    start = 0
    while start < len(data):
        end = min(start + SECTION, len(data))
        while end < len(data):
            gap = np.flatnonzero(words.NOT_LETTERS[data[end:end + SECTION]])
            if len(gap):
                end += int(gap[0])
                break
            end = min(end + SECTION, len(data))
        yield 0, pa.array([data[start:end].tobytes()], pa.binary())
        start = end


def packed(values: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """One binary value for each stretch of `values` between two `bounds`."""
    return pa.Array.from_buffers(pa.binary(), len(bounds) - 1, [None, pa.py_buffer((bounds * values.itemsize).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(values))])


def counted(docs: DataFrame, vocabulary) -> DataFrame:
    """doc_id, n (terms with repeats), terms, times (numbers of the items' terms in the document and their occurrences, packed int32)."""
    def count(piece: pa.RecordBatch) -> dict:
        known: Vocabulary = vocabulary.value
        n, keys = np.zeros(piece.num_rows, np.int64), []
        for _, column in _sections(piece.column("text")):
            w = words.find_words(column, lower=True, gaps=words.NOT_LETTERS)
            n += w.counts()
            hit, term = known.numbers(w)
            keys.append(np.unique(w.doc[hit] * len(known.terms) + term, return_counts=True))
        key, where = np.unique(np.concatenate([k for k, _ in keys]), return_inverse=True)
        times = np.bincount(where, np.concatenate([t for _, t in keys]), len(key)).astype(np.int32) if len(key) else np.zeros(0, np.int32)
        bounds = np.searchsorted(key, np.arange(piece.num_rows + 1) * len(known.terms))
        return {"doc_id": piece.column("doc_id"), "n": n, "terms": packed((key % len(known.terms)).astype(np.int32), bounds), "times": packed(times, bounds)}
    return map_pieces(documents(docs), "text", count, fields("doc_id:bigint", "n:bigint", "terms:binary", "times:binary"))


@dataclass
class Items:
    """The items of a block: numbers and weights of their terms, and the weights' floating-point halves."""
    ids: list[int | None]
    numbers: list[np.ndarray]       # of the terms, heaviest half-weight first
    weights: list[np.ndarray]       # w * occurrences in the item
    halves: list[np.ndarray]        # sqrt(w) * occurrences in the item
    lengths: np.ndarray
    root: np.ndarray                # sqrt(w) by term


def term_weights(n_docs: int, df: list[int]) -> list[int]:
    return [math.floor(1000 * math.log((2 * n_docs + 2) / (2 * d + 1))) for d in df]


def _items(ids: list, texts: list, vocabulary: Vocabulary, weight: np.ndarray) -> Items:
    number = {t.decode(): i for i, t in enumerate(vocabulary.terms)}
    root = np.sqrt(weight.astype(np.float64))
    numbers, weights, halves = [], [], []
    for text in texts:
        times = Counter(terms_of(text))
        at = np.array([number[t] for t in times], np.int64)
        c = np.array(list(times.values()), np.int64)
        order = np.argsort(-(root[at] * c), kind="stable")
        at, c = at[order], c[order]
        numbers.append(at)
        weights.append(weight[at] * c)
        halves.append(root[at] * c)
    return Items(ids, numbers, weights, halves, np.array([math.sqrt(float((h * h).sum())) for h in halves]), root)


# ---- vectors --------------------------------------------------------------------------------------------------------
@dataclass
class Vectors:
    """Documents with at least one term: bounds of their postings, and by posting term, integer impact and floating-point half."""
    ids: np.ndarray
    absent: np.ndarray              # is the doc_id NULL?
    bounds: np.ndarray
    term: np.ndarray
    impact: np.ndarray
    half: np.ndarray
    squares: np.ndarray             # by document

    def levels(self) -> np.ndarray:
        """Level of length; a vector of length 0 (all weights 0) has the lowest. No vector of a level is longer than `longest(level)`."""
        level = np.full(len(self.squares), -1, np.int64)
        some = self.squares > 0
        level[some] = np.maximum(np.floor(np.log2(self.squares[some]) * (LEVELS / 2)), 0)
        return level

    def take(self, rows: np.ndarray) -> Vectors:
        size = self.bounds[rows + 1] - self.bounds[rows]
        bounds = np.concatenate([[0], np.cumsum(size)])
        at = np.repeat(self.bounds[rows] - bounds[:-1], size) + np.arange(bounds[-1])
        return Vectors(self.ids[rows], self.absent[rows], bounds, self.term[at], self.impact[at], self.half[at], self.squares[rows])


def impacts(times: np.ndarray, n: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """Impact of each posting; n: terms of its document."""
    distinct, where = np.unique(n, return_inverse=True)
    m = np.array([100 - 75 + 75 * int(x) * n_docs // n_terms for x in distinct], np.int64)[where]
    return 1_000_000_000 * times // (1000 * times + 8 * m)


def vectors(batch: pa.RecordBatch, root: np.ndarray, n_docs: int, n_terms: int) -> Iterator[Vectors]:
    """The documents of a batch that have a term, in parts of bounded size."""
    raw = batch.column("terms")
    size = np.frombuffer(raw.buffers()[1], np.int32, len(raw) + raw.offset + 1)[raw.offset:].astype(np.int64)
    size = np.diff(size) // 4
    part = np.cumsum(size) // PART_POSTINGS
    for p in np.unique(part):
        rows = np.flatnonzero((part == p) & (size > 0))
        if not len(rows):
            continue
        some = batch.take(pa.array(rows))
        bounds = np.concatenate([[0], np.cumsum(size[rows])])
        term, times = (np.frombuffer(b"".join(some.column(c).to_pylist()), np.int32).astype(np.int64) for c in ("terms", "times"))
        impact = impacts(times, np.repeat(some.column("n").to_numpy(), size[rows]), n_docs, n_terms)
        half = root[term] * impact
        ids = some.column("doc_id")
        yield Vectors(ids.fill_null(0).to_numpy(), ids.is_null().to_numpy(zero_copy_only=False), bounds, term, impact, half, np.add.reduceat(half * half, bounds[:-1]))


# ---- search ---------------------------------------------------------------------------------------------------------
class Best:
    """The k best documents of each item so far. `floor`: scores known to be reached by k documents elsewhere."""

    def __init__(self, n: int, k: int, floor: np.ndarray):
        self.k, self.floor = k, floor.copy()
        none = np.zeros(0, np.int64)
        self.held = [(none, none, none.astype(bool)) for _ in range(n)]

    def add(self, item: int, score: np.ndarray, ids: np.ndarray, absent: np.ndarray) -> None:
        score, ids, absent = (np.concatenate(x) for x in zip(self.held[item], (score, ids, absent)))
        first = np.lexsort((ids, absent, -score))[:self.k]
        self.held[item] = score[first], ids[first], absent[first]
        if len(first) == self.k:
            self.floor[item] = max(self.floor[item], score[first[-1]])


def search_level(part: Vectors, items: Items, alive: np.ndarray, best: Best) -> None:
    """Add what the documents of one level score for the items `alive`."""
    order = np.argsort(part.term, kind="stable")
    term, half = part.term[order], part.half[order]
    owner = np.repeat(np.arange(len(part.squares)), np.diff(part.bounds))[order]
    whole = np.zeros(len(items.root), np.int64)
    for item in alive.tolist():
        numbers, halves, least = items.numbers[item], items.halves[item], max(int(best.floor[item]), 1)
        focus = numbers[:FOCUS]
        known, squares = np.zeros(len(part.squares)), part.squares.copy()
        for f, q, a, b in zip(focus, halves, np.searchsorted(term, focus), np.searchsorted(term, focus, "right")):
            known[owner[a:b]] += q * half[a:b]
            squares[owner[a:b]] -= half[a:b] ** 2
        rest = halves[FOCUS:]
        bound = known + math.sqrt(float((rest * rest).sum())) * np.sqrt(np.maximum(squares, 0) + part.squares * 1e-12)
        rows = np.flatnonzero(bound * MARGIN >= least)
        if not len(rows):
            continue
        whole[numbers] = items.weights[item]
        size = part.bounds[rows + 1] - part.bounds[rows]
        first = np.cumsum(size) - size
        at = np.repeat(part.bounds[rows] - first, size) + np.arange(int(size.sum()))
        score = np.add.reduceat(whole[part.term[at]] * part.impact[at], first)
        whole[numbers] = 0
        good = score >= least
        if good.any():
            best.add(item, score[good], part.ids[rows[good]], part.absent[rows[good]])


def longest(level: int) -> float:
    return 2.0 ** ((level + 1) / LEVELS) * (1 + 1e-12)


def searched(counts: DataFrame, shared, head: bool, k: int) -> DataFrame:
    """(item, item_id, doc_id, score): at most k a task and item. `head`: of the long vectors, else of all others."""
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, floor, n_docs, n_terms, least = shared.value
        best = Best(len(items.ids), k, floor)
        for batch in batches:
            for part in vectors(batch, items.root, n_docs, n_terms):
                level = part.levels()
                for one in np.unique(level[(level >= least) == head])[::-1].tolist():
                    alive = np.flatnonzero((items.lengths * longest(one) * MARGIN >= best.floor) & (items.lengths > 0))
                    if not len(alive):
                        break
                    search_level(part.take(np.flatnonzero(level == one)), items, alive, best)
        for i, (score, ids, absent) in enumerate(best.held):
            if len(score):
                yield pa.RecordBatch.from_arrays([pa.array([i] * len(score), pa.int32()), pa.array([items.ids[i]] * len(score), pa.int64()),
                                                  pa.array(ids, pa.int64(), mask=absent), pa.array(score)], names=["item", "item_id", "doc_id", "score"])
    return counts.mapInArrow(search, FOUND)


def _best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _corpus_counts(counts: DataFrame, n_terms: int) -> tuple[int, int, np.ndarray]:
    """Documents with a term, all terms, and documents by term."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(n_terms, np.int64)
        for batch in batches:
            df += np.bincount(np.frombuffer(b"".join(batch.column(0).to_pylist()), np.int32), minlength=n_terms)
        some = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(df[some])], names=["term", "docs"])
    sizes = counts.agg(F.count_if(F.col("n") > 0), F.sum("n")).first()
    df = np.zeros(n_terms, np.int64)
    for r in counts.select("terms").mapInArrow(count, "term bigint, docs bigint").groupBy("term").agg(F.sum("docs").alias("docs")).collect():
        df[r["term"]] = r["docs"]
    return sizes[0], sizes[1] or 0, df


def _head_level(counts: DataFrame, shared) -> int:
    """The level from which on the longest vectors are at least one in HEAD of all."""
    def levels(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()
        for batch in batches:
            for part in vectors(batch, shared.value[0], *shared.value[1:]):
                held.update(part.levels().tolist())
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int64()), pa.array(list(held.values()), pa.int64())], names=["level", "n"])
    rows = sorted(((r["level"], r["n"]) for r in counts.mapInArrow(levels, "level bigint, n bigint").groupBy("level").agg(F.sum("n").alias("n")).collect()), reverse=True)
    wanted, held = max(sum(n for _, n in rows) / HEAD, 1), 0
    for level, n in rows:
        held += n
        if held >= wanted:
            return level
    return 0


def _block(docs: DataFrame, ids: list, texts: list, k: int) -> DataFrame | None:
    """The k best documents of each item of a block; None if they have no terms."""
    spark = docs.sparkSession
    terms = {t for text in texts for t in terms_of(text)}
    if not terms:
        return None
    vocabulary = Vocabulary.of(terms)
    counts = written(counted(docs, spark.sparkContext.broadcast(vocabulary)))
    n_docs, n_terms, df = _corpus_counts(counts, len(vocabulary.terms))
    if not n_docs:
        return None
    items = _items(ids, texts, vocabulary, np.array(term_weights(n_docs, df.tolist()), np.int64))
    least = _head_level(counts, spark.sparkContext.broadcast((items.root, n_docs, n_terms)))
    share = lambda floor: spark.sparkContext.broadcast((items, floor, n_docs, n_terms, least))
    floor = np.zeros(len(ids), np.int64)
    head = written(_best(searched(counts, share(floor), True, k), k))
    for r in head.where(F.col("rank") == k).select("item", "score").collect():
        floor[r["item"]] = r["score"]
    rest = searched(counts, share(floor), False, k)
    return _best(head.drop("rank").union(rest), k).select("item_id", "rank", "doc_id", "score")


def ranked(docs: DataFrame, items: DataFrame, k: int = TOP) -> DataFrame:
    """item_id, rank, doc_id, score of the k best documents of each item."""
    asked = written(pick(items, item_id="item_id:bigint", text="text:string").where("text is not null").distinct())
    size = asked.agg(F.count("*"), F.sum(F.length("text"))).first()
    n_blocks = max(1, math.ceil(size[0] / BLOCK_ITEMS), math.ceil((size[1] or 0) / BLOCK_CHARS))
    out = docs.sparkSession.createDataFrame([], "item_id bigint, rank int, doc_id bigint, score bigint")
    for b in range(n_blocks):
        rows = asked.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n_blocks)) == b).collect()
        found = _block(docs, [r["item_id"] for r in rows], [r["text"] for r in rows], k) if rows else None
        out = out if found is None else found if b == 0 else out.union(found)
    return out


def op11_ranked_search(spark, folder: str) -> DataFrame:
    return ranked(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


_UPPER, _SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
OP11_SQL = rf"""
with found as (select row_number() over () as r, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_SMALL}'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') as terms from documents),
sized as (select r, doc_id, cast(len(terms) as bigint) as n from found where len(terms) > 0),
corpus as (select count(*) as docs, cast(sum(n) as bigint) as total from sized),
counts as (select r, term, count(*) as tf from (select r, unnest(terms) as term from found) group by r, term),
held as (select term, count(*) as df from counts group by term),
items as (select row_number() over () as i, item_id, regexp_extract_all(translate(text, '{_UPPER}', '{_SMALL}'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') as terms
          from (select distinct item_id, text from benchmark where text is not null)),
asked as (select i, item_id, term, count(*) as times from (select i, item_id, unnest(terms) as term from items) group by i, item_id, term),
scored as (select i, item_id, r, s.doc_id, cast(sum(times * cast(floor(1000 * ln(cast(2 * docs + 2 as double) / cast(2 * df + 1 as double))) as bigint)
              * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + (75 * n * docs) // total)))) as bigint) as score
           from asked join held using (term) join counts using (term) join sized s using (r) cross join corpus group by i, item_id, r, s.doc_id),
ordered as (select item_id, cast(row_number() over (partition by i order by score desc, doc_id asc nulls last) as integer) as rank, doc_id, score from scored where score > 0)
select item_id, rank, doc_id, score from ordered where rank <= 10
"""
