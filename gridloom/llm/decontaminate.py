"""Benchmark passages in documents, by spaced seeds.

Words are compared in lower case and without ASCII punctuation. A seed is a fixed mask over consecutive words; only the
words under its ones are hashed, so a substituted word under a zero changes nothing. Hashes of benchmark items are
joined with those of documents. A document first passes a bitmap of the items' hashes (of fixed size, so it may be
broadcast; it only spares rows that no join would keep). Each hit names a document, an item and how the two are
aligned; on that alignment the words around the hit are compared, and the item counts as found if enough words of some
window of it agree. Short items have seeds of their own, so that every alignment on which enough words agree is looked at: an item
of any length is found whichever words are substituted.

Texts are identified by a fingerprint of their words, so a text that occurs many times is compared once.

Defined results: a NULL or empty text holds nothing. Items of fewer than MIN_WORDS words, empty or NULL are no evidence
and are never found. Repeated documents get equal results, repeated items are reported by each of their ids. Empty
tables give no hits. A row with a NULL doc_id gets its result like any other. Other columns are ignored.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import written
from . import words
from .frames import documents, fields, id_place, map_pieces, maybe_in, pick, place_filter, table

SEEDS = ["111111", "11011011", "1100110101", "10110010101"]     # for items that are long enough for them, six words each
#: By the number of words of an item (16: or more), the seeds that with those above leave no way to substitute a quarter of the words,
#: of an item or of a window of 16, that no seed passes over. Found by a greedy search; a test goes through all ways.
MORE = {5: ["1111", "11101", "11011", "10111"], 6: ["11111", "111101", "111011", "110111", "101111"], 7: ["1111101", "1111011", "1110111", "1101111", "1011111"],
        8: ["11101", "110011", "10111"], 9: ["1110011", "101111", "11010101", "11111"], 10: ["11100111", "110101011", "1111011"], 11: ["11010111", "11111001"],
        12: ["1010100111", "110101011", "11000110011", "1110001101", "110001001101"], 13: ["11010100011", "110101101", "1110001101"], 14: ["110101000011", "1111011"],
        15: ["11110101"], 16: ["101010000111", "1100001100011", "11100101001"]}
MIN_WORDS = 5
WINDOW, SHARE = 16, 0.75    # found if this share of the words of a window, or of a shorter item, agree
FILTER_BITS = 1 << 26       # 8 MB


def seeds_of(n: int) -> list[str]:
    """The seeds that find an item of `n` words, or the windows of a longer one."""
    return [m for m in SEEDS if len(m) <= n] + MORE[min(n, WINDOW)]


def _hits(hashes: np.ndarray, doc: np.ndarray, seeds: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each seed, the hash at every place where it fits into one text, and the place."""
    spread = [hashes * words._SPREAD[k] for k in range(6)]
    for mask in seeds:
        many = len(hashes) - len(mask) + 1
        if many <= 0:
            continue
        at = np.flatnonzero(doc[:many] == doc[len(mask) - 1:])
        ones = [k for k, c in enumerate(mask) if c == "1"]
        total = np.full(len(at), int(mask, 2) * 0x9E3779B97F4A7C15 % (1 << 64), np.uint64)
        for nth, k in enumerate(ones):
            total += spread[nth][at + k]
        yield words.mix(total), at


def _split(column: pa.Array):
    found = words.find_words(column, lower=True, gaps=words.NOT_LETTERS)
    return found, found.hashes(), found.first()


def _prints(hashes: np.ndarray, first: np.ndarray) -> list[bytes]:
    """128 bits of each text's words."""
    return np.stack([words.whole_hashes(hashes, first), words.whole_hashes(words.mix(hashes + words._SPREAD[9]), first)], axis=1).view("S16").ravel().tolist() if len(first) > 1 else []


def _raw(hashes: np.ndarray, first: np.ndarray) -> list[bytes]:
    return [hashes[a:b].tobytes() for a, b in zip(first[:-1].tolist(), first[1:].tolist())]


def items_of(benchmark: DataFrame) -> DataFrame:
    """item_id, words (their hashes), n of every item that can be evidence."""
    def run(piece: pa.RecordBatch) -> dict:
        _, hashes, first = _split(piece.column("text"))
        return {"item_id": piece.column("item_id"), "item_words": _raw(hashes, first), "n": np.diff(first)}
    made = map_pieces(pick(benchmark, item_id="item_id:bigint", text="text:string"), "text", run, fields("item_id:bigint", "item_words:binary", "n:int"))
    return made.where(F.col("n") >= MIN_WORDS)


def _item_seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for item, raw, n in zip(*(batch.column(c).to_pylist() for c in ("item_id", "item_words", "n"))):
            hashes = np.frombuffer(raw, np.uint64)
            h, at = (np.concatenate(x) for x in zip(*_hits(hashes, np.zeros(len(hashes), np.int64), seeds_of(n))))
            yield pa.RecordBatch.from_arrays([pa.array([item] * len(h), pa.int64()), pa.array(h.view(np.int64)), pa.array(at.astype(np.int32))], names=["item_id", "h", "item_at"])


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Compare word by word on each alignment; report the items found and the best share of equal words."""
    for batch in batches:
        fps, ids, best = [], [], []
        for row in batch.to_pylist():
            text, found, top = np.frombuffer(row["text_words"], np.uint64), [], 0.0
            for candidate in row["candidates"]:
                item = np.frombuffer(candidate["item_words"], np.uint64)
                size, share = min(len(item), WINDOW), 0.0
                for shift in candidate["shifts"]:
                    a, b = max(0, -shift), min(len(item), len(text) - shift)
                    same = np.zeros(len(item) + 1)
                    same[a + 1:b + 1] = item[a:b] == text[a + shift:b + shift]
                    same = np.cumsum(same)
                    share = max(share, float((same[size:] - same[:-size]).max()) / size)
                if share >= SHARE:
                    found.append(candidate["item_id"])
                    top = max(top, share)
            if found:
                fps.append(row["fp"])
                ids.append(sorted(found))
                best.append(top)
        yield pa.RecordBatch.from_arrays([pa.array(fps, pa.binary()), pa.array(ids, pa.list_(pa.int64())), pa.array(best, pa.float64())], names=["fp", "item_ids", "best_share"])


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, n_items, item_ids, best_share, contaminated for each row of `docs`."""
    items = written(items_of(benchmark))
    sizes = [r["n"] for r in items.select(F.least("n", F.lit(WINDOW)).alias("n")).distinct().collect()]     # twelve numbers at most
    seeds = sorted({m for n in sizes for m in seeds_of(n)})
    item_hits = written(items.mapInArrow(_item_seeds, "item_id long, h long, item_at int"))
    held = place_filter(item_hits.select(F.col("h").bitwiseAND(F.lit(FILTER_BITS - 1))), FILTER_BITS)

    def probe(piece: pa.RecordBatch) -> dict:
        found, hashes, first = _split(piece.column("text"))
        h, at = [], []
        for value, place in _hits(hashes, found.doc, seeds):
            passed = maybe_in(held, (value & np.uint64(FILTER_BITS - 1)).astype(np.int64))
            h.append(value[passed])
            at.append(place[passed])
        h, at = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (h, at))
        doc = found.doc[at]
        order = np.argsort(doc, kind="stable")
        cuts = np.searchsorted(doc[order], np.arange(found.n_docs + 1)).astype(np.int32)
        lists = lambda values, kind: pa.ListArray.from_arrays(pa.array(cuts), pa.array(values[order], kind))                    # noqa: E731
        return {"doc_id": piece.column("doc_id"), "fp": _prints(hashes, first), "h": lists(h.view(np.int64), pa.int64()), "at": lists((at - first[:-1][doc]).astype(np.int32), pa.int32())}

    rows = written(map_pieces(documents(docs), "text", probe, fields("doc_id:bigint", "fp:binary", "h:array<bigint>", "at:array<int>")))
    hits = rows.where(F.size("h") > 0).select("fp", F.explode(F.arrays_zip("h", "at")).alias("x")).select("fp", "x.h", F.col("x.at").alias("text_at")).distinct()
    aligned = hits.join(item_hits, "h").select("fp", "item_id", (F.col("text_at") - F.col("item_at")).alias("shift"))
    pairs = aligned.groupBy("fp", "item_id").agg(F.collect_set("shift").alias("shifts"))
    asked = written(pairs.join(items, "item_id").groupBy("fp").agg(F.collect_list(F.struct("item_id", "item_words", "shifts")).alias("candidates")))

    wanted = place_filter(rows.join(asked.select("fp"), "fp", "left_semi").select(id_place("doc_id")))

    def again(piece: pa.RecordBatch) -> dict | None:
        piece = piece.filter(pa.array(maybe_in(wanted, piece.column("place").to_numpy())))
        if not piece.num_rows:
            return None
        _, hashes, first = _split(piece.column("text"))
        return {"fp": _prints(hashes, first), "text_words": _raw(hashes, first)}
    texts = map_pieces(documents(docs).select(id_place("doc_id").alias("place"), "text"), "text", again, fields("fp:binary", "text_words:binary"))
    found = (texts.join(asked.select("fp"), "fp", "left_semi").dropDuplicates(["fp"]).join(asked, "fp")
             .select("fp", "text_words", "candidates").mapInArrow(_verify, "fp binary, item_ids array<bigint>, best_share double"))
    out = rows.select("doc_id", "fp").join(written(found), "fp", "left")
    return out.select("doc_id", F.coalesce(F.size("item_ids"), F.lit(0)).alias("n_items"), "item_ids", "best_share", F.col("item_ids").isNotNull().alias("contaminated"))


def op3_decontamination(spark, folder: str) -> DataFrame:
    return contaminated(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
