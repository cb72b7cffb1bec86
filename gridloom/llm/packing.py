"""Best-fit packing by minimum bin slack.

Documents become token ids and an end id; those longer than a sequence are cut into full pieces and a rest. Which
lengths go together is decided on the table of lengths alone, of which there are at most `size`: the longest length
left opens a sequence, a subset-sum over bitsets of the lengths left finds the fullest feasible combination with it, and
that combination is used as often as its lengths last. So at most 3 * `size` patterns describe all sequences, however
many documents there are. Pieces are numbered within their length (a counted, salted numbering: no task holds all pieces of
a frequent length) and look their place up in the patterns.

Defined results: a NULL or empty text is the end id alone. Repeated rows are packed as often as they occur, equal
pieces in any order. An empty table gives no pieces. Other columns are ignored.
"""
from __future__ import annotations

import json
import re
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import written
from .frames import documents, fields, map_pieces, table

SIZE = 2048
END = 0
SALTS = 64                  # parts that number one length's pieces apart from each other
#: Texts of these characters are the same character by character and as a whole: none takes part in composition, in a
#: lower-casing that depends on its place, or in white space that only one of the libraries knows.
_PLAIN = re.compile("[\\t\\n\\x0b\\x0c\\r -~¡-įı-ſ]*")
#: What ends a run of letters without white space: the vocabulary's contractions, single digits, and runs of anything else.
_MARK = re.compile("'(?:s|t|re|ve|m|ll|d)|[0-9²³¹¼½¾]|[^\\sa-zªµºß-öø-ſ0-9²³¹¼½¾]+")


class Encoder:
    """Token ids of whole texts as bytes, four a token.

    `tokenizers` gives the ids. Texts of plain characters may take a shorter way to the same ids: where the vocabulary is
    a byte-level BPE with word ends whose merges are numbered in order, its merges are ranks, and `tiktoken` merges by
    rank. Tests compare the two; a vocabulary of another form never takes that way."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.ranked = _by_rank(path)

    def ids(self, text: str) -> bytes:
        if self.ranked is None or "<|" in text or not _PLAIN.fullmatch(text):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        words = " ".join(_MARK.sub(r" \g<0> ", text.lower()).split())
        return self.ranked.encode_to_numpy(words + " ", disallowed_special=()).astype("<u4").tobytes() if words else b""


def _by_rank(path: str):
    """The vocabulary as ranks for `tiktoken`, where a space ends a word; None if it has another form."""
    import tiktoken
    with open(path, encoding="utf-8") as file:
        model = json.load(file)["model"]
    vocabulary, merges = model.get("vocab"), model.get("merges")
    if model.get("type") != "BPE" or model.get("end_of_word_suffix") != "</w>" or model.get("continuing_subword_prefix") or model.get("ignore_merges"):
        return None
    joined = ["".join(m if isinstance(m, list) else m.split(" ")) for m in merges]
    if any(vocabulary.get(t) != 512 + i for i, t in enumerate(joined)):
        return None
    printed = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]       # bytes written as themselves in the vocabulary
    byte_of = {chr(b): b for b in printed} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(printed))}
    ranks = {}
    for token, number in vocabulary.items():
        if number >= 512 + len(merges):                     # special tokens
            continue
        stem = token.removesuffix("</w>")
        ranks[bytes(byte_of[c] for c in stem) + (b" " if stem != token else b"")] = number
    return tiktoken.Encoding("words", pat_str="[^ ]+ ", mergeable_ranks=ranks, special_tokens={})


@lru_cache(maxsize=2)
def _encoder(path: str) -> Encoder:
    return Encoder(path)


def pieces_of(docs: DataFrame, tokenizer: str, size: int = SIZE) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: the pieces of every document, in one pass without a shuffle."""
    def cut(batch: pa.RecordBatch) -> dict:
        encoder, out = _encoder(tokenizer), {"doc_id": [], "piece": [], "start": [], "length": [], "ids_crc32": []}
        for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
            ids = memoryview(encoder.ids(text or "") + END.to_bytes(4, "little"))
            for k, start in enumerate(range(0, len(ids) // 4, size)):
                part = ids[4 * start:4 * (start + size)]
                for name, value in zip(out, (doc, k, start, len(part) // 4, zlib.crc32(part))):
                    out[name].append(value)
        return out
    return map_pieces(documents(docs), "text", cut, fields("doc_id:bigint", "piece:int", "start:bigint", "length:bigint", "ids_crc32:bigint"))


# ---- which lengths go together --------------------------------------------------------------------------------------
def fullest(room: int, left: dict[int, int], lengths: list[int]) -> dict[int, int]:
    """A multiset of `left` (length: how many) with the largest sum up to `room`, as {length: times}.

    Bit s of a reached set is on if a sum of s is feasible. Longer lengths come first, so they are used up first."""
    reached, steps, full = 1, [], (1 << (room + 1)) - 1
    for n in lengths:
        if n > room or not left.get(n):
            continue
        before, many, times = reached, min(left[n], room // n), 1
        while many:                                                     # copies in groups of 1, 2, 4, ...
            times = min(times, many)
            reached |= (reached << (times * n)) & full
            many -= times
            times *= 2
        if reached != before:
            steps.append((n, before))
        if reached >> room & 1:
            break
    total, chosen = reached.bit_length() - 1, {}
    for n, before in reversed(steps):
        while not before >> total & 1:
            chosen[n] = chosen.get(n, 0) + 1
            total -= n
    return chosen


def plan_patterns(counts: dict[int, int], size: int = SIZE) -> list[tuple[int, dict[int, int]]]:
    """(times, {length: copies}) that use up all counts.

    A pattern leaves of some length fewer than its copies, so at most half; a length has at most size / length copies in
    a pattern. So a length n ends at most 2 + log2(size / n) patterns, and there are at most 3 * size in all."""
    left = {n: c for n, c in counts.items() if c}
    lengths = sorted(left, reverse=True)
    out = []
    while left:
        first = next(n for n in lengths if n in left)
        lengths = [n for n in lengths if n in left]
        left[first] -= 1
        pattern = fullest(size - first, left, lengths)
        left[first] += 1
        pattern[first] = pattern.get(first, 0) + 1
        times = min(left[n] // k for n, k in pattern.items())
        for n, k in pattern.items():
            left[n] -= k * times
            if not left[n]:
                del left[n]
        out.append((times, pattern))
    return out


def _places(patterns: list[tuple[int, dict[int, int]]]) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, first sequence, copies in a sequence, offset of the first copy): pieces of a length in rank order."""
    out, used, sequence = [], {}, 0
    for times, pattern in patterns:
        offset = 0
        for n in sorted(pattern, reverse=True):
            out.append((n, used.get(n, 0), sequence, pattern[n], offset))
            used[n] = used.get(n, 0) + times * pattern[n]
            offset += n * pattern[n]
        sequence += times
    return out


# ---- every piece to its place ---------------------------------------------------------------------------------------
def pack(pieces: DataFrame, size: int = SIZE) -> DataFrame:
    """`pieces` (a written table with `length` from 1 to `size`) with sequence_id and offset."""
    key = [c for c in ("doc_id", "piece") if c in pieces.columns]
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64(*key), F.lit(SALTS)).cast("int"))
    sums = written(salted.groupBy("length", "salt").agg(F.count("*").alias("n")))                          # at most size * SALTS rows
    counts = {r["length"]: r["n"] for r in sums.groupBy("length").agg(F.sum("n").alias("n")).collect()}    # at most `size` rows
    places = sorted(_places(plan_patterns(counts, size)))
    shift = 1 << 44
    starts = np.array([n * shift + rank for n, rank, *_ in places], np.int64)
    table_of = np.array([p for p in places], np.int64).reshape(-1, 5)

    before = sums.select("length", "salt", (F.sum("n").over(Window.partitionBy("length").orderBy("salt")) - F.col("n")).alias("before"))
    ranked = (salted.withColumn("number", F.row_number().over(Window.partitionBy("length", "salt").orderBy(*key)))
              .join(F.broadcast(before), ["length", "salt"])            # at most size * SALTS rows of three numbers
              .withColumn("rank", F.col("before") + F.col("number") - 1))
    spark = pieces.sparkSession
    held = spark.sparkContext.broadcast((starts, table_of))             # at most 3 * size patterns of at most 63 different lengths

    columns = list(pieces.columns)

    def place(batches):
        starts, at = held.value
        for batch in batches:
            n, rank = (batch.column(c).to_numpy() for c in ("length", "rank"))
            i = np.searchsorted(starts, n * shift + rank, "right") - 1
            k = rank - at[i, 1]
            new = {"sequence_id": at[i, 2] + k // at[i, 3], "offset": at[i, 4] + k % at[i, 3] * n}
            yield pa.RecordBatch.from_arrays([*map(batch.column, columns), *(pa.array(v, pa.int64()) for v in new.values())], names=[*columns, *new])
    schema = fields(*[f"{f.name}:{f.dataType.simpleString()}" for f in pieces.schema], "sequence_id:bigint", "offset:bigint")
    return ranked.select(*pieces.columns, "rank").mapInArrow(place, schema)


def op7_best_fit_packing(spark, folder: str) -> DataFrame:
    return packed(table(spark, folder, "documents"))


def packed(docs: DataFrame, tokenizer: str | None = None, size: int = SIZE) -> DataFrame:
    """The place of every piece of every document."""
    if tokenizer is None:
        import public_tokenizers
        tokenizer = public_tokenizers.path("word_bpe_49k.json")
    return pack(written(pieces_of(docs, tokenizer, size)), size)
