"""License texts and notices in documents, by patience alignment.

Words are compared in lower case and without punctuation. For a stretch of a document and a template, words unique to
both are anchors; the longest increasing subsequence of their places is kept, and the gaps between anchors are aligned
the same way, down to equal words at their ends. Coverage is the share of the template's words that are aligned.

A notice of up to SHORT words may miss one of them, if it is one that says little (`FILLERS`); all others must be aligned.

Alignment is for few documents: a template can be covered no further than its words occur at all, with their numbers,
so documents, and then windows of a document, whose count stays below the threshold, or that lack a word they must have,
are passed over without loss. Templates are texts and notices by SPDX identifier (`license_texts`), or the caller's.

Defined results: a NULL or empty text has no license. Repeated rows get equal findings; an empty table gives an empty
result. A license that occurs twice is found twice. Findings of equal coverage over the same words: the longer template,
then the smaller name. Other columns are ignored. Templates without words are never found.
"""
from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import words
from .frames import Spans, documents, fields, map_pieces, table
from .license_texts import FILLERS, TEMPLATES

COVERAGE = 0.8
SPREAD = 1.5                # a finding spans at most so many times the template's words
SHORT = 12                  # notices of up to so many words must have all words that tell something

def patience(a: list, b: list, low_a: int = 0, low_b: int = 0) -> list[tuple[int, int]]:
    """Pairs (place in a, place in b) of equal words, rising in both. Gaps wait on a list, so depth is no matter."""
    pairs, todo = [], [(low_a, len(a), low_b, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            pairs.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            pairs.append((a1, b1))
        if a0 == a1 or b0 == b1:
            continue
        in_a, in_b = Counter(a[a0:a1]), Counter(b[b0:b1])
        where = {w: j for j, w in enumerate(b[b0:b1], b0) if in_b[w] == 1}
        anchors = increasing([(i, where[w]) for i, w in enumerate(a[a0:a1], a0) if in_a[w] == 1 and w in where])
        pairs += anchors
        if anchors:
            edges = [(a0 - 1, b0 - 1), *anchors, (a1, b1)]
            todo += [(i + 1, k, j + 1, m) for (i, j), (k, m) in zip(edges, edges[1:])]
    return sorted(pairs)


def increasing(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest subsequence, of pairs rising in the first place, that rises in the second too."""
    tails, ends, before = [], [], []
    for n, (_, j) in enumerate(pairs):
        at = bisect_left(tails, j)
        tails[at:at + 1] = [j]
        ends[at:at + 1] = [n]
        before.append(ends[at - 1] if at else -1)
    out, n = [], ends[-1] if ends else -1
    while n >= 0:
        out.append(pairs[n])
        n = before[n]
    return out[::-1]


class Template:
    def __init__(self, name: str, text: str):
        found = words.find_words(pa.array([text]), lower=True, gaps=words.NOT_LETTERS)
        self.name, self.words = name, found.hashes().tolist()
        self.size = len(self.words)
        texts = [w.decode() for w in found.texts(np.arange(self.size))]
        self.must = frozenset(i for i, w in enumerate(texts) if w not in FILLERS) if self.size <= SHORT else frozenset()
        missing = self.size - len(self.must) if self.size <= SHORT else self.size
        self.need = self.size - min(1, missing) if self.size <= SHORT else int(np.ceil(COVERAGE * self.size))
        self.counts = Counter(self.words)

    def holds(self, pairs: list[tuple[int, int]]) -> bool:
        return len(pairs) >= self.need and self.must.issubset(j for _, j in pairs)


class Prepared:
    """Templates, their words, and for each word the templates that have it and how often; what each template needs, and which words."""

    def __init__(self, templates: tuple[tuple[str, str], ...]):
        self.templates = [t for t in (Template(*x) for x in templates) if t.size]
        self.words = np.unique(np.array([w for t in self.templates for w in t.words], np.uint64))
        entries = sorted((int(np.searchsorted(self.words, np.uint64(w))), i, n, w in {t.words[j] for j in t.must}) for i, t in enumerate(self.templates) for w, n in t.counts.items())
        word, self.template, self.times, self.must = (np.array(x) for x in zip(*entries)) if entries else (np.zeros(0, np.int64),) * 4
        self.bounds = np.searchsorted(word, np.arange(len(self.words) + 1))
        self.need = np.array([t.need for t in self.templates])
        self.musts = np.array([len({t.words[j] for j in t.must}) for t in self.templates])

    def possible(self, doc: np.ndarray, word: np.ndarray, n_docs: int) -> np.ndarray:
        """(text, template) pairs that hold enough of the template's words, and all that must be there, in any order."""
        size, total = len(self.words), len(self.templates)
        key, times = np.unique(doc * size + word, return_counts=True)
        doc, word = key // size, key % size
        many = self.bounds[word + 1] - self.bounds[word]
        at = np.repeat(self.bounds[word] - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))
        pair = np.repeat(doc, many) * total + self.template[at]
        held = np.bincount(pair, np.minimum(np.repeat(times, many), self.times[at]), n_docs * total).reshape(n_docs, total)
        must = np.bincount(pair, self.must[at], n_docs * total).reshape(n_docs, total)
        return np.argwhere((held >= self.need) & (must >= self.musts))


@lru_cache(maxsize=4)
def _prepared(templates: tuple[tuple[str, str], ...]) -> Prepared:
    return Prepared(templates)


def align(text: list, template: Template) -> list[tuple[int, int, int]]:
    """(aligned words, first word, word after the last) of each place where `text` (hashes, 0 for words of no template) holds the template.

    Windows of twice the template's length begin every half of it, so every finding lies in one of them. Of findings that
    overlap, those with most words stay."""
    size, found = template.size, []
    step = max(1, size // 2)
    known = np.cumsum([0] + [w in template.counts for w in text])
    starts = np.arange(0, max(1, len(text) - size + step), step)
    hits = known[np.minimum(starts + 2 * size, len(text))] - known[starts]
    for start in starts[hits >= template.need].tolist():
        window = text[start:start + 2 * size]
        if sum((Counter(window) & template.counts).values()) < template.need:
            continue
        pairs = patience(window, template.words)
        while pairs and pairs[-1][0] - pairs[0][0] >= SPREAD * size:            # a stray word far from the rest
            pairs = pairs[1:] if pairs[1][0] - pairs[0][0] > pairs[-1][0] - pairs[-2][0] else pairs[:-1]
        if template.holds(pairs):
            found.append((len(pairs), start + pairs[0][0], start + pairs[-1][0] + 1))
    taken = Spans()
    return [f for f in sorted(found, key=lambda f: (-f[0], f[2] - f[1], f[1])) if taken.add(f[1], f[2])]


def _scan(templates):
    def run(piece: pa.RecordBatch) -> dict:
        prepared = _prepared(templates)
        w = words.find_words(piece.column("text"), lower=True, gaps=words.NOT_LETTERS)
        hashes, first, findings = w.hashes(), w.first(), [[] for _ in range(w.n_docs)]
        if len(prepared.words):
            where = np.minimum(np.searchsorted(prepared.words, hashes), len(prepared.words) - 1)
            known = prepared.words[where] == hashes
            pairs = prepared.possible(w.doc[known], where[known], w.n_docs)
        else:
            known, pairs = np.zeros(len(hashes), bool), np.zeros((0, 2), np.int64)
        for d in np.unique(pairs[:, 0]).tolist():
            a, b = int(first[d]), int(first[d + 1])
            text, got = np.where(known[a:b], hashes[a:b], np.uint64(0)).tolist(), []
            for i in pairs[pairs[:, 0] == d, 1].tolist():
                t = prepared.templates[i]
                got += [(n / t.size, t.size, t.name, i, j) for n, i, j in align(text, t)]
            base, raw = int(w.bounds[d]), w.data[w.bounds[d]:w.bounds[d + 1]].tobytes()
            place = lambda byte: len(raw[:byte - base].decode())                                                    # noqa: E731
            taken = Spans()                             # of overlapping findings, that of most words
            kept = [g for g in sorted(got, key=lambda g: (-g[0] * g[1], -g[0], g[2])) if taken.add(g[3], g[4])]
            findings[d] = [{"license": n, "coverage": s, "start": place(int(w.start[a + i])), "end": place(int(w.end[a + j - 1]))} for s, _, n, i, j in sorted(kept, key=lambda k: k[3])]
        best = [max(f, key=lambda x: (x["coverage"], x["end"] - x["start"])) if f else None for f in findings]
        return {"doc_id": piece.column("doc_id"), "license": [b and b["license"] for b in best], "coverage": [b and b["coverage"] for b in best], "findings": findings}
    return run


def scan(docs: DataFrame, templates: dict[str, str] | None = None) -> DataFrame:
    """doc_id, license and coverage of the best finding, findings (license, coverage, start, end in code points). One pass, no shuffle."""
    schema = fields("doc_id:bigint", "license:string", "coverage:double", "findings:array<struct<license:string,coverage:double,start:bigint,end:bigint>>")
    return map_pieces(documents(docs), "text", _scan(tuple((templates or TEMPLATES).items())), schema)


def op1_license_scan(spark, folder: str) -> DataFrame:
    return scan(table(spark, folder, "documents"))
