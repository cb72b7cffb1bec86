import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from gridloom.llm import lexical_search, words

TERM = re.compile("[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, k=10):
    counts = [(i, Counter(terms(t))) for i, t in docs]
    counts = [(i, c) for i, c in counts if c]
    n_docs, total = len(counts), sum(sum(c.values()) for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    out = []
    for item_id, text in {(i, t) for i, t in items if t is not None}:
        scores = []
        for doc_id, c in counts:
            n = sum(c.values())
            m = 100 - 75 + 75 * n * n_docs // total
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10 ** 9 * c[t] // (1000 * c[t] + 8 * m)) for t in terms(text) if c[t])
            if score > 0:
                scores.append((-score, doc_id is None, doc_id or 0, doc_id))
        out += [(item_id, rank, s[3], -s[0]) for rank, s in enumerate(sorted(scores, key=lambda s: s[:3])[:k], 1)]
    return sorted(out, key=str)


@pytest.fixture
def items_of(spark):
    return lambda rows: spark.createDataFrame([(i, t, "x") for i, t in rows], "item_id long, text string, TEXT string")


def found(docs, items):
    return sorted([(r.item_id, r["rank"], r.doc_id, r.score) for r in lexical_search.ranked(docs, items).collect()], key=str)


def corpus(seed, n):
    r = random.Random(seed)
    vocabulary = [f"{r.choice(['w', 'W', 'é', 'ñ', '中'])}{k:x}" for k in range(400)]
    return [r.choice([" ", "\n", "-", ", "]).join(r.choices(vocabulary, [1 / (k + 1) for k in range(400)], k=r.choice([1, 3, 20, 80, 300]))) for _ in range(n)]


def test_against_brute_force(docs_of, items_of):
    docs, items = list(enumerate(corpus(1, 500))), list(enumerate(t[:300] for t in corpus(2, 40)))
    assert found(docs_of(docs, 5), items_of(items)) == brute(docs, items)


def test_blocks_long_texts_and_small_parts(docs_of, items_of, monkeypatch):
    docs, items = list(enumerate(corpus(3, 150))), list(enumerate(t[:300] for t in corpus(4, 9)))
    docs.append((1000, " ".join(corpus(5, 300))))
    for name, value in (("BLOCK_ITEMS", 2), ("PART_POSTINGS", 50), ("SECTION", 1000), ("HEAD", 5)):
        monkeypatch.setattr(lexical_search, name, value)
    assert found(docs_of(docs, 4), items_of(items)) == brute(docs, items)


def test_ties_repeated_rows_nulls_and_unknown_terms(docs_of, items_of):
    docs = [(i, "same words here") for i in range(40, 10, -1)] + [(5, "same"), (5, "same"), (None, "same words here"), (None, "rare"), (7, None), (8, ""), (9, " \n-- "), (3, "Rare RARE")]
    items = [(1, "same words"), (1, "same words"), (1, "here"), (2, "rare rare"), (None, "same"), (3, None), (4, ""), (5, "unknown zzz"), (6, "!!")]
    assert found(docs_of(docs), items_of(items)) == brute(docs, items)


def test_many_copies_and_documents_of_equal_length(docs_of, items_of):
    docs = [(i, "alpha beta gamma") for i in range(300)] + [(1000 + i, f"alpha x{i}") for i in range(100)]
    items = [(1, "alpha"), (2, "x7 x9 gamma"), (3, "beta beta beta")]
    assert found(docs_of(docs, 7), items_of(items)) == brute(docs, items)


def test_empty_tables(docs_of, items_of):
    assert found(docs_of([]), items_of([(1, "a")])) == [] and found(docs_of(["a"]), items_of([])) == []
    assert found(docs_of([None, ""]), items_of([(1, "a")])) == []


def test_lengths_and_coordinates_prune(monkeypatch):
    """Once thresholds stand, most vectors are passed over without an integer score."""
    texts = pa.array(corpus(6, 400))
    vocabulary = lexical_search.Vocabulary.of({t for text in texts.to_pylist() for t in terms(text)})
    weight = np.random.default_rng(1).integers(500, 9000, len(vocabulary.terms))
    items = lexical_search._items([0], [" ".join(terms(texts[3].as_py())[:40])], vocabulary, weight)
    w = words.find_words(texts, lower=True, gaps=words.NOT_LETTERS)
    hit, term = vocabulary.numbers(w)
    assert len(hit) == len(w.start)
    key, times = np.unique(w.doc * len(weight) + term, return_counts=True)
    bounds = np.searchsorted(key, np.arange(len(texts) + 1) * len(weight))
    term = key % len(weight)
    impact = lexical_search.impacts(times, np.repeat(w.counts(), np.diff(bounds)), len(texts), len(w.start))
    half = items.root[term] * impact
    part = lexical_search.Vectors(np.arange(len(texts)), np.zeros(len(texts), bool), bounds, term, impact, half, np.add.reduceat(half * half, bounds[:-1]))
    whole = np.zeros(len(weight), np.int64)
    whole[items.numbers[0]] = items.weights[0]
    scores = np.add.reduceat(whole[term] * impact, bounds[:-1])
    floor = np.array([np.sort(scores)[-10]])
    rescored = []
    monkeypatch.setattr(lexical_search.Best, "add", lambda self, i, score, ids, absent: rescored.append(ids))
    for level in np.unique(part.levels()).tolist():
        rows = np.flatnonzero(part.levels() == level)
        assert np.sqrt(part.squares[rows]).max() <= lexical_search.longest(level)
        if items.lengths[0] * lexical_search.longest(level) < floor[0]:
            assert scores[rows].max() < floor[0]
    lexical_search.search_level(part, items, np.array([0]), lexical_search.Best(1, 10, floor))
    assert sorted(np.concatenate(rescored).tolist()) == np.flatnonzero(scores >= floor[0]).tolist()


def test_impacts_do_not_overflow():
    assert lexical_search.impacts(np.array([3]), np.array([10 ** 9]), 10 ** 11, 10 ** 13)[0] == 3 * 10 ** 9 // (3000 + 8 * (25 + 75 * 10 ** 20 // 10 ** 13))
