import random
import re

import numpy as np
import pyarrow as pa
import pytest

from gridloom.llm import components, near_dup, words

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def shingles(text):
    w = WORD.findall((text or "").translate(LOWER))
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute(rows):
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j]):
                parent[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[root(i)] = min(least.get(root(i), d), d)
    return sorted((d, len(s), least[root(i)], d == least[root(i)]) for i, ((d, _), s) in enumerate(zip(rows, sets)))


def found(df):
    return sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in near_dup.near_duplicates(df).collect())


def edited(text, times, r):
    w = text.split(" ")
    for _ in range(times):
        w[r.randrange(len(w))] = f"x{r.randrange(10 ** 6)}"
    return " ".join(w)


def test_components_of_groups_with_many_edits(docs_of, prose):
    r, rows = random.Random(3), []
    for g in range(6):
        base = prose(g, 150)
        rows += [edited(base, r.randrange(0, 7), r) for _ in range(25)]
    rows += [prose(100 + k, 60) for k in range(20)] + [rows[0]] * 10 + ["", None, " \n\t ", "one two", "one two", "one two three four five", "One two"]
    ids = r.sample(range(10_000), len(rows))
    rows = list(zip(ids, rows))
    assert found(docs_of(rows)) == brute(rows)


def test_a_large_group_in_blocks(docs_of, prose, monkeypatch):
    r = random.Random(4)
    base = prose(1, 120)
    rows = [(i, edited(base, r.randrange(0, 9), r)) for i in range(400)]
    monkeypatch.setattr(near_dup, "BLOCK_ROWS", 16)
    assert found(docs_of(rows, 7)) == brute(rows)


def test_null_ids_repeated_rows_and_no_rows(docs_of, prose):
    a, b = prose(1, 50), prose(2, 50)
    rows = near_dup.near_duplicates(docs_of([(7, a), (7, a), (None, a), (None, b), (None, None), (3, ""), (9, a)])).collect()
    assert sorted(((r.doc_id, r.component_id, r.kept) for r in rows), key=str) == sorted(
        [(7, 7, True), (7, 7, True), (None, 7, False), (None, None, True), (None, None, True), (3, 3, True), (9, 7, False)], key=str)
    assert near_dup.near_duplicates(docs_of([])).collect() == []


def test_rows_of_one_id_with_other_texts(docs_of, prose):
    a, b = prose(1, 50), prose(2, 50)
    rows = near_dup.near_duplicates(docs_of([(1, a), (1, b), (2, b), (3, a)])).collect()
    assert sorted((r.doc_id, r.component_id) for r in rows) == [(1, 1), (1, 1), (2, 1), (3, 1)]


def test_estimates_and_merging():
    r = np.random.default_rng(5)
    for share in (0.3, 0.6, 0.85, 0.95):
        errors = []
        for _ in range(20):
            both = r.integers(0, 1 << 63, int(1000 * share), dtype=np.uint64)
            a, b = (np.unique(np.concatenate([both, r.integers(0, 1 << 63, (1000 - len(both)) // 2, dtype=np.uint64)])) for _ in range(2))
            x, y = near_dup.minima(a), near_dup.minima(b)
            errors.append(near_dup.estimate(near_dup.registers(x), near_dup.registers(y), len(a), len(b)) - len(both) / len(np.union1d(a, b)))
            union = near_dup.registers(near_dup.minima(np.union1d(a, b)))
            assert (near_dup.merge(near_dup.registers(x), near_dup.registers(y)) == union).all()
        assert abs(np.mean(errors)) < 0.03 and np.max(np.abs(errors)) < near_dup.MARGIN


def test_connected_against_union_find(spark):
    r = random.Random(6)
    for n, m in ((50, 30), (200, 190), (300, 900)):
        edges = [(r.randrange(n), r.randrange(n)) for _ in range(m)] + [(i, i + 1) for i in range(1000, 1060)] + [(5, 5), (None, 3)]
        parent = {}

        def root(x):
            parent.setdefault(x, x)
            while parent[x] != x:
                x = parent[x]
            return x
        for a, b in edges:
            if a is not None:
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
        got = {(x.node, x.root) for x in components.connected(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
        assert got == {(x, root(x)) for x in parent}


@pytest.mark.parametrize("texts", [["a b  c", None, "", "\n", "d\x0be\x0cf\rg"], ["x"], [], ["é ü", "a", "b"]])
def test_words(texts):
    w = words.find_words(pa.array(texts, pa.string()))
    by_doc = [[] for _ in texts]
    for d, t in zip(w.doc.tolist(), w.texts(np.arange(len(w.start)))):
        by_doc[d].append(t.decode())
    assert by_doc == [WORD.findall(t or "") for t in texts]


def test_words_of_slices_and_hashes():
    column = pa.array(["skip", "a b a", None, "b a", "ab a"]).slice(1)
    w = words.find_words(column)
    h = w.hashes()
    assert w.counts().tolist() == [3, 0, 2, 2] and h[0] == h[2] == h[4] == h[6] and h[1] == h[3] and len(set(h.tolist())) == 3
    assert words.whole_hashes(h, w.first())[1] == 0
