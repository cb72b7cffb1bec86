import hashlib
import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from gridloom.llm import fill_middle, words
from gridloom.llm.codepoints import CodePoints


def model(doc_id, text):
    text = text or ""
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[k:k + 8], 16) for k in (0, 8, 16, 24))
    n = len(text)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return doc_id, n, "plain", None, None, text
    p, m, s = text[:a], text[a:b], text[b:]
    return (doc_id, n, "spm", a, b - a, f"<S>{s}<P>{p}<M>{m}") if h4 % 100 < 20 else (doc_id, n, "psm", a, b - a, f"<P>{p}<S>{s}<M>{m}")


def texts(seed, n):
    r = random.Random(seed)
    letters = ["a", "B", " ", "\n", "é", "中", "😀", "é", "<", ">", "<P", "S>", "M", "‍", "\x00"]
    return ["".join(r.choices(letters, k=r.choice([0, 1, 2, 5, 40, 300]))) for _ in range(n)]


def rows_of(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output").collect()), key=str)


def test_against_a_model_and_back(docs_of):
    rows = list(enumerate(texts(1, 400))) + [(1000, None), (None, "no id é"), (1001, "a <M> b"), (1002, "<P>"), (1003, "<S"), (1004, "x" * 50_000 + "é" * 50_000), (7, "same id"), (7, "same id")]
    filled = fill_middle.fill_in_middle(docs_of(rows))
    assert rows_of(filled) == sorted((model(i, t) for i, t in rows), key=str)
    assert filled.where("form = 'psm'").count() > 100 and filled.where("form = 'spm'").count() > 30 and filled.where("form = 'plain'").count() > 30
    back = filled.select("doc_id", fill_middle.rebuilt(F.col("output"), F.col("form")).alias("text")).collect()
    assert sorted((tuple(r) for r in back), key=str) == sorted(((i, t or "") for i, t in rows), key=str)


def test_marks_beside_the_cuts_come_back(docs_of):
    """A text's own ends of marks next to ours."""
    rows = [(i, t) for i in range(60) for t in ("<", "<P", "P>", "S>M>P>", "<<<", "><>", "<S<P<M")]
    filled = fill_middle.fill_in_middle(docs_of(rows))
    back = filled.select("doc_id", fill_middle.rebuilt(F.col("output"), F.col("form")).alias("text")).collect()
    assert sorted(map(tuple, back)) == sorted(rows)


def test_shares_and_seed(docs_of):
    docs = docs_of([f"text {i}" for i in range(200)])
    assert {r.form for r in fill_middle.fill_in_middle(docs, plain_percent=0, spm_percent=100).collect()} == {"spm"}
    assert {r.form for r in fill_middle.fill_in_middle(docs, plain_percent=100).collect()} == {"plain"}
    assert rows_of(fill_middle.fill_in_middle(docs, seed=2)) != rows_of(fill_middle.fill_in_middle(docs))


def test_no_rows(docs_of):
    assert fill_middle.fill_in_middle(docs_of([])).collect() == []


def test_code_points_and_bytes():
    some = texts(2, 200)
    data, bounds = words.text_bytes(pa.array(some, pa.string()), lower=False)
    points = CodePoints(data, bounds)
    assert points.counts.tolist() == [len(t) for t in some]
    for d, t in enumerate(some):
        at = np.arange(len(t) + 1)
        want = [len(t[:k].encode()) + bounds[d] for k in at]
        assert points.to_bytes(np.full(len(at), d), at).tolist() == want
        assert points.to_points(np.full(len(at), d), np.array(want)).tolist() == at.tolist()
