import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest

from gridloom.llm import fingerprints, words


def plain_fingerprint(text):
    """One text at a time, by the definition."""
    raw = text.encode()
    tally = [0] * fingerprints.BUCKETS
    for i in range(len(raw) - 2):
        x = (raw[i] + raw[i + 1] * 256 + raw[i + 2] * 65536) * 0x9E3779B97F4A7C15 % 2 ** 64
        x ^= x >> 33
        x = x * 0xFF51AFD7ED558CCD % 2 ** 64
        x ^= x >> 33
        x = x * 0xC4CEB9FE1A85EC53 % 2 ** 64
        x ^= x >> 33
        tally[x * fingerprints.BUCKETS >> 64] += 1
    rank = sorted(tally)
    edges = [rank[fingerprints.BUCKETS * k // 4 - 1] for k in (1, 2, 3)]
    quarters = [sum(c > e for e in edges) for c in tally]
    size = min(round(float(np.log(len(raw) + 1.0) / np.log(1.1))), 255)
    return quarters, size


def digest_text(quarters, size):
    bits = "".join(f"{q:02b}" for q in quarters)
    return f"{size:02x}{int(bits, 2):0{len(bits) // 4}x}"


def near(a, b):
    return max(0.0, 1 - (sum(abs(x - y) for x, y in zip(a[0], b[0])) + min(abs(a[1] - b[1]) * fingerprints.LEVEL_COST, fingerprints.LENGTH_COST)) / fingerprints.BOUND)


def brute(rows):
    """`rows` in their order."""
    out = []
    for i, (doc_id, text) in enumerate(rows):
        text, following = text or "", rows[(i + 1) % len(rows)][1] or ""
        half = len(text) // 2
        edited = text[:len(text) - half] + following[:half]
        a, b, c = (plain_fingerprint(t) for t in (text, edited, following))
        out.append((doc_id, len(text), hashlib.sha256(edited.encode()).hexdigest(), digest_text(*a), digest_text(*b), near(a, b), near(a, c)))
    return sorted(out, key=str)


def found(df):
    return sorted((tuple(r) for r in fingerprints.edit_response(df).collect()), key=str)


def texts(prose, n):
    r = random.Random(1)
    return [r.choice(["", "é中😀 "]) + prose(k, r.choice([0, 1, 5, 60, 200])) for k in range(n)]


def test_edits_against_brute_force(docs_of, prose):
    rows = list(zip(random.Random(2).sample(range(-50, 1000), 90), texts(prose, 90))) + [(2000, None), (2001, ""), (2002, "é"), (2003, "a" * 60_000)]
    assert found(docs_of(rows, 4)) == brute(sorted(rows))


@pytest.mark.parametrize("rows", [[(3, "only one text here")], [(1, "some words"), (2, "other words")], []])
def test_few_rows(docs_of, rows):
    assert found(docs_of(rows, 1)) == brute(rows)


def test_null_ids_last_and_hot_ids_in_several_slices(docs_of, prose, spark):
    copies = [(5, "the same text again and again")] * 300
    rows = [(1, prose(1, 20))] + copies + [(9, prose(2, 30)), (None, prose(3, 25))]
    got = found(docs_of(rows, 6))
    assert got == brute(rows)
    order = docs_of(rows, 6)
    assert fingerprints.edit_response(order).count() == len(rows)


def test_one_shuffle_of_texts(docs_of, prose):
    df = fingerprints.edit_response(docs_of(texts(prose, 30)))
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    dealt = [line for line in plan.split("\n") if "Exchange rangepartitioning" in line]
    assert len([line for line in dealt if "ReusedExchange" not in line]) == 1, plan


def test_fingerprints_and_likeness(docs_of, prose, spark):
    rows = [(1, prose(1, 200)), (2, prose(1, 200)), (3, prose(1, 190)), (4, prose(2, 200)), (5, None)]
    prints = fingerprints.fingerprints(docs_of(rows))
    by_id = {r.doc_id: r.fingerprint for r in prints.collect()}
    assert by_id == {i: digest_text(*plain_fingerprint(t or "")) for i, t in rows} and by_id[1] == by_id[2]
    pairs = spark.createDataFrame([(k, by_id[a], None if b is None else by_id[b]) for k, (a, b) in enumerate([(1, 2), (1, 3), (1, 4), (1, None), (5, 5)])], "k int, a string, A string")
    got = [r.likeness for r in fingerprints.compared(pairs, "a", "A").orderBy("k").collect()]
    assert got[0] == 1 and got[4] == 1 and got[3] is None and 0.7 < got[1] < 1 and got[2] < 0.35


def test_counts_in_chunks(monkeypatch, prose):
    some = pa.array([prose(k, 40) for k in range(20)] + ["", "ab", "abc"])
    data, bounds = words.text_bytes(some, lower=False)
    whole = fingerprints.counts(data, bounds)
    assert whole.sum() == sum(max(len(t) - 2, 0) for t in some.to_pylist())
    monkeypatch.setattr(fingerprints, "CHUNK", 37)
    assert (fingerprints.counts(data, bounds) == whole).all()
