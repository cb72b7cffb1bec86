import collections
import re

from gridloom.llm import quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    w, seen, dup = WORD.findall(text), set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    grams = collections.Counter(tuple(w[i:i + 8]) for i in range(len(w) - 7))
    cover = {k for i in range(len(w) - 7) if grams[tuple(w[i:i + 8])] > 1 for k in range(i, i + 8)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(cover)


def test_measurements(docs_of, prose):
    texts = [None, "", " ", "\n\n", "a", "é ü ß\né ü ß\n", "a\na \na", "x\r\nx\r\nx", "one two " * 40, prose(1, 400), prose(2, 20) + "\n" + prose(2, 20), "#*$%&|<> x",
             "\n".join(["same line here", "", "same line here", " ", "other"]), "long " * 60_000]
    rows = {r.doc_id: r for r in quality.ledger(docs_of(texts).drop("kept")).collect()}
    for i, t in enumerate(texts):
        assert tuple(rows[i][m] for m in quality.MEASURES[:5]) == brute(t), i


def test_policies_and_ablations(docs_of, prose):
    texts = ["short", prose(1, 100), "same same " * 50, "# # # # # " * 10, None, prose(2, 100), prose(2, 100)]
    book = quality.ledger(docs_of(texts).select("doc_id", "text")).cache()
    bits = {r.name: r.bit for r in quality.rules()}
    rows = {r.doc_id: r.failed for r in book.collect()}
    assert rows[1] == 0 and rows[5] == rows[6] and rows[0] & bits["few_words"] and rows[4] & bits["few_words"] and rows[2] & bits["repeated_words"]
    for policy, names in quality.POLICIES.items():
        mask = sum(bits[n] for n in names)
        want = {(n, sum(bool(f & bits[n]) for f in rows.values()), sum(f & mask == bits[n] for f in rows.values()), len(rows)) for n in names}
        assert {tuple(r) for r in quality.ablations(book, policy).collect()} == want
        assert {r.doc_id for r in book.where(quality.passes(policy)).collect()} == {i for i, f in rows.items() if not f & mask}


def test_no_rows(docs_of):
    book = quality.ledger(docs_of([]).select("doc_id", "text"))
    assert book.collect() == [] and all(r.rows == 0 and r.failed == 0 for r in quality.ablations(book, "v1").collect())
