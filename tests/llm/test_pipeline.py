"""The pipeline against its stages in plain Python."""
import collections
import pathlib
import random

import pytest

import __spark_entry__ as contract
import corpus_pipeline
from gridloom.llm import licenses, pii, quality

from . import test_near_dup, test_packing, test_passages, test_quality

FOLDER = pathlib.Path("/root/testdata/sf0.001")


def keeps(text):
    n, chars, symbols, _, repeated = test_quality.brute(text)
    w = test_quality.WORD.findall(text or "")
    lines = [x for x in (text or "").split("\n") if test_quality.WORD.search(x)]
    echoes = sum(a == b for a, b in zip(w, w[1:]))
    return not (n < 20 or 100 * repeated > 30 * n or 100 * symbols > 10 * n or 100 * (len(lines) - len(set(lines))) > 60 * len(lines) or chars < 2 * n or chars > 25 * n
                or 100 * echoes > 30 * n)


def masked(text):
    spans = sorted((a, pii.KINDS.index(k), b) for k, a, b in [s[:3] for s in pii.find(text)])
    out, at, end = "", 0, -1
    for a, k, b in spans:
        if a >= end:
            out += text[at:a] + f"<{pii.KINDS[k].upper()}>"
        end = at = max(end, b)
    return out + text[at:]


def test_run_against_plain_python(spark, prose, tmp_path):
    tokenizers = pytest.importorskip("tokenizers")
    r = random.Random(11)
    items = [(k, prose(1000 + k, 40)) for k in range(3)]
    texts = [prose(k, r.randrange(25, 300)) for k in range(40)]
    texts += [test_near_dup.edited(texts[0], r.randrange(0, 4), r) for _ in range(12)] + ["few words", None, "", "# $ " * 40, "echo echo " * 50, texts[5]]
    texts += [f"{prose(70 + k, 40)} {items[k % 3][1]} {prose(80 + k, 30)}" for k in range(5)] + [f"{prose(90 + k, 30)} mail a{k}@b.cd or +1 (212) 555-0199 {prose(95 + k, 9)}" for k in range(4)]
    docs = list(zip(r.sample(range(1000), len(texts)), texts))
    spark.createDataFrame([(d, t, "en", "s", 1, "x") for d, t in docs], "doc_id long, text string, lang string, source string, n_chars long, kept string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    left = [(d, t) for d, t in docs if keeps(t)]
    kept = {d for d, _, _, k in test_near_dup.brute(left) if k}
    left = [(d, t) for d, t in left if d in kept]
    hits = test_passages.leaks(left, items)
    left = [(d, masked(t)) for d, t in left if not hits[d]]
    assert 30 < len(left) < len(docs) - 20 and any("<EMAIL>" in t for _, t in left)
    tokenizer = tokenizers.Tokenizer.from_file(test_packing.PATH)
    want = {d: len(tokenizer.encode(t, add_special_tokens=False).ids) + 1 for d, t in left}

    rows = corpus_pipeline.run(spark, str(tmp_path)).collect()
    got = collections.defaultdict(int)
    for x in rows:
        got[x.doc_id] += x.length
    assert got == want
    test_packing.check(rows, 2048)

    stage, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for name, run in corpus_pipeline.STAGES[:-1]:
        stage = run(spark, stage, str(tmp_path))
        assert stage.columns == ["doc_id", "text", "lang", "source", "n_chars", "kept"], name
        seen.append(stage.count())
    assert seen[-1] == seen[-2] == len(left) and seen == sorted(seen, reverse=True)
    assert all(x.n_chars == len(x.text) and x.kept == "x" for x in stage.collect())


def test_stages_bear_odd_rows(spark, docs_of, prose, tmp_path):
    spark.createDataFrame([(1, prose(1, 30)), (None, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    a = prose(5, 60)
    for rows in ([], [(1, a), (1, a), (None, a), (None, prose(6, 40)), (2, None), (3, ""), (4, prose(1, 30))]):
        docs = docs_of(rows)
        for name, run in corpus_pipeline.STAGES:
            out = run(spark, docs, str(tmp_path))
            n = out.count()
            assert not rows and n == 0 or rows and n > 0, name
    once = corpus_pipeline.near_duplicates(spark, docs_of([(1, a), (1, a), (2, a)]), str(tmp_path)).collect()
    assert [x.doc_id for x in once] == [1]


def test_rows_drop_by_id_and_text(spark, docs_of, prose, tmp_path):
    item = prose(1, 30)
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    a, b, c, d, e = (prose(20 + k, 80) for k in range(5))
    leak = f"{e} {item}"
    rows = [(1, a), (2, a), (2, b), (None, b), (None, a + " more"), (None, c), (None, c), (None, c + " more"), (None, d), (3, leak), (3, e), (None, leak), (None, None)]
    docs = docs_of(rows)
    once = [(x.doc_id, x.text) for x in corpus_pipeline.near_duplicates(spark, docs, str(tmp_path)).collect()]
    held = [t for i, t in once if i is None and t in (c, c + " more")]
    assert len(held) == 1
    assert sorted(once, key=str) == sorted([(1, a), (2, b), (None, held[0]), (None, d), (3, leak), (3, e), (None, None)], key=str)
    clean = [(x.doc_id, x.text) for x in corpus_pipeline.decontamination(spark, docs, str(tmp_path)).collect()]
    assert sorted(clean, key=str) == sorted([x for x in rows if x[1] != leak], key=str)


def test_queries_are_registered():
    names = list(contract.queries())
    for n in range(1, 11):
        assert sum(name.startswith(f"op{n}_") for name in names) == 1
    assert "pipeline" in names and not set(contract.oracle_sql()) - set(names)


@pytest.mark.skipif(not FOLDER.exists(), reason="the test tables are not here")
def test_license_query_finds_the_notices(spark):
    rows = {x.doc_id: x for x in licenses.op1_license_scan(spark, str(FOLDER)).collect()}
    texts = {x.doc_id: x.text for x in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    for name in ("Apache-2.0 notice", "MIT notice", "GPL-3.0 notice", "CC-BY-NC-4.0 notice"):
        assert {d for d, x in rows.items() if any(f.license == name for f in x.findings)} == {d for d, t in texts.items() if licenses.TEMPLATES[name] in t}
    assert quality.op5_quality_rules(spark, str(FOLDER)).where("not kept and not base_failed").count() > 0
