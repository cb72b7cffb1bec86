import itertools
import math
import random
import re

import numpy as np
import pyarrow as pa

from gridloom.llm import decontaminate, substring_dedup

TOKEN = re.compile(r"[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def substituted(text, times, r):
    w = text.split(" ")
    for i in r.sample(range(len(w)), times):
        w[i] = f"zz{r.randrange(10 ** 6)}"
    return " ".join(w)


def leaks(docs, items):
    """Every alignment of every item with every text."""
    out = {}
    split = lambda t: TOKEN.findall((t or "").lower())                                     # noqa: E731
    for d, t in docs:
        w, hit = split(t), []
        for i, it in items:
            it = split(it)
            if len(it) < decontaminate.MIN_WORDS:
                continue
            n = min(len(it), decontaminate.WINDOW)
            for shift in range(-len(it), len(w)):
                same = [0 <= k + shift < len(w) and w[k + shift] == it[k] for k in range(len(it))]
                if any(sum(same[k:k + n]) >= decontaminate.SHARE * n for k in range(len(it) - n + 1)):
                    hit.append(i)
                    break
        out[d] = hit
    return out


def test_leaks_with_substitutions(spark, docs_of, prose):
    r = random.Random(8)
    items = [(k, prose(1000 + k, n)) for k, n in enumerate([60, 40, 20, 16, 12, 8, 6, 5, 4, 1])] + [(30 + n, prose(2000 + n, n)) for n in range(7, 16)] + [(20, None), (21, ""), (22, prose(1000, 60)), (23, "a a a a a a a a a")]
    texts = [prose(k, 80) for k in range(30)]
    for k in range(90):
        i, item = r.choice([x for x in items if x[1] and len(x[1].split(" ")) > 4])
        texts.append(f"{prose(50 + k, 30)} {substituted(item, r.randrange(0, 1 + len(item.split(' ')) // 4), r)} {prose(99 + k, 20)}")
    texts += [None, "", "a " * 500, items[0][1], items[0][1].upper(), " ".join(items[0][1].split(" ")[:30]), texts[35], texts[35]]
    docs = list(enumerate(texts))
    rows = decontaminate.contaminated(docs_of(docs), spark.createDataFrame([(*x, "extra") for x in items], "item_id long, text string, Text string")).collect()
    assert {r.doc_id: r.item_ids or [] for r in rows} == leaks(docs, items) and len(rows) == len(docs)
    assert all(r.contaminated == bool(r.item_ids) and r.n_items == len(r.item_ids or []) for r in rows)


def test_seeds_pass_over_every_admitted_substitution():
    """All ways to substitute a quarter of an item of 5 to 20 words: some seed has only words that stayed."""
    for n in range(5, 21):
        size = min(n, decontaminate.WINDOW)
        times = size - math.ceil(decontaminate.SHARE * size)
        places = [sum(1 << (k + i) for k, c in enumerate(m) if c == "1") for m in decontaminate.seeds_of(n) for i in range(size - len(m) + 1)]
        for gone in itertools.combinations(range(size), times):
            lost = sum(1 << i for i in gone)
            assert any(not p & lost for p in places), (n, gone)


def test_leaks_without_rows_or_ids(spark, docs_of, prose):
    item = prose(1, 30)
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    assert [r.contaminated for r in decontaminate.contaminated(docs_of([(None, item), (None, item)]), bench).collect()] == [True, True]
    assert decontaminate.contaminated(docs_of([]), bench).collect() == []
    assert [r.n_items for r in decontaminate.contaminated(docs_of([item]), bench.limit(0)).collect()] == [0]


WORD = re.compile(r"[^\x20\x09-\x0d]+")


def runs_of(texts, n):
    """(text number, word number) of every run of n words, by its words."""
    out = {}
    for d, t in enumerate(texts):
        w = WORD.findall((t or "").lower())
        for i in range(len(w) - n + 1):
            out.setdefault(tuple(w[i:i + n]), []).append((d, i))
    return out


def test_repeated_passages(docs_of, prose):
    """By the words alone: no passage of more than 50 words is left twice, and nothing goes that is not repeated."""
    r = random.Random(9)
    passages = [prose(500 + k, r.randrange(51, 90)) for k in range(5)] + [prose(600, 70).replace(".", "").replace(",", "")]
    texts = [prose(k, 120) for k in range(20)]
    for k in range(24):
        end = r.choice([" ", ".\n", ". "])
        texts.append(f"{prose(100 + k, 30)}{end}{passages[k % 6]}{r.choice([' ', chr(10)])}{prose(200 + k, 30)}")
    texts += [None, "", "One. Two. Three.", texts[3], texts[3].upper(), (prose(7, 60) + " ") * 3, "é ß. " + passages[0], prose(800, 250).replace(".", "")]
    docs = list(enumerate(texts))
    rows = {x.doc_id: x for x in substring_dedup.deduplicated(docs_of(docs)).collect()}
    assert len(rows) == len(docs)
    repeated = {k for k, v in runs_of(texts, 51).items() if len(v) > 1}
    assert len(repeated) > 100
    left = runs_of([rows[d].text for d, _ in docs], 51)
    assert all(len(left[k]) == 1 for k in repeated if k in left)
    shared = {d for v in runs_of(texts, substring_dedup.MIN_WORDS).values() if len(v) > 1 for d, _ in v}
    for d, t in docs:
        x, at, kept = rows[d], 0, ""
        if d not in shared or t is None:
            assert (x.text, x.n_removed, x.removed) == (t, 0, "")
            continue
        where = {i for v in runs_of(texts, 20).values() if len(v) > 1 for e, k in v if e == d for i in range(k, k + 20)}
        begins = [m.start() for m in WORD.finditer(t)]
        for a, b in (map(int, s.split(":")) for s in x.removed.split(",") if s):
            kept, at = kept + t[at:a], b
            assert {i for i, c in enumerate(begins) if a <= c < b} <= where                                # what goes occurs again
        assert x.text == kept + t[at:]


def test_whole_sentences_go(docs_of, prose):
    """Six repeated sentences go whole, the ones around them stay whole, whatever stands before them."""
    r = random.Random(4)
    sentence = lambda n: " ".join(f"s{r.randrange(10 ** 6):x}" for _ in range(n)) + "."                     # noqa: E731
    six = [sentence(r.randrange(8, 14)) for _ in range(6)]
    own = [[sentence(r.randrange(5, 20)) for _ in range(6)] for _ in range(8)]
    docs = [(d, " ".join([*own[d][:3], *six, *own[d][3:]])) for d in range(7)]
    docs.append((7, " ".join([*own[7][:2], own[7][2][:-1], *six, *own[7][3:]])))                            # the first one runs on from another sentence
    rows = {x.doc_id: x for x in substring_dedup.deduplicated(docs_of(docs)).collect()}
    assert rows[0].text == docs[0][1] and rows[0].n_removed == 0 and rows[0].n_sentences == 12
    for d in range(1, 7):
        assert rows[d].text == " ".join(own[d]) and rows[d].n_removed == 6, d
    assert rows[7].text == " ".join([*own[7][:2], own[7][2][:-1] + " " + six[0], *own[7][3:]]) and rows[7].n_removed == 5


def test_repeated_rows_and_no_rows(docs_of, prose):
    t = prose(1, 100)
    rows = substring_dedup.deduplicated(docs_of([(1, t), (1, t), (None, t), (None, t), (0, "x")])).collect()
    assert sorted((str(x.doc_id), x.n_removed > 0) for x in rows) == [("0", False), ("1", False), ("1", False), ("None", True), ("None", True)]
    assert substring_dedup.deduplicated(docs_of([])).collect() == []


def test_rows_without_an_id_or_with_one_id_lose_only_what_is_repeated(docs_of, prose):
    p = [prose(600 + k, 60) for k in range(4)]
    own = [prose(700 + k, 90) for k in range(8)]
    for d in (None, 5):
        docs = [(1, f"{p[0]}\n{p[1]}"), (d, f"{p[0]}\n{own[0]}"), (d, f"{own[1]}\n{p[1]}"), (d, f"{own[2]}\n{own[3]}"), (d, f"{own[4]}\n{own[5]}"), (d, f"{p[2]}\n{own[6]}"), (d, f"{p[2]}\n{own[7]}")]
        texts = [x.text for x in substring_dedup.deduplicated(docs_of(docs)).collect()]
        whole = "\n".join(texts)
        assert all(whole.count(x) == 1 for x in own + p[:2]) and docs[3][1] in texts and docs[4][1] in texts
        assert whole.count(p[2]) == 1                       # the other copy, at the same place, is found


def test_every_passage_of_more_than_50_words_is_found():
    r = random.Random(77)
    word = lambda mark: f"w{int(r.paretovariate(0.5)) % 3000:x}{r.choice(mark)}"                    # noqa: E731
    for mark in (["", "", "", ".", ","], [""], [""] * 30 + ["."]):
        words = [word(mark) for _ in range(6000)]
        for size in (51, 55, 60):
            left = []
            for _ in range(300):
                a = r.randrange(len(words) - size)
                texts = [" ".join(x) for x in (words[max(0, a - 100):a + size + 100], [word(mark) for _ in range(r.randrange(40))] + words[a:a + size] + [word(mark) for _ in range(r.randrange(40))])]
                cut = substring_dedup.Cut(pa.array(texts))
                known, other = (cut.doc == 0) & (cut.run > 0), np.flatnonzero((cut.doc == 1) & (cut.run > 0))
                gone = {k for i in other[np.isin(cut.hash[other], cut.hash[known])] for k in range(cut.first[i], cut.last[cut.run[i] - 1] + 1)}
                left.append(size - len(gone))
            assert max(left) < size - 29 and np.mean(left) < 12, (size, max(left), np.mean(left))
