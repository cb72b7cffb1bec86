import math
import random
import re

from gridloom.llm import license_texts, licenses


def lcs(a, b):
    best = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(best[j] + 1 if x == y else max(best[j + 1], new[j]))
        best = new
    return best[-1]


def test_increasing_against_brute_force():
    r = random.Random(1)
    for _ in range(200):
        pairs = list(enumerate(r.sample(range(20), r.randrange(0, 9))))
        longest = 0
        for bits in range(1 << len(pairs)):
            js = [j for i, j in pairs if bits >> i & 1]
            longest = max(longest, len(js) if js == sorted(js) else 0)
        got = licenses.increasing(pairs)
        assert len(got) == longest and got == sorted(got) and [j for _, j in got] == sorted(j for _, j in got) and set(got) <= set(pairs)


def test_patience_is_a_common_subsequence():
    r = random.Random(2)
    for _ in range(300):
        a, b = ([r.randrange(12) for _ in range(r.randrange(20))] for _ in range(2))
        pairs = licenses.patience(a, b)
        assert all(a[i] == b[j] for i, j in pairs) and all(i < k and j < m for (i, j), (k, m) in zip(pairs, pairs[1:])) and len(pairs) <= lcs(a, b)
    words = list(range(300))
    edited = [w if r.random() > 0.1 else -r.randrange(10 ** 6) for w in words]
    assert len(licenses.patience(edited, words)) == lcs(edited, words)


def test_scan(docs_of, prose):
    t, r = license_texts.TEXTS, random.Random(3)
    words = t["MIT"].split()
    worn = " ".join(w if r.random() > 0.08 else "zzz" for w in words)
    texts = [None, "", prose(1, 300), "é " + t["MIT notice"] + ".", f"{prose(2, 50)}\n{t['Apache-2.0']}\n{prose(3, 50)}", f"a {worn} b {t['ISC']} c {t['ISC']}", "the " * 50_000,
             t["GPL-3.0"].upper(), " ".join(words[:60]), "released under the license", t["MIT notice"] + " " + t["CC-BY-NC-4.0 notice"]]
    texts.append(texts[3])
    rows = {x.doc_id: x for x in licenses.scan(docs_of(texts)).collect()}
    names = [[f.license for f in rows[i].findings] for i in range(len(texts))]
    assert names == [[], [], [], ["MIT notice"], ["Apache-2.0"], ["MIT", "ISC", "ISC"], [], ["GPL-3.0"], [], [], ["MIT notice", "CC-BY-NC-4.0 notice"], ["MIT notice"]]
    one = rows[3].findings[0]
    assert texts[3][one.start:one.end] == t["MIT notice"] and one.coverage == 1.0 and rows[5].findings[0].coverage < 1
    assert licenses.scan(docs_of([])).collect() == []
    own = licenses.scan(docs_of(["x alpha beta gamma y", "none"]), {"own": "Alpha, beta gamma!", "empty": " "}).collect()
    assert {x.doc_id: x.license for x in own} == {0: "own", 1: None}


SPLIT = re.compile(r"[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def brute(text, templates):
    """Names of the findings, in order: each template against every stretch of the text, by longest common subsequences."""
    words, got = SPLIT.findall(text.lower()), []
    for name, told in templates.items():
        t = SPLIT.findall(told.lower())
        short = len(t) <= licenses.SHORT
        need = (len(t) - 1 if any(w in license_texts.FILLERS for w in t) else len(t)) if short else math.ceil(licenses.COVERAGE * len(t))
        must = [w for w in t if short and w not in license_texts.FILLERS]
        reach, best = int(licenses.SPREAD * len(t)), []
        for i in range(len(words)):
            if words[i] not in t:
                continue
            row = [0] * (len(t) + 1)
            for j in range(i, min(len(words), i + reach)):
                new = [0]
                for k, w in enumerate(t):
                    new.append(row[k] + 1 if w == words[j] else max(row[k + 1], new[k]))
                row = new
                if row[-1] >= need and words[j] in t and all(words[i:j + 1].count(w) >= must.count(w) for w in must):
                    best.append((row[-1], i, j + 1))
        taken = []
        for n, i, j in sorted(best, key=lambda f: (-f[0], f[2] - f[1], f[1])):
            if all(j <= a or b <= i for a, b in taken):
                taken.append((i, j))
                got.append((n, n / len(t), name, i, j))
    kept = []
    for f in sorted(got, key=lambda f: (-f[0], -f[1], f[2])):
        if all(f[4] <= k[3] or k[4] <= f[3] for k in kept):
            kept.append(f)
    return [f[2] for f in sorted(kept, key=lambda f: f[3])]


def test_scan_against_brute_force(docs_of, prose):
    r, names = random.Random(6), list(license_texts.TEMPLATES)
    small = {n: license_texts.TEMPLATES[n] for n in names if len(license_texts.TEMPLATES[n]) < 400}
    texts = []
    for k in range(40):
        parts = [prose(k, r.randrange(3, 20))]
        for name in r.sample(list(small), r.randrange(0, 3)):
            w = small[name].split()
            if len(w) > 14:
                for i in r.sample(range(len(w)), len(w) // 9):
                    w[i] = f"zz{r.randrange(10 ** 6)}"
            parts += [r.choice(["", "(c) 2020. ", "under the "]) + " ".join(w), prose(1000 + k, r.randrange(3, 20))]
        texts.append(r.choice([" ", "\n"]).join(parts))
    rows = {x.doc_id: x for x in licenses.scan(docs_of(texts), small).collect()}
    for d, t in enumerate(texts):
        assert [f.license for f in rows[d].findings] == brute(t, small), t


def test_every_template_is_told_from_the_others(docs_of):
    names = list(license_texts.TEMPLATES)
    rows = {x.doc_id: x for x in licenses.scan(docs_of([f"Copyright. {license_texts.TEMPLATES[n]}\nend" for n in names])).collect()}
    assert {names[d]: [f.license for f in x.findings] for d, x in rows.items()} == {n: [n] for n in names}


def test_notices_in_other_words(docs_of):
    texts = ["Released under an MIT License.", "released under MIT license", "SPDX-License-Identifier: GPL-3.0-or-later", "// spdx-license-identifier: BSD-3-Clause", "All Rights Reserved",
             "Licensed under CC BY 4.0", "all rights are reserved", "released under the license", "This work is licensed under the Creative Commons Attribution 4.0 International License."]
    rows = {x.doc_id: x.license for x in licenses.scan(docs_of(texts)).collect()}
    assert [rows[i] for i in range(len(texts))] == ["MIT notice", "MIT notice", "GPL-3.0-or-later identifier", "BSD-3-Clause identifier", "All rights reserved", None, "All rights reserved", None,
                                                    "CC-BY-4.0 notice"]
