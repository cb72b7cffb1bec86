import hashlib
import random
import re

import pytest

from gridloom.llm import pii

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits):
    total = 0
    for i, c in enumerate(digits[::-1]):
        v = int(c) * (1 + i % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def brute(text):
    out = [(m.start(), 0, m.end()) for m in EMAIL.finditer(text)]
    out += [(m.start(), 1, m.end()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m.group().split("."))]
    out += [(m.start(), 2, m.end()) for m in CARD.finditer(text) if 12 <= len(d := re.sub("[ -]", "", m.group())) <= 19 and luhn(d)]
    out += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 9 <= len(re.sub("[^0-9]", "", m.group())) <= 15]
    return [(pii.KINDS[k], s, e) for s, k, e in sorted(out)]


def base(text):
    return [s[:3] for s in pii.find(text) if s[0] in pii.BASE_KINDS]


@pytest.mark.parametrize("alphabet", ["1234500..@@-ab +()x ", "0.1", "a@.", "+1 -().2", "4 -0"])
def test_base_spans(alphabet):
    r = random.Random(alphabet)
    for _ in range(20_000):
        text = "".join(r.choice(alphabet) for _ in range(r.randrange(60)))
        assert base(text) == brute(text), text


@pytest.mark.parametrize("text", ["1" * 200_000, "a" * 200_000 + "@", "1." * 100_000, "+1" + "(" * 200_000, "a@" * 100_000, "AB12 " * 40_000, "1 " * 100_000, "@" * 200_000])
def test_long_runs_take_linear_time(text):
    pii.find(text)


def test_checksums_and_context():
    kinds = lambda t: [s[0] for s in pii.find(t)]                                          # noqa: E731
    assert pii.mod97("GB82WEST12345698765432") and not pii.mod97("GB82WEST12345698765433")
    assert kinds("account DE89 3704 0044 0532 0130 00.") == ["iban"] and kinds("account DE89 3704 0044 0532 0130 01.") == []
    assert kinds("SSN: 123-45-6789") == ["ssn"] and kinds("part 123-45-6789") == [] and kinds("ssn 000-45-6789") == []
    assert kinds("call (212) 555-1234") == ["local_phone"] and kinds("order 212-555-1234") == []
    plain, near = (next(s[3] for s in pii.find(t) if s[0] == "card") for t in ("x 4111111111111111", "my visa card 4111111111111111"))
    assert near > plain


def test_report_and_mask(docs_of):
    texts = [None, "", "é a.b@c.de é", "ip 1.2.3.4 and +1 (212) 555-1234", "x" * 100_000 + " a@b.cd", "a@b.cd,a@b.cd"]
    rows = {r.doc_id: r for r in pii.report(docs_of(texts)).collect()}
    for i, t in enumerate(texts):
        spans = brute(t or "")
        assert [rows[i][f"n_{k}"] for k in pii.BASE_KINDS] == [sum(s[0] == k for s in spans) for k in pii.BASE_KINDS]
        assert rows[i].base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in spans).encode()).hexdigest()
        assert len(rows[i].spans.split(",")) == len(rows[i].scores.split(","))
    df = docs_of([*texts, texts[2]])
    out = {r[0]: (r[1], r[5]) for r in pii.masked(df.toDF(*[f"c{i}" for i in range(7)]), "c1").collect()}
    assert out[0] == (None, "other") and out[2][0] == "é <EMAIL> é" and out[3][0] == "ip <IP> and <PHONE>" and out[5][0] == "<EMAIL>,<EMAIL>" and out[6][0] == out[2][0]
    assert pii.mask("abcdef", [("ip", 1, 3, 1.0), ("card", 2, 5, 1.0)]) == "a<IP>f"
    assert pii.report(docs_of([])).collect() == []
