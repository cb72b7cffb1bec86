"""Personal data: regular expressions propose spans, checksums confirm them, words nearby adjust the score.

Email addresses, IPv4 addresses, payment cards (Luhn) and international phone numbers are always reported. IBANs (mod 97)
need their checksum; social security numbers and national phone numbers are digits like any other and count only where
a word nearby says so. Positions are code points, ends exclusive; matches of one kind do not overlap.

Every search is linear in the text, whatever it holds: runs are entered at their start only, and quantifiers that could
try a run's every length are possessive.

Defined results: a NULL or empty text has no spans. Repeated rows get equal spans; an empty table gives an empty result.
Spans of different kinds may overlap; they are sorted by start, then by the order of KINDS. Other columns are ignored.
"""
from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frames import Spans, add_columns, documents, fields, map_pieces, table

BASE_KINDS = ["email", "ip", "card", "phone"]
KINDS = [*BASE_KINDS, "iban", "ssn", "local_phone"]
NEARBY = 48                 # code points before a span in which context words count
LEAST = 0.6                 # score that a kind beyond the base needs

#: Start scores, and the words before a span that raise or lower them.
START = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.7, "iban": 0.9, "ssn": 0.3, "local_phone": 0.3}
RAISE = {
    "email": r"e-?mail|contact|write|kontakt|correo|courriel",
    "ip": r"\bip\b|address|server|host|login|adresse|direcci[oó]n",
    "card": r"card|visa|mastercard|amex|credit|debit|karte|carte|tarjeta",
    "phone": r"phone|call|tel|mobile|fax|whatsapp|telefon|t[ée]l[ée]phone|tel[ée]fono",
    "iban": r"iban|account|bank|konto|compte|cuenta",
    "ssn": r"\bssn\b|social security|social insurance",
    "local_phone": r"phone|call|\btel|mobile|cell|fax|whatsapp",
}
LOWER = {"ip": r"version|release|section|chapter|build|\bv$", "card": r"order|invoice|serial|isbn|tracking", "ssn": r"part|order|serial|invoice",
         "local_phone": r"order|invoice|serial|isbn"}
#: How long an IBAN of a country is.
IBAN_LENGTH = {"AT": 20, "BE": 16, "BG": 22, "CH": 21, "CZ": 24, "DE": 22, "DK": 18, "EE": 20, "ES": 24, "FI": 18, "FR": 27, "GB": 22, "GR": 27, "HR": 21,
               "HU": 28, "IE": 22, "IT": 27, "LT": 20, "LU": 20, "LV": 21, "NL": 18, "NO": 15, "PL": 28, "PT": 25, "RO": 24, "SE": 24, "SI": 19, "SK": 24, "TR": 26}

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_DOTTED = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3,}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}")
_SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
_LOCAL_PHONE = re.compile(r"(?<![0-9+.-])(?:\([0-9]{3}\) ?|[0-9]{3}[-. ])[0-9]{3}[-. ][0-9]{4}(?![0-9.-])")
_RAISE = {k: re.compile(v, re.I) for k, v in RAISE.items()}
_LOWER = {k: re.compile(v, re.I) for k, v in LOWER.items()}


def luhn(digits: str) -> bool:
    values = [int(d) for d in reversed(digits)]
    return (sum(values[::2]) + sum(sum(divmod(2 * v, 10)) for v in values[1::2])) % 10 == 0


def mod97(iban: str) -> bool:
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1


def _emails(text: str):
    floor, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > floor and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            yield start, found.end()
        floor = found.end() if found else at + 1
        at = text.find("@", at + 1)


def _ips(text: str):
    for run in _DOTTED.finditer(text):
        start, parts = run.start(), run.group().split(".")
        for k in range(0, len(parts) - 3, 4):           # a run of more parts is cut into fours from the left
            four = parts[k:k + 4]
            end = start + sum(map(len, four)) + 3
            if all(len(p.lstrip("0")) <= 3 and int(p[-3:]) <= 255 for p in four):
                yield start, end
            start = end + 1


def _cards(text: str):
    for m in _CARD.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "")
        if 12 <= len(digits) <= 19 and luhn(digits):
            yield m.span()


def _phones(text: str):
    for m in _PHONE.finditer(text):
        if 9 <= sum(c.isdigit() for c in m.group()) <= 15:
            yield m.span()


def _ibans(text: str):
    for m in _IBAN.finditer(text):
        size, taken, end = IBAN_LENGTH.get(m.group()[:2], 0), [], m.start()
        for c in m.group():
            if len(taken) == size:
                break
            end += 1
            if c != " ":
                taken.append(c)
        if size and len(taken) == size and not text[end:end + 1].isalnum() and mod97("".join(taken)):
            yield m.start(), end


def _ssns(text: str):
    for m in _SSN.finditer(text):
        area, group, serial = m.group().split("-")
        if area not in ("000", "666") and area < "900" and group != "00" and serial != "0000":
            yield m.span()


_FINDERS = {"email": _emails, "ip": _ips, "card": _cards, "phone": _phones, "iban": _ibans, "ssn": _ssns, "local_phone": lambda text: (m.span() for m in _LOCAL_PHONE.finditer(text))}


def score(kind: str, text: str, start: int) -> float:
    before = text[max(0, start - NEARBY):start]
    value = START[kind] + 0.4 * bool(_RAISE[kind].search(before)) - 0.3 * bool(kind in _LOWER and _LOWER[kind].search(before))
    return min(1.0, max(0.0, round(value, 2)))


def find(text: str) -> list[tuple[str, int, int, float]]:
    """(kind, start, end, score) of every span, by start, then kind."""
    out, taken = [], Spans()
    for order, kind in enumerate(KINDS):
        if order == len(BASE_KINDS):
            taken = Spans((start, end) for start, _, end, _ in out)
        for start, end in _FINDERS[kind](text):
            value = score(kind, text, start)
            if order < len(BASE_KINDS) or (value >= LEAST and taken.add(start, end)):
                out.append((start, order, end, value))
    return [(KINDS[order], start, end, value) for start, order, end, value in sorted(out)]


def mask(text: str, spans: list[tuple[str, int, int, float]]) -> str:
    """`text` with each span, or union of overlapping spans, replaced by the kind of its first one, as in <EMAIL>."""
    out, at, end = [], 0, -1
    for kind, start, stop, _ in spans:
        if start >= end:
            out += [text[at:start], f"<{kind.upper()}>"]
        end = at = max(end, stop)
    return "".join(out) + text[at:]


def _written(spans) -> str:
    return ",".join(f"{kind}:{start}:{end}" for kind, start, end, *_ in spans)


def _report(piece: pa.RecordBatch) -> dict:
    found = [find(t or "") for t in piece.column("text").to_pylist()]
    base = [[s for s in spans if s[0] in BASE_KINDS] for spans in found]
    return {"doc_id": piece.column("doc_id"), **{f"n_{k}": [sum(s[0] == k for s in spans) for spans in base] for k in BASE_KINDS},
            "base_sha256": [hashlib.sha256(_written(spans).encode()).hexdigest() for spans in base], "spans": [_written(spans) for spans in found],
            "scores": [",".join(f"{s[3]:.2f}" for s in spans) for spans in found]}


def report(docs: DataFrame) -> DataFrame:
    """One row a document: how many spans of each base kind, their digest, all spans and their scores. One pass, no shuffle."""
    return map_pieces(documents(docs), "text", _report, fields("doc_id:bigint", *[f"n_{k}:bigint" for k in BASE_KINDS], "base_sha256:string", "spans:string", "scores:string"))


def masked(df: DataFrame, text: str = "text") -> DataFrame:
    """`df` with its text masked in place; NULL stays NULL."""
    def run(column: pa.Array) -> dict:
        return {"__masked": [None if t is None else mask(t, spans) if (spans := find(t)) else t for t in column.to_pylist()]}
    out = add_columns(df, text, run, fields("__masked:string"))
    at = df.columns.index(text)
    plain = out.toDF(*[f"c{i}" for i in range(len(out.columns))])
    return plain.select(*[F.col(f"c{len(df.columns) if i == at else i}").alias(c) for i, c in enumerate(df.columns)])


def op4_pii(spark, folder: str) -> DataFrame:
    return report(table(spark, folder, "documents"))
