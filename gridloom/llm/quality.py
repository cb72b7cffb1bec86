"""Quality rules as a bitmask ledger.

Every rule is evaluated once per document. The ledger keeps the measurements and one bit for each rule that failed; a
policy is a named, versioned set of rules, applied to the bits alone. Changing a policy, or asking what each rule costs,
therefore needs no second look at the texts: ablations are sums of bit operations.

Defined results: a NULL or empty text has no words, so it fails the rule on few words. Ties do not occur. Repeated rows
get equal ledgers, an empty table gives an empty ledger, and other columns of the input are not looked at.
"""
from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import words
from .frames import add_columns, fields, pick

WINDOW = 8
SYMBOLS = np.zeros(256, np.int64)
SYMBOLS[[ord(c) for c in "#*$%&|<>"]] = 1
MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_echo_words"]


@dataclass(frozen=True)
class Rule:
    name: str
    bit: int
    fails: Column


def rules() -> list[Rule]:
    """The order is fixed: a bit never changes its meaning, new rules get new bits."""
    n, c = F.col, F.col("n_words")
    return [Rule(name, 1 << i, fails) for i, (name, fails) in enumerate([
        ("few_words", c < 20),
        ("repeated_words", 100 * n("n_repeat_words") > 30 * c),
        ("many_symbols", 100 * n("n_symbols") > 10 * c),
        ("repeated_lines", 100 * n("n_dup_lines") > 60 * n("n_lines")),
        ("short_words", n("word_chars") < 2 * c),
        ("long_words", n("word_chars") > 25 * c),
        ("echoed_words", 100 * n("n_echo_words") > 30 * c),
    ])]


#: Policies by version. "base" is the least any policy asks for.
POLICIES = {
    "base": ["few_words", "repeated_words"],
    "v1": ["few_words", "repeated_words", "many_symbols", "repeated_lines", "short_words", "long_words", "echoed_words"],
}


def policy_mask(policy: str) -> int:
    chosen = set(POLICIES[policy])
    return sum(r.bit for r in rules() if r.name in chosen)


def measure(texts: pa.Array) -> dict[str, np.ndarray]:
    """The measurements of each text."""
    w = words.find_words(texts)
    per_doc = lambda flags: np.diff(np.concatenate([[0], np.cumsum(flags)])[w.bounds])                  # noqa: E731
    ink = ~words.SPACE[w.data]
    counts = w.counts()

    breaks = np.flatnonzero(w.data == 10)
    line_start = np.sort(np.concatenate([w.bounds[:-1], breaks + 1]), kind="stable")
    line_doc = np.sort(np.concatenate([np.arange(w.n_docs), np.searchsorted(w.bounds, breaks, "right") - 1]), kind="stable")
    line_end = np.minimum(np.concatenate([line_start[1:] - 1, [len(w.data)]]), w.bounds[line_doc + 1]) if w.n_docs else line_start
    last = np.concatenate([line_doc[1:] != line_doc[:-1], [True]]) if w.n_docs else np.zeros(0, bool)
    line_end = np.where(last, w.bounds[line_doc + 1], line_end)                                         # no break closes a text's last line
    inked = np.concatenate([[0], np.cumsum(ink)])
    full = inked[line_end] > inked[line_start]
    line_start, line_end, line_doc = line_start[full], line_end[full], line_doc[full]
    key = words.mix(words.span_hashes(w.data, line_start, line_end) + words.mix(line_doc.astype(np.uint64)))
    n_lines = np.bincount(line_doc, minlength=w.n_docs)
    distinct = np.bincount(line_doc[np.unique(key, return_index=True)[1]], minlength=w.n_docs)

    repeated = np.zeros(len(w.start) + 1, np.int64)
    hashes = w.hashes()
    echo = w.doc[1:][(hashes[1:] == hashes[:-1]) & (w.doc[1:] == w.doc[:-1])]
    grams, at = words.ngrams(hashes, w.doc, WINDOW)
    if len(grams):
        keys = grams + words.mix(w.doc[at].astype(np.uint64))
        order = np.argsort(keys)
        same = keys[order][1:] == keys[order][:-1]
        twice = np.zeros(len(grams), bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        np.add.at(repeated, at[twice], 1)
        np.add.at(repeated, at[twice] + WINDOW, -1)
    covered = np.cumsum(repeated)[:-1] > 0
    return {"n_words": counts, "word_chars": per_doc(ink & ((w.data & 0xC0) != 0x80)), "n_symbols": per_doc(SYMBOLS[w.data]),
            "n_dup_lines": n_lines - distinct, "n_repeat_words": np.bincount(w.doc[covered], minlength=w.n_docs), "n_lines": n_lines,
            "n_echo_words": np.bincount(echo, minlength=w.n_docs)}


def ledger(df: DataFrame, text: str = "text") -> DataFrame:
    """`df` with the measurements and `failed`, the bits of the rules that failed. One pass, no shuffle."""
    out = add_columns(df, text, measure, fields(*[f"{m}:bigint" for m in MEASURES]))
    bits = F.lit(0).cast("bigint")
    for r in rules():
        bits = bits.bitwiseOR(F.when(r.fails, F.lit(r.bit)).otherwise(F.lit(0)).cast("bigint"))
    return out.withColumn("failed", bits)


def passes(policy: str) -> Column:
    """True where no rule of the policy failed."""
    return F.col("failed").bitwiseAND(F.lit(policy_mask(policy))) == 0


def ablations(book: DataFrame, policy: str) -> DataFrame:
    """For each rule of the policy: how many rows fail it, and how many fail it alone, so would be kept without it.

    One aggregate over the ledger; partial sums combine before the shuffle."""
    mask = policy_mask(policy)
    hit = F.col("failed").bitwiseAND(F.lit(mask))
    chosen = [r for r in rules() if r.bit & mask]
    sums = book.agg(*[F.coalesce(F.sum((hit.bitwiseAND(F.lit(r.bit)) != 0).cast("bigint")), F.lit(0)).alias(f"f{r.bit}") for r in chosen],
                    *[F.coalesce(F.sum((hit == r.bit).cast("bigint")), F.lit(0)).alias(f"a{r.bit}") for r in chosen], F.count("*").alias("n"))
    each = F.array(*[F.struct(F.lit(r.name).alias("rule"), F.col(f"f{r.bit}").alias("failed"), F.col(f"a{r.bit}").alias("failed_alone"), F.col("n").alias("rows"))
                     for r in chosen])
    return sums.select(F.explode(each).alias("x")).select("x.*")


def op5_quality_rules(spark, folder: str) -> DataFrame:
    docs = pick(spark.read.parquet(f"{folder}/documents.parquet"), doc_id="doc_id:bigint", text="text:string")
    book = ledger(docs)
    return book.select("doc_id", *MEASURES[:5], (~passes("base")).alias("base_failed"), passes("v1").alias("kept"), "failed", F.lit("v1").alias("policy"))


#: The same in SQL: words with their number, lines with theirs, windows of words by their text.
OP5_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
word AS (SELECT doc_id, generate_subscripts(w, 1) AS i, unnest(w) AS x, w FROM d),
gram AS (SELECT doc_id, i, array_to_string(w[i:i + 7], ' ') AS g FROM word WHERE i + 7 <= len(w)),
twice AS (SELECT doc_id, i FROM gram QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
covered AS (SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words FROM twice, (SELECT unnest(range(8)) AS k) GROUP BY doc_id),
echo AS (SELECT doc_id, count(*) FILTER (x = before) AS n_echo_words, sum(length(x)) AS word_chars
         FROM (SELECT doc_id, x, lag(x) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM word) GROUP BY doc_id),
line AS (SELECT doc_id, l FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l FROM d) WHERE regexp_matches(l, '[^\x20\x09-\x0D]')),
lines AS (SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT l) AS n_dup_lines FROM line GROUP BY doc_id),
m AS (SELECT doc_id, len(w) AS n_words, coalesce(word_chars, 0) AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
             coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(n_lines, 0) AS n_lines, coalesce(n_echo_words, 0) AS n_echo_words
      FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN echo USING (doc_id) LEFT JOIN lines USING (doc_id)),
f AS (SELECT *, CASE WHEN n_words < 20 THEN 1 ELSE 0 END + CASE WHEN 100 * n_repeat_words > 30 * n_words THEN 2 ELSE 0 END + CASE WHEN 100 * n_symbols > 10 * n_words THEN 4 ELSE 0 END
             + CASE WHEN 100 * n_dup_lines > 60 * n_lines THEN 8 ELSE 0 END + CASE WHEN word_chars < 2 * n_words THEN 16 ELSE 0 END
             + CASE WHEN word_chars > 25 * n_words THEN 32 ELSE 0 END + CASE WHEN 100 * n_echo_words > 30 * n_words THEN 64 ELSE 0 END AS failed FROM m)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines,
    CAST(n_repeat_words AS BIGINT) AS n_repeat_words, failed & 3 <> 0 AS base_failed, failed = 0 AS kept, CAST(failed AS BIGINT) AS failed, 'v1' AS policy FROM f
"""
