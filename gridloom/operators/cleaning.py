"""Text cleaner: fixed rules in a fixed order, as one chain of expressions per column."""
from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.cells import SPACE, TableError, col, collapse, is_text, require_columns, strip, type_of
from .result import Result

# Fixed value: text that reads as a number is left alone.
NUMBER_TEXT = r"^\s*[-+]?(\d[\d,]*(\.\d*)?|\.\d+)([eE][-+]?\d+)?\s*%?\s*$"
RULES = ("nonprinting", "trim", "collapse", "accents", "punctuation")
CASES = ("keep", "lower", "upper", "title", "sentence")


@F.pandas_udf(T.StringType())
def _without_accents(texts: pd.Series) -> pd.Series:
    """Decompose characters and drop the combining marks; Spark has no built-in for Unicode normal forms."""
    return texts.map(lambda t: None if t is None else
                     "".join(ch for ch in unicodedata.normalize("NFKD", t) if not unicodedata.combining(ch)))


def remove_nonprinting(c: Column) -> Column:
    return F.regexp_replace(c, r"[\p{Cc}\p{Cf}&&[^\t\n\r]]", "")


def remove_accents(c: Column) -> Column:
    """Only text beyond ASCII is sent to Python."""
    beyond = F.when(c.rlike(r"[^\x00-\x7F]"), c)
    return F.coalesce(_without_accents(beyond), c)


def remove_punctuation(c: Column) -> Column:
    return F.regexp_replace(c, rf"(?U)[^\p{{L}}\p{{N}}_{SPACE}]", "")


def title_case(c: Column) -> Column:
    """A capital after anything that is not a letter: O'Neil, X-Ray."""
    words = F.regexp_extract_all(F.lower(c), F.lit(r"(\p{L}+|\P{L}+)"), F.lit(1))
    return F.array_join(F.transform(words, lambda w: F.concat(F.upper(F.left(w, F.lit(1))), F.substring(w, F.lit(2), F.length(w)))), "")


def sentence_case(c: Column) -> Column:
    """Lower case, but for the first letter."""
    lowered = F.lower(c)
    lead = F.regexp_extract(lowered, r"^(\P{L}*)", 1)
    at = F.length(lead) + 1
    return F.concat(lead, F.upper(F.substring(lowered, at, F.lit(1))), F.substring(lowered, at + 1, F.length(lowered)))


_STEPS = {"nonprinting": remove_nonprinting, "trim": strip, "collapse": collapse, "accents": remove_accents,
          "punctuation": remove_punctuation}
_CASE_STEPS = {"lower": F.lower, "upper": F.upper, "title": title_case, "sentence": sentence_case}


def clean_text(df: DataFrame, columns: list[str], rules=("nonprinting", "trim", "collapse"), case: str = "keep") -> Result:
    """Clean the text of some columns. Metrics: cells changed, and changes per rule."""
    require_columns(df, columns)
    if not columns:
        raise TableError("choose at least one column to clean")
    if set(rules) - set(RULES) or case not in CASES:
        raise TableError(f"rules are {RULES}, cases are {CASES}")
    steps = [(rule, _STEPS[rule]) for rule in RULES if rule in rules]
    if case != "keep":
        steps.append(("case", _CASE_STEPS[case]))
    if not steps:
        raise TableError("choose at least one thing to clean")

    applies = {n: ~F.coalesce(col(n).rlike(NUMBER_TEXT), F.lit(True)) for n in columns if is_text(type_of(df, n))}

    def cleaned(n: str, upto: int) -> Column:
        c = col(n)
        for _, step in steps[:upto]:
            c = step(c)
        return c

    out = df.select(*[F.when(applies[n], cleaned(n, len(steps))).otherwise(col(n)).alias(n) if n in applies else col(n)
                      for n in df.columns])
    return Result(out, metrics=_changes(df, list(applies), applies, steps))


def _changes(df: DataFrame, columns, applies, steps) -> DataFrame:
    """One row: cells changed and changes per rule. Each rule's text is a column of its own, computed once."""
    staged = df.select(*[F.when(applies[n], col(n)).alias(f"c{i}_0") for i, n in enumerate(columns)])
    for k, (_, step) in enumerate(steps, 1):
        staged = staged.select("*", *[step(F.col(f"c{i}_{k - 1}")).alias(f"c{i}_{k}") for i in range(len(columns))])
    last = len(steps)

    def changed(before: int, after: int) -> Column:
        total = F.lit(0).cast("bigint")
        for i in range(len(columns)):
            total = total + F.coalesce(F.sum((F.col(f"c{i}_{before}") != F.col(f"c{i}_{after}")).cast("bigint")), F.lit(0))
        return total

    return staged.agg(changed(0, last).alias("cells_changed"),
                      *[changed(k - 1, k).alias(f"{name}_changed") for k, (name, _) in enumerate(steps, 1)])
