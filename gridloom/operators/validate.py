"""Rule-based validation: one flag per rule, one pass over the table, no shuffle."""
from __future__ import annotations

import functools
import operator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import patterns
from ..functions.cells import TableError, col, free_name, plain_number, strip, text_of, type_of
from ..plans.order import dense_index, file_order, tie_names
from .result import Result

RULES = ("required", "numeric", "range", "list", "pattern", "length")
HEADER_ROWS = 2                 # the first data row is row 2 of a sheet with a header


def _bound(raw, cast, name: str, where: str):
    if raw in (None, ""):
        return None
    try:
        return cast(float(raw))
    except (TypeError, ValueError):
        raise TableError(f"{where}: the {name} {raw!r} is not a number") from None


def _check(df: DataFrame, rule: dict, number: int) -> tuple[Column, Column] | None:
    """(fails, message) for one rule; None for a rule on an unknown column or of an unknown type, which never fails."""
    name, kind, value = rule.get("column"), rule.get("type"), rule.get("value")
    if name not in df.columns or kind not in RULES:
        return None
    dtype = type_of(df, name)
    text = text_of(df, name)
    there = F.coalesce(strip(text) != "", F.lit(False))
    where = f"rule {number} ({name})"
    say = lambda *parts: F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in (f"{name}: ", *parts)])
    if kind == "required":
        return ~there, say("a value is needed")
    number_value = plain_number(col(name), dtype)
    if kind == "numeric":
        return there & number_value.isNull(), say("\"", text, "\" is no number")
    if kind == "range":
        low = _bound((value or {}).get("min"), float, "minimum", where)
        high = _bound((value or {}).get("max"), float, "maximum", where)
        too_low = number_value < low if low is not None else F.lit(False)
        too_high = number_value > high if high is not None else F.lit(False)
        message = F.when(number_value.isNull(), say("\"", text, "\" is no number, so it lies in no range"))
        if low is not None:
            message = message.when(too_low, say(text, f" is less than {value['min']}"))
        if high is not None:
            message = message.otherwise(say(text, f" is more than {value['max']}"))
        return there & (number_value.isNull() | F.coalesce(too_low | too_high, F.lit(False))), message
    if kind == "list":
        allowed = [str(v) for v in (value if isinstance(value, list) else [value])]
        return there & ~text.isin(allowed), say("\"", text, "\" is none of the values listed")
    if kind == "pattern":
        return there & ~text.rlike(patterns.whole(patterns.pattern(value))), say("\"", text, "\" does not fit the pattern")
    low = _bound((value or {}).get("min"), int, "minimum length", where)
    high = _bound((value or {}).get("max"), int, "maximum length", where)
    length = F.length(text)
    outside = functools.reduce(operator.or_, ([length < low] if low is not None else []) + ([length > high] if high is not None else [F.lit(False)]))
    return there & outside, say(length.cast("string"), " characters are too few or too many")


def validate(df: DataFrame, rules: list[dict], row_numbers: bool = False, order_by=None) -> Result:
    """Check {column, type, value} rules. `df` holds every row with `errors`, the messages of the rules it breaks.

    `side("invalid")` and `side("valid")` split it; `row_numbers` adds `row_number` (2 for the first row), which numbers
    the whole table. Metrics: total, valid and invalid rows, error rate and rule failures."""
    checks = [c for i, rule in enumerate(rules, 1) if (c := _check(df, rule, i)) is not None]
    source = df
    number_name = free_name("row_number", df.columns)
    if row_numbers:
        source = dense_index(df, file_order(df, order_by), number_name, start=HEADER_ROWS, ties=tie_names(df, order_by), ascending=True)
    errors_name = free_name("errors", df.columns)
    found = F.array(*[F.when(fails, message) for fails, message in checks]) if checks else F.array().cast("array<string>")
    checked = source.select("*", F.array_compact(found).alias(errors_name))
    bad = F.size(col(errors_name)) > 0
    flags = df.select(F.array(*[fails for fails, _ in checks]).alias("f") if checks else F.array(F.lit(False)).alias("f"))
    failures = F.size(F.filter("f", lambda x: x))
    metrics = flags.select(failures.alias("n")).agg(
        F.count(F.lit(1)).alias("total_rows"), F.count_if(F.col("n") == 0).alias("valid_rows"), F.count_if(F.col("n") > 0).alias("invalid_rows"),
        F.coalesce(F.round(F.try_divide(F.count_if(F.col("n") > 0) * 100.0, F.count(F.lit(1))), 2), F.lit(0.0)).cast("double").alias("error_rate"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("rule_failures"))
    return Result(checked, {"invalid": checked.filter(bad), "valid": checked.filter(~bad).drop(errors_name)}, metrics)
