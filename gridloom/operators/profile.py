"""Column profile: counts, statistics, outliers, frequent values, lengths, date ranges and semantic types.

Every function returns one row per column (or per value) in long form, so the result does not widen with the table.
"""
from __future__ import annotations

import functools
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.cells import (MONTHS, TableError, col, date_order, is_missing, is_number, is_text, is_time,
                               number_of, plain_number, require_columns, strip, text_of, type_of, written_date)
from ..plans.order import file_order, order_value
from ..plans.quantiles import exact_quantiles
from ..plans.values import long_cells, unique_counts, value_counts
from ..session import written
from .dedupe import exact_copies

TOP_VALUES = 10


def infer_types(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """A copy where a text column whose filled cells are all numbers is bigint or double. One pass, then a projection.

    `columns` are those that may change, all when None."""
    texts = [n for n in columns or df.columns if is_text(type_of(df, n))]
    if not texts:
        return df
    seen = df.agg(*[e for i, n in enumerate(texts) for e in (
        F.count(col(n)).alias(f"cells{i}"), F.count(number_of(df, n)).alias(f"numbers{i}"),
        F.count(F.when(col(n).rlike(r"^\s*[-+]?\d+\s*$"), col(n).try_cast("bigint"))).alias(f"whole{i}"))]).first()
    out = []
    for n in df.columns:
        i = texts.index(n) if n in texts else None
        if i is None or not seen[f"cells{i}"] or seen[f"cells{i}"] != seen[f"numbers{i}"]:
            out.append(col(n))
        else:
            whole = seen[f"whole{i}"] == seen[f"cells{i}"]
            out.append((F.trim(col(n)).try_cast("bigint") if whole else number_of(df, n)).alias(n))
    return df.select(*out)


def profile_columns(df: DataFrame, counts: DataFrame | None = None, approximate: bool = False) -> DataFrame:
    """column, type, non_null, null_count, null_percentage, unique_count (missing values left out).

    Distinct values are counted column by column (from the value-count table if given), or sketched in one pass when
    `approximate`."""
    names = list(df.columns)
    there = [~is_missing(col(n), type_of(df, n)) for n in names]
    aggregates = [F.count(F.lit(1)).alias("rows")] + [F.count_if(t).alias(f"n{i}") for i, t in enumerate(there)]
    if approximate:
        aggregates += [F.approx_count_distinct(text_of(df, n)).alias(f"u{i}") for i, n in enumerate(names)]
    one = df.agg(*aggregates)
    basics = one.select(F.explode(F.array(*[F.struct(
        F.lit(i).alias("place"), F.lit(n).alias("column"), F.lit(type_of(df, n).simpleString()).alias("type"), F.col(f"n{i}").alias("non_null"),
        (F.col("rows") - F.col(f"n{i}")).alias("null_count"),
        F.round(F.try_divide((F.col("rows") - F.col(f"n{i}")) * 100.0, F.col("rows")), 2).alias("null_percentage"),
        (F.col(f"u{i}") if approximate else F.lit(None).cast("bigint")).alias("unique_count")) for i, n in enumerate(names)])).alias("p")).select("p.*")
    if approximate:
        return basics.drop("place")
    if counts is None:
        unique = unique_counts(df, names).withColumnRenamed("unique", "__unique")
    else:
        unique = counts.groupBy("column").agg(F.count(F.lit(1)).alias("__unique"))
    return basics.drop("unique_count").join(unique, "column", "left") \
        .select("column", "type", "non_null", "null_count", "null_percentage", F.coalesce("__unique", F.lit(0)).alias("unique_count"))


def _numeric(df: DataFrame, columns) -> list[str]:
    names = [n for n in (columns or df.columns) if is_number(type_of(df, n))]
    if not names:
        raise TableError("there is no numeric column")
    return names


def profile_numeric(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """column, mean, median, std, min, max, q25, q50, q75, skew, kurtosis and IQR outliers (count and % of all rows).

    Skew and kurtosis are corrected for sample size and need 3 and 4 values."""
    names = _numeric(df, columns)
    values = {n: plain_number(col(n), type_of(df, n)) for n in names}
    quartiles = exact_quantiles(df, values, [0.25, 0.5, 0.75])
    aggregates = [F.count(F.lit(1)).alias("rows")]
    for i, n in enumerate(names):
        v = values[n]
        q = quartiles[n]
        outlier = F.lit(False)
        if q[0.25] is not None:
            reach = 1.5 * (q[0.75] - q[0.25])
            outlier = (v < F.lit(q[0.25] - reach)) | (v > F.lit(q[0.75] + reach))
        aggregates += [F.count(v).alias(f"n{i}"), F.avg(v).alias(f"mean{i}"), F.stddev_samp(v).alias(f"std{i}"), F.min(v).alias(f"min{i}"),
                       F.max(v).alias(f"max{i}"), F.skewness(v).alias(f"skew{i}"), F.kurtosis(v).alias(f"kurt{i}"), F.count_if(outlier).alias(f"out{i}")]

    def row(i: int, name: str) -> Column:
        n, std = F.col(f"n{i}").cast("double"), F.col(f"std{i}")
        flat = std == 0
        skew = F.when(n >= 3, F.when(flat, 0.0).otherwise(F.col(f"skew{i}") * F.try_divide(F.sqrt(n * (n - 1)), n - 2)))
        kurtosis = F.when(n >= 4, F.when(flat, 0.0).otherwise(
            F.try_divide(n - 1, (n - 2) * (n - 3)) * ((n + 1) * F.col(f"kurt{i}") + 6)))
        q = {p: F.lit(quartiles[name][p]).cast("double") for p in (0.25, 0.5, 0.75)}
        return F.struct(F.lit(name).alias("column"), F.col(f"mean{i}").alias("mean"), q[0.5].alias("median"), std.alias("std"),
                        F.col(f"min{i}").alias("min"), F.col(f"max{i}").alias("max"), q[0.25].alias("q25"), q[0.5].alias("q50"),
                        q[0.75].alias("q75"), skew.alias("skew"), kurtosis.alias("kurtosis"), F.col(f"out{i}").alias("outliers"),
                        F.round(F.try_divide(F.col(f"out{i}") * 100.0, F.col("rows")), 2).alias("outlier_percentage"))
    return df.agg(*aggregates).select(F.explode(F.array(*[row(i, n) for i, n in enumerate(names)])).alias("p")).select("p.*")


def top_values(df: DataFrame, columns: list[str] | None = None, order_by=None, counts: DataFrame | None = None) -> DataFrame:
    """column, value, count, rank: the most frequent values, equal counts by first appearance.

    `row_number() <= 10` is applied to each task's share before the shuffle, so a column with many values stays small."""
    columns = columns or [n for n in df.columns if is_text(type_of(df, n))]
    counts = counts if counts is not None else value_counts(df, columns, order_by)
    window = W.partitionBy("column").orderBy(F.desc("n"), F.asc("at"), F.asc("value"))
    return counts.filter(F.col("column").isin(columns)).withColumn("rank", F.row_number().over(window)) \
        .filter(F.col("rank") <= TOP_VALUES).select("column", "value", F.col("n").alias("count"), "rank")


def text_lengths(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """column, mean_length, min_length, max_length, median_length of text."""
    columns = columns or [n for n in df.columns if is_text(type_of(df, n))]
    lengths = {n: F.length(text_of(df, n)) for n in columns}
    median = exact_quantiles(df, lengths, [0.5])
    one = df.agg(*[e for i, n in enumerate(columns) for e in (
        F.avg(lengths[n]).alias(f"mean{i}"), F.min(lengths[n]).alias(f"min{i}"), F.max(lengths[n]).alias(f"max{i}"))])
    return one.select(F.explode(F.array(*[F.struct(
        F.lit(n).alias("column"), F.col(f"mean{i}").alias("mean_length"), F.col(f"min{i}").alias("min_length"),
        F.col(f"max{i}").alias("max_length"), F.lit(median[n][0.5]).cast("double").alias("median_length")) for i, n in enumerate(columns)])).alias("p")).select("p.*")


def date_ranges(df: DataFrame, columns: list[str] | None = None, order: str = "auto") -> DataFrame:
    """column, earliest, latest of date columns (text is read as written dates)."""
    columns = columns or [n for n in df.columns if is_time(type_of(df, n))]
    if not columns:
        raise TableError("there is no date column")

    def when(n: str) -> Column:
        chosen = "YMD" if is_time(type_of(df, n)) else ((date_order(df, n) or "MDY") if order == "auto" else order)
        return written_date(col(n), type_of(df, n), chosen)
    one = df.agg(*[e for i, n in enumerate(columns) for e in (F.min(when(n)).alias(f"a{i}"), F.max(when(n)).alias(f"b{i}"))])
    return one.select(F.explode(F.array(*[F.struct(F.lit(n).alias("column"), F.col(f"a{i}").alias("earliest"), F.col(f"b{i}").alias("latest"))
                                          for i, n in enumerate(columns)])).alias("p")).select("p.*")


def boolean_counts(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """column, value, count for boolean columns."""
    columns = columns or [n for n in df.columns if isinstance(type_of(df, n), T.BooleanType)]
    if not columns:
        raise TableError("there is no boolean column")
    return value_counts(df, columns, first_seen=False).select("column", "value", F.col("n").alias("count"))


# ---- semantic types -------------------------------------------------------------------------------------------------
# Formats, patterns, words and the order of precedence that define the semantic types.
DATE_FORMATS = [
    "%Y-%m-%d", "%m/%d/%Y", "%d/%m/%Y", "%Y/%m/%d", "%d-%m-%Y", "%m-%d-%Y", "%Y.%m.%d", "%d.%m.%Y", "%m.%d.%Y",
    "%Y-%m-%d %H:%M:%S", "%m/%d/%Y %H:%M:%S", "%Y-%m-%dT%H:%M:%S", "%d %b %Y", "%d %B %Y", "%b %d, %Y", "%B %d, %Y",
]
PATTERNS = {
    "Email": [r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}"],
    "URL": [r"https?://[^\s/$.?#].[^\s]*", r"www\.[^\s/$.?#].[^\s]*"],
    "IPv4": [r"(?:\d{1,3}\.){3}\d{1,3}"],
    "IPv6": [r"(?:[0-9a-fA-F]{1,4}:){7}[0-9a-fA-F]{1,4}", r"::1", r"::"],
    "UUID": [r"(?i)[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}"],
    "SSN": [r"\d{3}-\d{2}-\d{4}"],
    "Card": [r"\d{4}[\s-]?\d{4}[\s-]?\d{4}[\s-]?\d{4}"],
    "Phone Number": [r"\+?1?[-.\s]?\(?\d{3}\)?[-.\s]?\d{3}[-.\s]?\d{4}", r"\+\d{1,3}[-.\s]?\d{1,4}[-.\s]?\d{6,12}"],
    "Currency": [r"[$€£¥]\s?[\d,]+(?:\.\d+)?", r"[\d,]+(?:\.\d+)?\s?(?:USD|EUR|GBP|JPY|CAD|AUD)", r"(?:USD|EUR|GBP|JPY|CAD|AUD)"],
    "Percentage": [r"\d+(?:\.\d+)?\s?%"],
    "Postal Code": [r"\d{5}(?:-\d{4})?", r"[A-Z]{1,2}\d[A-Z\d]?\s?\d[A-Z]{2}", r"[A-Z]\d[A-Z]\s?\d[A-Z]\d"],
    "ID/Serial": [r"[A-Z]{2,}-?\d+", r"[A-Z]+\d+", r"\d+"],
    "Boolean words": [r"(?i)(?:true|false|yes|no|y|n|on|off)"],
}
CURRENCY_MARKS = ["$", "€", "£", "¥", "USD", "EUR", "GBP", "JPY", "CAD", "AUD"]
PERCENT_NAME = r"pct|percent|%|rate|ratio|share|fraction|proportion"
_TEXT_SCORES = ["words", "words_or_digits", "Date", "Email", "URL", "UUID", "SSN", "Phone Number", "Currency", "Percentage", "Postal Code", "ID/Serial", "IP Address", "v4", "v6",
                "Credit Card", *[f"date{i}" for i in range(len(DATE_FORMATS))]]
PRIORITY = ["Boolean", "Date", "Email", "URL", "IP Address", "UUID", "SSN", "Credit Card", "Phone Number", "Currency",
            "Percentage", "Postal Code", "ID/Serial"]
THRESHOLD = 80.0


def _may_match(text: Column) -> dict[str, Column]:
    """What a text must show to fit a pattern at all: cheap tests that spare most texts the patterns."""
    size, first, last = F.length(text), F.left(text, F.lit(1)), F.right(text, F.lit(1))
    digit_last = last.between("0", "9")
    return {"Email": F.contains(text, F.lit("@")), "URL": F.startswith(text, F.lit("http")) | F.startswith(text, F.lit("www.")), "IPv4": size.between(7, 15) & digit_last,
            "IPv6": F.contains(text, F.lit(":")), "UUID": size == 36, "SSN": size == 11, "Card": size.between(16, 19) & digit_last, "Phone Number": size.between(9, 24) & digit_last,
            "Currency": first.isin(*[m for m in CURRENCY_MARKS if len(m) == 1]) | F.right(text, F.lit(3)).isin(*[m for m in CURRENCY_MARKS if len(m) == 3]), "Percentage": last == "%",
            "Postal Code": size.between(5, 10), "ID/Serial": digit_last, "Boolean words": size <= 5}


def _full_matches(text: Column) -> list[Column]:
    """For each of PATTERNS: does the whole text fit it?"""
    may = _may_match(text)
    return [(may[n] & text.rlike("^(?:" + "|".join(f"(?:{p})" for p in PATTERNS[n]) + r")\z")).alias(n) for n in PATTERNS]


_NUMERIC_SHAPE = r"^(\d{1,4})([-/.])(\d{1,2})([-/.])(\d{1,4})(?:(T|\s+)(\d{1,2}):(\d{1,2}):(\d{1,2}))?\z"
_DATE_START = r"^(?:\d{1,4}[-/.]\d|\d{1,2}\s+[A-Za-z]|[A-Za-z]{3,9}\s+\d)"
_NAMED_SHAPES = (r"^(\d{1,2})\s+([A-Za-z]+)\s+(\d{4})\z", r"^([A-Za-z]+)\s+(\d{1,2}),\s+(\d{4})\z")


def _date_parts(text: Column) -> Column:
    """The pieces of a written date, each taken once."""
    part = lambda i: F.regexp_extract(text, _NUMERIC_SHAPE, i)                                      # noqa: E731
    day_first, name_first = (F.regexp_extract(text, p, 0) != "" for p in _NAMED_SHAPES)
    named = lambda i, j: F.when(day_first, F.regexp_extract(text, _NAMED_SHAPES[0], i)).when(name_first, F.regexp_extract(text, _NAMED_SHAPES[1], j)).otherwise("")      # noqa: E731
    return F.struct(part(1).alias("a"), part(2).alias("s1"), part(3).alias("b"), part(4).alias("s2"), part(5).alias("c"), part(6).alias("t"), part(7).alias("H"),
                    part(8).alias("M"), part(9).alias("S"), day_first.alias("day_first"), named(1, 2).alias("day"), F.lower(named(2, 1)).alias("month"), named(3, 3).alias("year"))


def _formats(p: Column) -> list[Column]:
    """For each of DATE_FORMATS: is the text, given by its pieces, a real date in it?"""
    number = lambda c: c.try_cast("int")                                                            # noqa: E731
    clock = [F.coalesce(number(p[x]), F.lit(0)) for x in "HMS"]

    def real(y, m, d):
        return (number(y) >= 1) & F.try_make_timestamp(number(y), m if m is not None else F.lit(None), number(d), *clock).isNotNull()
    position = lambda names: F.array_position(F.array(*[F.lit(x) for x in names]), p["month"]).cast("int")      # noqa: E731
    numeric = {"%Y-%m-%d": real(p["a"], number(p["b"]), p["c"]), "%m/%d/%Y": real(p["c"], number(p["a"]), p["b"]), "%d/%m/%Y": real(p["c"], number(p["b"]), p["a"])}
    named = {"b": real(p["year"], position([m[:3] for m in MONTHS]), p["day"]), "B": real(p["year"], position(MONTHS), p["day"])}
    out = []
    for f in DATE_FORMATS:
        if "%b" in f or "%B" in f:
            out.append((p["day_first"] == F.lit(f.startswith("%d"))) & (p["year"] != "") & named["b" if "%b" in f else "B"])
            continue
        date, mark = f[:8], f[2]
        year, short = ("a", "c") if date.startswith("%Y") else ("c", "a")
        between = "T" if "T" in f else " " if "%H" in f else ""
        timed = p["t"] == "T" if between == "T" else ((p["t"] != "T") & (p["t"] != "")) if between else p["t"] == ""
        out.append((p["s1"] == mark) & (p["s2"] == mark) & (F.length(p[year]) == 4) & (F.length(p[short]) <= 2) & timed & numeric[date.replace(mark, "-" if year == "a" else "/")])
    return out


def first_values(df: DataFrame, columns: list[str], rows: int | None, order_by=None) -> DataFrame:
    """(column, value, at): the first `rows` filled cells of each column in file order, or all of them.

    Ten times as many rows from the head of the table are enough for most columns. A column with too few filled cells
    there gets a top-k of its own over the whole table, so no column is cut short."""
    if rows is None:
        return long_cells(df, columns, order_value(df, order_by)).filter(F.col("value").isNotNull())
    size = 10 * rows
    head = written(df.orderBy(*file_order(df, order_by)).limit(size))
    seen = head.agg(F.count(F.lit(1)).alias("rows"), *[F.count(text_of(head, n)).alias(f"n{i}") for i, n in enumerate(columns)]).first()
    short = [n for i, n in enumerate(columns) if seen.rows == size and seen[f"n{i}"] < rows]
    parts = []
    ready = [n for n in columns if n not in short]
    if ready:
        cells = long_cells(head, ready, order_value(head, order_by)).filter(F.col("value").isNotNull())
        window = W.partitionBy("column").orderBy("at")
        parts.append(cells.withColumn("__nth", F.row_number().over(window)).filter(F.col("__nth") <= rows).drop("__nth"))
    for n in short:
        filled_cells = df.select(F.lit(n).alias("column"), text_of(df, n).alias("value"), order_value(df, order_by).alias("at"))
        parts.append(filled_cells.filter(F.col("value").isNotNull()).orderBy("at").limit(rows))
    return functools.reduce(DataFrame.unionByName, parts)


def _flags(text: Column) -> dict[str, Column]:
    """What a text is, by name: the patterns it fits whole, dates by format, words and numbers."""
    fits = dict(zip(PATTERNS, _full_matches(text)))
    fits["Card"] = fits["Card"] & F.call_function("luhn_check", F.regexp_replace(text, r"\D", ""))
    number = plain_number(text, T.StringType())
    fraction = F.coalesce(number.between(0, 1), F.lit(False))
    return fits | {"digits": text.isin("0", "1"), "fraction": fraction, "fraction_or_sign": fraction | fits["Percentage"]}


def _bits(flags) -> Column:
    """The flags as bits of one whole number, the first lowest."""
    return functools.reduce(Column.bitwiseOR, [F.when(f, F.lit(1 << i)).otherwise(F.lit(0)).cast("bigint") for i, f in enumerate(flags)])


def _text_shares(df: DataFrame, columns: list[str], sample_rows: int | None, order_by) -> DataFrame:
    """Per text column, the share of filled cells that fit each type.

    Every different value is looked at once and told by a few bits; values with the same bits are counted together, so the
    shares come from a table of few rows. Words that can be Boolean are kept apart, as it matters whether there are just two."""
    if sample_rows is None:
        counted = value_counts(df, columns, order_by, first_seen=False)
    else:
        counted = first_values(df, columns, sample_rows, order_by).groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
    t = F.col("text")
    flags = _flags(t)
    place = {n: len(DATE_FORMATS) + i for i, n in enumerate(flags)}
    dated = F.when((F.length(t) <= 40) & t.rlike(_DATE_START) & (t.rlike(_NUMERIC_SHAPE) | t.rlike(_NAMED_SHAPES[0]) | t.rlike(_NAMED_SHAPES[1])), _date_parts(t))
    counted = written(counted.select("column", "n", strip(F.col("value")).alias("text")))      # the tests below are long; Spark plans them anew after every stage before them
    cells = counted.select("*", dated.alias("parts"))
    dates = F.when(F.col("parts").isNotNull(), _bits(_formats(F.col("parts")))).otherwise(F.lit(0).cast("bigint"))
    told = cells.select("column", "n", F.xxhash64(t).alias("h"), _bits(flags.values()).alias("bits"), dates.alias("dates"))
    word = F.when(F.col("bits").bitwiseAND(F.lit(1 << list(flags).index("Boolean words") | 1 << list(flags).index("digits"))) > 0, F.col("h"))
    few = told.groupBy("column", F.col("dates").bitwiseOR(F.shiftleft("bits", len(DATE_FORMATS))).alias("bits"), word.alias("word")).agg(
        F.sum("n").alias("n"), F.count(F.lit(1)).alias("values"), F.min("h").alias("low"), F.max("h").alias("high"))

    total = F.sum("n")
    has = lambda *names: F.col("bits").bitwiseAND(F.lit(sum(1 << place[n] for n in names)).cast("bigint")) > 0                 # noqa: E731
    share = lambda c: F.sum(F.when(c, F.col("n")).otherwise(F.lit(0))) * 100.0 / total                                        # noqa: E731
    others = [f(F.when(F.col("word").isNull(), F.col(c))) for f, c in ((F.min, "low"), (F.max, "high"))]
    return few.groupBy("column").agg(
        total.alias("cells"), F.sum("values").alias("values"),
        (F.count_distinct("word") + F.when(others[0].isNull(), 0).when(others[0] == others[1], 1).otherwise(2)).alias("different"),      # 2 is exact, more may be less
        share(has("Boolean words")).alias("words"), share(has("digits")).alias("digits"), share(has("Boolean words", "digits")).alias("words_or_digits"),
        share(F.col("bits").bitwiseAND(F.lit((1 << len(DATE_FORMATS)) - 1).cast("bigint")) > 0).alias("Date"),
        *[share(F.col("bits").bitwiseAND(F.lit(1 << i).cast("bigint")) > 0).alias(f"date{i}") for i in range(len(DATE_FORMATS))],
        *[share(has(n)).alias(n) for n in ("Email", "URL", "UUID", "SSN", "Phone Number", "Currency", "Percentage", "Postal Code", "ID/Serial")],
        share(has("IPv4", "IPv6")).alias("IP Address"), share(has("IPv4")).alias("v4"), share(has("IPv6")).alias("v6"),
        share(has("Card")).alias("Credit Card"), F.bool_and(has("fraction")).alias("fractions"), F.bool_and(has("fraction_or_sign")).alias("fractions_or_signs"))


def _first_currencies(df: DataFrame, columns: list[str], sample_rows: int | None, order_by) -> DataFrame:
    """(column, first_currency): the first cell that is an amount of money, of columns known to hold mostly such."""
    counted = value_counts(df, columns, order_by) if sample_rows is None else first_values(df, columns, sample_rows, order_by)
    money = counted.select("column", "at", strip(F.col("value")).alias("text"))
    return money.filter(dict(zip(PATTERNS, _full_matches(F.col("text"))))["Currency"]).groupBy("column").agg(F.min_by("text", "at").alias("first_currency"))


def _number_shares(df: DataFrame, columns: list[str], others: list[str]) -> DataFrame:
    """The same of numeric columns, which can only be Boolean or a Percentage, from two plain aggregates; of others their filled cells."""
    cell = {n: F.when(~is_missing(col(n), type_of(df, n)), col(n).cast("double")) for n in columns}
    ends = df.agg(F.count(F.lit(1)).alias("rows"), *[e for i, n in enumerate(columns) for e in (F.min(cell[n]).alias(f"a{i}"), F.max(cell[n]).alias(f"b{i}"))]).first()
    pairs = {n: (ends[f"a{i}"], ends[f"b{i}"]) for i, n in enumerate(columns)}
    rows = []
    for n in columns:
        low, high = (F.lit(x).cast("double") for x in pairs[n])
        two = F.when(F.bool_and(cell[n].isin(*[x for x in pairs[n] if x is not None])) & (low < high), 2).otherwise(0) if pairs[n][0] is not None else F.lit(0)
        rows.append(F.struct(F.lit(n).alias("column"), F.count(cell[n]).alias("cells"), two.cast("bigint").alias("different"),
                             (F.count_if(cell[n].isin(0.0, 1.0)) * 100.0 / F.nullif(F.count(cell[n]), F.lit(0))).alias("digits"), F.bool_and(cell[n].between(0, 1)).alias("fractions")))
    for n in others:
        rows.append(F.struct(F.lit(n).alias("column"), F.count_if(~is_missing(col(n), type_of(df, n))).alias("cells"), F.lit(0).cast("bigint").alias("different"),
                             F.lit(None).cast("double").alias("digits"), F.lit(None).cast("boolean").alias("fractions")))
    return df.agg(F.array(*rows).alias("x")).select(F.explode("x").alias("x")).select("x.*")


def semantic_types(df: DataFrame, columns: list[str] | None = None, sample_rows: int | None = None, order_by=None,
                   basics: DataFrame | None = None) -> DataFrame:
    """column, detected_type, confidence, format_info.

    Each type's score is the share of the filled cells that fit it; the first type of PRIORITY with 80% or more wins, and
    a column that fits none has the type of its declared Spark type. Numbers can only be Boolean (exactly 0 and 1) or a
    Percentage (0 to 1, when the name says so). All rows count, unless `sample_rows` of each column are asked for. Text
    columns are scored on their different values, numeric ones by plain aggregates. `basics` is not needed any more."""
    columns = list(columns or df.columns)
    require_columns(df, columns)
    kinds = {n: type_of(df, n) for n in columns}
    numeric = [n for n in columns if is_number(kinds[n])]
    texts = [n for n in columns if is_text(kinds[n])]
    named_percent = [n for n in columns if re.search(PERCENT_NAME, n, re.I)]
    column = F.col("column")
    is_numeric = column.isin(numeric) if numeric else F.lit(False)
    others = [n for n in columns if n not in numeric and n not in texts]
    listed = df.sparkSession.createDataFrame([(i, n) for i, n in enumerate(columns)], "place int, column string")
    parts = []
    if texts:
        shares = _text_shares(df, texts, sample_rows, order_by)
        shares = df.sparkSession.createDataFrame(shares.collect(), shares.schema)                                              # a row for each column
        money = [r.column for r in shares.filter(F.col("Currency") >= THRESHOLD).collect()]
        parts.append(shares.join(_first_currencies(df, money, sample_rows, order_by), "column", "left") if money else shares.withColumn("first_currency", F.lit(None).cast("string")))
    if numeric or others:
        parts.append(_number_shares(df, numeric, others))
    scored = functools.reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    joined = listed.join(scored, "column", "left").withColumn("non_null", F.coalesce("cells", F.lit(0))).withColumn(
        "unique_count", F.col("values") if texts else F.lit(0))
    if not texts:
        joined = joined.select("*", *[F.lit(None).cast("double").alias(n) for n in _TEXT_SCORES], F.lit(None).cast("string").alias("first_currency"),
                               F.lit(None).cast("boolean").alias("fractions_or_signs"))

    zero = F.lit(0.0)
    hinted = column.isin(named_percent) if named_percent else F.lit(False)
    two = F.col("different") == 2
    only_text = lambda c: F.when(is_numeric, zero).otherwise(c)
    varied = F.col("unique_count") >= F.col("non_null") * 0.9
    scores = {n: only_text(F.col(n)) for n in PRIORITY if n not in ("Boolean", "Percentage", "ID/Serial")}
    scores["Boolean"] = F.when(is_numeric, F.when(two, F.col("digits")).otherwise(zero)) \
        .otherwise(F.when(two, F.col("words_or_digits")).otherwise(F.col("words")))
    scores["ID/Serial"] = only_text(F.when(varied, F.col("ID/Serial")).otherwise(F.least(F.col("ID/Serial"), F.lit(50.0))))
    scores["Percentage"] = F.when(is_numeric, F.when(hinted & F.col("fractions"), 100.0).otherwise(zero)) \
        .otherwise(F.when(hinted & F.col("fractions_or_signs"), 100.0).otherwise(F.col("Percentage")))

    generic = F.lit("Text")
    for n, kind in kinds.items():
        found = "Integer" if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)) else \
            "Float" if is_number(kind) else "Boolean" if isinstance(kind, T.BooleanType) else "Date" if is_time(kind) else "Text"
        if found != "Text":
            generic = F.when(column == n, found).otherwise(generic)
    detected, confidence = generic, F.lit(100.0)
    for n in reversed(PRIORITY):
        wins = scores[n] >= THRESHOLD
        detected = F.when(wins, n).otherwise(detected)
        confidence = F.when(wins, F.round(scores[n], 1)).otherwise(confidence)
    empty = F.col("non_null") == 0
    best = F.lit(None).cast("string")
    best_share = F.greatest(*[F.col(f"date{i}") for i in range(len(DATE_FORMATS))])
    for i in reversed(range(len(DATE_FORMATS))):
        best = F.when(F.col(f"date{i}") == best_share, f"Format: {DATE_FORMATS[i]}").otherwise(best)
    mark = F.lit(None).cast("string")
    for m in reversed(CURRENCY_MARKS):
        mark = F.when(F.contains(F.col("first_currency"), F.lit(m)), f"Symbol: {m}").otherwise(mark)
    detected = F.when(empty, "Unknown").otherwise(detected)
    info = F.when((detected == "Date") & (best_share >= THRESHOLD), best).when(detected == "Currency", mark) \
        .when(detected == "IP Address", F.when(F.col("v4") >= F.col("v6"), "IPv4").otherwise("IPv6"))
    return joined.select("column", detected.alias("detected_type"), F.when(empty, zero).otherwise(confidence).alias("confidence"),
                         F.when(~is_numeric, info).alias("format_info"))


# ---- table-level facts ----------------------------------------------------------------------------------------------
def table_overview(df: DataFrame, types: DataFrame | None = None, order_by=None) -> DataFrame:
    """One row: rows, columns, type counts, exact duplicate rows, semantic type counts and columns read as another type."""
    types = types if types is not None else semantic_types(df, order_by=order_by)
    declared: dict[str, int] = {}
    for f in df.schema:
        declared[f.dataType.simpleString()] = declared.get(f.dataType.simpleString(), 0) + 1
    texts = [n for n in df.columns if is_text(type_of(df, n))]
    found = types.groupBy("detected_type").agg(F.count(F.lit(1)).alias("n"), F.count_if(
        F.col("column").isin(texts) & ~F.col("detected_type").isin("Text", "Unknown")).alias("reclassified"))
    counted = {r.detected_type: r for r in found.collect()}              # at most one row per semantic type
    as_map = lambda d: F.create_map(*[F.lit(x) for kv in sorted(d.items()) for x in kv])
    rows = df.agg(F.count(F.lit(1)).alias("n")).first().n
    return exact_copies(df).select(
        F.lit(rows).alias("rows"), F.lit(len(df.columns)).alias("columns"), as_map(declared).alias("declared_types"), "duplicate_rows",
        as_map({k: r.n for k, r in counted.items()}).alias("detected_types"),
        F.lit(sum(r.reclassified for r in counted.values())).alias("reclassified_columns"))


def gap_summary(basics: DataFrame) -> DataFrame:
    """Columns with missing values, most first, in the buckets under 5%, 5% to 30% and 30% or more."""
    p = F.col("null_percentage")
    return basics.filter("null_count > 0").select(
        "column", "null_count", "null_percentage", F.when(p < 5, "under 5%").when(p < 30, "5% to 30%").otherwise("30% or more").alias("bucket")) \
        .orderBy(F.desc("null_percentage"), "column")


def completeness(basics: DataFrame) -> DataFrame:
    """One row: the percentage of cells that are filled."""
    cells = F.sum(F.col("non_null") + F.col("null_count"))
    return basics.agg((100 - F.try_divide(F.sum("null_count") * 100.0, cells)).alias("completeness"))


# Name fragments that mark a column as sensitive, in order of precedence.
SENSITIVE_NAMES = ["name", "email", "phone", "address", "ssn", "social", "credit", "account", "password", "dob", "birth", "salary"]


def sensitive_columns(names: list[str]) -> list[tuple[str, str]]:
    """(column, fragment) for each column whose name contains one of the fragments; the first fragment counts."""
    return [(n, next(p for p in SENSITIVE_NAMES if p in n.lower())) for n in names if any(p in n.lower() for p in SENSITIVE_NAMES)]


def key_closeness(basics: DataFrame, top: int = 10) -> DataFrame:
    """How close each column is to a key: different values per 100 rows, the closest ten."""
    share = F.coalesce(F.try_divide(F.col("unique_count") * 100.0, F.col("non_null") + F.col("null_count")), F.lit(0.0))
    return basics.select("column", share.alias("unique_percentage")).select("*", F.when(F.col("unique_percentage") >= 99, "key candidate")
        .when(F.col("unique_percentage") >= 50, "50% to 99%").otherwise("under 50%").alias("bucket")) \
        .orderBy(F.desc("unique_percentage"), "column").limit(top)


def saved_value_counts(df: DataFrame, columns: list[str] | None = None, order_by=None) -> DataFrame:
    """The value-count table, written once so that several statistics can read it."""
    return written(value_counts(df, list(columns or df.columns), order_by))
