"""Named queries over the test tables, each with the same result in plain SQL where SQL can say it.

The tables hold no blanks and no repeated rows, so queries that are about them derive them with an expression that the
SQL repeats. Every query reads its whole tables.
"""
from __future__ import annotations

from collections.abc import Callable
from itertools import combinations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import formulas as f
from .functions.cells import col
from .operators import (anonymize, cleaning, columns, compare, dedupe, fill, filters, group, joins, keys, pivot, profile,
                        readiness, reshape, sorting, types, validate)
from .plans import recipes
from .session import scratch_path
from .sources import readers, sinks
from .streaming import rows as stream

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    def add(run: Query) -> Query:
        key = name or run.__name__
        QUERIES[key] = run
        if sql:
            ORACLES[key] = sql
        return run
    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _blanked(spark, sf) -> DataFrame:
    """events with blanks: value missing in every third row, event_type blank text in every fifth."""
    return table(spark, sf, "events").select(
        "event_id", "ts", "user_id", F.when(F.col("event_id") % 5 == 0, F.lit("  ")).otherwise(F.col("event_type")).alias("event_type"),
        F.when(F.col("event_id") % 3 != 0, F.col("value")).alias("value"))


_BLANKED = """(SELECT event_id, ts, user_id, CASE WHEN event_id % 5 = 0 THEN '  ' ELSE event_type END AS event_type,
    CASE WHEN event_id % 3 <> 0 THEN value END AS value FROM events)"""


# ---- filters --------------------------------------------------------------------------------------------------------
@query("""SELECT o_orderpriority, count(*) AS rows, round(sum(o_totalprice), 2) AS o_totalprice_sum,
    round(avg(o_totalprice), 4) AS o_totalprice_mean, count(o_totalprice) AS o_totalprice_count
  FROM orders WHERE o_totalprice > 100000 AND (lower(o_orderstatus) = 'f' OR lower(o_orderstatus) = 'o')
  GROUP BY o_orderpriority""")
def row_filter_then_group(spark, sf):
    kept = filters.row_filter(table(spark, sf, "orders"), [
        {"column": "o_orderstatus", "operator": "in_list", "value": "f, o"},
        {"column": "o_totalprice", "operator": "greater_than", "value": "100000"}])
    out = group.group_summary(kept, ["o_orderpriority"], ["o_totalprice"], ["sum", "mean", "count"])
    return out.withColumns({"o_totalprice_sum": F.round("o_totalprice_sum", 2), "o_totalprice_mean": F.round("o_totalprice_mean", 4)})


@query("""SELECT c_custkey, c_name, c_mktsegment FROM customer
  WHERE lower(c_mktsegment) <> 'building' AND lower(c_name) LIKE '%00%' AND lower(c_name) LIKE '%7'
     OR lower(c_mktsegment) LIKE 'auto%' AND c_acctbal <= 500 AND lower(c_name) NOT LIKE '%3%'""")
def filter_text_tests(spark, sf):
    return filters.row_filter(table(spark, sf, "customer"), [
        {"column": "c_mktsegment", "operator": "not_equals", "value": "Building"}, {"column": "c_name", "operator": "contains", "value": "00"},
        {"column": "c_name", "operator": "ends_with", "value": "7"},
        {"column": "c_mktsegment", "operator": "starts_with", "value": "Auto", "logic": "OR"},
        {"column": "c_acctbal", "operator": "less_equal", "value": 500, "logic": "AND"},
        {"column": "c_name", "operator": "not_contains", "value": "3"}]).select("c_custkey", "c_name", "c_mktsegment")


@query(f"""SELECT event_id, event_type, value FROM {_BLANKED}
  WHERE trim(event_type) = '' AND value IS NOT NULL OR event_type = 'click' AND value >= 10 AND value < 50""")
def filter_blanks_and_numbers(spark, sf):
    return filters.row_filter(_blanked(spark, sf), [
        {"column": "event_type", "operator": "is_empty"}, {"column": "value", "operator": "is_not_empty"},
        {"column": "event_type", "operator": "equals", "value": "CLICK", "logic": "OR"},
        {"column": "value", "operator": "greater_equal", "value": 10, "logic": "AND"},
        {"column": "value", "operator": "less_than", "value": 50}]).select("event_id", "event_type", "value")


@query("SELECT p_partkey, p_name FROM part WHERE p_size = 11 AND p_brand = 'Brand#2'")
def filter_exact_text(spark, sf):
    return filters.exact_filter(table(spark, sf, "part"), {"p_size": " 11 ", "p_brand": "Brand#2", "p_type": ""}).select("p_partkey", "p_name")


# ---- columns --------------------------------------------------------------------------------------------------------
@query("SELECT p_type AS kind, p_partkey, p_name, p_name AS p_name_copy, p_brand, p_size FROM part")
def columns_rearranged(spark, sf):
    df = columns.reorder_columns(table(spark, sf, "part"), ["p_type", "p_partkey"])
    df = columns.duplicate_column(columns.rename_columns(df, {"p_type": "kind"}), "p_name", "p_name_copy")
    return columns.delete_columns(df, ["p_retailprice"])


@query("""SELECT p_partkey, split_part(p_name, ' ', 1) AS colour, nullif(split_part(p_name, ' ', 2), '') AS p_name_part2 FROM part""")
def column_split(spark, sf):
    return columns.split_column(table(spark, sf, "part"), "p_name", " ", ["colour"]).select("p_partkey", "colour", "p_name_part2")


@query(f"""SELECT event_id, coalesce(event_type, '') || '/' || user_id::VARCHAR || '/' ||
    coalesce(CASE WHEN value = floor(value) THEN value::BIGINT::VARCHAR ELSE value::VARCHAR END, '') AS label FROM {_BLANKED}""")
def column_merge(spark, sf):
    return columns.merge_columns(_blanked(spark, sf), ["event_type", "user_id", "value"], "/", "label").select("event_id", "label")


@query("""SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, round(l_extendedprice * (1 - l_discount) * (1 + l_tax), 6) AS net,
    floor(l_quantity / 7) AS sevens, l_quantity - 7 * floor(l_quantity / 7) AS rest, ceil(l_quantity / 3.0) AS boxes,
    CASE WHEN l_discount <> 0 THEN round(l_tax / l_discount, 6) END AS ratio, power(l_linenumber, 2) AS squared,
    abs(l_discount - l_tax) AS gap FROM lineitem""")
def calc_math(spark, sf):
    q, d, x = F.col("l_quantity"), F.col("l_discount"), F.col("l_tax")
    return table(spark, sf, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", f.ROUND(F.col("l_extendedprice") * (1 - d) * (1 + x), 6).alias("net"),
        f.FLOORDIV(q, 7).alias("sevens"), f.MOD(q, 7).alias("rest"), f.CEILING(q / 3).alias("boxes"),
        f.ROUND(f.DIVIDE(x, d), 6).alias("ratio"), f.POWER(F.col("l_linenumber"), 2).alias("squared"), f.ABS(d - x).alias("gap"))


@query("""SELECT c_custkey, upper(c_name) AS upper_name, lower(c_mktsegment) AS segment, left(c_name, 4) AS head, right(c_name, 3) AS tail,
    length(c_name)::INTEGER AS n, replace(c_name, '#', '-') AS dashed, c_mktsegment || ':' || c_custkey::VARCHAR AS label, trim('  x ') AS trimmed FROM customer""")
def calc_text(spark, sf):
    n, m = F.col("c_name"), F.col("c_mktsegment")
    return table(spark, sf, "customer").select(
        "c_custkey", f.UPPER(n).alias("upper_name"), f.LOWER(m).alias("segment"), f.LEFT(n, 4).alias("head"), f.RIGHT(n, 3).alias("tail"),
        f.LEN(n).alias("n"), f.REPLACE(n, "#", "-").alias("dashed"), f.CONCAT(m, ":", F.col("c_custkey")).alias("label"), f.TRIM("  x ").alias("trimmed"))


@query(f"""SELECT event_id, CASE WHEN value > 50 THEN 'high' ELSE 'low' END AS size, coalesce(value, 0) AS value_or_zero,
    value IS NULL AS no_value, coalesce(value <> 10, TRUE) AS not_ten, coalesce(value > 5 AND value < 20, FALSE) AS middle FROM {_BLANKED}""")
def calc_if(spark, sf):
    v = F.col("value")
    df = columns.calculated_column(_blanked(spark, sf), "size", f.IF(v > 50, "high", "low"))
    return df.select("event_id", "size", f.COALESCE(v, 0).alias("value_or_zero"), f.ISNULL(v).alias("no_value"),
                     f.NE(v, 10).alias("not_ten"), f.BETWEEN(5, v, 20).alias("middle"))


@query("""SELECT o_orderkey, year(o_orderdate)::INTEGER AS y, month(o_orderdate)::INTEGER AS m, day(o_orderdate)::INTEGER AS d FROM orders""")
def calc_dates(spark, sf):
    when = F.date_format("o_orderdate", "yyyy-MM-dd")
    return table(spark, sf, "orders").select("o_orderkey", f.YEAR(when).alias("y"), f.MONTH(when).alias("m"), f.DAY(when).alias("d"))


@query(r"""SELECT c_custkey, regexp_replace(c_name, '([a-z]+)#0*([0-9])', '\2-\1', 'gi') AS c_name,
    regexp_replace(c_mktsegment, 'u', '$1', 'gi') AS c_mktsegment FROM customer""")
def find_replace_regex(spark, sf):
    df = columns.find_replace(table(spark, sf, "customer"), r"([a-z]+)#0*([0-9])", r"\2-\1", ["c_name"], use_regex=True).df
    return columns.find_replace(df, "U", "$1", ["c_mktsegment"]).df.select("c_custkey", "c_name", "c_mktsegment")


@query(r"""SELECT sum(len(regexp_extract_all(lower(p_name), 'ring')) + CASE WHEN lower(p_type) = 'small' THEN 0 ELSE 0 END)::BIGINT AS replacements,
    count(*) FILTER (WHERE lower(p_name) LIKE '%ring%') AS rows_affected FROM part""")
def find_replace_counts(spark, sf):
    return columns.find_replace(table(spark, sf, "part"), "Ring", "band", ["p_name"]).metrics


@query("SELECT p_partkey, CASE WHEN lower(p_type) = 'small' THEN 'S' ELSE p_type END AS p_type FROM part")
def find_replace_whole_cell(spark, sf):
    return columns.find_replace(table(spark, sf, "part"), "small", "S", ["p_type"], whole_cell=True).df.select("p_partkey", "p_type")


@query("""SELECT event_id, CASE WHEN event_type = 'click' THEN '''=' || event_type WHEN event_type = 'view' THEN '''-' || event_type
    WHEN event_type = 'error' THEN '-' || event_id::VARCHAR ELSE event_type END AS cell FROM events""")
def csv_safe_cells(spark, sf):
    kind = F.col("event_type")
    cell = F.when(kind == "click", F.concat(F.lit("="), kind)).when(kind == "view", F.concat(F.lit("-"), kind)) \
        .when(kind == "error", F.concat(F.lit("-"), F.col("event_id").cast("string"))).otherwise(kind)
    return sinks.safe_cells(table(spark, sf, "events").select("event_id", cell.alias("cell")))


# ---- text, types ----------------------------------------------------------------------------------------------------
_SPACE = r"[\t\n\x0b\f\r\x{85}\p{Z}]"


@query(rf"""SELECT doc_id, lower(regexp_replace(regexp_replace(regexp_replace(
      regexp_replace(text, '[^\P{{C}}\t\n\r\p{{Co}}\p{{Cs}}]', '', 'g'),
      '^{_SPACE}+|{_SPACE}+$', '', 'g'), '{_SPACE}+', ' ', 'g'), '[^\p{{L}}\p{{N}}_\t\n\x0b\f\r\x{{85}}\p{{Z}}]', '', 'g')) AS text FROM documents""")
def text_clean(spark, sf):
    df = table(spark, sf, "documents").select("doc_id", "text")
    return cleaning.clean_text(df, ["text"], ["nonprinting", "trim", "collapse", "punctuation"], "lower").df


@query("SELECT doc_id, strip_accents(text) AS text FROM documents")
def text_without_accents(spark, sf):
    return cleaning.clean_text(table(spark, sf, "documents").select("doc_id", "text"), ["text"], ["accents"]).df


@query("""SELECT p_partkey, upper(left(p_type, 1)) || lower(substr(p_type, 2)) AS p_type,
    array_to_string(list_transform(string_split(p_name, ' '), lambda x: upper(left(x, 1)) || lower(substr(x, 2))), ' ') AS p_name FROM part""")
def text_case(spark, sf):
    df = cleaning.clean_text(table(spark, sf, "part"), ["p_name"], [], "title").df
    return cleaning.clean_text(df, ["p_type"], [], "sentence").df.select("p_partkey", "p_type", "p_name")


@query(r"""SELECT count(*) FILTER (WHERE text <> lower(regexp_replace(text, '[\t\n\x0b\f\r\x{85}\p{Z}]+', ' ', 'g'))) AS cells_changed,
    count(*) FILTER (WHERE text <> regexp_replace(text, '[\t\n\x0b\f\r\x{85}\p{Z}]+', ' ', 'g')) AS collapse_changed,
    count(*) FILTER (WHERE regexp_replace(text, '[\t\n\x0b\f\r\x{85}\p{Z}]+', ' ', 'g') <> lower(regexp_replace(text, '[\t\n\x0b\f\r\x{85}\p{Z}]+', ' ', 'g'))) AS case_changed
  FROM documents""")
def text_clean_counts(spark, sf):
    return cleaning.clean_text(table(spark, sf, "documents"), ["text"], ["collapse"], "lower").metrics


def _written_numbers(spark, sf) -> DataFrame:
    """customer balances as people write them: $1.234,50 / (12,00) / 5% / not known."""
    k, v = F.col("c_custkey"), F.col("c_acctbal")
    plain = F.regexp_replace(F.translate(F.format_number(F.abs(v), 2), ",.", ".,"), "x", "")
    return table(spark, sf, "customer").select("c_custkey", F.when(k % 7 == 0, "not known")
        .when(v < 0, F.concat(F.lit("("), plain, F.lit(")"))).when(k % 7 == 1, F.concat(F.lit("$ "), plain)).otherwise(plain).alias("amount"), "c_acctbal")


@query("""SELECT c_custkey, CASE WHEN c_custkey % 7 <> 0 THEN c_acctbal END AS amount, c_custkey % 7 = 0 AS amount_failed FROM customer""")
def normalize_number(spark, sf):
    return types.normalize_types(_written_numbers(spark, sf), {"amount": "float"}, point=",").df.select("c_custkey", "amount", "amount_failed")


@query("""SELECT 'amount' AS "column", 'integer' AS type, count(*) FILTER (WHERE c_custkey % 7 <> 0 AND c_acctbal = floor(c_acctbal)) AS converted,
    count(*) FILTER (WHERE c_custkey % 7 = 0 OR c_acctbal <> floor(c_acctbal)) AS failed FROM customer""")
def normalize_counts(spark, sf):
    return types.normalize_types(_written_numbers(spark, sf), {"amount": "integer"}, point=",").metrics.drop("example")


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 11 <> 0 THEN o_orderdate END AS placed, o_orderkey % 11 = 0 AS placed_failed FROM orders""")
def normalize_date(spark, sf):
    k, d = F.col("o_orderkey"), F.col("o_orderdate")
    text = F.when(k % 11 == 0, "31/02/1999").when(k % 4 == 0, F.date_format(d, "dd/MM/yyyy")).when(k % 4 == 1, F.date_format(d, "d MMM yyyy")) \
        .when(k % 4 == 2, F.date_format(d, "yyyy-MM-dd")).otherwise(F.date_format(d, "MMMM d, yyyy"))
    df = table(spark, sf, "orders").select("o_orderkey", text.alias("placed"))
    return types.normalize_types(df, {"placed": "date"}).df.select("o_orderkey", "placed", "placed_failed")


@query("""SELECT event_id, CASE WHEN event_id % 6 < 2 THEN TRUE WHEN event_id % 6 < 4 THEN FALSE WHEN event_id % 6 = 4 THEN TRUE END AS flag,
    CASE WHEN event_id % 2 = 0 THEN (event_id % 100) / 100.0::DOUBLE ELSE event_id % 100::DOUBLE END AS share FROM events""")
def normalize_boolean_percentage(spark, sf):
    k = F.col("event_id")
    word = F.element_at(F.array(*[F.lit(w) for w in ("yes", "T", "No", "false", "7", "maybe")]), (k % 6 + 1).cast("int"))
    df = table(spark, sf, "events").select("event_id", word.alias("flag"), F.concat((k % 100).cast("string"), F.when(k % 2 == 0, "%").otherwise("")).alias("share"))
    return types.normalize_types(df, {"flag": "boolean", "share": "percentage"}).df.select("event_id", "flag", "share")


# ---- fill -----------------------------------------------------------------------------------------------------------
@query(f"""SELECT event_id, coalesce(nullif(trim(event_type), ''), 'none') AS event_type, value,
    CASE WHEN trim(event_type) = '' THEN 'event_type' END AS filled_columns FROM {_BLANKED}""")
def fill_constant(spark, sf):
    return fill.fill_missing(_blanked(spark, sf), ["event_type"], "constant", "none", flag=True).df.select("event_id", "event_type", "value", "filled_columns")


def _fill_sql(window: str) -> str:
    return f"""SELECT event_id, {window.format("nullif(trim(event_type), '')")} AS event_type, {window.format("value")} AS value FROM {_BLANKED}"""


@query(_fill_sql("last_value({} IGNORE NULLS) OVER (ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"))
def fill_previous(spark, sf):
    return fill.fill_missing(_blanked(spark, sf), ["event_type", "value"], "previous", order_by=["event_id"]).df.select("event_id", "event_type", "value")


@query(_fill_sql("first_value({} IGNORE NULLS) OVER (ORDER BY event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"))
def fill_next(spark, sf):
    return fill.fill_missing(_blanked(spark, sf), ["event_type", "value"], "next", order_by=["event_id"]).df.select("event_id", "event_type", "value")


@query(f"SELECT event_id, round(coalesce(value, (SELECT avg(value) FROM {_BLANKED})), 6) AS value FROM {_BLANKED}")
def fill_mean(spark, sf):
    return fill.fill_missing(_blanked(spark, sf), ["value"], "mean").df.select("event_id", F.round("value", 6).alias("value"))


@query(f"SELECT event_id, round(coalesce(value, (SELECT median(value) FROM {_BLANKED})), 6) AS value FROM {_BLANKED}")
def fill_median(spark, sf):
    return fill.fill_missing(_blanked(spark, sf), ["value"], "median").df.select("event_id", F.round("value", 6).alias("value"))


@query(f"""SELECT event_id, coalesce(nullif(trim(event_type), ''), (SELECT event_type FROM {_BLANKED} WHERE trim(event_type) <> ''
    GROUP BY event_type ORDER BY count(*) DESC, min(event_id) LIMIT 1)) AS event_type FROM {_BLANKED}""")
def fill_mode(spark, sf):
    return fill.fill_missing(_blanked(spark, sf), ["event_type"], "mode", order_by=["event_id"]).df.select("event_id", "event_type")


@query(f"SELECT event_id, trim(event_type) <> '' AND value IS NOT NULL AS kept FROM {_BLANKED}")
def drop_blank_rows(spark, sf):
    out = fill.drop_blank_rows(_blanked(spark, sf), ["event_type", "value"])
    return out.df.select("event_id", F.lit(True).alias("kept")).unionByName(out.side("removed").select("event_id", F.lit(False).alias("kept")))


# ---- duplicates -----------------------------------------------------------------------------------------------------
_GROUPS = """(SELECT user_id, event_type, count(*) AS n, min(event_id) AS keep_id FROM events GROUP BY user_id, event_type HAVING count(*) > 1)"""


@query(f"""SELECT 'user_id=' || user_id::VARCHAR || ', event_type=' || event_type AS row_preview, n AS count, keep_id FROM {_GROUPS}""")
def dup_groups(spark, sf):
    return dedupe.duplicate_groups(table(spark, sf, "events"), "event_id", ["user_id", "event_type"], order_by=["event_id"]) \
        .select("row_preview", "count", "keep_id")


@query(f"SELECT g.keep_id, e.event_id AS id, e.event_id <> g.keep_id AS remove FROM events e JOIN {_GROUPS} g USING (user_id, event_type)")
def dup_members(spark, sf):
    return dedupe.duplicate_members(table(spark, sf, "events"), "event_id", ["user_id", "event_type"], order_by=["event_id"]) \
        .select("keep_id", "id", "remove")


@query(f"""SELECT g.keep_id, 1::BIGINT AS page, count(*) AS count, string_agg(e.event_id::VARCHAR, ',' ORDER BY e.event_id) AS all_ids,
    string_agg(e.event_id::VARCHAR, ',' ORDER BY e.event_id) FILTER (WHERE e.event_id <> g.keep_id) AS ids_to_remove
  FROM events e JOIN {_GROUPS} g USING (user_id, event_type) GROUP BY g.keep_id""")
def dup_id_lists(spark, sf):
    out = dedupe.duplicate_id_lists(table(spark, sf, "events"), "event_id", ["user_id", "event_type"], order_by=["event_id"])
    return out.select("keep_id", "page", "count", F.array_join("all_ids", ",").alias("all_ids"), F.array_join("ids_to_remove", ",").alias("ids_to_remove"))


@query(f"""SELECT e.event_id AS id FROM {_BLANKED} e JOIN (SELECT user_id, value, min(event_id) AS keep_id FROM {_BLANKED} WHERE value IS NOT NULL
    GROUP BY user_id, value) g ON e.user_id = g.user_id AND e.value = g.value WHERE e.event_id <> g.keep_id""")
def dup_ids_to_remove(spark, sf):
    return dedupe.ids_to_remove(_blanked(spark, sf), "event_id", ["user_id", "value"], blank_is_value=False, order_by=["event_id"])


def _kept_and_removed(result) -> DataFrame:
    parts = [(result.df, True), (result.side("removed"), False)]
    return parts[0][0].select("event_id", F.lit(True).alias("kept")).unionByName(parts[1][0].select("event_id", F.lit(False).alias("kept")))


def _dedupe_sql(key: str, order: str) -> str:
    return f"SELECT event_id, row_number() OVER (PARTITION BY {key} ORDER BY {order}) = 1 AS kept FROM {_BLANKED}"


@query(_dedupe_sql("user_id, event_type", "event_id"))
def remove_duplicates_first(spark, sf):
    return _kept_and_removed(dedupe.remove_duplicates(_blanked(spark, sf), ["user_id", "event_type"], order_by=["event_id"]))


@query(_dedupe_sql("user_id, event_type", "event_id DESC"))
def remove_duplicates_last(spark, sf):
    return _kept_and_removed(dedupe.remove_duplicates(_blanked(spark, sf), ["user_id", "event_type"], "last", order_by=["event_id"]))


@query(_dedupe_sql("user_id", "CASE WHEN value IS NULL THEN 1 ELSE 0 END, event_id"))
def remove_duplicates_complete(spark, sf):
    return _kept_and_removed(dedupe.remove_duplicates(_blanked(spark, sf), ["user_id"], "most_complete", order_by=["event_id"]))


@query("""SELECT p_partkey, row_number() OVER (PARTITION BY lower(p_name), p_type ORDER BY p_partkey) = 1 AS kept FROM part""")
def remove_duplicates_loose(spark, sf):
    name = F.when(F.col("p_partkey") % 2 == 0, F.upper(F.regexp_replace("p_name", " ", "   "))).otherwise(F.concat(F.lit(" "), F.col("p_name")))
    out = dedupe.remove_duplicates(table(spark, sf, "part").withColumn("p_name", name), ["p_name", "p_type"], ignore_case_and_spaces=True, order_by=["p_partkey"])
    return out.df.select("p_partkey", F.lit(True).alias("kept")).unionByName(out.side("removed").select("p_partkey", F.lit(False).alias("kept")))


@query("""SELECT c_custkey, row_number() OVER (PARTITION BY c_custkey // 4 ORDER BY c_custkey) = 1 AS kept FROM customer""")
def remove_duplicates_folded(spark, sf):
    """Four spellings of one street: ß and ss, and the letters ﬁ as one."""
    k = F.col("c_custkey")
    spelled = F.element_at(F.array(*[F.lit(w) for w in ("Straße ﬁn ", "STRASSE FIN ", "strasse  ﬁN ", "StraẞE fin ")]), (k % 4 + 1).cast("int"))
    street = table(spark, sf, "customer").select("c_custkey", F.concat(spelled, F.floor(k / 4).cast("string")).alias("street"))
    out = dedupe.remove_duplicates(street, ["street"], ignore_case_and_spaces=True, order_by=["c_custkey"])
    return out.df.select("c_custkey", F.lit(True).alias("kept")).unionByName(out.side("removed").select("c_custkey", F.lit(False).alias("kept")))


@query("""WITH g AS (SELECT count(*) AS n FROM orders GROUP BY o_custkey, o_orderstatus)
  SELECT sum(n)::BIGINT AS rows_in, count(*) AS rows_kept, (sum(n) - count(*))::BIGINT AS rows_removed,
    count(*) FILTER (WHERE n > 1) AS groups_with_duplicates FROM g""")
def remove_duplicates_summary(spark, sf):
    return dedupe.remove_duplicates(table(spark, sf, "orders"), ["o_custkey", "o_orderstatus"], order_by=["o_orderkey"]).metrics


@query("SELECT (count(*) - (SELECT count(*) FROM (SELECT DISTINCT l_suppkey, l_quantity, l_returnflag FROM lineitem)))::BIGINT AS duplicate_rows FROM lineitem")
def exact_copies(spark, sf):
    return dedupe.exact_copies(table(spark, sf, "lineitem").select("l_suppkey", "l_quantity", "l_returnflag"))


@query("SELECT DISTINCT l_suppkey, l_returnflag, l_linestatus FROM lineitem")
def distinct_rows(spark, sf):
    return dedupe.distinct_rows(table(spark, sf, "lineitem").select("l_suppkey", "l_returnflag", "l_linestatus"))


# ---- sort, rank, sample ---------------------------------------------------------------------------------------------
@query("""SELECT o_orderkey, row_number() OVER (ORDER BY lower(o_orderpriority), o_totalprice DESC, o_orderkey) AS rank FROM orders""")
def sort_rank(spark, sf):
    return sorting.rank_rows(table(spark, sf, "orders"), ["o_orderpriority", ("o_totalprice", "descending")], order_by=["o_orderkey"]).select("o_orderkey", "rank")


@query(f"""SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY value DESC NULLS LAST, event_id) AS rank FROM {_BLANKED}""")
def sort_rank_within(spark, sf):
    return sorting.rank_rows(_blanked(spark, sf), [("value", "descending")], within="user_id", order_by=["event_id"]).select("event_id", "rank")


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
def top_n(spark, sf):
    return sorting.first_n(table(spark, sf, "orders"), 25, ["o_orderkey"], [("o_totalprice", "descending")]).select("o_orderkey", "o_totalprice")


@query("""SELECT o_orderkey, o_orderdate FROM (SELECT o_orderkey, o_orderdate, row_number() OVER (ORDER BY o_orderdate DESC, o_orderkey DESC) AS n FROM orders) WHERE n <= 40""")
def last_n(spark, sf):
    return sorting.last_n(table(spark, sf, "orders"), 40, ["o_orderkey"], ["o_orderdate"]).select("o_orderkey", "o_orderdate")


@query("SELECT o_orderkey FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS n FROM orders) WHERE n % 10 = 0")
def every_nth(spark, sf):
    return sorting.every_nth(table(spark, sf, "orders"), 10, ["o_orderkey"]).select("o_orderkey")


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY md5('7:' || o_orderkey::VARCHAR), o_orderkey LIMIT 100")
def sample_n(spark, sf):
    return sorting.sample_n(table(spark, sf, "orders"), 100, 7, ["o_orderkey"]).select("o_orderkey", "o_totalprice")


_LINES = "l_orderkey, l_partkey, l_suppkey, l_linenumber"


@query(f"SELECT {_LINES}, l_extendedprice FROM lineitem ORDER BY l_extendedprice DESC, {_LINES} LIMIT 12000")
def top_n_long(spark, sf):
    """More rows than a top-k holds: only those up to a cut are sorted."""
    return sorting.first_n(table(spark, sf, "lineitem"), 12_000, _LINES.split(", "), [("l_extendedprice", "descending")]).select(*_LINES.split(", "), "l_extendedprice")


@query(f"SELECT {_LINES} FROM lineitem ORDER BY md5('5:' || concat_ws(':', {_LINES})), {_LINES} LIMIT 11000")
def sample_n_long(spark, sf):
    return sorting.sample_n(table(spark, sf, "lineitem"), 11_000, 5, _LINES.split(", ")).select(*_LINES.split(", "))


@query("SELECT o_orderkey, o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS occurrence FROM orders")
def occurrence_number(spark, sf):
    return sorting.occurrence(table(spark, sf, "orders"), ["o_custkey"], order_by=["o_orderkey"]).select("o_orderkey", "o_custkey", "occurrence")


@query("SELECT o_custkey, row_number() OVER (ORDER BY min(o_orderkey)) AS group_number FROM orders GROUP BY o_custkey")
def group_numbers(spark, sf):
    return sorting.group_numbers(table(spark, sf, "orders"), ["o_custkey"], order_by=["o_orderkey"])


# ---- merge ----------------------------------------------------------------------------------------------------------
def _gappy_orders(spark, sf) -> DataFrame:
    """orders whose customer is missing in every 9th row and unknown in every 10th; the key is text."""
    k = F.col("o_orderkey")
    key = F.when(k % 9 == 0, None).when(k % 10 == 0, F.lit("none")).otherwise(F.col("o_custkey").cast("string"))
    return table(spark, sf, "orders").select("o_orderkey", key.alias("custkey"), F.col("o_totalprice").alias("amount"))


_GAPPY = """(SELECT o_orderkey, CASE WHEN o_orderkey % 9 = 0 THEN NULL WHEN o_orderkey % 10 = 0 THEN 'none' ELSE o_custkey::VARCHAR END AS custkey,
    o_totalprice AS amount FROM orders)"""
_CUSTOMERS = "(SELECT c_custkey::VARCHAR AS custkey, c_name, c_acctbal AS amount FROM customer)"


def _customers(spark, sf) -> DataFrame:
    return table(spark, sf, "customer").select(F.col("c_custkey").alias("custkey"), "c_name", F.col("c_acctbal").alias("amount"))


def _merge_sql(how: str, key: str = "coalesce(a.custkey, b.custkey)") -> str:
    return f"""SELECT {key} AS custkey, a.o_orderkey, a.amount AS amount_left, b.c_name, b.amount AS amount_right
      FROM {_GAPPY} a {how} JOIN {_CUSTOMERS} b ON a.custkey = b.custkey"""


def _merge(how: str, duplicates: str = "keep_all") -> Query:
    def run(spark, sf):
        return joins.merge_tables(_gappy_orders(spark, sf), _customers(spark, sf), "custkey", how=how, duplicates=duplicates,
                                  left_order=["o_orderkey"], right_order=["custkey"]).df
    return run


for _how in ("inner", "left", "right"):
    query(_merge_sql(_how.upper()), f"merge_{_how}")(_merge(_how))
query(_merge_sql("FULL"), "merge_outer")(_merge("outer"))
query(f"SELECT a.o_orderkey, a.custkey, a.amount FROM {_GAPPY} a WHERE NOT EXISTS (SELECT 1 FROM {_CUSTOMERS} b WHERE a.custkey = b.custkey)",
      "merge_left_only")(_merge("left_only"))
query(f"SELECT b.custkey::BIGINT AS custkey, b.c_name, b.amount FROM {_CUSTOMERS} b WHERE NOT EXISTS (SELECT 1 FROM {_GAPPY} a WHERE a.custkey = b.custkey)",
      "merge_right_only")(_merge("right_only"))
query(f"""WITH a AS (SELECT * FROM {_GAPPY} QUALIFY custkey IS NULL OR row_number() OVER (PARTITION BY custkey ORDER BY o_orderkey) = 1)
  SELECT coalesce(a.custkey, b.custkey) AS custkey, a.o_orderkey, a.amount AS amount_left, b.c_name, b.amount AS amount_right
  FROM a FULL JOIN {_CUSTOMERS} b ON a.custkey = b.custkey""", "merge_keep_first")(_merge("outer", "keep_first"))


@query("""SELECT a.o_orderkey, a.o_custkey, a.o_orderstatus, b.e_user, b.n FROM orders a JOIN (SELECT user_id AS e_user, CASE event_type WHEN 'click' THEN 'F'
    WHEN 'view' THEN 'O' ELSE 'P' END AS status, count(*) AS n FROM events GROUP BY ALL) b ON a.o_custkey = b.e_user AND a.o_orderstatus = b.status""")
def merge_two_keys(spark, sf):
    status = F.when(F.col("event_type") == "click", "F").when(F.col("event_type") == "view", "O").otherwise("P")
    right = table(spark, sf, "events").groupBy(F.col("user_id").alias("e_user"), status.alias("status")).agg(F.count(F.lit(1)).alias("n"))
    return joins.merge_tables(table(spark, sf, "orders"), right, ["o_custkey", "o_orderstatus"], ["e_user", "status"], "inner", "keep_all",
                              left_columns=["o_orderkey"], right_columns=["n"]).df.drop("status").select("o_orderkey", "o_custkey", "o_orderstatus", "e_user", "n")


@query(f"""WITH j AS (SELECT a.custkey AS k, a.o_orderkey AS l, b.custkey AS r FROM {_GAPPY} a FULL JOIN {_CUSTOMERS} b ON a.custkey = b.custkey)
  SELECT count(DISTINCT l) AS left_rows, (SELECT count(*) FROM customer) AS right_rows, count(*) AS merged_rows,
    count(*) FILTER (WHERE l IS NOT NULL AND r IS NOT NULL) AS matched_rows, count(*) FILTER (WHERE r IS NULL) AS unmatched_left,
    count(*) FILTER (WHERE l IS NULL) AS unmatched_right, 1.0::DOUBLE AS multiplication_factor, FALSE AS rows_multiplied, 'OUTER' AS join_type FROM j""")
def merge_stats(spark, sf):
    return joins.merge_tables(_gappy_orders(spark, sf), _customers(spark, sf), "custkey", how="outer", duplicates="keep_all").metrics


# ---- compare --------------------------------------------------------------------------------------------------------
def _versions(spark, sf) -> tuple[DataFrame, DataFrame]:
    """Two versions of orders keyed by customer (repeating) and status (missing in some rows)."""
    k = F.col("o_orderkey")
    base = table(spark, sf, "orders").select(
        "o_orderkey", F.when(k % 50 != 0, F.col("o_custkey")).alias("cust"), F.when(k % 25 != 0, F.col("o_orderstatus")).alias("status"),
        F.col("o_totalprice").alias("price"), F.col("o_orderpriority").alias("priority"))
    second = base.filter(k % 13 != 0).withColumns({
        "price": F.when(k % 7 == 0, F.col("price") + 1).otherwise(F.col("price")), "priority": F.when(k % 6 != 0, F.col("priority"))})
    return base.filter(k % 17 != 0), second


_VERSIONS = """base AS (SELECT o_orderkey, CASE WHEN o_orderkey % 50 <> 0 THEN o_custkey END AS cust, CASE WHEN o_orderkey % 25 <> 0 THEN o_orderstatus END AS status,
      o_totalprice AS price, o_orderpriority AS priority FROM orders),
    a AS (SELECT *, row_number() OVER (PARTITION BY cust, status ORDER BY o_orderkey) AS nth FROM base WHERE o_orderkey % 17 <> 0),
    b AS (SELECT o_orderkey, cust, status, CASE WHEN o_orderkey % 7 = 0 THEN price + 1 ELSE price END AS price,
      CASE WHEN o_orderkey % 6 <> 0 THEN priority END AS priority, row_number() OVER (PARTITION BY cust, status ORDER BY o_orderkey) AS nth
      FROM base WHERE o_orderkey % 13 <> 0),
    j AS (SELECT coalesce(a.cust, b.cust) AS cust, coalesce(a.status, b.status) AS status, coalesce(a.nth, b.nth) AS occurrence, a.nth AS an, b.nth AS bn,
      a.price AS ap, b.price AS bp, a.priority AS ar, b.priority AS br,
      CASE WHEN a.nth IS NULL THEN 'added' WHEN b.nth IS NULL THEN 'removed'
        WHEN a.price IS DISTINCT FROM b.price OR a.priority IS DISTINCT FROM b.priority THEN 'changed' ELSE 'unchanged' END AS change
      FROM (SELECT * FROM a WHERE cust IS NOT NULL OR status IS NOT NULL) a FULL JOIN (SELECT * FROM b WHERE cust IS NOT NULL OR status IS NOT NULL) b
        ON a.cust IS NOT DISTINCT FROM b.cust AND a.status IS NOT DISTINCT FROM b.status AND a.nth = b.nth)"""


def _comparison(spark, sf, keep: bool = False) -> compare.Comparison:
    first, second = _versions(spark, sf)
    return compare.compare_tables(first, second, ["cust", "status"], ["price", "priority"], ["o_orderkey"], ["o_orderkey"], keep)


@query(f"WITH {_VERSIONS} SELECT cust, status, occurrence, change AS status_ FROM j")
def compare_status(spark, sf):
    return _comparison(spark, sf).status()


@query(f"""WITH {_VERSIONS} SELECT cust, status, CASE WHEN ap IS DISTINCT FROM bp THEN ap END AS "price (Old)", CASE WHEN ap IS DISTINCT FROM bp THEN bp END AS "price (New)",
    CASE WHEN ap IS NOT DISTINCT FROM bp THEN ap END AS price, CASE WHEN ar IS DISTINCT FROM br THEN ar END AS "priority (Old)",
    CASE WHEN ar IS DISTINCT FROM br THEN br END AS "priority (New)", CASE WHEN ar IS NOT DISTINCT FROM br THEN ar END AS priority FROM j WHERE change = 'changed'""")
def compare_changed(spark, sf):
    return _comparison(spark, sf).changed()


@query(f"""WITH {_VERSIONS} SELECT cust, status, ap AS price, ar AS priority, change FROM j WHERE change IN ('removed', 'unchanged')
  UNION ALL SELECT cust, status, bp, br, change FROM j WHERE change = 'added'""")
def compare_outputs(spark, sf):
    c = _comparison(spark, sf, keep=True)
    return c.added().withColumn("change", F.lit("added")).unionByName(c.removed().withColumn("change", F.lit("removed"))) \
        .unionByName(c.unchanged().withColumn("change", F.lit("unchanged")))


@query(f"""WITH {_VERSIONS} SELECT cust, status, occurrence, 'priority' AS "column", ar AS old, br AS new FROM j WHERE change = 'changed' AND ar IS DISTINCT FROM br""")
def compare_changed_cells(spark, sf):
    return _comparison(spark, sf).changed_cells().filter(F.col("column") == "priority")


@query(f"""WITH {_VERSIONS}, s AS (SELECT (SELECT count(*) FROM a) AS total_rows_1, (SELECT count(*) FROM b) AS total_rows_2,
    count(*) FILTER (WHERE change IN ('changed', 'unchanged')) AS common, count(*) FILTER (WHERE change = 'added') AS added,
    count(*) FILTER (WHERE change = 'removed') AS removed, count(*) FILTER (WHERE change = 'changed') AS changed,
    count(*) FILTER (WHERE change = 'unchanged') AS unchanged, count(*) FILTER (WHERE an > 1) AS repeated_key_1, count(*) FILTER (WHERE bn > 1) AS repeated_key_2,
    (SELECT count(*) FROM a WHERE cust IS NULL AND status IS NULL) AS keyless_1, (SELECT count(*) FROM b WHERE cust IS NULL AND status IS NULL) AS keyless_2 FROM j)
  UNPIVOT s ON COLUMNS(*) INTO NAME metric VALUE value""")
def compare_summary(spark, sf):
    return _comparison(spark, sf).summary()


@query(f"""WITH {_VERSIONS} SELECT 1::INTEGER AS file, count(*) AS n FROM a WHERE cust IS NULL AND status IS NULL
  UNION ALL SELECT 2, count(*) FROM b WHERE cust IS NULL AND status IS NULL""")
def compare_keyless(spark, sf):
    return _comparison(spark, sf).rows_without_key().groupBy("file").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT count(*) AS rows_before, count(*) AS rows_after, count(*) FILTER (WHERE lower(c_name) <> c_name) AS cells_changed,
    count(*) FILTER (WHERE lower(c_name) <> c_name) AS rows_changed FROM customer""")
def change_preview(spark, sf):
    before = table(spark, sf, "customer")
    after = cleaning.clean_text(before, ["c_name"], [], "lower").df
    return compare.describe_change(before, after, ["c_custkey"]).metrics.select("rows_before", "rows_after", "cells_changed", "rows_changed")


@query("""WITH t AS (SELECT row_number() OVER (ORDER BY o_orderkey) AS a, row_number() OVER (ORDER BY o_custkey, o_orderkey) AS b, o_orderkey AS k, o_totalprice AS p FROM orders),
    m AS (SELECT count(*) FILTER (WHERE a <> b) AS moved, count(*) FILTER (WHERE k % 100 = 7) AS changed FROM t)
  SELECT 'copy' AS version, FALSE AS reordered UNION ALL SELECT 'sorted by customer', moved > 0 FROM m UNION ALL SELECT 'sorted and changed', moved > 0 AND changed = 0 FROM m""")
def change_reordered(spark, sf):
    """A copy, the rows in another order, and in another order with other prices."""
    df = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    changed = df.withColumn("o_totalprice", F.when(F.col("o_orderkey") % 100 == 7, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice")))
    cases = [("copy", df, ["o_orderkey"]), ("sorted by customer", df, ["o_custkey", "o_orderkey"]), ("sorted and changed", changed, ["o_custkey", "o_orderkey"])]
    return spark.createDataFrame([(name, compare.reordered(df, after, ["o_orderkey"], order)) for name, after, order in cases], "version string, reordered boolean")


# ---- group, pivot, reshape ------------------------------------------------------------------------------------------
@query(f"""SELECT nullif(trim(event_type), '') AS event_type, count(*) AS rows, round(sum(value), 4) AS value_sum, round(avg(value), 6) AS value_mean,
    round(median(value), 6) AS value_median, min(value) AS value_min, max(value) AS value_max, count(value) AS value_count, count(DISTINCT value) AS value_distinct,
    arg_min(value, event_id) FILTER (WHERE value IS NOT NULL) AS value_first, arg_max(value, event_id) FILTER (WHERE value IS NOT NULL) AS value_last
  FROM {_BLANKED} GROUP BY nullif(trim(event_type), '')""")
def group_all_functions(spark, sf):
    out = group.group_summary(_blanked(spark, sf), ["event_type"], ["value"], group.FUNCTIONS, order_by=["event_id"])
    return out.withColumns({"value_sum": F.round("value_sum", 4), "value_mean": F.round("value_mean", 6), "value_median": F.round("value_median", 6)})


@query("""SELECT o_orderstatus, count(*) AS rows, min(o_orderpriority) AS o_orderpriority_min, max(o_orderpriority) AS o_orderpriority_max,
    count(DISTINCT o_orderpriority) AS o_orderpriority_distinct, arg_min(o_orderpriority, o_orderkey) AS o_orderpriority_first FROM orders GROUP BY o_orderstatus""")
def group_text(spark, sf):
    return group.group_summary(table(spark, sf, "orders"), ["o_orderstatus"], ["o_orderpriority"], ["min", "max", "distinct", "first"], order_by=["o_orderkey"])


_STATUS = [("F", "F"), ("O", "O"), ("P", "P")]


def _pivot_sql(cell: str, empty: str = "{}", total_rows: bool = True) -> str:
    cells = ", ".join(f"""{empty.format(cell.format(f"FILTER (WHERE o_orderstatus = '{s}')"))} AS o_totalprice_{n}""" for s, n in _STATUS)
    cells += f", {empty.format(cell.format(''))} AS \"o_totalprice_Total\""
    return f"""SELECT o_orderpriority, {cells} FROM orders GROUP BY o_orderpriority UNION ALL SELECT 'Total', {cells} FROM orders"""


def _rounded(df: DataFrame, digits: int) -> DataFrame:
    return df.select(*[F.round(col(n), digits).alias(n) if t == "double" else col(n) for n, t in df.dtypes])


def _orders_pivot(aggregation: str, digits: int = 2, **options) -> Query:
    def run(spark, sf):
        return _rounded(pivot.pivot_table(table(spark, sf, "orders"), ["o_orderpriority"], ["o_orderstatus"], ["o_totalprice"], aggregation, **options).df, digits)
    return run


query(_pivot_sql("sum(o_totalprice) {}", "round({}, 2)"), "pivot_sum")(_orders_pivot("sum"))
query(_pivot_sql("avg(o_totalprice) {}", "round({}, 4)"), "pivot_mean")(_orders_pivot("mean", 4))
query(_pivot_sql("median(o_totalprice) {}", "round({}, 4)"), "pivot_median")(_orders_pivot("median", 4))
query(_pivot_sql("stddev_samp(o_totalprice) {}", "round({}, 3)"), "pivot_std")(_orders_pivot("std", 3))
query(_pivot_sql("count(o_totalprice) {}"), "pivot_count")(_orders_pivot("count"))
query(_pivot_sql("count(DISTINCT o_totalprice) {}"), "pivot_nunique")(_orders_pivot("nunique"))
query(_pivot_sql("sum(o_totalprice) {}", "round({} / sum(o_totalprice), 8)"), "pivot_share_of_row")(_orders_pivot("sum", 8, show_as="row"))
query(_pivot_sql("sum(o_totalprice) {}", "round({} / (SELECT sum(o_totalprice) FROM orders), 8)"), "pivot_share_of_total")(_orders_pivot("sum", 8, show_as="total"))


@query("""WITH t AS (SELECT o_orderpriority AS p, o_orderstatus AS s, count(*) AS n FROM orders GROUP BY ALL)
  SELECT p AS o_orderpriority, """ + ", ".join(f"""round(sum(n) FILTER (WHERE s = '{s}') / (SELECT sum(n) FROM t WHERE s = '{s}')::DOUBLE, 8) AS o_totalprice_{s}""" for s, _ in _STATUS)
       + """, round(sum(n) / (SELECT sum(n) FROM t)::DOUBLE, 8) AS "o_totalprice_Total" FROM t GROUP BY p
  UNION ALL SELECT 'Total', 1.0, 1.0, 1.0, 1.0""")
def pivot_share_of_column(spark, sf):
    return _orders_pivot("count", 8, show_as="column")(spark, sf)


@query("""SELECT coalesce(strftime(o_orderdate, '%Y'), 'Total') AS o_orderdate, round(sum(o_totalprice), 2) AS "sum_o_totalprice", count(*) AS "count_o_totalprice",
    min(o_totalprice) AS "min_o_totalprice", max(o_totalprice) AS "max_o_totalprice" FROM orders GROUP BY ROLLUP (strftime(o_orderdate, '%Y'))""")
def pivot_years_several(spark, sf):
    return _rounded(pivot.pivot_table(table(spark, sf, "orders"), ["o_orderdate"], [], ["o_totalprice"], ["sum", "count", "min", "max"], date_groups={"o_orderdate": "year"}).df, 2)


@query("""WITH t AS (SELECT strftime(o_orderdate, '%Y') || '-Q' || quarter(o_orderdate)::VARCHAR AS q, strftime(o_orderdate, '%Y-%m') AS m FROM orders)
  SELECT q, m, count(*) AS n FROM t GROUP BY ALL""")
def pivot_period_labels(spark, sf):
    df = table(spark, sf, "orders")
    return df.select(pivot.period_label(df, "o_orderdate", "quarter").alias("q"), pivot.period_label(df, "o_orderdate", "month").alias("m")) \
        .groupBy("q", "m").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH t AS (SELECT coalesce(event_type, '(blank)') AS event_type, value FROM (SELECT CASE WHEN event_id % 5 <> 0 THEN event_type END AS event_type,
      CASE WHEN event_id % 3 <> 0 THEN value END AS value FROM events))
  SELECT coalesce(event_type, 'Total') AS event_type, round(sum(value), 2) AS value FROM t GROUP BY ROLLUP (event_type)""")
def pivot_blank_labels(spark, sf):
    df = _blanked(spark, sf).withColumn("event_type", F.when(F.col("event_id") % 5 != 0, F.col("event_type")))
    return _rounded(pivot.pivot_table(df, ["event_type"], [], ["value"]).df, 2)


@query("SELECT 'label' AS \"column\", count(*) FILTER (WHERE event_id % 4 = 0) AS not_numbers FROM events")
def pivot_not_numbers(spark, sf):
    label = F.when(F.col("event_id") % 4 == 0, "n/a").otherwise(F.col("value").cast("string"))
    return pivot.pivot_table(table(spark, sf, "events").withColumn("label", label), ["event_type"], [], ["label"], "sum").metrics


@query("""SELECT p_partkey, name, value FROM (SELECT p_partkey, p_name, p_brand, p_type FROM part) UNPIVOT (value FOR name IN (p_name, p_brand, p_type))""")
def unpivot_text(spark, sf):
    return reshape.unpivot(table(spark, sf, "part").select("p_partkey", "p_name", "p_brand", "p_type"), ["p_partkey"]).df


@query(f"""SELECT event_id, 'event_type' AS field, event_type AS cell FROM {_BLANKED} WHERE trim(event_type) <> ''
  UNION ALL SELECT event_id, 'value', CASE WHEN value = floor(value) THEN value::BIGINT::VARCHAR ELSE value::VARCHAR END FROM {_BLANKED} WHERE value IS NOT NULL""")
def unpivot_drop_blank(spark, sf):
    return reshape.unpivot(_blanked(spark, sf), ["event_id"], ["event_type", "value"], "field", "cell", drop_blank=True).df


@query("""SELECT 'customer' AS source_file, c_custkey AS "Key", c_name AS "Name", c_acctbal AS balance, c_mktsegment AS segment FROM customer
  UNION ALL SELECT 'supplier', s_suppkey, s_name, s_acctbal, NULL FROM supplier""")
def append(spark, sf):
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("Key"), F.col("c_name").alias("Name"), F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment"))
    s = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("KEY "), F.col("s_name").alias("name"), F.col("s_acctbal").alias("money"))
    return reshape.append_tables([("customer", c), ("supplier", s)], {"supplier": {"money": "balance"}}, loose=True).df


@query("""WITH t AS (SELECT o_orderpriority AS p, count(*) AS n, max(o_orderkey) AS k, row_number() OVER (ORDER BY o_orderpriority) - 1 AS i FROM orders GROUP BY o_orderpriority)
  SELECT 'p' AS "Original Column/Row", """ + ", ".join(f'max(p) FILTER (WHERE i = {i}) AS "{i}"' for i in range(5)) + """ FROM t
  UNION ALL SELECT 'n', """ + ", ".join(f"max(n) FILTER (WHERE i = {i})::VARCHAR" for i in range(5)) + """ FROM t
  UNION ALL SELECT 'k', """ + ", ".join(f"max(k) FILTER (WHERE i = {i})::VARCHAR" for i in range(5)) + " FROM t")
def transpose_summary(spark, sf):
    t = table(spark, sf, "orders").groupBy(F.col("o_orderpriority").alias("p")).agg(F.count(F.lit(1)).alias("n"), F.max("o_orderkey").alias("k"))
    return reshape.transpose(t, ["p"])


@query("""WITH t AS (SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS pos, o_orderkey::VARCHAR AS o_orderkey, o_custkey::VARCHAR AS o_custkey,
                            nullif(o_orderpriority, '1-URGENT') AS o_orderpriority, o_orderstatus FROM orders),
              cells AS (SELECT pos, unnest([0, 1, 2, 3]) AS place, unnest(['o_orderkey', 'o_custkey', 'o_orderpriority', 'o_orderstatus']) AS "column",
                               unnest([o_orderkey, o_custkey, o_orderpriority, o_orderstatus]) AS value FROM t)
         SELECT place, "column", (pos // 1000)::BIGINT AS block, min(pos)::BIGINT AS first_row, count(*)::BIGINT AS cells,
                md5(string_agg(coalesce(value, '-'), '|' ORDER BY pos)) AS digest FROM cells GROUP BY ALL""")
def transpose_in_blocks(spark, sf):
    t = table(spark, sf, "orders").select("o_orderkey", "o_custkey", F.nullif("o_orderpriority", F.lit("1-URGENT")).alias("o_orderpriority"), "o_orderstatus")
    listed = F.array_join("values", "|", "-")
    return reshape.transpose_blocks(t, ["o_orderkey"], 1000).select("place", "column", "block", "first_row", F.size("values").cast("bigint").alias("cells"), F.md5(listed).alias("digest"))


# ---- validation -----------------------------------------------------------------------------------------------------
_RULES = [{"column": "event_type", "type": "required"}, {"column": "event_type", "type": "list", "value": ["click", "view", "error", "signup"]},
          {"column": "value", "type": "range", "value": {"min": 1, "max": "60"}}, {"column": "event_type", "type": "length", "value": {"min": 5}},
          {"column": "event_type", "type": "pattern", "value": "[a-z]+"}, {"column": "user_id", "type": "numeric"}, {"column": "nowhere", "type": "required"}]
_NUMBER_TEXT = "CASE WHEN value = floor(value) THEN value::BIGINT::VARCHAR ELSE value::VARCHAR END"
_BROKEN = f"""(SELECT event_id, list_filter([
    CASE WHEN trim(event_type) = '' THEN 'event_type: a value is needed' END,
    CASE WHEN event_type = 'purchase' THEN 'event_type: "purchase" is none of the values listed' END,
    CASE WHEN value < 1 THEN 'value: ' || {_NUMBER_TEXT} || ' is less than 1' WHEN value > 60 THEN 'value: ' || {_NUMBER_TEXT} || ' is more than 60' END,
    CASE WHEN trim(event_type) <> '' AND length(event_type) < 5 THEN 'event_type: ' || length(event_type)::VARCHAR || ' characters are too few or too many' END
  ], lambda x: x IS NOT NULL) AS errors FROM {_BLANKED})"""


@query(f"SELECT event_id, array_to_string(errors, '; ') AS errors FROM {_BROKEN} WHERE len(errors) > 0")
def validate_rows(spark, sf):
    return validate.validate(_blanked(spark, sf), _RULES).side("invalid").select("event_id", F.array_join("errors", "; ").alias("errors"))


@query(f"SELECT event_id, event_id + 2 AS row_number FROM {_BROKEN} WHERE len(errors) > 0")
def validate_row_numbers(spark, sf):
    return validate.validate(_blanked(spark, sf), _RULES, row_numbers=True, order_by=["event_id"]).side("invalid").select("event_id", "row_number")


@query(f"""SELECT count(*) AS total_rows, count(*) FILTER (WHERE len(errors) = 0) AS valid_rows, count(*) FILTER (WHERE len(errors) > 0) AS invalid_rows,
    round(count(*) FILTER (WHERE len(errors) > 0) * 100.0::DOUBLE / count(*), 2) AS error_rate, sum(len(errors))::BIGINT AS rule_failures FROM {_BROKEN}""")
def validate_summary(spark, sf):
    return validate.validate(_blanked(spark, sf), _RULES).metrics


# ---- profile --------------------------------------------------------------------------------------------------------
_EVENT_COLUMNS = [("event_id", "bigint"), ("ts", "timestamp_ntz"), ("user_id", "bigint"), ("event_type", "string"), ("value", "double")]


@query(" UNION ALL ".join(f"""SELECT '{n}' AS "column", '{t}' AS type, count({n}) AS non_null, count(*) - count({n}) AS null_count,
    round((count(*) - count({n})) * 100.0::DOUBLE / count(*), 2) AS null_percentage, count(DISTINCT {n}) AS unique_count FROM {_BLANKED}""" for n, t in _EVENT_COLUMNS))
def profile_columns(spark, sf):
    return profile.profile_columns(_blanked(spark, sf))


_NUMERIC = ["l_quantity", "l_extendedprice", "l_discount"]


@query(" UNION ALL ".join(f"""SELECT '{n}' AS "column", round(avg({n}), 6) AS mean, round(median({n}), 6) AS median, round(stddev_samp({n}), 6) AS std, min({n}) AS min, max({n}) AS max,
    round(quantile_cont({n}, 0.25), 6) AS q25, round(quantile_cont({n}, 0.5), 6) AS q50, round(quantile_cont({n}, 0.75), 6) AS q75,
    round(skewness({n}), 5) AS skew, round(kurtosis({n}), 5) AS kurtosis,
    (SELECT count(*) FROM lineitem x, (SELECT quantile_cont({n}, 0.25) AS a, quantile_cont({n}, 0.75) AS b FROM lineitem) WHERE x.{n} < a - 1.5 * (b - a) OR x.{n} > b + 1.5 * (b - a)) AS outliers
  FROM lineitem""" for n in _NUMERIC))
def profile_numeric(spark, sf):
    out = profile.profile_numeric(table(spark, sf, "lineitem"), _NUMERIC).drop("outlier_percentage")
    return out.withColumns({n: F.round(n, 6) for n in ("mean", "median", "std", "q25", "q50", "q75")} | {n: F.round(n, 5) for n in ("skew", "kurtosis")})


@query("""WITH t AS (SELECT 'event_type' AS "column", event_type AS value, count(*) AS n, min(event_id) AS pos FROM events GROUP BY event_type
    UNION ALL SELECT 'props', props, count(*), min(event_id) FROM events GROUP BY props)
  SELECT "column", value, n AS count, row_number() OVER (PARTITION BY "column" ORDER BY n DESC, pos)::INTEGER AS rank FROM t QUALIFY rank <= 10""")
def profile_top_values(spark, sf):
    return profile.top_values(table(spark, sf, "events"), ["event_type", "props"], ["event_id"])


@query(" UNION ALL ".join(f"""SELECT '{n}' AS "column", round(avg(length({n})), 6) AS mean_length, min(length({n}))::INTEGER AS min_length, max(length({n}))::INTEGER AS max_length,
    median(length({n}))::DOUBLE AS median_length FROM documents""" for n in ("text", "lang", "source")))
def profile_text_lengths(spark, sf):
    return profile.text_lengths(table(spark, sf, "documents")).withColumn("mean_length", F.round("mean_length", 6))


@query("""SELECT 'o_orderdate' AS "column", min(o_orderdate) AS earliest, max(o_orderdate) AS latest FROM orders""")
def profile_dates(spark, sf):
    return profile.date_ranges(table(spark, sf, "orders"))


@query("""SELECT 'big' AS "column", CASE WHEN value > 50 THEN 'True' ELSE 'False' END AS value, count(*) AS count FROM events GROUP BY ALL""")
def profile_booleans(spark, sf):
    return profile.boolean_counts(table(spark, sf, "events").select((F.col("value") > 50).alias("big")))


#: Text columns made from events: the type looked for, what a cell of it looks like in SQL, its format, and how Spark and SQL make the cell.
_K = "event_id"
_MADE = [
    ("mail", "Email", "[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+[.][a-zA-Z]{2,}", None, "concat('user', event_id, '@example.com')"),
    ("late", "Email", "[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+[.][a-zA-Z]{2,}", None, "CASE WHEN event_id < 2000 THEN concat('user', event_id, '@example.com') ELSE concat('no mail ', event_id) END"),
    ("most", "Email", "[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+[.][a-zA-Z]{2,}", None, "CASE WHEN event_id % 7 = 3 THEN 'none' ELSE concat('user', event_id, '@example.com') END"),
    ("code", "ID/Serial", "[A-Z]{2,}-?[0-9]+", None, "concat('EV-', lpad(cast(event_id AS STRING), 9, '0'))"),
    ("yes", "Boolean", "yes|No", None, "CASE WHEN event_id % 2 = 0 THEN 'yes' ELSE 'No' END"),
    ("price", "Currency", "[$][0-9,]+([.][0-9]+)?", "Symbol: $", "concat('$', event_id)"),
    ("site", "URL", "https?://[^\\s/$.?#].[^\\s]*", None, "concat('https://example.com/', event_id)"),
    ("day", "Date", "[0-9]{2}/[0-9]{2}/[0-9]{4}", "Format: %m/%d/%Y", "concat(lpad(cast(1 + event_id % 12 AS STRING), 2, '0'), '/', lpad(cast(1 + event_id % 28 AS STRING), 2, '0'), '/2024')"),
    ("words", "Text", "", None, "concat('plain words ', event_id)"),
]


def _made_sql() -> str:
    parts = []
    for name, kind, pattern, info, made in _MADE:
        share = f"sum(CASE WHEN regexp_full_match({name}, '{pattern}') THEN 1 ELSE 0 END) * 100.0::DOUBLE / count({name})"
        fits = f"({share} >= 80)" if kind != "Text" else "FALSE"
        shown = "NULL" if info is None else f"CASE WHEN {fits} THEN '{info}' END"
        parts.append(f"""SELECT '{name}' AS "column", CASE WHEN {fits} THEN '{kind}' ELSE 'Text' END AS detected_type, CASE WHEN {fits} THEN round({share}, 1) ELSE 100.0 END AS confidence,
            {shown}::VARCHAR AS format_info FROM t""")
    columns_ = ", ".join(f"{made.replace('AS STRING', 'AS VARCHAR')} AS {name}" for name, _, _, _, made in _MADE)
    return f"WITH t AS (SELECT {columns_} FROM events) " + " UNION ALL ".join(parts)


@query(_made_sql())
def semantic_types(spark, sf):
    """Over all rows: `late` stops being an address after the first 2000."""
    df = table(spark, sf, "events").select("event_id", *[F.expr(made).alias(name) for name, _, _, _, made in _MADE])
    return profile.semantic_types(df, [name for name, *_ in _MADE], order_by=["event_id"])


@query(f"""WITH t AS (SELECT 'value' AS "column", count(*) - count(value) AS null_count, count(*) AS n FROM {_BLANKED})
  SELECT "column", null_count, round(null_count * 100.0::DOUBLE / n, 2) AS null_percentage, '30% or more' AS bucket FROM t""")
def gap_summary(spark, sf):
    return profile.gap_summary(profile.profile_columns(_blanked(spark, sf)))


@query(f"SELECT round(100 - (count(*) - count(value)) * 100.0::DOUBLE / (count(*) * 5), 6) AS completeness FROM {_BLANKED}")
def completeness(spark, sf):
    return profile.completeness(profile.profile_columns(_blanked(spark, sf))).select(F.round("completeness", 6).alias("completeness"))


@query(" UNION ALL ".join(f"""SELECT '{n}' AS "column", round(count(DISTINCT {n}) * 100.0::DOUBLE / count(*), 6) AS unique_percentage,
    CASE WHEN count(DISTINCT {n}) * 100.0 / count(*) >= 99 THEN 'key candidate' WHEN count(DISTINCT {n}) * 100.0 / count(*) >= 50 THEN '50% to 99%' ELSE 'under 50%' END AS bucket FROM orders"""
    for n in ("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority")))
def key_closeness(spark, sf):
    return profile.key_closeness(profile.profile_columns(table(spark, sf, "orders"))).withColumn("unique_percentage", F.round("unique_percentage", 6))


@query("""SELECT count(*) AS rows, 6::INTEGER AS columns, (count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM orders)))::BIGINT AS duplicate_rows,
    0::INTEGER AS reclassified_columns FROM orders""")
def table_overview(spark, sf):
    out = profile.table_overview(table(spark, sf, "orders"), order_by=["o_orderkey"])
    return out.select(F.col("rows").cast("bigint").alias("rows"), "columns", "duplicate_rows", "reclassified_columns")


@query(" UNION ALL ".join(f"""SELECT '{n}' AS "column", '{k}' AS detected_type, 100.0::DOUBLE AS confidence, NULL::VARCHAR AS format_info FROM {t} GROUP BY ALL HAVING count({n}) > 0"""
    for t, n, k in (("part", "p_partkey", "Integer"), ("part", "p_retailprice", "Float"), ("part", "p_size", "Integer"))))
def semantic_types_of_numbers(spark, sf):
    return profile.semantic_types(table(spark, sf, "part").select("p_partkey", "p_retailprice", "p_size"))


# ---- keys -----------------------------------------------------------------------------------------------------------
_KEY_COLUMNS = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity"]


def _key_sql() -> str:
    """Every combination of the columns with whether it is unique, less those that hold a smaller unique one."""
    tried = " UNION ALL ".join(
        f"""SELECT {list(c)} AS names, (SELECT count(*) FROM (SELECT DISTINCT {", ".join(c)} FROM lineitem)) = (SELECT count(*) FROM lineitem) AS is_key"""
        for size in range(1, len(_KEY_COLUMNS) + 1) for c in combinations(sorted(_KEY_COLUMNS), size))
    return f"""WITH c AS ({tried}) SELECT array_to_string(names, ' + ') AS key, FALSE AS truncated FROM c WHERE is_key
      AND NOT EXISTS (SELECT 1 FROM c s WHERE s.is_key AND len(s.names) < len(c.names) AND list_has_all(c.names, s.names))"""


@query(_key_sql())
def minimal_keys(spark, sf):
    found = keys.find_minimal_keys(table(spark, sf, "lineitem"), _KEY_COLUMNS)
    return spark.createDataFrame([(" + ".join(sorted(k)), found.truncated) for k in found.keys], "key string, truncated boolean")


@query("""SELECT o_orderkey, o_orderkey::VARCHAR AS "Unique_ID", FALSE AS _is_duplicate FROM orders""")
def unique_id(spark, sf):
    return keys.unique_id(table(spark, sf, "orders"), ["o_orderstatus", "o_orderkey", "o_custkey"], order_by=["o_orderkey"], seconds=None) \
        .select("o_orderkey", "Unique_ID", "_is_duplicate")


@query("""WITH t AS (SELECT user_id, event_type, event_id FROM events UNION ALL SELECT user_id, event_type, event_id FROM events WHERE event_id % 3 = 0)
  SELECT event_id::VARCHAR || '|||' || event_type AS "Unique_ID", row_number() OVER (PARTITION BY event_id ORDER BY event_id) > 1 AS _is_duplicate FROM t""")
def unique_id_with_copies(spark, sf):
    df = table(spark, sf, "events").select("user_id", "event_type", "event_id")
    return keys.add_unique_id(df.unionByName(df.filter("event_id % 3 = 0")), ["event_id", "event_type"], ["event_id"]).select("Unique_ID", "_is_duplicate")


# ---- anonymize ------------------------------------------------------------------------------------------------------
@query(f"""WITH u AS (SELECT user_id, row_number() OVER (ORDER BY min(event_id)) AS n FROM events GROUP BY user_id),
    v AS (SELECT value, row_number() OVER (ORDER BY min(event_id)) AS n FROM {_BLANKED} WHERE value IS NOT NULL GROUP BY value)
  SELECT e.event_id, 'user_' || u.n::VARCHAR AS user_id, 'value_' || v.n::VARCHAR AS value FROM {_BLANKED} e JOIN u ON e.user_id = u.user_id LEFT JOIN v ON e.value = v.value""")
def pseudonyms(spark, sf):
    df = _blanked(spark, sf)
    done = anonymize.anonymize(df, ["user_id", "value"], order_by=["event_id"])
    anonymize.verify_anonymized(df, done.df, ["user_id", "value"], done.side("mapping"))
    return done.df.select("event_id", "user_id", "value")


@query(f"""WITH c AS (SELECT user_id, value, row_number() OVER (ORDER BY min(event_id)) AS n FROM {_BLANKED} GROUP BY user_id, value)
  SELECT e.event_id, 'user_' || c.n::VARCHAR AS user_id, CASE WHEN e.value IS NOT NULL THEN 'user_' || c.n::VARCHAR END AS value
  FROM {_BLANKED} e JOIN c ON e.user_id = c.user_id AND e.value IS NOT DISTINCT FROM c.value""")
def pseudonyms_related(spark, sf):
    return anonymize.anonymize(_blanked(spark, sf), ["user_id", "value"], related=True, order_by=["event_id"]).df.select("event_id", "user_id", "value")


@query("""SELECT 'event_type' AS "column", event_type AS original, 'EVE_' || lpad(row_number() OVER (ORDER BY min(event_id))::VARCHAR, 5, '0') AS pseudonym FROM events GROUP BY event_type""")
def pseudonym_mapping(spark, sf):
    mapping = anonymize.anonymize(table(spark, sf, "events"), ["event_type"], order_by=["event_id"], short_prefix=True).side("mapping")
    return mapping.select(F.col("columns")[0].alias("column"), F.col("original")[0].alias("original"), "pseudonym")


# ---- recipes, files, readiness --------------------------------------------------------------------------------------
_RECIPE = recipes.make_recipe([
    {"tool": "row-filter", "options": {"conditions": [{"column": "value", "operator": "greater_than", "value": "1"}]}},
    {"tool": "text-cleaner", "options": {"columns": ["event_type"], "case": "upper"}},
    {"tool": "find-replace", "options": {"find": "CLICK", "replace": "TAP", "columns": ["event_type"], "whole_cell": True}},
    {"tool": "fill-missing", "options": {"columns": ["event_type"], "value": "NONE"}},
    {"tool": "remove-duplicates", "options": {"columns": ["user_id", "event_type"]}},
    {"tool": "group-and-summarise", "options": {"group_columns": ["event_type"], "value_columns": ["value"], "max": True, "sum": False}}])


@query(f"""WITH t AS (SELECT event_id, user_id, value, CASE WHEN trim(event_type) = '' THEN 'NONE' WHEN event_type = 'click' THEN 'TAP' ELSE upper(event_type) END AS event_type
    FROM {_BLANKED} WHERE value > 1),
  d AS (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS nth FROM t)
  SELECT event_type, count(*) AS rows, max(value) AS value_max FROM d WHERE nth = 1 GROUP BY event_type""")
def recipe_replay(spark, sf):
    return recipes.replay(_RECIPE, _blanked(spark, sf), order_by=["event_id"]).df


@query(f"""WITH t AS (SELECT event_id, user_id, value, event_type FROM {_BLANKED} WHERE value > 1), n AS (SELECT (SELECT count(*) FROM events) AS a, count(*) AS b,
      count(*) FILTER (WHERE trim(event_type) <> '') AS upped, count(*) FILTER (WHERE event_type = 'click') AS tapped, count(*) FILTER (WHERE trim(event_type) = '') AS filled FROM t),
    d AS (SELECT count(*) AS c FROM (SELECT DISTINCT user_id, CASE WHEN trim(event_type) = '' THEN NULL ELSE event_type END AS e FROM t)),
    g AS (SELECT count(DISTINCT trim(event_type)) AS k FROM t)
  SELECT unnest([1, 2, 3, 4, 5, 6])::INTEGER AS step, unnest(['row-filter', 'text-cleaner', 'find-replace', 'fill-missing', 'remove-duplicates', 'group-and-summarise']) AS tool,
    unnest([a, b, b, b, b, c])::BIGINT AS rows_in, unnest([b, b, b, b, c, k])::BIGINT AS rows_out, unnest([NULL, upped + filled, tapped, filled, NULL, NULL])::BIGINT AS cells_changed FROM n, d, g""")
def recipe_report(spark, sf):
    """Rows and changed cells of every step, counted in the one job that writes the result."""
    return recipes.replay(_RECIPE, _blanked(spark, sf), order_by=["event_id"]).report(scratch_path(spark))


@query("""SELECT o_orderkey, ((row_number() OVER (ORDER BY o_orderkey) - 1) // 1000 + 1)::BIGINT AS chunk FROM orders""")
def split_by_rows(spark, sf):
    return sinks.split_by_rows(table(spark, sf, "orders"), 1000, ["o_orderkey"]).select("o_orderkey", "chunk")


@query("""SELECT o_orderkey, regexp_replace(o_orderpriority, '[^A-Za-z0-9_-]', '_', 'g') AS label FROM orders""")
def split_by_value(spark, sf):
    return sinks.split_by_value(table(spark, sf, "orders"), "o_orderpriority", ["o_orderkey"]).select("o_orderkey", "label")


@query("SELECT 4 * c_custkey + i AS at, CASE i WHEN 0 THEN 'n' || c_custkey::VARCHAR WHEN 1 THEN 'N_' || c_custkey::VARCHAR WHEN 2 THEN 'n' || c_custkey::VARCHAR || '_2' "
       "ELSE 'N' || c_custkey::VARCHAR || '_3' END AS label FROM customer, range(4) t(i)")
def split_by_clashing_values(spark, sf):
    """More clashing values than one driver should number: n5, N 5, n5_2 and N5, which becomes N5_3, as the name N5_2 is taken."""
    k, i = F.col("c_custkey").cast("string"), F.col("i")
    value = F.when(i == 0, F.concat(F.lit("n"), k)).when(i == 1, F.concat(F.lit("N "), k)).when(i == 2, F.concat(F.lit("n"), k, F.lit("_2"))).otherwise(F.concat(F.lit("N"), k))
    df = table(spark, sf, "customer").select("c_custkey", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("i"))
    df = df.select((F.col("c_custkey") * 4 + i).alias("at"), value.alias("value"))
    return sinks.split_by_value(df, "value", ["at"]).select("at", "label")


def _saved_csv(spark, sf) -> str:
    """Orders written as CSV in the shared folder, with a text column that looks like a number."""
    path = scratch_path(spark, ".csv")
    sinks.write_csv(table(spark, sf, "orders").select("o_orderkey", F.lpad(F.col("o_custkey").cast("string"), 6, "0").alias("code"), "o_totalprice",
                                                      F.when(F.col("o_orderkey") % 2 == 0, "NA").alias("note"), "o_orderpriority"), path, delimiter=";")
    return path


_TEXT_PRICE = "CASE WHEN o_totalprice = floor(o_totalprice) THEN o_totalprice::BIGINT::VARCHAR ELSE o_totalprice::VARCHAR END"


@query(f"""SELECT o_orderkey::VARCHAR AS o_orderkey, lpad(o_custkey::VARCHAR, 6, '0') AS code, {_TEXT_PRICE} AS o_totalprice,
    CASE WHEN o_orderkey % 2 = 0 THEN 'NA' END AS note, o_orderpriority FROM orders""")
def csv_lossless(spark, sf):
    return readers.read_delimited(spark, _saved_csv(spark, sf))


@query("""SELECT o_orderkey, o_custkey AS code, o_totalprice, CASE WHEN o_orderkey % 2 = 0 THEN 'NA' END AS note, o_orderpriority FROM orders""")
def csv_inferred(spark, sf):
    return readers.read_delimited(spark, _saved_csv(spark, sf), mode="infer")


@query("""SELECT c_custkey::VARCHAR AS c_custkey, c_name || ' €’é' AS label FROM customer""")
def csv_windows_1252(spark, sf):
    """Written with the bytes of windows-1252, read without naming the encoding."""
    path = scratch_path(spark, ".csv")
    label = F.translate(F.concat("c_name", F.lit(" €’é")), "€’", "\x80\x92")
    table(spark, sf, "customer").select("c_custkey", label.alias("label")).write.options(header=True, encoding="ISO-8859-1").csv(path)
    return readers.read_delimited(spark, path)


@query("""SELECT c_custkey::VARCHAR AS c_custkey, c_name, CASE WHEN c_custkey % 5 = 0 THEN 'more;and "more"' WHEN c_custkey % 5 = 1 THEN 'x' END AS _extra_cells FROM customer""")
def csv_ragged(spark, sf):
    path = scratch_path(spark, ".csv")
    tail = F.when(F.col("c_custkey") % 5 == 0, ';more;and "more"').when(F.col("c_custkey") % 5 == 1, ";x").otherwise("")
    line = F.concat(F.col("c_custkey").cast("string"), F.lit(";"), "c_name", tail)
    table(spark, sf, "customer").select(line.alias("c_custkey;c_name")).write.options(header=True, sep="\t", quote="\x01", escape="\x01").csv(path)
    return readers.read_delimited(spark, path, ragged="keep")


_BROKEN_CELL = "CASE WHEN o_orderkey % 3 = 0 THEN o_orderpriority || chr(10) || 'see \"' || o_orderkey::VARCHAR || '\";' || chr(13) || chr(10) || chr(10) ELSE o_orderpriority END"


def _csv_with_line_breaks(spark, sf) -> str:
    """Orders as one CSV file a part, with line breaks, quotes and delimiters inside every third note."""
    path, k, note = scratch_path(spark, ".csv"), F.col("o_orderkey"), F.col("o_orderpriority")
    broken = F.concat(note, F.lit('\nsee "'), k.cast("string"), F.lit('";\r\n\n'))
    table(spark, sf, "orders").select("o_orderkey", F.when(k % 3 == 0, broken).otherwise(note).alias("note"), "o_orderstatus").write.options(
        header=True, sep=";", escape='"', ignoreTrailingWhiteSpace=False).csv(path)
    return path


@query(f"SELECT o_orderkey::VARCHAR AS o_orderkey, {_BROKEN_CELL} AS note, o_orderstatus FROM orders")
def csv_line_breaks(spark, sf):
    """Found and read without being asked for."""
    return readers.read_delimited(spark, _csv_with_line_breaks(spark, sf))


@query(f"SELECT o_orderkey::VARCHAR AS key, {_BROKEN_CELL} AS note, 3::INTEGER AS width FROM orders")
def grid_line_breaks(spark, sf):
    grid = readers.raw_grid(spark, _csv_with_line_breaks(spark, sf))
    cell = lambda i: F.get("cells", F.lit(i))
    filled = F.size(F.filter("cells", lambda c: c.isNotNull())).alias("width")
    return grid.filter(cell(0) != "o_orderkey").select(cell(0).alias("key"), cell(1).alias("note"), filled)


@query("SELECT count(*) AS records, count(*) FILTER (WHERE o_orderkey % 3 = 0) AS with_breaks FROM orders")
def csv_record_count(spark, sf):
    path = _csv_with_line_breaks(spark, sf)
    breaks = readers.read_delimited(spark, path).filter(F.col("note").contains("\n")).agg(F.count(F.lit(1)).alias("with_breaks"))
    return breaks.select(F.lit(readers.count_records(spark, path)).cast("bigint").alias("records"), "with_breaks")


@query("""SELECT c_custkey::VARCHAR AS c_custkey, c_name || CASE c_custkey % 4 WHEN 0 THEN ' Zoë 中' WHEN 1 THEN ' €’é' WHEN 2 THEN ' é' || chr(129) ELSE ' plain' END AS label FROM customer""")
def csv_mixed_encodings(spark, sf):
    """A folder of files in UTF-8, windows-1252, ISO-8859-1 and ASCII, the bytes of each written as they are."""
    path, k = scratch_path(spark, ".csv"), F.col("c_custkey")
    tails = ["Zoë 中".encode(), "€’é".encode("cp1252"), "é\x81".encode("latin-1"), b"plain"]
    for i, tail in enumerate(tails):
        line = F.concat(k.cast("string").cast("binary"), F.lit(b","), F.col("c_name").cast("binary"), F.lit(b" " + tail)).cast("string")
        rows = table(spark, sf, "customer").filter(k % 4 == i).select(line.alias("value"), F.lit(1).alias("at"))
        head = spark.createDataFrame([("c_custkey,label", 0)], "value string, at int")
        head.unionByName(rows).coalesce(1).sortWithinPartitions("at").select("value").write.mode("append").text(path)
    return readers.read_delimited(spark, path)


@query("SELECT c_custkey::VARCHAR AS c_custkey, c_name, CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment END AS c_name_2, 4::INTEGER AS header_row FROM customer")
def grid_table(spark, sf):
    """A report whose table starts in its fourth line, with a title above, a repeated name and an unnamed blank column."""
    path, k = scratch_path(spark, ".csv"), F.col("c_custkey")
    cell = lambda c: F.coalesce(c.cast("string"), F.lit(""))                       # noqa: E731
    rows = table(spark, sf, "customer").select(k.alias("at"), F.concat_ws(",", cell(k), cell(F.col("c_name")), F.lit(""), cell(F.when(k % 2 == 0, F.col("c_mktsegment")))).alias("value"))
    top = spark.createDataFrame([(-4, "Customers,,,"), (-3, '"made, by hand",,,'), (-2, ",,,"), (-1, "c_custkey,c_name,,c_name")], "at long, value string")
    top.unionByName(rows).coalesce(1).sortWithinPartitions("at").select("value").write.text(path)
    grid = readers.raw_grid(spark, path, ",")
    header = readers.suggest_header_row(grid)
    return readers.table_from_grid(grid, header).drop("_position").withColumn("header_row", F.lit(header))


@query("""SELECT o_orderkey::VARCHAR AS o_orderkey, o_totalprice * 2 AS doubled, o_orderkey + o_custkey::DOUBLE AS added, NULL::DOUBLE AS bad, round(o_totalprice, 1) AS rounded,
    power(o_orderkey::DOUBLE, 2) AS squared, o_orderkey / 2 AS half FROM orders""")
def calc_on_text(spark, sf):
    """Arithmetic on a table whose every column is text."""
    df = readers.read_delimited(spark, _saved_csv(spark, sf))
    key, price = F.col("o_orderkey"), F.col("o_totalprice")
    made = {"doubled": f.MULTIPLY(price, 2), "added": f.ADD(key, F.col("code")), "bad": f.ADD(F.col("o_orderpriority"), 1), "rounded": f.ROUND(price, 1), "squared": f.POWER(key, 2)}
    for name, expression in made.items():
        df = columns.calculated_column(df, name, expression)
    return columns.calculated_column(df, "half", "o_orderkey / 2", infer=True).select("o_orderkey", *made, "half")


_PARTS_SQL = "SELECT o_orderkey, {} AS part FROM orders"


@query(_PARTS_SQL.format("regexp_replace(regexp_replace(o_orderpriority, '[^A-Za-z0-9_-]', '_', 'g'), '^_+|_+$', '', 'g')"))
def written_by_value(spark, sf):
    path = scratch_path(spark)
    sinks.write_split_by_value(table(spark, sf, "orders"), path, "o_orderpriority", ["o_orderkey"])
    return spark.read.parquet(path).select("o_orderkey", F.col("part").cast("string").alias("part"))


@query(_PARTS_SQL.format("CAST(floor((row_number() OVER (ORDER BY o_orderkey) - 1) / 700) + 1 AS INTEGER)"))
def written_by_rows(spark, sf):
    path = scratch_path(spark)
    sinks.write_split_by_rows(table(spark, sf, "orders"), path, 700, ["o_orderkey"])
    return spark.read.parquet(path).select("o_orderkey", "part")


@query("""SELECT 'keep' AS tool, (SELECT count(*) FROM orders) AS rows_in, count(*) AS rows_out, '{"above": 1000}' AS parameters FROM orders WHERE o_totalprice > 1000""")
def written_log(spark, sf):
    path, df = scratch_path(spark), table(spark, sf, "orders")
    sinks.write_with_log(df, df.filter("o_totalprice > 1000"), path, "keep", {"above": 1000, "password": "x"})
    return spark.read.schema(sinks.LOG_SCHEMA).json(f"{path}.log").select("tool", "rows_in", "rows_out", "parameters")


@query("""WITH t AS (SELECT event_type, event_id * 1000000007 + 1 AS big FROM events)
  SELECT event_type, sum(big)::BIGINT AS big FROM t GROUP BY event_type UNION ALL SELECT 'Total', sum(big)::BIGINT FROM t""")
def pivot_sum_whole(spark, sf):
    """Sums that a double cannot hold."""
    df = table(spark, sf, "events").select("event_type", (F.col("event_id") * 1000000007 + 1).alias("big"))
    return pivot.pivot_table(df, ["event_type"], None, ["big"], "sum").df


@query("""WITH t AS (SELECT l_linenumber, count(*) AS n FROM lineitem GROUP BY 1), o AS (SELECT l_linenumber::VARCHAR AS label, n, row_number() OVER (ORDER BY l_linenumber) AS place FROM t
    UNION ALL SELECT 'Total', sum(n), 1 + (SELECT count(*) FROM t) FROM t)
  SELECT label AS l_linenumber, n::BIGINT AS l_orderkey, place::BIGINT AS place FROM o""")
def pivot_numeric_rows(spark, sf):
    """Rows in number order; `place` is where the row stands in the result."""
    out = pivot.pivot_table(table(spark, sf, "lineitem"), ["l_linenumber"], None, ["l_orderkey"], "count").df
    return out.coalesce(1).withColumn("place", F.monotonically_increasing_id() + 1)


@query("SELECT event_id FROM events")
def filter_equals_nan(spark, sf):
    """A missing cell equals no text, so `not nan` keeps every row."""
    df = table(spark, sf, "events").withColumn("value", F.when(F.col("event_id") % 3 == 0, float("nan")).otherwise(F.col("value")))
    none = filters.row_filter(df, [{"column": "value", "operator": "equals", "value": "nan"}])
    return filters.row_filter(df, [{"column": "value", "operator": "not_equals", "value": "nan"}]).unionByName(none).select("event_id")


@query("""SELECT c_custkey, c_name, upper(c_mktsegment) AS c_mktsegment FROM customer WHERE c_acctbal >= 100""")
def stream_row_operators(spark, sf):
    base = scratch_path(spark)
    schema = table(spark, sf, "customer").schema

    def step(df):
        kept = filters.row_filter(df, [{"column": "c_acctbal", "operator": "greater_equal", "value": 100}])
        return cleaning.clean_text(kept, ["c_mktsegment"], ["trim"], "upper").df.select("c_custkey", "c_name", "c_mktsegment")
    stream.run_rows(stream.stream_table(spark, f"{sf}/customer.parquet*", schema), step, f"{base}/out", f"{base}/state").awaitTermination()
    return spark.read.parquet(f"{base}/out")


_CUSTOMER = ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"]
_GAPS = " + ".join(f"(count({n}) < count(*))::INTEGER" for n in _CUSTOMER)
_LARGEST_GAP = f"greatest({', '.join(f'count(*) - count({n})' for n in _CUSTOMER)})"


@query(f"""WITH d AS (SELECT count(*) AS n FROM (SELECT DISTINCT {', '.join(_CUSTOMER)} FROM customer)), s AS (SELECT count(*) AS n, {_GAPS} AS gaps, {_LARGEST_GAP} AS gap,
    count(DISTINCT c_custkey) AS keys FROM customer)
  SELECT fact, value FROM (SELECT unnest([
    {{'fact': 'rows', 'value': s.n::VARCHAR}}, {{'fact': 'columns', 'value': '{len(_CUSTOMER)}'}}, {{'fact': 'duplicate_rows', 'value': (s.n - d.n)::VARCHAR}},
    {{'fact': 'columns_with_gaps', 'value': gaps::VARCHAR}}, {{'fact': 'largest_gap', 'value': CASE WHEN gap > 0 THEN gap::VARCHAR END}},
    {{'fact': 'key', 'value': CASE WHEN keys = s.n THEN 'c_custkey' END}}, {{'fact': 'key_needs_dedup', 'value': CASE WHEN d.n < s.n THEN 'True' ELSE 'False' END}},
    {{'fact': 'transformations_applied', 'value': '1'}}, {{'fact': 'columns_transformed', 'value': '1'}}], recursive := true) FROM s, d)""")
def readiness_findings(spark, sf):
    return readiness.assess(table(spark, sf, "customer"), ["c_custkey"], ["c_custkey", "c_nationkey", "c_mktsegment"], anonymize_columns=["c_name"]).findings


@query("""SELECT * FROM (VALUES ('anonymization', 'high', 'c_name'), ('normalization', 'medium', 'joined')) v(type, priority, "column")""")
def readiness_recommendations(spark, sf):
    df = table(spark, sf, "customer").withColumn("joined", F.date_format(F.date_add(F.lit("2020-01-01").cast("date"), (F.col("c_custkey") % 900).cast("int")), "yyyy-MM-dd"))
    return readiness.assess(df, ["c_custkey"], search_keys=False).recommendations.drop("reason")
