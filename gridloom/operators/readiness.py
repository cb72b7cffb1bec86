"""Data readiness: profile, gaps, keys, recommendations and anonymization as one job over a table."""
from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.cells import is_text, type_of
from ..session import written
from .anonymize import anonymize, verify_anonymized
from .keys import KeyReport, find_keys
from .profile import (completeness, gap_summary, infer_types, key_closeness, profile_columns, saved_value_counts, semantic_types,
                      sensitive_columns, table_overview)
from .result import Result

ACCEPTABLE, ATTENTION = "acceptable", "needs_attention"
TO_NORMALIZE = ("Integer", "Date", "Currency")      # semantic types that text columns should be converted to


@dataclass
class Readiness:
    overview: DataFrame
    columns: DataFrame
    types: DataFrame
    gaps: DataFrame
    closeness: DataFrame
    keys: KeyReport | None
    sensitive: list[tuple[str, str]]
    recommendations: DataFrame
    findings: DataFrame
    result: DataFrame
    mapping: DataFrame | None = None
    log: list[dict] = field(default_factory=list)


def recommend(df: DataFrame, types: DataFrame, basics: DataFrame, triage: dict[str, str] | None = None) -> DataFrame:
    """(type, priority, column, reason): anonymize sensitive names, normalize text that holds another type, handle the
    gaps that were marked as needing attention. Works on one row per column."""
    schema = "type string, priority string, column string, reason string"
    spark = df.sparkSession
    rows = [("anonymization", "high", n, f"the name contains '{p}'") for n, p in sensitive_columns(df.columns)]
    texts = [n for n in df.columns if is_text(type_of(df, n))]
    found = spark.createDataFrame(rows, schema)
    normalize = types.filter(F.col("column").isin(texts) & F.col("detected_type").isin(*TO_NORMALIZE)).select(
        F.lit("normalization").alias("type"), F.lit("medium").alias("priority"), "column",
        F.concat(F.lit("text that holds "), F.lower("detected_type"), F.lit(" values")).alias("reason"))
    marked = [n for n, decision in (triage or {}).items() if decision == ATTENTION]
    gaps = basics.filter(F.col("column").isin(marked) if marked else F.lit(False)).select(
        F.lit("gap_handling").alias("type"), F.lit("medium").alias("priority"), "column",
        F.concat(F.col("null_count").cast("string"), F.lit(" missing values")).alias("reason"))
    return found.unionByName(normalize).unionByName(gaps)


def findings(overview: DataFrame, gaps: DataFrame, keys: KeyReport | None, log: list[dict]) -> DataFrame:
    """(fact, value) rows: size, columns with gaps, the largest gap, copies, the key, and what was applied."""
    facts = overview.select(F.explode(F.array(
        F.struct(F.lit("rows").alias("fact"), F.col("rows").cast("string").alias("value")),
        F.struct(F.lit("columns").alias("fact"), F.col("columns").cast("string").alias("value")),
        F.struct(F.lit("duplicate_rows").alias("fact"), F.col("duplicate_rows").cast("string").alias("value")))).alias("f")).select("f.*")
    worst = gaps.agg(F.count(F.lit(1)).alias("n"), F.max_by("column", "null_percentage").alias("column")).select(F.explode(F.array(
        F.struct(F.lit("columns_with_gaps").alias("fact"), F.col("n").cast("string").alias("value")),
        F.struct(F.lit("largest_gap").alias("fact"), F.col("column").alias("value")))).alias("f")).select("f.*")
    more = []
    if keys is not None:
        found = keys.keys or keys.keys_after_dedup
        more.append(("key", " + ".join(found[0]) if found else None))
        more.append(("key_needs_dedup", str(bool(keys.duplicate_rows and found))))
    applied = [e for e in log if e["status"] == "applied"]
    more.append(("transformations_applied", str(len(applied))))
    more.append(("columns_transformed", str(sum(len(e["columns"]) for e in applied))))
    return facts.unionByName(worst).unionByName(overview.sparkSession.createDataFrame(more, "fact string, value string"))


def assess(df: DataFrame, order_by=None, key_columns: list[str] | None = None, allow_missing_keys: bool = False,
           triage: dict[str, str] | None = None, anonymize_columns: list[str] | None = None,
           normalize_columns: list[str] | None = None, gap_columns: list[str] | None = None, search_keys: bool = True, **key_limits) -> Readiness:
    """Analyze, find keys, recommend, and carry out the chosen steps.

    Only anonymization changes data; normalization and gap handling are recorded in the log as not applied."""
    typed = infer_types(df)
    basics = written(profile_columns(typed, saved_value_counts(typed, order_by=order_by)))
    types = written(semantic_types(typed, order_by=order_by, basics=basics))
    gaps = gap_summary(basics)
    keys = find_keys(df, key_columns, allow_missing_keys, **key_limits) if search_keys else None
    log, result, mapping = [], df, None
    if anonymize_columns:
        done: Result = anonymize(df, anonymize_columns, order_by=order_by, short_prefix=True)
        result, mapping = done.df, done.side("mapping")
        verify_anonymized(df, result, anonymize_columns, mapping)
        log.append({"type": "anonymization", "columns": list(anonymize_columns), "status": "applied"})
    for kind, columns in (("normalization", normalize_columns), ("gap_handling", gap_columns)):
        if columns:
            log.append({"type": kind, "columns": list(columns), "status": "recorded, not applied"})
    share = completeness(basics).first().completeness
    overview = table_overview(typed, types).withColumn("completeness", F.lit(share))
    return Readiness(overview, basics, types, gaps, key_closeness(basics), keys, sensitive_columns(df.columns),
                     recommend(df, types, basics, triage), findings(overview, gaps, keys, log), result, mapping, log)
