"""Time the headline queries: BENCH_SF_DIR (tables) and BENCH_CPUS (threads) choose the run; prints one JSON line.

line choose queries, and then no cases are run.

Each query and case has a session of its own and runs twice, to the end, into a sink that discards the rows. The second run is reported.
"""
from __future__ import annotations

import json
import os
import sys
import tempfile
import time
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom import suite
from gridloom.operators import cleaning, compare, dedupe, fill, group, keys, pivot, profile, reshape, sorting, validate
from gridloom.session import build_session, release_scratch
from gridloom.sources.synthetic import synthetic_table

QUERIES = [
    "row_filter_then_group", "text_clean", "text_without_accents", "find_replace_regex", "normalize_date", "calc_math",      # rows
    "profile_columns", "profile_numeric", "profile_top_values", "semantic_types",                                            # analyze
    "dup_groups", "dup_members", "remove_duplicates_first", "remove_duplicates_complete", "exact_copies",                    # duplicates
    "minimal_keys", "unique_id", "pseudonyms", "pseudonyms_related",                                                         # keys
    "pivot_sum", "pivot_median", "pivot_nunique", "group_all_functions", "unpivot_text", "append",                           # group, reshape
    "validate_rows", "validate_summary", "compare_status", "compare_summary",                                                # check
    "merge_inner", "merge_outer", "merge_keep_first", "merge_stats",                                                         # merge
    "fill_previous", "fill_next", "fill_median", "fill_mode", "sort_rank", "sort_rank_within", "every_nth", "top_n", "split_by_rows",     # order
    "recipe_replay",
]


# The published cases of the table being matched: rows of the 15-column synthetic table, and the operation.
def reference_cases(spark) -> dict[str, tuple[int, Callable[[DataFrame], DataFrame]]]:
    key, row, values = ["id"], ["row"], ["amount", "status"]
    changed = lambda df: df.withColumn("amount", F.when(F.substring("id", -1, 1) == "7", F.col("amount") + 1).otherwise(F.col("amount")))
    rules = [{"column": "email", "type": "required"}, {"column": "amount", "type": "range", "value": {"min": 0, "max": 40000}}, {"column": "qty", "type": "numeric"}]
    twelve = ["first_name", "last_name", "invoice_date", "amount", "qty", "category", "region", "status", "zip", "vendor_code", "phone", "discount"]
    listed = lambda found: spark.createDataFrame([(" + ".join(k),) for k in found.keys], "key string")
    return {
        "analyze_500k": (500_000, lambda df: profile.profile_columns(df).select("column").unionByName(profile.profile_numeric(df).select("column"))
                         .unionByName(profile.top_values(df, order_by=row).select("column")).unionByName(profile.semantic_types(df, order_by=row).select("column"))),
        "dup_lowcard_100k": (100_000, lambda df: dedupe.duplicate_groups(df, "id", ["first_name", "last_name", "category"], order_by=row)),
        "dup_highcard_100k": (100_000, lambda df: dedupe.duplicate_groups(df, "id", ["first_name", "last_name", "invoice_date"], order_by=row)),
        "uniqueid12_100k": (100_000, lambda df: listed(keys.find_minimal_keys(df, twelve, max_size=5, max_keys=10, max_candidates=20_000, seconds=30))),       # the published limits
        "uniqueid12_all_100k": (100_000, lambda df: listed(keys.find_minimal_keys(df, twelve))),                                                                # none
        "pivot_500k": (500_000, lambda df: pivot.pivot_table(df, ["region", "category"], ["status"], ["amount"], "sum").df),
        "pivot_hi_500k": (500_000, lambda df: pivot.pivot_table(df, ["zip"], ["status"], ["amount"], "sum").df),
        "validate_500k": (500_000, lambda df: validate.validate(df, rules).side("invalid")),
        "compare1key_100k": (100_000, lambda df: compare.compare_tables(df, changed(df), key, values, row, row).status()),
        "text_clean_200k": (200_000, lambda df: cleaning.clean_text(df, ["first_name", "last_name"], ["trim", "collapse", "accents"], "upper").df),
        "fill_previous_200k": (200_000, lambda df: fill.fill_missing(df, ["notes", "discount", "zip"], "previous", flag=True, order_by=row).df),
        "fill_next_200k": (200_000, lambda df: fill.fill_missing(df, ["notes", "discount", "zip"], "next", flag=True, order_by=row).df),
        "fill_median_200k": (200_000, lambda df: fill.fill_missing(df, ["discount"], "median").df),
        "dedupe_complete_200k": (200_000, lambda df: dedupe.remove_duplicates(df, ["region", "category"], "most_complete", order_by=row).df),
        "dedupe_whole_row_200k": (200_000, lambda df: dedupe.remove_duplicates(df, order_by=row).df),
        "sort_rank_within_200k": (200_000, lambda df: sorting.rank_rows(df, ["status", "amount"], "region", row)),
        "unpivot_200k": (200_000, lambda df: reshape.unpivot(df, ["id", "region"], ["amount", "qty", "discount"]).df),
        "group_4_200k": (200_000, lambda df: group.group_summary(df, ["region"], ["amount", "qty", "discount"], ["sum", "mean"])),
        "group_2000_200k": (200_000, lambda df: group.group_summary(df, ["vendor_code", "region"], ["amount"], ["sum", "mean", "median", "min", "max"])),
        "append_3x200k": (200_000, lambda df: reshape.append_tables([("a", df), ("b", df), ("c", df)]).df),
    }


def session(threads: str):
    spark = build_session("bench", f"local[{threads}]", **{"spark.sql.shuffle.partitions": threads, "spark.driver.memory": "12g"})
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def timed(threads: str, run: Callable[..., DataFrame]) -> float:
    """Seconds of the second of two runs in a session of its own, so that no case pays for what others left behind."""
    spark = session(threads)
    try:
        for _ in range(2):
            start = time.perf_counter()
            run(spark).write.format("noop").mode("overwrite").save()
            seconds = round(time.perf_counter() - start, 3)
        release_scratch(spark)
    finally:
        spark.stop()
    return seconds


def time_cases(threads: str) -> dict[str, float]:
    folder = tempfile.mkdtemp(prefix="bench-")
    spark = session(threads)
    for rows in sorted({rows for rows, _ in reference_cases(spark).values()}):
        synthetic_table(spark, rows).withColumn("row", F.substring("id", 4, 20).cast("bigint")).write.parquet(f"{folder}/{rows}")
    names = list(reference_cases(spark))
    spark.stop()

    def case(name):
        def run(spark):
            rows, operation = reference_cases(spark)[name]
            return operation(spark.read.parquet(f"{folder}/{rows}"))
        return run
    return {name: timed(threads, case(name)) for name in names}


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    threads = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or QUERIES
    seconds = {name: timed(threads, lambda spark, run=suite.QUERIES[name]: run(spark, folder)) for name in names}
    cases = {} if sys.argv[1:] else time_cases(threads)
    print(json.dumps({"metric": "total_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": folder.rsplit("sf", 1)[-1],
                      "reference_cases": cases}))


if __name__ == "__main__":
    main()
