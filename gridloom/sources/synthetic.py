"""The synthetic benchmark table: 15 mixed columns, made by Spark in parallel from a seed."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Own words; only how many of them there are matters for the size of groups.
FIRST_NAMES = [f"{a}{b}" for a in ("Al", "Ber", "Cor", "Dan", "El") for b in ("a", "in", "ou")]
LAST_NAMES = [f"{a}{b}" for a in ("Dor", "Fell", "Gran") for b in ("by", "ham", "ton", "wick")]
CATEGORIES = ["bolts", "cables", "drills", "gears", "lamps", "pumps"]
REGIONS = ["east", "north", "south", "west"]
STATUSES = ["closed", "held", "open", "sent"]
NOTES = ["fragile", "heavy", "late", "wet"]


def synthetic_table(spark: SparkSession, rows: int, seed: int = 42) -> DataFrame:
    """Deterministic: every cell is a hash of the seed, the column and the row number."""
    def chance(column: str) -> Column:
        return F.pmod(F.xxhash64(F.lit(seed), F.lit(column), F.col("i")), F.lit(1 << 30)) / F.lit(float(1 << 30))

    def whole(column: str, low: int, high: int) -> Column:
        return (F.floor(chance(column) * (high - low)) + low).cast("bigint")

    def pick(column: str, words: list[str]) -> Column:
        return F.get(F.array(*[F.lit(w) for w in words]), whole(column, 0, len(words)).cast("int"))
    first, last = pick("first", FIRST_NAMES), pick("last", LAST_NAMES)
    text = lambda c: c.cast("string")
    return spark.range(rows).withColumnRenamed("id", "i").select(
        F.concat(F.lit("PR-"), F.lpad(text(F.col("i")), 7, "0")).alias("id"), first.alias("first_name"), last.alias("last_name"),
        F.concat(F.lower(first), F.lit("."), F.lower(last), text(F.col("i")), F.lit("@example.com")).alias("email"),
        F.concat(F.lit("555-"), text(whole("phone1", 100, 999)), F.lit("-"), text(whole("phone2", 1000, 9999))).alias("phone"),
        F.date_format(F.date_add(F.lit("2023-01-01").cast("date"), whole("date", 0, 730).cast("int")), "yyyy-MM-dd").alias("invoice_date"),
        F.round(chance("amount") * 49990 + 10, 2).alias("amount"), whole("qty", 1, 50).alias("qty"),
        pick("category", CATEGORIES).alias("category"), pick("region", REGIONS).alias("region"), pick("status", STATUSES).alias("status"),
        F.lpad(text(whole("zip", 1000, 99999)), 5, "0").alias("zip"),
        F.when(chance("d0") >= 0.3, F.round(chance("discount") * 0.3, 3)).alias("discount"),
        F.when(chance("n0") >= 0.6, pick("notes", NOTES)).alias("notes"),
        F.concat(F.lit("V"), F.lpad(text(whole("vendor", 0, 500)), 4, "0")).alias("vendor_code"))
