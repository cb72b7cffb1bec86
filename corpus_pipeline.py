"""From documents to packed sequences: quality rules, near-duplicates, benchmark passages, personal data, packing.

Each stage takes all documents that its predecessor kept, as a table, and returns those that go on, with the columns of
`documents`; the last returns the place of every piece. A document is a doc_id, or none, with a text, and the two stages in
the middle drop by (the hash of) both. Repeated rows are one document: near-duplicate removal leaves one of them, also of
those without a doc_id. Of a group it leaves the smallest doc_id, a row without one only if no other has one. Columns are taken by position, so other columns and names that differ in case only pass unchanged.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm import decontaminate, near_dup, packing, pii, quality
from gridloom.llm.frames import table, without_ids
from gridloom.session import written

POLICY = "v1"
ORACLE_SQL = None           # tokenizing and component search are not SQL; tests compare run() with a brute-force version


def _plain(docs: DataFrame) -> DataFrame:
    return docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])


def _column(docs: DataFrame, name: str) -> str:
    return f"c{docs.columns.index(name)}"


def _keyed(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """`docs` with columns by position and `row`, the key of the document; and the texts with that key as doc_id."""
    key, text = F.col(_column(docs, "doc_id")).cast("bigint"), F.col(_column(docs, "text"))
    keyed = _plain(docs).withColumn("row", F.xxhash64(key.isNull(), key, text.isNull(), text))
    return keyed, keyed.select(F.col("row").alias("doc_id"), text.alias("text"))


def quality_rules(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents that fail no rule of the policy."""
    plain = _plain(docs)
    return quality.ledger(plain, _column(docs, "text")).where(quality.passes(POLICY)).select(*plain.columns).toDF(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    keyed, texts = _keyed(docs)
    found = written(near_dup.near_duplicates(texts).groupBy(F.col("doc_id").alias("row")).agg(F.first("component_id").alias("component"), F.count("*").alias("n")))
    groups = found.groupBy("component").count().where("count > 1").select("component")
    ids = keyed.select("row", F.col(_column(docs, "doc_id")).cast("bigint").alias("id"))
    members = written(ids.join(found.join(groups, "component").select("row", "component"), "row"))
    order = F.struct(F.col("id").isNull(), "id", "row")
    first = members.groupBy("component").agg(F.min(order)["row"].alias("first"))
    left = without_ids(keyed, "row", members.join(first, "component").where("row <> first").select("row"))
    again = written(found.where("n > 1").select(F.col("row").alias("again")))
    if not again.isEmpty():
        same = F.col("row") == F.col("again")
        left = left.join(again, same, "left_anti").union(left.join(again, same, "left_semi").dropDuplicates(["row"]))
    return left.drop("row").toDF(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents that hold no passage of the benchmark."""
    keyed, texts = _keyed(docs)
    found = decontaminate.contaminated(texts, table(spark, folder, "benchmark"))
    return without_ids(keyed, "row", found.where("contaminated").select("doc_id")).drop("row").toDF(*docs.columns)


def personal_data(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """All documents, personal data replaced by its kind; n_chars follows the text."""
    plain = _plain(docs)
    text = _column(docs, "text")
    out = pii.masked(plain, text)
    if "n_chars" in docs.columns:
        size = _column(docs, "n_chars")
        out = out.withColumn(size, F.length(text).cast(plain.schema[size].dataType))
    return out.toDF(*docs.columns)


def best_fit_packing(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """The place of every piece of every document."""
    return packing.packed(docs)


STAGES = [("quality_rules", quality_rules), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("personal_data", personal_data),
          ("best_fit_packing", best_fit_packing)]


def run(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, folder))
    return STAGES[-1][1](spark, docs, folder)
