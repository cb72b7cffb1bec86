"""Connected components of a table of links, as joins and aggregates."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import written


def connected(links: DataFrame, a: str, b: str) -> DataFrame:
    """One row (node, root) for each node of `links`; nodes of one component have one root, the smallest of them.

    Each round, every node points to its smallest neighbour if that is smaller; chains of such pointers are shortened
    to their ends, and links are carried over to the ends. Links inside one end go, so the table shrinks until none is
    left. Minima combine before the shuffle, so a node with a third of all links is one row for each task; joins on it
    can be split, because the other side has one row a key. Every step is a table in the shared folder.
    NULL ends are no links. Repeated links and links of a node with itself change nothing."""
    spark = links.sparkSession
    edges = written(links.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u is not null and v is not null").distinct())
    roots = written(edges.select("u").union(edges.select("v")).distinct().select(F.col("u").alias("node"), F.col("u").alias("root")))
    edges = edges.where("u <> v")
    while not edges.isEmpty():
        both = edges.union(edges.select("v", "u"))
        up = written(both.groupBy("u").agg(F.min("v").alias("v")).where("v < u"))          # u points to v
        while True:
            end = up.select(F.col("u").alias("w"), F.col("v").alias("x"))
            longer = written(up.join(end, up.v == end.w, "left").select("u", F.coalesce("x", "v").alias("v"), F.col("x").isNotNull().alias("moved")))
            up = longer.select("u", "v")
            if longer.where("moved").isEmpty():
                break
        to = lambda df, key: df.join(up.select(F.col("u").alias("old"), F.col("v").alias("new")), F.col(key) == F.col("old"), "left")
        roots = written(to(roots, "root").select("node", F.coalesce("new", "root").alias("root")))
        edges = to(edges, "u").select(F.coalesce("new", "u").alias("u"), "v")
        edges = to(edges, "v").select("u", F.coalesce("new", "v").alias("v"))
        edges = written(edges.where("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct())
    return roots
