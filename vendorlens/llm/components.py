"""Connected components of an edge table by alternating large and small stars."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vendorlens.llm.tables import release, stored


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """``edges`` (a, b) with a > b. Large: every larger neighbour of a node points to the least of the
    node and its neighbours. Small: the node and its smaller neighbours point to the least of them."""
    if large:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        out = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        least = edges.groupBy("a").agg(F.min("b").alias("m"))
        out = edges.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(
            least.select("a", F.col("m").alias("b")))
    return out.where("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b); the root is the least node of the component. Each
    round is stored, and the rounds end when the edges no longer change; nothing is collected but sums."""
    def state(table):
        return table.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()

    current = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = state(current)
    while True:
        last, current = current, stored(_star(_star(current, True), False))
        release(last)
        now = state(current)
        if now == before:
            break
        before = now
    return current.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
        current.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
