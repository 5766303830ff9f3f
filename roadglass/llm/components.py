"""Connected components over an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import cut, skew_join


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of `edges` (columns a, b, of one orderable type); root is the component's
    smallest node. Every star is a table of its own, so that no plan holds another one several times over, and the loop
    ends when a round of both changes nothing."""

    def stars(e: DataFrame, large: bool) -> DataFrame:
        ends = F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))
        both = e.select(F.explode(ends).alias("e")).select("e.a", "e.b")
        seen = both if large else both.filter("b < a")
        least = seen.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        joined = skew_join(seen.filter("b > a") if large else seen, least, ["a"])
        out = joined.select(F.col("b").alias("a"), F.col("m").alias("b"))
        if not large:  # the centre itself hangs on the smallest neighbour, too
            out = out.unionByName(least.select("a", F.col("m").alias("b")))
        return out.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()

    def mark(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    current = cut(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    before = mark(current)
    for k in range(max_rounds):
        if not before[0]:
            break
        current = cut(stars(cut(stars(current, True), f"large-{k}"), False), f"stars-{k}")
        now = mark(current)
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components did not settle")
    roots = current.select("b").distinct()
    return current.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots.select(F.col("b").alias("node"), F.col("b").alias("root")))
