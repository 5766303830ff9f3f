"""Frequency sketches as tables: mergeable by adding, queried by joins."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession, functions as F


def count_min(df: DataFrame, item: str, width: int = 2048, depth: int = 4) -> DataFrame:
    """The sketch as (row, slot, n): at most width x depth rows whatever the input; merge by summing n."""
    rows = F.explode(F.sequence(F.lit(0), F.lit(depth - 1)))
    # items are counted first, so each distinct item is hashed once per row
    counts = df.groupBy(F.col(item).cast("string").alias("item")).agg(F.count(F.lit(1)).alias("n"))
    return counts.select("item", "n", rows.alias("row")).groupBy("row", F.pmod(F.xxhash64("item", "row"), F.lit(width)).alias("slot")).agg(F.sum("n").alias("n"))


def estimate(sketch: DataFrame, items: DataFrame, item: str, width: int = 2048, depth: int = 4) -> DataFrame:
    """(item, estimate) for each row of `items`; never below the true count. The sketch is bounded, so it is broadcast."""
    asked = items.select(F.col(item).cast("string").alias("item")).distinct().select("item", F.explode(F.sequence(F.lit(0), F.lit(depth - 1))).alias("row"))
    found = asked.withColumn("slot", F.pmod(F.xxhash64("item", "row"), F.lit(width))).join(F.broadcast(sketch), ["row", "slot"], "left")
    return found.groupBy("item").agg(F.min(F.coalesce("n", F.lit(0))).alias("estimate"))


def top_codes(df: DataFrame, item: str, k: int = 10) -> DataFrame:
    """The k most frequent items, exactly; ties in item order."""
    return df.groupBy(F.col(item).alias("item")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "item").limit(k)


def approx_top_codes(df: DataFrame, item: str, k: int = 10, tracked: int = 10_000) -> DataFrame:
    """The k most frequent items by Spark's mergeable heavy-hitter sketch: one pass, no shuffle of items."""
    return df.agg(F.expr(f"approx_top_k({item}, {k}, {tracked})").alias("t")).select(F.explode("t").alias("t")).select(F.col("t.item").alias("item"), F.col("t.count").alias("n"))


class StoredSketches:
    """Sketches of an item by slice of time (an hour by default), kept as a table in a folder: count-min rows and
    Spark's heavy-hitter sketches.

    A slice is sketched once, from its own rows; what any span of slices asks for is merged from the stored sketches and
    does not read a row again. Count-min rows add up, so a span's estimates are those of one sketch over all its rows: never too
    low, and too high by over 2 x rows / width with a probability of at most 2^-depth. Heavy hitters are exact while a slice and the span
    have at most `tracked` different items; beyond that a count may be short by as much as the sketch's error."""

    def __init__(self, spark: SparkSession, at: str, *, width: int = 2048, depth: int = 4, tracked: int = 10_000, seconds: int = 3600):
        self.spark, self.at, self.width, self.depth, self.tracked, self.seconds = spark, at, width, depth, tracked, seconds

    def add(self, df: DataFrame, *, ts: str, item: str) -> None:
        """Sketch the slices of these rows. The rows of a slice come in one call; a slice that comes again is replaced."""
        part = F.floor(F.unix_seconds(F.col(ts).cast("timestamp")) / self.seconds)
        slim = df.filter(F.col(ts).isNotNull() & F.col(item).isNotNull()).select(part.alias("slice"), F.col(item).cast("string").alias("item"))
        counts = slim.groupBy("slice", "item").agg(F.count(F.lit(1)).alias("n"))
        row = F.explode(F.sequence(F.lit(0), F.lit(self.depth - 1)))
        slots = counts.select("slice", "item", "n", row.alias("row")).groupBy("slice", "row", F.pmod(F.xxhash64("item", "row"), F.lit(self.width)).alias("slot")).agg(F.sum("n").alias("n"))
        top = slim.groupBy("slice").agg(F.expr(f"approx_top_k_accumulate(item, {self.tracked})").alias("sketch"))
        for name, part in (("slots", slots), ("top", top)):
            # a slice's sketch is at most width x depth rows, or one
            part.repartition("slice").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("slice").parquet(f"{self.at}/{name}")

    def _between(self, name: str, first: dt.datetime, last: dt.datetime) -> DataFrame:
        """The sketches of the slices from that of `first` to that of `last`; the files of others are not opened."""
        low, high = (int(t.replace(tzinfo=dt.timezone.utc).timestamp() // self.seconds) for t in (first, last))
        return self.spark.read.parquet(f"{self.at}/{name}").filter(F.col("slice").between(low, high))

    def count_min(self, first: dt.datetime, last: dt.datetime) -> DataFrame:
        """(row, slot, n) of a span, as `estimate` takes it."""
        return self._between("slots", first, last).groupBy("row", "slot").agg(F.sum("n").alias("n"))

    def top(self, first: dt.datetime, last: dt.datetime, k: int = 10) -> DataFrame:
        """(item, n): the k most frequent items of a span."""
        merged = self._between("top", first, last).agg(F.expr(f"approx_top_k_combine(sketch, {self.tracked})").alias("sketch"))
        found = merged.select(F.explode(F.expr(f"approx_top_k_estimate(sketch, {k})")).alias("t"))
        return found.select(F.col("t.item").alias("item"), F.col("t.count").alias("n"))
