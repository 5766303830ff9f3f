"""Trips from speeds, and nearest reachable targets in a road graph."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F, types as T

from ..session import shared_folder

SWITCH = 2.5


def moving_labels(speeds: np.ndarray, switch: float = SWITCH) -> np.ndarray:
    """The cheapest 0/1 path: standing costs v/5, moving costs (5 - v)/5 but not below 0, a switch costs `switch`.

    A tie stays, and the last sample stands on a tie. Only the difference of the two costs is carried."""
    stand = speeds / 5.0
    gain = stand - np.maximum(0.0, (5.0 - speeds) / 5.0)
    n = len(speeds)
    swap = np.zeros((n, 2), bool)
    lead = gain[0]  # cost of standing minus cost of moving
    for i in range(1, n):
        swap[i] = lead > switch, -lead > switch
        lead = min(max(lead, -switch), switch) + gain[i]
    out, state = np.zeros(n, np.int32), int(lead > 0)
    for i in range(n - 1, -1, -1):
        out[i] = state
        if swap[i, state]:
            state = 1 - state
    return out


def trip_segments(df: DataFrame, *, key: str, day: str, order: str, speed: str) -> DataFrame:
    """Samples labelled moving (1) or standing (0), numbered per vehicle and day: (key, day, order, position, moving).

    Spark deals the days of vehicles out and sorts them; a task walks its rows in Arrow batches and holds one day of
    one vehicle at a time. A null speed counts as standing still."""

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def labelled(t: pa.Table) -> pa.RecordBatch:
            first = t.column(3).to_numpy().astype(bool)
            first[:1] = True
            speeds = t.column(4).to_numpy()
            starts = np.flatnonzero(first)
            ends = [*starts[1:].tolist(), len(first)]
            moving = [moving_labels(speeds[a:b]) for a, b in zip(starts.tolist(), ends, strict=True)]
            place = np.arange(len(first)) - np.repeat(starts, np.diff([*starts, len(first)]))
            moving = np.concatenate(moving) if moving else np.zeros(0, np.int32)
            return pa.Table.from_arrays([t.column(0), t.column(1), t.column(2), pa.array(place), pa.array(moving)], names).combine_chunks().to_batches()

        names, held = [key, day, order, "position", "moving"], None
        for batch in batches:
            t = pa.Table.from_batches([batch])
            held = t if held is None else pa.concat_tables([held, t])
            starts = np.flatnonzero(held.column(3).to_numpy())
            if len(starts) and starts[-1] > 0:  # what comes before the last day is whole
                yield from labelled(held.slice(0, starts[-1]))
                held = held.slice(starts[-1])
        if held is not None and held.num_rows:
            yield from labelled(held)

    slim = df.select(key, day, order, F.coalesce(F.col(speed).cast("double"), F.lit(0.0)).alias("_v"))
    w = Window.partitionBy(key, day).orderBy(order)
    marked = slim.withColumn("_first", F.row_number().over(w) == 1).select(key, day, order, "_first", "_v")
    kinds = slim.schema
    out = T.StructType([kinds[key], kinds[day], kinds[order], T.StructField("position", T.LongType()), T.StructField("moving", T.IntegerType())])
    return marked.mapInArrow(label, out)


def nearest_target(edges: DataFrame, sources: DataFrame, targets: DataFrame, *, max_cost: float, max_rounds: int | None = None) -> DataFrame:
    """For every source the nearest target within `max_cost` (equal allowed): source, target, cost, path.

    A wave starts from all targets at once and runs against the edges (src, dst, cost >= 0). A node has one label, however
    many sources there are: what the way to its nearest target costs, which target that is, how many edges, and the next
    node. Ties go to the smaller target, then to fewer edges, then to the smaller next node. Only nodes whose label
    got better pass it on; when none does, the sources' paths are read off by following the next nodes. A bound on the rounds
    of the wave raises when it is hit. Each round is a table in the shared checkpoint folder."""
    spark = edges.sparkSession

    def cut(df: DataFrame) -> DataFrame:
        path = shared_folder(spark, "paths")
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    goals = targets.select("node").filter("node IS NOT NULL").distinct()
    label = ["cost", "target", "hops", "next"]
    labels = cut(goals.select("node", F.lit(0.0).alias("cost"), F.col("node").alias("target"), F.lit(0).alias("hops"), F.lit(None).cast(goals.schema["node"].dataType).alias("next"), F.lit(0).alias("round")))
    for k in count(1):
        front = labels.filter(F.col("round") == k - 1).select(F.col("node").alias("_to"), *[F.col(c).alias(f"_{c}") for c in label])
        if front.isEmpty():
            break
        if max_rounds is not None and k > max_rounds:
            raise RuntimeError(f"labels still get better after {max_rounds} rounds")
        offered = edges.join(front, edges["dst"] == front["_to"]).select(F.col("src").alias("node"), (F.col("cost") + F.col("_cost")).alias("cost"), F.col("_target").alias("target"), (F.col("_hops") + 1).alias("hops"), F.col("dst").alias("next"))
        offered = offered.filter(F.col("cost") <= max_cost).groupBy("node").agg(F.min(F.struct(*label)).alias("l")).select("node", "l.*", F.lit(k).alias("round"))
        # on a tie of all but the round the older label stays, so that it is not passed on again
        labels = cut(labels.unionByName(offered).groupBy("node").agg(F.min(F.struct(*label, "round")).alias("l")).select("node", "l.*"))

    asked = sources.select(F.col("node").alias("source")).distinct()
    at = labels.select(F.col("node").alias("_at"), "next")
    ways = asked.join(labels, asked["source"] == labels["node"]).select("source", "target", "cost", F.array("source").alias("path"), F.col("next").alias("_next"))
    done, ways = [], cut(ways)
    while not ways.isEmpty():
        done.append(ways.filter("_next IS NULL").drop("_next"))
        ways = ways.filter("_next IS NOT NULL").withColumn("path", F.concat("path", F.array("_next")))
        ways = cut(ways.join(at, ways["_next"] == at["_at"]).select("source", "target", "cost", "path", F.col("next").alias("_next")))
    empty = ways.drop("_next")
    return reduce(DataFrame.unionByName, done, empty).select("source", "target", "cost", F.array_join("path", "-").alias("path"))
