"""Writes that can be repeated: idempotent appends, snapshots and fan-out. Each is a DataFrame first, so a batch query,
a stream's foreachBatch and a test use the same rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def fresh_rows(new: DataFrame, existing: DataFrame, keys: list[str]) -> DataFrame:
    """The rows of `new` that an append may write: one for each key, none whose key is there already.

    These are also what a "returning" clause would give. Within `new` the first row in column order wins."""
    rest = [c for c in new.columns if c not in keys]
    single = new.groupBy(*keys).agg(F.min(F.struct(*rest)).alias("_r")).select(*keys, "_r.*") if rest else new.distinct()
    return single.join(existing.select(*keys), keys, "left_anti").select(*new.columns)


def upserted(existing: DataFrame, new: DataFrame, key: str, newest: str | None = None) -> DataFrame:
    """The snapshot after an upsert: rows of `new` replace rows of `existing` with their key (copy on write). Of several new
    rows of a key the one with the largest `newest` is taken, by default the largest in column order."""
    rest = [c for c in new.columns if c != key]
    by = F.struct(*([newest] if newest else []), *rest)
    single = new.groupBy(key).agg(F.max_by(F.struct(*rest), by).alias("_r")).select(key, "_r.*").select(*new.columns)
    return existing.join(new.select(key), key, "left_anti").unionByName(single)


def audit_rows(actions: DataFrame, *, actor: Column, action: str, resource: Column, detail: Column) -> DataFrame:
    """Append-only audit rows for a table of actions."""
    return actions.select("tenant_id", actor.alias("actor"), F.lit(action).alias("action"), resource.alias("resource"), detail.alias("detail"))


def write_by_hour(events: DataFrame, path: str, ts: str = "ts", drop: bool = False) -> None:
    """Append telemetry partitioned by day and hour; within a partition files are sorted for row-group skipping.

    Rows are rebalanced by hour: adaptive execution splits a shuffle partition with a hot hour over several tasks and puts
    small ones together. An hour has one file, but for hot hours and those that share their shuffle partition, which
    have one for each task of it. With `drop` the time itself is not written."""
    t = F.col(ts).cast("timestamp")
    placed = events.withColumn("d", F.to_date(t)).withColumn("h", F.hour(t))
    placed = placed.hint("rebalance", "d", "h").sortWithinPartitions("d", "h", "vin", ts)
    (placed.drop(ts) if drop else placed).write.mode("append").partitionBy("d", "h").parquet(path)


def write_fan_out(alerts: DataFrame, path: str) -> None:
    """One folder for each tenant's new alerts."""
    alerts.write.mode("append").partitionBy("tenant_id").parquet(path)
