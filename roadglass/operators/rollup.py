"""Mergeable daily rollup of telemetry, its incremental upkeep, and retention."""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..sources.ledger import Ledger, names, remove

#: How each measure of two partial rollups of a key and day is merged.
MERGE = {"events": F.sum, "min_odo": F.min, "max_odo": F.max, "sum_speed": F.sum, "max_coolant": F.max, "min_batt_v": F.min, "harsh_brakes": F.sum, "idle_samples": F.sum, "dtc_events": F.sum}


def measures() -> list[Column]:
    """The rollup's measures. All combine on the map side and merge later."""
    when = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    return [
        F.count(F.lit(1)).alias("events"),
        F.min("odo_km").alias("min_odo"),
        F.max("odo_km").alias("max_odo"),
        F.sum("speed_kmh").alias("sum_speed"),
        F.max("coolant_c").alias("max_coolant"),
        F.min("batt_v").alias("min_batt_v"),
        when(F.col("evt") == "HARSH_BRAKE").alias("harsh_brakes"),
        when(F.col("speed_kmh") < 1).alias("idle_samples"),
        when(F.col("dtcs").isNotNull()).alias("dtc_events"),
    ]


def daily_rollup(telemetry: DataFrame, key: str = "vin") -> DataFrame:
    """One row per vehicle and day."""
    return telemetry.groupBy(key, F.to_date("ts").alias("day")).agg(*measures())


def merge_rollups(old: DataFrame, new: DataFrame, key: str = "vin") -> DataFrame:
    """Add partial rollups together."""
    return old.unionByName(new).groupBy(key, "day").agg(*[f(c).alias(c) for c, f in MERGE.items()])


def incremental_rollup(rollup: DataFrame, telemetry: DataFrame, low, high, key: str = "vin") -> tuple[DataFrame, DataFrame]:
    """(merged rollup, late rows) after taking in the rows of (low, high], whose bounds are literals so that they reach the scan.

    Only days that the new rows touch are aggregated again. Rows at or before `low` that came too late for an earlier
    run are not counted; the caller gets them if the telemetry marks arrival (column `arrived`) after `low`."""
    low, high = F.lit(low), F.lit(high)
    fresh = daily_rollup(telemetry.filter((F.col("ts") > low) & (F.col("ts") <= high)), key)
    span = (F.col("day") >= F.to_date(low)) & (F.col("day") <= F.to_date(high))
    merged = merge_rollups(rollup.filter(span), fresh, key).unionByName(rollup.filter(~span))
    late = telemetry.filter((F.col("ts") <= low) & (F.col("arrived") > low)) if "arrived" in telemetry.columns else telemetry.limit(0)
    return merged, late


def retention_plan(telemetry: DataFrame, now, keep_hours: int) -> DataFrame:
    """Hour partitions and whether each goes: those that end at or before now - keep_hours."""
    hour = F.date_trunc("hour", F.col("ts").cast("timestamp"))
    ends = F.col("hour") + F.expr("interval 1 hour")
    parts = telemetry.groupBy(hour.alias("hour")).agg(F.count(F.lit(1)).alias("rows"))
    return parts.withColumn("dropped", ends <= F.lit(now).cast("timestamp") - F.expr(f"interval {keep_hours} hours"))


def retained(telemetry: DataFrame, now, keep_hours: int) -> DataFrame:
    """The rows that stay: those of hours that end after now - keep_hours, rows without a time too. The bound is a
    literal on the hour, so a table that is partitioned by day and hour is pruned by it."""
    cutoff = F.lit(now).cast("timestamp") - F.expr(f"interval {keep_hours + 1} hours")
    return telemetry.filter(F.col("ts").isNull() | (F.date_trunc("hour", F.col("ts").cast("timestamp")) > cutoff))


def apply_retention(spark: SparkSession, path: str, to: str, now, keep_hours: int) -> int:
    """Write the retained part of the table at `path` (as `write_by_hour` lays it out) to `to`; the number of hour
    partitions that were dropped. The caller swaps the folders, so a run that fails half-way has dropped nothing. Where the
    table is in the catalog, `drop_old_hours` drops the same without writing."""
    table = spark.read.parquet(path)
    gone = retention_plan(table, now, keep_hours).filter("dropped").count()
    retained(table, now, keep_hours).write.mode("overwrite").partitionBy("d", "h").parquet(to)
    return gone


def hours_table(telemetry: DataFrame, table: str, *, path: str | None = None, ts: str = "ts", spread: int = 8) -> None:
    """Append telemetry to a catalog table with a partition for each hour of the event, in `path` if it is new. An hour is
    written by `spread` tasks, parted by vehicle."""
    spark, t = telemetry.sparkSession, F.col(ts).cast("timestamp")
    placed = telemetry.withColumn("d", F.to_date(t)).withColumn("h", F.hour(t)).repartition("d", "h", F.pmod(F.xxhash64("vin"), F.lit(spread)))
    if spark.catalog.tableExists(table):
        placed.select(*spark.table(table).columns).write.insertInto(table)
    else:
        placed.write.partitionBy("d", "h").format("parquet").saveAsTable(table, **({"path": path} if path else {}))


def drop_old_hours(spark: SparkSession, table: str, now: dt.datetime, keep_hours: int) -> int:
    """Drop the hour partitions of a catalog table that end at or before now - keep_hours; how many there were.

    Only partitions that go are touched, in the catalog and as folders: no row that stays is read or written. Partitions
    are made as rows need them, so a stray of any age lies in an hour of its own and goes with it; rows without a time stay."""
    bound = now - dt.timedelta(hours=keep_hours)
    parts = [dict(x.split("=", 1) for x in r[0].split("/")) for r in spark.sql(f"SHOW PARTITIONS {table}").collect()]  # a name for each hour
    gone = [p for p in parts if p["d"][:1].isdigit() and dt.datetime.fromisoformat(p["d"]) + dt.timedelta(hours=int(p["h"]) + 1) <= bound]
    location = spark.sql(f"DESCRIBE TABLE EXTENDED {table}").filter("col_name = 'Location'").first()["data_type"]
    for at in range(0, len(gone), 500):
        spark.sql(f"ALTER TABLE {table} DROP IF EXISTS " + ", ".join(f"PARTITION (d = DATE '{p['d']}', h = {p['h']})" for p in gone[at : at + 500]))
    for p in gone:
        remove(spark, f"{location}/d={p['d']}/h={p['h']}")  # an external table leaves it
    return len(gone)


class StoredRollup:
    """The daily rollup as a table in a folder, advanced in steps that hold as a whole.

    A step rolls up the telemetry of (watermark, upto], merges it with the stored rows of the days it touches and writes
    those days to a folder of its own. Then one ledger entry says both what the new watermark is and in which folder
    each day lies. A job that dies before the entry has changed nothing that is read, and the next one does the
    step again; of two jobs at once one fails at the entry. So every row counts once."""

    def __init__(self, spark: SparkSession, at: str, key: str = "vin"):
        self.spark, self.at, self.key = spark, at, key
        self.ledger = Ledger(spark, f"{at}/ledger")

    def state(self) -> tuple[int, dt.datetime | None, dict[str, str]]:
        """(version, watermark, folder of each day)."""
        version = self.ledger.last()
        if version < 0:
            return -1, None, {}
        entry = self.ledger.read(version)
        return version, dt.datetime.fromisoformat(entry["upto"]), entry["days"]

    def _read(self, days: dict[str, str]) -> DataFrame | None:
        paths = [f"{self.at}/days/step={step}/day={d}" for d, step in sorted(days.items())]
        return self.spark.read.option("basePath", f"{self.at}/days").parquet(*paths).drop("step") if paths else None

    def table(self) -> DataFrame | None:
        """The rollup as of the last entry; none before the first day."""
        return self._read(self.state()[2])

    def advance(self, telemetry: DataFrame, now: dt.datetime, *, late_seconds: int = 20, start: dt.datetime | None = None) -> tuple[dt.datetime, dt.datetime]:
        """Take in the telemetry up to now - late_seconds; returns (from, upto]. What is newer may still be under way and
        waits for the next step; the first step begins at `start` (default: a day before its end)."""
        version, low, days = self.state()
        high = now - dt.timedelta(seconds=late_seconds)
        low = low or start or high - dt.timedelta(days=1)
        if high <= low:
            return low, low
        fresh = daily_rollup(telemetry.filter((F.col("ts") > F.lit(low)) & (F.col("ts") <= F.lit(high))), self.key)
        span = [(low.date() + dt.timedelta(days=k)).isoformat() for k in range((high.date() - low.date()).days + 1)]
        old = self._read({d: v for d, v in days.items() if d in set(span)})
        merged = merge_rollups(old.select(*fresh.columns), fresh, self.key) if old is not None else fresh
        step = f"{version + 1:09d}-{uuid.uuid4().hex}"
        merged.repartition("day").write.partitionBy("day").parquet(f"{self.at}/days/step={step}")
        touched = [n.removeprefix("day=") for n in names(self.spark, f"{self.at}/days/step={step}") if n.startswith("day=")]
        self.ledger.put(version + 1, {"upto": high.isoformat(), "days": days | {d: step for d in touched}})
        return low, high

