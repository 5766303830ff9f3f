"""The operators as Structured Streaming jobs. Stateful steps share one key, so state and shuffle agree."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import DateType, IntegerType, StructField, StructType

from ..operators import rules
from ..operators.rollup import measures
from ..operators.rules import Limits
from ..operators.windows import latest
from ..session import configured, shared_folder
from ..sources import sinks
from ..sources.ledger import Ledger, exists, is_whole, make, move, names, put_part, read_parts, remove
from ..sources.payloads import enrich, normalise, split_rejects


#: Rows of one range of run_in_order, about.
ROWS_PER_RANGE = 5_000_000
#: Files of one range, at most, and the rows of one that is worth its own task.
FILES_PER_RANGE, ROWS_PER_FILE = 8, 100_000


def folder(spark: SparkSession, name: str) -> str:
    """A fresh folder that all executors share."""
    return shared_folder(spark, f"stream-{name}")


def run_append(stream: DataFrame, name: str) -> DataFrame:
    """Run to the end of what is there and return the appended rows."""
    at = folder(stream.sparkSession, name)
    stream.writeStream.format("parquet").option("path", f"{at}/rows").option("checkpointLocation", f"{at}/state").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{at}/rows")


def run_batches(stream: DataFrame, name: str, each: Callable[[DataFrame, int, str], None], mode: str = "append", at: str | None = None) -> str:
    """Run to the end with `each` called for every micro-batch; returns the folder. With `at` a run goes on where the
    one before it in that folder ended or failed."""
    at = at or folder(stream.sparkSession, name)
    stream.writeStream.foreachBatch(lambda batch, k: each(batch, k, at)).option("checkpointLocation", f"{at}/state").outputMode(mode).trigger(availableNow=True).start().awaitTermination()
    return at


def run_latest(stream: DataFrame, name: str, keys: list[str], mode: str = "update") -> DataFrame:
    """Run an updating stream to the end and return the last row of each key. A batch that runs again replaces its folder."""
    at = run_batches(stream, name, lambda batch, k, to: batch.write.mode("overwrite").parquet(f"{to}/rows/batch={k}"), mode)
    rows = stream.sparkSession.read.schema(stream.schema.add("batch", "long")).parquet(f"{at}/rows")
    rest = [c for c in stream.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("r")).select(*keys, "r.*")


def in_order(table: DataFrame, order: str, at: str, rows_per_range: int | None = None, *, each: bool = False) -> Iterator[str]:
    """Lay a table out in ranges of the number `order` and hand them over one by one: each time the pattern of files that
    a stream is to read has a range more. Rows of equal `order` are in one range, nulls last; with `each` every value of
    `order`, a whole number that is never null then, is a range.

    The table is counted, sampled for its bounds and written once; a range is handed over by renaming its folder. A large
    range lies in several files, which are ranges themselves, so several tasks write and read it."""
    spark = table.sparkSession
    if each:
        ranged = table.withColumn("_range", F.col(order).cast("long"))
    else:
        rows = table.count()
        parts = max(1, -(-rows // (rows_per_range or ROWS_PER_RANGE)))
        files = max(1, min(FILES_PER_RANGE, rows // parts // ROWS_PER_FILE))
        ranged = table.repartitionByRange(parts * files, F.col(order).asc_nulls_last()).withColumn("_range", F.expr(f"spark_partition_id() div {files}"))
    ranged.write.partitionBy("_range").parquet(f"{at}/ranges")
    make(spark, f"{at}/in/none")
    numbers = sorted(int(n.split("=")[1]) for n in names(spark, f"{at}/ranges") if n.startswith("_range="))
    for k in numbers:
        move(spark, f"{at}/ranges/_range={k}", f"{at}/in/{k:09d}")
        yield f"{at}/in/*"
    if not numbers:
        yield f"{at}/in/*"


def run_in_order(table: DataFrame, order: str, name: str, job: Callable[[DataFrame], DataFrame], rows_per_range: int | None = None) -> DataFrame:
    """Feed a table to a job in ranges of the number `order` and return the appended rows.

    A file source takes files as they were modified, which need not be their order of events. Each range is
    run to its end, as one micro-batch, before the next is handed over."""
    spark = configured(table.sparkSession)
    at, stream = folder(spark, name), None
    for files in in_order(table, order, at, rows_per_range):
        stream = job(spark.readStream.schema(table.schema).parquet(files)) if stream is None else stream
        stream.writeStream.format("parquet").option("path", f"{at}/rows").option("checkpointLocation", f"{at}/state").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{at}/rows")


def dedup(stream: DataFrame, keys: list[str], *, ts: str = "ts", delay: str | None = "1 day") -> DataFrame:
    """Exact deduplication; state is dropped once the watermark has passed. Without a delay no row is late and all keys are kept."""
    if delay is None:
        return stream.dropDuplicates(keys)
    return stream.withWatermark(ts, delay).dropDuplicatesWithinWatermark(keys)


def tumbling(stream: DataFrame, *, ts: str = "ts", seconds: int = 1, delay: str | None = "15 seconds") -> DataFrame:
    """Events per tumbling window. Without a delay (update mode) no event is late and all windows are kept."""
    timed = stream if delay is None else stream.withWatermark(ts, delay)
    return timed.groupBy(F.window(ts, f"{seconds} seconds").alias("w")).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("second"), "n")


def live_state(stream: DataFrame, *, key: str = "vin", seq: str = "seq") -> DataFrame:
    """The newest row of each key in update mode; late rows never overwrite."""
    rest = [c for c in stream.columns if c != key]
    return stream.groupBy(key).agg(F.max_by(F.struct(*rest), seq).alias("r")).select(key, "r.*")


def rollup(stream: DataFrame, *, delay: str = "20 seconds") -> DataFrame:
    """The daily rollup in update mode. The group is an event-time window, so a day's state goes when the watermark
    has passed its end; rows that come for it later are dropped by Spark."""
    day = F.window("ts", "1 day").alias("w")
    return stream.withWatermark("ts", delay).groupBy("vin", day).agg(*measures()).withColumn("day", F.to_date("w.start")).drop("w")


def _newest(keys: list[str], order: str) -> Callable[[DataFrame], DataFrame]:
    """The row of each key with the largest `order`; the same however often a row is there."""
    def merge(df: DataFrame) -> DataFrame:
        rest = [c for c in df.columns if c not in keys]
        return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("r")).select(*keys, "r.*")

    return merge


_ROLLED = "vin string, events long, min_odo double, max_odo double, sum_speed double, max_coolant double, min_batt_v double, harsh_brakes long, idle_samples long, dtc_events long, day date, batch long"


class RollupJob:
    """The daily rollup of a stream with rows that come too late set aside. All it has is in one folder.

    A micro-batch is parted by the watermark as it stood before: rows of days that had closed go to `late`, the others to
    the rollup, whose state Spark drops day by day. The ledger notes the batch once its rows are written, and only then
    the rollup takes them, as one micro-batch of its own; it therefore drops none, and each row is either rolled up once
    or late. A run that failed goes on from the ledger."""

    def __init__(self, spark: SparkSession, at: str, delay_seconds: int = 20):
        self.spark, self.at, self.delay = configured(spark), at, delay_seconds
        self.ledger = Ledger(spark, f"{at}/ledger")

    def _part(self, batch: DataFrame, k: int) -> dict:
        """Write a batch in its two parts; the ledger's entry of it."""
        before = self.ledger.read(k - 1)["watermark_ms"] if k else None
        ends = (F.unix_seconds(F.date_trunc("day", "ts")) + 86_400) * 1000
        late = F.coalesce(ends <= F.lit(before), F.lit(False)) if before is not None else F.lit(False)
        seen = Observation()
        marked = batch.withColumn("is_late", late).observe(seen, F.count(F.lit(1)).alias("rows"), F.coalesce(F.count_if("is_late"), F.lit(0)).alias("late"), F.max(F.unix_millis("ts")).alias("top"))
        marked.write.mode("overwrite").partitionBy("is_late").parquet(f"{self.at}/rows/batch={k}")
        found = seen.get
        times = [t for t in (before, found["top"] - 1000 * self.delay if found["top"] is not None else None) if t is not None]
        entry = {"rows": found["rows"], "late": found["late"], "watermark_ms": max(times, default=None)}
        self.ledger.put(k, entry)
        return entry

    def _each(self, batch: DataFrame, k: int) -> None:
        if k:  # rolled up by now
            remove(self.spark, f"{self.at}/rows/batch={k - 1}/is_late=false")
        entry = self.ledger.read(k) or self._part(batch, k)
        if entry["rows"] > entry["late"]:
            stream = rollup(self.spark.readStream.schema(batch.schema).parquet(f"{self.at}/rows/*/is_late=false"), delay=f"{self.delay} seconds")

            def put(changed: DataFrame, j: int) -> None:
                put_part(changed.select(*[F.col(c).cast(t) for c, t in (x.split(" ") for x in _ROLLED.split(", ")[:-1])], F.lit(j).cast("long").alias("batch")), f"{self.at}/rollup", j, _newest(["vin", "day"], "batch"))

            query = stream.writeStream.foreachBatch(put).option("checkpointLocation", f"{self.at}/rollup-state").outputMode("update").trigger(availableNow=True).start()
            query.awaitTermination()
            states = [s for p in query.recentProgress for s in p["stateOperators"]]
            told = [(k, states[-1]["numRowsTotal"] if states else 0, sum(s["numRowsRemoved"] for s in states), sum(s["numRowsDroppedByWatermark"] for s in states))]
            self.spark.createDataFrame(told, "batch long, held long, removed long, dropped long").write.mode("overwrite").parquet(f"{self.at}/progress/batch={k}")

    def run(self, stream: DataFrame) -> None:
        """Run to the end of what is there."""
        stream.writeStream.foreachBatch(self._each).option("checkpointLocation", f"{self.at}/state").trigger(availableNow=True).start().awaitTermination()

    def table(self) -> DataFrame:
        """The rollup, a row for each vehicle and day."""
        schema = self.spark.createDataFrame([], _ROLLED).schema
        return read_parts(self.spark, f"{self.at}/rollup", schema, _newest(["vin", "day"], "batch")).drop("batch")

    def late(self, schema: StructType) -> DataFrame:
        """The rows that came after their day had closed."""
        found = [f"{self.at}/rows/{b}/is_late=true" for b in names(self.spark, f"{self.at}/rows") if exists(self.spark, f"{self.at}/rows/{b}/is_late=true")]
        return self.spark.read.schema(schema).parquet(*found) if found else self.spark.createDataFrame([], schema)

    def progress(self) -> DataFrame:
        """(batch, held, removed, dropped): rows of state after each batch and those that went, and rows Spark dropped."""
        return self.spark.read.parquet(f"{self.at}/progress").select("batch", "held", "removed", "dropped")


class LateFlags(StatefulProcessor):
    """Keeps the largest sequence number of each vehicle."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "seq long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        top = self.last.get()[0] if self.last.exists() else -1
        pdf = pd.concat(list(rows)).sort_values("arrival", kind="stable")
        before = pdf["seq"].cummax().shift(fill_value=-1).clip(lower=top)
        self.last.update((int(max(top, pdf["seq"].max())),))
        yield pd.DataFrame({"vin": pdf["vin"], "seq": pdf["seq"], "is_late": pdf["seq"] <= before})

    def close(self) -> None:
        pass


def late_flags(stream: DataFrame) -> DataFrame:
    """(vin, seq, is_late) in arrival order; needs vin, seq and arrival."""
    return stream.select("vin", "seq", "arrival").groupBy("vin").transformWithStateInPandas(LateFlags(), "vin string, seq long, is_late boolean", "Append", "None")


class WindowRules(StatefulProcessor):
    """Sliding readings of each vehicle for the window rules, of one vehicle or of a group of them at a time. What has left
    the window goes when rows come; a timer in event time clears the state of a vehicle or group that has fallen silent."""

    def __init__(self, limits: Limits, silent_seconds: int | None):
        self.limits, self.silent = limits, None if silent_seconds is None else silent_seconds * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        # the vehicles, how many readings each has, and the readings, vehicle by vehicle
        self.held = {k: handle.getValueState(k, "vins array<string>, sizes array<int>, ts_ms array<long>, readings array<double>") for k in ("coolant", "brake")}

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        for state in self.held.values():
            state.clear()
        yield pd.DataFrame([], columns=["vin", "ts_ms", "seq", "rule", "severity"]).astype({"vin": "str", "ts_ms": "int64", "seq": "int64", "rule": "str", "severity": "int32"})

    def _wait(self, last_ms: int) -> None:
        """One timer, after the newest row."""
        waiting = [t[0] if isinstance(t, (tuple, list)) else t for t in self.handle.listTimers()]
        due = max([last_ms + self.silent, *waiting])
        for t in waiting:
            if t != due:
                self.handle.deleteTimer(t)
        if due not in waiting:
            self.handle.registerTimer(due)

    def _windows(self, name: str, own: pd.DataFrame, values: np.ndarray, span_ms: int, seen_ms: int | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The readings in order, held ones first among those of equal time, and where the window of each of `own` begins
        and ends among them; rows of equal time see each other. Rows up to `seen_ms` have all been seen."""
        state = self.held[name]
        vins, sizes, old_t, old_v = state.get() if state.exists() else ([], [], [], [])
        every = np.concatenate([np.repeat(np.array(vins, object), sizes), own["vin"].to_numpy(object)])
        t, v = np.concatenate([np.array(old_t, np.int64), own["ts_ms"].to_numpy(np.int64)]), np.concatenate([np.array(old_v, float), values])
        codes, names = pd.factorize(every, use_na_sentinel=False)
        order = np.lexsort((t, codes))
        times = np.unique(t)
        place = codes * (len(times) + 1) + np.searchsorted(times, t)  # vehicle and time as one number
        new_t, new_code = t[len(old_t) :], codes[len(old_t) :]
        ends, begins = place[len(old_t) :], new_code * (len(times) + 1) + np.searchsorted(times, new_t - span_ms)
        t, v, codes, place = t[order], v[order], codes[order], place[order]
        last = np.searchsorted(codes, codes, "right") - 1  # the newest reading of the same vehicle
        kept = t >= t[last] - span_ms
        if seen_ms is not None:
            kept &= t >= seen_ms - span_ms
        if kept.any():
            left, n = np.unique(codes[kept], return_counts=True)
            state.update(([None if x is None or x != x else x for x in np.asarray(names, object)[left]], n.tolist(), t[kept].tolist(), v[kept].tolist()))
        else:
            state.clear()
        return v, np.searchsorted(place, begins, "left"), np.searchsorted(place, ends, "right")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        pdf, lim = pd.concat(list(rows)).sort_values(["ts_ms", "seq"], kind="stable"), self.limits
        seen = None if self.silent is None else timerValues.getCurrentWatermarkInMs()
        hot, brakes, out = pdf[pdf["coolant_c"].notna()], pdf[pdf["evt"] == "HARSH_BRAKE"], []
        if len(hot):
            v, low, high = self._windows("coolant", hot, hot["coolant_c"].to_numpy(float), lim.overheat_window * 1000, seen)
            found = over(v, low, high, lim.overheat_c) & (high - low >= 2)
            out.append(hot[found].assign(rule="OVERHEAT_TREND", severity=4))
        if len(brakes):
            _, low, high = self._windows("brake", brakes, np.ones(len(brakes)), lim.brake_window * 1000, seen)
            out.append(brakes[high - low >= lim.brakes].assign(rule="HARSH_BRAKE_PATTERN", severity=2))
        columns = ["vin", "ts_ms", "seq", "rule", "severity"]
        found = pd.concat(out)[columns] if out else pd.DataFrame([], columns=columns)
        if self.silent is not None:
            self._wait(int(pdf["ts_ms"].max()))
        yield found.astype({"ts_ms": "int64", "seq": "int64", "severity": "int32"})

    def close(self) -> None:
        pass


def over(values: np.ndarray, low: np.ndarray, high: np.ndarray, limit: float) -> np.ndarray:
    """Whether the mean of values[low:high] is over the limit, for each window.

    The mean is the one that an average over the window gives, which adds one value after the other. Differences of
    running sums decide all windows but those that lie so near the limit that the last bits matter; these are added up."""
    with np.errstate(invalid="ignore"):
        sums = np.concatenate([[0.0], np.cumsum(values)])
        n = high - low
        off = sums[high] - sums[low] - limit * n
        found = off > 0
        slack = 4 * np.finfo(float).eps * (len(values) * np.abs(values).sum() + n * abs(limit) * len(values))
        for k in np.flatnonzero(~(np.abs(off) > slack)):
            found[k] = n[k] > 0 and np.cumsum(values[low[k] : high[k]])[-1] / n[k] > limit
    return found


#: Groups of vehicles whose windows one call takes, where vehicles are many.
GROUPS = 1024


def window_rules(stream: DataFrame, limits: Limits = Limits(), silent_seconds: int | None = None, *, delay: str = "0 seconds", groups: int | None = None) -> DataFrame:
    """Alerts of the window rules. On input that arrives in event-time order they are those of the batch rules.

    `silent_seconds` (the longest window at least) drops the state of a vehicle once the watermark, `delay` behind the
    newest row, is so far past its last row. These timers run in event time, so a run to the end ends; rows behind the
    watermark are dropped then. Without it all vehicles' windows are kept and no row is late.

    Each vehicle has its own state, which suits small micro-batches. With `groups` vehicles are dealt into so many groups
    that have one state and one call each: a call and its state cost about as much as thousands of rows, so this suits
    large micro-batches over many vehicles. The state of a group is read and written whole; readings that the watermark
    has put out of reach go from it, and all of it when the group is silent."""
    slim = stream.select("vin", "ts_ms", "seq", "coolant_c", "evt")
    mode = "None"
    if silent_seconds is not None:
        if silent_seconds < max(limits.overheat_window, limits.brake_window):
            raise ValueError("silent_seconds is shorter than a window")
        slim, mode = slim.withColumn("_at", F.timestamp_millis("ts_ms")).withWatermark("_at", delay), "EventTime"
    slim = slim.filter("coolant_c IS NOT NULL OR evt = 'HARSH_BRAKE'")  # no rule sees other rows
    dealt = slim.groupBy("vin") if groups is None else slim.withColumn("_group", F.pmod(F.xxhash64("vin"), F.lit(groups)).cast("int")).groupBy("_group")
    return dealt.transformWithStateInPandas(WindowRules(limits, silent_seconds), "vin string, ts_ms long, seq long, rule string, severity int", "Append", mode)


def alert_dedup(alerts: DataFrame, *, delay: str = "2 hours") -> DataFrame:
    """One alert for each dedup key of a stream of alerts (with ts_ms). A key holds for an hour, so a delay of two keeps
    state for as long as a key can come again in order."""
    timed = alerts.withColumn("_at", F.timestamp_millis("ts_ms")).withWatermark("_at", delay)
    return timed.dropDuplicatesWithinWatermark(["dedup_key"]).drop("_at")


HOUR_MS = 3_600_000


def _hours(column: str = "ts_ms") -> Column:
    return F.floor(F.col(column) / HOUR_MS)


class Tables:
    """The tables of one ingest job. Telemetry and alerts are partitioned by day and hour of the event."""

    def __init__(self, spark: SparkSession, at: str, schemas: dict[str, StructType]):
        self.spark, self.at = spark, at
        self.schemas = {t: StructType([*s.fields, StructField("d", DateType()), StructField("h", IntegerType())]) for t, s in schemas.items()}
        for t, s in self.schemas.items():
            if not exists(spark, f"{at}/{t}"):
                spark.createDataFrame([], s).write.mode("ignore").partitionBy("d", "h").parquet(f"{at}/{t}")

    def read(self, table: str, hours: set[int]) -> DataFrame:
        """The rows of some hours (since 1970). Only their folders are opened; the folder of each of their days is listed once."""
        days: dict[str, set[str]] = {}
        for x in hours:
            days.setdefault(f"{self.at}/{table}/d={dt.date(1970, 1, 1) + dt.timedelta(days=x // 24)}", set()).add(f"h={x % 24}")
        paths = [f"{day}/{h}" for day in sorted(days) for h in names(self.spark, day) if h in days[day]]
        reader = self.spark.read.schema(self.schemas[table]).option("basePath", f"{self.at}/{table}")
        return reader.parquet(*paths) if paths else self.spark.createDataFrame([], self.schemas[table])


LIVE = "vin string, tenant_id int, seq long, ts_ms long, lat double, lon double, speed_kmh double"
_newest_of_vehicle = _newest(["vin"], "seq")
#: Edges of the latency histogram in seconds.
LATENCY_EDGES = (0.1, 0.5, 1, 5, 30, 300)


def ingest(stream: DataFrame, tenants: DataFrame, name: str = "ingest", *, at: str | None = None, limits: Limits = Limits()) -> dict[str, str]:
    """Raw payloads to alerts, telemetry, live state, outcome counts and dead letters; the paths of the tables.

    Within a batch alerts come first, then telemetry, then the rest. New alerts are set out by tenant in a folder of the
    batch (`fanout`) before they enter the alert table, with the tenant and an id that follows from their key. A batch
    writes only rows whose keys (vehicle, sequence number, time) are not in the tables yet, and opens these only in the
    hours that it touches: a key has one event time, so it can be nowhere else; a redelivery under another time is another
    row. What a batch has settled on is written before it is acted on, so one that runs again after a failure adds what is
    missing and nothing twice, and counts alike. The window rules see the new rows with those of the windows before
    them; alerts are raised on rows of the touched hours. Live state is kept in levels: a batch writes its own vehicles only.

    Outcomes of a batch: `processed`, `unknown` and `malformed` part its payloads; processed ones are `duplicate` or
    written, and written ones `late` (not over the vehicle's last number before the batch) or `ok`. They are observed
    while the tables are written; with a column `arrived` in the stream, latencies too (`latency<=` edges, in seconds)."""
    spark = configured(stream.sparkSession)
    judged = enrich(normalise(stream), tenants)
    timed = judged.withColumn("ts", F.timestamp_millis("ts_ms"))
    good_schema = split_rejects(timed)[0].schema
    empty = rules.alerts(spark.createDataFrame([], good_schema), limits)
    alert_schema = empty.withColumns({"tenant_id": F.lit(0).cast("int"), "alert_id": F.lit(0).cast("long")}).schema
    at = at or folder(spark, name)
    tables = Tables(spark, at, {"telemetry": good_schema, "alerts": alert_schema})
    reach = -(-max(limits.overheat_window, limits.brake_window) // 3600)
    reason = F.col("reject_reason")
    unknown = F.coalesce(reason.isin("vin", "unknown vin"), F.lit(False))

    def settled(rows: Callable[[], DataFrame], path: str, schema: StructType, **options) -> tuple[DataFrame, bool]:
        """What a batch has settled on: written the first time, read again after a failure."""
        again = is_whole(spark, path)
        if not again:
            rows().write.mode("overwrite").parquet(path, **options)
        return spark.read.schema(schema).parquet(path), again

    def each(batch: DataFrame, k: int, to: str) -> None:
        remove(spark, f"{to}/fresh/batch={k - 1}")
        kept = batch.persist()
        seen_all = Observation()
        metrics = [F.count(F.lit(1)).alias("all"), F.coalesce(F.count_if(reason.isNull()), F.lit(0)).alias("processed"), F.coalesce(F.count_if(unknown), F.lit(0)).alias("unknown")]
        if "arrived" in kept.columns:
            waited = F.unix_millis(F.col("arrived").cast("timestamp")) - F.col("ts_ms")
            metrics += [F.coalesce(F.count_if(waited <= 1000 * e), F.lit(0)).alias(f"latency<={e:g}") for e in LATENCY_EDGES]
        split_rejects(kept.observe(seen_all, *metrics))[1].write.mode("overwrite").parquet(f"{to}/dead/batch={k}")
        good, _ = split_rejects(kept)
        touched = {r["hour"] for r in good.select(_hours().alias("hour")).distinct().collect()}  # hours in a batch
        key = ["vin", "seq", "ts_ms"]
        fresh, again = settled(lambda: sinks.fresh_rows(good, tables.read("telemetry", touched), key), f"{to}/fresh/batch={k}", good_schema)

        def alerts() -> DataFrame:
            before = tables.read("telemetry", {x - j for x in touched for j in range(reach + 1)}).select(fresh.columns)
            seen = fresh.unionByName(before.join(fresh.select("vin").distinct(), "vin", "left_semi").join(fresh.select(*key), key, "left_anti").select(fresh.columns))
            found = rules.row_alerts(fresh, limits).unionByName(rules.overheat_alerts(seen, limits)).unionByName(rules.pattern_alerts(seen, limits))
            found = rules.keyed(found.filter(_hours().isin(sorted(touched))))
            owners = good.groupBy("vin").agg(F.max("tenant_id").alias("tenant_id"))
            named = rules.first_of_each(found).join(owners, "vin").withColumn("alert_id", F.xxhash64("dedup_key"))
            return sinks.fresh_rows(named.select(alert_schema.names), tables.read("alerts", touched), ["dedup_key"])

        new, told = settled(alerts, f"{to}/fanout/batch={k}", alert_schema, partitionBy=["tenant_id"])
        missing = sinks.fresh_rows(new, tables.read("alerts", touched), ["dedup_key"]) if told else new
        sinks.write_by_hour(missing.select(alert_schema.names).withColumn("_ts", F.timestamp_millis("ts_ms")), f"{to}/alerts", "_ts", drop=True)

        last = read_parts(spark, f"{to}/live", LIVE, _newest_of_vehicle).select("vin", F.col("seq").alias("_last"))
        by_order = fresh.join(last, "vin", "left").agg(F.count(F.lit(1)).alias("written"), F.count_if(F.col("seq") <= F.col("_last")).alias("late"))
        orders = settled(lambda: by_order, f"{to}/orders/batch={k}", by_order.schema)[0].first().asDict()  # the live state moves on below
        missing = sinks.fresh_rows(fresh, tables.read("telemetry", touched), key) if again else fresh
        sinks.write_by_hour(missing, f"{to}/telemetry")

        put_part(_newest_of_vehicle(good.selectExpr(*[f"CAST({c} AS {t}) AS {c}" for c, t in (x.split(" ") for x in LIVE.split(", "))])), f"{to}/live", k, _newest_of_vehicle)
        found = seen_all.get | orders
        n = {"processed": found["processed"], "unknown": found["unknown"], "malformed": found["all"] - found["processed"] - found["unknown"], "written": found["written"], "late": found["late"]}
        n |= {"ok": n["written"] - n["late"], "duplicate": n["processed"] - n["written"]} | {m: v for m, v in found.items() if m.startswith("latency")}
        spark.createDataFrame(sorted(n.items()), "outcome string, n long").coalesce(1).write.mode("overwrite").parquet(f"{to}/outcomes/batch={k}")
        kept.unpersist()

    run_batches(timed, name, each, at=at)
    return {t: f"{at}/{t}" for t in ("alerts", "fanout", "telemetry", "live", "outcomes", "dead")}


def live_table(spark: SparkSession, path: str) -> DataFrame:
    """An ingest job's live state: the newest row of each vehicle."""
    return read_parts(spark, path, LIVE, _newest_of_vehicle)


def batch_sizes(spark: SparkSession, path: str, edges: tuple[int, ...] = (1, 10, 100, 1_000, 10_000, 100_000)) -> DataFrame:
    """(at_most, batches): how many of an ingest job's batches had at most so many rows; a last row for all."""
    outcomes = spark.read.parquet(path).filter("outcome IN ('processed', 'unknown', 'malformed')").groupBy("batch").agg(F.sum("n").alias("n"))
    sums = outcomes.agg(*[F.count_if(F.col("n") <= e).alias(f"le{e}") for e in edges], F.count(F.lit(1)).alias("every"))
    rows = [F.struct(F.lit(e).cast("long").alias("at_most"), F.col(f"le{e}").alias("batches")) for e in edges] + [F.struct(F.lit(None).cast("long").alias("at_most"), F.col("every").alias("batches"))]
    return sums.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def open_kafka(spark: SparkSession, servers: str, topic: str, rows_per_batch: int = 2_000) -> DataFrame:
    """Raw payloads of a Kafka topic from its beginning on, as `ingest` takes them. Needs Spark's Kafka package on the
    class path, which the test machine does not have, so this reader is not tested there."""
    source = configured(spark).readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic)
    stream = source.option("startingOffsets", "earliest").option("maxOffsetsPerTrigger", rows_per_batch).load()
    return stream.select(F.col("value").cast("string").alias("value"), F.col("timestamp").alias("arrived"))


def open_parquet(spark: SparkSession, path: str, files_per_batch: int = 1) -> DataFrame:
    """A Parquet table as a stream, its event time ready for watermarks.

    A stream's path must be a folder or a pattern; the table may be a single file, so it is given as a pattern."""
    schema = spark.read.parquet(path).schema
    path = f"{path[:-1]}[{path[-1]}]"
    stream = configured(spark).readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))
