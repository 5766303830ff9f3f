"""The streaming jobs, run over the supplied tables to their end."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.vehicle import FAULT_CODES, fault_codes
from ..operators import rules
from ..streaming import jobs
from .bindings import TELEMETRY, TELEMETRY_SQL, payloads, read, view
from .events import LIMITS, SQL as EVENT_SQL, _tenants


def _viewed(events):
    t = view(events, TELEMETRY)
    codes = fault_codes(F.col("fault_string"))
    return t.withColumn("dtcs", F.when(F.size(codes) > 0, codes)).withColumn("ts_ms", F.unix_millis("ts"))


def _stream(spark, sf):
    return _viewed(jobs.open_parquet(spark, f"{sf}/events.parquet"))


def _table(spark, sf):
    """What _stream gives, to be fed in an order of its own."""
    return _viewed(read(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp")))


def stream_dedup(spark, sf):
    """Every 97th event is delivered twice; each is kept once."""
    s = _stream(spark, sf).select("vin", "seq", "ts")
    twice = s.withColumn("_copy", F.explode(F.when(F.col("seq") % 97 == 0, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))).drop("_copy")
    return jobs.run_append(jobs.dedup(twice, ["vin", "seq"], delay=None), "dedup").select("vin", "seq")


def stream_late_flags(spark, sf):
    t = _table(spark, sf).withColumn("arrival", F.expr("seq + case when seq % 50 = 0 then 1200 else 0 end"))
    return jobs.run_in_order(t.select("vin", "seq", "arrival"), "arrival", "late", jobs.late_flags).select("seq", "is_late")


def stream_rules(spark, sf):
    t = _table(spark, sf).select("vin", "ts_ms", "seq", "coolant_c", "evt")
    return jobs.run_in_order(t, "ts_ms", "rules", lambda s: jobs.window_rules(s, LIMITS, silent_seconds=LIMITS.brake_window, groups=jobs.GROUPS)).select("vin", "seq", "rule", "severity")


def stream_tumbling(spark, sf):
    w = jobs.tumbling(_stream(spark, sf), seconds=3600, delay=None)
    return jobs.run_latest(w, "tumbling", ["second"]).select(F.col("second").cast("timestamp_ntz").alias("hour"), "n")


def stream_live_state(spark, sf):
    s = _stream(spark, sf).select("vin", "seq", "speed_kmh")
    return jobs.run_latest(jobs.live_state(s), "live", ["vin"]).select("vin", "seq", "speed_kmh")


def _rolled(spark, table, **options):
    """The rollup job over a table, in its order of arrival."""
    job = jobs.RollupJob(spark, jobs.folder(spark, "rollup"))
    for files in jobs.in_order(table, "arrival", jobs.folder(spark, "rollup-in"), **options):
        job.run(spark.readStream.schema(table.schema).parquet(files))
    return job


def stream_rollup(spark, sf):
    t = _table(spark, sf).withColumn("arrival", F.col("ts_ms"))
    r = _rolled(spark, t).table()
    return r.select("vin", "day", "events", F.round("min_odo", 4).alias("min_odo"), F.round("max_odo", 4).alias("max_odo"), F.round("sum_speed", 4).alias("sum_speed"), F.round("max_coolant", 4).alias("max_coolant"), F.round("min_batt_v", 4).alias("min_batt_v"), "harsh_brakes", "idle_samples", "dtc_events")


def stream_rollup_late(spark, sf):
    """Telemetry comes ten days at a time, every 50th row ten days late: what is rolled up and what was too late for that."""
    t = _table(spark, sf).withColumn("arrival", F.expr("datediff(to_date(ts), DATE '2024-01-01') div 10 + case when seq % 50 = 0 then 1 else 0 end"))
    job = _rolled(spark, t, each=True)
    late = job.late(t.schema).groupBy("vin", F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("events"))
    return job.table().select(F.lit("rolled").alias("what"), "vin", "day", "events").unionByName(late.withColumn("what", F.lit("late")))


def stream_ingest(spark, sf):
    """Raw payloads of both makers, in several files and batches, through the whole job: rows of the tables it wrote.

    Every 89th payload is delivered twice, in another file."""
    at = jobs.folder(spark, "payloads")
    raw = payloads(spark, sf)
    raw.unionByName(raw.filter("event_id % 89 = 0")).repartition(6).select("value").write.parquet(at)
    stream = spark.readStream.schema("value string").option("maxFilesPerTrigger", 2).parquet(at)
    wrote = jobs.ingest(stream, _tenants(spark, sf))
    good, found = (spark.read.parquet(wrote[t]) for t in ("telemetry", "alerts"))
    count = lambda df, what: df.groupBy(what.alias("what")).agg(F.count(F.lit(1)).alias("n"))
    live = jobs.live_table(spark, wrote["live"]).agg(F.lit("live").alias("what"), F.count(F.lit(1)).alias("n"))
    single = found.filter("rule IN ('CRITICAL_DTC', 'DTC', 'LOW_12V', 'LOW_SOC')")
    outcomes = spark.read.parquet(wrote["outcomes"]).filter("outcome NOT IN ('ok', 'late')").groupBy(F.col("outcome").alias("what")).agg(F.sum("n").alias("n"))
    pushed = count(spark.read.parquet(wrote["fanout"]).filter("rule IN ('CRITICAL_DTC', 'DTC', 'LOW_12V', 'LOW_SOC')"), F.concat(F.lit("tenant "), F.col("tenant_id").cast("string")))
    return count(good, F.col("oem")).unionByName(count(single, F.col("rule"))).unionByName(live).unionByName(outcomes).unionByName(pushed)


def stream_alert_dedup(spark, sf):
    """Row alerts as they come, one for each vehicle, rule, code and hour."""
    def job(s):
        return jobs.alert_dedup(rules.keyed(rules.row_alerts(s, LIMITS)))

    t = _table(spark, sf).select("vin", "ts_ms", "seq", "dtcs", "batt_v", "soc_pct")
    return jobs.run_in_order(t, "ts_ms", "alerts", job).select("dedup_key", "rule", "vin")


QUERIES = {f.__name__: f for f in (stream_dedup, stream_late_flags, stream_rules, stream_tumbling, stream_live_state, stream_rollup, stream_rollup_late, stream_ingest, stream_alert_dedup)}

SQL = {
    "stream_dedup": f"WITH {TELEMETRY_SQL} SELECT vin, seq FROM telemetry",
    "stream_late_flags": EVENT_SQL["late_flags"],
    "stream_rules": EVENT_SQL["alert_rules"].split(" SELECT vin, seq, rule, severity, code,")[0] + " SELECT vin, seq, rule, severity FROM hot UNION ALL SELECT vin, seq, rule, severity FROM pattern",
    "stream_tumbling": "SELECT date_trunc('hour', ts) AS hour, count(*) AS n FROM events GROUP BY 1",
    "stream_live_state": f"WITH {TELEMETRY_SQL} SELECT vin, seq, speed_kmh FROM telemetry QUALIFY row_number() OVER (PARTITION BY vin ORDER BY seq DESC) = 1",
    "stream_rollup": EVENT_SQL["daily_rollup"],
    "stream_rollup_late": f"""WITH {TELEMETRY_SQL}, t AS (
          SELECT vin, ts, cast(ts AS date) AS day, (cast(ts AS date) - DATE '2024-01-01') // 10 + CASE WHEN seq % 50 = 0 THEN 1 ELSE 0 END AS b FROM telemetry
        ), tops AS (SELECT b, max(ts) AS top FROM t GROUP BY b), marks AS (
          SELECT x.b, max(y.top) - INTERVAL 20 SECOND AS mark FROM tops x LEFT JOIN tops y ON y.b < x.b GROUP BY x.b
        )
        SELECT CASE WHEN day + INTERVAL 1 DAY <= mark THEN 'late' ELSE 'rolled' END AS what, vin, day, count(*) AS events FROM t JOIN marks USING (b) GROUP BY 1, 2, 3""",
    "stream_ingest": f"""WITH {TELEMETRY_SQL}, faults(code, severity) AS (VALUES {", ".join(f"('{c}', {n})" for c, _, n in FAULT_CODES)}),
        good AS (SELECT *, CASE WHEN seq % 2 = 0 THEN 'aurora' ELSE 'borealis' END AS oem FROM telemetry WHERE seq % 50 <> 0 AND user_id % 10 <> 9),
        coded AS (SELECT vin, user_id, ts, unnest(CASE WHEN seq % 7 = 0 THEN ['P0301', 'C0035'] WHEN seq % 7 = 3 AND seq % 2 = 1 THEN ['P0217', 'U0100'] END) AS code FROM good),
        found AS (
          SELECT vin, user_id, ts, code, CASE WHEN coalesce(severity, 2) >= 4 THEN 'CRITICAL_DTC' ELSE 'DTC' END AS rule FROM coded LEFT JOIN faults USING (code)
          UNION ALL SELECT vin, user_id, ts, '', 'LOW_12V' FROM good WHERE batt_v < 11.8e0 UNION ALL SELECT vin, user_id, ts, '', 'LOW_SOC' FROM good WHERE oem = 'aurora' AND soc_pct < 10),
        sent AS (SELECT *, CASE WHEN event_id % 250 IN (0, 50, 100, 150) THEN 'malformed' WHEN event_id % 250 = 200 OR user_id % 10 = 9 THEN 'unknown' ELSE 'processed' END AS outcome, 1 + (event_id % 89 = 0)::INT AS times FROM events)
        SELECT oem AS what, count(*) AS n FROM good GROUP BY 1
        UNION ALL SELECT rule, count(DISTINCT concat(vin, code, epoch_us(ts) // 3600000000)) FROM found GROUP BY 1
        UNION ALL SELECT 'live', count(DISTINCT vin) FROM good UNION ALL SELECT 'written', count(*) FROM good
        UNION ALL SELECT outcome, sum(times)::BIGINT FROM sent GROUP BY 1 UNION ALL SELECT 'duplicate', count(*) FROM sent WHERE outcome = 'processed' AND times = 2
        UNION ALL SELECT concat('tenant ', user_id % 5), count(DISTINCT concat(vin, rule, code, epoch_us(ts) // 3600000000)) FROM found GROUP BY 1""",
    "stream_alert_dedup": EVENT_SQL["alert_rules"].split(" SELECT vin, seq, rule, severity, code,")[0] + " SELECT DISTINCT concat_ws(':', vin, rule, code, cast(epoch_us(ts) // 3600000000 AS varchar)) AS dedup_key, rule, vin FROM row_alerts",
}
