"""Ingest, rules, windows, rollup and sinks over the event table."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Window, functions as F

from ..functions import vehicle as V
from ..operators import journeys, rollup, rules, windows
from ..sources import payloads as P
from ..sources import sinks
from .bindings import ALERTS_SQL, TELEMETRY_SQL, VIN_SQL, alerts, payloads, read, telemetry, true_vin, vehicles

LIMITS = rules.Limits(overheat_c=100.0, overheat_window=86_400, brake_window=7 * 86_400, brakes=3)
LOW, HIGH = dt.datetime(2024, 1, 10, 12), dt.datetime(2024, 1, 20, 6)


def _tenants(spark, sf):
    users = true_vin(read(spark, sf, "events").select("user_id").distinct())
    return users.filter("user_id % 10 <> 9").select(F.col("vin17").alias("vin"), F.expr("cast(user_id % 5 as int)").alias("tenant_id"))


def _parsed(spark, sf):
    return P.normalise(payloads(spark, sf))


def parse_payloads(spark, sf):
    return _parsed(spark, sf).groupBy(F.coalesce("oem", F.lit("none")).alias("oem"), F.coalesce("reject_reason", F.lit("ok")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


def normalise(spark, sf):
    good = _parsed(spark, sf).filter("reject_reason IS NULL")
    return good.select("seq", "oem", "vin", "ts_ms", F.round("speed_kmh", 3).alias("speed_kmh"), F.round("odo_km", 3).alias("odo_km"), F.round("coolant_c", 2).alias("coolant_c"), "batt_v", "soc_pct", "evt", F.array_join("dtcs", ",").alias("dtcs"))


def dlq_split(spark, sf):
    _, dead = P.split_rejects(P.enrich(_parsed(spark, sf), _tenants(spark, sf)))
    return dead.groupBy("reject_reason").agg(F.count(F.lit(1)).alias("n"))


def dim_tenant_of(spark, sf):
    return _tenants(spark, sf)


def outcome_counts(spark, sf):
    enriched = P.enrich(_parsed(spark, sf), _tenants(spark, sf))
    outcome = F.when(F.col("reject_reason").isNull(), "processed").when(F.col("reject_reason").isin("vin", "unknown vin"), "unknown").otherwise("malformed")
    return enriched.groupBy(outcome.alias("outcome")).agg(F.count(F.lit(1)).alias("n"))


def vin_quality(spark, sf):
    e = true_vin(read(spark, sf, "events").select("event_id", "user_id"))
    given = F.expr("case event_id % 4 when 0 then vin17 when 1 then lower(vin17) when 2 then concat(substring(vin17, 1, 16), 'Q') else concat(substring(vin17, 1, 8), 'Z', substring(vin17, 10)) end")
    return e.groupBy(F.expr("cast(event_id % 4 as int)").alias("kind")).agg(F.count_if(V.is_valid_vin(given)).alias("valid"), F.count(F.lit(1)).alias("n"))


def vin_synthesise(spark, sf):
    return true_vin(read(spark, sf, "events").select("user_id").distinct()).select("user_id", "vin17")


def dtc_extract(spark, sf):
    return telemetry(spark, sf).filter("dtcs IS NOT NULL").select("seq", F.array_join("dtcs", ",").alias("codes"))


def dtc_enrich(spark, sf):
    code = telemetry(spark, sf).select(F.explode("dtcs").alias("code"))
    known = V.fault_table(spark)
    rich = code.join(F.broadcast(known), "code", "left")  # ten fixed rows
    rich = rich.select("code", V.fault_system(F.col("code")).alias("system"), F.substring("code", 2, 1).isin("0", "2").alias("generic"), F.coalesce("description", F.lit(V.UNKNOWN_CODE[0])).alias("description"), F.coalesce("severity", F.lit(V.UNKNOWN_CODE[1])).alias("severity"))
    return rich.groupBy("code", "system", "generic", "description", "severity").agg(F.count(F.lit(1)).alias("n"))


def haversine(spark, sf):
    return telemetry(spark, sf).select("seq", F.round(V.haversine_km(F.col("lat"), F.col("lon"), F.lit(13.0827), F.lit(80.2707)), 4).alias("km"))


def geohash(spark, sf):
    return telemetry(spark, sf).groupBy(V.geohash(F.col("lat"), F.col("lon"), 5).alias("geohash")).agg(F.count(F.lit(1)).alias("n"))


def sliding_window(spark, sf):
    w = windows.sliding_window(telemetry(spark, sf), key="vin", ts="ts", value="value", seconds=86_400)
    return w.select("seq", F.round("win_mean", 6).alias("win_mean"), "win_max", "win_count")


def alert_rules(spark, sf):
    return rules.row_alerts(telemetry(spark, sf), LIMITS).select("vin", "seq", "rule", "severity", F.coalesce("code", F.lit("")).alias("code"), rules.dedup_key(F.col("vin"), F.col("rule"), F.col("code"), F.col("ts_ms")).alias("dedup_key"))


def rule_overheat(spark, sf):
    return rules.detail_of(rules.overheat_alerts(telemetry(spark, sf), LIMITS), "OVERHEAT_TREND").select("vin", "seq", "severity", "mean_c", "max_c")


def rule_event_pattern(spark, sf):
    return rules.detail_of(rules.pattern_alerts(telemetry(spark, sf), LIMITS), "HARSH_BRAKE_PATTERN").select("vin", "seq", F.col("count_1h").alias("count_in_window"))


def alert_details(spark, sf):
    """What row alerts tell, by rule."""
    found = rules.row_alerts(telemetry(spark, sf), LIMITS)
    coded = rules.detail_of(found, "CRITICAL_DTC").unionByName(rules.detail_of(found, "DTC")).select("rule", F.concat_ws(": ", "code", "description").alias("told"))
    low = [rules.detail_of(found, rule).select("rule", F.format_string("%.1f", c).alias("told")) for rule, c in (("LOW_12V", "volts"), ("LOW_SOC", "soc_pct"))]
    return coded.unionByName(low[0]).unionByName(low[1]).groupBy("rule", "told").agg(F.count(F.lit(1)).alias("n"))


def alert_dedup(spark, sf):
    return rules.first_of_each(rules.alerts(telemetry(spark, sf), LIMITS)).select("dedup_key", "seq", "rule")


def late_flags(spark, sf):
    arrived = telemetry(spark, sf).withColumn("arrival", F.expr("seq + case when seq % 50 = 0 then 1200 else 0 end"))
    return windows.late_flags(arrived, key="vin", seq="seq", arrival="arrival").select("seq", "is_late")


def rolling_median(spark, sf):
    return windows.rolling_upper_median(telemetry(spark, sf), key="vin", order="seq", value="value").select("seq", "rolling_median")


def live_state(spark, sf):
    return windows.latest(telemetry(spark, sf).select("vin", "seq", "ts", "lat", "lon", "speed_kmh"), key="vin", seq="seq").withColumns({c: F.round(c, 5) for c in ("lat", "lon")})


def stride_sample(spark, sf):
    return windows.stride_sample(telemetry(spark, sf).select("vin").distinct(), key="vin", limit=40)


def _moving(spark, sf):
    return journeys.trip_segments(telemetry(spark, sf).withColumn("day", F.to_date("ts")).withColumn("v", F.expr("value / 10")), key="vin", day="day", order="seq", speed="v")


def trip_segments(spark, sf):
    return _moving(spark, sf).select("vin", "day", "position", "moving")


def trip_islands(spark, sf):
    numbered = telemetry(spark, sf).select("vin", (F.row_number().over(Window.partitionBy("vin").orderBy("seq")) - 1).cast("long").alias("position"), F.expr("case when speed_kmh > 20 then 1 else 0 end").alias("moving"))
    return windows.islands(numbered, key="vin", position="position", flag="moving")


def daily_rollup(spark, sf):
    r = rollup.daily_rollup(telemetry(spark, sf))
    return _rounded(r)


def _rounded(r):
    return r.withColumns({c: F.round(c, 4) for c in ("min_odo", "max_odo", "sum_speed", "max_coolant", "min_batt_v")})


def incremental_rollup(spark, sf):
    t = telemetry(spark, sf)
    merged, _ = rollup.incremental_rollup(rollup.daily_rollup(t.filter(F.col("ts") <= F.lit(LOW))), t, LOW, HIGH)
    return _rounded(merged)


def stored_rollup(spark, sf):
    """The rollup as a stored table, after three steps, the second of them asked for twice."""
    from ..streaming.jobs import folder

    t, store = telemetry(spark, sf), rollup.StoredRollup(spark, folder(spark, "stored-rollup"))
    for now in (LOW, HIGH, HIGH, HIGH + dt.timedelta(days=2)):
        store.advance(t, now, start=dt.datetime(2024, 1, 3))
    return _rounded(store.table())


def retained_hours(spark, sf):
    """What is left of an hourly catalog table after its old partitions are dropped."""
    from ..streaming.jobs import folder

    at = folder(spark, "hours")
    table = f"hours_{at[-32:]}"
    rollup.hours_table(telemetry(spark, sf).select("vin", "seq", "ts"), table, path=at, spread=1)
    gone = rollup.drop_old_hours(spark, table, dt.datetime(2024, 1, 20), 48)
    spark.sql(f"DROP TABLE {table}")
    left = spark.read.parquet(at).groupBy("d", "h").agg(F.count(F.lit(1)).alias("rows"))
    return left.select("d", F.col("h").cast("int").alias("h"), "rows").unionByName(spark.range(1).select(F.lit(None).cast("date").alias("d"), F.lit(-1).alias("h"), F.lit(gone).cast("long").alias("rows")))


def retention_plan(spark, sf):
    plan = rollup.retention_plan(telemetry(spark, sf), dt.datetime(2024, 1, 20), 48)
    return plan.select(F.col("hour").cast("timestamp_ntz").alias("hour"), "rows", "dropped")


def sink_idempotent_append(spark, sf):
    t = telemetry(spark, sf).select("vin", "seq", "ts", "value")
    again = t.unionByName(t.filter("seq % 97 = 0"))
    return sinks.fresh_rows(again, t.filter("seq % 3 = 0"), ["vin", "seq", "ts"])


def sink_new_alerts(spark, sf):
    found = rules.first_of_each(rules.alerts(telemetry(spark, sf), LIMITS)).select("dedup_key", "rule", "vin")
    old = rules.first_of_each(rules.row_alerts(telemetry(spark, sf).filter("seq % 2 = 0"), LIMITS).withColumn("dedup_key", rules.dedup_key(F.col("vin"), F.col("rule"), F.col("code"), F.col("ts_ms"))))
    return sinks.fresh_rows(found, old, ["dedup_key"]).groupBy("rule").agg(F.count(F.lit(1)).alias("n"))


def alert_fanout(spark, sf):
    from ..streaming.jobs import folder

    at = folder(spark, "fan-out")
    sinks.write_fan_out(alerts(spark, sf).filter("is_open").select("tenant_id", "alert_id", "severity"), at)
    return spark.read.parquet(at).groupBy(F.col("tenant_id").cast("int").alias("tenant_id")).agg(F.count(F.lit(1)).alias("n"), F.max("alert_id").alias("last_alert"))


def upsert_snapshot(spark, sf):
    v = vehicles(spark, sf).select("vin", "balance")
    new = v.filter("cast(substring(vin, 3) as int) % 3 = 0").withColumn("balance", F.round(F.col("balance") + 1000, 2))
    return sinks.upserted(v.filter("cast(substring(vin, 3) as int) % 7 <> 0"), new, "vin")


def audit_append(spark, sf):
    a = alerts(spark, sf).filter("is_open AND severity >= 4")
    return sinks.audit_rows(a, actor=F.concat(F.lit("user"), F.col("id").cast("string")), action="ack", resource=F.concat(F.lit("alert/"), F.col("alert_id").cast("string")), detail=F.col("rule"))


QUERIES = {f.__name__: f for f in (
    parse_payloads, normalise, dlq_split, dim_tenant_of, outcome_counts, vin_quality, vin_synthesise, dtc_extract, dtc_enrich, haversine, geohash, sliding_window, alert_rules,
    rule_overheat, rule_event_pattern, alert_details, alert_dedup, late_flags, rolling_median, live_state, stride_sample, trip_segments, trip_islands, daily_rollup, incremental_rollup,
    stored_rollup, retained_hours, retention_plan, sink_idempotent_append, sink_new_alerts, alert_fanout, upsert_snapshot, audit_append,
)}

_KIND = "CASE WHEN event_id % 250 = 0 THEN 'json' WHEN event_id % 250 = 50 THEN 'format' WHEN event_id % 250 = 100 THEN 'schema:seq' WHEN event_id % 250 = 150 THEN 'type:lat' ELSE 'ok' END"
_DTC = "CASE event_id % 7 WHEN 0 THEN ['P0301', 'C0035'] WHEN 3 THEN ['P0217', 'U0100'] END"
_FAULTS = "faults(code, description, severity) AS (VALUES " + ", ".join(f"('{c}', '{d}', {s})" for c, d, s in V.FAULT_CODES) + ")"
_ALERTS = f"""{TELEMETRY_SQL}, {_FAULTS},
coded AS (
  SELECT vin, seq, ts, code, CASE WHEN coalesce(severity, 2) >= 4 THEN 'CRITICAL_DTC' ELSE 'DTC' END AS rule, coalesce(severity, 2) AS severity
  FROM (SELECT vin, seq, ts, unnest(CASE seq % 7 WHEN 0 THEN ['P0301', 'C0035'] WHEN 3 THEN ['P0217', 'U0100'] END) AS code FROM telemetry) LEFT JOIN faults USING (code)
), row_alerts AS (
  SELECT vin, seq, ts, rule, severity, code FROM coded
  UNION ALL SELECT vin, seq, ts, 'LOW_12V', 3, '' FROM telemetry WHERE batt_v < 11.8e0
  UNION ALL SELECT vin, seq, ts, 'LOW_SOC', 2, '' FROM telemetry WHERE soc_pct < 10
), hot AS (
  SELECT vin, seq, ts, 'OVERHEAT_TREND' AS rule, 4 AS severity, '' AS code, m, top FROM (
    SELECT *, avg(coolant_c) OVER w AS m, max(coolant_c) OVER w AS top, count(*) OVER w AS n FROM telemetry WHERE coolant_c IS NOT NULL
    WINDOW w AS (PARTITION BY vin ORDER BY ts RANGE BETWEEN INTERVAL 1 DAY PRECEDING AND CURRENT ROW)) WHERE n >= 2 AND m > 100
), pattern AS (
  SELECT vin, seq, ts, 'HARSH_BRAKE_PATTERN' AS rule, 2 AS severity, '' AS code, n FROM (
    SELECT *, count(*) OVER (PARTITION BY vin ORDER BY epoch_us(ts) // 1000 RANGE BETWEEN 604800000 PRECEDING AND CURRENT ROW) AS n FROM telemetry WHERE evt = 'HARSH_BRAKE') WHERE n >= 3
)"""
_KEY = "concat_ws(':', vin, rule, code, cast(epoch_us(ts) // 3600000000 AS varchar))"
_ROLLUP = """SELECT vin, cast(ts AS date) AS day, count(*) AS events, round(min(odo_km), 4) AS min_odo, round(max(odo_km), 4) AS max_odo, round(sum(speed_kmh), 4) AS sum_speed,
 round(max(coolant_c), 4) AS max_coolant, round(min(batt_v), 4) AS min_batt_v, count(*) FILTER (WHERE evt = 'HARSH_BRAKE') AS harsh_brakes,
 count(*) FILTER (WHERE speed_kmh < 1) AS idle_samples, count(*) FILTER (WHERE fault_string IS NOT NULL) AS dtc_events FROM telemetry"""
#: Rejects after enrichment: what parsing leaves, then malformed numbers, then unknown ones.
_REASON = f"""CASE WHEN k <> 'ok' THEN k WHEN event_id % 250 = 200 THEN 'vin' WHEN user_id % 10 = 9 THEN 'unknown vin' END"""

SQL = {
    "parse_payloads": f"""SELECT CASE WHEN k IN ('json', 'format') THEN 'none' WHEN event_id % 2 = 0 THEN 'aurora' ELSE 'borealis' END AS oem, k AS reason, count(*) AS n
        FROM (SELECT *, {_KIND} AS k FROM events) GROUP BY 1, 2""",
    "normalise": f"""WITH {VIN_SQL}, {TELEMETRY_SQL}
        SELECT t.seq, CASE WHEN t.seq % 2 = 0 THEN 'aurora' ELSE 'borealis' END AS oem,
          CASE WHEN t.seq % 250 = 200 THEN replace(vin17, '1HGCM826', '1HGCM82I') ELSE vin17 END AS vin,
          CASE WHEN t.seq % 2 = 0 THEN epoch_us(t.ts) // 1000 ELSE cast(trunc(epoch_us(t.ts) // 1000 / 1000e0 * 1000e0) AS bigint) END AS ts_ms,
          CASE WHEN t.seq % 2 = 0 THEN round(t.value, 3) ELSE round(round(t.value * 1.609344e0, 2), 3) END AS speed_kmh,
          CASE WHEN t.seq % 2 = 0 THEN round(odo_km, 3) ELSE round(round(odo_km * 1.609344e0, 1), 3) END AS odo_km,
          CASE WHEN t.seq % 2 = 1 AND t.user_id % 3 <> 0 THEN round(round((150 + t.value * 1.00003e0 - 32) * 5 / 9, 1), 2) END AS coolant_c,
          batt_v, CASE WHEN t.seq % 2 = 0 THEN soc_pct END AS soc_pct, evt,
          array_to_string(CASE WHEN t.seq % 2 = 0 THEN CASE WHEN t.seq % 7 = 0 THEN ['P0301', 'C0035'] END ELSE {_DTC} END, ',') AS dtcs
        FROM telemetry t JOIN vins v ON t.seq = v.event_id WHERE {_KIND} = 'ok'""",
    "dlq_split": f"SELECT reject_reason, count(*) AS n FROM (SELECT {_REASON} AS reject_reason FROM (SELECT *, {_KIND} AS k FROM events)) WHERE reject_reason IS NOT NULL GROUP BY 1",
    "dim_tenant_of": f"WITH {VIN_SQL} SELECT DISTINCT vin17 AS vin, cast(user_id % 5 AS int) AS tenant_id FROM vins WHERE user_id % 10 <> 9",
    "outcome_counts": f"""SELECT CASE WHEN reject_reason IS NULL THEN 'processed' WHEN reject_reason IN ('vin', 'unknown vin') THEN 'unknown' ELSE 'malformed' END AS outcome, count(*) AS n
        FROM (SELECT {_REASON} AS reject_reason FROM (SELECT *, {_KIND} AS k FROM events)) GROUP BY 1""",
    "vin_quality": "SELECT cast(event_id % 4 AS int) AS kind, count(*) FILTER (WHERE event_id % 4 < 2) AS valid, count(*) AS n FROM events GROUP BY 1",
    "vin_synthesise": f"WITH {VIN_SQL} SELECT DISTINCT user_id, vin17 FROM vins",
    "dtc_extract": "SELECT event_id AS seq, CASE event_id % 7 WHEN 0 THEN 'P0301,C0035' ELSE 'P0217,U0100' END AS codes FROM events WHERE event_id % 7 IN (0, 3)",
    "dtc_enrich": f"""WITH {_FAULTS}, c AS (SELECT unnest({_DTC}) AS code FROM events)
        SELECT code, CASE substring(code, 1, 1) WHEN 'P' THEN 'Powertrain' WHEN 'C' THEN 'Chassis' WHEN 'B' THEN 'Body' ELSE 'Network' END AS system,
          substring(code, 2, 1) IN ('0', '2') AS generic, coalesce(description, 'Unknown code') AS description, coalesce(severity, 2) AS severity, count(*) AS n
        FROM c LEFT JOIN faults USING (code) GROUP BY 1, 2, 3, 4, 5""",
    "haversine": f"""WITH {TELEMETRY_SQL} SELECT seq, round(2 * 6371 * asin(sqrt(pow(sin(radians(13.0827e0 - lat) / 2), 2) + cos(radians(lat)) * cos(radians(13.0827e0)) * pow(sin(radians(80.2707e0 - lon) / 2), 2))), 4) AS km FROM telemetry""",
    "geohash": f"""WITH {TELEMETRY_SQL}, cells AS (
          SELECT cast(floor((lon + 180) / 360 * 8192) AS bigint) AS x, cast(floor((lat + 90) / 180 * 4096) AS bigint) AS y FROM telemetry
        ), bits AS (
          SELECT list_transform(range(0, 25), lambda k: CASE WHEN k % 2 = 0 THEN (x >> cast(12 - k // 2 AS int)) & 1 ELSE (y >> cast(11 - k // 2 AS int)) & 1 END) AS b FROM cells
        )
        SELECT array_to_string(list_transform(range(0, 5), lambda c: substring('0123456789bcdefghjkmnpqrstuvwxyz', cast(16*b[5*c+1] + 8*b[5*c+2] + 4*b[5*c+3] + 2*b[5*c+4] + b[5*c+5] + 1 AS int), 1)), '') AS geohash, count(*) AS n
        FROM bits GROUP BY 1""",
    "sliding_window": f"""WITH {TELEMETRY_SQL} SELECT seq, round(avg(value) OVER w, 6) AS win_mean, max(value) OVER w AS win_max, count(*) OVER w AS win_count FROM telemetry
        WINDOW w AS (PARTITION BY vin ORDER BY ts RANGE BETWEEN INTERVAL 1 DAY PRECEDING AND CURRENT ROW)""",
    "alert_rules": f"WITH {_ALERTS} SELECT vin, seq, rule, severity, code, {_KEY} AS dedup_key FROM row_alerts",
    "rule_overheat": f"WITH {_ALERTS} SELECT vin, seq, severity, round(m + 1e-9, 1) AS mean_c, round(top, 3) AS max_c FROM hot",
    "alert_details": f"""WITH {_ALERTS} SELECT rule, concat(code, ': ', coalesce(description, 'Unknown code')) AS told, count(*) AS n FROM coded LEFT JOIN (SELECT code, description FROM faults) USING (code) GROUP BY 1, 2
        UNION ALL SELECT 'LOW_12V', printf('%.1f', batt_v), count(*) FROM telemetry WHERE batt_v < 11.8e0 GROUP BY 1, 2
        UNION ALL SELECT 'LOW_SOC', printf('%.1f', soc_pct), count(*) FROM telemetry WHERE soc_pct < 10 GROUP BY 1, 2""",
    "rule_event_pattern": f"WITH {_ALERTS} SELECT vin, seq, n AS count_in_window FROM pattern",
    "alert_dedup": f"""WITH {_ALERTS}, every AS (SELECT * FROM row_alerts UNION ALL SELECT vin, seq, ts, rule, severity, code FROM hot UNION ALL SELECT vin, seq, ts, rule, severity, code FROM pattern)
        SELECT dedup_key, seq, rule FROM (SELECT *, {_KEY} AS dedup_key FROM every) QUALIFY row_number() OVER (PARTITION BY dedup_key ORDER BY ts, seq) = 1""",
    "late_flags": f"""WITH {TELEMETRY_SQL} SELECT seq, seq <= coalesce(max(seq) OVER (PARTITION BY vin ORDER BY seq + CASE WHEN seq % 50 = 0 THEN 1200 ELSE 0 END ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) AS is_late FROM telemetry""",
    "rolling_median": f"""WITH {TELEMETRY_SQL} SELECT seq, list_sort(l)[len(l) // 2 + 1] AS rolling_median FROM (
          SELECT seq, list(value) OVER (PARTITION BY vin ORDER BY seq ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) AS l FROM telemetry)""",
    "live_state": f"WITH {TELEMETRY_SQL} SELECT vin, seq, ts, round(lat, 5) AS lat, round(lon, 5) AS lon, speed_kmh FROM telemetry QUALIFY row_number() OVER (PARTITION BY vin ORDER BY seq DESC) = 1",
    "stride_sample": f"""WITH {TELEMETRY_SQL}, n AS (
          SELECT vin, row_number() OVER (ORDER BY ('0x' || substr(md5(vin), 1, 6))::INT % 64, vin) - 1 AS nth, count(*) OVER () AS total FROM (SELECT DISTINCT vin FROM telemetry)
        ), s AS (SELECT *, CASE WHEN total <= 40 THEN 1 ELSE (total + 39) // 40 END AS step FROM n)
        SELECT vin FROM s WHERE nth % step = 0""",
    # lead: the cost of standing so far less that of moving; back from the last sample a label changes where its step came from the other
    "trip_segments": f"""WITH RECURSIVE {TELEMETRY_SQL}, m AS (
          SELECT vin, ts::DATE AS day, row_number() OVER (PARTITION BY vin, ts::DATE ORDER BY seq) - 1 AS position, coalesce(value / 10, 0) / 5 - greatest(0, (5 - coalesce(value / 10, 0)) / 5) AS gain
          FROM telemetry
        ), f AS (
          SELECT vin, day, position, gain AS lead, false AS from_moving, false AS from_standing FROM m WHERE position = 0
          UNION ALL SELECT vin, day, m.position, least(greatest(lead, -2.5e0), 2.5e0) + m.gain, lead > 2.5, lead < -2.5 FROM f JOIN m USING (vin, day) WHERE m.position = f.position + 1
        ), b AS (
          SELECT vin, day, position, from_moving, from_standing, (lead > 0)::INT AS moving FROM f QUALIFY position = max(position) OVER (PARTITION BY vin, day)
          UNION ALL SELECT vin, day, p.position, p.from_moving, p.from_standing, CASE WHEN CASE b.moving WHEN 1 THEN b.from_standing ELSE b.from_moving END THEN 1 - b.moving ELSE b.moving END
          FROM b JOIN f AS p USING (vin, day) WHERE p.position = b.position - 1
        ) SELECT vin, day, position, moving FROM b""",
    "trip_islands": f"""WITH {TELEMETRY_SQL}, p AS (SELECT vin, row_number() OVER (PARTITION BY vin ORDER BY seq) - 1 AS position, speed_kmh > 20 AS moving FROM telemetry),
        c AS (SELECT *, sum(CASE WHEN moving THEN 0 ELSE 1 END) OVER (PARTITION BY vin ORDER BY position) AS run FROM p)
        SELECT vin, min(position) AS first, max(position) AS last FROM c WHERE moving GROUP BY vin, run""",
    "daily_rollup": f"WITH {TELEMETRY_SQL} {_ROLLUP} GROUP BY 1, 2",
    "incremental_rollup": f"WITH {TELEMETRY_SQL} {_ROLLUP} WHERE ts <= TIMESTAMP '2024-01-20 06:00:00' GROUP BY 1, 2",
    "stored_rollup": f"WITH {TELEMETRY_SQL} {_ROLLUP} WHERE ts > TIMESTAMP '2024-01-03' AND ts <= TIMESTAMP '2024-01-22 05:59:40' GROUP BY 1, 2",
    "retained_hours": """SELECT cast(ts AS date) AS d, hour(ts)::INT AS h, count(*) AS rows FROM events WHERE date_trunc('hour', ts) + INTERVAL 1 HOUR > TIMESTAMP '2024-01-18' GROUP BY 1, 2
        UNION ALL SELECT NULL, -1, count(DISTINCT date_trunc('hour', ts)) FROM events WHERE date_trunc('hour', ts) + INTERVAL 1 HOUR <= TIMESTAMP '2024-01-18'""",
    "retention_plan": f"""WITH {TELEMETRY_SQL} SELECT date_trunc('hour', ts) AS hour, count(*) AS rows, date_trunc('hour', ts) + INTERVAL 1 HOUR <= TIMESTAMP '2024-01-18 00:00:00' AS dropped FROM telemetry GROUP BY 1""",
    "sink_idempotent_append": f"WITH {TELEMETRY_SQL} SELECT vin, seq, ts, value FROM telemetry WHERE seq % 3 <> 0",
    "sink_new_alerts": f"""WITH {_ALERTS}, every AS (SELECT * FROM row_alerts UNION ALL SELECT vin, seq, ts, rule, severity, code FROM hot UNION ALL SELECT vin, seq, ts, rule, severity, code FROM pattern),
        old AS (SELECT DISTINCT {_KEY} AS k FROM row_alerts WHERE seq % 2 = 0)
        SELECT rule, count(DISTINCT {_KEY}) AS n FROM every WHERE {_KEY} NOT IN (SELECT k FROM old) GROUP BY rule""",
    "alert_fanout": f"WITH {ALERTS_SQL} SELECT tenant_id, count(*) AS n, max(alert_id) AS last_alert FROM alerts WHERE is_open GROUP BY tenant_id",
    "audit_append": f"""WITH {ALERTS_SQL} SELECT tenant_id, concat('user', id) AS actor, 'ack' AS action, concat('alert/', alert_id) AS resource, rule AS detail
        FROM alerts WHERE is_open AND severity >= 4""",
    "upsert_snapshot": """SELECT concat('VH', lpad(cast(c_custkey AS varchar), 8, '0')) AS vin, CASE WHEN c_custkey % 3 = 0 THEN round(c_acctbal + 1000, 2) ELSE c_acctbal END AS balance
        FROM customer WHERE c_custkey % 3 = 0 OR c_custkey % 7 <> 0""",
}
