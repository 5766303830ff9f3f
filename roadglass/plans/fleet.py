"""Serving queries, changes and risk over the fleet tables."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Window, functions as F

from ..functions.text import cursor_key
from ..operators import journeys, risk, rollup, serving
from ..operators.ordering import written
from .bindings import ALERTS_SQL, TELEMETRY_SQL, VEHICLES_SQL, alerts, read, risks, telemetry, vehicles

TENANT = 2


def list_vehicles(spark, sf):
    return vehicles(spark, sf).join(risks(spark, sf).select("vin", "score"), "vin", "left").select("vin", "tenant_id", "model", "powertrain", "model_year", "score")


def tenant_scope(spark, sf):
    return serving.tenant_scope(vehicles(spark, sf), TENANT).select("vin", "tenant_id", "model")


def mask_location(spark, sf):
    role = F.expr("case tenant_id when 0 then 'admin' when 1 then 'fleet_manager' when 2 then 'analyst' else 'guest' end")
    seen = serving.mask_positions(telemetry(spark, sf).select("seq", "tenant_id", "lat", "lon"), role)
    return seen.groupBy("masked", F.coalesce(F.substring("geohash", 1, 3), F.lit("exact")).alias("cell")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("lat"), 3).alias("mean_lat"))


def role_permissions(spark, sf):
    asked = alerts(spark, sf).select("alert_id", F.expr("case alert_id % 4 when 0 then 'admin' when 1 then 'fleet_manager' when 2 then 'analyst' else 'guest' end").alias("role"), F.expr("case alert_id % 3 when 0 then 'read' when 1 then 'approve' else 'erase' end").alias("perm"))
    return serving.allowed(asked, serving.role_permissions(spark)).groupBy("role", "perm").agg(F.count(F.lit(1)).alias("n"))


def dq_report(spark, sf):
    v, a = vehicles(spark, sf), alerts(spark, sf)
    one = v.agg(F.count(F.lit(1)).alias("rows"), F.count_if(~F.col("powertrain").isin("ICE", "HEV", "EV")).alias("bad_powertrain"), F.count_if(F.col("balance") < 0).alias("negative_balance"))
    two = a.agg(F.count_if(~F.col("severity").between(1, 5)).alias("bad_severity"), F.count_if(F.col("created_at").isNull()).alias("no_time"))
    return one.join(two)


def keyset_page(spark, sf):
    first = serving.keyset_page(vehicles(spark, sf).filter("powertrain = 'EV'").select("vin", "model"), key="vin", after="VH00000030", limit=25)
    return first.withColumn("next_key", cursor_key(F.col("next_cursor"))).drop("next_cursor")


def list_alerts(spark, sf):
    a = alerts(spark, sf).filter(f"is_open AND severity >= 3 AND tenant_id = {TENANT}").select("alert_id", "vin", "rule", "severity")
    return serving.keyset_page(a, key="alert_id", after=1 << 62, limit=50, descending=True).drop("next_cursor")


def top_risk(spark, sf):
    return serving.top_per_group(risks(spark, sf), group="tenant_id", score="score", tie="vin", limit=25).select("tenant_id", "rank", "vin", "model", "score")


def recent_series(spark, sf):
    own = telemetry(spark, sf).filter("vin = 'VH00000007'").select("ts", "seq", "value", "batt_v")
    return serving.recent(own, ts="ts", since=dt.datetime(2024, 1, 10), limit=60, tie="seq")


def vehicle_summary(spark, sf):
    """Vehicles with risk, drivers (here the model and whether the risk is high) and the last ten alerts."""
    drivers = F.array(F.struct(F.col("model").alias("label")), F.struct(F.when(F.col("score") >= 0.3, "high").otherwise("low").alias("label")))
    return serving.vehicle_summary(vehicles(spark, sf).select("vin", "model", "powertrain"), risks(spark, sf).withColumn("factors", drivers), alerts(spark, sf))


def vehicle_series(spark, sf):
    """Every vehicle's samples of two days and its newest row."""
    s = serving.vehicle_series(telemetry(spark, sf), until=dt.datetime(2024, 1, 20), minutes=2880, limit=5)
    return s.select("vin", F.array_join(F.transform("series", lambda x: x["seq"].cast("string")), ",").alias("series"), F.col("live.seq").alias("live_seq"))


def fleet_kpis(spark, sf):
    return serving.fleet_kpis(vehicles(spark, sf), alerts(spark, sf), risks(spark, sf))


def estimate_savings(spark, sf):
    return serving.estimate_savings(serving.tenant_scope(risks(spark, sf), TENANT), 50)


def radius_search(spark, sf):
    return serving.radius_search(telemetry(spark, sf).select("seq", "lat", "lon"), lat=13.0827, lon=80.2707, radius_km=250).select("seq", F.round("km", 3).alias("km"))


def radius_join(spark, sf):
    """Around every 53rd sample, within 5 to 105 km: how many samples lie there, and how far the farthest is."""
    t = telemetry(spark, sf).select("seq", "lat", "lon")
    centres = t.filter("seq % 53 = 0").select(F.col("seq").alias("centre"), "lat", "lon", F.expr("5e0 + seq % 5 * 25").alias("radius_km"))
    return serving.radius_totals(t, centres, value="seq").select("centre", "n", F.col("total").alias("seqs"), F.round("farthest", 3).alias("farthest"))


def interval_join(spark, sf):
    """Orders of a customer as assignments, each until the next: which one holds at each event of that user."""
    o = read(spark, sf, "orders").select(F.col("o_custkey").alias("user_id"), F.col("o_orderkey").alias("assignment"), F.expr("o_orderdate + interval 9 years").alias("valid_from"))
    after = F.lead("valid_from").over(Window.partitionBy("user_id").orderBy("valid_from", "assignment"))
    e = telemetry(spark, sf).select("user_id", "seq", "ts")
    return serving.interval_join(e, o.withColumn("valid_to", after), key="user_id", ts="ts").select("seq", "assignment")


def assignment_at(spark, sf):
    """Orders as short assignments within the time of the events, by a merge: which one holds at each event, if any."""
    begins = F.expr("cast(date_add(DATE '2023-12-25', cast(o_orderkey % 37 as int)) as timestamp_ntz)")
    o = read(spark, sf, "orders").groupBy(F.expr("o_custkey % 200").alias("user_id"), begins.alias("valid_from")).agg(F.max("o_orderkey").alias("assignment"))
    e = telemetry(spark, sf).select("user_id", "seq", "ts")
    return serving.assignment_at(e, o.withColumn("valid_to", F.expr("valid_from + interval 60 hours")), key="user_id", ts="ts").select("seq", "assignment", "valid_from")


def ack_alerts(spark, sf):
    """Every fifth alert is asked for twice, half of them by another tenant; the earlier request is recorded."""
    a = alerts(spark, sf).select("alert_id", "tenant_id", F.when(~F.col("is_open"), F.lit(0)).alias("acked_by"), F.lit(None).cast("string").alias("acked_at"))
    tenant = F.expr("cast(case when alert_id % 10 = 0 then tenant_id else (tenant_id + 1) % 5 end as int)").alias("tenant_id")
    asked = a.filter("alert_id % 5 = 0").select("alert_id", tenant, F.expr("cast(alert_id % 7 + 1 as int)").alias("user_id"), F.lit("2024-02-02").alias("at"))
    again = asked.withColumns({"user_id": F.col("user_id") + 10, "at": F.lit("2024-02-01")}).filter("alert_id % 20 = 0")
    return serving.acknowledge(a, asked.unionByName(again)).groupBy("changed", "acked_by", "acked_at").agg(F.count(F.lit(1)).alias("n"))


def decide_work_orders(spark, sf):
    o = alerts(spark, sf).select(F.col("alert_id").alias("work_order_id"), "tenant_id", F.when(F.col("is_open"), "proposed").otherwise("done").alias("status"), F.lit(None).cast("int").alias("approved_by"))
    said = o.filter("work_order_id % 3 = 0").select("work_order_id", "tenant_id", (F.col("work_order_id") % 2 == 0).alias("approve"), F.expr("cast(work_order_id % 5 as int)").alias("user_id"))
    return serving.decide(o, said).select("work_order_id", "status", "approved_by")


def propose_work_orders(spark, sf):
    """Requests in lower case, a quarter of them by another tenant, each made twice."""
    v = vehicles(spark, sf)
    asked = v.select(F.lower("vin").alias("vin"), F.expr("cast(case when id % 4 = 0 then tenant_id + 1 else tenant_id end as int)").alias("tenant_id"), F.expr("repeat(concat('check ', vin, ' '), 30)").alias("reason"), F.expr("cast(id % 9 as int)").alias("user_id"))
    return serving.propose(v, asked.unionByName(asked)).select("vin", "tenant_id", F.char_length("reason").cast("int").alias("reason_chars"), "proposed_by", "est_cost_usd", "status")


def erase_pii(spark, sf):
    """Every third person is asked for, every sixth of these by a tenant that is not theirs."""
    people = read(spark, sf, "customer").select("c_custkey", F.expr("cast(c_nationkey % 5 as int)").alias("tenant_id"), "c_name", "c_acctbal", F.when(F.col("c_custkey") % 9 == 0, F.lit("2024-01-01")).alias("erased_at"))
    asked = people.filter("c_custkey % 3 = 0").select("c_custkey", F.expr("cast(case when c_custkey % 6 = 0 then (tenant_id + 1) % 5 else tenant_id end as int)").alias("tenant_id"))
    return serving.erase(people, asked, id_col="c_custkey", at="2024-06-01", columns=["c_name"])


def erase_audit(spark, sf):
    """The audit rows of the erasures of erase_pii, each asked for by two users."""
    people = read(spark, sf, "customer").select("c_custkey", F.expr("cast(c_nationkey % 5 as int)").alias("tenant_id"), "c_name", F.when(F.col("c_custkey") % 9 == 0, F.lit("2024-01-01")).alias("erased_at"))
    asked = people.filter("c_custkey % 3 = 0").select("c_custkey", F.expr("cast(case when c_custkey % 6 = 0 then (tenant_id + 1) % 5 else tenant_id end as int)").alias("tenant_id"), F.explode(F.array(F.lit(7), F.lit(4))).alias("user_id"))
    return serving.erase_audited(people, asked, id_col="c_custkey", at="2024-06-01", columns=["c_name"])[1]


def _features(spark, sf):
    v = vehicles(spark, sf).withColumn("tenant_id", F.col("tenant_id").cast("int"))
    return risk.features(rollup.daily_rollup(telemetry(spark, sf)), v, as_of="2024-01-30", as_of_year=2026)


def features(spark, sf):
    f = _features(spark, sf)
    return f.select("vin", "tenant_id", *[F.round(c, 5).alias(c) for c in risk.FEATURES])


def baseline_score(spark, sf):
    return _features(spark, sf).select("vin", F.round(risk.baseline_score(F.col("service_overdue_ratio")), 5).alias("baseline"))


def feature_medians(spark, sf):
    return risk.medians(_features(spark, sf)).select(*[F.round(c, 5).alias(c) for c in risk.FEATURES])


#: Importances for the explanation query, so that it does not hang on a fitted model.
IMPORTANCE = {c: w for c, w in zip(risk.FEATURES, (0.9, 0.1, 0.3, 0.5, 0.4, 0.6, 0.2, 0.0, 0.0), strict=True)}


def explain_factors(spark, sf):
    f = written(_features(spark, sf), "features")  # for the medians and for the factors
    middle = risk.medians(f).first().asDict()
    told = risk.explain_factors(f, middle, IMPORTANCE)
    return told.select("vin", F.array_join(F.transform("factors", lambda x: x["feature"]), ",").alias("factors"))


def _labelled(spark, sf):
    """Breakdown labels from the features, with noise by hash that is about as large as what they tell."""
    f = _features(spark, sf)
    push = F.col("dtc_events_7d") * 0.4 + F.col("harsh_brakes_7d") * 0.3 + (12.6 - F.col("min_batt_v_7d")) * 0.5 + F.conv(F.substring(F.md5(F.col("vin").cast("binary")), 1, 4), 16, 10).cast("double") / 65536.0
    return f.withColumn("label", (push > 3.0).cast("int"))


def risk_split(spark, sf):
    """How many of each class are trained on and held out."""
    train, test = risk.split(_labelled(spark, sf), label="label", key="vin")
    both = train.withColumn("held_out", F.lit(False)).unionByName(test.withColumn("held_out", F.lit(True)))
    return both.groupBy("label", "held_out").agg(F.count(F.lit(1)).alias("n"))


def risk_quality(spark, sf):
    """A model trained on one part against the baseline on the other: which ranks breakdowns better."""
    train, test = risk.split(_labelled(spark, sf), label="label", key="vin")
    scored = risk.score_risk(risk.train_risk(train, label="label"), test).withColumn("baseline", risk.baseline_score(F.col("service_overdue_ratio")))
    found = {r["score"]: r for r in risk.quality(scored, label="label", scores=["score", "baseline"], key="vin").collect()}
    better = [found["score"][m] > found["baseline"][m] for m in ("roc_auc", "average_precision")]
    return test.agg(F.count(F.lit(1)).alias("held_out"), F.sum("label").cast("long").alias("positives"), F.lit(better[0]).alias("better_auc"), F.lit(better[1]).alias("better_precision"))


def train_risk(spark, sf):
    from ..operators import metrics

    train, test = risk.split(_labelled(spark, sf), label="label", key="vin")
    scored = risk.score_risk(risk.train_risk(train, label="label"), test)
    return metrics.roc_auc(scored, score="score", label="label").join(scored.agg(F.count(F.lit(1)).alias("held_out"), F.avg("label").alias("positive_rate")))


def score_risk(spark, sf):
    f = _labelled(spark, sf)
    return risk.score_risk(risk.train_risk(f, label="label"), f).select("vin", "tenant_id", "score", risk.baseline_score(F.col("service_overdue_ratio")).alias("baseline"))


def feature_importance(spark, sf):
    train, test = risk.split(_labelled(spark, sf), label="label", key="vin")
    model = risk.train_risk(train, label="label")
    middle = {c: v or 0.0 for c, v in risk.medians(test).first().asDict().items()}
    return risk.feature_importance(model, test, middle)


def _edges(spark, sf):
    """Roads between nations: who trades with whom, cheap where much is traded."""
    li = read(spark, sf, "lineitem").groupBy("l_orderkey", "l_suppkey").agg(F.count(F.lit(1)).alias("n"))
    o, c, s = read(spark, sf, "orders"), read(spark, sf, "customer"), read(spark, sf, "supplier")
    j = li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(c, F.col("o_custkey") == F.col("c_custkey")).join(s, F.col("l_suppkey") == F.col("s_suppkey"))
    return j.groupBy(F.col("c_nationkey").alias("src"), F.col("s_nationkey").alias("dst")).agg(F.sum("n").alias("n")).filter("src <> dst").select("src", "dst", F.round(1_000_000.0 / F.col("n")).alias("cost"))  # whole, so sums are exact


def nearest_target(spark, sf):
    nations = read(spark, sf, "nation")
    sources, targets = nations.filter("n_nationkey % 5 <> 0").select(F.col("n_nationkey").alias("node")), nations.filter("n_nationkey % 5 = 0").select(F.col("n_nationkey").alias("node"))
    return journeys.nearest_target(_edges(spark, sf), sources, targets, max_cost=60_000.0).select("source", "target", (F.col("cost") / 1000).alias("cost"), "path")


QUERIES = {f.__name__: f for f in (
    list_vehicles, tenant_scope, mask_location, role_permissions, dq_report, keyset_page, list_alerts, top_risk, recent_series, vehicle_summary, vehicle_series, fleet_kpis, estimate_savings, radius_search,
    radius_join, interval_join, assignment_at, ack_alerts, decide_work_orders, propose_work_orders, erase_pii, erase_audit, features, baseline_score, feature_medians, explain_factors, risk_split, risk_quality, train_risk, score_risk, feature_importance, nearest_target,
)}

#: The label of _labelled in SQL.
_LABEL = "(dtc_events_7d * 0.4e0 + harsh_brakes_7d * 0.3e0 + (12.6e0 - min_batt_v_7d) * 0.5e0 + ('0x' || substr(md5(vin), 1, 4))::INT / 65536e0 > 3.0e0)::INT"

_ROLES = "roles(role, perm) AS (VALUES " + ", ".join(f"('{r}', '{p}')" for r, perms in serving.ROLES.items() for p in perms) + ")"
_FEATURES = f"""WITH {TELEMETRY_SQL}, {VEHICLES_SQL}, week AS (
  SELECT vin, max(odo_km) AS odo, max(coolant_c) AS hot, min(batt_v) AS volt, count(*) FILTER (WHERE fault_string IS NOT NULL) AS dtc, count(*) FILTER (WHERE evt = 'HARSH_BRAKE') AS brakes
  FROM telemetry WHERE cast(ts AS date) >= DATE '2024-01-23' GROUP BY vin
), f AS (
  SELECT v.vin, cast(v.tenant_id AS int) AS tenant_id, (odo - last_service_odo_km) / service_interval_km AS service_overdue_ratio, cast(2026 - model_year AS double) AS vehicle_age_yrs,
    odo / 10000 AS odo_10k_km, coalesce(hot, 0) AS max_coolant_7d, coalesce(volt, 12.6) AS min_batt_v_7d, cast(dtc AS double) AS dtc_events_7d, cast(brakes AS double) AS harsh_brakes_7d,
    cast(powertrain = 'EV' AS int)::double AS is_ev, cast(powertrain = 'HEV' AS int)::double AS is_hybrid
  FROM vehicles v JOIN week USING (vin)
)"""
_NAMES = risk.FEATURES
_PUSH = "\n UNION ALL ".join(
    f"SELECT vin, '{c}' AS feature, {IMPORTANCE[c]}::double * d / (abs(m) + 1e-6) AS push, round({c}, 2) AS value FROM (SELECT vin, {c}, m.{c} AS m, {'m.' + c + ' - f.' + c if c in risk.LOW_IS_BAD else 'f.' + c + ' - m.' + c} AS d FROM (SELECT vin, {c} FROM f) f, (SELECT {c} FROM m) m) WHERE d > 0".replace(f"SELECT vin, {c}, m.{c}", f"SELECT f.vin, f.{c}, m.{c}")
    for c in _NAMES if c not in risk.FLAGS
)

SQL = {
    "list_vehicles": f"WITH {VEHICLES_SQL} SELECT vin, v.tenant_id, v.model, powertrain, model_year, score FROM vehicles v LEFT JOIN risks USING (vin)",
    "tenant_scope": f"WITH {VEHICLES_SQL} SELECT vin, tenant_id, model FROM vehicles WHERE tenant_id = {TENANT}",
    "mask_location": f"""WITH {TELEMETRY_SQL}, cells AS (
          SELECT seq, tenant_id, lat, lon, tenant_id >= 2 AS masked, cast(floor((lon + 180) / 360 * 256) AS bigint) AS x, cast(floor((lat + 90) / 180 * 128) AS bigint) AS y FROM telemetry
        ), bits AS (
          SELECT *, list_transform(range(0, 15), lambda k: CASE WHEN k % 2 = 0 THEN (x >> cast(7 - k // 2 AS int)) & 1 ELSE (y >> cast(6 - k // 2 AS int)) & 1 END) AS b FROM cells
        )
        SELECT masked, CASE WHEN masked THEN array_to_string(list_transform(range(0, 3), lambda c: substring('0123456789bcdefghjkmnpqrstuvwxyz', cast(16*b[5*c+1] + 8*b[5*c+2] + 4*b[5*c+3] + 2*b[5*c+4] + b[5*c+5] + 1 AS int), 1)), '') ELSE 'exact' END AS cell,
          count(*) AS n, round(avg(CASE WHEN masked THEN round(lat, 1) ELSE lat END), 3) AS mean_lat FROM bits GROUP BY 1, 2""",
    "role_permissions": f"""WITH {_ROLES}, asked AS (SELECT CASE o_orderkey % 4 WHEN 0 THEN 'admin' WHEN 1 THEN 'fleet_manager' WHEN 2 THEN 'analyst' ELSE 'guest' END AS role,
          CASE o_orderkey % 3 WHEN 0 THEN 'read' WHEN 1 THEN 'approve' ELSE 'erase' END AS perm FROM orders)
        SELECT role, perm, count(*) AS n FROM asked JOIN roles USING (role, perm) GROUP BY 1, 2""",
    "dq_report": f"""WITH {ALERTS_SQL} SELECT a.*, b.* FROM
        (SELECT count(*) AS rows, count(*) FILTER (WHERE powertrain NOT IN ('ICE', 'HEV', 'EV')) AS bad_powertrain, count(*) FILTER (WHERE balance < 0) AS negative_balance FROM vehicles) a,
        (SELECT count(*) FILTER (WHERE severity NOT BETWEEN 1 AND 5) AS bad_severity, count(*) FILTER (WHERE created_at IS NULL) AS no_time FROM alerts) b""",
    "keyset_page": f"""WITH {VEHICLES_SQL}, page AS (SELECT vin, model FROM vehicles WHERE powertrain = 'EV' AND vin > 'VH00000030' ORDER BY vin LIMIT 25)
        SELECT vin, model, CASE WHEN count(*) OVER () = 25 THEN max(vin) OVER () END AS next_key FROM page""",
    "list_alerts": f"WITH {ALERTS_SQL} SELECT alert_id, vin, rule, severity FROM alerts WHERE is_open AND severity >= 3 AND tenant_id = {TENANT} ORDER BY alert_id DESC LIMIT 50",
    "top_risk": f"WITH {VEHICLES_SQL} SELECT tenant_id, cast(row_number() OVER w AS int) AS rank, vin, model, score FROM risks WINDOW w AS (PARTITION BY tenant_id ORDER BY score DESC, vin) QUALIFY row_number() OVER w <= 25",
    "recent_series": f"WITH {TELEMETRY_SQL} SELECT ts, seq, value, batt_v FROM telemetry WHERE vin = 'VH00000007' AND ts >= TIMESTAMP '2024-01-10 00:00:00' ORDER BY ts DESC, seq DESC LIMIT 60",
    "vehicle_summary": f"""WITH {ALERTS_SQL}, few AS (
          SELECT vin, string_agg(concat_ws('/', rule, severity, code), ',' ORDER BY alert_id DESC) AS recent FROM (SELECT * FROM alerts QUALIFY row_number() OVER (PARTITION BY vin ORDER BY alert_id DESC) <= 10) GROUP BY vin)
        SELECT v.vin, v.model, powertrain, score, concat(v.model, ',', CASE WHEN score >= 0.3 THEN 'high' ELSE 'low' END) AS drivers, recent FROM vehicles v LEFT JOIN risks USING (vin) LEFT JOIN few USING (vin)""",
    "vehicle_series": f"""WITH {TELEMETRY_SQL}, few AS (
          SELECT vin, ts, seq FROM telemetry WHERE ts > TIMESTAMP '2024-01-18 00:00:00' AND ts <= TIMESTAMP '2024-01-20 00:00:00' QUALIFY row_number() OVER (PARTITION BY vin ORDER BY ts DESC, seq DESC) <= 5
        ), s AS (SELECT vin, string_agg(cast(seq AS varchar), ',' ORDER BY ts, seq) AS series FROM few GROUP BY vin)
        SELECT l.vin, series, live_seq FROM (SELECT vin, max(seq) AS live_seq FROM telemetry WHERE ts <= TIMESTAMP '2024-01-20 00:00:00' GROUP BY vin) l LEFT JOIN s USING (vin)""",
    "fleet_kpis": f"""WITH {ALERTS_SQL} SELECT (SELECT count(*) FROM vehicles) AS vehicles, (SELECT count(*) FROM alerts WHERE is_open) AS open_alerts,
          (SELECT count(*) FROM alerts WHERE is_open AND severity >= 4) AS critical_alerts, (SELECT count(*) FROM risks WHERE score >= 0.3) AS high_risk""",
    "estimate_savings": f"""WITH {VEHICLES_SQL}, s AS (SELECT coalesce(sum(score), 0) AS e, count(*) AS n FROM (SELECT score FROM risks WHERE tenant_id = {TENANT} ORDER BY score DESC, vin LIMIT 50))
        SELECT n AS vehicles, round(e, 1) AS expected_breakdowns, cast(round(e * 2400) AS bigint) AS avoided_usd, cast(round(n * 650 * 0.35) AS bigint) AS planned_usd, cast(round(e * 2400 - n * 650 * 0.35) AS bigint) AS net_usd FROM s""",
    "radius_search": f"""WITH {TELEMETRY_SQL}, d AS (SELECT seq, 2 * 6371 * asin(sqrt(pow(sin(radians(lat - 13.0827e0) / 2), 2) + cos(radians(lat)) * cos(radians(13.0827e0)) * pow(sin(radians(lon - 80.2707e0) / 2), 2))) AS km FROM telemetry)
        SELECT seq, round(km, 3) AS km FROM d WHERE km <= 250""",
    "radius_join": f"""WITH {TELEMETRY_SQL}, c AS (SELECT seq AS centre, lat AS clat, lon AS clon, 5e0 + seq % 5 * 25 AS r FROM telemetry WHERE seq % 53 = 0),
        d AS (SELECT centre, seq, r, 2 * 6371 * asin(sqrt(pow(sin(radians(lat - clat) / 2), 2) + cos(radians(lat)) * cos(radians(clat)) * pow(sin(radians(lon - clon) / 2), 2))) AS km FROM telemetry, c)
        SELECT centre, count(*) AS n, sum(seq)::BIGINT AS seqs, round(max(km), 3) AS farthest FROM d WHERE km <= r GROUP BY centre""",
    "assignment_at": f"""WITH {TELEMETRY_SQL}, o AS (
          SELECT o_custkey % 200 AS user_id, (DATE '2023-12-25' + (o_orderkey % 37)::INT)::TIMESTAMP AS valid_from, max(o_orderkey) AS assignment FROM orders GROUP BY 1, 2
        )
        SELECT seq, assignment, valid_from FROM telemetry t ASOF JOIN o ON t.user_id = o.user_id AND t.ts >= o.valid_from WHERE ts < valid_from + INTERVAL 60 HOUR""",
    "interval_join": f"""WITH {TELEMETRY_SQL}, o AS (SELECT o_custkey AS user_id, o_orderkey AS assignment, o_orderdate + INTERVAL 9 YEAR AS valid_from FROM orders),
        a AS (SELECT *, lead(valid_from) OVER (PARTITION BY user_id ORDER BY valid_from, assignment) AS valid_to FROM o)
        SELECT seq, assignment FROM telemetry t JOIN a ON t.user_id = a.user_id AND ts >= valid_from AND (valid_to IS NULL OR ts < valid_to)""",
    "ack_alerts": f"""WITH {ALERTS_SQL} SELECT is_open AND alert_id % 10 = 0 AS changed,
          CASE WHEN NOT is_open THEN 0 WHEN alert_id % 20 = 0 THEN cast(alert_id % 7 + 11 AS int) WHEN alert_id % 10 = 0 THEN cast(alert_id % 7 + 1 AS int) END AS acked_by,
          CASE WHEN NOT is_open THEN NULL WHEN alert_id % 20 = 0 THEN '2024-02-01' WHEN alert_id % 10 = 0 THEN '2024-02-02' END AS acked_at, count(*) AS n FROM alerts GROUP BY 1, 2, 3""",
    "decide_work_orders": f"""WITH {ALERTS_SQL} SELECT alert_id AS work_order_id, CASE WHEN NOT is_open THEN 'done' WHEN alert_id % 6 = 0 THEN 'approved' WHEN alert_id % 3 = 0 THEN 'rejected' ELSE 'proposed' END AS status,
          CASE WHEN is_open AND alert_id % 3 = 0 THEN cast(alert_id % 5 AS int) END AS approved_by FROM alerts""",
    "propose_work_orders": f"WITH {VEHICLES_SQL} SELECT vin, cast(tenant_id AS int) AS tenant_id, 300 AS reason_chars, cast(id % 9 AS int) AS proposed_by, 650::double AS est_cost_usd, 'proposed' AS status FROM vehicles WHERE id % 4 <> 0",
    "erase_pii": """SELECT c_custkey, cast(c_nationkey % 5 AS int) AS tenant_id, CASE WHEN c_custkey % 3 <> 0 OR c_custkey % 6 = 0 THEN c_name END AS c_name, c_acctbal,
        CASE WHEN c_custkey % 9 = 0 THEN '2024-01-01' WHEN c_custkey % 3 = 0 AND c_custkey % 6 <> 0 THEN '2024-06-01' END AS erased_at FROM customer""",
    "erase_audit": """SELECT cast(c_nationkey % 5 AS int) AS tenant_id, 'user4' AS actor, 'erase' AS action, concat('c_custkey/', c_custkey) AS resource, 'c_name' AS detail
        FROM customer WHERE c_custkey % 3 = 0 AND c_custkey % 6 <> 0 AND c_custkey % 9 <> 0""",
    "risk_split": f"""{_FEATURES}, n AS (SELECT {_LABEL} AS label, count(*) AS n FROM f GROUP BY 1)
        SELECT label, false AS held_out, n - round(n * 0.25)::BIGINT AS n FROM n UNION ALL SELECT label, true, round(n * 0.25)::BIGINT FROM n""",
    "risk_quality": f"""{_FEATURES}, n AS (SELECT {_LABEL} AS label, count(*) AS n FROM f GROUP BY 1)
        SELECT sum(round(n * 0.25))::BIGINT AS held_out, sum(label * round(n * 0.25))::BIGINT AS positives, true AS better_auc, true AS better_precision FROM n""",
    "features": f"{_FEATURES} SELECT vin, tenant_id, " + ", ".join(f"round({c}, 5) AS {c}" for c in _NAMES) + " FROM f",
    "baseline_score": f"{_FEATURES} SELECT vin, round(least(greatest(service_overdue_ratio / 1.5e0, 0), 1), 5) AS baseline FROM f",
    "feature_medians": f"{_FEATURES} SELECT " + ", ".join(f"round(median({c}), 5) AS {c}" for c in _NAMES) + " FROM f",
    "explain_factors": f"""{_FEATURES}, m AS (SELECT {', '.join(f'median({c}) AS {c}' for c in _NAMES)} FROM f), pushes AS ({_PUSH}),
        best AS (SELECT * FROM pushes QUALIFY row_number() OVER (PARTITION BY vin ORDER BY push DESC, feature DESC, value DESC) <= 3)
        SELECT f.vin, coalesce(string_agg(feature, ',' ORDER BY push DESC, feature DESC, value DESC), '') AS factors FROM f LEFT JOIN best USING (vin) GROUP BY f.vin""",
    "nearest_target": """WITH RECURSIVE edges AS (
          SELECT c_nationkey AS src, s_nationkey AS dst, round(1000000e0 / count(*)) AS cost
          FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey
          WHERE c_nationkey <> s_nationkey GROUP BY 1, 2
        ), walk AS (
          SELECT n_nationkey AS source, n_nationkey AS node, {'cost': 0e0, 'path': [n_nationkey]} AS best, 0 AS hops FROM nation WHERE n_nationkey % 5 <> 0
          UNION ALL
          SELECT source, dst, min({'cost': best.cost + edges.cost, 'path': list_append(best.path, dst)}), hops + 1
          FROM walk JOIN edges ON node = src WHERE hops < 6 AND best.cost + edges.cost <= 60000 GROUP BY source, dst, hops
        ), ends AS (
          SELECT source, min({'cost': best.cost, 'target': node, 'hops': hops, 'path': best.path}) AS e FROM walk WHERE node % 5 = 0 GROUP BY source
        )
        SELECT source, e.target AS target, e.cost / 1000 AS cost, array_to_string(e.path, '-') AS path FROM ends""",
}
