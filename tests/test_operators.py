"""Operators against brute force and invariants."""

import datetime as dt
import decimal
import heapq
import itertools
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from roadglass.operators import codes, journeys, metrics, risk, rollup, rules, serving, similarity, sketches, windows
from roadglass.sources import payloads, sinks

FLAT = '{"vin":"1M8GDM9AXKP042788","ts":"2025-03-04T05:06:07.890Z","seq":12,"lat":48.15,"lon":11.58,"speed_kmh":81.5,"odo_km":40210.4,"soc_pct":55,"dtc":["U0100"],"evt":"HARSH_BRAKE","coolant_c":88}'
SIGNALS = '"signals":{"speedMph":20,"odometerMi":250,"coolantTempF":203,"lvBatteryVolts":12.1},'
NESTED = '{"vehicleId":"1m8gdm9axkp042788","epoch":1741064767.25,"counter":31,"position":{"latitude":52.5,"longitude":13.4},' + SIGNALS + '"eventType":null,"faultString":"U0100 then DTC:P0171"}'


def parsed(spark, *values):
    return payloads.normalise(spark.createDataFrame([(v,) for v in values], "value string")).collect()


def test_both_formats(spark):
    a, b = parsed(spark, FLAT, NESTED)
    at = dt.datetime(2025, 3, 4, 5, 6, 7, 890_000, dt.timezone.utc)
    assert (a["oem"], a["ts_ms"], a["dtcs"], a["evt"], a["reject_reason"]) == ("aurora", round(at.timestamp() * 1000), ["U0100"], "HARSH_BRAKE", None)
    assert (b["vin"], b["ts_ms"], b["coolant_c"], b["dtcs"], b["batt_v"]) == ("1M8GDM9AXKP042788", 1741064767250, 95.0, ["U0100", "P0171"], 12.1)
    assert (b["speed_kmh"], b["odo_km"]) == (32.19, 402.3)


def test_rejects(spark):
    bad = ['{"bar":[2]}', "{oops", None, "[7, 8]", FLAT.replace("48.15", '"up"'), FLAT.replace('"seq":12,', ""), NESTED.replace('"speedMph":20', '"speedMph":"quick"'), FLAT.replace('"vin":"1M8GDM9AXKP042788"', '"vin":null')]
    assert [r["reject_reason"] for r in parsed(spark, *bad)] == ["format", "json", "json", "json", "type:lat", "schema:seq", "type:signals.speedMph", "schema:vin"]
    assert parsed(spark, NESTED.replace(SIGNALS, ""))[0]["speed_kmh"] == 0


def events(spark, rows):
    return spark.createDataFrame(rows, "vin string, ts_ms long, seq long, coolant_c double, batt_v double, soc_pct double, evt string, dtcs array<string>")


def test_rules_of_single_events(spark):
    got = rules.row_alerts(events(spark, [("v", 0, 1, None, 11.5, 9.0, None, ["P0217", "C0035"]), ("v", 1, 2, None, 12.0, None, None, None)])).collect()
    assert sorted((r["rule"], r["severity"], r["code"] or "") for r in got) == [("CRITICAL_DTC", 5, "P0217"), ("DTC", 3, "C0035"), ("LOW_12V", 3, ""), ("LOW_SOC", 2, "")]


def test_window_rules(spark):
    hot = events(spark, [("v", 0, 1, 115.0, None, None, None, None), ("v", 20_000, 2, 115.0, None, None, None, None), ("v", 900_000, 3, 115.0, None, None, None, None)])
    assert [r["seq"] for r in rules.overheat_alerts(hot).collect()] == [2]
    brakes = events(spark, [("v", 60_000 * k, k, None, None, None, "HARSH_BRAKE", None) for k in range(3)])
    assert [r["seq"] for r in rules.pattern_alerts(brakes).collect()] == [2]
    key = lambda ms: spark.range(1).select(rules.dedup_key(F.lit("v"), F.lit("DTC"), F.lit("P0301"), F.lit(ms)).alias("k")).first()["k"]
    assert key(36_900_000) == key(38_700_000) != key(39_700_000)


def test_sliding_window(spark):
    rng = random.Random(8)
    rows = [(f"v{k % 3}", dt.datetime(2024, 1, 1) + dt.timedelta(seconds=rng.randrange(600)), float(rng.randrange(50))) for k in range(200)]
    df = spark.createDataFrame(rows, "vin string, ts timestamp_ntz, value double")
    got = windows.sliding_window(df, key="vin", ts="ts", value="value", seconds=45).collect()
    for r in got:
        own = [v for vin, t, v in rows if vin == r["vin"] and 0 <= (r["ts"] - t).total_seconds() <= 45]
        assert (r["win_max"], r["win_count"]) == (max(own), len(own)) and abs(r["win_mean"] - sum(own) / len(own)) < 1e-9


def test_late_flags(spark):
    rng = random.Random(4)
    rows = [(rng.choice("xyz"), rng.randrange(40), k) for k in range(150)]
    df = spark.createDataFrame(rows, "vin string, seq long, arrival long")
    got = {r["arrival"]: r["is_late"] for r in windows.late_flags(df, key="vin", seq="seq", arrival="arrival").collect()}
    assert got == {k: any(v == vin and j < k and q >= seq for v, q, j in rows) for vin, seq, k in rows}


def cheapest_labels(speeds):
    """Of all 0/1 label sequences the cheapest; of equally cheap ones that which ends standing, then that which switches
    as early as it can. Speeds in quarters of 5 km/h, so that all sums are exact."""
    def cost(labels):
        each = sum(v / 5 if x == 0 else max(0.0, 1 - v / 5) for v, x in zip(speeds, labels, strict=True))
        return each + 2.5 * sum(x != y for x, y in itertools.pairwise(labels))

    return list(min(itertools.product((0, 1), repeat=len(speeds)), key=lambda x: (cost(x), x[-1], [a != b for a, b in zip(x[-2::-1], x[:0:-1])])))


def test_trips(spark):
    speeds = [0.0] * 6 + [55, 61.25, 2.5, 70, 66.25] + [0.0] * 8 + [35, 48.75]
    df = spark.createDataFrame([("v", 1, k, float(s)) for k, s in enumerate(speeds)], "vin string, day int, seq long, speed double")
    labelled = journeys.trip_segments(df, key="vin", day="day", order="seq", speed="speed")
    assert [(r["first"], r["last"]) for r in windows.islands(labelled, key="vin", position="position", flag="moving").orderBy("first").collect()] == [(6, 10), (19, 20)]
    rng = random.Random(3)
    for _ in range(150):
        v = [rng.choice([0, 1.25, 2.5, 3.75, 5, 8.75, 20]) for _ in range(rng.randrange(1, 11))]
        assert journeys.moving_labels(np.array(v, float)).tolist() == cheapest_labels(v)
    rows = [(f"v{k % 7}", k % 3, k, rng.choice([0.0, 2.5, 8.75, 30.0])) for k in range(200)]
    got = journeys.trip_segments(spark.createDataFrame(rows, "vin string, day int, seq long, speed double").repartition(5), key="vin", day="day", order="seq", speed="speed").collect()
    for k in range(7):
        for d in range(3):
            own = sorted((r["seq"], r["position"], r["moving"]) for r in got if r["vin"] == f"v{k}" and r["day"] == d)
            assert [p for _, p, _ in own] == list(range(len(own)))
            assert [m for *_, m in own] == cheapest_labels([s for v, dd, q, s in rows if v == f"v{k}" and dd == d])


def dijkstra(edges, src, goals, limit):
    heap, seen = [(0.0, src)], set()
    while heap:
        c, u = heapq.heappop(heap)
        if u in seen:
            continue
        seen.add(u)
        if u in goals:
            return c
        for a, b, w in edges:
            if a == u and c + w <= limit:
                heapq.heappush(heap, (c + w, b))
    return None


def test_nearest_target(spark):
    roads = [("home", "mill", 2.5), ("home", "pier", 7.0), ("mill", "pier", 3.0), ("mill", "yard", 9.0), ("pier", "yard", 1.5), ("yard", "home", 0.5)]
    e = spark.createDataFrame(roads, "src string, dst string, cost double")
    node = lambda *n: spark.createDataFrame([(x,) for x in n], "node string")
    assert [tuple(r) for r in journeys.nearest_target(e, node("home"), node("yard"), max_cost=50.0).collect()] == [("home", "yard", 7.0, "home-mill-pier-yard")]
    assert journeys.nearest_target(e, node("home"), node("yard"), max_cost=6.9).count() == 0
    assert journeys.nearest_target(e, node("home"), node("yard"), max_cost=7.0).count() == 1
    assert journeys.nearest_target(e, node("home"), node("moon"), max_cost=50.0).count() == 0
    rng = random.Random(5)
    big = [(str(a), str(b), float(rng.randrange(1, 20))) for a in range(15) for b in range(15) if a != b and rng.random() < 0.2]
    goals = {"3", "11"}
    got = {r["source"]: r["cost"] for r in journeys.nearest_target(spark.createDataFrame(big, "src string, dst string, cost double"), node(*map(str, range(15))), node(*goals), max_cost=25.0).collect()}
    assert got == {s: c for s in map(str, range(15)) if (c := dijkstra(big, s, goals, 25.0)) is not None}


def test_idle_samples_are_slow_ones(spark):
    """Whatever the event says: standing still or below 1 km/h is idle, no speed is not."""
    rows = [(None, 0.5), (None, 0.0), (None, 1.0), ("IDLE", 30.0), ("IDLE", None), ("HARSH_BRAKE", 0.9)]
    t = spark.createDataFrame([("v", dt.datetime(2024, 1, 1, 0, k), 1.0, s, None, None, e, None) for k, (e, s) in enumerate(rows)], "vin string, ts timestamp_ntz, odo_km double, speed_kmh double, coolant_c double, batt_v double, evt string, dtcs array<string>")
    assert rollup.daily_rollup(t).first()["idle_samples"] == 3


def test_retention_drops_whole_hours(spark, tmp_path):
    t = spark.createDataFrame([("v", dt.datetime(2024, 1, 1) + dt.timedelta(minutes=20 * k)) for k in range(36)], "vin string, ts timestamp_ntz")
    sinks.write_by_hour(t, str(tmp_path / "t"))
    gone = rollup.apply_retention(spark, str(tmp_path / "t"), str(tmp_path / "kept"), dt.datetime(2024, 1, 1, 12), 5)
    left = spark.read.parquet(str(tmp_path / "kept"))
    assert gone == 7 and left.count() == 36 - 3 * 7 and left.agg(F.min("h")).first()[0] == 7


def test_changes_stay_within_a_tenant(spark):
    people = spark.createDataFrame([(1, 1, "Ann", None), (2, 2, "Bo", None)], "id int, tenant_id int, name string, erased_at string")
    asked = spark.createDataFrame([(1, 1), (2, 1)], "id int, tenant_id int")
    got = {r["id"]: (r["name"], r["erased_at"]) for r in serving.erase(people, asked, id_col="id", at="now", columns=["name"]).collect()}
    assert got == {1: (None, "now"), 2: ("Bo", None)}


def test_increments_add_up(spark):
    rows = [(f"v{k % 5}", dt.datetime(2024, 1, 1) + dt.timedelta(minutes=37 * k), float(k), float(k % 9), None if k % 4 else float(k), 12.0, "IDLE" if k % 3 else "HARSH_BRAKE", ["P0301"] if k % 5 == 0 else None) for k in range(400)]
    t = spark.createDataFrame(rows, "vin string, ts timestamp_ntz, odo_km double, speed_kmh double, coolant_c double, batt_v double, evt string, dtcs array<string>")
    whole = sorted(map(tuple, rollup.daily_rollup(t).collect()))
    r, low = rollup.daily_rollup(t.limit(0)), dt.datetime(2023, 12, 31)
    for high in (dt.datetime(2024, 1, 3, 5), dt.datetime(2024, 1, 3, 9), dt.datetime(2024, 2, 1)):
        r, late = rollup.incremental_rollup(r, t, low, high)
        low = high
    assert sorted(map(tuple, r.select(rollup.daily_rollup(t).columns).collect())) == whole and late.count() == 0
    marked = t.withColumn("arrived", F.lit(dt.datetime(2024, 3, 1)).cast("timestamp_ntz"))
    assert rollup.incremental_rollup(r, marked, low, dt.datetime(2024, 3, 1))[1].count() == 400


def test_appends_can_be_repeated(spark):
    df = spark.createDataFrame([("a", 1, 2.0), ("a", 1, 1.0), ("b", 1, 3.0)], "vin string, seq long, v double")
    first = sinks.fresh_rows(df, df.limit(0), ["vin", "seq"])
    assert sorted(map(tuple, first.collect())) == [("a", 1, 1.0), ("b", 1, 3.0)]
    assert sinks.fresh_rows(df, first, ["vin", "seq"]).count() == 0
    assert sorted(map(tuple, sinks.upserted(df, spark.createDataFrame([("a", 9, 9.0)], df.schema), "vin").collect())) == [("a", 9, 9.0), ("b", 1, 3.0)]


def test_telemetry_by_hour(spark, tmp_path):
    t = spark.createDataFrame([(f"v{k}", dt.datetime(2024, 1, 1, k % 3)) for k in range(30)], "vin string, ts timestamp_ntz")
    sinks.write_by_hour(t, str(tmp_path / "t"))
    back = spark.read.parquet(str(tmp_path / "t"))
    assert back.count() == 30 and back.filter("h = 1").count() == 10


def test_count_min_never_underestimates(spark):
    df = spark.createDataFrame([(min(int(random.Random(k).expovariate(0.01)), 900),) for k in range(5000)], "x long")
    true = {str(r["x"]): r["n"] for r in df.groupBy("x").agg(F.count("*").alias("n")).collect()}
    got = {r["item"]: r["estimate"] for r in sketches.estimate(sketches.count_min(df, "x", 256, 4), df, "x", 256, 4).collect()}
    assert set(got) == set(true) and all(got[k] >= true[k] for k in true)
    skewed = spark.createDataFrame([("P0301",)] * 100 + [("P0420",)] * 50 + [(f"x{k}",) for k in range(200)], "c string")
    assert [r["item"] for r in sketches.top_codes(skewed, "c", 3).collect()][:2] == ["P0301", "P0420"] == [r["item"] for r in sketches.approx_top_codes(skewed, "c", 3).collect()][:2]


def test_precision_at_k(spark):
    df = spark.createDataFrame([(k, s, y) for k, (s, y) in enumerate(zip((0.9, 0.1, 0.2, 0.3, 0.8, 0.1, 0.1, 0.1, 0.1, 0.1), (1, 0, 0, 0, 1, 0, 0, 0, 0, 0), strict=True))], "id int, s double, y int")
    assert metrics.precision_at_k(df, score="s", label="y", tie="id", fraction=0.2).first()[0] == 1.0


def test_rank_measures(spark):
    rng = random.Random(2)
    rows = [(float(rng.randrange(12)), int(rng.random() < 0.4)) for _ in range(300)]
    df = spark.createDataFrame(rows, "s double, y int")
    pairs = [(1.0 if a > b else 0.5 if a == b else 0.0) for a, x in rows if x for b, z in rows if not z]
    assert abs(metrics.roc_auc(df, score="s", label="y").first()[0] - sum(pairs) / len(pairs)) < 1e-12
    ap, hits, seen, pos = 0.0, 0, 0, sum(y for _, y in rows)
    for s in sorted({s for s, _ in rows}, reverse=True):
        own = [y for t, y in rows if t == s]
        hits, seen = hits + sum(own), seen + len(own)
        ap += sum(own) / pos * hits / seen
    assert abs(metrics.average_precision(df, score="s", label="y").first()[0] - ap) < 1e-12


def test_explanation(spark):
    middle = dict(zip(risk.FEATURES, (0.5, 4, 8, 95, 12.4, 1, 5, 0, 0), strict=True))
    row = spark.createDataFrame([(1.5, 4.0, 8.0, 120.0, 11.2, 1.0, 5.0, 0.0, 0.0)], ", ".join(f"{c} double" for c in risk.FEATURES))
    got = risk.explain_factors(row, middle, dict.fromkeys(risk.FEATURES, 1.0)).first()["factors"]
    assert [f["label"] for f in got] == ["overdue for service", "coolant running hot", "12V battery voltage low"]


def test_pages_do_not_overlap(spark):
    df = spark.createDataFrame([(f"v{k:03d}",) for k in range(25)], "vin string")
    a = [r["vin"] for r in serving.keyset_page(df, key="vin", after=None, limit=10).collect()]
    b = [r["vin"] for r in serving.keyset_page(df, key="vin", after=a[-1], limit=10).collect()]
    c = serving.keyset_page(df, key="vin", after=b[-1], limit=10).collect()
    assert a + b + [r["vin"] for r in c] == [f"v{k:03d}" for k in range(25)] and c[0]["next_cursor"] is None


def test_approximate_neighbours(spark):
    v = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    q = v.filter("vec_id % 20 = 0")
    exact = {(r[0], r[1]) for r in similarity.knn_exact(v, q, id_col="vec_id", vec_col="v", query_id="vec_id").select("query_id", "neighbour_id").collect()}
    near = {(r[0], r[1]) for r in similarity.knn_lsh(v, q, id_col="vec_id", vec_col="v", query_id="vec_id").select("query_id", "neighbour_id").collect()}
    assert len(exact & near) >= 0.9 * len(exact)


def test_cells_of_clustered_vectors(spark):
    """Clusters far apart: a small share of the cells finds every neighbour; nulls and an empty table are no error."""
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(8, 10)) * 10
    rows = [(k, (centres[k % 8] + rng.normal(size=10) * 0.1).tolist()) for k in range(400)] + [(400, None)]
    v = spark.createDataFrame(rows, "id int, v array<double>")
    names = {"id_col": "id", "vec_col": "v", "query_id": "id"}
    pick = lambda df: {(r[0], r[1], r[2]) for r in df.select("query_id", "rank", "similarity").collect()}
    q = v.filter("id % 20 = 0")
    assert pick(similarity.knn_lsh(v, q, **names, share=1.0)) == pick(similarity.knn_exact(v, q, **names))
    found = similarity.knn_lsh(v, q, **names, share=0.5).select("query_id", "neighbour_id").collect()
    assert len(found) == 60 and all(a % 8 == b % 8 for a, b in found)
    assert similarity.knn_lsh(v.filter("false"), q, **names).count() == 0 == similarity.knn_lsh(v, q.filter("false"), **names).count()


def test_best_rows_are_those_of_brute_force():
    """Rows in batches: equal vectors, repeated ids, names, lengths that differ and numbers that are none."""
    rng = np.random.default_rng(0)
    short = lambda n, d: (lambda x: x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9))(rng.integers(-2, 3, (n, d)).astype(float))
    for trial in range(60):
        n, asked, d, k = rng.integers(1, 150), rng.integers(1, 30), rng.integers(1, 9), int(rng.integers(1, 5))
        rows, q = short(n, d), short(asked, d)
        ids, names = rng.integers(0, n if trial % 2 else max(1, n // 3), n), rng.integers(0, n, asked)
        lengths, own = np.full(n, d), np.full(asked, d)
        if trial % 5 == 0:
            rows[rng.integers(0, n)] = np.nan
        if trial % 3 == 0:
            ids, names = np.array([f"s{x}" for x in ids], object), np.array([f"s{x}" for x in names], object)
        if trial % 7 == 0:
            lengths = rng.integers(1, d + 1, n)
            rows[np.arange(d) >= lengths[:, None]] = 0
        best = similarity._Best(names, q, own, k)
        for part in np.array_split(rng.permutation(n), rng.integers(1, 6)):
            few = part[similarity._needed(rows[part], lengths[part], ids[part], k)] if len(part) else part
            if len(few):
                best.offer(None, ids[few], rows[few], lengths[few])
        want = []
        for j in range(asked):
            s = [-np.inf if lengths[r] != d else np.inf if np.isnan(x := np.cumsum(rows[r] * q[j])[-1]) else float(decimal.Decimal(repr(float(x))).quantize(decimal.Decimal("0.000001"), decimal.ROUND_HALF_UP)) for r in range(n)]
            want += [(j, name, -low) for low, name in sorted((-s[r], ids[r]) for r in range(n) if ids[r] != names[j])[:k]]
        assert list(zip(*(x.tolist() for x in best.found()), strict=True)) == want


def test_similarities_are_rounded_as_spark_does(spark):
    values = [0.1234565, 0.1234555, -0.1234565, 0.0000005, -0.0000004, 1.0, 0.9999995, 0.30000049999999997, 1 / 3]
    want = [r[0] for r in spark.createDataFrame([(v,) for v in values], "v double").select(F.round("v", 6)).collect()]
    assert similarity._rounded(np.array(values)).tolist() == want


def test_unit_works_out_the_norm_once(spark):
    rows = [([3.0, 4.0],), ([0.0, 0.0],), ([1.0, None],), ([],), (None,)]
    df = spark.createDataFrame(rows, "v array<double>").select(similarity.unit(F.col("v")).alias("u"))
    assert [r["u"] for r in df.collect()] == [[0.6, 0.8], [0.0, 0.0], [0.0, 0.0], [], None]
    many, began = spark.range(4_000).select(F.transform(F.sequence(F.lit(1), F.lit(1000)), lambda k: k + F.col("id") % 7).alias("v")), time.time()
    assert many.select(F.sum(F.get(similarity.unit(F.col("v")), F.lit(999)))).first()[0] > 4_000 * 0.05
    assert time.time() - began < 40  # with a norm for each number these are four thousand million steps


@pytest.mark.parametrize("queries", [16_384, 60])
def test_exact_neighbours_make_no_product_of_rows(spark, monkeypatch, queries):
    """Half of the vectors are one vector; blocks of queries give what plain products give, and no join meets all rows."""
    monkeypatch.setattr(similarity, "QUERIES", queries)
    rng = np.random.default_rng(9)
    x = rng.normal(size=(3000, 12))
    x[::2] = x[0]
    v = spark.createDataFrame([(k, r.tolist()) for k, r in enumerate(x)] + [(None, x[1].tolist())], "id int, v array<double>").repartition(3)
    found = similarity.knn_exact(v, v.filter("id % 20 = 3 OR id = 4"), id_col="id", vec_col="v", query_id="id")
    assert not any(word in found._jdf.queryExecution().executedPlan().toString() for word in ("NestedLoop", "Cartesian"))
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = set()
    for j in [*range(3, 3000, 20), 4]:
        s = np.round(u @ u[j], 6)
        want |= {(j, int(n), rank + 1, float(s[n])) for rank, n in enumerate([n for n in np.lexsort((np.arange(3000), -s)) if n != j][:3])}
    assert {(r["query_id"], r["neighbour_id"], r["rank"], r["similarity"]) for r in found.collect()} == want


def test_neighbours_in_cells_are_compared_by_products(spark, monkeypatch):
    """Every query meets the rows of its cells and no others, in several blocks of queries."""
    monkeypatch.setattr(similarity, "QUERIES", 10)
    rng = np.random.default_rng(11)
    x = rng.normal(size=(400, 6))
    x[::5] = x[0]
    v = spark.createDataFrame([(k, r.tolist()) for k, r in enumerate(x)], "id int, v array<double>").repartition(3)
    found = similarity.knn_lsh(v, v.filter("id % 20 = 1"), id_col="id", vec_col="v", query_id="id", share=0.4)
    assert not any(word in found._jdf.queryExecution().executedPlan().toString() for word in ("NestedLoop", "Cartesian"))
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    centres = u[[r["id"] for r in v.orderBy(F.xxhash64("id"), "id").limit(20).collect()]]
    cells, want = (u @ centres.T).argmax(1), set()
    for j in range(1, 400, 20):
        near, s = set(np.argsort(-(u[j] @ centres.T))[:8].tolist()), np.round(u @ u[j], 6)
        want |= {(j, int(n), rank + 1, float(s[n])) for rank, n in enumerate([n for n in np.lexsort((np.arange(400), -s)) if n != j and cells[n] in near][:3])}
    assert {(r["query_id"], r["neighbour_id"], r["rank"], r["similarity"]) for r in found.collect()} == want


def test_recall_of_codes_is_taken_against_products(spark):
    """The only product of rows left is that of two one-row tables."""
    from roadglass import plans

    plan = plans.QUERIES["knn_codes_recall"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    joins = [line for line in plan.splitlines() if "NestedLoop" in line or "Cartesian" in line]
    assert len(joins) == 1


def test_a_hot_hour_is_split_and_hours_of_other_shuffle_partitions_have_one_file(spark, tmp_path):
    size = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    rows = spark.range(60_000).selectExpr("concat('v', id % 500) AS vin", "sha2(string(id), 256) AS note", "timestamp_seconds(1704067200 + CASE WHEN id % 10 < 8 THEN 0 ELSE 3600 * (id % 97) END) AS ts")
    spark.conf.set(size, "256k")
    try:
        sinks.write_by_hour(rows, str(tmp_path / "t"))
    finally:
        spark.conf.unset(size)
    files = {f"{p.parent.parent.name}/{p.parent.name}": len(list(p.parent.glob("*.parquet"))) for p in (tmp_path / "t").glob("d=*/h=*/*.parquet")}
    hot = files.pop("d=2024-01-01/h=0")
    assert len(files) == 96 and hot > 2 and max(files.values()) <= hot  # four shuffle partitions: about a quarter of the hours lie with the hot one
    assert sum(n == 1 for n in files.values()) > len(files) / 2
    back = spark.read.parquet(str(tmp_path / "t"))
    assert back.count() == 60_000 and back.select("vin", "note", "ts").exceptAll(rows).count() == 0
    assert back.filter("d <> to_date(ts) OR h <> hour(ts)").count() == 0


def test_codes_of_vectors():
    """A code is the nearest centroid of each part by plain distances, and parts of few distinct rows lose nothing."""
    rng = np.random.default_rng(3)
    rows = rng.normal(size=(900, 10))
    books = codes.fit_books(rows, 4)
    got, low = codes.encode(rows, books), 0
    assert [b.shape for b in books] == [(256, 3), (256, 3), (256, 2), (256, 2)]
    for j, b in enumerate(books):
        own = rows[:, low:low + b.shape[1]]
        plain = ((own[:, None, :] - b[None]) ** 2).sum(2)
        assert np.allclose(plain[np.arange(900), got[:, j]], plain.min(1), atol=1e-5)
        low += b.shape[1]
    few = np.repeat(rows[:50], 3, axis=0).astype(np.float32)
    books = codes.fit_books(few, 4)
    assert np.array_equal(codes.decode(codes.encode(few, books), books), few)


@pytest.mark.parametrize("block", [4096, 7])
def test_neighbours_by_codes(spark, tmp_path, monkeypatch, block):
    """Recall on the supplied vectors, in one block of queries and in several, with batches that are merged."""
    monkeypatch.setattr(codes, "BLOCK", block)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 100)
    try:
        v = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
        q, names = v.filter("vec_id % 20 = 0"), {"id_col": "vec_id", "vec_col": "v", "query_id": "vec_id"}
        codes.write_codes(v, str(tmp_path), id_col="vec_id", vec_col="v", sample=300)  # not all rows are fitted on
        pick = lambda df: {(r["query_id"], r["neighbour_id"], r["similarity"], r["rank"]) for r in df.collect()}
        exact, near = pick(similarity.knn_exact(v, q, **names)), pick(codes.knn_codes(v, q, str(tmp_path), **names))
        assert len(near) == len(exact) and len({x[:3] for x in exact} & {x[:3] for x in near}) >= 0.9 * len(exact)
        assert pick(codes.knn_codes(v, q, str(tmp_path), keep=500, **names)) == exact
        assert spark.read.parquet(f"{tmp_path}/codes").count() == 500
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_neighbours_by_codes_at_the_edges(spark, tmp_path):
    """Names as ids, null and zero vectors, equal vectors, fewer numbers than parts, no rows, no queries."""
    rows = [(f"n{k:02d}", [float(k % 5), 1.0, float(k % 3)]) for k in range(40)] + [("null", None), ("zero", [0.0, 0.0, 0.0])]
    v, names = spark.createDataFrame(rows, "id string, v array<double>").repartition(3), {"id_col": "id", "vec_col": "v", "query_id": "id"}
    codes.write_codes(v, f"{tmp_path}/a", id_col="id", vec_col="v")
    pick = lambda df: {(r["query_id"], r["similarity"], r["rank"]) for r in df.collect()}
    assert pick(codes.knn_codes(v, v, f"{tmp_path}/a", **names)) == pick(similarity.knn_exact(v, v, **names))
    assert codes.knn_codes(v, v.filter("false"), f"{tmp_path}/a", **names).count() == 0
    codes.write_codes(v.filter("false"), f"{tmp_path}/b", id_col="id", vec_col="v")
    assert codes.knn_codes(v.filter("false"), v, f"{tmp_path}/b", **names).count() == 0
    ragged = spark.createDataFrame([("a", [1.0]), ("b", [1.0, 2.0])], "id string, v array<double>")
    with pytest.raises(Exception, match="different lengths"):
        codes.write_codes(ragged, f"{tmp_path}/c", id_col="id", vec_col="v")


def test_running_total_of_any_number(spark):
    rows = [(k * 7 % 300, k % 5) for k in range(300)]
    want = {v: (sum(n for w, n in rows if w < v), sum(1 for w, _ in rows if w < v)) for v, _ in rows}
    for kind in ("float", "decimal(12,2)", "smallint", "bigint"):
        df = spark.createDataFrame(rows, "v int, n int").selectExpr(f"cast(v AS {kind}) AS v", "n", "1 AS one")
        got = metrics.running_total(df, "v", ("n", "one"), parts=8)
        assert got.columns == ["v", "n", "one", "before_n", "before_one"]
        assert {int(r["v"]): (r["before_n"], r["before_one"]) for r in got.collect()} == want
        assert got.select(F.spark_partition_id()).distinct().count() > 1
    with pytest.raises(TypeError):
        metrics.running_total(spark.createDataFrame([("a", 1)], "v string, n int"), "v", "n")


@pytest.mark.parametrize("limit", [40, 7, 1000])
def test_stride_sample(spark, limit):
    df = spark.createDataFrame([(f"v{k}",) for k in range(150)], "vin string")
    got = windows.stride_sample(df, key="vin", limit=limit)
    assert got.columns == ["vin"] and min(limit, 150) * 0.7 <= got.count() <= limit or got.count() == 150


def test_nearest_target_beyond_fifty_edges(spark):
    chain = spark.createDataFrame([(k, k + 1, 1.0) for k in range(52)], "src int, dst int, cost double")
    node = lambda k: spark.createDataFrame([(k,)], "node int")
    assert [tuple(r)[:3] for r in journeys.nearest_target(chain, node(0), node(52), max_cost=60.0).collect()] == [(0, 52, 52.0)]
    with pytest.raises(RuntimeError):
        journeys.nearest_target(chain, node(0), node(52), max_cost=60.0, max_rounds=2)


def test_quantiles(spark):
    rng = random.Random(3)
    rows = [(g, None if k % 9 == 0 else round(rng.gauss(0, 5), k % 3)) for g in ("a", "b", None) for k in range(400)] + [("one", 7.0), ("none", None)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(5)
    at = (0.0, 0.5, 0.95, 1.0)
    want = {g: np.quantile([v for h, v in rows if h == g and v is not None], at) for g in ("a", "b", None, "one")}
    grouped = metrics.quantiles(df, value="v", at=at, group="g")
    got = {r["g"]: r["q"] for r in grouped.collect()}
    assert got.keys() == want.keys() and all(np.allclose(got[g], want[g]) for g in want)
    every = metrics.quantiles(df, value="v", at=at)
    assert np.allclose(every.first()["q"], np.quantile([v for _, v in rows if v is not None], at))
    assert metrics.quantiles(df.limit(0), value="v", at=at).collect()[0]["q"] is None
    soak = metrics.soak_summary(df.withColumn("o", F.monotonically_increasing_id()), order="o", value="v")
    for plan in (grouped, every, soak):  # no buffer that holds all values
        assert " percentile(" not in plan._jdf.queryExecution().optimizedPlan().toString()


def test_places_and_totals_do_not_depend_on_the_ranges(spark, monkeypatch):
    from roadglass.operators import ordering

    rng = random.Random(4)
    rows = [(rng.choice("abc"), k * 37 % 500, rng.randrange(5), f"t{k * 7 % 500:03d}") for k in range(500)]
    df = spark.createDataFrame(rows, "g string, v long, n long, tie string").repartition(4)
    for each in (1_000_000, 40):
        monkeypatch.setattr(ordering, "ROWS_EACH", each)
        got = sorted((r["_at"], r["v"]) for r in ordering.numbered(df, "v").collect())
        assert got == [(k, v) for k, v in enumerate(sorted(r[1] for r in rows))]
        for descending in (False, True):
            total = {(r["g"], r["v"]): r["before"] for r in metrics.running_total(df, "v", "n", descending=descending, within="g").collect()}
            assert total == {(g, v): sum(n for h, w, n, _ in rows if h == g and (w > v if descending else w < v)) for g, v, _, _ in rows}
        scored = df.select((F.col("v") % 3).alias("s"), (F.col("n") % 2).alias("label"), "tie")
        best = sorted(((-(v % 3), t, n % 2) for _, v, n, t in rows))[:100]
        got = metrics.precision_at_k(scored, score="s", label="label", tie="tie", fraction=0.2).first()
        assert got["precision_at_k"] == sum(b[2] for b in best) / 100
        assert windows.stride_sample(df.select("tie"), key="tie", limit=40).count() == 39  # every 13th of 500
    parts = ordering.in_ranges(df, "v", rows_each=40).groupBy("_part").count().collect()
    assert len(parts) > 8 and max(p["count"] for p in parts) < 120


def test_stored_sketches_of_any_span(spark, tmp_path):
    rng = random.Random(9)
    day0 = dt.datetime(2024, 1, 1)
    rows = [(day0 + dt.timedelta(minutes=rng.randrange(600)), f"P{min(int(rng.expovariate(0.2)), 40):04d}") for _ in range(3_000)] + [(None, "P1"), (day0, None)]
    df = spark.createDataFrame(rows, "ts timestamp_ntz, code string")
    store = sketches.StoredSketches(spark, str(tmp_path / "s"), width=64)
    for low in (0, 5):  # two loads of five hours each
        store.add(df.filter(F.hour("ts").between(low, low + 4)), ts="ts", item="code")
    store.add(df.filter("hour(ts) = 3"), ts="ts", item="code")  # an hour again
    for a, b in ((0, 9), (2, 6), (7, 7)):
        first, last = day0 + dt.timedelta(hours=a), day0 + dt.timedelta(hours=b)
        own = df.filter(F.hour("ts").between(a, b) & F.col("code").isNotNull())
        true = {r["code"]: r["count"] for r in own.groupBy("code").count().collect()}
        fresh = {r["item"]: r["estimate"] for r in sketches.estimate(sketches.count_min(own, "code", width=64), own, "code", width=64).collect()}
        got = {r["item"]: r["estimate"] for r in sketches.estimate(store.count_min(first, last), own, "code", width=64).collect()}
        assert got == fresh and all(got[c] >= n for c, n in true.items())
        top = [(r["item"], r["n"]) for r in store.top(first, last, 5).collect()]
        assert [n for _, n in top] == sorted(true.values(), reverse=True)[:5] and all(true[c] == n for c, n in top)
    plan = store.count_min(day0, day0)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(slice" in plan


def test_upsert_takes_one_row_of_a_key(spark):
    old = spark.createDataFrame([("a", 1, 1), ("b", 1, 1)], "k string, v int, at int")
    new = spark.createDataFrame([("a", 9, 2), ("a", 3, 5), ("c", 4, 1), ("c", 4, 1)], "k string, v int, at int")
    got = lambda df: sorted(map(tuple, df.collect()))
    assert got(sinks.upserted(old, new, "k", "at")) == [("a", 3, 5), ("b", 1, 1), ("c", 4, 1)]
    assert got(sinks.upserted(old, new, "k")) == [("a", 9, 2), ("b", 1, 1), ("c", 4, 1)]


def test_pages_by_cursor(spark):
    df = spark.createDataFrame([(k, f"v{k:03d}") for k in range(25)], "id long, vin string")
    for key, first in (("id", 0), ("vin", "v000")):
        seen, cursor = [], None
        while True:
            rows = serving.page_after(df, key=key, cursor=cursor, limit=10).collect()
            seen += [r[key] for r in rows]
            cursor = rows[-1]["next_cursor"] if rows else None
            if cursor is None:
                break
        assert len(seen) == len(set(seen)) == 25 and seen[0] == first
    for bad in ("%%%", "bm8=", "e30=", "é"):
        with pytest.raises(ValueError, match="not a cursor"):
            serving.page_after(df, key="vin", cursor=bad, limit=10)
