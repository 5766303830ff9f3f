"""Joins in space, in time and along roads against brute force."""

import datetime as dt
import heapq
import math
import random

import pytest
from pyspark.sql import functions as F

from roadglass.operators import journeys, serving


def km(a, b, c, d):
    p, q = math.radians(c - a) / 2, math.radians(d - b) / 2
    return 2 * 6371.0 * math.asin(min(1.0, math.sqrt(math.sin(p) ** 2 + math.cos(math.radians(a)) * math.cos(math.radians(c)) * math.sin(q) ** 2)))


def places(rng, n):
    """All over the world, thick at a place, at the poles and on both sides of the date line."""
    out = [(rng.uniform(-90, 90), rng.uniform(-180, 180)) for _ in range(n)]
    out += [(48 + rng.uniform(-0.2, 0.2), 11 + rng.uniform(-0.2, 0.2)) for _ in range(n)]
    out += [(rng.choice([-1, 1]) * rng.uniform(89, 90), rng.uniform(-180, 180)) for _ in range(n // 4)]
    out += [(rng.uniform(-5, 5), rng.choice([-180.0, 180.0, 179.99, -179.99, rng.uniform(179, 180)])) for _ in range(n // 4)]
    return out + [(90.0, 0.0), (-90.0, 180.0), (0.0, -180.0), (0.0, 180.0)]


@pytest.mark.parametrize("cell_points", [50_000, 20])
def test_radius_join(spark, cell_points):
    rng = random.Random(cell_points)
    points = [(k, *p) for k, p in enumerate(places(rng, 300))]
    centres = [(k, *p, rng.choice([0.0, 1.0, 8.0, 25.0, 300.0, 2500.0, 12_000.0, 25_000.0])) for k, p in enumerate(places(rng, 40))] + [(999, 48.0, 11.0, -1.0)]
    want = {(p, c) for p, a, b in points for c, d, e, r in centres if km(a, b, d, e) <= r}
    df = spark.createDataFrame([*points, (7000, None, 1.0)], "id long, lat double, lon double").repartition(3)
    around = spark.createDataFrame([*centres, (1000, None, None, 5.0)], "centre long, lat double, lon double, radius_km double")
    joined = serving.radius_join(df, around, cell_points=cell_points)
    got = joined.collect()
    assert len(got) == len(want) and {(r["id"], r["centre"]) for r in got} == want and joined.columns == ["id", "lat", "lon", "centre", "km"]
    near = [r for r in got if r["km"] < 1]
    assert near and all(abs(r["km"] - km(r["lat"], r["lon"], *centres[r["centre"]][1:3])) < 1e-6 for r in near)
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert serving.radius_join(df.limit(0), around).count() == 0 and serving.radius_join(df, around.limit(0)).count() == 0


@pytest.mark.parametrize("cell_points", [50_000, 20])
def test_radius_totals(spark, monkeypatch, cell_points):
    """Places and circles that many share: only places meet circles."""
    rng, seen, join = random.Random(6), [], serving.radius_join

    def counted(points, centres, **options):
        seen.append((points.count(), centres.count()))
        return join(points, centres, **options)

    monkeypatch.setattr(serving, "radius_join", counted)
    spots, middles = places(rng, 60), [(*p, rng.choice([0.0, 8.0, 300.0, 2500.0, 25_000.0])) for p in places(rng, 8)]
    points = [(k, *rng.choice(spots)) for k in range(2000)] + [(7000, None, 1.0)]
    centres = [(k, *rng.choice(middles)) for k in range(100)] + [(3, *middles[0]), (998, None, None, 5.0), (999, 48.0, 11.0, -1.0)]
    got = serving.radius_totals(spark.createDataFrame(points, "id long, lat double, lon double"), spark.createDataFrame(centres, "centre long, lat double, lon double, radius_km double"), value="id", cell_points=cell_points)
    want = {}
    for c, d, e, r in centres[:-2]:
        for k, a, b in points[:-1]:
            if km(a, b, d, e) <= r:
                n, total, far = want.get(c, (0, 0, 0.0))
                want[c] = (n + 1, total + k, max(far, km(a, b, d, e)))
    rows = {r["centre"]: (r["n"], r["total"], r["farthest"]) for r in got.collect()}
    assert {c: x[:2] for c, x in rows.items()} == {c: x[:2] for c, x in want.items()} and len(want) > 50
    assert all(abs(rows[c][2] - want[c][2]) < 1e-6 for c in want)
    assert seen[0][0] <= len(spots) and seen[0][1] <= len(middles)


def test_small_circles_among_many_points(spark):
    """1,000 circles of 5 km among 20,000 points that lie evenly in a region."""
    rng = random.Random(1)
    df = spark.createDataFrame([(k, 48 + rng.uniform(-2, 2), 11 + rng.uniform(-2, 2)) for k in range(20_000)], "id long, lat double, lon double")
    around = df.filter("id % 20 = 0").select(F.col("id").alias("centre"), "lat", "lon", F.lit(5.0).alias("radius_km"))
    joined = serving.radius_join(df, around)
    found = joined.count()
    want = 1_000 * 20_000 * math.pi * 25 / (445 * 298)  # the region in km
    assert 0.9 * want < found < 1.1 * want


def brute_at(events, assignments):
    out = []
    for key, t, e in events:
        before = [(f, a, u) for k, f, u, a in assignments if k == key and k is not None and t is not None and f is not None and f <= t]
        if before:
            f, a, u = max(before, key=lambda x: (x[0], x[1]))
            if u is None or t < u:
                out.append((key, t, e, f, a, u))
    return sorted(out, key=str)


@pytest.mark.parametrize("merged", [1_000_000, 60])
def test_assignment_at(spark, merged):
    rng, day0 = random.Random(merged), dt.datetime(2024, 1, 1)
    when = lambda: day0 + dt.timedelta(minutes=rng.randrange(3_000))
    events = [(rng.choice(["hot", "hot", "hot", "b", "c"]), when(), k) for k in range(600)] + [(None, day0, 900), ("b", None, 901), ("alone", day0, 902)]
    assignments = []
    for k in range(300):
        key, begins = rng.choice(["hot", "hot", "b", "gone"]), when()
        assignments.append((key, begins, rng.choice([None, begins + dt.timedelta(minutes=rng.randrange(1, 90))]), k))
    assignments += [(None, day0, None, 500), ("b", None, None, 501), ("hot", dt.datetime(2023, 1, 1), None, 502), ("c", dt.datetime(2023, 1, 1), dt.datetime(2023, 1, 2), 503)]
    e = spark.createDataFrame(events, "key string, t timestamp_ntz, e long").repartition(3)
    a = spark.createDataFrame(assignments, "key string, valid_from timestamp_ntz, valid_to timestamp_ntz, a long").select("key", "valid_from", "a", "valid_to").repartition(3)
    got = sorted((tuple(r) for r in serving.assignment_at(e, a, key="key", ts="t", merged=merged).collect()), key=str)
    assert got == brute_at(events, assignments) and len(got) > 200
    assert serving.assignment_at(e.limit(0), a, key="key", ts="t").count() == 0 and serving.assignment_at(e, a.limit(0), key="key", ts="t").count() == 0


def test_one_vehicle_with_very_many_assignments_makes_no_product(spark):
    n = 100_000
    t = lambda c: F.timestamp_seconds(F.lit(1_700_000_000) + c)
    e = spark.range(n).select(F.lit("v").alias("vin"), t(F.col("id") * 10 + 5).alias("ts"), F.col("id").alias("seq"))
    a = spark.range(n).select(F.lit("v").alias("vin"), t(F.col("id") * 10).alias("valid_from"), t(F.col("id") * 10 + 10).alias("valid_to"), F.col("id").alias("a"))
    got = serving.assignment_at(e, a, key="vin", ts="ts", merged=10_000)
    assert got.agg(F.count(F.lit(1)), F.count_if(F.col("seq") == F.col("a"))).first() == (n, n)


def brute_ways(edges, sources, targets, most):
    """Best (cost, target, edges, path) of each source by Dijkstra over whole paths."""
    out = {}
    for s in sources:
        heap, done = [(0.0, 0, (s,))], set()
        best = None
        while heap:
            cost, hops, path = heapq.heappop(heap)
            if best and cost > best[0]:
                break
            if path[-1] in targets and (best is None or (cost, path[-1], hops, path) < best):
                best = (cost, path[-1], hops, path)
            if (path[-1], cost, hops) in done and len(done) > 50_000:
                continue
            done.add((path[-1], cost, hops))
            for a, b, w in edges:
                if a == path[-1] and b not in path and cost + w <= most:
                    heapq.heappush(heap, (cost + w, hops + 1, (*path, b)))
        if best:
            out[s] = (best[1], best[0], "-".join(map(str, best[3])))
    return out


def test_nearest_targets_with_ties_and_roads_that_cost_nothing(spark):
    rng = random.Random(8)
    edges = [(a, b, float(rng.choice([0, 1, 1, 2, 3]))) for a in range(14) for b in range(14) if a != b and rng.random() < 0.16]
    targets = {3, 11}
    frame = spark.createDataFrame(edges, "src int, dst int, cost double")
    node = lambda xs: spark.createDataFrame([(x,) for x in xs], "node int")
    for most in (2.0, 6.0):
        got = {r["source"]: (r["target"], r["cost"], r["path"]) for r in journeys.nearest_target(frame, node([*range(14), 3]), node(targets), max_cost=most).collect()}
        assert got == brute_ways(edges, range(14), targets, most)
    assert got[3] == (3, 0.0, "3")
