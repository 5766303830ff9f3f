"""State that goes, rows that come too late, and tables that change in whole steps."""

import datetime as dt
import random
import time

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from roadglass.operators import rollup, rules
from roadglass.sources import ledger
from roadglass.streaming import jobs

TELEMETRY = "vin string, ts timestamp, seq long, odo_km double, speed_kmh double, coolant_c double, batt_v double, evt string, dtcs array<string>"


def telemetry(spark, rows):
    """Rows of (vin, time, seq)."""
    return spark.createDataFrame([(v, t, s, float(s), s % 7 * 1.0, 90.0 + s, 12.0, "HARSH_BRAKE" if s % 3 == 0 else None, ["P0301"] if s % 4 == 0 else None) for v, t, s in rows], TELEMETRY)


def day(k, hour=12, minute=0):
    return dt.datetime(2024, 1, 1) + dt.timedelta(days=k, hours=hour, minutes=minute)


def values(df, *without):
    columns = sorted(set(df.columns) - set(without))
    return sorted((tuple(str(r[c]) for c in columns) for r in df.collect()))


def batches():
    """Four deliveries; the third and fourth have rows of days that have closed, and of one that has just not."""
    first = [(f"v{k}", day(0, 1, k), k) for k in range(6)]
    second = [(f"v{k}", day(1, 2, k), 10 + k) for k in range(4)] + [("v0", day(0, 23), 20)]
    third = [("v1", day(0, 5), 30), ("v1", day(1, 6), 31), ("v2", day(2, 0, 1), 32)]
    fourth = [("v9", day(1, 7), 40), ("v9", day(4), 41), ("v9", day(2, 23), 42)]
    late = {30, 40}
    return (first, second, third, fourth), late


def feed(spark, path, rows):
    telemetry(spark, rows).coalesce(1).write.mode("append").parquet(path)
    time.sleep(0.02)
    return spark.readStream.schema(TELEMETRY).parquet(path)


def test_rollup_job_drops_state_and_keeps_late_rows(spark, tmp_path):
    parts, late = batches()
    job = jobs.RollupJob(spark, str(tmp_path / "job"))
    for rows in parts:
        job.run(feed(spark, str(tmp_path / "in"), rows))
    every = [r for rows in parts for r in rows]
    assert {r["seq"] for r in job.late(telemetry(spark, []).schema).collect()} == late
    want = rollup.daily_rollup(telemetry(spark, [r for r in every if r[2] not in late]))
    assert values(job.table()) == values(want)
    told = {r["batch"]: r for r in job.progress().collect()}
    assert sum(r["removed"] for r in told.values()) > 0 and all(r["dropped"] == 0 for r in told.values())
    assert told[3]["held"] < len(want.collect())
    left = job.table().count()
    job.run(spark.readStream.schema(TELEMETRY).parquet(str(tmp_path / "in")))  # nothing new
    assert job.table().count() == left


@pytest.mark.parametrize("after", ["rows", "ledger", "rollup"])
def test_rollup_job_goes_on_after_a_failure(spark, tmp_path, monkeypatch, after):
    parts, late = batches()
    job = jobs.RollupJob(spark, str(tmp_path / "job"))
    for rows in parts[:2]:
        stream = feed(spark, str(tmp_path / "in"), rows)
        job.run(stream)

    class Lost(Exception):
        pass

    def lost(*args, **options):
        raise Lost

    if after == "rows":
        monkeypatch.setattr(ledger.Ledger, "put", lost)
    elif after == "ledger":
        monkeypatch.setattr(jobs, "rollup", lost)
    else:
        monkeypatch.setattr(spark.__class__, "createDataFrame", lost)
    stream = feed(spark, str(tmp_path / "in"), parts[2]) if after != "rollup" else None
    if after == "rollup":
        monkeypatch.undo()
        stream = feed(spark, str(tmp_path / "in"), parts[2])
        monkeypatch.setattr(spark.__class__, "createDataFrame", lost)
    with pytest.raises(Exception, match="Lost|lost"):
        job.run(stream)
    monkeypatch.undo()
    job.run(feed(spark, str(tmp_path / "in"), parts[3]))
    every = [r for rows in parts for r in rows]
    assert {r["seq"] for r in job.late(telemetry(spark, []).schema).collect()} == late
    assert values(job.table()) == values(rollup.daily_rollup(telemetry(spark, [r for r in every if r[2] not in late])))


def test_silent_vehicles_leave_the_state(spark, tmp_path):
    limits = rules.Limits(overheat_window=60, brake_window=600, brakes=2)
    schema = "vin string, ts_ms long, seq long, coolant_c double, evt string"
    path, sizes, found = str(tmp_path / "in"), [], []
    jobs.configured(spark)
    for b, vins in enumerate((["a", "b", "c"], ["a"], ["a"], ["a", "b"])):
        rows = [(v, 3_600_000 * (b + 1) + 1000 * k, 100 * b + k, 120.0, "HARSH_BRAKE") for v in vins for k in range(3)]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
        stream = jobs.window_rules(spark.readStream.schema(schema).parquet(path), limits, silent_seconds=600)
        query = stream.writeStream.foreachBatch(lambda df, k: found.extend(map(tuple, df.collect()))).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        query.awaitTermination()
        sizes.append(query.lastProgress["stateOperators"][0]["numRowsTotal"])
    assert sizes[1] < sizes[0] and sizes[2] <= sizes[1]
    assert len(found) == 7 * 4  # of three rows all but the first are hot, and all but the first are a pattern
    with pytest.raises(ValueError, match="shorter"):
        jobs.window_rules(spark.readStream.schema(schema).parquet(path), limits, silent_seconds=60)


def test_window_rules_agree_with_the_batch_rules_at_the_limit(spark, tmp_path):
    """Readings whose mean is the limit but for the last bits of their sum."""
    rng, rows = random.Random(4), []
    for v in range(300):
        cents = [rng.randrange(16_000, 24_000) for _ in range(rng.randrange(2, 9))]
        cents.append(20_000 * (len(cents) + 1) - sum(cents))
        before = [rng.randrange(16_000, 24_000) for _ in range(20)]  # of other windows
        rows += [(f"v{v}", 60_000 * k, 1000 * v + k, c * 0.005, None) for k, c in enumerate(before)]
        rows += [(f"v{v}", 86_400_000 + 1000 * k, 1000 * v + 100 + k, c * 0.005, None) for k, c in enumerate(cents)]
    schema, limits = "vin string, ts_ms long, seq long, coolant_c double, evt string", rules.Limits(overheat_c=100.0)
    df = spark.createDataFrame(rows, schema)
    want = {r["seq"] for r in rules.overheat_alerts(df, limits).collect()}
    ends = {r[2]: r[2] // 1000 for r in rows if r[2] % 1000 >= 100}
    last = {v: max(q for q in ends if ends[q] == v) for v in range(300)}  # its window's exact mean is the limit
    assert 5 < len(want & set(last.values())) < 200
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    for groups in (None, 7):
        alerts = jobs.window_rules(jobs.configured(spark).readStream.schema(schema).parquet(str(tmp_path / "in")), limits, groups=groups)
        assert {r["seq"] for r in jobs.run_append(alerts, "limit").collect()} == want


def test_over_adds_up_what_is_near_the_limit():
    values = np.array([99.995, 100.005, 100.0, 100.0, 1e300, -1e300, 100.0, 100.0, np.inf, 1.0])
    low, high = np.array([0, 2, 4, 6, 8, 9, 3]), np.array([2, 4, 8, 8, 10, 10, 3])
    assert jobs.over(values, low, high, 100.0).tolist() == [False, False, False, False, True, False, False]
    assert jobs.over(values, low, high, 49.0).tolist() == [True, True, True, True, True, False, False]
    thirds = np.full(9, 0.1)
    assert jobs.over(thirds, np.array([0, 0]), np.array([3, 9]), 0.1).tolist() == [bool((0.1 + 0.1 + 0.1) / 3 > 0.1), bool(np.cumsum(thirds)[-1] / 9 > 0.1)]


def test_vehicles_in_groups_give_the_same_alerts(spark, tmp_path):
    limits = rules.Limits(overheat_window=60, brake_window=600, brakes=2)
    schema, rng, found = "vin string, ts_ms long, seq long, coolant_c double, evt string", random.Random(5), []
    rows = [(rng.choice(["a", "b", "c", "d", None]), rng.randrange(4) * 1_000_000 + 10_000 * rng.randrange(40), k, rng.choice([None, 90.0, 108.0, 108.5, 130.0]), rng.choice([None, "IDLE", "HARSH_BRAKE"])) for k in range(400)]
    df = spark.createDataFrame(rows, schema)
    want = sorted(tuple(r) for r in rules.overheat_alerts(df, limits).unionByName(rules.pattern_alerts(df, limits)).select("seq", "rule", "severity").collect())
    for groups in (None, 1, 3):
        got = jobs.run_in_order(df, "ts_ms", "grouped", lambda s: jobs.window_rules(s, limits, silent_seconds=600, groups=groups), 100)  # noqa: B023
        found.append(sorted(tuple(r) for r in got.select("seq", "rule", "severity").collect()))
    assert found == [want] * 3 and len(want) > 100


def test_silent_vehicles_leave_an_active_group(monkeypatch):
    class State:
        value = None

        def exists(self):
            return self.value is not None

        def get(self):
            return self.value

        def update(self, value):
            self.value = value

        def clear(self):
            self.value = None

    class Handle:
        def __init__(self):
            self.timers = []

        def getValueState(self, name, schema):  # noqa: N802
            return State()

        def listTimers(self):  # noqa: N802
            return iter(self.timers)

        def registerTimer(self, at):  # noqa: N802
            self.timers.append(at)

        def deleteTimer(self, at):  # noqa: N802
            self.timers.remove(at)

    class At:
        def __init__(self, ms):
            self.ms = ms

        def getCurrentWatermarkInMs(self):  # noqa: N802
            return self.ms

    rows = lambda *r: iter([pd.DataFrame(r, columns=["vin", "ts_ms", "seq", "coolant_c", "evt"])])
    job = jobs.WindowRules(rules.Limits(overheat_window=60, brake_window=600, brakes=2), 600)
    job.init(Handle())
    list(job.handleInputRows((1,), rows(("a", 0, 1, 120.0, "HARSH_BRAKE"), ("b", 1000, 2, 120.0, "HARSH_BRAKE")), At(0)))
    assert sorted(job.held["coolant"].value[0]) == sorted(job.held["brake"].value[0]) == ["a", "b"]
    found = pd.concat(job.handleInputRows((1,), rows(("a", 60_000, 3, 120.0, "HARSH_BRAKE")), At(1000)))
    assert list(zip(found["seq"], found["rule"], strict=True)) == [(3, "OVERHEAT_TREND"), (3, "HARSH_BRAKE_PATTERN")]
    list(job.handleInputRows((1,), rows(("a", 602_000, 4, 120.0, "HARSH_BRAKE")), At(601_001)))
    assert job.held["brake"].value[0] == ["a"] and job.held["coolant"].value == (["a"], [1], [602_000], [120.0])
    assert job.handle.timers == [1_202_000]


def test_a_large_range_lies_in_several_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(jobs, "ROWS_PER_FILE", 10)
    table, last = spark.range(1000).selectExpr("id * 7919 % 1000 AS at"), -1
    for k, _ in enumerate(jobs.in_order(table, "at", str(tmp_path / "a"), 250)):
        own = spark.read.parquet(str(tmp_path / "a" / "in" / f"{k:09d}"))
        values = sorted(r["at"] for r in own.collect())
        assert values[0] == last + 1 and values == list(range(values[0], values[-1] + 1)) and len(own.inputFiles()) > 4
        last = values[-1]
    assert k == 3 and last == 999


def test_ranges_are_handed_over_in_order(spark, tmp_path):
    rows = [(k * 7919 % 501, k) for k in range(500)] + [(None, 1000)]
    table = spark.createDataFrame(rows, "at long, id long").repartition(5)
    seen, last = [], -1
    for files in jobs.in_order(table, "at", str(tmp_path / "a"), 100):
        now = [r["at"] for r in spark.read.parquet(files).collect()]
        fresh = sorted(10**9 if x is None else x for x in now)[len(seen) :]
        assert fresh[0] > last and len(fresh) < 300
        seen, last = now, fresh[-1]
    assert len(seen) == 501
    assert len(list(jobs.in_order(table.limit(0), "at", str(tmp_path / "b")))) == 1
    assert len(list(jobs.in_order(table.filter("at < 4"), "at", str(tmp_path / "c"), each=True))) == table.filter("at < 4").select("at").distinct().count()


def test_ledger_gives_a_number_once(spark, tmp_path):
    at = str(tmp_path / "ledger")
    book = ledger.Ledger(spark, at)
    assert book.last() == -1 and book.read(0) is None
    book.put(0, {"a": [1, "é"]})
    with pytest.raises(FileExistsError):
        ledger.Ledger(spark, at).put(0, {"a": 2})
    assert book.read(0) == {"a": [1, "é"]} and book.last() == 0 and ledger.names(spark, at) == ["000000000"]


def test_parts_are_merged_level_by_level(spark, tmp_path):
    at, newest = str(tmp_path / "t"), jobs._newest(["k"], "n")
    schema = "k long, n long"
    for step in range(40):
        ledger.put_part(spark.createDataFrame([(step % 5, step), (100 + step, step)], schema), at, step, newest, fan=3)
        if step in (2, 8, 13):  # a step that runs again, at the end of a level too
            ledger.put_part(spark.createDataFrame([(step % 5, step), (100 + step, step)], schema), at, step, newest, fan=3)
    held = {level: len(ledger.names(spark, f"{at}/{level}")) for level in ledger.names(spark, at)}
    assert sum(held.values()) <= 3 * 4
    got = {r["k"]: r["n"] for r in ledger.read_parts(spark, at, spark.createDataFrame([], schema).schema, newest).collect()}
    assert got == {k: 35 + k for k in range(5)} | {100 + s: s for s in range(40)}


def test_stored_rollup_counts_every_row_once(spark, tmp_path, monkeypatch):
    rows = [(f"v{k % 3}", day(k // 40, k // 2 % 24, k % 60), k) for k in range(200)]
    t = telemetry(spark, rows)
    store = rollup.StoredRollup(spark, str(tmp_path / "r"))
    assert store.table() is None
    with_late = dt.timedelta(seconds=20)
    store.advance(t, day(1) + with_late, start=day(-1))
    put = ledger.Ledger.put
    monkeypatch.setattr(ledger.Ledger, "put", lambda *a: (_ for _ in ()).throw(OSError("lost")))  # between data and ledger
    with pytest.raises(OSError, match="lost"):
        store.advance(t, day(3) + with_late)
    monkeypatch.setattr(ledger.Ledger, "put", put)
    seen = lambda until: values(rollup.daily_rollup(t.filter(F.col("ts") <= F.lit(until))))
    assert values(store.table()) == seen(day(1))
    assert store.advance(t, day(3) + with_late) == (day(1), day(3))
    assert store.advance(t, day(3) + with_late) == (day(3), day(3))
    other = rollup.StoredRollup(spark, str(tmp_path / "r"))
    assert values(other.table()) == seen(day(3))
    # two at once: the second finds the number taken
    state = other.state()
    store.advance(t, day(4) + with_late)
    monkeypatch.setattr(other, "state", lambda: state)
    with pytest.raises(FileExistsError):
        other.advance(t, day(5) + with_late)
    assert values(store.table()) == seen(day(4))
    store.advance(t, day(9))
    assert values(store.table()) == seen(day(9))


def test_retention_drops_partitions_and_touches_no_other(spark, tmp_path):
    import os

    rows = [(f"v{k % 5}", day(0, 0) + dt.timedelta(minutes=20 * k), k) for k in range(600)]
    t, path = telemetry(spark, rows), str(tmp_path / "hours")
    table = "hours_of_test"
    spark.sql(f"DROP TABLE IF EXISTS {table}")
    rollup.hours_table(t, table, path=path)
    rollup.hours_table(telemetry(spark, [("v1", None, 9999), ("v1", dt.datetime(1999, 1, 1, 5), 9998)]), table)
    files = lambda: {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, n in os.walk(path) for f in n if f.endswith(".parquet")}
    before, now, keep = files(), day(3, 10, 30), 48
    want = rollup.retained(t, now, keep).count()
    plan = rollup.retention_plan(t, now, keep).filter("dropped").count()
    assert rollup.drop_old_hours(spark, table, now, keep) == plan + 1  # the stray of 1999 has an hour of its own
    after = files()
    assert all(before[f] == m for f, m in after.items()) and len(after) < len(before)
    spark.sql(f"REFRESH TABLE {table}")
    assert spark.table(table).count() == want + 1 and spark.table(table).filter("ts IS NULL").count() == 1
    assert rollup.drop_old_hours(spark, table, now, keep) == 0
    spark.sql(f"DROP TABLE {table}")
