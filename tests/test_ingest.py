"""The ingest job over several batches, with failures and repeats, against the batch operators."""

import datetime as dt
import json
import random
import time

import pytest
from pyspark.sql import functions as F

from roadglass.operators import rules, windows
from roadglass.sources import sinks
from roadglass.streaming import jobs

VIN = ("1M8GDM9AXKP042788", "11111111111111111")


def write_batches(path, n=4, each=40):
    """Files of payloads in order of time, half of the last file's in the next one again."""
    rng, rows = random.Random(6), []
    for k in range(n * each):
        at = dt.datetime(2024, 5, 1) + dt.timedelta(minutes=2 * k)
        rows.append({"vin": VIN[k % 2], "ts": at.isoformat(timespec="milliseconds") + "Z", "seq": k, "lat": 1.0, "lon": 2.0, "speed_kmh": 50.0, "odo_km": float(k), "soc_pct": rng.randrange(100), "coolant_c": rng.choice([95, 120]), "batt_v": 12.5, "evt": rng.choice(["HARSH_BRAKE", None]), "dtc": rng.choice([["P0301"], None])})
    for b in range(n):
        own = rows[max(0, b * each - each // 2) : (b + 1) * each]
        (path / f"{b}.json").write_text("".join(json.dumps({"value": json.dumps(r)}) + "\n" for r in own) + json.dumps({"value": "{bad"}) + "\n")
        time.sleep(0.02)
    return rows


def test_ingest_fails_and_goes_on(spark, tmp_path, monkeypatch):
    source = tmp_path / "in"
    source.mkdir()
    rows = write_batches(source)
    tenants = spark.createDataFrame([(v, k) for k, v in enumerate(VIN)], "vin string, tenant_id int")

    def run():
        stream = spark.readStream.schema("value string").option("maxFilesPerTrigger", 1).json(str(source))
        return jobs.ingest(stream, tenants, at=str(tmp_path / "job"))

    write, calls = sinks.write_by_hour, []

    def failing(df, path, *args, **options):
        calls.append(path)
        if len(calls) == 6:  # the third batch has written its alerts, not yet its telemetry
            raise RuntimeError("lost")
        write(df, path, *args, **options)

    monkeypatch.setattr(sinks, "write_by_hour", failing)
    with pytest.raises(Exception, match="lost"):
        run()
    monkeypatch.setattr(sinks, "write_by_hour", write)
    wrote = run()
    telemetry, alerts = (spark.read.parquet(wrote[t]) for t in ("telemetry", "alerts"))
    assert sorted(r["seq"] for r in telemetry.select("seq").collect()) == [r["seq"] for r in rows]
    want = rules.first_of_each(rules.alerts(telemetry))
    key = lambda df: sorted((r["dedup_key"], r["seq"]) for r in df.collect())
    assert key(alerts) == key(want) and {r["rule"] for r in want.collect()} >= {"OVERHEAT_TREND", "HARSH_BRAKE_PATTERN", "DTC", "LOW_SOC"}
    live = {r["vin"]: r["seq"] for r in jobs.live_table(spark, wrote["live"]).collect()}
    assert live == {r["vin"]: r["seq"] for r in windows.latest(telemetry, key="vin", seq="seq").collect()}
    assert spark.read.parquet(wrote["dead"]).count() == 4
    sizes = {r["at_most"]: r["batches"] for r in jobs.batch_sizes(spark, wrote["outcomes"]).collect()}
    assert sizes[10] == 0 and sizes[100] == sizes[None] == 4
    before = telemetry.count()
    assert run() == wrote and spark.read.parquet(wrote["telemetry"]).count() == before


def test_alerts_go_out_by_tenant_once_whatever_fails(spark, tmp_path, monkeypatch):
    source = tmp_path / "in"
    source.mkdir()
    write_batches(source)
    tenants = spark.createDataFrame([(v, k) for k, v in enumerate(VIN)], "vin string, tenant_id int")

    def run():
        stream = spark.readStream.schema("value string").option("maxFilesPerTrigger", 1).json(str(source))
        return jobs.ingest(stream, tenants, at=str(tmp_path / "job"))

    write, put, calls = sinks.write_by_hour, jobs.put_part, []

    def failing(df, path, *args, **options):
        calls.append("write")
        if calls.count("write") == 3:  # alerts of the second batch are set out, not yet in the table
            raise RuntimeError("lost")
        write(df, path, *args, **options)

    def failing_put(*args, **options):
        calls.append("put")
        if calls.count("put") == 3:  # telemetry is written, live state is not
            raise RuntimeError("lost")
        put(*args, **options)

    monkeypatch.setattr(sinks, "write_by_hour", failing)
    monkeypatch.setattr(jobs, "put_part", failing_put)
    for _ in range(2):
        with pytest.raises(Exception, match="lost"):
            run()
    wrote = run()
    alerts, pushed = (spark.read.parquet(wrote[t]) for t in ("alerts", "fanout"))
    key = lambda df: sorted((r["tenant_id"], r["alert_id"], r["dedup_key"], r["seq"]) for r in df.collect())
    assert key(alerts) == key(pushed) and len({r[1] for r in key(alerts)}) == len(key(alerts)) > 20
    assert all(k[0] == VIN.index(k[2].split(":")[0]) for k in key(alerts))
    outcomes = {}
    for r in spark.read.parquet(wrote["outcomes"]).collect():
        outcomes[r["outcome"]] = outcomes.get(r["outcome"], 0) + r["n"]
    # 160 rows, the last 20 of each of three files again in the next one
    assert outcomes == {"processed": 220, "unknown": 0, "malformed": 4, "written": 160, "duplicate": 60, "late": 0, "ok": 160}


def test_a_batch_costs_the_same_whatever_was_written_before(spark, tmp_path, monkeypatch):
    """Late and live rows over many batches: folders opened, parts held and rows written by each."""
    source = tmp_path / "in"
    source.mkdir()
    at0 = dt.datetime(2024, 5, 1)
    for b in range(18):
        rows = [{"vin": VIN[k % 2], "ts": (at0 + dt.timedelta(hours=b, minutes=k)).isoformat(timespec="milliseconds") + "Z", "seq": 100 * b + k if b != 16 else 5 + k, "lat": 1.0, "lon": 2.0, "speed_kmh": 1.0, "odo_km": 1.0, "batt_v": 12.5} for k in range(4)]
        (source / f"{b:02d}.json").write_text("".join(json.dumps({"value": json.dumps(r)}) + "\n" for r in rows))
        time.sleep(0.01)
    opened, read = [], jobs.Tables.read

    def counting(self, table, hours):
        df = read(self, table, hours)
        opened.append(len(df.inputFiles()))
        return df

    monkeypatch.setattr(jobs.Tables, "read", counting)
    stream = spark.readStream.schema("value string").option("maxFilesPerTrigger", 1).json(str(source))
    tenants = spark.createDataFrame([(v, k) for k, v in enumerate(VIN)], "vin string, tenant_id int")
    wrote = jobs.ingest(stream, tenants, at=str(tmp_path / "job"))
    per_batch = [sum(opened[i : i + len(opened) // 18]) for i in range(0, len(opened), len(opened) // 18)]
    assert max(per_batch[10:]) <= max(per_batch[2:10])
    from roadglass.sources import ledger

    assert sum(len(ledger.names(spark, f"{wrote['live']}/{level}")) for level in ledger.names(spark, wrote["live"])) == 1 + 18 % 16
    assert len(ledger.names(spark, str(tmp_path / "job/fresh"))) == 1
    late = {r["batch"]: r["n"] for r in spark.read.parquet(wrote["outcomes"]).filter("outcome = 'late'").collect()}
    assert late == {b: 4 if b == 16 else 0 for b in range(18)}
    assert {r["vin"]: r["seq"] for r in jobs.live_table(spark, wrote["live"]).collect()} == {VIN[0]: 1702, VIN[1]: 1703}


def test_window_state_keeps_only_the_window(spark):
    """What a vehicle's state holds after a batch is what later rows can still see."""
    class Held:
        rows = []

        def exists(self):
            return bool(self.rows)

        def get(self):
            return iter(self.rows)

        def put(self, rows):
            self.rows = rows

    import pandas as pd

    p = jobs.WindowRules(rules.Limits(), None)
    p.held = {"coolant": Held(), "brake": Held()}
    found = []
    for b in range(50):
        t = [b * 600_000 + 10_000 * k for k in range(60)]
        pdf = pd.DataFrame({"vin": "v", "ts_ms": t, "seq": range(b * 60, b * 60 + 60), "coolant_c": 120.0, "evt": "HARSH_BRAKE"})
        found += [out for out in p.handleInputRows(("v",), iter([pdf]), None)]
        assert len(p.held["coolant"].rows) <= 31 and len(p.held["brake"].rows) <= 361
    assert sum(map(len, found)) == 2 * 3000 - 1 - 2  # all but the first reading and the first two brakes
