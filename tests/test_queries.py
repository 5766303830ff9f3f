"""Every query of the fleet runs; those with SQL agree with DuckDB."""

import os

import duckdb
import pytest

from roadglass import plans

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    c.execute("SET timezone = 'UTC'")
    for f in os.listdir(SF):
        c.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    return c


def plain(v):
    if v is None or v != v:
        return None
    return f"{v:.9g}" if isinstance(v, float) else str(v).removesuffix(" 00:00:00")


@pytest.mark.parametrize("name", plans.QUERIES)
def test_query(spark, db, name):
    df = plans.QUERIES[name](spark, SF)
    got = [tuple(plain(r[c]) for c in sorted(df.columns)) for r in df.collect()]
    if name in plans.SQL:
        want = db.execute(plans.SQL[name])
        columns = [c[0] for c in want.description]
        rows = [dict(zip(columns, r, strict=True)) for r in want.fetchall()]
        assert sorted(columns) == sorted(df.columns)
        assert sorted(got, key=str) == sorted((tuple(plain(r[c]) for c in sorted(columns)) for r in rows), key=str)


@pytest.mark.parametrize("name", ["stream_tumbling", "stream_dedup", "stream_rules", "stream_late_flags", "stream_rollup", "stream_rollup_late", "stream_live_state", "stream_alert_dedup"])
def test_streams_over_files_in_shuffled_order(spark, db, name, tmp_path, monkeypatch):
    from roadglass.streaming import jobs

    monkeypatch.setattr(jobs, "ROWS_PER_RANGE", 400, raising=False)
    events = spark.read.parquet(f"{SF}/events.parquet")
    # the latest events come in the first file; one event a year on, beyond any delay
    late = events.limit(1).selectExpr(*[f"{c} + interval 1 year AS {c}" if c == "ts" else f"{c} + 1000000 AS {c}" if c == "event_id" else c for c in events.columns])
    third = events.selectExpr("max(event_id) / 3").first()[0]
    for part in (late, events.filter(f"event_id > {2 * third}"), events.filter(f"event_id <= {third}"), events.filter(f"event_id > {third} AND event_id <= {2 * third}")):
        part.coalesce(1).write.mode("append").parquet(f"{tmp_path}/events.parquet")
    db.execute(f"CREATE SCHEMA IF NOT EXISTS {name}")
    db.execute(f"CREATE VIEW {name}.events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    db.execute(f"SET search_path = '{name},main'")
    try:
        want = db.execute(plans.SQL[name])
        columns = [c[0] for c in want.description]
        rows = [tuple(map(plain, r)) for r in want.fetchall()]
    finally:
        db.execute("SET search_path = 'main'")
    got = [tuple(map(plain, r)) for r in plans.QUERIES[name](spark, str(tmp_path)).select(*columns).collect()]
    assert sorted(got, key=str) == sorted(rows, key=str)


@pytest.mark.parametrize("name", ["train_risk", "score_risk", "feature_importance"])
def test_risk_queries_train_at_the_operators_scale(spark, name, monkeypatch):
    from roadglass.operators import risk

    class Asked(Exception):
        pass

    def train(df, **options):
        raise Asked(options)

    monkeypatch.setattr(risk, "train_risk", train)
    with pytest.raises(Asked) as asked:
        plans.QUERIES[name](spark, SF)
    assert asked.value.args[0] == {"label": "label"}
