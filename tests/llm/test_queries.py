"""The registered operator queries against DuckDB, and the pipeline against a brute-force version."""

import os
from collections import Counter

import duckdb
import pytest
import sentencepiece
from pyspark.sql import functions as F

import corpus_pipeline
from roadglass.llm import registry
from roadglass.llm.quality_model import train

from .test_dedup import brute_components, brute_fingerprint, brute_lines, brute_spans, lower
from .test_selection import plain_schedule

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    return c


@pytest.fixture(scope="module")
def texts(spark):
    return sorted((r["doc_id"], r["text"]) for r in registry.documents(spark, SF).collect())


def plain(v):
    return f"{v:.9g}" if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", registry.oracle_sql())
def test_against_sql(spark, db, name):
    df = registry.queries()[name](spark, SF)
    want = db.execute(registry.oracle_sql()[name])
    columns = [c[0] for c in want.description]
    assert sorted(columns) == sorted(df.columns)
    rows = [dict(zip(columns, r, strict=True)) for r in want.fetchall()]
    order = sorted(columns)
    assert sorted(tuple(plain(r[c]) for c in order) for r in df.collect()) == sorted(tuple(plain(r[c]) for c in order) for r in rows)


def test_lines_by_hand(spark, texts):
    got = sorted((r["doc_id"], r["n_lines"], r["n_dropped"]) for r in registry.op7_line_dedup(spark, SF).collect())
    assert got == sorted(x[:3] for x in brute_lines(texts))


def test_substrings(spark, texts):
    import hashlib

    got = {tuple(r) for r in registry.op2_substring_dedup(spark, SF).collect()}
    assert got == {(*x[:4], hashlib.sha256(x[4]).hexdigest()) for x in brute_spans(texts)}
    assert sum(x[2] for x in got) > 0


def test_simhash(spark, texts):
    values = [brute_fingerprint(t) for _, t in texts]
    roots = brute_components(values)  # ids ascend, so the smallest index has the smallest id
    got = {(r["doc_id"], r["fingerprint"], r["component_id"]) for r in registry.op4_simhash(spark, SF).collect()}
    assert got == {(i, f"{v:016x}", texts[r][0]) for (i, _), v, r in zip(texts, values, roots, strict=True)}


def test_shards(spark, texts):
    got = registry.op5_sharding(spark, SF).collect()
    shard = {r["doc_id"]: r["shard"] for r in got}
    by_text = {}
    for i, t in texts:
        assert by_text.setdefault(t, shard[i]) == shard[i]
    load = Counter()
    for r in got:
        load[r["shard"]] += r["size"]
    assert len(load) == 16 and max(load.values()) - min(load.values()) <= 0.02 * sum(load.values()) / 16
    groups = Counter()
    for _, t in texts:
        groups[t] += len(t.encode()) + 1
    assert sorted(load.values()) == plain_schedule(list(groups.items()), 16)[1]


def test_pieces_of_every_document(spark, texts):
    library = sentencepiece.SentencePieceProcessor(model_file=registry.PIECE_MODEL)
    got = {r["doc_id"]: r for r in registry.op6_sentencepiece(spark, SF).collect()}
    assert len(got) == len(texts)
    for i, t in texts:
        assert got[i]["ids"] == library.encode(t) and got[i]["n_ids"] == len(got[i]["ids"]) and got[i]["round_trip"]


def test_pipeline(spark, texts):
    docs, labels = registry.documents(spark, SF), spark.read.parquet(f"{SF}/labels.parquet")
    model = train(docs, labels)
    good = {i for (i, t) in texts if model.tails(model.scores([t]))[0, -1] >= 0.5}
    single = {}
    for i, t in texts:
        if i in good:
            single[lower(t)] = i  # ids ascend: the largest stays
    left = sorted((i, t) for i, t in texts if i in set(single.values()))
    roots = brute_components([brute_fingerprint(t) for _, t in left])
    kept = {left[r][0] for r in roots}
    library = sentencepiece.SentencePieceProcessor(model_file=registry.PIECE_MODEL)
    got = corpus_pipeline.run(spark, SF).collect()
    assert {r["doc_id"] for r in got} == kept
    text = dict(texts)
    for r in got:
        assert r["round_trip"] and r["ids"] == library.encode(text[r["doc_id"]])
    # mixing: copies of a document follow its language, the largest language is taken about once
    lang = {r["doc_id"]: r["lang"] for r in docs.collect()}
    copies, docs_in = Counter(lang[r["doc_id"]] for r in got), Counter(lang[i] for i in kept)
    rates = {k: copies[k] / docs_in[k] for k in docs_in}
    assert 1 <= rates["en"] < 1.05 and all(rates[k] > rates["en"] for k in rates if k != "en")


def test_stages_keep_columns(spark):
    docs = registry.documents(spark, SF).filter("doc_id < 200").withColumn("kept", F.lit(1)).withColumn("component_id", F.lit("x")).withColumn("_kept_id", F.lit(2))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns and out.count() > 0
        assert stage(spark, docs.limit(0), SF).count() == 0


def test_stages_choose_one_of_repeated_rows_and_null_ids(spark):
    # repeated rows, null ids that copy one text and differ in another, and a group of nulls only
    alone, other = "one " * 30 + "alone", "quite another text " * 9
    rows = [(5, "same"), (5, "same"), (3, "SAME"), (None, "same"), (None, alone), (None, alone), (7, other), (7, other), (None, other)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    single = corpus_pipeline.drop_copies(spark, docs, SF)
    want = [(5, "same"), (7, other), (None, alone)]
    assert sorted(map(tuple, single.collect()), key=str) == sorted(want, key=str)
    near = corpus_pipeline.drop_near_copies(spark, docs.filter("text <> 'SAME'"), SF)
    assert sorted(map(tuple, near.collect()), key=str) == sorted(want, key=str)


def test_every_stage_on_edges(spark):
    """Null, unlisted and missing languages, nulls everywhere, empty and long texts, repeated rows: through all stages in turn."""
    rows = [(1, "the road to the mill is long and dry " * 8, "en", "s"), (2, None, None, None), (3, "", "it", "s"), (None, "la strada per il mulino " * 9, "it", None), (4, "der weg zur alten brücke " * 4_000, "de", "s")]
    rows += [(5, f"some words of text {k}", None, "s") for k in range(4)] + [(6, "same row", "pt", "s")] * 3
    for langs in (lambda x: x, lambda _: None, lambda _: "it"):
        docs = spark.createDataFrame([(i, t, langs(lang), s, 1, "x", "y") for i, t, lang, s in rows], "doc_id long, text string, lang string, source string, n_chars long, kept string, _mix_p string").repartition(3)
        for at, (_, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, docs, SF)
            if at == len(corpus_pipeline.STAGES) - 1:
                assert {"doc_id", "ids", "round_trip"} <= set(out.columns)
                assert all(r["round_trip"] for r in out.collect()) and out.count() == docs.count()
                assert stage(spark, docs.limit(0), SF).count() == 0
            else:
                assert out.columns == docs.columns and stage(spark, docs.limit(0), SF).count() == 0
                docs = out.coalesce(2) if at else docs  # the classifier's verdict on such texts is not the point here
