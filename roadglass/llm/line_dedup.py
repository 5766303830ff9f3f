"""Line deduplication with keep bitmaps, in Spark's own expressions only.

Every line long enough gives a 128-bit hash of its key. Hashes are range-partitioned and sorted by document and
position within each hash; streaming down, the first occurrence is the one that stays, and a hash found in enough
documents drops the others. What comes back is a sparse bitmap of dropped lines for each document, not text.

A hash may hold a large share of all lines. One of more than RUN occurrences is streamed in several runs of about that
length, each with the lines of its own documents in the same order; the first occurrences of the runs then compete for
the hash. So a run holds about RUN lines at any input size, and no list of hashes reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import ascii_lower, cut, hash128, skew_join, whole_text

SPACE = " \t\n\x0b\x0c\r"
#: Lines of one hash that are streamed in one run, about.
RUN = 50_000


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def line_bitmaps(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 20, min_docs: int = 3, run: int = RUN) -> DataFrame:
    """For each document with a dropped line: id, text_hash, dropped (array of word and bits, bit k of word w for
    line 64 w + k). A line's key is the line stripped of ASCII white space with A-Z lower-cased; keys of at least
    `min_chars` code points found in at least `min_docs` documents stay only in the largest id that holds them."""
    text = whole_text(text_col)
    keys = F.transform(_lines(ascii_lower(text)), lambda x: F.btrim(x, F.lit(SPACE)))
    h1, h2 = hash128(F.col("key"))
    occurrences = cut(
        docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("text_hash"), F.posexplode(keys).alias("pos", "key"))
        .filter(F.char_length("key") >= min_chars)
        .select("id", "text_hash", "pos", h1.alias("h1"), h2.alias("h2")),
        "lines",
    )
    long = occurrences.groupBy("h1").count().filter(F.col("count") > run).select(F.col("h1").alias("_long"), F.ceil(F.col("count") / run).alias("_runs"))
    long = cut(long, "long-runs")  # how it joins is left to its size
    dealt = occurrences.join(long, occurrences["h1"] == long["_long"], "left")
    dealt = dealt.select("id", "text_hash", "pos", "h1", "h2", F.coalesce(F.pmod(F.xxhash64("id"), F.col("_runs")), F.lit(0)).alias("run"), F.col("_runs").isNotNull().alias("is_part"))

    # in each run the first occurrence comes first; a document's lines are neighbours
    one_run = Window.partitionBy("h1", "h2", "run")
    streamed = (
        dealt.repartitionByRange("h1", "run")
        .withColumn("keeper", F.first("id").over(one_run.orderBy(F.desc("id"), "pos")))
        .withColumn("nth", F.dense_rank().over(one_run.orderBy(F.desc("id"))))
        .withColumn("n_docs", F.max("nth").over(one_run))
    )
    goes = (F.col("n_docs") >= min_docs) & ~F.col("id").eqNullSafe(F.col("keeper"))
    if long.isEmpty():
        dropped = streamed.filter(goes)
    else:
        streamed = cut(streamed.select("id", "text_hash", "pos", "h1", "h2", "run", "is_part", "keeper", "n_docs"), "runs")
        firsts = streamed.filter("is_part").groupBy("h1", "h2", "run").agg(F.max("keeper").alias("keeper"), F.max("n_docs").alias("n_docs"))
        verdicts = firsts.groupBy("h1", "h2").agg(F.max("keeper").alias("keeper"), F.sum("n_docs").alias("n_docs"))
        parts = skew_join(streamed.filter("is_part").drop("keeper", "n_docs"), verdicts, ["h1", "h2"])
        dropped = streamed.filter(~F.col("is_part") & goes).select("id", "text_hash", "pos").unionByName(parts.filter(goes).select("id", "text_hash", "pos"))

    bit = F.expr("shiftleft(1L, pos % 64)")
    words = dropped.groupBy("id", "text_hash", F.floor(F.col("pos") / 64).alias("word")).agg(F.bit_or(bit).alias("bits"))
    return words.groupBy("id", "text_hash").agg(F.sort_array(F.collect_list(F.struct("word", "bits"))).alias("dropped"))


def _mask(dropped: Column) -> Column:
    """The bitmap as bytes, '1' for each dropped line: constant-time look-up for each line."""
    before = F.concat(F.array(F.lit(-1).cast("long")), F.transform(dropped, lambda x: x["word"]))
    runs = F.zip_with(dropped, F.slice(before, 1, F.greatest(F.size(dropped), F.lit(0))), lambda x, last: F.concat(F.repeat(F.lit("0"), ((x["word"] - last - 1) * 64).cast("int")), F.reverse(F.lpad(F.bin(x["bits"]), 64, "0"))))
    return F.array_join(runs, "").cast("binary")


def line_dedup(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 20, min_docs: int = 3, run: int = RUN) -> DataFrame:
    """One row for each input row: id, n_lines, n_dropped, kept_text.

    Null or empty text is one empty line. A null id is smaller than any other; rows that share an id are one
    document, each with its own text, so a line they share counts once and stays in all of them if that id is
    the largest. Other columns of `docs` are not read; an empty table gives an empty result."""
    text = whole_text(text_col)
    bitmaps = line_bitmaps(docs, id_col=id_col, text_col=text_col, min_chars=min_chars, min_docs=min_docs, run=run)
    texts = docs.select(F.col(id_col).alias("_id"), text.alias("_text")).withColumn("_hash", F.xxhash64("_text"))
    joined = texts.join(bitmaps, texts["_id"].eqNullSafe(bitmaps["id"]) & (texts["_hash"] == bitmaps["text_hash"]), "left")
    lines, mask = _lines(F.col("_text")), F.col("_mask")
    kept = F.array_join(F.filter(lines, lambda x, i: F.substring(mask, i + 1, F.lit(1)) != F.lit(b"1")), "\n")
    n_dropped = F.aggregate("dropped", F.lit(0).cast("long"), lambda n, x: n + F.bit_count(x["bits"]))
    return joined.withColumn("_mask", _mask(F.col("dropped"))).select(
        F.col("_id").alias(id_col),
        F.size(lines).cast("long").alias("n_lines"),
        F.coalesce(n_dropped, F.lit(0)).cast("long").alias("n_dropped"),
        F.when(F.col("dropped").isNull(), F.col("_text")).otherwise(kept).alias("kept_text"),
    )
