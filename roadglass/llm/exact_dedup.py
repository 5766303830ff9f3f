"""Exact deduplication by deterministic block naming.

Each text, A-Z lower-cased, is cut into fixed-size blocks of bytes. The distinct blocks are sorted and named by
integers; then adjacent names are paired and the distinct pairs are sorted and named, again and again, until every
document has one name. Two documents get the same (level, name) exactly if their texts are equal.

Only distinct blocks are shuffled with their bytes, once, after map-side combining. Names find their way back by
a 128-bit hash of the block, which is first proven to be collision-free over all blocks; if it were not, the
blocks themselves are the join key. A name that a third of all documents share is split by adaptive execution.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .common import ascii_lower, cut, hash128, skew_join, whole_text


def _blocks(binary: Column, size: int) -> Column:
    """The text's bytes in blocks; an empty text is one empty block."""
    last = F.greatest(F.ceil(F.octet_length(binary) / size), F.lit(1)).cast("int")
    return F.transform(F.sequence(F.lit(1), last), lambda i: F.substring(binary, (i - 1) * size + 1, size))


def _name(distinct: DataFrame, by: list[str]) -> DataFrame:
    """Integer names for distinct rows: their place in the sorted hash partition they lie in.

    The rows differ, so their order within a partition is total and a task that runs again gives the same names."""
    return distinct.sortWithinPartitions(*by).withColumn("name", F.monotonically_increasing_id())


def block_names(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = 4096, hasher=hash128) -> DataFrame:
    """One row for each input row: _row, the id, text_sha256, level and name.

    (level, name) is the same for two rows exactly if their normalised texts are the same. Null text is empty."""
    texts = docs.select(F.monotonically_increasing_id().alias("_row"), F.col(id_col).alias(id_col), ascii_lower(whole_text(text_col)).alias("_text"))
    binary = F.col("_text").cast("binary")

    def keys(block: Column) -> Column:
        h1, h2 = hasher(block)
        return F.struct(h1.alias("h1"), h2.alias("h2"))

    rows = cut(texts.select("_row", id_col, F.sha2(binary, 256).alias("text_sha256"), F.transform(_blocks(binary, block_bytes), keys).alias("_keys")), "documents")
    blocks = texts.select(F.explode(_blocks(binary, block_bytes)).alias("block")).select(keys(F.col("block")).alias("k"), "block").select("k.*", "block")
    names = cut(_name(blocks.distinct(), ["block"]).select("h1", "h2", "name"), "block-names")
    placed = rows.select("_row", F.size("_keys").alias("n"), F.posexplode("_keys").alias("pos", "k")).select("_row", "n", "pos", "k.*")
    if names.groupBy("h1", "h2").count().filter("count > 1").isEmpty():
        current = skew_join(placed, names, ["h1", "h2"])
    else:  # the hash does not tell all blocks apart: carry the blocks themselves
        rows = cut(texts.select("_row", id_col, F.sha2(binary, 256).alias("text_sha256"), _blocks(binary, block_bytes).alias("_keys")), "documents")
        placed = rows.select("_row", F.size("_keys").alias("n"), F.posexplode("_keys").alias("pos", "block"))
        current = skew_join(placed, cut(_name(blocks.select("block").distinct(), ["block"]), "blocks"), ["block"])

    most = rows.select(F.max(F.size("_keys"))).first()[0] or 1
    current = cut(current.select("_row", "n", "pos", "name"), "names-0")
    done = [current.filter("n = 1").select("_row", F.lit(0).alias("level"), "name")]
    for level in range(1, (most - 1).bit_length() + 1):
        half = F.floor(F.col("pos") / 2).cast("int")
        pairs = current.filter("n > 1").groupBy("_row", half.alias("half")).agg(
            F.first("n").alias("n"),
            F.max(F.when(F.col("pos") % 2 == 0, F.col("name"))).alias("a"),
            F.coalesce(F.max(F.when(F.col("pos") % 2 == 1, F.col("name"))), F.lit(-1)).alias("b"),
        )
        pairs = cut(pairs.select("_row", F.ceil(F.col("n") / 2).cast("int").alias("n"), F.col("half").alias("pos"), "a", "b"), f"pairs-{level}")
        named = _name(pairs.select("a", "b").distinct(), ["a", "b"])
        current = cut(skew_join(pairs, named, ["a", "b"]).select("_row", "n", "pos", "name"), f"names-{level}")
        done.append(current.filter("n = 1").select("_row", F.lit(level).alias("level"), "name"))
    final = done[0]
    for more in done[1:]:
        final = final.unionByName(more)
    return rows.select("_row", id_col, "text_sha256").join(final, "_row")


def exact_dedup(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = 4096, hasher=hash128) -> DataFrame:
    """One row for each input row: id, keep_id, group_size, kept, text_sha256.

    Texts are equal if they are identical after lower-casing A-Z only; of equal texts the row with the largest id
    stays. Null text counts as empty. A null id is smaller than any other; rows that repeat both id and text are
    told apart, so exactly one row of each group is kept. An empty table gives an empty result. Other columns of
    `docs` are not read and may have any name."""
    named = cut(block_names(docs, id_col=id_col, text_col=text_col, block_bytes=block_bytes, hasher=hasher), "identities")
    groups = named.groupBy("level", "name").agg(F.max(F.struct(F.col(id_col).alias("id"), "_row")).alias("_keep"), F.count(F.lit(1)).alias("group_size"))
    return skew_join(named, groups, ["level", "name"]).select(
        id_col,
        F.col("_keep.id").alias("keep_id"),
        "group_size",
        (F.col("_row") == F.col("_keep._row")).alias("kept"),
        "text_sha256",
    )
