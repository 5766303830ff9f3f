"""What the training-data operators share: scratch tables, text rules and skew-safe joins."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import reduce, wraps

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()

_own_folder: list[str] = []


def scratch_root(spark: SparkSession) -> str:
    """The shared folder named by spark.checkpoint.dir. Only a session in local mode may do without that setting: its
    executors are threads of the driver, so a folder under /tmp is shared, too; on a cluster it would not be."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.conf.get("spark.master", "").startswith("local"):
        raise ValueError("spark.checkpoint.dir names no shared folder for scratch tables")
    if not _own_folder:
        _own_folder.append(tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
    return f"file://{_own_folder[0]}"


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write `df` as a scratch table and read it back: lineage ends here, so a lost executor re-reads the
    table instead of recomputing, and values such as monotonically increasing ids stay as written.

    The tables lie in the shared checkpoint folder under a fresh name and fall under its clean-up rule."""
    path = f"{scratch_root(df.sparkSession)}/scratch-{uuid.uuid4().hex}-{name}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only. `lower` does just that on pure ASCII, where it is several times faster than translate."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def whole_text(text_col: str) -> Column:
    """The text, null as empty."""
    return F.coalesce(F.col(text_col), F.lit(""))


def hash128(*cols: Column) -> tuple[Column, Column]:
    """Two independently seeded 64-bit hashes, to be used as one 128-bit key."""
    return F.xxhash64(*cols), F.xxhash64(F.lit(0x5EED), *cols)


def skew_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner", null_safe: bool = False) -> DataFrame:
    """Join on `keys` so that adaptive execution can split a hot key.

    Spark splits a skewed partition only if both sides are shuffled for this very join. A side that comes out of
    a groupBy on the same keys would be reused as it lies; one more derived join key makes both sides move. The
    right side must be the one with few rows for each key. Left columns win; right columns must not clash."""
    h = "_join_hash"
    left, right = left.withColumn(h, F.xxhash64(*keys)), right.withColumn(h, F.xxhash64(*keys))
    renamed = right.withColumnsRenamed({k: f"_r_{k}" for k in [*keys, h]})
    same = (lambda k: left[k].eqNullSafe(renamed[f"_r_{k}"])) if null_safe else (lambda k: left[k] == renamed[f"_r_{k}"])
    joined = left.join(renamed, reduce(lambda a, b: a & b, [left[h] == renamed[f"_r_{h}"], *map(same, keys)]), how)
    return joined.drop(h, *[f"_r_{k}" for k in [*keys, h]])


def free_name(docs: DataFrame, name: str) -> str:
    """`name`, with underscores added until no column of `docs` has it, whatever its case."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name += "_"
    return name


def row_keyed(docs: DataFrame) -> tuple[DataFrame, str]:
    """`docs` written with one more column that tells all rows apart, repeated and null ids too, and its name."""
    key = free_name(docs, "_row_key")
    return cut(docs.withColumn(key, F.monotonically_increasing_id()), "rows"), key


def keep_rows(docs: DataFrame, kept: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The rows of `docs`, all columns, whose id is in `kept`; a null id matches a null id."""
    ids = kept.select(F.col(id_col).alias("_kept_id"))
    return docs.join(ids, docs[id_col].eqNullSafe(ids["_kept_id"]), "left_semi")


def give_back() -> None:
    """Hand memory that is free in this process back to the system."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # not every C library has it
    if trim is not None:
        trim(0)


def trimmed(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """`run`, for mapInArrow, giving memory back when its task ends: a Python worker lives on for the stages that follow,
    and what its allocators keep counts against the executor."""

    @wraps(run)
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return task
