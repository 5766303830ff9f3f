"""Sharding by longest-processing-time scheduling.

Documents of equal text form a group and stay together. Groups are taken by size, largest first, and each goes to the
least-loaded shard, which a heap gives. Groups of one size are alike to the schedule, so the heap sees how many groups
there are of each size and not the groups: there are at most sqrt(2 x bytes) sizes, as distinct sizes add up. They stream
by the heap in order, in one task that holds the loads and a batch and writes its picks as it goes; nothing of it comes to
the driver. Where many groups have the same size the heap's picks repeat in rounds, which are handed out at once; Spark
then deals the groups of a size to its picks by their number. The schedule is the plain one for every group at any input
size. A group that is larger than a shard's share is not split.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .common import cut, skew_join, trimmed

#: Groups of a size, and rows of a shard, are numbered within hash classes, whose counts link the numbers. A class is at
#: least so many leading hex digits of the hash, more where classes would have over CLASS_ROWS rows.
CLASS_DIGITS, CLASS_ROWS = 3, 100_000


def rounds(heap: list[tuple[int, int]], size: int, count: int) -> list[tuple[int, list[int]]]:
    """Put `count` groups of `size` on the shards of `heap` (load, shard), each on the least-loaded one.

    The picks as (first, shards): from group `first` on the shards take one group each in this order, over and over."""
    if count == 1:
        load, shard = heap[0]
        heapq.heapreplace(heap, (load + size, shard))
        return [(0, [shard])]
    order, out, done = sorted(heap), [], 0
    active = 1
    while done < count:
        low, first = order[0]
        # all that the first shard does not overtake with its next group take part in the round
        while active < len(order) and order[active] < (low + size, first):
            active += 1
        turns, extra = divmod(count - done, active)
        if active < len(order):  # whole rounds until the next shard takes part
            load, shard = order[active]
            wait = max(1, -(-(load - low) // size) - 1)
            while (load, shard) > (low + (wait + 1) * size, first):
                wait += 1
            if wait <= turns:
                turns, extra = wait, 0
        out.append((done, [s for _, s in order[:active]]))
        order = sorted([(load + size * (turns + (k < extra)), s) for k, (load, s) in enumerate(order[:active])] + order[active:])
        done += turns * active + extra
        active = 1
    heap[:] = order
    return out


def schedule_sizes(sizes: Iterable[tuple[int, int]], shards: int) -> Iterator[tuple[int, list[tuple[int, list[int]]]]]:
    """(size, picks) of every (size, how many groups), which come largest first; the loads of the shards are all it keeps."""
    heap = [(0, s) for s in range(shards)]
    for size, count in sizes:
        yield size, rounds(heap, size, count)


PICKS = pa.schema([("bytes", pa.int64()), ("picks", pa.list_(pa.struct([("first", pa.int64()), ("turn", pa.list_(pa.int32()))])))])


def size_picks(sizes: DataFrame, shards: int, batch: int = 4096) -> DataFrame:
    """(bytes, picks) of a table of (bytes, count): sorted in one task and scheduled as they stream, `batch` sizes at a time."""

    @trimmed
    def scheduled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = (pair for b in batches for pair in zip(b["bytes"].to_pylist(), b["count"].to_pylist(), strict=True))
        own: list[dict] = []
        for size, turns in schedule_sizes(pairs, shards):
            own.append({"bytes": size, "picks": [{"first": first, "turn": turn} for first, turn in turns]})
            if len(own) == batch:
                yield pa.RecordBatch.from_pylist(own, PICKS)
                own = []
        yield pa.RecordBatch.from_pylist(own, PICKS)

    ordered = sizes.select("bytes", "count").coalesce(1).sortWithinPartitions(F.desc("bytes"))
    return ordered.mapInArrow(scheduled, "bytes long, picks array<struct<first:long,turn:array<int>>>")


def schedule(units: list[tuple[object, int]], shards: int) -> dict[object, int]:
    """Largest unit first, each to the shard with the least load; ties go to the smaller unit name and shard."""
    by_size: dict[int, list] = {}
    for name, size in sorted(units):
        by_size.setdefault(size, []).append(name)
    placed = {}
    for size, picks in schedule_sizes(sorted(((size, len(names)) for size, names in by_size.items()), reverse=True), shards):
        names = by_size[size]
        for (first, turn), end in zip(picks, [*(p for p, _ in picks[1:]), len(names)], strict=True):
            placed |= {names[k]: turn[(k - first) % len(turn)] for k in range(first, end)}
    return placed


def class_digits(count: int) -> int:
    """How many leading hex digits of the hash make a class of so many rows."""
    digits = CLASS_DIGITS
    while count > CLASS_ROWS * 16**digits:
        digits += 1
    return digits


def _numbered(rows: DataFrame, within: str, name: str, by: list[str]) -> DataFrame:
    """`rows` (with `class`) and `nth`: 0, 1, ... in each value of `within`, by class and then `by`; `class` goes."""
    counts = cut(rows.groupBy(within, "class").count(), f"{name}-classes")
    before = Window.partitionBy(within).orderBy("class").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(within, "class", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_start"))
    nth = F.row_number().over(Window.partitionBy(within, "class").orderBy(*by)) - 1
    ranked = rows.withColumn("_nth", nth)
    return skew_join(ranked, starts, [within, "class"]).withColumn("nth", F.col("_start") + F.col("_nth")).drop("class", "_start", "_nth")


def shard_by_size(docs: DataFrame, *, shards: int = 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each input row: id, size (UTF-8 bytes plus 1), text_crc32, shard, slot (0, 1, ... in each shard).

    Null text has no bytes and is grouped with the empty text. Null and repeated ids are rows like any other.
    An empty table gives an empty result. Other columns of `docs` are not read."""
    text = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    rows = cut(docs.select(F.col(id_col).alias("id"), (F.octet_length(text).cast("long") + 1).alias("size"), F.crc32(text).alias("text_crc32"), F.unhex(F.sha2(text, 256)).alias("group")), "sizes")
    digits = class_digits(rows.count())
    groups = rows.groupBy("group").agg(F.sum("size").alias("bytes"))
    groups = cut(groups.withColumn("class", F.substring(F.hex("group"), 1, digits)), "groups")
    sizes = cut(groups.groupBy("bytes").count(), "group-sizes")
    picks = cut(size_picks(sizes, shards), "picks")
    placed = skew_join(_numbered(groups, "bytes", "group", ["group"]), picks, ["bytes"])
    pick = F.element_at(F.filter("picks", lambda p: p["first"] <= F.col("nth")), -1)
    own = placed.withColumn("pick", pick).select("group", F.get("pick.turn", ((F.col("nth") - F.col("pick.first")) % F.size("pick.turn")).cast("int")).alias("shard"))
    spread = F.md5(F.concat(F.coalesce(F.col("id").cast("string"), F.lit("")), F.hex("group")).cast("binary"))  # the copies of one text fall into all classes
    put = skew_join(rows, own, ["group"]).withColumn("class", F.substring(spread, 1, digits))
    return _numbered(cut(put, "put"), "shard", "shard", ["id", "group"]).select(F.col("id").alias(id_col), "size", "text_crc32", "shard", F.col("nth").alias("slot"))
