"""SimHash near-duplicates: exact links between fingerprints that differ in few bits, by vantage-point trees.

A vantage-point tree parts points by their Hamming distance to a vantage point, and the triangle bound says which
other side a near point can lie on: if two points are within r, their distances to any point differ by r at most. On
all 64 bits that bound parts next to nothing: random fingerprints lie 32 +- 4 bits from any vantage point, so those
within 4 bits of a boundary, which both sides would have to hold, are most of them. The trees therefore stand on the
distance over parts of the bits. Of five parts one is equal in two fingerprints that differ in at most four bits; on
that part r is 0, so both lie in the same shell around every vantage point and no shard overlaps another.

Fingerprints go to five shards each: for every part the shell numbers around some vantage points, the more points the
more fingerprints there are. A shard that is still large goes on: rows that agree in its part are dealt again by five
parts of the bits that are left, as often as needed. Within a shard, tree nodes halve the fingerprints at the median
distance over the part, where the bound with r = 0 cuts off the other half; fingerprints that agree in the part meet in
a tree over all 64 bits with r = 4, whose boundary rows go to both sides. Each task returns a spanning forest of its
links, never all pairs; components over these forests are found by Spark joins.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from functools import reduce
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F, types as T

from .common import LOWER, UPPER, cut, skew_join, trimmed
from .components import connected_components

SEED = 42
MAX_BITS = 4
#: Widths of the five parts, from the top bit: of all bits, then of those that are left after each dealing.
LEVELS = ((13, 13, 13, 13, 12), (11, 10, 10, 10, 11), (9, 8, 8, 8, 9), (7, 7, 7, 7, 6))
#: Vantage points on a part. Any two differ in half of the bits, so that distances to them tell different things.
VANTAGES = (0x0000, 0x5555, 0x3333, 0x6666, 0x0F0F, 0x5A5A, 0x3C3C, 0x6969, 0x00FF, 0x55AA, 0x33CC, 0x6699)
#: Fingerprints of a shard, about, for which vantage points are chosen; a shard of more than SPLIT is dealt again.
SHARD = 4_096
SPLIT = 20_000
#: Fingerprints in a leaf of a tree, and most of those that are compared at once.
LEAF = 32
TILE = 512
_TO_LOWER = bytes.maketrans(UPPER.encode(), LOWER.encode())


def fingerprint(text: str | None, width: int = 4) -> int:
    """Unsigned 64-bit SimHash over the text's word shingles; 0 if it has no words."""
    words = (text or "").encode().translate(_TO_LOWER).split()
    if not words:
        return 0
    line = b" ".join(words)
    ends = list(accumulate(map(len, words), lambda a, n: a + n + 1))
    starts = [0, *(e + 1 for e in ends)]
    digest = xxhash.xxh64_intdigest
    shingles = [line] if len(words) < width else map(line.__getitem__, map(slice, starts, ends[width - 1 :]))
    hashes = np.fromiter((digest(s, SEED) for s in shingles), np.uint64)
    ones = np.zeros(64, np.int64)
    for k in range(0, len(hashes), 65_536):
        part = hashes[k : k + 65_536].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def _fingerprinted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = np.array([fingerprint(t.as_py()) for t in batch.column(1)], np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found)], ["id", "fp"])


class _Forest:
    """Links among n items, kept as the smallest label of each item's set."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def find(self, i: np.ndarray) -> np.ndarray:
        up = self.up[i]
        while len(i) and (up != self.up[up]).any():
            up = self.up[up]
        self.up[i] = up
        return up

    def link(self, i: np.ndarray, j: np.ndarray) -> None:
        while len(i):
            a, b = self.find(i), self.find(j)
            apart = a != b
            i, j, a, b = i[apart], j[apart], a[apart], b[apart]
            np.minimum.at(self.up, np.maximum(a, b), np.minimum(a, b))


def shard_links(fps: np.ndarray, codes: np.ndarray | None = None, radius: int = MAX_BITS, tally: Counter | None = None) -> np.ndarray:
    """For each of the distinct fingerprints the index of the one that stands for its linked set.

    With `codes` (the part of each) only links between equal codes are asked for; others may be found as well. `tally`
    counts tree nodes, the times that the bound cut off a side, the pairs that this left out and the pairs compared."""
    forest, told = _Forest(len(fps)), Counter() if tally is None else tally

    def tiles(a: np.ndarray, b: np.ndarray, own: bool) -> None:
        for s in range(0, len(a), TILE):
            for t in range(s if own else 0, len(b), TILE):
                x, y = a[s : s + TILE], b[t : t + TILE]
                told["compared"] += len(x) * len(y)
                i, j = np.nonzero(np.bitwise_count(fps[x][:, None] ^ fps[y][None, :]) <= radius)
                forest.link(x[i], y[j])

    def cut_off(pairs: int) -> None:
        told["pruned"] += 1
        told["left out"] += pairs

    todo: list[tuple] = []
    parted = [np.arange(len(fps))] if codes is not None else []
    if codes is None:
        todo.append((np.arange(len(fps)), None))
    while parted:  # the tree over the part
        a = parted.pop()
        told["nodes"] += 1
        if len(a) <= LEAF:
            tiles(a, a, True)
            continue
        d = np.bitwise_count(codes[a] ^ codes[a[0]])
        if not d.any():
            todo.append((a, None))
            continue
        inner = d <= np.median(d)
        if inner.all():
            inner = d < d.max()
        cut_off(int(inner.sum()) * int((~inner).sum()))  # with r = 0 nothing on one side links to the other
        parted += [a[inner], a[~inner]]
    while todo:  # the tree over all bits
        a, b = todo.pop()
        told["nodes"] += 1
        if b is None:
            if len(a) <= LEAF:
                tiles(a, a, True)
                continue
            d = np.bitwise_count(fps[a] ^ fps[a[0]]).astype(np.int16)
            ball = d <= radius
            if 8 * ball.sum() >= len(a):  # a clump: linked through its vantage point
                forest.link(a[ball], np.full(ball.sum(), a[0]))
                rim = ~ball & (d <= 2 * radius)
                cut_off(int(ball.sum()) * int((~ball & ~rim).sum()))
                todo += [(a[~ball], None), (a[ball], a[rim])]
                continue
            cut_at = np.median(d)
            inner = d <= cut_at
            if inner.all():
                inner = d < cut_at
            if not inner.any() or inner.all():
                tiles(a, a, True)
                continue
            edge = d[inner].max()
            near, far = inner & (d > edge - radius), ~inner & (d <= edge + radius)
            cut_off(int(inner.sum()) * int((~inner).sum()) - int(near.sum()) * int(far.sum()))
            todo += [(a[inner], None), (a[~inner], None), (a[near], a[far])]
        elif len(a) and len(b):
            if len(a) * len(b) <= LEAF * LEAF:
                tiles(a, b, False)
                continue
            v = fps[a[0] if len(a) >= len(b) else b[0]]
            da, db = np.bitwise_count(fps[a] ^ v).astype(np.int16), np.bitwise_count(fps[b] ^ v).astype(np.int16)
            at = int(np.median(np.concatenate([da, db])))
            ai, bi = da <= at, db <= at
            parts = [(a[ai], b[bi]), (a[~ai], b[~bi]), (a[ai & (da > at - radius)], b[~bi & (db <= at + radius)]), (a[~ai & (da <= at + radius)], b[bi & (db > at - radius)])]
            rest = sum(len(x) * len(y) for x, y in parts)
            if rest > 0.9 * len(a) * len(b):  # the bound prunes nothing here
                tiles(a, b, False)
            else:
                cut_off(len(a) * len(b) - rest)
                todo += parts
    return forest.find(np.arange(len(fps)))


def _linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spanning forests of the shards, which arrive one after another; a shard may run over several batches."""

    def forest(held: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch | None:
        codes, fps = (np.concatenate(x) for x in zip(*held, strict=True))
        if len(fps) < 2:
            return None
        root = shard_links(fps, codes)
        more = root != np.arange(len(fps))
        if not more.any():
            return None
        return pa.RecordBatch.from_arrays([pa.array(fps[more].view(np.int64)), pa.array(fps[root[more]].view(np.int64))], ["a", "b"])

    held: list[tuple[np.ndarray, np.ndarray]] = []
    last = None
    for batch in batches:
        shards, codes, fps = (batch.column(k).to_numpy() for k in range(3))
        if not len(shards):
            continue
        bounds = [0, *(np.flatnonzero(np.diff(shards)) + 1).tolist(), len(shards)]
        for lo, hi in zip(bounds, bounds[1:], strict=False):
            if held and shards[lo] != last:
                if (found := forest(held)) is not None:
                    yield found
                held = []
            last = shards[lo]
            held.append((codes[lo:hi].view(np.uint64), fps[lo:hi].view(np.uint64)))
    if held and (found := forest(held)) is not None:
        yield found


def _bits(fp: Column, top: int, width: int) -> Column:
    """`width` bits of the fingerprint, `top` bits from the left."""
    return F.shiftrightunsigned(F.shiftleft(fp, top), 64 - width)


def _rest(fp: Column, start: int, width: int) -> Column:
    """All bits but those of one part, moved to the top; zeros follow."""
    below = F.shiftleft(fp, start + width) if start + width < 64 else F.lit(0).cast("long")
    return below.bitwiseOR(F.shiftleft(_bits(fp, 0, start), width)) if start else below


def _dealt(rows: DataFrame, level: int, vantages: int) -> DataFrame:
    """`rows` (fp, rest, path) five times: code, the part; shard, from the code's shells; and the rest without the part."""
    rest, widths, out = F.col("rest"), LEVELS[level], []
    for k, w in enumerate(widths):
        start = sum(widths[:k])
        code = _bits(rest, start, w)
        shells = [F.bit_count(code.bitwiseXOR(F.lit(v & ((1 << w) - 1)))) for v in VANTAGES[:vantages]]
        shard = F.xxhash64(F.col("path"), F.lit(5 * level + k), *shells)
        out.append(F.struct(shard.alias("shard"), code.alias("code"), _rest(rest, start, w).alias("rest")))
    return rows.select("fp", F.explode(F.array(*out)).alias("p")).select("fp", "p.*")


def hamming_links(nodes: DataFrame, *, split: int = SPLIT, shard: int = SHARD) -> DataFrame:
    """Edges (a, b) that connect the distinct fingerprints `fp` of `nodes` exactly as all pairs within MAX_BITS do."""
    rows, ready = nodes.select("fp", F.col("fp").alias("rest"), F.lit(0).cast("long").alias("path")), []
    n = rows.count()
    for level in range(len(LEVELS)):
        # a vantage point leaves about a fifth of the rows in a shell
        vantages = min(len(VANTAGES), math.ceil(math.log(max(n / shard, 1.0), 4.5))) if not level else len(VANTAGES)
        dealt = _dealt(rows, level, vantages)
        if level == len(LEVELS) - 1:  # 40 of 64 bits are the same by now: what is left are clumps
            ready.append(dealt)
            break
        dealt = dealt if not level else cut(dealt, f"dealt-{level}")
        big = cut(dealt.groupBy("shard").count().filter(F.col("count") > split).select("shard", F.lit(True).alias("big")), f"big-{level}")
        if big.isEmpty():
            ready.append(dealt)
            break
        marked = skew_join(dealt, big, ["shard"], "left")
        ready.append(marked.filter("big IS NULL").drop("big"))
        rows = cut(marked.filter("big").select("fp", "rest", F.xxhash64("shard", "code").alias("path")), f"again-{level}")
    shards = reduce(DataFrame.unionByName, [r.select("shard", "code", "fp") for r in ready])
    return shards.repartition("shard").sortWithinPartitions("shard", "code", "fp").mapInArrow(trimmed(_linked), "a long, b long")


def simhash_components(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", split: int = SPLIT) -> DataFrame:
    """One row for each input row: id, fingerprint (16 hex digits), component_id.

    component_id is the smallest id that links of at most MAX_BITS differing bits reach, the row itself included.
    Null and empty texts have fingerprint zero and are linked like any other. Null ids count as no id: a component
    of nulls only has a null component_id. Repeated rows count each. An empty table gives an empty result. Copies
    are one fingerprint and are never expanded into pairs; no limit is put on links. Other columns are not read."""
    slim = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    rows = cut(slim.mapInArrow(trimmed(_fingerprinted), T.StructType([slim.schema["id"], T.StructField("fp", T.LongType())])), "fingerprints")
    nodes = cut(rows.groupBy("fp").agg(F.min("id").alias("least")), "nodes")
    comps = connected_components(hamming_links(nodes, split=split))
    rooted = cut(nodes.join(comps, nodes["fp"] == comps["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root")), "rooted")
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    of_fp = skew_join(rooted.select("fp", "root"), least, ["root"]).select("fp", "component_id")
    return skew_join(rows, of_fp, ["fp"]).select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
