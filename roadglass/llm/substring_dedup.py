"""Removal of every byte covered by a long string that also starts elsewhere, by suffix sorting.

To sort suffixes where they can match at all, each 200-byte window is assigned to an anchor: the least hash among the
48-byte grams inside it. Equal windows have equal anchors at the same place, and the windows of one anchor in a text
are consecutive, so a text falls into fragments: the bytes that one anchor's windows cover. Fragments meet by the hash
of their anchor's gram. Where all fragments of a gram are one and the same, every window of theirs is repeated. The
others are sorted: Spark deals the distinct fragments by gram, each task sorts the suffixes of its fragments in two
stages (those smaller than their successor directly, the rest induced by bucket scans), and neighbours with a common
prefix of 200 bytes are repeated. The result is whole: every window belongs to one anchor, and no group is cut.

No gram gathers in one task, however many texts have it: anchors are counted by gram with map-side combining, and the
counts meet the anchors in a join whose hot keys adaptive execution can split. A gram with more distinct fragments than
a task should sort has its windows counted one by one instead, by digest; the answer is the same.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, functions as F, types as T

from .common import cut, skew_join, whole_text
from .suffix_sort import common_prefixes, suffix_array, words_at

LENGTH = 200
GRAM = 48
#: Grams in a window.
SPAN = LENGTH - GRAM + 1
#: Bytes handled at once in a task.
CHUNK = 1 << 19
#: Distinct fragments of one gram that a task sorts; beyond, windows are counted.
SORTED = 4_000

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_BYTES = np.array([xxhash.xxh64_intdigest(bytes([b]), 11) for b in range(256)], np.uint64)
_power: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_power.get("up", ())) < n:
        size = max(n, CHUNK + (1 << 16))
        for name, factor in (("up", _BASE), ("down", _INVERSE)):
            p = np.full(size, factor, np.uint64)
            p[0] = 1
            _power[name] = np.multiply.accumulate(p)
    return _power["up"][:n], _power["down"][:n]


def gram_hashes(buffer: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the GRAM bytes at each position."""
    up, down = _powers(len(buffer))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTES[buffer] * up, dtype=np.uint64)])
    h = (sums[GRAM:] - sums[:-GRAM]) * down[: len(buffer) - GRAM + 1]
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    return h


def sliding_least(keys: np.ndarray, width: int) -> np.ndarray:
    """The least of each `width` neighbouring keys, by running minima within blocks from either side."""
    n = len(keys)
    blocks = np.concatenate([keys, np.full(-n % width, np.iinfo(np.uint64).max, np.uint64)]).reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[: n - width + 1], ahead[width - 1 : n])


def anchor_runs(buffer: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First and last window start and gram hash of every fragment of the texts that lie at `starts` in the buffer."""
    none = np.zeros(0, np.int64)
    if len(buffer) < LENGTH:
        return none, none, none.astype(np.uint64)
    h = gram_hashes(buffer)
    keys = (h & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(h), dtype=np.uint64)  # ties go to the leftmost
    least = sliding_least(keys, SPAN)
    edge = np.zeros(len(buffer) + 1, np.int64)
    long = sizes >= LENGTH
    np.add.at(edge, starts[long], 1)
    np.add.at(edge, starts[long] + sizes[long] - LENGTH + 1, -1)
    valid = np.cumsum(edge)[: len(least)] > 0
    fresh = np.ones(len(least), bool)
    fresh[1:] = least[1:] != least[:-1]
    fresh[starts[long]] = True
    fresh &= valid
    ended = valid.copy()
    ended[:-1] &= fresh[1:] | ~valid[1:]
    first, last = np.flatnonzero(fresh), np.flatnonzero(ended)
    return first, last, h[(least[first] & np.uint64(0xFFFFFFFF)).astype(np.int64)]


def _anchored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Fragments: id, text_hash, place (window start x 1024 + further windows), gram, digest of the bytes."""

    def fragments(pieces: list[tuple[int, int, bytes]], ids: pa.Array, hashes: np.ndarray) -> pa.RecordBatch:
        buffer = np.frombuffer(b"".join(p[2] for p in pieces), np.uint8)
        sizes = np.array([len(p[2]) for p in pieces])
        starts = np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64)
        first, last, gram = anchor_runs(buffer, starts, sizes)
        owner = np.searchsorted(starts, first, side="right") - 1
        view, digest = memoryview(buffer), xxhash.xxh3_64_intdigest
        digests = np.fromiter((digest(view[a:b]) for a, b in zip(first.tolist(), (last + LENGTH).tolist(), strict=True)), np.uint64, len(first))
        rows, base = np.array([p[0] for p in pieces])[owner], np.array([p[1] for p in pieces])[owner]
        place = (first - starts[owner] + base) * 1024 + (last - first)
        return pa.RecordBatch.from_arrays([ids.take(pa.array(rows)), pa.array(hashes[rows]), pa.array(place), pa.array(gram.view(np.int64)), pa.array(digests.view(np.int64))], ["id", "text_hash", "place", "gram", "digest"])

    for batch in batches:
        ids, hashes = batch.column(0), batch.column(1).to_numpy()
        pieces, size = [], 0
        for row, text in enumerate(batch.column(2)):
            data = (text.as_py() or "").encode()
            for at in range(0, max(len(data) - LENGTH + 1, 0), CHUNK):  # a piece holds CHUNK window starts at most
                piece = data[at : at + CHUNK + LENGTH - 1]
                pieces.append((row, at, piece))
                size += len(piece)
                if size >= CHUNK:
                    yield fragments(pieces, ids, hashes)
                    pieces, size = [], 0
        if pieces:
            yield fragments(pieces, ids, hashes)


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts compressed, so that joins by document move fewer bytes."""
    packer = zstandard.ZstdCompressor(level=3)
    for batch in batches:
        data = [packer.compress((t.as_py() or "").encode()) for t in batch.column(2)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(data, pa.binary())], ["id", "text_hash", "packed"])


def _fetched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes of the fragments that were asked for."""
    unpacker = zstandard.ZstdDecompressor()
    for batch in batches:
        gram, digest, times, data = [], [], [], []
        for packed, wanted in zip(batch.column(0), batch.column(1), strict=True):
            text = unpacker.decompress(packed.as_py())
            for w in wanted.as_py():
                start, more = divmod(w["place"], 1024)
                gram.append(w["gram"])
                digest.append(w["digest"])
                times.append(w["times"])
                data.append(text[start : start + more + LENGTH])
        yield pa.RecordBatch.from_arrays([pa.array(gram, pa.int64()), pa.array(digest, pa.int64()), pa.array(times, pa.int64()), pa.array(data, pa.binary())], ["gram", "digest", "times", "data"])


def repeated_windows(fragments: list[bytes], times: np.ndarray) -> list[list[int]]:
    """For each distinct fragment the runs of its windows that occur elsewhere, each as first x 1024 + last."""
    sizes = np.array([len(f) for f in fragments])
    text = np.frombuffer(b"".join(fragments), np.uint8)
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64)
    own = np.concatenate([np.arange(s, s + n - LENGTH + 1) for s, n in zip(starts, sizes, strict=True)])
    is_own = np.zeros(len(text), bool)
    is_own[own] = True
    order = suffix_array(text, LENGTH)
    order = order[is_own[order]]
    equal = common_prefixes(order, words_at(text), LENGTH) >= LENGTH
    again = np.zeros(len(text) + 1, bool)
    again[order[1:][equal]] = True
    again[order[:-1][equal]] = True
    out = []
    for s, n, t in zip(starts.tolist(), (sizes - LENGTH + 1).tolist(), times.tolist(), strict=True):
        if t > 1:
            out.append([n - 1])
            continue
        flags = np.concatenate([[0], again[s : s + n], [0]]).astype(np.int8)
        edges = np.flatnonzero(np.diff(flags))
        out.append((edges[::2] * 1024 + edges[1::2] - 1).tolist())
    return out


def _sorted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Verdicts on fragments that come sorted by gram; whole grams are sorted together, about CHUNK bytes at once."""

    def judged(rows: list[tuple]) -> pa.RecordBatch:
        runs = repeated_windows([r[3] for r in rows], np.array([r[2] for r in rows]))
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array(runs, pa.list_(pa.int32()))], ["gram", "digest", "runs"])

    rows, size = [], 0
    for batch in batches:
        for row in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
            if size >= CHUNK and row[0] != rows[-1][0]:
                yield judged(rows)
                rows, size = [], 0
            rows.append(row)
            size += len(row[3])
    if rows:
        yield judged(rows)


def _windowed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every window of the fragments of a crowded gram, by digest."""
    for batch in batches:
        for gram, digest, times, data in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
            n = len(data) - LENGTH + 1
            names = [hashlib.blake2b(data[i : i + LENGTH], digest_size=16).digest() for i in range(n)]
            yield pa.RecordBatch.from_arrays([pa.array([gram] * n, pa.int64()), pa.array([digest] * n, pa.int64()), pa.array([times] * n, pa.int64()), pa.array(range(n), pa.int32()), pa.array(names, pa.binary())], ["gram", "digest", "times", "nth", "window"])


def _cleared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts without their repeated spans; a span is start x 1024 + bytes."""
    unpacker = zstandard.ZstdDecompressor()
    for batch in batches:
        kept, counts = [], []
        for packed, spans in zip(batch.column(1), batch.column(2), strict=True):
            text = unpacker.decompress(packed.as_py())
            found = np.sort(np.asarray(spans.as_py() or [], np.int64))
            runs, at, parts, removed = 0, 0, [], 0
            end = 0
            for lo, size in zip((found >> 10).tolist(), (found & 1023).tolist(), strict=True):
                if lo > end or not runs:
                    parts.append(text[end:lo])
                    runs += 1
                    at = lo
                    end = max(end, lo)
                removed += max(0, lo + size - max(end, at))
                end = max(end, lo + size)
            parts.append(text[end:])
            kept.append(b"".join(parts))
            counts.append((len(text), removed, runs))
        found = np.array(counts, np.int64).reshape(-1, 3)
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(found[:, k]) for k in range(3)), pa.array(kept, pa.binary())], ["id", "n_bytes", "n_removed", "n_spans", "kept"])


def substring_dedup(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", sorted_at_most: int = SORTED) -> DataFrame:
    """One row for each input row: id, n_bytes, n_removed, n_spans, kept (the remaining bytes, joined).

    A byte goes if a 200-byte string that covers it also starts anywhere else in the table, overlaps and the same
    text included. Null text is empty; shorter texts lose nothing. Rows that repeat id and text are copies of each
    other. Null ids are rows like any other; an empty table gives an empty result. Other columns are not read."""
    text = whole_text(text_col).cast("string")
    slim = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("text_hash"), text.alias("text"))
    id_type = slim.schema["id"]
    key = ["id", "text_hash"]
    anchors = cut(slim.mapInArrow(_anchored, T.StructType([id_type, *(T.StructField(c, T.LongType()) for c in ("text_hash", "place", "gram", "digest"))])), "anchors")

    grams = anchors.groupBy("gram").agg(F.count(F.lit(1)).alias("n"), (F.min("digest") != F.max("digest")).alias("mixed")).filter("n > 1")
    found = cut(skew_join(anchors, grams.drop("n"), ["gram"]), "candidates")  # a row for each anchor at most

    # one text stands for each distinct fragment of a mixed gram and lends its bytes
    parts = found.filter("mixed").groupBy("gram", "digest").agg(F.count(F.lit(1)).alias("times"), F.min(F.struct(*key, "place")).alias("at"))
    parts = parts.select("gram", "digest", "times", "at.*")
    wanted = parts.groupBy(*key).agg(F.collect_list(F.struct("gram", "digest", "times", "place")).alias("wanted"))
    packed = slim.mapInArrow(_packed, T.StructType([id_type, T.StructField("text_hash", T.LongType()), T.StructField("packed", T.BinaryType())]))
    lent = packed.join(wanted.withColumnsRenamed({"id": "_i", "text_hash": "_t"}), F.col("id").eqNullSafe(F.col("_i")) & (F.col("text_hash") == F.col("_t")))
    fragments = cut(lent.select("packed", "wanted").mapInArrow(_fetched, "gram long, digest long, times long, data binary"), "fragments")

    crowded = cut(fragments.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > sorted_at_most).select("gram"), "crowded")
    sortable = fragments.join(crowded, "gram", "left_anti").repartition("gram").sortWithinPartitions("gram", "digest")
    runs = sortable.select("gram", "digest", "times", "data").mapInArrow(_sorted, "gram long, digest long, runs array<int>")
    if not crowded.isEmpty():
        windows = cut(fragments.join(crowded, "gram", "left_semi").select("gram", "digest", "times", "data").mapInArrow(_windowed, "gram long, digest long, times long, nth int, window binary"), "windows")
        again = windows.groupBy("window").agg(F.sum("times").alias("all")).filter(F.col("all") > 1).select("window")
        hits = skew_join(windows, again, ["window"]).groupBy("gram", "digest").agg(F.collect_list(F.col("nth") * 1024 + F.col("nth")).alias("runs"))
        runs = runs.unionByName(hits)
    verdicts = cut(runs, "verdicts")

    pure = found.filter("NOT mixed").select(*key, "place", F.array((F.col("place") % 1024).cast("int")).alias("runs"))
    mixed = skew_join(found.filter("mixed"), verdicts, ["gram", "digest"]).select(*key, "place", "runs")
    run = pure.unionByName(mixed).select(*key, F.floor(F.col("place") / 1024).alias("start"), F.explode("runs").alias("run"))
    first, last = F.floor(F.col("run") / 1024), F.col("run") % 1024
    span = (F.col("start") + first) * 1024 + (last - first + LENGTH)
    spans = run.groupBy(*key).agg(F.collect_set(span).alias("spans"))
    joined = packed.join(spans.withColumnsRenamed({"id": "_i", "text_hash": "_t"}), F.col("id").eqNullSafe(F.col("_i")) & (F.col("text_hash") == F.col("_t")), "left")
    out = T.StructType([id_type, *(T.StructField(c, T.LongType()) for c in ("n_bytes", "n_removed", "n_spans")), T.StructField("kept", T.BinaryType())])
    return joined.select("id", "packed", "spans").mapInArrow(_cleared, out).withColumnRenamed("id", id_col)
