"""Removal of words in passages that an earlier document holds, by matching statistics over FM-indexes.

Every document is streamed, by backward search, against compressed FM-indexes of the places where it can match at all.
Each window of WINDOW words is assigned to an anchor: the least hash among the GRAM-word grams inside it. Equal windows
have equal anchors at the same place, and the windows of one anchor in a text are consecutive, so a text falls into
fragments, and only fragments whose gram lies in two documents can hold a repeated window. Spark deals these by gram,
whole grams to one shard; a task indexes a shard of about CHUNK words, streams its fragments through the index and
reports each interval of at least WINDOW words with the least document among its suffixes.

A fragment that recurs, as in copies, is indexed once, with the least document that holds it; its verdict goes back to
all of them. A gram with more distinct fragments than a shard should hold falls into its windows, dealt by window.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, functions as F, types as T

from .common import cut, skew_join, whole_text
from .fm_index import FMIndex
from .substring_dedup import sliding_least

WINDOW = 13
GRAM = 4
#: Grams in a window; also the most windows of one fragment.
SPAN = WINDOW - GRAM + 1
#: Bytes handled at once in a task, about.
BLOCK = 1 << 20
#: Words of one index, about: a shard ends with the gram that reaches it.
CHUNK = 1 << 18
#: Distinct fragments of one gram in one shard; beyond, its windows are dealt one by one.
CROWDED = 10_000

_SPACE = regex.compile(rb"[\x20\x09-\x0D]")
_BYTES = np.array([xxhash.xxh64_intdigest(bytes([b]), 12) for b in range(256)], np.uint64)
_BYTES[32] = 0
_BASE = 0x9E3779B97F4A7C15


def _mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(32))
    h *= np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


def word_hashes(buffer: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each of the words that lie in the buffer with one space between."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    power = np.full(int((stops - starts).max()) + 1, _BASE, np.uint64)
    power[0] = 1
    power = np.multiply.accumulate(power)
    within = np.arange(len(buffer)) - np.repeat(starts, np.diff(starts, append=len(buffer)))
    return _mixed(np.add.reduceat(_BYTES[buffer] * power[within], starts))


def word_blocks(text: str | None, block: int = BLOCK) -> Iterator[tuple[int, list[bytes]]]:
    """(place of the first word, words) of blocks that share WINDOW - 1 words, so that each window lies in one."""
    data, at, place, carried = (text or "").encode(), 0, 0, []
    while at < len(data):
        space = _SPACE.search(data, at + block) if len(data) > at + block else None
        end = space.start() if space else len(data)
        words = carried + data[at:end].split()
        yield place, words
        carried = words[-(WINDOW - 1) :]
        place, at = place + len(words) - len(carried), end


def _anchored(batches: Iterator[pa.RecordBatch], digested: bool = True) -> Iterator[pa.RecordBatch]:
    """Fragments: id, text_hash, place (first word x 16 + further windows), gram, digest of the words (else 0)."""

    def fragments(pieces: list[tuple[int, int, list[bytes]]], ids: pa.Array, hashes: np.ndarray) -> pa.RecordBatch:
        data = b" ".join([b" ".join(p[2]) for p in pieces])
        buffer = np.frombuffer(data, np.uint8)
        spaces = np.flatnonzero(buffer == 32)
        starts, stops = np.concatenate([[0], spaces + 1]), np.append(spaces, len(buffer))
        h = word_hashes(buffer, starts, stops)
        gram = np.zeros(len(h) - GRAM + 1, np.uint64)
        for k in range(GRAM):
            gram = gram * np.uint64(_BASE) + h[k : len(h) - GRAM + 1 + k]
        gram = _mixed(gram)
        least = sliding_least((gram & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(gram), dtype=np.uint64), SPAN)  # ties go to the leftmost
        sizes = np.array([len(p[2]) for p in pieces])
        ends = np.cumsum(sizes)
        begins = ends - sizes
        valid = np.ones(len(least), bool)  # not over the border of two pieces
        for k in range(1, WINDOW):
            valid[ends[:-1] - k] = False
        fresh = np.ones(len(least), bool)
        fresh[1:] = least[1:] != least[:-1]
        fresh[begins] = True
        fresh &= valid
        last = valid.copy()
        last[:-1] &= fresh[1:] | ~valid[1:]
        first, last = np.flatnonzero(fresh), np.flatnonzero(last)
        owner = np.searchsorted(begins, first, side="right") - 1
        digests = np.zeros(len(first), np.uint64)
        if digested:
            view, digest = memoryview(data), xxhash.xxh3_64_intdigest
            digests[:] = [digest(view[a:b]) for a, b in zip(starts[first].tolist(), stops[last + WINDOW - 1].tolist(), strict=True)]
        rows, base = np.array([p[0] for p in pieces])[owner], np.array([p[1] for p in pieces])[owner]
        place = (first - begins[owner] + base) * 16 + (last - first)
        grams = gram[(least[first] & np.uint64(0xFFFFFFFF)).astype(np.int64)]
        return pa.RecordBatch.from_arrays([ids.take(pa.array(rows)), pa.array(hashes[rows]), pa.array(place), pa.array(grams.view(np.int64)), pa.array(digests.view(np.int64))], ["id", "text_hash", "place", "gram", "digest"])

    for batch in batches:
        ids, hashes = batch.column(0), batch.column(1).to_numpy()
        pieces, size = [], 0
        for row, text in enumerate(batch.column(2)):
            for place, words in word_blocks(text.as_py()):
                if len(words) >= WINDOW:
                    pieces.append((row, place, words))
                    size += len(words)
                if size >= BLOCK // 4:
                    yield fragments(pieces, ids, hashes)
                    pieces, size = [], 0
        if pieces:
            yield fragments(pieces, ids, hashes)


def _grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Anchors alone: id and gram."""
    for batch in _anchored(batches, digested=False):
        yield batch.select(["id", "gram"])


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The words of each text, one space between, compressed: joins by document move fewer bytes."""
    packer = zstandard.ZstdCompressor(level=3)
    for batch in batches:
        data = [packer.compress(b" ".join((t.as_py() or "").encode().split())) for t in batch.column(2)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(data, pa.binary())], ["id", "text_hash", "packed"])


def _bounds(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Where the words of a text with single spaces start and stop."""
    spaces = np.flatnonzero(np.frombuffer(text, np.uint8) == 32)
    return (np.concatenate([[0], spaces + 1]), np.append(spaces, len(text))) if text else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def _fetched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The words of the fragments that were asked for; rows that repeat lie side by side and lend theirs once."""
    unpacker, last = zstandard.ZstdDecompressor(), None
    for batch in batches:
        gram, digest, least, data = [], [], [], []
        for packed, wanted in zip(batch.column(0), batch.column(1), strict=True):
            packed, wanted = packed.as_py(), wanted.as_py()
            if (packed, wanted) == last:
                continue
            last = packed, wanted
            text = unpacker.decompress(packed)
            starts, stops = _bounds(text)
            for w in wanted:
                first, more = divmod(w["place"], 16)
                gram.append(w["gram"])
                digest.append(w["digest"])
                least.append(w["least"])
                data.append(text[starts[first] : stops[first + more + WINDOW - 1]])
        yield pa.RecordBatch.from_arrays([pa.array(gram, pa.int64()), pa.array(digest, pa.int64()), pa.array(least, pa.int64()), pa.array(data, pa.binary())], ["gram", "digest", "least", "data"])


def least_documents(fragments: pa.Array, documents: np.ndarray) -> pa.ListArray:
    """For each window of each fragment the least document that holds it: all fragments are indexed together, each is
    streamed through the index, and the intervals of whole windows tell."""
    words = pc.split_pattern(fragments, b" ")
    sizes = np.diff(words.offsets.to_numpy())
    names = words.flatten().dictionary_encode().indices.to_numpy() + 1
    stops = np.cumsum(sizes + 1) - 1
    text = np.zeros(int(stops[-1]) + 1, np.int64)
    text[np.delete(np.arange(len(text)), stops)] = names  # a 0 after each fragment
    index = FMIndex(text, WINDOW)
    length, low, _ = index.matching_statistics(text, stops - sizes, sizes)
    number, bounds = index.classes(WINDOW)
    owner = np.repeat(np.arange(len(sizes)), sizes + 1)
    least = np.minimum.reduceat(documents[owner[index.order]], bounds[:-1])
    reported = np.flatnonzero(length >= WINDOW)
    offsets = np.append(0, np.searchsorted(reported, stops)).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(least[number[low[reported]]]))


def _searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Verdicts on fragments that come sorted by key and digest; the fragments of a key are indexed together."""

    def judged(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(parts).combine_chunks()
        key, digest = table["key"].to_numpy(), table["digest"].to_numpy()
        fresh = np.ones(len(key), bool)  # a repeated row may have lent its words twice
        fresh[1:] = (key[1:] != key[:-1]) | (digest[1:] != digest[:-1])
        table = table.filter(pa.array(fresh)).combine_chunks()
        least = least_documents(table["data"].combine_chunks(), table["least"].to_numpy())
        return pa.RecordBatch.from_arrays([table["gram"].combine_chunks(), table["digest"].combine_chunks(), least], ["gram", "digest", "least"])

    held, size = [], 0
    for batch in batches:
        key = batch.column("key").to_numpy()
        edges = [0, *(np.flatnonzero(key[1:] != key[:-1]) + 1).tolist(), len(key)]
        weights = np.concatenate([[0], np.cumsum(pc.binary_length(batch.column("data")).to_numpy())])
        from_row = 0
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            if size + weights[a] - weights[from_row] >= 6 * CHUNK and (a > 0 or key[0] != held[-1].column("key")[-1].as_py()):
                if a > from_row:
                    held.append(batch.slice(from_row, a - from_row))
                yield judged(held)
                held, size, from_row = [], 0, a
        if len(key) > from_row:
            held.append(batch.slice(from_row))
            size += int(weights[-1] - weights[from_row])
    if held:
        yield judged(held)


def _windowed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The windows of the fragments of a crowded gram, with their digests."""
    for batch in batches:
        for gram, digest, least, data in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
            starts, stops = _bounds(data)
            found = [data[a:b] for a, b in zip(starts[: len(starts) - WINDOW + 1].tolist(), stops[WINDOW - 1 :].tolist(), strict=True)]
            n = len(found)
            names = np.fromiter(map(xxhash.xxh3_64_intdigest, found), np.uint64, n).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array([gram] * n, pa.int64()), pa.array([digest] * n, pa.int64()), pa.array(range(n), pa.int32()), pa.array(names), pa.array([least] * n, pa.int64()), pa.array(found, pa.binary())], ["gram", "digest", "nth", "window", "least", "data"])


def _cleared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts without the words of their marked windows; a mark is first word x 1024 + one bit a window."""
    unpacker = zstandard.ZstdDecompressor()
    for batch in batches:
        kept, counts = [], []
        for packed, marks in zip(batch.column(1), batch.column(2), strict=True):
            text = unpacker.decompress(packed.as_py())
            starts, stops = _bounds(text)
            found = np.asarray(marks.as_py() or [], np.int64)
            edge = np.zeros(len(starts) + 1, np.int64)
            for k in range(SPAN):
                first = (found[(found >> k) & 1 == 1] >> 10) + k
                np.add.at(edge, first, 1)
                np.add.at(edge, first + WINDOW, -1)
            stays = np.cumsum(edge)[:-1] == 0
            flips = np.flatnonzero(np.diff(stays.astype(np.int8), prepend=0, append=0))
            kept.append(b" ".join(text[starts[a] : stops[b - 1]] for a, b in zip(flips[::2].tolist(), flips[1::2].tolist(), strict=True)).decode())
            counts.append((len(starts), len(starts) - int(stays.sum())))
        found = np.array(counts, np.int64).reshape(-1, 2)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found[:, 0]), pa.array(found[:, 1]), pa.array(kept, pa.string())], ["id", "n_words", "n_removed", "kept"])


def passage_dedup(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", crowded: int = CROWDED) -> DataFrame:
    """One row for each input row: id, n_words, n_removed, kept (the remaining words, one space between).

    A word goes if a window of 13 words covers it whose words also start in a document with a smaller id; windows are
    judged on the input. Words are what ASCII white space parts, unchanged. Ids are whole numbers; a null id is smaller
    than any other, and rows that share an id are one document, each with its own text, so they do not take words from
    each other. Null text is empty; texts of under 13 words lose nothing; very long texts are read block by block. An
    empty table gives an empty result. Other columns, whatever their names, are not read."""
    text = whole_text(text_col).cast("string")
    slim = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("text_hash"), text.alias("text"))
    id_type = slim.schema["id"]
    if not isinstance(id_type.dataType, T.IntegralType):
        raise TypeError(f"{id_col} holds {id_type.dataType.simpleString()}; documents are ordered by whole numbers")
    rank: Column = F.coalesce(F.col("id").cast("long"), F.lit(-(1 << 63)))
    # anchors are worked out twice: cheaper than writing every one
    grams = slim.mapInArrow(_grams, T.StructType([id_type, T.StructField("gram", T.LongType())]))
    shared = grams.select("gram", rank.alias("rank")).groupBy("gram").agg(F.min("rank").alias("low"), F.max("rank").alias("high"))
    shared = cut(shared.filter("low < high").select(F.col("gram").alias("_gram")), "grams")
    anchors = slim.mapInArrow(_anchored, T.StructType([id_type, *(T.StructField(c, T.LongType()) for c in ("text_hash", "place", "gram", "digest"))]))
    found = cut(anchors.join(shared, anchors["gram"] == shared["_gram"]).drop("_gram"), "candidates")

    # the least document that holds a fragment lends its words
    parts = found.groupBy("gram", "digest").agg(F.min(F.struct(rank.alias("rank"), "id", "text_hash", "place")).alias("at"))
    parts = parts.select("gram", "digest", F.col("at.rank").alias("least"), F.col("at.id").alias("_i"), F.col("at.text_hash").alias("_t"), F.col("at.place").alias("place"))
    wanted = parts.groupBy("_i", "_t").agg(F.collect_list(F.struct("gram", "digest", "least", "place")).alias("wanted"))
    packed = slim.mapInArrow(_packed, T.StructType([id_type, T.StructField("text_hash", T.LongType()), T.StructField("packed", T.BinaryType())]))
    same = F.col("id").eqNullSafe(F.col("_i")) & (F.col("text_hash") == F.col("_t"))
    fragments = cut(packed.join(wanted, same).select("packed", "wanted").mapInArrow(_fetched, "gram long, digest long, least long, data binary"), "fragments")

    verdict = "gram long, digest long, least array<long>"
    many = cut(fragments.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > crowded).select("gram"), "crowded")
    dealt = fragments.join(many, "gram", "left_anti").select(F.col("gram").alias("key"), "gram", "digest", "least", "data")
    searched = dealt.repartition("key").sortWithinPartitions("key", "digest").mapInArrow(_searched, verdict)
    if not many.isEmpty():
        windows = cut(fragments.join(many, "gram", "left_semi").select("gram", "digest", "least", "data").mapInArrow(_windowed, "gram long, digest long, nth int, window long, least long, data binary"), "windows")
        single = windows.groupBy("gram", "window").agg(F.min("least").alias("least"), F.min("data").alias("data"))
        by_window = single.select(F.col("window").alias("key"), F.col("window").alias("gram"), F.col("gram").alias("digest"), "least", "data")
        told = cut(by_window.repartition("key").sortWithinPartitions("key", "digest").mapInArrow(_searched, verdict).select(F.col("digest").alias("gram"), F.col("gram").alias("window"), F.col("least")[0].alias("told")), "window-verdicts")
        per_window = skew_join(windows.drop("data", "least"), told, ["gram", "window"])
        regrouped = per_window.groupBy("gram", "digest").agg(F.sort_array(F.collect_set(F.struct("nth", "told"))).alias("told"))
        searched = searched.unionByName(regrouped.select("gram", "digest", F.col("told.told").alias("least")))
    verdicts = cut(searched, "verdicts")

    bits = F.aggregate(F.transform("least", lambda x, k: F.when(x < rank, F.call_function("shiftleft", F.lit(1).cast("long"), k)).otherwise(F.lit(0).cast("long"))), F.lit(0).cast("long"), lambda a, b: a + b)
    marks = skew_join(found, verdicts, ["gram", "digest"]).select("id", "text_hash", "place", bits.alias("bits")).filter("bits > 0")
    marks = marks.groupBy(F.col("id").alias("_i"), F.col("text_hash").alias("_t")).agg(F.collect_list(F.floor(F.col("place") / 16) * 1024 + F.col("bits")).alias("marks"))
    out = T.StructType([id_type, T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept", T.StringType())])
    return packed.join(marks, same, "left").select("id", "packed", "marks").mapInArrow(_cleared, out).withColumnRenamed("id", id_col)
