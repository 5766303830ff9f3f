"""How far the sources of a language diverge in their terms, counted exactly with length-bucketed packing.

A task finds the terms of many texts at once in one byte buffer and deals them by length. Up to eight bytes are one
uint64 word, up to sixteen are two; these buckets are sorted by radix, sixteen bits a pass and only as many passes as
the length has digits. Longer terms go to a byte-sorted bucket of their length. Terms enter in the order of group and
document and every sort is stable, so runs of equal terms tell occurrences and documents of each group. Spark adds the
runs up. Divergences are whole numbers: all shares are scaled to 10^9 and rounded down once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F, types as T

from .common import cut, skew_join

SCALE = 1_000_000_000
#: Bytes of text handled at once in a task, about; a longer text is handled alone.
BLOCK = 1 << 23
#: Kept terms whose divergences one task adds up at once, about.
TERMS = 4_096
#: Sources on each side of the pairs that one task adds up at once.
SIDE = 256

_IN_TERM = np.zeros(256, bool)
_IN_TERM[0x61:0x7B] = _IN_TERM[0x80:] = True


def term_spans(buffer: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and length of the terms in lower-cased bytes: runs of a-z and of bytes beyond ASCII."""
    inside = _IN_TERM[buffer].astype(np.int8)
    edges = np.flatnonzero(np.diff(inside, prepend=0, append=0))
    return edges[::2], edges[1::2] - edges[::2]


def radix_order(digits: list[np.ndarray]) -> np.ndarray:
    """A stable order by 16-bit digits, the least significant first; numpy sorts such digits by radix."""
    order = np.arange(len(digits[0]))
    for digit in digits:
        order = order[np.argsort(digit[order], kind="stable")]
    return order


def packed_words(data: bytes, starts: np.ndarray, size: int) -> list[np.ndarray]:
    """The terms of one length, up to sixteen bytes, as big-endian uint64 words, the last one first."""
    at_each = np.ndarray((len(data) - 7,), ">u8", data, strides=(1,))
    words = []
    for k in range((size - 1) // 8, -1, -1):
        unused = np.uint64(8 * max(0, 8 * (k + 1) - size))
        words.append((at_each[starts + 8 * k].astype(np.uint64) >> unused) << unused)
    return words


def _sorted_runs(data: bytes, buffer: np.ndarray, starts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(order, whether each term in that order differs from the one before) of terms of one length."""
    if size <= 16:
        words = packed_words(data, starts, size)
        digits = []
        for k, word in enumerate(words):
            bytes_used = min(8, size - 8 * (len(words) - 1 - k))
            digits += [(word >> np.uint64(s)).astype(np.uint16) for s in range(64 - 16 * -(-bytes_used // 2), 64, 16)]
        order = radix_order(digits)
        fresh = np.zeros(len(order), bool)
        for word in words:
            fresh[1:] |= word[order[1:]] != word[order[:-1]]
    else:
        terms = buffer[starts[:, None] + np.arange(size)].view(f"S{size}").ravel()
        order = np.argsort(terms, kind="stable")
        fresh = np.zeros(len(order), bool)
        fresh[1:] = terms[order[1:]] != terms[order[:-1]]
    fresh[:1] = True
    return order, fresh


def run_counts(texts: list[bytes], groups: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(first byte of the term, length, group, documents, occurrences as rows) bucket by bucket, with the buffer that
    the places refer to."""
    by_group = np.argsort(groups, kind="stable")
    data = b" ".join(texts[k] for k in by_group.tolist()).lower() + b" " * 16
    buffer = np.frombuffer(data, np.uint8)
    starts, sizes = term_spans(buffer)
    text_starts = np.cumsum([0] + [len(texts[k]) + 1 for k in by_group.tolist()])[:-1]
    owner = np.searchsorted(text_starts, starts, side="right") - 1
    by_size = np.argsort(np.minimum(sizes, 65_535).astype(np.uint16), kind="stable")
    lengths, first = np.unique(sizes[by_size], return_index=True) if len(sizes) and sizes.max() < 65_535 else (None, None)
    if lengths is None:  # a term of 64 KB or more: sort by the whole length
        by_size = np.argsort(sizes, kind="stable")
        lengths, first = np.unique(sizes[by_size], return_index=True)
    for size, which in zip(lengths.tolist(), np.split(by_size, first[1:]), strict=True):
        order, fresh_term = _sorted_runs(data, buffer, starts[which], size)
        which = which[order]
        group, doc = groups[by_group[owner[which]]], owner[which]
        fresh_group = fresh_term.copy()
        fresh_group[1:] |= group[1:] != group[:-1]
        fresh_doc = fresh_group.copy()
        fresh_doc[1:] |= doc[1:] != doc[:-1]
        runs = np.flatnonzero(fresh_group)
        at = starts[which[runs]]
        n = np.diff(runs, append=len(which))
        n_docs = np.add.reduceat(fresh_doc.astype(np.int64), runs)
        offsets = np.arange(len(at) + 1, dtype=np.int64) * size
        terms = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(at), [None, pa.py_buffer(offsets), pa.py_buffer(buffer[at[:, None] + np.arange(size)].tobytes())])
        yield terms, group[runs], n_docs, n


_COUNTS = "lang string, source string, term string, docs long, n long"


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial counts of (lang, source, term), a block of texts at a time."""

    def block(texts: list[bytes], langs: list[str], sources: list[str]) -> Iterator[pa.RecordBatch]:
        names: dict = {}
        groups = np.array([names.setdefault(g, len(names)) for g in zip(langs, sources, strict=True)], np.int64)
        lang, source = (pa.array([g[k] for g in names], pa.string()) for k in (0, 1))
        for terms, group, n_docs, n in run_counts(texts, groups):
            at = pa.array(group)
            yield pa.RecordBatch.from_arrays([lang.take(at), source.take(at), terms.cast(pa.binary()).cast(pa.string()), pa.array(n_docs), pa.array(n)], ["lang", "source", "term", "docs", "n"])

    held, size = ([], [], []), 0
    for batch in batches:
        for row in zip(*(batch.column(k).to_pylist() for k in (0, 1, 2)), strict=True):
            for kept, value in zip(held, row, strict=True):
                kept.append(value)
            size += len(row[0])
            if size >= BLOCK:
                yield from block(*held)
                held, size = ([], [], []), 0
    if held[0]:
        yield from block(*held)


def term_counts(docs: DataFrame, *, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """(lang, source, term, docs, n): documents of the group with the term, and occurrences. A term is a run of letters
    a-z (A-Z lower-cased) and code points beyond ASCII."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    slim = docs.select(text(text_col).cast("binary").alias("text"), text(lang_col).alias("lang"), text(source_col).alias("source"))
    return slim.mapInArrow(_counted, _COUNTS).groupBy("lang", "source", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("n"))


def _share(n: str, total: str) -> str:
    """SQL of 1 + floor(10^9 (n + 1) / total) as a long division by thousands: no product leaves 63 bits."""
    rest, digits = f"({n} + 1)", []
    for _ in range(3):
        digits.append(f"(({rest} * 1000L) div {total})")
        rest = f"(({rest} * 1000L) % {total})"
    return f"(1 + {digits[0]} * 1000000L + {digits[1]} * 1000L + {digits[2]})"


def shares(n: np.ndarray, total: np.ndarray) -> np.ndarray:
    """The same in numpy."""
    out, rest = np.zeros(np.broadcast(n, total).shape, np.int64), n + 1
    for _ in range(3):
        rest = rest * 1000
        digit = rest // total
        rest = rest - digit * total
        out = out * 1000 + digit
    return out + 1


def _paired(key: tuple, rows: pa.Table) -> pa.Table:
    """The sums of one block of terms for all pairs of a source of side `a` and one of side `b`. Rows without a term tell
    which sources there are, with the total of each. Terms that none of them has add the same each; the first block adds
    that for all terms, and every block takes back what its own terms would have added."""
    lang, a, b, block = (k.as_py() for k in key)
    is_source = rows["term"].is_null().combine_chunks().to_numpy(zero_copy_only=False)
    told, counts = rows.filter(pa.array(is_source)), rows.filter(pa.array(~is_source))
    sources = {s: k for k, s in enumerate(told["source"].to_pylist())}
    total, side = told["total"].to_numpy(), told["side"].to_numpy()
    term = counts["term"].combine_chunks().dictionary_encode()
    n = np.zeros((len(term.dictionary), len(sources)), np.int64)
    n[term.indices.to_numpy(), [sources[s] for s in counts["source"].to_pylist()]] = counts["n"].to_numpy()
    p, none = (shares(x, np.maximum(total, 1)) for x in (n, np.zeros(len(sources), np.int64)))
    absent = (told["v"].to_numpy()[0] if block == 0 else 0) - len(n)
    names, out = list(sources), ([], [], [], [])
    theirs = np.flatnonzero(side == b)
    for k in np.flatnonzero(side == a).tolist():
        gap = p[:, [k]] - p[:, theirs]
        base = (none[k] - none[theirs]) ** 2 // none[theirs]
        sums = (gap * gap // p[:, theirs]).sum(axis=0) + absent * base
        for other, value in zip(theirs.tolist(), sums.tolist(), strict=True):
            if other != k:
                for column, x in zip(out, (lang, names[k], names[other], value), strict=True):
                    column.append(x)
    return pa.table({"lang": pa.array(out[0], pa.string()), "source": pa.array(out[1], pa.string()), "item": pa.array(out[2], pa.string()), "value": pa.array(out[3], pa.int64())})


def source_divergence(docs: DataFrame, *, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", min_docs: int = 3, top: int = 200) -> DataFrame:
    """(lang, source, part, item, value, rank): part `pair` tells how far a source's term shares lie from those of each
    other source of the language, part `term` which terms a source has more of than its language, `top` at most.

    Terms in at least `min_docs` rows of the language count. A share is p = 1 + floor(10^9 (n + 1) / (N + V)), N
    occurrences of all V terms; a term's part in the divergence of p from q is floor((p - q)^2 / q). Null text, language
    and source are empty ones. Rows that repeat are documents each; texts and terms may be of any length. A language
    without terms has pairs of value 0. Equal values are ranked by the item's bytes. Totals may reach 9 * 10^15. An empty
    table gives an empty result. Other columns, whatever their names, are not read."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    counts = cut(term_counts(docs, text_col=text_col, lang_col=lang_col, source_col=source_col), "counts")
    in_lang = counts.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("lang_n"))
    kept = cut(skew_join(counts.drop("docs"), in_lang.filter(F.col("docs") >= min_docs).drop("docs"), ["lang", "term"]), "kept")

    groups = docs.select(text(lang_col).alias("lang"), text(source_col).alias("source")).distinct()
    sums = kept.groupBy("lang", "source").agg(F.sum("n").alias("n"))
    langs = kept.groupBy("lang", "term").agg(F.first("lang_n").alias("n")).groupBy("lang").agg(F.count(F.lit(1)).alias("v"), F.sum("n").alias("lang_total"))
    groups = groups.join(sums, ["lang", "source"], "left").join(langs, "lang", "left").na.fill(0, ["n", "v", "lang_total"])
    numbered = Window.partitionBy("lang").orderBy("source")
    groups = groups.select("lang", "source", (F.col("n") + F.col("v")).alias("total"), (F.col("lang_total") + F.col("v")).alias("lang_total"), "v", F.floor((F.row_number().over(numbered) - 1) / SIDE).alias("side"), F.greatest(F.ceil(F.col("v") / TERMS), F.lit(1)).alias("blocks"))
    groups = groups.withColumn("sides", F.max("side").over(Window.partitionBy("lang")) + 1)
    groups = cut(groups, "groups")  # one row a source; how it joins is left to its size

    told = kept.join(groups, ["lang", "source"])
    p, q = _share("n", "total"), _share("lang_n", "lang_total")
    over = told.select("lang", "source", F.col("term").alias("item"), F.expr(p).alias("p"), F.expr(q).alias("q")).filter("p > q")
    over = over.select("lang", "source", F.lit("term").alias("part"), "item", F.expr("((p - q) * (p - q)) div q").alias("value"))
    best = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    terms = over.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= top)

    # every block of terms meets the sources of two sides
    side = ["lang", "source", "total", "v", "side"]
    every = groups.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))).select(*side, "sides", "block", F.lit(None).cast("string").alias("term"), F.lit(0).cast("long").alias("n"))
    rows = told.select(*side, "sides", F.pmod(F.xxhash64("term"), F.col("blocks")).alias("block"), "term", "n").unionByName(every)
    others = F.explode(F.sequence(F.lit(0).cast("long"), F.col("sides") - 1))
    as_a = rows.withColumn("b", others).withColumn("a", F.col("side"))
    as_b = rows.withColumn("a", others).withColumn("b", F.col("side")).filter("a <> b")
    dealt = as_a.unionByName(as_b).select("lang", "a", "b", "block", "source", "total", "v", "side", "term", "n")
    summed = dealt.groupBy("lang", "a", "b", "block").applyInArrow(_paired, "lang string, source string, item string, value long")
    pairs = summed.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value", F.row_number().over(best).alias("rank"))
    return pairs.unionByName(terms)
