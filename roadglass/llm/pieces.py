"""SentencePiece encoding and decoding by batched numpy Viterbi.

A text is escaped as the model does and cut where no piece can reach across. Distinct units of equal length advance
together: at each position the hashes of the substrings that end there probe the sorted piece keys, every match is
scored, and vectorised maxima store the backpointers.

For a unigram model the score is the sum of piece scores. For a merge (BPE) model a path is right exactly if every
two neighbours are what merging their joint text would leave, so the score of a step is the piece's length if it
agrees with the last piece of the prefix it continues, and minus infinity if not; agreement of two pieces is found by
merging their text once and then looked up. Ids are those of the sentencepiece library.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame, functions as F, types as T
from sentencepiece import sentencepiece_model_pb2 as model_pb2

from .common import trimmed

SPACE = "▁"
#: Characters of the units that advance together, at most.
TOGETHER = 1 << 20
#: A unit of more characters than this is walked alone, character by character, with the same steps in little memory.
LONG = 1 << 16
#: Units whose ids a worker keeps, but for those of the texts at hand.
KNOWN = 400_000
_FACTOR = np.uint64(0x9E3779B97F4A7C15)
#: Characters outside the pieces are numbered from here on, by code point.
UNKNOWN = 1 << 21


class Pieces:
    """A loaded model with what encoding needs; built once in each Python worker."""

    def __init__(self, model: bytes):
        spec = model_pb2.ModelProto.FromString(model)
        kinds = {spec.trainer_spec.UNIGRAM: False, spec.trainer_spec.BPE: True}
        if spec.trainer_spec.model_type not in kinds:
            raise ValueError("only unigram and merge (BPE) models are encoded")
        rules = spec.normalizer_spec
        if rules.precompiled_charsmap or rules.remove_extra_whitespaces or not rules.escape_whitespaces:
            raise ValueError(f"the model rewrites its input ({rules.name}); only models that keep it are encoded")
        if spec.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError("models that put the space mark at a word's end are not encoded")
        #: Merge models score pieces by rank, unigram models by log probability.
        self.merges = kinds[spec.trainer_spec.model_type]
        self.dummy = rules.add_dummy_prefix
        m = sentencepiece.SentencePieceProcessor(model_proto=model)
        n = m.get_piece_size()
        self.text = [m.id_to_piece(i) for i in range(n)]
        self.bytes_at = {int(self.text[i][3:5], 16): i for i in range(n) if m.is_byte(i)}
        self.normal = {self.text[i]: i for i in range(n) if not (m.is_byte(i) or m.is_control(i) or m.is_unknown(i) or m.is_unused(i))}
        self.score = np.array([m.get_score(i) for i in range(n)])
        self.unknown = m.unk_id()
        self.longest = max(map(len, self.normal))
        self.inner = any(SPACE in p.lstrip(SPACE) for p in self.normal)
        self._index()
        self.raw = {i: bytes([b]) for b, i in self.bytes_at.items()}
        out = [self.raw.get(i, t.replace(SPACE, " ").encode() if self.normal.get(t) == i else b"") for i, t in enumerate(self.text)]
        #: The pieces' bytes end to end, with where each begins and how long it is.
        self.bytes_of = np.frombuffer(b"".join(out), np.uint8)
        self.n_bytes = np.array([len(b) for b in out])
        self.begins = np.cumsum(self.n_bytes) - self.n_bytes
        self.agree, self.new = (np.zeros(1, np.int64), np.zeros(1, bool)), {}
        #: Units met before, with their ids as the bytes of 32-bit numbers.
        self.cache: dict[str, bytes] = {}

    def _index(self) -> None:
        """Sorted hash keys of all pieces and their beginnings; each knows its piece, the entry it extends and its
        last character, so that a match can be told from a collision."""
        begun = sorted({p[:k] for p in self.normal for k in range(1, len(p) + 1)})
        by_size: dict[int, list[str]] = {}
        for p in begun:
            by_size.setdefault(len(p), []).append(p)
        hashes = {"": np.uint64(0)}
        for size in sorted(by_size):
            own = by_size[size]
            h = self._extend(np.array([hashes[p[:-1]] for p in own], np.uint64), np.array([ord(p[-1]) for p in own], np.uint64))
            hashes.update(zip(own, h, strict=True))
        keys = np.array([hashes[p] for p in begun], np.uint64)
        order = np.argsort(keys, kind="stable")
        begun = [begun[k] for k in order]
        at = {p: k for k, p in enumerate(begun)} | {"": -1}
        self.keys = keys[order]
        self.piece_of = np.array([self.normal.get(p, -1) for p in begun])
        self.extends = np.array([at[p[:-1]] for p in begun])
        self.ends_in = np.array([ord(p[-1]) for p in begun], np.uint64)

    @staticmethod
    def _extend(h: np.ndarray, chars: np.ndarray) -> np.ndarray:
        h = (h ^ chars) * _FACTOR
        return h ^ (h >> np.uint64(29))

    def name(self, k: int) -> str:
        return chr(k - UNKNOWN) if k >= UNKNOWN else self.text[k]

    def merged(self, text: str) -> list[int]:
        """Merge the best-scoring neighbours, leftmost first, until nothing merges."""
        parts = list(text)
        while len(parts) > 1:
            best, at = -np.inf, -1
            for k in range(len(parts) - 1):
                i = self.normal.get(parts[k] + parts[k + 1])
                if i is not None and self.score[i] > best:
                    best, at = self.score[i], k
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.normal.get(p, UNKNOWN + ord(p[0])) for p in parts]

    def fits(self, last: int, piece: int) -> bool:
        """Whether merging leaves these two neighbours alone; last is -1 at the start of a unit."""
        b = self.name(piece)
        a = "" if last < 0 else self.name(last)
        parts, edge, get, score = list(a + b), len(a), self.normal.get, self.score
        while len(parts) > 1:
            best, at = -np.inf, -1
            for k in range(len(parts) - 1):
                i = get(parts[k] + parts[k + 1])
                if i is not None and score[i] > best:
                    best, at = score[i], k
            if at < 0:
                break
            if at + 1 == edge:  # a merge across the two
                return False
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            edge -= at < edge
        return parts == ([a, b] if a else [b])

    def _agreed(self, last: np.ndarray, piece: np.ndarray) -> np.ndarray:
        """`fits` for arrays: looked up among the pairs met before, found out for the others."""
        pairs = (last + 1) << 32 | piece
        keys, good = self.agree
        at = np.minimum(np.searchsorted(keys, pairs), len(keys) - 1)
        out, unseen = good[at], np.flatnonzero(keys[at] != pairs)
        if len(unseen):
            fresh, place = np.unique(pairs[unseen], return_inverse=True)
            new = self.new
            for k in fresh.tolist():
                if k not in new:
                    new[k] = self.fits((k >> 32) - 1, k & 0xFFFFFFFF)
            out[unseen] = np.fromiter(map(new.__getitem__, fresh.tolist()), bool, len(fresh))[place]
            if len(new) > 100_000:
                self._settle()
        return out

    def _settle(self) -> None:
        """Move new pairs to the sorted ones; start over beyond four million."""
        old, good = self.agree
        keys = np.fromiter(self.new, np.int64, len(self.new))
        values = np.fromiter(self.new.values(), bool, len(self.new))
        self.new = {}
        if len(old) + len(keys) < 4_000_000:
            keys, values = np.concatenate([old, keys]), np.concatenate([good, values])
        order = np.argsort(keys, kind="stable")
        self.agree = keys[order], values[order]

    def matches(self, chars: np.ndarray) -> tuple[np.ndarray, ...]:
        """(end, row, width, piece) of every piece found in the rows of `chars`, sorted by end."""
        n, size = chars.shape
        row, start = np.repeat(np.arange(n), size), np.tile(np.arange(size), n)
        h, entry = np.zeros(n * size, np.uint64), np.full(n * size, -1)
        found = []
        for width in range(1, min(size, self.longest) + 1):
            c = chars[row, start + width - 1]
            h = self._extend(h, c)
            at = np.minimum(np.searchsorted(self.keys, h), len(self.keys) - 1)
            hit = (self.keys[at] == h) & (self.extends[at] == entry) & (self.ends_in[at] == c)
            piece = np.where(hit, self.piece_of[at], -1)
            if width == 1:
                piece = np.where(piece >= 0, piece, c.astype(np.int64) + UNKNOWN)
            on = np.flatnonzero(piece >= 0)
            found.append((start[on] + width, row[on], np.full(len(on), width), piece[on]))
            go = np.flatnonzero(hit & (start + width < size))
            row, start, h, entry = row[go], start[go], h[go], at[go]
        end, row, width, piece = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.argsort(end.astype(np.int16 if size < 1 << 15 else np.int32), kind="stable")
        return end[order], row[order], width[order], piece[order]

    def viterbi(self, units: list[str]) -> list[bytes]:
        """Ids of units that all have the same length, as the bytes of 32-bit numbers."""
        n, size = len(units), len(units[0])
        chars = np.frombuffer("".join(units).encode("utf-32-le"), np.uint32).reshape(n, size).astype(np.uint64)
        end, row, width, piece = self.matches(chars)
        bounds = np.searchsorted(end, np.arange(1, size + 2))
        best, last, back = np.full((size + 1, n), -np.inf), np.full((size + 1, n), -1, np.int64), np.zeros((size + 1, n), np.int64)
        best[0] = 0.0
        for e in range(1, size + 1):
            part = slice(bounds[e - 1], bounds[e])
            r, w, p = row[part], width[part], piece[part]
            before = best[e - w, r]
            if self.merges:
                score = np.where((before > -np.inf) & self._agreed(last[e - w, r], p), before + w, -np.inf)
            else:
                score = before + np.where(p >= UNKNOWN, self.score.min() - 10, self.score[np.minimum(p, len(self.score) - 1)])
            # the best score of each row: rows in order of score, so that the last assignment is the maximum
            order = np.argsort(score, kind="stable")
            order = order[score[order] > -np.inf]
            r, w, p = r[order], w[order], p[order]
            best[e, r], last[e, r], back[e, r] = score[order], p, w
        steps, at, rows = [], np.full(n, size), np.arange(n)
        lost = best[size] == -np.inf
        at[lost] = 0
        while at.any():
            steps.append(np.where(at > 0, last[at, rows], -1))
            at = at - np.where(at > 0, back[at, rows], 0)
        path = np.array(steps[::-1]).T if steps else np.full((n, 0), -1)
        there = path >= 0
        data, ends = path[there].astype(np.int32).tobytes(), (4 * np.cumsum(there.sum(1))).tolist()
        out = [data[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]
        for k in np.flatnonzero((path >= UNKNOWN).any(1)).tolist():
            out[k] = self.spelled(path[k][there[k]].tolist())
        for k in np.flatnonzero(lost).tolist():  # no path of agreeing neighbours: merge the unit itself
            out[k] = self.spelled(self.merged(units[k]))
        return out

    def alone(self, unit: str) -> bytes:
        """The same walk for one long unit."""
        size, get = len(unit), self.normal.get
        best, last, back = [0.0] + [-np.inf] * size, [-1] * (size + 1), [0] * (size + 1)
        low = float(self.score.min()) - 10
        known = self.new

        def agreed(a: int, b: int) -> bool:
            key = (a + 1) << 32 | b
            if key not in known:
                known[key] = self.fits(a, b)
            return known[key]

        for end in range(1, size + 1):
            for width in range(1, min(end, self.longest) + 1):
                piece = get(unit[end - width : end], UNKNOWN + ord(unit[end - 1]) if width == 1 else -1)
                before = best[end - width]
                if piece < 0 or before == -np.inf:
                    continue
                score = (1.0 if agreed(last[end - width], piece) else -np.inf) if self.merges else before + (low if piece >= UNKNOWN else float(self.score[piece]))
                if score > best[end]:
                    best[end], last[end], back[end] = score, piece, width
        if best[size] == -np.inf:
            return self.spelled(self.merged(unit))
        ids, end = [], size
        while end:
            ids.append(last[end])
            end -= back[end]
        return self.spelled(ids[::-1])

    def spelled(self, ids: list[int]) -> bytes:
        """Characters outside the pieces become their bytes' ids, or the unknown id if the model has no bytes."""
        out: list[int] = []
        for i in ids:
            if i < UNKNOWN:
                out.append(i)
            elif self.bytes_at:
                out += [self.bytes_at[b] for b in chr(i - UNKNOWN).encode()]
            else:
                out.append(self.unknown)
        return np.array(out, np.int32).tobytes()

    def units(self, text: str) -> list[str]:
        if not text:
            return []
        escaped = (SPACE if self.dummy else "") + text.replace(" ", SPACE)
        return [escaped] if self.inner else re.findall(f"{SPACE}*[^{SPACE}]+|{SPACE}+", escaped)

    def learn(self, units: set[str]) -> None:
        """Encode units that are not known yet, batch by equal length."""
        by_size: dict[int, list[str]] = {}
        for u in units:
            by_size.setdefault(len(u), []).append(u)
        for size, own in by_size.items():
            own.sort()
            some = max(1, min(20_000, TOGETHER // size))
            for k in range(0, len(own), some):
                part = own[k : k + some]
                self.cache.update(zip(part, map(self.alone, part) if size > LONG else self.viterbi(part), strict=True))

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        cut = [self.units(t) for t in texts]
        every = set().union(*cut)
        missing = every.difference(self.cache)
        if missing:
            if len(self.cache) + len(missing) > KNOWN:  # what these texts use stays
                self.cache = {u: self.cache[u] for u in every if u in self.cache}
            self.learn(missing)
        get = self.cache.__getitem__
        return [np.frombuffer(b"".join(map(get, own)), np.int32) for own in cut]

    def decode(self, ids: np.ndarray) -> str:
        sizes = self.n_bytes[ids]
        ends = np.cumsum(sizes)
        at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.begins[ids] - (ends - sizes), sizes)
        text = self.bytes_of[at].tobytes().decode(errors="replace")
        return text[1:] if self.dummy and text.startswith(" ") else text


_loaded: dict[bytes, Pieces] = {}


def _pieces(model: bytes) -> Pieces:
    if model not in _loaded:
        _loaded.clear()
        _loaded[model] = Pieces(model)
    return _loaded[model]


def _groups(texts: list[str], chars: int = 2_000_000) -> Iterator[list[str]]:
    own, size = [], 0
    for t in texts:
        own.append(t)
        size += len(t)
        if size > chars:
            yield own
            own, size = [], 0
    if own:
        yield own


def _encoder(model: bytes) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = _pieces(model)
        for batch in batches:
            at = 0
            for texts in _groups([t or "" for t in batch.column(1).to_pylist()]):
                ids = pieces.encode(texts)
                same = [pieces.decode(i) == t for i, t in zip(ids, texts, strict=True)]
                offsets = np.concatenate([[0], np.cumsum([len(i) for i in ids])]).astype(np.int32)
                values = np.concatenate(ids) if ids else np.empty(0, np.int32)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(texts)), pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, pa.int32())), pa.array(same)], ["id", "ids", "round_trip"])
                at += len(texts)

    return run


def read_model(path: str) -> bytes:
    """The model file's bytes, read on the driver and sent with the tasks; models are small, larger files are refused."""
    with open(path, "rb") as f:
        model = f.read((16 << 20) + 1)
    if len(model) > 16 << 20:
        raise ValueError("a model file of over 16 MB")
    return model


def encode_pieces(docs: DataFrame, model_path: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each input row: id, ids (array of int), n_ids, round_trip (decoding gives the text back).

    Null and empty texts have no ids. The one text that does not come back is one that holds the model's own space
    mark U+2581, which the model reads as a space. Null and repeated ids are rows like any other; an empty table gives
    an empty result. Other columns of `docs` are not read."""
    slim = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    schema = T.StructType([slim.schema["id"], T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("round_trip", T.BooleanType())])
    coded = slim.mapInArrow(trimmed(_encoder(read_model(model_path))), schema)
    return coded.select(F.col("id").alias(id_col), "ids", F.size("ids").cast("long").alias("n_ids"), "round_trip")


def decode_pieces(coded: DataFrame, model_path: str, *, ids_col: str = "ids", text_col: str = "text") -> DataFrame:
    """`coded` with the decoded text as a further column; null ids give null."""
    model = read_model(model_path)

    @F.pandas_udf("string")
    def decode(ids: pd.Series) -> pd.Series:
        pieces = _pieces(model)
        return ids.map(lambda x: None if x is None else pieces.decode(np.asarray(x, np.int32)))

    return coded.withColumn(text_col, decode(ids_col))
