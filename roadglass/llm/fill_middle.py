"""Fill-in-middle transformation with piece tables.

A document becomes a table of descriptors (buffer, start, stop) over two buffers that never change: its text and the
sentinels. Cutting splits a descriptor, an arrangement permutes descriptors and puts sentinels between, and the inverse
permutation brings the text back. Texts and digests are made by walking the descriptors; nothing is copied before.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

#: The sentinels, and the order of the parts in each form.
SENTINELS = (b"<P>", b"<S>", b"<M>")
PREFIX, SUFFIX, MIDDLE = range(3)
ORDERS = {"psm": (PREFIX, SUFFIX, MIDDLE), "spm": (SUFFIX, PREFIX, MIDDLE)}
#: How the parts stand in the text itself.
NATURAL = (PREFIX, MIDDLE, SUFFIX)

TEXT, SENTINEL = 0, 1
_SENTINEL_BUFFER = b"".join(SENTINELS)
_SENTINEL_AT = [(SENTINEL, sum(map(len, SENTINELS[:k])), sum(map(len, SENTINELS[: k + 1]))) for k in range(3)]

_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True

Piece = tuple[int, int, int]


def token_ends(data: bytes) -> np.ndarray:
    """The byte after each token; a token is a run of ASCII white space, if any, with the word after it."""
    space = _IS_SPACE[np.frombuffer(data, np.uint8)]
    ends = ~space
    ends[:-1] &= space[1:]
    if len(space) and space[-1]:  # white space at the end is a token of its own
        ends[-1] = True
    return np.flatnonzero(ends) + 1


def split(pieces: list[Piece], at: int) -> list[Piece]:
    """The table with a border `at` so many bytes of its content; pieces may be empty."""
    out, before, cut = [], 0, False
    for buffer, start, stop in pieces:
        inside = start + at - before
        before += stop - start
        if cut or at > before:
            out.append((buffer, start, stop))
        else:
            out += [(buffer, start, inside), (buffer, inside, stop)]
            cut = True
    return out


def arranged(parts: list[Piece], form: str) -> list[Piece]:
    """The pieces of a form; `parts` are prefix, middle and suffix."""
    by_name = dict(zip(NATURAL, parts, strict=True))
    return [piece for name in ORDERS[form] for piece in (_SENTINEL_AT[name], by_name[name])]


def restored(output: bytes, form: str) -> list[Piece]:
    """The pieces of an output that give the text again: cut at the sentinels, put back in their natural order."""
    if form == "plain":
        return [(TEXT, 0, len(output))]
    pieces, place, cuts = [(TEXT, 0, len(output))], 0, []
    for name in ORDERS[form]:
        place = output.index(SENTINELS[name], place)
        cuts += [place, place + len(SENTINELS[name])]
        place = cuts[-1]
    for at in cuts:
        pieces = split(pieces, at)
    found = dict(zip(ORDERS[form], pieces[2::2], strict=True))
    return [found[name] for name in NATURAL]


def walked(pieces: list[Piece], text: bytes) -> Iterator[memoryview]:
    """The bytes that the pieces stand for, one after the other."""
    buffers = memoryview(text), memoryview(_SENTINEL_BUFFER)
    for buffer, start, stop in pieces:
        yield buffers[buffer][start:stop]


def streamed_sha256(pieces: list[Piece], text: bytes) -> str:
    """The digest of what the pieces stand for."""
    digest = hashlib.sha256()
    for part in walked(pieces, text):
        digest.update(part)
    return digest.hexdigest()


def fill_middle_pieces(data: bytes, doc_id: object, seed: str, rate: int, spm_rate: int) -> tuple[int, str, list[Piece]]:
    """(tokens, form, pieces) of one text."""
    ends = token_ends(data)
    n = len(ends)
    drawn = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(drawn[k : k + 8], 16) for k in (0, 8, 16, 24))
    if not data or any(s in data for s in SENTINELS) or h3 % 100 >= rate:
        return n, "plain", [(TEXT, 0, len(data))]
    edges = np.concatenate([np.zeros(1, np.int64), ends])
    pieces = [(TEXT, 0, len(data))]
    for at in sorted((h1 % (n + 1), h2 % (n + 1)), reverse=True):
        pieces = split(pieces, int(edges[at]))
    form = "spm" if h4 % 100 < spm_rate else "psm"
    return n, form, arranged(pieces, form)


def _chars(data: bytes, piece: Piece) -> int:
    return int(np.count_nonzero(np.frombuffer(data, np.uint8)[piece[1] : piece[2]] & 0xC0 != 0x80))


_MADE = "n long, form string, prefix_chars long, middle_chars long, pieces array<struct<buffer:int,start:long,stop:long>>, output string, output_sha256 string"


def fill_in_middle(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", seed: str = "42", rate: int = 50, spm_rate: int = 80) -> DataFrame:
    """One row for each input row: id, n (tokens), form, prefix_chars, middle_chars, pieces, output, output_sha256.

    A text is cut at two token borders drawn from its id; of 100 texts about `rate` are rearranged, of these about
    `spm_rate` to suffix, prefix, middle and the others to prefix, suffix, middle. A text that is empty or holds a
    sentinel stays plain. `pieces` are the descriptors in output order: buffer 0 is the text in UTF-8, buffer 1 the
    sentinels. Null text is empty. A null id draws as an empty one does; rows that share an id draw alike, each in its
    own text. Very long texts are cut like any other, one text in memory at a time besides its batch. An empty table
    gives an empty result. Other columns, whatever their names, are not read."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                data = (text.as_py() or "").encode()
                n, form, pieces = fill_middle_pieces(data, doc_id, seed, rate, spm_rate)
                chars = (None, None)
                if form != "plain":
                    parts = dict(zip(ORDERS[form], pieces[1::2], strict=True))
                    chars = _chars(data, parts[PREFIX]), _chars(data, parts[MIDDLE])
                rows.append((n, form, *chars, [dict(zip(("buffer", "start", "stop"), p, strict=True)) for p in pieces], b"".join(walked(pieces, data)).decode(), streamed_sha256(pieces, data)))
            columns = [pa.array(c, f) for c, f in zip(zip(*rows, strict=True), kinds, strict=True)] if rows else [pa.array([], f) for f in kinds]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["id", *names])

    kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.list_(pa.struct([("buffer", pa.int32()), ("start", pa.int64()), ("stop", pa.int64())])), pa.string(), pa.string()]
    names = T.StructType.fromDDL(_MADE).names
    slim = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return slim.mapInArrow(made, T.StructType([slim.schema["id"], *T.StructType.fromDDL(_MADE).fields])).withColumnRenamed("id", id_col)


def restore_middle(outputs: DataFrame, *, form_col: str = "form", output_col: str = "output") -> DataFrame:
    """`outputs` without its output column and with the text (`restored`) that output and form alone give again, and its
    digest. A null output counts as empty; form must be plain, psm or spm. Names that clash are refused by Spark."""

    def back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, digests = [], []
            for form, output in zip(batch.column(form_at).to_pylist(), batch.column(output_at), strict=True):
                data = (output.as_py() or "").encode()
                pieces = restored(data, form)
                texts.append(b"".join(walked(pieces, data)).decode())
                digests.append(streamed_sha256(pieces, data))
            rest = [batch.column(k) for k in range(batch.num_columns) if k != output_at]
            yield pa.RecordBatch.from_arrays([*rest, pa.array(texts, pa.string()), pa.array(digests, pa.string())], out.names)

    form_at, output_at = outputs.columns.index(form_col), outputs.columns.index(output_col)
    kept = [f for f in outputs.schema.fields if f.name != output_col]
    out = T.StructType([*kept, T.StructField("restored", T.StringType()), T.StructField("restored_sha256", T.StringType())])
    return outputs.mapInArrow(back, out)
