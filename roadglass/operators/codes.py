"""Nearest neighbours by cosine similarity over product-quantised codes, ranked exactly at the end.

A vector of unit length is cut into parts, and each part is named by the nearest of 256 centroids of that part: one byte.
The centroids (the books) are fitted on a bounded sample; every row is coded. A search looks the bytes up in the books and
takes the product with the queries, so a block of queries reads the codes and not the vectors. Each task keeps the best
of its rows for each query; the best of all are then ranked by their own vectors, which are read once for all blocks.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .similarity import BLOCK, unit

#: Rows that the books are fitted on, at most; the rows with the least hashes of their ids.
SAMPLE = 16_384
#: Queries that are multiplied with a batch of codes at once.
STEP = 256


def fit_books(sample: np.ndarray, parts: int, centroids: int = 256, steps: int = 15) -> list[np.ndarray]:
    """Centroids of each part of the columns by Lloyd's steps; the first are rows of the sample, spread evenly over it."""
    books = []
    for own in np.array_split(sample.astype(np.float32), min(parts, sample.shape[1]), axis=1):
        first = np.unique(own, axis=0)
        book = first[np.linspace(0, len(first) - 1, min(centroids, len(first))).astype(int)]
        for _ in range(steps if len(book) < len(first) else 0):
            near = _nearest(own, book)
            n = np.bincount(near, minlength=len(book))
            sums = np.stack([np.bincount(near, own[:, d], len(book)) for d in range(own.shape[1])], axis=1)
            book = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], book).astype(np.float32)
        books.append(book)
    return books


def _nearest(rows: np.ndarray, book: np.ndarray) -> np.ndarray:
    """The number of the centroid that is nearest to each row."""
    return ((book**2).sum(1) / 2 - rows @ book.T).argmin(1)


def encode(rows: np.ndarray, books: list[np.ndarray]) -> np.ndarray:
    """One byte for each part of each row."""
    cuts = np.cumsum([b.shape[1] for b in books])[:-1]
    return np.stack([_nearest(own, b).astype(np.uint8) for own, b in zip(np.split(rows.astype(np.float32), cuts, axis=1), books, strict=True)], axis=1)


def decode(codes: np.ndarray, books: list[np.ndarray]) -> np.ndarray:
    """The vectors that codes stand for."""
    return np.concatenate([b[codes[:, j]] for j, b in enumerate(books)], axis=1)


def _matrix(column: pa.Array) -> np.ndarray:
    """The vectors of a batch as rows; they must have one length."""
    widths = np.diff(column.offsets.to_numpy())
    if len(widths) and (widths != widths[0]).any():
        raise ValueError("vectors of different lengths")
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def write_codes(vectors: DataFrame, at: str, *, id_col: str, vec_col: str, parts: int = 16, sample: int = SAMPLE) -> None:
    """Code every vector into the folder `at`: `codes` (id, code) and `books` (part, level, centroid).

    A null vector has no code; one of zeros is coded like any other. Repeated ids are rows of their own."""
    spark = vectors.sparkSession
    v = vectors.filter(F.col(vec_col).isNotNull()).select(F.col(id_col).alias("id"), unit(F.col(vec_col)).alias("v"))
    drawn = v.orderBy(F.xxhash64("id"), "id").limit(sample).select("v").toArrow()["v"].combine_chunks()  # at most `sample` rows
    if isinstance(drawn, pa.ChunkedArray):
        drawn = pa.concat_arrays(drawn.chunks) if drawn.num_chunks else pa.array([], pa.list_(pa.float64()))
    books = fit_books(_matrix(drawn), parts) if len(drawn) else []
    levels = [(j, k, c.tolist()) for j, book in enumerate(books) for k, c in enumerate(book)]  # parts x 256 at most
    spark.createDataFrame(levels, "part int, level int, centroid array<float>").coalesce(1).write.mode("overwrite").parquet(f"{at}/books")

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                codes = encode(_matrix(b["v"]), books)
                yield pa.RecordBatch.from_arrays([b["id"], pa.array([c.tobytes() for c in codes], pa.binary())], ["id", "code"])

    out = v.mapInArrow(coded, f"id {v.schema['id'].dataType.simpleString()}, code binary")
    out.write.mode("overwrite").parquet(f"{at}/codes")


def read_books(spark: SparkSession, at: str) -> list[np.ndarray]:
    """The books of an index: at most 256 centroids a part."""
    rows = spark.read.parquet(f"{at}/books").orderBy("part", "level").collect()
    return [np.array([r["centroid"] for r in rows if r["part"] == j], np.float32) for j in range(max((r["part"] for r in rows), default=-1) + 1)]


def nearest_codes(codes: DataFrame, books: list[np.ndarray], ids: list, q: np.ndarray, keep: int) -> DataFrame:
    """(query_id, id, estimate): the `keep` rows of each task whose codes come closest to each query."""

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = np.full((len(q), 0), 0, np.float32)
        place = np.zeros((len(q), 0), np.int64)
        held = np.array([], object)
        for b in batches:
            if not b.num_rows:
                continue
            vectors = decode(np.frombuffer(b"".join(b["code"].to_pylist()), np.uint8).reshape(b.num_rows, -1), books)
            names = np.concatenate([held, np.array(b["id"].to_pylist(), object)])
            wide = min(keep, score.shape[1] + b.num_rows)
            s, p = np.empty((len(q), wide), np.float32), np.empty((len(q), wide), np.int64)
            for low in range(0, len(q), STEP):
                rows = slice(low, low + STEP)
                found = np.concatenate([score[rows], q[rows] @ vectors.T], axis=1)
                where = np.concatenate([place[rows], np.broadcast_to(np.arange(len(held), len(names)), (len(found), b.num_rows))], axis=1)
                top = np.argpartition(-found, wide - 1, axis=1)[:, :wide]
                s[rows], p[rows] = np.take_along_axis(found, top, 1), np.take_along_axis(where, top, 1)
            used, place = np.unique(p, return_inverse=True)  # names that no query holds any more go
            score, place, held = s, place.reshape(p.shape), names[used]
        for j, name in enumerate(ids if score.shape[1] else []):
            n = score.shape[1]
            yield pa.RecordBatch.from_arrays([pa.array([name] * n, id_type), pa.array(held[place[j]].tolist(), row_type), pa.array(score[j], pa.float32())], ["query_id", "id", "estimate"])

    kind = codes.schema["id"].dataType.simpleString()
    empty = codes.select("id").limit(0).toArrow().schema
    id_type = row_type = empty.field("id").type
    return codes.mapInArrow(best, f"query_id {kind}, id {kind}, estimate float")


def knn_codes(vectors: DataFrame, queries: DataFrame, at: str, *, id_col: str, vec_col: str, query_id: str, k: int = 3, keep: int = 64) -> DataFrame:
    """About the k most similar vectors of each query: (query_id, neighbour_id, similarity, rank), similarities exact.

    `at` is the index that `write_codes` made of `vectors`; ids of rows and queries have one type and tell them apart.
    A row is no neighbour of the query of its id. Per query the `keep` rows of the closest codes are compared by their
    vectors, which are shuffled once to the candidates; blocks of about BLOCK queries each read the codes only.
    A larger `keep` finds more; with all rows the result is the exact one. Null vectors neither ask nor answer."""
    spark = vectors.sparkSession
    books, codes = read_books(spark, at), spark.read.parquet(f"{at}/codes")
    asked = queries.filter(F.col(vec_col).isNotNull()).select(F.col(query_id).alias("query_id"), unit(F.col(vec_col)).alias("_q"))
    v = vectors.filter(F.col(vec_col).isNotNull()).select(F.col(id_col).alias("id"), unit(F.col(vec_col)).alias("_v"))
    blocks = max(1, -(-asked.count() // BLOCK))
    w = Window.partitionBy("query_id").orderBy(F.desc("estimate"), "id")
    found = []
    for b in range(blocks):
        own = asked.filter(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b).toArrow()  # about BLOCK rows
        q = np.concatenate([_matrix(c) for c in own["_q"].chunks if len(c)] or [np.zeros((0, 0))]).astype(np.float32)
        near = nearest_codes(codes, books, own["query_id"].to_pylist(), q, keep + 1).filter("query_id <> id")
        found.append(near.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= keep).select("query_id", "id"))
    pairs = reduce(DataFrame.unionByName, found)
    dot = F.aggregate(F.zip_with("_v", "_q", lambda p, x: p * x), F.lit(0.0), lambda s, x: s + x)
    exact = pairs.join(v, "id").join(asked, "query_id").select("query_id", F.col("id").alias("neighbour_id"), F.round(dot, 6).alias("similarity"))
    by = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "neighbour_id")
    return exact.withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= k)
