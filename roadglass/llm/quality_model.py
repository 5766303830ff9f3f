"""Quality classifier: ordinal cumulative-link regression on graded ratings.

A text is the set of its word parts (runs of letters and digits, runs of symbols), hashed into BUCKETS. One weight
vector is shared by all grades and ordered thresholds cut the score: P(grade <= j) = logistic(theta_j - w x). The
expected grade and the tail probability P(grade >= wanted) follow; a document is kept if the tail is large enough.

The fit reads at most `max_rows` labelled documents (those of the smallest hashes of their ids), so it is bounded on
the driver and the same on every run; scoring reads every document, whole, in Arrow batches on the executors, without
a shuffle.
"""

from __future__ import annotations

import re
from operator import eq
from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from .common import give_back, free_name

BUCKETS = 1 << 16
#: Grades: 0 toxic, 1 poor, 2 good.
GRADES = 3
MAX_ROWS = 10_000
_PARTS = re.compile(r"[0-9a-z\x80-\U0010ffff]+|[^\s0-9a-z\x80-\U0010ffff]+")
_known: dict[str, tuple[int, ...]] = {}


def _buckets(word: str) -> tuple[int, ...]:
    """The buckets of a word's parts; kept for later words of this process, within bounds."""
    if len(_known) > 200_000:
        _known.clear()
    found = _known[word] = tuple(xxhash.xxh32_intdigest(p, 7) % BUCKETS for p in _PARTS.findall(word.lower()))
    return found


def _seen(words: list[str]) -> set[int]:
    seen: set[int] = set()
    get = _known.get
    for word in set(words):
        seen.update(get(word) or _buckets(word))
    return seen


def features(text: str | None) -> np.ndarray:
    """Sorted distinct buckets of a text's word parts; none for null."""
    seen = _seen((text or "").split())
    return np.sort(np.fromiter(seen, np.int32, len(seen)))


def all_features(text: str | None) -> np.ndarray:
    """The buckets of the word parts and of two habits, in eighths: how often a word follows itself, and how many
    words are new. None for null and empty texts."""
    words = (text or "").split()
    seen = _seen(words)
    if words:
        again = sum(map(eq, words, words[1:]))
        seen.update(_buckets(f"again{8 * again // len(words)}"))
        seen.update(_buckets(f"fresh{8 * len(set(words)) // len(words)}"))
    return np.sort(np.fromiter(seen, np.int32, len(seen)))


@dataclass
class OrdinalModel:
    weights: np.ndarray
    thresholds: np.ndarray

    def tails(self, score: np.ndarray) -> np.ndarray:
        """P(grade > j) for each score and threshold j."""
        return 1 / (1 + np.exp(np.clip(self.thresholds[None, :] - score[:, None], -40, 40)))

    def scores(self, texts: Iterable[str | None]) -> np.ndarray:
        return np.array([self.weights[all_features(t)].sum() for t in texts], float)


def fit_ordinal(rows: list[np.ndarray], grades: np.ndarray, *, rounds: int = 300, l2: float = 8.0, rate: float = 0.05, min_rows: int = 5) -> OrdinalModel:
    """Maximum likelihood with an L2 penalty by Adam on the whole sample. Features of under `min_rows` rows keep weight zero."""
    if not len(rows) or len(np.unique(grades)) < 2:  # nothing to tell apart: everything has the top grade
        return OrdinalModel(np.zeros(BUCKETS), np.full(GRADES - 1, -30.0))
    sizes = np.array([len(r) for r in rows])
    flat = np.concatenate(rows)
    common = np.bincount(flat, minlength=BUCKETS) >= min_rows
    # only buckets of enough rows take part: entries by row, the same entries by bucket, each with where a run begins
    used = np.flatnonzero(common)
    column = np.zeros(BUCKETS, np.int32)
    column[used] = np.arange(len(used), dtype=np.int32)
    owner = np.repeat(np.arange(len(rows), dtype=np.int32), sizes)[common[flat]]
    flat = column[flat[common[flat]]]
    by_bucket = owner[np.argsort(flat, kind="stable")]
    starts = np.concatenate([[0], np.cumsum(np.bincount(flat, minlength=len(used)))[:-1]]).astype(np.int64)
    own, row_starts = np.unique(owner, return_index=True)
    n, width = len(rows), len(used)
    # thresholds: the first, then steps that are kept positive
    p = np.zeros(width + GRADES - 1)
    p[width] = -2.0
    m, v = np.zeros_like(p), np.zeros_like(p)
    logistic = lambda x: 1 / (1 + np.exp(-np.clip(x, -40, 40)))
    for k in range(1, rounds + 1):
        steps = np.exp(p[width + 1 :])
        theta = p[width] + np.concatenate([[0.0], np.cumsum(steps)])
        score = np.zeros(n)
        if width:
            score[own] = np.add.reduceat(p[:width].astype(np.float32)[flat], row_starts, dtype=np.float64)
        ends = np.concatenate([[-np.inf], theta, [np.inf]])
        high, low = ends[grades + 1] - score, ends[grades] - score
        ph, pl = np.where(np.isinf(high), 1.0, logistic(high)), np.where(np.isinf(low), 0.0, logistic(low))
        mass = np.maximum(ph - pl, 1e-9)
        dh, dl = np.where(np.isinf(high), 0, ph * (1 - ph)) / mass / n, np.where(np.isinf(low), 0, pl * (1 - pl)) / mass / n
        # of the negative log likelihood: by score it is dh - dl, by the upper end -dh, by the lower end dl
        by_end = np.bincount(grades, dl, GRADES + 1) - np.bincount(grades + 1, dh, GRADES + 1)
        by_theta = by_end[1:-1]
        g = np.zeros_like(p)
        if width:
            g[:width] = np.add.reduceat((dh - dl).astype(np.float32)[by_bucket], starts, dtype=np.float64) + l2 / n * p[:width]
        g[width] = by_theta.sum()
        g[width + 1 :] = np.cumsum(by_theta[::-1])[::-1][1:] * steps
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        p -= rate * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.999**k)) + 1e-8)
    weights = np.zeros(BUCKETS)
    weights[used] = p[:width]
    return OrdinalModel(weights, p[width] + np.concatenate([[0.0], np.cumsum(np.exp(p[width + 1 :]))]))


def graded(labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, grade): toxic rows have grade 0, poor ones 1, good ones 2; of several ratings of an id the least holds.
    Rows with a null id, quality or toxic mark are not rated."""
    grade = F.when(F.col("toxic") == 1, 0).when(F.col("quality") == 0, 1).otherwise(2)
    rated = labels.dropna(subset=[id_col, "quality", "toxic"])
    return rated.groupBy(F.col(id_col).alias("_rated")).agg(F.min(grade).alias("_grade"))


def train(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", max_rows: int = MAX_ROWS) -> OrdinalModel:
    """Fit on at most `max_rows` labelled documents: the rated ids of the smallest hashes, one row of each.

    The same rows are taken on every run, however the tables are dealt. Of rows that repeat an id the smallest text
    (by its hash) is read; a rated id without a document is not."""
    rated = graded(labels, id_col).withColumn("_h", F.xxhash64("_rated"))
    sample = rated.orderBy("_h", "_rated").limit(max_rows)
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"))
    rows = texts.join(F.broadcast(sample), texts["_id"] == sample["_rated"])  # at most max_rows small rows

    @F.pandas_udf("binary")
    def buckets(text: pd.Series) -> pd.Series:
        return text.map(lambda t: all_features(t).astype("<i4").tobytes())

    # the whole text is cut down to its buckets before anything moves; as bytes, so that the driver makes no object of each
    found = rows.select("_id", "_grade", "_h", F.xxhash64("_text").alias("_t"), buckets("_text").alias("_x"))
    one = found.groupBy("_id", "_h").agg(F.first("_grade").alias("_grade"), F.min_by("_x", "_t").alias("_x"))
    got = one.toArrow().sort_by([("_h", "ascending"), ("_id", "ascending")])
    model = fit_ordinal([np.frombuffer(x.as_buffer(), "<i4") for x in got["_x"]], got["_grade"].to_numpy().astype(np.int64))
    del got
    give_back()  # the driver goes on to other stages
    return model


def graded_by(model: OrdinalModel, text: Column, *, wanted: int = GRADES - 1) -> Column:
    """Struct of expected_grade and tail_prob, P(grade >= wanted), of a text; null is scored as the empty text."""

    @F.pandas_udf("expected_grade double, tail_prob double")
    def score(texts: pd.Series) -> pd.DataFrame:
        tails = model.tails(model.scores(texts))
        give_back()
        return pd.DataFrame({"expected_grade": tails.sum(1), "tail_prob": tails[:, wanted - 1]})

    return score(text.cast("string"))


def quality_grades(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_tail: float = 0.5, max_rows: int = MAX_ROWS) -> DataFrame:
    """One row for each input row: id, expected_grade, tail_prob (that the grade is good), kept.

    Null and empty texts have no features and get the intercept's grade. With no labelled rows, or one grade only,
    everything is kept. Null and repeated ids are rows like any other; an empty table gives an empty result."""
    model = train(docs, labels, id_col=id_col, text_col=text_col, max_rows=max_rows)
    scored = docs.select(F.col(id_col).alias("_id"), graded_by(model, F.col(text_col)).alias("_q"))
    return scored.select(F.col("_id").alias(id_col), "_q.expected_grade", "_q.tail_prob", (F.col("_q.tail_prob") >= min_tail).alias("kept"))


def keep_good(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_tail: float = 0.5, max_rows: int = MAX_ROWS) -> DataFrame:
    """The rows of `docs`, all columns, that the classifier keeps."""
    model = train(docs, labels, id_col=id_col, text_col=text_col, max_rows=max_rows)
    columns, mark = docs.columns, free_name(docs, "_quality")
    scored = docs.withColumn(mark, graded_by(model, F.col(f"`{text_col}`")))
    return scored.filter(F.col(f"{mark}.tail_prob") >= min_tail).select(*[F.col(f"`{c}`") for c in columns])
