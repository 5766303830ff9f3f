"""Quality rules judged by host.

Each document gets counts from its whole text and fails or passes some rules. Failures are added up by host, each
host's failure rate is shrunk towards the fleet of hosts by a beta prior fitted to all hosts' documents, and the verdict on
the host is joined back to its documents. The verdict is how strictly the host's failing documents are judged: the more
its shrunk rate is over the prior's mean, the less a document may be over a rule. A document stays if it passes the base
rules, its host is not rejected as a whole and it is not over the rules by its host's measure.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import cut, skew_join

#: What counts as white space and as a symbol.
SPACE = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")


def repeat_words(words: list) -> int:
    """Words that lie in a window of three words found at least twice in the list."""
    if len(words) < 4:
        return 0
    names: dict = {}
    ids = np.fromiter((names.setdefault(w, len(names)) for w in words), np.int64, len(words))
    first = ids[:-2] * len(names) + ids[1:-1]
    if len(names) >= 1 << 20:  # three names no longer fit in 63 bits
        first = np.unique(first, return_inverse=True)[1]
    windows = first * len(names) + ids[2:]
    found, place, times = np.unique(windows, return_inverse=True, return_counts=True)
    if len(found) == len(windows):
        return 0
    again = times[place] > 1
    covered = np.zeros(len(words), bool)
    for k in range(3):
        covered[k : len(words) - 2 + k] |= again
    return int(covered.sum())


def text_counts(text: str | None) -> tuple[int, ...]:
    """The COUNTS of one text; null has none of anything but one empty line."""
    text = text or ""
    words = text.encode().split()
    lines = text.split("\n")
    worded = [x for x in lines if x.strip(SPACE)]
    spaces = sum(map(text.count, SPACE))
    return len(words), len(text) - spaces, sum(map(text.count, SYMBOLS)), len(worded) - len(set(worded)), repeat_words(words), len(lines)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = np.array([text_counts(t.as_py()) for t in batch.column(2)], np.int64).reshape(-1, len(COUNTS))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(found[:, k]) for k in range(len(COUNTS)))], ["id", "host", *COUNTS])


def beta_prior(hosts: DataFrame) -> tuple[float, float]:
    """(mean, strength) of the beta prior of the failure rates of hosts with n documents, f of them failing.

    Beta-binomial moments weighted by documents: the mean is that of all documents, and of the spread between hosts, counted
    by documents, what sampling alone would give is taken off, so many small hosts of one true rate have a strong prior."""
    n, f = F.col("n").cast("double"), F.col("f").cast("double")
    k, docs, failed, squares, spread = hosts.select(F.count(F.lit(1)), F.sum(n), F.sum(f), F.sum(n * n), F.sum(f * f / n)).first()
    if not k:
        return 0.5, 1.0
    mean = min(max(failed / docs, 1e-6), 1 - 1e-6)
    between = (spread - failed * failed / docs) / (mean * (1 - mean)) - (k - 1)
    room = docs - squares / docs - (k - 1)
    share = between / room if room > 0 else 0.0  # of a rate's variance, that between hosts
    return mean, min(max(1 / max(share, 1e-9) - 1, 1.0), 1e6)


def quality_rules(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", max_host_rate: float = 0.5) -> DataFrame:
    """One row for each input row: id, the counts, base_failed, kept, host_rate (shrunk) and host_rejected.

    base_failed: under 50 words, or over half the words in repeated three-word windows. Besides these, a document
    fails at over one symbol in ten words or over 30 % repeated lines. host_rejected judges such a failure by how far it
    is over the limit times host_rate over the prior's mean: over 1 it goes, so a failure twice the limit goes on a
    host of more than half the mean rate, and one just over it only on hosts about as bad as the mean or worse. A
    document that fails no rule goes only with a host of over `max_host_rate`. `kept` is false for all of these.
    Null text counts as empty. A null host gives no verdict, so only the base rules judge such rows. Repeated rows
    count each; an empty table gives an empty result. Other columns of `docs` are not read."""
    from pyspark.sql import types as T

    slim = docs.select(F.col(id_col).alias("id"), F.col(host_col).cast("string").alias("host"), F.col(text_col).cast("string").alias("text"))
    schema = T.StructType([slim.schema["id"], slim.schema["host"], *(T.StructField(c, T.LongType()) for c in COUNTS)])
    counted = slim.mapInArrow(_counted, schema)
    base = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    other = (10 * F.col("n_symbols") > F.col("n_words")) | (10 * F.col("n_dup_lines") > 3 * F.col("n_lines"))
    judged = cut(counted.withColumn("base_failed", base).withColumn("failed", (base | other).cast("long")), "rules")

    hosts = judged.filter("host IS NOT NULL").groupBy("host").agg(F.count(F.lit(1)).alias("n"), F.sum("failed").alias("f"))
    mean, strength = beta_prior(hosts)
    verdicts = hosts.select("host", ((F.col("f") + mean * strength) / (F.col("n") + strength)).alias("host_rate"))
    out = skew_join(judged, verdicts, ["host"], "left")
    # how far a failing document is over a rule, 1 at the limit, against how much worse its host is than the prior
    excess = F.greatest(F.try_divide(10.0 * F.col("n_symbols"), F.col("n_words")), F.try_divide(10.0 * F.col("n_dup_lines"), 3.0 * F.col("n_lines")))
    rejected = (F.col("failed") == 1) & F.coalesce(F.col("base_failed") | (excess * F.col("host_rate") > mean), F.lit(False))
    kept = ~F.col("base_failed") & ~rejected & ~F.coalesce(F.col("host_rate") > max_host_rate, F.lit(False))
    return out.select(F.col("id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"), "host_rate", rejected.alias("host_rejected"))
