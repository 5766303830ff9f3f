"""Soft-membership mixing of text domains to target token weights, in JVM operators only.

A classifier fitted on labelled rows (a bounded sample for each domain) gives each document's posterior over domains.
A document's tokens count towards every domain by its posterior. Nonnegative document rates are then fitted by
projected-gradient least squares so that the expected domain token totals match the targets, each domain's error
counted in its own tokens: a step is one distributed aggregate that returns as many sums as there are domains. The rate
after any number of steps is one column expression over a document's posterior, a fold over the steps' gradients, so
rates are never collected or joined; while fitting they are written with the posteriors every FOLD steps.
"""

from __future__ import annotations

import json
import warnings
from dataclasses import dataclass, field

import numpy as np
from pyspark.ml import PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF, StringIndexerModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import cut, free_name, hash128, whole_text

#: Distinct texts of each domain that the classifier is fitted on, at most.
ROWS_EACH = 2_000
#: More domains than this are refused: the gradient's sums come back to the driver.
MAX_DOMAINS = 256
FEATURES = 1 << 12
#: So many steps that together take less than a hundredth off the largest gap end the fit.
STALL = 5
#: Steps after which the rates are written, so that later steps start from there.
FOLD = 8
#: Where rates have a lower bound, the default scale is this much over the least one. At the least one the largest domain's documents stand at their
#: bound, and the fit creeps along it.
HEADROOM = 1.02
SPACE = "[\\x20\\x09-\\x0D]+"


def _tokens(text: Column) -> Column:
    return F.array_remove(F.split(text, SPACE, -1), "")


@dataclass
class Mixture:
    """A fitted mixture: domains, the classifier and the gradient of every step taken."""

    domains: list[str]
    classifier: PipelineModel | None
    targets: dict[str, float]
    min_rate: float
    max_rate: float | None = None
    steps: list[list[float]] = field(default_factory=list)
    reached: dict[str, float] = field(default_factory=dict)
    #: Domains that have a target but no document.
    absent: list[str] = field(default_factory=list)

    def bounded(self, rate: Column) -> Column:
        low = F.greatest(rate, F.lit(float(self.min_rate)))
        return low if self.max_rate is None else F.least(low, F.lit(float(self.max_rate)))

    def start(self) -> float:
        """The rate before any step."""
        return float(max(1.0, self.min_rate) if self.max_rate is None else min(max(1.0, self.min_rate), self.max_rate))

    def posteriors(self, docs: DataFrame, text_col: str) -> DataFrame:
        """`docs` with _mix_tokens and _mix_p, the posterior of each domain."""
        texts = docs.withColumn("_mix_words", _tokens(whole_text(text_col))).withColumn("_mix_tokens", F.size("_mix_words").cast("long"))
        if self.classifier is None:
            return texts.drop("_mix_words").withColumn("_mix_p", F.array(*[F.lit(1.0)] * len(self.domains)))
        scored = self.classifier.transform(texts).drop("_mix_words", "_mix_x", "_mix_raw", "_mix_best")
        # given out by a generator: what is computed from it above does not pull the classifier in once more
        return scored.select("*", F.explode(F.array(vector_to_array("_mix_prob"))).alias("_mix_p")).drop("_mix_prob")

    def rate(self, done: int = 0) -> Column:
        """The rate after all steps, from _mix_p; with `done` from _mix_rate, the rate after that many."""
        start, steps = F.col("_mix_rate") if done else F.lit(self.start()), self.steps[done:]
        if not steps:
            return start

        def step(rate: Column, g: Column) -> Column:
            move = F.aggregate(F.zip_with("_mix_p", g, lambda p, x: p * x), F.lit(0.0), lambda a, b: a + b)
            return self.bounded(rate - move)

        # one literal, however many domains and steps there are
        return F.aggregate(F.from_json(F.lit(json.dumps(steps)), "array<array<double>>"), start, step)

    def copies(self, id_col: str) -> Column:
        """How often a document is taken: the rate, its fraction settled by a hash of id and token count."""
        u = F.pmod(F.xxhash64(F.lit(0x3117), F.col(id_col), F.col("_mix_tokens")), F.lit(1 << 30)) / F.lit(float(1 << 30))
        return F.floor(F.col("_mix_rate") + u).cast("int")


def training_sample(docs: DataFrame, *, domain_col: str, text_col: str, rows_each: int = ROWS_EACH) -> DataFrame:
    """(domain, weight, text): at most `rows_each` distinct texts of each domain, weights adding up to its rows.

    A text that makes up more than one in `rows_each` of its domain's rows is taken for certain, with its count as
    weight; the rest of the places go to other texts by hash, which share the remaining rows by their counts."""
    h1, h2 = hash128(F.col("text"))
    texts = docs.select(F.col(domain_col).cast("string").alias("domain"), whole_text(text_col).alias("text")).filter(F.col("domain").isNotNull())
    keyed = texts.select("domain", h1.alias("h1"), h2.alias("h2"), "text")
    counts = cut(keyed.groupBy("domain", "h1", "h2").agg(F.count(F.lit(1)).alias("n")), "mix-counts")
    sizes = counts.groupBy("domain").agg(F.sum("n").alias("rows"), F.count(F.lit(1)).alias("texts"))
    # at most MAX_DOMAINS rows
    placed = counts.join(F.broadcast(sizes), "domain").withColumn("sure", (F.col("texts") <= rows_each) | (F.col("n") * rows_each > F.col("rows")))
    sure = placed.filter("sure")
    held = sure.groupBy("domain").agg(F.count(F.lit(1)).alias("held"), F.sum("n").alias("held_rows"))
    light = placed.filter("NOT sure").join(F.broadcast(held), "domain", "left").na.fill(0, ["held", "held_rows"])
    places = F.lit(rows_each) - F.col("held")
    # thinned by hash to some more than there are places for, then exactly that many, so that no task orders a whole domain
    few = F.pmod("h1", F.lit(1 << 30)) < (places + 6 * F.sqrt(places) + 20) / (F.col("texts") - F.col("held")) * (1 << 30)
    order = Window.partitionBy("domain").orderBy(F.pmod("h1", F.lit(1 << 30)), "h1", "h2")
    picked = light.filter(few).withColumn("_nth", F.row_number().over(order)).filter(F.col("_nth") <= places)
    shared = (F.col("rows") - F.col("held_rows")) / F.sum("n").over(Window.partitionBy("domain"))
    columns = ["domain", "h1", "h2"]
    chosen = cut(sure.select(*columns, F.col("n").cast("double").alias("weight")).unionByName(picked.select(*columns, (F.col("n") * shared).alias("weight"))), "mix-chosen")
    # at most MAX_DOMAINS x rows_each rows of 40 bytes; one text stands for its copies
    found = keyed.join(F.broadcast(chosen), columns).groupBy(*columns).agg(F.first("weight").alias("weight"), F.first("text").alias("text"))
    return found.select("domain", "weight", "text")


def fit_classifier(docs: DataFrame, domains: list[tuple[str, int]], *, domain_col: str, text_col: str, rows_each: int = ROWS_EACH) -> PipelineModel | None:
    """Multinomial logistic regression over hashed words; None if there is but one domain."""
    if len(domains) < 2:
        return None
    names = [d for d, _ in domains]
    sample = cut(training_sample(docs, domain_col=domain_col, text_col=text_col, rows_each=rows_each).select("domain", "weight", _tokens(F.col("text")).alias("_mix_words")), "mix-sample")
    index = StringIndexerModel.from_labels(names, inputCol="domain", outputCol="label", handleInvalid="error")
    hashing = HashingTF(inputCol="_mix_words", outputCol="_mix_x", numFeatures=FEATURES, binary=True)
    learner = LogisticRegression(featuresCol="_mix_x", weightCol="weight", regParam=1e-3, maxIter=30, family="multinomial", rawPredictionCol="_mix_raw", probabilityCol="_mix_prob", predictionCol="_mix_best")
    return PipelineModel([hashing, learner.fit(hashing.transform(index.transform(sample)))])


def tempered(totals: np.ndarray, power: float) -> np.ndarray:
    """Shares in proportion to a power of the totals."""
    w = np.maximum(totals, 0.0) ** power
    return w / w.sum() if w.sum() else w


def fit_mixture(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", domain_col: str = "lang", targets: dict[str, float] | None = None, power: float = 0.7, min_rate: float = 0.0, max_rate: float | None = None, scale: float | None = None, headroom: float = HEADROOM, max_steps: int = 100, tolerance: float = 1e-3) -> tuple[Mixture, DataFrame]:
    """The mixture and the table it was fitted on: id, _mix_tokens, _mix_p for every document.

    `targets` are domain weights (default: the domains' expected token totals to the power `power`), scaled to sum to
    one over the domains that there are; expected totals shall be target x scale x all tokens. The default scale is the
    least at which no domain has to shrink, `headroom` times that where rates have a lower bound, so with min_rate 1 no
    document is lost. Documents of null domain are not learnt from but take part; if all are null, rates stay where they
    start. A domain without a target is wanted at its lower bound. If no domain has a target, rates stay where they
    start, too, and a warning says so; targets of domains without documents are named in `absent` and in a warning.

    Steps end when every domain is within `tolerance` of its own target, or when the largest of these gaps
    no longer shrinks; where targets are missed then, a warning names them. `reached` has the totals
    either way. Rates have no upper bound unless `max_rate` gives one."""
    counts = docs.groupBy(F.col(domain_col).cast("string").alias("d")).count().filter("d IS NOT NULL").orderBy("d").limit(MAX_DOMAINS + 1).collect()
    if len(counts) > MAX_DOMAINS:
        raise ValueError(f"over {MAX_DOMAINS} domains")
    domains = [(r["d"], r["count"]) for r in counts] or [("", 1)]
    names = [d for d, _ in domains]
    mixture = Mixture(names, fit_classifier(docs, domains, domain_col=domain_col, text_col=text_col), {}, min_rate, max_rate)
    known = cut(mixture.posteriors(docs.select(F.col(id_col), F.col(text_col)), text_col).select(id_col, "_mix_tokens", "_mix_p"), "posteriors")

    def sums(rate: Column) -> np.ndarray:
        """Expected tokens of every domain at these rates: weighted vector sums, one row for each document, and a plan of
        one size for any number of domains."""
        weighed = known.select(array_to_vector("_mix_p").alias("p"), (rate * F.col("_mix_tokens")).alias("w")).filter("w > 0")
        total, mean = weighed.select(F.sum("w"), Summarizer.mean(F.col("p"), F.col("w"))).first() if not weighed.isEmpty() else (0.0, None)
        return total * mean.toArray() if mean is not None else np.zeros(len(names))

    totals = sums(F.lit(1.0))
    if targets:
        mixture.absent = sorted(set(targets) - {d for d, _ in domains}) if counts else sorted(targets)
    if mixture.absent:
        warnings.warn(f"no documents of {mixture.absent}, which have targets; the others share their part", stacklevel=2)
    if not totals.sum() or targets and not counts:
        return mixture, known
    wanted = np.array([float(targets.get(d, 0.0)) for d in names]) if targets else tempered(totals, power)
    if not wanted.sum():
        warnings.warn(f"none of the domains {names} has a target; rates stay at {mixture.start()}", stacklevel=2)
        return mixture, known
    wanted = wanted / wanted.sum()
    if scale is None:
        scale = max(t / (w * totals.sum()) for t, w in zip(totals, wanted, strict=True) if w > 0)
        if min_rate > 0 and len(names) > 1:
            scale *= headroom
    goal = np.where(wanted > 0, wanted * scale * totals.sum(), min_rate * totals)
    mixture.targets = dict(zip(names, goal.tolist(), strict=True))

    # Least squares in errors counted in a domain's tokens, variables scaled by the root of theirs. What a step does to
    # the errors has columns that sum to one (posteriors do), so no eigenvalue is over 1 and a whole step is safe.
    unit = 1 / np.maximum(totals, 1e-9)
    reached, gaps, done = totals * mixture.start(), [], 0
    measure = np.maximum(np.where(goal > 0, goal, totals), 1e-9)
    for _ in range(max_steps + 1):
        off = np.abs(reached - goal)
        if (off <= tolerance * measure).all():
            break
        gaps.append(float((off / measure).max()))
        if len(mixture.steps) == max_steps or len(gaps) > STALL and gaps[-1] > 0.99 * gaps[-1 - STALL]:
            break
        if len(mixture.steps) - done == FOLD:
            rated = mixture.rate(done)
            known, done = cut(known.withColumn("_mix_rate", rated), "rated"), len(mixture.steps)
        mixture.steps.append(((reached - goal) * unit).tolist())
        reached = sums(mixture.rate(done))
    mixture.reached = dict(zip(names, reached.tolist(), strict=True))
    missed = {d: (mixture.reached[d], mixture.targets[d]) for d, o, m in zip(names, off, measure, strict=True) if o > tolerance * m}
    if missed:
        warnings.warn(f"targets not met after {len(mixture.steps)} steps (reached, wanted): {missed}", stacklevel=2)
    return mixture, known.select(id_col, "_mix_tokens", "_mix_p")


def mixing_rates(docs: DataFrame, *, id_col: str = "doc_id", **options) -> DataFrame:
    """One row for each input row: id, tokens, domain (the likeliest), rate, copies, the token totals that were wanted
    for that domain and that the rates reach in expectation, and the domains with a target but no document
    (absent_targets, comma-joined).

    Null text has no tokens, very long texts have all of theirs. Null ids are rows like any other; repeated rows get the
    same rate and copies, and of posteriors that tie the first domain is named. Without any token, any domain or any
    target that fits a domain every rate is 1, or the bound nearest to 1. An empty table gives an empty result. Columns
    other than id, text and domain, whatever their names, are not read. Options are those of fit_mixture."""
    mixture, known = fit_mixture(docs, id_col=id_col, **options)
    best = F.array_position("_mix_p", F.array_max("_mix_p")).cast("int")
    rated = known.withColumn("_mix_rate", mixture.rate())
    named = lambda values: F.element_at(F.array(*map(F.lit, values)), best)
    totals = [named([float(t.get(d, 0.0)) for d in mixture.domains]).alias(c) for c, t in (("wanted_tokens", mixture.targets), ("reached_tokens", mixture.reached))]
    return rated.select(id_col, F.col("_mix_tokens").alias("tokens"), named(mixture.domains).alias("domain"), F.round("_mix_rate", 9).alias("rate"), mixture.copies(id_col).alias("copies"), *totals, F.lit(",".join(mixture.absent)).alias("absent_targets"))


def mix(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """`docs`, all columns, each row as often as its rate says. Posterior and rate are computed in place, so the
    texts are neither shuffled nor joined."""
    mixture, _ = fit_mixture(docs, id_col=id_col, text_col=text_col, **options)
    # columns of the caller's that bear the names used here step aside
    names = {c: f"_own_{k}" for k, c in enumerate(docs.columns) if c.lower().startswith("_mix_")}
    own = docs.withColumnsRenamed(names)
    columns = [F.col(f"`{names.get(c, c)}`").alias(c) for c in docs.columns]
    rated = mixture.posteriors(own, names.get(text_col, text_col)).withColumn("_mix_rate", mixture.rate()).withColumn("_mix_copies", mixture.copies(names.get(id_col, id_col)))
    turn = free_name(docs, "_mix_turn")
    return rated.select(*columns, F.explode(F.array_repeat(F.lit(True), F.col("_mix_copies"))).alias(turn)).drop(turn)
