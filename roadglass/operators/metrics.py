"""Pipeline and model quality measures as mergeable aggregates and range-partitioned ranks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import NumericType

from .ordering import in_ranges, numbered

#: Upper edges of the latency histogram in seconds; one open bucket follows.
EDGES = (0.05, 0.1, 0.25, 0.5, 1.0, 2.0, 3.0, 5.0, 10.0)


def events_per_second(df: DataFrame, *, ts: str, until, seconds: int = 5) -> DataFrame:
    """Mean of the last complete one-second buckets before `until`; seconds without events count as zero."""
    end = F.date_trunc("second", F.lit(until).cast("timestamp"))
    start = end - F.expr(f"interval {seconds} seconds")
    inside = df.filter((F.col(ts).cast("timestamp") >= start) & (F.col(ts).cast("timestamp") < end))
    return inside.agg((F.count(F.lit(1)) / F.lit(float(seconds))).alias("events_per_second"))


def freshness(ages: DataFrame, *, value: str) -> DataFrame:
    """Upper median of ages, by counts: the smallest age with more than half of all rows at or below it.

    Ages are counted per value before they are put in order, and the order is walked in value ranges."""
    counts = ages.groupBy(F.col(value).alias("v")).agg(F.count(F.lit(1)).alias("n"))
    below = running_total(counts, "v", "n")
    total = ages.agg(F.count(F.lit(1)).alias("total"))
    place = F.floor(F.col("total") / 2)
    return below.join(F.broadcast(total)).filter((F.col("before") <= place) & (F.col("before") + F.col("n") > place)).select(F.col("v").alias("upper_median"))


def quantiles(df: DataFrame, *, value: str, at: tuple[float, ...], group: str | None = None) -> DataFrame:
    """(group,) q: the exact quantiles of a number, interpolated between neighbours; nulls do not count.

    Rows are counted per value and the counts walked in value ranges. Without a group there is always one row."""
    slim = df.select((F.col(group) if group else F.lit(0)).alias("_g"), F.col(value).cast("double").alias("_v")).filter("_v IS NOT NULL")
    counts = slim.groupBy("_g", "_v").agg(F.count(F.lit(1)).alias("_n"))
    totals = slim.groupBy(F.col("_g").alias("_of")).agg(F.count(F.lit(1)).alias("_all"))
    ranked = running_total(counts, "_v", "_n", within="_g")
    ranked = ranked.join(totals, ranked["_g"].eqNullSafe(totals["_of"]))

    def value_at(place: Column) -> Column:
        return F.max(F.when((F.col("before") <= place) & (F.col("before") + F.col("_n") > place), F.col("_v")))

    places = [q * (F.col("_all") - 1) for q in at]
    ends = [x.alias(f"_{c}{k}") for k, p in enumerate(places) for c, x in (("low", value_at(F.floor(p))), ("high", value_at(F.ceil(p))))]
    found = ranked.groupBy("_g", "_all").agg(*ends)
    each = [F.when(F.col(f"_low{k}") == F.col(f"_high{k}"), F.col(f"_low{k}")).otherwise((F.ceil(p) - p) * F.col(f"_low{k}") + (p - F.floor(p)) * F.col(f"_high{k}")) for k, p in enumerate(places)]
    out = found.select(F.col("_g"), F.array(*each).alias("q"))
    return out.withColumnRenamed("_g", group) if group else out.agg(F.first("q").alias("q"))


def running_total(counts: DataFrame, order: str, n: str | tuple[str, ...], parts: int | None = None, descending: bool = False, within: str | None = None) -> DataFrame:
    """`counts` with `before`, the sum of `n` over all rows that come earlier in `order`, a number with unique values.

    Rows are dealt into as many ranges as there are rows for (or about `parts`); each range runs its own total and a table
    of range sums links them, so nothing is sorted in one task. With `within`, each of its groups has its own total.
    Several columns in `n` are summed in one go, into before_<column>."""
    if not isinstance(counts.schema[order].dataType, NumericType):
        raise TypeError(f"{order} is not a number: {counts.schema[order].dataType.simpleString()}")
    summed = {n: "before"} if isinstance(n, str) else {c: f"before_{c}" for c in n}
    keys = [within] if within else []
    ranged = in_ranges(counts, *keys, order, rows_each=None if parts is None else max(1, counts.count() // parts))
    by, sign = (F.desc(order), -1) if descending else (F.asc(order), 1)
    group = F.col(within) if within else F.lit(0)
    sums = ranged.groupBy(group.alias("_of_g"), F.col("_part").alias("_of_part")).agg(*[F.sum(c).alias(f"_sum_{c}") for c in summed])
    before = Window.partitionBy("_of_g").orderBy(F.col("_of_part") * sign).rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("_of_g", "_of_part", *[F.coalesce(F.sum(f"_sum_{c}").over(before), F.lit(0)).alias(f"_start_{c}") for c in summed])
    own = Window.partitionBy(*keys, "_part").orderBy(by).rowsBetween(Window.unboundedPreceding, -1)
    run = ranged.select("*", *[F.coalesce(F.sum(c).over(own), F.lit(0)).alias(f"_run_{c}") for c in summed])
    same = run["_part"] == starts["_of_part"]
    linked = run.join(starts, run[within].eqNullSafe(starts["_of_g"]) & same if within else same)
    return linked.select(*counts.columns, *[(F.col(f"_run_{c}") + F.col(f"_start_{c}")).alias(out) for c, out in summed.items()])


def _by_score(df: DataFrame, score: str, label: str) -> DataFrame:
    """Positives and negatives of each distinct score: ties are one group, and the table shrinks before it is ordered."""
    return df.groupBy(F.col(score).cast("double").alias("s")).agg(F.sum(F.col(label).cast("long")).alias("pos"), F.sum((1 - F.col(label)).cast("long")).alias("neg"))


def roc_auc(df: DataFrame, *, score: str, label: str) -> DataFrame:
    """Exact area under the ROC curve; tied pairs count half. Null if a class is absent."""
    g = running_total(_by_score(df, score, label), "s", "neg")
    area = F.sum(F.col("pos") * (F.col("before") + F.col("neg") / 2))
    return g.agg(F.try_divide(area, F.sum("pos") * F.sum("neg")).alias("roc_auc"))


def average_precision(df: DataFrame, *, score: str, label: str) -> DataFrame:
    """Sum over distinct thresholds of recall step times precision. Null without positives."""
    g = _by_score(df, score, label).withColumn("n", F.col("pos") + F.col("neg"))
    g = running_total(g, "s", ("pos", "n"), descending=True)
    precision = (F.col("before_pos") + F.col("pos")) / (F.col("before_n") + F.col("n"))
    return g.agg(F.try_divide(F.sum(F.col("pos") * precision), F.sum("pos")).alias("average_precision"))


def precision_at_k(df: DataFrame, *, score: str, label: str, tie: str, fraction: float = 0.02) -> DataFrame:
    """Share of positives among the best max(1, floor(n x fraction)) rows, and the positive rate of all.

    The k-th best score comes from counts by score. Rows tied at that score are put in order of `tie` range by range, so that
    neither a task nor the driver holds all of them."""
    n = df.count()
    k = max(1, int(n * fraction))
    g = running_total(_by_score(df, score, label).withColumn("n", F.col("pos") + F.col("neg")), "s", "n", descending=True)
    edge = g.filter((F.col("before") < k) & (F.col("before") + F.col("n") >= k)).select("s", "before").first()
    if edge is None:
        return df.agg(F.lit(None).cast("double").alias("precision_at_k"), F.avg(label).alias("positive_rate"))
    above = df.filter(F.col(score) > edge["s"]).agg(F.coalesce(F.sum(label), F.lit(0)).alias("a"))
    placed = numbered(df.filter(F.col(score) == edge["s"]).select(F.col(tie).alias("_tie"), F.col(label).alias("_label")), "_tie")
    tied = placed.filter(F.col("_at") < k - edge["before"]).agg(F.coalesce(F.sum("_label"), F.lit(0)).alias("b"))
    rate = df.agg(F.avg(label).alias("positive_rate"))
    return above.join(tied).join(rate).select(((F.col("a") + F.col("b")) / F.lit(float(k))).alias("precision_at_k"), "positive_rate")


def rate_by_label(df: DataFrame, *, ts: str, label: str) -> DataFrame:
    """Rows per second for each label and minute."""
    minute = F.date_trunc("minute", F.col(ts).cast("timestamp"))
    return df.groupBy(minute.alias("minute"), label).agg((F.count(F.lit(1)) / 60.0).alias("per_second"))


def latency_histogram(df: DataFrame, *, ts: str, seconds: Column, group: str = "hour", quantiles: tuple[float, ...] = (0.5, 0.95, 0.99)) -> DataFrame:
    """Per period: rows, mean, and quantiles interpolated from the fixed buckets (the last edge if beyond)."""
    period = F.date_trunc(group, F.col(ts).cast("timestamp")).alias("period")
    at_most = [F.count_if(F.col("_s") <= e).alias(f"le{k}") for k, e in enumerate(EDGES)]
    sums = df.withColumn("_s", seconds).groupBy(period).agg(F.count("_s").alias("n"), F.sum("_s").alias("total"), *at_most)

    def quantile(q: float) -> Column:
        rank, chain = F.lit(q) * F.col("n"), None
        for k, edge in enumerate(EDGES):
            low, below = (EDGES[k - 1], F.col(f"le{k - 1}")) if k else (0.0, F.lit(0))
            value = F.lit(low) + F.try_divide((edge - low) * (rank - below), F.col(f"le{k}") - below)
            chain = F.when(F.col(f"le{k}") >= rank, value) if chain is None else chain.when(F.col(f"le{k}") >= rank, value)
        return chain.otherwise(EDGES[-1])

    return sums.select("period", "n", F.try_divide("total", "n").alias("mean"), *[quantile(q).alias(f"p{round(q * 100)}") for q in quantiles])


def reconcile(sent: DataFrame, written: DataFrame, keys: list[str]) -> DataFrame:
    """One row: distinct keys sent, written, missing and unexpected, and the missing share."""
    a, b = sent.select(*keys).distinct().withColumn("_a", F.lit(1)), written.select(*keys).distinct().withColumn("_b", F.lit(1))
    sums = a.join(b, keys, "full").agg(F.count("_a").alias("sent"), F.count("_b").alias("written"), F.count_if(F.col("_b").isNull()).alias("missing"), F.count_if(F.col("_a").isNull()).alias("unexpected"))
    return sums.withColumn("missing_share", F.coalesce(F.try_divide("missing", "sent"), F.lit(0.0)))


def soak_summary(df: DataFrame, *, order: str, value: str) -> DataFrame:
    """Median, p95 and maximum, and the means of the first and second half in order (split at the median of `order`)."""
    half = quantiles(df, value=order, at=(0.5,)).select(F.col("q")[0].alias("_mid"))
    cut = df.join(F.broadcast(half))
    halves = cut.agg(
        F.max(value).alias("max"),
        F.avg(F.when(F.col(order) <= F.col("_mid"), F.col(value))).alias("first_half"), F.avg(F.when(F.col(order) > F.col("_mid"), F.col(value))).alias("second_half"),
    )
    ends = quantiles(df, value=value, at=(0.5, 0.95)).select(F.col("q")[0].alias("median"), F.col("q")[1].alias("p95"))
    return ends.join(F.broadcast(halves)).select("median", "p95", "max", "first_half", "second_half")
