"""Breakdown risk: features, baseline, a gradient-boosted model, its explanation and importance."""

from __future__ import annotations

from functools import reduce

from pyspark.ml import PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, functions as F

from .metrics import average_precision, precision_at_k, quantiles, roc_auc
from .ordering import numbered, written

#: The features in order, with what they are called in explanations.
LABELS = {
    "service_overdue_ratio": "overdue for service",
    "vehicle_age_yrs": "vehicle age",
    "odo_10k_km": "high mileage",
    "max_coolant_7d": "coolant running hot",
    "min_batt_v_7d": "12V battery voltage low",
    "dtc_events_7d": "frequent fault codes",
    "harsh_brakes_7d": "harsh braking",
    "is_ev": "EV",
    "is_hybrid": "hybrid",
}
FEATURES = tuple(LABELS)
FLAGS = ("is_ev", "is_hybrid")
LOW_IS_BAD = ("min_batt_v_7d",)


def features(rollup: DataFrame, vehicles: DataFrame, *, as_of, as_of_year: int) -> DataFrame:
    """Nine features per vehicle from the rollup's last days (as_of - 7 and later). Small dimensions join after the
    aggregate; how they join is left to their size."""
    week = rollup.filter(F.col("day") >= F.date_sub(F.to_date(F.lit(as_of)), 7)).groupBy("vin").agg(
        F.max("max_odo").alias("odo"), F.max("max_coolant").alias("hot"), F.min("min_batt_v").alias("volt"), F.sum("dtc_events").alias("dtc"), F.sum("harsh_brakes").alias("brakes")
    )
    return vehicles.join(week, "vin").select(
        "vin",
        "tenant_id",
        F.try_divide(F.col("odo") - F.col("last_service_odo_km"), F.col("service_interval_km").cast("double")).alias("service_overdue_ratio"),
        (F.lit(as_of_year) - F.col("model_year")).cast("double").alias("vehicle_age_yrs"),
        (F.col("odo") / 10000).alias("odo_10k_km"),
        F.coalesce("hot", F.lit(0.0)).alias("max_coolant_7d"),
        F.coalesce("volt", F.lit(12.6)).alias("min_batt_v_7d"),
        F.col("dtc").cast("double").alias("dtc_events_7d"),
        F.col("brakes").cast("double").alias("harsh_brakes_7d"),
        (F.col("powertrain") == "EV").cast("double").alias("is_ev"),
        (F.col("powertrain") == "HEV").cast("double").alias("is_hybrid"),
    )


def baseline_score(overdue: Column) -> Column:
    """How overdue the service is, 1 at one and a half intervals."""
    return F.least(F.greatest(overdue / 1.5, F.lit(0.0)), F.lit(1.0))


def medians(df: DataFrame) -> DataFrame:
    """One row with the exact median of each feature."""
    long = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("value")) for c in FEATURES])).alias("x")).select("x.*")
    middle = quantiles(long, value="value", at=(0.5,), group="feature")
    return middle.agg(*[F.max(F.when(F.col("feature") == c, F.col("q")[0])).alias(c) for c in FEATURES])


def explain_factors(df: DataFrame, middle: dict[str, float], importance: dict[str, float], k: int = 3) -> DataFrame:
    """`df` with `factors`: the k features that push a row's risk up most, by importance times relative deviation."""
    parts = []
    for c in FEATURES:
        if c in FLAGS:
            continue
        dev = (middle[c] - F.col(c)) if c in LOW_IS_BAD else (F.col(c) - middle[c])
        push = F.lit(float(importance.get(c, 0.0))) * dev / (abs(middle[c]) + 1e-6)
        parts.append(F.when(dev > 0, F.struct(push.alias("push"), F.lit(c).alias("feature"), F.round(F.col(c), 2).alias("value"))))
    ranked = F.sort_array(F.filter(F.array(*parts), lambda x: x.isNotNull()), asc=False)
    label = F.create_map(*[F.lit(x) for pair in LABELS.items() for x in pair])
    return df.withColumn("factors", F.transform(F.slice(ranked, 1, k), lambda x: F.struct(x["feature"].alias("feature"), label[x["feature"]].alias("label"), x["value"].alias("value"))))


def split(df: DataFrame, *, label: str, key: str, held_out: float = 0.25) -> tuple[DataFrame, DataFrame]:
    """(train, test), stratified: of n rows of a class exactly round(n x held_out) are held out, those first by a hash of
    the key (ties by the key). Places in that order are found range by range; the table is written once."""
    own = df.columns
    placed = numbered(df.withColumn("_hash", F.xxhash64(F.lit(1), key)), label, "_hash", key)
    sizes = placed.groupBy(F.col(label).alias("_class")).agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))  # a row for each class
    told = placed.join(sizes, placed[label].eqNullSafe(sizes["_class"])).withColumn("_test", F.col("_at") - F.col("_first") < F.round(F.col("_n") * held_out))
    return told.filter(~F.col("_test")).select(*own), told.filter("_test").select(*own)


def train_risk(df: DataFrame, *, label: str, trees: int = 20, depth: int = 4, step: float = 0.1) -> PipelineModel:
    """Gradient-boosted trees over the features."""
    assembled = VectorAssembler(inputCols=list(FEATURES), outputCol="_features", handleInvalid="keep")
    learner = GBTClassifier(featuresCol="_features", labelCol=label, maxIter=trees, maxDepth=depth, stepSize=step, seed=7, predictionCol="_prediction")
    return PipelineModel([assembled, learner.fit(assembled.transform(df))])


def score_risk(model: PipelineModel, df: DataFrame) -> DataFrame:
    """`df` with `score`, the model's probability of a breakdown."""
    scored = model.transform(df).withColumn("score", vector_to_array("probability")[1])
    return scored.drop("_features", "_prediction", "probability", "rawPrediction")


def feature_importance(model: PipelineModel, df: DataFrame, middle: dict[str, float]) -> DataFrame:
    """(feature, importance): mean change of the score when a feature is set to its median, all features in one pass."""
    keyed = score_risk(model, df).withColumnRenamed("score", "_own")
    copies = keyed.withColumn("feature", F.explode(F.array(*map(F.lit, FEATURES))))
    for c in FEATURES:
        copies = copies.withColumn(c, F.when(F.col("feature") == c, F.lit(float(middle[c]))).otherwise(F.col(c)))
    return score_risk(model, copies).groupBy("feature").agg(F.avg(F.abs(F.col("score") - F.col("_own"))).alias("importance"))


def quality(scored: DataFrame, *, label: str, scores: list[str], key: str) -> DataFrame:
    """(score, roc_auc, average_precision, precision_at_2pct, positive_rate) of each score column on the same rows."""
    held = written(scored.select(key, label, *scores), "scored")
    rows = []
    for c in scores:
        auc, ap = roc_auc(held, score=c, label=label), average_precision(held, score=c, label=label)
        best = precision_at_k(held, score=c, label=label, tie=key).withColumnRenamed("precision_at_k", "precision_at_2pct")
        rows.append(auc.join(ap).join(best).select(F.lit(c).alias("score"), "*"))  # one row each
    return reduce(DataFrame.unionByName, rows)
