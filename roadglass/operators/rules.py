"""Alert rules over canonical events: one scan and one explode for the row rules, range frames for the window rules."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.vehicle import fault_description, fault_severity
from .windows import sliding_window

ALERT = "struct<rule:string,severity:int,code:string,detail:string>"

#: What each rule tells beside its name: the fields of the JSON in `detail`, as a DDL type for from_json.
DETAILS = {
    "CRITICAL_DTC": "code string, description string", "DTC": "code string, description string", "LOW_12V": "volts double", "LOW_SOC": "soc_pct double",
    "OVERHEAT_TREND": "mean_c double, max_c double", "HARSH_BRAKE_PATTERN": "count_1h long",
}


@dataclass(frozen=True)
class Limits:
    """The rules' thresholds; windows are in seconds."""

    overheat_c: float = 108.0
    overheat_window: int = 300
    low_12v: float = 11.8
    low_soc: float = 10.0
    brake_window: int = 3600
    brakes: int = 3


def _alert(rule: Column, severity: Column, code: Column, detail: Column) -> Column:
    return F.struct(rule.alias("rule"), severity.cast("int").alias("severity"), code.cast("string").alias("code"), detail.cast("string").alias("detail"))


def dedup_key(vin: Column, rule: Column, code: Column, ts_ms: Column) -> Column:
    """One key for each vehicle, rule, code and hour."""
    return F.concat_ws(":", vin, rule, F.coalesce(code, F.lit("")), F.floor(ts_ms / 3_600_000).cast("string"))


def row_alerts(events: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """Alerts of single events: a fault code each, low 12 V battery, low charge. Needs vin, ts_ms, seq, dtcs, batt_v, soc_pct."""
    text = F.lit(None).cast("string")
    told = lambda c: F.to_json(F.struct(c.alias("code"), fault_description(c).alias("description")))
    coded = F.transform(F.coalesce("dtcs", F.array().cast("array<string>")), lambda c: _alert(F.when(fault_severity(c) >= 4, "CRITICAL_DTC").otherwise("DTC"), fault_severity(c), c, told(c)))
    single = F.array(
        F.when(F.col("batt_v") < limits.low_12v, _alert(F.lit("LOW_12V"), F.lit(3), text, F.to_json(F.struct(F.round("batt_v", 3).alias("volts"))))),
        F.when(F.col("soc_pct") < limits.low_soc, _alert(F.lit("LOW_SOC"), F.lit(2), text, F.to_json(F.struct(F.round("soc_pct", 3).alias("soc_pct"))))),
    )
    found = events.select("vin", "ts_ms", "seq", F.explode(F.concat(coded, F.filter(single, lambda a: a.isNotNull()))).alias("a"))
    return found.select("vin", "ts_ms", "seq", "a.*")


def overheat_alerts(events: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """Mean coolant temperature over the window above the limit, with at least two readings."""
    w = sliding_window(events.withColumn("ts", F.timestamp_millis("ts_ms")), key="vin", ts="ts", value="coolant_c", seconds=limits.overheat_window)
    hot = w.filter((F.col("win_count") >= 2) & (F.col("win_mean") > limits.overheat_c))
    # halves go up whatever the sum's last bits are
    detail = F.to_json(F.struct(F.round(F.col("win_mean") + 1e-9, 1).alias("mean_c"), F.round("win_max", 3).alias("max_c")))
    return hot.select("vin", "ts_ms", "seq", F.lit("OVERHEAT_TREND").alias("rule"), F.lit(4).alias("severity"), F.lit(None).cast("string").alias("code"), detail.alias("detail"))


def pattern_alerts(events: DataFrame, limits: Limits = Limits(), event: str = "HARSH_BRAKE") -> DataFrame:
    """An event that recurs within the window; other events are filtered out before the shuffle."""
    w = Window.partitionBy("vin").orderBy("ts_ms").rangeBetween(-limits.brake_window * 1000, 0)
    counted = events.filter(F.col("evt") == event).withColumn("n", F.count(F.lit(1)).over(w)).filter(F.col("n") >= limits.brakes)
    return counted.select("vin", "ts_ms", "seq", F.lit("HARSH_BRAKE_PATTERN").alias("rule"), F.lit(2).alias("severity"), F.lit(None).cast("string").alias("code"), F.to_json(F.struct(F.col("n").alias("count_1h"))).alias("detail"))


def detail_of(found: DataFrame, rule: str) -> DataFrame:
    """The alerts of one rule with the fields of their detail as columns."""
    return found.filter(F.col("rule") == rule).withColumn("_d", F.from_json("detail", DETAILS[rule])).select(*[c for c in found.columns if c not in ("detail", "code") or c == "code" and "code " not in DETAILS[rule]], "_d.*")


def alerts(events: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """All rules' alerts, with their dedup key."""
    found = row_alerts(events, limits).unionByName(overheat_alerts(events, limits)).unionByName(pattern_alerts(events, limits))
    return keyed(found)


def keyed(found: DataFrame) -> DataFrame:
    """Alerts with their dedup key."""
    return found.withColumn("dedup_key", dedup_key(F.col("vin"), F.col("rule"), F.col("code"), F.col("ts_ms")))


def first_of_each(found: DataFrame) -> DataFrame:
    """The earliest alert for each dedup key."""
    rest = [c for c in found.columns if c != "dedup_key"]
    return found.groupBy("dedup_key").agg(F.min_by(F.struct(*rest), F.struct("ts_ms", "seq")).alias("a")).select("dedup_key", "a.*")
