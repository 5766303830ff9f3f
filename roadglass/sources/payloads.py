"""Raw payloads of several makers to one canonical event, with a reason for each reject."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.vehicle import fault_codes, is_valid_vin

MILE_KM = 1.609344

#: The canonical event: name and type, required or not.
EVENT = (
    ("vin", "string", True), ("ts_ms", "long", True), ("seq", "long", True), ("lat", "double", True), ("lon", "double", True),
    ("speed_kmh", "double", True), ("odo_km", "double", True), ("soc_pct", "double", False), ("fuel_pct", "double", False),
    ("coolant_c", "double", False), ("batt_v", "double", False), ("evt", "string", False),
)


#: Every path that a format reads, typed: one parse serves all fields.
PAYLOAD = (
    "vin string, ts string, seq long, lat double, lon double, speed_kmh double, odo_km double, soc_pct double, fuel_pct double, coolant_c double, batt_v double, evt string, dtc string, "
    "vehicleId string, epoch double, counter long, position struct<latitude:double,longitude:double>, "
    "signals struct<speedMph:double,odometerMi:double,batteryPct:double,fuelPct:double,lvBatteryVolts:double,coolantTempF:double>, eventType string, faultString string"
)


#: Gives the value at a path of the payload, in the type that PAYLOAD states.
Get = Callable[[str], Column]


@dataclass(frozen=True)
class Format:
    """A maker's format: the keys whose presence marks it, an expression for each canonical field, where its fault
    codes are, and the numeric paths it reads."""

    name: str
    keys: tuple[str, ...]
    fields: dict[str, Callable[[Get], Column]]
    faults: str
    numbers: tuple[str, ...]


def _plain(path: str) -> Callable[[Get], Column]:
    return lambda get: get(path)


FLAT = Format(
    "aurora",
    ("vin", "ts", "speed_kmh"),
    {
        "vin": lambda get: F.upper(get("vin")),
        "ts_ms": lambda get: F.unix_millis(F.try_to_timestamp(get("ts"))),
        **{c: _plain(c) for c in ("seq", "lat", "lon", "speed_kmh", "odo_km", "soc_pct", "fuel_pct", "coolant_c", "batt_v", "evt")},
    },
    "dtc",
    ("seq", "lat", "lon", "speed_kmh", "odo_km", "soc_pct", "fuel_pct", "coolant_c", "batt_v"),
)

NESTED = Format(
    "borealis",
    ("vehicleId", "position"),
    {
        "vin": lambda get: F.upper(get("vehicleId")),
        "ts_ms": lambda get: (get("epoch") * 1000).try_cast("long"),
        "seq": _plain("counter"),
        "lat": _plain("position.latitude"),
        "lon": _plain("position.longitude"),
        "speed_kmh": lambda get: F.round(F.coalesce(get("signals.speedMph"), F.lit(0.0)) * MILE_KM, 2),
        "odo_km": lambda get: F.round(F.coalesce(get("signals.odometerMi"), F.lit(0.0)) * MILE_KM, 1),
        "soc_pct": _plain("signals.batteryPct"),
        "fuel_pct": _plain("signals.fuelPct"),
        "coolant_c": lambda get: F.round((get("signals.coolantTempF") - 32) * 5 / 9, 1),
        "batt_v": _plain("signals.lvBatteryVolts"),
        "evt": _plain("eventType"),
    },
    "faultString",
    ("epoch", "counter", "position.latitude", "position.longitude", "signals.speedMph", "signals.odometerMi", "signals.batteryPct", "signals.fuelPct", "signals.coolantTempF", "signals.lvBatteryVolts"),
)

#: Makers' formats in the order they are tried; add one here to take in another maker.
FORMATS = [FLAT, NESTED]


def _at(v: Column, path: str) -> Column:
    for name in path.split("."):
        v = v[name]
    return v


def normalise(raw: DataFrame, value_col: str = "value", formats: list[Format] | None = None, payload: str = PAYLOAD) -> DataFrame:
    """`raw` with the canonical fields, `dtcs` (null if there are none), `oem` and `reject_reason` (null if it is good).

    A format is known by the presence of its keys, null values included; the first match wins. `payload` lists all
    paths that the formats read. Rows that fit the types are parsed once; only those that do not are parsed again as
    text, to take numbers written as strings and to name what is wrong with others. Parsing and building stand in
    generators, so that no filter above is pushed below them and does the work again."""
    formats = formats or FORMATS
    columns, v, mended = [F.col(f"`{c}`") for c in raw.columns], F.col("_payload"), F.col("_mended")
    numbers = list(dict.fromkeys(p for f in formats for p in f.numbers))
    as_text = re.sub(r"\b(double|long)\b", "string", payload)
    parsed = F.from_json(F.col(value_col), f"{payload}, _unfit string", {"columnNameOfCorruptRecord": "_unfit"})

    def mend(t: Column) -> Column:
        values = [_at(t, p).try_cast("double") for p in numbers]
        misfits = [F.when(_at(t, p).isNotNull() & x.isNull(), F.lit(p)) for p, x in zip(numbers, values, strict=True)]
        return F.struct(F.array(*values).alias("numbers"), F.array_compact(F.array(*misfits)).alias("misfits"))

    raw = raw.select(*columns, F.explode(F.array(parsed)).alias("_payload"))
    again = F.when(v["_unfit"].isNotNull(), F.transform(F.array(F.from_json(F.col(value_col), as_text)), mend)[0])
    raw = raw.select(*columns, "_payload", F.explode(F.array(again)).alias("_mended"))

    def get(path: str) -> Column:
        return F.coalesce(_at(v, path), mended["numbers"][numbers.index(path)].try_cast("long" if path in ("seq", "counter") else "double")) if path in numbers else _at(v, path)

    def has(f: Format) -> Column:
        given = reduce(lambda a, b: a & b, [_at(v, k).isNotNull() for k in f.keys])
        named = F.size(F.array_intersect(F.json_object_keys(F.col(value_col)), F.array(*map(F.lit, f.keys)))) == len(f.keys)
        return F.when(given, F.lit(True)).otherwise(F.coalesce(named, F.lit(False)))

    def event(f: Format) -> Column:
        return F.struct(F.lit(f.name).alias("oem"), *[f.fields[name](get).cast(kind).alias(name) for name, kind, _ in EVENT], get(f.faults).alias("faults"))

    chain = None
    for f in formats:
        chain = F.when(has(f), event(f)) if chain is None else chain.when(has(f), event(f))
    built = raw.select(*columns, mended["misfits"].alias("_misfits"), F.explode(F.array(chain)).alias("_event"))
    e = F.col("_event")
    misfit = F.array_join(F.col("_misfits"), ",")
    missing = F.concat_ws(",", *[F.when(e[name].isNull(), F.lit(name)) for name, _, must in EVENT if must])
    reason = (
        F.when(e.isNull() & F.json_object_keys(F.col(value_col)).isNull(), "json")
        .when(e.isNull(), "format")
        .when(misfit != "", F.concat(F.lit("type:"), misfit))
        .when(missing != "", F.concat(F.lit("schema:"), missing))
    )
    codes = fault_codes(e["faults"])
    return built.select(*columns, e["oem"].alias("oem"), *[e[name].alias(name) for name, _, _ in EVENT], F.when(F.size(codes) > 0, codes).alias("dtcs"), F.left(reason, F.lit(200)).alias("reject_reason"))


def enrich(events: DataFrame, tenants: DataFrame, check_vin: bool = True) -> DataFrame:
    """Add tenant_id by vin; a vin that is malformed or unknown becomes a reject. `tenants` (vin, tenant_id) is a
    dimension whose join strategy is left to its size."""
    joined = events.join(tenants.select("vin", "tenant_id"), "vin", "left")
    bad = (F.when(~is_valid_vin(F.col("vin")), "vin") if check_vin else F.lit(None).cast("string"))
    unknown = F.when(F.col("tenant_id").isNull(), "unknown vin")
    # in a generator, as in normalise: a filter on the reason does not work it out again
    columns = [F.col(f"`{c}`") for c in joined.columns if c != "reject_reason"]
    return joined.select(*columns, F.explode(F.array(F.coalesce("reject_reason", bad, unknown))).alias("reject_reason"))


def split_rejects(events: DataFrame, value_col: str = "value") -> tuple[DataFrame, DataFrame]:
    """(good events, dead letters: the raw value and the reason)."""
    good = events.filter("reject_reason IS NULL").drop("reject_reason", value_col)
    return good, events.filter("reject_reason IS NOT NULL").select(value_col, "reject_reason")
