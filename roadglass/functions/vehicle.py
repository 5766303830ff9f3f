"""Vehicle identifiers, fault codes and positions as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: Fixed values of the VIN check digit: letter values and position weights.
VIN_LETTERS = "ABCDEFGHJKLMNPRSTUVWXYZ"
VIN_VALUES = "12345678123457923456789"
VIN_WEIGHTS = (8, 7, 6, 5, 4, 3, 2, 10, 0, 9, 8, 7, 6, 5, 4, 3, 2)

#: Known fault codes with description and severity (1 to 5); others count as severity 2.
FAULT_CODES = (
    ("P0301", "Cylinder 1 misfire detected", 3),
    ("P0217", "Engine coolant over-temperature", 5),
    ("P0420", "Catalyst efficiency below threshold", 2),
    ("P0171", "System too lean (bank 1)", 2),
    ("P0562", "System voltage low", 3),
    ("P0A80", "Replace hybrid/EV battery pack", 4),
    ("P0AA6", "HV battery isolation fault", 5),
    ("C0035", "Left front wheel speed sensor", 3),
    ("C1214", "Brake control relay circuit", 4),
    ("U0100", "Lost communication with ECM", 4),
)
UNKNOWN_CODE = ("Unknown code", 2)
SYSTEMS = {"P": "Powertrain", "C": "Chassis", "B": "Body", "U": "Network"}
FAULT_PATTERN = r"\b([PCBU][0-3][0-9A-F][0-9A-F]{2})\b"

EARTH_KM = 6371.0
GEOHASH_LETTERS = "0123456789bcdefghjkmnpqrstuvwxyz"


def vin_check_digit(vin: Column) -> Column:
    """The digit that belongs at the ninth place of a 17-character VIN."""
    digits = F.split(F.translate(F.upper(vin), VIN_LETTERS, VIN_VALUES), "").try_cast("array<int>")
    total = F.aggregate(F.zip_with(digits, F.lit(list(VIN_WEIGHTS)), lambda d, w: d * w), F.lit(0), lambda a, b: a + b)
    return F.element_at(F.lit([*"0123456789X"]), total % 11 + 1)


def is_valid_vin(vin: Column) -> Column:
    """17 characters without I, O and Q, and the right check digit; null is not valid."""
    shaped = F.upper(vin).rlike("^[A-HJ-NPR-Z0-9]{17}$")
    return F.coalesce(shaped & (F.substring(F.upper(vin), 9, 1) == vin_check_digit(vin)), F.lit(False))


def with_check_digit(vin: Column) -> Column:
    """The VIN in upper case with its ninth place made right."""
    return F.concat(F.upper(F.substring(vin, 1, 8)), vin_check_digit(vin), F.upper(F.substring(vin, 10, 8)))


def fault_codes(raw: Column) -> Column:
    """Distinct fault codes of a raw string, upper case, in order of appearance."""
    return F.array_distinct(F.regexp_extract_all(F.upper(raw), F.lit(FAULT_PATTERN), F.lit(1)))


def fault_severity(code: Column) -> Column:
    known = F.create_map(*[F.lit(x) for c, _, s in FAULT_CODES for x in (c, s)])
    return F.coalesce(known[code], F.lit(UNKNOWN_CODE[1]))


def fault_description(code: Column) -> Column:
    known = F.create_map(*[F.lit(x) for c, d, _ in FAULT_CODES for x in (c, d)])
    return F.coalesce(known[code], F.lit(UNKNOWN_CODE[0]))


def fault_system(code: Column) -> Column:
    return F.create_map(*[F.lit(x) for pair in SYSTEMS.items() for x in pair])[F.substring(code, 1, 1)]


def fault_table(spark: SparkSession) -> DataFrame:
    """The known fault codes as a small table to join."""
    return spark.createDataFrame(list(FAULT_CODES), "code string, description string, severity int")


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance."""
    dlat, dlon = F.radians(lat2 - lat1) / 2, F.radians(lon2 - lon1) / 2
    a = F.pow(F.sin(dlat), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(dlon), 2)
    return 2 * EARTH_KM * F.asin(F.sqrt(a))


def geohash(lat: Column, lon: Column, precision: int = 6) -> Column:
    """Geohash by interleaving the bits of the two cell numbers, longitude first."""
    bits = 5 * precision
    n_lon, n_lat = (bits + 1) // 2, bits // 2
    cell = lambda x, low, span, n: F.least(F.floor((x - low) / span * float(1 << n)), F.lit((1 << n) - 1)).cast("long")
    x, y = cell(lon, -180, 360, n_lon), cell(lat, -90, 180, n_lat)
    bit = lambda k: F.shiftright(x, n_lon - 1 - k // 2).bitwiseAND(F.lit(1)) if k % 2 == 0 else F.shiftright(y, n_lat - 1 - k // 2).bitwiseAND(F.lit(1))
    letters = []
    for c in range(precision):
        value = reduce(lambda a, b: a + b, [F.shiftleft(bit(5 * c + j), 4 - j) for j in range(5)])
        letters.append(F.substring(F.lit(GEOHASH_LETTERS), value.cast("int") + 1, F.lit(1)))
    return F.concat(*letters)


def masked_position(lat: Column, lon: Column, precise: Column) -> Column:
    """Struct of lat, lon, geohash, masked: exact if `precise`, else one decimal and the five-letter geohash."""
    return F.struct(
        F.when(precise, lat).otherwise(F.round(lat, 1)).alias("lat"),
        F.when(precise, lon).otherwise(F.round(lon, 1)).alias("lon"),
        F.when(precise, F.lit(None).cast("string")).otherwise(geohash(lat, lon, 5)).alias("geohash"),
        (~precise).alias("masked"),
    )
