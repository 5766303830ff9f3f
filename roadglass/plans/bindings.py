"""The supplied tables seen as a fleet. The expressions below are plain SQL that Spark and DuckDB read alike, so each
view is stated once; the operators and the SQL that checks them are written apart."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.vehicle import with_check_digit

#: Telemetry from events: one vehicle for each user.
TELEMETRY = {
    "vin": "concat('VH', lpad(cast(user_id as string), 8, '0'))",
    "user_id": "user_id",
    "tenant_id": "cast(user_id % 5 as int)",
    "ts": "ts",
    "seq": "event_id",
    "lat": "10 + (user_id * 37 % 1000) / 100e0 + (event_id * 13 % 100) / 10000e0",
    "lon": "70 + (user_id * 91 % 1500) / 100e0 + (event_id * 17 % 100) / 10000e0",
    "speed_kmh": "case when event_type = 'view' then 0e0 else value end",
    "odo_km": "1000 * (user_id % 50) + event_id / 10e0",
    "soc_pct": "cast(event_id * 7 % 101 as double)",
    "coolant_c": "case when user_id % 3 = 0 then null else 70 + value * 5e-1 end",
    "batt_v": "11 + (event_id * 11 % 35) / 10e0",
    "evt": "case event_type when 'error' then 'HARSH_BRAKE' when 'click' then 'IDLE' else null end",
    "fault_string": "case event_id % 7 when 0 then 'DTC:p0301;DTC:C0035' when 3 then 'P0217 junk u0100 P0217' else null end",
    "event_type": "event_type",
    "value": "value",
}

#: Vehicles from customers; a fleet is a nation, a tenant a region.
VEHICLES = {
    "vin": "concat('VH', lpad(cast(c_custkey as string), 8, '0'))",
    "id": "c_custkey",
    "fleet_id": "c_nationkey",
    "model": "c_mktsegment",
    "powertrain": "case c_custkey % 3 when 0 then 'EV' when 1 then 'HEV' else 'ICE' end",
    "model_year": "cast(2010 + c_custkey % 15 as int)",
    "last_service_odo_km": "cast(1000 * (c_custkey % 50) - 13 * (c_custkey % 997) as double)",
    "service_interval_km": "cast(10000 + 5000 * (c_custkey % 3) as int)",
    "balance": "c_acctbal",
}

#: Alerts from orders.
ALERTS = {
    "alert_id": "o_orderkey",
    "id": "o_custkey",
    "vin": "concat('VH', lpad(cast(o_custkey as string), 8, '0'))",
    "is_open": "o_orderstatus = 'O'",
    "severity": "cast(6 - cast(substring(o_orderpriority, 1, 1) as int) as int)",
    "rule": "concat('R', substring(o_orderpriority, 1, 1))",
    "code": "case o_orderkey % 4 when 0 then 'P0301' when 1 then 'U0100' else null end",
    "created_at": "o_orderdate",
}

#: Risk of a vehicle from its customer's balance.
RISK = "round(least(greatest((9999 - balance) / 11000e0, 0e0), 1e0), 6)"


def _select(view: dict[str, str]) -> str:
    return ", ".join(f"{e} AS {c}" for c, e in view.items())


TELEMETRY_SQL = f"telemetry AS (SELECT {_select(TELEMETRY)} FROM events)"
VEHICLES_SQL = f"""vehicles AS (
  SELECT v.*, n_regionkey AS tenant_id FROM (SELECT {_select(VEHICLES)} FROM customer) v JOIN nation ON fleet_id = n_nationkey
), risks AS (SELECT vin, id, tenant_id, model, {RISK} AS score FROM vehicles)"""
ALERTS_SQL = f"""{VEHICLES_SQL}, alerts AS (
  SELECT a.*, v.tenant_id FROM (SELECT {_select(ALERTS)} FROM orders) a JOIN vehicles v ON a.id = v.id
)"""


def read(spark: SparkSession, sf: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{table}.parquet")


def view(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    return df.select(*[F.expr(e).alias(c) for c, e in columns.items()])


def telemetry(spark: SparkSession, sf: str) -> DataFrame:
    from ..functions.vehicle import fault_codes

    t = view(read(spark, sf, "events"), TELEMETRY)
    codes = fault_codes(F.col("fault_string"))
    return t.withColumn("dtcs", F.when(F.size(codes) > 0, codes)).withColumn("ts_ms", F.unix_millis(F.col("ts").cast("timestamp")))


def vehicles(spark: SparkSession, sf: str) -> DataFrame:
    v, n = view(read(spark, sf, "customer"), VEHICLES), read(spark, sf, "nation")
    return v.join(n.select(F.col("n_nationkey").alias("fleet_id"), F.col("n_regionkey").alias("tenant_id")), "fleet_id")


def risks(spark: SparkSession, sf: str) -> DataFrame:
    return vehicles(spark, sf).select("vin", "id", "tenant_id", "model", F.expr(RISK).alias("score"))


def alerts(spark: SparkSession, sf: str) -> DataFrame:
    a = view(read(spark, sf, "orders"), ALERTS)
    return a.join(vehicles(spark, sf).select("id", "tenant_id"), "id")


#: A 17-character number for each user, before its check digit is put right.
RAW_VIN = "concat('1HGCM826', '0', 'A', lpad(cast(user_id as string), 7, '0'))"


def true_vin(df: DataFrame) -> DataFrame:
    """`df` (with user_id) plus vin17, a valid vehicle number of the user."""
    return df.withColumn("vin17", with_check_digit(F.expr(RAW_VIN)))


def payloads(spark: SparkSession, sf: str) -> DataFrame:
    """Raw JSON of both makers from events: even ids flat, odd ids nested, every 50th broken in some way."""
    e = true_vin(read(spark, sf, "events"))
    flat = F.to_json(F.struct(
        F.lower("vin17").alias("vin"), F.concat(F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSS"), F.lit("Z")).alias("ts"), F.col("event_id").alias("seq"),
        F.expr(TELEMETRY["lat"]).alias("lat"), F.expr(TELEMETRY["lon"]).alias("lon"), F.col("value").alias("speed_kmh"), F.expr(TELEMETRY["odo_km"]).alias("odo_km"),
        F.expr(TELEMETRY["soc_pct"]).alias("soc_pct"), F.expr(TELEMETRY["batt_v"]).alias("batt_v"), F.expr(TELEMETRY["evt"]).alias("evt"), F.expr("case when event_id % 7 = 0 then array('P0301', 'C0035') end").alias("dtc"),
    ))
    nested = F.to_json(F.struct(
        F.col("vin17").alias("vehicleId"), (F.expr("unix_millis(cast(ts as timestamp))") / 1000).alias("epoch"), F.col("event_id").alias("counter"),
        F.struct(F.expr(TELEMETRY["lat"]).alias("latitude"), F.expr(TELEMETRY["lon"]).alias("longitude")).alias("position"),
        F.struct(F.col("value").alias("speedMph"), F.expr(TELEMETRY["odo_km"]).alias("odometerMi"), F.expr("case when user_id % 3 <> 0 then 150 + value * 1.00003e0 end").alias("coolantTempF"), F.expr(TELEMETRY["batt_v"]).alias("lvBatteryVolts")).alias("signals"),
        F.expr(TELEMETRY["evt"]).alias("eventType"), F.expr(TELEMETRY["fault_string"]).alias("faultString"),
    ))
    good = F.when(F.col("event_id") % 2 == 0, flat).otherwise(nested)
    value = (
        F.when(F.col("event_id") % 250 == 0, F.lit("{not json"))
        .when(F.col("event_id") % 250 == 50, F.lit('{"foo":1}'))
        .when(F.col("event_id") % 250 == 100, F.regexp_replace(good, '"seq":', '"sequence":'))
        .when(F.col("event_id") % 250 == 150, F.regexp_replace(good, '"lat":', '"lat":"far","at":'))
        .when(F.col("event_id") % 250 == 200, F.regexp_replace(good, "1hgcm826", "1hgcm82i"))
        .otherwise(good)
    )
    return e.select("event_id", "user_id", "ts", value.alias("value"))


#: The check digit of RAW_VIN in SQL: weights times letter values, modulo 11.
VIN_SQL = f"""vins AS (
  SELECT *, concat(substring(raw, 1, 8), CASE WHEN m = 10 THEN 'X' ELSE cast(m AS varchar) END, substring(raw, 10)) AS vin17
  FROM (
    SELECT *, (8*d[1] + 7*d[2] + 6*d[3] + 5*d[4] + 4*d[5] + 3*d[6] + 2*d[7] + 10*d[8] + 9*d[10] + 8*d[11] + 7*d[12] + 6*d[13] + 5*d[14] + 4*d[15] + 3*d[16] + 2*d[17]) % 11 AS m
    FROM (
      SELECT *, list_transform(string_split(translate(raw, 'ABCDEFGHJKLMNPRSTUVWXYZ', '12345678123457923456789'), ''), lambda x: cast(x AS int)) AS d
      FROM (SELECT *, {RAW_VIN} AS raw FROM events)
    )
  )
)"""
