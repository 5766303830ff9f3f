"""Questions that the fleet's users ask: pages, tops, details, and the changes they make, over whole tables of requests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F
from pyspark.sql.types import IntegralType

from ..functions.text import cursor, read_cursor
from ..functions.vehicle import EARTH_KM, haversine_km, masked_position
from ..sources.sinks import audit_rows

#: What each role may do.
ROLES = {
    "admin": ("read", "ack", "approve", "erase", "audit", "copilot", "precise_location"),
    "fleet_manager": ("read", "ack", "approve", "copilot", "precise_location"),
    "analyst": ("read", "copilot"),
}

#: Fixed values of the savings estimate.
BREAKDOWN_USD = 2400
PLANNED_USD = 650
REPAIRED_SHARE = 0.35


def role_permissions(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(r, p) for r, perms in ROLES.items() for p in perms], "role string, perm string")


def allowed(requests: DataFrame, permissions: DataFrame) -> DataFrame:
    """The requests (with role and perm) whose role has the permission."""
    return requests.join(permissions, ["role", "perm"], "left_semi")


def tenant_scope(df: DataFrame, tenant: int, column: str = "tenant_id") -> DataFrame:
    """One tenant's rows; the filter is a plain literal so that it reaches the scan."""
    return df.filter(F.col(column) == tenant)


def mask_positions(df: DataFrame, role: Column | str) -> DataFrame:
    """lat and lon replaced by what the row's role may see, with geohash and masked."""
    precise = F.lit(role).isin([r for r, p in ROLES.items() if "precise_location" in p]) if isinstance(role, str) else role.isin([r for r, p in ROLES.items() if "precise_location" in p])
    seen = df.withColumn("_seen", masked_position(F.col("lat"), F.col("lon"), F.coalesce(precise, F.lit(False))))
    return seen.drop("lat", "lon").select("*", "_seen.*").drop("_seen")


def page_after(df: DataFrame, *, key: str, cursor: str | None, limit: int, descending: bool = False) -> DataFrame:
    """The page after a cursor, from the beginning without one; a cursor that can't be read or whose key is not of the
    column's type is an error before any job runs."""
    after = read_cursor(cursor)
    if after is not None and isinstance(df.schema[key].dataType, IntegralType):
        after = int(after)
    return keyset_page(df, key=key, after=after, limit=limit, descending=descending)


def keyset_page(df: DataFrame, *, key: str, after, limit: int, descending: bool = False) -> DataFrame:
    """The next page in key order. next_cursor is the last key's cursor if the page is full, else null."""
    if after is not None:
        df = df.filter(F.col(key) < after if descending else F.col(key) > after)
    page = df.orderBy(F.desc(key) if descending else F.asc(key)).limit(limit)
    whole = Window.partitionBy(F.lit(0))  # over one page
    last = F.min(key).over(whole) if descending else F.max(key).over(whole)
    return page.withColumn("next_cursor", F.when(F.count(F.lit(1)).over(whole) == limit, cursor(last)))


def top_per_group(df: DataFrame, *, group: str, score: str, tie: str, limit: int) -> DataFrame:
    """The best `limit` rows of every group; Spark keeps only that many per group before the shuffle."""
    w = Window.partitionBy(group).orderBy(F.desc(score), F.asc(tie))
    return df.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= limit)


def recent(df: DataFrame, *, ts: str, since, limit: int, tie: str) -> DataFrame:
    """The last `limit` rows from `since` on, in ascending order."""
    return df.filter(F.col(ts) >= since).orderBy(F.desc(ts), F.desc(tie)).limit(limit).orderBy(ts, tie)


def fleet_kpis(vehicles: DataFrame, alerts: DataFrame, risks: DataFrame) -> DataFrame:
    """One row: vehicles, open and critical alerts, vehicles at high risk. One pass over each table."""
    a = vehicles.agg(F.count(F.lit(1)).alias("vehicles"))
    b = alerts.agg(F.count_if("is_open").alias("open_alerts"), F.count_if(F.col("is_open") & (F.col("severity") >= 4)).alias("critical_alerts"))
    c = risks.agg(F.count_if(F.col("score") >= 0.3).alias("high_risk"))
    return a.join(b).join(c)  # one row each


def estimate_savings(risks: DataFrame, top: int = 50) -> DataFrame:
    """What servicing the vehicles at highest risk is expected to save."""
    best = risks.orderBy(F.desc("score"), "vin").limit(min(top, 200))
    sums = best.agg(F.coalesce(F.sum("score"), F.lit(0.0)).alias("expected"), F.count(F.lit(1)).alias("vehicles"))
    avoided, spend = F.col("expected") * BREAKDOWN_USD, F.col("vehicles") * PLANNED_USD * REPAIRED_SHARE
    return sums.select("vehicles", F.round("expected", 1).alias("expected_breakdowns"), F.round(avoided).cast("long").alias("avoided_usd"), F.round(spend).cast("long").alias("planned_usd"), F.round(avoided - spend).cast("long").alias("net_usd"))


def vehicle_summary(vehicles: DataFrame, risks: DataFrame, alerts: DataFrame, last: int = 10) -> DataFrame:
    """Each vehicle with its risk, what drives it and its last alerts with their codes. Alerts are cut to the last few
    per vehicle before anything is gathered. `risks` may carry factors, an array of structs with a label."""
    few = top_per_group(alerts, group="vin", score="alert_id", tie="alert_id", limit=last)
    gathered = few.groupBy("vin").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "rule", "severity", "code"))), lambda a: F.concat_ws("/", a["rule"], a["severity"], a["code"])).alias("recent"))
    drivers = F.array_join(F.transform("factors", lambda x: x["label"]), ",").alias("drivers") if "factors" in risks.columns else F.lit(None).cast("string").alias("drivers")
    told = risks.select("vin", "score", drivers)
    return vehicles.join(told, "vin", "left").join(gathered, "vin", "left").withColumn("recent", F.array_join("recent", ","))


def vehicle_series(telemetry: DataFrame, *, until, minutes: int = 30, limit: int = 60) -> DataFrame:
    """(vin, series, live): each vehicle's last samples of the minutes before `until`, oldest first, and its newest row.

    Samples are cut to `limit` per vehicle before they are gathered; the time bound reaches the scan."""
    end = F.lit(until)
    now = telemetry.filter((F.col("ts") > end - F.expr(f"interval {minutes} minutes")) & (F.col("ts") <= end)).select("vin", "ts", "seq", "speed_kmh", "batt_v")
    few = now.withColumn("_nth", F.row_number().over(Window.partitionBy("vin").orderBy(F.desc("ts"), F.desc("seq")))).filter(F.col("_nth") <= limit)
    series = few.groupBy("vin").agg(F.sort_array(F.collect_list(F.struct("ts", "seq", "speed_kmh", "batt_v"))).alias("series"))
    rest = ["seq", "ts", "lat", "lon", "speed_kmh"]
    live = telemetry.filter(F.col("ts") <= end).groupBy("vin").agg(F.max_by(F.struct(*rest), "seq").alias("live"))
    return live.join(series, "vin", "left").select("vin", "series", "live")


def radius_search(points: DataFrame, *, lat: float, lon: float, radius_km: float) -> DataFrame:
    """Points within the radius: a bounding box that reaches the scan, then the exact distance."""
    from math import cos, radians

    dlat = radius_km / 111.0
    near = points.filter(F.col("lat").between(lat - dlat, lat + dlat))
    if abs(lat) + dlat < 89:
        dlon = radius_km / (111.0 * cos(radians(abs(lat) + dlat)))
        near = near.filter(F.col("lon").between(lon - dlon, lon + dlon)) if dlon < 180 and abs(lon) + dlon <= 180 else near
    return near.withColumn("km", haversine_km(F.lit(lat), F.lit(lon), F.col("lat"), F.col("lon"))).filter(F.col("km") <= radius_km)


#: Points of one cell that meet its centres in one group of rows.
CELL_POINTS = 50_000
#: Levels by which the grid of a circle is finer than the circle.
FINER = 2


def _reach(lat: Column, km: Column) -> tuple[Column, Column]:
    """Half height and half width in degrees of a box around the circle; a circle with a pole inside has all longitudes."""
    dlat = F.degrees(km / EARTH_KM)
    wide = F.sin(F.radians(F.least(dlat, F.lit(90.0)))) / F.cos(F.radians(F.abs(lat)))
    return dlat, F.when((F.abs(lat) + dlat >= 90) | (wide >= 1), F.lit(180.0)).otherwise(F.degrees(F.asin(F.least(wide, F.lit(1.0)))))


def radius_join(points: DataFrame, centres: DataFrame, *, cell_points: int = CELL_POINTS) -> DataFrame:
    """Every pair of a point (lat, lon) and a centre (centre, lat, lon, radius_km) within the centre's radius: the point's
    columns, centre and km.

    A centre takes a grid whose cells are FINER levels smaller than its circle (level l has 2^l rows and columns), so at
    most nine by nine cells cover it and these are about twice as large as it is, and points meet it through these cells
    only: an equi-join, with the exact distance behind. A point is placed once on every level that centres use. A cell with more than `cell_points` points is split, and its
    centres go to every part. Points or centres without a place, and negative or null radii, match nothing."""
    rows = lambda level: F.pow(F.lit(2.0), level)
    placed = centres.filter("lat IS NOT NULL AND lon IS NOT NULL AND radius_km >= 0").select("centre", F.col("lat").cast("double").alias("_lat"), F.col("lon").cast("double").alias("_lon"), F.col("radius_km").cast("double").alias("_km"))
    dlat, dlon = _reach(F.col("_lat"), F.col("_km") + 1e-6)
    fits = F.floor(F.log2(F.least(180 / dlat, 360 / dlon)))
    placed = placed.withColumns({"_dlat": dlat, "_dlon": dlon, "_level": F.greatest(F.lit(0), F.least(F.lit(20), fits + FINER)).cast("int")})
    row = lambda lat: F.floor((lat + 90) / 180 * rows(F.col("_level")))
    column = lambda lon: F.floor((lon + 180) / 360 * rows(F.col("_level")))
    most = rows(F.col("_level")) - 1
    low, high = F.greatest(row(F.col("_lat") - F.col("_dlat")), F.lit(0)), F.least(row(F.col("_lat") + F.col("_dlat")), most.cast("long"))
    west = column(F.col("_lon") - F.col("_dlon"))
    east = F.least(column(F.col("_lon") + F.col("_dlon")), west + most.cast("long"))
    covered = placed.withColumn("_row", F.explode(F.sequence(low, high))).withColumn("_column", F.explode(F.sequence(west, east)))
    covered = covered.withColumn("_column", F.pmod("_column", rows(F.col("_level")).cast("long"))).drop("_dlat", "_dlon")

    levels = sorted(r["_level"] for r in placed.select("_level").distinct().collect())  # 21 at most
    own = points.filter("lat IS NOT NULL AND lon IS NOT NULL").withColumn("_level", F.explode(F.array(*map(F.lit, levels)).cast("array<int>")))
    own = own.withColumn("_row", F.least(row(F.col("lat").cast("double")), most.cast("long"))).withColumn("_column", F.pmod(column(F.col("lon").cast("double")), rows(F.col("_level")).cast("long")))
    cell = ["_level", "_row", "_column"]
    asked = covered.select(*cell).distinct()
    hot = own.join(asked, cell, "left_semi").groupBy(*cell).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > cell_points).select(*cell, F.ceil(F.col("_n") / cell_points).alias("_parts"))
    part = F.coalesce("_parts", F.lit(1).cast("long"))
    left = own.join(hot, cell, "left").withColumn("_part", F.pmod(F.xxhash64(*points.columns), part)).drop("_parts")
    right = covered.join(hot, cell, "left").withColumn("_part", F.explode(F.sequence(F.lit(0).cast("long"), part - 1))).drop("_parts")
    met = left.join(right, [*cell, "_part"]).withColumn("km", haversine_km(F.col("_lat"), F.col("_lon"), F.col("lat"), F.col("lon")))
    return met.filter(F.col("km") <= F.col("_km")).select(*points.columns, "centre", "km")


def radius_totals(points: DataFrame, centres: DataFrame, *, value: str, cell_points: int = CELL_POINTS) -> DataFrame:
    """(centre, n, total, farthest): how many points lie within each centre's radius, the sum of their `value` and the
    largest distance in km; centres without points are left out.

    Points at one place are added up first, and equal circles are asked once, so the pairs of `radius_join` are those of
    places and circles, however many points and centres share them; no pair of a point and a centre is made."""
    at = ["lat", "lon"]
    places = points.filter("lat IS NOT NULL AND lon IS NOT NULL").select(*[F.col(c).cast("double").alias(c) for c in at], value)
    places = places.groupBy(*at).agg(F.count(F.lit(1)).alias("_n"), F.sum(value).alias("_total"))
    circle = F.struct(*[F.col(c).cast("double").alias(c) for c in (*at, "radius_km")])
    named = centres.filter("lat IS NOT NULL AND lon IS NOT NULL AND radius_km >= 0").select("centre", circle.alias("_circle"))
    circles = named.select("_circle").distinct().select(F.col("_circle").alias("centre"), "_circle.*")
    sums = radius_join(places, circles, cell_points=cell_points).groupBy(F.col("centre").alias("_circle")).agg(F.sum("_n").alias("_n"), F.sum("_total").alias("_total"), F.max("km").alias("_km"))
    return named.join(sums, "_circle").groupBy("centre").agg(F.sum("_n").alias("n"), F.sum("_total").alias("total"), F.max("_km").alias("farthest"))


#: Events and assignments of one key that one task merges, about, and the most slices of a key.
MERGED = 1_000_000
CUTS = 1_000


def assignment_at(events: DataFrame, assignments: DataFrame, *, key: str, ts: str, merged: int = MERGED) -> DataFrame:
    """Events with the assignment of their key that began last at or before them, if it still holds (t < valid_to, an open
    end allowed). Where intervals do not overlap these are the rows of `interval_join`; where they do, only the newest counts.

    Both tables are merged in one sort by key and time, and the last assignment is carried forward, so a key with many of
    both makes no product. A key with over `merged` rows is cut by time into slices of about that many, each of which
    begins with what the slices before it carry. Of assignments that begin together the largest counts. Events without
    key or time match nothing."""
    held = [c for c in assignments.columns if c != key]
    rest = [c for c in events.columns if c != key]
    e = events.filter(F.col(key).isNotNull() & F.col(ts).isNotNull()).select(key, F.col(ts).alias("_t"), F.lit(1).alias("_kind"), F.struct(*rest).alias("_e"))
    a = assignments.filter(F.col(key).isNotNull() & F.col("valid_from").isNotNull()).select(key, F.col("valid_from").cast(e.schema["_t"].dataType).alias("_t"), F.lit(0).alias("_kind"), F.struct("valid_from", *[c for c in held if c != "valid_from"]).alias("_a"))
    both = e.unionByName(a, allowMissingColumns=True)
    sizes = both.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > merged)
    micros = F.unix_micros(F.col("_t").cast("timestamp"))
    # an even number of cuts for each long key; a table of long keys only
    cuts = both.join(sizes, key).groupBy(key).agg(F.percentile_approx(micros, F.array(*[F.lit(k / CUTS) for k in range(1, CUTS)]), 10_000).alias("_cuts"), F.first("_n").alias("_n"))
    step = F.greatest(F.lit(1), F.floor(CUTS * F.lit(merged) / F.col("_n"))).cast("int")
    cuts = cuts.select(key, F.array_distinct(F.filter("_cuts", lambda c, i: (i + 1) % step == 0)).alias("_cuts"))
    sliced = both.join(cuts, key, "left").withColumn("_slice", F.coalesce(F.size(F.filter("_cuts", lambda c: c <= micros)), F.lit(0)))

    ends = sliced.filter("_kind = 0 AND _cuts IS NOT NULL").groupBy(key, "_slice").agg(F.max(F.struct("_t", "_a")).alias("_end"))
    every = cuts.select(key, F.explode(F.sequence(F.lit(0), F.size("_cuts"))).alias("_slice")).join(ends, [key, "_slice"], "left")
    before = Window.partitionBy(key).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)  # a row for each slice
    carried = every.select(key, "_slice", F.last("_end._a", ignorenulls=True).over(before).alias("_carried"))

    forward = Window.partitionBy(key, "_slice").orderBy("_t", "_kind", "_a").rowsBetween(Window.unboundedPreceding, 0)
    merged_rows = sliced.drop("_cuts").withColumn("_last", F.last("_a", ignorenulls=True).over(forward)).filter("_kind = 1")
    told = merged_rows.join(carried, [key, "_slice"], "left").withColumn("_now", F.coalesce("_last", "_carried"))
    holds = F.col("_now").isNotNull() & (F.col("_now.valid_to").isNull() | (F.col("_t") < F.col("_now.valid_to")))
    return told.filter(holds).select(key, "_e.*", *[F.col(f"_now.{c}").alias(c) for c in held]).select(*events.columns, *held)


def interval_join(events: DataFrame, assignments: DataFrame, *, key: str, ts: str) -> DataFrame:
    """Events with the assignment that holds at their time: valid_from <= t < valid_to, open end allowed."""
    e, a = events.alias("e"), assignments.alias("a")
    holds = (F.col(f"e.{key}") == F.col(f"a.{key}")) & (F.col(f"e.{ts}") >= F.col("a.valid_from")) & (F.col("a.valid_to").isNull() | (F.col(f"e.{ts}") < F.col("a.valid_to")))
    return e.join(a, holds).select("e.*", *[F.col(f"a.{c}") for c in assignments.columns if c != key])


def acknowledge(alerts: DataFrame, requests: DataFrame) -> DataFrame:
    """Alerts after (alert_id, tenant_id, user_id, at) requests: open alerts of the request's tenant get acked_by and acked_at.

    Of several requests for an alert the earliest is recorded (ties: the smallest user)."""
    asked = requests.groupBy("alert_id", "tenant_id").agg(F.min(F.struct("at", "user_id")).alias("_asked"))
    hit = F.col("_asked").isNotNull() & F.col("acked_by").isNull()
    out = alerts.join(asked, ["alert_id", "tenant_id"], "left").withColumn("changed", hit)
    return out.withColumns({"acked_by": F.when(hit, F.col("_asked.user_id")).otherwise(F.col("acked_by")), "acked_at": F.when(hit, F.col("_asked.at")).otherwise(F.col("acked_at"))}).drop("_asked")


def decide(orders: DataFrame, decisions: DataFrame) -> DataFrame:
    """Work orders after (work_order_id, tenant_id, approve, user_id) decisions; only proposed ones move, and who decided
    is recorded in approved_by. Of several decisions on an order one refusal is enough; of those that agree with the
    outcome the smallest user is recorded."""
    said = decisions.groupBy("work_order_id", "tenant_id").agg(
        F.bool_and("approve").alias("_ok"), F.min(F.when(F.col("approve"), F.col("user_id"))).alias("_yes"), F.min(F.when(~F.col("approve"), F.col("user_id"))).alias("_no")
    )
    hit = F.col("_ok").isNotNull() & (F.col("status") == "proposed")
    moved = F.when(hit, F.when(F.col("_ok"), "approved").otherwise("rejected")).otherwise(F.col("status"))
    by = F.when(hit, F.when(F.col("_ok"), F.col("_yes")).otherwise(F.col("_no"))).otherwise(F.col("approved_by"))
    return orders.join(said, ["work_order_id", "tenant_id"], "left").withColumns({"status": moved, "approved_by": by}).drop("_ok", "_yes", "_no")


def propose(vehicles: DataFrame, requests: DataFrame) -> DataFrame:
    """New work orders for (vin, tenant_id, reason, user_id) requests on vehicles of that tenant; vins are read in upper
    case, the reason is cut at 300. An order's id is a hash of what it asks for, so the same request twice is one order."""
    asked = requests.select(F.upper("vin").alias("vin"), "tenant_id", F.left("reason", F.lit(300)).alias("reason"), F.col("user_id").alias("proposed_by"))
    own = asked.join(vehicles.select("vin", "tenant_id"), ["vin", "tenant_id"], "left_semi").dropDuplicates(["tenant_id", "vin", "reason", "proposed_by"])
    return own.select(
        F.xxhash64("tenant_id", "vin", "reason", "proposed_by").alias("work_order_id"), "tenant_id", "vin", "reason", "proposed_by",
        F.lit(float(PLANNED_USD)).alias("est_cost_usd"), F.lit("proposed").alias("status"),
    )


def erase(people: DataFrame, requests: DataFrame, *, id_col: str, at, columns: list[str]) -> DataFrame:
    """People with personal columns nulled where their own tenant asks, by (id, tenant_id) requests; who is erased already
    keeps the first time."""
    asked = requests.select(id_col, "tenant_id").distinct().withColumn("_asked", F.lit(True))
    hit = F.coalesce("_asked", F.lit(False))
    out = people.join(asked, [id_col, "tenant_id"], "left")
    blank = {c: F.when(hit, F.lit(None)).otherwise(F.col(c)) for c in columns}
    return out.withColumns(blank | {"erased_at": F.coalesce("erased_at", F.when(hit, F.lit(at)))}).drop("_asked")


def erase_audited(people: DataFrame, requests: DataFrame, *, id_col: str, at, columns: list[str]) -> tuple[DataFrame, DataFrame]:
    """`erase` by (id, tenant_id, user_id) requests, and its audit rows: one for each person who is erased by this, with
    who asked (the smallest user of several). Requests that change nothing leave no row."""
    done = people.filter("erased_at IS NULL").join(requests.groupBy(id_col, "tenant_id").agg(F.min("user_id").alias("_by")), [id_col, "tenant_id"])
    resource = F.concat(F.lit(f"{id_col}/"), F.col(id_col).cast("string"))
    audit = audit_rows(done, actor=F.concat(F.lit("user"), F.col("_by").cast("string")), action="erase", resource=resource, detail=F.lit(",".join(columns)))
    return erase(people, requests, id_col=id_col, at=at, columns=columns), audit
