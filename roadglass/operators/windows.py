"""Event-time windows per key. Every frame is built in, so rows stream through one sort per key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .ordering import numbered


def _micros(ts: str) -> Column:
    return F.unix_micros(F.col(ts).cast("timestamp"))


def sliding_window(df: DataFrame, *, key: str, ts: str, value: str, seconds: int) -> DataFrame:
    """Mean, maximum and count of `value` over [t - seconds, t] for each row; rows without a value are left out."""
    w = Window.partitionBy(key).orderBy(_micros(ts)).rangeBetween(-seconds * 1_000_000, 0)
    return df.filter(F.col(value).isNotNull()).withColumns({"win_mean": F.avg(value).over(w), "win_max": F.max(value).over(w), "win_count": F.count(value).over(w)})


def late_flags(df: DataFrame, *, key: str, seq: str, arrival: str) -> DataFrame:
    """Mark rows whose sequence number does not exceed all that arrived before them for their key."""
    before = Window.partitionBy(key).orderBy(arrival).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn("is_late", F.col(seq) <= F.coalesce(F.max(seq).over(before), F.lit(-1)))


def rolling_upper_median(df: DataFrame, *, key: str, order: str, value: str, rows: int = 50) -> DataFrame:
    """Upper median of the last `rows` values for each row."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(1 - rows, 0)
    last = F.sort_array(F.collect_list(value).over(w))
    return df.withColumn("rolling_median", F.element_at(last, (F.floor(F.size(last) / 2) + 1).cast("int")))


def islands(df: DataFrame, *, key: str, position: str, flag: str) -> DataFrame:
    """Runs of flag = 1 as (key, first, last), inclusive positions. Positions count 0, 1, ... within each key, so a
    run is what shares position minus rank among flagged rows."""
    on = df.filter(F.col(flag) == 1)
    run = F.col(position) - F.row_number().over(Window.partitionBy(key).orderBy(position))
    return on.withColumn("_run", run).groupBy(key, "_run").agg(F.min(position).alias("first"), F.max(position).alias("last")).drop("_run")


def latest(df: DataFrame, *, key: str, seq: str) -> DataFrame:
    """The row of the largest sequence number for each key, by a map-side combined maximum."""
    rest = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.max_by(F.struct(*rest), seq).alias("_row")).select(key, "_row.*")


def stride_sample(df: DataFrame, *, key: str, limit: int, cells: int = 64) -> DataFrame:
    """About every k-th row in the order of (hash cell, key), at most `limit`, where k = ceil(rows / limit).

    Rows are numbered range by range, with as many ranges as the table asks for; no task sorts a cell or the table."""
    from math import ceil

    total = df.count()
    if total <= limit:
        return df
    step = ceil(total / limit)
    digits = F.substring(F.md5(F.col(key).cast("string").cast("binary")), 1, 6)
    celled = df.withColumn("_cell", F.pmod(F.conv(F.coalesce(digits, F.lit("0")), 16, 10).cast("int"), F.lit(cells)))
    return numbered(celled, "_cell", key).filter((F.col("_at") % step == 0) & (F.col("_at") < step * limit)).drop("_cell", "_at")
