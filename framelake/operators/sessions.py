"""Cutting ordered captures into sets, bursts and runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.names import micros


def cut_at(df: DataFrame, keys: list[str], order: list[Column | str], starts: Column, name: str) -> DataFrame:
    """``df`` with a running number per key, which grows where ``starts`` (over the previous row) holds or is null.

    Shuffles once by ``keys``; rows of a key are ordered within their partition.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    flagged = df.withColumn("__starts", F.when(F.coalesce(starts, F.lit(True)), 1).otherwise(0))
    upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return flagged.withColumn(name, F.sum("__starts").over(upto)).drop("__starts")


def gap_sets(df: DataFrame, keys: list[str], time: str, tie: str, gap_seconds: float, name: str = "set_no") -> DataFrame:
    """A new set where more than the gap passed since the previous row of the key."""
    w = Window.partitionBy(*keys).orderBy(time, tie)
    before = F.lag(micros(F.col(time))).over(w)
    return cut_at(df, keys, [time, tie], micros(F.col(time)) - before > int(gap_seconds * 1e6), name)


def calendar_sets(df: DataFrame, time: str, unit: str, name: str = "set_start") -> DataFrame:
    """Sets by whole hours or days: the truncated time, in microseconds."""
    width = {"hour": 3_600_000_000, "day": 86_400_000_000}[unit]
    return df.withColumn(name, F.floor(micros(F.col(time)) / width).cast("long") * width)


def bursts(
    df: DataFrame, keys: list[str], time: str, tie: str, max_gap_seconds: float, same: list[str], near: Column | None = None
) -> DataFrame:
    """Rows of bursts (two rows at least) with ``burst_no`` and ``gap`` (seconds, null at its first row).

    A row joins the burst of the row before it if the gap is small enough, the ``same`` columns agree (null never
    agrees) and ``near`` holds. Null times never join. Numbers count single rows too, so they have gaps.
    """
    timed = df.where(F.col(time).isNotNull())
    w = Window.partitionBy(*keys).orderBy(time, tie)
    gap = (micros(F.col(time)) - micros(F.lag(time).over(w))) / 1e6
    joins = gap <= max_gap_seconds
    for c in same:
        joins = joins & F.coalesce(F.lag(c).over(w) == F.col(c), F.lag(F.lit(1)).over(w).isNull())
    if near is not None:
        joins = joins & near
    cut = cut_at(timed, keys, [time, tie], ~F.coalesce(joins, F.lit(False)), "burst_no")
    own = Window.partitionBy(*keys, "burst_no")
    inner = own.orderBy(time, tie)
    sized = cut.withColumn("burst_size", F.count(F.lit(1)).over(own)).where("burst_size > 1")
    return sized.withColumn("gap", (micros(F.col(time)) - micros(F.lag(time).over(inner))) / 1e6)


def burst_summary(rows: DataFrame, keys: list[str], max_gap_seconds: float, distance: Column | None = None, max_distance: int = 18) -> DataFrame:
    """One row per burst with its confidence: 0.45 for tight gaps, 0.35 for small distances, 0.20 for being one."""
    far = F.max(distance) if distance is not None else F.lit(0)
    confidence = 0.45 * (1 - F.max("gap") / max(max_gap_seconds, 1e-6)) + 0.35 * (1 - far / max(max_distance, 1)) + 0.20
    return rows.groupBy(*keys, "burst_no").agg(
        F.count(F.lit(1)).alias("n"), F.max("gap").alias("max_gap"), F.least(F.greatest(confidence, F.lit(0.0)), F.lit(1.0)).alias("confidence")
    )


def shots(files: DataFrame, path: str, photo_extensions: list[str]) -> DataFrame:
    """Files of one exposure: ``shot_key, files`` for the keys that have a photo among them."""
    from ..functions.names import shot_key

    ext = F.lower(F.element_at(F.split(F.col(path), r"\."), -1))
    keyed = files.select(path, shot_key(F.col(path)).alias("shot_key"), ext.isin(photo_extensions).alias("__photo"))
    grouped = keyed.groupBy("shot_key").agg(F.array_sort(F.collect_list(path)).alias("files"), F.max("__photo").alias("__photo"))
    return grouped.where("__photo").drop("__photo")
