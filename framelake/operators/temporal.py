"""Series of frames and events in batch."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.names import micros
from .ordered import SLICE_ROWS, folded, sliced


def hysteresis(value: Column, on: float, off: float, keys: list[str], order: list[str]) -> Column:
    """True from a value above ``on`` until one below ``off``; nulls and values between keep the state; false at first."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    mark = F.when(value > on, True).when(value < off, False)
    return F.coalesce(F.last(mark, ignorenulls=True).over(w), F.lit(False))


def cuts(df: DataFrame, keys: list[str], time: str, tie: str, value: str, window_seconds: float, ratio: float = 4.0, floor: float = 8.0) -> DataFrame:
    """Rows whose value is at least ``floor`` and ``ratio`` times the median of the window before them (none: no cut).

    Each row's median is taken over its own window, so the work grows with rows times rows a window."""
    timed = df.withColumn("__us", micros(F.col(time)))
    w = Window.partitionBy(*keys).orderBy("__us").rangeBetween(-int(window_seconds * 1e6), -1)
    level = timed.withColumn("level", F.percentile(value, F.lit(0.5)).over(w)).drop("__us")
    return level.where(F.col("level").isNotNull() & (F.col(value) >= floor) & (F.col(value) >= ratio * F.greatest(F.col("level"), F.lit(1e-6))))


def flicker(df: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """Mean and 95th percentile of the change to the previous row of the key."""
    w = Window.partitionBy(*keys).orderBy(*order)
    step = df.withColumn("__d", F.abs(F.col(value) - F.lag(value).over(w))).where(F.col("__d").isNotNull())
    return step.groupBy(*keys).agg(F.avg("__d").alias("mean_change"), F.percentile("__d", F.lit(0.95)).alias("p95_change"), F.count(F.lit(1)).alias("n"))


def jitter(df: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """Mean absolute second difference."""
    w = Window.partitionBy(*keys).orderBy(*order)
    second = F.abs(F.lead(value).over(w) - 2 * F.col(value) + F.lag(value).over(w))
    return df.withColumn("__j", second).where(F.col("__j").isNotNull()).groupBy(*keys).agg(F.avg("__j").alias("jitter"), F.count(F.lit(1)).alias("n"))


def ramp(df: DataFrame, keys: list[str], seconds: Column, mask: Column, margin: float, fade: float) -> Column:
    """1 on masked rows and within the margin of the nearest one, falling to 0 over the fade; 0 without any."""
    marked = F.when(mask, seconds)
    back = Window.partitionBy(*keys).orderBy(seconds).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ahead = Window.partitionBy(*keys).orderBy(seconds).rowsBetween(Window.currentRow, Window.unboundedFollowing)
    gap = F.least(seconds - F.last(marked, ignorenulls=True).over(back), F.first(marked, ignorenulls=True).over(ahead) - seconds)
    return F.coalesce(F.least(F.greatest(1 - (gap - margin) / max(fade, 1e-6), F.lit(0.0)), F.lit(1.0)), F.lit(0.0))


def eta(df: DataFrame, keys: list[str], done: Column, megapixels: str, seconds: str, parallel: int) -> DataFrame:
    """Seconds left: pending megapixels over the processed ones' rate times the parallelism; null without a rate."""
    sums = df.groupBy(*keys).agg(
        F.sum(F.when(done, F.col(megapixels))).alias("mp"), F.sum(F.when(done, F.col(seconds))).alias("s"), F.sum(F.when(~done, F.col(megapixels))).alias("left_mp")
    )
    left = F.coalesce("left_mp", F.lit(0.0))
    return sums.select(*keys, F.try_divide(left * F.col("s"), F.col("mp") * parallel).alias("eta_seconds"), left.alias("left_mp"))


def latest(df: DataFrame, keys: list[str], order: list[Column], columns: list[str]) -> DataFrame:
    """Last known state of each key."""
    return df.groupBy(*keys).agg(*[F.max_by(c, F.struct(*order)).alias(c) for c in columns], F.count(F.lit(1)).alias("n_events"))


def stalled(df: DataFrame, keys: list[str], time: str, now: Column, seconds: float) -> DataFrame:
    """Keys without an event for longer than ``seconds`` before ``now`` (microseconds)."""
    last = df.groupBy(*keys).agg(F.max(micros(F.col(time))).alias("last_us"))
    return last.withColumn("idle_seconds", (now - F.col("last_us")) / 1e6).where(F.col("idle_seconds") > seconds)


def overload(daily: DataFrame, keys: list[str], day: str, demand: str, budget: float, days: int = 3) -> DataFrame:
    """Days that end a streak of ``days`` neighbouring days with more demand than budget. ``day``: a whole number."""
    w = Window.partitionBy(*keys).orderBy(day).rangeBetween(-(days - 1), 0)
    over = F.when(F.col(demand) > budget, 1).otherwise(0)
    return daily.withColumn("__n", F.sum(over).over(w)).where(F.col("__n") == days).drop("__n")


def _low_pass(dt: Column, cutoff: Column | float) -> Column:
    """Share of the new value in an exponential filter of this cutoff frequency."""
    turned = dt * cutoff * (2 * math.pi)
    return turned / (turned + 1)


def _euro_step(scale: float, min_cutoff: float, beta: float, d_cutoff: float):
    """One step of the adaptive low-pass over rows with ``t, v``; the state is the last value and its speed. A row may bring its own ``scale``."""

    def step(state: Column, x: Column) -> tuple[dict[str, Column], Column]:
        first, gap = state["t"].isNull(), x["v"] - state["y"]
        dt = F.greatest(F.abs(x["t"] - state["t"]), F.lit(1e-6))
        speed = F.when(first, 0.0).otherwise(state["speed"] + _low_pass(dt, d_cutoff) * (gap / dt - state["speed"]))
        share = _low_pass(dt, min_cutoff + beta / max(scale, 1e-6) * F.abs(speed))
        y = F.when(first, x["v"]).otherwise(state["y"] + share * gap)
        return {"t": x["t"], "y": y, "speed": speed}, y

    return step


def one_euro(
    df: DataFrame, key: str, time: str, tie: str, value: str, scale: float = 1.0, min_cutoff: float = 1.0, beta: float = 0.5, d_cutoff: float = 1.0,
    zero_lag: bool = False, slice_rows: int = SLICE_ROWS,
) -> DataFrame:
    """``key, tie, smooth``: each key's series through an adaptive low-pass (the faster it moves, the higher the cutoff), in order of
    time; with ``zero_lag`` the mean of a forward and a backward pass. Null values are left out.

    The recursion is carried from slice to slice (``ordered.folded``), so a series of any length needs no row of its own.
    """
    seconds = F.col(time) if dict(df.dtypes)[time] in ("double", "float") else micros(F.col(time)) / 1e6
    points = df.where(F.col(value).isNotNull()).select(F.col(key).alias("__series"), seconds.alias("t"), F.col(tie).alias("tie"), F.col(value).cast("double").alias("v"))
    none = F.lit(None).cast("double")
    start, step = {"t": none, "y": none, "speed": F.lit(0.0)}, _euro_step(scale, min_cutoff, beta, d_cutoff)
    slices = sliced(points, "__series", ["t", "tie"], ["t", "tie", "v"], slice_rows)
    found = folded(slices, start, step, "double")
    if zero_lag:
        back = folded(slices, start, step, "double", backward=True).select(F.col("__key").alias("__k"), F.col("__slice").alias("__s"), F.col("__out").alias("__back"))
        found = found.join(back, F.col("__key").eqNullSafe(F.col("__k")) & (F.col("__slice") == F.col("__s")))
        found = found.withColumn("__out", F.zip_with("__out", "__back", lambda a, b: (a + b) / 2))
    rows = F.zip_with("__rows", "__out", lambda p, y: F.struct(p["tie"].alias("tie"), y.alias("y")))
    return found.select(F.col("__key").alias(key), F.explode(rows).alias("x")).select(key, F.col("x.tie").alias(tie), F.col("x.y").alias("smooth"))


def as_of(
    left: DataFrame, right: DataFrame, keys: list[str], left_time: str, right_time: str, right_columns: list[str], tie: str, slice_width: int | None = None
) -> DataFrame:
    """Each left row with the last right row of its key that is not later (null if none).

    Both sides are stacked and the last right row carried forward, so keys shuffle once and nothing is paired up. With
    ``slice_width`` a key's time is cut into slices that are carried one by one; what an earlier slice hands on is one row a
    slice, so few keys still give many tasks.
    """
    payload = F.struct(F.col(right_time).alias("__at"), *right_columns)
    kind = right.select(payload.alias("p")).schema["p"].dataType
    names = left.columns
    part = lambda t: F.floor(F.col(t) / slice_width).cast("long") if slice_width else F.lit(0).cast("long")
    a = left.withColumns({
        "__t": F.col(left_time), "__slice": part(left_time), "__side": F.lit(1), "__tie": F.lit(None).cast(right.schema[tie].dataType), "__r": F.lit(None).cast(kind)
    })
    b = right.where(F.col(right_time).isNotNull()).select(
        *keys, F.col(right_time).alias("__t"), part(right_time).alias("__slice"), F.lit(0).alias("__side"), F.col(tie).alias("__tie"), payload.alias("__r")
    )
    own = [*keys, "__slice"]
    w = Window.partitionBy(*own).orderBy("__t", "__side", "__tie").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    carried = a.unionByName(b, allowMissingColumns=True).withColumn("__r", F.last("__r", ignorenulls=True).over(w)).where("__side = 1")
    if slice_width:
        lasts = b.groupBy(*own).agg(F.max_by("__r", F.struct("__t", "__tie")).alias("__last"))
        present = lasts.unionByName(left.select(*keys, part(left_time).alias("__slice")).distinct(), allowMissingColumns=True).groupBy(*own).agg(F.max("__last").alias("__last"))
        before = Window.partitionBy(*keys).orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)
        handed = present.withColumn("__before", F.last("__last", ignorenulls=True).over(before)).drop("__last")
        carried = carried.join(handed, own, "left").withColumn("__r", F.coalesce("__r", "__before"))
    return carried.select(*names, F.col("__r.__at").alias(f"matched_{right_time}"), *[F.col(f"__r.{c}").alias(f"matched_{c}") for c in right_columns])
