"""Whole tracks: shots, gap filling, zero-lag smoothing, fading, and how far a region strays from its own normal."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import saved
from .ordered import SLICE_ROWS
from .robust import by_size
from .temporal import one_euro

#: Regions whose change counts as the frame's own, the calmest first.
COMMON_REGIONS = 3
COLOUR_FLOOR, TEXTURE_FLOOR = 1.0, 0.05
PASSES = 3


def _carried(df: DataFrame, keys: list[str], order: str, width: int, values: dict[str, Column]) -> DataFrame:
    """``df`` with, for each of ``values``, the last non-null value of an earlier row of the key (``order``: a whole number).

    Slices of ``width`` are carried one by one; of each slice one row is handed on, so a key's rows are never in one window.
    """
    cut = df.withColumn("__slice", F.floor(F.col(order) / width)).withColumns({f"__v_{n}": v for n, v in values.items()})
    own = Window.partitionBy(*keys, "__slice").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    near = cut.withColumns({n: F.last(f"__v_{n}", ignorenulls=True).over(own) for n in values})
    lasts = cut.groupBy(*keys, "__slice").agg(*[F.max_by(f"__v_{n}", F.when(F.col(f"__v_{n}").isNotNull(), F.col(order))).alias(f"__l_{n}") for n in values])
    before = Window.partitionBy(*keys).orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)
    handed = lasts.select(*[F.col(k).alias(f"__k_{k}") for k in keys], F.col("__slice").alias("__of"), *[F.last(f"__l_{n}", ignorenulls=True).over(before).alias(f"__b_{n}") for n in values])
    same = [F.col(k).eqNullSafe(F.col(f"__k_{k}")) for k in keys]
    met = near.join(handed, [F.col("__slice") == F.col("__of"), *same])
    return met.select(*df.columns, *[F.coalesce(n, f"__b_{n}").alias(n) for n in values])


def _counted(df: DataFrame, keys: list[str], order: str, width: int, mark: Column, name: str) -> DataFrame:
    """``df`` with the number of marked rows of the key up to this one, by slices like ``_carried``."""
    cut = df.withColumn("__slice", F.floor(F.col(order) / width)).withColumn("__m", mark.cast("long"))
    own = Window.partitionBy(*keys, "__slice").orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    near = cut.withColumn(name, F.sum("__m").over(own))
    sums = cut.groupBy(*keys, "__slice").agg(F.sum("__m").alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.partitionBy(*keys).orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    handed = sums.select(*[F.col(k).alias(f"__k_{k}") for k in keys], F.col("__slice").alias("__of"), before.alias("__before"))
    same = [F.col(k).eqNullSafe(F.col(f"__k_{k}")) for k in keys]
    return near.join(handed, [F.col("__slice") == F.col("__of"), *same]).withColumn(name, F.col(name) + F.col("__before")).select(*df.columns, name)


def stabilised(
    frames: DataFrame, track: str, frame: str, value: str, fps: float, jump: float, max_gap: float, fade: float, frame_count: DataFrame | None = None,
    min_cutoff: float = 1.0, beta: float = 0.5, d_cutoff: float = 1.0, slice_rows: int = SLICE_ROWS,
) -> DataFrame:
    """``track, shot, frame, source, weight, value, smooth`` of every tracked or filled frame.

    ``frames``: one row a tracked frame (``track, frame, value``); a frame's time is its number over ``fps``. A shot starts where the value jumps by
    over ``jump`` between neighbouring frames. Within a shot tracked frames up to ``max_gap`` seconds apart are one run,
    whose missing frames are interpolated; each run is smoothed forwards and backwards. ``weight`` fades over ``fade`` seconds where a run
    borders a longer gap, but not at a cut or where the clip begins or ends (``frame_count``: ``track, n``; without it the last tracked
    frame ends the clip). Rows with a null track, frame or value are left out; of repeated frames the smallest value counts.
    """
    there = frames.where(F.col(track).isNotNull() & F.col(frame).isNotNull() & F.col(value).isNotNull())
    one = there.groupBy(F.col(track).alias("track"), F.col(frame).cast("long").alias("frame")).agg(F.min(F.col(value).cast("double")).alias("value"))
    last = {"before": F.struct(F.col("frame").alias("f"), F.col("value").alias("v"))}
    steps = _carried(one, ["track"], "frame", slice_rows, last)
    cut = (F.col("frame") - F.col("before.f") == 1) & (F.abs(F.col("value") - F.col("before.v")) > jump)
    steps = steps.withColumn("cut", F.coalesce(cut, F.lit(False)))
    fresh = F.col("before").isNull() | F.col("cut") | ((F.col("frame") - F.col("before.f")) / fps > max_gap + 1e-9)
    runs = _counted(_counted(steps, ["track"], "frame", slice_rows, F.col("cut"), "shot"), ["track"], "frame", slice_rows, fresh, "run")
    held = saved(runs.withColumn("fresh", fresh))
    gap = F.col("frame") - F.col("before.f")
    filled = held.where(~F.col("fresh") & (gap > 1)).select("track", "shot", "run", F.explode(F.sequence(F.lit(1).cast("long"), gap - 1)).alias("i"), "before", "value", gap.alias("gap"))
    between = F.col("before.v") + (F.col("value") - F.col("before.v")) * F.col("i") / F.col("gap")
    filled = filled.select("track", "shot", "run", (F.col("before.f") + F.col("i")).alias("frame"), between.alias("value"), F.lit("interpolated").alias("source"))
    every = saved(held.select("track", "shot", "run", "frame", "value", F.lit("tracked").alias("source")).unionByName(filled))
    series = every.select(F.struct("track", "run").alias("series"), (F.col("frame") / fps).alias("t"), "frame", "value")
    smooth = one_euro(series, "series", "t", "frame", "value", min_cutoff=min_cutoff, beta=beta, d_cutoff=d_cutoff, zero_lag=True, slice_rows=slice_rows)
    ends = every.groupBy("track", "shot", "run").agg(F.min("frame").alias("first"), F.max("frame").alias("last"))
    clips = every.groupBy("track").agg((F.max("frame") + 1).alias("n")) if frame_count is None else frame_count.select(F.col(track).alias("track"), "n")
    starts = held.where("cut").select("track", "shot", F.col("frame").alias("starts"))
    ends = ends.join(clips, "track").join(starts, ["track", "shot"], "left")
    ends = ends.join(starts.select("track", (F.col("shot") - 1).alias("shot"), F.col("starts").alias("next")), ["track", "shot"], "left")
    rise = F.when(F.col("first") > F.coalesce("starts", F.lit(0)), (F.col("frame") - F.col("first") + 1) / fps / fade).otherwise(1.0)
    fall = F.when(F.col("last") < F.coalesce("next", "n") - 1, (F.col("last") - F.col("frame") + 1) / fps / fade).otherwise(1.0)
    joined = every.join(ends, ["track", "shot", "run"]).join(smooth.select("series.track", "series.run", "frame", "smooth"), ["track", "run", "frame"])
    weight = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.least(rise, fall)))
    return joined.select(F.col("track").alias(track), "shot", F.col("frame").alias(frame), "source", weight.alias("weight"), F.col("value").alias(value), "smooth")


def region_deviation(
    stats: DataFrame, shot: str, frame: str, region: str, on: float, colour_floor: float = COLOUR_FLOOR, texture_floor: float = TEXTURE_FLOOR, passes: int = PASSES
) -> DataFrame:
    """``shot, frame, region, score``: how far each region strays from its own normal over the shot, in its own spreads.

    ``stats`` has ``light, a, b, texture`` of each region on each frame. Light and texture count as log ratios (light times 50), a and b as differences to
    the region's median. What the ``COMMON_REGIONS`` calmest regions of a frame share is taken out. Each of the passes leaves out
    rows that the last one found at ``on`` or above, from normals, shared changes and spreads alike; a shot whose regions would keep
    fewer than three rows stays as it was. The score is null where a measure is null or a region has under three kept rows.

    A shot of up to ``robust.MOST_GATHERED`` rows is moved to one task, once, and its statistics are windows there. Those of longer shots are
    aggregates that are joined back; then a shot's region is one group, whose distinct values are what an exact median holds.
    """
    logged = lambda c: F.log(F.greatest(F.col(c), F.lit(1e-3)))
    x = {"x0": 50 * logged("light"), "x1": F.col("a"), "x2": F.col("b"), "x3": logged("texture")}
    ok = F.col("light").isNotNull() & F.col("a").isNotNull() & F.col("b").isNotNull() & F.col("texture").isNotNull()
    rows = stats.select(F.col(shot).alias("shot"), F.col(frame).alias("frame"), F.col(region).alias("region"), *[v.cast("double").alias(k) for k, v in x.items()], ok.alias("ok"))
    short, long = by_size(rows.where(F.col("region").isNotNull()), "shot")
    found = _deviations(short.repartition("shot"), list(x), on, colour_floor, texture_floor, passes, _beside, lambda df: df)
    if long is not None:
        found = found.unionByName(_deviations(long, list(x), on, colour_floor, texture_floor, passes, _joined, saved))
    score = F.when(F.col("ok"), F.col("score")).alias("score")
    return found.select(F.col("shot").alias(shot), F.col("frame").alias(frame), F.col("region").alias(region), score)


def _beside(df: DataFrame, keys: list[str], statistics: dict[str, Column]) -> DataFrame:
    """``df`` with statistics of its groups, by windows; null where a key is null."""
    there = reduce(Column.__and__, [F.col(k).isNotNull() for k in keys])
    return df.withColumns({n: F.when(there, v.over(Window.partitionBy(*keys))) for n, v in statistics.items()})


def _joined(df: DataFrame, keys: list[str], statistics: dict[str, Column]) -> DataFrame:
    """As ``_beside``, by an aggregate and a join."""
    return df.join(df.groupBy(*keys).agg(*[v.alias(n) for n, v in statistics.items()]), keys, "left")


def _deviations(
    rows: DataFrame, x: list[str], on: float, colour_floor: float, texture_floor: float, passes: int,
    over: Callable[[DataFrame, list[str], dict[str, Column]], DataFrame], held: Callable[[DataFrame], DataFrame],
) -> DataFrame:
    """The passes of ``region_deviation`` over ``shot, frame, region, ok`` and measures ``x``; ``over`` adds statistics of groups, ``held`` cuts the lineage."""
    now = held(rows.withColumns({"keep": F.col("ok"), "score": F.lit(None).cast("double"), "stopped": F.lit(False)}))
    half, place = F.lit(0.5), ["shot", "region"]
    kept = lambda c: F.when(F.col("keep"), c)
    for _ in range(passes):
        off = over(now, place, {f"m{c}": F.percentile(kept(F.col(c)), half) for c in x})
        off = off.withColumns({f"d{c}": F.col(c) - F.col(f"m{c}") for c in x})
        size = F.sqrt(F.col("dx0") ** 2 + F.col("dx1") ** 2 + F.col("dx2") ** 2)
        calmest = F.row_number().over(Window.partitionBy("shot", "frame").orderBy(F.desc("keep"), F.round(size, 9), "region"))
        off = off.withColumn("calm", F.col("keep") & (calmest <= COMMON_REGIONS))
        off = over(off, ["shot", "frame"], {f"c{c}": F.percentile(F.when(F.col("calm"), F.col(f"d{c}")), half) for c in x})
        e = {c: F.col(f"d{c}") - F.coalesce(f"c{c}", F.lit(0.0)) for c in x}
        away = off.select(
            "shot", "frame", "region", *x, "ok", "keep", F.col("score").alias("old"), "stopped",
            F.sqrt(e["x0"] ** 2 + e["x1"] ** 2 + e["x2"] ** 2).alias("dev_c"), F.abs(e["x3"]).alias("dev_t"),
        )
        middle = {"mc": F.percentile(kept(F.col("dev_c")), half), "mt": F.percentile(kept(F.col("dev_t")), half), "n": F.count(kept(F.lit(1)))}
        near = over(held(away), place, middle)
        mads = {s: F.percentile(kept(F.abs(F.col(d) - F.col(m))), half) for s, d, m in (("sc", "dev_c", "mc"), ("st", "dev_t", "mt"))}
        spread = lambda c, floor: F.greatest(1.4826 * F.col(c), F.lit(floor))
        found = F.greatest(F.col("dev_c") / spread("sc", colour_floor), F.col("dev_t") / spread("st", texture_floor))
        new = F.when(F.col("stopped"), F.col("old")).when(F.col("n") < 3, F.col("old")).otherwise(found)
        scored = over(near, place, mads).withColumn("score", new)
        scored = scored.withColumn("still", F.col("ok") & (F.coalesce("score", F.lit(float("inf"))) < on))
        least = over(over(scored, place, {"left": F.count(F.when(F.col("still"), 1))}), ["shot"], {"least": F.min("left")})
        after = least.withColumn("stopped", F.col("stopped") | (F.col("least") < 3))
        now = held(after.select("shot", "frame", "region", *x, "ok", F.when(F.col("stopped"), F.col("keep")).otherwise(F.col("still")).alias("keep"), "score", "stopped"))
    return now
