"""Scores, ranks, keepers and frontiers."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import saved

#: Weights of the cover checks.
COVER_WEIGHTS = {"photo": 30, "crop": 25, "costume": 20, "colour": 15, "light": 10}
#: Upper bounds of the face's share of the frame height.
FRAMING_BANDS = (("wide", 0.04), ("full-body", 0.12), ("three-quarter", 0.20), ("half-body", 0.33))


def min_max(value: str, keys: list[str]) -> Column:
    """Position of a value between the extremes of its group; 1 if they coincide."""
    w = Window.partitionBy(*keys)
    low, high = F.min(value).over(w), F.max(value).over(w)
    return F.when(high <= low, 1.0).otherwise((F.col(value) - low) / F.nullif(high - low, F.lit(0.0)))


def rank_in_group(df: DataFrame, keys: list[str], score: str, tie: str, name: str = "rank") -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(F.desc(score), F.asc(tie))
    return df.withColumn(name, F.row_number().over(w).cast("long"))


def keepers(df: DataFrame, keys: list[str], score: str, tie: str) -> DataFrame:
    """The best row of each group."""
    return rank_in_group(df, keys, score, tie).where("rank = 1").drop("rank")


def burst_scores(df: DataFrame, keys: list[str], sharpness: str, exposure: str, clipping: str, resolution: str) -> DataFrame:
    """Capture-only quality: half sharpness in the burst, then exposure, clipping and resolution."""
    score = 0.50 * min_max(sharpness, keys) + 0.25 * F.col(exposure) + 0.15 * F.col(clipping) + 0.10 * min_max(resolution, keys)
    return df.withColumn("score", F.least(F.greatest(score, F.lit(0.0)), F.lit(1.0)))


def cover_score(checks: dict[str, Column], gate: Column) -> tuple[Column, Column]:
    """Score 0..100 over the measured checks (null: not measured) times the gate; and the measured weight."""
    zero = F.lit(0.0)
    weight = sum((F.when(checks[k].isNotNull(), F.lit(w)).otherwise(0) for k, w in COVER_WEIGHTS.items()), F.lit(0))
    total = sum((F.coalesce(checks[k], zero) * w for k, w in COVER_WEIGHTS.items()), zero)
    return F.when(weight > 0, 100.0 * gate * total / F.nullif(weight, F.lit(0))).otherwise(0.0), weight


def framing(share: Column, faces: Column) -> Column:
    out = F.when(faces <= 0, "unknown").when(faces >= 2, "pair")
    for name, below in FRAMING_BANDS:
        out = out.when(share < below, name)
    return out.otherwise("close-up")


def eyes_open(left: Column, right: Column) -> Column:
    """no below 0.15 on either side, yes from 0.20 on both, else uncertain; null is uncertain."""
    return (
        F.when(left.isNull() | right.isNull(), "uncertain")
        .when(F.least(left, right) < 0.15, "no")
        .when(F.least(left, right) >= 0.20, "yes")
        .otherwise("uncertain")
    )


def suggest(ranked: DataFrame, score: str, tie: str, tight: str, pool: int = 12) -> DataFrame:
    """Cover (best), slide 2 (best of the other tightness, else the next) and slide 3 (best of the rest), from a pool of the top rows."""
    top = ranked.orderBy(F.desc(score), F.asc(tie)).limit(pool)
    numbered = top.withColumn("__n", F.row_number().over(Window.orderBy(F.desc(score), F.asc(tie))))
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    cover_tight = F.max(F.when(F.col("__n") == 1, F.col(tight))).over(everything)
    contrast = F.min(F.when((F.col("__n") > 1) & (F.col(tight) != cover_tight), F.col("__n"))).over(everything)
    second = F.coalesce(contrast, F.lit(2))
    third = F.when(second == 2, 3).otherwise(2)
    slot = F.when(F.col("__n") == 1, "cover").when(F.col("__n") == second, "slide_2").when(F.col("__n") == third, "slide_3")
    return numbered.withColumn("slot", slot).where(F.col("slot").isNotNull()).drop("__n")


#: Rows that are held against so many others at a time.
_STRIP = 256
_TILE = 4096


def _beaten(rows: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Which rows (all columns to be small) one of the others is as good as everywhere and better than somewhere."""
    out = np.zeros(len(rows), bool)
    for at in range(0, len(others), _STRIP):
        part = others[None, at : at + _STRIP]
        left = np.flatnonzero(~out)
        mine = rows[left, None]
        out[left] = ((part <= mine).all(axis=2) & (part < mine).any(axis=2)).any(axis=1)
    return out


def frontier(df: DataFrame, largest: list[str], smallest: list[str], tie: str, buckets: int = 64) -> DataFrame:
    """Rows that no other row beats: as good everywhere and better somewhere.

    Each hash bucket drops the rows that another one of it beats, in blocks ordered by sum (a row can only be beaten from before).
    What is left is cut into tiles, each block against each, and a row stays that no tile has beaten.
    """

    def values(rows: pa.Table) -> np.ndarray:
        columns = [-rows.column(c).to_numpy(zero_copy_only=False).astype(float) for c in largest] + [rows.column(c).to_numpy(zero_copy_only=False).astype(float) for c in smallest]
        return np.column_stack(columns)

    def local(rows: pa.Table) -> pa.Table:
        v = values(rows)
        order = np.argsort(v.sum(axis=1), kind="stable")
        kept = order[:0]
        for at in range(0, len(order), _TILE):
            part = order[at : at + _TILE]
            part = part[~_beaten(v[part], v[kept])]
            kept = np.concatenate([kept, part[~_beaten(v[part], v[part])]])
        return rows.take(pa.array(np.sort(kept)))

    def crossed(rows: pa.Table) -> pa.Table:
        v, side = values(rows), rows.column("__side").to_numpy()
        mine = np.flatnonzero(side == 0)
        return rows.take(pa.array(mine[~_beaten(v[mine], v[side == 1])]))

    bucket = lambda n: F.pmod(F.xxhash64(tie), F.lit(n))
    dealt = df.withColumn("__b", bucket(buckets))
    first = saved(dealt.groupBy("__b").applyInArrow(local, dealt.schema).drop("__b"))
    n = -(-first.count() // _TILE)
    each = F.explode(F.sequence(F.lit(0), F.lit(max(n - 1, 0))))
    mine = first.select("*", bucket(max(n, 1)).alias("__a"), each.alias("__b"), F.lit(0).alias("__side"))
    other = first.select("*", each.alias("__a"), bucket(max(n, 1)).alias("__b"), F.lit(1).alias("__side"))
    both = mine.unionByName(other)
    left = both.groupBy("__a", "__b").applyInArrow(crossed, both.schema)
    unbeaten = left.groupBy(*df.columns, "__a").agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") % max(n, 1) == 0)
    return unbeaten.withColumn("__times", F.explode(F.sequence(F.lit(1).cast("long"), F.floor(F.col("__n") / max(n, 1)).cast("long")))).select(*df.columns)


def trend(value: str, keys: list[str], order: list[str]) -> Column:
    """Of the last three values: strictly rising is worse, strictly falling better."""
    w = Window.partitionBy(*keys).orderBy(*order)
    one, two = F.lag(value, 1).over(w), F.lag(value, 2).over(w)
    return (
        F.when(two.isNull(), "INSUFFICIENT_DATA")
        .when((two < one) & (one < F.col(value)), "WORSENING")
        .when((two > one) & (one > F.col(value)), "IMPROVING")
        .otherwise("STABLE")
    )


def leaderboard(df: DataFrame, key: str, order: list[str], effect: Column, retention: Column, failed: Column, runtime: Column, baseline: Column) -> DataFrame:
    """First row of each configuration, its score (effect times retention; 0 if failed), rank and runtime against the baseline."""
    first = df.withColumn("__n", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("__n = 1").drop("__n")
    scored = first.withColumn("quality_score", F.when(failed | retention.isNull(), 0.0).otherwise(effect * retention))
    scored = scored.withColumn("runtime_pct", F.when((runtime != 0) & (baseline != 0), (runtime - baseline) / F.nullif(baseline, F.lit(0.0)) * 100))
    return global_rank(scored, "quality_score", key)


def edges_of(value: Column, bins: int = 1024) -> Column:
    """Aggregate: ascending edges that cut a group's values into ranges of about equal counts, from a mergeable sketch."""
    at = [i / bins for i in range(1, bins)]
    return F.array_distinct(F.array_sort(F.percentile_approx(value.cast("double"), at, 10 * bins)))


def bin_of(value: Column, edges: Column, stride: int = 32) -> Column:
    """How many of the ascending edges are at most the value; every ``stride``-th edge is looked at first, then those between."""
    upto = lambda a: F.size(F.filter(a, lambda e: e <= value))
    coarse = upto(F.transform(F.sequence(F.lit(stride), F.greatest(F.size(edges), F.lit(stride)), F.lit(stride)), lambda i: F.try_element_at(edges, i)))
    return coarse * stride + upto(F.slice(edges, coarse * stride + 1, F.lit(stride)))


def rank_within(df: DataFrame, keys: list[str], score: str, tie: str, name: str = "rank", descending: bool = True) -> DataFrame:
    """Rank of each row in its group, without one task that sorts a group: rows of value ranges are counted, counts are added
    up, and ranks within a range follow. A range holds few rows unless scores tie."""
    group = F.struct(*keys) if keys else F.struct(F.lit(1))
    keyed = df.withColumn("__k", group)
    edges = saved(keyed.groupBy("__k").agg(edges_of(F.col(score)).alias("__edges")))  # a sketch that is merged anew may give other edges, and counts and ranks must agree on them
    binned = keyed.join(edges, "__k", "left").withColumn("__bin", F.coalesce(bin_of(F.col(score).cast("double"), F.col("__edges")), F.lit(-1))).drop("__edges")
    way = (lambda c: F.desc(c)) if descending else (lambda c: F.asc(c))
    counts = binned.groupBy("__k", "__bin").agg(F.count(F.lit(1)).alias("__c"))
    before = counts.select("__k", "__bin", (F.sum("__c").over(Window.partitionBy("__k").orderBy(way("__bin"))) - F.col("__c")).alias("__before"))
    w = Window.partitionBy("__k", "__bin").orderBy(way(score), F.asc(tie))
    ranked = binned.join(before, ["__k", "__bin"]).withColumn(name, (F.col("__before") + F.row_number().over(w)).cast("long"))
    return ranked.select(*df.columns, name)


def global_rank(df: DataFrame, score: str, tie: str, name: str = "rank") -> DataFrame:
    """Rank over all rows by descending score."""
    return rank_within(df, [], score, tie, name)


def crop_plan(width: Column, height: Column, ratio: tuple[int, int]) -> tuple[Column, Column, Column, Column]:
    """The largest centred crop of an aspect ratio: x, y, width, height."""
    rw, rh = ratio
    wide = width * rh >= height * rw
    cw = F.when(wide, F.least(width, F.bround(height * rw / rh).cast("long"))).otherwise(width)
    ch = F.when(wide, height).otherwise(F.least(height, F.bround(width * rh / rw).cast("long")))
    return F.floor((width - cw) / 2), F.floor((height - ch) / 2), cw, ch
