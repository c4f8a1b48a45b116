"""Robust statistics of groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import saved
from .ranking import bin_of, edges_of

BINS = 64
#: A table of one row a group or range is broadcast up to this size.
MOST_BROADCAST = 10_000
#: Rows up to which a group is worked on in one task.
MOST_GATHERED = 1_000_000


def by_size(df: DataFrame, key: str, most: int | None = None) -> tuple[DataFrame, DataFrame | None]:
    """The rows of ``df`` whose group has up to ``most`` rows (``MOST_GATHERED``), and those of larger groups (None without any).

    Rows are read once more, to count them. There is at most one larger group to ``most`` rows, so their keys are broadcast. Rows with a null key are in neither.
    """
    there = df.where(F.col(key).isNotNull())
    large = saved(there.groupBy(key).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > (most or MOST_GATHERED)).select(key))
    if large.isEmpty():
        return there, None
    return there.join(F.broadcast(large), key, "left_anti"), there.join(F.broadcast(large), key, "left_semi")


def _met(df: DataFrame, small: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """``df`` joined with a saved table, which is broadcast if it holds at most ``MOST_BROADCAST`` rows."""
    return df.join(F.broadcast(small) if small.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST else small, on, how)


def _binned(df: DataFrame, keys: list[str], value: str) -> tuple[DataFrame, DataFrame]:
    """``__k, __bin, __v`` of all rows with a value, and per bin ``__k, __bin, n, total, below, size``: rows and sum of the bin,
    rows in the bins below and in the group. Bins are value ranges of about equal counts.

    Both steps are saved, so a statistic reads its rows three times: for the edges, for the counts, for the bins in question.
    """
    rows = df.where(F.col(value).isNotNull()).select(F.struct(*keys).alias("__k"), F.col(value).cast("double").alias("__v"))
    edges = saved(rows.groupBy("__k").agg(edges_of(F.col("__v"), BINS).alias("__edges")))
    placed = _met(rows, edges, ["__k"]).select("__k", bin_of(F.col("__v"), F.col("__edges"), 8).alias("__bin"), "__v")
    counts = saved(placed.groupBy("__k", "__bin").agg(F.count(F.lit(1)).alias("n"), F.sum("__v").alias("total")))
    own = Window.partitionBy("__k")
    upto = own.orderBy("__bin")
    return placed, saved(counts.withColumns({"below": F.sum("n").over(upto) - F.col("n"), "size": F.sum("n").over(own)}))


def _values_in(placed: DataFrame, bins: DataFrame) -> DataFrame:
    """``__k, __bin, __v, first, behind``: the distinct values of the given bins and the ranks within the bin that they take (from 0).
    Only rows of these bins move, and equal values as one."""
    inside = _met(placed, saved(bins.select("__k", "__bin").distinct()), ["__k", "__bin"], "left_semi")
    counts = inside.groupBy("__k", "__bin", "__v").agg(F.count(F.lit(1)).alias("c"))
    behind = F.sum("c").over(Window.partitionBy("__k", "__bin").orderBy("__v"))
    return counts.withColumn("behind", behind).withColumn("first", F.col("behind") - F.col("c")).drop("c")


def trimmed_mean(df: DataFrame, keys: list[str], value: str, share: float = 0.1) -> DataFrame:
    """Mean of each group without max(1, floor(share n)) values at either end; the plain mean below five values.

    Bins of values that lie wholly inside add their sums; only the rows of the two bins that the cuts go through are ranked.
    """
    placed, bins = _binned(df, keys, value)
    cut = F.when(F.col("size") < 5, 0).otherwise(F.greatest(F.lit(1), F.floor(F.col("size") * share).cast("long")))
    bins = bins.withColumn("low", cut).withColumn("high", F.col("size") - cut)
    whole = (F.col("below") >= F.col("low")) & (F.col("below") + F.col("n") <= F.col("high"))
    inside = bins.where(whole).select("__k", "size", F.col("n").alias("kept"), "total")
    edge = bins.where(~whole & (F.col("below") < F.col("high")) & (F.col("below") + F.col("n") > F.col("low"))).select("__k", "__bin", "below", "low", "high", "size")
    ranked = _values_in(placed, edge).join(edge, ["__k", "__bin"])
    copies = F.least(F.col("below") + F.col("behind"), F.col("high")) - F.greatest(F.col("below") + F.col("first"), F.col("low"))
    partly = ranked.withColumn("kept", copies).where("kept > 0").select("__k", "size", "kept", (F.col("kept") * F.col("__v")).alias("total"))
    found = inside.unionByName(partly).groupBy("__k").agg(F.sum("total").alias("total"), F.sum("kept").alias("n_kept"), F.max("size").alias("n"))
    return found.select("__k.*", (F.col("total") / F.col("n_kept")).alias("trimmed_mean"), "n_kept", "n")


def order_statistics(df: DataFrame, keys: list[str], value: str, at: tuple[float, ...]) -> DataFrame:
    """``keys, __p``: the exact percentiles of each group (linear interpolation), as an array.

    Counts by value range tell in which range each rank lies; only rows of these ranges are sorted, so neither a group nor
    its distinct values have to fit in one place.
    """
    placed, bins = _binned(df, keys, value)
    asked = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(p).alias("p")) for i, p in enumerate(at)])).alias("x")
    ranks = bins.select("__k", "size").distinct().select("__k", asked, "size")
    place = F.col("x.p") * (F.col("size") - 1)
    both = F.explode(F.array_distinct(F.array(F.floor(place), F.ceil(place)))).alias("rank")
    ranks = ranks.select("__k", F.col("x.i").alias("i"), place.alias("place"), both)
    own = bins.select("__k", "__bin", "below", "n")
    wanted = ranks.join(own, "__k").where("rank >= below and rank < below + n").select("__k", "__bin", "i", "place", "rank", (F.col("rank") - F.col("below")).alias("offset"))
    values = _values_in(placed, wanted)
    found = wanted.join(values, ["__k", "__bin"]).where("offset >= first and offset < behind")
    each = found.groupBy("__k", "i").agg(F.min("__v").alias("low"), F.max("__v").alias("high"), F.max(F.col("place") - F.floor("place")).alias("part"))
    # between equal neighbours the percentile is their value to the last digit: rows at it are then neither above nor below
    between = F.when(F.col("low") == F.col("high"), F.col("low")).otherwise(F.col("low") * (1 - F.col("part")) + F.col("high") * F.col("part"))
    each = each.select("__k", "i", between.alias("v"))
    return each.groupBy("__k").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "v"))), lambda x: x["v"]).alias("__p")).select("__k.*", "__p")


def band_mean(df: DataFrame, keys: list[str], value: str, by: str, low: float, high: float) -> DataFrame:
    """Mean of ``value`` over the rows whose ``by`` lies between two percentiles of the group (linear interpolation)."""
    inside = _met(df, saved(order_statistics(df, keys, by, (low, high))), keys).where(F.col(by).between(F.col("__p")[0], F.col("__p")[1]))
    return inside.groupBy(*keys).agg(F.avg(value).alias("band_mean"), F.count(F.lit(1)).alias("n_in_band"))


def percentiles(df: DataFrame, keys: list[str], value: str, at: tuple[float, ...]) -> DataFrame:
    """One column per percentile, p01, p05 ..."""
    found = order_statistics(df, keys, value, at)
    return found.select(*keys, *[F.col("__p")[i].alias(f"p{round(p * 100):02d}") for i, p in enumerate(at)])


def spread(df: DataFrame, keys: list[str], value: str, floor: float) -> DataFrame:
    """Median and robust spread: 1.4826 times the median absolute deviation, at least ``floor``."""
    middle = saved(order_statistics(df, keys, value, (0.5,)).select(*keys, F.col("__p")[0].alias("median")))
    off = _met(df, middle, keys).select(*keys, "median", F.abs(F.col(value) - F.col("median")).alias("__off"))
    found = order_statistics(off, [*keys, "median"], "__off", (0.5,))
    return found.select(*keys, "median", F.greatest(F.col("__p")[0] * 1.4826, F.lit(floor)).alias("spread"))


def joint_histogram(df: DataFrame, keys: list[str], bins: dict[str, tuple[Column, int]], least: int = 150) -> DataFrame:
    """Share of each group's rows in joint bins; ``bins``: name -> (value in 0..1, count). Groups below ``least`` rows are left out."""
    placed = df.withColumns({name: F.least(F.greatest(F.floor(v * n), F.lit(0)), F.lit(n - 1)).cast("int") for name, (v, n) in bins.items()})
    counts = placed.groupBy(*keys, *bins).agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n").over(Window.partitionBy(*keys))
    return counts.withColumn("__t", total).where(F.col("__t") >= least).withColumn("share", F.col("n") / F.col("__t")).drop("__t")


def weighted_moments(df: DataFrame, keys: list[str], value: str, weight: str) -> DataFrame:
    """Weighted mean and population deviation."""
    w, x = F.col(weight), F.col(value)
    sums = df.groupBy(*keys).agg(F.sum(w).alias("w"), F.sum(w * x).alias("wx"), F.sum(w * x * x).alias("wxx"))
    mean = F.col("wx") / F.nullif(F.col("w"), F.lit(0.0))
    return sums.select(*keys, mean.alias("mean"), F.sqrt(F.greatest(F.col("wxx") / F.nullif(F.col("w"), F.lit(0.0)) - mean * mean, F.lit(0.0))).alias("std"))


def style_profile(before: DataFrame, after: DataFrame, stem: str, measures: list[str]) -> DataFrame:
    """Differences after - before of measures, paired by stem; of repeated stems the last row by ``order`` counts."""
    pick = lambda d: d.groupBy(stem).agg(*[F.max_by(m, "order").alias(m) for m in measures])
    a, b = pick(before).alias("a"), pick(after).alias("b")
    return a.join(b, stem).select(stem, *[(F.col(f"b.{m}") - F.col(f"a.{m}")).alias(f"{m}_delta") for m in measures])


def median_of(df: DataFrame, value: str) -> DataFrame:
    """One row: the exact ``median`` of all rows with a value and their number ``n`` (null and 0 without any)."""
    there = df.where(F.col(value).isNotNull()).select(F.lit(1).alias("__one"), value)
    found = order_statistics(there, ["__one"], value, (0.5,)).select(F.col("__p")[0].alias("median"))
    return there.agg(F.count(F.lit(1)).alias("n")).join(F.broadcast(found), F.lit(True), "left").select("median", "n")
