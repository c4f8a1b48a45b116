"""What may be done to a frame without asking, what has drifted, what was checked, and what a move or a macro would leave."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import colour
from ..storage import saved
from .robust import by_size, order_statistics

#: Fixed values of the hue gate: mean and 95th percentile in degrees, share of the median chroma, least chroma, least pixels.
HUE_MEAN, HUE_P95, CHROMA_SHARE, LEAST_CHROMA, LEAST_PIXELS = 6.0, 20.0, 0.5, 1.0, 100
#: Kelvin a unit of b*, drift of full confidence.
KELVIN_PER_B, FULL_DRIFT = 50.0, 15.0
STATUSES = ("checked-pass", "checked-flagged", "unavailable", "not-run")


def mask_confidence(coverage: Column, stability: Column, model: Column, occluded: Column) -> Column:
    """The weakest of the evidence, each within 0 to 1 (missing stability or model evidence doesn't count, missing coverage is none); at most 0.35 where the region is covered."""
    inside = lambda x, d: colour.clip(F.coalesce(F.nanvl(x, F.lit(0.0)), F.lit(d)))
    least = F.least(inside(coverage, 0.0), inside(stability, 1.0), inside(model, 1.0))
    return F.when(F.coalesce(occluded, F.lit(False)), F.least(least, F.lit(0.35))).otherwise(least)


def safe_auto(confidence: Column, apply_at: float = 0.85, dampen_at: float = 0.65, review_at: float = 0.40) -> tuple[Column, Column]:
    """``action`` and the edit's ``scale``: applied, dampened by half, put to review or skipped. No confidence is none."""
    if not 0 <= review_at <= dampen_at <= apply_at <= 1:
        raise ValueError("thresholds must rise from review to apply")
    value = colour.clip(F.coalesce(F.nanvl(confidence.cast("double"), F.lit(0.0)), F.lit(0.0)))
    action = F.when(value >= apply_at, "apply").when(value >= dampen_at, "dampen").when(value >= review_at, "review").otherwise("skip")
    return action, F.when(action == "apply", 1.0).when(action == "dampen", 0.5).otherwise(0.0)


def shot_consistency(shots: DataFrame, shoot: str, key: str, reference: Column, least_pixels: int = 100) -> DataFrame:
    """``shoot, key, kelvin_delta, confidence, drift`` of each shot against its shoot's reference shot.

    ``shots``: a row a shot with mean ``a, b`` (of CIE L*a*b*) over its skin, and the ``n`` pixels behind them. ``reference``: whether a shot is the reference (of several the smallest key). All
    are 0 where either shot has under ``least_pixels`` pixels or the shoot has no reference.
    """
    valid = F.coalesce(F.col("n") >= least_pixels, F.lit(False)) & F.col("a").isNotNull() & F.col("b").isNotNull()
    each = shots.select(shoot, key, "a", "b", valid.alias("valid"), F.coalesce(reference, F.lit(False)).alias("reference"))
    first = each.where("reference").groupBy(shoot).agg(F.min_by(F.struct("a", "b", "valid"), key).alias("x"))
    joined = each.join(first, shoot, "left")
    a, b = F.col("a") - F.col("x.a"), F.col("b") - F.col("x.b")
    both = F.coalesce(F.col("valid") & F.col("x.valid"), F.lit(False))
    measured = lambda v: F.when(both, v).otherwise(0.0)
    drift = F.sqrt(a * a + b * b)
    return joined.select(shoot, key, measured(b * KELVIN_PER_B).alias("kelvin_delta"), measured(colour.clip(drift / FULL_DRIFT)).alias("confidence"), measured(drift).alias("drift"))


def colour_drift(pixels: DataFrame, image: str, before: tuple[str, str, str], after: tuple[str, str, str]) -> DataFrame:
    """``image, status, delta_e, hue_mean, hue_p95, kept, score`` of pixels with L*, a*, b* before and after an edit.

    Hue counts only where both colours have at least half of the image's median chroma before (and at least 1). The gate flags a mean shift over 6 degrees or a
    95th percentile over 20; with under 100 such pixels it is not-run. Medians and percentiles are exact. An image of up to ``robust.MOST_GATHERED`` pixels is moved to one
    task, once; larger ones are not gathered in one place: their percentiles go by value ranges.
    """
    small, large = by_size(pixels.select(image, *before, *after), image)
    shifts = _shifts(small.repartition(image), image, before, after)
    floor = F.greatest(F.percentile("c0", F.lit(0.5)).over(Window.partitionBy(image)) * CHROMA_SHARE, F.lit(LEAST_CHROMA))
    gated = _gated(shifts.withColumn("floor", floor))
    found = gated.groupBy(image).agg(*_sums(), F.percentile("dh", F.lit(0.95)).alias("p95"))
    if large is not None:
        shifts = _shifts(saved(large), image, before, after)  # read several times
        middle = saved(order_statistics(shifts, [image], "c0", (0.5,)).select(image, F.greatest(F.col("__p")[0] * CHROMA_SHARE, F.lit(LEAST_CHROMA)).alias("floor")))
        gated = _gated(shifts.join(F.broadcast(middle), image, "left"))
        tail = order_statistics(gated, [image], "dh", (0.95,)).select(image, F.col("__p")[0].alias("p95"))
        found = found.unionByName(gated.groupBy(image).agg(*_sums()).join(tail, image, "left"))
    run = F.col("k") >= LEAST_PIXELS
    over = (F.col("mean") > HUE_MEAN) | (F.col("p95") > HUE_P95)
    score = F.least(F.lit(1.0), F.greatest(F.col("p95") / (2 * HUE_P95), F.col("mean") / (2 * HUE_MEAN)))
    return found.where("n > 0").select(
        image, F.when(~run, "not-run").when(over, "checked-flagged").otherwise("checked-pass").alias("status"), "delta_e",
        F.when(run, F.col("mean")).alias("hue_mean"), F.when(run, F.col("p95")).alias("hue_p95"), (F.col("k") / F.col("n")).alias("kept"), F.when(run, score).alias("score"),
    )


def _shifts(pixels: DataFrame, image: str, before: tuple[str, str, str], after: tuple[str, str, str]) -> DataFrame:
    """``image, de, c0, c, dh``: colour difference, chroma before, the lesser chroma and the turn of hue of each pixel.

    All are null where a value is missing. Such pixels are not filtered: a filter would be pushed down to where the values are made, and make them once for each use.
    """
    there = reduce(Column.__and__, [F.col(c).isNotNull() & ~F.isnan(c) for c in (*before, *after)])
    l0, a0, b0, l1, a1, b1 = (F.col(c) for c in (*before, *after))
    chroma = lambda a, b: F.sqrt(a * a + b * b)
    turn = F.degrees(F.atan2(b1, a1)) - F.degrees(F.atan2(b0, a0))
    shift = F.abs(F.pmod(turn + 180, F.lit(360.0)) - 180)
    found = {"de": colour.delta_e_2000((l0, a0, b0), (l1, a1, b1)), "c0": chroma(a0, b0), "c": F.least(chroma(a0, b0), chroma(a1, b1)), "dh": shift}
    return pixels.select(image, *[F.when(there, v).alias(n) for n, v in found.items()])


def _gated(shifts: DataFrame) -> DataFrame:
    return shifts.withColumn("dh", F.when(F.col("c") >= F.col("floor"), F.col("dh")))


def _sums() -> list[Column]:
    return [F.avg("de").alias("delta_e"), F.avg("dh").alias("mean"), F.count("dh").alias("k"), F.count("c0").alias("n")]


def evidence(jobs: DataFrame, results: DataFrame, job: str, detectors: list[str]) -> DataFrame:
    """``job, detector, status, score`` for every job and every one of the ``detectors``, so that a check that passed, one that failed itself and one that never ran are told apart.

    ``results``: ``job, detector, available, measured, flagged, score`` of the detectors that reported (of several reports the last by ``order``).
    """
    every = jobs.select(job, F.explode(F.array(*map(F.lit, detectors))).alias("detector"))
    last = results.groupBy(job, "detector").agg(F.max_by(F.struct("available", "measured", "flagged", "score"), "order").alias("x"))
    x = lambda c, d: F.coalesce(F.col(f"x.{c}"), F.lit(d))
    status = F.when(F.col("x").isNull() | (x("available", True) & ~x("measured", True)), "not-run").when(~x("available", True), "unavailable").when(x("flagged", False), "checked-flagged").otherwise("checked-pass")
    return every.join(last, [job, "detector"], "left").select(job, "detector", status.alias("status"), F.when(status.startswith("checked"), F.col("x.score")).alias("score"))


def undo_plan(moves: DataFrame, existing: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What undoing ``moves`` (``source, destination`` of a manifest) would do while the paths of ``existing`` (``path``) are there.

    First ``source, destination, verdict``: ``restore``, ``missing`` (neither is there), ``exists again`` (both are), ``nothing`` (never moved, restored before, or onto itself); of several files
    that would go back to one place the smallest destination is restored, and the others find it ``exists again``. Then ``folder``: those of
    destinations that nothing is left in.
    """
    at = existing.select("path").distinct()
    joined = moves.select("source", "destination").distinct()
    joined = joined.join(at.select(F.col("path").alias("source"), F.lit(True).alias("__s")), "source", "left")
    joined = joined.join(at.select(F.col("path").alias("destination"), F.lit(True).alias("__d")), "destination", "left")
    there, back = F.col("__d").isNotNull(), F.col("__s").isNotNull()
    verdict = F.when(F.col("source") == F.col("destination"), "nothing").when(~there & ~back, "missing").when(~there, "nothing").when(back, "exists again").otherwise("restore")
    judged = joined.withColumn("verdict", verdict)
    first = judged.where("verdict = 'restore'").groupBy("source").agg(F.min("destination").alias("__first"))
    judged = judged.join(first, "source", "left").withColumn("verdict", F.when((F.col("verdict") == "restore") & (F.col("destination") != F.col("__first")), "exists again").otherwise(F.col("verdict")))
    verdicts = saved(judged.select("source", "destination", "verdict"))
    folder = lambda c: F.regexp_replace(c, "/[^/]*$", "")
    gone = verdicts.where("verdict = 'restore'").select(F.col("destination").alias("path"))
    left = at.join(gone, "path", "left_anti").unionByName(verdicts.where("verdict = 'restore'").select(F.col("source").alias("path")))
    used = left.select(folder(F.col("path")).alias("folder")).distinct()
    return verdicts, verdicts.select(folder(F.col("destination")).alias("folder")).distinct().join(used, "folder", "left_anti")


def macro_values(amounts: DataFrame, writes: DataFrame, parameters: DataFrame, base: DataFrame) -> DataFrame:
    """``frame, parameter, value, problem``: what macros make of parameters.

    ``amounts``: ``frame, macro, amount`` (-1 to 1); ``writes``: ``macro, parameter, positive, negative, crossing`` (targets, and whether the sign may change);
    ``parameters``: ``parameter, low, high, whole`` (limits, null for none); ``base``: ``frame, parameter, base``. The value goes from the base to the target by the amount, within the limits, rounded where whole. Null with
    a ``problem``: ``no base``, ``amount``, ``one-sided`` (no negative target), ``crosses zero``.
    """
    met = amounts.join(writes, "macro").join(parameters, "parameter").join(base, ["frame", "parameter"], "left")
    amount, start = F.col("amount"), F.col("base")
    target = F.when(amount > 0, F.col("positive")).otherwise(F.col("negative"))
    moved = F.when(amount == 0, start).otherwise(start + F.abs(amount) * (target - start))
    crosses = (F.signum(start) * F.signum(moved) < 0) & ~F.coalesce("crossing", F.lit(False))
    problem = F.when(start.isNull(), "no base").when(amount.isNull() | (F.abs(amount) > 1), "amount").when((amount < 0) & F.col("negative").isNull(), "one-sided").when(crosses, "crosses zero")
    inside = F.least(F.greatest(moved, F.coalesce("low", moved)), F.coalesce("high", F.greatest(moved, F.coalesce("low", moved))))
    value = F.when(amount == 0, start).when(F.col("whole"), F.rint(inside)).otherwise(inside)
    return met.select("frame", "macro", "parameter", F.when(problem.isNull(), value).alias("value"), problem.alias("problem"))
