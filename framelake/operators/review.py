"""Regression triage, performance comparison, review consensus."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import robust

#: Check, warning, regression, direction.
THRESHOLDS = [
    ("identity_ssim", 0.995, 0.985, "low"),
    ("identity_deltaE_mean", 0.8, 2.0, "high"),
    ("luminance_drift", 6.0, 12.0, "high"),
    ("chroma_drift", 5.0, 10.0, "high"),
    ("highlight_clip_delta", 1.5, 3.0, "high"),
    ("shadow_clip_delta", 1.5, 3.0, "high"),
    ("region_texture_retention", 0.75, 0.55, "low"),
    ("region_luminance_drift", 8.0, 15.0, "high"),
    ("region_chroma_drift", 6.0, 12.0, "high"),
    ("edge_preservation", 0.8, 0.65, "low"),
    ("perf_time_ratio", 1.25, 1.75, "high"),
    ("perf_ram_ratio", 1.25, 2.0, "high"),
]
VERDICTS = ["PASS", "REVIEW", "REGRESSION"]


def thresholds(spark) -> DataFrame:
    return spark.createDataFrame(THRESHOLDS, "check string, warn double, regress double, direction string")


def clip_ratio(before: Column, after: Column) -> Column:
    """Growth of a clipped share; from nothing to nothing it is 1, to something infinite."""
    return F.when(before > 1e-6, F.try_divide(after, before)).when(after <= 1e-6, 1.0).otherwise(F.lit(float("inf")))


def findings(measures: DataFrame, limits: DataFrame, value: str = "value") -> DataFrame:
    """``measures`` (with a ``check`` column) and their ``level``: PASS, REVIEW, REGRESSION; unknown checks pass."""
    joined = measures.join(F.broadcast(limits), "check", "left")
    high, v = F.col("direction") == "high", F.col(value)
    regress = (high & (v > F.col("regress"))) | (~high & (v < F.col("regress")))
    warn = (high & (v > F.col("warn"))) | (~high & (v < F.col("warn")))
    return joined.withColumn("level", F.when(regress, "REGRESSION").when(warn, "REVIEW").otherwise("PASS")).drop("warn", "regress", "direction")


def worst(level: str = "level") -> Column:
    """The worst verdict of a group."""
    rank = F.max(F.when(F.col(level) == "REGRESSION", 2).when(F.col(level) == "REVIEW", 1).otherwise(0))
    return F.element_at(F.array(*[F.lit(v) for v in VERDICTS]), rank + 1)


def compare_perf(candidate: DataFrame, baseline: DataFrame, keys: list[str], least_seconds: float = 2.0) -> DataFrame:
    """Time and memory ratios by key; baselines under two seconds are noise and pass."""
    base = baseline.select(*keys, F.col("time_s").alias("base_s"), F.col("ram_mb").alias("base_mb"))
    joined = candidate.select(*keys, "time_s", "ram_mb").join(base, keys)
    fast = F.col("base_s") < least_seconds
    t = F.when(~fast, F.col("time_s") / F.greatest(F.col("base_s"), F.lit(1e-6)))
    m = F.when(~fast, F.col("ram_mb") / F.greatest(F.col("base_mb"), F.lit(1e-6)))
    limits = {c: (w, r) for c, w, r, _ in THRESHOLDS}
    (tw, tr), (mw, mr) = limits["perf_time_ratio"], limits["perf_ram_ratio"]
    verdict = F.when(fast, "PASS").when((t > tr) | (m > mr), "REGRESSION").when((t > tw) | (m > mw), "REVIEW").otherwise("PASS")
    return joined.select(*keys, t.alias("time_ratio"), m.alias("ram_ratio"), verdict.alias("verdict"), fast.alias("skipped"))


def consensus(reviews: DataFrame, item: str, reviewer: str, outcome: str, critical: Column) -> DataFrame:
    """State of each item: two independent reviews that agree settle it; disagreement or a critical defect asks for a third."""
    first = reviews.groupBy(item, reviewer).agg(F.min(outcome).alias("o"), F.max(critical.cast("int")).alias("c"))
    found = first.groupBy(item).agg(
        F.count(F.lit(1)).alias("n_reviews"), F.countDistinct("o").alias("n_outcomes"), F.max("c").alias("critical"), F.min("o").alias("outcome")
    )
    third = (F.col("n_outcomes") > 1) | (F.col("critical") == 1)
    state = F.when(F.col("n_reviews") < 2, "incomplete").when(third & (F.col("n_reviews") < 3), "needs_third").when(third, "adjudicate").otherwise("settled")
    return found.withColumn("state", state).withColumn("outcome", F.when(F.col("state") == "settled", F.col("outcome")))


def unmatched(expected: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """Expected items without a review and reviews of unexpected items."""
    lost = expected.select(key).join(found.select(key), key, "left_anti").withColumn("problem", F.lit("missing"))
    odd = found.select(key).distinct().join(expected.select(key), key, "left_anti").withColumn("problem", F.lit("unexpected"))
    return lost.unionByName(odd)


#: Scores of a look's kind, framing and setting.
KIND_SCORES = {"photo": 1.0, "collage": 0.4, "poster": 0.0, "screenshot": 0.0}
FRAMING_SCORES = {"pair": 1.0, "full-body": 1.0, "three-quarter": 0.75, "half-body": 0.45, "close-up": 0.25, "wide": 0.5}
SETTING_SCORES = {"outdoor": 1.0, "studio": 1.0, "indoor": 0.6, "event-floor": 0.6}


def _score(name: Column, scores: dict[str, float]) -> Column:
    return F.create_map(*[F.lit(x) for kv in scores.items() for x in kv])[name]


def merged_looks(covers: DataFrame, looks: DataFrame, key: str) -> DataFrame:
    """``covers`` (``photo, costume, light, measured_light``) with what a labelled look says: kind, framing (several people make a pair
    unless it is wide; a hidden costume counts 0.6), and half of the light from the setting. Covers without a look stay."""
    joined = covers.join(looks.select(key, "kind", "framing", "people", "costume_readable", "setting", F.lit(True).alias("__seen")), key, "left")
    framing = F.when((F.col("framing") != "wide") & (F.coalesce("people", F.lit(0)) >= 2), "pair").otherwise(F.col("framing"))
    costume = F.round(_score(framing, FRAMING_SCORES) * F.when(F.col("costume_readable") == F.lit(False), 0.6).otherwise(1.0), 4)
    light = F.round(0.5 * F.col("measured_light") + 0.5 * _score(F.col("setting"), SETTING_SCORES), 4)
    seen = F.col("__seen").isNotNull()
    return joined.select(
        key, F.when(seen, _score(F.col("kind"), KIND_SCORES)).otherwise(F.col("photo")).alias("photo"),
        F.when(seen, costume).otherwise(F.col("costume")).alias("costume"), F.coalesce(F.when(seen, light), "light").alias("light"),
    )


def face_gate(covers: DataFrame, eyes: str, sharpness: str) -> DataFrame:
    """``gate`` of each cover: 0.6 for closed eyes, 0.8 for a face below 0.6 of the shoot's median sharpness, which counts from three measured
    faces on."""
    middle = robust.median_of(covers, sharpness).select(F.when(F.col("n") >= 3, F.col("median")).alias("__median"))
    soft = F.coalesce((F.col("__median") != 0) & (F.col(sharpness) < 0.6 * F.col("__median")), F.lit(False))
    gate = F.when(F.col(eyes) == "closed", 0.6).otherwise(1.0) * F.when(soft, 0.8).otherwise(1.0)
    return covers.join(F.broadcast(middle), F.lit(True)).withColumn("gate", gate).drop("__median")


def suggested(analysis: DataFrame, key: str) -> DataFrame:
    """Suggested settings from a frame's measures (``mean_l, p1, p95, p99`` of 255, ``noise, sharpness``); null where none is called for."""
    mean, p1, p95, p99 = (F.col(c) for c in ("mean_l", "p1", "p95", "p99"))
    whole = lambda x, low, high: F.least(F.greatest(x, F.lit(float(low))), F.lit(float(high))).cast("int")
    off = 128 - mean
    brightness = F.when(mean < 80, whole(off * 0.15, 0, 12)).when(mean > 180, whole(off * 0.3, -20, 0)).otherwise(whole(off * 0.5, -30, 30))
    span = p95 - p1
    return analysis.select(
        key, F.when(F.abs(brightness) >= 1, brightness).alias("brightness"), F.when(p1 < 10, whole((12 - p1) * 0.5, 0, 60)).alias("blacks"),
        F.when(p99 > 240, whole((240 - p99) * 1.5, -60, 0)).alias("whites"), F.when(p95 > 235, whole(235 - p95, -40, 0)).alias("highlights"),
        F.when(span < 120, whole((120 - span) * 0.3, 0, 30)).when(span > 230, whole((230 - span) * 0.3, -20, 0)).alias("contrast"),
        F.when(F.col("noise") > 0.25, whole(F.bround(F.col("noise") * 60), 0, 100)).alias("denoise"),
        F.when(F.col("sharpness") < 0.2, whole((0.2 - F.col("sharpness")) * 200, 5, 40)).alias("sharpen"),
    )


def qa_status(available: Column, flagged: Column) -> Column:
    """What became of a detector: null availability counts as available, null flags as passed."""
    return F.when(available == F.lit(False), "unavailable").when(F.coalesce(flagged, F.lit(False)), "flagged").otherwise("passed")


def qa_rollup(results: DataFrame, job: str, status: str) -> DataFrame:
    """``flagged, passed, unavailable, n`` of each job."""
    count = lambda s: F.count(F.when(F.col(status) == s, 1)).alias(s)
    return results.groupBy(job).agg(count("flagged"), count("passed"), count("unavailable"), F.count(F.lit(1)).alias("n"))


def decided(records: DataFrame, decisions: DataFrame, key: str, order: str) -> DataFrame:
    """``records`` with the latest ``decision`` of each, ``undecided`` without one."""
    last = decisions.groupBy(key).agg(F.max_by("decision", order).alias("decision"))
    return records.join(last, key, "left").withColumn("decision", F.coalesce("decision", F.lit("undecided")))


def with_default(items: DataFrame, value: str, otherwise: float = 1.0) -> DataFrame:
    """Missing or non-positive values take the median of the known ones, or ``otherwise`` where none is known."""
    known = robust.median_of(items.where(F.col(value) > 0), value).select(F.coalesce("median", F.lit(otherwise)).alias("__default"))
    filled = F.when(F.col(value) > 0, F.col(value)).otherwise(F.col("__default"))
    return items.join(F.broadcast(known), F.lit(True)).withColumn(value, filled).drop("__default")
