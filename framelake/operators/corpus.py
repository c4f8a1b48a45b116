"""Checks and reports of corpus manifests, duplicate groups and experiments."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SPLITS = ("dev", "calibration", "locked_test")


def _problem(df: DataFrame, kind: str, subject: Column, detail: Column) -> DataFrame:
    return df.select(F.lit(kind).alias("problem"), subject.cast("string").alias("subject"), detail.cast("string").alias("detail"))


def manifest_errors(assets: DataFrame, required: DataFrame, splits: tuple[str, ...] = SPLITS) -> DataFrame:
    """``problem, subject, detail`` of a manifest (``asset_id, path, sha256, split, group_id, person_ids, tags``): repeated ids, paths
    and hashes, unknown splits, groups and persons in several splits, and ``required`` (``split, tag, n``) counts that are missed.

    Each rule is one aggregate over its own key.
    """
    found = []
    for column in ("asset_id", "path", "sha256"):
        repeated = assets.where(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        found.append(_problem(repeated, f"repeated_{column}", F.col(column), F.col("n")))
    found.append(_problem(assets.where(~F.coalesce(F.col("split").isin(*splits), F.lit(False))), "unknown_split", F.col("asset_id"), F.col("split")))
    persons = assets.select("split", F.explode("person_ids").alias("unit"))
    for kind, units in (("group", assets.select("split", F.col("group_id").alias("unit"))), ("person", persons)):
        several = units.where("unit is not null").groupBy("unit").agg(F.array_sort(F.collect_set("split")).alias("s")).where("size(s) > 1")
        found.append(_problem(several, f"{kind}_in_several_splits", F.col("unit"), F.array_join("s", ",")))
    seen = assets.select("split", F.explode("tags").alias("tag")).groupBy("split", "tag").agg(F.count(F.lit(1)).alias("__n"))
    short = required.join(seen, ["split", "tag"], "left").where(F.coalesce("__n", F.lit(0)) < F.col("n"))
    found.append(_problem(short, "missing_coverage", F.concat_ws("/", "split", "tag"), F.concat_ws(" of ", F.coalesce("__n", F.lit(0)), "n")))
    return reduce(DataFrame.unionByName, found)


def split_report(assets: DataFrame) -> DataFrame:
    """``split, n_assets, n_persons, tags`` for each split: assets, distinct persons, and how often each tag occurs (``tag=n``, sorted)."""
    persons = assets.select("split", F.explode("person_ids").alias("p")).groupBy("split").agg(F.count_distinct("p").alias("n_persons"))
    tags = assets.select("split", F.explode("tags").alias("t")).groupBy("split", "t").agg(F.count(F.lit(1)).alias("n"))
    listed = tags.groupBy("split").agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws("=", "t", "n"))), ",").alias("tags"))
    counts = assets.groupBy("split").agg(F.count(F.lit(1)).alias("n_assets"))
    return counts.join(persons, "split", "left").join(listed, "split", "left").select("split", "n_assets", F.coalesce("n_persons", F.lit(0)).alias("n_persons"), "tags")


def pair_reason(aspect_a: Column, aspect_b: Column, similarity: Column, colour: Column, changed: Column, least: float, most_changed: float, most_colour: float, tolerance: float = 0.03) -> Column:
    """Why two frames are or aren't the same shot, from what was measured of the pair; the first test that fails names it."""
    return (
        F.when(F.abs(aspect_a - aspect_b) > tolerance * F.greatest(aspect_a, aspect_b), "different_aspect").when(colour > most_colour, "different_colour")
        .when(similarity < least, "different_composition").when(changed > most_changed, "pose_changed").otherwise("same_pose_and_framing")
    )


def duplicate_report(members: DataFrame, pairs: DataFrame, group: str, key: str, score: str, time: str) -> DataFrame:
    """One row per group of two or more: its best row as keeper (ties: smallest key), the others as extras, the weakest similarity and
    largest change between members, and the time between first and last."""
    best = F.max_by(F.col(key), F.struct(F.col(score), (-F.col(key)).alias("k")))
    found = members.groupBy(group).agg(
        F.count(F.lit(1)).alias("n"), best.alias("keeper"), F.array_sort(F.collect_list(key)).alias("__all"), (F.max(time) - F.min(time)).alias("span")
    ).where("n > 1")
    evidence = pairs.groupBy(group).agg(F.min("similarity").alias("least_similarity"), F.max("changed").alias("most_changed"))
    return found.join(evidence, group, "left").withColumn("extras", F.array_remove(F.col("__all"), F.col("keeper"))).drop("__all")


def extras(members: DataFrame, group: str, key: str, score: str) -> DataFrame:
    """All rows of each group but its best one."""
    place = F.row_number().over(Window.partitionBy(group).orderBy(F.desc(score), F.asc(key)))
    return members.withColumn("__n", place).where("__n > 1").drop("__n")


def experiment_verdict(run: DataFrame, expected: Column, least_delta: float, least_positive: float, most_regressed: float, most_time: float, most_ram: float) -> DataFrame:
    """``verdict`` of each measured arm (``n, median_delta, positive, regressed, checks, time_ratio, ram_ratio``): FAIL if a criterion is
    broken, else INCONCLUSIVE if something wasn't measured, else PASS."""
    uncertain = (F.col("n") != expected) | F.col("median_delta").isNull() | F.col("time_ratio").isNull() | F.col("ram_ratio").isNull()
    fails = [
        (F.col("n") == expected) & (F.col("median_delta") < least_delta),
        (F.col("n") > 0) & (F.try_divide(F.col("positive"), F.col("n")) < least_positive),
        F.col("regressed") / F.greatest(F.col("checks"), F.lit(1)) > most_regressed,
        F.col("time_ratio") > most_time,
        F.col("ram_ratio") > most_ram,
    ]
    failed = reduce(lambda a, b: a | b, [F.coalesce(x, F.lit(False)) for x in fails])
    return run.withColumn("verdict", F.when(failed, "FAIL").when(uncertain, "INCONCLUSIVE").otherwise("PASS"))


def portfolio(log: DataFrame, targets: dict[str, float], gap: float) -> DataFrame:
    """``kind, actual, target, warned``: share of the work of each kind, and whether it is over its target by the gap."""
    total = log.count()
    counts = log.groupBy("kind").agg(F.count(F.lit(1)).alias("n"))
    plan = log.sparkSession.createDataFrame(list(targets.items()), "kind string, target double")
    actual = F.round(F.coalesce("n", F.lit(0)) / max(total, 1), 3)
    return plan.join(counts, "kind", "left").select("kind", actual.alias("actual"), "target", (actual >= F.col("target") + gap).alias("warned"))


def selected_cases(cases: DataFrame, changed: DataFrame, rules: list[tuple[str, list[str]]], default: list[str]) -> DataFrame:
    """Cases with one of the tags that changed paths call for: of each path those of the first rule whose prefix it has; ``default`` where
    no path has one. ``full`` selects all cases, ``none`` alone none. Rules are a short list."""
    first = F.lit(None).cast("array<string>")
    for prefix, tags in reversed(rules):
        first = F.when(F.startswith("path", F.lit(prefix)), F.array(*map(F.lit, tags))).otherwise(first)
    active = changed.select(F.explode(first).alias("tag")).agg(F.collect_set("tag").alias("tags"))  # as many as the rules have
    active = active.select(F.when(F.size("tags") == 0, F.array(*map(F.lit, default))).when(F.size("tags") > 1, F.array_remove("tags", "none")).otherwise(F.col("tags")).alias("__tags"))
    hit = F.arrays_overlap("tags", "__tags") | F.array_contains("__tags", "full")
    return cases.join(F.broadcast(active), F.lit(True)).where(hit & ~F.array_contains("__tags", "none")).drop("__tags")


def review_ids(case: Column, recipe: Column) -> Column:
    """``case::recipe``; null unless both have something."""
    a, b = F.trim(case.cast("string")), F.trim(recipe.cast("string"))
    return F.when((a != "") & (b != ""), F.concat_ws("::", a, b))


def asset_ids(path: Column, sha256: Column) -> Column:
    return F.concat(F.lit("asset-"), F.substring(F.sha2(F.concat(path, F.lit("\x00"), sha256), 256), 1, 24))


def blinded(item: Column, source: Column, output: Column, seed: str) -> tuple[Column, Column]:
    """Opaque ids of the left and the right side of a review pair; the parity of the commitment's last byte tells the sides."""
    quoted = lambda c: F.to_json(F.struct(c.cast("string").alias("item_id"), output.cast("string").alias("output"), F.lit(seed).alias("seed"), source.cast("string").alias("source")))
    commitment = F.sha2(quoted(item), 256)
    even = F.conv(F.substring(commitment, -2, 2), 16, 10).cast("int") % 2 == 0
    side = lambda first: F.concat(F.lit("p2-"), F.substring(commitment, 1, 24), F.lit("-"), F.when(even, first).otherwise("b" if first == "a" else "a"))
    return side("a"), side("b")
