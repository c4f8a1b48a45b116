"""Plans that can be resumed and don't collide; splits, coverage, leakage; state merges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import saved
from .ordered import SLICE_ROWS, numbered, walked

LEVELS = ["A0", "A1", "A2", "A3", "A4", "A5"]


def conflicts(df: DataFrame, source: str, destination: Column) -> DataFrame:
    """Destinations, folded to lower case, that more than one source asks for."""
    folded = df.select(source, F.lower(destination).alias("destination"))
    return folded.groupBy("destination").agg(F.count(F.lit(1)).alias("n"), F.min(source).alias("first_source")).where("n > 1")


def output_plan(files: DataFrame, path: str, stem: str, ext: str, out_ext: Column) -> DataFrame:
    """``output`` for each file: its stem; where stems collide, with the source's extension; where that collides, with
    eight digits of the path's digest."""
    base = F.concat(F.col(stem), F.lit("."), out_ext)
    n1 = F.count(F.lit(1)).over(Window.partitionBy(F.lower(base)))
    second = F.concat(F.col(stem), F.lit("_"), F.col(ext), F.lit("."), out_ext)
    one = files.withColumn("__o", F.when(n1 == 1, base).otherwise(second)).withColumn("__c1", n1)
    n2 = F.count(F.lit(1)).over(Window.partitionBy(F.lower("__o")))
    third = F.concat(F.col(stem), F.lit("_"), F.col(ext), F.lit("_"), F.substring(F.sha2(path, 256), 1, 8), F.lit("."), out_ext)
    return one.withColumn("output", F.when(n2 == 1, F.col("__o")).otherwise(third)).drop("__o", "__c1")


def pair_policy(files: DataFrame, folder: str, stem: str, is_raw: Column, policy: str) -> DataFrame:
    """RAW+JPEG pairs share folder and folded stem. Policies: raw-only, jpeg-only, suffix (both, marked), error (both rejected)."""
    w = Window.partitionBy(folder, F.lower(stem))
    paired = (F.max(is_raw.cast("int")).over(w) == 1) & (F.min(is_raw.cast("int")).over(w) == 0)
    drop = {"raw-only": paired & ~is_raw, "jpeg-only": paired & is_raw}.get(policy, F.lit(False))
    status = F.when(drop, "excluded").when(paired & F.lit(policy == "error"), "rejected").otherwise("selected")
    return files.withColumns({"paired": paired, "status": status})


def resume(plan: DataFrame, done: DataFrame, key: str, hashes: list[str]) -> DataFrame:
    """``plan`` with ``resume_action``: skip if the finished row has the same hashes, else the reason to run."""
    prior = done.select(F.col(key).alias("__k"), *[F.col(h).alias(f"__{h}") for h in hashes])
    same = F.lit(True)
    for h in hashes:
        same = same & F.coalesce(F.col(h) == F.col(f"__{h}"), F.lit(False))
    action = F.when(F.col("__k").isNull(), "run:new").when(same, "skip:verified").otherwise("run:changed")
    return plan.join(prior, F.col(key) == F.col("__k"), "left").withColumn("resume_action", action).drop("__k", *[f"__{h}" for h in hashes])


def observe(prior: DataFrame, seen: DataFrame, key: str, content: str, decision: str) -> DataFrame:
    """Merge an observation into review state: same content keeps its decision, changed content falls back to hold, new rows
    are undecided, rows not seen stay but are absent."""
    a = prior.select(F.col(key).alias("__k"), F.col(content).alias("__c"), F.col(decision).alias("__d"))
    b = seen.select(key, content)
    merged = b.join(a, F.col(key) == F.col("__k"), "full")
    state = (
        F.when(F.col(key).isNull(), F.col("__d")).when(F.col("__k").isNull(), "undecided")
        .when(F.col(content).eqNullSafe(F.col("__c")), F.col("__d")).otherwise("hold")
    )
    change = F.when(F.col(key).isNull(), "absent").when(F.col("__k").isNull(), "new").when(F.col(content).eqNullSafe(F.col("__c")), "same").otherwise("changed")
    return merged.select(F.coalesce(key, "__k").alias(key), state.alias("decision"), change.alias("change"))


def reconcile(prior: DataFrame, found: DataFrame, key: str = "id") -> DataFrame:
    """Findings against known ones: new opens, unseen resolves, a resolved one seen again has regressed; an accepted or
    suppressed one reopens when its term is over or its metric grew by half."""
    a = prior.select(F.col(key).alias("__k"), F.col("status").alias("__s"), F.col("metric").alias("__m"), F.col("expired").alias("__e"))
    joined = found.select(key, "metric").join(a, F.col(key) == F.col("__k"), "full")
    parked = F.col("__s").isin("ACCEPTED", "SUPPRESSED")
    grown = (F.col("__m") > 0) & (F.col("metric") >= 1.5 * F.col("__m"))
    status = (
        F.when(F.col("__k").isNull(), "OPEN")
        .when(F.col(key).isNull(), F.when(F.col("__s").isin("RESOLVED", "ACCEPTED", "SUPPRESSED"), F.col("__s")).otherwise("RESOLVED"))
        .when(F.col("__s") == "RESOLVED", "REGRESSED")
        .when(parked & (F.coalesce("__e", F.lit(True)) | F.coalesce(grown, F.lit(False))), "OPEN")
        .otherwise(F.col("__s"))
    )
    return joined.select(F.coalesce(key, "__k").alias(key), status.alias("status"), F.coalesce("metric", "__m").alias("metric"))


def leakage(df: DataFrame, unit: str, split: str) -> DataFrame:
    """Units that appear in more than one split."""
    found = df.groupBy(unit).agg(F.countDistinct(split).alias("n_splits"), F.array_join(F.array_sort(F.collect_set(split)), ",").alias("splits"))
    return found.where("n_splits > 1")


def coverage(df: DataFrame, split: str, tag: str) -> DataFrame:
    """Rows per split and tag, per split, per tag and in all (nulls: all)."""
    return df.groupingSets([[split, tag], [split], [tag], []], split, tag).agg(F.count(F.lit(1)).alias("n"))


def missing(required: DataFrame, observed: DataFrame, keys: list[str]) -> DataFrame:
    return required.join(observed, keys, "left_anti")


def subject_split(df: DataFrame, subject: str, seed: str, share: float = 0.2) -> DataFrame:
    """``subject, split``: subjects ordered by the digest of seed:subject; the last fifth is held out, the fifth before validates.

    Places come from counts by digest prefix (4,096 ranges), so no task orders all subjects.
    """
    subjects = df.select(F.col(subject).alias("subject")).where(F.col(subject).isNotNull()).distinct()
    keyed = subjects.withColumn("h", F.sha2(F.concat(F.lit(f"{seed}:"), F.col("subject").cast("string")), 256)).withColumn("b", F.substring("h", 1, 3))
    counts = keyed.groupBy("b").agg(F.count(F.lit(1)).alias("c"))
    every = Window.orderBy("b").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    below = counts.select("b", (F.sum("c").over(Window.orderBy("b")) - F.col("c")).alias("below"), F.sum("c").over(every).alias("total"))
    place = F.col("below") + F.row_number().over(Window.partitionBy("b").orderBy("h"))
    held = F.greatest(F.lit(2), F.bround(F.col("total") * share).cast("long"))
    val = F.greatest(F.lit(1), F.bround(F.col("total") * share).cast("long"))
    split = (
        F.when(F.col("total") < 6, "development").when(F.col("place") > F.col("total") - held, "holdout")
        .when(F.col("place") > F.col("total") - held - val, "validation").otherwise("development")
    )
    return keyed.join(F.broadcast(below), "b").withColumn("place", place).select(F.col("subject").alias(subject), split.alias("split"))


def blocked(tasks: DataFrame, links: DataFrame, key: str, needs: str, done: Column) -> DataFrame:
    """Open prerequisites of each task: ``key, needs``."""
    finished = tasks.where(done).select(F.col(key).alias(needs))
    return links.join(finished, needs, "left_anti").select(key, needs)


def inherit(values: DataFrame, parents: DataFrame) -> DataFrame:
    """``name, path, value, level``: own values and those of all ancestors that no nearer one overrides.

    ``parents``: name, parent. Ancestors are found by doubling: those below 2^k levels up, seen from the ones exactly so many
    levels up, give those below 2^(k+1). Pairs already found are dropped, so a cycle ends when it comes round.
    """
    pair = ["name", "at"]
    nodes = parents.select("name").unionByName(parents.select(F.col("parent").alias("name"))).where("name is not null").distinct()
    every = saved(nodes.select("name", F.col("name").alias("at"), F.lit(0).alias("level")))
    far = saved(parents.where("name is not null and parent is not null and name != parent").select("name", F.col("parent").alias("at")).distinct().withColumn("level", F.lit(1)))

    def beyond(further: DataFrame, found: DataFrame) -> DataFrame:
        """Pairs by way of ``far`` and then ``further`` that are not in ``found``, by the shortest way."""
        onward = further.select(F.col("name").alias("at"), F.col("at").alias("__to"), F.col("level").alias("__more"))
        met = far.join(onward, "at").select("name", F.col("__to").alias("at"), (F.col("level") + F.col("__more")).alias("level"))
        return met.groupBy(*pair).agg(F.min("level").alias("level")).join(found.select(*pair), pair, "left_anti")

    while not far.isEmpty():
        wider = saved(every.unionByName(beyond(every, every)))
        far, every = saved(beyond(far, wider)), wider
    joined = every.join(values.withColumnRenamed("name", "at"), "at")
    w = Window.partitionBy("name", "path").orderBy("level")
    return joined.withColumn("__n", F.row_number().over(w)).where("__n = 1").select("name", "path", "value", "level")


def attention_level(severity: Column, blocking: Column, resolved: Column) -> Column:
    return (
        F.when(resolved | severity.isin("success", "info"), "A0").when(severity == "critical", "A5")
        .when((severity == "error") & (blocking > 0), "A4").when(severity == "error", "A3").when(blocking > 0, "A3")
        .when(severity == "warning", "A2").otherwise("A1")
    )


def attention_score(level: Column, blocking: Column, priority: Column) -> Column:
    """100 per level, 20 per blocked item (ten at most), 5 per step of priority (P0 highest)."""
    return F.array_position(F.array(*[F.lit(x) for x in LEVELS]), level) * 100 - 100 + F.least(blocking, F.lit(10)) * 20 + (4 - priority) * 5


def route(signals: DataFrame, desk: str, budget: int, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """Greedy routing per desk: by score (ties: id), A4 and A5 always, others while the minutes fit; what doesn't fit is skipped.

    Whether a signal fits depends on all before it; the minutes spent are carried from slice to slice of a desk's signals (``ordered.folded``).
    """
    slim = signals.select(desk, "id", "level", "score", "minutes", (-F.col("score")).alias("__order"))

    def step(state: Column, x: Column) -> tuple[dict[str, Column], Column]:
        take = x["level"].isin("A4", "A5") | (state["spent"] + x["minutes"] <= budget)
        return {"spent": state["spent"] + F.when(take, x["minutes"].cast("long")).otherwise(F.lit(0).cast("long"))}, take

    placed = numbered(slim, [desk], ["__order", "id"])
    chosen = walked(placed, desk, ["id", "level", "score", "minutes"], {"spent": F.lit(0).cast("long")}, step, "boolean", slice_rows)
    return chosen.withColumnRenamed("out", "selected")


def batches(df: DataFrame, keys: list[str]) -> DataFrame:
    level = F.array_position(F.array(*[F.lit(x) for x in LEVELS]), F.col("level"))
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.max_by("level", level).alias("max_level"), F.sum("minutes").alias("minutes"))


def in_range(spans: DataFrame, points: DataFrame, keys: list[str], low: str, high: str, at: str, width: int) -> DataFrame:
    """Each span (``low`` to ``high``, both included) with the points of its keys within it, as an equi-join: spans go to every slice of
    ``width`` that they touch, points to their own. A ``width`` near the usual span keeps copies few."""
    touched = F.explode(F.sequence(F.floor(F.col(low) / width).cast("long"), F.floor(F.col(high) / width).cast("long")))
    cut = spans.where(F.col(low) <= F.col(high)).withColumn("__slice", touched)
    met = cut.join(points.withColumn("__slice", F.floor(F.col(at) / width).cast("long")), [*keys, "__slice"])
    return met.where(F.col(at).between(F.col(low), F.col(high))).drop("__slice")
