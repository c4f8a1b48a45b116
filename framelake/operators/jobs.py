"""Life cycle of watch-folder jobs as tables: merge, lease recovery, queueing, verification."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: How far a status has come.
STATUS_RANK = {"pending": 0, "queued": 1, "processing": 2, "done": 3, "failed": 3}


def status_rank(status: Column) -> Column:
    ranks = F.create_map(*[x for k, v in STATUS_RANK.items() for x in (F.lit(k), F.lit(v))])
    return F.coalesce(ranks[status], F.lit(0))


def merge_records(base: DataFrame, local: DataFrame, incoming: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Three-way merge by key. A field that one side left as it was takes the other side's value; where both changed it, ``attempts``
    takes the larger, ``status`` the one that came further (local on a tie) and any other field the local one."""
    side = lambda d, p: d.select(F.col(key).alias(key), F.lit(True).alias(f"{p}__"), *[F.col(f).alias(f"{p}_{f}") for f in fields])
    joined = side(local, "l").join(side(incoming, "i"), key, "full").join(side(base, "b"), key, "left")

    def merged(f: str) -> Column:
        mine, theirs, before = (F.col(f"{p}_{f}") for p in "lib")
        both = {
            "attempts": F.greatest(mine, theirs),
            "status": F.when(status_rank(theirs) > status_rank(mine), theirs).otherwise(mine),
        }.get(f, mine)
        kept = F.when(mine.eqNullSafe(before), theirs).when(theirs.eqNullSafe(before), mine).otherwise(both)
        return F.when(F.col("i__").isNull(), mine).when(F.col("l__").isNull(), theirs).otherwise(kept).alias(f)

    return joined.select(key, *[merged(f) for f in fields])


def merge_jobs(base: DataFrame, local: DataFrame, incoming: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Three-way merge of jobs by key: a field that the local side left as it was takes the incoming value, any other stays local; ``attempts`` never
    falls behind the incoming one. Jobs of one side only stay."""
    side = lambda d, p: d.select(F.col(key).alias(key), F.lit(True).alias(f"{p}__"), *[F.col(f).alias(f"{p}_{f}") for f in fields])
    joined = side(local, "l").join(side(incoming, "i"), key, "full").join(side(base, "b"), key, "left")

    def merged(f: str) -> Column:
        mine, theirs, before = (F.col(f"{p}_{f}") for p in "lib")
        kept = F.when(mine.eqNullSafe(before), theirs).otherwise(mine)
        kept = F.greatest(kept, theirs) if f == "attempts" else kept
        return F.when(F.col("i__").isNull(), mine).when(F.col("l__").isNull(), theirs).otherwise(kept).alias(f)

    return joined.select(key, *[merged(f) for f in fields])


def recover_stale(jobs: DataFrame, now: Column, max_age_seconds: float = 3600.0) -> DataFrame:
    """Processing attempts that began too long ago, or at a time that can't be read, go back into the queue; ``recovered`` tells which."""
    started = F.try_to_timestamp(F.col("started_at"))
    age = F.unix_micros(now) - F.unix_micros(started)
    stale = (F.col("status") == "processing") & (F.coalesce("started_at", F.lit("")) != "") & (started.isNull() | (age >= max_age_seconds * 1e6))
    return jobs.withColumn("recovered", F.coalesce(stale, F.lit(False))).withColumns({
        "status": F.when(F.col("recovered"), "queued").otherwise(F.col("status")),
        "error_code": F.when(F.col("recovered"), "worker_lost").otherwise(F.col("error_code")),
        "started_at": F.when(~F.col("recovered"), F.col("started_at")),
    })


def job_key(*parts: Column) -> Column:
    """Idempotency key of content, kind, settings, pipeline and output."""
    return F.sha2(F.concat_ws("\x1f", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), 256)


def queue_jobs(ready: DataFrame, jobs: DataFrame, limit: int) -> tuple[DataFrame, DataFrame]:
    """``ready`` rows (``path, kind, job_id``) to be queued now, the first by path; and the queued jobs that they replace: of the same
    path and kind under another id. Jobs that exist are not queued again."""
    new = ready.join(jobs.select("job_id"), "job_id", "left_anti").orderBy("path", "kind").limit(limit)
    waiting = jobs.where("status = 'queued'")
    replaced = waiting.join(ready.select("path", "kind", F.col("job_id").alias("__new")), ["path", "kind"]).where("job_id != __new").drop("__new")
    return new, replaced.dropDuplicates(["job_id"])


def vanished(records: DataFrame, listing: DataFrame, path: str = "path") -> DataFrame:
    """Records in processing whose source is no longer listed: they fail."""
    return records.where("status = 'processing'").join(listing.select(path), path, "left_anti").withColumn("status", F.lit("failed"))


def verified(jobs: DataFrame, outputs: DataFrame, key: str = "job_id") -> DataFrame:
    """Jobs that ran, against what lies at their output: done only if it is there, not empty, and has the reported digest."""
    found = outputs.select(key, F.col("size").alias("__size"), F.col("sha256").alias("__sha"))
    code = (
        F.when(F.col("__size").isNull(), "output_missing").when(F.col("__size") <= 0, "output_empty").when(~F.col("sha256").eqNullSafe(F.col("__sha")), "output_changed")
    )
    joined = jobs.join(found, key, "left").withColumn("error_code", code)
    return joined.withColumn("status", F.when(F.col("error_code").isNull(), "done").otherwise("failed")).drop("__size", "__sha")


def undo_redo(events: DataFrame, key: str, order: str, action: str, value: str, depth: int) -> DataFrame:
    """``key, value, can_undo, can_redo`` of each session after its events: ``push`` adds a state behind the cursor and drops those
    ahead, of which the last ``depth`` are kept; ``undo`` and ``redo`` move the cursor within what there is.

    A session's events are folded as one array within the JVM; the state holds ``depth`` values.
    """
    rows = events.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(action).alias("a"), F.col(value).alias("v")))).alias("e"))
    kind = events.schema[value].dataType.simpleString()

    def step(s: Column, e: Column) -> Column:
        grown = F.concat(F.slice(s["held"], F.lit(1), s["at"]), F.array(e["v"]))
        kept = F.slice(grown, F.greatest(F.size(grown) - depth + 1, F.lit(1)), F.lit(depth))
        push, undo = e["a"] == "push", e["a"] == "undo"
        at = F.when(push, F.size(kept)).when(undo, F.greatest(s["at"] - 1, F.least(F.size(s["held"]), F.lit(1)))).otherwise(F.least(s["at"] + 1, F.size(s["held"])))
        return F.struct(F.when(push, kept).otherwise(s["held"]).alias("held"), at.alias("at"))

    start = F.struct(F.array().cast(f"array<{kind}>").alias("held"), F.lit(0).alias("at"))
    end = rows.select(key, F.aggregate("e", start, step).alias("s"))
    return end.select(key, F.get("s.held", F.col("s.at") - 1).alias(value), (F.col("s.at") > 1).alias("can_undo"), (F.col("s.at") < F.size("s.held")).alias("can_redo"))
