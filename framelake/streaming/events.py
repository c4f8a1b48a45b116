"""Folds over event streams."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import LongType, StructField, StructType

from ..storage import new_folder


def work_dir(spark: SparkSession) -> str:
    """A new folder below the shared checkpoint folder; ``storage.release_all`` removes it."""
    return new_folder(spark, "stream")


def _status(spark: SparkSession, path: str):
    """What Spark's file systems say about a path; None where nothing is."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    store = at.getFileSystem(spark._jsc.hadoopConfiguration())
    return store.getFileStatus(at) if store.exists(at) else None


def file_stream(spark: SparkSession, folder: str, name: str, schema: StructType, files_per_trigger: int | None = None) -> DataFrame:
    """A stream of the parquet files of a table, a single file or a directory of part files; new files are picked up as they appear."""
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    table = f"{folder.rstrip('/')}/{name}.parquet"
    status = _status(spark, table)
    if status is not None and status.isDirectory():
        return reader.parquet(table)
    return reader.option("pathGlobFilter", f"{name}.parquet").parquet(folder)


def drain(stream: DataFrame, mode: str, keys: list[str] | None = None) -> DataFrame:
    """All that the stream has now, as a table: appended rows, the last complete result, or (update mode) the last row
    of each of ``keys``, by default of the first column."""
    spark, at = stream.sparkSession, work_dir(stream.sparkSession)
    out = f"{at}/out"
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{at}/state").trigger(availableNow=True)
    if mode == "append":
        query = writer.format("parquet").option("path", out).start()
    elif mode == "update":
        query = writer.foreachBatch(lambda df, i: df.write.mode("overwrite").parquet(f"{out}/__batch={i}")).start()
    else:
        query = writer.foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(out)).start()
    query.awaitTermination()
    if _status(spark, out) is None:  # no batch has run
        return spark.createDataFrame([], stream.schema)
    if mode != "update":
        return spark.read.schema(stream.schema).parquet(out)
    rows = spark.read.schema(StructType([*stream.schema.fields, StructField("__batch", LongType())])).parquet(out)
    last = F.max_by(F.struct(*stream.columns), "__batch").alias("last")
    return rows.groupBy(*(keys or stream.columns[:1])).agg(last).select("last.*")


def windowed(events: DataFrame, time: str, width: str, late: str, keys: list[str], value: str) -> DataFrame:
    """Counts and sums per time window and key; a window is final once the watermark has passed it."""
    timed = events.withColumn("__ts", F.col(time).cast("timestamp")).withWatermark("__ts", late)
    found = timed.groupBy(F.window("__ts", width), *keys).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"))
    return found.select(F.unix_micros("window.start").alias("window_us"), *keys, "n", "total")


def progress(events: DataFrame, key: str, order: list[str], columns: list[str]) -> DataFrame:
    """Last known state and number of events of each key (complete mode)."""
    at = F.struct(*order)
    return events.groupBy(key).agg(*[F.max_by(c, at).alias(c) for c in columns], F.count(F.lit(1)).alias("n_events"))


def unique_jobs(events: DataFrame, time: str, late: str, keys: list[str]) -> DataFrame:
    """The first of the events that share an idempotency key; keys are forgotten when the watermark passes them."""
    return events.withColumn("__ts", F.col(time).cast("timestamp")).withWatermark("__ts", late).dropDuplicatesWithinWatermark(keys).drop("__ts")


def hysteresis(events: DataFrame, key: str, time: str, value: str, on: float, off: float) -> DataFrame:
    """``key, n, n_on, state`` after each micro-batch: the on/off state survives between batches (update mode)."""

    def step(name: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, n_on, now = state.get if state.exists else (0, 0, False)
        values = pd.concat(list(batches)).sort_values(time, kind="stable")[value].to_numpy(float)
        marks = np.where(values > on, 1, np.where(values < off, 0, -1))  # between, or not a number: as before
        last = np.maximum.accumulate(np.where(marks >= 0, np.arange(len(marks)), -1))
        states = np.where(last >= 0, marks[last] == 1, now)
        n, n_on, now = n + len(states), n_on + int(states.sum()), bool(states[-1])
        state.update((n, n_on, now))
        yield pd.DataFrame({key: [name[0]], "n": [n], "n_on": [n_on], "state": [now]})

    kind = events.schema[key].dataType.simpleString()
    return events.select(key, time, value).groupBy(key).applyInPandasWithState(
        step, f"{key} {kind}, n long, n_on long, state boolean", "n long, n_on long, state boolean", "update", GroupStateTimeout.NoTimeout
    )


def stalled(events: DataFrame, key: str, time: str, after_ms: int) -> DataFrame:
    """``key, last_us`` of keys without an event for ``after_ms`` of processing time (a timer per key; update mode)."""

    def step(name: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            (last,) = state.get
            state.remove()
            yield pd.DataFrame({key: [name[0]], "last_us": [last]})
            return
        last = state.get[0] if state.exists else 0
        for rows in batches:
            last = max(last, int(rows["__us"].max()))
        state.update((last,))
        state.setTimeoutDuration(after_ms)

    kind = events.schema[key].dataType.simpleString()
    timed = events.select(key, F.unix_micros(F.col(time).cast("timestamp")).alias("__us"))
    return timed.groupBy(key).applyInPandasWithState(step, f"{key} {kind}, last_us long", "last_us long", "update", GroupStateTimeout.ProcessingTimeTimeout)


def stable_files(scans: DataFrame) -> DataFrame:
    """Files of a polled folder: ready after two scans with equal size and modification time (``path, signature, scan``; update mode)."""

    def step(name: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seen, _ = state.get if state.exists else ("", "new")
        every = pd.concat(list(batches)).sort_values("scan", kind="stable")["signature"].to_numpy()
        before = every[-2] if len(every) > 1 else seen
        status = "ready" if every[-1] == before else "settling"
        state.update((every[-1], status))
        yield pd.DataFrame({"path": [name[0]], "signature": [every[-1]], "status": [status]})

    return scans.groupBy("path").applyInPandasWithState(
        step, "path string, signature string, status string", "signature string, status string", "update", GroupStateTimeout.NoTimeout
    )
