"""Jobs of a watched folder as one keyed state machine over a stream of their events."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_CARRIED = ("spark.sql.shuffle.partitions", "spark.sql.session.timeZone")
COLUMNS = "status string, attempts int, error_code string, version long"


def state_session(spark: SparkSession) -> SparkSession:
    """A session whose streams keep their state in RocksDB, as several state variables a key need; the caller's is left as it is."""
    own = spark.newSession()
    for name in _CARRIED:
        value = spark.conf.get(name, None)
        if value is not None:
            own.conf.set(name, value)
    own.conf.set("spark.sql.streaming.stateStore.providerClass", _ROCKS)
    return own


class JobMachine(StatefulProcessor):
    """queued -> processing -> done or failed. Three state variables a job: where it stands, its newest output, the events already applied. Each is read and
    written once a job and batch, as every call goes from Python to the JVM and back.

    - ``queue`` takes a new or failed job into the queue.
    - ``start`` begins an attempt of a queued job and its lease; a timer takes an attempt whose lease runs out back (``worker_lost``).
    - ``output`` is a written output with its size.
    - ``finish`` ends an attempt: done if an output of at least one byte was written since it began, else failed (``no_output``).
    - ``fail`` ends an attempt as failed.

    Other events in a state are ignored. An event that is delivered again changes nothing; one older than what was applied
    in an earlier batch comes too late and neither.
    """

    def __init__(self, lease_us: int, remember_us: int, key: str, kind: str):
        self.lease, self.remember, self.key, self.kind = lease_us, remember_us, key, kind

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.job = handle.getValueState("job", "status string, attempts int, started long, error_code string, version long, last long")
        self.output = handle.getValueState("output", "at long, size long")
        self.applied = handle.getValueState("applied", "event_ids array<long>, ats array<long>")

    def _expired(self, job: list, now: int) -> bool:
        """Take an attempt back whose lease has run out by ``now``."""
        if job[0] != "processing" or now < job[2] + self.lease:
            return False
        job[0], job[3] = "queued", "worker_lost"
        return True

    def _apply(self, job: list, output: tuple | None, event: str, at: int) -> bool:
        status = job[0]
        if event == "queue" and status in (None, "failed"):
            job[0], job[3] = "queued", None
        elif event == "start" and status == "queued":
            job[0], job[1], job[2], job[3] = "processing", job[1] + 1, at, None
        elif event == "fail" and status == "processing":
            job[0], job[3] = "failed", "failed"
        elif event == "finish" and status == "processing":
            fine = output is not None and output[0] >= job[2] and output[1] > 0
            job[0], job[3] = ("done", None) if fine else ("failed", "no_output")
        else:
            return False
        return True

    def _row(self, key: tuple, job: list) -> Row:
        return Row(**{self.key: key[0]}, status=job[0], attempts=job[1], error_code=job[3], version=job[4])

    def _timer(self, job: list) -> int | None:
        """When the lease of an attempt ends, in milliseconds."""
        return -(-(job[2] + self.lease) // 1000) if job[0] == "processing" else None

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802, N803
        job = list(self.job.get() or (None, 0, 0, None, 0, -(2**62)))
        output = written = self.output.get()
        applied = dict(zip(*(self.applied.get() or ((), ())), strict=True))
        before, timer = job[4], self._timer(job)
        batch: dict[int, tuple] = {}
        for row in rows:
            batch.setdefault(row.event_id, (row.at, row.event_id, row.event, row.size))
        fresh = sorted((x for x in batch.values() if x[1] not in applied and x[0] >= job[5]), key=lambda x: x[:2])
        for at, event_id, event, size in fresh:
            job[4] += self._expired(job, at)
            if event == "output":
                output = (at, size)
            else:
                job[4] += self._apply(job, output, event, at)
            job[5] = applied[event_id] = at
        if fresh:
            kept = {i: at for i, at in applied.items() if at >= job[5] - self.remember}
            self.applied.update((list(kept), list(kept.values())))
            self.job.update(tuple(job))
        if output != written:
            self.output.update(output)
        if self._timer(job) != timer:
            if timer is not None:
                self.handle.deleteTimer(timer)
            if job[0] == "processing":
                self.handle.registerTimer(self._timer(job))
        if job[4] != before:
            yield self._row(key, job)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        job = list(self.job.get())
        if self._expired(job, expiredTimerInfo.getExpiryTimeInMs() * 1000):
            job[4] += 1
            self.job.update(tuple(job))
            yield self._row(key, job)

    def close(self) -> None:
        pass


def job_states(events: DataFrame, key: str, time: str, lease_seconds: float, late: str, remember_seconds: float = 86_400.0) -> DataFrame:
    """``key, status, attempts, error_code, version`` whenever a job changes (append mode; the highest version is the latest).

    ``events``: ``event_id, key, time, event, size`` of a session with ``state_session``'s settings. Leases run out as the watermark (``late`` behind
    the newest event) passes them, without another event of the job. Rows with a null key, time or id are left out.
    """
    kind = events.schema[key].dataType.simpleString()
    there = events.where(F.col(key).isNotNull() & F.col(time).isNotNull() & F.col("event_id").isNotNull())
    timed = there.withColumn("__ts", F.col(time).cast("timestamp")).withWatermark("__ts", late)
    slim = timed.select("__ts", key, F.unix_micros("__ts").alias("at"), F.col("event_id").cast("long").alias("event_id"), "event", F.coalesce(F.col("size").cast("long"), F.lit(0)).alias("size"))
    machine = JobMachine(int(lease_seconds * 1e6), int(remember_seconds * 1e6), key, kind)
    return slim.groupBy(key).transformWithState(machine, f"{key} {kind}, {COLUMNS}", "append", "eventTime")


def latest(states: DataFrame, key: str) -> DataFrame:
    """The last of the ``states`` of each key."""
    return states.groupBy(key).agg(F.max_by(F.struct("status", "attempts", "error_code"), "version").alias("x")).select(key, "x.*")


def verified(finished: DataFrame, outputs: DataFrame, key: str, time: str, within: str, late: str) -> DataFrame:
    """Each finished attempt with the outputs of its job that were written up to ``within`` before it: a join of two streams, whose state
    is dropped as the watermarks pass (``key, finish_id, output_id, size``; append mode)."""
    a = finished.select(F.col(key).alias("__k"), F.col("event_id").alias("finish_id"), F.col(time).cast("timestamp").alias("__done")).withWatermark("__done", late)
    b = outputs.select(F.col(key).alias("__o"), F.col("event_id").alias("output_id"), "size", F.col(time).cast("timestamp").alias("__written")).withWatermark("__written", late)
    near = (F.col("__k") == F.col("__o")) & (F.col("__written") <= F.col("__done")) & (F.col("__written") >= F.col("__done") - F.expr(f"interval {within}"))
    return a.join(b, near).select(F.col("__k").alias(key), "finish_id", "output_id", "size")
