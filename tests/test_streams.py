"""The job state machine over several micro-batches, a restart, replays and leases; against a plain fold."""

import random

from pyspark.sql import functions as F

from framelake.streaming import events, jobs

SCHEMA = "event_id long, job string, ts timestamp, event string, size long"
LEASE = 50


def brute(rows, mark):
    out = {}
    for event_id, job, at, event, size in sorted(rows, key=lambda r: (r[2], r[0])):
        s = out.setdefault(job, {"status": None, "n": 0, "from": 0, "error": None, "out": None})
        if s["status"] == "processing" and at >= s["from"] + LEASE:
            s["status"], s["error"] = "queued", "worker_lost"
        if event == "output":
            s["out"] = (at, size)
        elif event == "queue" and s["status"] in (None, "failed"):
            s["status"], s["error"] = "queued", None
        elif event == "start" and s["status"] == "queued":
            s["status"], s["n"], s["from"], s["error"] = "processing", s["n"] + 1, at, None
        elif event == "fail" and s["status"] == "processing":
            s["status"], s["error"] = "failed", "failed"
        elif event == "finish" and s["status"] == "processing":
            fine = s["out"] and s["out"][0] >= s["from"] and s["out"][1] > 0
            s["status"], s["error"] = ("done", None) if fine else ("failed", "no_output")
    for s in out.values():
        if s["status"] == "processing" and s["from"] + LEASE <= mark:
            s["status"], s["error"] = "queued", "worker_lost"
    return {k: (s["status"], s["n"], s["error"]) for k, s in out.items() if s["status"]}


def written(spark, rows, at):
    flat = spark.createDataFrame([(i, j, t, e, s) for i, j, t, e, s in rows], "event_id long, job string, t long, event string, size long")
    flat.select("event_id", "job", F.timestamp_seconds("t").alias("ts"), "event", "size").coalesce(1).write.parquet(at)


def test_jobs_over_batches_and_a_restart(spark, tmp_path):
    rng = random.Random(2)
    rows = [(i, rng.choice("abcdef"), 10 * i + rng.randint(0, 9), rng.choice(["queue", "start", "start", "output", "finish", "fail"]), rng.randint(0, 3)) for i in range(160)]
    rows += [(500, "idle", 200, "queue", 0), (501, "idle", 210, "start", 0), (502, None, 220, "queue", 0)]
    rows.sort(key=lambda r: r[2])
    own = jobs.state_session(spark)
    source = str(tmp_path / "in")
    schema = own.createDataFrame([], SCHEMA).schema

    def run():
        stream = own.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(source)
        found = jobs.job_states(stream, "job", "ts", LEASE, "20 seconds")
        query = found.writeStream.outputMode("append").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True)
        query.format("parquet").option("path", str(tmp_path / "out")).start().awaitTermination()
        return {r.job: (r.status, r.attempts, r.error_code) for r in jobs.latest(spark.read.parquet(str(tmp_path / "out")), "job").collect()}

    cuts = [0, 50, 51, 110, len(rows)]
    for k, (a, b) in enumerate(zip(cuts[:3], cuts[1:], strict=False)):
        written(spark, rows[a:b] + (rows[a - 9 : a] if a else []), f"{source}/{k}")
    mark = lambda upto: max(r[2] for r in rows[:upto]) - 20
    there = [r for r in rows if r[1]]
    assert run() == brute([r for r in rows[:110] if r[1]], mark(110))
    written(spark, rows[110:] + rows[100:110], f"{source}/3")  # delivered after a restart, some again
    assert run() == brute(there, mark(len(rows)))
    assert run() == brute(there, mark(len(rows)))  # nothing new
    states = spark.read.parquet(str(tmp_path / "out"))
    assert states.groupBy("job", "version").count().where("count > 1").count() == 0
    assert states.where("job = 'idle' and error_code = 'worker_lost'").count() == 1  # by its timer alone


def test_outputs_meet_their_attempts(spark, tmp_path):
    rows = [(1, "a", 100, "finish", 0), (2, "a", 90, "output", 5), (3, "a", 20, "output", 6), (4, "b", 95, "output", 7), (5, "a", 101, "output", 8), (6, None, 95, "output", 9)]
    written(spark, rows, str(tmp_path / "e.parquet"))
    stream = spark.readStream.schema(spark.createDataFrame([], SCHEMA).schema).parquet(str(tmp_path / "e.parquet"))
    found = jobs.verified(stream.where("event = 'finish'"), stream.where("event = 'output'"), "job", "ts", "30 seconds", "1 minute")
    assert [(r.job, r.finish_id, r.output_id, r.size) for r in events.drain(found, "append").collect()] == [("a", 1, 2, 5)]


class Calls:
    """Stands for a handle and its state variables; counts what would go to the JVM."""

    def __init__(self):
        self.n, self.kept = 0, {}

    def getValueState(self, name, schema):  # noqa: N802
        one = type("State", (), {"get": lambda _: self.called(self.kept.get(name)), "exists": lambda _: self.called(name in self.kept), "update": lambda _, v: self.called(self.kept.update({name: v}))})
        return one()

    def getMapState(self, name, key, value):  # noqa: N802
        held = self.kept.setdefault(name, {})
        return type("State", (), {"iterator": lambda _: self.called(iter(held.items())), "updateValue": lambda _, k, v: self.called(held.update({k: v})), "removeKey": lambda _, k: self.called(held.pop(k))})()

    def called(self, found=None):
        self.n += 1
        return found

    def registerTimer(self, at):  # noqa: N802
        self.called(self.kept.update(timer=at))

    def deleteTimer(self, at):  # noqa: N802
        assert self.called(self.kept.pop("timer")) == at

    def listTimers(self):  # noqa: N802
        return self.called([self.kept["timer"]] if "timer" in self.kept else [])


def test_calls_to_the_state_do_not_grow_with_events():
    from pyspark.sql import Row

    handle, machine = Calls(), jobs.JobMachine(50_000_000, 10**12, "job", "string")
    machine.init(handle)
    event = lambda i, kind: Row(event_id=i, at=i * 1_000_000, event=kind, size=1)
    first = [event(0, "queue"), event(1, "start"), *[event(i, "output") for i in range(2, 200)], event(0, "queue")]
    assert [r.asDict() for r in machine.handleInputRows(("a",), iter(first), None)] == [{"job": "a", "status": "queued", "attempts": 1, "error_code": "worker_lost", "version": 3}]
    assert handle.n <= 8 and "timer" not in handle.kept
    handle.n = 0
    again = [event(200, "start"), event(199, "output"), event(201, "output")]
    assert [(r.status, r.attempts, r.version) for r in machine.handleInputRows(("a",), iter(again), None)] == [("processing", 2, 4)]
    assert handle.n <= 8 and handle.kept["timer"] == 250_000
    assert list(machine.handleInputRows(("a",), iter(again), None)) == []  # delivered again
    list(machine.handleInputRows(("a",), iter([event(202, "finish")]), None))
    assert handle.kept["job"][0] == "done" and "timer" not in handle.kept
