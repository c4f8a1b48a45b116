"""Gates, drift, evidence, undo, macros and job merges on small tables."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from framelake import storage
from framelake.operators import advice, jobs, robust


def test_safe_auto(spark):
    rows = [(0.9, None, None, False), (0.9, 0.7, None, None), (0.9, 0.7, 0.5, False), (0.9, 0.9, 0.1, False), (1.0, 1.0, 1.0, True), (None, 1.0, 1.0, False), (float("nan"), None, None, False), (7.0, -1.0, None, False)]
    df = spark.createDataFrame(rows, "c double, s double, m double, o boolean")
    found = df.select(advice.mask_confidence(*map(F.col, "csmo")).alias("v")).select("v", *[x.alias(n) for x, n in zip(advice.safe_auto(F.col("v")), ("action", "scale"), strict=True)])
    assert [(r.v, r.action, r.scale) for r in found.collect()] == [
        (0.9, "apply", 1.0), (0.7, "dampen", 0.5), (0.5, "review", 0.0), (0.1, "skip", 0.0), (0.35, "skip", 0.0), (0.0, "skip", 0.0), (0.0, "skip", 0.0), (0.0, "skip", 0.0),
    ]
    with pytest.raises(ValueError, match="thresholds"):
        advice.safe_auto(F.lit(0.5), 0.5, 0.6)


def test_colour_drift(spark):
    rng = np.random.default_rng(3)
    rows = []
    for image, turn, n in (("same", 0.0, 400), ("little", 4.0, 400), ("cast", 12.0, 400), ("tail", 0.0, 400), ("grey", 0.0, 400), ("few", 30.0, 60)):
        for i in range(n):
            hue, chroma, light = rng.uniform(20, 60), 0.3 if image == "grey" else rng.uniform(15, 30), rng.uniform(40, 70)
            moved = hue + (40 if image == "tail" and i % 10 == 0 else turn)
            at = lambda h: (chroma * np.cos(np.radians(h)), chroma * np.sin(np.radians(h)))  # noqa: B023, E731
            rows.append((image, float(light), *map(float, at(hue)), float(light), *map(float, at(moved))))
    df = spark.createDataFrame([*rows, ("same", None, 1.0, 1.0, 1.0, 1.0, 1.0)], "image string, l0 double, a0 double, b0 double, l1 double, a1 double, b1 double").repartition(4)
    got = {r.image: r for r in advice.colour_drift(df, "image", ("l0", "a0", "b0"), ("l1", "a1", "b1")).collect()}
    assert {k: r.status for k, r in got.items()} == {"same": "checked-pass", "little": "checked-pass", "cast": "checked-flagged", "tail": "checked-flagged", "grey": "not-run", "few": "not-run"}
    assert got["cast"].hue_mean == pytest.approx(12) and got["cast"].score == pytest.approx(1.0) and got["same"].delta_e == pytest.approx(0, abs=1e-9)
    assert got["grey"].kept == 0 and got["grey"].score is None and got["few"].kept == pytest.approx(1.0)


def test_colour_drift_moves_an_image_once(spark, monkeypatch):
    rng = np.random.default_rng(8)
    rows = [(i, *map(float, rng.uniform(20, 60, 6))) for i, n in ((1, 150), (2, 700), (3, 90)) for _ in range(n)] + [(None, 1.0, 1.0, 1.0, 1.0, 1.0, 1.0), (2, None, 1.0, 1.0, 1.0, 1.0, 1.0), (2, 1.0, 1.0, 1.0, 1.0, float("nan"), 1.0), (4, 1.0, 1.0, 1.0, None, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "image int, l0 double, a0 double, b0 double, l1 double, a1 double, b1 double").repartition(3)
    steps = []
    for module in (robust, advice):
        monkeypatch.setattr(module, "saved", lambda d: steps.append(1) or storage.saved(d))
    drifts = lambda: [[pytest.approx(v, abs=1e-9) if isinstance(v, float) else v for v in r] for r in advice.colour_drift(df, "image", ("l0", "a0", "b0"), ("l1", "a1", "b1")).orderBy("image").collect()]
    near = drifts()
    assert len(steps) == 1 and [r[0] for r in near] == [1, 2, 3]  # the keys of large images alone
    assert [r[-2] for r in near] == [1.0, 1.0, 1.0]  # incomplete pixels are not counted
    plain = [[getattr(v, "expected", v) for v in r] for r in near]
    for most in (500, 1):  # some images, or all of them, are too large to be gathered
        monkeypatch.setattr(robust, "MOST_GATHERED", most)
        assert plain == drifts()


def test_evidence_is_complete(spark):
    known = spark.createDataFrame([(1,), (2,)], "job long")
    rows = [(1, "seam", True, True, True, 0.7, 2), (1, "seam", True, True, False, 0.1, 1), (1, "drift", False, True, False, 0.2, 1), (2, "drift", None, None, None, 0.3, 1), (2, "seam", True, False, True, 0.9, 1), (9, "seam", True, True, True, 1.0, 1)]
    results = spark.createDataFrame(rows, 'job long, detector string, available boolean, measured boolean, flagged boolean, score double, "order" int'.replace('"', "`"))
    got = {(r.job, r.detector): (r.status, r.score) for r in advice.evidence(known, results, "job", ["seam", "drift", "skin"]).collect()}
    assert got == {
        (1, "seam"): ("checked-flagged", 0.7), (1, "drift"): ("unavailable", None), (1, "skin"): ("not-run", None), (2, "drift"): ("checked-pass", 0.3), (2, "seam"): ("not-run", None), (2, "skin"): ("not-run", None),
    }


def test_undo(spark):
    moves = spark.createDataFrame([("a/1", "s/1"), ("a/2", "s/2"), ("a/3", "t/3"), ("a/4", "a/4"), ("a/5", "t/5"), ("a/6", "u/6"), ("a/6", "u/7"), ("a/1", "s/1")], "source string, destination string")
    there = spark.createDataFrame([("s/1",), ("a/2",), ("a/3",), ("t/3",), ("u/6",), ("u/7",), ("a/4",)], "path string")
    verdicts, empty = advice.undo_plan(moves, there)
    assert {(r.source, r.destination): r.verdict for r in verdicts.collect()} == {
        ("a/1", "s/1"): "restore", ("a/2", "s/2"): "nothing", ("a/3", "t/3"): "exists again", ("a/4", "a/4"): "nothing", ("a/5", "t/5"): "missing", ("a/6", "u/6"): "restore", ("a/6", "u/7"): "exists again",
    }
    assert {r.folder for r in empty.collect()} == {"s"}


def test_macros(spark):
    amounts = spark.createDataFrame([(1, "warm", 0.5), (2, "warm", -0.5), (3, "warm", 0.0), (4, "warm", 1.5), (5, "warm", 1.0)], "frame long, macro string, amount double")
    writes = spark.createDataFrame([("warm", "k", 100.0, None, False), ("warm", "t", 30.0, -90.0, True)], "macro string, parameter string, positive double, negative double, crossing boolean")
    limits = spark.createDataFrame([("k", None, 60.0, True), ("t", -20.0, None, False)], "parameter string, low double, high double, whole boolean")
    base = spark.createDataFrame([(f, p, v) for f in range(1, 6) for p, v in (("k", -3.0 if f == 5 else 11.0), ("t", 10.0))], "frame long, parameter string, base double")
    got = {(r.frame, r.parameter): (r.value, r.problem) for r in advice.macro_values(amounts, writes, limits, base).collect()}
    assert got == {
        (1, "k"): (56.0, None), (1, "t"): (20.0, None), (2, "k"): (None, "one-sided"), (2, "t"): (-20.0, None), (3, "k"): (11.0, None), (3, "t"): (10.0, None),
        (4, "k"): (None, "amount"), (4, "t"): (None, "amount"), (5, "k"): (None, "crosses zero"), (5, "t"): (30.0, None),
    }


def test_shots_against_their_reference(spark):
    rows = [("s", 1, 2.0, 3.0, 500, True), ("s", 2, 5.0, 7.0, 500, False), ("s", 3, 9.0, 9.0, 20, False), ("s", 4, 0.0, 0.0, 500, True), ("t", 5, 1.0, 1.0, 500, False)]
    df = spark.createDataFrame(rows, "shoot string, k long, a double, b double, n long, ref boolean")
    got = {r.k: (r.kelvin_delta, r.confidence, r.drift) for r in advice.shot_consistency(df, "shoot", "k", F.col("ref")).collect()}
    assert got[2] == pytest.approx((200.0, 5 / 15, 5.0)) and got[1] == got[3] == got[5] == (0.0, 0.0, 0.0) and got[4][0] == -150.0


def test_merge_of_jobs(spark):
    rng = random.Random(1)
    side = lambda keep: {i: (rng.randint(0, 3), rng.choice("xyz")) for i in range(40) if rng.random() < keep}
    base, local, incoming = side(0.7), side(0.8), side(0.8)
    df = lambda d: spark.createDataFrame([(k, *v) for k, v in d.items()], "id long, attempts int, status string")
    got = {r.id: (r.attempts, r.status) for r in jobs.merge_jobs(df(base), df(local), df(incoming), "id", ["attempts", "status"]).collect()}
    want = {}
    for k in local.keys() | incoming.keys():
        if k not in local or k not in incoming:
            want[k] = local.get(k, incoming.get(k))
            continue
        b, mine, theirs = base.get(k, (None, None)), local[k], incoming[k]
        merged = [t if m == o else m for m, t, o in zip(mine, theirs, b, strict=True)]
        want[k] = (max(merged[0], theirs[0]), merged[1])
    assert got == want
