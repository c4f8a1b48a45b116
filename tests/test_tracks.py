"""Recursions over slices, whole tracks and region deviation against plain loops."""

import math
import random

import pytest
from pyspark.sql import functions as F

from framelake import storage
from framelake.operators import ordered, robust, temporal, tracks


def brute_euro(points, min_cutoff, beta, d_cutoff):
    low = lambda dt, c: (dt * c * 2 * math.pi) / (dt * c * 2 * math.pi + 1)
    out, t0, y, speed = [], None, 0.0, 0.0
    for t, v in points:
        if t0 is None:
            y = v
        else:
            dt = max(abs(t - t0), 1e-6)
            speed += low(dt, d_cutoff) * ((v - y) / dt - speed)
            y += low(dt, min_cutoff + beta * abs(speed)) * (v - y)
        t0 = t
        out.append(y)
    return out


def series(seed=1, n=90):
    rng = random.Random(seed)
    return [(k, float(i) + rng.random() / 2, i, rng.gauss(0, 5)) for k in ("a", "b", None) for i in range(n if k == "a" else rng.randint(1, 20))]


@pytest.mark.parametrize("slice_rows", [1, 7, 65_536])
@pytest.mark.parametrize("zero_lag", [False, True])
def test_filter_does_not_follow_slices(spark, slice_rows, zero_lag):
    rows = series()
    df = spark.createDataFrame([*rows, ("a", 500.0, 999, None)], "k string, t double, i long, v double").repartition(5)
    few = slice_rows if slice_rows > 1 else 30
    got = {(r.k, r.i): r.smooth for r in temporal.one_euro(df, "k", "t", "i", "v", 1.0, 0.3, 0.2, 0.4, zero_lag, few).collect()}
    want = {}
    for k in ("a", "b", None):
        own = sorted((t, i, v) for kk, t, i, v in rows if kk == k)
        there = brute_euro([(t, v) for t, _, v in own], 0.3, 0.2, 0.4)
        back = brute_euro([(t, v) for t, _, v in own[::-1]], 0.3, 0.2, 0.4)[::-1]
        want.update({(k, i): (a + b) / 2 if zero_lag else a for (_, i, _), a, b in zip(own, there, back, strict=True)})
    assert got.keys() == want.keys() and all(got[x] == pytest.approx(want[x], abs=1e-9) for x in want)


def test_one_long_key_is_numbered_by_several_tasks(spark):
    df = spark.range(2000).select(F.lit("k").alias("k"), F.pmod(F.col("id") * 7919, F.lit(2000)).alias("v"))
    found = ordered.numbered(df, ["k"], ["v"])
    assert found.where("no != v").count() == 0 and found.count() == 2000
    assert found.withColumn("p", F.spark_partition_id()).select("p").distinct().count() > 1
    assert ordered.numbered(df.limit(0), ["k"], ["v"]).count() == 0


def brute_track(points, fps, jump, max_gap, fade, n, euro):
    frames = sorted(points)
    out, shot, runs, starts = [], 0, [], {0: 0}
    for f in frames:
        before = runs[-1][1][-1] if runs else None
        cut = before is not None and f - before == 1 and abs(points[f] - points[before]) > jump
        if cut:
            shot += 1
            starts[shot] = f
        if before is None or cut or (f - before) / fps > max_gap + 1e-9:
            runs.append((shot, [f]))
        else:
            runs[-1][1].append(f)
    for shot, tracked in runs:
        full = list(range(tracked[0], tracked[-1] + 1))
        values = []
        for f in full:
            a, b = max(x for x in tracked if x <= f), min(x for x in tracked if x >= f)
            values.append(points[a] if a == b else points[a] + (points[b] - points[a]) * (f - a) / (b - a))
        pairs = [(f / fps, v) for f, v in zip(full, values, strict=True)]
        there, back = brute_euro(pairs, *euro), brute_euro(pairs[::-1], *euro)[::-1]
        end = starts.get(shot + 1, n)
        for f, v, x, y in zip(full, values, there, back, strict=True):
            w = 1.0
            if full[0] > starts[shot]:
                w = min(w, (f - full[0] + 1) / fps / fade)
            if full[-1] < end - 1:
                w = min(w, (full[-1] - f + 1) / fps / fade)
            out.append((shot, f, "tracked" if f in points else "interpolated", w, v, (x + y) / 2))
    return out


@pytest.mark.parametrize("slice_rows", [5, 65_536])
def test_stabilised_tracks(spark, slice_rows):
    rng = random.Random(4)
    tracks_of = {}
    for name in "xyz":
        values, v = {}, 0.0
        for f in range(rng.randint(0, 3), 60):
            v += rng.gauss(0, 1) + (40 if rng.random() < 0.06 else 0)
            if rng.random() < 0.7 and not 20 <= f < 32:
                values[f] = v
        tracks_of[name] = values
    rows = [(k, f, v) for k, p in tracks_of.items() for f, v in p.items()]
    df = spark.createDataFrame([*rows, rows[0], (None, 1, 1.0), ("x", None, 1.0), ("x", 25, None)], "k string, f long, v double").repartition(4)
    count = spark.createDataFrame([(k, 66) for k in tracks_of], "k string, n long")
    euro = (0.3, 0.1, 0.5)
    got = {}
    for r in tracks.stabilised(df, "k", "f", "v", 2.0, 20.0, 3.0, 4.0, count, *euro, slice_rows).collect():
        got.setdefault(r.k, []).append((r.shot, r.f, r.source, r.weight, r.v, r.smooth))
    for k, points in tracks_of.items():
        want = brute_track(points, 2.0, 20.0, 3.0, 4.0, 66, euro)
        for a, b in zip(sorted(got[k], key=lambda x: x[1]), want, strict=True):
            assert a[:3] == b[:3] and a[3:] == pytest.approx(b[3:], abs=1e-9)


def test_region_that_changes_alone_scores(spark):
    rng = random.Random(7)
    rows = []
    for f in range(60):
        shade = 0.6 if f < 15 else 1.0  # all regions at once: no deviation
        for r in range(5):
            covered = r == 2 and 40 <= f < 46
            light = (0.5 + 0.05 * r) * shade * (1 + rng.gauss(0, 0.01)) * (0.3 if covered else 1)
            rows.append(("s", f, r, light, rng.gauss(0, 0.3) + (20 if covered else 0), rng.gauss(0, 0.3), 0.2 * (1 + rng.gauss(0, 0.02)) * (3 if covered else 1)))
    rows.append(("s", 60, 0, None, 0.0, 0.0, 0.1))
    df = spark.createDataFrame(rows, "shot string, f long, r long, light double, a double, b double, texture double")
    got = {(x.f, x.r): x.score for x in tracks.region_deviation(df, "shot", "f", "r", 6.0).collect()}
    assert got.pop((60, 0)) is None
    high = {k for k, v in got.items() if v > 8}
    assert high == {(f, 2) for f in range(40, 46)}
    assert tracks.region_deviation(df.where("f < 2"), "shot", "f", "r", 6.0).where("score is not null").count() == 0


def test_region_deviation_moves_a_shot_once(spark, monkeypatch):
    rng = random.Random(3)
    lengths = {"a": 12, "b": 3, "c": 40}
    rows = [(s, f, r, rng.random() + 0.1, rng.gauss(0, 1), rng.gauss(0, 1), rng.random() + 0.1) for s, n in lengths.items() for f in range(n) for r in range(4)]
    rows += [("c", 40, 0, None, 0.0, 0.0, 0.1), ("c", None, 1, 0.4, 0.0, 0.0, 0.1), ("c", None, 2, 0.4, 1.0, 0.0, 0.1), (None, 1, 1, 0.4, 0.0, 0.0, 0.1), ("a", 1, None, 0.4, 0.0, 0.0, 0.1)]
    df = spark.createDataFrame(rows, "shot string, f long, r long, light double, a double, b double, texture double").repartition(3)
    steps = []
    for module in (robust, tracks):
        monkeypatch.setattr(module, "saved", lambda d: steps.append(1) or storage.saved(d))
    scores = lambda: sorted(map(tuple, tracks.region_deviation(df, "shot", "f", "r", 1.4).collect()), key=str)
    near = scores()
    assert len(steps) == 1 and len(near) == len(rows) - 2  # the keys of long shots alone
    for most in (20, 1):  # some shots, or all of them, are too long to be gathered
        monkeypatch.setattr(robust, "MOST_GATHERED", most)
        assert scores() == near
