"""Hand-made rows for the rules that the driver's tables cannot show: nulls, ties, edges."""

import datetime as dt
import struct

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from framelake.functions import colour, names
from framelake.operators import graph, planning, ranking, review, robust, sessions, similarity, temporal
from framelake.sources import images, tables
from framelake.streaming import events

T0 = dt.datetime(2024, 5, 1, 12)


def at(seconds):
    return None if seconds is None else T0 + dt.timedelta(seconds=seconds)


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(n) for n, c in columns.items()]).first()


def captures(spark, rows):
    return spark.createDataFrame([("s", i, at(t), "cam") for i, t in enumerate(rows)], "k string, id long, ts timestamp_ntz, camera string")


def test_bursts(spark):
    rows = sessions.bursts(captures(spark, [0, 1, 3, 3 + 18 * 3600]), ["k"], "ts", "id", 2.0, ["camera"])
    assert sorted(r.id for r in rows.collect()) == [0, 1, 2]
    summary = sessions.burst_summary(rows, ["k"], 2.0).collect()
    assert [(r.n, round(r.confidence, 6)) for r in summary] == [(3, 0.55)]
    late = sessions.bursts(captures(spark, [0, 1, None]), ["k"], "ts", "id", 2.0, ["camera"])
    assert sorted(r.id for r in late.collect()) == [0, 1]


def test_gap_is_inclusive(spark):
    cut = sessions.gap_sets(captures(spark, [0, 900, 1801]), ["k"], "ts", "id", 900)
    assert [r.set_no for r in cut.orderBy("id").collect()] == [1, 1, 2]


def test_complete_linkage_is_greedy(spark):
    edges = spark.createDataFrame([(0, 1, 2, 0.99), (0, 1, 3, 0.95)], "component long, a long, b long, similarity double")
    assert sorted((r.group_id, r.member) for r in similarity.complete_linkage(edges).collect()) == [(1, 1), (1, 2)]


def test_average_linkage_never_joins_unusable():
    inf = np.inf
    d = np.array([[inf, 0.1, 0.5, inf], [0.1, inf, 0.4, inf], [0.5, 0.4, inf, inf], [inf, inf, inf, inf]])
    assert similarity.average_linkage(d, 0.2).tolist() == [0, 0, 2, 3]
    assert similarity.average_linkage(d, 0.45).tolist() == [0, 0, 0, 3]
    assert similarity.average_linkage(d, 0.44).tolist() == [0, 0, 2, 3]


@pytest.mark.parametrize("seed", range(6))
def test_average_linkage_is_that_of_the_closest_pair(seed):
    """Against merging the closest pair of clusters again and again."""
    points = np.random.default_rng(seed).random((25, 3))
    d = np.sqrt(((points[:, None] - points) ** 2).sum(axis=2))
    groups = [[i] for i in range(25)]
    while len(groups) > 1:
        means = {(i, j): d[np.ix_(groups[i], groups[j])].mean() for i in range(len(groups)) for j in range(i)}
        i, j = min(means, key=means.get)
        if means[i, j] > 0.3:
            break
        groups[j] += groups.pop(i)
    want = {m: min(g) for g in groups for m in g}
    assert similarity.average_linkage(d, 0.3).tolist() == [want[i] for i in range(25)]


@pytest.mark.parametrize(("values", "mean"), [([1, 2, 3, 4, 100], 3.0), ([1, 2, 3, 100], 26.5)])
def test_trimmed_mean(spark, values, mean):
    df = spark.createDataFrame([("a", float(v)) for v in values] + [(None, float(v)) for v in values], "k string, v double")
    assert [r.trimmed_mean for r in robust.trimmed_mean(df, ["k"], "v").collect()] == [mean, mean]


def test_exact_statistics_of_skewed_groups(spark):
    """A group with one frequent value, one with all values apart, a small one and one without values."""
    rng = np.random.default_rng(4)
    groups = {"hot": [1.0] * 3000 + rng.random(200).tolist(), "apart": rng.normal(size=2500).tolist(), "few": [3.0, 1.0], "none": [None]}
    df = spark.createDataFrame([(k, v) for k, vs in groups.items() for v in vs], "k string, v double").repartition(4)
    at = (0.0, 0.013, 0.5, 0.977, 1.0)
    got = {r.k: r["__p"] for r in robust.order_statistics(df, ["k"], "v", at).collect()}
    assert set(got) == {"hot", "apart", "few"}
    for k, found in got.items():
        assert found == pytest.approx(np.quantile(groups[k], at).tolist())
    for r in robust.trimmed_mean(df, ["k"], "v").collect():
        v = np.sort(groups[r.k])
        cut = max(1, int(len(v) * 0.1)) if len(v) >= 5 else 0
        assert r.trimmed_mean == pytest.approx(v[cut : len(v) - cut].mean()) and r.n_kept == len(v) - 2 * cut
    ranked = ranking.rank_within(df, ["k"], "v", "v", descending=False).where("v is not null").collect()
    for k in got:
        assert sorted(r["rank"] for r in ranked if r.k == k) == list(range(1, len(groups[k]) + 1))
        assert [r.v for r in sorted((r for r in ranked if r.k == k), key=lambda r: r["rank"])] == sorted(groups[k])


def test_frontier_of_a_large_front(spark):
    """More frontier rows than a tile holds, repeated rows among them."""
    rows = [(i, float(i), float(6000 - i)) for i in range(6000)] + [(9000 + i, float(i), float(5900 - i)) for i in range(0, 5900, 7)] + [(5, 5.0, 5995.0)]
    df = spark.createDataFrame(rows, "k long, a double, b double").repartition(4)
    got = sorted(r.k for r in ranking.frontier(df, ["a", "b"], [], "k").collect())
    assert got == sorted([*range(6000), 5])


def test_eyes(spark):
    rows = [(0.15, 0.30), (0.14, 0.30), (0.20, 0.25), (None, 0.3)]
    df = spark.createDataFrame(rows, "l double, r double").select(ranking.eyes_open(F.col("l"), F.col("r")).alias("e"))
    assert [r.e for r in df.collect()] == ["uncertain", "no", "yes", "uncertain"]


def test_route_skips_and_continues(spark):
    rows = [("d", i, "A2", 100 - i, m) for i, m in enumerate([20, 20, 10])]
    df = spark.createDataFrame(rows, "desk string, id int, level string, score int, minutes int")
    assert {r.id: r.selected for r in planning.route(df, "desk", 30).collect()} == {0: True, 1: False, 2: True}


def test_frontier(spark):
    rows = [("a", 2, 1, 10, 0), ("b", 1, 1, 10, 0), ("c", 3, 2, 10, 0)]
    df = spark.createDataFrame(rows, "id string, quality int, runtime int, loc int, regressions int")
    assert sorted(r.id for r in ranking.frontier(df, ["quality"], ["runtime", "loc", "regressions"], "id").collect()) == ["a", "c"]


def test_hysteresis_keeps_state_over_nulls(spark):
    df = spark.createDataFrame([("k", i, v) for i, v in enumerate([None, 9.0, 6.0, 3.9, 5.0])], "k string, i int, v double")
    got = df.select("i", temporal.hysteresis(F.col("v"), 8, 4, ["k"], ["i"]).alias("s")).orderBy("i").collect()
    assert [r.s for r in got] == [False, True, True, False, False]


@pytest.mark.parametrize(("series", "trend"), [((1, 2, 3), "WORSENING"), ((3, 2, 1), "IMPROVING"), ((1, 3, 2), "STABLE"), ((1, 2), "INSUFFICIENT_DATA")])
def test_trend(spark, series, trend):
    df = spark.createDataFrame([("k", i, v) for i, v in enumerate(series)], "k string, i int, v int")
    assert df.select("i", ranking.trend("v", ["k"], ["i"]).alias("t")).orderBy(F.desc("i")).first().t == trend


def test_cover_score_over_measured_checks(spark):
    score, weight = ranking.cover_score(
        {"photo": F.lit(None).cast("double"), "crop": F.lit(1.0), "costume": F.lit(0.5), "colour": F.lit(0.0), "light": F.lit(None).cast("double")}, F.lit(1.0)
    )
    row = one(spark, score=score, weight=weight)
    assert (round(row.score, 1), row.weight) == (58.3, 60)


def test_equal_frames_need_no_gain(spark):
    rgb = tuple(F.lit(x) for x in (0.2, 0.4, 0.3))
    ev, gains = colour.match_gains(rgb, rgb)
    row = one(spark, ev=ev, r=gains[0], g=gains[1], b=gains[2])
    assert [round(x, 9) for x in row] == [0, 1, 1, 1]


def test_crop(spark):
    x, y, w, h = ranking.crop_plan(F.lit(4000), F.lit(3000), (4, 5))
    assert list(one(spark, x=x, y=y, w=w, h=h)) == [800, 0, 2400, 3000]


def test_leakage(spark):
    df = spark.createDataFrame([("p", "dev"), ("p", "locked_test"), ("q", "dev")], "person string, split string")
    assert [r.person for r in planning.leakage(df, "person", "split").collect()] == ["p"]


def test_stems(spark):
    row = one(spark, a=names.normal_stem(F.lit("A_edit")), b=names.normal_stem(F.lit("a_v2_edit")), c=names.shot_key(F.lit("/x/IMG.a.RAF")))
    assert list(row) == ["a", "a_v2", "/x/img"]


def test_durations(spark):
    texts = ["90s", "15m", "1h30m", "01:02:03", "-5m", "soon", "2d"]
    row = one(spark, **{f"c{i}": names.parse_duration(F.lit(t)) for i, t in enumerate(texts)})
    assert list(row) == [90, 900, 5400, 3723, -300, None, 172800]
    assert list(one(spark, a=names.format_duration(F.lit(45)), b=names.format_duration(F.lit(190)), c=names.format_duration(F.lit(3720)), d=names.format_duration(F.lit(None)))) == ["45s", "3m10s", "1h02m", "?"]


def test_eta(spark):
    df = spark.createDataFrame([("j", 10.0, 20.0, True), ("j", 30.0, 0.0, False), ("j", 30.0, 0.0, False)], "k string, mp double, s double, done boolean")
    assert temporal.eta(df, ["k"], F.col("done"), "mp", "s", 2).first().eta_seconds == 60


def test_delta_e_2000_reference_pair(spark):
    lab = lambda *v: tuple(F.lit(x) for x in v)
    pairs = [((50.0, 2.6772, -79.7751), (50.0, 0.0, -82.7485), 2.0425), ((50.0, 2.5, 0.0), (50.0, 0.0, -2.5), 4.3065), ((50.0, 2.49, -0.001), (50.0, -2.49, 0.0009), 7.1792)]
    row = one(spark, **{f"d{i}": colour.delta_e_2000(lab(*a), lab(*b)) for i, (a, b, _) in enumerate(pairs)})
    assert [round(x, 4) for x in row] == [d for *_, d in pairs]


def test_round_trips(spark):
    x = F.lit(0.37)
    row = one(spark, s=colour.linear_to_srgb(colour.srgb_to_linear(x)), p=colour.pq_to_linear(colour.linear_to_pq(x)))
    assert [round(v, 9) for v in row] == [0.37, 0.37]


def test_perf_skips_fast_baselines(spark):
    schema = "k int, time_s double, ram_mb double"
    a, b = spark.createDataFrame([(1, 9.0, 1.0), (2, 4.0, 1.0)], schema), spark.createDataFrame([(1, 1.0, 1.0), (2, 2.0, 1.0)], schema)
    assert {r.k: (r.verdict, r.skipped) for r in review.compare_perf(a, b, ["k"]).collect()} == {1: ("PASS", True), 2: ("REGRESSION", False)}


def test_clip_ratio(spark):
    f = lambda a, b: review.clip_ratio(F.lit(a), F.lit(b))
    assert list(one(spark, a=f(0.0, 0.0), b=f(0.0, 0.1), c=f(0.1, 0.2))) == [1.0, float("inf"), 2.0]


def test_inherit_stops_at_cycles(spark):
    parents = spark.createDataFrame([("a", "b"), ("b", "a"), ("c", None)], "name string, parent string")
    values = spark.createDataFrame([("a", "x", "1"), ("b", "x", "2"), ("b", "y", "3")], "name string, path string, value string")
    got = {(r.name, r.path): r.value for r in planning.inherit(values, parents).collect()}
    assert got == {("a", "x"): "1", ("a", "y"): "3", ("b", "x"): "2", ("b", "y"): "3"}


def test_inherit_reaches_every_ancestor(spark):
    n = 41
    parents = spark.createDataFrame([(f"n{i}", f"n{i - 1}") for i in range(1, n)] + [("x", "n20"), ("x", "n3"), ("p", "q"), ("q", "r"), ("r", "q")], "name string, parent string")
    values = spark.createDataFrame([("n0", "far", "0"), ("n7", "near", "7"), ("n30", "near", "30"), ("r", "far", "r")], "name string, path string, value string")
    got = {(r.name, r.path): (r.value, r.level) for r in planning.inherit(values, parents).collect()}
    want = {(f"n{i}", "far"): ("0", i) for i in range(n)} | {(f"n{i}", "near"): ("30", i - 30) if i >= 30 else ("7", i - 7) for i in range(7, n)}
    want |= {("x", "far"): ("0", 4), ("x", "near"): ("7", 14), ("p", "far"): ("r", 2), ("q", "far"): ("r", 1), ("r", "far"): ("r", 0)}
    assert got == want


def test_components_of_a_long_chain(spark):
    edges = [(i, i + 1, 1.0) for i in range(150)] + [(i + 1, i, 1.0) for i in range(200, 260)] + [(500, 500, 1.0)]
    got = similarity.with_components(spark.createDataFrame(edges, "a long, b long, similarity double")).collect()
    assert len(got) == len(edges)
    assert all(r.component == (0 if r.a <= 150 else 200 if r.a <= 260 else 500) for r in got)
    with pytest.raises(RuntimeError):
        graph.connected_components(spark.createDataFrame(edges, "a long, b long, similarity double"), "a", "b", 2)


def test_global_rank_with_ties(spark):
    df = spark.createDataFrame([(i, float(i % 3)) for i in range(20)], "id int, s double")
    got = {r.id: r.rank for r in ranking.global_rank(df, "s", "id").collect()}
    order = sorted(range(20), key=lambda i: (-(i % 3), i))
    assert got == {i: n + 1 for n, i in enumerate(order)}


def test_one_euro_of_a_constant(spark):
    df = spark.createDataFrame([("k", i, at(i), 5.0) for i in range(9)], "k string, id int, ts timestamp_ntz, v double")
    assert {r.smooth for r in temporal.one_euro(df, "k", "ts", "id", "v", zero_lag=True).collect()} == {5.0}


def test_change_point_needs_two_looks(spark):
    a, b = [1.0, 0.0], [0.0, 1.0]
    rows = [("r", i, v) for i, v in enumerate([a, a, a, a, b, a, a, b, b])]
    df = spark.createDataFrame(rows, "r string, i int, v array<double>")
    assert [r.i for r in similarity.change_points(df, "r", "i", "v", 0.5).collect()] == [7]


def png(w, h):
    return b"\x89PNG\r\n\x1a\n" + struct.pack(">I", 13) + b"IHDR" + struct.pack(">II", w, h) + b"\x08\x02\0\0\0"


def tiff(when):
    head = b"II*\0" + struct.pack("<I", 8)
    entries = struct.pack("<HHII", 0x0110, 2, 8, 38) + struct.pack("<HHII", 0x0132, 2, 20, 46)
    return head + struct.pack("<H", 2) + entries + struct.pack("<I", 0) + b"Camera1\0" + when.encode() + b"\0"


def test_folder_scan_and_probe(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.PNG").write_bytes(png(640, 480))
    (tmp_path / "sub" / "b.tif").write_bytes(tiff("2024:05:01 12:00:00"))
    (tmp_path / "note.txt").write_text("x")
    (tmp_path / "empty.jpg").write_bytes(b"")
    plan = {r.path.rsplit("/", 1)[1]: r.reason for r in images.input_plan(images.listing(spark, str(tmp_path))).collect()}
    assert plan == {"a.PNG": None, "b.tif": None, "note.txt": "unsupported_extension"}
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(str(tmp_path))
    found = images.probe(files).withColumn("t", images.capture_time(F.col("capture_text")))
    got = {r.path.rsplit("/", 1)[1]: (r.width, r.height, r.t, r.camera) for r in found.collect()}
    assert got["a.PNG"] == (640, 480, None, None)
    assert got["b.tif"] == (None, None, dt.datetime(2024, 5, 1, 12), "Camera1")


def test_cube_round_trip(spark, tmp_path):
    n = 3
    text = ["# made", 'TITLE "t"', f"LUT_3D_SIZE {n}", "DOMAIN_MIN 0 0 0"]
    text += [f"{r / 2} {g / 2} {b / 2}" for b in range(n) for g in range(n) for r in range(n)]
    (tmp_path / "id.cube").write_text("\n".join(text))
    cube = tables.cube_array(tables.read_cube(spark, str(tmp_path / "id.cube")))
    rgb = np.random.default_rng(1).random((50, 3))
    assert np.allclose(tables.trilinear(cube, rgb), rgb)
    pixels = spark.createDataFrame(pd.DataFrame(rgb, columns=list("rgb")))
    assert np.allclose(tables.apply_lut(pixels, cube).toPandas().to_numpy(), rgb)


def test_folder_watch_needs_two_equal_scans(spark, tmp_path):
    schema = "path string, signature string, scan int"
    rows = [("a", "1:1", 1), ("a", "1:1", 2), ("b", "2:1", 1), ("b", "3:2", 2)]
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "scans.parquet"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "scans.parquet"))
    got = {r.path: r.status for r in events.drain(events.stable_files(stream), "update").collect()}
    assert got == {"a": "ready", "b": "settling"}


@pytest.mark.parametrize("files", [None, 1])
def test_streams_of_part_files(spark, tmp_path, files):
    """A table of part files is read whole, and keys that the last batch lacks keep their row."""
    schema = "k string, t int, v double"
    parts = [[("a", 1, 70.0), ("b", 1, 10.0)], [("a", 2, 50.0)], [("c", 1, 90.0), ("a", 3, 10.0)]]
    for rows in parts:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "events.parquet"))
    stream = events.file_stream(spark, str(tmp_path), "events", spark.read.parquet(str(tmp_path / "events.parquet")).schema, files)
    kept = events.drain(stream.where("t < 3"), "append")
    assert sorted(r.k for r in kept.collect()) == ["a", "a", "b", "c"]
    got = sorted(map(tuple, events.drain(events.hysteresis(stream.where("t < 3"), "k", "t", "v", 60, 20), "update").collect()))
    assert got == [("a", 2, 2, True), ("b", 1, 0, False), ("c", 1, 1, True)]


def test_stream_without_files(spark, tmp_path):
    (tmp_path / "events.parquet").mkdir()
    stream = events.file_stream(spark, str(tmp_path), "events", spark.createDataFrame([], "k string, t int").schema)
    assert [events.drain(s, m).count() for s, m in ((stream, "append"), (stream, "update"), (stream.groupBy("k").count(), "complete"))] == [0, 0, 0]
