"""Jobs, recipes, corpora, graphs, faces and grades on small tables: ties, nulls, empty tables, odd values."""

import math
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from framelake import storage
from framelake.functions import colour, folds, grading, names
from framelake.operators import corpus, faces, graph, jobs, planning, ranking, recipes, review, robust, similarity, temporal
from framelake.plans import catalogue
from framelake.sources import documents


def rows(df, *columns):
    return sorted((tuple(r[c] for c in columns or df.columns) for r in df.collect()), key=repr)


def test_merge_of_records(spark):
    kind = "k int, status string, attempts int, error string"
    base = spark.createDataFrame([(1, "queued", 1, None), (2, "queued", 1, "x"), (3, "done", 1, None)], kind)
    local = spark.createDataFrame([(1, "processing", 2, None), (2, "queued", 1, "x"), (3, "done", 3, "l"), (4, "pending", 0, None)], kind)
    incoming = spark.createDataFrame([(1, "done", 1, "i"), (2, "failed", 2, None), (3, "failed", 2, "i"), (5, "odd", None, None)], kind)
    got = rows(jobs.merge_records(base, local, incoming, "k", ["status", "attempts", "error"]))
    assert got == [(1, "done", 2, "i"), (2, "failed", 2, None), (3, "failed", 3, "l"), (4, "pending", 0, None), (5, "odd", None, None)]
    assert jobs.merge_records(base, local.limit(0), incoming.limit(0), "k", ["status"]).count() == 0


def test_stale_jobs(spark):
    jobs_ = spark.createDataFrame(
        [(1, "processing", None, "2024-01-01 00:00:00"), (2, "processing", None, "2024-01-01 09:30:00"), (3, "processing", None, "soon"), (4, "processing", None, ""), (5, "done", None, "2020-01-01 00:00:00"), (6, "processing", None, None)],
        "k int, status string, error_code string, started_at string",
    )
    got = {r.k: (r.status, r.recovered) for r in jobs.recover_stale(jobs_, F.to_timestamp(F.lit("2024-01-01 10:00:00"))).collect()}
    assert got == {1: ("queued", True), 2: ("processing", False), 3: ("queued", True), 4: ("processing", False), 5: ("done", False), 6: ("processing", False)}


def test_queue_is_idempotent_and_replaces(spark):
    ready = spark.createDataFrame([("b", "jpg", "j2"), ("a", "jpg", "j1"), ("c", "jpg", "j3")], "path string, kind string, job_id string")
    there = spark.createDataFrame([("a", "jpg", "j1", "done"), ("b", "jpg", "old", "queued"), ("b", "tif", "t", "queued"), ("c", "jpg", "older", "done")], "path string, kind string, job_id string, status string")
    new, replaced = jobs.queue_jobs(ready, there, 1)
    assert rows(new, "job_id") == [("j2",)] and rows(replaced, "job_id") == [("old",)]


def test_undo_and_redo(spark):
    events = [(1, i, a, v) for i, (a, v) in enumerate([("push", 1), ("push", 2), ("undo", None), ("push", 3), ("undo", None), ("undo", None), ("redo", None)])]
    events += [(2, 0, "undo", None), (3, 0, "push", 1), (3, 1, "push", 2), (3, 2, "push", 3), (3, 3, "undo", None), (3, 4, "undo", None)]
    df = spark.createDataFrame(events, "k int, o int, a string, v int")
    got = rows(jobs.undo_redo(df, "k", "o", "a", "v", 2))
    assert got == [(1, 3, True, False), (2, None, False, False), (3, 2, False, True)]


def test_deep_merge(spark):
    kind = "recipe string, path string, value string"
    base = spark.createDataFrame([("r", "a.b", "1"), ("r", "a.c.d", "2"), ("r", "ab", "3"), ("r", "e", "4"), ("s", "a.b", "5")], kind)
    over = spark.createDataFrame([("r", "a", "x"), ("r", "e.f", "y")], kind)
    assert rows(recipes.deep_merge(base, over, "recipe"), "recipe", "path", "value") == [("r", "a", "x"), ("r", "ab", "3"), ("r", "e.f", "y"), ("s", "a.b", "5")]
    assert recipes.deep_merge(base, over.limit(0), "recipe").count() == 5


def test_cycles(spark):
    edges = [(1, 2), (2, 3), (3, 1), (3, 4), (4, 5), (5, 4), (6, 6), (7, 8), (8, 9), (0, 1), (None, 3), (9, None)]
    df = spark.createDataFrame(edges, "a long, b long")
    assert rows(graph.cycle_nodes(df, "a", "b")) == [(i,) for i in (1, 2, 3, 4, 5, 6)]
    assert graph.cycle_nodes(df.where("a > 6"), "a", "b").count() == 0
    assert graph.cycle_nodes(df.limit(0), "a", "b").count() == 0
    between = spark.createDataFrame([(1, 2), (2, 1), (2, 3), (3, 4), (4, 5), (5, 4)], "a long, b long")
    assert rows(graph.cycle_nodes(between, "a", "b")) == [(1,), (2,), (4,), (5,)]  # 3 only leads from one to the other


def test_cycles_of_long_ways_take_few_steps(spark, monkeypatch):
    ways = [(i, i + 1) for i in range(300)] + [(300, 298)]  # a long way into a cycle
    ways += [(1000 + i // 2, 1000 + i) for i in range(2, 200)] + [(1199, 2000), (2000, 1199)]  # a tree that ends in one
    steps = []
    monkeypatch.setattr(graph, "saved", lambda df: steps.append(1) or storage.saved(df))
    df = spark.createDataFrame(ways, "a long, b long")
    assert {r.node for r in graph.cycle_nodes(df, "a", "b").collect()} == {298, 299, 300, 1199, 2000}
    assert len(steps) < 100  # one step a node of the way before
    pairs = [(i, (i * i + 3 * i + j) % 47) for i in range(30) for j in (0, 31)] + [(i, i + 1) for i in range(100, 140)] + [(140, 100), (7, 120), (138, 99)]
    after = {u: {v for w, v in pairs if w == u} for u, _ in pairs}

    def leads_back(u):
        seen, more = set(), set(after[u])
        while more - seen:
            seen |= more
            more = set().union(*(after.get(v, set()) for v in more))
        return u in seen

    got = graph.cycle_nodes(spark.createDataFrame(pairs, "a long, b long"), "a", "b")
    assert {r.node for r in got.collect()} == {u for u in after if leads_back(u)}


def test_graph_problems_behind_a_long_way(spark, monkeypatch):
    steps = []
    monkeypatch.setattr(graph, "saved", lambda df: steps.append(1) or storage.saved(df))
    nodes = spark.range(200)
    edges = nodes.select("id", F.when(F.col("id") == 0, 1).when(F.col("id") == 150, 999).otherwise(F.col("id") - 1).alias("needs"))
    assert rows(graph.graph_problems(nodes, edges, "id", "needs")) == [(0, "cycle", None), (1, "cycle", None), (150, "missing_dependency", "999")]
    assert len(steps) < 60


def test_graph_problems_of_single_ways_take_few_steps(spark, monkeypatch):
    steps = []
    monkeypatch.setattr(graph, "saved", lambda df: steps.append(1) or storage.saved(df))
    nodes = spark.range(400)
    needs = F.when(F.col("id") % 10 == 3, F.col("id") + 4).when(F.col("id") % 10 == 7, F.col("id") - 4).when(F.col("id") == 250, 10**6).when(F.col("id") >= 300, F.col("id") - 1)
    edges = nodes.select("id", F.coalesce(needs, F.col("id").cast("double") / 2).cast("long").alias("needs")).where("id % 10 != 5")
    cycles = [(i, "cycle", None) for i in range(400) if i == 0 or i % 10 in (3, 7)]
    for given in (edges, edges.unionByName(edges)):  # repeated edges are not several ways out
        steps.clear()
        assert rows(graph.graph_problems(nodes, given, "id", "needs").distinct()) == sorted(cycles + [(250, "missing_dependency", "1000000")], key=repr)
        assert len(steps) <= 6  # two steps a doubling before


def test_cycles_with_few_or_no_forks(spark):
    ways = {
        "one way out": [(i, (7 * i * i + 3) % 211) for i in range(211)],
        "a chain into a cycle, loops on it": [(i, i + 1) for i in range(90)] + [(90, 70), (80, 80), (5, 5), (90, None), (None, 1)],
        "two ways at one node": [(i, i // 2) for i in range(1, 200)] + [(1, 150)],
        "layers, no cycle": [(10 * i + j, 10 * i + 10 + (3 * j + k) % 10) for i in range(6) for j in range(10) for k in (0, 1)],
    }
    for name, edges in ways.items():
        after = {}
        for u, v in edges:
            if u is not None and v is not None:
                after.setdefault(u, set()).add(v)

        def leads_back(u):
            seen, more = set(), set(after[u])  # noqa: B023
            while more - seen:
                seen |= more
                more = set().union(*(after.get(v, set()) for v in more))  # noqa: B023
            return u in seen

        got = [r.node for r in graph.cycle_nodes(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()]
        assert sorted(got) == sorted(u for u in after if leads_back(u)), name


def test_batch_plan(spark):
    tasks = spark.createDataFrame(
        [("q", 3, 0, ["io"]), ("q", 1, 0, ["io"]), ("q", 2, 0, []), ("q", 4, 1, ["db"]), ("q", 5, 2, ["net"]), ("z", 9, 0, [])], "queue string, id int, priority int, exclusive array<string>"
    )
    got = rows(graph.batch_plan(tasks, "queue", 3))
    assert got == [("q", 1, "batch"), ("q", 2, "batch"), ("q", 3, "overlaps"), ("q", 4, "batch"), ("q", 5, "batch full"), ("z", 9, "batch")]


def test_manifest(spark):
    kind = "asset_id string, path string, sha256 string, split string, group_id string, person_ids array<string>, tags array<string>"
    assets = spark.createDataFrame(
        [("a", "p", "h", "dev", "g", ["u", "v"], ["t"]), ("b", "q", "h", "locked_test", None, ["v"], []), ("a", "r", None, None, "g", None, None)], kind
    )
    required = spark.createDataFrame([("dev", "t", 1), ("dev", "x", 2)], "split string, tag string, n long")
    got = rows(corpus.manifest_errors(assets, required))
    assert got == sorted([
        ("missing_coverage", "dev/x", "0 of 2"), ("person_in_several_splits", "v", "dev,locked_test"), ("repeated_asset_id", "a", "2"), ("repeated_sha256", "h", "2"),
        ("unknown_split", "a", None),
    ], key=repr)
    assert corpus.manifest_errors(assets.limit(0), required.limit(0)).count() == 0
    assert rows(corpus.split_report(assets), "split", "n_assets", "n_persons", "tags") == [("dev", 1, 2, "t=1"), ("locked_test", 1, 1, None), (None, 1, 0, None)][:2] + [(None, 1, 0, None)]


def test_faces_are_paired_one_to_one(spark):
    kind = "img int, k int, x double, y double, w double, h double"
    left = spark.createDataFrame([(1, 1, 0.0, 0.0, 10.0, 10.0), (1, 2, 1.0, 0.0, 10.0, 10.0), (2, 1, 0.0, 0.0, 1.0, 1.0)], kind)
    right = spark.createDataFrame([(1, 7, 1.0, 0.0, 10.0, 10.0), (1, 8, 30.0, 0.0, 5.0, 5.0)], kind)
    box = ("x", "y", "w", "h")
    assert rows(faces.matched_faces(left, right, "img", box, "k")) == [(1, 1, 7), (1, 2, None), (2, 1, None)]
    got = {(r.img, r.anchor): r.face for r in faces.bound_faces(left, right, "img", box, "k").collect()}
    assert got == {(1, 1): None, (1, 2): 7, (2, 1): None}  # the best overlap first, not the first face


def test_tracks(spark):
    kind = "b int, t int, k int, x double, y double, w double, h double"
    seen = [(1, 0, 1, 0.0, 0.0, 10.0, 10.0), (1, 0, 2, 50.0, 0.0, 10.0, 10.0), (1, 1, 1, 52.0, 0.0, 10.0, 10.0), (1, 1, 2, 3.0, 0.0, 10.0, 10.0), (1, 2, 1, 20.0, 0.0, 10.0, 10.0), (1, 3, 1, 54.0, 1.0, 10.0, 10.0)]
    got = rows(faces.tracks(spark.createDataFrame(seen, kind), "b", "t", "k", ("x", "y", "w", "h")))
    assert got == [(1, 0, 1, 0), (1, 0, 2, 1), (1, 1, 1, 1), (1, 1, 2, 0), (1, 2, 1, 2), (1, 3, 1, 1)]


def test_versions_and_paths(spark):
    df = spark.createDataFrame([("1.4.2",), ("1.5",), ("v2.0.1",), ("1.4.2rc1",)], "v string")
    check = lambda spec: [r.ok for r in df.select(names.version_satisfies(F.col("v"), spec).alias("ok")).collect()]
    assert check("~=1.4.1") == [True, False, False, True]
    assert check("==1.*") == [True, True, False, True]
    assert check(">=1.4.2,<2") == [True, True, False, True]
    assert check("") == [True] * 4 and check("weird") == [False] * 4
    text = spark.createDataFrame([("see /home/a/b.txt and C:\\x\\y.z, not a/b or 1/2",)], "t string")
    assert text.select(names.redacted(F.col("t"))).first()[0] == "see <redacted-path> and <redacted-path> not a/b or 1/2"


def test_spans(spark):
    spans = spark.createDataFrame([("a", 1, 0, 25), ("a", 2, 30, 20), ("b", 3, 10, 10)], "k string, s int, low long, high long")
    points = spark.createDataFrame([("a", 0), ("a", 25), ("a", 26), ("b", 10), ("c", 5)], "k string, at long")
    assert rows(planning.in_range(spans, points, ["k"], "low", "high", "at", 10), "s", "at") == [(1, 0), (1, 25), (3, 10)]


def test_as_of_in_slices(spark):
    rng = np.random.default_rng(3)
    left = spark.createDataFrame([(i, int(i % 2), int(t)) for i, t in enumerate(rng.integers(0, 1000, 200))], "i int, k int, t long")
    right = spark.createDataFrame([(j, int(j % 2), int(t)) for j, t in enumerate(rng.integers(0, 1000, 40))] + [(99, 0, None)], "j int, k int, at long")
    whole = rows(temporal.as_of(left, right, ["k"], "t", "at", ["j"], "j"), "i", "matched_at", "matched_j")
    assert rows(temporal.as_of(left, right, ["k"], "t", "at", ["j"], "j", slice_width=37), "i", "matched_at", "matched_j") == whole


def test_scan_of_a_long_array(spark):
    df = spark.range(1).select(F.sequence(F.lit(1), F.lit(1000)).alias("a"))
    sums = df.select(folds.scan(F.col("a"), {"s": F.lit(0)}, lambda acc, x: ({"s": acc["s"] + x}, acc["s"] + x), "int")).first()[0]
    assert sums == np.cumsum(np.arange(1, 1001)).tolist()
    assert spark.range(1).select(folds.scan(F.array().cast("array<int>"), {"s": F.lit(0)}, lambda acc, x: ({"s": x}, x), "int")).first()[0] == []


@pytest.mark.parametrize("space", ["hsv", "lab", "lch", "oklab", "oklch"])
def test_spaces_lead_back(spark, space):
    pixels = spark.createDataFrame([tuple(map(float, p)) for p in np.random.default_rng(1).random((50, 3))] + [(0.0, 0.0, 0.0), (1.0, 1.0, 1.0), (0.5, 0.5, 0.5)], "r double, g double, b double")
    done = grading.in_space(pixels.select("*", *[F.col(c).alias(f"was_{c}") for c in "rgb"]), space, lambda x, y, z: (x, y, z))
    for r in done.collect():
        assert all(abs(r[c] - r[f"was_{c}"]) < 1e-5 for c in "rgb")


def test_gamut_and_balance(spark):
    df = spark.createDataFrame([(0.7, 30.0), (0.0, 0.0), (1.0, 90.0), (0.5, 264.0)], "l double, h double")
    got = df.select(grading.gamut_limit(F.col("l"), F.col("h")).alias("c"), "l", "h").collect()
    assert got[1].c == got[2].c == 0 and all(0 < r.c < 0.5 for r in (got[0], got[3]))
    white = spark.range(1).select(*[c.alias(n) for c, n in zip(grading.white_balanced(F.lit(0.5), F.lit(0.5), F.lit(0.5), 3000.0), "rgb", strict=True)]).first()
    assert white.r < white.g < white.b  # a warm light is taken out
    assert np.allclose(np.array(grading.white_balance_matrix(6504.0)), np.eye(3), atol=0.02)
    black = spark.range(1).select(colour.safe_divide(F.lit(1.0), F.lit(0.0), -1.0).alias("x")).first()
    assert black.x == -1


def test_gamut_limits_of_computed_colours_take_little(spark):
    """A lightness and hue that are long expressions themselves are computed once a row."""
    pixels = spark.range(200_000).select((F.col("id") % 50 / 50).alias("r"), (F.col("id") % 11 / 10).alias("g"), (F.col("id") % 9 / 8).alias("b"))
    light, a, b = colour.srgb_to_oklab(F.col("r"), F.col("g"), F.col("b"))
    plain = pixels.select("r", "g", "b", light.alias("l"), F.degrees(F.atan2(b, a)).alias("h"))
    found = plain.select("r", "g", "b", grading.gamut_limit(F.col("l"), F.col("h")).alias("c"))
    began = time.monotonic()
    most = found.agg(F.max("c")).first()[0]
    assert time.monotonic() - began < 20 and 0.2 < most < 0.5
    odd = spark.createDataFrame([(None, 10.0), (0.5, None), (float("nan"), 1.0)], "l double, h double")
    assert [r.c for r in odd.select(grading.gamut_limit(F.col("l"), F.col("h")).alias("c")).collect()] == [0.0, 0.0, 0.0]


def test_percentiles_between_equal_values(spark):
    values = [1234.56, 48617.07, 27900.33, 90123.45, 3.3, 0.7]
    df = spark.createDataFrame([(n, v) for n in range(12, 32) for v in values for _ in range(n)], "n int, v double")
    got = {(r.n, r.v): r["__p"] for r in robust.order_statistics(df.withColumn("w", F.col("v")), ["n", "v"], "w", (0.1, 0.37, 0.9)).collect()}
    assert len(got) == 20 * len(values) and all(list(p) == [v] * 3 for (_, v), p in got.items())


def test_ranks_and_counts_share_saved_edges(spark):
    """Merging a sketch in another order gives other edges; counts and ranks read the same saved ones."""
    df = spark.range(400).select((F.col("id") % 2).alias("set_id"), F.col("id").alias("k"))
    got = ranking.rank_within(df, ["set_id"], "k", "k", descending=False)
    assert "percentile_approx" not in got._jdf.queryExecution().optimizedPlan().toString()
    assert all(r["rank"] == r.k // 2 + 1 for r in got.collect())


def test_jaccard_moves_prefixes_only(spark):
    rng = np.random.default_rng(3)
    sets = {k: sorted({f"w{w}" for w in rng.integers(0, 30, rng.integers(1, 12))}) for k in range(80)}
    sets |= {k + 100: t[1:] + ["z"] for k, t in sets.items()} | {300: [], 301: ["z"]}
    df = spark.createDataFrame(list(sets.items()), "class_id long, tokens array<string>")
    for threshold in (0.5, 0.75):
        found = similarity.jaccard_join(df, threshold)
        assert "Window" not in found._jdf.queryExecution().optimizedPlan().toString()  # every token was shuffled to be ranked
        share = lambda a, b: len(set(a) & set(b)) / max(1, len(set(a) | set(b)))
        want = {(i, j) for i in sets for j in sets if i < j and share(sets[i], sets[j]) >= threshold}
        assert {(r.left_id, r.right_id) for r in found.collect()} == want


def test_jaccard_of_long_sets(spark):
    """Long sets are cut into parts by the hashes of their tokens; pairs on both sides of a step meet, and unlike sets that share rare tokens are no candidates."""
    rng = np.random.default_rng(5)
    common = [f"c{i}" for i in range(500)]
    sets: dict[int, list[str]] = {}
    for k, n in enumerate([*range(52, 68, 4), *range(215, 300, 12), *range(850, 1200, 50), 1500]):
        own = [f"r{k % 3}", *rng.choice(common, n // 3, replace=False).tolist(), *(f"w{w}" for w in rng.integers(0, 1 << 40, n - n // 3 - 1))]
        sets[10 * k] = sorted(own)
        for i, share in enumerate((0.99, 0.9, 0.8, 0.76, 0.74)):
            sets[10 * k + i + 1] = sorted(rng.choice(own, math.ceil(share * n), replace=False).tolist())
        sets[10 * k + 6] = sorted({*own[n // 8 :], *(f"x{i}" for i in range(n // 8))})
    df = spark.createDataFrame(list(sets.items()), "class_id long, tokens array<string>")
    share = lambda a, b: len(a & b) / len(a | b)
    as_sets = {k: set(t) for k, t in sets.items()}
    want = {(i, j): share(as_sets[i], as_sets[j]) for i in sets for j in sets if i < j}
    want = {pair: s for pair, s in want.items() if s >= 0.75}
    met = {(r.left_id, r.right_id) for r in similarity.jaccard_candidates(df.select(F.col("class_id").alias("k"), F.col("tokens").alias("t")), 0.75).collect()}
    assert want.keys() <= met and all(i // 10 == j // 10 for i, j in met)
    assert {(r.left_id, r.right_id): r.jaccard for r in similarity.jaccard_join(df, 0.75).collect()} == want


def test_jaccard_of_a_crowd(spark):
    """The tokens of near sets move about once, not once a pair; tiles of a crowd lose no pair."""
    base = [f"w{i}" for i in range(40)]
    sets = [(k, sorted([*base, f"own{k}"])) for k in range(600)]
    df = spark.createDataFrame(sets, "class_id long, tokens array<string>")
    found = similarity.jaccard_join(df, 0.75)
    assert "array_intersect" not in found._jdf.queryExecution().optimizedPlan().toString()  # a join of pairs with the tokens of both sides
    assert found.distinct().count() == found.count() == 600 * 599 // 2
    assert [r.jaccard for r in found.select("jaccard").distinct().collect()] == [40 / 42]


def test_linkage_moves_a_crowd_once(spark, tmp_path):
    """The tokens of near documents are not moved for each of their pairs."""
    rng = np.random.default_rng(11)
    words = [f"w{w}" for w in rng.integers(0, 1 << 40, 4000)]
    texts = [(k, " ".join([*rng.choice(words, 3960, replace=False), f"own{k}"])) for k in range(40)]
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    context = spark.sparkContext
    no = context._jvm.java.util.ArrayList()

    def stages():
        every = context._jsc.sc().statusStore().stageList(no, False, False, context._gateway.new_array(context._jvm.double, 0), no)
        return {(s.stageId(), s.attemptId()): s.shuffleWriteBytes() for s in map(every.apply, range(every.size()))}

    before, limit = stages(), spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)  # as with tables of more than a few rows
        found = rows(catalogue.linkage_groups(spark, str(tmp_path)))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    assert found == sorted(((0, r[1], r[2]) for r in found), key=repr) and sorted(r[1] for r in found) == list(range(40))
    assert sum(n for s, n in stages().items() if s not in before) < 20_000_000  # a join of the pairs with the tokens of both sides moved 54 million


def test_documents(spark):
    texts = spark.createDataFrame([("a", '{"name": "x", "params": {"p": 1.5}}'), ("b", "{oops"), ("c", '{"params": {}}'), ("d", '{"name": "known"}'), ("e", '{"name": "y", "extends": "gone"}'), ("f", None)], "path string, text string")
    good, bad = documents.imported_recipes(texts, spark.createDataFrame([("known",)], "recipe string"))
    assert rows(good) == [("x", None, "p", 1.5)]
    assert rows(bad) == sorted([("b", "malformed"), ("c", "missing_name"), ("d", "exists"), ("e", "unknown_parent"), ("f", "malformed")], key=repr)
    cubes = spark.createDataFrame([("ok", "3DLUTSIZE 2\n" + "\n".join(["0 0.5 1"] * 8)), ("short", "3DLUTSIZE 2\n0 0 0"), ("none", "0 0 0")], "path string, text string")
    assert documents.read_3dl(cubes).groupBy("path").count().collect()[0]["count"] == 8
    plan = spark.createDataFrame([("a", "X"), ("b", "x"), ("c", "c")], "s string, d string")
    assert rows(documents.move_plan(plan, "s", "d")) == [("a", "X", "conflict"), ("b", "x", "conflict"), ("c", "c", "done")]


def test_shared_folder():
    """Where none is named a cluster is refused, and a local run gets a folder."""
    from types import SimpleNamespace

    from framelake import storage

    def session(master, named=None, at=None):
        held = {"dir": at}
        context = SimpleNamespace(master=master, getCheckpointDir=lambda: held["dir"], setCheckpointDir=lambda d: held.update(dir=d))
        return SimpleNamespace(conf=SimpleNamespace(get=lambda key, default: named), sparkContext=context)

    assert storage.shared_folder(session("yarn", "hdfs://x/y")) == "hdfs://x/y"
    assert storage.shared_folder(session("spark://h", None, "s3://z")) == "s3://z"
    for master in ("yarn", "spark://h:7077", "local-cluster[2,1,1024]"):
        with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
            storage.shared_folder(session(master))
    assert "checkpoints-" in storage.shared_folder(session("local[2]"))


def test_saved_leaves_no_shuffle_and_can_be_released(spark):
    from framelake import storage

    before = spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled")
    df = storage.saved(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count())
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == before
    assert df.count() == 7 and df.join(df.withColumnRenamed("count", "n"), "k").count() == 7
    storage.release(df)
    with pytest.raises(Exception):  # noqa: B017
        df.collect()


def test_review_rules(spark):
    items = spark.createDataFrame([(1, 2.0), (2, None), (3, -1.0), (4, 4.0)], "k int, mp double")
    assert rows(review.with_default(items, "mp")) == [(1, 2.0), (2, 3.0), (3, 3.0), (4, 4.0)]
    assert rows(review.with_default(items.where("k in (2, 3)"), "mp")) == [(2, 1.0), (3, 1.0)]
    covers = spark.createDataFrame([(1, "closed", 10.0), (2, "open", 4.0), (3, "open", 9.0)], "k int, e string, s double")
    assert [(k, pytest.approx(g)) for k, g in rows(review.face_gate(covers, "e", "s"), "k", "gate")] == [(1, 0.6), (2, 0.8), (3, 1.0)]
    assert {g for _, g in rows(review.face_gate(covers.where("k > 1"), "e", "s"), "k", "gate")} == {1.0}
