"""Connected components, cycles and closures over edge tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..storage import release, saved
from .ordered import SLICE_ROWS, numbered, walked

MOST_ROUNDS = 60
#: A saved step follows each pointer through so many more: joins cost less than steps.
HOPS = 3
#: Fixed value: the part of a batch that is kept for housekeeping.
HOUSEKEEPING_SHARE = 0.30


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is tied to the smallest node around it. Edges have u > v."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are tied to the smallest of these."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def _marked(edges: DataFrame) -> tuple[DataFrame, dict]:
    """``edges``, saved, and a mark that equal edge sets share, taken as they are written."""
    seen = Observation()
    mark = edges.observe(seen, F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("sum"))
    return saved(mark), seen.get


def connected_components(edges: DataFrame, a: str, b: str, most_rounds: int = MOST_ROUNDS) -> DataFrame:
    """``node, component`` for every node of an edge; component: its smallest node.

    Alternating large-star and small-star steps: each round is saved, the edges end as stars around the smallest nodes, and the
    number of rounds grows with the logarithm of the nodes. An error if ``most_rounds`` don't settle it. Null ends and
    loops are dropped.
    """
    ends = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
    now, mark = _marked(ends.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col("u") != F.col("v"))).distinct())
    before = None
    for _ in range(most_rounds):
        if mark["n"] == 0 or mark == before:
            break
        before, last = mark, now
        now, mark = _marked(_small_star(_large_star(now)))
        release(last)
    else:
        raise RuntimeError(f"components not settled in {most_rounds} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )


def _spread(edges: DataFrame, marks: DataFrame, mark: str) -> DataFrame:
    """``node`` and the largest ``mark`` of it and of all nodes that lead to it (``marks``: a row a node); a saved row a node each round, until nothing changes."""
    held = saved(marks.select("node", mark, F.lit(True).alias("__more")))
    while True:
        now = held.select("node", mark)
        reached = edges.join(now, F.col("u") == F.col("node")).groupBy("v").agg(F.max(mark).alias("__new"))
        after = now.join(reached, F.col("node") == F.col("v"), "left")
        seen = Observation()
        after = after.select("node", F.greatest(mark, "__new").alias(mark), F.coalesce(F.col("__new") > F.col(mark), F.lit(False)).alias("__more"))
        last, held = held, saved(after.observe(seen, F.count_if("__more").alias("n")))
        release(last)
        if not seen.get["n"]:
            return held.select("node", mark)


def _counted(rows: DataFrame, what: Column | None = None) -> tuple[DataFrame, int]:
    """``rows``, saved, and their number (or what ``what`` counts), taken as they are written."""
    seen = Observation()
    held = saved(rows.observe(seen, (F.count(F.lit(1)) if what is None else F.count_if(what)).alias("n")))
    return held, seen.get["n"]


def _followed(ways: DataFrame, further: DataFrame, how: str) -> DataFrame:
    """``u, p, more``: the pointers of ``ways`` followed through ``HOPS`` of ``further`` (both ``u, p``, a row a node). A pointer that leads nowhere drops out (``how``:
    inner) or stays where it ends (left); ``more``: the last hop moved it."""
    after = further.select(F.col("u").alias("p"), F.col("p").alias("q"))
    for _ in range(HOPS):
        ways = ways.join(after, "p", how).select("u", F.coalesce("q", "p").alias("p"), F.col("q").isNotNull().alias("more"))
    return ways


def _circling(ways: DataFrame) -> DataFrame:
    """``node`` (saved) for every node that its pointers lead back to. Ways: ``u, p``, a row a node.

    Nodes that no pointer reaches and pointers that lead nowhere drop out while the rest is followed, in as many saved steps as the logarithm of the longest way. When
    none drops out any more, the pointers permute what is left, so all of that is on cycles.
    """
    now, n, first = ways, None, True
    while True:
        reached = now.select(F.col("p").alias("u")).distinct()
        last, before = now, n
        now, n = _counted(_followed(now.join(reached, "u", "left_semi"), now, "inner").select("u", "p"))
        if not first:
            release(last)
        first = False
        if not n or n == before:
            return now.select(F.col("u").alias("node"))


def _ended(ways: DataFrame) -> DataFrame:
    """``ways`` (``u, p``, a row a node, nothing circles), saved, with each pointer followed to where it ends."""
    held, more = saved(ways), 1
    while more:
        now, last = held.select("u", "p"), held
        held, more = _counted(_followed(now, now, "left"), F.col("more"))
        release(last)
    return held.select("u", "p")


def _without(edges: DataFrame, gone: DataFrame) -> DataFrame:
    """Edges with no end among ``gone`` (``node``)."""
    for end in ("u", "v"):
        edges = edges.join(gone.withColumnRenamed("node", end), end, "left_anti")
    return edges.select("u", "v")


def _drained(edges: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """What nodes with one way out settle: ``node`` of those on a cycle, and ``node`` of those that need no further look (saved; None: all).
    Edges: distinct ``u, v``, no loops.

    The only ways out are pointers. Those that lead back are cycles that nothing leaves (``_circling``); the others end at a node with several ways out, at a dead end, or
    on such a cycle. Nodes that lead to dead ends or to such cycles alone lie on no other cycle: without nodes of several ways out, that holds of all.
    """
    outs, forks = _counted(edges.groupBy("u").agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("p")), F.col("n") > 1)
    ways = outs.where("n = 1").select("u", "p")
    round_ = _circling(ways)
    if not forks:
        return round_, None
    dead = edges.select(F.col("v").alias("node")).distinct().join(outs.select(F.col("u").alias("node")), "node", "left_anti")
    over = saved(round_.unionByName(dead))
    ends = _ended(ways.join(round_.withColumnRenamed("node", "u"), "u", "left_anti"))
    settled = ends.join(over.withColumnRenamed("node", "p"), "p", "left_semi").select(F.col("u").alias("node"))
    return round_, saved(settled.unionByName(over).distinct())


def _trimmed(edges: DataFrame, n: int, least_share: float = 0.25) -> tuple[DataFrame, int]:
    """Of ``n`` saved edges those from nodes that an edge leads to, to nodes that one leaves; the rest is on no cycle. Again, as long as a step takes ``least_share`` away. Saved, with their number."""
    while True:
        reached, left = edges.select(F.col("v").alias("u")).distinct(), edges.select(F.col("u").alias("v")).distinct()
        last, before = edges, n
        edges, n = _counted(edges.join(reached, "u", "left_semi").join(left, "v", "left_semi").select("u", "v"))
        release(last)
        if not n or before - n < least_share * before:
            return edges, n


def _thinned(edges: DataFrame, n: int, least_share: float = 0.01) -> tuple[list[DataFrame], DataFrame | None]:
    """Frames of ``node`` on cycles, and those of ``n`` saved edges that are left (saved; None: none): trimmed, then ``_drained`` along the edges and against them, until that takes
    nothing or under ``least_share`` of the edges away."""
    found: list[DataFrame] = []
    while n:
        edges, n = _trimmed(edges, n)
        before = n
        for u, v in (("u", "v"), ("v", "u")):
            if not n:
                break
            on, gone = _drained(edges.select(F.col(u).alias("u"), F.col(v).alias("v")))
            found.append(on)
            last = edges
            edges, n = (edges, 0) if gone is None else _counted(_without(edges, gone))
            if last is not edges:
                release(last)
        if n and before - n <= least_share * before:
            return found, edges
    return found, None


def cycle_nodes(edges: DataFrame, a: str, b: str) -> DataFrame:
    """``node`` for every node that lies on a directed cycle, a loop at itself included. Null ends are dropped.

    If no node has several ways out (loops aside), following these settles it (``_circling``). Else what no cycle can hold and what nodes with one way out or one way in settle is taken out
    first (``_thinned``). Then each round colours a node by the largest node that leads to it; a node that keeps its own
    number is the pivot of its colour, and what leads back to it within the colour is its strongly connected piece, on cycles if
    it has two nodes. Pieces are taken out, edges between colours are on no cycle, and the rest goes on, thinned again. State is one row a node; the steps of a
    round grow with the longest of the shortest ways between nodes that are left.
    """
    ends = edges.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(F.col(a).alias("u"), F.col(b).alias("v"))
    other = F.when(F.col("u") != F.col("v"), F.col("v"))
    outs = ends.groupBy("u").agg(F.min(other).alias("p"), F.max(other).alias("q"), F.bool_or(F.col("u") == F.col("v")).alias("loop"))
    outs, forks = _counted(outs, F.col("p") != F.col("q"))
    found = [outs.where("loop").select(F.col("u").alias("node"))]
    if not forks:
        found.append(_circling(outs.where("p is not null").select("u", "p")))
        return reduce(DataFrame.unionByName, found).distinct()
    on, now = _thinned(*_counted(ends.where("u != v").distinct()))
    found += on
    while now is not None:
        nodes = now.select(F.col("u").alias("node")).unionByName(now.select(F.col("v").alias("node"))).distinct()
        colours = _spread(now, nodes.withColumn("colour", F.col("node")), "colour")
        of = lambda end: colours.select(F.col("node").alias(end), F.col("colour").alias(f"c{end}"))  # noqa: B023, E731
        inside = saved(now.join(of("u"), "u").join(of("v"), "v").where("cu = cv").select("u", "v"))
        back = inside.select(F.col("v").alias("u"), F.col("u").alias("v"))
        reached = _spread(back, colours.select("node", (F.col("node") == F.col("colour")).cast("int").alias("hit")), "hit").where("hit = 1")
        piece = saved(reached.join(colours, "node"))
        sizes = piece.groupBy("colour").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        found.append(saved(piece.join(sizes, "colour", "left_semi").select("node")))
        on, now = _thinned(*_counted(_without(inside, piece.select("node"))))
        found += on
    return reduce(DataFrame.unionByName, found).distinct()


def graph_problems(nodes: DataFrame, edges: DataFrame, key: str, needs: str) -> DataFrame:
    """``node, problem, detail``: dependencies that don't exist, and nodes on a cycle. Nodes are many and thin: they are never broadcast."""
    known = nodes.select(F.col(key).alias(needs)).distinct().withColumn("__there", F.lit(True))
    met = saved(edges.select(key, needs).join(known.hint("merge"), needs, "left"))
    lost = met.where("__there is null").select(F.col(key).alias("node"), F.lit("missing_dependency").alias("problem"), F.col(needs).cast("string").alias("detail"))
    return lost.unionByName(cycle_nodes(met.where("__there"), key, needs).select("node", F.lit("cycle").alias("problem"), F.lit(None).cast("string").alias("detail")))


def leases(tasks: DataFrame, modes: Column, now: Column, hours: float) -> DataFrame:
    """``subsystem, holder, mode`` of the active leases: a live task (``id, subsystems, heartbeat`` in microseconds) holds its subsystems
    until its heartbeat is too old; the strongest mode counts (ties: the smallest id)."""
    held = tasks.where(F.col("heartbeat") + int(hours * 3.6e9) >= now).select("id", F.explode("subsystems").alias("subsystem")).withColumn("mode", modes)
    strength = F.array_position(F.array(*map(F.lit, ("SHARED", "CAUTION", "EXCLUSIVE"))), F.col("mode"))
    best = F.max_by(F.struct(F.col("id").alias("holder"), "mode"), F.struct(strength, (-F.col("id")).alias("i")))
    return held.groupBy("subsystem").agg(best.alias("x")).select("subsystem", "x.holder", "x.mode")


def lease_conflicts(tasks: DataFrame, held: DataFrame) -> DataFrame:
    """``id, subsystem, holder, mode`` of subsystems that another task holds, other than in shared mode."""
    asked = tasks.select("id", F.explode("subsystems").alias("subsystem"))
    return asked.join(held.where("mode != 'SHARED'"), "subsystem").where("holder != id").select("id", "subsystem", "holder", "mode")


def overlap_verdicts(candidates: DataFrame, tasks: DataFrame, least_hits: int = 2, distinctive: int = 8, most: int = 1000) -> DataFrame:
    """``candidate, verdict, n_matches`` of a few proposed titles (``candidate, tokens``; ``most`` at most, which are broadcast) against all
    tasks (``id, tokens, live``): matches share ``least_hits`` words or one distinctive (long) word; DUPLICATE if they share
    four fifths of the shorter title with a live task."""
    if candidates.limit(most + 1).count() > most:
        raise ValueError(f"over {most} candidates")
    few = F.broadcast(candidates.select("candidate", F.col("tokens").alias("__own")))
    met = tasks.where("live").join(few, F.arrays_overlap("tokens", "__own"))
    hits = F.array_intersect("tokens", "__own")
    match = met.where((F.size(hits) >= least_hits) | F.exists(hits, lambda w: F.length(w) >= distinctive))
    score = F.round(F.size(hits) / F.greatest(F.lit(1), F.least(F.size("tokens"), F.size("__own"))), 2)
    found = match.groupBy("candidate").agg(F.count(F.lit(1)).alias("n_matches"), F.max(score).alias("best"))
    verdict = F.when(F.col("best") >= 0.8, "DUPLICATE").when(F.col("n_matches") > 0, "POSSIBLE_OVERLAP").otherwise("UNIQUE")
    return candidates.join(F.broadcast(found), "candidate", "left").select("candidate", verdict.alias("verdict"), F.coalesce("n_matches", F.lit(0)).alias("n_matches"))


def batch_plan(tasks: DataFrame, queue: str, most: int, active: DataFrame | None = None, share: float = HOUSEKEEPING_SHARE, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """``queue, id, decision`` of ready tasks (``id, priority, exclusive``: the subsystems that bear one task at a time; ``housekeeping`` if there is such a column) per
    queue, by priority and id: a task joins the batch unless it is full (``batch full``) or one of its exclusive subsystems is taken
    (``overlaps``), by the batch or by one of the queue's ``active`` tasks (``exclusive``). Of ``most`` places ``share`` (one at least) are for housekeeping; once these
    are used, housekeeping doesn't get the last place (``reserved``).

    Each decision depends on those before it; the batch so far is carried from slice to slice of a queue (``ordered.folded``).
    """
    chore = F.col("housekeeping") if "housekeeping" in tasks.columns else F.lit(False)
    slim = tasks.select(queue, "id", "priority", "exclusive", F.coalesce(chore, F.lit(False)).alias("chore"))
    if active is None:
        slim = slim.withColumn("held", F.array().cast("array<string>"))
    else:
        held = active.groupBy(F.col(queue).alias("__queue")).agg(F.array_distinct(F.flatten(F.collect_set("exclusive"))).alias("held"))
        slim = slim.join(held, F.col(queue).eqNullSafe(F.col("__queue")), "left").withColumn("held", F.coalesce("held", F.array().cast("array<string>")))
    places = max(1, int(most * share))

    def step(state: Column, x: Column) -> tuple[dict[str, Column], Column]:
        full = state["n"] >= most
        clash = F.arrays_overlap(state["taken"], x["exclusive"]) | F.arrays_overlap(x["held"], x["exclusive"])
        reserved = x["chore"] & (state["chores"] >= places) & (state["n"] >= most - 1)
        take = ~full & ~clash & ~reserved
        taken = F.when(take, F.array_union(state["taken"], x["exclusive"])).otherwise(state["taken"])
        new = {"n": state["n"] + take.cast("int"), "taken": taken, "chores": state["chores"] + (take & x["chore"]).cast("int")}
        return new, F.when(full, "batch full").when(clash, "overlaps").when(reserved, "reserved").otherwise("batch")

    start = {"n": F.lit(0), "taken": F.array().cast("array<string>"), "chores": F.lit(0)}
    placed = numbered(slim, [queue], ["priority", "id"])
    found = walked(placed, queue, ["id", "exclusive", "chore", "held"], start, step, "string", slice_rows)
    return found.select(queue, "id", F.col("out").alias("decision"))


def pressure(tasks: DataFrame) -> DataFrame:
    """``subsystem, n`` live tasks of each subsystem."""
    return tasks.select(F.explode("subsystems").alias("subsystem")).groupBy("subsystem").agg(F.count(F.lit(1)).alias("n"))


def shared_files(changes: DataFrame, unit: str, file: str) -> DataFrame:
    """``file, n, units`` of files that several units change, the units in order: all their overlaps without a row for each pair."""
    found = changes.select(unit, file).distinct().groupBy(file).agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list(unit)).alias("units"))
    return found.where("n > 1")
