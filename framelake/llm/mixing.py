"""Mixing sources to target weights by the cube method.

A source whose target is r times its size takes every document floor(r) times, and
once more with inclusion probability r - floor(r). The extra copies are drawn by
balanced sampling: the flight phase moves the vector of inclusion probabilities
along directions in the null space of the balancing constraints (tokens, documents)
until all but two are 0 or 1. It runs in blocks of bounded size; the few documents of
each block that are still open go on to the next level, block by block, until one
block per source remains. Its landing drops the document constraint, then the token
constraint, and leaves a miss of less than one document's size and less than one document. As documents differ in
size by orders of magnitude, each block also hands on some closed documents; the last step swaps taken ones of
them for others, one for one, where that brings the source's tokens closer to the target. Of a source's documents at most
``SWAPS`` pairs differ by that from the draw, whatever its size, so inclusion frequencies stay those of the cube method.

Every draw comes from a hash of the seed and the document, so reruns agree.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, prefix, saved
from .words import mix as mix_bits

BLOCK_ROWS = 8192
#: Weights by rank of the source, repeating.
WEIGHTS = (1, 2, 3)
#: No source is taken more than so many times.
MOST = 3
#: Of so many rows of a block one, closed, stays open to swaps on the next level; and swaps at most.
RESERVE = 32
SWAPS = 16
_EPS = 1e-9


def word_count(text: str = "text"):
    """Words of a text column; null has none."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """``source, source_size, n_docs, target`` for each source, by water filling.

    Sources rank by code point, null last. ``target = min(most * size, weight * level)``,
    where the level makes the targets add up to all sizes: the sources in the order of
    (most * size) / weight are capped as long as the level that the others would get
    exceeds their own cap level. Works on one row per source.
    """
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (rank % len(weights) + 1).cast("int"))
    per = per.withColumn("weight", weight).withColumn("cap", (F.col("source_size") * most).cast("double"))
    ordered = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    all_rows = ordered.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = ordered.rowsBetween(Window.unboundedPreceding, -1)
    rest_cap = F.sum("source_size").over(all_rows).cast("double") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    rest_weight = F.sum("weight").over(all_rows) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    per = per.withColumn("level", rest_cap / rest_weight).withColumn("capped", F.col("level") * F.col("weight") >= F.col("cap"))
    # capped sources form a prefix of the order; the first source behind them has the common level, the largest of the rest
    common = F.max(F.when(~F.col("capped"), F.col("level"))).over(all_rows)
    target = F.when(F.col("capped"), F.col("cap")).otherwise(F.col("weight") * common)
    return per.select("source", "source_size", "n_docs", target.alias("target"))


def _null_vector(size: np.ndarray) -> np.ndarray:
    """A vector u of three entries with sum(u) = 0 and sum(u * size) = 0."""
    a, b, c = size
    u = np.array([b - c, c - a, a - b], dtype=float)
    return u if u.any() else np.array([1.0, -1.0, 0.0])


def flight(prob: np.ndarray, size: np.ndarray, draw: np.ndarray) -> np.ndarray:
    """Move ``prob`` until at most two entries lie strictly between 0 and 1.

    Each step takes three open entries, moves along the null vector of the two
    constraints to one of the two faces of the cube, with the chances that keep the
    expected probabilities, and closes at least one entry. Linear in the entries.
    """
    prob = prob.astype(float).copy()
    hand: list[int] = []
    step = 0
    for i in range(len(prob)):
        if _EPS < prob[i] < 1 - _EPS:
            hand.append(i)
        else:
            prob[i] = round(prob[i])
        while len(hand) == 3:
            p = prob[hand]
            u = _null_vector(size[hand])
            prob[hand] = _move(p, u, draw[step % len(draw)])
            step += 1
            hand = [j for j in hand if _EPS < prob[j] < 1 - _EPS]
    return np.where(prob < _EPS, 0.0, np.where(prob > 1 - _EPS, 1.0, prob))


def _move(p: np.ndarray, u: np.ndarray, draw: float) -> np.ndarray:
    with np.errstate(divide="ignore", invalid="ignore"):
        up = np.min(np.where(u > 0, (1 - p) / u, np.where(u < 0, -p / u, np.inf)))
        down = np.min(np.where(u > 0, p / u, np.where(u < 0, (p - 1) / u, np.inf)))
    out = p + up * u if draw < down / (up + down) else p - down * u
    out[out < _EPS] = 0.0
    out[out > 1 - _EPS] = 1.0
    return out


def landing(prob: np.ndarray, size: np.ndarray, draw: np.ndarray) -> np.ndarray:
    """Close the last entries: first keeping the tokens, then with a plain draw."""
    prob = prob.copy()
    step = 0
    while len(open_ := np.flatnonzero((prob > 0) & (prob < 1))) > 1:
        i, j = open_[:2]
        u = np.array([size[j], -size[i]], dtype=float)
        if not u.all():
            u = np.array([1.0, 0.0]) if not size[i] else np.array([0.0, 1.0])
        prob[[i, j]] = _move(prob[[i, j]], u, draw[step % len(draw)])
        step += 1
    for i in np.flatnonzero((prob > 0) & (prob < 1)):
        prob[i] = float(draw[(step + 1) % len(draw)] < prob[i])
    return prob


def _draws(key: np.ndarray) -> np.ndarray:
    """Uniform numbers in [0, 1) from the documents' hashes."""
    return (mix_bits(key.astype(np.uint64)) >> np.uint64(11)).astype(float) / float(1 << 53)


def repair(prob: np.ndarray, size: np.ndarray, free: np.ndarray, miss: float) -> np.ndarray:
    """Swap a taken document for one that is not, the best pair each time, as long as the miss (tokens wanted less tokens
    taken) shrinks: the number of documents stays as the flight and the landing left it."""
    prob = prob.copy()
    for _ in range(SWAPS):
        taken, left = np.flatnonzero(free & (prob > 0.5)), np.flatnonzero(free & (prob < 0.5))
        if not len(taken) or not len(left):
            break
        left = left[np.argsort(size[left], kind="stable")]
        at = np.searchsorted(size[left], size[taken] + miss)
        near = np.stack([np.maximum(at - 1, 0), np.minimum(at, len(left) - 1)])
        after = np.abs(miss - (size[left[near]] - size[taken]))
        side, i = np.unravel_index(int(np.argmin(after)), after.shape)
        if not after[side, i] < abs(miss):
            break
        x, y = taken[i], left[near[side, i]]
        prob[x], prob[y], miss = 0.0, 1.0, miss - (size[y] - size[x])
    return prob


def _block(last: bool, reserve: int):
    def run(rows: pa.Table) -> pa.Table:
        key, size = rows.column("__key").to_numpy(), rows.column("size").to_numpy().astype(float)
        order = np.lexsort((size, key))
        draw, size = _draws(key[order]), size[order]
        free = rows.column("__free").to_numpy(zero_copy_only=False)[order]
        before = rows.column("prob").to_numpy()[order]
        prob = flight(before, size, draw)
        if last:
            prob = landing(prob, size, draw[::-1])
            prob = repair(prob, size, free, float(((before - prob) * size).sum()))
            passed = np.zeros(len(prob), bool)
        else:
            passed = (prob > 0) & (prob < 1)
            passed[np.flatnonzero(free & ~passed)[:reserve]] = True
        out, on = np.empty_like(prob), np.empty_like(passed)
        out[order], on[order] = prob, passed
        rows = rows.set_column(rows.schema.get_field_index("prob"), "prob", pa.array(out))
        return rows.set_column(rows.schema.get_field_index("__passed"), "__passed", pa.array(on))

    return run


def _levels(largest: int, block_rows: int, reserve: int) -> int:
    """Levels of the flight, so that the last has one block for the largest source."""
    levels, blocks = 1, -(-largest // block_rows)
    while blocks > 1:
        levels, blocks = levels + 1, -(-(reserve + 2) * blocks // block_rows)
    return levels


def mix(
    docs: DataFrame, seed: int = 17, block_rows: int = BLOCK_ROWS, weights: tuple[int, ...] = WEIGHTS, most: int = MOST
) -> DataFrame:
    """``doc_id, source, size, source_size, target, copies, taken`` for every row of ``docs``.

    A document without words has size 0 and is taken 0 words; a null source is a source
    of its own, last in order; repeated rows are sampled one by one; a table without
    words takes nothing (targets 0). Other columns are ignored. ``__key`` is the
    document's hash, for joining back.
    """
    reserve = block_rows // RESERVE
    sized = saved(docs.select("doc_id", "source", word_count().alias("size"), document_key(seed).alias("__key")))
    targets = saved(source_targets(sized, weights, most))
    largest = targets.agg(F.max("n_docs")).first()[0] or 0
    rate = F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(float(most)))).otherwise(0.0)
    state = (
        sized.join(F.broadcast(targets.withColumnRenamed("source", "__source")), F.col("source").eqNullSafe(F.col("__source")))
        .withColumn("__whole", F.floor(rate + _EPS).cast("double"))
        .withColumn("prob", F.when(F.col("size") > 0, F.greatest(F.lit(0.0), rate - F.col("__whole"))).otherwise(0.0))
        .withColumn("__blocks", F.ceil(F.col("n_docs") / block_rows).cast("long"))
        .withColumns({"__free": (F.col("prob") > 0) & (F.col("prob") < 1), "__passed": F.lit(True)})
        .select("doc_id", "source", "size", "source_size", "target", "__key", "__whole", "prob", "__free", "__passed", "__blocks")
    )
    closed, levels = [], _levels(largest, block_rows, reserve)
    for level in range(levels):
        state = state.withColumn("__block", F.pmod(F.xxhash64("__key", F.lit(level)), F.col("__blocks")))
        state = saved(state.groupBy("source", "__block").applyInArrow(_block(level == levels - 1, reserve), state.schema))
        state = state.drop("__block").withColumn("__blocks", F.ceil(F.col("__blocks") * (reserve + 2) / block_rows).cast("long"))
        closed.append(state.where(~F.col("__passed")))
        state = state.where("__passed")
    every = reduce(DataFrame.unionByName, closed)
    copies = F.when(F.col("size") > 0, F.col("__whole") + F.col("prob")).otherwise(0.0).cast("long")
    return every.select(
        "doc_id", "source", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"), "__key"
    )


def document_key(seed: int):
    """A hash of id, text and source; a null in any of them is told from every value."""
    values = [F.coalesce("doc_id", F.lit(-1)), F.coalesce("text", F.lit("")), F.coalesce("source", F.lit("")), F.lit(seed)]
    missing = [F.col(c).isNull() for c in ("doc_id", "text", "source")]
    return F.when(missing[0] | missing[1] | missing[2], F.xxhash64(*missing, *values)).otherwise(F.xxhash64(*values))


def mixed_documents(docs: DataFrame, seed: int = 17) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it (documents without words: never); the columns of ``docs``.

    Rows that agree in id, text and source share their copies: as even as possible, any order.
    """
    p = prefix(docs)
    key, copies, rows, place, times = (f"{p}{x}" for x in ("key", "copies", "rows", "place", "times"))
    taken = mix(docs, seed).groupBy("__key").agg(F.sum("copies"), F.count(F.lit(1))).toDF(key, copies, rows)
    same = Window.partitionBy(key).orderBy(F.monotonically_increasing_id())
    keyed = docs.withColumn(key, document_key(seed)).join(taken.where(F.col(copies) > 0), key)
    share = F.floor(F.col(copies) / F.col(rows)) + F.when(F.col(place) <= F.col(copies) % F.col(rows), 1).otherwise(0)
    single = keyed.where(F.col(rows) == 1).withColumn(times, F.col(copies))
    several = keyed.where(F.col(rows) > 1).withColumn(place, F.row_number().over(same)).withColumn(times, share).drop(place)
    taken_rows = single.unionByName(several).where(F.col(times) > 0)
    return taken_rows.withColumn(place, F.explode(F.sequence(F.lit(1).cast("long"), F.col(times).cast("long")))).select(*docs.columns)
