"""Sharding: a reproducible shuffle with computable shard and slot.

Rows are numbered 0..N-1 in the order of (id, content checksum, size). A keyed
Feistel network over Z_a x Z_b, where a = ceil(sqrt(N)) and b = ceil(N / a), permutes
the numbers; a value that falls outside 0..N-1 is encrypted again until it falls
inside (cycle walking), so the result is a permutation of 0..N-1. Shard and slot are
the remainder and quotient of the permuted number by the shard count: shard sizes
differ by one row at most, and any row's place follows from its number, N and the keys.

All work is DataFrame functions. Numbering takes one range shuffle of (id, size,
checksum), never of texts: the sorted ids are saved, counted by partition, and
each partition's offset (one row per partition) is broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import partitions, saved

DEFAULT_KEYS = (1013904242, 461845907, 1390208809, 943276693)
#: At most a - 1 values lie outside 0..N-1. Up to N = 4096 a walk thus ends within 64 steps;
#: beyond, a step stays outside with a chance below 1/64, so 64 steps fail one time in 2**384.
WALK_STEPS = 64


def _round(value: Column, key: int) -> Column:
    """The round function: small modular products that any SQL engine repeats exactly."""
    x = (value * F.lit(1103515) + F.lit(key)) % F.lit(2147483647)
    x = (x * F.lit(48271) + F.lit(12345)) % F.lit(2147483647)
    return F.floor(x / F.lit(64)).cast("long")


def _encrypt(value: Column, a: Column, b: Column, keys: tuple[int, ...]) -> Column:
    left, right = F.floor(value / b).cast("long"), value % b
    for i, key in enumerate(keys):
        if i % 2 == 0:
            left = (left + _round(right, key)) % a
        else:
            right = (right + _round(left, key)) % b
    return left * b + right


def feistel(number: Column, total: Column, keys: tuple[int, ...] = DEFAULT_KEYS) -> Column:
    """The permuted number, in 0..total-1; the walk is only evaluated for rows that need it."""
    a = F.ceil(F.sqrt(total.cast("double"))).cast("long")
    b = F.ceil(total / a).cast("long")
    first = _encrypt(number, a, b, keys)
    walked = F.aggregate(
        F.sequence(F.lit(2), F.lit(WALK_STEPS)), first, lambda v, _: F.when(v < total, v).otherwise(_encrypt(v, a, b, keys))
    )
    return F.when(first < total, first).when(walked < total, walked).otherwise(F.raise_error(F.lit("cycle walk did not end")).cast("long"))


def number_rows(df: DataFrame, order: list[str], name: str = "row_number") -> DataFrame:
    """``df`` with a gapless global number from 0 in the order of ``order`` (ties: any order), and ``__total`` rows.

    One range shuffle; the sorted partitions are saved so that counts and numbers
    come from the same rows whatever is recomputed.
    """
    held = saved(
        df.repartitionByRange(partitions(df.sparkSession), *[F.col(c) for c in order]).withColumn("__part", F.spark_partition_id())
    )
    counts = held.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"))
    below, everywhere = Window.orderBy("__part"), Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    offsets = counts.select(
        "__part", (F.sum("__n").over(below) - F.col("__n")).alias("__offset"), F.sum("__n").over(everywhere).alias("__total")
    )
    within = Window.partitionBy("__part").orderBy(*order)
    return (
        held.join(F.broadcast(offsets), "__part")
        .withColumn(name, F.col("__offset") + F.row_number().over(within) - F.lit(1))
        .drop("__part", "__offset")
    )


def shard_rows(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = 24, keys: tuple[int, ...] = DEFAULT_KEYS
) -> DataFrame:
    """``doc_id, size, text_crc32, row_number, position, shard, slot`` for every row.

    size: UTF-8 bytes of the text plus 8 (null text: no bytes, checksum of the empty
    string). Equal rows get neighbouring numbers in any order, and null ids come
    first. An empty table gives an empty result; other columns are ignored.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    slim = docs.select(
        F.col(id_col).alias("doc_id"),
        (F.octet_length(text) + F.lit(8)).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
    )
    numbered = number_rows(slim, ["doc_id", "text_crc32", "size"])
    placed = numbered.withColumn("position", feistel(F.col("row_number"), F.col("__total"), keys))
    return placed.select(
        "doc_id", "size", "text_crc32", "row_number", "position",
        (F.col("position") % shards).cast("int").alias("shard"),
        F.floor(F.col("position") / shards).cast("long").alias("slot"),
    )
