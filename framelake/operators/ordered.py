"""Positions and recursions along an order, without a task or a row that holds a whole key."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.folds import scan_with_state
from ..storage import new_folder, release, saved

#: Rows of a key that are folded as one array.
SLICE_ROWS = 65_536


def numbered(df: DataFrame, keys: list[str], order: list[str], name: str = "no") -> DataFrame:
    """``df`` with the position (from 0) of each row among those of its key, in the given order; saved.

    Rows are sorted by ranges over key and order; a position is the one within the range plus the key's rows in the ranges
    before. So a key with most of the rows spreads over ranges. Rows that agree in keys and order are numbered in any order.
    """
    ranges = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    lined = saved(df.repartitionByRange(ranges, *keys, *order).sortWithinPartitions(*keys, *order))
    lined = lined.withColumns({"__range": F.spark_partition_id(), "__at": F.monotonically_increasing_id()})
    each = lined.groupBy(*keys, "__range").agg(F.min("__at").alias("__first"), F.count(F.lit(1)).alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.partitionBy(*keys).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = each.select(*[F.col(k).alias(f"__k_{k}") for k in keys], F.col("__range").alias("__of"), (before - F.col("__first")).alias("__shift"))
    same = [F.col(k).eqNullSafe(F.col(f"__k_{k}")) for k in keys]
    met = lined.join(starts, [F.col("__range") == F.col("__of"), *same])
    return saved(met.withColumn(name, F.col("__at") + F.col("__shift")).select(*df.columns, name))


def sliced(points: DataFrame, key: str, order: list[str], columns: list[str], slice_rows: int = SLICE_ROWS) -> DataFrame:
    """``cut`` of ``points`` in an order."""
    return cut(numbered(points, [key], order), key, columns, slice_rows)


def cut(placed: DataFrame, key: str, columns: list[str], slice_rows: int = SLICE_ROWS) -> DataFrame:
    """``__key, __slice, __rows``: each key's rows (structs of ``no, *columns``) in slices of ``slice_rows``, one array a slice. Written
    to the shared folder, a directory for each number of a slice, so that a reader of one slice reads no other."""
    spark = placed.sparkSession
    row = F.array_sort(F.collect_list(F.struct("no", *columns))).alias("__rows")
    of = F.floor(F.col("no") / slice_rows).cast("int")
    slices = placed.groupBy(F.col(key).alias("__key"), of.alias("__slice")).agg(row).select("__key", "__rows", "__slice")
    at = new_folder(spark, "slices")
    slices.write.partitionBy("__slice").parquet(at)
    return spark.read.schema(slices.schema).parquet(at)


Step = Callable[[Column, Column], tuple[dict[str, Column], Column]]


def folded(slices: DataFrame, start: dict[str, Column], step: Step, kind: str, backward: bool = False) -> DataFrame:
    """``slices`` with ``__out``, the outputs (of SQL type ``kind``) of a recursion along each key's rows; saved.

    ``step`` gives the next state and the output from a state and a row. Slice i of all keys is folded in one round, from the states that
    the round before handed on (the last slice first if ``backward``). A key of any length so takes more rounds, not a larger
    row; a round's slices are tasks of their own.
    """
    last = slices.agg(F.max("__slice")).first()[0] or 0
    first = F.struct(*[v.alias(k) for k, v in start.items()])
    turned = F.reverse if backward else lambda c: c
    done: list[DataFrame] = []
    for i in range(last, -1, -1) if backward else range(last + 1):
        now = slices.where(F.col("__slice") == i)
        if done:
            handed = done[-1].select(F.col("__key").alias("__from"), F.col("__x.state").alias("__state"))
            now = now.join(handed, F.col("__key").eqNullSafe(F.col("__from")), "left").drop("__from")
        else:
            now = now.withColumn("__state", F.lit(None).cast(slices.select(first.alias("s")).schema["s"].dataType))
        state = F.coalesce("__state", first)
        done.append(saved(now.select("__key", "__slice", "__rows", scan_with_state(turned(F.col("__rows")), state, list(start), step, kind).alias("__x"))))
    every = reduce(DataFrame.unionByName, done).select("__key", "__slice", "__rows", turned(F.col("__x.out")).alias("__out"))
    if len(done) == 1:
        return every
    out = saved(every)
    for part in done:
        release(part)
    return out


def walked(placed: DataFrame, key: str, columns: list[str], start: dict[str, Column], step: Step, kind: str, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """``key``, ``columns`` and ``out`` of every row of ``placed`` (with ``no``): ``folded``, row by row."""
    found = folded(cut(placed, key, columns, slice_rows), start, step, kind)
    rows = F.explode(F.zip_with("__rows", "__out", lambda r, y: F.struct(r.alias("r"), y.alias("y")))).alias("x")
    return found.select(F.col("__key").alias(key), rows).select(key, *[F.col(f"x.r.{c}").alias(c) for c in columns], F.col("x.y").alias("out"))
