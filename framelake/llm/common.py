"""Small helpers that the operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from ..storage import release, saved

__all__ = ["WORD", "in_tasks", "order_key", "partitions", "prefix", "release", "rows_of", "saved", "squeezed", "table", "text_bytes", "unsqueezed", "with_fields"]

#: A word, as the contracts have it: a run of anything but space and \x09-\x0D.
WORD = r"[^\x20\x09-\x0D]+"


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def in_tasks(rows: DataFrame, n_buckets: int, each: int) -> DataFrame:
    """``rows`` dealt by ``bucket`` to a task for about ``each`` buckets, where that is more tasks than a shuffle has anyway: a task's
    share so stays the same however many buckets there are."""
    n = -(-n_buckets // each)
    return rows.repartition(n, "bucket") if n > partitions(rows.sparkSession) else rows


def text_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column; null is empty."""
    return [x or b"" for x in column.cast(pa.binary() if pa.types.is_string(column.type) else pa.large_binary()).to_pylist()]


def rows_of(batches: Iterable[pa.RecordBatch], limit_bytes: int = 16 << 20) -> Iterator[pa.RecordBatch]:
    """The batches in slices of about ``limit_bytes``, so that what a task holds doesn't follow the batch size."""
    for batch in batches:
        step = max(1, int(batch.num_rows * limit_bytes / max(1, batch.nbytes)))
        for at in range(0, batch.num_rows, step):
            yield batch.slice(at, step)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def order_key(column: str):
    """An id for joins and order: null comes first, as the smallest long."""
    return F.coalesce(F.col(column).cast("long"), F.lit(-(2**63)))


def prefix(df: DataFrame) -> str:
    """A prefix for working columns that no column of ``df`` starts with."""
    found = "__"
    while any(c.startswith(found) for c in df.columns):
        found += "_"
    return found


def with_fields(df: DataFrame, ddl: str) -> StructType:
    """The schema of ``df`` and more fields behind it."""
    return StructType([*df.schema.fields, *StructType.fromDDL(ddl).fields])


def squeezed(df: DataFrame) -> DataFrame:
    """``df`` with ``text`` as zstandard frames (null: of nothing), for a shuffle that moves whole texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=1)
        for batch in rows_of(batches):
            at = batch.schema.get_field_index("text")
            frames = pa.array([press.compress(x) for x in text_bytes(batch.column("text"))], pa.binary())
            yield batch.set_column(at, "text", frames)

    return df.mapInArrow(run, StructType([StructField(f.name, BinaryType()) if f.name == "text" else f for f in df.schema.fields]))


def unsqueezed(column: pa.Array) -> list[bytes]:
    back = zstandard.ZstdDecompressor()
    return [back.decompress(x) if x else b"" for x in column.to_pylist()]
