"""Lookup tables, manifests, reports."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ranking import rank_within

#: Edge of the largest lookup cube that is broadcast (65 cubed, three floats: 3.3 MB).
MOST_EDGE = 65


def read_cube(spark: SparkSession, path: str) -> DataFrame:
    """``n, ib, ig, ir, r, g, b`` of a .cube text: red runs fastest. Comments, titles and domains are skipped."""
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", r"\r?\n")).alias("pos", "line"))
    trimmed = lines.select("pos", F.trim("line").alias("line")).where("line != '' and not startswith(line, '#')")
    kind = F.when(F.col("line").startswith("LUT_3D_SIZE"), F.element_at(F.split("line", r"\s+"), -1).cast("int"))
    values = F.when(F.col("line").rlike(r"^[-+0-9.]"), F.transform(F.split("line", r"\s+"), lambda x: x.cast("double")))
    # one text is one row of the source: its lines are gathered again in order
    whole = trimmed.agg(F.max(kind).alias("n"), F.array_sort(F.collect_list(F.struct("pos", values.alias("v")))).alias("d"))
    flat = whole.select("n", F.posexplode(F.filter("d", lambda x: x["v"].isNotNull())).alias("i", "x"))
    i, size = F.col("i"), F.col("n")
    return flat.select(
        "n", F.floor(i / (size * size)).cast("int").alias("ib"), F.floor(i / size % size).cast("int").alias("ig"), (i % size).cast("int").alias("ir"),
        *[F.col("x.v")[k].alias(c) for k, c in enumerate("rgb")],
    )


def cube_array(lut: DataFrame) -> np.ndarray:
    """The cube [b, g, r, 3] of a table whose edge is checked to be small enough to broadcast."""
    n = lut.agg(F.max("n")).first()[0]
    if n is None or n > MOST_EDGE:
        raise ValueError(f"cube edge {n}, at most {MOST_EDGE}")
    out = np.zeros((n, n, n, 3))
    for row in lut.collect():
        out[row["ib"], row["ig"], row["ir"]] = row["r"], row["g"], row["b"]
    return out


def trilinear(cube: np.ndarray, rgb: np.ndarray) -> np.ndarray:
    """Interpolated values of rgb rows in 0..1."""
    n = len(cube)
    at = np.clip(rgb, 0, 1) * (n - 1)
    low = np.minimum(at.astype(int), n - 2) if n > 1 else np.zeros_like(at, int)
    f = at - low
    out = np.zeros_like(rgb, dtype=float)
    for dr in (0, 1):
        for dg in (0, 1):
            for db in (0, 1):
                w = np.prod(np.where([dr, dg, db], f, 1 - f), axis=1)
                r, g, b = (np.minimum(low[:, k] + d, n - 1) for k, d in enumerate((dr, dg, db)))
                out += w[:, None] * cube[b, g, r]
    return out


def apply_lut(pixels: DataFrame, cube: np.ndarray, strength: float = 1.0) -> DataFrame:
    """``pixels`` with r, g, b through the cube, blended with the original by ``strength``."""
    shared = pixels.sparkSession.sparkContext.broadcast(cube)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rgb = np.column_stack([batch.column(c).to_numpy(zero_copy_only=False).astype(float) for c in "rgb"])
            graded = rgb + strength * (trilinear(shared.value, rgb) - rgb)
            for k, c in enumerate("rgb"):
                batch = batch.set_column(batch.schema.get_field_index(c), c, pa.array(graded[:, k]))
            yield batch

    return pixels.withColumns({c: F.col(c).cast("double") for c in "rgb"}).mapInArrow(run, pixels.withColumns({c: F.col(c).cast("double") for c in "rgb"}).schema)


def manifest(runs: DataFrame, run: str, status: str, path: str) -> DataFrame:
    """One JSON document per run: counts by status and the files, sorted by path."""
    counts = runs.groupBy(run, status).agg(F.count(F.lit(1)).alias("n")).groupBy(run).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(status, "n")))).alias("counts"))
    files = runs.groupBy(run).agg(F.array_sort(F.collect_list(F.struct(F.col(path).alias("path"), F.col(status).alias("status")))).alias("files"))
    return counts.join(files, run).select(run, F.to_json(F.struct(F.lit(2).alias("schema"), "counts", "files")).alias("document"))


def review_rows(assets: DataFrame, labels: str, evidence: Column) -> DataFrame:
    """Review export: lists joined with semicolons, evidence as JSON."""
    return assets.withColumns({labels: F.concat_ws(";", labels), "evidence": F.to_json(evidence)})


def edit_report(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Each row as a JSON document with sorted keys and the document's digest."""
    document = F.to_json(F.struct(*sorted(columns)))
    return rows.withColumn("document", document).withColumn("digest", F.sha2(document, 256))


def contact_sheet(images: DataFrame, order: str, columns: int, cell: int) -> DataFrame:
    """Place of each thumbnail on the sheet of its set (``set_id``), in ascending order of a number."""
    placed = rank_within(images, ["set_id"], order, order, "__n", descending=False)
    n = F.col("__n") - 1
    return placed.withColumns({"x": (n % columns) * cell, "y": F.floor(n / columns).cast("int") * cell}).drop("__n")
