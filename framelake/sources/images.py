"""Image folders: listing, header probe, capture metadata. Pixels are never decoded here."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

RASTER = ("jpg", "jpeg", "png", "tif", "tiff", "bmp", "webp")
RAW = ("raf", "cr2", "cr3", "nef", "arw", "dng", "orf", "rw2")
HEAD = 64 << 10
#: TIFF tags of the capture record.
TAGS = {0x010F: "make", 0x0110: "model", 0x0132: "DateTime", 0x8769: "exif", 0x9003: "DateTimeOriginal", 0x9004: "DateTimeDigitized", 0x9291: "subsec"}


def listing(spark: SparkSession, folder: str, recursive: bool = True) -> DataFrame:
    """``path, ext, size, modified`` of all files but empty ones, which the reader skips; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(folder)
    return files.select("path", F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).alias("ext"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"))


def input_plan(files: DataFrame, include: str | None = None, exclude: str | None = None, hidden: bool = False) -> DataFrame:
    """``files`` with ``status`` and ``reason``: every path is selected, excluded or rejected for a stated cause."""
    name = F.element_at(F.split("path", "/"), -1)
    reason = F.when(~F.col("ext").isin(*RASTER, *RAW), "unsupported_extension").when(F.col("size") == 0, "empty_file")
    if not hidden:
        reason = reason.when(name.startswith("."), "hidden")
    if exclude:
        reason = reason.when(F.col("path").rlike(exclude), "exclude_pattern")
    if include:
        reason = reason.when(~F.col("path").rlike(include), "not_included")
    status = F.when(F.col("reason").isNull(), "selected").when(F.col("reason").isin("unsupported_extension", "empty_file"), "rejected").otherwise("excluded")
    return files.withColumn("reason", reason).withColumn("status", status)


def path_list(spark: SparkSession, path: str) -> DataFrame:
    """``position, path`` of a list of literal paths, as JSON documents {"version": 1, "inputs": [...]}, one a line.

    A long list is several documents with a ``part`` each (none: 0), in whatever files; positions run on in the order of the parts.
    """
    raw = spark.read.schema("version int, part long, inputs array<string>").json(path).select(F.coalesce("part", F.lit(0)).alias("part"), "inputs")
    sizes = raw.groupBy("part").agg(F.sum(F.size("inputs")).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # one row a document
    starts = sizes.select("part", before.alias("before"))
    each = raw.select("part", F.posexplode("inputs").alias("at", "path"))
    return each.join(starts, "part").select((F.col("before") + F.col("at")).cast("int").alias("position"), "path")


def _png(b: bytes):
    return struct.unpack(">II", b[16:24]) if b[:8] == b"\x89PNG\r\n\x1a\n" and len(b) >= 24 else None


def _jpeg(b: bytes):
    at = 2
    while b[:2] == b"\xff\xd8" and at + 9 < len(b) and b[at] == 0xFF:
        kind, size = b[at + 1], struct.unpack(">H", b[at + 2 : at + 4])[0]
        if 0xC0 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC):
            h, w = struct.unpack(">HH", b[at + 5 : at + 9])
            return w, h
        at += 2 + size
    return None


def _tiff_fields(b: bytes) -> dict[str, str | int]:
    """Capture fields of a TIFF structure; offsets beyond the head are left out."""
    order = {b"II": "<", b"MM": ">"}.get(b[:2])
    out: dict[str, str | int] = {}
    if not order or len(b) < 8:
        return out
    todo, done = [struct.unpack(order + "I", b[4:8])[0]], set()
    while todo:
        at = todo.pop()
        if at in done or at + 2 > len(b):
            continue
        done.add(at)
        for i in range(struct.unpack(order + "H", b[at : at + 2])[0]):
            entry = b[at + 2 + 12 * i : at + 14 + 12 * i]
            if len(entry) < 12:
                break
            tag, kind, n, value = struct.unpack(order + "HHII", entry)
            name = TAGS.get(tag)
            if name == "exif":
                todo.append(value)
            elif name and kind == 2:
                raw = entry[8 : 8 + n] if n <= 4 else b[value : value + n]
                out[name] = raw.split(b"\0")[0].decode("ascii", "replace").strip()
    return out


def _exif(b: bytes) -> dict[str, str | int]:
    if b[:2] in (b"II", b"MM"):
        return _tiff_fields(b)
    at = b.find(b"Exif\0\0", 0, 4096)
    return _tiff_fields(b[at + 6 :]) if at >= 0 else {}


def probe(files: DataFrame) -> DataFrame:
    """``path, width, height, capture_text, capture_source, camera`` from the first 64 KiB of ``content``; nulls where unknown.

    Only these bytes go to Python, but the reader of binary files has each file whole in a task before; fields whose
    place in the file lies beyond them are null."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for path, head in zip(pdf["path"], pdf["head"], strict=True):
                b = bytes(head or b"")
                w, h = _png(b) or _jpeg(b) or (None, None)
                fields = _exif(b)
                source = next((k for k in ("DateTimeOriginal", "DateTimeDigitized", "DateTime") if fields.get(k)), None)
                camera = " ".join(str(fields[k]) for k in ("make", "model") if fields.get(k)) or None
                rows.append((path, w, h, fields.get(source) if source else None, source, camera))
            yield pd.DataFrame(rows, columns=["path", "width", "height", "capture_text", "capture_source", "camera"]).astype({"width": "Int64", "height": "Int64"})

    head = files.select("path", F.substring("content", 1, HEAD).alias("head"))
    return head.mapInPandas(run, "path string, width long, height long, capture_text string, capture_source string, camera string")


def capture_time(text: Column) -> Column:
    """A timestamp without zone of ``YYYY:MM:DD HH:MM:SS``; null if it isn't one."""
    return F.try_to_timestamp(text, F.lit("yyyy:MM:dd HH:mm:ss")).cast("timestamp_ntz")


def decoder_route(ext: Column, deep: Column) -> Column:
    return F.when(ext.isin(*RAW), "raw").when(deep & ext.isin("png", "tif", "tiff"), "16bit").otherwise("8bit")


def output_format(ext: Column, wanted: str) -> Column:
    if wanted != "auto":
        return F.lit(wanted)
    return F.when(ext.isin("jpg", "jpeg"), "jpeg").when(ext.isin("tif", "tiff"), "tiff").when(ext.isin("webp"), "webp").otherwise("png")
