"""Pixel operators against plain loops on small images, with tiles smaller than the images and with missing pixels."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from framelake.operators import raster


def image_rows(seed, images=3, h=13, w=17, missing=0.1):
    rng = random.Random(seed)
    return [(i, r, c, float(rng.randint(0, 8)) * 32 - (rng.random() < 0.2)) for i in range(images) for r in range(h) for c in range(w) if rng.random() >= missing]


def frame(spark, rows):
    return spark.createDataFrame(rows, "image long, row long, col long, v double").repartition(5)


@pytest.mark.parametrize("tile", [1, 4, 256])
def test_laplacian(spark, tile):
    rows = image_rows(1)
    at = {r[:3]: r[3] for r in rows}

    def side(key, dr, dc):
        i, r, c = key
        return at.get((i, r + dr, c + dc), at.get((i, r - dr, c - dc), at[key]))

    want = {k: sum(side(k, dr, dc) for dr, dc in ((1, 0), (-1, 0), (0, 1), (0, -1))) - 4 * v for k, v in at.items()}
    found = raster.laplacian(frame(spark, rows), "v", tile).collect()
    assert {(r.image, r.row, r.col): r.laplacian for r in found} == want and len(found) == len(want)
    quality = {r.image: r for r in raster.frame_quality(frame(spark, rows), "v", tile).collect()}
    for i in range(3):
        own = np.array([v for k, v in want.items() if k[0] == i])
        grey = np.array([v for k, v in at.items() if k[0] == i]) / 255
        assert quality[i].sharpness == pytest.approx(own.var()) and quality[i].exposure == pytest.approx(np.exp(-(((grey.mean() - 0.5) / 0.28) ** 2)))
        assert quality[i].resolution == pytest.approx(np.log1p(len(own)))


def brute_blobs(points):
    left, out = set(points), []
    while left:
        seed = left.pop()
        blob, stack = [seed], [seed]
        while stack:
            i, r, c = stack.pop()
            for q in [(i, r + a, c + b) for a in (-1, 0, 1) for b in (-1, 0, 1)]:
                if q in left:
                    left.remove(q)
                    blob.append(q)
                    stack.append(q)
        out.append((blob[0][0], min(p[1:] for p in blob), len(blob), min(p[1] for p in blob), max(p[1] for p in blob), min(p[2] for p in blob), max(p[2] for p in blob)))
    return sorted(out)


@pytest.mark.parametrize("share", [0.15, 0.4, 0.6])
def test_blobs(spark, share):
    rng = random.Random(int(share * 100))
    rows = [(i, r, c, float(rng.random() < share)) for i in range(3) for r in range(14) for c in range(19)]
    rows += [(9, r, c, float(r % 4 == 0 or (c == 0 and r % 8 < 4) or (c == 20 and r % 8 >= 4))) for r in range(25) for c in range(21)]  # a winding path
    rows += [(10, 3, 3, 0.0)]
    got = raster.blobs(frame(spark, rows), F.col("v") == 1).collect()
    want = brute_blobs([r[:3] for r in rows if r[3] == 1])
    assert sorted((b.image, (b.row, b.col), b.area, b.top, b.bottom, b.left, b.right) for b in got) == want
    scores = {r.image: r for r in raster.clipping_blobs(frame(spark, rows).withColumn("v", F.col("v") * 255 + 1 - F.col("v")), ["v"], 0.02).collect()}
    assert scores[9].blob_fraction == pytest.approx(max(b[2] for b in want if b[0] == 9) / (25 * 21)) and scores[9].flagged
    assert (scores[10].score, scores[10].flagged) == (0.0, False)
    assert raster.blobs(frame(spark, rows), F.lit(False)).count() == 0


def test_palette_and_dominant_colours(spark):
    rng = random.Random(5)
    centres = [(20, 30, 40), (200, 40, 90), (120, 220, 10)]
    rows = [(i, k, *[min(255, max(0, x + rng.randint(-6, 6))) for x in centres[k % 3]]) for i in (0, 1) for k in range(300 + i)] + [(2, 0, 255, 255, 255), (2, 1, None, 1, 1)]
    df = spark.createDataFrame(rows, "image long, k long, r int, g int, b int").repartition(3)
    found = raster.palette(df, ["r", "g", "b"], k=3, cells=4, rounds=6)
    for i in (0, 1):
        own = sorted((r.r, r.g, r.b) for r in found.where(f"image = {i}").collect())
        assert all(abs(a - b) < 3 for x, y in zip(own, sorted(centres), strict=True) for a, b in zip(x, y, strict=True))
    assert [(r.weight, r.r) for r in found.where("image = 2").collect()] == [(1.0, 255.0)]
    top = raster.dominant_colours(df, ["r", "g", "b"], k=2).where("image = 2").collect()
    assert [(r["rank"], r.n, r.r, r.g, r.b) for r in top] == [(1, 1, 224, 224, 224)]


def test_palette_moves_cells_once(spark, monkeypatch):
    from framelake import storage

    steps = []
    monkeypatch.setattr(raster, "saved", lambda d: steps.append(1) or storage.saved(d))
    df = spark.createDataFrame([(i, 9.0 * j, 7.0 * (j % 5), 3.0 * j) for i in range(3) for j in range(25)], "image long, r double, g double, b double").repartition(3)
    found = raster.palette(df, ["r", "g", "b"], k=3, cells=16, rounds=5)
    assert len(steps) == 1 and found.groupBy("image").agg(F.sum("weight").alias("w")).where("w = 25").count() == 3
    away = spark.createDataFrame([(1.0, 2.0, 3.0), (2.0, 1.0000004, 1.0), (5.0, 4.0, 4.0), (3.0, 2.0, 1.9999), (None, None, 1.0)], "a double, b double, c double")
    assert [r[0] for r in away.select(raster._nearest([F.col(c) for c in "abc"])).collect()] == [0, 1, 1, 2, 2]


@pytest.mark.parametrize("angle", [0.3, 2.0, 4.4])
def test_light_plane(spark, angle):
    h, w = 24, 30
    ux, uy = np.cos(angle), np.sin(angle)
    value = lambda r, c: 0.5 + 0.2 * (ux * (c - (w - 1) / 2) / (w / 2) + uy * (r - (h - 1) / 2) / (h / 2))
    rows = [(0, r, c, float(value(r, c))) for r in range(h) for c in range(w)] + [(1, r, c, 0.5) for r in range(h) for c in range(w)] + [(2, 0, 0, 0.1)]
    got = {r.image: r for r in raster.light_plane(frame(spark, rows), "v").collect()}
    assert (got[0].dx, got[0].dy) == pytest.approx((ux, uy), abs=1e-6) and got[0].confidence == pytest.approx(0.45 * 0.45)
    assert [(got[i].dx, got[i].confidence) for i in (1, 2)] == [(None, 0.0)] * 2


def test_dither_keeps_the_mean_and_does_not_follow_tiles(spark):
    df = spark.range(64 * 64).select(F.lit(3).alias("image"), F.floor(F.col("id") / 64).alias("row"), (F.col("id") % 64).alias("col"))
    noise = raster.dither_noise(F.col("image"), F.col("row"), F.col("col"))
    for v in (0.0, 0.3137, 0.5, 1.0):
        mean = df.select(raster.quantised(F.lit(v), noise, 15).alias("q")).agg(F.avg("q")).first()[0]
        assert mean == pytest.approx(v * 15, abs=0.05)
    rows = df.select("row", "col", noise.alias("n")).collect()
    grid = np.zeros((64, 64))
    for r in rows:
        grid[r.row, r.col] = r.n
    assert np.abs(grid).max() <= 0.5 and np.mean(grid[:, 1:] * grid[:, :-1]) < 0  # neighbours differ
