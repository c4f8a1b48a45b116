"""Images as pixel rows (``image, row, col`` and values): neighbours, sharpness, blobs, palettes, shading planes.

Images may be of any size and lack pixels: work is dealt by tiles with a rim of their neighbours' pixels, by runs, or by mergeable
sums, never by whole images.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import saved
from .graph import connected_components

TILE = 256
SIDES = ("up", "down", "left", "right")
#: Rounds of the palette, and cells a channel.
ROUNDS, CELLS = 4, 16


def neighbours(pixels: DataFrame, value: str, tile: int = TILE) -> DataFrame:
    """``pixels`` (unique ``image, row, col``) with the values ``up, down, left, right`` of each; null where there is no pixel.

    A tile of ``tile`` by ``tile`` pixels is one group of both windows (dealt once), with the pixels that touch it from outside.
    """
    at = {"r": F.floor(F.col("row") / tile), "c": F.floor(F.col("col") / tile)}
    inside = {"r": F.pmod("row", F.lit(tile)), "c": F.pmod("col", F.lit(tile))}
    spot = lambda r, c: F.struct((at["r"] + r).alias("tr"), (at["c"] + c).alias("tc"), F.lit(r == 0 and c == 0).alias("own"))
    rim = [
        F.when(inside["r"] == 0, spot(-1, 0)), F.when(inside["r"] == tile - 1, spot(1, 0)), F.when(inside["c"] == 0, spot(0, -1)), F.when(inside["c"] == tile - 1, spot(0, 1)),
    ]
    dealt = pixels.select("*", F.explode(F.array_compact(F.array(spot(0, 0), *rim))).alias("__t")).select("*", "__t.*").drop("__t")
    dealt = dealt.repartition("image", "tr", "tc")
    across, along = Window.partitionBy("image", "tr", "tc", "row").orderBy("col"), Window.partitionBy("image", "tr", "tc", "col").orderBy("row")
    near = lambda w, order, shift: F.when(F.abs(F.lag(order, shift).over(w) - F.col(order)) == 1, F.lag(value, shift).over(w))
    both = dealt.withColumns({"left": near(across, "col", 1), "right": near(across, "col", -1)}).withColumns({"up": near(along, "row", 1), "down": near(along, "row", -1)})
    return both.where("own").select(*pixels.columns, *SIDES)


def laplacian(pixels: DataFrame, value: str, tile: int = TILE) -> DataFrame:
    """``pixels`` with ``laplacian``, the sum of the four neighbours less four times the value. Beyond an edge, or where a pixel is
    missing, the one opposite counts (if there is none either: the pixel itself)."""
    side = lambda a, b: F.coalesce(a, b, value)
    total = side("up", "down") + side("down", "up") + side("left", "right") + side("right", "left")
    return neighbours(pixels, value, tile).withColumn("laplacian", total - 4 * F.col(value)).drop(*SIDES)


def frame_quality(pixels: DataFrame, value: str, tile: int = TILE) -> DataFrame:
    """Per image, of grey values from 0 to 255: ``sharpness`` (the Laplacian's variance), ``exposure``, shares of clipped lights and shadows,
    their grade ``clipping`` and the logarithmic ``resolution``."""
    level = F.col(value) / 255
    sums = laplacian(pixels, value, tile).groupBy("image").agg(
        F.var_pop("laplacian").alias("sharpness"), F.avg(level).alias("__mean"), F.avg((level >= 0.99).cast("int")).alias("highlight_fraction"),
        F.avg((level <= 0.01).cast("int")).alias("shadow_fraction"), F.count(F.lit(1)).alias("__n"),
    )
    clipped = F.col("highlight_fraction") + F.col("shadow_fraction")
    return sums.select(
        "image", "sharpness", F.exp(-(((F.col("__mean") - 0.5) / 0.28) ** 2)).alias("exposure"), "highlight_fraction", "shadow_fraction",
        F.least(F.greatest(1 - clipped / 0.2, F.lit(0.0)), F.lit(1.0)).alias("clipping"), F.log1p("__n").alias("resolution"),
    )


def runs(pixels: DataFrame, mask: Column) -> DataFrame:
    """``image, row, start, end``: the runs of neighbouring masked pixels of each pixel row."""
    there = pixels.where(mask).select("image", "row", "col")
    island = F.col("col") - F.row_number().over(Window.partitionBy("image", "row").orderBy("col"))
    return there.withColumn("__i", island).groupBy("image", "row", "__i").agg(F.min("col").alias("start"), F.max("col").alias("end")).drop("__i")


def run_links(found: DataFrame) -> DataFrame:
    """``a, b`` (structs of image, row, start): runs of neighbouring rows that touch, corners included, as far as connectedness needs them.

    Runs of a row don't touch one another. So of two that touch across rows, one is the last of its row to begin before the other has
    ended; each run asks for that one in either direction, and links grow with the runs.
    """
    me = F.struct("image", "row", "start").alias("me")
    each = found.select("image", "row", "start", "end", me)
    links = []
    for step in (1, -1):  # who asks: the row below or above
        asked = each.select("image", F.col("row").alias("of"), F.col("start").alias("at"), F.lit(0).alias("ask"), F.struct("me", "end").alias("x"), F.lit(None).cast("long").alias("from"))
        asking = each.select("image", (F.col("row") - step).alias("of"), (F.col("end") + 1).alias("at"), F.lit(1).alias("ask"), F.struct("me", "end").alias("x"), F.col("start").cast("long").alias("from"))
        w = Window.partitionBy("image", "of").orderBy("at", "ask").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        last = F.last(F.when(F.col("ask") == 0, F.col("x")), ignorenulls=True).over(w)
        met = asked.unionByName(asking).withColumn("__last", last).where("ask = 1")
        links.append(met.where(F.col("__last.end") >= F.col("from") - 1).select(F.col("x.me").alias("a"), F.col("__last.me").alias("b")))
    return links[0].unionByName(links[1])


def blobs(pixels: DataFrame, mask: Column) -> DataFrame:
    """``image, row, col`` (the blob's first run), ``area`` and bounds of each blob: connected masked pixels, corners included.

    Rows of pixels become runs, runs of neighbouring rows are linked where they touch, and components are taken over runs.
    """
    found = saved(runs(pixels, mask))
    labels = connected_components(run_links(found), "a", "b")
    named = found.withColumn("node", F.struct("image", "row", "start")).join(labels.dropDuplicates(["node"]), "node", "left")
    blob = F.coalesce("component", "node")
    out = named.groupBy(blob.alias("blob")).agg(
        F.sum(F.col("end") - F.col("start") + 1).alias("area"), F.min("row").alias("top"), F.max("row").alias("bottom"), F.min("start").alias("left"), F.max("end").alias("right")
    )
    return out.select(F.col("blob.image").alias("image"), F.col("blob.row").alias("row"), F.col("blob.start").alias("col"), "area", "top", "bottom", "left", "right")


def clipping_blobs(pixels: DataFrame, channels: list[str], threshold: float, least_side: int = 8) -> DataFrame:
    """Per image: share of pixels with a channel at 0 or 255, share of the largest blob of such pixels, their larger one as ``score``, and whether the
    blob's share is over ``threshold``. Images under ``least_side`` rows or columns score 0."""
    clipped = F.lit(False)
    for c in channels:
        clipped = clipped | (F.col(c) == 0) | (F.col(c) == 255)
    kept = pixels.select("image", "row", "col", clipped.alias("clipped"))
    size = kept.groupBy("image").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("clipped").alias("n_clipped"), F.max("row").alias("h0"), F.min("row").alias("h1"), F.max("col").alias("w0"), F.min("col").alias("w1")
    )
    largest = blobs(kept, F.col("clipped")).groupBy("image").agg(F.max("area").alias("largest"))
    tiny = (F.col("h0") - F.col("h1") + 1 < least_side) | (F.col("w0") - F.col("w1") + 1 < least_side)
    share = lambda c: F.when(tiny, 0.0).otherwise(F.coalesce(F.col(c), F.lit(0)) / F.col("n"))
    joined = size.join(largest, "image", "left").select("image", share("n_clipped").alias("pixel_fraction"), share("largest").alias("blob_fraction"))
    return joined.select("image", "pixel_fraction", "blob_fraction", F.greatest("pixel_fraction", "blob_fraction").alias("score"), (F.col("blob_fraction") > threshold).alias("flagged"))


def colour_cells(pixels: DataFrame, channels: list[str], cells: int) -> DataFrame:
    """``image, cell, n`` and the channels' sums of each occupied colour cell (``cells`` to a channel, values from 0 to 255)."""
    width = 256 / cells
    part = [F.least(F.greatest(F.floor(F.col(c) / width), F.lit(0)), F.lit(cells - 1)) for c in channels]
    number = part[0]
    for p in part[1:]:
        number = number * cells + p
    there = pixels.dropna(subset=channels)
    return there.groupBy("image", number.cast("int").alias("cell")).agg(F.count(F.lit(1)).alias("n"), *[F.sum(F.col(c).cast("double")).alias(c) for c in channels])


def dominant_colours(pixels: DataFrame, channels: list[str], k: int = 5, bins: int = 4) -> DataFrame:
    """``image, rank, n`` and the centres of the ``k`` fullest of ``bins`` cells a channel (ties: the lower cell)."""
    counts = colour_cells(pixels, channels, bins).select("image", "cell", "n")
    ranked = counts.withColumn("rank", F.row_number().over(Window.partitionBy("image").orderBy(F.desc("n"), "cell"))).where(F.col("rank") <= k)
    width = 256 / bins
    centre = lambda i: F.rint((F.pmod(F.floor(F.col("cell") / bins ** (len(channels) - 1 - i)), F.lit(bins)) + 0.5) * width).cast("int")
    return ranked.select("image", "rank", "n", *[centre(i).alias(c) for i, c in enumerate(channels)])


def palette(pixels: DataFrame, channels: list[str], k: int = 5, cells: int = CELLS, rounds: int = ROUNDS) -> DataFrame:
    """``image, cluster, weight`` and channel means of ``k`` colours an image: weighted k-means over colour cells.

    Pixels are merged into cells once (``cells`` a channel, so at most ``cells`` cubed rows an image); the fullest cells are the first centres
    (ties: the lower cell). Cells are saved by image, and no round moves them again: it reads them beside their centres, one row an image. Cells go to the nearest
    centre (distances rounded to six digits, ties: the lower cluster); a centre without cells stays. Images with fewer cells have fewer colours.
    """
    counts = colour_cells(pixels, channels, cells)
    held = counts.select("image", "cell", "n", *[(F.col(c) / F.col("n")).alias(c) for c in channels])
    held = saved(held.repartition("image").sortWithinPartitions("image"))
    at = F.row_number().over(Window.partitionBy("image").orderBy(F.desc("n"), "cell")) - 1
    centre = [(j, c, f"__{c}_{j}") for j in range(k) for c in channels]
    first = held.withColumn("__at", at).where(F.col("__at") < k).groupBy("image")
    now = first.agg(*[F.max(F.when(F.col("__at") == j, F.col(c))).alias(name) for j, c, name in centre]).withColumns({f"__w_{j}": F.lit(0.0) for j in range(k)})
    for _ in range(rounds):
        met = held.join(now, "image", "right").withColumns({f"__d_{j}": sum(((F.col(f"__{c}_{j}") - F.col(c)) ** 2 for c in channels), F.lit(0.0)) for j in range(k)})
        sums = met.withColumn("cluster", _nearest([F.col(f"__d_{j}") for j in range(k)])).groupBy("image")
        of = lambda j, v: F.sum(F.when(F.col("cluster") == j, v))
        means = [F.coalesce(of(j, F.col("n") * F.col(c)) / of(j, F.col("n")), F.first(name)).alias(name) for j, c, name in centre]
        now = sums.agg(*means, *[F.coalesce(of(j, F.col("n")).cast("double"), F.lit(0.0)).alias(f"__w_{j}") for j in range(k)])
    each = [F.struct(F.lit(j).alias("cluster"), F.col(f"__w_{j}").alias("weight"), *[F.col(f"__{c}_{j}").alias(c) for c in channels]) for j in range(k)]
    return now.select("image", F.explode(F.array(*each)).alias("x")).select("image", "x.*").where(F.col(channels[0]).isNotNull())


def _nearest(away: list[Column]) -> Column:
    """The number of the least distance when rounded to six digits (ties: the first). Rounding is slow and only done where distances are close enough for it to matter."""
    if len(away) == 1:
        return F.lit(0)
    first_at = lambda values, least: F.coalesce(*[F.when(v == least, j) for j, v in enumerate(values)])
    least, exact = F.least(*away), [F.round(v, 6) for v in away]
    near = sum((F.when(v <= least + 2e-6, 1).otherwise(0) for v in away), F.lit(0))
    return F.when(near == 1, first_at(away, least)).otherwise(first_at(exact, F.least(*exact)))


def _determinant(m: list[list[Column]]) -> Column:
    (a, b, c), (d, e, f), (g, h, i) = m
    return a * (e * i - f * h) - b * (d * i - f * g) + c * (d * h - e * g)


def light_plane(pixels: DataFrame, value: str, least_pixels: int = 100) -> DataFrame:
    """``image, dx, dy, confidence``: the direction in which a low-frequency brightness (``value``, 0 to 1) rises over the image's middle ellipse.

    A plane is fitted by least squares from mergeable sums of products, solved as columns; its residuals are measured in a second pass.
    The direction is null (and the confidence 0) with under ``least_pixels`` pixels, without a slope, or where the slope is small against the residuals.
    """
    box = pixels.groupBy("image").agg((F.max("row") + 1).alias("h"), (F.max("col") + 1).alias("w"))
    placed = pixels.where(F.col(value).isNotNull()).join(box, "image")
    cx, cy = F.col("col") - (F.col("w") - 1) / 2, F.col("row") - (F.col("h") - 1) / 2
    one = F.lit(1.0)
    inside = (cx / F.greatest(F.col("w") * 0.35, one)) ** 2 + (cy / F.greatest(F.col("h") * 0.42, one)) ** 2 <= 1
    placed = placed.where(inside).select("image", (cx / F.greatest(F.col("w") / 2, one)).alias("x"), (cy / F.greatest(F.col("h") / 2, one)).alias("y"), F.col(value).alias("v"))
    products = {"sx": "x", "sy": "y", "sxx": "x * x", "sxy": "x * y", "syy": "y * y", "sxv": "x * v", "syv": "y * v", "sv": "v"}
    sums = placed.groupBy("image").agg(F.count(F.lit(1)).cast("double").alias("n"), *[F.sum(F.expr(e)).alias(k) for k, e in products.items()])
    c = {k: F.col(k) for k in ("n", *products)}
    left = [[c["sxx"], c["sxy"], c["sx"]], [c["sxy"], c["syy"], c["sy"]], [c["sx"], c["sy"], c["n"]]]
    right = [c["sxv"], c["syv"], c["sv"]]
    whole = _determinant(left)
    solved = [_determinant([[right[i] if j == k else left[i][j] for j in range(3)] for i in range(3)]) / F.nullif(whole, F.lit(0.0)) for k in range(3)]
    plane = saved(sums.where(F.col("n") >= least_pixels).select("image", *[s.alias(k) for s, k in zip(solved, ("px", "py", "p0"), strict=True)]))
    rest = F.col("v") - (F.col("px") * F.col("x") + F.col("py") * F.col("y") + F.col("p0"))
    residual = placed.join(plane, "image").groupBy("image").agg(F.stddev_pop(rest).alias("residual"))
    slope = F.sqrt(F.col("px") ** 2 + F.col("py") ** 2)
    confidence = F.least(F.lit(0.45), slope / F.greatest(F.col("residual") * 5, F.lit(0.035))) * 0.45
    fitted = plane.join(residual, "image").select("image", "px", "py", slope.alias("slope"), confidence.alias("confidence"))
    sure = (F.col("slope") >= 1e-6) & (F.col("confidence") >= 0.05)
    found = fitted.where(sure).select("image", (F.col("px") / F.col("slope")).alias("dx"), (F.col("py") / F.col("slope")).alias("dy"), "confidence")
    return box.select("image").join(found, "image", "left").withColumn("confidence", F.coalesce("confidence", F.lit(0.0)))


def dither_noise(image: Column, row: Column, col: Column) -> Column:
    """Noise within half a step for a pixel: the same at each run and for each tile of an export, high in frequency (neighbours differ), shifted by the
    image's number so that images don't share it. The three factors are those of interleaved gradient noise (fixed values)."""
    x, y = col + F.pmod(image * 31, F.lit(61)), row + F.pmod(image * 17, F.lit(67))
    inner = x * 0.06711056 + y * 0.00583715
    turned = (inner - F.floor(inner)) * 52.9829189
    return turned - F.floor(turned) - 0.5


def quantised(value: Column, noise: Column, levels: int = 255) -> Column:
    """A value from 0 to 1 as one of ``levels`` + 1 whole levels, dithered by ``noise``."""
    inside = F.least(F.greatest(value, F.lit(0.0)), F.lit(1.0))
    return F.least(F.greatest(F.rint(inside * levels + noise), F.lit(0.0)), F.lit(float(levels))).cast("int")
