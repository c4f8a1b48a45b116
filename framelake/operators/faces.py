"""Boxes of faces and crops; pairing them between two frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.folds import scan


def overlap(a: tuple[Column, ...], b: tuple[Column, ...]) -> Column:
    """Area that two boxes (x, y, width, height) share."""
    (ax, ay, aw, ah), (bx, by, bw, bh) = a, b
    across = F.least(ax + aw, bx + bw) - F.greatest(ax, bx)
    down = F.least(ay + ah, by + bh) - F.greatest(ay, by)
    return F.greatest(across, F.lit(0.0)) * F.greatest(down, F.lit(0.0))


def iou(a: tuple[Column, ...], b: tuple[Column, ...]) -> Column:
    """Shared area over joint area; 0 for empty boxes."""
    shared = overlap(a, b)
    return F.coalesce(F.try_divide(shared, a[2] * a[3] + b[2] * b[3] - shared), F.lit(0.0))


def subject_faces(faces: DataFrame, image: str, width: str, height: str, share: float = 0.35) -> DataFrame:
    """The largest face of each image and those of comparable size; faces without area are none."""
    area = F.col(width) * F.col(height)
    largest = F.max(area).over(Window.partitionBy(image))
    return faces.where((F.col(width) > 0) & (F.col(height) > 0)).withColumn("__largest", largest).where(area >= share * F.col("__largest")).drop("__largest")


def kept_share(boxes: DataFrame, image: str, box: tuple[str, ...], crop: tuple[str, ...]) -> DataFrame:
    """``image, kept``: share of the boxes' area that the image's crop keeps; null where there is none."""
    b, c = tuple(map(F.col, box)), tuple(map(F.col, crop))
    area = F.greatest(b[2], F.lit(0.0)) * F.greatest(b[3], F.lit(0.0))
    return boxes.groupBy(image).agg(F.try_divide(F.sum(overlap(b, c)), F.sum(area)).alias("kept"))


def matched_faces(left: DataFrame, right: DataFrame, image: str, box: tuple[str, ...], order: str, least: float = 0.3) -> DataFrame:
    """``image, left, right``: faces of two renders paired one to one. In order, each left face takes the free right face that it overlaps
    best, with at least ``least`` (ties: the last); null where none is left.

    An image's faces are few; they are folded as one array within the JVM.
    """
    shape = F.struct(F.col(order).alias("k"), *[F.col(c).cast("double").alias(n) for c, n in zip(box, "xywh", strict=True)])
    listed = lambda d, n: d.groupBy(image).agg(F.array_sort(F.collect_list(shape)).alias(n))
    both = listed(left, "l").join(listed(right, "r"), image, "left").withColumn("r", F.coalesce("r", F.filter("l", lambda _: F.lit(False))))
    sides = lambda s: tuple(s[c] for c in "xywh")

    def step(state: Column, face: Column) -> Column:
        scored = F.transform(state["free"], lambda r, i: F.struct(iou(sides(face), sides(r)).alias("s"), i.alias("i"), r["k"].alias("k")))
        best = F.array_max(F.filter(scored, lambda x: x["s"] >= least))
        free = F.when(best.isNull(), state["free"]).otherwise(F.filter(state["free"], lambda r: r["k"] != best["k"]))
        return F.struct(free.alias("free"), F.concat(state["found"], F.array(F.struct(face["k"].alias("left"), best["k"].alias("right")))).alias("found"))

    kinds = left.schema[order].dataType.simpleString(), right.schema[order].dataType.simpleString()
    start = F.struct(F.col("r").alias("free"), F.array().cast(f"array<struct<left:{kinds[0]},right:{kinds[1]}>>").alias("found"))
    pairs = both.select(image, F.explode(F.aggregate("l", start, step, lambda z: z["found"])).alias("x"))
    return pairs.select(image, "x.left", "x.right")


def window_union(frames: DataFrame, keys: list[str], box: tuple[str, ...]) -> DataFrame:
    """The smallest box around all boxes of a shot: ``x, y, w, h``."""
    x, y, w, h = map(F.col, box)
    around = frames.groupBy(*keys).agg(F.min(x).alias("x"), F.min(y).alias("y"), F.max(x + w).alias("__r"), F.max(y + h).alias("__b"))
    return around.select(*keys, "x", "y", (F.col("__r") - F.col("x")).alias("w"), (F.col("__b") - F.col("y")).alias("h"))


def track_baseline(frames: DataFrame, track: list[str], aperture: str) -> Column:
    """The widest aperture of a track that was seen twice at least; else null."""
    w = Window.partitionBy(*track)
    return F.when(F.count(aperture).over(w) >= 2, F.max(aperture).over(w))


def hsv_means(pixels: DataFrame, image: str, saturation: str, value: str, mask: str, least: int = 20) -> DataFrame:
    """Mean saturation and value over the masked pixels (mask over 0.1), or over all where they are ``least`` or fewer."""
    inside = F.col(mask) > 0.1
    few = F.count(F.when(inside, 1)) <= least
    mean = lambda c: F.when(few, F.avg(c)).otherwise(F.avg(F.when(inside, F.col(c))))
    return pixels.groupBy(image).agg(mean(saturation).alias("mean_s"), mean(value).alias("mean_v"))


def look_board(looks: DataFrame, board: str, weight: str, values: list[str]) -> DataFrame:
    """Weighted mean of each value over the references of a board; weights below zero count as none."""
    w = F.greatest(F.col(weight), F.lit(0.0))
    return looks.groupBy(board).agg(*[F.try_divide(F.sum(w * F.col(v)), F.sum(F.when(F.col(v).isNotNull(), w))).alias(v) for v in values])


def combined_mask(masks: list[Column], mode: str) -> Column:
    """Soft masks (0..1) together: union is the largest, intersection the product, difference the first less the others."""
    first, *rest = masks
    for m in rest:
        first = {"union": F.greatest(first, m), "intersection": first * m, "difference": first * (1 - m)}[mode]
    return first


def temporal_report(pairs: DataFrame, clip: list[str], frame: str, before: str, after: str) -> DataFrame:
    """``n, coverage, mean_change, p95_change, added_flicker`` of each clip: frames that were rendered, the change that the render makes, and
    how much more its neighbouring frames differ than the source's; frames that don't follow on one another are not compared."""
    w = Window.partitionBy(*clip).orderBy(frame)
    follows = F.col(frame) - F.lag(frame).over(w) == 1
    moved = lambda c: F.when(follows, F.abs(F.col(c) - F.lag(c).over(w)))
    steps = pairs.withColumns({"__change": F.abs(F.col(after) - F.col(before)), "__a": moved(after), "__b": moved(before)})
    return steps.groupBy(*clip).agg(
        F.count(F.lit(1)).alias("n"), (F.count(after) / F.count(F.lit(1))).alias("coverage"), F.avg("__change").alias("mean_change"),
        F.percentile("__change", F.lit(0.95)).alias("p95_change"), (F.avg("__a") - F.avg("__b")).alias("added_flicker"),
    )


def bound_faces(anchors: DataFrame, faces: DataFrame, image: str, box: tuple[str, ...], order: str, least: float = 0.3) -> DataFrame:
    """``image, anchor, face, iou``: settings anchored to boxes go to the faces found, one to one, the best overlap first (ties: the larger
    numbers); anchors that overlap none by ``least`` have a null face. An image's boxes are few."""
    shape = F.struct(F.col(order).alias("k"), *[F.col(c).cast("double").alias(n) for c, n in zip(box, "xywh", strict=True)])
    listed = lambda d, n: d.groupBy(image).agg(F.collect_list(shape).alias(n))
    both = listed(anchors, "a").join(listed(faces, "f"), image, "left").withColumn("f", F.coalesce("f", F.filter("a", lambda _: F.lit(False))))
    sides = lambda s: tuple(s[c] for c in "xywh")
    scored = F.flatten(F.transform("a", lambda a: F.transform("f", lambda f: F.struct(iou(sides(a), sides(f)).alias("iou"), a["k"].alias("anchor"), f["k"].alias("face")))))
    pairs = F.reverse(F.array_sort(F.filter(scored, lambda p: p["iou"] >= least)))
    kind = f"array<struct<iou:double,anchor:{anchors.schema[order].dataType.simpleString()},face:{faces.schema[order].dataType.simpleString()}>>"

    def step(taken: Column, p: Column) -> Column:
        clash = F.exists(taken, lambda t: (t["anchor"] == p["anchor"]) | (t["face"] == p["face"]))
        return F.when(clash, taken).otherwise(F.concat(taken, F.array(p)))

    bound = both.select(image, F.explode(F.aggregate(pairs, F.array().cast(kind), step)).alias("p")).select(image, "p.anchor", "p.face", "p.iou")
    return anchors.select(image, F.col(order).alias("anchor")).join(bound, [image, "anchor"], "left")


def best_face(faces: DataFrame, image: str, area: Column, order: str) -> DataFrame:
    """The largest face of each image (ties: the first)."""
    return faces.groupBy(image).agg(F.max_by(order, F.struct(area.alias("s"), (-F.col(order)).alias("k"))).alias("face"))


def frame_anchors(pixels: DataFrame, image: str, luma: str, channels: list[str], low: float, high: float) -> DataFrame:
    """Mean channels of each image over the pixels whose luma lies between two of its percentiles."""
    from .robust import order_statistics

    edges = order_statistics(pixels, [image], luma, (low, high))
    inside = pixels.join(edges, image).where(F.col(luma).between(F.col("__p")[0], F.col("__p")[1]))
    return inside.groupBy(image).agg(*[F.avg(c).alias(c) for c in channels], F.count(F.lit(1)).alias("n"))


def region_stats(pixels: DataFrame, frame: list[str], region: str, values: list[str]) -> DataFrame:
    """Exact median of each value over the pixels of each region of each frame; empty regions have no row."""
    return pixels.groupBy(*frame, region).agg(*[F.percentile(v, F.lit(0.5)).alias(v) for v in values], F.count(F.lit(1)).alias("n"))


def tracks(faces: DataFrame, burst: str, frame: str, face: str, box: tuple[str, ...], most: float = 0.5) -> DataFrame:
    """``burst, frame, face, track`` of faces followed through the frames of a burst: in order, each face takes the free track whose last
    centre is nearest, within ``most`` face widths (ties: the oldest); else it opens one. One face a track and frame.

    A burst's faces are few; they are folded as one array within the JVM.
    """
    x, y, w, h = map(F.col, box)
    row = F.struct(F.col(frame).alias("t"), F.col(face).alias("k"), (x + w / 2).alias("x"), (y + h / 2).alias("y"), w.cast("double").alias("w"))
    rows = faces.groupBy(burst).agg(F.array_sort(F.collect_list(row)).alias("q"))
    kind = faces.schema[frame].dataType.simpleString()

    def step(state: Column, f: Column) -> tuple[dict[str, Column], Column]:
        far = lambda s: F.sqrt((s["x"] - f["x"]) * (s["x"] - f["x"]) + (s["y"] - f["y"]) * (s["y"] - f["y"]))
        near = F.filter(F.transform(state["open"], lambda s, i: F.struct(far(s).alias("d"), i.alias("i"), s["t"].alias("t"))), lambda c: (c["t"] < f["t"]) & (c["d"] <= most * f["w"]))
        number = F.coalesce(F.array_min(near)["i"], F.size(state["open"]))
        own = F.struct(f["x"].alias("x"), f["y"].alias("y"), f["t"].alias("t"))
        moved = F.transform(state["open"], lambda s, i: F.when(i == number, own).otherwise(s))
        return {"open": F.when(number < F.size(state["open"]), moved).otherwise(F.concat(state["open"], F.array(own)))}, number

    start = {"open": F.array().cast(f"array<struct<x:double,y:double,t:{kind}>>")}
    found = rows.select(burst, F.explode(F.arrays_zip("q", scan(F.col("q"), start, step, "int").alias("track"))).alias("z"))
    return found.select(burst, F.col("z.q.t").alias(frame), F.col("z.q.k").alias(face), "z.track")
