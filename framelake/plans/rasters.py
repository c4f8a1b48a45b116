"""Pixel images on the driver's tables: line items are pixels, 256 orders an image, the line number its column."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import raster
from .catalogue import query, r6, read

PIXELS = """px as (select l_orderkey // 256 image, l_orderkey % 256 "row", l_linenumber::bigint col, max(l_quantity) * 5 r, floor(max(l_discount) * 2550) g, floor(max(l_tax) * 3187) b from lineitem group by 1, 2, 3)"""
#: A square image of parts: the retail price as brightness of 64 columns.
SQUARE = """sq as (select p_partkey // 1024 image, p_partkey % 1024 // 32 "row", p_partkey % 32 col, (p_size * 5)::double v, p_retailprice / 2100 light from part)"""


def _pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    each = read(spark, sf_dir, "lineitem").groupBy(F.expr("l_orderkey div 256").alias("image"), (F.col("l_orderkey") % 256).alias("row"), F.col("l_linenumber").cast("long").alias("col"))
    return each.agg((F.max("l_quantity") * 5).alias("r"), F.floor(F.max("l_discount") * 2550).cast("double").alias("g"), F.floor(F.max("l_tax") * 3187).cast("double").alias("b"))


def _square(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("p_partkey")
    return read(spark, sf_dir, "part").select(
        F.expr("p_partkey div 1024").alias("image"), F.floor(key % 1024 / 32).alias("row"), (key % 32).alias("col"), (F.col("p_size") * 5.0).alias("v"), (F.col("p_retailprice") / 2100).alias("light")
    )


_LAP = """n as (select p.*, u.v up, d.v dn, l.v lf, r.v rt from p left join p u on u.image = p.image and u.col = p.col and u."row" = p."row" - 1 left join p d on d.image = p.image and d.col = p.col and d."row" = p."row" + 1
  left join p l on l.image = p.image and l."row" = p."row" and l.col = p.col - 1 left join p r on r.image = p.image and r."row" = p."row" and r.col = p.col + 1),
q as (select *, coalesce(up, dn, v) + coalesce(dn, up, v) + coalesce(lf, rt, v) + coalesce(rt, lf, v) - 4 * v lap from n)"""


@query(f"""
with {PIXELS}, p as (select image, "row", col, r v from px), {_LAP}
select image, round(var_pop(lap), 4) sharpness, round(exp(-power((avg(v / 255) - 0.5) / 0.28, 2)), 6) exposure, round(avg((v / 255 >= 0.99)::int), 6) highlight_fraction, round(avg((v / 255 <= 0.01)::int), 6) shadow_fraction,
  round(least(greatest(1 - (avg((v / 255 >= 0.99)::int) + avg((v / 255 <= 0.01)::int)) / 0.2, 0), 1), 6) clipping, round(ln(1 + count(*)), 6) resolution from q group by image""")
def frame_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = raster.frame_quality(_pixels(spark, sf_dir).select("image", "row", "col", F.col("r").alias("v")), "v")
    return found.select("image", r6("sharpness", 4).alias("sharpness"), *[r6(c).alias(c) for c in ("exposure", "highlight_fraction", "shadow_fraction", "clipping", "resolution")])


@query(f"""
with {SQUARE}, p as (select image, "row", col, v from sq), {_LAP}
select image, "row", col, lap laplacian from q""")
def laplacian(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = raster.laplacian(_square(spark, sf_dir).select("image", "row", "col", "v"), "v")
    return found.select("image", "row", "col", "laplacian")


_CLOSURE = """e as (select a.image, a."row" * 1000000 + a.col i, b."row" * 1000000 + b.col j from m a join m b on a.image = b.image and abs(a."row" - b."row") <= 1 and abs(a.col - b.col) <= 1),
t as (select image, i, j from e union select t.image, t.i, e.j from t join e on e.image = t.image and e.i = t.j),
z as (select image, i, min(j) blob from t group by 1, 2)"""


@query(f"""
with recursive {PIXELS}, c as (select image, "row", col, (r = 0 or r = 255 or g = 0 or g = 255 or b = 0 or b = 255) hit from px), m as (select image, "row", col from c where hit), {_CLOSURE},
l as (select image, max(n) n from (select image, blob, count(*) n from z group by 1, 2) group by 1),
s as (select image, count(*) n, count(*) filter (hit) k, max("row") - min("row") + 1 < 7 or max(col) - min(col) + 1 < 7 tiny from c group by 1),
f as (select s.image, case when tiny then 0 else k / s.n end p, case when tiny then 0 else coalesce(l.n, 0) / s.n end q from s left join l using (image))
select image, round(p, 6) pixel_fraction, round(q, 6) blob_fraction, round(greatest(p, q), 6) score, q > 0.02 flagged from f""")
def clipping_blobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = raster.clipping_blobs(_pixels(spark, sf_dir), ["r", "g", "b"], 0.02, least_side=7)
    return found.select("image", *[r6(c).alias(c) for c in ("pixel_fraction", "blob_fraction", "score")], "flagged")


@query(f"""
with recursive {SQUARE}, m as (select image, "row", col from sq where v >= 170), {_CLOSURE}
select image, blob // 1000000 "row", count(*) area, min(i // 1000000) top, max(i // 1000000) bottom, min(i % 1000000) "left", max(i % 1000000) "right" from z group by image, blob""")
def blemish_blobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raster.blobs(_square(spark, sf_dir), F.col("v") >= 170).select("image", "row", "area", "top", "bottom", "left", "right")


@query(f"""
with {PIXELS}, c as (select image, (least(floor(r / 64), 3) * 16 + least(floor(g / 64), 3) * 4 + least(floor(b / 64), 3))::int cell, count(*) n from px group by 1, 2),
k as (select *, row_number() over (partition by image order by n desc, cell) "rank" from c)
select image, "rank"::int "rank", n, (cell // 16 * 64 + 32)::int r, (cell // 4 % 4 * 64 + 32)::int g, (cell % 4 * 64 + 32)::int b from k where "rank" <= 5""")
def dominant_colours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raster.dominant_colours(_pixels(spark, sf_dir), ["r", "g", "b"])


def _palette_sql(rounds: int = raster.ROUNDS) -> str:
    parts = [PIXELS, """h as (select image, (least(floor(r / 16), 15) * 256 + least(floor(g / 16), 15) * 16 + least(floor(b / 16), 15))::int cell, count(*) n, sum(r) / count(*) r, sum(g) / count(*) g, sum(b) / count(*) b from px group by 1, 2)""",
             "k0 as (select * from (select image, row_number() over (partition by image order by n desc, cell) - 1 cluster, 0.0::double weight, r, g, b from h) where cluster < 5)"]
    for i in range(rounds):
        parts.append(f"""a{i} as (select h.image, h.n, h.r, h.g, h.b, arg_min(k.cluster, (round(power(k.r - h.r, 2) + power(k.g - h.g, 2) + power(k.b - h.b, 2), 6), k.cluster)) cluster from h join k{i} k on k.image = h.image group by h.image, h.cell, h.n, h.r, h.g, h.b),
m{i} as (select image, cluster, sum(n) w, sum(n * r) / sum(n) r, sum(n * g) / sum(n) g, sum(n * b) / sum(n) b from a{i} group by 1, 2),
k{i + 1} as (select k.image, k.cluster, coalesce(w, 0)::double weight, coalesce(m.r, k.r) r, coalesce(m.g, k.g) g, coalesce(m.b, k.b) b from k{i} k left join m{i} m using (image, cluster))""")
    return "with " + ",\n".join(parts) + f"\nselect image, cluster::int cluster, weight, round(r, 4) r, round(g, 4) g, round(b, 4) b from k{rounds}"


@query(_palette_sql())
def palette(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raster.palette(_pixels(spark, sf_dir), ["r", "g", "b"]).select("image", "cluster", "weight", *[r6(c, 4).alias(c) for c in "rgb"])


@query(f"""
with {SQUARE}, b as (select image, max("row") + 1 h, max(col) + 1 w from sq group by 1),
p as (select image, (col - (w - 1) / 2) / greatest(w / 2, 1) x, ("row" - (h - 1) / 2) / greatest(h / 2, 1) y, light v from sq join b using (image)
  where power((col - (w - 1) / 2) / greatest(w * 0.35, 1), 2) + power(("row" - (h - 1) / 2) / greatest(h * 0.42, 1), 2) <= 1),
g as (select image, count(*) n, avg(x) mx, avg(y) my, avg(v) mv, covar_pop(x, x) xx, covar_pop(x, y) xy, covar_pop(y, y) yy, covar_pop(x, v) xv, covar_pop(y, v) yv from p group by 1),
f as (select *, (xv * yy - yv * xy) / (xx * yy - xy * xy) px, (yv * xx - xv * xy) / (xx * yy - xy * xy) py from g where n >= 100),
r as (select image, any_value(px) px, any_value(py) py, stddev_pop(v - mv - px * (x - mx) - py * (y - my)) res from p join f using (image) group by 1),
c as (select *, sqrt(px * px + py * py) s, least(0.45, sqrt(px * px + py * py) / greatest(res * 5, 0.035)) * 0.45 conf from r)
select b.image, round(case when s >= 1e-6 and conf >= 0.05 then px / s end, 6) dx, round(case when s >= 1e-6 and conf >= 0.05 then py / s end, 6) dy, round(coalesce(case when s >= 1e-6 and conf >= 0.05 then conf end, 0), 6) confidence from b left join c using (image)""")
def light_plane(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raster.light_plane(_square(spark, sf_dir), "light").select("image", *[r6(c).alias(c) for c in ("dx", "dy", "confidence")])


_X, _Y = "(col + image * 31 % 61)", '("row" + image * 17 % 67)'


@query(f"""
with {PIXELS}, i as (select *, {_X} * 0.06711056::double + {_Y} * 0.00583715::double f from px), n as (select *, (f - floor(f)) * 52.9829189::double t from i)
select image, "row", col, least(greatest(round_even(r / 260 * 15 + t - floor(t) - 0.5, 0), 0), 15)::int level from n""")
def dithered_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    level = raster.quantised(F.col("r") / 260, raster.dither_noise(F.col("image"), F.col("row"), F.col("col")), 15)
    return _pixels(spark, sf_dir).select("image", "row", "col", level.alias("level"))
