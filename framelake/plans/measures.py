"""Masked and statistical grades, face binding, looks, suggestions and roll-ups on the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import colour, grading
from ..operators import faces, review
from .catalogue import LAB_SQL, OKLAB_SQL, RGB_SQL, _rgb, query, r6, read
from .colours import CLIP, EDITS, KEY, MOD, ROUNDED, UNLIN, _keyed, space_sql

MASK = "((l_linenumber % 4) / 3.0)"


def _masked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rgb(spark, sf_dir).withColumn("m", (F.col("l_linenumber") % 4) / 3)


def _rounded(done: DataFrame, digits: int = 5) -> DataFrame:
    return done.select("l_orderkey", "l_linenumber", *[r6(c, digits).alias(c) for c in "rgb"])


@query(RGB_SQL + f"""
select {KEY}, round(2 * r * (1 - r), 6) exclusion, round(least(greatest(3 * r - 1, 0), 1), 6) linear_light, round(case when r = 0 then 0 when r < 0.5 then r / (1 - r) else 1 end, 6) color_dodge,
  round(case when r = 1 then 1 when r > 0.5 then 1 - (1 - r) / r else 0 end, 6) color_burn, round(case when r <= 0.5 then r - (1 - 2 * r) * r * (1 - r) else r + (2 * r - 1) * (sqrt(r) - r) end, 6) soft_light,
  round(case when r <= 0.5 then case when r > 1 / 3 then (3 * r - 1) / (2 * r) else 0 end when r < 2 / 3 then r / (2 * (1 - r)) else 1 end, 6) vivid_light from c""")
def self_blends(spark: SparkSession, sf_dir: str) -> DataFrame:
    modes = ("exclusion", "linear_light", "color_dodge", "color_burn", "soft_light", "vivid_light")
    return _keyed(_rgb(spark, sf_dir), **{m: grading.self_blend(F.col("r"), m) for m in modes})


@query(f"{space_sql('lab', (f'least(greatest(x + {MASK} * 3000.0 / 255, 0), 100)', 'y', 'z'))} {ROUNDED}")
def grade_sclera(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(grading.in_space(_masked(spark, sf_dir), "lab", grading.lightened(F.col("m"), 30)))


@query(f"{space_sql('lch', (f'x * (1 - {MASK}) + least(greatest(x * 1.1, 0), 100) * {MASK}', f'y * (1 - {MASK}) + least(greatest(y * 1.4, 0), 128) * {MASK}', f'z * (1 - {MASK}) + {MOD.format("z + 20")} * {MASK}'))} {ROUNDED}")
def grade_iris(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(grading.in_space(_masked(spark, sf_dir), "lch", grading.iris(F.col("m"), 0.8, 20, 0.5)))


_CLOTH = f"case when x * 2.55 > 170 and abs(y) < 15 and abs(z) < 15 then {MASK} * 0.8 else 0 end"


@query(f"{space_sql('lab', (f'least(greatest(x + ({_CLOTH}) * 1000.0 / 255, 0), 100)', f'least(greatest(y + ({_CLOTH}), -128), 127)', f'least(greatest(z + ({_CLOTH}) * 3, -128), 127)'))} {ROUNDED}")
def grade_white_cloth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(grading.in_space(_masked(spark, sf_dir), "lab", grading.whitened_cloth(F.col("m"), 0.8)))


@query(f"{space_sql('lab', ('x', f'y * case when {MASK} > 0.5 then 0.4 else 1 end', f'z * case when {MASK} > 0.5 then 0.4 else 1 end'))} {ROUNDED}")
def grade_cool_cast(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(grading.in_space(_masked(spark, sf_dir), "lab", grading.cool_cast_removed(F.col("m") > 0.5, 0.6)))


@query(OKLAB_SQL + f""", p as (select o.*, sqrt(oka * oka + okb * okb) ch, ((degrees(atan2(okb, oka)) + 360) % 360) h, {MASK} m from o),
t as (select l_orderkey, (degrees(atan2(sum(sin(radians(h))), sum(cos(radians(h))))) + 360) % 360 th, median(ch) tc from p where m > 0.05 group by 1),
e as (select p.l_orderkey, p.l_linenumber, okl, greatest(ch + least(greatest(tc - ch, -0.03), 0.03) * m * 0.7, 0) c2, h + least(greatest(((th - h + 180) % 360 + 360) % 360 - 180, -10), 10) * m * 0.7 h2 from p join t using (l_orderkey)),
x as (select l_orderkey, l_linenumber, okl, c2 * cos(radians(h2)) a, c2 * sin(radians(h2)) b from e),
y as (select *, {", ".join(f"power({r[0]!r} * okl + ({r[1]!r}) * a + ({r[2]!r}) * b, 3) u{i}" for i, r in enumerate(grading.OKLAB_M2_BACK))} from x)
select l_orderkey, round(avg({CLIP.format(f"({grading.OKLAB_M1_BACK[0][0]!r} * u0 + ({grading.OKLAB_M1_BACK[0][1]!r}) * u1 + ({grading.OKLAB_M1_BACK[0][2]!r}) * u2)")}), 5) red from y group by 1""")
def hair_unified(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = grading.unified_hair(_masked(spark, sf_dir), "l_orderkey", "m", 0.7)
    return done.groupBy("l_orderkey").agg(r6(F.avg(colour.srgb_to_linear(F.col("r"))), 5).alias("red"))


@query(LAB_SQL + f""", s as (select l_orderkey, avg(a) am, stddev_pop(a) sa, avg(b) bm, stddev_pop(b) sb from lab group by 1),
e as (select lab.*, (li + 16) / 116 y, case when sa < 1e-3 then a else (a - am) * least(greatest(8 / (sa + 1e-6), 0.3), 3) + 6 end a2, case when sb < 1e-3 then b else (b - bm) * least(greatest(10 / (sb + 1e-6), 0.3), 3) + 12 end b2 from lab join s using (l_orderkey)),
g as (select {KEY}, {", ".join(f"{w!r} * case when {t} > 6.0 / 29 then power({t}, 3) else (116 * ({t}) - 16) * 27.0 / 24389 end {n}" for n, w, t in zip(("x0", "y0", "z0"), colour.D65, ("(y + a2 / 500)", "y", "(y - b2 / 200)"), strict=True))} from e)
select {KEY}, {", ".join(f"round({UNLIN.format(CLIP.format(f'({r[0]!r} * x0 + ({r[1]!r}) * y0 + ({r[2]!r}) * z0)'))}, 4) {c}" for r, c in zip(grading.XYZ_TO_SRGB, "rgb", strict=True))} from g""")
def colour_transfer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(grading.colour_transfer(_rgb(spark, sf_dir), "l_orderkey", (6.0, 8.0, 12.0, 10.0)), 4)


@query(f"""
with a as ({space_sql(EDITS["warmth"][0], EDITS["warmth"][2])} select * from out), b as ({space_sql(EDITS["saturation"][0], EDITS["saturation"][2])} select * from out), u as (select *, 0.75 w from a union all select *, 0.25 from b)
select {KEY}, round(sum(r * w), 5) r, round(sum(g * w), 5) g, round(sum(b * w), 5) b from u group by 1, 2""")
def grade_stack(spark: SparkSession, sf_dir: str) -> DataFrame:
    pixels = _rgb(spark, sf_dir)
    graded = [(grading.in_space(pixels, *EDITS[n][:2]), w) for n, w in (("warmth", 3.0), ("saturation", 1.0))]
    return _rounded(grading.stacked(graded, ["l_orderkey", "l_linenumber"]))


BOXES = "select l_orderkey img, l_linenumber k, (min(l_partkey) % 40)::double x, (min(l_suppkey) % 30)::double y, max(l_quantity) + 10 w, 40.0::double h from lineitem group by 1, 2"


@query(f"""
with recursive f as ({BOXES}), t as (select f.img, f.k, x + 6 x, y + 3 y, w, h from f where k % 3 <> 1),
p as (select a.img, a.k anchor, t.k face, greatest(least(a.x + a.w, t.x + t.w) - greatest(a.x, t.x), 0) * greatest(least(a.y + a.h, t.y + t.h) - greatest(a.y, t.y), 0) s, a.w * a.h + t.w * t.h u from f a join t on a.img = t.img),
q as (select img, anchor, face, s / (u - s) iou, row_number() over (partition by img order by s / (u - s) desc, anchor desc, face desc) i from p where s / (u - s) >= 0.3),
z as (select img, 0::bigint i, []::int[] ua, []::int[] uf, null::int anchor, null::int face, null::double iou from q group by img
  union all select z.img, q.i, case when ok then list_append(ua, q.anchor) else ua end, case when ok then list_append(uf, q.face) else uf end, case when ok then q.anchor end, case when ok then q.face end, case when ok then q.iou end
  from z join q on q.img = z.img and q.i = z.i + 1, lateral (select not list_contains(z.ua, q.anchor) and not list_contains(z.uf, q.face) ok) o)
select f.img, f.k anchor, z.face, round(z.iou, 6) iou from f left join z on z.img = f.img and z.anchor = f.k""")
def face_binding(spark: SparkSession, sf_dir: str) -> DataFrame:
    each = read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("img"), F.col("l_linenumber").alias("k"))
    anchors = each.agg((F.min("l_partkey") % 40).cast("double").alias("x"), (F.min("l_suppkey") % 30).cast("double").alias("y"), (F.max("l_quantity") + 10).alias("w")).withColumn("h", F.lit(40.0))
    found = anchors.where("k % 3 != 1").withColumns({"x": F.col("x") + 6, "y": F.col("y") + 3})
    return faces.bound_faces(anchors, found, "img", ("x", "y", "w", "h"), "k").withColumn("iou", r6("iou"))


@query(f"with f as ({BOXES}) select img, arg_max(k, (w * h, -k)) face from f group by img")
def best_faces(spark: SparkSession, sf_dir: str) -> DataFrame:
    each = read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("img"), F.col("l_linenumber").alias("k")).agg((F.max("l_quantity") + 10).alias("w"))
    return faces.best_face(each, "img", F.col("w") * 40.0, "k")


@query("""
with p as (select l_orderkey % 50 img, l_quantity * 0.73105857863 r, l_discount * 0.73105857863 g, l_extendedprice y from lineitem), e as (select img, quantile_cont(y, 0.1) lo, quantile_cont(y, 0.9) hi from p group by 1)
select img, round(avg(r), 6) r, round(avg(g), 6) g, count(*) n from p join e using (img) where y between lo and hi group by 1""")
def frame_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    pixels = read(spark, sf_dir, "lineitem").select((F.col("l_orderkey") % 50).alias("img"), (F.col("l_quantity") * 0.73105857863).alias("r"), (F.col("l_discount") * 0.73105857863).alias("g"), F.col("l_extendedprice").alias("y"))
    found = faces.frame_anchors(pixels, "img", "y", ["r", "g"], 0.1, 0.9)
    return found.select("img", r6("r").alias("r"), r6("g").alias("g"), "n")


def _map_sql(name: str, scores: dict[str, float]) -> str:
    return f"case {name} " + " ".join(f"when '{k}' then {v}" for k, v in scores.items()) + " end"


_FRAMING = "case when framing <> 'wide' and coalesce(people, 0) >= 2 then 'pair' else framing end"


@query(f"""
with c as (select p_partkey, 0.5 photo, p_size / 50.0 costume, case when p_size % 3 = 0 then null else 0.4 end light, case when p_size % 4 = 0 then null else p_size / 100.0 end ml from part),
l as (select p_partkey, ['photo', 'collage', 'poster'][p_size % 3 + 1] kind, ['wide', 'half-body', 'close-up', 'full-body'][p_size % 4 + 1] framing, (p_partkey % 4)::int people, p_size % 5 <> 0 readable, ['studio', 'indoor', 'forest'][p_partkey % 3 + 1] setting from part where p_partkey % 2 = 0)
select c.p_partkey, (case when l.kind is null then photo else {_map_sql("kind", review.KIND_SCORES)} end)::double photo,
  case when l.kind is null then costume else round({_map_sql(_FRAMING, review.FRAMING_SCORES)} * case when not readable then 0.6 else 1 end, 4) end::double costume,
  coalesce(case when l.kind is not null then round(0.5 * ml + 0.5 * {_map_sql("setting", review.SETTING_SCORES)}, 4) end, light)::double light from c left join l using (p_partkey)""")
def look_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    size, key = F.col("p_size"), F.col("p_partkey")
    pick = lambda names, n: F.element_at(F.array(*map(F.lit, names)), (n % len(names) + 1).cast("int"))
    rows = read(spark, sf_dir, "part")
    covers = rows.select("p_partkey", F.lit(0.5).alias("photo"), (size / 50).alias("costume"), F.when(size % 3 != 0, 0.4).alias("light"), F.when(size % 4 != 0, size / 100).alias("measured_light"))
    looks = rows.where("p_partkey % 2 = 0").select(
        "p_partkey", pick(("photo", "collage", "poster"), size).alias("kind"), pick(("wide", "half-body", "close-up", "full-body"), size).alias("framing"), (key % 4).cast("int").alias("people"),
        (size % 5 != 0).alias("costume_readable"), pick(("studio", "indoor", "forest"), key).alias("setting"),
    )
    return review.merged_looks(covers, looks, "p_partkey")


@query("""
with c as (select p_partkey, ['open', 'closed', 'wink'][p_partkey % 3 + 1] eyes, case when p_size % 4 <> 0 then p_size * 1.5 end s from part), m as (select case when count(s) >= 3 then median(s) end m from c)
select p_partkey, (case when eyes = 'closed' then 0.6 else 1 end * case when coalesce(m <> 0 and s < 0.6 * m, false) then 0.8 else 1 end)::double gate from c, m""")
def face_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    eyes = F.element_at(F.array(*map(F.lit, ("open", "closed", "wink"))), (F.col("p_partkey") % 3 + 1).cast("int"))
    covers = read(spark, sf_dir, "part").select("p_partkey", eyes.alias("eyes"), F.when(F.col("p_size") % 4 != 0, F.col("p_size") * 1.5).alias("s"))
    return review.face_gate(covers, "eyes", "s").select("p_partkey", r6("gate").alias("gate"))


_INT = "trunc(least(greatest({0}, {1}), {2}))::int"


@query(f"""
with a as (select p_partkey, p_size * 5.0 m, p_partkey % 23 p1, 200.0 + p_partkey % 51 p95, 215.0 + p_size % 41 p99, (p_partkey % 10) / 10.0 noise, (p_size % 8) / 20.0 sharp from part),
b as (select *, case when m < 80 then {_INT.format("(128 - m) * 0.15", 0, 12)} when m > 180 then {_INT.format("(128 - m) * 0.3", -20, 0)} else {_INT.format("(128 - m) * 0.5", -30, 30)} end br from a)
select p_partkey, case when abs(br) >= 1 then br end brightness, case when p1 < 10 then {_INT.format("(12 - p1) * 0.5", 0, 60)} end blacks, case when p99 > 240 then {_INT.format("(240 - p99) * 1.5", -60, 0)} end whites,
  case when p95 > 235 then {_INT.format("235 - p95", -40, 0)} end highlights, case when p95 - p1 < 120 then {_INT.format("(120 - p95 + p1) * 0.3", 0, 30)} when p95 - p1 > 230 then {_INT.format("(230 - p95 + p1) * 0.3", -20, 0)} end contrast,
  case when noise > 0.25 then {_INT.format("round_even(noise * 60, 0)", 0, 100)} end denoise, case when sharp < 0.2 then {_INT.format("(0.2 - sharp) * 200", 5, 40)} end sharpen from b""")
def suggested_params(spark: SparkSession, sf_dir: str) -> DataFrame:
    key, size = F.col("p_partkey"), F.col("p_size")
    measures = read(spark, sf_dir, "part").select(
        "p_partkey", (size * 5.0).alias("mean_l"), (key % 23).cast("double").alias("p1"), (200.0 + key % 51).alias("p95"), (215.0 + size % 41).alias("p99"),
        ((key % 10).cast("decimal(10,1)") / 10).alias("noise"), ((size % 8).cast("decimal(10,1)") / 20).alias("sharpness"),
    )
    return review.suggested(measures, "p_partkey")


@query("""
with s as (select user_id, case when event_type = 'error' then 'unavailable' when value > 50 then 'flagged' else 'passed' end s from events)
select user_id, count(*) filter (s = 'flagged') flagged, count(*) filter (s = 'passed') passed, count(*) filter (s = 'unavailable') unavailable, count(*) n from s group by 1""")
def qa_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = review.qa_status(F.when(F.col("event_type") == "error", False), F.col("value") > 50)
    return review.qa_rollup(read(spark, sf_dir, "events").select("user_id", status.alias("status")), "user_id", "status")


@query("""
with d as (select o_custkey c_custkey, arg_max(o_orderpriority, o_orderkey) decision from orders where o_orderstatus <> 'O' group by 1)
select c_custkey, c_name, coalesce(decision, 'undecided') decision from customer left join d using (c_custkey)""")
def review_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    decisions = read(spark, sf_dir, "orders").where("o_orderstatus != 'O'").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey", F.col("o_orderpriority").alias("decision"))
    return review.decided(read(spark, sf_dir, "customer").select("c_custkey", "c_name"), decisions, "c_custkey", "o_orderkey")


@query("""
with v as (select c_custkey, case when c_custkey % 3 = 0 then null when c_custkey % 5 = 0 then -1 else c_acctbal end mp from customer)
select c_custkey, round(case when mp > 0 then mp else coalesce((select median(mp) from v where mp > 0), 1.0) end, 6) mp from v""")
def default_megapixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    value = F.when(F.col("c_custkey") % 3 == 0, None).when(F.col("c_custkey") % 5 == 0, -1.0).otherwise(F.col("c_acctbal"))
    return review.with_default(read(spark, sf_dir, "customer").select("c_custkey", value.alias("mp")), "mp").withColumn("mp", r6("mp"))


@query(f"""
with p as (select {KEY}, l_suppkey % 8 region, l_quantity l, l_discount a from lineitem) select l_orderkey, region, round(median(l), 6) l, round(median(a), 6) a, count(*) n from p group by 1, 2""")
def region_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    pixels = read(spark, sf_dir, "lineitem").select("l_orderkey", (F.col("l_suppkey") % 8).alias("region"), F.col("l_quantity").alias("l"), F.col("l_discount").alias("a"))
    found = faces.region_stats(pixels, ["l_orderkey"], "region", ["l", "a"])
    return found.select("l_orderkey", "region", r6("l").alias("l"), r6("a").alias("a"), "n")


@query(f"""
with recursive f as ({BOXES}), g as (select img // 4 burst, img % 4 t, k, x + w / 2 x, y + h / 2 y, w, row_number() over (partition by img // 4 order by img % 4, k) i from f),
z as (select burst, 0::bigint i, null::bigint t, null::int k, null::int track, []::struct(x double, y double, t bigint)[] o from g group by burst
  union all select burst, i, t, k, tr, case when tr < len(o) then list_transform(list_zip(o, range(0, len(o))), lambda p: case when p[2] = tr then me else p[1] end) else list_append(o, me) end from (
    select g.burst, g.i, g.t, g.k, z.o, {{'x': g.x, 'y': g.y, 't': g.t}} me, coalesce(list_sort(list_filter(list_transform(list_zip(z.o, range(0, len(z.o))), lambda p: {{'d': sqrt(power(p[1].x - g.x, 2) + power(p[1].y - g.y, 2)), 'i': p[2], 't': p[1].t}}),
      lambda c: c.t < g.t and c.d <= 0.5 * g.w))[1].i, len(z.o))::int tr from z join g on g.burst = z.burst and g.i = z.i + 1))
select burst, t frame, k face, track from z where i > 0""")
def face_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    each = read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("img"), F.col("l_linenumber").alias("face"))
    boxes = each.agg((F.min("l_partkey") % 40).cast("double").alias("x"), (F.min("l_suppkey") % 30).cast("double").alias("y"), (F.max("l_quantity") + 10).alias("w")).withColumn("h", F.lit(40.0))
    rows = boxes.withColumns({"burst": F.floor(F.col("img") / 4).cast("long"), "frame": F.col("img") % 4})
    return faces.tracks(rows, "burst", "frame", "face", ("x", "y", "w", "h"))


@query("select l_partkey, count(distinct l_suppkey) n, array_to_string(list_sort(list(distinct l_suppkey)), ',') units from lineitem group by 1 having count(distinct l_suppkey) > 1")
def shared_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators import graph

    return graph.shared_files(read(spark, sf_dir, "lineitem"), "l_suppkey", "l_partkey").withColumn("units", F.array_join(F.col("units").cast("array<string>"), ","))


@query("""
select l_orderkey, l_linenumber, round(case when l_discount <= 0.05 then 1 when l_discount >= 0.09 then 0 else 1 - power((l_discount - 0.05) / 0.04, 2) * (3 - 2 * (l_discount - 0.05) / 0.04) end, 6) gate from lineitem""")
def yaw_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _keyed(read(spark, sf_dir, "lineitem"), gate=colour.smoothstep_down(F.col("l_discount"), 0.05, 0.09))


@query("""
with p as (select p_partkey, p_brand, string_split(replace(lower(p_name), ' ', '.'), '.') s, p_size from part)
select p_partkey, i::int depth, array_to_string(s[:i], '.') prefix, round(case when p_size % 3 = 0 then -1.0 else 10.0 / (p_size % 3) end, 6) ratio,
  case when p_size / 60.0 < 0.04 then 'wide' when p_size / 60.0 < 0.12 then 'full-body' when p_size / 60.0 < 0.2 then 'three-quarter' when p_size / 60.0 < 0.33 then 'half-body' else 'close-up' end framing
from (select *, unnest(range(1, len(s) + 1)) i from p)""")
def sql_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rules called from SQL, as scalar and as table functions."""
    from ..functions import sql

    sql.register(spark)
    read(spark, sf_dir, "part").createOrReplaceTempView("framelake_part")
    return spark.sql("""
        SELECT p_partkey, depth, prefix, round(safe_divide(10, p_size % 3, -1), 6) AS ratio, framing(p_size / 60, 1) AS framing
        FROM framelake_part, LATERAL path_prefixes(replace(lower(p_name), ' ', '.'))""")
