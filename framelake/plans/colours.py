"""Colour and grading queries; the channels of a pixel come from a line's quantity, discount and tax."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import colour, grading
from .catalogue import FLAB, LAB_SQL, LIN, LIN_SQL, OKLAB_SQL, RGB_SQL, _lab, _mat, _oklab, _rgb, query, r6, read

KEY = "l_orderkey, l_linenumber"
UNLIN = "case when {0} <= 0.0031308 then {0} * 12.92 else 1.055 * power({0}, 1 / 2.4) - 0.055 end"
CLIP = "least(greatest({0}, 0), 1)"
MOD = "((({0}) % 360 + 360) % 360)"


def _step(name: str, before: str, columns: tuple[str, ...]) -> str:
    return f", {name} as (select {KEY}, {', '.join(f'{c} {n}' for c, n in zip(columns, 'xyz', strict=True))} from {before})"


def _matrix(m: tuple) -> tuple[str, ...]:
    return tuple("(" + " + ".join(f"({k!r}) * {v}" for k, v in zip(row, "xyz", strict=True)) + ")" for row in m)


def space_sql(space: str, edit: tuple[str, str, str]) -> str:
    """The channels after an edit of x, y, z in a space, as ``out``."""
    steps = [("s0", "c", tuple(CLIP.format(n) for n in "rgb"))]
    add = lambda *columns: steps.append((f"s{len(steps)}", f"s{len(steps) - 1}", columns))
    if space == "hsv":
        top, span = "greatest(x, y, z)", "(greatest(x, y, z) - least(x, y, z))"
        turn = f"case when {span} = 0 then 0 when {top} = x then (y - z) / {span} * 60 when {top} = y then (2 + (z - x) / {span}) * 60 else (4 + (x - y) / {span}) * 60 end"
        add(MOD.format(turn), f"case when {top} = 0 then 0 else {span} / {top} end", top)
        add(*edit)
        k = lambda n: f"((x / 60 + {n}) % 6)"
        add(*(f"z - z * y * least(greatest(least({k(n)}, 4 - {k(n)}), 0), 1)" for n in (5, 3, 1)))
    else:
        add(*(LIN.format(n) for n in "xyz"))
        if space in ("lab", "lch"):
            add(*_matrix(colour.SRGB_TO_XYZ))
            add(*(FLAB.format(f"({n} / {w!r})") for n, w in zip("xyz", colour.D65, strict=True)))
            add("116 * y - 16", "500 * (x - y)", "200 * (y - z)")
        else:
            add(*_matrix(colour.OKLAB_M1))
            add(*(f"cbrt(greatest({n}, 0))" for n in "xyz"))
            add(*_matrix(colour.OKLAB_M2))
        if space.endswith("lch"):
            add("x", "sqrt(y * y + z * z)", MOD.format("degrees(atan2(z, y))"))
        add(*edit)
        if space.endswith("lch"):
            add("x", "y * cos(radians(z))", "y * sin(radians(z))")
        if space in ("lab", "lch"):
            add("(x + 16) / 116 + y / 500", "(x + 16) / 116", "(x + 16) / 116 - z / 200")
            add(*(f"{w!r} * case when {n} > 6.0 / 29 then {n} * {n} * {n} else (116 * {n} - 16) * 27.0 / 24389 end" for n, w in zip("xyz", colour.D65, strict=True)))
            add(*_matrix(grading.XYZ_TO_SRGB))
        else:
            add(*_matrix(grading.OKLAB_M2_BACK))
            add("x * x * x", "y * y * y", "z * z * z")
            add(*_matrix(grading.OKLAB_M1_BACK))
        add(*(UNLIN.format(CLIP.format(n)) for n in "xyz"))
    return RGB_SQL + "".join(_step(*s) for s in steps) + f", out as (select {KEY}, {', '.join(f'{CLIP.format(n)} {c}' for n, c in zip('xyz', 'rgb', strict=True))} from s{len(steps) - 1})"


ROUNDED = f"select {KEY}, round(r, 5) r, round(g, 5) g, round(b, 5) b from out"
HUE_OFF = "least((abs({0} - {1}) % 360), 360 - (abs({0} - {1}) % 360))"


def _bell(x: str, centre: float, width: float) -> str:
    return f"exp(-power({HUE_OFF.format(x, centre)} / {width}, 2) / 2)"


def _window(x: str, centre: float) -> str:
    return f"least(greatest(1 - ({HUE_OFF.format(x, centre)} - 15) / 15, 0), 1)"


def _points_sql(x: str, points: list[tuple[float, float]]) -> str:
    parts = [f"when {x} <= {points[0][0]} then {points[0][1]}"]
    parts += [f"when {x} <= {b[0]} then {a[1]} + ({x} - {a[0]}) * {(b[1] - a[1]) / (b[0] - a[0])!r}" for a, b in zip(points, points[1:], strict=False)]
    return f"(case {' '.join(parts)} else {points[-1][1]} end)"


POINTS = [(0, 10), (64, 50), (128, 140), (192, 210), (255, 245)]
_soft = "1 / (1 + exp(-(x / 100 - {0}) * 10))"
_tint = lambda k, low, mid, high: " + ".join(
    f"({w}) * {sat / 4 * (math.cos, math.sin)[k](math.radians(hue))!r}" for w, (hue, sat) in
    ((f"1 - {_soft.format(0.32)}", low), (f"least(greatest({_soft.format(0.32)} - {_soft.format(0.72)}, 0), 1)", mid), (_soft.format(0.72), high))
)
_TONES = ((210.0, 40.0), (30.0, 10.0), (45.0, 60.0))
#: Name: space, edit, and the edit in SQL over x, y, z.
EDITS: dict[str, tuple[str, grading.Edit, tuple[str, str, str]]] = {
    "saturation": ("hsv", grading.saturated(0.41421356), ("x", "least(greatest(y * (1 + 0.41421356 * (1 - y)), 0), 1)", "z")),
    "vibrance": ("hsv", grading.vibrance(0.61803398), ("x", "least(greatest(y * case when (round(x, 9) > 0 and round(x, 9) < 50) or round(x, 9) > 320 then least(1 + 0.61803398 * (1 - y), 0.69098301) else 1 + 0.61803398 * (1 - y) end, 0), 1)", "z")),
    "calibration": ("hsv", grading.calibrated({"red": (40, 20), "green": (-30, 0), "blue": (10, -60)}), (
        MOD.format(f"x + {_bell('x', 0.0, 30)} * 6.0 + {_bell('x', 120.0, 30)} * -4.5 + {_bell('x', 240.0, 30)} * 1.5"),
        f"least(greatest(y * (1 + {_bell('x', 0.0, 30)} * 0.1 + {_bell('x', 240.0, 30)} * -0.3), 0), 1)", "z")),
    "hsl_table": ("hsv", grading.hsl_table({"orange": (12, -20, 8)}), (
        MOD.format(f"x + {_bell('x', 28.0, 20)} * 12"), f"case when {_bell('x', 28.0, 20)} > 0.01 then least(greatest(y + {_bell('x', 28.0, 20)} * -20.0 / 255, 0), 1) else y end",
        f"case when {_bell('x', 28.0, 20)} > 0.01 then least(greatest(z + {_bell('x', 28.0, 20)} * 8.0 / 255, 0), 1) else z end")),
    "warmth": ("lab", grading.warmer(0.5), ("x", "least(greatest(y + 5, -128), 127)", "least(greatest(z + 15, -128), 127)")),
    "lift_shadows": ("lab", grading.lifted_shadows(30), ("least(greatest(x + least(greatest(1 - x * 2.55 / 128, 0), 1) * 3000.0 / 255, 0), 100)", "y", "z")),
    "fade_toe": ("lab", grading.faded_toe(0.7), ("x + least(greatest(1 - x / 50, 0), 1) * 14", "y", "z")),
    "luminance_curve": ("lab", grading.luminance_curve(POINTS), (f"least(greatest({_points_sql('(x * 2.55)', POINTS)} / 2.55, 0), 100)", "y", "z")),
    "three_way_tone": ("lab", grading.three_way(*_TONES, balance=10), ("x", f"least(greatest(y + {_tint(0, *_TONES)}, -128), 127)", f"least(greatest(z + {_tint(1, *_TONES)}, -128), 127)")),
    "master_hsl": ("lch", grading.master_hsl(25, 1.2, -4), ("least(greatest(x - 4, 0), 100)", "y * 1.2", MOD.format("z + 25"))),
    "channel_hsl": ("lch", grading.channel_hsl("yellow", 12, 0.7, 5), (
        f"least(greatest(x + 5 * {_window(MOD.format('z + 12 * ' + _window('z', 60.0)), 60.0)}, 0), 100)", f"y * (1 - 0.3 * {_window(MOD.format('z + 12 * ' + _window('z', 60.0)), 60.0)})",
        MOD.format("z + 12 * " + _window("z", 60.0)))),
    "negative_split": ("lch", grading.negative_split(0.8, 0.5), ("x", "y * (1 - power(least(greatest(1 - x / 50, 0), 1), 2) * 0.8) * (1 - power(least(greatest((x - 60) / 40, 0), 1), 2) * 0.5)", "z")),
    "highlight_drift": ("lch", grading.highlight_drift(0.9), ("x", "y", "least(greatest(z + 10.8 * least(greatest((x - 75) / 25, 0), 1) * (1 - least(greatest((y - 8) / 12, 0), 1)), 0), 360)")),
    "split_tone": ("lch", grading.split_tone((220, 0.5), (40, 0.3), 10), (
        "x", "(y * (1 - least(greatest((0.55 - x / 100) / 0.55, 0), 1) * 0.5) + least(greatest((0.55 - x / 100) / 0.55, 0), 1) * 15) * (1 - least(greatest((x / 100 - 0.55) / 0.45, 0), 1) * 0.3) + least(greatest((x / 100 - 0.55) / 0.45, 0), 1) * 5.4",
        "(z * (1 - least(greatest((0.55 - x / 100) / 0.55, 0), 1) * 0.5) + least(greatest((0.55 - x / 100) / 0.55, 0), 1) * 110) * (1 - least(greatest((x / 100 - 0.55) / 0.45, 0), 1) * 0.3) + least(greatest((x / 100 - 0.55) / 0.45, 0), 1) * 12")),
    "film_split": ("oklch", grading.film_split(200, 68, 0.5, 0.5), (
        "x", "y + 0.02 * power(least(greatest((0.5 - x) / 0.5, 0), 1), 1.5) + 0.02 * power(least(greatest((x - 0.5) / 0.5, 0), 1), 1.5)",
        "case when x < 0.5 then case when power((0.5 - x) / 0.5, 1.5) > 0.1 then z * (1 - power(least((0.5 - x) / 0.5, 1), 1.5)) + power(least((0.5 - x) / 0.5, 1), 1.5) * 200 else z end"
        " when power(least((x - 0.5) / 0.5, 1), 1.5) > 0.1 then z * (1 - power(least((x - 0.5) / 0.5, 1), 1.5)) + power(least((x - 0.5) / 0.5, 1), 1.5) * 68 else z end")),
}


def _grade(name: str, space: str, edit: grading.Edit, sql: tuple[str, str, str]) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        done = grading.in_space(_rgb(spark, sf_dir), space, edit)
        return done.select("l_orderkey", "l_linenumber", *[r6(c, 5).alias(c) for c in "rgb"])

    run.__name__ = f"grade_{name}"
    query(f"{space_sql(space, sql)} {ROUNDED}")(run)


for _name, _parts in EDITS.items():
    _grade(_name, *_parts)


def _keyed(df: DataFrame, digits: int = 6, **columns: Column) -> DataFrame:
    return df.select("l_orderkey", "l_linenumber", *[(r6(c, digits) if digits else c).alias(n) for n, c in columns.items()])


@query(RGB_SQL + f", k as (select *, {_points_sql('(r * 255)', POINTS)} / 255 cr from c) select {KEY}, round(least(greatest(cr, 0), 1), 6) r from k")
def rgb_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _keyed(_rgb(spark, sf_dir), r=colour.clip(grading.curve(F.col("r") * 255, POINTS) / 255))


@query(RGB_SQL + f"""
select {KEY}, round(least(greatest(128 + ((r * 255 * 0.5 + g * 255 * 0.3 + b * 255 * 0.2) - 128) * 1.4 + 5, 0), 255), 5) grey from c""")
def bw_mixer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _keyed(_rgb(spark, sf_dir), 5, grey=grading.monochrome(F.col("r") * 255, F.col("g") * 255, F.col("b") * 255, (0.5, 0.3, 0.2), 5.0, 20.0))


@query(RGB_SQL + f"""
, w as (select *, r * 255 x, least(greatest(1 - r * 255 / 64, 0), 1) wb, least(greatest(1 - abs(r * 255 - 25) / 100, 0), 1) ws, least(greatest(1 - abs(r * 255 - 230) / 100, 0), 1) wh, least(greatest(1 - (255 - r * 255) / 64, 0), 1) ww from c)
select {KEY}, round(least(greatest(x + wb * -0.1 * 48 + ws * ws * (3 - 2 * ws) * 0.4 * 48 + wh * wh * (3 - 2 * wh) * -0.3 * 48 + ww * 0.2 * 48, 0), 255), 5) v from w""")
def tonal_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _keyed(_rgb(spark, sf_dir), 5, v=grading.tonal(F.col("r") * 255, 40, -30, 20, -10))


@query(RGB_SQL + f"""
select {KEY}, round(least(greatest(1 - (power(r * 300 - 150, 2) + power(g * 200 - 100, 2)) / (150.0 * 150 + 100.0 * 100) * 0.6, 0), 1), 6) fall,
  round(least(greatest((80 - sqrt(power(r * 300 - 120, 2) + power(g * 200 - 120, 2))) / 24, 0), 1), 6) round_mask from c""")
def frame_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, y, w, h = F.col("r") * 300, F.col("g") * 200, F.lit(300.0), F.lit(200.0)
    return _keyed(_rgb(spark, sf_dir), fall=grading.vignette(x, y, w, h, 0.6), round_mask=grading.radial_mask(x, y, w, h, (0.4, 0.6), 0.4, 0.3))


@query(LIN_SQL + f"""

select {KEY}, round({UNLIN.format("lr")}, 6) encoded, round(power(greatest(power(lg, 1 / (2523.0 / 32)) - 3424.0 / 4096, 0) / (2413.0 / 128 - 2392.0 / 128 * power(lg, 1 / (2523.0 / 32))), 1 / (2610.0 / 16384)), 6) from_pq,
  round(power(least(greatest(lb * 1.2 + 0.05 * (1 - lb), 0), 1), 1 / 1.1), 6) lgg from n""")
def tone_inverses(spark: SparkSession, sf_dir: str) -> DataFrame:
    linear = _rgb(spark, sf_dir).withColumns({c: colour.srgb_to_linear(F.col(c)) for c in "rgb"})
    return _keyed(linear, encoded=colour.linear_to_srgb(F.col("r")), from_pq=colour.pq_to_linear(F.col("g")), lgg=colour.lift_gamma_gain(F.col("b"), 0.05, 1.1, 1.2))


CAM_SQL = LIN_SQL + f", x as (select *, {_mat(colour.SRGB_TO_XYZ, ('lr', 'lg', 'lb'), ('xx', 'xy', 'xz'))} from n), q as (select *, {_mat(grading.CAT16, ('xx', 'xy', 'xz'), ('q1', 'q2', 'q3'))} from x), k as (select *, cbrt(greatest(q1, 0)) k1, cbrt(greatest(q2, 0)) k2, cbrt(greatest(q3, 0)) k3 from q), j as (select {KEY}, 170 * (0.2 * k1 + 0.7 * k2 + 0.1 * k3) / (1 + 0.7 * (0.2 * k1 + 0.7 * k2 + 0.1 * k3)) j, 50 * (k1 - k2) ja, 50 * (k2 - k3) jb from k)"


@query(CAM_SQL + f" select {KEY}, round(sqrt(power(j - 60, 2) + power(ja - 2, 2) + power(jb - 5, 2)), 6) de from j")
def cam16_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _rgb(spark, sf_dir)
    j, a, b = grading.cam16_ucs(*(colour.srgb_to_linear(F.col(c)) for c in "rgb"))
    seen = rows.select("l_orderkey", "l_linenumber", j.alias("j"), a.alias("a"), b.alias("b"))
    return _keyed(seen, de=colour.delta_e_76((F.col("j"), F.col("a"), F.col("b")), (F.lit(60.0), F.lit(2.0), F.lit(5.0))))


#: The adaptation from 4000 K, tint 20, spelt out as numbers so that the SQL doesn't follow the code.
WB = tuple(tuple(round(x, 9) for x in row) for row in grading.white_balance_matrix(4000.0, 20.0))


@query(LIN_SQL + f", m as (select {KEY}, {_mat(WB, ('lr', 'lg', 'lb'), ('x', 'y', 'z'))} from n) select {KEY}, " + ", ".join(f"round({UNLIN.format(CLIP.format(n))}, 5) {c}" for n, c in zip("xyz", "rgb", strict=True)) + " from m")
def cat16_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    r, g, b = grading.white_balanced(F.col("r"), F.col("g"), F.col("b"), 4000.0, 20.0)
    return _keyed(_rgb(spark, sf_dir), 5, r=r, g=g, b=b)


GAMUT_SQL = OKLAB_SQL.replace("with c", "with recursive c", 1) + f""", h as (select *, cos(atan2(okb, oka)) ch, sin(atan2(okb, oka)) sh from o),
w as (select {KEY}, okl, ch, sh, 0.0::double lo, 0.5::double hi, 0 i from h
  union all select {KEY}, okl, ch, sh, case when ok then mid else lo end, case when ok then hi else mid end, i + 1 from (
    select *, """ + " and ".join(f"({row[0]!r} * t1 * t1 * t1 + ({row[1]!r}) * t2 * t2 * t2 + ({row[2]!r}) * t3 * t3 * t3) between -1e-4 and 1.0001" for row in grading.OKLAB_M1_BACK) + """ ok from (
      select *, """ + ", ".join(f"({row[0]!r} * okl + ({row[1]!r}) * mid * ch + ({row[2]!r}) * mid * sh) t{i + 1}" for i, row in enumerate(grading.OKLAB_M2_BACK)) + """ from (select *, (lo + hi) / 2 mid from w where i < 20))))
"""  # fmt: skip


@query(GAMUT_SQL + f", f as (select * from w where i = 20) select {KEY}, round(case when okl > 0 and okl < 1 then lo else 0 end, 5) most from f")
def gamut_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    polar = _oklab(spark, sf_dir).withColumn("h", F.degrees(F.atan2("okb", "oka")))
    return _keyed(polar, 5, most=grading.gamut_limit(F.col("okl"), F.col("h")))


@query(RGB_SQL + f"""
, k as (select {KEY}, r * 0.5 ch, 0.05 + g * 0.3 m from c), t as (select *, greatest(ch / m - 1, 0) o from k)
select {KEY}, round(least(greatest(m * case when ch <= m then ch / m else 1 + o * power(1 / (1 + power(o / 0.8, 0.6)), 1 / 0.6) end, 0), m), 6) chroma from t""")
def gamut_compress(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _keyed(_rgb(spark, sf_dir), chroma=grading.gamut_compressed(F.col("r") * 0.5, 0.05 + F.col("g") * 0.3))


_W = "least(greatest((sqrt(oka * oka + okb * okb) - 0.008) / 0.032, 0), 1)"
_SUB = "select l_orderkey, l_linenumber, r, g, b, ".join(OKLAB_SQL.rsplit("select l_orderkey, l_linenumber, ", 1)) + f""", e as (select *, least(greatest(okl - 0.2 * sqrt(oka * oka + okb * okb), 0), 1) x, oka * 1.4 y, okb * 1.4 z, {_W} w from o),
d as (select *, {", ".join(f"{t} d{i}" for i, t in enumerate(_matrix(grading.OKLAB_M2_BACK)))} from e), t as (select * replace (d0 * d0 * d0 as x, d1 * d1 * d1 as y, d2 * d2 * d2 as z) from d),
u as (select *, {", ".join(f"{t} u{i}" for i, t in enumerate(_matrix(grading.OKLAB_M1_BACK)))} from t)"""


@query(_SUB + f" select {KEY}, " + ", ".join(f"round({n} * (1 - w) + ({UNLIN.format(CLIP.format(f'u{i}'))}) * w, 5) {n}" for i, n in enumerate("rgb")) + " from u")
def subtractive_saturation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grading.subtractive(_rgb(spark, sf_dir), 0.4).select("l_orderkey", "l_linenumber", *[r6(c, 5).alias(c) for c in "rgb"])


POLAR_SQL = "lab.*, sqrt(a * a + b * b) ch, ((degrees(atan2(b, a)) + 360) % 360) h"


def _lch(spark: SparkSession, sf_dir: str) -> DataFrame:
    chroma, hue = colour.to_polar(F.col("a"), F.col("b"))
    return _lab(spark, sf_dir).withColumns({"ch": chroma, "h": hue})


@query(LAB_SQL + f""", p as (select {POLAR_SQL} from lab)
select {KEY}, round(case when ch > 8 then exp(-power((h - 25) / 25, 2)) else 0 end, 6) skin, round(case when ch > 8 * least(greatest(li / 60, 1.0 / 3), 1) then exp(-power((h - 25) / 25, 2)) else 0 end, 6) relative_skin,
  round({_window("h", 40.0)}, 6) band from p""")
def skin_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = (F.col("li"), F.col("ch"), F.col("h"))
    return _keyed(_lch(spark, sf_dir), skin=grading.skin_membership(*at), relative_skin=grading.skin_membership(*at, reference=60.0), band=colour.hue_range_mask(F.col("h"), 40.0, 30.0, 15.0))


@query(OKLAB_SQL + f""", p as (select o.*, sqrt(oka * oka + okb * okb) ch, ((degrees(atan2(okb, oka)) + 360) % 360) h from o)
select {KEY}, h > 115 and h < 345 and ch >= 0.035 coloured, ch < 0.035 * greatest(okl, 0.2) grey from p""")
def paint_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    coloured, grey = grading.paint_like(F.col("okl"), F.col("oka"), F.col("okb"))
    return _oklab(spark, sf_dir).select("l_orderkey", "l_linenumber", coloured.alias("coloured"), grey.alias("grey"))


#: The pseudo-inverse of [[-0.2, -0.75], [-0.1, 0]]: its exact inverse, [[0, -10], [-4/3, 8/3]].
@query(LIN_SQL + f"""
, d as (select {KEY}, -ln(least(greatest(lr, 1e-5), 1)) + ln(least(greatest(lb, 1e-5), 1)) x, -ln(least(greatest(lg, 1e-5), 1)) + ln(least(greatest(lb, 1e-5), 1)) y from n)
select {KEY}, round(-10 * y, 5) melanin, round(-4.0 / 3 * x + 8.0 / 3 * y, 5) hemoglobin from d""")
def chromophores(spark: SparkSession, sf_dir: str) -> DataFrame:
    melanin, hemoglobin = grading.chromophores(*(colour.srgb_to_linear(F.col(c)) for c in "rgb"))
    return _keyed(_rgb(spark, sf_dir), 5, melanin=melanin, hemoglobin=hemoglobin)


@query(LIN_SQL + f"""
, d as (select {KEY}, -ln(least(greatest(lr, 1e-5), 1)) + ln(least(greatest(lb, 1e-5), 1)) x, -ln(least(greatest(lg, 1e-5), 1)) + ln(least(greatest(lb, 1e-5), 1)) y from n),
e as (select {KEY}, l_orderkey // 256 image, -10 * y m, -4.0 / 3 * x + 8.0 / 3 * y h from d)
select {KEY}, round(m - least(min(m) over (partition by image), 0), 5) melanin, round(h - least(min(h) over (partition by image), 0), 5) hemoglobin from e""")
def chromophore_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    melanin, hemoglobin = grading.chromophores(*(colour.srgb_to_linear(F.col(c)) for c in "rgb"))
    rows = _rgb(spark, sf_dir).select("l_orderkey", "l_linenumber", F.expr("l_orderkey div 256").alias("image"), melanin.alias("melanin"), hemoglobin.alias("hemoglobin"))
    done = grading.lifted_maps(rows, "image", ["melanin", "hemoglobin"])
    return done.select("l_orderkey", "l_linenumber", r6("melanin", 5).alias("melanin"), r6("hemoglobin", 5).alias("hemoglobin"))


@query(f"""
with h as (select {KEY}, l_extendedprice % 360 h from lineitem), d as (select *, {HUE_OFF.format("h", 300)} p, {HUE_OFF.format("h", 120)} g, {HUE_OFF.format("h", 60)} y from h)
select {KEY}, case when p <= g and p <= y then 'purple' when g <= y then 'green' else 'yellow' end phase from d""")
def bruise_phases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _keyed(read(spark, sf_dir, "lineitem"), 0, phase=grading.bruise_phase(F.col("l_extendedprice") % 360))


@query(LAB_SQL + f""", d as (select *, least(1, 6 / greatest(sqrt(power(li - 55, 2) + power(a - 8, 2) + power(b - 12, 2)), 1e-6)) s from lab)
select {KEY}, round(55 + (li - 55) * s, 5) l, round(8 + (a - 8) * s, 5) a, round(12 + (b - 12) * s, 5) b from d""")
def capped_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    light, a, b = grading.capped((F.lit(55.0), F.lit(8.0), F.lit(12.0)), (F.col("li"), F.col("a"), F.col("b")), 6.0)
    return _keyed(_lab(spark, sf_dir), 5, l=light, a=a, b=b)


@query(LAB_SQL + """, m as (select l_orderkey, avg(li * 2.55) m from lab group by 1)
select l_orderkey, round(case when m < 95 or m > 165 then least(greatest(ln(120 / 255.0) / ln(least(greatest(m, 1), 254) / 255), 0.75), 1.25) else 1 end, 6) gamma from m""")
def exposure_gamma(spark: SparkSession, sf_dir: str) -> DataFrame:
    means = _lab(spark, sf_dir).groupBy("l_orderkey").agg(F.avg(F.col("li") * 2.55).alias("m"))
    return means.select("l_orderkey", r6(grading.exposure_gamma(F.col("m"))).alias("gamma"))


@query(LAB_SQL + f""", p as (select {POLAR_SQL} from lab), s as (select l_orderkey, case when ch > 40 then floor(h / 30) % 12 end s, count(*) n from p group by 1, 2),
t as (select l_orderkey, sum(n) al, sum(n) filter (s is not null) v from s group by 1), near as (select l_orderkey, (s + d + 12) % 12 z, sum(n) n from s, (values (-1), (0), (1)) e(d) where s is not null group by 1, 2), b as (select l_orderkey, max(n) top from near group by 1)
select l_orderkey, round(least(1, coalesce(v / al, 0) / 0.12) * (0.5 + 0.5 * coalesce(top / v, 0)), 6) score, round(coalesce(v / al, 0), 6) vivid_share, round(coalesce(top / v, 0), 6) concentration from t left join b using (l_orderkey)""")
def colour_pop(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = grading.colour_pop(_lch(spark, sf_dir).withColumnsRenamed({"ch": "__c", "h": "__h"}), "l_orderkey")
    return found.select("l_orderkey", *[r6(c).alias(c) for c in ("score", "vivid_share", "concentration")])


@query(OKLAB_SQL + """, p as (select o.*, sqrt(oka * oka + okb * okb) ch, degrees(atan2(okb, oka)) h, (l_linenumber % 3) / 2.0 m from o)
select l_orderkey, round(avg(okl), 6) l_mean, round(avg(ch), 6) c_mean, round(stddev_pop(ch), 5) c_std, round(cos(atan2(avg(sin(radians(h))), avg(cos(radians(h))))), 4) h_cos from p where m > 0.3 group by 1""")
def skin_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    chroma, hue = colour.to_polar(F.col("oka"), F.col("okb"))
    pixels = _oklab(spark, sf_dir).select("l_orderkey", F.col("okl").alias("__l"), chroma.alias("__c"), hue.alias("__h"), ((F.col("l_linenumber") % 3) / 2).alias("m"))
    found = grading.skin_state(pixels, "l_orderkey", "m")
    return found.select("l_orderkey", r6("l_mean").alias("l_mean"), r6("c_mean").alias("c_mean"), r6("c_std", 5).alias("c_std"), r6(F.cos(F.radians("h_mean")), 4).alias("h_cos"))


@query(LAB_SQL + " select l_orderkey, round(avg(degrees(atan((li - 50) / b))), 5) ita from lab where abs(b) >= 1e-3 group by 1")
def ita_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    angle = F.degrees(F.atan((F.col("li") - 50) / F.col("b")))
    return _lab(spark, sf_dir).where(F.abs("b") >= 1e-3).groupBy("l_orderkey").agg(r6(F.avg(angle), 5).alias("ita"))
