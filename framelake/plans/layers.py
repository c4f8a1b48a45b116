"""Layers and adjustment records on the driver's tables: an order is a pixel, its line items are the layers over it; parts are records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import layers
from .catalogue import query, r6, read

MODES = [*layers.AFFINE, *layers.BLENDS]

#: Layers: of repeated line numbers the largest part; every third line number is clipped to the nearest lower one that isn't.
LAYERS = f"""l as (select l_orderkey px, l_linenumber::bigint z, arg_max(l_quantity / 50, l_partkey * 1000 + l_quantity) r, arg_max(l_discount * 10, l_partkey * 1000 + l_quantity) g, arg_max(l_tax * 12.5, l_partkey * 1000 + l_quantity) b, max(l_partkey) k from lineitem group by 1, 2),
y as (select px, z, r::double r, g::double g, b::double b, ((k % 9 + 1) / 9.0)::double a, {MODES}[(k % {len(MODES)} + 1)::int] mode, case when z % 3 = 0 then max(case when z % 3 <> 0 then z end) over (partition by px order by z) end clip from l)"""


def _blend(b: str, s: str, mode: str) -> str:
    burn = lambda b, s: f"(case when {s} <= 1e-9 then ({b} >= 1 - 1e-9)::int::double else 1 - least(1, (1 - {b}) / nullif({s}, 0)) end)"
    dodge = lambda b, s: f"(case when {s} >= 1 - 1e-9 then ({b} > 1e-9)::int::double else least(1, {b} / nullif(1 - ({s}), 0)) end)"
    hard = lambda b, s: f"(case when {s} <= 0.5 then 2 * {b} * {s} else 1 - 2 * (1 - {b}) * (1 - {s}) end)"
    vivid = f"(case when {s} <= 0.5 then {burn(b, f'(2 * {s})')} else {dodge(b, f'(2 * {s} - 1)')} end)"
    cases = {
        "Normal": s, "Multiply": f"{b} * {s}", "Screen": f"{b} + {s} - {b} * {s}", "Exclusion": f"{b} + {s} - 2 * {b} * {s}", "Darken": f"least({b}, {s})", "Color Burn": burn(b, s),
        "Linear Burn": f"greatest(0, {b} + {s} - 1)", "Lighten": f"greatest({b}, {s})", "Color Dodge": dodge(b, s), "Linear Dodge (Add)": f"least(1, {b} + {s})", "Overlay": hard(s, b), "Hard Light": hard(b, s),
        "Soft Light": f"(case when {s} <= 0.5 then {b} - (1 - 2 * {s}) * {b} * (1 - {b}) else {b} + (2 * {s} - 1) * (case when {b} <= 0.25 then ((16 * {b} - 12) * {b} + 4) * {b} else sqrt({b}) end - {b}) end)",
        "Vivid Light": vivid, "Linear Light": f"least(greatest({b} + 2 * {s} - 1, 0), 1)", "Pin Light": f"(case when {s} <= 0.5 then least({b}, 2 * {s}) else greatest({b}, 2 * {s} - 1) end)",
        "Hard Mix": f"({vivid} >= 0.5 - 1e-9)::int", "Difference": f"abs({b} - {s})", "Subtract": f"greatest(0, {b} - {s})", "Divide": f"(case when {s} <= 1e-9 then 1 else least(1, {b} / nullif({s}, 0)) end)",
    }
    return f"(case {mode} " + " ".join(f"when '{k}' then {v}" for k, v in cases.items()) + " end)::double"


def _fold(name: str, rows: str, start: str, keys: str) -> str:
    """A recursion over the numbered layers of ``rows`` from the rows of ``start`` (keys, i, cr, cg, cb, al)."""
    on = " and ".join(f"x.{k} = f.{k}" for k in keys.split(", "))
    own = ", ".join(f"f.{k}" for k in keys.split(", "))
    straight = lambda c: f"greatest(0, f.c{c} / case when f.al > 0 then f.al else 1 end)"
    step = ", ".join(f"(1 - x.a) * f.c{c} + x.a * ((1 - f.al) * x.{c} + f.al * {_blend(straight(c), 'x.' + c, 'x.mode')})" for c in "rgb")
    return f"""{name} as ({start} union all select {own}, x.i, {step}, 1 - (1 - x.a) * (1 - f.al) from {name} f join {rows} x on {on} and x.i = f.i + 1)"""


@query(f"""
with recursive {LAYERS},
c as (select px, clip base, r, g, b, a, mode, row_number() over (partition by px, clip order by z) i from y where clip is not null),
{_fold("fc", "c", "select px, z base, 0::bigint i, r cr, g cg, b cb, 1.0::double al from y where clip is null", "px, base")},
w as (select px, base, cr, cg, cb from fc qualify row_number() over (partition by px, base order by i desc) = 1),
s as (select y.px, cr r, cg g, cb b, a, mode, row_number() over (partition by y.px order by z) i from y join w on w.px = y.px and w.base = y.z),
{_fold("fs", "s", "select px, 0::bigint i, 0.0::double cr, 0.0::double cg, 0.0::double cb, 0.0::double al from (select distinct px from s)", "px")},
d as (select * from fs qualify row_number() over (partition by px order by i desc) = 1)
select px, {", ".join(f"round(case when al > 0 then least(greatest(c{c} / al, 0), 1) else 0 end, 7) {c}" for c in "rgb")}, round(al, 7) a from d""")
def layer_composite(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    order = F.col("l_partkey") * 1000 + F.col("l_quantity")
    pick = lambda v, n: F.max_by(v, order).cast("double").alias(n)
    each = read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("px"), F.col("l_linenumber").cast("long").alias("z"))
    rows = each.agg(pick(F.col("l_quantity") / 50, "r"), pick(F.col("l_discount") * 10, "g"), pick(F.col("l_tax") * 12.5, "b"), F.max("l_partkey").alias("k"))
    base = F.max(F.when(F.col("z") % 3 != 0, F.col("z"))).over(Window.partitionBy("px").orderBy("z"))
    mode = F.element_at(F.array(*map(F.lit, MODES)), (F.col("k") % len(MODES) + 1).cast("int"))
    stack = rows.select("px", "z", "r", "g", "b", ((F.col("k") % 9 + 1) / 9).alias("a"), mode.alias("mode"), F.when(F.col("z") % 3 == 0, base).alias("clip"))
    return layers.composite(stack, ["px"], run=4).select("px", *[r6(c, 7).alias(c) for c in "rgba"])


SETTINGS = {
    "Invert": {}, "Brightness": {"brightness": "k % 61 - 30"}, "Contrast": {"contrast": "k % 91 - 40"}, "Temperature": {"temperature": "k % 101 - 50"}, "Tint": {"tint": "k % 81 - 40"},
    "Saturation": {"saturation": "k % 151 - 100"}, "Vibrance": {"vibrance": "k % 121 - 60"}, "Exposure": {"exposure": "k % 5 - 2", "offset": "k % 3 / 50.0", "gamma": "1 + k % 4 / 4.0"},
    "Levels": {"black": "k % 40", "white": "200 + k % 50", "gamma": "0.5 + k % 6 / 5.0", "output_black": "k % 7", "output_white": "255 - k % 9"},
    "Gradient Map": {"dark_r": "k % 3 / 10.0", "dark_g": "0.1", "dark_b": "0.3", "light_r": "1", "light_g": "0.9", "light_b": "k % 5 / 5.0"},
}
_NAMES = list(SETTINGS)
_SAT = "(case when hi = lo then 1 else least(greatest(sat * ({0}), 0), 1) / nullif(sat, 0) end)"


def _graded(c: str, i: int) -> str:
    of = lambda kind, name: f"({SETTINGS[kind][name]})"
    weight = layers.LUMINANCE
    gain = {"Temperature": ("1 + 0.3 * t", "1", "1 - 0.3 * t"), "Tint": ("1 - 0.15 * t", "1 + 0.3 * t", "1 - 0.15 * t")}
    balance = {k: f"least(greatest({c} * ({g[i]}) / ({' + '.join(f'{w} * ({x})' for w, x in zip(weight, g, strict=True))}), 0), 1)".replace(" t)", f" ({of(k, k.lower())} / 100.0))") for k, g in gain.items()}
    linear = f"(case when {c} <= 0.04045 then {c} / 12.92 else power(({c} + 0.055) / 1.055, 2.4) end)"
    exposed = f"power(greatest(0, {linear} * power(2.0, {of('Exposure', 'exposure')}) + {of('Exposure', 'offset')}), 1 / {of('Exposure', 'gamma')})"
    levels = {k: of("Levels", k) for k in SETTINGS["Levels"]}
    light = "((hi + lo) / 2)"
    level = "floor((round_even(r * 255, 0) * 2126 + round_even(g * 255, 0) * 7152 + round_even(b * 255, 0) * 722 + 5000) / 10000)"
    dark, bright = of("Gradient Map", f"dark_{c}"), of("Gradient Map", f"light_{c}")
    cases = {
        "Invert": f"1 - {c}", "Brightness": f"least(greatest({c} + {of('Brightness', 'brightness')} / 100.0, 0), 1)", "Contrast": f"least(greatest(0.5 + ({c} - 0.5) * (1 + {of('Contrast', 'contrast')} / 100.0), 0), 1)", **balance,
        "Saturation": f"{light} + ({c} - {light}) * " + _SAT.format(f"(100 + {of('Saturation', 'saturation')}) / 100.0"),
        "Vibrance": f"{light} + ({c} - {light}) * " + _SAT.format(f"1 + ln(1 + (1 - coalesce((hi - lo) / nullif(hi, 0), 0)) * 9) / ln(10) * {of('Vibrance', 'vibrance')} / 100.0"),
        "Exposure": f"least(greatest(case when {exposed} <= 0.0031308 then 12.92 * {exposed} else 1.055 * power({exposed}, 1 / 2.4) - 0.055 end, 0), 1)",
        "Levels": f"({levels['output_black']} + power(least(greatest(({c} * 255 - {levels['black']}) / ({levels['white']} - {levels['black']}), 0), 1), 1 / {levels['gamma']}) * ({levels['output_white']} - {levels['output_black']})) / 255.0",
        "Gradient Map": f"least(greatest(round_even(({dark} + ({bright} - {dark}) * (least({level}, 255) / 255.0)) * 255, 0), 0), 255) / 255.0",
    }
    return f"round((case kind " + " ".join(f"when '{k}' then {v}" for k, v in cases.items()) + f" else {c} end)::double, 7) {c}"  # noqa: F541


@query(f"""
with c as (select l_orderkey, l_linenumber, l_quantity / 50 r, l_discount * 10 g, l_tax * 12.5 b, l_partkey k, case when l_partkey % 12 < {len(_NAMES)} then {_NAMES}[(l_partkey % 12 + 1)::int] end kind from lineitem),
h as (select *, greatest(r, g, b) hi, least(r, g, b) lo, (greatest(r, g, b) - least(r, g, b)) / nullif(case when greatest(r, g, b) + least(r, g, b) > 1 then 2 - greatest(r, g, b) - least(r, g, b) else greatest(r, g, b) + least(r, g, b) end, 0) sat from c)
select l_orderkey, l_linenumber, {", ".join(_graded(c, i) for i, c in enumerate("rgb"))} from h""")
def adjustment_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = "p_partkey % 12"
    settings = [f"when {k} = {i} then map({', '.join(f'{chr(39)}{n}{chr(39)}, cast(' + v.replace('k ', 'p_partkey ') + ' as double)' for n, v in SETTINGS[name].items())})" for i, name in enumerate(_NAMES)]
    kind = F.expr(f"case when {k} < {len(_NAMES)} then element_at(array({', '.join(repr(n) for n in _NAMES)}), cast({k} as int) + 1) end")
    records = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("record"), kind.alias("kind"), F.expr(f"case {' '.join(settings)} end".replace("map()", "cast(map() as map<string,double>)")).alias("settings"))
    pixels = read(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", F.col("l_partkey").alias("record"), (F.col("l_quantity") / 50).alias("r"), (F.col("l_discount") * 10).alias("g"), (F.col("l_tax") * 12.5).alias("b")
    )
    done = layers.adjusted(pixels, records)
    return done.select("l_orderkey", "l_linenumber", *[r6(c, 7).alias(c) for c in "rgb"])
