"""Compositing and adjustment records against plain loops over layers and pixels."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from framelake.operators import layers

MODES = [*layers.AFFINE, *layers.BLENDS]


def blend(b, s, mode):
    burn = lambda b, s: float(b >= 1) if s <= 0 else 1 - min(1, (1 - b) / s)
    dodge = lambda b, s: float(b > 0) if s >= 1 else min(1, b / (1 - s))
    hard = lambda b, s: 2 * b * s if s <= 0.5 else 1 - 2 * (1 - b) * (1 - s)
    vivid = lambda b, s: burn(b, 2 * s) if s <= 0.5 else dodge(b, 2 * s - 1)
    bent = ((16 * b - 12) * b + 4) * b if b <= 0.25 else b**0.5
    return {
        "Normal": lambda: s, "Multiply": lambda: b * s, "Screen": lambda: b + s - b * s, "Exclusion": lambda: b + s - 2 * b * s, "Darken": lambda: min(b, s), "Lighten": lambda: max(b, s),
        "Color Burn": lambda: burn(b, s), "Color Dodge": lambda: dodge(b, s), "Linear Burn": lambda: max(0, b + s - 1), "Linear Dodge (Add)": lambda: min(1, b + s), "Overlay": lambda: hard(s, b),
        "Hard Light": lambda: hard(b, s), "Soft Light": lambda: b - (1 - 2 * s) * b * (1 - b) if s <= 0.5 else b + (2 * s - 1) * (bent - b), "Vivid Light": lambda: vivid(b, s),
        "Linear Light": lambda: min(max(b + 2 * s - 1, 0), 1), "Pin Light": lambda: min(b, 2 * s) if s <= 0.5 else max(b, 2 * s - 1), "Hard Mix": lambda: float(vivid(b, s) >= 0.5),
        "Difference": lambda: abs(b - s), "Subtract": lambda: max(0, b - s), "Divide": lambda: 1 if s <= 0 else min(1, b / s),
    }[mode]()


def over(c, alpha, s, a, mode):
    b = [x / alpha if alpha > 0 else 0.0 for x in c]
    mixed = [(1 - alpha) * v + alpha * blend(min(max(x, 0.0), 1.0), v, mode) for x, v in zip(b, s, strict=True)]
    return [x * (1 - a) + v * a for x, v in zip(c, mixed, strict=True)], alpha * (1 - a) + a


def brute(rows):
    out = {}
    for px in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == px), key=lambda r: r[1])
        c, alpha = [0.0] * 3, 0.0
        for _, z, *s, a, mode, clip in own:
            if clip is not None:
                continue
            inner, full = s, 1.0
            for _, _, *cs, ca, cmode, cclip in own:
                if cclip == z:
                    inner, full = over(inner, full, cs, ca, cmode)
            c, alpha = over(c, alpha, inner, a, mode)
        if any(r[7] is None for r in own):
            out[px] = [*[x / alpha if alpha > 0 else 0.0 for x in c], alpha]
    return out


@pytest.mark.parametrize("run", [1, 3, 64])
@pytest.mark.parametrize("modes", [layers.AFFINE, MODES])
def test_composite(spark, run, modes):
    rng = random.Random(len(modes))
    rows = []
    for px in range(40):
        bases = []
        for z in range(rng.randint(1, 12)):
            clip = rng.choice(bases) if bases and rng.random() < 0.3 else None
            if clip is None:
                bases.append(z)
            value = lambda: rng.choice([rng.random(), 0.3, 0.7])
            rows.append((px, z, value(), value(), value(), rng.choice([0.0, 0.25, rng.random(), 1.0]), rng.choice(modes), clip))
    rows += [(900, 3, 0.2, 0.4, 0.6, 0.5, "Normal", None), (900, 4, 1.0, 1.0, 1.0, 1.0, "Normal", 77), (901, 1, 0.5, 0.5, 0.5, 1.0, "Normal", 0)]
    schema = "px long, z long, r double, g double, b double, a double, mode string, clip long"
    df = spark.createDataFrame([*rows, (900, None, 0.1, 0.1, 0.1, 1.0, "Normal", None), (900, 9, None, 0.1, 0.1, 1.0, "Normal", None)], schema).repartition(4)
    got = {r.px: [r.r, r.g, r.b, r.a] for r in layers.composite(df, ["px"], run).collect()}
    want = brute(rows)
    assert got.keys() == want.keys()
    for px, values in want.items():
        assert got[px] == pytest.approx(values, abs=1e-7), px


def test_runs_of_affine_layers_are_one_piece(spark):
    df = spark.range(50).select(F.lit(1).alias("px"), F.col("id").alias("__z"), F.array(*[F.lit(0.3)] * 3).alias("s"), F.lit(0.1).alias("a"), F.lit("Screen").alias("mode"))
    assert [len(r.pieces) for r in layers._runs(df, ["px"], 8).collect()] == [1]


def brute_adjusted(kind, s, rgb):
    rgb = np.array(rgb)
    get = lambda n, d: s.get(n, d)
    if kind == "Invert":
        return 1 - rgb
    if kind == "Brightness":
        return np.clip(rgb + get("brightness", 0) / 100, 0, 1)
    if kind == "Contrast":
        return np.clip(0.5 + (rgb - 0.5) * (1 + get("contrast", 0) / 100), 0, 1)
    if kind in ("Temperature", "Tint"):
        t = get(kind.lower(), 0) / 100
        gains = np.array([1 + 0.3 * t, 1, 1 - 0.3 * t]) if kind == "Temperature" else np.array([1 - 0.15 * t, 1 + 0.3 * t, 1 - 0.15 * t])
        return np.clip(rgb * gains / gains.dot(layers.LUMINANCE), 0, 1)
    if kind == "Saturation":
        high, low = rgb.max(), rgb.min()
        light, span = (high + low) / 2, high - low
        if span == 0:
            return rgb
        sat = span / (2 - high - low if light > 0.5 else high + low)
        return light + (rgb - light) * min(max(sat * (100 + get("saturation", 0)) / 100, 0), 1) / sat
    return rgb


def test_records_are_applied_by_join(spark):
    rng = random.Random(8)
    kinds = ["Invert", "Brightness", "Contrast", "Temperature", "Tint", "Saturation", "Sharpen"]
    records = [(i, k, {k.lower(): float(rng.randint(-90, 90))} if k != "Invert" and i % 5 else {}) for i, k in enumerate(kinds * 3)]
    pixels = [(j, rng.choice([*range(len(records)), 99, None]), rng.random(), rng.random(), rng.choice([0.5, rng.random()])) for j in range(300)] + [(300, 5, 0.4, 0.4, 0.4)]
    df = spark.createDataFrame(pixels, "j long, record long, r double, g double, b double")
    held = spark.createDataFrame(records, "record long, kind string, settings map<string,double>")
    got = {r.j: (r.r, r.g, r.b) for r in layers.adjusted(df, held).collect()}
    known = {i: (k, s) for i, k, s in records}
    for j, record, *rgb in pixels:
        kind, settings = known.get(record, (None, {}))
        assert got[j] == pytest.approx(tuple(brute_adjusted(kind, settings, rgb)), abs=1e-9), (j, kind, settings)
    program = {r.record: r.program for r in layers.compiled(held).collect()}
    assert set(program.values()) == {"linear", "Saturation"} and 6 not in program
