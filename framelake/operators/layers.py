"""Layers over one another and adjustments from records, over tables of pixels.

A layer at a pixel is a row: ``z`` (its place in the stack), ``r, g, b`` (straight, 0 to 1), ``a`` (coverage times opacity), ``mode`` and ``clip`` (the z of the
layer that it is clipped to, or null).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.colour import clip, linear_to_srgb, srgb_to_linear

#: Layers of a pixel that are merged as one run.
RUN = 64
#: Modes whose result is an affine function of the backdrop, so that neighbours merge before the backdrop is known.
AFFINE = ("Normal", "Multiply", "Screen", "Exclusion")
MOST_RECORDS = 10_000
#: Where a blend jumps, values this near to the corner count as on it.
NEAR = 1e-9
#: Rec. 709 luminance.
LUMINANCE = (0.2126, 0.7152, 0.0722)
KINDS = ("Invert", "Brightness", "Contrast", "Temperature", "Tint", "Saturation", "Vibrance", "Exposure", "Levels", "Gradient Map")

_PIECE = "array<struct<p:array<double>,t:array<double>,q:array<double>,u:double,s:array<double>,a:double,mode:string>>"


def _burn(b: Column, s: Column) -> Column:
    return F.when(s <= NEAR, (b >= 1 - NEAR).cast("double")).otherwise(1 - F.least(F.lit(1.0), (1 - b) / F.nullif(s, F.lit(0.0))))


def _dodge(b: Column, s: Column) -> Column:
    return F.when(s >= 1 - NEAR, (b > NEAR).cast("double")).otherwise(F.least(F.lit(1.0), b / F.nullif(1 - s, F.lit(0.0))))


def _hard(b: Column, s: Column) -> Column:
    return F.when(s <= 0.5, 2 * b * s).otherwise(1 - 2 * (1 - b) * (1 - s))


def _soft(b: Column, s: Column) -> Column:
    bent = F.when(b <= 0.25, ((16 * b - 12) * b + 4) * b).otherwise(F.sqrt(b))
    return F.when(s <= 0.5, b - (1 - 2 * s) * b * (1 - b)).otherwise(b + (2 * s - 1) * (bent - b))


def _vivid(b: Column, s: Column) -> Column:
    return F.when(s <= 0.5, _burn(b, 2 * s)).otherwise(_dodge(b, 2 * s - 1))


#: Blends of a backdrop and a source channel that are not affine in the backdrop.
BLENDS = {
    "Darken": lambda b, s: F.least(b, s), "Color Burn": _burn, "Linear Burn": lambda b, s: F.greatest(F.lit(0.0), b + s - 1), "Lighten": lambda b, s: F.greatest(b, s),
    "Color Dodge": _dodge, "Linear Dodge (Add)": lambda b, s: F.least(F.lit(1.0), b + s), "Overlay": lambda b, s: _hard(s, b), "Soft Light": _soft, "Hard Light": _hard, "Vivid Light": _vivid,
    "Linear Light": lambda b, s: clip(b + 2 * s - 1), "Pin Light": lambda b, s: F.when(s <= 0.5, F.least(b, 2 * s)).otherwise(F.greatest(b, 2 * s - 1)),
    "Hard Mix": lambda b, s: (_vivid(b, s) >= 0.5 - NEAR).cast("double"), "Difference": lambda b, s: F.abs(b - s), "Subtract": lambda b, s: F.greatest(F.lit(0.0), b - s),
    "Divide": lambda b, s: F.when(s <= NEAR, 1.0).otherwise(F.least(F.lit(1.0), b / F.nullif(s, F.lit(0.0)))),
}


def _piece(x: Column) -> Column:
    """A layer as a piece: of an affine mode C' = p C + q A + t and 1 - A' = u (1 - A) for premultiplied C over a backdrop of coverage A; of
    another one its colour, coverage and mode."""
    s, a, mode = x["s"], x["a"], x["mode"]
    kept = F.when(mode == "Multiply", 0.0).otherwise(1.0)
    p = F.transform(s, lambda v: F.when(mode == "Normal", 1 - a).when(mode == "Multiply", 1 - a + a * v).when(mode == "Screen", 1 - a * v).otherwise(1 - 2 * a * v))
    q = F.transform(s, lambda v: -a * v * (1 - kept))
    t = F.transform(s, lambda v: a * v)
    return F.struct(p.alias("p"), t.alias("t"), q.alias("q"), (1 - a).alias("u"), s.alias("s"), a.alias("a"), F.when(~mode.isin(*AFFINE), mode).alias("mode"))


def _zip(f, *arrays: Column) -> Column:
    """``f`` over the elements of arrays of three channels."""
    return F.array(*[f(*[a[i] for a in arrays]) for i in range(3)])


def _merged(x: Column, y: Column) -> Column:
    """The affine piece ``x``, then ``y`` over it, as one."""
    p = _zip(lambda a, b: a * b, y["p"], x["p"])
    q = _zip(lambda yp, yq, xq: yp * xq + yq * x["u"], y["p"], y["q"], x["q"])
    t = _zip(lambda yp, yq, yt, xt: yp * xt + yq * (1 - x["u"]) + yt, y["p"], y["q"], y["t"], x["t"])
    return F.struct(p.alias("p"), t.alias("t"), q.alias("q"), (y["u"] * x["u"]).alias("u"), y["s"].alias("s"), y["a"].alias("a"), F.lit(None).cast("string").alias("mode"))


def _appended(pieces: Column, y: Column) -> Column:
    """``pieces`` with ``y`` behind them, merged into the last one where both are affine."""
    last = F.try_element_at(pieces, F.lit(-1))
    both = last.isNotNull() & last["mode"].isNull() & y["mode"].isNull()
    kept = F.slice(pieces, 1, F.greatest(F.size(pieces) - 1, F.lit(0)))
    return F.when(both, F.concat(kept, F.array(_merged(last, y)))).otherwise(F.concat(pieces, F.array(y)))


def _applied(state: Column, y: Column) -> Column:
    """A backdrop ``c`` (premultiplied) and ``alpha``, with a piece over it."""
    alpha, straight = state["alpha"], lambda c: c / F.when(state["alpha"] > 0, state["alpha"]).otherwise(1.0)

    def blended(b: Column, s: Column) -> Column:
        out = F.lit(None).cast("double")
        for mode, f in BLENDS.items():
            out = F.when(y["mode"] == mode, f(b, s)).otherwise(out)
        return out

    pair = F.transform(F.arrays_zip(state["c"].alias("c"), y["s"].alias("s")), lambda v: (1 - y["a"]) * v["c"] + y["a"] * ((1 - alpha) * v["s"] + alpha * blended(straight(v["c"]), v["s"])))
    affine = _zip(lambda p, q, t, c: p * c + q * alpha + t, y["p"], y["q"], y["t"], state["c"])
    return F.struct(F.when(y["mode"].isNull(), affine).otherwise(pair).alias("c"), (1 - y["u"] * (1 - alpha)).alias("alpha"))


def _over(start: Column, pieces: Column) -> Column:
    kind = "struct<c:array<double>,alpha:double>"
    return F.aggregate(pieces, start.cast(kind), lambda acc, y: _applied(acc, y).cast(kind))


def _runs(rows: DataFrame, keys: list[str], run: int) -> DataFrame:
    """``keys, pieces``: the layers (``__z, s, a, mode``) of each key, bottom first, merged within runs of ``run`` places and then across them.

    Order matters and merging is associative, so runs are tasks' own work and only their pieces meet.
    """
    part = rows.groupBy(*keys, F.floor(F.col("__z") / run).alias("__run")).agg(F.array_sort(F.collect_list(F.struct("__z", "s", "a", "mode"))).alias("x"))
    fold = lambda xs, f: F.aggregate(xs, F.array().cast(_PIECE), lambda acc, v: _appended(acc, f(v)).cast(_PIECE))
    runs = part.select(*keys, "__run", fold(F.col("x"), lambda v: _piece(v).cast(_PIECE[6:-1])).alias("pieces"))
    whole = runs.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("__run", "pieces"))).alias("r"))
    return whole.select(*keys, fold(F.flatten(F.transform("r", lambda v: v["pieces"])), lambda v: v).alias("pieces"))


def composite(layers: DataFrame, keys: list[str], run: int = RUN) -> DataFrame:
    """``keys, r, g, b, a``: the layers of each pixel over one another, straight and from 0 to 1 (black and 0 where nothing covers it).

    Layers clipped to another one are blended into its colour, as if it were opaque, in the order of z, and its coverage and mode then count for all of
    them; those whose base is not there don't show. Rows with a null z, channel or coverage are left out; an unknown mode gives nulls.
    """
    there = layers.dropna(subset=["z", "r", "g", "b", "a"]).select(*keys, "z", F.array("r", "g", "b").cast("array<double>").alias("s"), F.col("a").cast("double").alias("a"), "mode", "clip")
    base = there.where("clip is null").select(*keys, F.col("z").alias("__z"), "s", "a", "mode")
    clipped = there.where("clip is not null").select(*keys, F.col("clip").alias("__base"), F.col("z").alias("__z"), "s", "a", "mode")
    own = _runs(clipped, [*keys, "__base"], run).withColumnRenamed("__base", "__z")
    met = base.join(own, [*keys, "__z"], "left")
    start = F.struct(F.col("s").alias("c"), F.lit(1.0).alias("alpha"))
    filled = F.when(F.col("pieces").isNull(), F.col("s")).otherwise(_over(start, F.col("pieces"))["c"])
    stacks = met.select(*keys, "__z", filled.alias("s"), "a", "mode")
    empty = F.struct(F.array(*[F.lit(0.0)] * 3).alias("c"), F.lit(0.0).alias("alpha"))
    done = _runs(stacks, keys, run).select(*keys, _over(empty, F.col("pieces")).alias("x"))
    channel = lambda i: F.when(F.col("x.alpha") > 0, clip(F.col("x.c")[i] / F.nullif(F.col("x.alpha"), F.lit(0.0)))).otherwise(F.when(F.col("x.alpha").isNotNull(), 0.0))
    return done.select(*keys, *[channel(i).alias(c) for i, c in enumerate("rgb")], F.col("x.alpha").alias("a"))


def _number(name: str, otherwise: float) -> Column:
    return F.coalesce(F.col("settings")[name], F.lit(float(otherwise)))


def _gains() -> Column:
    """Channel gains of the white-balance kinds, which keep the luminance of greys."""
    t = F.when(F.col("kind") == "Temperature", _number("temperature", 0)).otherwise(_number("tint", 0)) / 100
    warm = F.array(1 + 0.3 * t, F.lit(1.0), 1 - 0.3 * t)
    green = F.array(1 - 0.15 * t, 1 + 0.3 * t, 1 - 0.15 * t)
    gains = F.when(F.col("kind") == "Temperature", warm).otherwise(green)
    total = sum((gains[i] * w for i, w in enumerate(LUMINANCE)), F.lit(0.0))
    return F.when(total > 0, F.transform(gains, lambda g: g / total)).otherwise(F.array(*[F.lit(1.0)] * 3))


def compiled(records: DataFrame) -> DataFrame:
    """``record, program, gain, shift, settings`` of records (``record, kind, settings``: a map of numbers by name).

    Kinds that are linear in a channel become one program, ``linear``, with a gain and a shift a channel; the others are a program each. A missing setting counts
    as one that changes nothing; unknown kinds are left out.
    """
    kind = F.col("kind")
    contrast = 1 + _number("contrast", 0) / 100
    three = lambda v: F.array(v, v, v)
    gain = F.when(kind == "Invert", three(F.lit(-1.0))).when(kind == "Contrast", three(contrast)).when(kind.isin("Temperature", "Tint"), _gains()).otherwise(three(F.lit(1.0)))
    shift = F.when(kind == "Invert", 1.0).when(kind == "Brightness", _number("brightness", 0) / 100).when(kind == "Contrast", 0.5 - 0.5 * contrast).otherwise(0.0)
    program = F.when(kind.isin("Invert", "Brightness", "Contrast", "Temperature", "Tint"), "linear").when(kind.isin(*KINDS), kind)
    return records.select("record", program.alias("program"), gain.alias("gain"), shift.alias("shift"), "settings").where("program is not null")


def _saturated(scale: Column) -> tuple[Column, Column, Column]:
    """HSL saturation times ``scale``, which moves the channels from or towards the lightness."""
    r, g, b = (F.col(c) for c in "rgb")
    high, low = F.greatest(r, g, b), F.least(r, g, b)
    light, span = (high + low) / 2, high - low
    s = span / F.nullif(F.when(light > 0.5, 2 - high - low).otherwise(high + low), F.lit(0.0))
    ratio = F.coalesce(clip(s * scale) / F.nullif(s, F.lit(0.0)), F.lit(1.0))
    return tuple(light + (c - light) * ratio for c in (r, g, b))


def _vibrance() -> tuple[Column, Column, Column]:
    high, low = F.greatest("r", "g", "b"), F.least("r", "g", "b")
    headroom = 1 - F.coalesce((high - low) / F.nullif(high, F.lit(0.0)), F.lit(0.0))
    return _saturated(1 + F.log1p(headroom * 9) / F.log1p(F.lit(9.0)) * _number("vibrance", 0) / 100)


def _exposed(x: Column) -> Column:
    linear = F.greatest(F.lit(0.0), srgb_to_linear(x) * F.pow(F.lit(2.0), _number("exposure", 0)) + _number("offset", 0))
    return clip(linear_to_srgb(F.pow(linear, 1 / _number("gamma", 1))))


def _levelled(x: Column) -> Column:
    black, low = _number("black", 0), _number("output_black", 0)
    inside = clip((x * 255 - black) / (_number("white", 255) - black))
    return (low + F.pow(inside, 1 / _number("gamma", 1)) * (_number("output_white", 255) - low)) / 255


def _mapped() -> tuple[Column, ...]:
    """The colour between a dark and a light end that belongs to a pixel's luminance, in bytes."""
    level = F.floor((sum((F.rint(clip(F.col(c)) * 255) * round(w * 10_000) for c, w in zip("rgb", LUMINANCE, strict=True)), F.lit(0.0)) + 5000) / 10_000)
    t = F.least(level, F.lit(255)) / 255
    ends = lambda c: (_number(f"dark_{c}", 0), _number(f"light_{c}", 1))
    return tuple(F.least(F.greatest(F.rint((d + (e - d) * t) * 255), F.lit(0.0)), F.lit(255.0)) / 255 for d, e in map(ends, "rgb"))


#: What a program makes of the columns ``r, g, b`` of a pixel that has met its record.
PROGRAMS = {
    "linear": lambda: tuple(clip(F.col(c) * F.col("gain")[i] + F.col("shift")) for i, c in enumerate("rgb")),
    "Saturation": lambda: _saturated((100 + _number("saturation", 0)) / 100), "Vibrance": _vibrance,
    "Exposure": lambda: tuple(_exposed(F.col(c)) for c in "rgb"), "Levels": lambda: tuple(_levelled(F.col(c)) for c in "rgb"), "Gradient Map": _mapped,
}


def adjusted(pixels: DataFrame, records: DataFrame) -> DataFrame:
    """``pixels`` (``record, r, g, b`` and others) with the channels as their record's adjustment leaves them.

    Records are compiled once; a pixel meets its record in a join, and each program that occurs is one expression over the pixels that
    ask for it. Pixels without a record that is known stay as they are. Up to ``MOST_RECORDS`` records are broadcast; their ids must be unique.
    """
    ready = compiled(records)
    small = ready.limit(MOST_RECORDS + 1).count() <= MOST_RECORDS
    met = pixels.join(F.broadcast(ready) if small else ready, "record", "left")
    rest = [c for c in pixels.columns if c not in "rgb"]
    out = met.where("program is null").select(*rest, "r", "g", "b")
    for program in [r["program"] for r in ready.select("program").distinct().collect()]:  # at most one a program
        out = out.unionByName(met.where(F.col("program") == program).select(*rest, *[v.alias(c) for v, c in zip(PROGRAMS[program](), "rgb", strict=True)]))
    return out.select(*pixels.columns)
