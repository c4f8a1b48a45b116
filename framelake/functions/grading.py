"""Grades of pixels: edits in a colour space, as columns of a table of pixels.

A pixel is a row with ``r, g, b`` in 0..1. ``in_space`` leads the channels into a space, applies an edit
to its three columns and leads back; each step is a projection of its own, so no expression is written out many times over.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import colour
from .colour import clip

Triple = tuple[Column, Column, Column]
Edit = Callable[[Column, Column, Column], Triple]

_inverse = lambda m: tuple(map(tuple, np.linalg.inv(np.array(m)).tolist()))
OKLAB_M1_BACK, OKLAB_M2_BACK, XYZ_TO_SRGB = _inverse(colour.OKLAB_M1), _inverse(colour.OKLAB_M2), _inverse(colour.SRGB_TO_XYZ)
#: The CAT16 cone responses.
CAT16 = ((0.401288, 0.650173, -0.051461), (-0.250268, 1.204414, 0.045854), (-0.002079, 0.048952, 0.953127))
#: Hue bands of an HSL table (half degrees) and of single channels (degrees, width).
HUE_BANDS = {"red": 0.0, "orange": 14.0, "yellow": 27.0, "green": 57.0, "cyan": 92.0, "blue": 122.0, "purple": 148.0, "magenta": 156.0}
CHANNELS = {"red": 0.0, "orange": 30.0, "yellow": 60.0, "green": 120.0, "aqua": 180.0, "blue": 240.0, "purple": 280.0, "magenta": 320.0}
#: Optical densities of melanin and hemoglobin in R, G, B.
MELANIN, HEMOGLOBIN = (0.1, 0.2, 0.3), (-0.5, 0.25, 0.25)

_times = colour._times


def rgb_to_hsv(r: Column, g: Column, b: Column) -> Triple:
    """Hue in degrees, saturation and value."""
    high, low = F.greatest(r, g, b), F.least(r, g, b)
    span = high - low
    turn = F.when(high == r, (g - b) / F.nullif(span, F.lit(0.0))).when(high == g, 2 + (b - r) / F.nullif(span, F.lit(0.0))).otherwise(4 + (r - g) / F.nullif(span, F.lit(0.0)))
    return F.when(span == 0, 0.0).otherwise(F.pmod(turn * 60, F.lit(360.0))), F.coalesce(span / F.nullif(high, F.lit(0.0)), F.lit(0.0)), high


def hsv_to_rgb(h: Column, s: Column, v: Column) -> Triple:
    def channel(n: int) -> Column:
        k = F.pmod(h / 60 + n, F.lit(6.0))
        return v - v * s * clip(F.least(k, 4 - k))

    return channel(5), channel(3), channel(1)


def lab_to_linear(light: Column, a: Column, b: Column) -> Triple:
    """Linear sRGB of CIE L*a*b* under D65, not clipped."""
    back = lambda t: F.when(t > 6 / 29, t * t * t).otherwise((116 * t - 16) * (27 / 24389))
    y = (light + 16) / 116
    return _times(XYZ_TO_SRGB, tuple(w * back(t) for t, w in zip((y + a / 500, y, y - b / 200), colour.D65, strict=True)))


def oklab_to_linear(light: Column, a: Column, b: Column) -> Triple:
    """Linear sRGB of OKLab, not clipped."""
    return _times(OKLAB_M1_BACK, tuple(x * x * x for x in _times(OKLAB_M2_BACK, (light, a, b))))


def _named(df: DataFrame, values: Triple) -> DataFrame:
    return df.withColumns({f"__{i}": v for i, v in enumerate(values)})


def in_space(pixels: DataFrame, space: str, edit: Edit) -> DataFrame:
    """``pixels`` with r, g, b after an edit in ``hsv``, ``lab``, ``lch``, ``oklab`` or ``oklch`` (hues in degrees), held to 0..1."""
    c = tuple(F.col(f"__{i}") for i in range(3))
    df = _named(pixels, tuple(clip(F.col(x)) for x in "rgb"))
    if space == "hsv":
        df = _named(_named(_named(df, rgb_to_hsv(*c)), edit(*c)), hsv_to_rgb(*c))
    else:
        forth, back = (colour.linear_to_lab, lab_to_linear) if space in ("lab", "lch") else (colour.linear_to_oklab, oklab_to_linear)
        df = _named(_named(df, tuple(colour.srgb_to_linear(x) for x in c)), forth(*c))
        if space.endswith("lch"):
            df = _named(df, (c[0], *colour.to_polar(c[1], c[2])))
        df = _named(df, edit(*c))
        if space.endswith("lch"):
            df = _named(df, (c[0], *colour.from_polar(c[1], c[2])))
        df = _named(_named(df, back(*c)), tuple(colour.linear_to_srgb(x) for x in c))
    return df.withColumns({n: clip(x) for n, x in zip("rgb", c, strict=True)}).drop("__0", "__1", "__2")


def curve(x: Column, points: list[tuple[float, float]]) -> Column:
    """Piecewise-linear curve through ascending control points; constant beyond the ends."""
    out = F.when(x <= points[0][0], F.lit(float(points[0][1])))
    for (x0, y0), (x1, y1) in zip(points, points[1:], strict=False):
        out = out.when(x <= x1, y0 + (x - x0) * ((y1 - y0) / (x1 - x0)))
    return out.otherwise(F.lit(float(points[-1][1])))


# --- edits in HSV -------------------------------------------------------------------------------


def saturated(boost: float) -> Edit:
    """More for less saturated pixels."""
    return lambda h, s, v: (h, clip(s * (1 + boost * (1 - s))), v)


def vibrance(strength: float, protect_skin: bool = True) -> Edit:
    """As ``saturated``; skin hues (below 50 and above 320 degrees) never get more than a damped share."""

    def edit(h: Column, s: Column, v: Column) -> Triple:
        factor = 1 + strength * (1 - s)
        most, at = min(max(1 - strength * 0.5, 0.5), 1.0), F.round(h, 9)  # so that the limits don't hang on the last bit
        held = F.when(((at > 0) & (at < 50)) | (at > 320), F.least(factor, F.lit(most))).otherwise(factor)
        return h, clip(s * (held if protect_skin else factor)), v

    return edit


def calibrated(shifts: dict[str, tuple[float, float]]) -> Edit:
    """Hue and saturation shifts of the primaries ``red``, ``green``, ``blue``, each with a bell of 30 degrees around it."""

    def edit(h: Column, s: Column, v: Column) -> Triple:
        turn, scale = F.lit(0.0), F.lit(1.0)
        for name, (hue, sat) in shifts.items():
            off = colour.hue_distance(h, {"red": 0.0, "green": 120.0, "blue": 240.0}[name]) / 30.0
            bell = F.exp(-off * off / 2)
            turn, scale = turn + bell * (hue * 0.15), scale + bell * (sat * 0.005)
        return F.pmod(h + turn, F.lit(360.0)), clip(s * scale), v

    return edit


def hsl_table(shifts: dict[str, tuple[float, float, float]]) -> Edit:
    """Hue (degrees), saturation and value (of 255) shifts by bands, one after another, each with a bell of 20 degrees."""

    def edit(h: Column, s: Column, v: Column) -> Triple:
        for name, (hue, sat, lum) in shifts.items():
            off = colour.hue_distance(h, HUE_BANDS[name] * 2) / 20.0
            bell = F.exp(-off * off / 2)
            near = bell > 0.01
            h, s, v = (
                F.pmod(h + bell * hue, F.lit(360.0)),
                F.when(near, clip(s + bell * (sat / 255))).otherwise(s), F.when(near, clip(v + bell * (lum / 255))).otherwise(v),
            )
        return h, s, v

    return edit


# --- edits in Lab and LCh -----------------------------------------------------------------------


def warmer(warmth: float) -> Edit:
    return lambda light, a, b: (light, clip(a + warmth * 10, -128, 127), clip(b + warmth * 30, -128, 127))


def lifted_shadows(lift: float) -> Edit:
    """Lift (of 255) that fades out towards half of the lightness."""
    return lambda light, a, b: (clip(light + clip(1 - light * (255 / 100) / 128) * (lift * 100 / 255), 0, 100), a, b)


def faded_toe(strength: float) -> Edit:
    """Lifted blacks without a change of hue."""
    return lambda light, a, b: (light + clip(1 - light / 50) * (strength * 20), a, b)


def luminance_curve(points: list[tuple[float, float]]) -> Edit:
    """Curve over lightness, both of 255."""
    return lambda light, a, b: (clip(curve(light * 2.55, points) / 2.55, 0, 100), a, b)


def three_way(shadows: tuple[float, float], midtones: tuple[float, float], highlights: tuple[float, float], balance: float = 0.0) -> Edit:
    """Tints (hue in degrees, saturation of 100) of shadows, midtones and highlights, which soft steps of lightness tell apart."""

    def edit(light: Column, a: Column, b: Column) -> Triple:
        x, shift = light / 100, balance / 100 * 0.2
        step = lambda at: 1 / (1 + F.exp(-(x - (at + shift)) * 10))
        low, high = 1 - step(0.3), step(0.7)
        weights = (low, clip(1 - low - high), high)
        tints = [(sat / 4 * math.cos(math.radians(hue)), sat / 4 * math.sin(math.radians(hue))) for hue, sat in (shadows, midtones, highlights)]
        add = lambda k: sum((w * t[k] for w, t in zip(weights, tints, strict=True)), F.lit(0.0))
        return light, clip(a + add(0), -128, 127), clip(b + add(1), -128, 127)

    return edit


def master_hsl(hue: float, saturation: float, light_shift: float) -> Edit:
    return lambda light, c, h: (clip(light + light_shift, 0, 100), c * saturation, F.pmod(h + hue, F.lit(360.0)))


def channel_hsl(channel: str, hue: float, saturation: float, light_shift: float, width: float = 30.0, falloff: float = 15.0) -> Edit:
    """Master adjustments within a soft window around one hue; the window follows the hue as it is shifted."""

    def edit(light: Column, c: Column, h: Column) -> Triple:
        window = lambda x: colour.hue_range_mask(x, CHANNELS[channel], width, falloff)
        turned = F.pmod(h + hue * window(h), F.lit(360.0))
        inside = window(turned)
        return clip(light + light_shift * inside, 0, 100), c * (1 + (saturation - 1) * inside), turned

    return edit


def split_tone(shadow: tuple[float, float], highlight: tuple[float, float], balance: float = 0.0) -> Edit:
    """Hue and saturation (0..1) that shadows and highlights are drawn to, by their distance from the crossover."""

    def edit(light: Column, c: Column, h: Column) -> Triple:
        x, middle = light / 100, min(max(0.5 + balance / 200, 0.05), 0.95)
        for (hue, sat), weight in ((shadow, clip((middle - x) / max(middle, 0.05))), (highlight, clip((x - middle) / max(1 - middle, 0.05)))):
            share = weight * sat
            c, h = c * (1 - share) + share * (sat * 60), h * (1 - share) + share * hue
        return light, c, h

    return edit


def negative_split(shadows: float, highlights: float, low: float = 50.0, high: float = 60.0) -> Edit:
    """Less chroma towards the ends of lightness."""

    def edit(light: Column, c: Column, h: Column) -> Triple:
        down, up = clip(1 - light / low), clip((light - high) / (100 - high))
        return light, c * (1 - down * down * shadows) * (1 - up * up * highlights), h

    return edit


def highlight_drift(strength: float) -> Edit:
    """Hue rotation, twelve degrees at most, of light and hardly coloured pixels."""
    return lambda light, c, h: (light, c, clip(h + 12 * strength * clip((light - 75) / 25) * (1 - clip((c - 8) / 12)), 0, 360))


def film_split(shadow_hue: float, highlight_hue: float, pivot: float, strength: float) -> Edit:
    """OKLCh tint of both ends, with a soft power of the distance from the pivot."""

    def edit(light: Column, c: Column, h: Column) -> Triple:
        for hue, x in ((shadow_hue, (pivot - light) / max(pivot, 1e-6)), (highlight_hue, (light - pivot) / max(1 - pivot, 1e-6))):
            w = F.pow(clip(x), F.lit(1.5))
            c, h = c + w * (0.04 * strength), F.when(w > 0.1, h * (1 - w) + w * hue).otherwise(h)
        return light, c, h

    return edit


def subtractive(pixels: DataFrame, amount: float) -> DataFrame:
    """Dye-like saturation: more chroma, and darker the more chroma there is; near-neutral pixels stay as they are."""
    kept = pixels.withColumns({f"__was_{c}": F.col(c) for c in "rgb"})

    def edit(light: Column, c: Column, h: Column) -> Triple:
        return clip(light - c * (amount * 0.5)), F.greatest(c * (1 + amount), F.lit(0.0)), h

    chroma, _ = colour.to_polar(*colour.srgb_to_oklab(F.col("r"), F.col("g"), F.col("b"))[1:])
    weighed = kept.withColumn("__w", clip((chroma - 0.008) / 0.032))
    done = in_space(weighed, "oklch", edit)
    mixed = done.withColumns({c: F.col(f"__was_{c}") * (1 - F.col("__w")) + F.col(c) * F.col("__w") for c in "rgb"})
    return mixed.drop("__w", *[f"__was_{c}" for c in "rgb"])


# --- gamut, appearance, white balance -----------------------------------------------------------


def gamut_limit(light: Column, hue: Column, steps: int = 20) -> Column:
    """Largest OKLab chroma of a lightness and hue within sRGB, by bisection from 0 to 0.5: a batch of rows at a time, as a fold in columns would
    write the lightness and hue out anew for each use in each step."""

    @F.pandas_udf("double")
    def largest(light: pd.Series, cos: pd.Series, sin: pd.Series) -> pd.Series:
        x, c, s = (v.to_numpy(dtype=float, na_value=np.nan) for v in (light, cos, sin))
        low, high = np.zeros(len(x)), np.full(len(x), 0.5)
        with np.errstate(invalid="ignore", over="ignore"):
            for _ in range(steps):
                middle = (low + high) / 2
                cubes = [t * t * t for t in (i * x + j * (middle * c) + k * (middle * s) for i, j, k in OKLAB_M2_BACK)]
                inside = np.ones(len(x), bool)
                for i, j, k in OKLAB_M1_BACK:
                    v = i * cubes[0] + j * cubes[1] + k * cubes[2]
                    inside &= (v >= -1e-4) & (v <= 1 + 1e-4)
                low, high = np.where(inside, middle, low), np.where(inside, high, middle)
        return pd.Series(low)

    return F.when((light > 0) & (light < 1), largest(light, F.cos(F.radians(hue)), F.sin(F.radians(hue)))).otherwise(0.0)


def gamut_compressed(chroma: Column, limit: Column) -> Column:
    """Chroma as it is within the limit, and at the limit beyond it; a limit of practically nothing counts as one."""
    return F.least(F.greatest(chroma, F.lit(0.0)), F.when(limit > 1e-6, limit).otherwise(1.0))


def cam16_ucs(r: Column, g: Column, b: Column) -> Triple:
    """Uniform appearance coordinates J', a', b' of linear sRGB."""
    lo, mi, sh = (F.cbrt(F.greatest(x, F.lit(0.0))) for x in _times(CAT16, _times(colour.SRGB_TO_XYZ, (r, g, b))))
    x = (0.2 * lo + 0.7 * mi + 0.1 * sh) * 100
    return 1.7 * x / (1 + 0.007 * x), 50 * (lo - mi), 50 * (mi - sh)


#: What the locus is followed over, and the step of one unit of tint.
KELVIN_RANGE, TINT_RANGE, TINT_STEP = (2000.0, 50000.0), (-100.0, 100.0), 0.00035


def _white_xyz(kelvin: float, tint: float) -> np.ndarray:
    """XYZ (Y = 1) of a light: a place on the locus, and off it towards green by the tint.

    In the uniform plane (u, v) the way along the locus is the derivative of its fits; the tint goes at a right angle to it.
    """
    t, off = np.clip(kelvin, *KELVIN_RANGE), np.clip(tint, *TINT_RANGE) * TINT_STEP
    of_x, of_y = (next(np.poly1d(c) for upto, c in pieces if t <= upto) for pieces in (colour.LOCUS_X, colour.LOCUS_Y))
    x = of_x(1000 / t)
    y = of_y(x)
    dx = -of_x.deriv()(1000 / t) * 1000 / t**2
    dy = of_y.deriv()(x) * dx
    w = -2 * x + 12 * y + 3  # u = 4 x / w, v = 6 y / w
    du, dv = (4 * (dx * w - x * (12 * dy - 2 * dx)), 6 * (dy * w - y * (12 * dy - 2 * dx)))
    across = np.array([dv, -du]) if du < 0 else np.array([-dv, du])  # the side of larger v
    u, v = np.array([4 * x, 6 * y]) / w + across / np.hypot(du, dv) * off
    back = 2 * u - 8 * v + 4
    white = np.array([3 * u, 2 * v, back - 3 * u - 2 * v])
    return white / white[1]


def white_balance_matrix(kelvin: float, tint: float = 0.0) -> tuple[tuple[float, ...], ...]:
    """Linear sRGB to linear sRGB: cone responses scaled so that the light's white becomes D65."""
    cat, xyz = np.array(CAT16), np.array(colour.SRGB_TO_XYZ)
    scale = (cat @ np.array(colour.D65)) / np.maximum(cat @ _white_xyz(kelvin, tint), 1e-9)
    return tuple(map(tuple, (np.linalg.inv(xyz) @ np.linalg.inv(cat) @ np.diag(scale) @ cat @ xyz).tolist()))


def white_balanced(r: Column, g: Column, b: Column, kelvin: float, tint: float = 0.0) -> Triple:
    """sRGB under the given light, as under D65."""
    linear = tuple(colour.srgb_to_linear(x) for x in (r, g, b))
    return tuple(colour.linear_to_srgb(x) for x in _times(white_balance_matrix(kelvin, tint), linear))


# --- masks and measures -------------------------------------------------------------------------


def skin_membership(light: Column, chroma: Column, hue: Column, centre: float = 25.0, width: float = 25.0, least: float = 8.0, reference: float | None = None) -> Column:
    """Bell around the skin hues, 0 below a chroma; with a reference lightness darker pixels need less, down to a third."""
    off = (hue - centre) / width
    gate = F.lit(least) if reference is None else clip(light / reference, 1 / 3, 1.0) * least
    return F.when(chroma > gate, F.exp(-off * off)).otherwise(0.0)


def paint_like(light: Column, a: Column, b: Column) -> tuple[Column, Column]:
    """OKLab pixels of a colour that skin doesn't have, and of grey (fixed values: hues 115 to 345 degrees, chroma 0.035)."""
    chroma, hue = colour.to_polar(a, b)
    return (hue > 115.0) & (hue < 345.0) & (chroma >= 0.035), chroma < 0.035 * F.greatest(light, F.lit(0.2))


def chromophores(r: Column, g: Column, b: Column) -> tuple[Column, Column]:
    """Melanin and hemoglobin of linear sRGB: the least-squares solution for optical densities against that of blue."""
    back = np.linalg.pinv((np.array([MELANIN, HEMOGLOBIN]).T - np.array([[MELANIN[2], HEMOGLOBIN[2]]]))[:2]).tolist()
    density = [-F.ln(clip(x, 1e-5, 1.0)) for x in (r, g, b)]
    off = [density[0] - density[2], density[1] - density[2]]
    return tuple(row[0] * off[0] + row[1] * off[1] for row in back)


def lifted_maps(df: DataFrame, image: str, columns: list[str]) -> DataFrame:
    """``df`` with each of ``columns`` moved up by its image's lowest value where that is negative, so that differences within an image stay as they are."""
    lowest = df.groupBy(image).agg(*[F.least(F.min(c), F.lit(0.0)).alias(f"__{c}") for c in columns])
    return df.join(lowest, image).select(*[(F.col(c) - F.col(f"__{c}")).alias(c) if c in columns else F.col(c) for c in df.columns])


def bruise_phase(hue: Column) -> Column:
    """Purple, green or yellow, whichever hue (300, 120, 60 degrees) is nearest; ties: in that order."""
    purple, green, yellow = (colour.hue_distance(hue, x) for x in (300.0, 120.0, 60.0))
    return F.when((purple <= green) & (purple <= yellow), "purple").when(green <= yellow, "green").otherwise("yellow")


def capped(reference: Triple, edited: Triple, most: float) -> Triple:
    """Lab after an edit, drawn back to at most so great a difference from the reference."""
    scale = F.least(F.lit(1.0), most / F.greatest(colour.delta_e_76(edited, reference), F.lit(1e-6)))
    return tuple(a + (b - a) * scale for a, b in zip(reference, edited, strict=True))


def exposure_gamma(mean: Column, target: float = 120.0, low: float = 95.0, high: float = 165.0) -> Column:
    """Gamma (0.75 to 1.25) that leads a mean lightness (of 255) to the target; 1 within the limits."""
    held = clip(mean, 1.0, 254.0)
    return F.when((mean < low) | (mean > high), clip(math.log(target / 255) / F.ln(held / 255), 0.75, 1.25)).otherwise(1.0)


def tonal(x: Column, shadows: float = 0, highlights: float = 0, whites: float = 0, blacks: float = 0) -> Column:
    """Parametric curve over a channel of 255; settings from -100 to 100."""
    soft = lambda w: w * w * (3 - 2 * w)
    parts = ((blacks, clip(1 - x / 64)), (shadows, soft(clip(1 - F.abs(x - 25) / 100))), (highlights, soft(clip(1 - F.abs(x - 230) / 100))), (whites, clip(1 - (255 - x) / 64)))
    return clip(x + sum((w * (k / 100 * 48) for k, w in parts), F.lit(0.0)), 0, 255)


def monochrome(r: Column, g: Column, b: Column, weights: tuple[float, float, float], brightness: float = 0.0, contrast: float = 0.0) -> Column:
    """Weighted mean of the channels, contrast (-50 to 50) around 128, brightness added; channels and result of 255."""
    grey = sum((x * (w / sum(weights)) for x, w in zip((r, g, b), weights, strict=True)), F.lit(0.0))
    return clip(128 + (grey - 128) * (1 + min(max(contrast, -50), 50) / 50) + brightness, 0, 255)


def vignette(x: Column, y: Column, width: Column, height: Column, strength: float) -> Column:
    """Factor that falls with the square of the distance from the middle."""
    cx, cy = width / 2, height / 2
    return clip(1 - ((x - cx) * (x - cx) + (y - cy) * (y - cy)) / (cx * cx + cy * cy) * strength)


def radial_mask(x: Column, y: Column, width: Column, height: Column, centre: tuple[float, float], radius: float, feather: float) -> Column:
    """1 within a circle (shares of the frame; radius of its short side), falling to 0 over the outer ``feather`` of it."""
    r = F.greatest(F.least(width, height) * radius, F.lit(1.0))
    dx, dy = x - width * centre[0], y - height * centre[1]
    return clip((r - F.sqrt(dx * dx + dy * dy)) / F.greatest(r * feather, F.lit(1e-6)))


def colour_pop(pixels: DataFrame, image: str, vivid: float = 40.0, full: float = 0.12, sectors: int = 12) -> DataFrame:
    """``image, score, vivid_share, concentration``: share of vivid pixels (``__c, __h``: Lab chroma and hue), and how many of them lie in
    the busiest hue sector and its neighbours."""
    sector = F.when(F.col("__c") > vivid, F.pmod(F.floor(F.col("__h") / (360 / sectors)), F.lit(sectors)))
    counts = pixels.groupBy(image, sector.alias("s")).agg(F.count(F.lit(1)).alias("n"))
    spread = F.explode(F.array(*[F.pmod(F.col("s") + d, F.lit(sectors)) for d in (-1, 0, 1)])).alias("s")
    busiest = counts.where("s is not null").select(image, spread, "n").groupBy(image, "s").agg(F.sum("n").alias("n")).groupBy(image).agg(F.max("n").alias("top"))
    total = counts.groupBy(image).agg(F.sum("n").alias("all"), F.sum(F.when(F.col("s").isNotNull(), F.col("n"))).alias("vivid"))
    share, concentration = F.coalesce(F.col("vivid") / F.col("all"), F.lit(0.0)), F.coalesce(F.col("top") / F.col("vivid"), F.lit(0.0))
    score = F.least(F.lit(1.0), share / full) * (0.5 + 0.5 * concentration)
    return total.join(busiest, image, "left").select(image, score.alias("score"), share.alias("vivid_share"), concentration.alias("concentration"))


def skin_state(pixels: DataFrame, image: str, mask: str, least: float = 0.3) -> DataFrame:
    """``image, l_mean, c_mean, c_std, h_mean`` over the masked pixels (``__l, __c, __h``: OKLCh); hue is a circular mean."""
    inside = pixels.where(F.col(mask) > least)
    turn = colour.degrees360(F.avg(F.sin(F.radians("__h"))), F.avg(F.cos(F.radians("__h"))))
    return inside.groupBy(image).agg(F.avg("__l").alias("l_mean"), F.avg("__c").alias("c_mean"), F.stddev_pop("__c").alias("c_std"), turn.alias("h_mean"))


# --- masked edits, and edits that follow statistics of the frame --------------------------------


def self_blend(x: Column, mode: str) -> Column:
    """A channel blended with itself."""
    if mode == "exclusion":
        return 2 * x * (1 - x)
    if mode == "linear_light":
        return clip(3 * x - 1)
    if mode == "color_dodge":
        return F.when(x == 0, 0.0).when(x < 0.5, F.try_divide(x, 1 - x)).otherwise(1.0)
    if mode == "color_burn":
        return F.when(x == 1, 1.0).when(x > 0.5, 1 - F.try_divide(1 - x, x)).otherwise(0.0)
    if mode == "vivid_light":
        low = F.when(x > 1 / 3, F.try_divide(3 * x - 1, 2 * x)).otherwise(0.0)
        return F.when(x <= 0.5, low).when(x < 2 / 3, F.try_divide(x, 2 * (1 - x))).otherwise(1.0)
    return F.when(x <= 0.5, x - (1 - 2 * x) * x * (1 - x)).otherwise(x + (2 * x - 1) * (F.sqrt(x) - x))


def lightened(mask: Column, amount: float) -> Edit:
    """Lightness (of 255) raised where the mask is: whites of eyes, faces."""
    return lambda light, a, b: (clip(light + mask * (amount * 100 / 255), 0, 100), a, b)


def iris(mask: Column, saturation: float, hue: float, brightness: float) -> Edit:
    def edit(light: Column, c: Column, h: Column) -> Triple:
        mix = lambda old, new: old * (1 - mask) + new * mask
        return mix(light, clip(light * (1 + brightness * 0.2), 0, 100)), mix(c, clip(c * (1 + saturation * 0.5), 0, 128)), mix(h, F.pmod(h + hue, F.lit(360.0)))

    return edit


def whitened_cloth(mask: Column, strength: float) -> Edit:
    """Near-white pixels (lightness over 170 of 255, hardly coloured) a little lighter and warmer."""

    def edit(light: Column, a: Column, b: Column) -> Triple:
        m = F.when((light * 2.55 > 170) & (F.abs(a) < 15) & (F.abs(b) < 15), mask * strength).otherwise(0.0)
        return clip(light + m * (1000 / 255), 0, 100), clip(a + m, -128, 127), clip(b + m * 3, -128, 127)

    return edit


def cool_cast_removed(blueish: Column, strength: float) -> Edit:
    """Chroma drawn to grey where pixels are bluer than they should be."""
    left = F.when(blueish, 1 - strength).otherwise(1.0)
    return lambda light, a, b: (light, a * left, b * left)


def unified_hair(pixels: DataFrame, image: str, mask: str, strength: float) -> DataFrame:
    """Hair drawn to its own mean hue (by ten degrees at most) and median chroma (by 0.03 at most) in OKLCh."""
    light, a, b = colour.srgb_to_oklab(F.col("r"), F.col("g"), F.col("b"))
    chroma, hue = colour.to_polar(a, b)
    seen = pixels.where(F.col(mask) > 0.05).select(image, chroma.alias("__c"), F.radians(hue).alias("__h"))
    target = seen.groupBy(image).agg(colour.degrees360(F.sum(F.sin("__h")), F.sum(F.cos("__h"))).alias("__hue"), F.percentile("__c", F.lit(0.5)).alias("__chroma"))
    share = F.col(mask) * strength

    def edit(light: Column, c: Column, h: Column) -> Triple:
        turn = F.pmod(F.col("__hue") - h + 180, F.lit(360.0)) - 180
        return light, F.greatest(c + clip(F.col("__chroma") - c, -0.03, 0.03) * share, F.lit(0.0)), F.pmod(h + clip(turn, -10, 10) * share, F.lit(360.0))

    return in_space(pixels.join(target, image), "oklch", edit).drop("__hue", "__chroma")


def colour_transfer(pixels: DataFrame, image: str, reference: tuple[float, float, float, float]) -> DataFrame:
    """Chroma of each image moved to a reference's mean and spread of Lab a and b (``mean a, std a, mean b, std b``); spreads are scaled by 0.3
    to 3, and flat channels stay."""
    _, a, b = colour.linear_to_lab(*(colour.srgb_to_linear(F.col(c)) for c in "rgb"))
    ab = pixels.select(image, a.alias("__a"), b.alias("__b"))
    stats = ab.groupBy(image).agg(*[f(c).alias(f"{c}{n}") for c in ("__a", "__b") for f, n in ((F.avg, "m"), (F.stddev_pop, "s"))])

    def moved(x: Column, name: str, mean: float, std: float) -> Column:
        m, s = F.col(f"{name}m"), F.col(f"{name}s")
        return F.when(s < 1e-3, x).otherwise((x - m) * clip(std / (s + 1e-6), 0.3, 3.0) + mean)

    ma, sa, mb, sb = reference
    edit = lambda light, x, y: (light, moved(x, "__a", ma, sa), moved(y, "__b", mb, sb))
    return in_space(pixels.join(stats, image), "lab", edit).drop("__am", "__as", "__bm", "__bs")


def stacked(grades: list[tuple[DataFrame, float]], keys: list[str]) -> DataFrame:
    """Weighted mean of several grades of the same pixels; weights of zero or less count as none."""
    used = [(d, w) for d, w in grades if w > 0]
    total = sum(w for _, w in used)
    every = None
    for d, w in used:
        part = d.select(*keys, *[(F.col(c) * (w / total)).alias(c) for c in "rgb"])
        every = part if every is None else every.unionByName(part)
    return every.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in "rgb"])
