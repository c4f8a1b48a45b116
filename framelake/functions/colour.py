"""Pointwise colour and tone mathematics as column expressions.

Channels are doubles in 0..1 unless a name says otherwise; nothing here leaves the JVM.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the colour spaces.
OKLAB_M1 = (
    (0.4121656, 0.5362752, 0.0514575),
    (0.2118591, 0.6807189, 0.1074220),
    (0.0883024619, 0.2817188336, 0.6299787005),
)
OKLAB_M2 = (
    (0.2104542, 0.7936177, -0.0040720),
    (1.9779985, -2.4285922, 0.4505937),
    (0.0259040, 0.7827717, -0.8086757),
)
SRGB_TO_XYZ = ((0.4124564, 0.3575761, 0.1804375), (0.2126729, 0.7151522, 0.0721750), (0.0193339, 0.1191920, 0.9503041))
D65 = (0.95047, 1.0, 1.08883)
LUMA = (0.2126, 0.7152, 0.0722)
SHOULDER_KNEE = 0.8
BLOWN_LOW, BLOWN_HIGH = 0.94, 0.99
#: ST 2084.
PQ_M1, PQ_M2, PQ_C1, PQ_C2, PQ_C3 = 2610 / 16384, 2523 / 32, 3424 / 4096, 2413 / 128, 2392 / 128


def clip(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def safe_divide(a: Column, b: Column, fallback: float = 0.0) -> Column:
    return F.coalesce(F.try_divide(a, b), F.lit(fallback))


def srgb_to_linear(x: Column) -> Column:
    x = clip(x)
    return F.when(x <= 0.04045, x / 12.92).otherwise(F.pow((x + 0.055) / 1.055, F.lit(2.4)))


def linear_to_srgb(x: Column) -> Column:
    x = clip(x)
    return F.when(x <= 0.0031308, x * 12.92).otherwise(1.055 * F.pow(x, F.lit(1 / 2.4)) - 0.055)


def shoulder(x: Column, knee: float = SHOULDER_KNEE) -> Column:
    """Identity up to the knee, then an exponential approach to 1."""
    span = 1.0 - knee
    return F.when(x <= knee, x).otherwise(knee + span * (1 - F.exp(-(x - knee) / span)))


def luma(r: Column, g: Column, b: Column) -> Column:
    return LUMA[0] * r + LUMA[1] * g + LUMA[2] * b


def _times(m: tuple, v: tuple[Column, Column, Column]) -> tuple[Column, Column, Column]:
    return tuple(row[0] * v[0] + row[1] * v[1] + row[2] * v[2] for row in m)


def linear_to_oklab(r: Column, g: Column, b: Column) -> tuple[Column, Column, Column]:
    return _times(OKLAB_M2, tuple(F.cbrt(F.greatest(x, F.lit(0.0))) for x in _times(OKLAB_M1, (r, g, b))))


def srgb_to_oklab(r: Column, g: Column, b: Column) -> tuple[Column, Column, Column]:
    return linear_to_oklab(srgb_to_linear(r), srgb_to_linear(g), srgb_to_linear(b))


def degrees360(y: Column, x: Column) -> Column:
    return F.pmod(F.degrees(F.atan2(y, x)), F.lit(360.0))


def to_polar(a: Column, b: Column) -> tuple[Column, Column]:
    """Chroma and hue in degrees of an opponent pair."""
    return F.sqrt(a * a + b * b), degrees360(b, a)


def from_polar(chroma: Column, hue: Column) -> tuple[Column, Column]:
    return chroma * F.cos(F.radians(hue)), chroma * F.sin(F.radians(hue))


def linear_to_lab(r: Column, g: Column, b: Column) -> tuple[Column, Column, Column]:
    """CIE L*a*b* (L in 0..100) of linear sRGB under D65."""

    def f(t: Column) -> Column:
        return F.when(t > 216 / 24389, F.cbrt(t)).otherwise((24389 / 27 * t + 16) / 116)

    x, y, z = (f(v / w) for v, w in zip(_times(SRGB_TO_XYZ, (r, g, b)), D65, strict=True))
    return 116 * y - 16, 500 * (x - y), 200 * (y - z)


def delta_e_76(a: tuple, b: tuple) -> Column:
    return F.sqrt(sum(((x - y) * (x - y) for x, y in zip(a, b, strict=True)), F.lit(0.0)))


def delta_e_2000(one: tuple[Column, Column, Column], two: tuple[Column, Column, Column]) -> Column:
    """CIEDE2000 with unit weights."""
    (l1, a1, b1), (l2, a2, b2) = one, two
    c_mean = (F.sqrt(a1 * a1 + b1 * b1) + F.sqrt(a2 * a2 + b2 * b2)) / 2
    c7 = F.pow(c_mean, F.lit(7.0))
    g = 0.5 * (1 - F.sqrt(c7 / (c7 + 25.0**7)))
    a1p, a2p = a1 * (1 + g), a2 * (1 + g)
    c1, c2 = F.sqrt(a1p * a1p + b1 * b1), F.sqrt(a2p * a2p + b2 * b2)
    h1, h2 = degrees360(b1, a1p), degrees360(b2, a2p)
    none = (c1 * c2) == 0
    turn = h2 - h1
    dh = F.when(none, 0.0).when(F.abs(turn) <= 180, turn).when(turn > 180, turn - 360).otherwise(turn + 360)
    dl, dc, big_dh = l2 - l1, c2 - c1, 2 * F.sqrt(c1 * c2) * F.sin(F.radians(dh / 2))
    lm, cm, total = (l1 + l2) / 2, (c1 + c2) / 2, h1 + h2
    hm = F.when(none, total).when(F.abs(turn) <= 180, total / 2).when(total < 360, (total + 360) / 2).otherwise((total - 360) / 2)
    cos = lambda x: F.cos(F.radians(x))
    t = 1 - 0.17 * cos(hm - 30) + 0.24 * cos(2 * hm) + 0.32 * cos(3 * hm + 6) - 0.20 * cos(4 * hm - 63)
    l50 = (lm - 50) * (lm - 50)
    sl, sc, sh = 1 + 0.015 * l50 / F.sqrt(20 + l50), 1 + 0.045 * cm, 1 + 0.015 * cm * t
    cm7 = F.pow(cm, F.lit(7.0))
    turned = (hm - 275) / 25
    rt = -2 * F.sqrt(cm7 / (cm7 + 25.0**7)) * F.sin(F.radians(60 * F.exp(-turned * turned)))
    x, y, z = dl / sl, dc / sc, big_dh / sh
    return F.sqrt(F.greatest(x * x + y * y + z * z + rt * y * z, F.lit(0.0)))


#: Fixed values of the polynomial fits of the locus, highest power first: x over 1000 K / T up to a temperature, y over x likewise.
LOCUS_X = ((4000.0, (-0.2661239, -0.2343580, 0.8776956, 0.179910)), (7000.0, (-4.6070, 2.9678, 0.09911, 0.244063)), (math.inf, (-2.0064, 1.9018, 0.24748, 0.237040)))
LOCUS_Y = (
    (2222.0, (-1.1063814, -1.34811020, 2.18555832, -0.20219683)), (4000.0, (-0.9549476, -1.37418593, 2.09137015, -0.16748867)), (math.inf, (-3.0, 2.870, -0.275)),
)


def kelvin_to_xy(kelvin: Column, low: float = 1667.0, high: float = 50000.0) -> tuple[Column, Column]:
    """Chromaticity of the Planckian locus up to 4000 K, of the daylight locus beyond."""
    t = clip(kelvin, low, high)

    def fitted(pieces, v: Column) -> Column:
        out = F.lit(None).cast("double")
        for upto, c in reversed(pieces):
            value = sum((k * F.pow(v, F.lit(float(len(c) - 1 - n))) for n, k in enumerate(c)), F.lit(0.0))
            out = F.when(t <= upto, value).otherwise(out)
        return out

    x = fitted(LOCUS_X, 1000.0 / t)
    return x, fitted(LOCUS_Y, x)


def fitzpatrick(light: Column, b: Column) -> Column:
    """Skin phototype from the individual typology angle (cut points 55, 41, 28, 10, -30 degrees)."""
    ita = F.degrees(F.atan2(light - 50, b))
    out = F.when(ita > 55, "I")
    for cut, name in ((41, "II"), (28, "III"), (10, "IV"), (-30, "V")):
        out = out.when(ita > cut, name)
    return out.otherwise("VI")


def hue_distance(a: Column, b: Column | float) -> Column:
    d = F.pmod(F.abs(a - b), F.lit(360.0))
    return F.least(d, 360.0 - d)


def hue_range_mask(hue: Column, centre: float, width: float, falloff: float) -> Column:
    """1 within half the width of the centre, falling to 0 over ``falloff`` degrees."""
    return clip(1 - (hue_distance(hue, centre) - width / 2) / max(falloff, 1e-6))


def linear_to_pq(x: Column) -> Column:
    p = F.pow(clip(x), F.lit(PQ_M1))
    return F.pow((PQ_C1 + PQ_C2 * p) / (1 + PQ_C3 * p), F.lit(PQ_M2))


def pq_to_linear(x: Column) -> Column:
    p = F.pow(clip(x), F.lit(1 / PQ_M2))
    return F.pow(F.greatest(p - PQ_C1, F.lit(0.0)) / (PQ_C2 - PQ_C3 * p), F.lit(1 / PQ_M1))


def reinhard(x: Column, exposure: float = 1.0) -> Column:
    v = x * exposure
    return v / (1 + v)


def screen(base: Column, layer: Column) -> Column:
    return 1 - (1 - base) * (1 - layer)


def overlay(base: Column, layer: Column) -> Column:
    return F.when(base <= 0.5, 2 * base * layer).otherwise(1 - 2 * (1 - base) * (1 - layer))


def hard_light(base: Column, layer: Column) -> Column:
    return overlay(layer, base)


def soft_light(base: Column, layer: Column) -> Column:
    return (1 - 2 * layer) * base * base + 2 * layer * base


def masked(original: Column, processed: Column, mask: Column) -> Column:
    return original * (1 - mask) + processed * mask


def smoothstep_down(x: Column, start: float, end: float) -> Column:
    """1 before ``start``, 0 behind ``end``, smooth between."""
    t = clip((x - start) / max(end - start, 1e-9))
    return 1 - t * t * (3 - 2 * t)


def lift_gamma_gain(x: Column, lift: float, gamma: float, gain: float) -> Column:
    return F.pow(clip(x * gain + lift * (1 - x)), F.lit(1 / max(gamma, 1e-6)))


def soft_clip(x: Column, start: float, threshold: float = 1.0) -> Column:
    """Identity up to ``start``, then an exponential approach to ``threshold``."""
    span = max(threshold - start, 1e-6)
    return F.when(x <= start, x).otherwise(start + span * (1 - F.exp(-(x - start) / span)))


def density_curve(x: Column, slope: float, midpoint: float) -> Column:
    """A film-like sigmoid of density, scaled so that 0 stays 0 and 1 stays 1."""
    s = lambda v: 1 / (1 + F.exp(-slope * (v - midpoint)))
    low, high = 1 / (1 + math.exp(slope * midpoint)), 1 / (1 + math.exp(-slope * (1 - midpoint)))
    return (s(x) - low) / (high - low)


def match_gains(hero: tuple, frame: tuple, strength: float = 1.0, max_ev: float = 1.0, wb: tuple[float, float] = (0.9, 1 / 0.9)) -> tuple[Column, tuple]:
    """Exposure (EV) and r, g, b gains that move a frame's mean colour onto the hero's.

    The exposure is clipped, the white-balance ratios are clipped and then scaled so that
    they alone don't change the luminance; ``strength`` scales both in the exponent.
    """
    floor = lambda v: tuple(F.greatest(x, F.lit(1e-6)) for x in v)
    hero, frame = floor(hero), floor(frame)
    yh, yf = luma(*hero), luma(*frame)
    ev = clip(F.log2(yh / yf), -max_ev, max_ev) * strength
    ratio = tuple(clip((h / yh) / (f / yf), *wb) for h, f in zip(hero, frame, strict=True))
    norm = F.greatest(luma(*(w * f for w, f in zip(ratio, frame, strict=True))) / yf, F.lit(1e-6))
    return ev, tuple(F.pow(w / norm, F.lit(strength)) * F.pow(F.lit(2.0), ev) for w in ratio)
