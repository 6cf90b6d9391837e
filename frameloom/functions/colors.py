"""Colour spaces, vectorised, from their public definitions (CIE, hsluv.org, Ottosson's Oklab).

All functions take and return numpy arrays; RGB is linear with sRGB primaries, in [0, 1].  In HSLuv here, hue
is in degrees and saturation and lightness are in [0, 1].
"""

from __future__ import annotations

import numpy as np

#: Fixed values of the published definitions: sRGB to XYZ (D65), the white point, and CIE constants.
RGB_TO_XYZ = np.array([[0.41239079926595948, 0.35758433938387796, 0.18048078840183429], [0.21263900587151036, 0.71516867876775593, 0.072192315360733715], [0.019330818715591851, 0.11919477979462599, 0.95053215224966058]])
WHITE = np.array([0.95045592705167, 1.0, 1.089057750759878])
KAPPA, EPSILON = 903.2962962962963, 0.0088564516790356308
XYZ_TO_RGB = np.linalg.inv(RGB_TO_XYZ)
_D = WHITE[0] + 15 * WHITE[1] + 3 * WHITE[2]
_UN, _VN = 4 * WHITE[0] / _D, 9 * WHITE[1] / _D


def _dot(m, a, b, c):
    return tuple(m[i, 0] * a + m[i, 1] * b + m[i, 2] * c for i in range(3))


def lightness(y):
    """CIE L* / 100 of relative luminance."""
    return np.where(y > EPSILON, 1.16 * np.cbrt(y) - 0.16, y * KAPPA / 100)


def luminance(l):
    """Inverse of lightness()."""
    return np.where(l > 0.08, ((l + 0.16) / 1.16) ** 3, l * 100 / KAPPA)


def rgb_to_luv(r, g, b):
    x, y, z = _dot(RGB_TO_XYZ, r, g, b)
    d = x + 15 * y + 3 * z
    l = lightness(y)
    with np.errstate(all="ignore"):
        u = np.where(d > 0, 13 * l * (4 * x / d - _UN), 0.0)
        v = np.where(d > 0, 13 * l * (9 * y / d - _VN), 0.0)
    return l, u, v


def luv_to_rgb(l, u, v):
    y = luminance(l)
    with np.errstate(all="ignore"):
        up, vp = np.where(l > 0, u / (13 * l), 0.0) + _UN, np.where(l > 0, v / (13 * l), 0.0) + _VN
        x, z = y * 9 * up / (4 * vp), y * (12 - 3 * up - 20 * vp) / (4 * vp)
    dark = l <= 0
    return tuple(np.where(dark, 0.0, c) for c in _dot(XYZ_TO_RGB, x, y, z))


def luv_to_lch(l, u, v):
    return l, np.hypot(u, v), np.degrees(np.arctan2(v, u)) % 360


def lch_to_luv(l, c, h):
    t = np.radians(h)
    return l, c * np.cos(t), c * np.sin(t)


def most_chroma(l, h):
    """Largest chroma inside the sRGB gamut at a lightness and hue: the nearest of six straight bounds."""
    l100 = l * 100
    sub1 = (l100 + 16) ** 3 / 1560896
    sub2 = np.where(sub1 > EPSILON, sub1, l100 / KAPPA)
    t = np.radians(h)
    best = np.full(np.broadcast(l, h).shape, np.inf)
    with np.errstate(all="ignore"):
        for m1, m2, m3 in XYZ_TO_RGB:
            for edge in (0, 1):
                top1 = (284517 * m1 - 94839 * m3) * sub2
                top2 = (838422 * m3 + 769860 * m2 + 731718 * m1) * l100 * sub2 - 769860 * edge * l100
                bottom = (632260 * m3 - 126452 * m2) * sub2 + 126452 * edge
                length = (top2 / bottom) / (np.sin(t) - (top1 / bottom) * np.cos(t))
                best = np.where((length >= 0) & (length < best), length, best)
    return best / 100


def rgb_to_hsluv(r, g, b):
    l, c, h = luv_to_lch(*rgb_to_luv(r, g, b))
    with np.errstate(all="ignore"):
        s = np.where((l > 0.9999999) | (l < 1e-8), 0.0, c / most_chroma(l, h))
    return h, s, l


def hsluv_to_rgb(h, s, l):
    """Inverse; a colour with a component over 1 is divided by it, which keeps its hue."""
    with np.errstate(all="ignore"):
        c = np.where((l > 0.9999999) | (l < 1e-8), 0.0, most_chroma(l, h) * s)
    r, g, b = luv_to_rgb(*lch_to_luv(l, c, h))
    top = np.maximum(np.maximum(np.maximum(r, g), b), 1.0)
    return r / top, g / top, b / top


def rgb_to_hcl(r, g, b):
    """Hue, chroma, lightness of CIELUV."""
    l, c, h = luv_to_lch(*rgb_to_luv(r, g, b))
    return h, c, l


def rgb_to_xyy(r, g, b):
    x, y, z = _dot(RGB_TO_XYZ, r, g, b)
    t = x + y + z
    with np.errstate(all="ignore"):
        return np.where(t > 0, x / t, WHITE[0] / WHITE.sum()), np.where(t > 0, y / t, WHITE[1] / WHITE.sum()), y


def xyy_to_rgb(x, y, luma):
    with np.errstate(all="ignore"):
        k = np.where(y > 0, luma / y, 0.0)
    return _dot(XYZ_TO_RGB, x * k, luma, (1 - x - y) * k)


def rgb_to_hsl(r, g, b):
    """Plain HSL of the components."""
    top, low = np.maximum(np.maximum(r, g), b), np.minimum(np.minimum(r, g), b)
    d, l = top - low, (top + low) / 2
    with np.errstate(all="ignore"):
        s = np.where(d > 0, d / np.where(l < 0.5, top + low, 2 - top - low), 0.0)
        h = np.where(top == r, (g - b) / d, np.where(top == g, 2 + (b - r) / d, 4 + (r - g) / d))
    return np.where(d > 0, (60 * h) % 360, 0.0), s, l


def hsl_to_rgb(h, s, l):
    c = (1 - np.abs(2 * l - 1)) * s
    out = []
    for n in (0, 8, 4):
        k = (n + h / 30) % 12
        out.append(l - c / 2 * np.maximum(-1, np.minimum(np.minimum(k - 3, 9 - k), 1)))
    return tuple(out)


#: Oklab's two published matrices.
_OK1 = np.array([[0.4122214708, 0.5363325363, 0.0514459929], [0.2119034982, 0.6806995451, 0.1073969566], [0.0883024619, 0.2817188376, 0.6299787005]])
_OK2 = np.array([[0.2104542553, 0.7936177850, -0.0040720468], [1.9779984951, -2.4285922050, 0.4505937099], [0.0259040371, 0.7827717662, -0.8086757660]])


def rgb_to_oklab(r, g, b):
    return _dot(_OK2, *(np.cbrt(c) for c in _dot(_OK1, r, g, b)))


def oklab_to_rgb(l, a, b):
    return _dot(np.linalg.inv(_OK1), *(c**3 for c in _dot(np.linalg.inv(_OK2), l, a, b)))


def oklab_to_okhcl(l, a, b):
    return np.degrees(np.arctan2(b, a)) % 360, np.hypot(a, b), l


def okhcl_to_oklab(h, c, l):
    t = np.radians(h)
    return l, c * np.cos(t), c * np.sin(t)


def scnr(h, s, l, factor):
    """Green reduction: g' = factor * min(g, (r + b) / 2) + (1 - factor) * g; lightness is kept."""
    r, g, b = hsluv_to_rgb(h, s, l)
    g = factor * np.minimum(g, (r + b) / 2) + (1 - factor) * g
    h2, s2, _ = rgb_to_hsluv(r, g, b)
    return h2, s2, l


def star_colour(bv):
    """Linear RGB of a star of the given B-V index: black body at Ballesteros' temperature, brightest component 1."""
    bv = np.clip(np.asarray(bv, float), -0.4, 2.0)
    t = 4600 * (1 / (0.92 * bv + 1.7) + 1 / (0.92 * bv + 0.62))
    # Kim et al.'s cubic fit of the Planckian locus
    x = np.where(t < 4000, -0.2661239e9 / t**3 - 0.2343589e6 / t**2 + 0.8776956e3 / t + 0.179910, -3.0258469e9 / t**3 + 2.1070379e6 / t**2 + 0.2226347e3 / t + 0.240390)
    y = np.where(t < 2222, -1.1063814 * x**3 - 1.34811020 * x**2 + 2.18555832 * x - 0.20219683, np.where(t < 4000, -0.9549476 * x**3 - 1.37418593 * x**2 + 2.09137015 * x - 0.16748867, 3.0817580 * x**3 - 5.87338670 * x**2 + 3.75112997 * x - 0.37001483))
    r, g, b = (np.maximum(c, 0) for c in xyy_to_rgb(x, y, np.ones_like(x)))
    top = np.maximum(np.maximum(r, g), b)
    return r / top, g / top, b / top
