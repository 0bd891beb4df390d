"""Spectral index formulas and their climate stand-ins, as column expressions."""

from __future__ import annotations

from collections.abc import Callable
from math import pi

from pyspark.sql import Column
from pyspark.sql import functions as F

from fieldglass.functions.scalar import clamp, ratio

Bands = dict[str, Column]

#: index -> (bands it needs, expression over those bands)
SPECTRAL: dict[str, tuple[tuple[str, ...], Callable[[Bands], Column]]] = {
    "ndvi": (("red", "nir"), lambda b: ratio(b["nir"] - b["red"], b["nir"] + b["red"])),
    "ndwi": (("green", "nir"), lambda b: ratio(b["green"] - b["nir"], b["green"] + b["nir"])),
    "ndbi": (("nir", "swir"), lambda b: ratio(b["swir"] - b["nir"], b["swir"] + b["nir"])),
    "evi": (
        ("red", "nir", "blue"),
        lambda b: ratio(b["nir"] - b["red"], b["nir"] + 6.0 * b["red"] - 7.5 * b["blue"] + 1.0, 2.5),
    ),
    "savi": (("red", "nir"), lambda b: ratio(b["nir"] - b["red"], b["nir"] + b["red"] + 0.5, 1.5)),
    "nbr": (("nir", "swir"), lambda b: ratio(b["nir"] - b["swir"], b["nir"] + b["swir"])),
}


def season(timestamp: Column) -> Column:
    """Seasonal greening term: a yearly sine peaking after midsummer, limited to [-0.4, 1]."""
    return clamp(F.sin((F.dayofyear(timestamp) - 110) * (2 * pi / 365.25)), -0.4, 1.0)


def wetness(rainfall: Column, high_rain: float | None) -> Column:
    """Rain relative to its 0.92 quantile, limited to [0, 1.8]; missing rain counts as none, no quantile gives none."""
    if high_rain is None:
        return F.lit(None).cast("double")
    return clamp(F.try_divide(F.coalesce(rainfall, F.lit(0.0)), F.lit(high_rain + 1e-4)), 0.0, 1.8)


def heat(temperature: Column) -> Column:
    """Degrees above 27, limited to 20, as a share of 20; missing temperature counts as 25."""
    return clamp(F.coalesce(temperature, F.lit(25.0)) - 27.0, 0.0, 20.0) / 20.0


def proxy_ndvi(m: Column, r: Column, h: Column) -> Column:
    raw = 0.28 + 0.36 * F.coalesce(m, F.lit(0.2)) + 0.22 * r - 0.14 * h
    return F.bround(clamp(raw, 0.08, 0.88), 4)


def proxy_rest(ndvi: Column, m: Column, r: Column, h: Column) -> dict[str, Column]:
    """The other five stand-ins; four of them follow from the rounded NDVI stand-in."""
    return {
        "ndwi": F.bround(clamp(0.16 * r - 0.22 * h + 0.10 * F.coalesce(m, F.lit(0.0)), -0.55, 0.65), 4),
        "evi": F.bround(clamp(ndvi * 0.84 + 0.04, 0.05, 0.85), 4),
        "savi": F.bround(clamp(ndvi * 0.72 + 0.08, 0.06, 0.78), 4),
        "ndbi": F.bround(clamp(-0.68 * ndvi + 0.12, -0.55, 0.45), 4),
        "nbr": F.bround(clamp(0.52 * ndvi - 0.18 * h, -0.4, 0.75), 4),
    }
