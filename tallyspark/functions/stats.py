"""Rates, intervals and safe ratios as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

Z_95 = 1.96


def ratio(numerator: Column, denominator: Column) -> Column:
    """Numerator / denominator, 0 for an empty denominator."""
    return F.when(denominator == 0, F.lit(0.0)).otherwise(numerator / denominator)


def per_1000(matches: Column, total: Column) -> Column:
    return F.lit(1000.0) * ratio(matches, total)


def relative_change_percent(early: Column, recent: Column) -> Column:
    """Percent change from early to recent; null when there was nothing early."""
    return F.when(early > 0, F.lit(100.0) * (recent / early - 1))


def _wilson_parts(matches: Column, total: Column, z: float) -> tuple[Column, Column]:
    n = F.nullif(total.cast("double"), F.lit(0.0))
    p = matches / n
    scale = 1 + F.lit(z * z) / n
    centre = (p + F.lit(z * z) / (2 * n)) / scale
    half = F.lit(z) * F.sqrt(p * (1 - p) / n + F.lit(z * z) / (4 * n * n)) / scale
    return centre, half


def wilson_low(matches: Column, total: Column, z: float = Z_95) -> Column:
    centre, half = _wilson_parts(matches, total, z)
    return F.coalesce(F.greatest(F.lit(0.0), centre - half), F.lit(0.0))


def wilson_high(matches: Column, total: Column, z: float = Z_95) -> Column:
    """Upper Wilson bound; (0, 0) stands for no observations at all."""
    centre, half = _wilson_parts(matches, total, z)
    return F.when(total == 0, F.lit(0.0)).otherwise(F.least(F.lit(1.0), centre + half))


def mean_low(mean: Column, sd: Column, n: Column, z: float = Z_95) -> Column:
    """Normal lower bound from mean, sample deviation and count; one value is its own bound."""
    return F.coalesce(mean - F.lit(z) * sd / F.sqrt(F.nullif(n, F.lit(0))), mean)


def mean_high(mean: Column, sd: Column, n: Column, z: float = Z_95) -> Column:
    return F.coalesce(mean + F.lit(z) * sd / F.sqrt(F.nullif(n, F.lit(0))), mean)
