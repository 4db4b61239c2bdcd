"""The page gate: scores, admission, reasons, and what they do to confidences."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..catalog import ADMIT, CONTRAST_WEIGHT, DEGRADED, MIN_SIDE, SHARP_WEIGHT, SIZE_WEIGHT


def clip(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def size_score(width: Column, height: Column) -> Column:
    return F.least(F.lit(1.0), F.least(width, height) / F.lit(float(MIN_SIDE)))


def contrast_score(p2: Column, p98: Column) -> Column:
    """The spread of the grey values between their 2nd and 98th percentile."""
    return clip(((p98 - p2) / 255.0 - 0.15) / 0.45)


def sharpness_score(variance: Column, noise: Column) -> Column:
    """The variance of the Laplacian, damped where the page is noisy."""
    base = F.least(variance / 800.0, F.lit(1.0))
    return F.when(noise > 18, base * F.greatest(F.lit(0.4), F.lit(1.0) - (noise - 18) / 60.0)).otherwise(base)


def legibility(sharp: Column, contrast: Column, size: Column) -> Column:
    return clip(sharp * SHARP_WEIGHT + contrast * CONTRAST_WEIGHT + size * SIZE_WEIGHT)


def route(score: Column) -> Column:
    return F.when(score >= ADMIT, "admissible").when(score >= DEGRADED, "degraded").otherwise("refused")


def rejection_reason(sharp: Column, contrast: Column, size: Column, score: Column, width: Column, height: Column) -> Column:
    """Why a page is not admitted: up to four clauses; null if it is."""
    clauses = F.concat_ws(
        "; ",
        F.when(sharp < 0.5, F.format_string("text too blurry (sharpness=%.2f)", sharp)),
        F.when(contrast < 0.5, F.format_string("insufficient contrast (%.2f)", contrast)),
        F.when(size < 0.5, F.format_string(f"resolution too low (%dx%d, min {MIN_SIDE}px)", width, height)),
        F.when(score < ADMIT, F.format_string(f"overall legibility %.2f < threshold {ADMIT}", score)),
    )
    return F.when(score < ADMIT, clauses)


def scaled_confidence(confidence: Column, score: Column, admissible: Column) -> Column:
    """Confidence times legibility (at least a half; at most 0.6 for a page that was not admitted)."""
    factor = F.greatest(F.lit(0.5), F.least(F.lit(1.0), score))
    factor = F.when(admissible, factor).otherwise(F.least(factor, F.lit(0.6)))
    return clip(confidence * factor)
