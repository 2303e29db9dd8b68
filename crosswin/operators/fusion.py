"""Combine the scores of the two modalities."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from crosswin.functions.expr import array_sum, col, finite


def sanitize_score(c: str) -> Column:
    """Scores that are no number become one half."""
    return F.when(finite(c), col(c).cast("double")).otherwise(0.5)


def fusion_mean_binary(a: str, b: str) -> Column:
    return (sanitize_score(a) + sanitize_score(b)) / 2.0


def fusion_mean_multiclass(a: str, b: str) -> Column:
    """Mean of two probability arrays, bad entries as 0, normalised (all-zero rows stay 0)."""
    def clean(v: Column) -> Column:
        return F.when(finite(v), v.cast("double")).otherwise(0.0)

    mean = F.zip_with(a, b, lambda x, y: (clean(x) + clean(y)) / 2.0)
    return F.transform(F.array(array_sum(mean)), lambda s: F.transform(
        mean, lambda v: v / F.when(s == 0.0, 1.0).otherwise(s)))[0]
