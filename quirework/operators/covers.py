"""Scoring of cover analyses. Decoding images is left to a provider that fills the columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Significant colours of a generated cover at most, its size, and the share of a dominant colour.
FEW, WIDTH, HEIGHT, DOMINANT = 5, 1200, 1600, 0.6


def score(buckets: Column, width: Column, height: Column, dominant: Column) -> Column:
    few = buckets <= FEW
    half = lambda c, w: F.when(c, F.lit(w)).otherwise(F.lit(0.0))
    return half(few, 0.5) + half(few & (width == WIDTH) & (height == HEIGHT), 0.5) + half(dominant > DOMINANT, 0.2)
