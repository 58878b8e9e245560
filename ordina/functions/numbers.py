"""Numbers: softmax, argmax, integer quantities of images."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def argmax(values: str | Column) -> Column:
    """Index (from 0) of the largest element, the first of equal ones."""
    return (F.array_position(values, F.array_max(values)) - 1).cast("long")


def best_probability(logits: Column) -> Column:
    """Softmax probability of the largest logit, in double precision: 1 / sum(exp(v - max))."""
    values = logits.cast("array<double>")
    top = F.array_max(values)
    return 1 / F.aggregate(values, F.lit(0.0), lambda s, v: s + F.exp(v - top))


def softmax(logits: Column) -> Column:
    """Stable softmax of an array, in double precision."""
    values = logits.cast("array<double>")
    shifted = F.transform(values, lambda v: F.exp(v - F.array_max(values)))
    return F.transform(shifted, lambda v: v / F.aggregate(shifted, F.lit(0.0), lambda s, x: s + x))


def ctc_min_frames(tokens: Column) -> Column:
    """Least frames that can spell a sequence: its length plus one for each repeat of a neighbour."""
    n = F.size(tokens)
    repeats = F.size(F.filter(F.zip_with(F.slice(tokens, F.lit(1), F.greatest(n - 1, F.lit(0))), F.slice(tokens, F.lit(2), F.greatest(n - 1, F.lit(0))), lambda a, b: a == b), lambda x: x))
    return F.when(n > 0, n + repeats).otherwise(0).cast("long")


def geometry(spacing: Column) -> tuple[Column, Column]:
    """Height (the next multiple of 16 from 12.8 spacings) and width (140 spacings, half to even) of a normalised line."""
    return (F.ceil(spacing * 12.8 / 16) * 16).cast("long"), F.bround(spacing.cast("double") * 140, 0).cast("long")


def to_byte(gray: Column) -> Column:
    """A gray value in [0, 1] as 0 to 255, rounded half up, clipped."""
    return F.floor(F.greatest(F.lit(0.0), F.least(F.lit(1.0), gray.cast("double"))) * 255 + 0.5).cast("int")


def is_ink(gray: Column, threshold: float = 0.6) -> Column:
    return gray < F.lit(threshold)


def invert_and_pad(pixels: Column, width: Column) -> Column:
    """Ink as 1, padded with 0 on the right."""
    ink = F.transform(pixels, lambda v: 1 - v)
    return F.concat(ink, F.array_repeat(F.lit(0.0), F.greatest(width - F.size(ink), F.lit(0)).cast("int")))
