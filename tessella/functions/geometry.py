"""Boxes as structs of x0, y0, x1, y1 in 0..1."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def box(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    return F.struct(x0.cast("double").alias("x0"), y0.cast("double").alias("y0"), x1.cast("double").alias("x1"), y1.cast("double").alias("y1"))


def clamp(b: Column) -> Column:
    """Within the page, corners in order."""
    inside = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))
    return box(inside(F.least(b["x0"], b["x1"])), inside(F.least(b["y0"], b["y1"])), inside(F.greatest(b["x0"], b["x1"])), inside(F.greatest(b["y0"], b["y1"])))


def from_pixels(x0: Column, y0: Column, x1: Column, y1: Column, width: Column, height: Column) -> Column:
    return clamp(box(x0 / width, y0 / height, x1 / width, y1 / height))


def hull(points: Column) -> Column:
    """Smallest box around an array of structs x, y; null for none."""
    xs, ys = F.transform(points, lambda p: p["x"]), F.transform(points, lambda p: p["y"])
    return F.when(F.size(points) > 0, clamp(box(F.array_min(xs), F.array_min(ys), F.array_max(xs), F.array_max(ys))))


def affine(b: Column, m: tuple[float, float, float, float, float, float]) -> Column:
    """The hull of a box's corners under x' = m0 x + m1 y + m2, y' = m3 x + m4 y + m5."""
    corner = lambda x, y: F.struct((m[0] * x + m[1] * y + m[2]).alias("x"), (m[3] * x + m[4] * y + m[5]).alias("y"))
    return hull(F.array(corner(b["x0"], b["y0"]), corner(b["x1"], b["y0"]), corner(b["x0"], b["y1"]), corner(b["x1"], b["y1"])))


def contains(outer: Column, inner: Column, slack: float = 0.01) -> Column:
    return (inner["x0"] >= outer["x0"] - slack) & (inner["y0"] >= outer["y0"] - slack) & (inner["x1"] <= outer["x1"] + slack) & (inner["y1"] <= outer["y1"] + slack)


def orientation(words: DataFrame, page: str, angle: str, confidence: str, least_words: int = 5, least_share: float = 0.6, sure: float = 0.5) -> DataFrame:
    """(page, orientation): the quarter turn that confident words agree on; uncertain with few words or a mixed vote."""
    quarter = (F.pmod(F.round(F.col(angle) / 90), F.lit(4)) * 90).cast("int")
    votes = words.where(F.col(confidence) >= sure).groupBy(page, quarter.alias("q")).agg(F.count("*").alias("n"))
    best = votes.groupBy(page).agg(F.max(F.struct("n", (-F.col("q")).alias("q"))).alias("b"), F.sum("n").alias("total"))
    voted = best.select(page, F.when((F.col("total") >= least_words) & (F.col("b.n") / F.col("total") >= least_share), (-F.col("b.q")).cast("string")).otherwise("uncertain").alias("orientation"))
    return words.select(page).distinct().join(voted, page, "left").select(page, F.coalesce("orientation", F.lit("uncertain")).alias("orientation"))
