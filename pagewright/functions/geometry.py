"""Boxes as structs ``(x1, y1, x2, y2)`` of doubles, origin at the top left."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BOX = "struct<x1:double,y1:double,x2:double,y2:double>"


def box(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return F.struct(*[c.cast("double").alias(n) for c, n in zip((x1, y1, x2, y2), ("x1", "y1", "x2", "y2"))])


def from_array(values: Column) -> Column:
    return box(*[F.element_at(values, k) for k in (1, 2, 3, 4)])


def to_array(b: Column) -> Column:
    return F.array(b["x1"], b["y1"], b["x2"], b["y2"])


def normalize(b: Column, width: Column, height: Column) -> Column:
    return box(b["x1"] / width, b["y1"] / height, b["x2"] / width, b["y2"] / height)


def denormalize(b: Column, width: Column, height: Column) -> Column:
    return box(b["x1"] * width, b["y1"] * height, b["x2"] * width, b["y2"] * height)


def checked(b: Column) -> Column:
    """The box itself; a bound outside 0..1 fails the query."""
    inside = F.forall(to_array(b), lambda v: (v >= 0) & (v <= 1))
    return F.when(F.assert_true(inside, "box outside the unit square").isNull(), b)


def area(b: Column) -> Column:
    """Signed: a box turned inside out in one direction is negative."""
    return (b["x2"] - b["x1"]) * (b["y2"] - b["y1"])


def overlap(a: Column, b: Column) -> Column:
    """Area of the intersection; 0 where boxes only touch or lie apart."""
    w = F.least(a["x2"], b["x2"]) - F.greatest(a["x1"], b["x1"])
    h = F.least(a["y2"], b["y2"]) - F.greatest(a["y1"], b["y1"])
    return F.when((w > 0) & (h > 0), w * h).otherwise(F.lit(0.0))


def union_of(b: Column) -> Column:
    """Aggregate: the box around a group; an empty group gives zeros."""
    zero = F.lit(0.0)
    return box(F.coalesce(F.min(b["x1"]), zero), F.coalesce(F.min(b["y1"]), zero), F.coalesce(F.max(b["x2"]), zero), F.coalesce(F.max(b["y2"]), zero))
