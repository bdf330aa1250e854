"""Small column functions with exact semantics at the edges."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def percent(part: Column, rest: Column, digits: int = 2) -> Column:
    """100 * part / (part + rest), rounded; 0 where both are 0."""
    return F.round(F.coalesce(F.try_divide(part * 100.0, part + rest), F.lit(0.0)), digits)


def ratio_or_zero(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def length_label(seconds: Column) -> Column:
    """Short under 4 minutes, Medium under 20, else Long."""
    return F.when(seconds < 240, "Short").when(seconds < 1200, "Medium").otherwise("Long")


def int_list(text: Column) -> Column:
    """`1|5|9` as numbers, empty parts dropped."""
    return F.transform(F.filter(F.split(text, r"\|"), lambda x: x != ""), lambda x: x.cast("long"))


def joined_list(numbers: Column) -> Column:
    """Distinct numbers in order as `1|5|9`."""
    return F.array_join(F.transform(F.array_sort(F.array_distinct(numbers)), lambda x: x.cast("string")), "|")


def newer(a: Column, b: Column) -> Column:
    """The later of two times; null counts as no time."""
    return F.greatest(a, b)


def flight(start_a: Column, start_b: Column, end_a: Column, end_b: Column) -> tuple[Column, Column]:
    """The later start and the earlier end; null counts as no limit."""
    return F.greatest(start_a, start_b), F.least(end_a, end_b)


def split_id(c: Column) -> tuple[Column, Column]:
    """`a_b_7` -> (`a_b`, `7`): parted at the last underscore."""
    return F.regexp_extract(c, "^(.*)_([^_]*)$", 1), F.regexp_extract(c, "^(.*)_([^_]*)$", 2)


def display_name(c: Column) -> Column:
    return F.regexp_replace(c, "^IAB: ?", "")


def language_label(name: Column, confidence: Column, known: Column, least: float = 0.8) -> Column:
    """Unknown under the confidence; known languages by their name; else foreign."""
    return F.when(confidence < least, "Unknown Language").when(F.array_contains(known, name), name).otherwise("Foreign Language")


def corner_boxes(width: Column, height: Column, size: int) -> Column:
    """Boxes (x, y, size) in the four corners and the centre of an image."""
    right, low = width - size, height - size
    at = [(F.lit(0), F.lit(0)), (right, F.lit(0)), (F.lit(0), low), (right, low), (F.floor(right / 2), F.floor(low / 2))]
    return F.array(*[F.struct(x.cast("long").alias("x"), y.cast("long").alias("y")) for x, y in at])


def grid_boxes(width: Column, height: Column, size: int, step: int) -> Column:
    """All boxes of a sliding window that lie within the image, row by row."""
    xs, ys = (F.sequence(F.lit(0), (n - size).cast("long"), F.lit(step)) for n in (width, height))
    return F.when((width >= size) & (height >= size), F.flatten(F.transform(ys, lambda y: F.transform(xs, lambda x: F.struct(x.cast("long").alias("x"), y.cast("long").alias("y")))))).otherwise(F.array().cast("array<struct<x:bigint,y:bigint>>"))


def clamped(v: Column) -> Column:
    return F.greatest(v, F.lit(0))


def condensed_index(i: Column, j: Column, n: Column) -> Column:
    """The place of the pair (i, j) in the upper triangle of an n x n matrix, row by row."""
    a, b = F.least(i, j), F.greatest(i, j)
    return (n * a - (a * (a + 1) / 2).cast("long") + b - a - 1).cast("long")


def hash_tag(*parts: Column) -> Column:
    return F.sha1(F.concat_ws("|", *parts))


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine_distance(a: Column, b: Column) -> Column:
    return 1 - dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))


def chi_square(a: Column, b: Column) -> Column:
    """Sum of (x - y)^2 / (x + y) over places where the sum isn't 0."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.coalesce(F.try_divide((x - y) * (x - y), x + y), F.lit(0.0))), F.lit(0.0), lambda s, x: s + x)


def intersection(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.least(x, y)), F.lit(0.0), lambda s, x: s + x)


def sign_bits(v: Column, planes: list[list[float]]) -> Column:
    """A string of bits: on which side of each plane a vector lies."""
    return F.concat(*[F.when(dot(v, F.array(*[F.lit(float(x)) for x in p])) >= 0, "1").otherwise("0") for p in planes])


def stable_hash(v: Column, directions: list[list[float]], offsets: list[float], width: float) -> Column:
    """floor((v . a + b) / width) for each direction, joined by colons."""
    return F.concat_ws(":", *[F.floor((dot(v, F.array(*[F.lit(float(x)) for x in a])) + b) / width).cast("string") for a, b in zip(directions, offsets, strict=True)])
