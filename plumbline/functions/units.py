"""Lengths and areas: conversion between units, and how they are written. Lengths are decimal feet, areas square feet."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

METERS_PER_FOOT = 0.3048
SQ_METERS_PER_SQ_FOOT = METERS_PER_FOOT * METERS_PER_FOOT


def half_up(x: Column) -> Column:
    """The nearest whole number, halves towards plus infinity."""
    return F.floor(x + 0.5)


def fixed(x: Column, places: int) -> Column:
    """x with so many decimals, halves up, without grouping."""
    unit = 10**places
    scaled = half_up(F.abs(x) * unit)
    digits = F.lpad((scaled % unit).cast("string"), places, "0")
    return F.concat(F.when((x < 0) & (scaled > 0), F.lit("-")).otherwise(F.lit("")), F.floor(scaled / unit).cast("string"), F.lit("."), digits)


def grouped(n: Column) -> Column:
    """A whole number with a comma every three digits."""
    return F.format_number(n.cast("bigint"), 0)


def feet_inches(x: Column) -> Column:
    """struct<feet, inches>: whole feet and rounded inches, twelve of which are a foot more."""
    inches = (F.floor(x) * 12 + half_up((x - F.floor(x)) * 12)).cast("bigint")
    return F.struct(F.floor(inches / 12).cast("bigint").alias("feet"), (inches - 12 * F.floor(inches / 12)).cast("bigint").alias("inches"))


def from_feet_inches(feet: Column, inches: Column) -> Column:
    return feet + inches / 12


def to_meters(x: Column) -> Column:
    return x * METERS_PER_FOOT


def from_meters(x: Column) -> Column:
    return x / METERS_PER_FOOT


def to_sq_meters(x: Column) -> Column:
    return x * SQ_METERS_PER_SQ_FOOT


def format_length(x: Column, unit: Column, style: Column) -> Column:
    """x in the unit (inches, metric, or else decimal) and the style in which the drawing writes its own."""
    fi, m, d = feet_inches(x), fixed(to_meters(x), 2), fixed(x, 1)
    inches = F.when(style == "explicit", F.concat(fi["feet"], F.lit(" ft "), fi["inches"], F.lit(" in"))).when(style == "tick-space", F.concat(fi["feet"], F.lit("' "), fi["inches"], F.lit('"')))
    inches = inches.otherwise(F.concat(fi["feet"], F.lit("'"), fi["inches"], F.lit('"')))
    metric = F.concat(m, F.when(style == "meters", F.lit(" meters")).otherwise(F.lit(" m")))
    decimal = F.concat(d, F.when(style == "tick", F.lit("'")).when(style == "bare", F.lit("")).otherwise(F.lit(" ft")))
    return F.when(unit == "inches", inches).when(unit == "metric", metric).otherwise(decimal)


def area_shown(x: Column, unit: Column) -> Column:
    """The number shown for an area: whole, but two decimals below one square metre; nothing below zero."""
    m = to_sq_meters(x)
    metric = F.when(m >= 1, half_up(m).cast("double")).otherwise(half_up(m * 100) / 100)
    return F.when(unit == "metric", metric).otherwise(F.when(x > 0, half_up(x)).otherwise(F.lit(0)).cast("double"))


def format_area_number(n: Column, unit: Column) -> Column:
    """struct<value, suffix> of a number that is rounded already."""
    whole = n == F.floor(n)
    parts = F.concat(grouped(F.floor(n)), F.lit("."), F.lpad((half_up(n * 100) % 100).cast("string"), 2, "0"))
    return F.struct(F.when(whole, grouped(F.floor(n))).otherwise(parts).alias("value"), F.when(unit == "metric", F.lit("m²")).otherwise(F.lit("ft²")).alias("suffix"))


def format_area(x: Column, unit: Column) -> Column:
    """struct<value, suffix> of an area."""
    m = to_sq_meters(x)
    metric = F.when(m >= 1, grouped(half_up(m))).otherwise(fixed(m, 2))
    return F.struct(
        F.when(unit == "metric", metric).otherwise(F.when(x > 0, grouped(half_up(x))).otherwise(F.lit("0"))).alias("value"),
        F.when(unit == "metric", F.lit("m²")).otherwise(F.lit("ft²")).alias("suffix"),
    )


def dimension_input(x: Column, unit: Column) -> Column:
    """The text of an input field; empty for nothing, zero and what is no number."""
    fi = feet_inches(x)
    out = F.when(unit == "inches", F.concat(fi["feet"], F.lit("' "), fi["inches"], F.lit('"'))).when(unit == "metric", fixed(to_meters(x), 2)).otherwise(fixed(x, 1))
    return F.when(x.isNull() | F.isnan(x) | (x == 0), F.lit("")).otherwise(out)


def style_of(text: Column, fmt: Column) -> Column:
    """The style of one printed dimension of a format (inches, decimal, meters)."""
    has = lambda s: F.contains(text, F.lit(s))
    return (
        F.when(fmt == "inches", F.when(has("ft") | has("in"), F.lit("explicit")).when(has("' "), F.lit("tick-space")).otherwise(F.lit("tick")))
        .when(fmt == "decimal", F.when(has("'"), F.lit("tick")).when(has("ft") | has("feet"), F.lit("ft")).otherwise(F.lit("bare")))
        .when(fmt == "meters", F.when(has("meters"), F.lit("meters")).otherwise(F.lit("m")))
    )
