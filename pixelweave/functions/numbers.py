"""Rounding and unit helpers as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def half_up(x: Column) -> Column:
    """Nearest integer, halves towards plus infinity."""
    return F.floor(x + 0.5)


def byte(x: Column) -> Column:
    """Stored as an unsigned byte: halves to even, clamped to 0..255."""
    return F.least(F.lit(255), F.greatest(F.lit(0), F.bround(x))).cast("int")


def to_mm(value: Column, unit: Column) -> Column:
    return value * F.when(unit == "cm", 10.0).when(unit == "in", 25.4).otherwise(1.0)


def from_mm(mm: Column, unit: Column) -> Column:
    return mm / F.when(unit == "cm", 10.0).when(unit == "in", 25.4).otherwise(1.0)


def hex_channel(color: Column, i: int) -> Column:
    """Channel 0..2 of ``#rrggbb``; anything else gives 0."""
    good = color.rlike("^#[0-9a-fA-F]{6}$")
    return F.when(good, F.conv(F.substring(color, 2 + 2 * i, 2), 16, 10).cast("int")).otherwise(F.lit(0))
