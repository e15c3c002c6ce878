"""Observations: a value with its denominator, or the reason why there is none."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .rules import FLOOR


def rounded(x: Column, digits: int = 4) -> Column:
    """Half up as SQL rounds a double: the scaled value, so that 57 / 800 is 0.0712, just below 712.5 when scaled, and not 0.0713 as its digits 0.07125 would give."""
    scale = F.lit(10.0**digits)
    return F.round(x * scale) / scale


def rounded_duration(x: Column) -> Column:
    """Four digits of a long duration, rounded in decimals, where ties of doubles are a matter of representation."""
    return F.round(x.cast("decimal(20,6)"), 4).cast("double")


def half_even(x: Column, digits: int = 4) -> Column:
    """Rounding of the exact binary value, ties to even, as scripting languages round."""
    return F.call_function("format_number", x, F.lit("0." + "0" * digits)).cast("double")


def ratio(n: Column, d: Column, digits: int = 4) -> Column:
    """n / d rounded; null for an empty denominator."""
    return rounded(n.cast("double") / F.nullif(d.cast("double"), F.lit(0.0)), digits)


def gated(value: Column, population: Column, floor: int = FLOOR) -> Column:
    """The value, if the population reaches the floor."""
    return F.when(population >= floor, value)


def reason(population: Column, floor: int = FLOOR, empty: str = "no_population") -> Column:
    """Why a gated value is null; null if it isn't."""
    return F.when(population == 0, empty).when(population < floor, "insufficient_population")
