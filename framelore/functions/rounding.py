"""Rounding to decimal places as Python does it: half to even, on the exact binary value of a double."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def round_half_even(x: Column, places: int) -> Column:
    """``x`` to up to nine decimal places. ``bround`` rounds the shortest decimal text of a double, which 2.675 shows.

    The product with the power of ten may be rounded onto a half. What was lost then decides; it is exact, as both the part of
    ``x`` that a float holds and the rest have exact products with a power of so few bits. Doubles too large to have such
    places, infinities and NaN stay as they are.
    """
    if not 0 <= places <= 9:
        raise ValueError("places must be from 0 to 9")
    x, power = x.cast("double"), float(10**places)
    product, upper = x * power, x.cast("float").cast("double")
    lost = (upper * power - product) + (x - upper) * power
    aside = F.when(product * 2 == F.rint(product * 2), F.signum(lost) * 0.25).otherwise(0.0)
    return F.when(F.abs(x) < 2.0**53 / power, F.rint(product + aside) / power).otherwise(x)
