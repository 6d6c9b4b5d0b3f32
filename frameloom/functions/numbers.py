"""Rounding as on the exact binary value of a double, halves to even, in plain expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Splits a double of 53 bits into two of 26.
SPLITTER = float((1 << 27) + 1)


def round_binary(x: Column, places: int) -> Column:
    """A double rounded to so many places, 6 at most, as its exact value lies: 2.675, which is a little less, gives 2.67.

    x * 10^places is known exactly as p + e, by splitting x; only where p is just between two whole numbers does e, or
    else the even one, decide. Values so large that doubles lie farther apart than the places stay, as do infinite ones and NaN.
    """
    if not 0 <= places <= 6:
        raise ValueError("0 to 6 places")
    scale = float(10**places)

    def exact(v: Column) -> Column:
        c = v * SPLITTER
        high = c - (c - v)
        p = v * scale
        e = (high * scale - p) + (v - high) * scale
        whole = F.rint(p)
        apart = p - whole
        # From 2^52 on p has no fraction, and e may be the half.
        odd = F.abs(p % 2.0) == 1
        up = F.when((apart == 0.5) & (e > 0), 1.0).when((apart == -0.5) & (e < 0), -1.0).when((F.abs(e) == 0.5) & odd, F.signum(e))
        rounded = F.when(up.isNotNull(), whole + up).otherwise(whole)
        return F.when(F.abs(p) < float(1 << 53), rounded / scale).otherwise(v)

    return exact(x.cast("double"))
