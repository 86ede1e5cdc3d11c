"""Rounding to decimal digits as published tables round: half to even, by a double's exact value.

Spark's ``round`` takes the shortest decimal that reads back as the double, so 2.675, which as a double is
a little less, becomes 2.68. Here the product with the power of ten is kept with its error, by splitting
both factors into halves whose products are exact, and the error decides where the product alone is a tie.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Splits a double's 53 bits into two halves.
SPLITTER = 2.0**27 + 1


def _halves(x: Column) -> tuple[Column, Column]:
    spread = x * F.lit(SPLITTER)
    high = spread - (spread - x)
    return high, x - high


def round_half_even(x: Column, digits: int = 4) -> Column:
    """``x`` to ``digits`` decimal digits (0 to 15), the nearest double to the decimal; exact for
    ``|x| * 10 ** digits`` below 2 ** 52, beyond which doubles have no such digits and ``x`` stays."""
    if not 0 <= digits <= 15:
        raise ValueError("digits must be 0 to 15")
    scale = 10**digits
    # Half the digits of the scale are enough for exact products: 10 ** 15 has 50 bits.
    scale_high = float((scale >> 25) << 25)
    scale_low = float(scale - int(scale_high))
    size = F.abs(x.cast("double"))
    high, low = _halves(size)
    product = size * F.lit(float(scale))
    error = ((high * scale_high - product) + high * scale_low + low * scale_high) + low * scale_low
    whole = F.floor(product).cast("double")
    past_half = product - whole - 0.5
    odd = F.pmod(whole, F.lit(2.0)) == 1
    up = (past_half > 0) | ((past_half == 0) & ((error > 0) | ((error == 0) & odd)))
    # A product that rounding lifted to a whole number is just below it: still nearest to that number.
    nearest = (whole + up.cast("double")) / F.lit(float(scale))
    return F.when(product < 2.0**52, F.when(x < 0, -nearest).otherwise(nearest)).otherwise(x)
