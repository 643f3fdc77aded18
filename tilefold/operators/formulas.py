"""Closed formulas as column expressions: option prices and point sequences."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: coefficients of the rational approximation of the normal distribution (error below 1e-7)
NORMAL = (0.31938153, -0.356563782, 1.781477937, -1.821255978, 1.330274429)
SLOPE, ROOT = 0.2316419, 0.3989422804014327


def normal(x: Column) -> Column:
    """The standard normal distribution function."""
    q = 1 / (1 + F.abs(x) * SLOPE)
    total = F.lit(NORMAL[-1])
    for c in NORMAL[-2::-1]:
        total = q * total + c
    tail = F.exp(-x * x / 2) * ROOT * q * total
    return F.when(x > 0, 1 - tail).otherwise(tail)


def black_scholes(price: Column, strike: Column, years: Column, rate: Column, spread: Column) -> tuple[Column, Column]:
    """Prices of a European call and put."""
    root = spread * F.sqrt(years)
    d1 = (F.log(price / strike) + (rate + spread * spread / 2) * years) / root
    n1, n2, later = normal(d1), normal(d1 - root), strike * F.exp(-rate * years)
    return price * n1 - later * n2, later * (1 - n2) - price * (1 - n1)


def radical_inverse(i: Column, base: int, digits: int) -> Column:
    """The digits of i in a base, mirrored at the point: the van der Corput sequence."""
    return sum((F.floor(i / base**k) % base / float(base ** (k + 1)) for k in range(digits)), F.lit(0.0))
