"""Column functions on decimal prices."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, DoubleType

#: The cap of the insider share in the market and in the model variant of the margin solver.
Z_MARKET, Z_MODEL = 0.5, 0.99


def american_to_decimal(price: Column) -> Column:
    """-110 -> 1.909..., +150 -> 2.5; null for 0."""
    return F.when(price < 0, 100.0 / -price + 1.0).when(price > 0, price / 100.0 + 1.0)


def valid(price: Column) -> Column:
    """The price, or null where it cannot be one (not finite, or not above 1)."""
    return F.when((price > 1.0) & ~F.isnan(price) & (price < float("inf")), price)


def vig_pct(*prices: Column) -> Column:
    """Margin over the sum of implied probabilities, in percent; null if a price is."""
    total = F.lit(0.0)
    for p in prices:
        total = total + 1.0 / p
    return (total - 1.0) * 100.0


def proportional(price: Column, *others: Column) -> Column:
    """Fair probability of the first side by dividing the implied ones by their sum."""
    total = 1.0 / price
    for p in others:
        total = total + 1.0 / p
    return (1.0 / price) / total


def shin_two_way(price: Column, other: Column) -> Column:
    """Fair probability of the first of two sides under insider trading, in closed form.

    With implied a, b and S = a + b > 1 the insider share is z = (S-1)((a-b)^2-S) / (S((a-b)^2-1)); below its cap of 0.5 the
    fair probability is a - (S-1)/2 exactly. At the cap both sides are computed there and normalised. S <= 1: normalised only."""
    a, b = 1.0 / price, 1.0 / other
    s, d2 = a + b, (a - b) * (a - b)
    z = (s - 1.0) * (d2 - s) / (s * (d2 - 1.0))
    at_cap = lambda x: F.sqrt(0.25 + 2.0 * x * x / s) - 0.5
    return F.when(s <= 1.0, a / s).when(z < Z_MARKET, a - (s - 1.0) / 2.0).otherwise(at_cap(a) / (at_cap(a) + at_cap(b)))


def shin(prices: np.ndarray, cap: float = Z_MARKET, steps: int = 60) -> np.ndarray:
    """Rows of prices to rows of fair probabilities by bisection on the insider share; rows with a bad price are NaN."""
    with np.errstate(invalid="ignore", divide="ignore"):
        pi = np.where(prices > 1.0, 1.0 / prices, np.nan)
        s = pi.sum(axis=1, keepdims=True)
        lo, hi = np.zeros_like(s), np.full_like(s, cap)
        share = lambda z: (np.sqrt(z * z + 4.0 * (1.0 - z) * pi * pi / s) - z) / (2.0 * (1.0 - z))
        for _ in range(steps):
            mid = (lo + hi) / 2.0
            over = share(mid).sum(axis=1, keepdims=True) > 1.0
            lo, hi = np.where(over, mid, lo), np.where(over, hi, mid)
        p = share((lo + hi) / 2.0)
        return np.where(s <= 1.0, pi / s, p / p.sum(axis=1, keepdims=True))


def power(prices: np.ndarray, steps: int = 200) -> np.ndarray:
    """Rows of prices to fair probabilities pi^k with k such that they sum to 1."""
    with np.errstate(invalid="ignore", divide="ignore"):
        pi = np.where(prices > 1.0, 1.0 / prices, np.nan)
        s = pi.sum(axis=1, keepdims=True)
        lo, hi = np.full_like(s, 1e-3), np.ones_like(s)
        for _ in range(60):
            grow = (pi**hi).sum(axis=1, keepdims=True) > 1.0
            if not grow.any():
                break
            hi = np.where(grow, hi * 2.0, hi)
        for _ in range(steps):
            mid = (lo + hi) / 2.0
            over = (pi**mid).sum(axis=1, keepdims=True) > 1.0
            lo, hi = np.where(over, mid, lo), np.where(over, hi, mid)
        p = pi ** ((lo + hi) / 2.0)
        return p / p.sum(axis=1, keepdims=True)


@pandas_udf(ArrayType(DoubleType()))
def shin_three_way(a: pd.Series, b: pd.Series, c: pd.Series) -> pd.Series:
    return pd.Series(shin(np.column_stack([a, b, c]).astype(float)).tolist())


@pandas_udf(ArrayType(DoubleType()))
def shin_model(a: pd.Series, b: pd.Series, c: pd.Series) -> pd.Series:
    return pd.Series(shin(np.column_stack([a, b, c]).astype(float), Z_MODEL, 200).tolist())


@pandas_udf(ArrayType(DoubleType()))
def power_three_way(a: pd.Series, b: pd.Series, c: pd.Series) -> pd.Series:
    return pd.Series(power(np.column_stack([a, b, c]).astype(float)).tolist())


def kelly_stake(price: Column, fair: Column, fraction: float = 0.25, bankroll: float = 1000.0) -> Column:
    """Fractional Kelly stake, never negative."""
    return F.greatest(F.lit(0.0), (fair * price - 1.0) / (price - 1.0) * fraction * bankroll)


def edge_pct(price: Column, fair: Column) -> Column:
    return (price * fair - 1.0) * 100.0


def line_text(line: Column) -> Column:
    """A line with its sign and without trailing zeros: +1.5, -2, 0."""
    plain = F.regexp_replace(F.format_string("%.2f", F.abs(line)), r"\.?0+$", "")
    return F.when(line > 0, F.concat(F.lit("+"), plain)).when(line < 0, F.concat(F.lit("-"), plain)).otherwise(F.when(line.isNotNull(), F.lit("0")))


def devig_three_way(a: Column, b: Column, c: Column, method: str = "auto") -> Column:
    """Fair chances of three sides by 'shin', 'power' or 'proportional'; 'auto' is shin, as for every market of three sides or more."""
    if method == "proportional":
        return F.array(proportional(a, b, c), proportional(b, a, c), proportional(c, a, b))
    return {"auto": shin_model, "shin": shin_model, "power": power_three_way}[method](a, b, c)


@pandas_udf(ArrayType(DoubleType()))
def power_two_way(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series(power(np.column_stack([a, b]).astype(float)).tolist())


def devig_two_way(a: Column, b: Column, method: str = "auto") -> Column:
    """The same of two sides; 'auto' is power."""
    if method == "proportional":
        return F.array(proportional(a, b), proportional(b, a))
    if method == "shin":
        return F.array(shin_two_way(a, b), shin_two_way(b, a))
    return {"auto": power_two_way, "power": power_two_way}[method](a, b)


def clamped(value: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(value, F.lit(low)), F.lit(high))
