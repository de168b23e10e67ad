"""Closed-form numeric expressions."""
from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, functions as F

# Fixed value: standard normal quantile at 0.975.
Z_975 = 1.959963984540054


def distance(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    dx, dy = x1 - x2, y1 - y2
    return F.sqrt(dx * dx + dy * dy)


def gaussian_kernel(dist: Column, sigma: Column) -> Column:
    """exp(-(dist / sigma)^2 / 2). A bandwidth of zero divides as IEEE numbers do: 0 at any distance, NaN at none."""
    ratio = dist / F.nullif(sigma, F.lit(0.0))
    return F.when(sigma != 0, F.exp(F.lit(-0.5) * ratio * ratio)).when(dist > 0, 0.0).when(dist == 0, float("nan"))


def display_transform(value: Column, scale: str, cofactor: float = 5.0) -> Column:
    if scale == "raw":
        return value
    if scale == "log1p":
        return F.log1p(value)
    if scale == "asinh" and cofactor > 0:
        return F.asinh(value / F.lit(float(cofactor)))
    raise ValueError("scale must be raw, log1p or asinh with a positive cofactor")


def log_cp10k(value: Column, library: Column) -> Column:
    return F.log1p(F.lit(10000.0) / library * value)


def permutation_p(exceed: Column, permutations: int) -> Column:
    return (exceed + 1) / F.lit(permutations + 1)


def entropy_term(p: Column) -> Column:
    return -p * F.ln(F.greatest(p, F.lit(1e-300)))


def wilson_interval(successes: Column, trials: Column) -> Column:
    """95% Wilson score interval as struct<low, high>."""
    n, z = trials.cast("double"), F.lit(Z_975)
    p = successes / n
    scale = 1 + z * z / n
    centre = (p + z * z / (2 * n)) / scale
    half = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / scale
    return F.struct(F.greatest(F.lit(0.0), centre - half).alias("low"), F.least(F.lit(1.0), centre + half).alias("high"))


def permutation_resolution(family: Column, permutations: Column, rank: Column, alpha: str = "0.05") -> Column:
    """Exact permutation-resolution arithmetic under the strict rule q < alpha.

    alpha is taken as a decimal text so that boundary cases are decided with integers only.
    """
    numerator, denominator = Decimal(alpha).as_integer_ratio()
    m, b1, r = family.cast("bigint"), (permutations + 1).cast("bigint"), rank.cast("bigint")
    num, den = F.lit(numerator).cast("bigint"), F.lit(denominator).cast("bigint")
    need_rank = F.call_function("div", m * den, b1 * num) + 1
    need_perm = F.call_function("div", m * den, r * num)
    attainable = m * den < r * num * b1
    return F.struct(
        (F.lit(1.0) / (permutations + 1)).alias("minimum_p"),
        (F.lit(float(alpha)) * rank / family).alias("rank_threshold"),
        need_rank.alias("minimum_rejection_rank"), need_perm.alias("minimum_permutations"),
        attainable.alias("rank_attainable"))
