"""Minimum detectable effects and simulated power."""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from paneloom.functions import tails, variates
from paneloom.operators import ordering as O

POWER = 0.80
N_SIMS = 4_000  # published budget
HELD = 4_000_000  # numbers in a task's largest array
TAU_SD_NULL = math.sqrt(11 / 27)  # SD of the three-item tau under independence


def _reaches(fn, start: float = 1.0) -> float:
    """Where an increasing test turns true: the bound is doubled until it does, then halved down to the last bit."""
    low, high = 0.0, start
    while not fn(high):
        low, high = high, 2 * high
    while low < (low + high) / 2 < high:
        middle = (low + high) / 2
        low, high = (low, middle) if fn(middle) else (middle, high)
    return high


def noncentrality_df4(alpha: float, power: float) -> float:
    """Noncentrality of a chi-square with 4 degrees of freedom that reaches the power.

    The noncentral tail is a Poisson mixture of closed forms, summed until the
    weights past its mean no longer count; a scalar search on parameters only.
    """
    def central(x: float, half: int) -> float:
        return math.fsum(math.exp(k * math.log(x / 2) - x / 2 - math.lgamma(k + 1)) if x > 0 else float(k == 0)
                         for k in range(half))

    critical = _reaches(lambda x: central(x, 2) <= alpha)

    def tail(lam: float) -> float:
        j, total, closed = 0, 0.0, central(critical, 2)
        while True:
            weight = math.exp(j * math.log(lam / 2) - lam / 2 - math.lgamma(j + 1))
            total += weight * closed
            if j > lam / 2 and weight < 1e-18:
                return total
            closed += math.exp((2 + j) * math.log(critical / 2) - critical / 2 - math.lgamma(3 + j))
            j += 1

    return _reaches(lambda lam: tail(lam) >= power)


def constants(alpha: float = 0.05 / 6, power: float = POWER) -> tuple[float, float, float]:
    """Squared sum of normal quantiles, small-sample shift and noncentrality behind detectable()."""
    upper = NormalDist().inv_cdf(1 - alpha / 2)
    z = upper + NormalDist().inv_cdf(power)
    return z * z, 2 * (upper ** 2 / 4), noncentrality_df4(alpha, power)


def detectable(counts: DataFrame, alpha: float = 0.05 / 6, power: float = POWER) -> DataFrame:
    """Detectable effects at the nominal n (observations) and the independent n (subjects)."""
    z2, shift, lam = constants(alpha, power)

    def dz(n: Column) -> Column:
        # Normal approximation with the usual small-sample term for Student's t.
        return F.sqrt(F.lit(z2) / (n - F.lit(shift)))

    out = {}
    for label, n in (("nominal", F.col("n_obs")), ("independent", F.col("n_subjects"))):
        out[f"dz_{label}"] = dz(n)
        out[f"v_{label}"] = F.sqrt(F.lit(lam) / (2 * n))
        out[f"tau_{label}"] = dz(n) * TAU_SD_NULL
    return counts.withColumns(out)


def _weighted_median(levels: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Median of every simulation; levels ascend, a row of counts per simulation."""
    upto, n = np.cumsum(counts, axis=1), counts.sum(axis=1)

    def at(place):
        return levels[(upto <= place[:, None]).sum(axis=1)]

    return (at((n - 1) // 2) + at(n // 2)) / 2


def _brown_forsythe(levels: list[np.ndarray], counts: list[np.ndarray]) -> np.ndarray:
    """W of every simulation from the level counts of two groups; nan where no value deviates."""
    sums = []
    for values, own in zip(levels, counts):
        deviation = np.abs(values[None, :] - _weighted_median(values, own)[:, None])
        weighted = own * deviation
        sums.append((own.sum(axis=1).astype(float), weighted.sum(axis=1), (weighted * deviation).sum(axis=1)))
    (n0, z0, q0), (n1, z1, q1) = sums
    grand = (z0 + z1) / (n0 + n1)
    between = n0 * (z0 / n0 - grand) ** 2 + n1 * (z1 / n1 - grand) ** 2
    within = q0 - z0 * z0 / n0 + q1 - z1 * z1 / n1
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(within > 0, (n0 + n1 - 2) * between / within, np.nan)


def brown_forsythe_power(cases: DataFrame, value: Column, ratios: list[float], n_sims: int, seed: int,
                         base_more_variable: bool = True, alpha: float = 0.05 / 6) -> DataFrame:
    """Share of simulations that detect a given SD ratio, at the data's own n.

    Both groups are drawn from the empirical distribution. The level counts of a simulated group are one multinomial,
    a chain of conditional binomials over the levels, so a simulation costs the distinct values of the measure and not
    its cases; the ratios rescale the levels of those counts and share one set of draws. A task gets the level table,
    one row per distinct value, and a block of simulations that keeps its arrays within `HELD` numbers.
    """
    levels = O.value_counts(cases, [], value).select(F.col("v").cast("double").alias("v"), "n")
    n_levels = levels.count()
    block = max(1, min(250, HELD // max(n_levels, 1)))
    blocks = F.sequence(F.lit(0), F.lit(math.ceil(n_sims / block) - 1))
    sides = [1.0, -1.0 if base_more_variable else 1.0]

    def simulated(frame: pd.DataFrame) -> pd.DataFrame:
        number = int(frame["_block"].iat[0])
        sims = min(block, n_sims - number * block)
        table = frame.sort_values("v")
        v, n = table["v"].to_numpy(float), table["n"].to_numpy(np.int64)
        drawn = [variates.generator(seed, "power", number, side).multinomial(n.sum(), n / n.sum(), sims) for side in (0, 1)]
        centre = float(_weighted_median(v, n[None, :])[0])
        return pd.concat([pd.DataFrame({
            "ratio": ratio, "w": _brown_forsythe([v, centre + (v - centre) * ratio ** sides[1]], drawn), "n": int(n.sum())}) for ratio in ratios])

    tests = levels.withColumn("_block", F.explode(blocks)).groupBy("_block").applyInPandas(
        simulated, "ratio double, w double, n bigint")
    # F tails are worked out once per distinct statistic of a ratio.
    counted = tests.withColumn("w", F.nanvl("w", F.lit(None).cast("double"))).groupBy("ratio", "w", "n").agg(F.count("*").alias("sims"))
    p = tails.f_tail(F.col("w"), F.lit(1), 2 * F.col("n") - 2)
    hit = F.coalesce((F.col("p") < alpha).cast("int"), F.lit(0))
    return counted.withColumn("p", p).groupBy("ratio").agg(
        F.sum("sims").alias("n_sims"), (F.sum(hit * F.col("sims")) / F.sum("sims")).alias("power"))
