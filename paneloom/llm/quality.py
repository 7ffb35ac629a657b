"""Robust multivariate outliers: minimum covariance determinant per language and source.

Five statistics of a text are transformed (logarithms of counts, square roots of
shares). Documents are first added up in a fixed grid of small cells per group,
with exact sums and cross products, so a group of any size reaches its task as at
most one row per occupied cell. There the subset of `share` of the documents with
the smallest covariance determinant is found by concentration steps over cells from
several starts, reweighted once, and every document is judged by its own Mahalanobis
distance. Groups under `least` documents are judged by their language's estimate,
languages under it by the estimate of all; below that nothing is an outlier.

A null or empty text has zeros everywhere and fails the base rules. Null languages
and sources are groups of their own; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections import Counter
from itertools import islice

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import LongType

from paneloom.functions.tails import chi2_sf
from paneloom.llm.rows import per_row
from paneloom.llm.words import ASCII_SPACE, spaced_words
from paneloom.session import materialise

SYMBOLS = "#*$%&|<>"
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
WINDOW = 5
FEATURES = ["log_words", "log_word_length", "root_symbols", "log_dup_lines", "root_repeats"]
# Width of a grid cell, and the resolution added to every spread: a statistic that is the same
# in most documents of a group has no spread of its own, and length alone is no fault.
CELL = np.array([0.25, 0.1, 0.05, 0.35, 0.05])
RESOLUTION = np.array([1.0, 0.1, 0.08, 0.5, 0.1])
_P = len(FEATURES)


def repeated_words(words: list[bytes], size: int = WINDOW) -> int:
    """Words inside windows of `size` words that occur twice or more, the first included.

    Hashes of windows are compared first; only windows whose hash repeats are compared as words.
    """
    n = len(words) - size + 1
    if n < 2:
        return 0
    hashes = np.fromiter(map(hash, zip(*[islice(words, i, None) for i in range(size)])), np.int64, n)
    ordered = np.sort(hashes)
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(twice):
        return 0
    places = np.flatnonzero(np.isin(hashes, twice)).tolist()
    seen = Counter(tuple(words[p:p + size]) for p in places)
    marks = np.zeros(len(words) + 1, np.int64)
    for p in places:
        if seen[tuple(words[p:p + size])] > 1:
            marks[p] += 1
            marks[p + size] -= 1
    return int((np.cumsum(marks) > 0).sum())


def text_statistics(text: str | None) -> tuple[int, int, int, int, int]:
    """The five counts of COUNTS."""
    if not text:
        return 0, 0, 0, 0, 0
    words = spaced_words(text)
    lines = [line for line in text.split("\n") if line.strip(ASCII_SPACE)]
    return (len(words), len(text) - sum(map(text.count, ASCII_SPACE)), sum(map(text.count, SYMBOLS)),
            len(lines) - len(set(lines)), repeated_words(words))


def features() -> list[Column]:
    count = {name: F.col(name).cast("double") for name in COUNTS}
    per_word, per_char = F.greatest(count["n_words"], F.lit(1.0)), F.greatest(count["word_chars"], F.lit(1.0))
    return [F.log1p(count["n_words"]), F.log1p(count["word_chars"] / per_word), F.sqrt(count["n_symbols"] / per_char),
            F.log1p(count["n_dup_lines"]), F.sqrt(count["n_repeat_words"] / per_word)]


def chi2_quantile(tail: float, dof: int) -> float:
    """The value that a chi-square variable exceeds with probability `tail`."""
    low, high = 0.0, 1.0
    while chi2_sf(high, dof) > tail:
        high *= 2
    for _ in range(200):
        middle = (low + high) / 2
        low, high = (middle, high) if chi2_sf(middle, dof) > tail else (low, middle)
    return (low + high) / 2


def _moments(n, sums, products, chosen) -> tuple[np.ndarray, np.ndarray]:
    total = n[chosen].sum()
    mean = sums[chosen].sum(axis=0) / total
    return mean, products[chosen].sum(axis=0) / total - np.outer(mean, mean)


def _distances(points, mean, cov) -> np.ndarray:
    away = points - mean
    return np.einsum("ij,jk,ik->i", away, np.linalg.inv(cov), away)


def minimum_covariance(n, sums, products, share: float = 0.75, starts: int = 10, seed: int = 7):
    """Reweighted MCD mean and covariance of weighted cells, with the resolution added."""
    floor = np.diag(RESOLUTION ** 2)
    points, size = sums / n[:, None], n.sum()

    def nearest(distance):
        order = np.argsort(distance, kind="stable")
        upto = np.searchsorted(np.cumsum(n[order]), share * size) + 1
        return np.sort(order[:upto])

    def median(values):
        order = np.argsort(values, kind="stable")
        return values[order][np.searchsorted(np.cumsum(n[order]), size / 2)]

    middle = np.array([median(points[:, j]) for j in range(_P)])
    spread = np.array([1.4826 * median(np.abs(points[:, j] - middle[j])) for j in range(_P)])
    first = [nearest(_distances(points, middle, np.diag(spread ** 2) + floor))]
    draw = np.random.default_rng(seed)
    for _ in range(starts):
        few = draw.choice(len(n), size=min(len(n), _P + 1), replace=False, p=n / size)
        mean, cov = _moments(n, sums, products, few)
        first.append(nearest(_distances(points, mean, cov + floor)))
    best = None
    for chosen in first:
        for _ in range(100):
            mean, cov = _moments(n, sums, products, chosen)
            following = nearest(_distances(points, mean, cov + floor))
            if np.array_equal(following, chosen):
                break
            chosen = following
        mean, cov = _moments(n, sums, products, chosen)
        det = np.linalg.slogdet(cov + floor)[1]
        if best is None or det < best[0] - 1e-12:
            best = det, mean, cov, n[chosen].sum() / size
    _, mean, cov, held = best
    cov = cov * _consistency(held) + floor
    inside = _distances(points, mean, cov) <= chi2_quantile(0.025, _P)
    mean, cov = _moments(n, sums, products, inside if inside.any() else slice(None))
    return mean, cov * _consistency(0.975) + floor


def _consistency(share: float) -> float:
    """Makes the covariance of the innermost share of a normal sample that of the whole."""
    if share >= 1:
        return 1.0
    return share / (1 - chi2_sf(chi2_quantile(1 - share, _P), _P + 2))


_CROSS = [(i, j) for i in range(_P) for j in range(i, _P)]
_ESTIMATE = "level int, lang string, source string, n bigint, center array<double>, inverse array<double>"


def _estimate(cells: pd.DataFrame) -> pd.DataFrame:
    cells = cells.sort_values(["cell"])
    n = cells["n"].to_numpy(float)
    sums = np.stack(cells["sums"].to_list()).astype(float)
    flat = np.stack(cells["products"].to_list()).astype(float)
    products = np.zeros((len(n), _P, _P))
    for k, (i, j) in enumerate(_CROSS):
        products[:, i, j] = products[:, j, i] = flat[:, k]
    mean, cov = minimum_covariance(n, sums, products)
    head = cells.iloc[0]
    return pd.DataFrame({"level": [head["level"]], "lang": [head["lang"]], "source": [head["source"]], "n": [int(n.sum())],
                         "center": [mean.tolist()], "inverse": [np.linalg.inv(cov).ravel().tolist()]})


def estimates(stats: DataFrame, least: int = 50) -> DataFrame:
    """One estimate per (lang, source): its own, its language's or that of all documents."""
    x = [F.col(f"f{i}") for i in range(_P)]
    cell = F.concat_ws(":", *[F.floor(x[i] / float(CELL[i])).cast("string") for i in range(_P)])
    summed = lambda columns: F.array(*[F.sum(c) for c in columns])
    cells = stats.groupBy("lang", "source", cell.alias("cell")).agg(
        F.count(F.lit(1)).alias("n"), summed(x).alias("sums"), summed([x[i] * x[j] for i, j in _CROSS]).alias("products"))

    def coarser(level: int, lang: Column, source: Column) -> DataFrame:
        return cells.groupBy(F.lit(level).alias("level"), lang.alias("lang"), source.alias("source"), "cell").agg(
            F.sum("n").alias("n"), F.array(*[F.sum(F.col("sums")[i]) for i in range(_P)]).alias("sums"),
            F.array(*[F.sum(F.col("products")[k]) for k in range(len(_CROSS))]).alias("products"))

    none = F.lit(None).cast("string")
    levels = cells.select(F.lit(0).alias("level"), "lang", "source", "cell", "n", "sums", "products").unionByName(
        coarser(1, F.col("lang"), none)).unionByName(coarser(2, none, none))
    solved = materialise(levels.groupBy("level", "lang", "source").applyInPandas(_estimate, _ESTIMATE), "mcd")
    own, by_lang, of_all = (solved.where(F.col("level") == k).alias(name) for k, name in enumerate(("own", "tongue", "whole")))
    joined = own.join(by_lang, F.col("own.lang").eqNullSafe(F.col("tongue.lang")), "left").join(F.broadcast(of_all), F.lit(True), "left")

    def first(column: str) -> Column:
        return F.coalesce(*[F.when(F.col(f"{k}.n") >= least, F.col(f"{k}.{column}")) for k in ("own", "tongue", "whole")])

    return joined.select(F.col("own.lang").alias("lang"), F.col("own.source").alias("source"),
                         first("center").alias("center"), first("inverse").alias("inverse"))


def judge(docs: DataFrame, tail: float = 1e-6, least: int = 50) -> DataFrame:
    """doc_id, lang, source, the counts, base_failed, the squared distance and kept."""
    counted = per_row(docs.select("doc_id", "lang", "source", "text"), ["text"], {name: LongType() for name in COUNTS},
                      lambda: text_statistics, keep=["doc_id", "lang", "source"])
    stats = materialise(counted.select("*", *[c.alias(f"f{i}") for i, c in enumerate(features())]), "text-statistics")
    fits = estimates(stats, least)
    joined = stats.alias("d").join(
        fits.alias("e"), F.col("d.lang").eqNullSafe(F.col("e.lang")) & F.col("d.source").eqNullSafe(F.col("e.source")), "left")
    away = [F.col(f"f{i}") - F.col("center")[i] for i in range(_P)]
    distance = sum((away[i] * away[j] * F.col("inverse")[_P * i + j] for i in range(_P) for j in range(_P)), F.lit(0.0))
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return joined.select("doc_id", F.col("d.lang").alias("lang"), F.col("d.source").alias("source"), *COUNTS,
                         failed.alias("base_failed"), distance.alias("distance")).withColumn(
        "kept", ~F.col("base_failed") & ~F.coalesce(F.col("distance") > chi2_quantile(tail, _P), F.lit(False)))
