"""Closed-form tests. Each takes grouping columns and tests every group in one job.

Data is reduced to counts or sums first; the tail probabilities are then taken
on result rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from paneloom.functions import tails
from paneloom.operators import ordering as O


def _add(columns: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, columns)


def versus_baseline(stats: DataFrame, keys: list[str], baseline: str) -> DataFrame:
    """Candidate rows of a (keys, source, ...) summary with the baseline's columns as *_b.

    `stats` holds one row per key and source; a window carries the baseline over,
    so the summary is computed once.
    """
    values = [c for c in stats.columns if c not in (*keys, "source")]
    peers = Window.partitionBy(*keys)
    is_base = F.col("source") == baseline
    carried = stats.withColumns({f"{c}_b": F.max(F.when(is_base, F.col(c))).over(peers) for c in values})
    return carried.where(~is_base)


def chi_square(df: DataFrame, a: list[str], b: list[str], strict: bool = True) -> DataFrame:
    """Independence of a two-row table given as count columns; no continuity correction.

    An all-zero column leaves the test undefined: it stops the job, or gives a
    null where `strict` is off.
    """
    ra, rb = _add([F.col(c) for c in a]), _add([F.col(c) for c in b])
    total = (ra + rb).cast("double")
    chi2, low = F.lit(0.0), None
    empty = F.lit(False)
    for ca, cb in zip(a, b):
        column = F.col(ca) + F.col(cb)
        empty = empty | (column == 0)
        for cell, row in ((F.col(ca), ra), (F.col(cb), rb)):
            expected = F.try_divide(row * column, total)
            chi2 = chi2 + F.when(expected > 0, (cell - expected) * (cell - expected) / expected).otherwise(0.0)
            low = expected if low is None else F.least(low, expected)
    stop = F.lit(None).cast("double")
    if strict:
        stop = F.raise_error(F.lit("a level has no rows on either side; no chi-square test is defined")).cast("double")
    dof = len(a) - 1
    checked = df.withColumn("chi2", F.when(empty, stop).otherwise(chi2))
    p = (tails.chi2_tail_even(F.col("chi2"), dof) if dof % 2 == 0
         else tails.chi2_tail(F.col("chi2"), F.lit(dof)))
    return checked.withColumns({
        "dof": F.lit(dof), "n_total": ra + rb, "min_expected": low, "p": p,
        "cramers_v": F.sqrt(F.try_divide(F.col("chi2"), ra + rb)),
    })


def _ranked_levels(df: DataFrame, group: list[str], level: str, value: Column, open_domain: bool,
                   min_rows: int = 1) -> DataFrame:
    """(group, level, v, n, place, peers); levels below min_rows are left out before ranking."""
    counts = df.where(value.isNotNull() & F.col(level).isNotNull()).groupBy(
        *group, F.col(level), value.alias("v")).agg(F.count("*").alias("n"))
    if min_rows > 1:
        size = F.sum("n").over(Window.partitionBy(*group, level))
        counts = counts.withColumn("_size", size).where(F.col("_size") >= min_rows).drop("_size")
    return O.tied_places(counts, group, "v", "place", "peers", open_domain)


def mann_whitney(df: DataFrame, group: list[str], level: str, first: str, second: str, value: Column,
                 open_domain: bool = False) -> DataFrame:
    """Two-sided U test of `first` against `second`; tie and continuity corrected normal p."""
    ranked = _ranked_levels(df.where(F.col(level).isin(first, second)), group, level, value, open_domain)
    is_first = F.col(level) == first
    wide = ranked.groupBy(*group).agg(
        F.sum(F.when(is_first, F.col("n"))).alias("n_first"), F.sum(F.when(~is_first, F.col("n"))).alias("n_second"),
        F.sum(F.when(is_first, F.col("n") * F.col("place"))).alias("r1"),
        F.sum(O.tie_term(F.col("n"), F.col("peers"))).alias("ties"))
    n1, n2 = F.col("n_first").cast("double"), F.col("n_second").cast("double")
    n = n1 + n2
    u = F.col("r1") - n1 * (n1 + 1) / 2
    sd = F.sqrt(n1 * n2 / 12 * ((n + 1) - F.try_divide(F.col("ties"), n * (n - 1))))
    z = F.try_divide(F.greatest(u, n1 * n2 - u) - n1 * n2 / 2 - 0.5, sd)
    return wide.select(
        *group, "n_first", "n_second", u.alias("u"), (n1 * n2 / 2).alias("u_null"),
        F.least(F.lit(1.0), 2 * tails.normal_tail(z)).alias("p"))


def kruskal(df: DataFrame, group: list[str], level: str, value: Column, open_domain: bool = False) -> DataFrame:
    """Tie-corrected H over levels with at least two rows, and the effect H / (N - 1)."""
    ranked = _ranked_levels(df, group, level, value, open_domain, min_rows=2)
    levels = ranked.groupBy(*group, level).agg(
        F.sum("n").alias("n"), F.sum(F.col("n") * F.col("place")).alias("rank_sum"),
        F.sum(O.tie_term(F.col("n"), F.col("peers"))).alias("ties"))
    sums = levels.groupBy(*group).agg(
        F.count("*").alias("k"), F.sum("n").alias("n"), F.sum("ties").alias("ties"),
        F.sum(F.col("rank_sum") * F.col("rank_sum") / F.col("n")).alias("q"))
    n = F.col("n").cast("double")
    h = F.try_divide(12 / (n * (n + 1)) * F.col("q") - 3 * (n + 1), 1 - F.col("ties") / (n * n * n - n))
    out = sums.where(F.col("k") >= 2).withColumn("h", h)
    return out.select(*group, "k", "n", "h", (F.col("h") / (F.col("n") - 1)).alias("effect"),
                      tails.chi2_tail(F.col("h"), F.col("k") - 1).alias("p"))


def spearman(df: DataFrame, group: list[str], x: Column, y: Column, min_rows: int = 10,
             open_domain: bool = False) -> DataFrame:
    """Rank correlation with a t-based p; null below `min_rows` rows."""
    joint = df.where(x.isNotNull() & y.isNotNull()).groupBy(*group, x.alias("x"), y.alias("y")).agg(
        F.count("*").alias("n"))
    ranked = O.tied_places(joint, group, "x", "rx", "_px", open_domain)
    ranked = O.tied_places(ranked, group, "y", "ry", "_py", open_domain)
    # Centred on the mean rank, which the group's size gives exactly.
    total = F.col("_total")
    staged = (ranked.withColumn("_total", F.sum("n").over(Window.partitionBy(*group))) if not open_domain
              else ranked.join(joint.groupBy(*group).agg(F.sum("n").alias("_total")), group))
    dx, dy, w = F.col("rx") - (total + 1) / 2, F.col("ry") - (total + 1) / 2, F.col("n")
    sums = staged.groupBy(*group).agg(
        F.sum(w).alias("m"), F.sum(w * dx * dy).alias("sxy"), F.sum(w * dx * dx).alias("sxx"),
        F.sum(w * dy * dy).alias("syy")).withColumnRenamed("m", "n")
    return _correlation(sums, group, "rho", min_rows)


def pearson(df: DataFrame, group: list[str], x: Column, y: Column, min_rows: int = 3) -> DataFrame:
    use = df.where(x.isNotNull() & y.isNotNull())
    sums = use.groupBy(*group).agg(
        F.count("*").alias("n"), (F.covar_samp(x, y) * (F.count("*") - 1)).alias("sxy"),
        (F.var_samp(x) * (F.count("*") - 1)).alias("sxx"), (F.var_samp(y) * (F.count("*") - 1)).alias("syy"))
    return _correlation(sums, group, "r", min_rows)


def _correlation(sums: DataFrame, group: list[str], name: str, min_rows: int) -> DataFrame:
    usable = (F.col("n") >= min_rows) & (F.col("sxx") > 0) & (F.col("syy") > 0)
    r = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("sxy") / F.sqrt(F.col("sxx") * F.col("syy"))))
    out = sums.withColumn(name, F.when(usable, r))
    c = F.col(name)
    t = F.when(F.abs(c) < 1, c * F.sqrt((F.col("n") - 2) / (1 - c * c))).otherwise(F.lit(float("inf")))
    return out.select(*group, "n", name, F.when(c.isNotNull(), tails.t_two_sided(t, F.col("n") - 2)).alias("p"))


def brown_forsythe(df: DataFrame, keys: list[str], value: Column, baseline: str, open_domain: bool = False) -> DataFrame:
    """Median-centred Levene test of each source's spread against the baseline's."""
    return brown_forsythe_counts(O.value_counts(df, [*keys, "source"], value), keys, baseline, open_domain)


def brown_forsythe_counts(counts: DataFrame, keys: list[str], baseline: str, open_domain: bool = False) -> DataFrame:
    """The same from value counts (keys, source, v, n); counts of cells can be added up first."""
    group = [*keys, "source"]
    dev = F.abs(F.col("v") - F.col("med"))
    stats = O.with_median(counts, group, "med", open_domain).groupBy(*group).agg(
        F.sum("n").alias("n"), F.sum(F.col("n") * dev).alias("z1"), F.sum(F.col("n") * dev * dev).alias("z2"),
        F.sum(F.col("n") * F.col("v")).alias("v1"), F.sum(F.col("n") * F.col("v") * F.col("v")).alias("v2"))
    sd = F.sqrt(F.try_divide(F.col("v2") - F.col("v1") * F.col("v1") / F.col("n"), F.col("n") - 1))
    pairs = versus_baseline(stats.withColumn("sd", sd), keys, baseline)
    return _levene(pairs).select(*keys, "source", F.col("n_b").alias("n_base"), "n", F.col("sd_b").alias("sd_base"),
                                 "sd", "w", "p")


def _levene(pairs: DataFrame) -> DataFrame:
    na, nb = F.col("n_b").cast("double"), F.col("n").cast("double")
    n = na + nb
    grand = (F.col("z1_b") + F.col("z1")) / n
    between = (na * (F.col("z1_b") / na - grand) * (F.col("z1_b") / na - grand)
               + nb * (F.col("z1") / nb - grand) * (F.col("z1") / nb - grand))
    within = (F.col("z2_b") - F.col("z1_b") * F.col("z1_b") / na) + (F.col("z2") - F.col("z1") * F.col("z1") / nb)
    out = pairs.withColumn("w", F.try_divide((n - 2) * between, within))
    return out.withColumn("p", tails.f_tail(F.col("w"), F.lit(1), F.col("n_b") + F.col("n") - 2))


def tau_summary(df: DataFrame, group: list[str], tau: Column) -> DataFrame:
    """Mean, SD, SE and a 95% interval of per-pair rank correlation."""
    out = df.groupBy(*group).agg(F.count(tau).alias("n"), F.avg(tau).alias("mean"), F.stddev_samp(tau).alias("sd"))
    se = F.col("sd") / F.sqrt("n")
    return out.withColumns({"se": se, "ci_low": F.col("mean") - 1.96 * se, "ci_high": F.col("mean") + 1.96 * se})


def wilcoxon_less(df: DataFrame, group: list[str], diff: Column, open_domain: bool = False) -> DataFrame:
    """Signed-rank test that the difference is below zero; zero differences drop out."""
    signed = df.where(diff.isNotNull() & (diff != 0)).groupBy(
        *group, F.abs(diff).alias("v"), (diff > 0).alias("up")).agg(F.count("*").alias("n"))
    ranked = O.tied_places(signed, group, "v", "place", "peers", open_domain)
    sums = ranked.groupBy(*group).agg(
        F.sum(F.when(F.col("up"), F.col("n") * F.col("place")).otherwise(0.0)).alias("w_plus"),
        F.sum(O.tie_term(F.col("n"), F.col("peers"))).alias("ties"), F.sum("n").alias("m")).withColumnRenamed("m", "n")
    n, w = F.col("n").cast("double"), F.col("w_plus")
    z = F.try_divide(w - n * (n + 1) / 4, F.sqrt(n * (n + 1) * (2 * n + 1) / 24 - F.col("ties") / 48))
    return sums.select(*group, "n", "w_plus", tails.normal_tail(-z).alias("p"))


def paired_t_less(df: DataFrame, group: list[str], diff: Column) -> DataFrame:
    out = df.groupBy(*group).agg(F.count(diff).alias("n"), F.avg(diff).alias("mean"), F.stddev_samp(diff).alias("sd"))
    t = F.try_divide(F.col("mean"), F.col("sd") / F.sqrt("n"))
    return out.withColumn("t", t).select(*group, "n", "t", tails.t_tail(-F.col("t"), F.col("n") - 1).alias("p"))


# Multiple comparisons: over the short result table of a test.

def bonferroni(df: DataFrame, family: list[str], p: str = "p", out: str = "p_bonf") -> DataFrame:
    m = F.count("*").over(Window.partitionBy(*family))
    return df.withColumn(out, F.least(F.col(p) * m, F.lit(1.0)))


def holm(df: DataFrame, family: list[str], p: str = "p", out: str = "p_holm") -> DataFrame:
    """Step-down adjusted p: running maximum of (m - i + 1) p in order of p."""
    whole = Window.partitionBy(*family)
    ordered = whole.orderBy(F.col(p), "source")
    staged = df.withColumns({"_m": F.count("*").over(whole), "_i": F.row_number().over(ordered)})
    scaled = (F.col("_m") - F.col("_i") + 1) * F.col(p)
    upto = ordered.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return staged.withColumn(out, F.least(F.lit(1.0), F.max(scaled).over(upto))).drop("_m", "_i")
