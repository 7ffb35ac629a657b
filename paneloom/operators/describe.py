"""Descriptive aggregates over the panel: histograms, moments, agreement, consistency."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from paneloom.schema import DELTAS, LIKERT


def level_counts(value: Column, levels: list[int], prefix: str = "n_") -> list[Column]:
    """One zero-filled count per level, in a single aggregation."""
    def name(v):
        return f"{prefix}{'m' if v < 0 else 'p' if v > 0 else ''}{abs(v)}"

    return [F.sum(F.when(value == v, 1).otherwise(0)).alias(name(v)) for v in levels]


def histogram(df: DataFrame, group: list[str], value: Column, levels: list[int]) -> DataFrame:
    """Long zero-filled histogram with shares; levels without rows stay.

    Counts are taken wide, one row per group, and only the short result is exploded.
    """
    counts = df.where(value.isNotNull()).groupBy(*group).agg(
        F.array(*[F.sum(F.when(value == v, 1).otherwise(0)) for v in levels]).alias("c"))
    total = F.aggregate("c", F.lit(0).cast("long"), lambda a, x: a + x)
    rows = F.arrays_zip(F.array(*[F.lit(v) for v in levels]).alias("level"), F.col("c").alias("n"))
    out = counts.withColumn("total", total).withColumn("z", F.explode(rows))
    return out.select(*group, F.col("z.level").alias("level"), F.col("z.n").alias("n"),
                      F.when(F.col("total") > 0, F.col("z.n") / F.col("total")).otherwise(0.0).alias("share"))


def likert_histogram(df: DataFrame, group: list[str], value: str) -> DataFrame:
    return histogram(df, group, F.col(value), LIKERT)


def delta_histogram(df: DataFrame, group: list[str], value: Column) -> DataFrame:
    return histogram(df, group, value, DELTAS)


def over_groupings(df: DataFrame, sets: list[list[str]], aggregates: list[Column]) -> DataFrame:
    """Aggregates over several groupings in one job (GROUPING SETS); absent keys are 'all'."""
    keys = list(dict.fromkeys(k for s in sets for k in s))
    out = df.groupingSets([[F.col(k) for k in s] for s in sets], *[F.col(k) for k in keys]).agg(
        *aggregates, *[F.grouping(k).alias(f"_g_{k}") for k in keys])
    for k in keys:
        out = out.withColumn(k, F.when(F.col(f"_g_{k}") == 1, "all").otherwise(F.col(k).cast("string")))
    return out.drop(*[f"_g_{k}" for k in keys])


def moments(value: Column) -> list[Column]:
    return [F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"), F.count(value).alias("n")]


def icc_one_way(df: DataFrame, group: list[str], subject: str, value: Column, k: int = 3) -> DataFrame:
    """One-way random-effects ICC(1,1) with a fixed number of ratings per subject.

    Two aggregations: per subject sums, then sums over subjects.
    """
    per = df.groupBy(*group, subject).agg(
        F.count(value).alias("m"), F.sum(value).alias("s"), F.sum(value * value).alias("q"))
    tot = per.groupBy(*group).agg(
        F.count("*").alias("n"), F.sum("m").alias("m"), F.sum("s").alias("s"), F.sum("q").alias("q"),
        F.sum(F.try_divide(F.col("s") * F.col("s"), F.col("m"))).alias("sq"))
    between = F.col("sq") - F.col("s") * F.col("s") / F.col("m")
    within = F.col("q") - F.col("sq")
    ms_b, ms_w = F.try_divide(between, F.col("n") - 1), within / (F.col("n") * (k - 1))
    return tot.select(*group, F.col("n").alias("n_subjects"), F.col("m").alias("n_obs"),
                      F.try_divide(ms_b - ms_w, ms_b + (k - 1) * ms_w).alias("icc"))


def within_subject_sd(df: DataFrame, group: list[str], subject: str, value: Column) -> DataFrame:
    per = df.groupBy(*group, subject).agg(F.stddev_samp(value).alias("sd_within"))
    return per.where(F.col("sd_within").isNotNull() & ~F.isnan("sd_within"))


def between_subject_sd(df: DataFrame, group: list[str], subject: str, value: Column) -> DataFrame:
    per = df.groupBy(*group, subject).agg(F.avg(value).alias("m"))
    return per.groupBy(*group).agg(F.stddev_samp("m").alias("sd_between"), F.count("*").alias("n_subjects"))


def agreement(h: Column, y: Column) -> Column:
    return F.avg((h == y).cast("int"))


def difference_summary(diff: Column) -> list[Column]:
    return [F.count(diff).alias("n"), (100 * F.avg((diff == 0).cast("int"))).alias("pct_unchanged"),
            F.avg(F.abs(diff)).alias("mean_abs_diff"), F.stddev_samp(diff).alias("sd_diff")]


def frequency(df: DataFrame, columns: list[str]) -> DataFrame:
    """Count and percent per category for several columns at once.

    Categories are counted first; the total comes from the short counted table.
    """
    long = df.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("variable"), F.col(c).cast("string").alias("category")) for c in columns
    ])).alias("v")).select("v.*").where(F.col("category").isNotNull())
    counts = long.groupBy("variable", "category").agg(F.count("*").alias("n"))
    totals = counts.withColumn("total", F.sum("n").over(Window.partitionBy("variable")))
    return totals.select(
        "variable", "category", "n", F.round(100 * F.col("n") / F.col("total"), 2).alias("percent"))


def quartiles(df: DataFrame, group: list[str], value: Column) -> DataFrame:
    """Linear-interpolation quartiles from value counts.

    Equal values are counted before the percentile, so the state per group is the
    number of distinct values, not of rows.
    """
    counts = df.where(value.isNotNull()).groupBy(*group, value.alias("_v")).agg(F.count("*").alias("_n"))
    return counts.groupBy(*group).agg(
        F.percentile("_v", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)), F.col("_n")).alias("q")
    ).select(*group, F.col("q")[0].alias("q1"), F.col("q")[1].alias("median"), F.col("q")[2].alias("q3"))


def tukey_box(df: DataFrame, group: list[str], value: Column) -> DataFrame:
    """Quartiles and whiskers: the extreme data within 1.5 IQR of the box."""
    counts = df.where(value.isNotNull()).groupBy(*group, value.alias("v")).agg(F.count("*").alias("n"))
    box = quartiles(df, group, value)
    iqr = F.col("q3") - F.col("q1")
    joined = counts.join(box, group)
    return joined.groupBy(*group, "q1", "median", "q3").agg(
        F.min(F.when(F.col("v") >= F.col("q1") - 1.5 * iqr, F.col("v"))).alias("whisker_low"),
        F.max(F.when(F.col("v") <= F.col("q3") + 1.5 * iqr, F.col("v"))).alias("whisker_high"))


def mean_ranks(df: DataFrame, group: list[str], pairs: Column, weight: Column | None = None) -> DataFrame:
    """Mean rank per message from an array of (message, rank) on each row, which stands for `weight` rows; ranks are whole numbers."""
    w = F.lit(1) if weight is None else weight
    rank = F.col("p.rank")
    return (df.select(*group, w.cast("long").alias("_w"), F.explode(pairs).alias("p"))
            .groupBy(*group, F.col("p.message").alias("message"))
            .agg(F.try_divide(F.sum(F.col("_w") * rank), F.sum(F.when(rank.isNotNull(), F.col("_w")))).alias("mean_rank"),
                 F.sum("_w").alias("n")))


def extremes(df: DataFrame, group: list[str], value: str, label: Column) -> DataFrame:
    """Labels of the smallest and largest value; ties go to the smaller label."""
    low = F.min(F.struct(F.col(value).alias("v"), label.alias("l")))
    high = F.min(F.struct((-F.col(value)).alias("v"), label.alias("l")))
    return df.groupBy(*group).agg(low.alias("a"), high.alias("b")).select(
        *group, F.col("a.l").alias("lowest"), F.col("a.v").alias("lowest_value"),
        F.col("b.l").alias("highest"), (-F.col("b.v")).alias("highest_value"))
