"""Error metrics and distribution distances of sources against the baseline."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from paneloom.operators import ordering as O

METRICS = ["mae", "wasserstein", "spread"]


def error_metrics(cases: DataFrame, group: list[str], weight: Column | None = None) -> DataFrame:
    """Mean absolute error and bias (baseline minus source) under case weights."""
    w = F.lit(1) if weight is None else weight
    err = F.col("h") - F.col("y")
    return cases.groupBy(*group).agg(
        F.sum(w).alias("weight"), (F.sum(w * F.abs(err)) / F.sum(w)).alias("mae"),
        (F.sum(w * err) / F.sum(w)).alias("bias"))


def value_weights(cases: DataFrame, group: list[str], weight: Column | None = None) -> DataFrame:
    """Weight of each value on both sides: (group, v, wh, wy); a few rows per group."""
    w = (F.lit(1) if weight is None else weight).cast("double")
    # Count joint values first: the doubling then acts on counts, not on cases.
    joint = cases.groupBy(*group, "h", "y").agg(F.sum(w).alias("_w"))
    sides = F.array(
        F.struct(F.col("h").cast("double").alias("v"), F.col("_w").alias("wh"), F.lit(0.0).alias("wy")),
        F.struct(F.col("y").cast("double").alias("v"), F.lit(0.0).alias("wh"), F.col("_w").alias("wy")))
    return (joint.select(*group, F.explode(sides).alias("s")).groupBy(*group, F.col("s.v").alias("v"))
            .agg(F.sum("s.wh").alias("wh"), F.sum("s.wy").alias("wy")))


def wasserstein(weights: DataFrame, group: list[str], open_domain: bool = False) -> DataFrame:
    """Area between the two cumulative distributions over the pooled support.

    Runs on value weights. With a closed domain a window partition holds the distinct values of a group. With an open
    one the values are dealt by ranges: a range starts from the weights of the group's earlier ranges, and its last
    value meets the first of the next range, so the gap across a cut is counted once.
    """
    if open_domain:
        return _ranged_wasserstein(weights, group)
    by_value = Window.partitionBy(*group).orderBy("v")
    upto = by_value.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = Window.partitionBy(*group)
    gap = F.lead("v").over(by_value) - F.col("v")
    fh = F.sum("wh").over(upto) / F.sum("wh").over(whole)
    fy = F.sum("wy").over(upto) / F.sum("wy").over(whole)
    return (weights.withColumn("area", F.abs(fh - fy) * gap).groupBy(*group)
            .agg(F.coalesce(F.sum("area"), F.lit(0.0)).alias("wasserstein")))


def _ranged_wasserstein(weights: DataFrame, group: list[str]) -> DataFrame:
    dealt = O.ranged(weights, group)
    # One row per group and range: what lies before it, the group's totals, and where the next range begins.
    by_part, whole = Window.partitionBy(*group).orderBy("_part"), Window.partitionBy(*group)
    earlier = by_part.rowsBetween(Window.unboundedPreceding, -1)
    ends = dealt.groupBy(*group, "_part").agg(F.min("v").alias("_first"), F.sum("wh").alias("_ph"), F.sum("wy").alias("_py"))
    bounds = ends.select(
        *group, "_part", F.lead("_first").over(by_part).alias("_next"),
        *[F.coalesce(F.sum(c).over(earlier), F.lit(0.0)).alias(f"{c}_before") for c in ("_ph", "_py")],
        *[F.sum(c).over(whole).alias(f"{c}_all") for c in ("_ph", "_py")])
    inside = Window.partitionBy(*group, "_part").orderBy("v")
    upto = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = dealt.withColumns({
        "_ch": F.sum("wh").over(upto), "_cy": F.sum("wy").over(upto), "_lead": F.lead("v").over(inside)}).join(bounds, [*group, "_part"])
    fh = (F.col("_ph_before") + F.col("_ch")) / F.col("_ph_all")
    fy = (F.col("_py_before") + F.col("_cy")) / F.col("_py_all")
    area = F.abs(fh - fy) * (F.coalesce("_lead", "_next") - F.col("v"))
    return placed.groupBy(*group).agg(F.coalesce(F.sum(area), F.lit(0.0)).alias("wasserstein"))


def _sd_pop(s1: Column, s2: Column, w: Column) -> Column:
    return F.sqrt(F.greatest(F.lit(0.0), s2 / w - (s1 / w) * (s1 / w)))


def log_sd_ratio(sd_source: Column, sd_base: Column) -> Column:
    """|log(sd_source / sd_base)|; infinite when one of them is 0, null when both are."""
    return (F.when((sd_source == 0) & (sd_base == 0), None)
            .when((sd_source == 0) | (sd_base == 0), F.lit(float("inf")))
            .otherwise(F.abs(F.log(sd_source / sd_base))))


def spread(cases: DataFrame, group: list[str], weight: Column | None = None) -> DataFrame:
    """Absolute log ratio of the population SDs of absolute change."""
    w = F.lit(1) if weight is None else weight
    ay, ah = F.abs(F.col("y") - F.col("init")), F.abs(F.col("h") - F.col("init"))
    sums = cases.groupBy(*group).agg(
        F.sum(w).alias("w"), F.sum(w * ay).alias("y1"), F.sum(w * ay * ay).alias("y2"),
        F.sum(w * ah).alias("h1"), F.sum(w * ah * ah).alias("h2"))
    return sums.select(*group, log_sd_ratio(
        _sd_pop(F.col("y1"), F.col("y2"), F.col("w")), _sd_pop(F.col("h1"), F.col("h2"), F.col("w"))).alias("spread"))


def paired_effect(diff: Column) -> list[Column]:
    """n, mean difference, its SD and the paired effect size; null pairs drop out."""
    return [F.count(diff).alias("n"), F.avg(diff).alias("mean_diff"), F.stddev_samp(diff).alias("sd_diff"),
            F.try_divide(F.avg(diff), F.stddev_samp(diff)).alias("d_z")]


def all_metrics(cases: DataFrame, group: list[str], weight: Column | None = None) -> DataFrame:
    """Every metric for every group, from one joint count table of (h, y, init).

    The cases are counted once; what follows runs on at most 5 x 9 x 5 rows per group.
    """
    w = (F.lit(1) if weight is None else weight)
    counts = cases.groupBy(*group, "h", "y", "init").agg(F.sum(w).alias("w"))
    err = error_metrics(counts, group, F.col("w"))
    return (err.join(wasserstein(value_weights(counts, group, F.col("w")), group), group)
            .join(spread(counts, group, F.col("w")), group))
