"""Ranks and order statistics from value counts.

Equal values are counted before anything is ordered, so a group costs its
number of distinct values. Likert data has a handful. For measures with an
open domain the distinct values are dealt by ranges of (group, value), whatever
their distribution, so no group is ordered by one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from paneloom.session import cut_lineage


def value_counts(df: DataFrame, group: list[str], value: Column) -> DataFrame:
    return (df.where(value.isNotNull()).groupBy(*group, value.alias("v"))
            .agg(F.count("*").alias("n")))


def _before(*keys: str, order: str):
    return Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)


def _total_before(n: str, window) -> Column:
    return F.coalesce(F.sum(n).over(window), F.lit(0))


def ranged(counts: DataFrame, group: list[str]) -> DataFrame:
    """Counted values dealt by ranges of (group, v), with the number of their part as `_part`.

    Ranges are cut at sampled quantiles, so outliers and heavy tails make no part larger than another. The part of a
    value must not change when a task is run again, so it is written down.
    """
    parts = int(counts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return cut_lineage(counts.repartitionByRange(parts, *group, "v").withColumn("_part", F.spark_partition_id()))


def counts_below(counts: DataFrame, group: list[str], open_domain: bool) -> DataFrame:
    """Adds `below`: rows of the group with a smaller value.

    Open domain: a value has below it what its range holds before it and what the
    group's earlier ranges hold; the latter comes from one row per group and range.
    """
    if not open_domain:
        return counts.withColumn("below", _total_before("n", _before(*group, order="v")))
    dealt = ranged(counts, group)
    totals = dealt.groupBy(*group, "_part").agg(F.sum("n").alias("_held"))
    earlier = totals.withColumn("_earlier", _total_before("_held", _before(*group, order="_part"))).drop("_held")
    inner = _total_before("n", _before(*group, "_part", order="v"))
    return dealt.withColumn("_inner", inner).join(earlier, [*group, "_part"]).withColumn(
        "below", F.col("_earlier") + F.col("_inner")).select(*group, "v", "n", "below")


def average_ranks(df: DataFrame, group: list[str], value: Column, open_domain: bool = False) -> DataFrame:
    """(group, v, n, below, avg_rank): ties share the mean of their places."""
    ranked = counts_below(value_counts(df, group, value), group, open_domain)
    return ranked.withColumn("avg_rank", F.col("below") + (F.col("n") + 1) / 2)


def tied_places(counts: DataFrame, group: list[str], value: str, place: str, peers: str,
                open_domain: bool = False) -> DataFrame:
    """Adds the average rank of each counted row within its group, and the size of its tie.

    With a closed domain this is two windows over one hash partitioning by group.
    """
    if open_domain:
        pooled = counts.groupBy(*group, F.col(value).alias("v")).agg(F.sum("n").alias("n"))
        ranked = counts_below(pooled, group, open_domain=True).select(
            *group, F.col("v").alias(value), F.col("n").alias(peers),
            (F.col("below") + (F.col("n") + 1) / 2).alias(place))
        return counts.join(ranked, [*group, value])
    upto = Window.partitionBy(*group).orderBy(value).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    staged = counts.withColumns({
        "_upto": F.sum("n").over(upto), peers: F.sum("n").over(Window.partitionBy(*group, value))})
    return staged.withColumn(place, F.col("_upto") - F.col(peers) + (F.col(peers) + 1) / 2).drop("_upto")


def with_median(counts: DataFrame, group: list[str], name: str, open_domain: bool = False) -> DataFrame:
    """Adds the group's median to its counted values.

    Closed domain: windows over one hash partitioning by group. Open domain: the
    median is read off ranges of values, and one row per group goes back to them.
    """
    if open_domain:
        pooled = counts.groupBy(*group, "v").agg(F.sum("n").alias("n"))
        return counts.join(quantile_at(counts_below(pooled, group, True), group, 0.5, name), group)
    whole = Window.partitionBy(*group)
    staged = counts.withColumns({
        "_below": _total_before("n", _before(*group, order="v")), "_N": F.sum("n").over(whole)})
    place = (F.col("_N") - 1) / 2

    def at(p):
        hit = (F.col("_below") <= p) & (p < F.col("_below") + F.col("n"))
        return F.max(F.when(hit, F.col("v"))).over(whole)

    return staged.withColumn(name, (at(F.floor(place)) + at(F.ceil(place))) / 2).drop("_below", "_N")


def quantile_at(ranked: DataFrame, group: list[str], q: float, name: str) -> DataFrame:
    """Linear-interpolation quantile from counts with `below`; two conditional extremes per group."""
    total = ranked.groupBy(*group).agg(F.sum("n").alias("_N"))
    place = (F.col("_N") - 1) * q
    low, high = F.floor(place), F.ceil(place)

    def holds(p):
        return (F.col("below") <= p) & (p < F.col("below") + F.col("n"))

    both = ranked.join(total, group).groupBy(*group, "_N").agg(
        F.max(F.when(holds(low), F.col("v"))).alias("_a"), F.max(F.when(holds(high), F.col("v"))).alias("_b"))
    return both.select(*group, (F.col("_a") + (F.col("_b") - F.col("_a")) * (place - low)).alias(name))


def tie_term(n: Column, peers: Column) -> Column:
    """A counted row's part of the sum of t^3 - t over ties."""
    return n.cast("double") * (peers.cast("double") * peers - 1)


def leave_one_out_median(df: DataFrame, cell: list[str], value: str, levels: list[int]) -> DataFrame:
    """(cell, value, loo): median of the other values of the cell, one row per cell and value.

    Removing one case of a level leaves the same remainder whichever case it was,
    so the median depends on (cell, value) only. It is read off the cell's level
    counts; the rows are joined to this short table by the caller.
    """
    counts = df.groupBy(*cell).agg(
        F.array(*[F.sum(F.when(F.col(value) == v, 1).otherwise(0)) for v in levels]).alias("c"),
        F.count(value).alias("m"))
    per_value = counts.withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(len(levels) - 1)))).where(
        F.element_at("c", F.col("j") + 1) > 0)
    without = F.transform("c", lambda n, i: n - F.when(i == F.col("j"), 1).otherwise(0))
    running = F.transform(
        F.sequence(F.lit(1), F.lit(len(levels))),
        lambda k: F.aggregate(F.slice("rest", 1, k), F.lit(0).cast("long"), lambda a, x: a + x))
    level_array = F.array(*[F.lit(v) for v in levels])

    def at(position):  # 1-based order statistic of the remainder
        index = F.size(F.filter("running", lambda r: r < position))
        return F.element_at(level_array, index + 1)

    others = F.col("m") - 1
    middle = (at(F.floor((others + 1) / 2)) + at(F.floor((others + 2) / 2))) / 2
    alone = F.raise_error(F.lit("a cell holds a single case; no leave-one-out median is defined")).cast("double")
    return (per_value.withColumn("rest", without).withColumn("running", running)
            .select(*cell, F.element_at(level_array, F.col("j") + 1).alias(value),
                    F.when(others > 0, middle).otherwise(alone).alias("loo")))
