"""The combined report: every analysis over every design cell, as one long summary table.

Each analysis reduces the panel to counts or sums per cell once. Coarser
groupings (item, whole design) are added up from those short tables.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window

from paneloom import schema as S
from paneloom.functions import ranks as R
from paneloom.operators import describe as D
from paneloom.operators import hypothesis as H
from paneloom.operators import ordering as O
from paneloom.operators import power as W
from paneloom.operators import resample as B

CELL = ["item", "cell"]
GROUPINGS = [[], ["item"], ["item", "cell"]]
ALPHA_MODELS = 0.05 / 6
MIN_EXPECTED = 5


def _long(df: DataFrame, test: str, statistics: list[str]) -> DataFrame:
    return df.unpivot(
        [*CELL, "source"], [F.col(s).cast("double").alias(s) for s in statistics], "statistic", "value"
    ).withColumn("test", F.lit(test))


def _grids(*tail: str) -> list[list[str]]:
    return [[*g, *tail] for g in GROUPINGS]


def stance_counts(responses: DataFrame) -> DataFrame:
    """Level counts of the final belief per cell and source, added up to every grouping."""
    cells = responses.groupBy(*CELL, "source").agg(*D.level_counts(F.col("y"), S.LIKERT))
    names = [c for c in cells.columns if c.startswith("n_")]
    return D.over_groupings(cells, _grids("source"), [F.sum(c).alias(c) for c in names])


def stance_test(responses: DataFrame, baseline: str, strict: bool = True) -> DataFrame:
    counts = stance_counts(responses)
    names = [c for c in counts.columns if c.startswith("n_")]
    pairs = H.versus_baseline(counts, CELL, baseline)
    return H.chi_square(pairs, [f"{c}_b" for c in names], names, strict)


def change_test(panel: DataFrame, baseline: str) -> DataFrame:
    change = F.abs(F.col("y") - F.col("init"))
    cells = O.value_counts(panel, [*CELL, "source"], change)
    counts = D.over_groupings(cells, _grids("source", "v"), [F.sum("n").alias("n")]).withColumn(
        "v", F.col("v").cast("int"))
    out = H.brown_forsythe_counts(counts, CELL, baseline)
    return out.withColumn("variance_ratio", F.pow(F.try_divide(F.col("sd_base"), F.col("sd")), 2))


def paired_diffs(sources: list[str]):
    """(label, d) of every source that answered, on a wide row."""
    return F.filter(F.array(*[
        F.struct(F.lit(s).alias("label"), (F.col("h") - F.col(s)).alias("d")) for s in sources
    ]), lambda x: x["d"].isNotNull())


def difference_test(wide: DataFrame, sources: list[str], n_rep: int, seed: int) -> DataFrame:
    """Paired difference, effect size and sign-flip p of every source in every grouping."""
    return B.counted_sign_flip(wide, CELL, paired_diffs(sources), _grids(), n_rep, seed).withColumnRenamed("label", "source")


def tau_test(matched: DataFrame) -> DataFrame:
    """Mean tau per source from counts of its four possible values; a row of `matched` stands for `n` pairs of ranks hb and mc."""
    tau = R.kendall_tau(F.col("hb"), F.col("mc"))
    cells = matched.groupBy(*CELL, "source", F.round(3 * tau).cast("int").alias("k")).agg(F.sum("n").alias("n"))
    rolled = D.over_groupings(cells, _grids("source"), [
        F.sum("n").alias("n"), F.sum(F.col("n") * F.col("k")).alias("s1"),
        F.sum(F.col("n") * F.col("k") * F.col("k")).alias("s2")])
    sd = F.sqrt(F.try_divide(F.col("s2") - F.col("s1") * F.col("s1") / F.col("n"), F.col("n") - 1)) / 3
    return rolled.select(*CELL, "source", "n", (F.col("s1") / F.col("n") / 3).alias("mean"), sd.alias("sd"))


def message_test(mean_ranks: DataFrame, n_sources: int, baseline: str) -> DataFrame:
    """Spread of message mean ranks; only messages every source ranked count."""
    by = Window.partitionBy(*CELL, "message")
    shared = mean_ranks.withColumn("_m", F.count("*").over(by)).where(F.col("_m") == n_sources)
    everywhere = F.array(
        F.struct(F.lit("all").alias("item"), F.lit("all").alias("cell")),
        F.struct(F.col("item"), F.lit("all").alias("cell")), F.struct(F.col("item"), F.col("cell")))
    rows = shared.select("source", "mean_rank", F.explode(everywhere).alias("g")).select("g.*", "source", "mean_rank")
    out = H.brown_forsythe(rows, CELL, F.col("mean_rank"), baseline)
    return out.withColumn("variance_ratio", F.pow(F.try_divide(F.col("sd"), F.col("sd_base")), 2))


def effect_report(panel: DataFrame, responses: DataFrame, wide: DataFrame, matched: DataFrame,
                  mean_ranks: DataFrame, counts: DataFrame, sources: list[str], baseline: str,
                  n_rep: int, seed: int = 42) -> DataFrame:
    """(item, cell, source, test, statistic, value) of all six analyses; 'all' marks a whole dimension."""
    parts = [
        _long(difference_test(wide, sources, n_rep, seed), "difference", ["n", "mean_diff", "sd_diff", "d_z", "p"]),
        _long(stance_test(responses, baseline), "stance", ["chi2", "cramers_v", "min_expected", "p"]),
        _long(change_test(panel, baseline), "change", ["sd_base", "sd", "variance_ratio", "w", "p"]),
        _long(message_test(mean_ranks, len(sources) + 1, baseline), "message",
              ["n", "sd_base", "sd", "variance_ratio", "w", "p"]),
        _long(tau_test(matched), "tau", ["n", "mean", "sd"]),
        _long(W.detectable(counts).withColumn("source", F.lit("design")), "detectable",
              ["n_obs", "n_subjects", "dz_nominal", "dz_independent", "v_nominal", "v_independent",
               "tau_nominal", "tau_independent"]),
    ]
    return reduce(DataFrame.unionByName, parts)


def overview(summary: DataFrame, n_groups: int) -> DataFrame:
    """Source overview with two significance families: within a grouping, and over all groupings."""
    tests = summary.where(F.col("statistic").isin("p", "mean_diff", "d_z", "cramers_v", "variance_ratio", "mean"))
    name = F.concat_ws("_", "test", "statistic")
    wide = tests.withColumn("_name", name).groupBy(*CELL, "source").pivot("_name", [
        "difference_mean_diff", "difference_d_z", "difference_p", "stance_cramers_v", "stance_p",
        "change_variance_ratio", "change_p", "message_variance_ratio", "message_p", "tau_mean"]).agg(F.max("value"))

    def marks(p):
        return F.when(F.col(p) < ALPHA_MODELS / n_groups, "**").when(F.col(p) < ALPHA_MODELS, "*").otherwise("")

    return wide.where(F.col("source") != "design").withColumns({
        p.replace("_p", "_mark"): marks(p) for p in ("difference_p", "stance_p", "change_p", "message_p")})


def caveats(summary: DataFrame, full_messages: int) -> DataFrame:
    """Flags per cell: small expected counts, effect below detectable, fewer messages than the design."""
    def pick(test, statistic, fn):
        return fn(F.when((F.col("test") == test) & (F.col("statistic") == statistic), F.col("value")))

    out = summary.groupBy(*CELL).agg(
        pick("stance", "min_expected", F.min).alias("worst_expected"),
        pick("detectable", "dz_nominal", F.max).alias("detectable_d_z"),
        F.max(F.when((F.col("test") == "difference") & (F.col("statistic") == "d_z"), F.abs("value"))).alias("largest_d_z"),
        pick("message", "n", F.min).alias("n_messages"))
    return out.select(
        *CELL, (F.col("worst_expected") < MIN_EXPECTED).alias("small_expected"),
        (F.col("largest_d_z") < F.col("detectable_d_z")).alias("all_below_detectable"),
        (F.col("n_messages") < full_messages).alias("few_messages"))
