"""Queries for descriptive aggregates, metrics, windows, sorts and reshapes."""

from __future__ import annotations

from itertools import product

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from paneloom import schema as S
from paneloom.functions import scalars as N
from paneloom.operators import describe as D
from paneloom.operators import distance as M
from paneloom.operators import ordering as O
from paneloom.operators import pairing as P
from paneloom.plans import tables as V
from paneloom.plans.queries_scalar import MESSAGES, counted_pairs
from paneloom.plans.registry import query, r6, sq6
from paneloom.session import materialise

_C = F.col


def _delta():
    return _C("y") - _C("init")


_LEVELS = "(SELECT unnest([-2, -1, 0, 1, 2]) AS level)"
_DELTAS = "(SELECT unnest(range(-4, 5)) AS level)"


@query("agg1_likert_histogram", f"""WITH {V.RESP}
SELECT source, CAST(level AS INT) AS level, count(y) AS n, count(y) / CAST(sum(count(y)) OVER (PARTITION BY source) AS DOUBLE) AS share
FROM (SELECT DISTINCT source FROM resp) CROSS JOIN {_LEVELS} LEFT JOIN resp USING (source)
WHERE y = level OR y IS NULL GROUP BY source, level""")
def agg1(spark, sf_dir):
    return D.likert_histogram(V.responses(spark, sf_dir), ["source"], "y")


# Level counts per item and source, zero-filled.
_HIST = f"""{V.RESP}, g AS (SELECT DISTINCT item, source FROM resp),
hist AS (SELECT g.item, g.source, CAST(level AS INT) AS level, count(r.y) AS n FROM g CROSS JOIN {_LEVELS}
  LEFT JOIN resp r ON r.item = g.item AND r.source = g.source AND r.y = level GROUP BY 1, 2, 3)"""


@query("agg2_baseline_source_table", f"""WITH {_HIST}, t AS (SELECT source, level, sum(n) AS n FROM hist GROUP BY 1, 2)
SELECT level, {', '.join(f"CAST(max(CASE WHEN source = '{s}' THEN n END) AS BIGINT) AS {s}" for s in V.SOURCES)} FROM t GROUP BY level""")
def agg2(spark, sf_dir):
    hist = D.likert_histogram(V.responses(spark, sf_dir), ["source"], "y")
    return hist.groupBy("level").pivot("source", V.SOURCES).agg(F.max("n"))


@query("agg3_distribution_by_item_source", f"WITH {_HIST} SELECT item, source, level, n FROM hist")
def agg3(spark, sf_dir):
    return D.likert_histogram(V.responses(spark, sf_dir), ["item", "source"], "y").drop("share")


@query("agg4_change_histogram", f"""WITH {V.PANEL}, g AS (SELECT DISTINCT item, source FROM panel),
h AS (SELECT g.item, g.source, CAST(level AS INT) AS level, count(p.y) AS n FROM g CROSS JOIN {_DELTAS}
  LEFT JOIN panel p ON p.item = g.item AND p.source = g.source AND p.y - p.init = level GROUP BY 1, 2, 3)
SELECT *, {sq6('n / CAST(sum(n) OVER (PARTITION BY item, source) AS DOUBLE)')} AS share FROM h""")
def agg4(spark, sf_dir):
    return D.delta_histogram(V.panel(spark, sf_dir), ["item", "source"], _delta()).withColumn("share", r6(_C("share")))


@query("agg5_change_proportions", f"""WITH {V.PANEL}, h AS (SELECT s.source, CAST(level AS INT) AS level, count(p.y) AS n
  FROM (SELECT DISTINCT source FROM panel) s CROSS JOIN {_DELTAS} LEFT JOIN panel p ON p.source = s.source AND p.y - p.init = level GROUP BY 1, 2)
SELECT source, level, {sq6('n / CAST(sum(n) OVER (PARTITION BY source) AS DOUBLE)')} AS share FROM h""")
def agg5(spark, sf_dir):
    return D.delta_histogram(V.panel(spark, sf_dir), ["source"], _delta()).select("source", "level", r6(_C("share")).alias("share"))


_SETS = "GROUPING SETS ((source), (item, source))"


@query("agg6_abs_change_moments", f"""WITH {V.PANEL}
SELECT coalesce(item, 'all') AS item, source, {sq6('avg(abs(y - init))')} AS mean, {sq6('stddev_samp(abs(y - init))')} AS sd, count(y) AS n
FROM panel GROUP BY {_SETS}""")
def agg6(spark, sf_dir):
    out = D.over_groupings(V.panel(spark, sf_dir), [["source"], ["item", "source"]], D.moments(F.abs(_delta())))
    return out.select("item", "source", r6(_C("mean")).alias("mean"), r6(_C("sd")).alias("sd"), "n")


@query("agg7_mean_sd_range", f"""WITH {V.PANEL}, m AS (SELECT source, avg(abs(y - init)) AS mean, stddev_samp(abs(y - init)) AS sd FROM panel GROUP BY source)
SELECT source, {sq6('mean')} AS mean, {sq6('mean - sd')} AS range_low, {sq6('mean + sd')} AS range_high FROM m""")
def agg7(spark, sf_dir):
    m = V.panel(spark, sf_dir).groupBy("source").agg(*D.moments(F.abs(_delta())))
    return m.select("source", r6(_C("mean")).alias("mean"), r6(_C("mean") - _C("sd")).alias("range_low"),
                    r6(_C("mean") + _C("sd")).alias("range_high"))


@query("agg8_percentiles", f"""WITH {V.PANEL}
SELECT item, source, quantile_cont(abs(y - init), 0.25) AS q1, quantile_cont(abs(y - init), 0.5) AS median,
  quantile_cont(abs(y - init), 0.75) AS q3 FROM panel GROUP BY item, source""")
def agg8(spark, sf_dir):
    return D.quartiles(V.panel(spark, sf_dir), ["item", "source"], F.abs(_delta()))


@query("agg8_percentiles_open_domain", f"""SELECT o_orderpriority AS priority, {sq6('quantile_cont(o_totalprice, 0.25)')} AS q1,
  {sq6('quantile_cont(o_totalprice, 0.5)')} AS median FROM orders GROUP BY 1""")
def agg8_open(spark, sf_dir):
    orders = V.table(spark, sf_dir, "orders").withColumnRenamed("o_orderpriority", "priority")
    counts = O.value_counts(orders, ["priority"], _C("o_totalprice"))
    ranked = O.counts_below(counts, ["priority"], open_domain=True)
    out = O.quantile_at(ranked, ["priority"], 0.25, "q1").join(
        O.quantile_at(ranked, ["priority"], 0.5, "median"), "priority")
    return out.select("priority", r6(_C("q1")).alias("q1"), r6(_C("median")).alias("median"))


def _by_init(df, group, aggregates):
    """Aggregates by initial level; the full level list is kept."""
    spark = df.sparkSession
    have = df.groupBy(*group, "init").agg(*aggregates)
    names = {"item": V.ITEMS, "source": V.SOURCES}
    frame = V.inline(spark, group, list(product(*[names[g] for g in group]))).withColumn(
        "init", F.explode(F.array(*[F.lit(v) for v in S.LIKERT])))
    return frame.join(have, [*group, "init"], "left")


_FRAME = f"(SELECT 'baseline' AS source UNION ALL SELECT 'model_' || k FROM (SELECT unnest(range(2, 8)) AS k)) f CROSS JOIN {_LEVELS}"


@query("agg9_mean_sd_by_initial_level", f"""WITH {V.PANEL}
SELECT i.item, f.source, CAST(level AS INT) AS init, {sq6('avg(y - init)')} AS mean, {sq6('stddev_samp(y - init)')} AS sd
FROM {_FRAME} CROSS JOIN (SELECT unnest(['A', 'N', 'R']) AS item) i LEFT JOIN panel p ON p.source = f.source AND p.init = level AND p.item = i.item GROUP BY 1, 2, 3""")
def agg9(spark, sf_dir):
    return _by_init(V.panel(spark, sf_dir), ["item", "source"], [r6(F.avg(_delta())).alias("mean"), r6(F.stddev_samp(_delta())).alias("sd")])


@query("agg10_mean_sem_by_initial_level", f"""WITH {V.PANEL}
SELECT f.source, CAST(level AS INT) AS init, {sq6('avg(y - init)')} AS mean, {sq6('stddev_samp(y - init) / sqrt(count(y))')} AS sem
FROM {_FRAME} LEFT JOIN panel p ON p.source = f.source AND p.init = level GROUP BY 1, 2""")
def agg10(spark, sf_dir):
    return _by_init(V.panel(spark, sf_dir), ["source"], [
        r6(F.avg(_delta())).alias("mean"), r6(F.stddev_samp(_delta()) / F.sqrt(F.count("y"))).alias("sem")])


_SQL_DEMO = """demo AS (SELECT c_custkey AS subject, c_mktsegment AS segment, CAST(c_custkey % 70 + 18 AS INT) AS age,
  CASE c_custkey % 3 WHEN 0 THEN 'Female' WHEN 1 THEN 'Male' ELSE 'Other' END AS gender, 'N' || c_nationkey AS country FROM customer)"""


def demographics(spark, sf_dir):
    k = _C("c_custkey")
    return V.table(spark, sf_dir, "customer").select(
        k.alias("subject"), _C("c_mktsegment").alias("segment"), (k % 70 + 18).cast("int").alias("age"),
        F.when(k % 3 == 0, "Female").when(k % 3 == 1, "Male").otherwise("Other").alias("gender"),
        F.concat(F.lit("N"), "c_nationkey").alias("country"))


@query("agg11_subgroup_means", f"""WITH {V.PANEL}, {_SQL_DEMO}
SELECT source, CASE WHEN age <= 35 THEN '(0,35]' WHEN age <= 55 THEN '(35,55]' ELSE '(55,100]' END AS age_bin, {sq6('avg(y - init)')} AS mean, count(y) AS n
FROM panel JOIN demo USING (subject) GROUP BY 1, 2""")
def agg11(spark, sf_dir):
    per = V.panel(spark, sf_dir).groupBy("subject", "source").agg(F.sum(_delta()).alias("s"), F.count("y").alias("m"))
    joined = per.join(demographics(spark, sf_dir), "subject")
    return joined.groupBy("source", N.bins_right(_C("age"), N.AGE_EDGES_RIGHT).alias("age_bin")).agg(
        r6(F.sum("s") / F.sum("m")).alias("mean"), F.sum("m").alias("n"))


@query("agg12_between_subject_sd", f"""WITH {V.PANEL}, m AS (SELECT item, source, subject, avg(y - init) AS m FROM panel GROUP BY 1, 2, 3)
SELECT item, source, {sq6('stddev_samp(m)')} AS sd_between, count(*) AS n_subjects FROM m GROUP BY 1, 2""")
def agg12(spark, sf_dir):
    return D.between_subject_sd(V.panel(spark, sf_dir), ["item", "source"], "subject", _delta()).withColumn(
        "sd_between", r6(_C("sd_between")))


@query("agg13_within_subject_sd", f"""WITH {V.PANEL}
SELECT source, subject, {sq6('stddev_samp(y - init)')} AS sd_within FROM panel GROUP BY 1, 2 HAVING count(y) > 1""")
def agg13(spark, sf_dir):
    return D.within_subject_sd(V.panel(spark, sf_dir), ["source"], "subject", _delta()).withColumn(
        "sd_within", r6(_C("sd_within")))


@query("agg14_icc_one_way", f"""WITH {V.PAIRED}, d AS (SELECT source, subject, CAST(y - init AS DOUBLE) AS d FROM paired),
m AS (SELECT source, subject, avg(d) AS gm, count(*) AS m FROM d GROUP BY 1, 2),
g AS (SELECT source, avg(d) AS grand, count(*) AS n_obs FROM d GROUP BY 1),
b AS (SELECT source, count(*) AS n, sum((gm - grand) * (gm - grand) * m) AS ssb FROM m JOIN g USING (source) GROUP BY 1),
w AS (SELECT source, sum((d - gm) * (d - gm)) AS ssw FROM d JOIN m USING (source, subject) GROUP BY 1)
SELECT source, n AS n_subjects, n_obs, {sq6('(ssb / (n - 1) - ssw / (n * 2)) / (ssb / (n - 1) + 2 * ssw / (n * 2))')} AS icc
FROM b JOIN w USING (source) JOIN g USING (source)""")
def agg14(spark, sf_dir):
    return D.icc_one_way(V.paired(spark, sf_dir), ["source"], "subject", _delta()).withColumn("icc", r6(_C("icc")))


_MEAN_RANKS = f"""{MESSAGES},
mr AS (SELECT item, cell, source, message, avg(rank) AS mean_rank, count(*) AS n FROM messages GROUP BY 1, 2, 3, 4)"""


def mean_rank_table(spark, sf_dir, lines=None):
    group = ["item", "cell", "source"]
    answers = V.responses(spark, sf_dir, lines, [*group, "src", "r1", "r2", "r3", "order_seen"])
    return D.mean_ranks(counted_pairs(answers, group), group, _C("pairs"), _C("n"))


@query("agg15_mean_rank_by_message", f"WITH {_MEAN_RANKS} SELECT item, cell, source, message, {sq6('mean_rank')} AS mean_rank, n FROM mr")
def agg15(spark, sf_dir):
    return mean_rank_table(spark, sf_dir).withColumn("mean_rank", r6(_C("mean_rank")))


@query("agg16_message_by_source_table", f"""WITH {_MEAN_RANKS}
SELECT item, cell, message, {', '.join(f"{sq6(f'max(CASE WHEN source = {chr(39)}{s}{chr(39)} THEN mean_rank END)')} AS {s}" for s in V.SOURCES)}
FROM mr GROUP BY 1, 2, 3""")
def agg16(spark, sf_dir):
    return (mean_rank_table(spark, sf_dir).groupBy("item", "cell", "message")
            .pivot("source", V.SOURCES).agg(r6(F.max("mean_rank"))))


@query("agg17_extreme_messages", f"""WITH {_MEAN_RANKS}, k AS (SELECT source, {sq6('mean_rank')} AS v, item || '/' || cell || '/' || message AS l FROM mr)
SELECT source, arg_min(l, (v, l)) AS lowest, min(v) AS lowest_value, arg_min(l, (-v, l)) AS highest, max(v) AS highest_value FROM k GROUP BY source""")
def agg17(spark, sf_dir):
    t = mean_rank_table(spark, sf_dir).withColumn("mean_rank", r6(_C("mean_rank")))
    return D.extremes(t, ["source"], "mean_rank", F.concat_ws("/", "item", "cell", "message"))


@query("agg18_grand_mean_rank", f"WITH {MESSAGES} SELECT source, {sq6('avg(rank)')} AS mean_rank, count(*) AS n FROM messages GROUP BY source")
def agg18(spark, sf_dir):
    m = counted_pairs(V.responses(spark, sf_dir), ["source"]).select("source", "n", F.explode("pairs").alias("p"))
    return m.groupBy("source").agg(r6(F.sum(_C("n") * _C("p.rank")) / F.sum("n")).alias("mean_rank"), F.sum("n").alias("n"))


@query("agg19_tukey_box", f"""WITH {_MEAN_RANKS}, q AS (SELECT source, quantile_cont(mean_rank, 0.25) AS q1, quantile_cont(mean_rank, 0.5) AS median,
  quantile_cont(mean_rank, 0.75) AS q3 FROM mr GROUP BY source)
SELECT source, {sq6('q1')} AS q1, {sq6('median')} AS median, {sq6('q3')} AS q3,
  {sq6('min(CASE WHEN mean_rank >= q1 - 1.5 * (q3 - q1) THEN mean_rank END)')} AS whisker_low,
  {sq6('max(CASE WHEN mean_rank <= q3 + 1.5 * (q3 - q1) THEN mean_rank END)')} AS whisker_high
FROM mr JOIN q USING (source) GROUP BY source, q1, median, q3""")
def agg19(spark, sf_dir):
    box = D.tukey_box(materialise(mean_rank_table(spark, sf_dir)), ["source"], _C("mean_rank"))
    return box.select("source", *[r6(_C(c)).alias(c) for c in ("q1", "median", "q3", "whisker_low", "whisker_high")])


@query("agg20_exact_match_accuracy", f"WITH {V.PAIRED} SELECT source, {sq6('avg(CASE WHEN h = y THEN 1 ELSE 0 END)')} AS accuracy FROM paired GROUP BY source")
def agg20(spark, sf_dir):
    return V.paired(spark, sf_dir).groupBy("source").agg(r6(D.agreement(_C("h"), _C("y"))).alias("accuracy"))


_COMPARED = f"""cmp AS (SELECT * FROM (VALUES {V.SQL_PAIRS}) v(base, other)),
t AS (SELECT cmp.base AS run, cmp.other, a.subject, a.item, a.round, a.h, a.y AS base, b.y AS abl FROM cmp JOIN panel a ON a.source = cmp.base
  JOIN panel b ON b.source = cmp.other AND b.subject = a.subject AND b.item = a.item AND b.round = a.round WHERE a.y IS NOT NULL AND b.y IS NOT NULL)"""


@query("agg21_pairwise_difference", f"""WITH {V.PANEL}, {_COMPARED}
SELECT run AS base, other, count(*) AS n, {sq6('100.0 * avg(CASE WHEN base = abl THEN 1 ELSE 0 END)')} AS pct_unchanged, {sq6('avg(abs(base - abl))')} AS mean_abs_diff,
  {sq6('stddev_samp(base - abl)')} AS sd_diff FROM t GROUP BY 1, 2""")
def agg21(spark, sf_dir):
    rows = V.compared(P.assemble(V.panel(spark, sf_dir), V.CANDIDATES))
    out = rows.groupBy("base", "other").agg(*D.difference_summary(_C("y_base") - _C("y_other")))
    return out.select("base", "other", "n", *[r6(_C(c)).alias(c) for c in ("pct_unchanged", "mean_abs_diff", "sd_diff")])


@query("agg22_direct_cell", f"""WITH {V.PANEL}, {_COMPARED}
SELECT run AS base, other, coalesce(item, 'all') AS item, count(*) AS n, {sq6('avg(CASE WHEN base = abl THEN 1 ELSE 0 END)')} AS agree, {sq6('avg(base - abl)')} AS shift,
  {sq6('avg(abs(h - base))')} AS mae_base, {sq6('avg(abs(h - abl))')} AS mae_ablation, {sq6('avg(abs(h - base) - abs(h - abl))')} AS mae_diff
FROM t GROUP BY GROUPING SETS ((run, other), (run, other, item))""")
def agg22(spark, sf_dir):
    a, b, h = _C("y_base"), _C("y_other"), _C("h")
    return D.over_groupings(V.compared(P.assemble(V.panel(spark, sf_dir), V.CANDIDATES)), [["base", "other"], ["base", "other", "item"]], [
        F.count("*").alias("n"), r6(D.agreement(a, b)).alias("agree"), r6(F.avg(a - b)).alias("shift"),
        r6(F.avg(F.abs(h - a))).alias("mae_base"), r6(F.avg(F.abs(h - b))).alias("mae_ablation"),
        r6(F.avg(F.abs(h - a) - F.abs(h - b))).alias("mae_diff")])


@query("agg23_cell_delta_mae", f"""WITH {V.PAIRED}
SELECT item, cell, source, count(*) AS n, {sq6('avg(h - y)')} AS delta, {sq6('avg(abs(h - y))')} AS mae FROM paired GROUP BY 1, 2, 3""")
def agg23(spark, sf_dir):
    out = M.error_metrics(V.paired(spark, sf_dir), ["item", "cell", "source"])
    return out.select("item", "cell", "source", _C("weight").alias("n"), r6(_C("bias")).alias("delta"), r6(_C("mae")).alias("mae"))


GRIDS = [["source"], ["item", "source"], ["item", "cell", "source"]]
_SQL_GRIDS = "GROUPING SETS ((source), (item, source), (item, cell, source))"


@query("agg24_grouping_grid", f"""WITH {V.PAIRED}
SELECT coalesce(item, 'all') AS item, coalesce(cell, 'all') AS cell, source, count(*) AS n, {sq6('avg(h - y)')} AS delta, {sq6('avg(abs(h - y))')} AS mae
FROM paired GROUP BY {_SQL_GRIDS}""")
def agg24(spark, sf_dir):
    d = _C("h") - _C("y")
    return D.over_groupings(V.paired(spark, sf_dir), GRIDS, [
        F.count("*").alias("n"), r6(F.avg(d)).alias("delta"), r6(F.avg(F.abs(d))).alias("mae")])


_SQL_CELLS = "GROUPING SETS ((), (item), (item, cell))"


def design_counts(spark, sf_dir, lines=None):
    """Observations and distinct subjects per design cell, over the baseline.

    Subjects are made distinct by grouping first: a count(distinct) over grouping
    sets would copy every row once per set.
    """
    base = V.responses(spark, sf_dir, lines, ["subject", "item", "cell", "src"], [V.BASELINE])
    per = base.groupBy("item", "cell", "subject").agg(F.count("*").alias("n"))
    full = per.groupBy("item", "cell").agg(F.sum("n").alias("n_obs"), F.count("*").alias("n_subjects")).select(
        "item", "cell", "n_obs", "n_subjects")
    item = per.groupBy("item", "subject").agg(F.sum("n").alias("n")).groupBy("item").agg(
        F.sum("n").alias("n_obs"), F.count("*").alias("n_subjects")).select(
        "item", F.lit("all").alias("cell"), "n_obs", "n_subjects")
    whole = per.groupBy("subject").agg(F.sum("n").alias("n")).agg(
        F.sum("n").alias("n_obs"), F.count("*").alias("n_subjects")).select(
        F.lit("all").alias("item"), F.lit("all").alias("cell"), "n_obs", "n_subjects")
    return full.unionByName(item).unionByName(whole)


@query("agg25_design_counts", f"""WITH {V.RESP}
SELECT coalesce(item, 'all') AS item, coalesce(cell, 'all') AS cell, count(*) AS n_obs, count(DISTINCT subject) AS n_subjects
FROM resp WHERE src = 1 GROUP BY {_SQL_CELLS}""")
def agg25(spark, sf_dir):
    return design_counts(spark, sf_dir)


@query("agg31_frequency_table", f"""WITH {_SQL_DEMO}, v AS (SELECT 'segment' AS variable, segment AS category FROM demo
  UNION ALL SELECT 'gender', gender FROM demo UNION ALL SELECT 'country', country FROM demo)
SELECT variable, category, count(*) AS n, round(100.0 * count(*) / CAST(sum(count(*)) OVER (PARTITION BY variable) AS DOUBLE), 2) AS percent
FROM v GROUP BY 1, 2""")
def agg31(spark, sf_dir):
    return D.frequency(demographics(spark, sf_dir), ["segment", "gender", "country"])


@query("agg32_contingency_wording_by_level", f"""WITH {V.PANEL}
SELECT item, polarity, CAST(level AS INT) AS level, count(p.init) AS n FROM (SELECT DISTINCT item, polarity FROM panel) g CROSS JOIN {_LEVELS}
LEFT JOIN (SELECT item AS i, polarity AS pol, init FROM panel WHERE src = 1) p ON p.i = item AND p.pol = polarity AND p.init = level GROUP BY 1, 2, 3""")
def agg32(spark, sf_dir):
    base = V.panel(spark, sf_dir).where("src = 1")
    return D.likert_histogram(base, ["item", "polarity"], "init").drop("share")


@query("agg33_mean_by_wording", f"""WITH {V.PANEL}
SELECT polarity > 0 AS positive, {sq6('avg(init_raw)')} AS init_raw, {sq6('avg(raw)')} AS final_raw, {sq6('avg(init)')} AS init, {sq6('avg(y)')} AS final
FROM panel WHERE src = 1 GROUP BY 1""")
def agg33(spark, sf_dir):
    return V.panel(spark, sf_dir).where("src = 1").groupBy((_C("polarity") > 0).alias("positive")).agg(
        r6(F.avg("init_raw")).alias("init_raw"), r6(F.avg("raw")).alias("final_raw"),
        r6(F.avg("init")).alias("init"), r6(F.avg("y")).alias("final"))


@query("agg34_mean_by_sample", f"""WITH {V.RESP}
SELECT CASE WHEN src = 1 THEN 'observed' ELSE 'simulated' END AS sample, {sq6('avg(y)')} AS mean, count(*) AS n FROM resp GROUP BY 1""")
def agg34(spark, sf_dir):
    resp = V.responses(spark, sf_dir)
    stacked = resp.where("src = 1").withColumn("sample", F.lit("observed")).unionByName(
        resp.where("src > 1").withColumn("sample", F.lit("simulated")))
    return stacked.groupBy("sample").agg(r6(F.avg("y")).alias("mean"), F.count("*").alias("n"))


@query("agg35_counts_with_empty_bins", f"""WITH {_SQL_DEMO}, b AS (SELECT * FROM (VALUES (18, 25), (25, 35), (35, 45), (45, 55), (55, 65), (65, 200)) v(lo, hi)),
s AS (SELECT unnest(['Female', 'Male', 'Unstated']) AS gender)
SELECT lo || '-' || (hi - 1) AS age_bin, s.gender, count(d.subject) AS n FROM b CROSS JOIN s
LEFT JOIN demo d ON d.age >= lo AND d.age < hi AND d.gender = s.gender GROUP BY 1, 2""")
def agg35(spark, sf_dir):
    edges = N.AGE_EDGES_LEFT
    labels = [f"{a}-{b - 1}" for a, b in zip(edges, edges[1:])]
    frame = V.inline(spark, ["age_bin", "gender"], [(a, g) for a in labels for g in ("Female", "Male", "Unstated")])
    have = demographics(spark, sf_dir).groupBy(N.bins_left(_C("age"), edges).alias("age_bin"), "gender").agg(
        F.count("*").alias("n"))
    return frame.join(have, ["age_bin", "gender"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


@query("agg38_initial_and_final_moments", f"""WITH {V.PANEL}
SELECT source, {sq6('avg(init)')} AS mean_initial, {sq6('stddev_samp(init)')} AS sd_initial, {sq6('avg(y)')} AS mean_final, {sq6('stddev_samp(y)')} AS sd_final
FROM panel GROUP BY source""")
def agg38(spark, sf_dir):
    return V.panel(spark, sf_dir).groupBy("source").agg(
        r6(F.avg("init")).alias("mean_initial"), r6(F.stddev_samp("init")).alias("sd_initial"),
        r6(F.avg("y")).alias("mean_final"), r6(F.stddev_samp("y")).alias("sd_final"))


_TOP = f"""{V.PANEL}, sd AS (SELECT subject, round(stddev_samp(y - init), 9) AS sd FROM panel WHERE src = 1 GROUP BY 1 HAVING count(*) > 1),
top AS (SELECT subject, sd FROM sd ORDER BY sd DESC, subject LIMIT 20)"""


def _top_subjects(spark, sf_dir):
    base = V.panel(spark, sf_dir).where("src = 1")
    sd = D.within_subject_sd(base, [], "subject", _delta()).withColumn("sd", F.round("sd_within", 9))
    return sd.orderBy(F.desc("sd"), "subject").limit(20).select("subject", "sd")


@query("agg37_top_variable_subject_matrix", f"""WITH {_TOP}
SELECT subject, source, {sq6("avg(CASE WHEN item = 'A' THEN y - init END)")} AS "A", {sq6("avg(CASE WHEN item = 'N' THEN y - init END)")} AS "N",
  {sq6("avg(CASE WHEN item = 'R' THEN y - init END)")} AS "R" FROM panel WHERE src > 1 AND subject IN (SELECT subject FROM top) GROUP BY 1, 2""")
def agg37(spark, sf_dir):
    top = _top_subjects(spark, sf_dir)
    candidates = V.panel(spark, sf_dir).where("src > 1").join(top, "subject", "left_semi")
    return candidates.groupBy("subject", "source").pivot("item", V.ITEMS).agg(r6(F.avg(_delta())))


@query("srt3_top_subjects_by_sd", f"WITH {_TOP} SELECT subject, sd FROM top")
def srt3(spark, sf_dir):
    return _top_subjects(spark, sf_dir)


# Complete cases with the two baseline predictors added, in long form.
FRAME = V.COMPLETE + """,
loo_base AS (SELECT DISTINCT subject, item, round, cell, init, h FROM full_cases),
cells AS (SELECT item, cell, init, list_sort(list(h)) AS hs FROM (SELECT item, cell, y AS h, init FROM panel WHERE src = 1) GROUP BY 1, 2, 3),
scored AS (SELECT subject, item, round, cell, source, CAST(y AS DOUBLE) AS y, h, init FROM full_cases
  UNION ALL SELECT subject, item, round, cell, 'no_change', CAST(init AS DOUBLE), h, init FROM loo_base
  UNION ALL SELECT b.subject, b.item, b.round, b.cell, 'cell_median', list_aggregate(list_concat(hs[:list_position(hs, b.h) - 1], hs[list_position(hs, b.h) + 1:]), 'median'), b.h, b.init
    FROM loo_base b JOIN cells c ON c.item = b.item AND c.cell = b.cell AND c.init = b.init)"""

SCORED_SOURCES = V.CANDIDATES + ["no_change", "cell_median"]


def scored_wide(spark, sf_dir):
    """Complete cases with every candidate and the two baseline predictors as columns.

    The leave-one-out median is taken over every baseline case, then cases that
    some source missed are dropped, as the complete-case rule asks.
    """
    wide = materialise(P.assemble(V.panel(spark, sf_dir), V.CANDIDATES), "wide")
    medians = O.leave_one_out_median(wide, ["item", "cell", "init"], "h", S.LIKERT)
    full = P.attach_short(P.complete_cases(wide, V.CANDIDATES), medians, ["item", "cell", "init", "h"])
    return full.withColumns({"no_change": _C("init"), "cell_median": _C("loo")})


def scored_cases(spark, sf_dir):
    """scored_wide with one row per case and source."""
    full = scored_wide(spark, sf_dir)
    columns = [_C(s).cast("double").alias(s) for s in SCORED_SOURCES]
    return P.long_cases(
        full.select("subject", "item", "round", "cell", "h", "init", *columns),
        SCORED_SOURCES, ["subject", "item", "round", "cell", "h", "init"])


@query("met1_mae_and_bias", f"""WITH {FRAME} SELECT source, count(*) AS n, {sq6('avg(abs(h - y))')} AS mae, {sq6('avg(h - y)')} AS bias FROM scored GROUP BY source""")
def met1(spark, sf_dir):
    out = M.error_metrics(scored_cases(spark, sf_dir), ["source"])
    return out.select("source", _C("weight").alias("n"), r6(_C("mae")).alias("mae"), r6(_C("bias")).alias("bias"))


@query("met1_weighted_mae", f"""WITH {FRAME} SELECT source, {sq6('sum((subject % 3) * abs(h - y)) / sum(subject % 3)')} AS mae,
{sq6('sum((subject % 3) * (h - y)) / sum(subject % 3)')} AS bias FROM scored GROUP BY source""")
def met1w(spark, sf_dir):
    out = M.error_metrics(scored_cases(spark, sf_dir), ["source"], _C("subject") % 3)
    return out.select("source", r6(_C("mae")).alias("mae"), r6(_C("bias")).alias("bias"))


WASSERSTEIN = """vw AS (SELECT source, v, CAST(sum(wh) AS DOUBLE) AS wh, CAST(sum(wy) AS DOUBLE) AS wy FROM (
  SELECT source, CAST(h AS DOUBLE) AS v, 1 AS wh, 0 AS wy FROM scored UNION ALL SELECT source, y, 0, 1 FROM scored) GROUP BY 1, 2),
w1 AS (SELECT source, sum(abs(fh - fy) * gap) AS wasserstein FROM (
  SELECT source, sum(wh) OVER u / sum(wh) OVER a AS fh, sum(wy) OVER u / sum(wy) OVER a AS fy, lead(v) OVER (PARTITION BY source ORDER BY v) - v AS gap
  FROM vw WINDOW u AS (PARTITION BY source ORDER BY v ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), a AS (PARTITION BY source)) GROUP BY source)"""


@query("met2_wasserstein", f"""WITH {FRAME}, {WASSERSTEIN} SELECT source, {sq6('wasserstein')} AS wasserstein FROM w1""")
def met2(spark, sf_dir):
    out = M.wasserstein(M.value_weights(scored_cases(spark, sf_dir), ["source"]), ["source"])
    return out.withColumn("wasserstein", r6(_C("wasserstein")))


@query("met2_wasserstein_open_domain", f"""WITH w AS (SELECT l_returnflag AS flag, l_extendedprice AS v, sum(CASE WHEN l_linestatus = 'O' THEN 1e0 ELSE 0e0 END) AS wh,
  sum(CASE WHEN l_linestatus = 'F' THEN 1e0 ELSE 0e0 END) AS wy FROM lineitem GROUP BY 1, 2)
SELECT flag, {sq6('sum(abs(fh - fy) * gap)')} AS wasserstein FROM (SELECT flag, sum(wh) OVER u / sum(wh) OVER a AS fh, sum(wy) OVER u / sum(wy) OVER a AS fy,
  lead(v) OVER (PARTITION BY flag ORDER BY v) - v AS gap FROM w WINDOW u AS (PARTITION BY flag ORDER BY v ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), a AS (PARTITION BY flag)) GROUP BY flag""")
def met2_open(spark, sf_dir):
    """Prices of open against closed line items, a measure with as many values as rows."""
    weights = V.table(spark, sf_dir, "lineitem").groupBy(_C("l_returnflag").alias("flag"), _C("l_extendedprice").alias("v")).agg(
        *[F.sum(F.when(_C("l_linestatus") == status, 1.0).otherwise(0.0)).alias(name) for name, status in (("wh", "O"), ("wy", "F"))])
    out = M.wasserstein(weights, ["flag"], open_domain=True)
    return out.select("flag", r6(_C("wasserstein")).alias("wasserstein"))


@query("met3_spread", f"""WITH {FRAME}, s AS (SELECT source, stddev_pop(abs(y - init)) AS sy, stddev_pop(abs(h - init)) AS sh FROM scored GROUP BY source)
SELECT source, CASE WHEN sy = 0 OR sh = 0 THEN CAST('inf' AS DOUBLE) ELSE {sq6('abs(ln(sy / sh))')} END AS spread FROM s""")
def met3(spark, sf_dir):
    out = M.spread(scored_cases(spark, sf_dir), ["source"])
    return out.withColumn("spread", F.when(_C("spread") == float("inf"), _C("spread")).otherwise(r6(_C("spread"))))


@query("met4_no_change_baseline", f"""WITH {FRAME} SELECT item, {sq6('avg(abs(h - y))')} AS mae FROM scored WHERE source = 'no_change' GROUP BY item""")
def met4(spark, sf_dir):
    base = scored_cases(spark, sf_dir).where(_C("source") == "no_change")
    return M.error_metrics(base, ["item"]).select("item", r6(_C("mae")).alias("mae"))


@query("met5_leave_one_out_median", f"""WITH {FRAME} SELECT subject, item, round, y AS loo FROM scored WHERE source = 'cell_median'""")
def met5(spark, sf_dir):
    return scored_wide(spark, sf_dir).select("subject", "item", "round", "loo")


@query("met6_paired_effect_size", f"""WITH {V.PANEL}
SELECT source, count(h - y) AS n, {sq6('avg(h - y)')} AS mean_diff, {sq6('stddev_samp(h - y)')} AS sd_diff,
  {sq6('avg(h - y) / stddev_samp(h - y)')} AS d_z FROM panel WHERE src > 1 GROUP BY source""")
def met6(spark, sf_dir):
    out = V.panel(spark, sf_dir).where("src > 1").groupBy("source").agg(*M.paired_effect(_C("h") - _C("y")))
    return out.select("source", "n", *[r6(_C(c)).alias(c) for c in ("mean_diff", "sd_diff", "d_z")])


@query("met8_spread_ratios", f"""WITH {V.PANEL}, s AS (SELECT source, stddev_samp(abs(y - init)) AS sd FROM panel GROUP BY source)
SELECT c.source, {sq6('b.sd / c.sd')} AS sd_ratio, {sq6('(b.sd / c.sd) * (b.sd / c.sd)')} AS variance_ratio
FROM s c CROSS JOIN (SELECT sd FROM s WHERE source = 'baseline') b WHERE c.source <> 'baseline'""")
def met8(spark, sf_dir):
    from paneloom.operators.hypothesis import versus_baseline

    sd = V.panel(spark, sf_dir).groupBy(F.lit("all").alias("scope"), "source").agg(F.stddev_samp(F.abs(_delta())).alias("sd"))
    ratio = _C("sd_b") / _C("sd")
    return versus_baseline(sd, ["scope"], V.BASELINE).select(
        "source", r6(ratio).alias("sd_ratio"), r6(ratio * ratio).alias("variance_ratio"))


@query("met10_rank_within_cell", f"""WITH {_MEAN_RANKS}, k AS (SELECT item, cell, source, message, round(mean_rank, 9) AS v FROM mr)
SELECT item, cell, source, message, rank() OVER (PARTITION BY item, cell, source ORDER BY v)
  + (count(*) OVER (PARTITION BY item, cell, source, v) - 1) / 2e0 AS place FROM k""")
def met10(spark, sf_dir):
    t = mean_rank_table(spark, sf_dir).withColumn("v", F.round("mean_rank", 9))
    by = Window.partitionBy("item", "cell", "source")
    peers = F.count("*").over(Window.partitionBy("item", "cell", "source", "v"))
    return t.select("item", "cell", "source", "message", (F.rank().over(by.orderBy("v")) + (peers - 1) / 2).alias("place"))


@query("win1_rank_min_ties", f"""WITH {V.PAIRED}, m AS (SELECT item, source, round(avg(abs(h - y)), 1) AS mae FROM paired GROUP BY 1, 2)
SELECT item, source, mae, rank() OVER (PARTITION BY item ORDER BY mae) AS place FROM m""")
def win1(spark, sf_dir):
    m = V.paired(spark, sf_dir).groupBy("item", "source").agg(F.round(F.avg(F.abs(_C("h") - _C("y"))), 1).alias("mae"))
    return P.rank_within(m, ["item"], [_C("mae")], "place")


@query("win2_average_rank_open_domain", """SELECT c_nationkey AS nation, c_acctbal AS v, rank() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal)
  + (count(*) OVER (PARTITION BY c_nationkey, c_acctbal) - 1) / 2e0 AS avg_rank FROM customer""")
def win2(spark, sf_dir):
    people = V.table(spark, sf_dir, "customer").select(_C("c_nationkey").alias("nation"), "c_acctbal")
    ranked = O.average_ranks(people, ["nation"], _C("c_acctbal"), open_domain=True)
    # One row per case again: a value held n times appears n times.
    return ranked.withColumn("_i", F.explode(F.sequence(F.lit(1).cast("bigint"), "n"))).select("nation", "v", "avg_rank")


@query("win4_any_over_group", f"""WITH {V.PAIRED}, z AS (SELECT item, source, {sq6('avg(h - y) / stddev_samp(h - y) * sqrt(count(*))')} AS z FROM paired GROUP BY 1, 2)
SELECT item, source, z, max(abs(z)) OVER (PARTITION BY item) > 2 AS any_large FROM z""")
def win4(spark, sf_dir):
    d = _C("h") - _C("y")
    z = V.paired(spark, sf_dir).groupBy("item", "source").agg(
        r6(F.avg(d) / F.stddev_samp(d) * F.sqrt(F.count("*"))).alias("z"))
    return z.withColumn("any_large", F.max(F.abs("z")).over(Window.partitionBy("item")) > 2)


@query("win5_running_maximum", f"""WITH {V.PAIRED}, m AS (SELECT item, source, {sq6('avg(abs(h - y))')} AS mae FROM paired GROUP BY 1, 2)
SELECT item, source, max(mae) OVER (PARTITION BY item ORDER BY source ROWS UNBOUNDED PRECEDING) AS running_max FROM m""")
def win5(spark, sf_dir):
    m = V.paired(spark, sf_dir).groupBy("item", "source").agg(r6(F.avg(F.abs(_C("h") - _C("y")))).alias("mae"))
    w = Window.partitionBy("item").orderBy("source").rowsBetween(Window.unboundedPreceding, 0)
    return m.select("item", "source", F.max("mae").over(w).alias("running_max"))


@query("win6_empirical_cdf", f"""WITH {V.RESP}, c AS (SELECT source, y AS v, count(*) AS n FROM resp WHERE y IS NOT NULL GROUP BY 1, 2)
SELECT source, v, CAST(sum(n) OVER (PARTITION BY source ORDER BY v) AS BIGINT) AS upto, lead(v) OVER (PARTITION BY source ORDER BY v) - v AS gap FROM c""")
def win6(spark, sf_dir):
    counts = O.value_counts(V.responses(spark, sf_dir), ["source"], _C("y"))
    by = Window.partitionBy("source").orderBy("v")
    return counts.select("source", "v", F.sum("n").over(by).alias("upto"), (F.lead("v").over(by) - _C("v")).alias("gap"))


@query("win7_leave_one_out_by_cell", f"""WITH {FRAME}, b AS (SELECT DISTINCT item, cell, init, h FROM panel WHERE src = 1)
SELECT b.item, b.cell, b.init, b.h, list_aggregate(list_concat(hs[:list_position(hs, b.h) - 1], hs[list_position(hs, b.h) + 1:]), 'median') AS loo
FROM b JOIN cells c ON c.item = b.item AND c.cell = b.cell AND c.init = b.init""")
def win7(spark, sf_dir):
    base = V.panel(spark, sf_dir).where("src = 1")
    return O.leave_one_out_median(base, ["item", "cell", "init"], "h", S.LIKERT)


@query("win8_percent_of_total", f"""WITH {V.RESP}, c AS (SELECT item, source, count(*) AS n FROM resp GROUP BY 1, 2)
SELECT item, source, {sq6('100.0 * n / CAST(sum(n) OVER () AS DOUBLE)')} AS percent FROM c""")
def win8(spark, sf_dir):
    counts = V.responses(spark, sf_dir).groupBy("item", "source").agg(F.count("*").alias("n"))
    share = 100 * _C("n") / F.sum("n").over(Window.partitionBy(F.lit(1)))
    return counts.select("item", "source", r6(share).alias("percent"))


@query("srt1_order_by_metric", f"""WITH {V.PAIRED}, m AS (SELECT source, {sq6('avg(abs(h - y))')} AS mae FROM paired GROUP BY 1)
SELECT source, mae, row_number() OVER (ORDER BY mae, source) AS position FROM m""")
def srt1(spark, sf_dir):
    m = V.paired(spark, sf_dir).groupBy("source").agg(r6(F.avg(F.abs(_C("h") - _C("y")))).alias("mae"))
    w = Window.partitionBy(F.lit(1)).orderBy("mae", "source")
    return m.withColumn("position", F.row_number().over(w)).orderBy("position")


@query("srt2_size_ordering", """WITH s AS (SELECT DISTINCT p_size % 5 + 1 AS active, p_size AS total, 'm-' || p_size AS name FROM part)
SELECT name, row_number() OVER (ORDER BY active, total, name) AS position FROM s""")
def srt2(spark, sf_dir):
    names = V.table(spark, sf_dir, "part").select(
        (_C("p_size") % 5 + 1).alias("active"), _C("p_size").alias("total"),
        F.concat(F.lit("m-"), "p_size").alias("name")).distinct()
    w = Window.partitionBy(F.lit(1)).orderBy("active", "total", "name")
    return names.select("name", F.row_number().over(w).alias("position"))


@query("srt4_argmin_argmax", f"""WITH {V.PAIRED}, m AS (SELECT item, source, {sq6('avg(abs(h - y))')} AS mae FROM paired GROUP BY 1, 2)
SELECT item, arg_min(source, (mae, source)) AS best, arg_max(source, (mae, source)) AS worst FROM m GROUP BY item""")
def srt4(spark, sf_dir):
    m = V.paired(spark, sf_dir).groupBy("item", "source").agg(r6(F.avg(F.abs(_C("h") - _C("y")))).alias("mae"))
    key = F.struct("mae", "source")
    return m.groupBy("item").agg(F.min_by("source", key).alias("best"), F.max_by("source", key).alias("worst"))


@query("rsh1_pivot", f"""WITH {V.PAIRED}
SELECT item, {', '.join(f"{sq6(f'avg(CASE WHEN source = {chr(39)}{s}{chr(39)} THEN abs(h - y) END)')} AS {s}" for s in V.CANDIDATES)} FROM paired GROUP BY item""")
def rsh1(spark, sf_dir):
    return V.paired(spark, sf_dir).groupBy("item").pivot("source", V.CANDIDATES).agg(r6(F.avg(F.abs(_C("h") - _C("y")))))


@query("rsh2_melt", f"""WITH {V.PAIRED}, m AS (SELECT item, source, count(*) AS n, CAST(sum(h - y) AS BIGINT) AS total FROM paired GROUP BY 1, 2)
SELECT item, source, 'n' AS measure, n AS value FROM m UNION ALL SELECT item, source, 'total', total FROM m""")
def rsh2(spark, sf_dir):
    m = V.paired(spark, sf_dir).groupBy("item", "source").agg(F.count("*").alias("n"), F.sum(_C("h") - _C("y")).alias("total"))
    return P.melt(m, ["item", "source"], ["n", "total"], "measure", "value")


@query("rsh3_subject_item_matrix", f"""WITH {V.PAIRED}
SELECT subject, {sq6("avg(CASE WHEN item = 'A' THEN y END)")} AS "A", {sq6("avg(CASE WHEN item = 'N' THEN y END)")} AS "N", {sq6("avg(CASE WHEN item = 'R' THEN y END)")} AS "R"
FROM paired GROUP BY subject""")
def rsh3(spark, sf_dir):
    return V.paired(spark, sf_dir).groupBy("subject").pivot("item", V.ITEMS).agg(r6(F.avg("y")))
