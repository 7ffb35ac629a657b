"""Queries for resampling tests, rankings, sensitivity and the combined report."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from paneloom.operators import hypothesis as H
from paneloom.operators import pairing as P
from paneloom.operators import power as W
from paneloom.operators import resample as B
from paneloom.plans import report
from paneloom.plans import tables as V
from paneloom.plans.queries_describe import (FRAME, SCORED_SOURCES, _MEAN_RANKS, design_counts,
                                             mean_rank_table, scored_cases, scored_wide)
from paneloom.plans.queries_pairing import counted_rank_match
from paneloom.plans.queries_tests import _BF, _CHI
from paneloom.plans.registry import query, r6, sq6
from paneloom.session import materialise

_C = F.col

def _wide(spark, sf_dir, lines=None):
    # The cell follows from the subject. As a key it leaves numbers alone to carry, which need no sort of all answers.
    keys, carry = [*P.KEYS, "cell"], ("init", "h", "polarity")
    return P.assemble(V.panel(spark, sf_dir, lines, [*keys, *carry, "source", "y"]), V.CANDIDATES, keys, carry)


def _lines(spark, sf_dir):
    """The panel's rows for a job whose parts read beliefs and orders alone."""
    return materialise(V.lines_wide(spark, sf_dir, V.ANSWER_FIELDS), "lines")


def _beliefs(spark, sf_dir, lines):
    """Answers beside the baseline's initial belief, and all answers."""
    cells = [*report.CELL, "source", "y"]
    return V.panel(spark, sf_dir, lines, [*cells, "init"]), V.responses(spark, sf_dir, lines, cells)


def _diffs():
    return F.filter(F.array(*[
        F.struct(F.lit(s).alias("label"), (_C("h") - _C(s)).alias("d")) for s in V.CANDIDATES
    ]), lambda x: x["d"].isNotNull())


# Numpy's binomial draws have no SQL. What the tests observe has: these twins check the counts that the draws start from.
_OBSERVED = """sf AS (SELECT coalesce(item, 'all') AS item, coalesce(cell, 'all') AS cell, source, count(*) AS n, avg(h - y) AS mean_diff, stddev_samp(h - y) AS sd_diff
  FROM paired GROUP BY GROUPING SETS ((source), (item, source), (item, cell, source)))"""


@query("sta1_sign_flip_grid")
def sta1(spark, sf_dir, n_rep=B.N_FLIPS):
    out = B.counted_sign_flip(_wide(spark, sf_dir), ["item", "cell"], _diffs(), report.GROUPINGS, n_rep)
    return out.select("item", "cell", _C("label").alias("source"), "n", r6(_C("mean_diff")).alias("mean_diff"),
                      "exceed", r6(_C("p")).alias("p"), "reject")


@query("sta1_observed_differences", f"""WITH {V.PAIRED}, {_OBSERVED}
SELECT item, cell, source, n, {sq6('mean_diff')} AS mean_diff, {sq6('sd_diff')} AS sd_diff, {sq6('mean_diff / sd_diff')} AS d_z FROM sf""")
def sta1_observed(spark, sf_dir):
    """Effects of every grouping from counts per difference, as the sign flips see them."""
    out = B.observed_differences(B.difference_counts(_wide(spark, sf_dir), ["item", "cell"], _diffs(), report.GROUPINGS))
    return out.select("item", "cell", _C("label").alias("source"), "n", *[r6(_C(c)).alias(c) for c in ("mean_diff", "sd_diff", "d_z")])


@query("sta2_sign_flip_whole_design")
def sta2(spark, sf_dir, n_rep=B.N_FLIPS):
    out = B.counted_sign_flip(_wide(spark, sf_dir), [], _diffs(), [[]], n_rep)
    return out.select(_C("label").alias("source"), "n", r6(_C("mean_diff")).alias("mean_diff"), r6(_C("p")).alias("p"))


# Named comparisons: source a against source b; 'baseline' stands for the observed answers.
COMPARISONS = ([("baseline", s) for s in V.CANDIDATES] + [("model_2", s) for s in V.CANDIDATES[1:4]])


def _comparisons(spark, sf_dir):
    wide = _wide(spark, sf_dir).withColumn(V.BASELINE, _C("h"))
    diffs = F.filter(F.array(*[
        F.struct(F.lit(f"{a}|{b}").alias("label"), (_C(a) - _C(b)).alias("d")) for a, b in COMPARISONS
    ]), lambda x: x["d"].isNotNull())
    return wide, diffs


def _named(out):
    names = F.split("label", r"\|")
    return out.withColumns({"a": names[0], "b": names[1]})


@query("sta3_comparison_registry")
def sta3(spark, sf_dir, n_rep=B.N_FLIPS):
    wide, diffs = _comparisons(spark, sf_dir)
    out = _named(B.counted_sign_flip(wide, [], diffs, [[]], n_rep))
    return out.select("a", "b", "n", r6(_C("mean_diff")).alias("observed_diff"), r6(_C("p")).alias("p"))


@query("sta3_observed_differences", f"""WITH {V.PANEL}, cmp AS (SELECT * FROM (VALUES {', '.join(f"('{a}', '{b}')" for a, b in COMPARISONS)}) v(a, b)),
pd AS (SELECT cmp.a, cmp.b, x.y - z.y AS d FROM cmp JOIN panel x ON x.source = cmp.a JOIN panel z ON z.source = cmp.b AND z.subject = x.subject AND z.item = x.item AND z.round = x.round
  WHERE x.y IS NOT NULL AND z.y IS NOT NULL)
SELECT a, b, count(*) AS n, {sq6('avg(d)')} AS observed_diff, {sq6('stddev_samp(d)')} AS sd_diff FROM pd GROUP BY 1, 2""")
def sta3_observed(spark, sf_dir):
    wide, diffs = _comparisons(spark, sf_dir)
    out = _named(B.observed_differences(B.difference_counts(wide, [], diffs, [[]])))
    return out.select("a", "b", "n", r6(_C("mean_diff")).alias("observed_diff"), r6(_C("sd_diff")).alias("sd_diff"))


@query("agg22_ablation_permutation")
def agg22_permutation(spark, sf_dir, n_rep=B.N_FLIPS):
    a, b, h = _C("y_base"), _C("y_other"), _C("h")
    diffs = F.array(F.struct(F.lit("shift").alias("label"), (a - b).alias("d")),
                    F.struct(F.lit("mae").alias("label"), (F.abs(h - a) - F.abs(h - b)).alias("d")))
    pair = ["base", "other"]
    out = B.counted_sign_flip(V.compared(_wide(spark, sf_dir)), pair, diffs, [pair], n_rep)
    return out.groupBy(*pair).agg(r6(F.max(F.when(_C("label") == "shift", _C("p")))).alias("p_shift"),
                                  r6(F.max(F.when(_C("label") == "mae", _C("p")))).alias("p_mae"))


def _errors(spark, sf_dir):
    return materialise(B.subject_errors(scored_wide(spark, sf_dir), "subject", SCORED_SOURCES), "errors")


_N = len(SCORED_SOURCES)
# One digest per subject and 32 flips, subjects wide: the twin follows the published number of flips.
_CLUSTER = f"""se AS (SELECT subject, {', '.join(f"sum(abs(h - y)) FILTER (source = '{s}') AS e{i}" for i, s in enumerate(SCORED_SOURCES))} FROM scored GROUP BY subject),
nc AS (SELECT count(*) / {_N}e0 AS n_cases, {', '.join(f"(SELECT sum(e{i}) FROM se) AS o{i}" for i in range(_N))} FROM scored),
dg AS (SELECT blk, {', '.join(f'e{i}' for i in range(_N))}, ('0x' || substr(md5('7|' || blk || '|' || subject), 1, 8))::UBIGINT AS word
  FROM se CROSS JOIN (SELECT unnest(range({math.ceil(B.N_CLUSTER_FLIPS / 32)})) AS blk)),
rs AS (SELECT blk, pos, {', '.join(f"sum((2 * CAST((word >> CAST(pos AS UBIGINT)) & 1 AS INT) - 1) * e{i}) AS s{i}" for i in range(_N))}
  FROM dg CROSS JOIN (SELECT unnest(range(32)) AS pos) WHERE blk * 32 + pos < {B.N_CLUSTER_FLIPS} GROUP BY 1, 2),
cf AS ({' UNION ALL '.join(f"SELECT '{a}' AS a, '{b}' AS b, max(o{i} - o{j}) / max(n_cases) AS diff, (count(CASE WHEN abs(s{i} - s{j}) >= abs(o{i} - o{j}) - 1e-9 THEN 1 END) + 1) / {B.N_CLUSTER_FLIPS + 1}e0 AS p FROM rs CROSS JOIN nc"
                           for i, a in enumerate(SCORED_SOURCES) for j, b in enumerate(SCORED_SOURCES) if i < j)})"""


@query("sta4_cluster_sign_flip", f"WITH {FRAME}, {_CLUSTER} SELECT a, b, {sq6('diff')} AS diff, {sq6('p')} AS p FROM cf")
def sta4(spark, sf_dir, n_rep=B.N_CLUSTER_FLIPS):
    out = B.cluster_sign_flip(_errors(spark, sf_dir), "subject", SCORED_SOURCES, n_rep, 7)
    return out.select("a", "b", r6(_C("diff")).alias("diff"), r6(_C("p")).alias("p"))


@query("sta5_omnibus")
def sta5(spark, sf_dir, n_rep=B.N_CLUSTER_FLIPS):
    out = B.omnibus(_errors(spark, sf_dir), "subject", SCORED_SOURCES, n_rep, 7)
    return out.select(r6(_C("statistic")).alias("statistic"), r6(_C("p")).alias("p"))


@query("sta5_observed_variance", f"""WITH {FRAME} SELECT {sq6('var_pop(mae)')} AS statistic FROM (SELECT avg(abs(h - y)) AS mae FROM scored GROUP BY source)""")
def sta5_observed(spark, sf_dir):
    """The omnibus statistic from subject sums."""
    errors = B.mean_errors(_errors(spark, sf_dir), [], SCORED_SOURCES)
    return errors.agg(r6(F.var_pop("mae")).alias("statistic"))


@query("sta7_cluster_bootstrap")
def sta7(spark, sf_dir, n_boot=B.N_BOOTSTRAPS):
    out = B.bootstrap_errors(_errors(spark, sf_dir), "subject", SCORED_SOURCES, n_boot, 11)
    return out.select("rep", "source", r6(_C("mae")).alias("mae"), r6(_C("bias")).alias("bias"))


@query("sta7_bootstrap_all_metrics")
def sta7_all(spark, sf_dir, n_boot=B.N_BOOTSTRAPS):
    cases = materialise(scored_cases(spark, sf_dir), "cases")
    out = B.bootstrap_metrics(cases, "subject", n_boot, 11)
    return out.select("rep", "source", r6(_C("mae")).alias("mae"), r6(_C("wasserstein")).alias("wasserstein"))


@query("sta7_poisson_bootstrap", f"""WITH {FRAME}, se AS (SELECT subject, count(*) / {_N} AS m, {', '.join(f"sum(abs(h - y)) FILTER (source = '{s}') AS e{i}" for i, s in enumerate(SCORED_SOURCES))} FROM scored GROUP BY subject),
cum AS (SELECT list(c ORDER BY k) AS cs FROM (SELECT k, sum(t) OVER (ORDER BY k) AS c FROM (SELECT k, exp(-1e0) / gamma(k + 1e0) AS t FROM (SELECT unnest(range(12)) AS k)))),
u AS (SELECT se.*, rep, ('0x' || substr(md5('poisson|11|' || rep || '|' || subject), 1, 8))::UBIGINT / 4294967296e0 AS u FROM se CROSS JOIN (SELECT unnest(range({B.N_BOOTSTRAPS})) AS rep)),
w AS (SELECT *, {' + '.join(f'CASE WHEN u >= cs[{k}] THEN 1 ELSE 0 END' for k in range(1, 13))} AS w FROM u CROSS JOIN cum),
t AS (SELECT rep, sum(w * m) AS n, {', '.join(f'sum(w * e{i}) AS t{i}' for i in range(_N))} FROM w GROUP BY rep)
{' UNION ALL '.join(f"SELECT rep, '{s}' AS source, {sq6(f't{i} / CAST(n AS DOUBLE)')} AS mae FROM t WHERE n > 0" for i, s in enumerate(SCORED_SOURCES))}""")
def sta7_poisson(spark, sf_dir, n_boot=B.N_BOOTSTRAPS):
    out = B.poisson_errors(_errors(spark, sf_dir), "subject", SCORED_SOURCES, n_boot, 11)
    return out.select("rep", "source", r6(_C("mae")).alias("mae"))


def _mae_reps(errors, n_boot=B.N_BOOTSTRAPS):
    return B.bootstrap_errors(errors, "subject", SCORED_SOURCES, n_boot, 11).withColumn("mae", F.round("mae", 9))


@query("sta8_percentile_interval")
def sta8(spark, sf_dir, n_boot=B.N_BOOTSTRAPS):
    out = B.percentile_interval(_mae_reps(_errors(spark, sf_dir), n_boot), ["source"], "mae")
    return out.select("source", r6(_C("lo")).alias("lo"), r6(_C("hi")).alias("hi"))


_RANKED = ", ".join(f"'{s}'" for s in V.CANDIDATES)
_POINT = f"""pt AS (SELECT source, avg(abs(h - y)) AS mae FROM scored GROUP BY source),
pr AS (SELECT source, rank() OVER (ORDER BY mae) AS place FROM pt WHERE source IN ({_RANKED}))"""


@query("sta9_rank_summary")
def sta9(spark, sf_dir, n_boot=B.N_BOOTSTRAPS):
    errors = _errors(spark, sf_dir)
    out = B.rank_summary(B.mean_errors(errors, [], SCORED_SOURCES), materialise(_mae_reps(errors, n_boot), "reps"), "mae", V.CANDIDATES)
    return out.select("source", *[r6(_C(c)).alias(c) for c in ("estimate", "lo", "hi")], "place",
                      "rank_lo", "rank_hi", r6(_C("p_best")).alias("p_best"))


@query("sta9_point_ranks", f"WITH {FRAME}, {_POINT} SELECT source, {sq6('mae')} AS estimate, place FROM pt LEFT JOIN pr USING (source)")
def sta9_point(spark, sf_dir):
    """Estimates and ranks without replicates, from subject sums."""
    point = B.mean_errors(_errors(spark, sf_dir), [], SCORED_SOURCES)
    return point.join(B.point_ranks(point, "mae", V.CANDIDATES), "source", "left").select("source", r6(_C("mae")).alias("estimate"), "place")


@query("sta6_pairwise_mae")
def sta6(spark, sf_dir, n_boot=B.N_BOOTSTRAPS, n_rep=B.N_CLUSTER_FLIPS):
    errors = _errors(spark, sf_dir)
    reps = _mae_reps(errors, n_boot)
    flips = B.cluster_sign_flip(errors, "subject", SCORED_SOURCES, n_rep, 7)
    out = B.pairwise(reps, flips, SCORED_SOURCES)
    return out.select("a", "b", *[r6(_C(c)).alias(c) for c in ("diff", "lo", "hi", "p")], "significant")


_SWEEP_RETRY = f"""rt AS (SELECT source, count(CASE WHEN n_tries = {V.MAX_TRIES} THEN 1 END) AS tries_n, count(raw) AS valid_n, count(*) AS total FROM resp WHERE src > 1 GROUP BY source)"""
@query("sta26_sweep_estimates", f"""WITH {FRAME}, {_POINT}, {_SWEEP_RETRY}
SELECT source, source IN ('no_change', 'cell_median') AS is_baseline, valid_n, total AS valid_total, tries_n, {sq6('mae')} AS mae, place, {sq6('delta')} AS delta, n_obs
FROM pt JOIN (SELECT source, avg(h - y) AS delta, count(*) AS n_obs FROM scored GROUP BY source) USING (source) LEFT JOIN pr USING (source) LEFT JOIN rt USING (source)""")
def sta26_estimates(spark, sf_dir):
    """The sweep without its resampled columns."""
    wide = materialise(scored_wide(spark, sf_dir), "scored")
    point = B.mean_errors(B.subject_errors(wide, "subject", SCORED_SOURCES), [], SCORED_SOURCES)
    observed = B.observed_differences(B.difference_counts(wide, [], _scored_diffs(), [[]])).withColumnRenamed("label", "source")
    out = (point.join(B.point_ranks(point, "mae", V.CANDIDATES), "source", "left").join(observed, "source")
           .join(_retries(spark, sf_dir), "source", "left"))
    return out.select("source", _C("source").isin("no_change", "cell_median").alias("is_baseline"), "valid_n", "valid_total", "tries_n",
                      r6(_C("mae")).alias("mae"), "place", r6(_C("mean_diff")).alias("delta"), _C("n").alias("n_obs"))


def _scored_diffs():
    return F.array(*[F.struct(F.lit(s).alias("label"), (_C("h") - _C(s).cast("double")).alias("d")) for s in SCORED_SOURCES])


def _retries(spark, sf_dir):
    return V.responses(spark, sf_dir).where("src > 1").groupBy("source").agg(
        F.count(F.when(_C("n_tries") == V.MAX_TRIES, 1)).alias("tries_n"), F.count("raw").alias("valid_n"),
        F.count("*").alias("valid_total"))


@query("sta26_source_sweep")
def sta26(spark, sf_dir, n_boot=B.N_BOOTSTRAPS, n_rep=B.N_CLUSTER_FLIPS):
    wide = materialise(scored_wide(spark, sf_dir), "scored")
    errors = materialise(B.subject_errors(wide, "subject", SCORED_SOURCES), "errors")
    summary = B.rank_summary(B.mean_errors(errors, [], SCORED_SOURCES), materialise(_mae_reps(errors, n_boot), "reps"), "mae", V.CANDIDATES)
    flips = B.counted_sign_flip(wide, [], _scored_diffs(), [[]], n_rep).withColumnRenamed("label", "source")
    tested = H.holm(flips.withColumn("family", F.lit(1)), ["family"]).select(
        "source", _C("n").alias("n_obs"), _C("mean_diff").alias("delta"), "p", "p_holm")
    out = summary.join(tested, "source").join(_retries(spark, sf_dir), "source", "left")
    return out.select(
        "source", _C("source").isin("no_change", "cell_median").alias("is_baseline"), "valid_n", "valid_total", "tries_n",
        r6(_C("estimate")).alias("mae"), r6(_C("lo")).alias("mae_lo"), r6(_C("hi")).alias("mae_hi"), "place",
        r6(_C("delta")).alias("delta"), r6(_C("p")).alias("p"), r6(_C("p_holm")).alias("p_holm"),
        (_C("p_holm") < 0.05).alias("significant"), "n_obs", F.lit(n_boot).alias("n_boot"), F.lit(n_rep).alias("n_resamples"))


_SQL_COUNTS = """dc AS (SELECT coalesce(item, 'all') AS item, coalesce(cell, 'all') AS cell, count(*) AS n_obs, count(DISTINCT subject) AS n_subjects
FROM resp WHERE src = 1 GROUP BY GROUPING SETS ((), (item), (item, cell)))"""


_Z2, _SHIFT, _LAMBDA = (f"{c!r}::DOUBLE" for c in W.constants())


@query("sta27_detectable_effects", f"""WITH {V.RESP}, {_SQL_COUNTS}
SELECT item, cell, n_obs, n_subjects, round(sqrt({_Z2} / (n_obs - {_SHIFT})), 4) + 0.0 AS dz_nominal, round(sqrt({_Z2} / (n_subjects - {_SHIFT})), 4) + 0.0 AS dz_independent,
  round(sqrt({_LAMBDA} / (2 * n_obs)), 4) + 0.0 AS v_nominal, round(sqrt({_Z2} / (n_obs - {_SHIFT})) * {W.TAU_SD_NULL!r}::DOUBLE, 4) + 0.0 AS tau_nominal FROM dc""")
def sta27(spark, sf_dir):
    out = W.detectable(design_counts(spark, sf_dir))
    return out.select("item", "cell", "n_obs", "n_subjects", *[
        (F.round(c, 4) + F.lit(0.0)).alias(c) for c in ("dz_nominal", "dz_independent", "v_nominal", "tau_nominal")])


@query("sta28_brown_forsythe_power")
def sta28(spark, sf_dir, n_sims=W.N_SIMS):
    base = V.panel(spark, sf_dir).where("src = 1")
    change = F.abs(_C("y") - _C("init"))
    return W.brown_forsythe_power(base, change, [1.0, 1.05, 1.1, 1.25], n_sims, 5).withColumn("power", r6(_C("power")))


@query("sta28_power_less_variable_base")
def sta28_reverse(spark, sf_dir, n_sims=W.N_SIMS):
    """The other direction: the source varies more than the baseline."""
    base = V.panel(spark, sf_dir).where("src = 1")
    out = W.brown_forsythe_power(base, F.abs(_C("y") - _C("init")), [1.0, 1.05, 1.1, 1.25], n_sims, 5, base_more_variable=False)
    return out.withColumn("power", r6(_C("power")))


def full_report(spark, sf_dir, n_rep=B.N_FLIPS):
    """Every analysis of every grouping over the driver's panel."""
    lines = _lines(spark, sf_dir)
    matched = counted_rank_match(spark, sf_dir, lines).where(_C("reason").isNull())
    return report.effect_report(
        *_beliefs(spark, sf_dir, lines), _wide(spark, sf_dir, lines), matched,
        mean_rank_table(spark, sf_dir, lines), design_counts(spark, sf_dir, lines), V.CANDIDATES, V.BASELINE, n_rep)


# Statistics of the report that SQL can state; the F tails are left to the rows-only query.
_SQL_REPORT = f"""WITH {V.PAIRED}, {_OBSERVED}, gs AS (SELECT * FROM (VALUES ('all', 'all'), ('i', 'all'), ('i', 'c')) v(gi, gc)),
rg AS (SELECT CASE WHEN gi = 'all' THEN 'all' ELSE item END AS item, CASE WHEN gc = 'all' THEN 'all' ELSE cell END AS cell, source, src, y FROM resp CROSS JOIN gs),
lv AS (SELECT item || '/' || cell AS g, source, y AS level, count(*) AS o FROM rg WHERE y IS NOT NULL GROUP BY 1, 2, 3),
tab AS (SELECT g || '/' || source AS k, level, o, 'c' AS side FROM lv WHERE source <> 'baseline' UNION ALL
  SELECT s.g || '/' || s.source, l.level, l.o, 'b' FROM lv l JOIN (SELECT DISTINCT g, source FROM lv WHERE source <> 'baseline') s ON s.g = l.g WHERE l.source = 'baseline'),
{_CHI.format(keys='k')},
bv AS (SELECT CASE WHEN gi = 'all' THEN 'all' ELSE item END || '/' || CASE WHEN gc = 'all' THEN 'all' ELSE cell END AS k, source, abs(y - init) AS v FROM panel CROSS JOIN gs WHERE y IS NOT NULL), {_BF},
lo AS (SELECT item, cell, source, 'difference' AS test, unnest(['n', 'mean_diff', 'sd_diff', 'd_z']) AS statistic, unnest([CAST(n AS DOUBLE), mean_diff, sd_diff, mean_diff / sd_diff]) AS value FROM sf
UNION ALL SELECT split_part(k, '/', 1), split_part(k, '/', 2), split_part(k, '/', 3), 'stance', unnest(['chi2', 'cramers_v', 'min_expected', 'p']), unnest([chi2, sqrt(chi2 / n_total), min_expected, exp(-chi2 / 2) * (1 + chi2 / 2)]) FROM chi
UNION ALL SELECT split_part(k, '/', 1), split_part(k, '/', 2), source, 'change', unnest(['sd_base', 'sd', 'variance_ratio', 'w']), unnest([sd_base, sd, (sd_base / sd) * (sd_base / sd), w]) FROM bf)
SELECT item, cell, source, test, statistic, {sq6('value')} AS value FROM lo"""


def _sections(spark, sf_dir, difference, statistics):
    """The report's difference, stance and change sections over all groupings."""
    lines = _lines(spark, sf_dir)
    panel, responses = _beliefs(spark, sf_dir, lines)
    parts = [
        report._long(difference(_wide(spark, sf_dir, lines)), "difference", statistics),
        report._long(report.stance_test(responses, V.BASELINE), "stance",
                     ["chi2", "cramers_v", "min_expected", "p"]),
        report._long(report.change_test(panel, V.BASELINE), "change", ["sd_base", "sd", "variance_ratio", "w"]),
    ]
    out = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return out.withColumn("value", r6(_C("value")))


@query("sta29_effect_report")
def sta29(spark, sf_dir, n_rep=B.N_FLIPS):
    return _sections(spark, sf_dir, lambda wide: report.difference_test(wide, V.CANDIDATES, n_rep, 42),
                     ["n", "mean_diff", "sd_diff", "d_z", "p"])


@query("sta29_effect_statistics", _SQL_REPORT)
def sta29_statistics(spark, sf_dir):
    """The same without the resampled p."""
    def observed(wide):
        counts = B.difference_counts(wide, report.CELL, report.paired_diffs(V.CANDIDATES), report.GROUPINGS)
        return B.observed_differences(counts).withColumnRenamed("label", "source")

    return _sections(spark, sf_dir, observed, ["n", "mean_diff", "sd_diff", "d_z"])


@query("sta29_effect_report_full")
def sta29_full(spark, sf_dir, n_rep=B.N_FLIPS):
    return full_report(spark, sf_dir, n_rep).withColumn("value", r6(_C("value")))


@query("sta30_overview")
def sta30(spark, sf_dir, n_rep=B.N_FLIPS):
    out = report.overview(full_report(spark, sf_dir, n_rep), 13)
    return out.withColumns({c: r6(_C(c)) for c, t in out.dtypes if t == "double"})


@query("sta31_reliability_flags")
def sta31(spark, sf_dir, n_rep=B.N_FLIPS):
    return report.caveats(full_report(spark, sf_dir, n_rep), 27)


@query("sta31_message_and_tau_sections", f"""WITH {_MEAN_RANKS}, sh AS (SELECT item, cell, message FROM mr GROUP BY 1, 2, 3 HAVING count(*) = 7),
gs AS (SELECT * FROM (VALUES ('all', 'all'), ('i', 'all'), ('i', 'c')) v(gi, gc)),
bv AS (SELECT CASE WHEN gi = 'all' THEN 'all' ELSE item END || '/' || CASE WHEN gc = 'all' THEN 'all' ELSE cell END AS k, source, mean_rank AS v FROM mr JOIN sh USING (item, cell, message) CROSS JOIN gs), {_BF}
SELECT split_part(k, '/', 1) AS item, split_part(k, '/', 2) AS cell, source, n, {sq6('(sd / sd_base) * (sd / sd_base)')} AS variance_ratio FROM bf""")
def sta31_messages(spark, sf_dir):
    out = report.message_test(mean_rank_table(spark, sf_dir), 7, V.BASELINE)
    return out.select("item", "cell", "source", "n", r6(_C("variance_ratio")).alias("variance_ratio"))
