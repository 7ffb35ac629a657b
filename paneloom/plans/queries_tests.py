"""Queries for run health, closed-form tests and multiple comparisons."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from paneloom import schema as S
from paneloom.functions import ranks as R
from paneloom.operators import describe as D
from paneloom.operators import health as G
from paneloom.operators import hypothesis as H
from paneloom.plans import tables as V
from paneloom.plans.queries_describe import _MEAN_RANKS, mean_rank_table
from paneloom.plans.queries_pairing import RANK_MATCH, _rank_match
from paneloom.plans.queries_scalar import SQL_TRAITS, item_columns
from paneloom.plans.registry import query, r6, sq6
from paneloom.session import materialise

_C = F.col


def _delta():
    return _C("y") - _C("init")


def _diagnostics(spark, sf_dir):
    return V.responses(spark, sf_dir).where("src > 1").select(
        "source", "l_partkey", "l_orderkey", _C("raw").alias("llm_new_belief"),
        _C("raw").isNotNull().alias("valid_output"), "n_tries",
        F.when(_C("l_partkey") % 31 != 0, _C("n_truncated")).alias("n_truncated"),
        F.lit(V.TOKEN_BUDGET).alias("max_tokens_budget"), "completion_tokens", "thinking_disabled",
        (_C("completion_tokens") / 4).cast("int").alias("reasoning_tokens"))


_SQL_HEALTH = f"""hs AS (SELECT source, count(*) AS n, count(raw) AS valid,
  CAST(sum(CASE WHEN l_partkey % 31 <> 0 THEN n_truncated ELSE 0 END) AS BIGINT) AS truncated,
  {V.TOKEN_BUDGET} AS budget, CAST(floor(median(completion_tokens)) AS INT) AS tok_median, max(completion_tokens) AS tok_max,
  count(CASE WHEN completion_tokens >= 0.9 * {V.TOKEN_BUDGET} THEN 1 END) AS near_limit,
  count(CASE WHEN thinking_disabled THEN 1 END) AS no_thinking, {sq6('avg(n_tries)')} AS mean_tries,
  {sq6('100.0 * sum(CASE WHEN completion_tokens > 0 THEN CAST(floor(completion_tokens / 4) AS INT) END) / sum(CASE WHEN completion_tokens > 0 THEN completion_tokens END)')} AS think_pct,
  {sq6('100.0 * count(raw) / count(*)')} AS valid_pct FROM resp WHERE src > 1 GROUP BY source)"""


@query("agg26_validity_share", f"WITH {V.RESP} SELECT source, count(raw) AS n_valid, count(*) AS total, {sq6('count(raw) / CAST(count(*) AS DOUBLE)')} AS share FROM resp GROUP BY source")
def agg26(spark, sf_dir):
    return G.validity(V.responses(spark, sf_dir), ["source"], "raw").withColumn("share", r6(_C("share")))


@query("agg27_retry_share", f"""WITH {V.RESP} SELECT source, CAST(sum(CASE WHEN n_tries = 2 + src % 2 THEN 1 ELSE 0 END) AS BIGINT) AS n_at_limit,
count(*) AS total, {sq6('avg(CASE WHEN n_tries = 2 + src % 2 THEN 1 ELSE 0 END)')} AS share FROM resp WHERE src > 1 GROUP BY source""")
def agg27(spark, sf_dir):
    limits = V.inline(spark, ["source", "max_tries"], [(f"model_{n}", 2 + n % 2) for n in range(2, 8)])
    return G.retry_share(V.responses(spark, sf_dir), limits, "source").withColumn("share", r6(_C("share")))


_HEALTH = ["source", "n", "valid", "truncated", "budget", "tok_median", "tok_max", "near_limit", "no_thinking",
           "mean_tries", "think_pct", "valid_pct"]


@query("agg28_run_health", f"WITH {V.RESP}, {_SQL_HEALTH} SELECT {', '.join(_HEALTH)} FROM hs")
def agg28(spark, sf_dir):
    out = G.summarize(_diagnostics(spark, sf_dir), ["source"]).select(*_HEALTH)
    return out.withColumns({c: r6(_C(c)) for c in ("mean_tries", "think_pct", "valid_pct")})


@query("agg29_health_verdict", f"""WITH {V.RESP}, {_SQL_HEALTH}, rt AS (SELECT source, count(CASE WHEN l_partkey % 31 <> 0 AND n_truncated > 0 THEN 1 END) AS rows_truncated
  FROM resp WHERE src > 1 GROUP BY source)
SELECT source, CASE WHEN truncated > 0 AND no_thinking > 0 THEN 'NO-THINKING FALLBACK - ' || truncated || ' attempt(s) across ' || rows_truncated || '/' || n
  || ' rows hit the ceiling; ' || no_thinking || '/' || n || ' row(s) answered with thinking off' ELSE 'other' END AS verdict FROM hs JOIN rt USING (source)""")
def agg29(spark, sf_dir):
    return G.verdict(G.summarize(_diagnostics(spark, sf_dir), ["source"])).select("source", "verdict")


@query("agg29_verdict_without_truncation", f"""WITH {V.RESP}, h AS (SELECT source, r1 * 10 + r2 AS grp, count(*) AS n, count(raw) AS valid,
  count(CASE WHEN completion_tokens >= 0.9 * {V.TOKEN_BUDGET} THEN 1 END) AS near FROM resp WHERE src > 1 GROUP BY 1, 2)
SELECT source, grp, CASE WHEN near > 0 THEN 'RAISE max_tokens - ' || near || '/' || n || ' used over 90% of it'
  WHEN valid < n THEN 'FORMAT - ' || (n - valid) || '/' || n || ' unparseable, budget was not the limit' ELSE 'OK' END AS verdict FROM h""")
def agg29b(spark, sf_dir):
    runs = V.responses(spark, sf_dir).where("src > 1").select(
        "source", (_C("r1") * 10 + _C("r2")).alias("grp"), _C("raw").alias("llm_new_belief"),
        F.lit(V.TOKEN_BUDGET).alias("max_tokens_budget"), "completion_tokens")
    return G.verdict(G.summarize(runs, ["source", "grp"])).select("source", "grp", "verdict")


@query("agg30_first_failed_rows", f"""WITH {V.RESP} SELECT source, subject, item, round FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY subject, item, round) AS k
FROM resp WHERE raw IS NULL) WHERE k <= 5""")
def agg30(spark, sf_dir):
    # A row_number filter becomes a per-partition top-n before the shuffle.
    w = Window.partitionBy("source").orderBy("subject", "item", "round")
    failed = V.responses(spark, sf_dir).where(_C("raw").isNull()).select("source", "subject", "item", "round")
    return failed.withColumn("k", F.row_number().over(w)).where("k <= 5").drop("k")


@query("agg36_repair_counters", f"""WITH {V.PARSED} SELECT source AS file, count(*) AS n, CAST(sum(CASE WHEN usable AND raw IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS repaired,
CAST(sum(CASE WHEN usable AND raw IS NOT NULL AND raw <> b THEN 1 ELSE 0 END) AS BIGINT) AS mismatched FROM parsed GROUP BY source""")
def agg36(spark, sf_dir):
    from paneloom.functions import responses as parse

    p = parse.with_coerced(V.with_raw_text(V.responses(spark, sf_dir)), "raw_response")
    ok = _C("parsed").isNotNull()
    return p.groupBy(_C("source").alias("file")).agg(
        F.count("*").alias("n"), F.sum((ok & _C("raw").isNull()).cast("int")).alias("repaired"),
        F.sum(F.coalesce(ok & (_C("raw") != _C("parsed.new_belief")), F.lit(False)).cast("int")).alias("mismatched"))


@query("src9_incomplete_sources", f"""WITH {V.RESP}, c AS (SELECT source, count(*) AS n FROM resp GROUP BY source)
SELECT source, n, b AS n_baseline FROM c CROSS JOIN (SELECT n AS b FROM c WHERE source = 'baseline') WHERE source <> 'baseline' AND n < b""")
def src9(spark, sf_dir):
    return G.incomplete_sources(V.responses(spark, sf_dir), V.BASELINE)


_CHI = """chi AS (SELECT {keys}, sum(d * d / e) AS chi2, min(e) AS min_expected, max(t) AS n_total FROM (
  SELECT {keys}, o - rs * cs / CAST(t AS DOUBLE) AS d, rs * cs / CAST(t AS DOUBLE) AS e, t FROM (
    SELECT *, sum(o) OVER (PARTITION BY {keys}, side) AS rs, sum(o) OVER (PARTITION BY {keys}, level) AS cs, sum(o) OVER (PARTITION BY {keys}) AS t FROM tab)) GROUP BY {keys})"""


@query("sta14_chi_square_vs_baseline", f"""WITH {V.RESP}, lv AS (SELECT source, y AS level, count(*) AS o FROM resp WHERE y IS NOT NULL GROUP BY 1, 2),
tab AS (SELECT source, level, o, 'c' AS side FROM lv WHERE source <> 'baseline' UNION ALL
  SELECT s.source, l.level, l.o, 'b' FROM lv l CROSS JOIN (SELECT DISTINCT source FROM lv WHERE source <> 'baseline') s WHERE l.source = 'baseline'),
{_CHI.format(keys='source')}
SELECT source, {sq6('chi2')} AS chi2, {sq6('sqrt(chi2 / n_total)')} AS cramers_v, {sq6('min_expected')} AS min_expected, {sq6('exp(-chi2 / 2) * (1 + chi2 / 2)')} AS p FROM chi""")
def sta14(spark, sf_dir):
    counts = V.responses(spark, sf_dir).groupBy(F.lit("all").alias("scope"), "source").agg(
        *D.level_counts(_C("y"), S.LIKERT))
    names = [c for c in counts.columns if c.startswith("n_")]
    out = H.chi_square(H.versus_baseline(counts, ["scope"], V.BASELINE), [f"{c}_b" for c in names], names)
    return out.select("source", *[r6(_C(c)).alias(c) for c in ("chi2", "cramers_v", "min_expected", "p")])


@query("met7_cramers_v_quality_toxic", """WITH tab AS (SELECT 'all' AS k, toxic AS side, quality AS level, count(*) AS o FROM labels GROUP BY 2, 3),
""" + _CHI.format(keys="k") + f""" SELECT {sq6('chi2')} AS chi2, {sq6('sqrt(chi2 / n_total)')} AS cramers_v FROM chi""")
def met7(spark, sf_dir):
    t, q = _C("toxic"), _C("quality")
    wide = V.table(spark, sf_dir, "labels").agg(*[
        F.sum(((t == a) & (q == b)).cast("int")).alias(f"c{a}{b}") for a in (0, 1) for b in (0, 1)])
    out = H.chi_square(wide, ["c00", "c01"], ["c10", "c11"])
    return out.select(r6(_C("chi2")).alias("chi2"), r6(_C("cramers_v")).alias("cramers_v"))


# Rank sums of `v` over levels `g` within `k`: average ranks, tie term and U statistics.
def _ranks_sql(source: str) -> str:
    return f"""rk AS (SELECT *, rank() OVER (PARTITION BY k ORDER BY v) + (count(*) OVER (PARTITION BY k, v) - 1) / 2e0 AS r FROM ({source})),
tie AS (SELECT k, sum(t * t * t - t) AS ties, sum(t) AS nn FROM (SELECT k, v, CAST(count(*) AS DOUBLE) AS t FROM rk GROUP BY 1, 2) GROUP BY k)"""


def _normal_sf_sql(z: str) -> str:
    """Upper tail of the normal distribution: half minus the density times sum of z^(2k+1) / (2k+1)!!, all terms positive."""
    a = f"abs({z})"
    terms = f"lambda k: exp((2 * k + 1) * ln({a}) - lgamma(2 * k + 2) + k * ln(2e0) + lgamma(k + 1) - {a} * {a} / 2)"
    half = f"list_sum(list_transform(range(0, 200), {terms})) / sqrt(2 * pi())"
    return f"(CASE WHEN {z} = 0 THEN 0.5e0 WHEN {a} > 8 THEN CASE WHEN {z} > 0 THEN 0e0 ELSE 1e0 END ELSE 0.5e0 - sign({z}) * {half} END)"


# Two-sided p of U with ties and continuity.
_U_P = """zz AS (SELECT k, (greatest(u, n_first * n_second - u) - n_first * n_second / 2e0 - 0.5) / sqrt(n_first * n_second / 12e0 * (nn + 1 - ties / (nn * (nn - 1)))) AS z
  FROM us JOIN tie USING (k)), up AS (SELECT k, least(1e0, 2 * {tail}) AS p FROM zz)""".format(tail=_normal_sf_sql("z"))
_U = """us AS (SELECT k, count(CASE WHEN g = 1 THEN 1 END) AS n_first, count(CASE WHEN g = -1 THEN 1 END) AS n_second,
  sum(CASE WHEN g = 1 THEN r END) - count(CASE WHEN g = 1 THEN 1 END) * (count(CASE WHEN g = 1 THEN 1 END) + 1) / 2e0 AS u FROM rk GROUP BY k)"""


@query("sta16_mann_whitney_by_item", f"""WITH {V.PANEL}, {_ranks_sql("SELECT item AS k, polarity AS g, init AS v FROM panel WHERE src = 1")}, {_U}
SELECT k AS item, n_first, n_second, u, n_first * n_second / 2e0 AS u_null FROM us""")
def sta16(spark, sf_dir):
    base = V.panel(spark, sf_dir).where("src = 1").withColumn("pol", _C("polarity").cast("string"))
    return H.mann_whitney(base, ["item"], "pol", "1", "-1", _C("init")).drop("p")


@query("sta16_mann_whitney_p_value", f"""WITH {V.PANEL}, {_ranks_sql("SELECT item AS k, polarity AS g, init AS v FROM panel WHERE src = 1")}, {_U}, {_U_P}
SELECT k AS item, {sq6('p')} AS p FROM up""")
def sta16p(spark, sf_dir):
    base = V.panel(spark, sf_dir).where("src = 1").withColumn("pol", _C("polarity").cast("string"))
    return H.mann_whitney(base, ["item"], "pol", "1", "-1", _C("init")).select("item", r6(_C("p")).alias("p"))


def _framing(spark, sf_dir):
    base = V.panel(spark, sf_dir).where("src = 1").withColumn("pol", _C("polarity").cast("string"))
    pro, anti = _C("polarity") == 1, _C("polarity") == -1
    table = base.groupBy("item").agg(
        *D.level_counts(F.when(pro, _C("init")), S.LIKERT, "pro_"), *D.level_counts(F.when(anti, _C("init")), S.LIKERT, "anti_"))
    a, b = [c for c in table.columns if c.startswith("pro_")], [c for c in table.columns if c.startswith("anti_")]
    chi = H.chi_square(table, a, b).select("item", "chi2", "dof", "min_expected", _C("p").alias("chi2_p"))
    u = H.mann_whitney(base, ["item"], "pol", "1", "-1", _C("init")).withColumnRenamed("p", "u_p")
    out = H.bonferroni(chi.join(u, "item").withColumn("family", F.lit(1)), ["family"], "chi2_p", "chi2_p_bonf")
    return H.bonferroni(out, ["family"], "u_p", "u_p_bonf").drop("family")


@query("sta15_framing_tests", f"""WITH {V.PANEL}, {_ranks_sql("SELECT item AS k, polarity AS g, init AS v FROM panel WHERE src = 1")}, {_U},
tab AS (SELECT item, polarity AS side, init AS level, count(*) AS o FROM panel WHERE src = 1 GROUP BY 1, 2, 3), {_CHI.format(keys='item')},
f AS (SELECT *, exp(-chi2 / 2) * (1 + chi2 / 2) AS p FROM chi)
SELECT f.item, {sq6('chi2')} AS chi2, {sq6('min_expected')} AS min_expected, {sq6('p')} AS chi2_p, {sq6('least(p * count(*) OVER (), 1)')} AS chi2_p_bonf,
  n_first, n_second, u, n_first * n_second / 2e0 AS u_null FROM f JOIN us ON us.k = f.item""")
def sta15(spark, sf_dir):
    return _framing(spark, sf_dir).select(
        "item", *[r6(_C(c)).alias(c) for c in ("chi2", "min_expected", "chi2_p", "chi2_p_bonf")],
        "n_first", "n_second", "u", "u_null")


@query("sta15_framing_adjusted_u", f"""WITH {V.PANEL}, {_ranks_sql("SELECT item AS k, polarity AS g, init AS v FROM panel WHERE src = 1")}, {_U}, {_U_P}
SELECT k AS item, {sq6('p')} AS u_p, {sq6('least(p * count(*) OVER (), 1)')} AS u_p_bonf FROM up""")
def sta15p(spark, sf_dir):
    return _framing(spark, sf_dir).select("item", r6(_C("u_p")).alias("u_p"), r6(_C("u_p_bonf")).alias("u_p_bonf"))


@query("sta17_framing_on_change", f"""WITH {V.PAIRED}, {_ranks_sql("SELECT source || '/' || item AS k, polarity AS g, y - init AS v FROM paired")}, {_U},
m AS (SELECT source || '/' || item AS k, avg(CASE WHEN polarity = 1 THEN y - init END) AS mp, avg(CASE WHEN polarity = -1 THEN y - init END) AS ma FROM paired GROUP BY 1)
SELECT split_part(us.k, '/', 1) AS source, split_part(us.k, '/', 2) AS item, n_first, n_second, u, n_first * n_second / 2e0 AS u_null, {sq6('mp - ma')} AS diff
FROM us JOIN m ON m.k = us.k""")
def sta17(spark, sf_dir):
    paired = V.paired(spark, sf_dir).withColumns({"pol": _C("polarity").cast("string"), "d": _delta()})
    u = H.mann_whitney(paired, ["source", "item"], "pol", "1", "-1", _C("d")).drop("p")
    means = paired.groupBy("source", "item").agg(
        r6(F.avg(F.when(_C("polarity") == 1, _C("d"))) - F.avg(F.when(_C("polarity") == -1, _C("d")))).alias("diff"))
    return u.join(means, ["source", "item"])


@query("sta17_framing_on_change_p", f"""WITH {V.PAIRED}, {_ranks_sql("SELECT source || '/' || item AS k, polarity AS g, y - init AS v FROM paired")}, {_U}, {_U_P}
SELECT split_part(k, '/', 1) AS source, split_part(k, '/', 2) AS item, {sq6('p')} AS p, {sq6("least(p * count(*) OVER (PARTITION BY split_part(k, '/', 1)), 1)")} AS p_bonf FROM up""")
def sta17p(spark, sf_dir):
    paired = V.paired(spark, sf_dir).withColumns({"pol": _C("polarity").cast("string"), "d": _delta()})
    u = H.mann_whitney(paired, ["source", "item"], "pol", "1", "-1", _C("d"))
    return H.bonferroni(u, ["source"]).select("source", "item", r6(_C("p")).alias("p"), r6(_C("p_bonf")).alias("p_bonf"))


def traits(spark, sf_dir):
    from paneloom.functions import scalars as N

    scores = N.trait_scores(item_columns(), S.TRAIT_KEYS)
    return V.table(spark, sf_dir, "customer").select(
        _C("c_custkey").alias("subject"), (_C("c_custkey") % 70 + 18).alias("age"),
        *[c.alias(t) for t, c in scores.items()])


def predictor_rows(spark, sf_dir):
    """(source, predictor, x, d): the predictors of each answer, unpivoted."""
    panel = V.panel(spark, sf_dir).select("subject", "source", "init", _delta().alias("d"))
    joined = panel.join(traits(spark, sf_dir), "subject")
    return joined.select("source", "d", *[_C(t) for t in S.TRAITS], _C("age").cast("double").alias("age"),
                         _C("init").cast("double").alias("initial_belief")).unpivot(
        ["source", "d"], [*S.TRAITS, "age", "initial_belief"], "predictor", "x")


_SQL_PREDICTORS = f"""tr AS ({SQL_TRAITS}), pr AS (SELECT p.source, p.y - p.init AS d, tr.*, p.init AS initial_belief, CAST(p.subject % 70 + 18 AS DOUBLE) AS age
  FROM panel p JOIN tr ON tr.subject = p.subject WHERE p.y IS NOT NULL),
lp AS ({' UNION ALL '.join(f"SELECT source, '{t}' AS predictor, CAST({t} AS DOUBLE) AS x, d FROM pr" for t in [*S.TRAITS, 'age', 'initial_belief'])}),
rr AS (SELECT source, predictor, rank() OVER (PARTITION BY source, predictor ORDER BY x) + (count(*) OVER (PARTITION BY source, predictor, x) - 1) / 2e0 AS rx,
  rank() OVER (PARTITION BY source, predictor ORDER BY d) + (count(*) OVER (PARTITION BY source, predictor, d) - 1) / 2e0 AS ry FROM lp)"""


@query("sta10_spearman", f"""WITH {V.PANEL}, {_SQL_PREDICTORS} SELECT source, predictor, {sq6('corr(rx, ry)')} AS rho, count(*) AS n FROM rr GROUP BY source, predictor""")
def sta10(spark, sf_dir):
    out = H.spearman(predictor_rows(spark, sf_dir), ["source", "predictor"], _C("x"), _C("d"))
    return out.select("source", "predictor", r6(_C("rho")).alias("rho"), "n")


@query("sta10_spearman_open_domain", f"""WITH r AS (SELECT c_mktsegment AS segment, rank() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal) + (count(*) OVER (PARTITION BY c_mktsegment, c_acctbal) - 1) / 2e0 AS rx,
  rank() OVER (PARTITION BY c_mktsegment ORDER BY c_nationkey) + (count(*) OVER (PARTITION BY c_mktsegment, c_nationkey) - 1) / 2e0 AS ry FROM customer)
SELECT segment, {sq6('corr(rx, ry)')} AS rho, count(*) AS n FROM r GROUP BY segment""")
def sta10_open(spark, sf_dir):
    people = V.table(spark, sf_dir, "customer").withColumnRenamed("c_mktsegment", "segment")
    out = H.spearman(people, ["segment"], _C("c_acctbal"), _C("c_nationkey"), open_domain=True)
    return out.select("segment", r6(_C("rho")).alias("rho"), "n")


@query("sta11_pearson", f"""WITH {V.PAIRED} SELECT source, count(*) AS n, {sq6('corr(h, y)')} AS r FROM paired GROUP BY source""")
def sta11(spark, sf_dir):
    return H.pearson(V.paired(spark, sf_dir), ["source"], _C("h"), _C("y")).select("source", "n", r6(_C("r")).alias("r"))


@query("sta11_pearson_p_value")
def sta11p(spark, sf_dir):
    return H.pearson(V.paired(spark, sf_dir), ["source"], _C("h"), _C("y")).select("source", r6(_C("p")).alias("p"))


@query("sta13_correlation_grid", f"""WITH {V.PANEL}, {_SQL_PREDICTORS} SELECT source, predictor, {sq6('corr(rx, ry)')} AS rho, {sq6('corr(rx, ry) * corr(rx, ry)')} AS rho2 FROM rr GROUP BY 1, 2""")
def sta13(spark, sf_dir):
    out = H.spearman(predictor_rows(spark, sf_dir), ["source", "predictor"], _C("x"), _C("d"))
    return out.select("source", "predictor", r6(_C("rho")).alias("rho"), r6(_C("rho") * _C("rho")).alias("rho2"))


@query("sta13_correlation_grid_p")
def sta13p(spark, sf_dir):
    out = H.spearman(predictor_rows(spark, sf_dir), ["source", "predictor"], _C("x"), _C("d"))
    return H.bonferroni(out.withColumn("family", F.lit(1)), ["family"]).select(
        "source", "predictor", r6(_C("p")).alias("p"), r6(_C("p_bonf")).alias("p_bonf"))


@query("srt5_order_by_correlation", f"""WITH {V.PAIRED}, c AS (SELECT source, {sq6('corr(h, y)')} AS r FROM paired GROUP BY source)
SELECT source, r, row_number() OVER (ORDER BY r DESC, source) AS position FROM c""")
def srt5(spark, sf_dir):
    out = H.pearson(V.paired(spark, sf_dir), ["source"], _C("h"), _C("y")).select("source", r6(_C("r")).alias("r"))
    w = Window.partitionBy(F.lit(1)).orderBy(F.desc("r"), "source")
    return out.withColumn("position", F.row_number().over(w)).orderBy("position")


_SQL_KRUSKAL = f"""{V.PANEL}, sg AS (SELECT source AS k, c_mktsegment AS g, y - init AS v FROM panel JOIN customer ON c_custkey = subject WHERE y IS NOT NULL),
keep AS (SELECT k, g FROM sg GROUP BY 1, 2 HAVING count(*) >= 2), {_ranks_sql("SELECT sg.* FROM sg JOIN keep USING (k, g)")},
q AS (SELECT k, count(*) AS lv, sum(rs * rs / n) AS q FROM (SELECT k, g, sum(r) AS rs, count(*) AS n FROM rk GROUP BY 1, 2) GROUP BY k)"""


@query("sta12_kruskal_wallis", f"""WITH {_SQL_KRUSKAL}
SELECT q.k AS source, lv AS k, CAST(nn AS BIGINT) AS n, {sq6('(12 / (nn * (nn + 1)) * q - 3 * (nn + 1)) / (1 - ties / (nn * nn * nn - nn))')} AS h,
  {sq6('(12 / (nn * (nn + 1)) * q - 3 * (nn + 1)) / (1 - ties / (nn * nn * nn - nn)) / (nn - 1)')} AS effect FROM q JOIN tie USING (k)""")
def sta12(spark, sf_dir):
    return _kruskal(spark, sf_dir).select("source", "k", "n", r6(_C("h")).alias("h"), r6(_C("effect")).alias("effect"))


def _kruskal(spark, sf_dir):
    people = V.table(spark, sf_dir, "customer").select(_C("c_custkey").alias("subject"), _C("c_mktsegment").alias("segment"))
    rows = V.panel(spark, sf_dir).select("subject", "source", _delta().alias("d")).join(people, "subject")
    return H.kruskal(rows, ["source"], "segment", _C("d"))


@query("sta12_kruskal_wallis_p", f"""WITH {_SQL_KRUSKAL}, hh AS (
  SELECT q.k, (12 / (nn * (nn + 1)) * q - 3 * (nn + 1)) / (1 - ties / (nn * nn * nn - nn)) AS h FROM q JOIN tie USING (k) WHERE lv = 5)
SELECT k AS source, {sq6('exp(-h / 2) * (1 + h / 2)')} AS p FROM hh""")
def sta12p(spark, sf_dir):
    return _kruskal(spark, sf_dir).select("source", r6(_C("p")).alias("p"))


_BF = """md AS (SELECT k, source, median(v) AS med FROM bv GROUP BY 1, 2),
dv AS (SELECT bv.k, bv.source, abs(bv.v - md.med) AS z, bv.v FROM bv JOIN md USING (k, source)),
st AS (SELECT k, source, count(*) AS n, avg(z) AS zm, sum(z * z) - sum(z) * sum(z) / count(*) AS ssw, stddev_samp(v) AS sd FROM dv GROUP BY 1, 2),
bf AS (SELECT c.k, c.source, b.n AS n_base, c.n, b.sd AS sd_base, c.sd, (b.n + c.n - 2)
  * (b.n * pow(b.zm - (b.n * b.zm + c.n * c.zm) / (b.n + c.n), 2) + c.n * pow(c.zm - (b.n * b.zm + c.n * c.zm) / (b.n + c.n), 2)) / (b.ssw + c.ssw) AS w
  FROM st c JOIN st b ON b.k = c.k AND b.source = 'baseline' WHERE c.source <> 'baseline')"""


@query("sta18_brown_forsythe_change", f"""WITH {V.PANEL}, bv AS (SELECT item AS k, source, abs(y - init) AS v FROM panel WHERE y IS NOT NULL), {_BF}
SELECT k AS item, source, n_base, n, {sq6('sd_base')} AS sd_base, {sq6('sd')} AS sd, {sq6('w')} AS w FROM bf""")
def sta18(spark, sf_dir):
    out = H.brown_forsythe(V.panel(spark, sf_dir), ["item"], F.abs(_delta()), V.BASELINE)
    return out.select("item", "source", "n_base", "n", *[r6(_C(c)).alias(c) for c in ("sd_base", "sd", "w")])


@query("sta18_brown_forsythe_change_p")
def sta18p(spark, sf_dir):
    out = H.brown_forsythe(V.panel(spark, sf_dir), ["item"], F.abs(_delta()), V.BASELINE)
    return out.select("item", "source", r6(_C("p")).alias("p"))


@query("sta18_brown_forsythe_open_domain", f"""WITH bv AS (SELECT l_returnflag AS k, CASE WHEN l_linestatus = 'F' THEN 'baseline' ELSE l_linestatus END AS source, l_extendedprice AS v FROM lineitem), {_BF}
SELECT k AS flag, source, n, {sq6('w')} AS w FROM bf""")
def sta18_open(spark, sf_dir):
    """Spread of prices of open line items against closed ones; medians come from ranges of values."""
    rows = V.table(spark, sf_dir, "lineitem").select(
        _C("l_returnflag").alias("flag"), F.when(_C("l_linestatus") == "F", "baseline").otherwise(_C("l_linestatus")).alias("source"),
        _C("l_extendedprice").alias("v"))
    out = H.brown_forsythe(rows, ["flag"], _C("v"), "baseline", open_domain=True)
    return out.select("flag", "source", "n", r6(_C("w")).alias("w"))


@query("sta19_brown_forsythe_mean_ranks", f"""WITH {_MEAN_RANKS}, sh AS (SELECT item, cell, message FROM mr GROUP BY 1, 2, 3 HAVING count(*) = 7),
bv AS (SELECT 'all' AS k, source, mean_rank AS v FROM mr JOIN sh USING (item, cell, message)), {_BF}
SELECT source, n, {sq6('sd_base')} AS sd_base, {sq6('sd')} AS sd, {sq6('(sd / sd_base) * (sd / sd_base)')} AS variance_ratio, {sq6('w')} AS w FROM bf""")
def sta19(spark, sf_dir):
    means = mean_rank_table(spark, sf_dir)
    everyone = F.count("*").over(Window.partitionBy("item", "cell", "message"))
    shared = means.withColumns({"m": everyone, "scope": F.lit("all")}).where("m = 7")
    out = H.brown_forsythe(shared, ["scope"], _C("mean_rank"), V.BASELINE)
    ratio = _C("sd") / _C("sd_base")
    return out.select("source", "n", r6(_C("sd_base")).alias("sd_base"), r6(_C("sd")).alias("sd"),
                      r6(ratio * ratio).alias("variance_ratio"), r6(_C("w")).alias("w"))


_TAU = f"""{RANK_MATCH}, tau AS (SELECT *, ((CASE WHEN (hb[1]-hb[2])*(mc[1]-mc[2])>0 THEN 1 ELSE -1 END)
  + (CASE WHEN (hb[1]-hb[3])*(mc[1]-mc[3])>0 THEN 1 ELSE -1 END) + (CASE WHEN (hb[2]-hb[3])*(mc[2]-mc[3])>0 THEN 1 ELSE -1 END)) / 3e0 AS tau
  FROM rank_match WHERE reason IS NULL)"""


def _tau_rows(spark, sf_dir):
    kept = _rank_match(spark, sf_dir).where(_C("reason").isNull())
    return kept.withColumn("tau", R.kendall_tau(_C("hb"), _C("mc")))


@query("sta20_kendall_tau", f"""WITH {_TAU} SELECT source, count(*) AS n, {sq6('avg(tau)')} AS mean, {sq6('stddev_samp(tau)')} AS sd, {sq6('stddev_samp(tau) / sqrt(count(*))')} AS se,
{sq6('avg(tau) - 1.96 * stddev_samp(tau) / sqrt(count(*))')} AS ci_low, {sq6('avg(tau) + 1.96 * stddev_samp(tau) / sqrt(count(*))')} AS ci_high FROM tau GROUP BY source""")
def sta20(spark, sf_dir):
    out = H.tau_summary(_tau_rows(spark, sf_dir), ["source"], _C("tau"))
    return out.select("source", "n", *[r6(_C(c)).alias(c) for c in ("mean", "sd", "se", "ci_low", "ci_high")])


@query("sta21_tau_distribution", f"""WITH {_TAU} SELECT source, round(tau, 4) AS tau, count(*) AS n FROM tau GROUP BY 1, 2""")
def sta21(spark, sf_dir):
    return _tau_rows(spark, sf_dir).groupBy("source", F.round("tau", 4).alias("tau")).agg(F.count("*").alias("n"))


@query("sta21_tau_by_item", f"""WITH {_TAU} SELECT source, {', '.join(f"{sq6(f'avg(CASE WHEN item = {chr(39)}{i}{chr(39)} THEN tau END)')} AS {chr(34)}{i}{chr(34)}" for i in V.ITEMS)} FROM tau GROUP BY source""")
def sta21b(spark, sf_dir):
    return _tau_rows(spark, sf_dir).groupBy("source").pivot("item", V.ITEMS).agg(r6(F.avg("tau")))


def _half_errors(spark, sf_dir):
    # A short table (messages x sources x halves) that the tests below read several times.
    return materialise(_half_error_rows(spark, sf_dir), "halves")


def _half_error_rows(spark, sf_dir):
    """Per message: absolute error of each predictor against the baseline's other half."""
    from paneloom.plans.queries_scalar import counted_pairs

    half = F.when(F.substring(F.md5(F.concat_ws("|", F.lit("half"), "subject")), 1, 1) < "8", "a").otherwise("b")
    group = ["half", "item", "cell", "source"]
    means = D.mean_ranks(counted_pairs(V.responses(spark, sf_dir).withColumn("half", half), group), group, _C("pairs"), _C("n"))
    base = _C("source") == V.BASELINE
    target = means.where(base & (_C("half") == "b")).select("item", "cell", "message", _C("mean_rank").alias("target"))
    predictors = means.where((base & (_C("half") == "a")) | (~base & (_C("half") == "b")))
    return predictors.join(target, ["item", "cell", "message"]).select(
        "source", "item", "cell", "message", "mean_rank", "target", F.abs(_C("mean_rank") - _C("target")).alias("err"))


_SQL_HALF = V.RESP + """,
tr3 AS (SELECT *, [r1, r2, r3] AS t, CASE WHEN substr(md5('half|' || subject), 1, 1) < '8' THEN 'a' ELSE 'b' END AS half FROM resp WHERE list_sort([r1, r2, r3]) = [1, 2, 3]),
ms AS (SELECT half, item, cell, source, CAST(substr(['123', '132', '213', '231', '312', '321'][order_seen + 1], slot, 1) AS INT) AS message,
  CAST(CASE WHEN src = 1 THEN t[slot] ELSE list_position(t, slot) END AS INT) AS rank FROM tr3 CROSS JOIN (SELECT unnest([1, 2, 3]) AS slot)),
hm AS (SELECT half, item, cell, source, message, avg(rank) AS mean_rank FROM ms GROUP BY ALL),
he AS (SELECT p.source, p.item, p.cell, p.message, p.mean_rank, t.mean_rank AS target, abs(p.mean_rank - t.mean_rank) AS err FROM hm p JOIN hm t USING (item, cell, message)
  WHERE t.source = 'baseline' AND t.half = 'b' AND ((p.source = 'baseline' AND p.half = 'a') OR (p.source <> 'baseline' AND p.half = 'b')))"""


@query("met9_split_half_reliability", f"""WITH {_SQL_HALF}, hr AS (SELECT *, rank() OVER (PARTITION BY source ORDER BY round(mean_rank, 9)) + (count(*) OVER (PARTITION BY source, round(mean_rank, 9)) - 1) / 2e0 AS ra,
  rank() OVER (PARTITION BY source ORDER BY round(target, 9)) + (count(*) OVER (PARTITION BY source, round(target, 9)) - 1) / 2e0 AS rb FROM he)
SELECT source, count(*) AS n, {sq6('avg(err)')} AS mae, {sq6('corr(mean_rank, target)')} AS r, {sq6('corr(ra, rb)')} AS rho FROM hr GROUP BY source""")
def met9(spark, sf_dir):
    e = _half_errors(spark, sf_dir)
    mae = e.groupBy("source").agg(F.count("*").alias("n"), r6(F.avg("err")).alias("mae"))
    r = H.pearson(e, ["source"], _C("mean_rank"), _C("target")).select("source", r6(_C("r")).alias("r"))
    rho = H.spearman(e, ["source"], F.round("mean_rank", 9), F.round("target", 9)).select("source", r6(_C("rho")).alias("rho"))
    return mae.join(r, "source").join(rho, "source")


def _err_diffs(spark, sf_dir):
    e = _half_errors(spark, sf_dir)
    base = e.where(_C("source") == V.BASELINE).select("item", "cell", "message", _C("err").alias("e0"))
    return e.where(_C("source") != V.BASELINE).join(base, ["item", "cell", "message"]).select(
        "source", F.round(_C("e0") - _C("err"), 9).alias("d"))


_SQL_DIFF = f"""{_SQL_HALF}, ed AS (SELECT m.source AS k, round(b.err - m.err, 9) AS d FROM he m JOIN he b USING (item, cell, message) WHERE b.source = 'baseline' AND m.source <> 'baseline')"""


@query("sta22_wilcoxon_signed_rank", f"""WITH {_SQL_DIFF}, {_ranks_sql("SELECT k, d, abs(d) AS v FROM ed WHERE d <> 0")}
SELECT k AS source, count(*) AS n, {sq6('sum(CASE WHEN d > 0 THEN r ELSE 0 END)')} AS w_plus FROM rk GROUP BY k""")
def sta22(spark, sf_dir):
    return H.wilcoxon_less(_err_diffs(spark, sf_dir), ["source"], _C("d")).select("source", "n", r6(_C("w_plus")).alias("w_plus"))


@query("sta22_wilcoxon_p_value", f"""WITH {_SQL_DIFF}, {_ranks_sql("SELECT k, d, abs(d) AS v FROM ed WHERE d <> 0")},
ws AS (SELECT k, CAST(count(*) AS DOUBLE) AS n, sum(CASE WHEN d > 0 THEN r ELSE 0 END) AS w FROM rk GROUP BY k),
zz AS (SELECT k, -(w - n * (n + 1) / 4) / sqrt(n * (n + 1) * (2 * n + 1) / 24 - ties / 48) AS z FROM ws JOIN tie USING (k))
SELECT k AS source, {sq6(_normal_sf_sql('z'))} AS p FROM zz""")
def sta22p(spark, sf_dir):
    return H.wilcoxon_less(_err_diffs(spark, sf_dir), ["source"], _C("d")).select("source", r6(_C("p")).alias("p"))


@query("sta23_paired_t", f"""WITH {_SQL_DIFF} SELECT k AS source, count(*) AS n, {sq6('avg(d) / (stddev_samp(d) / sqrt(count(*)))')} AS t FROM ed GROUP BY k""")
def sta23(spark, sf_dir):
    return H.paired_t_less(_err_diffs(spark, sf_dir), ["source"], _C("d")).select("source", "n", r6(_C("t")).alias("t"))


@query("sta23_paired_t_p_value")
def sta23p(spark, sf_dir):
    return H.paired_t_less(_err_diffs(spark, sf_dir), ["source"], _C("d")).select("source", r6(_C("p")).alias("p"))


_SQL_P = f"""{V.PAIRED}, ps AS (SELECT item, source, {sq6('exp(-abs(sum(h - y)) / 50e0)')} AS p FROM paired GROUP BY 1, 2)"""


def _some_p(spark, sf_dir):
    return V.paired(spark, sf_dir).groupBy("item", "source").agg(
        r6(F.exp(-F.abs(F.sum(_C("h") - _C("y"))) / 50.0)).alias("p"))


@query("sta24_bonferroni", f"WITH {_SQL_P} SELECT item, source, p, {sq6('least(p * count(*) OVER (PARTITION BY item), 1)')} AS p_bonf FROM ps")
def sta24(spark, sf_dir):
    return H.bonferroni(_some_p(spark, sf_dir), ["item"]).withColumn("p_bonf", r6(_C("p_bonf")))


@query("sta25_holm", f"""WITH {_SQL_P}, o AS (SELECT *, (count(*) OVER (PARTITION BY item) - row_number() OVER (PARTITION BY item ORDER BY p, source) + 1) * p AS s FROM ps)
SELECT item, source, p, {sq6('least(1, max(s) OVER (PARTITION BY item ORDER BY p, source ROWS UNBOUNDED PRECEDING))')} AS p_holm FROM o""")
def sta25(spark, sf_dir):
    return H.holm(_some_p(spark, sf_dir), ["item"]).withColumn("p_holm", r6(_C("p_holm")))
