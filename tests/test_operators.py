"""Operators on small fixtures: invariants, brute force and published numbers."""

import math
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from paneloom.operators import conform as C
from paneloom.operators import describe as D
from paneloom.operators import distance as M
from paneloom.operators import health as G
from paneloom.operators import hypothesis as H
from paneloom.operators import ordering as O
from paneloom.operators import pairing as P
from paneloom.operators import power as W
from paneloom.operators import privacy as X
from paneloom.operators import regress as L
from paneloom.operators import resample as B
from paneloom.plans import tables as V
from paneloom.sources import readers as I

LEVELS = [-2, -1, 0, 1, 2]


@pytest.fixture(scope="module")
def ranking(spark):
    """60 subjects x 3 items; three sources off by 0, 1 and 2."""
    rows = []
    for i in range(60):
        for t in range(3):
            init = (i + t) % 5 - 2
            y = max(-2, min(2, init + (i * 7 + t * 3) % 3 - 1))
            rows.append((f"p{i}", f"t{t}", "package1", init, y, y, y + 1, y + 2))
    return spark.createDataFrame(
        rows, "subject string, item string, cell string, init int, h int, perfect int, off1 int, off2 int").cache()


SOURCES = ["perfect", "off1", "off2"]


def long(wide):
    return P.long_cases(wide, SOURCES, ["subject", "item", "cell", "h", "init"])


def by_source(df):
    return {r.source: r for r in df.collect()}


def test_metrics_of_shifted_sources(ranking):
    got = by_source(M.all_metrics(long(ranking), ["source"]))
    assert [round(got[s].mae, 9) for s in SOURCES] == [0, 1, 2]
    assert [round(got[s].bias, 9) for s in SOURCES] == [0, -1, -2]
    assert [round(got[s].wasserstein, 9) for s in SOURCES] == [0, 1, 2]
    assert got["perfect"].spread == 0


def test_weight_two_equals_duplication(ranking):
    twice = by_source(M.all_metrics(long(ranking.unionByName(ranking.where("subject < 'p3'"))), ["source"]))
    w = F.when(F.col("subject") < "p3", 2).otherwise(1)
    weighted = by_source(M.all_metrics(long(ranking), ["source"], w))
    for s in SOURCES:
        for m in ("mae", "wasserstein", "spread"):
            assert weighted[s][m] == pytest.approx(twice[s][m], abs=1e-12)


def test_leave_one_out_median_against_brute_force(spark, ranking):
    table = {(r.item, r.init, r.h): r.loo for r in O.leave_one_out_median(ranking, ["item", "init"], "h", LEVELS).collect()}
    cells = {}
    for r in ranking.collect():
        cells.setdefault((r.item, r.init), []).append(r.h)
    for (item, init), values in cells.items():
        for k, v in enumerate(values):
            assert table[(item, init, v)] == statistics.median(values[:k] + values[k + 1:])
    single = spark.createDataFrame([("a", 0, 1)], "item string, init int, h int")
    with pytest.raises(Exception, match="single case"):
        O.leave_one_out_median(single, ["item", "init"], "h", LEVELS).collect()


def test_open_domain_ranks_against_brute_force(spark):
    rng = np.random.default_rng(3)
    values = np.concatenate([rng.lognormal(0, 4, 3000), np.repeat(rng.lognormal(0, 1, 20), 5), [1e-300, 1e12]])
    df = spark.createDataFrame([("g", float(v)) for v in values], "g string, v double")
    got = {r.v: r.avg_rank for r in O.average_ranks(df, ["g"], F.col("v"), open_domain=True).collect()}
    ordered = np.sort(values)
    for v in values:
        low, high = np.searchsorted(ordered, v, "left"), np.searchsorted(ordered, v, "right")
        assert got[float(v)] == (low + 1 + high) / 2


def test_sign_flip_of_equal_samples(ranking):
    diffs = F.array(F.struct(F.lit("same").alias("label"), (F.col("h") - F.col("perfect")).alias("d")),
                    F.struct(F.lit("off").alias("label"), (F.col("h") - F.col("off1")).alias("d")))
    got = {r.label: r for r in B.sign_flip(ranking, ["item"], ["subject", "item"], diffs, [[], ["item"]], 200).where("item = 'all'").collect()}
    assert got["same"].mean_diff == 0 and got["same"].p == 1.0 and not got["same"].reject
    assert got["off"].mean_diff == -1 and got["off"].p == 0.0 and got["off"].reject and got["off"].n == 180


def test_draws_do_not_depend_on_the_ranges_of_blocks(ranking, monkeypatch):
    diffs = F.array(F.struct(F.lit("x").alias("label"), (F.col("h") - F.col("init")).alias("d")))
    first = sorted(map(tuple, B.replicate_sums(ranking, ["item"], ["subject", "item"], diffs, 300, 5).collect()))
    monkeypatch.setattr(B, "BLOCKS_AT_ONCE", 2)
    again = sorted(map(tuple, B.replicate_sums(ranking, ["item"], ["subject", "item"], diffs, 300, 5).collect()))
    assert first == again and len(first) == 3 * 300


def test_sign_flip_p_is_near_the_exact_one(spark):
    d = [1, 2, -1, 3, 1, 1, 2, -2, 1, 2]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(d)], "subject int, d int")
    diffs = F.array(F.struct(F.lit("x").alias("label"), F.col("d").alias("d")))
    got = B.sign_flip(df, [], ["subject"], diffs, [[]], 4000, 1).collect()[0]
    sums = [sum(v if k >> i & 1 else -v for i, v in enumerate(d)) for k in range(1024)]
    exact = sum(abs(s) >= abs(sum(d)) for s in sums) / 1024
    assert got.p == pytest.approx(exact, abs=0.03)


def test_cluster_flip_and_omnibus(ranking):
    errors = B.subject_errors(ranking, "subject", SOURCES).cache()
    got = {(r.a, r.b): r for r in B.cluster_sign_flip(errors, "subject", SOURCES, 100, 3).collect()}
    assert got[("perfect", "off1")]["diff"] == pytest.approx(-1)
    assert got[("off1", "off2")]["p"] == pytest.approx(1 / 101)
    flat = errors.select("subject", "m", *[F.col("off1").alias(s) for s in SOURCES])
    assert B.omnibus(errors, "subject", SOURCES, 60, 3).collect()[0].p == pytest.approx(1 / 61)
    assert B.omnibus(flat, "subject", SOURCES, 60, 3).collect()[0].p == 1.0


def test_bootstrap_weights_add_up(ranking):
    subjects = ranking.select("subject").distinct()
    totals = B.bootstrap_weights(subjects, "subject", 20, 1).groupBy("rep").agg(F.sum("w").alias("w")).collect()
    assert len(totals) == 20 and {r.w for r in totals} == {60}
    mean = B.poisson_weights(subjects, "subject", 200, 1).agg(F.sum("w") / (200 * 60)).collect()[0][0]
    assert mean == pytest.approx(1.0, abs=0.03)
    numbers = sorted(r.idx for r in B.numbered(subjects, "subject").collect())
    assert numbers == list(range(60))


def test_rank_summary_orders_sources(ranking):
    cases = long(ranking)
    reps = B.bootstrap_metrics(cases, "subject", 20, 1)
    got = by_source(B.rank_summary(M.error_metrics(cases, ["source"]), reps, "mae", SOURCES))
    assert [got[s].place for s in SOURCES] == [1, 2, 3]
    assert [got[s].p_best for s in SOURCES] == [1.0, 0.0, 0.0]




def _counts(spark, table):
    cols = "source string, n_m2 int, n_m1 int, n_0 int, n_p1 int, n_p2 int, scope string"
    return spark.createDataFrame([(k, *v, "all") for k, v in table.items()], cols)


def test_chi_square_by_hand(spark):
    a, b = [10, 20, 30, 25, 15], [20, 20, 20, 20, 20]
    df = _counts(spark, {"baseline": a, "x": b})
    names = ["n_m2", "n_m1", "n_0", "n_p1", "n_p2"]
    got = H.chi_square(H.versus_baseline(df, ["scope"], "baseline"), [f"{n}_b" for n in names], names).collect()[0]
    table = np.array([a, b], dtype=float)
    expected = table.sum(1, keepdims=True) * table.sum(0, keepdims=True) / table.sum()
    chi2 = ((table - expected) ** 2 / expected).sum()
    assert got.chi2 == pytest.approx(chi2) and got.cramers_v == pytest.approx(math.sqrt(chi2 / table.sum()))
    assert got.p == pytest.approx(math.exp(-chi2 / 2) * (1 + chi2 / 2)) and got.min_expected == expected.min()


def test_empty_level_stops_chi_square(spark):
    df = _counts(spark, {"baseline": [1, 2, 3, 4, 0], "x": [4, 3, 2, 1, 0]})
    names = ["n_m2", "n_m1", "n_0", "n_p1", "n_p2"]
    pairs = H.versus_baseline(df, ["scope"], "baseline")
    with pytest.raises(Exception, match="no rows on either side"):
        H.chi_square(pairs, [f"{n}_b" for n in names], names).collect()
    assert H.chi_square(pairs, [f"{n}_b" for n in names], names, strict=False).collect()[0].chi2 is None


def test_rank_tests_against_brute_force(spark):
    rng = np.random.default_rng(1)
    x, g = rng.integers(-2, 3, 80), rng.integers(0, 3, 80)
    df = spark.createDataFrame([("k", str(a), int(b)) for a, b in zip(g, x)], "grp string, g string, v int")
    ordered = np.sort(x)
    ranks = np.array([(np.searchsorted(ordered, v, "left") + 1 + np.searchsorted(ordered, v, "right")) / 2 for v in x])
    ties = sum(t ** 3 - t for t in np.unique(x, return_counts=True)[1])
    n = len(x)
    h = 12 / (n * (n + 1)) * sum(ranks[g == k].sum() ** 2 / (g == k).sum() for k in range(3)) - 3 * (n + 1)
    h /= 1 - ties / (n ** 3 - n)
    for open_domain in (False, True):
        got = H.kruskal(df, ["grp"], "g", F.col("v"), open_domain).collect()[0]
        assert got.h == pytest.approx(h) and got.effect == pytest.approx(h / (n - 1))
        assert got.p == pytest.approx(math.exp(-h / 2))
    u = sum((a > b) + (a == b) / 2 for a in x[g == 0] for b in x[g == 1])
    assert H.mann_whitney(df, ["grp"], "g", "0", "1", F.col("v")).collect()[0].u == pytest.approx(u)


def test_brown_forsythe_against_brute_force(spark):
    rng = np.random.default_rng(2)
    a, b = rng.integers(0, 5, 41), rng.integers(0, 3, 37)
    rows = [("all", "baseline", int(v)) for v in a] + [("all", "x", int(v)) for v in b]
    got = H.brown_forsythe(spark.createDataFrame(rows, "k string, source string, v int"), ["k"], F.col("v"), "baseline").collect()[0]
    za, zb = np.abs(a - np.median(a)), np.abs(b - np.median(b))
    z = np.concatenate([za, zb])
    w = (len(z) - 2) * (len(za) * (za.mean() - z.mean()) ** 2 + len(zb) * (zb.mean() - z.mean()) ** 2) / (
        ((za - za.mean()) ** 2).sum() + ((zb - zb.mean()) ** 2).sum())
    assert got.w == pytest.approx(w) and got.sd_base == pytest.approx(a.std(ddof=1))


def test_adjustments(spark):
    p = [0.01, 0.04, 0.03, 0.5]
    df = spark.createDataFrame([(1, f"s{i}", v) for i, v in enumerate(p)], "f int, source string, p double")
    assert [r.p_bonf for r in H.bonferroni(df, ["f"]).orderBy("source").collect()] == pytest.approx([0.04, 0.16, 0.12, 1.0])
    assert [r.p_holm for r in H.holm(df, ["f"]).orderBy("source").collect()] == pytest.approx([0.04, 0.09, 0.09, 0.5])


def test_detectable_effects_match_published_values(spark):
    got = W.detectable(spark.createDataFrame([(1173, 391)], "n_obs int, n_subjects int")).collect()[0]
    want = {"dz_nominal": 0.1018, "dz_independent": 0.1768, "v_nominal": 0.0858, "v_independent": 0.1486,
            "tau_nominal": 0.0649, "tau_independent": 0.1128}
    for name, value in want.items():
        assert round(got[name], 4) == pytest.approx(value, abs=1e-4), name


def test_icc_and_quartiles(spark):
    rows = [(f"p{i}", t, float((i * 3 + t) % 5)) for i in range(8) for t in range(3)]
    df = spark.createDataFrame([("s", *r) for r in rows], "source string, subject string, t int, v double")
    got = D.icc_one_way(df, ["source"], "subject", F.col("v")).collect()[0]
    v = np.array([r[2] for r in rows]).reshape(8, 3)
    ms_b = 3 * ((v.mean(1) - v.mean()) ** 2).sum() / 7
    ms_w = ((v - v.mean(1, keepdims=True)) ** 2).sum() / 16
    assert got.icc == pytest.approx((ms_b - ms_w) / (ms_b + 2 * ms_w))
    q = D.quartiles(df, ["source"], F.col("v")).collect()[0]
    assert [q.q1, q.median, q.q3] == pytest.approx(list(np.percentile(v, [25, 50, 75])))


def test_empty_levels_stay_in_histograms(spark):
    df = spark.createDataFrame([("a", 1), ("a", 1), ("a", None)], "g string, v int")
    got = {r.level: (r.n, r.share) for r in D.likert_histogram(df, ["g"], "v").collect()}
    assert got == {-2: (0, 0.0), -1: (0, 0.0), 0: (0, 0.0), 1: (2, 1.0), 2: (0, 0.0)}


def test_pairing_guards(spark):
    df = spark.createDataFrame([("p1", "a", 1, "s", 1.0), ("p1", "a", 1, "s", None)], "subject string, item string, round int, source string, y double")
    with pytest.raises(ValueError, match="not unique"):
        P.require_unique(df, P.KEYS)
    with pytest.raises(Exception, match="not unique"):
        P.pair(df.drop("source"), df, P.KEYS).collect()
    with pytest.raises(Exception, match="answers a case twice"):
        P.assemble(df, ["s"], carry=()).collect()
    with pytest.raises(Exception, match="null in y"):
        P.require_no_nulls(df, ["y"]).collect()
    with pytest.raises(ValueError, match="no rows"):
        P.restrict(df, item="b")
    nan = spark.createDataFrame([(float("nan"),)], "y double")
    with pytest.raises(Exception, match="null in y"):
        P.require_no_nulls(nan, ["y"]).collect()
    with pytest.raises(Exception, match="exactly one prior"):
        P.lookup_exactly_one(df.select("subject"), df, ["subject"], "y").collect()


def test_health_fallbacks_and_verdicts(spark):
    old = spark.createDataFrame([("m", 1, "stop"), ("m", None, "length")], "source string, llm_new_belief int, finish_reason string")
    got = G.verdict(G.summarize(old, ["source"])).collect()[0]
    assert (got.n, got.valid, got.truncated, got.tok_median) == (2, 1, 1, None)
    assert got.verdict.startswith("RAISE max_tokens - 1 attempt(s) across 1/2")
    new = spark.createDataFrame(
        [("a", True, 2, 0, 100, 50, False), ("b", True, 1, 0, 100, 95, False), ("c", False, 1, 0, 100, 10, False),
         ("d", True, 2, 1, 100, 10, True), ("e", True, 2, 1, 100, 10, False)],
        "source string, valid_output boolean, n_tries int, n_truncated int, max_tokens_budget int, completion_tokens int, thinking_disabled boolean")
    verdicts = {r.source: r.verdict for r in G.verdict(G.summarize(new, ["source"])).collect()}
    assert verdicts["a"] == "OK" and "used over 90%" in verdicts["b"] and verdicts["c"].startswith("FORMAT")
    assert verdicts["d"].startswith("NO-THINKING FALLBACK") and "retries recovered" in verdicts["e"]


def test_repair_fills_only_gaps(spark):
    raw = '{"new_belief": 2, "ranking": [3, 1, 2], "reasoning": "why", "general_public_stance": 0}'
    df = spark.createDataFrame([(1, None, None, raw), (None, None, 1, "bad")], "llm_new_belief int, llm_reasoning string, rank_1 int, raw_response string")
    got = C.repair(df).orderBy("raw_response").collect()
    assert (got[0].llm_new_belief, got[0].llm_reasoning, got[0].rank_1, got[0].repaired) == (None, None, 1, False)
    assert (got[1].llm_new_belief, got[1].llm_reasoning, got[1].rank_1, got[1].repaired) == (1, "why", 3, True)


def test_pseudonyms_are_stable_and_bijective(spark):
    ids = [f"{i:024d}" for i in range(40)]
    frame = spark.createDataFrame([(i,) for i in ids + ["nan", "{{%PROLIFIC_PID%}}", "RepresentsPayload"]], "original string")
    known = X.collect_ids([frame])
    assert known.count() == 40
    empty = spark.createDataFrame([], "original string, pseudonym string")
    first = {r.original: r.pseudonym for r in X.extend_map(empty, known.where("original < '000000000000000000000020'"), 1).collect()}
    assert sorted(first.values()) == [f"P{n:04d}" for n in range(1, 21)]
    old = spark.createDataFrame(list(first.items()), "original string, pseudonym string")
    second = {r.original: r.pseudonym for r in X.extend_map(old, known, 1).collect()}
    assert {k: second[k] for k in first} == first
    assert len(set(second.values())) == 40 and max(second.values()) == "P0040"


def test_text_rewrite_respects_word_limits(spark):
    a, b = "A" * 24, "B" * 24
    mapping = spark.createDataFrame([(a, "P0001")], "original string, pseudonym string")
    text = f"{a}, x{a} {a}é ({a}){b} {a}"
    df = spark.createDataFrame([(1, text), (2, "plain")], "k int, t string")
    got = {r.k: r for r in X.pseudonymise(df, "k", "t", mapping).collect()}
    assert got[1].t == f"P0001, x{a} {a}é (P0001){b} P0001" and got[1].n_replaced == 3
    assert got[2].t == "plain" and got[2].n_replaced == 0


def test_packed_records(spark):
    df = spark.createDataFrame([('a,"b,""c""",,d',), ("",), ("x",)], "v string")
    assert [r[0] for r in df.select(I.csv_fields(F.col("v"))).collect()] == [["a", 'b,"c"', "", "d"], [""], ["x"]]
    assert C.drop_positions(["p.code", "q.label"], ["code"]) == [0]
    with pytest.raises(ValueError):
        C.drop_positions(["p.code", "q.code"], ["code"])


def test_least_squares_and_random_intercept(spark):
    rng = np.random.default_rng(5)
    rows = []
    for i in range(80):
        u = rng.normal(0, 1.0)
        for t in range(3):
            x, z = rng.normal(), float(rng.integers(0, 2))
            rows.append(("s", f"p{i}", x, z, 0.5 + 2 * x - z + u + rng.normal(0, 0.5)))
    df = spark.createDataFrame(rows, "source string, subject string, x double, z double, y double")
    m = np.array([[1, r[2], r[3]] for r in rows])
    y = np.array([r[4] for r in rows])
    beta, *_ = np.linalg.lstsq(m, y, rcond=None)
    fit = {r.variable: r for r in L.ols(df, "source", ["x", "z"], "y").collect()}
    assert [fit[v].coefficient for v in ("Intercept", "x", "z")] == pytest.approx(list(beta))
    sigma2 = ((y - m @ beta) ** 2).sum() / (len(y) - 3)
    assert fit["x"].std_error == pytest.approx(math.sqrt(np.linalg.inv(m.T @ m)[1, 1] * sigma2))

    mixed = {r.variable: r for r in L.random_intercept(df, "source", "subject", ["x", "z"], "y").collect()}
    theta = mixed["x"].theta
    assert 2.0 < theta < 8.0  # true ratio 4
    def fit_at(t):
        block = np.linalg.inv(np.eye(3) + t)
        xx = sum(m[k:k + 3].T @ block @ m[k:k + 3] for k in range(0, 240, 3))
        xy = sum(m[k:k + 3].T @ block @ y[k:k + 3] for k in range(0, 240, 3))
        b = np.linalg.solve(xx, xy)
        r = y - m @ b
        s2 = sum(r[k:k + 3] @ block @ r[k:k + 3] for k in range(0, 240, 3)) / 237
        return 237 * math.log(s2) - 80 * np.linalg.slogdet(block)[1] + np.linalg.slogdet(xx)[1], b

    assert [mixed[k].coefficient for k in ("Intercept", "x", "z")] == pytest.approx(list(fit_at(theta)[1]), rel=1e-6)
    assert fit_at(theta)[0] <= min(fit_at(theta * 0.9)[0], fit_at(theta * 1.1)[0]) + 1e-9


def test_design_is_counterbalanced(spark):
    subjects = spark.range(27 * 4).withColumnRenamed("id", "subject")
    out = X.assign_design(subjects, "subject", ["a", "b", "c"], ["k1", "k2", "k3"], {i: ["pos", "neg"] for i in "abc"}, 3)
    combos = out.groupBy("subject").pivot("item").agg(F.first("cell")).groupBy("a", "b", "c").count().collect()
    assert len(combos) == 27 and {r["count"] for r in combos} == {4}
    positions = out.groupBy("subject").agg(F.sort_array(F.collect_list("position")).alias("p")).select("p").distinct().collect()
    assert [r.p for r in positions] == [[1, 2, 3]]


def test_every_line_item_is_an_answer(spark):
    for sf in ("sf0.001", "sf0.01"):
        folder = f"/root/testdata/{sf}"
        lines = V.table(spark, folder, "lineitem").join(V.table(spark, folder, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
        resp = V.responses(spark, folder)
        assert resp.count() == lines.count()
        assert P.duplicate_keys(resp, [*P.KEYS, "source"]).count() == 0


def test_ranks_of_skewed_values_are_dealt_evenly(spark):
    bulk = [(g, float(i) / 4000) for g in "ab" for i in range(4000)] + [("a", 1e6), ("a", 1e12), ("b", -1e15)]
    df = spark.createDataFrame(bulk, "g string, v double")
    ranked = O.average_ranks(df, ["g"], F.col("v"), open_domain=True)
    assert {(r.g, r.v): r.avg_rank for r in ranked.collect()} == {
        (g, v): i + 1 for g in "ab" for i, v in enumerate(sorted(x for k, x in bulk if k == g))}
    dealt = O.value_counts(df, ["g"], F.col("v")).repartitionByRange(8, "g", "v").groupBy(F.spark_partition_id()).count()
    assert max(r["count"] for r in dealt.collect()) < 2 * len(bulk) / 8


def test_many_levels_make_many_columns(spark):
    df = spark.createDataFrame([("s", f"l{i:03d}", float(i % 7), float(i)) for i in range(500)], "source string, level string, x double, y double")
    assert len(L.levels_of(df, "level", "l100")) == 500 and L.levels_of(df, "level", "l100")[0] == "l100"
    some, names = L.dummies(df, "level", L.levels_of(df.where("y < 20"), "level"))
    got = {(r.i, r.j): r.value for r in L.cross_products(some, ["source"], [*names, "x"], at_once=50).collect()}
    assert len(got) == 20 * 21 // 2 and got[19, 19] == sum((i % 7) ** 2 for i in range(500)) and got[0, 0] == 1


def test_noncentrality_holds_for_strict_levels():
    known = W.noncentrality_df4(0.05, 0.8)
    assert abs(known - 11.935) < 1e-2
    assert W.noncentrality_df4(1e-9, 0.999) > W.noncentrality_df4(1e-9, 0.8) > known


def plain_area(rows):
    """Area between two weighted cumulative distributions, value by value."""
    h, y = sum(r[1] for r in rows), sum(r[2] for r in rows)
    area = fh = fy = 0.0
    ordered = sorted(rows)
    for (v, a, b), (after, *_) in zip(ordered, ordered[1:]):
        fh, fy = fh + a / h, fy + b / y
        area += abs(fh - fy) * (after - v)
    return area


def test_distances_over_ranges_of_values(spark):
    rng = np.random.default_rng(4)
    rows = [("hot", float(v), float(a), float(b)) for v, a, b in zip(
        np.unique(np.concatenate((rng.normal(0, 1, 4000), rng.pareto(0.5, 1000)))), rng.integers(0, 3, 5000), rng.integers(0, 4, 5000))]
    rows += [("few", 1.0, 2.0, 0.0), ("few", 4.0, 0.0, 1.0), ("one", 3.0, 1.0, 5.0)]
    weights = spark.createDataFrame(rows, "g string, v double, wh double, wy double").repartition(7)
    want = {g: plain_area([r[1:] for r in rows if r[0] == g]) for g in ("hot", "few", "one")}
    for open_domain in (True, False):
        got = {r.g: r.wasserstein for r in M.wasserstein(weights, ["g"], open_domain).collect()}
        assert got == pytest.approx(want)
    assert M.wasserstein(weights.where("v > 1e300"), ["g"], open_domain=True).count() == 0


def test_ranges_of_a_hot_group_are_even(spark):
    values = spark.range(400_000).select(F.lit("g").alias("g"), F.exp(F.col("id") % 200_000 / 2000.0).alias("v")).distinct().withColumn("n", F.lit(1))
    sizes = [r["count"] for r in O.ranged(values, ["g"]).groupBy("_part").count().collect()]
    assert max(sizes) < 2 * sum(sizes) / len(sizes)


def test_medians_over_ranges_of_values(spark):
    rng = np.random.default_rng(6)
    data = {"a": rng.normal(0, 1, 999), "b": rng.pareto(1, 800), "c": np.array([2.0])}
    rows = [(g, float(v), int(k)) for g, x in data.items() for v, k in zip(x, rng.integers(1, 4, len(x)))]
    counts = spark.createDataFrame(rows, "g string, v double, n long")
    for open_domain in (True, False):
        got = {r.g: r.med for r in O.with_median(counts, ["g"], "med", open_domain).select("g", "med").distinct().collect()}
        assert got == pytest.approx({g: np.median(np.repeat([r[1] for r in rows if r[0] == g], [r[2] for r in rows if r[0] == g])) for g in data})


def test_orderings_are_counted_before_they_are_taken_apart(spark):
    from paneloom.plans.queries_scalar import counted_pairs, message_pairs

    rows = [(("A", "B", None)[i % 3], "baseline" if i % 4 == 0 else "model_2", 1 if i % 4 == 0 else 2, *ranks, i % 5 if i % 7 else None)
            for i in range(240) for ranks in ((1, 2, 3), (3, 1, 2), (2, 2, 1), (1, None, 2), (9, 1, 2))]
    resp = spark.createDataFrame(rows, "item string, source string, src int, r1 int, r2 int, r3 int, order_seen int").repartition(5)
    group = ["item", "source"]
    counted = counted_pairs(resp, group)
    plain = D.mean_ranks(message_pairs(resp), group, F.col("pairs"))
    weighted = D.mean_ranks(counted, group, F.col("pairs"), F.col("n"))
    assert sorted(map(str, weighted.collect())) == sorted(map(str, plain.collect()))
    assert counted.agg(F.sum("n")).collect()[0][0] == 480 and counted.count() <= 2 * 3 * 2 * 6
    # No filter on whole orderings has been moved below the count.
    below = counted._jdf.queryExecution().optimizedPlan().toString().rpartition("Aggregate [")[2]
    assert "array_sort" not in below and "zip" not in below


def test_mean_ranks_of_a_weightless_group_and_empty_input(spark):
    df = spark.createDataFrame([("a", [(1, 2), (2, None)], 3), ("a", [(1, 1)], 1)], "g string, pairs array<struct<message:int,rank:int>>, w int")
    got = {r.message: (r.mean_rank, r.n) for r in D.mean_ranks(df, ["g"], F.col("pairs"), F.col("w")).collect()}
    assert got == {1: (1.75, 4), 2: (None, 3)}
    assert D.mean_ranks(df.where("w > 9"), ["g"], F.col("pairs"), F.col("w")).count() == 0


def test_mean_rank_table_counts_answers_first(spark):
    from paneloom.plans.queries_describe import mean_rank_table

    plan = mean_rank_table(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    counts = [at for at in range(len(plan)) if plan.startswith("count(1)", at)]
    assert counts and "zip" in plan[:counts[-1]] and "zip" not in plan[counts[-1]:]


def test_answers_without_a_part_have_no_order_and_stop_no_report(spark, tmp_path):
    from paneloom.plans import report
    from paneloom.plans.queries_describe import mean_rank_table

    lines = [(o, None if o % 5 == 0 else o + n, 3 + n, n, float(o % 50), 10.0 * o, 0.01 * (o % 10), 0.0, "ANR"[o % 3])
             for o in range(1, 121) for n in range(1, 8) if (o + n) % 6]
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, "
                          "l_discount double, l_tax double, l_returnflag string").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(o, o % 10) for o in range(1, 121)], "o_orderkey long, o_custkey long").write.parquet(f"{tmp_path}/orders.parquet")
    held = V.responses(spark, str(tmp_path)).where("l_partkey IS NULL")
    assert held.count() == sum(row[1] is None for row in lines)
    assert held.where("r1 IS NOT NULL OR r2 IS NOT NULL OR r3 IS NOT NULL").count() == 0
    table = mean_rank_table(spark, str(tmp_path))
    # Of 13 parts, one has malformed orders; each whole order gives every one of the three messages a rank.
    whole = sum(row[1] is not None and row[1] % 13 != 0 for row in lines)
    assert table.agg(F.sum("n")).collect()[0][0] == 3 * whole
    assert report.message_test(table, 7, V.BASELINE).count() > 0


@pytest.fixture(scope="module")
def odd_lines(spark, tmp_path_factory):
    """A folder of lines with subjects, items, parts, suppliers and candidates missing, and a line that is there twice; its wide rows."""
    from paneloom.session import materialise

    folder = tmp_path_factory.mktemp("odd")
    lines = [(o, None if o % 9 == 0 else 7 * o + 5 * n, 3 + n, n, float(o % 50), 10.0 * o, 0.01 * (o % 10), 0.0, ("A", "N", "R", None)[o % 4])
             for o in range(1, 161) for n in range(1, 8) if (o + n) % 6]
    lines.append(lines[0])
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, "
                          "l_discount double, l_tax double, l_returnflag string").write.parquet(f"{folder}/lineitem.parquet")
    spark.createDataFrame([(o, o % 11 or None) for o in range(1, 161)], "o_orderkey long, o_custkey long").write.parquet(f"{folder}/orders.parquet")
    return materialise(V.lines_wide(spark, str(folder)), "odd")


def test_rankings_of_a_case_are_read_from_its_row(spark, odd_lines):
    from paneloom.plans.queries_pairing import _rank_match, counted_rank_match

    rows = V.responses(spark, "", odd_lines).collect()
    given = {(r.subject, r.item, r.round, r.source): r for r in rows if r.src > 1 and r.subject is not None and r.item is not None}
    want = {}
    for b in (r for r in rows if r.src == 1):
        for source in V.CANDIDATES:
            c = given.get((b.subject, b.item, b.round, source))
            hb, mc = [b.r1, b.r2, b.r3], c and [c.r1, c.r2, c.r3]
            whole = mc is not None and sorted(hb, key=str) == sorted(mc, key=str) == [1, 2, 3]
            reason = "missing" if c is None else "invalid_rank" if not whole else "other_stimulus" if b.order_seen != c.order_seen else None
            pair = (tuple(hb), tuple(mc.index(i) + 1 for i in (1, 2, 3))) if reason is None else None
            key = (b.item, b.cell, source, reason, pair)
            want[key] = want.get(key, 0) + 1
    assert {k[3] for k in want} == {None, "missing", "invalid_rank", "other_stimulus"}
    assert any(k[0] is None for k in want) and any(k[1] is None for k in want)

    def found(df, n):
        got = {}
        for r in df.withColumn("n", n).collect():
            key = (r.item, r.cell, r.source, r.reason, None if r.reason else (tuple(r.hb), tuple(r.mc)))
            got[key] = got.get(key, 0) + r.n
        return got

    matched, counted = _rank_match(spark, "", odd_lines), counted_rank_match(spark, "", odd_lines)
    assert found(matched, F.lit(1)) == want == found(counted, F.col("n"))
    plan = matched._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Aggregate" not in plan
    below = counted.where("reason IS NULL")._jdf.queryExecution().optimizedPlan().toString().rpartition("Aggregate [")[2]
    assert "array_sort" not in below and "array_position" not in below


def test_cases_are_assembled_without_a_sort(spark, odd_lines):
    from paneloom.plans.queries_resample import _wide

    cases = _wide(spark, "", odd_lines)
    plain = P.assemble(V.panel(spark, "", odd_lines), V.CANDIDATES)
    names = sorted(plain.columns)
    assert sorted(cases.columns) == names
    assert sorted(map(str, cases.select(names).collect())) == sorted(map(str, plain.select(names).collect()))
    assert "Sort" not in cases._jdf.queryExecution().executedPlan().toString()


def test_lines_of_a_round_are_picked_without_another_sort(spark, tmp_path):
    from paneloom.plans.queries_describe import design_counts

    names = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag"]
    lines = [(o, None if o % 5 == 0 else o + n, None if o % 7 == 0 else n, None if o % 13 == 0 else n, None if n == 3 else float(o), 1.0 * o,
              0.01 * n, 0.0, ("A", None)[o % 2]) for o in range(1, 61) for n in range(1, 9) if (o + n) % 4]
    lines += [lines[0], lines[0]]
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, "
                          "l_discount double, l_tax double, l_returnflag string").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(o, o % 4 or None) for o in range(1, 61)], "o_orderkey long, o_custkey long").write.parquet(f"{tmp_path}/orders.parquet")

    def order(row):
        return [(row[c] is not None, row[c] or 0) for c in V._ORDER]

    rounds, want = {}, {}
    for row in sorted((dict(zip(names, x)) for x in lines), key=order):
        answer = (row["l_orderkey"] % 4 or None, row["l_returnflag"], row["l_linenumber"])
        rounds[answer] = rounds.get(answer, 0) + 1
        case = want.setdefault((*answer[:2], rounds[answer]), {})
        if answer[2] in range(1, 8):
            case[V.SOURCES[answer[2] - 1]] = row
    for fields in (V._ORDER, V.ANSWER_FIELDS):
        got = V.lines_wide(spark, str(tmp_path), fields)
        rows = {(r.subject, r.item, r.round): {s: r[s].asDict() for s in V.SOURCES if r[s] is not None} for r in got.collect()}
        assert rows == {k: {s: {f: row[f] for f in fields} for s, row in case.items()} for k, case in want.items()}
        assert "SortAggregate" not in got._jdf.queryExecution().executedPlan().toString()
    held = V.lines_wide(spark, str(tmp_path), V.ANSWER_FIELDS)
    cells = ["subject", "item", "round", "source", "y", "r1", "r2", "r3", "order_seen"]
    for view in (V.responses, V.panel):
        plain = view(spark, str(tmp_path)).select(cells)
        assert sorted(map(str, view(spark, "", held, cells).collect())) == sorted(map(str, plain.collect()))
    first = [k for k, case in want.items() if V.BASELINE in case]
    whole = design_counts(spark, "", held).where("item = 'all'").collect()[0]
    assert (whole.n_obs, whole.n_subjects) == (len(first), len({k[0] for k in first}))
