"""Draws from counts against draws per case, exact enumeration, and what a draw must not depend on."""

import itertools
import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from paneloom.functions import variates
from paneloom.operators import power as W
from paneloom.operators import resample as B


def labelled(*columns):
    return F.array(*[F.struct(F.lit(c).alias("label"), F.col(c).alias("d")) for c in columns])


def exact_p(d):
    sums = [sum(s * v for s, v in zip(signs, d)) for signs in itertools.product((1, -1), repeat=len(d))]
    return sum(abs(s) >= abs(sum(d)) - 1e-12 for s in sums) / len(sums)


@pytest.mark.parametrize("d", [
    [1, 2, -1, 3, 1, 1, 2, -2, 1, 2], [0, 0, 0], [1, -1], [4] * 6, [0.1, 0.2, 0.3, -0.6], [0.5, 1.5, -2.25, 3.125, 0, 0, 0.75],
    [1, 1, 1, 1, 1, 1, 1, 1, -1, -1, -1, 2, 2, 2, 3, -3]])
def test_counted_p_is_near_the_exact_one(spark, d):
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(d)], "subject int, x double")
    got = B.counted_sign_flip(df, [], labelled("x"), [[]], 40_000, 1).collect()[0]
    exact = exact_p(d)
    assert abs(got.p - exact) <= 5 * math.sqrt(exact * (1 - exact) / 40_000) + 1e-12
    assert got.n == len(d) and got.mean_diff == pytest.approx(sum(d) / len(d)) and got.exceed == pytest.approx(got.p * 40_000)
    if len(set(d)) > 1:
        assert got.sd_diff == pytest.approx(np.std(d, ddof=1))


def test_counted_flips_agree_with_flips_per_case(spark):
    rng = np.random.default_rng(3)
    rows = [(i, f"i{i % 3}", f"c{i % 2}", float(a), float(b), None if i % 7 == 0 else float(rng.normal())) for i, (a, b) in enumerate(
        zip(rng.integers(-2, 3, 700), rng.choice([-1, 0, 1, 2], 700, p=[0.28, 0.2, 0.32, 0.2])))]
    df = spark.createDataFrame(rows, "subject int, item string, cell string, x double, z double, open double")
    groupings = [[], ["item"], ["item", "cell"]]
    diffs = F.filter(labelled("x", "z", "open"), lambda v: v["d"].isNotNull())
    key = lambda r: (r.item, r.cell, r.label)
    few = {key(r): r for r in B.sign_flip(df, ["item", "cell"], ["subject"], diffs, groupings, 4000, 5).collect()}
    got = {key(r): r for r in B.counted_sign_flip(df, ["item", "cell"], diffs, groupings, 20_000, 5).collect()}
    assert got.keys() == few.keys() and len(got) == 30
    for k, r in got.items():
        q = few[k]
        assert (r.n, r.mean_diff, r.sd_diff, r.d_z) == pytest.approx((q.n, q.mean_diff, q.sd_diff, q.d_z))
        p = (r.exceed + q.exceed) / 24_000
        assert abs(r.p - q.p) <= 4.5 * math.sqrt(p * (1 - p) * (1 / 4000 + 1 / 20_000)) + 1e-9, k


def test_counted_draws_depend_on_neither_rows_nor_partitions(spark):
    rows = [(i, (i * 7) % 5 - 2.0) for i in range(300)]
    first, second = (
        sorted(map(tuple, B.counted_sign_flip(spark.createDataFrame(r, "subject int, x double").repartition(k), [], labelled("x"), [[]], 40_000, 9).collect()))
        for r, k in ((rows, 3), (rows[::-1], 7)))
    assert first == second


def test_no_difference_and_no_case(spark):
    df = spark.createDataFrame([(1, 0.0), (2, 0.0)], "subject int, x double")
    assert [(r.p, r.exceed, r.d_z) for r in B.counted_sign_flip(df, [], labelled("x"), [[]], 1000, 1).collect()] == [(1.0, 1000, None)]
    assert B.counted_sign_flip(df.where("x > 1"), [], labelled("x"), [[]], 1000, 1).count() == 0


@pytest.mark.parametrize("trials", [1, 5, 63, 64, 65, 200, 256, 257, 10_000])
def test_fair_binomials(trials):
    draws = variates.heads(variates.generator(1, "x", trials), trials, 50_000)
    assert draws.min() >= 0 and draws.max() <= trials
    assert abs(draws.mean() - trials / 2) < 5 * math.sqrt(trials / 4 / 50_000)
    assert draws.var() == pytest.approx(trials / 4, rel=0.04)
    assert (variates.heads(variates.generator(1, "x", trials), trials, 50_000) == draws).all()


def test_splits_of_all_leaves_add_up():
    sizes, totals = [5, 0, 12, 1, 0, 0, 7, 30], np.full(4000, 55)
    leaves = np.array([variates.descend(3, 0, totals, sizes, leaf) for leaf in range(len(sizes))])
    assert (leaves.sum(axis=0) == 55).all() and not leaves[[1, 4, 5]].any()
    assert leaves.mean(axis=1) == pytest.approx(sizes, abs=0.5)
    assert np.cov(leaves)[2, 7] == pytest.approx(-55 * 12 / 55 * 30 / 55, rel=0.15)


def frame_of_errors(spark, n=90):
    rng = np.random.default_rng(1)
    rows = [(f"p{i}", 3, *map(float, rng.integers(0, 9, 3))) for i in range(n)]
    return rows, spark.createDataFrame(rows, "subject string, m int, a double, b double, c double")


@pytest.mark.parametrize("per_task", [1000, 8])
def test_bootstrap_weights_are_multinomial_at_every_cut(spark, monkeypatch, per_task):
    monkeypatch.setattr(B, "_per_task", lambda width: per_task)
    subjects = spark.createDataFrame([(i,) for i in range(60)], "subject long")
    rows = B.bootstrap_weights(subjects, "subject", 1200, 4).collect()
    table = np.zeros((1200, 60))
    for r in rows:
        table[r.rep, r.subject] += r.w
    assert (table.sum(axis=1) == 60).all() and min(r.w for r in rows) == 1
    assert table.mean(axis=0) == pytest.approx(np.ones(60), abs=0.16)
    assert table.var() == pytest.approx(1 - 1 / 60, rel=0.03)
    off = np.cov(table.T)[~np.eye(60, dtype=bool)]
    assert off.mean() == pytest.approx(-1 / 60, rel=0.1)


def test_bootstrap_sums_are_those_of_the_weights(spark, monkeypatch):
    monkeypatch.setattr(B, "_per_task", lambda width: 16)
    monkeypatch.setattr(B, "HELD", 3000)
    rows, errors = frame_of_errors(spark)
    values = {r[0]: np.array(r[2:]) for r in rows}
    want = np.zeros((700, 3))
    for r in B.bootstrap_weights(errors, "subject", 700, 2).collect():
        want[r.rep] += r.w * values[r.subject]
    got = {r.rep: (r.a, r.b, r.c) for r in B.bootstrap_sums(errors, "subject", ["a", "b", "c"], 700, 2).collect()}
    assert len(got) == 700
    assert np.array([got[i] for i in range(700)]) == pytest.approx(want)


def test_bootstrap_counts_are_those_of_the_weights(spark, monkeypatch):
    monkeypatch.setattr(B, "_per_task", lambda width: 16)
    rng = np.random.default_rng(2)
    rows = [(int(s), f"s{k}", int(rng.integers(0, 3)), None if s % 9 == 0 else int(rng.integers(0, 3))) for s in range(70) for k in range(2)
            for _ in range(3)]
    cases = spark.createDataFrame(rows, "subject long, source string, h int, y int")
    weights = {(r.rep, r.subject): r.w for r in B.bootstrap_weights(cases.select("subject").distinct(), "subject", 40, 6).collect()}
    want = Counter()
    for (rep, subject), w in weights.items():
        for s, *key in rows:
            if s == subject:
                want[rep, *key] += w
    got = B.bootstrap_counts(cases, "subject", ["source", "h", "y"], 40, 6).collect()
    assert {(r.rep, r.source, r.h, r.y): r.w for r in got} == dict(want)


def test_orders_are_uniform_and_sums_are_kept(spark):
    one = spark.createDataFrame([("p", 1, 0.0, 1.0, 3.0)], "subject string, m int, a double, b double, c double")
    dealt, _ = B._by_block(one.select("subject", "a"), "subject", 10, 5, 10)
    assert dealt.count() == 2
    draws = Counter()
    for block in range(6):
        matrix = np.tile([0.0, 1.0, 3.0], (2000, 1))
        draws.update(map(tuple, variates.generator(7, "order", block, "p").permuted(matrix, axis=1)))
    assert len(draws) == 6 and all(abs(n - 2000) < 5 * math.sqrt(2000) for n in draws.values())


def test_omnibus_p_is_near_the_exact_one(spark):
    rows = [("p0", 1, 1.0, 2.0, 4.0), ("p1", 1, 0.0, 2.0, 1.0), ("p2", 1, 1.0, 3.0, 3.0), ("p3", 1, 0.0, 1.0, 2.0)]
    errors = spark.createDataFrame(rows, "subject string, m int, a double, b double, c double")
    values = np.array([r[2:] for r in rows])
    orders = [np.array(o) for o in itertools.permutations(range(3))]
    stats = [np.var(sum(v[o] for v, o in zip(values, pick)) / 4) for pick in itertools.product(orders, repeat=4)]
    observed = np.var(values.sum(axis=0) / 4)
    exact = np.mean([s >= observed - 1e-12 for s in stats])
    got = B.omnibus(errors, "subject", ["a", "b", "c"], 20_000, 3).collect()[0]
    assert got.statistic == pytest.approx(observed)
    assert abs(got.p - exact) < 5 * math.sqrt(exact * (1 - exact) / 20_000) + 1e-4


@pytest.mark.parametrize("k", [2, 3, 5, 8, 9])
def test_permuted_sums_are_the_same_in_lanes_and_as_doubles(monkeypatch, k):
    rng = np.random.default_rng(k)
    units = [rng.integers(0, 12_000, k) / 2 for _ in range(40)]  # lanes are carried over several times

    def sums():
        held = B._PermutedSums(k, 20_001)
        for i, values in enumerate(units):
            held.add(values, variates.generator(3, "order", 0, i, kind=np.random.SFC64))
        held.carry()
        return held.sums

    packed = sums()
    monkeypatch.setattr(B, "_steps", lambda values: None)
    assert (packed == sums()).all() and packed.sum(axis=1) == pytest.approx(np.full(20_001, sum(u.sum() for u in units)))
    spread = np.sqrt(sum(u.var() for u in units) / 20_001)
    assert packed.mean(axis=0) == pytest.approx(np.full(k, packed.sum() / packed.size), abs=5 * spread)
    assert np.cov(packed.T)[0, 1] == pytest.approx(-sum(u.var() for u in units) / (k - 1), rel=0.15)


@pytest.mark.parametrize("step", [1.0, 0.1])
def test_every_order_is_equally_likely(step):
    for k in (3, 4, 5):
        held, n = B._PermutedSums(k, 60_000), 60_000 / math.factorial(k)
        held.add(np.arange(k) * step, variates.generator(7, "order", k, kind=np.random.SFC64))
        held.carry()
        draws = Counter(map(tuple, held.sums))
        assert len(draws) == math.factorial(k) and all(abs(c - n) < 5 * math.sqrt(n) for c in draws.values())
    full = B._PermutedSums(8, 1)
    table = full._packed(B._steps(np.arange(8.0))).view(np.uint16)
    assert len(set(map(tuple, table))) == 40_320 and (np.sort(table, axis=1) == 2 * np.arange(8)).all()


def test_omnibus_sums_leave_a_task_once_per_replicate(spark, monkeypatch):
    monkeypatch.setattr(B, "UNITS_A_PART", 30)
    rows, errors = frame_of_errors(spark)
    errors = errors.withColumn("subject", F.when(F.col("subject") != "p7", F.col("subject"))).withColumn("c", F.col("b") + 0.25)
    found = []
    for block in (131_072, 1000):
        monkeypatch.setattr(B, "ORDER_BLOCK", block)
        out = B.omnibus(errors, "subject", ["a", "b", "c"], 2500, 4)
        plan = out._jdf.queryExecution().toString()
        assert "MapInArrow" in plan and "FlatMapGroupsInPandas" not in plan
        found.append(out.collect()[0])
    again = B.omnibus(errors.repartition(5), "subject", ["a", "b", "c"], 2500, 4).collect()[0]
    assert again == found[1] and found[0].statistic == pytest.approx(np.var([sum(r[2] for r in rows) / 270, *[sum(r[3] for r in rows) / 270] * 2] + np.array([0, 0, 0.25 * 90 / 270])))
    assert abs(found[0].p - found[1].p) < 0.1


def plain_w(a, b):
    za, zb = np.abs(a - np.median(a)), np.abs(b - np.median(b))
    z = np.concatenate([za, zb])
    within = ((za - za.mean()) ** 2).sum() + ((zb - zb.mean()) ** 2).sum()
    between = len(za) * (za.mean() - z.mean()) ** 2 + len(zb) * (zb.mean() - z.mean()) ** 2
    return (len(z) - 2) * between / within if within > 0 else math.nan


def test_statistics_of_counts_are_those_of_rows():
    rng = np.random.default_rng(8)
    levels = np.array([0.0, 1.0, 2.5, 4.0])
    counts = [rng.multinomial(31, [0.4, 0.3, 0.2, 0.1], 50), rng.multinomial(31, [0.4, 0.3, 0.2, 0.1], 50)]
    counts[0][0] = counts[1][0] = [31, 0, 0, 0]
    got = W._brown_forsythe([levels, levels * 1.3], counts)
    want = [plain_w(np.repeat(levels, x), np.repeat(levels * 1.3, y)) for x, y in zip(*counts)]
    assert got == pytest.approx(want, nan_ok=True) and math.isnan(got[0])


@pytest.mark.parametrize("more", [True, False])
def test_power_is_that_of_simulated_rows(spark, more):
    rng = np.random.default_rng(5)
    values = rng.choice([0, 1, 2, 3], 240, p=[0.5, 0.25, 0.15, 0.1])
    df = spark.createDataFrame([(int(v),) for v in values] + [(None,)], "v int")
    alpha, ratio, sims = 0.05, 1.25, 1200
    got = {r.ratio: r for r in W.brown_forsythe_power(df, F.col("v"), [1.0, ratio], 4000, 3, more, alpha).collect()}
    assert {r.n_sims for r in got.values()} == {4000}
    centre, hits = np.median(values), 0
    scale = 1 / ratio if more else ratio
    critical = 3.8610  # F(1, 478) at 0.05
    for _ in range(sims):
        a, b = rng.choice(values, 240), centre + (rng.choice(values, 240) - centre) * scale
        hits += plain_w(a, b) > critical
    assert got[ratio].power == pytest.approx(hits / sims, abs=5 * math.sqrt(0.25 / sims))
    assert got[1.0].power < got[ratio].power


def test_power_of_a_constant_measure_is_zero(spark):
    df = spark.createDataFrame([(1,)] * 20, "v int")
    assert [r.power for r in W.brown_forsythe_power(df, F.col("v"), [1.5], 100, 3).collect()] == [0.0]


def test_flipped_sums_take_the_signs_of_the_digests(spark, monkeypatch):
    import hashlib

    rows, errors = frame_of_errors(spark, 40)
    want = np.zeros((70, 3))
    for subject, _, *values in rows:
        for rep in range(70):
            word = int(hashlib.md5(f"5|{rep // 32}|{subject}".encode()).hexdigest()[:8], 16)
            want[rep] += (2 * (word >> (rep % 32) & 1) - 1) * np.array(values)
    for at_once in (1, 64):
        monkeypatch.setattr(B, "BLOCKS_AT_ONCE", at_once)
        got = {r.rep: (r.a, r.b, r.c) for r in B.flipped_sums(errors, "subject", ["a", "b", "c"], 70, 5).collect()}
        assert len(got) == 70 and np.array([got[i] for i in range(70)]) == pytest.approx(want)


@pytest.mark.parametrize("keys", [[b"1", b"22", b"", b"p|3" * 9], [b"x" * 70, b"y"], [str(7919 * i).encode() for i in range(300)]])
def test_digests_are_those_of_hashlib(keys):
    import hashlib

    digests = variates.Digests(keys)
    for prefix in (b"", b"7|0|", b"7|3124|", b"poisson|11|9999|", b"z" * 16, b"7|1|"):
        assert digests.words(prefix).tolist() == [int(hashlib.md5(prefix + k).hexdigest()[:8], 16) for k in keys]


def test_poisson_sums_are_those_of_the_weights(spark, monkeypatch):
    monkeypatch.setattr(B, "DIGESTED_AT_ONCE", 16)
    rows, errors = frame_of_errors(spark)
    errors = errors.withColumn("subject", F.when(F.col("subject") != "p7", F.col("subject")))
    values = {None if r[0] == "p7" else r[0]: np.array(r[2:]) for r in rows}
    want = np.zeros((600, 3))
    for r in B.poisson_weights(errors, "subject", 600, 2).collect():
        want[r.rep] += r.w * values[r.subject]
    got = {r.rep: (r.a, r.b, r.c) for r in B.poisson_sums(errors, "subject", ["a", "b", "c"], 600, 2).collect()}
    assert len(got) == 600 and np.array([got[i] for i in range(600)]) == pytest.approx(want)


def test_bootstrap_counts_leave_a_task_once_per_replicate_and_combination(spark, monkeypatch):
    monkeypatch.setattr(B, "_per_task", lambda width: 4)
    rows = [(s, "a" if s % 2 else "b", s % 3) for s in range(300)]
    cases = spark.createDataFrame(rows, "subject long, source string, h int").repartition(4)
    got = B.bootstrap_counts(cases, "subject", ["source", "h"], 20, 6)
    assert got.groupBy("rep").agg(F.sum("w").alias("w")).where("w <> 300").count() == 0
    before = got._jdf.queryExecution().toString()
    assert "MapInArrow" in before and "FlatMapGroupsInPandas" not in before
