"""The sign-flip queries take every paired case of the design, and a million flips of each group."""

import math
from collections import Counter, defaultdict

import numpy as np
import pytest

from paneloom.operators.resample import N_FLIPS
from paneloom.plans import catalog
from paneloom.plans import tables as V
from paneloom.plans.queries_resample import COMPARISONS


def exact_p(differences):
    """Two-sided p over all sign flips: the distribution of the flipped sum, case by case."""
    chances, observed = np.ones(1), abs(sum(differences))
    for d in map(abs, differences):
        if d:
            step = np.zeros(2 * d + 1)
            step[[0, -1]] = 0.5
            chances = np.convolve(chances, step)
    sums = np.arange(len(chances)) - len(chances) // 2
    return chances[np.abs(sums) >= observed].sum()


@pytest.fixture(scope="module")
def design(spark, tmp_path_factory):
    """A folder of tables, and per case of it (item, cell, {source: belief}); sources answer an item zero to four times."""
    folder, rng = tmp_path_factory.mktemp("design"), np.random.default_rng(6)
    orders, lines, cases = [], [], defaultdict(dict)
    for subject in range(1, 46):
        orders.append((1000 + subject, subject))
        for item in V.ITEMS:
            for n, source in enumerate(V.SOURCES, start=1):
                rows = sorted((1000 + subject, int(rng.integers(1, 200)), int(rng.integers(1, 50)), float(rng.integers(900, 5000)),
                               float(rng.integers(1, 51)), float(rng.integers(0, 11)) / 100, 0.02) for _ in range(rng.integers(0, 5)))
                lines += [(*row, n, item) for row in rows]
                for k, row in enumerate(rows):
                    if n == 1 or row[2] % 11:
                        cases[subject, item, k][source] = (int(row[4]) % 5 - 2) * (1 if (subject + ord(item)) % 2 == 0 else -1)
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long").write.parquet(f"{folder}/orders.parquet")
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long, l_suppkey long, l_extendedprice double, l_quantity double, l_discount double, "
                                 "l_tax double, l_linenumber int, l_returnflag string").write.parquet(f"{folder}/lineitem.parquet")
    return str(folder), [(item, V.CELLS[subject % 3], y) for (subject, item, _), y in cases.items() if V.BASELINE in y]


def held_against(found, want):
    """`found` (key: n, mean, p) has every group of `want` (key: differences), all of its cases and p within Monte-Carlo error."""
    assert found.keys() == want.keys()
    for key, (n, mean, p) in found.items():
        exact = exact_p(want[key])
        assert (n, mean) == (len(want[key]), pytest.approx(sum(want[key]) / len(want[key]), abs=1e-6)), key
        assert abs(p - exact) <= 5 * math.sqrt(exact * (1 - exact) / N_FLIPS) + 1e-6, key


def paired(cases, pairs):
    return {(a, b): [y[a] - y[b] for *_, y in cases if a in y and b in y] for a, b in pairs}


def test_whole_design(spark, design):
    folder, cases = design
    rows = catalog.QUERIES["sta2_sign_flip_whole_design"](spark, folder).collect()
    held_against({(V.BASELINE, r.source): (r.n, r.mean_diff, r.p) for r in rows}, paired(cases, [(V.BASELINE, s) for s in V.CANDIDATES]))


def test_comparison_registry(spark, design):
    folder, cases = design
    rows = catalog.QUERIES["sta3_comparison_registry"](spark, folder).collect()
    held_against({(r.a, r.b): (r.n, r.observed_diff, r.p) for r in rows}, paired(cases, COMPARISONS))


def test_effect_report(spark, design):
    folder, cases = design
    found = {(r.item, r.cell, r.source, r.test, r.statistic): r.value for r in catalog.QUERIES["sta29_effect_report"](spark, folder).collect()}
    want = {(*names, s): paired([c for c in cases if names[0] in ("all", c[0]) and names[1] in ("all", c[1])], [(V.BASELINE, s)])[V.BASELINE, s]
            for names in {("all", "all"), *((i, c) for i in V.ITEMS for c in ("all", *V.CELLS))} for s in V.CANDIDATES}
    held_against({k[:3]: (v, found[*k[:3], "difference", "mean_diff"], found[*k[:3], "difference", "p"])
                  for k, v in found.items() if k[3:] == ("difference", "n")}, want)
    assert Counter(k[3] for k in found) == {"difference": 78 * 5, "stance": 78 * 4, "change": 78 * 4}
