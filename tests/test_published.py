"""Resampling queries have the published budgets by default and follow the number they are given."""

import inspect
import os

import pytest

from paneloom.operators.power import N_SIMS
from paneloom.operators.resample import N_BOOTSTRAPS, N_CLUSTER_FLIPS, N_FLIPS
from paneloom.plans import catalog

SF_DIR = os.environ.get("SF_DIR", "/root/testdata/sf0.001")
CLUSTERED = {"sta4_cluster_sign_flip", "sta5_omnibus", "sta6_pairwise_mae", "sta26_source_sweep"}


def test_published_budgets_are_the_defaults():
    assert (N_FLIPS, N_CLUSTER_FLIPS, N_BOOTSTRAPS, N_SIMS) == (1_000_000, 100_000, 10_000, 4_000)
    found = {}
    for name, fn in catalog.QUERIES.items():
        for p in ("n_rep", "n_boot", "n_sims"):
            if p in inspect.signature(fn).parameters:
                found[name] = True
                want = {"n_rep": N_CLUSTER_FLIPS if name in CLUSTERED else N_FLIPS, "n_boot": N_BOOTSTRAPS, "n_sims": N_SIMS}[p]
                assert inspect.signature(fn).parameters[p].default == want, name
    assert len(found) == 19


@pytest.mark.parametrize("name", ["sta2_sign_flip_whole_design", "sta5_omnibus"])
def test_p_moves_in_steps_of_the_given_number(spark, name):
    # 499 flips: p in 1/499; with the observed order among them, in 1/500.
    steps = 499 if name.startswith("sta2") else 500
    found = [r.p * steps for r in catalog.QUERIES[name](spark, SF_DIR, n_rep=499).collect()]
    assert found and all(abs(x - round(x)) < 1e-3 for x in found)


def test_intervals_use_all_replicates(spark):
    few, many = ({r.source: (r.lo, r.hi) for r in catalog.QUERIES["sta8_percentile_interval"](spark, SF_DIR, n_boot=n).collect()}
                 for n in (40, 400))
    assert few.keys() == many.keys() and few != many
