"""All registered queries, gathered by import."""

from paneloom.plans import (  # noqa: F401
    queries_describe, queries_jobs, queries_pairing, queries_resample, queries_scalar, queries_tests)
from paneloom.plans.registry import ORACLES, QUERIES  # noqa: F401
