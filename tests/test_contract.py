from __future__ import annotations

import pytest

import __spark_entry__ as entry
from contract.check import compare, duck
from contract.lift import Lift
from contract.oracle import ORACLE
from contract.queries import OVER_LIFT, REGISTRY

SF = "/root/testdata/sf0.001"
SAMPLE = ("ingest_counts", "utterance_signals", "structured_claims", "detect_conflicts", "resolve_conflicts", "cluster_duplicates", "gate_budget", "compact_state", "lookup_terms", "drift_attribution", "weight_shadow", "profile_candidates")


@pytest.fixture(scope="module")
def lift(spark):
    return Lift(spark, SF)


@pytest.fixture(scope="module")
def con():
    return duck(SF)


def test_every_query_has_its_sql():
    assert set(REGISTRY) == set(ORACLE)
    assert set(REGISTRY) <= set(entry.queries()) and set(ORACLE) <= set(entry.oracle_sql())
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", SAMPLE)
def test_query_agrees_with_sql(name, lift, con):
    assert compare(OVER_LIFT[name](lift), con, ORACLE[name]) == ""


def test_entry(spark):
    assert entry.entry(spark).where("allowed").count() > 0
