"""What simulated rule changes move."""

import random

from helpers import item, items
from pyspark.sql import functions as F
from test_moves import moved

from testimony.functions.scale import cut
from testimony.operators import conflicts, rulechange
from testimony.rules import SIGNAL_WEIGHTS, Policy


def test_transitions_move_objects_of_admitted_claims_once(spark):
    rng = random.Random(5)
    rows = [item(f"i{i}", object_key=f"o{i}", object=rng.randbytes(500).hex(), confidence=0) for i in range(300)]
    rows += [item("a", source_type="proposed_update", status="accepted", object="short", object_key="held"), item("b", modality="may", source_type="proposed_update", status="accepted", object_key="held")]
    base = items(spark, *rows)
    for f in ("explicit_preference", "explicit_rejection", "strong_emphasis", "long_form", "repeated"):
        base = base.withColumn(f, F.lit(f == "explicit_rejection"))
    base = cut(base, "claims")
    props = spark.createDataFrame([(f"r{i}", s, 1) for i, s in enumerate(("user_explicit_rejection", "user_long_form", "user_repeated"))], "proposal_id string, signal string, new_weight long")
    weights = spark.createDataFrame(sorted(SIGNAL_WEIGHTS.items()), "signal string, weight int")
    lax = Policy(min_conflict_severity=101, constitutional_blocks=())
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", "-1")
    try:
        sim = rulechange.simulate(base, conflicts.detect_conflicts(base), props, weights, lax)
        before = moved(spark)
        hits = {tuple(r) for r in rulechange.transitions(sim).select("scenario", "project_id", "rule", "subject", "entered").collect()}
        assert moved(spark) - before < 300 * 1000 * 2.5
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.autoBroadcastJoinThreshold")
    assert hits == {(f"r{i}", "p", rulechange.FORBIDDEN[3], x, False) for i in range(3) for x in "ab"}
