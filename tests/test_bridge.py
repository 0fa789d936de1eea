"""The evidence bridge: what making it moves."""

import random

from test_moves import moved

from testimony.functions.scale import cut
from testimony.operators.normalize import classify_tools
from testimony.plans import govern
from testimony.rules import DEFAULT_RULES


def test_bridge_moves_each_text_once(spark):
    """Clauses are made where their record came to, and tool results move without what no claim says."""
    rng = random.Random(4)
    said = [("p", f"u{i}", "s", "u", "user_utterance", f"2024-01-01 00:{i % 60:02d}:00", f"The agent must log {rng.randbytes(900).hex()}") for i in range(400)]
    told = [("p", f"t{i}", "s", "u", "2024-01-01 00:00:00", "pytest", f"suite passed {rng.randbytes(400).hex()}", "suite") for i in range(400)]
    names = "project_id source_id session_id user_id source_type ts text".split()
    heard = cut(spark.createDataFrame(said, names), "said")
    tools = cut(spark.createDataFrame(told, "project_id source_id session_id user_id ts name content object".split()), "tools")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", "-1")
    try:
        before = moved(spark)
        bridge = govern.evidence_bridge(heard, DEFAULT_RULES, classify_tools(tools))
        bridge.select("item_id", "clause", "object", "repeated").write.format("noop").mode("overwrite").save()
        assert moved(spark) - before < 400 * 1800 * 1.3
        assert {(r.source_type, r.repeated): r["count"] for r in bridge.groupBy("source_type", "repeated").count().collect()} == {("user_utterance", False): 400, ("tool_evidence", False): 400}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.autoBroadcastJoinThreshold")
