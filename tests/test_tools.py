"""How often the texts of tool results are looked at."""

from pyspark.sql import functions as F

from testimony.functions.scale import cut
from testimony.operators import normalize
from testimony.rules import NAMED_FAILURE


def test_tool_outputs_are_read_once(spark):
    """The patterns of a tool's outcome are written out once in the plan, however many columns rest on it."""
    calls = cut(spark.createDataFrame([("pytest", "3 failed"), ("pytest", "fixed the failed path: 4 passed"), ("shell", "no errors"), ("web_search", None), (None, "2 passed")], "name string, content string"), "calls")
    told = normalize.classify_tools(calls).where("outcome in ('passed', 'failed')").select("outcome", F.concat_ws(" ", "object", "outcome").alias("clause"), F.when(F.col("outcome") == "passed", "is").otherwise("is_not").alias("modality"))
    plan = told._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count(NAMED_FAILURE[:20]) == 1
    assert sorted(r.outcome for r in told.collect()) == ["failed", "passed", "passed", "passed"]
    kinds = [(r.evidence_kind, r.deterministic, r.object) for r in normalize.classify_tools(calls).collect()]
    assert sorted(kinds, key=str) == sorted([("test_result", True, "pytest")] * 2 + [("command_output", False, "shell"), ("web_result", False, "web_search"), ("test_result", True, "test_result")], key=str)
