"""What plans hold: few joins and small tasks, however often a table is asked."""

from helpers import item, items
from pyspark.sql import functions as F

from testimony.functions.scale import apart, crowd, crowded, cut, join_few, key_filter, without_few
from testimony.operators import cluster, conflicts, gate, integrity
from testimony.plans import govern
from testimony.rules import Policy


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_filters_are_written_and_sent_once(spark):
    df = cut(spark.range(300).select(F.col("id").cast("string").alias("k"), (F.col("id") % 100).alias("g")), "rows")
    few = cut(spark.range(10).select(F.col("id").cast("string").alias("k"), F.lit(True).alias("hit")), "few")
    for out in (join_few(join_few(df, few, "k"), few.withColumnRenamed("hit", "again"), "k"), without_few(df, few, "k"), crowded(df, ["g"])):
        assert "Subquery" not in plan_of(out) and "collect_list" not in plan_of(out)


def test_rows_apart(spark):
    """Each row is on one side, ones with null keys and ones that come twice as well; all that a filter names is on the first."""
    said = [(None, 1), (None, 1), ("a", 1), ("a", 1), ("b", 2), ("c", 3), ("d", None)] + [(f"x{i}", 10 + i) for i in range(50)]
    df = cut(spark.createDataFrame(said, "k string, g int"), "rows")
    few = spark.createDataFrame([("a",), (None,)], "k string")
    near, far = apart(df, (key_filter(few, "k"), F.col("k")), crowd(df, ["g"]))
    assert near.columns == far.columns == ["k", "g"]
    near, far = [sorted(map(tuple, x.collect()), key=str) for x in (near, far)]
    assert sorted(near + far, key=str) == sorted(said, key=str) and [x for x in near if x in said[:4]] == sorted(said[:4], key=str) and len(far) > 40


def _governed(spark):
    base = items(spark, item("a"), item("b", modality="may", source_type="agent_interpretation", confidence=74), item("c", object_key="other"), item("d", object_key="other"))
    found = conflicts.detect_conflicts(base)
    acts = found.select("conflict_id", F.lit("choose-a").alias("action"), F.lit("").alias("condition"), F.lit("r").alias("reason"), F.lit(1).alias("seq"))
    return base, govern.settled(cut(base, "items"), cut(conflicts.resolve(found, acts), "resolved")), conflicts.resolve(found, acts)


def test_settled_claims_are_read_not_joined_again(spark):
    _, governed, _ = _governed(spark)
    plan = plan_of(governed)
    assert "SortMergeJoin" not in plan and "Aggregate" not in plan and "BroadcastHashJoin" not in plan
    rows = {r.item_id: (r.status, r.superseded_by) for r in governed.collect()}
    assert rows["c"] == ("candidate", None) and sorted(rows[x][0] for x in "ab") == ["candidate", "superseded"] and len(rows) == 4


def test_drift_report_plans_each_metric_alone(spark):
    base, governed, resolved = _governed(spark)
    decisions = gate.gate(governed, Policy(), resolved, cluster.duplicates(governed))
    state = base.select("project_id").distinct().withColumn("compact_characters", F.lit(7))
    report = integrity.drift_report(governed, resolved, decisions, cluster.clusters(governed), state)
    assert "Join" not in plan_of(report) and "Exchange" not in plan_of(report)
    rows = {r.metric: r.value for r in report.collect()}
    assert rows["items"] == 4 and rows["compact_characters"] == 7 and rows["governance_allowed_count"] + rows["governance_blocked_count"] == 4
