"""What moves: claims keep their texts where they are written."""

import random

from helpers import item, items
from pyspark.sql import functions as F

from testimony.functions.scale import among, crowded, cut, join_few, top_k, without_few
from testimony.operators import conflicts, extract, gate, integrity, profile, review, rulechange
from testimony.rules import DEFAULT_RULES, SIGNAL_WEIGHTS, Policy


def moved(spark) -> int:
    """Bytes shuffled and written by all stages up to now."""
    sc = spark.sparkContext
    stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), None)
    return sum(stages.apply(i).shuffleWriteBytes() + stages.apply(i).outputBytes() for i in range(stages.size()))


def test_few_partners(spark):
    df = spark.range(2000).select(F.col("id").cast("string").alias("k"), (F.col("id") % 700).alias("g"))
    few = spark.range(1990, 2010).select(F.col("id").cast("string").alias("k"), F.lit(True).alias("hit"))
    assert df.where(~among(few, "k")).join(few, "k", "left_semi").count() == 0
    assert sorted(map(tuple, join_few(df, few, "k").select("k", "g", "hit").collect()), key=str) == sorted(map(tuple, df.join(few, "k", "left").select("k", "g", "hit").collect()), key=str)
    assert {r.k for r in without_few(df, few, "k").collect()} == {str(i) for i in range(1990)}
    near = crowded(df, ["g"], 3).groupBy("g").count().where("count >= 3")
    assert {r.g: r["count"] for r in near.collect()} == {g: 3 for g in range(600)}


def test_top_k_with_and_without_lanes(spark):
    df = spark.range(3000).select("id", (F.col("id") % 3).alias("g"), F.hash("id").alias("v"))
    for k in (2, 128, 129, 400):
        got = {(r.g, r["rank"]): r.id for r in top_k(df, ["g"], [F.asc("v"), F.asc("id")], k).collect()}
        rows = sorted(df.collect(), key=lambda r: (r.v, r.id))
        assert got == {(g, i): r.id for g in range(3) for i, r in enumerate([x for x in rows if x.g == g][:k], 1)}


def test_gate_moves_no_texts(spark):
    rng = random.Random(1)
    said = [(f"p{i % 3}", f"i{i}", f"s{i // 3}", rng.randbytes(1500).hex(), "must", "create", "goal", "user_utterance", 95, "candidate", 1, ["user_utterance"]) for i in range(900)]
    names = "project_id item_id slot_id claim modality predicate category source_type confidence status evidence_count evidence_types".split()
    items = cut(spark.createDataFrame(said, names), "texts")
    before = moved(spark)
    out = gate.gate(items, Policy(), None, items.where("item_id = 'i5'").select("item_id"))
    out.write.format("noop").mode("overwrite").save()
    assert moved(spark) - before < 900 * 3000 / 10
    assert out.where("allowed").count() == 3 * 12 and out.where(F.array_contains("reasons", "blocked_as_duplicate_candidate")).count() == 1


def test_slot_budget_by_exception(spark):
    """Slots beyond their cap, ones within it, and what later stages make of both."""
    rows = [("p", f"i{i:03d}", f"s{min(i, 7) if i < 40 else i}", f"pred{i % 2}", "c", "user_utterance", "must", 90 + i % 9, [] if i % 10 else ["x"]) for i in range(80)]
    names = "project_id item_id slot_id predicate category source_type modality confidence reasons".split()
    decided = spark.createDataFrame(rows, ", ".join(f"{n} {'int' if n == 'confidence' else 'array<string>' if n == 'reasons' else 'string'}" for n in names))
    for policy in (Policy(), Policy(max_per_slot=0), Policy(max_per_predicate=0, max_per_category=0, max_allowed=0), Policy(max_per_slot=0, max_per_predicate=0, max_per_category=0, max_allowed=0)):
        left = sorted([r for r in rows if not r[8]], key=lambda r: (-r[7], r[1]))
        want = {r[1]: list(r[8]) for r in rows}
        for cap, key in (("max_per_slot", 2), ("max_per_predicate", 3), ("max_per_category", 4), ("max_allowed", 0)):
            most, seen, kept = getattr(policy, cap), {}, []
            for r in left if most else []:
                seen[r[key]] = seen.get(r[key], 0) + 1
                if seen[r[key]] <= most:
                    kept.append(r)
                else:
                    want[r[1]] = [f"blocked_by_gate_budget_{cap}"]
            left = kept if most else left
        got = gate.budget(decided, policy).collect()
        assert {r.item_id: r.reasons for r in got} == want
        assert {r.item_id for r in got if r.allowed} == {r[1] for r in left}


def test_after_review(spark):
    items = spark.createDataFrame([("a", "user_utterance", "candidate"), ("b", "user_utterance", "candidate"), ("c", "user_utterance", "candidate"), ("t", "tool_evidence", "candidate")], ["item_id", "source_type", "status"])
    reviews = spark.createDataFrame([("prop_a", 1, "reject"), ("prop_a", 2, "accept"), ("prop_b", 1, "reject"), ("prop_t", 1, "accept"), ("b", 2, "accept")], ["proposal_id", "seq", "action"])
    got = {(r.source_type, r.status, len(r.item_id) == 64 or r.item_id) for r in review.after_review(items, reviews).collect()}
    assert got == {
        ("user_utterance", "candidate", "a"),
        ("proposed_update", "accepted", True),
        ("user_utterance", "rejected", "b"),
        ("user_utterance", "candidate", "c"),
        ("tool_evidence", "candidate", "t"),
    }


def test_simulation_writes_no_texts(spark):
    """One row of each claim a scenario is written, without its texts; held claims are not included."""
    base = items(spark, item("a", source_type="proposed_update", status="accepted"), item("b", object_key="other", source_type="proposed_update", status="accepted"), item("c", modality="may"))
    for f in ("explicit_preference", "explicit_rejection", "strong_emphasis", "long_form", "repeated"):
        base = base.withColumn(f, F.lit(f == "explicit_rejection"))
    props = spark.createDataFrame([("r1", "user_explicit_rejection", 1)], "proposal_id string, signal string, new_weight long")
    pairs = sorted(SIGNAL_WEIGHTS.items())
    weights = spark.createDataFrame(pairs, "signal string, weight int")
    sim = rulechange.simulate(base, conflicts.detect_conflicts(base), props, weights)
    assert not {"claim", "object", "object_key"} & set(sim.decisions.columns) and sim.decisions.count() == 6
    assert {"claim", "object", "object_key"} < set(sim.items.columns)
    included = {(r.scenario, r.base_item) for r in sim.items.where("include_in_world_state").collect()}
    assert included == {("", "b"), ("r1", "b")}


def _bridge(spark, n: int):
    """Claims of one record each, but for every tenth, which three records support; one without an object."""
    rng = random.Random(2)
    said = []
    for i in range(n):
        object_ = None if i == 3 else rng.randbytes(700).hex()
        key = None if i == 3 else "alias" if i % 4 == 0 else object_
        for j in range(3 if i % 10 == 0 else 1):
            clause = "done" if i == 3 else f"{(object_ or '')[:-1].upper()}{object_[-1]}"
            said.append((f"i{i}", "p", "project", "goal", "create", object_, key, "must", "user_utterance", f"u{i}_{j}", "s", clause, j + 1, f"2024-01-0{j + 1}", j == 1))
    names = "item_id project_id scope subject predicate object object_key modality source_type source_id session_id clause mention_count day repeated".split()
    kinds = {"mention_count": "long", "repeated": "boolean"}
    out = spark.createDataFrame(said, ", ".join(f"{c} {kinds.get(c, 'string')}" for c in names)).withColumn("ts", F.to_timestamp("day")).drop("day")
    return out.withColumns({f: F.lit(False) for f in (*extract.FLAGS, "deterministic")})


def test_claims_of_one_record_are_not_shuffled(spark):
    bridge = cut(_bridge(spark, 600), "bridge")
    before = moved(spark)
    several, single = extract.claims_apart(bridge, spark.createDataFrame([("i7",)], ["item_id"]))
    several.unionByName(single).write.format("noop").mode("overwrite").save()
    assert moved(spark) - before < 600 * 2800 / 3
    assert {"i0", "i7", "i590"} <= {r.item_id for r in several.select("item_id").collect()} and single.count() > 500
    rows = [sorted(map(str, df.select(sorted(df.columns)).collect())) for df in (several.unionByName(single), extract.claims(bridge))]
    assert rows[0] == rows[1] and len(rows[0]) == 600


def test_objects_that_texts_tell_are_not_written(spark):
    bridge = _bridge(spark, 40)
    for keys in (True, False):
        written = extract.packed(bridge, "clause", DEFAULT_RULES, keys)
        assert written.where("object is not null").count() == 0 and written.where("object_key is not null and object_key <> 'alias'").count() == (0 if keys else written.where("not item_id = 'i3' and object_key <> 'alias'").count())
        back = extract.unpacked(written, "clause", DEFAULT_RULES)
        assert sorted(map(str, back.select(bridge.columns).collect())) == sorted(map(str, bridge.collect()))


def test_held_sides_move_no_other_claims(spark):
    base = cut(spark.range(40_000).select(F.sha2(F.col("id").cast("string"), 256).alias("item_id"), F.lit("candidate").alias("status")), "claims")
    ids = [r.item_id for r in base.limit(2).collect()]
    found = spark.createDataFrame([("c", ids[0], ids[1], "resolved", "mark_resolved", 90)], "conflict_id string, item_a string, item_b string, resolution string, resolution_type string, severity int")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", "-1")
    try:
        before = moved(spark)
        held = conflicts.held_sides(found, base).collect()
        assert {r.item_id for r in held} == set(ids) and moved(spark) - before < 40_000 * 64 / 20
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.autoBroadcastJoinThreshold")


def test_sayings_of_one_record_are_not_shuffled(spark):
    names = "item_id string, user_id string, session_id string, source_type string"
    said = [(random.Random(i).randbytes(32).hex(), f"u{i % 3}", f"s{i % 50}", "user_utterance") for i in range(4000)]
    said += [("often", "u1", f"s{i % 2}", "user_utterance") for i in range(5)] + [("often", "u2", "s9", "user_utterance"), ("agent", "u1", "s1", "agent_interpretation")]
    bridge = cut(spark.createDataFrame(said, names), "sayings")
    before = moved(spark)
    profile.sayings(bridge).write.format("noop").mode("overwrite").save()
    assert moved(spark) - before < 4000 * 64 / 2
    rows = {(r.item_id, r.user_id): (r.sessions, r.records) for r in profile.sayings(bridge).collect()}
    assert rows["often", "u1"] == (2, 5) and rows["often", "u2"] == (1, 1) and rows[said[0][:2]] == (1, 1) and len(rows) == 4002


def test_upgrade_moves_no_texts(spark):
    rng = random.Random(3)
    said = [(f"i{i}", "render" if i % 2 else "create", f"{rng.randbytes(600).hex()} read", "", True) for i in range(600)]
    items = cut(spark.createDataFrame(said, "item_id string, predicate string, claim string, object string, include_in_world_state boolean"), "upgraded")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", "-1")
    try:
        before = moved(spark)
        out = integrity.upgrade_items(items, items.where("item_id in ('i3', 'i4')"), "2", cues=("read",))
        out.drop("claim", "object").write.format("noop").mode("overwrite").save()
        assert moved(spark) - before < 600 * 1200 / 10
        rows = {r.item_id: (r.predicate, r.predicate_fixed, r.core_cleared, r.include_in_world_state) for r in out.collect()}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.autoBroadcastJoinThreshold")
    assert rows["i3"] == ("read_source", True, True, False) and rows["i4"] == ("create", False, True, False) and rows["i5"] == ("read_source", True, False, True) and len(rows) == 600
