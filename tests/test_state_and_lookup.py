from __future__ import annotations

import math
import random

import numpy as np
import pytest
from helpers import by, item, items
from pyspark.sql import functions as F

from testimony.functions.scale import as_of_last, fit_budget, top_k
from testimony.operators import context, gate, index_store, lookup, state


def world(**kw):
    base = dict(source_type="proposed_update", status="accepted", modality="must", subject="compact_world_state", predicate="render", include_in_world_state=True, confidence=98)
    return {**base, **kw}


def test_compact_selection_filters(spark):
    rows = items(
        spark,
        item("in", **world(object="top rules", object_key="a")),
        item("low", **world(confidence=94, object_key="b")),
        item("lower", **world(confidence=90, object_key="c")),
        item("global", **world(scope="user_global", confidence=99, object_key="d")),
        item("may", **world(modality="may", object_key="e")),
    )
    built = state.build_state(rows, None).first()
    assert built.compact_structured_count == 1 and "必须渲染：top rules" in built.compact_state and built.compact_characters <= 1600
    assert built.structured_count == 5


def test_legacy_render_reads(spark):
    rows = items(spark, item("x", **world(object="每次任务前必须先读 WORLD_STATE.md")))
    assert "必须读取：每次任务前必须先读 WORLD_STATE.md" in state.build_state(rows, None).first().compact_state


def test_gate_output_rules_alone(spark):
    rows = items(spark, item("a", **world(object_key="a")), item("b", **world(object_key="b")))
    decisions = gate.gate(rows).withColumn("allowed", F.col("item_id") == "b")
    assert [r.item_id for r in state.state_items(rows, decisions).collect()] == ["b"]
    assert {r.item_id for r in state.state_items(rows).collect()} == {"a", "b"}


def test_budget_is_never_exceeded_and_doctrine_comes_first(spark):
    rows = items(spark, *[item(f"i{n:03d}", **world(object=f"rule number {n} " * 3, object_key=str(n))) for n in range(120)])
    built = state.build_state(rows, None, budget=700).first()
    assert built.characters <= 700 and len(built.state) < 700 and built.state.startswith("- User evidence")
    lines = built.state.split("\n")
    assert len(lines) == built.structured_count + 4


def taken(rows, budget):
    """What fits, row by row."""
    out, left = [], budget
    for key, cost in rows:
        if cost <= left:
            out.append(key)
            left -= cost
    return out, budget - left


def test_budget_against_brute_force(spark):
    df = spark.range(3000).selectExpr("id % 3 AS g", "sha2(cast(id AS string), 256) AS item_id", "5 + pmod(xxhash64(id), 40) * pmod(id, 5) AS cost_in", "map('a', id) AS extra")
    rows = df.collect()
    for budget in (60, 9000):
        got = fit_budget(df, ["g"], [F.asc("item_id")], F.col("cost_in"), budget, min_cost=5).collect()
        for g in range(3):
            mine = sorted((r for r in got if r.g == g), key=lambda r: r["rank"])
            want, total = taken(sorted((r.item_id, r.cost_in) for r in rows if r.g == g), budget)
            assert [r.item_id for r in mine] == want and [r["rank"] for r in mine] == list(range(1, len(want) + 1)) and mine[-1].running == total


def test_budget_goes_on_after_a_row_that_does_not_fit(spark):
    df = spark.createDataFrame([("g", 1, 900), ("g", 2, 900), ("g", 3, 50), ("g", 4, 50), ("h", 1, 2000), (None, 1, 7)], "g string, n int, c int")
    got = sorted(((r.g or ""), r.n) for r in fit_budget(df, ["g"], [F.asc("n")], F.col("c"), 1600).collect())
    assert got == [("", 1), ("g", 1), ("g", 3), ("g", 4)]
    assert fit_budget(df.limit(0), ["g"], [F.asc("n")], F.col("c"), 1600).collect() == []


def test_top_k_beyond_the_group_limit(spark):
    df = spark.range(4000).selectExpr("1 AS g", "id AS item_id", "(id * 7919) % 4001 AS v")
    got = [r.v for r in top_k(df, ["g"], [F.desc("v"), F.asc("item_id")], 1500).orderBy("rank").collect()]
    assert got == sorted((r.v for r in df.collect()), reverse=True)[:1500]


def test_as_of_over_bucket_borders(spark):
    states = spark.createDataFrame([("s", 10, "m1"), ("s", 4000, "m2"), ("s", 9000, "m3"), ("t", 5, "m4")], "k string, t long, m string")
    events = spark.createDataFrame([(1, "s", 5), (2, "s", 10), (3, "s", 3999), (4, "s", 8999), (5, "s", 90000), (6, "t", 50), (7, "u", 1)], "id int, k string, t long")
    at = lambda df: df.withColumn("ts", F.timestamp_seconds("t")).drop("t")
    got = {r.id: r.m for r in as_of_last(at(events), at(states), ["k"], "ts", ["m"], "id").collect()}
    assert got == {1: None, 2: "m1", 3: "m1", 4: "m2", 5: "m3", 6: "m4", 7: None}


RECORDS = [("p", "u1", "user_utterance", "Never inject the whole history."), ("p", "t1", "tool_evidence", "history lookup passed"), ("p", "t2", "tool_call", "nothing here")]


def records(spark):
    return spark.createDataFrame(RECORDS, "project_id string, source_id string, source_type string, text string")


def test_index_is_record_level(spark):
    index = lookup.evidence_index(records(spark))
    rows = by(index, "source_id")
    assert set(rows) == {"u1", "t1", "t2"} and all(r.record_level and not r.chunked and r.segment_index == 0 for r in rows.values())
    assert {r.source_type: r.segment_count for r in lookup.index_stats(index).collect()} == {"user_utterance": 1, "tool_evidence": 1, "tool_call": 1}


def test_term_lookup_against_brute_force(spark, tmp_path):
    """Scores of everything, against a lookup that leaves common terms out; many ties, and terms that nobody has."""
    r = random.Random(4)
    common = [f"c{i}" for i in range(6)]
    texts = [" ".join(w for w in [*common, *[f"r{r.randrange(60)}" for _ in range(5)], f"own{n % 90}"] if r.random() < 0.7) for n in range(300)]
    rows = [(f"p{n % 3}", f"s{n:03d}", "utterance", t) for n, t in enumerate(texts)] + [("p0", "none", "utterance", None), (None, "lost", "utterance", "c1 r1")]
    asked = [(i, " ".join([*r.sample(common, 4), *[f"r{r.randrange(70)}" for _ in range(3)], f"own{r.randrange(95)}"])) for i in range(25)] + [(90, "c0 c1"), (91, "nobody says"), (92, None), (93, " ".join(common))]
    frame = spark.createDataFrame(rows, "project_id string, source_id string, source_type string, text string")
    assert {x.action for x in index_store.refresh_index(frame, str(tmp_path)).collect()} == {"built"}
    held = {s: set((t or "").split()) for p, s, _, t in rows if p}
    n = {w: sum(w in v for v in held.values()) for w in set().union(*held.values())}
    want = set()
    for q, text in asked:
        words = {w for w in (text or "").split() if w in n}
        scored = sorted((-sum(math.floor(1000 * math.log(1 + len(held) / n[w])) for w in words & v), s, len(words & v)) for s, v in held.items() if words & v)
        want |= {(q, s, -score, shared, i + 1) for i, (score, s, shared) in enumerate(scored[:5])}
    queries = spark.createDataFrame(asked, "query_id int, text string")
    got = index_store.lookup_terms(spark, str(tmp_path), queries)
    assert {tuple(x) for x in got.select("query_id", "source_id", "score", "shared_terms", "rank").collect()} == want
    ids = index_store.lookup_by_id(spark, str(tmp_path), spark.createDataFrame([("s007",), ("gone",)], "source_id string"))
    assert [x.source_id for x in ids.collect()] == ["s007"] and "PartitionFilters: [bucket" in ids._jdf.queryExecution().toString()
    best = lookup.ground(index_store.lookup_terms(spark, str(tmp_path), queries.where("query_id = 90"), k=1), frame).first()
    assert best.text == texts[int(best.source_id[1:])]


def test_refresh_touches_what_changed(spark, tmp_path):
    cols = "project_id string, source_id string, source_type string, text string"
    frame = lambda *rows: spark.createDataFrame([(p, s, "utterance", t) for p, s, t in rows], cols)
    path = str(tmp_path)
    refresh = lambda *rows: {r.project_id: r.action for r in index_store.refresh_index(frame(*rows), path).collect()}
    assert index_store.manifest(spark, path).count() == 0
    assert refresh(("a", "1", "x"), ("b", "2", "y"), ("c", "3", "z")) == {"a": "built", "b": "built", "c": "built"}
    assert refresh(("a", "1", "x"), ("b", "2", "y"), ("c", "3", "z")) == {"a": "kept", "b": "kept", "c": "kept"}
    assert index_store.manifest(spark, path).first().edition == 1
    assert refresh(("a", "1", "x"), ("b", "2", "new"), ("d", "4", "y")) == {"a": "kept", "b": "rebuilt", "c": "removed", "d": "built"}
    held = index_store.stored(spark, path, "records")
    assert {(r.project_id, r.text, r.version) for r in held.collect()} == {("a", "x", 1), ("b", "new", 2), ("d", "y", 2)}
    found = index_store.lookup_terms(spark, path, spark.createDataFrame([(1, "y z")], "query_id int, text string"))
    assert [(r.source_id, r.shared_terms) for r in found.collect()] == [("4", 1)]
    assert sorted(p.name for p in (tmp_path / "records").iterdir() if "=" in p.name) == [f"project_id={x}" for x in "abcd"]
    assert [p.name for p in (tmp_path / "records/project_id=a").iterdir()] == ["version=1"]


def test_vector_lookup(spark):
    vecs = spark.createDataFrame([(1, [3.0, 0.0], 0), (2, [1.0, 1.0], 0), (3, [0.0, 2.0], 1), (4, [0.0, 0.0], 1)], "vec_id int, embedding array<float>, label int")
    index = lookup.vector_index(vecs)
    q = spark.createDataFrame([(7, [1.0, 0.0])], "query_id int, unit array<double>")
    got = [(r.vec_id, r.similarity) for r in lookup.vector_topk(index, q, k=2).orderBy("rank").collect()]
    assert got == [(1, 1.0), (2, round(1 / math.sqrt(2), 6))]
    many = spark.range(30).selectExpr("cast(id as int) as query_id", "array(1.0D, 0.0D) as unit")
    assert lookup.vector_topk(index, many, k=2, block=4).groupBy("vec_id").count().collect() == lookup.vector_topk(index, many, k=2).groupBy("vec_id").count().collect()
    assert index.where("record_level_no_split").count() == 4
    cents = {r.query_id: r.unit for r in lookup.centroids(vecs, "label").collect()}
    assert cents[1] == [0.0, 1.0]


@pytest.mark.parametrize("cells", [1, 7, 64])
def test_pruned_vectors_match_brute_force(spark, cells):
    """Clouds of vectors with copies, so that there are ties; a null and a zero vector; queries that are no records."""
    r = np.random.default_rng(6)
    middles = r.normal(size=(9, 12))
    rows = [(i, [float(x) for x in middles[i % 9] + 0.05 * r.normal(size=12)]) for i in range(270)] + [(i, [float(x) for x in middles[0]]) for i in range(270, 280)] + [(280, [0.0] * 12), (281, None)]
    index = lookup.vector_index(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    asked = [(i, [float(x) for x in (middles[i % 9] + 0.1 * r.normal(size=12))]) for i in range(20)] + [(20, [float(x) for x in middles[0]])]
    queries = lookup.vector_index(spark.createDataFrame(asked, "query_id long, embedding array<double>")).select("query_id", "unit")
    unit = {i: np.array(v) / np.linalg.norm(v) for i, v in rows if v and any(v)}
    want = set()
    for q, v in asked:
        v = np.array(v) / np.linalg.norm(v)
        for rank, (s, i) in enumerate(sorted((-round(float(u @ v), 6), i) for i, u in unit.items())[:6], 1):
            want.add((q, i, -s, rank))
    told: dict = {}
    got = {tuple(x) for x in lookup.vector_topk(index, queries, k=6, block=8, cells=cells, told=told).collect()}
    assert {(q, i, rank) for q, i, _, rank in got} == {(q, i, rank) for q, i, _, rank in want} and all(abs(a[2] - b[2]) < 2e-6 for a, b in zip(sorted(got), sorted(want), strict=True))
    assert told["pairs"] == 21 * 280 and (told["scored"] < 0.6 * told["pairs"] if cells == 64 else told["scored"] <= told["pairs"])
    assert lookup.vector_topk(index.limit(0), queries, k=2).collect() == lookup.vector_topk(index, queries.limit(0), k=2).collect() == []


def test_unchanged_inputs_are_skipped(spark):
    now = lookup.fingerprints(records(spark), ("source_id", "text"))
    again = lookup.fingerprints(records(spark).repartition(3), ("source_id", "text"))
    assert lookup.stale_projects(now, again).count() == 0
    changed = lookup.fingerprints(records(spark).where("source_id <> 't2'"), ("source_id", "text"))
    assert [r.project_id for r in lookup.stale_projects(changed, now).collect()] == ["p"]


def test_context_selection(spark):
    rows = items(
        spark,
        item("ctx_relevant", claim="governance policy selects rules for a task", object="rules", object_key="k1"),
        item("ctx_irrelevant", claim="database migration notes", object="notes", object_key="k2"),
        item("ctx_conditional", claim="governance policy under a condition", object="c", object_key="k3"),
        item("ctx_not_admitted", claim="governance policy candidate", object="n", object_key="k4"),
    )
    pool = rows.where("item_id <> 'ctx_not_admitted'").withColumn("conditional_block", F.col("item_id") == "ctx_conditional")
    tasks = spark.createDataFrame([("p", "s", "governance policy")], "project_id string, session_id string, task string")
    relevant = context.relevance(pool, tasks)
    chosen = context.select_context(pool, tasks, 900)
    out = context.exclusions(rows, tasks, pool, relevant, chosen)
    r = out.first()
    assert (r.included, r.not_admitted, r.conditional_conflict_block, r.not_task_relevant, r.over_budget) == (1, 1, 1, 1, 0)
    prints = lookup.fingerprints(rows, ("item_id",))
    m = context.manifests(chosen, out, "rules", "policy_hash", prints, 900).first()
    assert m.included_cognition_ids == ["ctx_relevant"] and m.gate_policy_hash == "policy_hash" and m.mutates_state is False and m.prompt_fingerprint
    tight = context.select_context(pool, tasks, 5)
    assert tight.count() == 0 and context.exclusions(rows, tasks, pool, relevant, tight).first().over_budget == 1


def test_lookup_keeps_few_pairs_of_common_terms(spark, tmp_path, monkeypatch):
    """A record that is tried first holds a whole query of common terms: others, which hold half of them, are kept only where they hold its rarest."""
    rng = random.Random(8)
    words = [f"word{i}" for i in range(24)]
    rows = [("p", f"s{i:03d}", "user_utterance", " ".join(words if i == 0 else rng.sample(words, 12))) for i in range(300)]
    frame = spark.createDataFrame(rows, ["project_id", "source_id", "source_type", "text"])
    index_store.refresh_index(frame, str(tmp_path))
    written, cut = {}, index_store.cut
    monkeypatch.setattr(index_store, "cut", lambda df, name: written.setdefault(name, cut(df, name)))
    queries = spark.createDataFrame([(1, " ".join(words))], ["query_id", "text"])
    best = index_store.lookup_terms(spark, str(tmp_path), queries, k=1).collect()
    assert [(r.source_id, r.shared_terms, r["rank"]) for r in best] == [("s000", 24, 1)]
    assert written["lookup-found"].count() < 160
