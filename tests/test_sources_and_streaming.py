from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from testimony.operators import context, feedback, normalize
from testimony.plans import govern
from testimony.sources import runlog, sinks
from testimony.sources.transcripts import backfill, read_transcript_stream, read_transcripts, with_record_ids
from testimony.streaming import ingest


def write(path, rows):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("\n".join(r if isinstance(r, str) else json.dumps(r, ensure_ascii=False) for r in rows) + "\n", encoding="utf-8")


def turn(i, user, assistant="done"):
    at = f"2026-01-01T00:{i:02d}:00Z"
    return [{"role": "user", "content": user, "timestamp": at}, {"role": "assistant", "content": assistant, "timestamp": at}]


def test_transcripts_keep_bad_lines_and_sessions(spark, tmp_path):
    write(tmp_path / "proj" / "s1.jsonl", [*turn(1, "hello"), "{broken", {"role": "tool", "name": "pytest", "content": "3 passed", "timestamp": "2026-01-01T00:02:00Z"}])
    rows = read_transcripts(spark, str(tmp_path / "proj")).collect()
    assert {(r.project_id, r.session_id) for r in rows} == {("proj", "s1")}
    assert sum(r.corrupt_record is not None for r in rows) == 1 and len(rows) == 4
    assert {r.role: r.name for r in rows if r.role}["tool"] == "pytest"


def test_transcripts_are_governed_end_to_end(spark, tmp_path):
    at = {"timestamp": "2026-02-01T08:00:00Z"}
    lines = [
        {"role": "user", "content": "The crane must stand still.", **at},
        {"role": "assistant", "content": "The crane must turn.", **at},
        {"role": "tool", "name": "pytest", "content": "5 passed, 0 failed", **at},
        {"role": "user", "content": "The fog bell tolls every nine seconds. Ships must not wait.", **at},
    ]
    write(tmp_path / "harbour" / "day.jsonl", lines)
    records = with_record_ids(read_transcripts(spark, str(tmp_path / "harbour")))
    foreign = spark.createDataFrame([("the fog bell tolls every nine seconds",)], "text string")
    run = govern.govern(ingest.utterances_of(records), normalize.classify_tools(ingest.tools_of(records)), passages=foreign)
    rows = {(r.source_type, r.predicate, r.object_key) for r in run.decisions.collect()}
    assert {k[:2] for k in rows} == {("user_utterance", "requires"), ("tool_evidence", "test_passed")}
    assert any(k[2] == "pytest" for k in rows)


def test_backfill_takes_named_files_only(spark, tmp_path):
    for s in ("a", "b", "c"):
        write(tmp_path / "p" / f"{s}.jsonl", turn(1, s))
    rows = backfill(spark, [str(tmp_path / "p" / "a.jsonl"), str(tmp_path / "p" / "b.jsonl")])
    assert {r.session_id for r in rows.collect()} == {"a", "b"}
    with pytest.raises(ValueError):
        backfill(spark, str(tmp_path / "p"))


def test_stream_of_turns_equals_one_batch(spark, tmp_path):
    src = tmp_path / "p"
    texts = ["You must not create AGENTS.md.", "You may create AGENTS.md.", "You must not create AGENTS.md."]
    for i, text in enumerate(texts):
        write(src / f"t{i}.jsonl", turn(i, text))
    write(src / "t0copy.jsonl", turn(0, texts[0]))

    def run(name, files):
        store, seen = str(tmp_path / name), []
        lines = read_transcript_stream(spark, str(src), "p", max_files=files).withColumn("session_id", F.lit("s"))
        q = ingest.ingest_stream(lines, store, str(tmp_path / f"{name}_ck"), then=lambda df, n: seen.append(df.count()))
        q.awaitTermination()
        return ingest.stored_records(spark, store), seen

    one, _ = run("one", 100)
    many, batches = run("many", 1)
    assert len(batches) >= 4 and sum(batches) == many.count()
    pick = ["record_id", "role", "content"]
    assert sorted(map(tuple, one.select(*pick).collect())) == sorted(map(tuple, many.select(*pick).collect()))
    assert many.count() == 6

    a = govern.govern(ingest.utterances_of(one))
    b = govern.govern(ingest.utterances_of(many))
    key = ["item_id", "confidence", "evidence_count", "status"]
    assert sorted(map(tuple, a.items.select(*key).collect())) == sorted(map(tuple, b.items.select(*key).collect()))
    assert a.conflicts.count() == b.conflicts.count() == 1


def test_replayed_batch_changes_nothing(spark, tmp_path):
    write(tmp_path / "p" / "s.jsonl", turn(1, "x"))
    lines, store = read_transcripts(spark, str(tmp_path / "p")), str(tmp_path / "store")
    for n in (0, 0, 1):
        ingest.ingest_batch(lines, n, store)
    assert ingest.stored_records(spark, store).count() == 2
    assert with_record_ids(lines).select("record_id").distinct().count() == 2


def test_once_only_delivery_stream_and_batch(spark, tmp_path):
    schema = "project_id string, session_id string, ts timestamp, request_id int"
    rows = spark.createDataFrame([("p", "s", 1, 1), ("p", "s", 2, 2), ("q", "s", 3, 3)], "project_id string, session_id string, t long, request_id int")
    rows = rows.select("project_id", "session_id", F.timestamp_seconds("t").alias("ts"), "request_id")
    assert {(r.project_id, r.request_id) for r in context.inject_once(rows).collect()} == {("p", 1), ("q", 3)}
    rows.write.parquet(str(tmp_path / "in"))
    out = ingest.inject_once_stream(spark.readStream.schema(schema).parquet(str(tmp_path / "in")))
    q = out.writeStream.format("memory").queryName("delivered").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("delivered").groupBy("project_id").count().filter("count > 1").count() == 0
    assert spark.table("delivered").count() == 2


def test_daily_feedback_stream_equals_batch(spark, tmp_path):
    rows = spark.range(100).select(F.timestamp_seconds(F.col("id") * 3600).alias("ts"), F.when(F.col("id") % 2 == 0, "drift").otherwise("test").alias("event_family"), F.lit("negative").alias("outcome"))
    rows.write.parquet(str(tmp_path / "in"))
    stream = feedback.daily(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")), watermark="1 hour")
    q = stream.writeStream.outputMode("complete").format("memory").queryName("trend").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(map(tuple, spark.table("trend").collect())) == sorted(map(tuple, feedback.daily(rows).collect()))


def test_sinks_append_raw_and_replace_derived(spark, tmp_path):
    raw, derived = str(tmp_path / "raw"), str(tmp_path / "derived")
    a = spark.createDataFrame([("p", 1), ("q", 2)], "project_id string, v int")
    b = spark.createDataFrame([("q", 3)], "project_id string, v int")
    for df in (a, b):
        sinks.append_raw(df, raw)
        sinks.replace_derived(df, derived)
    assert spark.read.parquet(raw).count() == 3
    assert {(r.project_id, r.v) for r in spark.read.parquet(derived).collect()} == {("p", 1), ("q", 3)}


def test_run_summary_drops_members_and_fingerprints(spark):
    noisy = {
        "hook": "nightly", "session_id": "harbour", "ingested": True, "step_count": 4, "step_scripts": ["load", "sweep"],
        "conflicts": {"new_conflicts": 5, "total_conflicts": 11, "pairs": ["a", "b"]},
        "conflict_clusters": {"total_conflicts": 11, "cluster_count": 7, "clusters": ["member " * 90]},
        "evidence_index": {"segment_count": 40, "source_types": {"tool_evidence": 31, "user_utterance": 9}, "source_fingerprint": "ff", "skipped": False},
    }
    raws = [json.dumps(noisy), "spray " * 300, "[\"x\"]", ""]
    df = spark.createDataFrame(list(enumerate(raws)), "i int, raw string")
    obj, text, arr, empty = runlog.summarize_runs(df).orderBy("i").collect()
    assert obj.raw_stdout_chars == len(raws[0]) and obj.summary.conflicts.total_conflicts == 11 and obj.summary.evidence_index.source_types == {"tool_evidence": 31, "user_utterance": 9}
    assert "clusters" not in obj.summary.conflict_clusters.asDict() and "source_fingerprint" not in obj.summary.evidence_index.asDict()
    assert text.stdout_tail == raws[1][-1000:] and text.summary is None
    assert arr.stdout_type == "list" and empty.raw_stdout_chars is None
