"""Seconds per headline query on the driver's tables; prints one JSON line.

The claim bridge and the governed claims are built once, timed as ``shared``; every query's seconds are its own on top.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from contract.check import local_session  # noqa: E402
from contract.lift import Lift  # noqa: E402
from contract.queries import OVER_LIFT  # noqa: E402

HEADLINE = (
    "ingest_counts",
    "clean_evidence",
    "tool_evidence_kind",
    "utterance_signals",
    "structured_claims",
    "detect_conflicts",
    "conflict_volume",
    "cluster_duplicates",
    "admission",
    "compact_state",
    "lookup_terms",
    "vector_topk",
    "context_manifest",
    "feedback_report",
    "drift_attribution",
    "dangling_refs",
    "profile_candidates",
    "simulate_diff",
)


def main(names: list[str]) -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"))
    spark.range(1000).selectExpr("sum(id)").collect()
    times = {}
    lift = Lift(spark, sf_dir)
    start = time.perf_counter()
    for table in (lift.bridge, lift.governed):
        table.write.format("noop").mode("overwrite").save()
    times["shared"] = round(time.perf_counter() - start, 3)
    print("shared", times["shared"], file=sys.stderr, flush=True)
    for name in names or HEADLINE:
        start = time.perf_counter()
        OVER_LIFT[name](lift).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        print(name, times[name], file=sys.stderr, flush=True)
    spark.stop()
    sf = Path(sf_dir).name.removeprefix("sf")
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": float(sf) if sf.replace(".", "", 1).isdigit() else sf}))


if __name__ == "__main__":
    main(sys.argv[1:])
