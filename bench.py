"""Benchmark: run the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]
and print ONE JSON line.

Each query is executed in full with a ``noop`` write (every row computed,
nothing collected to the driver).  One warm-up pass, then the best of
$BENCH_REPS timed passes per query.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from trajframe.plans.catalog import load_all  # noqa: E402
from trajframe.session import get_spark  # noqa: E402

HEADLINE = [
    "compose_action_formal",     # minimum slice: filter + renumber, sentinel history, rules, text
    "compose_action_sg",         # + sub-goal runs
    "win_loop_stop",
    "join_vector_similarity",
    "align_trajectories",
    "join_token_overlap",
    "win_seen_objects",
    "agg_corpus_bleu",
    "explode_annotations",
    "win_segment_markers",
]


def run(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    reps = int(os.environ.get("BENCH_REPS", "2"))
    names = os.environ.get("BENCH_QUERIES", ",".join(HEADLINE)).split(",")
    spark = get_spark("bench", cpus=cpus, shuffle_partitions=int(os.environ.get("BENCH_SHUFFLE_PARTITIONS", cpus)))
    qs = load_all()
    out: dict[str, float] = {}
    rows: dict[str, int] = {}
    for n in names:
        fn = qs[n][0]
        run(fn(spark, sf_dir))                      # warm-up (JIT, file listing, python workers)
        best = None
        for _ in range(reps):
            t = time.perf_counter()
            run(fn(spark, sf_dir))
            dt = time.perf_counter() - t
            best = dt if best is None else min(best, dt)
        out[n] = round(best, 3)
    ev = spark.read.parquet(f"{sf_dir}/events.parquet").count()
    rows["events"] = ev
    sf = sf_dir.rstrip("/").rsplit("sf", 1)[-1]
    total = round(sum(out.values()), 3)
    print(json.dumps({"metric": "headline_total", "value": total, "unit": "sec", "queries": out,
                      "sf": float(sf) if sf.replace(".", "").isdigit() else sf,
                      "events": ev, "events_per_sec_flagship": round(ev / out[names[0]], 1) if out.get(names[0]) else None,
                      "cpus": cpus}))


if __name__ == "__main__":
    main()
