"""Time the headline queries on one scale folder and print one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

from graphloom.plans import catalog
from graphloom.session import get_spark, local_checkpoints

HEADLINE = (
    "agg1_count_where", "agg2_count_members", "top1_argmax", "jn1_lookup", "jn4_edition_walk", "jn8_venue_events",
    "top2_cosine", "etl12_parse_documents", "etl14_chunks", "grf3_edition_links", "jn13_mentions", "fn3_normalize_answer",
    "ev2_token_f1_texts", "agg5_run_summary", "agg8_gaps_by_type", "ev6_verdicts", "ev21_citations", "win3_numbered_steps",
    "str2_latest_record",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    catalog.load()
    spark = local_checkpoints(get_spark("bench", master=f"local[{cpus}]"))
    spark.sparkContext.setLogLevel("ERROR")
    # Start-up and first-use costs stay out of the first query's time.
    spark.read.parquet(f"{sf_dir}/nation.parquet").count()
    times: dict[str, float] = {}
    for name in HEADLINE:
        start = time.perf_counter()
        catalog.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        print(f"{name} {times[name]}", file=sys.stderr, flush=True)
    print(
        json.dumps(
            {"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
             "sf": os.path.basename(sf_dir.rstrip("/"))}
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
