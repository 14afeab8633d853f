"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) choose data and threads.
Every query is written to the noop sink, so all of its rows and columns are computed.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

HEADLINE = [
    "recency_topk",
    "recent_per_person",
    "company_lookup",
    "person_provenance",
    "person_source_lists",
    "people_per_source",
    "source_status",
    "semantic_topk_batch",
    "words_topk",
    "question_routing",
    "routed_answers",
    "message_fanout",
    "calendar_fanout",
    "contact_records",
    "upsert_latest",
    "upsert_undelete",
    "apply_deletions",
    "absent_reconcile",
    "alias_then_email",
    "resolve_orders",
    "resolve_batch",
    "fuzzy_review_pairs",
    "review_queue",
    "merge_sources",
    "reembed_chunks",
    "stream_sync_replay",
]


def main() -> None:
    from kinweave.plans.queries import QUERIES
    from kinweave.session import build_session

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        f"local[{cpus}]",
        int(cpus),
        app="bench",
        **{
            "spark.ui.enabled": "false",
            "spark.driver.memory": os.environ.get("BENCH_MEMORY", "12g"),
            "spark.ui.showConsoleProgress": "false",
        },
    )
    QUERIES["network_counts"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in HEADLINE:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
        print(f"{name} {seconds[name]}", file=sys.stderr, flush=True)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": Path(sf_dir).name.removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
