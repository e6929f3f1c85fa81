"""Headline timings: index build, then search queries over the built index.

Env: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8).
Prints one JSON line. Each query is run to completion with the no-op sink
(every row computed, nothing collected to the driver).
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = (
    "match_term",
    "match_and",
    "match_phrase",
    "match_prefix",
    "match_near",
    "bm25_scores",
    "search_relevance",
    "search_count",
    "browse",
    "batch_search",
    "annotate_docs",
    "category_counts",
    "upsert_merge",
    "index_upsert",
    "auth_outcome",
    "request_bursts",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    from quire import registry as R
    from quire.session import local_session

    spark = local_session(cpus=cpus, shuffle_partitions=max(8, cpus * 2), app="quire-bench")
    times: dict[str, float] = {}
    t0 = time.time()
    R.ctx(spark, sf_dir)  # tokenise + write postings/docs/terms/corpus
    times["index_build"] = round(time.time() - t0, 3)
    for name in HEADLINE:
        fn = R.QUERIES[name]
        t = time.time()
        fn(spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - t, 3)
    sf = os.path.basename(sf_dir).replace("sf", "")
    print(
        json.dumps(
            {
                "metric": "total_sec",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": float(sf) if sf.replace(".", "").isdigit() else sf,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
