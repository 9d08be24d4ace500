"""Time the headline queries and print one JSON line.

BENCH_SF_DIR names the tables, BENCH_CPUS the number of local cores.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from kindred.plans import QUERIES
from kindred.session import build_session

HEADLINE = [
    "user_profile",
    "recommend_topk",
    "recommend_threshold",
    "recommend_mmr",
    "recommend_maxsum",
    "recommend_xquad",
    "recommend_final",
    "run_experiment",
    "tfidf_vectors",
    "tfidf_topn",
    "tfidf_cosine_pairs",
    "two_stage_single",
    "two_stage_profile",
    "hybrid_similarity",
    "pair_self_join",
    "recommend_final_clustered",
    "cosine_pairs_dense",
    "histogram_numeric",
    "ffill_group_marker",
    "page_text",
]


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "4")
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        spark__sql__shuffle__partitions=str(max(8, int(cpus))),
        spark__ui__enabled="false",
        spark__driver__memory="16g",
        spark__ui__showConsoleProgress="false",
    )
    spark.sparkContext.setLogLevel("ERROR")
    names = sys.argv[1:] or HEADLINE
    warm = os.environ.get("BENCH_WARM_DIR", os.path.join(os.path.dirname(sf), "sf0.01"))
    taken = {}
    for name in names:
        if os.path.isdir(warm):
            QUERIES[name](spark, warm).write.format("noop").mode("overwrite").save()
        start = time.perf_counter()
        QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
        taken[name] = round(time.perf_counter() - start, 3)
        print(f"{name} {taken[name]}", file=sys.stderr, flush=True)
    scale = re.search(r"sf([\d.]+)", sf)
    print(
        json.dumps(
            {
                "metric": "total wall time of the headline queries",
                "value": round(sum(taken.values()), 3),
                "unit": "sec",
                "queries": taken,
                "sf": float(scale[1]) if scale else sf,
            }
        )
    )


if __name__ == "__main__":
    main()
