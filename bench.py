"""Headline-query benchmark: one JSON line on stdout.

Runs the flagship queries of SURVEY 7.6 on ``$BENCH_SF_DIR`` (default
/root/testdata/sf0.1) with ``local[$BENCH_CPUS]``.  Each query -- plan
construction included -- is forced to completion with the ``noop`` sink (no
driver collection).  ``queries`` holds the best of ``$BENCH_REPEAT`` (default
2) runs, i.e. the steady state once code generation for that plan shape is
warm; ``cold_queries`` holds each query's first run.  ``value`` is the sum of
``queries``.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

ROOT = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, ROOT)

HEADLINE = [
    "kg_three_hop", "kg_priciest_order", "kg_two_hop_compare", "kg_valid_during", "kg_label_prefix",
    "kg_paths_batch", "kg_triangle", "forms_clean_score", "forms_mentions_rewrite", "bleu_conversations",
    "rouge_conversations", "link_vectors", "centroids_outliers", "prompts_split", "query_classes",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    only = os.environ.get("BENCH_QUERIES")
    from kgflow.plans.catalog import CATALOG
    from kgflow.session import local_session
    spark = local_session(cpus, shuffle_partitions=int(os.environ.get("BENCH_SHUFFLE", "8")))
    names = only.split(",") if only else HEADLINE
    # warm the JVM (codegen, readers, Python workers) on the smallest tables
    warm = os.environ.get("BENCH_WARM_DIR", "/root/testdata/sf0.001")
    if os.path.isdir(warm):
        for w in ("kg_three_hop", "bleu_conversations"):
            CATALOG[w][0](spark, warm).write.format("noop").mode("overwrite").save()
    repeat = max(1, int(os.environ.get("BENCH_REPEAT", "2")))
    times, cold = {}, {}
    for name in names:
        fn, _ = CATALOG[name]
        runs = []
        for _ in range(repeat):
            t0 = time.perf_counter()
            fn(spark, sf_dir).write.format("noop").mode("overwrite").save()
            runs.append(round(time.perf_counter() - t0, 3))
        cold[name], times[name] = runs[0], min(runs)
        print(f"{name}: {runs}", file=sys.stderr)
    m = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "cold_queries": cold, "cold_total": round(sum(cold.values()), 3),
                      "repeat": repeat, "sf": float(m.group(1)) if m else None, "cpus": cpus}))
    spark.stop()


if __name__ == "__main__":
    main()
