"""Headline queries at ``$BENCH_SF_DIR`` on ``local[$BENCH_CPUS]``; one JSON line."""

from __future__ import annotations

import json
import os
import time

from lithoflow.plans import catalog
from lithoflow.session import local_session

HEADLINE = ["flagship", "windowed_nearest_ties", "theme_fewtem", "theme_skytem", "well_theme_top3", "combine_with_prior", "inpox_probability", "stack_clamp", "cluster_stats_nearest_rank", "krige_window"]
LLM = [
    "op1_exact_dedup", "op2_token_counts", "op3_decontaminate", "op4_mix_sources", "op5_license_scan", "op6_language_id", "op7_suffix_dedup", "op8_chat_format",
    "op9_quality_classifier", "op10_minhash_near_dedup",
]


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "bench")
    todo = {k: catalog.queries()[k] for k in HEADLINE}
    try:
        from importlib import import_module

        llm = import_module("lithoflow.llm.catalog")

        todo |= {k: llm.queries()[k] for k in LLM}
    except ImportError:
        pass  # the subpackage may have been taken away
    took = {}
    for k, f in todo.items():
        f(spark, sf).write.format("noop").mode("overwrite").save()  # code generation and file listing
        t = time.perf_counter()
        f(spark, sf).write.format("noop").mode("overwrite").save()
        took[k] = round(time.perf_counter() - t, 3)
    print(json.dumps({"metric": "total_seconds", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": sf.rsplit("sf", 1)[-1]}))


if __name__ == "__main__":
    main()
