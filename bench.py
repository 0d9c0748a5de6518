"""Time the headline queries and print one JSON line.

BENCH_SF_DIR names the tables, BENCH_CPUS the local cores. Every query runs once,
its rows going nowhere, after one small warm-up query.
"""

from __future__ import annotations

import json
import os
import time

from talentloom.plans.registry import all_queries
from talentloom.session import local_session

HEADLINE = (
    "F1_final_score",
    "A1_top_ten_per_job",
    "J7_J8_J9_evidence",
    "E2_E3_skill_report",
    "D3a_D3b_total_months",
    "D1a_D1c_J11_cosine",
    "K2_K3_canonical_names",
    "K8_J5_fuzzy_pairs",
    "B6_transitive_closure",
    "A5_threshold_sweep",
    "A8_auc",
    "A12_similarity_matrix",
    "P21_text_quality",
    "S4_score_table",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session("bench", os.environ.get("BENCH_CPUS", "*"))
    spark.sparkContext.setLogLevel("ERROR")
    known = all_queries()
    spark.read.parquet(f"{folder}/orders.parquet").groupBy("o_orderstatus").count().collect()
    seconds = {}
    for name in HEADLINE:
        started = time.time()
        known[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.time() - started, 3)
    pairs = known["J10_pair_expansion"](spark, folder).count()
    print(
        json.dumps(
            {
                "metric": "total_seconds",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
                "pairs_scored": pairs,
                "pairs_per_second": round(pairs / seconds["F1_final_score"], 1),
            }
        )
    )


if __name__ == "__main__":
    main()
