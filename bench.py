"""Runs the headline queries over $BENCH_SF_DIR on local[$BENCH_CPUS] and prints one line of JSON."""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).parent))

HEADLINE = [
    "pricing_summary", "chained_3way", "having_sum", "count_where", "count_distinct", "in_subquery", "not_in_two_valued", "gt_all", "group_multi_label", "scalar_subquery_correlated",
    "running_sum_rows", "ntile_floor", "topk_multi_desc", "intersect_semi", "components", "as_of_tick", "token_jaccard", "cosine_topk", "content_dedup", "tumbling_day", "upsert_by_key",
]


def main() -> None:
    from pyspark.sql import SparkSession

    from amberline.plans.catalog import QUERIES

    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    conf = {
        "spark.master": f"local[{cpus}]", "spark.driver.memory": "8g", "spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false",
        "spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true",
    }
    spark = SparkSession.builder.config(map=conf).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    took = {}
    for name in HEADLINE:
        times = []
        for _ in range(2):  # the first run compiles code
            start = time.time()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            times.append(time.time() - start)
        took[name] = round(min(times), 3)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": sf_dir.rstrip("/").rpartition("/sf")[2]}))
    spark.stop()


if __name__ == "__main__":
    main()
