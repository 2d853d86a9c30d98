"""Time the headline queries: one JSON line. BENCH_SF_DIR and BENCH_CPUS choose data and cores."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession

from crawlgauge.plans.catalog import QUERIES

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
HEADLINE = [
    "page_flags_p08_p16",
    "page_text_signals_p17_p27",
    "site_score_a09_m07",
    "performance_b01_b02",
    "content_quality_b08_b09",
    "readability_b11_b13",
    "schema_issues_json06_json09_j04",
    "document_keywords_k05_j08",
    "cannibalisation_k06",
    "topic_clusters_k08_j09",
    "leader_similarity_k07",
    "page_keywords_k05_j12",
    "content_gaps_k10",
    "merit_k09_f07",
    "citations_c02_c05_src11",
    "psi_opportunities_ps04_f09",
    "layer_changes_m02_m06_j11",
    "diff_status_m05",
    "layer_scores_m10",
    "gates_f10",
    "llms_full_txt_g02",
    "sitemap_xml_g04",
    "schema_injection_g07",
    "regression_alerts_st02",
]


def main() -> None:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .appName("crawlgauge-bench")
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.ui.enabled", "false")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "20g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    wanted = sys.argv[1:] or HEADLINE
    spark.read.parquet(f"{SF_DIR}/pages.parquet").write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in wanted:
        best = None
        for _ in range(2):
            start = time.perf_counter()
            QUERIES[name](spark, SF_DIR).write.format("noop").mode("overwrite").save()
            took = time.perf_counter() - start
            best = took if best is None else min(best, took)
        seconds[name] = round(best, 3)
    total = round(sum(seconds.values()), 3)
    print(json.dumps({"metric": "headline_queries_total", "value": total, "unit": "sec", "queries": seconds, "sf": SF_DIR}))
    spark.stop()


if __name__ == "__main__":
    main()
