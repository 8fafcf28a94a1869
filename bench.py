"""Time the headline queries and print one JSON line.

BENCH_SF_DIR names the folder of the tables (default /root/testdata/sf0.1), BENCH_CPUS the cores.
BENCH_QUERIES may name other queries, separated by commas, or be ``all``.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from crawlmill.plans import catalog  # noqa: E402
from crawlmill.session import local_session  # noqa: E402

# query -> table whose rows count as its input
HEADLINE = {
    "price_alerts": "lineitem",
    "price_summary": "lineitem",
    "profile_lineitem": "lineitem",
    "quality_score": "events",
    "outlier_fences": "lineitem",
    "validate_records": "customer",
    "record_quality": "pages",
    "url_valid": "pages",
    "url_regex_split": "pages",
    "html_tag_counts": "pages",
    "html_word_freq": "pages",
    "page_score": "pages",
    "link_quality": "pages",
    "extract_items": "pages",
    "doc_topics": "documents",
    "doc_keywords": "documents",
    "doc_sentiment": "documents",
    "doc_analysis": "documents",
    "seo_score": "documents",
    "content_compare": "documents",
    "snapshot_bagdiff": "conversations",
    "job_status": "events",
    "robots_gate": "pages",
    "staged_run": "lineitem",
    "sink_table_with_id": "orders",
}
RUNS = 2


def seconds(spark, name: str, folder: str) -> float:
    start = time.perf_counter()
    catalog.QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    chosen = os.environ.get("BENCH_QUERIES", "")
    names = list(HEADLINE)
    if chosen:
        names = list(catalog.QUERIES) if chosen == "all" else chosen.split(",")
    spark = local_session(cpus, shuffle_partitions=max(8, int(cpus) if cpus.isdigit() else 8))
    spark.range(1000).selectExpr("sum(id)").collect()  # start the session before the clock
    times, rates = {}, {}
    for name in names:
        best = min(seconds(spark, name, folder) for _ in range(RUNS))
        times[name] = round(best, 3)
        if name in HEADLINE:
            rows = spark.read.parquet(f"{folder}/{HEADLINE[name]}.parquet").count()
            rates[name] = round(rows / best)
    print(
        json.dumps(
            {
                "metric": f"total of {len(names)} queries, best of {RUNS} runs each",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "rows_per_sec": rates,
                "cpus": cpus,
                "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
