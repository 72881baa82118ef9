"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) choose
data and cores. Each query runs BENCH_RUNS times (default 2) into a sink that
keeps nothing; the best time counts.
"""

from __future__ import annotations

import json
import os
import time

from tallyfold.checks import QUERIES
from tallyfold.session import build_session

HEADLINE = [
    "recon_view",
    "recon_records",
    "recon_key_any_join",
    "recon_stats",
    "reassess_tax",
    "tds_summary_view",
    "tds_summary_all_years",
    "tds_summary_report",
    "books_widgets",
    "books_summary_view",
    "books_summary",
    "books_ledger_page",
    "invoice_detail",
    "audit_search",
    "upload_history",
    "content_hash_gate",
    "parse_statement_text",
    "parse_statement_lines",
    "normalise_ledger",
    "match_customers",
    "books_upsert",
    "statement_insert_new",
    "customer_upsert",
    "merge_full",
    "merge_delta_summary",
    "stream_append_sync",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "2"))
    spark = build_session(
        "bench",
        master=f"local[{cpus}]",
        shuffle_partitions=int(cpus),
        extra={
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.driver.memory": "12g",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    times: dict[str, float] = {}
    for name in HEADLINE:
        best = None
        for _ in range(runs):
            start = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            took = time.perf_counter() - start
            best = took if best is None else min(best, took)
        times[name] = round(best, 3)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "total_best_seconds",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
