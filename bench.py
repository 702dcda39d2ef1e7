"""Seconds per headline query on the bench tables; prints one JSON line."""

from __future__ import annotations

import contextlib
import json
import os
import shutil
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = (
    "row_documents_orders", "sheet_documents", "markdown_tables", "incremental_new",
    "chunk_documents", "tokenize_documents", "material_numbers", "normalize_items",
    "bm25_topk", "vector_topk", "hybrid_fusion", "graded_context",
    "budget_actual_summary", "duplicate_invoice_lines", "reconcile", "verified_block",
    "verification_rollup", "recommend_chart", "token_overlap", "evaluate_batch",
    "grounding_decisions", "evaluate_history", "validate_judge", "token_budget",
    "token_rate",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    from ledgermill.plans import QUERIES
    from ledgermill.session import build_session

    chosen = sys.argv[1:] or HEADLINE
    shared = tempfile.mkdtemp(prefix="bench-")
    with contextlib.redirect_stdout(sys.stderr):
        spark = build_session(
            "bench",
            **{
                "spark.master": f"local[{cpus}]",
                "spark.sql.shuffle.partitions": cpus,
                "spark.driver.memory": "16g",
                "spark.ui.enabled": "false",
                "spark.checkpoint.dir": shared,
                "spark.ui.showConsoleProgress": "false",
            },
        )
        spark.sparkContext.setLogLevel("ERROR")
        # start the JVM's work once, outside the measured queries
        for warm in ("statement_totals", "bm25_topk"):
            QUERIES[warm](spark, folder).write.format("noop").mode("overwrite").save()
        times = {}
        for name in chosen:
            start = time.perf_counter()
            QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
            times[name] = round(time.perf_counter() - start, 3)
            print(f"{name:28s} {times[name]:8.3f}", file=sys.stderr, flush=True)
        spark.stop()
        shutil.rmtree(shared, ignore_errors=True)
    print(
        json.dumps(
            {
                "metric": "total_query_seconds",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
