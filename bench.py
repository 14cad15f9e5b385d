"""Time the headline queries: one JSON line on standard output."""

from __future__ import annotations

import json
import os
import sys
import time

from shiftlens.plans import all_entries
from shiftlens.session import session

HEADLINE = (
    "leaderboard", "cell_metrics", "run_harvest", "spend_ledger", "usage_totals", "task_tree", "task_patches",
    "append_missing_tasks", "failure_ordinals", "budget_ledger", "transition_audit", "token_reuse", "verifiable_batches",
    "scrub_documents", "content_budget", "junit_totals", "traceback_leaves", "import_bindings", "definition_violations",
    "oracle_violations", "components", "blast_radius", "dependency_order",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = session(
        "bench", f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false",
            "spark.driver.memory": "20g",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1000).selectExpr("sum(id)").collect()
    entries, seconds = all_entries(), {}
    for name in sys.argv[1:] or HEADLINE:
        start = time.perf_counter()
        entries[name].run(spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
        print(f"{name} {seconds[name]}", file=sys.stderr)
    total = round(sum(seconds.values()), 3)
    print(json.dumps({"metric": "headline_total", "value": total, "unit": "sec", "queries": seconds, "sf": folder.rsplit("sf", 1)[-1]}))
    spark.stop()


if __name__ == "__main__":
    main()
