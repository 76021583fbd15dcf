"""Times the registered queries and prints one JSON line.

BENCH_SF_DIR names the table folder, BENCH_CPUS the local cores. Each query runs twice and its second run counts, so
that neither code generation nor the one-time write of the shared state is part of it; the first runs are listed too.
"""

from __future__ import annotations

import json
import os
import time

from meterwise.plans import registry
from meterwise.session import build_session

HEADLINE = [
    "detect_idle",
    "rolling_baseline",
    "detect_cost_spike",
    "detect_cost_spike_lookback",
    "detect_incremental",
    "anomaly_ids",
    "full_rebuild",
    "apply_fixes_audit",
    "approve_fix_audit",
    "kpi_summary",
    "snapshot_savings",
    "health_scores",
    "pending_approvals",
    "spike_query_drilldown",
    "spike_query_top",
    "alert_parse",
    "alert_metrics",
    "evaluate_alerts",
    "cost_attribution",
    "week_over_week",
    "compliance_findings",
    "notification_feed",
    "audit_log_filtered",
    "stream_fixes",
]


def seconds(query, spark, folder: str) -> float:
    begin = time.perf_counter()
    query(spark, folder).write.format("noop").mode("overwrite").save()
    return round(time.perf_counter() - begin, 3)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        f"local[{cpus}]",
        "meterwise-bench",
        **{
            "spark.ui.enabled": "false",
            "spark.sql.shuffle.partitions": cpus,
            "spark.driver.memory": os.environ.get("BENCH_MEMORY", "8g"),
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries = registry.queries()
    first, second = {}, {}
    for name in HEADLINE:
        first[name] = seconds(queries[name], spark, folder)
        second[name] = seconds(queries[name], spark, folder)
    scale = os.path.basename(folder).removeprefix("sf")
    result = {
        "metric": "total_seconds_second_run",
        "value": round(sum(second.values()), 3),
        "unit": "sec",
        "queries": second,
        "first_run": first,
        "cpus": int(cpus),
        "sf": float(scale) if scale.replace(".", "", 1).isdigit() else scale,
    }
    spark.stop()
    print(json.dumps(result))


if __name__ == "__main__":
    main()
