"""Headline queries on local cores; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

from auditloom.plans import inputs
from auditloom.plans.registry import catalog
from auditloom.session import local_session

HEADLINE = (
    "r01_concurrent_login", "r03_impossible_travel", "r06_sensitive_table_access", "r11_sql_injection", "r16_high_entropy",
    "r30_multi_table_access", "r31_rare_access_hour", "w01_rolling_5m", "w02_user_zscore", "w03_gap_summary", "w10_sequences",
    "f02_normalize_query", "f05_entropy", "f20_shape_detailed", "s01_statement_ingest", "s11_general_log_text",
    "d01_rule_labels", "d04_multi_table_sessions", "d05_violations_and_locks", "d09_alert_rollup", "k02_event_anomalies",
    "a01_attack_matches", "a03_attack_threats", "a04_attack_sequences", "v02_persistence_threats", "v08_statement_variations",
    "b05_mature_anomalies", "t06_statement_threats", "t04_connection_lifecycle", "c08_persistent_threats", "i02_trail_verification",
    "l02_suppression", "g06_rank_frequency", "g08_distinct_counts", "g15_pool_screen",
    # These read the stored detection result; the first of them pays for writing it.
    "q04_top_risky_users", "q03_time_series_m", "q08_kpis", "q10_search", "q12_unified_list",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus)
    items = catalog().items
    # Start the JVM's compilers and the Python workers before measuring.
    items["r12_dos"].run(spark, sf_dir).count()
    rows = inputs.audit(spark, sf_dir).count()
    # Training is a job beside detection, which only scores; its time is told on its own.
    t = time.time()
    inputs.model(spark, sf_dir)
    train = round(time.time() - t, 3)
    times: dict[str, float] = {}
    for name in HEADLINE:
        t = time.time()
        items[name].run(spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - t, 3)
        print(f"{name}: {times[name]}s", file=sys.stderr, flush=True)
    total = round(sum(times.values()), 3)
    detect = times["k02_event_anomalies"]
    print(json.dumps({"metric": "total seconds of the headline queries", "value": total, "unit": "sec", "queries": times,
                      "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"), "audit_rows": rows, "train_sec": train,
                      "detection_rows_per_sec": round(rows / detect)}))
    spark.stop()


if __name__ == "__main__":
    main()
