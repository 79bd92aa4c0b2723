"""Times the headline queries and prints one JSON line.

``BENCH_SF_DIR`` names the tables (default: the largest local ones), ``BENCH_CPUS`` the cores.
Every query is run once unmeasured on the smallest tables to load classes, then timed writing its
full result to a no-op sink. The given tables are files of one row group, which no scan can split, so that all work on a
table would run in one task. Before timing they are written once as several files a table into a scratch
folder, unchanged otherwise, as a table of many files would be on a cluster.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time
from pathlib import Path

from lineforge.plans import catalog
from lineforge.session import local_session

HEADLINE = [
    "line_skeleton", "signature_rollup", "sanitize_text", "check_injection", "extract_fenced", "scan_events",
    "unpivot_stats", "write_routed", "key_presence", "key_types", "key_set_variants", "even_sample", "head_sample",
    "field_profile", "parser_lookup", "hit_counts", "parser_upsert", "route_lines", "parse_syslog",
    "parse_access_log", "parse_json_log", "parse_key_value", "parse_csv_log", "parse_app_log", "parse_mixed",
    "ocsf_map", "compact_flatten", "lint_forbidden", "lint_braces", "lint_regex_compile", "lint_summary",
    "output_quality", "run_triage", "counter_rate", "grid_rate", "drop_ratio", "gauge_ratio", "rate_by_label",
    "eval_grid", "alert_states", "alert_ruleset", "recording_rules", "stream_parse", "stream_signatures",
    "stream_alerts",
]


def run(spark, name: str, folder: str) -> float:
    started = time.perf_counter()
    catalog.QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - started


TABLES = ["events", "documents", "conversations"]
FILE_ROWS = 5000


def as_several_files(spark, folder: str) -> str:
    """The tables that the headline queries read, the larger ones as files of ``FILE_ROWS`` rows, in a folder of their own."""
    copy = tempfile.mkdtemp(prefix="bench-")
    for name in TABLES:
        table = spark.read.parquet(f"{folder}/{name}.parquet")
        files = max(1, min(64, table.count() // FILE_ROWS))
        table.repartition(files).write.parquet(f"{copy}/{name}.parquet")
    return copy


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    warm = Path(folder).parent / "sf0.001"
    spark = local_session(cores, "lineforge-bench", "16g")
    # the local tables are small files; larger ones are split by their row groups anyway
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1m")
    sf, folder = Path(folder).name.removeprefix("sf"), as_several_files(spark, folder)
    times: dict[str, float] = {}
    for name in sys.argv[1:] or HEADLINE:
        if warm.exists():
            run(spark, name, str(warm))
        times[name] = round(run(spark, name, folder), 3)
        print(f"{name} {times[name]}", file=sys.stderr, flush=True)
    print(json.dumps({
        "metric": "total_query_seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
        "sf": float(sf) if sf.replace(".", "").isdigit() else sf}))


if __name__ == "__main__":
    main()
