"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) choose data and cores. Every query is run once to warm
up and then timed, as often as BENCH_RUNS says (default 1; the median counts); results go to the no-op sink, so whole outputs are
computed and nothing is collected. The append figure times writing normalized events to a new table by day.
"""
from __future__ import annotations

import json
import os
import statistics
import sys
import tempfile
import time

from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "cor1_port_scan", "cor2_brute_force", "cor3_beaconing", "det6_run_all_detections", "det6_run_all_matches", "det11_anomaly_rules", "nrm1_normalize_events",
    "flt1_list_events_page", "flt2_search", "flt10_07_dns_tunnel", "ti2_event_match", "ti4_retroactive_hits", "ast1_asset_inventory", "ast2_alert_counts",
    "prv1_cookie_exfil", "cov2_technique_heatmap", "grf4_upsert_entities", "grf5_first_edges", "clu4_temporal_clusters", "kpi5_all_kpis", "kpi10_playbook_overall",
    "scr2_entity_scores", "ano2_peer_scores", "vec1_nearest", "src3_ids_lines", "snk1_append_round_trip",
]


def main() -> None:
    cpus = os.environ.get("BENCH_CPUS", "8")
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    wanted = sys.argv[1:] or HEADLINE
    spark = (SparkSession.builder.master(f"local[{cpus}]").appName("bench").config("spark.sql.shuffle.partitions", cpus).config("spark.ui.enabled", "false")
             .config("spark.driver.memory", "16g").config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="spark-")).config("spark.sql.session.timeZone", "UTC").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    from tidewatch.plans import load_all
    from tidewatch.plans.model import table
    registry = load_all().queries
    n_events = table(spark, sf, "events").count()
    runs = int(os.environ.get("BENCH_RUNS", "1"))

    def timed(job) -> float:
        took = []
        for _ in range(1 + runs):
            start = time.time()
            job()
            took.append(time.time() - start)
        return round(statistics.median(took[1:]), 3)

    times: dict[str, float] = {}
    for name in wanted:
        times[name] = timed(lambda: registry[name](spark, sf).write.format("noop").mode("overwrite").save())
        print(f"{name} {times[name]}", file=sys.stderr, flush=True)
    from tidewatch.plans.model import events
    from tidewatch.sources.sinks import append_events, scratch_folder
    rows = events(spark, sf).persist()
    rows.count()
    append_s = timed(lambda: append_events(rows, scratch_folder(spark) + "/events"))
    total = round(sum(times.values()), 3)
    print(json.dumps({
        "metric": "headline_queries_total", "value": total, "unit": "sec", "queries": times, "sf": sf.rstrip("/").split("/sf")[-1], "cores": int(cpus),
        "shuffle_partitions": int(cpus), "events": n_events,
        "append_events_per_sec": round(n_events / append_s), "runs": runs}))
    spark.stop()


if __name__ == "__main__":
    main()
