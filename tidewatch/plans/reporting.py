"""KPI, report, governance and sink queries."""
from __future__ import annotations

from pyspark.sql import functions as F

from tidewatch.functions.keyed import side_by_side
from tidewatch.operators import governance as V, graph as G, intel as I, kpi as P, reports as R
from tidewatch.plans import derived as D
from tidewatch.plans.enrichment import ASSETS, BEST, COUNTS, GROUP_TECHS, GROUPS, MATCHED, TECHS, TECH_SQL, hits, store
from tidewatch.plans.graphs import GRAPH
from tidewatch.plans.model import AS_OF, events, query, table, with_ne
from tidewatch.sources import sinks as S

T_AS_OF = f"TIMESTAMP '{AS_OF}'"
CASE_AS_OF = "2024-03-01 00:00:00"

KPI_SQL = {
    "mttd_first": "(SELECT round(greatest(0.0, (epoch_us((SELECT min(created_at) FROM det)) - epoch_us((SELECT min(timestamp) FROM ne))) / 60e6), 2)) AS mttd_first",
    "mttd_mean": "(SELECT round(avg(greatest(0.0, (epoch_us(created_at) - t) / 60e6)), 2) FROM det JOIN (SELECT detection_id, min(epoch_us(timestamp)) AS t FROM links JOIN ne USING (event_id) GROUP BY 1) ON detection_id = id) AS mttd_mean",
    "mttr": f"(SELECT round(avg(greatest(0.0, (epoch_us(TIMESTAMP '{CASE_AS_OF}') - epoch_us(created_at)) / 60e6)), 2) FROM cases WHERE status <> 'active') AS mttr",
    "mttc": f"(SELECT round(avg(greatest(0.0, (epoch_us(TIMESTAMP '{CASE_AS_OF}') - epoch_us(created_at)) / 60e6)), 2) FROM cases WHERE status = 'closed') AS mttc",
    "false_positive_rate": "(SELECT round(count(*) FILTER (severity = 'low' AND case_id IS NULL) / count(*), 4) FROM det) AS false_positive_rate",
    "alert_volume": f"(SELECT count(*) FROM det WHERE created_at >= {T_AS_OF} - INTERVAL 24 HOUR) AS alert_volume",
    "active_rules": "(SELECT count(DISTINCT rule_id) FROM det) AS active_rules",
    "open_cases": "(SELECT count(*) FROM cases WHERE status = 'active') AS open_cases",
    "assets": "(SELECT count(DISTINCT hostname) FROM ne) AS assets",
    "log_sources": "(SELECT count(DISTINCT source_type) FROM ne) AS log_sources",
}


def kpi_sql(*names):
    return with_ne("SELECT " + ", ".join(KPI_SQL[n] for n in names), D.DET, D.LINKS, D.CASES)


@query("kpi1_mttd_first", kpi_sql("mttd_first"))
def kpi1(spark, sf):
    return P.mttd_first(D.detections(spark, sf), events(spark, sf))


@query("kpi1_mttd_mean", kpi_sql("mttd_mean"))
def kpi1b(spark, sf):
    return P.mttd_mean(D.detections(spark, sf), D.detection_links(spark, sf), events(spark, sf))


@query("kpi2_response_times", kpi_sql("mttr", "mttc"))
def kpi2(spark, sf):
    return P.response_times(D.cases(spark, sf), CASE_AS_OF)


@query("kpi3_false_positive_rate", kpi_sql("false_positive_rate"))
def kpi3(spark, sf):
    return P.false_positive_rate(D.detections(spark, sf))


@query("kpi4_volume_counts", kpi_sql("alert_volume", "active_rules", "open_cases", "assets", "log_sources"))
def kpi4(spark, sf):
    return P.volume_counts(D.detections(spark, sf), D.cases(spark, sf), events(spark, sf), AS_OF)


@query("kpi5_all_kpis", kpi_sql(*[n for n in KPI_SQL if n not in ("mttr", "mttc")]))
def kpi5(spark, sf):
    return P.all_kpis(D.detections(spark, sf), D.detection_links(spark, sf), events(spark, sf), D.cases(spark, sf), AS_OF).drop("mttr", "mttc")


@query("kpi6_model_calls", """SELECT role AS model, round(avg(turn * 100), 1) AS avg_latency, count(*) AS calls, round(count(*) FILTER (conv_id % 10 = 0) / count(*), 4) AS error_rate
FROM conversations GROUP BY 1""")
def kpi6(spark, sf):
    calls = table(spark, sf, "conversations").selectExpr("role AS model", "turn * 100 AS latency_ms", "conv_id % 10 <> 0 AS success")
    return P.model_call_stats(calls)


SNAP = """snap AS (SELECT CAST(created_at AS DATE) AS d, count(*) AS n, count(*) FILTER (severity = 'low') AS fp FROM det GROUP BY 1)"""


def snapshots(spark, sf, version: int, where: str = "true"):
    return D.detections(spark, sf).filter(where).groupBy(F.to_date("created_at").alias("snapshot_date")).agg(
        F.count(F.lit(1)).alias("detection_count"), F.count_if(F.col("severity") == "low").alias("false_positive_count")).selectExpr(
        "snapshot_date", "0.0D AS mttd_minutes", "1.0D AS mttr_minutes", "2.0D AS mttc_minutes", f"detection_count * {version} AS alert_volume",
        "false_positive_count", "0L AS investigation_count", "detection_count", f"timestamp'2024-02-0{version}' AS computed_at")


def merged_snapshots(spark, sf):
    return P.upsert_snapshots(snapshots(spark, sf, 1), snapshots(spark, sf, 2, "created_at >= timestamp'2024-01-20'"))


@query("kpi7_snapshot_upsert", f"""WITH {D.DET}, {SNAP} SELECT CAST(d AS VARCHAR) AS snapshot_date, CASE WHEN d >= DATE '2024-01-20' THEN n * 2 ELSE n END AS alert_volume, n AS detection_count FROM snap""")
def kpi7(spark, sf):
    return merged_snapshots(spark, sf).select(F.col("snapshot_date").cast("string"), "alert_volume", "detection_count")


@query("kpi7_trends", f"""WITH {D.DET}, {SNAP}, w AS (SELECT * FROM snap WHERE d >= DATE '2024-01-30' - 15)
SELECT 'alert_volume' AS metric, CAST(d AS VARCHAR) AS date, CAST(CASE WHEN d >= DATE '2024-01-20' THEN n * 2 ELSE n END AS DOUBLE) AS value FROM w
UNION ALL SELECT 'false_positives', CAST(d AS VARCHAR), CAST(fp AS DOUBLE) FROM w UNION ALL SELECT 'mttr', CAST(d AS VARCHAR), 1.0 FROM w""")
def kpi7b(spark, sf):
    return P.kpi_trends(merged_snapshots(spark, sf), ["alert_volume", "false_positives", "mttr"], "2024-01-30", 15).withColumn("date", F.col("date").cast("string"))


@query("kpi8_feedback_stats", f"""WITH {D.FEEDBACK}, f AS (SELECT detection_id, CASE WHEN doc_id % 3 = 0 THEN 'FP' ELSE verdict END AS verdict FROM feedback)
SELECT count(*) AS verdicts_given, round(count(*) FILTER (verdict = 'TP') / count(*), 6) AS tp_rate, round(count(*) FILTER (verdict = 'FP') / count(*), 6) AS fp_rate FROM f""")
def kpi8(spark, sf):
    f = D.feedback(spark, sf)
    old = f.selectExpr("detection_id", "verdict", "timestamp'2024-01-01' AS updated_at")
    new = f.filter("doc_id % 3 = 0").selectExpr("detection_id", "'FP' AS verdict", "timestamp'2024-01-02' AS updated_at")
    bad = f.selectExpr("detection_id", "'MAYBE' AS verdict", "timestamp'2024-01-03' AS updated_at")
    stats = P.feedback_stats(P.upsert_feedback(old, new.unionByName(bad)))
    return stats.select("verdicts_given", F.round("tp_rate", 6).alias("tp_rate"), F.round("fp_rate", 6).alias("fp_rate"))


@query("kpi9_rule_quality", f"""WITH {D.DET}, {D.FEEDBACK}
SELECT rule_id, rule_name, count(*) AS total_hits, max(created_at) AS last_hit, count(verdict) AS analyst_reviewed, count(*) FILTER (verdict = 'TP') AS confirmed_tp,
  count(*) FILTER (verdict = 'FP') AS confirmed_fp, coalesce(round(count(*) FILTER (verdict = 'TP') / nullif(count(verdict), 0), 4), 0.0) AS tp_rate,
  coalesce(round(count(*) FILTER (verdict = 'FP') / nullif(count(verdict), 0), 4), 0.0) AS fp_rate FROM det LEFT JOIN feedback ON detection_id = id GROUP BY 1, 2""")
def kpi9(spark, sf):
    return P.rule_quality(D.detections(spark, sf), D.feedback(spark, sf))


@query("kpi9_quality_summary", f"""WITH {D.DET}, {D.FEEDBACK}
SELECT (SELECT count(*) FROM det) AS total_detections, (SELECT count(DISTINCT rule_id) FROM det) AS total_rules_fired, (SELECT count(DISTINCT attack_technique) FROM det) AS technique_count,
 (SELECT count(DISTINCT attack_tactic) FROM det) AS tactic_count, (SELECT round(count(*) FILTER (verdict = 'TP') / count(*), 4) FROM feedback) AS overall_tp_rate,
 (SELECT round(count(*) FILTER (verdict = 'FP') / count(*), 4) FROM feedback) AS overall_fp_rate, (SELECT count(DISTINCT detection_id) FROM feedback) AS analyst_reviewed,
 (SELECT count(DISTINCT rule_id) FROM feedback JOIN det ON id = detection_id) AS rules_with_feedback""")
def kpi9b(spark, sf):
    return P.quality_summary(D.detections(spark, sf), D.feedback(spark, sf))


DURATIONS = "dur AS (SELECT *, (epoch_us(completed_at) - epoch_us(started_at)) / 1e6 AS s FROM runs WHERE status IN ('completed', 'failed') AND completed_at >= started_at)"


@query("kpi10_playbook_mttr", f"WITH {D.RUNS}, {DURATIONS} SELECT playbook_id, playbook_name, round(avg(s), 3) AS mttr_seconds, count(*) AS sample_size FROM dur GROUP BY 1, 2")
def kpi10(spark, sf):
    return P.playbook_mttr(D.playbook_runs(spark, sf)).withColumn("mttr_seconds", F.round("mttr_seconds", 3))


@query("kpi10_playbook_overall", f"""WITH {D.RUNS}, {DURATIONS}, l AS (SELECT list_sort(list(s)) AS v FROM dur)
SELECT round(avg(s), 3) AS mttr_seconds, count(*) AS sample_size, (SELECT v[CAST(round_even(0.5 * (len(v) - 1), 0) AS BIGINT) + 1] FROM l) AS p50_seconds,
  (SELECT v[CAST(round_even(0.95 * (len(v) - 1), 0) AS BIGINT) + 1] FROM l) AS p95_seconds FROM dur""")
def kpi10b(spark, sf):
    return P.playbook_overall(D.playbook_runs(spark, sf)).withColumn("mttr_seconds", F.round("mttr_seconds", 3))


@query("kpi10_playbook_percentiles", f"""WITH {D.RUNS}, {DURATIONS}, l AS (SELECT playbook_id, list_sort(list(s)) AS v FROM dur GROUP BY 1)
SELECT playbook_id, v[CAST(round_even(0.5 * (len(v) - 1), 0) AS BIGINT) + 1] AS p50_seconds, v[CAST(round_even(0.95 * (len(v) - 1), 0) AS BIGINT) + 1] AS p95_seconds FROM l""")
def kpi10c(spark, sf):
    return P.playbook_percentiles(D.playbook_runs(spark, sf))


# ---- reports --------------------------------------------------------------------------------------------

DAY = f"timestamp > {T_AS_OF} - INTERVAL 1 DAY"


@query("rpt1_event_types", with_ne(f"SELECT event_type, count(*) AS cnt FROM ne WHERE {DAY} GROUP BY 1"))
def rpt1(spark, sf):
    return R.telemetry_types(events(spark, sf), AS_OF)


@query("rpt1_totals", with_ne(f"""SELECT (SELECT count(*) FROM ne WHERE {DAY}) AS total_events, (SELECT count(*) FROM ne WHERE {DAY} AND ioc_matched) AS ioc_matches,
 (SELECT count(*) FROM det WHERE created_at > {T_AS_OF} - INTERVAL 1 DAY) AS total_detections, (SELECT count(*) FROM assets) AS assets_count""", D.DET, ASSETS))
def rpt1b(spark, sf):
    e = events(spark, sf)
    return R.telemetry_totals(e, D.detections(spark, sf), I.asset_inventory(e), AS_OF)


@query("rpt1_top_rules", f"WITH {D.DET} SELECT rule_name, severity, count(*) AS cnt FROM det WHERE created_at > {T_AS_OF} - INTERVAL 1 DAY GROUP BY 1, 2 ORDER BY cnt DESC, rule_name, severity LIMIT 5")
def rpt1c(spark, sf):
    return R.telemetry_top_rules(D.detections(spark, sf), AS_OF)


PERIOD = "timestamp BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-20 23:59:59'"


@query("rpt2_executive_breakdown", with_ne(f"""
SELECT 'severity' AS section, severity AS key, count(*) AS cnt FROM ne WHERE {PERIOD} GROUP BY 2
UNION ALL (SELECT 'hostname', hostname, count(*) AS cnt FROM ne WHERE {PERIOD} GROUP BY 2 ORDER BY cnt DESC, hostname LIMIT 10)
UNION ALL (SELECT 'event_type', event_type, count(*) AS cnt FROM ne WHERE {PERIOD} GROUP BY 2 ORDER BY cnt DESC, event_type LIMIT 10)
UNION ALL (SELECT 'src_ip', dst_ip, count(*) AS cnt FROM ne WHERE {PERIOD} AND starts_with(dst_ip, '203.') GROUP BY 2 ORDER BY cnt DESC, dst_ip LIMIT 10)"""))
def rpt2(spark, sf):
    return R.executive_breakdown(events(spark, sf).withColumn("src_ip", F.col("dst_ip")), "2024-01-05", "2024-01-20 23:59:59")


@query("rpt2_executive_totals", with_ne(f"""SELECT (SELECT count(*) FROM ne WHERE {PERIOD}) AS total_events,
 (SELECT count(*) FROM det WHERE {PERIOD.replace('timestamp', 'created_at', 1)}) AS detection_count, (SELECT count(*) FROM cases WHERE {PERIOD.replace('timestamp', 'created_at', 1)}) AS investigation_count""", D.DET, D.CASES))
def rpt2b(spark, sf):
    return R.executive_totals(events(spark, sf), D.detections(spark, sf), D.cases(spark, sf), "2024-01-05", "2024-01-20 23:59:59")


LOGDAY = f"timestamp BETWEEN {T_AS_OF} - INTERVAL 24 HOUR AND {T_AS_OF}"


@query("rpt3_session_log", with_ne(f"""
(SELECT 'event_type' AS section, event_type AS key, count(*) AS cnt FROM ne WHERE {LOGDAY} GROUP BY 2 ORDER BY cnt DESC, key LIMIT 20)
UNION ALL SELECT 'source_type', source_type, count(*) FROM ne WHERE {LOGDAY} GROUP BY 2"""))
def rpt3(spark, sf):
    return R.session_log(events(spark, sf), AS_OF)


@query("rpt4_bulletin_iocs", f"""WITH {D.IOCS} SELECT ioc_value, ioc_type, confidence FROM iocs WHERE starts_with(lower(actor_tag), 'actor-1') AND confidence > 0
ORDER BY confidence DESC, ioc_value, ioc_type LIMIT 100""")
def rpt4(spark, sf):
    iocs = D.iocs(spark, sf).withColumn("ioc_status", F.when(F.col("confidence") == 0, "expired").otherwise("active"))
    return R.bulletin_iocs(iocs, "ACTOR-1").select("ioc_value", "ioc_type", "confidence")


@query("rpt4_bulletin_techniques", f"""WITH {D.DET}, {TECH_SQL} SELECT tech_id, tactic, (SELECT count(*) FROM det WHERE split_part(attack_technique, '.', 1) = tech_id) AS detections
FROM techs WHERE tech_id IN ('T1046', 'T1003')""")
def rpt4b(spark, sf):
    groups = spark.createDataFrame(GROUPS, "stix_id string, name string")
    techs = spark.createDataFrame([(a, a, b) for a, b in TECHS], "tech_id string, name string, tactic string")
    found = R.bulletin_techniques(R.bulletin_actor(groups, "del"), spark.createDataFrame(GROUP_TECHS, "stix_id string, tech_id string"), techs)
    seen = D.detections(spark, sf).groupBy(F.substring_index("attack_technique", ".", 1).alias("tech_id")).agg(F.count(F.lit(1)).alias("detections"))
    return found.join(seen, "tech_id", "left").select("tech_id", "tactic", F.coalesce("detections", F.lit(0)).alias("detections"))


@query("rpt4_bulletin_assets", with_ne("SELECT ip, coalesce(risk_score, 0) AS risk_score FROM assets LEFT JOIN counts USING (ip) ORDER BY coalesce(risk_score, 0) DESC, ip LIMIT 20", D.LINKS, ASSETS, COUNTS))
def rpt4c(spark, sf):
    e = events(spark, sf)
    scored = I.asset_inventory(e).join(I.alert_counts(D.detection_links(spark, sf), e), "ip", "left").na.fill(0, ["risk_score"])
    return R.bulletin_assets(scored).select("ip", "risk_score")


@query("rpt5_csf_counts", f"""WITH {D.DET}, {D.CASES}, {D.RUNS}, {SNAP}
SELECT 'GOVERN' AS csf_function, least(90, (SELECT count(*) FROM snap)) AS items UNION ALL SELECT 'IDENTIFY', (SELECT count(*) FROM det) UNION ALL SELECT 'PROTECT', (SELECT count(*) FROM runs WHERE status = 'completed')
UNION ALL SELECT 'DETECT', (SELECT count(*) FROM det) UNION ALL SELECT 'RESPOND', (SELECT count(*) FROM cases) UNION ALL SELECT 'RECOVER', (SELECT count(*) FROM cases WHERE status <> 'active')""")
def rpt5(spark, sf):
    return R.csf_counts(R.csf_evidence(D.detections(spark, sf), D.cases(spark, sf), D.playbook_runs(spark, sf), snapshots(spark, sf, 1)))


@query("rpt6_case_payloads", f"""WITH {D.DET}
SELECT id, '[' || upper(severity) || '] ' || rule_name || ' — ' || entity_key AS title, CASE severity WHEN 'low' THEN 1 WHEN 'high' THEN 3 WHEN 'critical' THEN 4 ELSE 2 END AS severity,
  concat_ws(',', attack_technique, attack_tactic) AS tags, 2 + CAST(attack_technique IS NOT NULL AS INT) + CAST(case_id IS NOT NULL AS INT) AS n_observables FROM det""")
def rpt6(spark, sf):
    det = D.detections(spark, sf).withColumns({"src_ip": F.col("entity_key"), "ioc_actor_tag": F.col("case_id")})
    p = F.from_json("payload", "title string, severity int, tags array<string>")
    return R.case_payloads(det).select("id", p["title"].alias("title"), p["severity"].alias("severity"), F.array_join(p["tags"], ",").alias("tags"), "n_observables")


@query("rpt7_closure_sync", f"""WITH {D.DET} SELECT id, CASE WHEN doc_id % 6 = 0 THEN CASE WHEN doc_id % 12 = 0 THEN 'Indeterminate' ELSE 'TruePositive' END ELSE 'open' END AS external_status,
  CASE WHEN doc_id % 6 = 0 THEN make_timestamp((1704067200000 + doc_id * 1000) * 1000) END AS external_closed_at FROM det""")
def rpt7(spark, sf):
    det = D.detections(spark, sf).selectExpr("id", "doc_id", "concat('x-', doc_id) AS external_case_id", "'open' AS external_status",
                                             "cast(null as timestamp) AS external_closed_at", "cast(null as string) AS external_analyst")
    resolved = det.filter("doc_id % 6 = 0").selectExpr("external_case_id", "case when doc_id % 12 <> 0 then 'TruePositive' end AS resolution",
                                                       "'ann' AS assignee", "1704067200000 + doc_id * 1000 AS end_ms")
    return R.sync_closures(det, resolved).select("id", "external_status", "external_closed_at")


@query("rpt8_ingest_provenance", with_ne("SELECT event_id, source_file, 'p-' || source_file AS prov_id FROM ne WHERE case_id = 'case-1'"))
def rpt8(spark, sf):
    e = events(spark, sf)
    files = e.groupBy("source_file").agg(F.max("ingested_at").alias("ingested_at")).withColumn("prov_id", F.concat(F.lit("p-"), "source_file"))
    junction = e.select("event_id", F.concat(F.lit("p-"), "source_file").alias("prov_id"))
    return R.ingest_provenance(files, junction, e.filter("case_id = 'case-1'").select("event_id")).select("event_id", "source_file", "prov_id")


@query("rpt8_provenance_list", f"""WITH {D.DET}, {D.RUNS}, kinds AS (SELECT * FROM (SELECT id AS record_id, rule_name AS label, created_at, 'detection' AS record_type FROM det ORDER BY created_at DESC, id DESC LIMIT 60)
  UNION ALL (SELECT run_id, playbook_name, started_at - INTERVAL 7305 DAY + INTERVAL 32000 DAY, 'playbook' FROM runs ORDER BY started_at DESC, run_id DESC LIMIT 60))
SELECT * FROM kinds ORDER BY created_at DESC, record_type, record_id DESC LIMIT 60""")
def rpt8b(spark, sf):
    det = D.detections(spark, sf).selectExpr("id AS record_id", "rule_name AS label", "created_at")
    runs = D.playbook_runs(spark, sf).selectExpr("run_id AS record_id", "playbook_name AS label", "started_at - interval '7305' day + interval '32000' day AS created_at")
    return R.provenance_list({"detection": det, "playbook": runs}, 60)


@query("rpt9_incident_techniques", f"""WITH {D.DET}, {TECH_SQL} SELECT DISTINCT tech_id, tactic FROM techs WHERE tech_id IN (SELECT split_part(attack_technique, '.', 1) FROM det WHERE case_id = 'case-3')""")
def rpt9(spark, sf):
    det = D.detections(spark, sf)
    links = det.filter("attack_technique IS NOT NULL").select(F.col("id").alias("detection_id"), F.substring_index("attack_technique", ".", 1).alias("tech_id"))
    return R.incident_techniques(det, "case-3", links, spark.createDataFrame(TECHS, "tech_id string, tactic string"))


@query("rpt9_incident_detections", f"WITH {D.DET} SELECT id, severity FROM det WHERE case_id = 'case-3' ORDER BY created_at DESC, id DESC LIMIT 50")
def rpt9b(spark, sf):
    return R.incident_detections(D.detections(spark, sf), "case-3").select("id", "severity")


@query("rpt9_incident_hits", with_ne("SELECT event_id, ioc_value FROM matched WHERE ioc_matched ORDER BY timestamp DESC, event_id DESC LIMIT 30", D.IOCS, BEST, MATCHED))
def rpt9c(spark, sf):
    return R.incident_hits(hits(spark, sf)).select("event_id", "ioc_value")


@query("rpt9_incident_runs", f"WITH {D.RUNS} SELECT run_id, status, started_at FROM runs WHERE case_id = 'case-5'")
def rpt9d(spark, sf):
    return R.incident_runs(D.playbook_runs(spark, sf), "case-5").select("run_id", "status", "started_at")


# ---- governance --------------------------------------------------------------------------------------------

RECEIPTS = """rec AS (SELECT concat('r-', CAST(o_orderkey % 9000 AS VARCHAR)) AS receipt_id, concat('case-', CAST(o_custkey AS VARCHAR)) AS case_id, o_orderdate AS executed_at, o_orderkey,
  CASE o_orderkey % 5 WHEN 0 THEN 'applied' WHEN 1 THEN 'noop_already_present' WHEN 2 THEN 'validation_failed' WHEN 3 THEN 'expired_rejected' ELSE 'rolled_back' END AS failure_taxonomy FROM orders)"""
ACCEPTED = """acc AS (SELECT * FROM (SELECT * FROM rec QUALIFY row_number() OVER (PARTITION BY receipt_id ORDER BY executed_at, o_orderkey) = 1) WHERE receipt_id NOT IN (SELECT 'r-' || c_custkey FROM customer))"""


def accepted(spark, sf):
    receipts = table(spark, sf, "orders").selectExpr(
        "concat('r-', cast(o_orderkey % 9000 as string)) AS receipt_id", "concat('case-', cast(o_custkey as string)) AS case_id",
        "cast(o_orderdate as timestamp) + make_dt_interval(0, 0, 0, o_orderkey / 1000000) AS executed_at",
        "case o_orderkey % 5 when 0 then 'applied' when 1 then 'noop_already_present' when 2 then 'validation_failed' when 3 then 'expired_rejected' else 'rolled_back' end AS failure_taxonomy")
    stored = table(spark, sf, "customer").selectExpr("concat('r-', cast(c_custkey as string)) AS receipt_id")
    return V.accept_receipts(receipts, stored)


@query("gov1_case_states", f"""WITH {RECEIPTS}, {ACCEPTED} SELECT case_id, arg_max(CASE failure_taxonomy WHEN 'applied' THEN 'containment_confirmed' WHEN 'noop_already_present' THEN 'containment_confirmed'
  WHEN 'rolled_back' THEN 'containment_rolled_back' ELSE 'containment_failed' END, (executed_at, o_orderkey)) AS case_status FROM acc GROUP BY 1""")
def gov1(spark, sf):
    return V.case_states(accepted(spark, sf)).select("case_id", "case_status")


@query("gov1_notifications", f"""WITH {RECEIPTS}, {ACCEPTED} SELECT receipt_id, case_id, CASE WHEN failure_taxonomy = 'expired_rejected' THEN 're_approve_required' ELSE 'manual_review_required' END AS required_action
FROM acc WHERE failure_taxonomy IN ('validation_failed', 'rolled_back', 'expired_rejected')""")
def gov1b(spark, sf):
    return V.notifications(accepted(spark, sf)).drop("status")


@query("gov2_approval_gate", """SELECT o_orderkey, concat_ws('; ', CASE WHEN o_orderkey % 4 = 0 THEN 'approved_by must be non-empty' END, CASE WHEN o_orderdate <= TIMESTAMP '1998-01-01' THEN 'expires_at is in the past' END,
  CASE WHEN (o_orderkey % 3 = 0 OR o_orderkey % 5 = 0) AND o_orderkey % 2 = 0 THEN 'override_log is required' END) AS errors FROM orders""")
def gov2(spark, sf):
    recs = table(spark, sf, "orders").selectExpr(
        "o_orderkey", "case when o_orderkey % 4 = 0 then '  ' else 'ann' end AS approved_by", "cast(o_orderdate as timestamp) AS expires_at",
        "case when o_orderkey % 3 = 0 then 'low' else 'high' end AS inference_confidence", "o_orderkey % 5 <> 0 AS inspection_passed",
        "case when o_orderkey % 2 = 1 then 'log' end AS override_log")
    return recs.select("o_orderkey", F.array_join(V.approval_errors("1998-01-01"), "; ").alias("errors"))


def actions(spark, sf):
    return events(spark, sf).select(
        F.col("event_id").alias("action_id"), F.col("hostname").alias("scope"), F.col("timestamp").alias("requested_at"),
        F.when(F.col("dst_port") == 22, "notify").otherwise("block_ip").alias("action"), F.col("dst_ip").alias("target"),
        (F.lit(0.8) + F.col("confidence") / 5).alias("confidence"), (F.col("process_id") % 11 != 0).alias("human_confirmed"))


GATES = """act AS (SELECT event_id AS action_id, hostname AS scope, timestamp AS t, CASE WHEN coalesce(dst_port, 0) <> 22 AND NOT (1000 + k) % 11 <> 0 THEN 'approval'
  WHEN 0.8 + confidence / 5 < 0.85 THEN 'confidence' WHEN coalesce(dst_port, 0) <> 22 AND starts_with(dst_ip, '192.168.') THEN 'safelist' END AS gate FROM ne)"""


@query("gov3_static_gates", with_ne("SELECT action_id, coalesce(gate, 'open') AS gate FROM act", GATES))
def gov3(spark, sf):
    return actions(spark, sf).select("action_id", F.coalesce(V.static_gate(), F.lit("open")).alias("gate"))


RATE = """cand AS (SELECT action_id, scope, t FROM act WHERE gate IS NULL),
passed(scope, a1, a2, a3, id) AS (
  SELECT scope, CAST(NULL AS TIMESTAMP), CAST(NULL AS TIMESTAMP), t, action_id FROM (SELECT *, row_number() OVER (PARTITION BY scope ORDER BY t, action_id) AS r FROM cand) WHERE r = 1
  UNION ALL SELECT scope, a2, a3, t, action_id FROM (
    SELECT p.scope, p.a2, p.a3, c.t, c.action_id, row_number() OVER (PARTITION BY p.scope ORDER BY c.t, c.action_id) AS r FROM passed p
    JOIN cand c ON c.scope = p.scope AND (c.t > p.a3 OR (c.t = p.a3 AND c.action_id > p.id)) AND (p.a1 IS NULL OR c.t > p.a1 + INTERVAL 1 DAY)) WHERE r = 1)"""


@query("gov3_action_policy", with_ne("""SELECT action_id, coalesce(gate, CASE WHEN id IS NOT NULL THEN 'allowed' ELSE 'rate_limit' END) AS gate, id IS NOT NULL AS allowed
FROM act LEFT JOIN passed ON id = action_id""", GATES, RATE, recursive=True))
def gov3b(spark, sf):
    """The rate gate depends on order; the SQL walks from each passed action to the next."""
    return V.decide_actions(actions(spark, sf), rate_limit=3, rate_window_seconds=86400).select("action_id", "gate", "allowed")


@query("gov4_source_health", with_ne(f"""SELECT source_type, max(timestamp) AS last_seen, CASE WHEN epoch({T_AS_OF}) - floor(epoch(max(timestamp))) < -85000 THEN 'connected' WHEN epoch({T_AS_OF}) - floor(epoch(max(timestamp))) < -80000 THEN 'degraded' ELSE 'offline' END AS status
FROM ne GROUP BY 1"""))
def gov4(spark, sf):
    return V.source_health(events(spark, sf), AS_OF, -85000, -80000)


# ---- sinks ---------------------------------------------------------------------------------------------------

@query("snk1_new_events", with_ne("SELECT event_id, timestamp FROM ne WHERE k % 3 <> 0 AND k % 2 = 0"))
def snk1(spark, sf):
    e = events(spark, sf)
    batch = e.filter("process_id % 2 = 0").unionByName(e.filter("process_id % 4 = 0").withColumn("ingested_at", F.col("ingested_at") + F.expr("interval 1 hour")))
    return S.new_events(e.filter("(process_id - 1000) % 3 = 0"), batch).select("event_id", "timestamp")


@query("snk1_append_round_trip", with_ne("SELECT event_id, severity, CAST(CAST(timestamp AS DATE) AS VARCHAR) AS event_date FROM ne"))
def snk1b(spark, sf):
    e = events(spark, sf)
    folder = S.scratch_folder(spark) + "/events"
    S.append_events(e.filter("process_id % 2 = 0"), folder)
    S.append_events(S.new_events(spark.read.parquet(folder), e), folder)
    return spark.read.parquet(folder).select("event_id", "severity", F.col("event_date").cast("string"))


@query("snk2_replace_events", with_ne("SELECT event_id, CASE WHEN k % 5 = 0 THEN 'critical' ELSE severity END AS severity FROM ne"))
def snk2(spark, sf):
    e = events(spark, sf)
    return S.replace_events(e, e.filter("process_id % 5 = 0").withColumn("severity", F.lit("critical"))).select("event_id", "severity")


@query("snk3_export_rows", with_ne("SELECT event_id, hostname, severity FROM ne WHERE contains(event_type, 'logon') AND severity = 'low' ORDER BY timestamp DESC, event_id DESC LIMIT 500"))
def snk3(spark, sf):
    folder = S.scratch_folder(spark) + "/export"
    S.export_events(events(spark, sf).select("event_id", "timestamp", "hostname", "event_type", "severity", "process_name", "case_id"), folder, "csv", 500, event_type="LOGON", severity="low")
    return spark.read.schema("event_id string, timestamp timestamp, hostname string, event_type string, severity string, process_name string, case_id string") \
        .option("header", True).csv(folder).select("event_id", "hostname", "severity")


@query("snk4_case_bundle", with_ne("""SELECT (SELECT count(*) FROM cases WHERE case_id = 'case-2') AS case_count, (SELECT count(*) FROM ents WHERE case_id = 'case-2') AS entities_count,
 (SELECT count(*) FROM edges WHERE source_id IN (SELECT id FROM ents WHERE case_id = 'case-2') AND target_id IN (SELECT id FROM ents WHERE case_id = 'case-2')) AS edges_count,
 (SELECT count(*) FROM det WHERE case_id = 'case-2') AS detections_count, (SELECT count(*) FROM ne WHERE case_id = 'case-2') AS events_count""", *GRAPH, D.DET, D.CASES))
def snk4(spark, sf):
    e = events(spark, sf)
    return S.bundle_counts(S.case_bundle(D.cases(spark, sf), e, D.detections(spark, sf), *G.build_graph(e), "case-2"))


@query("snk5_notebook_events", with_ne("SELECT event_id, timestamp FROM ne WHERE event_id IN (SELECT event_id FROM links JOIN det ON id = detection_id WHERE det.case_id = 'case-2') ORDER BY timestamp DESC, event_id DESC LIMIT 50", D.DET, D.LINKS))
def snk5(spark, sf):
    return S.notebook_events(D.detections(spark, sf), D.detection_links(spark, sf), events(spark, sf), "case-2").select("event_id", "timestamp")


@query("snk5_notebook_runs", f"WITH {D.RUNS}, {DURATIONS} SELECT count(*) AS runs, round(avg(s), 3) AS mttr_seconds FROM dur WHERE case_id = 'case-2'")
def snk5b(spark, sf):
    return S.notebook_runs(D.playbook_runs(spark, sf), "case-2").withColumn("mttr_seconds", F.round("mttr_seconds", 3))


@query("snk6_daily_backup", with_ne("SELECT event_id, timestamp, process_name FROM ne"))
def snk6(spark, sf):
    target = S.daily_backup(events(spark, sf), S.scratch_folder(spark), "2024-01-30")
    return spark.read.parquet(target).select("event_id", "timestamp", "process_name")


@query("snk7_keep_recent", with_ne(f"SELECT event_id FROM ne WHERE timestamp >= {T_AS_OF} - INTERVAL 9 DAY"))
def snk7(spark, sf):
    return S.keep_recent(events(spark, sf), AS_OF, 9).select("event_id")


@query("snk7_purge_round_trip", with_ne(f"SELECT event_id FROM ne WHERE timestamp >= TIMESTAMP '2024-01-30 06:00:00' - INTERVAL 9 DAY"))
def snk7b(spark, sf):
    folder = S.scratch_folder(spark) + "/events"
    S.append_events(events(spark, sf), folder)
    S.purge_old(spark, folder, "2024-01-30 06:00:00", 9)
    return spark.read.parquet(folder).select("event_id")


@query("snk8_archive", "SELECT count(*) AS lines, 64 AS hash_length FROM events")
def snk8(spark, sf):
    lines = events(spark, sf).select(F.col("raw_event").alias("value"), F.col("source_type").alias("source"), F.col("timestamp").alias("received_at"))
    folder = S.scratch_folder(spark) + "/evidence"
    S.archive_lines(lines, folder)
    hashed = S.archive_manifest(spark, folder).agg(F.max(F.length("sha256")).alias("hash_length"))
    return side_by_side(spark.read.text(folder, recursiveFileLookup=True).agg(F.count(F.lit(1)).alias("lines")), hashed)
