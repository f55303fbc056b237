"""Rule and correlation queries."""
from __future__ import annotations

from pyspark.sql import functions as F

from tidewatch.operators import correlate as C, rules as R
from tidewatch.plans.model import AS_OF, events, query, table, with_ne

RULES = [
    R.Rule("r-cradle", "PowerShell Download Cradle", "high", ["attack.execution", "attack.t1059.001"],
           {"selection": {"Image": "powershell.exe", "CommandLine|contains|all": ["-nop", "-w hidden"]}}),
    R.Rule("r-port", "Suspicious Outbound Port", "critical", ["attack.command_and_control", "attack.t1071"],
           {"selection": {"DestinationPort": 4444}}),
    R.Rule("r-wmi", "WMI Process Spawn", "high", ["attack.lateral_movement", "attack.t1021"],
           {"parent": {"ParentImage|contains": "WmiPrvSE"}, "known": {"Image": ["svchost.exe", "chrome.exe"]}},
           "parent and not known"),
    R.Rule("r-auth", "Failed Logon", "medium", ["attack.credential_access", "attack.t1110.001"],
           {"selection": {"EventType": "logon_failure"}}),
    R.Rule("r-net", "External Target Or Early Host", "odd-level", ["attack.t1046"],
           {"sel_ip": {"DestinationIp": "203.0.113.?"}, "sel_host": {"Computer|startswith": "host-1"},
            "skip": {"Image|endswith": "me.exe"}}, "1 of sel* and not skip"),
    R.Rule("r-task", "Scheduled Task", "low", ["attack.persistence", "attack.t1053.005"],
           {"cmd": {"CommandLine|re": "schtasks.*daily [0-9]?5$"}, "user": {"User|contains": "user1"}}, "all of them"),
    R.Rule("r-mix", "Precedence", "informational", [],
           {"a": {"Image": "cmd.exe"}, "b": {"dst_port": 22}, "c": {"event_type": "http"}}, "a or b and c"),
    R.Rule("r-bad", "Unmapped", "low", [], {"selection": {"NoSuchField": "x"}}),
]

RULE_TESTS = {
    "r-cradle": "process_name = 'powershell.exe' AND contains(command_line, '-nop') AND contains(command_line, '-w hidden')",
    "r-port": "dst_port = 4444",
    "r-wmi": "contains(parent_process_name, 'WmiPrvSE') AND NOT (process_name IN ('svchost.exe', 'chrome.exe'))",
    "r-auth": "event_type = 'logon_failure'",
    "r-net": "(dst_ip LIKE '203.0.113._' OR starts_with(hostname, 'host-1')) AND NOT suffix(process_name, 'me.exe')",
    "r-task": "regexp_matches(command_line, 'schtasks.*daily [0-9]?5$') AND contains(username, 'user1')",
    "r-mix": "process_name = 'cmd.exe' OR (dst_port = 22 AND event_type = 'http')",
}
MATCHES = "m AS (" + " UNION ALL ".join(
    f"SELECT '{rid}' AS rule_id, event_id, timestamp FROM ne WHERE {test}" for rid, test in RULE_TESTS.items()) + ")"
RULE_ROWS = ("rules(rule_id, rule_name, severity, attack_technique, attack_tactic) AS (VALUES "
             "('r-cradle','PowerShell Download Cradle','high','T1059.001','Execution'),"
             "('r-port','Suspicious Outbound Port','critical','T1071','Command And Control'),"
             "('r-wmi','WMI Process Spawn','high','T1021','Lateral Movement'),"
             "('r-auth','Failed Logon','medium','T1110.001','Credential Access'),"
             "('r-net','External Target Or Early Host','medium','T1046',NULL),"
             "('r-task','Scheduled Task','low','T1053.005','Persistence'),"
             "('r-mix','Precedence','informational',NULL,NULL))")
ANALYTICS = [("CAR-1", "T1059", "Shell launch", "High"), ("CAR-2", "T1059", "Encoded command", "Low"),
             ("CAR-3", "T1071", "Web beacon", "Medium"), ("CAR-4", "T1110", "Guessing", "Low")]
ANALYTIC_ROWS = "car(analytic_id, technique_id) AS (VALUES ('CAR-1','T1059'),('CAR-2','T1059'),('CAR-3','T1071'),('CAR-4','T1110'))"


def detections_by_rule(spark, sf):
    matches = R.match_events(events(spark, sf), RULES)
    return R.detections_from_matches(matches, R.rule_table(spark, RULES)), matches


@query("det1_value_predicates", with_ne(
    "SELECT event_id, process_name = 'cmd.exe' AS eq, contains(command_line, 'stop') AS has, "
    "starts_with(hostname, 'host-1.') AS starts, suffix(process_name, 't.exe') AS ends_, "
    "dst_ip LIKE '192.168.%._' AS wild, dst_port = 443 AS num, contains(command_line, '_') AS literal_mark, "
    "contains(lower(command_line), 'run 1') AS folded FROM ne"))
def det1(spark, sf):
    p = R.value_predicate
    return events(spark, sf).select(
        "event_id", p("process_name", "cmd.exe", []).alias("eq"), p("command_line", "stop", ["contains"]).alias("has"),
        p("hostname", "host-1.", ["startswith"]).alias("starts"), p("process_name", "t.exe", ["endswith"]).alias("ends_"),
        p("dst_ip", "192.168.*.?", []).alias("wild"), p("dst_port", "443", []).alias("num"),
        p("command_line", "_", ["contains"]).alias("literal_mark"),
        p("command_line", "RUN 1", ["contains"], True).alias("folded"))


@query("det2_field_lists", with_ne(
    "SELECT event_id, process_name IN ('cmd.exe', 'certutil.exe') AS any_value, "
    "contains(command_line, 'net') AND contains(command_line, 'stop') AS all_values FROM ne"))
def det2(spark, sf):
    return events(spark, sf).select(
        "event_id", R.field_predicate("Image", ["cmd.exe", "certutil.exe"]).alias("any_value"),
        R.field_predicate("CommandLine|contains|all", ["net", "stop"]).alias("all_values"))


@query("det3_conditions", with_ne("SELECT rule_id, event_id FROM m WHERE rule_id IN ('r-net', 'r-task', 'r-mix', 'r-wmi')", MATCHES))
def det3(spark, sf):
    chosen = [r for r in RULES if r.rule_id in ("r-net", "r-task", "r-mix", "r-wmi")]
    return R.match_events(events(spark, sf), chosen).select("rule_id", "event_id")


@query("det4_field_aliases", with_ne(
    "SELECT event_id FROM ne WHERE process_name = 'svchost.exe' AND dst_port = 443 AND contains(tags, 'tun0') IS NOT FALSE "
    "AND smb_path IS NULL AND conn_state = 'SF'"))
def det4(spark, sf):
    e = events(spark, sf)
    keep = R.selection_predicate({"process.name": "svchost.exe", "destination.port": 443, "zeek.smb_mapping.path": None,
                                  "zeek.conn.state": "SF"})
    return e.filter(keep & F.coalesce(R.field_predicate("Tags|contains", "tun0"), F.lit(True))).select("event_id")


@query("det5_match_rule", with_ne(
    "SELECT event_id FROM ne WHERE process_name = 'powershell.exe' AND contains(command_line, '-nop') "
    "AND contains(command_line, '-w hidden') AND case_id = 'case-3'"))
def det5(spark, sf):
    return R.match_rule(events(spark, sf), RULES[0], case_id="case-3").select("event_id")


@query("det6_run_all_matches", with_ne("SELECT rule_id, event_id FROM m", MATCHES))
def det6(spark, sf):
    return R.match_events(events(spark, sf), RULES).select("rule_id", "event_id")


@query("det6_run_all_detections", with_ne(
    "SELECT rule_id, count(*) AS matched_count, min(timestamp) AS first_event, max(timestamp) AS created_at FROM m GROUP BY rule_id",
    MATCHES))
def det6b(spark, sf):
    return detections_by_rule(spark, sf)[0].select("rule_id", "matched_count", "first_event", "created_at")


@query("det7_rule_metadata", with_ne(
    "SELECT rule_id, rule_name, severity, attack_technique, attack_tactic, "
    "concat('Rule ', chr(39), rule_name, chr(39), ' matched ', n, ' event(s).') AS explanation "
    "FROM (SELECT rule_id, count(*) AS n FROM m GROUP BY 1) JOIN rules USING (rule_id)", MATCHES, RULE_ROWS))
def det7(spark, sf):
    return detections_by_rule(spark, sf)[0].select(
        "rule_id", "rule_name", "severity", "attack_technique", "attack_tactic", "explanation")


@query("det8_detection_techniques", with_ne(
    "SELECT DISTINCT substr(sha256('detection:' || rule_id), 1, 32) AS detection_id, attack_technique AS tech_id "
    "FROM m JOIN rules USING (rule_id) WHERE attack_technique IS NOT NULL", MATCHES, RULE_ROWS))
def det8(spark, sf):
    return R.detection_techniques(detections_by_rule(spark, sf)[0])


@query("det8_detection_provenance", with_ne(
    "SELECT DISTINCT substr(sha256('detection:' || rule_id), 1, 32) AS detection_id, rule_id, rule_name AS rule_title, "
    "64 AS hash_length, 'batch-1' AS engine_version, '1' AS field_map_version FROM m JOIN rules USING (rule_id)",
    MATCHES, RULE_ROWS))
def det8b(spark, sf):
    p = R.detection_provenance(detections_by_rule(spark, sf)[0], "batch-1")
    return p.withColumn("hash_length", F.length("rule_sha256")).drop("rule_sha256")


@query("det9_analytics_enrichment", with_ne(
    "SELECT r.rule_id, (SELECT count(*) FROM car c WHERE c.technique_id = split_part(r.attack_technique, '.', 1)) AS analytic_count, "
    "(SELECT string_agg(analytic_id, ',' ORDER BY analytic_id) FROM car c "
    " WHERE c.technique_id = split_part(r.attack_technique, '.', 1)) AS analytics "
    "FROM rules r WHERE r.rule_id IN (SELECT rule_id FROM m)", MATCHES, RULE_ROWS, ANALYTIC_ROWS))
def det9(spark, sf):
    catalog = spark.createDataFrame(ANALYTICS, "analytic_id string, technique_id string, title string, coverage_level string")
    out = R.enrich_with_analytics(detections_by_rule(spark, sf)[0], catalog)
    ids = F.transform(F.from_json("car_analytics", "array<struct<analytic_id:string>>"), lambda a: a["analytic_id"])
    return out.select("rule_id", "analytic_count", F.array_join(ids, ",").alias("analytics"))


@query("det10_burst_rule", with_ne(
    "SELECT make_timestamp(cast(floor(epoch(timestamp) / 86400) AS BIGINT) * 86400000000) AS window_start, count(*) AS hits, "
    "max(timestamp) AS last_event FROM ne WHERE http_status_code = 401 GROUP BY 1 HAVING count(*) > 3"))
def det10(spark, sf):
    return R.burst_counts(events(spark, sf), F.col("http_status_code") == 401, more_than=3, window="1 day")


@query("det11_anomaly_rules", with_ne("""
SELECT event_id, array_to_string(list_filter([
  CASE WHEN lower(parent_process_name) IN ('winword.exe','excel.exe','powerpnt.exe','outlook.exe','mspub.exe')
        AND lower(process_name) IN ('cmd.exe','powershell.exe','wscript.exe','cscript.exe','mshta.exe','rundll32.exe') THEN 'ANO-001' END,
  CASE WHEN process_name IN ('svchost.exe') AND coalesce(parent_process_name, '') NOT IN ('svchost.exe','services.exe','wininit.exe','') THEN 'ANO-002' END,
  CASE WHEN process_name IN ('svchost.exe') AND regexp_matches(lower(process_executable), 'appdata|temp|tmp') THEN 'ANO-003' END,
  CASE WHEN starts_with(dst_ip, '203.') AND dst_port IS NOT NULL AND dst_port NOT IN (80,443,8080,8443,53,22,21,25,587,110,143,3389,445,139) THEN 'ANO-004' END
], lambda x: x IS NOT NULL), ',') AS rules FROM ne"""))
def det11(spark, sf):
    return events(spark, sf).select("event_id", F.array_join(R.anomaly_rules(), ",").alias("rules"))


@query("det12_technique_lookup", with_ne(
    "SELECT event_id, CASE WHEN attack_technique IN ('T1059.001','T1071.001','T1046') THEN attack_technique "
    "ELSE 'T1071.004' END AS technique, CASE WHEN attack_technique = 'T1059.001' THEN 'Execution' "
    "WHEN attack_technique = 'T1046' THEN 'Discovery' ELSE 'Command and Control' END AS tactic "
    "FROM ne WHERE attack_technique IN ('T1059.001','T1071.001','T1046') OR event_type = 'dns_query'"))
def det12(spark, sf):
    alerts = events(spark, sf).select(
        "event_id", "event_type", F.lit("other").alias("category"),
        F.array_compact(F.array(F.concat(F.lit("attack."), F.lower("attack_technique")))).alias("tags"))
    return R.map_techniques(alerts).select("event_id", "technique", "tactic")


# ---- correlation --------------------------------------------------------------------------------

SCAN = dict(window="1 day", min_ports=3)
BRUTE = dict(window="7 days", min_failures=3)
BEACON = dict(min_intervals=4, max_cv=0.9, chunk="day")
CHAINS = [
    C.Chain("scan-bruteforce", "Port scan then brute force", ["corr-portscan", "corr-bruteforce"], window="30 days"),
    C.Chain("recon-to-access", "Recon then access", ["corr-bruteforce", "corr-beacon"], ["discovery", "credential-access"], window="30 days"),
]
LIVE = f"timestamp <= TIMESTAMP '{AS_OF}'"
SCAN_SQL = """scans AS (
  SELECT src_ip, make_timestamp(cast(floor(epoch(timestamp) / 86400) AS BIGINT) * 86400000000) AS window_start,
         count(DISTINCT dst_port) AS distinct_ports, count(*) AS n_events, min(timestamp) AS first_event, max(timestamp) AS created_at
  FROM ne WHERE src_ip IS NOT NULL AND dst_port IS NOT NULL GROUP BY 1, 2 HAVING count(DISTINCT dst_port) >= 3)"""
BRUTE_SQL = """brutes AS (
  SELECT src_ip, dst_ip, make_timestamp(cast(floor(epoch(timestamp) / 604800) AS BIGINT) * 604800000000) AS window_start,
         count(*) AS n_events, min(timestamp) AS first_event, max(timestamp) AS created_at
  FROM ne WHERE src_ip IS NOT NULL AND (event_outcome = 'failure' OR event_type = 'logon_failure'
        OR (event_type = 'ssh' AND NOT ssh_auth_success)) GROUP BY 1, 2, 3 HAVING count(*) >= 3)"""
BEACON_SQL = """gaps AS (
  SELECT src_ip, dst_ip, dst_port, timestamp, event_id, (epoch_us(timestamp) - lag(epoch_us(timestamp)) OVER (
           PARTITION BY src_ip, dst_ip, dst_port ORDER BY timestamp, event_id)) / 1e6 AS gap
  FROM ne WHERE src_ip IS NOT NULL AND dst_ip IS NOT NULL AND dst_port IS NOT NULL
    AND event_type IN ('conn', 'network_connect', 'tls', 'ssl', 'http')),
beacons AS (
  SELECT src_ip, dst_ip, dst_port, count(*) AS n_events, avg(gap) AS mean_interval, stddev_pop(gap) AS stddev_interval,
         max(timestamp) AS created_at
  FROM gaps WHERE gap IS NOT NULL GROUP BY ALL
  HAVING count(*) >= 4 AND avg(gap) > 0 AND stddev_pop(gap) / nullif(avg(gap), 0) < 0.9)"""
FOUND_SQL = """found AS (
  SELECT 'corr-portscan' AS rule_id, 'discovery' AS attack_tactic, src_ip AS entity_key, n_events, created_at FROM scans
  UNION ALL SELECT 'corr-bruteforce', 'credential-access', src_ip, n_events, created_at FROM brutes
  UNION ALL SELECT 'corr-beacon', 'command-and-control', src_ip, n_events, created_at FROM beacons)"""


def correlated(spark, sf):
    e = events(spark, sf)
    cols = C.OUTPUT
    return (C.port_scans(e, **SCAN).select(*cols).unionByName(C.brute_force(e, **BRUTE).select(*cols))
            .unionByName(C.beacons(e, **BEACON).select(*cols)))


@query("cor1_port_scan", with_ne("SELECT * FROM scans", SCAN_SQL))
def cor1(spark, sf):
    return C.port_scans(events(spark, sf), **SCAN).select(
        "src_ip", "window_start", "distinct_ports", "n_events", "first_event", "created_at")


@query("cor1_port_scan_events", with_ne(
    "SELECT substr(sha256('corr-portscan:' || epoch_us(s.window_start) || '|' || s.src_ip), 1, 32) AS detection_id, n.event_id "
    "FROM scans s JOIN ne n ON n.src_ip = s.src_ip AND n.dst_port IS NOT NULL "
    "AND floor(epoch(n.timestamp) / 86400) = floor(epoch(s.window_start) / 86400)", SCAN_SQL))
def cor1b(spark, sf):
    e = events(spark, sf)
    return C.port_scan_events(e, C.port_scans(e, **SCAN), window=SCAN["window"])


@query("cor2_brute_force", with_ne("SELECT * FROM brutes", BRUTE_SQL))
def cor2(spark, sf):
    return C.brute_force(events(spark, sf), **BRUTE).select(
        "src_ip", "dst_ip", "window_start", "n_events", "first_event", "created_at")


@query("cor3_beaconing", with_ne(
    "SELECT src_ip, dst_ip, dst_port, n_events, round(mean_interval, 4) AS mean_interval, "
    "round(stddev_interval, 4) AS stddev_interval, created_at FROM beacons", BEACON_SQL))
def cor3(spark, sf):
    return C.beacons(events(spark, sf), **BEACON).select(
        "src_ip", "dst_ip", "dst_port", "n_events", F.round("mean_interval", 4).alias("mean_interval"),
        F.round("stddev_interval", 4).alias("stddev_interval"), "created_at")


@query("cor3_connection_gaps", with_ne(
    "SELECT event_id, round(gap, 6) AS gap_seconds FROM gaps WHERE gap IS NOT NULL", BEACON_SQL))
def cor3b(spark, sf):
    return C.connection_gaps(events(spark, sf), chunk="day").select("event_id", F.round("gap_seconds", 6).alias("gap_seconds"))


@query("cor4_chain_by_rules", with_ne(
    f"SELECT entity_key, count(*) AS n_events, max(created_at) AS created_at FROM found "
    f"WHERE rule_id IN ('corr-portscan', 'corr-bruteforce') AND created_at BETWEEN TIMESTAMP '{AS_OF}' - INTERVAL 30 DAY AND TIMESTAMP '{AS_OF}' "
    "GROUP BY 1 HAVING count(DISTINCT rule_id) = 2", SCAN_SQL, BRUTE_SQL, BEACON_SQL, FOUND_SQL))
def cor4(spark, sf):
    return C.chain_by_rules(correlated(spark, sf), CHAINS[0], AS_OF).select("entity_key", "n_events", "created_at")


TACTIC_SQL = (f"in_scope AS (SELECT * FROM found WHERE created_at BETWEEN TIMESTAMP '{AS_OF}' - INTERVAL 30 DAY AND TIMESTAMP '{AS_OF}'),\n"
              "by_rules AS (SELECT entity_key FROM in_scope WHERE rule_id IN ('corr-bruteforce', 'corr-beacon') "
              "GROUP BY 1 HAVING count(DISTINCT rule_id) = 2)")


@query("cor5_chain_by_tactics", with_ne(
    "SELECT entity_key, count(*) AS n_events, max(created_at) AS created_at FROM in_scope "
    "WHERE attack_tactic IN ('discovery', 'credential-access') AND entity_key NOT IN (SELECT entity_key FROM by_rules) "
    "GROUP BY 1 HAVING count(DISTINCT attack_tactic) = 2", SCAN_SQL, BRUTE_SQL, BEACON_SQL, FOUND_SQL, TACTIC_SQL))
def cor5(spark, sf):
    return C.chain_by_tactics(correlated(spark, sf), CHAINS[1], AS_OF).select("entity_key", "n_events", "created_at")


@query("cor6_suppress_repeats", with_ne(
    f"SELECT f.rule_id, f.entity_key, f.created_at FROM found f WHERE NOT EXISTS (SELECT 1 FROM found h "
    f"WHERE h.rule_id = f.rule_id AND h.entity_key = f.entity_key AND h.created_at >= TIMESTAMP '{AS_OF}' - INTERVAL 1440 MINUTE)",
    SCAN_SQL, BRUTE_SQL, BEACON_SQL, FOUND_SQL))
def cor6(spark, sf):
    found = correlated(spark, sf)
    return C.suppress_repeats(found, found, AS_OF, minutes=1440).select("rule_id", "entity_key", "created_at")


@query("cor7_run_all", with_ne(
    f"""SELECT rule_id, entity_key, n_events, created_at FROM (
  SELECT rule_id, entity_key, n_events, created_at FROM found
  UNION ALL SELECT 'corr-chain-scan-bruteforce', entity_key, count(*), max(created_at) FROM in_scope
    WHERE rule_id IN ('corr-portscan', 'corr-bruteforce') GROUP BY 2 HAVING count(DISTINCT rule_id) = 2
  UNION ALL SELECT 'corr-chain-recon-to-access', entity_key, count(*), max(created_at) FROM in_scope
    WHERE rule_id IN ('corr-bruteforce', 'corr-beacon') GROUP BY 2 HAVING count(DISTINCT rule_id) = 2
  UNION ALL SELECT 'corr-chain-recon-to-access', entity_key, count(*), max(created_at) FROM in_scope
    WHERE attack_tactic IN ('discovery', 'credential-access') AND entity_key NOT IN (SELECT entity_key FROM by_rules)
    GROUP BY 2 HAVING count(DISTINCT attack_tactic) = 2) f
WHERE NOT EXISTS (SELECT 1 FROM found h WHERE h.rule_id = f.rule_id AND h.entity_key = f.entity_key
  AND h.created_at >= TIMESTAMP '{AS_OF}' - INTERVAL 60 MINUTE)""", SCAN_SQL, BRUTE_SQL, BEACON_SQL, FOUND_SQL, TACTIC_SQL))
def cor7(spark, sf):
    history = correlated(spark, sf)
    return C.run_all(events(spark, sf), history, CHAINS, AS_OF, scan=SCAN, brute=BRUTE, beacon=BEACON).select(
        "rule_id", "entity_key", "n_events", "created_at")
