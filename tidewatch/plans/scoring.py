"""Scoring and model queries."""
from __future__ import annotations

from pyspark.sql import functions as F

from tidewatch.operators import graph as G, scores as S
from tidewatch.plans import derived as D
from tidewatch.plans.graphs import GRAPH
from tidewatch.plans.model import AS_OF, events, query, with_ne
from tidewatch.schema import TECHNIQUE_WEIGHTS

BASE = "CASE {0} WHEN 'critical' THEN 40 WHEN 'high' THEN 30 WHEN 'medium' THEN 20 WHEN 'low' THEN 10 WHEN 'info' THEN 5 ELSE 0 END"
WEIGHT = "CASE {0} " + " ".join(f"WHEN '{t}' THEN {w}" for t, w in TECHNIQUE_WEIGHTS.items()) + " ELSE 0 END"
ANOMALIES = """flag AS (
  SELECT event_id, 'ANO-001' AS r FROM ne WHERE parent_process_name = 'winword.exe' AND process_name IN ('cmd.exe', 'powershell.exe')
  UNION ALL SELECT event_id, 'ANO-002' FROM ne WHERE process_name = 'svchost.exe' AND parent_process_name IS NOT NULL AND parent_process_name <> 'services.exe'
  UNION ALL SELECT event_id, 'ANO-003' FROM ne WHERE process_name = 'svchost.exe' AND contains(process_executable, 'Temp')
  UNION ALL SELECT event_id, 'ANO-004' FROM ne WHERE starts_with(dst_ip, '203.') AND dst_port = 4444)"""
ENTITY_SCORES = f"""es AS (SELECT entity, CAST(least(100, w + least(s, 30) + least(coalesce(a, 0) * 10, 20) + least(d * 5, 10)) AS INT) AS risk_score FROM (
  SELECT coalesce(process_name, event_id) AS entity, max({WEIGHT.format('attack_technique')}) AS w, max({BASE.format('severity')}) AS s, count(DISTINCT detection_id) AS d
  FROM links JOIN ne USING (event_id) GROUP BY 1) LEFT JOIN (SELECT coalesce(process_name, event_id) AS entity, count(DISTINCT r) AS a FROM links JOIN ne USING (event_id) JOIN flag USING (event_id) GROUP BY 1) USING (entity))"""


@query("scr1_detection_score", f"WITH {D.DET} SELECT id, CAST(least(100, {BASE.format('severity')} + {WEIGHT.format('attack_technique')} + least((doc_id % 4) * 10, 20)) AS INT) AS score FROM det")
def scr1(spark, sf):
    return D.detections(spark, sf).select("id", S.detection_score(F.col("severity"), F.col("attack_technique"), F.col("doc_id") % 4).alias("score"))


@query("scr2_entity_scores", with_ne("SELECT * FROM es", D.LINKS, ANOMALIES, ENTITY_SCORES))
def scr2(spark, sf):
    return S.score_entities(D.detection_links(spark, sf), events(spark, sf))


@query("scr3_score_detections", with_ne(f"""SELECT id, CAST(least(100, {BASE.format('severity')} + {WEIGHT.format('attack_technique')} + least(coalesce(a, 0) * 10, 20)) AS INT) AS risk_score
FROM det LEFT JOIN (SELECT detection_id, count(DISTINCT r) AS a FROM links JOIN flag USING (event_id) GROUP BY 1) ON detection_id = id""", D.DET, D.LINKS, ANOMALIES))
def scr3(spark, sf):
    return S.score_detections(D.detections(spark, sf), D.detection_links(spark, sf), events(spark, sf)).select("id", "risk_score")


@query("scr4_nodes_with_risk", with_ne("SELECT id, name, coalesce(risk_score, 0) AS risk_score FROM ents LEFT JOIN es ON es.entity = ents.name AND ents.type = 'process'", *GRAPH, D.LINKS, ANOMALIES, ENTITY_SCORES))
def scr4(spark, sf):
    e = events(spark, sf)
    nodes = G.build_graph(e)[0].select(F.when(F.col("type") == "process", F.col("name")).otherwise(F.col("id")).alias("id"), F.col("id").alias("node"), "name")
    return S.nodes_with_risk(nodes, S.score_entities(D.detection_links(spark, sf), e)).select(F.col("node").alias("id"), "name", "risk_score")


@query("ano1_features", with_ne("""
SELECT event_id, CASE severity WHEN 'critical' THEN 1.0 WHEN 'high' THEN 0.75 WHEN 'medium' THEN 0.5 ELSE 0.25 END::DOUBLE AS severity,
  (CAST('0x' || substr(md5(event_type), 1, 8) AS BIGINT) % 100) / 100 AS event_type_hash, round(src_port / 65535, 9) AS src_port, round(coalesce(dst_port, 0) / 65535, 9) AS dst_port,
  round(coalesce(http_status_code, 0) / 999, 9) AS http_status, round(least(coalesce(conn_duration, 0), 3600) / 3600, 9) AS conn_dur, round(process_id / 65535, 9) AS pid FROM ne"""))
def ano1(spark, sf):
    cells = S.feature_columns()
    return events(spark, sf).select("event_id", *[F.round(c, 9).alias(n) for n, c in cells.items()])


@query("ano2_peer_scores")
def ano2(spark, sf):
    """Random trees, so rows only; checked against a sequential reference walk in the tests."""
    return S.score_anomalies(events(spark, sf))


@query("ano3_anomaly_detections", with_ne("""
SELECT 'anomaly-' || event_id AS id, 'anomaly-' || regexp_extract(src_ip, '^(\\d+\\.\\d+\\.\\d+)', 1) || '.subnet__' || coalesce(process_name, 'unknown') AS rule_id,
  CASE WHEN anomaly_score > 0.85 THEN 'high' ELSE 'medium' END AS severity FROM ne WHERE anomaly_score > 0.7"""))
def ano3(spark, sf):
    scored = events(spark, sf).select("event_id", S.peer_subnet(F.col("src_ip")).alias("subnet"), S.peer_process(F.col("process_name")).alias("process"), "anomaly_score")
    return S.anomaly_detections(scored).select("id", "rule_id", "severity")


PEERS = "starts_with(src_ip, '10.0.1.') AND process_name = 'cmd.exe'"


@query("ano4_peer_profile", with_ne(f"""SELECT count(*) AS event_count, round(avg(anomaly_score), 4) AS avg_score, round(max(anomaly_score), 4) AS max_score FROM (
  SELECT anomaly_score FROM ne WHERE {PEERS} ORDER BY timestamp DESC, event_id DESC LIMIT 500)"""))
def ano4(spark, sf):
    return S.peer_profile(events(spark, sf), "10.0.1", "CMD.exe")


@query("ano4_score_trend", with_ne(f"SELECT timestamp, event_id, anomaly_score FROM ne WHERE {PEERS} AND timestamp >= TIMESTAMP '{AS_OF}' - INTERVAL 168 HOUR ORDER BY timestamp, event_id LIMIT 500"))
def ano4b(spark, sf):
    return S.score_trend(events(spark, sf), "10.0.1", "cmd.exe", AS_OF, 168)


@query("fbk1_true_positive_probability")
def fbk1(spark, sf):
    det = D.detections(spark, sf)
    return S.true_positive_probability(S.train_verdicts(S.verdict_features(det, D.feedback(spark, sf))), det)


# The same steps in SQL: a batch is judged by the weights so far, which its mean gradient then moves.
ONLINE = f"""obs AS (SELECT {BASE.format('severity')} / 40.0 AS s, CAST('0x' || md5(rule_id)[1:8] AS BIGINT) % 100 / 100.0 AS r, CAST(verdict = 'TP' AS DOUBLE) AS y,
  ((row_number() OVER (ORDER BY created_at, id) - 1) * 20) // count(*) OVER () AS k FROM det JOIN feedback ON detection_id = id),
steps(k, n, hits, ws, wr, b) AS (SELECT CAST(-1 AS BIGINT), CAST(0 AS BIGINT), CAST(0 AS HUGEINT), CAST(0 AS DOUBLE), CAST(0 AS DOUBLE), CAST(0 AS DOUBLE)
  UNION ALL SELECT k, count(*), sum(CAST((p > 0.5) = (y = 1) AS INT)), any_value(ws) - avg((p - y) * s), any_value(wr) - avg((p - y) * r), any_value(b) - avg(p - y)
  FROM (SELECT o.*, t.ws, t.wr, t.b, 1 / (1 + exp(-(t.ws * o.s + t.wr * o.r + t.b))) AS p FROM steps t JOIN obs o ON o.k = t.k + 1) GROUP BY k)"""


@query("fbk1_progressive_accuracy", f"""WITH RECURSIVE {D.DET}, {D.FEEDBACK}, {ONLINE} SELECT CAST(k AS INT) AS batch, n, round(ws, 4) AS severity_weight, round(wr, 4) AS rule_weight, round(b, 4) AS bias,
  CASE WHEN sum(n) OVER (ORDER BY k) >= 10 THEN round(sum(hits) OVER (ORDER BY k) / sum(n) OVER (ORDER BY k), 4) END AS accuracy FROM steps WHERE k >= 0""")
def fbk1b(spark, sf):
    steps = S.running_accuracy(S.online_verdicts(S.verdict_features(D.detections(spark, sf), D.feedback(spark, sf))))
    figures = ["severity_weight", "rule_weight", "bias", "accuracy"]
    rows = spark.createDataFrame([(r["batch"], r["n"], *(r[c] for c in figures)) for r in steps], "batch int, n bigint, " + ", ".join(f"{c} double" for c in figures))
    return rows.select("batch", "n", *[F.round(c, 4).alias(c) for c in figures])


@query("fbk1_online_probability", f"""WITH RECURSIVE {D.DET}, {D.FEEDBACK}, {ONLINE} SELECT id, round(1 / (1 + exp(-(ws * {BASE.format('severity')} / 40.0 + wr * (CAST('0x' || md5(rule_id)[1:8] AS BIGINT) % 100 / 100.0) + b))), 4) AS p_tp
FROM det, (SELECT * FROM steps ORDER BY k DESC LIMIT 1)""")
def fbk1c(spark, sf):
    det = D.detections(spark, sf)
    steps = S.online_verdicts(S.verdict_features(det, D.feedback(spark, sf)))
    return S.online_probability(steps, det).select("id", F.round("p_tp", 4).alias("p_tp"))
