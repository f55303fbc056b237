"""Derived model tables (detections, feedback, indicators, cases, runs, ...) for both engines."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidewatch.plans.model import table

# Detections stand on documents: one per document; event e belongs to detection e // 10.
DETECTION_EXPRESSIONS = {
    "id": "concat('det-', cast(doc_id as string))",
    "rule_id": "concat('rule-', source)",
    "rule_name": "concat('Rule ', source)",
    "severity": "case doc_id % 5 when 0 then 'critical' when 1 then 'high' when 2 then 'medium' when 3 then 'low' else 'info' end",
    "attack_technique": "case doc_id % 7 when 0 then 'T1059.001' when 1 then 'T1110.001' when 2 then 'T1071.001' "
                        "when 3 then 'T1046' when 4 then 'T1003.001' when 5 then 'T1055' end",
    "attack_tactic": "case doc_id % 7 when 0 then 'execution' when 1 then 'Credential-Access' when 2 then 'command-and-control' "
                     "when 3 then 'discovery' when 4 then 'credential-access' when 5 then 'elsewhere' end",
    "case_id": "case when doc_id % 10 = 0 then concat('case-', cast(doc_id % 7 as string)) end",
    "entity_key": "concat('10.0.', cast(doc_id % 3 as string), '.', cast(doc_id % 40 as string))",
    "explanation": "concat('Found in ', lang)",
}
_OFFSET = "(1704067200 + (doc_id * 2591) % 2592000)"


def _columns(created: str) -> str:
    cells = [f"{text} AS {name}" for name, text in DETECTION_EXPRESSIONS.items()]
    cells += [f"{created} AS created_at", f"case when doc_id % 4 <> 0 then {created} end AS triaged_at", "doc_id"]
    return ", ".join(cells)


DET = f"det AS (SELECT {_columns(f'make_timestamp(CAST({_OFFSET} AS BIGINT) * 1000000)')} FROM documents)"
LINKS = "links AS (SELECT concat('det-', CAST(event_id // 10 AS VARCHAR)) AS detection_id, CAST(event_id AS VARCHAR) AS event_id FROM events " \
        "WHERE event_id // 10 IN (SELECT doc_id FROM documents))"
FEEDBACK = "feedback AS (SELECT concat('det-', CAST(doc_id AS VARCHAR)) AS detection_id, CASE WHEN quality = 1 THEN 'TP' ELSE 'FP' END AS verdict, doc_id FROM labels)"


def detections(spark: SparkSession, sf: str) -> DataFrame:
    created = f"timestamp_seconds({_OFFSET})"
    cells = [f"{text} AS {name}" for name, text in DETECTION_EXPRESSIONS.items()]
    cells += [f"{created} AS created_at", f"case when doc_id % 4 <> 0 then {created} end AS triaged_at", "doc_id"]
    return table(spark, sf, "documents").selectExpr(*cells)


def detection_links(spark: SparkSession, sf: str) -> DataFrame:
    """(detection_id, event_id): the normalized form of a detection's matched ids."""
    docs = table(spark, sf, "documents").select("doc_id")
    ev = table(spark, sf, "events").selectExpr("event_id div 10 AS doc_id", "cast(event_id as string) AS event_id")
    return ev.join(docs, "doc_id", "left_semi").selectExpr("concat('det-', cast(doc_id as string)) AS detection_id", "event_id")


def feedback(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "labels").selectExpr(
        "concat('det-', cast(doc_id as string)) AS detection_id", "case when quality = 1 then 'TP' else 'FP' end AS verdict", "doc_id")


# Playbook runs: one per order line group.
RUNS = """runs AS (SELECT CAST(o_orderkey AS VARCHAR) AS run_id, o_orderpriority AS playbook_id, concat('Playbook ', o_orderpriority) AS playbook_name,
  CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'failed' ELSE 'running' END AS status, o_orderdate AS started_at,
  s.done AS completed_at, concat('case-', CAST(o_custkey % 7 AS VARCHAR)) AS case_id, o_custkey, o_orderkey
  FROM orders LEFT JOIN (SELECT l_orderkey, max(l_shipdate) AS done FROM lineitem GROUP BY 1) s ON s.l_orderkey = o_orderkey)"""


def playbook_runs(spark: SparkSession, sf: str) -> DataFrame:
    shipped = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.max("l_shipdate").cast("timestamp").alias("completed_at"))
    o = table(spark, sf, "orders")
    return o.join(shipped, o.o_orderkey == shipped.l_orderkey, "left").selectExpr(
        "cast(o_orderkey as string) AS run_id", "o_orderpriority AS playbook_id", "concat('Playbook ', o_orderpriority) AS playbook_name",
        "case o_orderstatus when 'F' then 'completed' when 'O' then 'failed' else 'running' end AS status",
        "cast(o_orderdate as timestamp) AS started_at", "completed_at",
        "concat('case-', cast(o_custkey % 7 as string)) AS case_id", "o_custkey", "o_orderkey")


# Cases: one per customer.
CASES = """cases AS (SELECT concat('case-', CAST(c_custkey AS VARCHAR)) AS case_id, concat('Case ', c_name) AS name,
  CASE c_custkey % 3 WHEN 0 THEN 'active' WHEN 1 THEN 'closed' ELSE 'resolved' END AS status,
  make_timestamp(CAST(1704067200 + (c_custkey * 977) % 2592000 AS BIGINT) * 1000000) AS created_at, c_custkey FROM customer)"""


def cases(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "customer").selectExpr(
        "concat('case-', cast(c_custkey as string)) AS case_id", "concat('Case ', c_name) AS name",
        "case c_custkey % 3 when 0 then 'active' when 1 then 'closed' else 'resolved' end AS status",
        "timestamp_seconds(1704067200 + (c_custkey * 977) % 2592000) AS created_at", "c_custkey")


# Recommendations and notifications: one per order.
RECS = """recs AS (SELECT concat('rec-', CAST(o_orderkey AS VARCHAR)) AS recommendation_id, concat('case-', CAST(o_custkey % 7 AS VARCHAR)) AS case_id,
  CASE o_orderkey % 4 WHEN 0 THEN 'draft' WHEN 1 THEN 'approved' WHEN 2 THEN 'dispatched' ELSE 'draft' END AS status,
  o_orderdate AS generated_at, o_orderkey, o_totalprice FROM orders)"""


def recommendations(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").selectExpr(
        "concat('rec-', cast(o_orderkey as string)) AS recommendation_id", "concat('case-', cast(o_custkey % 7 as string)) AS case_id",
        "case o_orderkey % 4 when 0 then 'draft' when 1 then 'approved' when 2 then 'dispatched' else 'draft' end AS status",
        "cast(o_orderdate as timestamp) AS generated_at", "o_orderkey", "o_totalprice")


# Indicators: a fixed dimension over the public test addresses, plus one per supplier so the table grows.
IOC_FIXED = [
    ("203.0.113.0", "ip", None, 80, "apt-alpha", "feodo"), ("203.0.113.1", "ip", None, 0, "apt-old", "feodo"),
    ("203.0.113.2:8080", "ip:port", "203.0.113.2", 60, "apt-beta", "threatfox"),
    ("203.0.113.2", "ip", None, 30, "apt-gamma", "misp"), ("10.0.1.7", "ip", None, 55, "insider", "misp"),
    ("192.168.1.3:22", "ip:port", "192.168.1.3", 45, "apt-beta", "threatfox"),
    ("192.168.1.3:80", "ip:port", "192.168.1.3", 70, "apt-delta", "threatfox"),
]
_IOC_COLUMNS = "ioc_value, ioc_type, bare_ip, confidence, actor_tag, feed_source"
IOCS = ("iocs AS (SELECT * FROM (VALUES " + ", ".join(
    "(" + ", ".join("NULL" if v is None else repr(v) for v in row) + ")" for row in IOC_FIXED) + f") t({_IOC_COLUMNS}) "
    "UNION ALL SELECT concat('198.51.', CAST(s_suppkey % 250 AS VARCHAR), '.', CAST(s_suppkey // 250 AS VARCHAR)), 'ip', NULL, "
    "CAST(s_suppkey % 100 AS INT), concat('actor-', CAST(s_nationkey AS VARCHAR)), CASE WHEN s_suppkey % 2 = 0 THEN 'feodo' ELSE 'misp' END FROM supplier)")


def iocs(spark: SparkSession, sf: str) -> DataFrame:
    fixed = spark.createDataFrame(
        IOC_FIXED, "ioc_value string, ioc_type string, bare_ip string, confidence int, actor_tag string, feed_source string")
    grown = table(spark, sf, "supplier").selectExpr(
        "concat('198.51.', cast(s_suppkey % 250 as string), '.', cast(s_suppkey div 250 as string)) AS ioc_value", "'ip' AS ioc_type",
        "cast(null as string) AS bare_ip", "cast(s_suppkey % 100 as int) AS confidence", "concat('actor-', cast(s_nationkey as string)) AS actor_tag",
        "case when s_suppkey % 2 = 0 then 'feodo' else 'misp' end AS feed_source")
    return fixed.unionByName(grown)


TRACKERS = ["tracker0.com", "tracker2.com"]
