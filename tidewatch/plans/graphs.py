"""Entity graph queries."""
from __future__ import annotations

from pyspark.sql import functions as F

from tidewatch.functions.keyed import scratch_folder
from tidewatch.operators import graph as G
from tidewatch.plans.model import events, query, with_ne
from tidewatch.schema import AUTH_EVENT_TYPES

BASE_NAME = "CASE WHEN file_path IS NOT NULL THEN regexp_extract(file_path, '[^/\\\\]*$') END"
PROC = "CASE WHEN process_name IS NOT NULL THEN 'proc:' || lower(hostname) || ':' || process_id END"
IDS = f"""ids AS (SELECT *, 'host:' || lower(hostname) AS h, 'user:' || lower(username) AS u, {PROC} AS p, 'file:' || file_path AS f,
  'ip:' || dst_ip AS i, 'domain:' || lower(domain) AS d FROM ne)"""
MENTIONS = f"""mentions AS (
  SELECT h AS id, 'host' AS type, hostname AS name, case_id, event_id, timestamp FROM ids
  UNION ALL SELECT u, 'user', username, case_id, event_id, timestamp FROM ids
  UNION ALL SELECT p, 'process', process_name, case_id, event_id, timestamp FROM ids WHERE p IS NOT NULL
  UNION ALL SELECT f, 'file', {BASE_NAME}, case_id, event_id, timestamp FROM ids WHERE f IS NOT NULL
  UNION ALL SELECT i, 'ip', dst_ip, case_id, event_id, timestamp FROM ids
  UNION ALL SELECT d, 'domain', domain, case_id, event_id, timestamp FROM ids WHERE d IS NOT NULL)"""
AUTH = "(" + ", ".join(f"'{t}'" for t in AUTH_EVENT_TYPES) + ")"
EDGE_ROWS = f"""edge_rows AS (
  SELECT 'process' AS source_type, p AS source_id, 'executed_by' AS edge_type, 'user' AS target_type, u AS target_id, event_id, timestamp FROM ids WHERE p IS NOT NULL
  UNION ALL SELECT 'process', p, 'ran_on', 'host', h, event_id, timestamp FROM ids WHERE p IS NOT NULL
  UNION ALL SELECT 'process', p, 'accessed', 'file', f, event_id, timestamp FROM ids WHERE p IS NOT NULL AND f IS NOT NULL
  UNION ALL SELECT 'process', p, 'connected_to', 'ip', i, event_id, timestamp FROM ids WHERE p IS NOT NULL
  UNION ALL SELECT 'domain', d, 'resolved_to', 'ip', i, event_id, timestamp FROM ids WHERE d IS NOT NULL
  UNION ALL SELECT 'host', h, 'connected_to', 'ip', i, event_id, timestamp FROM ids WHERE p IS NULL
  UNION ALL SELECT 'user', u, 'logged_into', 'host', h, event_id, timestamp FROM ids WHERE p IS NULL AND event_type IN {AUTH})"""
# Perimeter rows: zeek events stand in for firewall logs.
PERIMETER = """zoned AS (SELECT *, CASE k % 4 WHEN 0 THEN 'green' WHEN 1 THEN 'red' END AS zone FROM ne WHERE source_type = 'zeek'),
pmentions AS (SELECT 'ip:' || dst_ip AS id, 'ip' AS type, dst_ip AS name, event_id FROM zoned
  UNION ALL SELECT 'firewall_zone:' || zone, 'firewall_zone', zone, event_id FROM zoned WHERE zone IS NOT NULL),
pedges AS (SELECT 'firewall_zone:' || zone AS source_id, CASE WHEN event_outcome = 'failure' THEN 'blocks' ELSE 'traverses' END AS edge_type,
  'ip:' || dst_ip AS target_id, event_id FROM zoned WHERE zone IS NOT NULL)"""
ENTITIES = """ents AS (SELECT id, type, name, case_id, timestamp AS created_at FROM mentions
  QUALIFY row_number() OVER (PARTITION BY id ORDER BY timestamp DESC, event_id DESC) = 1)"""
EDGES = """edges AS (SELECT *, timestamp AS created_at FROM edge_rows
  QUALIFY row_number() OVER (PARTITION BY source_id, edge_type, target_id ORDER BY timestamp, event_id) = 1)"""
GRAPH = (IDS, MENTIONS, EDGE_ROWS, ENTITIES, EDGES)
UNDIRECTED = "und AS (SELECT source_id AS a, target_id AS b, target_type AS bt FROM edges UNION SELECT target_id, source_id, source_type FROM edges)"


def built(spark, sf):
    return G.build_graph(events(spark, sf))


_STORED: dict[tuple, G.GraphIndex] = {}


def stored(spark, sf):
    """The graph of all events, stored once a session and input."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _STORED:
        entities, edges = built(spark, sf)
        _STORED[key] = G.store_graph(entities, edges, scratch_folder(spark), buckets=32)
    return _STORED[key]


@query("grf1_entities", with_ne("SELECT id, type, name, case_id, event_id, timestamp FROM mentions", IDS, MENTIONS))
def grf1(spark, sf):
    return G.extract_entities(events(spark, sf)).drop("attributes")


@query("grf1_entity_attributes", with_ne(
    "SELECT p AS id, event_id, source_type, process_name, CAST(process_id AS VARCHAR) AS pid, left(command_line, 256) AS command_line, parent_process_name, "
    "8 - CAST(parent_process_name IS NULL AS INT) AS n_attributes FROM ids WHERE p IS NOT NULL", IDS))
def grf1b(spark, sf):
    a = F.col("attributes")
    return G.extract_entities(events(spark, sf)).filter("type = 'process'").select(
        "id", "event_id", a["source_type"].alias("source_type"), a["process_name"].alias("process_name"), a["process_id"].alias("pid"),
        a["command_line"].alias("command_line"), F.try_element_at(a, F.lit("parent_process_name")).alias("parent_process_name"), F.size(a).alias("n_attributes"))


@query("grf2_edges", with_ne("SELECT * FROM edge_rows", IDS, EDGE_ROWS))
def grf2(spark, sf):
    return G.extract_edges(events(spark, sf)).drop("properties")


@query("grf3_perimeter_entities", with_ne("SELECT * FROM pmentions", PERIMETER))
def grf3(spark, sf):
    return G.perimeter_entities(events(spark, sf), "zeek").select("id", "type", "name", "event_id")


@query("grf3_perimeter_edges", with_ne("SELECT * FROM pedges", PERIMETER))
def grf3b(spark, sf):
    return G.perimeter_edges(events(spark, sf), "zeek").select("source_id", "edge_type", "target_id", "event_id")


@query("grf4_upsert_entities", with_ne("SELECT * FROM ents", *GRAPH))
def grf4(spark, sf):
    return G.upsert_entities(G.extract_entities(events(spark, sf))).select("id", "type", "name", "case_id", "created_at")


@query("grf5_first_edges", with_ne("SELECT source_id, edge_type, target_id, event_id, created_at FROM edges", *GRAPH))
def grf5(spark, sf):
    return G.first_edges(G.extract_edges(events(spark, sf))).select("source_id", "edge_type", "target_id", "event_id", "created_at")


@query("grf6_forward_hops", with_ne("""
SELECT DISTINCT source_id, edge_type, target_id FROM edges JOIN (SELECT node, min(hop) AS hop FROM walk GROUP BY 1) ON source_id = node WHERE hop < 3""",
    *GRAPH, "walk(node, hop) AS (SELECT 'domain:px.tracker0.com', 0 UNION SELECT target_id, hop + 1 FROM walk JOIN edges ON source_id = node WHERE hop < 3)",
    recursive=True))
def grf6(spark, sf):
    return G.edges_from(stored(spark, sf), "domain:px.tracker0.com", depth=3, spark=spark).select("source_id", "edge_type", "target_id")


@query("grf6_forward_hops_process", with_ne("""
SELECT DISTINCT source_id, edge_type, target_id FROM edges JOIN (SELECT node, min(hop) AS hop FROM walk GROUP BY 1) ON source_id = node WHERE hop < 2""",
    *GRAPH, "walk(node, hop) AS (SELECT 'proc:host-1.corp.local:1002', 0 UNION SELECT target_id, hop + 1 FROM walk JOIN edges ON source_id = node WHERE hop < 2)",
    recursive=True))
def grf6b(spark, sf):
    return G.edges_from(stored(spark, sf), "proc:host-1.corp.local:1002", depth=2, spark=spark).select("source_id", "edge_type", "target_id")


@query("grf7_reverse_edges", with_ne("SELECT source_id, edge_type FROM edges WHERE target_id = 'ip:203.0.113.2'", *GRAPH))
def grf7(spark, sf):
    return G.edges_to(built(spark, sf)[1], "ip:203.0.113.2").select("source_id", "edge_type")


@query("grf7_neighbours", with_ne("""
SELECT DISTINCT 'out' AS direction, target_id AS node, target_type AS node_type, edge_type FROM edges WHERE source_id = 'host:host-3.corp.local'
UNION SELECT 'in', source_id, source_type, edge_type FROM edges WHERE target_id = 'host:host-3.corp.local'""", *GRAPH))
def grf7b(spark, sf):
    return G.neighbours(built(spark, sf)[1], "host:host-3.corp.local")


SUB = """walk(node, hop) AS (SELECT 'file:/tmp/f3', 0 UNION SELECT b, hop + 1 FROM walk JOIN und ON a = node WHERE hop < 2),
kept AS (SELECT node, min(hop) AS hop FROM walk GROUP BY 1 ORDER BY hop, node LIMIT 100)"""


@query("grf8_subgraph_nodes", with_ne("SELECT node AS id, CAST(hop AS INT) AS hop, type, name FROM kept LEFT JOIN ents ON id = node", *GRAPH, UNDIRECTED, SUB, recursive=True))
def grf8(spark, sf):
    return G.stored_subgraph(spark, stored(spark, sf), "file:/tmp/f3", depth=2, max_nodes=100)[0].select("id", "hop", "type", "name")


@query("grf8_subgraph_edges", with_ne("""
SELECT source_id, edge_type, target_id FROM edges WHERE source_id IN (SELECT node FROM kept) AND target_id IN (SELECT node FROM kept)
AND (source_id IN (SELECT node FROM kept WHERE hop < 2) OR target_id IN (SELECT node FROM kept WHERE hop < 2))
AND ((SELECT count(*) FROM kept WHERE hop < 2) < 100 OR source_id = 'file:/tmp/f3' OR target_id = 'file:/tmp/f3')""", *GRAPH, UNDIRECTED, SUB, recursive=True))
def grf8b(spark, sf):
    return G.stored_subgraph(spark, stored(spark, sf), "file:/tmp/f3", depth=2, max_nodes=100)[1].select("source_id", "edge_type", "target_id")


@query("grf9_global_graph", with_ne("""
SELECT source_id, edge_type, target_id FROM edges WHERE source_id IN (SELECT id FROM newest) AND target_id IN (SELECT id FROM newest)""",
    *GRAPH, "newest AS (SELECT id FROM ents ORDER BY created_at DESC, id LIMIT 100)"))
def grf9(spark, sf):
    return G.global_graph(*built(spark, sf), limit=100)[1].select("source_id", "edge_type", "target_id")


@query("grf10_case_graph", with_ne("""
SELECT source_id, edge_type, target_id FROM edges WHERE source_id IN (SELECT id FROM ents WHERE case_id = 'case-4') AND target_id IN (SELECT id FROM ents WHERE case_id = 'case-4')""",
    *GRAPH))
def grf10(spark, sf):
    return G.case_graph(*built(spark, sf), "case-4")[1].select("source_id", "edge_type", "target_id")


@query("grf11_rebuild_entities", with_ne("SELECT id, type, name FROM ents", IDS.replace("FROM ne", "FROM ne WHERE source_type = 'evtx'"), MENTIONS, EDGE_ROWS, ENTITIES))
def grf11(spark, sf):
    return G.build_graph(events(spark, sf), "evtx")[0].select("id", "type", "name")


@query("grf11_rebuild_edges", with_ne("SELECT source_id, edge_type, target_id, event_id FROM edges", IDS.replace("FROM ne", "FROM ne WHERE source_type = 'evtx'"), EDGE_ROWS, EDGES))
def grf11b(spark, sf):
    return G.build_graph(events(spark, sf), "evtx")[1].select("source_id", "edge_type", "target_id", "event_id")


@query("grf12_delete_entity", with_ne("SELECT source_id, edge_type, target_id FROM edges WHERE source_id <> 'ip:192.168.1.2' AND target_id <> 'ip:192.168.1.2'", *GRAPH))
def grf12(spark, sf):
    return G.delete_entity(*built(spark, sf), "ip:192.168.1.2")[1].select("source_id", "edge_type", "target_id")


PATH = """walk(node, hop) AS (SELECT 'file:/tmp/f3', 0 UNION SELECT b, hop + 1 FROM walk JOIN und ON a = node WHERE hop < 4),
lev AS (SELECT node, min(hop) AS hop FROM walk GROUP BY 1),
par AS (SELECT l.node, l.hop, min(und.a) AS parent FROM lev l JOIN und ON und.b = l.node JOIN lev q ON q.node = und.a AND q.hop = l.hop - 1 GROUP BY 1, 2),
path(node, hop) AS (SELECT node, hop FROM lev WHERE node = 'domain:www.example.org' UNION ALL
  SELECT p.parent, p.hop - 1 FROM path JOIN par p ON p.node = path.node WHERE p.hop > 0)"""


@query("grf13_shortest_path", with_ne("SELECT CAST(hop AS INT) AS step, node FROM path", *GRAPH, UNDIRECTED, PATH, recursive=True))
def grf13(spark, sf):
    return G.shortest_path(stored(spark, sf), "file:/tmp/f3", "domain:www.example.org", max_hops=4, spark=spark)


RETYPED = """r AS (SELECT *, CASE event_type WHEN 'logon_failure' THEN 'process_create' WHEN 'http' THEN 'network_connection' WHEN 'conn' THEN 'file_create'
  ELSE 'process_access' END AS kind, 'process:' || process_name || ':' || hostname AS p, 'process:' || parent_process_name || ':' || hostname AS pp,
  'file:' || file_path AS f FROM ne)"""


def retyped(spark, sf):
    kind = F.when(F.col("event_type") == "logon_failure", "process_create").when(F.col("event_type") == "http", "network_connection") \
            .when(F.col("event_type") == "conn", "file_create").otherwise("process_access")
    return events(spark, sf).withColumn("event_type", kind)


@query("grf14_investigation_nodes", with_ne("""
SELECT 'host:' || hostname AS id, 'host' AS type FROM r UNION SELECT 'user:' || username, 'user' FROM r UNION SELECT p, 'process' FROM r WHERE p IS NOT NULL
UNION SELECT pp, 'process' FROM r WHERE pp IS NOT NULL UNION SELECT 'ip:' || dst_ip, 'ip' FROM r UNION SELECT 'domain:' || domain, 'domain' FROM r WHERE domain IS NOT NULL
UNION SELECT f, 'file' FROM r WHERE f IS NOT NULL UNION SELECT 'technique:' || attack_technique, 'attack_technique' FROM r
WHERE attack_technique IS NOT NULL AND severity IN ('high', 'critical')""", RETYPED))
def grf14(spark, sf):
    return G.investigation_nodes(retyped(spark, sf))


@query("grf14_investigation_edges", with_ne("""
SELECT pp AS source, p AS target, 'spawned' AS edge_type FROM r WHERE kind = 'process_create' AND p IS NOT NULL AND pp IS NOT NULL
UNION SELECT p, 'ip:' || dst_ip, 'connected_to' FROM r WHERE kind = 'network_connection' AND p IS NOT NULL
UNION SELECT p, f, 'wrote' FROM r WHERE kind = 'file_create' AND p IS NOT NULL AND f IS NOT NULL
UNION SELECT p, f, 'accessed' FROM r WHERE kind = 'process_access' AND p IS NOT NULL AND f IS NOT NULL
UNION SELECT p, 'host:' || hostname, 'ran_on' FROM r WHERE p IS NOT NULL
UNION SELECT 'domain:' || domain, 'ip:' || dst_ip, 'resolved_to' FROM r WHERE domain IS NOT NULL
UNION SELECT p, 'technique:' || attack_technique, 'triggered' FROM r WHERE p IS NOT NULL AND attack_technique IS NOT NULL AND severity IN ('high', 'critical')""", RETYPED))
def grf14b(spark, sf):
    return G.investigation_edges(retyped(spark, sf))


@query("grf15_list_entities", with_ne("SELECT id, name, created_at FROM ents WHERE type = 'user' ORDER BY created_at DESC, id LIMIT 40", *GRAPH))
def grf15(spark, sf):
    return G.list_entities(built(spark, sf)[0], "user", 40).select("id", "name", "created_at")
