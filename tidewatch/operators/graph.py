"""Entity graph: extraction from events, upserts, traversals, paths."""
from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tidewatch.functions.keyed import cut_lineage, newest_per_key, oldest_per_key
from tidewatch.functions.postings import Postings, store_postings
from tidewatch.functions.scalars import any_of
from tidewatch.schema import AUTH_EVENT_TYPES

EDGE_KEY = ["source_id", "edge_type", "target_id"]


def _has(name: str) -> Column:
    return F.col(name).isNotNull() & (F.col(name) != "")


def _ids() -> dict[str, Column]:
    host_key = F.when(_has("hostname"), F.lower("hostname")).otherwise("unknown")
    return {
        "host": F.when(_has("hostname"), F.concat(F.lit("host:"), F.lower("hostname"))),
        "user": F.when(_has("username"), F.concat(F.lit("user:"), F.lower("username"))),
        "process": F.when(_has("process_name") & F.col("process_id").isNotNull(),
                          F.concat(F.lit("proc:"), host_key, F.lit(":"), F.col("process_id").cast("string"))),
        "file": F.when(_has("file_path"), F.concat(F.lit("file:"), "file_path")),
        "ip": F.when(_has("dst_ip"), F.concat(F.lit("ip:"), "dst_ip")),
        "domain": F.when(_has("domain"), F.concat(F.lit("domain:"), F.lower("domain"))),
    }


def _with_ids(events: DataFrame) -> tuple[DataFrame, dict[str, Column]]:
    """Events with a column an id, each computed once a row however many edges use it."""
    ids = _ids()
    return events.withColumns({f"_{k}": c for k, c in ids.items()}), {k: F.col(f"_{k}") for k in ids}


def _attributes(**cells: Column | str) -> Column:
    """String map without the null entries."""
    pairs = []
    for key, value in cells.items():
        pairs += [F.lit(key), (F.col(value) if isinstance(value, str) else value).cast("string")]
    return F.map_filter(F.create_map(*pairs), lambda k, v: v.isNotNull())


def _base_name(path: Column) -> Column:
    tail = F.regexp_extract(path, r"[^/\\]*$", 0)
    return F.when(tail != "", tail).otherwise(path)


def extract_entities(events: DataFrame) -> DataFrame:
    """(id, type, name, attributes, case_id, event_id, timestamp): one row per entity mention."""
    events, ids = _with_ids(events)
    cmd = F.substring("command_line", 1, 256)
    names = {"host": F.col("hostname"), "user": F.col("username"), "process": F.col("process_name"), "file": _base_name(F.col("file_path")),
             "ip": F.col("dst_ip"), "domain": F.col("domain")}
    extra = {
        "host": _attributes(hostname="hostname", source_type="source_type"),
        "user": _attributes(username="username", source_type="source_type", user_domain="user_domain"),
        "process": _attributes(process_name="process_name", process_id="process_id", hostname="hostname", source_type="source_type",
                               command_line=cmd, process_executable="process_executable",
                               parent_process_id="parent_process_id", parent_process_name="parent_process_name"),
        "file": _attributes(file_path="file_path", sha256="file_hash_sha256"),
        "ip": _attributes(ip_address="dst_ip", dst_port="dst_port", network_protocol="network_protocol", network_direction="network_direction"),
        "domain": _attributes(domain="domain"),
    }
    rows = F.array(*[
        F.when(ids[k].isNotNull(), F.struct(ids[k].alias("id"), F.lit(k).alias("type"), names[k].alias("name"), extra[k].alias("attributes")))
        for k in ids])
    return events.select(F.explode(rows).alias("e"), "case_id", "event_id", "timestamp").filter("e IS NOT NULL") \
                 .select("e.id", "e.type", "e.name", "e.attributes", "case_id", "event_id", "timestamp")


def extract_edges(events: DataFrame) -> DataFrame:
    """(source_type, source_id, edge_type, target_type, target_id, event_id, timestamp, properties) per mention."""
    events, ids = _with_ids(events)
    proc, user, host, file, ip, domain = (ids[k] for k in ("process", "user", "host", "file", "ip", "domain"))
    plain = F.create_map().cast("map<string,string>")
    flow = _attributes(dst_port="dst_port", src_ip="src_ip", src_port="src_port", network_protocol="network_protocol", event_outcome="event_outcome")
    host_flow = _attributes(dst_port="dst_port", src_ip="src_ip", network_protocol="network_protocol", event_type="event_type")
    login = _attributes(event_type="event_type")
    no_proc = proc.isNull()

    def edge(when: Column, st: str, s: Column, kind: str, tt: str, t: Column, props: Column) -> Column:
        return F.when(when & s.isNotNull() & t.isNotNull(), F.struct(
            F.lit(st).alias("source_type"), s.alias("source_id"), F.lit(kind).alias("edge_type"),
            F.lit(tt).alias("target_type"), t.alias("target_id"), props.alias("properties")))

    yes = F.lit(True)
    rows = F.array(
        edge(yes, "process", proc, "executed_by", "user", user, plain),
        edge(yes, "process", proc, "ran_on", "host", host, plain),
        edge(yes, "process", proc, "accessed", "file", file, plain),
        edge(yes, "process", proc, "connected_to", "ip", ip, flow),
        edge(yes, "domain", domain, "resolved_to", "ip", ip, plain),
        edge(no_proc, "host", host, "connected_to", "ip", ip, host_flow),
        edge(no_proc & F.col("event_type").isin(AUTH_EVENT_TYPES), "user", user, "logged_into", "host", host, login))
    return events.select(F.explode(rows).alias("e"), "event_id", "timestamp").filter("e IS NOT NULL").select("e.*", "event_id", "timestamp")


def _zone() -> Column:
    marks = F.filter(F.transform(F.split("tags", ","), lambda t: F.trim(t)), lambda t: t.startswith("zone:"))
    return F.lower(F.substr(F.get(marks, F.lit(0)), F.lit(6)))


def perimeter_entities(events: DataFrame, source_type: str = "ipfire_syslog") -> DataFrame:
    """Target addresses and firewall zones of perimeter log rows."""
    rows = events.filter((F.col("source_type") == source_type) & _has("dst_ip")).withColumn("zone", _zone())
    both = F.array_compact(F.array(
        F.struct(F.concat(F.lit("ip:"), "dst_ip").alias("id"), F.lit("ip").alias("type"), F.col("dst_ip").alias("name"),
                 _attributes(ip_address="dst_ip").alias("attributes")),
        F.when(F.col("zone").isNotNull(), F.struct(
            F.concat(F.lit("firewall_zone:"), "zone").alias("id"), F.lit("firewall_zone").alias("type"), F.col("zone").alias("name"),
            _attributes(zone_name="zone", zone_color=F.upper("zone")).alias("attributes")))))
    return rows.select(F.explode(both).alias("e"), "case_id", "event_id", "timestamp") \
               .select("e.id", "e.type", "e.name", "e.attributes", "case_id", "event_id", "timestamp")


def perimeter_edges(events: DataFrame, source_type: str = "ipfire_syslog") -> DataFrame:
    kind = F.when(F.col("event_outcome") == "failure", "blocks").when(_has("src_ip"), "traverses").otherwise("permits")
    return events.filter((F.col("source_type") == source_type) & _has("dst_ip")).withColumn("zone", _zone()) \
        .filter(F.col("zone").isNotNull()).select(
            F.lit("firewall_zone").alias("source_type"), F.concat(F.lit("firewall_zone:"), "zone").alias("source_id"),
            kind.alias("edge_type"), F.lit("ip").alias("target_type"), F.concat(F.lit("ip:"), "dst_ip").alias("target_id"),
            _attributes(src_ip="src_ip").alias("properties"), "event_id", "timestamp")


def upsert_entities(mentions: DataFrame) -> DataFrame:
    """Last write per id wins."""
    return newest_per_key(mentions, ["id"], ["timestamp", "event_id"]).withColumnRenamed("timestamp", "created_at")


def first_edges(mentions: DataFrame) -> DataFrame:
    """First write per (source, type, target) wins."""
    return oldest_per_key(mentions, EDGE_KEY, ["timestamp", "event_id"]).withColumnRenamed("timestamp", "created_at")


def build_graph(events: DataFrame, source_type: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Entities and edges of all events (or one source) as a batch job."""
    scope = events.filter(F.col("source_type") == source_type) if source_type else events
    entities = upsert_entities(extract_entities(scope).unionByName(perimeter_entities(scope)))
    edges = first_edges(extract_edges(scope).unionByName(perimeter_edges(scope)))
    return entities, edges


# ---- traversal -------------------------------------------------------------------------------------

class GraphIndex(NamedTuple):
    """A stored graph: entities by id, edges by source and by target. The traversals take it in place of the frames."""
    entities: Postings
    by_source: Postings
    by_target: Postings


def store_graph(entities: DataFrame, edges: DataFrame, folder: str, buckets: int = 256) -> GraphIndex:
    entities, edges = cut_lineage(entities), cut_lineage(edges)       # dealing by ranges reads its rows twice, edges are dealt twice
    return GraphIndex(store_postings(entities, "id", [], f"{folder}/entities", buckets),
                      store_postings(edges, "source_id", ["target_id"], f"{folder}/by_source", buckets),
                      store_postings(edges, "target_id", ["source_id"], f"{folder}/by_target", buckets))


def edges_from(edges: DataFrame | GraphIndex, entity_id: str, depth: int = 2, spark: SparkSession | None = None) -> DataFrame:
    """Edges reachable forward within ``depth`` hops, each once. A node expands only the first time it is reached.

    From a stored graph a hop reads the buckets of its frontier; from a frame it scans all edges.
    """
    spark = spark or edges.sparkSession
    frontier = spark.createDataFrame([(entity_id,)], "node string")
    seen = frontier
    parts = []
    for hop in range(depth):
        leaving = edges.by_source.rows(frontier) if isinstance(edges, GraphIndex) else edges.join(frontier, F.col("source_id") == F.col("node"), "left_semi")
        step = cut_lineage(leaving)
        parts.append(step)
        if hop + 1 < depth:
            frontier = cut_lineage(step.select(F.col("target_id").alias("node")).distinct().join(seen, "node", "left_anti"))
            if frontier.isEmpty():
                break
            seen = seen.unionByName(frontier)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def edges_to(edges: DataFrame, entity_id: str) -> DataFrame:
    return edges.filter(F.col("target_id") == entity_id)


def neighbours(edges: DataFrame, entity_id: str) -> DataFrame:
    """(direction, node, node_type, edge_type) around one entity."""
    out = edges.filter(F.col("source_id") == entity_id).select(
        F.lit("out").alias("direction"), F.col("target_id").alias("node"), F.col("target_type").alias("node_type"), "edge_type")
    into = edges.filter(F.col("target_id") == entity_id).select(F.lit("in"), "source_id", "source_type", "edge_type")
    return out.union(into).distinct()


def both_directions(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("source_id").alias("a"), F.col("target_id").alias("b"), F.col("target_type").alias("b_type")).union(
        edges.select("target_id", "source_id", "source_type")).distinct()


def subgraph(entities: DataFrame, edges: DataFrame, root: str, depth: int = 2, max_nodes: int = 100,
             types: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Nodes around ``root`` in both directions and the edges between them.

    Keeps the first ``max_nodes`` by (hop, id), the feature's own cap, so the kept ids are few and may pass the driver; the
    edge scan of every hop stays distributed. Nodes without an entity row come back as stubs named by their id.
    """
    def rows(ids, ends):
        return edges.filter(any_of([F.col(end).isin(ids) for end in ends]))
    return _subgraph(edges.sparkSession, lambda ids: entities.filter(F.col("id").isin(ids)), rows, root, depth, max_nodes, types)


def stored_subgraph(spark: SparkSession, graph: GraphIndex, root: str, depth: int = 2, max_nodes: int = 100,
                    types: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """:func:`subgraph` of a stored graph; every hop reads the buckets of its frontier."""
    sides = {"source_id": graph.by_source, "target_id": graph.by_target}

    def rows(ids, ends):
        parts = [sides[end].rows_of(spark, ids) for end in ends]
        return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    return _subgraph(spark, lambda ids: graph.entities.rows_of(spark, ids), rows, root, depth, max_nodes, types)


def _subgraph(spark, entities_of, edges_at, root, depth, max_nodes, types):
    empty = spark.createDataFrame([], "id string, hop int")
    ends = ["source_id", "target_id"]
    if entities_of([root]).isEmpty():
        return (empty.join(entities_of([root]).drop("event_id"), "id"), edges_at([root], ends).limit(0))
    depth, max_nodes = min(max(depth, 1), 10), max(max_nodes, 1)
    kept, frontier, expanded = {root: 0}, [root], []
    for hop in range(1, depth + 1):
        if not frontier or len(kept) >= max_nodes:
            break
        expanded += frontier
        links = both_directions(edges_at(frontier, ends))
        if types:
            links = links.filter(F.col("b_type").isin(types))
        fresh = links.filter(F.col("a").isin(frontier) & ~F.col("b").isin(list(kept))).select("b").distinct() \
                     .orderBy("b").limit(max_nodes - len(kept)).collect()
        frontier = [r["b"] for r in fresh]
        kept.update({node: hop for node in frontier})
    nodes = spark.createDataFrame(list(kept.items()), "id string, hop int")
    described = nodes.join(entities_of(list(kept)).drop("event_id"), "id", "left").withColumns({
        "type": F.coalesce("type", F.substring_index("id", ":", 1)),
        "name": F.coalesce("name", F.expr("substring(id, instr(id, ':') + 1)"))})
    if types:
        described = described.filter(F.col("type").isin(types))
    ids = list(kept)
    touched = edges_at(expanded, ends).filter(F.col("source_id").isin(ids) & F.col("target_id").isin(ids)).dropDuplicates(EDGE_KEY)
    return described, touched


def induced_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with both ends in ``nodes``: two semi-joins."""
    ids = nodes.select("id")
    return edges.join(ids, F.col("source_id") == F.col("id"), "left_semi").join(ids, F.col("target_id") == F.col("id"), "left_semi")


def global_graph(entities: DataFrame, edges: DataFrame, limit: int = 100) -> tuple[DataFrame, DataFrame]:
    newest = entities.orderBy(F.col("created_at").desc(), "id").limit(limit)
    return newest, induced_edges(edges, newest)


def case_graph(entities: DataFrame, edges: DataFrame, case_id: str) -> tuple[DataFrame, DataFrame]:
    nodes = entities.filter(F.col("case_id") == case_id)
    return nodes, induced_edges(edges, nodes)


def delete_entity(entities: DataFrame, edges: DataFrame, entity_id: str) -> tuple[DataFrame, DataFrame]:
    return entities.filter(F.col("id") != entity_id), edges.filter((F.col("source_id") != entity_id) & (F.col("target_id") != entity_id))


def shortest_path(edges: DataFrame | GraphIndex, source: str, target: str, max_hops: int = 10, spark: SparkSession | None = None) -> DataFrame:
    """(step, node) of one shortest undirected path; among equals the smallest predecessor. Empty when none."""
    spark = spark or edges.sparkSession
    links = None if isinstance(edges, GraphIndex) else cut_lineage(both_directions(edges).select("a", "b").distinct())

    def around(nodes):
        """(a, b) with a in ``nodes``."""
        if links is not None:
            return links.join(nodes.select(F.col("node").alias("a")), "a")
        out = edges.by_source.rows(nodes).select(F.col("source_id").alias("a"), F.col("target_id").alias("b"))
        return out.union(edges.by_target.rows(nodes).select("target_id", "source_id"))
    frontier = spark.createDataFrame([(source, None, 0)], "node string, parent string, hop int")
    levels, seen, arrived = [frontier], frontier.select("node"), source == target
    for hop in range(1, max_hops + 1):
        if arrived:
            break
        reached = around(frontier.select("node")).groupBy(F.col("b").alias("node")).agg(F.min("a").alias("parent"))
        frontier = cut_lineage(reached.join(seen, "node", "left_anti").withColumn("hop", F.lit(hop)))
        if frontier.isEmpty():
            break
        levels.append(frontier)
        seen = seen.unionByName(frontier.select("node"))
        arrived = not frontier.filter(F.col("node") == target).isEmpty()
    path = []
    if arrived:
        at = target
        for level in reversed(levels):  # one row per hop
            path.append((level.first()["hop"], at))
            at = level.filter(F.col("node") == at).first()["parent"]
    return spark.createDataFrame(sorted(path), "step int, node string")


def list_entities(entities: DataFrame, kind: str | None = None, limit: int = 100) -> DataFrame:
    scope = entities.filter(F.col("type") == kind) if kind else entities
    return scope.orderBy(F.col("created_at").desc(), "id").limit(limit)


# ---- investigation graph ---------------------------------------------------------------------------

def _investigation_ids() -> dict[str, Column]:
    host = F.coalesce(F.nullif("hostname", F.lit("")), F.lit("?"))
    def tag(kind, col):
        return F.when(_has(col), F.concat(F.lit(kind + ":"), col))
    return {
        "host": tag("host", "hostname"), "user": tag("user", "username"),
        "process": F.when(_has("process_name"), F.concat(F.lit("process:"), "process_name", F.lit(":"), host)),
        "parent": F.when(_has("parent_process_name"), F.concat(F.lit("process:"), "parent_process_name", F.lit(":"), host)),
        "ip": tag("ip", "dst_ip"), "domain": tag("domain", "domain"),
        "file": F.when(_has("file_path") & ~F.col("file_path").startswith("HK"), F.concat(F.lit("file:"), "file_path")),
        "technique": F.when(_has("attack_technique") & F.col("severity").isin("high", "critical"),
                            F.concat(F.lit("technique:"), "attack_technique")),
    }


def investigation_nodes(events: DataFrame) -> DataFrame:
    ids = _investigation_ids()
    kinds = {"parent": "process", "technique": "attack_technique"}
    rows = F.array_compact(F.array(*[F.when(c.isNotNull(), F.struct(c.alias("id"), F.lit(kinds.get(k, k)).alias("type"))) for k, c in ids.items()]))
    return events.select(F.explode(rows).alias("n")).select("n.*").distinct()


def investigation_edges(events: DataFrame) -> DataFrame:
    i = _investigation_ids()
    kind = F.col("event_type")

    def edge(when: Column, s: str, t: str, name: str) -> Column:
        return F.when(when & i[s].isNotNull() & i[t].isNotNull(),
                      F.struct(i[s].alias("source"), i[t].alias("target"), F.lit(name).alias("edge_type")))
    yes = F.lit(True)
    rows = F.array_compact(F.array(
        edge(kind == "process_create", "parent", "process", "spawned"),
        edge(kind == "network_connection", "process", "ip", "connected_to"),
        edge(kind == "file_create", "process", "file", "wrote"),
        edge(kind.isin("process_access", "file_read"), "process", "file", "accessed"),
        edge(yes, "process", "host", "ran_on"), edge(yes, "domain", "ip", "resolved_to"),
        edge(yes, "process", "technique", "triggered")))
    return events.select(F.explode(rows).alias("e")).select("e.*").distinct()
