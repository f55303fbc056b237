"""Filters, search, named hunts and ranked lists over the event table."""
from __future__ import annotations

import re
from typing import Callable

from pyspark.sql import Column, DataFrame, functions as F

from tidewatch.functions.keyed import with_previous
from tidewatch.functions.scalars import any_of, is_private_ip, severity_rank
from tidewatch.schema import AUTH_EVENT_TYPES, DNS_EVENT_TYPES, TLS_EVENT_TYPES

SEARCH_COLUMNS = ["hostname", "username", "process_name", "command_line", "file_path", "domain", "url",
                  "attack_technique", "attack_tactic", "raw_event"]


def has_text(column: str, needle: str) -> Column:
    """Case-insensitive literal substring; null is no match."""
    return F.coalesce(F.contains(F.lower(column), F.lit(needle.lower())), F.lit(False))


def newest_first(df: DataFrame, limit: int, offset: int = 0, ts: str = "timestamp", tie: str = "event_id") -> DataFrame:
    """Page of the newest rows with a unique tiebreak; planned as a per-partition top-k."""
    ordered = df.orderBy(F.col(ts).desc(), F.col(tie).desc())
    return (ordered.offset(offset) if offset else ordered).limit(limit)


# ---- list and search ------------------------------------------------------------------------

def event_filter(events: DataFrame, hostname=None, process_name=None, case_id=None, severity=None, event_type=None,
                 time_from=None, time_to=None) -> DataFrame:
    """Every filter given must hold."""
    out = events
    for column, needle in (("hostname", hostname), ("process_name", process_name), ("event_type", event_type)):
        if needle:
            out = out.filter(has_text(column, needle))
    if case_id:
        out = out.filter(F.col("case_id") == case_id)
    if severity:
        out = out.filter(F.lower("severity") == severity.lower())
    if time_from:
        out = out.filter(F.col("timestamp") >= F.lit(time_from).cast("timestamp"))
    if time_to:
        out = out.filter(F.col("timestamp") <= F.lit(time_to).cast("timestamp"))
    return out


def list_events(events: DataFrame, page: int = 1, page_size: int = 50, **filters) -> DataFrame:
    return newest_first(event_filter(events, **filters), page_size, (page - 1) * page_size)


def page_info(events: DataFrame, page: int = 1, page_size: int = 50, **filters) -> DataFrame:
    total = event_filter(events, **filters).agg(F.count(F.lit(1)).alias("total"))
    return total.select("total", F.lit(page).alias("page"), F.lit(page_size).alias("page_size"),
                        (F.col("total") > page * page_size).alias("has_next"))


def search(events: DataFrame, text: str, case_id: str | None = None) -> DataFrame:
    scope = events.filter(F.col("case_id") == case_id) if case_id else events
    return scope.filter(any_of([has_text(c, text) for c in SEARCH_COLUMNS]))


def get_event(events: DataFrame, event_id: str) -> DataFrame:
    return events.filter(F.col("event_id") == event_id)


def investigation_query(events: DataFrame, text: str = "", severity: str | None = None, technique: str | None = None) -> DataFrame:
    out = events
    if text:
        out = out.filter(any_of([has_text(c, text) for c in ("hostname", "event_type", "src_ip", "dst_ip", "domain")]))
    if severity:
        out = out.filter(F.lower("severity") == severity.lower())
    if technique:
        out = out.filter(has_text("attack_technique", technique))
    return out


ENTITY_COLUMNS = {"host": ["hostname"], "user": ["username"], "process": ["process_name"], "ip": ["src_ip", "dst_ip"],
                  "domain": ["domain"], "file": ["file_path"]}


def entity_summary(events: DataFrame, entity_id: str) -> DataFrame:
    """First seen, last seen and event count of a ``type:value`` id."""
    kind, _, value = entity_id.partition(":")
    hit = any_of([F.lower(c) == value.lower() for c in ENTITY_COLUMNS[kind]])
    return events.filter(hit).agg(F.count(F.lit(1)).alias("event_count"), F.min("timestamp").alias("first_seen"),
                                  F.max("timestamp").alias("last_seen")).withColumn("entity_id", F.lit(entity_id))


# ---- templates ---------------------------------------------------------------------------------

def suspicious_ip_comms(events: DataFrame, dst_ip: str, limit: int = 200) -> DataFrame:
    rows = events.filter(F.col("dst_ip") == dst_ip).select("hostname", "src_ip", "dst_ip", "timestamp", "event_type").distinct()
    return rows.orderBy(F.col("timestamp").desc(), "hostname", "src_ip", "event_type").limit(limit)


def powershell_children(events: DataFrame, parent: str = "powershell", limit: int = 200) -> DataFrame:
    return newest_first(events.filter(has_text("parent_process_name", parent)), limit)


def unusual_auth(events: DataFrame, threshold: int, types: list[str] | None = None, limit: int = 100) -> DataFrame:
    return (events.filter(F.col("event_type").isin(types or ["authentication"])).groupBy("hostname", "username")
            .agg(F.count(F.lit(1)).alias("cnt"), F.min("timestamp").alias("first_seen"), F.max("timestamp").alias("last_seen"))
            .filter(F.col("cnt") > threshold).orderBy(F.col("cnt").desc(), "hostname", "username").limit(limit))


def indicator_search(events: DataFrame, value: str, limit: int = 500) -> DataFrame:
    same = [F.col(c) == value for c in ("src_ip", "dst_ip", "file_hash_sha256")]
    part = [has_text(c, value) for c in ("hostname", "username", "domain")]
    return newest_first(events.filter(F.coalesce(any_of(same), F.lit(False)) | any_of(part)), limit)


# ---- named hunts -------------------------------------------------------------------------------

COMMON_POWERSHELL_CHILDREN = ["conhost.exe", "powershell.exe", "pwsh.exe"]


def _one_of_text(column: str, needles: list[str]) -> Column:
    return any_of([has_text(column, n) for n in needles])


def _sources_with(events: DataFrame, rows: Column, over: int) -> DataFrame:
    return events.filter(rows).groupBy("src_ip").agg(F.count(F.lit(1)).alias("rows_of_source")) \
                 .filter(F.col("rows_of_source") > over)


def beacon_pairs(events: DataFrame, max_jitter: float = 5.0, min_gaps: int = 3, chunk: str = "hour") -> DataFrame:
    """Source to public target pairs whose gaps between connections vary by less than ``max_jitter`` seconds."""
    outside = events.filter(F.col("src_ip").isNotNull() & F.col("dst_ip").isNotNull() & ~is_private_ip(F.col("dst_ip")))
    slim = outside.select("event_id", "src_ip", "dst_ip", "timestamp")
    now = F.unix_micros("timestamp")
    gaps = with_previous(slim, ["src_ip", "dst_ip"], "timestamp", "event_id", now, "_before", chunk) \
        .filter(F.col("_before").isNotNull()).withColumn("gap", (now - F.col("_before")) / 1e6)
    return (gaps.groupBy("src_ip", "dst_ip").agg(F.count(F.lit(1)).alias("gaps"), F.stddev_pop("gap").alias("jitter"))
            .filter((F.col("gaps") >= min_gaps) & (F.col("jitter") < max_jitter)))


def dns_tunnel(events: DataFrame, max_length: int = 50, max_queries: int = 20) -> DataFrame:
    dns = F.col("event_type").isin(DNS_EVENT_TYPES)
    busy = _sources_with(events, dns, max_queries).select("src_ip", F.lit(True).alias("busy_source"))
    return (events.filter(dns).join(busy, "src_ip", "left")
            .filter((F.length("dns_query") > max_length) | F.coalesce("busy_source", F.lit(False))).select(*events.columns))


def ssh_brute(events: DataFrame, more_than: int = 5) -> DataFrame:
    return _sources_with(events, F.coalesce(~F.col("ssh_auth_success"), F.lit(False)) | F.coalesce(F.col("dst_port") == 22, F.lit(False)), more_than)


def port_scan_sources(events: DataFrame, as_of: str, more_than: int = 20, lookback: str = "24 HOURS") -> DataFrame:
    end = F.lit(as_of).cast("timestamp")
    return (events.filter((F.col("timestamp") > end - F.expr(f"INTERVAL {lookback}")) & (F.col("timestamp") <= end))
            .groupBy("src_ip").agg(F.count_distinct("dst_port").alias("ports")).filter(F.col("ports") > more_than))


def _where(test: Callable[[], Column]) -> Callable[[DataFrame], DataFrame]:
    return lambda events: events.filter(F.coalesce(test(), F.lit(False)))


# Named hunts that are plain predicates: name -> (technique, frame function). Search words are fixed values.
PRESETS: dict[str, tuple[str, Callable[[DataFrame], DataFrame]]] = {
    "ps_child": ("T1059.001", _where(lambda: F.lower("parent_process_name").isin("powershell.exe", "pwsh.exe")
                 & ~F.coalesce(F.lower("process_name"), F.lit("")).isin(COMMON_POWERSHELL_CHILDREN))),
    "auth_hours": ("T1078", _where(lambda: F.col("event_type").isin(AUTH_EVENT_TYPES)
                   & ((F.hour("timestamp") < 7) | (F.hour("timestamp") >= 19)))),
    "lolbin": ("T1218", _where(lambda: _one_of_text("process_name", ["certutil", "mshta", "regsvr32", "rundll32", "wscript"]))),
    "lateral": ("T1021", _where(lambda: any_of([_one_of_text(c, ["wmiprvse", "wmic", "psexec"]) for c in
                                                ("process_name", "parent_process_name", "command_line")]))),
    "cred_dump": ("T1003", _where(lambda: (F.col("event_type") == "process_access") | has_text("command_line", "lsass")
                  | has_text("file_path", "lsass") | has_text("command_line", "\\sam") | has_text("file_path", "\\sam"))),
    "dns_tunnel": ("T1071.004", dns_tunnel),
    "tls_ja3": ("T1573", _where(lambda: F.col("tls_ja3").isNotNull())),
    "http_ua": ("T1071.001", _where(lambda: (F.col("event_type") == "http") & (F.col("http_user_agent").isNull()
                | _one_of_text("http_user_agent", ["curl", "python-requests", "Go-http-client", "wget", "powershell"])))),
    "exfil_upload": ("T1048", _where(lambda: (F.col("event_type") == "http") & (F.col("http_request_body_len") > 1_000_000))),
    "ssh_brute": ("T1110.004", ssh_brute),
    "rdp_lateral": ("T1021.001", _where(lambda: (F.col("dst_port") == 3389) & is_private_ip(F.col("src_ip")))),
    "smb_enum": ("T1135", _where(lambda: has_text("smb_action", "tree_connect") | has_text("smb_action", "list")
                 | F.col("smb_path").isNotNull())),
    "ioc_hits": ("T1566", _where(lambda: F.col("ioc_matched"))),
    "zeek_notice": ("T1040", _where(lambda: F.col("zeek_notice_note").isNotNull() | F.col("zeek_weird_name").isNotNull())),
    "encoded_cmd": ("T1027", _where(lambda: _one_of_text("command_line", ["base64", "-enc", "-encodedcommand", "^"]))),
    "schtask_persist": ("T1053.005", _where(lambda: has_text("process_name", "schtasks") | has_text("process_name", "at.exe")
                        | (has_text("command_line", "schtasks") & (has_text("command_line", "create") | has_text("command_line", "/sc"))))),
    "ntlm_relay": ("T1557.001", _where(lambda: F.col("ntlm_username").isNotNull() | has_text("event_type", "ntlm"))),
    "av_kill": ("T1562.001", _where(lambda: _one_of_text("command_line", ["defender", "MpCmdRun", "sc stop", "net stop", "taskkill"]))),
}


def preset(events: DataFrame, name: str) -> DataFrame:
    return PRESETS[name][1](events)


# ---- ranking, fallback, views -------------------------------------------------------------------

def rank_results(rows: DataFrame, limit: int) -> DataFrame:
    return rows.orderBy(severity_rank(F.col("severity")), F.col("timestamp").desc(), F.col("event_id").desc()).limit(limit)


def keyword_search(events: DataFrame, keyword: str) -> DataFrame:
    text = F.lower(F.concat_ws(" ", "hostname", "username", "process_name", "command_line", "event_type", "src_ip", "dst_ip", "domain"))
    return events.filter(F.contains(text, F.lit(keyword.lower())))


def recent_http(events: DataFrame, limit: int = 200) -> DataFrame:
    return newest_first(events.filter((F.col("event_type") == "http") & F.col("domain").isNotNull()), limit)


def recent_dns(events: DataFrame, limit: int = 500) -> DataFrame:
    return newest_first(events.filter(F.col("event_type").isin(DNS_EVENT_TYPES) & F.col("dns_query").isNotNull()), limit)


def recent_tls(events: DataFrame, limit: int = 500, types: list[str] | None = None) -> DataFrame:
    return newest_first(events.filter(F.col("event_type").isin(types or TLS_EVENT_TYPES)), limit)


def list_detections(detections: DataFrame, feedback: DataFrame, severity=None, rule_id=None, case_id=None, verdict=None,
                    limit: int = 100, offset: int = 0) -> DataFrame:
    """Detections with their analyst verdict, newest first."""
    out = detections
    for column, value in (("severity", severity), ("rule_id", rule_id), ("case_id", case_id)):
        if value:
            out = out.filter(F.col(column) == value)
    out = out.join(feedback.select(F.col("detection_id").alias("id"), "verdict"), "id", "left")
    if verdict:
        out = out.filter(F.col("verdict") == verdict)
    return newest_first(out, limit, offset, "created_at", "id")


def triage_batch(detections: DataFrame, limit: int = 20) -> DataFrame:
    """Newest untriaged detections with a one-line summary each."""
    def t(c):
        return F.coalesce(F.col(c), F.lit("?"))
    rows = newest_first(detections.filter(F.col("triaged_at").isNull()), limit, 0, "created_at", "id")
    return rows.withColumn("summary", F.format_string(
        "Rule: %s | Severity: %s | Technique: %s | Tactic: %s", t("rule_name"), t("severity"), t("attack_technique"), t("attack_tactic")))


def mark_triaged(detections: DataFrame, batch: DataFrame, at: Column) -> DataFrame:
    """The detection table with the batch stamped; written back as a new version."""
    done = batch.select("id", F.lit(True).alias("_done"))
    return detections.join(done, "id", "left").withColumn(
        "triaged_at", F.when(F.col("_done"), at).otherwise(F.col("triaged_at"))).select(*detections.columns)


def top_threats(detections: DataFrame, limit: int = 10) -> DataFrame:
    return detections.orderBy(F.col("risk_score").desc(), F.col("created_at").desc(), "id").limit(limit)


def list_anomalies(events: DataFrame, min_score: float = 0.7, limit: int = 50) -> DataFrame:
    return events.filter(F.col("anomaly_score") >= min_score) \
                 .orderBy(F.col("anomaly_score").desc(), F.col("timestamp").desc(), "event_id").limit(limit)


def list_recommendations(recs: DataFrame, status=None, case_id=None, limit: int = 50, offset: int = 0) -> DataFrame:
    for column, value in (("status", status), ("case_id", case_id)):
        if value:
            recs = recs.filter(F.col(column) == value)
    return newest_first(recs, limit, offset, "generated_at", "recommendation_id")


def pending_notifications(notes: DataFrame, limit: int = 100) -> DataFrame:
    return newest_first(notes.filter(F.col("status") == "pending"), limit, 0, "created_at", "notification_id")


def case_context(events: DataFrame, detections: DataFrame, case_id: str, limit: int = 50) -> DataFrame:
    """Newest case events and case detections merged in time order."""
    ev = newest_first(events.filter(F.col("case_id") == case_id), limit).select(
        F.lit("event").alias("kind"), F.col("event_id").alias("item"), "timestamp", F.col("event_type").alias("title"))
    det = newest_first(detections.filter(F.col("case_id") == case_id), limit, 0, "created_at", "id").select(
        F.lit("detection"), "id", "created_at", "rule_name")
    return ev.union(det).orderBy("timestamp", "kind", "item")


def hunt_history(hunts: DataFrame, analyst: str, limit: int = 20) -> DataFrame:
    return newest_first(hunts.filter(F.col("analyst_id") == analyst), limit, 0, "created_at", "hunt_id")


# What a hunt may be made of: nodes of the parsed statement by class name, and functions. Anything else is refused.
HUNT_PLANS = set("""Project Filter Aggregate Sort GlobalLimit LocalLimit Offset Distinct SubqueryAlias UnresolvedSubqueryColumnAliases UnresolvedHaving Join Union Intersect Except
    UnresolvedWith UnresolvedRelation OneRowRelation Generate""".split())
HUNT_EXPRESSIONS = set("""UnresolvedAttribute UnresolvedStar UnresolvedAlias UnresolvedExtractValue UnresolvedFunction UnresolvedGenerator UnresolvedNamedLambdaVariable LambdaFunction Alias MultiAlias Literal Cast
    And Or Not EqualTo EqualNullSafe GreaterThan GreaterThanOrEqual LessThan LessThanOrEqual IsNull IsNotNull In InSubquery ListQuery ScalarSubquery Exists Like ILike RLike LikeAny LikeAll NotLikeAny
    NotLikeAll CaseWhen Add Subtract Multiply Divide IntegralDivide Remainder UnaryMinus UnaryPositive BitwiseAnd BitwiseOr BitwiseXor BitwiseNot Concat CreateNamedStruct StringTrim StringTrimLeft
    StringTrimRight StringLocate Overlay Substring TimestampAdd TimestampDiff SortOrder WindowExpression WindowSpecDefinition SpecifiedWindowFrame UnspecifiedFrame CurrentRow UnboundedPreceding
    UnboundedFollowing Rollup Cube GroupingSets""".split())
HUNT_FUNCTIONS = set("""abs array array_agg array_contains array_distinct array_join array_max array_min array_position array_sort array_union arrays_overlap approx_count_distinct ascii avg between bit_length bool_and
    bool_or cardinality ceil char_length coalesce collect_list collect_set concat concat_ws contains corr count count_if crc32 cume_dist current_date current_timestamp date date_add date_diff date_format
    date_sub date_trunc datediff day dayofmonth dayofweek dayofyear decode dense_rank element_at encode endswith every exists exp explode explode_outer extract filter find_in_set first first_value flatten
    floor forall from_unixtime get_json_object greatest hash hex hour if ifnull initcap instr isnotnull isnull json_array_length lag last last_value lcase lead least left length levenshtein ln locate log
    log10 log2 lower lpad ltrim map_keys map_values max max_by md5 mean median min min_by minute mod month now nth_value ntile nullif nvl nvl2 octet_length parse_url percent_rank percentile
    percentile_approx percentile_cont percentile_disc pmod posexplode position pow power quarter rank regexp regexp_count regexp_extract regexp_extract_all regexp_instr regexp_like regexp_replace
    regexp_substr repeat replace reverse right round row_number rpad rtrim second sequence sha1 sha2 sign size slice sort_array split split_part sqrt startswith stddev stddev_pop stddev_samp struct""".split()) | set(
    """substr substring substring_index sum timestamp to_date to_timestamp transform translate trim trunc try_cast try_divide ucase unbase64 unhex unix_micros unix_millis unix_timestamp upper url_decode
    var_pop var_samp variance weekday weekofyear when window xxhash64 year zip_with""".split())
HUNT_NAMES_REFUSED = {"_metadata", "user", "current_user", "session_user"}     # resolve without being columns


def _items(seq) -> list:
    return [seq.apply(k) for k in range(seq.size())]


def _check_hunt(node, readable: frozenset[str], view: str) -> None:
    """Walks the parsed statement. ``readable`` holds the names a relation may have here: the view, and the WITH names in scope."""
    kind, where = node.getClass().getSimpleName().rstrip("$"), node.getClass().getName()
    is_expression = kind in HUNT_EXPRESSIONS
    if not where.startswith("org.apache.spark.sql.catalyst.") or not (is_expression or kind in HUNT_PLANS):
        raise ValueError(f"not allowed in a hunt: {kind}")
    if kind == "UnresolvedRelation":
        parts = _items(node.multipartIdentifier())
        if len(parts) != 1 or parts[0].lower() not in readable or node.isStreaming():
            raise ValueError(f"only {view} can be read")
    elif kind in ("UnresolvedFunction", "UnresolvedGenerator"):
        name = ".".join(_items(node.nameParts())) if kind == "UnresolvedFunction" else node.name().unquotedString()
        if name.lower() not in HUNT_FUNCTIONS:
            raise ValueError(f"function not allowed in a hunt: {name}")
    elif kind == "UnresolvedAttribute" and any(p.lower() in HUNT_NAMES_REFUSED for p in _items(node.nameParts())):
        raise ValueError(f"not a column: {node.name()}")
    elif kind == "UnresolvedWith":
        for named in _items(node.cteRelations()):                # a body sees the names before its own, not its own
            _check_hunt(named._2(), readable, view)
            readable = readable | {named._1().lower()}
    for child in _items(node.children()) + ([] if is_expression else _items(node.expressions())):
        _check_hunt(child, readable, view)
    if kind in ("ListQuery", "ScalarSubquery", "Exists"):
        _check_hunt(node.plan(), readable, view)


def hunt_sql(events: DataFrame, sql: str, view: str = "normalized_events", limit: int = 500) -> DataFrame:
    """A user's own SELECT over the event view and its own WITH names, at most ``limit`` rows back.

    The nodes of the parsed statement are walked, subqueries included: a class, function or relation that is not on the list is
    refused, so other tables, files, names computed by ``identifier``, table functions and calls into Java never get analysed.
    """
    statement = sql.strip().rstrip(";")
    if not re.match(r"(?is)^\s*(select|with)\b", statement) or ";" in statement:
        raise ValueError("one SELECT statement is allowed")
    if "${" in statement:
        raise ValueError("variables are not allowed")           # they would be replaced before parsing
    spark = events.sparkSession
    _check_hunt(spark._jsparkSession.sessionState().sqlParser().parsePlan(statement), frozenset({view.lower()}), view)
    events.createOrReplaceTempView(view)
    return spark.sql(statement).limit(limit)
