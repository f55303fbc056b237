"""Line formats: IDS JSON, firewall syslog, host-agent results, Windows events."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tidewatch.functions.scalars import parse_once, MAX_TEXT_BYTES, parse_time, sha256_from_hash_list
from tidewatch.schema import conform, lookup
from tidewatch.sources.records import event_key, register_source


def _now(ingested_at: Column | None) -> Column:
    return ingested_at if ingested_at is not None else F.current_timestamp()


def _file(lines: DataFrame) -> Column:
    return F.col("source_file") if "source_file" in lines.columns else F.lit("stream")


def _text(c: Column) -> Column:
    return F.nullif(F.trim(c), F.lit(""))


# ---- IDS JSON lines ------------------------------------------------------------------------------------

# Fixed values.
EVE_TYPES = {"alert": "detection", "flow": "network_connect", "dns": "dns_query", "http": "network_connect", "tls": "network_connect", "heartbeat": "heartbeat"}
EVE_SEVERITY = {1: "critical", 2: "high", 3: "medium", 4: "low"}
EVE_ACTION = {"allowed": "success", "blocked": "failure"}
EVE_DDL = """timestamp string, event_type string, src_ip string, dest_ip string, src_port string, dest_port string, proto string, host string, flow_id string,
alert struct<severity:int, signature:string, signature_id:string, category:string, action:string,
  metadata:struct<mitre_attack_id:array<string>, mitre_tactic_name:array<string>>>,
dns struct<rrname:string, rrtype:string>, http struct<hostname:string, url:string, http_method:string>, flow struct<state:string>"""


def eve_events(lines: DataFrame, ingested_at: Column | None = None) -> DataFrame:
    """IDS JSON lines (value). Broken lines are dropped."""
    now = _now(ingested_at)

    def d(path: str) -> Column:
        return F.col(f"d.{path}")

    rows = parse_once(lines, F.from_json("value", EVE_DDL), "d").filter(d("event_type").isNotNull() | d("timestamp").isNotNull())
    kind = d("event_type")
    alert, dns, http = kind == "alert", kind == "dns", kind == "http"

    def tag(when: Column, label: str, value: Column) -> Column:
        return F.when(when & value.isNotNull() & (value != ""), F.concat(F.lit(label + ":"), value))

    tags = F.concat_ws(",", tag(alert, "sid", d("alert.signature_id")), tag(alert, "category", d("alert.category")), tag(dns, "dns_type", d("dns.rrtype")),
                       tag(http, "method", d("http.http_method")), tag(F.lit(True), "flow_id", d("flow_id")))
    out = rows.select(
        event_key(_file(lines), F.col("value")).alias("event_id"), F.coalesce(parse_time(d("timestamp")), now).alias("timestamp"), now.alias("ingested_at"),
        F.lit("suricata_eve").alias("source_type"), _file(lines).alias("source_file"), d("host").alias("hostname"), d("src_ip").alias("src_ip"),
        d("src_port").try_cast("int").alias("src_port"), d("dest_ip").alias("dst_ip"), d("dest_port").try_cast("int").alias("dst_port"),
        F.when(dns, d("dns.rrname")).when(http, d("http.hostname")).alias("domain"), F.when(http, d("http.url")).alias("url"),
        F.coalesce(lookup(EVE_TYPES, kind), _text(kind)).alias("event_type"),
        F.when(alert, F.coalesce(lookup(EVE_SEVERITY, F.coalesce(d("alert.severity"), F.lit(4))), F.lit("low"))).otherwise("info").alias("severity"),
        F.when(alert, d("alert.signature")).alias("detection_source"),
        F.when(alert, F.get(d("alert.metadata.mitre_attack_id"), F.lit(0))).alias("attack_technique"),
        F.when(alert, F.get(d("alert.metadata.mitre_tactic_name"), F.lit(0))).alias("attack_tactic"), d("proto").alias("network_protocol"),
        F.when(alert, lookup(EVE_ACTION, d("alert.action"))).when((kind == "flow") & (d("flow.state") == "closed"), "success").alias("event_outcome"),
        _text(tags).alias("tags"), F.substring("value", 1, MAX_TEXT_BYTES).alias("raw_event"))
    return conform(out)


# ---- firewall syslog --------------------------------------------------------------------------------------

# Fixed values.
SYSLOG_LINE = r"^(\w{3})\s+(\d{1,2})\s+(\d{2}:\d{2}:\d{2})\s+(\S+)\s+kernel:\s+(\S+)\s+(IN=.*)$"
ZONES = {"green0": "green", "red0": "red", "blue0": "blue", "orange0": "orange"}
PASS_PREFIXES = ["FORWARDFW", "INPUTFW"]


def firewall_events(lines: DataFrame, as_of: Column | None = None, ingested_at: Column | None = None) -> DataFrame:
    """RFC 3164 firewall lines (value). The missing year is the current one, or last year when that lies over 30 days ahead."""
    now = _now(ingested_at)
    ref = as_of if as_of is not None else now
    line = F.trim("value")

    def group(i: int) -> Column:
        return F.regexp_extract("line", SYSLOG_LINE, i)

    rows = lines.withColumn("line", line).filter(F.col("line").rlike(SYSLOG_LINE)).withColumns({
        "prefix": group(5), "kv": F.map_from_entries(F.array_distinct(F.zip_with(
            F.regexp_extract_all(group(6), F.lit(r"(\w+)=(\S*)"), F.lit(1)), F.regexp_extract_all(group(6), F.lit(r"(\w+)=(\S*)"), F.lit(2)),
            lambda k, v: F.struct(k, v)))), "host": group(4),
        "md": F.concat_ws(" ", group(1), F.lpad(group(2), 2, "0"), group(3))})

    def kv(name: str) -> Column:
        return _text(F.try_element_at("kv", F.lit(name)))

    def at(year: Column) -> Column:
        return F.try_to_timestamp(F.concat_ws(" ", year.cast("string"), "md"), F.lit("yyyy MMM dd HH:mm:ss"))

    this = at(F.year(ref))
    when = F.when(this > ref + F.expr("INTERVAL 30 DAYS"), at(F.year(ref) - 1)).otherwise(this)
    good = F.col("prefix").isin(PASS_PREFIXES)

    def zone(side: str) -> Column:
        return F.concat(F.lit("zone:"), lookup(ZONES, kv(side)))

    tags = F.concat_ws(",", F.concat(F.lit("in:"), kv("IN")), F.concat(F.lit("out:"), kv("OUT")), zone("IN"), zone("OUT"))
    return conform(rows.select(
        event_key(_file(lines), F.col("line")).alias("event_id"), F.coalesce(when, now).alias("timestamp"), now.alias("ingested_at"),
        F.lit("ipfire_syslog").alias("source_type"), _file(lines).alias("source_file"), F.col("host").alias("hostname"), kv("SRC").alias("src_ip"),
        kv("SPT").try_cast("int").alias("src_port"), kv("DST").alias("dst_ip"), kv("DPT").try_cast("int").alias("dst_port"),
        F.lit("network_connect").alias("event_type"), F.when(good, "info").otherwise("medium").alias("severity"), F.col("prefix").alias("detection_source"),
        F.substring("line", 1, MAX_TEXT_BYTES).alias("raw_event"), _text(tags).alias("tags"), kv("PROTO").alias("network_protocol"),
        F.when(good, "success").otherwise("failure").alias("event_outcome")))


# ---- host agent results ---------------------------------------------------------------------------------------

# Event type -> the words in a query name that mean it.
QUERY_KINDS = {
    "process_create": ["process", "proc", "startup"],
    "network_connect": ["socket", "network", "listen", "open_socket"],
    "file_create": ["file", "path"],
    "logon_event": ["user", "account", "login"],
}


def osquery_events(lines: DataFrame, ingested_at: Column | None = None) -> DataFrame:
    """Result envelopes (value): snapshot rows, else the differential columns, else data rows."""
    now = _now(ingested_at)
    ddl = "name string, queryName string, unixTime string, calendarTime string, snapshot array<map<string,string>>, columns map<string,string>, data array<map<string,string>>"
    d = F.col("d")
    rows = parse_once(lines, F.from_json("value", ddl), "d").filter(d.isNotNull())
    records = F.when(F.size(d["snapshot"]) > 0, d["snapshot"]).when(F.size(d["columns"]) > 0, F.array(d["columns"])).otherwise(d["data"])
    rows = rows.select("value", _file(lines).alias("source_file"), F.coalesce(_text(d["name"]), _text(d["queryName"]), F.lit("unknown")).alias("q"),
                       F.coalesce(d["unixTime"].try_cast("bigint"), d["calendarTime"].try_cast("bigint")).alias("t"), F.posexplode(records).alias("n", "c"))

    def c(*names: str) -> Column:
        return F.coalesce(*[_text(F.try_element_at("c", F.lit(n))) for n in names])

    low = F.lower("q")
    kind = F.lit(None).cast("string")
    for name, words in reversed(QUERY_KINDS.items()):
        kind = F.when(low.rlike("|".join(words)), name).otherwise(kind)
    who = c("uid", "username", "user")
    return conform(rows.select(
        event_key(F.col("source_file"), F.col("value"), F.col("n").cast("string")).alias("event_id"),
        F.coalesce(F.timestamp_seconds(F.when(F.col("t") != 0, F.col("t"))), now).alias("timestamp"), now.alias("ingested_at"), F.lit("osquery").alias("source_type"),
        "source_file", c("hostname", "host", "host.hostname", "host.name").alias("hostname"),
        F.coalesce(F.when(who.try_cast("bigint").isNull(), who), c("username", "user")).alias("username"), c("name", "path").alias("process_name"),
        c("pid").try_cast("int").alias("process_id"), c("parent", "ppid").try_cast("int").alias("parent_process_id"),
        F.when(c("name", "path") != c("path"), c("path")).alias("file_path"), F.substring(c("cmdline", "command_line"), 1, MAX_TEXT_BYTES).alias("command_line"),
        c("local_address", "src_ip", "source").alias("src_ip"), c("local_port", "src_port").try_cast("int").alias("src_port"),
        c("remote_address", "dst_ip", "destination").alias("dst_ip"), c("remote_port", "dst_port").try_cast("int").alias("dst_port"), kind.alias("event_type"),
        F.to_json(F.struct(F.col("q").alias("query_name"), F.col("c").alias("columns"))).alias("raw_event"), F.concat(F.lit("osquery:"), "q").alias("tags")))


# ---- Windows events ---------------------------------------------------------------------------------------------

# Event id -> type, exported logs.
EXPORT_SYSMON = {
    1: "process_create", 2: "file_creation_time_changed", 3: "network_connect", 5: "process_terminate", 6: "driver_load", 7: "image_load",
    8: "create_remote_thread", 9: "raw_disk_access", 10: "process_access", 11: "file_create", 12: "registry_event", 13: "registry_value_set",
    14: "registry_key_rename", 15: "file_create_stream_hash", 17: "pipe_event", 18: "pipe_connection", 19: "wmi_event", 20: "wmi_consumer",
    21: "wmi_subscription", 22: "dns_query", 23: "file_delete", 24: "clipboard_event", 25: "process_tampering", 26: "file_delete_detected"}
EXPORT_SECURITY = {
    4624: "logon_success", 4625: "logon_failure", 4634: "logoff", 4648: "explicit_credential_logon", 4672: "special_privileges_assigned",
    4688: "process_create", 4698: "scheduled_task_created", 4720: "user_account_created", 4726: "user_account_deleted", 4768: "kerberos_tgs_request",
    4769: "kerberos_service_ticket", 4776: "ntlm_auth", 4798: "user_group_membership_enumerated", 4799: "security_group_enumerated"}
# Event id -> type, live logs by channel.
LIVE_CHANNELS = {
    "Sysmon": {
        1: "process_create", 2: "file_creation_time_changed", 3: "network_connect", 5: "process_terminate", 6: "driver_load", 7: "image_load",
        8: "create_remote_thread", 9: "raw_access_read", 10: "process_access", 11: "file_create", 12: "registry_event", 13: "registry_value_set",
        14: "registry_key_rename", 15: "file_create_stream_hash", 16: "sysmon_config_change", 17: "pipe_created", 18: "pipe_connected",
        19: "wmi_event_filter_activity", 20: "wmi_event_consumer_activity", 21: "wmi_event_consumer_to_filter_activity", 22: "dns_query",
        23: "file_delete", 25: "process_tamper", 26: "file_delete_detected", 29: "file_executable_detected"},
    "Security": {
        4624: "logon", 4625: "logon_failure", 4648: "logon_explicit_cred", 4672: "special_logon", 4688: "process_create", 4697: "service_installed",
        4698: "scheduled_task_created", 4699: "scheduled_task_deleted", 4700: "scheduled_task_enabled", 4701: "scheduled_task_disabled",
        4702: "scheduled_task_updated", 4720: "user_account_created", 4722: "user_account_enabled", 4725: "user_account_disabled",
        4726: "user_account_deleted", 4732: "user_added_to_group", 4756: "user_added_to_global_group", 4768: "kerberos_ticket_requested",
        4769: "kerberos_service_ticket_requested", 4771: "kerberos_pre_auth_failed"},
    "PowerShell": {
        4100: "powershell_error", 4101: "powershell_execute_pipeline", 4102: "powershell_complete_pipeline", 4103: "powershell_module_logging",
        4104: "powershell_script_block", 4105: "powershell_command_start", 4106: "powershell_command_stop", 40961: "powershell_console_start",
        40962: "powershell_console_ready", 53504: "powershell_ipc_thread"},
    "WMI": {5857: "wmi_activity", 5858: "wmi_activity_error", 5859: "wmi_subscription_event", 5860: "wmi_temporary_subscription", 5861: "wmi_permanent_subscription"},
    "TaskScheduler": {106: "scheduled_task_registered", 141: "scheduled_task_deleted", 200: "scheduled_task_started", 201: "scheduled_task_completed", 319: "scheduled_task_failed"},
}


def _node(value: Column) -> Column:
    """Plain value or the ``#text`` of an attribute node."""
    return _text(F.when(value.startswith("{"), F.get_json_object(value, "$['#text']")).otherwise(value))


def _named(name: str) -> Column:
    return F.filter("pairs", lambda p: (p["k"] == name) & (F.trim(p["v"]) != ""))


def _from_fields(get, user: Column) -> dict[str, Column]:
    """Columns shared by exported and live events; ``get`` returns the first non-empty named field."""
    return {
        "username": user, "process_name": get("Image", "NewProcessName", "ProcessName"), "command_line": F.substring(get("CommandLine"), 1, MAX_TEXT_BYTES),
        "process_id": get("ProcessId", "NewProcessId").try_cast("int"), "parent_process_id": get("ParentProcessId").try_cast("int"),
        "parent_process_name": get("ParentImage", "ParentProcessName"), "src_port": get("SourcePort").try_cast("int")}


def windows_export_events(lines: DataFrame, ingested_at: Column | None = None) -> DataFrame:
    """Exported event records (value = {"event_record_id", "timestamp", "data"}), data being the event as JSON text."""
    now = _now(ingested_at)
    outer = parse_once(lines, F.from_json("value", "event_record_id string, timestamp string, data string"), "o").filter("o IS NOT NULL")
    body = F.coalesce(F.get_json_object("o.data", "$.Event"), F.col("o.data"))
    ddl = "System struct<TimeCreated:string, EventID:string, Channel:string, Computer:string, EventRecordID:string>, EventData string"
    rows = parse_once(outer, F.from_json(body, ddl), "e")
    rows = parse_once(rows, F.get_json_object("e.EventData", "$.Data"), "data_node")
    item = "array<map<string,string>>"
    listed = F.when(F.col("data_node").startswith("["), F.from_json("data_node", item)).when(F.col("data_node").startswith("{"), F.array(F.from_json("data_node", "map<string,string>")))
    pairs = F.transform(listed, lambda m: F.struct(F.coalesce(F.try_element_at(m, F.lit("@Name")), F.try_element_at(m, F.lit("Name"))).alias("k"),
                                                   F.coalesce(F.try_element_at(m, F.lit("#text")), F.try_element_at(m, F.lit("value"))).alias("v")))
    rows = parse_once(rows, F.filter(pairs, lambda p: p["k"].isNotNull()), "pairs")
    rows = parse_once(rows, F.from_json("e.EventData", "map<string,string>"), "flat")

    def get(*names: str) -> Column:
        cells = []
        for n in names:
            hit = F.get(_named(n), F.lit(0))["v"]
            cells += [F.trim(hit), F.when(F.col("data_node").isNull(), _text(F.try_element_at("flat", F.lit(n))))]
        return F.coalesce(*cells)

    s = F.col("e.System")
    number = _node(s["EventID"]).try_cast("int")
    channel, computer = _node(s["Channel"]), _node(s["Computer"])
    record = F.coalesce(_text(F.col("o.event_record_id")), _node(s["EventRecordID"]))
    hashes = get("Hashes", "Hash")
    created = s["TimeCreated"]
    time = F.coalesce(F.get_json_object(created, "$['@SystemTime']"), F.get_json_object(created, "$['#attributes'].SystemTime"), F.col("o.timestamp"))
    cells = _from_fields(get, get("SubjectUserName", "TargetUserName", "User"))
    cells.update({
        "event_id": F.when(record.isNotNull() & computer.isNotNull(), F.concat(F.lit("evtx:"), computer, F.lit(":"), record)).otherwise(event_key(_file(lines), F.col("value"))),
        "timestamp": F.coalesce(parse_time(time), now), "ingested_at": now, "source_type": F.lit("evtx"), "source_file": _file(lines), "hostname": computer,
        "dst_ip": get("DestinationIp", "DestAddress"), "dst_port": get("DestinationPort", "DestPort").try_cast("int"), "src_ip": get("SourceIp", "SourceAddress"),
        "domain": get("DestinationHostname", "QueryName"), "file_path": get("TargetFilename", "TargetObject", "ObjectName"),
        "file_hash_sha256": F.when(F.upper(hashes).contains("SHA256="), sha256_from_hash_list(hashes)).otherwise(hashes),
        "event_type": F.when(F.lower(channel).contains("sysmon"), lookup(EXPORT_SYSMON, number)).otherwise(lookup(EXPORT_SECURITY, number)),
        "raw_event": F.substring("o.data", 1, MAX_TEXT_BYTES)})
    return conform(rows.select(*[c.alias(n) for n, c in cells.items()]))


def windows_live_events(lines: DataFrame, ingested_at: Column | None = None) -> DataFrame:
    """Collected live-log records (value = JSON with Id, TimeCreated, MachineName, UserId, Message; channel)."""
    now = _now(ingested_at)
    ddl = "Id string, TimeCreated string, MachineName string, UserId string, Message string"
    message = F.substring("d.Message", 1, MAX_TEXT_BYTES)
    parts = F.transform(F.filter(F.split(message, r"\r?\n"), lambda x: x.contains(":")),
                        lambda x: F.struct(F.trim(F.substring_index(x, ":", 1)).alias("k"), F.trim(F.regexp_extract(x, r"^[^:]*:(.*)$", 1)).alias("v")))
    rows = parse_once(lines, F.from_json("value", ddl), "d").filter("d IS NOT NULL")
    rows = parse_once(rows, F.filter(parts, lambda p: (p["k"] != "") & (p["v"] != "")), "pairs")

    def get(*names: str) -> Column:  # a repeated field keeps its last value
        return F.coalesce(*[F.try_element_at(_named(n), F.lit(-1))["v"] for n in names])

    t = F.col("d.TimeCreated")
    number = F.col("d.Id").try_cast("int")
    kind = F.lit(None).cast("string")
    for channel, types in LIVE_CHANNELS.items():
        kind = F.when(F.lower("channel").contains(channel.lower()), lookup(types, number)).otherwise(kind)
    sid = _text(F.when(F.col("d.UserId").startswith("{"), F.get_json_object("d.UserId", "$.Value")).otherwise(F.col("d.UserId")))
    cells = _from_fields(get, F.coalesce(get("User", "SubjectUserName"), sid))
    cells.update({
        "event_id": event_key(F.col("channel"), F.col("value")),
        "timestamp": F.coalesce(F.timestamp_millis(F.nullif(F.regexp_extract(t, r"^/Date\((-?\d+)", 1), F.lit("")).try_cast("bigint")), parse_time(t), now),
        "ingested_at": now, "source_type": F.lit("winevent"), "source_file": F.col("channel"), "hostname": _text(F.col("d.MachineName")), "event_type": kind,
        "file_path": get("TargetFilename", "TargetObject"), "file_hash_sha256": sha256_from_hash_list(get("Hashes")), "src_ip": get("SourceIp"),
        "dst_ip": get("DestinationIp"), "dst_port": get("DestinationPort").try_cast("int"), "domain": get("QueryName", "DestinationHostname"),
        "raw_event": F.to_json(F.struct(number.alias("EventID"), F.col("channel").alias("Channel"), F.substring(message, 1, 2048).alias("Message")))})
    return conform(rows.select(*[c.alias(n) for n, c in cells.items()]))


# ---- pre-normalizer -----------------------------------------------------------------------------------------------

# Fixed values.
RELAY_SEVERITY = {"1": "critical", "2": "high", "3": "medium", "4": "low", "critical": "critical", "high": "high", "medium": "medium", "low": "low",
                  "info": "info", "informational": "info"}


def relay_documents(docs: DataFrame) -> DataFrame:
    """Sensor documents (value) as flat relay records; protocol objects pass through as JSON text."""
    rows = parse_once(docs, F.from_json("value", "map<string,string>"), "m").filter("m IS NOT NULL")

    def j(*paths: str) -> Column:
        """Top-level key, or ``object.field`` one level down."""
        cells = []
        for p in paths:
            head, _, leaf = p.partition("/")
            top = F.try_element_at("m", F.lit(head))
            cells.append(_text(F.get_json_object(top, f"$.{leaf}") if leaf else top))
        return F.coalesce(*cells)

    return rows.select(
        j("@timestamp").alias("timestamp"), F.lit("suricata_eve").alias("source_type"), j("event/type", "event.type").alias("event_type"),
        j("observer/hostname", "agent/hostname").alias("hostname"), j("source/ip", "src_ip").alias("src_ip"), j("destination/ip", "dst_ip").alias("dst_ip"),
        j("source/port", "src_port").try_cast("int").alias("src_port"), j("destination/port", "dst_port").try_cast("int").alias("dst_port"),
        F.coalesce(lookup(RELAY_SEVERITY, F.lower(j("event/severity", "alert/severity"))), F.lit("info")).alias("severity"),
        *[j(n).alias(n) for n in ("dns", "tls", "file", "http", "alert")], F.substring("value", 1, MAX_TEXT_BYTES).alias("raw_event"))


def relay_syslog(lines: DataFrame, received_at: Column | None = None) -> DataFrame:
    return lines.select(_now(received_at).alias("timestamp"), F.lit("ipfire_syslog").alias("source_type"), F.lit("syslog").alias("event_type"),
                        F.lit("info").alias("severity"), F.substring(F.trim("value"), 1, MAX_TEXT_BYTES).alias("raw_event"))


register_source("eve", eve_events)
register_source("firewall", firewall_events)
register_source("osquery", osquery_events)
register_source("windows_export", windows_export_events)
