"""Network-sensor documents (IDS in ECS shape and protocol logs): one declarative map, one parse, one pass.

``PATHS`` lists for every kind of document where each event column is looked for, in order: a nested path (``a.b.c``), or a
flat key written with its dots (``=a.b.c``). All paths form one ``from_json`` schema, so a document is parsed once, and each
column is one CASE over the kind.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from tidewatch.functions.scalars import MAX_TEXT_BYTES, parse_time
from tidewatch.schema import EVENT_SCHEMA, conform
from tidewatch.functions.scalars import parse_once
from tidewatch.sources.records import event_key, register_source

SRC = ["source.ip", "src_ip", "srcip"]
DST = ["destination.ip", "dst_ip", "dstip"]
PORTS = {"src_port": ["source.port", "src_port"], "dst_port": ["destination.port", "dst_port"]}
SENSOR_HOST = ["observer.hostname", "agent.hostname"]


def _z(log: str, name: str) -> list[str]:
    """A protocol log field: nested, then as one dotted key."""
    return [f"zeek.{log}.{name}", f"=zeek.{log}.{name}"]


# kind -> (event_type, severity, detection source, {column: paths}). Fixed values.
PATHS: dict[str, tuple[str, str, str, dict[str, list[str]]]] = {
    "alert": ("alert", "info", "malcolm_alert", {**PORTS, "severity": ["event.severity", "alert.severity"], "detection_source": ["rule.name", "alert.signature"]}),
    "syslog": ("syslog", "info", "ipfire_syslog", {"hostname": ["host.name", "hostname"]}),
    "eve_tls": ("tls", "info", "suricata_tls", {
        **PORTS, "tls_version": ["tls.version", "=tls.version", "=tls.version_string"], "tls_ja3": ["tls.ja3.hash", "=tls.ja3.hash", "ja3"],
        "tls_ja3s": ["tls.ja3s.hash", "=tls.ja3s.hash", "ja3s"], "tls_sni": ["tls.sni", "=tls.sni", "host.name"], "tls_cipher": ["tls.cipher", "=tls.cipher"],
        "tls_cert_subject": ["tls.server.x509.subject.common_name", "=tls.server.x509.subject.common_name"], "tls_validation_status": ["tls.established"]}),
    "eve_dns": ("dns_query", "info", "suricata_dns", {
        **PORTS, "dns_query": ["dns.question.name", "=dns.question.name", "=dns.query"], "dns_query_type": ["dns.question.type", "=dns.question.type", "=dns.type"],
        "dns_rcode": ["dns.response_code", "=dns.response_code", "=dns.rcode"], "dns_answers": ["dns.answers", "=dns.answers"]}),
    "eve_fileinfo": ("file_transfer", "info", "suricata_fileinfo", {
        **PORTS, "file_md5": ["file.hash.md5", "=file.hash.md5", "md5"], "file_sha256_eve": ["file.hash.sha256", "=file.hash.sha256"],
        "file_mime_type": ["file.type", "=file.mime_type", "=file.type"], "file_size_bytes": ["file.size", "=file.size"]}),
    "eve_anomaly": ("anomaly", "high", "malcolm_anomaly", {**PORTS, "severity": ["event.severity", "alert.severity"], "detection_source": ["event.action", "anomaly.type"]}),
    "conn": ("conn", "info", "zeek_conn", {
        **PORTS, "conn_state": _z("conn", "state") + ["network.state"], "conn_duration": ["network.duration", "event.duration"],
        "conn_orig_bytes": ["source.bytes", "network.bytes"], "conn_resp_bytes": ["destination.bytes"], "network_protocol": ["network.transport"]}),
    "weird": ("weird", "high", "zeek_weird", {**PORTS, "zeek_weird_name": _z("weird", "name") + ["weird_name"]}),
    "http": ("http", "info", "zeek_http", {
        **PORTS, "http_method": ["http.request.method", "=zeek.http.method"], "http_uri": ["url.original", "=url.original"],
        "http_status_code": ["http.response.status_code", "=zeek.http.status_code"], "http_user_agent": ["user_agent.original", "=user_agent.original"],
        "domain": ["destination.domain", "url.domain"], "http_referrer": ["http.request.referrer"] + _z("http", "referrer"),
        "http_request_body_len": ["http.request.body.bytes"] + _z("http", "request_body_len"),
        "http_response_body_len": ["http.response.body.bytes"] + _z("http", "response_body_len"), "http_resp_mime_type": _z("http", "resp_mime_types")}),
    "tls": ("ssl", "info", "zeek_ssl", {
        **PORTS, "tls_version": ["tls.version", "zeek.ssl.version"], "tls_ja3": ["tls.client.ja3", "=tls.client.ja3"],
        "tls_sni": _z("ssl", "server_name") + ["tls.client.server_name"], "tls_cert_subject": ["tls.server.subject", "zeek.ssl.subject"]}),
    "x509": ("x509", "info", "zeek_x509", {"tls_cert_subject": ["zeek.x509.subject", "tls.server.subject", "=zeek.x509.subject"]}),
    "fileinfo": ("files", "info", "zeek_files", {
        "file_md5": ["file.hash.md5", "zeek.files.md5"], "file_sha256_eve": ["file.hash.sha256"], "file_mime_type": ["file.mime_type", "zeek.files.mime_type"],
        "file_size_bytes": ["file.size", "zeek.files.total_bytes"], "file_path": ["file.name", "zeek.files.filename"]}),
    "notice": ("notice", "high", "zeek_notice", {"zeek_notice_note": _z("notice", "note"), "zeek_notice_msg": _z("notice", "msg")}),
    "kerberos": ("kerberos_tgs_request", "info", "zeek_kerberos", {"kerberos_client": _z("kerberos", "client"), "kerberos_service": _z("kerberos", "service"), "username": _z("kerberos", "client")}),
    "ntlm": ("ntlm_auth", "info", "zeek_ntlm", {"username": _z("ntlm", "username"), "ntlm_username": _z("ntlm", "username"), "ntlm_domain": _z("ntlm", "domain")}),
    "ssh": ("ssh", "info", "zeek_ssh", {**PORTS, "ssh_auth_success": _z("ssh", "auth_success"), "ssh_version": _z("ssh", "version")}),
    "smb_mapping": ("smb_mapping", "info", "zeek_smb_mapping", {"smb_path": _z("smb_mapping", "path")}),
    "smb_files": ("smb_files", "info", "zeek_smb_files", {"smb_action": _z("smb_files", "action"), "smb_path": _z("smb_files", "name")}),
    "rdp": ("rdp", "info", "zeek_rdp", {"rdp_cookie": _z("rdp", "cookie"), "rdp_security_protocol": _z("rdp", "security_protocol")}),
    "dce_rpc": ("dce_rpc", "info", "zeek_dce_rpc", {"file_path": _z("dce_rpc", "endpoint"), "_second": _z("dce_rpc", "operation")}),
    "dhcp": ("dhcp", "info", "zeek_dhcp", {"hostname": _z("dhcp", "hostname") + ["observer.hostname"]}),
    "dns": ("dns_query", "info", "zeek_dns", {
        "dns_query": ["dns.question.name"] + _z("dns", "query"), "domain": ["dns.question.name"] + _z("dns", "query"),
        "dns_query_type": ["dns.question.type", "zeek.dns.qtype_name"], "dns_rcode": ["dns.response_code", "zeek.dns.rcode_name"]}),
    "software": ("software", "info", "zeek_software", {"process_name": _z("software", "name"), "_second": _z("software", "version")}),
    "known_hosts": ("known_host", "info", "zeek_known_hosts", {}),
    "known_services": ("known_service", "info", "zeek_known_services", {"dst_port": ["destination.port"], "network_protocol": ["zeek.known_services.port_proto"]}),
    "sip": ("sip", "info", "zeek_sip", {"http_method": _z("sip", "method"), "url": _z("sip", "uri")}),
    "ftp": ("ftp", "info", "zeek_ftp", {"command_line": _z("ftp", "command"), "_second": _z("ftp", "reply_code"), "http_status_code": _z("ftp", "reply_code")}),
    "smtp": ("smtp", "info", "zeek_smtp", {"username": _z("smtp", "from"), "tags": _z("smtp", "to"), "file_path": _z("smtp", "subject")}),
    "socks": ("socks", "info", "zeek_socks", {}),
    "tunnel": ("tunnel", "info", "zeek_tunnel", {"network_protocol": _z("tunnel", "type")}),
    "pe": ("pe", "info", "zeek_pe", {"_second": _z("pe", "is_packed"), "tags": _z("pe", "compile_ts")}),
}
# Address paths that differ from SRC / DST.
SOURCE_PATHS = {"dhcp": ["source.ip"] + _z("dhcp", "client_addr"), "known_hosts": ["source.ip", "=zeek.known_hosts.host", "zeek.known_hosts.host"],
                "known_services": ["source.ip", "zeek.known_services.host"]}
TARGET_PATHS = {"dhcp": _z("dhcp", "assigned_ip")}
EVE_KINDS = ["alert", "eve_tls", "eve_dns", "eve_fileinfo", "eve_anomaly"]
NEVER_DROPPED = ["syslog", "dhcp"]


def _schema() -> T.StructType:
    """One struct over every path used; leaves are text, so numbers, booleans and lists arrive as written."""
    tree: dict = {}
    flat = set()
    lists = [SRC, DST, SENSOR_HOST, ["=@timestamp"], *SOURCE_PATHS.values(), *TARGET_PATHS.values()]
    for _, _, _, columns in PATHS.values():
        lists += list(columns.values())
    for path in [p for paths in lists for p in paths]:
        if path.startswith("="):
            flat.add(path[1:])
            continue
        node = tree
        for part in path.split("."):
            node = node.setdefault(part, {})

    def build(node: dict) -> T.DataType:
        return T.StructType([T.StructField(k, build(v)) for k, v in node.items()]) if node else T.StringType()

    top = build(tree)
    for name in sorted(flat):
        if name not in top.fieldNames():
            top.add(T.StructField(name, T.StringType()))
    return top


def _at(path: str) -> str:
    return f"d.`{path[1:]}`" if path.startswith("=") else f"d.{path}"


def _first(paths: list[str]) -> str:
    """First non-empty of the paths, as expression text (hundreds of small Column calls would slow planning down)."""
    return "coalesce(" + ", ".join(f"nullif(trim({_at(p)}), '')" for p in paths) + ")"


def _kinds(names: list[str]) -> str:
    return "kind in (" + ", ".join(f"'{n}'" for n in names) + ")"


def sensor_events(docs: DataFrame, ingested_at: Column | None = None) -> DataFrame:
    """Documents (kind, value) as events. Rows without a source address are dropped, except syslog and address leases."""
    now = ingested_at if ingested_at is not None else F.current_timestamp()
    kind = F.col("kind")
    known = parse_once(docs.filter(kind.isin(list(PATHS))), F.from_json("value", _schema()), "d")
    wanted: dict[str, dict[str, list[str]]] = {}
    for name, (_, _, _, columns) in PATHS.items():
        for column, paths in columns.items():
            wanted.setdefault(column, {})[name] = paths

    def by_kind(per: dict[str, list[str]]) -> str:
        """CASE over kinds; kinds that share paths share a branch."""
        groups: dict[tuple, list[str]] = {}
        for name, paths in per.items():
            groups.setdefault(tuple(paths), []).append(name)
        return "case " + " ".join(f"when {_kinds(names)} then {_first(list(paths))}" for paths, names in groups.items()) + " end"

    picked = {c: by_kind(per) for c, per in wanted.items()}
    picked["src_ip"] = by_kind({**{n: SRC for n in PATHS if n not in SOURCE_PATHS}, **SOURCE_PATHS})
    picked["dst_ip"] = by_kind({**{n: DST for n in PATHS if n not in TARGET_PATHS}, **TARGET_PATHS})
    rows = known.selectExpr("kind", "value", f"{_first(['=@timestamp'])} AS _t", f"{_first(SENSOR_HOST)} AS _sensor", *[f"{text} AS {n}" for n, text in picked.items()])

    def fixed(index: int) -> Column:
        groups: dict[str, list[str]] = {}
        for name, spec in PATHS.items():
            groups.setdefault(spec[index], []).append(name)
        return F.expr("case " + " ".join(f"when {_kinds(names)} then '{value}'" for value, names in groups.items()) + " end")

    second, is_kind = F.col("_second"), lambda *names: kind.isin(*names)
    slash = lambda c: F.when(second.isNotNull() & F.col(c).isNotNull(), F.concat(c, F.lit("/"), "_second"))
    packed = is_kind("pe") & second.isNotNull() & (F.lower(second) != "false")
    out = rows.withColumns({
        "event_id": event_key(kind, F.col("value")), "timestamp": F.coalesce(parse_time(F.col("_t")), now), "ingested_at": now,
        "event_type": fixed(0), "severity": F.when(packed, "high").otherwise(F.lower(F.coalesce("severity", fixed(1)))),
        "detection_source": F.coalesce("detection_source", fixed(2)),
        "source_type": F.when(kind == "syslog", "ipfire_syslog").when(is_kind(*EVE_KINDS), "suricata_eve").otherwise("zeek"),
        "hostname": F.coalesce(F.when(is_kind("syslog", "dhcp"), F.col("hostname")), F.when(kind != "syslog", F.col("_sensor")),
                               F.when(kind == "syslog", "ipfire").otherwise("malcolm")),
        "src_ip": F.coalesce("src_ip", F.when(kind == "dhcp", "0.0.0.0")),
        "tls_validation_status": F.when(F.col("tls_validation_status") == "true", "valid").when(F.col("tls_validation_status") == "false", "failed"),
        "dns_ttl": F.get_json_object("dns_answers", "$[0].ttl").try_cast("int"),
        "dns_answers": F.when(F.get_json_object("dns_answers", "$[0]").isNotNull(), F.col("dns_answers")),
        "network_protocol": F.when(kind == "tunnel", F.col("network_protocol")).otherwise(F.lower("network_protocol")),
        "username": F.when(kind == "kerberos", F.substring_index("username", "@", 1)).otherwise(F.col("username")),
        "file_path": F.when(kind == "dce_rpc", F.coalesce(slash("file_path"), "file_path", "_second")).otherwise(F.col("file_path")),
        "process_name": F.coalesce(slash("process_name"), "process_name"),
        "command_line": F.when(F.col("command_line").isNotNull(), F.concat("command_line", F.lit(" ("), F.coalesce("_second", F.lit("None")), F.lit(")"))),
        "tags": F.when(kind == "pe", F.concat(F.lit("compile_ts:"), "tags")).otherwise(F.col("tags")),
        "http_resp_mime_type": F.coalesce(F.get_json_object("http_resp_mime_type", "$[0]"), "http_resp_mime_type"),
        "raw_event": F.substring("value", 1, MAX_TEXT_BYTES),
    }).filter(F.col("src_ip").isNotNull() | kind.isin(NEVER_DROPPED))
    numbers = {f.name: f.dataType for f in EVENT_SCHEMA.fields if not isinstance(f.dataType, (T.StringType, T.TimestampType))}
    present = [c for c in numbers if c in out.columns]
    return conform(out.withColumns({c: F.col(c).try_cast(numbers[c]) for c in present}))


register_source("sensor", sensor_events)
