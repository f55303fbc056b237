"""Source parsers run on raw text that Spark writes from the event table; the oracle states what must come back."""
from __future__ import annotations

from pyspark.sql import functions as F

from tidewatch.plans import derived as D
from tidewatch.plans.model import events, query, raw_events, table, with_ne
from tidewatch.sources import feeds as X, logs as L, records as R, sensor as Z
from tidewatch.sources.sinks import scratch_folder

def iso():
    return F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")



def as_json(df, *columns, **renamed):
    cells = [F.col(c) for c in columns] + [c.alias(n) for n, c in renamed.items()]
    return df.select("event_id", F.to_json(F.struct(*cells)).alias("value"))


# ---- generic records ---------------------------------------------------------------------------------

def json_lines(spark, sf):
    good = as_json(events(spark, sf), **{"@timestamp": iso(), "Host": F.col("hostname"), "user.name": F.col("username"), "Image": F.col("process_name"), "PID": F.col("process_id"),
                                         "cmd": F.col("command_line"), "dest_ip": F.col("dst_ip"), "DestinationPort": F.col("dst_port"), "hashes": F.col("file_hash_sha256"),
                                         "action": F.col("event_type"), "level": F.upper("severity"), "tags": F.split("tags", ",")}).select("value")
    bad = events(spark, sf).filter("process_id % 9 = 0").select(F.concat(F.lit('{"broken": '), "event_id").alias("value"))
    return good.union(bad)


RECORD_SQL = with_ne("""SELECT timestamp, hostname, username, process_name, process_id, command_line, dst_ip, dst_port,
  CASE WHEN file_hash_sha256 IS NOT NULL THEN split_part(file_hash_sha256, 'SHA256=', 2) END AS file_hash_sha256, event_type, severity, tags FROM ne""")
RECORD_COLUMNS = ["timestamp", "hostname", "username", "process_name", "process_id", "command_line", "dst_ip", "dst_port", "file_hash_sha256", "event_type", "severity", "tags"]


@query("src1_json_lines", RECORD_SQL)
def src1(spark, sf):
    folder = scratch_folder(spark) + "/ndjson"
    json_lines(spark, sf).write.text(folder)
    return R.records_to_events(R.read_json_lines(spark, folder), "json").select(*RECORD_COLUMNS)


@query("src1_json_arrays", with_ne("SELECT hostname, dst_ip, event_type FROM ne"))
def src1b(spark, sf):
    folder = scratch_folder(spark) + "/arrays"
    rows = as_json(events(spark, sf), "hostname", "dst_ip", "event_type").withColumn("file", F.floor(F.col("event_id").cast("bigint") / 100))  # about a hundred records per array
    rows.groupBy("file").agg(F.concat(F.lit("["), F.array_join(F.collect_list("value"), ","), F.lit("]")).alias("value")).select("value").repartition(20).write.text(folder)
    listed = spark.read.text(folder)  # several arrays per part file, so they are read by line here
    rows = listed.select(F.explode(F.from_json("value", "array<map<string,string>>")).alias("fields")).select("fields", F.to_json("fields").alias("raw"), F.lit("arrays").alias("source_file"))
    return R.records_to_events(rows, "json").select("hostname", "dst_ip", "event_type")


@query("src2_csv", with_ne("SELECT timestamp, hostname, process_name, process_id, dst_port, event_type FROM ne"))
def src2(spark, sf):
    folder = scratch_folder(spark) + "/csv"
    events(spark, sf).select(iso().alias("EventTime"), F.col("hostname").alias("ComputerName"), F.col("process_name").alias("NewProcessName"), F.col("process_id").alias("NewProcessId"),
                             F.col("dst_port").alias("destination_port"), F.col("event_type").alias("Category")).write.option("header", True).csv(folder)
    return R.records_to_events(R.read_csv_records(spark, folder), "csv").select("timestamp", "hostname", "process_name", "process_id", "dst_port", "event_type")


# ---- IDS lines -----------------------------------------------------------------------------------------

def eve_lines(spark, sf):
    e = events(spark, sf)
    k = F.col("process_id") - 1000
    kind = F.when(k % 6 == 0, "alert").when(k % 6 == 1, "flow").when(k % 6 == 2, "dns").when(k % 6 == 3, "http").when(k % 6 == 4, "tls").otherwise("stats")
    alert = F.struct((k % 5 + 1).alias("severity"), F.lit("sig").alias("signature"), k.alias("signature_id"), F.lit("cat").alias("category"),
                     F.when(k % 4 == 0, "blocked").otherwise("allowed").alias("action"), F.struct(F.array("attack_technique").alias("mitre_attack_id")).alias("metadata"))
    return as_json(e, "src_ip", "src_port", timestamp=F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+0000'"), event_type=kind, dest_ip=F.col("dst_ip"), dest_port=F.col("dst_port"),
                   proto=F.upper("network_protocol"), host=F.col("hostname"), flow_id=F.col("event_id"), alert=F.when(kind == "alert", alert),
                   dns=F.when(kind == "dns", F.struct(F.col("dns_query").alias("rrname"), F.lit("A").alias("rrtype"))),
                   http=F.when(kind == "http", F.struct(F.col("domain").alias("hostname"), F.col("url").alias("url"), F.lit("GET").alias("http_method"))),
                   flow=F.when(kind == "flow", F.struct(F.when(k % 12 == 1, "closed").otherwise("new").alias("state")))).select("value")


@query("src3_ids_lines", with_ne("""
SELECT timestamp, src_ip, src_port, dst_ip, dst_port, hostname, upper(network_protocol) AS network_protocol,
  CASE k % 6 WHEN 0 THEN 'detection' WHEN 2 THEN 'dns_query' WHEN 5 THEN 'stats' ELSE 'network_connect' END AS event_type,
  CASE WHEN k % 6 = 0 THEN CASE k % 5 WHEN 0 THEN 'critical' WHEN 1 THEN 'high' WHEN 2 THEN 'medium' WHEN 3 THEN 'low' ELSE 'low' END ELSE 'info' END AS severity,
  CASE WHEN k % 6 = 0 THEN CASE WHEN k % 4 = 0 THEN 'failure' ELSE 'success' END WHEN k % 12 = 1 THEN 'success' END AS event_outcome,
  CASE WHEN k % 6 = 0 THEN attack_technique END AS attack_technique, CASE k % 6 WHEN 2 THEN dns_query WHEN 3 THEN domain END AS domain,
  concat_ws(',', CASE k % 6 WHEN 0 THEN concat('sid:', k, ',category:cat') WHEN 2 THEN 'dns_type:A' WHEN 3 THEN 'method:GET' END, 'flow_id:' || event_id) AS tags FROM ne"""))
def src3(spark, sf):
    return L.eve_events(eve_lines(spark, sf)).select("timestamp", "src_ip", "src_port", "dst_ip", "dst_port", "hostname", "network_protocol", "event_type", "severity",
                                                     "event_outcome", "attack_technique", "domain", "tags")


def syslog_lines(spark, sf):
    e = events(spark, sf)
    k = F.col("process_id") - 1000
    prefix = F.when(k % 3 == 0, "FORWARDFW").when(k % 3 == 1, "DROP_CTINVALID").otherwise("REJECT_INPUT")
    iface = F.when(k % 2 == 0, "green0").otherwise("tun1")
    line = F.concat(F.date_format("timestamp", "MMM d HH:mm:ss"), F.lit(" fw1 kernel: "), prefix, F.lit(" IN="), iface, F.lit(" OUT="), F.when(k % 5 == 0, "").otherwise("red0"),
                    F.lit(" SRC="), "src_ip", F.lit(" DST="), "dst_ip", F.lit(" PROTO=TCP"), F.when(F.col("dst_port").isNotNull(), F.concat(F.lit(" SPT=99 DPT="), F.col("dst_port").cast("string"))).otherwise(""))
    noise = e.filter("process_id % 4 = 0").select(F.concat(F.lit("Jan  1 00:00:00 fw1 dhcpd: lease "), "event_id").alias("value"))
    return e.select(line.alias("value")).union(noise)


@query("src4_firewall_syslog", with_ne("""
SELECT date_trunc('second', timestamp) AS timestamp, src_ip, dst_ip, dst_port, CASE WHEN dst_port IS NOT NULL THEN 99 END AS src_port,
  CASE k % 3 WHEN 0 THEN 'FORWARDFW' WHEN 1 THEN 'DROP_CTINVALID' ELSE 'REJECT_INPUT' END AS detection_source, CASE WHEN k % 3 = 0 THEN 'info' ELSE 'medium' END AS severity,
  CASE WHEN k % 3 = 0 THEN 'success' ELSE 'failure' END AS event_outcome,
  concat_ws(',', CASE WHEN k % 2 = 0 THEN 'in:green0' ELSE 'in:tun1' END, CASE WHEN k % 5 <> 0 THEN 'out:red0' END, CASE WHEN k % 2 = 0 THEN 'zone:green' END, CASE WHEN k % 5 <> 0 THEN 'zone:red' END) AS tags FROM ne"""))
def src4(spark, sf):
    out = L.firewall_events(syslog_lines(spark, sf), as_of=F.lit("2024-02-01").cast("timestamp"))
    return out.select("timestamp", "src_ip", "dst_ip", "dst_port", "src_port", "detection_source", "severity", "event_outcome", "tags")


@query("src5_host_agent", with_ne("""
SELECT date_trunc('second', timestamp) AS timestamp, process_name, CASE WHEN k % 2 = 0 THEN 'root' ELSE username END AS username, process_id, dst_ip,
  CASE k % 4 WHEN 0 THEN 'process_create' WHEN 1 THEN 'network_connect' WHEN 2 THEN 'file_create' ELSE 'logon_event' END AS event_type, n AS copy
FROM ne, (VALUES (0), (1)) t(n) WHERE n = 0 OR k % 3 = 0"""))
def src5(spark, sf):
    e = events(spark, sf)
    k = F.col("process_id") - 1000
    name = F.when(k % 4 == 0, "running_processes").when(k % 4 == 1, "listen_ports").when(k % 4 == 2, "etc_paths").otherwise("logins")

    def row(n):
        return F.struct(F.lit(n).cast("string").alias("copy"), F.col("process_name").alias("name"), F.col("process_id").cast("string").alias("pid"), F.col("dst_ip").alias("remote_address"),
                        F.when(k % 2 == 0, "root").otherwise("1001").alias("uid"), F.when(k % 2 == 1, F.col("username")).alias("username"))
    lines = as_json(e, name=name, unixTime=F.unix_timestamp("timestamp"), snapshot=F.when(k % 3 == 0, F.array(row(0), row(1))), columns=F.when(k % 3 == 1, row(0)),
                    data=F.when(k % 3 == 2, F.array(row(0))))
    out = L.osquery_events(lines)
    return out.select("timestamp", "process_name", "username", "process_id", "dst_ip", "event_type", F.get_json_object("raw_event", "$.columns.copy").cast("int").alias("copy"))


@query("src6_windows_export", with_ne("""
SELECT 'evtx:' || hostname || ':' || event_id AS event_id, timestamp, hostname, username, process_name, process_id, command_line, dst_port, CASE WHEN k % 8 = 0 THEN 'bb' || k END AS file_hash_sha256,
  CASE k % 4 WHEN 0 THEN 'process_create' WHEN 1 THEN 'network_connect' WHEN 2 THEN 'logon_failure' ELSE NULL END AS event_type FROM ne"""))
def src6(spark, sf):
    e = events(spark, sf)
    k = F.col("process_id") - 1000
    number = F.when(k % 4 == 0, 1).when(k % 4 == 1, 3).when(k % 4 == 2, 4625).otherwise(9999)
    channel = F.when(k % 4 < 2, "Microsoft-Windows-Sysmon/Operational").otherwise("Security")

    def item(n, c):
        return F.struct(F.lit(n).alias("@Name"), F.col(c).cast("string").alias("#text"))
    listed = F.struct(F.array(item("User", "username"), item("Image", "process_name"), item("ProcessId", "process_id"), item("CommandLine", "command_line"),
                              item("DestinationPort", "dst_port"), item("Hashes", "file_hash_sha256")).alias("Data"))
    flat = F.struct(F.col("username").alias("User"), F.col("process_name").alias("Image"), F.col("process_id").cast("string").alias("ProcessId"), F.col("command_line").alias("CommandLine"),
                    F.col("dst_port").cast("string").alias("DestinationPort"), F.col("file_hash_sha256").alias("Hashes"))
    system = F.struct(F.struct(iso().alias("@SystemTime")).alias("TimeCreated"), F.struct(number.cast("string").alias("#text")).alias("EventID"), channel.alias("Channel"),
                      F.col("hostname").alias("Computer"))
    data = F.when(k % 2 == 0, F.to_json(F.struct(F.struct(system.alias("System"), listed.alias("EventData")).alias("Event")))) \
            .otherwise(F.to_json(F.struct(system.alias("System"), flat.alias("EventData"))))
    lines = as_json(e, event_record_id=F.col("event_id").cast("bigint"), data=data)
    return L.windows_export_events(lines).select("event_id", "timestamp", "hostname", "username", "process_name", "process_id", "command_line", "dst_port", "file_hash_sha256", "event_type")


@query("src7_windows_live", with_ne("""
SELECT date_trunc('millisecond', timestamp) AS timestamp, hostname, CASE WHEN k % 3 = 0 THEN 'S-1-5-21' ELSE username END AS username, process_name, process_id, command_line, dst_ip,
  CASE k % 5 WHEN 0 THEN 'process_create' WHEN 1 THEN 'logon' WHEN 2 THEN 'powershell_script_block' WHEN 3 THEN 'wmi_activity' ELSE 'scheduled_task_started' END AS event_type FROM ne"""))
def src7(spark, sf):
    e = events(spark, sf)
    k = F.col("process_id") - 1000
    number = F.when(k % 5 == 0, 1).when(k % 5 == 1, 4624).when(k % 5 == 2, 4104).when(k % 5 == 3, 5857).otherwise(200)
    channel = F.when(k % 5 == 0, "Microsoft-Windows-Sysmon/Operational").when(k % 5 == 1, "Security").when(k % 5 == 2, "Microsoft-Windows-PowerShell/Operational") \
               .when(k % 5 == 3, "Microsoft-Windows-WMI-Activity/Operational").otherwise("Microsoft-Windows-TaskScheduler/Operational")

    def field(n, c):
        return F.concat(F.lit(n + ": "), F.col(c).cast("string"))
    message = F.concat_ws("\r\n", F.lit("Event happened:"), F.when(k % 3 != 0, field("User", "username")), field("Image", "process_name"), field("ProcessId", "process_id"),
                          field("CommandLine", "command_line"), field("DestinationIp", "dst_ip"))
    lines = e.select(channel.alias("channel"), F.to_json(F.struct(
        number.alias("Id"), F.concat(F.lit("/Date("), F.unix_millis("timestamp").cast("string"), F.lit(")/")).alias("TimeCreated"), F.col("hostname").alias("MachineName"),
        F.struct(F.lit("S-1-5-21").alias("Value")).alias("UserId"), message.alias("Message"))).alias("value"))
    return L.windows_live_events(lines).select("timestamp", "hostname", "username", "process_name", "process_id", "command_line", "dst_ip", "event_type")


# ---- sensor documents -------------------------------------------------------------------------------------

KINDS = list(Z.PATHS)


def sensor_docs(spark, sf):
    """Every event as one document of a kind chosen by its number; odd events use flat dotted keys for protocol fields."""
    e = events(spark, sf)
    n = F.col("event_id").cast("bigint")
    kind = F.element_at(F.array(*[F.lit(x) for x in KINDS]), (n % len(KINDS) + 1).cast("int"))
    src = F.when(n % 13 != 0, F.col("src_ip"))
    text = F.col("process_name")

    def s(**cells):
        return F.struct(*[c.alias(k) for k, c in cells.items()])
    k = F.col("process_id") - 1000
    zeek = s(conn=s(state=F.lit("SF")), weird=s(name=text), http=s(referrer=F.lit("ref"), resp_mime_types=F.array(F.lit("image/gif"), F.lit("x"))), ssl=s(server_name=F.col("domain")),
             x509=s(subject=text), files=s(md5=F.lit("m5"), filename=F.col("file_path")), notice=s(note=text, msg=F.lit("m")), kerberos=s(client=F.concat("username", F.lit("@REALM")), service=F.lit("cifs")),
             ntlm=s(username=F.col("username"), domain=F.lit("CORP")), ssh=s(auth_success=k % 2 == 0, version=F.lit(2)), smb_mapping=s(path=F.col("file_path")), smb_files=s(action=F.lit("OPEN"), name=F.col("file_path")),
             rdp=s(cookie=F.col("username"), security_protocol=F.lit("TLS")), dce_rpc=s(endpoint=F.lit("svcctl"), operation=F.when(k % 2 == 0, "Open")), dhcp=s(assigned_ip=F.col("dst_ip"), hostname=F.col("hostname")),
             software=s(name=text, version=F.when(k % 2 == 0, "1.0")), known_services=s(port_proto=F.lit("TCP")), sip=s(method=F.lit("INVITE"), uri=F.col("url")), ftp=s(command=F.lit("RETR"), reply_code=F.lit(226)),
             smtp=s(**{"from": F.col("username"), "to": F.array("hostname"), "subject": F.col("command_line")}), tunnel=s(type=F.lit("Teredo")), pe=s(is_packed=k % 2 == 0, compile_ts=F.lit("c1")))
    nested = n % 2 == 0
    body = s(**{
        "doc_id": F.col("event_id"), "doc_kind": kind, "@timestamp": iso(), "source": F.when(nested, s(ip=src, port=F.col("src_port"), bytes=k)), "destination": F.when(nested, s(ip=F.col("dst_ip"), port=F.col("dst_port"), domain=F.col("domain"), bytes=k * 2)),
        "src_ip": F.when(~nested, src), "dst_ip": F.when(~nested, F.col("dst_ip")), "observer": s(hostname=F.col("hostname")), "host": s(name=F.lit("h1")), "network": s(transport=F.lit("TCP"), duration=k * 1.5),
        "event": s(severity=F.when(k % 3 == 0, "High"), action=F.lit("act")), "rule": s(name=text), "zeek": F.when(nested, zeek), "zeek.weird.name": F.when(~nested, text), "zeek.conn.state": F.when(~nested, F.lit("S0")),
        "zeek.kerberos.client": F.when(~nested, F.col("username")), "tls": s(version=F.lit("1.3"), sni=F.col("domain"), established=k % 2 == 0, ja3=s(hash=F.lit("j3"))),
        "dns": s(question=s(name=F.col("dns_query"), type=F.lit("A")), response_code=F.lit("NOERROR"), answers=F.array(s(data=F.lit("1.2.3.4"), ttl=k))),
        "file": s(hash=s(md5=F.lit("m1"), sha256=F.lit("s1")), type=F.lit("text/x"), size=k, name=F.col("file_path")), "http": s(request=s(method=F.lit("GET")), response=s(status_code=F.lit(200), body=s(bytes=k)))})
    return e.select(kind.alias("kind"), F.explode(F.array(F.to_json(body))).alias("value"))  # a generator: written once per row


KIND_CASE = "CASE CAST(event_id AS BIGINT) % " + str(len(KINDS)) + " " + " ".join(f"WHEN {i} THEN '{x}'" for i, x in enumerate(KINDS)) + " END"
TYPE_CASE = "CASE kind " + " ".join(f"WHEN '{n}' THEN '{spec[0]}'" for n, spec in Z.PATHS.items()) + " END"
SENSOR = f"""doc AS (SELECT *, CAST(event_id AS BIGINT) % 2 = 0 AS nested, CAST(event_id AS BIGINT) % 13 <> 0 AS has_src, {KIND_CASE} AS kind FROM ne)"""
# What each kind's own columns must contain, joined with '|'; flat documents carry only the flat keys.
DETAIL_SQL = """CASE kind
  WHEN 'alert' THEN coalesce(process_name, 'malcolm_alert') WHEN 'eve_tls' THEN concat_ws('|', '1.3', 'j3', coalesce(domain, 'h1'), CASE WHEN k % 2 = 0 THEN 'valid' ELSE 'failed' END)
  WHEN 'eve_dns' THEN concat_ws('|', dns_query, 'A', 'NOERROR', k) WHEN 'eve_fileinfo' THEN concat_ws('|', 'm1', 's1', 'text/x', k) WHEN 'eve_anomaly' THEN 'act'
  WHEN 'conn' THEN CASE WHEN nested THEN concat_ws('|', 'SF', k, k * 2, 'tcp') ELSE 'S0|tcp' END WHEN 'weird' THEN coalesce(process_name, '')
  WHEN 'http' THEN CASE WHEN nested THEN concat_ws('|', 'GET', domain, 'ref', 'image/gif', k) ELSE concat_ws('|', 'GET', k) END
  WHEN 'tls' THEN CASE WHEN nested THEN concat_ws('|', '1.3', domain) ELSE '1.3' END WHEN 'x509' THEN CASE WHEN nested THEN coalesce(process_name, '') ELSE '' END
  WHEN 'fileinfo' THEN concat_ws('|', 'm1', 's1', k, file_path) WHEN 'notice' THEN CASE WHEN nested THEN concat_ws('|', process_name, 'm') ELSE '' END
  WHEN 'kerberos' THEN CASE WHEN nested THEN concat_ws('|', username, username || '@REALM', 'cifs') ELSE concat_ws('|', username, username) END
  WHEN 'ntlm' THEN CASE WHEN nested THEN concat_ws('|', username, username, 'CORP') ELSE '' END WHEN 'ssh' THEN CASE WHEN nested THEN concat_ws('|', k % 2 = 0, 2) ELSE '' END
  WHEN 'smb_mapping' THEN CASE WHEN nested THEN coalesce(file_path, '') ELSE '' END WHEN 'smb_files' THEN CASE WHEN nested THEN concat_ws('|', 'OPEN', file_path) ELSE '' END
  WHEN 'rdp' THEN CASE WHEN nested THEN concat_ws('|', username, 'TLS') ELSE '' END WHEN 'dce_rpc' THEN CASE WHEN nested THEN CASE WHEN k % 2 = 0 THEN 'svcctl/Open' ELSE 'svcctl' END ELSE '' END
  WHEN 'dhcp' THEN coalesce(CASE WHEN nested THEN dst_ip END, '') WHEN 'dns' THEN concat_ws('|', dns_query, 'A', 'NOERROR', dns_query)
  WHEN 'software' THEN CASE WHEN nested THEN coalesce(process_name || CASE WHEN k % 2 = 0 THEN '/1.0' ELSE '' END, '') ELSE '' END
  WHEN 'known_services' THEN CASE WHEN nested THEN 'tcp' ELSE '' END WHEN 'sip' THEN CASE WHEN nested THEN concat_ws('|', 'INVITE', url) ELSE '' END
  WHEN 'ftp' THEN CASE WHEN nested THEN 'RETR (226)|226' ELSE '' END WHEN 'smtp' THEN CASE WHEN nested THEN concat_ws('|', username, '["' || hostname || '"]', command_line) ELSE '' END
  WHEN 'tunnel' THEN CASE WHEN nested THEN 'Teredo' ELSE '' END WHEN 'pe' THEN CASE WHEN nested THEN 'compile_ts:c1' ELSE '' END ELSE '' END"""


def detail():
    c = {
        "alert": ["detection_source"], "eve_tls": ["tls_version", "tls_ja3", "tls_sni", "tls_validation_status"], "eve_dns": ["dns_query", "dns_query_type", "dns_rcode", "dns_ttl"],
        "eve_fileinfo": ["file_md5", "file_sha256_eve", "file_mime_type", "file_size_bytes"], "eve_anomaly": ["detection_source"], "conn": ["conn_state", "conn_orig_bytes", "conn_resp_bytes", "network_protocol"],
        "weird": ["zeek_weird_name"], "http": ["http_method", "domain", "http_referrer", "http_resp_mime_type", "http_response_body_len"], "tls": ["tls_version", "tls_sni"], "x509": ["tls_cert_subject"],
        "fileinfo": ["file_md5", "file_sha256_eve", "file_size_bytes", "file_path"], "notice": ["zeek_notice_note", "zeek_notice_msg"], "kerberos": ["username", "kerberos_client", "kerberos_service"],
        "ntlm": ["username", "ntlm_username", "ntlm_domain"], "ssh": ["ssh_auth_success", "ssh_version"], "smb_mapping": ["smb_path"], "smb_files": ["smb_action", "smb_path"],
        "rdp": ["rdp_cookie", "rdp_security_protocol"], "dce_rpc": ["file_path"], "dhcp": ["dst_ip"], "dns": ["dns_query", "dns_query_type", "dns_rcode", "domain"], "software": ["process_name"],
        "known_services": ["network_protocol"], "sip": ["http_method", "url"], "ftp": ["command_line", "http_status_code"], "smtp": ["username", "tags", "file_path"], "tunnel": ["network_protocol"], "pe": ["tags"]}
    out = F.lit("")
    for kind, columns in c.items():
        out = F.when(F.col("kind") == kind, F.concat_ws("|", *[F.col(x).cast("string") for x in columns])).otherwise(out)
    return out


def parsed_docs(spark, sf):
    out = Z.sensor_events(sensor_docs(spark, sf))
    return out.withColumns({"doc": F.get_json_object("raw_event", "$.doc_id"), "kind": F.get_json_object("raw_event", "$.doc_kind")})


def _sensor_query(name, kinds):
    listed = "(" + ", ".join(f"'{k}'" for k in kinds) + ")"

    @query(name, with_ne(f"""SELECT event_id AS doc, kind, timestamp, {TYPE_CASE} AS event_type, CASE WHEN kind = 'dhcp' AND nested THEN hostname WHEN kind = 'syslog' THEN 'h1' ELSE hostname END AS hostname,
      CASE WHEN kind = 'dhcp' THEN CASE WHEN nested AND has_src THEN src_ip ELSE '0.0.0.0' END WHEN kind IN ('known_hosts', 'known_services') THEN CASE WHEN nested AND has_src THEN src_ip END
           WHEN has_src THEN src_ip END AS src_ip,
      CASE WHEN kind IN ('alert', 'eve_anomaly') THEN CASE WHEN k % 3 = 0 THEN 'high' WHEN kind = 'alert' THEN 'info' ELSE 'high' END WHEN kind IN ('weird', 'notice') THEN 'high'
           WHEN kind = 'pe' AND nested AND k % 2 = 0 THEN 'high' ELSE 'info' END AS severity, {DETAIL_SQL} AS detail
      FROM doc WHERE kind IN {listed} AND (kind IN ('syslog', 'dhcp') OR (has_src AND (nested OR kind NOT IN ('known_hosts', 'known_services'))))""", SENSOR))
    def run(spark, sf):
        return parsed_docs(spark, sf).filter(F.col("kind").isin(kinds)).select("doc", "kind", "timestamp", "event_type", "hostname", "src_ip", "severity", detail().alias("detail"))


_sensor_query("src8_ids_documents", KINDS[:6])
_sensor_query("src9_protocol_documents", KINDS[6:])


@query("src10_dataset_rows", with_ne("""SELECT timestamp, src_ip AS hostname, username, process_name, event_type, dst_ip,
  CASE WHEN value_level = 'CRIT' THEN 'critical' WHEN value_level = 'warn' THEN 'medium' WHEN value_level = 'high' THEN 'high' ELSE 'low' END AS severity FROM (SELECT *, severity_raw AS value_level FROM ne)"""))
def src10(spark, sf):
    rows = raw_events(spark, sf).select(iso().alias("Timestamp"), F.col("src_ip").alias("Source IP"), F.col("dst_ip").alias("Destination IP"), F.col("username").alias("User"),
                                        F.col("process_name").alias("Process"), F.col("event_type").alias("Event Type"), F.col("severity").alias("Severity"))
    return R.dataset_rows_to_events(rows).select("timestamp", "hostname", "username", "process_name", "event_type", "dst_ip", "severity")


@query("src11_relay_documents", with_ne("""SELECT event_id, hostname, CASE WHEN has_src THEN src_ip END AS src_ip, dst_ip, CASE WHEN nested THEN src_port END AS src_port,
  CASE WHEN k % 3 = 0 THEN 'high' ELSE 'info' END AS severity FROM doc""", SENSOR))
def src11(spark, sf):
    out = L.relay_documents(sensor_docs(spark, sf))
    return out.select(F.get_json_object("raw_event", "$.doc_id").alias("event_id"), "hostname", "src_ip", "dst_ip", "src_port", "severity")


# ---- feeds ------------------------------------------------------------------------------------------------

@query("src12_feodo", "SELECT 'ip-' || s_suppkey AS ioc_value, 'fam' || s_nationkey AS malware_family, 50 AS confidence FROM supplier")
def src12(spark, sf):
    rows = table(spark, sf, "supplier").selectExpr("""concat('"2024-01-01 00:00:00","ip-', s_suppkey, '","443","online","2024-01-02","fam', s_nationkey, '"') AS value""")
    head = table(spark, sf, "supplier").selectExpr("concat('# first_seen_utc,dst_ip,', s_suppkey) AS value")
    return X.feodo_iocs(rows.union(head)).select("ioc_value", "malware_family", "confidence")


@query("src12_kev", "SELECT 'CVE-' || s_suppkey || '-' || n AS ioc_value, s_name AS actor_tag, 40 AS confidence FROM supplier, range(2) t(n)")
def src12b(spark, sf):
    doc = table(spark, sf, "supplier").selectExpr("""to_json(named_struct('vulnerabilities', transform(sequence(0, 2), i -> named_struct(
        'cveID', case when i < 2 then concat('CVE-', s_suppkey, '-', i) else ' ' end, 'dateAdded', '2024-01-01', 'vulnerabilityName', s_name)))) AS value""")
    return X.kev_iocs(doc).select("ioc_value", "actor_tag", "confidence")


@query("src12_threatfox", "SELECT CASE WHEN s_suppkey % 2 = 0 THEN '9.9.9.' || s_suppkey || ':80' ELSE 'd' || s_suppkey || '.com' END AS ioc_value, CASE WHEN s_suppkey % 2 = 0 THEN '9.9.9.' || s_suppkey END AS bare_ip, 'a,b' AS actor_tag FROM supplier")
def src12c(spark, sf):
    rows = table(spark, sf, "supplier").selectExpr("""concat('"2024-01-01", "', s_suppkey, '", "', case when s_suppkey % 2 = 0 then concat('9.9.9.', s_suppkey, ':80') else concat('d', s_suppkey, '.com') end,
        '", "ip:port", "mal", "75", "a,b"') AS value""")
    short = table(spark, sf, "supplier").selectExpr("concat('x,', s_suppkey) AS value")
    return X.threatfox_iocs(rows.union(short)).select("ioc_value", "bare_ip", "actor_tag")


@query("src12_misp", """SELECT 'v' || s_suppkey AS ioc_value, CASE s_suppkey % 4 WHEN 0 THEN 'ip' WHEN 1 THEN 'domain' WHEN 2 THEN 'sha256' END AS ioc_type,
  CASE s_suppkey % 5 WHEN 1 THEN 90 WHEN 2 THEN 70 WHEN 3 THEN 50 WHEN 4 THEN 30 ELSE 50 END AS confidence, CASE WHEN s_suppkey % 2 = 0 THEN 'APT' || s_nationkey END AS actor_tag FROM supplier WHERE s_suppkey % 4 <> 3""")
def src12d(spark, sf):
    rows = table(spark, sf, "supplier").selectExpr(
        "concat('v', s_suppkey) AS value", "case s_suppkey % 4 when 0 then 'ip-dst' when 1 then 'hostname' when 2 then 'sha256' else 'yara' end AS type", "cast(s_suppkey % 5 as int) AS threat_level",
        "s_name AS info", """case when s_suppkey % 2 = 0 then array('tlp:red', concat('misp-galaxy:threat-actor="APT', s_nationkey, '"')) else array('tlp:red') end AS tags""")
    return X.misp_iocs(rows).select("ioc_value", "ioc_type", "confidence", "actor_tag")


@query("src13_easyprivacy", "SELECT lower('T' || s_suppkey || '.example.com') AS domain FROM supplier WHERE s_suppkey % 3 = 0")
def src13(spark, sf):
    rows = table(spark, sf, "supplier").selectExpr("case s_suppkey % 3 when 0 then concat('||T', s_suppkey, '.example.com^$third-party') when 1 then concat('! note ', s_suppkey) else concat('/path', s_suppkey) end AS value")
    return X.easyprivacy_domains(rows).select("domain")


@query("src13_disconnect", "SELECT 'd' || s_suppkey || '.net' AS domain, 'Email' AS category FROM supplier UNION ALL SELECT 'e' || s_suppkey || '.net', 'Social' FROM supplier")
def src13b(spark, sf):
    text = """concat('{"license":"x","categories":{"Email":[{"Co":{"http://c/":["D', s_suppkey, '.net"],"dnt":"eff"}}],"Social":[{"So":{"http://s/":["e', s_suppkey, '.net"]}}]}}') AS value"""
    return X.disconnect_domains(table(spark, sf, "supplier").selectExpr(text))


@query("src13_ipsum", "SELECT '7.7.7.' || s_suppkey AS ip, CAST(s_suppkey % 9 AS INT) AS tier FROM supplier WHERE s_suppkey % 2 = 0")
def src13c(spark, sf):
    rows = table(spark, sf, "supplier").selectExpr("case when s_suppkey % 2 = 0 then concat('7.7.7.', s_suppkey, chr(9), s_suppkey % 9) when s_suppkey % 4 = 1 then '# c' else concat('7.7.7.', s_suppkey) end AS value")
    return X.ipsum_addresses(rows)


@query("src13_tor", "SELECT '6.6.6.' || s_suppkey AS ip FROM supplier")
def src13d(spark, sf):
    rows = table(spark, sf, "supplier").selectExpr("concat('6.6.6.', s_suppkey) AS value")
    return X.tor_exits(rows.union(rows))


def stix_lines(spark, sf):
    """Parts are techniques, suppliers groups, order lines the relationships between them."""
    ref = "array(named_struct('source_name', 'mitre-attack', 'external_id', {0}))"
    t = table(spark, sf, "part").selectExpr(f"""to_json(named_struct('id', concat('ap-', p_partkey), 'type', 'attack-pattern', 'name', p_name, 'revoked', p_partkey % 10 = 0, 'x_mitre_is_subtechnique', p_partkey % 7 = 0,
        'description', concat(repeat(concat(p_name, ' '), 8), '(Citation: X)  end'), 'x_mitre_platforms', array('Windows'), 'kill_chain_phases', array(named_struct('phase_name', p_type)),
        'external_references', {ref.format("concat('T', 1000 + p_partkey)")})) AS value""")
    g = table(spark, sf, "supplier").selectExpr(f"""to_json(named_struct('id', concat('is-', s_suppkey), 'type', 'intrusion-set', 'name', s_name, 'revoked', s_suppkey % 9 = 0, 'aliases', array(s_name),
        'external_references', {ref.format("concat('G', s_suppkey)")})) AS value""")
    r = table(spark, sf, "lineitem").selectExpr("""to_json(named_struct('id', concat('rel-', lpad(cast(l_orderkey as string), 9, '0'), '-', l_linenumber, '-', l_partkey, '-', l_suppkey), 'type', 'relationship', 'relationship_type', case when l_linenumber % 4 = 0 then 'mitigates' else 'uses' end,
        'revoked', l_linenumber = 1, 'source_ref', concat('is-', l_suppkey), 'target_ref', concat('ap-', l_partkey), 'description', concat('Seen (Citation: Y) ', l_returnflag))) AS value""")
    return t.unionByName(g).unionByName(r)


@query("src14_techniques", "SELECT 'T' || (1000 + p_partkey) AS tech_id, p_name AS name, p_type AS tactic FROM part WHERE p_partkey % 10 <> 0 AND p_partkey % 7 <> 0")
def src14(spark, sf):
    return X.stix_techniques(X.stix_objects(stix_lines(spark, sf))).drop("stix_id")


@query("src14_groups", "SELECT 'is-' || s_suppkey AS stix_id, 'G' || s_suppkey AS group_id, s_name AS name FROM supplier WHERE s_suppkey % 9 <> 0")
def src14b(spark, sf):
    return X.stix_groups(X.stix_objects(stix_lines(spark, sf))).drop("aliases")


@query("src14_group_techniques", """SELECT DISTINCT 'is-' || l_suppkey AS stix_id, 'T' || (1000 + l_partkey) AS tech_id FROM lineitem JOIN part ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey
WHERE l_linenumber <> 1 AND l_linenumber % 4 <> 0 AND p_partkey % 10 <> 0 AND p_partkey % 7 <> 0""")
def src14c(spark, sf):
    return X.stix_group_techniques(X.stix_objects(stix_lines(spark, sf)))


@query("src15_technique_documents", """
WITH rel AS (SELECT *, 'rel-' || lpad(CAST(l_orderkey AS VARCHAR), 9, '0') || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey AS id FROM lineitem),
seen AS (SELECT l_partkey, string_agg('- Seen ' || l_returnflag, chr(10) ORDER BY id) AS t FROM (SELECT * FROM rel WHERE l_linenumber % 4 <> 0 QUALIFY row_number() OVER (PARTITION BY l_partkey ORDER BY id) <= 5) GROUP BY 1),
fix AS (SELECT l_partkey, string_agg(s_name, '; ' ORDER BY id) AS t FROM rel JOIN supplier ON s_suppkey = l_suppkey WHERE l_linenumber % 4 = 0 GROUP BY 1)
SELECT 'T' || (1000 + p_partkey) AS tid, left('Technique: T' || (1000 + p_partkey) || ' — ' || p_name || chr(10) || 'Tactics: ' || p_type || chr(10) || 'Platforms: Windows' || chr(10) || chr(10) || 'Description:' || chr(10)
  || repeat(p_name || ' ', 8) || 'end' || coalesce(chr(10) || chr(10) || 'Mitigations: ' || fix.t, '') || coalesce(chr(10) || chr(10) || 'Observed in the wild:' || chr(10) || seen.t, ''), 2000) AS document
FROM part LEFT JOIN seen ON seen.l_partkey = p_partkey LEFT JOIN fix ON fix.l_partkey = p_partkey WHERE p_partkey % 10 <> 0 AND length(repeat(p_name || ' ', 8) || 'end') >= 50""")
def src15(spark, sf):
    return X.technique_documents(X.stix_objects(stix_lines(spark, sf))).select("tid", "document")


@query("src16_hayabusa", """SELECT 'hayabusa-R' || doc_id AS rule_id, CASE doc_id % 4 WHEN 0 THEN 'critical' WHEN 1 THEN 'medium' WHEN 2 THEN 'informational' ELSE 'medium' END AS severity,
  CASE WHEN doc_id % 2 = 0 THEN 'T1059.001' END AS attack_technique, CASE doc_id % 3 WHEN 0 THEN 'Execution' WHEN 1 THEN 'Other' END AS attack_tactic, '[Hayabusa] Rule ' || lang || ': Src=' || source AS explanation FROM documents""")
def src16(spark, sf):
    lines = table(spark, sf, "documents").selectExpr("""to_json(named_struct('Level', case doc_id % 4 when 0 then 'crit' when 1 then 'med' when 2 then 'info' else 'odd' end, 'RuleTitle', concat('Rule ', lang),
        'MitreTags', case when doc_id % 2 = 0 then array('G001', 'T1059.001') else array('S1') end, 'MitreTactics', case doc_id % 3 when 0 then array('Exec') when 1 then array('Other') end,
        'Details', map('Src', source, 'Empty', ''), 'RuleID', concat('R', doc_id))) AS value""")
    return X.hayabusa_detections(lines).select("rule_id", "severity", "attack_technique", "attack_tactic", "explanation")


@query("src16_chainsaw", """SELECT 'chainsaw-c' || doc_id AS rule_id, CASE doc_id % 3 WHEN 0 THEN 'high' WHEN 1 THEN 'informational' ELSE 'medium' END AS severity,
  CASE WHEN doc_id % 2 = 0 THEN 'T1003.001' END AS attack_technique, CASE WHEN doc_id % 2 = 0 THEN 'Credential Access' END AS attack_tactic, CAST(doc_id AS VARCHAR) AS matched_event FROM documents""")
def src16b(spark, sf):
    docs = table(spark, sf, "documents").selectExpr("""to_json(array(named_struct('level', case doc_id % 3 when 0 then 'high' when 1 then 'info' else 'weird' end, 'name', lang, 'id', concat('c', doc_id), 'status', 'stable',
        'tags', case when doc_id % 2 = 0 then array('attack.credential_access', 'attack.t1003.001') else array('car.2013') end,
        'document', named_struct('data', named_struct('Event', named_struct('System', named_struct('EventRecordID', doc_id))))))) AS value""")
    return X.chainsaw_detections(docs).select("rule_id", "severity", "attack_technique", "attack_tactic", "matched_event")
