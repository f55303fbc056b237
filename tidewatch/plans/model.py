"""Model tables derived from the test tables, and the registry of checked queries.

Every model column is one SQL expression that both engines evaluate alike, so the Spark
frame and the oracle's ``ne`` view come from the same text.
"""
from __future__ import annotations

from typing import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidewatch.functions.scalars import canonical_severity
from tidewatch.schema import EVENT_SCHEMA

K_SPARK = "cast(get_json_object(props, '$.k') as int)"
K_DUCK = "cast(json_extract_string(props, '$.k') as int)"

_PORTS = "case k % 8 when 0 then 22 when 1 then 80 when 2 then 443 when 3 then 3389 when 4 then 4444 " \
         "when 5 then 8080 when 6 then 445 else 53 end"
_DOMAIN = "case when event_type in ('click', 'view') then case k % 4 " \
          "when 0 then concat('px.tracker', cast(k % 3 as string), '.com') " \
          "when 1 then 'www.example.org' when 2 then 'cdn.shop.net' end end"
_KIND = "case event_type when 'error' then 'logon_failure' when 'signup' then 'logon_success' " \
        "when 'purchase' then 'conn' when 'click' then 'http' else 'dns_query' end"
_CONN = "event_type in ('purchase', 'click')"

EVENT_EXPRESSIONS = {
    "event_id": "cast(event_id as string)",
    "timestamp": "ts",
    "ingested_at": "ts",
    "source_type": "case event_id % 4 when 0 then 'zeek' when 1 then 'suricata_eve' when 2 then 'evtx' else 'osquery' end",
    "source_file": "concat('feed-', cast(event_id % 4 as string), '.log')",
    "hostname": "concat('host-', cast(user_id % 20 as string), '.corp.local')",
    "username": "concat('CORP', chr(92), 'user', cast(user_id as string))",
    "process_name": "case k % 6 when 0 then 'powershell.exe' when 1 then 'cmd.exe' when 2 then 'svchost.exe' "
                    "when 3 then 'chrome.exe' when 4 then 'certutil.exe' end",
    "process_id": "cast(1000 + k as int)",
    "parent_process_name": "case k % 5 when 0 then 'winword.exe' when 1 then 'explorer.exe' "
                           "when 2 then 'services.exe' when 3 then 'WmiPrvSE.exe' end",
    "parent_process_id": "cast(500 + k % 50 as int)",
    "file_path": "case k % 4 when 0 then concat('C:', chr(92), 'Users', chr(92), 'u', cast(user_id as string), chr(92), "
                 "'AppData', chr(92), 'f', cast(k % 10 as string), '.exe') "
                 "when 1 then concat('/tmp/f', cast(k % 10 as string)) end",
    "file_hash_sha256": "case when k % 8 = 0 then concat('MD5=aa', cast(k as string), ',SHA256=bb', cast(k as string)) end",
    "command_line": "case when k % 7 = 0 then concat('powershell.exe -nop -w hidden -enc ', cast(k as string)) "
                    "when k % 7 = 1 then concat('schtasks /create /sc daily ', cast(k as string)) "
                    "when k % 7 = 2 then 'net stop defender' else concat('run ', cast(k as string)) end",
    "src_ip": "concat('10.0.', cast(user_id % 3 as string), '.', cast(user_id % 40 as string))",
    "src_port": "cast(1024 + event_id % 50000 as int)",
    "dst_ip": "case when k < 50 then concat('192.168.1.', cast(k % 5 as string)) "
              "else concat('203.0.113.', cast(k % 5 as string)) end",
    "dst_port": f"case when {_CONN} then {_PORTS} end",
    "domain": _DOMAIN,
    "url": "case when event_type = 'click' then concat('http://www.example.org/p', cast(k as string)) end",
    "event_type": _KIND,
    "severity": "case when value >= 200 then 'CRIT' when value >= 120 then 'high' when value >= 60 then 'warn' "
                "when value >= 20 then 'low' else 'verbose' end",
    "confidence": "cast(k % 10 as double) / 10",
    "detection_source": "case when k % 6 = 0 then concat('signature-', cast(k % 3 as string)) end",
    "attack_technique": "case k % 9 when 0 then 'T1059.001' when 1 then 'T1110' when 2 then 'T1071.001' when 3 then 'T1046' end",
    "attack_tactic": "case k % 9 when 0 then 'execution' when 1 then 'credential-access' "
                     "when 2 then 'command-and-control' when 3 then 'discovery' end",
    "raw_event": "props",
    "tags": "case k % 4 when 0 then 'in:green0,zone:green' when 1 then 'in:red0,zone:red' when 2 then 'in:tun0' end",
    "case_id": "case when k % 10 = 0 then concat('case-', cast(user_id % 7 as string)) end",
    "event_outcome": "case event_type when 'error' then 'failure' when 'signup' then 'success' end",
    "user_domain": "'CORP'",
    "process_executable": "case when k % 12 = 2 then concat('C:', chr(92), 'Users', chr(92), 'Temp', chr(92), 'svchost.exe') "
                          "else concat('C:', chr(92), 'Windows', chr(92), 'p', cast(k % 6 as string)) end",
    "network_protocol": "case when k % 2 = 0 then 'tcp' else 'udp' end",
    "dns_query": f"case when event_type = 'view' then concat(repeat('a', k), '.', coalesce({_DOMAIN}, 'corp.local')) end",
    "dns_query_type": "case when event_type = 'view' then case when k % 3 = 0 then 'TXT' else 'A' end end",
    "tls_ja3": "case when k % 12 = 0 then concat('ja3-', cast(k as string)) end",
    "tls_version": "case when k % 12 = 0 then 'TLSv1.3' end",
    "http_method": "case when event_type = 'click' then case when k % 2 = 0 then 'POST' else 'GET' end end",
    "http_uri": "case when event_type = 'click' then concat('/p', cast(k as string)) end",
    "http_status_code": "case when event_type = 'click' then case when k % 5 = 0 then 401 else 200 end end",
    "http_user_agent": "case when event_type = 'click' then case k % 5 when 0 then 'curl/8.0' when 1 then 'Mozilla/5.0' "
                       "when 2 then 'python-requests/2.31' when 3 then 'Go-http-client/1.1' end end",
    "http_referrer": "case when event_type = 'click' then 'http://portal.corp.local/' end",
    "http_request_body_len": "case when event_type = 'click' then cast(k * 20000 as bigint) end",
    "http_response_body_len": "case when event_type = 'click' then cast(event_id % 500 as bigint) end",
    "http_resp_mime_type": "case when event_type = 'click' then case event_id % 3 when 0 then 'image/gif' "
                           "when 1 then 'text/html' end end",
    "ioc_matched": "k % 20 = 0",
    "ioc_confidence": "case when k % 20 = 0 then cast(40 + k % 60 as int) end",
    "conn_state": "case when event_type = 'purchase' then 'SF' end",
    "conn_duration": "case when event_type = 'purchase' then cast(k as double) * 50 end",
    "conn_orig_bytes": "case when event_type = 'purchase' then cast(k as bigint) * 1000 end",
    "zeek_notice_note": "case when k % 25 = 0 then 'Scan::Port_Scan' end",
    "zeek_weird_name": "case when k % 30 = 1 then 'bad_checksum' end",
    "ssh_auth_success": f"case when {_CONN} and k % 8 = 0 then k % 16 = 0 end",
    "ntlm_username": "case when k % 40 = 3 then concat('user', cast(user_id as string)) end",
    "smb_path": "case when k % 16 = 6 then concat(chr(92), chr(92), 'srv', chr(92), 'share') end",
    "smb_action": "case when k % 16 = 14 then 'SMB::TREE_CONNECT' end",
    "anomaly_score": "cast((event_id * 37) % 1000 as double) / 1000",
}

SEVERITY_DUCK = "case when value >= 200 then 'critical' when value >= 120 then 'high' when value >= 60 then 'medium' " \
                "when value >= 20 then 'low' else 'info' end"

# ``AS_OF`` stands where a live deployment would use the current time.
AS_OF = "2024-01-30 00:00:00"


def _ne_sql() -> str:
    cells = []
    for name, text in EVENT_EXPRESSIONS.items():
        cells.append(f"{SEVERITY_DUCK if name == 'severity' else text} AS {name}")
    cells.append(f"{EVENT_EXPRESSIONS['severity']} AS severity_raw")
    return (f"raw_k AS (SELECT *, {K_DUCK} AS k FROM events),\n"
            f"ne AS (SELECT {', '.join(cells)}, k, ts, user_id FROM raw_k)")


NE = _ne_sql()


def with_ne(body: str, *ctes: str, recursive: bool = False) -> str:
    """Oracle text: the event view, extra CTEs, then the query."""
    return f"WITH {'RECURSIVE ' if recursive else ''}" + ",\n".join([NE, *ctes]) + "\n" + body


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


PART_ROWS = 1 << 16


def spread(rows: DataFrame, key: str, parts: int | None = None) -> DataFrame:
    """Dealt into parts of about PART_ROWS rows. A split of a well compressed file holds millions of narrow rows, each of which becomes
    several wide ones; the narrow ones are dealt, so that a task's share stays the same however large the table is."""
    parts = parts or -(-rows.count() // PART_ROWS)       # from the files' footers
    return rows.repartition(parts, key) if parts > 1 else rows


def raw_events(spark: SparkSession, sf: str, parts: int | None = None) -> DataFrame:
    """Events as a sensor would deliver them: severity spelled with aliases. In ``parts`` partitions if given."""
    base = spread(table(spark, sf, "events"), "event_id", parts).withColumn("k", F.expr(K_SPARK))
    return base.selectExpr(*[f"cast({EVENT_EXPRESSIONS.get(f.name, 'null')} as {f.dataType.simpleString()}) AS {f.name}" for f in EVENT_SCHEMA.fields])


def events(spark: SparkSession, sf: str) -> DataFrame:
    """The normalized event table."""
    return raw_events(spark, sf).withColumn("severity", canonical_severity(F.col("severity")))


class Registry:
    """Named queries with optional oracle text."""

    def __init__(self) -> None:
        self.queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
        self.sql: dict[str, str] = {}

    def add(self, name: str, sql: str | None = None):
        def keep(fn):
            def run(spark: SparkSession, sf: str) -> DataFrame:
                spark.conf.set("spark.sql.session.timeZone", "UTC")
                return zone_free(fn(spark, sf))
            run.__name__ = name
            run.__doc__ = fn.__doc__
            if name in self.queries:
                raise ValueError(f"query {name} is registered twice")
            self.queries[name] = run
            if sql is not None:
                self.sql[name] = sql
            return fn
        return keep


def zone_free(df: DataFrame) -> DataFrame:
    """Timestamps leave as zone-less values, as the oracle reports them."""
    return df.select(*[
        F.col(f"`{n}`").cast("timestamp_ntz").alias(n) if t == "timestamp" else F.col(f"`{n}`")
        for n, t in df.dtypes])


REGISTRY = Registry()
query = REGISTRY.add
