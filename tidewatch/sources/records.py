"""Schema-less records: JSON lines, JSON arrays, CSV and dataset rows mapped to events by column aliases."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tidewatch.functions.scalars import MAX_TEXT_BYTES, parse_time, sha256_from_hash_list
from tidewatch.operators.normalize import DOTTED_NAMES
from tidewatch.schema import conform, lookup

# Event column -> record keys that mean it (lower case).
KEY_ALIASES = {
    "hostname": ["hostname", "host", "computer", "computername", "machine", "node"],
    "username": ["username", "user", "account", "subjectusername", "targetusername", "user_name", "account_name"],
    "process_name": ["process", "process_name", "image", "newprocessname", "processname", "process_image"],
    "process_id": ["pid", "process_id", "processid", "newprocessid"],
    "parent_process_id": ["ppid", "parent_pid", "parent_process_id", "parentprocessid"],
    "parent_process_name": ["parent_process", "parent_process_name", "parentimage", "parentprocessname"],
    "command_line": ["commandline", "command_line", "cmdline", "cmd", "image_loaded", "processcommandline"],
    "dst_ip": ["dst_ip", "dest_ip", "destinationip", "destination_ip", "dest", "dst"],
    "dst_port": ["dst_port", "dest_port", "destinationport", "destination_port"],
    "src_ip": ["src_ip", "source_ip", "sourceip", "src"],
    "src_port": ["src_port", "source_port", "sourceport"],
    "file_path": ["file_path", "filepath", "targetfilename", "targetobject", "filename", "path"],
    "file_hash_sha256": ["file_hash_sha256", "sha256", "hash", "hashes"],
    "domain": ["domain", "destinationhostname", "dest_hostname", "fqdn", "queryname"],
    "timestamp": ["timestamp", "time", "eventtime", "@timestamp", "date", "created_at", "event_time", "datetime"],
    "event_type": ["event_type", "eventtype", "type", "action", "category"],
    "severity": ["severity", "level", "alert_severity", "priority"],
    "tags": ["tags", "labels"],
    "case_id": ["case_id", "caseid", "case"],
    "url": ["url", "uri", "http_url", "request_url"],
}
ACCEPTED_SEVERITIES = ["critical", "high", "medium", "low", "info", "informational"]


def event_key(*parts: Column) -> Column:
    """Stable id from source and raw text, so reading a file twice gives the same ids."""
    return F.sha2(F.concat_ws("|", *parts), 256)


def read_json_lines(spark: SparkSession, path: str) -> DataFrame:
    """(fields, raw, source_file) per NDJSON line; blank and broken lines are dropped."""
    lines = spark.read.text(path).select(F.trim("value").alias("raw"), F.col("_metadata.file_path").alias("source_file"))
    return json_fields(lines)


def read_json_documents(spark: SparkSession, path: str) -> DataFrame:
    """Files holding one JSON array or one object."""
    whole = spark.read.text(path, wholetext=True).select(F.trim("value").alias("t"), F.col("_metadata.file_path").alias("source_file"))
    listed = F.when(F.col("t").startswith("["), F.col("t")).otherwise(F.concat(F.lit("["), "t", F.lit("]")))
    rows = whole.select(F.explode(F.from_json(listed, "array<map<string,string>>")).alias("fields"), "source_file")
    return rows.select("fields", F.to_json("fields").alias("raw"), "source_file")


def json_fields(lines: DataFrame) -> DataFrame:
    return lines.filter("raw <> ''").withColumn("fields", F.from_json("raw", "map<string,string>")).filter(F.size("fields") > 0)


def read_csv_records(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.option("header", True).option("mode", "PERMISSIVE").csv(path)
    cells = []
    for c in rows.columns:
        cells += [F.lit(c), F.col(f"`{c}`")]
    fields = F.create_map(*cells)
    return rows.select(fields.alias("fields"), F.to_json(fields).alias("raw"), F.col("_metadata.file_path").alias("source_file"))


def records_to_events(records: DataFrame, source_type: str, ingested_at: Column | None = None) -> DataFrame:
    """Rows (fields, raw, source_file) as events; the first non-null key of an alias set wins, in record order."""
    now = ingested_at if ingested_at is not None else F.current_timestamp()
    entries = F.transform(F.map_entries("fields"), lambda e: F.struct(F.lower(e["key"]).alias("k"), e["value"].alias("v")))
    lowered = records.select("*", F.explode(F.array(entries)).alias("_e"))  # a generator: computed once, not per column

    def pick(target: str) -> Column:
        names = KEY_ALIASES[target] + DOTTED_NAMES.get(target, [])
        hit = F.get(F.filter("_e", lambda e: e["k"].isin(names) & e["v"].isNotNull()), F.lit(0))["v"]
        return F.nullif(F.trim(hit), F.lit(""))

    cells = {t: pick(t) for t in KEY_ALIASES}
    level = F.lower(cells["severity"])
    hashed = cells["file_hash_sha256"]
    cells.update({
        "timestamp": F.coalesce(parse_time(cells["timestamp"]), now),
        "severity": F.when(level.isin(ACCEPTED_SEVERITIES), level),
        "command_line": F.substring(cells["command_line"], 1, MAX_TEXT_BYTES),
        "file_hash_sha256": F.coalesce(sha256_from_hash_list(hashed), hashed),
        "tags": F.coalesce(F.array_join(F.from_json(cells["tags"], "array<string>"), ","), cells["tags"]),
        "ingested_at": now, "source_type": F.lit(source_type), "source_file": F.col("source_file"),
        "raw_event": F.substring("raw", 1, MAX_TEXT_BYTES), "event_id": event_key(F.col("source_file"), F.col("raw"))})
    for number in ("process_id", "parent_process_id", "src_port", "dst_port"):
        cells[number] = cells[number].try_cast("int")
    return conform(lowered.select(*[c.alias(n) for n, c in cells.items()]))


# Fixed values.
DATASET_SEVERITY = {"informational": "low", "information": "low", "info": "low", "debug": "low", "verbose": "low", "unknown": "low",
                    "warning": "medium", "warn": "medium", "moderate": "medium", "med": "medium", "crit": "critical", "hi": "high",
                    "low": "low", "medium": "medium", "high": "high", "critical": "critical"}


def dataset_rows_to_events(rows: DataFrame, ingested_at: Column | None = None) -> DataFrame:
    """Public SIEM dataset rows, whatever of the known column spellings they have."""
    now = ingested_at if ingested_at is not None else F.current_timestamp()
    have = set(rows.columns)

    def first(*names: str) -> Column:
        found = [F.nullif(F.trim(F.col(f"`{n}`").cast("string")), F.lit("")) for n in names if n in have]
        return F.coalesce(*found) if found else F.lit(None).cast("string")

    raw = F.to_json(F.struct(*[F.col(f"`{c}`") for c in rows.columns]))
    return conform(rows.select(
        event_key(F.lit("dataset"), raw).alias("event_id"), F.coalesce(parse_time(first("Timestamp", "timestamp")), now).alias("timestamp"),
        now.alias("ingested_at"), F.lit("siem_seed").alias("source_type"), first("Source IP", "hostname", "Host").alias("hostname"),
        first("User", "username").alias("username"), first("Process", "process").alias("process_name"),
        F.coalesce(first("Event Type", "event_type"), F.lit("siem_event")).alias("event_type"),
        F.coalesce(lookup(DATASET_SEVERITY, F.lower(first("Severity", "severity"))), F.lit("low")).alias("severity"),
        first("Source IP", "src_ip").alias("src_ip"), first("Destination IP", "dst_ip").alias("dst_ip"), raw.alias("raw_event")))


_SOURCES: dict = {}


def register_source(name: str, reader) -> None:
    """Add a reader ``f(lines) -> events`` under a name; streaming ingestion looks readers up here."""
    _SOURCES[name] = reader


def source(name: str):
    return _SOURCES[name]
