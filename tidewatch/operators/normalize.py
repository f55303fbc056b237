"""Whole-event normalization as one projection."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tidewatch.functions.scalars import canonical_severity, compose_unicode, parse_once, scrub_prompt_injection, strip_controls, truncate_utf8

# Which columns each step touches.
CLEANED = [
    "source_type", "source_file", "hostname", "username", "process_name", "parent_process_name", "file_path",
    "file_hash_sha256", "src_ip", "dst_ip", "domain", "url", "event_type", "detection_source", "attack_technique",
    "attack_tactic", "tags",
]
SCRUBBED = ["command_line", "raw_event", "domain", "url", "file_path"]

# Canonical column -> dotted names that mean it, in order of preference.
DOTTED_NAMES = {
    "process_name": ["process.name"],
    "process_id": ["process.pid"],
    "command_line": ["process.command_line"],
    "process_executable": ["process.executable"],
    "parent_process_name": ["process.parent.name"],
    "parent_process_id": ["process.parent.pid"],
    "username": ["user.name"],
    "user_domain": ["user.domain"],
    "hostname": ["host.hostname", "host.name"],
    "src_ip": ["source.ip"],
    "src_port": ["source.port"],
    "dst_ip": ["destination.ip"],
    "dst_port": ["destination.port"],
    "domain": ["destination.domain", "dns.question.name"],
    "file_path": ["file.path"],
    "file_hash_sha256": ["file.hash.sha256"],
    "network_protocol": ["network.protocol"],
    "network_direction": ["network.direction"],
    "event_type": ["event.action"],
    "event_outcome": ["event.outcome"],
    "raw_event": ["event.original"],
    "attack_technique": ["threat.technique.id"],
    "attack_tactic": ["threat.tactic.name"],
    "url": ["url.original"],
}


def normalize(events: DataFrame, as_of: Column | None = None, unicode_form: bool = True) -> DataFrame:
    """Ids, times, severity, control characters, length, injection text. Idempotent, no row dropped.

    A missing id becomes a hash of the whole row, so a replay gives the same id again.
    """
    now = as_of if as_of is not None else F.current_timestamp()
    fingerprint = F.sha2(F.to_json(F.struct(*[F.col(c) for c in events.columns if c not in ("event_id", "ingested_at")])), 256)
    # Each stage sits behind a one-row explode, so that its expensive expressions are computed once and not copied into later ones.
    stripped = parse_once(events, F.struct(*[strip_controls(F.col(c)).alias(c) for c in [*CLEANED, "command_line"]]), "_stripped")
    cells = F.col("_stripped")
    step1: dict[str, Column] = {
        "event_id": F.when(F.trim("event_id") != "", F.col("event_id")).otherwise(fingerprint),
        "timestamp": F.coalesce("timestamp", now),
        "ingested_at": F.coalesce("ingested_at", now),
        "severity": canonical_severity(F.col("severity")),
        "command_line": F.when(cells["command_line"] != "", truncate_utf8(cells["command_line"])),
        "raw_event": truncate_utf8(F.col("raw_event")),
    }
    step1.update({c: cells[c] for c in CLEANED})
    clean = stripped.withColumns(step1).drop("_stripped")
    if unicode_form:
        clean = clean.withColumns({c: compose_unicode(F.col(c)) for c in SCRUBBED})
    scrubbed = parse_once(clean, F.struct(*[scrub_prompt_injection(F.col(c), unicode_form=False).alias(c) for c in SCRUBBED]), "_scrubbed")
    return scrubbed.withColumns({c: F.col("_scrubbed")[c] for c in SCRUBBED}).drop("_scrubbed")


def canonical_columns(df: DataFrame) -> DataFrame:
    """Rename dotted columns to canonical names; exact match first, then case-insensitive; the first alias that has
    a value wins. Other columns pass through."""
    lower = {}
    for c in df.columns:
        lower.setdefault(c.lower(), c)
    out, used = [], set()
    for target, names in DOTTED_NAMES.items():
        found = [n if n in df.columns else lower[n] for n in names if n in df.columns or n in lower]
        if target in df.columns:
            found = [target, *found]
        if found:
            out.append(F.coalesce(*[F.col(f"`{n}`") for n in found]).alias(target))
            used.update(found)
    rest = [F.col(f"`{c}`") for c in df.columns if c not in used]
    return df.select(*rest, *out)


def first_value(fields: Column, aliases: list[str]) -> Column:
    """First non-null value of a MAP whose lower-cased key is one of ``aliases`` (record order)."""
    hits = F.filter(F.map_entries(fields), lambda e: F.lower(e["key"]).isin(aliases) & e["value"].isNotNull())
    return F.get(hits, F.lit(0))["value"]
