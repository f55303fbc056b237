"""Column expressions: cleaning, canonical forms, network tests, identifiers, decay."""
from __future__ import annotations

import unicodedata
from collections.abc import Callable
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from tidewatch.schema import FEED_BASE_SCORES, OCSF_BY_TYPE, SEVERITY_ALIASES, SEVERITY_RANK, lookup

# ---- Fixed values: patterns whose exact text decides the result --------------------------
CONTROL_CHARS = r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x9f]"
INJECTION_PATTERN = (
    r"(?i)(?:ignore\s+previous\s+instructions?|\[/?INST\]|<\|(?:system|user|assistant)\|>|###"
    r"|---SYSTEM|---INSTRUCTION|ignore\s+\S+\s+(?:instruction|prompt|context))"
)
BASE64_TEXT = r"^[A-Za-z0-9+/\s]+=*$"
UNREADABLE = r"[^\p{L}\p{N} .,!?;:'\-_()/\\\n\t]"
TECHNIQUE_ID = r"^T\d{4}(\.\d{3})?$"
IPV4 = r"^\d{1,3}(\.\d{1,3}){3}$"
MAX_TEXT_BYTES = 8192


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def all_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions)


# ---- cleaning ----------------------------------------------------------------------------

def canonical_severity(severity: Column) -> Column:
    """16 aliases to five levels; unknown text becomes info, null stays null."""
    key = F.lower(F.trim(severity))
    return F.when(severity.isNotNull(), F.coalesce(lookup(SEVERITY_ALIASES, key), F.lit("info")))


def severity_rank(severity: Column) -> Column:
    return F.coalesce(lookup(SEVERITY_RANK, severity), F.lit(5))


def strip_controls(text: Column) -> Column:
    return F.nullif(F.regexp_replace(text, CONTROL_CHARS, ""), F.lit(""))


def truncate_utf8(text: Column, limit: int = MAX_TEXT_BYTES) -> Column:
    """Longest prefix of whole characters within ``limit`` bytes.

    Looks at the byte after the cut and steps back over continuation bytes (at most three).
    """
    raw = text.cast("binary")

    def starts_char(position: int) -> Column:
        byte = F.hex(F.substring(raw, position, 1))
        return ~byte.between("80", "BF")

    cut = F.lit(limit - 3)
    for back in (2, 1, 0):
        cut = F.when(starts_char(limit + 1 - back), F.lit(limit - back)).otherwise(cut)
    return F.when(F.octet_length(text) <= limit, text).otherwise(
        F.decode(raw.substr(F.lit(1), cut), "UTF-8"))


def compose_unicode(text: Column) -> Column:
    """NFC form; only non-ASCII values travel to Python, the rest pass as nulls."""
    def nfc(values: pd.Series) -> pd.Series:
        return values.map(lambda v: unicodedata.normalize("NFC", v), na_action="ignore")

    return F.coalesce(F.pandas_udf(nfc, "string")(F.when(text.rlike(r"[^\x00-\x7f]"), text)), text)


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with value computed a single time however often it is used: the optimizer can't copy it into each place."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def parse_once(rows: DataFrame, parsed: Column, name: str) -> DataFrame:
    """Add a computed column through a one-element explode. The generator keeps the optimizer from copying the computation into
    every expression that reads it."""
    return rows.select("*", F.explode(F.array(parsed)).alias(name))


def decoded_base64(text: Column) -> Column:
    """Readable plain text hidden in a base64-looking value, else null. Length and alphabet are tested before anything is decoded."""
    def readable(decoded: Column) -> Column:
        def judged(plain: Column) -> Column:
            # Bytes that are no text count as unreadable, so binary garbage is left out.
            letters = F.length(F.regexp_replace(plain, UNREADABLE, ""))
            return F.when((F.trim(plain) != "") & (letters / F.greatest(F.length(decoded), F.lit(1)) > 0.7), plain)
        return once(F.replace(decoded, F.lit("\ufffd"), F.lit("")), judged)

    def opened(body: Column) -> Column:
        padded = F.concat(body, F.repeat(F.lit("="), F.pmod(-F.length(body), F.lit(4))))
        return once(F.make_valid_utf8(F.try_to_binary(padded, F.lit("base64")).cast("string")), readable)

    def tried(bare: Column) -> Column:
        looks = (F.length(F.replace(bare, F.lit(" "), F.lit(""))) >= 16) & bare.rlike(BASE64_TEXT)
        return F.when(looks, once(F.regexp_replace(bare, r"[\s=]", ""), opened))

    return once(F.trim(text), tried)


def scrub_prompt_injection(text: Column, unicode_form: bool = True) -> Column:
    """Remove instruction-injection phrases, also from base64-hidden text; empty becomes null."""
    def trimmed(base: Column) -> Column:
        seen = F.concat_ws(" ", base, decoded_base64(base))
        return F.regexp_replace(F.regexp_replace(seen, INJECTION_PATTERN, ""), r"^\s+|\s+$", "")

    base = compose_unicode(text) if unicode_form else text
    return once(once(base, trimmed), lambda t: F.when(t != "", t))


def parse_time(value: Column) -> Column:
    """ISO text, epoch seconds, or 100-ns ticks since 1601 (numbers above 1e17) as TIMESTAMP."""
    text = F.trim(value.cast("string"))
    numeric = F.when(text.rlike(r"^[+-]?\d+(\.\d+)?([eE]\+?\d+)?$"), text.try_cast("double"))
    iso = F.regexp_replace(text, r"([+-]\d{2})(\d{2})$", "$1:$2")
    return F.coalesce(
        F.when(numeric > 1e17, F.timestamp_seconds(numeric / 1e7 - F.lit(11644473600.0)))
         .when(numeric.isNotNull(), F.timestamp_seconds(numeric)),
        F.when(~text.rlike(r"^[+-]?\d+(\.\d+)?$"), iso.try_cast("timestamp")),
    )


def sanitize_field(text: Column, limit: int = 500) -> Column:
    """ASCII control characters out, over-long values cut and marked."""
    clean = F.regexp_replace(text, r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]", "")
    return F.when(F.length(clean) > limit, F.concat(F.substring(clean, 1, limit), F.lit(" [truncated]"))).otherwise(clean)


def sha256_from_hash_list(hashes: Column) -> Column:
    return F.nullif(F.regexp_extract(hashes, r"(?i)(?:^|,)\s*SHA256=([^,]+)", 1), F.lit(""))


def ocsf_class(event_type: Column) -> Column:
    return lookup(OCSF_BY_TYPE, event_type)


def embedding_text(e) -> Column:
    """Space-joined ``label:value`` pairs; null and empty fields are skipped."""
    def part(label: str, value: Column) -> Column:
        return F.when(value.isNotNull() & (value != ""), F.concat(F.lit(label + ":"), value))

    return F.concat_ws(
        " ", part("host", e("hostname")), part("user", e("username")), part("process", e("process_name")),
        part("cmd", F.substring(e("command_line"), 1, 256)), part("type", e("event_type")),
        part("severity", e("severity")), part("dst", e("dst_ip")), part("technique", e("attack_technique")))


# ---- network -----------------------------------------------------------------------------

def ipv4_number(ip: Column) -> Column:
    """IPv4 text to its 32-bit number as BIGINT; null for anything else."""
    o = F.split(ip, r"\.")
    octets = [F.get(o, i).try_cast("bigint") for i in range(4)]
    number = octets[0] * 16777216 + octets[1] * 65536 + octets[2] * 256 + octets[3]
    valid = ip.rlike(IPV4) & all_of([x <= 255 for x in octets])
    return F.when(valid, number)


# Address blocks that are not globally routable: (first address, prefix length).
PRIVATE_BLOCKS = [
    ("0.0.0.0", 8), ("10.0.0.0", 8), ("127.0.0.0", 8), ("169.254.0.0", 16), ("172.16.0.0", 12), ("192.168.0.0", 16),
]


def cidr_bounds(address: str, prefix: int) -> tuple[int, int]:
    a, b, c, d = (int(x) for x in address.split("."))
    first = a * 16777216 + b * 65536 + c * 256 + d
    return first, first + 2 ** (32 - prefix) - 1


def is_private_ip(ip: Column) -> Column:
    """RFC 1918, loopback, link-local (IPv4) or loopback, unique-local, link-local (IPv6)."""
    n = ipv4_number(ip)
    v4 = any_of([n.between(*cidr_bounds(a, p)) for a, p in PRIVATE_BLOCKS])
    v6 = F.lower(ip).rlike(r"^(::1$|f[cd][0-9a-f]{2}:|fe[89ab][0-9a-f]:)")
    return F.coalesce(v4, F.lit(False)) | F.coalesce(v6, F.lit(False))


def address_tag(ip: Column) -> Column:
    return F.when(is_private_ip(ip), F.lit("internal")).otherwise(F.lit("external"))


def flow_direction(src: Column, dst: Column) -> Column:
    """Private source is outbound (also private to private); private target inbound; else lateral."""
    return F.when(is_private_ip(src), "outbound").when(is_private_ip(dst), "inbound").otherwise("lateral")


def peer_subnet(ip: Column) -> Column:
    parts = F.split(ip, r"\.")
    return F.when(F.size(parts) == 4, F.concat(F.array_join(F.slice(parts, 1, 3), "."), F.lit(".subnet"))) \
            .otherwise(F.lit("unknown_subnet"))


def peer_process(process: Column) -> Column:
    return F.trim(F.lower(F.coalesce(F.nullif(process, F.lit("")), F.lit("unknown"))))


def domain_suffixes(domain: Column) -> Column:
    """The domain and each parent, without the bare top level."""
    labels = F.split(F.trim(F.lower(domain), F.lit(".")), r"\.")
    n = F.size(labels)
    return F.when(n >= 2, F.transform(
        F.sequence(F.lit(1), n - 1),
        lambda i: F.array_join(F.slice(labels, i, n), "."))).otherwise(F.array().cast("array<string>"))


def target_type(target: Column) -> Column:
    return F.when(target.rlike(IPV4), "ip").when(target.rlike(r"^AS\d+$"), "asn") \
            .when(target.contains("@"), "email").otherwise("domain")


def ip_type(is_tor: Column, is_proxy: Column, is_datacenter: Column, details: Column) -> Column:
    """Flags first, then the cached JSON answer; tor > vpn > datacenter > isp."""
    def flag(name: str) -> Column:
        return F.get_json_object(details, f"$.{name}") == "true"
    return F.when(is_tor, "tor").when(is_proxy, "vpn").when(is_datacenter, "datacenter") \
            .when(flag("proxy"), "vpn").when(flag("hosting"), "datacenter").when(flag("mobile"), "isp")


# ---- identifiers and descriptions ----------------------------------------------------------

def canonical_id(kind: str, value: Column) -> Column:
    """``type:value`` with host domain, user realm, path and port removed."""
    v = F.lower(value)
    prefix = kind
    if kind == "host":
        v = F.substring_index(v, ".", 1)
    elif kind == "user":
        v = F.when(v.contains("\\"), F.substring_index(v, "\\", -1)).otherwise(F.substring_index(v, "@", 1))
    elif kind in ("process", "file"):
        v = F.regexp_extract(v, r"[^/\\]*$", 0)
    elif kind in ("ip_src", "ip_dst"):
        v, prefix = F.substring_index(v, ":", 1), "ip"
    elif kind == "domain":
        v = F.rtrim(v, F.lit("."))
    return F.when(v.isNotNull() & (v != ""), F.concat(F.lit(prefix + ":"), v))


def parent_technique(technique: Column) -> Column:
    return F.upper(F.substring_index(technique, ".", 1))


def is_technique(value: Column) -> Column:
    return value.rlike(TECHNIQUE_ID)


def stable_id(kind: Column, name: Column) -> Column:
    return F.substring(F.sha2(F.concat(kind, F.lit(":"), name), 256), 1, 32)


def describe_event(e) -> Column:
    """One sentence per event; missing values print as empty text."""
    def t(name: str, default: str = "") -> Column:
        return F.coalesce(e(name).cast("string"), F.lit(default))
    kind = e("event_type")
    return (
        F.when((kind == "process_create") & (t("parent_process_name") != ""),
               F.format_string("%s spawned %s on %s", t("parent_process_name"), t("process_name"), t("hostname")))
         .when(kind == "process_create", F.format_string("Process created: %s on %s", t("process_name"), t("hostname")))
         .when(kind == "network_connection",
               F.format_string("%s connected to %s:%s from %s", t("process_name"), t("dst_ip"), t("dst_port", "?"), t("hostname")))
         .when(kind == "file_create",
               F.format_string("%s wrote file %s on %s", t("process_name"), t("file_path"), t("hostname")))
         .when(kind == "registry_write",
               F.format_string("%s wrote registry key %s on %s", t("process_name"), t("file_path"), t("hostname")))
         .when(kind == "process_access",
               F.format_string("%s accessed %s on %s", t("process_name"), t("file_path"), t("hostname")))
         .when(kind == "auth_failure",
               F.format_string("Authentication failed for %s on %s", t("username", "?"), t("hostname")))
         .otherwise(F.format_string("%s: %s on %s", t("event_type"), t("process_name"), t("hostname"))))


# ---- indicator confidence --------------------------------------------------------------------

def daily_decay(confidence: Column) -> Column:
    return F.greatest(F.lit(0), confidence - 1)


def weekly_decay(score: Column, days: Column) -> Column:
    return F.greatest(F.lit(0), score - F.floor(days * 5 / 7)).cast("int")


def feed_base_score(feed: Column) -> Column:
    return F.coalesce(lookup(FEED_BASE_SCORES, F.lower(feed)), F.lit(30))
