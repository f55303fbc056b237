"""Threat feeds, blocklists, technique catalogs and external scanner findings."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from tidewatch.functions.keyed import cut_lineage
from tidewatch.functions.scalars import parse_once, stable_id
from tidewatch.schema import lookup


def _plain(c: Column) -> Column:
    return F.nullif(F.trim(F.regexp_replace(c, '^\\s*"|"\\s*$', "")), F.lit(""))


def _no_comments(lines: DataFrame, mark: str = "#") -> DataFrame:
    return lines.filter((F.trim("value") != "") & ~F.col("value").startswith(mark))


# ---- indicator feeds (lines in ``value``) --------------------------------------------------------------

def feodo_iocs(lines: DataFrame) -> DataFrame:
    c = F.from_csv("value", F.lit("first_seen_utc string, dst_ip string, dst_port string, c2_status string, last_online string, malware string"))
    rows = _no_comments(lines).select(c.alias("c")).select("c.*")
    return rows.select(_plain(F.col("dst_ip")).alias("ioc_value"), F.lit("ip").alias("ioc_type"), F.lit(None).cast("string").alias("bare_ip"), F.lit(50).alias("confidence"),
                       _plain(F.col("first_seen_utc")).alias("first_seen"), _plain(F.col("last_online")).alias("last_seen"), _plain(F.col("malware")).alias("malware_family"),
                       F.lit(None).cast("string").alias("actor_tag"), F.lit("feodo").alias("feed_source")).filter("ioc_value IS NOT NULL")


def kev_iocs(documents: DataFrame) -> DataFrame:
    """Vulnerability catalog documents (value = {"vulnerabilities": [...]})."""
    v = F.explode(F.from_json("value", "vulnerabilities array<struct<cveID:string, dateAdded:string, vulnerabilityName:string>>")["vulnerabilities"])
    rows = documents.select(v.alias("v")).select("v.*")
    return rows.select(_plain(F.col("cveID")).alias("ioc_value"), F.lit("cve").alias("ioc_type"), F.lit(40).alias("confidence"), _plain(F.col("dateAdded")).alias("first_seen"),
                       _plain(F.col("vulnerabilityName")).alias("actor_tag"), F.lit("cisa_kev").alias("feed_source")).filter("ioc_value IS NOT NULL")


def threatfox_iocs(lines: DataFrame) -> DataFrame:
    ddl = "first_seen string, id string, ioc string, kind string, malware string, level string, tags string"
    c = F.from_csv("value", F.lit(ddl), {"ignoreLeadingWhiteSpace": "true"})
    rows = _no_comments(lines).filter(F.size(F.split("value", ",")) >= 6).select(c.alias("c")).select("c.*")
    ioc = _plain(F.col("ioc"))
    return rows.select(ioc.alias("ioc_value"), _plain(F.col("kind")).alias("ioc_type"), F.when(ioc.contains(":"), F.regexp_extract(ioc, "^(.*):[^:]*$", 1)).alias("bare_ip"),
                       F.lit(50).alias("confidence"), _plain(F.col("first_seen")).alias("first_seen"), _plain(F.col("malware")).alias("malware_family"),
                       _plain(F.col("tags")).alias("actor_tag"), F.lit("threatfox").alias("feed_source")).filter("ioc_value IS NOT NULL")


# Fixed values.
ATTRIBUTE_TYPES = {"ip-src": "ip", "ip-dst": "ip", "domain": "domain", "hostname": "domain", "url": "url", "md5": "md5", "sha1": "sha1", "sha256": "sha256",
                   "email-src": "email", "filename": "filename"}
THREAT_LEVEL = {1: 90, 2: 70, 3: 50, 4: 30}


def misp_iocs(attributes: DataFrame) -> DataFrame:
    """Attribute rows (type, value, threat_level, info, tags): known types only, actor from the galaxy tag."""
    galaxy = F.filter("tags", lambda t: t.startswith("misp-galaxy:threat-actor="))
    actor = F.regexp_replace(F.substring_index(F.get(galaxy, F.lit(0)), "=", -1), '^"|"$', "")
    return attributes.select(F.col("value").alias("ioc_value"), lookup(ATTRIBUTE_TYPES, F.col("type")).alias("ioc_type"),
                             F.coalesce(lookup(THREAT_LEVEL, F.col("threat_level")), F.lit(50)).alias("confidence"),
                             F.nullif(F.substring("info", 1, 120), F.lit("")).alias("malware_family"), actor.alias("actor_tag"), F.lit("misp").alias("feed_source")) \
                     .filter("ioc_type IS NOT NULL")


# ---- blocklists ---------------------------------------------------------------------------------------------

def easyprivacy_domains(lines: DataFrame) -> DataFrame:
    d = F.lower(F.regexp_extract(F.trim("value"), r"^\|\|([a-zA-Z0-9._-]+)\^", 1))
    return _no_comments(lines, "!").select(d.alias("domain"), F.lit("easyprivacy").alias("feed")).filter("domain <> ''")


def disconnect_domains(documents: DataFrame) -> DataFrame:
    """(domain, category) of {"categories": {name: [{company: {url: [domains]}}]}}; the dnt marker is skipped."""
    ddl = "categories map<string, array<map<string, map<string, string>>>>"
    a = documents.select(F.explode(F.from_json("value", ddl)["categories"]).alias("category", "companies"))
    b = a.select("category", F.explode("companies").alias("company")).select("category", F.explode("company").alias("name", "sites"))
    c = b.select("category", F.explode("sites").alias("url", "domains")).filter("url <> 'dnt'")
    d = c.select(F.explode(F.from_json("domains", "array<string>")).alias("domain"), "category")
    return d.select(F.lower("domain").alias("domain"), "category")


def ipsum_addresses(lines: DataFrame) -> DataFrame:
    parts = F.split("value", "\t")
    return _no_comments(lines).select(F.trim(F.get(parts, F.lit(0))).alias("ip"), F.trim(F.get(parts, F.lit(1))).try_cast("int").alias("tier")).filter("tier IS NOT NULL AND ip <> ''")


def tor_exits(lines: DataFrame) -> DataFrame:
    return _no_comments(lines).select(F.trim("value").alias("ip")).distinct()


# ---- technique catalog ---------------------------------------------------------------------------------------

OBJECT_DDL = """id string, type string, name string, description string, revoked boolean, aliases array<string>, relationship_type string, source_ref string, target_ref string,
x_mitre_is_subtechnique boolean, x_mitre_deprecated boolean, x_mitre_detection string, x_mitre_platforms array<string>,
external_references array<struct<source_name:string, external_id:string>>, kill_chain_phases array<struct<kill_chain_name:string, phase_name:string>>"""


def read_stix(spark: SparkSession, path: str) -> DataFrame:
    """Objects of bundle files, one row each."""
    bundle = spark.read.text(path, wholetext=True)
    return bundle.select(F.explode(F.from_json("value", f"objects array<struct<{', '.join(_colon(OBJECT_DDL))}>>")["objects"]).alias("o")).select("o.*")


def _colon(ddl: str) -> list[str]:
    out, depth, part = [], 0, ""
    for ch in ddl.replace("\n", " "):
        depth += (ch == "<") - (ch == ">")
        if ch == "," and depth == 0:
            out.append(part.strip())
            part = ""
        else:
            part += ch
    out.append(part.strip())
    return [p.replace(" ", ":", 1) for p in out]


def stix_objects(lines: DataFrame) -> DataFrame:
    """One object per line (value)."""
    return parse_once(lines, F.from_json("value", OBJECT_DDL), "o").select("o.*")


def _catalog_id() -> Column:
    refs = F.filter("external_references", lambda r: (r["source_name"] == "mitre-attack") & r["external_id"].isNotNull())
    return F.get(refs, F.lit(0))["external_id"]


def _not(flag: str) -> Column:
    return ~F.coalesce(F.col(flag), F.lit(False))


def stix_techniques(objects: DataFrame) -> DataFrame:
    return objects.filter((F.col("type") == "attack-pattern") & _not("revoked") & _not("x_mitre_is_subtechnique")).select(
        F.col("id").alias("stix_id"), _catalog_id().alias("tech_id"), "name", F.coalesce(F.get("kill_chain_phases", F.lit(0))["phase_name"], F.lit("")).alias("tactic")) \
        .filter("tech_id IS NOT NULL AND tech_id <> ''")


def stix_groups(objects: DataFrame) -> DataFrame:
    return objects.filter((F.col("type") == "intrusion-set") & _not("revoked")).select(F.col("id").alias("stix_id"), _catalog_id().alias("group_id"), "name", "aliases")


def stix_group_techniques(objects: DataFrame) -> DataFrame:
    """(stix_id, tech_id) of live ``uses`` relationships from groups to live top-level techniques. Objects are parsed once and stored by what is asked of them."""
    objects = cut_lineage(objects.select("id", "type", "revoked", "relationship_type", "source_ref", "target_ref", "x_mitre_is_subtechnique", "external_references", "name", "kill_chain_phases"))
    uses = objects.filter((F.col("type") == "relationship") & _not("revoked") & (F.col("relationship_type") == "uses")).select("source_ref", "target_ref").distinct()
    groups = objects.filter(F.col("type") == "intrusion-set").select(F.col("id").alias("source_ref"))
    techniques = stix_techniques(objects).select(F.col("stix_id").alias("target_ref"), "tech_id")
    return uses.join(groups, "source_ref", "left_semi").join(techniques, "target_ref").select(F.col("source_ref").alias("stix_id"), "tech_id").distinct()


def _clean(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(c, r"\(Citation:[^)]+\)", ""), r"\s+", " "))


def technique_documents(objects: DataFrame, min_description: int = 50, max_chars: int = 2000, procedures: int = 5) -> DataFrame:
    """(tid, name, document): description, detection advice, mitigations and up to five observed procedures as one text.
    Objects are parsed once and stored by what is asked of them."""
    objects = cut_lineage(objects.select("id", "type", "revoked", "relationship_type", "source_ref", "target_ref", "x_mitre_deprecated", "external_references", "name", "kill_chain_phases",
                                         "description", "x_mitre_detection", "x_mitre_platforms"))
    rel = objects.filter(F.col("type") == "relationship").select("id", "relationship_type", "source_ref", "target_ref", "description")
    seen = _first_n(rel.filter((F.col("relationship_type") == "uses") & (F.coalesce("description", F.lit("")) != ""))
                    .select("target_ref", "id", F.substring(_clean(F.col("description")), 1, 400).alias("text")), procedures).withColumnRenamed("texts", "seen")
    names = objects.select(F.col("id").alias("source_ref"), F.col("name").alias("text"))
    named = rel.filter(F.col("relationship_type") == "mitigates").join(names, "source_ref").filter("text <> ''").select("target_ref", "id", "text")
    # Names of one character or more, two more between each: a text of max_chars can't show more than a third as many and one.
    fixes = _first_n(named, max_chars // 3 + 1).withColumnRenamed("texts", "fixes")
    t = objects.filter((F.col("type") == "attack-pattern") & _not("revoked") & _not("x_mitre_deprecated")).select(
        "id", _catalog_id().alias("tid"), "name", _clean(F.col("description")).alias("body"), _clean(F.col("x_mitre_detection")).alias("advice"),
        F.coalesce(F.nullif(F.array_join(F.transform("kill_chain_phases", lambda p: p["phase_name"]), ", "), F.lit("")), F.lit("Unknown")).alias("tactics"),
        F.coalesce(F.nullif(F.array_join("x_mitre_platforms", ", "), F.lit("")), F.lit("Unknown")).alias("platforms")) \
        .filter(F.col("tid").startswith("T") & (F.length("body") >= min_description))
    j = t.join(seen, t["id"] == seen["target_ref"], "left").drop("target_ref").join(fixes, t["id"] == fixes["target_ref"], "left")
    text = F.concat_ws(
        "\n", F.concat(F.lit("Technique: "), "tid", F.lit(" — "), "name"), F.concat(F.lit("Tactics: "), "tactics"), F.concat(F.lit("Platforms: "), "platforms"),
        F.lit(""), F.lit("Description:"), F.col("body"), F.when(F.col("advice") != "", F.concat(F.lit("\nDetection guidance:\n"), "advice")),
        F.when(F.size("fixes") > 0, F.concat(F.lit("\nMitigations: "), F.array_join("fixes", "; "))),
        F.when(F.size("seen") > 0, F.concat(F.lit("\nObserved in the wild:\n"), F.array_join(F.transform("seen", lambda x: F.concat(F.lit("- "), x)), "\n"))))
    return j.select("tid", "name", F.substring(text, 1, max_chars).alias("document"))


def _first_n(rows: DataFrame, n: int) -> DataFrame:
    """First n texts per target by id; the limit is applied before the shuffle as well as after it."""
    order = Window.partitionBy("target_ref").orderBy("id")
    top = rows.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= n)
    return top.groupBy("target_ref").agg(F.transform(F.sort_array(F.collect_list(F.struct("n", "text"))), lambda x: x["text"]).alias("texts"))


# ---- scanner findings --------------------------------------------------------------------------------------

# Fixed values.
SCAN_A_LEVEL = {"crit": "critical", "high": "high", "med": "medium", "medium": "medium", "low": "low", "info": "informational"}
SCAN_A_TACTIC = {"Recon": "Reconnaissance", "ResDev": "Resource Development", "InitAccess": "Initial Access", "Exec": "Execution", "Persis": "Persistence",
                 "PrivEsc": "Privilege Escalation", "DefEvas": "Defense Evasion", "CredAccess": "Credential Access", "Discov": "Discovery", "LatMov": "Lateral Movement",
                 "Collect": "Collection", "C2": "Command and Control", "Exfil": "Exfiltration", "Impact": "Impact"}
SCAN_B_LEVEL = {"critical": "critical", "high": "high", "medium": "medium", "low": "low", "informational": "informational", "info": "informational"}
SCAN_B_TACTICS = [
    "initial_access", "execution", "persistence", "privilege_escalation", "defense_evasion", "credential_access",
    "discovery", "lateral_movement", "collection", "command_and_control", "exfiltration", "impact", "reconnaissance",
    "resource_development",
]


def hayabusa_detections(lines: DataFrame, case_id: str | None = None) -> DataFrame:
    """Timeline findings, one JSON object per line."""
    ddl = "Level string, MitreTags array<string>, MitreTactics array<string>, Details map<string,string>, RuleTitle string, RuleID string, RuleFile string"
    r = lines.withColumn("r", F.from_json("value", ddl)).filter("r IS NOT NULL").select("value", "r.*")
    tactic = F.get("MitreTactics", F.lit(0))
    title = F.coalesce(F.nullif("RuleTitle", F.lit("")), F.lit("Hayabusa Detection"))
    details = F.array_join(F.transform(F.filter(F.map_entries("Details"), lambda e: e["value"].isNotNull() & (e["value"] != "")),
                                       lambda e: F.concat(e["key"], F.lit("="), e["value"])), " | ")
    return r.select(
        stable_id(F.lit("hayabusa"), F.col("value")).alias("id"), F.concat(F.lit("hayabusa-"), F.coalesce(F.nullif("RuleID", F.lit("")), F.nullif("RuleFile", F.lit("")), F.lit("unknown"))).alias("rule_id"),
        title.alias("rule_name"), F.coalesce(lookup(SCAN_A_LEVEL, F.lower(F.coalesce("Level", F.lit("med")))), F.lit("medium")).alias("severity"),
        F.get(F.filter("MitreTags", lambda t: F.upper(t).startswith("T") & (F.length(t) >= 5)), F.lit(0)).alias("attack_technique"),
        F.coalesce(lookup(SCAN_A_TACTIC, tactic), tactic).alias("attack_tactic"),
        F.concat_ws(": ", F.concat(F.lit("[Hayabusa] "), title), F.nullif(details, F.lit(""))).alias("explanation"), F.lit(case_id).cast("string").alias("case_id"))


def chainsaw_detections(documents: DataFrame, case_id: str | None = None) -> DataFrame:
    """Hunt findings; each row of ``value`` is a JSON array of findings."""
    item = "struct<level:string, tags:array<string>, name:string, id:string, status:string, document:struct<data:struct<Event:struct<System:struct<EventRecordID:string>>>>>"
    r = documents.select(F.explode(F.from_json("value", f"array<{item}>")).alias("r")).select("r.*")
    technique = F.get(F.filter("tags", lambda t: F.lower(t).rlike(r"^attack\.t\d{4}")), F.lit(0))
    tactic = F.get(F.filter("tags", lambda t: F.regexp_replace(F.lower(t), r"^attack\.", "").isin(SCAN_B_TACTICS) & F.lower(t).startswith("attack.")), F.lit(0))
    level = F.lower(F.coalesce(F.nullif("level", F.lit("")), F.lit("medium")))
    name = F.coalesce(F.nullif("name", F.lit("")), F.lit("Chainsaw Detection"))
    record = F.col("document.data.Event.System.EventRecordID")
    return r.select(
        stable_id(F.lit("chainsaw"), F.concat_ws("|", "id", "name", record, "level")).alias("id"),
        F.concat(F.lit("chainsaw-"), F.coalesce(F.nullif("id", F.lit("")), F.nullif("name", F.lit("")), F.lit("unknown"))).alias("rule_id"), name.alias("rule_name"),
        F.coalesce(lookup(SCAN_B_LEVEL, level), F.lit("medium")).alias("severity"), F.upper(F.regexp_replace(technique, r"(?i)^attack\.", "")).alias("attack_technique"),
        F.initcap(F.regexp_replace(F.regexp_replace(tactic, r"(?i)^attack\.", ""), "_", " ")).alias("attack_tactic"),
        F.format_string("[Chainsaw] %s (level=%s, status=%s)", name, level, F.coalesce("status", F.lit("unknown"))).alias("explanation"),
        record.alias("matched_event"), F.lit(case_id).cast("string").alias("case_id"))
