"""Personal data in text, with DataFrame functions alone: four fixed kinds, and identifiers that share their contexts.

Bootstrapping: matches of the fixed kinds are the first believed instances. Lexical patterns are the two words before an
identifier, the two after it, and one on each side; words with digits count by their shape. Patterns and the instances (values) met in
them are a bipartite graph. In every round a pattern scores the share of its instances believed to be of a kind; it is accepted with MIN_SEEDS believed instances and a
score of ACCEPT. An instance that is no seed is believed as far as any of its accepted patterns is right (1 less the product of
their doubts), and so induces the patterns of the next round. It ends when a round adds none and
beliefs stand still (to STILL on average), or after ROUNDS. Identifiers in accepted patterns are added.
Patterns with fewer than MIN_SEEDS different instances can never be accepted and are left out first. Only rows of identifiers and
their contexts are shuffled.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tidewatch.llm.common import stored

KINDS = ["email", "ip", "card", "phone"]
# The kinds' expressions in a form that scans long runs once: possessive loops, and starts only where a run begins or a match ended.
EXPRESSIONS = [
    r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    r"[0-9]++(?:[\x20-][0-9]++)*+",
    r"\+[0-9][\x20().0-9-]+[0-9]",
]
IDENTIFIER = r"(?<![\p{L}\p{N}@._%+/:-])[\p{L}\p{N}@._%+/:-]*[0-9@][\p{L}\p{N}@._%+/:-]*"
MIN_SEEDS, ROUNDS, ACCEPT, STILL = 5, 16, 0.8, 1e-4
CONTEXT, GROUP = 60, 256          # characters looked at on each side of a match; matches whose lengths are summed together
SPAN = "array<struct<start:int,kind:int,end:int,value:string,before:string,after:string>>"


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(number: Column) -> Column:
    def add(total: Column, i: Column) -> Column:
        d = F.substring(F.reverse(number), i, F.lit(1)).cast("int")
        return total + F.when(i % 2 == 1, d).when(d > 4, d * 2 - 9).otherwise(d * 2)
    return F.aggregate(F.sequence(F.lit(1), F.char_length(number)), F.lit(0), add) % 10 == 0


def valid(kind: int, value: Column) -> Column:
    if kind == 1:
        return F.forall(F.split(value, r"\."), lambda p: F.coalesce(F.regexp_extract(p, "^0*([0-9]{1,3})$", 1).try_cast("int") <= 255, F.lit(False)))
    if kind == 2:
        return F.char_length(digits(value)).between(14, 19) & luhn(digits(value))
    if kind == 3:
        return F.char_length(digits(value)).between(10, 15)
    return F.lit(True)


def with_matches(df: DataFrame, text: str, name: str, expression: str, kind: int, sign: str | None = None) -> DataFrame:
    """Adds ``name``: all leftmost matches as spans in code points. Texts without ``sign`` can't match and aren't scanned.

    A split by the expression gives the pieces between the matches; starts are running sums of lengths, taken in groups so that
    many matches stay cheap.
    """
    found = F.regexp_extract_all(F.col(text), F.lit(expression), F.lit(0))
    none = F.array().cast("array<string>")
    df = df.withColumn("_hits", F.coalesce(found if sign is None else F.when(F.contains(F.col(text), F.lit(sign)), found), none))
    if kind == 2:                                              # single digits are never part of a longer match
        df = df.withColumn("_any", F.exists("_hits", lambda h: F.char_length(h) >= 14))
    else:
        df = df.withColumn("_any", F.size("_hits") > 0)
    df = df.withColumn("_pieces", F.when(F.col("_any"), F.split(F.col(text), expression, -1)))
    df = df.withColumn("_lengths", F.zip_with("_pieces", "_hits", lambda p, h: F.char_length(p) + F.coalesce(F.char_length(h), F.lit(0))))
    add = lambda total, x: total + x
    df = df.withColumn("_groups", F.transform(F.sequence(F.lit(0), F.floor(F.size("_hits") / GROUP).cast("int")), lambda g: F.aggregate(F.slice("_lengths", g * GROUP + 1, F.lit(GROUP)), F.lit(0), add)))

    def span(hit: Column, i: Column) -> Column:
        piece = F.element_at("_pieces", i + 1)
        group = F.floor(i / GROUP).cast("int")
        start = F.aggregate(F.slice("_groups", F.lit(1), group), F.lit(0), add) + F.aggregate(F.slice("_lengths", group * GROUP + 1, i % GROUP), F.lit(0), add) + F.char_length(piece)
        return F.struct(start.alias("start"), F.lit(kind).alias("kind"), (start + F.char_length(hit)).alias("end"), hit.alias("value"), F.right(piece, F.lit(CONTEXT)).alias("before"),
                        F.left(F.element_at("_pieces", i + 2), F.lit(CONTEXT)).alias("after"))

    spans = F.when(F.col("_any"), F.transform("_hits", span))
    if kind >= 0:
        spans = F.filter(spans, lambda s: valid(kind, s["value"]))
    return df.withColumn(name, F.coalesce(spans.cast(SPAN), F.array().cast(SPAN))).drop("_hits", "_any", "_pieces", "_lengths", "_groups")


def with_base(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds ``base``: the spans of the fixed kinds by start, then kind. A null text has none."""
    for kind, (name, expression, sign) in enumerate(zip(KINDS, EXPRESSIONS, ("@", ".", None, "+"))):
        df = with_matches(df, text, f"_{name}", expression, kind, sign)
    return df.withColumn("base", F.sort_array(F.concat(*[f"_{name}" for name in KINDS]))).drop(*[f"_{name}" for name in KINDS])


def contexts(before: Column, after: Column) -> Column:
    """The patterns of a match: lower-case words within CONTEXT characters and up to the next match of the same expression, digits as 0."""
    def words(side: Column, expression: str) -> Column:
        found = F.regexp_replace(F.regexp_replace(F.regexp_extract(F.lower(side), expression, 1), "[0-9]+", "0"), r"\s+", " ")
        return F.when(found != "", found)

    left, right = words(before, r"(?:^|\s)(\S+)\s*$"), words(after, r"^\s*(\S+)(?:\s|$)")
    return F.array_compact(F.array(F.concat(F.lit("before "), words(before, r"(?:^|\s)(\S+\s+\S+)\s*$")), F.concat(F.lit("after "), words(after, r"^\s*(\S+\s+\S+)(?:\s|$)")),
                                   F.concat(F.lit("between "), left, F.lit(" "), right)))


def occurrences(docs: DataFrame) -> DataFrame:
    """(row, doc_id, text_key, base, others): per document its base spans, and identifiers outside them; narrow and stored."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), F.xxhash64("text").alias("text_key"))
    rows = with_matches(with_base(rows), "text", "others", IDENTIFIER, -1)
    free = F.filter("others", lambda o: ~F.exists("base", lambda b: (b["start"] < o["end"]) & (o["start"] < b["end"])))
    return stored(rows.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text_key", "base", free.alias("others")))


def discovered(found: DataFrame) -> DataFrame:
    """(row, doc_id, text_key, start, kind, end) of identifiers that accepted patterns add."""
    met = found.select(F.explode(F.concat("base", "others")).alias("s")).select(F.sha2("s.value", 256).alias("instance"), F.explode(contexts(F.col("s.before"), F.col("s.after"))).alias("pattern")).distinct()
    frequent = met.groupBy("pattern").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= MIN_SEEDS)
    edges = stored(met.join(frequent, "pattern"))                                                   # one row a pattern and instance
    seeds = stored(found.select(F.explode("base").alias("s")).select(F.sha2("s.value", 256).alias("instance"), F.col("s.kind").alias("kind")).distinct().withColumn("belief", F.lit(1.0)))
    believed, size = seeds, (0, 0.0)
    for _ in range(ROUNDS):
        support = edges.join(believed, "instance").groupBy("pattern", "kind").agg(F.count(F.lit(1)).alias("believed"), F.sum("belief").alias("total"), F.first("n").alias("n"))
        strong = (F.col("believed") >= MIN_SEEDS) & (F.col("total") >= ACCEPT * (F.col("n") + 1))
        sure = stored(support.filter(strong).select("pattern", "kind", (F.col("total") / (F.col("n") + 1)).alias("strength")))
        if sure.isEmpty():
            break
        met_by = edges.join(sure, "pattern").groupBy("instance", "kind").agg((1 - F.product(1 - F.col("strength"))).alias("belief"))
        new = met_by.join(seeds.select("instance"), "instance", "left_anti")
        believed = stored(seeds.unionByName(new))
        before, size = size, believed.agg(F.count(F.lit(1)), F.coalesce(F.sum("belief"), F.lit(0.0))).first()
        if size[0] == before[0] and abs(size[1] - before[1]) <= STILL * size[0]:
            break
    open_ = found.select("row", "doc_id", "text_key", F.explode("others").alias("o")).select(
        "row", "doc_id", "text_key", "o.start", "o.end", F.col("o.value").alias("value"), F.sha2("o.value", 256).alias("instance"), F.explode(contexts(F.col("o.before"), F.col("o.after"))).alias("pattern"))
    shaped = (F.col("kind") == 0) | (F.char_length(digits(F.col("value"))) >= 4)
    taken = open_.join(sure, "pattern").join(believed.select("instance", "kind", "belief"), ["instance", "kind"]).filter(shaped)
    best = taken.groupBy("row", "doc_id", "text_key", "start", "end").agg(F.max_by("kind", F.struct("belief", "strength", -F.col("kind"))).alias("kind"))
    return best.select("row", "doc_id", "text_key", "start", "kind", "end")


def joined(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat(F.element_at(names, s["kind"] + 1), F.lit(":"), s["start"].cast("string"), F.lit(":"), s["end"].cast("string"))))


def places(spans: Column) -> Column:
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end")))


def find_spans(docs: DataFrame) -> DataFrame:
    """(doc_id, base, spans) of every document: spans as (start, kind, end) sorted by start, then kind; spans holds base and what
    the patterns add. Null texts have none; repeated documents each get a row; other columns are ignored."""
    found = occurrences(docs)
    added = discovered(found).groupBy("row").agg(F.collect_list(F.struct("start", "kind", "end")).alias("added"))
    rows = found.select("row", "doc_id", places(F.col("base")).alias("base")).join(added, "row", "left")
    return rows.select("doc_id", "base", F.sort_array(F.concat("base", F.coalesce("added", F.array().cast("array<struct<start:int,kind:int,end:int>>")))).alias("spans"))


def report(found: DataFrame) -> DataFrame:
    """The digest columns of the registered query."""
    def count(kind: int) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")

    counts = [count(k).alias(f"n_{name}") for k, name in enumerate(KINDS)]
    return found.select("doc_id", *counts, F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def redact(docs: DataFrame) -> DataFrame:
    """The documents with every span replaced by its kind in angle brackets (overlapping spans by the first's), all columns kept.

    n_chars, if there, follows the new text. Base spans are found where the text is read; only added spans are joined, by id and
    text hash, so without a large table of them the texts are not shuffled.
    """
    columns = docs.columns
    added = stored(discovered(occurrences(docs)).select("doc_id", "text_key", "start", "kind", "end").distinct().groupBy("doc_id", "text_key")
                   .agg(F.collect_list(F.struct("start", "kind", "end")).alias("_added")).select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key"), "_added"))
    packed = docs.select(F.struct(*columns).alias("_row"), F.col("doc_id").cast("long").alias("_doc"), F.coalesce("text", F.lit("")).alias("_text"), F.xxhash64("text").alias("_hash"))
    spans = with_base(packed, "_text").join(added, F.col("_doc").eqNullSafe(F.col("_id")) & (F.col("_hash") == F.col("_key")), "left")
    spans = spans.withColumn("_all", F.sort_array(F.concat(places(F.col("base")), F.coalesce("_added", F.array().cast("array<struct<start:int,kind:int,end:int>>")))))
    names = F.array(*map(F.lit, KINDS))
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))

    def step(state: Column, s: Column) -> Column:
        inside = s["start"] < state["at"]
        mark = F.concat(F.lit("<"), F.element_at(names, s["kind"] + 1), F.lit(">"))
        text = F.concat(state["out"], F.substring(F.col("_text"), state["at"] + 1, s["start"] - state["at"]), mark)
        return F.struct(F.when(inside, state["out"]).otherwise(text).alias("out"), F.greatest(state["at"], s["end"]).alias("at"))

    new = F.aggregate("_all", start, step, lambda s: F.concat(s["out"], F.substring(F.col("_text"), s["at"] + 1, F.char_length("_text"))))
    clean = F.when(F.col("_row.text").isNotNull(), F.when(F.size("_all") > 0, new).otherwise(F.col("_row.text")))
    done = spans.select("_row", clean.alias("_clean"))
    size = docs.schema["n_chars"].dataType if "n_chars" in columns else None
    return done.select(*[F.col("_clean").alias(c) if c == "text" else F.when(F.col("_clean").isNotNull(), F.char_length("_clean").cast(size)).otherwise(F.col("_row.n_chars")).alias(c) if c == "n_chars" else F.col(f"_row.`{c}`").alias(c) for c in columns])
