"""Near-duplicate detection by a chosen-path similarity join over minwise tokens.

Texts become sets of five-word shingles; documents with equal sets are one class. Each class has ``COORDINATES`` minwise
tokens. In each of ``TREES`` independent trees a node selects a few coordinates, 1 / similarity of them on average, and sends
its classes to one child per value of each selected token, so a pair at the threshold survives a level with one common child on
average. A node of at most ``SMALL`` classes is a leaf. A larger one is branched again, up to ``LEVELS`` levels in all; a pair at
the threshold is lost by one tree with probability 0.55 after three levels and by all with less than 1e-5.

Links are confirmed on full shingle sets in two steps, so that groups never turn into all their pairs:
1. every class against one pivot, of its nodes' smallest classes the one it shares most nodes with. Confirmed pairs merge labels.
2. classes tied by leaves (over pairs with similar signatures) or by nodes that stay large form families. A family's sets are
   brought together once, in blocks of about BLOCK classes; classes outside its largest label meet every block, so every pair of
   different labels is compared, and one row a joined label comes out.
"""
from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from tidewatch.llm.common import BASE, MASK, MAX_BROADCAST_IDS, Words, byte_table, mixed, sequence_hash, stored, text_batches, with_ids
from tidewatch.operators.cluster import connected_components

SHINGLE, SIMILARITY = 5, 0.75
COORDINATES, TREES, SMALL, LEVELS, SHARED, BLOCK = 64, 20, 64, 3, 8, 512
ESTIMATE = 0.5                # of the signatures; 4.6 standard deviations under the threshold
WORD_BYTES = byte_table(lambda b: b != 32 and not 9 <= b <= 13)
MULTIPLIERS = (mixed(np.arange(1, COORDINATES + 1, dtype=np.uint64) * np.uint64(BASE)) | np.uint64(1))


def shingle_sets(run: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, bounds): the sorted distinct shingle hashes of each text, joined."""
    words = Words(run, WORD_BYTES)
    grams = sequence_hash(words.hash, SHINGLE)
    sets = []
    for first, last in zip(words.bounds[:-1].tolist(), words.bounds[1:].tolist()):
        n = last - first
        if n >= SHINGLE:
            sets.append(np.unique(grams[first:last - SHINGLE + 1]))
        elif n:
            sets.append(mixed(sequence_hash(words.hash[first:last], n) + np.uint64(n)))
        else:
            sets.append(np.empty(0, dtype=np.uint64))
    bounds = np.concatenate(([0], np.cumsum([len(s) for s in sets])))
    return np.concatenate(sets) if sets else np.empty(0, dtype=np.uint64), bounds


def set_digest(hashes: np.ndarray) -> bytes:
    return hashlib.blake2b(hashes.tobytes(), digest_size=16).digest()


def stand_in(digest: bytes) -> int:
    """The number of a class whose documents all lack an id."""
    return int.from_bytes(digest[:8], "little", signed=True)


def signatures(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, class, number, tokens): class is a digest of the set, number what stands for an id that all of its documents
    lack, tokens the minwise values as 32-bit integers."""
    def scan(batches):
        for batch in batches:
            for first, run in text_batches(batch.column("text").to_pylist()):
                hashes, bounds = shingle_sets(run)
                full = np.flatnonzero(np.diff(bounds))
                minima = np.zeros((len(run), COORDINATES), dtype=np.uint32)
                for k in range(COORDINATES if len(full) else 0):
                    minima[full, k] = np.minimum.reduceat(hashes * MULTIPLIERS[k], bounds[full]) >> np.uint64(32)
                digests = [set_digest(hashes[a:b]) for a, b in zip(bounds[:-1], bounds[1:])]
                yield pa.RecordBatch.from_arrays([
                    batch.column("doc_id").slice(first, len(run)), pa.array(np.diff(bounds), pa.int64()), pa.array(digests, pa.binary()),
                    pa.array([stand_in(d) for d in digests], pa.int64()), pa.array([row.tobytes() for row in minima], pa.binary())], ["doc_id", "n_shingles", "class", "number", "tokens"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(scan, "doc_id long, n_shingles long, class binary, number long, tokens binary")


def chosen(node: np.ndarray, level: int) -> list[np.ndarray]:
    """Per coordinate whether a node selects it: 1 / SIMILARITY of them on average, and at least one at a root."""
    share = np.uint64(int((1 << 64) / (SIMILARITY * COORDINATES)))
    draws = np.stack([mixed(node + np.uint64((k + 1) * BASE & MASK)) for k in range(COORDINATES)])
    picked = draws < share
    if level == 0:
        picked[draws.argmin(axis=0), np.arange(len(node))] = True
    return list(picked)


def children(rows: DataFrame, level: int) -> DataFrame:
    """(node, id) rows of the next level from (node, id, tokens) rows; at level 0 the nodes are the roots of the trees."""
    def scan(batches):
        for batch in batches:
            n = batch.num_rows
            ids, tokens = batch.column("id"), np.frombuffer(b"".join(batch.column("tokens").to_pylist()), dtype=np.uint32).reshape(n, COORDINATES)
            if level:
                starts = [batch.column("node").to_numpy(zero_copy_only=False).view(np.uint64)]
            else:
                starts = [np.full(n, (t + 1) * BASE & MASK, dtype=np.uint64) for t in range(TREES)]
            for node in starts:
                if level == 0:
                    marks = [np.full(n, bool(m[0])) for m in chosen(node[:1], 0)]
                else:
                    marks = chosen(node, level)
                for k, mark in enumerate(marks):
                    at = np.flatnonzero(mark)
                    if len(at):
                        child = mixed(mixed(node[at] + np.uint64(k + 1)) ^ (tokens[at, k].astype(np.uint64) * np.uint64(BASE)))
                        yield pa.RecordBatch.from_arrays([pa.array(child.view(np.int64)), ids.take(pa.array(at))], ["node", "id"])

    return rows.mapInArrow(scan, "node long, id long")


def confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs (a, b) whose full sets, from (id, set), reach the similarity."""
    def compare(batches):
        for batch in batches:
            keep = [linked(np.frombuffer(x, dtype=np.uint64), np.frombuffer(y, dtype=np.uint64)) for x, y in zip(batch.column("sa").to_pylist(), batch.column("sb").to_pylist())]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    both = pairs.join(sets.select(F.col("id").alias("a"), F.col("set").alias("sa")), "a").join(sets.select(F.col("id").alias("b"), F.col("set").alias("sb")), "b")
    return both.select("a", "b", "sa", "sb").mapInArrow(compare, "a long, b long")


def token_matrix(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint32).reshape(-1, COORDINATES)


def leaf_ties(rows: DataFrame) -> DataFrame:
    """(a, b) ties inside leaves, from (node, id, tokens) rows: every class of a leaf with the first one that it reaches over pairs
    with similar signatures. All pairs of a leaf are compared, but a leaf gives less ties than it has classes."""
    def emit(table):
        node, ids, tokens = table.column("node").to_numpy(), table.column("id").to_numpy(), token_matrix(table.column("tokens"))
        bounds = np.concatenate(([0], np.flatnonzero(np.diff(node)) + 1, [len(node)]))
        out_a, out_b = [], []
        for first, last in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
            part = tokens[first:last]
            near = (part[:, None, :] == part[None, :, :]).mean(axis=2) >= ESTIMATE
            reach = np.arange(last - first)
            while True:                                          # at most SMALL classes: a few rounds
                new = np.where(near, reach[None, :], last - first).min(axis=1)
                if (new == reach).all():
                    break
                reach = new
            at = np.flatnonzero(reach != np.arange(last - first))
            out_a.append(ids[first + reach[at]])
            out_b.append(ids[first + at])
        a, b = np.concatenate(out_a), np.concatenate(out_b)
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    def scan(batches):
        held = None
        for batch in batches:
            table = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
            node = table.column("node").to_numpy()
            cut = int(np.searchsorted(node, node[-1])) if len(node) else 0      # the last leaf may go on
            if cut:
                yield emit(table.slice(0, cut))
            held = table.slice(cut)
        if held is not None and held.num_rows:
            yield emit(held)

    return rows.repartition("node").sortWithinPartitions("node", "id").mapInArrow(scan, "a long, b long").distinct()


def shingles_of(docs: DataFrame, wanted: DataFrame, nameless: bool = False) -> DataFrame:
    """(id, set) of the documents with a wanted id, and of one document of each wanted class without any; stored."""
    def sets(batches):
        for batch in batches:
            for first, run in text_batches(batch.column("text").to_pylist()):
                hashes, bounds = shingle_sets(run)
                found = [hashes[a:b] for a, b in zip(bounds[:-1], bounds[1:])]
                ids = [stand_in(set_digest(x)) if i is None else i for i, x in zip(batch.column("id").slice(first, len(run)).to_pylist(), found)]
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([x.tobytes() for x in found], pa.binary())], ["id", "set"])

    texts = docs.select(F.col("doc_id").cast("long").alias("id"), "text")
    rows = with_ids(texts, wanted, "id").mapInArrow(sets, "id long, set binary")
    if nameless:
        rows = rows.unionByName(with_ids(texts.filter("id is null").mapInArrow(sets, "id long, set binary"), wanted, "id").dropDuplicates(["id"]))
    return stored(rows)


def linked(left: np.ndarray, right: np.ndarray) -> bool:
    both = len(np.intersect1d(left, right, assume_unique=True))
    return 100 * both >= 100 * SIMILARITY * (len(left) + len(right) - both)


def family_links(rows: DataFrame) -> DataFrame:
    """Links (a, b) that join different labels of a family, from (place, id, label, home, tokens, set) rows.

    The about BLOCK home rows of a place are held and all its rows pass by them. Pairs of one label, or of labels that a link of
    this place has joined, are skipped; signatures select what is compared on full sets.
    """
    def scan(batches):
        place, ids, labels, sets, tokens, joined = None, [], [], [], np.empty((0, COORDINATES), dtype=np.uint32), {}

        def root(label):
            while joined.get(label, label) != label:
                label = joined[label]
            return label

        for batch in batches:
            out_a, out_b = [], []
            for row, own in zip(batch.to_pylist(), token_matrix(batch.column("tokens"))):
                if row["place"] != place:
                    place, ids, labels, sets, tokens, joined = row["place"], [], [], [], np.empty((BLOCK, COORDINATES), dtype=np.uint32), {}
                mine, n = np.frombuffer(row["set"], dtype=np.uint64), len(ids)
                near = np.flatnonzero((tokens[:n] == own).mean(axis=1) >= ESTIMATE) if n else ()
                for k in near:
                    if root(labels[k]) != root(row["label"]) and linked(mine, sets[k]):
                        joined[root(labels[k])] = root(row["label"])
                        out_a.append(min(ids[k], row["id"]))
                        out_b.append(max(ids[k], row["id"]))
                if row["home"]:
                    if n == len(tokens):
                        tokens = np.concatenate([tokens, np.empty_like(tokens)])
                    tokens[n] = own
                    ids.append(row["id"])
                    labels.append(row["label"])
                    sets.append(mine)
            yield pa.RecordBatch.from_arrays([pa.array(out_a, pa.int64()), pa.array(out_b, pa.int64())], ["a", "b"])

    return rows.repartition("place").sortWithinPartitions("place", F.desc("home"), "id").mapInArrow(scan, "a long, b long").distinct()


def mixed_members(members: DataFrame, label: DataFrame) -> DataFrame:
    """(node, id, size, label) of the nodes that still hold more than one label; a class without a row in ``label`` is its own."""
    labelled = members.join(label, "id", "left").select("node", "id", "size", F.coalesce("label", "id").alias("label"))
    several = labelled.groupBy("node").agg(F.min("label").alias("low"), F.max("label").alias("high")).filter("low <> high").select("node")
    return stored(labelled.join(several, "node", "left_semi"))


def tree_nodes(classes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(node, id, size) of the leaves, and of all root nodes of classes that can have a link.

    A linked pair shares about 19 of the roughly 25 tokens that the roots select; a class that shares fewer than SHARED with
    anything has no link.
    """
    def shared(rows: DataFrame) -> DataFrame:
        return rows.join(rows.groupBy("node").agg(F.count(F.lit(1)).alias("size")).filter("size > 1"), "node")

    first = stored(shared(stored(children(classes, 0))).drop("size"))
    active = first.groupBy("id").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= SHARED).select("id")
    roots = members = stored(shared(stored(first.join(active, "id", "left_semi"))))
    leaves = None
    for level in range(1, LEVELS + 1):
        large = members.filter(F.col("size") > SMALL)
        last = level == LEVELS or large.isEmpty()
        done = members if last else members.filter(F.col("size") <= SMALL)
        leaves = done if leaves is None else leaves.unionByName(done)
        if last:
            return leaves, roots
        members = stored(shared(stored(children(large.select("node", "id").join(classes, "id").select("node", "id", "tokens"), level))))
    return leaves, roots


def star_pairs(roots: DataFrame) -> DataFrame:
    """(a, b): each class with the pivot, the smallest class of a node, that it shares most nodes with."""
    pivots = roots.groupBy("node").agg(F.min("id").alias("pivot"))
    met = roots.join(pivots, "node").filter("id <> pivot").groupBy("id", "pivot").agg(F.count(F.lit(1)).alias("n")).filter("n > 2")
    return met.groupBy("id").agg(F.max_by("pivot", F.struct("n", F.xxhash64("pivot"))).alias("pivot")).select(F.least("id", "pivot").alias("a"), F.greatest("id", "pivot").alias("b")).distinct()


def hooked(label: DataFrame, found: DataFrame) -> DataFrame:
    """Labels after confirmed pairs: each label takes the smallest that a pair ties it to, followed twice. No loop is needed here,
    as equal labels need only mean one component; the components themselves are walked once, over all links, at the end."""
    ends = found
    for side in ("a", "b"):
        ends = ends.join(label.select(F.col("id").alias(side), "label"), side, "left").withColumn(side, F.coalesce("label", side)).drop("label")
    ties = ends.filter("a <> b").select(F.greatest("a", "b").alias("low"), F.least("a", "b").alias("up"))
    up = stored(ties.groupBy("low").agg(F.min("up").alias("up")))
    for _ in range(2):
        up = up.join(up.select(F.col("low").alias("up"), F.col("up").alias("further")), "up", "left").select("low", F.coalesce("further", "up").alias("up"))
    moved = label.join(up, F.col("label") == F.col("low"), "left").select("id", F.coalesce("up", "label").alias("label"))
    return stored(moved.unionByName(up.select(F.col("low").alias("id"), F.col("up").alias("label"))).groupBy("id").agg(F.min("label").alias("label")))


def class_links(classes: DataFrame, docs: DataFrame, nameless: bool = False) -> DataFrame:
    """(id, label): for each linked class the smallest class it reaches; classes are (id, tokens). ``nameless`` says whether some have
    no document with an id."""
    leaves, roots = tree_nodes(classes)
    sets = shingles_of(docs, stored(roots.select("id").distinct()), nameless)        # once, of the classes that can have a link
    first = stored(confirmed(stored(star_pairs(roots)), sets))
    label = hooked(classes.select("id", F.col("id").alias("label")).limit(0), first)
    rows = mixed_members(leaves, label)
    ties = leaf_ties(rows.filter(F.col("size") <= SMALL).join(classes, "id").select("node", "id", "tokens"))
    dense = rows.filter(F.col("size") > SMALL).select("node", "id")
    ties = ties.unionByName(dense.join(dense.groupBy("node").agg(F.min("id").alias("a")), "node").filter("a <> id").select("a", F.col("id").alias("b")).distinct())
    family = stored(connected_components(ties).select(F.col("node").alias("id"), F.col("label").alias("family")).join(label, "id", "left").withColumn("label", F.coalesce("label", "id")))
    several = family.groupBy("family").agg(F.count(F.lit(1)).alias("size"), F.min("label").alias("low"), F.max("label").alias("high")).filter("low <> high").select("family", "size")
    largest = family.groupBy("family", "label").agg(F.count(F.lit(1)).alias("n")).groupBy("family").agg(F.max_by("label", F.struct("n", "label")).alias("main"))
    n_blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    # Rows of the family's largest label stay in their own block, the others meet every block: all pairs of different labels meet.
    blocks = F.when(F.col("label") != F.col("main"), F.sequence(F.lit(0), n_blocks - 1)).otherwise(F.array(F.col("own")))
    placed = (family.join(several, "family").join(largest, "family").withColumn("own", F.pmod(F.xxhash64("id"), n_blocks).cast("int")).withColumn("block", F.explode(blocks))
              .select(F.xxhash64("family", "block").alias("place"), "id", "label", (F.col("own") == F.col("block")).alias("home")))
    placed = stored(placed)
    second = family_links(placed.join(classes, "id").join(sets, "id").select("place", "id", "label", "home", "tokens", "set"))
    return connected_components(first.unionByName(second)).select(F.col("node").alias("id"), "label")


def memberships(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, class, component_id, stands) for every document.

    ``stands`` marks the rows that may stand for their component: those with its id, in a component without ids those of its smallest
    class, and every row without shingles.
    """
    signed = stored(signatures(docs))
    full = signed.filter("n_shingles > 0")
    classes = full.groupBy("class").agg(F.min("doc_id").alias("least_id"), F.first("number").alias("number"), F.first("tokens").alias("tokens"))
    classes = stored(classes.withColumn("id", F.coalesce("least_id", "number")))
    nameless = not classes.filter("least_id is null").isEmpty()
    roots = classes.select("class", "id", "least_id").join(class_links(classes.select("id", "tokens"), docs, nameless), "id", "left").withColumn("label", F.coalesce("label", "id"))
    if nameless:                                 # numbers of classes without an id name no component
        roots = stored(roots)
        names = roots.groupBy("label").agg(F.min("least_id").alias("component_id"))
        roots = roots.join(names, "label").select("class", "component_id", (F.col("component_id").isNull() & (F.col("id") == F.col("label"))).alias("first"))
    else:
        roots = roots.select("class", F.col("label").alias("component_id"), F.lit(False).alias("first"))
    own = ["doc_id", "n_shingles", "class"]
    rows = full.select(*own).join(roots, "class", "left").select(*own, "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("first")).alias("stands"))
    return rows.unionByName(signed.filter("n_shingles = 0").select(*own, F.col("doc_id").alias("component_id"), F.lit(True).alias("stands")))


def components(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every document.

    component_id is the smallest doc_id reachable over links, also over documents without an id; it is null if none has one. Null
    and empty texts have no shingles and are linked with nothing: their own id is the component. Documents that repeat an id and
    text are copies of one another and all kept; one without id is not. Extra columns are ignored.
    """
    return memberships(docs).select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)).alias("kept"))


def with_class(docs: DataFrame, name: str) -> DataFrame:
    """Adds the digest of the text's set."""
    def scan(batches):
        for batch in batches:
            for first, run in text_batches(batch.column("text").to_pylist()):
                hashes, bounds = shingle_sets(run)
                yield pa.RecordBatch.from_arrays([*batch.slice(first, len(run)).columns, pa.array([set_digest(hashes[a:b]) for a, b in zip(bounds[:-1], bounds[1:])], pa.binary())], [*batch.schema.names, name])

    return docs.mapInArrow(scan, StructType([*docs.schema.fields, StructField(name, BinaryType())]))


def keep_one(docs: DataFrame) -> DataFrame:
    """One document of each component, all columns kept: the one whose id names it; where several rows have that id and one set, or
    where no row has an id, one of them. Texts without words are no copies of one another: one row an id stays, and all without id.

    Ids that stand once (all, as a rule) are selected without moving a text; only the rows of other ids, and those without one, are
    dealt by id and set to pick one.
    """
    standing = memberships(docs).filter("stands").select("doc_id", "class")
    counts = stored(standing.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")))
    kept = with_ids(docs, counts.filter("n = 1 and doc_id is not null").select("doc_id"), "doc_id").select(*docs.columns)
    several = counts.filter("n > 1 or doc_id is null").select(F.col("doc_id").alias("_id"))
    n = several.count()
    if not n:
        return kept
    key = next(f"_set{k}" for k in range(len(docs.columns) + 1) if f"_set{k}" not in docs.columns)
    same = F.col("r.doc_id").eqNullSafe(F.col("s._id"))
    again = with_class(docs.alias("r").join((F.broadcast(several) if n <= MAX_BROADCAST_IDS else several).alias("s"), same, "left_semi"), key)
    chosen = stored(standing.select(F.col("doc_id").alias("_id"), F.col("class").alias("_class")).distinct())
    loose = F.col("doc_id").isNull() & (F.col(key) == F.lit(set_digest(np.empty(0, dtype=np.uint64))))
    picked = again.filter(~loose).dropDuplicates(["doc_id", key]).alias("r").join(chosen.alias("s"), same & (F.col(f"r.{key}") == F.col("s._class")), "left_semi")
    return kept.unionByName(picked.select(*docs.columns)).unionByName(again.filter(loose).select(*docs.columns))
