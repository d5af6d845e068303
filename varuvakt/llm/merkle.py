"""Merkle manifest of a dataset with sixteen-way trees that keep only every second level.

Every row is a leaf: the SHA-256 of its fields, each written as ``-`` if null, else as its UTF-8 byte count, a colon and the
value. Each source has a tree over its leaves by ascending doc_id; the roots of these trees, by source, are the leaves of one more
tree. While several nodes remain, every sixteen consecutive ones become the hash of their concatenated digests.

Checkpoint and recompute: of a tree only the levels 0, KEEP_EVERY, 2 KEEP_EVERY, ... and the root are stored. A proof is taken from the
top down. For each stored level its aligned subtrees (the nodes below one node of the next stored level, at most FANOUT ** KEEP_EVERY
of them) are gathered, the missing levels inside are hashed anew, the siblings on the way to the subtree's top are emitted before
those already known above it, and the hashed levels are dropped.

At scale: leaves get their places by a range shuffle of digests and counts per range, so a source with a third of all rows is numbered by
many tasks; texts are hashed in the scan and never shuffled. A subtree is the largest group there is.

Cases: rows without doc_id are leaves before all others of their source, rows without source form a tree of their own, which comes
first; rows of one source and doc_id are ordered by their digests, so repeated rows are leaves one by one and their order
does not matter. Texts of any length are hashed whole. An empty table gives no rows. Other columns than the five fields are left behind;
a field that the table lacks counts as null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from varuvakt.llm.common import ascii_lower, columns_of, stored

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
FANOUT = 16
KEEP_EVERY = 2
#: Rows whose id's CRC-32 it divides are altered by ``audit``.
ALTERED_EVERY = 5

PATH = "array<struct<before:string,after:string>>"


def digest(fields: list[Column]) -> Column:
    """H of a row; the fields are strings."""
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(f).cast("string"), F.lit(":"), f), F.lit("-")) for f in fields]), 256)


def leaves(docs: DataFrame) -> DataFrame:
    """tree (key of the source, in the order of sources), source, doc_id, node (the row's digest), changed: that of the altered row, if it is altered."""
    have = {c.lower() for c in docs.columns}
    own = {f: columns_of([f])[0] if f in have else F.lit(None) for f in FIELDS}
    types = {f: "long" if f in ("doc_id", "n_chars") else "string" for f in FIELDS}
    rows = docs.select(*[own[f].cast(types[f]).alias(f) for f in FIELDS])
    as_text = {f: F.col(f).cast("string") for f in FIELDS}
    altered = F.crc32(as_text["doc_id"].cast("binary")) % ALTERED_EVERY == 0
    return rows.select(
        F.coalesce(F.concat(F.lit("1"), "source"), F.lit("0")).alias("tree"),
        "source",
        "doc_id",
        digest(list(as_text.values())).alias("node"),
        F.when(altered, digest([*list(as_text.values())[:-1], ascii_lower(F.col("text"))])).alias("changed"),
    )


def placed(rows: DataFrame, *order: str) -> DataFrame:
    """Rows with ``pos``, their place from 0 in their ``tree`` by the columns ``order``, and ``m``, the number of rows of that tree."""
    salted = rows.withColumn("salt", F.monotonically_increasing_id())  # splits a range of equal rows
    keys = ["tree", *order, "salt"]
    ranged = salted.repartitionByRange(*keys).sortWithinPartitions(*keys).drop("salt")
    # The id holds the number of the range and, in its low 33 bits, the place inside.
    ranged = stored(ranged.withColumn("at", F.monotonically_increasing_id()), "merkle-ranges").withColumn("part", F.shiftright("at", 33))
    sizes = ranged.groupBy("tree", "part").agg(F.count("*").alias("size"), F.min("at").alias("first"))
    whole = Window.partitionBy("tree")
    before = whole.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    shifts = sizes.select("tree", "part", (F.coalesce(F.sum("size").over(before), F.lit(0)) - F.col("first")).alias("shift"), F.sum("size").over(whole).alias("m"))
    return ranged.join(shifts, ["tree", "part"]).withColumn("pos", F.col("at") + F.col("shift")).drop("at", "part", "shift")


def hashed(nodes: Column) -> Column:
    """Digests of the next level of consecutive nodes, the first of which begins a run."""
    runs = F.sequence(F.lit(0), F.ceil(F.size(nodes) / FANOUT).cast("int") - 1)
    return F.transform(runs, lambda r: F.sha2(F.concat_ws("", F.slice(nodes, r * FANOUT + 1, FANOUT)), 256))


def subtrees(level: DataFrame) -> DataFrame:
    """tree, block, m, members (the nodes of an aligned subtree in order, with doc_id and changed), levels: nodes of each level inside."""
    members = F.sort_array(F.collect_list(F.struct("pos", "node", "doc_id", "changed")))
    wide = level.where("m > 1").groupBy("tree", F.floor(F.col("pos") / FANOUT**KEEP_EVERY).cast("long").alias("block"), "m").agg(members.alias("members"))
    inner = wide.withColumn("l0", F.col("members.node"))
    for k in range(1, KEEP_EVERY):
        inner = inner.withColumn(f"l{k}", F.when(F.col("m") > FANOUT**k, hashed(F.col(f"l{k - 1}"))))
    return inner


def checkpoints(base: DataFrame) -> list[DataFrame]:
    """Stored levels 0, KEEP_EVERY, ... of all trees: tree, pos, m (nodes of the tree in this level), node. A tree ends with m = 1."""
    levels = [stored(base, "merkle-level")]
    most = levels[0].agg(F.max("m")).first()[0] or 0
    while most > 1:
        top = F.coalesce(*[hashed(F.col(f"l{k}")) for k in reversed(range(KEEP_EVERY))])
        left = F.ceil(F.col("m") / FANOUT**KEEP_EVERY).cast("long")
        up = subtrees(levels[-1]).select("tree", F.col("block").alias("pos"), left.alias("m"), F.element_at(top, 1).alias("node"))
        empty = [F.lit(None).cast(t).alias(c) for c, t in (("doc_id", "long"), ("changed", "string"))]
        levels.append(stored(up.select("*", *empty), "merkle-level"))
        most = -(-most // FANOUT**KEEP_EVERY)
    return levels


def roots(levels: list[DataFrame]) -> DataFrame:
    """tree, node of every tree's root."""
    tops = [level.where("m = 1").select("tree", "node") for level in levels]
    out = tops[0]
    for top in tops[1:]:
        out = out.union(top)
    return out


def proofs(levels: list[DataFrame], tops: DataFrame) -> DataFrame:
    """Each leaf with ``path``: the digests before and after it in its run, then those of its run's node, up to the root and on by its tree's ``path`` in ``tops``.

    Columns: tree, pos, node, doc_id, changed, path. Level by level from the top; what a subtree hashes anew is not kept.
    """
    found = None
    for level in reversed(levels):
        # A tree whose root lies in this level enters with the path above it.
        own = level.where("m = 1").join(tops, "tree").select("tree", "pos", "node", "doc_id", "changed", "path")
        if found is not None:
            above = found.select("tree", F.col("pos").alias("block"), F.col("path").alias("above"))
            wide = subtrees(level).join(above, ["tree", "block"])
            steps = [_siblings(f"l{k}", FANOUT**k) for k in range(KEEP_EVERY)]
            path = lambda i: F.concat(F.filter(F.array(*[s(i) for s in steps]), lambda s: s.isNotNull()), F.col("above"))
            each = F.explode(F.transform("members", lambda x, i: F.struct(x.alias("x"), path(i).alias("path"))))
            own = own.union(wide.select("tree", each.alias("each")).select("tree", "each.x.*", "each.path"))
        found = own if level is levels[0] else stored(own, "merkle-paths")
    return found


def _siblings(column: str, width: int):
    """For the place of a member in its subtree: digests before and after the node above it in the level ``column``; null where the tree has no such level."""
    nodes = F.col(column)

    def of(i: Column) -> Column:
        at = F.floor(i / width).cast("int")
        start = at - at % FANOUT
        before = F.concat_ws("", F.slice(nodes, start + 1, at - start))
        after = F.concat_ws("", F.slice(nodes, at + 2, start + FANOUT - 1 - at))
        return F.when(nodes.isNotNull(), F.struct(before.alias("before"), after.alias("after")))

    return of


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its path give."""
    return F.aggregate(path, leaf, lambda node, s: F.sha2(F.concat(s["before"], node, s["after"]), 256))


def manifest(docs: DataFrame) -> tuple[list[DataFrame], DataFrame, str | None]:
    """Stored levels of the trees of all sources; tree, subroot and path of each source; the root (None without rows)."""
    levels = checkpoints(placed(leaves(docs), "doc_id", "node").select("tree", "pos", "m", "node", "doc_id", "changed"))
    members = roots(levels).select(F.lit("").alias("tree"), F.col("tree").alias("member"), "node")
    listed = stored(placed(members, "member"), "merkle-members")
    over = checkpoints(listed.select("tree", "pos", "m", "node", F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("string").alias("changed")))
    top = roots(over).first()
    start = docs.sparkSession.createDataFrame([("", [])], f"tree string, path {PATH}")
    paths = proofs(over, start).join(listed.select("pos", "member"), "pos")
    subroots = stored(paths.select(F.col("member").alias("tree"), F.col("node").alias("subroot"), "path"), "merkle-subroots")
    return levels, subroots, top and top["node"]


def audit(docs: DataFrame) -> DataFrame:
    """Every row's leaf and proof in the untouched table, and the check of the row, altered where ``leaves`` says so, against the root.

    Columns: doc_id, leaf, subroot, root, path, folded_root (from the altered leaf, if there is one), verified.
    """
    levels, subroots, root = manifest(docs)
    found = proofs(levels, subroots.select("tree", "path"))
    checked = found.join(subroots.select("tree", "subroot"), "tree").withColumn("folded_root", folded(F.coalesce("changed", "node"), F.col("path")))
    return checked.select("doc_id", F.col("node").alias("leaf"), "subroot", F.lit(root).cast("string").alias("root"), "path", "folded_root", (F.col("folded_root") == F.lit(root)).alias("verified"))


def digests(docs: DataFrame) -> DataFrame:
    """``audit`` with the SHA-256 of each path's siblings, joined from left to right and bottom to top, in place of the path."""
    rows = audit(docs)
    joined = F.sha2(F.concat_ws("", F.transform("path", lambda s: F.concat(s["before"], s["after"]))), 256)
    return rows.select("doc_id", "leaf", "subroot", "root", joined.alias("proof_sha256"), "folded_root", "verified")
