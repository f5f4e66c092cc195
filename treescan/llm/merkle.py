"""Merkle dataset manifest with proofs by pointer jumping.

A leaf is the SHA-256 of a row's fields. The leaves of a group (a value of one column, null among them) are numbered by
id, and every 8 consecutive nodes become the hash of their hex texts, until one node, the subroot, remains; the subroots,
ordered by group (null first, then bytewise), become the root in the same way. Proofs: each node holds the segment of
siblings on the step to its parent and points at the parent. A self-join then gives each node the segment of the node it
points at, concatenated to its own, and that node's pointer, so the distance covered doubles in each round until every
leaf reaches the root. A round needs only the leaves and what they can point at: at distance d that is an 8^d-th of the
nodes, so these are broadcast once they are provably small, and joined by a shuffle before.

Digests are kept as 32 bytes and hashed as hex text. Numbers come from counts of range partitions. Rows equal in all
fields are counted in as many places as there are input partitions before they are numbered, so a row repeated over a
third of the input is not numbered by one task; which of equal rows gets which place makes no difference but to its
siblings. Null fields are `-`; rows without id come first in their group; rows that repeat an id are ordered by leaf. A
single leaf is its group's subroot, a single subroot is the root; without siblings a proof is the hash of nothing. An
empty table has no root and no proofs.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from treescan.llm.common import materialize

FAN = 8
#: Name of the tree of subroots; groups are named `=<value>`, and `-` for null, which sorts as they are ordered.
TOP = ""
#: Level of a subroot, whatever the height of its tree.
SUBROOT = -1
#: Nodes to point at of at most so many bytes together are broadcast.
BROADCAST = 8 << 20


def field(value: Column) -> Column:
    """A field as it goes into a leaf: the bytes of its text, a colon and the text; `-` for null."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_of(*values: Column) -> Column:
    """Hex SHA-256 of the fields."""
    return F.sha2(F.concat(*map(field, values)).cast("binary"), 256)


def hexed(digest: Column) -> Column:
    return F.lower(F.hex(digest))


def _numbered(rows: DataFrame) -> DataFrame:
    """rows (tree, id, hash, told, copies, salt) with at, from 0 in each tree, and size of the tree; a row for each copy."""
    order = ["tree", "id", "hash", "salt"]
    parts = materialize(rows.repartitionByRange(*order).withColumn("part", F.spark_partition_id()), "leaf_ranges")
    counts = parts.groupBy("tree", "part").agg(F.sum("copies").alias("n"))
    of_tree = Window.partitionBy("tree")
    earlier = Window.unboundedPreceding, -1
    before = counts.select("tree", "part", F.coalesce(F.sum("n").over(of_tree.orderBy("part").rowsBetween(*earlier)), F.lit(0)).alias("before"), F.sum("n").over(of_tree).alias("size"))
    own = F.coalesce(F.sum("copies").over(Window.partitionBy("tree", "part").orderBy(*order).rowsBetween(*earlier)), F.lit(0))
    placed = parts.withColumn("own", own).join(before, ["tree", "part"]).withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)))
    return placed.select("tree", (F.col("before") + F.col("own") + F.col("copy")).alias("at"), "size", "hash", "id", "told")


def _height(size: int) -> int:
    h = 0
    while size > 1:
        size, h = -(-size // FAN), h + 1
    return h


def _grown(leaves: DataFrame, height: int) -> tuple[list[DataFrame], DataFrame]:
    """The runs of each level (tree, at of the parent, size of the parent's level, kids, hash of the parent), and all
    nodes that remain alone: tree, hash."""
    nodes, levels = leaves, []
    alone = [leaves.where("size = 1").select("tree", "hash")]
    for _ in range(height):
        kids = F.array_sort(F.collect_list(F.struct("at", "hash", "id", "told")))
        runs = nodes.where("size > 1").groupBy("tree", F.expr(f"at div {FAN}").alias("run"), F.expr(f"(size + {FAN - 1}) div {FAN}").alias("parents")).agg(kids.alias("kids"))
        text = F.array_join(F.transform("kids", lambda k: hexed(k["hash"])), "")
        runs = materialize(runs.withColumn("hash", F.unhex(F.sha2(text.cast("binary"), 256))), "merkle_runs")
        levels.append(runs)
        nodes = runs.select("tree", F.col("run").alias("at"), F.col("parents").alias("size"), "hash", F.lit(None).cast(leaves.schema["id"].dataType).alias("id"), F.lit(None).cast("binary").alias("told"))
        alone.append(nodes.where("size = 1").select("tree", "hash"))
    return levels, reduce(DataFrame.union, alone)


def _key(tree: Column, level: Column, at: Column) -> Column:
    return F.struct(tree.alias("tree"), level.cast("int").alias("level"), at.cast("long").alias("at"))


def _steps(runs: DataFrame, level: int) -> DataFrame:
    """Kids of runs as nodes: their place, whom they point at, and the segment of siblings of that step."""
    joined = lambda kept: F.aggregate(kept, F.unhex(F.lit("")), lambda a, k: F.concat(a, k["hash"]))
    left = joined(F.filter("kids", lambda k: k["at"] < F.col("kid.at")))
    right = joined(F.filter("kids", lambda k: k["at"] > F.col("kid.at")))
    up = F.when((F.col("parents") == 1) & (F.col("tree") != TOP), _key(F.col("tree"), F.lit(SUBROOT), F.lit(0))).otherwise(_key(F.col("tree"), F.lit(level + 1), F.col("run")))
    # the lowest nodes of the top tree are the subroots of groups
    own = F.when((F.col("tree") == TOP) & F.lit(level == 0), _key(F.col("kid.id").cast("string"), F.lit(SUBROOT), F.lit(0))).otherwise(_key(F.col("tree"), F.lit(level), F.col("kid.at")))
    return runs.select("*", F.explode("kids").alias("kid")).select(own.alias("node"), up.alias("jump"), F.array(F.struct(left.alias("left"), right.alias("right"))).alias("segment"), "kid.id", F.col("kid.hash").alias("leaf"), "kid.told")


def proofs(docs: DataFrame, fields: list[str], *, id_col: str = "doc_id", by: str = "lang", told: dict[str, Column] | None = None) -> DataFrame:
    """One row for each row of docs: id, leaf, told, subroot, root (hex digests), steps.

    fields: columns that make up a leaf. told: for some fields what somebody else gives for them, to be held against the
    manifest; its leaf is the column told. steps: from the leaf to the root, the siblings left and right of the node,
    each the concatenated bytes of their digests.
    """
    said = told or {}
    hash_of = lambda values: F.unhex(leaf_of(*values))
    rows = docs.select(
        F.coalesce(F.concat(F.lit("="), F.col(by).cast("string")), F.lit("-")).alias("tree"),
        F.col(id_col).alias("id"),
        hash_of([F.col(f) for f in fields]).alias("hash"),
        hash_of([said.get(f, F.col(f)) for f in fields]).alias("told"),
        F.pmod(F.spark_partition_id(), F.lit(4096)).alias("salt"),
    )
    rows = rows.groupBy("tree", "id", "hash", "told", "salt").agg(F.count("*").alias("copies"))
    leaves = materialize(_numbered(rows), "leaves")
    sizes = leaves.groupBy("tree").agg(F.count("*").alias("n"))
    total, trees, largest = sizes.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*"), F.coalesce(F.max("n"), F.lit(0))).first()
    height, top_height = _height(largest), _height(trees)

    levels, alone = _grown(leaves, height)
    subroots = materialize(alone, "subroots")
    none = F.lit(None).cast("binary").alias("told")
    top_leaves = materialize(_numbered(subroots.select(F.lit(TOP).alias("tree"), F.col("tree").alias("id"), "hash", none, F.lit(1).cast("long").alias("copies"), F.lit(0).alias("salt"))), "top_leaves")
    top_levels, tops = _grown(top_leaves, top_height)
    root = tops.first()
    root = None if root is None else bytes(root["hash"]).hex()

    no_id = F.lit(None).cast(docs.schema[id_col].dataType).alias("id")
    single = leaves.where("size = 1").select(_key(F.col("tree"), F.lit(0), F.lit(0)).alias("node"), _key(F.col("tree"), F.lit(SUBROOT), F.lit(0)).alias("jump"), F.array().cast("array<struct<left: binary, right: binary>>").alias("segment"), "id", F.col("hash").alias("leaf"), "told")
    own = [single, *[_steps(runs, k) for k, runs in enumerate(levels)]]
    above = [_steps(runs, k).withColumn("id", no_id) for k, runs in enumerate(top_levels)]
    walk = materialize(reduce(DataFrame.unionByName, [*own, *above]), "pointers")

    distance, deepest = 1, max(height, 1) + top_height
    while distance <= deepest:
        target = (F.col("node.level") >= distance) | (F.col("node.level") == SUBROOT) | (F.col("node.tree") == TOP)
        far = walk.where(target).select(F.col("node").alias("jump"), F.col("jump").alias("jump2"), F.col("segment").alias("segment2"))
        # at most the nodes of a distance's level and above, each with its steps
        most = (total * FAN // (FAN - 1) // FAN**distance + trees * (height + 2)) * (200 + min(distance, deepest) * 32 * FAN)
        joined = walk.join(F.broadcast(far) if most <= BROADCAST else far, "jump", "left")
        whole = F.when(F.col("segment2").isNull(), F.col("segment")).otherwise(F.concat("segment", "segment2"))
        distance *= 2
        # what no leaf can point at in the next round has done its part
        needed = (F.col("node.level") == 0) | (F.col("node.level") >= distance) | (F.col("node.level") == SUBROOT) | (F.col("node.tree") == TOP)
        walk = materialize(joined.select("node", F.col("jump2").alias("jump"), whole.alias("segment"), "id", "leaf", "told").where(needed), "pointers")

    of_tree = subroots.select(F.col("tree").alias("name"), F.col("hash").alias("subroot"))
    of_tree = F.broadcast(of_tree) if trees * 200 <= BROADCAST else of_tree
    found = walk.where((F.col("node.level") == 0) & (F.col("node.tree") != TOP)).withColumn("name", F.col("node.tree")).join(of_tree, "name")
    return found.select(F.col("id").alias(id_col), hexed(F.col("leaf")).alias("leaf"), hexed(F.col("told")).alias("told"), hexed(F.col("subroot")).alias("subroot"), F.lit(root).cast("string").alias("root"), F.col("segment").alias("steps"))


def proof_digest(steps: Column) -> Column:
    """SHA-256 of all siblings, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(steps, lambda s: hexed(F.concat(s["left"], s["right"]))), "").cast("binary"), 256)


def folded(leaf: Column, steps: Column) -> Column:
    """The root that a leaf and the siblings on its way lead to."""
    return F.aggregate(steps, leaf, lambda node, s: F.sha2(F.concat(hexed(s["left"]), node, hexed(s["right"])).cast("binary"), 256))
