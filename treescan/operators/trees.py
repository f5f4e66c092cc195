"""Trees given by parent pointers: depth, paths, subtrees, labels, contexts.

Table nodes: tu, node_id, parent_id (null for a root), and ordinal among siblings. Walks double their stride in
each round, so a chain of a thousand nodes takes ten rounds; each round is written to the shared folder. In each round
some walk comes to its end, so where their number stays the same parents form a cycle.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from treescan.functions.storage import counted, written
from treescan.operators import contraction


def _open() -> Column:
    """How many walks go on, counted while a round is written."""
    return F.count_if(F.col("jump").isNotNull())


def _still_open(n: int, before: int, cycles: bool = False) -> int:
    """The walks that go on; 0 where only cycles are left, or ValueError unless these are allowed."""
    if n == before and not cycles:
        raise ValueError("parents form a cycle")
    return 0 if n == before else n


#: Walks that are doubled without taking off leaves first.
FEW = 1 << 18


def walks_up(nodes: DataFrame, of_node: Column, together, parent: str = "parent_id") -> DataFrame:
    """tu, node_id, top, rooted, value for each node: of_node of the node and all above it up to top, put together two by
    two by together(upper, lower). top is the highest node (rooted), a parent that has no row, or null in a cycle.

    Leaves are taken off while that halves what is left, and get their values from their parents at the end. So the
    doubled walks are those of few nodes, and most rows are joined with their own parents only."""
    key, peeled = ["tu", "node_id"], []
    alive, seen = counted(nodes.select(*key, F.col(parent).alias("up"), of_node.alias("value")), "walks", all=F.count(F.lit(1)))
    n = seen["all"]
    while n > FEW:
        parents = alive.where("up is not null").select("tu", F.col("up").alias("node_id")).distinct().withColumn("inner", F.lit(True))
        marked, seen = counted(alive.join(parents, key, "left"), "walks", leaves=F.count_if(F.col("inner").isNull()))
        peeled.append(marked.where("inner is null").drop("inner"))
        alive, before, n = marked.where("inner").drop("inner"), n, n - seen["leaves"]
        if 2 * n > before:
            break
    walk, seen = counted(alive.select(*key, F.col("up").alias("jump"), F.coalesce("up", "node_id").alias("top"), F.col("up").isNull().alias("rooted"), "value"), "walks", open=_open())
    n = seen["open"]
    while n:
        far = walk.select("tu", F.col("node_id").alias("jump"), F.col("jump").alias("jump2"), F.col("top").alias("top2"), F.col("rooted").alias("rooted2"), F.col("value").alias("value2"))
        far = walk.join(far, ["tu", "jump"], "left")
        value = F.when(F.col("value2").isNull(), F.col("value")).otherwise(together(F.col("value2"), F.col("value")))
        walk, seen = counted(far.select(*key, F.col("jump2").alias("jump"), F.coalesce("top2", "top").alias("top"), F.coalesce("rooted2", "rooted").alias("rooted"), value.alias("value")), "walks", open=_open())
        n = _still_open(seen["open"], n, cycles=True)
    known = walk.select(*key, F.when(F.col("jump").isNull(), F.col("top")).alias("top"), (F.col("jump").isNull() & F.col("rooted")).alias("rooted"), "value")
    for k in reversed(range(len(peeled))):
        above = known.select("tu", F.col("node_id").alias("up"), F.col("top").alias("top2"), F.col("rooted").alias("rooted2"), F.col("value").alias("value2"), F.lit(True).alias("there"))
        value = F.when(F.col("value2").isNull(), F.col("value")).otherwise(together(F.col("value2"), F.col("value")))
        top = F.when(F.col("there"), F.col("top2")).otherwise(F.coalesce("up", "node_id"))
        back = peeled[k].join(above, ["tu", "up"], "left").select(*key, top.alias("top"), F.coalesce("rooted2", F.col("up").isNull()).alias("rooted"), value.alias("value"))
        known = known.union(written(back, "walks") if k else back)
    return known


def node_depth(nodes: DataFrame) -> DataFrame:
    """tu, node_id, depth (edges to the root), root_id; null depth where a walk never ends at a root."""
    return contraction.depths(nodes)


def path_to_root(nodes: DataFrame) -> DataFrame:
    """tu, node_id, path: ids from the root to the node. No row where the walk does not end at a root of the tu."""
    return walks_up(nodes, F.array("node_id"), F.concat).where("rooted").select("tu", "node_id", F.col("value").alias("path"))


def _gathered_up(nodes: DataFrame, start: Column, more, grown, name: str) -> DataFrame:
    """tu, node_id and a number over the subtree of each node. After a round the number covers what is less than the
    stride below; what is the stride below adds its own by the aggregate more and the function grown(own, more, stride)."""
    at, seen = counted(nodes.select("tu", "node_id", F.col("parent_id").alias("jump"), start.cast("long").alias(name)), name, open=_open())
    n, stride = seen["open"], 1
    while n:
        below = at.where("jump is not null").groupBy("tu", F.col("jump").alias("node_id")).agg(more(name).alias("more"))
        far = at.select("tu", F.col("node_id").alias("jump"), F.col("jump").alias("jump2"))
        joined = at.join(below, ["tu", "node_id"], "left").join(far, ["tu", "jump"], "left")
        at, seen = counted(joined.select("tu", "node_id", F.col("jump2").alias("jump"), grown(F.col(name), F.col("more"), stride).alias(name)), name, open=_open())
        n, stride = _still_open(seen["open"], n), stride * 2
    return at.select("tu", "node_id", name)


def label_tree(nodes: DataFrame) -> DataFrame:
    """nodes with depth, size (with itself), pre and post (0-based, the last pre of the subtree). Raises ValueError where
    parents form a cycle.

    By contraction: sizes go up, then pre goes down as the sum of the sizes of earlier siblings, plus one a step.
    """
    post = (F.col("pre") + F.col("size") - 1).alias("post")
    if set(nodes.columns) == {"tu", "node_id", "parent_id", "ordinal"}:  # nothing to be joined again
        return contraction.labels(nodes, carry=("parent_id", "ordinal")).select(*nodes.columns, "depth", "size", "pre", post)
    found = contraction.labels(nodes).select("tu", "node_id", "depth", "size", "pre", post)
    return nodes.drop("depth", "size", "pre", "post").join(found, ["tu", "node_id"])


def preorder(labelled: DataFrame) -> DataFrame:
    """Rows in the order of the tree: parents first, children left to right."""
    return labelled.orderBy("tu", "pre")


def subtree(labelled: DataFrame, roots: DataFrame) -> DataFrame:
    """roots (root_id, tu, node_id) to all nodes at or below each: root_id, node_id.

    With labels a subtree is a range of pre. Ranges of one tu are nested or apart, so they are met through the blocks
    that hold them (as positions are), not by comparing every node with every root. A node probes the levels that occur.
    """
    levels = list(range(0, 40, 2))
    ends = labelled.join(roots.select("root_id", "tu", "node_id"), ["tu", "node_id"]).select("root_id", "tu", F.col("pre").alias("lo"), F.col("post").alias("hi"))
    same = lambda k: F.shiftright("lo", k) == F.shiftright("hi", k)
    stored = written(ends.withColumn("level", F.coalesce(*[F.when(same(k), F.lit(k)) for k in levels])).withColumn("block", F.expr("shiftright(lo, level)")), "ranges")
    occur = sorted(r[0] for r in stored.select("level").distinct().collect())  # of the levels above
    if not occur:
        return stored.select("root_id", "tu", F.lit(None).cast(labelled.schema["node_id"].dataType).alias("node_id"))
    probes = labelled.select("tu", "node_id", "pre", F.explode(F.array(*[F.struct(F.lit(k).alias("level"), F.shiftright("pre", k).alias("block")) for k in occur])).alias("b")).select("tu", "node_id", "pre", "b.level", "b.block")
    return probes.join(stored, ["tu", "level", "block"]).where("pre between lo and hi").select("root_id", "tu", "node_id")


def subtree_size(labelled: DataFrame) -> DataFrame:
    """tu, node_id, n_below (nodes below it), n_children."""
    children = labelled.where("parent_id is not null").groupBy("tu", F.col("parent_id").alias("node_id")).agg(F.count("*").alias("n_children"))
    return labelled.select("tu", "node_id", (F.col("size") - 1).alias("n_below")).join(children, ["tu", "node_id"], "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))


def height(nodes: DataFrame) -> DataFrame:
    """tu, node_id, height: edges to the deepest node below. Raises ValueError where parents form a cycle.

    Leaves are taken off while that halves what is left, and leave their heights with their parents, so that only few
    nodes are left for the strides."""
    peeled: list[DataFrame] = []
    alive, seen = counted(nodes.select("tu", "node_id", "parent_id", F.lit(0).cast("long").alias("height")), "height", all=F.count(F.lit(1)))
    n = seen["all"]
    while n > FEW:
        above = alive.where("parent_id is not null").groupBy("tu", F.col("parent_id").alias("node_id")).agg((F.max("height") + 1).alias("more"))
        marked = alive.join(above, ["tu", "node_id"], "left").select("tu", "node_id", "parent_id", F.greatest("height", "more").alias("height"), F.col("more").isNotNull().alias("inner"))
        marked, seen = counted(marked, "height", leaves=F.count_if(~F.col("inner")))
        peeled.append(marked.where("not inner").select("tu", "node_id", "height"))
        alive, before, n = marked.where("inner").drop("inner"), n, n - seen["leaves"]
        if 2 * n > before:
            break
    rest = _gathered_up(alive, F.col("height"), F.max, lambda own, more, stride: F.greatest(own, more + stride), "height")
    return reduce(DataFrame.union, peeled, rest)


def context_chain(decls: DataFrame, which: str = "semantic_parent") -> DataFrame:
    """decls: tu, node_id, kind, name, is_decl, is_context, pre, and the context parent ``which``. Chain of contexts of
    each declaration from the outermost in, then itself; null for other nodes. An entry has the node's id only if that
    context comes before the declaration in the walk. Raises ValueError where contexts form a cycle."""
    entry = F.struct("kind", "name", "node_id", F.col("pre").alias("at"))
    up = walks_up(decls.where("is_context"), F.array(entry), F.concat, which)
    up = up.select("tu", F.col("node_id").alias("start"), F.when(F.col("top").isNull(), F.raise_error(F.lit("parents form a cycle")).cast(up.schema["value"].dataType)).otherwise(F.col("value")).alias("above"))
    rows = decls.select("tu", "node_id", "is_decl", "pre", F.col(which).alias("start"), F.array(entry).alias("own")).join(up, ["tu", "start"], "left")
    whole = F.concat(F.coalesce("above", F.slice("own", 1, 0)), "own")
    visible = lambda e: F.struct(e["kind"].alias("kind"), e["name"].alias("name"), F.when(e["at"] <= F.col("pre"), e["node_id"]).alias("node_id"))
    return rows.select("tu", "node_id", F.when(F.col("is_decl"), F.transform(whole, visible)).alias("chain"))


def context_group(kind: Column) -> Column:
    """Group of a context's kind; the first rule that fits counts."""
    has = lambda *words: F.lit(False) if not words else F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(kind, w))
    return F.when(kind == "TranslationUnitDecl", "TranslationUnit").when(kind == "NamespaceDecl", "Namespace").when(has("Record", "Class"), "Record").when(has("Function", "Method", "Constructor", "Destructor"), "Function").when(kind == "EnumDecl", "Enum").otherwise("Other")


def contexts_of_kind(chains: DataFrame) -> DataFrame:
    """Entries of chains counted by tu and group of kind."""
    return chains.select("tu", F.explode("chain").alias("e")).groupBy("tu", context_group(F.col("e.kind")).alias("context_group")).agg(F.count("*").alias("n"))
