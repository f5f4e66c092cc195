"""Labels of trees by contraction: leaves fold into their parents, chains shorten, and the little that is left of a tree
is finished by one task.

A round removes all leaves and, where these are less than half of what is left, an independent set of nodes with a single
child: those whose coin is up while their parent's is down. So what is left shrinks by a constant share each round and
all rounds together are linear in the nodes. Trees of at most ``finish`` nodes need no round at all. Going up, a removed
leaf adds its weight to its parent, and a node taken out of a chain leaves its weight on the edge of its child. Going
down, the rounds are undone in reverse: a node's value is its parent's and that of the edge to it.

Columns: tu, node_id, parent_id (null for a root). A parent without a row counts as one that has no value. Nodes on a
cycle or below one get null values.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from treescan.functions.storage import counted, written

#: Nodes (left) of a tree that one task finishes: about 200 MB with its names. Most translation units are smaller.
FINISH = 1 << 20


@dataclass
class Contraction:
    """Rounds as (leaves, spliced or None, alive after it), what is left of the trees, and what is left of large cycles.

    Rows have up (the parent they began with), parent_id (as it was when they went), weight and between: nodes folded
    into it, and nodes taken out between it and its parent. Spliced rows have the child and what was between that and them.
    """

    rounds: list[tuple[DataFrame, DataFrame | None, DataFrame]] = field(default_factory=list)
    rest: list[DataFrame] = field(default_factory=list)
    cyclic: list[DataFrame] = field(default_factory=list)
    total: int = 0


def _split(alive: DataFrame, finish: int) -> tuple[DataFrame, DataFrame | None]:
    """The rows of trees that are small enough, and the rest if there is any."""
    sizes = written(alive.groupBy("tu").agg(F.count("*").alias("n")).where(F.col("n") > finish).select("tu"), "large_trees")
    if sizes.isEmpty():
        return alive, None
    return alive.join(sizes, "tu", "left_anti"), alive.join(sizes, "tu", "left_semi")


def contract(nodes: DataFrame, finish: int | None = None) -> Contraction:
    """nodes (tu, node_id, parent_id, more columns) to the rounds that take them apart."""
    finish = FINISH if finish is None else finish
    out = Contraction()
    long = lambda n: F.lit(n).cast("long")
    alive, n = counted(nodes.withColumn("up", F.col("parent_id")).withColumns({"weight": long(1), "between": long(0)}), "nodes", all=F.count(F.lit(1)))
    out.total = n["all"]
    small, alive = _split(alive, finish)
    out.rest.append(small)
    key, turn = ["tu", "node_id"], 0
    while alive is not None:
        turn += 1
        of_parent = alive.where("parent_id is not null").groupBy("tu", F.col("parent_id").alias("node_id"))
        marked = alive.join(of_parent.agg(F.count("*").alias("kids")), key, "left").withColumn("leaf", F.col("kids").isNull())
        marked, n = counted(marked, "marked", all=F.count(F.lit(1)), leaves=F.count_if("leaf"))
        leaves = marked.where("leaf").drop("kids", "leaf")
        masses = leaves.where("parent_id is not null").groupBy("tu", F.col("parent_id").alias("node_id")).agg(F.sum(F.col("weight") + F.col("between")).alias("more"), F.count("*").alias("gone"))
        inner = marked.where("not leaf").drop("leaf").join(masses, key, "left")
        inner = inner.withColumns({"weight": F.col("weight") + F.coalesce("more", long(0)), "kids": F.col("kids") - F.coalesce("gone", long(0))}).drop("more", "gone")
        inner = written(inner, "inner")
        if not n["leaves"]:  # whatever isn't on a cycle has a leaf below it, or is one
            out.cyclic.append(inner.drop("kids"))
            break
        spliced = None
        if 2 * n["leaves"] < n["all"]:
            spliced = written(_chain_links(inner, turn), "spliced")
            shorter = spliced.select("tu", F.col("child").alias("node_id"), F.col("parent_id").alias("above"), (F.col("weight") + F.col("between")).alias("more"))
            kept = inner.join(spliced.select(*key), key, "left_anti").join(shorter, key, "left")
            inner = written(kept.withColumns({"parent_id": F.coalesce("above", "parent_id"), "between": F.col("between") + F.coalesce("more", long(0))}).drop("above", "more"), "inner")
        alive = inner.drop("kids")
        out.rounds.append((leaves, spliced, alive))
        small, alive = _split(alive, finish)
        out.rest.append(small)
    return out


def _chain_links(inner: DataFrame, turn: int) -> DataFrame:
    """Nodes to take out: of a single child, coin up, and their parent's down, so no two of them meet."""
    coin = lambda c: F.pmod(F.xxhash64("tu", c, F.lit(turn)), F.lit(2)) == 1
    only = inner.where("parent_id is not null").groupBy("tu", F.col("parent_id").alias("node_id")).agg(F.min(F.struct("node_id", "between")).alias("c"))
    alone = inner.where("kids = 1 and parent_id is not null").where(coin("node_id") & ~coin("parent_id")).drop("kids")
    return alone.join(only, ["tu", "node_id"]).withColumns({"child": F.col("c.node_id"), "child_between": F.col("c.between")}).drop("c").where("child <> parent_id")


def _order(rows: pa.Table) -> tuple[list[int], list[int], np.ndarray]:
    """Place of each row's parent (-1: none), the rows from leaves to roots without those on cycles, and a number for each
    tree and parent."""
    codes = lambda a: a.combine_chunks().dictionary_encode().indices
    n = rows.num_rows
    trees = codes(rows.column("tu")).to_numpy()
    names = codes(pa.chunked_array([*rows.column("node_id").chunks, *rows.column("parent_id").chunks], rows.schema.field("node_id").type))
    names = pc.fill_null(names, -1).to_numpy().astype(np.int64)
    own, above = (trees.astype(np.int64) * (2 * n + 1) + x for x in (names[:n], names[n:]))
    by_key = np.argsort(own)
    at = np.minimum(np.searchsorted(own, above, sorter=by_key), max(n - 1, 0))
    up = np.where((names[n:] >= 0) & (own[by_key[at]] == above), by_key[at], -1)
    waits = np.bincount(up[up >= 0], minlength=n).tolist()
    up = up.tolist()
    order = [v for v, w in enumerate(waits) if not w]
    for v in order:
        p = up[v]
        if p >= 0:
            waits[p] -= 1
            if not waits[p]:
                order.append(p)
    return up, order, above


def _in_tasks(df: DataFrame, f, schema: str, total: int) -> DataFrame:
    """f over whole trees of at most about FINISH nodes, many small ones at a time. total: an upper bound of the rows."""
    parts = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), 2 * total // FINISH)
    return df.withColumn("bucket", F.pmod(F.xxhash64("tu"), F.lit(parts))).groupBy("bucket").applyInArrow(f, schema).drop("bucket")


def _sizes_of(rows: pa.Table) -> pa.Table:
    """What is left of trees, with size: weights of a node and all below it. Null on a cycle."""
    up, order, _ = _order(rows)
    size, between = rows.column("weight").to_pylist(), rows.column("between").to_pylist()
    for v in order:
        if up[v] >= 0:
            size[up[v]] += size[v] + between[v]
    done = np.zeros(len(up), bool)
    done[order] = True
    return rows.append_column("size", pa.array(size, pa.int64(), mask=~done))


def _labels_of(rows: pa.Table, carry: tuple[str, ...] = ()) -> pa.Table:
    """Whole trees (tu, node_id, parent_id, ordinal, bucket) to tu, node_id, depth, size, pre, root_id, carry, bucket."""
    ids, n = rows.column("node_id").combine_chunks(), rows.num_rows
    up, order, family = _order(rows)
    size = [1] * n
    for v in order:
        if up[v] >= 0:
            size[up[v]] += size[v]
    ordinal = rows.column("ordinal").to_numpy()
    by = np.lexsort((ordinal, family))
    if ((np.diff(family[by]) == 0) & (np.diff(ordinal[by]) == 0)).any():  # ties go by name
        names = np.empty(n, np.int64)
        names[pc.array_sort_indices(ids).to_numpy()] = np.arange(n)
        by = np.lexsort((names, ordinal, family))
    sizes = np.array(size)[by]
    sums = np.cumsum(sizes) - sizes
    begins = np.append(True, np.diff(family[by]) != 0)[:n]
    before = np.empty(n, np.int64)
    before[by] = sums - np.repeat(sums[begins], np.diff(np.append(np.flatnonzero(begins), n)))
    before, top = before.tolist(), rows.column("parent_id").is_null().to_pylist()
    depth, pre, root = [None] * n, [None] * n, [-1] * n
    for v in reversed(order):
        p, edge = up[v], 0 if top[v] else 1
        if p < 0:
            depth[v], pre[v], root[v] = edge, before[v] + edge, v if top[v] else -1
        elif depth[p] is not None:
            depth[v], pre[v], root[v] = depth[p] + 1, pre[p] + before[v] + 1, root[p]
    at = np.array(root, np.int64)
    return pa.table({"tu": rows.column("tu"), "node_id": ids, "depth": pa.array(depth, pa.int64()), "size": pa.array(size, pa.int64()), "pre": pa.array(pre, pa.int64()), "root_id": ids.take(pa.array(np.maximum(at, 0), mask=at < 0)), **{c: rows.column(c) for c in carry}, "bucket": rows.column("bucket")})


def in_order_of(rows: pa.Table, carry: tuple[str, ...]) -> pa.Table:
    """Whole trees (tu, node_id, parent_id, ordinal, carry, bucket), tree by tree in their order, to tu, root_id, pre, depth,
    ends (subtrees that end at a node), carry, bucket. Nodes below a parent that has no row go. Raises ValueError where
    parents form a cycle."""
    found = _labels_of(rows, carry)
    if found.column("pre").null_count:
        raise ValueError("parents form a cycle")
    found = found.filter(pc.is_valid(found.column("root_id")))
    trees = found.column("tu").combine_chunks().dictionary_encode().indices
    trees = pc.fill_null(trees, -1).to_numpy(zero_copy_only=False)
    pre, size = found.column("pre").to_numpy(), found.column("size").to_numpy()
    by = np.lexsort((pre, trees))
    trees, last = trees[by], (pre + size - 1)[by]
    first = np.flatnonzero(np.append(True, np.diff(trees) != 0)[: len(by)])
    begins = np.repeat(first, np.diff(np.append(first, len(by))))
    ends = np.bincount(begins + last, minlength=len(by))
    found = found.take(pa.array(by)).append_column("ends", pa.array(ends, pa.int32()))
    return found.select(["tu", "root_id", "pre", "depth", "ends", *carry, "bucket"])


def _values_of(rows: pa.Table) -> pa.Table:
    """What is left of trees (tu, node_id, parent_id, steps, shift, further columns, bucket) to tu, node_id, depth, pre,
    root_id, further columns, bucket."""
    carry = [c for c in rows.column_names if c not in ("tu", "node_id", "parent_id", "steps", "shift", "bucket")]
    ids = rows.column("node_id").combine_chunks()
    up, order, _ = _order(rows)
    depth, pre = ([None] * len(up) for _ in range(2))
    root = [-1] * len(up)
    steps, shift, top = rows.column("steps").to_pylist(), rows.column("shift").to_pylist(), rows.column("parent_id").is_null().to_pylist()
    for v in reversed(order):
        p = up[v]
        if p < 0:
            depth[v], pre[v], root[v] = steps[v], shift[v], v if top[v] else -1
        elif depth[p] is not None:
            depth[v], pre[v], root[v] = depth[p] + steps[v], pre[p] + shift[v], root[p]
    at = np.array(root)
    return pa.table({"tu": rows.column("tu"), "node_id": ids, "depth": pa.array(depth, pa.int64()), "pre": pa.array(pre, pa.int64()), "root_id": ids.take(pa.array(np.maximum(at, 0), mask=at < 0)), **{c: rows.column(c) for c in carry}, "bucket": rows.column("bucket")})


def _schema(df: DataFrame, *more: str) -> str:
    return ", ".join([*[f"{f.name} {f.dataType.simpleString()}" for f in df.schema], *more])


def subtree_sizes(c: Contraction) -> DataFrame:
    """tu, node_id, up, further columns, gone (the round, null for what was left) and size of each node with all below it."""
    rest = reduce(DataFrame.unionByName, c.rest)
    known = written(_in_tasks(rest, _sizes_of, _schema(rest, "bucket long", "size long"), c.total).drop("parent_id", "weight", "between").withColumn("gone", F.lit(None).cast("int")), "sizes")
    for cyclic in c.cyclic:
        known = known.unionByName(cyclic.drop("parent_id", "weight", "between").withColumns({"gone": F.lit(-1), "size": F.lit(None).cast("long")}))
    for k in reversed(range(len(c.rounds))):
        leaves, spliced, _ = c.rounds[k]
        parts = [leaves.withColumn("size", F.col("weight"))]
        if spliced is not None:
            below = known.select("tu", F.col("node_id").alias("child"), F.col("size").alias("below"))
            parts.append(written(spliced.join(below, ["tu", "child"], "left").withColumn("size", F.col("weight") + F.col("child_between") + F.col("below")).drop("child", "child_between", "below"), "sizes"))
        known = reduce(DataFrame.unionByName, [known, *[p.drop("parent_id", "weight", "between").withColumn("gone", F.lit(k).cast("int")) for p in parts]])
    return known


def sibling_offsets(sized: DataFrame) -> DataFrame:
    """sized (tu, node_id, up, ordinal, size) with before: sizes of earlier siblings. Siblings are summed in ranges, so
    that a parent with very many children is not one task."""
    order = ["tu", "up", "ordinal", "node_id"]
    parts = written(sized.repartitionByRange(*order).withColumn("part", F.spark_partition_id()), "siblings")
    whole = Window.partitionBy("tu", "up").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # only families that go on over the end of a range, two for each at most
    ends = parts.groupBy("part").agg(F.min(F.struct("tu", "up")).alias("a"), F.max(F.struct("tu", "up")).alias("b")).select("part", F.explode(F.array_distinct(F.array("a", "b"))).alias("f")).select("part", "f.tu", "f.up")
    same = lambda a, b: (a["part"] == b["part"]) & (a["tu"] == b["tu"]) & a["up"].eqNullSafe(b["up"])
    sums = parts.join(F.broadcast(ends), same(parts, ends), "left_semi").groupBy("part", "tu", "up").agg(F.sum("size").alias("size"))
    carried = sums.withColumn("carry", F.sum("size").over(whole)).where("carry is not null").drop("size")
    within = F.sum("size").over(Window.partitionBy("part", "tu", "up").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    out = parts.withColumn("within", within)
    out = out.join(F.broadcast(carried), same(out, carried), "left").select(*[out[c] for c in out.columns], carried["carry"])
    zero = F.lit(0).cast("long")
    return out.withColumn("before", F.coalesce("within", zero) + F.coalesce("carry", zero)).drop("part", "within", "carry")


def from_the_top(c: Contraction, edges: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """edges (tu, node_id, up, gone, steps, shift) to (tu, node_id, depth, pre, root_id): sums of steps and shift from the
    root to each node. root_id is null where the walk ends at a parent that has no row. The columns carry of the edges go
    along, so that no join is needed to have them again. The last round is not written: use the result once."""
    key = ["tu", "node_id"]
    current, changed = edges.select(*key, "steps", "shift", *carry), False
    undo: list[DataFrame] = []
    rest = [c.rest[0].select(*key, "parent_id").join(current, key)]
    for k, (leaves, spliced, alive) in enumerate(c.rounds):
        if not changed and spliced is None:  # parents are still those that the nodes began with
            undo.append(edges.where(F.col("gone") == k).select(*key, F.col("up").alias("parent_id"), "steps", "shift", *carry))
            rest.append(c.rest[k + 1].select(*key, "parent_id").join(current, key))
            continue
        undo.append(written(leaves.select(*key, "parent_id").join(current, key), "removed"))
        live = alive.select(*key).join(current, key)
        if spliced is not None:
            changed = True
            # undone before the leaves of the round, whose parents may be among them
            undo.append(written(spliced.select(*key, "parent_id", "child").join(current, key), "removed"))
            longer = undo[-1].select("tu", F.col("child").alias("node_id"), F.col("steps").alias("s"), F.col("shift").alias("t"))
            zero = F.lit(0).cast("long")
            live = live.join(longer, key, "left").select(*key, (F.col("steps") + F.coalesce("s", zero)).alias("steps"), (F.col("shift") + F.coalesce("t", zero)).alias("shift"), *carry)
        current = written(live, "edges")
        rest.append(c.rest[k + 1].select(*key, "parent_id").join(current, key))
    if changed:
        left = reduce(DataFrame.unionByName, rest)
    else:
        left = edges.where("gone is null").select(*key, F.col("up").alias("parent_id"), "steps", "shift", *carry)
    kind = edges.schema["node_id"].dataType.simpleString()
    schema = f"tu {edges.schema['tu'].dataType.simpleString()}, node_id {kind}, depth long, pre long, root_id {kind}, {''.join(f"{n} {edges.schema[n].dataType.simpleString()}, " for n in carry)}bucket long"
    known = written(_in_tasks(left, _values_of, schema, c.total), "values")
    for cyclic in c.cyclic:
        known = known.union(cyclic.select(*key, *[F.lit(None).cast(t).alias(n) for n, t in (("depth", "long"), ("pre", "long"), ("root_id", kind), *((n, edges.schema[n].dataType) for n in carry))]))
    for k, removed in reversed(list(enumerate(undo))):
        above = known.select("tu", F.col("node_id").alias("parent_id"), F.col("depth").alias("d"), F.col("pre").alias("p"), "root_id", F.lit(True).alias("there"))
        value = lambda own, upper: F.when(F.col("there"), F.col(upper) + F.col(own)).otherwise(F.col(own))
        root = F.when(F.col("parent_id").isNull(), F.col("node_id")).otherwise(F.col("root_id"))
        back = removed.join(above, ["tu", "parent_id"], "left").select(*key, value("steps", "d").alias("depth"), value("shift", "p").alias("pre"), root.alias("root_id"), *carry)
        known = known.union(written(back, "values") if k else back)
    return known


def depths(nodes: DataFrame, finish: int | None = None) -> DataFrame:
    """tu, node_id, depth, root_id."""
    c = contract(nodes.select("tu", "node_id", "parent_id"), finish)
    parts = [r.select("tu", "node_id", "up", F.lit(None).cast("int").alias("gone")) for r in c.rest] + [r.select("tu", "node_id", "up", F.lit(-1).alias("gone")) for r in c.cyclic]
    for k, (leaves, spliced, _) in enumerate(c.rounds):
        parts += [df.select("tu", "node_id", "up", F.lit(k).alias("gone")) for df in (leaves, spliced) if df is not None]
    one = F.when(F.col("up").isNull(), 0).otherwise(1).cast("long")
    edges = reduce(DataFrame.unionByName, parts).withColumns({"steps": one, "shift": F.lit(0).cast("long")})
    return from_the_top(c, edges).select("tu", "node_id", F.when(F.col("root_id").isNotNull(), F.col("depth")).alias("depth"), "root_id")


def labels(nodes: DataFrame, finish: int | None = None, carry: tuple[str, ...] = ()) -> DataFrame:
    """nodes (tu, node_id, parent_id, ordinal) to tu, node_id, depth, size, pre, root_id, and parent_id or ordinal where
    they are in carry. Raises ValueError where parents
    form a cycle. Trees of at most ``finish`` nodes are labelled in tasks, many at a time; larger ones go by rounds."""
    nodes, n = counted(nodes.select("tu", "node_id", "parent_id", F.col("ordinal").cast("long").alias("ordinal")), "nodes", all=F.count(F.lit(1)))
    small, large = _split(nodes, FINISH if finish is None else finish)
    kind = nodes.schema["node_id"].dataType.simpleString()
    schema = f"tu {nodes.schema['tu'].dataType.simpleString()}, node_id {kind}, depth long, size long, pre long, root_id {kind}, {''.join(f"{n} {nodes.schema[n].dataType.simpleString()}, " for n in carry)}bucket long"
    bad = F.count_if(F.col("pre").isNull())
    found, n = counted(_in_tasks(small, lambda rows: _labels_of(rows, carry), schema, n["all"]), "labels", bad=bad)
    if large is not None:
        c = contract(large, finish)
        sized = written(sibling_offsets(subtree_sizes(c)), "sized")
        edge = F.when(F.col("up").isNull(), 0).otherwise(1).cast("long")
        along = ("size", *("up" if n == "parent_id" else n for n in carry))
        edges = sized.select("tu", "node_id", "up", "gone", edge.alias("steps"), (F.col("before") + edge).alias("shift"), *(n for n in along if n != "up"))
        more, m = counted(from_the_top(c, edges, along).withColumnRenamed("up", "parent_id"), "labels", bad=bad)
        found, n = found.unionByName(more), {"bad": n["bad"] + m["bad"]}
    if n["bad"]:
        raise ValueError("parents form a cycle")
    return found
