"""Tree contraction against a plain walk, with and without rounds."""

import random

import pytest
from pyspark.sql import functions as F
from treescan.operators import contraction, trees

SCHEMA = "tu string, node_id string, parent_id string, ordinal long"


def forest(seed, n, shape):
    rng = random.Random(seed)
    rows = []
    for tu in ("t", "u"):
        for i in range(n if tu == "t" else 6):
            if shape == "bushy":
                up = None if i < 3 else rng.randrange(max(0, i // 3 - 1), i)
            elif shape == "chain":
                up = None if i == 0 else i - 1 if rng.random() < 0.97 else rng.randrange(i)
            elif shape == "star":
                up = None if i == 0 else 0
            else:
                up = None
            rows.append((tu, f"n{i}", None if up is None else f"n{up}", rng.randrange(4)))
    rng.shuffle(rows)
    return rows


def brute(rows):
    kids, nodes = {}, {(r[0], r[1]): r for r in rows}
    for r in rows:
        kids.setdefault((r[0], r[2]), []).append(r)
    out = {}

    def walk(tu):
        clock, stack = 0, [(r, 0, r[1], False) for r in sorted(kids.get((tu, None), []), key=lambda r: (r[3], r[1]), reverse=True)]
        while stack:
            r, depth, root, closing = stack.pop()
            if closing:
                d, p, t = out[(tu, r[1])]
                out[(tu, r[1])] = (d, clock - p, p, t)
                continue
            out[(tu, r[1])] = (depth, clock, root)
            clock += 1
            stack.append((r, depth, root, True))
            stack += [(k, depth + 1, root, False) for k in sorted(kids.get((tu, r[1]), []), key=lambda k: (k[3], k[1]), reverse=True)]

    for tu in {r[0] for r in rows}:
        walk(tu)
    assert len(out) == len(nodes)
    return out


@pytest.mark.parametrize("shape", ["bushy", "chain", "star", "roots"])
@pytest.mark.parametrize("finish", [20, 1 << 18])
def test_labels_equal_a_walk(spark, shape, finish):
    rows = forest(3, 90, shape)
    nodes = spark.createDataFrame(rows, SCHEMA)
    got = {(r.tu, r.node_id): (r.depth, r.size, r.pre, r.root_id) for r in contraction.labels(nodes, finish).collect()}
    assert got == brute(rows)
    depths = {(r.tu, r.node_id): (r.depth, r.root_id) for r in contraction.depths(nodes, finish).collect()}
    assert depths == {k: (v[0], v[3]) for k, v in brute(rows).items()}


@pytest.mark.parametrize("finish", [3, 1 << 18])
def test_cycles_and_lost_parents_have_no_depth(spark, finish):
    rows = [("t", f"c{i}", f"c{(i + 1) % 30}", 0) for i in range(30)] + [("t", f"b{i}", f"c{i}", 0) for i in range(9)] + [("t", "s", "s", 0), ("t", "two", "one", 0), ("t", "one", "two", 0)]
    rows += [("t", "r", None, 0), ("t", "k", "r", 0), ("t", "lost", "gone", 0), ("t", "lost2", "lost", 1)] + [("t", f"k{i}", "k", i) for i in range(9)]
    nodes = spark.createDataFrame(rows, SCHEMA)
    got = {r.node_id: (r.depth, r.root_id) for r in contraction.depths(nodes, finish).collect()}
    want = {r[1]: (None, None) for r in rows} | {"r": (0, "r"), "k": (1, "r")} | {f"k{i}": (2, "r") for i in range(9)}
    assert got == want
    with pytest.raises(ValueError, match="cycle"):
        contraction.labels(nodes, finish)
    good = nodes.where("node_id in ('r', 'k', 'k0', 'k1')")
    assert {r.node_id: (r.pre, r.size) for r in contraction.labels(good, finish).collect()} == {"r": (0, 4), "k": (1, 3), "k0": (2, 1), "k1": (3, 1)}
    assert contraction.labels(nodes.limit(0), finish).count() == 0


@pytest.mark.parametrize("shape", ["bushy", "chain", "star", "roots", "cycle"])
def test_walks_do_not_depend_on_leaves_taken_off(spark, shape, monkeypatch):
    """Paths by doubling alone and after leaves were taken off; only nodes left over take part in the doubled walks."""
    rows = forest(5, 90, "bushy" if shape == "cycle" else shape)
    rows += [("t", "lost", "gone", 0), ("t", "lost2", "lost", 0)] + ([("t", "a", "b", 0), ("t", "b", "a", 0), ("t", "below", "a", 0)] if shape == "cycle" else [])
    nodes = spark.createDataFrame(rows, SCHEMA)
    want = {}
    up = {(r[0], r[1]): r[2] for r in rows}
    for tu, node in up:
        path, at = [], node
        while at is not None and (tu, at) in up and len(path) < 200:
            path, at = [at, *path], up[tu, at]
        if at is None:
            want[tu, node] = path
    for few in (1 << 18, 0):
        monkeypatch.setattr(trees, "FEW", few)
        assert {(r.tu, r.node_id): r.path for r in trees.path_to_root(nodes).collect()} == want
        tops = {(r.tu, r.node_id): r.top for r in trees.walks_up(nodes, F.array("node_id"), F.concat).collect()}
        assert len(tops) == len(rows) and tops["t", "lost2"] == "gone" and tops.get(("t", "below")) is None


@pytest.mark.parametrize("shape", ["bushy", "chain", "star"])
def test_bare_trees_are_labelled_without_a_join(spark, shape, monkeypatch):
    """Parents and ordinals come along with the labels, through tasks and through rounds; the plan joins nothing to nodes."""
    rows = forest(4, 90, shape)
    nodes = spark.createDataFrame(rows, SCHEMA)
    want = {(tu, n): (up, o, *v[:3]) for (tu, n, up, o), v in ((r, brute(rows)[r[0], r[1]]) for r in rows)}
    for finish in (1 << 18, 20):
        monkeypatch.setattr(contraction, "FINISH", finish)
        found = trees.label_tree(nodes)
        assert {(r.tu, r.node_id): (r.parent_id, r.ordinal, r.depth, r.size, r.pre) for r in found.collect()} == want
        assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()
