"""The Merkle manifest against a plain recursion."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F
from treescan.llm import merkle

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(*values):
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in values])


def tree(nodes):
    """Root and, for each node, its siblings level by level."""
    paths, owners = [[] for _ in nodes], [[i] for i in range(len(nodes))]
    while len(nodes) > 1:
        runs = [list(range(k, min(k + 8, len(nodes)))) for k in range(0, len(nodes), 8)]
        for run in runs:
            for i in run:
                for o in owners[i]:
                    paths[o].append(([nodes[j] for j in run if j < i], [nodes[j] for j in run if j > i]))
        owners = [[o for i in run for o in owners[i]] for run in runs]
        nodes = [h(*[nodes[i] for i in run]) for run in runs]
    return nodes[0], paths


def brute(rows, change):
    """Sorted (doc_id, leaf, subroot, root, proof, folded root) of rows (doc_id, text, lang, source, n_chars)."""
    of = lambda r, text: leaf(r[0], r[3], r[2], r[4], text)
    langs = sorted({r[2] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    groups = {k: sorted((r for r in rows if r[2] == k), key=lambda r: (r[0] is not None, r[0] or 0, of(r, r[1]))) for k in langs}
    trees = {k: tree([of(r, r[1]) for r in g]) for k, g in groups.items()}
    if not rows:
        return []
    root, tops = tree([trees[k][0] for k in langs])
    out = []
    for k, top in zip(langs, tops, strict=True):
        for r, own in zip(groups[k], trees[k][1], strict=True):
            steps, node = own + top, of(r, change(r))
            for a, b in steps:
                node = h(*a, node, *b)
            out.append((repr(r[0]), of(r, r[1]), trees[k][0], root, h(*[x for a, b in steps for x in a + b]), node))
    return sorted(out)


def got(spark, rows, change):
    docs = spark.createDataFrame(rows, SCHEMA).withColumn("Tree", F.lit(1)).withColumn("hash", F.lit("x"))
    proofs = merkle.proofs(docs, FIELDS, told={"text": change})
    digest = proofs.select("doc_id", "leaf", "subroot", "root", merkle.proof_digest(F.col("steps")).alias("p"), merkle.folded(F.col("told"), F.col("steps")).alias("f"))
    return sorted((repr(r[0]), *r[1:]) for r in digest.collect())


def documents(n, langs, seed=1):
    rng = random.Random(seed)
    return [(i, rng.choice([None, "", "Abc", "é\n" * 9, "X y " * 4000]), rng.choice(langs), rng.choice([None, "s", "é"]), rng.choice([None, 3])) for i in rng.sample(range(10 * n), n)]


@pytest.mark.parametrize(
    "rows",
    [
        [],
        [(5, "A", "en", "s", 1)],
        [(5, "A", None, "s", 1), (None, None, "en", None, None)],
        documents(9, ["en"]),
        documents(700, [None, "", "é", "z", "-", "=", "en"]) + [(8000, "Q", "alone", "s", 1)],
        documents(65, ["en", "de"]) + [(7, "same", "en", "s", 4)] * 40 + [(7, "other", "en", "s", 5)] * 3 + [(None, "same", "en", "s", 4)] * 9,
        [(i, "t", f"l{i}", "s", i) for i in range(75)],
    ],
    ids=["empty", "one", "nulls", "nine", "langs", "repeats", "many_langs"],
)
def test_manifest_equals_recursion(spark, rows):
    lowered = F.when(F.col("doc_id") % 3 == 0, F.lower("text")).otherwise(F.col("text"))
    change = lambda r: r[1] if r[0] is None or r[0] % 3 or r[1] is None else r[1].lower()
    assert got(spark, rows, lowered) == brute(rows, change)


def test_far_nodes_are_joined_by_a_shuffle_too(spark, monkeypatch):
    rows = documents(300, ["en", None])
    want = brute(rows, lambda r: "other" if r[0] % 2 else r[1])
    monkeypatch.setattr(merkle, "BROADCAST", 0)
    assert got(spark, rows, F.when(F.col("doc_id") % 2 == 1, "other").otherwise(F.col("text"))) == want
