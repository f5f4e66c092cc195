"""The n-gram join against brute force, and its products and column blocks on their own."""

import random

import numpy as np
import pytest
from treescan.llm import ngram_join
from treescan.llm.ngram_join import product, shared_columns

SCHEMA = "doc_id long, text string"


def grams(text):
    w = (text or "").encode()
    w = bytes(c + 32 if 65 <= c <= 90 else c for c in w).split()
    return {tuple(w[i : i + 4]) for i in range(len(w) - 3)} if len(w) >= 4 else {tuple(w)} if w else set()


def brute(rows):
    """Sorted (doc_id, n_shingles, component_id)."""
    sets = [grams(t) for _, t in rows]
    top = list(range(len(rows)))

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            same_id = rows[i][0] is not None and rows[i][0] == rows[j][0]
            if (both and 100 * both >= 85 * (len(a) + len(sets[j]) - both)) or same_id:
                top[find(i)] = find(j)
    ids = {}
    for i, (k, _) in enumerate(rows):
        ids.setdefault(find(i), []).append(k)
    least = {r: min((k for k in ks if k is not None), default=None) for r, ks in ids.items()}
    return sorted(((k, len(sets[i]), least[find(i)]) for i, (k, _) in enumerate(rows)), key=repr)


def corpus():
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(2, 6)))
    texts = []
    passage = [word() for _ in range(70)]
    for n, copies, edits in ((40, 30, 2), (120, 60, 4), (120, 40, 7), (300, 12, 5), (9, 8, 1)):  # some link, some just miss
        base = [word() for _ in range(n)]
        for _ in range(copies):
            w = list(base)
            for k in rng.sample(range(n), rng.randint(0, min(edits, n))):
                w[k] = word()
            texts.append(" ".join(w))
    texts += [" ".join([word() for _ in range(60)] + passage) for _ in range(25)]
    texts += [texts[0]] * 20 + [texts[40].upper(), texts[41].replace(" ", "\n\t")]
    texts += [None, "", " \n", "one", "one", "two words", "a b c", "a b c d", "A B C D", "w " * 20_000, "w " * 30, "q" * 9000]
    rng.shuffle(texts)
    return list(enumerate(texts))


def found(spark, rows, docs=None):
    docs = spark.createDataFrame(rows, SCHEMA) if docs is None else docs
    return sorted((tuple(r) for r in ngram_join.find_links(docs.selectExpr("*", "1 AS Code", "'x' AS n")).collect()), key=repr)


def test_join_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK_CELLS", 1500)
    monkeypatch.setattr(ngram_join, "ROWS", 16)
    monkeypatch.setattr(ngram_join, "ROW_CELLS", 1600)
    rows = corpus()
    assert found(spark, rows) == brute(rows)


def test_ids_may_repeat_or_be_absent(spark):
    rows = corpus()[:60]
    rows += [(None, rows[3][1]), (None, "alone without an id here"), (None, None), (5, rows[7][1]), (5, "another text of document five"), (900, "another text of document five"), (6, None)]
    assert found(spark, rows) == brute(rows)


def test_nothing_to_join(spark):
    rows = [(1, None), (2, ""), (3, "a b c d e f"), (4, "g h i j k l")]
    assert found(spark, rows) == brute(rows)
    assert found(spark, [], spark.createDataFrame(rows, SCHEMA).limit(0)) == []


@pytest.mark.parametrize("chunk", [7, 4096])
def test_product_equals_set_overlaps(monkeypatch, chunk):
    monkeypatch.setattr(ngram_join, "CHUNK", chunk)
    rng = np.random.default_rng(2)
    base = rng.integers(0, 2**63, 120).astype(np.uint64)
    sets = [np.unique(np.concatenate([rng.permutation(base)[: rng.integers(107, 120)], rng.integers(0, 2**63, rng.integers(1, 8)).astype(np.uint64)])) for _ in range(50)]
    one, two = sets[:20], sets[20:]
    sizes = [np.array([len(s) for s in x]) for x in (one, two)]
    wanted = rng.random((20, 30)) < 0.9
    got = product(one, two, *sizes, wanted)
    for i, a in enumerate(one):
        for j, b in enumerate(two):
            both = len(set(a.tolist()) & set(b.tolist()))
            assert got[i, j] == (wanted[i, j] and 100 * both >= 85 * (len(a) + len(b) - both))
    assert 50 < got.sum() < 550


def test_frequent_columns_leave_a_block_early(monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK_CELLS", 20)
    monkeypatch.setattr(ngram_join, "CLASSES", 16)
    rng = random.Random(1)
    rows = [(c, sorted({7, *rng.sample(range(10, 400), 5)})) for c in range(200)]
    cells = lambda g: b"".join(x.to_bytes(ngram_join.CELL, "big") for x in g)
    batch = lambda block, part: ngram_join.pa.RecordBatch.from_pydict({"block": [block] * len(part), "code": [c for c, _ in part], "cells": [cells(g) for _, g in part]})
    batches = [batch(0, part) for part in (rows[:90], rows[60:90], rows[90:])]
    past = [r for b in shared_columns(iter([batch(-1, [(1, [5, 6])]), batch(-1, [(1, [5, 6]), (2, [6])])])) for r in b.to_pylist()]
    assert [(r["code"], len(r["grams"]), set(r["classes"])) for r in past] == [(1, 2, {16}), (2, 1, {16})]
    assert past[0]["grams"][1] == past[1]["grams"][0] != 6
    got = {}
    for b in shared_columns(iter(batches)):
        for r in b.to_pylist():
            for x, k in zip(r["grams"], r["classes"], strict=True):
                assert got.setdefault((r["code"], x), k) == k and got[(r["code"], x)] == k
    df = {}
    for _, g in rows:
        for x in g:
            df[x] = df.get(x, 0) + 1
    assert got == {(c, x): min(df[x], 16) for c, g in rows for x in g if df[x] > 1}
