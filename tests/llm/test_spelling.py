"""Spelling variants against brute force, and the one-error search on its own."""

import random
import re
import zlib

import numpy as np
import pytest
from treescan.llm import spelling
from treescan.llm.common import UPPER


def one_apart(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(rows):
    counts = {}
    lower = {u: u + 32 for u in UPPER}
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(lower)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            run = run[: h % len(run)] + run[h % len(run) + 1 :] if h % 31 == 0 else run
            counts[run] = counts.get(run, 0) + 1
    n = {w: k for w, k in counts.items() if len(w) >= 7 and k >= 2}
    near = {w: [v for v in n if abs(len(v) - len(w)) <= 1 and one_apart(v, w)] for w in n}
    form = {}
    for w, vs in near.items():
        best = min(vs, key=lambda v: (-n[v], v), default=None)
        if best is not None and n[best] >= 10 * n[w]:
            form[w] = best
    out = set()
    for w in n:
        root = w
        while root in form:
            root = form[root]
        out.add((w, form.get(w), root, n[w], len(near[w]), n[form[w]] if w in form else None))
    return out


def texts():
    rng = random.Random(4)
    stems = ["".join(rng.choice("abÀéz") for _ in range(rng.randint(7, 10))) for _ in range(25)] + ["aaaaaaaa", "aaaaaaa", "abababab", "ß" * 12, "x" * 700]
    words = []
    for s in stems:
        for _ in range(12):
            w, k = list(s), rng.randrange(len(s))
            rng.choice([lambda: w.pop(k), lambda: w.insert(k, rng.choice("abÀéz")), lambda: w.__setitem__(k, rng.choice("abÀéz"))])()  # noqa: B023
            words += ["".join(w)] * rng.choice([1, 2, 3])
        words += [s] * rng.choice([2, 40, 400])
    rng.shuffle(words)
    lines = [" ".join(words[i : i + 60]) for i in range(0, len(words), 60)]
    odd = [None, "", "Abcdefg ABCDEFG abcdefg×abcdefg", "ÀBCDÉFGH àbcdéfgh", "short words in this one", "l" * 30_000 + " " + "l" * 30_000, "l" * 30_001 + "1" + "l" * 30_001]
    return list(enumerate(lines + odd)) + [(None, lines[0]), (3, lines[3]), (3, lines[3])]


@pytest.mark.parametrize("part", [40, 150_000])
def test_variants_equal_brute_force(spark, monkeypatch, part):
    monkeypatch.setattr(spelling, "PART", part)
    rows = texts()
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS word", "2 AS N")
    got = spelling.group_variants(spelling.vocabulary(docs)).collect()
    want = brute(rows)
    assert len(got) == len(want) and {tuple(r) for r in got} == want


def test_no_documents_no_words(spark):
    docs = spark.createDataFrame([(1, None), (None, "too short")], "doc_id long, text string")
    assert spelling.group_variants(spelling.vocabulary(docs)).count() == 0
    assert spelling.group_variants(spelling.vocabulary(docs.limit(0))).count() == 0


def test_search_finds_each_pair_once_and_only_outside_the_exact_part():
    rng = random.Random(9)
    words = sorted({"".join(rng.choice("ab") for _ in range(rng.randint(3, 9))) for _ in range(400)})
    raw = [w.encode() for w in words]
    exact = np.array([rng.randint(1, len(w) - 1) for w in words])
    q, v = spelling.one_error(spelling.FmIndex(raw), spelling.Query(raw), exact)
    got = list(zip(q.tolist(), v.tolist(), strict=True))
    want = {(i, j) for i, a in enumerate(words) for j, b in enumerate(words) if b.endswith(a[len(a) - exact[i] :]) and one_apart(a[: len(a) - exact[i]], b[: len(b) - exact[i]])}
    assert len(got) == len(set(got)) and set(got) == want
