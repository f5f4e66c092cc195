"""The corpus operators against brute force on small fixtures, with the edge cases that each docstring defines."""

import hashlib
import itertools
import math
import random
import time
import zlib

import numpy as np
import public_tokenizers
import pytest
from treescan.llm import bpe, exact_dedup, mixing, near_dedup, quality_rules, sharding, url_reputation
from treescan.llm.common import table

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def rows_of(texts):
    return [(i, t, "en", f"s{i % 3}", len(t or "")) for i, t in enumerate(texts)]


def edge_texts():
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdéü") for _ in range(rng.randint(1, 6)))
    base = [" ".join(word() for _ in range(n)) for n in (3, 5, 12, 60, 60, 200)]
    near = [" ".join(["zz" if i == k else w for i, w in enumerate(base[4].split())]) for k in (0, 1, 30)]
    lines = "one two three\n\n  \none two three\nx\nx\r\nx"
    return [None, "", " \t\n", *base, *near, base[5].upper(), base[5].replace(" ", "\t\n"), base[5], lines, "a\x1cb\x85c\u00a0d", "w " * 30_000, "#*$ %&|<> !" * 20, "é" * 5000]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows_of(edge_texts()), SCHEMA)


def words(text):
    return (text or "").encode().split()


# quality rules


def brute_stats(text):
    w = words(text)
    windows = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    many = {x for x in windows if windows.count(x) > 1} if len(windows) < 2000 else set(windows)
    covered = {i + k for i, x in enumerate(windows) if x in many for k in range(5)}
    lines = [x for x in (text or "").split("\n") if x.encode().strip()]
    return len(w), sum(len(x.decode()) for x in w), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered)


def test_stats_equal_brute_force(docs):
    got = docs.select("doc_id", "text", quality_rules.text_stats("text").alias("s")).collect()
    for r in got:
        assert tuple(r.s[:5]) == brute_stats(r.text), r.doc_id


def test_rules_find_planted_thresholds_and_render():
    rng = np.random.default_rng(1)
    x = {"a": rng.random(3000), "b": rng.random(3000), "c": rng.random(3000)}
    y = (((x["a"] > 0.8) & (x["b"] < 0.5)) | (x["c"] > 0.95)).astype(int)
    rules = quality_rules.learn_rules(x, y)
    hit = np.zeros(len(y), bool)
    for r in rules:
        hit |= quality_rules._mask(x, r.conditions)
    assert (hit == (y == 1)).mean() > 0.99 and len(rules) <= 4
    assert "a >=" in " ".join(map(str, rules))


def brute_first_condition(x, y):
    """The single condition of largest information gain, by trying all."""
    p0, n0 = int(y.sum()), int((y == 0).sum())
    best = (1e-9, None)
    for f, v in x.items():
        values = sorted(set(v.tolist()))
        for op in (">=", "<="):
            gains = []
            for a, b in zip(values, values[1:]):
                t = (a + b) / 2
                inside = v >= t if op == ">=" else v <= t
                p, n = int(y[inside].sum()), int((y[inside] == 0).sum())
                gains.append((p * (math.log2(p / (p + n)) - math.log2(p0 / (p0 + n0))) if p else 0.0, t))
            if gains and (top := max(gains, key=lambda g: g[0]))[0] > best[0] + 1e-12:
                best = (top[0], (f, op, top[1]))
    return best[1]


def test_grown_conditions_equal_brute_force():
    """Every condition is the best of all on what the ones before cover; growing ends where no good text is covered."""
    for seed in range(6):
        rng = np.random.default_rng(seed)
        x = {"a": rng.integers(0, 12, 80).astype(float), "b": rng.random(80), "c": rng.integers(0, 3, 80).astype(float)}
        y = ((x["a"] > 6) & (rng.random(80) < 0.8)).astype(int)
        inside = np.ones(80, bool)
        grown = quality_rules._grow(x, y, 4)
        for f, op, t in grown:
            want = brute_first_condition({k: v[inside] for k, v in x.items()}, y[inside])
            assert (f, op) == want[:2] and t == pytest.approx(want[2])
            inside &= x[f] >= t if op == ">=" else x[f] <= t
        assert grown and (len(grown) == 4 or not (y[inside] == 0).any() or brute_first_condition({k: v[inside] for k, v in x.items()}, y[inside]) is None)


def test_odd_labels_and_a_very_long_text(spark):
    rows = [(i, "good text of some words here to read on and on again" if i % 2 else f"### $$$ %%% &&& ||| <<< >>> *** ### $$$ %%% &&& a{i}", "en", "s", 1) for i in range(80)]
    rows += [(200, "long words of text " * 400_000, "en", "s", 1), (None, None, None, None, None), (7, "", "en", "s", 0)]
    labels = [(i, i % 2, 0) for i in range(80)] * 2 + [(3, 0, 0), (4, 1, 0), (None, 0, 0), (200, None, None)]
    out = quality_rules.judge(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).select("doc_id", "quality.*").collect()
    got = {r.doc_id: r for r in out if r.doc_id not in (None, 7)}
    assert len(out) == len(rows) and got[200].n_words == 1_600_000 and got[200].base_failed and not got[200].kept
    assert sum(got[i].kept for i in range(0, 80, 2)) == 0 and sum(got[i].kept for i in range(1, 80, 2) if i != 7) == 39


def test_no_labels_reject_nothing(spark, docs):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    out = quality_rules.judge(docs, labels)
    assert all(r.quality.kept != r.quality.base_failed for r in out.collect())


def test_clashing_columns_stay(spark, docs):
    labels = spark.createDataFrame([(1, None, 0), (None, 1, 0), (3, 0, 1)], "doc_id long, quality int, toxic int")
    out = quality_rules.judge(docs.withColumn("Quality", docs.lang).withColumn("_stats", docs.lang), labels)
    assert out.columns[-1] == "quality_" and "_stats" in out.columns and out.count() == docs.count()


# exact dedup


def test_exact_dedup_equals_brute_force(spark):
    texts = edge_texts() * 3 + ["same"] * 300
    rows = rows_of(texts) + [(None, "same", None, None, None), (None, "alone", None, None, None), (1, "", "en", "s", 0)]
    rows += [(2, "twice", "en", "s", 5)] * 2
    norm = lambda t: b" ".join(_split(t or ""))

    def _split(t):
        import re

        return re.split(rb"[\x20\x09-\x0D]+", t.encode())

    groups = {}
    for r in rows:
        groups.setdefault(norm(r[1]), []).append(r[0])
    got = exact_dedup.find_copies(spark.createDataFrame(rows, SCHEMA), runs=9).collect()
    assert len(got) == len(rows)
    by_sha = {hashlib.sha256(k).hexdigest(): v for k, v in groups.items()}
    for r in got:
        ids = by_sha[r.text_sha256]
        known = [i for i in ids if i is not None]
        assert r.keep_id == (min(known) if known else None) and r.group_size == len(ids)
    assert sum(r.kept for r in got) == len(groups)
    assert exact_dedup.drop_copies(spark.createDataFrame(rows, SCHEMA).withColumn("_key", table_lit())).count() == len(groups)


def table_lit():
    from pyspark.sql import functions as F

    return F.lit("x")


@pytest.mark.parametrize("runs", [3, 64])
def test_exact_dedup_of_thousands_of_keys_in_small_batches(spark, runs):
    rng = random.Random(runs)
    rows = [(i, f"text {rng.randrange(2500)}") for i in range(6000)]
    groups = {}
    for i, t in rows:
        groups.setdefault(t, []).append(i)
    setting = "spark.sql.execution.arrow.maxRecordsPerBatch"
    spark.conf.set(setting, "97")
    try:
        docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
        got = {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in exact_dedup.find_copies(docs, runs=runs).collect()}
        kept = sorted(r.doc_id for r in exact_dedup.drop_copies(docs, runs=runs).collect())
    finally:
        spark.conf.unset(setting)
    assert got == {i: (min(groups[t]), len(groups[t]), i == min(groups[t])) for i, t in rows}
    assert kept == sorted(map(min, groups.values()))


def test_a_run_out_of_order_is_an_error():
    keys = np.array([b"b" * 48, b"a" * 48], "S48")
    with pytest.raises(ValueError, match="ascend"):
        list(exact_dedup.sent(0, 0, exact_dedup.Run(keys, exact_dedup.pa.array([1, 2], exact_dedup.pa.int64()), np.ones(2, np.int64)), 0, 1))


def test_runs_merge_without_a_sort():
    rng = np.random.default_rng(3)
    pa = exact_dedup.pa

    def run(n):
        keys = np.unique(np.frombuffer(rng.integers(0, 3, (n, 48), np.uint8).tobytes() if n < 40 else rng.bytes(48 * n), "S48"))
        return exact_dedup.Run(keys, pa.array([int(x) if x else None for x in rng.integers(0, 9, len(keys))], pa.int64()), rng.integers(1, 5, len(keys)))

    for a, b in [(0, 5), (5, 0), (30, 30), (1000, 700)]:
        x, y = run(a), run(b)
        if a == 1000:
            y = exact_dedup.Run(np.unique(np.concatenate([y.keys, x.keys[::3]])), None, None)
            y.ids, y.copies = pa.array(range(len(y)), pa.int64()), np.ones(len(y), np.int64)
        z = x.with_(y)
        want = {}
        for r in (x, y):
            for k, i, c in zip(r.keys.tolist(), r.ids.to_pylist(), r.copies.tolist()):
                old = want.get(k, (None, 0))
                want[k] = (min((v for v in (old[0], i) if v is not None), default=None), old[1] + c)
        assert list(zip(z.keys.tolist(), z.ids.to_pylist(), z.copies.tolist())) == [(k, *want[k]) for k in sorted(want)]


def test_exact_dedup_of_other_ids_and_names(spark):
    rows = [(f"d{i}", ["x  y", "x y", "z", None, ""][i % 5], i) for i in range(40)]
    got = exact_dedup.find_copies(spark.createDataFrame(rows, "doc_id string, text string, run int"), runs=3).collect()
    assert {(r.doc_id, r.keep_id, r.group_size) for r in got} == {(i, ["d0", "d0", "d12", "d13", "d13"][n % 5], [16, 16, 8, 16, 16][n % 5]) for i, _, n in rows}


def test_exact_dedup_of_nothing(spark):
    assert exact_dedup.find_copies(spark.createDataFrame([], SCHEMA)).count() == 0


# near dedup


def shingles(text):
    w = (text or "").encode().translate(bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))).split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute_components(rows):
    sets = {r[0]: shingles(r[1]) for r in rows}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in itertools.combinations(sorted(sets), 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= 85 * len(sets[a] | sets[b]):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in sets}


def near_rows():
    rng = random.Random(3)
    rows = rows_of(edge_texts())
    for g in range(12):
        base = [f"w{rng.randint(0, 400)}" for _ in range(rng.choice([30, 80, 200]))]
        for _ in range(rng.choice([2, 6, 25])):
            text = list(base)
            for _ in range(rng.randint(0, 3)):
                text[rng.randrange(len(text))] = f"x{rng.randint(0, 99)}"
            rows.append((len(rows), " ".join(text), "en", f"g{g}", 1))
    return rows


def test_near_dedup_equals_brute_force(spark):
    rows = near_rows()
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.find_near_copies(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == brute_components(rows)


def test_near_dedup_of_ids_with_several_texts(spark):
    """Rows that repeat an id are one document: their links join, an empty text too; other columns may have any name."""
    text = lambda k: " ".join(f"{k}{i}" for i in range(40))
    rows = [(3, text("l")), (7, text("l")), (7, text("m")), (9, text("m")), (7, None), (11, text("n")), (9, text("n")), (20, text("o"))]
    frame = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as id", "2 as node", "3 as root", "4 as _kept")
    got = {(r.doc_id, r.n_shingles, r.component_id) for r in near_dedup.find_near_copies(frame).collect()}
    assert got == {(3, 36, 3), (7, 36, 3), (7, 0, 3), (9, 36, 3), (11, 36, 3), (20, 36, 20)}
    assert sorted(r.doc_id for r in near_dedup.drop_near_copies(frame).collect()) == [3, 20]


def test_near_dedup_of_a_large_group(spark):
    """300 near copies of one text, some links only through others, beside near misses that share coordinates."""
    rng = random.Random(11)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for k in range(300):
        words = list(base)
        for at in rng.sample(range(120), 1 if k < 240 else 9):
            words[at] = f"x{k}_{at}"
        rows.append((k * 3, " ".join(words), "en", "g", 1))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.find_near_copies(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == brute_components(rows)


def test_near_misses_are_not_paired(spark):
    """4,000 texts that all agree by 0.84 and share 96 shingles: no post of a list is left to be compared."""
    common = " ".join(f"c{i}" for i in range(100))
    rows = [(k, common + " " + " ".join(f"u{k}_{i}" for i in range(9))) for k in range(4000)]
    texts = spark.createDataFrame(rows, "id long, text string")
    active = texts.selectExpr("id as node", "105L as n", "id as root")
    began = time.time()
    assert near_dedup.prefix_pairs(active, texts).count() == 0 and time.time() - began < 60


def test_near_dedup_nulls_and_repeats(spark):
    long = " ".join(f"q{i}" for i in range(40))
    rows = [(None, long, None, None, None), (7, long, "a", "b", 1), (7, long, "a", "b", 1), (8, None, None, None, None), (None, "only here", None, None, None)]
    got = sorted(((r.doc_id, r.component_id, r.kept) for r in near_dedup.find_near_copies(spark.createDataFrame(rows, SCHEMA)).collect()), key=str)
    assert got == sorted([(None, 7, False), (7, 7, True), (7, 7, True), (8, 8, True), (None, None, True)], key=str)
    assert near_dedup.find_near_copies(spark.createDataFrame([], SCHEMA)).count() == 0


# sharding


def test_sharding_law(spark):
    docs = table(spark, SF, "documents")
    got = sharding.shard_rows(docs, [1.0] * 16, [1.0] * 17).collect()
    assert len(got) == docs.count()
    for shard in range(16):
        assert sorted(r.slot for r in got if r.shard == shard) == list(range(sum(r.shard == shard for r in got)))
    assert all(r.grown_shard in (r.shard, 16) for r in got)
    text = {r.doc_id: (r.text or "").encode() for r in docs.collect()}
    assert all(r.size == len(text[r.doc_id]) + 1 and r.text_crc32 == zlib.crc32(text[r.doc_id]) for r in got)


def test_winning_bids_equal_brute_force(spark):
    """The bids worked out again in Python: Spark's xxhash64 of a long and an int, chained from the seed 42."""
    import struct

    import xxhash

    def hashed(key, shard):
        seed = 42 if key is None else xxhash.xxh64_intdigest(struct.pack("<q", key), 42)
        return xxhash.xxh64_intdigest(struct.pack("<i", shard), seed)

    def winner(key, weights):
        bids = [w / -math.log(((hashed(key, s) >> 11) + 0.5) / 2**53) for s, w in enumerate(weights)]
        return max(range(len(bids)), key=lambda s: (bids[s], -s))

    weights, grown = [1.0, 2.0, 0.5, 1.0], [1.0, 2.0, 0.5, 1.0, 3.0]
    frame = spark.createDataFrame([(i if i % 50 else None, f"t{i}") for i in range(600)], "doc_id long, text string")
    for r in sharding.shard_rows(frame, weights, grown).collect():
        assert (r.shard, r.grown_shard) == (winner(r.doc_id, weights), winner(r.doc_id, grown))


def test_sharding_weights_and_edges(spark, docs):
    many = spark.range(20000).selectExpr("id as doc_id", "cast(null as string) as text", "'x' as shard", "1 as part")
    got = sharding.shard_rows(many, [1.0, 3.0]).groupBy("shard").count().collect()
    share = {r[0]: r[1] / 20000 for r in got}
    assert abs(share[1] - 0.75) < 0.02
    assert sharding.shard_rows(docs.where("false"), [1.0] * 3).count() == 0
    clash = sharding.shard_rows(docs.selectExpr("*", "1 as size", "2 as slot", "3 as own", "4 as before"), [1.0] * 3)
    assert clash.columns == ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"] and clash.count() == docs.count()
    twice = spark.createDataFrame([(None, "a"), (None, "b"), (1, None), (1, None)], "doc_id long, text string")
    rows = sharding.shard_rows(twice, [1.0] * 4).collect()
    assert len(rows) == 4 and len({r.shard for r in rows if r.doc_id is None}) == 1


# byte-level BPE


def test_bpe_equals_tiktoken(spark, docs):
    import base64

    import tiktoken

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(9)
    extra = ["".join(rng.choice(["a", "th", "é", "漢", "😀", " ", "\n", "\t", "1", "!", "'s", "\u00a0", "\x85", "\x1c", "\u2028", "<|endoftext|>"]) for _ in range(n)) for n in [1, 2, 3, 50, 400] * 8]
    extra += ["a" * 3000, "ab" * 700, " " * 1000, "aaab" * 65, "x" * 255 + " " + "x" * 256 + " " + "x" * 257]
    frame = docs.unionByName(spark.createDataFrame(rows_of(extra), SCHEMA))
    out = bpe.encode(frame.withColumn("bpe", frame.lang), path, public_tokenizers.PATTERN)
    for r in bpe.decode(out.selectExpr("text", "bpe_.*"), path).collect():
        want = enc.encode_ordinary(r.text or "")
        assert r.ids == want, repr(r.text)[:80]
        assert r.n_tokens == len(want) and r.ids_sha256 == hashlib.sha256(" ".join(map(str, want)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256((r.text or "").encode()).hexdigest() and bytes(r.decoded) == (r.text or "").encode()


def brute_bpe(piece, ranks):
    t = [bytes([b]) for b in piece]
    while True:
        rank, i = min(((ranks.get(t[i] + t[i + 1], 1 << 40), i) for i in range(len(t) - 1)), default=(1 << 40, 0))
        if rank == 1 << 40:
            return [ranks[x] for x in t]
        t[i : i + 2] = [t[i] + t[i + 1]]


def test_long_pieces_equal_brute_force_for_odd_vocabularies():
    """Vocabularies in which a merge may give a pair of smaller rank; pieces over several rows, and runs across rows."""
    for seed in range(8):
        rng = random.Random(seed)
        tokens = [bytes([b]) for b in range(256)] + sorted({bytes(rng.choice(b"abc") for _ in range(rng.randint(2, 6))) for _ in range(60)}, key=lambda _: rng.random())
        own = bpe.Vocabulary(tokens)
        ranks = {t: i for i, t in enumerate(tokens)}
        pieces = [bytes(rng.choice(b"abc") for _ in range(rng.randint(257, 500))) for _ in range(3)] + [b"a" * 300, b"ab" * 160 + b"c"]
        assert own.encode_pieces(pieces) == [brute_bpe(p, ranks) for p in pieces]


def test_bpe_of_nothing(spark, docs):
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    none = bpe.encode(docs.where("false"), path, public_tokenizers.PATTERN)
    assert none.count() == 0 and bpe.decode(none.selectExpr("bpe.*"), path).count() == 0


# url filters


def test_url_parts_and_rules(spark):
    urls = [None, "", "nohost", "http://A.Example.NET/en/x?q#f", "x://net/", "x://net", "http://a.net?x://b", "ftp://b.example.com/de/1", "http://z.org/fr/", "http://notorg/fr/", "a://b://c/d"]
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id long, url string")
    none = spark.createDataFrame([], "host string, bad int")
    got = {r.page_id: r for r in url_reputation.judge(pages, none).collect()}
    assert [(got[i].host, got[i].path, got[i].rule, got[i].verdict) for i in range(len(urls))] == [
        ("", "", None, "allow"), ("", "", None, "allow"), ("", "", None, "allow"), ("a.example.net", "/en/x", "example.net/en/", "allow"),
        ("net", "/", "net/", "block"), ("net", "", None, "allow"), ("a.net", "", None, "allow"), ("b.example.com", "/de/1", "example.com/de/", "block"),
        ("z.org", "/fr/", "org/fr/", "allow"), ("notorg", "/fr/", None, "allow"), ("b:", "//c/d", None, "allow"),
    ]


def test_bad_host_is_blocked_and_small_one_shrunk(spark):
    rows = [("bad.a.com", 1)] * 60 + [("good.a.com", 0)] * 300 + [("few.a.com", 1)] * 1 + [("other.b.com", 0)] * 300 + [("unseen.b.com", None)]
    got = {r.host: r for r in url_reputation.reputations(spark.createDataFrame(rows, "host string, bad int")).collect()}
    assert got["bad.a.com"].blocked and not got["good.a.com"].blocked and not got["few.a.com"].blocked and not got["unseen.b.com"].blocked
    assert got["few.a.com"].rate < 1 and got["unseen.b.com"].n == 0


def test_levels_of_hosts(spark):
    hosts = ["", "com", "a.b.com", "x.co.uk", "www.x.co.uk", "co.uk", "u:p@a.b.org:8080", "10.0.0.1:80", "[::1]", "b.com."]
    frame = spark.createDataFrame([(h,) for h in hosts], "host string")
    got = [tuple(r) for r in frame.select(*url_reputation.levels_of(frame.host)).collect()]
    assert got == [("", ""), ("com", "com"), ("b.com", "com"), ("x.co.uk", "co.uk"), ("x.co.uk", "co.uk"), ("co.uk", "co.uk"), ("b.org", "org"), ("10.0.0.1", "10.0.0.1"), ("[::1]", "[::1]"), ("com.", "")]


def test_url_query_with_odd_pages_equals_its_sql(spark, tmp_path):
    """Null urls, no host, no number, numbers too long for an id, an empty table: the registered query against its SQL."""
    import duckdb
    from treescan.llm import queries

    urls = [None, "", "nohost", "http://a.b.org/en/page", "http://a.b.org/en/" + "9" * 30, "http://u@a.b.org:80/en/1.html", "http://10.0.0.1/en/2.html"] * 2
    urls += [f"http://bad.b.org/en/{i}.html" for i in range(40)] + [f"http://good.c.co.uk/en/{i}.html" for i in range(40, 80)]
    for n in (len(urls), 0):
        d = tmp_path / str(n)
        spark.createDataFrame([(i, u, 1) for i, u in enumerate(urls[:n])], "page_id long, url string, Host int").write.parquet(f"{d}/pages.parquet")
        spark.createDataFrame([(i, int(i >= 40), 0) for i in range(80)] + [(None, 0, 0), (3, None, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
        con = duckdb.connect()
        for t in ("pages", "labels"):
            con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{d}/{t}.parquet/*.parquet')")
        want = con.sql(queries.ORACLES["op9_url_filters"]).fetchall()
        got = [tuple(r) for r in queries.op9_url_filters(spark, str(d)).collect()]
        assert len(got) == n and sorted(got) == sorted(want)
        assert n == 0 or {r[4] for r in got if r[1] == "bad.b.org"} == {"block"}


# mixing


def brute_deviation(order, weights):
    total = sum(weights.values())
    seen = dict.fromkeys(weights, 0)
    worst = 0.0
    for t, s in enumerate(order, 1):
        seen[s] += 1
        worst = max(worst, *(abs(seen[x] - t * w / total) for x, w in weights.items()))
    return worst


@pytest.mark.parametrize("weights", [{"a": 5, "b": 1, "c": 1, "d": 1, "e": 1, "f": 1}, {"a": 1}, {"a": 7, "b": 11, "c": 3}, {f"s{i}": i + 1 for i in range(12)}])
def test_period_stays_within_one_block(weights):
    order = sorted(weights, key=lambda s: (-weights[s], s))
    at, n = mixing.phase_slots(order, weights, sum(weights.values()), dict.fromkeys(weights, 10**9), 10**6)
    taken = {k: s for s, x in at.items() for k in x}
    assert n == len(taken) == sum(weights.values()) and all(len(at[s]) == w for s, w in weights.items())
    assert brute_deviation([taken[k % n] for k in range(2 * n)], weights) < 1


def test_weights_are_exact():
    third, f = mixing.Fraction(1, 3), mixing.Fraction
    assert mixing.whole_weights({"a": 1 / 3, "b": 2 / 3}) == {"a": 1, "b": 2}
    assert mixing.whole_weights({"a": 0.99999, "b": 0.00001}) == {"a": 99_999, "b": 1}
    assert mixing.whole_weights({"a": third, "b": 0.5, "c": 7}) == {"a": 2, "b": 3, "c": 42}
    rng = random.Random(2)
    given = {f"s{i}": rng.random() for i in range(50)}
    whole, total = mixing.whole_weights(given), sum(map(f, given.values()))
    assert all(f(whole[s], sum(whole.values())) == f(w) / total for s, w in given.items())
    for bad in (0.0, -1.0, math.inf, math.nan):
        with pytest.raises(ValueError):
            mixing.whole_weights({"a": 1.0, "b": bad})


def test_deviation_from_the_given_weights_over_many_rows():
    """10^6 rows, blocks of one row, weights without a short period: each prefix of the first phase is within a block."""
    rng = random.Random(8)
    weights = {f"s{i}": rng.random() ** 3 + 1e-3 for i in range(7)}
    rows = {s: 10**6 for s in weights}
    at, n = mixing.phase_slots(sorted(weights, key=lambda s: (-weights[s], s)), whole := mixing.whole_weights(weights), sum(whole.values()), {**rows, max(weights, key=weights.get): 300_000}, 10**7)
    total = sum(weights.values())
    assert n > 300_000
    for s, slots in at.items():
        x, j = np.array(slots), np.arange(len(slots))
        # just before and just after each block of the source
        assert (j - x * (weights[s] / total) > -1 - 1e-6).all() and ((j + 1) - (x + 1) * (weights[s] / total) < 1 + 1e-6).all()


def test_many_sources_plan_in_time():
    rng = random.Random(4)
    rows = {f"s{i}": rng.randint(1, 30) for i in range(10_000)}
    phases = mixing.plan(rows, mixing.whole_weights({s: rng.random() for s in rows}), 1)
    taken = sorted(slot0 + k for x in phases.values() for (_, _, slot0, _, period, n, slots, *_) in x for k in slots)
    assert taken == list(range(sum(rows.values())))
    with pytest.raises(ValueError):
        mixing.plan({"a": 10**9, "b": 10**9}, mixing.whole_weights({"a": 0.123456789, "b": 1.0}), 1, most=1000)


def test_mix_places_every_row(spark):
    sizes, weights, b = {"a": 100, "b": 37, "": 5, "d": 250}, {"a": 0.5, "b": 0.2, "": 0.2, "d": 0.1}, 4
    rows = [(i, "t", "en", s or None, 1) for i, s in enumerate(s for s, n in sizes.items() for _ in range(n))]
    docs = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as mix", "2 as _mix0", "3 as _mix_3", "4 as _before", "5 as count")
    out = mixing.mix(docs, weights, block_rows=b)
    got = sorted(out.collect(), key=lambda r: r.mix_.position)
    assert [r.mix_.position for r in got] == list(range(len(rows)))
    assert all(r.mix_.release <= r.mix_.slot < r.mix_.deadline for r in got)
    first = [r for r in got if r.mix_.phase == 0]
    blocks = {r.mix_.slot: r.source or "" for r in first}
    assert brute_deviation([blocks[k] for k in sorted(blocks)], mixing.whole_weights(weights)) < 1
    assert [r.doc_id for r in mixing.in_order(out).collect()] == [r.doc_id for r in got]
    assert mixing.mix(docs.where("false")).count() == 0
    same = docs.limit(50).selectExpr("cast(null as long) as doc_id", "text", "source").unionAll(docs.selectExpr("1L as doc_id", "concat(text, doc_id) as text", "source"))
    assert sorted(r[0] for r in mixing.mix(same, block_rows=3).select("mix.position").collect()) == list(range(50 + len(rows)))
    with pytest.raises(ValueError):
        mixing.mix(docs, {"a": 1.0})
