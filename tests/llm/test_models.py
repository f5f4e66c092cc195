"""LM scoring and toxicity against brute force, and held-out accuracy."""

import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from treescan.llm import importance, suffix_tree, toxicity
from treescan.llm.common import table

SF = "/root/testdata/sf0.01"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def tokens_of(text):
    low = (text or "").encode().translate(bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123))))
    return [*low.split(), b"\n"]


def small_docs():
    rng = np.random.default_rng(2)
    words = ["the", "of", "and", "cat", "dog", "runs", "Über"]
    texts = [None, "", " \n"]
    for i in range(60):
        n = int(rng.integers(1, 80))
        body = [words[int(k)] for k in rng.integers(0, len(words), n)]
        for k in range(0, n - 2, 7):
            body[k : k + 3] = ["new", "YORK", "city"]
        texts.append(" ".join(body + [f"rare{i}"] * (i % 3)))
    return [(i, t, "en", "s", 0) for i, t in enumerate(texts)] + [(None, "the cat", "en", "s", 0), (5, "the dog", "en", "s", 0)]


def brute_scores(rows, p_symbol=3.2e-5, min_count=2):
    """id and text to (held_out, n_tokens, n_known, N, base, score), by plain dictionaries."""
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 5 == 1
    train = [tokens_of(r[1]) for r in rows if not held(r[0])]
    c = Counter(t for x in train for t in x)
    n, v = sum(c.values()), len(c)
    own = {t for t in c if c[t] >= max(2.0, p_symbol * n)} | {b"\n"}
    sym = lambda t: t if t in own else None
    depth = suffix_tree.DEPTH
    counts = defaultdict(Counter)
    for x in train:
        line = [b"\n"] * depth + [sym(t) for t in x]
        for k in range(depth, len(line)):
            for d in range(depth + 1):
                counts[tuple(line[k - d : k])][line[k]] += 1
    states = {()}
    for ctx, follow in counts.items():
        total, up = sum(follow.values()), counts[ctx[1:]]
        if not ctx or total < min_count:
            continue
        gain = sum(k * math.log(k / total / (up[s] / sum(up.values()))) for s, k in follow.items())
        if gain > 0.5 * len(follow) * math.log(n):
            states.add(ctx)
    symbols = {*own, None}

    def prob(ctx, s):
        while ctx not in states:
            ctx = ctx[1:]
        if not ctx:
            return (counts[()][s] + 0.5) / (n + 0.5 * len(symbols))
        follow = counts[ctx]
        total, kinds = sum(follow.values()), len(follow)
        return (follow[s] + kinds * prob(ctx[1:], s)) / (total + kinds)

    for ctx in list(states)[:50]:
        assert abs(sum(prob(ctx, s) for s in symbols) - 1) < 1e-9
    others = n - sum(c[t] for t in own)
    unseen = max(0.5, sum(k == 1 for k in c.values()))
    out = []
    for r in rows:
        x = tokens_of(r[1])
        line = [b"\n"] * depth + [sym(t) for t in x]
        score = 0.0
        for k, t in enumerate(x):
            score += math.log10(prob(tuple(line[k : k + depth]), sym(t)))
            if sym(t) is None:
                score += math.log10((c[t] or unseen) / (others + unseen))
        out.append((r[0], held(r[0]), len(x), sum(t in c for t in x), n, sum(math.log10((c[t] + 0.5) / (n + 0.5 * (v + 1))) for t in x), score))
    return out


@pytest.mark.parametrize("p_symbol", [3.2e-5, 5e-3])
def test_scores_equal_brute_force(spark, p_symbol):
    rows = [*small_docs(), (7, "the cat of " * 20_000, "en", "s", 0)]
    frame = spark.createDataFrame(rows, SCHEMA).withColumn("block", F.lit(1)).withColumn("Score", F.lit(2))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # parts stay where their hash puts them
    got = suffix_tree.score_texts(frame.repartition(5, "doc_id"), p_symbol=p_symbol).collect()
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    key = lambda r: (str(r[0]), r[2], round(r[5], 6))
    assert len(got) == len(rows)
    for a, b in zip(sorted(got, key=key), sorted(brute_scores(rows, p_symbol), key=key), strict=True):
        assert tuple(a)[:5] == b[:5] and a.base_score == pytest.approx(b[5], abs=1e-9) and a.score == pytest.approx(b[6], rel=1e-6)


def test_numbers_survive_packing():
    rng = np.random.default_rng(1)
    x = np.sort(rng.integers(0, 2**64, 1000, np.uint64, endpoint=False))
    assert (suffix_tree.unpack_sorted(suffix_tree.pack_sorted(x), 1000) == x).all()
    for width in (1, 7, 30, 45):
        y = np.unique(rng.integers(0, 2**width, 500, np.uint64))
        z = suffix_tree.scattered(y, width)
        assert len(np.unique(z)) == len(y) and (z < 2**width).all() and (suffix_tree.scattered(z, width, back=True) == y).all()


def brute_ratios(rows, good):
    """Bucket of a feature, and log ratios by bucket, from the definition: 16 leading bits of word hashes and pair hashes."""
    import xxhash

    mask = (1 << 64) - 1

    def buckets(text):
        low = (text or "").encode().translate(bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123))))
        h = [xxhash.xxh3_64_intdigest(w) for w in low.split()]
        pairs = [((a * 0x9E3779B97F4A7C15) & mask) ^ ((b * 0xC2B2AE3D27D4EB4F) & mask) for a, b in zip(h, h[1:])]
        return [x >> 48 for x in h + pairs]

    raw, target = Counter(), Counter()
    for i, t, *_ in rows:
        raw.update(buckets(t))
        if i in good:
            target.update(buckets(t))
    n = importance.BUCKETS
    all_raw, all_target = sum(raw.values()) + n, sum(target.values()) + n
    return buckets, lambda b: math.log((target[b] + 1) / all_target) - math.log((raw[b] + 1) / all_raw)


def test_importance_against_brute_force(spark):
    texts = ["good words here"] * 40 + ["Bad %% junk %%"] * 20 + [None, "", "good words here again", "long " * 60_000]
    rows = [(i, t, "en", "s", 0) for i, t in enumerate(texts)] + [(3, "good words here", "en", "s", 0)] + [(None, f"no id {i}", "en", "s", 0) for i in range(30)]
    labels = spark.createDataFrame([(i, int(i < 40), 0) for i in range(0, 60, 2)] + [(None, 1, 0), (1, None, 0)], "doc_id long, quality int, toxic int")
    docs = spark.createDataFrame(rows, SCHEMA)
    buckets, ratio = brute_ratios(rows, set(range(0, 40, 2)))
    for k in (1, 40, len(rows) - 1, len(rows), len(rows) + 5):
        out = importance.resample(docs.withColumn("importance", F.lit(0)).withColumn("_weightk", F.lit(1)), labels, k=k)
        got = out.select("doc_id", "text", "importance_.*").collect()
        kept = sorted((r.key for r in got if r.kept), reverse=True)
        assert kept == sorted((r.key for r in got), reverse=True)[:k] and len(kept) == min(k, len(rows))
    assert len(got) == len(rows)
    for r in got:
        assert r.log_weight == pytest.approx(sum(map(ratio, buckets(r.text))), abs=1e-6, rel=1e-9)
    assert len({r.key - r.log_weight for r in got if r.doc_id is None}) == 30
    assert importance.resample(docs.where("false"), labels).count() == 0
    assert importance.resample(docs, labels.where("false")).where("importance.kept").count() == len(rows)


def test_exactly_k_of_equal_rows(spark):
    docs = spark.createDataFrame([(1, "same text here", "en", "s", 0)] * 50, SCHEMA)
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    assert importance.resample(docs, labels, k=10).where("importance.kept").count() == 10


def test_gumbel_top_k_follows_the_weights(spark):
    """With weights 1 : 3 and one draw, the heavy row is drawn about three times in four."""
    keys = spark.range(4000).select("id", importance.gumbel(F.col("id"), 1).alias("a"), (importance.gumbel(F.col("id"), 2) + F.log(F.lit(3.0))).alias("b"))
    assert abs(keys.agg(F.avg((F.col("b") > F.col("a")).cast("double"))).first()[0] - 0.75) < 0.03


def test_scores_of_nothing(spark):
    assert suffix_tree.score_texts(spark.createDataFrame([], SCHEMA)).count() == 0
    held = next(i for i in range(99) if zlib.crc32(str(i).encode()) % 5 == 1)
    r = suffix_tree.score_texts(spark.createDataFrame([(held, "only held out", "en", "s", 1)], SCHEMA)).first()
    assert r.train_tokens == 0 and r.n_known == 0 and math.isfinite(r.score)


def test_model_beats_unigrams_on_held_out_texts(spark):
    r = suffix_tree.score_texts(table(spark, SF, "documents")).where("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert r[0] > r[1]


# toxicity


def test_nearest_equal_brute_force():
    rng = np.random.default_rng(4)
    n, terms = 400, 30
    vectors = [{int(t): float(rng.integers(1, 4)) for t in rng.choice(terms, int(rng.integers(1, 6)), replace=False)} for _ in range(n)]
    idf = rng.random(terms) + 0.5
    index = toxicity.Index(toxicity.pa.array(np.arange(n) * 3), rng.integers(0, 2, n), vectors, idf)

    def unit(v):
        w = np.zeros(terms)
        for t, c in v.items():
            w[t] = (1 + math.log(c)) * idf[t]
        return w / np.sqrt((w * w).sum())

    dense = np.array([unit(v) for v in vectors])
    for q in vectors[:80]:
        cosines = dense @ unit(q)
        want = [r for r in np.lexsort((np.arange(n), -np.round(cosines, 12))) if cosines[r] > 0][: toxicity.K]
        rows, got = index.nearest(q)
        assert index.ids.take(toxicity.pa.array(rows)).to_pylist() == [3 * r for r in want] and np.allclose(got, cosines[want])


def test_nearest_by_posting_lists_equal_brute_force(monkeypatch):
    """With few frequent terms the rest goes by block maxima and posting lists."""
    monkeypatch.setattr(toxicity, "DENSE", 3)
    test_nearest_equal_brute_force()


def test_every_term_of_the_examples_is_compared(spark):
    """Texts without any telling term meet the examples whose words they have; a copy with the other label stays."""
    words = ["apple", "bridge", "cloud", "drum", "engine", "forest"]
    mine = [i for i in range(400) if zlib.crc32(str(i).encode()) % 3 != 1][:12]
    rows = [(i, f"{words[k // 2]} only{k // 2} seen{k // 2}") for k, i in enumerate(mine)]
    asked = [(1_000 + k, f"{w} alone") for k, w in enumerate(words)]
    labels = spark.createDataFrame([(i, k % 2) for k, i in enumerate(mine)], "doc_id long, toxic int")
    got = toxicity.score_texts(spark.createDataFrame(rows + asked, "doc_id long, text string"), labels).collect()
    nearest = {r.doc_id: set(r.toxicity.nearest) for r in got}
    assert [nearest[1_000 + k] for k in range(6)] == [{mine[2 * k], mine[2 * k + 1]} for k in range(6)]


def brute_toxicity(rows, labels):
    """Scores of (id, text) rows from the definition, with plain dictionaries; ids of both are text or numbers."""
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 3 == 1
    terms = {k: toxicity.terms_of(t or "") for k, (_, t) in enumerate(rows)}
    first = {}
    for k, (i, _) in enumerate(rows):
        first.setdefault(i, k)
    toxic = {i: max(t for j, t in labels if j == i and t is not None) for i, t in labels if i is not None and t in (0, 1)}
    ex = sorted(i for i in toxic if not held(i) and i in first)
    kept = []
    for i in ex:
        own = set(terms[first[i]])
        if not any(toxic[k] == toxic[i] and len(own & set(terms[first[k]])) >= 0.85 * len(own | set(terms[first[k]])) for k in kept):
            kept.append(i)
    vocabulary = {t for i in ex for t in terms[first[i]]}
    df = Counter(t for c in terms.values() for t in c if t in vocabulary)
    pos, n = sum(toxic[i] for i in kept), len(kept)
    weight = {}
    for t in vocabulary:
        d, a = sum(t in terms[first[i]] for i in kept), sum(t in terms[first[i]] and toxic[i] for i in kept)
        part = lambda seen, expected: seen * math.log(seen / expected) if seen > 0 else 0.0
        g2 = 2 * (part(a, d * pos / n) + part(d - a, d * (n - pos) / n) + part(pos - a, (n - d) * pos / n) + part(n - pos - d + a, (n - d) * (n - pos) / n))
        weight[t] = (math.log((1 + len(rows)) / (1 + df[t])) + 1) * (1 + (max(g2, 0) if a * n > d * pos else 0))
    unit = {}
    for k, c in terms.items():
        w = {t: (1 + math.log(m)) * weight[t] for t, m in c.items() if t in vocabulary}
        norm = math.sqrt(sum(x * x for x in w.values()))
        unit[k] = {t: x / norm for t, x in w.items()} if norm else {}
    base = pos / n

    def vote(k, without=None):
        near = [(round(-sum(x * unit[first[i]].get(t, 0) for t, x in unit[k].items()), 12), j) for j, i in enumerate(kept) if i != without]
        near = sorted(x for x in near if x[0] < 0)[: toxicity.K]
        if not near:
            return 0.0, []
        return (sum(-c * toxic[kept[j]] for c, j in near) + toxicity.PRIOR_WEIGHT * base) / (sum(-c for c, _ in near) + toxicity.PRIOR_WEIGHT), [kept[j] for _, j in near]

    steps = toxicity.isotonic(np.array([vote(first[i], i)[0] for i in kept]), np.array([float(toxic[i]) for i in kept]))
    out = []
    for k, (i, _) in enumerate(rows):
        v, near = vote(k)
        out.append((i, float(np.clip(np.interp(v, *steps), 0, 1)), near))
    return out


@pytest.mark.parametrize("kind", ["long", "string"])
def test_toxicity_equals_brute_force(spark, kind):
    rng = np.random.default_rng(6)
    words = ["sun", "river", "bridges", "garden", "quiet", "market", "stupid", "worthless", "idiots", "vile"]
    make = str if kind == "string" else int
    rows, labels = [], []
    for i in range(120):
        bad = i % 4 == 0
        body = rng.choice(words[5:] if bad else words[:8], int(rng.integers(2, 12))).tolist()
        rows.append((make(i), " ".join([*body, f"only{i}"])))
        if i < 90:
            labels.append((make(i), int(bad)))
    rows += [(make(500), rows[0][1]), (make(501), None), (make(502), ""), (None, "vile idiots"), (make(503), "?? 12"), (make(504), "vile " * 30_000)]
    labels += [(make(500), 1), (None, 1), (make(3), None)]
    frame = spark.createDataFrame(rows, f"doc_id {kind}, text string").withColumn("Toxicity", F.lit(1))
    out = toxicity.score_texts(frame, spark.createDataFrame(labels, f"doc_id {kind}, toxic int"))
    got = {str(r.doc_id): r for r in out.select("doc_id", F.col(f"{out.columns[-1]}.*")).collect()}
    assert len(got) == len(rows)
    for i, score, near in brute_toxicity(rows, labels):
        r = got[str(i)]
        assert r.score == pytest.approx(score, abs=1e-9) and r.nearest == near and r.predicted == (score >= 0.7), i
    assert toxicity.score_texts(frame.where("false"), spark.createDataFrame(labels, f"doc_id {kind}, toxic int")).count() == 0


def test_isotonic_is_monotone():
    x, y = toxicity.isotonic(np.array([0.1, 0.2, 0.2, 0.3, 0.9]), np.array([0.0, 1.0, 0.0, 0.0, 1.0]))
    assert (np.diff(y) > 0).all() and (np.diff(x) > 0).all() and y[-1] == 1


def test_held_out_accuracy_and_edges(spark):
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    odd = spark.createDataFrame([(900_001, None), (900_002, ""), (None, "nothing of note"), (900_003, "x " * 50_000)], "doc_id long, text string")
    out = toxicity.score_texts(docs.select("doc_id", "text").union(odd).withColumn("toxicity", F.lit(1)), labels)
    assert out.columns[-1] == "toxicity_"
    rows = out.select("doc_id", "toxicity_.*", (~toxicity.in_training("doc_id")).alias("held_out")).collect()
    assert len(rows) == docs.count() + 4 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)
    truth = {r.doc_id: r.toxic for r in labels.collect()}
    held = [(truth[r.doc_id], r.predicted) for r in rows if r.held_out and r.doc_id in truth]
    hit, said, real = sum(t & p for t, p in held), sum(p for _, p in held), sum(t for t, _ in held)
    assert hit >= 0.9 * said and hit >= 0.6 * real
    assert all(r.nearest and len(r.nearest) == len(r.cosines) for r in rows if r.predicted)


def test_toxicity_without_labels(spark):
    docs = table(spark, "/root/testdata/sf0.001", "documents").select("doc_id", "text").limit(5)
    none = spark.createDataFrame([(1, None), (None, 1)], "doc_id long, toxic int")
    assert {r.toxicity.score for r in toxicity.score_texts(docs, none).collect()} == {0.0}
