"""MinHash near-dedup: an inverted join over the coordinates of signatures.

A text's set is its distinct 5-word shingles (hashed to 64 bits). A base signature has ROWS * COORDINATES minima; each
coordinate joins ROWS of them, so two texts of similarity s agree on one with probability s ** ROWS. Texts are posted
under the coordinate-value pairs of a prefix: to agree on MATCHES of all coordinates, two texts must agree on one of any
COORDINATES - MATCHES + 1. Pairs of at least MATCHES collisions are retained, counted with the coordinates that the prefix
skips read off the signatures, and confirmed on the full sets. At similarity 0.85 a pair
is missed with a probability of about 2e-6.

No group's pairs are all written out. Equal sets are one node. First every text is tried with the one pivot (the
smallest id of a posting list) it collides with most, and what is linked so becomes a component. Lists that hold several
components take other pivots in further rounds, while these link enough. Then only lists that still hold several
components are looked at. Their texts are posted under their rarest shingles, as many as a link
leaves free to differ, and two are paired where both still have enough shingles after the places where they meet; the
pairs' collisions are counted on the signatures and MATCHES or more go on to the full sets. So a large group of near
copies costs a pair for each member, near misses are not paired, and no link between components is lost.

Null and empty texts have no shingles and no links. Rows that repeat an id are one document, with the links of all their
texts. Rows without id take part in no link; among equal sets they get the component of those with an id, else null.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from treescan.llm.common import LOWER, chunks, free_name, materialize, small_batches, word_hashes

SHINGLE = 5
ROWS, COORDINATES, MATCHES = 6, 40, 3
PREFIX = COORDINATES - MATCHES + 1
#: Link where LINK[0] * intersection >= LINK[1] * union.
LINK = (100, 85)
#: Of the base signature, the share that must agree; 0.85 less six standard deviations.
LEAST_SHARE = 0.7

_RNG = np.random.default_rng(20240611)
_A = (_RNG.integers(0, 2**31, ROWS * COORDINATES, np.uint32) << 1) | np.uint32(1)
_B = _RNG.integers(0, 2**32, ROWS * COORDINATES, np.uint32)
_M = _RNG.integers(0, 2**63, SHINGLE, np.uint64) * np.uint64(2) + np.uint64(1)

SKETCH = T.StructType([T.StructField("n_shingles", T.LongType()), T.StructField("set_key", T.BinaryType()), T.StructField("coordinates", T.ArrayType(T.LongType())), T.StructField("base", T.BinaryType())])


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def shingle_sets(texts: list[bytes]) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each UTF-8 text, lower-cased in A-Z."""
    words = [t.translate(LOWER).split() for t in texts]
    flat = pa.array([w for x in words for w in x], pa.large_binary())
    if not len(flat):
        return [np.zeros(0, np.uint64)] * len(texts)
    coded = flat.dictionary_encode()
    h = word_hashes(coded.dictionary.to_pylist())[coded.indices.to_numpy()]
    windows = np.zeros(max(0, len(h) - SHINGLE + 1), np.uint64)
    for k in range(SHINGLE):
        windows += h[k : len(h) - SHINGLE + 1 + k] * _M[k]
    windows = _mixed(windows)
    out, at = [], 0
    for x in words:
        n = len(x)
        if n >= SHINGLE:
            own = np.sort(windows[at : at + n - SHINGLE + 1])
            out.append(own[np.append(True, own[1:] != own[:-1])])
        elif n:
            out.append(_mixed(np.array([xxhash.xxh3_64_intdigest(b" ".join(x), seed=n)], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
        at += n
    return out


def base_signature(shingles: np.ndarray) -> np.ndarray:
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    least = np.full(len(_A), 2**32 - 1, np.uint32)
    for k in range(0, len(x), 2048):
        h = np.multiply.outer(_A, x[k : k + 2048])
        h += _B[:, None]
        np.minimum(least, h.min(axis=1), out=least)
    return least


def coordinates_of(bases: np.ndarray) -> np.ndarray:
    """The coordinate-value pairs of base signatures (a row each) as one number each."""
    h = np.repeat(np.arange(COORDINATES, dtype=np.uint64)[None, :], len(bases), axis=0)
    for k in range(ROWS):
        h = _mixed(h * np.uint64(0x9E3779B97F4A7C15) + bases[:, k::ROWS].astype(np.uint64) + np.uint64(k))
    return h.view(np.int64)


@F.arrow_udf(SKETCH)
def sketch(text: pa.Array) -> pa.Array:
    texts = text.fill_null("").cast(pa.binary()).to_pylist()
    n, keys, bases = [], [], []
    for a, b in chunks(texts):
        for s in shingle_sets(texts[a:b]):
            n.append(len(s))
            keys.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
            bases.append(base_signature(s))
    stacked = np.array(bases, np.uint32).reshape(-1, len(_A))
    values = pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1) * COORDINATES, pa.int32()), pa.array(coordinates_of(stacked).reshape(-1), pa.int64()))
    low = [row.tobytes() for row in (stacked & np.uint32(255)).astype(np.uint8)]
    return pa.StructArray.from_arrays([pa.array(n, pa.int64()), pa.array(keys, pa.binary()), values, pa.array(low, pa.binary())], SKETCH.names)


@F.arrow_udf(T.ArrayType(T.LongType()))
def shingle_hashes(text: pa.Array) -> pa.Array:
    texts = text.fill_null("").cast(pa.binary()).to_pylist()
    return pa.array([s.view(np.int64) for a, b in chunks(texts) for s in shingle_sets(texts[a:b])], pa.list_(pa.int64()))


@F.arrow_udf(T.BooleanType())
def may_link(a: pa.Array, b: pa.Array) -> pa.Array:
    """Whether two base signatures agree on MATCHES coordinates and on LEAST_SHARE of all minima."""
    x, y = (np.frombuffer(b"".join(c.to_pylist()), np.uint8).reshape(-1, len(_A)) for c in (a, b))
    same = x == y
    # base j belongs to coordinate j // ROWS, as coordinates_of reads them
    matches = same.reshape(-1, COORDINATES, ROWS).all(axis=2).sum(axis=1)
    return pa.array((matches >= MATCHES) & (same.sum(axis=1) >= LEAST_SHARE * len(_A)), pa.bool_())


@F.arrow_udf(T.BooleanType())
def linked(a: pa.Array, b: pa.Array) -> pa.Array:
    """Whether the full shingle sets of two texts link."""
    one, two = (c.fill_null("").cast(pa.binary()).to_pylist() for c in (a, b))
    out: list[bool] = []
    for lo, hi in chunks([x if len(x) > len(y) else y for x, y in zip(one, two, strict=True)], 4_000_000):
        for x, y in zip(shingle_sets(one[lo:hi]), shingle_sets(two[lo:hi]), strict=True):
            both = len(np.intersect1d(x, y, assume_unique=True))
            out.append(both > 0 and LINK[0] * both >= LINK[1] * (len(x) + len(y) - both))
    return pa.array(out, pa.bool_())


def components(edges: DataFrame) -> DataFrame:
    """Edges (a, b) to (node, root), root the smallest node reachable: large-star and small-star rounds until stable."""
    edges = materialize(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct(), "edges")
    mark = None
    while True:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("m").alias("a"), F.col("v").alias("b")).union(least.select(F.col("m").alias("a"), F.col("u").alias("b"))).distinct()
        edges = materialize(small, "edges")
        new = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if new == mark:
            return edges.select(F.col("b").alias("node"), F.col("a").alias("root"))
        mark = new


def confirmed(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Of pairs (a, b), those whose full sets link; texts: id, text."""
    one = pairs.join(texts.select(F.col("id").alias("a"), F.col("text").alias("text_a")), "a")
    two = one.join(texts.select(F.col("id").alias("b"), F.col("text").alias("text_b")), "b")
    return two.where(linked("text_a", "text_b")).select("a", "b")


def prefix_pairs(active: DataFrame, texts: DataFrame) -> DataFrame:
    """Pairs (a, b) of active documents (node, n, root) in different components that can still link.

    Shingles are put in order of rarity among the active documents. The first shingle that a pair has in common stands
    at a place after which both sets must hold the whole intersection, so only the first 15 in 100 shingles of a set are
    posted, and two of a list are paired only if enough is left of both after their places.
    """
    text = F.when(F.col("root").isNotNull(), F.col("text"))  # keeps the function above the join
    text = texts.join(active, texts["id"] == active["node"]).select("node", "n", "root", shingle_hashes(text).alias("all"))
    own = materialize(text.select("node", "n", "root", F.explode("all").alias("shingle")), "shingles")
    # a shingle that one document has pairs nothing: it only takes a place
    common = own.groupBy("shingle").agg(F.count("*").alias("seen")).where("seen > 1")
    placed = own.join(common, "shingle").withColumn("left", F.count("*").over(Window.partitionBy("node")) - F.row_number().over(Window.partitionBy("node").orderBy("seen", "shingle")) + 1)
    posts = materialize(placed.where(LINK[0] * F.col("left") >= LINK[1] * F.col("n")).select("shingle", "node", "n", "root", "left"), "prefixes")
    of_root = posts.groupBy("shingle", "root").agg(F.count("*").alias("count"), F.min("n").alias("least_n"))
    major = of_root.groupBy("shingle").agg(F.max(F.struct("count", "root")).alias("x"), F.count("*").alias("roots"), F.min("least_n").alias("least_n")).where("roots > 1").select("shingle", F.col("x.root").alias("major"), "least_n")
    # written before the joins on shingle, so that AQE can split the shuffles of a frequent shingle
    # what can't even link with the smallest set of a list is compared with none of it
    mixed = posts.join(materialize(major, "major"), "shingle").where(sum(LINK) * F.col("left") >= LINK[1] * (F.col("n") + F.col("least_n")))
    mixed = materialize(mixed.drop("least_n"), "mixed")
    one = mixed.where("root <> major").select("shingle", F.col("node").alias("x"), F.col("n").alias("nx"), F.col("root").alias("rx"), F.col("left").alias("lx"))
    two = mixed.select("shingle", F.col("node").alias("y"), F.col("n").alias("ny"), F.col("root").alias("ry"), F.col("left").alias("ly"), "major")
    enough = sum(LINK) * F.least("lx", "ly") >= LINK[1] * (F.col("nx") + F.col("ny"))
    met = one.join(two, (one["shingle"] == two["shingle"]) & (F.col("rx") != F.col("ry")) & ((F.col("ry") == F.col("major")) | (F.col("x") < F.col("y"))) & enough)
    return met.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def _mixed_lists(posts: DataFrame) -> DataFrame:
    """The posts of lists that hold several components."""
    mixed = posts.groupBy("post").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("post")
    return posts.join(mixed, "post", "left_semi")


def more_pivots(live: DataFrame, texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Further rounds with other pivots: each list with several components takes one of its largest component, by a hash
    that changes with the round, and every document of the others tries the pivot that it collides with most. Goes on
    while a tenth of the tried documents link. live with the roots then, and what roots became (root, top)."""
    names = live.select("root", F.col("root").alias("top")).where("false")
    turn = 0
    while True:
        turn += 1
        of_root = live.groupBy("post", "root").agg(F.count("*").alias("members"), F.min_by("node", F.xxhash64("node", F.lit(turn))).alias("pivot"))
        pivots = of_root.groupBy("post").agg(F.max(F.struct("members", "root", "pivot")).alias("p"), F.count("*").alias("roots")).where("roots > 1").select("post", F.col("p.root").alias("pivot_root"), "p.pivot")
        tries = live.join(pivots, "post").where("root <> pivot_root").groupBy("node", "pivot").agg(F.count("*").alias("collisions"))
        best = tries.groupBy("node").agg(F.max(F.struct("collisions", "pivot")).alias("x")).where(F.col("x.collisions") >= MATCHES - 1)
        best = materialize(best.select(F.col("x.pivot").alias("a"), F.col("node").alias("b")), "tries")
        found = materialize(confirmed(best, texts), "found")
        tried, n = best.count(), found.count()
        if n:
            own = live.select("node", "root").distinct()
            edges = found.join(own.toDF("a", "root_a"), "a").join(own.toDF("b", "root_b"), "b").select(F.col("root_a").alias("a"), F.col("root_b").alias("b"))
            joined = materialize(components(edges).select(F.col("node").alias("root"), F.col("root").alias("top")), "joined")
            later = joined.toDF("old", "new")
            names = materialize(names.join(later, names["top"] == later["old"], "left").select("root", F.coalesce("new", "top").alias("top")).union(joined), "names")
            live = materialize(live.join(joined, "root", "left").select("post", "node", "n", F.coalesce("top", "root").alias("root")), "live_posts")
        if 10 * n < tried or not n:
            return live, names


def find_near_copies(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: id, n_shingles, component_id, kept."""
    small_batches(docs.sparkSession)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    rows = materialize(texts.withColumn("s", sketch("text")).select("id", "s.*"), "sketches")
    nodes = rows.where("n_shingles > 0 and id is not null").groupBy("set_key", "n_shingles").agg(F.min("id").alias("node"), F.first("coordinates").alias("coordinates"), F.first("base").alias("base"))
    nodes = materialize(nodes, "nodes")

    posts = nodes.select(F.explode(F.slice("coordinates", 1, PREFIX)).alias("post"), "node", F.col("n_shingles").alias("n"))
    lists = posts.groupBy("post").agg(F.min("node").alias("pivot"), F.count("*").alias("members")).where("members > 1").select("post", "pivot")
    posts = materialize(posts.join(lists, "post"), "posts")

    # only texts that meet others are sent to be compared
    texts = texts.join(posts.select(F.col("node").alias("id")).distinct(), "id", "left_semi")
    texts = materialize(texts, "node_texts")
    stars = posts.where("node <> pivot").groupBy("node", "pivot").agg(F.count("*").alias("collisions"))
    best = stars.groupBy("node").agg(F.max(F.struct("collisions", "pivot")).alias("x")).where(F.col("x.collisions") >= MATCHES - 1).select(F.col("x.pivot").alias("a"), F.col("node").alias("b"))
    roots = components(confirmed(best, texts))
    first = materialize(posts.join(roots, "node", "left").select("post", "node", "n", F.coalesce("root", "node").alias("root")), "posts_rooted")
    live, names = more_pivots(materialize(_mixed_lists(first), "live_posts"), texts)
    current = nodes.select("node").distinct().join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("root"))
    current = materialize(current.join(names, "root", "left").select("node", F.coalesce("top", "root").alias("root")), "roots_now")

    active = materialize(_mixed_lists(live).select("node", "n", "root").distinct(), "active")
    pairs = prefix_pairs(active, texts)
    sides = nodes.select("node", "base")
    pairs = pairs.join(sides.select(F.col("node").alias("a"), F.col("base").alias("base_a")), "a").join(sides.select(F.col("node").alias("b"), F.col("base").alias("base_b")), "b").where(may_link("base_a", "base_b")).select("a", "b").distinct()
    more = confirmed(materialize(pairs, "pairs"), texts)
    # the nodes of an id belong together
    of_id = materialize(rows.where("id is not null").select("id", "set_key").join(nodes.select("set_key", "node"), "set_key").select("id", "node").distinct(), "nodes_of_ids")
    several = of_id.groupBy("id").agg(F.min("node").alias("a"), F.max("node").alias("z")).where("a < z").select("id", "a")
    more = more.union(of_id.join(several, "id").where("node > a").select("a", F.col("node").alias("b")))
    root_of = lambda k: current.select(F.col("node").alias(k), F.col("root").alias(f"root_{k}"))
    across = more.join(root_of("a"), "a").join(root_of("b"), "b").select(F.col("root_a").alias("a"), F.col("root_b").alias("b"))
    joined = components(across).select(F.col("node").alias("root"), F.col("root").alias("top"))
    tops = nodes.select("set_key", "node").join(current, "node").join(joined, "root", "left").select("set_key", "node", F.coalesce("top", "root").alias("component"))
    by_id = of_id.join(tops.select("node", "component").distinct(), "node").groupBy("id").agg(F.min("component").alias("component"))
    named = rows.where("id is not null").join(by_id, "id", "left").select("id", "n_shingles", F.coalesce("component", "id").alias("component_id"))
    unnamed = rows.where("id is null").join(tops.select("set_key", "component"), "set_key", "left").select("id", "n_shingles", F.col("component").alias("component_id"))
    found = named.union(unnamed)
    return found.select(F.col("id").alias(id_col), "n_shingles", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))


def drop_near_copies(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs whose document stands for its component, with all their columns."""
    key = free_name(docs, "_kept")
    kept = find_near_copies(docs, id_col=id_col, text_col=text_col).where("kept").select(F.col(id_col).alias(key)).distinct()
    return docs.join(kept, docs[id_col].eqNullSafe(kept[key]), "left_semi")
