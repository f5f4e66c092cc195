"""Toxicity by the nearest labelled examples, with exact TF-IDF cosine over a block-max inverted index.

Terms are words and the first PREFIX_LETTERS letters of longer words. A bounded sample of labelled rows (those of
smallest hash) is the set of examples, and all their terms are indexed. Of examples with the same label whose full sets of
terms agree by NEAR or more, the one of smallest id counts; a labelled id that several rows have counts with one text.
Document frequencies of the terms are counted over all documents. The weight of a term is its TF-IDF, times 1 + its
likelihood ratio where toxic examples have it more often, so that what tells the label counts more and nothing is left
out. The index has a posting list for each term and its largest weight in each block of examples, alike examples standing
together; a query's lists of frequent terms are summed by a matrix product, the block maxima of the others make bounds,
and only lists with postings in blocks that can beat the k-th example are read. Examples vote with their cosine, plus a
prior weight for the base rate; votes become probabilities by isotonic regression on the examples themselves, each left out of its own vote. The driver holds the
sample's terms and counts, no texts.

Empty and null texts, and texts with none of the terms, get the rate of such examples. Ties go to the example of smaller id.
Without labels of both classes every score is the base rate (0 without labels).
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from treescan.llm.common import chunks, crc_of_id, free_name, materialize, shuffle_partitions, small_batches

PREFIX_LETTERS = 4
K = 15
#: A sample of 8,000 examples makes 16 blocks, so that a term's maxima are a short row of a table.
BLOCK = 512
#: Terms whose posting lists are rows of a matrix, and vectors multiplied with it at once.
DENSE = 768
BATCH = 256
#: More than sums of single precision can be off.
SLACK = 1e-5
PRIOR_WEIGHT = 0.5
NEAR = 0.85
_WORDS = re.compile(r"[^\W\d_]+").findall

TERMS = T.MapType(T.StringType(), T.IntegerType())
VECTOR = T.StructType([T.StructField("terms", T.ArrayType(T.IntegerType())), T.StructField("counts", T.ArrayType(T.IntegerType()))])


def in_training(id_col: str) -> Column:
    return F.pmod(crc_of_id(id_col), F.lit(3)) != 1


def terms_of(text: str) -> Counter:
    words = Counter(_WORDS(text.lower()))
    out = Counter(words)
    for w, n in words.items():
        if len(w) > PREFIX_LETTERS:
            out[w[:PREFIX_LETTERS] + "*"] += n
    return out


@F.arrow_udf(TERMS)
def term_counts(text: pa.Array) -> pa.Array:
    return pa.array([list(terms_of(t or "").items()) for t in text.to_pylist()], pa.map_(pa.string(), pa.int32()))


def spans(lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """The numbers of all ranges from lo up to hi, one range after the other."""
    n = hi - lo
    return np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))


def pair_of(vector: dict[int, float] | tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    return (np.fromiter(vector.keys(), np.int64), np.fromiter(vector.values(), float)) if isinstance(vector, dict) else vector


def word_terms(texts: list[str], place: dict[str, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Terms of texts that have a place: (ends of the lists, places, counts), texts one after the other."""
    words = [_WORDS(t.lower()) for t in texts]
    coded = pa.array([w for x in words for w in x], pa.string()).dictionary_encode()
    kinds = coded.dictionary.to_pylist()
    own = np.array([place.get(w, -1) for w in kinds], np.int64)
    start = np.array([place.get(w[:PREFIX_LETTERS] + "*", -1) if len(w) > PREFIX_LETTERS else -1 for w in kinds], np.int64)
    text = np.repeat(np.arange(len(texts)) << 32, [len(x) for x in words])
    at = coded.indices.to_numpy()
    both = [(text + x[at])[x[at] >= 0] for x in (own, start)] if len(at) else [np.zeros(0, np.int64)]
    found, counts = np.unique(np.concatenate(both), return_counts=True)
    return np.searchsorted(found, np.arange(len(texts) + 1) << 32), found & 0xFFFFFFFF, counts


def alike_order(terms: np.ndarray, counts: np.ndarray, ends: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Examples in the order of the angle that two principal directions of their most frequent terms give."""
    n = len(ends) - 1
    frequent = np.argsort(-np.bincount(terms, minlength=len(idf)), kind="stable")[:256]
    column = np.full(len(idf), -1)
    column[frequent] = np.arange(len(frequent))
    at = np.flatnonzero(column[terms] >= 0)
    x = np.zeros((len(frequent), n))
    x[column[terms[at]], np.repeat(np.arange(n), np.diff(ends))[at]] = (1 + np.log(counts[at])) * idf[terms[at]]
    x /= np.maximum(np.sqrt((x * x).sum(axis=0)), 1e-300)
    if len(frequent) < 3:
        return np.arange(n)
    axes = np.linalg.eigh(x @ x.T)[1][:, -3:-1].T @ x
    return np.argsort(np.arctan2(*(axes - axes.mean(axis=1, keepdims=True))), kind="stable")


class Index:
    """Unit vectors of the examples: by example, and as posting lists with block maxima. The DENSE most frequent terms
    are a matrix; of the other terms only blocks are read whose bound can beat the K-th example."""

    def __init__(self, ids: pa.Array, labels: np.ndarray, vectors: list, idf: np.ndarray):
        """ids in ascending order; vectors: (terms, counts) of each example, or a dict. idf: the weight of each term."""
        pairs = [pair_of(v) for v in vectors]
        ends = np.cumsum([0, *(len(t) for t, _ in pairs)])
        terms = np.concatenate([t for t, _ in pairs] or [np.zeros(0)]).astype(np.int32)
        counts = np.concatenate([n for _, n in pairs] or [np.zeros(0)]).astype(np.int32)
        idf = np.asarray(idf, float)
        self.rank = alike_order(terms, counts, ends, idf) if len(pairs) else np.zeros(0, np.int64)  # of each row among the ids
        places = spans(ends[self.rank], ends[self.rank + 1])
        self.ids, self.labels, self.idf = ids.take(pa.array(self.rank)), np.asarray(labels, float)[self.rank], idf
        self.terms, self.counts = terms[places], counts[places]
        self.ends = np.cumsum([0, *np.diff(ends)[self.rank]])
        self.base = float(self.labels.mean()) if len(pairs) else 0.0
        self.built = False

    def __getstate__(self) -> tuple:
        """The examples only, compressed: each executor keeps a copy on disk, and lists are soon built again."""
        return self.rank, self.ids, self.labels, self.idf, self.ends, self.base, zlib.compress(self.terms.tobytes(), 3), zlib.compress(self.counts.tobytes(), 3)

    def __setstate__(self, state: tuple) -> None:
        self.rank, self.ids, self.labels, self.idf, self.ends, self.base, terms, counts = state
        self.terms, self.counts = np.frombuffer(zlib.decompress(terms), np.int32), np.frombuffer(zlib.decompress(counts), np.int32)
        self.built = False

    def build(self) -> None:
        self.blocks = -(-len(self.ids) // BLOCK)
        row = np.repeat(np.arange(len(self.ids)), np.diff(self.ends)).astype(np.int32)
        w = (1 + np.log(self.counts)) * self.idf[self.terms]
        self.norms = np.sqrt(np.bincount(row, w * w, len(self.ids)))
        w = (w / self.norms[row]).astype(np.float32)
        n = np.bincount(self.terms, minlength=len(self.idf))
        self.column = np.full(len(self.idf), -1, np.int32)  # of frequent terms
        frequent = np.argsort(-n, kind="stable")[:DENSE]
        self.column[frequent] = np.arange(len(frequent))
        at = np.flatnonzero(self.column[self.terms] >= 0)
        self.matrix = np.zeros((DENSE, self.blocks * BLOCK), np.float32)
        self.matrix[self.column[self.terms[at]], row[at]] = w[at]
        rare = np.flatnonzero(self.column[self.terms] < 0)
        rare = rare[np.argsort(self.terms[rare], kind="stable")]
        self.rows, self.posted = row[rare], w[rare]  # lists of the rare terms, by row
        self.cuts = np.searchsorted(self.terms[rare], np.arange(len(self.idf) + 1)).astype(np.int32)
        self.maxima = np.zeros((len(self.idf), self.blocks), np.float32)
        np.maximum.at(self.maxima, (self.terms[rare], self.rows // BLOCK), self.posted)
        self.built = True

    def weighed(self, terms: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        w = (1 + np.log(counts)) * self.idf[terms]
        norm = np.sqrt((w * w).sum())
        return (terms, w / norm) if norm else (terms[:0], w[:0])

    def unit(self, counts: dict[int, float]) -> dict[int, float]:
        terms, w = self.weighed(*pair_of(counts))
        return dict(zip(terms.tolist(), w.tolist(), strict=True))

    def nearest(self, counts: dict[int, float], without: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """Rows and cosines of the K examples of largest positive cosine."""
        return next(self.nearest_of([pair_of(counts)], [without]))

    def nearest_of(self, vectors: list[tuple[np.ndarray, np.ndarray]], without: list[int] | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Of each vector what nearest() gives."""
        if not self.built:
            self.build()
        whole = np.zeros(len(self.idf))
        for lo in range(0, len(vectors), BATCH):
            units = [self.weighed(*v) for v in vectors[lo : lo + BATCH]]
            queries = np.zeros((len(units), DENSE), np.float32)
            for i, (t, w) in enumerate(units):
                common = self.column[t] >= 0
                queries[i, self.column[t[common]]] = w[common]
            for i, (scores, (t, w)) in enumerate(zip(queries @ self.matrix, units, strict=True)):
                skip = without[lo + i] if without else -1
                yield self.best(scores, t, w, whole, skip) if len(self.ids) and len(t) else (np.zeros(0, np.int64), np.zeros(0))

    def best(self, scores: np.ndarray, terms: np.ndarray, w: np.ndarray, whole: np.ndarray, without: int) -> tuple[np.ndarray, np.ndarray]:
        """scores: by the frequent terms, of single precision, so that what comes near the K-th is summed again."""
        k = min(K, len(scores))
        least = lambda: np.partition(np.delete(scores, without) if without >= 0 else scores, -k)[-k] if len(scores) > k else 0.0
        rare = np.flatnonzero(self.column[terms] < 0)
        maxima, own = self.maxima[terms[rare]], w[rare].astype(np.float32)
        bounds = scores.reshape(-1, BLOCK).max(axis=1) + own @ maxima
        read = maxima[:, bounds >= least() - SLACK].any(axis=1)  # lists with postings in blocks that can beat the K-th
        lo, hi = self.cuts[terms[rare[read]]], self.cuts[terms[rare[read]] + 1]
        if len(lo):
            lists = list(map(slice, lo.tolist(), hi.tolist()))
            rows, posted = (np.concatenate([x[y] for y in lists]) for x in (self.rows, self.posted))
            scores = scores + np.bincount(rows, np.repeat(own[read], hi - lo) * posted, len(scores)).astype(np.float32)
        found = np.flatnonzero((scores > 0) & (scores >= least() - SLACK))
        found = found[found != without]
        if not len(found):
            return found, np.zeros(0)
        whole[terms] = w
        lists = list(map(slice, self.ends[found].tolist(), self.ends[found + 1].tolist()))
        t = np.concatenate([self.terms[x] for x in lists])
        shared = np.flatnonzero(whole[t])
        of = np.repeat(np.arange(len(found)), self.ends[found + 1] - self.ends[found])[shared]
        t, counts = t[shared], np.concatenate([self.counts[x] for x in lists])[shared]
        cosines = np.bincount(of, (1 + np.log(counts)) * self.idf[t] * whole[t], len(found)) / self.norms[found]
        whole[terms] = 0
        top = np.lexsort((self.rank[found], -np.round(cosines, 12)))[:K]
        return found[top], cosines[top]

    def vote(self, rows: np.ndarray, cosines: np.ndarray) -> float:
        return float((cosines @ self.labels[rows] + PRIOR_WEIGHT * self.base) / (cosines.sum() + PRIOR_WEIGHT)) if len(rows) else 0.0

    def own_votes(self, rows: np.ndarray) -> list[float]:
        """The votes on examples, each without its own."""
        vectors = [(self.terms[a:b], self.counts[a:b]) for a, b in zip(self.ends[rows], self.ends[rows + 1], strict=True)]
        return [self.vote(*x) for x in self.nearest_of(vectors, rows.tolist())]


def isotonic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: points of a non-decreasing line through the means of the pools."""
    order = np.argsort(x, kind="stable")
    pools: list[list[float]] = []  # sum of y, count, sum of x
    for v in np.unique(x):
        m = x[order] == v
        pools.append([float(y[order][m].sum()), float(m.sum()), float(v * m.sum())])
        while len(pools) > 1 and pools[-2][0] / pools[-2][1] >= pools[-1][0] / pools[-1][1]:
            last = pools.pop()
            pools[-1] = [a + b for a, b in zip(pools[-1], last, strict=True)]
    return np.array([p[2] / p[1] for p in pools]), np.array([p[0] / p[1] for p in pools])


def examples(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, max_labelled: int) -> DataFrame:
    """id, toxic and terms of the labelled sample, one row an id, written to the shared folder."""
    few = labels.where(F.col("toxic").isin(0, 1) & F.col(id_col).isNotNull() & in_training(id_col)).groupBy(F.col(id_col).alias("id")).agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("id"), "id").limit(max_labelled)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(few), "id")
    text = F.coalesce("text", F.lit(""))
    rows = rows.groupBy("id", "toxic").agg(F.min_by(text, F.struct(F.xxhash64(text), text)).alias("text"))
    return materialize(rows.select("id", "toxic", term_counts("text").alias("terms")), "examples")


def distinct_examples(vectors: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray) -> np.ndarray:
    """Which examples stay: those whose set of terms agrees by NEAR or more with no earlier one of their label that stays.
    Sets that agree so share one of their rarest terms, as many as may differ and one more."""
    seen = np.bincount(np.concatenate([t for t, _ in vectors] or [np.zeros(0, np.int64)]).astype(np.int64))
    lists: dict[tuple, list[int]] = {}
    sets: dict[int, np.ndarray] = {}
    for i, (terms, _) in enumerate(vectors):
        own = np.sort(terms)
        rarest = own[np.argsort(seen[own], kind="stable")][: len(own) - math.ceil(NEAR * len(own)) + 1]
        marks = [(labels[i], t) for t in rarest.tolist()]
        near = False
        for k in {k for m in marks for k in lists.get(m, ())}:
            both = len(np.intersect1d(own, sets[k], assume_unique=True))
            if both >= NEAR * (len(own) + len(sets[k]) - both):
                near = True
                break
        if not near:
            sets[i] = own
            for m in marks:
                lists.setdefault(m, []).append(i)
    return np.array(list(sets), np.int64)


def relevance(a: np.ndarray, df: np.ndarray, pos: float, all_n: float) -> np.ndarray:
    """For terms in df of all_n examples, a of the pos toxic ones: 1, and for those more common in toxic examples the
    likelihood ratio on top."""
    def part(seen: np.ndarray, expected: np.ndarray) -> np.ndarray:
        return np.where(seen > 0, seen * np.log(np.maximum(seen, 1e-300) / np.maximum(expected, 1e-300)), 0.0)

    g2 = 2 * (part(a, df * pos / all_n) + part(df - a, df * (all_n - pos) / all_n) + part(pos - a, (all_n - df) * pos / all_n) + part(all_n - pos - df + a, (all_n - df) * (all_n - pos) / all_n))
    return 1 + np.where(a * all_n > df * pos, np.maximum(g2, 0.0), 0.0)


def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lists of terms to (t, n): in how many of the lists each term is."""
    total = np.zeros(0, np.int64)
    for batch in batches:
        n = np.bincount(batch.column(0).flatten().to_numpy(), minlength=len(total))
        n[: len(total)] += total
        total = n
    t = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(t.astype(np.int32)), pa.array(total[t].astype(np.int64))], names=["t", "n"])


def score_texts(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", max_labelled: int = 8_000, cut: float = 0.7, keep: list[str] | None = None) -> DataFrame:
    """docs (or their columns ``keep``) with a struct column ``toxicity`` (or a free name; the last column): score,
    predicted, nearest (ids of the nearest examples) and cosines. At most max_labelled rows are learned from, with all
    their terms."""
    small_batches(docs.sparkSession)
    sc = docs.sparkSession.sparkContext
    sample = examples(docs, labels, id_col, text_col, max_labelled)
    terms = sample.select(F.explode(F.map_keys("terms")).alias("term")).distinct().toArrow().column("term").to_pylist()  # of the sample
    place = sc.broadcast({t: i for i, t in enumerate(sorted(terms))})
    lists = lambda ends, *of: pa.StructArray.from_arrays([pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(x.astype(np.int32))) for x in of], names=["terms", "counts"])

    def vector(text: pa.Array) -> pa.Array:
        texts = [t or "" for t in text.to_pylist()]
        sizes, found, counts = [np.zeros(1, np.int64)], [np.zeros(0)], [np.zeros(0)]
        for lo, hi in chunks(texts):
            ends, t, n = word_terms(texts[lo:hi], place.value)
            sizes.append(np.diff(ends))
            found.append(t)
            counts.append(n)
        return lists(np.cumsum(np.concatenate(sizes)), np.concatenate(found), np.concatenate(counts))

    def placed(terms: pa.Array) -> pa.Array:
        ends = terms.offsets.to_numpy()
        keys, counts = terms.keys.slice(ends[0], ends[-1] - ends[0]), terms.items.slice(ends[0], ends[-1] - ends[0])
        return lists(ends - ends[0], np.array([place.value[t] for t in keys.to_pylist()]), counts.to_numpy())

    name, own = free_name(docs, "toxicity"), free_name(docs, "_vector")
    columns = [F.col(f"`{c}`") for c in (docs.columns if keep is None else keep)]
    rows = materialize(docs.select(*columns, F.arrow_udf(vector, VECTOR)(F.col(text_col)).alias(own)), "vectors")
    total = rows.count()
    df = np.zeros(len(terms))
    seen = rows.select(F.col(own)["terms"].alias("t")).mapInArrow(counted, "t int, n long").groupBy("t").agg(F.sum("n").alias("n")).toArrow()  # a row for each term of the sample at most
    df[seen.column("t").to_numpy()] = seen.column("n").to_numpy()
    known = sample.select("id", "toxic", F.arrow_udf(placed, VECTOR)(F.col("terms")).alias("v")).toArrow().sort_by("id").combine_chunks()
    labelled = known.column("toxic").to_numpy().astype(float)
    v = known.column("v").combine_chunks()
    ends = np.cumsum(pc.list_value_length(v.field("terms")).to_numpy())[:-1]
    vectors = list(zip(*[np.split(v.field(f).flatten().to_numpy(), ends) for f in ("terms", "counts")], strict=True)) if len(known) else []
    stay = distinct_examples(vectors, labelled)
    vectors, labelled, ids = [vectors[i] for i in stay.tolist()], labelled[stay], known.column("id").combine_chunks().take(pa.array(stay))
    weights = np.log((1 + total) / (1 + df)) + 1
    if len(ids):
        at, of = np.concatenate([t for t, _ in vectors]), np.repeat(labelled, [len(t) for t, _ in vectors])
        weights *= relevance(np.bincount(at, of, len(terms)), np.bincount(at, minlength=len(terms)).astype(float), labelled.sum(), len(ids))
    shared = sc.broadcast(Index(ids, labelled, vectors, weights))

    def voted_on(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(shared.value.own_votes(batch.column(0).to_numpy()), pa.float64())], names=["row", "vote"])

    steps = np.zeros(1), np.zeros(1)
    if len(ids):
        votes = docs.sparkSession.range(0, len(ids), 1, shuffle_partitions(docs.sparkSession)).mapInArrow(voted_on, "row long, vote double").toArrow().sort_by("row")
        steps = isotonic(votes.column("vote").to_numpy(), shared.value.labels)

    def voted(terms: pa.Array, counts: pa.Array) -> pa.Array:
        index, ends = shared.value, np.cumsum(pc.list_value_length(terms).to_numpy())[:-1]
        given = list(zip(np.split(terms.flatten().to_numpy(), ends), np.split(counts.flatten().to_numpy(), ends), strict=True)) if len(terms) else []
        found = list(index.nearest_of(given))
        score = np.clip([np.interp(index.vote(r, c), *steps) for r, c in found], 0, 1) if found else np.zeros(0)
        sizes = pa.array(np.cumsum([0, *(len(r) for r, _ in found)]), pa.int32())
        near = index.ids.take(pa.array(np.concatenate([r for r, _ in found] or [np.zeros(0)]).astype(np.int64)))
        cosines = pa.array(np.concatenate([c for _, c in found] or [np.zeros(0)]))
        return pa.StructArray.from_arrays([pa.array(score, pa.float64()), pa.array((score >= cut).astype(np.int32)), pa.ListArray.from_arrays(sizes, near), pa.ListArray.from_arrays(sizes, cosines)], names=["score", "predicted", "nearest", "cosines"])

    vote = T.StructType([T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType()), T.StructField("nearest", T.ArrayType(docs.schema[id_col].dataType)), T.StructField("cosines", T.ArrayType(T.DoubleType()))])
    return rows.withColumn(name, F.arrow_udf(voted, vote)(F.col(own)["terms"], F.col(own)["counts"])).drop(own)
