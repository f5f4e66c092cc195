"""Quality rules: a decision list learned by sequential covering, applied as ordered Spark conditional expressions.

text_stats counts in Arrow batches; learn_rules grows conjunctions of thresholds on two thirds of a bounded labelled
sample, prunes them on the last third, and keeps those precise enough; rule_column turns the list into F.when(...).
Empty and null texts have zero counts (and fail the base rule on fewer than 10 words). Ties between thresholds go to
the first feature and the smallest threshold. Without labels of both classes the list is empty and rejects nothing.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from treescan.llm.common import SYMBOLS, UPPER, chunks, free_name, small_batches

STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_digits", "n_exclaims")
STATS_TYPE = T.StructType([T.StructField(s, T.LongType()) for s in STATS])
WINDOW = 5


def repeated_words(ids: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Per text, the words that lie in a window of WINDOW words found twice or more in that text.

    ids: the words of all texts as numbers; sizes: the words of each text. Windows are sorted by a 64-bit hash; equal
    neighbours are compared word by word.
    """
    n = len(ids)
    out = np.zeros(len(sizes), np.int64)
    if n < WINDOW:
        return out
    doc = np.repeat(np.arange(len(sizes)), sizes)
    starts = np.flatnonzero(doc[: n - WINDOW + 1] == doc[WINDOW - 1 :])
    if not len(starts):
        return out
    mix = np.random.default_rng(7).integers(1, 2**63, int(ids.max()) + 1, np.uint64)[ids]
    key = doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    key = key[starts]
    for k in range(WINDOW):
        key = (key ^ (key >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + mix[starts + k]
    order = np.argsort(key, kind="stable")
    near = starts[order]
    same = (key[order][1:] == key[order][:-1]) & (doc[near[1:]] == doc[near[:-1]])
    for k in range(WINDOW):
        same &= ids[near[1:] + k] == ids[near[:-1] + k]
    found = np.concatenate([near[1:][same], near[:-1][same]])
    edge = np.zeros(n + 1, np.int64)
    twice = np.unique(found)
    np.add.at(edge, twice, 1)
    np.add.at(edge, twice + WINDOW, -1)
    return np.bincount(doc[np.cumsum(edge[:-1]) > 0], minlength=len(sizes)).astype(np.int64)


def stats_of(texts: list[bytes]) -> dict[str, np.ndarray]:
    """STATS of UTF-8 texts."""
    words = [t.split() for t in texts]
    sizes = np.array([len(w) for w in words], np.int64)
    flat = pa.array([x for w in words for x in w], pa.large_binary())
    ids = flat.dictionary_encode().indices.to_numpy() if len(flat) else np.zeros(0, np.int32)
    word_bytes = np.array([sum(map(len, w)) for w in words], np.int64)
    inner = np.array([len(t) - len(t.translate(None, bytes(range(0x80, 0xC0)))) for t in texts], np.int64)
    lines = [[x for x in t.split(b"\n") if x.strip()] for t in texts]
    without = lambda drop: np.array([len(t) - len(t.translate(None, drop)) for t in texts], np.int64)
    return {
        "n_words": sizes,
        "word_chars": word_bytes - inner,  # continuation bytes are not code points of their own
        "n_symbols": without(SYMBOLS),
        "n_dup_lines": np.array([len(x) - len(set(x)) for x in lines], np.int64),
        "n_repeat_words": repeated_words(ids, sizes),
        "n_lines": np.array([len(x) for x in lines], np.int64),
        "n_upper": without(UPPER),
        "n_digits": without(b"0123456789"),
        "n_exclaims": without(b"!"),
    }


@F.arrow_udf(STATS_TYPE)
def text_stats(text: pa.Array) -> pa.Array:
    texts = text.fill_null("").cast(pa.binary()).to_pylist()
    parts = [stats_of(texts[a:b]) for a, b in chunks(texts)]
    return pa.StructArray.from_arrays([pa.array(np.concatenate([p[s] for p in parts]) if parts else [], pa.int64()) for s in STATS], list(STATS))


def features(stats: str | Column) -> dict[str, Column]:
    """The numbers that rules may test, of a column of text_stats; 0 where a share has no base."""
    at = lambda name: (F.col(stats) if isinstance(stats, str) else stats)[name].cast("double")
    share = lambda a, b: F.coalesce(at(a) / F.nullif(at(b), F.lit(0.0)), F.lit(0.0))
    return {
        "symbol_share": share("n_symbols", "word_chars"),
        "upper_share": share("n_upper", "word_chars"),
        "digit_share": share("n_digits", "word_chars"),
        "exclaim_share": share("n_exclaims", "n_words"),
        "dup_line_share": share("n_dup_lines", "n_lines"),
        "repeat_share": share("n_repeat_words", "n_words"),
        "word_length": share("word_chars", "n_words"),
        "words_a_line": share("n_words", "n_lines"),
        "n_words": at("n_words"),
    }


def base_failed(stats: str) -> Column:
    s = F.col(stats)
    return (s["n_words"] < 10) | (100 * s["n_repeat_words"] > 20 * s["n_words"])


@dataclass(frozen=True)
class Rule:
    """Reject where all conditions (feature, '>=' or '<=', threshold) hold."""

    conditions: tuple[tuple[str, str, float], ...]
    covered: int
    precision: float

    def __str__(self) -> str:
        return " and ".join(f"{f} {op} {t:.4g}" for f, op, t in self.conditions)


def _mask(x: dict[str, np.ndarray], conditions) -> np.ndarray:
    out = np.ones(len(next(iter(x.values()))), bool)
    for f, op, t in conditions:
        out &= x[f] >= t if op == ">=" else x[f] <= t
    return out


def _grow(x: dict[str, np.ndarray], y: np.ndarray, most: int) -> list[tuple[str, str, float]]:
    """Add the condition of largest information gain until no good text is covered."""
    rule: list[tuple[str, str, float]] = []
    inside = np.ones(len(y), bool)
    while len(rule) < most and (y[inside] == 0).any() and y[inside].any():
        p0, n0 = y[inside].sum(), (y[inside] == 0).sum()
        base, best = np.log2(p0 / (p0 + n0)), (1e-9, None)
        for f, v in x.items():
            order = np.argsort(v[inside], kind="stable")
            value, bad = v[inside][order], y[inside][order]
            edge = np.flatnonzero(np.diff(value) > 0)
            cum = np.cumsum(bad)
            for op in (">=", "<="):
                p = p0 - cum[edge] if op == ">=" else cum[edge]
                n = (len(value) - edge - 1 if op == ">=" else edge + 1) - p
                gain = np.where(p > 0, p * (np.log2(np.maximum(p, 1e-9) / np.maximum(p + n, 1)) - base), 0.0)
                if len(gain) and gain.max() > best[0]:
                    i = edge[int(gain.argmax())]
                    best = (float(gain.max()), (f, op, float(value[i] + value[i + 1]) / 2))
        if best[1] is None:
            break
        rule.append(best[1])
        inside = _mask(x, rule)
    return rule


def learn_rules(x: dict[str, np.ndarray], y: np.ndarray, *, max_rules: int = 12, max_conditions: int = 4, min_cover: int = 5, min_precision: float = 0.95) -> list[Rule]:
    """Sequential covering. y: 1 for texts to reject; every third row prunes, the others grow rules."""
    rules: list[Rule] = []
    prunes = np.arange(len(y)) % 3 == 2
    left = np.ones(len(y), bool)
    while len(rules) < max_rules:
        grow, prune = left & ~prunes, left & prunes
        if y[grow].sum() < min_cover:
            break
        conditions = _grow({f: v[grow] for f, v in x.items()}, y[grow], max_conditions)
        seen, truth = {f: v[prune] for f, v in x.items()}, y[prune]

        def worth(k: int) -> tuple[float, int]:
            m = _mask(seen, conditions[:k])
            p, n = int(truth[m].sum()), int((truth[m] == 0).sum())
            return (p - n) / max(1, p + n), -k

        conditions = conditions[: max(range(1, len(conditions) + 1), key=worth, default=0)]
        if not conditions:
            break
        m = _mask(x, conditions) & left
        p, n = int(y[m].sum()), int(m.sum())
        if p < min_cover or p < min_precision * n:
            break
        rules.append(Rule(tuple(conditions), n, p / n))
        left &= ~m
    return rules


def labelled_sample(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", max_labelled: int = 20_000) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """Features and reject marks of at most max_labelled labelled rows that pass the base rules.

    The sample is those with the smallest hash of the id; with 16 bytes a row the broadcast side stays under 1 MB.
    """
    few = labels.select(F.col(id_col).alias("_id"), (F.col("quality") == 0).cast("int").alias("_bad")).where("_id is not null and _bad is not null").orderBy(F.xxhash64("_id"), "_id", "_bad").limit(max_labelled)
    # the text depends on both sides, so the counts are taken above the join
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).join(F.broadcast(few), "_id").select("_id", "_bad", text_stats(F.when(F.col("_bad").isNotNull(), F.col("_text"))).alias("_stats")).where(~base_failed("_stats"))
    got = rows.select("_id", "_bad", *[c.alias(f) for f, c in features("_stats").items()]).toPandas().sort_values(["_id", "_bad"], kind="stable")
    got = got.sample(frac=1.0, random_state=11) if len(got) else got
    return {f: got[f].to_numpy(float) for f in features("_stats")}, got["_bad"].to_numpy(int)


def rule_column(rules: list[Rule], stats: str) -> Column:
    """The first rule that holds, as text; null where none does."""
    of = features(stats)
    out = F.lit(None).cast("string")
    chain = None
    for rule in rules:
        test = F.lit(True)
        for f, op, t in rule.conditions:
            test = test & (of[f] >= t if op == ">=" else of[f] <= t)
        chain = F.when(test, F.lit(str(rule))) if chain is None else chain.when(test, F.lit(str(rule)))
    return out if chain is None else chain.otherwise(out)


def judge(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", max_labelled: int = 20_000) -> DataFrame:
    """docs with a struct column (``quality``, or a free name): the counts, base_failed, rule and kept.

    The struct is the last column, so extra columns of any name stay as they are.
    """
    small_batches(docs.sparkSession)
    rules = learn_rules(*labelled_sample(docs, labels, id_col=id_col, text_col=text_col, max_labelled=max_labelled))
    name = free_name(docs, "quality")
    stats = free_name(docs, "_stats")
    out = docs.withColumn(stats, text_stats(F.col(text_col)))
    failed, rule = base_failed(stats), rule_column(rules, stats)
    return out.withColumn(name, F.struct(F.col(f"{stats}.*"), failed.alias("base_failed"), rule.alias("rule"), (~failed & rule.isNull()).alias("kept"))).drop(stats)
