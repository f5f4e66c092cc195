"""Spelling variant grouping: one-error search of a vocabulary with bidirectional FM-index search schemes.

Two words are near if they differ by one inserted, deleted or replaced code point. Then one half of a word is whole in
the other: either its first half and the error lies to the right of it, or its second half and the error lies to the
left. So each scheme matches one half exactly and extends across the other half allowing one error. An FM-index extends
to the left; of the pair that makes it bidirectional, the index of the words serves the scheme that matches the second
half, and the index of the reversed words the scheme that matches the first half and extends to the right. A state is an
interval of suffix ranks: the words that end as the pattern so far does. Where an interval is down to a few words, these
are compared with the query instead of being searched on.

The vocabulary is dealt into parts by halves: a word is an entry of the parts of the two first and the two second halves
that words of about its length can share with it, and a query of the parts of its own two. The parts hold about as many
entries at every size of the vocabulary; the entries of a half that alone exceeds a part are dealt over several, and its
queries go to each. A pair found by its second half is left out where the first half is equal too, so every near pair is
met exactly once and counts are sums.

Null and empty texts have no words. A null id counts as the empty text in the hash that plants misspellings.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from treescan.llm.common import UPPER, materialize, small_batches

#: Words: runs of these, in code points that Latin-1 has.
LETTERS = "A-Za-zÀ-ÿ"
LEAST_LENGTH, LEAST_COUNT = 7, 2
#: A form has at least so many times the occurrences of its variants.
RATIO = 10
#: Entries of a part, about.
PART = 150_000
#: An interval of so many words at most is compared word by word.
FEW = 4
#: Queries searched, and cells compared, at once.
QUERIES_AT_ONCE, CELLS = 20_000, 4_000_000
FOUND = "word string, n long, n_near long, form_n long, form string"


class FmIndex:
    """Words (Latin-1 bytes, distinct), each ended by 0, in the order of all their suffixes; equal suffixes stand in the
    order of the words."""

    def __init__(self, words: list[bytes]):
        self.flat = np.frombuffer(b"\0".join(words) + b"\0" * 9, np.uint8)
        self.lengths = np.fromiter(map(len, words), np.int64, len(words))
        self.starts = np.cumsum(self.lengths + 1) - self.lengths - 1
        self.size = n = int((self.lengths + 1).sum())
        order = self._sorted_suffixes(n)
        before = np.where(order > 0, self.flat[order - 1], 0).astype(np.uint64)
        rows = np.argsort(before, kind="stable")
        #: For each character, in order, the ranks of the suffixes that it stands before.
        self.keys = before[rows] * np.uint64(n) + rows.astype(np.uint64)
        self.letters = np.unique(before)[1:]
        self.word_at = np.repeat(np.arange(len(words)), self.lengths + 1)[order]

    def _sorted_suffixes(self, n: int) -> np.ndarray:
        """Prefix doubling from keys of eight characters."""
        ends = np.repeat(self.starts + self.lengths, self.lengths + 1)
        rest = ends - np.arange(n)
        key = np.zeros(n, np.uint64)
        for k in range(8):
            key = (key << np.uint64(8)) | np.where(rest > k, self.flat[k : n + k], 0).astype(np.uint64)
        order, covered = np.argsort(key, kind="stable"), 8
        while (rest >= covered).any():
            ordered = key[order]
            rank = np.empty(n, np.uint64)
            rank[order] = np.cumsum(np.append(False, ordered[1:] != ordered[:-1])).astype(np.uint64)
            later = np.zeros(n, np.uint64)
            going = np.flatnonzero(rest >= covered)
            later[going] = rank[going + covered] + np.uint64(1)
            key = rank * np.uint64(n + 1) + later
            order, covered = np.argsort(key, kind="stable"), covered * 2
        return order

    def left(self, lo: np.ndarray, hi: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Intervals after one more character on the left."""
        base = c.astype(np.uint64) * np.uint64(self.size)
        return np.searchsorted(self.keys, base + lo.astype(np.uint64)), np.searchsorted(self.keys, base + hi.astype(np.uint64))

    def whole(self, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of intervals, those that hold a word that begins there: their numbers and the words; one each, as words are distinct."""
        a, b = np.searchsorted(self.keys, lo.astype(np.uint64)), np.searchsorted(self.keys, hi.astype(np.uint64))
        at = np.flatnonzero(b > a)
        return at, self.word_at[self.keys[a[at]].astype(np.int64)]

    def branches(self, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """All characters that go before intervals: number of the interval, character and interval after it."""
        k = len(self.letters)
        which, c = np.repeat(np.arange(len(lo)), k), np.tile(self.letters, len(lo))
        a, b = self.left(lo[which], hi[which], c)
        some = b > a
        return which[some], c[some], a[some], b[some]


def spans(lo: np.ndarray, n: np.ndarray) -> np.ndarray:
    """lo, lo + 1, ... of n numbers each."""
    return np.repeat(lo - np.cumsum(n) + n, n) + np.arange(int(n.sum()))


class Query:
    """Query words, ended like those of an index."""

    def __init__(self, words: list[bytes]):
        self.flat = np.frombuffer(b"\0".join(words) + b"\0" * 9, np.uint8)
        self.lengths = np.fromiter(map(len, words), np.int64, len(words))
        self.starts = np.cumsum(self.lengths + 1) - self.lengths - 1

    def next(self, q: np.ndarray, pos: np.ndarray) -> np.ndarray:
        """The character of each query left of which nothing but pos - 1 characters remain."""
        return self.flat[self.starts[q] + pos - 1]


def one_error(index: FmIndex, queries: Query, exact: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct pairs (query, word) that differ by one error, not in the last ``exact`` characters of the query."""
    pairs = [_one_error(index, queries, exact, np.arange(a, min(a + QUERIES_AT_ONCE, len(exact)))) for a in range(0, len(exact), QUERIES_AT_ONCE)]
    q, v = (np.concatenate([p[k] for p in pairs]) if pairs else np.zeros(0, np.int64) for k in (0, 1))
    return q, v


def _one_error(index: FmIndex, queries: Query, exact: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    found: list[tuple[np.ndarray, np.ndarray]] = []
    words = len(index.lengths)
    pos, lo, hi = queries.lengths[q], np.zeros(len(q), np.int64), np.full(len(q), words, np.int64)

    def few(keep: np.ndarray) -> None:
        """States with a few words left: compare these."""
        n = hi[keep] - lo[keep]
        who, v = np.repeat(q[keep], n), index.word_at[spans(lo[keep], n)]
        ok = near(queries, who, index, v, exact[who])
        found.append((who[ok], v[ok]))

    # the exact half
    waiting = []
    while len(q):
        small = hi - lo <= FEW
        few(np.flatnonzero(small & (hi > lo)))
        over = ~small & (pos == queries.lengths[q] - exact[q])
        waiting.append((q[over], pos[over], lo[over], hi[over]))
        go = ~small & ~over
        q, pos, lo, hi = q[go], pos[go], lo[go], hi[go]
        lo, hi = index.left(lo, hi, queries.next(q, pos))
        pos = pos - 1
    q, pos, lo, hi = (np.concatenate([w[k] for w in waiting]) if waiting else np.zeros(0, np.int64) for k in range(4))

    # the other half: each round spends the error here or goes on without
    while len(q):
        interval, back = np.unique(lo * (index.size + 1) + hi, return_inverse=True)
        ilo, ihi = interval // (index.size + 1), interval % (index.size + 1)
        which, c, clo, chi = index.branches(ilo, ihi)
        n_of = np.bincount(which, minlength=len(interval))
        first = np.cumsum(n_of) - n_of
        n = n_of[back]
        state, branch = np.repeat(np.arange(len(q)), n), spans(first[back], n)
        left = pos[state] > 0
        same = left & (c[branch] == queries.next(q[state], np.maximum(pos[state], 1)))
        replaced, deleted = np.flatnonzero(left & ~same), np.flatnonzero(pos > 0)
        spent = (
            np.concatenate([q[state], q[state[replaced]], q[deleted]]),
            np.concatenate([pos[state], pos[state[replaced]] - 1, pos[deleted] - 1]),
            np.concatenate([clo[branch], clo[branch[replaced]], lo[deleted]]),
            np.concatenate([chi[branch], chi[branch[replaced]], hi[deleted]]),
        )
        found += _exact_rest(index, queries, *spent)
        q, pos, lo, hi = q[state[same]], pos[state[same]] - 1, clo[branch[same]], chi[branch[same]]
        small = hi - lo <= FEW
        few(np.flatnonzero(small & (hi > lo)))
        q, pos, lo, hi = q[~small], pos[~small], lo[~small], hi[~small]

    pairs = np.unique(np.concatenate([a * words + v for a, v in found])) if found else np.zeros(0, np.int64)
    return pairs // words, pairs % words


def _exact_rest(index: FmIndex, queries: Query, q, pos, lo, hi) -> list[tuple[np.ndarray, np.ndarray]]:
    """Go on without a further error to the beginning of the word."""
    out = []
    while len(q):
        end = pos == 0
        at, v = index.whole(lo[end], hi[end])
        out.append((q[end][at], v))
        q, pos, lo, hi = q[~end], pos[~end], lo[~end], hi[~end]
        lo, hi = index.left(lo, hi, queries.next(q, pos))
        some = hi > lo
        q, pos, lo, hi = q[some], pos[some] - 1, lo[some], hi[some]
    return out


def _alike(a, p: np.ndarray, b, r: np.ndarray, n: np.ndarray) -> np.ndarray:
    """How many characters, of n at most, are equal from places p of a and r of b on."""
    out = np.zeros(len(p), np.int64)
    at = np.arange(len(p))
    k = 0
    while len(at):  # eight places at a time, for those that are equal so far
        reach = np.minimum(n[at] - k, 8)
        steps = np.arange(8)
        one = a[np.minimum(p[at, None] + k + steps, len(a) - 1)]
        two = b[np.minimum(r[at, None] + k + steps, len(b) - 1)]
        same = (one == two) & (steps < reach[:, None])
        run = np.where(same.all(axis=1), 8, np.argmin(same, axis=1))
        out[at] += run
        at, k = at[(run == 8) & (n[at] > k + 8)], k + 8
    return out


def near(queries: Query, q: np.ndarray, index: FmIndex, v: np.ndarray, exact: np.ndarray) -> np.ndarray:
    """Which queries and words differ by exactly one error, not in the last ``exact`` characters of the query: what is
    alike from the left and from the right make up the rest."""
    la, lb = queries.lengths[q], index.lengths[v]
    ok = np.abs(la - lb) <= 1
    out = np.zeros(len(q), bool)
    todo = np.flatnonzero(ok)
    for k in range(0, len(todo), CELLS // 16):
        t = todo[k : k + CELLS // 16]
        x, y, m, n = queries.starts[q[t]], index.starts[v[t]], la[t], lb[t]
        least = np.minimum(m, n)
        prefix = _alike(queries.flat, x, index.flat, y, least)
        suffix = _alike(queries.flat[::-1], len(queries.flat) - x - m, index.flat[::-1], len(index.flat) - y - n, least)
        out[t] = np.where(m == n, prefix + suffix == m - 1, prefix + suffix >= least) & (suffix >= exact[t])
    return out


def search_part(key, entries: pa.Table, asked: pa.Table) -> pa.Table:
    """Near words of the queries of a part among its entries: how many, and the most frequent (ties: the smallest)."""
    turned = key[0].as_py() % 2 == 1
    coded = entries.column("word").combine_chunks().dictionary_encode()
    vocabulary = coded.dictionary
    first = np.zeros(len(vocabulary), np.int64)
    codes = coded.indices.to_numpy()
    first[codes[::-1]] = np.arange(len(codes))[::-1]
    counts, spread = (entries.column(c).to_numpy()[first] for c in ("n", "spread"))
    rank = np.empty(len(vocabulary), np.int64)
    rank[pc.array_sort_indices(vocabulary).to_numpy()] = np.arange(len(vocabulary))
    raw = lambda a: [w.encode("latin-1")[:: -1 if turned else 1] for w in a.to_pylist()]
    index, queries = FmIndex(raw(vocabulary)), Query(raw(asked.column("asked")))
    exact, deals, deal = (asked.column(c).to_numpy() for c in ("exact", "deals", "deal"))
    q, v = one_error(index, queries, exact)
    mine = spread[v] % deals[q] == deal[q]
    if not turned:  # equal first halves are met by the other scheme
        m = queries.lengths[q] - exact[q]
        mine &= _alike(queries.flat, queries.starts[q], index.flat, index.starts[v], np.minimum(m, index.lengths[v])) < m
    q, v = q[mine], v[mine]
    order = np.lexsort((rank[v], -counts[v], q))
    q, v = q[order], v[order]
    head = np.append(True, q[1:] != q[:-1])[: len(q)]
    form = np.full(len(exact), -1)
    form[q[head]] = v[head]
    none = form < 0
    return pa.table(
        {
            "word": asked.column("asked"),
            "n": asked.column("asked_n"),
            "n_near": pa.array(np.bincount(q, minlength=len(exact))),
            "form_n": pa.array(counts[np.maximum(form, 0)], mask=none),
            "form": vocabulary.take(pa.array(np.maximum(form, 0), mask=none)),
        }
    )


def misspelt(id_col: str, run: Column) -> Column:
    """The run, without one code point where the hash of id and run says so."""
    h = F.crc32(F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit(":"), run).cast("binary"))
    k = (h % F.length(run)).cast("int")
    return F.when(h % 31 == 0, F.concat(F.substring(run, F.lit(1), k), F.substring(run, k + 2, F.length(run)))).otherwise(run)


def vocabulary(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """word, n: runs of letters, lower-cased in A-Z and misspelt, of at least LEAST_LENGTH code points and LEAST_COUNT occurrences."""
    runs = docs.select(F.col(id_col).alias("id"), F.explode(F.regexp_extract_all(F.col(text_col), F.lit(f"[{LETTERS}]{{{LEAST_LENGTH},}}"), F.lit(0))).alias("run"))
    lower = F.when(F.col("run").rlike("[A-Z]"), F.translate("run", UPPER.decode(), UPPER.decode().lower())).otherwise(F.col("run"))
    words = runs.select("id", lower.alias("run")).select(misspelt("id", F.col("run")).alias("word")).where(F.length("word") >= LEAST_LENGTH)
    return words.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= LEAST_COUNT)


def near_words(words: DataFrame) -> DataFrame:
    """words (word, n) with n_near and, of the near words, that of most occurrences (form, form_n; ties: the smallest)."""
    small_batches(words.sparkSession)
    parts = max(1, -(-4 * words.count() // PART // 2))
    length = F.length("word")
    # kind 0 meets by second halves, kind 1 by first ones; a word meets those of its own length and one more or less
    half = lambda kind, n: F.floor((n + (1 - kind)) / 2).cast("int")
    key = lambda kind, n: F.struct(F.lit(kind).alias("kind"), (F.left("word", n) if kind else F.right("word", n)).alias("half"), n.alias("exact"))
    own = lambda kind: key(kind, half(kind, length))
    others = F.array_distinct(F.array(*[key(kind, half(kind, length + d)) for kind in (0, 1) for d in (-1, 0, 1)]))
    entries = words.select("word", "n", F.explode(others).alias("k")).select("word", "n", "k.kind", "k.half")
    asked = words.select("word", "n", F.explode(F.array(own(0), own(1))).alias("k")).select("word", "n", "k.*")
    # few, as each has more than PART entries
    busy = materialize(entries.groupBy("kind", "half").agg(F.count("*").alias("m")).where(F.col("m") > PART).select("kind", "half", F.ceil(F.col("m") / PART).alias("busy")), "busy_halves")
    deals = F.coalesce("busy", F.lit(1)).alias("deals")
    spread = F.pmod(F.xxhash64("word"), F.lit(1 << 30)).alias("spread")
    part = (F.pmod(F.xxhash64("half", "deal"), F.lit(parts)) * 2 + F.col("kind")).cast("long").alias("part")
    entries = entries.join(busy, ["kind", "half"], "left").select("word", "n", "kind", "half", deals, spread).withColumn("deal", F.col("spread") % F.col("deals")).select(part, "word", "n", "spread")
    asked = asked.join(busy, ["kind", "half"], "left").select("word", "n", "kind", "half", "exact", deals).withColumn("deal", F.explode(F.sequence(F.lit(0).cast("long"), F.col("deals") - 1)))
    asked = asked.select(part, F.col("word").alias("asked"), F.col("n").alias("asked_n"), F.col("exact").cast("long").alias("exact"), "deals", "deal")
    found = entries.groupBy("part").cogroup(asked.groupBy("part")).applyInArrow(search_part, FOUND)
    best = F.min(F.when(F.col("form").isNotNull(), F.struct((-F.col("form_n")).alias("n"), "form")))
    whole = found.groupBy("word", "n").agg(F.sum("n_near").alias("n_near"), best.alias("best"))
    return whole.select("word", "n", "n_near", F.col("best.form").alias("form"), (-F.col("best.n")).alias("form_n"))


def group_variants(words: DataFrame) -> DataFrame:
    """word, form, root, n, n_near, form_n of words (word, n). A form needs RATIO times the word's occurrences, so chains
    of forms end; they are followed by doubling."""
    good = F.col("form_n") >= RATIO * F.col("n")
    linked = materialize(near_words(words).select("word", "n", "n_near", F.when(good, F.col("form")).alias("form"), F.when(good, F.col("form_n")).alias("form_n")), "variants")
    up = materialize(linked.where("form is not null").select("word", F.col("form").alias("root")), "roots")
    while True:
        far = up.select(F.col("word").alias("root"), F.col("root").alias("further"))
        longer = up.join(far, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved"))
        longer = materialize(longer, "roots")
        up = longer.select("word", "root")
        if longer.where("moved").isEmpty():
            break
    return linked.join(up, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
