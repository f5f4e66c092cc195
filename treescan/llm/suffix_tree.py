"""LM scoring with a probabilistic suffix tree over the tokens of texts.

Symbols of the tree are the tokens that make up at least p_symbol of the training tokens (so there are at most
1 / p_symbol, and a table of them is small at any size), and one more for all others. A context of up to DEPTH symbols
that was seen min_count times is a state of the tree if its next-symbol distribution diverges from that of the next
shorter context by more than a Bayesian information criterion allows for its parameters; so the number of states grows
with the corpus. Distributions are smoothed into that of the nearest shorter state (Witten-Bell); the root's is never
zero. A token is scored in the state of the longest suffix of what came before. A token that is no symbol of its own then
shares the others' probability by its count; unseen tokens together have the share of tokens seen once (Good-Turing).

Texts are coded once, in blocks of about BLOCK_BYTES, and only codes go on. A block asks once for each of its distinct
tokens, and once for each of its distinct sequences of DEPTH + 1 symbols. Questions are dealt over parts by a hash of the
token or of the context, carry the block's training counts, and travel as sorted lists, so that an answer is a list of
numbers in the same order. A part adds up the counts of its contexts and asks the parts of the shorter contexts in turn.
Counts go down to single symbols so; then tests and smoothed probabilities come up again, and at last to the blocks. The
driver holds the table of symbols and a few totals. Whatever a context's share, its part has at most one number a symbol
from each block. Log probabilities travel in single precision.

Null texts count as empty: one end token. Without training texts all tokens count as unseen. Rows that repeat an id or a
text are scored each.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from treescan.llm.common import LOWER, chunks, crc_of_id, materialize, shuffle_partitions, small_batches, word_hashes

DEPTH = 3
#: At most so many bits of a symbol, so that DEPTH + 1 fit a number.
MOST_BITS = 15
OTHER, END = 0, 1
END_HASH = np.uint64(xxhash.xxh3_64_intdigest(b"\n"))  # no word has a line feed
#: Text bytes of a block.
BLOCK_BYTES = 8_000_000
LN10 = np.log(10.0)
_ODD = 0x9E3779B97F4A7C15

# parts and blocks are of one type, so that both sides of a cogroup are dealt alike
ASKS = "source long, part long, n int, keys binary, counts binary"
ANSWERS = "target long, part long, n int, counts binary, totals binary, logp binary"


def in_training(id_col: str) -> Column:
    return F.pmod(crc_of_id(id_col), F.lit(5)) != 1


# packed numbers


def packed(x: np.ndarray) -> bytes:
    """Numbers byte by byte of the same place, compressed."""
    planes = np.ascontiguousarray(x).view(np.uint8).reshape(len(x), x.dtype.itemsize).T
    return pa.compress(np.ascontiguousarray(planes), "zstd", asbytes=True)


def unpacked(data: bytes, n: int, dtype) -> np.ndarray:
    size = np.dtype(dtype).itemsize
    planes = np.frombuffer(pa.decompress(data, n * size, "zstd", asbytes=True), np.uint8).reshape(size, n)
    return np.ascontiguousarray(planes.T).reshape(-1).view(dtype)


def pack_sorted(x: np.ndarray) -> bytes:
    """Ascending numbers by their steps."""
    return packed(np.diff(x, prepend=np.uint64(0)))


def unpack_sorted(data: bytes, n: int) -> np.ndarray:
    return np.cumsum(unpacked(data, n, np.uint64), dtype=np.uint64)


def summed(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, ascending, and the sums of their numbers."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])[: len(keys)])
    return keys[first], (np.add.reduceat(n[order], first) if len(first) else n[:0])


def asks(source: int, part: np.ndarray, keys: np.ndarray, counts: np.ndarray) -> Iterator[tuple]:
    """Rows of ASKS: ascending keys, dealt over parts in the same order."""
    cuts = np.append(np.flatnonzero(np.append(True, part[1:] != part[:-1])[: len(part)]), len(part))
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        yield source, int(part[a]), b - a, pack_sorted(keys[a:b]), packed(counts[a:b])


def asked(table: pa.Table) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """The keys of each row of ASKS, and the distinct ones of all with the sums of their counts."""
    sizes = table.column("n").to_pylist()
    keys = [unpack_sorted(k, n) for k, n in zip(table.column("keys").to_pylist(), sizes, strict=True)]
    counts = [unpacked(c, n, np.int64) for c, n in zip(table.column("counts").to_pylist(), sizes, strict=True)]
    return keys, *summed(np.concatenate(keys), np.concatenate(counts))


def rows_table(rows: list[tuple], schema: str) -> pa.Table:
    types = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    fields = [f.split() for f in schema.split(", ")]
    return pa.table({name: pa.array([r[i] for r in rows], types[t]) for i, (name, t) in enumerate(fields)})


def part_of_hash(keys: np.ndarray, parts: int) -> np.ndarray:
    return ((keys >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)


# coded blocks


def hashed_words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of texts: hashes of the distinct tokens, the place among them of each token (each text's end too), tokens a text."""
    words = [[*t.translate(LOWER).split(), b"\n"] for t in texts]
    coded = pa.array([w for x in words for w in x], pa.large_binary()).dictionary_encode()
    return word_hashes(coded.dictionary.to_pylist()), coded.indices.to_numpy(), np.array([len(w) for w in words], np.int32)


def coder(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, train, text) to blocks: ids, sizes and train of the texts, the distinct hashes with their training counts and
    all counts, and each token's rank by count."""
    block = TaskContext.get().partitionId() << 24
    held: list[tuple] = []
    size = 0
    for batch in batches:
        texts = batch.column(2).fill_null("").cast(pa.binary()).to_pylist()
        for lo, hi in chunks(texts):
            held.append((batch.column(0).slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo), *hashed_words(texts[lo:hi])))
            size += sum(map(len, texts[lo:hi]))
            if size >= BLOCK_BYTES:
                yield coded_block(block, held)
                held, size, block = [], 0, block + 1
    if held:
        yield coded_block(block, held)


def coded_block(block: int, held: list[tuple]) -> pa.RecordBatch:
    ids = pa.concat_arrays([x[0] for x in held])
    train = np.concatenate([x[1].to_numpy(zero_copy_only=False) for x in held]).astype(np.uint8)
    sizes = np.concatenate([x[4] for x in held])
    keys, at, counts = np.unique(np.concatenate([x[2][x[3]] for x in held]), return_inverse=True, return_counts=True)
    trained = np.bincount(at[np.repeat(train, sizes) == 1], minlength=len(keys)).astype(np.int64)
    by_count = np.argsort(-counts, kind="stable")
    rank = np.empty(len(keys), np.int32)
    rank[by_count] = np.arange(len(keys), dtype=np.int32)
    row = {"block": block, "n_docs": len(ids), "n_keys": len(keys), "n_tokens": len(at), "n_train": int(trained.sum()), "sizes": packed(sizes), "train": packed(train), "keys": pack_sorted(keys), "trained": packed(trained), "counts": packed(counts.astype(np.int64)), "codes": packed(rank[at])}
    columns = {k: pa.array([v], pa.binary() if isinstance(v, bytes) else pa.int64()) for k, v in row.items()}
    columns["ids"] = pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids)
    return pa.RecordBatch.from_pydict(columns)


def token_asks(parts: int):
    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                keys = unpack_sorted(r["keys"], r["n_keys"])
                rows = list(asks(r["block"], part_of_hash(keys, parts), keys, unpacked(r["trained"], r["n_keys"], np.int64)))
                yield from rows_table(rows, ASKS).to_batches()

    return ask


def token_counts(least: float):
    """Of the asks of a part: each row's training counts of its keys; and one row (target null) with the number of keys
    seen, of keys seen once, and the keys of at least ``least`` with their counts."""

    def count(table: pa.Table) -> pa.Table:
        keys, u, n = asked(table)
        part = table.column("part")[0].as_py()
        rows = [(t, part, len(k), packed(n[np.searchsorted(u, k)]), None, None) for t, k in zip(table.column("source").to_pylist(), keys, strict=True)]
        top = (n >= least) | ((u == END_HASH) & (n > 0))
        rows.append((None, part, int(top.sum()), pack_sorted(u[top]), packed(n[top]), packed(np.array([(n > 0).sum(), (n == 1).sum()]))))
        return rows_table(rows, ANSWERS)

    return count


# the tree


class Shape(NamedTuple):
    bits: int
    parts: int
    total: int
    root: np.ndarray  # training counts of the symbols
    min_count: int

    def mask(self, symbols: int) -> np.uint64:
        return np.uint64((1 << (self.bits * symbols)) - 1)

    def root_logp(self) -> np.ndarray:
        return np.log((self.root + 0.5) / (self.total + 0.5 * len(self.root)))


def _multiplied(x: np.ndarray, by: int, width: int) -> np.ndarray:
    return (x * np.uint64(by & ((1 << width) - 1))) & np.uint64((1 << width) - 1)


def scattered(x: np.ndarray, width: int, back: bool = False) -> np.ndarray:
    """Numbers below 2^width, one to one over that range; ``back`` undoes it."""
    if not width:
        return x
    by = pow(_ODD, -1, 1 << width) if back else _ODD
    x = _multiplied(x, by, width)
    return _multiplied(x ^ (x >> np.uint64((width + 1) // 2)), by, width)


def key_of(context: np.ndarray, symbol: np.ndarray, depth: int, shape: Shape) -> np.ndarray:
    return (scattered(context, depth * shape.bits) << np.uint64(shape.bits)) | symbol


def parts_of_key(key: np.ndarray, depth: int, shape: Shape) -> np.ndarray:
    """Parts by context, ascending with the key."""
    width = depth * shape.bits
    top = key >> np.uint64(shape.bits + max(0, width - 32))
    return (top * np.uint64(shape.parts)) >> np.uint64(min(width, 32))


def shorter(keys: np.ndarray, depth: int, shape: Shape) -> tuple[np.ndarray, np.ndarray]:
    """The key without the oldest symbol of each context, and the next symbol."""
    symbol = keys & shape.mask(1)
    context = scattered(keys >> np.uint64(shape.bits), depth * shape.bits, back=True)
    return key_of(context & shape.mask(depth - 1), symbol, depth - 1, shape), symbol


def line_keys(symbols: np.ndarray, sizes: np.ndarray, shape: Shape) -> np.ndarray:
    """For each token the key of the DEPTH symbols before it and itself. Before a text stand ends."""
    starts = np.cumsum(sizes + DEPTH) - sizes
    line = np.full(len(symbols) + DEPTH * len(sizes), END, np.uint64)
    at = np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(len(symbols))
    line[at] = symbols
    context = np.zeros(len(at), np.uint64)
    for k in range(DEPTH, 0, -1):
        context = (context << np.uint64(shape.bits)) | line[at - k]
    return key_of(context, line[at], DEPTH, shape)


def symbols_of(keys: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Symbols of token hashes; known: the hashes of the symbols after END, ascending."""
    found = np.full(len(keys), OTHER, np.uint16)
    if len(known):
        at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
        hit = known[at] == keys
        found[hit] = at[hit] + END + 1
    found[keys == END_HASH] = END
    return found


def token_places(r: dict) -> np.ndarray:
    """The place of each token of a block among its keys."""
    by_count = np.argsort(-unpacked(r["counts"], r["n_keys"], np.int64), kind="stable")
    return by_count[unpacked(r["codes"], r["n_tokens"], np.int32)]


def with_symbols(known: np.ndarray):
    """Blocks with symbols in place of hashes."""

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [packed(symbols_of(unpack_sorted(k.as_py(), n.as_py()), known)) for k, n in zip(batch.column("keys"), batch.column("n_keys"), strict=True)]
            columns = {c: batch.column(c) for c in batch.schema.names if c not in ("keys", "trained")}
            yield pa.RecordBatch.from_pydict({**columns, "symbols": pa.array(found, pa.binary())})

    return put


def gram_asks(shape: Shape):
    """Blocks to the questions for their distinct keys, with training counts."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.drop_columns(["ids"]).to_pylist():
                sizes = unpacked(r["sizes"], r["n_docs"], np.int32).astype(np.int64)
                keys = line_keys(unpacked(r["symbols"], r["n_keys"], np.uint16)[token_places(r)], sizes, shape)
                trained = np.repeat(unpacked(r["train"], r["n_docs"], np.uint8), sizes)
                both = np.sort((keys << np.uint64(1)) | trained)
                keys = both >> np.uint64(1)
                first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
                n = np.add.reduceat((both & np.uint64(1)).astype(np.int64), first)
                yield from rows_table(list(asks(r["block"], parts_of_key(keys[first], DEPTH, shape), keys[first], n)), ASKS).to_batches()

    return ask


def ask_shorter(depth: int, shape: Shape):
    """Of the asks of a part of contexts of a depth: its own, for the next shorter contexts."""

    def ask(table: pa.Table) -> pa.Table:
        _, u, n = asked(table)
        keys, n = summed(shorter(u, depth, shape)[0], n)
        return rows_table(list(asks(table.column("part")[0].as_py(), parts_of_key(keys, depth - 1, shape), keys, n)), ASKS)

    return ask


def tested(depth: int, shape: Shape):
    """Of the asks of a part of contexts of a depth and the answers on its shorter contexts: the answers, of each key
    the count, the count of its context, and the smoothed log probability in the longest state."""

    def answer(table: pa.Table, below: pa.Table | None) -> pa.Table:
        keys, u, n = asked(table)
        short, symbol = shorter(u, depth, shape)
        if depth == 1:
            up_n, up_total, up_logp = shape.root[symbol], np.full(len(u), shape.total), shape.root_logp()[symbol]
        else:
            below = below.sort_by("part").to_pylist()
            of = lambda name, dtype: np.concatenate([unpacked(r[name], r["n"], dtype) for r in below])
            at = np.searchsorted(np.unique(short), short)
            up_n, up_total, up_logp = of("counts", np.int64)[at], of("totals", np.int64)[at], of("logp", np.float32)[at].astype(float)
        context = u >> np.uint64(shape.bits)
        first = np.flatnonzero(np.append(True, context[1:] != context[:-1]))
        each = np.diff(np.append(first, len(u)))
        total, kinds = np.repeat(np.add.reduceat(n, first), each), np.repeat(np.add.reduceat((n > 0).astype(np.int64), first), each)
        gain = np.zeros(len(u))
        seen = n > 0
        gain[seen] = n[seen] * (np.log(n[seen] / total[seen]) - np.log(up_n[seen] / up_total[seen]))
        gain = np.repeat(np.add.reduceat(gain, first), each)
        state = (total >= shape.min_count) & (gain > 0.5 * kinds * np.log(max(1, shape.total)))
        logp = up_logp.copy()
        logp[state] = np.log((n[state] + kinds[state] * np.exp(up_logp[state])) / (total[state] + kinds[state]))
        logp, part = logp.astype(np.float32), table.column("part")[0].as_py()
        rows = []
        for target, k in zip(table.column("source").to_pylist(), keys, strict=True):
            at = np.searchsorted(u, k)
            rows.append((target, part, len(k), packed(n[at]) if depth < DEPTH else None, packed(total[at]) if depth < DEPTH else None, packed(logp[at])))
        return rows_table(rows, ANSWERS)

    return answer if depth > 1 else lambda table: answer(table, None)


def scorer(shape: Shape, kinds: int, unseen: float, others: float, id_col: str):
    """A block and its answers (on tokens: without logp) to the scores of its texts."""

    def score(blocks: pa.Table, answers: pa.Table) -> pa.Table:
        r = blocks.drop_columns(["ids"]).to_pylist()[0]
        answers = answers.sort_by("part").to_pylist()
        of = lambda name, dtype, rows: np.concatenate([unpacked(x[name], x["n"], dtype) for x in rows])
        c = of("counts", np.int64, [x for x in answers if x["logp"] is None])
        logp = of("logp", np.float32, [x for x in answers if x["logp"] is not None]).astype(float)
        sizes, place = unpacked(r["sizes"], r["n_docs"], np.int32).astype(np.int64), token_places(r)
        symbol = unpacked(r["symbols"], r["n_keys"], np.uint16)
        keys = line_keys(symbol[place], sizes, shape)
        own = np.where(symbol == OTHER, np.log(np.where(c > 0, c, unseen) / (others + unseen)), 0.0)
        base = np.log10((c + 0.5) / (shape.total + 0.5 * (kinds + 1)))
        starts = np.cumsum(sizes) - sizes
        over = lambda x: np.add.reduceat(x, starts)
        n, train = len(sizes), unpacked(r["train"], r["n_docs"], np.uint8) == 1
        ids = blocks.column("ids").combine_chunks().flatten()
        return pa.table({id_col: ids, "held_out": ~train, "n_tokens": sizes, "n_known": over((c > 0).astype(np.int64)[place]), "train_tokens": np.full(n, shape.total, np.int64), "base_score": over(base[place]), "score": over(logp[np.searchsorted(np.unique(keys), keys)] + own[place]) / LN10})

    return score


def score_texts(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", p_symbol: float = 3.2e-5, min_count: int = 2) -> DataFrame:
    """id, held_out, n_tokens, n_known, train_tokens, base_score, score for each row of docs."""
    spark = docs.sparkSession
    if p_symbol * (2**MOST_BITS - 3) < 1:
        raise ValueError(f"p_symbol must be at least {1 / (2**MOST_BITS - 3):.3g}")
    small_batches(spark)
    size = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    parts = max(-(-size // BLOCK_BYTES), shuffle_partitions(spark))
    id_type = docs.schema[id_col].dataType.simpleString()
    block = "block long, n_docs long, n_keys long, n_tokens long, n_train long, sizes binary, train binary, {}counts binary, codes binary, ids array<" + id_type + ">"
    rows = docs.select(F.col(id_col).alias("id"), in_training(id_col).alias("train"), F.col(text_col).alias("text"))
    blocks = materialize(rows.mapInArrow(coder, block.format("keys binary, trained binary, ")), "blocks")
    total = blocks.agg(F.coalesce(F.sum("n_train"), F.lit(0))).first()[0]

    asking = blocks.select("block", "n_keys", "keys", "trained").mapInArrow(token_asks(parts), ASKS)
    tokens = materialize(asking.groupBy("part").applyInArrow(token_counts(max(2.0, p_symbol * total)), ANSWERS), "tokens")
    kinds = once = 0
    hashes, n = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for r in tokens.where("target is null").select("n", "counts", "totals", "logp").toLocalIterator():  # at most 1 / p_symbol tokens in all
        seen = unpacked(bytes(r["logp"]), 2, np.int64)
        kinds, once = kinds + int(seen[0]), once + int(seen[1])
        hashes.append(unpack_sorted(bytes(r["counts"]), r["n"]))
        n.append(unpacked(bytes(r["totals"]), r["n"], np.int64))
    hashes, n = np.concatenate(hashes), np.concatenate(n)  # parts come in any order
    order = np.argsort(hashes)
    hashes, n = hashes[order], n[order]
    end = hashes == END_HASH
    known, others = hashes[~end], float(total - n.sum())
    root = np.concatenate([[int(others), int(n[end].sum())], n[~end]]).astype(np.int64)
    shape = Shape(max(1, int(len(root) - 1).bit_length()), parts, total, root, min_count)

    lines = blocks.mapInArrow(with_symbols(known), block.format("") + ", symbols binary")
    levels = {DEPTH: lines.mapInArrow(gram_asks(shape), ASKS)}
    for depth in range(DEPTH, 1, -1):
        levels[depth - 1] = levels[depth].groupBy("part").applyInArrow(ask_shorter(depth, shape), ASKS)
    answers = levels[1].groupBy("part").applyInArrow(tested(1, shape), ANSWERS)
    for depth in range(2, DEPTH + 1):
        answers = levels[depth].groupBy("part").cogroup(answers.groupBy("target")).applyInArrow(tested(depth, shape), ANSWERS)
    answers = answers.union(tokens.where("target is not null"))
    schema = f"`{id_col}` {id_type}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return lines.groupBy("block").cogroup(answers.groupBy("target")).applyInArrow(scorer(shape, kinds, max(0.5, float(once)), others, id_col), schema)
