"""Byte-level BPE encoding and decoding with numpy matrices.

Texts are split by the pattern; the distinct pieces of a batch are put, by length, into padded matrices of token ids.
In each round every row merges its leftmost pair of least rank, found through a hash table of pairs, and closes the
gap; rows without a pair leave the matrix. A piece of more than LONG bytes is laid over several rows: in each round its
least rank is that of its rows, all leftmost pairs of that rank merge at once (or the first one alone, where a merge
gives a pair of still smaller rank), and only the rows that they touch close their gaps. Null texts count as empty and
have no ids.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from treescan.llm.common import chunks, free_name, small_batches

NONE = np.int32(2**31 - 1)
LONG = 256
CELLS = 1 << 20
#: Columns of the rows that a long piece is laid over.
SEGMENT = 64
#: Bytes of distinct pieces that a worker remembers between batches, besides those of the last one.
REMEMBERED_BYTES = 600_000


class PairTable:
    """Open-addressing hash table from a pair of ids to the id of their merge."""

    def __init__(self, pairs: np.ndarray, merged: np.ndarray):
        bits = max(4, int(2 * len(pairs) + 1).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), np.int64((1 << bits) - 1)
        self.keys = np.full(1 << bits, -1, np.int64)
        self.values = np.full(1 << bits, NONE, np.int32)
        todo = np.arange(len(pairs))
        at = self.slot(pairs)
        while len(todo):
            free = self.keys[at] == -1
            first = np.unique(at[free], return_index=True)[1]
            put = np.flatnonzero(free)[first]
            self.keys[at[put]], self.values[at[put]] = pairs[todo[put]], merged[todo[put]]
            rest = np.ones(len(todo), bool)
            rest[put] = False
            todo, at = todo[rest], (at[rest] + 1) & self.mask

    def slot(self, pairs: np.ndarray) -> np.ndarray:
        return ((pairs.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The id of each pair's merge; NONE where there is none or an id is -1."""
        pairs = (left.astype(np.int64) << 32) | (right.astype(np.int64) & 0xFFFFFFFF)
        out = np.full(pairs.shape, NONE, np.int32)
        todo = np.flatnonzero((left >= 0) & (right >= 0))
        flat, sought = out.reshape(-1), pairs.reshape(-1)[todo]
        at = self.slot(sought)
        while len(todo):
            there = self.keys[at]
            hit = there == sought
            flat[todo[hit]] = self.values[at[hit]]
            go = ~hit & (there != -1)
            todo, sought, at = todo[go], sought[go], (at[go] + 1) & self.mask
        return out


class Vocabulary:
    """Ranks of byte strings (id = rank) and all pairs that merge into one of them."""

    def __init__(self, tokens: list[bytes]):
        ids = {t: i for i, t in enumerate(tokens)}
        self.tokens = tokens
        self.of_byte = np.array([ids.get(bytes([b]), -1) for b in range(256)], np.int32)
        if (self.of_byte < 0).any():
            raise ValueError("each byte must be a token")
        found = [(ids[t[:k]] << 32 | ids[t[k:]], i) for i, t in enumerate(tokens) for k in range(1, len(t)) if t[:k] in ids and t[k:] in ids]
        self.pairs = PairTable(np.array([p for p, _ in found], np.int64), np.array([m for _, m in found], np.int32))

    @classmethod
    def read(cls, path: str) -> Vocabulary:
        """From a file with a line for each token: base64 and rank."""
        with open(path, "rb") as f:
            ranks = sorted((int(r), base64.b64decode(t)) for t, r in (line.split() for line in f if line.strip()))
        if [r for r, _ in ranks] != list(range(len(ranks))):
            raise ValueError("ranks must be 0, 1, 2, ...")
        return cls([t for _, t in ranks])

    def encode_pieces(self, pieces: list[bytes]) -> list[list[int]]:
        """Ids of each piece, merged apart from the others."""
        out: list[list[int]] = [[]] * len(pieces)
        sizes = np.array([len(p) for p in pieces], np.int64)
        order = np.argsort(sizes, kind="stable")
        start = int(np.searchsorted(sizes[order], 1))
        while start < len(order):
            width = 1 << max(1, int(sizes[order[start]] - 1).bit_length())
            if width > LONG:
                rows = order[start:].tolist()
                for i, ids in zip(rows, self.encode_laid([pieces[i] for i in rows]), strict=True):
                    out[i] = ids
                break
            stop = min(int(np.searchsorted(sizes[order], width, "right")), start + max(1, CELLS // width))
            rows = order[start:stop]
            for i, ids in zip(rows.tolist(), self.encode_matrix([pieces[i] for i in rows.tolist()], width), strict=True):
                out[i] = ids
            start = stop
        return out

    def encode_matrix(self, pieces: list[bytes], width: int) -> list[list[int]]:
        raw = np.frombuffer(b"".join(p.ljust(width, b"\0") for p in pieces), np.uint8).reshape(-1, width)
        n = np.array([len(p) for p in pieces])
        ids = np.where(np.arange(width) < n[:, None], self.of_byte[raw], np.int32(-1))
        done: list[list[int]] = [[]] * len(pieces)
        rows = np.arange(len(pieces))
        ranks = self.pairs.find(ids[:, :-1], ids[:, 1:])
        while len(rows):
            best = ranks.argmin(axis=1)
            k = np.arange(len(rows))
            least = ranks[k, best]
            over = least == NONE
            if over.any():
                kept = ids[over]
                counts = (kept >= 0).sum(axis=1)
                flat, ends = kept[kept >= 0].tolist(), np.cumsum(counts).tolist()
                for i, a, b in zip(rows[over].tolist(), [0, *ends], ends):
                    done[i] = flat[a:b]
                go = ~over
                rows, ids, ranks, best, least = rows[go], ids[go], ranks[go], best[go], least[go]
                if not len(rows):
                    break
                used = int((ids >= 0).sum(axis=1).max())
                ids, ranks = ids[:, :used], ranks[:, : used - 1]
                k = np.arange(len(rows))
            w = ids.shape[1]
            ids[k, best] = least
            take = np.arange(w - 1) + (np.arange(w - 1) > best[:, None])
            ids = np.take_along_axis(ids, take, axis=1)
            if w == 2:
                ranks = np.full((len(rows), 1), NONE, np.int32)
                ids = np.concatenate([ids, np.full((len(rows), 1), -1, np.int32)], axis=1)
                continue
            # pair j now starts where pair j or j + 1 did; the two pairs at the merge are looked up anew
            take = np.arange(w - 2) + (np.arange(w - 2) >= best[:, None])
            ranks = np.take_along_axis(ranks, take, axis=1)
            right = best < w - 2
            ranks[k[right], best[right]] = self.pairs.find(ids[k[right], best[right]], ids[k[right], best[right] + 1])
            left = best > 0
            ranks[k[left], best[left] - 1] = self.pairs.find(ids[k[left], best[left] - 1], ids[k[left], best[left]])
        return done

    def encode_laid(self, pieces: list[bytes]) -> list[list[int]]:
        """Ids of long pieces, each over rows of SEGMENT columns that follow each other."""
        m = Laid(self, pieces)
        while (least := m.least()) is not None:
            m.merge(m.pairs(least), least)
        return m.result()

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


class Laid:
    """Long pieces as rows of token ids, -1 after the last. The pair of a row's last token and the next row's first has
    its rank in the column of the last token. One more row of -1 stands for no row."""

    def __init__(self, vocabulary: Vocabulary, pieces: list[bytes]):
        self.find = vocabulary.pairs.find
        n_rows = np.array([-(-len(p) // SEGMENT) for p in pieces])
        self.piece = np.repeat(np.arange(len(pieces)), n_rows)
        self.starts = np.cumsum(n_rows) - n_rows
        raw = np.frombuffer(b"".join(p.ljust(r * SEGMENT, b"\0") for p, r in zip(pieces, n_rows.tolist(), strict=True)), np.uint8).reshape(-1, SEGMENT)
        n = np.full(len(raw), SEGMENT)
        n[self.starts + n_rows - 1] = [len(p) - (r - 1) * SEGMENT for p, r in zip(pieces, n_rows.tolist(), strict=True)]
        self.none = len(raw)
        self.count = np.append(n, 0)
        self.ids = np.full((len(raw) + 1, SEGMENT), -1, np.int32)
        self.ids[:-1] = np.where(np.arange(SEGMENT) < n[:, None], vocabulary.of_byte[raw], np.int32(-1))
        self.after, self.before = np.arange(1, len(raw) + 2), np.arange(-1, len(raw))
        self.after[self.starts + n_rows - 1] = self.none
        self.before[self.starts] = self.none
        self.ranks = np.full((len(raw) + 1, SEGMENT), NONE, np.int32)
        self.row_least = np.full(len(raw) + 1, NONE, np.int32)
        self.rank(np.arange(len(raw)))

    def rank(self, rows: np.ndarray) -> None:
        left = self.ids[rows]
        right = np.concatenate([left[:, 1:], np.full((len(rows), 1), -1, np.int32)], axis=1)
        full = np.flatnonzero(self.count[rows])
        right[full, self.count[rows[full]] - 1] = self.ids[self.after[rows[full]], 0]
        self.ranks[rows] = self.find(left, right)
        self.row_least[rows] = self.ranks[rows].min(axis=1)

    def least(self) -> np.ndarray | None:
        """The least rank of each piece; None where no piece has a pair."""
        least = np.minimum.reduceat(self.row_least[:-1], self.starts)
        return least if (least != NONE).any() else None

    def pairs(self, least: np.ndarray) -> tuple[np.ndarray, ...]:
        """Row and column of both tokens of the pairs of least rank, each leftmost in what overlaps."""
        rows = np.flatnonzero((self.row_least[:-1] == least[self.piece]) & (self.row_least[:-1] != NONE))
        at, col = np.nonzero(self.ranks[rows] == self.row_least[rows][:, None])
        row = rows[at]
        last = col + 1 == self.count[row]
        row2, col2 = np.where(last, self.after[row], row), np.where(last, 0, col + 1)
        overlaps = np.append(False, (row[1:] == row2[:-1]) & (col[1:] == col2[:-1]))
        if overlaps.any():
            k = np.arange(len(row))
            even = (k - np.maximum.accumulate(np.where(overlaps, 0, k))) % 2 == 0
            row, col, row2, col2 = row[even], col[even], row2[even], col2[even]
        return row, col, row2, col2

    def before_smaller(self, pairs: tuple[np.ndarray, ...], new: np.ndarray) -> tuple[np.ndarray, ...]:
        """pairs, of a piece only the first where merging one after the other would give a pair of smaller rank on the
        way. new: the token of each pair."""
        row, col, row2, col2 = pairs
        first = col == 0
        before = self.before[row]
        left = self.ids[np.where(first, before, row), np.where(first, self.count[before], col) - 1]
        last = col2 + 1 == self.count[row2]
        row3, col3 = np.where(last, self.after[row2], row2), np.where(last, 0, col2 + 1)
        follows = np.append(False, (row[1:] == row3[:-1]) & (col[1:] == col3[:-1]))
        left[follows] = new[follows]
        smaller = (self.find(left, new) < new) | (self.find(new, self.ids[row3, col3]) < new)
        if not smaller.any():
            return pairs
        piece = self.piece[row]
        keep = ~np.isin(piece, piece[smaller]) | np.append(True, piece[1:] != piece[:-1])
        return tuple(x[keep] for x in pairs)

    def merge(self, pairs: tuple[np.ndarray, ...], least: np.ndarray) -> None:
        row, col, row2, col2 = self.before_smaller(pairs, least[self.piece[pairs[0]]])
        self.ids[row, col] = least[self.piece[row]]
        self.ids[row2, col2] = -1
        rows = np.unique(np.concatenate([row, row2]))
        old = self.ids[rows]
        left = old >= 0
        n = left.sum(axis=1)
        new = np.full_like(old, -1)
        new[np.arange(SEGMENT) < n[:, None]] = old[left]
        self.ids[rows], self.count[rows] = new, n
        empty = rows[n == 0]  # no two that follow each other: a row between them has the merged token
        near = np.unique(np.concatenate([rows, self.before[rows]]))
        self.after[self.before[empty]], self.before[self.after[empty]] = self.after[empty], self.before[empty]
        self.rank(near[near != self.none])

    def result(self) -> list[list[int]]:
        rows = self.ids[:-1]
        flat = rows[rows >= 0].tolist()
        ends = np.cumsum(np.add.reduceat(self.count[:-1], self.starts)).tolist()
        return [flat[a:b] for a, b in zip([0, *ends], ends)]


class Coder:
    """Encodes and decodes texts; remembers the ids of pieces."""

    def __init__(self, vocabulary: Vocabulary, pattern: str):
        self.vocabulary = vocabulary
        self.split = regex.compile(pattern).findall
        self.ids: dict[str, str] = {}
        self.bytes: dict[str, bytes] = {}
        self.held = 0

    def learn(self, pieces: set[str]) -> None:
        if self.held > REMEMBERED_BYTES:
            self.ids.clear()
            self.bytes.clear()
            self.held = 0
        new = [p for p in pieces if p not in self.ids]
        self.held += sum(map(len, new))
        for p, ids in zip(new, self.vocabulary.encode_pieces([p.encode() for p in new]), strict=True):
            self.ids[p] = " ".join(map(str, ids))
            self.bytes[p] = self.vocabulary.decode(ids)

    def encode(self, texts: list[str]) -> tuple[list[str], list[bytes]]:
        """Of each text: its ids as decimals joined by a space, and the bytes that they decode to."""
        split = [self.split(t) for t in texts]
        self.learn(set().union(*split))
        return [" ".join(map(self.ids.__getitem__, s)) for s in split], [b"".join(map(self.bytes.__getitem__, s)) for s in split]


def coder_udf(spark: SparkSession, path: str, pattern: str, with_ids: bool):
    """UDF of a text: struct of n_tokens, ids_sha256, decoded_sha256 and, where asked for, ids.

    The vocabulary (a fixed file of about a megabyte) is read on the driver and broadcast.
    """
    fields = [T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]
    shared = spark.sparkContext.broadcast(Vocabulary.read(path))
    own: list[Coder] = []

    def code(text: pa.Array) -> pa.Array:
        if not own:
            own.append(Coder(shared.value, pattern))
        texts = text.fill_null("").to_pylist()
        n, a, b, all_ids = [], [], [], []
        for lo, hi in chunks(texts, 1_500_000):
            ids, decoded = own[0].encode(texts[lo:hi])
            n += [s.count(" ") + 1 if s else 0 for s in ids]
            a += [hashlib.sha256(s.encode()).hexdigest() for s in ids]
            b += [hashlib.sha256(s).hexdigest() for s in decoded]
            if with_ids:
                all_ids += [np.fromstring(s, np.int32, sep=" ") for s in ids]
        columns = [pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())]
        return pa.StructArray.from_arrays(columns + [pa.array(all_ids, pa.list_(pa.int32()))] * with_ids, [f.name for f in fields] + ["ids"] * with_ids)

    return F.arrow_udf(code, T.StructType(fields + [T.StructField("ids", T.ArrayType(T.IntegerType()))] * with_ids))


def encode(docs: DataFrame, path: str, pattern: str, *, text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """docs with a struct column ``bpe`` (or a free name; the last column): n_tokens, ids_sha256, decoded_sha256, ids."""
    small_batches(docs.sparkSession)
    return docs.withColumn(free_name(docs, "bpe"), coder_udf(docs.sparkSession, path, pattern, with_ids)(F.col(text_col)))


def decode(coded: DataFrame, path: str, *, ids_col: str = "ids") -> DataFrame:
    """coded with a binary column ``decoded`` (or a free name; the last column): the bytes of a list of ids."""
    shared = coded.sparkSession.sparkContext.broadcast(Vocabulary.read(path).tokens)

    def back(ids: pa.Array) -> pa.Array:
        return pa.array([None if x is None else b"".join(map(shared.value.__getitem__, x)) for x in ids.to_pylist()], pa.binary())

    return coded.withColumn(free_name(coded, "decoded"), F.arrow_udf(back, T.BinaryType())(F.col(ids_col)))
