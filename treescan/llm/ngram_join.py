"""N-gram Jaccard join: a blocked sparse product of the document by n-gram incidence with itself.

Rows of the incidence are distinct sets (documents of equal sets are one row), columns are n-grams. The product is never
formed whole; what the size of a set says about the overlap that a link needs discards most of it beforehand:

1. Column blocks. The incidence is dealt by columns into blocks of about as many cells at any size of the corpus. A block
   drops columns of one row, as they overlap with nothing, and gives the others a class of frequency. Columns that hold
   more than a 1/20,000 of all cells are found in the first pass and go past the blocks, in the last class.
2. Prefix. With columns in the order of class and hash, two rows that link share a column among the first
   n - least + 1 of each, least being the smallest overlap that a set of n can link with. Only these columns are products'
   candidates; each is a list of rows.
3. Pivots. In rounds, each list with rows of several components takes a row of its largest component as pivot, and each
   other row is multiplied with the pivot that it shares most lists with. Rows that link become one component.
4. Row blocks. Rows of lists that still hold several components are put in order of their most crowded list and of their
   size and cut into blocks. Two blocks are multiplied if a list holds rows of both, in different components and of sizes
   that can link. A product adds up the overlap counts of its row pairs over chunks of columns and discards pairs whose
   count and remaining columns cannot reach the bound that their sizes set; it gives back the links that join
   components, at most one less than its rows.

So a large group of near copies costs a product with a pivot for each row; rows that just miss it meet it in blocks of
the matrix, not pair by pair. Every pair of different sets that links is found. A column is the hash of an n-gram,
of 48 bits and the bits that number the block, so a hash gets longer as the corpus grows; a pair of 450 n-grams each is
miscounted with a chance of 1e-10 or less.

Null and empty texts have an empty set and no links; a text of fewer words than N has its whole sequence as its one
n-gram. Rows that repeat an id are one document, with the links of all their texts. Rows without id get the component of
the ids that they link with, else null.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from treescan.llm.common import LOWER, chunks, materialize, small_batches, word_hashes
from treescan.llm.near_dedup import components

N = 4
#: Link where LINK[0] * intersection >= LINK[1] * union.
LINK = (100, 85)
#: Cells of a column block, about. Columns of more than 1 / OFTEN of all cells go past the blocks.
BLOCK_CELLS, OFTEN = 4_000_000, 20_000
#: Column blocks of a small corpus, so that it is spread over tasks too.
BLOCKS = 32
#: Bytes of a column's name besides its block, so names have 48 bits and as many more as there are blocks.
CELL = 6
#: Frequencies from here on are one class.
CLASSES = (1 << 15) - 1
#: A row block has at most so many rows, and so many cells unless a single row has more.
ROWS, ROW_CELLS = 1024, 2_000_000
#: Columns of a chunk of a product.
CHUNK = 2048
#: Codes of at most so many bytes together are broadcast.
BROADCAST = 8 << 20

_M = np.random.default_rng(20240811).integers(0, 2**63, 64, np.uint64) * np.uint64(2) + np.uint64(1)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(32))


def gram_sets(texts: list[bytes]) -> list[np.ndarray]:
    """Ascending distinct n-gram hashes of each UTF-8 text, lower-cased in A-Z."""
    words = [t.translate(LOWER).split() for t in texts]
    flat = pa.array([w for x in words for w in x], pa.large_binary()).dictionary_encode()
    h = word_hashes(flat.dictionary.to_pylist())[flat.indices.to_numpy()] if len(flat) else np.zeros(0, np.uint64)
    grams = np.zeros(max(0, len(h) - N + 1), np.uint64)
    for k in range(N):
        grams += h[k : len(h) - N + 1 + k] * _M[k]
    grams = _mixed(grams)
    out, at = [], 0
    for x in words:
        if len(x) >= N:
            out.append(np.unique(grams[at : at + len(x) - N + 1]))
        elif x:
            out.append(_mixed(np.array([xxhash.xxh3_64_intdigest(b" ".join(x), seed=len(x))], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
        at += len(x)
    return out


def _code(s: np.ndarray) -> int | None:
    """Names a set: equal sets have one code."""
    return xxhash.xxh3_64_intdigest(s.tobytes()) - 2**63 if len(s) else None


def _sets(batch: pa.RecordBatch) -> Iterator[list[np.ndarray]]:
    texts = batch.column("text").fill_null("").cast(pa.binary()).to_pylist()
    for a, b in chunks(texts):
        yield gram_sets(texts[a:b])


def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """id, n_shingles and code of each row; in some row of each batch also the columns that are frequent in it."""
    for batch in batches:
        n, codes, cells = [], [], []
        for sets in _sets(batch):
            n += map(len, sets)
            codes += map(_code, sets)
            cells += sets
        columns, counts = np.unique(np.concatenate(cells), return_counts=True) if cells else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
        many = counts * 2 * OFTEN >= max(counts.sum(), 1)  # what is left out adds up to half of the share asked for
        often = pa.StructArray.from_arrays([pa.array(columns[many].view(np.int64)), pa.array(counts[many])], ["gram", "count"])
        ends = np.full(batch.num_rows + 1, len(often), np.int32)
        ends[0] = 0
        yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(n, pa.int64()), pa.array(codes, pa.int64()), pa.ListArray.from_arrays(pa.array(ends), often)], names=["id", "n_shingles", "code", "often"])


def incidence(bits: int, often: np.ndarray):
    """Texts to rows (block, code, cells): of each set its columns in each of 2^bits blocks, CELL bytes for each. Frequent
    columns go by numbers below 0, dealt by code."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for sets in _sets(batch):
                distinct = {_code(s): s for s in sets if len(s)}
                if not distinct:
                    continue
                grams = named(np.concatenate(list(distinct.values())), bits)
                code = np.repeat(np.array(list(distinct)), [len(s) for s in distinct.values()])
                block = (grams >> np.uint64(8 * CELL)).astype(np.int64)
                past = np.isin(grams, often)
                block[past] = -1 - (code[past] & ((1 << bits) - 1))
                order = np.lexsort((grams, block, code)) if past.any() else np.arange(len(grams))
                block, code, grams = block[order], code[order], grams[order]
                first = _firsts(block, code)
                cells = grams.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 8 - CELL :].tobytes()
                ends = pa.py_buffer((np.append(first, len(block)) * CELL).astype(np.int32).tobytes())
                yield pa.RecordBatch.from_arrays([pa.array(block[first]), pa.array(code[first]), pa.Array.from_buffers(pa.binary(), len(first), [None, ends, pa.py_buffer(cells)])], names=["block", "code", "cells"])

    return deal


def named(grams: np.ndarray, bits: int) -> np.ndarray:
    """Hashes cut to the leading bits that number the block and CELL bytes after them: as many more as the corpus is larger."""
    return grams >> np.uint64(max(0, 64 - bits - 8 * CELL))


def _firsts(*keys: np.ndarray) -> np.ndarray:
    """Where a new combination of keys begins."""
    new = np.zeros(len(keys[0]), bool)
    new[:1] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return np.flatnonzero(new)


class ColumnBlock:
    """Cells of a column block as they come in. What a column above CLASSES holds is given out early, so that memory is
    bounded whatever a column's frequency."""

    def __init__(self):
        self.seen: set[int] = set()
        self.codes: list[np.ndarray] = []
        self.grams: list[np.ndarray] = []
        self.cells = 0
        self.full = np.zeros(0, np.uint64)

    def unseen(self, codes: np.ndarray) -> np.ndarray:
        """Copies say the same again."""
        return np.array([c not in self.seen and not self.seen.add(c) for c in codes.tolist()], bool)

    def add(self, codes: np.ndarray, ends: np.ndarray, grams: np.ndarray) -> Iterator[pa.RecordBatch]:
        new = self.unseen(codes)
        keep = np.repeat(new, np.diff(ends))
        code, grams = np.repeat(codes, np.diff(ends))[keep], grams[keep]
        if len(self.full):
            over = np.isin(grams, self.full)
            yield from self._out(code[over], grams[over], np.full(int(over.sum()), CLASSES))
            code, grams = code[~over], grams[~over]
        self.codes.append(code)
        self.grams.append(grams)
        self.cells += len(code)
        if self.cells > 4 * BLOCK_CELLS:
            code, grams, df = self._counted()
            over = df >= CLASSES
            self.full = np.union1d(self.full, grams[over])
            yield from self._out(code[over], grams[over], df[over])
            self.codes, self.grams, self.cells = [code[~over]], [grams[~over]], int((~over).sum())

    def _counted(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        code, grams = np.concatenate(self.codes), np.concatenate(self.grams)
        _, at, counts = np.unique(grams, return_inverse=True, return_counts=True)
        return code, grams, counts[at]

    @staticmethod
    def _out(code: np.ndarray, grams: np.ndarray, df: np.ndarray) -> Iterator[pa.RecordBatch]:
        if len(code):
            first = _firsts(code)
            ends = pa.array(np.append(first, len(code)).astype(np.int32))
            classes = pa.ListArray.from_arrays(ends, pa.array(np.minimum(df, CLASSES).astype(np.int16)))
            yield pa.RecordBatch.from_arrays([pa.array(code[first]), classes, pa.ListArray.from_arrays(ends, pa.array(grams.view(np.int64)))], names=["code", "classes", "grams"])

    def end(self) -> Iterator[pa.RecordBatch]:
        if self.codes:
            code, grams, df = self._counted()
            shared = df > 1
            yield from self._out(code[shared], grams[shared], df[shared])


class PastBlock(ColumnBlock):
    """Frequent columns: all go on, in the last class."""

    def add(self, codes: np.ndarray, ends: np.ndarray, grams: np.ndarray) -> Iterator[pa.RecordBatch]:
        new = self.unseen(codes)
        keep = np.repeat(new, np.diff(ends))
        yield from self._out(np.repeat(codes, np.diff(ends))[keep], grams[keep], np.full(int(keep.sum()), CLASSES))


def shared_columns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (block, code, cells), those of a block one after the other, to rows (code, classes, grams) of the columns that
    several codes have."""
    block, at = ColumnBlock(), None
    for batch in batches:
        numbers = batch.column("block").to_numpy()
        cuts = np.append(_firsts(numbers), len(numbers)).tolist()
        for lo, hi in zip(cuts, cuts[1:], strict=False):
            if at is None or numbers[lo] != at:
                yield from block.end()
                at = numbers[lo]
                block = ColumnBlock() if at >= 0 else PastBlock()
            cells = batch.column("cells").slice(lo, hi - lo)
            sizes = pc.binary_length(cells).to_numpy() // CELL
            raw = np.frombuffer(b"".join(cells.to_pylist()), np.uint8).reshape(-1, CELL)
            grams = np.zeros((len(raw), 8), np.uint8)
            grams[:, 8 - CELL :] = raw
            grams = grams.view(">u8").reshape(-1).astype(np.uint64)
            # a name is unique over the blocks; those of frequent columns need only differ from each other
            grams |= np.uint64((int(at) if at >= 0 else 1 << (63 - 8 * CELL)) << (8 * CELL))
            yield from block.add(batch.column("code").slice(lo, hi - lo).to_numpy(), np.append(0, np.cumsum(sizes)), grams)
    yield from block.end()


def least_overlap(a, b):
    """The smallest overlap with which sets of a and b can link."""
    return -(-LINK[1] * (a + b) // sum(LINK))


def _by_column(sets: list[np.ndarray], columns: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The cells of sets in some columns, by column: row and column number of each, and how many each row has."""
    flat, row = np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    among = np.isin(flat, columns)
    row, column = row[among], np.searchsorted(columns, flat[among])
    order = np.argsort(column, kind="stable")
    return row[order], column[order], np.bincount(row, minlength=len(sets))


def product(one: list[np.ndarray], two: list[np.ndarray], size1: np.ndarray, size2: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Which of the wanted pairs link: a product by chunks of columns that discards pairs which can no longer reach their
    bound. Sizes are those of the whole sets, of which columns that no other set has may be left out."""
    bound = least_overlap(size1[:, None], size2[None, :])
    columns = np.intersect1d(np.concatenate(one), np.concatenate(two))
    (row1, col1, rest1), (row2, col2, rest2) = _by_column(one, columns), _by_column(two, columns)
    counts = np.zeros(bound.shape, np.int64)
    alive = wanted & (np.minimum(rest1[:, None], rest2[None, :]) >= bound)
    for lo in range(0, len(columns), CHUNK):
        if not alive.any():
            break
        width = min(CHUNK, len(columns) - lo)
        r1, r2 = np.flatnonzero(alive.any(axis=1)), np.flatnonzero(alive.any(axis=0))
        dense = []
        for row, col, rest, n in ((row1, col1, rest1, len(one)), (row2, col2, rest2, len(two))):
            a, b = np.searchsorted(col, [lo, lo + width])
            cells = np.zeros((n, width), np.float32)
            cells[row[a:b], col[a:b] - lo] = 1
            rest -= np.bincount(row[a:b], minlength=n)
            dense.append(cells)
        counts[np.ix_(r1, r2)] += (dense[0][r1] @ dense[1][r2].T).astype(np.int64)
        alive &= counts + np.minimum(rest1[:, None], rest2[None, :]) >= bound
    return alive & (counts >= bound)


def joined_edges(links: Iterator[tuple[int, int]], codes: list[int], roots: list[int]) -> list[tuple[int, int]]:
    """Of links between rows, those that join components."""
    top: dict[int, int] = {}

    def find(x: int) -> int:
        while top.get(x, x) != x:
            top[x] = top.get(top[x], top[x])
            x = top[x]
        return x

    out = []
    for i, j in links:
        a, b = find(roots[i]), find(roots[j])
        if a != b:
            top[a] = b
            out.append((codes[i], codes[j]))
    return out


def multiply(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
    """Rows (x, y, block, code, n, root, grams) of two row blocks x and y, or of one block x = y, to links (a, b) of rows in
    different components."""
    rows = rows.combine_chunks().to_batches()[0]
    block, n = rows.column("block").to_numpy(), rows.column("n").to_numpy()
    codes, roots = rows.column("code").to_numpy(), rows.column("root").to_numpy()
    ends = rows.column("grams").offsets.to_numpy()
    flat = rows.column("grams").values.to_numpy().view(np.uint64)
    sets = [flat[a:b] for a, b in zip(ends, ends[1:], strict=False)]
    x, y = key[0].as_py(), key[1].as_py()
    one, two = np.flatnonzero(block == x), np.flatnonzero(block == y)
    wanted = roots[one][:, None] != roots[two][None, :]
    if x == y:
        wanted &= one[:, None] < two[None, :]
    edges: list[tuple[int, int]] = []
    if wanted.any():
        links = product([sets[i] for i in one], [sets[i] for i in two], n[one], n[two], wanted)
        edges = joined_edges(((one[i], two[j]) for i, j in np.argwhere(links)), codes.tolist(), roots.tolist())
    return pa.table({"a": pa.array([e[0] for e in edges], pa.int64()), "b": pa.array([e[1] for e in edges], pa.int64())})


def row_blocks(rows: DataFrame, order: list[str]) -> DataFrame:
    """rows (with n) with ``block``: cut in an order of columns into blocks of at most ROWS rows and about ROW_CELLS cells."""
    parts = materialize(rows.repartitionByRange(*order).withColumn("part", F.spark_partition_id()), "row_ranges")
    sofar = F.sum(F.greatest("n", F.lit(ROW_CELLS // ROWS + 1))).over(Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    block = F.col("part").cast("long") * (1 << 32) + F.floor(F.coalesce(sofar, F.lit(0)) / ROW_CELLS)
    return parts.withColumn("block", block).drop("part")


def _several(posts: DataFrame) -> DataFrame:
    """The posts (gram, code, n, root) of lists with several components."""
    mixed = materialize(posts.groupBy("gram").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("gram"), "mixed_lists")
    return posts.join(mixed, "gram", "left_semi")


def _pivot_links(live: DataFrame, matrix: DataFrame, turn: int) -> tuple[DataFrame, int]:
    """Links of rows with the pivot that they share most lists with, and how many rows were tried."""
    of_root = live.groupBy("gram", "root").agg(F.count("*").alias("members"), F.min_by(F.struct("code", "n"), F.xxhash64("code", F.lit(turn))).alias("pivot"))
    pivots = of_root.groupBy("gram").agg(F.max(F.struct("members", "root", "pivot")).alias("p")).select("gram", F.col("p.root").alias("pivot_root"), "p.pivot")
    # written, so that AQE can split the lists of the join
    shared = live.join(materialize(pivots, "pivots"), "gram").where("root <> pivot_root").groupBy("code", "n", "root", "pivot", "pivot_root").agg(F.count("*").alias("lists"))
    can = LINK[0] * F.least("n", "pivot.n") >= LINK[1] * F.greatest("n", "pivot.n")
    best = shared.where(can).groupBy("code", "n", "root").agg(F.max(F.struct("lists", "pivot", "pivot_root")).alias("x"))
    tries = best.select("code", "n", "root", F.col("x.pivot.code").alias("pivot"), F.col("x.pivot.n").alias("pivot_n"), F.col("x.pivot_root").alias("pivot_root"))
    tries = materialize(row_blocks(tries, ["pivot", "code"]), "tries")
    # a pivot and the rows of a block that try it, which are at most ROWS
    rows = tries.select(F.col("block").alias("x"), F.col("pivot").alias("y"), F.lit(0).cast("long").alias("block"), "code", "n", "root")
    tops = tries.select(F.col("block").alias("x"), F.col("pivot").alias("y"), F.lit(1).cast("long").alias("block"), F.col("pivot").alias("code"), F.col("pivot_n").alias("n"), F.col("pivot_root").alias("root")).distinct()
    tried = tries.count()
    both = _with_grams(rows.unionByName(tops), 2 * tried, matrix)
    links = both.groupBy("x", "y").applyInArrow(lambda key, t: multiply((pa.scalar(0), pa.scalar(1)), t), "a long, b long")
    return materialize(links, "links"), tried


def _with_grams(rows: DataFrame, most: int, matrix: DataFrame) -> DataFrame:
    """rows (x, y, block, code, n, root), at most so many, with the grams of their codes; few rows leave the matrix where it is."""
    rows = F.broadcast(rows) if most * 64 <= BROADCAST else rows
    return matrix.join(rows, "code").select("x", "y", "block", "code", "n", "root", "grams")


def _block_links(live: DataFrame, matrix: DataFrame) -> DataFrame:
    """Links of rows of different components in lists that hold several, by products of row blocks."""
    sizes = live.groupBy("gram").agg(F.count("*").alias("members"))
    crowd = live.join(materialize(sizes, "list_sizes"), "gram").groupBy("code", "n", "root").agg(F.max(F.struct("members", "gram")).alias("crowd"))
    rows = materialize(row_blocks(crowd.select("code", "n", "root", "crowd"), ["crowd", "root", "n", "code"]), "row_blocks")
    placed = materialize(live.select("gram", "code").join(rows.select("code", "n", "root", "block"), "code"), "placed")
    of_list = placed.groupBy("gram", "block").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.min("n").alias("least"), F.max("n").alias("most")).groupBy("gram").agg(F.collect_list(F.struct("block", "lo", "hi", "least", "most")).alias("blocks"))
    own = F.col("root")
    fits = lambda b: ((b["lo"] != own) | (b["hi"] != own)) & (LINK[0] * F.least(F.col("n"), b["most"]) >= LINK[1] * F.greatest(F.col("n"), b["least"]))
    met = placed.join(materialize(of_list, "list_blocks"), "gram").withColumn("others", F.transform(F.filter("blocks", fits), lambda b: b["block"]))
    partners = met.groupBy("code", "n", "root", "block").agg(F.array_distinct(F.flatten(F.collect_list("others"))).alias("others"))
    each = partners.select("code", "n", "root", "block", F.explode("others").alias("other"))
    each = each.select(F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"), "block", "code", "n", "root")
    each = materialize(each, "block_rows")
    return _with_grams(each, each.count(), matrix).groupBy("x", "y").applyInArrow(multiply, "a long, b long")


def _renamed(rooted: DataFrame, edges: DataFrame) -> DataFrame:
    """rooted (..., root) after components that edges (a, b) between codes join become one."""
    own = rooted.select("code", "root").distinct()
    across = edges.join(own.toDF("a", "root_a"), "a").join(own.toDF("b", "root_b"), "b").select(F.col("root_a").alias("a"), F.col("root_b").alias("b"))
    joined = components(across).select(F.col("node").alias("root"), F.col("root").alias("top"))
    return rooted.join(joined, "root", "left").withColumn("root", F.coalesce("top", "root")).drop("top")


def shared_matrix(docs: DataFrame, sizes: DataFrame, often: list[int], cells: int) -> DataFrame:
    """code, n, grams: the columns of each set of docs (text) that other sets have too, in the order of class and hash.
    sizes: code, n; often: columns that go past the blocks; cells: of the whole matrix, about."""
    bits = (max(cells, (BLOCKS - 1) * BLOCK_CELLS) // BLOCK_CELLS).bit_length()
    past = named(np.array(often, np.int64).view(np.uint64), bits)
    dealt = docs.select("text").mapInArrow(incidence(bits, past), "block long, code long, cells binary")
    sharing = dealt.repartition("block").sortWithinPartitions("block").mapInArrow(shared_columns, "code long, classes array<smallint>, grams array<long>")
    cell = F.arrays_zip("classes", "grams")
    matrix = sharing.groupBy("code").agg(F.sort_array(F.flatten(F.collect_list(cell))).alias("cells"))
    # sizes are grouped by code like the cells, so nothing is shuffled again
    return materialize(matrix.join(sizes, "code").select("code", "n", F.transform("cells", lambda c: c["grams"]).alias("grams")), "matrix")


def prefix_posts(matrix: DataFrame) -> DataFrame:
    """gram, code, n: the columns of each row that a link cannot do without, if others have them too."""
    least = F.ceil(LINK[1] * F.col("n") / LINK[0])
    first = F.col("n") - least + 1 - (F.col("n") - F.size("grams"))  # columns of one row come first and need no place
    posts = matrix.where(first > 0).select("code", "n", F.explode(F.slice("grams", F.lit(1), first.cast("int"))).alias("gram"))
    posts = materialize(posts, "posts")
    lists = posts.groupBy("gram").agg(F.count("*").alias("m")).where("m > 1").select("gram")
    return posts.join(materialize(lists, "lists"), "gram", "left_semi")


def find_links(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: id, n_shingles, component_id."""
    small_batches(docs.sparkSession)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    id_type = docs.schema[id_col].dataType.simpleString()
    rows = materialize(texts.mapInArrow(describe, f"id {id_type}, n_shingles long, code long, often array<struct<gram: long, count: long>>"), "sets")
    cells = rows.agg(F.coalesce(F.sum("n_shingles"), F.lit(0))).first()[0]
    # at most 2 * OFTEN columns
    many = rows.select(F.explode("often").alias("o")).groupBy("o.gram").agg(F.sum("o.count").alias("count")).where(F.col("count") * 2 * OFTEN >= cells)
    sizes = rows.where("code is not null").groupBy("code").agg(F.first("n_shingles").alias("n"))
    matrix = shared_matrix(texts, sizes, [r[0] for r in many.select("gram").collect()], cells)
    # every list has several rows, and so several components for now
    live = materialize(prefix_posts(matrix).withColumn("root", F.col("code")), "live")
    current = materialize(live.select("code", "root").distinct(), "roots")
    # products need the rows of lists only
    active = current.select("code")
    matrix = materialize(matrix.drop("n").join(F.broadcast(active) if current.count() * 16 <= BROADCAST else active, "code", "left_semi"), "rows_of_lists")
    turn = 0
    while True:
        turn += 1
        links, tried = _pivot_links(live, matrix, turn)
        found = links.count()
        if found:
            current = materialize(_renamed(current, links), "roots")
            live = materialize(_several(live.drop("root").join(current, "code")), "live")
        if 10 * found < tried or not found:
            break
    current = materialize(_renamed(current, materialize(_block_links(live, matrix), "links")), "roots")
    # the sets of an id belong together, and so do the ids of a set
    named = materialize(rows.where("id is not null and code is not null").join(current, "code", "left").select("id", F.coalesce("root", "code").alias("root")).distinct(), "named")
    of_id = named.groupBy("id").agg(F.min("root").alias("a"), F.max("root").alias("z")).where("a < z").select("id", "a")
    merged = components(named.join(of_id, "id").where("root > a").select("a", F.col("root").alias("b"))).select(F.col("node").alias("root"), F.col("root").alias("top"))
    top = lambda df: df.join(merged, "root", "left").withColumn("root", F.coalesce("top", "root")).drop("top")
    smallest = materialize(top(named).groupBy("root").agg(F.min("id").alias("component")), "smallest")
    whole = top(rows.join(current, "code", "left").withColumn("root", F.coalesce("root", "code"))).join(smallest, "root", "left")
    by_id = whole.where("id is not null").groupBy("id").agg(F.min("component").alias("of_id"))
    return whole.join(by_id, "id", "left").select(F.col("id").alias(id_col), "n_shingles", F.coalesce("component", "of_id", "id").alias("component_id"))
