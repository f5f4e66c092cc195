"""Exact dedup: a tree merge of sorted digest runs.

A row's key is the SHA-256 of its normalised text, its length in bytes and a second 64-bit hash, so that equal means all
three agree. Rows are dealt into 2^r runs by a hash of id and key, and each run is sorted once and kept as chunks of
distinct keys with their smallest id and number of copies. In round k run i exchanges with the run whose number differs
in bit k from the top: each keeps the half of its key range that its own number stands for, so after r rounds a run owns
the keys that begin with its number. What comes in is already sorted, so it is merged chunk by chunk, without a sort: a
merge holds only the chunks that overlap, and every merge keeps the smallest id and adds up the copies of a key. The
answers go back down through the first runs, so a text that a third of all rows share is a few rows in each task.

A null text counts as empty. A null id never wins against an id; among null ids alone the group is kept. Of rows that
repeat both id and text one is kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from treescan.llm.common import BLANKS, free_name, materialize, shuffle_partitions

KEY_BYTES = 48
KEYS = f"S{KEY_BYTES}"
#: Distinct keys of a chunk.
CHUNK = 1 << 14


def normalised(text: Column) -> Column:
    """The text with each run of blanks as one space, as UTF-8 bytes."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), BLANKS, " ").cast("binary")


def key_of(text: Column) -> Column:
    """SHA-256, length and second hash of a normalised text, as KEY_BYTES bytes."""
    number = lambda n: F.unhex(F.lpad(F.hex(n), 16, "0"))
    return F.concat(F.unhex(F.sha2(text, 256)), number(F.octet_length(text).cast("long")), number(F.xxhash64(text)))


class Run:
    """Ascending distinct keys with ids (null where no copy has one) and copies."""

    def __init__(self, keys: np.ndarray, ids: pa.Array, copies: np.ndarray):
        self.keys, self.ids, self.copies = keys, ids, copies

    @classmethod
    def of(cls, keys: pa.Array, ids: pa.Array, copies: np.ndarray) -> Run:
        """Rows in the order of their keys, folded key by key: pyarrow's groups come in any order, so they are numbered."""
        flat = np.frombuffer(b"".join(keys.to_pylist()), KEYS)
        first = np.append(True, flat[1:] != flat[:-1])
        rows = pa.table({"group": np.cumsum(first), "id": ids, "copies": copies})
        got = rows.group_by("group", use_threads=False).aggregate([("id", "min"), ("copies", "sum")]).sort_by("group")
        return cls(flat[first], got.column("id_min").combine_chunks().cast(ids.type), got.column("copies_sum").to_numpy()).ascending()

    def ascending(self) -> Run:
        """Itself; a run whose keys do not ascend is an error, as all merges take it that they do."""
        if not (self.keys[1:] > self.keys[:-1]).all():
            raise ValueError("the keys of a run do not ascend")
        return self

    def __len__(self) -> int:
        return len(self.keys)

    def part(self, lo: int, hi: int) -> Run:
        return Run(self.keys[lo:hi], self.ids.slice(lo, hi - lo), self.copies[lo:hi])

    def with_(self, other: Run) -> Run:
        """Both merged: new keys of the other go in at their places, equal keys become one."""
        at = np.searchsorted(self.keys, other.keys)
        same = np.append(self.keys, b"")[at] == other.keys
        same &= at < len(self.keys)
        copies = self.copies.copy()
        copies[at[same]] += other.copies[same]
        partner = np.full(len(self.keys), -1)
        partner[at[same]] = np.flatnonzero(same)
        ids = pc.min_element_wise(self.ids, other.ids.take(pa.array(partner, mask=partner < 0)), skip_nulls=True)
        new = np.flatnonzero(~same)
        order = np.insert(np.arange(len(self.keys)), at[new], len(self.keys) + np.arange(len(new)))
        ids = pa.concat_arrays([ids, other.ids.take(pa.array(new))]).take(pa.array(order))
        return Run(np.insert(self.keys, at[new], other.keys[new]), ids, np.insert(copies, at[new], other.copies[new]))

    def owners(self, bits: int) -> np.ndarray:
        """The leading bits of the keys."""
        lead = np.ascontiguousarray(self.keys.view(np.uint8).reshape(-1, KEY_BYTES)[:, :4]).view(">u4").reshape(-1)
        return lead >> np.uint32(32 - bits)


def sent(run: int, source: int, of: Run, k: int, bits: int) -> Iterator[pa.RecordBatch]:
    """The chunks of a run after k rounds, each to the run that it goes to in the next one."""
    pieces = [(run, of.ascending())]
    if k < bits:
        place = bits - 1 - k
        cut = int(((of.owners(bits) >> np.uint32(place)) & np.uint32(1) == 0).sum())
        pieces = [(run & ~(1 << place), of.part(0, cut)), (run | (1 << place), of.part(cut, len(of)))]
    for to, piece in pieces:
        for lo in range(0, len(piece), CHUNK):
            c = piece.part(lo, min(lo + CHUNK, len(piece)))
            ids = pa.ListArray.from_arrays(pa.array([0, len(c)], pa.int32()), c.ids)
            keys = c.keys.tobytes()
            yield pa.RecordBatch.from_arrays([pa.array([to], pa.int32()), pa.array([source], pa.int32()), pa.array([keys[:KEY_BYTES]]), pa.array([keys]), ids, pa.array([c.copies.tobytes()])], names=["run", "source", "low", "keys", "ids", "copies"])


def read_chunks(batch: pa.RecordBatch) -> Iterator[tuple[int, int, Run]]:
    for i in range(batch.num_rows):
        keys, copies = (np.frombuffer(batch.column(c)[i].as_py(), t) for c, t in (("keys", KEYS), ("copies", np.int64)))
        yield batch.column("run")[i].as_py(), batch.column("source")[i].as_py(), Run(keys, batch.column("ids")[i].values, copies)


def form_runs(bits: int):
    """Rows (run, key, id) sorted by run and key to chunks of the first runs."""

    def form(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, held_run = None, -1
        for batch in batches:
            runs = batch.column("run").to_numpy()
            cuts = [0, *(np.flatnonzero(runs[1:] != runs[:-1]) + 1).tolist(), len(runs)]
            for lo, hi in zip(cuts, cuts[1:], strict=False):
                if lo == hi:
                    continue
                run, part = int(runs[lo]), batch.slice(lo, hi - lo)
                got = Run.of(part.column("key"), part.column("id"), np.ones(hi - lo, np.int64))
                if held is not None and run != held_run:
                    yield from sent(held_run, held_run, held, 0, bits)
                    held = None
                if held is not None:
                    got = held.with_(got)
                if len(got) > 1:  # the last key may go on in the next batch
                    yield from sent(run, run, got.part(0, len(got) - 1), 0, bits)
                held, held_run = got.part(len(got) - 1, len(got)), run
        if held is not None:
            yield from sent(held_run, held_run, held, 0, bits)

    return form


def merge_runs(k: int, bits: int):
    """Chunks sorted by run and lowest key to chunks of the merged runs, after round k (from 1)."""

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, held_run = None, -1
        for batch in batches:
            for run, _, chunk in read_chunks(batch):
                if held is not None and run != held_run:
                    yield from sent(held_run, held_run, held, k, bits)
                    held = None
                chunk.ascending()
                if held is None:
                    held, held_run = chunk, run
                    continue
                done = int(np.searchsorted(held.keys, chunk.keys[0]))  # what is smaller than all that is to come
                if done >= CHUNK:
                    yield from sent(run, run, held.part(0, done), k, bits)
                    held = held.part(done, len(held))
                held = held.with_(chunk)
        if held is not None:
            yield from sent(held_run, held_run, held, k, bits)

    return merge


def opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks to rows (run, key, keep_id, copies), run the one that they come from."""
    for batch in batches:
        for _, source, c in read_chunks(batch):
            keys = pa.FixedSizeBinaryArray.from_buffers(pa.binary(KEY_BYTES), len(c), [None, pa.py_buffer(c.keys.tobytes())]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(c), source, np.int32)), keys, c.ids, pa.array(c.copies)], names=["run", "key", "keep_id", "copies"])


def find_copies(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", runs: int | None = None) -> DataFrame:
    """One row for each row of docs: id, keep_id, group_size, kept, text_sha256 (lower-case hex). runs: at least so many;
    without it the shuffle partitions of the session."""
    bits = max(1, (max(2, runs or shuffle_partitions(docs.sparkSession)) - 1).bit_length())
    n, id_type = 1 << bits, docs.schema[id_col].dataType.simpleString()
    keyed = docs.select(F.col(id_col).alias("id"), key_of(normalised(F.col(text_col))).alias("key"))
    rows = materialize(keyed.withColumn("run", F.pmod(F.xxhash64("id", "key"), F.lit(n)).cast("int")), "digests")
    chunk = f"run int, source int, low binary, keys binary, ids array<{id_type}>, copies binary"
    first = rows.select("run", "key", "id").repartitionById(n, F.col("run")).sortWithinPartitions("run", "key").mapInArrow(form_runs(bits), chunk)
    first = materialize(first, "runs")
    merged = first
    for k in range(1, bits + 1):
        merged = merged.repartitionById(n, F.col("run")).sortWithinPartitions("run", "low").mapInArrow(merge_runs(k, bits), chunk)
    row = f"run int, key binary, keep_id {id_type}, copies long"
    groups = merged.mapInArrow(opened, row).where("copies > 1").select("key", "keep_id", F.col("copies").alias("group_size"))
    answers = first.mapInArrow(opened, row).select("run", "key").join(groups, "key")
    back = rows.join(answers, ["run", "key"], "left").withColumn("again", F.row_number().over(Window.partitionBy("run", "key", "id").orderBy("id")))
    keep = F.when(F.col("group_size").isNull(), F.col("id")).otherwise(F.col("keep_id"))
    sha = F.lower(F.hex(F.substring("key", 1, 32)))
    return back.select(F.col("id").alias(id_col), keep.alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"), (F.col("id").eqNullSafe(keep) & (F.col("again") == 1)).alias("kept"), sha.alias("text_sha256"))


def drop_copies(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", runs: int | None = None) -> DataFrame:
    """The rows of docs that find_copies keeps, with all their columns."""
    digest, key, sha = free_name(docs, "_digest"), free_name(docs, "_key"), F.sha2(normalised(F.col(text_col)), 256)
    kept = find_copies(docs, id_col=id_col, text_col=text_col, runs=runs).where("kept").select(F.col(id_col).alias(key), F.col("text_sha256").alias(digest + "_kept"))
    own = docs.withColumn(digest, sha)
    found = own.join(kept, own[digest].eqNullSafe(kept[digest + "_kept"]) & own[id_col].eqNullSafe(kept[key]), "left_semi")
    again = free_name(docs, "_again")
    return found.withColumn(again, F.row_number().over(Window.partitionBy(digest, id_col).orderBy(digest))).where(F.col(again) == 1).select(*docs.columns)
