"""Structured Streaming forms: line reassembly, counts, and navigation history with state. No watermarks are needed:
state is bounded by its own rules (a buffer of 65,536 characters, 500 entries, counts by source and tab).

Pacing is a matter of the query: trigger(processingTime=...) and a rate limit of the source."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import batched, groupby, islice
from operator import itemgetter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from treescan.functions.storage import shared_path
from treescan.operators.history import CAP, PLACE, History
from treescan.operators.logs import shown_level
from treescan.streaming.timed import GROUPS

MAX_BUFFER = 64 * 1024
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
LINE = T.StructType([T.StructField("source", T.LongType()), T.StructField("fd", T.IntegerType()), T.StructField("line", T.StringType())])
ENTRY = T.StructType([T.StructField("session", T.LongType()), T.StructField("n_entries", T.IntegerType()), T.StructField("cursor", T.IntegerType()), *[T.StructField(p, T.LongType()) for p in PLACE], T.StructField("last_seq", T.LongType())])


def run(df: DataFrame, mode: str, path: str | None = None) -> DataFrame:
    """Run a stream over all there is now and return what it wrote: the last full result (complete), all rows (append),
    or rows with the batch they come from (update). With the path of an earlier run it goes on from there."""
    spark = df.sparkSession
    path = path or shared_path(spark, "stream")
    setting = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(setting, None)

    def keep(part: DataFrame, batch: int) -> None:
        part.withColumn("batch", F.lit(batch)).write.mode("overwrite").parquet(path if mode == "complete" else f"{path}/batch={batch}_")

    spark.conf.set(setting, ROCKSDB)
    try:  # a query takes the settings of its start
        part = df.writeStream.outputMode(mode).option("checkpointLocation", f"{path}-state").trigger(availableNow=True).foreachBatch(keep).start()
    finally:
        spark.conf.unset(setting) if before is None else spark.conf.set(setting, before)
    part.awaitTermination()
    schema = T.StructType([*df.schema.fields, T.StructField("batch", T.IntegerType())])
    out = spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(path)
    return out if mode == "update" else out.drop("batch")


def chunks(lines: DataFrame, width: int = 7) -> DataFrame:
    """Lines (source, seq, line) as chunks (source, fd, seq, chunk) of width characters, line feeds included."""
    text = F.concat("line", F.lit("\n"))
    cut = F.transform(F.sequence(F.lit(0), F.floor((F.length(text) - 1) / width).cast("int")), lambda i: F.substring(text, i * width + 1, F.lit(width)))
    return lines.select(F.col("source").alias("source"), F.col("is_stderr").cast("int").alias("fd"), "seq", F.posexplode(cut).alias("part", "chunk"))


class LineBuffer(StatefulProcessor):
    """Keeps the unfinished line of a source and descriptor, its last MAX_BUFFER characters at most.

    Chunks are put together as many at a time as fit the buffer, so that nothing is cut off between them; none of them is
    a row of its own in Python."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.tail = handle.getValueState("tail", "tail string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        old = self.tail.get()
        given = pd.concat([r[["seq", "part", "chunk"]] for r in rows])
        order = np.lexsort((given["part"].to_numpy(), given["seq"].to_numpy()))
        buffer, lines, piece = old[0] if old else "", [], []
        size = len(buffer)
        for chunk in given["chunk"].to_numpy(object)[order].tolist():
            ends = not isinstance(chunk, str)
            if not ends and size + len(chunk) <= MAX_BUFFER:
                piece.append(chunk)
                size += len(chunk)
                continue
            *done, buffer = (buffer + "".join(piece)).split("\n")
            *more, buffer = [*filter(None, [buffer]), ""] if ends else (buffer + chunk)[-MAX_BUFFER:].split("\n")
            lines += done + more
            piece, size = [], len(buffer)
        *done, buffer = (buffer + "".join(piece)).split("\n")
        lines += done
        self.tail.update((buffer,))
        if lines:
            yield pd.DataFrame({"source": key[0], "fd": key[1], "line": lines})

    def close(self) -> None:
        pass


def reassemble_lines(pieces: DataFrame) -> DataFrame:
    """chunks (source, fd, seq, part, chunk) to complete lines (source, fd, line); the tail waits for its end. A null
    chunk is the end of its source and descriptor: what is left of a line comes out."""
    return pieces.groupBy("source", "fd").transformWithStateInPandas(LineBuffer(), LINE, "Append", "None")


#: Numbers of a block of early chunks, and rows of a batch that are looked at together.
BLOCK, SLICE = 1024, 16_384


class OrderedLines(StatefulProcessor):
    """Lines of chunks in the order of their numbers: one that comes early waits in the state until those before it are there.

    What waits is kept by blocks of numbers, as each call of the state goes to another process: the block of the next
    number with the tail in one value, later blocks in a map. A batch reads and writes a block at most once a slice."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.head = handle.getValueState("head", "next long, tail string, n array<long>, chunk array<string>, later long")
        self.early = handle.getMapState("early", "block long", "n array<long>, chunk array<string>")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802, N803
        nxt, tail, numbers, texts, later = self.head.get() or (0, "", [], [], 0)
        held, rows = dict(zip(numbers, texts, strict=True)), iter(rows)
        while piece := list(islice(rows, SLICE)):
            ahead: dict[int, dict[int, str | None]] = {}
            for row in piece:
                n = row["n"]
                if n < nxt:  # has come before
                    continue
                if n // BLOCK == nxt // BLOCK:
                    held[n] = row["chunk"]
                else:
                    ahead.setdefault(n // BLOCK, {})[n] = row["chunk"]
            while nxt in held:
                chunk = held.pop(nxt)
                nxt += 1
                tail = "" if chunk is None else (tail + chunk)[-MAX_BUFFER:]
                *done, tail = tail.split("\n")
                for line in done:
                    yield Row(source=key[0], fd=key[1], line=line)
                if nxt % BLOCK == 0:
                    old = self.early.getValue((nxt // BLOCK,)) if later else None
                    if old:
                        held = dict(zip(*old, strict=True))
                        self.early.removeKey((nxt // BLOCK,))
                        later -= 1
                    held |= ahead.pop(nxt // BLOCK, {})
            for block, more in ahead.items():
                old = self.early.getValue((block,)) if later else None
                later += not old
                more = (dict(zip(*old, strict=True)) | more) if old else more
                self.early.updateValue((block,), (list(more), list(more.values())))
        self.head.update((nxt, tail, list(held), list(held.values()), later))

    def close(self) -> None:
        pass


def reassemble_numbered(pieces: DataFrame) -> DataFrame:
    """Chunks (source, fd, n, chunk), numbered from 0 in each source and descriptor and in any order, also over batches, to
    complete lines. Of the rows of a batch a slice is held: what waits is state."""
    return pieces.groupBy("source", "fd").transformWithState(OrderedLines(), LINE, "Append", "None")


def log_counts(entries: DataFrame) -> DataFrame:
    """Entries by source and tab, all the time; All has every entry."""
    each = entries.withColumn("tab", F.explode(F.array(F.lit("All"), shown_level(F.col("level")))))
    return each.groupBy("source", "tab").agg(F.count("*").alias("n"))


class NavState(StatefulProcessor):
    """Histories of a group of sessions: their entries, capped, and the cursor."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.kept = handle.getMapState("history", "session string", "entries array<bigint>, cursor int")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        columns, some, out = ["session", "seq", "delta", *PLACE], self.kept.exists(), []
        given = sorted((r for part in rows for r in zip(*(part[c].tolist() for c in columns), strict=True)), key=itemgetter(0, 1))
        for session, own in groupby(given, key=itemgetter(0)):
            old, last = self.kept.getValue((session,)) if some else None, 0
            h = History(list(batched(old[0], len(PLACE))), old[1], CAP) if old else History()
            for _, last, delta, *place in own:  # noqa: B007
                h.apply(delta, tuple(place))
            self.kept.updateValue((session,), ([x for e in h.entries for x in e], h.cursor))
            out.append((int(session) if session else None, len(h.entries), h.cursor, *(h.entries[h.cursor] if h.entries else (0,) * len(PLACE)), last))
        yield pd.DataFrame(out, columns=ENTRY.names, dtype=object)

    def close(self) -> None:
        pass


def nav_history(events: DataFrame, groups: int = GROUPS) -> DataFrame:
    """events as in history.nav_history_replay, as a stream, to the state of each session after each batch. Sessions are
    dealt over groups, as in timed.ended_sessions; seq must be given."""
    session = F.coalesce(F.col("session").cast("string"), F.lit(""))
    whole = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ["delta", *PLACE]]
    rows = events.select(F.pmod(F.xxhash64("session"), F.lit(groups)).alias("group"), session.alias("session"), F.coalesce("seq", F.raise_error(F.lit("seq is null"))).alias("seq"), *whole)
    return rows.groupBy("group").transformWithStateInPandas(NavState(), ENTRY, "Update", "None")
