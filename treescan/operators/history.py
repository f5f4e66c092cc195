"""Navigation and query history."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

PLACE = ["file", "line", "col", "node", "version"]
CAP = 500


def nav_history(events: DataFrame, cap: int = CAP) -> DataFrame:
    """events (session, seq and PLACE) without moves back or forward: drop invalid files and repeats of the entry before,
    keep the newest cap. Entries with pos, 1 for the oldest kept."""
    w = Window.partitionBy("session").orderBy("seq")
    here = F.struct(*PLACE)
    rows = events.where("file > 0").withColumn("_last", F.lag(here).over(w)).where(F.col("_last").isNull() | ~F.col("_last").eqNullSafe(here)).drop("_last")
    newest = F.row_number().over(Window.partitionBy("session").orderBy(F.col("seq").desc()))
    return rows.withColumn("_new", newest).where(F.col("_new") <= cap).withColumn("pos", F.row_number().over(w)).drop("_new")


class History:
    """The history of one session: entries up to a cap and a cursor."""

    def __init__(self, entries: list[tuple] | None = None, cursor: int = -1, cap: int = CAP):
        self.entries, self.cursor, self.cap = entries or [], cursor, cap

    def visit(self, entry: tuple) -> None:
        if entry[0] <= 0 or (self.entries and self.entries[self.cursor] == entry):
            return
        self.entries = [*self.entries[: self.cursor + 1], entry][-self.cap :]
        self.cursor = len(self.entries) - 1

    def move(self, delta: int) -> None:
        if self.entries and 0 <= self.cursor + delta < len(self.entries):
            self.cursor += delta

    def apply(self, delta: int | None, entry: tuple) -> None:
        self.move(int(delta)) if delta else self.visit(entry)


RESULT = "session long, pos int, file long, line long, col long, node long, version long, is_current boolean"


def nav_history_replay(events: DataFrame, cap: int = CAP) -> DataFrame:
    """events with delta (null or 0 for a visit): the history of each session after its last event. Each session is one
    person's clicks; it is replayed in batches in order of seq, with only the capped history in memory."""
    columns = ["session", "seq", "delta", *PLACE]

    def replay(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, history = None, None
        for part in parts:
            for row in part[columns].itertuples(index=False, name=None):
                if history is None or row[0] != last:
                    if history is not None:
                        yield _rows(last, history)
                    last, history = row[0], History(cap=cap)
                delta = 0 if pd.isna(row[2]) else int(row[2])
                history.apply(delta, tuple(0 if pd.isna(x) else int(x) for x in row[3:]))
        if history is not None:
            yield _rows(last, history)

    return events.select(*columns).repartition("session").sortWithinPartitions("session", "seq").mapInPandas(replay, RESULT)


def _rows(session: int, h: History) -> pd.DataFrame:
    rows = [(session, i + 1, *e, i == h.cursor) for i, e in enumerate(h.entries)]
    return pd.DataFrame(rows, columns=["session", "pos", *PLACE, "is_current"])


def recent_queries(events: DataFrame, cap: int = 20) -> DataFrame:
    """events (user, ts, query): trimmed, not empty, unique, the newest first, at most cap a user."""
    q = F.regexp_replace("query", r"^\s+|\s+$", "")
    last = events.select("user", "ts", q.alias("query")).where("query <> ''").groupBy("user", "query").agg(F.max("ts").alias("ts"))
    return last.withColumn("rank", F.row_number().over(Window.partitionBy("user").orderBy(F.col("ts").desc(), "query"))).where(F.col("rank") <= cap)
