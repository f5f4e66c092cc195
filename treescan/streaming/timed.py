"""Streams whose state ends: a bounded queue that is drained by ticks, runs that are done, and sessions that go idle.

Time is that of the events. What is due before a row is done before the row; where no more rows come, an event timer does
it once the watermark has passed. So results don't depend on how rows fall into micro-batches, as long as rows of a key
come in the order of their times, and a restart goes on from the state. In a batch the rows of a key are held at once: the
source's rate limit (maxFilesPerTrigger, maxBytesPerTrigger) bounds them. Rows behind the watermark are late and go.

Sessions are dealt over groups, and a group is a key: each key costs Python several calls of the state, a frame and an Arrow
batch, and each Row a conversion of every value, which is more than the history of a session takes.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator
from itertools import batched, groupby
from operator import itemgetter

import pandas as pd
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from treescan.operators.history import CAP, PLACE, History

#: Entries that wait at most, entries shown at a tick, and milliseconds between ticks.
PENDING, BATCH, TICK = 20_000, 500, 100
SHOWN = "source long, seq long, line string, tick long, dropped boolean"
FINISHED = "run long, completed long, failed long, total long, status string, last_seq long"
#: Groups that sessions are dealt over.
GROUPS = 1024
ENDED = "session long, began long, ended long, n_events long, n_entries int, cursor int, file long, line long"


class _Timed(StatefulProcessor):
    """Keeps one timer a key."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle

    def wait_until(self, at: int | None) -> None:
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        if at is not None:
            self.handle.registerTimer(at)

    def close(self) -> None:
        pass


class BoundedQueue(_Timed):
    """Entries of a source wait in a queue. One too many drops the oldest; each tick shows the next ones."""

    def __init__(self, pending: int, batch: int, tick: int):
        self.most, self.batch, self.every = pending, batch, tick

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.waiting = handle.getListState("waiting", "seq long, line string")
        self.clock = handle.getValueState("clock", "tick long")

    def _load(self) -> tuple[deque, int | None]:
        clock = self.clock.get()
        queue = deque((r[0], r[1]) for r in self.waiting.get()) if clock else deque()
        return queue, clock[0] if clock else None

    def _keep(self, queue: deque, tick: int) -> None:
        if queue:
            self.waiting.put(list(queue))
            self.clock.update((tick,))
            self.wait_until((tick + 1) * self.every)
        else:  # nothing waits, so no tick needs to be remembered
            self.waiting.clear()
            self.clock.clear()
            self.wait_until(None)

    def _drain(self, source: int, queue: deque, tick: int, until: int) -> Iterator[Row]:
        """Ticks after ``tick`` up to ``until``; those that find nothing are passed over."""
        while queue and tick < until:
            tick += 1
            for _ in range(min(self.batch, len(queue))):
                seq, line = queue.popleft()
                yield Row(source=source, seq=seq, line=line, tick=tick, dropped=False)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:  # noqa: N802, N803
        queue, tick = self._load()
        for row in sorted(rows, key=lambda r: (r["ms"], r["seq"])):
            now = row["ms"] // self.every
            yield from self._drain(key[0], queue, now if tick is None else tick, now)
            tick = now if tick is None else max(tick, now)
            queue.append((row["seq"], row["line"]))
            if len(queue) > self.most:
                seq, line = queue.popleft()
                yield Row(source=key[0], seq=seq, line=line, tick=None, dropped=True)
        self._keep(queue, tick)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        queue, tick = self._load()
        until = timerValues.getCurrentWatermarkInMs() // self.every
        if queue:
            yield from self._drain(key[0], queue, tick, until)
            self._keep(queue, max(tick, until))


def bounded_queue(entries: DataFrame, pending: int = PENDING, batch: int = BATCH, tick: int = TICK) -> DataFrame:
    """entries (source, seq, ts, line) to SHOWN: at which tick (number of tick milliseconds since the epoch) each is shown,
    or that it was dropped. What still waits at the end of the watermark is neither."""
    rows = entries.withWatermark("ts", "0 seconds").select("source", "seq", "ts", F.unix_millis("ts").alias("ms"), "line")
    return rows.groupBy("source").transformWithState(BoundedQueue(pending, batch, tick), SHOWN, "Append", "EventTime")


class RunState(_Timed):
    """Counts of a run until it is done, or has been silent for too long."""

    def __init__(self, idle: int):
        self.idle = idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.counts = handle.getValueState("counts", "completed long, failed long, total long, seq long, ms long")

    @staticmethod
    def _row(run: int, counts: tuple, status: str) -> Row:
        completed, failed, total, last, _ = counts
        return Row(run=run, completed=completed, failed=failed, total=total, status=status, last_seq=last)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:  # noqa: N802, N803
        counts = self.counts.get()
        for row in sorted(rows, key=lambda r: (r["ms"], r["seq"])):
            if counts and row["ms"] - counts[4] > self.idle:
                yield self._row(key[0], counts, "abandoned")
                counts = None
            completed, failed, total, *_ = counts or (0, 0, 0)
            counts = (completed + bool(row["ok"]), failed + (not row["ok"]), max(total, row["total"]), row["seq"], row["ms"])
            if counts[0] + counts[1] >= counts[2]:
                yield self._row(key[0], counts, "error" if counts[1] == counts[2] else "merged")
                counts = None
        if counts:
            self.counts.update(tuple(counts))
            self.wait_until(counts[4] + self.idle + 1)
        else:
            self.counts.clear()
            self.wait_until(None)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        counts = self.counts.get()
        self.counts.clear()
        if counts:
            yield self._row(key[0], tuple(counts), "abandoned")


def finished_runs(events: DataFrame, idle: int) -> DataFrame:
    """events (run, seq, ts, total, ok) to FINISHED: a row once a run has had as many events as its total, or none for more
    than idle milliseconds. Its state is gone then, and further events of its name are a new run."""
    rows = events.withWatermark("ts", "0 seconds").select("run", "seq", "ts", F.unix_millis("ts").alias("ms"), F.col("total").cast("long").alias("total"), "ok")
    return rows.groupBy("run").transformWithState(RunState(idle), FINISHED, "Append", "EventTime")


class SessionState(_Timed):
    """Histories of a group of sessions until they go idle. The group's timer is not after the first of them is due."""

    def __init__(self, idle: int):
        self.idle = idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.kept = handle.getMapState("history", "session string", "entries array<bigint>, cursor int, began long, ended long, n long")

    @staticmethod
    def _history(entries: list[int], cursor: int) -> History:
        return History(list(batched(entries, len(PLACE))), cursor, CAP)

    @staticmethod
    def _ended(session: str, h: History, began: int, last: int, n: int) -> tuple:
        place = h.entries[h.cursor] if h.entries else (0,) * len(PLACE)
        return int(session) if session else None, began, last, n, len(h.entries), h.cursor, place[0], place[1]

    @staticmethod
    def _frame(rows: list[tuple]) -> pd.DataFrame:
        """As objects, so that a missing session makes no floats of the others."""
        return pd.DataFrame(rows, columns=[c.split()[0] for c in ENDED.split(", ")], dtype=object)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        columns = ["session", "seq", "ms", "delta", *PLACE]
        given = sorted((r for part in rows for r in zip(*(part[c].tolist() for c in columns), strict=True)), key=itemgetter(0, 1))
        some, due, ended = self.kept.exists(), None, []
        for session, own in groupby(given, key=itemgetter(0)):
            old = self.kept.getValue((session,)) if some else None
            h, began, last, n = (self._history(old[0], old[1]), *old[2:]) if old else (History(), None, None, 0)
            for _, _, ms, delta, *place in own:
                if last is not None and ms - last > self.idle:
                    ended.append(self._ended(session, h, began, last, n))
                    h, began, n = History(), None, 0
                h.apply(delta, tuple(place))
                began, last, n = ms if began is None else began, ms, n + 1
            self.kept.updateValue((session,), ([x for e in h.entries for x in e], h.cursor, began, last, n))
            due = last + self.idle + 1 if due is None else min(due, last + self.idle + 1)
        waits = list(self.handle.listTimers()) if some else []
        if not waits or due < min(waits):
            self.wait_until(due)
        if ended:
            yield self._frame(ended)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        now, due, ended = timerValues.getCurrentWatermarkInMs(), None, []
        for (session,), (entries, cursor, began, last, n) in self.kept.iterator():
            at = last + self.idle + 1
            if at < now:
                ended.append((session, self._ended(session, self._history(entries, cursor), began, last, n)))
            else:
                due = at if due is None else min(due, at)
        for session, _ in ended:
            self.kept.removeKey((session,))
        if due is not None:
            self.handle.registerTimer(due)
        if ended:
            yield self._frame([row for _, row in ended])


def ended_sessions(events: DataFrame, idle: int, groups: int = GROUPS) -> DataFrame:
    """events as in history.nav_history_replay, with ts, to ENDED: a row for each session without an event for more than
    idle milliseconds, with the history as it was. A later event of its name begins a new session.

    pandas has no whole numbers with nulls, so a session is text, and none where it is null; seq and ts must be given."""
    must = lambda c, name: F.coalesce(c, F.raise_error(F.lit(f"{name} is null")))
    session = F.coalesce(F.col("session").cast("string"), F.lit(""))
    whole = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ["delta", *PLACE]]
    rows = events.withWatermark("ts", "0 seconds").select(F.pmod(F.xxhash64("session"), F.lit(groups)).alias("group"), session.alias("session"), must(F.col("seq"), "seq").alias("seq"), "ts", must(F.unix_millis("ts"), "ts").alias("ms"), *whole)
    return rows.groupBy("group").transformWithStateInPandas(SessionState(idle), ENDED, "Append", "EventTime")
