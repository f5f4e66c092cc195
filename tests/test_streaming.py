"""Streams give what batches give."""

import datetime as dt
import random
from collections import deque

import pandas as pd
import pytest
from pyspark.sql import functions as F
from treescan.operators import history, logs
from treescan.plans import bindings as b
from treescan.streaming import operators as st
from treescan.streaming import timed

SF = "/root/testdata/sf0.001"


def test_log_counts_equal_batch(spark):
    stream = st.run(st.log_counts(logs.parse_lines(b.log_lines(spark, SF, stream=True))), "complete")
    batch = logs.log_tabs(logs.parse_lines(b.log_lines(spark, SF)))
    assert sorted(map(tuple, stream.collect())) == sorted(map(tuple, batch.collect()))


def test_lines_across_micro_batches(spark, tmp_path):
    """Two files are two batches: the tail of the first is finished by the second; long lines keep their end."""
    long = "x" * 70_000
    parts = [[(1, 0, 1, 0, "ab"), (1, 0, 2, 0, "c\nde"), (2, 1, 1, 0, "other")], [(1, 0, 3, 0, "f\n" + long), (1, 0, 4, 0, "\n"), (2, 1, 2, 0, "\nlast"), (2, 1, 3, 0, None), (2, 1, 4, 0, None)]]
    schema = "source long, fd int, seq long, part int, chunk string"
    for k, rows in enumerate(parts):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / f"in/b{k}"))
    chunks = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    got = sorted((r.source, r.fd, r.line) for r in st.run(st.reassemble_lines(chunks), "append").collect())
    # a buffer of 65,536 characters: "f" and its line feed are lost in front of the long line
    assert (2, 1, "other") in got and (1, 0, "abc") in got and got[-2:] == [(2, 1, "last"), (2, 1, "other")]
    assert max(len(x[2]) for x in got) == st.MAX_BUFFER - 1


def test_history_equals_batch(spark):
    stream = st.run(st.nav_history(b.nav_events(spark, SF, stream=True)), "update")
    last = stream.groupBy("session").agg(F.max_by("n_entries", "batch").alias("n"), F.max_by("cursor", "batch").alias("c"))
    batch = history.nav_history_replay(b.nav_events(spark, SF)).groupBy("session").agg(F.count("*").cast("int").alias("n"), F.max_by(F.col("pos") - 1, F.col("is_current")).alias("c"))
    assert sorted(map(tuple, last.collect())) == sorted(map(tuple, batch.collect()))


def stream_of(spark, folder, schema):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(folder))


def put(spark, rows, schema, folder):
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(folder))


LINES = "source long, seq long, ts timestamp, line string"


def at(ms):
    return dt.datetime.fromtimestamp(ms / 1000, dt.UTC)


def queue(rows, pending, batch, tick, end):
    """The queue by a plain loop, up to the time end."""
    waiting, out, now = deque(), {}, None
    for seq, ms in [*rows, (None, end)]:
        while now is not None and now < ms // tick:
            now += 1
            for _ in range(min(batch, len(waiting))):
                out[waiting.popleft()] = (now, False)
        now = ms // tick
        if seq is not None:
            waiting.append(seq)
            if len(waiting) > pending:
                out[waiting.popleft()] = (None, True)
    return out


def test_a_burst_fills_the_queue_and_a_restart_goes_on(spark, tmp_path):
    """25,000 entries at once, then a few ticks later some more, read by a second run from the first one's checkpoint."""
    first = [(1, i, at(1000), "x") for i in range(25_000)]
    later = [(1, 25_000 + i, at(1050 + 70 * i), "y") for i in range(40)] + [(2, 99_999, at(4000), "z")]
    put(spark, first, LINES, tmp_path / "in/a")
    path = str(tmp_path / "out")
    st.run(timed.bounded_queue(stream_of(spark, tmp_path / "in", LINES)), "append", path)
    put(spark, later, LINES, tmp_path / "in/b")
    got = st.run(timed.bounded_queue(stream_of(spark, tmp_path / "in", LINES)), "append", path).where("source = 1").collect()
    rows = [(s, round(t.timestamp() * 1000)) for _, s, t, _ in first + later[:-1]]
    want = queue(rows, timed.PENDING, timed.BATCH, timed.TICK, 4000)
    assert {r.seq: (r.tick, r.dropped) for r in got} == want and len(got) == len(want)
    assert sum(d for _, d in want.values()) >= 5000


@pytest.mark.parametrize("files", [1, 20])
def test_timed_streams_do_not_depend_on_batches(spark, tmp_path, files):
    """As one batch and as twenty, with restarts between."""
    rng = random.Random(1)
    events = sorted((rng.randrange(40_000), rng.randrange(4)) for _ in range(400))
    rows = [(k, i, at(ms), "ab"[i % 2]) for i, (ms, k) in enumerate(events)] + [(9, 400, at(90_000), "end")]
    step = -(-len(rows) // files)
    got = {}
    for k in range(0, len(rows), step):
        put(spark, rows[k : k + step], LINES, tmp_path / f"in/{k:05}")
        if (k // step) % 9 == 8 or k + step >= len(rows):
            lines = stream_of(spark, tmp_path / "in", LINES)
            got["queue"] = st.run(timed.bounded_queue(lines, 7, 2, 1000), "append", str(tmp_path / "q"))
            runs = lines.selectExpr("source run", "seq", "ts", "15 total", "seq % 3 <> 0 ok")
            got["runs"] = st.run(timed.finished_runs(runs, 1500), "append", str(tmp_path / "r"))
            nav = lines.selectExpr("source session", "seq", "ts", "seq % 3 + 1 file", "1L line", "1L col", "1L node", "1L version", "if(seq % 7 = 0, -1, 0) delta")
            got["sessions"] = st.run(timed.ended_sessions(nav, 900), "append", str(tmp_path / "s"))
    for k in range(4):
        own = [(s, round(t.timestamp() * 1000)) for key, s, t, _ in rows if key == k]
        assert {r.seq: (r.tick, r.dropped) for r in got["queue"].where(f"source = {k}").collect()} == queue(own, 7, 2, 1000, 90_000)
        parts, seqs = [], []
        for s, ms in own:
            if seqs and ms - seqs[-1][1] > 1500:
                parts.append(("abandoned", seqs))
                seqs = []
            seqs = [*seqs, (s, ms)]
            if len(seqs) == 15:
                parts.append(("merged", seqs))
                seqs = []
        parts += [("abandoned", seqs)] if seqs else []
        want = [(k, sum(s % 3 != 0 for s, _ in p), sum(s % 3 == 0 for s, _ in p), 15, status, p[-1][0]) for status, p in parts]
        assert sorted(tuple(r) for r in got["runs"].where(f"run = {k}").collect()) == sorted(want)
        sessions = []
        for s, ms in own:
            if not sessions or ms - sessions[-1][-1][1] > 900:
                sessions.append([])
            sessions[-1].append((s, ms))
        assert sorted((r.began, r.ended, r.n_events) for r in got["sessions"].where(f"session = {k}").collect()) == sorted((p[0][1], p[-1][1], len(p)) for p in sessions)


def test_state_goes_when_runs_and_sessions_end(spark, tmp_path):
    rows = [(k, 10 * k + i, at(1000 * k + i), "a") for k in range(8) for i in range(10)] + [(99, 999, at(500_000), "end")]
    put(spark, rows, LINES, tmp_path / "in/a")
    lines = stream_of(spark, tmp_path / "in", LINES)
    runs = lines.selectExpr("source run", "seq", "ts", "10 total", "true ok")
    nav = lines.selectExpr("source session", "seq", "ts", "1L file", "1L line", "1L col", "1L node", "1L version", "0 delta")
    for name, df, left in (("r", timed.finished_runs(runs, 10_000), 1), ("s", timed.ended_sessions(nav, 10_000), 1), ("q", timed.bounded_queue(lines, 5, 2, 100), 1)):
        st.run(df, "append", str(tmp_path / name))
        state = spark.read.format("statestore").options(path=f"{tmp_path}/{name}-state", stateVarName={"r": "counts", "s": "history", "q": "clock"}[name]).load()
        assert state.count() == left  # the last key, whose time is the watermark


@pytest.mark.parametrize("files", [1, 20])
def test_early_chunks_wait_also_over_a_restart(spark, tmp_path, files):
    rng = random.Random(files)
    text = {(k, fd): "".join(rng.choice("ab\n") for _ in range(400)) for k in range(3) for fd in range(2)}
    rows = [(*key, i, t[i * 7 : i * 7 + 7]) for key, t in text.items() for i in range(-(-len(t) // 7))] + [(*key, 999, "never") for key in text]
    rows += rng.sample(rows, 40)  # some come twice
    rng.shuffle(rows)
    step, schema = -(-len(rows) // files), "source long, fd int, n long, chunk string"
    for k in range(0, len(rows), step):
        put(spark, rows[k : k + step], schema, tmp_path / f"in/{k:05}")
        if (k // step) % 9 == 8 or k + step >= len(rows):
            out = st.run(st.reassemble_numbered(stream_of(spark, tmp_path / "in", schema)), "append", str(tmp_path / "out"))
    got = sorted((r.source, r.fd, r.line) for r in out.collect())
    assert got == sorted((*key, line) for key, t in text.items() for line in t.split("\n")[:-1])


def test_early_chunks_are_kept_by_blocks(spark, tmp_path):
    """Chunks over several blocks and slices, backwards over three batches; the state has a row a block, not one a chunk."""
    text = "".join(f"{i} {'x' * (i % 9)}\n" for i in range(4_000))
    rows = [(1, 0, i, text[i * 5 : i * 5 + 5]) for i in range(-(-len(text) // 5))]
    schema, path = "source long, fd int, n long, chunk string", str(tmp_path / "out")
    third = len(rows) // 3
    put(spark, rows[: third - 1 : -1], schema, tmp_path / "in/0")
    st.run(st.reassemble_numbered(stream_of(spark, tmp_path / "in", schema)), "append", path)
    state = spark.read.format("statestore").options(path=f"{path}-state", stateVarName="early").load()
    assert 0 < state.count() <= len(rows) // 1024 + 1
    put(spark, rows[5:third] + rows[5:9], schema, tmp_path / "in/1")
    put(spark, rows[:5], schema, tmp_path / "in/2")
    got = [r.line for r in st.run(st.reassemble_numbered(stream_of(spark, tmp_path / "in", schema)), "append", path).collect()]
    assert sorted(got) == sorted(text.split("\n")[:-1])
    assert spark.read.format("statestore").options(path=f"{path}-state", stateVarName="early").load().count() == 0


def test_lines_of_a_batch_are_put_together_at_once():
    """As chunk by chunk: what the buffer cuts off, ends of input, and what waits for the next batch."""

    class Tail:
        value = None

        def get(self):
            return self.value

        def update(self, value):
            self.value = value

    most = st.MAX_BUFFER
    for chunks in (["a\nb", "c", "\n", None, "d", None, None, "", "e"], ["x" * (most - 1), "y", "z", "\nu", "v" * (most + 5), "w\nq"], ["x" * most, "\n" + "y" * most + "\nz", "\n", None], [None], ["x" * 9 + "\n"] * 20_000):
        want, buffer = [], "0"
        for chunk in chunks:
            *done, buffer = [*filter(None, [buffer]), ""] if chunk is None else (buffer + chunk)[-most:].split("\n")
            want += done
        state = st.LineBuffer()
        state.tail, n = Tail(), len(chunks)
        state.tail.update(("0",))
        rows = pd.DataFrame({"source": 1, "fd": 0, "seq": [i // 3 for i in range(n)], "part": [i % 3 for i in range(n)], "chunk": chunks}).sample(frac=1, random_state=1)
        got = [line for out in state.handleInputRows((1, 0), iter([rows[: n // 2], rows[n // 2 :]]), None) for line in out["line"]]
        assert got == want and state.tail.get() == (buffer,)


NAV = "session long, seq long, ts timestamp, file long, line long, col long, node long, version long, delta int"


def test_sessions_of_a_group_share_timer_and_state(spark, tmp_path):
    """One group for all, over restarts: no session, large numbers, nulls, and sessions due at other times than the group's timer."""
    big = 2**60 + 1
    batches = [
        [(None, 0, at(50), 3, None, 1, 1, 1, None), (big, 1, at(100), 4, 7, 1, 1, 1, 0), (big - 1, 2, at(200), 5, 8, 1, 1, 1, 0)],
        [(None, 3, at(900), 6, 9, 1, 1, 1, 0), (big - 1, 4, at(1000), None, 1, 1, 1, 1, 0)],
        [(None, 5, at(1500), None, None, None, None, None, -1), (7, 6, at(1900), 1, 1, 1, 1, 1, 0)],
        [(7, 7, at(2600), 2, 2, 2, 2, 2, 0)],
        [(8, 8, at(9000), 2, 2, 2, 2, 2, 0)],
    ]
    for k, rows in enumerate(batches):
        put(spark, rows, NAV, tmp_path / f"in/{k}")
        out = st.run(timed.ended_sessions(stream_of(spark, tmp_path / "in", NAV), 1000, groups=1), "append", str(tmp_path / "out"))
    assert sorted(map(tuple, out.collect()), key=str) == sorted([(None, 50, 1500, 3, 2, 0, 3, 0), (big, 100, 100, 1, 1, 0, 4, 7), (big - 1, 200, 1000, 2, 1, 0, 5, 8), (7, 1900, 2600, 2, 2, 1, 2, 2)], key=str)
    state = spark.read.format("statestore").options(path=f"{tmp_path}/out-state", stateVarName="history").load()
    assert state.count() == 1  # of the last session


def test_a_group_of_sessions_is_few_calls_of_the_state():
    """A call a session, some a group, and one frame; each session used to be a key with five calls and a batch of its own."""

    class Calls:
        def __init__(self):
            self.n, self.kept, self.timers = 0, {}, set()

        def __getattr__(self, name):
            self.n += 1
            return {"exists": lambda: bool(self.kept), "getValue": self.kept.get, "updateValue": self.kept.__setitem__, "listTimers": lambda: iter(self.timers), "registerTimer": self.timers.add, "deleteTimer": self.timers.discard}[name]

    calls, state = Calls(), timed.SessionState(10)
    state.kept = state.handle = calls
    n = 1000
    rows = pd.DataFrame({"session": [str(i % n) for i in range(3 * n)], "seq": range(3 * n), "ms": [i // n * 10 + i // n // 2 * 5 for i in range(3 * n)], "delta": 0, **{p: 1 for p in history.PLACE}})
    frames = list(state.handleInputRows((0,), iter([rows[:n], rows[n:]]), None))
    assert [len(f) for f in frames] == [n] and set(frames[0]["n_events"]) == {2}
    assert len(calls.kept) == n and calls.timers == {36} and calls.n <= n + 5


def test_histories_of_a_group_go_on_over_restarts(spark, tmp_path):
    """One group for all: no session, large numbers and nulls; its state is a key of the group with an entry a session."""
    big = 2**60 + 1
    for k, rows in enumerate([[(None, 0, at(50), 3, None, 1, 1, 1, None), (big, 1, at(100), 4, 7, 1, 1, 1, 0)], [(big, 3, at(300), 6, 9, 1, 1, 1, 0), (None, 2, at(200), 5, 8, 1, 1, 1, 0), (None, 4, at(400), None, None, None, None, None, -1)]]):
        put(spark, rows, NAV, tmp_path / f"in/{k}")
        out = st.run(st.nav_history(stream_of(spark, tmp_path / "in", NAV), groups=1), "update", str(tmp_path / "out"))
    got = sorted((r.batch, r.last_seq, r.session, r.n_entries, r.cursor, r.file, r.line) for r in out.collect())
    assert got == [(0, 0, None, 1, 0, 3, 0), (0, 1, big, 1, 0, 4, 7), (1, 3, big, 2, 1, 6, 9), (1, 4, None, 2, 0, 3, 0)]
    state = spark.read.format("statestore").options(path=f"{tmp_path}/out-state", stateVarName="history").load()
    assert state.count() == 2 and state.select("key").distinct().count() == 1
