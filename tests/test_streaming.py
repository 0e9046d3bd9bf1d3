"""The replay stream over several micro-batches, restarts and timers, against the loop that it stands for."""

from __future__ import annotations

import datetime
import random

import pytest
from pyspark.sql import functions as F

from studyloom.streaming import replay

START = datetime.datetime(2024, 1, 1)
SCHEMA = "key long, op_id long, client_ts timestamp_ntz, version timestamp_ntz, received_at timestamp"
CLOCK = "2024-01-01 00:01:00"


def at(seconds):
    return None if seconds is None else START + datetime.timedelta(seconds=seconds)


@pytest.fixture
def run(spark, tmp_path):
    folder = f"file://{tmp_path}"
    feed = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in/*")

    def go(batches, **settings):
        """Writes the batches (lists of key, op, seconds, version) as files and runs the stream to their end."""
        for b in batches:
            n = sum(1 for _ in (tmp_path / "in").iterdir()) if (tmp_path / "in").exists() else 0
            spark.createDataFrame([(k, o, at(t), at(v), at(1000 * n)) for k, o, t, v in b], SCHEMA).coalesce(1).write.parquet(f"{folder}/in/{n}")
        return {r.op_id: r.status for r in replay.replay_stream(feed, folder, **settings).collect()}

    return go


def loop(batches, clock=60):
    """Each batch in the order of client times, one write after the other."""
    version, want = {}, {}
    for b in batches:
        for k, o, t, v in sorted(b, key=lambda w: (w[2], w[1])):
            if v is None:
                want[o] = "skipped"
                continue
            own = max(v, version.get(k, v))
            want[o] = "applied" if t >= own else "conflict"
            if want[o] == "applied":
                version[k] = clock
    return want


def test_equals_the_loop(run):
    r = random.Random(7)
    batches, op = [], 0
    for _ in range(3):
        rows = []
        for _ in range(60):
            k = r.randrange(9)
            rows.append((k, op, r.randrange(80), None if k == 4 else k * 5))
            op += 1
        batches.append(rows)
    got = run(batches[:2], server_clock=CLOCK)
    assert got == loop(batches[:2])
    # Started again from the checkpoint: versions are still known, and nothing is answered twice.
    assert run(batches[2:], server_clock=CLOCK) == loop(batches)


def test_stored_versions_and_ties(run):
    got = run([[(1, 11, 5, 0), (1, 10, 5, 0), (2, 20, 5, 5), (3, 30, 5, 6), (5, 50, 70, 0), (5, 51, 65, 0), (5, 52, 9, 0)], [(3, 31, 59, 6), (2, 21, 60, 90), (2, 22, 95, 90)]], server_clock=CLOCK)
    assert got == {11: "conflict", 10: "applied", 20: "applied", 30: "conflict", 50: "applied", 51: "applied", 52: "applied", 31: "applied", 21: "conflict", 22: "applied"}


def test_idle_rows_lose_their_state(run):
    """The second batch comes in long after the first one: the timer of row 1 is due, and its next write meets the stored
    version. Row 2 isn't idle. Client times that go back are answered all the same."""
    run([[(1, 1, 5, 0)], [(2, 2, 5, 0)]], server_clock=CLOCK, idle_seconds=10)
    got = run([[(1, 3, 1, 0), (2, 4, 1, 0)]], server_clock=CLOCK, idle_seconds=10)
    assert got == {1: "applied", 2: "applied", 3: "applied", 4: "conflict"}


def test_the_executors_clock(run):
    assert run([[(1, 1, 5, 0), (1, 2, 6, 0)]]) == {1: "applied", 2: "conflict"}
