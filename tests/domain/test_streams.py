"""Stateful streams and epochs on rows out of order, late rows and any split into batches, against plain walks."""

import datetime as dt
import random
import time

import pytest
from pyspark.sql import functions as F

from dealspark.streaming import stateful as SO
from dealspark.streaming import streams as ST

T0 = dt.datetime(2024, 1, 1)
SCHEMA = "user_id long, ts timestamp, event_id long"


def at(minutes):
    return T0 + dt.timedelta(minutes=minutes)


def stream(spark, tmp_path, batches, schema=SCHEMA):
    """One file, and so one batch, for each list of rows."""
    folder = tmp_path / "in"
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"file://{tmp_path}/part{i}")
        part = next((tmp_path / f"part{i}").glob("*.parquet"))
        folder.mkdir(exist_ok=True)
        target = folder / f"{i:05}.parquet"
        target.write_bytes(part.read_bytes())
        import os

        os.utime(target, (1_700_000_000 + i, 1_700_000_000 + i))
    return spark.readStream.schema(spark.createDataFrame([], schema).schema).option("maxFilesPerTrigger", 1).parquet(f"file://{folder}")


def walk_sessions(rows, idle=30, cap=480):
    out, users = set(), {}
    for user, ts, _ in rows:
        if user is not None and ts is not None:
            users.setdefault(user, []).append(ts)
    for user, times in users.items():
        spans = []
        for t in sorted(times):
            if spans and t < spans[-1][1] + dt.timedelta(minutes=idle) and t < spans[-1][0] + dt.timedelta(minutes=cap):
                spans[-1][1:] = [t, spans[-1][2] + 1]
            else:
                spans.append([t, t, 1])
        out |= {(user, a, min(b + dt.timedelta(minutes=idle), a + dt.timedelta(minutes=cap)), n) for a, b, n in spans}
    return out


def walk_verdicts(rows, limit, minutes):
    out, users = set(), {}
    for user, ts, i in sorted((r for r in rows if r[0] is not None and r[1] is not None), key=lambda r: (r[1], r[2])):
        times = users[user] = [t for t in users.get(user, []) if t > ts - dt.timedelta(minutes=minutes)]
        allowed = len(times) < limit
        if allowed:
            times.append(ts)
        out.add((user, i, allowed, limit - len(times), times[0] + dt.timedelta(minutes=minutes)))
    return out


def naive(rows):
    return {tuple(v.replace(tzinfo=None) if isinstance(v, dt.datetime) else v for v in r) for r in rows}


def shuffled(seed, n=400, minutes=3000, behind=50):
    """Events in batches, each up to `behind` minutes out of order, within the watermark of an hour; one user has a third."""
    rng = random.Random(seed)
    rows = [(0 if rng.random() < 0.34 else rng.randrange(1, 6), at(rng.uniform(0, minutes)), i) for i in range(n)]
    rows += [(None, at(5), n), (1, None, n + 1), (2, at(7), n + 2), (2, at(7), n + 2)]
    late = sorted(rows, key=lambda r: (r[1] or T0) + dt.timedelta(minutes=rng.uniform(0, behind)))
    cuts = sorted(rng.sample(range(1, len(late)), 4))
    return rows, [late[a:b] for a, b in zip([0, *cuts], [*cuts, len(late)])]


@pytest.mark.parametrize("seed", [1, 2])
def test_capped_sessions_out_of_order(spark, tmp_path, seed):
    rows, batches = shuffled(seed)
    found = SO.run_to_end(stream(spark, tmp_path, batches), lambda e: SO.capped_sessions(e, 30, 2), f"file://{tmp_path}/run")
    got = found.collect()
    assert naive(got) == walk_sessions(rows, 30, 120) and len(got) == len(naive(got))


def test_event_before_an_open_session(spark, tmp_path):
    """50 minutes before the open session's start: a session of its own; between two sessions: it joins them."""
    batches = [[(1, at(100), 1), (2, at(100), 1)], [(1, at(50), 2), (2, at(75), 2)], [(2, at(52), 3)]]
    found = SO.run_to_end(stream(spark, tmp_path, batches), lambda e: SO.capped_sessions(e), f"file://{tmp_path}/run")
    assert naive(found.collect()) == {(1, at(50), at(80), 1), (1, at(100), at(130), 1), (2, at(52), at(130), 3)}


def test_events_past_the_watermark_are_dropped(spark, tmp_path):
    batches = [[(1, at(1000), 1)], [(1, at(2000), 2)], [(1, at(10), 3)], [(1, at(2010), 4)]]
    found = SO.run_to_end(stream(spark, tmp_path, batches), lambda e: SO.capped_sessions(e), f"file://{tmp_path}/run")
    assert naive(found.collect()) == {(1, at(1000), at(1030), 1), (1, at(2000), at(2040), 2)}


def test_rate_verdicts_out_of_order(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(SO, "APPENDED", 7)
    rows, batches = shuffled(3)
    batches[1].append((5, at(1), 9000))
    rows.append((5, at(1), 9000))
    found = SO.run_to_end(stream(spark, tmp_path, [sum(batches, [])]), lambda e: SO.rate_verdicts(e, 3, 60), f"file://{tmp_path}/one")
    assert naive(found.collect()) == walk_verdicts(rows, 3, 60)


def test_rate_verdicts_in_batches(spark, tmp_path):
    rows, batches = shuffled(4)
    found = SO.run_to_end(stream(spark, tmp_path, batches), lambda e: SO.rate_verdicts(e, 2, 90), f"file://{tmp_path}/run")
    assert naive(found.collect()) == walk_verdicts(rows, 2, 90)


TURNS = "conv_id long, turn int, text string"


def test_last_turns_over_batches(spark, tmp_path):
    batches = [[(1, 5, "a"), (1, 1, "b"), (2, 0, "c"), (None, 3, "d"), (3, None, "e")], [(1, 4, "f"), (1, 2, "g")], [(2, 9, "h"), (1, 3, "i")]]
    found = SO.run_updates(SO.last_turns(stream(spark, tmp_path, batches, TURNS), 3, None), ["conv_id"], f"file://{tmp_path}/run")
    assert {tuple(r) for r in found.collect()} == {(1, 3, 3, 5), (2, 2, 0, 9)}


def test_idle_conversations_leave_the_state(spark, tmp_path):
    """With a time to live of no hours, what a batch kept has gone by the next."""
    source = stream(spark, tmp_path, [[(1, 5, "a")], [(1, 6, "b")]], TURNS)
    seen = []
    with SO.state_store(spark):
        turns = SO.last_turns(source, 3, 0.0001)  # 0.36 seconds
        sink = lambda batch, epoch: (seen.extend(tuple(r) for r in batch.collect()), time.sleep(1))
        query = turns.writeStream.foreachBatch(sink).outputMode("update").option("checkpointLocation", f"file://{tmp_path}/c").start()
        until = time.time() + 60
        while len(seen) < 2 and time.time() < until:
            time.sleep(0.5)
        query.stop()
    assert seen[:2] == [(1, 1, 5, 5), (1, 1, 6, 6)]


@pytest.mark.parametrize("seed", [5, 6, 7])
def test_upserts_are_the_same_in_any_split(spark, tmp_path, seed):
    rng = random.Random(seed)
    rows = [(rng.randrange(8), at(1440 * rng.uniform(0, 60)), i) for i in range(120)] + [(3, None, 500), (None, at(1440 * 59), 501)]
    newest = max(r[1] for r in rows if r[1])
    edge = newest - dt.timedelta(days=20)
    rng.shuffle(rows)
    batches = [rows[i::4] for i in range(4)] if seed == 5 else ([rows] if seed == 6 else [rows[:1], rows[1:]])
    merged, late = ST.upsert_stream(stream(spark, tmp_path, batches), "user_id", "ts", "20 days", f"file://{tmp_path}/run")
    in_time = [r for r in rows if r[1] is not None and r[1] >= edge]
    assert naive(late.collect()) == {r for r in rows if r not in in_time}
    want = {}
    for r in in_time:
        want[r[0]] = max(want.get(r[0], r), r, key=lambda x: x[1])
    assert naive(merged.collect()) == set(want.values()) and merged.count() == len(want) and late.count() == len(rows) - len(in_time)


def test_late_row_in_a_batch_of_its_own(spark, tmp_path):
    merged, late = ST.upsert_stream(stream(spark, tmp_path, [[(1, at(1440 * 70), 1)], [(2, at(1440 * 10), 2)]]), "user_id", "ts", "20 days", f"file://{tmp_path}/run")
    assert [r.event_id for r in merged.collect()] == [1] and [r.event_id for r in late.collect()] == [2]


def test_epoch_that_runs_again_changes_nothing(spark, tmp_path):
    epochs = ST.Epochs(spark, f"file://{tmp_path}/run")
    rows = spark.createDataFrame([(1, T0, 1)], SCHEMA)
    epochs.write(rows, "late", 0)
    assert epochs.read("late", rows.schema).count() == 0 and epochs.newest() is None  # not committed
    for _ in range(2):
        epochs.write(rows, "late", 0)
        epochs.commit(0, 5, 1)
    assert epochs.read("late", rows.schema).count() == 1 and (epochs.late(), epochs.newest(), epochs.newest(0)) == (1, 5, None)


def test_late_rows_over_many_batches(spark, tmp_path):
    """More batches than a query remembers the progress of."""
    rng = random.Random(8)
    batches = [[(1, at(60 * k - (rng.uniform(0, 300) if rng.random() < 0.5 else 0)), k)] for k in range(105)]
    batches[40].append((1, None, 999))
    newest, late, kept = None, set(), {}
    for batch in batches:
        for r in batch:
            start = r[1] and r[1].replace(minute=0, second=0, microsecond=0)
            if start is None or newest is not None and start + dt.timedelta(hours=1) <= newest - dt.timedelta(hours=1):
                late.add(r)
            else:
                kept[start] = kept.get(start, 0) + 1
        newest = max([t for t in [newest, *(r[1] for r in batch)] if t])
    counts, rows, n = ST.windows_and_late(stream(spark, tmp_path, batches), base=f"file://{tmp_path}/run")
    assert n == len(late) > 10 and naive(rows.collect()) == late
    assert {r.start.replace(tzinfo=None): r.n for r in counts.collect()} == kept


def test_streams_of_nothing(spark, tmp_path):
    events = stream(spark, tmp_path, [[]])
    assert SO.run_to_end(events, lambda e: SO.capped_sessions(e), f"file://{tmp_path}/a").count() == 0
    merged, late = ST.upsert_stream(events, "user_id", "ts", "20 days", f"file://{tmp_path}/b")
    assert merged.count() == late.count() == 0
    counts, rows, n = ST.windows_and_late(events, base=f"file://{tmp_path}/c")
    assert counts.count() == rows.count() == n == 0
