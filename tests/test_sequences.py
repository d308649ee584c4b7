"""Numbers and timers of the stream against the batch, and of the batch against a plain loop."""

import random
from datetime import datetime, timedelta, timezone

import pytest
from chaptermill.streaming import sequences

START = datetime(2024, 1, 1, tzinfo=timezone.utc)


def made_up(seed, n=240, projects=4):
    rng = random.Random(seed)
    rows, generation = [], dict.fromkeys(range(projects), 0)
    for i in range(n):
        project = rng.randrange(projects) if rng.random() < 0.7 else 0
        generation[project] += rng.random() < 0.1
        kind = rng.choice(["task-progress", "task-succeeded", "token-opened", "token-consumed"])
        token = f"t{rng.randrange(max(1, i // 3 - 6), i // 3 + 2)}-{project}" if kind.startswith("token") else None
        at = START + timedelta(milliseconds=1000 * 7 * i + rng.choice([0, 0, 500]))
        rows.append((project, f"e{i:05}", at, kind, generation[project] - (rng.random() < 0.1) if rng.random() < 0.9 else None, token))
    return rows


def in_a_loop(rows):
    """Numbered events by one pass in order; expiries take their place in it."""
    found = []
    for project in {r[0] for r in rows}:
        own = sorted({r[1]: r for r in rows if r[0] == project}.values(), key=lambda r: (r[2], r[1]))
        newest, kept = None, []
        for r in own:
            if r[4] is not None and newest is not None and r[4] < newest:
                continue
            newest = r[4] if newest is None or (r[4] is not None and r[4] > newest) else newest
            kept.append(r)
        hold = timedelta(milliseconds=sequences.TTL_MS)
        told = list(kept)
        for i, r in enumerate(told):
            if r[3] == "token-opened":
                after = next((k[2] for k in told[i + 1 :] if k[5] == r[5] and k[3].startswith("token")), None)
                if after is None or after >= r[2] + hold:
                    kept.append((project, f"expired-{r[5]}-{round(r[2].timestamp() * 1000)}", r[2] + hold, "token-expired", None, r[5]))
        found += [(project, n, r[1], r[3]) for n, r in enumerate(sorted(kept, key=lambda r: (r[2], r[1])), 1)]
    return sorted(found)


def brief(rows):
    return sorted((r.project_id, r.sequence, r.event_id, r.event_type) for r in rows)


@pytest.mark.parametrize("width", [1 << 20, 60_000])
def test_batch_numbers(spark, monkeypatch, width):
    monkeypatch.setattr(sequences, "WIDTH", width)
    rows = made_up(3)
    odd = [(None, "x", START, "a", 1, None), (1, None, START, "a", 1, None), (1, "y", None, "a", 1, None), rows[5]]
    frame = spark.createDataFrame([*rows, *odd], sequences.EVENTS).repartition(3)
    got = brief(sequences.numbered(frame).collect())
    assert got == in_a_loop(rows) and any(k == "token-expired" for *_, k in got)
    assert len(got) < len(rows) + sum(k == "token-expired" for *_, k in got)  # some came late


def test_stream_equals_batch_and_goes_on_after_a_restart(spark, tmp_path):
    pytest.importorskip("google.protobuf")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rows = made_up(9, 120, 3)
    # Out of order by less than the delay, in small files; an event far ahead lets the watermark pass the rest.
    rng = random.Random(1)
    arrival = sorted(rows, key=lambda r: (r[2] + timedelta(seconds=rng.randrange(0, 90)), r[1]))
    last = (99, "end", START + timedelta(days=1), "a", 0, None)
    batches = [arrival[:50], arrival[50:51], arrival[51:], [last], [(99, "end2", START + timedelta(days=1, seconds=1), "a", 0, None)]]
    source, out, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    spark.createDataFrame([], sequences.EVENTS).write.parquet(source)
    for batch in batches:  # each its own query: a restart from the checkpoint
        spark.createDataFrame(batch, sequences.EVENTS).coalesce(1).write.mode("append").parquet(source)
        events = spark.readStream.schema(sequences.EVENTS).parquet(source)
        stream = sequences.numbered_stream(events, "2 minutes").writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start()
        stream.awaitTermination(300)
        assert stream.exception() is None
    got = brief(r for r in spark.read.parquet(out).collect() if r.project_id != 99)
    assert got == in_a_loop(rows) == brief(sequences.numbered(spark.createDataFrame(rows, sequences.EVENTS)).collect())
    for project in {g[0] for g in got}:
        assert [n for p, n, *_ in got if p == project] == list(range(1, 1 + sum(g[0] == project for g in got)))
