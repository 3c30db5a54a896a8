"""Growing traces by byte offsets, and expiry by timers."""

import json

import pytest
from pyspark.sql import functions as F

from quarry.streaming import expiry, offsets


def event(i, **more):
    return json.dumps({"event_id": f"e{i}", "episode_id": "t", "kind": "k", **more}, ensure_ascii=False)


@pytest.fixture
def traces(tmp_path):
    d = tmp_path / "traces"
    d.mkdir()
    for name, lines, end in (
        ("plain", [event(i, text="é" * i) for i in range(12)], "\n"), ("cut", [event(i) for i in range(7)], ""),
        ("poison", [event(0), event(1), "{no", event(3)], "\n"), ("again", [event(0), event(1), event(0), event(2)], "\n"), ("large", [event(0), event(1, text="x" * 500), event(2)], "\n"),
        ("blank", [event(0), "", event(1)], "\n"), ("null", ['{"kind":"k"}', event(1)], "\n"),
    ):
        (d / name).write_text("\n".join(lines) + end, "utf-8")
    return d


def by_hand(raw, max_events, max_bytes, max_event_bytes, steps):
    """Rows (position, event_id, start, end) and checkpoints of one trace, line by line."""
    rows, points, at, n, seen = [], [], 0, 0, set()
    for _ in range(steps):
        start, added, error = at, 0, None
        while added < max_events and at - start < max_bytes and at < len(raw):
            allowance = min(max_event_bytes, max_bytes - (at - start))
            stop = raw.find(b"\n", at)
            stop = len(raw) if stop < 0 else stop + 1
            if stop - at > allowance:
                if not added:
                    error = (offsets.OVER_BUDGET, at, at + allowance + 1)
                break
            try:
                i = json.loads(raw[at:stop])["event_id"]
            except (ValueError, KeyError):
                error = (offsets.MALFORMED, at, stop)
                break
            if i in seen:
                error = (offsets.REPEATED, at, stop)
                break
            seen.add(i)
            rows.append((n, i, at, stop))
            at, n, added = stop, n + 1, added + 1
        points.append((at, n, at - start, error is None and at == len(raw), *(error or (None, None, None))))
        if points[-1][3] or (error and error[0] != offsets.OVER_BUDGET):
            break
    return rows, points


@pytest.mark.parametrize("bounds", [(5, 100_000, 400), (3, 200, 150), (100, 130, 130), (100, 100_000, 100_000)])
def test_steps_stop_where_the_bounds_say(spark, traces, tmp_path, bounds):
    state = str(tmp_path / "state")
    lines = offsets.positioned_lines(spark, str(traces)).cache()
    for _ in range(4):
        offsets.step(spark, lines, state, *bounds)
    for trace in traces.iterdir():
        rows, points = by_hand(trace.read_bytes(), *bounds, 4)
        got = offsets.indexed(spark, state).filter(F.col("trace") == trace.name).orderBy("position").collect()
        assert [(r.position, r.event_id, r.start_byte, r.end_byte) for r in got] == rows
        got = offsets.checkpoints(spark, state).filter(F.col("trace") == trace.name).orderBy("step").collect()
        assert [(r.next_byte, r.event_count, r.bytes_processed, r.complete, r.error, r.error_start, r.error_end) for r in got] == points


def test_larger_bounds_go_on_after_a_large_line(spark, traces, tmp_path):
    state = str(tmp_path / "state")
    lines = offsets.positioned_lines(spark, str(traces)).filter("trace in ('large', 'poison')").cache()
    offsets.run(spark, lines, state, 10, 10_000, 200)
    assert {r.trace: r.error for r in offsets.latest_checkpoints(spark, state).collect()} == {"large": offsets.OVER_BUDGET, "poison": offsets.MALFORMED}
    offsets.run(spark, lines, state, 10, 10_000, 2_000)
    assert {r.trace: (r.event_count, r.complete) for r in offsets.latest_checkpoints(spark, state).collect()} == {"large": (3, True), "poison": (2, False)}


def test_a_lost_step_is_done_again(spark, traces, tmp_path):
    state = tmp_path / "state"
    lines = offsets.positioned_lines(spark, str(traces)).filter("trace = 'plain'").cache()
    offsets.step(spark, lines, str(state), 5, 10_000, 400)
    orphan = spark.read.parquet(str(state / "rows" / "step=1"))
    orphan.write.parquet(str(state / "rows" / "step=2"))  # rows without a checkpoint
    assert offsets.indexed(spark, str(state)).count() == 5
    offsets.run(spark, lines, str(state), 5, 10_000, 400)
    assert sorted(r.position for r in offsets.indexed(spark, str(state)).collect()) == list(range(12))


def test_lines_of_a_file_in_several_splits(spark, tmp_path):
    raw = "".join(f"{i} " + "é" * (i % 50) + "\n" for i in range(3000))
    (tmp_path / "one").write_text(raw, "utf-8")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20k")
    try:
        lines = offsets.positioned_lines(spark, str(tmp_path))
        assert spark.read.option("lineSep", "\n").text(str(tmp_path)).rdd.getNumPartitions() > 1
        data = raw.encode()
        rows = sorted((r.start_byte, r.end_byte, r.line) for r in lines.collect())
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert [data[a:b].decode() for a, b, _ in rows] == [f"{line}\n" for _, _, line in rows] == raw.splitlines(keepends=True)


def test_timers_expire_items(spark, tmp_path):
    source, out, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    ttl = {"session": 60_000, "note": 600_000}
    batches = [
        [("a", "session", 0), ("b", "note", 0), ("c", "session", 10), ("d", "lasting", 0), (None, "session", 5)],
        [("a", "session", 50), ("c", "session", 100)],  # a goes on, c starts anew
        [("b", "note", 200)],
        [("a", "session", 20), ("e", "session", 195)],  # the first is late, the second is not
        [("f", "session", 1000)],
    ]
    before = {k: spark.conf.get(k, None) for k in expiry.STATE_STORE}
    try:
        for k, v in expiry.STATE_STORE.items():
            spark.conf.set(k, v)
        for rows in batches:  # each batch is a run of its own, from the checkpoint of the one before
            df = spark.createDataFrame(rows, "id string, kind string, s long").select("id", "kind", F.timestamp_seconds(F.col("s") + 10_000).alias("updated_at"))
            df.coalesce(1).write.mode("append").parquet(source)
            stream = spark.readStream.schema(df.schema).parquet(source)
            q = expiry.expired_items(stream, ttl, "10 seconds").writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start()
            q.awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)
    at = lambda t: t.timestamp() - 10_000
    got = sorted((r.id, at(r.started_at), at(r.last_at), r.updates, at(r.expired_at)) for r in spark.read.parquet(out).collect())
    assert got == [("a", 0, 50, 2, 110), ("b", 0, 200, 2, 800), ("c", 10, 10, 1, 70), ("c", 100, 100, 1, 160), ("e", 195, 195, 1, 255)]
