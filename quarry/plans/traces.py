"""Queries over growing traces and live items: steps by byte offsets, expiry by timers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.operators import events as E
from quarry.operators.lineage import cut, new_folder
from quarry.plans.registry import ORACLES, query
from quarry.plans.runs import EVENTS, events
from quarry.sources import items
from quarry.sources.adapters import table
from quarry.streaming import expiry, offsets

#: Bounds of a step of trace_steps, and the longest line.
STEP = {"max_events": 45, "max_bytes": 4000, "max_event_bytes": 400}


@query
def trace_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each episode is a file; in one of 9 a line is broken, in one of 11 an event comes again. The second run resumes the first."""
    folder, state = new_folder(spark, "traces"), new_folder(spark, "trace-index")
    e = events(spark, sf_dir).select("episode_id", "position", *[F.col(c).cast("string").alias(c) for c in ("event_id", "kind", "call_id")])
    ids = F.when((F.col("episode_id") % 11 == 0) & (F.col("position") == 40), "e7").otherwise(F.concat(F.lit("e"), F.col("position")))
    line = F.to_json(F.struct(ids.alias("event_id"), F.col("episode_id").cast("string").alias("episode_id"), "kind", "call_id"))
    broken = (F.col("episode_id") % 9 == 0) & (F.col("position") == 35)
    # Over so many folders, tasks list the files, and not the driver.
    path = F.format_string("%02d/%d", F.pmod("episode_id", F.lit(64)), "episode_id")
    items.write_lines(e.select(path.alias("path"), "position", F.when(broken, "{broken").otherwise(line).alias("line")), folder.removeprefix("file:"), "position")
    lines = cut(offsets.positioned_lines(spark, folder))
    offsets.run(spark, lines, state, **STEP, most_steps=1)
    offsets.run(spark, lines, state, **STEP)
    rows = offsets.indexed(spark, state).select("trace", "step", F.lit("row").alias("what"), "position", "event_id", "start_byte", "end_byte", F.lit(None).cast("string").alias("error"))
    steps = offsets.checkpoints(spark, state).select("trace", "step", F.when(F.col("complete"), "complete").otherwise("checkpoint").alias("what"), F.col("event_count").alias("position"), F.lit(None).cast("string").alias("event_id"), F.coalesce("error_start", "next_byte").alias("start_byte"), F.coalesce("error_end", "next_byte").alias("end_byte"), "error")
    return rows.unionByName(steps)


#: Each trace walks from step to step: the furthest line that fits, before the first one that cannot be read.
ORACLES["trace_steps"] = EVENTS.replace("WITH ", "WITH RECURSIVE ", 1) + f""",
t AS (SELECT CAST(episode_id AS VARCHAR) AS trace, position AS n, episode_id % 9 = 0 AND position = 35 AS broken, episode_id % 11 = 0 AND position = 40 AS again, kind, call_id FROM episode_events),
v AS (SELECT trace, n, CASE WHEN broken THEN 'malformed_trace_event' WHEN again THEN 'repeated_event' END AS bad, CASE WHEN again THEN 'e7' ELSE 'e' || n END AS event_id,
 CASE WHEN broken THEN '{{broken' ELSE '{{"event_id":"' || CASE WHEN again THEN 'e7' ELSE 'e' || n END || '","episode_id":"' || trace || '","kind":"' || kind || '"' || CASE WHEN call_id IS NULL THEN '' ELSE ',"call_id":"' || call_id || '"' END || '}}' END AS line FROM t),
l AS (SELECT trace, n, bad, event_id, CAST(sum(strlen(line) + 1) OVER (PARTITION BY trace ORDER BY n) AS BIGINT) AS e, strlen(line) + 1 AS size FROM v),
q AS (SELECT trace, max(n) AS total, coalesce(min(n) FILTER (WHERE bad IS NOT NULL), 1000000000) AS stop FROM l GROUP BY trace),
s(trace, step, n, e, done) AS (SELECT trace, 0, CAST(0 AS BIGINT), CAST(0 AS BIGINT), false FROM q
 UNION ALL SELECT s.trace, s.step + 1, max(l.n), max(l.e), max(l.n) = any_value(q.total) OR (any_value(q.stop) = max(l.n) + 1 AND max(l.n) < s.n + {STEP["max_events"]} AND any_value(b.e) - s.e <= {STEP["max_bytes"]})
  FROM s JOIN q ON q.trace = s.trace JOIN (SELECT trace, n, e FROM l UNION ALL SELECT trace, 0, 0 FROM q) l ON l.trace = s.trace LEFT JOIN l b ON b.trace = s.trace AND b.n = q.stop
  WHERE NOT s.done AND l.n >= s.n AND l.n <= s.n + {STEP["max_events"]} AND l.e - s.e <= {STEP["max_bytes"]} AND l.n < q.stop GROUP BY s.trace, s.step, s.n, s.e)
SELECT s.trace, s.step, 'row' AS what, l.n - 1 AS position, l.event_id, l.e - l.size AS start_byte, l.e AS end_byte, NULL AS error
FROM s JOIN s p ON p.trace = s.trace AND p.step = s.step - 1 JOIN l ON l.trace = s.trace AND l.n > p.n AND l.n <= s.n
UNION ALL SELECT s.trace, s.step, CASE WHEN s.n = q.total THEN 'complete' ELSE 'checkpoint' END, s.n, NULL, CASE WHEN s.done AND s.n < q.total THEN b.e - b.size ELSE s.e END, CASE WHEN s.done AND s.n < q.total THEN b.e ELSE s.e END, CASE WHEN s.done AND s.n < q.total THEN b.bad END
FROM s JOIN q USING (trace) LEFT JOIN l b ON b.trace = s.trace AND b.n = q.stop WHERE s.step > 0"""

#: Milliseconds that an item of a kind lives after its last update.
TTL = {"short": 6 * 3600_000, "long": 30 * 3600_000}


@query
def expired_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users as items, replayed from files of ten days each."""
    source, out, state = new_folder(spark, "updates"), new_folder(spark, "expired"), new_folder(spark, "expiry-state")
    e = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("id"), F.when(F.col("user_id") % 3 == 0, "short").otherwise("long").alias("kind"), F.date_trunc("millisecond", "ts").alias("updated_at"))
    third = F.floor((F.dayofmonth("updated_at") - 1) / 11).cast("int")
    for i in range(3):  # one file after the other, as they would come
        e.filter(third == i).coalesce(1).write.mode("append").parquet(source)
    before = {k: spark.conf.get(k, None) for k in expiry.STATE_STORE}
    for k, v in expiry.STATE_STORE.items():
        spark.conf.set(k, v)
    try:
        stream = spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 1).parquet(source)
        q = expiry.expired_items(stream, TTL, "1 hour").writeStream.format("parquet").option("path", out).option("checkpointLocation", state).outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)
    return spark.read.schema(expiry.EXPIRED).parquet(out)


#: The watermark ends one hour before the last update; a longer pause than an item's time starts it anew.
ORACLES["expired_items"] = f"""
WITH u AS (SELECT CAST(user_id AS VARCHAR) AS id, CASE WHEN user_id % 3 = 0 THEN 'short' ELSE 'long' END AS kind, date_trunc('millisecond', ts) AS t, CASE WHEN user_id % 3 = 0 THEN INTERVAL {TTL["short"]} MILLISECOND ELSE INTERVAL {TTL["long"]} MILLISECOND END AS ttl FROM events),
g AS (SELECT *, CASE WHEN t >= lag(t) OVER (PARTITION BY id ORDER BY t) + ttl THEN 1 ELSE 0 END AS anew FROM u),
s AS (SELECT *, sum(anew) OVER (PARTITION BY id ORDER BY t ROWS UNBOUNDED PRECEDING) AS life FROM g),
r AS (SELECT id, kind, min(t) AS started_at, max(t) AS last_at, count(*) AS updates, max(t) + any_value(ttl) AS expired_at FROM s GROUP BY id, kind, life)
SELECT * FROM r WHERE expired_at <= (SELECT max(t) FROM u) - INTERVAL 1 HOUR
 OR EXISTS (SELECT 1 FROM r n WHERE n.id = r.id AND n.started_at > r.started_at)"""


@query
def selected_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir).select(F.col("episode_id").alias("trace"), "event_id", (F.col("position") - 1).alias("position"), "call_id", F.col("kind").isin("failed", "user_message").alias("marked"))
    return E.select_metadata(e, e.filter("event_id % 501 = 0").select("event_id"), 12)


#: The choice goes probe by probe; each takes the next marked event, its call, the event there, and its call, as long as there is room.
ORACLES["selected_metadata"] = EVENTS.replace("WITH ", "WITH RECURSIVE ", 1) + """,
e AS (SELECT episode_id AS trace, event_id, position - 1 AS p, call_id, kind IN ('failed', 'user_message') AS marked, count(*) OVER (PARTITION BY episode_id) AS n FROM episode_events),
b(trace, lo, hi, depth) AS (SELECT DISTINCT trace, CAST(1 AS BIGINT), n - 2, 2 FROM e
 UNION ALL SELECT trace, unnest([lo, (lo + hi) // 2 + 1]), unnest([(lo + hi) // 2 - 1, hi]), depth + 1 FROM b WHERE lo <= hi),
d AS (SELECT trace, p, min(depth) AS depth FROM (SELECT trace, (lo + hi) // 2 AS p, depth FROM b WHERE lo <= hi UNION ALL SELECT trace, CAST(0 AS BIGINT), 0 FROM e UNION ALL SELECT trace, n - 1, 1 FROM e) GROUP BY trace, p),
t AS (SELECT trace, p, row_number() OVER (PARTITION BY trace ORDER BY depth, p) AS turn FROM d),
c AS (SELECT trace, call_id, list(p ORDER BY p)[1:2] AS partners FROM e WHERE call_id IS NOT NULL GROUP BY trace, call_id),
x AS (SELECT e.trace, e.p, coalesce(c.partners, []) AS partners FROM e LEFT JOIN c USING (trace, call_id)),
w AS (SELECT t.trace, 2 * t.turn - 1 AS k, (SELECT min(e.p) FROM e WHERE e.trace = t.trace AND e.p >= t.p AND e.marked) AS p FROM t WHERE turn <= 12 UNION ALL SELECT trace, 2 * turn, p FROM t WHERE turn <= 12),
s AS (SELECT trace, row_number() OVER (PARTITION BY trace ORDER BY k) AS k, p, partners FROM w JOIN x USING (trace, p)),
f(trace, k, chosen) AS (SELECT trace, CAST(0 AS BIGINT), coalesce(list(p ORDER BY p) FILTER (WHERE event_id % 501 = 0), []) FROM e GROUP BY trace
 UNION ALL SELECT f.trace, s.k, CASE WHEN len(chosen) >= 12 THEN chosen ELSE
  list_concat(list_concat(chosen, list_filter([s.p], lambda z: NOT list_contains(chosen, z))),
   list_filter(s.partners[1:least(2, 12 - len(chosen) - CASE WHEN list_contains(chosen, s.p) THEN 0 ELSE 1 END)], lambda z: NOT list_contains(chosen, z) AND z <> s.p)) END
  FROM f JOIN s ON s.trace = f.trace AND s.k = f.k + 1),
z AS (SELECT trace, chosen[1:12] AS chosen FROM f QUALIFY row_number() OVER (PARTITION BY trace ORDER BY k DESC) = 1),
y AS (SELECT trace, unnest(chosen) AS p, unnest(range(len(chosen))) AS place FROM z)
SELECT y.trace, CAST(place AS INTEGER) AS place, event_id FROM y JOIN e USING (trace, p)"""
