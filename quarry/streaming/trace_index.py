"""Incremental indexing of trace files: bounded steps, resumable by checkpoint, exactly once by file."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Fields of a trace line that the index keeps; the line's text stays in the file.
LINE = T.StructType([T.StructField(c, T.StringType()) for c in ("event_id", "episode_id", "kind", "call_id")])


def index_rows(lines: DataFrame) -> DataFrame:
    """Metadata of each trace line, with whether it could be read."""
    e = F.from_json("value", LINE)
    ok = e.isNotNull() & e["event_id"].isNotNull()
    return lines.select(
        F.regexp_extract("file", r"([^/]+)$", 1).alias("trace"), *[e[c].alias(c) for c in LINE.fieldNames()],
        F.octet_length("value").cast("long").alias("bytes"), F.sha2("value", 256).alias("digest"), F.coalesce(ok, F.lit(False)).alias("readable"),
    )


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"))


def index_step(spark: SparkSession, path: str, target: str, checkpoint: str, files_per_step: int = 1) -> int:
    """Index the files that came since the last call, a few per micro-batch, and return how many batches ran."""
    stream = spark.readStream.format("text").option("maxFilesPerTrigger", files_per_step).load(path)
    rows = index_rows(stream.select("value", F.col("_metadata.file_path").alias("file")))
    q = rows.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return len([p for p in q.recentProgress if p.numInputRows])


def byte_step(sizes: DataFrame, start: int, max_events: int, max_bytes: int) -> DataFrame:
    """The lines (trace, position, bytes) of each trace that one step takes from ``start`` on: within both bounds, and
    ending before the first line that does not fit. An empty step means that the bounds are too small for the next line."""
    from pyspark.sql import Window

    w = Window.partitionBy("trace").orderBy("position")
    s = sizes.filter(F.col("position") >= start).withColumns({"_n": F.row_number().over(w), "_b": F.sum("bytes").over(w)})
    return s.filter((F.col("_n") <= max_events) & (F.col("_b") <= max_bytes)).drop("_n", "_b")


def live_sessions(items: DataFrame, delay: str, ttl: str) -> DataFrame:
    """A stream of items with their expiry by event time; state for keys older than the watermark is dropped."""
    timed = items.withWatermark("updated_at", delay)
    return timed.groupBy(F.session_window("updated_at", ttl), "id").agg(F.count("*").alias("retrievals"), F.max("updated_at").alias("last_at"))
