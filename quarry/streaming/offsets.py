"""Incremental indexing of growing trace files by byte offsets: bounded steps that resume inside a file.

The index and its progress are two tables below one folder. A step takes from each trace the lines after its offset that
fit in the bounds of events and bytes, and stops before a line that does not fit or cannot be read. It writes the rows of
the index under its own number first and then its checkpoints, one row for each trace that it worked on; rows count only
once their step has checkpoints, so a step that was lost on the way is done again in the same place.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.utils import AnalysisException

#: What a line must be; event_id must not be null.
LINE = T.StructType([T.StructField(c, T.StringType()) for c in ("event_id", "episode_id", "kind", "call_id")])
CHECKPOINT = "trace string, step int, next_byte long, event_count long, bytes_processed long, complete boolean, error string, error_start long, error_end long"
#: Bytes of small files that one task reads.
PART = 16 << 20
#: A line over the bounds may be taken by a later step with larger ones; any other error ends a trace.
OVER_BUDGET, MALFORMED, REPEATED = "trace_event_budget", "malformed_trace_event", "repeated_event"


def positioned_lines(spark: SparkSession, path: str, name: str = r"([^/]+)$") -> DataFrame:
    """Each line of the files below a folder with its bytes: trace, start_byte, end_byte, line. Lines end with a newline.

    ``name`` takes the trace from the path of its one file.

    A file is read in splits; a line lies in the split that it starts in, so lines are ordered by split and then as they are read,
    and bytes are summed within a split and over the splits of a file.
    """
    lines = spark.read.option("lineSep", "\n").option("recursiveFileLookup", "true").text(path)
    m = F.col("_metadata")
    rows = lines.select(
        F.regexp_extract(m["file_path"], name, 1).alias("trace"), m["file_size"].alias("size"), m["file_block_start"].alias("split"),
        F.col("value").alias("line"), (F.octet_length("value") + 1).cast("long").alias("n"),
    )
    # Spark counts 4 MB for opening a file; tasks are put together to about PART bytes. One split stays in one task.
    whole = int(lines._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    tasks = max(4 * spark.sparkContext.defaultParallelism, -(-whole // PART))
    # A file below both settings is never split, so only larger ones are read for the sizes of their splits.
    conf = spark._jsparkSession.sessionState().conf()
    large = rows.filter(F.col("size") > min(conf.filesMaxPartitionBytes(), conf.filesOpenCostInBytes()))
    totals = large.groupBy("trace", "split").agg(F.sum("n").alias("n"))
    before = totals.select("trace", "split", (F.sum("n").over(Window.partitionBy("trace").orderBy("split")) - F.col("n")).alias("before"))
    end = F.coalesce("before", F.lit(0)) + F.sum("n").over(Window.partitionBy("trace", "split").orderBy("at"))
    placed = rows.coalesce(tasks).withColumn("at", F.monotonically_increasing_id()).join(before, ["trace", "split"], "left").withColumn("end", end)
    # The last line may lack its newline.
    return placed.select("trace", (F.col("end") - F.col("n")).alias("start_byte"), F.least("end", "size").alias("end_byte"), "line", "size")


def checkpoints(spark: SparkSession, state: str) -> DataFrame:
    try:
        return spark.read.schema(CHECKPOINT).parquet(f"{state}/checkpoints")
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], CHECKPOINT)


def latest_checkpoints(spark: SparkSession, state: str) -> DataFrame:
    """Where each trace stands."""
    return checkpoints(spark, state).groupBy("trace").agg(F.max_by(F.struct("step", "next_byte", "event_count", "complete", "error", "error_start", "error_end"), "step").alias("x")).select("trace", "x.*")


def indexed(spark: SparkSession, state: str) -> DataFrame:
    """The rows of all steps that have checkpoints: trace, position, the fields of the line, start_byte, end_byte, digest, step."""
    done = checkpoints(spark, state).select("step").distinct()
    return spark.read.parquet(f"{state}/rows").join(F.broadcast(done), "step", "left_semi")


def step(spark: SparkSession, lines: DataFrame, state: str, max_events: int, max_bytes: int, max_event_bytes: int) -> int:
    """Go on with every trace that is neither complete nor stopped by a line that cannot be read; how many there were.

    lines: what ``positioned_lines`` gives, best as a table. Of each trace only lines within max_bytes of its offset are looked at.
    """
    known = latest_checkpoints(spark, state)
    number = (checkpoints(spark, state).agg(F.max("step")).first()[0] or 0) + 1
    stuck = F.col("complete") | (F.col("error").isNotNull() & (F.col("error") != OVER_BUDGET))
    sizes = lines.groupBy("trace").agg(F.max("size").alias("size"))
    open_ = sizes.join(known, "trace", "left").filter(~F.coalesce(stuck, F.lit(False)))
    open_ = open_.select("trace", F.coalesce("next_byte", F.lit(0)).alias("from"), F.coalesce("event_count", F.lit(0)).alias("count"), F.col("size").alias("whole"))
    w = Window.partitionBy("trace").orderBy("start_byte")
    within = (F.col("start_byte") >= F.col("from")) & (F.col("start_byte") < F.col("from") + max_bytes)
    near = lines.join(open_, "trace").filter(within).withColumn("nth", F.row_number().over(w)).filter(F.col("nth") <= max_events)
    event = F.from_json("line", LINE)
    size = F.col("end_byte") - F.col("start_byte")
    allowance = F.least(F.lit(max_event_bytes), F.lit(max_bytes) - (F.col("start_byte") - F.col("from")))
    read = near.withColumn("event", F.when(size <= max_event_bytes, event)).withColumn("allowance", allowance)
    # An event is repeated if its trace has it in an earlier step or on an earlier line of this one.
    try:
        earlier = indexed(spark, state).select("trace", "event_id", F.lit(True).alias("seen"))
        read = read.join(earlier, (read["trace"] == earlier["trace"]) & (read["event.event_id"] == earlier["event_id"]), "left").select(read["*"], "seen")
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        read = read.withColumn("seen", F.lit(None).cast("boolean"))
    again = F.row_number().over(Window.partitionBy("trace", "event.event_id").orderBy("start_byte")) > 1
    read = read.withColumn("seen", F.coalesce(F.col("seen"), again))
    error = F.when(size > F.col("allowance"), OVER_BUDGET).when(F.col("event.event_id").isNull(), MALFORMED).when(F.col("seen"), REPEATED)
    read = read.withColumn("error", error)
    before = F.count("error").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    read = read.withColumn("errors", before).filter((F.col("errors") == 0) | ((F.col("errors") == 1) & F.col("error").isNotNull()))
    path = f"{state}/rows/step={number}"
    keep = read.select(
        "trace", (F.col("count") + F.col("nth") - 1).alias("position"), *[F.col(f"event.{c}").alias(c) for c in LINE.fieldNames()],
        "start_byte", "end_byte", F.sha2("line", 256).alias("digest"), "error", "allowance",
    )
    # Also the line that stopped a trace, so that the checkpoints follow from what was written.
    keep.write.mode("overwrite").parquet(f"{state}/taken/step={number}")
    taken = spark.read.parquet(f"{state}/taken/step={number}")
    taken.filter("error is null").drop("error", "allowance").write.mode("overwrite").parquet(path)
    ends = taken.groupBy("trace").agg(
        F.max(F.when(F.col("error").isNull(), F.col("end_byte"))).alias("end"), F.count_if(F.col("error").isNull()).alias("added"),
        F.max("error").alias("error"), F.max(F.when(F.col("error").isNotNull(), F.col("start_byte"))).alias("error_start"),
        F.max(F.when(F.col("error") == OVER_BUDGET, F.col("start_byte") + F.col("allowance") + 1).when(F.col("error").isNotNull(), F.col("end_byte"))).alias("error_end"),
    )
    rows = open_.join(ends, "trace", "left").withColumn("next", F.coalesce("end", "from")).withColumn("added", F.coalesce("added", F.lit(0)))
    # A line that only this step's bytes leave no room for is no error.
    waits = (F.col("error") == OVER_BUDGET) & (F.col("added") > 0)
    kept = lambda c: F.when(~F.coalesce(waits, F.lit(False)), F.col(c))
    out = rows.select(
        "trace", F.lit(number).alias("step"), F.col("next").alias("next_byte"), (F.col("count") + F.col("added")).alias("event_count"), (F.col("next") - F.col("from")).alias("bytes_processed"),
        (kept("error").isNull() & (F.col("next") >= F.col("whole"))).alias("complete"), kept("error").alias("error"), kept("error_start").alias("error_start"), kept("error_end").alias("error_end"),
    )
    n = open_.count()
    if n:
        out.write.mode("append").parquet(f"{state}/checkpoints")
    return n


def run(spark: SparkSession, lines: DataFrame, state: str, max_events: int, max_bytes: int, max_event_bytes: int, most_steps: int | None = None) -> int:
    """Steps until no trace goes on, or so many; the number of steps. A trace that only waits for larger bounds goes no further."""
    done = 0
    while most_steps is None or done < most_steps:
        before = latest_checkpoints(spark, state).agg(F.sum("next_byte"), F.count("*")).first()
        if not step(spark, lines, state, max_events, max_bytes, max_event_bytes):
            break
        done += 1
        if latest_checkpoints(spark, state).agg(F.sum("next_byte"), F.count("*")).first() == before:
            break
    return done
