"""What the operators of this subpackage share: scratch tables, Arrow batches and bounded broadcasts."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Ids up to this many may be broadcast (8 bytes each); beyond it a shuffled join is used.
BROADCAST_IDS = 500_000
#: While a scratch table is written: Spark deletes the shuffle files of a query as soon as it ends, instead of when the
#: driver next collects garbage, and hands Python this many rows at a time.
MEANWHILE = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxRecordsPerBatch": "1000"}


def scratch_root(spark: SparkSession) -> str:
    """The shared folder for scratch tables: spark.checkpoint.dir, or a folder of our own in local mode only."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="quarry-scratch-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{scratch_root(spark)}/quarry/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared scratch folder and read it again, which cuts its lineage.

    Once the table is complete nothing reads the shuffles behind it any more, so their files go at once. Arrow batches
    are small meanwhile. The session's settings are as before afterwards.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    before = {k: spark.conf.get(k, None) for k in MEANWHILE}
    try:
        for k, v in MEANWHILE.items():
            spark.conf.set(k, v)
        df.write.option("compression", "zstd").parquet(path)
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)
    out = spark.read.schema(df.schema).parquet(path)
    out._quarry_path = path
    return out


def discard(df: DataFrame) -> None:
    """Delete a table of ``materialize`` that nothing will read any more."""
    path = getattr(df, "_quarry_path", None)
    if path:
        jvm = df.sparkSession._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(target, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(batches: Iterator[pa.RecordBatch], rows: int = 1000) -> Iterator[pa.RecordBatch]:
    """The batches in parts of at most so many rows, so that what is made of one stays small. Spark bounds their bytes."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def few_ids(ids: DataFrame) -> DataFrame:
    """Mark a table of ids for broadcast if it is checked to be small; otherwise leave the join to Spark."""
    n = ids.limit(BROADCAST_IDS + 1).count()
    return F.broadcast(ids) if n <= BROADCAST_IDS else ids


def keyed_runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Rows of a partition sorted by ``keys``, as one table per key."""
    held: list[pa.Table] = []
    last = None
    for batch in batches:
        if batch.num_rows == 0:
            continue
        whole = pa.Table.from_batches([batch])
        cols = [whole.column(k).to_pylist() for k in keys]
        start = 0
        here = list(zip(*cols, strict=True))
        for i, key in enumerate(here):
            if key != last:
                if i > start:
                    held.append(whole.slice(start, i - start))
                if held:
                    yield pa.concat_tables(held)
                held, start, last = [], i, key
        held.append(whole.slice(start))
    if held:
        yield pa.concat_tables(held)
