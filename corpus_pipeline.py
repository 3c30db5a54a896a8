"""The corpus pipeline: quality, near duplicates, repeated strings, mixing and encoding, one after the other.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again for the next
one. All but the last return the columns of documents.

Defined results: a null text counts as empty, and stays unless its score rejects it; very long texts are judged and cut
whole; rows are documents, also those that repeat a doc_id or have none: of equal rows, and of rows in one group of near
duplicates, one stays, that with the smallest doc_id (null after all others; ties by a hash of the text); similarities,
scores and posteriors at a threshold are kept, linked or clean; an empty table gives an empty table; further columns are
kept as they are, whatever their names. Where labels are missing nothing is rejected.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import bpe, mixing, ngram_join, quality, suffix_dedup
from quarry.llm.common import few_ids, materialize, table
from quarry.llm.queries import tokenizer

#: Weights of the domains after mixing: clean documents of good quality take it all.
WEIGHTS = {"good": 1.0, "good_toxic": 0.0, "low": 0.0, "low_toxic": 0.0}


def unused(name: str, docs: DataFrame) -> str:
    """A column name that ``docs`` does not have."""
    while name in docs.columns:
        name += "_"
    return name


def classify_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the rule ensemble rejects. Without labels nothing is rejected."""
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    name = unused("_score", docs)
    return quality.score(docs, model, name).filter(F.col(name) >= 0.3).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group of documents whose five-word shingles are 0.8 alike or more: that of the smallest doc_id."""
    groups = materialize(ngram_join.join_groups(docs, width=5, num=80, den=100), "groups")
    linked = groups.filter("n_shingles > 0")
    gone = linked.filter("doc_id <> component_id").select("doc_id").distinct()
    told = groups.groupBy("doc_id").count().agg(F.count_if(F.expr("count > 1 or doc_id is null"))).first()[0]
    if not told:
        return docs.join(few_ids(gone), "doc_id", "left_anti").select(*docs.columns)
    # Ids do not tell these rows apart, so their texts do too.
    key, mark = unused("_id", docs), unused("_text", docs)
    order = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "text_hash")
    stays = linked.groupBy("group").agg(F.min(order).alias("x")).select(F.col("x.doc_id").alias(key), F.col("x.text_hash").alias(mark))
    blank = groups.filter("n_shingles = 0").select(F.col("doc_id").alias(key), F.col("text_hash").alias(mark))
    wanted = stays.unionByName(blank).select(F.coalesce(key, F.lit(-1)).alias(key), F.col(key).isNull().alias(f"{key}null"), mark).distinct()
    rows = docs.withColumn(key, F.coalesce("doc_id", F.lit(-1)).cast("long")).withColumn(f"{key}null", F.col("doc_id").isNull()).withColumn(mark, F.xxhash64(F.col("text").cast("string")))
    names = [key, f"{key}null", mark]
    return rows.join(wanted, names, "left_semi").dropDuplicates(names).select(*docs.columns)


def drop_repeated_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts every byte that a repeated string of PASSAGE bytes covers; documents of which nothing is left go.

    Any passage of over 50 words is longer than that, so all of it goes.
    """
    other = tuple(c for c in docs.columns if c not in ("doc_id", "text"))
    cut = suffix_dedup.dedup(docs.toDF(*[c if c in ("doc_id", "text") else f"other_{i}" for i, c in enumerate(docs.columns)]), span=suffix_dedup.PASSAGE, keep_text=True, carry=tuple(f"other_{i}" for i, c in enumerate(docs.columns) if c in other))
    left = cut.filter((F.col("n_removed") == 0) | (F.length(F.trim("kept")) > 0))
    # A text that is not cut stays as it is, null too.
    made = {"doc_id": F.col("doc_id").cast(docs.schema["doc_id"].dataType), "text": F.when(F.col("n_removed") == 0, F.col("text")).otherwise(F.col("kept"))}
    n_chars = F.when(F.col("n_removed") == 0, F.col(f"other_{docs.columns.index('n_chars')}")).otherwise(F.length("kept")) if "n_chars" in docs.columns else None
    made |= {"n_chars": n_chars.cast(docs.schema["n_chars"].dataType)} if n_chars is not None else {}
    # Written here, whole texts go to Python in small batches; what reads this again does not cut them anew.
    return materialize(left.select(*[made.get(c, F.col(f"other_{i}")).alias(c) for i, c in enumerate(docs.columns)]), "cut")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that are toxic rather than not, and repeats others towards the weights; a copy is a repeated row.

    Soft posteriors do not allow weights of 0, so the rates alone would drop clean documents and keep toxic ones. Toxic
    documents go by their posterior instead, and every other one stays at least once: low ones were judged by stage 1.
    """
    toxic = F.col("p_good_toxic") + F.col("p_low_toxic") > 0.5
    rate = F.when(toxic, 0.0).otherwise(F.greatest(F.col("rate"), F.lit(1.0)))
    key, copies, copy = unused("_key", docs), unused("_copies", docs), unused("_copy", docs)
    own = F.xxhash64("doc_id", "text")
    rates = mixing.mix(docs, table(spark, sf_dir, "labels"), WEIGHTS, key=own).select(F.col("doc_id").alias(key), mixing.copies(rate, F.col("doc_id")).alias(copies))
    # Most documents keep one row, so only the others' keys are joined.
    odd = rates.filter(F.col(copies) != 1).dropDuplicates([key])
    small = odd.limit(500_001).count() <= 500_000
    joined = docs.withColumn(key, own).join(F.broadcast(odd) if small else odd, key, "left").withColumn(copies, F.coalesce(copies, F.lit(1)))
    return joined.filter(F.col(copies) > 0).withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(copies)))).select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of each document, packed as little-endian unsigned 32-bit integers, with their number and digests."""
    return materialize(bpe.encode_documents(docs, tokenizer("word_bpe_49k.json"), keep_ids=True).drop("decoded"), "encoded")


STAGES = [
    ("quality", classify_quality),
    ("near_duplicates", drop_near_duplicates),
    ("repeated_strings", drop_repeated_strings),
    ("mixing", mix_sources),
    ("encoding", encode),
]

#: The stages are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
