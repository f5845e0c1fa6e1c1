"""A corpus pipeline: toxic documents go, one document of each near-duplicate group stays, documents
that contain benchmark items go, sources are mixed to their target weights, and the rest is sharded.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes each stage's result as
Parquet in the shared folder and reads it as the next one's documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parley.llm import decontamination, jaccard_join, mixing, sharding, toxicity
from parley.llm.registry import table, toxicity_model
from parley.llm.scratch import Scratch


#: A column that tells rows apart by id and text, while a stage runs: rows may lack an id or share one.
KEY = "key of id and text"


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.withColumn(KEY, F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.lit(":"), F.coalesce(F.xxhash64("text").cast("string"), F.lit("null"))))


def _near(df: DataFrame, most: int = 1_000_000) -> DataFrame:
    """A broadcast hint for a saved table of keys of some forty bytes, if its size allows it."""
    return F.broadcast(df) if df.count() <= most else df


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that a model trained on the labels does not call toxic. Each row is judged by its text alone, so ids may be null or
    repeated; null and empty texts stay; without labels, or in an empty table, all stay."""
    return toxicity.without_toxic(docs, toxicity_model(docs, table(spark, sf_dir, "labels")))


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by a Jaccard similarity of 0.8 of five-word shingles: the one with the least id, and of rows
    that share that id one. Documents without words are linked with nothing and stay; so do all rows without an id, which no link
    can name. An empty table stays empty."""
    return jaccard_join.one_of_each(docs, n=5, percent=80)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that hold less than 0.8 of every benchmark item's five-word shingles. Rows are judged by their own text, also where they
    lack an id or share one with a contaminated row; equal rows go together. Null and empty texts hold nothing and stay."""
    found = decontamination.contained_items(_keyed(docs), table(spark, sf_dir, "benchmark"), id_col=KEY)
    gone = Scratch(spark).save(found.select(F.col("doc_id").alias("key of what goes")).distinct())
    return _keyed(docs).join(_near(gone), F.col(KEY) == F.col("key of what goes"), "left_anti").drop(KEY)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: its words taken, in whole copies, rounded half up. A document of which less than half is
    taken goes, and so do those without words, of which nothing can be taken. Rows without an id or with one that repeats are documents
    of their own; rows equal in id and text are taken alike. An empty table stays empty."""
    found = mixing.mix_sources(_keyed(docs), carry=(KEY,)).where("size > 0").groupBy(F.col(KEY).alias("taken key")).agg(F.floor(F.max(F.col("taken") / F.col("size")) + 0.5).cast("int").alias("times of it"))
    times = _near(Scratch(spark).save(found.where("`times of it` > 0")))
    copies = F.explode(F.sequence(F.lit(1), F.col("times of it")))
    return _keyed(docs).join(times, F.col(KEY) == F.col("taken key")).select(*[F.col(f"`{c}`") for c in docs.columns], copies.alias("copy of a taken document")).drop("copy of a taken document")


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The shard and slot of every row of the mix, repeated ones too; rows without an id or a text have their place like others. Of equal
    texts, which are neighbours, the ids decide the order. An empty table has no rows."""
    return sharding.shards(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("n-gram Jaccard join", one_of_each_group),
    ("benchmark decontamination", drop_contaminated),
    ("mixing sources to target weights", mix),
    ("sharding", shard),
]

#: The first stage learns a model, which SQL cannot express; tests hold run() against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark)
    docs, before = table(spark, sf_dir, "documents"), None
    for _, stage in STAGES:
        docs = scratch.save(stage(spark, docs, sf_dir))
        if before is not None:
            scratch.drop(before)
        before = docs
    return docs
