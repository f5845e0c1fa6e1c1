"""The queries of the ten corpus operators and, where SQL can express them, their oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parley.llm import decontamination, fill_in_middle, html, jaccard_join, language, licenses, line_dedup, mixing, neighbours, sharding, token_alignment, toxicity, url_filter

QUERIES: dict = {}
ORACLES: dict = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(id_col: str = "doc_id"):
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0


@query
def op1_language(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    found = language.identify(docs, language.learn(docs.where(~held_out())))
    return found.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "lang_pred", "score", F.to_json("mixture").alias("mixture"))


@query
def op2_nearest_neighbours(spark, sf_dir):
    return neighbours.nearest(table(spark, sf_dir, "embeddings"))


@query
def op3_decontamination(spark, sf_dir):
    return decontamination.contained_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


ORACLES["op3_decontamination"] = decontamination.ORACLE_SQL


@query
def op4_source_mix(spark, sf_dir):
    return mixing.mix_sources(table(spark, sf_dir, "documents"))


@query
def op5_jaccard_join(spark, sf_dir):
    return jaccard_join.jaccard_components(table(spark, sf_dir, "documents"), n=3, percent=90)


ORACLES["op5_jaccard_join"] = jaccard_join.oracle_sql(3, 90)


def toxicity_model(docs: DataFrame, labels: DataFrame):
    """The model learned from the labels of documents that are not held out; an id that repeats in
    the labels counts once, as toxic if any of its labels is."""
    known = labels.where(~held_out()).groupBy("doc_id").agg(F.max("toxic").alias("label"))
    return toxicity.learn(docs.select("doc_id", "text").join(known, "doc_id"), label_col="label")


@query
def op6_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    found = toxicity.score(docs, toxicity_model(docs, table(spark, sf_dir, "labels")))
    return found.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


@query
def op7_html_extraction(spark, sf_dir):
    return html.extract(table(spark, sf_dir, "pages")).withColumn("n_chars", F.char_length("text").cast("long"))


@query
def op8_license_scan(spark, sf_dir):
    return licenses.scan(table(spark, sf_dir, "documents"))


@query
def op9_sharding(spark, sf_dir):
    return sharding.shards(table(spark, sf_dir, "documents"))


@query
def op10_line_dedup(spark, sf_dir):
    return line_dedup.fuzzy_lines(table(spark, sf_dir, "documents"))


@query
def op11_url_filter(spark, sf_dir):
    return url_filter.judge(table(spark, sf_dir, "pages"), url_filter.learn(url_filter.labelled(spark)))


@query
def op12_fill_in_middle(spark, sf_dir):
    found = fill_in_middle.fill_in_middle(table(spark, sf_dir, "documents"))
    sha = lambda text: F.sha2(text.cast("binary"), 256)
    return found.select("doc_id", "n", "form", "prefix_chars", "middle_chars", sha(F.col("output")).alias("output_sha256"), sha(fill_in_middle.restored(F.col("output"), F.col("form"))).alias("restored_sha256"))


ORACLES["op12_fill_in_middle"] = fill_in_middle.ORACLE_SQL


@query
def op13_token_alignment(spark, sf_dir):
    return token_alignment.align(table(spark, sf_dir, "documents"))
