"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import jaccard, langid, mixing, neighbours, ogg, quality, secrets, sentencepiece_codec, toxicity, urlfilter
from .common import held_out, table


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = toxicity.score(docs, toxicity.learn(docs, table(spark, sf_dir, "labels")))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "hits", "words")


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(table(spark, sf_dir, "documents"), secrets.train(), path_col="source")
    real = F.filter("findings", lambda x: x["secret"])
    spans = F.array_join(F.transform(real, lambda x: F.concat_ws("-", x["start"], x["end"])), ",")
    return found.select("doc_id", F.size("findings").alias("n_candidates"), F.size(real).alias("n_secrets"), spans.alias("secret_spans"), F.array_max(F.transform("findings", lambda x: x["score"])).alias("max_score"))


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.similar_components(table(spark, sf_dir, "documents"))


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.query(spark, sf_dir)


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = langid.identify(docs, langid.train(docs))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op7_ogg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ogg.probe(ogg.media(table(spark, sf_dir, "documents"))).drop("error")


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_codec.encode(table(spark, sf_dir, "documents"), sentencepiece_codec.load())


def op10_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return neighbours.nearest(vectors, vectors.where("vec_id % 50 = 0"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_quality, op2_toxicity, op3_secrets, op4_jaccard_join, op5_url_filter, op6_language, op7_ogg, op8_mixing, op9_sentencepiece, op10_neighbours)
}

ORACLE_SQL = {"op5_url_filter": urlfilter.ORACLE, "op8_mixing": mixing.ORACLE}
