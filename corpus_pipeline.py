"""A corpus pipeline of five operators; each stage's output is written as Parquet and read back as the next one's input.

Every stage takes documents with null ids, texts, languages or sources, empty texts, repeated rows and further columns, and
an empty table gives an empty result. Null and empty texts are kept by the quality classifier, are linked with nothing,
hold no secrets, take part in the mix with size 0, and have null or no pieces.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from cellatlas.llm import common, jaccard, mixing, quality, secrets, sentencepiece_codec

#: Scratch tables behind the result of the stage before, which its reader has written by the time the next one begins.
_left: set[str] = set()


def _stage(f: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    """Deletes what the stage before has left, and notes what this one leaves; tables of anything else stay."""

    @wraps(f)
    def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        _done(spark)
        before = common.scratch_paths()
        out = f(spark, docs, sf_dir)
        _left.update(common.scratch_paths() - before)
        return out

    return stage


def _done(spark: SparkSession) -> None:
    common.release_paths(spark, _left)
    _left.clear()


@_stage
def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    return quality.keep_good(docs, common.table(spark, sf_dir, "labels"))


@_stage
def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of similar documents stays."""
    return jaccard.one_of_each(docs)


@_stage
def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in the texts are replaced by a mark."""
    return secrets.redact(docs, secrets.train(), path_col="source")


@_stage
def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources are mixed to their target weights: documents are repeated or left out."""
    return mixing.mixed(docs)


@_stage
def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """SentencePiece ids of every document."""
    return sentencepiece_codec.encode(docs, sentencepiece_codec.load())


STAGES = [
    ("quality", good_quality),
    ("near copies", without_near_copies),
    ("secrets", without_secrets),
    ("mixing", mixed),
    ("sentencepiece", tokens),
]

#: No SQL: the stages learn models and segment by Viterbi; the tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. Of the tables that are written on the way, only the one behind this result stays."""
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        kept = common.stored(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
        _done(spark)
        if name != STAGES[0][0]:
            common.release(docs)
        docs = kept
    return docs
