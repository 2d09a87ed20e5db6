"""Documents made ready for training: language, near-duplicates, benchmark passages, mixture, shards.

Each stage takes the rows that the stage before it kept. All but the last return the columns of documents. A row without
doc_id cannot be told from others, so it goes at the second stage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from molframe.llm import decontam, langid, minhash, mixing, sharding
from molframe.llm.common import by_key, cut, parts, release, table, unpacked

#: targets are token shares to this power: near one, so that most documents stay
MIX_POWER = 0.95


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a word in a language that was learned from the labelled ones among them; those without letters go.

    How certain the language is does not matter: a text that switches among several is clean."""
    model = langid.train(docs.filter(~langid.held_out()))
    named = langid.labelled(docs, model)
    return unpacked(named.filter(F.col("lang_pred") != langid.UNKNOWN), docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest doc_id of each group of near copies. Texts are dealt by doc_id once; both joins find them where they lie."""
    docs = by_key(docs.filter("doc_id is not null").repartition(parts(spark), "doc_id"), "doc_id")
    kept = cut(minhash.near_duplicates(docs).filter("kept").select("doc_id").distinct())
    release(spark)
    return docs.join(kept, "doc_id", "left_semi").select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of the benchmark."""
    return decontam.clean(docs, table(spark, sf_dir, "benchmark")).select(*docs.columns)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample whose expected tokens follow flattened shares of sources, languages and topics."""
    return unpacked(mixing.with_draw(docs, MIX_POWER).filter("kept"), docs)


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document's shard and place in it."""
    return sharding.shard(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("mixture", mixture),
    ("shards", shards),
]

#: a fitted model, similarities and raking are not SQL: tests/llm compares run() with a brute-force version
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
        release(spark)
    return STAGES[-1][1](spark, docs, sf_dir)
