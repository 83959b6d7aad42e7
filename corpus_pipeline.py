"""Documents to token ids in five stages: language, near-duplicates, repeated passages, mixture, tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.llm import bpe, common, language, mixing, neardup, queries, repeats

#: Bytes of a passage that may not be there twice. Of runs of 51 words of the test documents 99.5 % are longer.
PASSAGE = 200


def by_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Leaves out documents of no language: null texts and those without a letter. Whatever the score, the rest stays."""
    found = language.identify(docs, language.train(language.sample(docs)))
    return found.filter(F.col("lang_pred") != language.UNKNOWN).select(*docs.columns)


def one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of copies and near copies (SimHash links and what a prefix filter adds, all verified), the document with
    the smallest doc_id."""
    return neardup.representatives(docs)


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts passages that are there more than once; a document of which nothing is left goes."""
    return repeats.cleaned(docs, PASSAGE)


def in_mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, in files and rows in the order of the mixture."""
    shares = mixing.tempered(docs.groupBy("source").agg(F.count("*").alias("n")))
    return mixing.arranged(docs, shares)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, with digests of the ids and of the text decoded from them."""
    return bpe.encoded(docs, queries.vocabulary("byte_bpe_50k.json"))


STAGES = [("language", by_language), ("near_duplicates", one_of_near_copies), ("repeated_passages", without_repeats), ("mixture", in_mixture), ("tokens", tokens)]

#: SQL can't express the stages' models, hashes and automata; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each one's rows written to the shared folder and read again."""
    docs = common.table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs, _ = common.written(docs, name)
    return docs
