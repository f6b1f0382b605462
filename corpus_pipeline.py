"""A corpus pipeline: the stages that documents pass through, in order.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; what it returns is
written as Parquet and read again as the next one's docs.  All but the last return
the columns of documents.  Nulls, empty tables, repeated rows and extra columns are
handled as the operators' modules say.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomdex.llm import common, decontamination, language_id, minhash_dedup, source_mixing, substring_dedup


def keep_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a recognised language; null, letterless and unrecognisable texts go.

    From here on a document's lang is the language identified, whatever it said before.

    Learned from all rows with a language, so that every document is judged by profiles of all.
    A text is recognised by the trigrams that are common in a language: the best language's
    score is never low enough to tell junk from text.
    """
    model = language_id.learn(docs)
    common_ = language_id.common_grams(docs)
    own = common.set_aside(docs, F.col("text"))
    known = language_id.recognise(own, common_, language_id.bounds(docs, common_))
    found = language_id.identify(known, model).filter(F.col("lang_pred") != language_id.UNKNOWN)
    return common.put_back(found, [], {"lang": F.col("lang_pred").cast(docs.schema["lang"].dataType)})


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by five-word shingle sets of similarity 0.8 and more."""
    return minhash_dedup.keep_one(docs)


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 35 words and more that occur elsewhere are cut; documents left without a word go."""
    own = common.set_aside(docs, F.col("text"), F.col("doc_id"))
    cut = substring_dedup.dedup_substrings(own).filter("n_words = 0 or n_removed < n_words")
    changed = {"text": F.col("text"), "n_chars": F.length("text").cast(docs.schema["n_chars"].dataType)} if "n_chars" in docs.columns else {"text": F.col("text")}
    return common.put_back(cut, [], changed)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which a benchmark item was found go."""
    return decontamination.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How often the mix takes each document (copies), the words that makes and its language; documents not taken go."""
    mixed = source_mixing.mix(docs, keep=("lang",))
    return mixed.filter("copies > 0").select(F.col("id").alias("doc_id"), "source", "size", "target", "copies", "taken", "_kept.lang")


STAGES = [
    ("language ID", keep_languages),
    ("MinHash near-dedup", drop_near_duplicates),
    ("substring dedup", cut_repeated_passages),
    ("benchmark decontamination", drop_benchmark_leaks),
    ("mixing sources", mix_sources),
]

#: Models and repeated passages are beyond SQL; tests/llm compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what each returns is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = common.stored(docs)
    return docs
