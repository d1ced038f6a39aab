"""A corpus from raw documents to packed training sequences, as stages that are each stored and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from questmill.llm import langid, pii
from questmill.llm.langid import with_language
from questmill.llm.near_dup import without_near_copies
from questmill.llm.packing import pack_documents
from questmill.llm.quality import with_quality
from questmill.llm.shared import columns_of, fresh_name, stash, vocabulary

#: A document leaves when no language has this share of its words; text that mixes two languages stays.
LEAST_SHARE = 0.4


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the likelihood ratio. Null and empty texts go; rows are judged one by one, repeats alike;
    columns of any name and type pass through; an empty table stays empty."""
    name = fresh_name("__quality", docs.columns)
    judged = with_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), name=name)
    return judged.where(F.col(name)["kept"]).select(*columns_of(docs))


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a learned language that at least two words in five belong to. Texts without a letter go, as do all where no row is
    labelled; rows are judged one by one; columns of any name and type pass through."""
    lang, share = fresh_name("__lang", docs.columns), fresh_name("__share", docs.columns)
    judged = with_language(docs, langid.fit(docs), names=(lang, share))
    return judged.where((F.col(lang) != "und") & (F.col(share) >= LEAST_SHARE)).select(*columns_of(docs))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The row with the smallest id of each group of near-copies (similarity 0.8 or more of five-word shingles); different texts under
    one id are different rows, rows that repeat id and text stay once, and every row without an id stays. Null and empty texts are no
    copies of one another. Columns of any name and type pass through."""
    return without_near_copies(docs).select(*columns_of(docs))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data replaced by its kind; character counts follow. Null texts stay null; rows and other columns as they are."""
    return pii.redact_documents(docs, pii.fit(docs)).withColumn("n_chars", F.length("text").cast("long")).select(*columns_of(docs))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of at most 4096 tokens; a null or empty text is one piece of the end id alone."""
    return pack_documents(docs, vocabulary("word_bpe_49k.json"))


STAGES = [
    ("quality rules", quality_rules),
    ("language ID", language_id),
    ("MinHash near-dedup", near_dedup),
    ("PII", personal_data),
    ("packing", packing),
]
#: Language model, PII model and tokenizer have no SQL form; tests hold the run against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = stash(docs)
    return docs
