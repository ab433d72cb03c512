"""A corpus pipeline: five stages over documents, each written as Parquet and read again by the next.

Each stage is (spark, docs, sf_dir) -> DataFrame over all rows it is given; all but the last return the columns
of documents, ``doc_id, text, lang, source, n_chars``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ferrule.llm import bpe, common, jaccard_join, language_id, line_dedup, mixing

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which a language is recognised; lang is what was predicted.

    Null and empty texts, and texts without a letter, go; repeated rows and null ids stay; an empty table, or one
    without any labelled text, gives an empty one.
    """
    found = language_id.language_id(docs, language_id.fit(docs), carry=("source", "n_chars", "text"))
    return found.where("lang_pred <> 'und'").select("doc_id", "text", F.col("lang_pred").alias("lang"), "source", "n_chars")


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Deletes aligned blocks from later documents; a document that loses all its words goes.

    Documents that lose nothing stay as they are, null and empty texts too; of repeated rows the first stays;
    n_chars is counted anew where lines go; an empty table gives an empty one.
    """
    out = line_dedup.line_dedup(docs, carry=("lang", "source", "n_chars"))
    return out.where("n_removed = 0 OR n_words_left > 0").select("doc_id", "text", "lang", "source", F.when(F.col("n_removed") > 0, F.length("text")).otherwise(F.col("n_chars")).cast("long").alias("n_chars"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies one row stays, that with the least id, null last; five words, similarity 0.8.

    Texts without words are no copies of anything and stay, null ones too; rows count as rows, whatever ids they
    repeat; an empty table gives an empty one.
    """
    return jaccard_join.distinct_documents(docs, width=5, percent=80, carry=("lang", "source", "n_chars")).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: whole, and once more if a part is taken.

    Texts without words have no size and are not taken, null ones neither; a null source is a source; rows count
    as rows, whatever ids they repeat; an empty table gives an empty one.
    """
    return mixing.mixed_documents(docs).select(*COLUMNS)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, and the digest of what they decode to.

    Null text counts as empty and has no tokens; each row is encoded by itself; an empty table gives an empty one.
    """
    ranks, pattern = public_tokenizers.path(bpe.DEFAULT_RANKS), public_tokenizers.PATTERN
    done = bpe.bpe_encode(docs, ranks, pattern, check=True)
    return done.select("doc_id", "source", "lang", F.size("token_ids").cast("long").alias("n_tokens"), "token_ids", "decoded_sha256")


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", dedup_lines),
    ("near_copies", drop_near_copies),
    ("mix_sources", mix_sources),
    ("tokenize", tokenize),
]

#: Suffix automata, patience diff and the tokenizer are beyond SQL; the tests run the stages one by one and compare.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir, each written and read again; a table goes when the next one stands."""
    with common.Scratch(spark) as s:
        docs, last = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
        for name, stage in STAGES[:-1]:
            docs = s.table(stage(spark, docs, sf_dir), f"pipeline-{name}")
            if last is not None:
                s.drop(last)
            last = docs
        return s.result(STAGES[-1][1](spark, docs, sf_dir))
