"""A corpus pipeline over `documents`: language, quality, near-duplicates, benchmark leaks, tokens.

Each stage takes (spark, docs, sf_dir) and works on all that the one before it kept. All but the last
return rows with the columns of documents; the last returns the encoded texts.

Defined cases, beside those of the operators: a null, empty or wordless text goes (language_id: it has no
letter); of repeated rows one stays (simhash_dedup), a null id among them last; columns beyond those of
documents are kept by all stages but the last, whatever they are called; a document that decontamination
leaves without text goes; an empty table passes through all stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from winnowlake.llm import decontaminate, langid, piece_bpe, quality_rules, simhash
from winnowlake.llm.common import discard, materialise, table


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows go whose text has no letter, whose language is not told with a score of 1/2 or more, or that
    fit no learned language. All labelled rows count: two folds of three are learned from, and how well
    texts fit their language is taken from the third."""
    unigrams = langid.fit(docs, ~langid.held_out())
    return langid.accepted(docs, unigrams, within=langid.bounds(docs, unigrams, langid.held_out()))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows go that fail the base rule or the calibrated regression."""
    return quality_rules.judged(docs, quality_rules.fit(docs, table(spark, sf_dir, "labels")), keep_columns=True)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The row with the smallest id of each group of near-duplicates stays."""
    return simhash.deduplicated(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark passages are taken out of the texts; rows that are half benchmark go."""
    return decontaminate.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of every text, their number, and digests of the ids and of the text decoded from them."""
    return piece_bpe.encoded(docs, columns=("n_tokens", "ids_sha256", "decoded_sha256", "ids"))


STAGES = [
    ("language_id", language_id),
    ("quality_rules", quality),
    ("simhash_dedup", near_dedup),
    ("decontamination", decontamination),
    ("sentencepiece", sentencepiece),
]

#: SQL can't express the stages; tests compare them with plain loops.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        before, docs = docs, stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialise(docs, f"pipeline-{name}")
            discard(before)  # the stage is written; the documents themselves are no such table
    return docs
