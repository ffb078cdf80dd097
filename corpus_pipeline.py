"""A corpus pipeline: quality rules, line dedup, near-duplicates, decontamination and token ids, stage after stage.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written and read again as the next one's docs.
All but the last keep the columns of `documents`, also those that a caller adds, whatever their names. run() does all of
them, with a table in the shared folder between, which goes once the next one is written. An empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import decontaminate, line_dedup, near_dedup, quality, sentencepiece_codec
from tessera.llm._common import removed, table, written
from tessera.llm.queries import PIECES, vocabulary


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep. A null or empty text has no words and goes; rows that repeat and null ids
    are judged row by row; a null lang, or one without a reference, leaves the base rules only."""
    return quality.keep_good(docs)


def deduped_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without recurring lines; a document that had words and has none left goes; n_chars follows the text. Null and
    empty texts stay; rows that repeat id and text are one document and lose the same lines."""
    prefix = "line_dedup"
    while any(c.startswith(prefix) for c in docs.columns):
        prefix += "_"
    found = line_dedup.dedup(docs, prefix=prefix)
    dropped = F.col(f"{prefix}_n_dropped") > 0
    found = found.where(~dropped | F.rlike("text", F.lit(r"[^ \t-\r]")))
    if "n_chars" in docs.columns:
        n_chars = F.when(dropped, F.length("text")).otherwise(F.col("n_chars"))
        found = found.withColumn("n_chars", n_chars.cast(docs.schema["n_chars"].dataType))
    return found.select(*docs.columns)


def distinct_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five words, similarity 0.8): that of the smallest doc_id, null ids
    last. A row is meant by its id and text: of rows that repeat both one stays, and a repeated id doesn't take another
    text with it. Texts without words stay."""
    return near_dedup.keep_one(docs)


def clean_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark items, judged by their text alone: null texts, null ids and rows that repeat stay or go
    as each text does."""
    return decontaminate.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Digests and counts of each document's token ids and decoded text, a row for each row; a null text is an empty one."""
    return sentencepiece_codec.encode(docs, vocabulary(PIECES))


STAGES = [
    ("quality rules", good_documents),
    ("line dedup", deduped_lines),
    ("minhash near-dedup", distinct_documents),
    ("benchmark decontamination", clean_documents),
    ("sentencepiece codec", token_ids),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = None
    for k, (_, stage) in enumerate(STAGES):
        found = stage(spark, docs, sf_dir)
        if k == len(STAGES) - 1:
            return found
        docs = written(found, f"stage{k}")
        if held is not None:
            removed(held)
        held = docs
