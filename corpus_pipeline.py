"""documents -> quality rules -> SimHash near-dedup (five-word shingles, Jaccard 0.8) -> substring dedup -> benchmark decontamination -> BPE ids.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept, and returns the columns of documents,
but for the last, which returns the ids. In every stage a null text counts as empty, repeated rows are rows of their own,
extra columns are carried and may have any name, and an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm.bpe import bpe_digests
from palimpsest.llm.common import materialise, table
from palimpsest.llm.decontam import contamination
from palimpsest.llm.quality import quality_filter
from palimpsest.llm.queries import tokenizer_path
from palimpsest.llm.simhash import simhash_dedup
from palimpsest.llm.substring_dedup import substring_dedup


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go; null and empty texts fail the base rules; equal texts of a language share their fate."""
    return quality_filter(docs, table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near copies the document with the smallest id stays (null ids last; of equal ids any one); texts without words are one component."""
    return simhash_dedup(docs, shingle=5, similarity=0.8)


def shared_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 35 words or more that are in two places go from both; n_chars follows; a text that loses all its words stays, empty."""
    kept = substring_dedup(docs)
    return kept.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a window of a benchmark item go; an empty benchmark or a text without words lets all stay."""
    found = contamination(docs, table(spark, sf_dir, "benchmark"))
    return found.filter(~F.col(found.columns[-1])).select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, token_ids, n_tokens and the digests of ids and decoded text; an empty text has no tokens."""
    return bpe_digests(docs, tokenizer_path(), ids=True)


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("shared_passages", shared_passages), ("decontaminate", decontaminate), ("encode", encode)]

#: SQL has no MinHash and no BPE; tests/llm holds run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        kept = stage(spark, docs, sf_dir)
        # a stage's table goes as soon as the next one is written
        docs = materialise(kept, f"stage-{name}", docs) if i + 1 < len(STAGES) else kept
    return docs
