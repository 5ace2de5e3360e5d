"""A corpus pipeline: toxicity, line dedup, near-dedup, decontamination, encoding.

Every stage works on all that its predecessor kept and takes (spark, docs,
sf_dir); its result is written as Parquet and read again as the next one's
docs. All but the last return the columns of ``documents``.

Defined results, for every stage: null and empty texts are documents without
words or terms and stay; a null id is an id of its own that no stage links
with another; rows that share an id are judged each by its own text, but for
near-copies, where an id is one document and goes with all its rows; of tied
copies the smallest id stays; an empty table gives an empty table; columns
beyond those of ``documents`` are left out, so none can clash.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pipeweave.llm import bpe, common, decontaminate, line_dedup, near_dedup, toxicity

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score reaches 0.5 go; all stay if the labels that join don't hold both classes."""
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.accepted(docs.select(*COLUMNS), model)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Long lines of three or more documents stay in one of them; n_chars follows the text."""
    out = line_dedup.dedup_lines(docs.select(*COLUMNS))
    return out.select("doc_id", "text", "rest.lang", "rest.source", F.length("text").cast("bigint").alias("n_chars"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays: the smallest id."""
    gone = near_dedup.near_duplicates(docs, words=5).where(~F.col("kept")).select(F.col("doc_id").alias("gone_id")).distinct()
    return docs.select(*COLUMNS).join(gone, F.col("doc_id") == F.col("gone_id"), "left_anti")


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain a benchmark item go."""
    return decontaminate.clean_documents(docs.select(*COLUMNS), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids (packed little-endian unsigned 32-bit) and the text decoded from them."""
    import public_tokenizers

    out = bpe.round_trip(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    return out.select("doc_id", "n_tokens", "ids", F.decode("decoded", "UTF-8").alias("text"))


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_lines),
    ("minhash_near_dedup", drop_near_copies),
    ("benchmark_decontamination", drop_leaks),
    ("byte_level_bpe", encode),
]

#: No SQL: the toxicity and encoding stages can't be expressed in it.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = common.table(stage(spark, docs, sf_dir), f"stage-{name}")
    return common.table(STAGES[-1][1](spark, docs, sf_dir), f"stage-{STAGES[-1][0]}")
