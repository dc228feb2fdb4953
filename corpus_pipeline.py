"""From raw documents to packed training sequences: a stage for each of five operators.

Each stage's result is written as Parquet in the shared folder and read again as the next one's input,
so no stage is computed twice and a lost executor costs its own tasks only.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import shared_folder, table
from tessera.llm.dedup import without_repeats
from tessera.llm.jaccard import keep_one
from tessera.llm.packing import pack
from tessera.llm.pii import redact
from tessera.llm.quality import keep_good

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def counted(docs: DataFrame) -> DataFrame:
    """The columns of documents, n_chars as the text is now."""
    return docs.withColumn("n_chars", F.char_length("text").cast("long")).select(*COLUMNS)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a rule rejects go."""
    return keep_good(docs.select(*COLUMNS))


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, the one with the smallest id."""
    return keep_one(docs.select(*COLUMNS)).select(*COLUMNS)


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 200 bytes or more that stand elsewhere too go; the documents stay."""
    return counted(without_repeats(docs.select(*COLUMNS)))


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind."""
    return counted(redact(docs.select(*COLUMNS)))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the sequences of 2048 ids."""
    import public_tokenizers

    pieces = pack(docs, public_tokenizers.path("byte_bpe_50k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [("quality_rules", quality_rules), ("jaccard_join", jaccard_join), ("suffix_dedup", suffix_dedup), ("pii", pii), ("packing", packing)]

#: Iterative stages and tokenizers have no SQL; tests compare with plain Python versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage."""
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{i}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
