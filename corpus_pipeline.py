"""From raw documents to packed sequences: five stages, each written as Parquet and read again by the next.

Defined cases, for every stage: a null text counts as empty and stays null until it is packed (the quality rules reject both, so that none gets
further when the stages run in order); null languages, sources and ids are values as any other; repeated rows are judged and placed one by one, and
of near-duplicates, repeated rows included, one row stays; a very long text is worked on whole in every stage; an empty table gives an empty
result of the same columns; extra columns, whatever their names, go with their rows up to the last stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rolemesh.llm import jaccard_join, mixing, packing, quality_rules, secret_scans
from rolemesh.llm.common import stage, written


@stage(first=True)
def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality policy in production keeps."""
    return quality_rules.filtered(docs, quality_rules.POLICY)


@stage
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: five-word shingles, similarity 0.8 or more."""
    return jaccard_join.deduplicated(docs, n_words=5, percent=80)


@stage
def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, with the secrets found in it replaced by a mark."""
    return secret_scans.redacted(docs, written(secret_scans.scan(docs), "secret-ledger"))


@stage
def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, in files that hold the sources mixed to their target weights."""
    return mixing.mixed(docs, mixing.WEIGHTS, mixing.BLOCK_CHARS, apart=True)


@stage
def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of packed sequences, in the order of the mix: doc_id, start, length, doc_tokens, sequence_id, offset, ids."""
    import public_tokenizers

    name = F.col("_metadata.file_name")
    numbered = F.concat(F.lpad(F.regexp_extract(name, "^part-([0-9]+)", 1), 20, "0"), name)  # so that part-100000 follows part-99999
    ordered = docs.select("doc_id", "text", numbered.alias("file"), F.col("_metadata.row_index").alias("row"))
    return packing.pack(ordered, public_tokenizers.path("word_bpe_49k.json"), order=("file", "row"))


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("secrets", secrets), ("mix", mix), ("pack", pack)]
#: Tokenizer ids have no SQL; the stages' operators have their own tests in tests/llm.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, f"stage-{name}")
    return docs
