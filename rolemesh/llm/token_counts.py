"""Token counts by an exact length histogram.

Documents are counted by encoded length; every question about a context limit is then a suffix or
prefix sum over that histogram, whose size is bounded by the longest document and not by the number
of documents. The sums are taken in two levels (segments of lengths, then inside each segment), so
that no single task holds the whole histogram.

Defined cases: null and empty texts have `end_id` alone (length 1) or no ids (length 0) without
one; repeated rows count each; a very long text is encoded whole and is one length; an empty table gives an empty histogram and
zero totals. Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rolemesh.llm.common import slices, texts, written
from rolemesh.llm.encoding import AT_ONCE, encoder

#: Lengths in a segment.
SEGMENT = 128


def token_lengths(docs: DataFrame, tokenizer_path: str, keeps_spaces: bool, end_id: int | None = None) -> DataFrame:
    """(doc_id, n_tokens) of every whole text."""

    def lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = encoder(tokenizer_path, keeps_spaces, end_id)
        for batch in batches:
            for part in slices(batch, most=AT_ONCE):
                yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.int64()), pa.array(made.ids(texts(part))[0])], names=["doc_id", "n_tokens"])

    return docs.select("doc_id", "text").mapInArrow(lengths, "doc_id long, n_tokens long")


def length_histogram(lengths: DataFrame) -> DataFrame:
    """(length, n_docs): one row for each length that occurs."""
    return lengths.groupBy(F.col("n_tokens").alias("length")).agg(F.count("*").alias("n_docs"))


def limit_curve(histogram: DataFrame) -> DataFrame:
    """For each length L that occurs, as a context limit: n_docs of that length, docs_over (longer than L), tokens_over (theirs),
    kept_tokens (sum of min(length, L)), cut_tokens (lost), cumulative share of documents no longer than L."""
    rows = histogram.withColumn("segment", F.floor(F.col("length") / SEGMENT))
    sums = rows.groupBy("segment").agg(F.sum("n_docs").alias("docs"), F.sum(F.col("n_docs") * F.col("length")).alias("tokens"))
    later = Window.orderBy(F.col("segment").desc()).rowsBetween(Window.unboundedPreceding, -1)
    after = sums.select("segment", *[F.coalesce(F.sum(c).over(later), F.lit(0)).alias(f"{c}_after") for c in ("docs", "tokens")])
    inside = Window.partitionBy("segment").orderBy(F.col("length").desc()).rowsBetween(Window.unboundedPreceding, -1)
    docs, tokens = sums.agg(F.sum("docs"), F.sum("tokens")).first()  # two numbers
    joined = rows.join(after, "segment").withColumns({"all_docs": F.lit(docs or 0), "all_tokens": F.lit(tokens or 0)})
    over = joined.select(
        "length", "n_docs", "all_docs", "all_tokens",
        (F.col("docs_after") + F.coalesce(F.sum("n_docs").over(inside), F.lit(0))).alias("docs_over"),
        (F.col("tokens_after") + F.coalesce(F.sum(F.col("n_docs") * F.col("length")).over(inside), F.lit(0))).alias("tokens_over"),
    )
    kept = F.col("all_tokens") - F.col("tokens_over") + F.col("docs_over") * F.col("length")
    return over.select("length", "n_docs", "docs_over", "tokens_over", kept.alias("kept_tokens"), (F.col("all_tokens") - kept).alias("cut_tokens"), ((F.col("all_docs") - F.col("docs_over")) / F.col("all_docs")).alias("share_within"))


def at_limits(histogram: DataFrame, limits: list[int]) -> DataFrame:
    """Totals at any context limits, in one pass: (context_limit, docs_over, kept_tokens, cut_tokens)."""
    limit = F.explode(F.array(*[F.lit(int(x)) for x in limits]))
    rows = histogram.select("length", "n_docs", limit.alias("context_limit"))
    n, length, most = F.col("n_docs"), F.col("length"), F.col("context_limit")
    return rows.groupBy("context_limit").agg(F.sum(F.when(length > most, n).otherwise(0)).alias("docs_over"), F.sum(n * F.least(length, most)).alias("kept_tokens"), F.sum(n * F.greatest(length - most, F.lit(0))).alias("cut_tokens"))


def quantiles(curve: DataFrame, shares: list[float]) -> DataFrame:
    """(share, length): the smallest length within which at least that share of documents lies."""
    share = F.explode(F.array(*[F.lit(float(x)) for x in shares]))
    return curve.select("length", "share_within", share.alias("share")).where("share_within >= share").groupBy("share").agg(F.min("length").alias("length"))


def op7_token_counts(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return limit_curve(written(length_histogram(token_lengths(docs, public_tokenizers.path("byte_bpe_50k.json"), True)), "length-histogram"))
