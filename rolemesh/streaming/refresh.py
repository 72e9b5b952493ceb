"""Tables brought up to date by micro-batches that read and write only what they touch.

The state is dealt into buckets by its key. A batch reads the last version of the buckets that its rows fall into, and writes these under its own number; a
list of which batch wrote which bucket says what is current. A batch that is repeated finds the same versions and writes the same again; buckets that no row
falls into are neither read nor written.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rolemesh.operators import embedtext, review
from rolemesh.sources.tables import upserted


def bucket_of(key: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def _put(spark: SparkSession, rows: DataFrame, touched: list[int], folder: str, number: int) -> None:
    """Write a version of the touched buckets (empty ones too: the list has them), then the list."""
    rows.write.mode("overwrite").partitionBy("bucket").parquet(f"{folder}/state/batch={number}")
    spark.createDataFrame([(b,) for b in touched], "bucket int").coalesce(1).write.mode("overwrite").parquet(f"{folder}/written/batch={number}")


def state(spark: SparkSession, folder: str, like: DataFrame, before: int | None = None, buckets: list[int] | None = None) -> DataFrame:
    """The rows of the last version of each bucket (of those given), with the columns of `like`; before: as it was before the batch of that number."""
    seen = spark.read.parquet(f"{folder}/written")
    if before is not None:
        seen = seen.where(F.col("batch") < before)
    if buckets is not None:
        seen = seen.where(F.col("bucket").isin(buckets))
    last = [f"{r.batch}/{r.bucket}" for r in seen.groupBy("bucket").agg(F.max("batch").alias("batch")).collect()]  # one for each bucket
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in like.schema)
    rows = spark.read.schema(f"{columns}, batch long, bucket int").parquet(f"{folder}/state")
    return rows.where(F.concat_ws("/", "batch", "bucket").isin(last)).select(*like.columns)  # a filter on folders: others aren't read


def kept_current(stream: DataFrame, begin: DataFrame, step: Callable[[DataFrame, DataFrame], DataFrame], folder: str, key: str, buckets: int = 64, keyed: Callable[[DataFrame], DataFrame] = lambda batch: batch) -> None:
    """Run step(rows of the state, batch) -> rows over all of the stream that is there. begin is the first state; keyed gives a batch the key of the state if its rows don't have it.

    step sees all rows of the state whose key is in the batch (and those that share their buckets), and must keep what it doesn't change.
    """
    spark = stream.sparkSession
    _put(spark, begin.withColumn("bucket", bucket_of(key, buckets)), list(range(buckets)), folder, -1)

    def one(batch: DataFrame, number: int) -> None:
        rows = keyed(batch).persist()
        touched = [r.b for r in rows.select(bucket_of(key, buckets).alias("b")).distinct().collect()]  # buckets at most
        if touched:
            after = step(state(spark, folder, begin, number, touched), rows).select(*begin.columns)
            _put(spark, after.withColumn("bucket", bucket_of(key, buckets)), touched, folder, number)
        rows.unpersist()

    query = stream.writeStream.foreachBatch(one).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()


def to_match_again(asked: DataFrame, before: DataFrame, after: DataFrame, changed: DataFrame) -> DataFrame:
    """The asks (see `funnel.asked_of`) of roles that a change of candidates may concern: those whose skill one of the changed (candidate_id) held before or holds now. No other role's run can come out differently."""
    held = before.select("skill", "candidate_id").unionByName(after.select("skill", "candidate_id")).join(changed.select("candidate_id").distinct(), "candidate_id", "left_semi")
    return asked.join(held.select("skill").distinct(), "skill", "left_semi")


def rematched(runs: DataFrame, again: DataFrame, made: DataFrame) -> DataFrame:
    """runs (role_id, ...) with those of the roles in `again` replaced by `made` (as many rows for each role as there are)."""
    return runs.join(again.select("role_id"), "role_id", "left_anti").unionByName(made)


def decided(matches: DataFrame, events: DataFrame) -> DataFrame:
    """matches (role_id, match_id, status, released, active, score, run_rank) after a batch of decisions."""
    after = review.decisions(matches, events.drop("role_id")).where("match_id IS NOT NULL").select("match_id", F.col("status").alias("s"), F.col("released").alias("r"))
    rows = matches.join(after, "match_id", "left")
    return rows.withColumns({"status": F.coalesce("s", "status"), "released": F.coalesce("r", "released")}).drop("s", "r")


def refreshed(profiles: DataFrame, changes: DataFrame, embed: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """profiles (candidate_id, text, vector) after a batch of changes (candidate_id, text): a changed text loses its vector, and all that have none are embedded anew.

    embed takes (doc_id, text) and gives (doc_id, bucket, weight); a vector is kept as a map of buckets.
    """
    newest = changes.groupBy("candidate_id").agg(F.max_by("text", "n").alias("text"))
    rows = upserted(profiles, newest, "candidate_id", ["text"], ["vector"]).drop("change")
    wanted = embedtext.backlog(rows.select(F.col("candidate_id").alias("payload"), F.col("vector").isNotNull().alias("has_vector"), "text"), profiles.limit(0).selectExpr("'' AS status", "'' AS kind", "candidate_id AS payload"), "embed_profile")
    texts = rows.join(wanted.withColumnRenamed("payload", "candidate_id"), "candidate_id", "left_semi").select(F.col("candidate_id").alias("doc_id"), "text")
    made = embed(texts).groupBy(F.col("doc_id").alias("candidate_id")).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("bucket", "weight")))).alias("made"))  # one vector
    return rows.join(made, "candidate_id", "left").withColumn("vector", F.coalesce("vector", "made")).drop("made")
