"""Entities as typed tables: scans, appends, upserts with their rules, deletes and report sinks.

Updates are expressed as the table's next state; a caller writes it where the table lives (an atomic overwrite, or a merge on a table format that has one).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Columns of the entities.
SCHEMAS = {
    "candidates": "id string, full_name string, email string, location string, resume_text string, source string, status string, created_at timestamp",
    "candidate_profiles": "candidate_id string, profile string, headline string, years_experience int, certifications array<string>, software array<string>, availability string, available_from date, timezone string, embedding array<float>, embedding_model string, embedded_at timestamp",
    "candidate_availability": "candidate_id string, timezone string, work_start int, work_end int, hours_per_week int, available_from date",
    "roles": "id string, title string, company string, description string, requirements string, must_haves array<string>, nice_to_haves array<string>, required_certifications array<string>, required_software array<string>, min_years_experience int, timezone string, starts_on date, min_overlap_hours int, hours_per_week int, status string, embedding array<float>, embedding_model string, embedded_at timestamp",
    "matches": "id string, role_id string, candidate_id string, score double, explanation string, breakdown string, status string, released_at timestamp",
    "review_events": "id long, match_id string, action string, actor string, reason string, replacement_candidate_id string, metadata string, created_at timestamp",
    "filter_runs": "id string, role_id string, created_at timestamp, matched_at timestamp, match_status string, attention_reason string, candidate_ids array<string>, retrieved_ids array<string>, retrieved_similarities array<double>, unranked_ids array<string>, request_id string, metrics string",
    "jobs": "id long, kind string, payload string, status string, priority int, run_at timestamp, attempts int, max_attempts int, last_error string, locked_at timestamp, locked_by string",
    "documents": "id string, title string, content string, embedding array<float>",
}
LOG_LINE = "time timestamp, level string, service string, msg string, request_id string, job_id string, duration_ms double, rest variant"


def scan(spark: SparkSession, folder: str, names: tuple[str, ...] = tuple(SCHEMAS)) -> dict[str, DataFrame]:
    """The entities of a folder with a Parquet table each, by name; columns that a table lacks are null."""
    return {n: spark.read.schema(SCHEMAS[n]).parquet(f"{folder}/{n}") for n in names}


def corpus(spark: SparkSession, folder: str, expected_schema: str) -> DataFrame:
    """(slug, text, expected) of a folder with <slug>.txt files, each with its <slug>.expected.json if there is one; empty files give no row."""
    slug = lambda ending: F.regexp_extract(F.col("_metadata.file_name"), f"^(.*)\\.{ending}$", 1)
    texts = spark.read.text(f"{folder}/*.txt", wholetext=True).select(slug("txt").alias("slug"), F.col("value").alias("text"))
    answers = spark.read.text(f"{folder}/*.expected.json", wholetext=True).select(slug("expected\\.json").alias("slug"), F.from_json("value", expected_schema).alias("expected"))
    return texts.join(answers, "slug", "left")


def log_lines(lines: DataFrame, column: str = "value") -> DataFrame:
    """Known fields of JSON log lines, and the whole line as a variant for the fields that a service adds; lines that are no objects are left out."""
    known = F.from_json(column, "time timestamp, level string, service string, msg string, request_id string, job_id string, duration_ms double")
    rows = lines.withColumn("k", known).where(F.col(column).startswith("{"))
    return rows.select("k.*", F.try_parse_json(column).alias("rest"))


def appended(table: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """table with the rows of new whose key it lacks; of several new rows with one key, one."""
    return table.unionByName(new.dropDuplicates(key).join(table.select(*key), key, "left_anti"))


def upserted(table: DataFrame, new: DataFrame, key: str, derived_from: list[str], derived: list[str]) -> DataFrame:
    """table with the rows of new in place of or beside its own, and `change` (inserted, replaced, kept). `derived` columns survive a replacement only if none of `derived_from` changed."""
    own = [c for c in table.columns if c != key and c not in derived]
    old = table.select(key, F.struct(*[c for c in table.columns if c != key]).alias("o"))
    rows = old.join(new.select(key, F.struct(*own).alias("n")), key, "full_outer")
    same = reduce(lambda a, b: a & b, [F.col(f"o.{c}").eqNullSafe(F.col(f"n.{c}")) for c in derived_from])
    there, replaced = F.col("n").isNotNull(), F.col("o").isNotNull()
    kept = [F.when(~there | same, F.col(f"o.{c}")).alias(c) for c in derived]
    change = F.when(there & replaced, "replaced").when(there, "inserted").otherwise("kept")
    return rows.select(key, *[F.when(there, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c) for c in own], *kept, change.alias("change"))


def still_current(new: DataFrame, table: DataFrame, key: str, source: str) -> DataFrame:
    """Rows of new that were made from what the table's source column still holds (new has its hash as source_hash)."""
    now = table.select(key, F.sha2(F.coalesce(source, F.lit("")), 256).alias("source_hash"))
    return new.join(now, [key, "source_hash"], "left_semi").drop("source_hash")


def latest(rows: DataFrame, key: list[str], order: Column) -> DataFrame:
    """One row a key, the last in that order."""
    return rows.withColumn("_k", F.row_number().over(Window.partitionBy(*key).orderBy(order.desc()))).where("_k = 1").drop("_k")


def patched(table: DataFrame, patches: DataFrame, key: str) -> DataFrame:
    """table with the fields that patches supply: patches has key, `supplied` (names) and the columns; a supplied null clears, a field not supplied stays."""
    columns = [c for c in table.columns if c != key]
    p = patches.select(key, "supplied", *[F.col(c).alias(f"_{c}") for c in columns])
    rows = table.join(p, key, "left")
    return rows.select(key, *[F.when(F.coalesce(F.array_contains("supplied", c), F.lit(False)), F.col(f"_{c}")).otherwise(F.col(c)).alias(c) for c in columns])


def deleted(gone: DataFrame, candidates: DataFrame, children: dict[str, DataFrame], matches: DataFrame, events: DataFrame) -> tuple[dict[str, DataFrame], DataFrame]:
    """(tables without the candidates of gone and what hangs on them, candidates that can't go because a match of theirs has review history)."""
    with_history = matches.join(events.select("match_id").distinct(), "match_id", "left_semi").select("candidate_id").distinct()
    blocked = gone.join(with_history, "candidate_id", "left_semi")
    free = gone.join(with_history, "candidate_id", "left_anti").select("candidate_id")
    tables = {"candidates": candidates, **children, "matches": matches}
    return {n: t.join(free, "candidate_id", "left_anti") for n, t in tables.items()}, blocked


def write_reports(reports: dict[str, tuple[DataFrame, list[str]]], folder: str) -> None:
    """Each report (table, columns that part it) as Parquet below folder/<name>."""
    for name, (table, parts) in reports.items():
        table.write.mode("overwrite").partitionBy(*parts).parquet(f"{folder}/{name}")
