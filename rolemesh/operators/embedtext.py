"""Texts that profiles and roles are embedded from, and which vectors are wanted, stale or unusable."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rolemesh.operators.taxonomy import unique

#: Fixed value: wording of clauses about place, time, hours and the right to work.
LOGISTICS = "(?i)\\b(pacific|mountain|central|eastern)\\s+time\\b|\\btime\\s*zone\\b|\\bbusiness\\s+hours\\b|\\bon-?site\\b|\\bhybrid\\b|\\bremote\\b|\\bcommutable\\b|\\brelocat|\\b(based|located)\\s+in\\b|\\bright\\s+to\\s+work\\b|\\bwork\\s+authori[sz]ation\\b|\\bvisa\\b|\\b(able|available|availability)\\s+to\\s+start\\b|\\bstart\\s+(within|immediately|on\\s+or\\s+before|date)\\b"


def about_the_work(entries: Column) -> Column:
    """Entries without their clauses on logistics; an entry that was nothing else is gone."""
    clauses = F.transform(entries, lambda e: F.array_join(F.filter(F.transform(F.split(e, ";"), lambda c: F.trim(c)), lambda c: (c != "") & ~c.rlike(LOGISTICS)), "; "))
    return F.filter(clauses, lambda e: e != "")


def labelled(rows: DataFrame, columns: dict[str, str], terms: DataFrame) -> DataFrame:
    """rows with the ids of the given columns {column: kind} as labels, in their order (ids unknown to terms stay)."""
    out = rows
    for column, kind in columns.items():
        labels = terms.where(F.col("kind") == kind).select(F.col("id").alias("x"), "label")
        each = rows.select("row_id", F.posexplode(column).alias("pos", "x")).join(labels, "x", "left").groupBy("row_id").agg(F.sort_array(F.collect_list(F.struct("pos", F.coalesce("label", "x").alias("l")))).alias("ls"))
        out = out.join(each.select("row_id", F.transform("ls", lambda y: y["l"]).alias(f"{column}_labels")), "row_id", "left").withColumn(f"{column}_labels", F.coalesce(f"{column}_labels", F.array().cast("array<string>")))
    return out


def _rendered(lines: list[tuple[str, Column]]) -> Column:
    return F.concat_ws("\n", *[F.when(F.size(unique(v)) > 0, F.concat(F.lit(f"{label}: "), F.array_join(unique(v), "; "))) for label, v in lines])


def profile_texts(profiles: DataFrame, terms: DataFrame) -> DataFrame:
    """(row_id, text) of profiles (row_id, headline, titles, certifications, software, skills): labelled lines, ids as labels, empty lines left out."""
    rows = labelled(profiles, {"certifications": "certifications", "software": "software"}, terms)
    lines = [("Role", F.concat(F.array("headline"), "titles")), ("Qualifications", F.col("certifications_labels")), ("Software", F.col("software_labels")), ("Skills", F.col("skills"))]
    return rows.select("row_id", _rendered(lines).alias("text"))


def role_texts(roles: DataFrame, terms: DataFrame) -> DataFrame:
    """(row_id, text) of roles (row_id, title, certifications, preferred_certifications, software, preferred_software, must_haves, nice_to_haves): required before preferred."""
    kinds = {"certifications": "certifications", "preferred_certifications": "certifications", "software": "software", "preferred_software": "software"}
    rows = labelled(roles, kinds, terms)
    both = lambda c: F.concat(f"{c}_labels", f"preferred_{c}_labels")
    lines = [("Role", F.array("title")), ("Qualifications", both("certifications")), ("Software", both("software")), ("Skills", about_the_work(F.concat("must_haves", "nice_to_haves")))]
    return rows.select("row_id", _rendered(lines).alias("text"))


def overlaid(rows: DataFrame) -> DataFrame:
    """rows (row_id, profile: JSON text, headline, certifications, software) with document: the stored fields under the row's own columns where those have a value; null if the JSON is no object."""
    doc = F.from_json("profile", "headline string, certifications array<string>, software array<string>, skills array<string>")
    over = lambda c: F.when(F.size(c) > 0, F.col(c)).otherwise(F.col(f"d.{c}"))
    parsed = rows.withColumn("d", F.when(F.trim("profile").startswith("{"), doc))
    fields = F.struct(F.coalesce(F.nullif(F.trim("headline"), F.lit("")), F.col("d.headline")).alias("headline"), over("certifications").alias("certifications"), over("software").alias("software"), F.col("d.skills").alias("skills"))
    return parsed.select("row_id", F.when(F.col("d").isNotNull(), F.to_json(fields)).alias("document"))


def fallback_texts(rows: DataFrame) -> DataFrame:
    """(row_id, text) for free-form profiles: headline, the JSON as it is, certifications, software."""
    body = F.when(~F.trim("profile").isin("", "{}"), F.trim("profile"))
    line = lambda c: F.when(F.size(c) > 0, F.concat(F.lit(f"{c}: "), F.array_join(c, ", ")))
    return rows.select("row_id", F.concat_ws("\n", F.nullif(F.trim("headline"), F.lit("")), body, line("certifications"), line("software")).alias("text"))


def embedded_once(texts: DataFrame, cache: DataFrame, embed, batch: str = "text") -> tuple[DataFrame, DataFrame]:
    """(vectors, counts): vectors is (row_id, key, bucket, weight, hit) for every row; each distinct text that the cache (key, bucket, weight) lacks is embedded once. counts is (rows, distinct, hits).

    embed takes a DataFrame (doc_id, text) and gives (doc_id, bucket, weight).
    """
    keyed = texts.select("row_id", "text", F.sha2(F.coalesce("text", F.lit("")), 256).alias("key"))
    have = cache.select("key").distinct().withColumn("hit", F.lit(True))
    distinct = keyed.groupBy("key").agg(F.first("text").alias("text")).join(have, "key", "left")
    fresh = embed(distinct.where("hit IS NULL").select(F.col("key").alias("doc_id"), "text")).select(F.col("doc_id").alias("key"), "bucket", "weight")
    known = cache.join(distinct.where("hit").select("key"), "key", "left_semi").select("key", "bucket", "weight")
    all_ = fresh.withColumn("hit", F.lit(False)).union(known.withColumn("hit", F.lit(True)))
    return keyed.select("row_id", "key").join(all_, "key"), distinct.agg(F.count("*").alias("distinct"), F.count("hit").alias("hits"))


def backlog(rows: DataFrame, jobs: DataFrame, kind: str) -> DataFrame:
    """(payload) of rows (payload, has_vector, text) that need a vector: none yet, text not blank, and no such job queued."""
    queued = jobs.where((F.col("status") == "queued") & (F.col("kind") == kind)).select("payload")
    return rows.where(~F.col("has_vector") & (F.trim(F.coalesce("text", F.lit("x"))) != "")).select("payload").join(queued, "payload", "left_anti")


def current_vectors(computed: DataFrame, rows: DataFrame) -> DataFrame:
    """computed (row_id, input_key, ...) whose inputs are still what the row holds (row_id, text); stale ones are left out."""
    now = rows.select("row_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("input_key"))
    return computed.join(now, ["row_id", "input_key"], "left_semi")


def usable_vectors(vectors: DataFrame, width: int) -> DataFrame:
    """(id, width_ok, norm_ok) of vectors (id, v)."""
    norm = F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    return vectors.select("id", F.coalesce(F.size("v") == width, F.lit(False)).alias("width_ok"), F.coalesce(norm > 0, F.lit(False)).alias("norm_ok"))
