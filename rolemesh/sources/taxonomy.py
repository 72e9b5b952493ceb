"""A vocabulary file: nested JSON to dimension tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TERM = "struct<id:string,label:string,aliases:array<string>,group:string,variant_of:array<string>>"
PLACE = "struct<id:string,aliases:array<string>,regions:array<string>,timezones:array<string>>"
KINDS = ("certifications", "software", "industries")
SCHEMA = ", ".join([*(f"{k} array<{TERM}>" for k in KINDS), f"jurisdictions array<{PLACE}>"])


def exploded(kinds: DataFrame) -> dict[str, DataFrame]:
    """terms (kind, id, label, grp), names (kind, id, name: id, label and aliases) and variants (id, variant_of) of documents (kind, terms: array of nested terms)."""
    t = kinds.select("kind", F.explode("terms").alias("t"))
    none = F.array().cast("array<string>")
    return {
        "terms": t.select("kind", "t.id", "t.label", F.col("t.group").alias("grp")),
        "names": t.select("kind", "t.id", F.explode(F.concat(F.array("t.id", "t.label"), F.coalesce("t.aliases", none))).alias("name")).distinct(),
        "variants": t.select("t.id", F.explode(F.coalesce("t.variant_of", none)).alias("variant_of")),
    }


def read(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The tables of `exploded`, with places (id, name), regions (id, region) and place_zones (id, timezone), from a JSON file with a list for each kind and one of jurisdictions."""
    doc = spark.read.schema(SCHEMA).json(path, multiLine=True)
    parts = [doc.select(F.lit(k).alias("kind"), F.col(k).alias("terms")).where(F.col(k).isNotNull()) for k in KINDS]
    j = doc.select(F.explode("jurisdictions").alias("j"))
    return exploded(parts[0].union(parts[1]).union(parts[2])) | {
        "places": j.select("j.id", F.explode("j.aliases").alias("name")),
        "regions": j.select("j.id", F.explode("j.regions").alias("region")),
        "place_zones": j.select("j.id", F.explode("j.timezones").alias("timezone")),
    }
