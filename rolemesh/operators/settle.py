"""Which qualification a written name is: family, awarding body, place and status, and keeping lists of held ids in step with the records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rolemesh.operators import taxonomy as tax
from rolemesh.operators.names import spans

#: Words that say how far along the holder is, not which qualification it is.
STATUS_WORDS = "(?i)\\b(?:part[- ]qualified|fully[- ]qualified|newly[- ]qualified|qualified|finalist|candidate|student|trainee|member|fellow|in progress|studying(?: for| towards?)?|pursuing|working towards?)\\b"


def families(names: DataFrame, index: DataFrame) -> DataFrame:
    """names (name, ...) with base: the id its letters belong to, as written or without words of progress; null if unknown."""
    certs = index.where("kind = 'certifications'")
    whole, bare = (certs.select(F.col("key").alias(k), F.col("id").alias(i)) for k, i in (("_k1", "_i1"), ("_k2", "_i2")))
    rows = names.withColumns({"_k1": tax.alias_key(F.col("name"), True), "_k2": tax.alias_key(F.regexp_replace("name", STATUS_WORDS, " "), True)})
    return rows.join(whole, "_k1", "left").join(bare, "_k2", "left").withColumn("base", F.coalesce("_i1", "_i2")).drop("_k1", "_k2", "_i1", "_i2")


def bodies_in(texts: DataFrame, bodies: DataFrame, variants: DataFrame, own_first: bool = True) -> DataFrame:
    """(row_id, id, of, body): the awarding body of each row's id, or of a variant of it (of), that its text names, as the text writes it. texts: (row_id, id, text); bodies: (id, body).

    own_first: the id itself is asked before its variants, in order of their ids, and each by its longest name; else the longest name of all wins.
    """
    own = bodies.select("id", F.col("id").alias("of"), F.col("body").alias("term")).union(variants.join(bodies, "id").select(F.col("variant_of"), "id", "body"))
    docs = texts.select(F.struct("row_id", "id").alias("doc_id"), "text")
    found = spans(docs, own.select(F.col("term").alias("name"), "term").distinct(), 0)
    met = found.select("doc_id.*", "term", "start", "surface").join(own, ["id", "term"])
    order = [F.col("of") != F.col("id"), "of"] if own_first else []
    best = F.row_number().over(Window.partitionBy("row_id", "id").orderBy(*order, F.length("term").desc(), "of", "start", "term"))
    return met.withColumn("k", best).where("k = 1").select("row_id", "id", "of", F.col("surface").alias("body"))


def settled(records: DataFrame, index: DataFrame, terms: DataFrame, variants: DataFrame, bodies: DataFrame, places: DataFrame) -> DataFrame:
    """records (row_id, name, canonical, issuing_body, jurisdiction, hint) with the id, body and place they settle to.

    terms carries issuing_body and place; an id stays as its name is unless its letters are shared. Then a body named with it beats the
    given variant, which beats the only variant of the place (the one that the record names, else the hint).
    """
    rows = tax.placed(families(records, index), places, "jurisdiction").withColumn("where", F.coalesce("place", F.nullif(F.trim("jurisdiction"), F.lit("")))).withColumn("at", F.coalesce("place", "hint"))
    v = variants.join(terms.select("id", F.col("place").alias("v_place")), "id").groupBy(F.col("variant_of").alias("base")).agg(F.collect_list(F.struct("id", F.col("v_place"))).alias("vs"))
    text = F.concat_ws(" ", "name", F.coalesce("issuing_body", F.lit("")))
    named = bodies_in(rows.where("base IS NOT NULL").select("row_id", F.col("base").alias("id"), text.alias("text")), bodies.join(variants.select("id").distinct(), "id", "left_semi"), variants, own_first=False).select("row_id", F.col("of").alias("named"))
    rows = rows.join(v, "base", "left").join(named, "row_id", "left")
    ids, local = F.transform("vs", lambda x: x["id"]), F.filter("vs", lambda x: x["v_place"] == F.col("at"))
    given = F.when(F.array_contains(ids, F.col("canonical")), F.col("canonical"))
    one = F.when(F.size(local) == 1, F.get(local, F.lit(0))["id"])
    term = F.when(F.col("vs").isNull(), F.col("base")).otherwise(F.coalesce("named", given, one, F.col("base")))
    rows = rows.withColumn("settled", term).join(terms.select(F.col("id").alias("settled"), F.col("issuing_body").alias("t_body"), F.col("place").alias("t_place"), "label"), "settled", "left")
    return rows.select("row_id", "name", F.col("settled").alias("canonical"), F.coalesce("t_body", F.nullif(F.trim("issuing_body"), F.lit(""))).alias("issuing_body"), F.coalesce("t_place", "where").alias("jurisdiction"))


def display(records: DataFrame, index: DataFrame, terms: DataFrame) -> DataFrame:
    """records (row_id, name, canonical, issuing_body, jurisdiction) with shown: the name as written without words of progress (the label if it leads nowhere), then who awarded it and where."""
    bare = F.trim(F.regexp_replace(F.regexp_replace("name", STATUS_WORDS, " "), "[\\x20\\x09-\\x0D]+", " "))
    bare = F.regexp_replace(bare, "^[ ,-]+|[ ,-]+$", "")
    rows = records.withColumn("bare", F.when(bare == "", F.col("name")).otherwise(bare))
    rows = rows.withColumn("_k", tax.alias_key(F.col("bare"), True)).join(index.where("kind = 'certifications'").select(F.col("key").alias("_k"), F.col("id").alias("known")), "_k", "left")
    rows = rows.join(terms.select(F.col("id").alias("canonical"), "label"), "canonical", "left")
    name = F.when(F.col("canonical").isNotNull() & F.col("known").isNull(), F.col("label")).otherwise(F.col("bare"))
    detail = F.array_join(F.filter(F.array("issuing_body", "jurisdiction"), lambda d: d.isNotNull() & (F.lower(d) != F.lower(name))), ", ")
    return rows.select("row_id", F.when(detail != "", F.concat(name, F.lit(" ("), detail, F.lit(")"))).otherwise(name).alias("shown"))


def synced_ids(rows: DataFrame) -> DataFrame:
    """rows (row_id, ids, records) with ids brought in step: records are struct(canonical, family: array of related ids, counts), in order.

    Each record takes out all ids of its family and, if it counts, puts its own where the first of them stood (at the end if none did). A fold over the row's own records; nothing is shuffled.
    """

    def step(ids: Column, r: Column) -> Column:
        first = F.get(F.filter(F.transform(ids, lambda x, i: F.when(F.array_contains(r["family"], x), i)), lambda i: i.isNotNull()), F.lit(0))
        left = F.filter(ids, lambda x: ~F.array_contains(r["family"], x))
        at = F.least(F.coalesce(first, F.size(ids)), F.size(left))
        put = F.concat(F.slice(left, 1, at), F.array(r["canonical"]), F.slice(left, at + 1, F.size(left)))
        return F.when(r["counts"] & r["canonical"].isNotNull() & ~F.array_contains(left, r["canonical"]), put).otherwise(left)

    return rows.withColumn("ids", F.aggregate("records", F.col("ids"), step))


def localised(requirements: DataFrame, index: DataFrame, terms: DataFrame, variants: DataFrame, bodies: DataFrame, places: DataFrame, place_zones: DataFrame, regions: DataFrame | None = None) -> DataFrame:
    """requirements (row_id, name, canonical, quote, timezone) settled by the place their words name first, else by that of the role's time zone."""
    said = tax.first_place(requirements.select(F.col("row_id").alias("doc_id"), F.concat_ws(" ", "name", "quote").alias("text")), places, regions).select(F.col("doc_id").alias("row_id"), F.col("place").alias("stated"))
    rows = tax.place_of_zone(requirements, place_zones).withColumnRenamed("place", "zone_place").join(said, "row_id", "left")
    none = F.lit(None).cast("string")
    asked = rows.select("row_id", "name", "canonical", none.alias("issuing_body"), none.alias("jurisdiction"), F.coalesce("stated", "zone_place").alias("hint"))
    return settled(asked, index, terms, variants, bodies, places).select("row_id", "canonical")
