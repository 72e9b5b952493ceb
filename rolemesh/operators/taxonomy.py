"""A vocabulary of canonical terms: alias keys, the alias index, and resolving of written names, lists and places against it.

A vocabulary is five tables: terms (kind, id, label, grp, issuing_body), names (kind, id, name), variants (id, variant_of), places
(id, name) and place_zones (id, timezone). They are dimensions: joins with them are left to Spark, which broadcasts by measured size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rolemesh.operators.names import spans

#: Words that say a credential is held rather than which it is (certifications only).
CREDENTIAL_WORDS = ("certified", "certification", "certifications", "certificate", "credential", "license", "licensed", "licence")
#: A parenthetical that stands apart from a word; one glued to a word is part of the name.
APART = "(^|[ \\t\\n\\r])\\([^)]*\\)"


def alias_key(text: Column, certification: bool | Column = False) -> Column:
    """Lower case, & as `and`, parentheticals that stand apart dropped, credential words dropped for certifications, letters and digits only."""
    plain = F.regexp_replace(F.replace(F.lower(text), F.lit("&"), F.lit(" and ")), APART, " ")
    words = F.split(plain, "[^a-z0-9]+")
    without = F.filter(words, lambda w: ~w.isin(*CREDENTIAL_WORDS))
    if isinstance(certification, bool):
        return F.array_join(without if certification else words, "")
    return F.array_join(F.when(certification, without).otherwise(words), "")


def place_key(text: Column) -> Column:
    return F.regexp_replace(F.lower(text), "[^a-z0-9]", "")


def _keyed(rows: DataFrame, column: str) -> DataFrame:
    return rows.withColumn("key", alias_key(F.col(column), F.col("kind") == "certifications"))


def alias_index(names: DataFrame) -> DataFrame:
    """(kind, key, id) of every name that leads to one id alone."""
    keyed = _keyed(names, "name").where("key <> ''").groupBy("kind", "key").agg(F.min("id").alias("id"), F.max("id").alias("other"))
    return keyed.where("id = other").drop("other")


def resolved(values: DataFrame, index: DataFrame, column: str = "raw") -> DataFrame:
    """values (kind, raw, ...) with id: the canonical id its key leads to, or null."""
    return _keyed(values, column).join(index, ["kind", "key"], "left").drop("key")


def canonical(values: DataFrame, terms: DataFrame, column: str = "raw") -> DataFrame:
    """values with is_canonical: whether the text is exactly an id."""
    return values.join(terms.select("kind", F.col("id").alias(column), F.lit(True).alias("c")), ["kind", column], "left").withColumn("is_canonical", F.coalesce("c", F.lit(False))).drop("c")


def _in_order(found: DataFrame, key: str, name: str, condition: Column) -> Column:
    return F.transform(F.array_sort(F.collect_list(F.when(condition, F.struct("at", key)))), lambda x: x[key]).alias(name)


def resolved_lists(rows: DataFrame, index: DataFrame, kind: str, lists: tuple[str, ...]) -> DataFrame:
    """(row_id, ids, unknown): the lists of each row (earlier lists first) as canonical ids and unknown texts, each once, in order of first sight; blanks dropped.

    With two lists this is the merge of a main and an overflow list: what is known in either joins the ids, what is not the unknown.
    """
    parts = [rows.select("row_id", F.lit(n).alias("part"), F.posexplode(c).alias("pos", "raw")) for n, c in enumerate(lists)]
    each = parts[0]
    for p in parts[1:]:
        each = each.union(p)
    each = _keyed(each.withColumn("kind", F.lit(kind)), "raw").join(index, ["kind", "key"], "left").where(F.col("id").isNotNull() | (F.trim("raw") != ""))
    once = each.groupBy("row_id", "id", F.when(F.col("id").isNull(), F.col("key")).alias("k")).agg(F.min(F.struct("part", "pos", F.trim("raw").alias("text"))).alias("at"))
    once = once.select("row_id", "id", "at", F.col("at.text").alias("text"))
    got = once.groupBy("row_id").agg(_in_order(once, "id", "ids", F.col("id").isNotNull()), _in_order(once, "text", "unknown", F.col("id").isNull()))  # no longer than the lists
    none = F.array().cast("array<string>")
    return rows.select("row_id").join(got, "row_id", "left").select("row_id", F.coalesce("ids", none).alias("ids"), F.coalesce("unknown", none).alias("unknown"))


def variants_of(variants: DataFrame) -> DataFrame:
    """(id, variants): the ids that an ambiguous id may turn out to be."""
    return variants.groupBy(F.col("variant_of").alias("id")).agg(F.sort_array(F.collect_set("id")).alias("variants"))


def placed(values: DataFrame, places: DataFrame, column: str = "raw") -> DataFrame:
    """values with place: the jurisdiction that the text names, by id or alias, or null."""
    names = places.select("id", F.explode(F.array("id", "name")).alias("n")).groupBy(place_key(F.col("n")).alias("_key")).agg(F.min("id").alias("place"))
    return values.withColumn("_key", place_key(F.col(column))).join(names, "_key", "left").drop("_key")


def place_of_zone(values: DataFrame, place_zones: DataFrame) -> DataFrame:
    """values (timezone, ...) with place: the jurisdiction of the time zone, or null."""
    return values.join(place_zones.groupBy("timezone").agg(F.min("id").alias("place")), "timezone", "left")


#: What a region's code ends a location with, and what stands before it ("Austin, TX 78701").
REGION_ENDS, REGION_FOLLOWS = "^[ \\t]*(?:$|\\n|[|\u2022\u00b7]|[0-9]{5})", ", "


def first_place(texts: DataFrame, places: DataFrame, regions: DataFrame | None = None) -> DataFrame:
    """(doc_id, place) of the jurisdiction that a text names first: by id or alias as a whole word in its own case, or by the code of a region (id, region) that ends a location. Texts that name none are left out."""
    every = 1 << 31
    named = spans(texts, places.select(F.explode(F.array("id", "name")).alias("name"), F.col("id").alias("term")), every).select("doc_id", "start", "term")
    if regions is not None:
        codes = spans(texts, regions.select(F.col("region").alias("name"), F.col("id").alias("term")), every, whole=False)
        named = named.union(codes.where(F.col("ahead").endswith(REGION_FOLLOWS) & F.col("behind").rlike(REGION_ENDS)).select("doc_id", "start", "term"))
    return named.groupBy("doc_id").agg(F.min(F.struct("start", "term"))["term"].alias("place"))


def problems(terms: DataFrame, names: DataFrame, variants: DataFrame, groups: DataFrame) -> DataFrame:
    """(problem, kind, id) for every break of the vocabulary's rules."""
    keyed = _keyed(names, "name")
    shared = keyed.where("key <> ''").groupBy("kind", "key").agg(F.collect_set("id").alias("ids")).where(F.size("ids") > 1)  # the few terms that claim one key
    v = variants.join(terms.select("id", F.col("grp").alias("own")), "id").join(terms.select(F.col("id").alias("variant_of"), F.col("grp").alias("theirs"), F.lit(True).alias("there")), "variant_of", "left")
    nested = variants.select(F.col("id").alias("variant_of")).distinct().withColumn("nested", F.lit(True))
    v = v.join(nested, "variant_of", "left").withColumn("kind", F.lit("certifications"))
    parts = [
        keyed.where("key = ''").select(F.lit("empty key").alias("problem"), "kind", "id"),
        shared.select(F.lit("shared key"), "kind", F.explode("ids").alias("id")),
        terms.where("grp IS NOT NULL").join(groups, "grp", "left_anti").select(F.lit("unknown group"), "kind", "id"),
        v.where("there IS NULL OR id = variant_of").select(F.lit("variant of no other id"), "kind", "id"),
        v.where("nested").select(F.lit("variant of a variant"), "kind", "id"),
        v.where("there AND NOT own <=> theirs").select(F.lit("another group than its variant"), "kind", "id"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out.distinct()


def unlisted(rows: DataFrame, terms: DataFrame, index: DataFrame) -> DataFrame:
    """(kind, column, raw, n, suggestion): distinct values of array columns that are no canonical id, with the id that each would resolve to. rows: (kind, column, raw)."""
    odd = rows.groupBy("kind", "column", "raw").agg(F.count("*").alias("n")).join(terms.select("kind", F.col("id").alias("raw")), ["kind", "raw"], "left_anti")
    return resolved(odd, index).select("kind", "column", "raw", "n", F.col("id").alias("suggestion"))


def first_records(records: DataFrame) -> DataFrame:
    """records (row_id, pos, canonical, name, ...): the first for each qualification of a row; unresolved ones are told apart by the key of their name."""
    key = F.coalesce("canonical", F.concat(F.lit("?"), alias_key(F.col("name"), True)))
    return records.withColumn("_k", F.row_number().over(Window.partitionBy("row_id", key).orderBy("pos"))).where("_k = 1").drop("_k")


def without(preferred: Column, required: Column) -> Column:
    """Preferred entries, in order, that are not required."""
    return F.filter(preferred, lambda p: ~F.array_contains(required, p))


def unique(values: Column) -> Column:
    """Non-blank values with white space collapsed, the first of each kept whatever its case."""
    flat = F.filter(F.transform(values, lambda v: F.trim(F.regexp_replace(F.coalesce(v, F.lit("")), "[\\x20\\x09-\\x0D]+", " "))), lambda v: v != "")
    folded = F.transform(flat, F.lower)
    return F.filter(flat, lambda v, i: F.array_position(folded, F.lower(v)) == i + 1)


def content_key(parts: dict[str, Column]) -> Column:
    """SHA-256 of the canonical JSON of all parts that change an answer, by name."""
    return F.sha2(F.to_json(F.struct(*[parts[k].alias(k) for k in sorted(parts)]), {"ignoreNullFields": "false"}), 256)
