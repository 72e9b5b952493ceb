"""Queries on the vocabulary of certifications and software bound to the supplied tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from rolemesh.operators import settle as st
from rolemesh.operators import taxonomy as tax
from rolemesh.operators import text as tx
from rolemesh.plans import bindings as b
from rolemesh.plans import documents as dc
from rolemesh.plans.text_queries import key_sql
from rolemesh.sources.taxonomy import exploded

#: Places of the variants of `standard`, and the bodies that award them.
BODIES = (("economy", "Eco Board"), ("small", "Sma Institute"), ("small", "Sma"), ("medium", "Med Board"))
PLACES = (("economy", "africa"), ("small", "asia"))


def documents(spark, d):
    """The vocabulary as nested documents, one a kind: {kind, terms: [{id, label, aliases, group, variant_of}]}."""
    soft = b.table(spark, d, "part").select("p_brand").distinct().select(F.lit("software").alias("kind"), F.lower("p_brand").alias("id"), F.col("p_brand").alias("label"), F.array(F.replace("p_brand", F.lit("#"), F.lit(" ")), F.concat(F.upper("p_brand"), F.lit(" (certified)"))).alias("aliases"), F.lit(None).cast("string").alias("grp"), F.array().cast("array<string>").alias("variant_of"))
    certs = b.terms(spark).select(F.lit("certifications").alias("kind"), "id", F.initcap("id").alias("label"), F.array(F.concat(F.lit("Certified "), "id"), F.concat("id", F.lit(" & co"))).alias("aliases"), "grp", F.when(F.col("variant_of").isNotNull(), F.array("variant_of")).otherwise(F.array().cast("array<string>")).alias("variant_of"))
    return soft.union(certs).groupBy("kind").agg(F.sort_array(F.collect_list(F.struct("id", "label", "aliases", F.col("grp").alias("group"), "variant_of"))).alias("terms"))


def vocabulary(spark, d):
    v = exploded(documents(spark, d))
    place = spark.createDataFrame(list(PLACES), "id string, place string")
    bodies = spark.createDataFrame(list(BODIES), "id string, body string")
    first = bodies.groupBy("id").agg(F.max("body").alias("issuing_body"))
    return v | {"terms": v["terms"].join(place, "id", "left").join(first, "id", "left"), "bodies": bodies, "index": tax.alias_index(v["names"])}


def places(spark, d):
    """Regions as jurisdictions, with their nations as aliases."""
    return b.table(spark, d, "region").join(b.table(spark, d, "nation"), F.col("r_regionkey") == F.col("n_regionkey")).select(F.lower("r_name").alias("id"), F.col("n_name").alias("name"))


def place_zones(spark, d):
    zones = spark.createDataFrame([(k % 5, z) for k, z in enumerate(b.ZONES)], "r_regionkey int, timezone string")
    return zones.join(b.table(spark, d, "region"), "r_regionkey").select(F.lower("r_name").alias("id"), "timezone")


WRITTEN = "CASE (candidate_id + i) % 5 WHEN 0 THEN upper(x) WHEN 1 THEN ' ' || replace(x, '#', ' ') WHEN 2 THEN x || ' (expert)' WHEN 3 THEN 'Unknown ' || CAST(i AS VARCHAR(9)) ELSE x END"
EXTRA = "array({}, 'UNKNOWN-1', 'Mystery ' || CAST(candidate_id % 3 AS VARCHAR(9)), '  ', 'Brand#1 (certified)')"


def written(spark, d):
    """Software as people might write it: (row_id, main, extra)."""
    return b.profiles(spark, d).selectExpr("candidate_id AS row_id", f"transform(software, (x, i) -> {WRITTEN}) AS main", f"{EXTRA.format('get(software, 0)')} AS extra")


def _joined(rows):
    return rows.select("row_id", F.array_join("ids", ";").alias("ids"), F.array_join("unknown", ";").alias("unknown"))


def resolved_terms(spark, d):
    v = vocabulary(spark, d)
    values = written(spark, d).select(F.lit("software").alias("kind"), F.explode("main").alias("raw")).groupBy("kind", "raw").agg(F.count("*").alias("n"))
    return tax.canonical(tax.resolved(values, v["index"]), v["terms"])


def term_audit(spark, d):
    v = vocabulary(spark, d)
    w = written(spark, d)
    rows = w.select(F.lit("software").alias("kind"), F.lit("main").alias("column"), F.explode("main").alias("raw")).union(w.select(F.lit("software"), F.lit("extra"), F.explode("extra"))).union(b.roles(spark, d).select(F.lit("certifications"), F.lit("required"), F.explode("required_certifications")))
    return tax.unlisted(rows, v["terms"], v["index"])


def taxonomy_problems(spark, d):
    """The vocabulary with errors: the alias "Brand 1" for every tenth brand, an empty alias, an unknown group and a variant of a variant."""
    v = exploded(documents(spark, d))
    bad = spark.createDataFrame([("certifications", "promo", "certified license"), ("software", "brand#2", "BRAND 1"), ("certifications", "large", "The Medium"), ("certifications", "medium", "the-medium")], "kind string, id string, name string")
    links = spark.createDataFrame([("promo", "small"), ("large", "nobody"), ("medium", "medium")], "id string, variant_of string")
    groups = spark.createDataFrame([("g0",), ("g1",)], "grp string")
    return tax.problems(v["terms"], v["names"].unionByName(bad), v["variants"].unionByName(links), groups)


#: A record for each profile, by its key: how the name is written, an id, the body, the place and a hint.
RECORD = {
    "name": "CASE k % 5 WHEN 0 THEN 'Part-qualified Standard' WHEN 1 THEN 'Standard' WHEN 2 THEN 'standard certificate' WHEN 3 THEN 'Certified Medium' ELSE 'Shaman' END",
    "canonical": "CASE WHEN k % 7 = 0 THEN 'small' END",
    "issuing_body": "CASE k % 4 WHEN 0 THEN 'the SMA Institute of X' WHEN 1 THEN 'Eco Board' END",
    "jurisdiction": "CASE k % 3 WHEN 0 THEN here WHEN 1 THEN 'Atlantis' END",
    "hint": "CASE k % 2 WHEN 0 THEN 'asia' END",
}
_RECORD = ", ".join(f"{v} AS {k}" for k, v in RECORD.items())


def records(spark, d):
    return dc.resumes(spark, d).withColumn("k", F.col("doc_id")).selectExpr("doc_id AS row_id", *[f"{v} AS {k}" for k, v in RECORD.items()])


def _settled(spark, d):
    v = vocabulary(spark, d)
    return st.settled(records(spark, d), v["index"], v["terms"], v["variants"], v["bodies"], places(spark, d))


def displayed(spark, d):
    v = vocabulary(spark, d)
    return st.display(_settled(spark, d), v["index"], v["terms"])


def held_ids(spark, d):
    """Each profile's certifications brought in step with a record of standard as economy, and with one of medium that is not held yet."""
    rows = b.profiles(spark, d).selectExpr("candidate_id AS row_id", "certifications AS ids", "array(named_struct('canonical', 'economy', 'family', array('standard', 'economy'), 'counts', candidate_id % 3 <> 0), named_struct('canonical', 'medium', 'family', array('medium'), 'counts', false)) AS records")
    return st.synced_ids(rows).select("row_id", F.array_join("ids", ";").alias("ids"))


def localised(spark, d):
    v = vocabulary(spark, d)
    n = "CASE role_id % 3 WHEN 0 THEN concat('in ', 'NATION_', cast(role_id % 25 AS string), ' or so') END"
    rows = b.roles(spark, d).selectExpr("role_id AS row_id", "'Standard' AS name", "cast(null AS string) AS canonical", f"{n} AS quote", "timezone")
    return st.localised(rows, v["index"], v["terms"], v["variants"], v["bodies"], places(spark, d), place_zones(spark, d))


def first_of_records(spark, d):
    rows = b.table(spark, d, "orders").selectExpr("o_custkey AS row_id", "o_orderkey AS pos", "CASE WHEN o_orderkey % 3 = 0 THEN lower(o_orderstatus) END AS canonical", "o_orderpriority AS name")
    return tax.first_records(rows).select("row_id", "pos")


QUERIES = {
    "taxonomy_terms": lambda s, d: exploded(documents(s, d))["terms"],
    "taxonomy_names": lambda s, d: exploded(documents(s, d))["names"],
    "alias_index": lambda s, d: vocabulary(s, d)["index"],
    "taxonomy_problems": taxonomy_problems,
    "resolved_terms": resolved_terms,
    "resolved_lists": lambda s, d: _joined(tax.resolved_lists(written(s, d), vocabulary(s, d)["index"], "software", ("main",))),
    "overflow_merge": lambda s, d: _joined(tax.resolved_lists(written(s, d), vocabulary(s, d)["index"], "software", ("main", "extra"))),
    "term_audit": term_audit,
    "ambiguous_variants": lambda s, d: tax.variants_of(vocabulary(s, d)["variants"]).select("id", F.array_join("variants", ";").alias("variants")),
    "customer_places": lambda s, d: tax.placed(b.table(s, d, "customer").join(b.table(s, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).selectExpr("c_custkey", "CASE c_custkey % 3 WHEN 0 THEN lower(n_name) WHEN 1 THEN replace(n_name, '_', ' - ') ELSE 'Nowhere' END AS raw"), places(s, d)),
    "zone_places": lambda s, d: tax.place_of_zone(b.availability(s, d).select("candidate_id", "timezone"), place_zones(s, d)),
    "first_places": lambda s, d: tax.first_place(dc.resumes(s, d), places(s, d)),
    "unique_lists": lambda s, d: written(s, d).select("row_id", F.array_join(tax.unique(F.concat("extra", "main", "extra")), ";").alias("values")),
    "preferred_only": lambda s, d: b.profiles(s, d).select("candidate_id", F.array_join(tax.without(F.col("software"), F.slice(F.col("software"), 1, 2)), ";").alias("preferred")),
    "first_records": first_of_records,
    "content_keys": lambda s, d: b.candidates(s, d).select("candidate_id", tax.content_key({"name": F.col("full_name"), "email": F.col("email"), "kind": F.lit("profile")}).alias("key")),
    "name_families": lambda s, d: st.families(records(s, d), vocabulary(s, d)["index"]).select("row_id", "base"),
    "named_bodies": lambda s, d: st.bodies_in(records(s, d).select("row_id", F.lit("standard").alias("id"), F.col("issuing_body").alias("text")), vocabulary(s, d)["bodies"], vocabulary(s, d)["variants"]).select("row_id", "of", "body"),
    "settled_records": _settled,
    "displayed_records": displayed,
    "held_ids": held_ids,
    "localised_requirements": localised,
    "qualification_status": lambda s, d: tx.on_lines(dc.resumes(s, d), s.createDataFrame([(c, c) for c in ("economy", "promo")], "name string, term string")).select("doc_id", "term", "line", tx.qualification_status(F.col("line"), F.col("surface")).alias("status")),
}

_BODY = ", ".join(map(str, BODIES))
SQL = f"""{dc.SQL},
soft AS (SELECT DISTINCT p_brand FROM part),
tm AS MATERIALIZED (SELECT 'software' AS kind, lower(p_brand) AS id, p_brand AS label, NULL AS grp, [replace(p_brand, '#', ' '), upper(p_brand) || ' (certified)'] AS aliases FROM soft
  UNION ALL SELECT 'certifications', id, upper(id[1]) || id[2:], grp, ['Certified ' || id, id || ' & co'] FROM term),
nms AS MATERIALIZED (SELECT kind, id, unnest([id, label] || aliases) AS name FROM tm),
kn AS (SELECT kind, id, CASE WHEN kind = 'certifications' THEN {key_sql('name', True)} ELSE {key_sql('name', False)} END AS key FROM nms),
idx AS MATERIALIZED (SELECT kind, key, min(id) AS id FROM kn WHERE key <> '' GROUP BY kind, key HAVING min(id) = max(id)),
wr AS MATERIALIZED (SELECT candidate_id AS row_id, [{WRITTEN.replace("(candidate_id + i)", "(candidate_id + i - 1)").replace("CAST(i AS", "CAST(i - 1 AS")} FOR x, i IN software] AS main, {EXTRA.format("software[1]").replace("array(", "[", 1)[:-1]}] AS extra FROM prof),
pl AS (SELECT lower(r_name) AS id, n_name AS name FROM region JOIN nation ON r_regionkey = n_regionkey),
rec AS MATERIALIZED (SELECT doc_id AS row_id, {_RECORD} FROM (SELECT *, doc_id AS k FROM rs)),
body AS (SELECT * FROM (VALUES {_BODY}) t(id, body))
"""


def _lists(columns: str) -> str:
    return f"""WITH {SQL}, e AS (SELECT row_id, i AS pos, raw, {key_sql('raw', False)} AS key FROM (SELECT row_id, unnest({columns}) AS raw, unnest(range(1, len({columns}) + 1)) AS i FROM wr)),
m AS (SELECT row_id, idx.id, CASE WHEN idx.id IS NULL THEN e.key END AS k, min(pos) AS pos, arg_min(trim(raw), pos) AS t FROM e LEFT JOIN idx ON idx.kind = 'software' AND idx.key = e.key WHERE idx.id IS NOT NULL OR trim(raw) <> '' GROUP BY 1, 2, 3),
g AS (SELECT row_id, string_agg(id, ';' ORDER BY pos) FILTER (id IS NOT NULL) AS ids, string_agg(t, ';' ORDER BY pos) FILTER (id IS NULL) AS unknown FROM m GROUP BY 1)
SELECT row_id, coalesce(ids, '') AS ids, coalesce(unknown, '') AS unknown FROM wr LEFT JOIN g USING (row_id)"""


_BASE = "CASE row_id % 5 WHEN 3 THEN 'medium' WHEN 4 THEN NULL ELSE 'standard' END"
_SET = f"""sd AS (SELECT rec.*, {_BASE} AS base, CASE WHEN rec.name = 'Shaman' THEN NULL WHEN row_id % 5 = 3 THEN 'medium' WHEN row_id % 4 = 0 THEN 'small' WHEN row_id % 4 = 1 THEN 'economy' WHEN canonical = 'small' THEN 'small'
  WHEN coalesce(pl.id, hint) = 'africa' THEN 'economy' WHEN coalesce(pl.id, hint) = 'asia' THEN 'small' ELSE 'standard' END AS s, pl.id AS place FROM rec LEFT JOIN pl ON pl.name = jurisdiction),
se AS (SELECT row_id, name, s AS canonical, coalesce(CASE s WHEN 'economy' THEN 'Eco Board' WHEN 'small' THEN 'Sma Institute' WHEN 'medium' THEN 'Med Board' END, issuing_body) AS issuing_body, coalesce(CASE s WHEN 'economy' THEN 'africa' WHEN 'small' THEN 'asia' END, place, jurisdiction) AS jurisdiction FROM sd)"""
ORACLES = {
    "taxonomy_terms": f"WITH {SQL} SELECT kind, id, label, grp FROM tm",
    "taxonomy_names": f"WITH {SQL} SELECT DISTINCT kind, id, name FROM nms",
    "alias_index": f"WITH {SQL} SELECT * FROM idx",
    "taxonomy_problems": f"""WITH {SQL}, own AS (SELECT count(*) FILTER (p_brand = 'Brand#1') > 0 AND count(*) FILTER (p_brand = 'Brand#2') > 0 AS both_ FROM soft)
SELECT 'empty key' AS problem, 'certifications' AS kind, 'promo' AS id UNION ALL SELECT 'shared key', 'software', unnest(['brand#1', 'brand#2']) FROM own WHERE both_ UNION ALL SELECT 'shared key', 'certifications', unnest(['large', 'medium'])
UNION ALL SELECT 'unknown group', 'certifications', 'promo' UNION ALL SELECT 'variant of no other id', 'certifications', unnest(['large', 'medium']) UNION ALL SELECT 'variant of a variant', 'certifications', unnest(['promo', 'medium']) UNION ALL SELECT 'another group than its variant', 'certifications', 'promo'""",
    "resolved_terms": f"WITH {SQL}, v AS (SELECT raw, count(*) AS n FROM (SELECT unnest(main) AS raw FROM wr) GROUP BY 1) SELECT 'software' AS kind, raw, n, idx.id, raw IN (SELECT id FROM tm WHERE kind = 'software') AS is_canonical FROM v LEFT JOIN idx ON idx.kind = 'software' AND idx.key = {key_sql('raw', False)}",
    "resolved_lists": _lists("main"),
    "overflow_merge": _lists("main || extra"),
    "term_audit": f"WITH {SQL}, v AS (SELECT 'main' AS \"column\", unnest(main) AS raw FROM wr UNION ALL SELECT 'extra', unnest(extra) FROM wr) SELECT 'software' AS kind, \"column\", raw, count(*) AS n, min(idx.id) AS suggestion FROM v LEFT JOIN idx ON idx.kind = 'software' AND idx.key = {key_sql('raw', False)} WHERE raw IS NOT NULL AND raw NOT IN (SELECT id FROM tm WHERE kind = 'software') GROUP BY \"column\", raw UNION ALL SELECT 'software', \"column\", raw, count(*), NULL FROM v WHERE raw IS NULL GROUP BY ALL",
    "ambiguous_variants": f"WITH {SQL} SELECT variant_of AS id, string_agg(id, ';' ORDER BY id) AS variants FROM term WHERE variant_of IS NOT NULL GROUP BY 1",
    "customer_places": f"WITH {SQL} SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN lower(n_name) WHEN 1 THEN replace(n_name, '_', ' - ') ELSE 'Nowhere' END AS raw, CASE WHEN c_custkey % 3 <> 2 THEN lower(r_name) END AS place FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON r_regionkey = n_regionkey",
    "zone_places": f"WITH {SQL} SELECT candidate_id, timezone, lower(r_name) AS place FROM avail LEFT JOIN region ON r_regionkey = (list_position({list(b.ZONES)!r}, timezone) - 1) % 5",
    "first_places": f"WITH {SQL} SELECT doc_id, lower(r_name) AS place FROM rs JOIN nation ON n_name = here JOIN region ON r_regionkey = n_regionkey",
    "unique_lists": f"WITH {SQL}, e AS (SELECT row_id, i, trim(regexp_replace(coalesce(v, ''), '[\\x20\\x09-\\x0D]+', ' ', 'g')) AS v FROM (SELECT row_id, unnest(extra || main || extra) AS v, unnest(range(len(extra || main || extra))) AS i FROM wr)), f AS (SELECT row_id, min(i) AS i, arg_min(v, i) AS v FROM e WHERE v <> '' GROUP BY row_id, lower(v)) SELECT row_id, string_agg(v, ';' ORDER BY i) AS values FROM f GROUP BY 1",
    "preferred_only": f"WITH {SQL} SELECT candidate_id, array_to_string(software[3:], ';') AS preferred FROM prof",
    "first_records": f"WITH o AS (SELECT o_custkey AS row_id, o_orderkey AS pos, coalesce(CASE WHEN o_orderkey % 3 = 0 THEN lower(o_orderstatus) END, '?' || {key_sql('o_orderpriority', True)}) AS k FROM orders) SELECT row_id, min(pos) AS pos FROM o GROUP BY row_id, k",
    "content_keys": f"WITH {SQL} SELECT candidate_id, sha256('{{\"email\":\"' || email || '\",\"kind\":\"profile\",\"name\":\"' || full_name || '\"}}') AS key FROM cand",
    "name_families": f"WITH {SQL} SELECT row_id, {_BASE} AS base FROM rec",
    "named_bodies": f"WITH {SQL} SELECT row_id, CASE row_id % 4 WHEN 0 THEN 'small' ELSE 'economy' END AS of, CASE row_id % 4 WHEN 0 THEN 'SMA Institute' ELSE 'Eco Board' END AS body FROM rec WHERE row_id % 4 < 2",
    "settled_records": f"WITH {SQL}, {_SET} SELECT * FROM se",
    "displayed_records": f"""WITH {SQL}, {_SET}, n AS (SELECT *, CASE WHEN name = 'Part-qualified Standard' THEN 'Standard' ELSE name END AS bare FROM se), d AS (SELECT row_id, bare, concat_ws(', ', issuing_body, jurisdiction) AS detail FROM n)
SELECT row_id, CASE WHEN detail <> '' THEN bare || ' (' || detail || ')' ELSE bare END AS shown FROM d""",
    "held_ids": f"""WITH {SQL}, a AS (SELECT candidate_id AS row_id, certifications AS c, coalesce(list_position([x IN ('economy', 'standard') FOR x IN certifications], true), 0) AS p, [x FOR x IN certifications IF x NOT IN ('economy', 'standard')] AS l FROM prof),
f AS (SELECT row_id, CASE WHEN row_id % 3 = 0 THEN l WHEN p = 0 THEN l || ['economy'] ELSE l[1:p - 1] || ['economy'] || l[p:] END AS ids FROM a) SELECT row_id, array_to_string([x FOR x IN ids IF x <> 'medium'], ';') AS ids FROM f""",
    "localised_requirements": f"""WITH {SQL}, r AS (SELECT role_id AS row_id, CASE WHEN role_id % 3 = 0 THEN lower(a.r_name) ELSE lower(z.r_name) END AS place FROM role JOIN nation ON n_nationkey = role_id % 25 JOIN region a ON a.r_regionkey = n_regionkey LEFT JOIN region z ON z.r_regionkey = (list_position({list(b.ZONES)!r}, timezone) - 1) % 5)
SELECT row_id, CASE place WHEN 'africa' THEN 'economy' WHEN 'asia' THEN 'small' ELSE 'standard' END AS canonical FROM r""",
    "qualification_status": f"""WITH {SQL}, l AS (SELECT doc_id, c, w, unnest(CASE w WHEN 4 THEN [c, 'promo'] ELSE [c] END) AS term, CASE w WHEN 0 THEN '- ' || upper(c) || ' licence, ' || (2000 + ki % 20) WHEN 1 THEN '- Studying for ' || c WHEN 2 THEN '* Audited a ' || c || ' firm' WHEN 3 THEN '- their ' || c ELSE '- ' || c || ' and part-qualified promo' END AS line FROM (SELECT doc_id, c, (doc_id + i - 1) % 5 AS w, doc_id + i - 1 AS ki FROM (SELECT doc_id, unnest(range(1, len(certifications) + 1)) AS i, unnest(certifications) AS c FROM rs)))
SELECT doc_id, term, line, CASE WHEN w = 1 THEN 'in_progress' WHEN w = 4 AND term = 'promo' THEN 'part_qualified' ELSE 'qualified' END AS status FROM l WHERE term IN ('economy', 'promo')""",
}
