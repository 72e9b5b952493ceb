"""Queries on grounding and embedding texts, with their SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rolemesh.operators import embedtext as em
from rolemesh.operators import grounding as gr
from rolemesh.operators import text as tx
from rolemesh.plans import bindings as b
from rolemesh.plans import documents as dc
from rolemesh.plans.record_queries import JOBS, _jobs
from rolemesh.plans.text_queries import PIECES, CERTS
from rolemesh.plans.vocabulary_queries import SQL as VOCABULARY
from rolemesh.plans.vocabulary_queries import vocabulary
from rolemesh.sources.scratch import kept


def _names(spark, d):
    return b.table(spark, d, "part").select(F.col("p_brand").alias("name"), F.lower("p_brand").alias("term")).distinct().union(spark.createDataFrame([(c, c) for c in CERTS], "name string, term string"))


def _quotes(spark, d):
    """A passage of five words of each text with its case, spaces and dashes changed; every fifth text doesn't have it."""
    p = F.regexp_extract_all("text", F.lit(PIECES), F.lit(0))
    first = F.when(F.get("p", F.lit(0)).rlike("^[A-Za-z0-9]"), 11).otherwise(12)
    rows = b.table(spark, d, "documents").select("doc_id", "text", p.alias("p")).where("size(p) > 30 AND text RLIKE '^[ -~\\\\s]*$'").withColumn("passage", F.array_join(F.slice("p", first, 9), ""))
    quote = F.concat(F.lit(" "), F.replace(F.regexp_replace(F.upper("passage"), "\\s+", "  "), F.lit("-"), F.lit("–")), F.when(F.col("doc_id") % 5 == 0, " zzqq").otherwise(""))
    return rows.select("doc_id", "text", "passage", quote.alias("quote"))


def found_quotes(spark, d):
    return gr.found_quote(_quotes(spark, d)).select("doc_id", F.lower("found").alias("found"))


def resume_audit(spark, d):
    """Values of each resume with errors planted by key: an unknown name, another number, software and years that nobody wrote."""
    r = dc.resumes(spark, d).withColumn("k", F.col("doc_id"))
    value = lambda field, kind, v: r.select("doc_id", F.lit(field).alias("field"), F.lit(kind).alias("kind"), F.expr(v).cast("string").alias("value")).where("value IS NOT NULL")
    parts = [
        value("full_name", "verbatim", "CASE WHEN k % 7 = 1 THEN 'Nobody Known' ELSE upper(replace(full_name, '#', '  ')) END"),
        value("phone", "phone", "CASE WHEN k % 11 <> 0 THEN CASE WHEN k % 7 = 2 THEN '+44 20 7946 0000' ELSE concat('001 555 ', lpad(cast(k % 1000 AS string), 3, '0'), lpad(cast(k % 10000 AS string), 4, '0')) END END"),
        value("start_year", "year", "CASE WHEN k % 7 = 3 THEN 1901 ELSE 2024 - years_experience END"),
        value("years_experience", "tenure", "years_experience"),
        value("current", "present", "CASE WHEN years_experience IS NOT NULL THEN 'x' END"),
        value("software", "term", "CASE WHEN k % 7 = 0 THEN 'brand#99' END"),
        r.select("doc_id", F.lit("software"), F.lit("term"), F.explode("software")),
        r.select("doc_id", F.lit("certifications"), F.lit("term"), F.explode("certifications")),
    ]
    return gr.audited(reduce(DataFrame.union, parts), r, _names(spark, d)).groupBy("field", "grounded").agg(F.count("*").alias("n"), F.sum("doc_id").alias("ids"))


def jd_audit(spark, d):
    r = dc.descriptions(spark, d).withColumn("k", F.col("doc_id"))
    value = lambda field, kind, v: r.select("doc_id", F.lit(field).alias("field"), F.lit(kind).alias("kind"), F.expr(v).cast("string").alias("value")).where("value IS NOT NULL")
    parts = [
        value("min_years", "number", "CASE WHEN k % 7 = 0 THEN 77 ELSE min_years END"), value("hours_per_week", "weekly", "CASE WHEN k % 7 = 1 THEN 33 ELSE hours_per_week END"),
        value("overlap", "overlap", "CASE WHEN k % 7 = 2 THEN 15 ELSE min_overlap_hours END"), value("software", "term", "CASE WHEN k % 7 = 3 THEN 'brand#99' ELSE soft END"), value("other", "verbatim", "CASE WHEN k % 7 = 4 THEN 'Bad Co' ELSE 'ACME  co' END"),
    ]
    return gr.audited(reduce(DataFrame.union, parts), r, _names(spark, d)).groupBy("field", "grounded").agg(F.count("*").alias("n"), F.sum("doc_id").alias("ids"))


def quote_audit(spark, d):
    """Answers with the passage twice, one that isn't there and one that is too long."""
    q = _quotes(spark, d)
    quotes = F.array("quote", F.lower("passage"), F.lit("never written zzqq"), F.repeat(F.lit("long "), 80))
    rows = q.select(F.col("doc_id").alias("row_id"), F.col("doc_id").alias("candidate_id"), F.lit("depth").alias("dimension"), (F.col("doc_id") % 3).cast("int").alias("level"), F.when(F.col("doc_id") % 10 == 0, F.slice(quotes, 3, 2)).otherwise(quotes).alias("quotes"))
    out = gr.grounded_quotes(rows, q.select(F.col("doc_id").alias("candidate_id"), "text"))
    return out.select("row_id", F.size("quotes").alias("n"), F.lower(F.get("quotes", F.lit(0))).alias("first"), "unbacked", "overlong", "absent")


def fragments(spark, d):
    """Whole-word containment, the line, and years, on resumes."""
    r = dc.resumes(spark, d)
    soft = F.get("software", F.lit(0))
    year = (2024 - F.col("years_experience"))
    rows = r.select("doc_id", gr.in_text(F.concat(F.upper(soft), F.lit(",")), F.col("text")).alias("has_comma"), gr.in_text(F.lit("naly"), F.col("text")).alias("part_of_word"), gr.line_with(F.lit("JUNIOR analyst"), F.col("text")).alias("line"), F.when(year.isNotNull(), gr.year_in_text(year, F.col("text"))).alias("year"), gr.year_in_text(F.lit(1901), F.col("text")).alias("no_year"))
    return rows


def plan_coverage(spark, d):
    r = kept(dc.resumes(spark, d), "resumes")
    plan = r.select("doc_id", F.when(F.col("doc_id") % 9 == 0, "Someone Else").otherwise(F.replace("full_name", F.lit("#"), F.lit(" "))).alias("full_name"), F.concat("certifications", F.when(F.col("doc_id") % 8 == 0, F.array(F.lit("brand#99"))).otherwise(F.array().cast("array<string>"))).alias("terms"))
    return gr.coverage(plan, r, _names(spark, d), 20, 2)


def profile_texts(spark, d):
    r = dc.resumes(spark, d)
    rows = r.select(F.col("doc_id").alias("row_id"), F.lit(" Senior  Analyst ").alias("headline"), F.array(F.lit("senior analyst"), F.col("segment")).alias("titles"), "certifications", "software", F.when(F.col("doc_id") % 2 == 0, F.array(F.lit("close"), F.lit("Close"), F.lit("tax"))).otherwise(F.array().cast("array<string>")).alias("skills"))
    return em.profile_texts(rows, vocabulary(spark, d)["terms"])


def role_texts(spark, d):
    r = dc.descriptions(spark, d)
    one = lambda c: F.when(F.col(c).isNotNull(), F.array(c)).otherwise(F.array().cast("array<string>"))
    rows = r.select(F.col("doc_id").alias("row_id"), F.col("p_name").alias("title"), one("cert").alias("certifications"), F.array("other").alias("preferred_certifications"), one("soft").alias("software"), F.array(F.lower("nice_soft")).alias("preferred_software"), F.array(F.lit("Standard costing; on-site in X"), F.lit("Remote; visa needed")).alias("must_haves"), F.array(F.lit("Able to start soon; Excel")).alias("nice_to_haves"))
    return em.role_texts(rows, vocabulary(spark, d)["terms"])


def _stored(spark, d):
    json = "CASE doc_id % 3 WHEN 0 THEN concat('{\"headline\": \"Old\", \"skills\": [\"a\"], \"software\": [\"s\"]}') WHEN 1 THEN '{}' ELSE 'free text' END AS profile"
    return dc.resumes(spark, d).selectExpr("doc_id AS row_id", json, "CASE WHEN doc_id % 2 = 0 THEN ' New ' END AS headline", "certifications", "software")


def embedded_once(spark, d):
    """Vectors of all documents, those of every third being cached: how many entries each document has, and whether from the cache."""
    docs = b.table(spark, d, "documents").select(F.col("doc_id").alias("row_id"), "text")
    cached = docs.where("row_id % 3 = 0").select(F.sha2(F.coalesce("text", F.lit("")), 256).alias("doc_id"), "text").dropDuplicates(["doc_id"])
    vectors, _ = em.embedded_once(docs, tx.hashed_embedding(cached).select(F.col("doc_id").alias("key"), "bucket", "weight"), tx.hashed_embedding)
    return vectors.groupBy("row_id", "hit").agg(F.count("*").alias("entries"))


def backlog(spark, d):
    rows = b.candidates(spark, d).select(F.col("candidate_id").alias("payload"), (F.col("candidate_id") % 3 == 0).alias("has_vector"), F.when(F.col("candidate_id") % 5 == 0, " ").otherwise(F.col("full_name")).alias("text"))
    return em.backlog(rows, _jobs(spark, d), "click")


def current_vectors(spark, d):
    docs = b.table(spark, d, "documents").select(F.col("doc_id").alias("row_id"), "text")
    made = docs.select("row_id", F.sha2(F.coalesce(F.when(F.col("row_id") % 4 == 0, F.concat(F.lit("old "), "text")).otherwise(F.col("text")), F.lit("")), 256).alias("input_key"), F.lit(1).alias("v"))
    return em.current_vectors(made, docs).select("row_id", "v")


QUERIES = {
    "fragments_in_text": fragments,
    "found_quotes": found_quotes,
    "resume_audit": resume_audit,
    "jd_audit": jd_audit,
    "quote_audit": quote_audit,
    "plan_coverage": plan_coverage,
    "profile_texts": profile_texts,
    "role_embedding_texts": role_texts,
    "overlaid_documents": lambda s, d: em.overlaid(_stored(s, d)),
    "fallback_texts": lambda s, d: em.fallback_texts(_stored(s, d)),
    "embedded_once": embedded_once,
    "embedding_backlog": backlog,
    "current_vectors": current_vectors,
    "usable_vectors": lambda s, d: em.usable_vectors(b.candidate_vectors(s, d).select(F.col("candidate_id").alias("id"), "v"), 64),
}

_PASSAGE = """qt AS (SELECT doc_id, text, array_to_string(p[f:f + 8], '') AS passage FROM (SELECT *, CASE WHEN regexp_matches(p[1], '^[A-Za-z0-9]') THEN 11 ELSE 12 END AS f FROM (SELECT doc_id, text, regexp_extract_all(text, '[A-Za-z0-9]+|[^A-Za-z0-9]+') AS p FROM documents) WHERE len(p) > 30 AND regexp_full_match(text, '[ -~\\s]*')))"""
_DROP = "v AS (SELECT * FROM ({}) t(field, grounded, doc_id)) SELECT field, grounded, count(*) AS n, sum(doc_id)::BIGINT AS ids FROM v GROUP BY 1, 2"
_UP = "upper({0}[1]) || {0}[2:]"
ORACLES = {
    "fragments_in_text": f"WITH {dc.SQL} SELECT doc_id, len(software) > 1 AS has_comma, false AS part_of_word, CASE WHEN years_experience IS NOT NULL THEN 'Junior Analyst, Old ' || segment || ', ' || (2020 - years_experience) || ' - ' || (2024 - years_experience) END AS line, CASE WHEN years_experience IS NOT NULL THEN true END AS year, false AS no_year FROM rs",
    "found_quotes": f"WITH {_PASSAGE} SELECT doc_id, CASE WHEN doc_id % 5 <> 0 THEN lower(passage) END AS found FROM qt",
    "resume_audit": f"WITH {dc.SQL}, " + _DROP.format("SELECT 'full_name', doc_id % 7 <> 1, doc_id FROM rs UNION ALL SELECT 'phone', doc_id % 7 <> 2, doc_id FROM rs WHERE doc_id % 11 <> 0 UNION ALL SELECT 'start_year', doc_id % 7 <> 3, doc_id FROM rs WHERE years_experience IS NOT NULL OR doc_id % 7 = 3 UNION ALL SELECT 'years_experience', true, doc_id FROM rs WHERE years_experience IS NOT NULL UNION ALL SELECT 'current', true, doc_id FROM rs WHERE years_experience IS NOT NULL UNION ALL SELECT 'software', false, doc_id FROM rs WHERE doc_id % 7 = 0 UNION ALL SELECT 'software', true, doc_id FROM (SELECT doc_id, unnest(software) FROM rs) UNION ALL SELECT 'certifications', true, doc_id FROM (SELECT doc_id, unnest(certifications) FROM rs)"),
    "jd_audit": f"WITH {dc.SQL}, " + _DROP.format("SELECT 'min_years', doc_id % 7 <> 0, doc_id FROM jd WHERE doc_id % 7 = 0 OR min_years IS NOT NULL UNION ALL SELECT 'hours_per_week', doc_id % 7 <> 1, doc_id FROM jd WHERE doc_id % 7 = 1 OR hours_per_week IS NOT NULL UNION ALL SELECT 'overlap', doc_id % 7 <> 2, doc_id FROM jd WHERE doc_id % 7 = 2 OR min_overlap_hours IS NOT NULL UNION ALL SELECT 'software', doc_id % 7 <> 3, doc_id FROM jd WHERE doc_id % 7 = 3 OR soft IS NOT NULL UNION ALL SELECT 'other', doc_id % 7 <> 4, doc_id FROM jd"),
    "quote_audit": f"WITH {_PASSAGE} SELECT doc_id AS row_id, CASE WHEN doc_id % 10 = 0 THEN 0 ELSE 1 END AS n, CASE WHEN doc_id % 10 <> 0 THEN lower(passage) END AS first, doc_id % 10 = 0 AND doc_id % 3 > 0 AS unbacked, 1::BIGINT AS overlong, (1 + (doc_id % 5 = 0 AND doc_id % 10 <> 0)::INTEGER)::BIGINT AS absent FROM qt",
    "plan_coverage": f"WITH {dc.SQL}, w AS (SELECT doc_id, len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) AS n, years_experience FROM rs) SELECT doc_id, 'never names brand#99' AS problem FROM rs WHERE doc_id % 8 = 0 UNION ALL SELECT doc_id, 'too few words' FROM w WHERE n < 20 UNION ALL SELECT doc_id, 'too few positions' FROM w WHERE years_experience IS NULL UNION ALL SELECT doc_id, 'name is missing' FROM rs WHERE doc_id % 9 = 0",
    "profile_texts": f"WITH {VOCABULARY} SELECT doc_id AS row_id, concat_ws(chr(10), 'Role: Senior Analyst; ' || segment, CASE WHEN len(certifications) > 0 THEN 'Qualifications: ' || array_to_string([{_UP.format('x')} FOR x IN certifications], '; ') END, CASE WHEN len(software) > 0 THEN 'Software: ' || array_to_string([{_UP.format('x')} FOR x IN software], '; ') END, CASE WHEN doc_id % 2 = 0 THEN 'Skills: close; tax' END) AS text FROM rs",
    "role_embedding_texts": f"WITH {VOCABULARY} SELECT doc_id AS row_id, concat_ws(chr(10), 'Role: ' || p_name, 'Qualifications: ' || CASE WHEN cert IS NOT NULL AND cert <> other THEN {_UP.format('cert')} || '; ' ELSE '' END || {_UP.format('other')}, 'Software: ' || CASE WHEN soft IS NOT NULL AND soft <> lower(nice_soft) THEN {_UP.format('soft')} || '; ' ELSE '' END || CASE WHEN nice_soft IN (SELECT p_brand FROM part) THEN nice_soft ELSE lower(nice_soft) END, 'Skills: Standard costing; Excel') AS text FROM jd",
    "overlaid_documents": f"""WITH {dc.SQL} SELECT doc_id AS row_id, CASE doc_id % 3 WHEN 2 THEN NULL ELSE '{{' || concat_ws(',', CASE WHEN doc_id % 2 = 0 THEN '"headline":"New"' WHEN doc_id % 3 = 0 THEN '"headline":"Old"' END, CASE WHEN len(certifications) > 0 THEN '"certifications":["' || array_to_string(certifications, '","') || '"]' END, CASE WHEN len(software) > 0 THEN '"software":["' || array_to_string(software, '","') || '"]' WHEN doc_id % 3 = 0 THEN '"software":["s"]' END, CASE WHEN doc_id % 3 = 0 THEN '"skills":["a"]' END) || '}}' END AS document FROM rs""",
    "fallback_texts": f"""WITH {dc.SQL} SELECT doc_id AS row_id, concat_ws(chr(10), CASE WHEN doc_id % 2 = 0 THEN 'New' END, CASE doc_id % 3 WHEN 0 THEN '{{"headline": "Old", "skills": ["a"], "software": ["s"]}}' WHEN 2 THEN 'free text' END, CASE WHEN len(certifications) > 0 THEN 'certifications: ' || array_to_string(certifications, ', ') END, CASE WHEN len(software) > 0 THEN 'software: ' || array_to_string(software, ', ') END) AS text FROM rs""",
    "embedding_backlog": f"WITH {b.SQL}, {JOBS} SELECT candidate_id AS payload FROM cand WHERE candidate_id % 3 <> 0 AND candidate_id % 5 <> 0 AND candidate_id NOT IN (SELECT payload FROM job WHERE status = 'queued' AND kind = 'click')",
    "current_vectors": "SELECT doc_id AS row_id, 1 AS v FROM documents WHERE doc_id % 4 <> 0 OR text IS NULL",
    "usable_vectors": f"WITH {b.SQL} SELECT candidate_id AS id, coalesce(len(v) = 64, false) AS width_ok, coalesce(list_inner_product(v, v) > 0, false) AS norm_ok FROM cvec",
}
