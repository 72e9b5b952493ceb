"""Queries on the texts of documents, resumes and descriptions, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from rolemesh.operators import taxonomy as tax
from rolemesh.operators import text as tx
from rolemesh.plans import bindings as b
from rolemesh.plans import documents as dc

#: A letter and a mark that compose, a soft hyphen, ligatures, a zero-width space, wide spaces.
UNCLEAN = "e\u0301\u00ad\ufb01\ufb05\u200b \u2003\n\n"
CERTS = ("economy", "standard", "small", "medium", "large", "promo")


def _docs(spark, d):
    return b.table(spark, d, "documents")


def alias_keys(spark, d):
    name = F.expr("CASE p_partkey % 4 WHEN 0 THEN concat(upper(p_brand), ' & (Certified) ', p_name) WHEN 1 THEN concat('The Certified ', p_name, ' Credential') WHEN 2 THEN concat(p_name, '(c)(3)') ELSE concat(p_name, '-', lower(p_type), ' license') END")
    return b.table(spark, d, "part").select("p_partkey", tax.alias_key(name).alias("key"), tax.alias_key(name, True).alias("cert_key"))


#: Names are taken from neighbouring pieces (words, and what stands between them) of a text.
PIECES = "([A-Za-z0-9]+|[^A-Za-z0-9]+)"


def _names(spark, d):
    """Names from all passages of benchmark: words of five letters or more, runs of two and of three with one space between, words with the comma behind them, short words in their own case."""
    p = b.table(spark, d, "benchmark").select(F.regexp_extract_all("text", F.lit(PIECES), F.lit(0)).alias("p"))
    long = lambda w: w.rlike("^[A-Za-z]{4,}$")
    next_ = lambda i, k: F.get("p", i + k)
    pick = lambda f: F.filter(F.transform("p", f), lambda w: w.isNotNull())
    one = F.filter("p", lambda w: w.rlike("^[A-Za-z]+$"))
    two = pick(lambda w, i: F.when(long(w) & (next_(i, 1) == " ") & long(next_(i, 2)), F.array_join(F.slice("p", i + 1, 3), "")))
    three = pick(lambda w, i: F.when(long(w) & (next_(i, 1) == " ") & long(next_(i, 2)) & (next_(i, 3) == " ") & long(next_(i, 4)), F.array_join(F.slice("p", i + 1, 5), "")))
    marked = pick(lambda w, i: F.when(long(w) & next_(i, 1).startswith(","), F.concat(w, F.lit(","))))
    rows = p.select(F.explode(F.concat(one, two, three, marked)).alias("w")).select(F.when(F.length("w") > 4, F.lower("w")).otherwise(F.col("w")).alias("name"))
    return rows.where("length(name) > 4 OR name RLIKE '^[A-Z]'").distinct().select("name", F.col("name").alias("term"))


def _cert_names(spark):
    return spark.createDataFrame([(c, c) for c in CERTS], "name string, term string")


def _soft_names(spark, d):
    return b.table(spark, d, "part").select(F.col("p_brand").alias("name"), F.lower("p_brand").alias("term")).distinct()


def jd_qualifications(spark, d):
    docs = dc.descriptions(spark, d)
    must = tx.sections(docs).select("doc_id", F.posexplode("must").alias("pos", "line"))
    lines = must.select(F.struct("doc_id", "pos").alias("doc_id"), F.col("line").alias("text"))
    found = tx.spans(lines, _cert_names(spark), lines=True).select("doc_id.doc_id", "doc_id.pos", "line", F.col("start").alias("at"), "term")
    return tx.equivalents(found).select("doc_id", "term", "accept_equivalents", "stated")


def reading_of_spans(spark, d):
    return tx.in_context(tx.on_lines(dc.resumes(spark, d), _cert_names(spark))).groupBy("term", "reading").agg(F.count("*").alias("n"))


def longest_spans(spark, d):
    """Spans of names of benchmark in documents, longest only."""
    found = tx.spans(_docs(spark, d), _names(spark, d))
    return tx.maximal(found).groupBy("doc_id").agg(F.count("*").alias("n"), F.sum("start").alias("places"))


def span_places(spark, d):
    docs = dc.resumes(spark, d)
    return tx.spans(docs, _cert_names(spark)).select("doc_id", "start", "end", "surface", "term")


def read_off(spark, d):
    docs = dc.resumes(spark, d)
    known = docs.select("doc_id", F.explode("certifications").alias("term"))
    return tx.read_off(docs, known, _cert_names(spark))


QUERIES = {
    "alias_keys": alias_keys,
    "contacts": lambda s, d: tx.contacts(dc.resumes(s, d)),
    "document_contacts": lambda s, d: tx.contacts(_docs(s, d)),
    "head_lines": lambda s, d: tx.head_line(dc.descriptions(s, d)),
    "term_mentions": lambda s, d: tx.mentions(_docs(s, d), _names(s, d)),
    "span_places": span_places,
    "longest_spans": longest_spans,
    "reading_of_spans": reading_of_spans,
    "standards_named": lambda s, d: tx.standards(dc.resumes(s, d)).select("doc_id", F.array_join("standards", ";").alias("standards")),
    "years_on_page": lambda s, d: tx.years_of_experience(dc.resumes(s, d), 2026),
    "availability_said": lambda s, d: tx.availability(dc.resumes(s, d)),
    "requirement_lists": lambda s, d: tx.sections(dc.descriptions(s, d)).select("doc_id", F.array_join("must", ";").alias("must"), F.array_join("nice", ";").alias("nice")),
    "numeric_requirements": lambda s, d: tx.numeric_requirements(dc.descriptions(s, d)),
    "section_terms": lambda s, d: tx.section_terms(dc.descriptions(s, d), _soft_names(s, d)),
    "jd_qualifications": jd_qualifications,
    "qualification_records": lambda s, d: tx.qualification_records(dc.resumes(s, d), _cert_names(s)),
    "position_history": lambda s, d: tx.positions(dc.resumes(s, d)).drop("pos"),
    "certificates_read_off": read_off,
    "cleaned_texts": lambda s, d: _docs(s, d).select("doc_id", F.sha2(tx.cleaned(F.concat(F.lit("\r\n\n"), F.replace("text", F.lit(". "), F.lit(".  \r\n")), F.lit(UNCLEAN))), 256).alias("sha")),
    "comparison_forms": lambda s, d: _docs(s, d).select("doc_id", F.sha2(tx.comparison_form(F.concat(F.col("text"), F.lit(" — It’s"))), 256).alias("sha")),
    "hashed_embeddings": lambda s, d: tx.hashed_embedding(_docs(s, d)).drop("row"),
    "embed_once": lambda s, d: tx.embed_once(_docs(s, d), _docs(s, d).where("doc_id % 3 = 0").select(F.sha2("text", 256).alias("key")).distinct()),
}


def key_sql(name: str, certification: bool) -> str:
    plain = f"regexp_replace(replace(lower({name}), '&', ' and '), '(^|[ \\t\\n\\r])\\([^)]*\\)', ' ', 'g')"
    drop = " AND w NOT IN (" + ", ".join(f"'{w}'" for w in tax.CREDENTIAL_WORDS) + ")" if certification else ""
    return f"array_to_string([w FOR w IN string_split_regex({plain}, '[^a-z0-9]+') IF w <> ''{drop}], '')"


_PIECES = "regexp_extract_all(text, '[A-Za-z0-9]+|[^A-Za-z0-9]+')"
_STOP = ", ".join(f"'{w}'" for w in tx.STOP_WORDS)
_NAME_SQL = f"""bp AS (SELECT {_PIECES} AS p FROM benchmark), bi AS (SELECT p, unnest(range(1, len(p) + 1)) AS i FROM bp),
bn AS (SELECT p[i] AS w, p[i + 1] AS l1, p[i + 2] AS l2, p[i + 3] AS l3, p[i + 4] AS l4, regexp_matches(p[i], '^[A-Za-z]{{4,}}$') AS a, p[i + 1] = ' ' AND regexp_matches(p[i + 2], '^[A-Za-z]{{4,}}$') AS b, p[i + 3] = ' ' AND regexp_matches(p[i + 4], '^[A-Za-z]{{4,}}$') AS c FROM bi),
nw AS (SELECT w FROM bn WHERE regexp_matches(w, '^[A-Za-z]+$') UNION ALL SELECT w || l1 || l2 FROM bn WHERE a AND b UNION ALL SELECT w || l1 || l2 || l3 || l4 FROM bn WHERE a AND b AND c UNION ALL SELECT w || ',' FROM bn WHERE a AND l1[1] = ','),
nm AS MATERIALIZED (SELECT DISTINCT CASE WHEN length(w) > 4 THEN lower(w) ELSE w END AS name FROM nw WHERE length(w) > 4 OR regexp_matches(w, '^[A-Z]')),
dp AS (SELECT doc_id, unnest({_PIECES}) AS w, generate_subscripts({_PIECES}, 1) AS i FROM documents),
dx AS MATERIALIZED (SELECT doc_id, w, lead(w, 1) OVER o AS l1, lead(w, 2) OVER o AS l2, lead(w, 3) OVER o AS l3, lead(w, 4) OVER o AS l4, (sum(length(w)) OVER o - length(w))::INTEGER AS start_ FROM dp WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
g AS (SELECT doc_id, start_, w AS surface FROM dx UNION ALL SELECT doc_id, start_, w || l1 || l2 FROM dx WHERE l1 = ' ' AND l2 IS NOT NULL UNION ALL SELECT doc_id, start_, w || l1 || l2 || l3 || l4 FROM dx WHERE l1 = ' ' AND l3 = ' ' AND l4 IS NOT NULL UNION ALL SELECT doc_id, start_, w || ',' FROM dx WHERE l1[1] = ',' AND (length(l1) > 1 OR l2 IS NULL)),
sp AS MATERIALIZED (SELECT DISTINCT doc_id, start_, start_ + length(surface) AS end_, name AS term FROM g JOIN nm ON lower(surface) = lower(name) AND (length(name) > 4 OR surface = name))"""
_CERT_LINES = """cl AS (SELECT doc_id, i, c, (doc_id + i - 1) % 5 AS w, doc_id + i - 1 AS ki FROM (SELECT doc_id, unnest(range(1, len(certifications) + 1)) AS i, unnest(certifications) AS c FROM rs))"""

ORACLES = {
    "alias_keys": f"WITH n AS (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN upper(p_brand) || ' & (Certified) ' || p_name WHEN 1 THEN 'The Certified ' || p_name || ' Credential' WHEN 2 THEN p_name || '(c)(3)' ELSE p_name || '-' || lower(p_type) || ' license' END AS name FROM part) SELECT p_partkey, {key_sql('name', False)} AS key, {key_sql('name', True)} AS cert_key FROM n",
    "contacts": f"WITH {dc.SQL} SELECT doc_id, replace(full_name, '#', ' ') AS full_name, split_part(email, '#', 2) AS email, CASE WHEN doc_id % 11 <> 0 THEN '+1 (555) ' || lpad((doc_id % 1000)::VARCHAR, 3, '0') || '-' || lpad((doc_id % 10000)::VARCHAR, 4, '0') END AS phone FROM rs",
    "document_contacts": f"""WITH l AS (SELECT doc_id, text, trim([x FOR x IN string_split(text, chr(10)) IF regexp_matches(x, '[^\\x20\\x09-\\x0D]')][1]) AS line FROM documents), n AS (SELECT *, trim(string_split_regex(line, '{tx.NAME_END}')[1]) AS name FROM l)
SELECT doc_id, nullif(CASE WHEN name = upper(name) AND name <> lower(name) THEN array_to_string([upper(w[1]) || lower(w[2:]) FOR w IN string_split(name, ' ')], ' ') ELSE name END, '') AS full_name, nullif(regexp_extract(text, '{tx.EMAIL}'), '') AS email, trim([x FOR x IN regexp_extract_all(text, '{tx.PHONE}') IF length(regexp_replace(x, '[^0-9]', '', 'g')) BETWEEN 10 AND 13][1]) AS phone FROM n""",
    "head_lines": f"WITH {dc.SQL} SELECT doc_id, trim(string_split_regex([x FOR x IN string_split(text, chr(10)) IF regexp_matches(x, '[^\\x20\\x09-\\x0D]')][1], '[\\x20\\x09]+[(|–—-]')[1]) AS title FROM jd",
    "term_mentions": f"WITH {_NAME_SQL} SELECT doc_id, term, count(DISTINCT start_) AS n, min(start_) AS first_at FROM sp GROUP BY doc_id, term",
    "longest_spans": f"WITH {_NAME_SQL} SELECT doc_id, count(*) AS n, sum(start_)::BIGINT AS places FROM sp a WHERE NOT EXISTS (SELECT 1 FROM sp o WHERE o.doc_id = a.doc_id AND o.start_ <= a.start_ AND o.end_ >= a.end_ AND o.end_ - o.start_ > a.end_ - a.start_) GROUP BY doc_id",
    "span_places": f"""WITH {dc.SQL}, p AS (SELECT doc_id, {_PIECES} AS p FROM rs), x AS (SELECT doc_id, p, unnest(range(1, len(p) + 1)) AS i FROM p)
SELECT doc_id, length(array_to_string(p[1:i - 1], ''))::INTEGER AS start, length(array_to_string(p[1:i], ''))::INTEGER AS end, p[i] AS surface, lower(p[i]) AS term FROM x WHERE lower(p[i]) IN {CERTS!r}""",
    "reading_of_spans": f"WITH {dc.SQL}, {_CERT_LINES}, r AS (SELECT c AS term, CASE w WHEN 2 THEN 'employer' WHEN 3 THEN 'other' ELSE 'holding' END AS reading FROM cl UNION ALL SELECT 'promo', 'holding' FROM cl WHERE w = 4) SELECT term, reading, count(*) AS n FROM r GROUP BY ALL",
    "standards_named": f"WITH {dc.SQL} SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'US GAAP;IFRS 16;ASC 606-10' WHEN 1 THEN 'IFRS' ELSE '' END AS standards FROM rs",
    "years_on_page": f"WITH {dc.SQL} SELECT doc_id, least(2026 - list_min([x::INTEGER FOR x IN regexp_extract_all(text, '[0-9]+') IF regexp_matches(x, '^(19[7-9][0-9]|20[0-9][0-9])$') AND length(x) = 4 AND x <= '2026']), 70)::INTEGER AS years FROM rs",
    "availability_said": f"WITH {dc.SQL} SELECT doc_id, ['immediate', 'two_weeks', 'one_month', 'unknown'][doc_id % 4 + 1] AS availability FROM rs",
    "requirement_lists": f"""WITH {dc.SQL} SELECT doc_id, concat_ws(';', CASE WHEN soft IS NOT NULL THEN 'Hands-on with ' || soft END, CASE WHEN cert IS NOT NULL THEN CASE WHEN doc_id % 4 = 3 THEN 'An active ' || cert || ' licence' ELSE upper(cert) || ' or equivalent (' || other || ')' END END,
  CASE WHEN min_years IS NOT NULL THEN min_years || '+ years in the trade, ' || (min_years + 2) || ' years at best' END) AS must, nice_soft AS nice FROM jd""",
    "numeric_requirements": f"WITH {dc.SQL} SELECT doc_id, min_years, hours_per_week, min_overlap_hours AS overlap_hours FROM jd",
    "section_terms": f"WITH {dc.SQL}, b AS (SELECT DISTINCT lower(p_brand) AS term FROM part) SELECT doc_id, 'required' AS part, soft AS term FROM jd WHERE soft IS NOT NULL UNION ALL SELECT doc_id, 'preferred', lower(nice_soft) FROM jd JOIN b ON term = lower(nice_soft) UNION ALL SELECT doc_id, 'required', lower(nice_soft) FROM jd JOIN b ON term = lower(nice_soft) WHERE soft IS NULL AND cert IS NULL AND min_years IS NULL",
    "jd_qualifications": f"WITH {dc.SQL} SELECT doc_id, cert AS term, doc_id % 4 <> 3 AS accept_equivalents, true AS stated FROM jd WHERE cert IS NOT NULL",
    "qualification_records": f"""WITH {dc.SQL}, {_CERT_LINES},
m AS (SELECT doc_id, c AS term, i, 0 AS part, CASE w WHEN 0 THEN upper(c) ELSE c END AS name, CASE w WHEN 1 THEN 'in_progress' ELSE 'qualified' END AS status, CASE w WHEN 0 THEN (2000 + ki % 20)::INTEGER END AS year, CASE w WHEN 0 THEN upper(c) || ' licence, ' || (2000 + ki % 20) WHEN 1 THEN 'Studying for ' || c ELSE c || ' and part-qualified promo' END AS quote FROM cl WHERE w NOT IN (2, 3)
  UNION ALL SELECT doc_id, 'promo', i, 1, 'promo', CASE WHEN c = 'promo' THEN 'part_qualified' ELSE 'part_qualified' END, NULL, c || ' and part-qualified promo' FROM cl WHERE w = 4),
k AS (SELECT * REPLACE (CASE WHEN term = 'promo' AND quote = 'promo and part-qualified promo' THEN 'part_qualified' ELSE status END AS status) FROM m),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, term ORDER BY status <> 'qualified', i, part) AS n FROM k) SELECT doc_id, term, name, status, year, quote FROM r WHERE n = 1""",
    "position_history": f"WITH {dc.SQL} SELECT doc_id, 'Senior Analyst' AS title, segment || ' Ltd' AS employer, (2024 - years_experience)::INTEGER AS start_year, NULL::INTEGER AS end_year, true AS current FROM rs WHERE years_experience IS NOT NULL UNION ALL SELECT doc_id, 'Junior Analyst', 'Old ' || segment, (2020 - years_experience)::INTEGER, (2024 - years_experience)::INTEGER, false FROM rs WHERE years_experience IS NOT NULL",
    "certificates_read_off": f"""WITH {dc.SQL}, {_CERT_LINES},
l AS (SELECT doc_id, c AS term, i, w, ki, CASE w WHEN 0 THEN '- ' || upper(c) || ' licence, ' || (2000 + ki % 20) WHEN 1 THEN '- Studying for ' || c WHEN 2 THEN '* Audited a ' || c || ' firm' WHEN 3 THEN '- their ' || c ELSE '- ' || c || ' and part-qualified promo' END AS line FROM cl),
a AS (SELECT doc_id, term, i, line, CASE WHEN w = 1 OR w = 4 AND term = 'promo' THEN 1 ELSE 0 END AS open, CASE WHEN w = 0 THEN (2000 + ki % 20)::INTEGER END AS year FROM l UNION ALL SELECT o.doc_id, 'promo', o.i, o.line, 1, NULL FROM l o JOIN l p ON p.doc_id = o.doc_id AND p.term = 'promo' WHERE o.w = 4 AND o.term <> 'promo'),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, term ORDER BY open, i) AS n FROM a) SELECT doc_id, term, line, year FROM r WHERE n = 1""",
    "cleaned_texts": f"""WITH t AS (SELECT doc_id, regexp_replace(chr(13) || chr(10) || chr(10) || replace(text, '. ', '.  ' || chr(13) || chr(10)) || '{UNCLEAN}', '\\r\\n?', chr(10), 'g') AS t FROM documents),
p AS (SELECT doc_id, nfc_normalize(regexp_replace(t, '[\\x00-\\x08\\x0B-\\x1F\\x7F-\\x{{9F}}\\x{{AD}}\\x{{200B}}-\\x{{200D}}\\x{{2060}}\\x{{FEFF}}\\x{{E0000}}-\\x{{E007F}}]', '', 'g')) AS t FROM t)
SELECT doc_id, sha256(regexp_replace(regexp_replace(regexp_replace(replace(replace(t, 'ﬁ', 'fi'), '\ufb05', 'st'), '[\\t \\x{{A0}}\\x{{1680}}\\x{{2000}}-\\x{{200A}}\\x{{2028}}\\x{{2029}}\\x{{202F}}\\x{{205F}}\\x{{3000}}]+(\\n|$)', '\\1', 'g'), '^\\n+', ''), '\\n+$', '')) AS sha FROM p""",
    "comparison_forms": "SELECT doc_id, sha256(trim(regexp_replace(lower(translate(text || ' — It’s', '‐‑‒–—−‘’', '------''''')), '[\\x20\\x09-\\x0D]+', ' ', 'g'))) AS sha FROM documents",
    "hashed_embeddings": f"""WITH r AS (SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS text FROM documents), s AS (SELECT row, unnest(string_split_regex(lower(text), '[\\n;:,()]|\\.[\\x20\\x09-\\x0D]')) AS s FROM r),
w AS (SELECT row, [w FOR w IN regexp_extract_all(s, '[\\p{{L}}\\p{{N}}]+') IF w NOT IN ({_STOP})] AS ws FROM s), t AS (SELECT row, unnest(ws || [ws[i] || ' ' || ws[i + 1] FOR i IN range(1, len(ws))]) AS t FROM w),
a AS (SELECT row, t FROM t UNION ALL SELECT row, text FROM r WHERE row NOT IN (SELECT row FROM t)), c AS (SELECT row, ('0x' || substr(md5(t), 1, 8))::BIGINT AS h, count(*) AS n FROM a GROUP BY row, t),
x AS (SELECT row, h % 64 AS bucket, sum((CASE WHEN (h // 64) % 2 = 0 THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END) * (1 + ln(n))) AS x FROM c GROUP BY 1, 2), m AS (SELECT row, sqrt(sum(x * x)) AS norm FROM x GROUP BY 1)
SELECT doc_id, bucket, round(x / norm, 6) + 0.0::DOUBLE AS weight FROM x JOIN m USING (row) JOIN r USING (row) WHERE norm > 1e-12 UNION ALL SELECT doc_id, 0, 1.0::DOUBLE FROM m JOIN r USING (row) WHERE norm <= 1e-12""",
    "embed_once": "SELECT sha256(coalesce(text, '')) AS key, count(*) AS rows, bool_or(doc_id % 3 = 0) AS hit FROM documents GROUP BY 1",
}
