"""Queries on reasons, texts, levels and explanations, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from rolemesh.operators import funnel as fn
from rolemesh.operators import reasons as rs
from rolemesh.operators import rerank as rr
from rolemesh.operators import text as tx
from rolemesh.plans import bindings as b
from rolemesh.plans import documents as dc
from rolemesh.plans.funnel_queries import RANKED, STAGES, asked_and_held, overlaps, shortlists, zones
from rolemesh.plans.review_queries import MATCHES, matches_before
from rolemesh.plans.text_queries import CERTS
from rolemesh.plans.text_queries import ORACLES as TEXT
from rolemesh.sources.scratch import kept

CERT_NAMES = [(c, c) for c in CERTS]


def _pairs(spark, d):
    return matches_before(spark, d).select("role_id", "candidate_id")


def _terms(spark):
    return b.terms(spark).withColumn("label", F.initcap("id"))


def verdicts(spark, d):
    return rs.qualification_verdicts(_pairs(spark, d), b.roles(spark, d), b.profiles(spark, d), _terms(spark))


def misses(spark, d):
    names = spark.createDataFrame(CERT_NAMES, "name string, term string")
    records = tx.qualification_records(dc.resumes(spark, d), names).select(F.col("doc_id").alias("candidate_id"), F.col("term").alias("pos"), F.col("term").alias("id"), "name", "status")
    labels = spark.createDataFrame([("g0", "Full"), ("g1", "Technician"), ("g2", "Specialist")], "grp string, group_label string")
    failed = verdicts(spark, d).where("NOT passed AND held IS NULL").select("role_id", "candidate_id", "required")
    return rs.nearest_misses(failed, records, _terms(spark), labels)


def availability_verdicts(spark, d):
    v = rs.availability_verdicts(_pairs(spark, d), b.roles(spark, d), b.availability(spark, d), overlaps(spark, d), zones(spark), b.TODAY)
    return v.withColumn("reasons", F.array_join("reasons", "; "))


def _people(spark, d):
    r = dc.resumes(spark, d)
    return r.selectExpr("doc_id AS candidate_id", "CASE WHEN doc_id % 4 <> 0 THEN text WHEN doc_id % 8 = 0 THEN '  ' END AS resume", "CASE WHEN doc_id % 3 = 0 THEN ' Analyst' END AS headline", "certifications", "software")


def _roles(spark, d):
    docs = dc.descriptions(spark, d)
    return docs.join(tx.sections(docs), "doc_id").selectExpr("doc_id AS role_id", "p_name AS title", "CASE WHEN doc_id % 2 = 0 THEN ' Acme ' END AS company", "text AS description", "must AS must_haves", "nice AS nice_to_haves", "CASE WHEN cert IS NULL THEN cast(array() AS array<string>) ELSE array(cert) END AS required_certifications", "CASE WHEN soft IS NULL THEN cast(array() AS array<string>) ELSE array(soft) END AS required_software", "min_years")


def batched(spark, d):
    texts = rr.candidate_texts(_people(spark, d)).select("candidate_id", F.length("text").alias("chars"))
    return rr.batches(kept(shortlists(spark, d), "shortlist").join(kept(texts, "lengths").hint("merge"), "candidate_id"))


def term_levels(spark, d):
    names = b.table(spark, d, "part").select(F.col("p_brand").alias("name"), F.lower("p_brand").alias("term")).distinct().union(spark.createDataFrame(CERT_NAMES, "name string, term string"))
    wanted = tx.mentions(dc.descriptions(spark, d), names).select(F.col("doc_id").alias("role_id"), "term")
    named = tx.mentions(dc.resumes(spark, d), names).select(F.col("doc_id").alias("candidate_id"), "term")
    pairs = _pairs(spark, d).join(b.profiles(spark, d).select("candidate_id"), "candidate_id", "left_semi")
    return rr.term_levels(pairs, wanted, named).select("role_id", "candidate_id", "level", F.array_join("has", ";").alias("has"), F.array_join("lacks", ";").alias("lacks"))


def overlap_levels(spark, d):
    return rr.overlap_levels(_pairs(spark, d), dc.descriptions(spark, d).select(F.col("doc_id").alias("role_id"), "text"), dc.resumes(spark, d).select(F.col("doc_id").alias("candidate_id"), "text"))


def completeness(spark, d):
    asked = matches_before(spark, d).select("role_id", "candidate_id")
    s = F.col("role_id") + F.col("candidate_id")
    levels = [F.when(F.col("candidate_id") % 5 != 0, F.col("candidate_id") % 5).alias("l0"), F.lit(1).alias("l1"), F.lit(None).cast("int").alias("l2")]
    good = asked.where(s % 7 != 0).select("role_id", "candidate_id", *levels)
    odd = asked.where(s % 13 == 0).select("role_id", (F.col("candidate_id") + 10_000_000).alias("candidate_id"), *levels)
    return rr.completeness(asked, good.union(asked.where((s % 11 == 0) & (s % 7 != 0)).select("role_id", "candidate_id", *levels)).union(odd), ["l0", "l1", "l2"])


def _results(spark, d):
    return matches_before(spark, d).selectExpr("role_id", "candidate_id", "score", "candidate_id % 3 AS batch", "candidate_id AS pos", "CASE WHEN role_id % 13 = 0 AND candidate_id % 3 = 2 THEN '2' ELSE '1' END AS rubric_version")


def explained(spark, d):
    m = matches_before(spark, d)
    levels = [F.when((F.col("candidate_id") + k) % 6 < 5, (F.col("candidate_id") + k) % 6).cast("int") for k in range(5)]
    evidence = [F.concat(F.lit(" evidence "), F.lit(str(k))) if k % 2 else F.lit("  ") for k in range(5)]
    reasons = F.array(F.lit("  "), F.when(F.col("role_id") % 2 == 0, " names it ").otherwise(""))
    made = rr.breakdown(F.col("match_id"), F.col("run_rank"), F.col("score"), F.lit("1"), levels, reasons)
    return m.select("match_id", rr.explanation(levels, evidence, reasons).alias("explanation"), made.alias("breakdown"))


QUERIES = {
    "qualification_verdicts": verdicts,
    "nearest_misses": misses,
    "shortfalls": lambda s, d: rs.shortfalls(_pairs(s, d), b.roles(s, d), b.profiles(s, d)).withColumn("missing", F.array_join("missing", ";")),
    "availability_verdicts": availability_verdicts,
    "hours_wording": lambda s, d: overlaps(s, d).where("minutes IS NOT NULL").select(F.col("minutes"), rs.hours(F.col("minutes")).alias("words")).distinct(),
    "hard_filter_truth": lambda s, d: fn.experienced_totals(*asked_and_held(s, d)),
    "candidate_texts": lambda s, d: rr.candidate_texts(_people(s, d)),
    "role_texts": lambda s, d: rr.role_texts(_roles(s, d), 400),
    "rerank_batches": batched,
    "term_levels": term_levels,
    "overlap_levels": overlap_levels,
    "answer_completeness": completeness,
    "merged_batches": lambda s, d: rr.merged_batches(_results(s, d)),
    "explanations": explained,
}


def mention_sql(name: str, table: str) -> str:
    """CTEs for the one- and two-word names of `tn` (name, term) in a table (doc_id, text)."""
    return f"""{name}p AS (SELECT doc_id, regexp_extract_all(text, '[A-Za-z0-9]+|[^A-Za-z0-9]+') AS p FROM {table}), {name}x AS (SELECT doc_id, p, unnest(range(1, len(p) + 1)) AS i FROM {name}p),
{name} AS MATERIALIZED (SELECT DISTINCT doc_id, term FROM (SELECT doc_id, p[i] AS s FROM {name}x UNION ALL SELECT doc_id, array_to_string(p[i:i + 2], '') FROM {name}x WHERE i + 2 <= len(p)) JOIN tn ON lower(s) = lower(name) AND (length(name) > 4 OR s = name))"""


_ACC = STAGES[STAGES.index("ambiguous AS"):STAGES.index("needs AS")]
_MIN = STAGES[STAGES.index("days AS"):STAGES.index("open_role AS")].rstrip().rstrip(",")
_V = f"""{_ACC} lv AS (SELECT required, id, min(accept::INTEGER) AS eq FROM acc GROUP BY 1, 2),
ask AS MATERIALIZED (SELECT mt.role_id, mt.candidate_id, coalesce(accept_equivalents, true) AS accepts, required_certifications[1] AS required FROM mt JOIN role USING (role_id) WHERE len(required_certifications) > 0),
hd AS (SELECT candidate_id, unnest(certifications) AS id, unnest(range(len(certifications))) AS at_ FROM prof),
bs AS (SELECT role_id, candidate_id, min({{'g': CASE WHEN eq = 0 THEN 0 WHEN accepts THEN 1 ELSE 2 END, 'a': at_, 'id': hd.id}}) AS b FROM ask JOIN hd USING (candidate_id) JOIN lv ON lv.required = ask.required AND lv.id = hd.id GROUP BY 1, 2),
vd AS MATERIALIZED (SELECT role_id, candidate_id, required, b.g AS g, accepts, b.id AS held, upper(required[1]) || required[2:] AS asked, upper(b.id[1]) || b.id[2:] AS shown FROM ask LEFT JOIN bs USING (role_id, candidate_id)),
vr AS MATERIALIZED (SELECT role_id, candidate_id, required, coalesce(g < 2, false) AS passed, held, asked, CASE g WHEN 0 THEN 'Holds ' || shown || ', which this role asks for' WHEN 1 THEN 'Holds ' || shown || ', equivalent to the ' || asked || ' this role asks for'
  WHEN 2 THEN 'Holds ' || shown || ', the same level as a ' || asked || ', but this role requires the ' || asked || ' itself' ELSE 'No ' || asked || CASE WHEN accepts THEN ' or equivalent' ELSE '' END || ' on the resume' END AS reason FROM vd)"""
_DOCS = dc.SQL.split(b.SQL + ",", 1)[1]
_RECORDS = TEXT["qualification_records"].split(dc.SQL + ",", 1)[1]
_CTES, _LAST = _RECORDS.rsplit(") SELECT", 1)
_PEOPLE = "pe AS (SELECT doc_id AS candidate_id, CASE WHEN doc_id % 4 <> 0 THEN text WHEN doc_id % 8 = 0 THEN '  ' END AS resume, CASE WHEN doc_id % 3 = 0 THEN 'Analyst' END AS headline, certifications, software FROM rs), ct AS (SELECT candidate_id, coalesce(nullif(trim(resume), ''), concat_ws(chr(10), headline, CASE WHEN len(certifications) > 0 THEN 'Certifications: ' || array_to_string(certifications, ', ') END, CASE WHEN len(software) > 0 THEN 'Software: ' || array_to_string(software, ', ') END)) AS text FROM pe)"
_W = "list_distinct(regexp_extract_all(lower({}), '[a-z][a-z0-9&+/-]{{3,}}'))"
_LEVEL = " || chr(10) || ".join(
    f"'{label}' || CASE WHEN (candidate_id + {k}) % 6 = 5 THEN ': not scored for this role.' ELSE ': ' || ['none', 'weak', 'partial', 'strong', 'full'][(candidate_id + {k}) % 6 + 1] || ' (' || (candidate_id + {k}) % 6 || '/4).' END" + (f" || ' evidence {k}'" if k % 2 else "")
    for k, label in enumerate(rr.DIMENSIONS)
)
ORACLES = {
    "qualification_verdicts": f"WITH {MATCHES}, {_V} SELECT role_id, candidate_id, required, passed, held, reason FROM vr",
    "nearest_misses": f"""WITH {MATCHES}, {_DOCS}, {_V}, {_CTES}), rc AS (SELECT {_LAST}),
gl AS (SELECT * FROM (VALUES ('g0', 'full'), ('g1', 'technician'), ('g2', 'specialist')) t(grp, gname)), ms AS (SELECT v.role_id, v.candidate_id, v.required, rc.term AS near, rc.name, rc.status, asked, gname, CASE WHEN rc.status <> 'qualified' AND EXISTS (SELECT 1 FROM lv WHERE lv.required = v.required AND lv.id = rc.term) THEN 0
  WHEN rc.status = 'qualified' AND rc.term = 'standard' AND t.grp = w.grp THEN 1 WHEN rc.status = 'qualified' AND t.grp <> w.grp THEN 2 END AS kind FROM vr v JOIN rc ON rc.doc_id = v.candidate_id JOIN term t ON t.id = rc.term JOIN term w ON w.id = v.required JOIN gl ON gl.grp = t.grp WHERE NOT passed AND held IS NULL),
bk AS (SELECT *, row_number() OVER (PARTITION BY role_id, candidate_id, required ORDER BY kind > 0, near) AS k FROM ms WHERE kind IS NOT NULL)
SELECT role_id, candidate_id, required, near, CASE kind WHEN 0 THEN CASE status WHEN 'part_qualified' THEN 'Part-qualified ' ELSE 'Studying for ' END || name || ': not yet qualified, so it does not meet the ' || asked || ' requirement'
  WHEN 1 THEN 'Holds ' || name || ' but the resume does not say which body or country awarded it, so it cannot be matched to the ' || asked || ' this role asks for' ELSE 'Holds ' || name || ', which is a different level (' || gname || ') and not equivalent to the ' || asked || ' this role asks for' END AS reason FROM bk WHERE k = 1""",
    "shortfalls": f"WITH {MATCHES} SELECT mt.role_id, mt.candidate_id, array_to_string([x FOR x IN required_software IF NOT list_contains(software, x)], ';') AS missing, CASE WHEN min_years > 0 AND NOT coalesce(years_experience >= min_years, false) THEN CASE WHEN years_experience IS NULL THEN 'The resume does not show how many years of experience' ELSE 'Has ' || years_experience || CASE WHEN years_experience = 1 THEN ' year' ELSE ' years' END || ' of experience' END || '; this role asks for at least ' || min_years END AS experience FROM mt JOIN role USING (role_id) JOIN prof USING (candidate_id)",
    "availability_verdicts": f"""WITH {MATCHES}, {_MIN}, j AS (SELECT mt.role_id, mt.candidate_id, a.candidate_id IS NOT NULL AS answered, a.timezone AS zone, a.hours_per_week AS hours, available_from, r.starts_on, r.hours_per_week AS asked, r.timezone AS role_zone, min_overlap_hours AS mo, m.minutes FROM mt JOIN role r USING (role_id) LEFT JOIN avail a USING (candidate_id)
  LEFT JOIN minutes m ON m.role_zone = r.timezone AND m.day = coalesce(r.starts_on, DATE '{b.TODAY}') AND m.zone = a.timezone AND m.work_start = a.work_start AND m.work_end = a.work_end),
t AS (SELECT *, concat_ws('; ', CASE WHEN NOT answered THEN 'Has not given their time zone, working hours, hours per week and start date' END, CASE WHEN available_from > starts_on THEN 'Available from ' || available_from || '; this role starts on ' || starts_on END, CASE WHEN hours < asked THEN 'Offers ' || hours || ' hours a week; this role needs ' || asked END,
  CASE WHEN answered AND role_zone IS NOT NULL THEN CASE WHEN zone = 'XYZ5' THEN 'Time zone "XYZ5" is not one the overlap can be worked out for' WHEN minutes < 60 * mo THEN 'Working hours overlap the role''s day (09:00 to 17:00 ' || role_zone || ') by ' || CASE WHEN minutes = 60 THEN '1 hour' WHEN minutes % 60 = 0 THEN minutes // 60 || ' hours' ELSE minutes / 60.0::DOUBLE || ' hours' END || '; this role needs ' || mo END END) AS reasons FROM j)
SELECT role_id, candidate_id, reasons = '' AS passed, reasons, minutes AS overlap_minutes FROM t""",
    "hours_wording": f"WITH {b.SQL}, {_MIN} SELECT DISTINCT minutes, CASE WHEN minutes = 60 THEN '1 hour' WHEN minutes % 60 = 0 THEN minutes // 60 || ' hours' ELSE minutes / 60.0::DOUBLE || ' hours' END AS words FROM minutes WHERE minutes IS NOT NULL",
    "hard_filter_truth": f"WITH {STAGES} SELECT role_id, count(*) AS n, sum(candidate_id)::BIGINT AS ids FROM staged WHERE cleared > 3 GROUP BY role_id",
    "candidate_texts": f"WITH {dc.SQL}, {_PEOPLE} SELECT * FROM ct WHERE text <> ''",
    "role_texts": f"""WITH {dc.SQL}, s AS (SELECT doc_id, text, 'Title: ' || p_name || chr(10) || CASE WHEN doc_id % 2 = 0 THEN 'Company: Acme' || chr(10) ELSE '' END AS head, concat_ws(chr(10), '- ' || CASE WHEN soft IS NOT NULL THEN 'Hands-on with ' || soft END, '- ' || CASE WHEN cert IS NOT NULL THEN CASE WHEN doc_id % 4 = 3 THEN 'An active ' || cert || ' licence' ELSE upper(cert) || ' or equivalent (' || other || ')' END END,
  '- ' || CASE WHEN min_years IS NOT NULL THEN min_years || '+ years in the trade, ' || (min_years + 2) || ' years at best' END) AS must, nice_soft, concat_ws(chr(10), '- certifications: ' || cert, '- software: ' || soft, '- minimum years of experience: ' || min_years) AS needs FROM jd),
t AS (SELECT *, CASE WHEN must <> '' THEN chr(10) || 'Must-haves:' || chr(10) || must || chr(10) ELSE '' END || chr(10) || 'Nice-to-haves:' || chr(10) || '- ' || nice_soft || chr(10) || CASE WHEN needs <> '' THEN chr(10) || 'Required, as taxonomy ids:' || chr(10) || needs || chr(10) ELSE '' END AS tail FROM s),
b AS (SELECT *, greatest(400 - length(head) - length(tail) - 2, 0) AS room FROM t), c AS (SELECT *, CASE WHEN length(trim(text)) > room THEN trim(left(trim(text), room)) ELSE trim(text) END AS body FROM b),
w AS (SELECT doc_id, regexp_replace(head || CASE WHEN body <> '' THEN chr(10) || body || chr(10) ELSE '' END || tail, '^\\s+|\\s+$', '', 'g') AS text FROM c) SELECT doc_id AS role_id, CASE WHEN length(text) > 400 THEN trim(left(text, 400)) ELSE text END AS text FROM w""",
    "term_levels": f"""WITH {MATCHES}, {_DOCS}, tn AS (SELECT DISTINCT p_brand AS name, lower(p_brand) AS term FROM part UNION ALL SELECT id, id FROM term), {mention_sql('jm', 'jd')}, {mention_sql('rm', 'rs')},
e AS (SELECT mt.role_id, mt.candidate_id, jm.term, rm.term IS NOT NULL AS there FROM mt JOIN prof USING (candidate_id) JOIN jm ON jm.doc_id = mt.role_id LEFT JOIN rm ON rm.doc_id = mt.candidate_id AND rm.term = jm.term),
a AS (SELECT role_id, candidate_id, round_even(4.0::DOUBLE * count(*) FILTER (there) / count(*), 0)::INTEGER AS level, string_agg(term, ';' ORDER BY term) FILTER (there) AS has, string_agg(term, ';' ORDER BY term) FILTER (NOT there) AS lacks FROM e GROUP BY 1, 2)
SELECT mt.role_id, mt.candidate_id, level, coalesce(has, '') AS has, coalesce(lacks, '') AS lacks FROM mt JOIN prof USING (candidate_id) LEFT JOIN a USING (role_id, candidate_id)""",
    "overlap_levels": f"""WITH {MATCHES}, {_DOCS}, rw AS MATERIALIZED (SELECT doc_id AS role_id, {_W.format('text')} AS w FROM jd), cw AS MATERIALIZED (SELECT doc_id AS candidate_id, {_W.format('text')} AS c, string_split(text, chr(10)) AS ls FROM rs),
cl AS MATERIALIZED (SELECT candidate_id, c, [{{'l': trim(regexp_replace(x, '{tx.BULLET}', '')), 'w': {_W.format('x')}}} FOR x IN ls] AS ls FROM cw),
p AS (SELECT mt.role_id, mt.candidate_id, len(list_intersect(w, c)) / nullif(len(w), 0)::DOUBLE AS share, list_max([{{'n': len(list_intersect(w, y.w)), 'i': -i, 'l': y.l}} FOR y, i IN ls]).l AS line FROM mt JOIN rw USING (role_id) JOIN cl USING (candidate_id))
SELECT role_id, candidate_id, round_even(least(coalesce(share, 0) * 2, 1.0) * 4, 0)::INTEGER AS level, CASE WHEN length(line) > 300 THEN regexp_replace(left(line, 300), '\\s+\\S*$', '') ELSE line END AS line FROM p""",
    "answer_completeness": f"WITH {MATCHES}, k AS (SELECT role_id, candidate_id, role_id + candidate_id AS s FROM mt) SELECT role_id, count(*) FILTER (s % 7 = 0) AS missing, count(*) FILTER (s % 13 = 0) AS unknown, count(*) FILTER (s % 11 = 0 AND s % 7 <> 0) AS repeated, (count(*) FILTER (candidate_id % 5 <> 0 AND (s % 7 <> 0 OR s % 13 = 0)) > 0 AND count(*) FILTER (candidate_id % 5 = 0 AND (s % 7 <> 0 OR s % 13 = 0)) > 0)::INTEGER AS uneven FROM k GROUP BY role_id",
    "merged_batches": f"WITH {MATCHES}, r AS (SELECT role_id, candidate_id, score, candidate_id % 3 AS batch, CASE WHEN role_id % 13 = 0 AND candidate_id % 3 = 2 THEN '2' ELSE '1' END AS v FROM mt), o AS (SELECT role_id FROM r GROUP BY 1 HAVING count(DISTINCT v) = 1) SELECT role_id, candidate_id, score, (row_number() OVER (PARTITION BY role_id ORDER BY score DESC, batch, candidate_id))::INTEGER AS rank FROM r WHERE role_id IN (SELECT role_id FROM o)",
    "explanations": f"""WITH {MATCHES} SELECT match_id, CASE WHEN role_id % 2 = 0 THEN 'names it' || chr(10) || chr(10) ELSE '' END || {_LEVEL} AS explanation,
  '{{"filter_run_id":' || match_id || CASE WHEN run_rank IS NOT NULL THEN ',"rank":' || run_rank ELSE '' END || ',"similarity":' || score || ',"rubric_version":"1","dimensions":{{' || concat_ws(',', {', '.join(f"CASE WHEN (candidate_id + {k}) % 6 < 5 THEN '\"d{k}\":' || (candidate_id + {k}) % 6 END" for k in range(5))}) || '}},"reasons":["  ","' || CASE WHEN role_id % 2 = 0 THEN ' names it ' ELSE '' END || '"]}}' AS breakdown FROM mt""",
}
ORACLES["rerank_batches"] = f"""WITH {RANKED}, {_DOCS}, {_PEOPLE}, l AS (SELECT role_id, rank, candidate_id, row_number() OVER (PARTITION BY role_id ORDER BY rank) AS n FROM listed JOIN ct USING (candidate_id) WHERE text <> '') SELECT role_id, rank, candidate_id, ((n - 1) // 10)::INTEGER AS batch FROM l"""
