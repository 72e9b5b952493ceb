"""Resumes and role descriptions rendered from the bound tables, as DataFrames and as SQL for the oracle.

The scalar expressions are valid in both dialects, so that both render the same text; what an extraction must give back is then known from the tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rolemesh.plans import bindings as b

_K = "CAST({} AS VARCHAR(20))".format
HEAD = [
    "replace(full_name, '#', ' ') || CASE k % 3 WHEN 0 THEN ' – Senior Analyst' WHEN 1 THEN ', MBA' ELSE '' END",
    f"'Email: ' || email || '  Tel: ' || CASE WHEN k % 11 = 0 THEN '555-0123' ELSE '+1 (555) ' || lpad({_K('k % 1000')}, 3, '0') || '-' || lpad({_K('k % 10000')}, 4, '0') END",
    "'Based in ' || here || ', formerly ' || there",
    "CASE k % 4 WHEN 0 THEN 'Available immediately' WHEN 1 THEN 'Notice: two weeks' WHEN 2 THEN 'Needs 30 days' ELSE 'Open to offers' END",
    "CASE k % 3 WHEN 0 THEN 'Reporting under US GAAP, IFRS 16 and us gaap; non-GAAP measures; ASC 606-10' WHEN 1 THEN 'Closed the books under IFRS and then ifrs, IFRS' ELSE 'Kept the books' END",
]
WORK = [
    "'EXPERIENCE'",
    f"'Senior Analyst, ' || segment || ' Ltd, ' || {_K('2024 - years')} || ' – present'",
    f"'Junior Analyst, Old ' || segment || ', ' || {_K('2020 - years')} || ' - ' || {_K('2024 - years')}",
]
#: A certification c at place i of the list.
LINE = f"CASE (k + i) % 5 WHEN 0 THEN '- ' || upper(c) || ' licence, ' || {_K('2000 + (k + i) % 20')} WHEN 1 THEN '- Studying for ' || c WHEN 2 THEN '* Audited a ' || c || ' firm' WHEN 3 THEN '- their ' || c ELSE '- ' || c || ' and part-qualified promo' END"
TITLE = "p_name || CASE role_id % 3 WHEN 0 THEN ' (Contract)' WHEN 1 THEN ' - Well-paid' ELSE '' END"
HOURS = f"CASE WHEN hours_per_week IS NOT NULL THEN 'About ' || {_K('hours_per_week')} || ' to 40 hours per week.' ELSE 'Hours by agreement.' END || CASE WHEN min_overlap_hours IS NOT NULL THEN ' We ask for ' || {_K('min_overlap_hours')} || ' hours of overlap.' ELSE '' END"
SOFT = "'- Hands-on with ' || soft || '.'"
CERT = "CASE WHEN role_id % 4 = 3 THEN '- An active ' || cert || ' licence' ELSE '- ' || upper(cert) || ' or equivalent (' || other || ')' END"
YEARS = f"'* ' || {_K('min_years')} || '+ years in the trade, ' || {_K('min_years + 2')} || ' years at best'"
NICE = "'- ' || nice_soft"


def resumes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, text, ...): a resume for each profile; doc_id is the candidate's key."""
    nation = b.table(spark, sf_dir, "nation")
    people = b.table(spark, sf_dir, "customer").selectExpr("c_custkey AS candidate_id", "c_nationkey", "(c_nationkey + 7) % 25 AS other", "c_mktsegment AS segment")
    rows = b.profiles(spark, sf_dir).join(b.candidates(spark, sf_dir).hint("merge"), "candidate_id").join(people.hint("merge"), "candidate_id")
    rows = rows.join(nation.select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("here")), "c_nationkey").join(nation.select(F.col("n_nationkey").alias("other"), F.col("n_name").alias("there")), "other")
    rows = rows.withColumns({"k": F.col("candidate_id"), "years": F.col("years_experience")})
    certs = f"concat(array('CERTIFICATIONS'), transform(certifications, (c, i) -> {LINE}))"
    soft = "CASE WHEN size(software) > 0 THEN array('SOFTWARE', 'Uses ' || array_join(software, ', ')) ELSE cast(array() AS array<string>) END"
    work = f"CASE WHEN years IS NOT NULL THEN array({', '.join(WORK)}) ELSE cast(array() AS array<string>) END"
    text = f"array_join(concat(array({', '.join(HEAD)}), {work}, {certs}, {soft}), chr(10))"
    return rows.selectExpr("candidate_id AS doc_id", f"{text} AS text", "full_name", "email", "certifications", "software", "years_experience", "here", "there", "segment")


def descriptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, text, ...): a description for each role; doc_id is the role's key."""
    parts = b.table(spark, sf_dir, "part").selectExpr("p_partkey AS role_id", "p_name", "'Brand#' || cast(p_size % 25 + 1 AS string) AS nice_soft", "CASE lower(p_type) WHEN 'promo' THEN 'large' ELSE 'promo' END AS other")
    rows = b.roles(spark, sf_dir).join(parts.hint("merge"), "role_id").selectExpr("*", "get(required_software, 0) AS soft", "get(required_certifications, 0) AS cert")
    text = f"concat_ws(chr(10), {TITLE}, 'Acme Co', '', {HOURS}, 'Requirements', CASE WHEN soft IS NOT NULL THEN {SOFT} END, CASE WHEN cert IS NOT NULL THEN {CERT} END, CASE WHEN min_years IS NOT NULL THEN {YEARS} END, 'Nice-to-haves', {NICE}, 'About us', '- Friendly people')"
    return rows.selectExpr("role_id AS doc_id", f"{text} AS text", "soft", "cert", "other", "nice_soft", "min_years", "hours_per_week", "min_overlap_hours", "p_name", "timezone")


def _duck(text: str) -> str:
    return text.replace("\n", " ")


SQL = f"""{b.SQL},
rs AS MATERIALIZED (SELECT k AS doc_id, array_to_string([{', '.join(HEAD)}] || (CASE WHEN years IS NOT NULL THEN [{', '.join(WORK)}] ELSE []::VARCHAR[] END) || ['CERTIFICATIONS'] || [{LINE.replace('(k + i)', '(k + i - 1)')} FOR c, i IN certifications]
  || (CASE WHEN len(software) > 0 THEN ['SOFTWARE', 'Uses ' || array_to_string(software, ', ')] ELSE []::VARCHAR[] END), chr(10)) AS text, * EXCLUDE (k)
  FROM (SELECT prof.candidate_id AS k, prof.*, full_name, email, years_experience AS years, h.n_name AS here, t.n_name AS there, c_mktsegment AS segment FROM prof JOIN cand USING (candidate_id) JOIN customer ON c_custkey = prof.candidate_id JOIN nation h ON h.n_nationkey = c_nationkey JOIN nation t ON t.n_nationkey = (c_nationkey + 7) % 25)),
jd AS MATERIALIZED (SELECT role_id AS doc_id, concat_ws(chr(10), {TITLE}, 'Acme Co', '', {HOURS}, 'Requirements', CASE WHEN soft IS NOT NULL THEN {SOFT} END, CASE WHEN cert IS NOT NULL THEN {CERT} END, CASE WHEN min_years IS NOT NULL THEN {YEARS} END, 'Nice-to-haves', {NICE}, 'About us', '- Friendly people') AS text, *
  FROM (SELECT role.*, p_name, 'Brand#' || (p_size % 25 + 1) AS nice_soft, CASE lower(p_type) WHEN 'promo' THEN 'large' ELSE 'promo' END AS other, required_software[1] AS soft, required_certifications[1] AS cert FROM role JOIN part ON p_partkey = role_id))
"""
