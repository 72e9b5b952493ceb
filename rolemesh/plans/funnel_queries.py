"""Queries of the hard-filter funnel on the bound tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from rolemesh.operators import funnel as fn
from rolemesh.plans import bindings as b
from rolemesh.sources.scratch import kept


def zones(spark):
    return spark.createDataFrame([(z,) for z in b.ZONES], "zone string")


def asked_held_pool(spark, d, roles=None):
    """What open roles ask for, who holds their skills, and everybody they are taken from; each written once."""
    asked, pool = kept(fn.asked_of(b.roles(spark, d) if roles is None else roles, b.terms(spark), b.TODAY), "asked"), _pool(spark, d)
    return asked, kept(fn.holders(asked, pool), "holders"), pool


def asked_and_held(spark, d, roles=None):
    return asked_held_pool(spark, d, roles)[:2]


def _pool(spark, d):
    return kept(fn.pool_of(b.candidates(spark, d), b.profiles(spark, d), b.availability(spark, d)), "pool")


def counts_of(spark, d, asked, held, pool, clock=None):
    """The funnel; who has a profile is read off the pool, which is written, and not worked out of all lines again."""
    return fn.funnel(asked, kept(fn.signatures(held), "signatures"), b.candidates(spark, d), pool.select("candidate_id"), zones(spark), clock)


def funnel_of(spark, d, roles):
    asked, pool = kept(fn.asked_of(roles, b.terms(spark), b.TODAY), "asked"), _pool(spark, d)
    return counts_of(spark, d, asked, fn.holders(asked, pool), pool)


def role_funnel(spark, d):
    return funnel_of(spark, d, b.roles(spark, d))


def acceptable(spark, d):
    return fn.acceptable_sets(b.roles(spark, d), b.terms(spark)).select("role_id", F.array_join(F.flatten("sets"), ",").alias("ids"))


def overlaps(spark, d):
    days = b.roles(spark, d).where("timezone IS NOT NULL").select(F.col("timezone").alias("role_zone"), F.coalesce("starts_on", F.lit(b.TODAY).cast("date")).alias("day")).distinct()
    shifts = b.availability(spark, d).select(F.col("timezone").alias("zone"), "work_start", "work_end").distinct()
    every = days.agg(F.collect_set(F.struct("role_zone", "day"))).scalar()  # zones of the world by days of the calendar
    return fn.overlap_minutes(shifts.select("*", F.explode(every).alias("x")).select("x.*", *shifts.columns), zones(spark))


def vectors_of(spark, d):
    """Vectors of roles and of candidates that can be compared, each written once."""
    return kept(fn.comparable(b.role_vectors(spark, d), "role_id"), "vectors"), kept(fn.comparable(b.candidate_vectors(spark, d), "candidate_id"), "vectors")


def shortlist_of(spark, d, asked, held):
    return fn.shortlist(asked, held, b.role_vectors(spark, d), b.candidate_vectors(spark, d), zones(spark))


def shortlists(spark, d):
    return shortlist_of(spark, d, *asked_and_held(spark, d))


def unranked(spark, d):
    asked, held = asked_and_held(spark, d)
    return fn.unranked(asked, held, b.role_vectors(spark, d), b.candidate_vectors(spark, d), zones(spark))


def run_records(spark, d):
    """Clocks and vectors are written once for all parts, and who could not be ranked is counted where the blocks meet."""
    asked, held, pool = asked_held_pool(spark, d)
    clock, vectors = fn.asked_clocks(asked, zones(spark)), vectors_of(spark, d)
    days = fn.days_of(clock)
    counts = kept(counts_of(spark, d, asked, held, pool, clock), "counts")
    listed = kept(fn.ranked(asked, held, *vectors, days), "shortlist")
    return fn.run_record(counts, asked, listed, fn.apart(asked, held, *vectors, days, counts=True), b.role_vectors(spark, d))


QUERIES = {
    "role_funnel": role_funnel,
    "cleared_stages": lambda s, d: fn.cleared_counts(role_funnel(s, d)),
    "stage_exclusions": lambda s, d: fn.exclusions(role_funnel(s, d)),
    "funnel_text": lambda s, d: fn.rendered(role_funnel(s, d)),
    "acceptable_sets": acceptable,
    "overlap_minutes": overlaps,
    "shortlists": shortlists,
    "unranked_candidates": unranked,
    "passed_candidates": lambda s, d: fn.passed_in_order(*asked_and_held(s, d), zones(s)),
    "run_records": run_records,
}

STAGES = f"""{b.SQL},
ambiguous AS (SELECT DISTINCT variant_of AS id FROM term WHERE variant_of IS NOT NULL),
acc AS (SELECT id AS required, f AS accept, id FROM term, (VALUES (true), (false)) t(f) UNION SELECT variant_of, f, id FROM term, (VALUES (true), (false)) t(f) WHERE variant_of IS NOT NULL
  UNION SELECT a.id, true, m.id FROM term a JOIN term m USING (grp) WHERE m.id NOT IN (SELECT id FROM ambiguous)),
needs AS (SELECT role_id, coalesce(accept_equivalents, true) AS accept_equivalents, unnest(required_certifications) AS required FROM role),
sets AS MATERIALIZED (SELECT role_id, list_sort(list(DISTINCT id)) AS ids FROM needs LEFT JOIN acc ON acc.required = needs.required AND accept = accept_equivalents GROUP BY role_id),
days AS (SELECT DISTINCT timezone AS role_zone, coalesce(starts_on, DATE '{b.TODAY}') AS day FROM role WHERE timezone IS NOT NULL),
shifts AS (SELECT DISTINCT timezone AS zone, work_start, work_end FROM avail),
clocks AS MATERIALIZED (SELECT role_zone, day, zone, hour(l) * 60 + minute(l) AS mins FROM (SELECT role_zone, day, zone, (((day::TIMESTAMP + to_minutes(540 + i)) AT TIME ZONE role_zone) AT TIME ZONE (CASE WHEN zone = 'XYZ5' THEN 'UTC' ELSE zone END)) AS l FROM days, (SELECT DISTINCT zone FROM shifts), range(480) t(i))),
minutes AS MATERIALIZED (SELECT role_zone, day, zone, work_start, work_end, CASE WHEN zone <> 'XYZ5' THEN (count(*) FILTER (CASE WHEN work_end > work_start THEN mins >= work_start AND mins < work_end ELSE mins >= work_start OR mins < work_end END))::INTEGER END AS minutes FROM clocks JOIN shifts USING (zone) GROUP BY role_zone, day, zone, work_start, work_end),
open_role AS MATERIALIZED (SELECT role.*, sets.ids, coalesce(starts_on, DATE '{b.TODAY}') AS day FROM role LEFT JOIN sets USING (role_id) WHERE status = 'open'),
person AS MATERIALIZED (SELECT c.candidate_id, c.full_name, p.candidate_id IS NOT NULL AS has_profile, certifications, software, years_experience, a.candidate_id IS NOT NULL AS answered, a.timezone AS zone, work_start, work_end, a.hours_per_week AS hours, available_from
  FROM cand c LEFT JOIN prof p USING (candidate_id) LEFT JOIN avail a USING (candidate_id) WHERE c.status = 'active'),
early AS MATERIALIZED (SELECT r.role_id, p.candidate_id, p.full_name, r.timezone AS role_zone, r.day, r.min_overlap_hours, zone, work_start, work_end, CASE WHEN NOT has_profile THEN 0
  WHEN NOT (r.ids IS NULL OR coalesce(list_has_any(r.ids, p.certifications), false)) THEN 1
  WHEN NOT coalesce(list_has_all(p.software, r.required_software), false) THEN 2
  WHEN NOT (coalesce(r.min_years, 0) = 0 OR coalesce(p.years_experience >= r.min_years, false)) THEN 3
  WHEN NOT (answered AND (r.starts_on IS NULL OR available_from <= r.starts_on) AND (r.hours_per_week IS NULL OR hours >= r.hours_per_week)) THEN 4 ELSE 5 END AS early FROM open_role r CROSS JOIN person p),
staged AS MATERIALIZED (SELECT e.role_id, candidate_id, full_name, CASE WHEN early = 5 AND (CASE WHEN e.role_zone IS NULL THEN min_overlap_hours IS NULL ELSE coalesce(m.minutes >= 60 * coalesce(min_overlap_hours, 0), false) END) THEN 6 ELSE early END AS cleared
  FROM early e LEFT JOIN minutes m ON e.early = 5 AND m.role_zone = e.role_zone AND m.day = e.day AND m.zone = e.zone AND m.work_start = e.work_start AND m.work_end = e.work_end),
fun AS MATERIALIZED (SELECT role_id, count(*) AS pool, count(*) FILTER (cleared > 0) AS after_profile, count(*) FILTER (cleared > 1) AS after_certifications, count(*) FILTER (cleared > 2) AS after_software,
  count(*) FILTER (cleared > 3) AS after_experience, count(*) FILTER (cleared > 4) AS after_availability, count(*) FILTER (cleared > 5) AS after_overlap FROM staged GROUP BY role_id),
excl AS (SELECT role_id, unnest([1, 2, 3, 4, 5, 6])::INTEGER AS stage, unnest(['profile', 'certifications', 'software', 'experience', 'availability', 'overlap']) AS filter,
  unnest([after_profile, after_certifications, after_software, after_experience, after_availability, after_overlap]) AS remaining,
  unnest([pool - after_profile, after_profile - after_certifications, after_certifications - after_software, after_software - after_experience, after_experience - after_availability, after_availability - after_overlap]) AS excluded FROM fun),
topf AS (SELECT role_id, filter AS top_filter, excluded AS top_excluded FROM (SELECT *, row_number() OVER (PARTITION BY role_id ORDER BY excluded DESC, stage) AS k FROM excl WHERE stage > 1) WHERE k = 1 AND excluded > 0)
"""
RANKED = f"""{STAGES},
cnorm AS MATERIALIZED (SELECT *, sqrt(list_reduce([x * x FOR x IN v], lambda s, x: s + x)) AS norm FROM cvec),
rnorm AS MATERIALIZED (SELECT *, sqrt(list_reduce([x * x FOR x IN v], lambda s, x: s + x)) AS norm FROM rvec),
near AS MATERIALIZED (SELECT s.role_id, s.candidate_id, s.full_name, CASE WHEN c.model IS NOT DISTINCT FROM r.model THEN 1 - list_reduce([x * r.v[i] FOR x, i IN c.v], lambda s, x: s + x) / nullif(c.norm * r.norm, 0) END AS distance
  FROM staged s LEFT JOIN cnorm c USING (candidate_id) LEFT JOIN rnorm r ON r.role_id = s.role_id WHERE cleared = 6),
ranked AS (SELECT role_id, (row_number() OVER (PARTITION BY role_id ORDER BY distance, full_name, candidate_id))::INTEGER AS rank, candidate_id, round(1 - distance, 6) AS similarity FROM near WHERE distance IS NOT NULL),
listed AS MATERIALIZED (SELECT * FROM ranked WHERE rank <= 20),
unr AS (SELECT role_id, candidate_id, full_name, EXISTS (SELECT 1 FROM rvec r WHERE r.role_id = near.role_id AND list_inner_product(v, v) > 0) AS role_embedded FROM near WHERE distance IS NULL)
"""
ORACLES = {
    "role_funnel": f"WITH {STAGES} SELECT fun.*, top_filter, top_excluded FROM fun LEFT JOIN topf USING (role_id)",
    "cleared_stages": f"WITH {STAGES} SELECT role_id, cleared, count(*) AS n FROM staged GROUP BY ALL",
    "stage_exclusions": f"WITH {STAGES} SELECT * FROM excl",
    "funnel_text": f"WITH {STAGES} SELECT role_id, pool || ' active -> ' || after_profile || ' profile -> ' || after_certifications || ' certifications -> ' || after_software || ' software -> ' || after_experience || ' experience -> ' || after_availability || ' availability -> ' || after_overlap || ' overlap' AS line FROM fun",
    "acceptable_sets": f"WITH {STAGES} SELECT role_id, array_to_string(ids, ',') AS ids FROM sets",
    "overlap_minutes": f"WITH {STAGES} SELECT * FROM minutes",
    "shortlists": f"WITH {RANKED} SELECT * FROM listed",
    "unranked_candidates": f"WITH {RANKED} SELECT * FROM unr",
    "passed_candidates": f"WITH {STAGES} SELECT role_id, (row_number() OVER (PARTITION BY role_id ORDER BY full_name, candidate_id))::INTEGER AS position, candidate_id FROM staged WHERE cleared = 6",
    "run_records": f"""WITH {RANKED}, l AS (SELECT role_id, string_agg(candidate_id, ',' ORDER BY rank) AS retrieved, string_agg(printf('%.6f', similarity), ',' ORDER BY rank) AS similarities, count(*) AS n_retrieved FROM listed GROUP BY 1), u AS (SELECT role_id, count(*) AS n_unranked FROM unr GROUP BY 1)
SELECT fun.*, top_filter, day AS overlap_on, coalesce(retrieved, '') AS retrieved, coalesce(similarities, '') AS similarities, coalesce(n_retrieved, 0) AS n_retrieved, coalesce(n_unranked, 0) AS n_unranked, EXISTS (SELECT 1 FROM rvec r WHERE r.role_id = fun.role_id AND list_inner_product(v, v) > 0) AS role_embedded
FROM fun JOIN open_role USING (role_id) LEFT JOIN topf USING (role_id) LEFT JOIN l USING (role_id) LEFT JOIN u USING (role_id)""",
}
