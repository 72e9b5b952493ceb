"""Queries on jobs, run metrics, logs, rules of tables, updates and evaluation of the bound tables, with their SQL."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rolemesh.operators import evaluate as ev
from rolemesh.operators import jobs as jb
from rolemesh.operators import matches as mt
from rolemesh.operators import quality as ql
from rolemesh.operators import text as tx
from rolemesh.plans import bindings as b
from rolemesh.plans import documents as dc
from rolemesh.plans import funnel_queries as fq
from rolemesh.plans import review_queries as rq
from rolemesh.sources import tables as tb
from rolemesh.sources.scratch import shared_dir

NOW = "2024-01-31"
_NOW = lambda: F.lit(NOW).cast("timestamp_ntz")
#: Prices of a million tokens in and out; one kind has none, one provider is free.
PRICES = {"click": (0.5, 1.0), "error": (1.25, 2.0), "purchase": (3.0, 15.0), "signup": (0.1, 0.2)}
FREE = ["fake"]


def _jobs(spark, d):
    return b.table(spark, d, "events").selectExpr("event_id AS id", "event_type AS kind", "user_id AS payload", "element_at(array('queued', 'running', 'succeeded', 'failed'), cast(event_id % 4 + 1 AS int)) AS status", "event_id % 3 AS priority", "ts AS run_at", "(event_id DIV 4) % 4 AS attempts", "3 AS max_attempts", "event_id % 11 = 3 AS permanent")


JOBS = "job AS (SELECT event_id AS id, event_type AS kind, user_id AS payload, ['queued', 'running', 'succeeded', 'failed'][event_id % 4 + 1] AS status, event_id % 3 AS priority, ts AS run_at, (event_id // 4) % 4 AS attempts, 3 AS max_attempts, event_id % 11 = 3 AS permanent FROM events)"


def _runs(spark, d):
    rows = b.table(spark, d, "events").selectExpr("event_id", "event_type AS model", "CASE WHEN event_id % 9 = 0 THEN 'fake' ELSE 'live' END AS provider", "cast(floor(value * 100) AS long) AS total_ms", "event_id % 4 AS llm_calls", "event_id % 3 AS cache_hits", "cast(get_json_object(props, '$.k') AS long) * 100 AS tokens_in", "event_id % 500 AS tokens_out", "event_id % 20 AS candidates", "event_id % 77 AS rerank_ms")
    return jb.cost(rows, spark.createDataFrame([(k, *v) for k, v in PRICES.items()], "model string, price_in double, price_out double"), FREE)


_PRICE = ", ".join(f"('{k}', {i}::DOUBLE, {o}::DOUBLE)" for k, (i, o) in PRICES.items())
RUNS = f"""price AS (SELECT * FROM (VALUES {_PRICE}) t(model, pi, po)), rn AS (SELECT event_id, event_type AS model, CASE WHEN event_id % 9 = 0 THEN 'fake' ELSE 'live' END AS provider, floor(value * 100)::BIGINT AS total_ms, event_id % 4 AS llm_calls, event_id % 3 AS cache_hits, (props->>'$.k')::BIGINT * 100 AS tokens_in, event_id % 500 AS tokens_out, event_id % 20 AS candidates, event_id % 77 AS rerank_ms,
  CASE WHEN event_id % 9 = 0 THEN 0.0::DOUBLE ELSE round(((props->>'$.k')::BIGINT * 100 * pi + (event_id % 500) * po) / 1e6, 6) END AS cost FROM events LEFT JOIN price ON model = event_type)"""


def _metered(spark, d):
    m = F.to_json(F.struct("total_ms", F.struct(F.col("rerank_ms").alias("rerank"), F.lit(5).alias("filter")).alias("stage_ms"), "candidates", "llm_calls", "cache_hits", F.col("tokens_in").alias("input_tokens"), F.col("cost").alias("estimated_cost_usd"), "model"))
    metrics = _runs(spark, d).select(F.col("event_id").alias("run_id"), m.alias("metrics"))
    return rq.runs(spark, d).join(metrics, "run_id").selectExpr("*", "concat('r', cast(run_id DIV 2 AS string)) AS request_id")


def _lines(spark, d):
    e = b.table(spark, d, "events").selectExpr("event_id", "ts", "value AS duration", "CASE WHEN event_id % 100 = 7 THEN 'bad id' ELSE concat('r', cast(floor(event_id / 2) AS string)) END AS request_id", "CASE WHEN event_id % 5 <> 0 THEN event_id DIV 10 END AS job_id", "event_id % 4 AS calls", "event_id % 900 AS tokens")
    return e.withColumn("service", F.lit("api")).union(e.where("event_id % 3 <> 0").withColumn("service", F.lit("ai")))


def _log_text(spark, d):
    return _lines(spark, d).select(F.when(F.col("event_id") % 50 == 3, "plain text").otherwise(F.to_json(F.struct(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("time"), "service", "request_id", F.col("duration").alias("duration_ms"), F.struct(F.col("tokens").alias("n")).alias("extra")))).alias("value"))


def pending(spark, d):
    """Every fifth role lacks its embedding; those who ordered a part and have no vector couldn't be ranked for its role."""
    runs = b.roles(spark, d).selectExpr("role_id", "role_id % 5 <> 0 AS embedded")
    return jb.pending(_jobs(spark, d), runs, rq.matches_before(spark, d).where("candidate_id % 19 = 0"), ["signup"], ["click", "view"])


def entity_rows(spark, d):
    """Candidates and profiles written as entities and scanned by their declared columns: those that a table lacks are null."""
    folder = f"{shared_dir(spark).rstrip('/')}/rolemesh/entities-{uuid.uuid4().hex}"
    b.candidates(spark, d).selectExpr("cast(candidate_id AS string) AS id", "full_name", "email", "status").write.parquet(f"{folder}/candidates")
    b.profiles(spark, d).selectExpr("cast(candidate_id AS string) AS candidate_id", "cast(years_experience AS int) AS years_experience", "certifications", "software", "1 AS extra").write.parquet(f"{folder}/candidate_profiles")
    t = tb.scan(spark, folder, ("candidates", "candidate_profiles"))
    rows = t["candidates"].join(t["candidate_profiles"], F.col("id") == F.col("candidate_id"), "left")
    return rows.select("id", "full_name", "status", F.coalesce("location", F.lit("-")).alias("location"), "years_experience", F.array_join("software", ";").alias("software"), F.col("embedding").isNull().alias("no_vector"))


def report_rows(spark, d):
    """Costs by model and provider written as a report with a folder for each model, and read again."""
    folder = f"{shared_dir(spark).rstrip('/')}/rolemesh/reports-{uuid.uuid4().hex}"
    sums = _runs(spark, d).groupBy("model", "provider").agg(F.count("*").alias("runs"), F.sum("tokens_in").alias("tokens_in"), F.count("cost").alias("priced"))
    tb.write_reports({"costs": (sums, ["model"])}, folder)
    return spark.read.parquet(f"{folder}/costs").select("model", "provider", "runs", "tokens_in", "priced")


def _all(rules) -> DataFrame:
    return ql.violations(rules)


def _odd_availability(spark, d):
    return b.availability(spark, d).withColumn("hours_per_week", F.when(F.col("candidate_id") % 50 == 1, 90).otherwise(F.col("hours_per_week"))).withColumn("work_end", F.when(F.col("candidate_id") % 60 == 2, F.col("work_start")).otherwise(F.col("work_end")))


def _odd_roles(spark, d):
    return b.roles(spark, d).withColumn("min_overlap_hours", F.when(F.col("role_id") % 70 == 5, 9).otherwise(F.col("min_overlap_hours"))).withColumn("status", F.when(F.col("role_id") % 80 == 1, "paused").otherwise(F.col("status")))


def domain_violations(spark, d):
    """The rules on the bound tables, with errors planted by key."""
    c, p = b.candidates(spark, d), b.profiles(spark, d).withColumn("years_experience", F.when(F.col("candidate_id") % 90 == 4, -1).otherwise(F.col("years_experience")))
    m = rq.matches_before(spark, d).withColumn("score", F.col("score") + F.when(F.col("match_id") % 100 == 3, 1).otherwise(0))
    return _all(ql.domain_rules(c, p, _odd_availability(spark, d), _odd_roles(spark, d), m))


def uniqueness(spark, d):
    people = b.candidates(spark, d).withColumn("email", F.when(F.col("candidate_id") % 40 == 3, "Same@Example.com").when(F.col("candidate_id") % 41 == 0, None).otherwise(F.col("email")))
    lines = b.table(spark, d, "lineitem").join(b.table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return ql.repeated([(people, "email", [F.lower("email")]), (lines, "role and candidate", [F.col("l_partkey"), F.col("o_custkey")]), (b.profiles(spark, d), "profile", [F.col("candidate_id")])])


def orphans(spark, d):
    there, open_ = b.candidates(spark, d).where("candidate_id % 10 <> 3"), b.roles(spark, d).where("role_id % 10 <> 4")
    m = rq.matches_before(spark, d)
    links = [(b.profiles(spark, d), "profile of candidate", "candidate_id", there, "candidate_id"), (b.availability(spark, d), "answers of candidate", "candidate_id", there, "candidate_id"), (m, "match of candidate", "candidate_id", there, "candidate_id"), (m, "match of role", "role_id", open_, "role_id"), (rq._events(spark, d), "event of match", "match_id", m.where("match_id % 10 <> 5"), "match_id"), (rq.runs(spark, d), "run of role", "role_id", open_, "role_id")]
    return ql.orphans(links)


def funnel_invariants(spark, d):
    """Run records with errors planted by key."""
    r = fq.run_records(spark, d).withColumn("after_software", F.when(F.col("role_id") % 50 == 0, F.col("pool") + 1).otherwise(F.col("after_software"))).withColumn("n_unranked", F.when(F.col("role_id") % 50 == 1, F.col("pool")).otherwise(F.col("n_unranked"))).withColumn("retrieved", F.when(F.col("role_id") % 50 == 2, F.concat("retrieved", F.lit(",1"))).otherwise(F.col("retrieved")))
    return _all(ql.funnel_rules(r))


def outcome_invariants(spark, d):
    r = rq.runs(spark, d).withColumn("attention_detail", F.when(F.col("run_id") % 30 == 0, "late")).withColumn("attention_reason", F.when(F.col("run_id") % 35 == 1, None).otherwise(F.col("attention_reason")))
    return _all(ql.outcome_rules(r))


def role_completeness(spark, d):
    from rolemesh.operators import text as tx

    docs = dc.descriptions(spark, d)
    rows = docs.join(tx.sections(docs), "doc_id").join(tx.numeric_requirements(docs).select("doc_id", F.col("hours_per_week").alias("parsed_hours")), "doc_id")
    return _all(ql.role_rules(rows.selectExpr("doc_id AS role_id", "timezone", "must AS must_haves", "CASE WHEN doc_id % 33 = 0 THEN ' ' ELSE text END AS description", "parsed_hours", "CASE WHEN doc_id % 44 = 0 THEN 10 WHEN doc_id % 45 = 0 THEN 0 END AS asked_hours")))


def population_summary(spark, d):
    p = b.profiles(spark, d)
    rows = p.select(F.lit("software").alias("attribute"), F.explode_outer("software").alias("value")).union(p.select(F.lit("certification"), F.explode_outer("certifications")))
    return ev.attribute_summary(rows, p.count())


def years_buckets(spark, d):
    y = F.col("years_experience")
    bucket = F.when(y.isNull(), "unknown").when(y <= 2, "0-2").when(y <= 5, "3-5").when(y <= 10, "6-10").when(y <= 20, "11-20").otherwise("20+")
    return b.profiles(spark, d).groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"))


def software_f1(spark, d):
    """Each profile's software against that of the role whose key its own gives."""
    roles = b.roles(spark, d).select("role_id", "required_software")
    p = b.profiles(spark, d).withColumn("role_id", F.col("candidate_id") % b.table(spark, d, "part").count())
    return p.join(roles, "role_id").select("candidate_id", F.round(mt.set_f1(F.col("software"), F.col("required_software")), 6).alias("f1"))


def field_scores(spark, d):
    """Contacts taken from resumes against the tables, with cases that errored."""
    from rolemesh.operators import text as tx

    r = dc.resumes(spark, d)
    rows = tx.contacts(r).join(r.select("doc_id", F.col("full_name").alias("want_name"), F.col("email").alias("want_email")), "doc_id")
    scores = rows.select(F.col("doc_id").alias("case_id"), F.expr("stack(2, 'contact', 'name', full_name, replace(upper(want_name), '#', ' '), 'contact', 'email', email, want_email) AS (section, field, got, want)"))
    return ev.field_means(scores.select("case_id", "section", "field", ev.exact(F.col("got"), F.col("want")).alias("score")), r.where("doc_id % 10 = 0").select(F.col("doc_id").alias("case_id")))


def comparable(spark, d):
    from rolemesh.operators import text as tx

    r = dc.resumes(spark, d)
    p = tx.positions(r).select("doc_id", ev.position_form(F.struct("title", "start_year", "end_year")).alias("form"))
    q = r.select("doc_id", F.explode("certifications").alias("c")).select("doc_id", ev.qualification_form(F.struct(F.col("c").alias("id"), F.when(F.col("doc_id") % 2 == 0, "uk").alias("place"), F.lit("qualified").alias("status"))))
    return p.union(q)


def precision(spark, d):
    truth = rq.matches_before(spark, d).where("status = 'approved'").select("role_id", "candidate_id")
    ranked = rq.matches_before(spark, d).select("role_id", "candidate_id", (-F.col("score")).alias("rank"))
    return ev.precision_at_truth(ranked, truth)


def perturbed(spark, d):
    clean = rq.matches_before(spark, d).select("role_id", "candidate_id", "score", (F.col("candidate_id") % 5).alias("l0"), F.when(F.col("role_id") % 2 == 0, F.col("role_id") % 5).alias("l1"))
    added = clean.select("role_id", "candidate_id", (F.col("score") + F.when(F.col("candidate_id") % 7 == 0, 0.1).otherwise(0.0)).alias("score"), F.when(F.col("candidate_id") % 9 == 0, F.col("l0") + 1).otherwise(F.col("l0")).alias("l0"), F.when(F.col("candidate_id") % 11 == 0, None).otherwise(F.col("l1")).alias("l1"))
    return ev.perturbed(clean, added, ["l0", "l1"])


def _profile_table(spark, d):
    v = F.when(F.col("candidate_id") % 3 == 0, F.lit("v"))
    return b.profiles(spark, d).select("candidate_id", F.concat(F.lit("Analyst "), F.col("candidate_id")).alias("headline"), "certifications", "software", "years_experience", v.alias("embedding"))


def upserts(spark, d):
    """New profiles for every second candidate: some with other software, some with other years only, some new."""
    new = b.candidates(spark, d).where("candidate_id % 2 = 0").select("candidate_id").join(b.profiles(spark, d), "candidate_id", "left").select("candidate_id", F.concat(F.lit("Analyst "), F.col("candidate_id")).alias("headline"), F.coalesce("certifications", F.array().cast("array<string>")).alias("certifications"), F.when(F.col("candidate_id") % 4 == 0, F.array(F.lit("new"))).otherwise(F.coalesce("software", F.array().cast("array<string>"))).alias("software"), F.lit(9).alias("years_experience"))
    out = tb.upserted(_profile_table(spark, d), new, "candidate_id", ["headline", "certifications", "software"], ["embedding"])
    return out.select("candidate_id", "headline", F.array_join("software", ",").alias("software"), "years_experience", "embedding", "change")


def role_updates(spark, d):
    table = b.roles(spark, d).select("role_id", "title", "required_software", "hours_per_week", F.lit("v").alias("embedding"))
    new = table.where("role_id % 3 = 0").select("role_id", F.when(F.col("role_id") % 6 == 0, F.upper("title")).otherwise(F.col("title")).alias("title"), "required_software", F.lit(30).alias("hours_per_week"))
    return tb.upserted(table, new, "role_id", ["title", "required_software"], ["embedding"]).drop("required_software")


def guarded(spark, d):
    docs = b.table(spark, d, "documents")
    new = docs.select("doc_id", F.lit("parsed").alias("profile"), F.sha2(F.coalesce(F.when(F.col("doc_id") % 5 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")), F.lit("")), 256).alias("source_hash"))
    return tb.still_current(new, docs.select("doc_id", "text"), "doc_id", "text")


def appended(spark, d):
    one = b.candidates(spark, d).where("candidate_id % 3 <> 0").select("candidate_id", "full_name")
    return tb.appended(one, b.candidates(spark, d).select("candidate_id", F.lower("full_name").alias("full_name")), ["candidate_id"])


def latest_answers(spark, d):
    return tb.latest(b.table(spark, d, "events").selectExpr("user_id", "event_id", "event_type"), ["user_id"], F.col("event_id"))


def patched(spark, d):
    table = b.candidates(spark, d).select("candidate_id", "full_name", "email", "status")
    patches = table.where("candidate_id % 4 = 0").select("candidate_id", F.when(F.col("candidate_id") % 8 == 0, F.array(F.lit("email"), F.lit("status"))).otherwise(F.array(F.lit("full_name"))).alias("supplied"), F.lit("New").alias("full_name"), F.lit(None).cast("string").alias("email"), F.lit("archived").alias("status"))
    return tb.patched(table, patches, "candidate_id")


def deletions(spark, d):
    """What is left of each table, and who can't go."""
    gone = b.candidates(spark, d).where("candidate_id % 6 = 0").select("candidate_id")
    m = rq.matches_before(spark, d)
    left, blocked = tb.deleted(gone, b.candidates(spark, d), {"profiles": b.profiles(spark, d), "availability": b.availability(spark, d)}, m, rq._events(spark, d))
    parts = [t.select(F.lit(n).alias("part"), "candidate_id") for n, t in left.items()] + [blocked.select(F.lit("blocked"), "candidate_id")]
    return reduce(DataFrame.union, parts).groupBy("part").agg(F.count("*").alias("n"), F.sum("candidate_id").alias("ids"))


QUERIES = {
    "entity_rows": entity_rows,
    "report_rows": report_rows,
    "queued_once": lambda s, d: jb.queued_once(_jobs(s, d)),
    "ready_jobs": lambda s, d: jb.ready_order(_jobs(s, d), _NOW(), ["click", "error", "signup"]),
    "retry_schedule": lambda s, d: jb.retry_schedule(_jobs(s, d)),
    "stale_running": lambda s, d: jb.stale_running(_jobs(s, d), F.lit("2024-01-15").cast("timestamp_ntz"), 300),
    "latest_jobs": lambda s, d: jb.latest(_jobs(s, d)),
    "pending_dependencies": pending,
    "owned_completions": lambda s, d: jb.owned(b.table(s, d, "events").selectExpr("user_id AS job_id", "event_id % 3 AS worker", "event_id AS attempt"), b.table(s, d, "events").where("event_id % 2 = 0").selectExpr("user_id AS job_id", "event_id % 3 AS worker", "event_id AS attempt")),
    "run_costs": lambda s, d: _runs(s, d),
    "runs_per_model": lambda s, d: jb.per_model(_runs(s, d)),
    "latest_runs": lambda s, d: jb.latest_runs(_metered(s, d), b.roles(s, d)),
    "run_usage": lambda s, d: jb.usage(_runs(s, d).withColumn("run_id", F.col("event_id") % 1000)),
    "call_counts": lambda s, d: jb.call_counts(b.table(s, d, "conversations").selectExpr("conv_id", "turn", "2 + turn % 3 AS completions", "turn % 2 AS cache_hits", "text AS prompt", "role AS answer")),
    "cache_effect": lambda s, d: jb.cache_effect(b.table(s, d, "events").selectExpr("event_type AS kind", "user_id % 3 AS model", "event_id % 4 = 0 AS hit")),
    "request_traces": lambda s, d: jb.request_trace(_lines(s, d)),
    "request_paths": lambda s, d: jb.request_path(_lines(s, d)),
    "log_lines": lambda s, d: tb.log_lines(_log_text(s, d)).select("time", "service", "request_id", "duration_ms", F.expr("variant_get(rest, '$.extra.n', 'long')").alias("n")),
    "domain_violations": domain_violations,
    "uniqueness_violations": uniqueness,
    "orphan_references": orphans,
    "funnel_invariants": funnel_invariants,
    "outcome_invariants": outcome_invariants,
    "population_checks": lambda s, d: ql.population(b.profiles(s, d), b.candidates(s, d), b.availability(s, d), tx.availability(dc.resumes(s, d)), b.roles(s, d).join(dc.descriptions(s, d).selectExpr("doc_id AS role_id", "text AS description"), "role_id")),
    "role_selectivity": lambda s, d: ql.selectivity(fq.role_funnel(s, d)),
    "role_completeness": role_completeness,
    "population_summary": population_summary,
    "years_buckets": years_buckets,
    "software_f1": software_f1,
    "field_scores": field_scores,
    "comparable_forms": comparable,
    "precision_at_truth": precision,
    "perturbed_levels": perturbed,
    "profile_upserts": upserts,
    "role_updates": role_updates,
    "guarded_upserts": guarded,
    "appended_rows": appended,
    "latest_answers": latest_answers,
    "patched_rows": patched,
    "cascade_deletes": deletions,
}


def _rule(rule: str, key: str, table: str, where: str) -> str:
    return f"SELECT '{rule}' AS rule, {key}::VARCHAR AS id FROM {table} WHERE {where}"


def _repeat(rule: str, key: str, table: str, where: str = "true") -> str:
    return f"SELECT '{rule}' AS rule, {key} AS key, count(*) AS n FROM {table} WHERE {where} GROUP BY 2 HAVING count(*) > 1"


def _orphan(name: str, child: str, column: str, parent: str) -> str:
    return f"SELECT '{name}' AS reference, {column}::VARCHAR AS id, count(*) AS n FROM {child} WHERE {column} IS NOT NULL AND {column} NOT IN ({parent}) GROUP BY 2"


_TRACE = "e AS (SELECT event_id, ts, value AS duration, CASE WHEN event_id % 100 = 7 THEN 'bad id' ELSE 'r' || (event_id // 2) END AS request_id, CASE WHEN event_id % 5 <> 0 THEN event_id // 10 END AS job_id, event_id % 4 AS calls, event_id % 900 AS tokens FROM events), l AS (SELECT *, 'api' AS service FROM e UNION ALL SELECT *, 'ai' FROM e WHERE event_id % 3 <> 0)"
_SUMMARY = f"""WITH {b.SQL}, e AS (SELECT 'software' AS attribute, unnest(CASE WHEN len(software) = 0 THEN ['(none)'] ELSE software END) AS value FROM prof UNION ALL SELECT 'certification', unnest(CASE WHEN len(certifications) = 0 THEN ['(none)'] ELSE certifications END) FROM prof),
c AS (SELECT attribute, value, count(*) AS n, round(100.0::DOUBLE * count(*) / (SELECT count(*) FROM prof), 4) AS percent FROM e GROUP BY 1, 2), p AS (SELECT *, (row_number() OVER (PARTITION BY attribute, value = '(none)' ORDER BY n DESC, value))::INTEGER AS place FROM c) SELECT * FROM p WHERE place <= 10 OR value = '(none)'"""
ORACLES = {
    "entity_rows": f"WITH {b.SQL} SELECT candidate_id::VARCHAR AS id, full_name, status, '-' AS location, years_experience::INTEGER AS years_experience, array_to_string(software, ';') AS software, true AS no_vector FROM cand LEFT JOIN prof USING (candidate_id)",
    "report_rows": f"WITH {RUNS} SELECT model, provider, count(*) AS runs, sum(tokens_in)::BIGINT AS tokens_in, count(cost) AS priced FROM rn GROUP BY 1, 2",
    "queued_once": f"WITH {JOBS} SELECT kind, payload, min(id) AS id, count(*) - 1 AS suppressed FROM job WHERE status = 'queued' GROUP BY kind, payload",
    "ready_jobs": f"WITH {JOBS} SELECT * FROM (SELECT id, kind, row_number() OVER (PARTITION BY kind ORDER BY priority DESC, run_at, id) AS place FROM job WHERE status = 'queued' AND run_at <= TIMESTAMP '{NOW}' AND kind IN ('click', 'error', 'signup'))",
    "retry_schedule": f"WITH {JOBS}, f AS (SELECT *, permanent OR attempts >= max_attempts OR EXISTS (SELECT 1 FROM job q WHERE q.status = 'queued' AND q.kind = j.kind AND q.payload = j.payload) AS final FROM job j WHERE status = 'failed') SELECT id, CASE WHEN final THEN 'failed' ELSE 'queued' END AS next_status, CASE WHEN NOT final THEN least(600, 5 * pow(4, greatest(attempts - 1, 0)))::INTEGER END AS wait_s FROM f",
    "stale_running": f"WITH {JOBS}, o AS (SELECT * FROM job WHERE status = 'running' AND run_at + INTERVAL 300 SECOND < TIMESTAMP '2024-01-15') SELECT id, CASE WHEN attempts >= max_attempts OR EXISTS (SELECT 1 FROM job q WHERE q.status = 'queued' AND q.kind = o.kind AND q.payload = o.payload) OR EXISTS (SELECT 1 FROM o p WHERE p.kind = o.kind AND p.payload = o.payload AND p.id < o.id AND p.attempts < p.max_attempts) THEN 'failed' ELSE 'queued' END AS next_status FROM o",
    "latest_jobs": f"WITH {JOBS} SELECT kind, payload, max(id) AS id, arg_max(status, id) AS status FROM job GROUP BY kind, payload",
    "pending_dependencies": f"""WITH {rq.MATCHES}, {JOBS}, busy AS (SELECT DISTINCT kind, payload FROM job WHERE status IN ('queued', 'running')), late AS (SELECT DISTINCT role_id FROM mt JOIN busy ON payload = candidate_id AND kind IN ('click', 'view') WHERE candidate_id % 19 = 0)
SELECT role_id, CASE WHEN role_id % 5 = 0 THEN CASE WHEN EXISTS (SELECT 1 FROM busy WHERE payload = role_id AND kind = 'signup') THEN 'wait' ELSE 'not_ready' END WHEN role_id IN (SELECT role_id FROM late) THEN 'partial' ELSE 'whole' END AS state FROM role""",
    "owned_completions": "WITH c AS (SELECT user_id, max(event_id) AS a FROM events WHERE event_id % 2 = 0 GROUP BY 1) SELECT user_id AS job_id, event_id % 3 AS worker, event_id AS attempt, coalesce(event_id = a, false) AS counts FROM events LEFT JOIN c USING (user_id)",
    "run_costs": f"WITH {RUNS} SELECT * FROM rn",
    "runs_per_model": f"WITH {RUNS} SELECT model, count(*) AS runs, round(avg(candidates), 1) AS avg_candidates, round(avg(llm_calls), 1) AS avg_llm_calls, round(avg(tokens_in), 0) AS avg_tokens_in, round(avg(tokens_out), 0) AS avg_tokens_out, round(avg(rerank_ms), 0) AS avg_rerank_ms, round(avg(cost), 4) AS avg_cost, round(sum(cost) / nullif(sum(candidates), 0), 4) AS cost_per_candidate, round(avg(total_ms), 0) AS avg_total_ms, round(quantile_cont(total_ms, 0.5), 4) AS p50_ms, round(quantile_cont(total_ms, 0.95), 4) AS p95_ms FROM rn WHERE llm_calls > 0 GROUP BY model",
    "latest_runs": f"WITH {rq.MATCHES}, {RUNS}, t AS (SELECT * FROM run ORDER BY created_at DESC, run_id LIMIT 20) SELECT strftime(created_at, '%m-%d %H:%M:%S') AS run_at, left(title, 28) AS role, coalesce(attention_reason, match_status, '-') AS outcome, 'r' || (run_id // 2) AS request_id, total_ms::INTEGER AS total_ms, 5 AS filter_ms, rerank_ms::INTEGER AS rerank_ms, candidates::INTEGER AS reranked, llm_calls::INTEGER AS llm_calls, cache_hits::INTEGER AS cache_hits, tokens_in::INTEGER AS tokens_in, cost AS cost_usd, model FROM t JOIN role USING (role_id) JOIN rn ON event_id = run_id",
    "run_usage": f"WITH {RUNS} SELECT event_id % 1000 AS run_id, sum(llm_calls)::BIGINT AS llm_calls, sum(cache_hits)::BIGINT AS cache_hits, sum(tokens_in)::BIGINT AS tokens_in, sum(tokens_out)::BIGINT AS tokens_out, CASE WHEN NOT bool_or(cost IS NULL) THEN round(sum(cost), 6) END AS cost FROM rn GROUP BY 1",
    "call_counts": "SELECT conv_id, turn, 2 + turn % 3 AS completions, turn % 2 AS cache_hits, 2 + turn % 3 - turn % 2 AS llm_calls, (length(coalesce(text, '')) + 3) // 4 AS tokens_in, (length(coalesce(role, '')) + 3) // 4 AS tokens_out FROM conversations",
    "cache_effect": "SELECT event_type AS kind, user_id % 3 AS model, count(*) AS calls, count(*) FILTER (event_id % 4 = 0) AS hits, round(count(*) FILTER (event_id % 4 = 0) / count(*), 4) AS hit_rate FROM events GROUP BY 1, 2",
    "request_traces": f"WITH {_TRACE} SELECT request_id, count(*) AS lines, count(*) FILTER (service = 'ai') AS ai_lines, round(sum(duration), 4) AS duration, sum(calls)::BIGINT AS calls, sum(tokens)::BIGINT AS tokens, count(DISTINCT job_id) AS jobs FROM l WHERE request_id <> 'bad id' GROUP BY request_id",
    "request_paths": f"WITH {_TRACE} SELECT request_id, row_number() OVER (PARTITION BY request_id ORDER BY ts, service) AS place, ts, service FROM l WHERE request_id <> 'bad id'",
    "log_lines": f"WITH {_TRACE} SELECT date_trunc('second', ts)::TIMESTAMP AS time, service, request_id, duration AS duration_ms, tokens AS n FROM l WHERE event_id % 50 <> 3",
    "domain_violations": " UNION ALL ".join([f"WITH {rq.MATCHES} " + _rule("years below 0", "candidate_id", "prof", "candidate_id % 90 = 4"), _rule("hours outside 1..80", "candidate_id", "avail", "candidate_id % 50 = 1"), _rule("start equals end", "candidate_id", "avail", "candidate_id % 60 = 2 OR work_start = work_end"), _rule("role status", "role_id", "role", "role_id % 80 = 1"), _rule("overlap outside 1..8", "role_id", "role", "role_id % 70 = 5"), _rule("overlap without zone", "role_id", "role", "role_id % 70 = 5 AND timezone IS NULL"), _rule("score outside 0..1", "match_id", "mt", "match_id % 100 = 3 AND score > 0")]),
    "uniqueness_violations": " UNION ALL ".join([f"WITH {b.SQL} " + _repeat("email", "'same@example.com'", "cand", "candidate_id % 40 = 3"), _repeat("role and candidate", "l_partkey || '/' || o_custkey", "lineitem JOIN orders ON l_orderkey = o_orderkey")]),
    "orphan_references": " UNION ALL ".join([f"WITH {rq.MATCHES} " + _orphan("profile of candidate", "prof", "candidate_id", "SELECT candidate_id FROM cand WHERE candidate_id % 10 <> 3"), _orphan("answers of candidate", "avail", "candidate_id", "SELECT candidate_id FROM cand WHERE candidate_id % 10 <> 3"), _orphan("match of candidate", "mt", "candidate_id", "SELECT candidate_id FROM cand WHERE candidate_id % 10 <> 3"), _orphan("match of role", "mt", "role_id", "SELECT role_id FROM role WHERE role_id % 10 <> 4"), _orphan("event of match", "ev", "match_id", "SELECT match_id FROM mt WHERE match_id % 10 <> 5"), _orphan("run of role", "run", "role_id", "SELECT role_id FROM role WHERE role_id % 10 <> 4")]),
    "funnel_invariants": f"WITH {fq.STAGES} SELECT 'counts rise' AS rule, role_id::VARCHAR AS id FROM fun WHERE role_id % 50 = 0 UNION ALL SELECT 'more listed and unranked than passed', role_id::VARCHAR FROM fun WHERE role_id % 50 = 1 UNION ALL SELECT 'lists of different length', role_id::VARCHAR FROM fun WHERE role_id % 50 = 2",
    "outcome_invariants": f"WITH {rq.MATCHES} SELECT 'reason and status disagree' AS rule, run_id::VARCHAR AS id FROM run WHERE run_id % 35 = 1 AND attention_reason IS NOT NULL UNION ALL SELECT 'detail without reason', run_id::VARCHAR FROM run WHERE run_id % 30 = 0 AND (attention_reason IS NULL OR run_id % 35 = 1)",
    "population_checks": f"""WITH {dc.SQL}, c AS (SELECT count(*) AS n, count(prof.candidate_id) AS p, count(*) FILTER (len(certifications) > 0) AS c, count(*) FILTER (len(software) > 0) AS s, count(avail.candidate_id) AS a, count(DISTINCT timezone) AS z FROM cand LEFT JOIN prof USING (candidate_id) LEFT JOIN avail USING (candidate_id)),
x AS (SELECT (SELECT count(DISTINCT v) FROM (SELECT unnest(certifications) AS v FROM prof)) AS dc, (SELECT count(DISTINCT v) FROM (SELECT unnest(software) AS v FROM prof)) AS ds)
SELECT 'population' AS check, n::DOUBLE AS value, n >= 150 AS ok FROM c UNION ALL SELECT 'profiles', p::DOUBLE, p = n FROM c UNION ALL SELECT 'distinct time zones', z::DOUBLE, z >= 6 FROM c UNION ALL
SELECT 'roles described', count(*)::DOUBLE, count(*) >= 5 FROM jd UNION ALL SELECT 'roles with overlap', count(min_overlap_hours)::DOUBLE, count(min_overlap_hours) >= 3 FROM role UNION ALL SELECT 'distinct hours asked', count(DISTINCT hours_per_week)::DOUBLE, count(DISTINCT hours_per_week) >= 2 FROM role
UNION ALL SELECT 'distinct availability', count(DISTINCT doc_id % 4)::DOUBLE, count(DISTINCT doc_id % 4) >= 4 FROM rs UNION ALL SELECT 'share with certifications', round(c / n, 6), c / n >= 0.5 FROM c UNION ALL SELECT 'share with software', round(s / n, 6), s / n >= 0.5 FROM c UNION ALL SELECT 'share answered', round(a / n, 6), a / n BETWEEN 0.70 AND 0.95 FROM c
UNION ALL SELECT 'distinct certifications', dc::DOUBLE, dc >= 5 FROM x UNION ALL SELECT 'distinct software', ds::DOUBLE, ds >= 5 FROM x""",
    "role_selectivity": f"WITH {fq.STAGES} SELECT role_id, after_overlap AS passed, after_overlap >= 1 AND after_overlap <= 0.9 * pool AS ok, (SELECT count(DISTINCT after_overlap) FROM fun) AS sizes, (SELECT count(DISTINCT after_overlap) FROM fun) >= 4 AS sizes_ok FROM fun",
    "role_completeness": f"WITH {dc.SQL}, a AS (SELECT *, CASE WHEN doc_id % 44 = 0 THEN 10 WHEN doc_id % 45 = 0 THEN 0 END AS asked FROM jd) SELECT 'no time zone' AS rule, doc_id::VARCHAR AS id FROM a WHERE timezone IS NULL UNION ALL SELECT 'no must-haves', doc_id::VARCHAR FROM a WHERE soft IS NULL AND cert IS NULL AND min_years IS NULL UNION ALL SELECT 'no description', doc_id::VARCHAR FROM a WHERE doc_id % 33 = 0 UNION ALL SELECT 'hours both parsed and asked', doc_id::VARCHAR FROM a WHERE hours_per_week IS NOT NULL AND asked IS NOT NULL UNION ALL SELECT 'hours not positive', doc_id::VARCHAR FROM a WHERE asked <= 0",
    "population_summary": _SUMMARY,
    "years_buckets": f"WITH {b.SQL} SELECT CASE WHEN years_experience IS NULL THEN 'unknown' WHEN years_experience <= 2 THEN '0-2' WHEN years_experience <= 5 THEN '3-5' WHEN years_experience <= 10 THEN '6-10' WHEN years_experience <= 20 THEN '11-20' ELSE '20+' END AS bucket, count(*) AS n FROM prof GROUP BY 1",
    "software_f1": f"WITH {b.SQL} SELECT candidate_id, round(CASE WHEN len(software) + len(required_software) = 0 THEN 1.0 ELSE 2.0 * len(list_intersect(software, required_software)) / (len(software) + len(required_software)) END, 6)::DOUBLE AS f1 FROM prof JOIN role ON role_id = candidate_id % (SELECT count(*) FROM part)",
    "field_scores": f"WITH {dc.SQL} SELECT 'contact' AS section, 'name' AS field, count(*) AS n, round(avg(CASE WHEN doc_id % 10 = 0 THEN 0 ELSE 1 END), 6) AS mean FROM rs UNION ALL SELECT 'contact', 'email', count(*), round(avg(CASE WHEN doc_id % 10 = 0 THEN 0 ELSE (email = split_part(email, '#', 2))::INTEGER END), 6) FROM rs",
    "comparable_forms": f"WITH {dc.SQL} SELECT doc_id, 'senior analyst ' || (2024 - years_experience) || '-now' AS form FROM rs WHERE years_experience IS NOT NULL UNION ALL SELECT doc_id, 'junior analyst ' || (2020 - years_experience) || '-' || (2024 - years_experience) FROM rs WHERE years_experience IS NOT NULL UNION ALL SELECT doc_id, unnest(certifications) || CASE WHEN doc_id % 2 = 0 THEN ' uk' ELSE ' -' END || ' qualified' FROM rs",
    "precision_at_truth": f"WITH {rq.MATCHES}, t AS (SELECT role_id, count(*) AS k FROM mt WHERE status = 'approved' GROUP BY 1), r AS (SELECT role_id, status, row_number() OVER (PARTITION BY role_id ORDER BY -score, candidate_id) AS p FROM mt) SELECT role_id, k, count(*) FILTER (p <= k AND status = 'approved') AS hits, round(count(*) FILTER (p <= k AND status = 'approved') / k, 6) AS precision FROM t JOIN r USING (role_id) GROUP BY 1, 2",
    "perturbed_levels": f"""WITH {rq.MATCHES}, x AS (SELECT role_id, candidate_id, candidate_id % 5 AS a, CASE WHEN role_id % 2 = 0 THEN role_id % 5 END AS b FROM mt), y AS (SELECT *, CASE WHEN candidate_id % 9 = 0 THEN 'l0: ' || a || ' -> ' || (a + 1) END AS m0, CASE WHEN candidate_id % 11 = 0 AND b IS NOT NULL THEN 'l1: ' || b || ' -> none' END AS m1 FROM x)
SELECT role_id, candidate_id, m0 IS NULL AND m1 IS NULL AS levels_unchanged, candidate_id % 7 <> 0 AS score_not_raised, concat_ws('; ', m0, m1) AS moved FROM y""",
    "profile_upserts": f"""WITH {b.SQL}, o AS (SELECT candidate_id, software, years_experience, CASE WHEN candidate_id % 3 = 0 THEN 'v' END AS embedding, true AS there FROM prof), n AS (SELECT candidate_id FROM cand WHERE candidate_id % 2 = 0),
j AS (SELECT coalesce(n.candidate_id, o.candidate_id) AS id, o.*, n.candidate_id IS NOT NULL AS new FROM o FULL JOIN n ON n.candidate_id = o.candidate_id)
SELECT id AS candidate_id, 'Analyst ' || id AS headline, CASE WHEN new AND id % 4 = 0 THEN 'new' ELSE array_to_string(coalesce(software, []), ',') END AS software, (CASE WHEN new THEN 9 ELSE years_experience END)::INTEGER AS years_experience, CASE WHEN NOT new OR id % 4 <> 0 OR software = ['new'] THEN embedding END AS embedding, CASE WHEN new AND there THEN 'replaced' WHEN new THEN 'inserted' ELSE 'kept' END AS change FROM j""",
    "role_updates": f"WITH {b.SQL} SELECT role_id, CASE WHEN role_id % 6 = 0 THEN upper(title) ELSE title END AS title, CASE WHEN role_id % 3 = 0 THEN 30 ELSE hours_per_week END AS hours_per_week, CASE WHEN role_id % 6 <> 0 OR upper(title) = title THEN 'v' END AS embedding, CASE WHEN role_id % 3 = 0 THEN 'replaced' ELSE 'kept' END AS change FROM role",
    "guarded_upserts": "SELECT doc_id, 'parsed' AS profile FROM documents WHERE doc_id % 5 <> 0 OR text IS NULL",
    "appended_rows": f"WITH {b.SQL} SELECT candidate_id, CASE WHEN candidate_id % 3 = 0 THEN lower(full_name) ELSE full_name END AS full_name FROM cand",
    "latest_answers": "SELECT user_id, max(event_id) AS event_id, arg_max(event_type, event_id) AS event_type FROM events GROUP BY 1",
    "patched_rows": f"WITH {b.SQL} SELECT candidate_id, CASE WHEN candidate_id % 8 = 4 THEN 'New' ELSE full_name END AS full_name, CASE WHEN candidate_id % 8 <> 0 THEN email END AS email, CASE WHEN candidate_id % 8 = 0 THEN 'archived' ELSE status END AS status FROM cand",
    "cascade_deletes": f"""WITH {rq.MATCHES}, h AS (SELECT DISTINCT candidate_id FROM mt JOIN ev USING (match_id)), g AS (SELECT candidate_id FROM cand WHERE candidate_id % 6 = 0 AND candidate_id NOT IN (SELECT candidate_id FROM h)),
p AS (SELECT 'candidates' AS part, candidate_id FROM cand UNION ALL SELECT 'profiles', candidate_id FROM prof UNION ALL SELECT 'availability', candidate_id FROM avail UNION ALL SELECT 'matches', candidate_id FROM mt)
SELECT part, count(*) AS n, sum(candidate_id)::BIGINT AS ids FROM p WHERE candidate_id NOT IN (SELECT candidate_id FROM g) GROUP BY 1 UNION ALL SELECT 'blocked', count(*), sum(candidate_id)::BIGINT FROM cand WHERE candidate_id % 6 = 0 AND candidate_id IN (SELECT candidate_id FROM h) HAVING count(*) > 0""",
}
