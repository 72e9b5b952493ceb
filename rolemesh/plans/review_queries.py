"""Queries on scores, matches, runs and decisions of the bound tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from rolemesh.operators import funnel as fn
from rolemesh.operators import matches as mt
from rolemesh.operators import review as rv
from rolemesh.plans import bindings as b
from rolemesh.plans.funnel_queries import RANKED, asked_held_pool, counts_of, shortlists, vectors_of, zones
from rolemesh.sources.scratch import kept


def _basis(spark, d):
    """(asked, held, shortlist, pool, clocks, vectors of roles and of candidates), each written once."""
    asked, held, pool = asked_held_pool(spark, d)
    clock, vectors = fn.asked_clocks(asked, zones(spark)), vectors_of(spark, d)
    return asked, held, kept(fn.ranked(asked, held, *vectors, fn.days_of(clock)), "shortlist"), pool, clock, vectors


def _judged(spark, d, listed=None):
    """A judgement for each shortlisted pair, with levels from its keys."""
    listed = kept(shortlists(spark, d), "shortlist") if listed is None else listed
    roles = b.roles(spark, d).select("role_id", (F.size("required_software") > 0).alias("soft"))
    pairs = listed.join(roles.hint("merge"), "role_id")
    level = lambda k: ((3 * F.col("candidate_id") + 5 * F.col("role_id") + 7 * k) % 5).cast("int")
    return pairs.select("role_id", "candidate_id", *[(F.when(F.col("soft"), level(k)) if k == 1 else level(k)).alias(f"l{k}") for k in range(5)])


#: Lines whose matches a task holds, about.
LINES = 200_000


def matches_before(spark, d):
    """A match for each pair of a role and a candidate who once ordered it, in any state.

    Tasks are dealt by a count of lines: keys pack so well that Spark, which goes by bytes, would lay ever more of them in one task.
    """
    table = b.table(spark, d, "lineitem")
    tasks = 1 + table.count() // LINES
    lines = table.select("l_orderkey", F.col("l_partkey").alias("role_id")).repartition(tasks, "l_orderkey")
    orders = b.table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("candidate_id")).repartition(tasks, "l_orderkey")
    return lines.join(orders.hint("merge"), "l_orderkey").select("role_id", "candidate_id").repartition(tasks, "role_id", "candidate_id").distinct().selectExpr(
        "role_id", "candidate_id", "role_id * 10000000 + candidate_id AS match_id",
        "element_at(array('proposed', 'pending_review', 'approved', 'rejected', 'swapped', 'proposed'), cast((candidate_id + role_id) % 6 + 1 AS int)) AS status",
        "(candidate_id + role_id) % 6 = 2 AND candidate_id % 4 = 0 OR (candidate_id + role_id) % 97 = 0 AS released", "(candidate_id + role_id) % 6 = 5 AS by_hand",
        "cast((7 * candidate_id + 3 * role_id) % 101 AS double) / 100 AS score",
        "CASE WHEN (candidate_id + role_id) % 6 <> 5 THEN cast((candidate_id * 5 + role_id) % 50 + 1 AS int) END AS run_rank",
    )


def _events(spark, d, before=None):
    """Each event of a user is a decision on one of the matches of the candidate of that key."""
    numbered = (matches_before(spark, d) if before is None else before).selectExpr("candidate_id", "match_id", "row_number() OVER (PARTITION BY candidate_id ORDER BY role_id) - 1 AS k", "count(*) OVER (PARTITION BY candidate_id) AS n")
    e = b.table(spark, d, "events").selectExpr("event_id", "ts", "user_id AS candidate_id", "CASE event_type WHEN 'purchase' THEN 'approve' WHEN 'error' THEN 'reject' WHEN 'view' THEN 'swap' WHEN 'click' THEN 'release' ELSE 'unrelease' END AS action", "(user_id + event_id) % (SELECT_N) AS replacement".replace("(SELECT_N)", str(b.table(spark, d, "customer").count())))
    return e.hint("merge").join(numbered, "candidate_id").where("k = event_id % n").selectExpr("event_id", "ts", "match_id", "action", "CASE WHEN action = 'swap' THEN replacement END AS replacement_id")


def runs(spark, d):
    """A run for each event, of the role that its key gives."""
    n = b.table(spark, d, "part").count()
    status = "CASE event_id % 5 WHEN 0 THEN 'matched' WHEN 1 THEN 'needs_attention' WHEN 2 THEN 'needs_attention' WHEN 3 THEN 'matched' END"
    return b.table(spark, d, "events").selectExpr("event_id AS run_id", f"event_id % {n} AS role_id", "ts AS created_at", "CASE WHEN event_id % 3 <> 0 THEN ts END AS matched_at", f"{status} AS match_status", "CASE event_id % 5 WHEN 1 THEN 'too_few_passed' WHEN 2 THEN 'too_few_qualified' END AS attention_reason")


def _there(spark, d):
    """Candidates that still exist."""
    return b.candidates(spark, d).where("candidate_id % 37 <> 5")


def _scored(spark, d, listed=None):
    return mt.scored(_judged(spark, d, listed))


def rubric_scores(spark, d):
    return _scored(spark, d).withColumn("before_cap", F.round("before_cap", 6))


def review_queue(spark, d, listed=None, before=None):
    return mt.queued(_scored(spark, d, listed), matches_before(spark, d) if before is None else before, _there(spark, d))


def _merged(spark, d, basis=None):
    """Who could not be compared matters only where there is a match already, so only those pairs are looked at."""
    asked, held, listed, _, clock, vectors = basis or _basis(spark, d)
    before = kept(matches_before(spark, d), "matches")
    pair = ("role_id", "candidate_id")
    seen = kept(listed.select(*pair).union(fn.unranked_among(asked, held, *vectors, clock, before).select(*pair)), "considered")
    history = kept(_events(spark, d, before).select("match_id").distinct().join(before.hint("merge"), "match_id"), "history")
    new = kept(review_queue(spark, d, listed, before), "queue")
    return mt.merged(before, new, seen, history, b.roles(spark, d).where("status = 'open'").select("role_id"))


def run_outcomes(spark, d):
    basis = _basis(spark, d)
    asked, held, _, pool, clock, _ = basis
    passed = kept(counts_of(spark, d, asked, held, pool, clock).select("role_id", F.col("after_overlap").alias("passed")), "passed")
    rows = b.roles(spark, d).where("status = 'open'").select("role_id", (F.col("role_id") % 7 == 0).alias("partial")).join(passed.hint("merge"), "role_id", "left").na.fill({"passed": 0})
    return mt.run_outcomes(_scored(spark, d, basis[2]), kept(_merged(spark, d, basis), "merged"), rows)


def _failures(spark, d):
    return runs(spark, d).where("run_id % 4 = 0").selectExpr("run_id", "concat('service answered ', cast(500 + run_id % 4 AS string)) AS cause")


def audit_trail(spark, d):
    return rv.audit_trail(_events(spark, d), matches_before(spark, d), b.candidates(spark, d))


def scoped_matches(spark, d):
    """The first page of each persona: all, an employer's by role, talent's own."""
    rows = matches_before(spark, d).join(b.roles(spark, d).select("role_id", "title"), "role_id").join(b.candidates(spark, d).select("candidate_id", "full_name"), "candidate_id")
    by = [F.col("score").desc(), F.col("match_id").asc()]
    parts = [rv.page(rv.visible(rows, p, F.col("candidate_id")), by, 0, 20, [key]).select(F.lit(p).alias("persona"), F.col(key).alias("scope"), "place", "match_id", "title", "full_name", "score") for p, key in (("ops", "role_id"), ("employer", "role_id"), ("talent", "candidate_id"))]
    return parts[0].union(parts[1]).union(parts[2])


def entity_pages(spark, d):
    """The newest candidates, roles and jobs of each status, a page of 50 each."""
    jobs = b.table(spark, d, "events").selectExpr("'job' AS entity", "event_type AS status", "event_id AS id")
    rows = b.candidates(spark, d).selectExpr("'candidate' AS entity", "status", "candidate_id AS id").union(b.roles(spark, d).selectExpr("'role'", "status", "role_id")).union(jobs)
    return rv.page(rows, [F.col("id").desc()], 0, 50, ["entity", "status"])


def decisions(spark, d):
    before = kept(matches_before(spark, d), "matches")
    active = before.join(b.candidates(spark, d).selectExpr("candidate_id", "status = 'active' AS active"), "candidate_id")
    return rv.decisions(active, _events(spark, d, before))


QUERIES = {
    "rubric_scores": rubric_scores,
    "review_queue": review_queue,
    "match_merge": _merged,
    "run_outcomes": run_outcomes,
    "release_rule": lambda s, d: mt.release_rule(matches_before(s, d)),
    "next_in_reserve": lambda s, d: mt.reserve(matches_before(s, d), b.candidates(s, d)),
    "decision_queue": lambda s, d: rv.review_queue(matches_before(s, d)),
    "superseded_runs": lambda s, d: rv.standing_runs(runs(s, d)),
    "failed_runs": lambda s, d: rv.failed_runs(runs(s, d), _failures(s, d)),
    "role_status": lambda s, d: rv.role_status(b.roles(s, d), matches_before(s, d), runs(s, d)),
    "employer_status": lambda s, d: rv.for_employer(rv.role_status(b.roles(s, d), matches_before(s, d), runs(s, d))),
    "runs_page": lambda s, d: fn.runs_page(runs(s, d).withColumnRenamed("run_id", "id"), 0, 3).select("role_id", "place", "id"),
    "audit_trail": audit_trail,
    "scoped_matches": scoped_matches,
    "entity_pages": entity_pages,
    "decisions": decisions,
}

MATCHES = f"""{b.SQL},
mt AS MATERIALIZED (SELECT role_id, candidate_id, role_id * 10000000 + candidate_id AS match_id, ['proposed', 'pending_review', 'approved', 'rejected', 'swapped', 'proposed'][(candidate_id + role_id) % 6 + 1] AS status,
  (candidate_id + role_id) % 6 = 2 AND candidate_id % 4 = 0 OR (candidate_id + role_id) % 97 = 0 AS released, (candidate_id + role_id) % 6 = 5 AS by_hand, ((7 * candidate_id + 3 * role_id) % 101)::DOUBLE / 100 AS score,
  CASE WHEN (candidate_id + role_id) % 6 <> 5 THEN ((candidate_id * 5 + role_id) % 50 + 1)::INTEGER END AS run_rank FROM (SELECT DISTINCT l_partkey AS role_id, o_custkey AS candidate_id FROM lineitem JOIN orders ON l_orderkey = o_orderkey)),
nm AS (SELECT candidate_id, match_id, row_number() OVER (PARTITION BY candidate_id ORDER BY role_id) - 1 AS k, count(*) OVER (PARTITION BY candidate_id) AS n FROM mt),
ev AS MATERIALIZED (SELECT event_id, ts, match_id, CASE event_type WHEN 'purchase' THEN 'approve' WHEN 'error' THEN 'reject' WHEN 'view' THEN 'swap' WHEN 'click' THEN 'release' ELSE 'unrelease' END AS action,
  CASE WHEN event_type = 'view' THEN (user_id + event_id) % (SELECT count(*) FROM customer) END AS replacement_id FROM events JOIN nm ON user_id = candidate_id AND k = event_id % n),
run AS MATERIALIZED (SELECT event_id AS run_id, event_id % (SELECT count(*) FROM part) AS role_id, ts AS created_at, CASE WHEN event_id % 3 <> 0 THEN ts END AS matched_at,
  CASE event_id % 5 WHEN 0 THEN 'matched' WHEN 1 THEN 'needs_attention' WHEN 2 THEN 'needs_attention' WHEN 3 THEN 'matched' END AS match_status, CASE event_id % 5 WHEN 1 THEN 'too_few_passed' WHEN 2 THEN 'too_few_qualified' END AS attention_reason FROM events)
"""
JUDGED = f"""{MATCHES}, {RANKED.split(b.SQL + ",", 1)[1]},
judged AS MATERIALIZED (SELECT role_id, candidate_id, ((3 * candidate_id + 5 * role_id) % 5)::INTEGER AS l0, CASE WHEN len(required_software) > 0 THEN ((3 * candidate_id + 5 * role_id + 7) % 5)::INTEGER END AS l1,
  ((3 * candidate_id + 5 * role_id + 14) % 5)::INTEGER AS l2, ((3 * candidate_id + 5 * role_id + 21) % 5)::INTEGER AS l3, ((3 * candidate_id + 5 * role_id + 28) % 5)::INTEGER AS l4 FROM listed JOIN role USING (role_id)),
bc AS (SELECT *, (40 * l0 + 25 * coalesce(l1, 0) + 15 * l2 + 10 * l3 + 10 * l4)::DOUBLE / (300 + CASE WHEN l1 IS NULL THEN 0 ELSE 100 END) AS before_cap FROM judged),
sc AS (SELECT *, round(CASE l0 WHEN 0 THEN least(before_cap, 0.3) WHEN 1 THEN least(before_cap, 0.5) ELSE before_cap END, 3) AS score FROM bc),
rk AS MATERIALIZED (SELECT *, (row_number() OVER (PARTITION BY role_id ORDER BY score DESC, before_cap DESC, candidate_id))::INTEGER AS rank FROM sc),
q AS (SELECT rk.role_id, rk.candidate_id, rank, rk.score, coalesce(status = 'swapped', false) AS swapped, sum(CASE WHEN coalesce(status = 'swapped', false) THEN 0 ELSE 1 END) OVER (PARTITION BY rk.role_id ORDER BY rank) AS place FROM rk LEFT JOIN mt USING (role_id, candidate_id) WHERE rk.candidate_id % 37 <> 5),
nw AS MATERIALIZED (SELECT role_id, candidate_id, rank, score, CASE WHEN place <= 5 AND score >= 0.6 THEN 'pending_review' ELSE 'proposed' END AS new_status, swapped FROM q),
seen AS (SELECT role_id, candidate_id FROM listed UNION SELECT role_id, candidate_id FROM unr),
hist AS (SELECT DISTINCT role_id, candidate_id FROM ev JOIN mt USING (match_id)),
both_ AS (SELECT role_id, candidate_id, mt.status AS was, new_status, coalesce(mt.status IN ('proposed', 'pending_review') AND NOT released AND NOT by_hand, false) AS free, s.role_id IS NOT NULL AS considered, h.role_id IS NOT NULL AS history, r.status = 'open' AS ran
  FROM mt FULL JOIN nw USING (role_id, candidate_id) LEFT JOIN seen s USING (role_id, candidate_id) LEFT JOIN hist h USING (role_id, candidate_id) LEFT JOIN role r USING (role_id)),
mc AS (SELECT *, CASE WHEN was IS NULL THEN 'inserted' WHEN new_status IS NOT NULL THEN (CASE WHEN free THEN 'replaced' ELSE 'kept' END) WHEN ran AND free AND NOT considered AND NOT history THEN 'removed' WHEN ran AND free AND NOT considered AND was = 'pending_review' THEN 'demoted' ELSE 'kept' END AS change FROM both_),
mg AS MATERIALIZED (SELECT role_id, candidate_id, change, CASE WHEN change IN ('inserted', 'replaced') THEN new_status WHEN change = 'demoted' THEN 'proposed' WHEN change = 'kept' THEN was END AS status FROM mc)"""
_STATUS = f"""WITH {MATCHES}, rel AS (SELECT role_id, count(*) AS n FROM mt WHERE released GROUP BY 1), lat AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY role_id ORDER BY created_at DESC, run_id) AS k FROM run WHERE match_status IS NOT NULL) WHERE k = 1),
st AS (SELECT role_id, coalesce(n, 0) AS released, run_id, CASE WHEN coalesce(n, 0) >= 2 THEN 'ready' WHEN match_status = 'needs_attention' THEN 'needs_attention' ELSE 'in_review' END AS status FROM role LEFT JOIN rel USING (role_id) LEFT JOIN lat USING (role_id))"""


def _page(persona: str, key: str, where: str) -> str:
    return f"SELECT '{persona}' AS persona, {key} AS scope, k::INTEGER AS place, match_id, title, full_name, score FROM (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY score DESC, match_id) AS k FROM j WHERE {where}) WHERE k <= 20"


ORACLES = {
    "rubric_scores": f"WITH {JUDGED} SELECT role_id, candidate_id, l0, l1, l2, l3, l4, round(before_cap, 6) AS before_cap, score, rank FROM rk",
    "review_queue": f"WITH {JUDGED} SELECT * FROM nw",
    "match_merge": f"WITH {JUDGED} SELECT * FROM mg",
    "run_outcomes": f"""WITH {JUDGED}, ql AS (SELECT rk.role_id, count(*) FILTER (score >= 0.6 AND coalesce(mg.status NOT IN ('rejected', 'swapped'), false)) AS qualified FROM rk LEFT JOIN mg USING (role_id, candidate_id) GROUP BY 1),
ps AS (SELECT role_id, count(*) FILTER (cleared = 6) AS passed FROM staged GROUP BY 1)
SELECT role_id, qualified, CASE WHEN qualified IS NOT NULL THEN 0.6::DOUBLE END AS min_score, CASE WHEN passed < 2 THEN 'needs_attention' WHEN coalesce(qualified, 0) >= 2 THEN 'matched' WHEN role_id % 7 <> 0 THEN 'needs_attention' END AS match_status,
  CASE WHEN passed < 2 THEN 'too_few_passed' WHEN coalesce(qualified, 0) < 2 AND role_id % 7 <> 0 THEN 'too_few_qualified' END AS attention_reason FROM ps LEFT JOIN ql USING (role_id)""",
    "release_rule": f"WITH {MATCHES}, c AS (SELECT role_id, count(*) FILTER (status = 'approved') AS approved, count(*) FILTER (released AND status <> 'approved') AS odd, count(*) FILTER (released) AS released FROM mt GROUP BY role_id) SELECT role_id, approved, released, CASE WHEN approved <> 2 THEN 'a release needs exactly 2 approved candidates, and this role has ' || approved WHEN odd > 0 THEN odd || ' released match(es) of this role are not approved: withdraw them before releasing' ELSE 'release' END AS action FROM c",
    "next_in_reserve": f"WITH {MATCHES}, k AS (SELECT role_id, candidate_id, match_id, score, row_number() OVER (PARTITION BY role_id ORDER BY score DESC, run_rank NULLS LAST, match_id) AS k FROM mt JOIN cand USING (candidate_id) WHERE mt.status = 'proposed' AND NOT released AND score >= 0.6 AND cand.status = 'active') SELECT role_id, candidate_id, match_id, score FROM k WHERE k = 1",
    "decision_queue": f"WITH {MATCHES}, p AS (SELECT *, CASE WHEN status = 'approved' THEN 'approved' ELSE 'pending' END AS part FROM mt WHERE status IN ('pending_review', 'approved')) SELECT role_id, part, (row_number() OVER (PARTITION BY role_id, part ORDER BY score DESC, run_rank NULLS LAST, match_id))::INTEGER AS place, match_id, candidate_id, score FROM p",
    "superseded_runs": f"WITH {MATCHES}, m AS (SELECT role_id, max(created_at) AS newest FROM run WHERE matched_at IS NOT NULL GROUP BY 1) SELECT run_id, coalesce(created_at < newest, false) AS superseded FROM run LEFT JOIN m USING (role_id)",
    "failed_runs": f"WITH {MATCHES} SELECT run_id, role_id, CASE WHEN run_id % 4 = 0 AND matched_at IS NULL THEN 'needs_attention' ELSE match_status END AS match_status, CASE WHEN run_id % 4 = 0 AND matched_at IS NULL THEN 'ai_failed' ELSE attention_reason END AS attention_reason, CASE WHEN run_id % 4 = 0 AND matched_at IS NULL THEN 'service answered ' || (500 + run_id % 4) END AS attention_detail FROM run",
    "role_status": f"{_STATUS} SELECT * FROM st",
    "employer_status": f"{_STATUS} SELECT role_id, CASE WHEN status = 'needs_attention' THEN 'in_review' ELSE status END AS status, released FROM st",
    "runs_page": f"WITH {MATCHES} SELECT * FROM (SELECT role_id, (row_number() OVER (PARTITION BY role_id ORDER BY created_at DESC, run_id))::INTEGER AS place, run_id AS id FROM run) WHERE place <= 3",
    "audit_trail": f"WITH {MATCHES} SELECT role_id, (row_number() OVER (PARTITION BY role_id ORDER BY event_id))::INTEGER AS place, event_id, match_id, mt.candidate_id, c.full_name AS candidate_name, action, o.full_name AS replacement_name FROM ev JOIN mt USING (match_id) JOIN cand c USING (candidate_id) LEFT JOIN cand o ON o.candidate_id = replacement_id",
    "scoped_matches": f"WITH {MATCHES}, j AS MATERIALIZED (SELECT mt.*, title, full_name FROM mt JOIN role USING (role_id) JOIN cand USING (candidate_id)) {_page('ops', 'role_id', 'true')} UNION ALL {_page('employer', 'role_id', 'released')} UNION ALL {_page('talent', 'candidate_id', 'released')}",
    "entity_pages": f"WITH {b.SQL}, r AS (SELECT 'candidate' AS entity, status, candidate_id AS id FROM cand UNION ALL SELECT 'role', status, role_id FROM role UNION ALL SELECT 'job', event_type, event_id FROM events) SELECT entity, status, id, place FROM (SELECT *, (row_number() OVER (PARTITION BY entity, status ORDER BY id DESC))::INTEGER AS place FROM r) WHERE place <= 50",
}
