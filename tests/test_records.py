"""Matches, runs, jobs, rules and updates on small frames where each row tests one rule."""

import datetime

from pyspark.sql import functions as F
from rolemesh.operators import evaluate, jobs, matches, quality, reasons, review
from rolemesh.sources import tables, taxonomy


def test_merge(spark):
    keys = "role_id int, candidate_id int, "
    before = spark.createDataFrame(
        [(1, 1, "proposed", False, False), (1, 2, "approved", False, False), (1, 3, "pending_review", False, False), (1, 4, "pending_review", False, False), (1, 5, "pending_review", False, True), (1, 6, "proposed", False, False), (1, 7, "swapped", False, False), (2, 1, "proposed", False, False), (1, 8, "proposed", True, False)],
        keys + "status string, released boolean, by_hand boolean",
    )
    ranked = spark.createDataFrame([(1, 1, 1, 0.9), (1, 2, 2, 0.8), (1, 7, 3, 0.7), (1, 9, 4, 0.7), (1, 10, 5, 0.65), (1, 99, 6, 0.6), (1, 11, 7, 0.2)], keys + "rank int, score double")
    people = spark.createDataFrame([(k,) for k in range(20)], "candidate_id int")
    queue = matches.queued(ranked, before, people, size=3, least=0.6)
    status = {r.candidate_id: r.new_status for r in queue.collect()}
    assert status == {1: "pending_review", 2: "pending_review", 7: "pending_review", 9: "pending_review", 10: "proposed", 11: "proposed"}  # a swapped one takes no place, a deleted one is skipped
    seen, runs = spark.createDataFrame([(1, 6)], keys.rstrip(", ")), spark.createDataFrame([(1,)], "role_id int")
    history = spark.createDataFrame([(1, 4)], keys.rstrip(", "))
    merged = matches.merged(before, queue, seen, history, runs)
    got = {(r.role_id, r.candidate_id): (r.change, r.status) for r in merged.collect()}
    assert got[(1, 1)] == ("replaced", "pending_review") and got[(1, 2)] == ("kept", "approved") and got[(1, 7)] == ("kept", "swapped") and got[(1, 9)] == ("inserted", "pending_review")
    assert got[(1, 3)] == ("removed", None) and got[(1, 4)] == ("demoted", "proposed") and got[(1, 5)] == ("kept", "pending_review") and got[(1, 6)] == ("kept", "proposed") and got[(1, 8)] == ("kept", "proposed")
    assert got[(2, 1)] == ("kept", "proposed")  # a role that didn't run
    plan = spark.createDataFrame([(1, 9, False), (2, 1, False), (3, 5, True)], "role_id int, passed int, partial boolean")
    ends = {r.role_id: (r.qualified, r.match_status, r.attention_reason) for r in matches.run_outcomes(ranked, merged, plan).collect()}
    assert ends == {1: (4, "matched", None), 2: (None, "needs_attention", "too_few_passed"), 3: (None, None, None)}


def test_reserve_needs_an_active_candidate(spark):
    rows = spark.createDataFrame([(1, 1, 11, "proposed", False, 0.9, 1), (1, 2, 12, "proposed", False, 0.8, None), (1, 3, 13, "proposed", False, 0.8, 7), (1, 4, 14, "approved", False, 1.0, 1)], "role_id int, candidate_id int, match_id int, status string, released boolean, score double, run_rank int")
    people = spark.createDataFrame([(1, "archived"), (2, "active"), (3, "active"), (4, "active")], "candidate_id int, status string")
    assert matches.reserve(rows, people).first().candidate_id == 3


def test_stale_jobs(spark):
    old = datetime.datetime(2024, 1, 1)
    rows = [(1, "a", 1, "running", old, 3, 3), (2, "a", 1, "running", old, 1, 3), (3, "a", 1, "running", old, 1, 3), (4, "b", 1, "running", old, 1, 3), (5, "b", 1, "queued", old, 0, 3), (6, "c", 1, "running", old + datetime.timedelta(days=30), 0, 3)]
    got = {r.id: r.next_status for r in jobs.stale_running(spark.createDataFrame(rows, "id int, kind string, payload int, status string, run_at timestamp, attempts int, max_attempts int"), F.lit("2024-01-02").cast("timestamp"), 300).collect()}
    assert got == {1: "failed", 2: "queued", 3: "failed", 4: "failed"}


def test_role_status_and_supersession(spark):
    t = lambda h: datetime.datetime(2024, 1, 1, h)
    runs = spark.createDataFrame([(1, 1, t(1), t(2), "matched", None), (2, 1, t(3), t(4), "needs_attention", "too_few_passed"), (3, 1, t(2), None, None, None), (4, 2, t(1), None, None, None)], "run_id int, role_id int, created_at timestamp, matched_at timestamp, match_status string, attention_reason string")
    assert {r.run_id: r.superseded for r in review.standing_runs(runs).collect()} == {1: True, 2: False, 3: True, 4: False}
    rows = spark.createDataFrame([(3, True), (3, True)], "role_id int, released boolean")
    roles = spark.createDataFrame([(1,), (2,), (3,)], "role_id int")
    status = review.role_status(roles, rows, runs)
    assert {r.role_id: (r.status, r.run_id) for r in status.collect()} == {1: ("needs_attention", 2), 2: ("in_review", None), 3: ("ready", None)}
    assert {r.role_id: r.status for r in review.for_employer(status).collect()} == {1: "in_review", 2: "in_review", 3: "ready"}
    failed = review.failed_runs(runs, spark.createDataFrame([(1, "x"), (3, "y")], "run_id int, cause string"))
    assert {r.run_id: r.attention_detail for r in failed.collect()} == {1: None, 2: None, 3: "y", 4: None}


def test_verdicts(spark):
    terms = spark.createDataFrame([("cpa_us", "US CPA", "g", "cpa"), ("cpa", "CPA", "g", None), ("acca", "ACCA", "g", None), ("aat", "AAT", "t", None)], "id string, label string, grp string, variant_of string")
    roles = spark.createDataFrame([(1, ["cpa"], True), (2, ["cpa"], False)], "role_id int, required_certifications array<string>, accept_equivalents boolean")
    profiles = spark.createDataFrame([(1, ["acca", "cpa_us"]), (2, ["acca"]), (3, ["aat"])], "candidate_id int, certifications array<string>")
    pairs = spark.createDataFrame([(r, c) for r in (1, 2) for c in (1, 2, 3)], "role_id int, candidate_id int")
    got = {(r.role_id, r.candidate_id): (r.passed, r.held, r.reason) for r in reasons.qualification_verdicts(pairs, roles, profiles, terms).collect()}
    assert got[(1, 1)] == (True, "cpa_us", "Holds US CPA, which this role asks for")
    assert got[(1, 2)] == (True, "acca", "Holds ACCA, equivalent to the CPA this role asks for")
    assert got[(2, 2)] == (False, "acca", "Holds ACCA, the same level as a CPA, but this role requires the CPA itself")
    assert got[(1, 3)][2] == "No CPA or equivalent on the resume" and got[(2, 3)][2] == "No CPA on the resume"


def test_rules_of_tables(spark):
    t = spark.createDataFrame([(1, "open", 9), (2, "odd", None), (3, None, 2)], "role_id int, status string, h int")
    rules = [(t, "status", F.col("role_id"), ~F.col("status").isin("open")), (t, "hours", F.col("role_id"), ~F.col("h").between(1, 8))]
    assert {tuple(r) for r in quality.violations(rules).collect()} == {("status", "2"), ("hours", "1")}
    assert [tuple(r) for r in quality.repeated([(t.union(t.where("role_id = 3")), "status", [F.col("status")])]).collect()] == []
    assert [tuple(r) for r in quality.orphans([(t, "h", "h", t.where("role_id = 3"), "h")]).collect()] == [("h", "9", 1)]


def test_updates(spark):
    table = spark.createDataFrame([(1, "a", 1, "v"), (2, "b", 2, "v"), (3, None, 3, "v")], "id int, text string, n int, embedding string")
    new = spark.createDataFrame([(1, "a", 9), (2, "c", 2), (3, None, 7), (4, "d", 4)], "id int, text string, n int")
    got = {r.id: (r.text, r.n, r.embedding, r.change) for r in tables.upserted(table, new.where("id <> 3 OR n = 7"), "id", ["text"], ["embedding"]).collect()}
    assert got == {1: ("a", 9, "v", "replaced"), 2: ("c", 2, None, "replaced"), 3: (None, 7, "v", "replaced"), 4: ("d", 4, None, "inserted")}
    patches = spark.createDataFrame([(1, ["n"], "zz", None), (2, ["text"], None, 5)], "id int, supplied array<string>, text string, n int")
    got = {r.id: (r.text, r.n) for r in tables.patched(table.drop("embedding"), patches, "id").collect()}
    assert got == {1: ("a", None), 2: (None, 2), 3: (None, 3)}
    assert sorted(r.id for r in tables.appended(table.drop("embedding"), new, ["id"]).collect()) == [1, 2, 3, 4]


def test_deletes(spark):
    people = spark.createDataFrame([(1,), (2,), (3,)], "candidate_id int")
    held = spark.createDataFrame([(10, 1), (20, 2)], "match_id int, candidate_id int")
    left, blocked = tables.deleted(people.where("candidate_id < 3"), people, {"profiles": people}, held, spark.createDataFrame([(10,)], "match_id int"))
    assert {n: sorted(r.candidate_id for r in t.collect()) for n, t in left.items()} == {"candidates": [1, 3], "profiles": [1, 3], "matches": [1]}
    assert [r.candidate_id for r in blocked.collect()] == [1]


def test_sources(spark, tmp_path):
    (tmp_path / "a.txt").write_text("one\ntwo")
    (tmp_path / "b.txt").write_text("")
    (tmp_path / "c.txt").write_text("alone")
    (tmp_path / "a.expected.json").write_text('{"n": 2}')
    got = {r.slug: (r.text, r.expected and r.expected.n) for r in tables.corpus(spark, str(tmp_path), "n int").collect()}
    assert got == {"a": ("one\ntwo", 2), "c": ("alone", None)}
    (tmp_path / "v.json").write_text('{"software": [{"id": "xero", "label": "Xero", "aliases": ["X"]}], "certifications": [{"id": "cpa_us", "label": "US CPA", "group": "full", "variant_of": ["cpa"]}], "jurisdictions": [{"id": "uk", "aliases": ["England"], "timezones": ["Europe/London"]}]}')
    v = taxonomy.read(spark, str(tmp_path / "v.json"))
    assert {tuple(r) for r in v["names"].collect()} == {("software", "xero", "xero"), ("software", "xero", "Xero"), ("software", "xero", "X"), ("certifications", "cpa_us", "cpa_us"), ("certifications", "cpa_us", "US CPA")}
    assert [tuple(r) for r in v["variants"].collect()] == [("cpa_us", "cpa")] and v["places"].first().name == "England"
    spark.createDataFrame([("1", "n")], "id string, full_name string").write.parquet(str(tmp_path / "t" / "candidates"))
    row = tables.scan(spark, str(tmp_path / "t"), ("candidates",))["candidates"].first()
    assert (row.full_name, row.status) == ("n", None)
    tables.write_reports({"runs": (spark.createDataFrame([(1, "x"), (2, "y")], "role_id int, s string"), ["role_id"])}, str(tmp_path / "r"))
    assert (tmp_path / "r" / "runs" / "role_id=1").exists()


def test_evaluation(spark):
    row = spark.createDataFrame([(" A", "a", None)], "x string, y string, z string").select(evaluate.exact(F.col("x"), F.col("y")), evaluate.exact(F.col("z"), F.col("z")), evaluate.exact(F.col("x"), F.col("z"))).first()
    assert tuple(row) == (1.0, 1.0, 0.0)
    scores = spark.createDataFrame([(1, "s", "f", 1.0), (2, "s", "f", 1.0)], "case_id int, section string, field string, score double")
    assert evaluate.field_means(scores, spark.createDataFrame([(2,)], "case_id int")).first()["mean"] == 0.5
    ranked = spark.createDataFrame([(1, c, c) for c in range(1, 5)], "role_id int, candidate_id int, rank int")
    got = evaluate.precision_at_truth(ranked, spark.createDataFrame([(1, 1), (1, 4)], "role_id int, candidate_id int")).first()
    assert (got.k, got.hits, got["precision"]) == (2, 1, 0.5)


def test_matches_are_dealt_by_a_count_of_lines(spark, monkeypatch):
    from rolemesh.plans import review_queries

    d = "/root/testdata/sf0.001"
    lines = spark.read.parquet(f"{d}/lineitem.parquet").count()
    few = review_queries.matches_before(spark, d)
    monkeypatch.setattr(review_queries, "LINES", 500)
    many = review_queries.matches_before(spark, d)
    assert few.rdd.getNumPartitions() == 1 and many.rdd.getNumPartitions() == 1 + lines // 500 > 10  # however well keys pack
    assert not few.exceptAll(many).count() and not many.exceptAll(few).count()
