"""Streams give what the batch forms give on the same rows."""

import datetime
import random

import pandas as pd

from rolemesh.operators import review, text
from rolemesh.streaming import decisions, queue, refresh

MATCHES = "role_id long, match_id long, status string, released boolean, active boolean, score double, run_rank int"


def files(spark, tmp_path, parts, schema):
    for k, rows in enumerate(parts):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        for f in (tmp_path / "in").glob("part-*.parquet"):
            if not f.name.startswith("part-x"):
                f.rename(f.with_name(f"part-x{k}.parquet"))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))


def matches():
    return [(r, 100 * r + k, ["pending_review", "pending_review", "proposed", "proposed", "approved"][k], False, k != 3, 0.9 - k / 10, k) for r in (1, 2) for k in range(5)]


def events():
    said = ["approve", "approve", "swap", "release", "reject", "unrelease", "swap", "approve", "release", "approve"]
    day = datetime.datetime(2024, 1, 1)
    return [(n, 100 * r + n % 5, day + datetime.timedelta(minutes=n), a) for r in (1, 2) for n, a in enumerate(said)]


def test_decisions_by_batches(spark, tmp_path):
    schema = "event_id long, match_id long, ts timestamp, action string"
    rows = [(100 * r[1] + r[0], *r[1:]) for r in events()]
    rows.sort(key=lambda r: (r[2], r[0]))
    begin = spark.createDataFrame(matches(), MATCHES)
    roles = begin.select("match_id", "role_id")
    refresh.kept_current(files(spark, tmp_path, [rows[:6], rows[6:14], rows[14:]], schema), begin, refresh.decided, str(tmp_path / "state"), "role_id", 8, lambda batch: batch.join(roles, "match_id"))
    got = {r.match_id: (r.status, r.released) for r in refresh.state(spark, str(tmp_path / "state"), begin).collect()}
    whole = review.decisions(begin, spark.createDataFrame(rows, schema)).where("match_id IS NOT NULL").collect()
    assert got == {r.match_id: (r.status, r.released) for r in whole}
    assert {s for s, _ in got.values()} >= {"approved", "swapped"}


def test_decisions_as_keyed_state(spark, tmp_path):
    """Three batches give what the whole gives; an event that comes again changes nothing, and one that comes late meets the state of its batch."""
    schema = "event_id long, match_id long, ts timestamp, action string"
    rows = [(100 * r[1] + r[0], *r[1:]) for r in events()]
    rows.sort(key=lambda r: (r[2], r[0]))
    begin = spark.createDataFrame(matches() + [(3, 300, "proposed", False, True, 0.9, None)], MATCHES)
    late = (1, 104, datetime.datetime(2023, 1, 1), "reject")
    parts = [rows[:6], [*rows[6:14], rows[2], rows[7]], [*rows[14:], rows[0]], [late, late, (2, 999, datetime.datetime(2024, 1, 2), "approve")]]
    stream = files(spark, tmp_path, parts, schema)
    decisions.decided(stream, begin).writeStream.format("memory").queryName("decided").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    out = spark.table("decided").collect()
    whole = review.decisions(begin, spark.createDataFrame([*rows, (*late[:2], datetime.datetime(2025, 1, 1), late[3])], schema)).collect()
    said = sorted((r.event_id, r.result) for r in out if r.event_id is not None)
    assert said == sorted((r.event_id, r.result) for r in whole if r.event_id is not None)
    got = {r[1]: (r[2], r[3]) for r in [*matches(), (3, 300, "proposed", False)]}
    for r in out:  # batch by batch
        if r.match_id is not None:
            got[r.match_id] = (r.status, r.released)
    assert got == {r.match_id: (r.status, r.released) for r in whole if r.match_id is not None}
    assert not any(r.role_id == 3 for r in out)  # a list that no event concerns isn't touched


def test_fold_rules(spark):
    begin = spark.createDataFrame(matches()[:5], MATCHES)
    day = datetime.datetime(2024, 1, 1)
    said = [("approve", 100), ("approve", 100), ("swap", 101), ("approve", 101), ("release", 100), ("reject", 100), ("reject", 104), ("unrelease", 100), ("swap", 104), ("release", 100)]
    rows = [(n, m, day + datetime.timedelta(minutes=n), a) for n, (a, m) in enumerate(said)]
    log = {r.event_id: r.result for r in review.decisions(begin, spark.createDataFrame(rows, "event_id long, match_id long, ts timestamp, action string")).where("event_id IS NOT NULL").collect()}
    assert [log[n] for n in range(10)] == ["done", "no change", "done: 102 brought in", "refused: the match is swapped", "done", "refused: the match is released", "refused: the match is released", "done", "refused: the match is released", "done"]


def test_refresh(spark, tmp_path):
    begin = spark.createDataFrame([(1, "tax close", {0: 1.0}), (2, "audit", {1: 1.0}), (3, "old", None)], "candidate_id long, text string, vector map<long,double>")
    stream = files(spark, tmp_path, [[(1, "tax close", 1), (4, "new one", 1)], [(2, "audit of banks", 2)]], "candidate_id long, text string, n int")
    refresh.kept_current(stream, begin, lambda a, b: refresh.refreshed(a, b, text.hashed_embedding), str(tmp_path / "state"), "candidate_id", 16)
    got = {r.candidate_id: r for r in refresh.state(spark, str(tmp_path / "state"), begin).collect()}
    assert got[1].vector == {0: 1.0}  # unchanged text, vector kept
    want = {}
    for r in text.hashed_embedding(spark.createDataFrame([(2, "audit of banks"), (3, "old"), (4, "new one")], "doc_id long, text string")).collect():
        want.setdefault(r.doc_id, {})[r.bucket] = r.weight
    assert {k: got[k].vector for k in (2, 4)} == {k: want[k] for k in (2, 4)}
    assert got[3].vector in (None, want[3])  # embedded once its bucket is touched
    # buckets that nobody's change falls into have one version, the first
    of = {r.candidate_id: r.b for r in spark.createDataFrame([(k,) for k in (1, 2, 3, 4)], "candidate_id long").select("candidate_id", refresh.bucket_of("candidate_id", 16).alias("b")).collect()}
    written = {(r.batch, r.bucket) for r in spark.read.parquet(str(tmp_path / "state" / "written")).collect()}
    assert written == {(-1, k) for k in range(16)} | {(0, of[1]), (0, of[4]), (1, of[2])}
    assert {r.candidate_id: r.text for r in refresh.state(spark, str(tmp_path / "state"), begin, before=1).collect()} == {1: "tax close", 2: "audit", 3: "old", 4: "new one"}


def test_a_bucket_may_become_empty(spark, tmp_path):
    begin = spark.createDataFrame([(k, "x") for k in range(20)], "id long, v string")
    stream = files(spark, tmp_path, [[(k,) for k in range(20)], [(5,)]], "id long")
    gone = lambda rows, batch: rows.join(batch, "id", "left_anti")
    refresh.kept_current(stream, begin, gone, str(tmp_path / "state"), "id", 4)
    assert refresh.state(spark, str(tmp_path / "state"), begin).count() == 0
    assert refresh.state(spark, str(tmp_path / "state"), begin, before=0).count() == 20


def test_only_concerned_roles_are_matched_again(spark):
    """After a change of people, new shortlists of the concerned roles and old ones of the others are the shortlists of all roles."""
    from rolemesh.operators import funnel

    asks = "role_id long, required_certifications array<string>, required_software array<string>, min_years int, starts_on date, hours_per_week int, timezone string, min_overlap_hours int, status string, accept_equivalents boolean"
    roles = spark.createDataFrame([(k, [], [["s"], ["t"], ["s", "t"], ["u"]][k % 4], None, None, None, None, None, "open", True) for k in range(12)], asks)
    terms = spark.createDataFrame([], "id string, grp string, variant_of string")
    zones = spark.createDataFrame([("UTC",)], "zone string")
    people = spark.createDataFrame([(k, f"n{k}", "active") for k in range(10)], "candidate_id long, full_name string, status string")
    answers = spark.createDataFrame([(k, "UTC", 0, 600, 40, None) for k in range(10)], "candidate_id long, timezone string, work_start int, work_end int, hours_per_week int, available_from date")
    vectors = lambda n, key, f: spark.createDataFrame([(k, None, f(k)) for k in range(n)], f"{key} long, model string, v array<double>")
    rv, cv = vectors(12, "role_id", lambda k: [1.0, k / 10]), vectors(10, "candidate_id", lambda k: [1.0, k / 7])
    skills = lambda new: spark.createDataFrame([(k, [], ["t"] if k == 3 and new else ["s"] if k % 2 else ["t"], 3) for k in range(10)], "candidate_id long, certifications array<string>, software array<string>, years_experience int")
    asked = funnel.asked_of(roles, terms, "2026-01-01").cache()
    before, after = (funnel.holders(asked, funnel.pool_of(people, skills(new), answers)).cache() for new in (False, True))
    near = lambda a, h: funnel.shortlist(a, h, rv, cv, zones, 4)
    again = refresh.to_match_again(asked, before, after, spark.createDataFrame([(3,)], "candidate_id long"))
    assert {r.role_id % 4 for r in again.collect()} == {0, 1}  # nobody holds s and t, or u
    merged = refresh.rematched(near(asked, before), again, near(again, after))
    rows = lambda df: {(r.role_id, r["rank"], r.candidate_id) for r in df.collect()}
    assert rows(merged) == rows(near(asked, after)) != rows(near(asked, before))


def test_queued_once(spark, tmp_path):
    parts = [[(1, "a", 1, "queued"), (2, "a", 1, "queued"), (3, "b", 1, "queued")], [(4, "a", 1, "queued"), (5, "a", 1, "running")], [(6, "a", 1, "queued"), (7, "b", 1, "queued")]]
    stream = files(spark, tmp_path, parts, "id long, kind string, payload long, status string")
    queue.queued_once(stream).writeStream.format("memory").queryName("queued").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    assert {r.id: r.kept for r in spark.table("queued").collect()} == {1: True, 2: False, 3: True, 4: False, 6: True, 7: False}


def test_stale_running(spark, tmp_path):
    day = datetime.datetime(2024, 1, 1)
    at = lambda m: day + datetime.timedelta(minutes=m)
    parts = [[(1, "running", at(0)), (2, "running", at(1))], [(2, "succeeded", at(3))], [(3, "running", at(500))], [(4, "running", at(501))], [(5, "queued", at(502))]]
    stream = files(spark, tmp_path, parts, "id long, status string, ts timestamp")
    queue.stale_running(stream, 300).writeStream.format("memory").queryName("stale").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    assert [(r.id, r.began) for r in spark.table("stale").collect()] == [(1, at(0))]


class Cell:
    """A value of keyed state, held in memory."""

    def __init__(self):
        self.value = None

    def exists(self):
        return self.value is not None

    def get(self):
        return self.value

    def update(self, value):
        self.value = value

    def clear(self):
        self.value = None


def test_queued_once_in_any_batches():
    """Random events cut into random batches, against a plain walk over them."""
    r = random.Random(3)
    for _ in range(200):
        rows = [(k, r.choice(["queued", "queued", "running", "failed"])) for k in range(r.randrange(1, 14))]
        waiting, want = False, {}
        for k, status in rows:
            if status == "queued":
                want[k], waiting = not waiting, True
            elif status == "running":
                waiting = False
        step, got = queue.Waiting(), {}
        step.queued = Cell()
        while rows:
            n = r.randrange(1, len(rows) + 1)
            part, rows = r.sample(rows[:n], n), rows[n:]
            for out in step.handleInputRows(("a", 1), iter([pd.DataFrame(part, columns=["id", "status"])]), None):
                got |= dict(zip(out["id"].tolist(), out["kept"].tolist(), strict=True))
        assert got == want
        assert step.queued.exists() == waiting


def test_roles_are_folded_as_they_come(spark):
    """Batches of a few rows, so that roles go over their ends; each role as by its own fold."""
    rows = [(r, 1000 * r + m, ["proposed", "pending_review", "approved", "swapped"][(r + m) % 4], (r * m) % 11 == 0, m % 5 > 0, None if m % 7 == 0 else (m * 13 % 10) / 10, None if m % 3 == 0 else m % 4) for r in range(40) for m in range(r % 9 + 1)]
    matches = spark.createDataFrame(rows, "role_id long, match_id long, status string, released boolean, active boolean, score double, run_rank int")
    asked = [(k, 1000 * (k % 40) + k % (k % 40 % 9 + 1), datetime.datetime(2025, 1, 1) + datetime.timedelta(minutes=k * 37 % 101), ["approve", "reject", "swap", "release", "unrelease"][k * 7 % 5]) for k in range(600)]
    events = spark.createDataFrame(asked, "event_id long, match_id long, ts timestamp, action string")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        found = review.decisions(matches, events)
        assert "FlatMapGroups" not in found._jdf.queryExecution().executedPlan().toString()  # no call for each role
        got = {(r.role_id, r.match_id, r.status, r.released, r.event_id, r.result) for r in found.collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    m, e, want = matches.toPandas(), events.toPandas(), set()
    for role, own in m.groupby("role_id"):
        ends, log = review.fold(own, e[e["match_id"] // 1000 == role])
        want |= {(role, x, s, bool(r), None, None) for x, s, r in ends.itertuples(index=False)} | {(role, None, None, None, k, s) for k, s in log.itertuples(index=False)}
    assert got == want and len(got) == len(rows) + 600
