"""Operators on small frames where each row tests one rule."""

import datetime

import pytest
from pyspark.sql import functions as F
from rolemesh.operators import funnel, jobs, matches
from rolemesh.sources.scratch import kept

#: role zone, candidate zone, start, end, day, minutes of the role's day 09:00-17:00 in the candidate's hours.
OVERLAPS = [
    ("America/New_York", "America/New_York", 540, 1020, "2026-06-15", 480),
    ("America/New_York", "America/Los_Angeles", 540, 1020, "2026-06-15", 300),
    ("America/New_York", "Europe/London", 540, 1020, "2026-03-09", 240),  # the United States have changed their clocks, Britain hasn't
    ("America/New_York", "Europe/London", 540, 1020, "2026-06-15", 180),
    ("America/New_York", "Asia/Manila", 1260, 360, "2026-06-15", 480),  # a night shift
    ("America/New_York", "XYZ5", 540, 1020, "2026-06-15", None),
    ("Nowhere", "Asia/Manila", 540, 1020, "2026-06-15", None),
    ("Asia/Manila", "America/New_York", 60, 240, "2026-03-08", 120),  # 20:00 to 05:00, where the clock goes from 02:00 to 03:00
    ("Asia/Manila", "America/New_York", 60, 120, "2026-11-01", 120),  # 21:00 to 04:00, where the hour from 01:00 comes twice
]


def test_overlap_minutes(spark):
    rows = [(r, datetime.date.fromisoformat(d), z, s, e) for r, z, s, e, d, _ in OVERLAPS]
    tuples = spark.createDataFrame(rows, "role_zone string, day date, zone string, work_start int, work_end int")
    zones = spark.createDataFrame([(z,) for z in {x for o in OVERLAPS for x in o[:2]} - {"XYZ5", "Nowhere"}], "zone string")
    got = {(r.role_zone, r.zone, str(r.day)): r.minutes for r in funnel.overlap_minutes(tuples, zones).collect()}
    assert got == {(r, z, d): m for r, z, _, _, d, m in OVERLAPS}


def pool(spark):
    """Candidates who each miss one thing: profile, certificate, software, years, answers, hours, overlap, a known zone; 8 misses nothing, 9 is archived."""
    day = datetime.date(2026, 1, 1)
    roles = spark.createDataFrame(
        [(1, ["x"], ["s"], 3, day, 20, "Europe/London", 2, "open", True), (2, [], ["s"], None, None, None, None, None, "open", None), (3, [], [], None, None, None, None, 2, "open", True), (4, ["nobody"], [], None, None, None, None, None, "open", True), (5, [], [], 0, None, None, None, None, "open", False), (6, [], [], None, None, None, None, None, "closed", True)],
        "role_id int, required_certifications array<string>, required_software array<string>, min_years int, starts_on date, hours_per_week int, timezone string, min_overlap_hours int, status string, accept_equivalents boolean",
    )
    people = spark.createDataFrame([(k, f"n{k}", "archived" if k == 9 else "active") for k in range(10)], "candidate_id int, full_name string, status string")
    profiles = spark.createDataFrame([(k, ["y"] if k == 1 else ["x"], [] if k == 2 else ["s", "t"], None if k == 3 else 3) for k in range(1, 10)], "candidate_id int, certifications array<string>, software array<string>, years_experience int")
    late = datetime.date(2031, 1, 1)
    answers = spark.createDataFrame([(k, "Asia/Manila" if k == 6 else "XYZ5" if k == 7 else "Europe/London", 540, 1020, 10 if k == 5 else 40, late if k == 3 else day) for k in range(10) if k != 4], "candidate_id int, timezone string, work_start int, work_end int, hours_per_week int, available_from date")
    terms = spark.createDataFrame([("x", "g", None), ("y", "h", None)], "id string, grp string, variant_of string")
    zones = spark.createDataFrame([("Europe/London",), ("Asia/Manila",)], "zone string")
    return roles, people, profiles, answers, terms, zones


def basis(spark, case):
    roles, people, profiles, answers, terms, zones = case
    asked = funnel.asked_of(roles, terms, "2026-01-01").cache()
    held = funnel.holders(asked, funnel.pool_of(people, profiles, answers)).cache()
    return asked, held, {r.role_id: r for r in funnel.funnel(asked, funnel.signatures(held), people, profiles, zones).collect()}


def test_each_filter_drops_the_one_who_misses_it(spark):
    case = pool(spark)
    asked, held, counts = basis(spark, case)
    stages = funnel.checked(asked, held, case[-1]).cache()
    # 0 has no profile, 1 not the certificate and 2 not the software of role 1, so none of them is paired with it
    assert {r.candidate_id: r.cleared for r in stages.where("role_id = 1").collect()} == {3: 3, 4: 4, 5: 4, 6: 5, 7: 5, 8: 6}
    # without a start date anyone who has answered is in time, however late they are free
    assert {r.candidate_id: r.cleared for r in stages.where("role_id = 2").collect()} == {1: 6, 3: 6, 4: 4, 5: 6, 6: 6, 7: 6, 8: 6}
    assert {r.cleared for r in stages.where("role_id = 3").collect()} == {4, 5}  # an overlap in no zone can't be met
    assert stages.where("role_id = 4 OR role_id = 6").count() == 0
    r = counts[1]
    assert (r.pool, r.after_profile, r.after_certifications, r.after_software, r.after_experience, r.after_availability, r.after_overlap, r.top_filter, r.top_excluded) == (9, 8, 7, 6, 5, 3, 1, "availability", 2)
    assert (counts[4].after_profile, counts[4].after_certifications, counts[4].top_filter) == (8, 0, "certifications")
    assert (counts[5].after_software, counts[5].after_overlap) == (8, 7)
    spread = {x.cleared: x.n for x in funnel.cleared_counts(spark.createDataFrame([counts[1]])).collect()}
    assert spread == {0: 1, 1: 1, 2: 1, 3: 1, 4: 2, 5: 2, 6: 1}


def exchanges(df):
    """How many exchanges the plan of df has, as it is before it runs. The driver's memory grows with the square of it."""
    return sum("Exchange" in line for line in df._jdf.queryExecution().executedPlan().toString().splitlines())


def test_plans_of_the_funnel_are_short(spark):
    roles, people, profiles, answers, terms, zones = pool(spark)
    asked, everybody = kept(funnel.asked_of(roles, terms, "2026-01-01"), "asked"), kept(funnel.pool_of(people, profiles, answers), "pool")
    held = kept(funnel.holders(asked, everybody), "holders")
    signed = kept(funnel.signatures(held), "signatures")
    found = {"holders": exchanges(funnel.holders(asked, everybody)), "funnel": exchanges(funnel.funnel(asked, signed, people, profiles, zones))}
    assert found["holders"] <= 8 and found["funnel"] <= 15, found  # 14 and 30 in one piece


def test_totals_of_the_experienced_equal_their_pairs(spark):
    roles, people, profiles, answers, terms, zones = pool(spark)
    asked = kept(funnel.asked_of(roles, terms, "2026-01-01"), "asked")
    held = kept(funnel.holders(asked, funnel.pool_of(people, profiles, answers)), "holders")
    pairs = funnel.checked(asked, held, zones).where("cleared > 3").groupBy("role_id").agg(F.count("*").alias("n"), F.sum("candidate_id").alias("ids"))
    got = {tuple(r) for r in funnel.experienced_totals(asked, held).collect()}
    assert got == {tuple(r) for r in pairs.collect()} and (1, 5, 30) in got and len(got) == 4


def test_unranked_among_given_pairs(spark):
    """Of the given pairs those that all pairs would give, whether or not they pass, by a plan without other pairs."""
    roles, people, profiles, answers, terms, zones = pool(spark)
    asked = kept(funnel.asked_of(roles, terms, "2026-01-01"), "asked")
    held = kept(funnel.holders(asked, funnel.pool_of(people, profiles, answers)), "holders")
    rv = spark.createDataFrame([(1, "a", [1.0, 0.0]), (2, "b", [1.0, 1.0])], "role_id int, model string, v array<double>")
    cv = spark.createDataFrame([(8, "a", [1.0, 0.0]), (3, "b", [0.0, 0.0])], "candidate_id int, model string, v array<double>")
    every = {tuple(r) for r in funnel.unranked(asked, held, rv, cv, zones).collect()}
    among = spark.createDataFrame([(2, 8), (2, 3), (2, 4), (1, 8), (5, 1), (6, 8), (9, 9)], "role_id int, candidate_id int")
    got = {tuple(r) for r in funnel.unranked(asked, held, rv, cv, zones, among).collect()}
    assert {r[:2] for r in got} == {(2, 8), (2, 3), (5, 1)}
    assert got == {r for r in every if r[:2] in {tuple(x) for x in among.collect()}}


def test_plan_of_shortlists_is_short(spark):
    roles, people, profiles, answers, terms, zones = pool(spark)
    asked = kept(funnel.asked_of(roles, terms, "2026-01-01"), "asked")
    held = kept(funnel.holders(asked, funnel.pool_of(people, profiles, answers)), "holders")
    rv = spark.createDataFrame([(1, "a", [1.0, 0.0])], "role_id int, model string, v array<double>")
    cv = spark.createDataFrame([(8, "a", [1.0, 0.0])], "candidate_id int, model string, v array<double>")
    found = exchanges(funnel.shortlist(asked, held, rv, cv, zones))
    assert found <= 12, found  # 32 in one piece


def chance(spark):
    """Roles and people that ask for and have anything, nothing or unknown things."""
    import random

    r = random.Random(4)
    some = lambda of: r.sample(of, r.randrange(len(of)))
    day = lambda: datetime.date(2026, r.randint(1, 12), 15)
    zone = lambda: r.choice(["Europe/London", "Asia/Manila", "XYZ5", None])
    asked = [(k, some("xy"), some(["s", "t", "u"]), r.choice([None, 0, 2, 5]), r.choice([None, day()]), r.choice([None, None, 0, 20, 40]), zone(), r.choice([None, 0, 2, 8]), "open", r.choice([None, True, False])) for k in range(60)]
    held = [(k, some("xyz"), some(["s", "t", "u"]), r.choice([None, 1, 4, 6])) for k in range(70)]
    said = [(k, zone(), *r.choice([(540, 1020), (1260, 360), (None, 3), (600, 600)]), r.choice([None, 10, 20, 40]), r.choice([None, day()])) for k in range(5, 75)]
    roles = spark.createDataFrame(asked, "role_id int, required_certifications array<string>, required_software array<string>, min_years int, starts_on date, hours_per_week int, timezone string, min_overlap_hours int, status string, accept_equivalents boolean")
    people = spark.createDataFrame([(k, f"n{k % 9}", "active") for k in range(80)], "candidate_id int, full_name string, status string")
    profiles = spark.createDataFrame(held, "candidate_id int, certifications array<string>, software array<string>, years_experience int")
    answers = spark.createDataFrame(said, "candidate_id int, timezone string, work_start int, work_end int, hours_per_week int, available_from date")
    _, _, _, _, terms, zones = pool(spark)
    return (roles, people, profiles, answers, terms, zones), asked, {h[0]: h for h in held}, {a[0]: a for a in said}


def clock_minutes(role_zone, day, zone, start, end):
    from zoneinfo import ZoneInfo

    if not {role_zone, zone} <= {"Europe/London", "Asia/Manila"} or start is None:
        return None
    at = [datetime.datetime(day.year, day.month, day.day, 9 + k // 60, k % 60, tzinfo=ZoneInfo(role_zone)).astimezone(ZoneInfo(zone)) for k in range(480)]
    clock = [t.hour * 60 + t.minute for t in at]
    return sum(start <= m < end if end > start else m >= start or m < end for m in clock)


def passes(role, profile, answer):
    """How many filters are cleared, by the rules one after the other."""
    _, certs, soft, years, start, hours, zone, overlap, _, _ = role
    if profile is None:
        return 0
    if not set(certs) <= set(profile[1]):
        return 1
    if not set(soft) <= set(profile[2]):
        return 2
    if years and not (profile[3] is not None and profile[3] >= years):
        return 3
    if not (answer and (start is None or answer[5] is not None and answer[5] <= start) and (hours is None or answer[4] is not None and answer[4] >= hours)):
        return 4
    if zone is None:
        return 6 if overlap is None else 5
    minutes = clock_minutes(zone, start or datetime.date(2026, 1, 1), answer[1], answer[2], answer[3])
    return 6 if minutes is not None and minutes >= 60 * (overlap or 0) else 5


def test_equal_to_the_naive_pairs(spark):
    """Counts and pairs equal those of all pairs, tested one by one, whatever roles ask for."""
    case, asked, held, said = chance(spark)
    plan, holding, counts = basis(spark, case)
    want = {(role[0], c): passes(role, held.get(c), said.get(c)) for role in asked for c in range(80)}
    got = {(r.role_id, r.candidate_id): r.cleared for r in funnel.checked(plan, holding, case[-1]).collect()}
    assert got == {k: v for k, v in want.items() if v > 2}
    for role in asked:
        mine = [v for (k, _), v in want.items() if k == role[0]]
        assert [counts[role[0]][f"after_{s}"] for s in funnel.STAGES] == [sum(v > k for v in mine) for k in range(6)]


def test_shortlists_equal_the_naive_order(spark):
    """Exact distances decide, however close; blocks of a few rows and of many give the same."""
    import random

    case, asked, held, said = chance(spark)
    plan, holding, _ = basis(spark, case)
    r = random.Random(2)
    close = {k: [1.0, k * 1e-7 if k % 2 else (80 - k) * 1e-7, 0.0] for k in range(80)} | {3: [0.0, 0.0, 0.0], 6: [1.0, 2.0]}
    people = spark.createDataFrame([(k, r.choice([None, "a"]), v) for k, v in close.items() if k != 9], "candidate_id int, model string, v array<double>").cache()
    roles = spark.createDataFrame([(k, r.choice([None, "a"]), None if k == 4 else [1.0, 0.0, 1e-9 * k]) for k in range(60)], "role_id int, model string, v array<double>").cache()
    ours = {x.role_id: (x.model, x.v) for x in roles.collect()}
    theirs = {x.candidate_id: (x.model, x.v) for x in people.collect()}
    want, rest = {}, set()
    for role in asked:
        model, a = ours[role[0]]
        near = []
        for c in range(80):
            if passes(role, held.get(c), said.get(c)) < 6:
                continue
            kind, b = theirs.get(c, (None, None))
            if a is None or b is None or not any(b) or kind != model or len(b) != len(a):
                rest.add((role[0], c))
                continue
            dot, aa, bb = 0.0, 0.0, 0.0
            for x, y in zip(a, b, strict=True):
                dot, aa, bb = dot + y * x, aa + x * x, bb + y * y
            near.append((1 - dot / (bb**0.5 * aa**0.5), f"n{c % 9}", c))
        for k, x in enumerate(sorted(near)[:5]):
            want[role[0], k + 1] = x[2]
    for block in (3, 1024):
        got = {(x.role_id, x["rank"]): x.candidate_id for x in funnel.shortlist(plan, holding, roles, people, case[-1], 5, block).collect()}
        assert got == want
    left = {(x.role_id, x.candidate_id) for x in funnel.unranked(plan, holding, roles, people, case[-1]).collect()}
    assert left == rest


def test_farther_by_a_ten_millionth_is_behind(spark):
    """Two distances that agree to six places are ordered by themselves, not by name."""
    case = pool(spark)
    plan, holding, _ = basis(spark, case)
    roles = spark.createDataFrame([(2, None, [1.0, 0.0])], "role_id int, model string, v array<double>")
    people = spark.createDataFrame([(1, None, [1.0, 0.0005]), (3, None, [1.0, 0.0001])], "candidate_id int, model string, v array<double>")
    got = funnel.shortlist(plan.where("role_id = 2"), holding, roles, people, case[-1]).orderBy("rank").collect()
    assert [(r.candidate_id, r.similarity) for r in got] == [(3, 1.0), (1, 1.0)]


def test_the_rarest_requirement_leads(spark):
    """Candidates meet a skill by what the fewest of them hold."""
    case = list(pool(spark))
    case[0] = spark.createDataFrame([(1, ["x"], ["s", "rare"], "open")], "role_id int, required_certifications array<string>, required_software array<string>, status string").selectExpr("*", "CAST(NULL AS int) AS min_years", "CAST(NULL AS date) AS starts_on", "CAST(NULL AS int) AS hours_per_week", "CAST(NULL AS string) AS timezone", "CAST(NULL AS int) AS min_overlap_hours", "true AS accept_equivalents")
    case[2] = case[2].withColumn("software", F.expr("if(candidate_id = 5, array('rare', 's'), software)"))
    asked = funnel.asked_of(case[0], case[4], "2026-01-01")
    people = funnel.pool_of(case[1], case[2], case[3])
    lead = {len(r.wants): r["keys"] for r in funnel.leads(funnel.skills_of(asked), people).collect()}
    assert lead == {3: ["s:rare"], 1: ["c:x"]}
    assert {r.candidate_id for r in funnel.holders(asked, people).where(F.col("skill") == asked.first().skill).collect()} == {5}


def test_acceptable_ids(spark):
    terms = spark.createDataFrame([("economy", "g0", "standard"), ("standard", "g0", None), ("small", "g0", "standard"), ("promo", "g2", None)], "id string, grp string, variant_of string")
    got = {(r.required, r.accept_equivalents): set(r.ids) for r in funnel.acceptable_ids(terms).groupBy("required", "accept_equivalents").agg(F.collect_set("id").alias("ids")).collect()}
    assert got[("standard", False)] == got[("standard", True)] == {"standard", "economy", "small"}
    assert got[("economy", False)] == {"economy"}
    assert got[("economy", True)] == {"economy", "small"}  # the ambiguous id is no equivalent


@pytest.mark.parametrize(("levels", "score"), [((0, 4, 4, 4, 4), 0.3), ((1, 4, 4, 4, 4), 0.5), ((4, None, 4, 4, 4), 1.0), ((None,) * 5, None), ((2, 2, 2, 2, 2), 0.5)])
def test_scores(spark, levels, score):
    rows = spark.createDataFrame([(1, 1, *levels)], "role_id int, candidate_id int, l0 int, l1 int, l2 int, l3 int, l4 int")
    assert matches.scored(rows).first().score == score


def test_retries(spark):
    rows = [(k, "a", k, "failed", k, 9, None) for k in range(1, 7)] + [(7, "b", 1, "failed", 1, 9, False), (8, "b", 1, "queued", 0, 9, None), (9, "c", 1, "failed", 3, 3, False), (10, "d", 1, "failed", 1, 3, True)]
    got = {r.id: (r.next_status, r.wait_s) for r in jobs.retry_schedule(spark.createDataFrame(rows, "id int, kind string, payload int, status string, attempts int, max_attempts int, permanent boolean")).collect()}
    assert [got[k][1] for k in range(1, 7)] == [5, 20, 80, 320, 600, 600]
    assert got[7] == got[9] == got[10] == ("failed", None)


def test_every_ready_job_has_a_place(spark):
    """No cap, however many there are of a kind, and a kind that isn't named is one too."""
    rows = [(k, None if k % 3 == 0 else "a", k % 2, "queued" if k % 5 else "running") for k in range(5000)]
    df = spark.createDataFrame(rows, "id long, kind string, priority int, status string").withColumn("run_at", F.timestamp_seconds(F.pmod("id", F.lit(7))))
    got = {(r.kind, r.place): r.id for r in jobs.ready_order(df, F.timestamp_seconds(F.lit(5))).collect()}
    want = {}
    for kind in (None, "a"):
        ready = sorted((-p, k % 7, k) for k, x, p, s in rows if x == kind and s == "queued" and k % 7 <= 5)
        want |= {(kind, n + 1): k for n, (*_, k) in enumerate(ready)}
    assert got == want


def test_paths_are_whole(spark):
    lines = spark.createDataFrame([(f"r{k % 2}" if k % 50 else "bad id", k, "ai" if k % 3 else "api") for k in range(1000)], "request_id string, ts long, service string")
    got = jobs.request_path(lines).where("request_id = 'r1'").orderBy("place").collect()
    assert [r.ts for r in got] == [k for k in range(1000) if k % 2] and [r.place for r in got] == list(range(1, 501))


def test_pending(spark):
    work = spark.createDataFrame([("role", 1, "queued"), ("role", 2, "failed"), ("profile", 10, "running"), ("resume", 11, "succeeded")], "kind string, payload long, status string")
    runs = spark.createDataFrame([(1, False), (2, False), (3, True), (4, True), (5, True)], "role_id long, embedded boolean")
    unranked = spark.createDataFrame([(3, 10), (3, 11), (4, 11), (1, 10)], "role_id long, candidate_id long")
    got = {r.role_id: r.state for r in jobs.pending(work, runs, unranked, ["role"], ["profile", "resume"]).collect()}
    assert got == {1: "wait", 2: "not_ready", 3: "partial", 4: "whole", 5: "whole"}


def test_holders_never_broadcast_people(spark, tmp_path):
    asked = spark.createDataFrame([(1, [["a"], ["b", "c"]], ["x"], "k1", "k2"), (2, [], [], "k0", "k0")], "role_id long, sets array<array<string>>, software array<string>, skill string, certs string")
    rows = [(k, f"P{k}", ["c:a", "c:c", "c:b", "s:x"][: 2 + k % 3] + [f"c:{j}" for j in range(60)]) for k in range(300)]
    pool = spark.createDataFrame(rows, "candidate_id long, full_name string, held array<string>")
    pool = pool.selectExpr("*", "1 AS has_years", "true AS answered", "date '2026-01-01' AS free_from", "40 AS has_hours", "'UTC' AS zone", "0 AS work_start", "60 AS work_end")
    pool.write.parquet(str(tmp_path / "pool"))  # lists that pack to a fraction of their size
    held = funnel.holders(asked, spark.read.parquet(str(tmp_path / "pool")))
    plan, deeper = held._jdf.queryExecution().executedPlan().toString().split("\n"), None
    for x in plan:
        at = len(x) - len(x.lstrip(" :+-"))
        deeper = None if deeper is not None and at <= deeper else deeper
        deeper = at if deeper is None and "BroadcastExchange" in x else deeper
        assert deeper is None or "candidate_id" not in x, x
    got = {}
    for r in held.collect():
        got.setdefault(r.skill, []).append(r.candidate_id)
    assert {s: len(x) for s, x in got.items()} == {"k0": 300, "k1": 100, "k2": 300} and all(len(set(x)) == len(x) for x in got.values())
    assert set(got["k1"]) == {k for k in range(300) if k % 3 == 2}


def written_basis(spark, case):
    """What is asked and who holds it as written tables, as the queries have them."""
    roles, people, profiles, answers, terms, zones = case
    asked = kept(funnel.asked_of(roles, terms, "2026-01-01"), "asked")
    return asked, kept(funnel.holders(asked, funnel.pool_of(people, profiles, answers)), "holders"), zones


def test_shortlists_of_written_parts_are_planned_in_few_exchanges(spark):
    asked, held, zones = written_basis(spark, pool(spark))
    rv = spark.createDataFrame([(1, "a", [1.0, 0.0])], "role_id int, model string, v array<double>")
    cv = spark.createDataFrame([(8, "a", [1.0, 0.0])], "candidate_id int, model string, v array<double>")
    vectors = [kept(funnel.comparable(v, key), "vectors") for v, key in ((rv, "role_id"), (cv, "candidate_id"))]
    ranked = funnel.ranked(asked, held, *vectors, funnel.days_of(funnel.asked_clocks(asked, zones)))
    assert exchanges(ranked) <= 8 and [tuple(r) for r in ranked.select("role_id", "candidate_id").collect()] == [(1, 8)]


def test_who_passed_is_listed_by_blocks(spark):
    """Positions by name equal those of all pairs sorted, equal and missing names too, in blocks of a few people and of many; no pair is sorted."""
    case, asked, held, said = chance(spark)
    names = {k: None if k % 7 == 0 else f"n{k % 9}" for k in range(80)}
    case = (case[0], spark.createDataFrame([(k, n, "active") for k, n in names.items()], "candidate_id int, full_name string, status string"), *case[2:])
    plan, holding, zones = written_basis(spark, case)
    want = set()
    for role in asked:
        mine = [c for c in range(80) if passes(role, held.get(c), said.get(c)) == 6]
        want |= {(role[0], k + 1, c) for k, c in enumerate(sorted(mine, key=lambda c: (names[c] is not None, names[c] or "", c)))}
    for block in (3, 1024):
        listed = funnel.passed_in_order(plan, holding, zones, block)
        assert {tuple(r) for r in listed.collect()} == want and len(want) == listed.count()
    assert "Window" not in listed._jdf.queryExecution().executedPlan().toString().split("FlatMapCoGroupsInArrow")[0]


def test_who_cannot_be_ranked_is_listed_and_counted_by_blocks(spark):
    case, _, _, _ = chance(spark)
    plan, holding, zones = written_basis(spark, case)
    rv = spark.createDataFrame([(k, "ab"[k % 2], [1.0, 0.0]) for k in range(0, 60, 3)], "role_id int, model string, v array<double>")
    cv = spark.createDataFrame([(k, "ab"[k % 2], [float(k % 5), 0.0]) for k in range(70)], "candidate_id int, model string, v array<double>")
    spaces = [kept(funnel.comparable(v, key).select(key, "space"), "spaces") for v, key in ((rv, "role_id"), (cv, "candidate_id"))]
    clock = funnel.asked_clocks(plan, zones)
    every = funnel.checked(plan, holding, zones).where("cleared = 6").select("role_id", "candidate_id")
    want = {tuple(r) for r in funnel.unranked_among(plan, holding, *spaces, clock, every).collect()}
    days = funnel.days_of(clock)
    for block in (3, 1024):
        rows = [tuple(r) for r in funnel.apart(plan, holding, *spaces, days, block=block).collect()]
        assert set(rows) == want and len(rows) == len(want) and {r[3] for r in rows} == {True, False}
        counts = funnel.apart(plan, holding, *spaces, days, counts=True, block=block).groupBy("role_id").agg(F.sum("n").alias("n")).collect()
        assert {r.role_id: r.n for r in counts} == {k: sum(w[0] == k for w in want) for k in {w[0] for w in want}}


def broadcast(df):
    """What the plan of df, as it is before it runs, broadcasts."""
    found, deeper = [], None
    for x in df._jdf.queryExecution().executedPlan().toString().split("\n"):
        at = len(x) - len(x.lstrip(" :+-"))
        deeper = None if deeper is not None and at <= deeper else deeper
        deeper = at if deeper is None and "BroadcastExchange" in x else deeper
        found += [x] if deeper is not None else []
    return found


def test_shortlists_never_broadcast_holders_or_vectors(spark):
    """Written holders pack to a fraction of their rows, so that Spark would take millions of them for small."""
    asked, held, zones = written_basis(spark, pool(spark))
    rv = spark.createDataFrame([(1, "a", [1.0, 0.0])], "role_id int, model string, v array<double>")
    cv = spark.createDataFrame([(8, "a", [1.0, 0.0])], "candidate_id int, model string, v array<double>")
    near = funnel.shortlist(asked, held, rv, cv, zones)
    assert not [x for x in broadcast(near) if "candidate_id" in x or "role_id" in x]


def test_merging_never_broadcasts_pairs(spark):
    pairs = spark.createDataFrame([(1, 1, "proposed", False, False)], "role_id int, candidate_id int, status string, released boolean, by_hand boolean")
    new = spark.createDataFrame([(1, 2, "proposed")], "role_id int, candidate_id int, new_status string")
    merged = matches.merged(pairs, new, new, pairs, pairs.select("role_id"))
    assert not broadcast(merged) and {(r.candidate_id, r.change) for r in merged.collect()} == {(1, "kept"), (2, "inserted")}
    ranked = spark.createDataFrame([(1, 2, 1, 0.9)], "role_id int, candidate_id int, rank int, score double")
    assert not broadcast(matches.queued(ranked, pairs, spark.createDataFrame([(2,)], "candidate_id int")))


def test_bound_tables_that_grow_are_never_broadcast(spark):
    from rolemesh.plans import bindings, documents

    d = "/root/testdata/sf0.001"
    for df in (bindings.profiles(spark, d), bindings.candidate_vectors(spark, d), bindings.role_vectors(spark, d), documents.resumes(spark, d), documents.descriptions(spark, d)):
        assert not [x for x in broadcast(df) if "_custkey" in x or "_orderkey" in x or "_partkey" in x]
