"""Text rules on small frames where each row tests one rule."""

import pytest
from pyspark.sql import functions as F
from rolemesh.operators import embedtext, grounding, rerank, settle, taxonomy, text


def docs(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


@pytest.mark.parametrize(
    ("raw", "key", "cert"),
    [
        ("A & B (UK) Certified", "aandbcertified", "aandb"), ("Certified Public Accountant (CPA)", "certifiedpublicaccountant", "publicaccountant"), ("501(c)(3)", "501c3", "501c3"),
        ("CA(SA)", "casa", "casa"), ("CPA (active)", "cpa", "cpa"), ("Chartered Accountant", "charteredaccountant", "charteredaccountant"), ("PMP certification credential", "pmpcertificationcredential", "pmp"), ("(x)", "", ""),
    ],
)
def test_alias_keys(spark, raw, key, cert):
    row = spark.createDataFrame([(raw,)], "t string").select(taxonomy.alias_key(F.col("t")), taxonomy.alias_key(F.col("t"), True)).first()
    assert tuple(row) == (key, cert)


def test_lists(spark):
    names = spark.createDataFrame([("software", "xero", "Xero"), ("software", "qb", "Quick Books"), ("software", "a", "Same"), ("software", "b", "same")], "kind string, id string, name string")
    rows = spark.createDataFrame([(1, ["XERO", "mystery", " ", "quick-books", "Mystery!"], ["xero", "other"]), (2, [], []), (3, ["same"], None)], "row_id int, m array<string>, e array<string>")
    got = {r.row_id: (r.ids, r.unknown) for r in taxonomy.resolved_lists(rows, taxonomy.alias_index(names), "software", ("m", "e")).collect()}
    assert got == {1: (["xero", "qb"], ["mystery", "other"]), 2: ([], []), 3: ([], ["same"])}
    row = spark.createDataFrame([(["a  b", None, "A B", " ", "c"],)], "v array<string>").select(taxonomy.unique(F.col("v"))).first()
    assert row[0] == ["a b", "c"]


def test_head_lines_and_contacts(spark):
    d = docs(spark, "\n Full-Stack Engineer (remote)\nx", "Senior Accountant – Tax", "A|B", None, "JANE DOE, CPA\njane@x.co.uk +1 (555) 010-2030; 12-34", "Plain")
    titles = [r.title for r in text.head_line(d).orderBy("doc_id").collect()]
    assert titles == ["Full-Stack Engineer", "Senior Accountant", "A|B", None, "JANE DOE, CPA", "Plain"]
    got = {r.doc_id: (r.full_name, r.email, r.phone) for r in text.contacts(d).collect()}
    assert got[4] == ("Jane Doe", "jane@x.co.uk", "+1 (555) 010-2030")
    assert got[3] == (None, None, None)
    assert got[2][0] == "A"


def test_mentions_and_spans(spark):
    d = docs(spark, "CPA firm in Oakland, CA; our client's CPA and a Cpa (US CPA)", "Quick  Books and quick books", None, "")
    names = spark.createDataFrame([("CPA", "cpa"), ("US CPA", "cpa_us"), ("CA", "ca"), ("Quick Books", "qb")], "name string, term string")
    found = text.spans(d, names)
    assert found.where("doc_id = 1").count() == 1  # two spaces are another surface
    kept = text.maximal(found)
    assert kept.where("doc_id = 0 AND term = 'cpa'").count() == 2  # the one inside US CPA is gone; Cpa isn't written as the short name is
    readings = {(r.term, r.reading) for r in text.in_context(kept).where("doc_id = 0").collect()}
    assert readings == {("cpa", "employer"), ("cpa", "other"), ("ca", "place"), ("cpa_us", "holding")}
    assert text.mentions(docs(spark), names).count() == 0


def test_names_of_any_length_and_spelling(spark):
    d = docs(spark, "A Certified Public Accountant knows C++, c++ and 501(c)(3) law; Certified Public Accountants don't", "SQL, sql, MySQL; R&D", "É CPAÉ xCPA CPA1 CPA", "a a a", "İİ Master of Laws\r\nmaster of laws")
    names = ["Certified Public Accountant", "C++", "501(c)(3)", "SQL", "R", "R&D", "CPA", "a a", "Master of Laws", ""]
    frame = spark.createDataFrame([(n, n.lower()) for n in names], "name string, term string")
    want = {(0, "certified public accountant", 2), (0, "c++", 36), (0, "501(c)(3)", 49), (1, "sql", 0), (1, "r", 17), (1, "r&d", 17), (2, "cpa", 2), (2, "cpa", 17), (3, "a a", 0), (3, "a a", 2), (4, "master of laws", 3), (4, "master of laws", 19)}
    for most in (100, 3):  # with the task, and in parts that meet the texts
        found = text.spans(d, frame, lines=True, most=most).collect()
        assert {(r.doc_id, r.term, r.start) for r in found} == want and len(found) == len(want)
        assert [(r.pos, r.line) for r in found if r.start == 19] == [(1, "master of laws")]


def test_names_equal_patterns(spark):
    """Every mention is what a search by pattern finds, whatever the letters and marks."""
    import random
    import re

    r = random.Random(6)
    some = lambda n: "".join(r.choice("aAbB1 é+(\n") for _ in range(n))
    texts, names = [some(60) for _ in range(40)] + [None, ""], {some(r.randint(1, 7)) for _ in range(60)}
    names = {n for n in names if n}
    want = set()
    for k, page in enumerate(texts):
        for n in names:
            pattern = re.compile("(?<![A-Za-z0-9])(?=" + re.escape(n) + "(?![A-Za-z0-9]))", 0 if len(n) <= 4 else re.IGNORECASE)
            want |= {(k, n, m.start()) for m in pattern.finditer(page or "")}
    found = text.spans(docs(spark, *texts), spark.createDataFrame([(n, n) for n in names], "name string, term string")).collect()
    assert {(x.doc_id, x.term, x.start) for x in found} == want and len(found) == len(want)
    assert all(texts[x.doc_id][x.start : x.end] == x.surface for x in found)


def test_context_is_read_before_longer_names_win(spark):
    """A longer name that isn't held doesn't hide the shorter one inside it; names over two lines and firms on the next line are seen."""
    names = spark.createDataFrame([("CPA", "cpa"), ("CPA firm member", "member"), ("US CPA", "us"), ("ACCA", "acca")], "name string, term string")
    d = docs(spark, "CPA firm member firm, US CPA", "their CPA; ACCA\nfirm", "- ACCA, 2019\n- 2020 CPA")
    got = {(r.doc_id, r.term): (r.name, r.year) for r in text.qualification_records(d, names).collect()}
    assert got == {(0, "us"): ("US CPA", None), (2, "acca"): ("ACCA", 2019), (2, "cpa"): ("CPA", None)}
    inside = docs(spark, "their US CPA, CPA")
    assert {r.term for r in text.qualification_records(inside, names).collect()} == {"cpa"}


@pytest.mark.parametrize(
    ("raw", "clean"),
    [
        ("e\u0301tude \u212b", "étude Å"), ("so\u00adft\u200b \ufeffx\u0085", "soft x"), ("\ufb00\ufb01\ufb02\ufb03\ufb04\ufb05\ufb06", "fffiflffifflstst"), ("\r\n\r a \u2003\rb\t\n\n", " a\nb"), ("x\U000e0041y", "xy"), (None, None), ("", ""), ("²½", "²½"),
    ],
)
def test_clean_text(spark, raw, clean):
    assert spark.createDataFrame([(raw,)], "t string").select(text.cleaned(F.col("t"))).first()[0] == clean


def test_places(spark):
    places = spark.createDataFrame([("united_states", "United States"), ("uae", "United Arab Emirates"), ("uk", "UK"), ("canada", "Canada")], "id string, name string")
    regions = spark.createDataFrame([("united_states", "TX"), ("united_states", "CA"), ("canada", "ON")], "id string, region string")
    rows = {"Austin, TX": "united_states", "Austin, TX 78701": "united_states", "Toronto, ON | UK": "canada", "CPA, CA, CIA": None, "in the United Arab Emirates": "uae", "CANADA": None, "ON, UK": "uk", "Dallas, TX\nUK": "united_states", "Austin, TXT": None, "": None, "Austin,  TX": None}
    got = {r.doc_id: r.place for r in taxonomy.first_place(docs(spark, *rows), places, regions).collect()}
    assert got == {k: p for k, p in enumerate(rows.values()) if p}


def test_bodies(spark):
    """The id itself is asked before its variants, each by its longest name, and the text's own writing is kept."""
    bodies = spark.createDataFrame([("ca", "Institute"), ("ca_in", "ICAI"), ("ca_uk", "Institute of Scotland"), ("ca_uk", "ICAS")], "id string, body string")
    variants = spark.createDataFrame([("ca_in", "ca"), ("ca_uk", "ca")], "id string, variant_of string")
    rows = spark.createDataFrame([(1, "ca", "the institute of scotland"), (2, "ca", "icas and Icai"), (3, "ca_uk", "ICAI, ICAS, Institute of SCOTLAND"), (4, "ca", None), (5, "ca_uk", "ICASX")], "row_id int, id string, text string")
    got = {r.row_id: (r.of, r.body) for r in settle.bodies_in(rows, bodies, variants).collect()}
    assert got == {1: ("ca", "institute"), 2: ("ca_in", "Icai"), 3: ("ca_uk", "Institute of SCOTLAND")}
    longest = {r.row_id: r.of for r in settle.bodies_in(rows, bodies, variants, own_first=False).collect()}
    assert longest == {1: "ca_uk", 2: "ca_in", 3: "ca_uk"}


def test_sections(spark):
    jd = "Clerk\nRequirements:\n- 5+ years of work, 3 years here.\n1. Xero\nNice to have\n* Excel.\nAbout us\n- Fun"
    d = docs(spark, jd, "no sections", None)
    got = {r.doc_id: (r.must, r.nice) for r in text.sections(d).collect()}
    assert got[0] == (["5+ years of work, 3 years here", "Xero"], ["Excel"])
    assert got[1] == ([], [])
    figures = text.numeric_requirements(docs(spark, jd + "\n15 to 20 hours per week; 4+ hours of overlap", "1-4 years")).orderBy("doc_id").collect()
    assert [tuple(r)[1:] for r in figures] == [(5, 15, 4), (None, None, None)]


@pytest.mark.parametrize(("name", "line", "status"), [("ACCA", "AAT qualified and part-qualified ACCA", "part_qualified"), ("AAT", "AAT qualified and part-qualified ACCA", "qualified"), ("CPA", "CPA candidate, 2024", "in_progress"), ("CPA", "CPA, 2019", "qualified")])
def test_status(spark, name, line, status):
    assert spark.createDataFrame([(name, line)], "n string, l string").select(text.qualification_status(F.col("l"), F.col("n"))).first()[0] == status


def test_standards(spark):
    got = text.standards(docs(spark, "IFRS 16, ifrs 16, IFRS, non-GAAP, US GAAP and ASC 350-40; XIFRS", "none")).orderBy("doc_id").collect()
    assert [r.standards for r in got] == [["IFRS 16", "IFRS", "US GAAP", "ASC 350-40"], []]


def test_embedding(spark):
    d = spark.createDataFrame([(1, "tax close. tax"), (1, "tax close. tax"), (2, "the of and"), (3, None), (4, "")], "doc_id long, text string")
    rows = text.hashed_embedding(d).collect()
    assert {r.doc_id for r in rows} == {1, 2, 3, 4}  # no text is without a vector
    lengths = {}
    for r in rows:
        lengths[(r.doc_id, r.row)] = lengths.get((r.doc_id, r.row), 0) + r.weight**2
    assert len(lengths) == 5 and all(abs(x - 1) < 1e-4 for x in lengths.values())
    across = {(r.bucket, r.weight) for r in text.hashed_embedding(docs(spark, "tax. close")).collect()}
    within = {(r.bucket, r.weight) for r in text.hashed_embedding(docs(spark, "tax close")).collect()}
    assert len(within) > len(across)  # a pair of words counts only on one side of a break


def test_embedding_by_definition(spark):
    """Every text alone gives what the definition says, and no row is shuffled for it."""
    import re
    from hashlib import md5
    from math import log, sqrt

    texts = ["Tax close. tax", "Ünïcode—naïve ǅ x²; the of and", "the of and", "", None, " . ", "a_b 1/2\u00a0x", "tax close tax close, tax"] + ["w%d of w%d. " % (k % 7, k % 5) * k for k in range(130)]
    got = text.hashed_embedding(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
    want = {}
    for k, t in enumerate(texts):
        terms = []
        for s in re.split(r"[\n;:,()]|\.[\x20\x09-\x0D]", (t or "").lower()):
            ws = [w for w in re.findall(r"[^\W_]+", s) if w not in text.STOP_WORDS]
            terms += ws + [f"{a} {b}" for a, b in zip(ws, ws[1:], strict=False)]
        sums = {}
        for x in set(terms or [t or ""]):
            h = int(md5(x.encode()).hexdigest()[:8], 16)
            sums[h % 64] = sums.get(h % 64, 0) + (1 - 2 * (h // 64 % 2)) * (1 + log(max(1, terms.count(x))))
        norm = sqrt(sum(x * x for x in sums.values()))
        want |= {(k, b): x / norm for b, x in sums.items()} if norm > 1e-12 else {(k, 0): 1.0}
    rows = {(r.doc_id, r.bucket): r.weight for r in got.collect()}
    assert rows.keys() == want.keys() and all(abs(rows[k] - want[k]) < 1e-6 for k in want)


def test_quotes(spark):
    page = 'He said: “Closed the\n books — on time” (IAS 16), R in QuickBooks'
    rows = [("closed  THE books - on time", "Closed the\n books — on time"), ("ias 1", None), ("R", "R"), ("uickBooks", None), ("...", None), ("(IAS 16)", "(IAS 16)"), ('"closed', "“Closed")]
    d = spark.createDataFrame([(q, page) for q, _ in rows], "quote string, text string")
    assert {r.quote: r.found for r in grounding.found_quote(d).collect()} == dict(rows)


def test_quotes_equal_patterns(spark):
    """Passages and whole words are what a search by pattern finds, whatever the marks, spaces and case."""
    import random
    import re

    from rolemesh.operators import quotes

    groups = (quotes.DASHES, quotes.TICKS, quotes.MARKS)

    def pattern(quote):
        words = quote.split()
        if not re.search(r"\w", quote):
            return None
        body = r"\s+".join("".join(next((f"[{g}]" for g in groups if c in g), re.escape(c)) for c in w) for w in words)
        return (r"(?<!\w)" if re.match(r"\w", words[0]) else "") + body + (r"(?!\w)" if re.search(r"\w$", words[-1]) else "")

    r = random.Random(9)
    some = lambda n: "".join(r.choice("aAbé1_ -–’'\"“\n\t\xa0.") for _ in range(n))
    rows = [(k, some(r.randint(0, 6)), some(50)) for k in range(1500)] + [(1500, None, "a"), (1501, "a", None)]
    # parts of a text are certain to be there
    rows += [(2000 + k, t[a : a + 7].upper(), t) for k, (_, _, t) in enumerate(rows[:500]) for a in [r.randrange(40)]]
    got = {x.k: (x.found, x.there) for x in grounding.found_quote(spark.createDataFrame(rows, "k long, quote string, text string")).withColumn("there", grounding.in_text("quote", "text")).collect()}
    for k, quote, page in rows:
        want = None
        if quote and page and pattern(quote):
            m = re.search(pattern(quote), page, re.IGNORECASE)
            want = m.group() if m else None
        there = False
        if quote and page and quotes.normal(quote):
            there = re.search(r"(?<!\w)" + re.escape(quotes.normal(quote)) + r"(?!\w)", quotes.normal(page)) is not None
        assert got[k] == (want, there), (quote, page)
    assert sum(x[0] is not None for x in got.values()) > 300


@pytest.mark.parametrize(
    ("check", "value", "page", "there"),
    [
        ("year", "2023", "since '23", True), ("year", "2023", "06/23", True), ("year", "2019", "10/23/2019", True), ("year", "2023", "10/23/2019", False), ("number", "5", "five years", True), ("number", "5", "15 or 5.5", False), ("number", "5", "5.", True),
        ("weekly", "15", "15 to 20 hours per week", True), ("weekly", "25", "$25 per hour", False), ("overlap", "4", "at least 4 hours of overlap", True), ("overlap", "4", "overlap of four hours", True), ("overlap", "4", "4 hours. An overlap", False),
        ("phone", "001 555 010 2030", "(555) 010-2030", True), ("phone", "12345", "12345", False), ("tenure", "3", "3 yrs", True), ("tenure", "3", "long", False), ("verbatim", "Month-End", "month–end close", True),
    ],
)
def test_grounding(spark, check, value, page, there):
    d = spark.createDataFrame([(1, page)], "doc_id int, text string")
    names = spark.createDataFrame([("nothing", "nothing")], "name string, term string")
    got = grounding.audited(spark.createDataFrame([(1, "f", check, value)], "doc_id int, field string, kind string, value string"), d, names).first()
    assert got.grounded is there


def test_settlement(spark):
    names = spark.createDataFrame([("certifications", i, n) for i, n in (("ca", "CA"), ("ca_in", "Indian CA"), ("ca_uk", "UK CA"), ("acca", "ACCA"))], "kind string, id string, name string")
    terms = spark.createDataFrame([("ca", "CA", None, None), ("ca_in", "Indian CA", "ICAI", "india"), ("ca_uk", "UK CA", "ICAS", "uk"), ("acca", "ACCA", "ACCA", None)], "id string, label string, issuing_body string, place string")
    variants = spark.createDataFrame([("ca_in", "ca"), ("ca_uk", "ca")], "id string, variant_of string")
    bodies = spark.createDataFrame([("ca_in", "ICAI"), ("ca_uk", "ICAS")], "id string, body string")
    places = spark.createDataFrame([("uk", "England"), ("india", "Bharat")], "id string, name string")
    rows = [(1, "CA finalist", None, None, "england", None), (2, "CA", "ca_uk", "the ICAI", None, "uk"), (3, "CA", None, None, None, "india"), (4, "CA", None, None, None, None), (5, "ACCA", "ca_uk", None, "Mars", "uk"), (6, "XYZ", "ca", None, None, "uk"), (7, "Indian CA", None, "ICAS", "uk", "uk")]
    got = {r.row_id: r.canonical for r in settle.settled(spark.createDataFrame(rows, "row_id int, name string, canonical string, issuing_body string, jurisdiction string, hint string"), taxonomy.alias_index(names), terms, variants, bodies, places).collect()}
    assert got == {1: "ca_uk", 2: "ca_in", 3: "ca_in", 4: "ca", 5: "acca", 6: None, 7: "ca_in"}


def test_rerank_rules(spark):
    rows = [(1, k, k, c) for k, c in enumerate([60, 30, 20, 5, 5, 5, 5], 1)]
    got = rerank.batches(spark.createDataFrame(rows, "role_id int, rank int, candidate_id int, chars int"), 3, 90).orderBy("rank").collect()
    assert [r.batch for r in got] == [0, 0, 1, 1, 1, 2, 2]
    pairs = spark.createDataFrame([(1, 1), (2, 1)], "role_id int, candidate_id int")
    wanted = spark.createDataFrame([(1, t) for t in "abcdefgh"], "role_id int, term string")
    named = spark.createDataFrame([(1, t) for t in "abcde"], "candidate_id int, term string")
    assert {r.role_id: r.level for r in rerank.term_levels(pairs, wanted, named).collect()} == {1: 2, 2: None}  # 2.5 goes to the even level


def test_logistics(spark):
    row = spark.createDataFrame([(["US GAAP; on-site in Chicago", "Visa needed", "Excel"],)], "e array<string>").select(embedtext.about_the_work(F.col("e"))).first()
    assert row[0] == ["US GAAP", "Excel"]


def test_overlap_levels_of_odd_texts(spark):
    """Nothing shared: the first line, even one without words; of lines that share as much, the first; no role words, no text."""
    from rolemesh.operators import rerank

    roles = spark.createDataFrame([(1, "ledger audit payroll treasury"), (2, "a b c"), (3, None)], "role_id int, text string")
    people = spark.createDataFrame([(1, "--\n- audit of banks\n- ledger, audit\n- audit ledger"), (2, "\nnothing here"), (3, None), (4, "")], "candidate_id int, text string")
    pairs = roles.select("role_id").crossJoin(people.select("candidate_id"))
    got = {(r.role_id, r.candidate_id): (r.level, r.line) for r in rerank.overlap_levels(pairs, roles, people).collect()}
    assert got[1, 1] == (4, "ledger, audit")
    assert got[2, 1] == (0, "--") and got[1, 2] == (0, "") and got[1, 4] == (0, "")
    assert got[1, 3] == (0, None) and len(got) == 12


def test_the_end_of_a_phone_number_is_no_year(spark):
    pages = [("Tel: +1 (555) 901-1901", False), ("555-901-1901", False), ("555.901.1901", False), ("(555) 901-1901, since 1901", True), ("1899-1901", True), ("1899 - 1901", True), ("call 555-0123 (1901)", True)]
    d = spark.createDataFrame(pages, "text string, there boolean")
    assert [r.got for r in d.select(grounding.year_in_text(F.lit(1901), F.col("text")).alias("got"), "text").collect()] == [x for _, x in pages]


def test_terms_of_a_pair_stay_one_row(spark):
    pairs = spark.createDataFrame([(1, 5), (1, 6), (2, 5), (1, 7)], "role_id int, candidate_id int")
    wanted, named = spark.createDataFrame([(1, "b"), (1, "a"), (1, "c")], "role_id int, term string"), spark.createDataFrame([(5, "c"), (5, "a"), (5, "z"), (6, "z")], "candidate_id int, term string")
    found = rerank.term_levels(pairs, wanted, named)
    assert {tuple(r) for r in found.select("role_id", "candidate_id", "level", F.array_join("has", ";"), F.array_join("lacks", ";")).collect()} == {(1, 5, 3, "a;c", "b"), (1, 6, 0, "", "a;b;c"), (1, 7, 0, "", "a;b;c"), (2, 5, None, "", "")}
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Join") == 2  # the pairs are met once


def test_many_texts_are_composed_whole(spark):
    d = spark.createDataFrame([(k, ("éЖ" if k % 70 == 0 else "éЖ") + str(k) if k % 9 else None) for k in range(1000)], "k int, t string").coalesce(1)
    assert [r.c for r in d.select(text.composed("t").alias("c"), "k").orderBy("k").collect()] == [f"éЖ{k}" if k % 9 else None for k in range(1000)]


def test_overlap_levels_by_definition(spark):
    """Lines are looked up by the words that a pair shares; no line is compared with a pair."""
    import random
    import re

    from rolemesh.operators import rerank

    rnd = random.Random(4)
    page = lambda n: "\n".join(rnd.choice(("- ", "", "  ")) + " ".join(rnd.choice(("audit", "Bank", "close", "cash", "of", "ledger", "r&d+", "x")) for _ in range(rnd.randrange(5))) for _ in range(n))
    roles, people = {k: page(k % 3) for k in range(12)}, {k: page(k % 6) for k in range(40)}
    roles[12], people[40] = None, None
    got = rerank.overlap_levels(spark.createDataFrame([(a, b) for a in roles for b in people], "role_id long, candidate_id long"), spark.createDataFrame(list(roles.items()), "role_id long, text string"), spark.createDataFrame(list(people.items()), "candidate_id long, text string"))
    assert got._jdf.queryExecution().optimizedPlan().toString().count("array_intersect") == 1
    words = lambda t: set(re.findall(rerank.WORD, t.lower()))
    rows = {(r.role_id, r.candidate_id): (r.level, r.line) for r in got.collect()}
    assert len(rows) == 13 * 41
    for (a, b), (level, line) in rows.items():
        if roles[a] is not None and people[b] is not None:
            rw, lines = words(roles[a]), [re.sub(r"^\s*-\s+", "", x).strip(" ") for x in people[b].split("\n")]
            share = len(rw & words(people[b])) / len(rw) if rw else 0
            assert level == round(min(share * 2, 1) * 4)
            assert line == max(lines, key=lambda x: len(rw & words(x)))  # the first of equals


def test_plan_coverage_renders_once(spark):
    """Resumes are written once, however many checks read them."""
    from rolemesh.plans.grounding_queries import plan_coverage

    assert "lineitem.parquet" not in "".join(plan_coverage(spark, "/root/testdata/sf0.001").inputFiles())
