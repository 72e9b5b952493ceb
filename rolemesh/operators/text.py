"""Normal forms, extraction and embedding of whole corpora by column functions."""

from __future__ import annotations

import unicodedata
from collections import Counter
from collections.abc import Iterator
from hashlib import md5
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from rolemesh.operators.names import spans

#: Patterns of addresses, numbers and the end of a name, and words that say nothing.
EMAIL = "[A-Za-z0-9_.+-]+@[A-Za-z0-9_-]+(?:\\.[A-Za-z0-9_-]+)+"
PHONE = "\\+?\\(?[0-9][0-9\\s().-]{8,}[0-9]"
NAME_END = "\\s{2,}|\\s[–—|-]+\\s|,|\\|"
STOP_WORDS = (
    "a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "in", "is", "it", "of", "on", "or", "that", "the", "to", "with",
    "year", "years", "experience", "role", "qualifications", "software", "industries", "standards", "skills",
)


def comparison_form(text: Column) -> Column:
    """Dashes and apostrophes unified, white space collapsed, lower case, trimmed."""
    same = F.translate(text, "‐‑‒–—−‘’", "------''")
    return F.trim(F.regexp_replace(F.lower(same), "[\\x20\\x09-\\x0D]+", " "))


#: What readings, sections and figures are known by.
NOT_A_HOLDING = "^(?i)\\s+(?:firms?|practices?|reporting|compliance|filings?|forms?)\\b"
SOMEONE_ELSE = "(?i)(?:client's|clients'|outside|external|their)\\s$"
STATE_LIST = "^,\\s*[A-Z]{2}\\b"
CITY_BEFORE = "(?:[a-z][A-Za-z0-9_]*,|\\bin)\\s$"
STANDARD = "(?<![A-Za-z0-9])(?:(?<![Nn]on-)(?<![Nn]on )(?:US |U\\.S\\. |UK |Canadian )?GAAP|(?:ASC|IAS|FRS|GASB|ASPE) [0-9]+(?:-[0-9]+)?|IFRS(?: [0-9]+)?|GASB|ASPE)(?![A-Za-z0-9])"
AVAILABILITY = (
    ("immediate", "(?i)\\b(available immediately|immediately available|immediate start|start immediately)\\b"),
    ("two_weeks", "(?i)\\b(two|2) weeks?\\b"),
    ("one_month", "(?i)\\b(one|1|a) month\\b|\\b(four|4) weeks\\b|\\b30 days\\b"),
)
BULLET = "^\\s*(?:[-*•>]|[0-9]+[.)])\\s+"
MUST_HEADING = "(?i)^(requirements?|qualifications?|(?:you )?must[- ]haves?|required|what you(?:'ll)? (?:need|bring))\\b"
NICE_HEADING = "(?i)^(preferred|nice[- ]to[- ]haves?|bonus|plus(?:es)?|desirable|desired)\\b"
MIN_YEARS = "(?i)(^|[^0-9-])([0-9]{1,2})(?:\\s*\\+|\\s+or more|\\s*[-–]\\s*[0-9]{1,2})?\\s+years?\\b"
HOURS_A_WEEK = "(?i)(^|[^0-9-])([0-9]{1,2})(?:\\s*(?:to|[-–])\\s*[0-9]{1,2})?\\s+hours\\s+(?:a|per|each)\\s+week\\b"
OVERLAP_HOURS = "(?i)(^|[^0-9-])([0-9])\\+?\\s+(?:or more\\s+)?hours?\\s+(?:of\\s+)?overlap"
NO_EQUIVALENTS = "(?i)\\b(?:active|current|valid)\\b[^\\n]*\\blicen[sc]e\\b|\\bno equivalents?\\b"
EQUIVALENTS = "(?i)\\bequivalent"
CLAUSE = "[;,|•\\n]|\\.\\s|\\band\\b"
PART_QUALIFIED = "(?i)\\bpart[- ]qualifi(?:ed|cation)\\b|\\bfinalist\\b|\\bpapers (?:passed|remaining)\\b"
IN_PROGRESS = "(?i)\\b(?:studying|in progress|pursuing|working towards?|candidate|student|trainee|eligible|sitting|exams? (?:passed|remaining|pending|scheduled|sections?)|passed [a-zA-Z0-9_]+ of|expected)\\b"
YEAR_AFTER = "^[^\\n]{0,25}?(?<![0-9])((?:19|20)[0-9][0-9])(?![0-9])(?!\\s*[-–—])"
POSITION = "^(.+?), (.+), ((?:19|20)[0-9]{2}) [-–] ((?:19|20)[0-9]{2}|[Pp]resent)$"


def first_line(text: Column) -> Column:
    """The first line with a word, trimmed; null if there is none."""
    return F.trim(F.get(F.filter(F.split(text, "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]")), F.lit(0)))


def contacts(docs: DataFrame) -> DataFrame:
    """(doc_id, full_name, email, phone): the first line up to a wide gap, a free-standing dash or bar, or a comma; the first address; the first number of 10 to 13 digits."""
    name = F.trim(F.get(F.split(first_line(F.col("text")), NAME_END), F.lit(0)))
    name = F.when((name == F.upper(name)) & (name != F.lower(name)), F.initcap(name)).otherwise(name)
    numbers = F.filter(F.regexp_extract_all("text", F.lit(PHONE), F.lit(0)), lambda p: F.length(F.regexp_replace(p, "[^0-9]", "")).between(10, 13))
    return docs.select("doc_id", F.nullif(name, F.lit("")).alias("full_name"), F.nullif(F.regexp_extract("text", EMAIL, 0), F.lit("")).alias("email"), F.trim(F.get(numbers, F.lit(0))).alias("phone"))


def head_line(docs: DataFrame) -> DataFrame:
    """(doc_id, title): the first line with a word, cut at a dash, bar or parenthesis that white space goes before."""
    return docs.select("doc_id", F.trim(F.get(F.split(first_line(F.col("text")), "[\\x20\\x09]+[(|–—-]"), F.lit(0))).alias("title"))


def mentions(docs: DataFrame, names: DataFrame) -> DataFrame:
    """(doc_id, term, n, first_at): which terms each text names, how often, and where first (code points before it)."""
    return spans(docs, names).groupBy("doc_id", "term").agg(F.count_distinct("start").alias("n"), F.min("start").alias("first_at"))


def maximal(found: DataFrame) -> DataFrame:
    """Spans without those that lie inside a longer span of their text: of all that begin earlier, or there and end later, none may reach as far."""
    before = Window.partitionBy("doc_id").orderBy("start", F.col("end").desc()).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    longest = F.max(F.struct("end", (-F.col("start")).alias("before"))).over(before)  # the longest of those that reach farthest
    return found.withColumn("reach", longest).where("reach.end = end AND reach.before = -start").drop("reach")


def _sums(words: str, text: bytes, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, weights) of one text. words: its segments as lines, all but letters and digits as spaces; text: the term of a text without words."""
    counts: Counter[str] = Counter()
    for segment in words.split("\n"):
        ws = [w for w in segment.split() if w not in _STOPS]
        counts.update(ws)
        counts.update(map(" ".join, pairwise(ws)))
    terms = [t.encode() for t in counts] or [text]
    n = np.fromiter(counts.values() or [1], np.float64, len(terms))
    h = np.frombuffer(b"".join([md5(t).digest()[:4] for t in terms]), dtype=">u4").astype(np.int64)
    sums = np.bincount(h % dim, np.where(h // dim % 2 == 0, 1.0, -1.0) * (1 + np.log(n)))
    norm = np.sqrt(sums @ sums)
    if norm <= 1e-12:
        return np.zeros(1, np.int64), np.ones(1)
    there = np.unique(h % dim)
    return there, sums[there] / norm


_STOPS = frozenset(STOP_WORDS)
#: Texts that a batch of embeddings is made from.
EMBEDDED = 64


def hashed_embedding(docs: DataFrame, dim: int = 64) -> DataFrame:
    """(row, doc_id, bucket, weight): signed hashing of words and of neighbouring words within a segment, each worth 1 + ln(count), scaled to unit length.

    Empty buckets are left out; a text without words is a term itself, and a vector whose terms cancel is the first unit vector, so that none is zero.
    Case, segments and words are Spark's; terms are counted and hashed a text at a time, where the text lies: nothing is sorted, exploded or shuffled.
    """
    text = F.coalesce("text", F.lit(""))
    words = F.regexp_replace(F.regexp_replace(F.lower(text), "[\n;:,()]|\\.[\\x20\\x09-\\x0D]", "\n"), "[^\\p{L}\\p{N}\n]+", " ")
    rows = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", words.alias("words"), text.cast("binary").alias("text"))
    schema = f"row long, doc_id {docs.schema['doc_id'].dataType.simpleString()}, bucket long, weight double"

    def embed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for begin in range(0, whole.num_rows, EMBEDDED):
                batch = whole.slice(begin, EMBEDDED)
                found = [_sums(ws.as_py(), t.as_py(), dim) for ws, t in zip(batch.column("words"), batch.column("text"), strict=True)]
                of = pa.array(np.repeat(np.arange(len(found)), [len(x) for x, _ in found]))
                values = [pa.array(np.concatenate(x)) for x in zip(*found, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column("row").take(of), batch.column("doc_id").take(of), *values], names=["row", "doc_id", "bucket", "weight"])

    return rows.mapInArrow(embed, schema).withColumn("weight", F.round("weight", 6) + 0.0)


def in_context(found: DataFrame) -> DataFrame:
    """Located spans of certifications with `reading`: employer ("CPA firm"), other (someone else's), place (a state after a city or in a list), else holding."""
    two = F.length("surface") == 2
    place = two & (F.col("ahead").rlike(CITY_BEFORE) | F.col("behind").rlike(STATE_LIST))
    reading = F.when(F.col("behind").rlike(NOT_A_HOLDING), "employer").when(F.substring("ahead", -12, 12).rlike(SOMEONE_ELSE), "other").when(place, "place").otherwise("holding")
    return found.withColumn("reading", reading)


def standards(docs: DataFrame) -> DataFrame:
    """(doc_id, standards): accounting frameworks and numbered standards in order of first mention, each once whatever its case."""
    found = F.regexp_extract_all("text", F.lit(STANDARD), F.lit(0))
    folded = F.transform(found, F.lower)
    return docs.select("doc_id", F.filter(found, lambda x, i: F.array_position(folded, F.lower(x)) == i + 1).alias("standards"))


def years_of_experience(docs: DataFrame, as_of: int) -> DataFrame:
    """(doc_id, years): from the earliest year on the page, none later than as_of, to as_of; 70 at most; null without a year."""
    years = F.filter(F.regexp_extract_all("text", F.lit("[0-9]+"), F.lit(0)), lambda x: x.rlike("^(19[7-9][0-9]|20[0-9][0-9])$"))
    past = F.filter(F.transform(years, lambda x: x.cast("int")), lambda y: y <= as_of)
    return docs.select("doc_id", F.least(as_of - F.array_min(past), F.lit(70)).alias("years"))


def availability(docs: DataFrame) -> DataFrame:
    """(doc_id, availability): the first that the text says of immediate, two_weeks and one_month, else unknown."""
    said = F.lit("unknown")
    for name, pattern in reversed(AVAILABILITY):
        said = F.when(F.col("text").rlike(pattern), name).otherwise(said)
    return docs.select("doc_id", said.alias("availability"))


def sections(docs: DataFrame) -> DataFrame:
    """(doc_id, must, nice): bullets under must-have and nice-to-have headings, without their marks and a last full stop. A bullet belongs to the nearest heading above it.

    One pass over the lines of a row; nothing is shuffled.
    """
    none = F.array().cast("array<string>")
    begin = F.struct(F.lit("").alias("section"), none.alias("must"), none.alias("nice"))

    def step(s: Column, line: Column) -> Column:
        bare, bullet = F.trim(F.regexp_replace(line, "[\\t\\r\\f]", " ")), line.rlike(BULLET)
        heading = F.when(bare.rlike(MUST_HEADING), "must").when(bare.rlike(NICE_HEADING), "nice").otherwise("")
        item = F.regexp_replace(F.trim(F.regexp_replace(line, BULLET, "")), "[.]+$", "")
        return F.when(bare == "", s).otherwise(
            F.struct(
                F.when(bullet, s["section"]).otherwise(heading).alias("section"),
                F.when(bullet & (s["section"] == "must"), F.array_append(s["must"], item)).otherwise(s["must"]).alias("must"),
                F.when(bullet & (s["section"] == "nice"), F.array_append(s["nice"], item)).otherwise(s["nice"]).alias("nice"),
            )
        )

    found = F.aggregate(F.split("text", "\n"), begin, step)
    return docs.select("doc_id", found.alias("s")).select("doc_id", "s.must", "s.nice")


def numeric_requirements(docs: DataFrame) -> DataFrame:
    """(doc_id, min_years, hours_per_week, overlap_hours): years from the first must-have bullet that has them, the lower figures of hours from the whole text."""
    def figure(text: Column, pattern: str) -> Column:
        return F.nullif(F.regexp_extract(text, pattern, 2), F.lit("")).cast("int")

    years = F.filter(F.transform("must", lambda m: figure(m, MIN_YEARS)), lambda y: y.isNotNull())
    return sections(docs).join(docs, "doc_id").select("doc_id", F.get(years, F.lit(0)).alias("min_years"), figure(F.col("text"), HOURS_A_WEEK).alias("hours_per_week"), figure(F.col("text"), OVERLAP_HOURS).alias("overlap_hours"))


def section_terms(docs: DataFrame, names: DataFrame) -> DataFrame:
    """(doc_id, part, term): terms named under must-haves (in the whole text if there are none), and under nice-to-haves."""
    rows = sections(docs).join(docs, "doc_id")
    required = F.when(F.size("must") > 0, F.array_join("must", "\n")).otherwise(F.col("text"))
    texts = rows.select(F.struct("doc_id", F.lit("required").alias("part")).alias("doc_id"), required.alias("text")).union(rows.select(F.struct("doc_id", F.lit("preferred").alias("part")), F.array_join("nice", "\n")))
    return mentions(texts, names).select("doc_id.doc_id", "doc_id.part", "term")


def equivalents(lines: DataFrame) -> DataFrame:
    """(doc_id, pos, at, term, accept_equivalents, stated) of terms named on requirement lines (doc_id, pos, line, at, term): strict if the line asks for an active licence or no equivalents;
    of several on one line that speaks of equivalents, only the first is the requirement."""
    strict, spoken = F.col("line").rlike(NO_EQUIVALENTS), F.col("line").rlike(EQUIVALENTS)
    first = F.row_number().over(Window.partitionBy("doc_id", "line").orderBy("pos", "at", "term"))
    rows = lines.withColumn("k", first).where((F.col("k") == 1) | ~spoken)
    return rows.select("doc_id", "pos", "at", "term", (~strict).alias("accept_equivalents"), (strict | spoken).alias("stated"))


def lines_of(docs: DataFrame) -> DataFrame:
    """(doc_id, pos, line) of every line with a word."""
    return docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line")).where(F.col("line").rlike("[^\\x20\\x09-\\x0D]"))


def on_lines(docs: DataFrame, names: DataFrame) -> DataFrame:
    """(doc_id, start, end, surface, term, ahead, behind, pos, line): mentions with the line they begin on."""
    return spans(docs, names, lines=True)


def qualification_status(line: Column, name: Column) -> Column:
    """qualified, or what the words of the clauses that hold the name say instead: part_qualified or in_progress."""
    clauses = F.filter(F.split(line, CLAUSE), lambda c: F.contains(F.lower(c), F.lower(name)))
    context = F.when(F.size(clauses) > 0, F.concat_ws(" ", name, F.array_join(clauses, " "))).otherwise(F.concat_ws(" ", name, line))
    return F.when(context.rlike(PART_QUALIFIED), "part_qualified").when(context.rlike(IN_PROGRESS), "in_progress").otherwise("qualified")


def qualification_records(docs: DataFrame, names: DataFrame) -> DataFrame:
    """(doc_id, term, name, status, year, quote): one record for each certification a text names: its first held mention, else its first; quote is the line, year one that follows the name closely.

    Mentions that aren't holdings are dropped before longer names take the place of those inside them.
    """
    found = maximal(in_context(on_lines(docs, names)).where("reading = 'holding'"))
    quote = F.trim(F.regexp_replace("line", BULLET, ""))
    rows = found.withColumn("quote", quote).withColumn("status", qualification_status(F.col("quote"), F.col("surface")))
    best = F.row_number().over(Window.partitionBy("doc_id", "term").orderBy(F.col("status") != "qualified", "start", "end"))
    year = F.regexp_extract(F.substring_index("behind", "\n", 1), YEAR_AFTER, 1)
    return rows.withColumn("k", best).where("k = 1").select("doc_id", "term", F.col("surface").alias("name"), "status", F.nullif(year, F.lit("")).cast("int").alias("year"), "quote")


def positions(docs: DataFrame) -> DataFrame:
    """(doc_id, pos, title, employer, start_year, end_year, current): lines "title, employer, year - year or present" between the EXPERIENCE heading and the next heading in capitals."""
    body = F.regexp_extract("text", "(?s)(?:^|\\n)EXPERIENCE\\n(.*?)(?:\\n[A-Z]{4,}(?:\\n|$)|$)", 1)
    rows = docs.select("doc_id", F.posexplode(F.split(body, "\n")).alias("pos", "line"))
    part = lambda k: F.trim(F.regexp_extract("line", POSITION, k))
    end = part(4)
    return rows.where(F.col("line").rlike(POSITION)).select("doc_id", "pos", part(1).alias("title"), part(2).alias("employer"), part(3).cast("int").alias("start_year"), F.when(end.rlike("^[0-9]+$"), end).cast("int").alias("end_year"), (~end.rlike("^[0-9]+$")).alias("current"))


def read_off(docs: DataFrame, known: DataFrame, names: DataFrame) -> DataFrame:
    """(doc_id, term, line, year) for terms known to be held (doc_id, term): the line under CERTIFICATIONS that names it, else a held line anywhere; year only if the line has exactly one."""
    listed = docs.select("doc_id", F.split(F.regexp_extract("text", "(?s)(?:^|\\n)CERTIFICATIONS\\n(.*?)(?:\\n[A-Z]{4,}(?:\\n|$)|$)", 1), "\n").alias("section"))
    found = maximal(on_lines(docs, names)).join(known, ["doc_id", "term"], "left_semi").join(listed, "doc_id")
    held = qualification_status(F.col("line"), F.col("surface")) == "qualified"
    best = F.row_number().over(Window.partitionBy("doc_id", "term").orderBy(F.array_contains("section", F.col("line")).desc(), held.desc(), "start", "end"))
    years = F.filter(F.regexp_extract_all("line", F.lit("[0-9]+"), F.lit(0)), lambda x: x.rlike("^(19|20)[0-9][0-9]$"))
    return found.withColumn("k", best).where("k = 1").select("doc_id", "term", "line", F.when(F.size(years) == 1, F.get(years, F.lit(0))).cast("int").alias("year"))


#: What is left out of clean text, ligatures with what they stand for, white space at the end of a line.
UNPRINTABLE = "[\\x00-\\x08\\x0B-\\x1F\\x7F-\\x9F\\xAD\\u200B-\\u200D\\u2060\\uFEFF\\x{E0000}-\\x{E007F}]"
SPACE = "[\\t \\xA0\\u1680\\u2000-\\u200A\\u2028\\u2029\\u202F\\u205F\\u3000]"
LIGATURES = (("\ufb00", "ff"), ("\ufb01", "fi"), ("\ufb02", "fl"), ("\ufb03", "ffi"), ("\ufb04", "ffl"), ("\ufb05", "st"), ("\ufb06", "st"))


#: Texts that are Python strings at a time.
COMPOSED = 64


@F.arrow_udf(StringType())
def composed(text: pa.Array) -> pa.Array:
    """Composed characters (NFC), a few texts at a time; texts that are composed already are handed on as they are."""
    parts = []
    for k in range(0, len(text), COMPOSED):
        part = text.slice(k, COMPOSED)
        rows = part.to_pylist()
        if not all(x is None or unicodedata.is_normalized("NFC", x) for x in rows):
            part = pa.array([x if x is None else unicodedata.normalize("NFC", x) for x in rows], text.type)
        parts.append(part)
    return pa.concat_arrays(parts) if parts else text


def cleaned(text: Column) -> Column:
    """Line ends as line feeds, unprintable characters dropped, characters composed, ligatures written out, lines trimmed at the right, blank ends dropped.

    No character before the combining marks changes by composing, so that only texts with later ones go to Python.
    """
    plain = F.regexp_replace(F.regexp_replace(text, "\\r\\n?", "\n"), UNPRINTABLE, "")
    whole = F.coalesce(composed(F.when(plain.rlike("[^\\x00-\\u02FF]"), plain)), plain)
    for one, two in LIGATURES:
        whole = F.replace(whole, F.lit(one), F.lit(two))
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(whole, f"{SPACE}+(\\n|$)", "$1"), "^\n+", ""), "\n+$", "")


def embed_once(docs: DataFrame, cached: DataFrame) -> DataFrame:
    """(key, rows, hit): each distinct text once, by content key; hit if the cache has its vector."""
    keys = docs.select(F.sha2(F.coalesce("text", F.lit("")), 256).alias("key")).groupBy("key").agg(F.count("*").alias("rows"))
    return keys.join(cached.select("key", F.lit(True).alias("h")), "key", "left").select("key", "rows", F.coalesce("h", F.lit(False)).alias("hit"))
