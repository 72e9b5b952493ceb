"""Checks that extracted values, quotes and figures are really in the text they came from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rolemesh.operators.names import spans
from rolemesh.operators.quotes import in_text, line_of, passage_of
from rolemesh.operators.text import mentions

#: Number words, and what shows tenure or a role that goes on.
NUMBERS = ("one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten", "eleven", "twelve", "thirteen", "fourteen", "fifteen", "sixteen", "seventeen", "eighteen", "nineteen", "twenty")
TENURE = "(?<![0-9])(?:19|20)[0-9]{2}(?![0-9])|(?i)\\b(?:years?|yrs?)\\b"
PRESENT = "(?i)\\b(?:present|current(?:ly)?|now|ongoing|to date)\\b"
MOST_QUOTES, QUOTE_CHARS = 3, 300


def found_quote(docs: DataFrame, quote: str = "quote", text: str = "text") -> DataFrame:
    """docs with found: the passage that the quote copies, as the text writes it (case, white space, dashes and quotation marks may differ); null if there is none."""
    return docs.withColumn("found", passage_of(quote, text))


def line_with(fragment: Column, text: Column) -> Column:
    """The first line that carries the fragment, without bullets; null if none does."""
    return F.nullif(F.regexp_replace(F.trim(line_of(fragment, text)), "^[-*•>\\s]+", ""), F.lit(""))


#: Fixed value: what the last four digits of a phone number follow.
PHONE = "(?<![0-9]{3}(?:\\) ?|[-. ])[0-9]{3}[-. ])"


def year_in_text(year: Column, text: Column) -> Column:
    """Whether the text writes the year: in full, as '23, or as month/year; the day of a date and the end of a phone number are none."""
    # fixed values: how a year is written
    short = F.lpad((year % 100).cast("string"), 2, "0")
    pattern = F.concat(F.lit(f"(?<![0-9])(?:{PHONE}"), year.cast("string"), F.lit("|['’]"), short, F.lit("|(?<![0-9/])(?:0?[1-9]|1[0-2])/"), short, F.lit("(?![0-9/]))(?![0-9])"))
    return F.coalesce(F.rlike(text, pattern), F.lit(False))


def _word(number: Column) -> Column:
    return F.get(F.array(*[F.lit(w) for w in NUMBERS]), number - 1)


def number_in_text(number: Column, text: Column) -> Column:
    """Whether the text writes the number, in digits that are no part of a longer one, or in words up to twenty."""
    digits = F.array_contains(F.regexp_extract_all(text, F.lit(NUMBER), F.lit(0)), number.cast("string"))
    words = F.array_contains(F.regexp_extract_all(F.lower(text), F.lit("[\\p{L}\\p{N}_]+"), F.lit(0)), F.when(number.between(1, 20), _word(number)))
    return F.coalesce(digits, F.lit(False)) | F.coalesce(words, F.lit(False))


#: A whole number that is no part of a longer one, and what an hour is called.
NUMBER = "(?<![0-9.,])[0-9]+(?![0-9,]|\\.[0-9])"


def _figure(number: Column) -> Column:
    digits = F.concat(F.lit("(?<![0-9.,$:])"), number.cast("string"), F.lit("(?![0-9,:]|\\.[0-9])"))
    return F.when(number.between(1, 20), F.concat(F.lit("(?:"), digits, F.lit("|\\b"), _word(number), F.lit("\\b)"))).otherwise(digits)


#: Fixed value.
HOURS = "\\s*\\+?\\s*(?:or more\\s+)?(?:hours?|hrs?)\\b"


def weekly_hours_in_text(hours: Column, text: Column) -> Column:
    # fixed values: how weekly hours are written
    pattern = F.concat(F.lit("(?i)"), _figure(hours), F.lit(f"(?:\\s*(?:to|[-–])\\s*[0-9]{{1,2}})?{HOURS}(?:\\s*(?:a|per|each|/)\\s*(?:week|wk)\\b|\\s+weekly\\b)"))
    return F.coalesce(F.rlike(text, pattern), F.lit(False))


def overlap_hours_in_text(hours: Column, text: Column) -> Column:
    # fixed values: how hours of overlap are written
    clause, n = "[^.;\\n]{0,60}", _figure(hours)
    return F.coalesce(F.rlike(text, F.concat(F.lit("(?i)"), n, F.lit(f"{HOURS}{clause}\\boverlap|\\boverlap{clause}"), n, F.lit(HOURS))), F.lit(False))


def phone_in_text(phone: Column, text: Column) -> Column:
    """Whether the page has the number's digits, or its last ten."""
    digits, page = F.regexp_replace(phone, "[^0-9]", ""), F.regexp_replace(text, "[^0-9]", "")
    return F.coalesce((F.length(digits) >= 7) & (F.contains(page, digits) | ((F.length(digits) > 10) & F.contains(page, F.right(digits, F.lit(10))))), F.lit(False))


#: How a value of each kind is looked for.
CHECKS = {
    "verbatim": in_text,
    "phone": phone_in_text,
    "year": lambda v, t: year_in_text(F.try_to_number(v, F.lit("9999")).cast("int"), t),
    "number": lambda v, t: number_in_text(v.cast("int"), t),
    "weekly": lambda v, t: weekly_hours_in_text(v.cast("int"), t),
    "overlap": lambda v, t: overlap_hours_in_text(v.cast("int"), t),
    "tenure": lambda v, t: F.rlike(t, F.lit(TENURE)),
    "present": lambda v, t: F.rlike(t, F.lit(PRESENT)),
}


def audited(values: DataFrame, docs: DataFrame, names: DataFrame) -> DataFrame:
    """values (doc_id, field, kind, value) with grounded: whether the text of their document carries them.

    kind is one of CHECKS, or `term` for canonical ids, which count as carried if the text names them (names: name, term). What isn't
    grounded is the drop log; the rest, gathered by document and field, is what is left of the extraction.
    """
    named = mentions(docs, names).select("doc_id", F.col("term").alias("value"), F.lit("term").alias("kind"), F.lit(True).alias("there"))
    terms = values.where("kind = 'term'").join(named, ["doc_id", "kind", "value"], "left").select("doc_id", "field", "kind", "value", F.coalesce("there", F.lit(False)).alias("grounded"))
    case = F.lit(False)
    for kind, check in CHECKS.items():
        own = [F.when(F.col("kind") == kind, F.col(c)) for c in ("value", "text")]  # so that Python sees no other rows
        case = F.when(F.col("kind") == kind, check(*own)).otherwise(case)
    other = values.where("kind <> 'term'").join(docs.select("doc_id", "text"), "doc_id").select("doc_id", "field", "kind", "value", case.alias("grounded"))
    return terms.union(other)


def grounded_quotes(answers: DataFrame, texts: DataFrame) -> DataFrame:
    """(row_id, dimension, quotes, unbacked, overlong, absent) of answers (row_id, candidate_id, dimension, level, quotes): the passages that the candidate's text carries, each once,
    300 characters at most, the first three; whether a level above 0 is left with none, and how many quotes were too long or are not there."""
    rows = answers.select("row_id", "candidate_id", "dimension", "level", F.posexplode_outer("quotes").alias("pos", "quote")).join(texts.select("candidate_id", "text"), "candidate_id")
    got = found_quote(rows).withColumn("long", F.length("quote") > QUOTE_CHARS)
    good = F.when(~F.col("long") & (F.length("found") <= QUOTE_CHARS), F.col("found"))
    once = F.row_number().over(Window.partitionBy("row_id", "dimension", good).orderBy("pos"))
    marked = got.withColumn("good", good).withColumn("k", once)
    sums = marked.groupBy("row_id", "dimension").agg(
        F.max("level").alias("level"), F.sort_array(F.collect_list(F.when(F.col("good").isNotNull() & (F.col("k") == 1), F.struct("pos", "good")))).alias("q"),
        F.count_if("long").alias("overlong"), F.count_if(~F.col("long") & F.col("good").isNull()).alias("absent"))
    kept = F.slice(F.transform("q", lambda x: x["good"]), 1, MOST_QUOTES)
    return sums.select("row_id", "dimension", kept.alias("quotes"), ((F.coalesce("level", F.lit(0)) > 0) & (F.size(kept) == 0)).alias("unbacked"), "overlong", "absent")


def coverage(plan: DataFrame, docs: DataFrame, names: DataFrame, least_words: int, least_positions: int) -> DataFrame:
    """(doc_id, problem) of planned documents: terms (doc_id, term, ...) that the text never names, too few words or positions, and a name that isn't there. plan: (doc_id, full_name, terms)."""
    from rolemesh.operators.text import positions

    named = spans(docs, names).select("doc_id", "term")
    lost = plan.select("doc_id", F.explode("terms").alias("term")).join(named.hint("merge"), ["doc_id", "term"], "left_anti").select("doc_id", F.concat(F.lit("never names "), F.col("term")).alias("problem"))
    jobs = positions(docs).groupBy("doc_id").agg(F.count("*").alias("jobs"))
    rows = plan.join(docs.select("doc_id", "text").hint("merge"), "doc_id").join(jobs.hint("merge"), "doc_id", "left")
    words = F.size(F.regexp_extract_all("text", F.lit("([^\\x20\\x09-\\x0D]+)"), F.lit(0)))
    checks = F.array(F.when(words < least_words, "too few words"), F.when(F.coalesce("jobs", F.lit(0)) < least_positions, "too few positions"), F.when(~in_text(F.col("full_name"), F.col("text")), "name is missing"))
    return lost.union(rows.select("doc_id", F.explode(F.filter(checks, lambda c: c.isNotNull()))))
