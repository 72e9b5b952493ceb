"""How good extractions and rankings are against what is known to be right."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rolemesh.operators.text import comparison_form


def exact(got: Column, want: Column) -> Column:
    """1 if the values agree apart from case and blanks around them (two missing ones do), else 0."""
    return F.lower(F.trim(got)).eqNullSafe(F.lower(F.trim(want))).cast("double")


def field_means(scores: DataFrame, errors: DataFrame) -> DataFrame:
    """(section, field, n, mean) of scores (case_id, section, field, score); a case that errored scores 0 in every field of its section."""
    bad = errors.select("case_id").distinct().withColumn("e", F.lit(True))
    rows = scores.join(bad, "case_id", "left")
    return rows.groupBy("section", "field").agg(F.count("*").alias("n"), F.round(F.avg(F.when(F.col("e"), 0.0).otherwise(F.col("score"))), 6).alias("mean"))


def position_form(p: Column) -> Column:
    """A position as comparable text: title start-end."""
    return F.concat(comparison_form(p["title"]), F.lit(" "), F.coalesce(p["start_year"].cast("string"), F.lit("?")), F.lit("-"), F.coalesce(p["end_year"].cast("string"), F.lit("now")))


def qualification_form(q: Column) -> Column:
    """A qualification as comparable text: id, place and status."""
    return F.concat_ws(" ", q["id"], F.coalesce(q["place"], F.lit("-")), q["status"])


def precision_at_truth(ranked: DataFrame, truth: DataFrame) -> DataFrame:
    """(role_id, k, hits, precision): of the first k ranked, k being the size of the role's truth set, the share that is true; roles without truth are left out."""
    size = truth.groupBy("role_id").agg(F.count_distinct("candidate_id").alias("k"))
    first = ranked.withColumn("place", F.row_number().over(Window.partitionBy("role_id").orderBy("rank", "candidate_id"))).join(size, "role_id").where(F.col("place") <= F.col("k"))
    hit = first.join(truth.select("role_id", "candidate_id").distinct(), ["role_id", "candidate_id"], "left_semi").groupBy("role_id").agg(F.count("*").alias("hits"))
    rows = size.join(hit, "role_id", "left").na.fill({"hits": 0})
    return rows.select("role_id", "k", "hits", F.round(F.col("hits") / F.col("k"), 6).alias("precision"))


def perturbed(clean: DataFrame, added: DataFrame, levels: list[str]) -> DataFrame:
    """(role_id, candidate_id, levels_unchanged, score_not_raised, moved): each pair with something added to its text against the clean run; moved names the levels that changed."""
    keys = ["role_id", "candidate_id"]
    rows = clean.select(*keys, F.col("score").alias("s0"), *[F.col(c).alias(f"{c}_0") for c in levels]).join(added.select(*keys, F.col("score").alias("s1"), *levels), keys)
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("none"))
    moved = F.filter(F.array(*[F.when(~F.col(c).eqNullSafe(F.col(f"{c}_0")), F.concat(F.lit(f"{c}: "), text(f"{c}_0"), F.lit(" -> "), text(c))) for c in levels]), lambda m: m.isNotNull())
    return rows.select(*keys, (F.size(moved) == 0).alias("levels_unchanged"), F.coalesce(F.col("s1") <= F.col("s0"), F.lit(True)).alias("score_not_raised"), F.array_join(moved, "; ").alias("moved"))


def attribute_summary(rows: DataFrame, total: int, most: int = 10) -> DataFrame:
    """(attribute, value, n, percent, place) of the `most` commonest values of each attribute (attribute, value: null for none), and how many have none."""
    counts = rows.groupBy("attribute", F.coalesce("value", F.lit("(none)")).alias("value")).agg(F.count("*").alias("n"))
    place = F.row_number().over(Window.partitionBy("attribute", F.col("value") == "(none)").orderBy(F.col("n").desc(), "value"))
    return counts.withColumn("place", place).where((F.col("place") <= most) | (F.col("value") == "(none)")).withColumn("percent", F.round(100.0 * F.col("n") / total, 4))
