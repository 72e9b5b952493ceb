"""Why a candidate passes or fails a role, in words, for any pairs that are asked about (role_id, candidate_id)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rolemesh.operators.funnel import acceptable_ids


def hours(minutes: Column) -> Column:
    """1 hour, 3 hours, 2.5 hours."""
    whole = F.concat((minutes / 60).cast("int").cast("string"), F.lit(" hours"))
    return F.when(minutes == 60, "1 hour").when(minutes % 60 == 0, whole).otherwise(F.concat((minutes / 60.0).cast("double").cast("string"), F.lit(" hours")))


def qualification_verdicts(pairs: DataFrame, roles: DataFrame, profiles: DataFrame, terms: DataFrame) -> DataFrame:
    """(role_id, candidate_id, required, passed, held, reason) for each certification that a role of a pair requires: the best that the candidate holds for it decides.

    terms: (id, label, grp, variant_of). Best is the one asked for or a variant of it, then an accepted equivalent, then one of the same level that the role rules out.
    """
    asked = pairs.join(roles.select("role_id", F.coalesce("accept_equivalents", F.lit(True)).alias("accepts"), F.posexplode("required_certifications").alias("pos", "required")), "role_id")
    held = profiles.select("candidate_id", F.posexplode("certifications").alias("at", "id"))
    levels = acceptable_ids(terms).groupBy("required", "id").agg(F.min("accept_equivalents").alias("equivalent"))  # false: it is the one asked for
    met = asked.join(held, "candidate_id").join(levels, ["required", "id"])
    met = met.withColumn("grade", F.when(~F.col("equivalent"), 0).when(F.col("accepts"), 1).otherwise(2))
    best = met.groupBy("role_id", "candidate_id", "pos").agg(F.min(F.struct("grade", "at", "id")).alias("b"))
    names = terms.select("id", "label").distinct()
    rows = asked.join(best, ["role_id", "candidate_id", "pos"], "left").join(names.select(F.col("id").alias("required"), F.col("label").alias("asked")), "required").join(names.select(F.col("id").alias("held"), F.col("label").alias("shown")), F.col("b.id") == F.col("held"), "left")
    grade, asked_, shown = F.col("b.grade"), F.col("asked"), F.col("shown")
    reason = (
        F.when(grade == 0, F.concat(F.lit("Holds "), shown, F.lit(", which this role asks for")))
        .when(grade == 1, F.concat(F.lit("Holds "), shown, F.lit(", equivalent to the "), asked_, F.lit(" this role asks for")))
        .when(grade == 2, F.concat(F.lit("Holds "), shown, F.lit(", the same level as a "), asked_, F.lit(", but this role requires the "), asked_, F.lit(" itself")))
        .otherwise(F.concat(F.lit("No "), asked_, F.when(F.col("accepts"), " or equivalent").otherwise(""), F.lit(" on the resume")))
    )
    return rows.select("role_id", "candidate_id", "required", F.coalesce(grade < 2, F.lit(False)).alias("passed"), "held", reason.alias("reason"))


def nearest_misses(failed: DataFrame, records: DataFrame, terms: DataFrame, group_labels: DataFrame) -> DataFrame:
    """(role_id, candidate_id, required, near, reason) for failed requirements: the closest thing the resume shows.

    records: (candidate_id, pos, id, name, status). Closest is one of the right level not held yet, then shared letters of the same group, then one of another level.
    """
    levels = acceptable_ids(terms).where("accept_equivalents").select("required", "id", F.lit(True).alias("level"))
    one = terms.select("id", "grp").distinct()
    shared = terms.where("variant_of IS NOT NULL").select(F.col("variant_of").alias("id"), F.lit(True).alias("shared")).distinct()
    rows = failed.join(records, "candidate_id").join(levels, ["required", "id"], "left").join(one, "id").join(one.select(F.col("id").alias("required"), F.col("grp").alias("wanted")), "required").join(shared, "id", "left")
    rows = rows.join(terms.select(F.col("id").alias("required"), F.col("label").alias("asked")).distinct(), "required").join(group_labels, "grp", "left")
    held = F.col("status") == "qualified"
    kind = F.when(~held & F.col("level").isNotNull(), 0).when(held & F.col("shared").isNotNull() & (F.col("grp") == F.col("wanted")), 1).when(held & (F.col("grp") != F.col("wanted")), 2)
    rows = rows.withColumn("kind", kind).where("kind IS NOT NULL")
    # records of the last two kinds count in their own order, whichever comes first
    best = F.row_number().over(Window.partitionBy("role_id", "candidate_id", "required").orderBy(F.col("kind") > 0, "pos"))
    asked, name = F.col("asked"), F.col("name")
    said = F.when(F.col("status") == "part_qualified", "Part-qualified ").otherwise("Studying for ")
    reason = (
        F.when(F.col("kind") == 0, F.concat(said, name, F.lit(": not yet qualified, so it does not meet the "), asked, F.lit(" requirement")))
        .when(F.col("kind") == 1, F.concat(F.lit("Holds "), name, F.lit(" but the resume does not say which body or country awarded it, so it cannot be matched to the "), asked, F.lit(" this role asks for")))
        .otherwise(F.concat(F.lit("Holds "), name, F.lit(", which is a different level ("), F.lower("group_label"), F.lit(") and not equivalent to the "), asked, F.lit(" this role asks for")))
    )
    return rows.withColumn("k", best).where("k = 1").select("role_id", "candidate_id", "required", F.col("id").alias("near"), reason.alias("reason"))


def shortfalls(pairs: DataFrame, roles: DataFrame, profiles: DataFrame) -> DataFrame:
    """(role_id, candidate_id, missing, experience): software asked for and not held, in the role's order, and why the years don't do, if they don't."""
    rows = pairs.join(roles.select("role_id", "required_software", "min_years"), "role_id").join(profiles.select("candidate_id", "software", "years_experience"), "candidate_id")
    wanted, has = F.coalesce("min_years", F.lit(0)), F.col("years_experience")
    asks = F.concat(F.lit("; this role asks for at least "), wanted.cast("string"))
    short = F.when(has.isNull(), F.concat(F.lit("The resume does not show how many years of experience"), asks)).otherwise(F.concat(F.lit("Has "), has.cast("string"), F.when(has == 1, " year").otherwise(" years"), F.lit(" of experience"), asks))
    return rows.select("role_id", "candidate_id", F.filter("required_software", lambda s: ~F.array_contains("software", s)).alias("missing"), F.when((wanted > 0) & ~F.coalesce(has >= wanted, F.lit(False)), short).alias("experience"))


def availability_verdicts(pairs: DataFrame, roles: DataFrame, availability: DataFrame, minutes: DataFrame, known_zones: DataFrame, today: str) -> DataFrame:
    """(role_id, candidate_id, passed, reasons, overlap_minutes): when and where, with every reason against; those who have not answered fail. minutes: see overlap_minutes."""
    asked = roles.select("role_id", "starts_on", F.coalesce("starts_on", F.lit(today).cast("date")).alias("day"), F.col("hours_per_week").alias("asked_hours"), F.col("timezone").alias("role_zone"), "min_overlap_hours")
    answers = availability.select("candidate_id", F.col("timezone").alias("zone"), "work_start", "work_end", "hours_per_week", "available_from", F.lit(True).alias("answered"))
    known = known_zones.select("zone").distinct()
    rows = pairs.join(asked, "role_id").join(answers, "candidate_id", "left").join(minutes, ["role_zone", "day", "zone", "work_start", "work_end"], "left")
    rows = rows.join(known.withColumn("k1", F.lit(True)), "zone", "left").join(known.select(F.col("zone").alias("role_zone"), F.lit(True).alias("k2")), "role_zone", "left")
    c = F.col
    text = lambda *parts: F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])
    reasons = F.array(
        F.when(c("answered").isNull(), "Has not given their time zone, working hours, hours per week and start date"),
        F.when(c("available_from") > c("starts_on"), text("Available from ", c("available_from").cast("string"), "; this role starts on ", c("starts_on").cast("string"))),
        F.when(c("hours_per_week") < c("asked_hours"), text("Offers ", c("hours_per_week").cast("string"), " hours a week; this role needs ", c("asked_hours").cast("string"))),
        F.when(c("answered") & c("role_zone").isNull() & c("min_overlap_hours").isNotNull(), text("This role needs ", c("min_overlap_hours").cast("string"), " hours of overlap but has no time zone to work it out in")),
        F.when(c("answered") & c("role_zone").isNotNull(),
               F.when(c("k1").isNull(), text('Time zone "', c("zone"), '" is not one the overlap can be worked out for'))
               .when(c("k2").isNull(), text('The role\'s time zone "', c("role_zone"), '" is not one the overlap can be worked out for'))
               .when(c("minutes") < 60 * c("min_overlap_hours"), text("Working hours overlap the role's day (09:00 to 17:00 ", c("role_zone"), ") by ", hours(c("minutes")), "; this role needs ", c("min_overlap_hours").cast("string")))),
    )
    said = F.filter(reasons, lambda r: r.isNotNull())
    return rows.select("role_id", "candidate_id", (F.size(said) == 0).alias("passed"), said.alias("reasons"), c("minutes").alias("overlap_minutes"))
