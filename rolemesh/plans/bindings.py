"""The supplied tables bound to the schema of candidates and roles, as DataFrames and as SQL for the oracle.

All derivations are integer arithmetic, set aggregates and string concatenation on keys, so that
both forms agree exactly. Tables that grow are joined by merge: their files are a fraction of their rows, and Spark, which goes by the size of files,
would build them in the driver to broadcast them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed values.
ZONES = ("America/New_York", "America/Chicago", "America/Los_Angeles", "Europe/London", "Asia/Manila", "Asia/Kolkata", "Australia/Sydney", "America/Phoenix")
TODAY = "2026-06-15"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _zone(key: str) -> str:
    return f"element_at(array({', '.join(repr(z) for z in ZONES)}), cast(({key}) % 8 + 1 AS int))"


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").selectExpr("c_custkey AS candidate_id", "c_name AS full_name", "concat(lower(c_name), '@example.com') AS email", "CASE WHEN c_custkey % 20 = 0 THEN 'archived' ELSE 'active' END AS status")


def profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a profile: certifications and software as sorted sets, years of experience or null."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey")
    parts = table(spark, sf_dir, "part").select("p_partkey", F.lower("p_type").alias("cert"), F.lower("p_brand").alias("soft"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority", F.year("o_orderdate").alias("y"))
    facts = orders.hint("merge").join(lines, F.col("o_orderkey") == F.col("l_orderkey")).join(parts.hint("merge"), F.col("l_partkey") == F.col("p_partkey"))
    held = facts.groupBy(F.col("o_custkey").alias("candidate_id")).agg(
        F.sort_array(F.collect_set(F.when(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"), F.col("cert")))).alias("c"),
        F.sort_array(F.collect_set("soft")).alias("s"),
        (F.max("y") - F.min("y")).alias("years"),
    )
    keys = table(spark, sf_dir, "customer").where("c_custkey % 13 <> 0").select(F.col("c_custkey").alias("candidate_id"))
    none = F.array().cast("array<string>")
    return keys.join(held.hint("merge"), "candidate_id", "left").select("candidate_id", F.coalesce("c", none).alias("certifications"), F.coalesce("s", none).alias("software"), F.expr("CASE WHEN candidate_id % 17 = 0 THEN NULL ELSE years END").alias("years_experience"))


def availability(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").where("c_custkey % 7 <> 0").selectExpr(
        "c_custkey AS candidate_id",
        f"CASE WHEN c_custkey % 31 = 0 THEN 'XYZ5' ELSE {_zone('c_nationkey')} END AS timezone",
        "cast(CASE WHEN c_custkey % 9 = 0 THEN 1260 ELSE 60 * (6 + c_custkey % 5) END AS int) AS work_start",
        "cast(CASE WHEN c_custkey % 9 = 0 THEN 360 ELSE 60 * (14 + c_custkey % 7) END AS int) AS work_end",
        "element_at(array(15, 20, 40, 40), cast(c_custkey % 4 + 1 AS int)) AS hours_per_week",
        "date_add(date '2026-01-01', cast(c_custkey % 300 AS int)) AS available_from",
    )


def roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every part is a role."""
    return table(spark, sf_dir, "part").selectExpr(
        "p_partkey AS role_id", "p_name AS title",
        "CASE WHEN p_partkey % 3 = 0 THEN array(lower(p_type)) ELSE cast(array() AS array<string>) END AS required_certifications",
        "CASE WHEN p_partkey % 2 = 0 THEN array(lower(p_brand)) ELSE cast(array() AS array<string>) END AS required_software",
        "nullif(p_size % 6, 0) AS min_years",
        "CASE WHEN p_partkey % 5 <> 0 THEN date_add(date '2026-06-01', cast(p_partkey % 60 AS int)) END AS starts_on",
        "CASE WHEN p_partkey % 4 = 0 THEN 20 END AS hours_per_week",
        f"CASE WHEN p_partkey % 6 <> 5 THEN {_zone('p_partkey')} END AS timezone",
        "CASE WHEN p_partkey % 6 <> 5 THEN cast(1 + p_partkey % 5 AS int) END AS min_overlap_hours",
        "CASE WHEN p_partkey % 10 = 9 THEN 'closed' ELSE 'open' END AS status",
        "CASE WHEN p_partkey % 5 = 4 THEN true ELSE p_partkey % 4 <> 3 END AS accept_equivalents",
    )


def terms(spark: SparkSession) -> DataFrame:
    """Certification vocabulary: (id, grp, variant_of). `standard` is ambiguous; economy and small are its variants."""
    rows = [("economy", "g0", "standard"), ("standard", "g0", None), ("small", "g0", "standard"), ("medium", "g1", None), ("large", "g1", None), ("promo", "g2", None)]
    return spark.createDataFrame(rows, "id string, grp string, variant_of string")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("v"))


def candidate_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(candidate_id, model, v): v null for some, all zeros for some."""
    n = table(spark, sf_dir, "embeddings").count()
    keys = table(spark, sf_dir, "customer").selectExpr("c_custkey AS candidate_id", f"(c_custkey * 7 + 1) % {n} AS vec_id", "CASE WHEN c_custkey % 11 = 0 THEN 'b' ELSE 'a' END AS model")
    joined = keys.hint("merge").join(vectors(spark, sf_dir), "vec_id")
    value = F.when(F.col("candidate_id") % 19 == 0, F.lit(None)).when(F.col("candidate_id") % 23 == 0, F.transform("v", lambda x: x * 0)).otherwise(F.col("v"))
    return joined.select("candidate_id", "model", value.alias("v"))


def role_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "embeddings").count()
    keys = table(spark, sf_dir, "part").selectExpr("p_partkey AS role_id", f"p_partkey % {n} AS vec_id", "CASE WHEN p_partkey % 11 = 0 THEN 'b' ELSE 'a' END AS model")
    return keys.hint("merge").join(vectors(spark, sf_dir), "vec_id").select("role_id", "model", "v")


_LIST = ", ".join(repr(z) for z in ZONES)
SQL = f"""
cand AS MATERIALIZED (SELECT c_custkey AS candidate_id, c_name AS full_name, lower(c_name) || '@example.com' AS email, CASE WHEN c_custkey % 20 = 0 THEN 'archived' ELSE 'active' END AS status FROM customer),
facts AS MATERIALIZED (SELECT o_custkey, o_orderpriority, year(o_orderdate) AS y, lower(p_type) AS cert, lower(p_brand) AS soft FROM orders JOIN lineitem ON o_orderkey = l_orderkey JOIN part ON l_partkey = p_partkey),
held AS MATERIALIZED (SELECT o_custkey, list_sort(list(DISTINCT cert) FILTER (o_orderpriority IN ('1-URGENT', '2-HIGH'))) AS c, list_sort(list(DISTINCT soft)) AS s, max(y) - min(y) AS years FROM facts GROUP BY 1),
prof AS MATERIALIZED (SELECT c_custkey AS candidate_id, coalesce(c, []::VARCHAR[]) AS certifications, coalesce(s, []::VARCHAR[]) AS software, CASE WHEN c_custkey % 17 = 0 THEN NULL ELSE years END AS years_experience FROM customer LEFT JOIN held ON c_custkey = o_custkey WHERE c_custkey % 13 <> 0),
avail AS MATERIALIZED (SELECT c_custkey AS candidate_id, CASE WHEN c_custkey % 31 = 0 THEN 'XYZ5' ELSE [{_LIST}][c_nationkey % 8 + 1] END AS timezone,
  (CASE WHEN c_custkey % 9 = 0 THEN 1260 ELSE 60 * (6 + c_custkey % 5) END)::INTEGER AS work_start, (CASE WHEN c_custkey % 9 = 0 THEN 360 ELSE 60 * (14 + c_custkey % 7) END)::INTEGER AS work_end,
  [15, 20, 40, 40][c_custkey % 4 + 1] AS hours_per_week, (DATE '2026-01-01' + (c_custkey % 300)::INTEGER)::DATE AS available_from FROM customer WHERE c_custkey % 7 <> 0),
role AS MATERIALIZED (SELECT p_partkey AS role_id, p_name AS title, CASE WHEN p_partkey % 3 = 0 THEN [lower(p_type)] ELSE []::VARCHAR[] END AS required_certifications, CASE WHEN p_partkey % 2 = 0 THEN [lower(p_brand)] ELSE []::VARCHAR[] END AS required_software,
  nullif(p_size % 6, 0) AS min_years, CASE WHEN p_partkey % 5 <> 0 THEN (DATE '2026-06-01' + (p_partkey % 60)::INTEGER)::DATE END AS starts_on, CASE WHEN p_partkey % 4 = 0 THEN 20 END AS hours_per_week,
  CASE WHEN p_partkey % 6 <> 5 THEN [{_LIST}][p_partkey % 8 + 1] END AS timezone, CASE WHEN p_partkey % 6 <> 5 THEN (1 + p_partkey % 5)::INTEGER END AS min_overlap_hours,
  CASE WHEN p_partkey % 10 = 9 THEN 'closed' ELSE 'open' END AS status, CASE WHEN p_partkey % 5 = 4 THEN true ELSE p_partkey % 4 <> 3 END AS accept_equivalents FROM part),
term AS (SELECT * FROM (VALUES ('economy', 'g0', 'standard'), ('standard', 'g0', NULL), ('small', 'g0', 'standard'), ('medium', 'g1', NULL), ('large', 'g1', NULL), ('promo', 'g2', NULL)) t(id, grp, variant_of)),
nvec AS (SELECT count(*) AS n FROM embeddings),
cvec AS MATERIALIZED (SELECT c_custkey AS candidate_id, CASE WHEN c_custkey % 11 = 0 THEN 'b' ELSE 'a' END AS model, CASE WHEN c_custkey % 19 = 0 THEN NULL WHEN c_custkey % 23 = 0 THEN [x * 0 FOR x IN embedding::DOUBLE[]] ELSE embedding::DOUBLE[] END AS v FROM customer, nvec JOIN embeddings ON vec_id = (c_custkey * 7 + 1) % n),
rvec AS MATERIALIZED (SELECT p_partkey AS role_id, CASE WHEN p_partkey % 11 = 0 THEN 'b' ELSE 'a' END AS model, embedding::DOUBLE[] AS v FROM part, nvec JOIN embeddings ON vec_id = p_partkey % n)
"""
