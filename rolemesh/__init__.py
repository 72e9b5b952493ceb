"""Talent-matching analytics on Spark: DataFrame operators over whole tables of roles and candidates."""
