"""Quality rules as a bitmask ledger, with DataFrame functions only.

Every rule is evaluated once a document; the ledger keeps its failure bit and the measurements the
rules read. A policy is a versioned mask over those bits: to apply another policy, or to ask what
a rule costs, nothing is measured again. Ablations group by the mask first (at most 2^rules rows,
whatever the corpus) and take every rule's share from those rows by bit operations.

Defined cases: a null text has no words; an empty table gives an empty ledger; a very long text is measured whole,
in time proportional to n log n of its words; repeated rows are each a row of the ledger; nothing is joined or shuffled to measure, so one source or one text may hold any share of the rows.
Columns of docs other than doc_id and text are ignored, or kept by `filtered` whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rolemesh.llm.common import written

#: White space between words.
SPACE = "[\\x20\\x09-\\x0D]"
SYMBOLS = "[#*$%&|<>]"


@dataclass(frozen=True)
class Rule:
    """fails(measurement columns) is true for a document that breaks the rule."""

    name: str
    fails: Callable[[Callable[[str], Column]], Column]
    base: bool = False


#: Bit k of the ledger is rule k. New rules are added at the end; a bit never changes its meaning.
RULES = (
    Rule("few_words", lambda m: m("n_words") < 50, base=True),
    Rule("repeated_windows", lambda m: 100 * m("n_repeat_words") > 50 * m("n_words"), base=True),
    Rule("many_symbols", lambda m: 100 * m("n_symbols") > 30 * m("n_words")),
    Rule("repeated_lines", lambda m: 100 * m("n_dup_lines") > 50 * m("n_lines")),
    Rule("shouting", lambda m: 100 * m("n_upper") > 40 * m("word_chars")),
    Rule("odd_word_length", lambda m: (m("word_chars") < 2 * m("n_words")) | (m("word_chars") > 20 * m("n_words"))),
)
BIT = {r.name: 1 << k for k, r in enumerate(RULES)}
BASE = sum(BIT[r.name] for r in RULES if r.base)
#: Policy versions: the rules that reject.
POLICIES = {1: BASE, 2: BASE | BIT["many_symbols"] | BIT["shouting"], 3: sum(BIT.values())}


def measured(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines, n_lines, n_upper and n_repeat_words added, all long (names as given must be free)."""
    body = F.coalesce(F.col(text), F.lit(""))
    words = F.filter(F.split(body, f"{SPACE}+"), lambda w: w != "")
    lines = F.filter(F.split(body, "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    split = docs.withColumns({"_w": words, "_l": lines, "n_symbols": F.regexp_count(body, F.lit(SYMBOLS)), "n_upper": F.length(F.regexp_replace(body, "\\P{Lu}+", ""))})
    n = F.size("_w")
    hashed = F.slice(F.transform("_w", lambda w, i: F.xxhash64(w, F.get("_w", i + 1), F.get("_w", i + 2))), 1, n - 2)
    counted = split.withColumns({"n_words": n, "word_chars": F.length(F.array_join("_w", "")), "n_lines": F.size("_l"), "n_dup_lines": F.size("_l") - F.size(F.array_distinct("_l")), "_h": F.when(n > 2, hashed)})
    # equal windows have equal hashes: only texts with an equal pair of hashes are looked at further, word by word
    at = F.sequence(F.lit(0), F.col("n_words") - 3)
    windows = F.sort_array(F.transform(at, lambda i: F.struct(F.get("_w", i).alias("a"), F.get("_w", i + 1).alias("b"), F.get("_w", i + 2).alias("c"), i.alias("i"))))
    again = F.size(F.array_distinct("_h")) < F.size("_h")
    sorted_ = counted.withColumn("_s", F.when(again, windows))

    def same(x: Column, y: Column) -> Column:
        return (x["a"] == y["a"]) & (x["b"] == y["b"]) & (x["c"] == y["c"])

    twice = F.transform("_s", lambda x, k: F.when(F.coalesce(same(x, F.get("_s", k - 1)), F.lit(False)) | F.coalesce(same(x, F.get("_s", k + 1)), F.lit(False)), x["i"]))
    starts = sorted_.withColumn("_p", F.sort_array(F.filter(twice, lambda i: i.isNotNull())))
    empty = F.struct(F.lit(0).alias("n"), F.lit(0).alias("upto"))
    covered = F.aggregate("_p", empty, lambda acc, p: F.struct((acc["n"] + p + 3 - F.greatest(acc["upto"], p)).alias("n"), (p + 3).alias("upto")))["n"]
    out = starts.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0))).drop("_w", "_l", "_h", "_s", "_p")
    return out.withColumns({c: F.col(c).cast("long") for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_lines", "n_upper", "n_repeat_words")})


MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper")


def failed_bits(rules: tuple[Rule, ...] = RULES) -> Column:
    bits = [F.when(r.fails(F.col), F.lit(1 << k)).otherwise(F.lit(0)).cast("long") for k, r in enumerate(rules)]
    out = bits[0]
    for b in bits[1:]:
        out = out.bitwiseOR(b)
    return out


def ledger(docs: DataFrame) -> DataFrame:
    """(doc_id, the measurements, failed): failed has bit k set where rule k fails."""
    return measured(docs.select("doc_id", "text")).select("doc_id", *MEASURES, failed_bits().alias("failed"))


def passes(mask: int) -> Column:
    return F.col("failed").bitwiseAND(F.lit(mask).cast("long")) == 0


def apply_policy(rows: DataFrame, version: int) -> DataFrame:
    """The ledger with kept: no rule of that policy version fails."""
    return rows.withColumn("kept", passes(POLICIES[version]))


def ablation(rows: DataFrame, version: int) -> DataFrame:
    """For each rule of a policy: n_failed, n_alone (rejected by it only, so kept without it) and n_kept_without."""
    mask = POLICIES[version]
    masks = rows.groupBy(F.col("failed").bitwiseAND(F.lit(mask).cast("long")).alias("bits")).agg(F.count("*").alias("n"))
    used = [(name, bit) for name, bit in BIT.items() if bit & mask]
    each = F.explode(F.array(*[F.struct(F.lit(name).alias("rule"), F.lit(bit).cast("long").alias("bit")) for name, bit in used])).alias("r")
    rest = F.col("bits").bitwiseAND(F.bitwise_not(F.col("r.bit")))
    counted = masks.select("bits", "n", each).groupBy("r.rule").agg(
        F.sum(F.when(F.col("bits").bitwiseAND(F.col("r.bit")) != 0, F.col("n")).otherwise(0)).alias("n_failed"),
        F.sum(F.when((rest == 0) & (F.col("bits") != 0), F.col("n")).otherwise(0)).alias("n_alone"),
        F.sum(F.when(rest == 0, F.col("n")).otherwise(0)).alias("n_kept_without"),
    )
    return counted


def filtered(docs: DataFrame, version: int) -> DataFrame:
    """The rows of docs that the policy keeps, with the columns of docs."""
    names = [f"c{k}" for k in range(len(docs.columns))]
    text = names[docs.columns.index("text")]
    rows = measured(docs.toDF(*names), text).withColumn("failed", failed_bits())
    # a generator of one row or none: a plain filter would be moved below the measures and hold each of them many times over
    once = F.explode(F.when(passes(POLICIES[version]), F.array(F.lit(1))).otherwise(F.array().cast("array<int>")))
    return rows.select(*names, once.alias("_once")).select(*names).toDF(*docs.columns)


#: The policy in production.
POLICY = 3


def op2_quality_rules(spark, sf_dir: str) -> DataFrame:
    rows = apply_policy(written(ledger(spark.read.parquet(f"{sf_dir}/documents.parquet")), "rule-ledger"), POLICY)
    base = ~passes(BASE)
    return rows.select("doc_id", *MEASURES, base.alias("base_failed"), "kept", "failed")


def rule_ablation(spark, sf_dir: str) -> DataFrame:
    """What each rule of the production policy costs, from the ledger alone."""
    return ablation(written(ledger(spark.read.parquet(f"{sf_dir}/documents.parquet")), "rule-ledger"), POLICY)


ORACLE = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, doc_id, t, [x FOR x IN string_split_regex(t, '[\\x20\\x09-\\x0D]+') IF x <> ''] AS ws,
  [x FOR x IN string_split(t, chr(10)) IF regexp_matches(x, '[^\\x20\\x09-\\x0D]')] AS ls FROM d),
g AS (SELECT r, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS s FROM (SELECT r, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
p AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, s) AS n FROM g) WHERE n > 1),
c AS (SELECT r, count(DISTINCT j) AS n FROM (SELECT r, unnest([i, i + 1, i + 2]) AS j FROM p) GROUP BY r),
m AS (SELECT w.doc_id, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
  length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
  coalesce(c.n, 0)::BIGINT AS n_repeat_words, len(ls)::BIGINT AS n_lines, length(regexp_replace(t, '\\P{Lu}', '', 'g'))::BIGINT AS n_upper
  FROM w LEFT JOIN c USING (r)),
f AS (SELECT *, ((n_words < 50)::BIGINT + 2 * (100 * n_repeat_words > 50 * n_words)::BIGINT + 4 * (100 * n_symbols > 30 * n_words)::BIGINT
  + 8 * (100 * n_dup_lines > 50 * n_lines)::BIGINT + 16 * (100 * n_upper > 40 * word_chars)::BIGINT
  + 32 * (word_chars < 2 * n_words OR word_chars > 20 * n_words)::BIGINT)::BIGINT AS failed FROM m)
SELECT *, (failed & 3) <> 0 AS base_failed, failed = 0 AS kept FROM f
"""
_EACH = ", ".join(f"('{name}', {bit})" for name, bit in BIT.items())
ABLATION_ORACLE = f"""WITH o AS ({ORACLE}), r AS (SELECT * FROM (VALUES {_EACH}) t(rule, bit))
SELECT rule, count(*) FILTER ((failed & bit) <> 0) AS n_failed, count(*) FILTER (failed = bit) AS n_alone, count(*) FILTER ((failed & ~bit) = 0) AS n_kept_without FROM o, r GROUP BY rule"""
