"""Mixing sources to target weights by Pfair scheduling.

Each source's documents form a stream that is cut into blocks of `block_units`. With weight w out
of Q (the sum of all weights), block j of a source is released at floor(j * Q / w) and due at
ceil((j + 1) * Q / w); the released block with the earliest deadline goes next. Since the weights fill
the single output exactly, every deadline is met, and at any time a source has had its share to
within less than one block. The schedule repeats every Q blocks, so one period, computed from the
weights alone, places every block of any corpus by arithmetic. When a source runs out, a new phase
begins with the weights of the others: nothing is dropped or repeated.

Documents are placed in their stream by the hash of their doc_id and text, in two levels: hash ranges
inside each source, whose totals are summed first, then order inside a range. A source with a third of
all rows, or very many rows without a doc_id, are as finely divided as their rows demand; only rows that
agree in both doc_id and text stay together.

With `apart`, each source that the weights don't name has a stream of its own inside OTHER. OTHER's turns go round among those that
still have blocks, so that each has its equal part of them to within less than one block, as Pfair gives equal weights. Where a
round begins follows from how many blocks all of them have: the sources are ranked, and rounds are found, by sorting ranges.
The driver holds the schedule of the weights that it was given, and nothing for each source.

Defined cases: without `apart`, sources that the weights don't name, and null ones, form one stream OTHER together;
with it, null ones and those called OTHER are one of the unnamed;
a weight of 0 or a source without rows takes no part; sources of which only such weights are left
follow at the end; null and empty texts count one unit, and a very long text as many blocks as it fills, all in its first one's place;
repeated rows are each placed, next to each other; an empty table gives no rows. Columns of docs may have any names.
"""

from __future__ import annotations

from heapq import heapify, heappop, heappush

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rolemesh.llm.common import ranked, running, written

OTHER = "other"
#: About so many rows are ordered together.
RANGE_ROWS = 5_000


def period(weights: dict[str, int]) -> dict[str, list[int]]:
    """For each source, the places of its blocks in one period of sum(weights) places, by earliest deadline among the released."""
    q, places = sum(weights.values()), {s: [] for s in weights}
    waiting, ready = [(0, s) for s, w in weights.items() if w > 0], []  # the next block of each source: (release, source), (deadline, source)
    heapify(waiting)
    for t in range(q):
        while waiting and waiting[0][0] <= t:
            _, s = heappop(waiting)
            heappush(ready, (-(-(len(places[s]) + 1) * q // weights[s]), s))
        _, s = heappop(ready)
        places[s].append(t)
        if len(places[s]) < weights[s]:
            heappush(waiting, (len(places[s]) * q // weights[s], s))
    return places


def phases(weights: dict[str, int], blocks: dict[str, int]) -> list[dict]:
    """Runs of blocks between which a source runs out: rows of (source, first, last, base, period, weight, places)."""
    left = {s: n for s, n in blocks.items() if n > 0}
    done, base, out = dict.fromkeys(left, 0), 0, []
    while left:
        active = {s: weights.get(s, 0) for s in left if weights.get(s, 0) > 0} or dict.fromkeys(left, 1)
        q, places = sum(active.values()), period(active)
        ends = {s: (left[s] - 1) // w * q + places[s][(left[s] - 1) % w] + 1 for s, w in active.items()}
        length = min(ends.values())
        for s, w in active.items():
            used = length // q * w + sum(p < length % q for p in places[s])
            if used:
                out.append({"source": s, "first": done[s], "last": done[s] + used - 1, "base": base, "period": q, "weight": w, "places": places[s]})
            done[s] += used
            left[s] -= used
        base += length
        left = {s: n for s, n in left.items() if n > 0}
    return out


def rounds(blocks: DataFrame, streams: DataFrame) -> DataFrame:
    """blocks (stream, block) with `turn`: their places when streams (stream, blocks) take turns, a block each, as long as they have any."""
    sized = ranked(streams, "stream-ranks", F.desc("blocks"), "stream").select("stream", "blocks", F.col("id").alias("rank"))  # those with a block left come first
    n = streams.count()
    events = streams.select(F.col("blocks").alias("at"), F.lit(0).alias("asks"), F.lit(1).cast("long").alias("over"), F.col("blocks").alias("used"), "stream")
    asked = blocks.select("block").distinct().select(F.col("block").alias("at"), F.lit(1), F.lit(0).cast("long"), F.lit(0).cast("long"), F.lit(None).cast("string"))
    upto = running(events.union(asked), "rounds", [F.col("at"), F.col("asks"), F.col("stream")], gone=(F.sum, F.col("over")), spent=(F.sum, F.col("used"))).where("asks = 1")
    begins = upto.select(F.col("at").alias("block"), (F.col("spent") + F.col("at") * (F.lit(n) - F.col("gone"))).alias("begins"))  # blocks of all streams in the rounds before
    return blocks.join(begins, "block").join(sized.select("stream", "rank"), "stream").select("stream", "block", (F.col("begins") + F.col("rank")).alias("turn"))


def scheduled(docs: DataFrame, weights: dict[str, int], block_units: int, units: Column, apart: bool = False) -> DataFrame:
    """docs with `_class` (its stream: a weight's name, or with `apart` the source), `_block`, `_slot` (place of its block in the mix) and `_start` (units before it in its stream).

    docs needs doc_id and source; units is the size of a row. Rows of one doc_id are told apart by `_hash`, a hash of their content (of text if there is no such column).
    """
    spark = docs.sparkSession
    named = [s for s in weights if s != OTHER]
    docs = docs if "_hash" in docs.columns else docs.withColumn("_hash", F.xxhash64("text") if "text" in docs.columns else F.lit(0).cast("long"))
    place = F.xxhash64("doc_id", "_hash")
    known = F.col("source").isin(named)
    stream = F.coalesce("source", F.lit(OTHER)) if apart else F.when(known, F.col("source")).otherwise(F.lit(OTHER))
    rows = docs.withColumns({"_weight": F.when(known, F.col("source")).otherwise(F.lit(OTHER)), "_class": stream, "_units": F.greatest(F.lit(1), F.coalesce(units, F.lit(1))).cast("long"), "_place": place})
    n = max(1, -(-docs.count() // RANGE_ROWS))
    rows = rows.withColumn("_range", F.floor((F.shiftrightunsigned("_place", 33) * F.lit(n)) / F.lit(float(2**31))).cast("long"))
    totals = written(rows.groupBy("_weight", "_class", "_range").agg(F.sum("_units").alias("total")), "range-totals")
    before = Window.partitionBy("_class").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    bases = totals.select("_class", "_range", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("_base"))
    streams = totals.groupBy("_weight", F.col("_class").alias("stream")).agg(F.ceil(F.sum("total") / block_units).cast("long").alias("blocks"))
    inside = Window.partitionBy("_class", "_range").orderBy("_place", "doc_id", "_hash").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("_within", F.coalesce(F.sum("_units").over(inside), F.lit(0))).join(bases, ["_class", "_range"])
    placed = placed.withColumn("_start", F.col("_base") + F.col("_within")).withColumn("_block", F.floor(F.col("_start") / block_units).cast("long"))
    plan = phases(weights, {r["_weight"]: r["blocks"] for r in streams.groupBy("_weight").agg(F.sum("blocks").alias("blocks")).collect()})  # a row for each weight
    schema = "source string, first long, last long, base long, period long, weight long, places array<long>"
    table = spark.createDataFrame([tuple(p.values()) for p in plan], schema)  # at most the square of the number of weights given
    placed = placed.withColumn("_turn", F.col("_block"))
    if apart:
        ours = F.col("_weight") == OTHER
        blocks = written(placed.where(ours).select(F.col("_class").alias("stream"), F.col("_block").alias("block")).distinct(), "blocks")
        turns = rounds(blocks, written(streams.where(ours).select("stream", "blocks"), "streams")).select(F.col("stream").alias("_class"), F.col("block").alias("_block"), F.lit(OTHER).alias("_weight"), F.col("turn").alias("_own"))
        placed = placed.join(turns, ["_class", "_block", "_weight"], "left").withColumn("_turn", F.coalesce("_own", "_turn")).drop("_own")
    joined = placed.join(F.broadcast(table.withColumnsRenamed({c: f"_p_{c}" for c in table.columns})), (F.col("_weight") == F.col("_p_source")) & F.col("_turn").between(F.col("_p_first"), F.col("_p_last")))
    k = F.col("_turn") - F.col("_p_first")
    slot = F.col("_p_base") + F.floor(k / F.col("_p_weight")) * F.col("_p_period") + F.get("_p_places", (k % F.col("_p_weight")).cast("int"))
    return joined.withColumn("_slot", slot.cast("long")).drop("_units", "_hash", "_place", "_range", "_within", "_base", "_weight", "_turn", *[f"_p_{c}" for c in table.columns])


def mixed(docs: DataFrame, weights: dict[str, int], block_units: int, apart: bool = False) -> DataFrame:
    """docs in mixed order, columns as given: range-partitioned and sorted by place, so that files written from it hold the mix in order."""
    names = [f"c{k}" for k in range(len(docs.columns))]
    of = {c: names[docs.columns.index(c)] for c in ("doc_id", "source", "text")}
    plain = docs.toDF(*names).withColumns({"doc_id": F.col(of["doc_id"]), "source": F.col(of["source"]), "_hash": F.xxhash64(of["text"])})
    rows = scheduled(plain, weights, block_units, F.length(of["text"]), apart)
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartitionByRange(parts, "_slot", "_start").sortWithinPartitions("_slot", "_start", "doc_id").select(*names).toDF(*docs.columns)


#: Target weights of the sources in production, in twentieths (OTHER: of all others together), and characters in a block.
WEIGHTS = {"src0": 4, "src1": 3, "src2": 2, "src3": 2, OTHER: 9}
BLOCK_CHARS = 100_000


def op3_mixing(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", F.length("text").alias("n"), F.xxhash64("text").alias("_hash"))
    rows = scheduled(docs, WEIGHTS, BLOCK_CHARS, F.col("n"), apart=True)
    return rows.select("doc_id", F.col("_class").alias("source_class"), F.col("_block").alias("block"), F.col("_slot").alias("slot"), F.col("_start").alias("units_before"))
