"""Exact top-k inner products by norm-sorted blocks.

Vectors are turned into integers and packed into blocks by descending length. A rotation from the
singular value decomposition of all vectors moves most of every vector's length into its first
coordinates: a partial sum over those, and Cauchy-Schwarz on the lengths of the two rests, bounds a
score from above. A block, and then a vector, is skipped once its bound is below the k-th score that
the query already has; scores themselves are exact integers: of 64 bits where the lengths of a query and a block allow it, of any size elsewhere.

Candidate blocks are numbered by descending length and dealt to groups of neighbours, so that a group's
longest vector bounds all that it holds. A query block is paired only with the groups whose bound reaches
the threshold of one of its queries; which those are is found by sorting thresholds among the groups' bounds by ranges,
before any vector is copied. No number of groups or blocks comes to the driver. There are two rounds: the thresholds start from the longest vectors (one block
of bounded size, sent to all tasks), the first round searches the LEAD longest groups, and the second
takes its thresholds from the first round's answers. What is copied grows with the pairs that survive.

Defined cases: vectors that are null or hold null, NaN or infinite components, and rows without
an id, take no part; a shorter vector counts as filled up with zeros; each repeated row is a
candidate, and a query for itself if its id says so; a query's own id is never its answer; ties go
to the smaller id; an empty table gives no rows. Components may have any finite size (those that scaling would make infinite count as the
largest double); the order is that of exact scores, and a score beyond 64 bits is given as the nearest 64-bit integer, with `exact` as a
key that orders such scores. Very long vectors only make blocks wider. Extra columns are ignored.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rolemesh.llm.common import ranked as places
from rolemesh.llm.common import running, written

#: Vectors in a block, blocks in a group of candidates, queries in a group.
BLOCK, GROUP_BLOCKS, QUERIES = 2048, 4, 4096
#: Products of lengths below this have 64-bit scores; components beyond LARGE don't weigh more in the rotation, and lengths beyond HUGE aren't bounded.
EXACT, LARGE, HUGE = float(1 << 62), 1e9, 1e140
#: The largest double, as an integer.
MOST = int(sys.float_info.max)
#: Rotated coordinates in a partial sum; groups of candidates in the first round.
HEAD, LEAD = 16, 8


def whole(x: Column) -> Column:
    """The greatest whole double not above x, at most the largest double."""
    held = F.greatest(F.lit(-sys.float_info.max), F.least(F.lit(sys.float_info.max), x))
    return F.when(F.abs(held) < float(1 << 53), F.floor(held).cast("double")).otherwise(held)  # beyond, all doubles are whole


def integers(table: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """(id, v): floor(scale * component) of every vector that takes part, as whole doubles (exact, as a double times a power of two is)."""
    v = F.col(vector_col)
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    return table.where(F.col(id_col).isNotNull() & v.isNotNull()).where(fine).select(F.col(id_col).cast("long").alias("id"), F.transform(v, lambda x: whole(F.lit(float(scale)) * x.cast("double"))).alias("v"))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows filled up with zeros to width."""
    flat, sizes = column.flatten().to_numpy(), np.diff(column.offsets.to_numpy())
    out = np.zeros((len(sizes), width))
    out[np.arange(width)[None, :] < sizes[:, None]] = flat
    return out


def rotation(vectors: DataFrame, width: int) -> np.ndarray:
    """Right singular vectors of all vectors, largest first, from the sum of their outer products (width x width numbers)."""

    def gram(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width))
        for batch in batches:
            x = np.clip(_matrix(batch.column("v"), width), -LARGE, LARGE)  # any axes will do: they decide what is skipped early
            total += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(width * width)), pa.array(total.ravel())], names=["k", "s"])

    rows = vectors.select("v").mapInArrow(gram, "k long, s double").groupBy("k").agg(F.sum("s").alias("s")).toPandas()
    total = np.zeros(width * width)
    total[rows["k"].to_numpy(dtype=np.int64)] = rows["s"].to_numpy(dtype=float)
    _, axes = np.linalg.eigh(total.reshape(width, width))
    return axes[:, ::-1]


def lengths(x: np.ndarray) -> np.ndarray:
    """Lengths of rows, infinite where squares are too large."""
    with np.errstate(over="ignore"):
        return np.sqrt((x**2).sum(axis=1))


def held(score: int) -> float:
    """The nearest double."""
    return float(max(min(score, MOST), -MOST))


def order_key(score: int) -> bytes | None:
    """Bytes in the order of scores, for those that 64 bits may not hold; others have none."""
    if abs(score) < 1 << 62:
        return None
    size = (score.bit_length() + 7) // 8
    plain = size.to_bytes(2, "big") + abs(score).to_bytes(size, "big")
    return b"\x01" + plain if score > 0 else b"\x00" + bytes(255 - x for x in plain)


def blocks(vectors: DataFrame, width: int, most: int) -> DataFrame:
    """(part, seq, n, top, ids, v): packed rows of each partition in its order; top is the largest length in the block."""
    names = ["part", "seq", "n", "top", "ids", "v"]
    types = [pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.binary(), pa.binary()]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq, ids, rows = TaskContext.get().partitionId(), 0, [], []

        def row(i: np.ndarray, x: np.ndarray) -> pa.RecordBatch:
            top = float(lengths(x).max())
            return pa.RecordBatch.from_arrays([pa.array([c], t) for c, t in zip((part, seq, len(i), top, i.tobytes(), x.tobytes()), types, strict=True)], names=names)

        for batch in batches:
            ids.append(batch.column("id").to_numpy())
            rows.append(_matrix(batch.column("v"), width))
            if sum(map(len, ids)) >= most:
                i, x = np.concatenate(ids), np.concatenate(rows)
                full = len(i) // most * most
                for k in range(0, full, most):
                    yield row(i[k : k + most], x[k : k + most])
                    seq += 1
                ids, rows = [i[full:]], [x[full:]]
        if ids and sum(map(len, ids)):
            yield row(np.concatenate(ids), np.concatenate(rows))

    return vectors.mapInArrow(pack, "part long, seq long, n long, top double, ids binary, v binary")


class Search:
    """Best k of some queries over blocks of candidates."""

    def __init__(self, ids: np.ndarray, v: np.ndarray, axes: np.ndarray, k: int, floor: np.ndarray):
        self.ids, self.v, self.axes, self.k = ids, v, axes, k
        self.head, self.rest, self.norm = self._turned(v)
        self.floor = floor.astype(float)  # k-th best score so far
        self.best = [(np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)) for _ in ids]

    def _turned(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        with np.errstate(all="ignore"):  # what overflows isn't bounded
            turned = v @ self.axes
            return turned[:, :HEAD], lengths(turned[:, HEAD:]), lengths(v)

    def lowest(self, at: np.ndarray | int) -> np.ndarray:
        """What a score must reach, as thresholds are rounded."""
        return self.floor[at] - np.abs(np.where(np.isfinite(self.floor[at]), self.floor[at], 0)) * 1e-12 - 1

    def over(self, ids: np.ndarray, v: np.ndarray, top: float) -> None:
        """One block."""
        with np.errstate(all="ignore"):
            alive = np.flatnonzero(~(self.norm * top * (1 + 1e-9) + 1 < self.lowest(slice(None))))
        if not len(alive):
            return
        head, rest, norm = self._turned(v)
        for a in range(0, len(alive), 256):
            q = alive[a : a + 256]
            with np.errstate(all="ignore"):
                bound = self.head[q] @ head.T + self.rest[q][:, None] * rest[None, :]
                bound += 1e-9 * self.norm[q][:, None] * norm[None, :] + 1  # more than the rounding of the rotation
                bound[(self.norm[q][:, None] > HUGE) | (norm[None, :] > HUGE)] = np.inf
            for row, at in enumerate(q):
                self._keep(at, ids, v, np.flatnonzero(bound[row] >= self.lowest(at)), top)

    def _keep(self, at: int, ids: np.ndarray, v: np.ndarray, near: np.ndarray, top: float) -> None:
        near = near[ids[near] != self.ids[at]]
        if not len(near):
            return
        if self.norm[at] * top < EXACT and max(self.norm[at], top) < EXACT:
            score = v[near].astype(np.int64) @ self.v[at].astype(np.int64)
        else:
            own = [int(x) for x in self.v[at]]
            score = np.array([sum(a * int(x) for a, x in zip(own, row, strict=True)) for row in v[near]], dtype=object)
        above = (np.array([held(s) for s in score]) if score.dtype == object else score) >= self.lowest(at)
        scores, found = (np.concatenate(x) for x in zip(self.best[at], (score[above], ids[near][above]), strict=True))
        order = np.array(sorted(range(len(scores)), key=lambda i: (-scores[i], found[i]))[: self.k], dtype=np.int64) if scores.dtype == object else np.lexsort((found, -scores))[: self.k]
        self.best[at] = scores[order], found[order]
        if len(order) == self.k:
            kth = scores[order[-1]]
            self.floor[at] = max(self.floor[at], held(int(kth)))


def _unpacked(row, width: int) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(row.ids, dtype=np.int64), np.frombuffer(row.v, dtype=float).reshape(-1, width)


def needed(search: Search) -> float:
    """The length that a vector must have to reach any threshold of a query block."""
    low = search.lowest(slice(None))
    with np.errstate(all="ignore"):
        need = np.where(search.norm > 0, (low - 1) / np.maximum(search.norm * (1 + 1e-9), 1e-300), np.where(low > 0, np.inf, -np.inf))
    return float(np.where(np.isnan(need), -np.inf, need).min()) if len(need) else np.inf


def top_k(table: DataFrame, is_query: Column, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 1024) -> DataFrame:
    """(query_id, rank, vec_id, score, exact) of each query row's k best candidates. is_query is a condition on a column `id`."""
    spark = table.sparkSession
    vectors = integers(table, id_col, vector_col, scale)
    width = max(1, vectors.agg(F.max(F.size("v"))).first()[0] or 1)
    axes = rotation(vectors, width)
    length = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = vectors.withColumn("length", length).repartitionByRange(parts, F.col("length").desc(), "id").sortWithinPartitions(F.col("length").desc(), "id").select("id", "v")
    packed = written(blocks(ordered, width, BLOCK), "vector-blocks")
    asked = written(blocks(vectors.where(is_query), width, min(QUERIES, BLOCK)), "query-blocks")
    longest = packed.orderBy(F.col("top").desc(), "part", "seq").limit(1).collect()  # one block
    # parts are in descending order of length, and so are the blocks of a part
    numbered = written(places(packed.select("part", "seq", "top"), "block-places", "part", "seq").select("part", "seq", "top", F.floor(F.col("id") / GROUP_BLOCKS).alias("g")), "block-groups")
    groups = written(numbered.groupBy("g").agg(F.max("top").alias("top")), "group-tops")
    n_groups = groups.count()
    grouped = packed.join(numbered.select("part", "seq", "g"), ["part", "seq"])

    def floors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            frame, out, need = batch.to_pandas(), [], []
            for row in frame.itertuples():
                known = np.frombuffer(row.floor, dtype=float) if row.floor is not None else np.full(row.n, -np.inf)
                search = Search(*_unpacked(row, width), axes, k, known.copy())
                if row.floor is None:
                    for other in longest:
                        search.over(*_unpacked(other, width), other.top)
                out.append(search.floor.tobytes())
                need.append(needed(search))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], pa.array(out, pa.binary()), pa.array(need, pa.float64())], names=[*names, "floor", "need"])

    names = ["part", "seq", "n", "top", "ids", "v"]
    told = "part long, seq long, n long, top double, ids binary, v binary, floor binary"

    def begin(queries: DataFrame) -> DataFrame:
        """Query blocks with their thresholds and `upto`: how many of the first groups they must see, by their needs' places among the groups' longest lengths."""
        begun = written(queries.mapInArrow(floors, told + ", need double"), "query-floors")
        none = F.lit(None).cast("long")
        bounds = groups.select("top", F.lit(0).alias("asks"), (F.col("g") + 1).alias("g"), none.alias("part"), none.alias("seq"))
        needs = begun.select("need", F.lit(1), none, "part", "seq")
        seen = running(bounds.union(needs), "needs", [F.col("top").desc(), F.col("asks"), F.col("part"), F.col("seq")], upto=(F.max, F.col("g"))).where("asks = 1")
        return written(begun.drop("need").join(seen.select("part", "seq", F.coalesce("upto", F.lit(0)).alias("upto")), ["part", "seq"]), "query-groups")

    def search(queries: pd.DataFrame, candidates: pd.DataFrame) -> pd.DataFrame:
        out = []
        candidates = candidates.sort_values("top", ascending=False)
        for row in queries.itertuples():
            found = Search(*_unpacked(row, width), axes, k, np.frombuffer(row.floor, dtype=float).copy())
            for other in candidates.itertuples():
                found.over(*_unpacked(other, width), other.top)
            for at, (scores, ids) in enumerate(found.best):
                near, keys = [max(min(int(s), (1 << 63) - 1), -(1 << 63)) for s in scores], [order_key(int(s)) for s in scores]
                out.append(pd.DataFrame({"part": row.part, "seq": row.seq, "at": at, "query_id": found.ids[at], "vec_id": ids, "score": pd.Series(near, dtype="int64"), "exact": pd.Series(keys, dtype="object")}))
        return pd.concat(out) if out else pd.DataFrame({c: pd.Series(dtype="object" if c == "exact" else "int64") for c in ("part", "seq", "at", "query_id", "vec_id", "score", "exact")})

    def answers(begun: DataFrame, first: int, last: int) -> DataFrame:
        """Best k of each query over the groups from first to last that its block must see."""
        ends = F.least(F.col("upto"), F.lit(last)) - 1
        shares = max(1, -(-begun.count() * min(QUERIES, BLOCK) // QUERIES))  # a group meets the query blocks in shares of about QUERIES queries
        share = F.pmod(F.xxhash64("part", "seq"), F.lit(shares)).cast("int").alias("h")
        left = begun.where(ends >= first).select("*", share, F.explode(F.sequence(F.lit(first).cast("long"), ends.cast("long"))).alias("g"))
        wanted = written(left.select("g", "h").distinct(), "block-pairs")  # a group is copied to the shares that must see it
        right = grouped.where(F.col("g").between(first, last - 1)).join(wanted, "g")
        return left.groupBy("g", "h").cogroup(right.groupBy("g", "h")).applyInPandas(search, "part long, seq long, at long, query_id long, vec_id long, score long, exact binary")

    best = Window.partitionBy("part", "seq", "at").orderBy(F.col("score").desc(), F.col("exact").desc(), "vec_id")

    def ranked(rows: DataFrame) -> DataFrame:
        return rows.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)

    answered = ("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score", "exact")
    begun = begin(asked.withColumn("floor", F.lit(None).cast("binary")).select(*names, "floor"))
    lead = written(ranked(answers(begun, 0, min(LEAD, n_groups))).drop("rank"), "first-answers")
    if n_groups <= LEAD:
        return ranked(lead).select(*answered)
    # the k-th score of each query so far: of the longest block (in begun) or of the first round, whichever is higher
    kth = ranked(lead).where(F.col("rank") == k).groupBy("part", "seq").agg(F.collect_list(F.struct("at", "score")).alias("kth"))  # BLOCK entries at most

    def raised(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for floor, found in zip(batch.column("floor").to_pylist(), batch.column("kth").to_pylist(), strict=True):
                x = np.frombuffer(floor, dtype=float).copy()
                for y in found or []:
                    x[y["at"]] = max(x[y["at"]], y["score"])
                out.append(x.tobytes())
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], pa.array(out, pa.binary())], names=[*names, "floor"])

    again = begun.drop("upto").join(kth, ["part", "seq"], "left").select(*names, "floor", "kth").mapInArrow(raised, told)
    rest = answers(begin(again), LEAD, n_groups)
    return ranked(lead.union(rest)).select(*answered)


def op9_exact_topk(spark, sf_dir: str) -> DataFrame:
    return top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("id") % 100 == 0).drop("exact")


ORACLE = """
WITH v AS (SELECT vec_id, [floor(1024 * x::DOUBLE)::BIGINT FOR x IN embedding] AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.e, c.e), lambda z: z[1] * z[2]))::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 10
"""
