"""N-gram Jaccard join by set-relation skipping.

A text's set holds its word n-grams. Equal sets are one class, found by a 128-bit fingerprint and the size; a
class has an id of its own, so that no two are ever taken for one by a shorter hash.

*Index lists by position.* The ordered universe of hashed n-grams is cut into blocks. Two sets within
the threshold differ in at most d elements, so of d + 1 (and a few more) blocks at least one holds
the same elements in both: a set is listed under the content of each block, and lists are read
only where a whole block agrees; all other positions are skipped. Block counts depend on the size
class, and a set is listed in its own class and in that below, so no pair of sizes is missed.

*Answers from a highly similar set.* In each list the least set is the leader. Every set is
verified against the leader with which it shares most lists, and joined to its component. Lists whose
sets are then all in one component hold no further news. In the others, the sets outside the main
component are compared with all sets of the list without intersecting them anew: a member's overlap
with x follows from the leader's overlap with x, corrected by the few elements in which member and
leader differ, and is skipped unread where the leader's answer already bounds it below the threshold.

*Sketches before sets.* A set's sketch has 2 to 4 bits an element, each the parity of the elements hashed
to it, so two sketches differ in no more bits than their sets differ in elements. Pairs whose sketches
differ too much are passed over for certain, and only sets of the other pairs are read: unlike texts that
share a passage cost a sketch, not a set.

Components are exact: a link between sets of different components would share a list, and every
such pair is decided. Within a component not every link is listed.

Nothing about whole documents reaches the driver, and no group is taken whole: list rows are dealt by
hash, hot leaders are joined by Spark's skew-aware join, and comparisons run in chunks of CHUNK x CHUNK
sets or SKETCHED x SKETCHED sketches.

Defined cases: texts without words (null, empty, blank) have no n-grams and no links; with fewer
words than n, the whole sequence is the one n-gram; repeated rows and repeated doc_ids are rows of
their own; null doc_ids take part and are never a component's id unless there is no other (then it
is null), and the least 64-bit integer is taken for a null one; a very long text is one set, read whole; an empty table gives no rows. Extra columns are ignored, or kept by `deduplicated`.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rolemesh.llm.common import hashes, mix, slices, split_words, texts, written

#: Entries of index lists held by a task before they are handed on; sets, and sketches, in a chunk of comparisons.
HELD, CHUNK, SKETCHED = 1_500_000, 256, 2048
#: Documents for each bucket of lists, and sets that a task remembers to list once.
BUCKET_DOCS, LISTED = 20_000, 200_000
#: Up to so many ids (8 bytes each) are broadcast to pick texts; beyond that the texts are shuffled.
MOST_IDS = 2_000_000
NO_ID = -(2**63)
LOW48 = 2**48 - 1


def shingle_sets(array: pa.Array, n_words: int) -> tuple[np.ndarray, np.ndarray]:
    """The hashed n-gram set of each text: sizes, and all elements, ascending within a text."""
    coded, counts = split_words(array)
    seq = hashes(coded.dictionary)[coded.indices.to_numpy()]
    ends = np.cumsum(counts)
    h = np.zeros(max(0, len(seq) - n_words + 1), dtype=np.uint64)
    for k in range(n_words):
        h = mix(h + seq[k : k + len(h)])
    out = []
    for end, n in zip(ends.tolist(), counts.tolist(), strict=True):
        if n >= n_words:
            out.append(np.unique(h[end - n : end - n_words + 1]))
        elif n:
            one = np.zeros(1, dtype=np.uint64)
            for k in range(end - n, end):
                one = mix(one + seq[k])
            out.append(mix(one + np.uint64(n)))  # a short text equals only texts with the same words
        else:
            out.append(np.zeros(0, dtype=np.uint64))
    return np.fromiter(map(len, out), dtype=np.int64, count=len(out)), np.concatenate(out) if out else np.zeros(0, dtype=np.uint64)


@cache
def size_classes(percent: int, upto: int) -> np.ndarray:
    """Lower bounds of size classes; sets within the threshold are in the same or in neighbouring classes."""
    bounds = [1]
    while bounds[-1] <= upto:
        bounds.append(max(bounds[-1] + 1, -(-bounds[-1] * 100 // percent)))
    return np.array(bounds, dtype=np.int64)


def listed(sizes: np.ndarray, elements: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """(set number, list key) for every list a set stands in."""
    bounds = size_classes(percent, 1 << int(max(1, sizes.max(initial=1))).bit_length())
    own = np.searchsorted(bounds, sizes, side="right") - 1
    of = np.repeat(np.arange(len(sizes)), sizes)
    mixed = mix(elements ^ np.uint64(0x5851F42D4C957F2D))
    sets, keys = [], []
    for down in (0, 1):
        family = own - down
        there = (sizes > 0) & (family >= 0)
        largest = bounds[np.clip(family + 1, 0, len(bounds) - 1)] - 1
        differ = (100 - percent) * (largest + largest * 100 // percent) // (100 + percent)
        there &= differ > 0  # otherwise only equal sets are near enough
        spare = np.maximum(2, -(-differ // 8))
        blocks = np.where(there, differ + 1 + spare, 1)
        keep = there[of]
        o, e = of[keep], mixed[keep]
        if not len(o):
            continue
        block = ((elements[keep] >> np.uint64(32)) * blocks[o].astype(np.uint64)) >> np.uint64(32)
        first = np.flatnonzero(np.concatenate([[True], (o[1:] != o[:-1]) | (block[1:] != block[:-1])]))
        content = np.add.reduceat(e, first)
        place = mix(family[o[first]].astype(np.uint64) * np.uint64(0x1_0000_0001) + block[first])
        sets.append(o[first])
        keys.append(mix(content + place))
        empty = blocks - np.bincount(o[first], minlength=len(sizes))
        for s in np.flatnonzero(there & (empty > spare)):  # rare: agreeing blocks may all be empty ones
            have = block[start_of(o, s)].astype(np.int64)
            none = np.setdiff1d(np.arange(blocks[s]), have)
            sets.append(np.full(len(none), s))
            keys.append(mix(mix(np.uint64(family[s]) * np.uint64(0x1_0000_0001) + none.astype(np.uint64)) + np.uint64(1)))
    return (np.concatenate(sets), np.concatenate(keys)) if sets else (np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64))


def start_of(sorted_of: np.ndarray, s: int) -> slice:
    return slice(*np.searchsorted(sorted_of, [s, s + 1]))


def fingerprints(sizes: np.ndarray, elements: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit sums of each set, as signed integers."""
    ends = np.concatenate([[0], np.cumsum(sizes)])
    out = []
    for salt in (0x2545F4914F6CDD1D, 0xD1342543DE82EF95):
        sums = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(mix(elements ^ np.uint64(salt)), dtype=np.uint64)])
        out.append(mix((sums[ends[1:]] - sums[ends[:-1]]) + sizes.astype(np.uint64)).view(np.int64))
    return out[0], out[1]


def sketches(sizes: np.ndarray, elements: np.ndarray) -> list[bytes]:
    """Each set's sketch: bit k is the parity of the elements hashed to k, in a power of two of at least twice the size (256 bits at least)."""
    widths = np.maximum(256, 1 << np.ceil(np.log2(np.maximum(2 * sizes, 1))).astype(np.int64))
    ends = np.cumsum(widths)
    at = mix(elements ^ np.uint64(0x9FB21C651E98DF25)).view(np.int64) & np.repeat(widths - 1, sizes)
    bits = np.bincount(at + np.repeat(ends - widths, sizes), minlength=int(widths.sum())).astype(np.uint8) & 1
    data = np.packbits(bits, bitorder="little").tobytes()
    return [data[(e - w) // 8 : e // 8] for e, w in zip(ends.tolist(), widths.tolist(), strict=True)]


def folded(words: np.ndarray, n_words: int) -> np.ndarray:
    """Sketches (one a row, 64-bit words) as they were in a narrower width: places that agree modulo the width fall together."""
    return np.bitwise_xor.reduce(words.reshape(*words.shape[:-1], -1, n_words), axis=-2)


class SketchIndex:
    """Sketches by size; `near_to` gives the numbers of those that may be within the threshold of another (none that is is missed)."""

    def __init__(self, sizes: np.ndarray, packed: list[bytes], percent: int) -> None:
        self.percent, self.order = percent, np.argsort(sizes, kind="stable")
        self.sizes, self.classes, first = sizes[self.order], [], 0
        lengths = np.array([len(packed[k]) for k in self.order])
        for last in [*(np.flatnonzero(np.diff(lengths)) + 1).tolist(), len(lengths)]:
            if last > first:
                self.classes.append((first, last, np.frombuffer(b"".join(packed[k] for k in self.order[first:last]), dtype=np.uint64).reshape(last - first, -1)))
            first = last

    def near_to(self, size: int, packed: bytes) -> np.ndarray:
        own, found = np.frombuffer(packed, dtype=np.uint64), []
        lo, hi = np.searchsorted(self.sizes, [-(-size * self.percent // 100), size * 100 // self.percent + 1])
        for first, last, words in self.classes:
            a, b = max(first, lo), min(last, hi)
            if a < b:
                width = min(words.shape[1], len(own))
                apart = np.bitwise_count(folded(words[a - first : b - first], width) ^ folded(own, width)).sum(axis=1, dtype=np.int64)
                found.append(a + np.flatnonzero(apart * (100 + self.percent) <= (100 - self.percent) * (self.sizes[a:b] + size)))
        return self.order[np.concatenate(found)] if found else np.zeros(0, dtype=np.int64)


def _pack48(x: np.ndarray) -> bytes:
    return np.ascontiguousarray(x.astype("<u8")).view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def _unpack48(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // 6, 8), dtype=np.uint8)
    out[:, :6] = np.frombuffer(data, dtype=np.uint8).reshape(-1, 6)
    return out.view("<u8").ravel()


def sets_and_stars(docs: DataFrame, n_words: int, percent: int, fingerprint: Callable = fingerprints) -> DataFrame:
    """One table of two kinds of rows: documents (doc_id, row, row2, n, fp1, fp2), and stars (leader, member, k) of 48-bit set keys that share k lists.

    docs has doc_id, text, row and row2 (numbers for its content). A task lists a set once, however many of its texts have it. List entries are
    handed on as packed bytes, dealt by the hash of the list over buckets whose number follows that of the documents.
    """
    buckets = max(4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-docs.count() // BUCKET_DOCS))
    names, types = ["bucket", "a", "b", "docs"], [pa.int64(), pa.binary(), pa.binary(), pa.binary()]

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        seen: set[tuple[int, int, int]] = set()

        def flush() -> pa.RecordBatch:
            keys, ids = (np.concatenate(x) for x in zip(*held, strict=True))
            bucket = (keys % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            cuts = np.flatnonzero(np.diff(bucket[order])) + 1
            keys, ids, bucket = (keys // np.uint64(buckets))[order], ids[order], bucket[order]
            at = [0, *cuts.tolist(), len(order)] if len(order) else [0]
            rows = [(int(bucket[a]), _pack48(keys[a:b]), _pack48(ids[a:b]), None) for a, b in zip(at, at[1:], strict=False)]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 4, types, strict=True)], names=names)

        for batch in batches:
            for part in slices(batch):
                sizes, elements = shingle_sets(texts(part), n_words)
                fp1, fp2 = fingerprint(sizes, elements)
                doc = part.column("doc_id").cast(pa.int64()).fill_null(NO_ID).to_numpy()
                row, row2 = (part.column(c).to_numpy() for c in ("row", "row2"))
                told = np.stack([doc, row, row2, sizes, fp1, fp2]).astype("<i8").tobytes()
                where = int(np.abs(row[0]) % buckets)
                yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((where, None, None, told), types, strict=True)], names=names)
                new = np.zeros(len(sizes), dtype=bool)
                for k, of in enumerate(zip(fp1.tolist(), fp2.tolist(), sizes.tolist(), strict=True)):
                    if of not in seen:
                        seen.add(of)
                        new[k] = True
                if len(seen) > LISTED:
                    seen.clear()
                sets, keys = listed(sizes[new], elements[np.repeat(new, sizes)], percent)
                sets = np.flatnonzero(new)[sets]
                held.append((keys, fp1.view(np.uint64)[sets] & np.uint64(LOW48)))
                if sum(len(k) for k, _ in held) >= HELD:
                    yield flush()
                    held = []
        if held:
            yield flush()

    columns = ["doc_id", "row", "row2", "n", "fp1", "fp2", "leader", "member", "k"]

    def rows_of(values: np.ndarray, first: int) -> pa.Table:
        none = pa.nulls(values.shape[1], pa.int64())
        return pa.table([pa.array(values[k - first]) if first <= k < first + len(values) else none for k in range(len(columns))], names=columns)

    def read(bucket: pa.Table) -> pa.Table:
        out = [rows_of(np.frombuffer(told, dtype="<i8").reshape(6, -1), 0) for told in bucket.column("docs").drop_null().to_pylist()]
        keys, ids = (_unpack48(b"".join(bucket.column(c).drop_null().to_pylist())) for c in ("a", "b"))
        if len(keys):
            order = np.lexsort((ids, keys))
            keys, ids = keys[order], ids[order]
            new = np.concatenate([[True], keys[1:] != keys[:-1]])
            leader = ids[np.maximum.accumulate(np.where(new, np.arange(len(keys)), 0))]
            leader, ids = leader[leader != ids], ids[leader != ids]
            order = np.lexsort((ids, leader))
            leader, ids = leader[order], ids[order]
            new = np.flatnonzero(np.concatenate([[True], (leader[1:] != leader[:-1]) | (ids[1:] != ids[:-1])])[: len(ids)])
            out.append(rows_of(np.stack([leader[new], ids[new], np.diff([*new, len(ids)])]).astype(np.int64), 6))
        return pa.concat_tables(out)

    packed = docs.select("doc_id", "text", "row", "row2").mapInArrow(index, "bucket long, a binary, b binary, docs binary")
    return packed.groupBy("bucket").applyInArrow(read, ", ".join(f"{c} long" for c in columns))


def tokens_of(docs: DataFrame, n_words: int, sketched: bool = False, fingerprint: Callable = fingerprints) -> DataFrame:
    """(fp1, fp2, n, tokens) of each row: the set's elements, ascending unsigned 64-bit integers, as bytes; or (fp1, fp2, n, sketch)."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                sizes, elements = shingle_sets(texts(part), n_words)
                if sketched:
                    held = sketches(sizes, elements)
                else:
                    data, ends = elements.tobytes(), (8 * np.cumsum(sizes)).tolist()
                    held = [data[e - 8 * n : e] for e, n in zip(ends, sizes.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([*map(pa.array, fingerprint(sizes, elements)), pa.array(sizes), pa.array(held, pa.binary())], names=["fp1", "fp2", "n", name])

    name = "sketch" if sketched else "tokens"
    return docs.select("text").mapInArrow(make, f"fp1 long, fp2 long, n long, {name} binary")


def of_sets(docs: DataFrame, sets: DataFrame, n_words: int, sketched: bool = False, fingerprint: Callable = fingerprints) -> DataFrame:
    """(id, n, tokens or sketch) of the sets (id, fp1, fp2, n, a_row), from the texts of their rows: a written table with a row for each set."""
    ids = sets.select(F.col("a_row").alias("row"))
    picked = docs.select("row", "text").join(F.broadcast(ids) if ids.count() <= MOST_IDS else ids, "row", "left_semi")
    made = tokens_of(picked, n_words, sketched, fingerprint).join(sets.select("id", "fp1", "fp2", "n"), ["fp1", "fp2", "n"]).drop("fp1", "fp2")
    return written(made.dropDuplicates(["id"]), "sketches" if sketched else "tokens")


def near(overlap, a, b, percent: int):
    return 100 * overlap >= percent * (a + b - overlap)


def maybe_near(pairs: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of columns a, b, na, nb, sa, sb whose sketches don't rule out that their sets are within the threshold."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("na", "nb", "sa", "sb")]
            keep = [bool(len(SketchIndex(np.array([m]), [p], percent).near_to(n, q))) for m, n, p, q in zip(*columns, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(pa.array(keep, pa.bool_())) for c in ("a", "b")], names=["a", "b"])

    return pairs.select("a", "b", "na", "nb", "sa", "sb").mapInArrow(check, "a long, b long")


def verified(pairs: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of columns a, b, ta, tb whose token sets are within the threshold."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (batch.column(c).to_pylist() for c in ("ta", "tb"))
            keep = []
            for p, q in zip(x, y, strict=True):
                s, t = np.frombuffer(p, dtype=np.uint64), np.frombuffer(q, dtype=np.uint64)
                keep.append(bool(near(len(np.intersect1d(s, t, assume_unique=True)), len(s), len(t), percent)))
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(pa.array(keep, pa.bool_())) for c in ("a", "b")], names=["a", "b"])

    return pairs.select("a", "b", "ta", "tb").mapInArrow(check, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the edges (a, b), by alternating large-star and small-star steps, each cut off from its lineage by a written table."""
    now = written(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "edges")
    before = None
    while True:
        size = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()[:]
        if size == before:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(now.select("b", "b").distinct())
        before = size
        both = now.union(now.select("b", "a"))
        least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = written(large.where("a <> b").distinct(), "edges")
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        down = large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        down = down.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        now = written(down.union(least.select("a", F.col("m").alias("b"))).where("a <> b").distinct(), "edges")


def in_cells(members: DataFrame, things: DataFrame, chunk: int) -> DataFrame:
    """Cells (leader, oc, mc) of at most about chunk sets that ask and chunk sets that are held: (member, root, asks, both, columns of things).

    members: (leader, member, root, tested: was compared with this leader), all of a leader's sets or those still open; things has id. Sets outside
    the main component of a leader ask all its sets. Leaders with nothing more to tell have no cells.
    """
    by_root = members.groupBy("leader", "root").agg(F.count("*").alias("k"), F.count_if(~F.col("tested")).alias("untested"), F.count_if(F.col("member") == F.col("leader")).alias("led"))
    groups = by_root.groupBy("leader").agg(F.max_by("root", F.struct("k", "root")).alias("main"), F.sum("k").alias("size"), F.count("*").alias("roots"), F.max("k").alias("most"), F.sum("untested").alias("untested"), F.sum("led").alias("led"))
    # a leader and one other set, which were compared before, have nothing more to tell; two sets left without their leader have
    groups = groups.where("roots > 1 AND (size > 2 OR untested > 0 OR led = 0)").select("leader", "main", F.ceil(F.col("size") / chunk).alias("chunks"), F.ceil((F.col("size") - F.col("most")) / chunk).alias("out_chunks"))
    groups = written(groups, "groups")  # a table of its own, so that the join may split a leader of very many sets
    told = [c for c in things.columns if c != "id"]
    rows = members.join(groups, "leader").withColumn("outside", F.col("root") != F.col("main"))
    rows = rows.join(things, F.col("member") == F.col("id")).select("leader", "member", "root", "outside", "chunks", "out_chunks", *told)
    place = F.xxhash64("member")
    every = [F.explode(F.sequence(F.lit(0).cast("long"), F.col(c) - 1)) for c in ("out_chunks", "chunks")]
    inside = rows.select("*", F.pmod(place, "chunks").alias("mc")).select("*", every[0].alias("oc")).withColumn("asks", F.lit(False))
    asking = rows.where("outside AND (chunks > 1 OR out_chunks > 1)").select("*", F.pmod(place, "out_chunks").alias("oc")).select("*", every[1].alias("mc")).withColumn("asks", F.lit(True))
    alone = F.col("outside") & (F.col("chunks") == 1) & (F.col("out_chunks") == 1)  # in a group of one cell, a set that asks is also held
    return inside.unionByName(asking).select("leader", "oc", "mc", "member", "root", "asks", alone.alias("both"), *told)


def open_members(members: DataFrame, sketches_: DataFrame, percent: int) -> DataFrame:
    """The rows of members whose sketch leaves it open that they link to a set of another component under the same leader."""

    def compare(cell: pd.DataFrame) -> pd.DataFrame:
        asks, held = cell[cell["asks"] | cell["both"]], cell[~cell["asks"]]
        index = SketchIndex(held["n"].to_numpy(), held["sketch"].tolist(), percent)
        roots, ids = held["root"].to_numpy(), held["member"].to_numpy()
        hit, found = np.zeros(len(held), dtype=bool), []
        for x, root, n, sketch in zip(asks["member"], asks["root"], asks["n"], asks["sketch"], strict=True):
            others = index.near_to(n, sketch)
            others = others[roots[others] != root]
            if len(others):
                hit[others] = True
                found.append(x)
        sets = np.unique(np.concatenate([np.array(found, dtype=np.int64), ids[hit]]))
        return pd.DataFrame({"leader": np.full(len(sets), cell["leader"].iloc[0]), "member": sets})

    cells = in_cells(members, sketches_, SKETCHED)
    open_ = written(cells.groupBy("leader", "oc", "mc").applyInPandas(compare, "leader long, member long").distinct(), "open")
    return written(members.join(open_, ["leader", "member"], "left_semi"), "open-members")


def further_links(members: DataFrame, tokens: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between sets of different components that stand under one leader, as many as unite them (no link that others of its cell imply)."""
    cells = in_cells(members, tokens.select("id", "tokens"), CHUNK)

    def compare(cell: pd.DataFrame) -> pd.DataFrame:
        asks, held = cell[cell["asks"] | cell["both"]], cell[~cell["asks"]]
        if not len(asks) or not len(held):
            return pd.DataFrame({"a": pd.Series(dtype="int64"), "b": pd.Series(dtype="int64")})
        sets = [np.frombuffer(t, dtype=np.uint64) for t in held["tokens"]]
        leads = np.flatnonzero(held["member"].to_numpy() == held["leader"].to_numpy())
        leader = sets[leads[0] if len(leads) else 0]  # another chunk's first set serves as well: answers derived from it are exact
        lacks = [np.setdiff1d(leader, s, assume_unique=True) for s in sets]
        adds = [np.setdiff1d(s, leader, assume_unique=True) for s in sets]
        sizes, n_adds = np.array([len(s) for s in sets]), np.array([len(s) for s in adds])
        roots, ids = held["root"].to_numpy(), held["member"].to_numpy()
        index = SketchIndex(sizes, sketches(sizes, np.concatenate(sets)), percent)
        out, united = [], {}

        def find(root: int) -> int:
            while root in united:
                root = united[root]
            return root

        for x, root, tokens_x in zip(asks["member"], asks["root"], asks["tokens"], strict=True):
            t = np.frombuffer(tokens_x, dtype=np.uint64)
            open_ = index.near_to(len(t), sketches(np.array([len(t)]), t)[0])
            open_ = open_[roots[open_] != root]
            if not len(open_):
                continue
            common = np.intersect1d(t, leader, assume_unique=True)
            # the leader's answer bounds every member's: no more than the common elements and what the member adds
            open_ = open_[near(len(common) + n_adds[open_], sizes[open_], len(t), percent)]
            for k in open_:
                a, b = find(root), find(roots[k])
                if a == b:  # linked already through other sets of this cell
                    continue
                overlap = len(common) - len(np.intersect1d(common, lacks[k], assume_unique=True)) + len(np.intersect1d(t, adds[k], assume_unique=True))
                if near(overlap, sizes[k], len(t), percent):
                    united[a] = b
                    out.append((x, ids[k]))
        return pd.DataFrame(out, columns=["a", "b"]).astype("int64")

    return cells.groupBy("leader", "oc", "mc").applyInPandas(compare, "a long, b long")


def near_duplicates(docs: DataFrame, n_words: int = 5, percent: int = 80, fingerprint: Callable = fingerprints) -> DataFrame:
    """(doc_id, row, row2, n_shingles, component_id, root) for every row of docs (doc_id, text, row, row2)."""
    spark: SparkSession = docs.sparkSession
    table = written(sets_and_stars(docs, n_words, percent, fingerprint), "sets-and-stars")
    rows = table.where("fp1 IS NOT NULL").select(F.nullif("doc_id", F.lit(NO_ID)).alias("doc_id"), "row", "row2", "n", "fp1", "fp2")
    classes = rows.where("n > 0").groupBy("fp1", "fp2", "n").agg(F.min("doc_id").alias("first"), F.min("row").alias("a_row"))
    classes = written(classes.withColumn("id", F.monotonically_increasing_id()), "classes")
    keyed = classes.select("id", F.col("fp1").bitwiseAND(F.lit(LOW48)).alias("key"))
    stars = table.where("leader IS NOT NULL").groupBy("leader", "member").agg(F.sum("k").alias("k"))
    leaders, members = (keyed.select(F.col("key").alias(k), F.col("id").alias(i)) for k, i in (("leader", "l"), ("member", "m")))
    stars = stars.join(leaders, "leader").join(members, "member")
    # classes whose list keys are equal count as one in the lists, so these few are compared anyway
    twins = written(keyed.join(keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key"), "key", "left_semi"), "equal-keys")
    same = twins.select("key", F.col("id").alias("l")).join(twins.select("key", F.col("id").alias("m")), "key").where("l < m").select("l", "m", F.lit(1).cast("long").alias("k"))
    stars = stars.where("l <> m").select("l", "m", "k").union(same)
    stars = written(stars.select(F.col("l").alias("leader"), F.col("m").alias("member"), "k"), "stars")

    picked = written(stars.select(F.explode(F.array("leader", "member")).alias("id")).distinct().join(classes, "id").select("id", "fp1", "fp2", "n", "a_row"), "picked")
    drawn = of_sets(docs, picked, n_words, True, fingerprint)
    one = written(stars.groupBy("member").agg(F.max_by("leader", F.struct("k", "leader")).alias("leader")), "first-leaders")
    pairs = one.join(drawn.select(F.col("id").alias("member"), F.col("n").alias("nb"), F.col("sketch").alias("sb")), "member").join(drawn.select(F.col("id").alias("leader"), F.col("n").alias("na"), F.col("sketch").alias("sa")), "leader")
    pairs = written(maybe_near(pairs.withColumnsRenamed({"leader": "a", "member": "b"}), percent), "maybe-links")
    tokens = of_sets(docs, picked.join(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "id", "left_semi"), n_words, False, fingerprint)
    both = pairs.join(tokens.select(F.col("id").alias("b"), F.col("tokens").alias("tb")), "b").join(tokens.select(F.col("id").alias("a"), F.col("tokens").alias("ta")), "a")
    links = written(verified(both, percent), "links")
    roots = components(links)
    tested = stars.join(one.select("member", F.col("leader").alias("first")), "member").select("leader", "member", (F.col("leader") == F.col("first")).alias("tested"))
    members = tested.union(stars.select("leader", "leader", F.lit(True)).distinct()).join(roots.select(F.col("node").alias("member"), "root"), "member", "left")
    members = written(members.select("leader", "member", F.coalesce("root", "member").alias("root"), "tested"), "members")
    members = open_members(members, drawn, percent)
    if members.take(1):
        tokens = of_sets(docs, picked.join(members.select(F.col("member").alias("id")).distinct(), "id", "left_semi"), n_words, False, fingerprint)
        roots = components(links.union(written(further_links(members, tokens, percent), "links")))
    roots = written(roots, "roots")

    of_class = classes.join(roots.select(F.col("node").alias("id"), "root"), "id", "left").select("fp1", "fp2", "n", "first", F.coalesce("root", "id").alias("root"))
    least = of_class.groupBy("root").agg(F.min("first").alias("component_id"))
    named = written(of_class.join(least, "root").select("fp1", "fp2", "n", "component_id", "root"), "components")
    joined = rows.join(named, ["fp1", "fp2", "n"], "left")
    return joined.select("doc_id", "row", "row2", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"), F.when(F.col("n") > 0, F.col("root")).alias("root"))


def _numbers(doc: str, text: str) -> dict[str, Column]:
    """Two independent 64-bit numbers for a row's content."""
    return {"row": F.xxhash64(doc, text), "row2": F.xxhash64(F.lit("second"), F.reverse(F.coalesce(F.col(text), F.lit(""))), F.col(text).isNull(), doc)}


def with_row(docs: DataFrame) -> DataFrame:
    """(doc_id, text, row, row2)."""
    return docs.select("doc_id", "text").withColumns(_numbers("doc_id", "text"))


def deduplicated(docs: DataFrame, n_words: int = 5, percent: int = 80) -> DataFrame:
    """docs without all but one row of each component (that with the least doc_id); texts without words all stay. Columns as given.

    Rows are told apart by 128 bits of their content; of rows that agree in doc_id and text, one stays.
    """
    names = [f"c{k}" for k in range(len(docs.columns))]
    doc, text = (names[docs.columns.index(c)] for c in ("doc_id", "text"))
    keys = ["row", "row2"]
    keyed = docs.toDF(*names).withColumns(_numbers(doc, text))
    found = written(near_duplicates(keyed.select(F.col(doc).alias("doc_id"), F.col(text).alias("text"), *keys), n_words, percent), "near-duplicates").where("root IS NOT NULL")
    first = F.min(F.struct(F.coalesce("doc_id", F.lit(2**63 - 1)).alias("d"), *keys)).alias("f")
    kept = found.groupBy("root").agg(first, F.count("*").alias("k")).where("k > 1").select("root", "f.row", "f.row2")
    gone = written(found.join(kept.select("root"), "root", "left_semi").select(*keys).distinct().join(kept.select(*keys), keys, "left_anti"), "removed")
    twice = written(found.groupBy(*keys).agg(F.count("*").alias("k")).where("k > 1").select(*keys), "repeated")
    gone, twice = (F.broadcast(x) if x.count() <= MOST_IDS else x for x in (gone, twice))
    left = keyed.join(gone, keys, "left_anti")
    single = left.join(twice, keys, "left_anti")
    once = left.join(twice, keys, "left_semi").dropDuplicates(keys)
    return single.union(once).select(*names).toDF(*docs.columns)


def op1_jaccard_join(spark, sf_dir: str) -> DataFrame:
    docs = with_row(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return near_duplicates(docs, n_words=3, percent=90).select("doc_id", "n_shingles", "component_id")
