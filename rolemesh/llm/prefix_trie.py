"""The trie of conversation prefixes: balanced parentheses per shard with range min-max excess blocks.

A conversation is the path of its turns' 128-bit digests. Paths are sorted by ranges, and each run of them is a shard: its trie is
a sequence of parentheses, built from the lengths that neighbouring paths share. ``Parens.close`` finds the end of every
subtree through blocks of least excess; the rank of "()" pairs counts leaves, and cumulative arrays over the preorder give
savings. Only nodes on the first and last path of a shard may stand in others too. Those spines meet by the
digest of their prefix: what hangs below a node in each shard is added up, each node of the merged spines is owned by one path, and
sums along the paths give the subtrees. Shards hold SHARD_TURNS turns (or one conversation), however many copies or
first turns there are; copies are parted by conv_id.

Defined cases: rows without conv_id belong to no conversation; null turns come first; rows of one turn are ordered by role, then text, and
repeated ones are all turns; a null role or text is empty; a conversation without turns ends at the root; a table
without conversations has no root; a very long text is worth its code points and is hashed where it is read. Extra
columns are ignored. The turns of one conversation are ordered in one task (sorted on disk if need be) and its path is one row of 24 bytes a turn.
The digest of ends is sequential by nature: the conversations that end at one node reach it as a string for each shard.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rolemesh.llm.common import written
from rolemesh.llm.warc import met

#: Turns of a shard, about; bits of a block of parentheses.
SHARD_TURNS, BLOCK = 1_000_000, 64
NOBODY = hashlib.sha256(b"").hexdigest()


class Parens:
    """Balanced parentheses (true: open) with a tree of the least excess of blocks."""

    def __init__(self, bits: np.ndarray) -> None:
        self.bits, self.n = bits, len(bits)
        self.leaves = 1 << max(0, (-(-self.n // BLOCK) - 1).bit_length())
        excess = np.full(self.leaves * BLOCK, np.iinfo(np.int64).max)
        excess[: self.n] = np.cumsum(np.where(bits, 1, -1))
        self.excess = excess
        self.least = np.full(2 * self.leaves, np.iinfo(np.int64).max)
        self.least[self.leaves :] = excess.reshape(-1, BLOCK).min(axis=1)
        for level in range(self.leaves.bit_length() - 2, -1, -1):
            at = np.arange(1 << level, 2 << level)
            self.least[at] = np.minimum(self.least[2 * at], self.least[2 * at + 1])
        self.pairs = np.cumsum(bits & ~np.append(bits[1:], True))

    def _first(self, at: np.ndarray, below: np.ndarray) -> np.ndarray:
        """The first place from each `at` to the end of its block where the excess is less than `below`; -1 if there is none."""
        found = np.full(len(at), -1)
        left = np.arange(len(at))
        place = at.copy()
        while len(left):
            hit = self.excess[place[left]] < below[left]
            found[left[hit]] = place[left[hit]]
            left = left[~hit]
            place[left] += 1
            left = left[place[left] % BLOCK > 0]
        return found

    def close(self, opens: np.ndarray) -> np.ndarray:
        """The closing parenthesis of each opening one: in its block, else in the first block to the right that goes low enough."""
        below = self.excess[opens]
        found = np.full(len(opens), -1)
        near = (opens + 1) % BLOCK > 0
        found[near] = self._first(opens[near] + 1, below[near])
        left = np.flatnonzero(found < 0)
        node = opens[left] // BLOCK + self.leaves
        up = np.ones(len(left), dtype=bool)
        while up.any():  # to the first ancestor whose right neighbour goes low enough
            right = np.minimum(node + 1, 2 * self.leaves - 1)
            over = up & (node % 2 == 0) & (self.least[right] < below[left])
            node = np.where(over, right, np.where(up, node // 2, node))
            up &= ~over
        while (node < self.leaves).any():  # and down again
            inner = node < self.leaves
            down = np.where(inner, 2 * node, node)
            node = np.where(inner & (self.least[np.minimum(down, 2 * self.leaves - 1)] >= below[left]), down + 1, down)
        found[left] = self._first((node - self.leaves) * BLOCK, below[left])
        return found

    def leaf_pairs(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many "()" stand between a and b, both included."""
        return self.pairs[b] - self.pairs[a] + (self.bits[a] & ~self.bits[np.minimum(a + 1, self.n - 1)])


def shared(keys: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """How many first turns each path has in common with the one before (keys: all paths' turns, one after the other)."""
    start = np.cumsum(lengths) - lengths
    common = np.zeros(len(lengths), dtype=np.int64)
    left, depth = np.arange(1, len(lengths)), 0
    while len(left):
        left = left[np.minimum(lengths[left], lengths[left - 1]) > depth]
        left = left[(keys[start[left] + depth] == keys[start[left - 1] + depth]).all(axis=1)]
        depth += 1
        common[left] = depth
    return common


_COLUMNS = {
    "conv_id": pa.int64(), "depth": pa.int64(), "parent_conv_id": pa.int64(), "n_convs": pa.int64(), "n_children": pa.int64(), "n_leaves": pa.int64(), "saved_tokens": pa.int64(), "ends": pa.string(),
    "parent": pa.binary(), "prefix": pa.binary(), "path": pa.int64(), "tokens": pa.int64(),
}
_SCHEMA = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends string, parent binary, prefix binary, path long, tokens long"


def shard_nodes(shard: int, convs: np.ndarray, keys: np.ndarray, lengths: np.ndarray, chars: np.ndarray) -> pa.RecordBatch:
    """Nodes of a shard of sorted paths. Those on its first or last path have `prefix` (and `path`, 2 x shard for the first and 1 more for the last), and
    count children, leaves and savings of what hangs below them and isn't on these paths; `ends` lists ids. The others are complete but for the conv_id of a parent that has a prefix (`parent`).
    """
    lcp = shared(keys, lengths)
    opens = lengths - lcp
    closes = np.append(np.append(0, lengths[:-1]) - lcp, lengths[-1] + 1)
    runs = np.append(np.column_stack([closes[:-1], opens]).ravel(), closes[-1])
    runs[0] = 1  # the root opens first
    kinds = np.append(np.tile([False, True], len(lengths)), False)
    kinds[0] = True
    bits = np.repeat(kinds, runs)
    tree = Parens(bits)
    first = np.flatnonzero(bits)
    last = tree.close(first)
    n = len(first)
    begun = np.cumsum(opens)  # nodes below the root that are open, or were, when a path ends
    ended = np.cumsum(runs)[1:-1:2]  # parentheses before a path's end
    depth = np.append(0, np.arange(begun[-1]) - np.repeat(begun - opens, opens) + np.repeat(lcp, opens) + 1)
    turn = np.repeat(np.cumsum(lengths) - lengths + lcp, opens) + depth[1:] - 1 - np.repeat(lcp, opens)
    tokens = np.append(0, chars[turn])
    a, b = np.searchsorted(ended, first, side="right"), np.searchsorted(ended, last, side="right")  # members: paths that end inside
    members = b - a
    least = np.minimum.reduceat(np.append(convs, np.iinfo(np.int64).max), np.column_stack([a, b]).ravel())[::2]
    size = (last - first + 1) // 2
    order = np.lexsort((np.arange(n), depth))
    ranked = depth[order] * n + order
    parent = order[np.maximum(np.searchsorted(ranked, (depth - 1) * n + np.arange(n)) - 1, 0)]
    parent[0] = -1
    children = np.bincount(parent[1:], minlength=n)
    gain = np.append(0, np.cumsum((members - 1) * tokens))
    saved = gain[np.arange(n) + size] - gain[:n]
    leaves = tree.leaf_pairs(first, last)
    end = np.where(lengths == 0, 0, begun)  # the node where a path ends
    # the two spines: nodes open on the first path, and on the last
    left = np.arange(lengths[0] + 1)
    right = np.empty(lengths[-1] + 1, dtype=np.int64)
    node = end[-1]
    for d in range(lengths[-1], -1, -1):
        right[d], node = node, parent[node]
    spine = np.zeros(n, dtype=bool)
    spine[left] = spine[right] = True
    hangs = ~spine & spine[parent]  # tops of what hangs below a spine
    hangs[0] = False
    own = {name: np.bincount(parent[hangs], weights=None, minlength=n) if x is None else _summed(parent[hangs], x[hangs], n) for name, x in (("children", None), ("leaves", leaves), ("saved", saved))}
    digests: dict[int, str] = {}
    cuts = np.flatnonzero(np.diff(end, prepend=-1, append=-1))
    ids = {}
    for k, m in zip(cuts[:-1], cuts[1:], strict=True):
        ids[int(end[k])] = ",".join(map(str, convs[k:m].tolist()))
    for k, text in ids.items():
        digests[k] = text if spine[k] else hashlib.sha256(text.encode()).hexdigest()
    parts = []
    rest = np.flatnonzero(~spine)
    names: dict[int, bytes] = {}
    for side, nodes in ((0, left), (1, right)):
        begin = int(lengths[:-1].sum()) if side else 0
        path, made = hashlib.blake2b(digest_size=16), []
        for d in range(len(nodes)):
            if d:
                path.update(keys[begin + d - 1].tobytes())
            made.append(path.copy().digest())
        names |= dict(zip(nodes.tolist(), made, strict=True))
        new = nodes if not side else np.where(np.isin(nodes, left), -1, nodes)  # what the first path has counts there
        once = lambda x, new=new: np.where(new >= 0, x[new], 0)
        parts.append([least[nodes], depth[nodes], np.full(len(nodes), -1), once(members), once(own["children"]), once(own["leaves"]), once(own["saved"]), [digests.get(k) if k >= 0 else None for k in new.tolist()], [None, *made[:-1]], made, np.full(len(nodes), 2 * shard + side), tokens[nodes]])
    parts.append([least[rest], depth[rest], np.where(spine[parent[rest]], -1, least[parent[rest]]), members[rest], children[rest], leaves[rest], saved[rest], [digests.get(k, NOBODY) for k in rest.tolist()], [names.get(k) for k in parent[rest].tolist()], [None] * len(rest), np.full(len(rest), -1), tokens[rest]])
    arrays = []
    for k, (name, kind) in enumerate(_COLUMNS.items()):
        whole = [x for p in parts for x in p[k]] if name in ("ends", "parent", "prefix") else np.concatenate([p[k] for p in parts])
        arrays.append(pa.array(whole, kind))
    return pa.RecordBatch.from_arrays(arrays, names=list(_COLUMNS))


def _summed(groups: np.ndarray, x: np.ndarray, n: int) -> np.ndarray:
    out = np.zeros(n, dtype=np.int64)
    np.add.at(out, groups, x)
    return out


def rebuilt(conversations: DataFrame, borrowed: int = 6, family: int = 100) -> DataFrame:
    """(conv_id, path, chars): the turns' digests (16 bytes each, joined) and code points of every conversation, its first h turns taken from the first of its family, h = crc32(conv_id) mod borrowed."""
    text, role = F.coalesce("text", F.lit("")), F.coalesce("role", F.lit(""))
    rows = conversations.where("conv_id IS NOT NULL").select("conv_id", "turn", role.alias("role"), text.alias("text"))
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    key = F.unhex(F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text")))
    own = written(rows.select("conv_id", F.row_number().over(order).alias("pos"), key.alias("key"), F.length("text").cast("long").alias("chars")), "turns")
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % borrowed
    convs = own.where("pos = 1").select("conv_id")
    lent = own.where((F.col("conv_id") % family == 0) & (F.col("pos") < borrowed)).select(F.col("conv_id").alias("from"), "pos", "key", "chars")
    taken = convs.withColumn("h", h).withColumn("from", F.col("conv_id") - F.col("conv_id") % family).join(lent, "from").where("pos <= h")
    turns = taken.select("conv_id", "pos", "key", "chars").unionByName(own.where(F.col("pos") > h))
    none = F.lit(None)
    every = turns.unionByName(convs.select("conv_id", none.cast("int").alias("pos"), none.cast("binary").alias("key"), none.cast("long").alias("chars")))
    seq = F.sort_array(F.collect_list(F.when(F.col("pos").isNotNull(), F.struct("pos", "key", "chars"))))
    paths = every.groupBy("conv_id").agg(seq.alias("s"))
    return paths.select("conv_id", F.unhex(F.array_join(F.transform("s", lambda x: F.hex(x["key"])), "")).alias("path"), F.transform("s", lambda x: x["chars"]).alias("chars"))


def trie(paths: DataFrame, shard_turns: int = SHARD_TURNS) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256) of every node of the trie of (conv_id, path, chars)."""
    spark = paths.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    paths = written(paths, "paths")  # ranges are found by a look at all of it

    step = min(10_000, shard_turns)  # paths looked at together

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, held, turns = TaskContext.get().partitionId() << 20, [], 0

        def nodes() -> pa.RecordBatch:
            convs = np.concatenate([b.column("conv_id").to_numpy() for b in held])
            lengths = np.concatenate([np.fromiter((len(x.as_buffer()) // 16 for x in b.column("path")), dtype=np.int64, count=b.num_rows) for b in held])
            keys = np.frombuffer(b"".join(x.as_buffer() for b in held for x in b.column("path")), dtype=np.uint64).reshape(-1, 2)
            chars = np.concatenate([b.column("chars").flatten().to_numpy() for b in held])
            return shard_nodes(shard, convs, keys, lengths, chars)

        for batch in batches:
            for k in range(0, batch.num_rows, step):
                held.append(batch.slice(k, step))
                turns += len(held[-1].column("chars").flatten())
                if turns >= shard_turns:
                    yield nodes()
                    shard, held, turns = shard + 1, [], 0
        if held:
            yield nodes()

    sorted_paths = paths.repartitionByRange(n, "path", "conv_id").sortWithinPartitions("path", "conv_id").select("conv_id", "path", "chars")
    nodes = written(sorted_paths.mapInArrow(build, _SCHEMA), "trie-nodes")
    spines = merged(nodes.where("prefix IS NOT NULL"))
    parents = spines.select(F.col("prefix").alias("parent"), F.col("conv_id").alias("p"))
    plain = ["depth", "n_convs", "n_children", "n_leaves", "saved_tokens"]
    whole = nodes.where("prefix IS NULL")
    inner = whole.where("parent IS NULL").select("conv_id", *plain, "parent_conv_id", F.col("ends").alias("ends_sha256"))
    tops = met(whole.where("parent IS NOT NULL").select("conv_id", *plain, "ends", "parent"), parents, "parent").select("conv_id", *plain, F.col("p").alias("parent_conv_id"), F.col("ends").alias("ends_sha256"))
    top = spines.join(parents, "parent", "left").select("conv_id", *plain, F.col("p").alias("parent_conv_id"), "ends_sha256")
    return inner.unionByName(tops).unionByName(top).select("conv_id", "depth", "parent_conv_id", *plain[1:], "ends_sha256")


def merged(spines: DataFrame) -> DataFrame:
    """Nodes on the spines of all shards, merged by prefix: (prefix, parent, conv_id, depth, n_convs, n_children, n_leaves, saved_tokens, ends_sha256)."""
    total = {c: F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")}
    nodes = spines.groupBy("prefix").agg(F.first("parent").alias("parent"), F.min("conv_id").alias("conv_id"), F.first("depth").alias("depth"), F.first("tokens").alias("tokens"), F.min("path").alias("owner"), *total.values())
    below = nodes.groupBy(F.col("parent").alias("prefix")).agg(F.count("*").alias("on_spines"))
    nodes = nodes.join(below, "prefix", "left").withColumn("n_children", F.col("n_children") + F.coalesce("on_spines", F.lit(0)))
    # what a node adds to its own subtree: what hangs from it, and itself
    nodes = written(nodes.withColumn("n_leaves", F.col("n_leaves") + (F.col("n_children") == 0).cast("long")).withColumn("saved_tokens", F.col("saved_tokens") + (F.col("n_convs") - 1) * F.col("tokens")).drop("on_spines", "tokens"), "trie-spines")
    weights = nodes.select("prefix", F.col("owner").alias("path"), F.col("n_leaves").alias("l"), F.col("saved_tokens").alias("s"))
    deeper = Window.partitionBy("path").orderBy(F.desc("depth"))
    sums = spines.select("prefix", "path", "depth").join(weights, ["prefix", "path"], "left")
    sums = sums.select("prefix", F.sum(F.coalesce("l", F.lit(0))).over(deeper).alias("l"), F.sum(F.coalesce("s", F.lit(0))).over(deeper).alias("s")).groupBy("prefix").agg(F.sum("l").alias("n_leaves"), F.sum("s").alias("saved_tokens"))
    found = nodes.drop("n_leaves", "saved_tokens", "owner").join(sums, "prefix")
    return found.join(ends_digests(spines), "prefix", "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(NOBODY)))


def ends_digests(spines: DataFrame) -> DataFrame:
    """(prefix, ends_sha256): the lists of a node's shards, in their order, run through one digest."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, running = None, None
        row = lambda: pa.RecordBatch.from_arrays([pa.array([now], pa.binary()), pa.array([running.hexdigest()])], names=["prefix", "ends_sha256"])
        for batch in batches:
            for prefix, ends in zip(batch.column("prefix").to_pylist(), batch.column("ends").to_pylist(), strict=True):
                if prefix != now:
                    if now is not None:
                        yield row()
                    now, running = prefix, hashlib.sha256(ends.encode())
                else:
                    running.update(b"," + ends.encode())
        if now is not None:
            yield row()

    lists = spines.where("ends IS NOT NULL").select("prefix", "path", "ends")
    n = int(spines.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return lists.repartition(n, "prefix").sortWithinPartitions("prefix", "path").select("prefix", "ends").mapInArrow(digest, "prefix binary, ends_sha256 string")


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie(rebuilt(spark.read.parquet(f"{sf_dir}/conversations.parquet")))


ORACLE = """
WITH t AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos FROM conversations WHERE conv_id IS NOT NULL),
c AS MATERIALIZED (SELECT conv_id, xor(list_reduce([4294967295::BIGINT] || [ascii(x)::BIGINT FOR x IN string_split(conv_id::VARCHAR, '')], lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda s, z: CASE WHEN s & 1 = 1 THEN xor(s >> 1, 3988292384) ELSE s >> 1 END)), 4294967295) % 6 AS h FROM (SELECT DISTINCT conv_id FROM t)),
r AS (SELECT c.conv_id, pos, role, text FROM c JOIN t b ON b.conv_id = c.conv_id - c.conv_id % 100 AND pos <= h UNION ALL SELECT conv_id, pos, role, text FROM c JOIN t USING (conv_id) WHERE pos > h),
k AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY pos) AS depth, text, md5(length(role) || ':' || role || text) AS key FROM r),
p AS MATERIALIZED (SELECT conv_id, depth, length(text) AS tokens, string_agg(key, '') OVER (PARTITION BY conv_id ORDER BY depth) AS path FROM k UNION ALL SELECT conv_id, 0, 0, '' FROM c),
ends AS (SELECT path, sha256(string_agg(conv_id, ',' ORDER BY conv_id)) AS ends_sha256 FROM (SELECT conv_id, arg_max(path, depth) AS path FROM p GROUP BY 1) GROUP BY 1),
n AS MATERIALIZED (SELECT path, depth, any_value(tokens) AS tokens, min(conv_id) AS conv_id, count(*) AS n_convs FROM p GROUP BY ALL),
kids AS (SELECT path[:-33] AS path, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY 1),
f AS MATERIALIZED (SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN kids USING (path)),
under AS (SELECT p.path, count(*) FILTER (n_children = 0) AS n_leaves, sum((n_convs - 1) * f.tokens)::BIGINT AS saved_tokens FROM f JOIN p ON p.conv_id = f.conv_id AND p.depth <= f.depth GROUP BY 1)
SELECT f.conv_id, f.depth, up.conv_id AS parent_conv_id, f.n_convs, f.n_children, n_leaves, saved_tokens, coalesce(ends_sha256, sha256('')) AS ends_sha256
FROM f JOIN under USING (path) LEFT JOIN ends USING (path) LEFT JOIN n up ON f.depth > 0 AND up.path = f.path[:-33]
"""
