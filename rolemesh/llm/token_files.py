"""Token-id files: fixed-size id blocks transposed to byte planes, each plane compressed with zstandard, and a chunk index.

A chunk holds whole documents in ascending doc_id order, about `chunk_ids` ids of them (one long
document may be more). Its ids are cut into blocks of `block_ids`; a block's little-endian unsigned
32-bit ids are transposed so that all lowest bytes stand first, then all second bytes and so on,
and each of the four planes is compressed alone: the upper planes shrink to almost nothing. Chunks
are committed by Spark's own writer (a lost executor leaves no half file), and the index holds each
chunk's first id, so that a range of documents is found without reading payloads.

Defined cases: a null or empty text holds the end id alone; repeated rows and doc_ids are each
written, ordered by doc_id, then by the text's hash, null doc_ids first, so that rows of one doc_id may
be dealt over several shards; a very long text is one chunk; an empty table gives empty files. Extra
columns are ignored.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rolemesh.llm.common import scratch_dir, slices, texts
from rolemesh.llm.encoding import AT_ONCE, encoder

#: First bytes of a payload.
MAGIC = b"IDPLANE1"


def to_planes(ids: np.ndarray, block_ids: int = 65_536, level: int = 3) -> bytes:
    """Header (magic, ids, ids a block), the planes' compressed sizes, then the planes."""
    press = zstandard.ZstdCompressor(level=level)
    planes = []
    for k in range(0, len(ids), block_ids):
        block = np.ascontiguousarray(ids[k : k + block_ids], dtype="<u4")
        planes += [press.compress(p.tobytes()) for p in block.view(np.uint8).reshape(-1, 4).T]
    return MAGIC + struct.pack("<QI", len(ids), block_ids) + np.array([len(p) for p in planes], dtype="<u4").tobytes() + b"".join(planes)


def from_planes(payload: bytes) -> np.ndarray:
    if payload[:8] != MAGIC:
        raise ValueError("not a token-id payload")
    (n, block_ids), expand, out = struct.unpack_from("<QI", payload, 8), zstandard.ZstdDecompressor(), []
    blocks = -(-n // block_ids)
    sizes = np.frombuffer(payload, dtype="<u4", count=4 * blocks, offset=20).tolist()
    at = 20 + 16 * blocks
    for b in range(blocks):
        planes = []
        for size in sizes[4 * b : 4 * b + 4]:
            planes.append(np.frombuffer(expand.decompress(payload[at : at + size]), dtype=np.uint8))
            at += size
        out.append(np.ascontiguousarray(np.stack(planes, axis=1)).view("<u4").ravel())
    return np.concatenate(out) if out else np.zeros(0, dtype="<u4")


def write_ids(docs: DataFrame, path: str, tokenizer_path: str, end_id: int = 2, keeps_spaces: bool = True, chunk_ids: int = 262_144, block_ids: int = 65_536) -> None:
    """Write `path`/chunks (payloads by shard) and `path`/index (shard, chunk, first_id, n_ids, n_docs, first_doc, last_doc)."""
    spark = docs.sparkSession
    shards = int(spark.conf.get("spark.sql.shuffle.partitions"))
    names = ["shard", "chunk", "doc_ids", "lengths", "n_ids", "payload"]
    types = [pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.int64(), pa.binary()]

    def shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, made, chunk = TaskContext.get().partitionId(), encoder(tokenizer_path, keeps_spaces, end_id), 0
        held: list[tuple[pa.Array, np.ndarray, np.ndarray]] = []  # doc_ids, lengths, ids

        def row(doc_ids: pa.Array, lengths: np.ndarray, ids: np.ndarray) -> pa.RecordBatch:
            lists = [pa.ListArray.from_arrays(pa.array([0, len(lengths)], pa.int32()), x) for x in (doc_ids, pa.array(lengths, pa.int64()))]
            alone = [pa.array([x], t) for x, t in zip((own, chunk, len(ids), to_planes(ids, block_ids)), (types[0], types[1], types[4], types[5]), strict=True)]
            return pa.RecordBatch.from_arrays([*alone[:2], *lists, *alone[2:]], names=names)

        for batch in batches:
            for part in slices(batch, most=AT_ONCE):
                n, flat = made.ids(texts(part))
                held.append((part.column("doc_id").cast(pa.int64()), n, flat))
                if sum(len(x[2]) for x in held) < chunk_ids:
                    continue
                doc_ids, n, flat = pa.concat_arrays([x[0] for x in held]), *(np.concatenate([x[k] for x in held]) for k in (1, 2))
                ends, first, at = np.cumsum(n), 0, 0
                while (last := int(np.searchsorted(ends, at + chunk_ids)) + 1) <= len(n):
                    yield row(doc_ids.slice(first, last - first), n[first:last], flat[at : ends[last - 1]])
                    first, at, chunk = last, int(ends[last - 1]), chunk + 1
                held = [(doc_ids.slice(first), n[first:], flat[at:])] if first < len(n) else []
        if held:
            yield row(pa.concat_arrays([x[0] for x in held]), *(np.concatenate([x[k] for x in held]) for k in (1, 2)))

    ordered = docs.select("doc_id", "text", F.xxhash64("text").alias("h")).repartitionByRange(shards, "doc_id", "h").sortWithinPartitions("doc_id", "h").select("doc_id", "text")
    chunks = ordered.mapInArrow(shard, "shard long, chunk long, doc_ids array<long>, lengths array<long>, n_ids long, payload binary")
    chunks.write.option("compression", "none").parquet(f"{path}/chunks")
    kept = spark.read.parquet(f"{path}/chunks").select("shard", "chunk", "n_ids", F.size("doc_ids").alias("n_docs"), F.element_at("doc_ids", 1).alias("first_doc"), F.element_at("doc_ids", -1).alias("last_doc"))
    totals = kept.groupBy("shard").agg(F.sum("n_ids").alias("total"))
    earlier = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # a row for each shard
    bases = totals.select("shard", F.coalesce(F.sum("total").over(earlier), F.lit(0)).alias("base"))
    within = Window.partitionBy("shard").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    index = kept.join(bases, "shard").withColumn("first_id", F.col("base") + F.coalesce(F.sum("n_ids").over(within), F.lit(0))).drop("base")
    index.write.parquet(f"{path}/index")


def read_ids(spark: SparkSession, path: str, **columns) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of every document in the files at path; ids are little-endian unsigned 32-bit integers.

    columns: expressions over doc_id, n_tokens and ids to return in place of ids; they are taken
    where a chunk is expanded, so that the join with the index moves no ids.
    """
    names = ["shard", "chunk", "doc_id", "local_start", "n_tokens", "ids"]

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                shard, chunk, payload = (batch.column(c)[k].as_py() for c in ("shard", "chunk", "payload"))
                doc_ids, lengths = (batch.column(c)[k].values for c in ("doc_ids", "lengths"))
                ends = np.cumsum(lengths.to_numpy())
                starts = ends - lengths.to_numpy()
                ids = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(ends), [None, pa.py_buffer(4 * np.append(starts, ends[-1:])), pa.py_buffer(from_planes(payload))])
                where = [pa.array(np.full(len(ends), x), pa.int64()) for x in (shard, chunk)]
                yield pa.RecordBatch.from_arrays([*where, doc_ids, pa.array(starts), lengths, ids.cast(pa.binary())], names=names)

    wanted = columns or {"ids": F.col("ids")}
    chunks = spark.read.parquet(f"{path}/chunks").select("shard", "chunk", "doc_ids", "lengths", "payload")
    docs = chunks.mapInArrow(expand, "shard long, chunk long, doc_id long, local_start long, n_tokens long, ids binary")
    docs = docs.select("shard", "chunk", "doc_id", "local_start", "n_tokens", *[c.alias(k) for k, c in wanted.items()])
    first = spark.read.parquet(f"{path}/index").select("shard", "chunk", "first_id")
    return docs.join(first, ["shard", "chunk"]).select("doc_id", (F.col("first_id") + F.col("local_start")).alias("start"), "n_tokens", *wanted)


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import uuid

    import public_tokenizers

    path = f"{scratch_dir(spark).rstrip('/')}/rolemesh/token-files-{uuid.uuid4().hex}"
    write_ids(spark.read.parquet(f"{sf_dir}/documents.parquet"), path, public_tokenizers.path("byte_bpe_50k.json"))
    return read_ids(spark, path, ids_crc32=F.crc32("ids"))
