"""What the corpus operators share: the shared scratch folder, written intermediate tables, word hashing."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Callable, Iterator
from functools import wraps

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Text bytes that a Python task works on at a time.
SLICE_BYTES = 4 << 20


def scratch_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``; a local one is set only where that is unset (tests)."""
    key = "spark.checkpoint.dir"
    found = spark.sparkContext.getConf().get(key) or spark.conf.get(key, None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="rolemesh-")
        spark.conf.set(key, found)
    return found


def written(df: DataFrame, label: str, compression: str = "snappy") -> DataFrame:
    """Cut the lineage of df with a Parquet table in the shared folder: a lost executor costs no recomputation of what is above."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark).rstrip('/')}/rolemesh/{label}-{uuid.uuid4().hex}"
    if _TABLES.now is not None:
        _TABLES.now.append(path)
    df.write.option("compression", compression).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def ranked(df: DataFrame, label: str, *order, most: int = 1 << 63) -> DataFrame:
    """df, written, with `id`: its place from 0 in the given order, which must tell all rows apart. Rows are sorted by ranges; only a count for each partition meets in one task."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = written(df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()), label)
    if placed.count() > most:
        raise ValueError(f"more than {most} rows to rank")
    part, within = F.shiftright("_at", 33), F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = placed.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    bases = parts.select("_part", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_base"))  # a row for each partition
    return placed.join(F.broadcast(bases), part == F.col("_part")).withColumn("id", F.col("_base") + within).drop("_at", "_part", "_base")


def running(df: DataFrame, label: str, order: list, **values) -> DataFrame:
    """df with a column for each of values (F.sum or F.max, and a column): the aggregate over all rows that stand no later in the given order.

    Rows are sorted by ranges, and each range is summed where it lies; only a row for each range meets in one task, and is sent to all.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = written(df.repartitionByRange(n, *order).withColumn("_part", F.spark_partition_id()), label)
    own = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy("_part").agg(*[f(c).alias(f"_t_{k}") for k, (f, c) in values.items()])
    totals = totals.select("_part", *[f(F.col(f"_t_{k}")).over(before).alias(f"_b_{k}") for k, (f, _) in values.items()])
    joined = rows.withColumns({f"_o_{k}": f(c).over(own) for k, (f, c) in values.items()}).join(F.broadcast(totals), "_part")
    both = {k: F.coalesce(F.col(f"_o_{k}") + F.col(f"_b_{k}"), f"_o_{k}", f"_b_{k}") if f is F.sum else F.greatest(f"_o_{k}", f"_b_{k}") for k, (f, _) in values.items()}
    return joined.withColumns(both).drop("_part", *[f"_{x}_{k}" for k in values for x in "ob"])


class _Tables(threading.local):
    """What the pipeline of this thread has written: while a stage runs (none: outside stages), and by the stage before it."""

    now: list[str] | None = None
    earlier: list[str] = []


_TABLES = _Tables()


def stage(f: Callable | None = None, *, first: bool = False) -> Callable:
    """A pipeline stage (spark, docs, sf_dir): tables that the stage before wrote for itself are deleted as it begins, but for those that docs still reads. The first stage begins a pipeline and deletes nothing."""
    if f is None:
        return lambda g: stage(g, first=first)

    @wraps(f)
    def staged(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        read = [] if first else docs.inputFiles() if _TABLES.earlier else []
        for path in [] if first else _TABLES.earlier:
            if not any(f"{path}/" in x for x in read):
                there = spark._jvm.org.apache.hadoop.fs.Path(path)  # any store that Spark writes to
                there.getFileSystem(spark._jsc.hadoopConfiguration()).delete(there, True)
        _TABLES.now = []
        try:
            return f(spark, docs, sf_dir)
        finally:
            _TABLES.earlier, _TABLES.now = _TABLES.now, None

    return staged


def slices(batch: pa.RecordBatch, column: str = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut an Arrow batch so that each part holds about `most` bytes of text (one row at least)."""
    pa.default_memory_pool().release_unused()  # what the last batch needed goes back to the system: workers share an executor's memory
    if not batch.num_rows:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    group = (np.cumsum(sizes) - sizes) // most
    cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts, cuts[1:], strict=False):
        yield batch.slice(a, b - a)


def texts(batch: pa.RecordBatch, column: str = "text") -> pa.Array:
    """The texts of a batch with 64-bit offsets that begin at 0 (Arrow's string functions go wrong on some slices); null is the empty text."""
    array = pc.fill_null(batch.column(column).cast(pa.large_string()), "")
    _, offsets, data = array.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[array.offset : array.offset + len(array) + 1] if len(array) else np.zeros(1, dtype=np.int64)
    data = data.slice(at[0], at[-1] - at[0]) if data is not None else None
    return pa.LargeStringArray.from_buffers(len(array), pa.py_buffer((at - at[0]).tobytes()), data)


def split_words(array: pa.Array, lower: bool = True) -> tuple[pa.DictionaryArray, np.ndarray]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of each text (A-Z lower-cased if asked): their dictionary codes over the batch, and each text's word count."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(array) if lower else array)
    words, offsets = lists.values, lists.offsets.to_numpy().astype(np.int64)
    words = words.slice(offsets[0], offsets[-1] - offsets[0])
    full = pc.greater(pc.binary_length(words), 0).to_numpy(zero_copy_only=False)
    before = np.concatenate([[0], np.cumsum(full)])
    counts = np.diff(before[offsets - offsets[0]])
    return words.filter(pa.array(full)).dictionary_encode(), counts


def hashes(dictionary: pa.Array) -> np.ndarray:
    """A 64-bit hash of each entry."""
    return np.fromiter(map(xxhash.xxh3_64_intdigest, dictionary.to_pylist()), dtype=np.uint64, count=len(dictionary))


def mix(x: np.ndarray) -> np.ndarray:
    """Scatter the bits of 64-bit integers (multiply and xor-shift)."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x9E3779B97F4A7C15)
    x = x ^ (x >> np.uint64(29))
    return x * np.uint64(0xBF58476D1CE4E5B9) ^ (x >> np.uint64(32))
