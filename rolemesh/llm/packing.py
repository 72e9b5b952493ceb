"""Packing by concatenate-and-cut: prefix sums over partition token totals, then fixed windows with boundary records.

Pass 1 encodes every text once and keeps, with the ids, a running offset inside its *run* (the rows
that one task reads in order). The totals of the runs, one row each, are summed in run order, which
turns every local offset into a global one; windows of fixed length are then cut without moving
any ids. Only run totals, never rows, meet in one task.

Defined cases: a null or empty text is a document that holds the end id alone; repeated rows and
repeated doc_ids are packed as often as they occur; a null doc_id stays null; a text longer than a
window spans several; an empty table gives no pieces. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rolemesh.llm.common import slices, texts, written
from rolemesh.llm.encoding import AT_ONCE, encoder

#: Up to so many run totals (about 60 bytes each) are broadcast; beyond that Spark chooses the join.
MOST_RUNS = 500_000


def encoded_runs(docs: DataFrame, tokenizer_path: str, end_id: int, keeps_spaces: bool, order: tuple[str, str] | None = None) -> DataFrame:
    """(run_file, run_row, doc_id, local_start, n_tokens, ids): ids are little-endian unsigned 32-bit integers.

    order names a file column and a row-number column that say where a row stands; without it the
    order is that in which tasks read the table.
    """
    file, row = (F.col(c) for c in order) if order else (F.lit(None).cast("string"), F.lit(None).cast("long"))
    rows = docs.select("doc_id", "text", file.cast("string").alias("run_file"), row.cast("long").alias("run_row"))
    schema = pa.schema([("run_file", pa.string()), ("run_row", pa.int64()), ("doc_id", pa.int64()), ("local_start", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = f"{TaskContext.get().partitionId():012d}"
        made, run, upto = encoder(tokenizer_path, keeps_spaces, end_id), None, 0
        for batch in batches:
            for part in slices(batch, most=AT_ONCE):
                n, flat = made.ids(texts(part))
                ends, data = np.cumsum(n), flat.tobytes()
                where = zip(part.column("run_file").to_pylist(), part.column("run_row").to_pylist(), strict=True) if order else [(own, 0)] * len(n)
                out: list[tuple] = []
                for (f, r), doc, k, end in zip(where, part.column("doc_id").to_pylist(), n.tolist(), ends.tolist(), strict=True):
                    if run is None or run[0] != f:
                        run, upto = (f, r), 0
                    out.append((*run, doc, upto, k, data[4 * (end - k) : 4 * end]))
                    upto += k
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), schema.types, strict=True)], schema=schema)

    return rows.mapInArrow(encode, "run_file string, run_row long, doc_id long, local_start long, n_tokens long, ids binary")


def pack(docs: DataFrame, tokenizer_path: str, window: int = 2048, end_id: int = 1, keeps_spaces: bool = False, order: tuple[str, str] | None = None) -> DataFrame:
    """A row for each piece: doc_id, start (ids of its document before it), length, doc_tokens, sequence_id, offset (in its sequence), ids (binary)."""
    encoded = written(encoded_runs(docs, tokenizer_path, end_id, keeps_spaces, order), "encoded")
    totals = encoded.groupBy("run_file", "run_row").agg(F.sum("n_tokens").alias("total"))
    before = Window.orderBy("run_file", "run_row").rowsBetween(Window.unboundedPreceding, -1)
    bases = written(totals.select("run_file", "run_row", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("base")), "run-bases")
    if bases.count() <= MOST_RUNS:
        bases = F.broadcast(bases)
    placed = encoded.join(bases, ["run_file", "run_row"]).select("doc_id", (F.col("base") + F.col("local_start")).alias("at"), "n_tokens", "ids")
    names = ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"]
    types = [*[pa.int64()] * 6, pa.binary()]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "ids"):
                out: list[tuple] = []
                for doc, at, n, ids in zip(*(c.to_pylist() for c in part.columns), strict=True):
                    start = 0
                    while start < n:
                        sequence, offset = divmod(at + start, window)
                        length = min(n - start, window - offset)
                        out.append((doc, start, length, n, sequence, offset, ids[4 * start : 4 * (start + length)]))
                        start += length
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=names)

    return placed.mapInArrow(cut, "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary")


def sequences(pieces: DataFrame, window: int = 2048) -> DataFrame:
    """One row a sequence: its boundary records in order, and its number of tokens (a sequence holds `window` pieces at most)."""
    record = F.struct("offset", "doc_id", "start", "length", "ids")
    return pieces.groupBy("sequence_id").agg(F.sort_array(F.collect_list(record)).alias("pieces"), F.sum("length").alias("n_tokens"), (F.lit(window) - F.sum("length")).alias("padding"))


def op4_packing(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    pieces = pack(docs, public_tokenizers.path("word_bpe_49k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
