"""Language-model scores by subword lattice likelihood.

The pieces come from an existing subword vocabulary, whose own scores (ranks) start the unigram
model; expectation-maximisation over the training words then fits the piece probabilities. The
probability of a word is the sum over all its segmentations, by a forward recursion in log space.
As no piece crosses a word, a text's log probability is the sum over its words and the end, so each
distinct word of the corpus is scored once, however often it occurs.

Word counts are gathered over all training texts by a shuffle. Scores return to the texts in two
ways: the most frequent words (at most MOST_WORDS, each of at most MOST_BYTES bytes) are broadcast,
and all others are joined by a shuffle on the word.

Defined cases: null and empty texts hold the end alone; repeated rows and doc_ids are each scored;
a null doc_id counts as the empty id text (so it trains); without training rows all counts are 0; an empty table
gives no rows; characters outside the vocabulary are spelt by UTF-8 bytes; a very long word (a text without white
space) is scored whole, its pieces looked up for all positions at once, in blocks of BLOCK. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rolemesh.llm.common import slices, split_words, texts, written

MOST_WORDS, MOST_BYTES = 400_000, 32
#: Probability kept for spelling by bytes; added to each piece's expected count.
BYTE_SHARE, FLOOR = 1e-4, 0.05
ROUNDS = 2
#: Words of more code points are scored alone, so many positions at a time.
LONG, BLOCK = 512, 65_536
#: Words counted in a task before they are handed on.
HELD_WORDS = 400_000


def held_out(modulus: int, remainder: int) -> Column:
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % modulus == remainder


class Lattice:
    """Unigram pieces: forward probabilities and expected counts of words, many words of one length at a time."""

    def __init__(self, pieces: list[str], logp: np.ndarray):
        self.pieces, self.logp = pieces, logp
        self.longest = max(map(len, pieces))
        keys = np.array([self._hash(p) for p in pieces], dtype=np.uint64)
        self.order = np.argsort(keys)
        self.keys = keys[self.order]
        self.byte = np.log(BYTE_SHARE / 256)

    BASE = 0x9E3779B97F4A7C15 | 1

    @classmethod
    def _hash(cls, piece: str) -> int:
        h = 0
        for c in piece:
            h = (h * cls.BASE + ord(c) + 1) % 2**64
        return h ^ (len(piece) << 57)

    def _edges(self, codes: np.ndarray) -> list[list[tuple[int, np.ndarray, np.ndarray]]]:
        """For each end j: (start i, piece id or -1, log probability) over the rows of codes (words x length)."""
        rows, length = codes.shape
        prefix = np.zeros((length + 1, rows), dtype=np.uint64)
        base = np.uint64(self.BASE)
        for j in range(length):
            prefix[j + 1] = prefix[j] * base + codes[:, j].astype(np.uint64) + np.uint64(1)
        power = [1]
        for _ in range(min(length, self.longest)):
            power.append(power[-1] * self.BASE % 2**64)
        n_bytes = 1 + (codes > 0x7F).astype(int) + (codes > 0x7FF) + (codes > 0xFFFF)
        out = []
        for j in range(1, length + 1):
            at_end = []
            for i in range(max(0, j - self.longest), j):
                h = (prefix[j] - prefix[i] * np.uint64(power[j - i])) ^ np.uint64((j - i) << 57)
                k = np.minimum(np.searchsorted(self.keys, h), len(self.keys) - 1)
                piece = np.where(self.keys[k] == h, self.order[k], -1)
                lp = np.where(piece >= 0, self.logp[piece], -np.inf)
                if j - i == 1:
                    lp = np.logaddexp(lp, n_bytes[:, i] * self.byte)
                elif not (piece >= 0).any():
                    continue
                at_end.append((i, piece, lp))
            out.append(at_end)
        return out

    def _long_edges(self, codes: np.ndarray, backwards: bool = False) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Of one word, block after block: (first end, piece ids, log probabilities); row j of a block holds the pieces of 1, 2, ... code points that end there."""
        base, width = np.uint64(self.BASE), min(self.longest, len(codes))
        n_bytes = 1 + (codes > 0x7F).astype(int) + (codes > 0x7FF) + (codes > 0xFFFF)
        for first in range(0, len(codes), BLOCK)[:: -1 if backwards else 1]:
            last, back = min(first + BLOCK, len(codes)), max(0, first - width)
            part = codes[back:last].astype(np.uint64) + np.uint64(1)
            ends = np.arange(first - back, last - back)
            pieces, lps = np.full((len(ends), width), -1), np.full((len(ends), width), -np.inf)
            h = np.zeros(len(part), dtype=np.uint64)  # of the piece that begins at each position, made longer by one code point a round
            for length in range(1, width + 1):
                h = h[: len(part) - length + 1] * base + part[length - 1 :]
                whole = ends >= length - 1
                key = h[ends[whole] - length + 1] ^ np.uint64(length << 57)
                k = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
                found = self.keys[k] == key
                pieces[whole, length - 1] = np.where(found, self.order[k], -1)
                lps[whole, length - 1] = np.where(found, self.logp[self.order[k]], -np.inf)
            lps[:, 0] = np.logaddexp(lps[:, 0], n_bytes[first:last] * self.byte)
            yield first, pieces, lps

    def _long_alpha(self, codes: np.ndarray) -> np.ndarray:
        width = min(self.longest, len(codes))
        alpha = np.full(len(codes) + 1 + width, -np.inf)  # width places before the first
        alpha[width] = 0
        for first, _, lps in self._long_edges(codes):
            for j in range(len(lps)):
                at = first + j + width  # pieces of 1, 2, ... code points begin at places at, at - 1, ...
                x = alpha[at - width + 1 : at + 1][::-1] + lps[j]
                top = x.max()
                alpha[at + 1] = top + np.log(np.exp(x - top).sum())
        return alpha[width:]

    def long_forward(self, codes: np.ndarray) -> float:
        """As `forward`, of one long word."""
        return float(self._long_alpha(codes)[-1])

    def long_expected(self, codes: np.ndarray, count: float) -> np.ndarray:
        """As `expected`, of one long word."""
        alpha, width = self._long_alpha(codes), min(self.longest, len(codes))
        beta = np.full(len(codes) + 1 + width, -np.inf)  # beta[j + width] of place j
        beta[-1] = 0
        out = np.zeros(len(self.pieces))
        for first, pieces, lps in self._long_edges(codes, backwards=True):
            for j in range(len(lps) - 1, -1, -1):
                end = first + j + 1
                into = beta[end : end + width][::-1]  # places end - 1, end - 2, ...
                np.logaddexp(into, lps[j] + beta[end + width], out=into)
            j, k = np.nonzero(pieces >= 0)
            start, end, used = first + j - k, first + j + 1, pieces[j, k]
            share = np.exp(alpha[start] + self.logp[used] + beta[end + width] - alpha[-1]) * count
            out += np.bincount(used, weights=share, minlength=len(out))
        return out

    def forward(self, codes: np.ndarray) -> np.ndarray:
        """Natural log of the marginal probability of each row."""
        if codes.shape[1] > LONG:
            return np.array([self.long_forward(row) for row in codes])
        alpha = self._forward(self._edges(codes), codes)
        return alpha[-1]

    @staticmethod
    def _forward(edges: list, codes: np.ndarray) -> np.ndarray:
        alpha = np.full((codes.shape[1] + 1, len(codes)), -np.inf)
        alpha[0] = 0
        for j, at_end in enumerate(edges, 1):
            for i, _, lp in at_end:
                alpha[j] = np.logaddexp(alpha[j], alpha[i] + lp)
        return alpha

    def expected(self, codes: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Expected number of uses of each piece in words that occur `counts` times."""
        if codes.shape[1] > LONG:
            return sum((self.long_expected(row, c) for row, c in zip(codes, counts, strict=True)), np.zeros(len(self.pieces)))
        edges = self._edges(codes)
        alpha = self._forward(edges, codes)
        beta = np.full(alpha.shape, -np.inf)
        beta[-1] = 0
        out = np.zeros(len(self.pieces))
        for j in range(codes.shape[1], 0, -1):
            for i, piece, lp in edges[j - 1]:
                beta[i] = np.logaddexp(beta[i], lp + beta[j])
                used = piece >= 0
                share = np.exp(alpha[i] + np.where(used, self.logp[piece], -np.inf) + beta[j] - alpha[-1]) * counts
                out += np.bincount(piece[used], weights=share[used], minlength=len(out))
        return out


def by_length(words: list[str], most: int = 20_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(positions, code-point matrix) for words of equal length, the word mark before each."""
    marked = ["▁" + w for w in words]
    sizes = np.fromiter(map(len, marked), dtype=np.int64, count=len(marked))
    flat = np.frombuffer("".join(marked).encode("utf-32-le"), dtype=np.uint32)
    first = np.cumsum(sizes) - sizes
    order = np.argsort(sizes, kind="stable")
    cuts = np.flatnonzero(np.diff(sizes[order])) + 1
    for group in np.split(order, cuts):
        length = int(sizes[group[0]]) if len(group) else 0
        step = max(1, min(most, 2_000_000 // max(1, length)))
        for k in range(0, len(group), step):
            part = group[k : k + step]
            yield part, flat[first[part][:, None] + np.arange(length)]


def vocabulary(model_file: str) -> tuple[list[str], np.ndarray]:
    """Pieces of an existing model (special and byte pieces aside), and starting log probabilities from their ranks."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=model_file)
    ids = [k for k in range(model.get_piece_size()) if not (model.is_control(k) or model.is_unknown(k) or model.is_byte(k) or model.is_unused(k))]
    pieces = [model.id_to_piece(k) for k in ids]
    rank = np.argsort(np.argsort([-model.get_score(k) for k in ids], kind="stable"))
    weight = 1 / (rank + 10.0)
    return pieces, np.log(weight / weight.sum() * (1 - BYTE_SHARE))


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, c): every word of all texts, with its count in those whose `trains` is true."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []

        def merged() -> pa.Table:
            t = pa.concat_tables(held).group_by("word").aggregate([("c", "sum")])
            return pa.table({"word": t.column("word"), "c": t.column("c_sum")})

        for batch in batches:
            for part in slices(batch):
                coded, counts = split_words(texts(part))
                trains = np.repeat(part.column("trains").to_numpy(zero_copy_only=False).astype(bool), counts)
                codes = coded.indices.to_numpy()
                held.append(pa.table({"word": coded.dictionary, "c": pa.array(np.bincount(codes[trains], minlength=len(coded.dictionary)), pa.int64())}))
                if sum(map(len, held)) > HELD_WORDS:
                    held = [merged()]
                    if len(held[0]) > HELD_WORDS // 2:
                        yield from held.pop().cast(schema).to_batches()
        if held:
            yield from merged().cast(schema).to_batches()

    schema = pa.schema([("word", pa.string()), ("c", pa.int64())])
    return docs.mapInArrow(count, "word string, c long").groupBy("word").agg(F.sum("c").alias("c"))


def fit(words: DataFrame, n_ends: int, pieces: list[str], logp: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, float]:
    """Piece log probabilities, and that of the end, after so many rounds over the training words. What returns to the driver is a number a piece."""
    end = 0.0
    for _ in range(rounds):
        model = Lattice(pieces, logp)

        def expect(batches: Iterator[pa.RecordBatch], model: Lattice = model) -> Iterator[pa.RecordBatch]:
            total = np.zeros(len(model.pieces))
            for batch in batches:
                counts = batch.column("c").to_numpy()
                for at, codes in by_length(batch.column("word").to_pylist()):
                    total += model.expected(codes, counts[at])
            used = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(total[used])], names=["piece", "n"])

        sums = words.where("c > 0").mapInArrow(expect, "piece long, n double").groupBy("piece").agg(F.sum("n").alias("n")).toPandas()
        n = np.full(len(pieces), FLOOR)
        n[sums["piece"].to_numpy(dtype=np.int64)] += sums["n"].to_numpy(dtype=float)
        total = n.sum() + n_ends + FLOOR
        logp, end = np.log(n / total * (1 - BYTE_SHARE)), float(np.log((n_ends + FLOOR) / total * (1 - BYTE_SHARE)))
    return logp, end


def word_scores(words: DataFrame, pieces: list[str], logp: np.ndarray) -> DataFrame:
    """(word, c, lp): lp is log10 of the word's probability over all segmentations."""
    model = Lattice(pieces, logp)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lp = np.zeros(batch.num_rows)
            for at, codes in by_length(batch.column("word").to_pylist()):
                lp[at] = model.forward(codes) / np.log(10)
            yield pa.RecordBatch.from_arrays([batch.column("word"), batch.column("c"), pa.array(lp)], names=["word", "c", "lp"])

    return words.select("word", "c").mapInArrow(score, "word string, c long, lp double")


def frequent(scored: DataFrame, most: int = MOST_WORDS, longest: int = MOST_BYTES) -> pa.Table:
    """The words above the lowest count at which no more than `most` remain: a table of bounded size for every task."""
    short = scored.where((F.octet_length("word") <= longest) & (F.col("c") > 0))
    sizes = short.groupBy(F.floor(F.log2("c") * 8).alias("k")).agg(F.count("*").alias("n"), F.min("c").alias("c")).orderBy(F.col("k").desc()).collect()  # some hundred rows
    least, total = None, 0
    for r in sizes:
        total += r["n"]
        if total > most:
            break
        least = r["c"]
    return short.where(F.col("c") >= (least or 2**62)).toArrow()


def scores(docs: DataFrame, model_file: str, trains: Column) -> DataFrame:
    """Per row of docs: doc_id, trained, n_tokens, n_known, train_tokens, base_score, score."""
    spark = docs.sparkSession
    rows = docs.select("doc_id", "text", trains.alias("trains"))
    words = written(word_counts(rows), "word-counts")
    n_ends = rows.where("trains").count()
    n_words, distinct = words.where("c > 0").agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    n, v = n_words + n_ends, distinct + (n_ends > 0)
    pieces, logp = vocabulary(model_file)
    logp, end = fit(words, n_ends, pieces, logp)
    scored = written(word_scores(words, pieces, logp), "word-scores")
    common = frequent(scored)
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, common.schema) as stream:
        stream.write_table(common)
    shared = spark.sparkContext.broadcast(sink.getvalue().to_pybytes())
    scale = n + 0.5 * (v + 1)

    def base_of(c: np.ndarray) -> np.ndarray:
        return np.log10((c + 0.5) / scale)

    rest_type = pa.list_(pa.struct([("word", pa.string()), ("tf", pa.int64())]))
    names = ["row", "doc_id", "trains", "n_tokens", "known", "base", "lp", "rest"]
    types = [pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), rest_type]

    def partly(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.ipc.open_stream(shared.value).read_all().combine_chunks()
        known = pa.array(table.column("word").combine_chunks().cast(pa.large_string()), pa.large_string())
        base, lp = base_of(table.column("c").to_numpy().astype(float)), table.column("lp").to_numpy()
        at = TaskContext.get().partitionId() << 36
        for batch in batches:
            for part in slices(batch):
                coded, counts = split_words(texts(part))
                place = pc.fill_null(pc.index_in(coded.dictionary, value_set=known), -1).to_numpy().astype(np.int64)
                codes = coded.indices.to_numpy().astype(np.int64)
                found = place >= 0
                each = [found.astype(np.int64), np.where(found, base[place], 0.0) if len(base) else np.zeros(len(place)), np.where(found, lp[place], 0.0) if len(lp) else np.zeros(len(place))]
                ends = np.cumsum(counts)
                sums = [np.diff(np.concatenate([[0], np.cumsum(x[codes])])[np.concatenate([[0], ends])]) for x in each]
                doc = np.repeat(np.arange(len(counts)), counts)
                rare = ~found[codes]
                pairs, tf = np.unique(doc[rare] * len(place) + codes[rare], return_counts=True) if rare.any() else (np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64))
                of, code = np.divmod(pairs, max(1, len(place)))
                offsets = np.searchsorted(of, np.arange(len(counts) + 1)).astype(np.int32)
                entries = pa.StructArray.from_arrays([coded.dictionary.take(pa.array(code)).cast(pa.string()), pa.array(tf, pa.int64())], fields=list(rest_type.value_type))
                rest = pa.ListArray.from_arrays(pa.array(offsets), entries)
                columns = [pa.array(at + np.arange(len(counts))), part.column("doc_id").cast(pa.int64()), part.column("trains"), pa.array(counts + 1), pa.array(sums[0]), pa.array(sums[1]), pa.array(sums[2]), rest.cast(rest_type)]
                at += len(counts)
                yield pa.RecordBatch.from_arrays([c.cast(t) for c, t in zip(columns, types, strict=True)], names=names)

    part = written(rows.mapInArrow(partly, "row long, doc_id long, trains boolean, n_tokens long, known long, base double, lp double, rest array<struct<word:string,tf:long>>"), "partly-scored")
    rare = part.select("row", F.explode("rest").alias("x")).select("row", "x.word", "x.tf")
    by_row = rare.join(scored, "word").groupBy("row").agg(
        F.sum(F.when(F.col("c") > 0, F.col("tf")).otherwise(0)).alias("known2"),
        F.sum(F.col("tf") * F.log10((F.col("c") + 0.5) / F.lit(scale))).alias("base2"),
        F.sum(F.col("tf") * F.col("lp")).alias("lp2"),
    )
    zero = F.lit(0)
    return part.drop("rest").join(by_row, "row", "left").select(
        "doc_id", "trains", "n_tokens",
        (F.col("known") + F.coalesce("known2", zero) + int(n_ends > 0)).cast("long").alias("n_known"), F.lit(n).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("base2", zero) + F.lit(float(base_of(np.array(float(n_ends)))))).alias("base_score"),
        (F.col("lp") + F.coalesce("lp2", zero) + F.lit(end / np.log(10))).alias("score"),
    )


def op5_lm_scoring(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = scores(docs, public_tokenizers.path("piece_bpe_32k.model"), ~held_out(5, 1))
    return found.select("doc_id", (~F.col("trains")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
