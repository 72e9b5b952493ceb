"""Quality classifier by positive-unlabelled learning.

Trusted positives and unlabelled web text give an unbiased estimate of the risk of a classifier;
where its part for the negatives falls below zero, it is set to zero (non-negative risk), which
keeps a flexible model from fitting the positives away. The class prior is estimated from the same
two samples: among the texts that a first model finds most positive, unlabelled texts are as dense
as positives times the prior.

Features are shares and means over a whole text (letters, capitals, digits, marks, repeated
words, line and word lengths), and the shares of its words and of its byte trigrams in hashed buckets, taken once
for every document in one pass; what is fitted is a linear model on a bounded sample (about `MOST_ROWS`
positives and as many unlabelled texts at most, chosen by a hash; see `sampled`). Labels, lang, source
and doc_id are not inputs of a score.

Defined cases: null and empty texts have all features 0 and a score as any other; very long texts are
measured whole; repeated rows are each scored; without positive or unlabelled training rows every score is the prior of 0.5;
an empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rolemesh.llm.common import hashes, slices, split_words, texts, written

MOST_ROWS = 20_000
#: Kinds of bytes that are counted; a byte belongs to the first kind that has it.
KINDS = {
    "upper": [*range(0x41, 0x5B)],
    "lower": [*range(0x61, 0x7B)],
    "digit": [*range(0x30, 0x3A)],
    "space": [0x20, *range(0x09, 0x0E)],
    "symbol": [*b"#*$%&|<>"],
    "exclaim": [*b"!?"],
    "stop": [*b".,;:'\"-()"],
    "ascii": [*range(0x80)],
    "start": [*range(0xC0, 0x100)],
    "inside": [*range(0x80, 0xC0)],
}
#: Buckets of hashed words and of hashed byte trigrams.
BUCKETS = 64
TABLE = np.zeros(256, dtype=np.uint8)
for _n, _bytes in reversed(list(enumerate(KINDS.values()))):
    TABLE[_bytes] = _n
NAMES = [*(f"{k}_share" for k in KINDS), "capital_share", "distinct_share", "twice_share", "word_length", "words_a_line", "marked_words", "length", *(f"word_{k}" for k in range(BUCKETS)), *(f"bytes_{k}" for k in range(BUCKETS))]


#: Features before the hashed ones; the hashed ones count for less by so much; folds of the rows from which the prior is read.
SHARES, HASHED, FOLDS = len(NAMES) - 2 * BUCKETS, 4.0, 4


def features_of(array: pa.Array) -> np.ndarray:
    """A row of features for each text."""
    n = len(array)
    if not n:
        return np.zeros((0, len(NAMES)), dtype=np.float32)
    _, offsets, data = array.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[: n + 1]
    raw = np.frombuffer(data, dtype=np.uint8)[: at[-1]] if data is not None else np.zeros(0, dtype=np.uint8)
    kinds = TABLE[raw]
    doc = np.repeat(np.arange(n), np.diff(at))
    counts = np.bincount(doc * len(KINDS) + kinds, minlength=n * len(KINDS)).reshape(n, -1).astype(float)
    size = np.maximum(counts.sum(axis=1), 1)
    of = dict(zip(KINDS, counts.T, strict=True))
    letters = np.maximum(of["upper"] + of["lower"], 1)
    coded, words = split_words(array, lower=False)
    codes, many = coded.indices.to_numpy().astype(np.int64), np.maximum(words, 1)
    of_word = np.repeat(np.arange(n), words)
    distinct = np.bincount(np.unique(of_word * (len(coded.dictionary) + 1) + codes) // (len(coded.dictionary) + 1), minlength=n)
    twice = np.bincount(of_word[1:][(codes[1:] == codes[:-1]) & (of_word[1:] == of_word[:-1])], minlength=n)
    marked = pc.match_substring_regex(coded.dictionary, "[#*$%&|<>!]").to_numpy(zero_copy_only=False)
    lines = pc.count_substring(array, "\n").to_numpy() + 1
    bucket = (hashes(coded.dictionary) % np.uint64(BUCKETS)).astype(np.int64)
    hashed = np.bincount(of_word * BUCKETS + bucket[codes], minlength=n * BUCKETS).reshape(n, -1) / many[:, None]
    three = (raw[:-2].astype(np.uint32) * 961 + raw[1:-1].astype(np.uint32) * 31 + raw[2:]) * np.uint32(2654435761) >> np.uint32(26) if len(raw) > 2 else np.zeros(0, dtype=np.uint32)
    one_text = doc[: len(three)] == doc[2:]
    grams = np.bincount(doc[: len(three)][one_text] * BUCKETS + three[one_text], minlength=n * BUCKETS).reshape(n, -1) / size[:, None]
    return np.column_stack([
        *(counts / size[:, None]).T, of["upper"] / letters, distinct / many, twice / many,
        np.minimum((size - of["space"]) / many, 60) / 10, np.log1p(words / lines), np.bincount(of_word[marked[codes]], minlength=n) / many, np.log1p(size) / 10, hashed, grams,
    ]).astype(np.float32)


def features(docs: DataFrame) -> DataFrame:
    """(doc_id, f): the features of every whole text."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                rows = features_of(texts(part))
                f = pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1) * len(NAMES), pa.int32()), pa.array(rows.ravel()))
                yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.int64()), f], names=["doc_id", "f"])

    return docs.select("doc_id", "text").mapInArrow(measure, "doc_id long, f array<float>")


@dataclass(frozen=True)
class Model:
    """score = 1 / (1 + exp(-(w . (f - mean) / scale + b)))"""

    mean: np.ndarray
    scale: np.ndarray
    w: np.ndarray
    b: float
    prior: float


def _descend(gradient, width: int, steps: int = 400, rate: float = 0.05) -> np.ndarray:
    """Adam from zero."""
    theta, m, v = np.zeros(width), np.zeros(width), np.zeros(width)
    for t in range(1, steps + 1):
        g = gradient(theta)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        theta = theta - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return theta


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def estimated_prior(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """Ratio of the shares above a threshold, at the threshold with the least upper confidence bound of that ratio.

    The least of many noisy ratios would be too low on small samples; the bound prefers thresholds that keep many rows of both.
    """
    noise = sum(np.sqrt(np.log(40) / (2 * len(x))) for x in (positive, unlabelled))
    shares = [((unlabelled >= c).mean(), max((positive >= c).mean(), 1e-9)) for c in np.quantile(positive, np.linspace(0.01, 0.9, 90))]
    u, p = min(shares, key=lambda s: (s[0] + noise) / s[1])
    return float(np.clip(u / p, 0.05, 0.98))


def fit(positive: np.ndarray, unlabelled: np.ndarray, penalty: float = 1e-2) -> Model:
    """Linear model of least non-negative risk (logistic loss). The prior is read from scores of rows that the scoring model didn't see."""
    both = np.concatenate([positive, unlabelled])
    mean, scale = both.mean(axis=0), np.maximum(both.std(axis=0), 1e-6)
    scale[SHARES:] *= HASHED
    p, u = (np.column_stack([np.clip((x - mean) / scale, -8, 8), np.ones(len(x))]) for x in (positive, unlabelled))
    fold_p, fold_u = (np.arange(len(x)) % FOLDS for x in (p, u))
    seen_p, seen_u = np.zeros(len(p)), np.zeros(len(u))
    for k in range(FOLDS):
        a, b = p[fold_p != k], u[fold_u != k]
        if not len(a) or not len(b):
            continue

        def apart(theta: np.ndarray, a: np.ndarray = a, b: np.ndarray = b) -> np.ndarray:  # positives from unlabelled
            return -(a.T @ _sigmoid(-a @ theta)) / len(a) + b.T @ _sigmoid(b @ theta) / len(b) + penalty * theta

        first = _descend(apart, p.shape[1])
        seen_p[fold_p == k], seen_u[fold_u == k] = p[fold_p == k] @ first, u[fold_u == k] @ first
    prior = estimated_prior(seen_p, seen_u)

    def risk(theta: np.ndarray) -> np.ndarray:
        yp, yu = p @ theta, u @ theta
        on_p = -(p.T @ _sigmoid(-yp)) / len(p)  # positives as positives
        as_negative = u.T @ _sigmoid(yu) / len(u) - prior * (p.T @ _sigmoid(yp)) / len(p)
        value = np.logaddexp(0, yu).mean() - prior * np.logaddexp(0, yp).mean()
        regular = penalty * np.append(theta[:-1], 0)
        return prior * on_p + as_negative + regular if value >= 0 else regular - as_negative  # a negative part below zero is climbed back alone

    theta = _descend(risk, p.shape[1])
    return Model(mean, scale, theta[:-1], float(theta[-1]), prior)


def sampled(rows: DataFrame, most: int) -> np.ndarray:
    """Features of about `most` rows at most, those of least hash of doc_id and features, however many rows there are. Equal rows come together, so that a second bound holds what many of them may add."""
    n = rows.count()
    hashed = rows.select(F.xxhash64("doc_id", "f").alias("h"), "f")
    part = hashed if n <= most else hashed.where(F.col("h") < F.lit(-(1 << 63) + (most << 64) // n)).orderBy("h").limit(2 * most)
    table = part.toArrow().sort_by("h").column("f").combine_chunks()  # in the same order wherever rows lay
    return table.flatten().to_numpy().astype(float).reshape(-1, len(NAMES))


def train(measured: DataFrame, labels: DataFrame, trains: Column, most: int = MOST_ROWS) -> Model | None:
    """From rows for which `trains` holds (a condition on doc_id): quality 1 is a trusted positive, a document without a label is unlabelled."""
    marks = labels.where(trains).select("doc_id", "quality")
    positive = sampled(measured.join(marks.where("quality = 1").select("doc_id").distinct(), "doc_id", "left_semi"), most)
    unlabelled = sampled(measured.where(trains).join(labels.select("doc_id"), "doc_id", "left_anti"), most)
    return fit(positive, unlabelled) if len(positive) and len(unlabelled) else None


def score(measured: DataFrame, model: Model | None) -> DataFrame:
    """(doc_id, score): probability of good quality, by column functions on the features."""
    if model is None:
        return measured.select("doc_id", F.lit(0.5).alias("score"))
    at = [F.array(*[F.lit(float(x)) for x in v]) for v in (model.mean, model.scale, model.w)]
    terms = F.transform("f", lambda x, i: F.least(F.lit(8.0), F.greatest(F.lit(-8.0), (x.cast("double") - F.get(at[0], i)) / F.get(at[1], i))) * F.get(at[2], i))
    total = F.aggregate(terms, F.lit(model.b), lambda a, x: a + x)
    return measured.select("doc_id", (1 / (1 + F.exp(-total))).alias("score"))


def op8_quality_classifier(spark, sf_dir: str) -> DataFrame:
    held = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 3 == 1
    measured = written(features(spark.read.parquet(f"{sf_dir}/documents.parquet")), "features")
    model = train(measured, spark.read.parquet(f"{sf_dir}/labels.parquet"), ~held)
    return score(measured, model).select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
