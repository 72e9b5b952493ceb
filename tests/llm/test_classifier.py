"""Held-out accuracy on the supplied labels, and the prior and risk on made-up classes."""

import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from rolemesh.llm import quality_classifier as qc

DATA = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    got = qc.op8_quality_classifier(spark, DATA).join(spark.read.parquet(f"{DATA}/labels.parquet"), "doc_id").where("held_out").toPandas()
    assert (got.predicted == got.quality).mean() > 0.95
    ranks, good = got.score.rank(), got.quality == 1
    assert (ranks[good].sum() - good.sum() * (good.sum() + 1) / 2) / (good.sum() * (~good).sum()) > 0.95
    assert got.score.between(0, 1).all()


@pytest.mark.parametrize("prior", [0.3, 0.6, 0.85])
def test_prior_and_risk(prior):
    r = np.random.default_rng(1)
    positive = r.normal(2, 1, (4000, 3))
    is_good = r.random(6000) < prior
    unlabelled = np.where(is_good[:, None], r.normal(2, 1, (6000, 3)), r.normal(-2, 1, (6000, 3)))
    model = qc.fit(positive, unlabelled)
    assert abs(model.prior - prior) < 0.06
    said = ((unlabelled - model.mean) / model.scale) @ model.w + model.b > 0
    assert (said == is_good).mean() > 0.97


def test_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, 1.0), (1, "", 2.0), (None, "a b" * 100, 3.0), (4, "\x00 \U0001f642", None)], "doc_id long, text string, f double")
    measured = qc.features(docs)
    assert [len(r.f) for r in measured.collect()] == [len(qc.NAMES)] * 4
    assert all(np.isfinite(r.f).all() for r in measured.collect())
    assert [r.score for r in qc.score(measured, None).collect()] == [0.5] * 4
    assert qc.features(docs.where("false")).count() == 0
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert qc.train(measured, none, F.lit(True)) is None


def plain_fit(p, u):
    """The same risk, term by term: features in units of their spread, a prior from scores of folds that were left out, Adam on the non-negative risk."""
    both = np.concatenate([p, u])
    scale = np.maximum(both.std(axis=0), 1e-6)
    scale[qc.SHARES :] *= qc.HASHED
    z = [np.hstack([np.clip((x - both.mean(axis=0)) / scale, -8, 8), np.ones((len(x), 1))]) for x in (p, u)]
    squash = lambda x: 1 / (1 + np.exp(-np.clip(x, -40, 40)))

    def adam(gradient):
        x, m, v = (np.zeros(z[0].shape[1]) for _ in range(3))
        for t in range(1, 401):
            g = gradient(x)
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g**2
            x = x - 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        return x

    seen = [np.zeros(len(x)) for x in z]
    for k in range(qc.FOLDS):
        kept = [x[np.arange(len(x)) % qc.FOLDS != k] for x in z]
        x = adam(lambda w, a=kept[0], b=kept[1]: np.mean(-squash(-a @ w)[:, None] * a, axis=0) + np.mean(squash(b @ w)[:, None] * b, axis=0) + 1e-2 * w)
        for at, rows in zip(seen, z, strict=True):
            left = np.arange(len(rows)) % qc.FOLDS == k
            at[left] = rows[left] @ x
    noise = sum(np.sqrt(np.log(40) / (2 * len(x))) for x in seen)
    shares = [(np.mean(seen[1] >= c), max(np.mean(seen[0] >= c), 1e-9)) for c in np.quantile(seen[0], np.linspace(0.01, 0.9, 90))]
    a, b = min(shares, key=lambda s: (s[0] + noise) / s[1])
    prior = np.clip(a / b, 0.05, 0.98)

    def risk(w):
        sp, su = z[0] @ w, z[1] @ w
        penalty = 1e-2 * np.append(w[:-1], 0)
        negative = np.mean(squash(su)[:, None] * z[1], axis=0) - prior * np.mean(squash(sp)[:, None] * z[0], axis=0)
        if np.mean(np.logaddexp(0, su)) - prior * np.mean(np.logaddexp(0, sp)) < 0:
            return penalty - negative
        return prior * np.mean(-squash(-sp)[:, None] * z[0], axis=0) + negative + penalty

    w = adam(risk)
    return lambda f: squash(np.clip((f - both.mean(axis=0)) / scale, -8, 8) @ w[:-1] + w[-1])


def test_scores_equal_a_plain_run(spark):
    """The query on all of the smallest tables against NumPy alone; however its rows lie."""
    data = "/root/testdata/sf0.001"
    docs, labels = (spark.read.parquet(f"{data}/{t}.parquet").toPandas() for t in ("documents", "labels"))
    f = {d: x for d, x in zip(docs.doc_id, qc.features_of(pa.array(docs.text.tolist(), pa.large_string())).astype(float), strict=True)}
    trains = {d for d in docs.doc_id if zlib.crc32(str(d).encode()) % 3 != 1}
    good, marked = set(labels.doc_id[labels.quality == 1]), set(labels.doc_id)
    hashed = {r.doc_id: r.h for r in qc.features(spark.read.parquet(f"{data}/documents.parquet")).select("doc_id", F.xxhash64("doc_id", "f").alias("h")).collect()}
    rows = [np.array([f[d] for d in sorted(some, key=hashed.get)]) for some in (trains & good, trains - marked)]
    want = plain_fit(*rows)
    for parts in ("2", "9"):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        got = {r.doc_id: (r.score, r.predicted, r.held_out) for r in qc.op8_quality_classifier(spark, data).collect()}
        assert len(got) == len(docs)
        for d, x in f.items():
            score = float(want(x))
            assert abs(got[d][0] - score) < 1e-6 and got[d][2] == (d not in trains)
            assert abs(score - 0.5) < 1e-6 or got[d][1] == (score >= 0.5)
    spark.conf.set("spark.sql.shuffle.partitions", "8")
