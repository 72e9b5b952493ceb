"""Top-k against all scores, on vectors with every kind of row that takes no part."""

import math

import pytest
from pyspark.sql import functions as F
from rolemesh.llm import exact_topk


def plain(rows, k, step):
    fine = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for i, q in fine:
        if i % step == 0:
            scored = sorted((-sum(a * b for a, b in zip(q, v)), j) for j, v in fine if j != i)[:k]
            out += [(i, n + 1, j, -s) for n, (s, j) in enumerate(scored)]
    return sorted(out)


@pytest.mark.parametrize("small", [False, True])
def test_top_k(spark, small, monkeypatch):
    if small:
        for name, value in (("BLOCK", 16), ("GROUP_BLOCKS", 2), ("QUERIES", 4), ("HEAD", 2)):
            monkeypatch.setattr(exact_topk, name, value)
    import random

    r = random.Random(5)
    rows = [(i, [r.gauss(0, 1 + (i % 7 == 0)) for _ in range(6)]) for i in range(300)]
    rows += [(i, [0.5, -0.25, 1.0, 0.0, 2.0, 3.0]) for i in range(300, 400)]  # one very common vector
    rows += [(401, None), (402, [float("nan")] * 6), (403, [None, *[1.0] * 5]), (404, [float("inf"), *[0.0] * 5]), (405, []), (406, [9.0]), (None, [1.0] * 6), (-50, [1.0] * 6), (7, rows[7][1])]
    table = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<double>, rank int").repartition(4)
    got = sorted(map(tuple, exact_topk.top_k(table, F.col("id") % 50 == 0).drop("exact").collect()))
    assert got == plain(rows, 10, 50)


def test_few_and_no_rows(spark):
    table = spark.createDataFrame([(0, [1.0]), (1, [2.0])], "vec_id long, embedding array<float>")
    assert [tuple(x)[:4] for x in exact_topk.top_k(table, F.col("id") == 0).collect()] == [(0, 1, 1, 2 * 1024 * 1024)]
    assert exact_topk.top_k(table.where("false"), F.col("id") == 0).count() == 0
    assert exact_topk.top_k(table, F.col("id") == 5).count() == 0


def test_short_groups_are_not_copied():
    """A query block that already has high thresholds needs vectors of some length."""
    import numpy as np

    v = np.array([[10.0, 0], [0, 10]])
    search = exact_topk.Search(np.array([1, 2]), v, np.eye(2), 1, np.array([500.0, 900.0]))
    assert 49 < exact_topk.needed(search) < 50  # 10 * 49 doesn't reach 500
    none_yet = exact_topk.Search(np.array([1, 2]), v, np.eye(2), 1, np.array([-np.inf, 900.0]))
    assert exact_topk.needed(none_yet) == -np.inf


@pytest.mark.parametrize("small", [False, True])
def test_scores_beyond_64_bits(spark, small, monkeypatch):
    """Components of any finite size: the order is that of exact sums, and what 64 bits can't hold is given as the nearest."""
    if small:
        for name, value in (("BLOCK", 4), ("GROUP_BLOCKS", 1), ("QUERIES", 4), ("HEAD", 1), ("LEAD", 2)):
            monkeypatch.setattr(exact_topk, name, value)
    big = [1e300, 2.0**60, 3e9, -1e300, 1.5e9, 2.0**52, 1.0, -0.1, 0.0]
    rows = [(k, [a, b]) for k, (a, b) in enumerate((a, b) for a in big for b in (1.0, -3.0, 2e9, -1e300))] + [(90, [1e300, 1.0]), (91, [1.0, 2.0]), (92, [-1.0, 2.0])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(2)
    whole = {i: [math.floor(x) * 1024 if abs(x) >= 2**53 else math.floor(1024 * x) for x in v] for i, v in rows}
    want = set()
    for i in range(0, 93, 9):
        if i in whole:
            scored = sorted((-sum(a * b for a, b in zip(whole[i], v, strict=True)), j) for j, v in whole.items() if j != i)[:5]
            want |= {(i, n + 1, j, max(min(-s, 2**63 - 1), -(2**63))) for n, (s, j) in enumerate(scored)}
    assert {tuple(r)[:4] for r in exact_topk.top_k(table, F.col("id") % 9 == 0, k=5).collect()} == want


def test_keys_are_in_the_order_of_scores():
    scores = sorted([*(s * (1 << k) + d for s in (-1, 1) for k in (62, 63, 64, 200, 2000) for d in (-1, 0, 1))])
    keys = [exact_topk.order_key(s) for s in scores if abs(s) >= 1 << 62]
    assert keys == sorted(keys) and exact_topk.order_key(7) is None


def test_two_rounds(spark, monkeypatch):
    """Vectors of very different lengths in many groups: the second round takes the first one's thresholds, and the answers are those of all pairs."""
    import random

    for name, value in (("BLOCK", 16), ("GROUP_BLOCKS", 1), ("QUERIES", 8), ("HEAD", 2), ("LEAD", 3)):
        monkeypatch.setattr(exact_topk, name, value)
    r = random.Random(2)
    rows = [(i, [r.gauss(0, 1) * 2 ** (-i / 40) for _ in range(5)]) for i in range(400)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    assert sorted(map(tuple, exact_topk.top_k(table, F.col("id") % 40 == 0, k=3).drop("exact").collect())) == plain(rows, 3, 40)
