"""Schedules against their definition, and placed rows against a plain walk."""

import random
from collections import Counter

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from rolemesh.llm import mixing


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 12), min_size=1, max_size=7))
def test_less_than_one_block_from_the_share(ws):
    weights = {f"s{k}": w for k, w in enumerate(ws)}
    q, places = sum(ws), mixing.period(weights)
    assert sorted(p for x in places.values() for p in x) == list(range(q))
    for t in range(q + 1):
        for s, w in weights.items():
            assert abs(sum(p < t for p in places[s]) - t * w / q) < 1


@settings(max_examples=100, deadline=None)
@given(st.dictionaries(st.sampled_from("abcde"), st.integers(0, 5), min_size=1), st.dictionaries(st.sampled_from("abcdef"), st.integers(0, 40)))
def test_phases_place_every_block_once(weights, blocks):
    slots = []
    for p in mixing.phases(weights, blocks):
        for b in range(p["first"], p["last"] + 1):
            k = b - p["first"]
            slots.append((p["base"] + k // p["weight"] * p["period"] + p["places"][k % p["weight"]], p["source"], b))
    assert sorted(s for s, _, _ in slots) == list(range(sum(blocks.values())))
    assert Counter(s for _, s, _ in slots) == Counter({s: n for s, n in blocks.items() if n})
    for s in blocks:
        own = [b for _, x, b in sorted(slots) if x == s]
        assert own == list(range(blocks[s]))


def rows(seed=1):
    r = random.Random(seed)
    out = [(i, "x" * r.choice([0, 1, 50, 400]), r.choice(["a", "a", "a", "b", "c", None, "z"]), 1) for i in range(3000)]
    return [*out, (5, None, "a", 2), (5, None, "a", 2), (None, "yy", "b", 3)]


def test_rows(spark, monkeypatch):
    monkeypatch.setattr(mixing, "RANGE_ROWS", 100)
    weights = {"a": 5, "b": 3, mixing.OTHER: 2}
    docs = spark.createDataFrame(rows(), "doc_id long, text string, source string, slot int").repartition(4)
    got = mixing.scheduled(docs, weights, 1000, F.length("text")).collect()
    assert len(got) == len(rows())
    upto = Counter()
    for r in sorted(got, key=lambda r: (r["_slot"], r["_start"])):
        c = r["_class"]
        assert r["_start"] == upto[c] and r["_block"] == upto[c] // 1000
        upto[c] += max(1, len(r["text"] or ""))
    first = {}
    for r in got:
        first.setdefault(r["_slot"], set()).add(r["_class"])
    assert all(len(c) == 1 for c in first.values())
    until = min(max(r["_slot"] for r in got if r["_class"] == c) for c in weights)
    for t in range(until):
        for c, w in weights.items():
            assert abs(sum(s < t and c in x for s, x in first.items()) - t * w / 10) <= 1 + 1e-9  # a block may hold no document's start


def test_mixed_order_is_that_of_the_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(mixing, "RANGE_ROWS", 100)
    docs = spark.createDataFrame(rows(), "doc_id long, text string, source string, slot int").repartition(4)
    weights = {"a": 5, "b": 3, mixing.OTHER: 2}
    mixing.mixed(docs, weights, 1000).write.parquet(str(tmp_path / "m"))
    back = spark.read.parquet(str(tmp_path / "m"))
    assert back.columns == docs.columns
    got = back.orderBy("_metadata.file_name", "_metadata.row_index").collect()
    want = mixing.scheduled(docs, weights, 1000, F.length("text")).orderBy("_slot", "_start").collect()
    assert [(r.doc_id, r.text, r.source) for r in got] == [(r.doc_id, r.text, r.source) for r in want]


def test_no_rows(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, source string")
    assert mixing.mixed(docs, mixing.WEIGHTS, 10).count() == 0


def test_each_unnamed_source_has_its_share(spark, tmp_path, monkeypatch):
    """Weights are kept to within less than one block, that of OTHER too, and a hot source that they don't name takes no more of OTHER's turns than the others."""
    monkeypatch.setattr(mixing, "BLOCK_CHARS", 500)
    of = [*["hot"] * 20, "rare", "rare", None, None, *["src0"] * 4, "src1", "src1", "src2", "src3"]
    spark.createDataFrame([(i, "x" * 50, of[i % len(of)]) for i in range(3200)], "doc_id long, text string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    got = mixing.op3_mixing(spark, str(tmp_path)).collect()
    assert len(got) == 3200
    slots = {}
    for r in got:
        slots.setdefault(r.source_class, set()).add(r.slot)
    assert set(slots) == {"src0", "src1", "src2", "src3", "hot", "rare", mixing.OTHER}
    assert sum(map(len, slots.values())) == len(set().union(*slots.values()))  # a slot is one stream's
    unnamed = [slots[s] for s in ("hot", "rare", mixing.OTHER)]
    weights = {s: (mixing.WEIGHTS[s], slots[s]) for s in ("src0", "src1", "src2", "src3")} | {"": (mixing.WEIGHTS[mixing.OTHER], set().union(*unnamed))}
    for t in range(min(max(x) for _, x in weights.values())):
        for w, x in weights.values():
            assert abs(sum(p < t for p in x) - t * w / 20) < 1
        if all(max(x) >= t for x in unnamed):
            turns = [sum(p < t for p in x) for x in unnamed]
            assert all(abs(x - sum(turns) / 3) < 1 for x in turns)


def test_rounds_equal_taking_turns(spark):
    r = random.Random(8)
    for sizes in ([3, 0, 5, 5, 1], [r.choice([1, 2, 7, 30]) for _ in range(40)], [4]):
        left, order, j = {f"s{k:02}": n for k, n in enumerate(sizes) if n}, [], 0
        while any(n > j for n in left.values()):
            order += [(s, j) for s in sorted(left, key=lambda s: (-left[s], s)) if left[s] > j]
            j += 1
        some = [x for x in order if r.random() < 0.7] or order  # a long document leaves blocks without a start
        got = mixing.rounds(spark.createDataFrame(some, "stream string, block long"), spark.createDataFrame(list(left.items()), "stream string, blocks long")).collect()
        assert {(x.stream, x.block): x.turn for x in got} == {x: n for n, x in enumerate(order) if x in set(some)}


def test_very_many_sources(spark):
    """Nothing on the driver grows with the sources: 20,000 of them, most with one row."""
    docs = spark.range(30_000).selectExpr("id AS doc_id", "'x' AS text", "concat('s', id % 20000) AS source")
    got = mixing.scheduled(docs, {"s0": 1, mixing.OTHER: 1}, 1, F.length("text"), apart=True)
    assert got.count() == got.select("_slot").distinct().count() == 30_000
    assert got.agg(F.max("_slot")).first()[0] == 29_999


def test_very_long_texts_keep_their_places(spark):
    docs = spark.createDataFrame([(k, "é" * n, s) for k, (n, s) in enumerate([(3_000_000, "a"), (5, "a"), (2_000_000, "z"), (7, "z"), (9, None), (4, "b")])], "doc_id long, text string, source string")
    got = mixing.scheduled(docs, {"a": 1, "b": 1, mixing.OTHER: 1}, 100_000, F.length("text"), apart=True).collect()
    assert sorted(r["_start"] for r in got if r["_class"] == "a") in ([0, 5], [0, 3_000_000])
    slots = {}
    for r in got:
        slots.setdefault(r["_slot"], set()).add((r["_class"], r["_block"]))
    assert all(len(x) == 1 for x in slots.values()) and len(got) == 6
