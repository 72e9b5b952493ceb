import pyarrow as pa
import re
from rolemesh.llm.common import slices, split_words, texts


def test_slices_hold_every_text_whole():
    rows = [None if k % 7 == 3 else f"Ü{k} " * (k % 50) for k in range(3000)]
    batch = pa.RecordBatch.from_arrays([pa.array(rows, pa.string())], names=["text"])
    parts = [texts(p) for p in slices(batch, most=10_000)]
    assert len(parts) > 10
    for p in parts:
        p.validate(full=True)
    assert [t for p in parts for t in p.to_pylist()] == [r or "" for r in rows]


def test_words():
    rows = ["", "  ", "A\tb\x0bÉ\x1c c d ", "\nx"]
    coded, counts = split_words(pa.array(rows, pa.large_string()))
    low = [re.findall("[^\\x20\\x09-\\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in r)) for r in rows]
    assert coded.to_pylist() == [w for x in low for w in x]
    assert counts.tolist() == [len(x) for x in low]


def test_running_and_ranked(spark):
    import random

    from pyspark.sql import functions as F
    from rolemesh.llm.common import ranked, running

    r = random.Random(3)
    rows = [(k, r.randrange(20), r.choice([None, 1, 5])) for k in range(500)]
    df = spark.createDataFrame(rows, "k long, v long, x long").repartition(3)
    got = {q.k: (q.total, q.most) for q in running(df, "t", [F.col("v").desc(), F.col("k")], total=(F.sum, F.col("x")), most=(F.max, F.col("x"))).collect()}
    seen = []
    for k, _, x in sorted(rows, key=lambda q: (-q[1], q[0])):
        seen += [x] if x is not None else []
        assert got[k] == ((sum(seen), max(seen)) if seen else (None, None))
    places = {q.k: q.id for q in ranked(df, "t", F.desc("v"), "k").collect()}
    assert places == {k: n for n, (k, *_) in enumerate(sorted(rows, key=lambda q: (-q[1], q[0])))}
    assert ranked(df.where("false"), "t", "k").count() == 0


def test_stages_delete_only_what_the_stage_before_wrote(spark):
    import os
    import threading

    from rolemesh.llm import common

    made = {}

    def keeps(name):
        def f(spark, docs, sf_dir):
            common.written(spark.range(3), f"own-{name}")
            made[name] = common._TABLES.now[-1]
            return docs

        return f

    one, two, last = common.stage(first=True)(keeps("one")), common.stage(keeps("two")), common.stage(keeps("last"))
    there = lambda name: os.path.exists(made[name].removeprefix("file:"))
    docs = spark.range(2)
    one(spark, docs, "")
    two(spark, docs, "")
    assert not there("one") and there("two")
    other = threading.Thread(target=lambda: (common.stage(first=True)(keeps("their first"))(spark, docs, ""), common.stage(keeps("their second"))(spark, docs, "")))
    other.start()
    other.join()
    assert there("two") and there("their second") and not there("their first")
    last(spark, docs, "")
    assert not there("two") and there("last")
    one(spark, docs, "")  # another pipeline may begin while the last one's result isn't read yet
    assert there("last")
