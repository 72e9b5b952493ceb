"""Packing, token counts and token-id files against the tokenizers library run text by text."""

import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from rolemesh.llm import packing, token_counts, token_files
from tokenizers import Tokenizer

TEXTS = [(3, "The cat sat."), (1, ""), (2, None), (5, "word " * 5000), (5, "word " * 5000), (None, "no id"), (0, "It's 12,5 !'s\t\tÜber")]


def plain(name, end):
    t = Tokenizer.from_file(public_tokenizers.path(name))
    return lambda x: [*t.encode(x or "", add_special_tokens=False).ids, end]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", 0.5) for i, t in TEXTS]  # columns that clash with those of the operators
    return spark.createDataFrame(rows, "doc_id long, text string, ids string, start double").repartition(3)


@pytest.fixture(scope="module")
def none(docs):
    return docs.where("false")


def crc(ids):
    return zlib.crc32(np.array(ids, dtype="<u4").tobytes())


def test_packing(docs):
    got = packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), window=512).collect()
    encode, whole = plain("word_bpe_49k.json", 1), []
    for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):
        assert r.sequence_id * 512 + r.offset == len(whole)  # gapless, and only the last is short
        ids = np.frombuffer(r.ids, dtype="<u4").tolist()
        assert len(ids) == r.length > 0
        whole += ids
    assert len(whole) == sum(len(encode(t)) for _, t in TEXTS)
    assert sorted(whole) == sorted(i for _, t in TEXTS for i in encode(t))
    for doc, text in {(i, t) for i, t in TEXTS if i != 5}:
        parts = sorted((r.start, np.frombuffer(r.ids, dtype="<u4").tolist()) for r in got if r.doc_id == doc)
        assert [i for _, p in parts for i in p] == encode(text)


def test_packed_sequences(docs):
    pieces = packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), window=512)
    rows = packing.sequences(pieces, 512).collect()
    assert sum(r.padding for r in rows) < 512
    assert all(sum(p.length for p in r.pieces) == r.n_tokens for r in rows)


def test_packing_keeps_a_given_order(spark, tmp_path):
    spark.range(200).selectExpr("id doc_id", "concat('w', id) text").repartitionByRange(3, "doc_id").sortWithinPartitions("doc_id").write.parquet(str(tmp_path / "t"))
    table = spark.read.parquet(str(tmp_path / "t")).selectExpr("*", "_metadata.file_name f", "_metadata.row_index r")
    got = packing.pack(table, public_tokenizers.path("word_bpe_49k.json"), order=("f", "r")).orderBy("sequence_id", "offset").collect()
    assert [r.doc_id for r in got if r.start == 0] == list(range(200))


def test_nothing_to_pack(none):
    assert packing.pack(none, public_tokenizers.path("word_bpe_49k.json")).count() == 0


def test_token_files(spark, docs, tmp_path):
    path = str(tmp_path / "ids")
    token_files.write_ids(docs, path, public_tokenizers.path("byte_bpe_50k.json"), chunk_ids=100, block_ids=64)
    got = token_files.read_ids(spark, path).orderBy("start").collect()
    encode, at = plain("byte_bpe_50k.json", 2), 0
    want = sorted(TEXTS, key=lambda x: (x[0] is not None, x[0] or 0))
    assert [r.doc_id for r in got] == [i for i, _ in want]
    for r, (_, text) in zip(got, want, strict=True):
        assert (r.start, r.n_tokens, crc(np.frombuffer(r.ids, dtype="<u4"))) == (at, len(encode(text)), crc(encode(text)))
        at += r.n_tokens
    index = spark.read.parquet(path + "/index")
    assert index.selectExpr("sum(n_ids)", "sum(n_docs)").first()[:] == (at, len(TEXTS))


def test_no_token_files(spark, none, tmp_path):
    token_files.write_ids(none, str(tmp_path / "x"), public_tokenizers.path("byte_bpe_50k.json"))
    assert token_files.read_ids(spark, str(tmp_path / "x")).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2**32 - 1), max_size=300), st.integers(1, 70))
def test_planes_round_trip(ids, block):
    ids = np.array(ids, dtype="<u4")
    assert token_files.from_planes(token_files.to_planes(ids, block)).tolist() == ids.tolist()


def test_token_counts(docs):
    lengths = token_counts.token_lengths(docs, public_tokenizers.path("byte_bpe_50k.json"), True, 2)
    encode = plain("byte_bpe_50k.json", 2)
    want = [len(encode(t)) for _, t in TEXTS]
    histogram = token_counts.length_histogram(lengths)
    curve = token_counts.limit_curve(histogram)
    for r in curve.collect():
        assert r.n_docs == want.count(r.length)
        assert r.docs_over == sum(n > r.length for n in want)
        assert r.kept_tokens == sum(min(n, r.length) for n in want) == sum(want) - r.cut_tokens
        assert r.share_within == pytest.approx(sum(n <= r.length for n in want) / len(want))
    for r in token_counts.at_limits(histogram, [1, 4, 10**6]).collect():
        assert r.kept_tokens == sum(min(n, r.context_limit) for n in want)
        assert r.docs_over == sum(n > r.context_limit for n in want)
    assert {r.share: r.length for r in token_counts.quantiles(curve, [0.5, 1.0]).collect()} == {0.5: sorted(want)[3], 1.0: max(want)}


def test_no_token_counts(none):
    curve = token_counts.limit_curve(token_counts.length_histogram(token_counts.token_lengths(none, public_tokenizers.path("byte_bpe_50k.json"), True)))
    assert curve.count() == 0
