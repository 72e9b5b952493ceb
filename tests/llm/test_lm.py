"""Lattice scores against a plain recursion, counts and base scores against a plain count."""

import math
import re
import zlib
from collections import Counter
from functools import cache

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from rolemesh.llm import lm_scoring as lm

PIECES = ["▁", "▁a", "a", "b", "ab", "▁ab", "ba", "abab", "é"]
LOGP = np.log(np.array([0.1, 0.1, 0.2, 0.2, 0.1, 0.1, 0.1, 0.05, 0.05]))


def all_segmentations(word, model):
    table = dict(zip(model.pieces, model.logp, strict=True))

    @cache
    def p(text):
        if not text:
            return 1.0
        total = sum(math.exp(table[text[:k]]) * p(text[k:]) for k in range(1, len(text) + 1) if text[:k] in table)
        return total + math.exp(model.byte * len(text[0].encode())) * p(text[1:])

    return p("▁" + word)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="abéx🙂", max_size=9), min_size=1, max_size=8))
def test_marginal_likelihood(words):
    model = lm.Lattice(PIECES, LOGP)
    for at, codes in lm.by_length(words):
        for k, got in zip(at, model.forward(codes), strict=True):
            assert math.exp(got) == pytest.approx(all_segmentations(words[k], model), rel=1e-9)


def test_expected_counts_are_the_gradient():
    model, words, counts = lm.Lattice(PIECES, LOGP), ["abab", "ba", "x"], np.array([3, 1, 2])
    got = sum(model.expected(codes, counts[at]) for at, codes in lm.by_length(words))
    for k in range(len(PIECES)):
        def total(step, k=k):
            moved = lm.Lattice(PIECES, LOGP + step * (np.arange(len(PIECES)) == k))
            return sum((moved.forward(c) * counts[at]).sum() for at, c in lm.by_length(words))
        assert got[k] == pytest.approx((total(1e-5) - total(-1e-5)) / 2e-5, abs=1e-4)


TEXTS = [(k, t) for k, t in enumerate(["The cat sat the", "", None, "A\tcat\x0b cat", "zzz " * 300, "Über é 🙂", "x" * 500, "the cat sat", "the the cat"])] + [(3, "again A\tcat"), (None, "no id cat")]


def plain_words(text):
    return re.findall("[^\\x20\\x09-\\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


@pytest.mark.parametrize("most", [400_000, 2])
def test_scores(spark, most, monkeypatch):
    monkeypatch.setattr(lm.frequent, "__defaults__", (most, 32))
    docs = spark.createDataFrame([(i, t, "x", 1.0) for i, t in TEXTS], "doc_id long, text string, word string, score double").repartition(3)
    got = lm.scores(docs, public_tokenizers.path("piece_bpe_32k.model"), ~lm.held_out(5, 1)).collect()
    out = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 5 == 1
    counts = Counter(w for i, t in TEXTS if not out(i) for w in [*plain_words(t), 0])
    n, v = sum(counts.values()), len(counts)
    want = Counter()
    for i, t in TEXTS:
        tokens = [*plain_words(t), 0]
        base = sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in tokens)
        want[i, not out(i), len(tokens), sum(counts[w] > 0 for w in tokens), n, round(base, 6)] += 1
    assert Counter((r.doc_id, r.trains, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
    assert all(-1e5 < r.score < 0 for r in got)


def test_no_rows(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert lm.scores(docs, public_tokenizers.path("piece_bpe_32k.model"), ~lm.held_out(5, 1)).count() == 0


def test_long_words(monkeypatch):
    """Words beyond LONG are scored by blocks of positions, with the same probabilities and expected counts."""
    model = lm.Lattice(PIECES, LOGP)
    codes = np.array([ord(c) for c in "▁" + "abébab🙂a" * 40], dtype=np.uint32)
    want, counts = model.forward(codes[None, :])[0], model.expected(codes[None, :], np.array([2.0]))
    for block in (7, 64, 65_536):
        monkeypatch.setattr(lm, "BLOCK", block)
        assert model.long_forward(codes) == pytest.approx(want, rel=1e-12)
        assert model.long_expected(codes, 2.0) == pytest.approx(counts, abs=1e-9)


def test_scores_are_sums_over_words_and_the_end(spark):
    """A text's score is the sum of its words' log probabilities by the fitted lattice, and that of the end."""
    from pyspark.sql import functions as F

    path = public_tokenizers.path("piece_bpe_32k.model")
    texts = ["the cat sat", "the dog", None, "", "x" * 700 + " the", "The THE the", "🙂 never seen"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: r.score for r in lm.scores(docs, path, F.col("doc_id") < 5).collect()}
    words = lm.word_counts(docs.select("doc_id", "text", (F.col("doc_id") < 5).alias("trains")))
    pieces, start = lm.vocabulary(path)
    logp, end = lm.fit(words, 5, pieces, start)
    model = lm.Lattice(pieces, logp)

    def of(word):
        return model.forward(np.array([[ord(c) for c in "▁" + word]], dtype=np.uint32))[0]

    for i, t in enumerate(texts):
        want = end + sum(of(w) for w in (t or "").lower().split())
        assert got[i] == pytest.approx(want / math.log(10), rel=1e-9)
