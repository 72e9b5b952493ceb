import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from rolemesh.llm.encoding import TextEncoder
from tokenizers import Tokenizer

ENCODERS = {name: TextEncoder(public_tokenizers.path(name), spaces, 2) for name, spaces in (("word_bpe_49k.json", False), ("byte_bpe_50k.json", True))}
PIECES = ["the", "Über", "It's", "'s", "!'s", "  ", " ", "\n", " \n", "\n ", "\t", "&&&", "a_b", "12.5", "İ", "中文", "é", "é", " ", "<|endoftext|>", "<|startoftext|>", "<|", "×", "÷", "\x7f", "x'!", "...", "token = \"ab-12\"", "", "\x01", "\x00", "🙂"]


@pytest.mark.parametrize("name", ENCODERS)
@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.sampled_from(PIECES) | st.text(max_size=6), max_size=12).map("".join), max_size=6))
def test_ids_equal_the_librarys(name, texts):
    plain = Tokenizer.from_file(public_tokenizers.path(name))
    n, flat = ENCODERS[name].ids(pa.array(texts, pa.large_string()))
    want = [plain.encode(t, add_special_tokens=False).ids + [2] for t in texts]
    assert n.tolist() == [len(w) for w in want]
    assert flat.tolist() == [i for w in want for i in w]
    assert flat.dtype == np.dtype("<u4")


def test_forgotten_pieces_are_encoded_again(monkeypatch):
    """With room for a few pieces only, and many slices, ids stay the library's."""
    monkeypatch.setattr("rolemesh.llm.encoding.MOST", 10)
    path = public_tokenizers.path("byte_bpe_50k.json")
    made, plain = TextEncoder(path, True, None), Tokenizer.from_file(path)
    for k in range(6):
        texts = [f"word{j} is here, again {k}" for j in range(8)] + ["a" * 100 + " b", None]
        n, flat = made.ids(pa.array([t or "" for t in texts], pa.large_string()))
        want = [plain.encode(t or "", add_special_tokens=False).ids for t in texts]
        assert n.tolist() == [len(w) for w in want]
        assert flat.tolist() == [i for w in want for i in w]
    assert len(made.seen) <= 40


def test_special_tokens_are_the_librarys():
    for name, special in (("word_bpe_49k.json", "<|startoftext|>"), ("byte_bpe_50k.json", "<|endoftext|>")):
        n, flat = ENCODERS[name].ids(pa.array([f"a {special} b"], pa.large_string()))
        want = Tokenizer.from_file(public_tokenizers.path(name)).encode(f"a {special} b", add_special_tokens=False)
        assert flat.tolist() == [*want.ids, 2]
        assert special in want.tokens
