"""Token ids of whole texts with a public tokenizer file, fast enough for a corpus.

The tokenizers library needs about a second a megabyte. Nearly all of that is spent on words that
it has seen before, so texts are cut where the tokenizer itself always cuts (at spaces, and around
runs of ASCII punctuation), each distinct piece of a batch is encoded once, and the ids are put
together with array operations. A text on which such cuts might differ from the tokenizer's own
(white space other than single spaces and line feeds, letters outside Latin-1, punctuation beside
an apostrophe, the marks that special tokens begin with) goes to the library whole. Results equal the
library's on every text, special tokens' strings included (they are single ids there).

A Python worker remembers pieces and their ids in one pool of at most MOST pieces; when that is full,
the pieces that were used least lately make room, so that frequent words are encoded once a worker.
"""

from __future__ import annotations

import os
from itertools import chain, repeat

import numpy as np
import pyarrow as pa

#: Longest piece (code points) and number of pieces that a Python worker remembers, and text bytes that are encoded at a time.
LONGEST, MOST, AT_ONCE = 64, 600_000, 8 << 20
#: Kinds of bytes. MARK (with LESS and BAR): ASCII punctuation but for the apostrophe, QUOTE, which begins contractions; ODD sends a text to the library whole.
OTHER, MARK, QUOTE, SPACE, FEED, ODD, LESS, BAR, LATIN, SIGN = range(10)
KIND = np.zeros(256, dtype=np.uint8)
KIND[:0x20] = KIND[0x7F] = ODD
KIND[0xC2] = KIND[0xC4:] = ODD  # lead bytes of all code points beyond ASCII but U+00C0 to U+00FF
KIND[[*b"!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"]] = MARK
KIND[[*b"' \n<|"]] = QUOTE, SPACE, FEED, LESS, BAR
KIND[[0xC3, 0x97, 0xB7]] = LATIN, SIGN, SIGN  # the signs for times and divided by are no letters
#: What two neighbouring bytes mean: a piece begins at the second; its text is odd.
BEGINS, STRANGE = 1, 2
#: Pieces whose ids are taken from one text of so many pieces.
JOINED = 256


def _pairs(cut_feeds: bool) -> np.ndarray:
    table, marks = np.zeros((10, 10), dtype=np.uint8), [MARK, LESS, BAR]
    plain = [k for k in range(10) if k not in marks]
    table[np.ix_([k for k in plain if k != SPACE], marks)] |= BEGINS
    table[np.ix_(marks, plain)] |= BEGINS
    table[:, [SPACE, FEED] if cut_feeds else SPACE] |= BEGINS
    table[:, ODD] |= STRANGE
    for first, second in ((SPACE, SPACE), (marks, QUOTE), (QUOTE, marks), (LESS, BAR), (LATIN, SIGN)):
        table[first, second] |= STRANGE
    return table.ravel()


class TextEncoder:
    """ids(texts) for a tokenizer file; `keeps_spaces` says whether a space and a line feed differ before a word."""

    def __init__(self, path: str, keeps_spaces: bool, end_id: int | None):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.keeps_spaces, self.end_id, self.pairs = keeps_spaces, end_id, _pairs(not keeps_spaces)
        vocabulary = self.tokenizer.get_vocab()
        self.bytes_of = np.zeros(max(vocabulary.values()) + 1, dtype=np.int64)  # of an id of a piece of ASCII letters
        for piece, k in vocabulary.items():
            self.bytes_of[k] = len(piece if keeps_spaces else piece.removesuffix("</w>"))
        self.seen: dict[str, int] = {}
        self.first, self.size, self.used = (np.zeros(0, dtype=np.int64) for _ in range(3))  # of each remembered piece, in the pool
        self.pool, self.clock = np.zeros(0, dtype="<u4"), 0

    def _cut(self, array: pa.Array) -> tuple[pa.DictionaryArray, np.ndarray]:
        """The pieces of all texts (coded), and where each text's pieces begin. array has 64-bit offsets from 0."""
        _, offsets, data = array.buffers()
        at = np.frombuffer(offsets, dtype=np.int64)[: len(array) + 1]
        size = int(at[-1]) if len(array) else 0
        if not size:
            return pa.array([], pa.large_string()).dictionary_encode(), np.zeros(len(array) + 1, dtype=np.int64)
        raw = np.frombuffer(data, dtype=np.uint8)[:size]
        kind = KIND[raw]
        flags = np.empty(size, dtype=np.uint8)
        flags[0] = 0
        np.take(self.pairs, kind[:-1] * np.uint8(10) + kind[1:], out=flags[1:])
        starts = at[:-1][np.diff(at) > 0]
        flags[starts] = np.where(kind[starts] == ODD, STRANGE, 0)  # neighbours across two texts don't count
        begins = (flags & BEGINS).view(bool)
        whole = np.unique(np.searchsorted(at, np.flatnonzero(flags & STRANGE), side="right") - 1)
        for k in whole.tolist():
            begins[at[k] : at[k + 1]] = False
        begins[starts] = True
        starts = np.flatnonzero(begins)
        pieces = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(np.append(starts, size).tobytes()), data)
        return pieces.dictionary_encode(), np.searchsorted(starts, at)

    def _slots(self, pieces: list[str]) -> np.ndarray:
        """The place of each piece in first and size; new pieces are encoded and added."""
        if len(self.first) > MOST or len(self.pool) > 8 * MOST:
            self._evict()
        self.clock += 1
        slots = np.fromiter(map(self.seen.get, pieces, repeat(-1)), dtype=np.int64, count=len(pieces))
        new = np.flatnonzero(slots < 0)
        if len(new):
            texts = [pieces[k] for k in new.tolist()]
            size, ids = self._encoded(texts)
            n = len(self.first)
            self.first = np.append(self.first, len(self.pool) + np.cumsum(size) - size)
            self.size, self.used = np.append(self.size, size), np.append(self.used, np.zeros(len(size), dtype=np.int64))
            self.pool = np.concatenate([self.pool, ids])
            slots[new] = np.arange(n, n + len(new))
            self.seen.update((p, s) for p, s in zip(texts, range(n, n + len(new)), strict=True) if len(p) <= LONGEST)
        self.used[slots] = self.clock
        return slots

    def _encoded(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Number of ids of each piece, and all ids. Words of ASCII letters after a space are encoded many in one text, and told apart by their ids' bytes."""
        is_word = np.fromiter((p[:1] == " " and p.isascii() and p[1:].isalpha() for p in pieces), dtype=bool, count=len(pieces))
        words, rest = ([pieces[k] for k in np.flatnonzero(x).tolist()] for x in (is_word, ~is_word))
        n_rest, of_rest = self._library(rest)
        _, of_words = self._library(["".join(words[k : k + JOINED]) for k in range(0, len(words), JOINED)])
        ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) - (not self.keeps_spaces))
        upto = np.cumsum(self.bytes_of[of_words])
        last = np.searchsorted(upto, ends)
        if len(words) and not (upto[-1] == ends[-1] and (upto[last] == ends).all()):
            raise ValueError("the tokenizer joins words across a space")
        size = np.empty(len(pieces), dtype=np.int64)
        size[is_word], size[~is_word] = np.diff(last, prepend=-1), n_rest
        ids, of = np.empty(int(size.sum()), dtype="<u4"), np.repeat(is_word, size)
        ids[of], ids[~of] = of_words, of_rest
        return size, ids

    def _library(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        sizes, ids = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype="<u4")]
        for k in range(0, len(texts), 20_000):
            made = [e.ids for e in self.tokenizer.encode_batch_fast(texts[k : k + 20_000], add_special_tokens=False)]
            sizes.append(np.fromiter(map(len, made), dtype=np.int64, count=len(made)))
            ids.append(np.fromiter(chain.from_iterable(made), dtype="<u4", count=int(sizes[-1].sum())))
        return np.concatenate(sizes), np.concatenate(ids)

    def _evict(self) -> None:
        """Keep the half of the remembered pieces that were used last."""
        names, slots = list(self.seen), np.fromiter(self.seen.values(), dtype=np.int64, count=len(self.seen))
        kept = np.sort(np.argsort(-self.used[slots], kind="stable")[: MOST // 2])
        slots = slots[kept]
        size = self.size[slots]
        first = np.cumsum(size) - size
        self.pool = self.pool[np.repeat(self.first[slots] - first, size) + np.arange(int(size.sum()))]
        self.first, self.size, self.used = first, size, self.used[slots]
        self.seen = {names[k]: s for s, k in enumerate(kept.tolist())}

    def ids(self, array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Number of ids of each text, and all ids one text after the other; each text ends with end_id if that is set."""
        coded, offsets = self._cut(array)
        slots = self._slots(coded.dictionary.to_pylist())
        codes = coded.indices.to_numpy()
        size = self.size[slots].astype(np.int32)
        lengths = size[codes]
        upto = np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)])
        total, n = int(upto[-1]), np.diff(upto[offsets])
        narrow = np.int32 if total + len(self.pool) < 2**31 else np.int64
        at = np.repeat(self.first[slots].astype(narrow)[codes] - upto[:-1].astype(narrow), lengths)
        at += np.arange(total, dtype=narrow)
        if self.end_id is None:
            return n, self.pool[at]
        out = np.full(total + len(n), self.end_id, dtype="<u4")
        if total:
            ends = np.cumsum(n + 1) - 1
            real = np.ones(len(out), dtype=bool)
            real[ends] = False
            out[real] = self.pool[at]
        return n + 1, out


_ENCODERS: dict[tuple, TextEncoder] = {}


def encoder(path: str, keeps_spaces: bool, end_id: int | None) -> TextEncoder:
    """One encoder a Python worker: what it has seen serves later tasks."""
    key = (path, keeps_spaces, end_id)
    if key not in _ENCODERS:
        _ENCODERS[key] = TextEncoder(*key)
    return _ENCODERS[key]
