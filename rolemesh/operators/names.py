"""Where texts name terms: names of any length and spelling, found by an automaton over all of them in one pass over each text.

A task builds the automaton from the names (Aho-Corasick) and hands on Arrow batches; nothing is cut into words and no text meets a name that it
doesn't hold. Up to MOST_NAMES names go with the task; more are dealt into parts of that size, which meet the texts in buckets of TEXTS rows.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MOST_NAMES, TEXTS = 200_000, 2_000
#: Fixed value: names of up to so many characters match in their own case only.
EXACT_UP_TO = 4
#: Characters on each side of a span that readings look at.
AROUND = 40
_WORD = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789")


def folded(text: str) -> str:
    """Lower case, a character for each character."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(x if len(x := c.lower()) == 1 else c for c in text)


class Finder:
    """All whole-word mentions of (name, term); whole: no letter or digit may stand on either side."""

    def __init__(self, names: list[tuple[str, str]], exact_up_to: int = EXACT_UP_TO, whole: bool = True) -> None:
        held: dict[str, list[tuple[str, str]]] = {}
        for name, term in names:
            if name:
                held.setdefault(folded(name), []).append((name, term))
        self.automaton, self.exact_up_to, self.whole = ahocorasick.Automaton(), exact_up_to, whole
        for low, entries in held.items():
            self.automaton.add_word(low, (len(low), entries))
        self.automaton.make_automaton()
        self.empty = not held

    def __call__(self, text: str | None) -> Iterator[tuple[int, int, str]]:
        """(start, end, term) of every mention, each once."""
        if self.empty or not text:
            return
        for last, (n, entries) in self.automaton.iter(folded(text)):
            start, end = last - n + 1, last + 1
            if self.whole and (start and text[start - 1] in _WORD or end < len(text) and text[end] in _WORD):
                continue
            yield from ((start, end, term) for term in {term for name, term in entries if n > self.exact_up_to or text[start:end] == name})


#: Columns of a span, and those of the line it begins on.
_SPAN = {"start": pa.int32(), "end": pa.int32(), "surface": pa.string(), "term": pa.string(), "ahead": pa.string(), "behind": pa.string()}
_LINE = {"pos": pa.int32(), "line": pa.string()}


def _found(batch: pa.RecordBatch, finder: Finder, lines: bool) -> pa.RecordBatch:
    rows, out = [], []
    for k, text in enumerate(batch.column("text").to_pylist()):
        breaks = None
        for start, end, term in finder(text):
            rows.append(k)
            row = (start, end, text[start:end], term, text[max(0, start - AROUND) : start], text[end : end + AROUND])
            if lines:
                if breaks is None:
                    breaks = [-1, *(i for i, c in enumerate(text) if c == "\n"), len(text)]
                at = bisect_right(breaks, start - 1) - 1
                row += (at, text[breaks[at] + 1 : max(breaks[at + 1], end)])
            out.append(row)
    kinds = _SPAN | (_LINE if lines else {})
    columns = zip(*out, strict=True) if out else [[]] * len(kinds)
    return pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(rows, pa.int64())), *[pa.array(list(c), t) for c, t in zip(columns, kinds.values(), strict=True)]], names=["doc_id", *kinds])


def spans(docs: DataFrame, names: DataFrame, exact_up_to: int = EXACT_UP_TO, whole: bool = True, lines: bool = False, most: int = MOST_NAMES) -> DataFrame:
    """(doc_id, start, end, surface, term, ahead, behind[, pos, line]): every mention of names (name, term) in docs (doc_id, text), by code points.

    ahead and behind: the 40 characters on either side; pos and line: number and text of the line where it begins. Names of up to exact_up_to
    characters match in their own case only. A null text and an empty name have no mentions; spans may overlap; repeated rows of docs each have theirs.
    """
    docs, names = docs.select("doc_id", "text"), names.select("name", "term").where("name <> '' AND term IS NOT NULL").distinct()
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, start int, end int, surface string, term string, ahead string, behind string" + ", pos int, line string" * lines
    n = names.count()
    if n <= most:
        few = [(r.name, r.term) for r in names.collect()]

        def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            finder = Finder(few, exact_up_to, whole)
            for batch in batches:
                for k in range(0, batch.num_rows, 256):
                    yield _found(batch.slice(k, 256), finder, lines)

        return docs.mapInArrow(search, schema)

    def meet(texts: pa.Table, part: pa.Table) -> pa.Table:
        finder = Finder(list(zip(part.column("name").to_pylist(), part.column("term").to_pylist(), strict=True)), exact_up_to, whole)
        return pa.Table.from_batches([_found(b, finder, lines) for b in texts.select(["doc_id", "text"]).to_batches(256)] or [_found(pa.RecordBatch.from_pylist([], texts.select(["doc_id", "text"]).schema), finder, lines)])

    parts, buckets = -(-n // most), max(1, docs.count() // TEXTS)
    texts = docs.withColumn("bucket", F.pmod(F.monotonically_increasing_id(), F.lit(buckets))).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    dealt = names.withColumn("part", F.pmod(F.xxhash64("name"), F.lit(parts)).cast("int")).withColumn("bucket", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(buckets - 1).cast("long"))))
    return texts.groupBy("part", "bucket").cogroup(dealt.groupBy("part", "bucket")).applyInArrow(meet, schema)
