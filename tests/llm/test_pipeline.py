"""The whole pipeline against a plain one in Python and SQL on the smallest documents."""

import re
from collections import defaultdict
from itertools import combinations

import corpus_pipeline
import duckdb
import numpy as np
import public_tokenizers
from rolemesh.llm import quality_rules, secret_scans
from tokenizers import Tokenizer

DATA = "/root/testdata/sf0.001"
WORD = re.compile("[^\\x20\\x09-\\x0D]+")


def plain():
    """{doc_id: ids} of what must be packed: documents that the rules keep, the least of each group of near-duplicates, secrets replaced by a mark."""
    con = duckdb.connect()
    con.execute(f"CREATE TABLE documents AS SELECT doc_id, text FROM '{DATA}/documents.parquet'")
    texts = dict(con.execute("SELECT doc_id, coalesce(text, '') FROM documents").fetchall())
    kept = sorted(r[0] for r in con.execute(f"SELECT doc_id FROM ({quality_rules.ORACLE}) WHERE kept").fetchall())
    spans = dict(con.execute(f"SELECT doc_id, spans FROM ({secret_scans.ORACLE})").fetchall())
    sets, root = {}, {d: d for d in kept}
    for d in kept:
        words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), texts[d]))
        sets[d] = {tuple(words[k : k + 5]) for k in range(len(words) - 4)}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in combinations(kept, 2):
        common = len(sets[a] & sets[b])
        if 100 * common >= 80 * (len(sets[a]) + len(sets[b]) - common):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    tokenizer, out = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), {}
    for d in kept:
        if find(d) == d:
            text, upto, parts = texts[d], 0, []
            for s in filter(None, spans[d].split(",")):
                start, end = map(int, s.split(":")[1:])
                if start >= upto:
                    parts += [text[upto:start], "[secret]"]
                upto = max(upto, end)
            out[d] = [*tokenizer.encode("".join(parts) + text[upto:], add_special_tokens=False).ids, 1]
    return out


def test_pipeline(spark):
    want, got, places = plain(), defaultdict(list), defaultdict(list)
    for r in corpus_pipeline.run(spark, DATA).collect():
        got[r.doc_id].append((r.start, np.frombuffer(r.ids, dtype="<u4").tolist(), r.doc_tokens))
        places[r.sequence_id].append((r.offset, r.length))
    assert set(got) == set(want)
    for d, pieces in got.items():
        assert [i for _, ids, _ in sorted(pieces) for i in ids] == want[d]
        assert {n for *_, n in pieces} == {len(want[d])}
    assert sorted(places) == list(range(len(places)))
    for k, held in places.items():
        ends = np.cumsum([n for _, n in sorted(held)])
        assert [o for o, _ in sorted(held)] == [0, *ends[:-1]]
        assert ends[-1] == 2048 or k == len(places) - 1


ODD = "doc_id long, text string, lang string, source string, n_chars long, id long, rank int, _slot string"


def test_odd_rows_through_every_stage(spark, tmp_path):
    """Nulls, repeated rows, a very long text and columns with the operators' own names go through all stages; an empty table gives an empty result."""
    good = " ".join(f"word{k} and some other{k % 97} things, here" for k in range(60))
    long = " ".join(f"word{k} thing{k * 3} here{k * 5}," for k in range(60_000))
    rows = [(1, good, "en", None, None, 1, 1, "a"), (1, good, "en", None, None, 1, 1, "a"), (None, good + " more", None, "x", 3, 2, None, None), (3, None, None, None, None, None, None, None), (4, "", "en", "src0", 0, 1, 1, "b"), (5, long, "en", "src0", None, 1, 2, "c"), (6, long.replace("here", "there"), None, "other", None, 1, 2, "c")]
    for name, given in (("odd", rows), ("none", [])):
        spark.createDataFrame(given, ODD).write.parquet(str(tmp_path / name / "documents.parquet"))
        docs = spark.read.parquet(str(tmp_path / name / "documents.parquet"))
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            docs = stage(spark, docs, str(tmp_path / name))
            docs.write.parquet(str(tmp_path / name / f"stage{k}"))
            docs = spark.read.parquet(str(tmp_path / name / f"stage{k}"))
            if k < 4:
                assert docs.columns == [c.split()[0] for c in ODD.split(", ")]
        got = docs.groupBy("doc_id").sum("length").collect()
        if not given:
            assert got == []
        else:
            kept = [r.doc_id for r in got]
            assert {5, 6} <= set(kept) and len([k for k in kept if k in (1, None)]) == 1 and not {3, 4} & set(kept)
