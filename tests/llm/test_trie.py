import hashlib
import random
import zlib

import numpy as np
import pytest
from rolemesh.llm import prefix_trie as pt

SCHEMA = "conv_id long, turn long, role string, text string"


def plain(rows):
    convs = {}
    for c, t, r, x in rows:
        if c is not None:
            convs.setdefault(c, []).append((t is not None, t or 0, r or "", x or ""))
    convs = {c: [v[2:] for v in sorted(s)] for c, s in convs.items()}
    made = {}
    for c, s in convs.items():
        h = zlib.crc32(str(c).encode()) % 6
        made[c] = convs.get(c - c % 100, [])[:h] + s[h:]
    members, below = {}, {}
    for c, s in made.items():
        for d in range(len(s) + 1):
            members.setdefault(tuple(s[:d]), []).append(c)
    for p in members:
        if p:
            below.setdefault(p[:-1], []).append(p)
    leaves, saved = {}, {}
    for p in sorted(members, key=len, reverse=True):
        leaves[p] = sum(leaves[x] for x in below.get(p, [])) or 1
        saved[p] = sum(saved[x] for x in below.get(p, [])) + ((len(members[p]) - 1) * len(p[-1][1]) if p else 0)
    ends = {p: hashlib.sha256(",".join(str(c) for c in sorted(m) if len(made[c]) == len(p)).encode()).hexdigest() for p, m in members.items()}
    return {(min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(below.get(p, [])), leaves[p], saved[p], ends[p]) for p, m in members.items()}


def mixed():
    random.seed(3)
    return [(c, random.choice([None, t, t]), random.choice(["u", None, "a"]), random.choice(["x", "yy", None, "zé"])) for c in range(300) for t in range(random.randint(1, 7))]


CASES = {
    "nulls, ties and turnless": mixed(),
    "copies over many shards": [(c, t, "u", f"t{t}") for c in range(1000, 1300) for t in range(6)],
    "long": [(c, t, "u", f"t{t}") for c in (7, 8) for t in range(1500)] + [(None, 1, "u", "x")],
    "very long text": [(7, 0, "u", "é" * 2_000_000), (8, 0, "u", "é" * 2_000_000)],
    "one": [(5, 0, "u", "x")],
    "empty": [],
}


@pytest.mark.parametrize("name", CASES)
def test_trie_equals_plain(spark, name):
    df = spark.createDataFrame(CASES[name], SCHEMA).selectExpr("*", "'x' AS path", "1 AS depth")
    found = [tuple(r) for r in pt.trie(pt.rebuilt(df), shard_turns=40).collect()]
    assert len(found) == len(set(found))
    assert set(found) == plain(CASES[name])


def test_close_finds_partners():
    rng = np.random.default_rng(5)
    for n in (1, 31, 32, 33, 500, 5000):
        left, bits, open_ = n, [], 0
        while left or open_:
            if left and (not open_ or rng.random() < 0.55):
                bits.append(True)
                left, open_ = left - 1, open_ + 1
            else:
                bits.append(False)
                open_ -= 1
        bits, stack, want = np.array(bits), [], {}
        for k, x in enumerate(bits):
            if x:
                stack.append(k)
            else:
                want[stack.pop()] = k
        tree, opens = pt.Parens(bits), np.flatnonzero(bits)
        assert tree.close(opens).tolist() == [want[k] for k in opens.tolist()]
        pairs = [sum(bits[i] and not bits[i + 1] for i in range(k, want[k])) for k in opens.tolist()]
        assert tree.leaf_pairs(opens, tree.close(opens)).tolist() == pairs
