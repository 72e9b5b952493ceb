"""Components against all pairs, over many small tables whose sets lie near the threshold."""

import random
import re
from itertools import combinations

import pytest
from rolemesh.llm import jaccard_join as jj

WORD = re.compile("[^\\x20\\x09-\\x0D]+")


def shingles(text, n):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[k : k + n]) for k in range(len(words) - n + 1)} if len(words) >= n else ({tuple(words)} if words else set())


def plain(rows, n, percent):
    sets = [shingles(t, n) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in combinations(range(len(rows)), 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
            root[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[find(k)] = min(i, least.get(find(k), i))
    return sorted(((i, len(sets[k]), least.get(find(k)) if sets[k] else i) for k, (i, _) in enumerate(rows)), key=str)


def table(seed):
    r = random.Random(seed)
    words = [f"w{k}" for k in range(400)]
    rows = []
    for _ in range(12):
        base = [r.choice(words) for _ in range(r.choice([2, 3, 4, 6, 9, 12, 20, 30, 60, 150, 400]))]
        for _ in range(r.choice([1, 2, 5, 15])):
            text = list(base)
            for _ in range(r.choice([0, 0, 1, 1, 2, 3, len(text) // 25, len(text) // 12])):
                k = r.randrange(len(text))
                text[k : k + r.choice([0, 1, 1])] = [r.choice(words)] * r.choice([0, 1, 1])
                text = text or ["x"]
            rows.append((len(rows), r.choice([" ", "\n", "\t "]).join(text)))
            if r.random() < 0.3:
                base = text  # chains: neighbours are near, the ends are not
    shared = [r.choice(words) for _ in range(40)]  # a passage in many unlike texts
    rows += [(len(rows) + k, " ".join(shared + [r.choice(words) for _ in range(r.choice([5, 20, 60]))])) for k in range(20)]
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize(("n", "percent"), [(3, 90), (5, 80), (1, 60)])
def test_components(spark, n, percent):
    tables = [table(seed) for seed in range(6)]
    rows = [(1000 * k + i, re.sub("w", f"t{k}x", t)) for k, rows in enumerate(tables) for i, t in rows]
    docs = jj.with_row(spark.createDataFrame(rows, "doc_id long, text string").repartition(5))
    got = jj.near_duplicates(docs, n, percent).select("doc_id", "n_shingles", "component_id").collect()
    assert sorted(map(tuple, got), key=str) == plain(rows, n, percent)


def test_odd_rows(spark):
    same = "one two Three four five six seven eight nine ten"
    rows = [(5, same), (5, same), (2, same.upper()), (None, same), (None, "only this one"), (7, None), (8, ""), (9, " \t"), (5, "other"), (11, "Other"), (12, "other other"), (13, "é " * 3000), (14, "é " * 2999)]
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, row string, n int")
    got = jj.near_duplicates(jj.with_row(docs), 3, 90).select("doc_id", "n_shingles", "component_id").collect()
    assert sorted(map(tuple, got), key=str) == plain(rows, 3, 90)
    kept = jj.deduplicated(docs, 3, 90)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id, r.text) for r in kept.collect() if r.doc_id is not None) == [(2, same.upper()), (5, "other"), (7, None), (8, ""), (9, " \t"), (12, "other other"), (13, "é " * 3000)]
    assert [r.text for r in kept.collect() if r.doc_id is None] == ["only this one"]
    assert jj.near_duplicates(jj.with_row(docs.where("false")), 3, 90).count() == 0


def test_further_links_are_found(spark):
    """Sets that are near each other but not near their leader."""
    r = random.Random(3)
    base = [f"b{k}" for k in range(200)]
    rows = []
    for k in range(8):
        text = list(base)
        for j in r.sample(range(200), 6):
            text[j] = f"m{k}{j}"
        rows += [(10 * k, " ".join(text)), (10 * k + 1, " ".join([*text, "end"])), (10 * k + 2, " ".join([*text, "end", "of"]))]
    docs = jj.with_row(spark.createDataFrame(rows, "doc_id long, text string"))
    got = jj.near_duplicates(docs, 3, 90).select("doc_id", "n_shingles", "component_id").collect()
    assert sorted(map(tuple, got), key=str) == plain(rows, 3, 90)


def test_two_sets_left_without_their_leader(spark):
    """Short texts by threes: two are near each other, the third is near to neither and is often the leader of all lists that they share."""
    r = random.Random(5)
    rows = []
    for k in range(400):
        n = r.choice([12, 15, 20, 22, 25, 30, 36, 40])
        x = [f"g{k}w{j}" for j in range(n)]
        y = [*x[:-1], "y"] if n > 20 else [*x, "y"]
        z = [*x[:-1], "z"]
        z[: r.choice([1, 1, 2])] = ["z"]
        rows += [(10 * k + j, " ".join(t)) for j, t in enumerate((x, y, z))]
    docs = jj.with_row(spark.createDataFrame(rows, "doc_id long, text string"))
    got = jj.near_duplicates(docs, 3, 90).select("doc_id", "n_shingles", "component_id").collect()
    assert sorted(map(tuple, got), key=str) == plain(rows, 3, 90)


def test_classes_with_one_short_hash(spark):
    """Unlike sets whose first 64 bits agree stay apart, are compared, and keep their rows once each."""

    def weak(sizes, elements):
        fp1, fp2 = jj.fingerprints(sizes, elements)
        return fp1 % 3, fp2

    rows = [(i, t) for i, t in table(3) if len(t) < 2000]
    docs = jj.with_row(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    got = jj.near_duplicates(docs, 3, 90, weak).select("doc_id", "n_shingles", "component_id").collect()
    assert sorted(map(tuple, got), key=str) == plain(rows, 3, 90)
