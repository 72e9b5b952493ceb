"""Quality rules and secret scans against plain Python, rule by rule and text by text."""

import hashlib
import re
from collections import Counter

import pytest
from rolemesh.llm import quality_rules as qr
from rolemesh.llm import secret_scans as ss

TEXTS = [
    "", None, " \t\n", "one two three one two three", "a b c a b c a b c " * 20, "É " * 60, "x\ny\nx\n \nx", "## ** $% a|b <c> " * 30,
    "THE LOUD TEXT!! " * 40, " ".join(f"w{k}" for k in range(200)), "a a a a", "one\x0btwo\x0cthree\rfour one two three four", "🙂 b " * 70 + "\nq" * 3,
]


def plain_measures(text):
    words = re.findall("[^\\x20\\x09-\\x0D]+", text or "")
    windows = [tuple(words[k : k + 3]) for k in range(len(words) - 2)]
    often = Counter(windows)
    covered = {k + j for k, w in enumerate(windows) if often[w] > 1 for j in range(3)}
    lines = [x for x in (text or "").split("\n") if re.search("[^\\x20\\x09-\\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall("[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(k, t, "s", k) for k, t in enumerate([*TEXTS, *TEXTS[:4]])], "doc_id long, text string, kept string, n_words int")


def test_measures(docs):
    for r in qr.ledger(docs).collect():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == plain_measures([*TEXTS, *TEXTS[:4]][r.doc_id])
        assert bool(r.failed & qr.BASE) == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)


def test_policies_and_ablation(docs):
    rows = qr.ledger(docs).cache()
    bits = [r.failed for r in rows.collect()]
    for version, mask in qr.POLICIES.items():
        assert sum(r.kept for r in qr.apply_policy(rows, version).collect()) == sum(not b & mask for b in bits)
        for r in qr.ablation(rows, version).collect():
            own = qr.BIT[r.rule]
            assert r.n_failed == sum(bool(b & own) for b in bits)
            assert r.n_alone == sum(b & mask == own for b in bits)
            assert r.n_kept_without == sum(not b & mask & ~own for b in bits)


def test_filter_keeps_columns(docs):
    kept = qr.filtered(docs, 3)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in qr.ledger(docs).collect() if not r.failed & qr.POLICIES[3]}
    assert qr.filtered(docs.where("false"), 3).count() == 0
    assert qr.ledger(docs.where("false")).count() == 0


KEY = "AKIA" + "ABCDEFGH12345678"
SECRETS = [
    "", None, "no secret here", f"key {KEY} end {KEY}{KEY}", "password = hunter2", "Password: 'abcdefghijkl' é token=xyz", "token = token = abcdefghijklmnop",
    'é🙂 api_key="0123456789abcdef0123" x', "-----BEGIN RSA PRIVATE KEY-----", "https://me:pw@host/ secret:abcdefabcdefabcdef", "AKIA AKIAX deadbeef", "APIKEY=" + "a" * 400, f"{'secret=0123456789abcdef ' * 50}",
    "ghp_" + "a1B2" * 10, "ſecret=abcdefghijklmnop toKen=abcdefghijklmnop",
]


def plain_spans(text):
    out = []
    for place, rule in enumerate(ss.RULES):
        for m in re.finditer(rule.pattern, text or "", re.ASCII):
            if len(m[rule.group]) >= rule.least:
                out.append((m.start(), place, m.end(), rule.kind))
    return sorted(out)


def test_spans(spark):
    docs = spark.createDataFrame([(k, t) for k, t in enumerate([*SECRETS, *SECRETS[3:6]])], "doc_id long, text string")
    for r in ss.findings(docs, ss.scan(docs)).collect():
        text = [*SECRETS, *SECRETS[3:6]][r.doc_id]
        if "K" in (text or ""):
            assert len(r.spans) == 0  # letters in either case are those of ASCII
        else:
            assert [(s.start, s.place, s.end, s.kind) for s in r.spans] == plain_spans(text)


def test_ledger_scans_each_pair_once(spark):
    old = spark.createDataFrame([(k, t) for k, t in enumerate(SECRETS[:7])], "doc_id long, text string")
    new = spark.createDataFrame([(k, t) for k, t in enumerate(SECRETS)] + [(99, SECRETS[5])], "doc_id long, text string")
    first = ss.scan(old, rules=ss.RULES[:3]).cache()
    again = ss.scan(new, first).cache()
    keys = [r.key for r in ss.RULES]
    sha = {hashlib.sha256((t or "").encode()).hexdigest() for t in SECRETS[:7]}
    for r in again.collect():
        assert sorted(r.scanned) == sorted(keys[3:] if r.blob_id in sha else keys)
    both = first.unionByName(again)
    assert ss.scan(new, both).count() == 0
    want = {r.doc_id: r.spans for r in ss.findings(new, ss.scan(new)).collect()}
    assert {r.doc_id: r.spans for r in ss.findings(new, both).collect()} == want
    assert len(want[99]) == len(want[5]) > 0


def test_redaction(spark):
    docs = spark.createDataFrame([(k, t, len(t or "")) for k, t in enumerate(SECRETS)], "doc_id long, text string, n_chars long")
    got = ss.redacted(docs, ss.scan(docs))
    assert got.columns == docs.columns
    for r in got.collect():
        text, out, upto = SECRETS[r.doc_id], "", 0
        if "K" in (text or ""):
            continue
        for start, _, end, _ in plain_spans(text):
            if start >= upto:
                out += text[upto:start] + "[secret]"
            upto = max(upto, end)
        assert r.text == (out + text[upto:] if text is not None else None)
        assert r.n_chars == len(r.text or "")


def test_no_rows(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, n_chars int")
    assert ss.findings(docs, ss.scan(docs)).count() == ss.redacted(docs, ss.scan(docs)).count() == 0
