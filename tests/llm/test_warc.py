import gzip
import hashlib

import pytest
from rolemesh.llm import warc


def saved(spark, tmp_path, rows):
    spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'x' AS payload", "1 AS record_id").write.parquet(str(tmp_path / "pages.parquet"))
    return str(tmp_path)


def plain(rows):
    first = {}
    for page, _, html in rows:
        if len((html or "").encode()) >= 100:
            first.setdefault(html, []).append((page is None, page))
    out, given = [], set()
    for page, _, html in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        data = (html or "").encode()
        again = len(data) >= 100 and html in given
        given.add(html)
        out.append((page, len(data), hashlib.sha256(data).hexdigest(), "revisit" if again else "response", min(first[html])[1] if again else None))
    return sorted(out, key=str)


BIG = "<p>" + "ab\r\n\r\nWARC/1.1\r\nContent-Length: 3\r\n" * 4 + "é"
CASES = {
    "copies": [(k, f"http://x/{k}", BIG + str(k % 3)) for k in range(40)] + [(100 + k, "u", "short") for k in range(5)],
    "odd": [(3, None, None), (2, "a\r\nWARC-Type: x", ""), (None, "u", BIG), (9, "u", BIG), (None, "v", BIG), (9, "u", BIG), (4, "u", "x" * 99), (5, "u", "x" * 99), (6, "u", "x" * 100), (7, "u", "x" * 100)],
    "nobody": [(None, "u", BIG), (None, "u", BIG)],
    "long": [(1, "u", "é\n" * 3_000_000), (0, "u", "é\n" * 3_000_000)],
    "empty": [],
}


@pytest.mark.parametrize("name", CASES)
def test_archives_equal_plain(spark, tmp_path, name):
    found = warc.op12_warc(spark, saved(spark, tmp_path, CASES[name]))
    assert sorted((tuple(r)[:5] for r in found.collect()), key=str) == plain(CASES[name])


def test_payloads_come_back_and_files_are_archives(spark, tmp_path):
    rows = [(1, "u", BIG), (2, "a\nb", "\x00ü" * 80), (3, "u", BIG)]
    records = warc.captures(spark.read.parquet(saved(spark, tmp_path, rows) + "/pages.parquet"))
    heads = warc.written(warc.headers(records), "t")
    warc.write(records, heads, warc.resolution(heads), str(tmp_path / "w"))
    back = {r.page_id: (r.record_type, r.payload, r.url) for r in warc.read(spark, str(tmp_path / "w")).collect()}
    assert back == {1: ("response", bytearray(BIG.encode()), "u"), 2: ("response", bytearray("\x00ü".encode() * 80), "a%0Ab"), 3: ("revisit", None, "u")}
    for file in (tmp_path / "w").glob("part-*"):
        for fields, block in warc.parsed(file.read_bytes()):
            assert len(block) == int(fields["content-length"]) and fields["warc-record-id"].startswith("<urn:uuid:")


def record(kind, name, body, digest, page, extra=""):
    http = b"HTTP/1.1 200 OK\r\nContent-Length: %d\r\n\r\n" % len(body)
    block = http + (body if kind == "response" else b"")
    head = f"WARC/1.1\r\nWARC-Type: {kind}\r\nWARC-Record-ID: <urn:uuid:{name}>\r\nPage-Id: {page}\r\nWARC-Payload-Digest: sha256:{digest}\r\n{extra}Content-Length: {len(block)}\r\n\r\n"
    return head.encode() + block + b"\r\n\r\n"


def test_revisits_of_several_archives_are_resolved(spark, tmp_path):
    body, other = BIG.encode(), b"z" * 200
    digest, lost = (hashlib.sha256(x).hexdigest() for x in (body, other))
    (tmp_path / "in").mkdir()
    info = b"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:uuid:i>\r\nContent-Length: 2\r\n\r\nab\r\n\r\n"
    (tmp_path / "in" / "a.warc.gz").write_bytes(b"".join(map(gzip.compress, (info, record("response", "a", body, digest, 5), record("revisit", "b", body, digest, 1)))))  # a stream for each record
    (tmp_path / "in" / "b.warc").write_bytes(record("response", "c", body, digest, 4) + record("revisit", "d", other, lost, 9, "WARC-Refers-To: <urn:uuid:gone>\r\n"))
    warc.deduplicated(spark, str(tmp_path / "in"), str(tmp_path / "out"))
    back = warc.resolved(warc.written(warc.read(spark, str(tmp_path / "out"), payload=False), "t"))
    found = {r.page_id: (r.record_type, r.refers_to, r.payload_bytes, r.payload_digest) for r in back.collect()}
    n = len(body)
    assert found == {4: ("response", None, n, digest), 5: ("revisit", 4, n, digest), 1: ("revisit", 4, n, digest), 9: ("revisit", None, 200, lost)}


def test_broken_archives_are_refused():
    whole = record("response", "a", b"abc", "0", 1)
    with pytest.raises(ValueError, match="cut off"):
        list(warc.parsed(whole[:-5]))
    with pytest.raises(ValueError, match="begins with"):
        list(warc.parsed(b"GET / HTTP/1.1\r\n\r\n"))
