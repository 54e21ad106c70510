from __future__ import annotations

import gzip
import hashlib
import io
import random
import zlib

import pytest

from trailmill.llm import arc_warc as aw

SCHEMA = "page_id long, url string, html string"


def record(block: bytes, url="http://a.example/x", **more) -> dict:
    return {"url": url, "ip": "1.2.3.4", "date": "20080102030405", "mime": "text/html", "block": block, **more}


@pytest.mark.parametrize("version", ["1", "2"])
def test_arc_round_trip(version):
    rng = random.Random(9)
    blocks = [b"", b"\n", b"HTTP/1.1 200 OK\r\n\r\n<html>", bytes(rng.randrange(256) for _ in range(5_000)), b"http://fake 1.1.1.1 20080101000000 text/html 5\nabcde\n"]
    got = list(aw.read_arc(aw.arc_file("n.arc", version, [record(b) for b in blocks])))
    assert [r["block"] for r in got] == blocks and {r["version"] for r in got} == {version}
    assert all(r["url"] == "http://a.example/x" and r["date"] == "20080102030405" for r in got)
    assert len(got[0]) == len(aw.FIELDS[version]) + 3


def test_header_lines():
    about = b"1 0 old\n" + aw.NAMES["1"].encode() + b"\n\n"
    first = b"filedesc://x 0.0.0.0 20000101000000 text/plain %d\n" % len(about) + about + b"\n"
    blank = first + b"\nhttp://a 1.1.1.1 20000101000000 text/html; charset = utf-8 3\nabc\n"
    got = list(aw.read_arc(blank))
    assert got[0]["mime"] == "text/html; charset = utf-8" and got[0]["block"] == b"abc"
    for bad in (b"http://a 1 2 t 3\nabc\n", first + b"http://a 1.1.1.1 20000101000000 text/html 30\nabc\n", first + b"a b 3\nabc\n", first.replace(b"1 0 old", b"7 0 old")):
        with pytest.raises(ValueError):
            list(aw.read_arc(bad))
    assert list(aw.read_arc(b"")) == []


def test_identifiers_carry_ordinals():
    seen = set()
    for n in (0, 1, -1, 5, 2**63 - 1, -(2**63), 123456789012):
        name = aw.record_id(n)
        assert aw.ordinal_of(name) == n and name[24] == "8" and name[29] in "89ab"
        seen.add(name)
    assert len(seen) == 7 and aw.record_id(None, "a") != aw.record_id(None, "b")


def test_warc_records():
    head = b"HTTP/1.1 200 OK\r\nContent-Length: 3\r\n\r\n"
    for refers, kind in ((None, "response"), (77, "revisit")):
        fields, block = aw.read_warc(aw.warc_record(record(head + b"abc", ordinal=5, at=0), refers))
        assert fields["warc-type"] == kind and fields["warc-date"] == "2008-01-02T03:04:05Z"
        assert fields["warc-payload-digest"] == aw.base32_sha1(b"abc") and block == (head if refers else head + b"abc")
        assert fields["warc-block-digest"] == aw.base32_sha1(block)
    assert aw.ordinal_of(fields["warc-refers-to"]) == 77 and fields["warc-profile"] == aw.PROFILE
    fields, block = aw.read_warc(aw.warc_record(record(b"plain", url="dns:a", ordinal=None, at=9), None))
    assert fields["warc-type"] == "resource" and block == b"plain"
    with pytest.raises(ValueError):
        aw.read_warc(b"WARC/1.1\r\nContent-Length: 9\r\n\r\nabc\r\n\r\n")


def test_members():
    parts = [b"a" * 10, b"", b"b" * 3_000_000]
    data = b"".join(gzip.compress(p) for p in parts)
    assert list(aw.members(io.BytesIO(data), 1_000)) == parts
    with pytest.raises((ValueError, zlib.error)):
        list(aw.members(io.BytesIO(gzip.compress(b"x" * 100_000)[:-30])))


def test_query(spark):
    big, other = "é" * 600, "z" * 1_000
    pages = [(1, "http://a/1", big), (9, "http://a/9", big), (4, "http://a b/\t4", big), (2, None, "small"), (3, "ftp://x", "small"), (5, "u", None), (6, "u", ""), (7, "u", other), (7, "u", other), (8, "u", other), (None, "u", other), (10, "u", "x" * 999), (11, "u", "x" * 999), (12, "u", "\r\n\r\nHTTP/1.1\r\n" * 50_000)]
    df = spark.createDataFrame([(*p, 0) for p in pages], SCHEMA + ", PAYLOAD_BYTES int").repartition(3)
    got = sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in aw.digest(df).collect()), key=str)
    want = []
    for i, _, html in pages:
        data = (html or "").encode()
        same = [j for j, _, h in pages if j is not None and (h or "").encode() == data]
        revisit = len(data) >= 1_000 and i is not None and i != max(same)
        want.append((i, len(data), hashlib.sha1(data).hexdigest(), "revisit" if revisit else "response", max(same) if revisit else None))
    assert got == sorted(want, key=str)


def test_files_roll(spark, monkeypatch):
    monkeypatch.setattr(aw, "WARC_BYTES", 500)
    monkeypatch.setattr(aw, "ARC_BYTES", 300)
    df = spark.createDataFrame([(i, "http://a", f"page {i} " * 20) for i in range(30)], SCHEMA).coalesce(1)
    manifest = aw.convert(aw.legacy_archives(df))
    assert manifest.agg({"records": "sum"}).first()[0] == 30 and manifest.count() >= 1
    assert sorted(r.page_id for r in aw.read_back(manifest).collect()) == list(range(30))


def test_large_groups_and_several_archives(spark):
    """Half of all records are one page, spread over many archives; a table of keys says who keeps it."""
    same, rows = "same " * 300, []
    for k in range(400):
        rows.append((k, "http://a", same if k % 2 else f"{k} " * (200 + k)))
    df = spark.createDataFrame(rows, SCHEMA).repartition(7)
    got = {r.page_id: (r.record_type, r.refers_to) for r in aw.digest(df).collect()}
    assert got == {k: ("revisit", 399) if k % 2 and k < 399 else ("response", None) for k in range(400)}


def test_files_of_attempts_that_failed_are_not_read(spark, tmp_path):
    """What a lost attempt left in the folder is in no manifest."""
    to = f"file://{tmp_path}/warc"
    df = spark.createDataFrame([(i, "http://a", f"page {i}") for i in range(20)], SCHEMA)
    manifest = aw.convert(aw.legacy_archives(df), to)
    (tmp_path / "warc" / "000000-999-0000.warc.gz").write_bytes(b"half a file")
    assert sorted(r.page_id for r in aw.read_back(manifest).collect()) == list(range(20))


def damaged():
    """Archives with one good record before and one behind each kind of damage, and how many rejects they have."""
    about = b"1 0 old\n" + aw.NAMES["1"].encode() + b"\n\n"
    first = b"filedesc://x 0.0.0.0 20000101000000 text/plain %d\n" % len(about) + about + b"\n"
    good = lambda n, url=b"http://a/": url + b"%d 1.1.1.1 20080101000000 text/html 3\nab%d\n" % (n, n)
    bad = [
        (b"http://b 1.1.1.1 20080101000000 text/html 300000\nabc\n", 1),
        (b"http://b 1.1.1.1 00000000000000 text/html 3\nabc\n", 1),
        (b"http://b 3\nabc\n", 1),
        (b"http://b 1.1.1.1 20080101000000 text/html -3\nabc\n", 1),
        (b"\xff\xfe\x00 rubbish\nmore rubbish\n", 1),
        (b"http://caf\xe9/ 1.1.1.1 20080101000000 text/html 3\nabc\n", 0),
        (b"http://b 1.1.1.1 200801011230 text/html 3\nabc\n", 0),
    ]
    return [(first + good(1) + x + good(2), n) for x, n in bad] + [(first + good(1) + good(2) + b"http://b 1.1.1.1 2008", 1)]


def test_damage_is_listed_and_the_rest_is_read(spark):
    files = damaged()
    for content, n in files:
        found = list(aw.scan_arc(content))
        assert [r["block"] for r, _ in found if r and r["block"] != b"abc"] == [b"ab1", b"ab2"], content
        assert sum(b is not None for _, b in found) == n, found
    assert [r["url"] for r, _ in aw.scan_arc(files[5][0]) if r][1] == "http://caf%E9/"
    assert [aw.warc_date(r["date"]) for r, _ in aw.scan_arc(files[6][0]) if r][1] == "2008-01-01T12:30:00Z"
    rows = [(f"f{k}", c) for k, (c, _) in enumerate(files)] + [("none", None), ("empty", b""), ("other", b"PK\x03\x04 no archive"), ("version", files[0][0].replace(b"1 0 old", b"9 0 old"))]
    df = spark.createDataFrame(rows, "path string, content binary")
    out = aw.rejects(df).collect()
    assert {(r.path) for r in out} == {"f0", "f1", "f2", "f3", "f4", "f7", "other", "version"} and all(r.reason for r in out)
    back = aw.read_back(aw.convert(df)).collect()
    assert len(back) == 2 * len(files) + 2 and all(r.payload_bytes == 3 for r in back)


def test_gzip_members(spark):
    parts = [aw.arc_file("n.arc", "1", [record(b"one")]), b"http://a/2 1.1.1.1 20080101000000 text/html 3\ntwo\n", b"http://a/3 1.1.1.1 20080101000000 text/html 5\nthree\n"]
    packed = [gzip.compress(p) for p in parts]
    blocks = lambda content: [r["block"] for r, _ in aw.scan_arc(content) if r]
    lost = lambda content: [b for _, b in aw.scan_arc(content) if b]
    assert blocks(b"".join(packed)) == [b"one", b"two", b"three"] and not lost(b"".join(packed) + bytes(20))
    broken = packed[1][:20] + b"\xff" * (len(packed[1]) - 20)
    assert blocks(packed[0] + broken + packed[2]) == [b"one", b"three"] and lost(packed[0] + broken + packed[2])
    assert blocks(b"".join(packed)[:-9]) in ([b"one", b"two"], [b"one", b"two", b"three"]) and lost(b"".join(packed)[:-9])
    assert list(aw.read_arc(b"".join(packed)))[1]["block"] == b"two"


def test_empty_table(spark):
    assert aw.digest(spark.createDataFrame([], SCHEMA)).collect() == []
