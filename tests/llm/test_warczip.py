import base64
import gzip
import hashlib
import io
import json
import random
import struct
import zipfile

import pytest

from marlstone.llm import shared, warczip

COLUMNS = ["page_id", "url", "record_type", "payload", "payload_bytes", "payload_digest", "refers_to"]


def digest(payload):
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def test_round_trip(spark):
    rng = random.Random(1)
    pages = [(i, rng.choice([None, "http://é.example.org/a b\n", f"http://x/{i}"]), rng.choice([None, "", "a", "same" * 100, f"<p>é {i}</p>" * rng.choice([1, 500]), "\r\n\r\nX: y\r\n\r\n"])) for i in range(300)]
    pages += [(-5, "u", "only once"), (1000, "u", "long " * 200_000)]
    df = spark.createDataFrame([(*p, "x", 7) for p in pages], "page_id long, url string, html string, first string, sha1 int").repartition(5)
    got = {r["page_id"]: r.asDict() for r in warczip.records(warczip.packed(df), COLUMNS).collect()}
    first = {}
    for i, _, html in pages:
        key = (html or "").encode()
        first[key] = min(i, first.get(key, i))
    assert len(got) == len(pages)
    for i, url, html in pages:
        data, r = (html or "").encode(), got[i]
        assert (r["payload_bytes"], r["payload_digest"]) == (len(data), digest(data))
        assert (r["record_type"], r["refers_to"]) == (("response", None) if first[data] == i else ("revisit", first[data]))
        assert (None if r["payload"] is None else bytes(r["payload"])) == (data if first[data] == i else None)
        assert (r["url"] is None) == (url is None)


def test_odd_pages(spark):
    schema = "page_id long, url string, html string"
    assert warczip.records(warczip.packed(spark.createDataFrame([], schema)), COLUMNS).count() == 0
    df = spark.createDataFrame([(None, None, "a"), (3, None, "a"), (3, None, "a"), (None, "u", "b")], schema)
    got = sorted((r["page_id"] or -1, r["record_type"], r["refers_to"]) for r in warczip.records(warczip.packed(df), COLUMNS).collect())
    assert got == [(-1, "response", None), (-1, "revisit", 3), (3, "response", None), (3, "response", None)]


def _reader(data):
    return lambda at, n: data[at : at + n]


def test_directories_with_and_without_zip64():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("a.txt", "hello", zipfile.ZIP_STORED)
        z.writestr("é/b.txt", "x" * 1000, zipfile.ZIP_DEFLATED)
        z.comment = b"note" * 100
    data = out.getvalue()
    found = warczip.directory(_reader(data), len(data))
    assert list(found) == ["a.txt", "é/b.txt"] and found["é/b.txt"][0] == 8
    at = warczip.stored_at(_reader(data), found["a.txt"])
    assert data[at : at + 5] == b"hello"
    with pytest.raises(ValueError):
        warczip.stored_at(_reader(data), found["é/b.txt"])
    with pytest.raises(ValueError):
        warczip.directory(_reader(b"x" * 100), 100)


def test_zip64_records_are_followed():
    """A package in which the directory's place, sizes and offsets stand in ZIP64 fields only."""
    name, body = b"a", b"stored bytes"
    local = struct.pack("<4sHHHHHLLLHH", b"PK\x03\x04", 45, 0, 0, 0, 0, 0, 0xFFFFFFFF, 0xFFFFFFFF, 1, 20) + name + struct.pack("<HHQQ", 1, 16, len(body), len(body)) + body
    pad = b"\0" * 7
    start = len(pad)
    central = struct.pack("<4sHHHHHHLLLHHHHHLL", b"PK\x01\x02", 45, 45, 0, 0, 0, 0, 0, 0xFFFFFFFF, 0xFFFFFFFF, 1, 28, 0, 0, 0, 0, 0xFFFFFFFF) + name + struct.pack("<HHQQQ", 1, 24, len(body), len(body), start)
    at = start + len(local)
    end64 = struct.pack("<4sQHHLLQQQQ", b"PK\x06\x06", 44, 45, 45, 0, 0, 1, 1, len(central), at)
    locator = struct.pack("<4sLQL", b"PK\x06\x07", 0, at + len(central), 1)
    end = struct.pack("<4sHHHHLLH", b"PK\x05\x06", 0, 0, 0xFFFF, 0xFFFF, 0xFFFFFFFF, 0xFFFFFFFF, 0)
    data = pad + local + central + end64 + locator + end
    found = warczip.directory(_reader(data), len(data))
    assert found == {"a": (0, len(body), len(body), start)}
    at = warczip.stored_at(_reader(data), found["a"])
    assert data[at : at + len(body)] == body


def test_damage_is_told():
    data = warczip.record(1, "http://x/", b"payload", None)
    assert warczip.parsed(data)["payload"] == b"payload"
    raw = gzip.decompress(data).replace(b"payload\r\n", b"paxload\r\n")
    with pytest.raises(ValueError):
        warczip.parsed(gzip.compress(raw))


def test_packages_are_closed_when_full(spark, monkeypatch):
    df = spark.range(50).selectExpr("id AS page_id", "'u' AS url", "repeat(cast(id as string), 100) AS html").coalesce(1)
    assert warczip.packed(df).count() == 1


def _foreign(kind, url, body, http=True, digest_=None):
    block = (b"HTTP/1.0 200 OK\r\ncontent-length:" + str(len(body)).encode() + b"\r\n\r\n" + body) if http else body
    head = [b"WARC/1.0", b"WARC-Type:" + kind.encode(), b"WARC-Record-ID: <urn:uuid:0>", b"Content-Type: " + (b"application/http;msgtype=response" if http else b"application/warc-fields")]
    head += [b"WARC-Target-URI: " + url.encode()] * bool(url) + [b"WARC-Payload-Digest: " + (digest_ or "").encode()] * bool(digest_)
    return b"\r\n".join([*head, b"Content-Length: " + str(len(block)).encode()]) + b"\r\n\r\n" + block + b"\r\n\r\n"


@pytest.mark.parametrize("index", ["cdxj", "cdxj.gz", "deflated", "cdx", "none", "half"])
def test_packages_of_others(spark, tmp_path, index):
    """Two archives with several kinds of records, one of them plain, and indexes in their usual forms."""
    first = [_foreign("warcinfo", "", b"software: x\r\n", http=False), _foreign("response", "http://a.org/1", b"one" * 50_000, digest_="sha1:" + digest(b"one" * 50_000)), _foreign("response", "http://a.org/2", b"two", digest_="sha256:00")]
    second = [_foreign("response", "http://b.org/", b"three\r\n\r\nWARC/1.0", digest_="sha1:" + "A" * 32), _foreign("metadata", "http://b.org/", b"k: v", http=False)]
    files = {"one.warc.gz": [gzip.compress(r) for r in first], "two.warc": second}
    lines, cdx = [], [" CDX N b a m s k r M S V g"]
    for name, parts in files.items():
        at = 0
        for p in parts:
            if index != "half" or name == "one.warc.gz":
                lines.append("org,a)/ 2020 " + json.dumps({"url": "u", "offset": at, "length": str(len(p)), "filename": name}))
                cdx.append(f"org,a)/ 2020 u text/html 200 X - - {len(p)} {at} {name}")
            at += len(p)
    path = tmp_path / "p.wacz"
    with zipfile.ZipFile(path, "w", zipfile.ZIP_STORED) as z:
        for name, parts in files.items():
            z.writestr(f"archive/{name}", b"".join(parts))
        z.writestr("pages/pages.jsonl", "{}")
        text = "\n".join(cdx if index == "cdx" else lines).encode()
        if index == "cdxj.gz":
            z.writestr("indexes/index.cdx.gz", gzip.compress(text[:100]) + gzip.compress(text[100:]))
            z.writestr("indexes/index.idx", "org,a)/ 2020\tindex.cdx.gz\t0\t100\t1\n")
        elif index == "deflated":
            z.writestr("indexes/index.cdxj", text, zipfile.ZIP_DEFLATED)
        elif index != "none":
            z.writestr("indexes/index.cdxj", text)
    packages = spark.createDataFrame([(f"file://{path}", path.stat().st_size)], "path string, bytes long")
    got = sorted((r["url"] or "", r["record_type"], bytes(r["payload"]), r["payload_bytes"], r["digest_ok"]) for r in warczip.records(packages, [*COLUMNS, "digest_ok"]).collect())
    assert got == [
        ("", "warcinfo", b"software: x\r\n", 13, None),
        ("http://a.org/1", "response", b"one" * 50_000, 150_000, True),
        ("http://a.org/2", "response", b"two", 3, None),
        ("http://b.org/", "metadata", b"k: v", 4, None),
        ("http://b.org/", "response", b"three\r\n\r\nWARC/1.0", 17, False),
    ]


def test_packages_written_here_are_usual_ones(spark):
    path = warczip.packed(spark.createDataFrame([(1, "http://Www.Ex.org:80/A?b", "x"), (2, None, "y")], "page_id long, url string, html string").coalesce(1)).first()["path"]
    with zipfile.ZipFile(path.removeprefix("file:")) as z:
        assert z.namelist() == [warczip.DATA, warczip.INDEX] and z.testzip() is None
        lines = gzip.decompress(z.read(warczip.INDEX)).decode().splitlines()
        data = z.read(warczip.DATA)
    assert lines[0].startswith('org,ex,www)/A?b 19700101000000 {"url": "http://Www.Ex.org:80/A?b"') and lines[1].startswith("- 1970")
    assert list(warczip.walked(_reader(data), 0, len(data))) == [p[1:] for p in warczip.index_places(lines)]


def test_a_damaged_record_is_a_row(spark, tmp_path):
    good = warczip.record(1, "http://x/", b"payload", None)
    path = tmp_path / "d.zip"
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("archive/a.warc.gz", good + b"junk" * 10 + good)
        z.writestr("indexes/i.cdxj", "\n".join("k 1 " + json.dumps({"filename": "a.warc.gz", "offset": o, "length": n}) for o, n in ((0, len(good)), (len(good), 40), (len(good) + 40, len(good)))))
    got = warczip.records(spark.createDataFrame([(str(path), 1)], "path string, bytes long"), COLUMNS).collect()
    assert sorted(r["record_type"] for r in got) == ["damaged", "response", "response"]


def test_schemes():
    assert warczip.arrow_uri("s3a://bucket/key") == "s3://bucket/key" and warczip.arrow_uri("/tmp/x") == "file:///tmp/x" and warczip.arrow_uri("file:/tmp/x") == "file:///tmp/x"
    assert warczip.arrow_uri("wasbs://c@acct.blob.core.windows.net/p") == "abfss://c@acct.dfs.core.windows.net/p" and warczip.arrow_uri("hdfs://nn:9000/x") == "hdfs://nn:9000/x"
    with pytest.raises(ValueError):
        warczip.opened("nosuchscheme://x/y")


def test_frequent_payloads_spread(spark, monkeypatch):
    monkeypatch.setattr(shared, "HOT_ROWS", 5)
    pages = [(i, "u", None if i % 3 == 0 else f"p{i % 40}") for i in range(200)]
    got = {r["page_id"]: (r["record_type"], r["refers_to"]) for r in warczip.records(warczip.packed(spark.createDataFrame(pages, "page_id long, url string, html string")), COLUMNS).collect()}
    low = {}
    for i, _, html in pages:
        low.setdefault(html, i)
    assert got == {i: ("response", None) if low[h] == i else ("revisit", low[h]) for i, _, h in pages}
