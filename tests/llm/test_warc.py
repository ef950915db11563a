import gzip
import hashlib
import io
import json
import re
import struct
import zipfile

import pytest

from lociframe.llm import warc

LONG = "é" * 700


def pages():
    rows = [(1, "http://a/x y", LONG), (2, "http://b/é", LONG), (3, None, "short"), (4, "http://c/%20?q=1#f", "short"), (5, "u\nv", None), (5, "u\nv", None), (None, "http://d/", LONG), (9, "", "z" * 3000), (9, "", "z" * 3000), (8, "http://e/", "z" * 3000)]
    return rows


def test_round_trip(spark):
    df = spark.createDataFrame([(i, u, h, "clash") for i, u, h in pages()], "page_id bigint, url string, html string, digest string")
    got = warc.archive_and_read(spark, df.repartition(3)).withColumn("id", warc.row_id("record_id")).withColumn("best", warc.row_id("refers_to")).collect()
    want = []
    best = {LONG: 2, "z" * 3000: 9}
    for i, u, h in pages():
        data = (h or "").encode()
        refers = best.get(h) if h in best and best[h] != i else None
        want.append((i, u, "response" if refers is None else "revisit", refers, hashlib.sha1(data).hexdigest(), len(data), data if refers is None else None))
    assert sorted(map(repr, want)) == sorted(repr((r["id"], r["url"], r["record_type"], r["best"], r["digest"], r["length"], bytes(r["payload"]) if r["payload"] is not None else None)) for r in got)
    assert warc.archive_and_read(spark, df.where("false")).count() == 0


def test_archives_are_rolled_and_split(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(warc, "RUN", 500)
    df = spark.range(40).selectExpr("id page_id", "concat('http://x/', id) url", "repeat(cast(id as string), 300) html").coalesce(1)
    table = warc.write(warc.records(df), f"file://{tmp_path}/w")
    path = table.first()["path"]
    found = list(warc.runs(path))
    assert table.count() == 1 and len(found) > 3
    assert sum(len(sizes) for _, sizes, _ in found) == 40 == warc.read(table).count()
    with zipfile.ZipFile(path.removeprefix("file://")) as z:
        assert z.testzip() is None and all(i.compress_type == zipfile.ZIP_STORED for i in z.infolist())
        package = json.loads(z.read("datapackage.json"))
        assert all(hashlib.sha256(z.read(r["path"])).hexdigest() == r["hash"].removeprefix("sha256:") for r in package["resources"])
        assert z.read("indexes/index.cdx").startswith(b"x)/0 2024")


#: Records as the WARC format's public text and crawlers write them; none comes of this library's writer.
INFO = b"""WARC/1.0\r
WARC-Type: warcinfo\r
WARC-Date: 2006-09-19T17:20:14Z\r
WARC-Record-ID: <urn:uuid:d7ae5c10-e6b3-4d27-967d-34780c58ba39>\r
Content-Type: application/warc-fields\r
Content-Length: 24\r
\r
software: X\r
robots: no\r
\r
"""
CHUNKED = b"""WARC/1.0\r
WARC-Type: response\r
WARC-Target-URI: <http://www.archive.org/a%20b?q=\xc3\xa9>\r
WARC-Date: 2006-09-19T17:20:24Z\r
WARC-Block-Digest: sha1:UZY6ND6CCHXETFVJD2MSS7ZENMWF7KQ2\r
WARC-IP-Address: 207.241.233.58\r
WARC-Record-ID: <urn:uuid:92283950-ef2f-4d72-b224-f54c6ec90bb0>\r
Content-Type: application/http;\r
  msgtype=response\r
Content-Length: 107\r
\r
HTTP/1.1 404 Not Found\r
Content-Type: text/plain\r
Transfer-Encoding: chunked\r
\r
4;x=y\r
Wiki\r
6\r
pedia!\r
0\r
\r
\r
\r
"""
RESOURCE = b"""WARC/1.1\r
WARC-Type: resource\r
WARC-Target-URI: file://var/www/logo.txt\r
WARC-Date: 2006-09-30T18:00:00Z\r
WARC-Record-ID: <urn:uuid:39509228-ae2f-11b2-763a-aa4c6ec90bb0>\r
WARC-Payload-Digest: sha256:ab12\r
Content-Type: text/plain\r
Content-Length: 5\r
\r
hello\r
\r
"""
REVISIT = b"""WARC/1.1\r
WARC-Type: revisit\r
WARC-Target-URI: http://www.archive.org/x\r
WARC-Date: 2007-03-06T00:43:35Z\r
WARC-Profile: http://netpreserve.org/warc/1.1/server-not-modified\r
WARC-Record-ID: <urn:uuid:16da6da0-bcdc-49c3-927e-57494593bbbb>\r
WARC-Refers-To: <urn:uuid:92283950-ef2f-4d72-b224-f54c6ec90bb0>\r
Content-Type: message/http\r
Content-Length: 0\r
\r
\r
\r
"""
BARE = b"WARC/0.18\nWARC-Type: Metadata\nContent-Length: 3\n\na:b\n\n"
FOREIGN = [INFO, CHUNKED, RESOURCE, REVISIT, BARE]


def fixed(record):
    """The record with the length that its block has."""
    head, block = re.split(rb"\r?\n\r?\n", record, maxsplit=1)
    block = block.removesuffix(b"\r\n\r\n").removesuffix(b"\n\n")
    return re.sub(rb"Content-Length: \d+$", b"Content-Length: %d" % len(block), head) + record[len(head) : len(head) + (4 if b"\r" in head else 2)] + block + b"\r\n\r\n"


def test_foreign_records():
    info, chunked, resource, revisit, bare = (warc.parse_record(fixed(r)) for r in FOREIGN)
    assert info["record_type"] == "warcinfo" and info["payload"] == b"software: X\r\nrobots: no" and info["url"] is None
    assert info["record_id"] == "urn:uuid:d7ae5c10-e6b3-4d27-967d-34780c58ba39" and info["digest"] == hashlib.sha1(info["payload"]).hexdigest()
    assert chunked["payload"] == b"Wikipedia!" and chunked["status"] == 404 and chunked["url"] == "http://www.archive.org/a%20b?q=é" and chunked["content_type"] == "text/plain" and chunked["length"] == 10
    assert resource["payload"] == b"hello" and resource["digest"] == "sha256:ab12" and resource["status"] is None
    assert revisit["payload"] is None and revisit["length"] is None and revisit["digest"] is None and revisit["refers_to"].endswith("f54c6ec90bb0")
    assert bare["record_type"] == "metadata" and bare["payload"] == b"a:b" and bare["record_id"] is None
    assert warc.parse_record(CHUNKED.replace(b"4;x=y", b"zz").replace(b"107", b"103"))["payload"].startswith(b"zz")  # chunks that are none
    for wrong in (b"WARC/1.0\r\nWARC-Type: x\r\n\r\n", b"WARC/1.0\r\nContent-Length: 5", INFO.replace(b"24", b"2x")):
        with pytest.raises(ValueError):
            warc.parse_record(wrong)


@pytest.mark.parametrize("index", ["cdxj", "cdxj.gz", "cdx", "deflated", "lengths", "none"])
@pytest.mark.parametrize("packed", [True, False])
def test_foreign_archives(spark, tmp_path, index, packed):
    """Two archives in one package, their members gzipped or not, with indexes of several kinds."""
    listed, path = [], tmp_path / f"{index}{packed}.wacz"
    with zipfile.ZipFile(path, "w") as z:
        for name in ("one", "two"):
            data, file = b"", f"{name}.warc{'.gz' if packed else ''}"
            for k, r in enumerate(FOREIGN):
                part = gzip.compress(fixed(r)) if packed else fixed(r)
                if k:  # warcinfo is not listed
                    listed.append((f"org,archive)/{k}", 20060919172024 + k, file, len(data), len(part)))
                data += part
            z.writestr(f"archive/{file}", data)
        if index == "cdx":
            text = " CDX N b a m s k r M S V g\n" + "".join(f"{key} {date} http://x/ text/html 200 ABC - - {n} {at} {file}\n" for key, date, file, at, n in sorted(listed))
        else:
            entries = [(key, date, {"url": "http://x/{}", "filename": file, "offset": at, **({} if index == "lengths" else {"length": str(n)})}) for key, date, file, at, n in sorted(listed)]
            text = "".join(f"{key} {date} {json.dumps(entry)}\n" for key, date, entry in entries)
        if index == "cdxj.gz":
            half = len(text) // 2
            z.writestr("indexes/index.cdxj.gz", gzip.compress(text[:half].encode()) + gzip.compress(text[half:].encode()))
        elif index != "none":
            z.writestr(f"indexes/index.{'cdx' if index == 'cdx' else 'cdxj'}", text, zipfile.ZIP_DEFLATED if index == "deflated" else zipfile.ZIP_STORED)
        z.writestr("fuzzy/x", "y")
    got = warc.read(spark.createDataFrame([(f"file://{path}",)], "path string")).collect()
    want = [warc.parse_record(fixed(r)) for r in FOREIGN[0 if index == "none" else 1 :]] * 2
    plain = lambda r: repr([(k, bytes(v) if isinstance(v, bytearray) else v) for k, v in sorted(r.items())])
    assert sorted(plain(r.asDict()) for r in got) == sorted(map(plain, want))


def test_records_one_after_another():
    whole = b"".join(map(fixed, FOREIGN))
    want = [warc.parse_record(fixed(r)) for r in FOREIGN]
    for size in (1, 7, 100, 10_000):
        assert list(warc.read_all(iter([whole[k : k + size] for k in range(0, len(whole), size)]))) == want
    with pytest.raises(ValueError):
        list(warc.read_all(iter([whole[:-20]])))


def test_an_index_that_points_nowhere(tmp_path):
    with zipfile.ZipFile(tmp_path / "x.wacz", "w") as z:
        z.writestr("archive/a.warc", fixed(INFO))
        z.writestr("indexes/index.cdxj", 'x 1 {"filename": "a.warc", "offset": "9999", "length": "5"}\n')
    with pytest.raises(ValueError, match="beyond"):
        list(warc.runs(str(tmp_path / "x.wacz")))


def reader(data):
    return lambda at, n: data[at : at + n]


def test_members_of_any_archive():
    for comment in (b"", b"PK\x05\x06 a comment"):
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as z:
            z.writestr("archive/a", b"x" * 100)
            z.writestr("indexes/é", b"y", zipfile.ZIP_DEFLATED)
            z.comment = comment
        data = out.getvalue()
        found = warc.members(reader(data), len(data))
        at, n, method = found["archive/a"]
        assert data[at : at + n] == b"x" * 100 and method == 0 and found["indexes/é"][2] == 8


def test_zip64_numbers():
    """A directory entry and an end whose numbers stand in the ZIP64 fields."""
    body, name = b"hello", b"archive/a"
    local = b"PK\x03\x04" + struct.pack("<HHHHHIIIHH", 45, 0, 0, 0, 0, 0, 0xFFFFFFFF, 0xFFFFFFFF, len(name), 20) + name + struct.pack("<HHQQ", 1, 16, len(body), len(body)) + body
    extra = struct.pack("<HH", 0x9999, 2) + b"zz" + struct.pack("<HHQQQ", 1, 24, len(body), len(body), 0)
    entry = b"PK\x01\x02" + struct.pack("<HHHHHHIIIHHHHHII", 45, 45, 0, 0, 0, 0, 0, 0xFFFFFFFF, 0xFFFFFFFF, len(name), len(extra), 0, 0, 0, 0, 0xFFFFFFFF) + name + extra
    at = len(local)
    end64 = b"PK\x06\x06" + struct.pack("<QHHIIQQQQ", 44, 45, 45, 0, 0, 1, 1, len(entry), at)
    locator = b"PK\x06\x07" + struct.pack("<IQI", 0, at + len(entry), 1)
    end = b"PK\x05\x06" + struct.pack("<HHHHIIH", 0, 0, 0xFFFF, 0xFFFF, 0xFFFFFFFF, 0xFFFFFFFF, 0)
    data = local + entry + end64 + locator + end
    start, n, method = warc.members(reader(data), len(data))["archive/a"]
    assert data[start : start + n] == body and method == 0


def test_broken_archives_are_errors():
    with pytest.raises(ValueError, match="no end"):
        warc.members(reader(b"nothing"), 7)
    with pytest.raises(ValueError, match="not a WARC"):
        warc.parse_record(b"HTTP/1.1 200 OK\r\n\r\n")
    good = warc.record_bytes(1, "u", b"abc", hashlib.sha1(b"abc").hexdigest(), 3, None, "2024-01-01T00:00:00Z")
    assert warc.parse_record(good)["payload"] == b"abc"
    with pytest.raises(ValueError, match="cut short"):
        warc.parse_record(good[:-6])
