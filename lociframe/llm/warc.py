"""WARC records in ZIP-packaged web archives (WACZ): a writer, and a reader that extracts nothing.

An archive is a ZIP file whose members archive/*.warc.gz (one gzip member for each record) or archive/*.warc are stored
without compression; indexes/* list the records' files, offsets and lengths, as CDXJ or CDX lines, plain or compressed.
The reader takes the file's tail, finds the central directory through the end record or, where numbers do not fit, the
ZIP64 one, locates the members, and range-reads the records that the index lists. Archives are planned as runs of
adjoining records, so one large archive is read by many tasks. A member that no index mentions is read from its start to
its end, by one task.

Files are opened through the Arrow filesystem of their address, so the folder may be any that it knows. A task writes
under a name of its own; the table of archives lists those of tasks that ended well, and only these are read.

Defined results of the writer: a null payload is empty. Of equal payloads of at least MINIMUM bytes, those of the largest
id are responses, the others revisit it (with equal ids, or none at all, each is a response). Rows and repeats stay.
Of the reader: records of every type come out, ids, addresses and types as they stand. The payload of an HTTP message is
its body, without the chunks' marks where it came in chunks, that of any other record its block; a revisit has none. A
payload digest that is SHA-1 comes out in hex; another kind as it stands; where none is given, the payload's own SHA-1.
length is the payload's, that of a revisit what its HTTP head says, null where it says nothing. What is no WARC record, or
is cut short, is a ValueError.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import itertools
import json
import re
import struct
import uuid
import zipfile
import zlib
from collections.abc import Callable, Iterator
from urllib.parse import quote, unquote, urlsplit

import numpy as np
import pyarrow as pa
from pyarrow import fs as arrow_fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lociframe.llm.common import cut, fresh_dir, small_batches
from lociframe.llm.repeats import bitmap, mark

#: Bytes from which equal payloads become revisits; records and bytes of one archive; bytes of one planned run.
MINIMUM, RECORDS, SIZE, RUN = 1000, 50_000, 256 << 20, 4 << 20

#: Bytes that are read at once where something is read from its start to its end.
PIECE = 1 << 20

RECORD = "record_id string, record_type string, url string, date string, content_type string, status int, refers_to string, digest string, length bigint, payload binary"


def records(pages: DataFrame, id: str = "page_id", url: str = "url", text: str = "html") -> DataFrame:
    """One record for each row: id, url, payload, digest, and whether it revisits another's. Payloads travel only where
    their digest may occur more than once."""
    rows = pages.select(F.col(f"`{id}`").cast("bigint").alias("id"), F.col(f"`{url}`").cast("string").alias("url"), F.encode(F.coalesce(F.col(f"`{text}`"), F.lit("")), "UTF-8").alias("payload"))
    rows = rows.withColumns({"digest": F.sha1("payload"), "length": F.octet_length("payload").cast("bigint")})
    long = rows.where(F.col("length") >= MINIMUM)
    groups = cut(long.groupBy("digest").agg(F.max("id").alias("best"), F.count("*").alias("n")).where("n > 1").select("digest", "best"))
    n = groups.count()
    seen = mark(rows, [F.col("digest")], bitmap(groups.select("digest"), n)).withColumn("__hit", F.col("__hit") & (F.col("length") >= MINIMUM))
    alone = seen.where(~F.col("__hit")).withColumn("best", F.lit(None).cast("bigint"))
    # of what has copies, only payloads that may be written travel
    may = mark(seen.where("__hit"), [F.col("digest"), F.col("id")], bitmap(groups.where("best is not null"), n), "__best") if n else seen.where("__hit").withColumn("__best", F.lit(True))
    shared = may.withColumn("payload", F.when(F.col("__best") | F.col("id").isNull(), F.col("payload"))).drop("__best").join(groups, "digest", "left")
    both = alone.unionByName(shared)
    revisits = F.col("best").isNotNull() & ~F.col("id").eqNullSafe(F.col("best"))
    return both.select("id", "url", F.when(~revisits, F.col("payload")).alias("payload"), "digest", "length", F.when(revisits, F.col("best")).alias("refers_to"))


def _name(id: int | None) -> str:
    return f"urn:row:{'' if id is None else id}"


def row_id(record: str) -> Column:
    """The row's id of a record that write has made."""
    return F.regexp_extract(record, "^urn:row:(-?[0-9]+)$", 1).try_cast("bigint")


def _uri(url: str) -> str:
    """As it stands, if it can stand in a line."""
    plain = url and url.isprintable() and " " not in url and not url.startswith(("escaped:", "<"))
    return url if plain else f"escaped:{quote(url, safe='')}"


def record_bytes(id: int | None, url: str | None, payload: bytes | None, digest: str, length: int, refers_to: int | None, date: str) -> bytes:
    """A response with its payload, or where it refers to another a revisit without; either has the HTTP head."""
    revisit = refers_to is not None
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {length}\r\n\r\n".encode() + (b"" if revisit else payload)
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <{_name(id)}>", f"WARC-Date: {date}", "Content-Type: application/http; msgtype=response"]
    if url is not None:
        head.append(f"WARC-Target-URI: {_uri(url)}")
    head.append(f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}")
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <{_name(refers_to)}>"]
    return _record(head, block)


def _record(head: list[str], block: bytes) -> bytes:
    return "\r\n".join([*head, f"Content-Length: {len(block)}"]).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


END_OF_HEAD = re.compile(rb"\r?\n\r?\n")


def _headers(data: bytes, encoding: str) -> tuple[str, dict[str, str], int] | None:
    """The first line, the fields by lower-case name (of repeated ones the first), and where the head ends."""
    if not (end := END_OF_HEAD.search(data)):
        return None
    first, *lines = re.split("\r?\n", data[: end.start()].decode(encoding, "replace"))
    found: dict[str, str] = {}
    name = ""
    for line in lines:
        if line[:1] in " \t" and name:  # goes on
            found[name] += " " + line.strip()
        else:
            name, _, value = line.partition(":")
            name = name.strip().lower()
            found.setdefault(name, value.strip())
    return first, found, end.end()


def _whole(body: bytes) -> bytes:
    """A body that came in chunks, put together; as it is where its marks make no sense."""
    out, at = [], 0
    while m := re.compile(rb"[ \t]*([0-9a-fA-F]+)[ \t]*(?:;[^\r\n]*)?\r?\n").match(body, at):
        size = int(m[1], 16)
        if not size:
            return b"".join(out)
        out.append(body[m.end() : m.end() + size])
        if len(out[-1]) < size:
            return body
        at = m.end() + size
        at += 2 if body[at : at + 2] == b"\r\n" else 1 if body[at : at + 1] == b"\n" else 0
    return body


def _digest(given: str | None) -> str | None:
    """SHA-1 in hex, whether it was given so or in base 32; any other kind as it stands."""
    kind, _, value = (given or "").partition(":")
    if kind.lower() not in ("sha1", "sha-1"):
        return given or None
    if re.fullmatch("[0-9a-fA-F]{40}", value):
        return value.lower()
    try:
        return base64.b32decode(value.upper()).hex()
    except ValueError:
        return given


def parse_record(data: bytes) -> dict:
    """One record; ValueError where its parts do not agree."""
    if not data.startswith(b"WARC/"):
        raise ValueError("not a WARC record")
    if (read := _headers(data, "utf-8")) is None:
        raise ValueError("a record's head is cut short")
    _, head, at = read
    if not head.get("content-length", "").isdigit():
        raise ValueError("a record has no length")
    block = data[at : at + int(head["content-length"])]
    if len(block) != int(head["content-length"]):
        raise ValueError("a record is cut short")
    kind, content = head.get("warc-type", "unknown").lower(), head.get("content-type")
    payload, status, length = block, None, None
    if block[:5] == b"HTTP/" or (content or "").lower().replace(" ", "").startswith("application/http"):
        if (read := _headers(block, "latin-1")) is not None:
            first, http, body = read
            payload, content = block[body:], http.get("content-type")
            status = int(m[1]) if (m := re.match(r"HTTP/\S+\s+(\d{3})\b", first)) else None
            length = int(http["content-length"]) if http.get("content-length", "").isdigit() else None
            if "chunked" in http.get("transfer-encoding", "").lower():
                payload = _whole(payload)
    if kind == "revisit":
        payload = None
    url = head.get("warc-target-uri")
    if url is not None:
        url = unquote(url.removeprefix("escaped:")) if url.startswith("escaped:") else url.removeprefix("<").removesuffix(">")
    bare = lambda x: x.removeprefix("<").removesuffix(">") if x else None
    digest = _digest(head.get("warc-payload-digest")) or (hashlib.sha1(payload).hexdigest() if payload is not None else None)
    return {
        "record_id": bare(head.get("warc-record-id")), "record_type": kind, "url": url, "date": head.get("warc-date"), "content_type": content, "status": status,
        "refers_to": bare(head.get("warc-refers-to")), "digest": digest, "length": length if payload is None else len(payload), "payload": payload,
    }


def sort_key(url: str) -> str:
    """The host's parts from the last to the first, then the rest: what an index is sorted by."""
    try:
        parts = urlsplit(url)
        host = (parts.hostname or "").split(".")
    except ValueError:
        return url
    return f"{','.join(reversed(host))}){parts.path}{'?' + parts.query if parts.query else ''}".lower() if host != [""] else url


class Archive:
    """Writes one ZIP archive to a stream; members are stored, so that readers can seek into them."""

    def __init__(self, stream, date: str = "2024-01-01T00:00:00Z"):
        self.zip = zipfile.ZipFile(stream, "w", zipfile.ZIP_STORED, allowZip64=True)
        self.member = self.zip.open("archive/data.warc.gz", "w", force_zip64=True)
        self.offset, self.lines, self.hash, self.date = 0, [], hashlib.sha256(), date
        self._write(_record(["WARC/1.1", "WARC-Type: warcinfo", f"WARC-Record-ID: <{uuid.uuid4().urn}>", f"WARC-Date: {date}", "Content-Type: application/warc-fields"], b"format: WARC File Format 1.1\r\n"))

    def _write(self, data: bytes) -> int:
        packed = gzip.compress(data, 5, mtime=0)
        self.member.write(packed)
        self.hash.update(packed)
        self.offset += len(packed)
        return len(packed)

    def add(self, url: str | None, digest: str, revisit: bool, data: bytes) -> None:
        at, url = self.offset, _uri(url or "")
        entry = {"url": url, "mime": "warc/revisit" if revisit else "text/html", "status": "200", "digest": f"sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}"}
        entry |= {"length": str(self._write(data)), "offset": str(at), "filename": "data.warc.gz"}
        self.lines.append(f"{sort_key(url)} {re.sub('[^0-9]', '', self.date)[:14]} {json.dumps(entry)}")

    def close(self) -> None:
        self.member.close()
        listed = [("data.warc.gz", "archive/data.warc.gz", self.hash.hexdigest(), self.offset)]
        for path, text in (("indexes/index.cdx", "".join(f"{x}\n" for x in sorted(self.lines))), ("pages/pages.jsonl", '{"format": "json-pages-1.0", "id": "pages", "title": "All Pages"}\n')):
            data = text.encode()
            self.zip.writestr(path, data)
            listed.append((path.rsplit("/", 1)[-1], path, hashlib.sha256(data).hexdigest(), len(data)))
        package = {"profile": "data-package", "wacz_version": "1.1.1", "created": self.date, "resources": [{"name": n, "path": p, "hash": f"sha256:{h}", "bytes": b} for n, p, h, b in listed]}
        self.zip.writestr("datapackage.json", json.dumps(package))
        self.zip.close()


def open_fs(address: str) -> tuple[arrow_fs.FileSystem, str]:
    if address.startswith("file:"):
        return arrow_fs.LocalFileSystem(), "/" + address.removeprefix("file:").lstrip("/")
    return arrow_fs.FileSystem.from_uri(address) if "://" in address else (arrow_fs.LocalFileSystem(), address)


def write(rows: DataFrame, folder: str, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """The records of rows (see records) in archives in the folder; the table (path, n_records, size) of archives."""
    small_batches(rows.sparkSession)
    given = rows.select("id", "url", "payload", "digest", "length", "refers_to")

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = open_fs(folder)
        system.create_dir(root, recursive=True)
        archive, stream, name, done = None, None, "", []

        def end() -> None:
            archive.close()
            stream.close()
            done.append((f"{folder}/{name}", len(archive.lines), system.get_file_info(f"{root}/{name}").size))

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if archive is None:
                    name = f"{uuid.uuid4().hex}.wacz"
                    stream = system.open_output_stream(f"{root}/{name}")
                    archive = Archive(stream, date)
                archive.add(row[1], row[3], row[5] is not None, record_bytes(*row, date))
                if archive.offset >= SIZE or len(archive.lines) >= RECORDS:
                    end()
                    archive = None
        if archive is not None:
            end()
        if done:
            yield pa.RecordBatch.from_arrays([pa.array([d[k] for d in done], t) for k, t in enumerate((pa.string(), pa.int64(), pa.int64()))], names=["path", "n_records", "size"])

    return cut(given.mapInArrow(over, "path string, n_records bigint, size bigint"))


def members(read, size: int) -> dict[str, tuple[int, int, int]]:
    """name: (offset of the data, stored bytes, method) of each member; read(offset, n) gives bytes of the file."""
    tail_at = max(0, size - 65_557)
    tail = read(tail_at, size - tail_at)
    at = tail.rfind(b"PK\x05\x06")
    while at >= 0 and (len(tail) < at + 22 or at + 22 + struct.unpack_from("<H", tail, at + 20)[0] != len(tail)):
        at = tail.rfind(b"PK\x05\x06", 0, at)
    if at < 0:
        raise ValueError("no end of a ZIP archive")
    count, length, start = struct.unpack_from("<HII", tail, at + 10)
    if count == 0xFFFF or length == 0xFFFFFFFF or start == 0xFFFFFFFF:
        locator = read(tail_at + at - 20, 20)
        if locator[:4] != b"PK\x06\x07":
            raise ValueError("no ZIP64 locator")
        end = read(struct.unpack_from("<Q", locator, 8)[0], 56)
        if end[:4] != b"PK\x06\x06":
            raise ValueError("no ZIP64 end")
        count, length, start = struct.unpack_from("<QQQ", end, 32)
    directory, found, at = read(start, length), {}, 0
    for _ in range(count):
        if directory[at : at + 4] != b"PK\x01\x02":
            raise ValueError("a broken central directory")
        flags, method = struct.unpack_from("<HH", directory, at + 8)
        stored, whole = struct.unpack_from("<II", directory, at + 20)
        n, extra, comment = struct.unpack_from("<HHH", directory, at + 28)
        local = struct.unpack_from("<I", directory, at + 42)[0]
        name = directory[at + 46 : at + 46 + n].decode("utf-8" if flags & 0x800 else "cp437")
        k, stop = at + 46 + n, at + 46 + n + extra
        while k + 4 <= stop:
            kind, own = struct.unpack_from("<HH", directory, k)
            if kind == 1:  # the numbers that did not fit, in this order
                j = k + 4
                if whole == 0xFFFFFFFF:
                    whole, j = struct.unpack_from("<Q", directory, j)[0], j + 8
                if stored == 0xFFFFFFFF:
                    stored, j = struct.unpack_from("<Q", directory, j)[0], j + 8
                if local == 0xFFFFFFFF:
                    local = struct.unpack_from("<Q", directory, j)[0]
            k += 4 + own
        at = stop + comment
        before = read(local, 30)
        if before[:4] != b"PK\x03\x04":
            raise ValueError(f"no member at {local}")
        found[name] = (local + 30 + sum(struct.unpack_from("<HH", before, 26)), stored, method)
    return found


def _range(f):
    return lambda offset, n: f.read_at(n, offset)


def _pieces(read: Callable, at: int, size: int, method: int) -> Iterator[bytes]:
    """The bytes of a member, some at a time; deflated ones come out inflated."""
    inflate = zlib.decompressobj(-15) if method == 8 else None
    if method not in (0, 8):
        raise ValueError(f"a member is compressed by method {method}")
    for k in range(at, at + size, PIECE):
        data = read(k, min(PIECE, at + size - k))
        yield inflate.decompress(data) if inflate else data
    if inflate:
        yield inflate.flush()


def _gunzipped(pieces: Iterator[bytes]) -> Iterator[bytes]:
    """The same for gzip members one after another; what is not compressed stays."""
    first = next(pieces, b"")
    pieces = itertools.chain([first], pieces)
    if first[:2] != b"\x1f\x8b":
        yield from pieces
        return
    inflate = zlib.decompressobj(31)
    for data in pieces:
        while data:
            yield inflate.decompress(data)
            data = inflate.unused_data
            if inflate.eof:
                inflate = zlib.decompressobj(31)


def _lines(pieces: Iterator[bytes]) -> Iterator[str]:
    rest = b""
    for data in pieces:
        *whole, rest = (rest + data).split(b"\n")
        yield from (x.decode("utf-8", "replace").rstrip("\r") for x in whole)
    if rest:
        yield rest.decode("utf-8", "replace")


def index_entries(lines: Iterator[str]) -> Iterator[tuple[str, int, int]]:
    """(file, offset, length) of each line of a CDXJ index, or of a CDX one, whose first line names the fields; a length
    that is not given is -1."""
    letters: list[str] = []
    number = lambda x: int(x) if str(x).isdigit() else -1
    for line in lines:
        if line.lstrip().startswith("CDX "):
            letters = line.split()[1:]
        elif (at := line.find("{")) >= 0 and line.endswith("}") and not letters:
            entry = json.loads(line[at:])
            if "offset" in entry and "filename" in entry:
                yield str(entry["filename"]), int(entry["offset"]), number(entry.get("length", ""))
        elif letters and len(found := line.split()) == len(letters):
            entry = dict(zip(letters, found, strict=True))
            if entry.get("V", "").isdigit() and "g" in entry:
                yield entry["g"], int(entry["V"]), number(entry.get("S", ""))


def runs(address: str) -> Iterator[tuple[int, list[int], int]]:
    """(offset in the file, bytes of each record, 0) of runs of adjoining records of an archive, from its indexes. Of a
    member that they do not mention: (offset, [], bytes)."""
    system, path = open_fs(address)
    with system.open_input_file(path) as f:
        read = _range(f)
        found = members(read, f.size())
        kept = {n.removeprefix("archive/"): m for n, m in found.items() if n.startswith("archive/") and n.lower().endswith((".warc.gz", ".warc"))}
        if any(method for _, _, method in kept.values()):
            raise ValueError("the archive's members are not stored")
        listed: dict[str, list[tuple[int, int]]] = {n: [] for n in kept}
        for name, member in sorted(found.items()):
            if name.startswith("indexes/") and name.lower().endswith((".cdx", ".cdxj", ".cdx.gz", ".cdxj.gz")):
                for file, offset, length in index_entries(_lines(_gunzipped(_pieces(read, *member)))):
                    if (file := file.rsplit("/", 1)[-1]) in listed:
                        listed[file].append((offset, length))
    for name, (start, size, _) in sorted(kept.items()):
        if not listed[name]:
            if size:
                yield start, [], size
            continue
        entries = np.array(listed[name], np.int64)
        offsets, first = np.unique(entries[:, 0], return_index=True)
        lengths = entries[first, 1]
        lengths = np.where(lengths > 0, lengths, np.diff(np.r_[offsets, size]))
        if offsets[0] < 0 or (offsets + lengths > size).any():
            raise ValueError(f"the index of {name} points beyond its end")
        sizes, total, after = [], 0, -1
        for offset, length in zip(offsets.tolist(), lengths.tolist(), strict=True):
            if sizes and (total + length > RUN or offset != after):
                yield start + after - total, sizes, 0
                sizes, total = [], 0
            sizes.append(length)
            total, after = total + length, offset + length
        yield start + after - total, sizes, 0


def read_run(address: str, offset: int, sizes: list[int], whole: int = 0) -> Iterator[dict]:
    system, path = open_fs(address)
    with system.open_input_file(path) as f:
        if whole:
            yield from read_all(_gunzipped(_pieces(_range(f), offset, whole, 0)))
            return
        data, at = memoryview(f.read_at(sum(sizes), offset)), 0
    for n in sizes:
        record = data[at : at + n]
        yield parse_record(zlib.decompressobj(31).decompress(record) if record[:2] == b"\x1f\x8b" else bytes(record))
        at += n


def read_all(pieces: Iterator[bytes]) -> Iterator[dict]:
    """Records one after another; what stands between them is skipped if it is white space."""
    held = bytearray()
    need = 0
    for data in itertools.chain(pieces, [None]):
        if data is not None:
            held += data
            if len(held) < need:
                continue
        while True:
            at = len(held) - len(held.lstrip())
            del held[:at]
            end = END_OF_HEAD.search(held)
            if not held or (end is None and data is not None):
                break
            head = _headers(bytes(held[: end.end()]), "utf-8") if end else None
            size = (head[1].get("content-length", "") if head else "") or "0"
            need = end.end() + int(size) if end and size.isdigit() else 0
            if len(held) < need and data is not None:
                break
            yield parse_record(bytes(held[:need] if need else held))
            del held[: need or len(held)]
            need = 0


def read(archives: DataFrame) -> DataFrame:
    """All records that the archives of a table with the column path list, with the columns of RECORD."""
    spark = archives.sparkSession

    def plan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                found = runs(path)
                while made := list(itertools.islice(found, 1000)):
                    columns = [pa.array([path] * len(made)), *(pa.array([m[k] for m in made], t) for k, t in enumerate((pa.int64(), pa.list_(pa.int64()), pa.int64())))]
                    yield pa.RecordBatch.from_arrays(columns, names=["path", "offset", "sizes", "whole"])

    types = pa.schema([(n, {"int": pa.int32(), "bigint": pa.int64(), "binary": pa.binary()}.get(t, pa.string())) for n, t in (x.split() for x in RECORD.split(", "))])

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for planned in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                held: list[dict] = []
                size = 0
                for r in read_run(*planned):
                    held.append(r)
                    size += len(r["payload"] or b"")
                    if len(held) >= 500 or size >= 4 * RUN:
                        yield pa.RecordBatch.from_pylist(held, types)
                        held, size = [], 0
                if held:
                    yield pa.RecordBatch.from_pylist(held, types)

    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    planned = archives.select("path").repartition(n, "path").mapInArrow(plan, "path string, offset bigint, sizes array<bigint>, whole bigint")
    return planned.repartition(n, "path", "offset").mapInArrow(over, RECORD)


def archive_and_read(spark: SparkSession, pages: DataFrame, folder: str | None = None, **columns: str) -> DataFrame:
    """The records of pages, written to archives in the folder (default: a new one in the shared folder) and read back."""
    return read(write(records(pages, **columns), folder or fresh_dir(spark, "archives")))


def verified(payload: Column, digest: Column) -> Column:
    """The digest; an error where a payload is at hand and has another."""
    return F.when(payload.isNull() | digest.contains(":") | (F.sha1(payload) == digest), digest).otherwise(F.raise_error(F.lit("a payload does not match its digest")))
