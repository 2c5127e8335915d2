"""WARC records in ZIP packages: written by the executors, read back by ranges without extraction.

A package that is written here holds two stored members: ``archive/data.warc.gz``, one gzip member for each record, and
``indexes/index.cdx.gz``, a CDXJ line with file name, offset and length for each record. Reading takes any package of
this kind: it parses the end record, the ZIP64 locator and directory where there are any, and the central directory;
finds where the stored members below ``archive/`` start; reads all indexes below ``indexes/`` (CDXJ or CDX with a header line, plain or
gzipped, stored or deflated; the lines of cluster indexes are passed over), and then the records by their ranges, neighbours together. An archive without
index lines is walked from record to record. Nothing is unpacked. Files are opened by the workers through Arrow's file
systems, under the schemes that Spark's paths have.

Of records with equal payloads that with the smallest page_id is a response; the others are revisits,
whose block keeps the HTTP header (so the payload's length is known) and whose header names the response.
Packages lie in the shared folder under names that no two attempts share; only those that the committed
table of packages lists are read, so lost executors leave no wrong records.

Defined results: a null html is an empty payload; a null url gives a record without target; rows that share
the smallest page_id of a payload are all responses; a null page_id comes back null and is the response only if no
page with that payload has an id; an empty table gives no packages. Payload length and digest of a response are
measured on what was read; ``digest_ok`` says whether its header agrees (null where that has no SHA-1). What is no WARC record
is a row of type ``damaged`` with nulls.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import json
import re
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import new_path, small_batches, with_groups, written

DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdx.gz"
#: A package is closed beyond this many bytes or records; ranges are read together up to SPAN bytes.
ROLL_BYTES, ROLL_RECORDS, SPAN = 256 << 20, 100_000, 4 << 20
TASK_BYTES = 32 << 20


def arrow_uri(uri: str) -> str:
    """A path of Spark's as Arrow names it: other schemes for the same stores."""
    scheme, sep, rest = uri.partition("://")
    if not sep:
        return "file://" + uri.removeprefix("file:")
    if scheme in ("s3a", "s3n"):
        return "s3://" + rest
    if scheme in ("wasb", "wasbs"):
        return "abfs" + scheme[4:] + "://" + rest.replace(".blob.", ".dfs.", 1)
    return uri


def opened(uri: str):
    """The file system and path of a URI; of a scheme that Arrow doesn't know, through fsspec where that is at hand."""
    from pyarrow import fs

    try:
        return fs.FileSystem.from_uri(arrow_uri(uri))
    except pa.ArrowInvalid:
        try:
            import fsspec
        except ModuleNotFoundError:
            raise ValueError(f"no file system for {uri}") from None
        found, path = fsspec.core.url_to_fs(uri)
        return fs.PyFileSystem(fs.FSSpecHandler(found)), path


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


# ---------------------------------------------------------------- records


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One WARC record, compressed by itself; a revisit if it refers to a page."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    kind = "response" if refers_to is None else "revisit"
    block = http + (payload if refers_to is None else b"")
    name = f"page:{page_id}" if page_id is not None else f"uuid:{uuid.uuid5(uuid.NAMESPACE_URL, url or '')}"
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:{name}>", "WARC-Date: 1970-01-01T00:00:00Z"]
    if url is not None:
        head.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: quote(m[0]), url))
    head += [f"WARC-Payload-Digest: sha1:{digest_of(payload)}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    pack = zlib.compressobj(6, zlib.DEFLATED, 31)
    return pack.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + pack.flush()


_DAMAGED = dict.fromkeys(("page_id", "url", "payload", "payload_bytes", "payload_digest", "refers_to", "digest_ok")) | {"record_type": "damaged"}


def parsed(data: bytes, strict: bool = True) -> dict:
    """A record's page_id (of records written here), type, url, payload, its length and digest, whether that is the
    header's, and the page that it refers to. With ``strict``, damage is an error."""
    out = _parsed(data)
    if strict and (out["record_type"] == "damaged" or out["digest_ok"] is False):
        raise ValueError("a WARC record is damaged")
    return out


def _parsed(data: bytes) -> dict:
    try:
        raw = zlib.decompressobj(31).decompress(data) if data[:2] == b"\x1f\x8b" else data
        head, _, rest = raw.partition(b"\r\n\r\n")
        lines = head.decode("utf-8", "replace").split("\r\n")
        fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        size = int(fields["content-length"])
        kind = fields["warc-type"]
    except (zlib.error, KeyError, ValueError):
        return dict(_DAMAGED)
    if not lines[0].startswith("WARC/") or len(rest) < size:
        return dict(_DAMAGED)
    block, length = rest[:size], None
    payload = block
    if fields.get("content-type", "").startswith("application/http"):
        http, _, payload = block.partition(b"\r\n\r\n")
        found = re.search(rb"(?i)(?:^|\n)Content-Length:\s*(\d+)", http)
        length = int(found[1]) if found else None
    kept = None if kind == "revisit" else payload
    declared = fields.get("warc-payload-digest") or (fields.get("warc-block-digest") if payload is block else None) or ""
    told = declared.partition(":")[2].upper() if declared.lower().startswith("sha1:") else None
    digest = told if kept is None else digest_of(kept)
    page = lambda v: int(m[1]) if v and (m := re.fullmatch(r"<urn:page:(-?\d+)>", v)) else None
    return {
        "page_id": page(fields.get("warc-record-id")), "record_type": kind, "url": fields.get("warc-target-uri"), "payload": kept,
        "payload_bytes": length if kept is None else len(kept), "payload_digest": digest, "refers_to": page(fields.get("warc-refers-to")),
        "digest_ok": None if told is None or kept is None else told == digest,
    }


def surt(url: str | None) -> str:
    """The sort key of a URL: its host's labels reversed, and its path."""
    host, slash, path = (url or "").partition("://")[2].partition("/")
    name = re.sub(r":\d+$", "", host.rpartition("@")[2]).lower()
    return quote(",".join(reversed(name.split("."))) + ")/" + path, safe=",)/?&=%~:;+$!*'(@#") if slash or host else "-"


# ---------------------------------------------------------------- packages


class Package:
    """Writes one package as a stream."""

    def __init__(self, uri: str):
        self.uri, self.index, self.size = uri, [], 0
        fs, path = opened(uri)
        self.out = fs.open_output_stream(path)
        self.zip = zipfile.ZipFile(self.out, "w", zipfile.ZIP_STORED, allowZip64=True)
        self.data = self.zip.open(zipfile.ZipInfo(DATA), "w", force_zip64=True)

    def add(self, data: bytes, url: str | None = None) -> None:
        self.data.write(data)
        place = {"url": url or "", "filename": DATA.rpartition("/")[2], "offset": str(self.size), "length": str(len(data))}
        self.index.append(f"{surt(url)} 19700101000000 {json.dumps(place)}\n")
        self.size += len(data)

    def close(self) -> tuple[str, int, int]:
        self.data.close()
        self.zip.writestr(zipfile.ZipInfo(INDEX), gzip.compress("".join(self.index).encode(), 6, mtime=0))
        self.zip.close()
        self.out.close()
        return self.uri, len(self.index), self.size


def directory(read, size: int) -> dict[str, tuple[int, int, int, int]]:
    """The central directory of a ZIP file: name -> (method, compressed size, size, local header's
    place). ``read(place, length)`` gives bytes."""
    tail = read(max(0, size - 65557), min(size, 65557))
    at = tail.rfind(b"PK\x05\x06")
    if at < 0:
        raise ValueError("no end of central directory")
    entries, length, start = struct.unpack("<HLL", tail[at + 10 : at + 20])
    if at >= 20 and tail[at - 20 : at - 16] == b"PK\x06\x07":  # ZIP64 locator
        (place,) = struct.unpack("<Q", tail[at - 12 : at - 4])
        end = read(place, 56)
        if end[:4] != b"PK\x06\x06":
            raise ValueError("no ZIP64 end of central directory")
        entries, length, start = struct.unpack("<QQQ", end[32:56])
    raw, out, at = read(start, length), {}, 0
    for _ in range(entries):
        if raw[at : at + 4] != b"PK\x01\x02":
            raise ValueError("damaged central directory")
        flags, method = struct.unpack("<HH", raw[at + 8 : at + 12])
        packed, full, n_name, n_extra, n_note = struct.unpack("<LLHHH", raw[at + 20 : at + 34])
        (place,) = struct.unpack("<L", raw[at + 42 : at + 46])
        name = raw[at + 46 : at + 46 + n_name].decode("utf-8" if flags & 0x800 else "cp437")
        extra = raw[at + 46 + n_name : at + 46 + n_name + n_extra]
        while len(extra) >= 4:
            kind, n = struct.unpack("<HH", extra[:4])
            if kind == 1:  # 64-bit values stand for those fields that are all ones
                wide = iter(struct.unpack(f"<{n // 8}Q", extra[4 : 4 + n // 8 * 8]))
                full = next(wide) if full == 0xFFFFFFFF else full
                packed = next(wide) if packed == 0xFFFFFFFF else packed
                place = next(wide) if place == 0xFFFFFFFF else place
            extra = extra[4 + n :]
        out[name] = (method, packed, full, place)
        at += 46 + n_name + n_extra + n_note
    return out


def begins_at(read, entry: tuple[int, int, int, int]) -> int:
    """Where a member's bytes start."""
    place = entry[3]
    head = read(place, 30)
    if head[:4] != b"PK\x03\x04":
        raise ValueError("not a member")
    n_name, n_extra = struct.unpack("<HH", head[26:30])
    return place + 30 + n_name + n_extra


def stored_at(read, entry: tuple[int, int, int, int]) -> int:
    """Where a stored member's bytes start."""
    if entry[0]:
        raise ValueError("not a stored member")
    return begins_at(read, entry)


def _index_lines(read, entry: tuple[int, int, int, int]) -> list[str]:
    data = read(begins_at(read, entry), entry[1])
    if entry[0] == 8:
        data = zlib.decompress(data, -15)
    elif entry[0]:
        raise ValueError("an index is stored or deflated")
    if data[:2] == b"\x1f\x8b":
        data = gzip.decompress(data)
    return data.decode("utf-8", "replace").splitlines()


def index_places(lines: list[str]) -> Iterator[tuple[str, int, int]]:
    """File name, offset and length of each line of a CDXJ or CDX index; lines of other kinds are passed over."""
    columns = None
    for line in lines:
        if line.startswith(" CDX "):
            columns = {c: i for i, c in enumerate(line.split()[1:])}
        elif (at := line.find(" {")) >= 0:
            try:
                found = json.loads(line[at + 1 :])
                yield found["filename"], int(found["offset"]), int(found["length"])
            except (KeyError, TypeError, ValueError):
                continue
        elif columns and {"g", "V", "S"} <= columns.keys():
            parts = line.split(" ")
            if len(parts) >= len(columns) and parts[columns["V"]].isdigit() and parts[columns["S"]].isdigit():
                yield parts[columns["g"]], int(parts[columns["V"]]), int(parts[columns["S"]])


def walked(read, start: int, size: int) -> Iterator[tuple[int, int]]:
    """Offset and length of each record of an archive, gzip members or plain records, read from end to end."""
    at = 0
    if read(start, min(2, size)) == b"\x1f\x8b":
        while at < size:
            unpack, used = zlib.decompressobj(31), 0
            while not unpack.eof and at + used < size:
                data = read(start + at + used, min(1 << 20, size - at - used))
                while data and not unpack.eof:
                    unpack.decompress(data, 1 << 20)
                    used += len(data) - len(unpack.unconsumed_tail) - len(unpack.unused_data)
                    data = unpack.unconsumed_tail
            yield at, used
            at += used
    while at < size:
        head = read(start + at, min(1 << 16, size - at))
        end = head.find(b"\r\n\r\n")
        found = re.search(rb"(?i)\nContent-Length:\s*(\d+)", head[: end + 1])
        if end < 0 or not found:
            yield at, size - at
            return
        length = min(size - at, end + 4 + int(found[1]) + 4)
        yield at, length
        at += length


def package_ranges(read, size: int) -> Iterator[tuple[int, int]]:
    """Place and length in the package of every record of its stored archives."""
    entries = directory(read, size)
    archives = {n: e for n, e in entries.items() if n.startswith("archive/") and re.search(r"\.warc(\.gz)?$", n)}
    starts = {}
    for name, e in archives.items():
        starts[name.rpartition("/")[2]] = (stored_at(read, e), e[1])
    told: dict[str, set[tuple[int, int]]] = {}
    for name, e in sorted(entries.items()):
        if name.startswith("indexes/") and not name.endswith("/"):
            for file, at, length in index_places(_index_lines(read, e)):
                told.setdefault(file.rpartition("/")[2], set()).add((at, length))
    for name, (start, length) in sorted(starts.items()):
        for at, n in sorted(told[name]) if name in told else walked(read, start, length):
            yield start + at, min(n, length - at)


# ---------------------------------------------------------------- on the cluster


def _write(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        package, done = None, []
        for batch in batches:
            for i in range(batch.num_rows):
                if package is None:
                    fs, path = opened(folder)
                    fs.create_dir(path, recursive=True)
                    package = Package(f"{folder}/{uuid.uuid4().hex}.zip")
                page_id, url, html, first = (batch.column(c)[i].as_py() for c in ("page_id", "url", "html", "first"))
                package.add(record(page_id, url, (html or "").encode(), None if first is None or first == page_id else first), url)
                if package.size >= ROLL_BYTES or len(package.index) >= ROLL_RECORDS:
                    done.append(package.close())
                    package = None
        if package is not None:
            done.append(package.close())
        columns = [pa.array([x[i] for x in done], t) for i, t in enumerate((pa.string(), pa.int64(), pa.int64()))]
        yield pa.RecordBatch.from_arrays(columns, names=["path", "records", "bytes"])

    return run


def _locate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for uri in batch.column("path").to_pylist():
            fs, path = opened(uri)
            with fs.open_input_file(path) as f:
                read = lambda at, n, f=f: f.read_at(n, at)
                ranges = list(package_ranges(read, f.size()))
            yield pa.RecordBatch.from_arrays(
                [pa.array([uri] * len(ranges), pa.string()), pa.array([a for a, _ in ranges], pa.int64()), pa.array([n for _, n in ranges], pa.int64())],
                names=["path", "at", "length"],
            )


_TYPES = {"page_id": pa.int64(), "record_type": pa.string(), "url": pa.string(), "payload": pa.binary(), "payload_bytes": pa.int64(), "payload_digest": pa.string(), "refers_to": pa.int64(), "digest_ok": pa.bool_()}


def _fetch(columns: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = sorted(zip(*(batch.column(c).to_pylist() for c in ("path", "at", "length")), strict=True))
            out, i = [], 0
            while i < len(rows):
                uri, lo, n = rows[i]
                hi, j = lo + n, i + 1
                while j < len(rows) and rows[j][0] == uri and rows[j][1] == hi and rows[j][1] + rows[j][2] - lo <= SPAN:
                    hi, j = rows[j][1] + rows[j][2], j + 1
                fs, path = opened(uri)
                with fs.open_input_file(path) as f:
                    data = f.read_at(hi - lo, lo)
                for _, at, n in rows[i:j]:
                    x = parsed(data[at - lo : at - lo + n], strict=False)
                    out.append({c: x[c] for c in columns})
                i = j
                if len(out) >= 256:
                    yield pa.RecordBatch.from_pylist(out, schema=pa.schema([(c, _TYPES[c]) for c in columns]))
                    out = []
            yield pa.RecordBatch.from_pylist(out, schema=pa.schema([(c, _TYPES[c]) for c in columns]))

    return run


def packed(pages: DataFrame) -> DataFrame:
    """Writes the records of ``pages(page_id, url, html)``; ``(path, records, bytes)`` of each package."""
    spark = pages.sparkSession
    small_batches(spark)
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html", F.sha1(F.encode(F.coalesce("html", F.lit("")), "UTF-8")).alias("sha1"))
    # A payload that many pages have, such as the empty one, is looked up by broadcast and spreads over all tasks.
    twice = written(pages.groupBy("sha1").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1"), "payloads")
    rows = with_groups(pages, twice, ["sha1"], "n").select("page_id", "url", "html", "first")
    return written(rows.mapInArrow(_write(new_path(spark, "warc")), "path string, records long, bytes long"), "packages")


def records(packages: DataFrame, columns: list[str]) -> DataFrame:
    """The records of ``packages(path, bytes)``; columns among page_id, record_type, url, payload,
    payload_bytes, payload_digest, refers_to, digest_ok. Ranges are dealt by their bytes, so that a task reads about
    TASK_BYTES, whatever the packages' sizes."""
    spark = packages.sparkSession
    small_batches(spark)
    kinds = {"page_id": "long", "payload_bytes": "long", "refers_to": "long", "payload": "binary", "digest_ok": "boolean"}
    places = packages.select("path").mapInArrow(_locate, "path string, at long, length long")
    total = packages.agg(F.sum("bytes")).first()[0] or 0
    tasks = max(spark.sparkContext.defaultParallelism, -(-total // TASK_BYTES))
    places = places.repartition(tasks, "path", F.expr(f"at div {SPAN}"))
    return places.mapInArrow(_fetch(columns), ", ".join(f"{c} {kinds.get(c, 'string')}" for c in columns))
