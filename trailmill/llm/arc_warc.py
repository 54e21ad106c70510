"""Legacy archives: ARC 1 and 2 are read by their header lines and declared lengths, and written as WARC.

An archive is a row (path, content), as Spark's binaryFile source gives it. Its first record says the
version, and with it how many fields a header line has. Every record then is a line, the declared
number of bytes, and a line break. Each becomes a WARC record: its identifier is made from its
ordinal, its timestamp from the 14-digit date, its type from the scheme and from whether an equal
payload is held elsewhere, its digests (SHA-1 in base 32) from its bytes.

Of records with equal payloads of at least LEAST_REVISIT bytes, the one with the largest ordinal is
a response and the others revisit it; smaller ones are all responses. Groups and decisions are made on
a table of keys (file, offset, digest), never on bodies: the join that tells each record its group's
response is of two written tables, so the planner splits a group of any size. What was decided then goes
to the archives as one list for each file, so bodies travel at most once, and only if these lists are too
many to be broadcast.

WARC files go to the shared folder, one gzip member for each record, each attempt of a task under
names of its own; only the files of finished attempts are in the manifest, which is a table.

Defined cases: a null payload is an empty one; a null URL is "-"; blanks in a URL are percent-coded.
Records with a null ordinal are responses. Records equal in payload and ordinal are the same record
written twice: all with the largest ordinal are responses. A very long payload is in memory alone.
An empty table gives no files and an empty result. Extra columns are not read.

Damage ends no job: `rejects` lists what can't be read (a length that goes past the end, a header line with too few fields or a date
that is none, a broken gzip member, a file of another version), by file and byte, and reading goes on at the next line that can be a
header. Headers are Latin-1, URLs percent-coded; a date of twelve digits has no seconds. Gzip members are read one behind
the other. A whole archive is one row, so archives of over 2 GB are to be cut before.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator
from datetime import UTC, datetime, timedelta

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ROWS, folder, staged, utf8

LEAST_REVISIT = 1_000
#: Payload bytes of an ARC file, and compressed bytes of a WARC file, after which a new one begins.
ARC_BYTES = 4 << 20
WARC_BYTES = 64 << 20
LEVEL = 1

# The fields of the header line by version.
FIELDS = {
    "1": ("url", "ip", "date", "mime", "length"),
    "2": ("url", "ip", "date", "mime", "status", "checksum", "location", "offset", "filename", "length"),
}
NAMES = {
    "1": "URL IP-address Archive-date Content-type Archive-length",
    "2": "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
ORDINAL = b"X-Archive-Ordinal"


# ---- ARC -------------------------------------------------------------------------------------


def arc_file(name: str, version: str, records: list[dict]) -> bytes:
    """An ARC file of the records (url, ip, date, mime, block)."""
    about = f"{version} 0 trailmill\n{NAMES[version]}\n\n".encode()
    out = [_arc_record({"url": f"filedesc://{name}", "ip": "0.0.0.0", "date": "20000101000000", "mime": "text/plain", "block": about}, "1" if version == "1" else version, name, 0)]
    at = len(out[0])
    for record in records:
        out.append(_arc_record(record, version, name, at))
        at += len(out[-1])
    return b"".join(out)


def _arc_record(record: dict, version: str, name: str, at: int) -> bytes:
    block = record["block"]
    given = {**record, "status": "200", "checksum": hashlib.md5(block).hexdigest(), "location": "-", "offset": at, "filename": name, "length": len(block)}
    line = " ".join(str(given[f]) or "-" for f in FIELDS[version])
    return line.encode() + b"\n" + block + b"\n"


#: A line that can be a record's header, behind damage: a URL, an address, a date, a type and a length.
HEADER = re.compile(rb"(?m)^[A-Za-z][A-Za-z0-9+.-]*:[^ \n]* [0-9.:A-Fa-f]+ [0-9]{12,14} [^\n]* [0-9]+$")
GZIP = b"\x1f\x8b\x08"


def unpacked(content: bytes) -> tuple[bytes, list[tuple[int, str]]]:
    """An archive's bytes, its gzip members one behind the other if it has any, and what was lost: from which byte, and why.
    Behind a damaged member the next one is looked for."""
    if not content.startswith(GZIP[:2]):
        return content, []
    parts, lost, at, size = [], [], 0, 0
    while 0 <= at < len(content):
        unpack, held = zlib.decompressobj(31), b""
        try:
            held = unpack.decompress(memoryview(content)[at:])
            if not unpack.eof:
                raise zlib.error("cut off")
            at = len(content) - len(unpack.unused_data)
            if not unpack.unused_data.startswith(GZIP[:2]) and unpack.unused_data.strip(b"\0"):
                raise zlib.error("no member follows")
            at = at if unpack.unused_data.strip(b"\0") else len(content)
        except zlib.error as error:
            lost.append((size, f"a damaged gzip member at byte {at}: {error}"))
            at = content.find(GZIP, at + 1)
        parts.append(held)
        size += len(held)
    return b"".join(parts), lost


def _digits14(date: str) -> str:
    """A date of 14 digits, of which old writers left out the seconds."""
    date = date + "00" if len(date) == 12 else date
    if len(date) != 14 or not date.isascii() or not date.isdigit():
        raise ValueError(f"{date!r} is no date")
    datetime.strptime(date, "%Y%m%d%H%M%S")
    return date


def scan_arc(content: bytes) -> Iterator[tuple[dict | None, tuple[int, str] | None]]:
    """The records of an ARC file, without its first, and between them what can't be read: (record, None) or (None, (byte,
    reason)). Lengths are trusted where they fit; behind damage, reading goes on at the next line that can be a header."""
    content, lost = unpacked(content)
    yield from ((None, x) for x in lost)
    version, at = None, 0
    while at < len(content):
        end = content.find(b"\n", at)
        line = content[at : end if end >= 0 else len(content)].decode("latin-1").rstrip("\r")
        if end >= 0 and not line.strip():
            at = end + 1
            continue
        try:
            if end < 0:
                raise ValueError(f"no header line at byte {at}")
            parts = line.split(" ")
            if not parts[-1].isascii() or not parts[-1].isdigit():
                raise ValueError(f"the header line at byte {at} ends with no length")
            length = int(parts[-1])
            block = content[end + 1 : end + 1 + length]
            if len(block) != length:
                raise ValueError(f"the record at byte {at} declares {length} bytes, {len(block)} are left")
            if version is None:
                if not line.startswith("filedesc://"):
                    raise ValueError("an ARC file starts with a filedesc record")
                version = block.split(b" ", 1)[0].decode("latin-1")
                if version not in FIELDS:
                    yield None, (at, f"unknown ARC version {version}")
                    return
            else:
                fields = FIELDS[version]
                # Old writers left blanks in content types: what is between the fixed fields belongs there.
                extra = len(parts) - len(fields)
                if extra < 0:
                    raise ValueError(f"the header line at byte {at} has {len(parts)} fields, version {version} has {len(fields)}")
                parts = [*parts[:3], " ".join(parts[3 : 4 + extra]), *parts[4 + extra :]]
                record = dict(zip(fields, parts, strict=True))
                record["date"] = _digits14(record["date"])
                record["url"] = "".join(c if c < "\x7f" else f"%{ord(c):02X}" for c in record["url"])
                yield {**record, "version": version, "at": at, "block": block}, None
            at = end + 1 + length + 1
        except ValueError as error:
            yield None, (at, str(error))
            if version is None:
                return
            # A wrong date or field leaves the length as it is; else the next header line is the next record.
            follows = HEADER.search(content, end + 1) if end >= 0 else None
            at = follows.start() if follows else len(content)


def read_arc(content: bytes) -> Iterator[dict]:
    """The records of an ARC file without damage; raises at the first."""
    for record, bad in scan_arc(content):
        if bad:
            raise ValueError(bad[1])
        yield record


def http_split(block: bytes) -> tuple[bytes, bytes]:
    """Header, with the empty line, and payload of an HTTP answer; no header if there is none."""
    if block.startswith(b"HTTP/"):
        end = block.find(b"\r\n\r\n")
        if end >= 0:
            return block[: end + 4], block[end + 4 :]
    return b"", block


def header_value(header: bytes, name: bytes) -> str | None:
    for line in header.split(b"\r\n"):
        key, colon, value = line.partition(b":")
        if colon and key.strip().lower() == name.lower():
            return value.strip().decode("latin-1")
    return None


def ordinal_in(header: bytes) -> int | None:
    """The ordinal of a record, if its header has one that is a number of 64 bits."""
    try:
        number = int(header_value(header, ORDINAL) or "")
    except ValueError:
        return None
    return number if -(1 << 63) <= number < 1 << 63 else None


# ---- WARC ------------------------------------------------------------------------------------


def record_id(ordinal: int | None, salt: str = "") -> str:
    """A version 8 UUID that carries the ordinal: its 64 bits and 58 of their digest."""
    if ordinal is None:
        number = int.from_bytes(hashlib.sha1(salt.encode()).digest()[:8], "big")
        tag = hashlib.sha1(b"none" + number.to_bytes(8, "big")).digest()
    else:
        number = ordinal & (1 << 64) - 1
        tag = hashlib.sha1(number.to_bytes(8, "big")).digest()
    check = int.from_bytes(tag[:8], "big") >> 6
    # 48 bits, version, 12 bits, variant, 4 bits | 58 bits
    bits = (number >> 16) << 80 | 8 << 76 | (number >> 4 & 0xFFF) << 64 | 2 << 62 | (number & 0xF) << 58 | check
    digits = f"{bits:032x}"
    return f"<urn:uuid:{digits[:8]}-{digits[8:12]}-{digits[12:16]}-{digits[16:20]}-{digits[20:]}>"


def ordinal_of(identifier: str) -> int:
    bits = int(identifier.strip("<>").removeprefix("urn:uuid:").replace("-", ""), 16)
    number = (bits >> 80) << 16 | (bits >> 64 & 0xFFF) << 4 | bits >> 58 & 0xF
    return number - (1 << 64) if number >= 1 << 63 else number


def base32_sha1(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def warc_date(date14: str) -> str:
    return datetime.strptime(date14, "%Y%m%d%H%M%S").strftime("%Y-%m-%dT%H:%M:%SZ")


def warc_record(record: dict, refers_to: int | None) -> bytes:
    """The WARC record of a converted ARC record."""
    header, payload = http_split(record["block"])
    web = record["url"].split(":", 1)[0].lower() in ("http", "https")
    kind = "revisit" if refers_to is not None else "response" if web or header else "resource"
    block = header if kind == "revisit" else record["block"]
    lines = [
        ("WARC-Type", kind),
        ("WARC-Record-ID", record_id(record["ordinal"], f"{record['url']} {record['date']} {record['at']}")),
        ("WARC-Target-URI", record["url"]),
        ("WARC-Date", warc_date(record["date"])),
        ("WARC-IP-Address", record["ip"]),
        ("WARC-Payload-Digest", base32_sha1(payload)),
        ("WARC-Block-Digest", base32_sha1(block)),
        ("Content-Type", "application/http; msgtype=response" if header else record["mime"]),
        ("Content-Length", len(block)),
    ]
    if kind == "revisit":
        lines += [("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(refers_to))]
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in lines) + "\r\n"
    return head.encode() + block + b"\r\n\r\n"


def read_warc(data: bytes) -> tuple[dict[str, str], bytes]:
    """Header and block of one WARC record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/1."):
        raise ValueError("not a WARC record")
    fields = {k.lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:])}
    length = int(fields["content-length"])
    if rest[length:] != b"\r\n\r\n":
        raise ValueError("the declared length is not that of the block")
    return fields, rest[:length]


def members(stream, size: int = 1 << 20) -> Iterator[bytes]:
    """The gzip members of a stream, one at a time."""
    unpack, parts, left = zlib.decompressobj(31), [], b""
    while chunk := left or stream.read(size):
        parts.append(unpack.decompress(chunk))
        left = b""
        if unpack.eof:
            left = unpack.unused_data
            yield b"".join(parts)
            unpack, parts = zlib.decompressobj(31), []
    if any(parts):
        raise ValueError("the last gzip member is cut off")


# ---- tables ----------------------------------------------------------------------------------


def legacy_archives(pages: DataFrame, ordinal: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(path, content): ARC files of the pages, versions 1 and 2 in turn."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, files = TaskContext.get().partitionId(), 0
        for batch in batches:
            held: list[dict] = []
            size = 0
            parts = (batch.slice(at, ROWS) for at in range(0, batch.num_rows, ROWS))
            rows = (row for p in parts for row in zip(p.column(0).to_pylist(), p.column(1).to_pylist(), utf8(p.column(2)), strict=True))
            for k, (number, address, payload) in enumerate(rows):
                # A second for each ordinal, within one year.
                date = datetime(2008, 1, 1, tzinfo=UTC) + timedelta(seconds=(number or 0) % 31_536_000)
                head = [b"HTTP/1.1 200 OK", b"Content-Type: text/html; charset=utf-8", b"Content-Length: %d" % len(payload)]
                head += [] if number is None else [b"%s: %d" % (ORDINAL, number)]
                clean = "".join(c if c > " " else f"%{ord(c):02X}" for c in address or "-") or "-"
                block = b"\r\n".join([*head, b"", payload])
                held.append({"url": clean, "ip": "0.0.0.0", "date": date.strftime("%Y%m%d%H%M%S"), "mime": "text/html", "block": block})
                size += len(block)
                if size >= ARC_BYTES or k == batch.num_rows - 1:
                    name = f"{part:06d}-{files:06d}.arc"
                    content = arc_file(name, "12"[(part + files) % 2], held)
                    yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([content], pa.binary())], ["path", "content"])
                    held, size, files = [], 0, files + 1

    rows = pages.select(F.col(ordinal).cast("bigint"), F.col(url), F.col(html))
    return rows.mapInArrow(write, "path string, content binary")


KEY = "path string, at bigint, ordinal bigint, payload_bytes bigint, payload_sha1 string"


def record_keys(archives: DataFrame) -> DataFrame:
    """One row for each record of the archives (path, content): where it is, and what finds equal payloads."""
    names = [f.split()[0] for f in KEY.split(", ")]
    kinds = [pa.int64() if f.endswith("bigint") else pa.string() for f in KEY.split(", ")]

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                rows = []
                for r, bad in scan_arc(content.as_py() or b""):
                    if bad is None:
                        header, payload = http_split(r["block"])
                        rows.append((path, r["at"], ordinal_in(header), len(payload), hashlib.sha1(payload).hexdigest()))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    return archives.select("path", "content").mapInArrow(parse, KEY)


def rejects(archives: DataFrame) -> DataFrame:
    """(path, at, reason) of what the archives (path, content) hold and `convert` leaves out: where in the unpacked file, and why."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                bad = [b for _, b in scan_arc(content.as_py() or b"") if b]
                if bad:
                    yield pa.RecordBatch.from_arrays([pa.array([path] * len(bad)), pa.array([at for at, _ in bad], pa.int64()), pa.array([why for _, why in bad])], ["path", "at", "reason"])

    return archives.select("path", "content").mapInArrow(parse, "path string, at bigint, reason string")


def revisits(keys: DataFrame) -> DataFrame:
    """(path, revisits): of every archive the places of records whose payload another record keeps, and
    that record's ordinal."""
    keys = staged(keys, "arc-keys")
    group = ["payload_sha1", "payload_bytes"]
    some = keys.where(f"payload_bytes >= {LEAST_REVISIT} and ordinal is not null")
    kept = staged(some.groupBy(*group).agg(F.max("ordinal").alias("response"), F.count("*").alias("n")).where("n > 1").drop("n"), "arc-responses")
    found = some.join(kept, group).where("ordinal <> response")
    return staged(found.groupBy("path").agg(F.collect_list(F.struct("at", "response")).alias("revisits")), "arc-revisits")


def convert(archives: DataFrame, to: str | None = None) -> DataFrame:
    """Writes the archives' records as WARC files; the manifest (path, records) of finished files. The
    archives are read twice, so what makes them should be stored, or cheap."""
    to = to or folder(archives.sparkSession, "warc")
    rows = archives.select("path", "content").join(revisits(record_keys(archives)), "path", "left").select("content", "revisits")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        task = TaskContext.get()
        system, root = fs.FileSystem.from_uri(to)
        system.create_dir(root, recursive=True)
        done: list[tuple[str, int]] = []
        out, size, count = None, 0, 0
        try:
            for batch in batches:
                for content, decided in zip(batch.column(0), batch.column(1), strict=True):
                    refers = {d["at"]: d["response"] for d in decided.as_py() or ()}
                    for record, bad in scan_arc(content.as_py() or b""):
                        if bad is not None:
                            continue
                        if out is None:
                            name = f"{task.partitionId():06d}-{task.taskAttemptId()}-{len(done):04d}.warc.gz"
                            out, size, count = system.open_output_stream(f"{root}/{name}", compression=None), 0, 0
                            done.append((name, 0))
                        record["ordinal"] = ordinal_in(http_split(record["block"])[0])
                        pack = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
                        data = pack.compress(warc_record(record, refers.get(record["at"]))) + pack.flush()
                        out.write(data)
                        size, count = size + len(data), count + 1
                        done[-1] = (done[-1][0], count)
                        if size >= WARC_BYTES:
                            out.close()
                            out = None
        finally:
            if out is not None:
                out.close()
        if done:
            yield pa.RecordBatch.from_arrays([pa.array([f"{to}/{n}" for n, _ in done]), pa.array([c for _, c in done], pa.int64())], ["path", "records"])

    return staged(rows.mapInArrow(write, "path string, records bigint"), "warc-manifest")


READ = "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, url string, date string"


def read_back(manifest: DataFrame) -> DataFrame:
    """One row for each record of the WARC files. Payloads' digests are checked against the bytes."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        names = [f.split()[0] for f in READ.split(", ")]
        kinds = [pa.int64() if f.endswith("bigint") else pa.string() for f in READ.split(", ")]
        for batch in batches:
            for path in batch.column(0).to_pylist():
                system, place = fs.FileSystem.from_uri(path)
                rows = []
                with system.open_input_stream(place, compression=None) as stream:
                    for data in members(stream):
                        fields, block = read_warc(data)
                        header, payload = http_split(block)
                        digest = fields["warc-payload-digest"]
                        if fields["warc-type"] != "revisit" and digest != base32_sha1(payload):
                            raise ValueError(f"a payload in {path} is not that of its digest")
                        size = int(header_value(header, b"Content-Length") or len(payload))
                        number = header_value(header, ORDINAL)
                        target = fields.get("warc-refers-to")
                        rows.append(
                            (
                                None if number is None else int(number),
                                size,
                                base64.b32decode(digest.removeprefix("sha1:")).hex(),
                                fields["warc-type"],
                                None if target is None else ordinal_of(target),
                                fields["warc-target-uri"],
                                fields["warc-date"],
                            )
                        )
                        if len(rows) == 4096:
                            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)
                            rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    parts = max(1, int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return manifest.select("path").repartition(parts).mapInArrow(read, READ)


def digest(pages: DataFrame) -> DataFrame:
    """The result of the query: all pages, by way of ARC and WARC files."""
    records = read_back(convert(staged(legacy_archives(pages), "arc")))
    kind = F.when(F.col("record_type") == "resource", "response").otherwise(F.col("record_type"))
    return records.select("page_id", "payload_bytes", "payload_digest", kind.alias("record_type"), "refers_to")
