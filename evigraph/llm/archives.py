"""Legacy web archives (ARC) and their conversion to WARC.

ARC files come in two versions whose record lines have different fields; both end in the declared
length of the content. The converter parses each line by its file's version, takes exactly the
declared bytes, and synthesises what WARC asks for: identifiers, timestamps, types and digests.
Both kinds of archive are written as one gzip member a record. Files are read and written through
Arrow's file systems at the shared folder, under names of their own for each task attempt; only
files named in a finished task's output are used, so that a lost executor leaves orphans at most.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyarrow import fs as arrow_fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evigraph.llm.shared import Scratch

#: The fields of a record line by ARC version; the length is always last.
ARC_FIELDS = {
    "1": ("url", "ip", "date", "content_type", "length"),
    "2": ("url", "ip", "date", "content_type", "result", "checksum", "location", "offset", "filename", "length"),
}
ARC_TITLES = {
    "1": "URL IP-address Archive-date Content-type Archive-length",
    "2": "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
#: A file is closed and the next begun beyond this size.
FILE_BYTES = 64 << 20
#: Payloads from this size on are stored once.
REVISIT_BYTES = 100
LEVEL = 5
_SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")
_CHUNK = 1 << 20


def _open(uri: str):
    return arrow_fs.FileSystem.from_uri(uri)


def gzip_member(data: bytes) -> bytes:
    packer = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def members(uri: str) -> Iterator[bytes]:
    """The gzip members of a file, one after another."""
    system, path = _open(uri)
    with system.open_input_stream(path, compression=None) as f:
        unpacker, parts, data = zlib.decompressobj(31), [], f.read(_CHUNK)
        while data:
            parts.append(unpacker.decompress(data))
            if unpacker.eof:
                yield b"".join(parts)
                data, parts = unpacker.unused_data or f.read(_CHUNK), []
                unpacker = zlib.decompressobj(31)
            else:
                data = f.read(_CHUNK)
        if any(parts):
            raise ValueError(f"{uri} ends within a record")


# ARC


def _word(value: str) -> str:
    """A field of a record line: no white space, never empty."""
    return "".join(f"%{ord(c):02X}" if c.isspace() and ord(c) < 128 else "%20" if c.isspace() else c for c in value) or "-"


def arc_head(version: str, name: str, date: str) -> bytes:
    """The version block that opens an ARC file."""
    body = f"{version} 0 archive\n{ARC_TITLES[version]}\n".encode()
    return arc_record(version, {"url": f"filedesc://{name}", "ip": "0.0.0.0", "date": date, "content_type": "text/plain", "result": "200", "filename": name}, body)


def arc_record(version: str, head: dict[str, str], content: bytes) -> bytes:
    line = " ".join(str(len(content)) if name == "length" else _word(head.get(name, "")) for name in ARC_FIELDS[version])
    return line.encode() + b"\n" + content + b"\n"


@dataclass
class ArcRecord:
    head: dict[str, str]
    content: bytes


def parse_arc(blocks: Iterator[bytes]) -> Iterator[ArcRecord]:
    """Records of an ARC file given as its members (or as one block); the first is the version block.

    The version block tells the fields of the lines after it. Content may hold anything, also
    line ends: its end is told by the declared length alone.
    """
    version = None
    for block in blocks:
        at = 0
        while at < len(block):
            if block[at : at + 1] in (b"\n", b"\r"):
                at += 1
                continue
            end = block.index(b"\n", at)
            words = block[at:end].decode("utf-8", "replace").rstrip("\r").split(" ")
            length = int(words[-1])
            content = block[end + 1 : end + 1 + length]
            if len(content) != length:
                raise ValueError("a record is shorter than its declared length")
            at = end + 1 + length
            if version is None:
                if not words[0].startswith("filedesc:"):
                    raise ValueError("no version block")
                version = content.split(b" ", 1)[0].decode()
                if version not in ARC_FIELDS:
                    raise ValueError(f"ARC version {version}")
            fields = ARC_FIELDS[version]
            if len(words) != len(fields):
                raise ValueError(f"a record line has {len(words)} fields, version {version} has {len(fields)}")
            yield ArcRecord(dict(zip(fields, words)), content)


def warc_date(date: str) -> str:
    """An ARC date (8 to 14 digits; years of two digits only in 12-digit dates before 1970) as ISO 8601."""
    digits = date if date.isdigit() else ""
    if len(digits) == 12 and not digits.startswith(("19", "20")):
        digits = "19" + digits
    digits = (digits + "00000101000000"[len(digits) :])[:14] if len(digits) >= 4 else "19700101000000"
    return f"{digits[:4]}-{digits[4:6]}-{digits[6:8]}T{digits[8:10]}:{digits[10:12]}:{digits[12:14]}Z"


# WARC


@dataclass
class WarcRecord:
    head: dict[str, str]
    block: bytes
    http: dict[str, str] = field(default_factory=dict)
    payload: bytes = b""


def warc_bytes(head: dict[str, str], block: bytes) -> bytes:
    lines = ["WARC/1.1", *(f"{k}: {v}" for k, v in head.items()), f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(lines).encode() + block + b"\r\n\r\n"


def _fields(lines: list[bytes]) -> dict[str, str]:
    pairs = (x.decode("utf-8", "replace").partition(":") for x in lines if b":" in x)
    return {k.strip(): v.strip() for k, _, v in pairs}


def split_http(block: bytes) -> tuple[dict[str, str], bytes, int]:
    """Header fields, payload and where the payload begins."""
    at = block.find(b"\r\n\r\n")
    if not block.startswith(b"HTTP/") or at < 0:
        return {}, block, 0
    return _fields(block[:at].split(b"\r\n")[1:]), block[at + 4 :], at + 4


def parse_warc(data: bytes) -> WarcRecord:
    """One record, by its declared length."""
    end = data.index(b"\r\n\r\n")
    lines = data[:end].split(b"\r\n")
    if not lines[0].startswith(b"WARC/"):
        raise ValueError("not a WARC record")
    head = _fields(lines[1:])
    length = int(head["Content-Length"])
    block = data[end + 4 : end + 4 + length]
    if len(block) != length:
        raise ValueError("a record is shorter than its declared length")
    http, payload, _ = split_http(block)
    return WarcRecord(head, block, http, payload)


def record_id(*parts: str) -> str:
    """An identifier that depends on the record alone, so that a repeated task writes the same."""
    return f"<urn:uuid:{uuid.uuid5(_SPACE, chr(0).join(parts))}>"


def convert(record: ArcRecord, original: str | None = None) -> bytes:
    """The WARC record of an ARC record.

    original: the identifier of the response that holds the same payload, for a revisit. The
    version block becomes a warcinfo, HTTP content a response, any other content a resource.
    """
    head, url = record.head, record.head["url"]
    date = warc_date(head["date"])
    if url.startswith("filedesc:"):
        return warc_bytes({"WARC-Type": "warcinfo", "WARC-Record-ID": record_id(url, date), "WARC-Date": date, "WARC-Filename": url.partition("//")[2], "Content-Type": "application/warc-fields"}, record.content)
    http, payload, at = split_http(record.content)
    digest = hashlib.sha256(payload).hexdigest()
    kind = "response" if at else "resource"
    out = {
        "WARC-Type": "revisit" if original else kind,
        "WARC-Record-ID": record_id(http.get("X-Page-Id", url), digest, "revisit" if original else "first"),
        "WARC-Date": date,
        "WARC-Target-URI": url,
        "WARC-IP-Address": head["ip"],
        "WARC-Payload-Digest": f"sha256:{digest}",
        "Content-Type": "application/http; msgtype=response" if at else head["content_type"],
    }
    block = record.content
    if original:
        out |= {"WARC-Refers-To": original, "WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"}
        block = record.content[:at]
    else:
        out["WARC-Block-Digest"] = f"sha256:{hashlib.sha256(block).hexdigest()}"
    return warc_bytes(out, block)


# Spark


class _Writer:
    """Files of bounded size under names of their own."""

    def __init__(self, root: str, suffix: str):
        self.system, self.root = _open(root)
        self.scheme = root[: len(root) - len(self.root)] if root.endswith(self.root) else ""
        self.system.create_dir(self.root, recursive=True)
        self.suffix, self.out, self.size = suffix, None, 0

    def begin(self) -> str:
        self.close()
        self.name = f"{uuid.uuid4().hex}{self.suffix}"
        self.out, self.size = self.system.open_output_stream(f"{self.root}/{self.name}", compression=None), 0
        return self.name

    @property
    def uri(self) -> str:
        return f"{self.scheme}{self.root}/{self.name}"

    def write(self, data: bytes) -> None:
        self.out.write(data)
        self.size += len(data)

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
            self.out = None


def write_arc(pages: DataFrame, key: str, url: str, html: str, root: str) -> DataFrame:
    """Write every page into ARC files under root; returns page_id, path, ordinal, payload_bytes, payload_digest.

    Null html is an empty payload, a null url is written as "-", a null key leaves its HTTP field
    out. The two versions alternate from file to file.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer, at, count = _Writer(root, ".arc.gz"), 0, 0
        for batch in batches:
            rows = {k: [] for k in ("page_id", "path", "ordinal", "payload_bytes", "payload_digest")}
            for page, address, text in zip(batch.column(0), batch.column(1), batch.column(2)):
                if writer.out is None or writer.size > FILE_BYTES:
                    name = writer.begin()
                    version, at, count = "12"[int(name[0], 16) % 2], 0, count + 1
                    writer.write(gzip_member(arc_head(version, name, "20240101000000")))
                page, payload = page.as_py(), (text.as_py() or "").encode()
                tag = "" if page is None else f"X-Page-Id: {page}\r\n"
                http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n{tag}\r\n".encode()
                head = {"url": address.as_py() or "", "ip": "0.0.0.0", "date": "20240101000000", "content_type": "text/html", "result": "200", "offset": str(writer.size), "filename": writer.name}
                writer.write(gzip_member(arc_record(version, head, http + payload)))
                at += 1
                for k, v in zip(rows, (page, writer.uri, at, len(payload), hashlib.sha256(payload).hexdigest())):
                    rows[k].append(v)
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(rows.values(), (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()))], names=list(rows))
        writer.close()

    chosen = pages.select(F.col(key).cast("long").alias("page_id"), F.col(url).alias("url"), F.col(html).alias("html"))
    return chosen.mapInArrow(run, "page_id long, path string, ordinal long, payload_bytes long, payload_digest string")


def originals(manifest: DataFrame) -> DataFrame:
    """The manifest with refers_to: the smallest page of an equal payload, where that is another page."""
    first = manifest.filter(F.col("payload_bytes") >= REVISIT_BYTES).groupBy("payload_digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1 and first is not null").drop("n")
    return manifest.join(first, "payload_digest", "left").withColumn("refers_to", F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first"))).drop("first")


def convert_arcs(manifest: DataFrame, root: str, files: int) -> DataFrame:
    """Convert so many ARC files to WARC files under root, each in a group of its own that is dealt to one of as many tasks; returns path and records.

    manifest: path, ordinal, payload_digest, refers_to for every record of these files.
    """

    def run(table: pa.Table) -> pa.Table:
        source = table.column("path")[0].as_py()
        refers = {o.as_py(): (r.as_py(), d.as_py()) for o, r, d in zip(table.column("ordinal"), table.column("refers_to"), table.column("payload_digest"))}
        writer, done = _Writer(root, ".warc.gz"), 0
        writer.begin()
        for n, record in enumerate(parse_arc(members(source))):
            first, digest = refers.get(n, (None, None))
            writer.write(gzip_member(convert(record, None if first is None else record_id(str(first), digest, "first"))))
            done += n > 0
        writer.close()
        return pa.table({"path": [writer.uri], "records": pa.array([done], pa.int64())})

    return manifest.select("path", "ordinal", "payload_digest", "refers_to").repartition(max(1, files), "path").groupBy("path").applyInArrow(run, "path string, records long")


def read_warcs(files: DataFrame) -> DataFrame:
    """Every record but warcinfo of WARC files (column path), with digests recomputed.

    Columns: record_id, page_id, url, record_type, refers_id, payload_bytes, payload_digest. A
    payload whose digest differs from its header fails the read. A revisit's size and digest are
    those its headers give for the full payload.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ("record_id", "page_id", "url", "record_type", "refers_id", "payload_bytes", "payload_digest")
        types = (pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string())

        def batch_of(rows):
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=list(names))

        for batch in batches:
            for path in batch.column(0):
                rows = []
                for data in members(path.as_py()):
                    r = parse_warc(data)
                    kind = r.head["WARC-Type"]
                    if kind == "warcinfo":
                        continue
                    digest, size = r.head["WARC-Payload-Digest"].partition(":")[2], len(r.payload)
                    if kind == "revisit":
                        size = int(r.http["Content-Length"])
                    elif hashlib.sha256(r.payload).hexdigest() != digest:
                        raise ValueError(f"{r.head['WARC-Record-ID']}: the payload is not what was stored")
                    page = r.http.get("X-Page-Id")
                    rows.append((r.head["WARC-Record-ID"], None if page is None else int(page), r.head["WARC-Target-URI"], kind, r.head.get("WARC-Refers-To"), size, digest))
                    if len(rows) >= 5000:
                        yield batch_of(rows)
                        rows = []
                yield batch_of(rows)

    return files.select("path").mapInArrow(run, "record_id string, page_id long, url string, record_type string, refers_id string, payload_bytes long, payload_digest string")


def archive_pages(pages: DataFrame, key: str, url: str, html: str) -> DataFrame:
    """Write pages as legacy archives, convert these to WARC, and read the result back.

    One row per row of pages: page_id, payload_bytes, payload_digest, record_type, refers_to, url,
    record_id. Of equal payloads of at least REVISIT_BYTES, the smallest page is the response and
    the others revisit it; rows that repeat this smallest page are responses too. Null html is
    empty; a null page is never the smallest, and is a response if no other page has its payload.
    An empty table gives no rows. Only the three named columns are read.
    """
    spark = pages.sparkSession
    scratch = Scratch(spark, "archives")
    manifest = scratch.save(write_arc(pages, key, url, html, scratch.path("arc")), "manifest")
    arcs = manifest.select("path").distinct().count()
    files = scratch.save(convert_arcs(originals(manifest), scratch.path("warc"), arcs), "files")
    scratch.drop("arc")
    parts = max(1, min(files.count(), spark.sparkContext.defaultParallelism * 8))
    read = scratch.save(read_warcs(files.repartition(parts)), "read")
    first = read.filter("record_type <> 'revisit'").select(F.col("record_id").alias("refers_id"), F.col("page_id").alias("refers_to")).dropDuplicates(["refers_id"])
    again = read.filter("record_type = 'revisit'").join(first, "refers_id", "left")
    once = read.filter("record_type <> 'revisit'").withColumn("refers_to", F.lit(None).cast("long"))
    cols = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url", "record_id"]
    return once.select(cols).unionByName(again.select(cols))
