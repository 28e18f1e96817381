"""ARC files, and their conversion to WARC.

An ARC file starts with a version block that names the fields of its header lines:
five in version 1, ten in version 2. A header line is followed by as many bytes as its
last field declares. From these the converter makes what WARC asks for: a record id
(a name-based UUID of the ARC file's own name, the record's offset, address and date),
a date with separators, a type, block and payload digests, and revisit records for
payloads already stored. Files are gzip members, one per record.

The converter goes over the archives twice. First only ids, lengths and digests come
out and are grouped by payload digest; then every archive meets the list of its own
revisits and is rewritten by one task. Payloads are never shuffled, just whole
compressed archives, whose size ``file_bytes`` bounds except for single long records.

Inputs: a null body is empty, a null address is written as ``-``, blanks and controls in
addresses are percent-encoded. A null id is left out; such records are always responses
and are never referred to. Rows that repeat an id count as separate records, the first
by record id being the smallest. Other columns are ignored. An empty table gives no
records. A record cut short of its declared length is marked ``WARC-Truncated``.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewright.errors import PrepareError
from tablewright.functions.kinds import ref
from tablewright.llm.common import written

# Fixed values of the formats.
ARC_FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

LEVEL = 6  # of compression
ID_FIELD = "X-Page-Id"
DATE = "20240101000000"


# --- files of gzip members --------------------------------------------------------


def _member(data: bytes) -> bytes:
    packer = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def _members(raw: bytes) -> Iterator[tuple[int, bytes]]:
    """Offset and content of each member; what is not compressed is one member.

    A line feed may follow the last member. Anything else behind one, and a member without
    its end, raises an error: what stands there would be lost.
    """
    view, at = memoryview(raw), 0
    while view[at : at + 2] == b"\x1f\x8b":
        unpacker, parts, next_at = zlib.decompressobj(31), [], at
        while not unpacker.eof and next_at < len(raw):
            piece = view[next_at : next_at + 16_384]
            parts.append(unpacker.decompress(piece))
            next_at += len(piece)
        if not unpacker.eof:
            raise PrepareError("the archive ends inside a member", {"offset": at})
        yield at, b"".join(parts)
        at = next_at - len(unpacker.unused_data)
    if at and raw[at:] not in (b"", b"\n"):
        raise PrepareError("bytes behind a member are no member", {"offset": at})
    if not at and raw.strip(b"\n"):
        yield 0, raw


def _write(files: DataFrame, path: str) -> None:
    """Rows of one binary column as a file each; Spark's text writer copies the bytes."""
    files.select(F.col("file").cast("string").alias("value")).write.option("maxRecordsPerFile", 1).text(path)


def _open(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("path", "content")


# --- ARC ------------------------------------------------------------------------


@dataclass(frozen=True)
class ArcRecord:
    archive: str  # the file's own name for itself
    offset: int
    fields: dict
    block: bytes
    truncated: bool

    @property
    def record_id(self) -> str:
        named = f"{self.archive} {self.offset} {self.fields['URL']} {self.fields['Archive-date']}"
        return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, named)}>"

    @property
    def date(self) -> str:
        d = self.fields["Archive-date"].ljust(14, "0")
        return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"

    @property
    def is_http(self) -> bool:
        return self.block.startswith(b"HTTP/")

    def parts(self) -> tuple[bytes, bytes]:
        """HTTP head, with its empty line, and payload; no head outside HTTP."""
        end = self.block.find(b"\r\n\r\n") if self.is_http else -1
        return (self.block[: end + 4], self.block[end + 4 :]) if end >= 0 else (b"", self.block)


def head_field(head: bytes, name: str) -> str | None:
    found = re.search(rb"(?im)^" + name.encode() + rb":[ \t]*([^\r\n]*)", head)
    return found[1].decode("utf-8", "replace").strip() if found else None


def _address(url: str | None) -> str:
    if not url:
        return "-"
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)


def arc_header(version: int, values: dict, length: int) -> bytes:
    names = ARC_FIELDS[version].split(" ")
    line = " ".join([values.get(n, "-") for n in names[:-1]] + [str(length)])
    return line.encode("utf-8") + b"\n"


def read_arc(raw: bytes) -> Iterator[ArcRecord]:
    """Records of one ARC file, compressed by record, as a whole, or not at all."""
    archive, names = "", ARC_FIELDS[1].split(" ")
    for start, data in _members(raw):
        at = 0
        while at < len(data):
            end = data.find(b"\n", at)
            line = data[at : end if end >= 0 else len(data)].decode("utf-8", "replace").rstrip("\r")
            begin, at = at, end + 1 if end >= 0 else len(data)
            if not line.strip():
                continue
            if line.startswith("filedesc://"):
                # The version block's own line has version 1's fields, whatever follows.
                values = line.rsplit(" ", 4)
                length = int(values[-1])
                body = data[at : at + length].decode("utf-8", "replace").split("\n")
                archive, names = values[0].removeprefix("filedesc://"), body[1].rstrip("\r").split(" ")
                if int(body[0].split(" ")[0]) not in ARC_FIELDS or names[-1] != "Archive-length":
                    raise PrepareError("not an ARC version block", {"line": line})
                at += length
                continue
            values = line.rsplit(" ", len(names) - 1)  # an address may hold blanks
            if len(values) != len(names) or not values[-1].isdigit():
                raise PrepareError("not an ARC header line", {"line": line[:200], "fields": names})
            length = int(values[-1])
            block = data[at : at + length]
            yield ArcRecord(archive, start + begin, dict(zip(names, values)), block, len(block) < length)
            at += length


def write_arc(
    pages: DataFrame,
    path: str,
    version: int = 1,
    file_bytes: int = 8_000_000,
    page_id: str = "page_id",
    url: str = "url",
    body: str = "html",
) -> None:
    """Pages as HTTP responses in ARC files below ``path``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        files = 0
        parts: list[bytes] = []
        held = offset = 0
        for batch in batches:
            for key, address, payload in zip(*(c.to_pylist() for c in batch.columns)):
                if not parts:
                    intro = f"{version} 0 pages\n{ARC_FIELDS[version]}\n".encode()
                    own = {"URL": f"filedesc://pages-{task}-{files}.arc", "IP-address": "0.0.0.0"}
                    own |= {"Archive-date": DATE, "Content-type": "text/plain"}
                    parts = [_member(arc_header(1, own, len(intro)) + intro + b"\n")]
                    offset = len(parts[0])
                payload = payload or b""
                head = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
                head += f"{ID_FIELD}: {key}\r\n" if key is not None else ""
                block = f"{head}Content-Length: {len(payload)}\r\n\r\n".encode() + payload
                own = {"URL": _address(address), "IP-address": "0.0.0.0", "Archive-date": DATE}
                own |= {"Content-type": "text/html", "Result-code": "200", "Offset": str(offset)}
                own |= {"Filename": f"pages-{task}-{files}.arc"}
                parts.append(_member(arc_header(version, own, len(block)) + block + b"\n"))
                offset += len(parts[-1])
                held += len(block)
                if held >= file_bytes:
                    yield pa.RecordBatch.from_arrays([pa.array([b"".join(parts)], pa.binary())], ["file"])
                    files, parts, held = files + 1, [], 0
        if parts:
            yield pa.RecordBatch.from_arrays([pa.array([b"".join(parts)], pa.binary())], ["file"])

    chosen = pages.select(ref(page_id).cast("long"), ref(url), ref(body).cast("binary"))
    _write(chosen.toDF("page_id", "url", "body").mapInArrow(run, "file binary"), path)


# --- WARC -----------------------------------------------------------------------


def _digest(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def warc_record(arc: ArcRecord, original: tuple | None) -> bytes:
    """The WARC record of an ARC record; ``original`` is (record id, address, date) to revisit."""
    head, payload = arc.parts()
    kind = "response" if arc.is_http else "resource"
    block, mime = arc.block, arc.fields["Content-type"]
    fields = []
    if original:
        kind, block = "revisit", head
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", original[0])]
        fields += [("WARC-Refers-To-Target-URI", original[1]), ("WARC-Refers-To-Date", original[2])]
    if arc.is_http:
        mime = "application/http; msgtype=response"
    if arc.truncated:
        fields.append(("WARC-Truncated", "length"))
    fields = [
        ("WARC-Type", kind),
        ("WARC-Record-ID", arc.record_id),
        ("WARC-Date", arc.date),
        ("WARC-Target-URI", arc.fields["URL"]),
        ("WARC-IP-Address", arc.fields["IP-address"]),
        ("WARC-Payload-Digest", f"sha256:{_digest(payload)}"),
        ("WARC-Block-Digest", f"sha256:{_digest(block)}"),
        *fields,
        ("Content-Type", mime),
        ("Content-Length", str(len(block))),
    ]
    lines = "".join(f"{k}: {v}\r\n" for k, v in fields)
    return b"WARC/1.1\r\n" + lines.encode("utf-8") + b"\r\n" + block + b"\r\n\r\n"


def read_warc(raw: bytes) -> Iterator[tuple[dict, bytes]]:
    """Header fields (lower-case names) and block of each record of one WARC file."""
    for _, data in _members(raw):
        at = 0
        while at < len(data):
            end = data.find(b"\r\n\r\n", at)
            if end < 0 or not data.startswith(b"WARC/", at):
                raise PrepareError("not a WARC record", {"starts": data[at : at + 40].hex()})
            lines = data[at:end].decode("utf-8", "replace").split("\r\n")[1:]
            fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
            begin = end + 4
            at = begin + int(fields["content-length"])
            yield fields, data[begin:at]
            at += 4


ARCHIVED = "record_id string, page_id long, url string, date string, payload_bytes long, digest string, path string, offset long"


def _list_arc(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            rows = []
            for r in read_arc(raw):
                head, payload = r.parts()
                key = head_field(head, ID_FIELD)
                rows.append(
                    (
                        r.record_id,
                        int(key) if key else None,
                        r.fields["URL"],
                        r.date,
                        len(payload),
                        _digest(payload),
                        path,
                        r.offset,
                    )
                )
            if rows:
                names = ["record_id", "page_id", "url", "date", "payload_bytes", "digest", "path", "offset"]
                kinds = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64()]
                arrays = [pa.array(c, k) for c, k in zip(zip(*rows), kinds)]
                yield pa.RecordBatch.from_arrays(arrays, names)


def _convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for raw, revisits in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            originals = {r["offset"]: (r["to_id"], r["to_url"], r["to_date"]) for r in revisits or []}
            file = b"".join(_member(warc_record(r, originals.get(r.offset))) for r in read_arc(raw))
            if file:
                yield pa.RecordBatch.from_arrays([pa.array([file], pa.binary())], ["file"])


def arc_to_warc(spark: SparkSession, arc_path: str, warc_path: str, least_bytes: int = 100) -> None:
    """Convert the ARC files below ``arc_path``, one WARC file each.

    Of records with equal payloads of ``least_bytes`` or more, the one with the
    smallest page id is a response and the others revisit it.
    """
    archives = _open(spark, arc_path)
    listed = written(archives.mapInArrow(_list_arc, ARCHIVED), "warc-listing")
    large = listed.filter((F.col("payload_bytes") >= least_bytes) & F.col("page_id").isNotNull())
    first = F.min(F.struct("page_id", "record_id", "url", "date"))
    firsts = large.groupBy("digest").agg(first.alias("first"), F.count(F.lit(1)).alias("copies"))
    firsts = firsts.filter("copies > 1").select("digest", "first")
    revisits = (
        large.join(firsts, "digest")
        .filter(F.col("record_id") != F.col("first.record_id"))
        .groupBy("path")
        .agg(
            F.collect_list(
                F.struct(
                    "offset",
                    F.col("first.record_id").alias("to_id"),
                    F.col("first.url").alias("to_url"),
                    F.col("first.date").alias("to_date"),
                )
            ).alias("revisits")
        )
    )
    joined = archives.join(revisits, "path", "left").select("content", "revisits")
    _write(joined.mapInArrow(_convert, "file binary"), warc_path)


RECORDS = "record_id string, page_id long, record_type string, url string, date string, payload_bytes long, payload_digest string, refers_to_id string"


def _list_warc(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for raw in batch.column(0).to_pylist():
            rows = []
            for fields, block in read_warc(raw):
                if f"sha256:{_digest(block)}" != fields["warc-block-digest"]:
                    raise PrepareError("a block differs from its digest", {"record": fields["warc-record-id"]})
                end = block.find(b"\r\n\r\n") + 4 if block.startswith(b"HTTP/") else 0
                key = head_field(block[:end], ID_FIELD)
                revisit = fields["warc-type"] == "revisit"
                rows.append(
                    (
                        fields["warc-record-id"],
                        int(key) if key else None,
                        fields["warc-type"],
                        fields["warc-target-uri"],
                        fields["warc-date"],
                        # A revisit stores the head alone, which still names the payload's length.
                        int(head_field(block, "Content-Length") or 0) if revisit else len(block) - end,
                        fields["warc-payload-digest"].removeprefix("sha256:") if revisit else _digest(block[end:]),
                        fields.get("warc-refers-to"),
                    )
                )
            if rows:
                names = [c.split(" ")[0] for c in RECORDS.split(", ")]
                kinds = [pa.int64() if c.endswith("long") else pa.string() for c in RECORDS.split(", ")]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """A row per record of the WARC files below ``path``; ``refers_to`` is the page id revisited."""
    records = written(_open(spark, path).select("content").mapInArrow(_list_warc, RECORDS), "warc-records")
    ids = records.filter("record_type = 'response'").select(
        F.col("record_id").alias("refers_to_id"), F.col("page_id").alias("refers_to")
    )
    revisits = records.filter("record_type = 'revisit'").join(ids, "refers_to_id", "left")
    others = records.filter("record_type <> 'revisit'").withColumn("refers_to", F.lit(None).cast("long"))
    return others.unionByName(revisits)
