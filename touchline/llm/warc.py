"""WARC derivatives: responses become linked metadata records and plain-text conversion records.

`responses` turns pages into response records; `derive` makes of each response a conversion record (plain text) and a
metadata record, both with WARC-Refers-To of the response and with its target, date, source headers and digests kept;
`write_files` / `read_files` store and scan WARC 1.1 files (a gzip member a record) with an offset index.

Null html: a response with an empty payload, whose conversion is empty. Null url: no WARC-Target-URI. Record ids are
name-based on page_id, url and payload, so a task that is run again makes the same records. Rows with equal page_id, url
and html are one capture: each row gives the same record under the same id, and a file holds it once. Header names are
read in any case and with or without blanks after the colon; folded lines are joined, repeated names listed. A
WARC-Page-Id that is no number reads as null; a record without its length is an error. Files are read record by record.
Very long pages are one record each, whole. Extra columns are ignored, whatever their names. An empty table makes no
records. There are no ties: equal records are equal in every field.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import json
import re
import uuid
import zlib
from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import parts
from .html_extraction import blocks
from .token_files import open_fs

DATE = "2020-01-01T00:00:00Z"
#: Headers of a response that its derivatives keep, under the same names.
KEPT = ("WARC-Target-URI", "WARC-Date", "WARC-Page-Id")
RECORD = "page_id long, record_type string, record_id string, refers_to string, target_uri string, payload_digest string, block_digest string, content_length long, record binary"


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(*of) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, '|'.join(map(str, of)))}>"


def record(headers: dict[str, str | None], block: bytes) -> bytes:
    """One record as WARC 1.1 writes it; headers without a value are left out."""
    lines = [f"{k}: {v}" for k, v in headers.items() if v is not None]
    return "\r\n".join(["WARC/1.1", *lines, f"Content-Length: {len(block)}", "", ""]).encode("utf-8", "surrogatepass") + block + b"\r\n\r\n"


#: The spelling under which known headers are kept.
SPELLING = {h.lower(): h for h in (*KEPT, "WARC-Type", "WARC-Record-ID", "WARC-Refers-To", "WARC-Payload-Digest", "WARC-Block-Digest", "WARC-Source-Payload-Digest", "WARC-Concurrent-To", "Content-Type", "Content-Length")}


def header_lines(lines: list[str]) -> dict[str, str]:
    """Headers by name. Folded lines belong to the one before, values of one name are listed, lines without a colon go."""
    unfolded: list[str] = []
    for x in lines:
        if x[:1] in (" ", "\t") and unfolded:
            unfolded[-1] += " " + x.strip()
        elif ":" in x:
            unfolded.append(x)
    out: dict[str, str] = {}
    for x in unfolded:
        name, _, value = x.partition(":")
        name = SPELLING.get(name.strip().lower(), name.strip())
        out[name] = f"{out[name]}, {value.strip()}" if name in out else value.strip()
    return out


def read_records(chunks: Iterable[bytes]) -> Iterator[tuple[dict[str, str], bytes, bytes]]:
    """Headers, block and all bytes of each record of a stream; one record is held at a time."""
    chunks, data = iter(chunks), bytearray()

    def more() -> bool:
        got = next(chunks, None)
        if got:
            data.extend(got)
        return got is not None

    while True:
        blank = 0  # line ends between records
        while True:
            while blank < len(data) and data[blank] in b"\r\n":
                blank += 1
            if blank < len(data) or not more():
                break
        del data[:blank]
        if not data:
            return
        seen = 0
        while (end := data.find(b"\r\n\r\n", max(0, seen - 3))) < 0:
            seen = len(data)
            if not more():
                raise ValueError("a WARC record is cut off in its headers")
        version, *lines = data[:end].decode("utf-8", "surrogateescape").split("\r\n")
        headers = header_lines(lines)
        if not version.startswith("WARC/") or not headers.get("Content-Length", "").isdigit():
            raise ValueError(f"no WARC record: {version[:80]!r}")
        size = end + 4 + int(headers["Content-Length"])
        while len(data) < size:
            if not more():
                raise ValueError("a WARC record is cut off in its block")
        yield headers, bytes(data[end + 4 : size]), bytes(data[:size]) + b"\r\n\r\n"
        del data[:size]


def parse(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of each record in `data`."""
    for headers, block, _ in read_records([data]):
        yield headers, block


def unzipped(file, size: int = 1 << 20) -> Iterator[bytes]:
    """The bytes of a file of gzip members, or of a plain one."""
    z, first = None, True
    while raw := file.read(size):
        if first and raw[:2] != b"\x1f\x8b":
            yield raw
            yield from iter(lambda: file.read(size), b"")
            return
        first = False
        while raw:
            z = z or zlib.decompressobj(31)
            yield z.decompress(raw)
            raw = z.unused_data
            z = None if z.eof else z


def http_payload(block: bytes) -> tuple[dict[str, str], bytes]:
    """Status line (under the empty name) and headers of an HTTP response, and its payload."""
    head, _, payload = block.partition(b"\r\n\r\n")
    status, *lines = head.decode("latin-1").split("\r\n")
    return {"": status} | header_lines(lines), payload


def one_line(value: str | None) -> str | None:
    return None if value is None else " ".join(value.split())


def response(page_id, url: str | None, html: str | None) -> bytes:
    payload = (html or "").encode("utf-8", "surrogatepass")
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload) + payload
    own = digest(payload)
    return record({"WARC-Type": "response", "WARC-Record-ID": record_id("response", page_id, url, own), "WARC-Date": DATE, "WARC-Target-URI": one_line(url), "WARC-Page-Id": None if page_id is None else str(page_id), "Content-Type": "application/http; msgtype=response", "WARC-Payload-Digest": own, "WARC-Block-Digest": digest(block)}, block)


def derivatives(headers: dict[str, str], block: bytes) -> list[bytes]:
    """The conversion and the metadata record of one response record."""
    http, payload = http_payload(block)
    text = "\n".join(blocks(payload.decode("utf-8", "replace"))).encode("utf-8", "surrogatepass")
    source = headers.get("WARC-Record-ID")
    linked = {k: headers.get(k) for k in KEPT} | {"WARC-Refers-To": source, "WARC-Refers-To-Target-URI": headers.get("WARC-Target-URI"), "WARC-Refers-To-Date": headers.get("WARC-Date"), "WARC-Source-Payload-Digest": headers.get("WARC-Payload-Digest")}
    conversion = {"WARC-Type": "conversion", "WARC-Record-ID": record_id("conversion", source)} | linked | {"Content-Type": "text/plain; charset=utf-8", "WARC-Block-Digest": digest(text)}
    about = json.dumps({"envelope": {k: v for k, v in headers.items()}, "http": http, "payload-length": len(payload), "conversion": conversion["WARC-Record-ID"], "conversion-digest": conversion["WARC-Block-Digest"], "conversion-chars": len(text.decode("utf-8", "surrogatepass"))}, ensure_ascii=False, sort_keys=True).encode("utf-8", "surrogatepass")
    metadata = {"WARC-Type": "metadata", "WARC-Record-ID": record_id("metadata", source), "WARC-Concurrent-To": conversion["WARC-Record-ID"]} | linked | {"Content-Type": "application/json", "WARC-Block-Digest": digest(about)}
    return [record(conversion, text), record(metadata, about)]


def number(value: str | None) -> int | None:
    """A 64-bit number, or None."""
    return int(value) if value and re.fullmatch(r"-?\d{1,19}", value) and -(2**63) <= int(value) < 2**63 else None


def row(raw: bytes) -> tuple:
    (headers, block, raw), = read_records([raw])
    own = headers.get("WARC-Payload-Digest") or headers.get("WARC-Source-Payload-Digest")
    return (number(headers.get("WARC-Page-Id")), headers.get("WARC-Type"), headers.get("WARC-Record-ID"), headers.get("WARC-Refers-To"), headers.get("WARC-Target-URI"), own, headers.get("WARC-Block-Digest"), len(block), raw)


def _batch(rows: Iterable[tuple]):
    import pyarrow as pa

    kinds = (pa.int64(), *[pa.string()] * 6, pa.int64(), pa.binary())
    rows = list(rows)
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=[c.split()[0] for c in RECORD.split(", ")])


def responses(pages: DataFrame) -> DataFrame:
    """A response record of every row of pages(page_id, url, html)."""

    def batches(it):
        for b in it:
            for at in range(0, b.num_rows, 200):
                yield _batch(row(response(*p)) for p in zip(*(b.column(k).slice(at, 200).to_pylist() for k in range(3))))

    return pages.select("page_id", "url", "html").mapInArrow(batches, RECORD)


def derive(records: DataFrame) -> DataFrame:
    """Two linked records of every response among `records`; records of other types make none."""

    def batches(it):
        for b in it:
            raws = b.column(0)
            for at in range(0, b.num_rows, 200):
                yield _batch(row(d) for raw in raws.slice(at, 200).to_pylist() for h, block in parse(raw) if h.get("WARC-Type") == "response" for d in derivatives(h, block))

    return records.where("record_type = 'response'").select("record").mapInArrow(batches, RECORD)


def write_files(records: DataFrame, uri: str, files: int | None = None) -> DataFrame:
    """Writes `part-N.warc.gz`, a gzip member a record; returns the index: file, offset, length, record_id, record_type."""
    import pyarrow as pa

    spark = records.sparkSession
    system, folder = open_fs(uri)
    system.create_dir(folder, recursive=True)

    def save(it):
        from pyspark import TaskContext

        system, folder = open_fs(uri)
        context = TaskContext.get()
        name = f"part-{context.partitionId():05d}.warc.gz"
        temporary, at, index, last = f"{folder}/.{name}-{context.taskAttemptId()}", 0, [], None
        with system.open_output_stream(temporary, compression=None) as f:
            for b in it:
                for kind, rid, raw in zip(*(c.to_pylist() for c in b.columns)):
                    if rid is not None and rid == last:  # the same record once more
                        continue
                    last = rid
                    member = gzip.compress(raw, 6, mtime=0)
                    f.write(member)
                    index.append((f"{uri}/{name}", at, len(member), rid, kind))
                    at += len(member)
        system.move(temporary, f"{folder}/{name}")
        if index:
            yield pa.RecordBatch.from_arrays([pa.array(list(c)) for c in zip(*index)], names=["file", "offset", "length", "record_id", "record_type"])

    dealt = records.select("record_type", "record_id", "record").repartition(files or parts(spark), "record_id").sortWithinPartitions("record_id")
    dealt.mapInArrow(save, "file string, offset long, length long, record_id string, record_type string").write.parquet(f"{uri}/index")
    return spark.read.parquet(f"{uri}/index")


def read_files(spark: SparkSession, uri: str) -> DataFrame:
    """All records of the WARC files in folder `uri`, zipped or not; a task reads whole files, record by record."""
    from pyarrow import fs

    system, folder = open_fs(uri)
    names = sorted(f.base_name for f in system.get_file_info(fs.FileSelector(folder)) if f.base_name.endswith((".warc", ".warc.gz")) and not f.base_name.startswith("."))

    def batches(it):
        system, folder = open_fs(uri)
        for b in it:
            for name in b.column(0).to_pylist():
                rows, size = [], 0
                with system.open_input_stream(f"{folder}/{name}", compression=None) as f:
                    for _, _, raw in read_records(unzipped(f)):
                        rows.append(row(raw))
                        size += len(raw)
                        if size > 4 << 20:
                            yield _batch(rows)
                            rows, size = [], 0
                yield _batch(rows)

    files = spark.createDataFrame([(n,) for n in names], "name string")
    return files.repartition(max(1, min(len(names), parts(spark)))).mapInArrow(batches, RECORD)


def digests(records: DataFrame) -> DataFrame:
    """The columns of records without their bytes."""
    return records.select("page_id", "record_type", "record_id", "refers_to", "target_uri", "payload_digest", "block_digest", "content_length", F.sha2("record", 256).alias("record_sha256"))
