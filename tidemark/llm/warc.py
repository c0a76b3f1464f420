"""Converter of legacy ARC archives to WARC.

ARC files open with a `filedesc://` record whose body names the version and the fields of every header line. Version 1
lines have 5 fields, version 2 lines 10; both end with the declared length of the record's body. The converter parses
records by declared length, never by searching for the next header, and synthesises what WARC asks for: an identifier
(a UUID of URL, date, page id and the digest of the whole block, so a rerun gives the same), an ISO timestamp from the 14-digit date, record types, and
SHA-1 digests of block and payload. Of responses with equal payloads the first stays a response, the others become
`revisit` records without payload. Records that are equal in all of these are one capture told twice: they share an
identifier and have the same type.

Archives are gzip files written through Spark's own writer, one row each, so any Hadoop file system serves and a lost task
is written anew. An archive is closed at ARCHIVE_BYTES or ROWS_PER_FILE records, so what a task holds is an archive and
one record, and no record lies far behind its archive's beginning.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_schema, bound_batches

# Fixed values of the ARC and WARC formats.
V1_FIELDS = "URL IP-address Archive-date Content-type Archive-length"
V2_FIELDS = "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length"
WARC_VERSION = "WARC/1.0"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"
WARC_END = "\r\n\r\n"

#: Payload bytes from which on equal payloads are revisits; records and bytes at which an archive is closed.
MIN_REVISIT_BYTES, ROWS_PER_FILE, ARCHIVE_BYTES = 0, 1000, 16 << 20
SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")
ARC_ROW = "arc_file string, offset long, record_id string, version int, url string, ip string, date string, mime string, status int, http string, page_id long, payload binary, payload_bytes long, payload_digest string"
WARC_ROW = "warc_file string, offset long, record_id string, record_type string, url string, date string, mime string, http string, page_id long, refers_to_id string, refers_to_uri string, payload binary, payload_bytes long, payload_digest string, block_digest_ok boolean, payload_digest_ok boolean"


def digest(data: bytes) -> str:
    """Bare upper-case base32 of the SHA-1."""
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _field(x: str | None, default: str) -> str:
    return "".join(x.split()) or default if x else default


def arc_text(version: int, page_id, url: str | None, html: str, date: str, ip: str = "0.0.0.0", name: str = "pages.arc") -> str:
    """One ARC record without the newline that ends it: header line, HTTP headers, payload."""
    payload = html.encode("utf-8", "replace")
    head = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n" + f"Content-Length: {len(payload)}\r\n" + (f"X-Page-Id: {page_id}\r\n" if page_id is not None else "") + "\r\n"
    size = len(head.encode()) + len(payload)
    line = [_field(url, "unknown:"), ip, date, "text/html"] + (["200", hashlib.md5(payload).hexdigest(), "-", "0", name] if version == 2 else []) + [str(size)]
    return " ".join(line) + "\n" + head + html


def arc_head(version: int, date: str, name: str = "pages.arc") -> str:
    """The version block that an ARC file opens with."""
    body = f"{version} 0 tidemark\n{V2_FIELDS if version == 2 else V1_FIELDS}\n"
    line = [f"filedesc://{name}", "0.0.0.0", date, "text/plain"] + (["200", "-", "-", "0", name] if version == 2 else []) + [str(len(body))]
    return " ".join(line) + "\n" + body


def _write(rows: DataFrame, line_sep: str, path: str) -> None:
    """Rows of one archive's text each, a gzip file for each row."""
    rows.write.option("maxRecordsPerFile", 1).option("compression", "gzip").option("zlib.compress.level", "BEST_SPEED").option("lineSep", line_sep).text(path)


class _Archive:
    """Records of the archive being made; `add` gives back its text once it is full."""

    def __init__(self, sep: str, most_bytes: int) -> None:
        self.sep, self.most, self.held, self.size, self.made = sep, most_bytes, [], 0, 0

    def close(self) -> list[str]:
        out = [self.sep.join(self.held)] if self.held else []
        self.made += len(out)
        self.held, self.size = [], 0
        return out

    def add(self, record: str) -> list[str]:
        self.held.append(record)
        self.size += len(record)
        return self.close() if self.size >= self.most or len(self.held) > ROWS_PER_FILE else []


def _lines(texts: list[str]) -> Iterator[pa.RecordBatch]:
    for t in texts:
        yield pa.RecordBatch.from_arrays([pa.array([t], pa.string())], names=["value"])


def write_arc(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", date: str = "20080430204825", archive_bytes: int = ARCHIVE_BYTES) -> None:
    """Write pages as gzip ARC files. Files have version 1 and 2 in turn; null html is an empty payload,
    a null or blank url is written as `unknown:`, white space in a url is dropped, a null id leaves the X-Page-Id header out."""
    bound_batches(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        own, task = _Archive("\n", archive_bytes), TaskContext.get().partitionId()
        for b in batches:
            for page_id, url, html in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
                version = 1 + (task + own.made) % 2
                if not own.held:
                    own.add(arc_head(version, date))
                yield from _lines(own.add(arc_text(version, page_id, url, html, date)))
        yield from _lines(own.close())

    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("html"))
    _write(rows.mapInArrow(run, "value string"), "\n", path)


def record_id(*parts: object) -> str:
    return f"<urn:uuid:{uuid.uuid5(SPACE, ' '.join(map(str, parts)))}>"


def parse_arc(data: bytes, name: str, blocks: bool = False) -> Iterator[dict]:
    """Records of one uncompressed ARC file, by the header line of its version and the declared length; version blocks, as `block`, on demand.

    Whatever follows the field line of a version block, such as the XML metadata of ARC 1.1, belongs to the block."""
    at, version = 0, 1
    while at < len(data):
        end = data.find(b"\n", at)
        if end < 0:
            return
        line = data[at:end].decode("utf-8", "replace").rstrip("\r")
        if not line.strip():
            at = end + 1
            continue
        fields = line.split(" ")
        if not fields[-1].isdigit():
            raise ValueError(f"{name}, byte {at}: a header line without a length")
        body = data[end + 1 : end + 1 + int(fields[-1])]
        if len(body) != int(fields[-1]):
            raise ValueError(f"{name}, byte {at}: the declared length passes the end of the file")
        if line.startswith("filedesc://"):
            first, _, rest = body.decode("ascii", "replace").partition("\n")
            version = int(first.split(" ")[0])
            if rest.lstrip().partition("\n")[0].strip() != (V2_FIELDS if version == 2 else V1_FIELDS):
                raise ValueError(f"{name}: unknown fields for version {version}")
            if blocks:
                wanted = 10 if version == 2 else 5
                url, date = " ".join(fields[: len(fields) - wanted + 1]), fields[2 - wanted]
                yield {"offset": at, "record_id": record_id("filedesc", url, date, digest(body)), "date": date, "block": body}
        else:
            wanted = 10 if version == 2 else 5
            url, (ip, date, mime, *more) = " ".join(fields[: len(fields) - wanted + 1]), fields[len(fields) - wanted + 1 :]
            http, gap, payload = body.partition(b"\r\n\r\n")
            if not (http.startswith(b"HTTP/") and gap):
                http, payload = b"", body
            head = http.decode("utf-8", "replace")
            low = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in head.split("\r\n")[1:])}
            page_id = int(low["x-page-id"]) if "x-page-id" in low else None
            yield {
                "arc_file": name, "offset": at, "record_id": record_id(url, date, page_id, digest(body)), "version": version, "url": url, "ip": ip, "date": date, "mime": mime,
                "status": int(more[0]) if version == 2 and more[0].isdigit() else int(head.split(" ")[1]) if head else None, "http": head, "page_id": page_id,
                "payload": payload, "payload_bytes": len(payload), "payload_digest": digest(payload),
            }
        at = end + 1 + int(fields[-1])


def parse_warc(data: bytes, name: str) -> Iterator[dict]:
    """Records of one uncompressed WARC file, by Content-Length; digests are checked against the block."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        first, *lines = data[at:end].decode("utf-8", "replace").split("\r\n")
        if not first.startswith("WARC/"):
            raise ValueError(f"{name}, byte {at}: no WARC record")
        h = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
        block = data[end + 4 : end + 4 + int(h["content-length"])]
        kind, payload, http = h["warc-type"], None, ""
        if kind in ("response", "revisit"):
            head, gap, rest = block.partition(b"\r\n\r\n")
            http, payload = (head.decode("utf-8", "replace"), rest) if gap else ("", block)
        low = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in http.split("\r\n")[1:])}
        told = h.get("warc-payload-digest", "").removeprefix("sha1:") or None
        yield {
            "warc_file": name, "offset": at, "record_id": h["warc-record-id"], "record_type": kind, "url": h.get("warc-target-uri"), "date": h.get("warc-date"), "mime": h.get("content-type"), "http": http,
            "page_id": int(low["x-page-id"]) if "x-page-id" in low else None, "refers_to_id": h.get("warc-refers-to"), "refers_to_uri": h.get("warc-refers-to-target-uri"),
            "payload": payload if kind == "response" else None, "payload_bytes": len(payload) if kind == "response" else int(h.get("x-payload-length", 0)), "payload_digest": told,
            "block_digest_ok": h.get("warc-block-digest") == f"sha1:{digest(block)}", "payload_digest_ok": told == digest(payload) if kind == "response" else None,
        }
        at = end + 4 + int(h["content-length"]) + 4


def gunzipped(data: bytes) -> bytes:
    import gzip

    return gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data


def _read(spark: SparkSession, path: str, parse, schema: str, columns: list[str] | None) -> DataFrame:
    """Rows of all archives below path; a task holds one archive at a time and hands on some records at a time."""
    schema = ", ".join(c for c in schema.split(", ") if columns is None or c.split(" ")[0] in columns)
    out = arrow_schema(schema)
    bound_batches(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch(held: list[dict]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[f.name] for r in held], f.type) for f in out], schema=out)

        for b in batches:
            for i in range(b.num_rows):
                name, data = b.column(0)[i].as_py(), b.column(1)[i].as_py()
                held, size = [], 0
                for r in parse(gunzipped(data), name.rsplit("/", 1)[-1]):
                    held.append(r)
                    size += r["payload_bytes"]
                    if size > 4 << 20:
                        yield batch(held)
                        held, size = [], 0
                if held:
                    yield batch(held)

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(run, schema)


def read_arc(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """All records of the ARC files below path but the version blocks; repeated ones as often as they are there, none of a folder without archives."""
    return _read(spark, path, parse_arc, ARC_ROW, columns)


def read_warc(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """All records of the WARC files below path; repeated ones as often as they are there, none of a folder without archives."""
    return _read(spark, path, parse_warc, WARC_ROW, columns)


def iso_date(date: str) -> str:
    """WARC-Date of a 14-digit ARC date; shorter dates are filled with the earliest moment they may mean."""
    d = (date if date.isdigit() else "") + "00000101000000"[len(date if date.isdigit() else "") :]
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def warc_text(r: dict) -> str:
    """One WARC record without the two line ends that close it."""
    revisit = r["refers_to_id"] is not None
    http = f"{r['http']}\r\n\r\n" if r["http"] else ""
    block = http if revisit else http + r["payload"].decode("utf-8", "replace")
    raw = block.encode("utf-8", "replace")
    lines = [WARC_VERSION, f"WARC-Type: {'revisit' if revisit else 'response' if r['http'] else 'resource'}", f"WARC-Record-ID: {r['record_id']}", f"WARC-Date: {iso_date(r['date'])}", f"WARC-Target-URI: {r['url']}", f"WARC-IP-Address: {r['ip']}"]
    lines += [f"WARC-Payload-Digest: sha1:{r['payload_digest']}", f"WARC-Block-Digest: sha1:{digest(raw)}"]
    if revisit:
        lines += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: {r['refers_to_id']}", f"WARC-Refers-To-Target-URI: {r['refers_to_uri']}", f"WARC-Refers-To-Date: {iso_date(r['refers_to_date'])}", f"X-Payload-Length: {r['payload_bytes']}"]
    lines += [f"Content-Type: {'application/http; msgtype=response' if r['http'] else r['mime']}", f"Content-Length: {len(raw)}"]
    return "\r\n".join(lines) + "\r\n\r\n" + block


def warcinfo_text(r: dict) -> str:
    """The warcinfo record of an ARC version block, which it keeps whole, without the two line ends that close it."""
    block = r["block"].decode("utf-8", "replace")
    raw = block.encode("utf-8", "replace")
    lines = [WARC_VERSION, "WARC-Type: warcinfo", f"WARC-Record-ID: {r['record_id']}", f"WARC-Date: {iso_date(r['date'])}", f"WARC-Block-Digest: sha1:{digest(raw)}", "Content-Type: text/plain", f"Content-Length: {len(raw)}"]
    return "\r\n".join(lines) + "\r\n\r\n" + block


def roles(records: DataFrame, min_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """arc_file, offset, record_id of revisits, with refers_to_id, refers_to_uri, refers_to_date of the record with the equal
    payload and the smallest page_id (null ids last; equal ids by record identifier). Narrow rows: payloads stay where they are."""
    own = records.filter(F.col("payload_bytes") >= min_bytes)
    order = F.struct(F.col("page_id").isNull().alias("last"), "page_id", "record_id", "url", "date")
    first = own.groupBy("payload_digest", "payload_bytes").agg(F.min(order).alias("first"))
    found = own.select("arc_file", "offset", "record_id", "payload_digest", "payload_bytes").join(first, ["payload_digest", "payload_bytes"]).filter(F.col("record_id") != F.col("first.record_id"))
    return found.select("arc_file", "offset", "record_id", F.col("first.record_id").alias("refers_to_id"), F.col("first.url").alias("refers_to_uri"), F.col("first.date").alias("refers_to_date"))


def convert(spark: SparkSession, arc_path: str, warc_path: str, min_bytes: int = MIN_REVISIT_BYTES, archive_bytes: int = ARCHIVE_BYTES) -> None:
    """Convert all ARC files in arc_path, whatever their names (hidden ones left out), to gzip WARC files in warc_path. Each version block becomes a warcinfo record.

    Identifiers of revisits are found on narrow rows first and gathered for each ARC file (no more than it has records);
    they meet the files as these are, compressed, so thousands of equal payloads skew nothing. Payload text must be UTF-8
    (other bytes are replaced on writing).
    """
    bound_batches(spark)
    of = roles(read_arc(spark, arc_path, ["arc_file", "offset", "record_id", "page_id", "url", "date", "payload_bytes", "payload_digest"]), min_bytes)
    of_file = of.groupBy("arc_file").agg(F.collect_list(F.struct("offset", "refers_to_id", "refers_to_uri", "refers_to_date")).alias("revisits"))
    files = spark.read.format("binaryFile").load(arc_path).select(F.element_at(F.split("path", "/"), -1).alias("arc_file"), "content")
    names = ("refers_to_id", "refers_to_uri", "refers_to_date")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _Archive(WARC_END, archive_bytes)
        for b in batches:
            for i in range(b.num_rows):
                name, data, revisits = (b.column(k)[i].as_py() for k in range(3))
                told = {r["offset"]: r for r in revisits or ()}
                for r in parse_arc(gunzipped(data), name, blocks=True):
                    yield from _lines(own.add(warcinfo_text(r) if "block" in r else warc_text(r | {n: told[r["offset"]][n] if r["offset"] in told else None for n in names})))
        yield from _lines(own.close())

    rows = files.join(of_file.hint("shuffle_hash"), "arc_file", "left").select("arc_file", "content", "revisits")
    _write(rows.mapInArrow(run, "value string"), WARC_END, warc_path)


def page_records(spark: SparkSession, warc_path: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to (page id of the referred record), url, digests_ok, as the archives have them.

    Repeated pages give as many rows, of one record type; a folder without archives gives none."""
    rows = read_warc(spark, warc_path, ["record_id", "record_type", "page_id", "refers_to_id", "payload_bytes", "payload_digest", "url", "block_digest_ok", "payload_digest_ok"])
    rows = rows.filter(F.col("record_type").isin("response", "revisit"))
    first = rows.filter("record_type = 'response'").select(F.col("record_id").alias("refers_to_id"), F.col("page_id").alias("refers_to")).dropDuplicates(["refers_to_id"])
    done = rows.filter("record_type = 'revisit'").join(first, "refers_to_id", "left").unionByName(rows.filter("record_type = 'response'").withColumn("refers_to", F.lit(None).cast("long")))
    return done.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url", (F.col("block_digest_ok") & F.coalesce("payload_digest_ok", F.lit(True))).alias("digests_ok"))
