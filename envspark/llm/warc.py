"""WARC archives with transaction assembly (operator 9).

``write_archives`` turns pages into WARC/1.1 files: per page a request, a
response (or, for a payload that a page with a smaller id already has, a
revisit without body) and a metadata record; request and metadata name the
response in ``WARC-Concurrent-To``.  Spark's text sink writes the files: a
record is one line and the four bytes that end every WARC record are the line
separator, so any store that Spark can write holds them.

``read_records`` parses archives by ``Content-Length`` and gives one row per
record.  ``assemble`` brings the records of a capture together by the
identifier that they are concurrent to, in one grouped shuffle instead of two
joins: one nested row per capture.

Payloads are deduplicated by SHA-1 on slim rows (id, digest, size): only digests
that occur more than once take part in the join that finds the first page.

A reader holds a whole archive, so files are cut by bytes: their number comes
from the summed sizes, and pages move once, by (digest, id), into one file
each task.  A file so holds about ``FILE_BYTES`` of pages, and a page longer
than that mostly a file to itself.  Pages of one payload have ids of their own
and spread over all files.

Defined results: null html is the empty payload; null and repeated ids are
kept, each row is its own capture; a null page_id is never the first page
unless all pages of a payload have none; rows that share the smallest id and
the payload are all responses; a null url has no target URI; extra columns are
ignored; empty in, no record and no row out.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from envspark.llm import common as C

END = "\r\n\r\n"
DATE = "1970-01-01T00:00:00Z"                # pages carry no fetch time
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORDS_PER_FILE = 6000
FILE_BYTES = 32 << 20
RECORD_HEADS = 1000                          # what the records of a capture hold beside the payload, about
READ_STEP = 1 << 20


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _record(kind: str, rid: str, block: str, ctype: str, **fields: str | None) -> str:
    """A record without its closing line ends; fields that are None are left out."""
    head = [f"WARC/1.1\r\nWARC-Type: {kind}\r\nWARC-Record-ID: <urn:uuid:{rid}>\r\nWARC-Date: {DATE}\r\n"]
    head += [f"{k.replace('_', '-')}: {v}\r\n" for k, v in fields.items() if v is not None]
    return "".join(head) + f"Content-Type: {ctype}\r\nContent-Length: {len(block.encode())}\r\n\r\n{block}"


def _line(value: str) -> str:
    """A value that fits one header line."""
    return re.sub("[\x00-\x20\x7f\x85\u2028\u2029]", lambda m: "".join(f"%{b:02X}" for b in m[0].encode()), value)


def _to_records(run_id: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        space, part, n = uuid.UUID(run_id), TaskContext.get().partitionId(), 0
        for b in batches:
            out = []
            for page, url, html, first, again in zip(*(b.column(i).to_pylist() for i in range(5)), strict=True):
                n += 1
                ids = [str(uuid.uuid5(space, f"{part}/{n}/{k}")) for k in ("response", "request", "metadata")]
                payload = (html or "").encode()
                digest = f"sha1:{base32_sha1(payload)}"
                uri = None if url is None else _line(url)
                rest = re.sub(r"^[^:/?#]*://", "", uri or "")
                host = re.split(r"[/?#]", rest, maxsplit=1)[0]
                http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}{END}"
                if again:
                    out.append(_record("revisit", ids[0], http, "application/http; msgtype=response", WARC_Target_URI=uri,
                                       WARC_Payload_Digest=digest, WARC_Profile=PROFILE, WARC_Refers_To_Page=str(first)))
                else:
                    out.append(_record("response", ids[0], http + (html or ""), "application/http; msgtype=response",
                                       WARC_Target_URI=uri, WARC_Payload_Digest=digest))
                to = f"<urn:uuid:{ids[0]}>"
                out.append(_record("request", ids[1], f"GET {rest[len(host):] or '/'} HTTP/1.1\r\nHost: {host}{END}",
                                   "application/http; msgtype=request", WARC_Target_URI=uri, WARC_Concurrent_To=to))
                out.append(_record("metadata", ids[2], "" if page is None else f"page-id: {page}\r\n",
                                   "application/warc-fields", WARC_Target_URI=uri, WARC_Concurrent_To=to))
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], names=["value"])
    return run


def file_count(total: int, cores: int) -> int:
    """Files for ``total`` bytes: one for each ``FILE_BYTES``, at least one per core."""
    return max(1, cores, -(-total // FILE_BYTES))


def write_archives(pages: DataFrame, path: str) -> None:
    """Write ``pages`` (page_id, url, html) as gzipped WARC files under
    ``path``, each of about ``FILE_BYTES`` before compression."""
    spark = pages.sparkSession
    C.small_batches(spark)
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
                        F.coalesce("html", F.lit("")).alias("html"))
    # a null id as a key of its own
    rows = rows.withColumn("digest", F.unhex(F.sha1("html"))) \
        .withColumn("at", F.coalesce("page_id", F.lit(0))).withColumn("none", F.col("page_id").isNull())
    slim = C.materialize(rows.select("digest", "at", "none", "page_id", (F.octet_length("html") + RECORD_HEADS).cast("long").alias("bytes")), "payloads")
    shared = slim.groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    revisits = slim.join(shared.select("digest", "first"), "digest") \
        .where(F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))) \
        .groupBy("digest", "at", "none").agg(F.first("first").alias("first"))
    files = file_count(slim.agg(F.sum("bytes")).first()[0] or 0, spark.sparkContext.defaultParallelism)
    key = ["digest", "at", "none"]
    marked = rows.repartition(files, *key).join(revisits.repartition(files, *key), key, "left") \
        .select("page_id", "url", "html", "first", F.col("first").isNotNull().alias("again"))
    marked.mapInArrow(C.tidy(_to_records(str(uuid.uuid4()))), "value string").write.mode("overwrite") \
        .option("lineSep", END).option("compression", "gzip").option("maxRecordsPerFile", RECORDS_PER_FILE).text(path)


class _Stream:
    """Bytes of a plain or (multi-member) gzipped archive, inflated in steps."""

    def __init__(self, raw: bytes) -> None:
        self.raw, self.at, self.held, self.pos = raw, 0, b"", 0
        self.inflate = zlib.decompressobj(31) if raw[:2] == b"\x1f\x8b" else None

    def _more(self) -> bool:
        if self.at >= len(self.raw):
            return False
        part = self.raw[self.at:self.at + READ_STEP]
        self.at += len(part)
        if self.inflate is not None:
            got = b""
            while part:
                got += self.inflate.decompress(part)
                part = self.inflate.unused_data
                if self.inflate.eof:
                    self.inflate = zlib.decompressobj(31)
            part = got
        self.held, self.pos = self.held[self.pos:] + part, 0
        return True

    def until(self, mark: bytes) -> bytes | None:
        """Bytes up to the mark, which is skipped; None at the end."""
        start = self.pos
        while (i := self.held.find(mark, start)) < 0:
            back = len(self.held) - self.pos - len(mark) + 1
            if not self._more():
                return None
            start = self.pos + max(back, 0)
        out = self.held[self.pos:i]
        self.pos = i + len(mark)
        return out

    def take(self, n: int) -> bytes:
        while len(self.held) - self.pos < n and self._more():
            pass
        out = self.held[self.pos:self.pos + n]
        self.pos += n
        return out


def _headers(block: bytes) -> tuple[str, dict[str, str]]:
    first, *rest = block.decode("utf-8", "replace").split("\r\n")
    return first, {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in rest)}


def parse_records(raw: bytes) -> Iterator[dict]:
    """Records of one archive; fields in lower case, blocks cut by length."""
    s = _Stream(raw)
    while (head := s.until(b"\r\n\r\n")) is not None:
        version, h = _headers(head.lstrip(b"\r\n"))
        if not version.startswith("WARC/"):
            raise ValueError(f"not a WARC record: {version[:60]!r}")
        block = s.take(int(h["content-length"]))
        s.take(4)
        kind = h.get("warc-type")
        rec = {"record_id": h.get("warc-record-id"), "concurrent_to": h.get("warc-concurrent-to"), "type": kind,
               "uri": h.get("warc-target-uri"), "refers_to": h.get("warc-refers-to-page"), "page_id": None,
               "digest": h.get("warc-payload-digest", "").removeprefix("sha1:") or None, "length": None,
               "http_head": None, "payload": None, "digest_ok": None}
        if kind in ("response", "revisit", "request"):
            http, _, body = block.partition(b"\r\n\r\n")
            rec["http_head"] = http.decode("utf-8", "replace")
            if kind == "response":
                own = base32_sha1(body)
                rec |= {"payload": body, "length": len(body), "digest_ok": rec["digest"] in (None, own), "digest": own}
            elif kind == "revisit":
                rec["length"] = int(_headers(http)[1].get("content-length", 0))
        elif kind == "metadata":
            page = _headers(b"\r\n" + block)[1].get("page-id")
            rec["page_id"] = None if page is None else int(page)
        rec["refers_to"] = None if rec["refers_to"] is None else int(rec["refers_to"])
        yield rec


_RECORD = pa.schema([("record_id", pa.string()), ("concurrent_to", pa.string()), ("type", pa.string()), ("uri", pa.string()),
                     ("refers_to", pa.int64()), ("page_id", pa.int64()), ("digest", pa.string()), ("length", pa.int64()),
                     ("http_head", pa.string()), ("payload", pa.binary()), ("digest_ok", pa.bool_())])


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """One row per record of the archives under ``path``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                held, size = [], 0
                for rec in parse_records(b.column(0)[i].as_py()):
                    held.append(rec)
                    size += len(rec["payload"] or b"") + 500
                    if size >= C.BATCH_BYTES:
                        yield pa.RecordBatch.from_pylist(held, schema=_RECORD)
                        held, size = [], 0
                if held:
                    yield pa.RecordBatch.from_pylist(held, schema=_RECORD)

    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInArrow(C.tidy(run), "record_id string, concurrent_to string, type string, uri string, refers_to long, page_id long, "
                                 "digest string, length long, http_head string, payload binary, digest_ok boolean")


def assemble(records: DataFrame) -> DataFrame:
    """One nested row per capture: its request, response and metadata records,
    joined by the identifier that they are concurrent to."""
    def one(kinds: tuple[str, ...], col: str):
        return F.first(F.when(F.col("type").isin(*kinds), F.col(col)), ignorenulls=True)
    answer = ("response", "revisit")
    cap = records.where(F.col("type").isin("request", "metadata", *answer)) \
        .groupBy(F.coalesce("concurrent_to", "record_id").alias("capture")).agg(
        one(answer, "record_id").alias("a_id"), one(answer, "type").alias("a_type"), one(answer, "uri").alias("a_uri"),
        one(answer, "http_head").alias("a_head"), one(answer, "payload").alias("a_payload"), one(answer, "length").alias("a_length"),
        one(answer, "digest").alias("a_digest"), one(answer, "digest_ok").alias("a_ok"), one(answer, "refers_to").alias("a_refers"),
        one(("request",), "record_id").alias("q_id"), one(("request",), "http_head").alias("q_head"),
        one(("metadata",), "record_id").alias("m_id"), one(("metadata",), "page_id").alias("m_page"))
    return cap.select(
        "capture", F.col("a_uri").alias("uri"),
        F.struct(F.col("q_id").alias("record_id"), F.col("q_head").alias("http_head")).alias("request"),
        F.struct(F.col("a_id").alias("record_id"), F.col("a_type").alias("type"), F.col("a_head").alias("http_head"),
                 F.col("a_payload").alias("payload"), F.col("a_length").alias("payload_bytes"),
                 F.col("a_digest").alias("payload_digest"), F.col("a_ok").alias("digest_ok"),
                 F.col("a_refers").alias("refers_to")).alias("response"),
        F.struct(F.col("m_id").alias("record_id"), F.col("m_page").alias("page_id")).alias("metadata"))


def warc_roundtrip(pages: DataFrame, path: str | None = None) -> DataFrame:
    """Write the pages' archives, read them back and assemble the captures."""
    spark = pages.sparkSession
    path = path or C.new_path(spark, "warc")
    write_archives(pages, path)
    C.release(spark)
    return assemble(read_records(spark, path))
