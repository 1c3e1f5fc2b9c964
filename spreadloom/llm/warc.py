"""WARC archives: written from pages, read back, and rewritten so that every payload is kept once.

An archive is a file of records, each a gzip member of its own, as crawlers write them. Files are written and read by
Spark, so any store it knows will do; one row is one archive of bounded size. Revisits are resolved over headers alone:
they are shuffled by payload digest, the response of the smallest page id is the original of its digest, and every other
record with it, revisit records that came so included, is joined to it. Verdicts go back to their archive by its name, and
archives are rewritten where they lie, with fresh headers: payloads are moved once at most, and never by digest.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spreadloom.llm.common import drop, prepare, remove, save, shared_path

#: Bytes of records, as they were before they were compressed, after which an archive ends.
ARCHIVE_BYTES = 16 << 20
#: Bytes read at once from a member, and headers sent to Spark at once.
STEP, ROWS = 1 << 16, 2000
#: What follows the members of a file: a byte of padding, as gzip allows.
PADDING = "\0"
# Names of the format.
VERSION, REVISIT_PROFILE = "WARC/1.1", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: No function reads the clock: the date of records whose page has none.
DATE = "1970-01-01T00:00:00Z"
NAMESPACE = uuid.UUID(int=0)


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload, usedforsecurity=False).digest()).decode()


def record(kind: str, headers: dict[str, str | None], block: bytes) -> bytes:
    """One record as a gzip member."""
    lines = [VERSION, f"WARC-Type: {kind}", *(f"{k}: {v}" for k, v in headers.items() if v is not None), f"Content-Length: {len(block)}"]
    squeeze = zlib.compressobj(6, zlib.DEFLATED, 31)
    return squeeze.compress("\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + squeeze.flush()


def http_block(payload: bytes) -> bytes:
    return f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode() + payload


def record_id(*of: object) -> str:
    return f"<urn:uuid:{uuid.uuid5(NAMESPACE, repr(of))}>"


def target(url: str | None) -> str | None:
    """The address with everything that a header line cannot hold written as %XX."""
    return None if url is None else quote(url, safe="!#$&'()*+,/:;=?@[]~%")


def members(data: bytes) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """(place in the file, headers by lower-case name, block) of every record of an archive."""
    view, at = memoryview(data), 0
    while at < len(view) and view[at]:
        start, opened, out = at, zlib.decompressobj(31), []
        while not opened.eof:
            if at >= len(view):
                raise ValueError(f"record at {start} has no end")
            out.append(opened.decompress(view[at : at + STEP]))
            at += STEP
        at = min(at, len(view)) - len(opened.unused_data)
        head, _, rest = b"".join(out).partition(b"\r\n\r\n")
        first, *lines = head.decode().split("\r\n")
        if not first.startswith("WARC/"):
            raise ValueError(f"no record at {start}")
        headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
        n = int(headers["content-length"])
        if len(rest) < n:
            raise ValueError(f"record at {start} is cut")
        yield start, headers, rest[:n]


def payload_of(headers: dict[str, str], block: bytes) -> bytes:
    """What the server sent, without the lines of HTTP before it."""
    return block.partition(b"\r\n\r\n")[2] if headers.get("content-type", "").startswith("application/http") else block


def archived(rows: Iterator[tuple[bytes, int]], most: int) -> Iterator[pa.RecordBatch]:
    """Archives of (record, bytes before compression), a row each, that end after `most` bytes."""
    held, size = [], 0
    for member, plain in rows:
        held.append(member)
        size += plain
        if size >= most:
            yield pa.RecordBatch.from_arrays([pa.array([b"".join(held)], pa.binary())], names=["archive"])
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array([b"".join(held)], pa.binary())], names=["archive"])


def put(archives: DataFrame, folder: str) -> None:
    """One file per row. Spark's text writer takes the bytes as they are."""
    text = archives.select(F.col("archive").cast("string").alias("value"))
    text.write.option("maxRecordsPerFile", 1).option("lineSep", PADDING).option("compression", "none").text(folder)


def write(pages: DataFrame, folder: str, date: str = DATE, most: int = ARCHIVE_BYTES) -> None:
    """A response record per row of `pages` (page_id, url, html) in new archives in `folder`.

    A null html is an empty payload; a null page_id or url has no header; repeated rows are written each; pages of any
    length are one record, which a task holds with its archive; other columns are not looked at; no rows give no records.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def records() -> Iterator[tuple[bytes, int]]:
            for b in batches:
                for page_id, url, html in zip(*(c.to_pylist() for c in b.columns), strict=True):
                    payload = (html or "").encode()
                    headers = {
                        "WARC-Record-ID": record_id("response", page_id, url), "WARC-Date": date, "WARC-Target-URI": target(url), "WARC-Payload-Digest": "sha1:" + digest(payload),
                        "WARC-Page-ID": None if page_id is None else quote(page_id), "Content-Type": "application/http; msgtype=response"}
                    yield record("response", headers, http_block(payload)), len(payload)

        yield from archived(records(), most)

    prepare(pages.sparkSession)
    own = pages.select(*(F.col(c).cast("string").alias(c) for c in ("page_id", "url", "html")))
    put(own.mapInArrow(run, "archive binary"), folder)


def files(spark: SparkSession, folder: str) -> DataFrame:
    """path, content of every archive. One archive is one row, and no batch that Python gets is longer than a few."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(folder).select("path", "content")


HEADERS = "path string, place long, kind string, record_id string, date string, url string, page_id string, payload_bytes long, digest string, content_hash binary, refers_to_record string"


def headers(spark: SparkSession, folder: str) -> DataFrame:
    """What the records of all archives say, without payloads: path and place of the record, kind (WARC-Type), record_id,
    date, url, page_id, payload_bytes, digest (base32 SHA-1), content_hash (SHA-256), refers_to_record.

    Digest, hash and bytes are taken from the payload itself, but for revisits, which have none: their digest is that of
    the header, the others are null. A payload that is not as its header says raises.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.string(), pa.int64(), *[pa.string()] * 5, pa.int64(), pa.string(), pa.binary(), pa.string())
        names = [c.split(" ")[0] for c in HEADERS.split(", ")]

        def rows() -> Iterator[tuple]:
            for b in batches:
                for path, content in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                    for place, h, block in members(content.as_py()):
                        said, page, kind = h.get("warc-payload-digest", "").partition(":")[2], h.get("warc-page-id"), h["warc-type"]
                        size, own, full = None, said, None
                        if kind != "revisit":
                            payload = payload_of(h, block)
                            size, own, full = len(payload), digest(payload), hashlib.sha256(payload).digest()
                            if said and said != own:
                                raise ValueError(f"{path} at {place}: payload has digest {own}, not {said}")
                        yield path, place, kind, h["warc-record-id"], h.get("warc-date"), h.get("warc-target-uri"), None if page is None else unquote(page), size, own, full, h.get("warc-refers-to")

        held: list[tuple] = []
        for r in rows():
            held.append(r)
            if len(held) == ROWS:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held, strict=True), kinds, strict=True)], names=names)
                held = []
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held, strict=True), kinds, strict=True)], names=names)

    return files(spark, folder).mapInArrow(run, HEADERS)


def resolve(heads: DataFrame, least: int = 0, kind: str = "long") -> DataFrame:
    """Every row of `heads` (a saved table as of `headers`) with record_type, refers_to (page id of the original) and the
    original's record id, url and date: original, original_url, original_date; payload_bytes of a revisit are those of its original.

    Of responses with one payload of at least `least` bytes the one of the smallest page id, as a `kind`, is the original;
    ids that are no `kind` come last; of equal ids the first by path and place. Revisit records that came with no response
    of their digest stay revisits and refer to nothing.
    """
    number = F.col("page_id").try_cast(kind)
    order = F.struct(number.isNull().alias("none"), number.alias("id"), F.col("path"), F.col("place"))
    whole = heads.where("kind <> 'revisit'").where(F.col("payload_bytes") >= least)
    # one row per payload: partial aggregation meets the copies where they lie
    first = whole.groupBy("digest", "content_hash").agg(
        F.min_by(F.struct("path", "place", "page_id", "record_id", "url", "date", "payload_bytes"), order).alias("o"))
    named = first.groupBy("digest").agg(F.min_by("o", "content_hash").alias("o"))
    mine = heads.where("kind <> 'revisit'").join(first, ["digest", "content_hash"], "left")
    came = heads.where("kind = 'revisit'").join(named, "digest", "left")
    both = mine.select(*heads.columns, "o").union(came.select(*heads.columns, "o"))
    big = F.coalesce(F.col("payload_bytes") >= least, F.lit(True))
    itself = (F.col("o.path") == F.col("path")) & (F.col("o.place") == F.col("place"))
    again = (F.col("kind") == "revisit") | (big & ~F.coalesce(itself, F.lit(True)))
    of = lambda c, name: F.when(again, F.col(f"o.{c}")).alias(name)
    kept = [c for c in heads.columns if c != "payload_bytes"]
    return both.select(
        *kept, F.coalesce("payload_bytes", F.col("o.payload_bytes")).alias("payload_bytes"), F.when(again, "revisit").otherwise("response").alias("record_type"),
        of("page_id", "refers_to"), of("record_id", "original"), of("url", "original_url"), of("date", "original_date"))


def deduplicate(spark: SparkSession, folder: str, out: str, least: int = 0, kind: str = "long", most: int = ARCHIVE_BYTES) -> None:
    """Archives of `folder` rewritten to `out`: records whose payload stands elsewhere become revisits without it."""
    heads = save(headers(spark, folder), "heads")
    again = resolve(heads, least, kind).where("record_type = 'revisit'")
    # as many as an archive has records
    told = again.groupBy("path").agg(F.collect_list(F.struct("place", "digest", "refers_to", "original", "original_url", "original_date")).alias("told"))
    told = save(told, "told")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def records() -> Iterator[tuple[bytes, int]]:
            for b in batches:
                for path, content, of in zip(b.column(0).to_pylist(), b.column(1), b.column(2).to_pylist(), strict=True):
                    revisits = {r["place"]: r for r in of or ()}
                    for place, h, block in members(content.as_py()):
                        own = {"WARC-Date": h.get("warc-date"), "WARC-Target-URI": h.get("warc-target-uri"), "WARC-Page-ID": h.get("warc-page-id")}
                        if place in revisits:
                            r = revisits[place]
                            own |= {
                                "WARC-Record-ID": record_id("revisit", h["warc-record-id"], path, place), "WARC-Payload-Digest": "sha1:" + r["digest"], "WARC-Profile": REVISIT_PROFILE,
                                "WARC-Refers-To": r["original"], "WARC-Refers-To-Target-URI": r["original_url"], "WARC-Refers-To-Date": r["original_date"],
                                "WARC-Refers-To-Page-ID": None if r["refers_to"] is None else quote(r["refers_to"])}
                            yield record("revisit", own, b""), STEP // 64
                        else:
                            own |= {"WARC-Record-ID": h["warc-record-id"], "WARC-Payload-Digest": "sha1:" + digest(payload_of(h, block)), "Content-Type": h.get("content-type")}
                            yield record(h["warc-type"], own, block), len(block)

        yield from archived(records(), most)

    put(files(spark, folder).join(told, "path", "left").select("path", "content", "told").mapInArrow(run, "archive binary"), out)
    drop(heads, told)


def op12_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    kind = dict(pages.dtypes)["page_id"]
    raw, lean = shared_path(spark, "warc"), shared_path(spark, "warc")
    write(pages, raw)
    deduplicate(spark, raw, lean, 0, kind)
    heads = save(headers(spark, lean), "heads")
    remove(spark, raw, lean)
    back = resolve(heads, 0, kind)
    number = lambda c: F.col(c).cast(kind).alias(c)
    return back.select(number("page_id"), "payload_bytes", F.col("digest").alias("payload_digest"), "record_type", number("refers_to"))


#: SHA-1 is known to DuckDB in hex; 20 of its bits are four letters of base32.
OP12_SQL = r"""
with d as (
  select page_id, coalesce(html, '') as h, sha1(coalesce(html, '')) as x, strlen(coalesce(html, '')) as payload_bytes from pages),
groups as (
  select page_id, payload_bytes, h, min(page_id) over (partition by h) as first,
         list_transform(range(0, 8), lambda g: ('0x' || x[5 * g + 1 : 5 * g + 5])::int) as parts from d),
letters as (
  select *, list_aggregate(list_transform(parts, lambda p: concat(
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[(p >> 15) % 32 + 1], 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[(p >> 10) % 32 + 1],
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[(p >> 5) % 32 + 1], 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[p % 32 + 1])), 'string_agg', '') as payload_digest from groups)
select page_id, payload_bytes, payload_digest, case when page_id = first then 'response' else 'revisit' end as record_type,
       case when page_id <> first then first end as refers_to
from letters
"""
