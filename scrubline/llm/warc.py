"""WARC archives: reading, resolution of revisit records, and writing of deduplicated archives."""

from __future__ import annotations

import gzip
import io
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, shared_folder, ship_package
from .common import col as named

DATE = "2026-01-01T00:00:00Z"
#: ``http`` is the HTTP header of a response or revisit, with its empty line; ``payload`` what follows, or the whole block of other records.
FIELDS = "record_id string, warc_type string, url string, date string, digest string, refers_to string, content_type string, http binary, payload binary"
RESPONSE_TYPE = "application/http; msgtype=response"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


HTTP = ("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: ", "\r\n\r\n")
_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
#: Kept records are marked in bitmaps of 2**PLACE_BITS places (4 KB each, the most ``bitmap_construct_agg`` has); up to so many bitmaps (64 MB) are broadcast.
PLACE_BITS, MOST_BITMAPS = 15, 1 << 14


def capture(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", date: str = DATE, again: bool = True) -> DataFrame:
    """The records (``FIELDS``) of a crawl that fetched each page, and (``again``) a second time, when the payload hadn't changed.

    The first fetch is a response record with the payload; the second a revisit record, without payload or reference,
    that only has the payload's digest. A null page is empty, a null url "". Record ids are "<page>-1" and "<page>-2".
    """
    page = F.coalesce(named(id_col).cast("string"), F.lit("null"))
    payload = F.encode(F.coalesce(named(html_col), F.lit("")), "UTF-8")
    base = pages.select(page.alias("p"), F.coalesce(named(url_col), F.lit("")).alias("url"), payload.alias("payload"), F.concat(F.lit("sha1:"), F.sha1(payload)).alias("digest"))
    http = F.encode(F.concat(F.lit(HTTP[0]), F.octet_length("payload").cast("string"), F.lit(HTTP[1])), "UTF-8")

    def fetch(n: str, kind: str, http: Column, payload: Column) -> DataFrame:
        return base.select(F.concat("p", F.lit("-" + n)).alias("record_id"), F.lit(kind).alias("warc_type"), "url", F.lit(date).alias("date"), "digest", F.lit(None).cast("string").alias("refers_to"), F.lit(RESPONSE_TYPE).alias("content_type"), http.cast("binary").alias("http"), payload.cast("binary").alias("payload"))

    first = fetch("1", "response", http, F.col("payload"))
    return first.unionByName(fetch("2", "revisit", F.lit(None), F.lit(None))) if again else first


def base32(digits: Column) -> Column:
    """40 hexadecimal digits in base 32, as archives write digests. ``conv`` counts 0 to 9 and A to V, eight digits for each ten."""
    parts = [F.lpad(F.conv(F.substring(digits, 10 * i + 1, 10), 16, 32), 8, "0") for i in range(4)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", _BASE32)


def canonical(digest: Column) -> Column:
    """One spelling of a digest: the algorithm in lower case, SHA-1 in base 32 even if it came in hexadecimal, others in lower case if they're hexadecimal."""
    kind, value = F.lower(F.substring_index(digest, ":", 1)), F.regexp_replace(digest, "^[^:]*:", "")
    sha1 = F.when(value.rlike("^[0-9a-fA-F]{40}$"), base32(value)).otherwise(F.upper(value))
    other = F.when(value.rlike("^[0-9a-fA-F]+$"), F.lower(value)).otherwise(value)
    return F.when(digest.contains(":"), F.concat(kind, F.lit(":"), F.when(kind == "sha1", sha1).otherwise(other))).otherwise(digest)


def resolve(records: DataFrame) -> DataFrame:
    """The records of a deduplicated archive: (record_id, warc_type, url, digest, refers_to, payload_bytes, header, http, payload).

    ``records`` has ``FIELDS``. It is read once and copied to the shared folder as it lies, each record with its place; the rows of the result
    read that copy, and aren't kept a second time. Headers alone are shuffled by payload digest. Of the responses with a digest the one of the least
    record id stays a response; the others become revisit records of it, with their HTTP header. Revisit records are joined to the original with their digest.
    Those whose original isn't there stay, with a null ``refers_to``. Payloads aren't shuffled: the places of kept responses are looked up
    in bitmaps (``_at``). Every record gets a fresh header: an id made from the
    record's type, id and digest, unless it has one in angle brackets, the length, and for revisits the original's id and url. Records of other
    types (requests, metadata, resources, conversions, archive information) pass as they are, with a fresh header.

    Digests are compared in one spelling (``canonical``), and written as they came. One that a record lacks is worked out from its payload, SHA-1 in base 32;
    a response without payload has an empty one. A revisit without a digest resolves to nothing. A record without a type is a response. Rows with a
    null record id are passed over. Responses and revisits of equal record id and digest are one record, a response before a revisit; of several payloads
    then the shortest stays. Different digests under one record id are different records. No records, no rows. Other columns are ignored.
    """
    scratch = Scratch(records.sparkSession, "warc")
    given = records.filter("record_id is not null").withColumn("warc_type", F.coalesce("warc_type", F.lit("response")))
    shaped = given.select("record_id", "warc_type", F.coalesce("url", F.lit("")).alias("url"), F.coalesce("date", F.lit(DATE)).alias("date"), "digest", F.coalesce("content_type", F.lit(RESPONSE_TYPE)).alias("content_type"), "http", "payload")
    own = F.col("warc_type").isin("response", "revisit")
    shaped = shaped.withColumn("payload", F.when(F.col("warc_type") != "revisit", F.coalesce("payload", F.lit(b"")))).withColumn("http", F.when(own, F.col("http")))
    shaped = shaped.withColumn("digest", F.when(own, F.coalesce("digest", F.concat(F.lit("sha1:"), base32(F.sha1("payload"))), F.lit(""))).otherwise(F.col("digest")))
    shaped = shaped.withColumn("n", F.coalesce(F.octet_length("payload"), F.lit(0))).withColumn("mark", F.xxhash64("payload")).withColumn("place", F.monotonically_increasing_id())
    copy = scratch.write(shaped, "zstd")
    fields = ("warc_type", "n", "mark", "url", "date", "digest", "content_type", "http", "place")
    heads = copy.filter(own).withColumn("same", canonical(F.col("digest"))).groupBy("record_id", "same").agg(F.min(F.struct(*fields)).alias("h"))
    heads = scratch.write(heads.select("record_id", "same", "h.*"))
    originals = scratch.write(heads.filter("warc_type = 'response'").groupBy("same").agg(F.min(F.struct("record_id", "url", "date", "digest")).alias("original")))
    found = heads.join(originals, "same", "left")
    is_original = F.coalesce((F.col("warc_type") == "response") & (F.col("record_id") == F.col("original.record_id")), F.lit(False))
    refers = F.when(~is_original & (F.col("same") != ""), F.col("original.record_id"))
    kind = F.when(is_original, "response").otherwise("revisit")
    more = [F.when(refers.isNotNull(), F.col(f"original.{x}")).alias(f"refers_{x}") for x in ("url", "date", "digest")]
    index = scratch.write(found.select("record_id", kind.alias("warc_type"), "url", "date", "digest", "content_type", "http", refers.alias("refers_to"), *more, F.lit(0).cast("long").alias("payload_bytes"), "place"))
    scratch.drop(heads, originals)
    plain = ["record_id", "warc_type", "url", "digest", "refers_to", "payload_bytes", "header", "http", "payload"]
    revisits = index.filter("warc_type = 'revisit'").withColumn("payload", F.lit(None).cast("binary")).withColumn("header", _header())
    whole = _at(copy, ~own, index.filter("warc_type = 'response'").select("place"), scratch)
    whole = whole.select("*", F.col("n").cast("long").alias("payload_bytes"), *[F.lit(None).cast("string").alias(f"refers_{x}") for x in ("to", "url", "date", "digest")])
    return revisits.select(*plain).unionByName(whole.withColumn("header", _header()).select(*plain))


def _at(copy: DataFrame, besides: Column, places: DataFrame, scratch: Scratch) -> DataFrame:
    """The rows of ``copy`` with a place in ``places``, and those with ``besides``.

    A bit a place is broadcast: 4 KB for up to 32,768 rows that a task copied one after the other, so no row of ``copy`` is shuffled. Over MOST_BITMAPS are joined without a broadcast, which shuffles the rows.
    """
    bitmaps = scratch.write(places.groupBy(F.shiftright("place", PLACE_BITS).alias("at")).agg(F.bitmap_construct_agg(F.col("place") % (1 << PLACE_BITS)).alias("bits")))
    few = bitmaps.count() <= MOST_BITMAPS
    spot = (F.col("place") % (1 << PLACE_BITS)).cast("int")
    byte = F.conv(F.hex(F.substring("bits", F.shiftright(spot, 3) + 1, F.lit(1))), 16, 10).cast("int")
    marked = copy.withColumn("at", F.shiftright("place", PLACE_BITS)).join(F.broadcast(bitmaps) if few else bitmaps, "at", "left")
    return marked.filter(besides | F.coalesce(F.getbit(byte, spot % 8) == 1, F.lit(False))).drop("at", "bits")


def _urn(kind: Column, record: Column, digest: Column) -> Column:
    h = F.md5(F.concat(kind, F.lit(" "), record, F.lit(" "), F.coalesce(digest, F.lit(""))).cast("binary"))  # null without a record
    made = F.regexp_replace(h, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "<urn:uuid:$1-$2-$3-$4-$5>")
    return F.when(record.rlike("^<[^<>]+>$"), record).otherwise(made)


def _header() -> Column:
    """The header of a record of the output, up to and with the empty line; after it come the HTTP header and the payload."""
    kind = F.col("warc_type")
    lines = [
        F.lit("WARC/1.1"),
        F.concat(F.lit("WARC-Type: "), kind),
        F.concat(F.lit("WARC-Record-ID: "), _urn(kind, F.col("record_id"), F.col("digest"))),
        F.concat(F.lit("WARC-Date: "), F.col("date")),
        F.when(kind.isin("response", "revisit") | (F.col("url") != ""), F.concat(F.lit("WARC-Target-URI: "), F.col("url"))),
        F.concat(F.lit("WARC-Payload-Digest: "), F.col("digest")),
        F.when(kind == "revisit", F.lit("WARC-Profile: " + REVISIT_PROFILE)),
        F.concat(F.lit("WARC-Refers-To: "), _urn(F.lit("response"), F.col("refers_to"), F.col("refers_digest"))),
        F.concat(F.lit("WARC-Refers-To-Target-URI: "), F.col("refers_url")),
        F.concat(F.lit("WARC-Refers-To-Date: "), F.col("refers_date")),
        F.concat(F.lit("Content-Type: "), F.col("content_type")),
        F.concat(F.lit("Content-Length: "), (F.coalesce(F.octet_length("http"), F.lit(0)) + F.col("payload_bytes")).cast("string")),
    ]
    return F.concat(F.concat_ws("\r\n", *lines), F.lit("\r\n\r\n"))


def write_archives(resolved: DataFrame, path: str, compress: bool = True) -> DataFrame:
    """Writes the records of ``resolve`` as WARC files, one a partition, in the folder ``path``; returns (file, records, bytes).

    A file is written under a name of the task's own and then renamed, so a task that runs again, or twice, leaves one
    whole file. ``path`` is any place that pyarrow's file systems open and that all executors share. Each record is a gzip member of its own.
    Rows with a null header are passed over; a partition without rows gives a file without records. Repeated rows are written each; other columns are ignored.
    """
    ship_package(resolved.sparkSession)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs
        from pyspark import TaskContext

        task = TaskContext.get()
        system, folder = fs.FileSystem.from_uri(path)
        system.create_dir(folder, recursive=True)
        name = f"part-{task.partitionId():06d}.warc" + (".gz" if compress else "")
        own = f"{folder}/.{name}.{task.taskAttemptId()}"
        n = size = 0
        with system.open_output_stream(own, compression=None) as out:
            for b in batches:
                for header, http, payload in zip(*(b.column(c).to_pylist() for c in range(3))):
                    if header is None:
                        continue
                    raw = header.encode() + (http or b"") + (payload or b"") + b"\r\n\r\n"
                    raw = gzip.compress(raw, 6, mtime=0) if compress else raw
                    out.write(raw)
                    n, size = n + 1, size + len(raw)
        system.move(own, f"{folder}/{name}")
        yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([n], pa.int64()), pa.array([size], pa.int64())], ["file", "records", "bytes"])

    return resolved.select("header", "http", "payload").mapInArrow(write, "file string, records long, bytes long")


def archive(records: DataFrame, path: str | None = None, compress: bool = True) -> DataFrame:
    """The rows of ``resolve``, once they are written as archives too, with the archives' folder as ``.archives``.

    ``path`` is that of ``write_archives``; without one it is a new folder in the shared folder, which stays.
    """
    spark = records.sparkSession
    out = resolve(records)
    out.archives = path or f"{shared_folder(spark)}/scrubline/archives-{uuid.uuid4().hex}"
    write_archives(out, out.archives, compress).collect()
    return out


class Malformed(Exception):
    """An archive that ends within a record, or whose next record can't be told from it."""


def stream(raw) -> Iterator[dict]:
    """The records of an open archive, plain or compressed, as dicts of ``FIELDS``, one in memory at a time; raises ``Malformed``."""
    f = io.BufferedReader(raw) if isinstance(raw, io.RawIOBase) else raw
    while True:
        line = f.readline()
        if not line:
            return
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise Malformed("no record begins here")
        head, last = {}, None
        while line := f.readline():
            if not line.strip():
                break
            if line[:1] in b" \t" and last:
                head[last] += " " + line.strip().decode(errors="replace")
                continue
            name, _, value = line.decode(errors="replace").partition(":")
            last = name.strip().lower()
            head[last] = value.strip()
        size = head.get("content-length", "0")
        if not line or not (size.isascii() and size.isdigit()):
            raise Malformed("a header has no end or no length")
        body = f.read(int(size))
        if len(body) < int(size):
            raise Malformed("a record ends early")
        kind, http = head.get("warc-type"), None
        if kind in (None, "response", "revisit") and body.startswith(b"HTTP/"):
            top, gap, rest = body.partition(b"\r\n\r\n")
            http, body = top + gap, rest
        yield {
            "record_id": head.get("warc-record-id"),
            "warc_type": kind,
            "url": head.get("warc-target-uri"),
            "date": head.get("warc-date"),
            "digest": head.get("warc-payload-digest"),
            "refers_to": head.get("warc-refers-to"),
            "content_type": head.get("content-type"),
            "http": http,
            "payload": None if kind == "revisit" else body,
        }


def parse(data, strict: bool = False) -> Iterator[dict]:
    """The records of an archive, given as bytes or an open binary file, as dicts of ``FIELDS``.

    What follows a place where the archive breaks off, a length that is no number or damaged compression can't be told apart and is
    passed over, or raises ``Malformed`` if ``strict``. An empty archive has no records.
    """
    f = io.BytesIO(data) if isinstance(data, bytes) else io.BufferedReader(data, 1 << 20)
    start = f.peek(2) if isinstance(f, io.BufferedReader) else data
    if start[:2] == b"\x1f\x8b":
        f = gzip.GzipFile(fileobj=f)
    try:
        yield from stream(f)
    except (Malformed, EOFError, gzip.BadGzipFile, zlib.error) as e:
        if strict:
            raise Malformed(str(e)) from e


def read_archives(spark, path: str, strict: bool = False) -> DataFrame:
    """The records of all WARC files under ``path``, of every type, with ``FIELDS``. A task reads a file at a time, as a stream of one record after the other.

    ``path`` is any place that both Spark and pyarrow's file systems open. Damaged files are as in ``parse``. A folder without archives gives no rows.
    """
    ship_package(spark)
    names = [f.split()[0] for f in FIELDS.split(", ")]
    kinds = [pa.binary() if f.endswith("binary") else pa.string() for f in FIELDS.split(", ")]

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        def batch(rows: list[dict]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], kind) for n, kind in zip(names, kinds)], names)

        for b in batches:
            for where in b.column(0).to_pylist():
                scheme, _, rest = where.partition(":")
                scheme, rest = {"s3a": "s3", "s3n": "s3"}.get(scheme, scheme), quote(rest, safe="/:@")
                system, name = fs.FileSystem.from_uri(f"{scheme}:{rest if rest.startswith('//') else '//' + rest}")
                rows, size = [], 0
                with system.open_input_stream(name, compression=None) as f:
                    for r in parse(f, strict):
                        rows.append(r)
                        size += len(r["payload"] or b"") + 500
                        if size > 4 << 20:
                            yield batch(rows)
                            rows, size = [], 0
                if rows:
                    yield batch(rows)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc*").load(path).select("path")
    return files.mapInArrow(records, FIELDS)
