"""WARC archives: write, normalise, index, read.

Crawlers may gzip a whole archive as one stream, which cannot be entered in the middle.
``normalise`` inflates such a stream once, writes every record as a gzip member of its
own, and keeps a sidecar index of where each member lies, so single records can be read.

Archives go to a folder all executors share, by PyArrow's file systems (local or mounted
folders, HDFS, S3, GCS). Each attempt of a task writes files of its own names and only
what the successful attempt returned is used, so lost executors leave no half-read file.
"""

from __future__ import annotations

import hashlib
import posixpath
import uuid
import zlib

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import delete, make_folder, materialize, new_folder, scratch

LEAST_REVISIT = 100
DATE = "2024-01-01T00:00:00Z"
INDEX = "archive string, record long, offset long, length long, record_id string, record_type string, page_id long, refers_to long, payload_bytes long, payload_digest string"
CHUNK = 1 << 20


def open_folder(uri: str) -> tuple[pafs.FileSystem, str]:
    """A file system and the path in it; a bare path is a local or mounted one."""
    if uri.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return pafs.FileSystem.from_uri(uri)


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None = None) -> bytes:
    """One WARC/1.1 record; a revisit states its payload's digest and size but holds none."""
    revisit = refers_to is not None
    name = "none" if page_id is None else str(page_id)
    target = "".join(c if 32 < ord(c) < 127 else "".join(f"%{b:02X}" for b in c.encode()) for c in url or "")
    lines = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:page:{name}>", f"WARC-Date: {DATE}", f"WARC-Target-URI: {target}",
        f"WARC-Payload-Digest: sha256:{digest}", f"X-Payload-Length: {len(payload)}",
    ]
    if revisit:
        lines += [f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    body = b"" if revisit else payload
    lines += ["Content-Type: text/html; charset=utf-8", f"Content-Length: {len(body)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def parse(stream):
    """(raw record, headers, payload) of each record of an iterable of inflated bytes."""
    buffer, ended = bytearray(), False
    stream = iter(stream)

    def more() -> bool:
        nonlocal ended
        got = next(stream, None)
        ended = got is None
        if got:
            buffer.extend(got)
        return not ended

    while True:
        while (head := buffer.find(b"\r\n\r\n")) < 0:
            if not more():
                if buffer.strip():
                    raise ValueError("an archive ends within a record's headers")
                return
        lines = bytes(buffer[:head]).decode().split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no WARC record: {lines[0][:40]!r}")
        headers = dict((k.strip().lower(), v.strip()) for k, _, v in (x.partition(":") for x in lines[1:]))
        size = int(headers["content-length"])
        end = head + 4 + size + 4
        while len(buffer) < end:
            if not more():
                raise ValueError("an archive ends within a record")
        raw = bytes(buffer[:end])
        del buffer[:end]
        yield raw, headers, raw[head + 4 : head + 4 + size]


def inflate(source):
    """The bytes of a gzip file of one or many members, read once from front to back."""
    inflater = None
    while chunk := source.read(CHUNK):
        while chunk:
            if inflater is None:
                inflater = zlib.decompressobj(31)
            # so much at once, however well a chunk is compressed
            yield inflater.decompress(chunk, CHUNK)
            chunk = inflater.unconsumed_tail
            if inflater.eof:
                chunk, inflater = inflater.unused_data, None
    if inflater is not None:
        raise ValueError("a gzip stream is cut off")


def _page(urn: str | None) -> int | None:
    name = (urn or "").strip("<>").rpartition(":")[2]
    return int(name) if name.lstrip("-").isdigit() else None


def write_monolithic(df: DataFrame, folder: str, archive_bytes: int = 64 << 20) -> DataFrame:
    """Write (page_id, url, html, digest, refers_to) rows as archives of one gzip stream
    each; (archive, records) of each. A partition starts a new archive after ``archive_bytes``."""

    def run(batches):
        fs, root = open_folder(folder)
        out = None
        for b in batches:
            payloads = b.column("html").cast(pa.large_binary()).to_pylist()
            for page, url, html, digest, refers in zip(b.column("page_id").to_pylist(), b.column("url").to_pylist(), payloads, b.column("digest").to_pylist(), b.column("refers_to").to_pylist()):
                if out is None:
                    name = f"{uuid.uuid4().hex}.warc.gz"
                    out, squeeze, n, size = fs.open_output_stream(posixpath.join(root, name), compression=None), zlib.compressobj(1, wbits=31), 0, 0
                got = record(page, url, html or b"", digest, refers)
                out.write(squeeze.compress(got))
                n, size = n + 1, size + len(got)
                if size >= archive_bytes:
                    out.write(squeeze.flush())
                    out.close()
                    yield pa.RecordBatch.from_pydict({"archive": [name], "records": pa.array([n], pa.int64())})
                    out = None
        if out is not None:
            out.write(squeeze.flush())
            out.close()
            yield pa.RecordBatch.from_pydict({"archive": [name], "records": pa.array([n], pa.int64())})

    cols = ["page_id", "url", "html", "digest", "refers_to"]
    return df.select(*cols).mapInArrow(run, "archive string, records long")


def normalise(archives: DataFrame, source: str, folder: str) -> DataFrame:
    """Rewrite each archive of ``archives`` (archive) with a member for every record; the
    sidecar index. A payload's digest and size are of the whole payload, also of a revisit,
    which states them; a response's are computed and compared with what it states."""

    def run(batches):
        src, src_root = open_folder(source)
        dst, dst_root = open_folder(folder)
        for b in batches:
            for archive in b.column(0).to_pylist():
                name, rows, offset = f"{uuid.uuid4().hex}.warc.gz", [], 0
                with src.open_input_stream(posixpath.join(src_root, archive), compression=None) as f, dst.open_output_stream(posixpath.join(dst_root, name), compression=None) as out:
                    for i, (raw, headers, payload) in enumerate(parse(inflate(f))):
                        squeeze = zlib.compressobj(1, wbits=31)
                        member = squeeze.compress(raw) + squeeze.flush()
                        out.write(member)
                        kind, page, refers, size, digest = described(headers, payload)
                        rows.append((name, i, offset, len(member), headers.get("warc-record-id"), kind, page, refers, size, digest))
                        offset += len(member)
                        if len(rows) >= 10_000:
                            yield _index(rows)
                            rows = []
                if rows:
                    yield _index(rows)

    return archives.select("archive").mapInArrow(run, INDEX)


def _index(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=[x.split()[0] for x in INDEX.split(", ")])


def read(index: DataFrame, folder: str, payload: bool = True) -> DataFrame:
    """Read each record of the index at its offset: page_id, record_type, refers_to,
    payload_bytes, payload_digest, url and, on request, the payload (null for revisits).

    All values are the record's own: a response's size and digest are computed from its
    payload, a revisit states those of the payload it refers to. A record that is not what
    the index says, or whose payload does not have its stated digest, is an error."""

    def run(batches):
        fs, root = open_folder(folder)
        name, source = None, None
        for b in batches:
            out = []
            for archive, offset, length, *told in zip(*(b.column(c).to_pylist() for c in ("archive", "offset", "length", "record_type", "page_id", "refers_to", "payload_bytes", "payload_digest"))):
                if archive != name:
                    name, source = archive, fs.open_input_file(posixpath.join(root, archive))
                try:
                    raw, headers, body = next(parse([zlib.decompress(source.read_at(length, offset), 31)]))
                    row = described(headers, body)
                except (zlib.error, StopIteration, KeyError) as error:
                    raise ValueError(f"no whole record at {offset} of {archive}") from error
                if list(row) != told:
                    raise ValueError(f"the record at {offset} of {archive} is not what the index says")
                kind, page, refers, size, digest = row
                out.append((page, kind, refers, size, digest, headers.get("warc-target-uri"), body if payload and kind != "revisit" else None))
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary()]
            cols = list(zip(*out)) or [[]] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)][: 6 + payload], names=["page_id", "record_type", "refers_to", "payload_bytes", "payload_digest", "url", "payload"][: 6 + payload])

    kind = "page_id long, record_type string, refers_to long, payload_bytes long, payload_digest string, url string"
    return index.mapInArrow(run, kind + ", payload binary" * payload)


def described(headers: dict[str, str], payload: bytes) -> tuple:
    """(record_type, page_id, refers_to, payload_bytes, payload_digest) of a record."""
    stated = headers.get("warc-payload-digest", "").removeprefix("sha256:")
    revisit = headers["warc-type"] == "revisit"
    digest, size = (stated, int(headers.get("x-payload-length", 0))) if revisit else (hashlib.sha256(payload).hexdigest(), len(payload))
    if stated and stated != digest:
        raise ValueError("a payload does not have its stated digest")
    return headers["warc-type"], _page(headers.get("warc-record-id")), _page(headers.get("warc-refers-to")) if revisit else None, size, digest


def revisits(pages: DataFrame, least: int = LEAST_REVISIT) -> DataFrame:
    """``pages`` (page_id, url, html) with digest and refers_to: of rows with equal payloads of
    at least ``least`` bytes that with the smallest page_id is the response, others revisit it.

    Only digests that repeat are joined back; a digest that a third of all pages share is
    one row after the partial aggregation, and AQE splits its rows in the join.
    """
    p = pages.withColumn("digest", F.sha2(F.coalesce(F.col("html"), F.lit("")).cast("binary"), 256))
    keys = p.where((F.octet_length("html") >= least) & F.col("page_id").isNotNull())
    first = keys.groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").select(F.col("digest").alias("d"), "first")
    refers = F.when(F.col("page_id") != F.col("first"), F.col("first"))
    return p.join(first, F.col("digest") == F.col("d"), "left").withColumn("refers_to", refers).drop("d", "first")


def archive_pages(df: DataFrame, folder: str | None = None) -> tuple[DataFrame, str]:
    """Write pages (page_id, url, html) as archives and give their index and folder. The index
    is a sidecar of the archives: Parquet in ``index`` within the folder, so that
    ``read_folder`` needs nothing else.

    A null html is an empty payload, a null url an empty target, a null page_id a record
    named ``none`` that is always a response. Rows that repeat a page_id and a payload are
    captures of one record and share its type. Empty tables give an empty index.
    """
    spark = df.sparkSession
    home = folder or new_folder(spark, "warc")
    raw, out = (make_folder(spark, home) + x for x in ("/whole", "/members"))
    with scratch(spark):
        pages = revisits(df.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html")))
        archives, _ = materialize(write_monolithic(pages, make_folder(spark, raw)), "archives")
        # one row an archive: dealt out, so that no task has many of them
        n = max(1, archives.count())
        index = normalise(archives.repartition(min(n, 4096)), raw, make_folder(spark, out))
        index.write.parquet(out + "/index")
    delete(spark, raw)
    return spark.read.schema(INDEX).parquet(out + "/index"), out


def read_folder(spark: SparkSession, folder: str, payload: bool = True) -> DataFrame:
    """All records of a folder that ``archive_pages`` gave, by its sidecar index."""
    return read(spark.read.schema(INDEX).parquet(folder + "/index"), folder, payload)
