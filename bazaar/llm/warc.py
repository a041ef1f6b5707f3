"""WARC archives: writing, normalising monolithic gzip files, reading by offset.

An archive that was compressed as one gzip stream cannot be read from the
middle.  The normaliser inflates such a file once, front to back, and rewrites
each record as a gzip member of its own; beside the new file it writes an index
of offsets (one JSON line a record).  Files are one task each, since a single gzip
stream can only be inflated in order; memory stays at one buffer, however long
records and files are.

Payloads equal to an earlier one are ``revisit`` records that refer to the
``response`` with the smallest page id.  Ids per digest are found by aggregation
before the join, and a digest that many pages share is split by Spark's skewed
join.

Files lie in a folder that all machines share (below spark.checkpoint.dir) and are
named by task attempt; only files that a finished task reports are read, so a lost
executor or a repeated attempt leaves nothing half-written behind that counts.

Defined results: a null payload counts as empty; rows with the same payload and
the same smallest page id are all responses; among equal payloads a row without
page id revisits the smallest id, and without any id all are responses; control
characters in urls are percent-encoded; extra columns are passed over; no rows
give no records.
"""

from __future__ import annotations

import base64
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bazaar.llm.common import cut, shared_folder, shared_fs, table

BUFFER = 1 << 20
GZIP = 31  # zlib's window bits for the gzip format
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD = "page_id string, url string, record_type string, refers_to string, payload_bytes long, payload_digest string"


# -- records ----------------------------------------------------------------------------

def digest_text(sha1: bytes) -> str:
    return base64.b32encode(sha1).decode()


def _header_value(text: str) -> str:
    return "".join(quote(c) if ord(c) < 33 or ord(c) == 127 else c for c in text)


def _id_value(page_id: str) -> str:
    """A page id as a header value that ``unquote`` gives back whole."""
    return quote(page_id, safe="!#$&'()*+,/:;=?@[]~")


def _record_id(page_id: str | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}/{digest}')}>"


def record(page_id: str | None, url: str | None, payload: bytes, digest: str, refers_to: str | None, revisit: bool) -> bytes:
    """A whole WARC record, with an HTTP response as block (its head alone in a revisit)."""
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode() + (b"" if revisit else payload)
    head = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", _record_id(page_id, digest)), ("WARC-Date", DATE),
            ("WARC-Payload-Digest", f"sha1:{digest}"), ("X-Payload-Bytes", str(len(payload)))]
    if url is not None:
        head.append(("WARC-Target-URI", _header_value(url)))
    if page_id is not None:
        head.append(("X-Page-Id", _id_value(page_id)))
    if revisit:
        head += [("WARC-Profile", PROFILE), ("WARC-Refers-To", _record_id(refers_to, digest))]
        if refers_to is not None:
            head.append(("X-Refers-To-Page-Id", _id_value(refers_to)))
    head += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode("utf-8", "surrogatepass") + b"\r\n" + block + b"\r\n\r\n"


def parse_head(head: bytes) -> dict[str, str]:
    version, *lines = head.decode("utf-8", "surrogatepass").split("\r\n")
    if not version.startswith("WARC/"):
        raise ValueError(f"no WARC record: {version[:40]!r}")
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines if x)}


def inflate(chunks: Iterator[bytes]) -> Iterator[bytes]:
    """The bytes of a gzip file of one or many members, a buffer at a time."""
    zip_ = zlib.decompressobj(GZIP)
    for chunk in chunks:
        while chunk:
            if zip_.eof:
                zip_ = zlib.decompressobj(GZIP)
            yield zip_.decompress(chunk, BUFFER)
            chunk = zip_.unused_data if zip_.eof else zip_.unconsumed_tail
    if not zip_.eof:
        yield zip_.flush()


class Stream:
    """Reads heads and so many bytes from a stream of chunks, holding one buffer."""

    def __init__(self, chunks: Iterator[bytes]):
        self.chunks, self.held = chunks, b""

    def more(self) -> bool:
        for chunk in self.chunks:
            if chunk:
                self.held += chunk
                return True
        return False

    def head(self) -> bytes | None:
        """Bytes up to and with the next empty line; None at the end."""
        while (end := self.held.find(b"\r\n\r\n")) < 0:
            if not self.more():
                if self.held.strip():
                    raise ValueError("the archive ends within a record")
                return None
        out, self.held = self.held[:end + 4], self.held[end + 4:]
        return out

    def take(self, n: int) -> Iterator[bytes]:
        while n:
            if not self.held and not self.more():
                raise ValueError("the archive ends within a record")
            part, self.held = self.held[:n], self.held[n:]
            n -= len(part)
            yield part


def normalise_stream(chunks: Iterator[bytes], write) -> Iterator[tuple[int, int, dict[str, str]]]:
    """Writes each record of an inflated archive as a member; yields offset, length and head."""
    stream, offset = Stream(chunks), 0
    while (head := stream.head()) is not None:
        fields, zip_ = parse_head(head), zlib.compressobj(6, zlib.DEFLATED, GZIP)
        length = write(zip_.compress(head))
        for part in stream.take(int(fields["content-length"]) + 4):
            length += write(zip_.compress(part))
        length += write(zip_.flush())
        yield offset, length, fields
        offset += length


# -- Spark ------------------------------------------------------------------------------

def _attempt() -> str:
    task = TaskContext.get()
    return f"{task.partitionId():06d}-{task.taskAttemptId()}-{uuid.uuid4().hex[:8]}"


def with_revisits(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """page_id, url, html, sha1 (hex), refers_to and revisit of each page."""
    pages = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html")).withColumn("sha1", F.sha1(F.col("html").cast("binary")))
    # Only digests of several pages; stored, so that the join's two sides are plain
    # shuffles and Spark can split a digest that many pages share.
    first = cut(pages.groupBy("sha1").agg(F.min("page_id").alias("first_id"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"))
    revisit = (F.octet_length("html") >= min_bytes) & F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    return pages.join(first, "sha1", "left").select("page_id", "url", "html", "sha1", F.when(revisit, F.col("first_id")).alias("refers_to"), revisit.alias("revisit"))


def write_monolithic(records: DataFrame, folder: str) -> DataFrame:
    """One gzip stream of records for each task; ``path`` of the files, as a stored table."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = shared_fs(folder)
        name, out, zip_ = f"whole-{_attempt()}.warc.gz", None, zlib.compressobj(6, zlib.DEFLATED, GZIP)
        for batch in batches:
            for row in zip(*(batch.column(c) for c in ("page_id", "url", "html", "sha1", "refers_to", "revisit"))):
                page_id, url, html, sha1, refers_to, revisit = (x.as_py() for x in row)
                if out is None:
                    fs.create_dir(base, recursive=True)
                    out = fs.open_output_stream(f"{base}/{name}", compression=None)
                out.write(zip_.compress(record(page_id, url, html.encode("utf-8", "surrogatepass"), digest_text(bytes.fromhex(sha1)), refers_to, revisit)))
        if out is not None:
            out.write(zip_.flush())
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([f"{folder}/{name}"])], ["path"])

    text = records.withColumns({c: F.col(c).cast("string") for c in ("page_id", "refers_to")})
    return cut(text.mapInArrow(run, "path string"))


def normalise(files: DataFrame, folder: str) -> DataFrame:
    """Rewrites each monolithic file with a member a record and a sidecar index; the index as a stored table."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = shared_fs(folder)
        for batch in batches:
            for path in batch.column("path").to_pylist():
                fs.create_dir(base, recursive=True)
                name, rows = f"members-{_attempt()}.warc.gz", []
                to = f"{base}/{name}"
                with fs.open_input_stream(shared_fs(path)[1], compression=None) as source, fs.open_output_stream(to, compression=None) as out, fs.open_output_stream(f"{to}.idx", compression=None) as index:
                    def write(data: bytes) -> int:
                        out.write(data)
                        return len(data)

                    for offset, length, head in normalise_stream(inflate(iter(lambda: source.read(BUFFER), b"")), write):
                        entry = {"offset": offset, "length": length, "id": head["warc-record-id"], "type": head["warc-type"], "digest": head.get("warc-payload-digest")}
                        index.write(json.dumps(entry).encode() + b"\n")
                        rows.append((f"{folder}/{name}", offset, length))
                        if len(rows) >= 10_000:
                            yield _index_rows(rows)
                            rows = []
                if rows:
                    yield _index_rows(rows)

    def _index_rows(rows):
        return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows), (pa.string(), pa.int64(), pa.int64()))], ["path", "offset", "length"])

    # A row is a whole file's work: the shuffle deals files out one by one.
    return cut(files.repartition(files.sparkSession.sparkContext.defaultParallelism).mapInArrow(run, "path string, offset long, length long"))


def read_members(index: DataFrame, payload: bool = False) -> DataFrame:
    """The records that an index points to, each read on its own by offset; digests are checked."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs = source = opened = None
        for batch in batches:
            rows = []
            for path, offset, length in zip(*(batch.column(c).to_pylist() for c in ("path", "offset", "length"))):
                if path != opened:
                    fs, base = shared_fs(path)
                    source, opened = fs.open_input_file(base), path
                source.seek(offset)
                data = zlib.decompress(source.read(length), GZIP)
                cut_ = data.index(b"\r\n\r\n") + 4
                head, block = parse_head(data[:cut_]), data[cut_:-4]
                body = block[block.index(b"\r\n\r\n") + 4:]
                digest = head["warc-payload-digest"].removeprefix("sha1:")
                full = head["warc-type"] == "response"
                if full and digest_text(hashlib.sha1(body).digest()) != digest:
                    raise ValueError(f"payload digest differs in {path} at {offset}")
                page_id, refers_to = (x if x is None else unquote(x) for x in (head.get("x-page-id"), head.get("x-refers-to-page-id")))
                rows.append((page_id, head.get("warc-target-uri"), head["warc-type"], refers_to,
                             len(body) if full else int(head["x-payload-bytes"]), digest, body if full and payload else None))
            if rows:
                kinds = [pa.string()] * 4 + [pa.int64(), pa.string(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows), kinds)][:6 + payload], [*names, "payload"][:6 + payload])

    names = [x.split()[0] for x in RECORD.split(", ")]
    return index.mapInArrow(run, RECORD + ", payload binary" * payload)


def op6_warc_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A record per row of ``pages`` in monolithic archives, normalised and read back by offset."""
    pages, folder = table(spark, sf_dir, "pages"), shared_folder(spark, "warc")
    whole = write_monolithic(with_revisits(pages), f"{folder}/whole")
    records = read_members(normalise(whole, f"{folder}/members"))
    kind = pages.schema["page_id"].dataType
    return records.select(F.col("page_id").cast(kind).alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(kind).alias("refers_to"), "url")
