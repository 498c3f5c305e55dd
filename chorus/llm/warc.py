"""WARC archives: written with an index, read by coalesced byte ranges (operator 12).

Every page becomes a record of a ``.warc.gz`` archive, one gzip member per record, so
that a record can be read alone. Pages with equal payloads of at least ``LEAST`` bytes
are stored once: the one with the largest id is the ``response``, the others are
``revisit`` records that name it and carry no payload.

*Index first.* A task that appends a record knows its place; the index (file, offset,
length, URL, digest and the ids) is what the writing job returns, staged as a table.
An archive is named after its task attempt, so a lost or repeated attempt leaves a file
that no index row points to, and never a record twice.

*Reading* takes any selection of index rows. They are dealt to tasks by file and region,
sorted by offset inside a task, and neighbouring ranges (gaps up to ``GAP`` bytes) are
fetched by one read of at most ``MOST`` bytes, or of one record if that is longer. The
digest of every payload is compared with the one in its header. Revisits are resolved by
a join with the responses they name.

Archives lie in the shared folder and are opened with ``pyarrow.fs``, in tasks only.

Defined results: a null payload is empty; payloads are stored and hashed whole. A missing
id is the smallest; of equal payloads every row with the largest id is a response, so
repeated rows of that id are responses each. A null URL leaves its header out, control
characters in a URL are percent-encoded in the header. An empty table gives an empty
result. Other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, functions as F

from chorus.llm.common import stage
from chorus.workspace import shared_dir

LEAST = 1000  # bytes of payloads that are stored once
ARCHIVE = 1 << 30  # bytes after which a task begins another archive
REGION = 32 << 20  # bytes of an archive that one reading task takes
GAP = 64 << 10
MOST = 4 << 20
LEVEL = 6

#: Fixed values of the WARC format.
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Pages carry no time of capture.
NO_DATE = "1970-01-01T00:00:00Z"
_NAMES = uuid.UUID("6f1c2f6e-7d4d-5d3b-9d55-6a1f7f0c2b11")

INDEX = ("file string, offset long, length long, url string, digest string, page_id long, "
         "record_id string, record_type string, referred boolean")
RECORD = ("page_id long, record_type string, record_id string, refers_to string, "
          "payload_bytes long, payload_digest string, referred boolean")


def record_id(page_id: int | None, sha: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(_NAMES, f'{page_id}/{sha}')}>"


def _head(fields: list[tuple[str, str | None]]) -> bytes:
    lines = ["WARC/1.1", *(f"{k}: {v}" for k, v in fields if v is not None)]
    return ("\r\n".join(lines) + "\r\n\r\n").encode()


def _uri(url: str | None) -> str | None:
    return url and re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)


def make_record(page_id: int | None, url: str | None, payload: bytes, sha: str,
                refers_to: str | None) -> bytes:
    """One record; with ``refers_to``, a record id, a revisit without the payload."""
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    http = (b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
            b"Content-Length: %d\r\n\r\n" % len(payload))
    block = http if refers_to else http + payload
    head = _head([
        ("WARC-Type", "revisit" if refers_to else "response"),
        ("WARC-Record-ID", record_id(page_id, sha)), ("WARC-Date", NO_DATE),
        ("WARC-Target-URI", _uri(url)), ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("WARC-Profile", REVISIT_PROFILE if refers_to else None), ("WARC-Refers-To", refers_to),
        ("X-Page-Id", None if page_id is None else str(page_id)),
        ("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))])
    return head + block + b"\r\n\r\n"


def parse_record(data: bytes) -> tuple[dict[str, str], bytes]:
    """The header fields, names in lower case, and the payload of a record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("the range holds no WARC record")
    fields = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines[1:])}
    block = rest[:int(fields["content-length"])]
    if len(block) < int(fields["content-length"]):
        raise ValueError("the record is cut off")
    return fields, block.partition(b"\r\n\r\n")[2]


def _member(data: bytes) -> bytes:
    packer = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def _store(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(re.sub("^s3[an]:", "s3:", uri))


def _records(rows: list, schema: str) -> pa.RecordBatch:
    names = [x.split()[0] for x in schema.split(", ")]
    kinds = {"long": pa.int64(), "string": pa.string(), "boolean": pa.bool_(), "binary": pa.binary()}
    kind = dict(zip(names, (kinds[x.split()[1]] for x in schema.split(", "))))
    return pa.RecordBatch.from_arrays(
        [pa.array([r[i] for r in rows], kind[c]) for i, c in enumerate(names)], names=names)


class Archive:
    """The archives of one task attempt; ``add`` returns file, offset and length."""

    def __init__(self, folder: str):
        from pyspark import TaskContext

        self.folder, self.out, self.at = folder, None, 0
        self.name = f"{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}"
        self.made = 0

    def add(self, data: bytes) -> tuple[str, int, int]:
        if self.out is None or self.at >= ARCHIVE:
            self.close()
            self.file = f"{self.folder}/{self.name}-{self.made}.warc.gz"
            store, path = _store(self.file)
            if self.made == 0:
                store.create_dir(path.rpartition("/")[0], recursive=True)
            self.out, self.at, self.made = store.open_output_stream(path, compression=None), 0, self.made + 1
            info = b"format: WARC File Format 1.1\r\n"
            self._append(_head([("WARC-Type", "warcinfo"), ("WARC-Date", NO_DATE),
                                ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"),
                                ("Content-Type", "application/warc-fields"),
                                ("Content-Length", str(len(info)))]) + info + b"\r\n\r\n")
        return self.file, *self._append(data)

    def _append(self, data: bytes) -> tuple[int, int]:
        member, start = _member(data), self.at
        self.out.write(member)
        self.at += len(member)
        return start, len(member)

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
            self.out = None


def _writer(folder: str):
    def run(batches: Iterator[pa.RecordBatch]):
        archive = Archive(folder)
        try:
            for batch in batches:
                rows = []
                for page_id, url, html, sha, keeper, twice in zip(
                        *(batch.column(i) for i in range(6))):
                    page_id, sha, keeper = page_id.as_py(), sha.as_py(), keeper.as_py()
                    url, twice = url.as_py(), twice.as_py()
                    again = twice and page_id != keeper
                    payload = html.as_py()
                    data = make_record(page_id, url, payload, sha,
                                       record_id(keeper, sha) if again else None)
                    rows.append((*archive.add(data), url, hashlib.sha1(payload).hexdigest(), page_id,
                                 record_id(page_id, sha), "revisit" if again else "response",
                                 twice and not again))
                yield _records(rows, INDEX)
        finally:
            archive.close()

    return run


def write_archives(pages: DataFrame, folder: str | None = None, id_col: str = "page_id",
                   url_col: str = "url", html_col: str = "html", least: int = LEAST) -> DataFrame:
    """Write all pages below ``folder`` (a new shared one by default); returns the index."""
    folder = folder or shared_dir(pages.sparkSession, "warc")
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"),
                        F.col(url_col).cast("string").alias("url"),
                        F.coalesce(F.col(html_col).cast("string"), F.lit(""))
                        .cast("binary").alias("html"))
    rows = rows.withColumn("sha", F.sha2("html", 256))
    twice = (rows.filter(F.octet_length("html") >= least).groupBy("sha")
             .agg(F.max("page_id").alias("keeper"), F.count(F.lit(1)).alias("n"))
             .filter(F.col("n") > 1).select("sha", "keeper", F.lit(True).alias("twice")))
    marked = rows.join(stage(twice, "warc-twice"), "sha", "left")
    found = marked.select("page_id", "url", "html", "sha", "keeper",
                          F.coalesce("twice", F.lit(False)).alias("twice"))
    return stage(found.mapInArrow(_writer(folder), INDEX), "warc-index")


def coalesces(start: int, end: int, offset: int, length: int) -> bool:
    """Whether one read of ``start`` to ``end`` also takes a range that follows."""
    return offset - end <= GAP and max(end, offset + length) - start <= MOST


def _reads(batches: Iterator[pa.RecordBatch]):
    """(start, end, rows) for each read; rows are sorted, and those of one read are held."""
    start, end, held = 0, 0, []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            file, offset, length = row[:3]
            if held and (file != held[0][0] or not coalesces(start, end, offset, length)):
                yield start, end, held
                held = []
            if not held:
                start, end = offset, offset
            end = max(end, offset + length)
            held.append(row)
    if held:
        yield start, end, held


def _reader(payloads: bool, schema: str):
    def run(batches: Iterator[pa.RecordBatch]):
        name, source = None, None
        for start, end, rows in _reads(batches):
            if rows[0][0] != name:
                if source is not None:
                    source.close()
                name = rows[0][0]
                store, path = _store(name)
                source = store.open_input_file(path)
            data = source.read_at(end - start, start)
            out, size = [], 0
            for _, offset, length, referred in rows:
                raw = zlib.decompress(data[offset - start:offset - start + length], 31)
                fields, payload = parse_record(raw)
                digest = base64.b32decode(fields["warc-payload-digest"].removeprefix("sha1:"))
                refers = fields.get("warc-refers-to")
                if refers is None and hashlib.sha1(payload).digest() != digest:
                    raise ValueError(f"{name} at {offset}: the payload does not have its digest")
                page = fields.get("x-page-id")
                out.append((None if page is None else int(page), fields["warc-type"],
                            fields["warc-record-id"], refers,
                            None if refers else len(payload), digest.hex(), referred,
                            *([None if refers else payload] if payloads else [])))
                size += len(payload)
                if size > 4 * MOST:
                    yield _records(out, schema)
                    out, size = [], 0
            if out:
                yield _records(out, schema)
        if source is not None:
            source.close()

    return run


def read_records(index: DataFrame, payloads: bool = False) -> DataFrame:
    """The records of the chosen index rows, read by coalesced byte ranges.

    With ``payloads`` the column ``payload`` follows, null for revisits.
    """
    spark, schema = index.sparkSession, RECORD + ", payload binary" * payloads
    total = index.agg(F.sum("length")).first()[0] or 0
    n = max(spark.sparkContext.defaultParallelism, -(-total // REGION))
    dealt = (index.select("file", "offset", "length", "referred")
             .repartition(n, "file", F.expr(f"offset div {REGION}"))
             .sortWithinPartitions("file", "offset"))
    return dealt.mapInArrow(_reader(payloads, schema), schema)


def resolve(records: DataFrame) -> DataFrame:
    """Revisits get size and digest of the payload from the response they name."""
    kinds = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    own = records.filter(F.col("record_type") == "response").withColumn(
        "refers_to", F.lit(None).cast("long"))
    named = (records.filter("referred").groupBy(F.col("record_id").alias("refers_to"))
             .agg(F.first("page_id").alias("first_id"), F.first("payload_bytes").alias("bytes"),
                  F.first("payload_digest").alias("digest")))
    again = (records.filter(F.col("record_type") == "revisit")
             .join(named, "refers_to", "left")
             .select("page_id", F.col("bytes").alias("payload_bytes"),
                     F.col("digest").alias("payload_digest"), "record_type",
                     F.col("first_id").alias("refers_to")))
    return own.select(*kinds).unionByName(again)


def archived(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Write all pages, read all records back: one row per page."""
    index = write_archives(pages, folder)
    return resolve(stage(read_records(index), "warc-records"))
