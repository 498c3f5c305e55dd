from __future__ import annotations

import gzip
import hashlib
import io
import zlib
from collections import defaultdict
from pathlib import Path

import pytest

from chorus.llm import warc
from chorus.llm.common import stage


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5)


def brute(rows):
    last = defaultdict(lambda: None)
    for i, _, html in rows:
        data = (html or "").encode()
        if i is not None and (last[data] is None or i > last[data]):
            last[data] = i
    out = []
    for i, _, html in rows:
        data = (html or "").encode()
        again = len(data) >= 1000 and i != last[data]
        out.append((i, len(data), hashlib.sha1(data).hexdigest(),
                    "revisit" if again else "response", last[data] if again else None))
    return sorted(out, key=repr)


def found(df):
    return sorted((tuple(r) for r in warc.archived(df).collect()), key=repr)


@pytest.fixture(scope="module")
def rows(prose, awkward):
    long, other = prose(400, 11), prose(300, 12)
    texts = [*awkward, "x" * 999, "x" * 999, "y" * 1000, "y" * 1000, "é" * 500, "é" * 500,
             "é" * 499, "é" * 499, *[long] * 300, *[other] * 7, "HTTP\r\n\r\nWARC/1.1\r\n\r\n" * 60,
             prose(30_000, 13)]
    return [(i * 13 % 1009, None if i % 11 == 0 else f"http://host/{i}?q=\n é", t)
            for i, t in enumerate(texts)]


def test_like_brute_force(spark, rows, clashing):
    assert found(clashing(pages(spark, rows))) == brute(rows)


def test_missing_and_repeated_ids(spark):
    same = "z" * 2000
    rows = [(None, "u", same), (4, "u", same), (4, "v", same), (2, None, same), (None, None, None),
            (None, "u", "w" * 1500), (None, "u", "w" * 1500)]
    assert found(pages(spark, rows)) == brute(rows)


def test_empty_table(spark):
    assert found(pages(spark, [])) == []


def test_archives_are_plain_warc_files(spark, rows, tmp_path):
    """Every member of the files, read from their start, is a record of the index or warcinfo."""
    index = warc.write_archives(pages(spark, rows), f"file://{tmp_path}").collect()
    seen = {}
    for path in tmp_path.glob("*.warc.gz"):
        data, at = path.read_bytes(), 0
        while at < len(data):
            member = zlib.decompressobj(31)
            record = member.decompress(data[at:])
            size = len(data) - at - len(member.unused_data)
            seen[path.name, at] = (size, record)
            at += size
        assert gzip.GzipFile(fileobj=io.BytesIO(data)).read().startswith(b"WARC/1.1\r\n")
    assert len(seen) == len(index) + len(list(tmp_path.glob("*.warc.gz")))
    html = {(i, u): t or "" for i, u, t in rows}
    for r in index:
        size, record = seen[Path(r.file).name, r.offset]
        assert size == r.length
        head, _, block = record.partition(b"\r\n\r\n")
        assert block.endswith(b"\r\n\r\n")
        fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
        assert int(fields["Content-Length"]) == len(block) - 4
        assert fields["WARC-Type"] == r.record_type and fields["WARC-Record-ID"] == r.record_id
        assert ("WARC-Refers-To" in fields) == (r.record_type == "revisit")
        payload = block[:-4].partition(b"\r\n\r\n")[2].decode()
        assert payload == ("" if r.record_type == "revisit" else html[r.page_id, r.url])


def test_a_selection_gives_its_payloads(spark, rows):
    index = warc.write_archives(pages(spark, rows))
    chosen = index.filter("page_id % 3 = 0")
    got = {r.page_id: r.payload for r in warc.read_records(chosen, payloads=True).collect()}
    want = {r.page_id: r.record_type for r in chosen.collect()}
    html = {i: t for i, _, t in rows}
    assert got.keys() == want.keys()
    for i, kind in want.items():
        assert got[i] is None if kind == "revisit" else bytes(got[i]).decode() == (html[i] or "")


def test_a_damaged_payload_is_noticed(spark, tmp_path):
    index = stage(warc.write_archives(pages(spark, [(1, "u", "a" * 50)]), f"file://{tmp_path}"), "test")
    row = index.first()
    path = Path(row.file.removeprefix("file://"))
    data = path.read_bytes()
    record = zlib.decompress(data[row.offset:], 31).replace(b"a" * 50, b"b" * 50)
    path.write_bytes(data[:row.offset] + gzip.compress(record))
    from pyspark.sql import functions as F
    longer = index.withColumn("length", F.lit(path.stat().st_size - row.offset))
    with pytest.raises(Exception, match="does not have its digest"):
        warc.read_records(longer).collect()


class Batch:
    def __init__(self, rows):
        self.columns = [Column([r[i] for r in rows]) for i in range(4)]


class Column(list):
    def to_pylist(self):
        return self


def test_neighbouring_ranges_are_one_read():
    near, far, most = warc.GAP, warc.GAP + 1, warc.MOST
    rows = [("a", 0, 10, False), ("a", 10, 10, False), ("a", 20 + near, 10, False),
            ("a", 30 + near + far, 10, False), ("b", 0, 10, False), ("b", 10, most, False),
            ("b", 10 + most, 10, False)]
    reads = list(warc._reads([Batch(rows[:3]), Batch(rows[3:])]))
    assert [(s, e, len(r)) for s, e, r in reads] == [
        (0, 30 + near, 3), (30 + near + far, 40 + near + far, 1), (0, 10, 1),
        (10, 10 + most, 1), (10 + most, 20 + most, 1)]
