"""Archives, index and reads against the pages themselves."""

import collections
import gzip
import hashlib
import random

import compare

from voxframe.llm import warc as W
from voxframe.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
SCHEMA = "page_id long, url string, html string, digest string, payload int, target long, salt int"


def frame(spark, pages):
    return spark.createDataFrame([(*p, "x", 1, 2, 3) for p in pages], SCHEMA)


def brute(pages):
    groups = collections.defaultdict(list)
    for at, (page_id, _, html) in enumerate(pages):
        body = (html or "").encode()
        groups[body].append((page_id is None, page_id or 0, at))
    out = []
    for at, (page_id, _, html) in enumerate(pages):
        body = (html or "").encode()
        first = min(groups[body])
        revisit = len(body) >= 100 and first[2] != at
        out.append((page_id, len(body), hashlib.sha256(body).hexdigest(), "revisit" if revisit else "response",
                    pages[first[2]][0] if revisit else None))
    return sorted(out, key=repr)


def made():
    random.seed(3)
    pages = [(i, f"http://h{i % 7}.org/p?q={i} x\r\nX-Bad: 1", f"<p>{i}</p>" + "ä" * random.randrange(300)) for i in range(200)]
    pages += [(1000 - i, "http://copy.org", "<html>copied\r\n\r\nWARC/1.1 text</html>" * 10) for i in range(150)]
    pages += [(2000 + i, None, "x" * n) for i, n in enumerate((99, 99, 100, 100, 101))]
    pages += [(3000, "u", None), (3001, "u", ""), (3002, "", None), (None, "n", "null id " * 30), (None, "n", "null id " * 30),
              (3003, "n", "null id " * 30), (None, "m", "only null ids " * 20), (None, "m", "only null ids " * 20)]
    pages += [(3100, "r", "the same row " * 20)] * 5  # rows that repeat in full
    pages += [(3200, "日本/ü", "long " * 400_000)]
    return pages


def test_pages_come_back(spark):
    pages = made()
    got = [tuple(r) for r in W.digest(frame(spark, pages)).collect()]
    assert sorted(got, key=repr) == brute(pages)


def test_empty_table(spark):
    assert W.digest(frame(spark, []).limit(0)).count() == 0


def members(path):
    """(offset, length, record) of every gzip member of a file, by the standard library alone."""
    import zlib

    data, at = open(path, "rb").read(), 0
    while at < len(data):
        one = zlib.decompressobj(31)
        whole = one.decompress(data[at:])
        size = len(data) - at - len(one.unused_data)
        yield at, size, whole
        at += size


def test_archives_and_index(spark, tmp_path):
    pages = made()
    rows = W.classified(frame(spark, pages), "page_id", "url", "html", 100)
    index = W.write_archives(rows, str(tmp_path / "a"), file_bytes=20_000).collect()
    assert len(index) == len(pages)
    files = list((tmp_path / "a").iterdir())
    assert len(files) > 4
    listed = {(r.file, r.offset): r for r in index}
    for file in files:
        for n, (offset, size, whole) in enumerate(members(file)):
            headers, block = W.parse(whole)
            assert whole.endswith(b"\r\n\r\n") and len(whole) == whole.index(b"\r\n\r\n") + 8 + len(block)
            if not n:
                assert headers["warc-type"] == b"warcinfo"
                continue
            row = listed.pop((str(file), offset))
            assert row.length == size and row.record_type.encode() == headers["warc-type"]
            assert headers["warc-payload-digest"].decode() == f"sha256:{row.digest}"
            assert headers.get("warc-target-uri", b"").decode() == (row.url or "")
            assert "x-bad" not in headers
            if row.record_type == "response":
                assert hashlib.sha256(block.partition(b"\r\n\r\n")[2]).hexdigest() == row.digest
    assert not listed
    assert gzip.open(files[0]).read().startswith(b"WARC/1.1")


def test_selected_records_only(spark, tmp_path):
    pages = made()
    index = W.archive(frame(spark, pages), str(tmp_path / "b"))
    some = index.where("page_id % 5 = 0 AND record_type = 'response'")
    want = {r.page_id for r in some.collect()}
    for gap, most in ((0, 1), (1 << 30, 1 << 30), (200, 1000)):
        got = W.read_records(some, gap, most).collect()
        assert {r.page_id for r in got} == want and len(got) == some.count()
        texts = {p[0]: p[2] for p in pages}
        assert all(bytes(r.payload).decode() == (texts[r.page_id] or "") for r in got)


def test_ranges():
    places = [(0, 10), (10, 5), (20, 5), (100, 50), (150, 1), (200, 500)]
    assert list(W.ranges(places, 5, 100)) == [(0, 25, [0, 1, 2]), (100, 151, [3, 4]), (200, 700, [5])]
    assert [n for *_, numbers in W.ranges(places, 0, 1) for n in numbers] == list(range(6))
    assert list(W.ranges(places, 1000, 10_000)) == [(0, 700, list(range(6)))]
    assert not list(W.ranges([]))


def test_unlisted_archives_are_ignored(spark, tmp_path):
    index = W.archive(frame(spark, made()[:20]), str(tmp_path / "c"))
    (tmp_path / "c" / "left-by-a-lost-task.warc.gz").write_bytes(b"half a reco")
    assert W.read_records(index).count() == 20


def test_query_equals_sql(spark):
    got = compare.spark_rows(QUERIES["op11_warc"](spark, SF))
    want = compare.sql_rows(compare.connect(SF), ORACLES["op11_warc"])
    assert got[1] and compare.difference(got, want) is None
