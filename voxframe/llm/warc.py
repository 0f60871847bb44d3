"""WARC archives with an index first, and coalesced byte-range reads of selected records.

Each task writes archives of its own (every record a gzip member) and yields one index
row for each record: file, offset, length, URL and digest. The index is a table
that Spark commits; archives of a failed attempt are never in it, so lost executors
leave nothing but files that no one reads. To read records, their index rows are
sorted by file and offset, and neighbouring ranges are fetched in one read.
"""

from __future__ import annotations

import gzip
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyarrow.fs import FileSystem
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxframe.llm.common import cut, scratch

MIN_BYTES = 100
FILE_BYTES = 256 << 20
READ_BYTES = 8 << 20
GAP_BYTES = 64 << 10
BATCH_BYTES = 16 << 20
SLICE_BYTES = 8 << 20
MOST_SLICES = 20_000
SALTS = 32
LEVEL = 6
DATE = "1970-01-01T00:00:00Z"
# Names that the format gives
IDENTICAL = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
VERSION = b"WARC/1.1"

INDEX_SCHEMA = "file string, offset long, length long, url string, digest string, record_type string, page_id long"
RECORD_SCHEMA = (
    "file string, offset long, record_id string, record_type string, page_id long, url string, digest string, "
    "refers_id string, refers_to long, payload binary"
)


def shared_files(path: str) -> tuple[FileSystem, str]:
    """File system and path of a folder that all executors share (a local path, or hdfs, s3, gs)."""
    path = re.sub(r"^file:/+", "/", path)
    return FileSystem.from_uri(re.sub(r"^s3[an]://", "s3://", path))


def classified(pages: DataFrame, page_id: str, url: str, html: str, min_bytes: int) -> DataFrame:
    """(page_id, url, payload, digest, bytes, refers_to, revisit): one row for each record to write.

    Of equal payloads of at least `min_bytes` bytes the page with the smallest page_id (NULL last, then by url)
    is the response; smaller payloads are all responses. Payloads are moved once, by an aggregate that keeps
    the first page of each digest and so combines copies before the shuffle. Revisits need no payload:
    they are counted by (digest, page, url), and those of a digest meet its first page in SALTS pieces.
    """
    body = F.coalesce(F.col(html).cast("string"), F.lit("")).cast("binary")
    named = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), body.alias("payload"))
    rows = named.withColumns({"bytes": F.octet_length("payload").cast("long"), "digest": F.sha2("payload", 256)})
    order = [F.col("page_id").isNull().alias("none"), F.col("page_id"), F.col("url").isNull().alias("bare"), F.col("url")]
    long = rows.where(F.col("bytes") >= min_bytes)
    firsts = long.groupBy("digest").agg(F.min(F.struct(*order, "payload", "bytes")).alias("f"))
    none = [F.lit(None).cast("long").alias("refers_to"), F.lit(False).alias("revisit")]
    shown = ["page_id", "url", "payload", "digest", "bytes", "refers_to", "revisit"]
    responses = firsts.select("f.page_id", "f.url", "f.payload", "digest", "f.bytes", *none)
    small = rows.where(F.col("bytes") < min_bytes).select("page_id", "url", "payload", "digest", "bytes", *none)
    salt = F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).alias("salt")
    groups = cut(long.groupBy("digest", "bytes", "page_id", "url", salt).agg(F.count(F.lit(1)).alias("n")))
    pieces = groups.groupBy("digest", "salt").agg(F.sum("n").alias("n"), F.min(F.struct(*order)).alias("f"))
    copied = pieces.groupBy("digest").agg(F.sum("n").alias("all"), F.min("f").alias("f")).where(F.col("all") > 1)
    met = pieces.select("digest", "salt").join(copied, "digest")
    is_first = F.col("page_id").eqNullSafe(F.col("f.page_id")) & F.col("url").eqNullSafe(F.col("f.url"))
    left = F.col("n") - is_first.cast("long")
    revisits = (
        groups.join(met, ["digest", "salt"]).withColumn("left", left).where("left > 0")
        .select("page_id", "url", F.lit(None).cast("binary").alias("payload"), "digest", "bytes", F.col("f.page_id").alias("refers_to"),
                F.lit(True).alias("revisit"), F.explode(F.sequence(F.lit(1), "left")))
    )
    return responses.unionByName(small).unionByName(revisits.select(shown))


def _head(lines: list[tuple[str, object]], first: bytes = VERSION) -> bytes:
    shown = [f"{k}: {v}".encode() if not isinstance(v, bytes) else k.encode() + b": " + v for k, v in lines if v is not None]
    return b"\r\n".join([first, *shown, b"", b""])


def _uri(url: bytes | None) -> bytes | None:
    """A header's value may hold no blanks or control characters; they are percent-encoded."""
    return None if url is None else re.sub(rb"[\x00-\x20\x7F]", lambda m: b"%%%02X" % m[0][0], url)


def record(row: dict, space: uuid.UUID, min_bytes: int = MIN_BYTES, date: str = DATE) -> tuple[bytes, bytes | None, str]:
    """(whole record, URL, type) of one page: an HTTP answer with its payload, or a revisit without one.

    The id of a response that others may refer to follows from its digest.
    """
    kind, payload = ("revisit", b"") if row["revisit"] else ("response", row["payload"])
    shared = f"<{uuid.uuid5(space, row['digest']).urn}>"
    own = shared if kind == "response" and row["bytes"] >= min_bytes else f"<{uuid.uuid4().urn}>"
    answer = [("Content-Type", "text/html; charset=utf-8"), ("Content-Length", row["bytes"])]
    block = _head(answer, b"HTTP/1.1 200 OK") + payload
    url = _uri(row["url"])
    lines = [
        ("WARC-Type", kind), ("WARC-Record-ID", own), ("WARC-Date", date), ("WARC-Target-URI", url),
        ("WARC-Payload-Digest", f"sha256:{row['digest']}"), ("X-Page-ID", row["page_id"]),
        ("Content-Type", "application/http;msgtype=response"), ("Content-Length", len(block)),
    ]
    if kind == "revisit":
        lines += [("WARC-Profile", IDENTICAL), ("WARC-Refers-To", shared), ("X-Refers-To-Page-ID", row["refers_to"])]
    return _head(lines) + block + b"\r\n\r\n", url, kind


def parse(data: bytes) -> tuple[dict[str, bytes], bytes]:
    """(headers by lower-case name, block) of one record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    first, *lines = head.split(b"\r\n")
    if not first.startswith(b"WARC/"):
        raise ValueError("no record begins here")
    pairs = [line.partition(b":") for line in lines]
    headers = {k.decode().strip().lower(): v.strip() for k, _, v in pairs}
    size = int(headers["content-length"])
    if len(rest) < size:
        raise ValueError("the record ends before its block")
    return headers, rest[:size]


def write_archives(
    rows: DataFrame, folder: str, min_bytes: int = MIN_BYTES, file_bytes: int = FILE_BYTES, date: str = DATE
) -> DataFrame:
    """Write every row of `classified` as a record below `folder`; returns the index, a stored table.

    A task begins a new archive after `file_bytes`. Each archive starts with a `warcinfo` record, which the index leaves out.
    """
    space = uuid.uuid4()

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, base = shared_files(folder)
        files.create_dir(base, recursive=True)
        out, name, at = None, None, 0
        names = [c.split(" ")[0] for c in INDEX_SCHEMA.split(", ")]
        types = [pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.string(), pa.string(), pa.int64()]
        try:
            for batch in batches:
                made = []
                for i in range(len(batch)):
                    row = batch.slice(i, 1).to_pylist()[0]
                    if out is None:
                        name = f"{uuid.uuid4().hex}.warc.gz"
                        out = files.open_output_stream(f"{base}/{name}", compression=None)
                        about = b"software: voxframe\r\nformat: WARC File Format 1.1\r\n"
                        info = [("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<{uuid.uuid4().urn}>"), ("WARC-Date", date),
                                ("Content-Type", "application/warc-fields"), ("Content-Length", len(about))]
                        start = gzip.compress(_head(info) + about + b"\r\n\r\n", LEVEL, mtime=0)
                        out.write(start)
                        at = len(start)
                    whole, url, kind = record(row, space, min_bytes, date)
                    member = gzip.compress(whole, LEVEL, mtime=0)
                    out.write(member)
                    made.append((f"{folder}/{name}", at, len(member), url, row["digest"], kind, row["page_id"]))
                    at += len(member)
                    if at >= file_bytes:
                        out.close()
                        out = None
                columns = zip(*made) if made else [[]] * len(names)
                arrays = [pa.array(c, type=t) for c, t in zip(columns, types)]
                yield pa.RecordBatch.from_arrays([arrays[0], arrays[1], arrays[2], arrays[3].cast(pa.string()), *arrays[4:]], names)
        finally:
            if out is not None:
                out.close()

    return cut(rows.withColumn("url", F.col("url").cast("binary")).mapInArrow(apply, INDEX_SCHEMA))


def ranges(places: list[tuple[int, int]], gap: int = GAP_BYTES, most: int = READ_BYTES) -> Iterator[tuple[int, int, list[int]]]:
    """(start, end, numbers of places) of each read for sorted (offset, length): near ranges are one read of at most `most` bytes."""
    start = end = None
    held: list[int] = []
    for n, (offset, length) in enumerate(places):
        if held and (offset - end > gap or offset + length - start > most):
            yield start, end, held
            held = []
        if not held:
            start, end = offset, offset
        end = max(end, offset + length)
        held.append(n)
    if held:
        yield start, end, held


def read_records(index: DataFrame, gap: int = GAP_BYTES, read_bytes: int = READ_BYTES) -> DataFrame:
    """The records that `index` names, as they stand in the archives (see RECORD_SCHEMA); a revisit has an empty payload.

    Index rows may be any selection; each is read once for every time it is listed. Memory of a task: one read,
    and the payloads of one batch.
    """
    total = index.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]
    tasks = total // max(SLICE_BYTES, total // MOST_SLICES) + 1
    wanted = index.select("file", "offset", "length").repartitionByRange(tasks, "file", "offset").sortWithinPartitions("file", "offset")
    names = [c.split(" ")[0] for c in RECORD_SCHEMA.split(", ")]
    types = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.binary()]

    def fields(file: str, offset: int, data: bytes) -> tuple:
        headers, block = parse(data)
        text = lambda k: headers[k].decode("utf-8", "replace") if k in headers else None
        number = lambda k: int(headers[k]) if k in headers else None
        payload = block.partition(b"\r\n\r\n")[2]
        return (file, offset, text("warc-record-id"), text("warc-type"), number("x-page-id"), text("warc-target-uri"),
                text("warc-payload-digest").removeprefix("sha256:"), text("warc-refers-to"), number("x-refers-to-page-id"), payload)

    def batch_of(made: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(zip(*made), types)], names)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened, source = None, None
        made, held = [], 0
        try:
            for batch in batches:
                file, offset, length = (batch.column(i).to_pylist() for i in range(3))
                edges = [i for i in range(len(file)) if not i or file[i] != file[i - 1]] + [len(file)]
                for first, stop in zip(edges, edges[1:]):
                    if file[first] != opened:
                        if source is not None:
                            source.close()
                        files, path = shared_files(file[first])
                        opened, source = file[first], files.open_input_file(path)
                    for start, end, numbers in ranges(list(zip(offset[first:stop], length[first:stop])), gap, read_bytes):
                        data = source.read_at(end - start, start)
                        for n in numbers:
                            at = offset[first + n] - start
                            made.append(fields(opened, offset[first + n], gzip.decompress(data[at:at + length[first + n]])))
                            held += len(made[-1][-1])
                            if held > BATCH_BYTES:
                                yield batch_of(made)
                                made, held = [], 0
            if made:
                yield batch_of(made)
        finally:
            if source is not None:
                source.close()

    return wanted.mapInArrow(apply, RECORD_SCHEMA)


def archive(
    pages: DataFrame, folder: str | None = None, min_bytes: int = MIN_BYTES, page_id: str = "page_id", url: str = "url", html: str = "html"
) -> DataFrame:
    """Write all pages to archives below `folder` (a new one in the shared scratch folder if not given); returns the index."""
    folder = folder or f"{scratch(pages.sparkSession)}/warc-{uuid.uuid4().hex}"
    return write_archives(classified(pages, page_id, url, html, min_bytes), folder, min_bytes)


def digest(pages: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of every page, as read back from the archives.

    NULL html is an empty payload; a NULL page_id stays NULL and never comes before another in a group; a NULL url is
    left out of the record. Repeated rows are records of their own: one is the response, the others revisit it. A
    revisit's bytes and digest are those of the payload that the archives hold for the record it refers to. No rows for an empty table.
    """
    got = read_records(archive(pages))
    read = cut(got.select("record_id", "record_type", "page_id", "refers_id", "refers_to", F.octet_length("payload").cast("long").alias(
        "payload_bytes"), F.sha2("payload", 256).alias("payload_digest")))
    shown = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    responses = read.where("record_type = 'response'")
    salted = read.where("record_type = 'revisit'").withColumn("salt", F.pmod(F.xxhash64("record_id"), F.lit(SALTS)))
    wanted = salted.select("refers_id", "salt").distinct()
    target = responses.select(F.col("record_id").alias("refers_id"), "payload_bytes", "payload_digest")
    revisits = salted.drop("payload_bytes", "payload_digest").join(wanted.join(target, "refers_id"), ["refers_id", "salt"])
    return responses.select(shown).unionByName(revisits.select(shown))
