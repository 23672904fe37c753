"""WARC archives with a two-level capture index.

``write_archives`` puts every page into gzip-per-record WARC segments in the shared folder. ``build_index`` sorts the
captures by reversed-host URL key and writes index files: compressed blocks of ``BLOCK`` captures, then a sparse directory
of the blocks (first key, offset, size), then the directory's place. ``lookup`` binary-searches the
files' key ranges and the directory of each file found, reads and searches the blocks, and ``read_records``
reads exactly the byte ranges of the captures found.

Files are opened through ``pyarrow.fs`` by URI, so the folder can be on any store that it knows. A task that is run twice
writes files under new names; only those named in the committed capture table are ever read.

Defined results: null html is an empty payload; a null url has the empty key and a ``urn:`` target; of equal payloads of
at least ``MIN_REVISIT`` bytes the largest page_id is the response (rows repeated under that id: all of them) and the
others revisit it; an empty table gives no records; extra columns are ignored.
"""

from __future__ import annotations

import bisect
import gzip
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.llm.common import materialize, pick, scratch_path

MIN_REVISIT = 1000
SEGMENT_BYTES = 32 << 20
BLOCK = 1024
_DATE = "2024-01-01T00:00:00Z"
CAPTURES = "page_id long, key string, file string, at long, size long"
_TAIL = 16


def url_key(url: Column) -> Column:
    """``http://a.b.com/x?y`` -> ``com,b,a)/x?y``: lower-cased host reversed, scheme dropped; null is the empty key."""
    rest = F.regexp_replace(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    return F.when(url.isNull(), F.lit("")).otherwise(F.concat(F.array_join(F.reverse(F.split(F.lower(host), r"\.")), ","), F.lit(")"), F.substr(rest, F.length(host) + 1)))


def _open(uri: str, mode: str):
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(uri)
    if mode == "r":
        return store.open_input_file(path)
    store.create_dir(path.rsplit("/", 1)[0], recursive=True)
    return store.open_output_stream(path, compression=None)


def _record(page_id: int, url: str | None, body: bytes, digest: str, refers_to: int | None) -> bytes:
    target = "".join(c if c > " " else f"%{ord(c):02X}" for c in url) if url is not None else f"urn:page:{page_id}"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(body)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + body
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <urn:page:{page_id}>",
        f"WARC-Date: {_DATE}",
        f"WARC-Target-URI: {target}",
        f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if refers_to is not None:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def write_archives(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Write the archives; the capture table (page_id, key, file, at, size), committed before it is returned."""
    folder = folder or scratch_path(pages.sparkSession, "warc")
    pages = pick(pages, ["page_id", "url", "html"])
    payload = F.coalesce(F.col("html"), F.lit(""))
    digested = pages.select("page_id", F.sha1(payload.cast("binary")).alias("digest"), F.octet_length(payload).alias("bytes"))
    first = (
        digested.filter(F.col("bytes") >= MIN_REVISIT).groupBy("digest", "bytes")
        .agg(F.max("page_id").alias("original"), F.count("*").alias("n")).filter("n > 1").select("digest", "bytes", "original")
    )
    full = pages.select("page_id", "url", "html", url_key(F.col("url")).alias("key"), F.sha1(payload.cast("binary")).alias("digest"), F.octet_length(payload).alias("bytes"))
    marked = full.join(first, ["digest", "bytes"], "left").select("page_id", "url", "key", "html", "digest", F.when(F.col("page_id") < F.col("original"), F.col("original")).alias("refers_to"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, name, at = None, "", 0
        for batch in batches:
            rows = []
            for page_id, url, key, html, digest, refers_to in zip(*(c.to_pylist() for c in batch.columns)):
                if out is None or at >= SEGMENT_BYTES:
                    if out is not None:
                        out.close()
                    name, at = f"{folder}/{uuid.uuid4().hex}.warc.gz", 0
                    out = _open(name, "w")
                data = gzip.compress(_record(page_id, url, (html or "").encode(), digest, refers_to), 4, mtime=0)
                out.write(data)
                rows.append((page_id, key, name, at, len(data)))
                at += len(data)
            if rows:
                yield _captures([(key, page_id, *rest) for page_id, key, *rest in rows])
        if out is not None:
            out.close()

    return materialize(marked.mapInArrow(run, CAPTURES), "captures")


def build_index(captures: DataFrame, folder: str | None = None, block: int = BLOCK) -> DataFrame:
    """Write the index files; their list (file, first_key, last_key, directory_at, captures), one row per file.

    Range partitioning by (key, page_id) splits a key that holds many captures over several files.
    """
    spark = captures.sparkSession
    folder = folder or scratch_path(spark, "cdx")
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = captures.repartitionByRange(partitions, "key", "page_id").sortWithinPartitions("key", "page_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, name, directory, pending, at, last, count = None, "", [], [], 0, "", 0

        def flush():
            nonlocal at
            data = zlib.compress(json.dumps(pending).encode(), 4)
            out.write(data)
            directory.append((pending[0][0], at, len(data)))
            at += len(data)
            pending.clear()

        for batch in batches:
            for page_id, key, file, offset, size in zip(*(batch.column(c).to_pylist() for c in ("page_id", "key", "file", "at", "size"))):
                if out is None:
                    name = f"{folder}/{uuid.uuid4().hex}.cdx"
                    out = _open(name, "w")
                pending.append((key, page_id, file, offset, size))
                last, count = key, count + 1
                if len(pending) == block:
                    flush()
        if out is not None:
            if pending:
                flush()
            tail = zlib.compress(json.dumps(directory).encode(), 4)
            out.write(tail + at.to_bytes(8, "big") + len(tail).to_bytes(8, "big"))
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (name, directory[0][0], last, at, count)], ["file", "first_key", "last_key", "directory_at", "captures"])

    return materialize(ordered.mapInArrow(run, "file string, first_key string, last_key string, directory_at long, captures long"), "cdx-files")


def _route(keys: DataFrame, index: DataFrame) -> DataFrame:
    """(key, cdx): each key with the index files whose key range holds it.

    Files follow one another in key order, so a task finds the first one by binary search in the sorted ranges and goes on
    while ranges still hold the key. The list has one row per index file (a few hundred thousand captures each at production
    size); it goes to the tasks in blocks of at most ``MAX_FILES`` rows, one pass over the keys each.
    """
    context, files = keys.sparkSession.sparkContext, index.select("first_key", "last_key", "file")
    blocks = -(-index.count() // MAX_FILES) or 1
    out = None
    for b in range(blocks):
        part = files.filter(F.pmod(F.xxhash64("file"), F.lit(blocks)) == b) if blocks > 1 else files
        # Ordered by the last key: the first file that can hold a key is the first whose last key isn't before it.
        known = context.broadcast(sorted((r["last_key"], r["first_key"], r["file"]) for r in part.collect()))

        def run(batches: Iterator[pa.RecordBatch], known=known) -> Iterator[pa.RecordBatch]:
            ranges = known.value
            for batch in batches:
                rows = []
                for key in batch.column(0).to_pylist():
                    at = bisect.bisect_left(ranges, (key,))
                    while at < len(ranges) and ranges[at][1] <= key:
                        rows.append((key, ranges[at][2]))
                        at += 1
                yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in rows], pa.string()), pa.array([f for _, f in rows], pa.string())], ["key", "cdx"])

        found = keys.mapInArrow(run, "key string, cdx string")
        out = found if out is None else out.union(found)
    return out


def lookup(index: DataFrame, keys: DataFrame) -> DataFrame:
    """The captures of each of ``keys`` (key): a binary search for the index file, one in its directory, then block reads."""
    routed = _route(keys.select("key").filter("key IS NOT NULL").distinct(), index)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, source, directory, firsts, held_at, held_block = "", None, [], [], -1, []
        for batch in batches:
            rows = []
            for key, cdx in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if cdx != name:
                    if source is not None:
                        source.close()
                    name, source, held_at = cdx, _open(cdx, "r"), -1
                    end = source.size()
                    tail = source.read_at(_TAIL, end - _TAIL)
                    where, size = int.from_bytes(tail[:8], "big"), int.from_bytes(tail[8:], "big")
                    directory = json.loads(zlib.decompress(source.read_at(size, where)))
                    firsts = [d[0] for d in directory]
                k = max(0, bisect.bisect_left(firsts, key) - 1)
                while k < len(directory) and firsts[k] <= key:
                    if k != held_at:
                        held_block, held_at = json.loads(zlib.decompress(source.read_at(directory[k][2], directory[k][1]))), k
                    i = bisect.bisect_left(held_block, [key])
                    while i < len(held_block) and held_block[i][0] == key:
                        rows.append(held_block[i])
                        i += 1
                    k += 1
                    if len(rows) >= 10_000:  # a block at most above that, however many captures a key has
                        yield _captures(rows)
                        rows = []
            if rows:
                yield _captures(rows)
        if source is not None:
            source.close()

    # By number, so that light rows aren't put together: a task's work is the blocks that it reads.
    return routed.repartition(_tasks(routed), "cdx").sortWithinPartitions("cdx", "key").mapInArrow(run, CAPTURES)


MAX_FILES = 50_000


def _tasks(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def _captures(rows: list) -> pa.RecordBatch:
    key, page_id, file, at, size = (pa.array(c, t) for c, t in zip(zip(*rows), (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64())))
    return pa.RecordBatch.from_arrays([page_id, key, file, at, size], ["page_id", "key", "file", "at", "size"])


def parse_record(data: bytes) -> dict:
    """The fields of one gzip member."""
    head, block = gzip.decompress(data).split(b"\r\n\r\n", 1)
    fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    block = block[: int(fields["Content-Length"])]
    http, body = block.split(b"\r\n\r\n", 1)
    length = int(http.rsplit(b"Content-Length: ", 1)[1].split(b"\r\n")[0])
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    if fields["WARC-Type"] == "response" and (len(body) != length or hashlib.sha1(body).hexdigest() != digest):
        raise ValueError(f"payload of {fields['WARC-Record-ID']} is damaged")
    number = lambda x: None if (n := x.rsplit(":", 1)[1].rstrip(">")) == "None" else int(n)
    return {
        "page_id": number(fields["WARC-Record-ID"]),
        "target": fields["WARC-Target-URI"],
        "record_type": fields["WARC-Type"],
        "payload_bytes": length,
        "payload_digest": digest,
        "refers_to": number(fields["WARC-Refers-To"]) if "WARC-Refers-To" in fields else None,
        "payload": body.decode() if fields["WARC-Type"] == "response" else None,
    }


_FIELDS = {"page_id": pa.int64(), "target": pa.string(), "record_type": pa.string(), "payload_bytes": pa.int64(), "payload_digest": pa.string(), "refers_to": pa.int64(), "payload": pa.string()}


def read_records(captures: DataFrame, payload: bool = True) -> DataFrame:
    """The records at the captures' byte ranges, with their payload unless ``payload`` is false. A segment's captures are read in order of offset."""
    names = [n for n in _FIELDS if payload or n != "payload"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, source = "", None
        for batch in batches:
            for i in range(0, batch.num_rows, 500):
                rows = []
                for file, at, size in zip(*(batch.column(c).to_pylist()[i : i + 500] for c in ("file", "at", "size"))):
                    if file != name:
                        if source is not None:
                            source.close()
                        name, source = file, _open(file, "r")
                    rows.append(parse_record(source.read_at(size, at)))
                yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], _FIELDS[n]) for n in names], names)
        if source is not None:
            source.close()

    types = {pa.int64(): "long", pa.string(): "string"}
    segment = F.floor(F.col("at") / (4 << 20))  # parts of a segment can go to different tasks
    return captures.repartition(_tasks(captures), "file", segment).sortWithinPartitions("file", "at").select("file", "at", "size").mapInArrow(run, ", ".join(f"{n} {types[_FIELDS[n]]}" for n in names))
