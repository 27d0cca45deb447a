"""WARC archives of pages, and a two-level capture index over them.

Archives: one gzip member per record, so that a record is a byte range. Equal payloads are stored once; other captures of one
are revisit records that hold the HTTP header alone.

Index: captures sorted by reversed-host URL key in shards of compressed blocks of BLOCK_LINES captures. The directory
holds the first key of each block; each shard keeps its part beside its blocks, and only the first key of each shard, whose number
is the number of shuffle partitions, goes to every task. A lookup is a binary search over shards, one over the shard's directory,
a range read of one block and a binary search inside it; then a range read of the record.

Files are written under names that hold the task attempt, and moved in place when whole; the manifest, written as a table,
names those that count. So a lost executor costs a task's work and nothing else.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.llm._store import Workspace

BLOCK_LINES = 512
FILE_BYTES = 1 << 30
DEDUP_BYTES = 1000
DATE = "1970-01-01T00:00:00Z"  # of records whose fetch time is not known

_ENTRY = "key string, page_id long, type string, file string, at long, length long"


def url_key(url: Column) -> Column:
    """com,example,www)/path?query of http://user@www.example.com:80/path?query#part; a null URL is an empty key, what is no URL goes under ~."""
    split = r"^(?i)[a-z][a-z0-9+.\-]*://(?:[^/?#@]*@)?([^/:?#]*)(?::\d*)?([^#]*)"
    host = F.lower(F.regexp_extract(url, split, 1))
    path = F.regexp_extract(url, split, 2)
    key = F.when(host == "", F.concat(F.lit("~"), url)).otherwise(F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(")"), F.when(path == "", F.lit("/")).otherwise(path)))
    return F.coalesce(F.regexp_replace(key, r"[\x00-\x20\x7f]", "_"), F.lit(""))


def _files(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


class _Sink:
    """A file of the shared folder that appears under its name only when it is whole."""

    def __init__(self, root: str, stem: str, end: str):
        task = TaskContext.get()
        self.name = f"{stem}-{task.partitionId():06d}-{task.taskAttemptId()}-{uuid.uuid4().hex[:8]}{end}"
        self.fs, self.base = _files(root)
        self.out, self.at = self.fs.open_output_stream(f"{self.base}/.{self.name}", compression=None), 0

    def write(self, data: bytes) -> tuple[int, int]:
        at = self.at
        self.out.write(data)
        self.at += len(data)
        return at, len(data)

    def close(self) -> None:
        self.out.close()
        self.fs.move(f"{self.base}/.{self.name}", f"{self.base}/{self.name}")


def _zip(data: bytes) -> bytes:
    z = zlib.compressobj(1, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def _unzip(data: bytes) -> bytes:
    return zlib.decompress(data, 31)


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, size: int, refers_to: int | None) -> bytes:
    """A response record, or a revisit of the page refers_to, not compressed.

    WARC-Target-URI has %20 for each space and unprintable character of the URL, so such URLs are not given back as they were; WARC-Date is DATE, as pages have no fetch time.
    """
    again = refers_to is not None
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    name = lambda n: f"<urn:page:{'' if n is None else n}>"
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if again else 'response'}",
        f"WARC-Record-ID: {name(page_id)}",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {''.join(c if c.isprintable() and c != ' ' else '%20' for c in url or '')}",
        f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}",
    ]
    if again:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {name(refers_to)}"]
    body = http if again else http + payload
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(body)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def parse_record(data: bytes) -> dict:
    """page_id, url, type, refers_to, payload (None in a revisit), size and digest of the full payload of one record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
    body = rest[: int(fields["Content-Length"])]
    http, _, payload = body.partition(b"\r\n\r\n")
    size = next(int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
    number = lambda s: int(s[10:-1]) if s and s[10:-1] else None
    again = fields["WARC-Type"] == "revisit"
    stated = base64.b32decode(fields["WARC-Payload-Digest"][5:]).hex()
    if not again and (len(payload) != size or hashlib.sha1(payload).hexdigest() != stated):
        raise ValueError(f"record {fields['WARC-Record-ID']} does not hold the payload that it states")
    return {"page_id": number(fields["WARC-Record-ID"]), "url": fields["WARC-Target-URI"], "type": fields["WARC-Type"], "refers_to": number(fields.get("WARC-Refers-To")), "payload": None if again else payload, "size": size, "digest": stated}


def write_archives(pages: DataFrame, work: Workspace) -> DataFrame:
    """Writes a record per row of pages (page_id, url, html) and returns the manifest: key, page_id, type, file, at, length.

    Of the rows with equal payloads of DEDUP_BYTES or more, those with the largest page_id are responses and the others
    revisit it; where no page_id is known, all are responses. A null html is an empty payload, a null url an empty one. Rows that
    repeat are captures of their own. No rows give an empty manifest. Other columns aren't read.
    """
    one = pages.select("page_id", "url", F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("payload"))
    one = one.withColumns({"digest": F.sha1("payload"), "size": F.length("payload")})
    kept = one.filter(F.col("size") >= DEDUP_BYTES).groupBy("digest").agg(F.max("page_id").alias("kept"), F.count("*").alias("n")).filter("n > 1").select("digest", "kept")
    # the join is on a key that one group of copies may dominate: a sort-merge join of plain sides, whose large partitions Spark splits
    told = one.join(kept, "digest", "left").select(
        "page_id", "url", "payload", "digest", "size", F.when(F.col("page_id").isNull() | (F.col("page_id") != F.col("kept")), F.col("kept")).alias("refers_to"), url_key(F.col("url")).alias("key")
    )
    root = work.root

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sink = None
        waiting: list[tuple] = []  # rows of a file are told once it is whole

        def rows():
            sink.close()
            out = pa.RecordBatch.from_arrays([pa.array([x[k] for x in waiting], t) for k, t in enumerate([pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64()])], ["key", "page_id", "type", "file", "at", "length"])
            waiting.clear()
            return out

        for batch in batches:
            for lo in range(0, len(batch), 64):
                for x in batch.slice(lo, 64).to_pylist():
                    if sink is None:
                        sink = _Sink(root, "archive", ".warc.gz")
                    data = _zip(record(x["page_id"], x["url"], x["payload"], x["digest"], x["size"], x["refers_to"]))
                    at, n = sink.write(data)
                    waiting.append((x["key"], x["page_id"], "response" if x["refers_to"] is None else "revisit", sink.name, at, n))
                    if sink.at >= FILE_BYTES:
                        yield rows()
                        sink = None
        if sink is not None:
            yield rows()

    return work.save(told.mapInArrow(run, _ENTRY), "manifest")


#: Sorts before every page_id.
_NONE = -(1 << 63)


def _sort_key(line: bytes) -> tuple[bytes, int]:
    key, n = line.split(b"\t", 2)[:2]
    return key, int(n) if n else _NONE


class Index:
    """The two-level index of a manifest. top: for each shard (first key, first page_id, file of blocks, file of the directory)."""

    def __init__(self, manifest: DataFrame, work: Workspace, shards: int = 0):
        spark = work.spark
        self.root, self.shards = work.root, shards or int(spark.conf.get("spark.sql.shuffle.partitions"))
        root = self.root

        def run(batches):
            blocks = sides = None
            lines: list[bytes] = []
            first = None
            side: list[bytes] = []

            def flush():
                at, n = blocks.write(_zip(b"\n".join(lines)))
                side.append(b"%s\t%d\t%d" % (b"\t".join(lines[0].split(b"\t", 2)[:2]), at, n))
                lines.clear()

            for batch in batches:
                for x in batch.to_pylist():
                    if blocks is None:
                        blocks, sides = _Sink(root, "index", ".cdx.gz"), _Sink(root, "index", ".directory")
                    line = "\t".join([x["key"], "" if x["page_id"] is None else str(x["page_id"]), x["type"], x["file"], str(x["at"]), str(x["length"])]).encode()
                    first = first or (x["key"], x["page_id"])
                    lines.append(line)
                    if len(lines) == BLOCK_LINES:
                        flush()
            if blocks is not None:
                if lines:
                    flush()
                sides.write(b"\n".join(side))
                blocks.close()
                sides.close()
                yield pa.RecordBatch.from_arrays([pa.array([first[0]]), pa.array([first[1]], pa.int64()), pa.array([blocks.name]), pa.array([sides.name]), pa.array([len(side)], pa.int64())], ["key", "page_id", "blocks", "directory", "n"])

        order = manifest.repartitionByRange(self.shards, "key", "page_id").sortWithinPartitions("key", "page_id")
        table = work.save(order.mapInArrow(run, "key string, page_id long, blocks string, directory string, n long"), "shards")
        # one row for each shard, at most self.shards of them
        self.top = sorted(((r.key.encode(), _NONE if r.page_id is None else r.page_id), r.blocks, r.directory) for r in table.collect())

    def lookup(self, keys: DataFrame) -> DataFrame:
        """The entries of each distinct (key, page_id) of keys: key, page_id, type, file, at, length. A key without any gives no row."""
        root, top = self.root, self.top

        def run(batches):
            fs, base = _files(root)
            starts = [x[0] for x in top]
            shard = -1
            directory: list[tuple[tuple[bytes, int], int, int]] = []
            firsts: list[tuple[bytes, int]] = []
            block, lines, keys = -1, [], []
            handle = None
            before = None

            def load_shard(s):
                nonlocal shard, directory, firsts, block, handle
                with fs.open_input_stream(f"{base}/{top[s][2]}", compression=None) as f:
                    rows = [x.split(b"\t") for x in f.read().split(b"\n")]
                directory = [((k, int(n) if n else _NONE), int(at), int(size)) for k, n, at, size in rows]
                firsts = [x[0] for x in directory]
                shard, block, handle = s, -1, fs.open_input_file(f"{base}/{top[s][1]}")

            def load_block(b):
                nonlocal block, lines, keys
                lines = _unzip(handle.read_at(directory[b][2], directory[b][1])).split(b"\n")
                keys = [_sort_key(x) for x in lines]
                block = b

            def find(want):
                """From the last block that begins before the key on, as equal keys may go over blocks and shards."""
                s = max(0, bisect_left(starts, want) - 1)
                while s < len(top) and starts[s] <= want:
                    if s != shard:
                        load_shard(s)
                    b = max(0, bisect_left(firsts, want) - 1)
                    while b < len(firsts) and firsts[b] <= want:
                        if b != block:
                            load_block(b)
                        for k in range(bisect_left(keys, want), bisect_right(keys, want)):
                            yield lines[k]
                        b += 1
                    s += 1

            for batch in batches:
                out = []
                for k, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    want = (k.encode(), _NONE if n is None else n)
                    if want != before:
                        out += [x.decode().split("\t") for x in find(want)]
                        before = want
                yield pa.RecordBatch.from_arrays(
                    [pa.array([x[0] for x in out], pa.string()), pa.array([int(x[1]) if x[1] else None for x in out], pa.int64()), pa.array([x[2] for x in out], pa.string()), pa.array([x[3] for x in out], pa.string()), pa.array([int(x[4]) for x in out], pa.int64()), pa.array([int(x[5]) for x in out], pa.int64())],
                    ["key", "page_id", "type", "file", "at", "length"],
                )

        order = keys.select("key", "page_id").repartitionByRange(self.shards, "key", "page_id").sortWithinPartitions("key", "page_id")
        return order.mapInArrow(run, _ENTRY)


def read_records(found: DataFrame, root: str, shards: int, payload: bool = False) -> DataFrame:
    """The record at each (file, at, length): page_id, url, record_type, refers_to, payload_bytes, payload_digest, and the payload if asked for."""
    schema = T._parse_datatype_string("page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string" + ", payload binary" * payload)
    kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
    fields = ["page_id", "url", "type", "refers_to", "size", "digest", "payload"][: 6 + payload]

    def run(batches):
        fs, base = _files(root)
        name, handle = None, None
        for batch in batches:
            for lo in range(0, len(batch), 256):
                rows = []
                for x in batch.slice(lo, 256).to_pylist():
                    if x["file"] != name:
                        name, handle = x["file"], fs.open_input_file(f"{base}/{x['file']}")
                    r = parse_record(_unzip(handle.read_at(x["length"], x["at"])))
                    rows.append([r[f] for f in fields])
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in zip(range(len(fields)), kinds)], schema.names)

    return found.select("file", "at", "length").repartitionByRange(shards, "file", "at").sortWithinPartitions("file", "at").mapInArrow(run, schema)


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    work = Workspace(spark, "warc")
    index = Index(write_archives(pages, work), work)
    keys = pages.select(url_key(F.col("url")).alias("key"), "page_id")
    return read_records(index.lookup(keys), work.root, index.shards).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP2_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, octet_length(encode(html)) AS n, sha1(html) AS h FROM p),
k AS (SELECT h, max(page_id) AS kept FROM d WHERE n >= 1000 GROUP BY h)
SELECT d.page_id, d.n::BIGINT AS payload_bytes, d.h AS payload_digest,
  CASE WHEN k.kept <> d.page_id OR (d.page_id IS NULL AND k.kept IS NOT NULL) THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN k.kept <> d.page_id OR d.page_id IS NULL THEN k.kept END AS refers_to
FROM d LEFT JOIN k ON d.h = k.h
"""
