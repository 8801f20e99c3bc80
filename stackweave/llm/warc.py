"""WARC archives with a two-level capture index.

Writing: each task writes its pages as gzip members into an archive of its own in the shared folder. Of equal payloads the
smallest page_id is a response and the others are revisits that name it. Where each record lies goes into the index:
captures are range-partitioned and sorted by reversed-host URL key, cut into blocks of ``BLOCK`` lines, each compressed by
itself; a directory beside each part keeps the first key and the place of every block; the parts' first keys (one for
each partition) are the top level.

Reading: captures are looked up in sorted order: binary search over the parts, then over a part's directory, then one
range read of a block; what it names is read from the archives by range, in the order of the files.

Files get a new name for each attempt of a task and are found through the rows of the attempt that counted, so lost and
repeated tasks leave at most unread files.

Defined results: a null html is an empty payload; a null url is an empty one; white space and control characters of a URL
are escaped in the index and become single spaces in the record; a null page_id counts as the smallest, and its revisits
refer to null; equal rows are records of their own, the first of equal page_ids being the response as well; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import uuid
import zlib
from bisect import bisect_right
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, scratch_path, slices

BLOCK = 256  # lines of a compressed index block
MIN_REVISIT_BYTES = 0  # smaller payloads are always responses
SALTS = 48
DATE = "2026-01-01T00:00:00Z"
NONE = -(1 << 63)
SPACES = re.compile(r"[\x00-\x20\x7F\x85\xA0\u2028\u2029]+")


def sort_key(url: Column, page_id: Column) -> Column:
    """Reversed host, then the rest of the URL, then the page: com,example,www)/path?query page.

    Index lines are cut at line ends and tabs, so white space and control characters of the whole key are escaped; URLs
    that differ in these alone share a key, under which each has a line of its own."""
    whole = F.lower(F.coalesce(url, F.lit("")))
    host = F.regexp_extract(whole, r"^(?:[a-z][a-z0-9+.-]*://)?(?:[^/@?#]*@)?([^/?#]*)", 1)
    rest = F.regexp_replace(whole, r"^(?:[a-z][a-z0-9+.-]*://)?[^/?#]*", "")
    place = F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(")"), rest)
    return F.concat(F.regexp_replace(place, r"[\x00-\x20\x7F\x{85}\x{A0}\x{2028}\x{2029}]", "%20"), F.lit(" "), F.lpad(F.coalesce(page_id.cast("string"), F.lit("-")), 20, "0"))


def record(kind: str, url: str, page_id: int | None, payload: bytes, digest: str, refers: int | None) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + (payload if kind == "response" else b"")
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id} {url}')}>", f"WARC-Date: {DATE}", f"WARC-Target-URI: {url}", f"WARC-Payload-Digest: sha1:{digest}", f"X-Page-ID: {'' if page_id is None else page_id}"]
    if kind == "revisit":
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"X-Refers-To-Page-ID: {'' if refers is None else refers}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(head).encode() + block + b"\r\n\r\n"


def parse(raw: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """WARC headers, HTTP headers and body of a record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, body = block.partition(b"\r\n\r\n")
    return fields, dict(x.split(": ", 1) for x in http.decode().split("\r\n")[1:]), body


def sha1_base32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def decided(pages: DataFrame, min_bytes: int) -> DataFrame:
    """page_id, url, payload (text), refers_to, revisit. Keys are salted, so that copies of one payload are spread."""
    payload = F.coalesce("html", F.lit(""))
    key = F.sha2(payload, 256)
    salt = F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int")
    ready = pages.select("page_id", F.coalesce("url", F.lit("")).alias("url"), payload.alias("payload"), key.alias("key"), salt.alias("salt"), sort_key(F.col("url"), F.col("page_id")).alias("sort_key"))
    first = F.min(F.struct(F.coalesce("page_id", F.lit(NONE)).alias("id"), "sort_key")).alias("first")
    merged = ready.groupBy("key").agg(first, F.bit_or(F.expr("shiftleft(1L, salt)")).alias("mask"))
    held = F.filter(F.sequence(F.lit(0), F.lit(SALTS - 1)), lambda s: F.call_function("getbit", F.col("mask"), s) == 1)
    side = merged.select("key", F.col("first.id").alias("first_id"), F.explode(held).alias("salt"))
    small = F.octet_length("payload") < min_bytes
    revisit = (F.coalesce("page_id", F.lit(NONE)) != F.col("first_id")) & ~small
    refers = F.when(revisit & (F.col("first_id") != NONE), F.col("first_id"))
    return ready.join(side, ["key", "salt"]).select("page_id", "url", "payload", "sort_key", refers.alias("refers_to"), revisit.alias("revisit"))


PLACES = "sort_key string, file string, offset bigint, length bigint"


def write_archives(pages: DataFrame, folder: str, min_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """Writes the records; one row for each with its place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(folder)
        fs.create_dir(root, recursive=True)
        out, name, at = None, f"{uuid.uuid4().hex}.warc.gz", 0
        for whole in batches:
            for batch in slices(whole, 512):
                rows = []
                for page_id, url, payload, key, refers, revisit in zip(*(batch.column(k).to_pylist() for k in range(6))):
                    data = payload.encode()
                    one = gzip.compress(record("revisit" if revisit else "response", SPACES.sub(" ", url).strip(" "), page_id, data, sha1_base32(data), refers), 3, mtime=0)
                    out = out or fs.open_output_stream(f"{root}/{name}", compression=None)
                    out.write(one)
                    rows.append((key, name, at, len(one)))
                    at += len(one)
                if rows:
                    yield pa.RecordBatch.from_arrays(list(map(pa.array, zip(*rows))), names=["sort_key", "file", "offset", "length"])
        if out:
            out.close()

    return materialize(decided(pages, min_bytes).select("page_id", "url", "payload", "sort_key", "refers_to", "revisit").mapInArrow(run, PLACES), "warc-places")


def write_index(places: DataFrame, folder: str, block: int = BLOCK) -> list[tuple[str, str]]:
    """Writes the index; its top level: the first key and the name of every part, sorted (one for each partition)."""
    n = int(places.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(folder)
        fs.create_dir(root, recursive=True)
        name, out, at, directory, held = uuid.uuid4().hex, None, 0, [], []

        def flush() -> None:
            nonlocal out, at
            data = zlib.compress("\n".join(held).encode(), 6)
            out = out or fs.open_output_stream(f"{root}/{name}.idx", compression=None)
            out.write(data)
            directory.append(f"{held[0].split(chr(9))[0]}\t{at}\t{len(data)}")
            at += len(data)
            held.clear()

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                line = "\t".join(map(str, row))
                # records of one key stay in one block
                if len(held) >= block and held[-1].split("\t", 1)[0] != row[0]:
                    flush()
                held.append(line)
        if held:
            flush()
        if out:
            out.close()
            with fs.open_output_stream(f"{root}/{name}.dir", compression=None) as d:
                d.write("\n".join(directory).encode())
            yield pa.RecordBatch.from_pydict({"first": [directory[0].split("\t")[0]], "part": [name]})

    ordered = places.select("sort_key", "file", "offset", "length").repartitionByRange(n, "sort_key").sortWithinPartitions("sort_key", "file", "offset")
    parts = materialize(ordered.mapInArrow(run, "first string, part string"), "warc-parts")
    return sorted(map(tuple, parts.toLocalIterator()))


class Index:
    """Lookups in the order of their keys: it holds one part's directory and one block at a time."""

    def __init__(self, folder: str, parts: list[tuple[str, str]]):
        self.fs, self.root = pafs.FileSystem.from_uri(folder)
        self.parts, self.firsts = parts, [p[0] for p in parts]
        self.part = self.at = None
        self.directory: list[list[str]] = []
        self.keys: list[str] = []
        self.lines: dict[str, list[tuple[str, int, int]]] = {}

    def find(self, key: str) -> list[tuple[str, int, int]]:
        part = bisect_right(self.firsts, key) - 1
        if part < 0:
            return []
        if part != self.part:
            with self.fs.open_input_file(f"{self.root}/{self.parts[part][1]}.dir") as f:
                self.directory = [x.split("\t") for x in f.read().decode().split("\n")]
            self.keys, self.part, self.at = [x[0] for x in self.directory], part, None
        at = bisect_right(self.keys, key) - 1
        if at < 0:
            return []
        if at != self.at:
            _, offset, length = self.directory[at]
            with self.fs.open_input_file(f"{self.root}/{self.parts[part][1]}.idx") as f:
                f.seek(int(offset))
                lines = zlib.decompress(f.read(int(length))).decode().split("\n")
            self.lines, self.at = defaultdict(list), at
            for line in lines:
                k, file, start, size = line.split("\t")
                self.lines[k].append((file, int(start), int(size)))
        return self.lines.get(key, [])


CAPTURES = "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint"
CAPTURES_SCHEMA = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])


def read_captures(wanted: DataFrame, folder: str, parts: list[tuple[str, str]]) -> DataFrame:
    """Looks up sort keys (column sort_key) and reads every record of them back from the archives."""
    spark = wanted.sparkSession
    top = spark.sparkContext.broadcast(parts)  # a row for each index partition
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(folder, top.value)
        for whole in batches:
            for batch in slices(whole, 2048):
                places = sorted(p for key in batch.column(0).to_pylist() for p in index.find(key))
                rows, held, file = [], None, None
                for name, offset, length in places:
                    if name != held:
                        if file:
                            file.close()
                        held, file = name, index.fs.open_input_file(f"{index.root}/{name}")
                    file.seek(offset)
                    warc, http, body = parse(gzip.decompress(file.read(length)))
                    kind, stated = warc["WARC-Type"], warc["WARC-Payload-Digest"].removeprefix("sha1:")
                    if kind == "response" and sha1_base32(body) != stated:
                        raise ValueError(f"payload of page {warc['X-Page-ID']} does not match its digest")
                    number = lambda x: int(x) if x else None
                    rows.append((number(warc["X-Page-ID"]), int(http["Content-Length"]), stated, kind, number(warc.get("X-Refers-To-Page-ID"))))
                if file:
                    file.close()
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows), CAPTURES_SCHEMA)], schema=CAPTURES_SCHEMA)

    keys = wanted.select("sort_key").distinct().repartitionByRange(n, "sort_key").sortWithinPartitions("sort_key")
    return keys.mapInArrow(run, CAPTURES)


def archive_and_read(pages: DataFrame, *, folder: str | None = None, min_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """Writes archives and index, then looks every page up and reads it back."""
    folder = folder or scratch_path(pages.sparkSession, "warc")
    parts = write_index(write_archives(pages, folder, min_bytes), folder)
    return read_captures(pages.select(sort_key(F.col("url"), F.col("page_id")).alias("sort_key")), folder, parts)
