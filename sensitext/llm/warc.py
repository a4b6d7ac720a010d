"""A deterministic sharded WARC writer, and its reader.

Records are dealt to shards by ranges of page_id with about equal payload bytes: the ranges are cut from exact
byte counts of ``cells`` equal id ranges, so they do not depend on sampling, tasks or partitions. Within a shard,
records are sorted by page_id; a file is closed once its compressed size passes ``roll_bytes``, and each record is a gzip
member without a time stamp. Equal input therefore gives equal files.

Of records with equal payloads of at least ``least_revisit`` bytes, the one with the smallest page_id is written in
full and the others as revisits of it. Which one that is, is decided on digests alone; the decisions then travel with
the pages to their shards, so payloads are shuffled once.

Headers and digests are made anew from the payload. A task writes under a temporary name of its own attempt; the names of
successful attempts form a manifest (a Spark table, so a lost or repeated task leaves no trace in it), a second pass
renames its files, and readers open only what the manifest lists.

Defined results: a null html is an empty payload; a null url writes no target; rows without page_id sort first in
the first shard and read back as null. Of rows with one page_id and payload the first is the record, the others
revisit it. An empty table gives an empty archive. Other columns are ignored.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import posixpath
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote, unquote

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..settings import cut_lineage


@dataclass(frozen=True)
class Layout:
    """Payload bytes of a shard before compression, compressed bytes after which a file ends, and id ranges counted."""

    shard_bytes: int = 32 << 20
    roll_bytes: int = 8 << 20
    cells: int = 4096
    least_revisit: int = 100
    date: str = "1970-01-01T00:00:00Z"


_REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def record_id(page_id: int | None, digest: str) -> str:
    return f"urn:uuid:{uuid.UUID(bytes=hashlib.sha256(f'{page_id} {digest}'.encode()).digest()[:16])}"


def make_record(page_id: int | None, url: str | None, payload: bytes, digest: str, kind: str, first: int | None, date: str) -> bytes:
    """One WARC record, headers regenerated: a response, or a revisit of page ``first`` without the payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + payload if kind == "response" else http
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{record_id(page_id, digest)}>", f"WARC-Date: {date}"]
    if page_id is not None:
        lines.append(f"Page-ID: {page_id}")
    if url is not None:  # control characters and blanks would break the header
        lines.append("WARC-Target-URI: " + quote(url, safe="!#$&'()*+,/:;=?@[]~"))
    lines += [f"WARC-Payload-Digest: sha256:{digest}", f"Payload-Length: {len(payload)}"]
    lines.append(f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}")
    if kind == "revisit":
        lines += [f"WARC-Profile: {_REVISIT}", f"WARC-Refers-To: <{record_id(first, digest)}>"]
        if first is not None:
            lines.append(f"Refers-To-Page: {first}")
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def compress(record: bytes) -> bytes:
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)  # gzip, and zlib writes no time
    return packer.compress(record) + packer.flush()


def records(stream: io.BufferedIOBase) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of every record of an uncompressed stream; the block's digest must agree."""
    while True:
        line = stream.readline()
        if not line:
            return
        if line != b"WARC/1.1\r\n":
            raise ValueError(f"no WARC record begins with {line[:40]!r}")
        headers = {}
        while (line := stream.readline()) not in (b"\r\n", b""):
            name, _, value = line.decode().rstrip("\r\n").partition(": ")
            headers[name] = value
        block = stream.read(int(headers["Content-Length"]))
        if headers["WARC-Block-Digest"] != f"sha256:{hashlib.sha256(block).hexdigest()}" or stream.read(4) != b"\r\n\r\n":
            raise ValueError(f"record {headers['WARC-Record-ID']} is damaged")
        yield headers, block


def _shards(sizes: DataFrame, layout: Layout) -> tuple[int, int, list[int]]:
    """Smallest id, width of a cell, and each cell's shard: cells one after the other until a shard is full."""
    ends = sizes.agg(F.min("page_id").alias("lo"), F.max("page_id").alias("hi")).first()
    if ends.lo is None:
        return 0, 1, [0]
    width = (ends.hi - ends.lo) // layout.cells + 1
    cell = F.expr(f"cast((cast(page_id as decimal(20)) - {ends.lo}) div {width} as int)")
    counted = sizes.filter("page_id is not null").groupBy(cell.alias("cell")).agg(F.sum("payload_bytes").alias("size")).collect()
    bytes_of = {r.cell: r.size + 1 for r in counted}
    shard, held, out = 0, 0, []
    for c in range((ends.hi - ends.lo) // width + 1):
        if held >= layout.shard_bytes:
            shard, held = shard + 1, 0
        held += bytes_of.get(c, 0)
        out.append(shard)
    return ends.lo, width, out


def qualified(spark, folder: str) -> str:
    """The folder with its scheme, as tasks need it."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    whole = path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()
    return "file://" + whole[5:] if whole.startswith("file:/") and not whole.startswith("file://") else whole


_MANIFEST = "shard int, part int, temporary string, file string, records long, bytes long, sha256 string"


def write_warc(pages: DataFrame, folder: str, layout: Layout = Layout()) -> DataFrame:
    """Writes page_id, url and html of ``pages`` to ``folder``; returns the manifest of finished files."""
    spark = pages.sparkSession
    folder = qualified(spark, folder)
    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.encode(F.coalesce("html", F.lit("")), "utf-8").alias("payload"))
    facts = rows.select("page_id", F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("digest"))
    facts = cut_lineage(facts, "payloads")
    lo, width, shard_of = _shards(facts, layout)

    long_ = facts.filter(F.col("payload_bytes") >= layout.least_revisit)
    groups = long_.groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("many")).filter("many > 1")
    decisions = long_.join(groups, "digest").select(
        "page_id", F.lit(0).alias("kind"), F.lit(None).cast("string").alias("url"), F.lit(None).cast("binary").alias("payload"), "digest", "first"
    )
    none = F.lit(None).cast("long")
    content = rows.select("page_id", F.lit(1).alias("kind"), "url", "payload", F.lit(None).cast("string").alias("digest"), none.alias("first"))
    cell = F.expr(f"cast((cast(page_id as decimal(20)) - {lo}) div {width} as int)")
    shard = F.coalesce(F.element_at(F.lit(shard_of), cell + 1), F.lit(0)).alias("shard")
    sent = decisions.union(content).withColumn("shard", shard)
    ordered = sent.repartition(max(shard_of) + 1, "shard").sortWithinPartitions("shard", "page_id", "kind", "url", "payload")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = _Files(folder, layout, f"{TaskContext.get().partitionId()}-{uuid.uuid4().hex}")
        page, firsts, seen = (None, None), {}, set()
        for batch in batches:
            for shard, page_id, kind, url, payload, digest, first in zip(
                *(batch.column(c).to_pylist() for c in ("shard", "page_id", "kind", "url", "payload", "digest", "first"))
            ):
                if (shard, page_id) != page:
                    page, firsts, seen = (shard, page_id), {}, set()
                if kind == 0:
                    firsts[digest] = first
                    continue
                digest = hashlib.sha256(payload).hexdigest()
                own = digest not in firsts or (firsts[digest] == page_id and digest not in seen)
                seen.add(digest)
                out.add(shard, make_record(page_id, url, payload, digest, "response" if own else "revisit", firsts.get(digest), layout.date))
            yield from out.finished()
        out.close()
        yield from out.finished()

    written = cut_lineage(ordered.mapInArrow(run, _MANIFEST), "warc-written")

    def commit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for old, new in zip(*(batch.column(c).to_pylist() for c in ("temporary", "file"))):
                old, new = posixpath.join(root, old), posixpath.join(root, new)
                if system.get_file_info(old).type != fs.FileType.NotFound:  # else an earlier attempt has moved it
                    system.move(old, new)
            yield batch

    return cut_lineage(written.mapInArrow(commit, _MANIFEST).drop("temporary"), "warc-manifest")


class _Files:
    """The open file of a task; files end at a change of shard or past the roll size."""

    def __init__(self, folder: str, layout: Layout, attempt: str):
        self.system, self.root = fs.FileSystem.from_uri(folder)
        self.layout, self.attempt, self.rows, self.sink = layout, attempt, [], None
        self.shard, self.part = None, 0

    def add(self, shard: int, record: bytes) -> None:
        if shard != self.shard:
            self.close()
            self.shard, self.part = shard, 0
        if self.sink is None:
            self.temporary = f"_temporary/{self.attempt}-{shard:06d}-{self.part:05d}.warc.gz"
            self.system.create_dir(posixpath.join(self.root, "_temporary"), recursive=True)
            self.sink = self.system.open_output_stream(posixpath.join(self.root, self.temporary), compression=None)
            self.size, self.count, self.digest = 0, 0, hashlib.sha256()
        packed = compress(record)
        self.sink.write(packed)
        self.digest.update(packed)
        self.size, self.count = self.size + len(packed), self.count + 1
        if self.size >= self.layout.roll_bytes:
            self.close()

    def close(self) -> None:
        if self.sink is not None:
            self.sink.close()
            self.sink = None
            name = f"pages-{self.shard:06d}-{self.part:05d}.warc.gz"
            self.rows.append((self.shard, self.part, self.temporary, name, self.count, self.size, self.digest.hexdigest()))
            self.part += 1

    def finished(self) -> Iterator[pa.RecordBatch]:
        if self.rows:
            names = [f.split()[0] for f in _MANIFEST.split(", ")]
            kinds = [pa.int32(), pa.int32(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*self.rows), kinds)], names=names)
            self.rows = []


_READ = "page_id long, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long"


def read_warc(manifest: DataFrame, folder: str, with_payload: bool = True) -> DataFrame:
    """The records of the files that the manifest lists. Digests of files, blocks and payloads must agree.

    The payload of a revisit is null; its length and digest are those of the full payload."""
    folder = qualified(manifest.sparkSession, folder)
    kinds = [pa.int64(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.string(), pa.int64()]
    names = [f.split()[0] for f in _READ.split(", ")]

    def read(name: str, sha256: str) -> Iterator[tuple]:
        system, root = fs.FileSystem.from_uri(folder)
        with system.open_input_stream(posixpath.join(root, name), compression=None) as file:
            data = file.read()
        if hashlib.sha256(data).hexdigest() != sha256:
            raise ValueError(f"{name} is not the file of the manifest")
        for headers, block in records(gzip.GzipFile(fileobj=io.BytesIO(data))):
            digest = headers["WARC-Payload-Digest"].removeprefix("sha256:")
            size, payload = int(headers["Payload-Length"]), None
            if headers["WARC-Type"] == "response":
                payload = block.partition(b"\r\n\r\n")[2]
                if len(payload) != size or hashlib.sha256(payload).hexdigest() != digest:
                    raise ValueError(f"payload of {headers['WARC-Record-ID']} is damaged")
            page, first, url = (headers.get(n) for n in ("Page-ID", "Refers-To-Page", "WARC-Target-URI"))
            yield (
                int(page) if page else None, unquote(url) if url is not None else None, payload if with_payload else None, size, digest,
                headers["WARC-Type"], int(first) if first else None,
            )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, sha256 in zip(batch.column("file").to_pylist(), batch.column("sha256").to_pylist()):
                held, size = [], 0
                for row in read(name, sha256):
                    held.append(row)
                    size += len(row[2] or b"") + 200
                    if size > 4 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held), kinds)], names=names)
                        held, size = [], 0
                if held:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held), kinds)], names=names)

    return manifest.select("file", "sha256").repartition("file").mapInArrow(run, _READ)
