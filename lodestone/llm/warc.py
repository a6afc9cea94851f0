"""WARC archives: a deterministic sharded writer and a streaming reader.

Records are sorted by id and payload digest and cut into shards of about ``shard_bytes`` of payload: a record's shard is the sum of the bytes before it
over shard_bytes. These sums are exact, made of each partition's own and the partitions' totals, so the same rows give the same files on any cluster,
and an id that many rows share is cut too. A shard's task streams
its records in order, one gzip member each, into files rolled at ``roll_bytes`` of compressed size. Files are written under
temporary names of the task's attempt; what the successful attempts report becomes the manifest, files are renamed by it
(again and again does no harm), and the manifest is written last. Readers follow the manifest only.

Equal payloads: the record with the smallest id is a response, the others are revisits that refer to it, so a payload that a
third of all rows share is found by an aggregation on digests and no group is gathered.

Headers are lines: a URL that no line can hold (control characters, white space at its ends) is written with these percent-encoded, and in full, as a
JSON string, in a header of its own, by which reading gives it back as it was.

Defined results: a null payload counts as empty; payloads of any length are whole; of rows repeated under one id and payload
the first is as if alone, the others revisit it; null ids come first, and revisit where another id has the payload; an empty
table gives an archive without files; other columns aren't read.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import materialize, partitions, remove

#: Fixed values of the format.
VERSION = b"WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Shards at most: their first keys are one array in every task. With more bytes than that holds, shards grow.
SHARDS = 1 << 21


def _sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(source_id: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'record:{source_id}')}>"


def record(headers: list[tuple[str, object]], block: bytes, level: int) -> bytes:
    """One record as a gzip member of its own; the length is added."""
    lines = [VERSION, *(f"{k}: {v}".encode() for k, v in [*headers, ("Content-Length", len(block))])]
    packer = zlib.compressobj(level, zlib.DEFLATED, 31)
    return packer.compress(b"\r\n".join(lines) + b"\r\n\r\n" + block + b"\r\n\r\n") + packer.flush()


def response(source_id: int | None, url: str, payload: bytes, date: str, level: int) -> bytes:
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode() + payload
    return record([
        ("WARC-Type", "response"), ("WARC-Record-ID", record_id(source_id)), ("WARC-Date", date), *uri(url),
        ("Content-Type", "application/http; msgtype=response"), ("WARC-Block-Digest", f"sha1:{_sha1(block)}"),
        ("WARC-Payload-Digest", f"sha1:{_sha1(payload)}"), ("WARC-Source-ID", source_id),
    ], block, level)


def revisit(source_id: int | None, url: str, payload: bytes, first: int | None, date: str, level: int) -> bytes:
    return record([
        ("WARC-Type", "revisit"), ("WARC-Record-ID", record_id(source_id)), ("WARC-Date", date), *uri(url),
        ("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", record_id(first)), ("WARC-Block-Digest", f"sha1:{_sha1(b'')}"),
        ("WARC-Payload-Digest", f"sha1:{_sha1(payload)}"), ("WARC-Source-ID", source_id), ("WARC-Refers-To-Source-ID", first), ("WARC-Payload-Length", len(payload)),
    ], b"", level)


def uri(url: str) -> list[tuple[str, object]]:
    """The headers of a URL."""
    safe = re.sub(r"[\x00-\x20\x7f-\x9f]|^\s+|\s+$", lambda m: quote(m[0], safe=""), url) if url != url.strip() or re.search(r"[\x00-\x1f\x7f-\x9f]", url) else url
    return [("WARC-Target-URI", safe), *([("WARC-Source-URL", json.dumps(url))] if safe != url else [])]


def cuts(rows: DataFrame, shard_bytes: int) -> list:
    """First ids of all shards but the first, for shards of about shard_bytes; the same for the same rows. rows: (id, size), ids of any type that sorts.

    Three jobs, whatever the ids: sums within partitions of the sorted ids, the partitions' totals, the least id of each shard.
    """
    kind = rows.schema["id"].dataType.simpleString()
    held = rows.where("id IS NOT NULL").groupBy("id").agg(F.sum(F.col("size").cast("long")).alias("size"))

    def running(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, before = TaskContext.get().partitionId(), 0
        for batch in batches:
            size = batch["size"].to_numpy()
            upto = np.cumsum(size) + before
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(size), part, np.int32)), batch["id"], pa.array(upto - size), batch["size"]], names=["part", "id", "before", "size"])
            before = int(upto[-1]) if len(upto) else before

    dealt = held.repartitionByRange(partitions(rows), "id").sortWithinPartitions("id")
    placed = materialize(dealt.mapInArrow(running, f"part int, id {kind}, before long, size long"), "warc_sizes")
    totals = sorted(tuple(r) for r in placed.groupBy("part").agg(F.sum("size")).collect())  # a row for each partition
    if not totals:
        return []
    offsets, total = [], 0
    for part, size in totals:
        offsets.append((part, total))
        total += size
    shard_bytes = max(shard_bytes, -(-total // SHARDS))
    after = placed.join(F.broadcast(rows.sparkSession.createDataFrame(offsets, "part int, offset long")), "part")
    found = after.groupBy(F.expr(f"(before + offset) DIV {shard_bytes}").alias("shard")).agg(F.min("id").alias("id"))
    return sorted(bytes(x) if isinstance(x, bytearray) else x for x in found.toArrow()["id"].to_pylist())[1:]


#: A record's place in the order: null ids first, then by id, then by digest. Of equal length, so that bytes sort.
_KEY = "concat(IF(id IS NULL, X'00', X'01'), unhex(lpad(hex(coalesce(id, 0) ^ (-9223372036854775807L - 1L)), 16, '0')), unhex(substring(digest, 1, 16)))"


def write(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", shard_bytes: int = 16 << 20, roll_bytes: int = 16 << 20, date: str = "1970-01-01T00:00:00Z", level: int = 6) -> DataFrame:
    """Write an archive to a folder (a URI that executors reach) and return its manifest: file, shard, part, records, bytes, sha256, first_id, last_id."""
    spark = pages.sparkSession
    text = F.coalesce(F.col(payload_col), F.lit("")).cast("binary")
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(url_col), F.lit("")).alias("url"), text.alias("payload"), F.sha1(text).alias("digest"))
    key = F.expr(_KEY)
    edges = np.array(cuts(rows.select(key.alias("id"), F.octet_length("payload").alias("size")), shard_bytes), "S17")
    shard = F.arrow_udf(lambda keys: pa.array(np.searchsorted(edges, np.array(keys.to_pylist(), "S17"), "right").astype(np.int32)), "int")
    groups = rows.groupBy("digest").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    again = rows.select("id", "digest").join(groups, "digest").where(~F.col("id").eqNullSafe(F.col("first")))
    notes = again.select("id", F.lit(None).cast("string").alias("url"), F.lit(None).cast("binary").alias("payload"), "digest", "first", F.lit(0).alias("kind")).distinct()
    both = notes.unionByName(rows.select("id", "url", "payload", "digest", F.lit(None).cast("long").alias("first"), F.lit(1).alias("kind")))
    shards = len(edges) + 1
    dealt = both.withColumn("shard", shard(key)).repartitionById(shards, F.col("shard")).sortWithinPartitions("shard", F.col("id").asc_nulls_first(), "digest", "kind", "url")

    def save(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, attempt, note, last = None, uuid.uuid4().hex, None, None
        for batch in batches:
            for row in batch.to_pylist():
                key = (row["id"], row["digest"])
                if out and out.shard != row["shard"]:
                    yield out.close()
                    out = None
                if row["kind"] == 0:
                    note = (key, row["first"])
                    continue
                out = out or _Roll(folder, attempt, row["shard"], date, level)
                if out.size >= roll_bytes:
                    yield out.close()
                    out = out.following()
                if note and note[0] == key:
                    data = revisit(row["id"], row["url"], row["payload"], note[1], date, level)
                elif last == key:
                    data = revisit(row["id"], row["url"], row["payload"], row["id"], date, level)
                else:
                    data = response(row["id"], row["url"], row["payload"], date, level)
                out.add(row["id"], data)
                last = key
        if out:
            yield out.close()

    written = materialize(dealt.mapInArrow(save, _MANIFEST), "warc_written")

    def commit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        system, root = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for row in batch.to_pylist():
                old, new = f"{root}/_temporary/{row['temporary']}", f"{root}/{row['file']}"
                if system.get_file_info(old).type != fs.FileType.NotFound:
                    system.move(old, new)
                elif system.get_file_info(new).size != row["bytes"]:
                    raise OSError(f"{row['file']} was neither written nor committed")
            yield batch

    committed = written.mapInArrow(commit, _MANIFEST).drop("temporary")
    committed.write.parquet(f"{folder}/_manifest")
    remove(spark, f"{folder}/_temporary")
    return manifest(spark, folder)


_MANIFEST = "file string, temporary string, shard int, part int, records long, bytes long, sha256 string, first_id long, last_id long"


class _Roll:
    """A file of a shard in the making."""

    def __init__(self, folder: str, attempt: str, shard: int, date: str, level: int, part: int = 0):
        from pyarrow import fs

        self.folder, self.attempt, self.shard, self.date, self.level, self.part = folder, attempt, shard, date, level, part
        system, root = fs.FileSystem.from_uri(folder)
        self.file = f"part-{shard:06d}-{part:05d}.warc.gz"
        self.temporary = f"{attempt}-{self.file}"
        system.create_dir(f"{root}/_temporary", recursive=True)
        self.stream, self.hash, self.size, self.records, self.first, self.last = system.open_output_stream(f"{root}/_temporary/{self.temporary}", compression=None), hashlib.sha256(), 0, 0, None, None
        info = f"software: record writer\r\nformat: WARC File Format 1.1\r\nisPartOf: {self.file}\r\n".encode()
        self._put(record([("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, self.file)}>"), ("WARC-Date", date), ("WARC-Filename", self.file), ("Content-Type", "application/warc-fields")], info, level))

    def _put(self, data: bytes) -> None:
        self.stream.write(data)
        self.hash.update(data)
        self.size += len(data)

    def add(self, source_id: int | None, data: bytes) -> None:
        self._put(data)
        self.first = source_id if not self.records else self.first
        self.last = source_id
        self.records += 1

    def following(self) -> _Roll:
        return _Roll(self.folder, self.attempt, self.shard, self.date, self.level, self.part + 1)

    def close(self) -> pa.RecordBatch:
        self.stream.close()
        return pa.RecordBatch.from_arrays(
            [pa.array([x], t) for x, t in (
                (self.file, pa.string()), (self.temporary, pa.string()), (self.shard, pa.int32()), (self.part, pa.int32()), (self.records, pa.int64()),
                (self.size, pa.int64()), (self.hash.hexdigest(), pa.string()), (self.first, pa.int64()), (self.last, pa.int64()),
            )],
            names=["file", "temporary", "shard", "part", "records", "bytes", "sha256", "first_id", "last_id"],
        )


def manifest(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/_manifest")


def parse(chunks: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (names in lower case) and block of every record of a file that comes in chunks; one record is held at a time."""
    unpacker, parts = zlib.decompressobj(31), []
    for chunk in chunks:
        while chunk:
            parts.append(unpacker.decompress(chunk))
            chunk = b""
            if unpacker.eof:
                chunk, data = unpacker.unused_data, b"".join(parts)
                unpacker, parts = zlib.decompressobj(31), []
                head, _, rest = data.partition(b"\r\n\r\n")
                lines = head.decode("utf-8").split("\r\n")
                if lines[0].encode() != VERSION:
                    raise ValueError("not a WARC record")
                headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
                n = int(headers["content-length"])
                if rest[n:] != b"\r\n\r\n":
                    raise ValueError("a record's length is wrong")
                yield headers, rest[:n]
    if any(parts):
        raise ValueError("the file ends within a record")


_READ = "id long, url string, record_type string, date string, payload binary, payload_bytes long, payload_digest string, refers_to long"


def read(spark: SparkSession, folder: str, batch_bytes: int = 8 << 20) -> DataFrame:
    """Every response and revisit record of an archive. payload is null for revisits; digests of responses are checked."""
    files = manifest(spark, folder).select("file", "bytes")
    n = max(1, min(files.count(), 1 << 16))
    schema = pa.schema([("id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("date", pa.string()), ("payload", pa.binary()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.int64())])
    number = lambda x: None if x in (None, "None") else int(x)

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        system, root = fs.FileSystem.from_uri(folder)
        rows, held = [], 0
        for batch in batches:
            for name in batch["file"].to_pylist():
                with system.open_input_stream(f"{root}/{name}", compression=None) as stream:
                    for headers, block in parse(iter(lambda s=stream: s.read(1 << 20), b"")):
                        kind = headers["warc-type"]
                        if kind == "warcinfo":
                            continue
                        payload = block.partition(b"\r\n\r\n")[2] if kind == "response" else None
                        digest = headers["warc-payload-digest"].removeprefix("sha1:")
                        if payload is not None and _sha1(payload) != digest:
                            raise ValueError(f"{name}: a payload doesn't have its digest")
                        size = len(payload) if payload is not None else int(headers["warc-payload-length"])
                        rows.append((number(headers["warc-source-id"]), json.loads(headers["warc-source-url"]) if "warc-source-url" in headers else headers["warc-target-uri"], kind, headers["warc-date"], payload, size, digest, number(headers.get("warc-refers-to-source-id"))))
                        held += len(block)
                        if held >= batch_bytes or len(rows) >= 4096:
                            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
                            rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return files.repartition(n).mapInArrow(load, _READ)
