"""WARC archives, written in deterministic shards and read back.

Records are ordered by page_id, then payload digest, then the response before its revisits, then url. A narrow table of
digests, urls and sizes decides everything: which record is the response, and by a range sort with running sums of bytes
where each shard begins, so shards hold about ``shard_bytes`` of records whatever the ids are, and the same for the same
table whatever the partitions. A shard may begin within an id, and within the revisits of a payload. Revisits are made
from the narrow table alone; of the payloads only those of responses travel, once, to their shard, which they find by the
first response of each shard. A task writes its shard as gzip members with headers and digests made anew, begins another
file when ``file_bytes`` compressed bytes are reached, writes each under a temporary name and renames it when it is
whole. A file counts once a manifest row names it, and manifest rows are committed by Spark: a lost or repeated task
leaves files of the same names and bytes, or none that a reader looks at.

By default a shard is 1 / SHARDS of all bytes, but within SHARD_BYTES, and a file an eighth of it, so that a shard rolls
over several files at any size; 100 TB make shards of 8 GB in files of up to 1 GB.

Records with equal payloads: one with the largest page_id is the response, the others are revisits that refer to it.
Payloads that many rows of one page_id share are reduced to one in each task before they travel.

Defined cases: a null html is the empty payload; a null url becomes ``urn:page:<page_id>``; rows without a page_id
come first and are never referred to unless all rows of the payload lack one. Rows that repeat page_id and payload: one
is the response, the others refer to the same id. A payload of any length is one record, alone in its shard where it is
larger than one. An empty table gives no files. Extra columns, whatever their names, are ignored.

Archives are written through pyarrow's file systems (local or mounted folders, HDFS, S3, GCS), so the folder must be
one that these can open.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructType

from maskwright.llm.common import HOT_SHARE, discard, lookup, materialize, shared_dir

#: How many shards a table makes, and the least and greatest bytes of records in one.
SHARDS, SHARD_BYTES = 1024, (16_000_000, 8_000_000_000)
#: Files that a shard would make if its records didn't shrink.
FILES = 8
#: Bytes of a record besides its payload, about.
HEAD = 600
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MANIFEST = "path string, shard int, records long, bytes long, sha256 string"
RECORD = "page_id long, url string, record_type string, payload_digest string, payload_bytes long, refers_to long, payload binary"


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}:{digest}')}>"


def member(fields: list[tuple[str, str]], block: bytes, level: int) -> bytes:
    """One record as a gzip member; nothing in it depends on when or where it is made."""
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in [*fields, ("Content-Length", str(len(block)))]) + "\r\n"
    out = zlib.compressobj(level, zlib.DEFLATED, 31)
    return out.compress(head.encode() + block + b"\r\n\r\n") + out.flush()


def page_record(page_id: int | None, url: str | None, payload: bytes | None, sha1: str, size: int, refers_to: int | None, date: str, level: int) -> bytes:
    """A page's record: a response with its payload, or without one a revisit; ``sha1`` (hex) and ``size`` are the payload's."""
    digest = base64.b32encode(bytes.fromhex(sha1)).decode()
    if payload is not None and hashlib.sha1(payload).hexdigest() != sha1:
        raise ValueError(f"page {page_id}: the payload isn't the one that was counted")
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http if payload is None else http + payload
    url = "".join(url.split()) if url else f"urn:page:{page_id}"
    fields = [
        ("WARC-Type", "revisit" if payload is None else "response"), ("WARC-Record-ID", record_id(page_id, digest)),
        ("WARC-Date", date), ("WARC-Target-URI", url), ("Content-Type", "application/http;msgtype=response"),
        ("WARC-Block-Digest", f"sha1:{base32_sha1(block)}"), ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("X-Payload-Length", str(size)), ("X-Page-Id", "" if page_id is None else str(page_id)),
    ]
    if payload is None:
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(refers_to, digest)), ("X-Refers-To-Page-Id", "" if refers_to is None else str(refers_to))]
    return member(fields, block, level)


class Shard:
    """The files of one shard, each under a temporary name until it is whole."""

    def __init__(self, folder: str, number: int, file_bytes: int, date: str, level: int):
        from pyarrow import fs

        self.fs, self.folder = fs.FileSystem.from_uri(folder)
        self.number, self.file_bytes, self.date, self.level = number, file_bytes, date, level
        self.files: list[tuple] = []
        self.out = None

    def add(self, record: bytes) -> None:
        if self.out is not None and self.size + len(record) > self.file_bytes and self.records:
            self.close()
        if self.out is None:
            self.name = f"{self.folder}/shard-{self.number:06d}-{len(self.files):05d}.warc.gz"
            self.temporary = f"{self.name}.{uuid.uuid4().hex}.tmp"
            self.out, self.size, self.records, self.sum = self.fs.open_output_stream(self.temporary, compression=None), 0, 0, hashlib.sha256()
            self._write(member([("WARC-Type", "warcinfo"), ("WARC-Record-ID", record_id(None, self.name.rpartition("/")[2])), ("WARC-Date", self.date), ("WARC-Filename", self.name.rpartition("/")[2]), ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n", self.level))
        self._write(record)
        self.records += 1

    def _write(self, data: bytes) -> None:
        self.out.write(data)
        self.sum.update(data)
        self.size += len(data)

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
            self.fs.move(self.temporary, self.name)
            self.files.append((self.name, self.number, self.records, self.size, self.sum.hexdigest()))
            self.out = None


def _key(page_id: Column, digest: Column) -> Column:
    """29 bytes that are ordered as (page_id, digest), rows without a page_id first."""
    high = F.unhex(F.lpad(F.hex(page_id.bitwiseXOR(F.lit(-(2**63)))), 16, "0"))
    return F.concat(F.when(page_id.isNull(), F.lit(b"\x00" * 9)).otherwise(F.concat(F.lit(b"\x01"), high)), digest)


def _roles(pages: DataFrame, revisit_min_bytes: int) -> DataFrame:
    """A narrow row for each record, written once: key, kind (0 response, 1 revisit), url, page_id, refers_to, bytes."""
    digest = F.unhex(F.sha1("payload"))
    narrow = pages.select("page_id", "url", digest.alias("digest"), F.octet_length("payload").cast("long").alias("bytes"), F.monotonically_increasing_id().alias("row"))
    narrow = materialize(narrow, "payload-digests")
    # The largest page_id first; of its rows that with the first url.
    top = F.min(F.struct(F.col("page_id").isNull().alias("none"), F.bitwise_not("page_id").alias("down"), "url", "row")).alias("top")
    same = narrow.where(F.col("bytes") >= revisit_min_bytes).groupBy("digest").agg(top, F.count(F.lit(1)).alias("n"))
    same = materialize(same.where("n > 1").select("digest", "n", F.bitwise_not("top.down").alias("refers_to"), F.col("top.row").alias("first")), "payload-groups")
    rows = lookup(narrow, same, "digest", "n", "row")
    revisit = F.coalesce(F.col("first") != F.col("row"), F.lit(False))
    out = rows.select(
        _key(F.col("page_id"), F.col("digest")).alias("key"), revisit.cast("int").alias("kind"), "url", "row", "page_id", "digest",
        F.when(revisit, F.col("refers_to")).alias("refers_to"), "bytes",
    )
    return materialize(out, "records")


def _placed(records: DataFrame, shard_bytes: int | None, file_bytes: int | None) -> tuple[DataFrame, int, int]:
    """``records`` with their shard, written once; the number of shards, and the bytes of a file."""
    weight = F.lit(HEAD) + F.when(F.col("kind") == 0, F.col("bytes")).otherwise(0)
    total = records.agg(F.sum(weight)).first()[0] or 0
    shard_bytes = shard_bytes or min(max(-(-total // SHARDS), SHARD_BYTES[0]), SHARD_BYTES[1])

    def summed(batches: Iterator) -> Iterator:
        """What a part of the sort has before each of its rows."""
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        part, total = TaskContext.get().partitionId(), 0
        for batch in batches:
            upto = np.cumsum(batch.column("weight").to_numpy(zero_copy_only=False)) + total
            total = int(upto[-1]) if len(upto) else total
            columns = [*batch.columns, pa.array(np.full(batch.num_rows, part), pa.int32()), pa.array(upto, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, "part", "upto"])

    weighed = records.withColumn("weight", weight.cast("long"))
    sorted_ = weighed.orderBy("key", "kind", "url", "row").mapInArrow(summed, StructType([*weighed.schema]).add("part", IntegerType()).add("upto", LongType()))
    sorted_ = materialize(sorted_, "sorted-records")
    sums = sorted_.groupBy("part").agg(F.max("upto").alias("sum"))
    before = F.coalesce(F.sum("sum").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sums.select("part", before.alias("before"))  # a row for each part of the sort
    at = F.col("upto") - F.col("weight") + F.col("before")
    placed = sorted_.join(F.broadcast(starts), "part").withColumn("shard", F.floor(at / shard_bytes).cast("int")).drop("part", "weight", "upto", "before")
    placed = materialize(placed, "placed-records")
    discard(sorted_)
    return placed, (placed.agg(F.max("shard")).first()[0] or 0) + 1, file_bytes or max(-(-shard_bytes // FILES), 1_000_000)


def _payloads(pages: DataFrame, records: DataFrame, placed: DataFrame) -> DataFrame:
    """shard, key, kind -1 and payload: what a shard's responses hold. Others that come along are passed over there."""
    cuts = placed.where("kind = 0").groupBy("shard").agg(F.min("key").alias("key")).collect()  # a row for each shard
    first = sorted((bytes(r["key"]), r["shard"]) for r in cuts)
    shared = pages.sparkSession.sparkContext.broadcast(first)

    @F.pandas_udf("int")
    def shard_of(key):
        import bisect

        import pandas as pd

        keys = [k for k, _ in shared.value]
        return pd.Series([shared.value[max(bisect.bisect_right(keys, bytes(k)) - 1, 0)][1] for k in key], dtype="int32")

    rows = pages.select(_key(F.col("page_id"), F.unhex(F.sha1("payload"))).alias("key"), "payload")
    # Payloads that at least HOT_SHARE of all rows have, of which there are 1 / HOT_SHARE at most: one comes from a task.
    often = records.groupBy("digest").agg(F.count(F.lit(1)).alias("n"), F.max(F.when(F.col("kind") == 0, F.col("key"))).alias("response"), F.sum(1 - F.col("kind")).alias("responses"))
    least = max(2, int(records.count() * HOT_SHARE))
    hot = materialize(often.where((F.col("n") >= least) & (F.col("responses") == 1)).select("digest", "response"), "hot-payloads")
    rows = rows.withColumn("digest", F.substring("key", 10, 20)).join(F.broadcast(hot), "digest", "left")
    cold = rows.where("response IS NULL").select("key", "payload")
    once = rows.where("key = response").groupBy("key").agg(F.first("payload").alias("payload"))
    out = cold.unionByName(once)
    return out.withColumn("shard", shard_of("key"))


def write(pages: DataFrame, folder: str, shard_bytes: int | None = None, file_bytes: int | None = None, revisit_min_bytes: int = 0, date: str = "2020-01-01T00:00:00Z", level: int = 6) -> DataFrame:
    """Write the archives of ``pages`` (page_id, url, html) into ``folder``; the manifest: path, shard, records, bytes, sha256."""
    spark = pages.sparkSession
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce(F.col("html").cast("binary"), F.lit(b"")).alias("payload"))
    records = _roles(pages, revisit_min_bytes)
    placed, n, file_bytes = _placed(records, shard_bytes, file_bytes)
    bare = placed.select("shard", "key", "kind", "url", "row", "page_id", F.lower(F.hex("digest")).alias("sha1"), "refers_to", "bytes", F.lit(None).cast("binary").alias("payload"))
    full = _payloads(pages, records, placed).select("shard", "key", F.lit(-1).alias("kind"), F.lit(None).cast("string").alias("url"), F.lit(0).cast("long").alias("row"), F.lit(None).cast("long").alias("page_id"), F.lit(None).cast("string").alias("sha1"), F.lit(None).cast("long").alias("refers_to"), F.lit(0).cast("long").alias("bytes"), "payload")
    both = bare.unionByName(full).repartitionByRange(n, "shard").sortWithinPartitions("shard", "key", "kind", "url", "row")

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        shard: Shard | None = None
        held = payload = None
        done_files: list[tuple] = []
        for batch in batches:
            for part in (batch.slice(i, 64) for i in range(0, batch.num_rows, 64)):
                for r in part.to_pylist():
                    if r["kind"] < 0:
                        held, payload = r["key"], r["payload"]
                        continue
                    if shard is None or shard.number != r["shard"]:
                        if shard:
                            shard.close()
                            done_files += shard.files
                        shard = Shard(folder, r["shard"], file_bytes, date, level)
                    if r["kind"] == 0 and held != r["key"]:
                        raise ValueError(f"page {r['page_id']} has no payload: the table changed while it was read")
                    shard.add(page_record(r["page_id"], r["url"], payload if r["kind"] == 0 else None, r["sha1"], r["bytes"], r["refers_to"], date, level))
        if shard:
            shard.close()
            done_files += shard.files
        columns = list(zip(*done_files, strict=True)) or [[]] * 5
        types = (pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.string())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=[c.split()[0] for c in MANIFEST.split(", ")])

    _make(spark, folder)
    written = both.mapInArrow(run, MANIFEST)
    manifest = materialize(written.withColumn("path", F.concat(F.lit(_scheme(folder)), "path")), "warc-manifest")
    discard(records, placed)
    return manifest


def _make(spark, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(path)


def _scheme(folder: str) -> str:
    """What pyarrow leaves out of a path that it gives back."""
    return folder.partition("://")[0] + "://" if "://" in folder else ""


def members(stream, chunk: int = 1 << 20) -> Iterator[bytes]:
    """The gzip members of a stream, one after the other."""
    data, out, inflate = b"", [], zlib.decompressobj(31)
    while True:
        data = data or stream.read(chunk)
        if not data:
            return
        out.append(inflate.decompress(data))
        data = inflate.unused_data
        if inflate.eof:
            yield b"".join(out)
            out, inflate = [], zlib.decompressobj(31)


def parse(record: bytes) -> tuple[dict[str, str], bytes]:
    """A record's fields, by name in lower case, and its block."""
    head, _, rest = record.partition(b"\r\n\r\n")
    first, *lines = head.decode().split("\r\n")
    if not first.startswith("WARC/1."):
        raise ValueError(f"not a WARC record: {first[:40]!r}")
    fields = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
    return fields, rest[: int(fields["content-length"])]


def read(manifest: DataFrame, payloads: bool = True) -> DataFrame:
    """The page records of the archives that ``manifest`` names; digests of blocks and payloads are checked."""
    number = lambda s: int(s) if s else None

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyarrow import fs

        names = [c.split()[0] for c in RECORD.split(", ")]
        types = (pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.binary())
        for batch in batches:
            for path in batch.column(0).to_pylist():
                rows: list[tuple] = []
                where, name = fs.FileSystem.from_uri(path)
                with where.open_input_stream(name, compression=None) as stream:
                    for record in members(stream):
                        fields, block = parse(record)
                        if fields["warc-type"] == "warcinfo":
                            continue
                        payload = block.partition(b"\r\n\r\n")[2]
                        digest = fields["warc-payload-digest"].partition(":")[2]
                        if fields["warc-block-digest"] != f"sha1:{base32_sha1(block)}" or fields["warc-type"] == "response" and base32_sha1(payload) != digest:
                            raise ValueError(f"{path}: a digest differs in {fields['warc-record-id']}")
                        rows.append((number(fields["x-page-id"]), fields["warc-target-uri"], fields["warc-type"], digest, int(fields["x-payload-length"]), number(fields.get("x-refers-to-page-id")), payload if payloads else None))
                        if len(rows) >= 500:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)
                            rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    files = max(1, manifest.count())
    return manifest.select("path").repartitionByRange(files, "path").mapInArrow(run, RECORD)


def round_trip(pages: DataFrame, revisit_min_bytes: int = 0) -> DataFrame:
    """Write ``pages`` into the shared folder, read the archives back and say what each record is."""
    manifest = write(pages, shared_dir(pages.sparkSession, "warc"), revisit_min_bytes=revisit_min_bytes)
    return read(manifest, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
