"""WARC archives: a deterministic sharded writer and a reader.

Records are range-sorted by page id: the id range is cut into CELLS equal cells, cells become shards of about
SHARD_BYTES of payload, and each shard is sorted and written as gzip members to files that roll at ROLL_BYTES
compressed. A cell that holds more than a shard is cut into equal ranges or, where its ids are too uneven for that, spread
over several shards by a hash. Cuts depend on the data alone, and so
do file names, record ids, headers and digests. Tasks write under temporary names and return a manifest; the manifest
is stored, and a second job renames exactly the files that it lists, so failed or repeated attempts leave no records.

Of records with equal payloads of at least `least` bytes, the one with the largest page id is a response, the others
are revisits of it. Only the digests of payloads that occur twice or more are joined back, by broadcast up to
MOST_BROADCAST of them.

Defined cases: a null html is an empty payload; a null page_id sorts first and is the smallest id; rows with the same
page id and payload are all responses if theirs is the largest id; a null url becomes urn:page:<id>, control
characters and spaces in urls are escaped; an empty table writes no file and reads back as no rows; other columns are
ignored.
"""

from __future__ import annotations

import gzip
import hashlib
import json
import math
import re
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinweave.llm.common import checkpoint, make_folder, new_folder, prepare

CELLS, SHARD_BYTES, ROLL_BYTES = 4096, 16 << 20, 8 << 20
MOST_BROADCAST = 200_000
#: Writing tasks at most; beyond that a task writes several shards, one after another.
MOST_TASKS = 100_000
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MANIFEST = "shard int, seq int, temporary string, name string, n_records long, n_bytes long, sha256 string"
RECORD = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"


def record_id(page_id: int | None, url: str, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id} {url} {digest}')}>"


def uri(page_id: int | None, url: str | None) -> str:
    if url is None:
        return f"urn:page:{'' if page_id is None else page_id}"
    return re.sub(r"[\x00-\x20\x7f-\x9f  ]", lambda m: "".join(f"%{b:02X}" for b in m[0].encode()), url)


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    """One WARC record; its block is an HTTP response, without payload if it is a revisit."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    target = uri(page_id, url)
    head = {
        "WARC-Type": "revisit" if revisit else "response",
        "WARC-Record-ID": record_id(page_id, target, digest),
        "WARC-Date": DATE,
        "WARC-Target-URI": target,
        "WARC-Payload-Digest": f"sha1:{digest}",
        "WARC-Block-Digest": f"sha1:{hashlib.sha1(block).hexdigest()}",
        "Content-Type": "application/http; msgtype=response",
        "X-Page-ID": "" if page_id is None else str(page_id),
        "X-Has-URL": str(int(url is not None)),
    }
    if revisit:
        head |= {"WARC-Profile": PROFILE, "X-Refers-To-Page-ID": "" if refers_to is None else str(refers_to)}
    head["Content-Length"] = str(len(block))
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head.items()).encode() + b"\r\n" + block + b"\r\n\r\n"


def store(folder: str) -> tuple[fs.FileSystem, str]:
    """The file system of a folder and the path in it; Hadoop's names for S3 are those of one store."""
    return fs.FileSystem.from_uri(re.sub(r"^s3[an]://", "s3://", folder))


class Roll:
    """Writes the records of a shard to files of about ROLL_BYTES."""

    def __init__(self, folder: str) -> None:
        self.fs, self.root = store(folder)
        self.attempt = uuid.uuid4().hex
        self.shard: int | None = None
        self.parts: list[bytes] = []
        self.size = self.seq = 0

    def flush(self) -> list[dict]:
        if not self.parts:
            return []
        data, n = b"".join(self.parts), len(self.parts)
        name = f"part-{self.shard:06d}-{self.seq:05d}.warc.gz"
        temporary = f"_temporary-{self.attempt}-{name}"
        with self.fs.open_output_stream(f"{self.root}/{temporary}", compression=None) as f:
            f.write(data)
        self.parts, self.size = [], 0
        row = {"shard": self.shard, "seq": self.seq, "temporary": temporary, "name": name, "n_records": n, "n_bytes": len(data), "sha256": hashlib.sha256(data).hexdigest()}
        self.seq += 1
        return [row]

    def add(self, shard: int, data: bytes) -> list[dict]:
        out = []
        if shard != self.shard:
            out = self.flush()
            self.shard, self.seq = shard, 0
        member = gzip.compress(data, 3, mtime=0)
        self.parts.append(member)
        self.size += len(member)
        return out + (self.flush() if self.size >= ROLL_BYTES else [])


def _write(frames: Iterator[pd.DataFrame], folder: str) -> Iterator[pd.DataFrame]:
    roll = Roll(folder)
    columns = [x.split()[0] for x in MANIFEST.split(", ")]
    for frame in frames:
        rows = []
        for shard, i, has_id, url, payload, digest, to, revisit, has_to in zip(*(frame[c] for c in ("shard", "page_id", "has_id", "url", "payload", "digest", "refers_to", "revisit", "has_to")), strict=True):
            rows += roll.add(int(shard), record(int(i) if has_id else None, url, payload, digest, int(to) if has_to else None, bool(revisit)))
        yield pd.DataFrame(rows, columns=columns)
    yield pd.DataFrame(roll.flush(), columns=columns)


def _commit(frames: Iterator[pd.DataFrame], folder: str) -> Iterator[pd.DataFrame]:
    files, root = store(folder)
    for frame in frames:
        for temporary, name, n in zip(frame["temporary"], frame["name"], frame["n_bytes"], strict=True):
            done = files.get_file_info(f"{root}/{name}")
            if done.type == fs.FileType.NotFound or done.size != n:
                files.move(f"{root}/{temporary}", f"{root}/{name}")
        yield frame[["name"]]


def shards(payloads: DataFrame) -> tuple[object, int]:
    """The column that deals rows (page_id, size, digest) to shards, and the number of shards."""
    low, high = payloads.agg(F.min("page_id"), F.max("page_id")).first()
    if low is None:
        low = high = 0
    width = max(1, math.ceil((high - low + 1) / CELLS))
    far = F.col("page_id").cast("decimal(20,0)") - F.lit(low).cast("decimal(20,0)")  # ids may span more than a long holds
    part = F.call_function("div", far, F.lit(width).cast("decimal(20,0)")).cast("int")
    cell = F.coalesce(part + 1, F.lit(0))
    sized = payloads.groupBy(cell.alias("cell")).agg(F.sum(F.col("size") + 200).alias("n"))
    sizes = {r["cell"]: r["n"] for r in sized.collect()}  # CELLS + 1 rows at most
    first, spread, at, room = [], [], 0, 0
    for c in range(max(sizes, default=0) + 1):
        n = sizes.get(c, 0)
        if n > 2 * SHARD_BYTES:
            at += bool(room)
            first.append(at)
            spread.append(math.ceil(n / SHARD_BYTES))
            at, room = at + spread[-1], 0
            continue
        if room and room + n > SHARD_BYTES:
            at, room = at + 1, 0
        first.append(at)
        spread.append(1)
        room += n
    deal = F.array(*map(F.lit, first))[cell]
    if max(spread) > 1:
        wide = F.array(*map(F.lit, spread))[cell]
        within = (far - part.cast("decimal(20,0)") * F.lit(width)).cast("double") / F.lit(float(width))
        ranged = F.coalesce(F.least(F.floor(within * wide).cast("int"), wide - 1), F.lit(0))
        crowded = payloads.groupBy(cell.alias("cell"), ranged.alias("part")).agg(F.sum(F.col("size") + 200).alias("n")).where(F.col("n") > 4 * SHARD_BYTES)
        uneven = {r["cell"] for r in crowded.select("cell").distinct().collect()}  # CELLS + 1 rows at most
        hashed = F.pmod(F.xxhash64("url", "digest"), wide).cast("int")
        deal = deal + (F.when(cell.isin(*uneven), hashed).otherwise(ranged) if uneven else ranged)
    return deal, at + 1


def write(pages: DataFrame, folder: str, least: int = 1000, html: str = "html") -> DataFrame:
    """Write the archives of pages (page_id, url, html) to folder; the manifest, as a table stored beside them."""
    spark = pages.sparkSession
    prepare(spark)
    make_folder(spark, folder)
    payload = F.coalesce(F.col(html).cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumns({"digest": F.sha1("payload"), "size": F.octet_length("payload").cast("long")})
    brief = rows.select("page_id", "url", "digest", "size")
    twice = checkpoint(brief.where(F.col("size") >= least).groupBy("digest").agg(F.max("page_id").alias("refers_to"), F.count("*").alias("n")).where("n > 1").drop("n"))
    few = twice.count() <= MOST_BROADCAST
    joined = rows.join((F.broadcast(twice) if few else twice).withColumnRenamed("digest", "__kw_digest"), (F.col("digest") == F.col("__kw_digest")) & (F.col("size") >= least), "left").drop("__kw_digest")
    revisit = F.col("refers_to").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("refers_to"))
    joined = joined.withColumns({"revisit": revisit, "refers_to": F.when(revisit, F.col("refers_to"))})
    deal, n = shards(brief)
    dealt = joined.withColumn("shard", deal).repartitionById(min(n, MOST_TASKS), F.col("shard") % min(n, MOST_TASKS)).sortWithinPartitions("shard", "page_id", "url", "digest")
    ready = dealt.select("shard", F.coalesce("page_id", F.lit(0)).alias("page_id"), F.col("page_id").isNotNull().alias("has_id"), "url", "payload", "digest", F.coalesce("refers_to", F.lit(0)).alias("refers_to"), "revisit", F.col("refers_to").isNotNull().alias("has_to"))
    ready.mapInPandas(lambda it: _write(it, folder), MANIFEST).write.parquet(f"{folder}/_manifest")
    manifest = spark.read.parquet(f"{folder}/_manifest")
    manifest.repartition(max(1, min(n, 200)), "name").mapInPandas(lambda it: _commit(it, folder), "name string").write.parquet(f"{folder}/_committed")
    return manifest


def members(data: bytes) -> Iterator[bytes]:
    while data:
        d = zlib.decompressobj(31)
        yield d.decompress(data)
        data = d.unused_data


def parse(data: bytes) -> dict:
    """A record as a row of RECORD; its digests must agree with its content."""
    head, _, rest = data.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    h = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines)
    block = rest[: int(h["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    digest = h["WARC-Payload-Digest"].removeprefix("sha1:")
    kind = h["WARC-Type"]
    if version != "WARC/1.1" or hashlib.sha1(block).hexdigest() != h["WARC-Block-Digest"].removeprefix("sha1:") or kind == "response" and hashlib.sha1(payload).hexdigest() != digest:
        raise ValueError(f"record {h.get('WARC-Record-ID')} is damaged")
    size = int(re.search(rb"(?m)^Content-Length: (\d+)", http)[1])
    number = lambda k: int(h[k]) if h.get(k) else None
    return {"page_id": number("X-Page-ID"), "url": h["WARC-Target-URI"] if h["X-Has-URL"] == "1" else None, "payload_bytes": size, "payload_digest": digest, "record_type": kind, "refers_to": number("X-Refers-To-Page-ID"), "payload": payload if kind == "response" else None}


def read(spark: SparkSession, folder: str) -> DataFrame:
    """The records of the archives in folder."""
    prepare(spark)

    def rows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for content in frame["content"]:
                batch, size = [], 0
                for m in members(content):
                    batch.append(parse(m))
                    size += len(m)
                    if size > ROLL_BYTES:
                        yield pd.DataFrame(batch).astype({"page_id": "Int64", "refers_to": "Int64"})
                        batch, size = [], 0
                if batch:
                    yield pd.DataFrame(batch).astype({"page_id": "Int64", "refers_to": "Int64"})

    if not spark.read.parquet(f"{folder}/_manifest").select("name").head(1):
        return spark.createDataFrame([], RECORD)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*.warc.gz").load(folder).select("content")
    return files.mapInPandas(rows, RECORD)


def round_trip(pages: DataFrame, least: int = 1000) -> DataFrame:
    """The records of pages as read back from archives in a new folder of the shared one."""
    folder = new_folder(pages.sparkSession, "warc")
    write(pages, folder, least)
    return read(pages.sparkSession, folder)


def report(manifest: DataFrame) -> str:
    """Totals of a manifest as JSON."""
    r = manifest.agg(F.count("*").alias("files"), F.sum("n_records").alias("records"), F.sum("n_bytes").alias("bytes")).first()
    return json.dumps(r.asDict())
