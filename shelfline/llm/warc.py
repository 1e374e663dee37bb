"""Deterministic sharded WARC archives: range-sorted records, files rolled by compressed size.

Shard bounds are quantiles of a sample of page ids that a hash of the id chooses, so the same table
gives the same shards however it is partitioned. A shard is one task: it writes its records in order
of page id, each as a gzip member of its own, and starts a new file where the next record would take
the file past `roll_bytes`. Headers and digests are made anew from the payload and carry nothing of
the run, so every attempt of a task writes the same bytes. A file is written under a temporary name
and moved when complete; readers go by the manifest, a table that is committed after all files.

Of records with equal payloads of at least 1000 bytes the one with the largest page id is a
response; the others become revisit records without payload. Their choice needs ids and digests
only, so the pages themselves are shuffled once.

Cases: null html is an empty payload; a null page_id sorts first and never is the one revisited
unless all ids are null, then all are responses; repeated rows give a record each, and rows with the
largest id are all responses; a null url has no target header; an empty table writes no file; other
columns are ignored. Files are written through Arrow's file systems, which know local and shared
folders, hdfs, s3 and gs.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import os
import re
import uuid
from collections.abc import Callable, Iterator
from urllib.parse import quote

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfline.llm.common import in_batches, table, written
from shelfline.session import shared_dir

#: Payloads below this are never replaced by a revisit.
LEAST_REVISITED = 1000
#: Payload bytes of a shard, about; a file is closed before it grows past ROLL_BYTES.
SHARD_BYTES, ROLL_BYTES = 32 << 20, 8 << 20
#: Page ids that the bounds are taken from, at most.
SAMPLE = 1 << 15
#: The archives say nothing of when they were written.
DATE = "2000-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
LOWEST = -(1 << 63)
#: Most tasks that read archives back; each takes its files one after the other.
READERS = 10_000


def member(headers: list[tuple[str, str]], block: bytes) -> bytes:
    """One WARC record as a gzip member."""
    lines = ["WARC/1.1", *(f"{k}: {v}" for k, v in headers), f"Content-Length: {len(block)}"]
    return gzip.compress("\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n", 6, mtime=0)


def sha1(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(page_id: int | None, digest: str, repeat: int) -> str:
    return f"<urn:x-page:{'' if page_id is None else page_id}:{digest}:{repeat}>"


def page_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, repeat: int) -> bytes:
    digest = hashlib.sha1(payload).hexdigest()
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    headers = [("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", record_id(page_id, digest, repeat))]
    headers += [("WARC-Date", DATE), ("Content-Type", "application/http;msgtype=response")]
    if url is not None:
        headers.append(("WARC-Target-URI", quote(url, safe="!#$%&'()*+,/:;=?@[]~")))
    if refers_to is None:
        block += payload
    else:
        headers += [("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(refers_to, digest, 0))]
    headers += [("WARC-Payload-Digest", sha1(payload)), ("WARC-Block-Digest", sha1(block))]
    return member(headers, block)


def info_record(name: str) -> bytes:
    headers = [("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:x-file:{name}>"), ("WARC-Date", DATE), ("WARC-Filename", name)]
    return member([*headers, ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n")


class ShardFiles:
    """The files of one shard, written in order under temporary names."""

    def __init__(self, root: str, shard: int, roll_bytes: int) -> None:
        self.files, self.root = fs.FileSystem.from_uri(root)
        self.shard, self.roll_bytes = shard, roll_bytes
        self.count, self.out, self.done = 0, None, []

    def add(self, record: bytes) -> None:
        if self.out and self.size + len(record) > self.roll_bytes:
            self.close()
        if not self.out:
            self.name = f"shard-{self.shard:06d}-{self.count:05d}.warc.gz"
            self.temporary = f"{self.root}/_temporary/{uuid.uuid4().hex}/{self.name}"
            self.files.create_dir(os.path.dirname(self.temporary), recursive=True)
            self.out, self.size, self.records, self.count = self.files.open_output_stream(self.temporary, compression=None), 0, 0, self.count + 1
            self.write(info_record(self.name))
        self.write(record)
        self.records += 1

    def write(self, data: bytes) -> None:
        self.out.write(data)
        self.size += len(data)

    def close(self) -> None:
        if self.out:
            self.out.close()
            self.files.move(self.temporary, f"{self.root}/{self.name}")
            self.done.append((self.name, self.shard, self.records, self.size))
            self.out = None


def shard_writer(root: str, roll_bytes: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Writes sorted rows; a page's revisit decisions (without payload) come before its records."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, files, page, refers, repeats = None, None, None, {}, {}
        done = []
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("shard", "page_id", "digest", "url", "payload", "refers_to"))):
                if row[0] != shard:
                    if files:
                        files.close()
                        done += files.done
                    shard, files, page = row[0], ShardFiles(root, row[0], roll_bytes), ()
                if row[1] != page:
                    page, refers, repeats = row[1], {}, {}
                if row[4] is None:
                    refers[row[2]] = row[5]
                    continue
                nth = repeats[row[2]] = repeats.get(row[2], -1) + 1
                files.add(page_record(page, row[3], row[4], refers.get(row[2]), nth))
        if files:
            files.close()
            done += files.done
        columns = zip(*done) if done else ((), (), (), ())
        types = (pa.string(), pa.int32(), pa.int64(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], ["name", "shard", "records", "bytes"])

    return run


def write(spark: SparkSession, pages: DataFrame, root: str, shard_bytes: int = SHARD_BYTES, roll_bytes: int = ROLL_BYTES) -> DataFrame:
    """Writes pages below root and returns the manifest (name, shard, records, bytes)."""
    payload = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), payload.alias("payload"))
    rows = rows.withColumn("digest", F.sha1("payload"))
    large = rows.where(F.octet_length("payload") >= LEAST_REVISITED).select("page_id", "digest")
    last = large.groupBy(F.col("digest").alias("of_digest")).agg(F.max("page_id").alias("refers_to"), F.count("*").alias("n")).where("n > 1")
    revisits = large.join(last, F.col("digest") == F.col("of_digest"))
    revisits = revisits.where("refers_to is not null and (page_id is null or page_id < refers_to)").select("page_id", "digest", "refers_to")
    total = rows.agg(F.sum(F.octet_length("payload"))).first()[0] or 0
    shards = total // shard_bytes + 1
    place = F.coalesce("page_id", F.lit(LOWEST))
    chosen = rows.select(place.alias("at")).distinct().orderBy(F.xxhash64("at"), "at").limit(SAMPLE)
    sample = np.sort(np.array([r["at"] for r in chosen.collect()], np.int64))
    bounds = sample[np.arange(1, shards) * len(sample) // shards] if len(sample) else sample

    @F.pandas_udf("int")
    def shard_of(ids: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(bounds, ids.to_numpy(), side="right").astype(np.int32))

    records = rows.select("page_id", "digest", "url", "payload", F.lit(None).cast("long").alias("refers_to"), F.lit(1).alias("kind"))
    none = [F.lit(None).cast(t).alias(c) for c, t in (("url", "string"), ("payload", "binary"))]
    both = records.unionAll(revisits.distinct().select("page_id", "digest", *none, "refers_to", F.lit(0).alias("kind")))
    both = both.withColumn("shard", shard_of(place)).repartitionById(int(shards), F.col("shard"))
    ordered = both.sortWithinPartitions("shard", "page_id", "kind", "digest", "url").drop("kind")
    made = in_batches(ordered, shard_writer(root, roll_bytes), "name string, shard int, records long, bytes long")
    return written(spark, made, "manifest")


def records_of(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each record of a compressed archive, checked against its digests."""
    with gzip.GzipFile(fileobj=stream, mode="rb") as data:
        while version := data.readline():
            if version != b"WARC/1.1\r\n":
                raise ValueError(f"not a WARC record: {version[:40]!r}")
            headers = {}
            while (line := data.readline()) != b"\r\n":
                name, _, value = line.decode().rstrip("\r\n").partition(": ")
                headers[name] = value
            block = data.read(int(headers["Content-Length"]))
            if data.read(4) != b"\r\n\r\n":
                raise ValueError(f"record {headers['WARC-Record-ID']} has the wrong length")
            if headers.get("WARC-Block-Digest", sha1(block)) != sha1(block):
                raise ValueError(f"record {headers['WARC-Record-ID']} has the wrong digest")
            yield headers, block


def page_row(headers: dict[str, str], block: bytes) -> tuple[int | None, int, str, str, int | None]:
    def page(name: str) -> int | None:
        digits = headers[name].split(":")[2]
        return int(digits) if digits else None

    digest = base64.b32decode(headers["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
    head, _, payload = block.partition(b"\r\n\r\n")
    size = int(re.search(rb"Content-Length: (\d+)", head)[1])
    if headers["WARC-Type"] == "response" and (size != len(payload) or hashlib.sha1(payload).hexdigest() != digest):
        raise ValueError(f"record {headers['WARC-Record-ID']} has the wrong payload")
    refers = page("WARC-Refers-To") if headers["WARC-Type"] == "revisit" else None
    return page("WARC-Record-ID"), size, digest, headers["WARC-Type"], refers


def read(manifest: DataFrame, root: str) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of the records in the manifest's files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, base = fs.FileSystem.from_uri(root)
        types = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
        names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
        for batch in batches:
            for name in batch.column("name").to_pylist():
                with files.open_input_stream(f"{base}/{name}", compression=None) as stream:
                    rows = [page_row(*r) for r in records_of(stream) if r[0]["WARC-Type"] in ("response", "revisit")]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

    shape = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"
    # A fixed number of partitions: names are few bytes, which adaptive execution would put in one.
    return in_batches(manifest.select("name").repartition(min(manifest.count() or 1, READERS), "name"), run, shape)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = shared_dir(spark, "warc")
    return read(write(spark, table(spark, sf_dir, "pages"), root), root)


CHECK = f"""
WITH digests AS (
  SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
marked AS (
  SELECT *, CASE WHEN payload_bytes >= {LEAST_REVISITED} THEN max(page_id) OVER (PARTITION BY payload_digest) END AS last FROM digests)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id < last THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id < last THEN last END AS refers_to
FROM marked
"""
