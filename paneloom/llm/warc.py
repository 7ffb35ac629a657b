"""Deterministic sharded WARC archives.

Pages are dealt to shards by ranges of their id, with bounds taken from a hash
sample, and sorted inside; a shard's records depend on the pages only. Every record
is a gzip member of its own with headers and digests made anew; a file is closed
before it would pass `roll_bytes` compressed. Files are written under names that no
other attempt uses, listed in a manifest, moved to their final names, and listed
again: only what the final manifest names belongs to the archive, whatever attempts
were lost on the way. All files go through `pyarrow.fs` below the shared folder.

Of records with equal payloads of `least` bytes or more, that with the largest id
holds the payload and the others are revisits of it. A null payload is empty, a null
url is left out, rows with a null id come first. Of rows that repeat both id and
payload the first is written in full. An empty table gives an archive without files.
"""

from __future__ import annotations

import base64
import hashlib
import io
import uuid
import zlib
from collections.abc import Iterator
from datetime import datetime, timezone

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, functions as F

from paneloom.session import work_path

NAMESPACE = uuid.UUID("6f1c3d52-7e0b-5b64-9d57-2f6a0c1f4e11")
_MANIFEST = "name string, temp string, shard int, seq int, records bigint, bytes bigint, sha1 string"
_LOWEST = -(1 << 63)


def _open(folder: str):
    """The file system of a folder's address, and its path there."""
    return fs.FileSystem.from_uri(folder)


def _one_line(value: str) -> str:
    return value.replace("\r", "%0D").replace("\n", "%0A")


def record(kind: str, headers: list[tuple[str, str]], block: bytes) -> bytes:
    """A WARC/1.1 record as one gzip member; no time of writing, so the bytes depend on the content only."""
    head = [("WARC-Type", kind), *headers, ("WARC-Block-Digest", "sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode()),
            ("Content-Length", str(len(block)))]
    body = ("WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head) + "\r\n").encode() + block + b"\r\n\r\n"
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(body) + packer.flush()


def record_id(page: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(NAMESPACE, f'{page}/{digest}')}>"


def page_record(page: int | None, url: str | None, payload: bytes, digest: str, original: int | None, revisit: bool, date: str) -> bytes:
    """The response record of a page, or its revisit of the original's payload."""
    head = [("WARC-Record-ID", record_id(page, f"{digest}/{revisit}")), ("WARC-Date", date)]
    if url is not None:
        head.append(("WARC-Target-URI", _one_line(url)))
    if page is not None:
        head.append(("X-Page-ID", str(page)))
    head += [("Content-Type", "application/http; msgtype=response"),
             ("WARC-Payload-Digest", "sha1:" + base64.b32encode(bytes.fromhex(digest)).decode()), ("X-Payload-Length", str(len(payload)))]
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    if not revisit:
        return record("response", head, http + payload)
    head += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
             ("WARC-Refers-To", record_id(original, f"{digest}/False"))]
    if original is not None:
        head.append(("X-Refers-To-Page", str(original)))
    return record("revisit", head, http)


class _Roller:
    """Files of one shard: named by attempt while open, closed before they grow too large."""

    def __init__(self, folder: str, prefix: str, shard: int, roll_bytes: int, date: str):
        self.system, self.root = _open(folder)
        self.prefix, self.shard, self.roll, self.date = prefix, shard, roll_bytes, date
        self.attempt, self.seq, self.out, self.rows = uuid.uuid4().hex, 0, None, []

    def add(self, member: bytes) -> None:
        if self.out is not None and self.size + len(member) > self.roll:
            self.close()
        if self.out is None:
            self.name = f"{self.prefix}-{self.shard:06d}-{self.seq:04d}.warc.gz"
            self.temp = f"_temporary/{self.name}.{self.attempt}"
            self.out = self.system.open_output_stream(f"{self.root}/{self.temp}", compression=None)
            self.size, self.records, self.sum = 0, 0, hashlib.sha1()
            self._put(record("warcinfo", [("WARC-Record-ID", record_id(None, self.name)), ("WARC-Date", self.date),
                                          ("WARC-Filename", self.name), ("Content-Type", "application/warc-fields")],
                             b"format: WARC File Format 1.1\r\n"))
        self._put(member)
        self.records += 1

    def _put(self, member: bytes) -> None:
        self.out.write(member)
        self.sum.update(member)
        self.size += len(member)

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
            self.rows.append((self.name, self.temp, self.shard, self.seq, self.records, self.size, self.sum.hexdigest()))
            self.out, self.seq = None, self.seq + 1


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], type=t) for i, t in enumerate(kinds)],
                                      names=[c.split()[0] for c in _MANIFEST.split(", ")])


class _Shards:
    """Shard of an id: ranges of about equal bytes, from a hash sample whose size does not grow with the pages.

    The sample cuts the ids into at most `knots` ranges. More shards than that divide each range evenly by id.
    """

    def __init__(self, pages: DataFrame, shard_bytes: int, samples: int = 32, knots: int = 4096):
        total, count, low, high = pages.agg(F.sum("bytes"), F.count(F.lit(1)), F.min("at"), F.max("at")).first()
        self.count = -(-(total or 0) // shard_bytes) or 1
        self.low, self.high, ranges = low, high, min(self.count, knots)
        self.bounds = np.zeros(0, np.int64)
        if ranges > 1:
            share = min(1.0, samples * ranges / count)
            rows = pages.where(F.pmod(F.xxhash64("page_id"), F.lit(1 << 30)) < int(share * (1 << 30))).select(
                "at", "bytes").orderBy("at", "bytes").collect()  # about samples x knots ids at most
            upto = np.cumsum([r["bytes"] + 1 for r in rows])
            cuts = np.searchsorted(upto, upto[-1] * np.arange(1, ranges) / ranges) if rows else []
            self.bounds = np.unique(np.array([rows[i]["at"] for i in cuts], np.int64))
        if self.count <= knots:
            self.count = len(self.bounds) + 1

    def of(self, ids: np.ndarray) -> np.ndarray:
        place = np.searchsorted(self.bounds, ids, side="right")
        if self.count == len(self.bounds) + 1:
            return place.astype(np.int32)
        edges = np.concatenate(([self.low], self.bounds, [self.high])).astype(float)
        width = np.maximum(edges[place + 1] - edges[place], 1.0)
        inside = np.clip((ids.astype(float) - edges[place]) / width, 0.0, np.nextafter(1.0, 0.0))
        return np.minimum((place + inside) * self.count / (len(self.bounds) + 1), self.count - 1).astype(np.int32)


def _by_file(files: DataFrame, most_tasks: int = 100_000) -> DataFrame:
    """Listed files dealt by their number, a task each: adaptive execution would put so few rows into one."""
    shards, width = files.agg(F.coalesce(F.max("shard"), F.lit(0)) + 1, F.coalesce(F.max("seq"), F.lit(0)) + 1).first()
    tasks = min(shards * width, most_tasks)
    return files.repartitionById(tasks, ((F.col("shard").cast("bigint") * width + F.col("seq")) % tasks).cast("int"))


def write_archive(pages: DataFrame, folder: str, prefix: str = "pages", shard_bytes: int = 1 << 25, roll_bytes: int = 1 << 24,
                  least: int = 1000, date: datetime = datetime(2000, 1, 1, tzinfo=timezone.utc)) -> DataFrame:
    """Write page_id, url and html as records below `folder`; the manifest of what was committed."""
    spark = pages.sparkSession
    payload = F.coalesce("html", F.lit("")).cast("binary")
    at = F.coalesce("page_id", F.lit(_LOWEST)).alias("at")
    slim = pages.select("page_id", at, F.sha1(payload).alias("digest"), F.length(payload).cast("bigint").alias("bytes"))
    groups = slim.where(F.col("bytes") >= least).groupBy("digest", "bytes").agg(
        F.max("page_id").alias("original"), F.count(F.lit(1)).alias("n")).where("n > 1")
    repeats = slim.join(groups, ["digest", "bytes"]).select("page_id", "at", "digest", "original")

    shards = _Shards(slim, shard_bytes)

    @F.pandas_udf("int")
    def shard_of(ids: pd.Series) -> pd.Series:
        return pd.Series(shards.of(ids.to_numpy()))

    # Decisions sort before the pages they are about: the writer meets both in one pass over one shuffle.
    none = lambda kind: F.lit(None).cast(kind)
    rows = repeats.select("page_id", "at", F.lit(0).alias("kind"), "digest", "original", none("string").alias("url"), none("binary").alias("payload")).union(
        pages.select("page_id", at, F.lit(1), none("string"), none("bigint"), "url", payload))
    dealt = rows.withColumn("shard", shard_of("at")).repartitionById(shards.count, F.col("shard")).sortWithinPartitions(
        "shard", "at", "kind", "digest", "url", "payload")
    stamp = date.strftime("%Y-%m-%dT%H:%M:%SZ")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        roller, here, originals, written = None, None, {}, set()
        for batch in batches:
            for page, key, kind, digest, original, url, body, shard in zip(*[c.to_pylist() for c in batch.columns]):
                if roller is None or roller.shard != shard:
                    if roller is not None:
                        roller.close()
                        yield _batch(roller.rows)
                    roller = _Roller(folder, prefix, shard, roll_bytes, stamp)
                if key != here:
                    here, originals, written = key, {}, set()
                if kind == 0:
                    originals[digest] = original
                    continue
                digest = hashlib.sha1(body).hexdigest()
                revisit = digest in originals and (originals[digest] != page or digest in written)
                written.add(digest)
                roller.add(page_record(page, url, body, digest, originals.get(digest), revisit, stamp))
        if roller is not None:
            roller.close()
            yield _batch(roller.rows)

    system, root = _open(folder)
    system.create_dir(f"{root}/_temporary")
    attempt = f"{folder}/_written"
    dealt.mapInArrow(write, _MANIFEST).write.parquet(attempt)
    manifest = f"{folder}/_manifest"
    _by_file(spark.read.schema(_MANIFEST).parquet(attempt)).mapInArrow(_committer(folder), _MANIFEST).write.parquet(manifest)
    return spark.read.schema(_MANIFEST).parquet(manifest)


def _committer(folder: str):
    """Moves listed files to their final names; a move that an earlier attempt made is left as it is."""
    def commit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = _open(folder)
        for batch in batches:
            for name, temp, *_, size, _ in zip(*[c.to_pylist() for c in batch.columns]):
                if system.get_file_info(f"{root}/{temp}").type == fs.FileType.File:
                    system.move(f"{root}/{temp}", f"{root}/{name}")
                if system.get_file_info(f"{root}/{name}").size != size:
                    raise IOError(f"{name} is not the file that the manifest lists")
            yield batch
    return commit


def _members(stream) -> Iterator[bytes]:
    """The gzip members of a stream, one whole record each."""
    held = stream.read(1 << 20)
    while held:
        reader, out = zlib.decompressobj(31), io.BytesIO()
        while not reader.eof:
            if not held:
                raise IOError("a record is cut off")
            out.write(reader.decompress(held))
            held = reader.unused_data if reader.eof else stream.read(1 << 20)
        yield out.getvalue()
        held = held or stream.read(1 << 20)


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and block of a record, the block held against its length and digest."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    headers = dict(line.split(": ", 1) for line in lines[1:])
    block = rest[:int(headers["Content-Length"])]
    if headers["WARC-Block-Digest"] != "sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode():
        raise ValueError("a block does not have its digest")
    return headers, block


_READ = "page_id bigint, url string, record_type string, payload_bytes bigint, payload_digest string, refers_to bigint"


def read_archive(spark: SparkSession, folder: str, payload: bool = False) -> DataFrame:
    """Records of the files in the final manifest; payloads are verified, and returned if asked for."""
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = _open(folder)
        kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64()] + [pa.binary()] * payload
        names = [c.split()[0] for c in _READ.split(", ")] + ["payload"] * payload

        def emit(rows):
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], type=t) for i, t in enumerate(kinds)], names=names)

        for batch in batches:
            for name in batch.column(0).to_pylist():
                rows, held = [], 0
                with system.open_input_stream(f"{root}/{name}", compression=None) as stream:
                    for raw in _members(stream):
                        headers, block = parse(raw)
                        if headers["WARC-Type"] == "warcinfo":
                            continue
                        rows.append(_row(headers, block, payload))
                        held += len(rows[-1][-1] or b"") if payload else 0
                        if len(rows) >= 10_000 or held > 1 << 26:
                            yield emit(rows)
                            rows, held = [], 0
                yield emit(rows)

    files = _by_file(spark.read.schema(_MANIFEST).parquet(f"{folder}/_manifest"))
    return files.select("name").mapInArrow(read, _READ + ", payload binary" * payload)


def _row(headers: dict[str, str], block: bytes, payload: bool) -> tuple:
    kind, body = headers["WARC-Type"], block.partition(b"\r\n\r\n")[2]
    digest = base64.b32decode(headers["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
    size = int(headers["X-Payload-Length"])
    if kind == "response" and (len(body) != size or hashlib.sha1(body).hexdigest() != digest):
        raise ValueError("a payload does not have its digest")
    number = lambda name: int(headers[name]) if name in headers else None
    return (number("X-Page-ID"), headers.get("WARC-Target-URI"), kind, size, digest, number("X-Refers-To-Page"),
            *([body if kind == "response" else None] if payload else []))


def archive_folder(spark: SparkSession) -> str:
    return work_path(spark, "warc")
