"""WARC archives: a deterministic sharded writer, and a reader.

Records are ordered by id and by the digest of their payload, and dealt to shards by cut
points in that order, which are quantiles of a sample chosen by a hash of both. Each shard
writes its records into one file after another, rolled by compressed size, under temporary
names, and renames a file when it is complete; what was written is listed in a manifest,
which alone tells readers which files count. Nothing in the bytes depends on time, session,
task or attempt, nor on how the input is split, so equal rows and an equal number of shards
leave equal files under equal names.

Of records with equal payloads of at least ``least`` bytes the one with the largest id
is a response, the others are revisits that refer to it and carry no payload. Null
payloads are empty, null URLs are written as an empty target. Ids should be unique:
rows with the same id and payload are equal records (both responses or revisits of the
same one). Rows without an id are spread by their payload. Further columns are ignored.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vacancia.llm.common import new_folder, partitions, stored

NAMESPACE = uuid.UUID("6f0c7cb2-54ff-4d0c-9a3c-0f3b6b1d9e11")
EMPTY_ID = "-"


@dataclass(frozen=True)
class Layout:
    """``roll_bytes``: a file takes no further record once its compressed size reaches it.
    ``date`` is written into every record, since the pages have none. ``files``: the number
    of shards, by default that of shuffle partitions; ``sample``: rows a shard that the cut
    points are taken from."""

    least: int = 0
    roll_bytes: int = 16 << 20
    level: int = 6
    date: str = "1970-01-01T00:00:00Z"
    files: int | None = None
    sample: int = 64


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode("ascii")


def record_id(row_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(NAMESPACE, f'{row_id}:{digest}')}>"


def record(
    row_id: int | None,
    url: str | None,
    payload: bytes,
    digest: str,
    refers_to: int | None,
    revisit: bool,
    date: str,
) -> bytes:
    """One record with its headers; an HTTP response is the block."""
    status = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
    http = status + b"Content-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    target = "".join(c if c > " " else "%%%02X" % ord(c) for c in url or "")
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {record_id(row_id, digest)}",
        f"WARC-Date: {date}",
        f"WARC-Target-URI: {target}",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"WARC-Block-Digest: sha1:{payload_digest(block)}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
        f"X-Row-Id: {EMPTY_ID if row_id is None else row_id}",
        f"X-Payload-Length: {len(payload)}",
    ]
    if revisit:
        head += [
            "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
            f"WARC-Refers-To: {record_id(refers_to, digest)}",
            f"X-Refers-To-Row: {refers_to}",
        ]
    return "\r\n".join(head).encode("utf-8") + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_records(content: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of each record of a file; raises if a length or digest is wrong."""
    stream = gzip.GzipFile(fileobj=io.BytesIO(content))
    while True:
        line = stream.readline()
        if not line:
            return
        if line != b"WARC/1.1\r\n":
            raise ValueError(f"not the start of a record: {line[:40]!r}")
        head: dict[str, str] = {}
        while (line := stream.readline()) not in (b"\r\n", b""):
            name, _, value = line.decode("utf-8").rstrip("\r\n").partition(": ")
            head[name] = value
        block = stream.read(int(head["Content-Length"]))
        if stream.read(4) != b"\r\n\r\n":
            raise ValueError("a record does not end where its length says")
        if head["WARC-Block-Digest"] != "sha1:" + payload_digest(block):
            raise ValueError("a block does not have its digest")
        yield head, block


# About what a record weighs besides its payload.
HEADERS = 512


def cut_points(keys: DataFrame, shards: int, sample: int) -> list[tuple[int | None, str]]:
    """Where in the order of (row_id, sha) a shard ends; shards are of like weight.

    ``sample`` keys a shard are looked at, the same ones for the same rows.
    """
    every = max(1, keys.count() // (shards * sample))
    chosen = keys.filter(F.pmod(F.xxhash64("row_id", "sha"), F.lit(every)) == 0)
    weights = chosen.groupBy("row_id", "sha").agg(F.sum(F.col("n") + HEADERS).alias("w"))
    rows = weights.orderBy("row_id", "sha").collect()
    whole, so_far, cuts = sum(r["w"] for r in rows), 0, []
    for r in rows:
        if so_far * shards >= whole * (len(cuts) + 1):
            cuts.append((r["row_id"], r["sha"]))
        so_far += r["w"]
    return cuts


def shard_of(cuts: list[tuple[int | None, str]]) -> Column:
    """How many cut points a row's (row_id, sha) has reached."""
    if not cuts:
        return F.lit(0)
    ends = F.array(*[F.struct(F.lit(k).cast("long").alias("row_id"), F.lit(d).alias("sha")) for k, d in cuts])
    own = F.struct("row_id", "sha")
    return F.size(F.filter(ends, lambda end: end <= own))


def plan_records(
    pages: DataFrame, row_id: str, url: str, payload: str, layout: Layout, shards: int
) -> DataFrame:
    """The pages with their ``shard``, and ahead of revisits a row with the response's id.

    Only digests are grouped; a payload that thousands of pages share is one key, whose
    partial maxima are taken before the shuffle. The payloads meet what was found when
    all are sorted, so they are moved once.
    """
    body = F.coalesce(F.col(payload), F.lit("")).cast("binary")
    rows = pages.select(
        F.col(row_id).cast("long").alias("row_id"), F.col(url).alias("url"), body.alias("payload")
    ).withColumn("sha", F.sha1("payload"))
    keys = stored(rows.select("row_id", "sha", F.octet_length("payload").alias("n")), "warc-digests")
    first = keys.filter(F.col("n") >= layout.least).groupBy("sha", "n").agg(
        F.max("row_id").alias("response_id"), F.count(F.lit(1)).alias("copies")
    )
    revisits = (
        keys.join(first.filter("copies > 1"), ["sha", "n"])
        .filter(~F.col("row_id").eqNullSafe(F.col("response_id")))
        .select("row_id", "sha", "response_id")
        .distinct()
    )
    none = F.lit(None)
    both = rows.withColumn("response_id", none.cast("long")).unionByName(
        revisits.select(
            "row_id", none.cast("string").alias("url"), none.cast("binary").alias("payload"), "sha", "response_id"
        )
    )
    return both.withColumn("shard", shard_of(cut_points(keys, shards, layout.sample)))


MANIFEST = "file string, records long, bytes long, first_id long, last_id long, sha256 string"


def write_archives(
    pages: DataFrame,
    folder: str,
    row_id: str = "page_id",
    url: str = "url",
    payload: str = "html",
    layout: Layout = Layout(),
) -> DataFrame:
    """Write the archives into ``folder`` and return the manifest.

    ``folder`` is a URI that pyarrow.fs opens on every executor (file, s3, hdfs, gs).
    """
    spark = pages.sparkSession
    n = layout.files or partitions(spark)
    records = plan_records(pages, row_id, url, payload, layout, n)
    ordered = records.repartitionById(n, "shard").sortWithinPartitions(
        "shard", "row_id", "sha", F.col("payload").isNotNull(), "url"
    )

    def write(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, base = pafs.FileSystem.from_uri(folder)
        files.create_dir(base, recursive=True)
        entries: list[tuple] = []
        buffer, ids, rolled, shard = io.BytesIO(), [], 0, -1

        def commit() -> None:
            nonlocal buffer, ids, rolled
            data = buffer.getvalue()
            final = f"shard-{shard:06d}-{rolled:05d}.warc.gz"
            temporary = f"{base}/.{final}.{uuid.uuid4().hex}"
            with files.open_output_stream(temporary, compression=None) as out:
                out.write(data)
            files.move(temporary, f"{base}/{final}")
            digest = hashlib.sha256(data).hexdigest()
            entries.append((final, len(ids), len(data), ids[0], ids[-1], digest))
            buffer, ids, rolled = io.BytesIO(), [], rolled + 1

        revisited, response = None, None  # the last row that tells of revisits
        for batch in batches:
            for row in batch.to_pylist():
                if row["shard"] != shard:
                    if ids:
                        commit()
                    shard, rolled = row["shard"], 0
                own = row["row_id"], row["sha"]
                if row["payload"] is None:
                    revisited, response = own, row["response_id"]
                    continue
                raw = record(
                    row["row_id"],
                    row["url"],
                    row["payload"],
                    base64.b32encode(bytes.fromhex(row["sha"])).decode("ascii"),
                    response if own == revisited else None,
                    own == revisited,
                    layout.date,
                )
                buffer.write(gzip.compress(raw, layout.level, mtime=0))
                ids.append(row["row_id"])
                if buffer.tell() >= layout.roll_bytes:
                    commit()
        if ids:
            commit()
        names = ["file", "records", "bytes", "first_id", "last_id", "sha256"]
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string()]
        columns = list(zip(*entries)) or [()] * len(names)
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

    manifest = ordered.mapInArrow(write, MANIFEST)
    manifest.write.mode("overwrite").parquet(f"{folder}/manifest")
    return read_manifest(spark, folder)


def read_manifest(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")


RECORDS = (
    "row_id long, url string, payload binary, payload_bytes long, payload_digest string, "
    "record_type string, refers_to long, file string"
)


def read_archives(spark: SparkSession, folder: str, with_payload: bool = True) -> DataFrame:
    """The records of all files the manifest lists, one task reading whole files.

    Lengths, block digests and the payload digests of responses are checked; a file whose
    bytes are not what the manifest says fails the read.
    """
    listed = read_manifest(spark, folder).select("file", "sha256", "bytes")

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, base = pafs.FileSystem.from_uri(folder)
        schema = [
            ("row_id", pa.int64()),
            ("url", pa.string()),
            ("payload", pa.binary()),
            ("payload_bytes", pa.int64()),
            ("payload_digest", pa.string()),
            ("record_type", pa.string()),
            ("refers_to", pa.int64()),
            ("file", pa.string()),
        ]

        def table(rows: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*rows)) or [()] * len(schema)
            arrays = [pa.array(c, k) for c, (_, k) in zip(columns, schema)]
            return pa.RecordBatch.from_arrays(arrays, [n for n, _ in schema])

        for batch in batches:
            for entry in batch.to_pylist():
                with files.open_input_stream(f"{base}/{entry['file']}", compression=None) as f:
                    content = f.read()
                if hashlib.sha256(content).hexdigest() != entry["sha256"]:
                    raise ValueError(f"{entry['file']} is not what the manifest lists")
                rows, held = [], 0
                for head, block in parse_records(content):
                    body = block.partition(b"\r\n\r\n")[2]
                    digest = head["WARC-Payload-Digest"].removeprefix("sha1:")
                    revisit = head["WARC-Type"] == "revisit"
                    size = int(head["X-Payload-Length"])
                    if not revisit and (len(body) != size or payload_digest(body) != digest):
                        raise ValueError(f"{entry['file']}: a payload does not have its digest")
                    own = head["X-Row-Id"]
                    to = head.get("X-Refers-To-Row")
                    rows.append(
                        (
                            None if own == EMPTY_ID else int(own),
                            head["WARC-Target-URI"],
                            None if revisit or not with_payload else body,
                            size,
                            digest,
                            head["WARC-Type"],
                            None if to is None else int(to),
                            entry["file"],
                        )
                    )
                    held += len(body) * with_payload + 200
                    if held > 4 << 20:
                        yield table(rows)
                        rows, held = [], 0
                yield table(rows)

    return listed.repartition(partitions(spark)).mapInArrow(read, RECORDS)


def archive_folder(spark: SparkSession, name: str = "warc") -> str:
    folder = new_folder(spark, name)
    return folder if "://" in folder or folder.startswith("file:") else f"file://{folder}"
