"""Stupid-backoff scores of documents under a trigram model of the whole corpus.

Every word, pair and triple of neighbouring words counts; nothing is left out of the model.
With c counting over all rows and c' over all but the row that is scored, a word w after u v
scores

    c'(u v w) / c(u v)                    if c'(u v w) > 0, else
    backoff * c'(v w) / c(v)              if c'(v w) > 0, else
    backoff * backoff * c(w) / c(all),

with one factor less where there are fewer words before it. A document's score is the sum
of the logarithms, its mean the sum over its number of words.

N-grams are known by 56-bit hashes; of ten billion of them one in seven million shares another's. A task counts those of a batch of rows, sorts them and
sends them to buckets of the hash, of which there are so many that each holds about
``bucket_bytes`` of text. A bucket's task adds up its counts, whatever batch they came from,
which is its part of the count table, joins them to what was asked, and answers each batch
in the order of its own hashes. The rows are then read once more, exploded again into the
same batches, and each position is scored from the answers. A hot n-gram is one number of
each batch, texts are never shuffled, and no task holds more than a batch or a bucket. The
second reading has to meet the same batches, as it does for tables that are read from files;
a batch whose hashes have no fitting answer raises an error.

Words are runs without white space, A-Z lower-cased. Null text is empty text; a document
without words has no score (null). Each row is scored by itself, whether its doc_id is
null, repeated or not. Further columns are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from urllib.parse import unquote

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vacancia.llm.common import chunks, partitions
from vacancia.llm.warc import archive_folder

ORDERS = 3
SPARED = np.uint64(8)  # bits of a hash that are not kept


@dataclass(frozen=True)
class Model:
    """``batch_bytes``: text whose n-grams are counted together; ``bucket_bytes``: text whose
    n-grams, on average, one bucket holds."""

    backoff: float = 0.4
    batch_bytes: int = 5 << 20
    bucket_bytes: int = 4 << 20


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """The words of all texts, one after another, as hashes, and how many each text has."""
    seen: dict[bytes, int] = {}
    sizes, parts = [], []
    for text in texts:
        words = (text or "").encode("utf-8", "surrogatepass").lower().split()
        for w in set(words).difference(seen):
            seen[w] = xxhash.xxh64_intdigest(w, 42)
        parts.append(np.fromiter(map(seen.__getitem__, words), dtype=np.uint64, count=len(words)))
        sizes.append(len(words))
    return np.concatenate(parts) if parts else np.zeros(0, np.uint64), np.array(sizes, dtype=np.int64)


class Grams:
    """The n-grams that end at each word of some texts, as hashes; those of order k are
    there where a text has k words up to it."""

    def __init__(self, texts: list[str | None]):
        words, self.sizes = word_hashes(texts)
        self.begins = np.cumsum(self.sizes) - self.sizes
        at = np.arange(len(words)) - np.repeat(self.begins, self.sizes)
        hashes = _mix(words)
        self.places, self.hashes = [np.arange(len(words))], [hashes >> SPARED]
        for k in range(1, ORDERS):
            longer = np.zeros_like(hashes)
            longer[1:] = _mix(hashes[:-1] * np.uint64(3) + words[1:])
            here = np.flatnonzero(at >= k)
            self.places.append(here)
            self.hashes.append(longer[here] >> SPARED)
            hashes = longer

    def counted(self) -> tuple[np.ndarray, np.ndarray]:
        """All distinct hashes, sorted, and how often each occurs."""
        return np.unique(np.concatenate(self.hashes), return_counts=True)

    def placed(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """As ``counted``, with the number of each n-gram's hash between, order after order."""
        return np.unique(np.concatenate(self.hashes), return_inverse=True, return_counts=True)

    def own_counts(self, order: int, which: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """How often each n-gram (by number ``which``) occurs in its own text."""
        out = np.ones(len(which), dtype=np.int64)
        again = np.flatnonzero(counts[which] > 1)
        if len(again):
            owner = np.repeat(np.arange(len(self.sizes)), self.sizes)[self.places[order][again]]
            _, run, many = np.unique(
                owner * np.int64(len(counts)) + which[again], return_inverse=True, return_counts=True
            )
            out[again] = many[run]
        return out


def bucket_edges(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """Where each bucket begins among sorted hashes, and the end."""
    own = ((hashes >> np.uint64(24)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
    return np.searchsorted(own, np.arange(buckets + 1))


def _batches(batches: Iterable[pa.RecordBatch], size: int) -> Iterator[tuple[pa.Array, list]]:
    """Ids and texts, about ``size`` characters at a time."""
    ids: list[pa.Array] = []
    texts: list[str | None] = []
    held = 0
    for batch in batches:
        found = batch.column(1).to_pylist()
        for begin, end in chunks([len(t or "") for t in found], size):
            more = sum(len(t or "") for t in found[begin:end])
            if texts and held + more > size:
                yield pa.concat_arrays(ids), texts
                ids, texts, held = [], [], 0
            ids.append(batch.column(0).slice(begin, end - begin))
            texts += found[begin:end]
            held += more
    if texts:
        yield pa.concat_arrays(ids), texts


def _packed(hashes: np.ndarray) -> bytes:
    """Sorted hashes as steps, byte by byte, so that what is compressed has long runs."""
    steps = np.diff(hashes, prepend=np.uint64(0))
    return zlib.compress(steps.view(np.uint8).reshape(-1, 8).T.tobytes(), 1)


def _unpacked(raw: bytes) -> np.ndarray:
    planes = np.frombuffer(zlib.decompress(raw), dtype=np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view(np.uint64).ravel(), dtype=np.uint64)


def _numbers(values: np.ndarray) -> bytes:
    """Counts in a byte each; those of 255 and more follow in eight."""
    large = values[values >= 255]
    return np.minimum(values, 255).astype(np.uint8).tobytes() + large.astype("<i8").tobytes()


def _counts(raw: bytes, n: int) -> np.ndarray:
    values = np.frombuffer(raw, dtype=np.uint8, count=n).astype(np.int64)
    values[values == 255] = np.frombuffer(raw, dtype="<i8", offset=n)
    return values


ASKED = "part int, batch int, bucket int, words long, hashes binary, counts binary"
ANSWERED = "part int, batch int, bucket int, words long, check long, totals binary"


def _schema(spec: str) -> tuple[list[str], list[pa.DataType]]:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    fields = [f.split() for f in spec.split(", ")]
    return [n for n, _ in fields], [kinds[k] for _, k in fields]


def _table(rows: list[tuple], spec: str) -> pa.RecordBatch:
    names, kinds = _schema(spec)
    columns = list(zip(*rows)) or [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)


def _check(hashes: np.ndarray) -> int:
    """Of the hashes that were asked for, to tell that an answer fits."""
    return int(np.bitwise_xor.reduce(hashes, initial=np.uint64(0)) >> np.uint64(1))


def asked(rows: DataFrame, model: Model, buckets: int) -> DataFrame:
    """For each batch and bucket the distinct hashes, sorted, with the batch's counts."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        for k, (_, texts) in enumerate(_batches(batches, model.batch_bytes)):
            grams = Grams(texts)
            hashes, counts = grams.counted()
            edges = bucket_edges(hashes, buckets)
            n = int(grams.sizes.sum())
            out = [
                (part, k, b, n if b == 0 else 0, _packed(hashes[i:j]), _numbers(counts[i:j]))
                for b, (i, j) in enumerate(zip(edges, edges[1:]))
                if j > i or b == 0
            ]
            for begin, end in chunks([len(r[4]) for r in out], 4 << 20):
                yield _table(out[begin:end], ASKED)

    return rows.mapInArrow(run, ASKED)


def answered(requests: DataFrame) -> DataFrame:
    """The counts over all batches, for each request in the order of its hashes."""

    def add_up(group: pa.Table) -> pa.Table:
        rows = group.to_pylist()
        hashes = [_unpacked(r["hashes"]) for r in rows]
        _, which = np.unique(np.concatenate(hashes), return_inverse=True)
        counts = np.concatenate([_counts(r["counts"], len(h)) for r, h in zip(rows, hashes)])
        table = np.zeros(int(which.max(initial=-1)) + 1, dtype=np.int64)
        np.add.at(table, which, counts)
        totals, at, out = table[which], 0, []
        for r, h in zip(rows, hashes):
            own = totals[at : at + len(h)]
            out.append((r["part"], r["batch"], r["bucket"], r["words"], _check(h), _numbers(own)))
            at += len(h)
        return pa.Table.from_batches([_table(out, ANSWERED)])

    return requests.groupBy("bucket").applyInArrow(add_up, ANSWERED)


def _of_part(folder: str, part: int) -> Iterator[tuple[int, list[dict]]]:
    """The answers to each batch of a part, in order."""
    files, base = pafs.FileSystem.from_uri(folder)
    listed = files.get_file_info(pafs.FileSelector(f"{base}/part={part}", allow_not_found=True))
    names = sorted(unquote(f.path) for f in listed if f.path.endswith(".parquet"))
    batch, held = None, []
    for name in names:
        with files.open_input_file(name) as source:
            for group in pq.ParquetFile(source).iter_batches(batch_size=256):
                for row in group.to_pylist():
                    if row["batch"] != batch:
                        if held:
                            yield batch, held
                        batch, held = row["batch"], []
                    held.append(row)
    if held:
        yield batch, held


def log_scores(
    grams: Grams, totals: np.ndarray, which: np.ndarray, counts: np.ndarray, words: int, backoff: float
) -> tuple[np.ndarray, np.ndarray]:
    """Logarithm of each word's score, and the order of the n-gram that it comes from."""
    at, n = len(grams.hashes[0]), len(grams.places[0])
    before = totals[which[:at]]  # of the n-gram of the last order that ends at a word
    score = np.log(before) - math.log(max(words, 1))
    order = np.ones(n, dtype=np.int8)
    for k in range(1, ORDERS):
        here = grams.places[k]
        own = which[at : at + len(here)]
        at += len(here)
        count = np.zeros(n, dtype=np.int64)
        count[here] = totals[own]
        others = count[here] - grams.own_counts(k, own, counts)
        score[here] += math.log(backoff)
        seen = here[others > 0]
        score[seen] = np.log(others[others > 0]) - np.log(before[seen - 1])
        order[seen] = k + 1
        before = count
    return score, order


SCORED = "doc_id long, n_words long, n_pairs_seen long, n_triples_seen long, log_score double"


def scores(
    docs: DataFrame, model: Model = Model(), text: str = "text", doc_id: str = "doc_id"
) -> DataFrame:
    """doc_id, n_words, n_pairs_seen, n_triples_seen, log_score and mean_log_score of each row.

    The counts of pairs and triples are those of words scored from them.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    buckets = max(1, math.ceil(size / model.bucket_bytes))
    folder = archive_folder(spark, "ngram-counts")
    # Of each part one task writes all answers, sorted by batch and bucket.
    answers = answered(asked(rows, model, buckets)).repartition(partitions(spark), "part")
    answers.sortWithinPartitions("part", "batch", "bucket").write.partitionBy("part").parquet(folder)
    spec = ANSWERED.replace("part int, ", "") + ", part int"
    words = spark.read.schema(spec).parquet(folder).agg(F.sum("words").alias("n")).first()["n"] or 0

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        answers = _of_part(folder, TaskContext.get().partitionId())
        for k, (ids, texts) in enumerate(_batches(batches, model.batch_bytes)):
            grams = Grams(texts)
            hashes, which, counts = grams.placed()
            edges = bucket_edges(hashes, buckets)
            batch, found = next(answers, (-1, []))
            asked_for = [(b, hashes[i:j]) for b, (i, j) in enumerate(zip(edges, edges[1:])) if j > i or b == 0]
            fits = [(b, _check(h)) for b, h in asked_for] == [(r["bucket"], r["check"]) for r in found]
            if batch != k or not fits:
                raise ValueError("the rows were not met again in the batches in which they were counted")
            parts = [_counts(r["totals"], len(h)) for r, (_, h) in zip(found, asked_for)]
            score, order = log_scores(grams, np.concatenate(parts), which, counts, words, model.backoff)
            per_row = [np.add.reduceat(np.append(v, 0), grams.begins) for v in (score, order == 2, order == 3)]
            some = grams.sizes > 0
            seen = [np.where(some, v, 0).astype(np.int64) for v in per_row[1:]]
            arrays = [ids, pa.array(grams.sizes), *map(pa.array, seen), pa.array(per_row[0], mask=~some)]
            yield pa.RecordBatch.from_arrays(arrays, [f.split()[0] for f in SCORED.split(", ")])

    return rows.mapInArrow(run, SCORED).withColumn("mean_log_score", F.col("log_score") / F.col("n_words"))
