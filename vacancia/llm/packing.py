"""Packing documents into token sequences along a space-filling curve.

Each document becomes token ids and one id 0 behind them. Its vector, the sum of a
hashed random direction per id, has a few dimensions; the document's key is the place of
that vector on a Hilbert curve. Documents are range-sorted by key and their ids laid end
to end into sequences of ``length`` ids within each range, so neighbours on the curve
share sequences. What is left at the end of a range is cut into powers of two, which need
no padding.

Null text is empty text: one id. Repeated rows are packed each, ties on the curve are in
order of doc_id (nulls first). Texts of any length are cut where a sequence is full.
Further columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vacancia.llm.common import chunks, partitions, stored

SEPARATOR = 0


@dataclass(frozen=True)
class Packing:
    """``vocabulary`` is the path of a tokenizer file on every executor; ``dimensions`` x
    ``bits`` is the curve's grid. Documents move in parts of ``part`` ids, so that ranges
    of equally many rows are of like size however long some documents are."""

    vocabulary: str
    length: int = 1024
    dimensions: int = 4
    bits: int = 10
    part: int = 2048
    ranges: int | None = None


# ---- token ids

# A single space between two characters that are no white space always starts a new word of
# a byte-level vocabulary, so a long text can be cut before it.
_CUT = re.compile(r"(?<=\S) (?=\S)")
LONG = 100_000
PROBE = "It's 12 o'clock,  \n\t naïve café — \u65e5\u672c e\u0301 \U0001f600 x_y <a> ''s 'LL \x1c\x85\xa0 end "


def byte_letters() -> dict[str, int]:
    """The letters byte-level vocabularies write bytes with: printable ones for themselves,
    the others as letters from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class Words:
    """Ids of texts by the tokenizer file.

    A byte-level BPE whose merges are ranked by id is run by the quicker of two engines for
    such vocabularies, if that gives the tokenizer's own ids for a text that tries it; texts
    with special tokens and all other vocabularies are left to the tokenizer.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.n_ids = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.kind = np.dtype("<u2" if self.n_ids <= 1 << 16 else "<u4")
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.quick = self.engine()

    def engine(self):
        import public_tokenizers
        import tiktoken

        letters = byte_letters()
        vocabulary = {w: i for w, i in self.tokenizer.get_vocab(with_added_tokens=False).items() if w not in self.special}
        if not all(c in letters for w in vocabulary for c in w):
            return None
        ranks = {bytes(letters[c] for c in w): i for w, i in vocabulary.items()}
        if not all(bytes([b]) in ranks for b in range(256)):
            return None
        pattern = public_tokenizers.PATTERN
        made = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        probe = PROBE * 3
        own = self.tokenizer.encode(probe, add_special_tokens=False).ids
        return made if made.encode_ordinary(probe) == own else None

    def whole(self, text: str) -> bytes:
        ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        return np.array(ids, dtype=self.kind).tobytes()

    def parts(self, text: str) -> Iterator[str]:
        """A long text cut where that changes no ids."""
        begin = 0
        while len(text) - begin > LONG:
            cut = _CUT.search(text, begin + LONG)
            if cut is None:
                break
            yield text[begin : cut.start()]
            begin = cut.start()
        yield text[begin:]

    def ids(self, texts: list[str]) -> list[bytes]:
        """Little-endian ids of each text, without the separator."""
        out = []
        for text in texts:
            if self.quick is None or any(s in text for s in self.special):
                out.append(self.whole(text))
            elif len(text) <= LONG:
                out.append(np.array(self.quick.encode_ordinary(text), dtype=self.kind).tobytes())
            else:
                found = [
                    self.whole(p) if len(p) > 2 * LONG else np.array(self.quick.encode_ordinary(p), self.kind).tobytes()
                    for p in self.parts(text)
                ]
                out.append(b"".join(found))
        return out


@lru_cache(maxsize=2)
def words_of(path: str) -> Words:
    return Words(path)


# ---- the curve


def hilbert_keys(points: np.ndarray, bits: int) -> np.ndarray:
    """Place on the Hilbert curve of points (n x d, integers below ``2**bits``).

    Skilling's transform, on all points at once: undo the rotations of each level from
    the top, Gray-decode, and interleave the bits.
    """
    x = points.astype(np.int64).T.copy()
    d = len(x)
    level = 1 << (bits - 1)
    while level > 1:
        mask = level - 1
        for i in range(d):
            high = (x[i] & level) != 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & mask)
            x[0] ^= np.where(high, mask, swap)
            x[i] ^= swap
        level >>= 1
    for i in range(1, d):
        x[i] ^= x[i - 1]
    turn = np.zeros_like(x[0])
    level = 1 << (bits - 1)
    while level > 1:
        turn ^= np.where((x[d - 1] & level) != 0, level - 1, 0)
        level >>= 1
    x ^= turn
    key = np.zeros_like(x[0])
    for bit in range(bits - 1, -1, -1):
        for i in range(d):
            key = (key << 1) | ((x[i] >> bit) & 1)
    return key


@lru_cache(maxsize=2)
def directions(n_ids: int, dimensions: int) -> np.ndarray:
    """A fixed direction per id: hashed signs."""
    ids = np.arange(n_ids, dtype=np.uint64)
    out = np.empty((n_ids, dimensions), dtype=np.float32)
    with np.errstate(over="ignore"):
        for k in range(dimensions):
            h = (ids + np.uint64(k + 1)) * np.uint64(0x9E3779B97F4A7C15)
            h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            h = (h ^ (h >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)
            out[:, k] = np.where((h >> np.uint64(63)) != 0, 1.0, -1.0)
    return out


def curve_keys(ids: list[np.ndarray], n_ids: int, dimensions: int, bits: int) -> np.ndarray:
    """Curve key of each document: its mean direction, spread over the grid by its spread."""
    rows = directions(n_ids, dimensions)
    sums = np.zeros((len(ids), dimensions))
    for i, own in enumerate(ids):
        if len(own):
            counts = np.zeros(dimensions)
            for begin in range(0, len(own), 1 << 18):
                counts += rows[own[begin : begin + (1 << 18)]].sum(axis=0, dtype=np.float64)
            sums[i] = counts / np.sqrt(len(own))
    # A sum of n signs over the root of n has a spread near one; repeats widen it. The
    # arctangent takes every value into the grid.
    grid = (np.arctan(sums / 4.0) / np.pi + 0.5) * (1 << bits)
    return hilbert_keys(np.clip(grid.astype(np.int64), 0, (1 << bits) - 1), bits)


# ---- tokens and sequences


def tokens(docs: DataFrame, setup: Packing, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The parts of each document's ids, the separator included, in rows of their own.

    ``curve`` is the document's key, ``mark`` a checksum that tells rows with one doc_id
    apart, ``start`` the number of ids before the part, ``total`` that of all.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = words_of(setup.vocabulary)
        end = np.array([SEPARATOR], dtype=words.kind).tobytes()
        size = words.kind.itemsize
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for begin, stop in chunks([len(t) for t in texts], 4 << 20):
                found = [b + end for b in words.ids(texts[begin:stop])]
                arrays = [np.frombuffer(b, dtype=words.kind)[:-1] for b in found]
                keys = curve_keys(arrays, words.n_ids, setup.dimensions, setup.bits)
                owners, starts, parts = [], [], []
                for i, ids in enumerate(found):
                    for at in range(0, len(ids), setup.part * size):
                        owners.append(i)
                        starts.append(at // size)
                        parts.append(ids[at : at + setup.part * size])
                own = pa.array(owners, pa.int64())
                whole = [
                    batch.column(0).slice(begin, stop - begin),
                    pa.array(keys, pa.int64()),
                    pa.array([zlib.crc32(b) for b in found], pa.int64()),
                    pa.array([len(b) // size for b in found], pa.int64()),
                ]
                columns = [c.take(own) for c in whole] + [
                    pa.array(starts, pa.int64()),
                    pa.array(parts, pa.binary()),
                ]
                yield pa.RecordBatch.from_arrays(
                    columns, ["doc_id", "curve", "mark", "total", "start", "ids"]
                )

    return rows.mapInArrow(
        run, "doc_id long, curve long, mark long, total long, start long, ids binary"
    )


PIECES = [
    ("doc_id", "long", pa.int64()),
    ("start", "long", pa.int64()),
    ("length", "long", pa.int64()),
    ("ids_crc32", "long", pa.int64()),
    ("doc_tokens", "long", pa.int64()),
    ("sequence_id", "long", pa.int64()),
    ("offset", "long", pa.int64()),
    ("sequence_length", "long", pa.int64()),
    ("ids", "binary", pa.binary()),
]


def tail_cuts(rest: int) -> list[int]:
    """``rest`` as powers of two, the largest first."""
    return [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]


class Sequences:
    """Lays documents end to end; pieces come out when the length of their sequence is known."""

    def __init__(self, first_sequence: int, length: int):
        self.length, self.sequence, self.used = length, first_sequence, 0
        self.open: list[tuple] = []  # pieces of the sequence that is being filled
        self.done: list[tuple] = []

    def add(self, doc_id: int | None, start: int, ids: np.ndarray, total: int) -> None:
        """A part of a document; one that follows the last piece goes on with it."""
        while len(ids):
            take = ids[: self.length - self.used]
            last = self.open[-1] if self.open else None
            if last and last[0] == doc_id and last[3] == total and last[1] + len(last[2]) == start:
                self.open[-1] = (doc_id, last[1], np.concatenate([last[2], take]), total)
            else:
                self.open.append((doc_id, start, take, total))
            self.used += len(take)
            start, ids = start + len(take), ids[len(take) :]
            if self.used == self.length:
                self.close([self.length])

    def close(self, sizes: list[int]) -> None:
        """End the open pieces' sequence, as sequences of the given sizes."""
        pending = self.open[::-1]
        for size in sizes:
            offset = 0
            while offset < size:
                doc_id, start, ids, total = pending.pop()
                take = min(len(ids), size - offset)
                if take < len(ids):
                    pending.append((doc_id, start + take, ids[take:], total))
                part = ids[:take]
                crc = zlib.crc32(part.astype("<u4").tobytes())
                raw = part.tobytes()
                self.done.append(
                    (doc_id, start, take, crc, total, self.sequence, offset, size, raw)
                )
                offset += take
            self.sequence += 1
        self.open, self.used = [], 0


def pack(
    docs: DataFrame,
    setup: Packing,
    text: str = "text",
    doc_id: str = "doc_id",
    with_ids: bool = False,
) -> DataFrame:
    """One row per piece, with the ids of the piece if asked for.

    A range of the curve is one task that holds one open sequence; a document may go on in
    the next range.
    Sequence numbers begin at the range's number times ``2**40``.
    """
    spark = docs.sparkSession
    n = setup.ranges or partitions(spark)
    # Finding the ranges reads the rows once more, so they are not made twice.
    rows = stored(tokens(docs, setup, text, doc_id), "tokens", "zstd")
    order = ["curve", "doc_id", "mark", "start"]
    ordered = rows.repartitionByRange(n, *order).sortWithinPartitions(*order)
    columns = PIECES if with_ids else PIECES[:-1]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        kind = words_of(setup.vocabulary).kind
        sequences = Sequences(TaskContext.get().partitionId() << 40, setup.length)

        def made() -> pa.RecordBatch:
            values = list(zip(*sequences.done)) or [()] * len(PIECES)
            sequences.done = []
            arrays = [pa.array(v, k) for v, (_, _, k) in zip(values, columns)]
            return pa.RecordBatch.from_arrays(arrays, [c for c, _, _ in columns])

        for batch in batches:
            named = [batch.column(i).to_pylist() for i in (0, 3, 4)]
            for own, total, start, ids in zip(*named, batch.column(5)):
                sequences.add(own, start, np.frombuffer(ids.as_buffer(), dtype=kind), total)
                if len(sequences.done) > 20_000:
                    yield made()
        if sequences.used:
            sequences.close(tail_cuts(sequences.used))
        yield made()

    return ordered.mapInArrow(run, ", ".join(f"{c} {k}" for c, k, _ in columns))
