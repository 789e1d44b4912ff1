"""Benchmark decontamination: which words of the documents lie in passages of a benchmark.

Words are runs of letters, digits and everything beyond ASCII, A-Z lower-cased. A window
of an item is any ``width`` consecutive words of it; an item of fewer words, but not none,
is one window. A word of a document is hit where any occurrence of a window covers it.

Windows are searched for by the method of Wu and Manber, with words as symbols. Windows of
one length m share a shift table over hashed blocks of two words: how far the end of a
window may move on before that block could lie in any of them. Where it may not move, the
bucket of the block's hash, ordered by a hash of the words before it, selects the windows
to test, and these are compared word for word. Every document of a batch is cut into lanes
that advance side by side, so each step is one numpy operation for all of them.

The items are dealt by a hash of their id into blocks of about ``block_bytes`` of text. The
tables of a block are built in one task and kept as a file of the shared folder. A task
takes one block after another for the documents it holds, so its memory does not grow with
the benchmark, and all that is said of a document is found where its text is read.

Null and empty texts have no words. Rows with the same item_id are one item with the
windows of each, a null item_id counts as the empty string. Repeated and null doc_ids
are rows like any other. Empty tables give no rows, or rows without hits. Further
columns are left aside unless named in ``keys``.
"""

from __future__ import annotations

import io
import json
import math
import uuid
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vacancia.llm.common import chunks
from vacancia.llm.warc import archive_folder

# Fixed values of the contract: bytes between words become spaces, capitals small letters.
WORD_BYTES = frozenset([*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)])
FOLDED = bytes(b + 32 if 0x41 <= b <= 0x5A else b if b in WORD_BYTES else 0x20 for b in range(256))


@dataclass(frozen=True)
class Search:
    """``lane``: words of a document that are searched in one go; ``batch_bytes``: text
    that is searched side by side."""

    width: int = 10
    block_bytes: int = 8 << 20
    batch_bytes: int = 16 << 20
    lane: int = 1024


def split_words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(FOLDED).split()


def _mixed(h: np.ndarray, symbol: np.ndarray) -> np.ndarray:
    """A 64-bit hash that takes one more symbol in."""
    h = (h ^ symbol.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(29))


class Windows:
    """Shift table and buckets for distinct windows of one length, given as rows of numbers."""

    def __init__(self, rows: np.ndarray):
        self.rows = rows
        self.m = rows.shape[1]
        self.block = min(2, self.m)
        bits = max(8, int(4 * rows.size).bit_length())
        self.drop = np.uint64(64 - bits)
        last = self.m - self.block
        self.shift = np.full(1 << bits, last + 1, dtype=np.int16)
        flat, begins = rows.ravel(), np.arange(len(rows)) * self.m
        for at in range(last + 1):
            slot = self._slot(self._block_hash(flat, begins + at + self.block - 1))
            np.minimum.at(self.shift, slot, np.int16(last - at))
        keys = self._keys(flat, begins + self.m - 1)
        self.order = np.argsort(keys, kind="stable")
        self.keys = keys[self.order]

    def _block_hash(self, symbols: np.ndarray, ends: np.ndarray) -> np.ndarray:
        h = np.zeros(len(ends), dtype=np.uint64)
        for back in range(self.block):
            h = _mixed(h, symbols[ends - back])
        return h

    def _slot(self, h: np.ndarray) -> np.ndarray:
        return (h >> self.drop).astype(np.int64)

    def _keys(self, symbols: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The bucket of the last block above, the hash of the words before it below."""
        h = self._block_hash(symbols, ends)
        before = np.zeros(len(ends), dtype=np.uint64)
        for back in range(self.block, self.m):
            before = _mixed(before, symbols[ends - back])
        return (self._slot(h).astype(np.uint64) << self.drop) | (before >> (np.uint64(64) - self.drop))

    def find(self, symbols: np.ndarray, lane: int) -> tuple[np.ndarray, np.ndarray]:
        """Ends of occurrences in ``symbols``, and which window occurs there."""
        at = np.arange(0, len(symbols), lane)
        stop = np.minimum(at + lane, len(symbols))
        at = np.maximum(at, self.m - 1)
        found = []
        while True:
            going = at < stop
            if not going.all():
                at, stop = at[going], stop[going]
            if not len(at):
                break
            move = self.shift[self._slot(self._block_hash(symbols, at))]
            found.append(at[move == 0])
            at = at + np.maximum(move, 1)
        ends = np.concatenate(found) if found else np.zeros(0, dtype=np.int64)
        keys = self._keys(symbols, ends)
        low = np.searchsorted(self.keys, keys, "left")
        many = np.searchsorted(self.keys, keys, "right") - low
        ends, low = np.repeat(ends, many), np.repeat(low, many)
        nth = np.arange(len(ends)) - np.repeat(np.cumsum(many) - many, many)
        which = self.order[low + nth]
        same = np.ones(len(ends), dtype=bool)
        for back in range(self.m):
            same &= symbols[ends - back] == self.rows[which, self.m - 1 - back]
        return ends[same], which[same]


@dataclass
class Block:
    """The windows of some items: numbers of their words, and per length its ``Windows``
    with the items (numbers into ``items``) of window k at ``owners[first[k]:first[k + 1]]``."""

    numbers: dict[bytes, int]
    items: list[str]
    lengths: list[tuple[Windows, np.ndarray, np.ndarray]]


def build_block(items: Iterable[tuple[str | None, str | None]], width: int) -> Block:
    numbers: dict[bytes, int] = {}
    names: dict[str, int] = {}
    rows: dict[int, list[np.ndarray]] = {}
    owners: dict[int, list[np.ndarray]] = {}
    for item, text in items:
        words = split_words(text)
        if not words:
            continue
        ids = np.array([numbers.setdefault(w, len(numbers) + 1) for w in words], dtype=np.int32)
        m = min(width, len(ids))
        windows = np.lib.stride_tricks.sliding_window_view(ids, m)
        owner = names.setdefault(item or "", len(names))
        rows.setdefault(m, []).append(windows)
        owners.setdefault(m, []).append(np.full(len(windows), owner, dtype=np.int32))
    lengths = []
    for m in sorted(rows):
        distinct, which = np.unique(np.concatenate(rows[m]), axis=0, return_inverse=True)
        pairs = np.unique(np.stack([which.ravel(), np.concatenate(owners[m])], 1), axis=0)
        first = np.searchsorted(pairs[:, 0], np.arange(len(distinct) + 1))
        lengths.append((Windows(distinct), first, pairs[:, 1].astype(np.int32)))
    return Block(numbers, list(names), lengths)


def write_block(block: Block, path: str) -> None:
    """Arrays only; the file takes its name when it is complete."""
    arrays = {
        "words": np.frombuffer(b"\n".join(block.numbers), dtype=np.uint8),
        "items": np.frombuffer(json.dumps(block.items).encode("ascii"), dtype=np.uint8),
    }
    for windows, first, owners in block.lengths:
        arrays |= {f"{n}-{windows.m}": a for n, a in (("rows", windows.rows), ("first", first), ("owners", owners))}
    out = io.BytesIO()
    np.savez(out, **arrays)
    files, target = pafs.FileSystem.from_uri(path)
    temporary = f"{target}.{uuid.uuid4().hex}"
    with files.open_output_stream(temporary) as f:
        f.write(out.getvalue())
    files.move(temporary, target)


def read_block(path: str) -> Block:
    files, target = pafs.FileSystem.from_uri(path)
    with files.open_input_stream(target) as f:
        held = np.load(io.BytesIO(f.read()))
    words = held["words"].tobytes().split(b"\n") if len(held["words"]) else []
    items = json.loads(held["items"].tobytes())
    lengths = []
    for name in held.files:
        if name.startswith("rows-"):
            m = name.removeprefix("rows-")
            lengths.append((Windows(held[name]), held[f"first-{m}"], held[f"owners-{m}"]))
    return Block({w: k + 1 for k, w in enumerate(words)}, items, lengths)


def write_blocks(items: DataFrame, search: Search, item_id: str, text: str) -> list[str]:
    """The tables of all items as files; how many follows from the size of their texts."""
    spark = items.sparkSession
    rows = items.select(F.col(item_id).cast("string").alias("item"), F.col(text).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    n = max(1, math.ceil(size / search.block_bytes))
    folder, width = archive_folder(spark, "benchmark-blocks"), search.width
    paths = [f"{folder}/block-{k:06d}" for k in range(n)]

    def build(key: tuple, group: pa.Table) -> pa.Table:
        k = key[0].as_py()
        files, base = pafs.FileSystem.from_uri(folder)
        files.create_dir(base, recursive=True)
        pairs = zip(group.column("item").to_pylist(), group.column("text").to_pylist())
        write_block(build_block(pairs, width), paths[k])
        return pa.table({"block": pa.array([k], pa.int32())})

    dealt = rows.withColumn("block", F.pmod(F.xxhash64(F.coalesce("item", F.lit(""))), F.lit(n)).cast("int"))
    made = dealt.groupBy("block").applyInArrow(build, "block int").collect()  # numbers of files
    return [paths[k] for k in sorted(r["block"] for r in made)]


def _spans(hit: np.ndarray, begins: np.ndarray) -> list[list[dict]]:
    """Runs of hit words of each document, counted from its own first word."""
    edges = np.flatnonzero(np.diff(np.concatenate([[0], hit.view(np.int8), [0]])))
    starts, lengths = edges[::2], edges[1::2] - edges[::2]
    owner = np.searchsorted(begins, starts, "right") - 1
    out: list[list[dict]] = [[] for _ in begins]
    for doc, at, n in zip(owner.tolist(), (starts - begins[owner]).tolist(), lengths.tolist()):
        out[doc].append({"first": at, "length": n})
    return out


def search_texts(texts: Sequence[str | None], blocks: Iterable[Block], lane: int) -> list[tuple]:
    """Number of words, hit spans and sorted items of each text."""
    words = [split_words(t) for t in texts]
    sizes = np.array([len(w) for w in words], dtype=np.int64)
    begins = np.concatenate([[0], np.cumsum(sizes + 1)])[:-1]  # one place free behind each
    places = np.arange(sizes.sum()) + np.repeat(np.arange(len(words)), sizes)
    flat = [w for ws in words for w in ws]
    hit = np.zeros(int((sizes + 1).sum()), dtype=bool)
    items: list[set[str]] = [set() for _ in words]
    for block in blocks:
        symbols = np.zeros(len(hit), dtype=np.int32)
        symbols[places] = np.fromiter(map(block.numbers.get, flat, repeat(0)), np.int32, len(flat))
        for windows, first, owners in block.lengths:
            ends, which = windows.find(symbols, lane)
            for back in range(windows.m):
                hit[ends - back] = True
            doc = np.searchsorted(begins, ends, "right") - 1
            pairs = np.unique(np.stack([doc, which], 1), axis=0)
            cut = np.flatnonzero(np.diff(pairs[:, 0])) + 1
            for part in np.split(pairs, cut) if len(pairs) else ():
                owned = np.unique(np.concatenate([owners[first[k] : first[k + 1]] for k in part[:, 1]]))
                items[part[0, 0]].update(block.items[k] for k in owned.tolist())
    spans = _spans(hit, begins)
    return [(len(w), s, sorted(i)) for w, s, i in zip(words, spans, items)]


def occurrences(
    docs: DataFrame,
    items: DataFrame,
    search: Search = Search(),
    keys: Sequence[str] = ("doc_id",),
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
) -> DataFrame:
    """``keys`` of every row of ``docs`` with n_words, hits and items.

    ``hits`` are disjoint runs of words, as number of the first (from zero) and length, in
    order; ``items`` the ids with an occurring window, sorted as strings.
    """
    paths = write_blocks(items, search, item_id, item_text)
    rows = docs.select(*[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)], F.col(text).alias("text"))
    kept = rows.drop("text").schema
    named = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept)
    says = "n_words long, hits array<struct<first: int, length: int>>, items array<string>"
    span = pa.struct([("first", pa.int32()), ("length", pa.int32())])

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple[str, Block] | None = None

        def opened() -> Iterator[Block]:
            nonlocal last
            for path in paths:
                if last is None or last[0] != path:
                    last = None
                    last = path, read_block(path)
                yield last[1]

        for batch in batches:
            texts = batch.column(len(keys)).to_pylist()
            for begin, end in chunks([len(t or "") for t in texts], search.batch_bytes):
                found = search_texts(texts[begin:end], opened(), search.lane)
                n, spans, names = zip(*found)
                own = batch.slice(begin, end - begin)
                yield pa.RecordBatch.from_arrays(
                    [
                        *[own.column(i) for i in range(len(keys))],
                        pa.array(n, pa.int64()),
                        pa.array(spans, pa.list_(span)),
                        pa.array(names, pa.list_(pa.string())),
                    ],
                    [*kept.names, "n_words", "hits", "items"],
                )

    found = rows.mapInArrow(scan, f"{named}, {says}")
    return found.select(*[F.col(f"k{i}").alias(k) for i, k in enumerate(keys)], "n_words", "hits", "items")
