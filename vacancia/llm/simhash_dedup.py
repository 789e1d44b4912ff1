"""SimHash near-duplicates by pigeonhole blocks.

A fingerprint is split into blocks. Fingerprints that differ in at most ``radius`` bits
agree on all but ``radius`` blocks, so with ``blocks - radius`` blocks as a key and one
table for each choice of them, a close pair shares a key in some table. Rows that share a
key are compared by Hamming distance. Documents with one fingerprint are one node from the
start, and a key's rows give links that connect what is connected, not all pairs.

Rows arrive sorted by key and are compared as they stream by. A key with more than ``MOST``
rows is set aside, cut into chunks, and pairs of chunks are compared in tasks of their own,
so no key is one task's work and no link is lost.

Null text is empty text; documents without words have fingerprint zero and are linked like
any other. Rows without doc_id link nothing. Rows that share a doc_id are one node. Further
columns are ignored.

Rows repeated in id and text (A-Z lower-cased) come out once.

At a Jaccard similarity of 0.8 such keys would be a few bits long. ``similar_documents`` takes
the smallest hashes of the sets of shingles for keys instead, and compares the sets, in two
steps that are the same for any number of sets. First every set is compared with the least
one of each of its keys, which connects families of copies at one comparison a set. Then the
keys that still hold sets not connected are cut into pieces by size, and pairs of pieces are
compared, but for those whose sets are all connected already.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vacancia.llm import votes
from vacancia.llm.common import ascii_lower, chunks, partitions, stored, words
from vacancia.llm.components import components
from vacancia.llm.manifest import ranked

SMALL = 24  # rows of a key up to which every pair is looked at by shifting
MOST = 4096

# ---- 64-bit fingerprints, made by DataFrame operations


def masks(blocks: int, chosen: int, bits: int = 64) -> list[int]:
    """The bits of every choice of ``chosen`` out of ``blocks`` near-equal blocks."""
    edges = [round(bits * k / blocks) for k in range(blocks + 1)]
    parts = [((1 << b) - (1 << a)) for a, b in zip(edges, edges[1:])]
    return [sum(c) for c in combinations(parts, chosen)]


def signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def fingerprints(docs: DataFrame, n: int, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id and fingerprint (long): the majority bits of the shingles' XXH64, seed 42."""
    rows = docs.select(
        F.col(doc_id).alias("doc_id"), ascii_lower(F.coalesce(F.col(text), F.lit(""))).alias("t")
    )
    rows = rows.withColumn("own", F.xxhash64("t"))
    flat = votes.shingle_rows(rows, ["doc_id", "own"], words(F.col("t")), n)
    shingle = F.concat_ws(" ", *[f"w{k + 1}" for k in range(n)])
    flat = flat.select(
        "doc_id", "own", F.when(F.col("w1").isNotNull(), F.xxhash64(shingle)).alias("h")
    )
    sums = flat.groupBy("doc_id", "own").agg(*votes.vote_sums(F.col("h"), F.lit(1)))
    return sums.select("doc_id", votes.majority().alias("fingerprint"))


# ---- sets of shingles: their smallest hashes to meet by, the sets themselves to compare

GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def word_hashes(texts: list[str]) -> Iterator[np.ndarray]:
    """64-bit hashes of each text's words, A-Z lower-cased."""
    seen: dict[bytes, int] = {}
    for text in texts:
        found = text.encode("utf-8", "surrogatepass").lower().split()
        for w in found:
            if w not in seen:
                seen[w] = xxhash.xxh64_intdigest(w, 42)
        yield np.fromiter((seen[w] for w in found), dtype=np.uint64, count=len(found))


def shingle_hashes(hashes: np.ndarray, n: int) -> np.ndarray:
    """One hash per ``n`` neighbouring words; of fewer words, one of all."""
    n = min(n, len(hashes))
    if not n:
        return hashes
    out = np.zeros(len(hashes) - n + 1, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for k in range(n):
            out = _mix(out * np.uint64(3) + hashes[k : len(hashes) - n + 1 + k])
    return out


@dataclass(frozen=True)
class Similar:
    """Documents whose sets of ``shingle`` neighbouring words have a Jaccard similarity of
    ``least`` are linked.

    In each of ``tables`` tables a set's key is its smallest members by ``rows`` hashes. Two
    sets agree in one of these with a probability that is their similarity s, whatever the
    edit that made one of the other, so a pair meets in no table with probability
    ``(1 - s ** rows) ** tables``: 5e-6 at 0.8, 1e-8 at 0.85. All that meet are compared by
    their sets, in tasks of at most ``chunk`` sets and about ``chunk_bytes`` of them (one set
    at least) on either side.
    """

    shingle: int = 5
    least: float = 0.8
    rows: int = 6
    tables: int = 40
    chunk: int = 1024
    chunk_bytes: int = 32 << 20


def shingle_sets(texts: list[str], n: int) -> Iterator[np.ndarray]:
    """Each text's distinct shingle hashes, sorted."""
    for begin, end in chunks([len(t) for t in texts], 4 << 20):
        for hashes in word_hashes(texts[begin:end]):
            yield np.unique(shingle_hashes(hashes, n))


def meeting_keys(members: np.ndarray, rows: int, tables: int) -> np.ndarray:
    """A key for each table, of a set that is not empty."""
    n = rows * tables
    seeds = _mix(np.arange(1, 2 * n + 1, dtype=np.uint64) * GOLDEN) | np.uint64(1)
    first, second = seeds[:n, None], seeds[n:, None]
    least = np.full(n, np.iinfo(np.uint64).max, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for begin in range(0, len(members), 512):
            spread = members[begin : begin + 512] * first
            spread ^= spread >> np.uint64(32)
            spread *= second
            np.minimum(least, spread.min(axis=1), out=least)
        out = np.arange(1, tables + 1, dtype=np.uint64) * GOLDEN
        for k in range(rows):
            out = _mix(out * np.uint64(3) + least[k::rows])
    return out.view(np.int64)


def _with_own(docs: DataFrame, text: str, doc_id: str) -> DataFrame:
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return rows.select("doc_id", F.xxhash64("text").alias("own"), "text")


def set_keys(docs: DataFrame, setup: Similar, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id and ``own``, the text's hash; ``node``, the hash of its set, its size and keys.

    A text without words has no keys.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, sizes, keys = [], [], []
            for members in shingle_sets([t or "" for t in batch.column(2).to_pylist()], setup.shingle):
                nodes.append(signed(xxhash.xxh64_intdigest(members.tobytes(), 42)))
                some = len(members) > 0
                sizes.append(len(members))
                keys.append(meeting_keys(members, setup.rows, setup.tables) if some else [])
            yield pa.RecordBatch.from_arrays(
                [
                    *batch.columns[:2],
                    pa.array(nodes, pa.int64()),
                    pa.array(sizes, pa.int64()),
                    pa.array(keys, pa.list_(pa.int64())),
                ],
                ["doc_id", "own", "node", "size", "keys"],
            )

    schema = "doc_id long, own long, node long, size long, keys array<long>"
    return _with_own(docs, text, doc_id).mapInArrow(run, schema)


def alike(sets: list[np.ndarray], least: float, known: list[int] | None = None) -> list[tuple[int, int]]:
    """Places of pairs that connect all sets which similarities of ``least`` connect.

    Each set looks up who has its members; sets connected before (of one label in ``known``)
    are not looked at again.
    """
    sizes = np.array([len(s) for s in sets])
    ends = np.cumsum(sizes)
    owners = np.repeat(np.arange(len(sets)), sizes)
    _, numbers = np.unique(np.concatenate(sets), return_inverse=True)
    having = owners[np.argsort(numbers, kind="stable")]
    upto = np.cumsum(np.bincount(numbers))
    label = np.arange(len(sets)) if known is None else np.unique(known, return_inverse=True)[1]
    out: list[tuple[int, int]] = []
    for i in range(len(sets)):
        if (label == label[i]).all():
            continue
        own = numbers[ends[i] - sizes[i] : ends[i]]
        stop = upto[own]
        count = stop - np.where(own > 0, upto[own - 1], 0)
        at = np.repeat(stop - np.cumsum(count), count) + np.arange(count.sum())
        both = np.bincount(having[at], minlength=len(sets))
        near = both / (sizes + sizes[i] - both) >= least
        for j in np.flatnonzero(near):
            if label[j] != label[i]:
                out.append((i, int(j)))
                label[label == label[j]] = label[i]
    return out


def compare_sets(least: float):
    """For ``mapInArrow`` on (task, node, label, members) sorted by task: links within each task
    between sets of different labels."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, nodes, labels, sets = None, [], [], []

        def linked() -> list[tuple[int, int]]:
            return [(nodes[i], nodes[j]) for i, j in alike(sets, least, labels)] if len(sets) > 1 else []

        for batch in batches:
            found = []
            for task, node, label, members in zip(*(c.to_pylist() for c in batch.columns)):
                if task != now:
                    found += linked()
                    now, nodes, labels, sets = task, [], [], []
                nodes.append(node)
                labels.append(label)
                sets.append(np.frombuffer(members, dtype=np.uint64))
            yield _links(found)
        yield _links(linked())

    return run


def compare_to_pivot(least: float):
    """For ``mapInArrow`` on (pivot, node, members), in which each pivot's own set comes ahead
    of those to compare with it: links to the pivot. Two sets are held at a time."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = np.zeros(0, dtype=np.uint64)
        for batch in batches:
            found = []
            for pivot, node, members in zip(*(c.to_pylist() for c in batch.columns)):
                own = np.frombuffer(members, dtype=np.uint64)
                if node == pivot:
                    first = own
                    continue
                few, many = sorted((own, first), key=len)
                at = np.minimum(np.searchsorted(many, few), len(many) - 1)
                both = int((many[at] == few).sum())
                if both / (len(few) + len(many) - both) >= least:
                    found.append((node, pivot))
            yield _links(found)

    return run


def _links(found: list[tuple[int, int]]) -> pa.RecordBatch:
    ends = [pa.array([link[k] for link in found], pa.int64()) for k in (0, 1)]
    return pa.RecordBatch.from_arrays(ends, ["a", "b"])


# ---- comparing the rows of each key


def distances(prints: np.ndarray, one: np.ndarray) -> np.ndarray:
    return np.bitwise_count(prints ^ one).sum(axis=-1, dtype=np.int64)


def forest(prints: np.ndarray, nodes: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Links that connect all rows which links of at most ``radius`` bits connect.

    From each row reached, those not reached yet are looked at once.
    """
    left = np.arange(len(nodes))
    out: list[tuple[int, int]] = []
    while len(left):
        queue, left = [int(left[0])], left[1:]
        while queue and len(left):
            at = queue.pop()
            near = distances(prints[left], prints[at]) <= radius
            if near.any():
                found = left[near]
                out += [(int(nodes[at]), int(nodes[k])) for k in found]
                queue += found.tolist()
                left = left[~near]
    return out


def close_pairs(
    keys: np.ndarray, prints: np.ndarray, nodes: np.ndarray, radius: int
) -> tuple[list[np.ndarray], list[tuple[int, int]]]:
    """Links among rows sorted by key; all rows of a key are here."""
    edges = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1], [True]]))
    sizes = np.diff(edges)
    pairs: list[np.ndarray] = []
    small = np.repeat(sizes, sizes)
    few = np.flatnonzero((small > 1) & (small <= SMALL))
    k, p, v = keys[few], prints[few], nodes[few]
    for shift in range(1, int(sizes[sizes <= SMALL].max(initial=1))):
        same = np.flatnonzero(k[shift:] == k[:-shift])
        if not len(same):
            break
        near = distances(p[same], p[same + shift]) <= radius
        pairs.append(np.stack([v[same][near], v[same + shift][near]]))
    links: list[tuple[int, int]] = []
    for i in np.flatnonzero(sizes > SMALL):
        a, b = edges[i], edges[i + 1]
        links += forest(prints[a:b], nodes[a:b], radius)
    return pairs, links


LINKS = "a long, b long, key long, print binary, place long"


def _out(a=(), b=(), keys=(), prints=(), places=()) -> pa.RecordBatch:
    n = max(len(a), len(keys))

    def longs(values):
        return pa.array(values if len(values) else [None] * n, pa.int64())

    raw = pa.array(list(prints) if len(prints) else [None] * n, pa.binary())
    arrays = [longs(a), longs(b), longs(keys), raw, longs(places)]
    return pa.RecordBatch.from_arrays(arrays, ["a", "b", "key", "print", "place"])


def compare_sorted(radius: int, width: int, most: int | None):
    """For ``mapInArrow`` on (key, print, node) sorted by key.

    Links come out as ``a, b``. Rows of a key with more than ``most`` come out as they are,
    with their place; nothing larger than that is held.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = np.zeros(0, dtype=np.int64)
        prints = np.zeros((0, width // 64), dtype=np.uint64)
        nodes = np.zeros(0, dtype=np.int64)
        passing, place = None, 0  # a key that is set aside, and how many of its rows were

        def aside(upto: int) -> pa.RecordBatch:
            nonlocal place
            raw = [prints[i].tobytes() for i in range(upto)]
            batch = _out(
                a=nodes[:upto], keys=keys[:upto], prints=raw, places=np.arange(place, place + upto)
            )
            place += upto
            return batch

        def linked(upto: int) -> Iterator[pa.RecordBatch]:
            if upto:
                pairs, links = close_pairs(keys[:upto], prints[:upto], nodes[:upto], radius)
                for some in pairs:
                    if some.shape[1]:
                        yield _out(a=some[0], b=some[1])
                if links:
                    yield _out(a=[x for x, _ in links], b=[y for _, y in links])

        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            column = batch.column(1)
            data = np.frombuffer(column.buffers()[2], dtype=np.uint8)
            lo = column.offset * width // 8
            new = data[lo : lo + n * width // 8].view(np.uint64).reshape(n, width // 64)
            keys = np.concatenate([keys, batch.column(0).to_numpy()])
            prints = np.concatenate([prints, new])
            nodes = np.concatenate([nodes, batch.column(2).to_numpy()])
            if passing is not None:
                upto = int(np.searchsorted(keys != passing, True))
                if upto:
                    yield aside(upto)
                    keys, prints, nodes = keys[upto:], prints[upto:], nodes[upto:]
                if not len(keys):
                    continue
                passing = None
            # The last key may go on in the next batch.
            upto = int(np.searchsorted(keys == keys[-1], True))
            yield from linked(upto)
            keys, prints, nodes = keys[upto:], prints[upto:], nodes[upto:]
            if most is not None and len(keys) > most:
                passing, place = keys[0], 0
                yield aside(len(keys))
                keys, prints, nodes = keys[:0], prints[:0], nodes[:0]
        yield from linked(len(keys))

    return run


def links(rows: DataFrame, radius: int, width: int, most: int = MOST) -> DataFrame:
    """``a, b``: links among rows (key, print, node) that share a key."""
    n = partitions(rows.sparkSession)
    by_key = rows.select("key", "print", "node").repartition(n, "key").sortWithinPartitions("key")
    found = stored(by_key.mapInArrow(compare_sorted(radius, width, most), LINKS), "links-found")
    large = found.filter(F.col("key").isNotNull())
    counts = large.groupBy("key").agg(F.max("place").alias("last"))
    parts = F.floor(F.col("last") / most).cast("int") + 1
    own = F.floor(F.col("place") / most).cast("int")
    spread = large.join(counts, "key").select(
        "key",
        "print",
        F.col("a").alias("node"),
        own.alias("own"),
        F.explode(F.sequence(F.lit(0), parts - 1)).alias("other"),
    )
    task = F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other"))
    again = (
        spread.select(task.alias("key"), "print", "node")
        .repartition(n, "key")
        .sortWithinPartitions("key")
        .mapInArrow(compare_sorted(radius, width, None), LINKS)
    )
    return found.filter(F.col("key").isNull()).unionByName(again).select("a", "b")


# ---- the operators


def near_duplicates(
    docs: DataFrame,
    text: str = "text",
    doc_id: str = "doc_id",
    shingle: int = 4,
    radius: int = 4,
    blocks: int = 7,
) -> DataFrame:
    """doc_id, fingerprint (long) and component_id, the smallest doc_id reachable.

    ``blocks`` sets the keys' selectivity: ``64 * (blocks - radius) / blocks`` bits, in as
    many tables as there are choices of the blocks.
    """
    prints = stored(fingerprints(docs, shingle, text, doc_id), "simhash")
    nodes = stored(
        prints.groupBy("fingerprint").agg(F.min("doc_id").cast("long").alias("node")), "simhash-nodes"
    )
    tables = [
        F.xxhash64(F.lit(k), F.col("fingerprint").bitwiseAND(F.lit(signed(m))))
        for k, m in enumerate(masks(blocks, blocks - radius))
    ]
    raw = F.unhex(F.lpad(F.hex("fingerprint"), 16, "0"))
    rows = nodes.filter(F.col("node").isNotNull()).select(
        F.explode(F.array(*tables)).alias("key"), raw.alias("print"), "node"
    )
    return labelled(prints, nodes, links(rows, radius, 64), ["fingerprint"])


def _sets(docs: DataFrame, wanted: DataFrame, setup: Similar) -> DataFrame:
    """``node, members`` of the wanted (doc_id, own, node)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, texts = (c.to_pylist() for c in batch.columns)
            for begin, end in chunks([len(t or "") for t in texts], 1 << 20):
                members = [m.tobytes() for m in shingle_sets([t or "" for t in texts[begin:end]], setup.shingle)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(nodes[begin:end], pa.int64()), pa.array(members, pa.binary())], ["node", "members"]
                )

    # One row per node: rows repeated in id and text have the same set.
    rows = docs.join(wanted, ["doc_id", "own"]).select("node", "text")
    return rows.mapInArrow(run, "node long, members binary").dropDuplicates(["node"])


def _to_pivots(met: DataFrame, sets: DataFrame, setup: Similar) -> DataFrame:
    """Links of each set to the least one of each of its keys. A pivot that many sets have is
    compared with ``chunk`` of them in one place."""
    pairs = stored(met.filter("node <> pivot").select("node", "pivot").distinct(), "similar-pivots")
    parts = F.ceil(F.count(F.lit(1)) / setup.chunk).cast("int").alias("parts")
    heads = pairs.groupBy("pivot").agg(parts)
    salted = pairs.join(heads, "pivot").select(
        "pivot", "node", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int").alias("salt")
    )
    own = heads.select(
        "pivot", F.col("pivot").alias("node"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("salt")
    )
    rows = salted.unionByName(own).join(sets, "node")
    ordered = rows.repartition(partitions(met.sparkSession), "pivot", "salt").sortWithinPartitions(
        "pivot", "salt", F.col("node") != F.col("pivot")
    )
    found = ordered.select("pivot", "node", "members").mapInArrow(
        compare_to_pivot(setup.least), "a long, b long"
    )
    return stored(found, "similar-links")


def _pieces(met: DataFrame, known: DataFrame, setup: Similar) -> DataFrame:
    """``task, node, label``: the sets to compare of keys that hold sets not connected by
    ``known`` (node, component).

    Of keys with the same sets one is enough, and with two sets both were compared before.
    A piece has sets of like size, so that it is bounded in bytes, and of few components; two
    are compared where they have several components between them and their sizes allow it.
    """
    labelled = met.filter("n > 2").join(known, "node", "left").select(
        "key", "node", "size", "n", F.coalesce("component", "node").alias("label")
    )
    told = [F.bit_xor(F.xxhash64("node", F.lit(k))).alias(f"h{k}") for k in (1, 2)]
    open_keys = labelled.groupBy("key", "n").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), *told)
    chosen = open_keys.filter("lo <> hi").groupBy("n", "h1", "h2").agg(F.min("key").alias("key"))
    bits = F.ceil(F.log2("size")).cast("int")
    rest = labelled.join(chosen.select("key"), "key").select("key", "node", "label", bits.alias("bits"))
    rows = ranked(rest.withColumn("grp", F.concat_ws(":", "key", "bits")), ["label", "node"])
    most = F.greatest(F.lit(1), F.least(F.lit(setup.chunk), F.expr(f"shiftright({setup.chunk_bytes // 8}L, bits)")))
    rows = stored(
        rows.select("key", "bits", F.floor(F.col("rank") / most).alias("place"), "node", "label"), "similar-rest"
    )
    pieces = rows.groupBy("key", "bits", "place").agg(F.min("label").alias("lo"), F.max("label").alias("hi"))
    a, b = pieces.alias("a"), pieces.alias("b")
    apart = F.col("b.bits") - F.col("a.bits")
    later = (apart == 0) & (F.col("b.place") >= F.col("a.place"))
    fits = later | ((apart > 0) & (apart <= math.ceil(math.log2(1 / setup.least))))
    several = F.least("a.lo", "b.lo") != F.greatest("a.hi", "b.hi")
    ends = [F.struct(F.col(f"{x}.bits").alias("bits"), F.col(f"{x}.place").alias("place")) for x in "ab"]
    pairs = a.join(b, (F.col("a.key") == F.col("b.key")) & fits & several).select(
        F.col("a.key").alias("key"),
        F.xxhash64("a.key", *ends).alias("task"),
        F.explode(F.array_distinct(F.array(*ends))).alias("end"),
    )
    tasks = pairs.select("key", "end.*", "task")
    return rows.join(tasks, ["key", "bits", "place"]).select("task", "node", "label")


def near_rows(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id and ``own``, as ``similar_rows`` knows rows, and the component of each by SimHash."""
    row = F.xxhash64("doc_id", "own")
    rows = _with_own(docs, text, doc_id).filter(F.col("doc_id").isNotNull())
    rows = rows.select("doc_id", "own", "text", row.alias("row")).dropDuplicates(["doc_id", "own"])
    found = near_duplicates(rows, doc_id="row").select(F.col("doc_id").alias("row"), "component_id")
    return rows.select("doc_id", "own", "row").join(found, "row").select("doc_id", "own", "component_id")


def similar_rows(
    docs: DataFrame,
    setup: Similar = Similar(),
    text: str = "text",
    doc_id: str = "doc_id",
    near: DataFrame | None = None,
) -> DataFrame:
    """doc_id and ``own``, the XXH64 of the text as it is, of each row; component_id and
    component_own, those of the smallest row of its component that has a doc_id.

    Rows of one component of ``near`` (``near_rows``) meet as those that share a key do."""
    prints = stored(set_keys(docs, setup, text, doc_id), "similar-keys")
    row = F.struct("doc_id", "own")
    nodes = stored(
        prints.groupBy("node").agg(
            F.min(F.when(F.col("doc_id").isNotNull(), row)).alias("row"),
            F.first("keys").alias("keys"),
            F.first("size").alias("size"),
        ),
        "similar-nodes",
    )
    rows = nodes.filter(F.col("row").isNotNull()).select(F.explode("keys").alias("key"), "node", "size")
    if near is not None:
        close = near.join(prints.select("doc_id", "own", "node"), ["doc_id", "own"])
        close = close.select(F.xxhash64(F.lit("simhash"), "component_id").alias("key"), "node").distinct()
        rows = rows.unionByName(close.join(nodes.filter("size > 0").select("node", "size"), "node"))
    several = rows.groupBy("key").agg(F.min("node").alias("pivot"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    met = stored(rows.join(several, "key"), "similar-keys-met")
    wanted = nodes.join(met.select("node").distinct(), "node").select("row.doc_id", "row.own", "node")
    sets = stored(_sets(_with_own(docs, text, doc_id), stored(wanted, "similar-wanted"), setup), "similar-sets")
    first = _to_pivots(met, sets, setup)
    tasks = _pieces(met, components(first), setup).join(sets, "node").select("task", "node", "label", "members")
    found = (
        tasks.repartition(partitions(docs.sparkSession), "task")
        .sortWithinPartitions("task")
        .mapInArrow(compare_sets(setup.least), "a long, b long")
    )
    parts = components(first.unionByName(stored(found, "similar-links")))
    named = nodes.select("node", "row").join(parts, "node", "left")
    named = named.select("node", "row", F.coalesce("component", "node").alias("component"))
    first_row = named.groupBy("component").agg(F.min("row").alias("first"))
    named = stored(named.join(first_row, "component").select("node", "first"), "named")
    return prints.join(named, "node").select(
        "doc_id",
        "own",
        F.col("first.doc_id").alias("component_id"),
        F.col("first.own").alias("component_own"),
    )


def similar_documents(docs: DataFrame, setup: Similar = Similar(), text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id and component_id of documents with similar word shingles."""
    return similar_rows(docs, setup, text, doc_id).select("doc_id", "component_id")


def labelled(prints: DataFrame, nodes: DataFrame, found: DataFrame, by: list[str]) -> DataFrame:
    """Each document with the smallest doc_id of its component."""
    parts = components(found)
    named = nodes.join(parts, "node", "left").select(
        *by, F.coalesce("component", "node").alias("component_id")
    )
    return prints.join(stored(named, "named"), by)
