"""Small tables with the awkward rows every operator has to take, and plain re-computations."""

import re

import numpy as np
import xxhash

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
# Extra columns with names the operators use themselves.
CLASHING = SCHEMA + ", key string, node string, verdict string, score string, size string, own string"

WORDS = (
    "river stone quiet window market yellow garden ladder copper meadow winter signal "
    "basket thunder pocket island mirror velvet candle harbor"
).split()


def prose(seed: int, n: int) -> str:
    rng = np.random.default_rng(seed)
    return " ".join(f"{WORDS[k]}{j % 7}" for k, j in zip(rng.integers(0, 20, n), rng.integers(0, 99, n)))


def documents() -> list[tuple]:
    long = prose(1, 30_000)
    near = prose(2, 300)
    rows = [
        (1, "The quick brown fox jumps over the lazy dog near the river bank today", "en", "a", 1),
        (2, "The quick  brown fox jumps\tover the lazy dog near the river bank today", "en", "a", 1),
        (3, None, "en", "b", None),
        (4, "", None, "b", 0),
        (5, "   \t\n", "en", None, 5),
        (6, long, "en", "c", 1),
        (7, near, "en", "c", 1),
        (8, near.replace("river", "creek", 1), "en", None, 1),
        (9, near, "en", "c", 1),
        (10, "één twee — drie \U0001f600 vier", "nl", "d", 1),
        (11, "word", "nl", "d", 1),
        (12, "4711 !!! ...", "en", "e", 1),
        (13, long + " end", "en", "c", 1),
        (14, prose(3, 40), "xx", "a", 1),
        (15, "A A A A A A", None, "a", 1),
        (15, "A A A A A A", None, "a", 1),
        (None, "nobody's text is here", "en", "a", 1),
        (100, "river bank", "en", "b", 1),
    ]
    return rows


def frame(spark, rows=None, schema=SCHEMA, parts=3):
    return spark.createDataFrame(documents() if rows is None else rows, schema).repartition(parts)


def clashing(spark):
    return spark.createDataFrame([(*r, *["x"] * 6) for r in documents()], CLASHING)


UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_LOWER = str.maketrans(UPPER, UPPER.lower())


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(_LOWER))


def shingles(text, n):
    w = words(text)
    return [" ".join(w[k : k + n]) for k in range(max(1, len(w) - n + 1))] if w else []


def majority(terms, weights=None):
    if not terms:
        return 0
    hashes = [xxhash.xxh64_intdigest(t.encode(), 42) for t in terms]
    weights = weights or [1] * len(terms)
    out = 0
    for bit in range(64):
        votes = sum(w for h, w in zip(hashes, weights) if h >> bit & 1)
        out |= (votes * 2 > sum(weights)) << bit
    return out


def components(nodes, linked):
    """Smallest node reachable from each, by searching."""
    out = {}
    for start in sorted(nodes):
        if start in out:
            continue
        todo = [start]
        while todo:
            at = todo.pop()
            if at not in out:
                out[at] = start
                todo += [b for b in nodes if b not in out and linked(at, b)]
    return out
