"""Language identification by rank-order profiles of character n-grams.

A text is folded to lower case, everything that is not a letter is one boundary mark,
and n-grams of one to three characters that stand inside a word with its marks are
counted. The most frequent ones, in the order of their frequency, are the document's
profile; its distance to a language is the sum, over these n-grams, of how far their
place is from the place in the language's profile, or the profile's length where the
language does not have them. The nearest language is predicted.

Profiles are learned from a sample of labelled rows: of each language a share of the rows,
chosen by a hash, that comes to about ``sample`` rows. Everything else sees all rows.

A text that is null or has no letter is ``und`` with score 0; so is every text when
nothing could be learned. Ties go to the language first in code point order. Repeated
rows are predicted each; further columns stay, those named like the result go.
"""

from __future__ import annotations

import sys
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vacancia.llm.common import chunks, stored

UNDETERMINED = "und"
SEGMENT = 1 << 20  # characters worked on at once


@dataclass(frozen=True)
class Settings:
    """``places`` is the length of a profile, ``sample`` the labelled rows per language that
    profiles are learned from."""

    places: int = 400
    sample: int = 2000
    max_languages: int = 1000


@lru_cache(maxsize=1)
def folding() -> np.ndarray:
    """Lower-case code point of every letter, zero for everything else."""
    out = np.zeros(sys.maxunicode + 1, dtype=np.uint32)
    for point in range(sys.maxunicode + 1):
        c = chr(point)
        if c.isalpha():
            low = c.lower()
            out[point] = ord(low[0]) if len(low) == 1 else point
    return out


def marked(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All letters of the texts with single marks between words, and each text's start.

    A text begins and ends with a mark, so none of its n-grams reaches into the next.
    """
    joined = "\0".join(texts) + "\0"
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    ends = np.cumsum([len(t) + 1 for t in texts]) - 1
    letters = folding()[points]
    kept = letters > 0
    kept[1:] |= kept[:-1]  # a mark after each word
    kept[ends] = True
    before = np.cumsum(kept)
    out = np.concatenate([np.zeros(1, dtype=np.int64), letters[kept].astype(np.int64)])
    starts = np.concatenate([[0], before[ends]])
    return out, starts


def counted(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    codes = np.sort(codes)
    if not len(codes):
        return codes, np.zeros(0, dtype=np.int64)
    edges = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]]))
    return codes[edges], np.diff(np.append(edges, len(codes)))


def ngrams(letters: np.ndarray) -> np.ndarray:
    """Codes of the n-grams of one to three characters; the letters start and end with a mark."""
    if len(letters) < 3:
        return np.zeros(0, dtype=np.int64)
    a, b, c = letters[:-2], letters[1:-1], letters[2:]
    one = letters[letters > 0]
    two = (letters[:-1] << 21) | letters[1:]
    two = two[two > 0] | (1 << 61)
    three = ((a << 42) | (b << 21) | c)[b > 0]
    return np.concatenate([one, two, three | (1 << 62)])


def text_counts(letters: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams of one text and their counts, a segment of it at a time."""
    if len(letters) <= SEGMENT:
        return counted(ngrams(letters))
    marks = np.flatnonzero(letters == 0)
    codes, sums = np.zeros(0, np.int64), np.zeros(0, np.int64)
    begin = 0
    while begin < len(letters) - 1:
        # A cut at a mark belongs to both sides; a word longer than a segment stays whole.
        at = np.searchsorted(marks, begin + SEGMENT, side="right") - 1
        end = int(marks[at]) if marks[at] > begin else int(marks[min(at + 1, len(marks) - 1)])
        found, n = counted(ngrams(letters[begin : end + 1]))
        codes, where = np.unique(np.concatenate([codes, found]), return_inverse=True)
        sums = np.bincount(where, weights=np.concatenate([sums, n])).astype(np.int64)
        begin = end
    return codes, sums


def most_frequent(codes: np.ndarray, counts: np.ndarray, places: int) -> np.ndarray:
    """The most frequent n-grams in order; ties by code."""
    if len(codes) > places:
        least = np.partition(counts, len(counts) - places)[len(counts) - places]
        enough = counts >= least
        codes, counts = codes[enough], counts[enough]
    return codes[np.lexsort((codes, -counts))[:places]]


def counts_of(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for begin, end in chunks([len(t) for t in texts], SEGMENT):
        letters, starts = marked(texts[begin:end])
        for i in range(end - begin):
            yield text_counts(letters[starts[i] : starts[i + 1] + 1])


@dataclass(frozen=True)
class Profiles:
    """Languages, all their n-grams in order of code, and each one's place in each language."""

    languages: tuple[str, ...]
    codes: np.ndarray
    places: np.ndarray  # n-grams x languages
    length: int

    def predict(self, codes: np.ndarray, counts: np.ndarray) -> tuple[str, float]:
        """Language and score: how far the best is from having nothing in common, 0 to 1."""
        if not len(codes) or not self.languages:
            return UNDETERMINED, 0.0
        own = most_frequent(codes, counts, self.length)
        at = np.minimum(np.searchsorted(self.codes, own), max(len(self.codes) - 1, 0))
        known = self.codes[at] == own
        places = np.where(known[:, None], self.places[at], -1)
        off = np.abs(places - np.arange(len(own))[:, None])
        distance = np.where(places < 0, self.length, np.minimum(off, self.length)).sum(axis=0)
        best = int(np.argmin(distance))
        return self.languages[best], 1.0 - float(distance[best]) / (self.length * len(own))


def learn(
    labelled: DataFrame, settings: Settings = Settings(), key: str = "doc_id"
) -> Profiles:
    """Profiles of the labelled rows (``text``, ``lang``), sampled as documented above.

    Counting is distributed; a language's profile, bounded by ``places``, comes back.
    """
    known = labelled.filter(F.col("lang").isNotNull())
    rates = known.groupBy("lang").agg((settings.sample / F.count(F.lit(1))).alias("rate")).collect()
    if len(rates) > settings.max_languages:
        raise ValueError("more languages than max_languages")
    spark = labelled.sparkSession
    share = spark.createDataFrame([(r["lang"], r["rate"]) for r in rates], "lang string, rate double")
    spread = F.pmod(F.xxhash64(F.col(key), F.lit("sample")), F.lit(1 << 40)) / float(1 << 40)
    rows = (
        known.join(F.broadcast(share), "lang")  # a row per language, max_languages at most
        .filter(spread < F.col("rate"))
        .select("lang", F.coalesce("text", F.lit("")).alias("text"))
    )

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums: dict[str, dict[int, int]] = {}
            texts = batch.column(1).to_pylist()
            for lang, (codes, n) in zip(batch.column(0).to_pylist(), counts_of(texts)):
                own = sums.setdefault(lang, {})
                for code, m in zip(codes.tolist(), n.tolist()):
                    own[code] = own.get(code, 0) + m
            for lang, own in sums.items():
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([lang] * len(own), pa.string()),
                        pa.array(list(own), pa.int64()),
                        pa.array(list(own.values()), pa.int64()),
                    ],
                    ["lang", "code", "n"],
                )

    sums = (
        rows.mapInArrow(count, "lang string, code long, n long")
        .groupBy("lang", "code")
        .agg(F.sum("n").alias("n"))
    )
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "code")
    top = stored(
        sums.withColumn("place", F.row_number().over(order) - 1)
        .filter(F.col("place") < settings.places)
        .select("lang", "code", "place"),
        "language-profiles",
    )
    return profiles(top.collect(), settings.places)


def profiles(rows: Iterable, length: int) -> Profiles:
    """Profiles out of (language, n-gram, place)."""
    rows = [(r[0], r[1], r[2]) for r in rows]
    languages = tuple(sorted({r[0] for r in rows}))
    column = {lang: i for i, lang in enumerate(languages)}
    codes = np.unique(np.array([r[1] for r in rows], dtype=np.int64))
    places = np.full((len(codes), len(languages)), -1, dtype=np.int64)
    for lang, code, place in rows:
        places[np.searchsorted(codes, code), column[lang]] = place
    return Profiles(languages, codes, places, length)


def held_out(doc_id: Column) -> Column:
    """Whether a document takes no part in learning: a third of all ids."""
    return F.coalesce(
        F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False)
    )


def predict(docs: DataFrame, model: Profiles, text: str = "text") -> DataFrame:
    """Adds lang_pred and score. One pass without a shuffle."""
    kept = [c for c in docs.columns if c not in ("lang_pred", "score")]
    at = kept.index(text)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column(at).to_pylist()]
            found = [model.predict(codes, n) for codes, n in counts_of(texts)]
            columns = [
                pa.array([f[0] for f in found], pa.string()),
                pa.array([f[1] for f in found], pa.float64()),
            ]
            yield pa.RecordBatch.from_arrays(
                batch.columns + columns, batch.schema.names + ["lang_pred", "score"]
            )

    rows = docs.select(*kept)
    schema = rows.select("*", F.lit("").alias("lang_pred"), F.lit(0.0).alias("score")).schema
    return rows.mapInArrow(run, schema)


def predict_narrow(docs: DataFrame, model: Profiles, text: str = "text") -> DataFrame:
    """As ``predict``, but the text does not come back out of Python."""
    kept = [c for c in docs.columns if c not in (text, "lang_pred", "score")]
    rows = docs.select(*kept, text)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column(len(kept)).to_pylist()]
            found = [model.predict(codes, n) for codes, n in counts_of(texts)]
            columns = [
                pa.array([f[0] for f in found], pa.string()),
                pa.array([f[1] for f in found], pa.float64()),
            ]
            yield pa.RecordBatch.from_arrays(
                batch.columns[:-1] + columns, kept + ["lang_pred", "score"]
            )

    schema = docs.select(*kept, F.lit("").alias("lang_pred"), F.lit(0.0).alias("score")).schema
    return rows.mapInArrow(run, schema)
