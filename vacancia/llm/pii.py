"""Personal data: fixed patterns, and a linear-chain conditional random field.

The patterns (emails, IP addresses, card numbers that pass Luhn, phone numbers) give the
base spans. A conditional random field over the shapes of words, trained from a small
labelled table, adds spans of the same kinds written in ways the patterns do not cover; a
run of words with one label counts if its digits or letters make sense for the kind and it
does not touch a base span. Base spans always stay.

A line is one chain of words. Whole texts are decoded; a line longer than ``SEGMENT``
characters is cut at white space into chains of that length. Null text is empty text.
Repeated rows are searched each; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vacancia.llm.common import chunks

KINDS = ("email", "ip", "card", "phone")
SEGMENT = 4 << 20

Span = tuple[str, int, int]

# ---- base spans

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+\Z")
_IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_NOT_DIGIT = re.compile(r"[^0-9]+")


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Each ``@`` with what may stand before it, so a long run of letters is read once."""
    last, at = 0, text.find("@")
    while at >= 0:
        begin = at
        while begin > last and text[begin - 1] in _LOCAL_CHARS:
            begin -= 1
        domain = _DOMAIN.match(text, at + 1) if begin < at else None
        last = domain.end() if domain else at + 1
        if domain:
            yield begin, last
        at = text.find("@", last)


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else (d * 2 - 9 if d > 4 else d * 2)
    return total % 10 == 0


def is_ip(text: str) -> bool:
    parts = text.split(".")
    return len(parts) == 4 and all(
        p.isascii() and p.isdigit() and (len(p.lstrip("0")) <= 3) and int(p[-4:]) <= 255 for p in parts
    )


def is_card(digits: str) -> bool:
    return 13 <= len(digits) <= 19 and luhn(digits)


def base_spans(text: str) -> list[Span]:
    """By kind as listed, then start."""
    out: list[Span] = []
    if "@" in text:
        out += [("email", a, b) for a, b in emails(text)]
    out += [("ip", *m.span()) for m in _IP.finditer(text) if is_ip(m[0])]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13 and is_card(_NOT_DIGIT.sub("", m[0])):
            out.append(("card", *m.span()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= len(_NOT_DIGIT.sub("", m[0])) <= 15:
                out.append(("phone", *m.span()))
    return out


def listed(spans: Iterable[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


# ---- words and their shapes

LABELS = ("other", *KINDS)
N = len(LABELS)
_NAMES = ("space", "lower", "upper", "digit", "at", "dot", "plus", "dash", "bracket", "mark", "far")
_CLASS = {name: i for i, name in enumerate(_NAMES)}


def _class_table() -> np.ndarray:
    out = np.full(129, _CLASS["mark"], dtype=np.uint8)
    for i in range(128):
        c = chr(i)
        if c in "\t\n\x0b\x0c\r ":
            out[i] = _CLASS["space"]
        elif "a" <= c <= "z":
            out[i] = _CLASS["lower"]
        elif "A" <= c <= "Z":
            out[i] = _CLASS["upper"]
        elif "0" <= c <= "9":
            out[i] = _CLASS["digit"]
        elif c in "@.+-()":
            out[i] = _CLASS[dict(zip("@.+-()", ("at", "dot", "plus", "dash", "bracket", "bracket")))[c]]
    out[128] = _CLASS["far"]
    return out


CLASSES = _class_table()
# One bit per kind of character a word may hold; letters of all sorts share one.
_BITS = np.array([0, 1, 1, 2, 4, 8, 16, 32, 64, 128, 1], dtype=np.uint8)
_DIGITS = np.digitize(np.arange(64), [1, 2, 3, 4, 5, 7, 9, 12, 13, 17, 20]).astype(np.int32)
_LENGTHS = np.digitize(np.arange(64), [2, 3, 4, 6, 9, 13, 17, 20, 30]).astype(np.int32)
FEATURES = (256, 12, 5, 10, len(_NAMES) ** 2)  # holds, digits, dots, length, edges
CONTEXT = (0, 1)  # of these the words before and after count as well


@dataclass
class Words:
    """The words of some texts, each with its place, its features and where its chain starts."""

    begin: np.ndarray
    end: np.ndarray
    features: np.ndarray  # words x features
    chains: np.ndarray  # first word of each chain


def words_of(points: np.ndarray) -> Words:
    classes = CLASSES[np.minimum(points, 128)]
    ink = classes != 0
    edge = np.diff(np.concatenate([[0], ink.view(np.int8), [0]]))
    begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(begin):
        empty = np.zeros(0, dtype=np.int64)
        return Words(empty, empty, np.zeros((0, len(FEATURES)), np.int32), empty)
    holds = np.bitwise_or.reduceat(_BITS[classes], begin)
    digits = np.add.reduceat(classes == _CLASS["digit"], begin, dtype=np.int32)
    dots = np.add.reduceat(classes == _CLASS["dot"], begin, dtype=np.int32)
    features = np.empty((len(begin), len(FEATURES)), dtype=np.int32)
    features[:, 0] = holds
    features[:, 1] = _DIGITS[np.minimum(digits, 63)]
    features[:, 2] = np.minimum(dots, 4)
    features[:, 3] = _LENGTHS[np.minimum(end - begin, 63)]
    features[:, 4] = classes[begin].astype(np.int32) * len(_NAMES) + classes[end - 1]
    line = np.searchsorted(np.flatnonzero(points == 10), begin)
    chains = np.flatnonzero(np.concatenate([[True], line[1:] != line[:-1]]))
    return Words(begin, end, features, chains)


# ---- the field


@dataclass
class Field:
    """Weights: per feature value and label, of the word itself, the one before and the one
    after (whose last row stands for none), and of label following label."""

    own: list[np.ndarray]
    before: list[np.ndarray]
    after: list[np.ndarray]
    follows: np.ndarray

    @classmethod
    def empty(cls) -> Field:
        own = [np.zeros((n, N), dtype=np.float32) for n in FEATURES]
        near = [[np.zeros((FEATURES[f] + 1, N), dtype=np.float32) for f in CONTEXT] for _ in "ab"]
        return cls(own, near[0], near[1], np.zeros((N, N), dtype=np.float32))

    def neighbours(self, words: Words) -> list[tuple[np.ndarray, np.ndarray]]:
        first = np.zeros(len(words.begin), dtype=bool)
        first[words.chains] = True
        last = np.append(first[1:], True)
        out = []
        for f in CONTEXT:
            value = words.features[:, f]
            before = np.where(first, FEATURES[f], np.concatenate([[0], value[:-1]]))
            out.append((before, np.where(last, FEATURES[f], np.append(value[1:], 0))))
        return out

    def scores(self, words: Words) -> np.ndarray:
        out = self.own[0][words.features[:, 0]]
        for f in range(1, len(FEATURES)):
            out += self.own[f][words.features[:, f]]
        for k, (before, after) in enumerate(self.neighbours(words)):
            out += self.before[k][before]
            out += self.after[k][after]
        return out


def decode(field: Field, words: Words) -> np.ndarray:
    """The most likely labels of each chain, by Viterbi on all chains at once.

    Chains are sorted by length, so those still running are the first ones.
    """
    n = len(words.begin)
    best = np.zeros(n, dtype=np.int8)
    if not n:
        return best
    scores = field.scores(words)
    lengths = np.diff(np.append(words.chains, n))
    order = np.argsort(-lengths, kind="stable")
    starts, lengths = words.chains[order], lengths[order]
    running = np.searchsorted(-lengths, -np.arange(1, lengths[0] + 1), side="right")
    back = np.zeros((n, N), dtype=np.int8)
    alpha = scores[starts]
    finals = np.zeros(len(starts), dtype=np.int8)
    for t in range(1, lengths[0] + 1):
        still = running[t] if t < lengths[0] else 0
        if still < len(alpha):
            finals[still : len(alpha)] = alpha[still:].argmax(axis=1)
            alpha = alpha[:still]
        if not still:
            break
        paths = alpha[:, :, None] + field.follows
        at = starts[:still] + t
        back[at] = paths.argmax(axis=1)
        alpha = paths.max(axis=1) + scores[at]
    label = finals.copy()
    for t in range(lengths[0] - 1, -1, -1):
        here = running[t]
        at = starts[:here] + t
        best[at] = label[:here]
        if t:
            label[:here] = back[at, label[:here]]
    return best


_LEFT, _RIGHT = ".,;:!?'\"<>[]{}|=#*$%&-", ".,;:!?'\"<>[]{}|=#*$%&(-"


def sensible(kind: str, text: str) -> bool:
    """Whether what a run of words says can be of its kind."""
    digits = _NOT_DIGIT.sub("", text)
    if kind == "email":
        spelled = re.sub(r"\s*[\[({<]?\s*(?:\bat\b|@)\s*[\])}>]?\s*", "@", text, count=1)
        spelled = re.sub(r"\s*[\[({<]?\s*(?:\bdot\b|\.)\s*[\])}>]?\s*", ".", spelled)
        return any(a == 0 and b == len(spelled) for a, b in emails(spelled))
    if kind == "ip":
        return is_ip(re.sub(r"\s*[\[({]\s*\.\s*[\])}]\s*", ".", text))
    if kind == "card":
        return is_card(digits) and not re.search(r"[A-Za-z]", text)
    return 10 <= len(digits) <= 15 and not re.search(r"[^0-9+().\x20/-]", text) and not is_card(digits)


def added_spans(text: str, found: Iterable[tuple[int, int, int]], base: list[Span]) -> list[Span]:
    """Runs of equally labelled words as spans that make sense and touch no base span."""
    out = []
    taken = sorted((a, b) for _, a, b in base)
    for label, begin, end in found:
        while begin < end and text[begin] in _LEFT:
            begin += 1
        while end > begin and text[end - 1] in _RIGHT:
            end -= 1
        if begin == end or any(a < end and begin < b for a, b in taken):
            continue
        if sensible(LABELS[label], text[begin:end]):
            out.append((LABELS[label], begin, end))
    return out


def runs(words: Words, labels: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(label, begin, end) of neighbours in one chain with one label."""
    first = np.zeros(len(labels), dtype=bool)
    first[words.chains] = True
    new = first | np.concatenate([[True], labels[1:] != labels[:-1]]) if len(labels) else first
    at = np.flatnonzero(new)
    stop = np.append(at[1:], len(labels))
    keep = labels[at] > 0 if len(labels) else np.zeros(0, dtype=bool)
    for a, b in zip(at[keep], stop[keep]):
        yield int(labels[a]), int(words.begin[a]), int(words.end[b - 1])


def segments(text: str) -> list[tuple[int, str]]:
    """A very long text in parts with their places, cut at line ends or else white space."""
    out, begin = [], 0
    while len(text) - begin > SEGMENT:
        stop = text.rfind("\n", begin + 1, begin + SEGMENT)
        if stop < 0:
            stop = text.rfind(" ", begin + 1, begin + SEGMENT)
        stop = stop if stop > 0 else begin + SEGMENT
        out.append((begin, text[begin:stop]))
        begin = stop
    out.append((begin, text[begin:]))
    return out


def field_runs(field: Field, texts: Sequence[str]) -> list[list[tuple[int, int, int]]]:
    """For each text the runs the field labels, in code points."""
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    parts = [(i, at, part) for i, t in enumerate(texts) for at, part in segments(t)]
    for lo, hi in chunks([len(p) for _, _, p in parts], SEGMENT):
        some = parts[lo:hi]
        joined = "\n".join(p for _, _, p in some)
        points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        words = words_of(points)
        starts = np.cumsum([0] + [len(p) + 1 for _, _, p in some])
        for label, begin, end in runs(words, decode(field, words)):
            k = int(np.searchsorted(starts, begin, side="right")) - 1
            i, at, _ = some[k]
            out[i].append((label, int(begin - starts[k] + at), int(end - starts[k] + at)))
    return out


# ---- training


def train(rows: Sequence[tuple[str, Sequence[Span]]], steps: int = 120, rate: float = 0.3, decay: float = 1e-4) -> Field:
    """Maximum likelihood by Adam over all rows (text, spans) at once; each line is a chain.

    Log-space forward and backward sums over padded chains give the expected counts.
    """
    field = Field.empty()
    if not rows:
        return field
    text = "\n".join(t.replace("\n", " ") for t, _ in rows)
    starts = np.cumsum([0] + [len(t) + 1 for t, _ in rows])
    spans = [(k, a + s, b + s) for (_, own), s in zip(rows, starts) for k, a, b in own]
    words = words_of(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32))
    n = len(words.begin)
    if not n:
        return field
    gold = np.zeros(n, dtype=np.int64)
    for kind, a, b in spans:
        lo, hi = np.searchsorted(words.end, a, "right"), np.searchsorted(words.begin, b, "left")
        gold[lo:hi] = LABELS.index(kind)
    lengths = np.diff(np.append(words.chains, n))
    width, chains = int(lengths.max()), len(lengths)
    inside = np.arange(width) < lengths[:, None]
    where = words.chains[:, None] + np.minimum(np.arange(width), lengths[:, None] - 1)
    near = field.neighbours(words)
    tables = field.own + field.before + field.after + [field.follows]
    picks = [words.features[:, f] for f in range(len(FEATURES))]
    picks += [b for b, _ in near] + [a for _, a in near]
    truth = np.eye(N)[gold]
    pairs = np.zeros((N, N))
    linked = np.ones(n, dtype=bool)
    linked[words.chains] = False
    np.add.at(pairs, (gold[:-1][linked[1:]], gold[1:][linked[1:]]), 1.0)
    moments = [(np.zeros(t.shape), np.zeros(t.shape)) for t in tables]

    def lse(x: np.ndarray, axis: int) -> np.ndarray:
        top = x.max(axis=axis, keepdims=True)
        return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis=axis))

    for step in range(1, steps + 1):
        scores = field.scores(words).astype(np.float64)[where]
        follows = field.follows.astype(np.float64)
        alpha = np.zeros((chains, width, N))
        beta = np.zeros((chains, width, N))
        alpha[:, 0] = scores[:, 0]
        for t in range(1, width):
            step_on = lse(alpha[:, t - 1, :, None] + follows, 1) + scores[:, t]
            alpha[:, t] = np.where(inside[:, t, None], step_on, alpha[:, t - 1])
        whole = lse(alpha[:, -1], 1)
        for t in range(width - 2, -1, -1):
            ahead = lse(follows + (scores[:, t + 1] + beta[:, t + 1])[:, None, :], 2)
            beta[:, t] = np.where(inside[:, t + 1, None], ahead, 0.0)
        share = np.exp(alpha + beta - whole[:, None, None])[inside]
        expected = np.zeros((N, N))
        for t in range(1, width):
            joint = alpha[:, t - 1, :, None] + follows + (scores[:, t] + beta[:, t])[:, None, :]
            on = inside[:, t]
            expected += np.exp(joint[on] - whole[on][:, None, None]).sum(axis=0)
        miss = truth - share
        gradients = []
        for table, pick in zip(tables, picks):
            g = np.zeros(table.shape)
            np.add.at(g, pick, miss)
            gradients.append(g)
        gradients.append(pairs - expected)
        for k, (table, g) in enumerate(zip(tables, gradients)):
            g = g / chains - decay * table
            m, v = moments[k]
            m[:] = 0.9 * m + 0.1 * g
            v[:] = 0.999 * v + 0.001 * g * g
            table += (rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return field


@dataclass(frozen=True)
class Sample:
    """Bounds of the labelled table: documents looked at, windows, and words in a window."""

    documents: int = 6000
    windows: int = 1200
    reach: int = 8


def variants(text: str, span: Span) -> Iterator[tuple[str, list[Span]]]:
    """The same window with its span written in other ways, so that the field learns them."""
    kind, a, b = span
    own, other = text[a:b], []
    if kind == "phone":
        bare = own[1:].lstrip("0123456789") if " " in own else own[1:]
        other = [bare.strip(" -."), re.sub(r"[() ]+", "-", own[1:]).strip("-")]
        other += [re.sub(r"[() -]+", ".", own).strip(".")]
    elif kind == "card":
        digits = _NOT_DIGIT.sub("", own)
        groups = [digits[i : i + 4] for i in range(0, len(digits), 4)]
        other = [" ".join(groups), ".".join(groups), "-".join(groups), "  ".join(groups)]
    elif kind == "email":
        name, _, domain = own.partition("@")
        other = [f"{name} at {domain}", f"{name} [at] {domain}", f"{name} at {domain.replace('.', ' dot ')}"]
        other += [f"{name} @ {domain}"]
    elif kind == "ip":
        other = [own.replace(".", "[.]"), own.replace(".", "(.)")]
    for new in other:
        yield text[:a] + new + text[b:], [(kind, a, a + len(new))]


def windows(text: str, reach: int) -> Iterator[tuple[str, list[Span]]]:
    """Short labelled pieces of a text: around each base span, and around other numbers."""
    spans = base_spans(text)
    places = [(a, b, [(k, a, b)]) for k, a, b in spans]
    for m in re.finditer(r"\S*[0-9@+]\S*", text):
        if not any(a < m.end() and m.start() < b for _, a, b in spans):
            places.append((*m.span(), []))
    for a, b, own in places:
        before, behind = text[max(0, a - 400) : a].split("\n")[-1], text[b : b + 400].split("\n")[0]
        left = " ".join(before.split(" ")[-reach:])
        right = " ".join(behind.split(" ")[:reach])
        moved = [(k, x - a + len(left), y - a + len(left)) for k, x, y in own]
        window = left + text[a:b] + right
        # Other spans in the window are labelled as well.
        rest = [s for s in base_spans(window) if not any(s[1] < y and x < s[2] for _, x, y in moved)]
        yield window, moved + rest
        for k, x, y in moved:
            if not rest:
                yield from variants(window, (k, x, y))


def labelled_windows(docs: DataFrame, sample: Sample = Sample(), text: str = "text", doc_id: str = "doc_id") -> list[tuple[str, list[Span]]]:
    """The small labelled table: windows of the documents with the smallest hashes of their ids."""
    chosen = (
        docs.select(F.col(doc_id).alias("__id"))
        .distinct()
        .orderBy(F.xxhash64("__id"), "__id")
        .limit(sample.documents)
    )
    rows = docs.select(F.col(doc_id).alias("__id"), F.col(text).alias("__text"))
    rows = rows.join(F.broadcast(chosen), "__id", "left_semi")  # sample.documents rows at most
    reach = sample.reach

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for own, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for k, (window, spans) in enumerate(windows(t or "", reach)):
                    out.append((own, k, window, listed(spans)))
            columns = list(zip(*out)) or [()] * 4
            kinds = [batch.schema.field(0).type, pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds)], ["id", "k", "window", "spans"]
            )

    kind = dict(docs.dtypes)[doc_id]
    found = (
        rows.mapInArrow(cut, f"id {kind}, k long, window string, spans string")
        .orderBy(F.xxhash64("id", "k"), "id", "k")
        .limit(sample.windows)
        .collect()
    )
    parse = [(r["window"], [s.split(":") for s in r["spans"].split(",") if s]) for r in found]
    return [(w, [(k, int(a), int(b)) for k, a, b in s]) for w, s in parse]


OUT = (
    "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, "
    "spans string, n_added long"
)


def find(docs: DataFrame, field: Field, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per document: counts and digest of the base spans, all spans, how many were added."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            out = []
            for t, labelled in zip(texts, field_runs(field, texts)):
                base = base_spans(t)
                more = added_spans(t, labelled, base)
                counts = [sum(k == kind for k, _, _ in base) for kind in KINDS]
                digest = hashlib.sha256(listed(base).encode()).hexdigest()
                both = sorted(base + more, key=lambda s: (KINDS.index(s[0]), s[1]))
                out.append((*counts, digest, listed(both), len(more)))
            kinds = [pa.int64()] * 4 + [pa.string(), pa.string(), pa.int64()]
            columns = list(zip(*out)) or [()] * 7
            arrays = [pa.array(c, k) for c, k in zip(columns, kinds)]
            names = ["doc_id", *[f"n_{k}" for k in KINDS], "base_sha256", "spans", "n_added"]
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], names)

    return rows.mapInArrow(run, OUT)
