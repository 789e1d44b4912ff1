"""URL filter: host and path rules, then a weighted vocabulary found by Aho-Corasick.

A rule decides where one fits. Other URLs are searched for vocabulary terms standing
between characters that are neither letters nor digits: one strict term, or distinct
soft terms whose weights reach the threshold, block the URL.

Nulls and URLs without ``://`` have an empty host and path and fit no rule; the text of
the latter is searched like any other. Repeated rows are judged each. Other columns stay.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vacancia.llm.common import UPPER

ALLOW, BLOCK = "allow", "block"


@dataclass(frozen=True)
class Rule:
    """Fits ``host`` and its subdomains where the path starts with ``path``."""

    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


@dataclass(frozen=True)
class Vocabulary:
    """Terms in lower case. ``soft`` has their weights; ``threshold`` is what they must reach."""

    strict: tuple[str, ...] = ("casino", "escort", "hentai", "porn", "porno", "viagra", "xxx")
    soft: tuple[tuple[str, int], ...] = (
        ("adult", 2),
        ("bet", 1),
        ("cam", 1),
        ("dating", 1),
        ("farm", 1),
        ("free", 1),
        ("loan", 1),
        ("pills", 2),
        ("poker", 2),
        ("sex", 2),
        ("spam", 2),
        ("win", 1),
        ("x", 1),
    )
    threshold: int = 3


@dataclass(frozen=True)
class UrlFilter:
    """``rules`` go to every task and are bounded by ``max_rules``."""

    rules: tuple[Rule, ...] = ()
    vocabulary: Vocabulary = field(default_factory=Vocabulary)
    max_rules: int = 1_000_000

    def __post_init__(self):
        if len(self.rules) > self.max_rules:
            raise ValueError("too many rules to send to every task")


def host(url: Column) -> Column:
    raw = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)\A.*?://([^/?#]*)", 1)
    return F.translate(raw, UPPER, UPPER.lower())


def path(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)\A.*?://[^/?#]*([^?#]*)", 1)


@lru_cache(maxsize=4)
def _automaton(vocabulary: Vocabulary):
    found = ahocorasick.Automaton()
    for term, weight in vocabulary.soft:
        found.add_word(term, (term, weight))
    for term in vocabulary.strict:
        found.add_word(term, (term, None))
    if len(found):
        found.make_automaton()
    return found


@lru_cache(maxsize=4)
def _by_host(rules: tuple[Rule, ...]) -> dict[str, list[Rule]]:
    """Rules by host, the longest first; of equal ones the first given."""
    out: dict[str, list[Rule]] = {}
    for rule in sorted(rules, key=lambda r: -len(r.text)):
        out.setdefault(rule.host, []).append(rule)
    return out


def fitting_rule(rules: tuple[Rule, ...], url_host: str, url_path: str) -> Rule | None:
    """The longest rule that fits."""
    by_host, best, rest = _by_host(rules), None, url_host
    while rest:
        for rule in by_host.get(rest, ()):
            if url_path.startswith(rule.path):
                if best is None or len(rule.text) > len(best.text):
                    best = rule
                break
        rest = rest.partition(".")[2]
    return best


_EDGE = re.compile(r"[a-z0-9]")


def term_hits(vocabulary: Vocabulary, text: str) -> tuple[int, int, int]:
    """Strict hits, distinct soft terms, and the weight of those."""
    automaton = _automaton(vocabulary)
    strict, soft = 0, {}
    if len(automaton):
        for end, (term, weight) in automaton.iter(text):
            begin = end + 1 - len(term)
            if (begin and _EDGE.match(text[begin - 1])) or _EDGE.match(text[end + 1 : end + 2]):
                continue
            if weight is None:
                strict += 1
            else:
                soft[term] = weight
    return strict, len(soft), sum(soft.values())


OUT = pa.schema(
    [
        ("rule", pa.string()),
        ("verdict", pa.string()),
        ("strict_hits", pa.int64()),
        ("soft_terms", pa.int64()),
        ("soft_weight", pa.int64()),
    ]
)


def judge_urls(pages: DataFrame, url: str = "url", setup: UrlFilter = UrlFilter()) -> DataFrame:
    """Adds host, path, rule, verdict, strict_hits, soft_terms and soft_weight.

    Columns with those names are replaced. One narrow pass without a shuffle.
    """
    added = ("host", "path", *OUT.names)
    kept = [c for c in pages.columns if c not in added]
    rows = pages.withColumns({"host": host(F.col(url)), "path": path(F.col(url))})
    lower = F.translate(F.col(url), UPPER, UPPER.lower())
    rows = rows.select(*kept, "host", "path", lower.alias("__lower"))

    def judged(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            at = batch.schema.get_field_index
            for h, p, low in zip(
                batch.column(at("host")).to_pylist(),
                batch.column(at("path")).to_pylist(),
                batch.column(at("__lower")).to_pylist(),
            ):
                strict, soft, weight = term_hits(setup.vocabulary, low or "")
                rule = fitting_rule(setup.rules, h, p)
                bad = strict > 0 or weight >= setup.vocabulary.threshold
                verdict = rule.verdict if rule else BLOCK if bad else ALLOW
                out.append((rule.text if rule else None, verdict, strict, soft, weight))
            columns = [pa.array(c, f.type) for c, f in zip(zip(*out), OUT)] if out else [
                pa.array([], f.type) for f in OUT
            ]
            whole = batch.columns[:-1] + columns
            yield pa.RecordBatch.from_arrays(whole, names=batch.schema.names[:-1] + OUT.names)

    schema = rows.drop("__lower").schema
    for name, kind in (("rule", "string"), ("verdict", "string")):
        schema = schema.add(name, kind)
    for name in ("strict_hits", "soft_terms", "soft_weight"):
        schema = schema.add(name, "long")
    return rows.mapInArrow(judged, schema)
