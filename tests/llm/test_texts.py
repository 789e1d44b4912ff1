"""Language profiles, personal data, backoff scores."""

import hashlib
import math
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tests.llm import cases
from vacancia.llm import backoff_lm, language_id, pii

# ---- language

SPEECH = {
    "en": "the house stands near the water and nobody knows who built it there",
    "de": "das haus steht nicht weit vom wasser und niemand weiß wer es gebaut hat",
    "fr": "la maison se trouve près de l'eau et personne ne sait qui l'a construite",
}


def speech(spark):
    rows = []
    for k in range(150):
        lang = ("en", "de", "fr")[k % 3]
        words = SPEECH[lang].split()
        text = " ".join(words[(k * 7 + j * (k % 5 + 1)) % len(words)] for j in range(12))
        rows.append((k, text, lang if k % 10 else None, "s", 0))
    return cases.frame(spark, rows), rows


def plain_profile(texts, places):
    """Places of n-grams by counting substrings of marked words."""
    counts = Counter()
    for text in texts:
        for word in re.findall(r"[^\W\d_]+", text.lower()):
            marked = f"_{word}_"
            for n in (1, 2, 3):
                grams = [marked[i : i + n] for i in range(len(marked) - n + 1)]
                counts.update(g for g in grams if g != "_")
    code = lambda g: (len(g), [0 if c == "_" else ord(c) for c in g])
    return {g: k for k, g in enumerate(sorted(counts, key=lambda g: (-counts[g], code(g)))[:places])}


def test_predictions_match_plain_profiles(spark):
    docs, rows = speech(spark)
    settings = language_id.Settings(places=60)
    model = language_id.learn(docs, settings)
    got = {r.doc_id: (r.lang_pred, r.score) for r in language_id.predict(docs, model).collect()}
    known = {
        lang: plain_profile([r[1] for r in rows if r[2] == lang], 60) for lang in ("de", "en", "fr")
    }
    for i, text, *_ in rows:
        own = plain_profile([text], 60)
        distance = {
            lang: sum(min(abs(k - places[g]), 60) if g in places else 60 for g, k in own.items())
            for lang, places in known.items()
        }
        best = min(sorted(distance), key=distance.get)
        assert got[i] == (best, pytest.approx(1 - distance[best] / (60 * len(own))))


def test_held_out_accuracy(spark):
    docs, rows = speech(spark)
    held = language_id.held_out(F.col("doc_id"))
    model = language_id.learn(docs.filter(~held))
    got = language_id.predict(docs.withColumn("h", held), model).collect()
    truth = {r[0]: ("en", "de", "fr")[r[0] % 3] for r in rows}
    for r in got:
        assert r.h == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
    out = [r.lang_pred == truth[r.doc_id] for r in got if r.h]
    assert sum(out) / len(out) >= 0.95


@pytest.mark.parametrize("columns", [cases.frame, cases.clashing])
def test_language_of_awkward_rows(spark, columns):
    docs = columns(spark)
    model = language_id.learn(docs)
    got = language_id.predict(docs, model)
    assert got.count() == len(cases.documents())
    by_id = {r.doc_id: r for r in got.collect()}
    for k in (3, 4, 5, 12):
        assert (by_id[k].lang_pred, by_id[k].score) == ("und", 0.0)
    assert by_id[6].lang_pred == "en" and 0 <= by_id[6].score <= 1
    assert set(docs.columns) <= set(got.columns) | {"score"}


def test_nothing_to_learn_from(spark):
    docs = cases.frame(spark, [(1, "some text", None, None, 0)])
    model = language_id.learn(docs)
    assert language_id.predict(docs, model).first().lang_pred == "und"
    assert language_id.predict(docs.limit(0), model).count() == 0


def test_long_text_in_segments(monkeypatch):
    text = cases.prose(4, 3000) + " " + "x" * 700
    whole = [tuple(map(list, c)) for c in language_id.counts_of([text, "a b", ""])]
    monkeypatch.setattr(language_id, "SEGMENT", 200)
    assert [tuple(map(list, c)) for c in language_id.counts_of([text, "a b", ""])] == whole


# ---- personal data


def plain_spans(text):
    """The patterns as they stand in the contract."""
    digits = lambda s: re.sub("[^0-9]", "", s)
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m[0].split(".")):
            out.append(("ip", *m.span()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        if 13 <= len(digits(m[0])) <= 19 and pii.luhn(digits(m[0])):
            out.append(("card", *m.span()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= len(digits(m[0])) <= 15:
            out.append(("phone", *m.span()))
    return out


TEXTS = [
    "write to ann.lee@mail.example.com, or a@b.c_x@d.e and x@y",
    "from 10.0.0.1 to 256.1.1.1 and 1.2.3.4.5.6.7.8 or 010.1.2.003",
    "card 4111 1111 1111 1111 or 4111-1111-1111-1112 and 378282246310005",
    "call +1 (619) 555-0142 or +49 30 901820 now, +1 2",
    "@@ a@ @b.c d@e.f@g.h +++ 1.1.1.1@x.y",
    "é+1 234 567 890é 😀 joe@host.example 😀",
    "",
    "1" * 40 + " " + "9." * 30,
    "4451718024887799 27.65.93.188",
    "0000000000000000.0.0.1 and 1.2.3.0000000000000000255",
]


@pytest.mark.parametrize("text", TEXTS)
def test_base_spans(text):
    assert pii.base_spans(text) == plain_spans(text)


def test_base_spans_at_random():
    import random

    rng = random.Random(7)
    for _ in range(4000):
        text = "".join(rng.choice("a.@-+1234567890 ()_é,") for _ in range(rng.randrange(40)))
        assert pii.base_spans(text) == plain_spans(text), text


def training_rows():
    rows = []
    for k in range(60):
        before, after = cases.prose(k, 6), cases.prose(k + 500, 6)
        shown = [
            f"ab{k}.cd@mail{k % 7}.example.com",
            f"{k % 200 + 10}.{k}.2.{k % 90}",
            "4111 1111 1111 1111" if k % 8 == 2 else "4012888888881881",
            f"+1 ({200 + k}) 555-01{k:02d}",
        ][k % 4]
        text = f"{before} so {shown} then {after}"
        spans = [s for s in pii.base_spans(text) if text[s[1] : s[2]] == shown]
        rows.append((text, spans))
        for s in spans:
            rows += list(pii.variants(text, s))
        rows.append((f"{before} {k}.{k} and version {k % 5}.0 {after}", []))
    return rows


@pytest.fixture(scope="module")
def field():
    return pii.train(training_rows())


def test_the_field_has_learned_its_table(field):
    hit = total = 0
    for text, spans in training_rows():
        found = pii.field_runs(field, [text])[0]
        for kind, a, b in spans:
            total += 1
            hit += any(pii.LABELS[k] == kind and x < b and a < y for k, x, y in found)
    assert hit / total > 0.95


def test_viterbi_is_the_best_path(field):
    import itertools

    import numpy as np

    text = "call (619) 555-0142 or\njoe at mail.example.com\n1.2.3.4"
    words = pii.words_of(np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32))
    labels = pii.decode(field, words)
    scores = field.scores(words)
    for a, b in zip(words.chains, [*words.chains[1:], len(labels)]):
        def total(path, a=a):
            own = sum(scores[a + t][k] for t, k in enumerate(path))
            return own + sum(field.follows[j][k] for j, k in zip(path, path[1:]))

        best = max(itertools.product(range(pii.N), repeat=b - a), key=total)
        assert total(best) == pytest.approx(total(labels[a:b]), abs=1e-3)


def test_spans_are_added_and_base_ones_stay(spark, field):
    rows = [(k, t, None, None, 0) for k, t in enumerate([*TEXTS, "pay 4111.1111.1111.1111 soon", "mail bo.li at mail3.example.com now", None])]
    got = {r.doc_id: r for r in pii.find(cases.frame(spark, rows), field).collect()}
    for k, text, *_ in rows:
        base = plain_spans(text or "")
        assert got[k].base_sha256 == hashlib.sha256(pii.listed(base).encode()).hexdigest()
        counts = Counter(s[0] for s in base)
        assert [got[k][f"n_{kind}"] for kind in pii.KINDS] == [counts[kind] for kind in pii.KINDS]
        assert set(pii.listed(base).split(",")) <= set(got[k].spans.split(",")) | {""}
    assert got[len(TEXTS)].spans == "card:4:23"
    assert got[len(TEXTS) + 1].spans == "email:5:31"
    assert got[8].spans.startswith("ip:")


def test_no_training_rows_and_no_documents(spark):
    field = pii.train([])
    assert pii.find(cases.frame(spark), field).count() == len(cases.documents())
    assert pii.find(cases.clashing(spark).limit(0), field).count() == 0
    assert pii.labelled_windows(cases.frame(spark).limit(0)) == []


def test_segments_cover_a_long_text(monkeypatch):
    monkeypatch.setattr(pii, "SEGMENT", 50)
    text = cases.prose(8, 60) + "\n" + "y" * 120 + " tail"
    parts = pii.segments(text)
    assert "".join(p for _, p in parts) == text
    assert all(text[at : at + len(p)] == p for at, p in parts)


# ---- backoff scores


def plain_scores(texts, backoff=0.4):
    """Words, words scored from pairs and from triples, and log score of each text."""
    rows = [cases.words(t) for t in texts]
    grams = lambda ws, n: Counter(tuple(ws[k : k + n]) for k in range(len(ws) - n + 1))
    counts = [sum((grams(ws, n) for ws in rows), Counter()) for n in (1, 2, 3)]
    total = sum(counts[0].values())
    out = []
    for ws in rows:
        own = [grams(ws, n) for n in (1, 2, 3)]
        seen, log = [0, 0], 0.0
        for k in range(len(ws)):
            factor = 1.0
            for n in (3, 2):
                if k + 1 >= n:
                    gram = tuple(ws[k - n + 1 : k + 1])
                    others = counts[n - 1][gram] - own[n - 1][gram]
                    if others:
                        seen[n - 2] += 1
                        log += math.log(factor * others / counts[n - 2][gram[:-1]])
                        break
                    factor *= backoff
            else:
                log += math.log(factor * counts[0][(ws[k],)] / total)
        out.append((len(ws), *seen, log))
    return out


def scored(df, model):
    return sorted(
        ((r.doc_id or 0, r.n_words, r.n_pairs_seen, r.n_triples_seen, r.log_score) for r in backoff_lm.scores(df, model).collect()),
        key=lambda r: [x or 0 for x in r],
    )


BIG = 1 << 60
REPEATED = [
    (None, "a b c d", None, None, None),
    (None, "a b c e", None, None, None),
    (BIG + 1, "p q r s", None, None, None),
    (BIG + 2, "p q r t p q", None, None, None),
    (-1, "a b c d x y", None, None, None),
    (7, "one two three", None, None, None),
    (7, "one two three", None, None, None),
    (8, "rare words alone", None, None, None),
    (9, "the " * 5000, None, None, None),
]


@pytest.mark.parametrize("columns", [cases.frame, cases.clashing])
@pytest.mark.parametrize("model", [backoff_lm.Model(), backoff_lm.Model(batch_bytes=300, bucket_bytes=500)])
def test_backoff_scores(spark, columns, model):
    rows = cases.documents()
    df = columns(spark) if columns is cases.clashing else columns(spark, rows + REPEATED)
    rows = rows if columns is cases.clashing else rows + REPEATED
    want = sorted(
        ((r[0] or 0, *found) for r, found in zip(rows, plain_scores([r[1] for r in rows]))),
        key=lambda r: [x or 0 for x in r],
    )
    got = scored(df, model)
    assert [g[:4] for g in got] == [w[:4] for w in want]
    for g, w in zip(got, want):
        assert g[4] == (pytest.approx(w[4]) if w[1] else None)


def test_backoff_tells_rare_pairs_apart(spark):
    """A text of rare words that a second document has scores far above one that none has."""
    rows = [(k, cases.prose(k, 80), None, None, None) for k in range(40)]
    rows += [(100 + k, "xx1 xx2 xx3 xx4 xx5 xx6", None, None, None) for k in range(2)]
    rows += [(200, "yy1 yy2 yy3 yy4 yy5 yy6", None, None, None)]
    got = {r.doc_id: r for r in backoff_lm.scores(cases.frame(spark, rows)).collect()}
    assert got[100].n_triples_seen == 4 and got[200].n_triples_seen == got[200].n_pairs_seen == 0
    assert got[100].mean_log_score > got[200].mean_log_score + 3


def test_backoff_of_nothing(spark):
    assert backoff_lm.scores(cases.frame(spark).limit(0)).count() == 0
