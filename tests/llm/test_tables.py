"""URL filter, mixing, packing, WARC archives."""

import re
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tests.llm import cases
from vacancia.llm import mixing, packing, queries, url_filter, warc

# ---- URLs

URLS = [
    ("http://a.example.com/en/1", "example.com/en/", "block"),
    ("http://WWW.Example.com/en/x?y#z", "www.example.com/en/", "allow"),
    ("https://x.www.example.com/en/", "www.example.com/en/", "allow"),
    ("https://notexample.com/en/", "com/", "allow"),
    ("https://casino.example.com/fr/1", "com/", "allow"),
    ("https://example.com", None, "allow"),
    ("https://a.net/es/1", "net/es/", "block"),
    ("https://a.net/fr", None, "allow"),
    ("https://casino-win.org/", None, "block"),
    ("https://casinos.org/", None, "allow"),
    ("https://free-bet.org/win", None, "block"),
    ("https://free-free.org/free", None, "allow"),
    ("https://adult-x.org", None, "block"),
    ("ftp://h/p://q", None, "allow"),
    ("no scheme casino", None, "block"),
    (None, None, "allow"),
    ("", None, "allow"),
    ("https://x.org/" + "a" * 200_000 + "/porn", None, "block"),
]


def test_urls(spark):
    rows = [(k, u, "h") for k, (u, _, _) in enumerate(URLS)]
    docs = spark.createDataFrame(rows, "page_id long, url string, rule string")
    got = {r.page_id: r for r in url_filter.judge_urls(docs, setup=queries.URL_SETUP).collect()}
    for k, (url, rule, verdict) in enumerate(URLS):
        assert (got[k].rule, got[k].verdict) == (rule, verdict), url
        parts = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
        assert (got[k].host, got[k].path) == ((parts[1].lower(), parts[2]) if parts else ("", ""))
    assert url_filter.judge_urls(docs.limit(0)).count() == 0
    plain = url_filter.UrlFilter(vocabulary=url_filter.Vocabulary(strict=(), soft=()))
    assert {r.verdict for r in url_filter.judge_urls(docs, setup=plain).collect()} == {"allow"}


# ---- mixing


def water_filled(by_source, weights=mixing.WEIGHTS, most=mixing.MOST):
    names = sorted((s for s in by_source if s is not None), key=lambda s: s.encode())
    names += [None] * (None in by_source)
    weight = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    total = sum(by_source.values())
    fixed = {}
    while True:
        left = total - sum(fixed.values())
        rest = {s: weight[s] for s in names if s not in fixed}
        out = {s: left * w / sum(rest.values()) for s, w in rest.items()}
        over = {s: float(most * by_source[s]) for s, t in out.items() if t > most * by_source[s]}
        if not over:
            return fixed | out
        fixed |= over


@pytest.mark.parametrize("columns", [cases.frame, cases.clashing])
def test_mixing_awkward_rows(spark, columns):
    got = mixing.mix(columns(spark)).collect()
    assert len(got) == len(cases.documents())
    sizes = defaultdict(int)
    for r in cases.documents():
        sizes[r[3]] += len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or ""))
    want = water_filled(sizes)
    for r in got:
        assert r.source_size == sizes[r.source]
        assert r.target == pytest.approx(want[r.source])
        assert r.taken == r.copies * r.size and 0 <= r.copies <= 3
    assert sorted(map(tuple, mixing.mix(columns(spark)).collect()), key=str) == sorted(map(tuple, got), key=str)


def test_mixing_comes_near_its_targets(spark):
    rng = np.random.default_rng(0)
    rows, sizes = [], defaultdict(int)
    for k in range(1500):
        source = "abcdefg"[min(6, int(rng.exponential(1.5)))]
        n = int(rng.lognormal(3, 1))
        sizes[source] += n
        rows.append((k, "w " * n, None, source, 0))
    got = mixing.mix(cases.frame(spark, rows)).collect()
    taken = defaultdict(int)
    for r in got:
        taken[r.source] += r.taken
    want = water_filled(sizes)
    assert sum(want.values()) == pytest.approx(sum(sizes.values()))
    for source, target in want.items():
        assert abs(taken[source] - target) <= 0.01 * target + 2


def test_one_large_document_cannot_be_made_up_for(spark):
    rows = [(1, "w " * 1000, None, "b", 0), (2, "w " * 10, None, "b", 0), (3, "w " * 5000, None, "a", 0)]
    got = {r.doc_id: r for r in mixing.mix(cases.frame(spark, rows)).collect()}
    assert got[1].target == pytest.approx(6010 * 2 / 7)
    assert got[1].taken + got[2].taken == 2000 + 0 or abs(got[1].taken + got[2].taken - got[1].target) < 720


def test_mixing_nothing(spark):
    assert mixing.mix(cases.frame(spark).limit(0)).count() == 0
    assert [r.taken for r in mixing.mix(cases.frame(spark, [(1, None, None, None, 0)])).collect()] == [0]


def test_mixing_runs_no_python(spark):
    plan = mixing.sizes(cases.frame(spark), "text", "source", "doc_id")._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


# ---- packing

SETUP = packing.Packing(vocabulary=public_tokenizers.path("byte_bpe_50k.json"))


def tokenizer():
    return Tokenizer.from_file(SETUP.vocabulary)


def test_ids_are_the_tokenizers():
    words, own = packing.words_of(SETUP.vocabulary), tokenizer()
    assert words.quick is not None
    texts = ["", " ", "  a", "a  b\n c \n", "<|endoftext|> x", "it's 'LL", "x\x1c y\x85 z\xa0 w", "日本 語", "é 12³½"]
    texts += ["a" + chr(k) + " " + chr(k) + "b c" + chr(k) for k in range(1, 0x3100) if not 0xD800 <= k < 0xE000]
    texts += [cases.prose(3, 60_000), "q" * 250_000, "  " * 120_000 + "end"]
    for text, ids in zip(texts, words.ids(texts)):
        want = own.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(ids, words.kind).tolist() == want, text[:40]


def test_other_vocabularies_are_left_to_the_tokenizer():
    words = packing.Words(public_tokenizers.path("word_bpe_49k.json"))
    assert words.quick is None
    own = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    assert np.frombuffer(words.ids(["Some words"])[0], words.kind).tolist() == own.encode("Some words", add_special_tokens=False).ids


def test_ids_equal_the_tokenizer_on_random_texts():
    """Thousands of texts of awkward characters: spaces, controls, marks, joiners, digits, scripts."""
    words, own = packing.words_of(SETUP.vocabulary), tokenizer()
    rng = np.random.default_rng(11)
    awkward = list(" \t\n\r\x0b\x00\x7f\u00a0\u200b\u200d\u2028\ufeff\u0301'’s_-.,!?09٣aZéßİıǅ한字🙂👩\U0001f1e9\U0010ffff") + [
        "'ll", "  ", "\r\n", "<|endoftext|>", "the", " The", "123456"
    ]
    texts = ["".join(rng.choice(awkward, size=rng.integers(0, 40))) for _ in range(6000)]
    texts += ["".join(rng.choice(awkward, size=20_000))]
    got = words.ids(texts)
    for text, raw in zip(texts, got):
        want = own.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(raw, words.kind).tolist() == want, repr(text)


@pytest.mark.parametrize("columns", [cases.frame, cases.clashing])
def test_packing_is_gapless_and_whole(spark, columns):
    own = tokenizer()
    got = packing.pack(columns(spark), SETUP, with_ids=True).collect()
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in got:
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
        ids = np.frombuffer(r.ids, "<u2").astype("<u4")
        assert len(ids) == r.length and zlib.crc32(ids.tobytes()) == r.ids_crc32
    padding = used = 0
    for rows in sequences.values():
        at = 0
        for r in sorted(rows, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at == rows[0].sequence_length <= 1024
        used += at
        padding += 0 if at & (at - 1) == 0 else 1024 - at
    assert padding == 0
    for i, text, *_ in cases.documents():
        want = own.encode(text or "", add_special_tokens=False).ids + [0]
        rows = sorted(pieces[i], key=lambda r: r.start)
        if i == 15:  # twice in the table
            assert sum(r.length for r in rows) == 2 * len(want)
            continue
        assert np.concatenate([np.frombuffer(r.ids, "<u2") for r in rows]).tolist() == want
        assert {r.doc_tokens for r in rows} == {len(want)}
    assert packing.pack(columns(spark).limit(0), SETUP).count() == 0


@pytest.mark.parametrize("d,bits", [(2, 5), (3, 3), (4, 2)])
def test_the_curve_visits_every_cell_by_single_steps(d, bits):
    points = np.stack(np.meshgrid(*[np.arange(1 << bits)] * d), -1).reshape(-1, d)
    keys = packing.hilbert_keys(points, bits)
    assert sorted(keys.tolist()) == list(range(len(points)))
    assert np.abs(np.diff(points[np.argsort(keys)], axis=0)).sum(axis=1).max() == 1


def test_alike_documents_are_near_on_the_curve():
    words = packing.words_of(SETUP.vocabulary)
    base = cases.prose(1, 400)
    texts = [base, base + " river3"] + [cases.prose(k, 400) for k in range(2, 60)]
    keys = packing.curve_keys([np.frombuffer(b, words.kind) for b in words.ids(texts)], words.n_ids, 4, 10)
    order = np.argsort(keys).tolist()
    assert abs(order.index(0) - order.index(1)) < 6


# ---- WARC


def pages(spark):
    rows = [(k, f"http://h/{k}", f"<p>{k % 7}</p>" * (k % 5), "x") for k in range(60)]
    rows += [(60, None, None, "x"), (61, "http://h/é y", "é" * 70_000, "x"), (62, "", "", "x")]
    return spark.createDataFrame(rows, "page_id long, url string, html string, sha string"), rows


def archive(spark, layout):
    table, rows = pages(spark)
    folder = warc.archive_folder(spark)
    manifest = warc.write_archives(table, folder, layout=layout).collect()
    return folder, manifest, rows


@pytest.mark.parametrize("least", [0, 30])
def test_round_trip(spark, least):
    folder, manifest, rows = archive(spark, warc.Layout(least=least, roll_bytes=2000))
    got = {r.row_id: r for r in warc.read_archives(spark, folder).collect()}
    last: dict = {}
    for k, _, html, _ in rows:
        last[html or ""] = k
    for k, url, html, _ in rows:
        body = (html or "").encode()
        first = last[html or ""] if len(body) >= least else k
        r = got[k]
        assert (r.payload_bytes, r.payload_digest) == (len(body), warc.payload_digest(body))
        assert (r.record_type, r.refers_to) == (("response", None) if first == k else ("revisit", first))
        assert r.payload == (body if first == k else None)
    assert len(manifest) > 3 and sum(m.records for m in manifest) == len(rows)


def test_archives_are_deterministic(spark):
    one, two = (archive(spark, warc.Layout(roll_bytes=1500))[1] for _ in range(2))
    assert sorted(one) == sorted(two)


def test_archives_do_not_depend_on_session_or_splits(spark):
    """Tens of thousands of rows, a third of them without an id, many with equal payloads."""
    n = 50_000
    layout = warc.Layout(files=6, roll_bytes=200_000)
    made = []
    for session, splits in ((spark, 3), (spark.newSession(), 17)):
        folder = warc.archive_folder(session)
        k = F.col("id")
        table = session.range(n).repartition(splits).select(
            F.when(k % 3 > 0, k).alias("page_id"),
            F.concat(F.lit("http://h/"), k).alias("url"),
            F.repeat(F.concat(F.lit("p"), (k * 7919 % 30_011).cast("string")), F.lit(5)).alias("html"),
        )
        manifest = warc.write_archives(table, folder, layout=layout)
        made.append(sorted(manifest.collect(), key=lambda m: m.file))
        assert warc.read_archives(session, folder, with_payload=False).count() == n
    assert made[0] == made[1]
    by_shard: dict = {}
    for m in made[0]:
        by_shard[m.file[:12]] = by_shard.get(m.file[:12], 0) + m.records
    # Rows without an id lie in several shards, and all are of like size.
    assert len(by_shard) == 6 and max(by_shard.values()) < 2 * min(by_shard.values())
    assert sum(m.first_id is None for m in made[0] if m.file.endswith("00000.warc.gz")) >= 2


def test_only_listed_and_whole_files_are_read(spark):
    import os

    folder, manifest, rows = archive(spark, warc.Layout(roll_bytes=1500))
    base = folder.removeprefix("file://")
    with open(f"{base}/shard-000000-99999.warc.gz", "wb") as f:
        f.write(b"left behind by a task that died")
    assert warc.read_archives(spark, folder).count() == len(rows)
    assert not [f for f in os.listdir(base) if f.startswith(".shard")]
    with open(f"{base}/{manifest[0].file}", "ab") as f:
        f.write(b"x")
    with pytest.raises(Exception, match="manifest"):
        warc.read_archives(spark, folder).count()


def test_no_pages(spark):
    folder = warc.archive_folder(spark)
    assert warc.write_archives(pages(spark)[0].limit(0), folder).count() == 0
    assert warc.read_archives(spark, folder).count() == 0
