"""SimHash near-duplicates, document fingerprints, components, exact deduplication."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm import cases
from vacancia.llm import exact_dedup, fingerprints, simhash_dedup, votes
from vacancia.llm.components import components


def test_fingerprints_and_components_match_brute_force(spark):
    docs = cases.frame(spark)
    got = simhash_dedup.near_duplicates(docs).collect()
    assert len(got) == len(cases.documents()) - 1  # the repeated row is one document
    prints = {(r[0], r[1]): cases.majority(cases.shingles(r[1], 4)) for r in cases.documents()}
    by_id = {i: p for (i, _), p in prints.items() if i is not None}
    close = lambda a, b: bin(by_id[a] ^ by_id[b]).count("1") <= 4
    want = cases.components(by_id, close)
    for row in got:
        if row.doc_id is not None:
            assert row.fingerprint & (1 << 64) - 1 == by_id[row.doc_id]
            assert row.component_id == want[row.doc_id]
    assert want[2] == 1 and want[9] == 7 and want[4] == 3 and want[5] == 3


def test_links_of_a_key_split_over_chunks(spark):
    rng = random.Random(5)
    base = rng.getrandbits(64)
    prints = sorted({base ^ sum(1 << rng.randrange(64) for _ in range(rng.randrange(9))) for _ in range(400)})
    prints = [p & (1 << 64) - 1 for p in prints]
    rows = [(7, p.to_bytes(8, "big"), k) for k, p in enumerate(prints)]
    table = spark.createDataFrame(rows, "key long, print binary, node long")
    close = lambda a, b: bin(prints[a] ^ prints[b]).count("1") <= 4
    want = cases.components(range(len(prints)), close)
    for most in (30, 4096):
        found = components(simhash_dedup.links(table, 4, 64, most=most))
        got = {r.node: r.component for r in found.collect()}
        assert {k: got.get(k, k) for k in range(len(prints))} == want


def test_every_close_pair_shares_a_key():
    rng = random.Random(1)
    tables = simhash_dedup.masks(7, 3)
    assert len(tables) == 35
    for _ in range(300):
        flips = sum(1 << k for k in rng.sample(range(64), 4))
        assert any(not flips & m for m in tables)


@pytest.mark.parametrize("shape", ["path", "star", "random"])
def test_components(spark, shape):
    rng = random.Random(3)
    if shape == "path":
        pairs = [(k, k + 1) for k in range(60)]
    elif shape == "star":
        pairs = [(500, k) for k in range(100)]
    else:
        pairs = [(rng.randrange(80), rng.randrange(80)) for _ in range(60)]
    links = spark.createDataFrame(pairs + pairs[:5], "a long, b long")
    near = {(a, b) for a, b in pairs} | {(b, a) for a, b in pairs}
    nodes = {x for a, b in pairs if a != b for x in (a, b)}
    want = cases.components(nodes, lambda a, b: (a, b) in near)
    assert {r.node: r.component for r in components(links).collect()} == want


def test_similar_documents_are_grouped_and_others_left_alone(spark):
    rng = np.random.default_rng(9)
    rows, families = [], {}
    for family in range(12):
        words = cases.prose(100 + family, 250).split()
        for member in range(4):
            own = list(words)
            for at in rng.choice(len(own), 3, replace=False) if member else []:
                own[at] = f"new{family}x{member}x{at}"
            families[len(rows)] = family * 4
            rows.append((len(rows), " ".join(own), "en", "s", 0))
    rows += [(k, cases.prose(1000 + k, 120), "en", "s", 0) for k in range(100, 150)]
    families |= {k: k for k in range(100, 150)}
    got = simhash_dedup.similar_documents(cases.frame(spark, rows)).collect()
    assert {r.doc_id: r.component_id for r in got} == families


def test_similar_documents_on_awkward_rows(spark):
    got = {r.doc_id: r.component_id for r in simhash_dedup.similar_documents(cases.clashing(spark)).collect()}
    assert got[9] == got[8] == 7 and got[13] == 6 and got[4] == got[5] == 3 and got[14] == 14


def weighted(text):
    terms = cases.shingles(text, 5)
    return cases.majority(terms, [1 + len(t.encode()) // 16 for t in terms])


def test_document_fingerprints_match_brute_force(spark):
    rows = [r for r in cases.documents() if r[0] is not None]
    rows = sorted({(r[0], r[1] or "") for r in rows}, reverse=True)
    prints = {i: weighted(t) for i, t in rows}
    alike = lambda a, b: 1 - bin(a ^ b).count("1") / 64
    want = {}
    for k, (i, text) in enumerate(rows):
        after_id, after = rows[(k + 1) % len(rows)]
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        near = sum(bin(prints[i] ^ p).count("1") <= 3 for p in prints.values()) - 1
        want[i] = (
            len(text),
            hashlib.sha256(edited.encode()).hexdigest(),
            f"{prints[i]:016x}",
            f"{weighted(edited):016x}",
            alike(prints[i], weighted(edited)),
            alike(prints[i], prints[after_id]),
            near if i % 100 == 0 else None,
        )
    docs = cases.clashing(spark).filter("doc_id is not null")
    got = fingerprints.document_fingerprints(docs).collect()
    assert len(got) == len(want)
    assert {r.doc_id: tuple(r)[1:] for r in got} == want


def test_a_document_alone_and_one_without_id(spark):
    alone = fingerprints.document_fingerprints(cases.frame(spark, [(3, "a b c d e f", None, None, 0)]))
    row = alone.first()
    assert row.near_next == 1.0
    assert row.edited_sha256 == hashlib.sha256(b"a b c da b c").hexdigest()[:64] or row.n_chars == 11
    nobody = fingerprints.document_fingerprints(cases.frame(spark)).filter("doc_id is null").collect()
    assert len(nobody) == 1 and nobody[0].n_near is None


def test_search_finds_all_within_the_radius(spark):
    rng = random.Random(2)
    prints = {rng.getrandbits(64) for _ in range(60)}
    for p in list(prints)[:30]:
        prints |= {p ^ sum({1 << rng.randrange(64) for _ in range(rng.randrange(1, 6))}) for _ in range(4)}
    prints = sorted(prints)
    table = spark.createDataFrame([(simhash_dedup.signed(p),) for p in prints], "fingerprint long")
    got = {(r[0] & (1 << 64) - 1, r[1] & (1 << 64) - 1) for r in fingerprints.within(table, table).collect()}
    assert got == {(a, b) for a in prints for b in prints if bin(a ^ b).count("1") <= 3}


def test_fingerprints_run_no_python(spark):
    plan = fingerprints.document_fingerprints(cases.frame(spark))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_votes_hold_very_many_terms(spark):
    big = spark.range(1).select(F.lit(-1).cast("long").alias("h"))
    sums = big.agg(*votes.vote_sums(F.col("h"), F.lit((1 << 31) - 1))).select(votes.majority().alias("f"))
    assert sums.first().f == -1


# ---- exact


def expected_exact(rows):
    clean = [(i, re.sub(r"[\x20\x09-\x0D]+", " ", t or "")) for i, t in rows]
    out = []
    for i, t in clean:
        same = [j for j, u in clean if u == t]
        known = [j for j in same if j is not None]
        keep = min(known) if known else None
        out.append((i, keep, len(same), hashlib.sha256(t.encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("columns", [cases.frame, cases.clashing])
def test_exact_dedup(spark, columns):
    got = exact_dedup.first_seen(columns(spark)).collect()
    want = expected_exact([(r[0], r[1]) for r in cases.documents()])
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got), key=str) == want
    kept = [r for r in got if r.kept]
    assert len(kept) == len({w[3] for w in want})
    assert all(r.doc_id == r.keep_id for r in kept)


def test_exact_dedup_with_one_hot_text(spark):
    rows = [(k, "the same text" if k % 3 else f"text {k}", None, None, 0) for k in range(3000)]
    got = exact_dedup.first_seen(cases.frame(spark, rows), n_buckets=4).collect()
    assert sum(r.kept for r in got) == 1001
    assert {r.group_size for r in got if r.keep_id == 1} == {2000}


@pytest.mark.parametrize("n", [0, 1, 2, 3, 10, 1000, 50_000])
def test_binary_fuse_filter(n):
    rng = np.random.default_rng(n)
    keys = rng.integers(0, 2**63, n).astype(np.uint64)
    others = rng.integers(2**63, 2**64, 20_000, dtype=np.uint64)
    made = exact_dedup.build_filter(np.concatenate([keys, keys[:3]]))
    assert exact_dedup.may_hold(keys, *made).all()
    if n:
        assert exact_dedup.may_hold(others, *made).mean() < 0.001
    if n >= 50_000:
        assert len(made[3]) / 2 < 1.3 * n


# ---- similar by their sets of shingles


def edited(words, kind, share, seed):
    """``share`` of the words appended, cut off or replaced, in one place."""
    n = round(len(words) * share)
    if kind == "appended":
        return words + cases.prose(seed, n).split()
    if kind == "truncated":
        return words[: len(words) - n]
    at = (seed * 37) % (len(words) - n)
    return words[:at] + cases.prose(seed, n).split() + words[at + n :]


def passages():
    rows = []
    for k in range(90):
        words = cases.prose(7000 + k, 150 + 5 * k).split()
        rows.append(" ".join(words))
        for kind, share in (("appended", 0.23), ("truncated", 0.18), ("replaced", 0.09)):
            most = share if k % 3 else share * 1.3  # a third of the pairs is below the bound
            rows.append(" ".join(edited(words, kind, most, 9000 + 10 * k + len(kind))))
    return [(k, t, "en", "s", 0) for k, t in enumerate(rows)]


def by_similarity(rows):
    sets = {r[0]: frozenset(cases.shingles(r[1], 5)) for r in rows}
    near = lambda a, b: len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])
    return cases.components(sets, near)


@pytest.mark.parametrize("sizes", [{}, {"chunk": 2}, {"chunk_bytes": 4096}])
def test_edited_passages_match_brute_force(spark, sizes):
    rows = passages()
    want = by_similarity(rows)
    linked = [k for k in want if want[k] != k]
    assert 150 < len(linked) < len(rows) - 120
    got = simhash_dedup.similar_documents(cases.frame(spark, rows), simhash_dedup.Similar(**sizes))
    assert {r.doc_id: r.component_id for r in got.collect()} == want


def test_links_of_sets_match_brute_force():
    rng = np.random.default_rng(3)
    base = [np.unique(rng.integers(0, 2**63, 60)).astype(np.uint64) for _ in range(6)]
    sets = [np.unique(np.concatenate([base[k % 6][rng.random(60) > 0.1], base[k % 5][:3]])) for k in range(80)]
    have = [set(s.tolist()) for s in sets]
    near = lambda a, b: len(have[a] & have[b]) >= 0.8 * len(have[a] | have[b])
    linked = set(simhash_dedup.alike(sets, 0.8))
    assert all(near(a, b) for a, b in linked)
    connected = lambda a, b: (a, b) in linked or (b, a) in linked
    assert cases.components(range(80), connected) == cases.components(range(80), near)


def test_sets_of_a_known_label_are_not_compared():
    one = np.arange(100, dtype=np.uint64)
    sets = [one, one[:99], one[:98], np.arange(200, 300, dtype=np.uint64)]
    assert simhash_dedup.alike(sets, 0.8, [5, 5, 5, 9]) == []
    assert len(simhash_dedup.alike(sets, 0.8, [5, 5, 6, 9])) == 1


def test_a_large_family_moves_each_set_a_few_times(spark):
    """Thousands of near copies beside a few that only resemble them: one way for any size."""
    base = cases.prose(77, 300).split()
    rows = []
    for k in range(3000):
        words = list(base)
        words[k % 290] = f"own{k}"
        rows.append((k, " ".join(words), "en", "s", 0))
    for k in range(5):  # too different to link, but close enough to meet
        rows.append((5000 + k, " ".join(base[: 170 + k]), "en", "s", 0))
    docs = cases.frame(spark, rows)
    setup = simhash_dedup.Similar(chunk=256)
    got = {r.doc_id: r.component_id for r in simhash_dedup.similar_documents(docs, setup).collect()}
    assert {got[k] for k in range(3000)} == {0} and {got[5000 + k] for k in range(5)} == {5000}
    prints = simhash_dedup.set_keys(docs, setup)
    keyed = prints.select("node", "size", F.explode("keys").alias("key"))
    several = keyed.groupBy("key").agg(F.min("node").alias("pivot"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    met = keyed.join(several, "key")
    family = prints.filter("doc_id < 3000").select("node", F.lit(0).cast("long").alias("component"))
    moved = simhash_dedup._pieces(met, family, setup).groupBy("node").count().agg(F.max("count").alias("most"), F.avg("count").alias("mean")).first()
    # A piece of the family alone is compared with the few pieces that hold others, not with its like.
    assert moved.mean < 2 * setup.tables
