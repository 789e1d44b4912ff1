"""The pipeline's stages against brute force, on a small table of documents."""

import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from tests.llm import cases
from vacancia.llm import exact_dedup, fingerprints, queries, simhash_dedup
from vacancia.llm.common import stored

COLUMNS = [c.split()[0] for c in cases.SCHEMA.split(", ")]


def shingle_set(text):
    return frozenset(cases.shingles(text, 5))


def similarity(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def corpus():
    """Families of near copies, exact copies, lone documents, and what no language fits."""
    rng = np.random.default_rng(4)
    rows = []

    def add(text, source="a"):
        rows.append((len(rows), text, "en" if len(rows) % 4 else None, source, len(text or "")))

    for family in range(8):
        words = cases.prose(50 + family, 200).split()
        add(" ".join(words), "ab"[family % 2])
        for copy in range(3):
            own = list(words)
            for at in rng.choice(len(own), 2, replace=False):
                own[at] = f"other{copy}x{at}"
            add(" ".join(own), "abc"[copy])
        add("  ".join(words) + "\n", "c")
    for k in range(30):
        add(cases.prose(500 + k, 40 + k), "abcd"[k % 4])
    rows += [(len(rows) + k, t, None, "d", 0) for k, t in enumerate((None, "", "12 34 !!", "ЖИ"))]
    rows.append(rows[0])
    return rows


@pytest.fixture(scope="module")
def stages(spark):
    """What each stage got and gave."""
    docs = cases.frame(spark, corpus())
    out = []
    for name, stage in corpus_pipeline.STAGES:
        made = stored(stage(spark, docs, ""), name)
        out.append((name, docs, made))
        docs = made
    return {name: (before, after) for name, before, after in out}


def test_order_and_columns(stages):
    assert list(stages) == ["language_id", "exact_dedup", "simhash_near_dedup", "mixing", "packing"]
    for name, (_, after) in stages.items():
        if name != "packing":
            assert after.columns == COLUMNS


def test_only_texts_without_a_language_go(stages):
    before, after = stages["language_id"]
    lost = Counter(r.text for r in before.collect()) - Counter(r.text for r in after.collect())
    assert set(lost) == {None, "", "12 34 !!", "ЖИ"}


def test_first_copies_stay(stages):
    before, after = stages["exact_dedup"]
    first = {}
    for r in before.collect():
        key = re.sub(r"[\x20\x09-\x0D]+", " ", r.text or "")
        first[key] = min(first.get(key, r.doc_id), r.doc_id)
    assert sorted(r.doc_id for r in after.collect()) == sorted(first.values())


def test_one_of_each_family_stays(stages):
    before, after = stages["simhash_near_dedup"]
    sets = {r.doc_id: shingle_set(r.text) for r in before.collect()}
    want = cases.components(sets, lambda a, b: similarity(sets[a], sets[b]) >= 0.8)
    assert sorted(r.doc_id for r in after.collect()) == sorted(set(want.values()))


def test_documents_stay_as_often_as_the_mix_takes_them(stages):
    from vacancia.llm import mixing

    before, after = stages["mixing"]
    want = {r.doc_id: r.copies for r in mixing.mix(before).collect() if r.copies}
    assert Counter(r.doc_id for r in after.collect()) == want
    assert max(want.values()) <= 3


def test_every_id_is_packed_once(stages):
    before, after = stages["packing"]
    own = Tokenizer.from_file(queries.packing_setup().vocabulary)
    want = Counter()
    for r in before.collect():
        want[r.doc_id] += len(own.encode(r.text, add_special_tokens=False).ids) + 1
    got, used = Counter(), defaultdict(int)
    for r in after.collect():
        got[r.doc_id] += r.length
        used[r.sequence_id] += r.length
    assert got == want
    assert all(n <= 1024 and n & (n - 1) == 0 for n in used.values())


def test_run_reads_documents(spark, tmp_path):
    cases.frame(spark, corpus()).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() > 0


@pytest.mark.parametrize("rows", [[], [(None, None, None, None, None)], [(1, "one text only", "en", "a", 1)]])
def test_tiny_tables(spark, tmp_path, rows):
    cases.frame(spark, rows, parts=1).write.parquet(str(tmp_path / "documents.parquet"))
    assert (corpus_pipeline.run(spark, str(tmp_path)).count() > 0) == (len(rows) > 0 and rows[0][0] == 1)


def test_empty_tables(spark):
    none = cases.clashing(spark).limit(0)
    assert exact_dedup.first_seen(none).count() == 0
    assert simhash_dedup.near_duplicates(none).count() == 0
    assert simhash_dedup.similar_documents(none).count() == 0
    assert fingerprints.document_fingerprints(none).count() == 0


def test_text_hashes_of_the_dedup_query(spark):
    got = exact_dedup.first_seen(cases.frame(spark, corpus()[:3])).collect()
    want = {hashlib.sha256(r[1].encode()).hexdigest() for r in corpus()[:3]}
    assert {r.text_sha256 for r in got} == want


def test_rows_that_share_an_id_are_decided_apart(spark):
    """Lone texts of one id, or of none, stay beside a near copy; each is mixed by itself."""
    family = cases.prose(800, 200)
    rows = [(1, family, "en", "a", 0), (2, family + " end", "en", "a", 0)]
    rows += [(2, cases.prose(801, 90), "en", "a", 0), (1, cases.prose(802, 70), "en", "a", 0)]
    rows += [(1, family + " other end", "en", "a", 0)]
    left = corpus_pipeline.one_of_similar(spark, cases.frame(spark, rows), "").collect()
    texts = [r.text for r in left]
    assert {rows[2][1], rows[3][1]} < set(texts) and len(texts) == 3


def test_copies_of_rows_that_share_an_id(spark):
    from vacancia.llm import mixing

    rows = [(k // 3 if k < 60 else None, cases.prose(900 + k, 20 + 17 * (k % 9)), "en", "abc"[k % 2], 0) for k in range(90)]
    docs = cases.frame(spark, rows)
    plan = mixing.mix(docs.withColumn("hash", F.xxhash64("text")), carry=("hash",)).collect()
    want = {(r.doc_id, r.hash): r.copies for r in plan if r.copies}
    after = corpus_pipeline.mixed(spark, docs, "").withColumn("hash", F.xxhash64("text"))
    got = Counter((r.doc_id, r.hash) for r in after.collect())
    assert got == want and max(got.values()) <= 3
    assert len(want) < len(rows)
