"""Decontamination, Merkle manifest, conversation repair."""

import hashlib
import itertools
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from tests.llm import cases
from vacancia.llm import audit_queries, conversations, decontamination, manifest

# ---- decontamination


def marked(text, items, width):
    """Hit words and items of a text, window by window."""
    words = decontamination.split_words(text)
    hit, names = set(), set()
    for item, item_text in items:
        own = decontamination.split_words(item_text)
        m = min(width, len(own))
        windows = {tuple(own[k : k + m]) for k in range(len(own) - m + 1)} if own else set()
        for k in range(len(words) - m + 1):
            if tuple(words[k : k + m]) in windows:
                hit.update(range(k, k + m))
                names.add(item or "")
    return len(words), hit, sorted(names)


def test_words():
    assert decontamination.split_words("It's ÉTÉ, été_9\x00Z [x] \x7fÿ") == [
        w.encode() for w in ("it", "s", "ÉtÉ", "été", "9", "z", "x", "ÿ")
    ]
    assert decontamination.split_words(None) == decontamination.split_words(" .,_") == []


@pytest.mark.parametrize("width", [1, 2, 3, 10])
def test_search_equals_every_window(width, tmp_path):
    rnd = random.Random(width)
    for trial in range(60):
        known = [f"w{k}" for k in range(rnd.choice([1, 2, 3, 30]))]
        items = [
            (str(rnd.randint(0, 8)), " ".join(rnd.choices(known, k=rnd.choice([0, 1, 2, 3, 5, 12, 25]))))
            for _ in range(12)
        ]
        texts = [
            " ".join(rnd.choices(known, k=rnd.choice([0, 1, 3, 50, 200]))) + " " + rnd.choice(items)[1]
            for _ in range(10)
        ] + [None, ""]
        path = f"file://{tmp_path}/block-{width}-{trial}"
        decontamination.write_block(decontamination.build_block(items, width), path)
        got = decontamination.search_texts(texts, [decontamination.read_block(path)], rnd.choice([1, 7, 64]))
        for (n, spans, names), text in zip(got, texts):
            hit = {k for s in spans for k in range(s["first"], s["first"] + s["length"])}
            assert (n, hit, names) == marked(text, items, width)
            ends = [(s["first"], s["first"] + s["length"]) for s in spans]
            assert all(a[1] < b[0] for a, b in zip(ends, ends[1:]))


def test_occurrences(spark):
    passage = " ".join(f"p{k}" for k in range(25))
    rows = cases.documents() + [
        (20, "before " + passage.upper() + " after", "en", "a", 1),
        (21, " ".join(passage.split()[3:13]), "en", "a", 1),
        (22, " ".join(passage.split()[3:12]), "en", "a", 1),
        (None, passage, None, None, None),
        (20, "before " + passage.upper() + " after", "en", "a", 1),
        (23, "x " * 200_000 + passage, "en", "a", 1),
    ]
    items = [(1, passage), (2, "short one"), (3, None), (4, " ?!"), (10, passage), (None, "river"), (1, "word")]
    table = spark.createDataFrame([(*i, "x") for i in items], "item_id long, text string, n_words string")
    docs = spark.createDataFrame([(*r, "x", "y") for r in rows], cases.SCHEMA + ", hits string, items string").repartition(3)
    texts = [(None if i is None else str(i), t) for i, t in items]
    want = sorted(
        (str(r[0]), n, sorted(hit), names)
        for r in rows
        for n, hit, names in [marked(r[1], texts, 10)]
    )
    for search in (decontamination.Search(), decontamination.Search(block_bytes=40, lane=3, batch_bytes=100)):
        found = decontamination.occurrences(docs, table, search).collect()
        got = sorted(
            (str(r.doc_id), r.n_words, [k for s in r.hits for k in range(s.first, s.first + s.length)], list(r["items"]))
            for r in found
        )
        assert got == want
    none = decontamination.occurrences(docs, table.limit(0)).collect()
    assert len(none) == len(rows) and not any(r.hits or r["items"] for r in none)
    assert decontamination.occurrences(docs.limit(0), table).count() == 0


# ---- manifest


def plain_hash(parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_leaf(row):
    doc_id, text, lang, source, n_chars = row
    fields = [None if v is None else str(v) for v in (doc_id, source, lang, n_chars, text)]
    return plain_hash("-" if f is None else f"{len(f.encode())}:{f}" for f in fields)


def climb(nodes, at):
    """The top over ``nodes``, and the siblings of number ``at`` on the way."""
    path = []
    while len(nodes) > 1:
        k = at // 8 * 8
        run = nodes[k : k + 8]
        path.append(("".join(run[: at - k]), "".join(run[at - k + 1 :])))
        nodes = [plain_hash(nodes[i : i + 8]) for i in range(0, len(nodes), 8)]
        at //= 8
    return nodes[0], path


def plain_manifest(rows):
    groups = {}
    for row in rows:
        groups.setdefault(row[2], []).append(row)
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    leaves = {}
    for g in order:
        own = sorted(groups[g], key=lambda r: (r[0] is not None, r[0] or 0, plain_leaf(r)))
        leaves[g] = [(r[0], plain_leaf(r)) for r in own]
    tops = {g: climb([leaf for _, leaf in leaves[g]], 0)[0] for g in order}
    out = []
    for at, g in enumerate(order):
        for k, (doc_id, leaf) in enumerate(leaves[g]):
            _, low = climb([d for _, d in leaves[g]], k)
            root, high = climb([tops[o] for o in order], at)
            out.append((str(doc_id), leaf, tops[g], root, low + high))
    return sorted(out)


def proved(built, requests):
    found = manifest.proofs(built, requests).collect()
    return sorted(
        (str(r.doc_id), r.digest, r.subroot, r.root, [(s.left, s.right) for s in r.path]) for r in found
    )


def manifest_of(spark, docs):
    own = manifest.leaf_digest([F.col(f) for f in manifest.FIELDS])
    return manifest.build(manifest.leaf_rows(docs, own), "doc_id")


def test_manifest_equals_plain_trees(spark):
    rows = cases.documents()
    rows += [(1000 + k, f"text {k % 70}", "de", None, k) for k in range(73)]
    rows += [(2000 + k, "t", f"l{k:02}", "s", None) for k in range(9)]
    docs = spark.createDataFrame([(*r, *"abcde") for r in rows], cases.SCHEMA + ", grp string, rank string, digest string, at string, path string")
    built = manifest_of(spark, docs.repartition(5))
    want = plain_manifest(rows)
    assert proved(built, built.leaves) == want
    folded = manifest.proofs(built, built.leaves).select(
        manifest.folded(F.col("digest"), F.col("path")).alias("f"), "root"
    )
    assert folded.filter("f <> root").count() == 0
    # A few requests only, and one for a leaf that is not there.
    some = built.leaves.filter("doc_id in (1003, 1072, 2004, 12)")
    ids = {"1003", "1072", "2004", "12"}
    assert proved(built, some) == [w for w in want if w[0] in ids]
    beyond = built.leaves.filter("doc_id = 1003").withColumn("rank", F.lit(73).cast("long"))
    assert proved(built, beyond) == []


@pytest.mark.parametrize("n", [0, 1, 9])
def test_manifest_of_few_rows(spark, n):
    rows = [(k, "same", None, None, None) for k in range(n)]
    built = manifest_of(spark, cases.frame(spark, rows))
    assert proved(built, built.leaves) == plain_manifest(rows)
    assert built.root.count() == (n > 0)


def test_tampering_shows(spark, tmp_path):
    rows = [(k, "Text with Capitals" if k % 2 else "text without", "en", "a", 1) for k in range(40)]
    cases.frame(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in audit_queries.merkle_manifest(spark, str(tmp_path)).collect()}
    import zlib

    for k in range(40):
        changed = zlib.crc32(str(k).encode()) % 3 == 0 and k % 2
        assert got[k].verified is not bool(changed)
        assert (got[k].folded_root == got[k].root) is got[k].verified


# ---- conversation repair


def fault_of(rows, k):
    role, text = rows[k]
    bare = text.strip(" \t\n\x0b\x0c\r")
    if not bare:
        return "blank"
    if (role, text) in rows[:k]:
        return "duplicate"
    return "" if bare[-1] in ".!?" else "truncated"


def cheapest(rows):
    """Cost, audit and lines of the best of all edits, by trying them all."""
    faults = [fault_of(rows, k) for k in range(len(rows))]
    best = {}

    def legal(initials):
        rest = initials[1:] if initials.startswith("s") else initials
        return not initials or len(rest) >= 2 and len(rest) % 2 == 0 and rest == "ua" * (len(rest) // 2)

    def tried(k, cost, audit, lines, initials):
        if cost > limit:
            return
        if k == len(rows) and legal(initials):
            if "least" not in best or (cost, audit) < best["least"][:2]:
                best["least"] = (cost, audit, lines)
        for role in ("user", "assistant"):
            if audit.count("I") < 3 and (initials + role[0]).lstrip("s") in ("ua" * 20)[: len(initials) + 1]:
                tried(k, cost + 5, audit + "I", [*lines, f"{role}:"], initials + role[0])
        if k == len(rows):
            return
        role, text = rows[k]
        tried(k + 1, cost + 2, audit + "D", lines, initials)
        if faults[k] in ("blank", "duplicate"):
            return
        more = 5 * (faults[k] == "truncated")
        tried(k + 1, cost + more, audit + "K", [*lines, f"{role}:{text}"], initials + (role[:1] or "-"))
        for other in ("user", "assistant"):
            tried(k + 1, cost + more + 1, audit + "R", [*lines, f"{other}:{text}"], initials + other[0])

    limit = 2 * len(rows)  # of deleting all
    tried(0, 0, "", [], "")
    return best["least"]


def expected(turned):
    """All of a conversation's results; ``turned`` has (turn, role, text), ordered."""
    rows = [(r, t) for _, r, t in turned]
    turns = [t for t, _, _ in turned if t is not None]
    faults = [fault_of(rows, k) for k in range(len(rows))]
    pairs = [a[0][:1] + b[0][:1] for a, b in zip(rows, rows[1:])]
    cost, audit, lines = cheapest(rows)
    return (
        max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0,
        *[faults.count(f) for f in ("blank", "duplicate", "truncated")],
        sum(p not in ("su", "ua", "au") for p in pairs),
        cost,
        audit,
        hashlib.sha256("\n".join(lines).encode()).hexdigest(),
    )


def conversation_rows(seed, n, most=5):
    rnd = random.Random(seed)
    out = []
    for conv in range(n):
        turn = 0
        for _ in range(rnd.randint(1, most)):
            turn += rnd.choice([0, 1, 1, 2])
            role = rnd.choice(["system", "user", "assistant", "user", "assistant", "tool", ""])
            text = rnd.choice(["Yes.", "No", " \t", "Really? ", "Well!\n", "So", "Hm."])
            out.append((conv, rnd.choice([turn, turn, turn, None]), role, text))
    return out


def in_order(rows):
    by = {}
    for conv, turn, role, text in rows:
        by.setdefault(conv, []).append((turn, role or " " if role is None else role, " " if text is None else text))
    key = lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).hexdigest())
    return {c: sorted(r, key=key) for c, r in by.items()}


SHAPE = "conv_id long, turn long, role string, text string"
FIELDS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def results(df):
    return {r.conv_id: tuple(r[f] for f in FIELDS) for r in df.collect()}


@pytest.mark.parametrize("chunk", [2, conversations.CHUNK])
def test_repair_equals_trying_all_edits(spark, chunk):
    rows = conversation_rows(chunk, 120) + [(None, None, None, None), (None, 3, "user", "Hi."), (500, 1, "user", None)]
    table = spark.createDataFrame([(*r, "x", "y") for r in rows], SHAPE + ", grp string, rank string").repartition(4)
    got = results(conversations.repair(table, chunk=chunk))
    want = {c: expected(r) for c, r in in_order(rows).items()}
    assert got == want


def test_conversations_without_rows(spark):
    rows = spark.createDataFrame([(1, 1, "user", "Hi.")], SHAPE)
    listed = spark.createDataFrame([(1,), (2,), (2,), (None,)], "conv_id long")
    got = results(conversations.repair(rows, listed))
    none = (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert got[2] == got[None] == none and len(got) == 3
    assert got[1][5:7] == (2, "D")
    assert conversations.repair(rows.limit(0)).count() == 0


def test_long_conversation_by_chunks(spark):
    """One conversation of most rows gives the same in chunks of any size, as SQL does."""
    rnd = random.Random(5)
    rows = [
        (70, k, rnd.choice(["user", "assistant", "system"]), rnd.choice([f"t{k}.", f"t{k}", "again.", " "]))
        for k in range(300)
    ] + conversation_rows(3, 20)
    table = spark.createDataFrame(rows, SHAPE).repartition(6)
    seen = [results(conversations.repair(table, chunk=c)) for c in (3, 512)]
    assert seen[0] == seen[1]
    state, audit = 0, seen[0][70][6]
    assert len(audit.replace("I", "")) == 300
    # The cost by the plain recurrence over all rows.
    costs = conversations.END_COSTS
    plain = [(r, t) for _, r, t in in_order(rows)[70]]
    for k in reversed(range(len(plain))):
        letter = chr(
            65
            + 4 * ("sua".find(plain[k][0][0]) if plain[k][0][0] in "sua" else 3)
            + conversations.FAULTS.index(fault_of(plain, k))
        )
        costs = conversations.node(letter, costs)[0]
    assert costs[state] == seen[0][70][5]


def test_common_ends_are_solved_once(monkeypatch):
    calls = []
    plain = conversations.node
    monkeypatch.setattr(conversations, "node", lambda *a: calls.append(a) or plain(*a))
    letters = [chr(65 + k) for k in (0, 4, 8, 7)]
    signatures = sorted(("".join(s) for s in itertools.product(letters, repeat=4)), key=lambda s: s[::-1])
    nodes = conversations.Suffixes()
    found = [nodes.edits(s, conversations.END_COSTS) for s in signatures]
    assert len(calls) == 4 + 16 + 64 + 256
    assert found == [conversations.Suffixes().edits(s, conversations.END_COSTS) for s in signatures]


@pytest.mark.parametrize("name", sorted(audit_queries.QUERIES))
def test_queries_equal_their_sql(spark, name, tmp_path):
    """On awkward rows, whole; very long texts are compared with plain searches above."""
    short = [r for r in cases.documents() if len(r[1] or "") < 5_000]
    cases.frame(spark, short).write.parquet(f"{tmp_path}/documents.parquet")
    items = [(1, "The quick brown fox jumps over the lazy dog near the river bank"), (2, "river bank"), (3, None)]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = conversation_rows(9, 60, 9) + [(None, 1, "user", "A."), (900, None, None, None)]
    spark.createDataFrame(rows, SHAPE).write.parquet(f"{tmp_path}/conversations.parquet")
    db = duckdb.connect()
    for t in ("documents", "benchmark", "conversations"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    got = audit_queries.QUERIES[name](spark, str(tmp_path))
    names = sorted(got.columns)
    want = db.execute(f"SELECT {', '.join(names)} FROM ({audit_queries.ORACLES[name]})").fetchall()
    assert sorted(map(str, want)) == sorted(str(tuple(r)) for r in got.select(*names).collect())
