"""Registered queries of decontamination, manifest and conversation repair, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vacancia.llm import conversations, decontamination, manifest
from vacancia.llm.common import UPPER, ascii_lower, table

DAMAGES = 20


def decontaminated(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    found = decontamination.occurrences(docs, items)
    n_hit = F.aggregate("hits", F.lit(0).cast("long"), lambda n, s: n + s["length"])
    return found.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.size("hits") > 0).alias("contaminated"),
    )


def merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(*manifest.FIELDS)
    changed = [ascii_lower(F.col(f)) if f == "text" else F.col(f) for f in manifest.FIELDS]
    tampered = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 0, F.lit(False))
    own = manifest.leaf_digest([F.col(f) for f in manifest.FIELDS])
    rows = manifest.leaf_rows(docs, F.when(tampered, manifest.leaf_digest(changed)).otherwise(own))
    built = manifest.build(rows, "doc_id")
    proved = manifest.proofs(built, built.leaves)
    return proved.select(
        "doc_id",
        F.col("digest").alias("leaf"),
        "subroot",
        "root",
        manifest.proof_digest(F.col("path")).alias("proof_sha256"),
        manifest.folded(F.col("claim"), F.col("path")).alias("folded_root"),
    ).withColumn("verified", F.col("folded_root") == F.col("root"))


def damaged(rows: DataFrame) -> DataFrame:
    """The rows with the faults of the contract."""
    space = F.lit(" ")
    named = [F.coalesce(F.col(c).cast("string"), space) for c in ("conv_id", "turn")]
    kind = F.crc32(F.concat(named[0], F.lit(":"), named[1])) % DAMAGES
    text, role = F.coalesce("text", space), F.coalesce("role", space)
    text = F.when(kind == 1, "").when(kind == 2, F.translate(text, ".!?", "")).otherwise(text)
    return (
        rows.select(
            "conv_id",
            "turn",
            F.when(kind == 4, "user").otherwise(role).alias("role"),
            text.alias("text"),
            F.explode(F.array_repeat(F.lit(0), F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1))),
        )
        .drop("col")
    )


def conversations_repaired(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    return conversations.repair(damaged(rows), rows)


# ---- SQL

_FOLD = f"translate(text, '{UPPER}', '{UPPER.lower()}')"

DECONTAMINATION_SQL = rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id,
    regexp_extract_all(coalesce({_FOLD}, ''), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents
), i AS (
  SELECT coalesce(item_id::VARCHAR, '') AS item,
    regexp_extract_all(coalesce({_FOLD}, ''), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark
), item_windows AS (
  SELECT DISTINCT item, least(len(w), 10) AS k, w[p:p + least(len(w), 10) - 1] AS words
  FROM i, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS u(p) WHERE len(w) > 0
), doc_windows AS (
  SELECT r, p, k, w[p:p + k - 1] AS words
  FROM d, (SELECT DISTINCT k FROM item_windows), unnest(range(1, len(w) - k + 2)) AS u(p)
), hits AS (SELECT r, p, k, item FROM doc_windows JOIN item_windows USING (k, words)),
covered AS (
  SELECT r, count(DISTINCT q) AS n_hit FROM hits, unnest(range(p, p + k)) AS u(q) GROUP BY r
), named AS (
  SELECT r, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items
  FROM hits GROUP BY r
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit,
  coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN covered USING (r) LEFT JOIN named USING (r)"""


def _crc32_sql(text: str) -> str:
    """CRC-32 of an ASCII string, half a byte at a time."""
    halves = []
    for k in range(16):
        for _ in range(4):
            k = (k >> 1) ^ (0xEDB88320 * (k & 1))
        halves.append(k)
    known = "[" + ", ".join(f"{k}::BIGINT" for k in halves) + "]"

    def half(x: str) -> str:
        return f"xor({known}[({x} & 15) + 1], {x} >> 4)"

    codes = f"list_transform(range(1, length({text}) + 1), lambda i: ascii(substr({text}, i, 1))::BIGINT)"
    low = f"lambda a, b: {half(half('xor(a, b)'))}"
    return f"xor(list_reduce({codes}, {low}, 4294967295::BIGINT), 4294967295::BIGINT)"


def _manifest_sql(levels: int = 8, top_levels: int = 4) -> str:
    """For at most 8 ** levels rows of a language and 8 ** top_levels languages."""

    def leaf(text: str) -> str:
        fields = [text if f == "text" else f"{f}::VARCHAR" for f in manifest.FIELDS]
        parts = [f"coalesce(strlen({f})::VARCHAR || ':' || {f}, '-')" for f in fields]
        return f"sha256({' || '.join(parts)})"

    def tree(name: str, depth: int) -> list[str]:
        """Runs of each level, and each leaf's siblings and own way through them."""
        steps, at = [], f"{name}0"
        for k in range(depth):
            steps.append(
                f"{name}_runs{k} AS (SELECT grp, idx >> 3 AS up, list(digest ORDER BY idx) AS run, any_value(n) AS n "
                f"FROM {at} GROUP BY grp, idx >> 3)"
            )
            at = f"{name}{k + 1}"
            steps.append(
                f"{at} AS (SELECT grp, up AS idx, CASE WHEN n = 1 THEN run[1] ELSE sha256(array_to_string(run, '')) END "
                f"AS digest, (n + 7) // 8 AS n FROM {name}_runs{k})"
            )
        return steps

    def way(name: str, start: str, depth: int) -> list[str]:
        """From ``start`` (grp, rank, folded, proof) up; one node left is carried on."""
        steps, at = [], start
        for k in range(depth):
            own = f"((rank >> {3 * k}) & 7)"
            steps.append(
                f"{name}_up{k} AS (SELECT t.* EXCLUDE (folded, proof), "
                f"CASE WHEN r.n = 1 THEN folded ELSE sha256(array_to_string(run[1:{own}], '') || folded || "
                f"array_to_string(run[{own} + 2:], '')) END AS folded, "
                f"CASE WHEN r.n = 1 THEN proof ELSE proof || array_to_string(run[1:{own}], '') || "
                f"array_to_string(run[{own} + 2:], '') END AS proof "
                f"FROM {at} t JOIN {name}_runs{k} r ON r.grp = t.grp AND r.up = t.rank >> {3 * (k + 1)})"
            )
            at = f"{name}_up{k}"
        return steps

    low, top = f"l{levels}", f"t{top_levels}"
    steps = [
        f"rows AS (SELECT doc_id, coalesce('=' || lang, '') AS grp, {leaf('text')} AS leaf, "
        f"CASE WHEN {_crc32_sql('doc_id::VARCHAR')} % 3 = 0 THEN {leaf(_FOLD)} ELSE {leaf('text')} END AS claim "
        "FROM documents)",
        "ranked AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY doc_id NULLS FIRST, leaf) - 1 AS rank, "
        "count(*) OVER (PARTITION BY grp) AS n FROM rows)",
        "l0 AS (SELECT grp, rank AS idx, leaf AS digest, n FROM ranked)",
        *tree("l", levels),
        f"subroots AS (SELECT grp AS name, digest AS subroot, row_number() OVER (ORDER BY grp) - 1 AS rank, "
        f"count(*) OVER () AS n FROM {low})",
        "t0 AS (SELECT '' AS grp, rank AS idx, subroot AS digest, n FROM subroots)",
        *tree("t", top_levels),
        "start AS (SELECT doc_id, leaf, grp, rank, claim AS folded, '' AS proof FROM ranked)",
        *way("l", "start", levels),
        f"over AS (SELECT doc_id, leaf, subroot, '' AS grp, s.rank, folded, proof "
        f"FROM l_up{levels - 1} u JOIN subroots s ON s.name = u.grp)",
        *way("t", "over", top_levels),
    ]
    return (
        "WITH " + ",\n".join(steps) + f"\nSELECT doc_id, leaf, subroot, {top}.digest AS root, sha256(proof) AS proof_sha256, "
        f"folded AS folded_root, folded = {top}.digest AS verified FROM t_up{top_levels - 1}, {top}"
    )


def _repair_sql() -> str:
    """Costs, audits and lines of the four states, folded over a conversation from its end."""
    far = 1_000_000_000

    def way(edit: str, cost: str, after: int, line: str | None) -> str:
        lines = f"acc[{after}].t" if line is None else f"list_concat([{line}], acc[{after}].t)"
        return f"{{'c': acc[{after}].c + {cost}, 'a': '{edit}' || acc[{after}].a, 't': {lines}}}"

    def best(q: int) -> str:
        bad = f"CASE WHEN x.f IN (1, 2) THEN {far} ELSE x.f // 3 * {conversations.TRUNCATED_COST} END"
        said = "x.role || ':' || x.text"
        to = conversations.NEXT[q] + 1
        ways = [way("D", "2", q + 1, None), way("R", f"1 + {bad}", to, f"'{conversations.ROLE[q]}:' || x.text")]
        for initial, after in conversations.KEPT[q].items():
            fits = f"CASE WHEN left(x.role, 1) = '{initial}' THEN 0 ELSE {far} END"
            ways.append(way("K", f"{bad} + {fits}", after + 1, said))
        return f"list_min([{', '.join(ways)}])"

    def put(q: int, onward: str) -> str:
        role = conversations.ROLE[q]
        return (
            f"list_transform([{onward}], lambda o: {{'c': o.c + 5, 'a': 'I' || o.a, "
            f"'t': list_concat(['{role}:'], o.t)}})[1]"
        )

    n = [best(q) for q in range(4)]
    two = f"list_min([{n[2]}, {put(2, n[3])}])"
    three = f"list_min([{n[3]}, {put(3, n[2])}])"
    folded = (
        f"[list_min([{n[0]}, {put(0, two)}]), list_min([{n[1]}, {put(1, two)}]), {two}, {three}]"
    )
    end = (
        "[{'c': 0::BIGINT, 'a': '', 't': []::VARCHAR[]}, {'c': 10::BIGINT, 'a': 'II', 't': ['user:', 'assistant:']}, "
        "{'c': 5::BIGINT, 'a': 'I', 't': ['assistant:']}, {'c': 0::BIGINT, 'a': '', 't': []::VARCHAR[]}]"
    )
    key = "coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')"
    blank = r"regexp_replace(text, '[\x20\x09-\x0D]+$', '')"
    return rf"""
WITH kinds AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    {_crc32_sql(key)} % {DAMAGES} AS kind FROM conversations
), rows AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
    CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text
  FROM kinds, unnest(range(CASE kind WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS u(copy)
), ordered AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text)) AS place FROM rows
), faults AS (
  SELECT *, CASE WHEN {blank} = '' THEN 1
      WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY place) > 1 THEN 2
      WHEN right({blank}, 1) NOT IN ('.', '!', '?') THEN 3 ELSE 0 END AS f,
    left(lag(role) OVER (PARTITION BY conv_id ORDER BY place), 1) || left(role, 1) AS pair
  FROM ordered
), lists AS (
  SELECT conv_id, max(turn) - min(turn) + 1 - count(DISTINCT turn) AS gaps,
    count(*) FILTER (f = 1) AS blank, count(*) FILTER (f = 2) AS duplicate,
    count(*) FILTER (f = 3) AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal,
    list({{'f': f, 'role': role, 'text': text}} ORDER BY place DESC) AS back
  FROM faults GROUP BY conv_id
), solved AS (
  SELECT * EXCLUDE (back), list_reduce(back, lambda acc, x: {folded}, {end})[1] AS best FROM lists
)
SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank,
  coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
  coalesce(illegal, 0) AS illegal, coalesce(best.c, 0) AS cost, coalesce(best.a, '') AS audit,
  sha256(coalesce(array_to_string(best.t, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c
  LEFT JOIN solved s ON s.conv_id IS NOT DISTINCT FROM c.conv_id"""


QUERIES = {
    "op11_decontamination": decontaminated,
    "op12_merkle_manifest": merkle_manifest,
    "op13_conversation_repair": conversations_repaired,
}

ORACLES = {
    "op11_decontamination": DECONTAMINATION_SQL,
    "op12_merkle_manifest": _manifest_sql(),
    "op13_conversation_repair": _repair_sql(),
}
