"""Document fingerprints by SimHash, and the search for near ones in permuted block tables.

Terms are five neighbouring words, A-Z lower-cased; a term's weight grows with its length,
so that runs of short, common words count less. Each term's hash votes with its weight for
or against every bit. Likeness is the share of equal bits.

The search splits fingerprints into blocks and keeps one table per choice of the blocks
that must agree if all differing bits lie in the others; a query meets only fingerprints
that agree with it on the chosen blocks, and the distance decides.

Null text is empty text, whose fingerprint is zero. Rows repeated in doc_id and text are
one document; ties of doc_id are ordered by a hash of the text; a null doc_id comes last. Of a single
document the next one is itself. Further columns are ignored. Everything is DataFrame
operations.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vacancia.llm import votes
from vacancia.llm.common import ascii_lower, partitions, stored, words

SHINGLE = 5
NO_ID = -(1 << 63)


def likeness(a: Column, b: Column) -> Column:
    return 1.0 - F.bit_count(a.bitwiseXOR(b)) / F.lit(64.0)


def fingerprints(rows: DataFrame, keys: list[str], text: str, n: int = SHINGLE) -> DataFrame:
    """``keys`` and ``fingerprint`` (long): weighted votes of the text's terms."""
    source = rows.select(*keys, ascii_lower(F.col(text)).alias("__t"))
    flat = votes.shingle_rows(source, keys, words(F.col("__t")), n)
    flat = flat.select(*keys, F.when(
        F.col("w1").isNotNull(), F.concat_ws(" ", *[f"w{k + 1}" for k in range(n)])
    ).alias("term"))
    weight = 1 + F.floor(F.octet_length("term") / 16)
    sums = flat.groupBy(*keys).agg(
        *votes.vote_sums(F.when(F.col("term").isNotNull(), F.xxhash64("term")), weight)
    )
    return sums.select(*keys, votes.majority().alias("fingerprint"))


def neighbours(ids: DataFrame, n: int) -> DataFrame:
    """``own, th, next_own, next_th``: each row's successor by descending id, the last's the first.

    Rows are range-partitioned, a window looks ahead inside each range, and one row per
    range says where the next begins.
    """
    ranged = stored(
        ids.repartitionByRange(n, F.desc("own"), F.desc("th")).withColumn(
            "part", F.spark_partition_id()
        ),
        "ordered",
    )
    order = Window.partitionBy("part").orderBy(F.desc("own"), F.desc("th"))
    heads = ranged.groupBy("part").agg(F.max(F.struct("own", "th")).alias("head"))
    by_part = Window.orderBy("part")  # one row per range
    first = F.first("head").over(by_part.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    heads = heads.select(
        "part", F.coalesce(F.lead("head").over(by_part), first).alias("after")
    )
    ahead = ranged.select(
        "*", F.lead(F.struct("own", "th")).over(order).alias("ahead")
    ).join(heads, "part")
    following = F.coalesce("ahead", "after")
    return ahead.select("own", "th", following["own"].alias("next_own"), following["th"].alias("next_th"))


def edited_documents(docs: DataFrame, text: str, doc_id: str) -> tuple[DataFrame, DataFrame]:
    """Rows (own, th, text, edited), and each one's successor.

    Whole texts are shuffled once, by id, and used from there twice; beside them only the
    beginnings that are put into other texts move.
    """
    spark = docs.sparkSession
    base = docs.select(
        F.coalesce(F.col(doc_id).cast("long"), F.lit(NO_ID)).alias("own"),
        F.coalesce(F.col(text), F.lit("")).alias("text"),
    ).withColumn("th", F.xxhash64("text"))
    ids = base.select("own", "th", F.char_length("text").alias("n")).distinct()
    ids = stored(ids, "ids")
    after = stored(
        neighbours(ids.select("own", "th"), partitions(spark)).join(ids, ["own", "th"]), "after"
    )
    wanted = after.select(
        F.col("next_own").alias("own"),
        F.col("next_th").alias("th"),
        F.col("own").alias("to_own"),
        F.col("th").alias("to_th"),
        F.floor(F.col("n") / 2).cast("int").alias("half"),
    )
    beginnings = base.join(wanted, ["own", "th"]).select(
        F.col("to_own").alias("own"),
        F.col("to_th").alias("th"),
        F.left(F.col("text"), F.col("half")).alias("begin"),
    )
    n = F.char_length("text")
    both = base.join(beginnings, ["own", "th"]).withColumn(
        "edited",
        F.concat(F.left(F.col("text"), (n - F.floor(n / 2)).cast("int")), F.col("begin")),
    )
    return both.select("own", "th", "text", "edited"), after


def block_keys(fingerprint: Column, radius: int, blocks: int) -> Column:
    """One key per table: the chosen blocks, moved nowhere but masked, with the table's number."""
    edges = [round(64 * k / blocks) for k in range(blocks + 1)]
    parts = [(1 << b) - (1 << a) for a, b in zip(edges, edges[1:])]
    keys = []
    for k, chosen in enumerate(combinations(parts, blocks - radius)):
        mask = sum(chosen)
        mask = mask - (1 << 64) if mask >> 63 else mask
        keys.append(F.xxhash64(F.lit(k), fingerprint.bitwiseAND(F.lit(mask))))
    return F.array(*keys)


def within(queries: DataFrame, prints: DataFrame, radius: int = 3, blocks: int = 6) -> DataFrame:
    """``query, fingerprint`` for all fingerprints within ``radius`` bits of each query.

    Both sides have a column ``fingerprint`` of distinct values. A pair met in several
    tables comes out once.
    """
    asked = queries.select(
        F.col("fingerprint").alias("query"),
        F.explode(block_keys(F.col("fingerprint"), radius, blocks)).alias("key"),
    )
    kept = prints.select(
        "fingerprint", F.explode(block_keys(F.col("fingerprint"), radius, blocks)).alias("key")
    )
    near = F.bit_count(F.col("query").bitwiseXOR(F.col("fingerprint"))) <= radius
    return (
        asked.join(kept, (asked["key"] == kept["key"]) & near)
        .select("query", "fingerprint")
        .distinct()
    )


def document_fingerprints(
    docs: DataFrame,
    text: str = "text",
    doc_id: str = "doc_id",
    every: int = 100,
    radius: int = 3,
) -> DataFrame:
    """Fingerprints of all documents and of their edited texts, and their likeness.

    ``n_near`` counts, for documents whose id is divisible by ``every``, the other documents
    with a fingerprint within ``radius`` bits, out of all; it is null for the rest.
    """
    both, after = edited_documents(docs, text, doc_id)
    keys = ["own", "th", "n_chars", "edited_sha256", "which"]
    texts = both.select(
        "own",
        "th",
        F.char_length("text").cast("long").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"),
        F.posexplode(F.array("text", "edited")).alias("which", "__text"),
    )
    made = fingerprints(texts, keys, "__text")
    rows = stored(
        made.groupBy("own", "th").agg(
            F.max("n_chars").alias("n_chars"),
            F.max("edited_sha256").alias("edited_sha256"),
            F.max(F.when(F.col("which") == 0, F.col("fingerprint"))).alias("fingerprint"),
            F.max(F.when(F.col("which") == 1, F.col("fingerprint"))).alias("edited"),
        ),
        "prints",
    )
    counts = stored(
        rows.groupBy("fingerprint").agg(F.count(F.lit(1)).alias("n")), "print-counts"
    )
    asked = rows.filter((F.col("own") % every == 0) & (F.col("own") != NO_ID))
    hits = (
        within(asked.select("fingerprint").distinct(), counts, radius)
        .join(counts, "fingerprint")
        .groupBy("query")
        .agg((F.sum("n") - 1).alias("n_near"))
    )
    following = rows.select(
        F.col("own").alias("next_own"), F.col("th").alias("next_th"), F.col("fingerprint").alias("next")
    )
    is_asked = (F.col("own") % every == 0) & (F.col("own") != NO_ID)
    out = rows.join(
        after.select("own", "th", "next_own", "next_th").join(following, ["next_own", "next_th"]),
        ["own", "th"],
    )
    asked_hits = hits.withColumnRenamed("query", "fingerprint")
    return out.join(asked_hits, "fingerprint", "left").select(
        F.when(F.col("own") != NO_ID, F.col("own")).alias("doc_id"),
        "n_chars",
        "edited_sha256",
        votes.hex16(F.col("fingerprint")).alias("fingerprint"),
        votes.hex16(F.col("edited")).alias("edited_fingerprint"),
        likeness(F.col("fingerprint"), F.col("edited")).alias("near_edited"),
        likeness(F.col("fingerprint"), F.col("next")).alias("near_next"),
        F.when(is_asked, F.col("n_near")).alias("n_near"),
    )
