"""The corpus pipeline: language ID, exact and near deduplication, mixing, packing.

Each stage gets the rows its predecessor kept, with the columns of ``documents``, and its
decisions are applied: the next one sees only what stays. ``run`` writes every stage's rows
as Parquet into the shared folder and reads them again, so a lost executor never costs more
than the stage at hand.

Empty tables pass through. Rows without doc_id are kept unless their text is an exact copy
or no language is found; repeated rows are exact copies.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vacancia.llm import exact_dedup, language_id, mixing, packing, simhash_dedup
from vacancia.llm.common import stored, table
from vacancia.llm.queries import packing_setup

NO_ID = -(1 << 63)
# A text whose profile has less than this in common with every language's is of none.
LEAST_SCORE = 0.2


def _own(doc_id: str = "doc_id"):
    return F.coalesce(F.col(doc_id).cast("long"), F.lit(NO_ID))


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is found; the label of a document is not looked at for it."""
    model = language_id.learn(docs.select("doc_id", "text", "lang"))
    judged = language_id.predict(docs, model)
    found = (F.col("lang_pred") != language_id.UNDETERMINED) & (F.col("score") >= LEAST_SCORE)
    return judged.filter(found).select(*docs.columns)


def first_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the smallest doc_id, once."""
    kept = exact_dedup.first_seen(docs).filter("kept")
    kept = kept.select(_own().alias("__own"), F.col("text_sha256").alias("__sha"))
    rows = docs.withColumns(
        {"__own": _own(), "__sha": F.sha2(exact_dedup.normalised(F.col("text")), 256)}
    )
    again = Window.partitionBy("__own", "__sha").orderBy("__own")
    return (
        rows.join(kept, ["__own", "__sha"], "left_semi")
        .withColumn("__nth", F.row_number().over(again))
        .filter("__nth = 1")
        .select(*docs.columns)
    )


def one_of_similar(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the row with the smallest doc_id, known by id and text.

    Texts whose SimHash fingerprints are linked meet, and those that share a key of their
    shingle sets; what meets is confirmed by the sets themselves."""
    near = stored(simhash_dedup.near_rows(docs), "pipeline-simhash")
    rows = simhash_dedup.similar_rows(docs, near=near)
    other = (F.col("doc_id") != F.col("component_id")) | (F.col("own") != F.col("component_own"))
    dropped = rows.filter(other).select(F.col("doc_id").alias("__id"), F.col("own").alias("__own"))
    here = (F.col("doc_id").cast("long") == F.col("__id")) & (F.xxhash64("text") == F.col("__own"))
    return docs.join(dropped.distinct(), here, "left_anti").select(*docs.columns)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it. Empty documents take no part."""
    rows = docs.withColumns({"__own": _own(), "__text": F.xxhash64("text")})
    plan = mixing.mix(rows, carry=("__text",)).filter("copies > 0")
    plan = plan.select(
        _own().alias("__own"), "__text", F.col("source").alias("__source"), F.col("copies").alias("__copies")
    )
    # Of a row that is repeated as it is, every copy has the same decision.
    plan = plan.distinct()
    same = [rows["__own"] == plan["__own"], rows["__text"] == plan["__text"]]
    rows = rows.join(plan, [*same, mixing.same(rows["source"], plan["__source"])])
    copies = F.explode(F.sequence(F.lit(1), F.col("__copies").cast("int")))
    return rows.withColumn("__copy", copies).select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in their sequences."""
    return packing.pack(docs, packing_setup())


STAGES = [
    ("language_id", known_language),
    ("exact_dedup", first_copies),
    ("simhash_near_dedup", one_of_similar),
    ("mixing", mixed),
    ("packing", packed),
]

# Language profiles, fingerprints and token ids are beyond SQL; tests compare the stages
# with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs


QUERIES = {"pipeline": run}
ORACLES: dict[str, str] = {}
