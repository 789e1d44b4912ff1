"""Merkle manifest of a table: content-addressed nodes, and proofs found by descent.

Each row is a leaf, the SHA-256 of its fields, each written as its UTF-8 length, a colon
and its value, or ``-`` where it is null. The leaves of a group (null is one) ascend by id,
and while there are several nodes every ``FAN`` neighbours become the hash of their
digests. What remains is the group's subroot; the subroots, ordered by group (null first,
then by bytes), become the root in the same way.

Nodes are kept as records of a digest and its children's digests, by level. A request for
a leaf descends from the root: the digits of its rank in base ``FAN`` say which child to
take at each record, the children not taken are collected as a segment of the path, and
the reversed path is the proof. Requests that share a way share its rows, so a level is
joined once to the records of that level on their digest, and no key is hot but that of
equal subtrees.

Ranks come from a range sort over group and id, with small tables of offsets, so a group
may hold any part of the rows. Only the counts of levels reach the driver.

Rows with the same id are ordered by their digest; equal rows are leaves of their own, and
null ids come first. Null in any field is a field like any other. An empty table has no
nodes and no proofs. Further columns do not count unless named as fields.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vacancia.llm.common import partitions, stored

FAN_BITS = 3
FAN = 1 << FAN_BITS
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(value: Column) -> Column:
    return F.sha2(value, 256)


def leaf_digest(fields: Sequence[Column]) -> Column:
    def written(value: Column) -> Column:
        value = value.cast("string")
        text = F.concat(F.octet_length(value).cast("string"), F.lit(":"), value)
        return F.coalesce(text, F.lit("-"))

    return digest(F.concat(*[written(f) for f in fields]))


def group_key(group: Column) -> Column:
    """A string never null, in the order of the groups."""
    return F.coalesce(F.concat(F.lit("="), group.cast("string")), F.lit(""))


def height(n: Column) -> Column:
    """The number of levels above ``n`` leaves."""
    return reduce(Column.__add__, [(n > F.lit(FAN**k)).cast("int") for k in range(21)])


def ranked(rows: DataFrame, order: Sequence[str]) -> DataFrame:
    """``rows`` with ``rank`` within ``grp`` by ``order``, ``n`` of the group, and its ``height``.

    The rows are sorted over all groups at once; a position follows from the first one of
    the group in its partition and the number of the group's rows in partitions before.
    """
    keys = ["grp", *order]
    spread = rows.repartitionByRange(partitions(rows.sparkSession), *keys)
    placed = spread.sortWithinPartitions(*keys).withColumn("at", F.monotonically_increasing_id())
    placed = stored(placed.withColumn("part", F.shiftright("at", 33)), "manifest-order")
    runs = placed.groupBy("part", "grp").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("here"))
    before = Window.partitionBy("grp").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select(
        "part",
        "grp",
        (F.col("first") - F.coalesce(F.sum("here").over(before), F.lit(0))).alias("origin"),
        F.sum("here").over(Window.partitionBy("grp")).alias("n"),
    ).withColumn("height", height(F.col("n")))
    return placed.join(runs, ["part", "grp"]).withColumn("rank", F.col("at") - F.col("origin")).drop(
        "at", "part", "origin"
    )


@dataclass(frozen=True)
class Tree:
    """``levels[k]``: grp, idx, digest, children of the nodes k above the leaves; level 0
    is ``leaves``. ``tops``: grp, height, digest."""

    levels: list[DataFrame]
    tops: DataFrame


def grown(leaves: DataFrame) -> Tree:
    """The tree of each group over rows of grp, rank, height, digest."""
    at = leaves.select("grp", F.col("rank").alias("idx"), "digest", "height")
    tallest = leaves.agg(F.max("height").alias("h")).first()["h"]
    tops = [at.filter("height = 0")]
    levels: list[DataFrame] = [at]
    for k in range(1, (tallest or 0) + 1):
        parts = at.filter(F.col("height") >= k).withColumns(
            {"digit": F.col("idx") % FAN, "idx": F.shiftright("idx", FAN_BITS)}
        )
        runs = parts.groupBy("grp", "idx", "height").agg(
            F.sort_array(F.collect_list(F.struct("digit", "digest"))).alias("run")
        )
        children = F.transform("run", lambda c: c["digest"])
        at = stored(
            runs.select(
                "grp",
                "idx",
                "height",
                children.alias("children"),
                digest(F.array_join(children, "")).alias("digest"),
            ),
            f"manifest-level-{k}",
        )
        levels.append(at)
        tops.append(at.filter(F.col("height") == k).select("grp", "idx", "digest", "height"))
    return Tree(levels, reduce(DataFrame.unionByName, tops).drop("idx"))


@dataclass(frozen=True)
class Manifest:
    """``leaves``: the rows with grp, rank, n, height and digest; ``groups``: grp, subroot,
    its rank among the subroots, and both heights; ``root``: one row, none for no leaves."""

    leaves: DataFrame
    trees: Tree
    groups: DataFrame
    top: Tree
    root: DataFrame


def build(leaves: DataFrame, order: str) -> Manifest:
    """The manifest over rows of ``grp``, ``digest`` and the column ``order``."""
    leaves = stored(ranked(leaves, [order, "digest"]), "manifest-leaves")
    trees = grown(leaves)
    tops = trees.tops.select(
        F.lit("").alias("grp"), F.col("grp").alias("name"), "digest", F.col("height").alias("own_height")
    )
    groups = stored(ranked(stored(tops, "manifest-subroots"), ["name"]), "manifest-groups")
    top = grown(groups)
    return Manifest(leaves, trees, groups, top, top.tops.select(F.col("digest").alias("root")))


def records(level: DataFrame) -> DataFrame:
    """Digest to children, once for equal subtrees."""
    return level.groupBy("digest").agg(F.first("children").alias("children"))


def _steps(frontier: DataFrame, level: DataFrame) -> DataFrame:
    """Each node's children, with the siblings on either side as a further segment."""
    opened = frontier.join(records(level), "digest").select(
        "grp", "idx", "path", "children", F.posexplode("children").alias("digit", "child")
    )
    return opened.select(
        "grp",
        (F.shiftleft("idx", FAN_BITS) + F.col("digit")).alias("idx"),
        F.col("child").alias("digest"),
        F.concat("path", F.array(siblings(F.col("children"), F.col("digit")))).alias("path"),
    )


def siblings(children: Column, digit: Column) -> Column:
    """The digests left and right of a child."""
    left = F.array_join(F.slice(children, F.lit(1), digit.cast("int")), "")
    right = F.array_join(F.slice(children, (digit + 2).cast("int"), F.lit(FAN)), "")
    return F.struct(left.alias("left"), right.alias("right"))


def _descend(start: DataFrame, tree: Tree, wanted: DataFrame, stop: int) -> DataFrame:
    """Down to level ``stop``, where ``start`` (grp, idx, digest, path, height) comes in at
    each group's own height, along the ways to the ``wanted`` leaves (grp, idx) only."""
    at = start.limit(0).drop("height")
    for k in range(len(tree.levels) - 1, stop - 1, -1):
        at = at.unionByName(start.filter(F.col("height") == k).drop("height"))
        if k > stop:
            ways = wanted.select("grp", F.shiftright("idx", FAN_BITS * (k - 1)).alias("idx")).distinct()
            at = _steps(at, tree.levels[k]).join(ways, ["grp", "idx"], "left_semi")
            at = stored(at, f"manifest-path-{k}")
    return at


def proofs(manifest: Manifest, requests: DataFrame) -> DataFrame:
    """``requests`` (columns grp and rank, others are kept) with subroot, root and ``path``.

    ``path`` holds the siblings left and right of the way, from the leaf up. Requests for
    leaves that are not there give no row.
    """
    wanted = requests.select("grp", F.col("rank").alias("idx"))
    groups = manifest.groups.select("name", "own_height", F.col("digest").alias("subroot"), "rank")
    asked = groups.join(requests.select(F.col("grp").alias("name")).distinct(), "name", "left_semi")
    no_path = F.array().cast("array<struct<left: string, right: string>>")
    start = manifest.top.tops.select("grp", F.lit(0).cast("long").alias("idx"), "digest", "height")
    leaves = asked.select(F.lit("").alias("grp"), F.col("rank").alias("idx"))
    found = _descend(start.withColumn("path", no_path), manifest.top, leaves, 0)
    subroots = asked.join(found.select(F.col("idx").alias("rank"), "path"), "rank")
    subroots = stored(
        subroots.select(
            F.col("name").alias("grp"),
            F.lit(0).cast("long").alias("idx"),
            F.col("subroot").alias("digest"),
            "path",
            F.col("own_height").alias("height"),
        ),
        "manifest-subroot-paths",
    )
    # Leaves meet their parents, an eighth as many, with the path as far as there.
    parents = _descend(subroots, manifest.trees, wanted, 1)
    opened = [subroots.filter("height = 0").select("grp", "idx", "path", F.lit(None).cast("array<string>").alias("children"))]
    if len(manifest.trees.levels) > 1:
        below = parents.join(records(manifest.trees.levels[1]), "digest")
        opened.append(below.select("grp", "idx", "path", "children"))
    nodes = reduce(DataFrame.unionByName, opened).withColumnRenamed("idx", "parent")
    rows = requests.withColumn("parent", F.shiftright("rank", FAN_BITS))
    met = rows.join(nodes, ["grp", "parent"]).filter(
        F.col("children").isNull() & (F.col("rank") == 0) | (F.col("rank") % FAN < F.size("children"))
    )
    last = F.array(siblings(F.col("children"), F.col("rank") % FAN))
    whole = F.when(F.col("children").isNull(), F.col("path")).otherwise(F.concat("path", last))
    subroot = manifest.groups.select(F.col("name").alias("grp"), F.col("digest").alias("subroot"))
    return (
        met.withColumn("path", F.reverse(whole))
        .drop("parent", "children")
        .join(subroot, "grp")
        .join(F.broadcast(manifest.root))  # one row
    )


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its proof lead to."""
    return F.aggregate(path, leaf, lambda low, s: digest(F.concat(s["left"], low, s["right"])))


def proof_digest(path: Column) -> Column:
    return digest(F.array_join(F.transform(path, lambda s: F.concat(s["left"], s["right"])), ""))


def leaf_rows(
    docs: DataFrame,
    claims: Column,
    fields: Sequence[str] = FIELDS,
    group: str = "lang",
    order: str = "doc_id",
) -> DataFrame:
    """grp, ``order``, digest and ``claim`` of each row; texts go no further than here.

    ``claims`` is the digest that the row's holder claims for it."""
    return stored(
        docs.select(
            group_key(F.col(group)).alias("grp"),
            F.col(order),
            leaf_digest([F.col(f) for f in fields]).alias("digest"),
            claims.alias("claim"),
        ),
        "manifest-rows",
    )
