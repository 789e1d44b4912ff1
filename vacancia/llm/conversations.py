"""Conversation repair: the cheapest edits that give each conversation a legal order of roles.

The rows of a conversation are taken by turn (null first, ties by role and digest of the
text). The first fault of a row counts: blank (nothing but white space), duplicate (role
and text seen earlier in the conversation), truncated (its last character that is no white
space is none of ``.!?``). Keeping a row costs 0, giving it the role user or assistant 1,
deleting it 2, inserting an empty user or assistant row 5; blank and duplicate rows have to
go, truncated ones that stay cost 5 more. The initials of the roles have to read
``(s?(ua)+)?``; of the cheapest edits those with the least initials are taken.

A row's role initial and fault are one symbol, a conversation's symbols its signature.
Equal signatures are solved once, and signatures with a common end share what follows: they
are sorted from their end, so that a stack of automaton nodes, each a symbol and what comes
after it, is all that a task holds. A node knows for each state of the grammar the cost to
go and the first edit of the best way on, from which the audit of any signature through it
is read off. As each edit has its own initial, ties are settled by that edit alone.

A conversation may hold any part of the rows: ranks come from a range sort, signatures are
cut into chunks of ``CHUNK`` rows, and what lies behind a chunk counts only by the four
costs to go, less the least. For conversations of several chunks these come from products
of the chunks' cost matrices, chunk upon chunk, so no task ever holds more than ``CHUNK`` of
anything. Only the digest of the repaired text has to see a conversation in one piece: its
rows stream by, sorted, and one text is held at a time.

Null role and text are one space; an empty role has no initial, so it cannot be kept. A null conversation is a conversation. Conversations are
found by their key alone: those without rows have no edits. Empty tables give no rows.
Further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from vacancia.llm.common import SPACE, partitions, stored
from vacancia.llm.manifest import group_key, ranked

# Fixed values of the contract.
KEEP, REROLE, DELETE, INSERT = "K", "R", "D", "I"
COST = {KEEP: 0, REROLE: 1, DELETE: 2, INSERT: 5}
TRUNCATED_COST = 5
FAULTS = ("", "blank", "duplicate", "truncated")
INITIALS = "sua"
# States: nothing yet, after system, after user, after assistant. Ends are the first and last.
STATES = 4
ROLE = ("user", "user", "assistant", "user")  # of a row put in at a state
NEXT = (2, 2, 3, 2)
KEPT = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})

CHUNK = 512
FAR = 1 << 40
Costs = tuple[int, ...]


def symbol(initial: Column, fault: Column) -> Column:
    """One letter for a row: which initial (the last is any other), which fault."""
    one = sum((F.when(initial == c, F.lit(k)).otherwise(F.lit(0)) for k, c in enumerate(INITIALS)), F.lit(0))
    other = F.when(initial.isin(*INITIALS), one).otherwise(F.lit(len(INITIALS)))
    return F.char(F.lit(65) + other * len(FAULTS) + fault)


def read_symbol(letter: str) -> tuple[str, str]:
    initial, fault = divmod(ord(letter) - 65, len(FAULTS))
    return (INITIALS + "?")[initial], FAULTS[fault]


def _inserted(costs: list[tuple[int, str]]) -> tuple[Costs, str]:
    """Costs and edits of the states where rows may be put in first."""
    best = list(costs)
    for q in (2, 3, 0, 1):
        # Out of the two states that lead to each other, from what does without.
        onward = costs[NEXT[q]] if q in (2, 3) else best[NEXT[q]]
        best[q] = min(best[q], (onward[0] + COST[INSERT], INSERT))
    return tuple(c for c, _ in best), "".join(e for _, e in best)


END_COSTS, END_EDITS = _inserted([(0, "."), (FAR, "."), (FAR, "."), (0, ".")])


def node(letter: str, after: Costs) -> tuple[Costs, str]:
    """Cost to go and first edit of each state at a row, from the costs to go behind it."""
    initial, fault = read_symbol(letter)
    costs = []
    for q in range(STATES):
        ways = [(after[q] + COST[DELETE], DELETE)]
        if fault not in ("blank", "duplicate"):
            more = TRUNCATED_COST if fault == "truncated" else 0
            ways.append((after[NEXT[q]] + COST[REROLE] + more, REROLE))
            if initial in KEPT[q]:
                ways.append((after[KEPT[q][initial]] + COST[KEEP] + more, KEEP))
        costs.append(min(ways))
    return _inserted(costs)


def levelled(costs: Iterable[int]) -> Costs:
    costs = tuple(costs)
    least = min(costs)
    return tuple(min(c - least, FAR) for c in costs)


def matrix(signature: str) -> list[int]:
    """The cost from each state ahead of the rows to each state behind them."""
    columns = []
    for q in range(STATES):
        costs: Costs = tuple(0 if t == q else FAR for t in range(STATES))
        for letter in reversed(signature):
            costs = node(letter, costs)[0]
        columns.append(costs)
    return [min(columns[t][q], FAR) for q in range(STATES) for t in range(STATES)]


def applied(m: list[int], after: Costs) -> Costs:
    """Costs to go ahead of rows with cost matrix ``m``."""
    return levelled(min(m[STATES * q + t] + after[t] for t in range(STATES)) for q in range(STATES))


def product(a: list[int], b: list[int]) -> list[int]:
    n = range(STATES)
    return [min(FAR, min(a[STATES * q + k] + b[STATES * k + t] for k in n)) for q in n for t in n]


class Suffixes:
    """The automaton's nodes of one signature at a time; those of a common end stay."""

    def __init__(self) -> None:
        self.begin: Costs | None = None
        self.letters: list[str] = []
        self.nodes: list[tuple[Costs, str]] = []  # from the end

    def edits(self, signature: str, behind: Costs) -> list[str]:
        """For each row the first edit of each state, with ``behind`` the costs after the last."""
        if behind != self.begin:
            self.begin, self.letters, self.nodes = behind, [], []
        backwards = signature[::-1]
        shared = 0
        for a, b in zip(backwards, self.letters):
            if a != b:
                break
            shared += 1
        del self.letters[shared:], self.nodes[shared:]
        for letter in backwards[shared:]:
            self.nodes.append(node(letter, self.nodes[-1][0] if self.nodes else behind))
            self.letters.append(letter)
        return [edits for _, edits in reversed(self.nodes)]


def faulty(rows: DataFrame) -> DataFrame:
    """grp, turn, role, digest, rank, n and letter of each row; texts go no further.

    ``rows`` has grp, turn, role, text, without nulls but in turn.
    """
    bare = F.btrim(F.col("text"), F.lit(SPACE))
    own = F.when(bare == "", 1).when(~F.right(bare, F.lit(1)).isin(".", "!", "?"), 3).otherwise(0)
    narrow = rows.select("grp", "turn", "role", F.sha2("text", 256).alias("digest"), own.alias("own"))
    placed = ranked(narrow, ["turn", "role", "digest"])
    said = placed.groupBy("grp", "role", "digest").agg(
        F.min("rank").alias("first"), F.count(F.lit(1)).alias("times")
    )
    again = said.filter("times > 1").drop("times")
    joined = placed.join(again, ["grp", "role", "digest"], "left")
    fault = F.when((F.col("own") != 1) & (F.col("rank") > F.col("first")), 2).otherwise(F.col("own"))
    return joined.select(
        "grp", "turn", "role", "digest", "rank", "n", symbol(F.left("role", F.lit(1)), fault).alias("letter")
    )


def _arrow(df: DataFrame, schema: str, columns: list[str], each) -> DataFrame:
    """Rows through a function of lists of ``columns`` to lists of the schema's columns."""
    source = df.select(*columns)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = each()
        for batch in batches:
            made = [kept(*row) for row in zip(*[c.to_pylist() for c in batch.columns])]
            out = list(zip(*made)) or [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], names)

    shape = to_arrow_schema(StructType.fromDDL(schema))
    names, kinds = shape.names, shape.types
    return source.mapInArrow(run, schema)


def boundaries(chunks: DataFrame, chunk: int) -> DataFrame:
    """grp, part, behind: the levelled costs to go behind each chunk that has others around it.

    Matrices are multiplied over ``chunk`` neighbours at a time until one is left of each
    conversation; then the costs come down the same way.
    """
    many = chunks.filter(F.col("n") > chunk)
    known = _arrow(
        many.select("signature").distinct(), "signature string, m array<long>", ["signature"],
        lambda: lambda s: (s, matrix(s)),
    )
    at = stored(many.join(known, "signature").select("grp", "part", "m"), "conversation-costs")
    levels = []
    while (at.agg(F.max("part").alias("p")).first()["p"] or 0) > 0:
        runs = stored(
            at.groupBy("grp", F.floor(F.col("part") / chunk).alias("upper")).agg(
                F.sort_array(F.collect_list(F.struct("part", "m"))).alias("run")
            ),
            "conversation-runs",
        )
        levels.append(runs)

        def multiplied():
            def one(grp, upper, run):
                m = run[0]["m"]
                for r in run[1:]:
                    m = product(m, r["m"])
                return grp, upper, m

            return one

        at = stored(
            _arrow(runs, "grp string, part long, m array<long>", ["grp", "upper", "run"], multiplied),
            "conversation-costs",
        )

    def spread():
        def one(grp, run, behind):
            out = []
            for r in reversed(run):
                out.append({"part": r["part"], "behind": list(behind)})
                behind = applied(r["m"], tuple(behind))
            return grp, out

        return one

    found = at.select("grp", "part", F.array(*[F.lit(c).cast("long") for c in END_COSTS]).alias("behind"))
    for runs in reversed(levels):
        met = runs.join(found.withColumnRenamed("part", "upper"), ["grp", "upper"])
        each = _arrow(
            met, "grp string, out array<struct<part: long, behind: array<long>>>", ["grp", "run", "behind"], spread
        )
        found = stored(each.select("grp", F.inline("out")), "conversation-behind")
    return found


def decided(rows: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """The rows of ``faulty`` with ``edits``, the first edit of each state."""
    part = F.floor(F.col("rank") / chunk).cast("long")
    chunks = rows.groupBy("grp", part.alias("part")).agg(
        F.first("n").alias("n"),
        F.sort_array(F.collect_list(F.struct("rank", "turn", "role", "digest", "letter"))).alias("rows"),
    )
    chunks = stored(
        chunks.withColumn("signature", F.array_join(F.transform("rows", lambda r: r["letter"]), "")),
        "conversation-chunks",
    )
    end = F.array(*[F.lit(c).cast("long") for c in END_COSTS])
    chunks = chunks.join(boundaries(chunks, chunk), ["grp", "part"], "left").withColumn(
        "behind", F.coalesce("behind", end)
    )
    distinct = chunks.select("behind", "signature").distinct().withColumn("backwards", F.reverse("signature"))
    spread = distinct.repartitionByRange(partitions(rows.sparkSession), "behind", "backwards")
    ordered = spread.sortWithinPartitions("behind", "backwards")

    def solved():
        nodes = Suffixes()
        return lambda behind, signature: (behind, signature, nodes.edits(signature, tuple(behind)))

    solutions = _arrow(
        ordered, "behind array<long>, signature string, edits array<string>", ["behind", "signature"], solved
    )
    met = chunks.join(stored(solutions, "conversation-edits"), ["behind", "signature"])
    each = F.inline(F.arrays_zip("rows", "edits"))
    return met.select("grp", each).select("grp", "rows.*", "edits")


REPAIRS = (
    "grp string, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, "
    "audit string, repaired_sha256 string"
)
LEGAL = ("su", "ua", "au")


class Conversation:
    """What is known of a conversation while its rows stream by."""

    def __init__(self, grp: str):
        self.grp = grp
        self.turns: list[int] = []  # first, last, how many
        self.faults = dict.fromkeys(FAULTS, 0)
        self.illegal = self.cost = self.state = 0
        self.initial: str | None = None
        self.audit = bytearray()
        self.hash = hashlib.sha256()
        self.any = False

    def put(self, line: str) -> None:
        self.hash.update(("\n" * self.any + line).encode("utf-8", "surrogatepass"))
        self.any = True

    def edit(self, edits: str, role: str, text: str) -> str:
        """Edits up to the one that takes the row, which is returned."""
        while True:
            edit = edits[self.state]
            if edit == ".":
                return edit
            self.audit += edit.encode()
            self.cost += COST[edit]
            if edit == DELETE:
                return edit
            if edit == KEEP:
                self.put(f"{role}:{text}")
                self.state = KEPT[self.state][role[0]]
                return edit
            self.put(f"{ROLE[self.state]}:{'' if edit == INSERT else text}")
            self.state = NEXT[self.state]
            if edit == REROLE:
                return edit

    def take(self, turn: int | None, role: str, text: str, letter: str, edits: str) -> None:
        if turn is not None:
            first, last, n = self.turns or (turn, None, 0)
            self.turns = [first, turn, n + (turn != last)]
        fault = read_symbol(letter)[1]
        self.faults[fault] += 1
        if self.initial is not None:
            self.illegal += self.initial + role[:1] not in LEGAL
        self.initial = role[:1]
        edit = self.edit(edits, role, text)
        if fault == "truncated" and edit != DELETE:
            self.cost += TRUNCATED_COST

    def result(self) -> tuple:
        self.edit(END_EDITS, "", "")
        first, last, n = self.turns or (0, -1, 0)
        counts = [self.faults[f] for f in FAULTS[1:]]
        return (
            self.grp, last - first + 1 - n, *counts, self.illegal, self.cost,
            self.audit.decode("ascii"), self.hash.hexdigest(),
        )


def repaired(rows: DataFrame, edits: DataFrame) -> DataFrame:
    """One row per conversation: each text comes ahead of the rows that have it."""
    none = F.lit(None).cast("string")
    texts = rows.select(
        "grp", "turn", "role", F.sha2("text", 256).alias("digest"), F.lit(-1).cast("long").alias("rank"),
        "text", none.alias("letter"), none.alias("edits"),
    )
    both = texts.unionByName(edits.withColumn("text", none))
    spread = both.repartition(partitions(rows.sparkSession), "grp")
    ordered = spread.sortWithinPartitions("grp", "turn", "role", "digest", "rank")
    shape = to_arrow_schema(StructType.fromDDL(REPAIRS))

    def stream(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at: Conversation | None = None
        text = ""

        def made(results: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*results)) or [()] * len(shape.names)
            arrays = [pa.array(c, k) for c, k in zip(columns, shape.types)]
            return pa.RecordBatch.from_arrays(arrays, shape.names)

        for batch in batches:
            done = []
            for grp, turn, role, own, letter, first in zip(*[c.to_pylist() for c in batch.columns]):
                if at is None or at.grp != grp:
                    if at is not None:
                        done.append(at.result())
                    at = Conversation(grp)
                if letter is None:
                    text = own
                else:
                    at.take(turn, role, text, letter, first)
            yield made(done)
        if at is not None:
            yield made([at.result()])

    return ordered.select("grp", "turn", "role", "text", "letter", "edits").mapInArrow(stream, REPAIRS)


def repair(
    rows: DataFrame,
    conversations: DataFrame | None = None,
    conversation: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    text: str = "text",
    chunk: int = CHUNK,
) -> DataFrame:
    """Faults, cost, audit and digest of the repaired text of each conversation.

    ``conversations`` lists those to return (its column ``conversation``), also without rows;
    by default the ones in ``rows``. ``chunk`` is 2 at least.
    """
    if chunk < 2:
        raise ValueError("a chunk has two rows at least")
    space = F.lit(" ")
    own = rows.select(
        group_key(F.col(conversation)).alias("grp"),
        F.col(turn).cast("long").alias("turn"),
        F.coalesce(role, space).alias("role"),
        F.coalesce(text, space).alias("text"),
    )
    found = repaired(own, decided(stored(faulty(own), "conversation-rows"), chunk))
    listed = rows if conversations is None else conversations
    names = listed.select(F.col(conversation).alias("name")).distinct().withColumn("grp", group_key(F.col("name")))
    filled = names.join(found, "grp", "left")
    zero = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return filled.select(
        F.col("name").alias(conversation),
        *zero,
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"),
    )
