"""Mixing sources to target weights by entropy balancing.

Targets: sources in code point order, null last, get the given weights in turn and share
the whole size accordingly; a target stops at ``most`` times its source's size and the
excess goes to the others by weight.

Rates: of all ways to weight the documents whose weighted sizes meet the targets, the one
that is closest to taking each document once has rates ``exp(lambda)`` with one multiplier
per source. The multipliers minimise the convex dual
``sum(size * exp(lambda)) - sum(lambda * target)``; each Newton step sums the tilted sizes
over all documents' cells in a distributed aggregate. Copies: rates are rounded to whole
copies by a hash, one size class after another from the largest; what a class takes too
much or too little is made up by the next smaller ones.

Null text has size 0. Documents of size 0 take nothing. An empty table gives no rows. Rows
repeated with their doc_id are one document each and get equal copies. Further columns are
ignored. Everything is DataFrame operations.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vacancia.llm.common import n_words, stored

WEIGHTS = (5, 2, 1)
MOST = 3


def same(a: Column, b: Column) -> Column:
    return a.eqNullSafe(b)


def sizes(
    docs: DataFrame, text: str, source: str, doc_id: str, carry: tuple[str, ...] = ()
) -> DataFrame:
    """doc_id, source, size, class of size and a hash that orders documents: narrow rows."""
    rows = docs.select(
        F.col(doc_id).alias("doc_id"),
        F.col(source).alias("source"),
        n_words(F.col(text)).alias("size"),
        *carry,
    )
    # md5 spreads ids that follow each other; 52 bits of it make a number below one.
    spread = F.conv(F.substring(F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 1, 13), 16, 10)
    return rows.withColumns(
        {
            "class": F.when(F.col("size") > 0, F.floor(F.log2(F.col("size")))).otherwise(-1).cast("int"),
            "u": spread.cast("double") / F.lit(float(1 << 52)),
        }
    )


def targets(by_source: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """``source, source_size`` with ``target``. One small row per source.

    A source is full when ``most * size`` is at most its weight times the water level.
    Sources sorted by the level at which they are full: with those before it full, a
    source's level is what is left over the weights left; the level sought is the first
    that does not fill its own source.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    turn = F.array(*[F.lit(float(w)) for w in weights])
    rows = by_source.withColumn("rank", F.row_number().over(order) - 1).withColumn(
        "weight", F.get(turn, (F.col("rank") % len(weights)).cast("int"))
    )
    rows = rows.withColumn("cap", F.col("source_size") * float(most))
    filling = Window.orderBy((F.col("cap") / F.col("weight")).asc(), F.col("rank"))
    before = filling.rowsBetween(Window.unboundedPreceding, -1)
    after = filling.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    whole = Window.partitionBy()
    rows = rows.withColumn(
        "level",
        (F.sum("source_size").over(whole) - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
        / F.sum("weight").over(after),
    )
    is_open = F.col("cap") > F.col("level") * F.col("weight")
    rows = rows.withColumn("nth", F.row_number().over(filling))
    first_open = F.min(F.when(is_open, F.struct("nth", "level"))).over(whole)
    rows = rows.withColumn("water", first_open["level"])
    return rows.select(
        "source",
        "source_size",
        F.least("cap", F.coalesce(F.col("water") * F.col("weight"), F.col("cap"))).alias("target"),
    )


def multipliers(
    cells: DataFrame, aims: DataFrame, steps: int = 50, tolerance: float = 1e-12
) -> DataFrame:
    """``source, multiplier`` by Newton's method on the dual.

    ``cells`` are the sufficient counts (source, size, n) of the documents. Each step
    aggregates gradient and curvature over them and stores the new multipliers, one row
    per source, so the plan does not grow and a lost executor repeats one step at most.
    """
    now = stored(
        aims.filter((F.col("target") > 0) & (F.col("source_size") > 0)).select(
            "source", "target", F.lit(0.0).alias("multiplier")
        ),
        "mix-step",
    )
    for _ in range(steps):
        tilted = (
            cells.alias("c")
            .join(now.alias("m"), same(F.col("c.source"), F.col("m.source")))
            .groupBy("m.source", "m.target", "m.multiplier")
            .agg(F.sum(F.col("n") * F.col("size") * F.exp("multiplier")).alias("taken"))
        )
        # Gradient: taken - target; curvature: taken. A step up is at most one, where the
        # exponential would overshoot.
        step = F.least((F.col("target") - F.col("taken")) / F.col("taken"), F.lit(1.0))
        now = stored(
            tilted.select(
                "source",
                "target",
                (F.col("multiplier") + step).alias("multiplier"),
                (F.abs(F.col("taken") - F.col("target")) / F.col("target")).alias("off"),
            ),
            "mix-step",
        )
        if (now.agg(F.max("off").alias("off")).first()["off"] or 0.0) <= tolerance:
            break
        now = now.drop("off")
    return now.select("source", "multiplier")


def copies(rate: Column, u: Column, most: int) -> Column:
    """A rate rounded to whole copies: the fraction is the share of documents rounded up."""
    whole = F.floor(rate)
    return F.least(whole + F.when(u < rate - whole, 1).otherwise(0), F.lit(most)).cast("long")


def rounded(rows: DataFrame, rates: DataFrame, most: int) -> DataFrame:
    """``source, class, rate`` after carrying each class's rounding to the next smaller.

    One pass per class of sizes, of which there are as many as powers of two up to the
    longest document; each sums the words its documents take under the rate they get.
    Where the smaller classes could not make up for what came out, as with one document
    that is larger than the target, all of the class is rounded down or up instead,
    whichever leaves less.
    """
    smaller = Window.partitionBy("source").orderBy("class").rowsBetween(
        Window.unboundedPreceding, -1
    )
    by_class = stored(
        rows.filter("size > 0")
        .groupBy("source", "class")
        .agg(F.sum("size").alias("words"))
        .withColumn("rest", F.coalesce(F.sum("words").over(smaller), F.lit(0))),
        "mix-classes",
    )
    top = by_class.agg(F.max("class").alias("top")).first()["top"]
    carry = stored(
        rates.select("source", "rate", F.lit(0.0).alias("carried")), "mix-carry"
    )
    parts: list[DataFrame] = []
    for k in range(top if top is not None else -1, -1, -1):
        here = by_class.filter(F.col("class") == k).select("source", "words", "rest")
        wanted = (
            carry.alias("r")
            .join(here.alias("h"), same(F.col("r.source"), F.col("h.source")), "left")
            .select(
                "r.source",
                "r.rate",
                "r.carried",
                F.col("h.words"),
                F.col("h.rest"),
                F.least(
                    F.greatest(F.col("r.rate") + F.col("r.carried") / F.col("h.words"), F.lit(0.0)),
                    F.lit(float(most)),
                ).alias("own"),
            )
        )
        got = (
            rows.filter(F.col("class") == k)
            .alias("d")
            .join(wanted.alias("w"), same(F.col("d.source"), F.col("w.source")))
            .groupBy(F.col("w.source").alias("of"))
            .agg(F.sum(copies(F.col("w.own"), F.col("d.u"), most) * F.col("d.size")).alias("taken"))
        )
        due = F.col("carried") + F.col("rate") * F.col("words")
        low, high = F.floor("own").cast("double"), F.least(F.ceil("own"), F.lit(most)).cast("double")
        left = {"hashed": due - F.col("taken"), "low": due - low * F.col("words")}
        left["high"] = due - high * F.col("words")
        lost = {
            name: F.greatest(
                value - (most - F.col("rate")) * F.col("rest"),
                -value - F.col("rate") * F.col("rest"),
                F.lit(0.0),
            )
            for name, value in left.items()
        }
        pick = F.when(lost["hashed"] <= F.least(lost["low"], lost["high"]), F.lit("hashed")).when(
            lost["low"] <= lost["high"], F.lit("low")
        ).otherwise(F.lit("high"))
        taken = wanted.alias("w").join(got, same(F.col("w.source"), F.col("of")), "left")
        taken = taken.withColumn("pick", F.when(F.col("words").isNotNull(), pick))

        def picked(hashed: Column, low: Column, high: Column, none: Column) -> Column:
            how = F.col("pick")
            return (
                F.when(how == "hashed", hashed).when(how == "low", low).when(how == "high", high)
            ).otherwise(none)

        carry = stored(
            taken.select(
                "w.source",
                "w.rate",
                picked(left["hashed"], left["low"], left["high"], F.col("carried")).alias("carried"),
                F.lit(k).alias("class"),
                picked(F.col("own"), low, high, F.lit(None)).alias("own"),
            ),
            "mix-carry",
        )
        parts.append(carry.filter(F.col("own").isNotNull()).select("source", "class", "own"))
        carry = carry.drop("class", "own")
    out = rates.select("source", F.lit(-1).alias("class"), F.lit(0.0).alias("own"))
    for part in parts:
        out = out.unionByName(part)
    return out


def mix(
    docs: DataFrame,
    text: str = "text",
    source: str = "source",
    doc_id: str = "doc_id",
    weights: tuple[int, ...] = WEIGHTS,
    most: int = MOST,
    carry: tuple[str, ...] = (),
) -> DataFrame:
    """doc_id, source, size, source_size, target, copies and taken for every document, and
    the columns named in ``carry``."""
    rows = stored(sizes(docs, text, source, doc_id, carry), "mix-sizes")
    cells = stored(
        rows.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n")), "mix-cells"
    )
    by_source = cells.groupBy("source").agg(F.sum(F.col("n") * F.col("size")).alias("source_size"))
    aims = stored(targets(by_source, weights, most), "mix-targets")
    tilt = multipliers(cells, aims)
    rates = stored(
        aims.alias("a")
        .join(tilt.alias("t"), same(F.col("a.source"), F.col("t.source")), "left")
        .select(
            "a.source",
            F.least(F.coalesce(F.exp("t.multiplier"), F.lit(0.0)), F.lit(float(most))).alias("rate"),
        ),
        "mix-rates",
    )
    final = stored(
        rounded(rows, rates, most)
        .alias("p")
        .join(aims.alias("a"), same(F.col("p.source"), F.col("a.source")))
        .select("p.source", "p.class", "p.own", "a.source_size", "a.target"),
        "mix-plan",
    )
    fits = same(F.col("d.source"), F.col("f.source")) & (F.col("d.class") == F.col("f.class"))
    n = copies(F.col("f.own"), F.col("d.u"), most)
    return (
        rows.alias("d")
        .join(final.alias("f"), fits)
        .select(
            "d.doc_id",
            "d.source",
            "d.size",
            "f.source_size",
            "f.target",
            n.alias("copies"),
            (n * F.col("d.size")).alias("taken"),
            *[F.col(f"d.{c}") for c in carry],
        )
    )
