"""The given tables, and the URLs and pages the queries build from their rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vacancia.session import configure


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return configure(spark).read.parquet(f"{sf_dir}/{name}.parquet")


# How many partitions the caller wants inputs dealt over; unset, files are read as they lie.
INPUT_PARTITIONS = "vacancia.input.partitions"


def texts(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table whose long texts are worked on."""
    return dealt(table(spark, sf_dir, name))


def dealt(rows: DataFrame) -> DataFrame:
    """Dealt over as many partitions as the caller has set, for files too few to share."""
    wanted = rows.sparkSession.conf.get(INPUT_PARTITIONS, None)
    return rows.repartition(int(wanted)) if wanted else rows


def pick(selector: Column, *options: Column | str | None) -> Column:
    """The option whose position the selector holds; texts are literals."""
    out = F.lit(None)
    for i, option in reversed(list(enumerate(options))):
        value = option if isinstance(option, Column) else F.lit(option)
        out = F.when(selector == i, value).otherwise(out)
    return out


def fmt(template: str, **values: Column) -> Column:
    """``template`` with ``{name}`` replaced by the columns."""
    parts: list[Column] = []
    rest = template
    while rest:
        at = min((rest.find("{" + n + "}") for n in values if "{" + n + "}" in rest), default=-1)
        if at < 0:
            parts.append(F.lit(rest))
            break
        name = rest[at + 1 : rest.index("}", at)]
        if at:
            parts.append(F.lit(rest[:at]))
        parts.append(values[name].cast("string"))
        rest = rest[at + len(name) + 2 :]
    return F.concat(*parts)


def escape_html(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
