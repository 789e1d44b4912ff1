"""Two-phase logging of postings, and the answers of the receiving service."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vacancia.functions.text import compose_posting_text, let
from vacancia.operators.lookup import first_in_batch, only_new

# Error texts of :func:`classify_api_response`.
UNREACHABLE = "The service could not be reached."
UNEXPECTED = "Unexpected response."


def staged_rows(postings: DataFrame) -> DataFrame:
    """``pending_token, job_posting_text, source_url`` of postings.

    The token is a digest of what is sent, so staging again yields it again.
    """
    return with_token(postings.withColumn("job_posting_text", posting_text()))


def posting_text() -> Column:
    return compose_posting_text(
        F.col("title"),
        F.col("company"),
        F.col("location"),
        F.col("salary_raw"),
        F.col("description_text"),
    )


def with_token(postings: DataFrame) -> DataFrame:
    """Postings with ``pending_token``; one that was worked out where the text lies is kept, so
    that the text need not come along."""
    if "pending_token" in postings.columns:
        return postings
    text = F.col("job_posting_text") if "job_posting_text" in postings.columns else posting_text()
    token = F.sha2(F.concat_ws("|", F.coalesce("source_url", F.lit("")), text), 256)
    return postings.withColumn("pending_token", token)


def stage_submissions(
    postings: DataFrame, applications: DataFrame, order: str, row_id: str
) -> DataFrame:
    """Phase 1: rows to append for postings that are neither logged nor repeated."""
    fresh = first_in_batch(only_new(postings, applications, row_id), order, row_id)
    return staged_rows(fresh)


def not_yet_staged(rows: DataFrame, staged: DataFrame) -> DataFrame:
    """Rows whose token is not staged; what makes a replay append nothing."""
    return rows.join(staged.select("pending_token"), "pending_token", "left_anti")


def confirm_submissions(staged: DataFrame, confirms: DataFrame) -> DataFrame:
    """Phase 2: one application per staged token that was confirmed.

    A token is spent by its first confirmation.
    """
    first = confirms.groupBy("pending_token").agg(F.min("date_applied").alias("date_applied"))
    return staged.join(first, "pending_token").withColumn(
        "application_id", application_id(F.col("pending_token"))
    )


def application_id(token: Column) -> Column:
    return F.substring(token, 1, 32)


def refusals(refused: DataFrame) -> DataFrame:
    """``pending_token, _error``: the least text of each token that was refused."""
    text = F.coalesce(F.min("error"), F.lit(UNEXPECTED)).alias("_error")
    return refused.groupBy("pending_token").agg(text)


def expired_confirms(staged: DataFrame, confirms: DataFrame) -> DataFrame:
    """Confirmations of tokens nobody staged: status 410."""
    return (
        confirms.join(staged.select("pending_token"), "pending_token", "left_anti")
        .withColumn("ok", F.lit(False))
        .withColumn("status", F.lit(410))
    )


def classify_api_response(endpoint: Column, status: Column, body: Column) -> Column:
    """``struct(ok, status, error, value)`` of a logged answer.

    ``value`` is the pending token, the application id or the match, by endpoint
    (``ingest``, ``confirm``, ``lookup``). A null status means no answer came.
    """

    def read(answer: Column) -> Column:
        def field(name: str) -> Column:
            """A field as text; null when missing, null or no JSON."""
            return F.try_variant_get(answer, f"$.{name}", "string")

        def truthy(name: str) -> Column:
            return let(F.try_variant_get(answer, f"$.{name}", "variant"), _truthy)

        complete = (
            F.when(endpoint == "ingest", truthy("pendingToken") & truthy("extraction"))
            .when(endpoint == "confirm", truthy("applicationId"))
            .otherwise(F.lit(True))
        )
        value = (
            F.when(endpoint == "ingest", field("pendingToken"))
            .when(endpoint == "confirm", field("applicationId"))
            .otherwise(F.when(answer.isNotNull(), F.get_json_object(body, "$.match")))
        )
        return F.struct(
            complete.alias("complete"), field("error").alias("error"), value.alias("value")
        )

    # As for JSON-LD, a marker behind the text tells one whole value from a part.
    marked = F.try_parse_json(F.concat(F.lit("["), body, F.lit(',"end"]')))
    answer = let(
        marked,
        lambda m: F.when(
            (F.try_variant_get(m, "$[1]", "string") == "end")
            & F.try_variant_get(m, "$[2]", "variant").isNull(),
            F.try_variant_get(m, "$[0]", "variant"),
        ),
    )
    return let(let(answer, read), lambda r: _verdict(status, r["complete"], r["error"], r["value"]))


def _truthy(member: Column) -> Column:
    """What the service's language takes as true: no null, no empty text, no zero."""

    def test(kind: Column) -> Column:
        text = F.coalesce(F.try_variant_get(member, "$", "string"), F.lit("{}"))
        number = kind.rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)")
        return ~(
            (kind == "VOID")
            | ((kind == "STRING") & (text == ""))
            | ((kind == "BOOLEAN") & (text == "false"))
            | (number & F.coalesce(text.try_cast("double") == 0, F.lit(False)))
        )

    return let(F.coalesce(F.schema_of_variant(member), F.lit("VOID")), test)


def _verdict(status: Column, complete: Column, message: Column, value: Column) -> Column:
    accepted = status.between(200, 299)
    ok = status.isNotNull() & accepted & complete
    error = (
        F.when(status.isNull(), F.lit(UNREACHABLE))
        .when(
            ~accepted,
            F.coalesce(
                message,
                F.concat(F.lit("Request failed ("), status.cast("string"), F.lit(").")),
            ),
        )
        .when(~complete, F.lit(UNEXPECTED))
    )
    return F.struct(
        ok.alias("ok"),
        F.coalesce(status, F.lit(0)).alias("status"),
        error.alias("error"),
        F.when(ok, value).alias("value"),
    )
