"""Scoring model answers about business ideas against a pass mark."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import parsing
from ..functions.text import UNKNOWN_SOURCE

# Fixed value.
ERROR_MESSAGE = "Failed to parse model output"


def parse_evaluations(responses: DataFrame, score_keys: list[tuple[str, str]]) -> DataFrame:
    """Scores per response; an answer that is no JSON object becomes an error row with its text."""
    v = F.col("_v")
    scores = F.create_map(
        *[
            part
            for name, key in score_keys
            for part in (
                F.lit(name),
                F.coalesce(parsing.field(v, key, "double"), F.lit(0.0)),
            )
        ]
    )
    ok = v.isNotNull()
    return (
        responses.withColumn("_v", parsing.parsed_object("response"))
        .withColumn("status", F.when(ok, "ok").otherwise("error"))
        .withColumn("message", F.when(~ok, ERROR_MESSAGE))
        .withColumn("raw", F.when(~ok, F.col("response")))
        .withColumn("scores", F.when(ok, scores))
        .withColumn(
            "reason", F.when(ok, F.coalesce(parsing.field(v, "reason", "string"), F.lit("")))
        )
        .drop("_v", "response")
    )


def below_threshold(scores: Column | str, threshold: float) -> Column:
    """Entries under the pass mark, in score order."""
    entries = F.map_entries(F.col(scores) if isinstance(scores, str) else scores)
    return F.filter(entries, lambda e: e["value"] < threshold)


def weak_areas(scores: Column | str, threshold: float) -> Column:
    return F.transform(below_threshold(scores, threshold), lambda e: e["key"])


def verdict(weak: Column | str) -> Column:
    w = F.col(weak) if isinstance(weak, str) else weak
    return F.when(F.size(w) == 0, "pass").when(F.size(w) > 0, "fail")


def next_step(verdict_column: Column | str) -> Column:
    v = F.col(verdict_column) if isinstance(verdict_column, str) else verdict_column
    return F.when(v == "pass", "continue").when(v == "fail", "revise")


def assess(evaluations: DataFrame, threshold: float) -> DataFrame:
    return evaluations.withColumn("weak_areas", weak_areas("scores", threshold)).withColumn(
        "verdict", verdict("weak_areas")
    )


def suggest_fixes(
    assessed: DataFrame, suggestions: DataFrame, id_column: str, aliases: dict[str, str] | None = None
) -> DataFrame:
    """One row per weak area with its suggestions, an empty list where none are known.

    ``aliases`` maps score names to areas of the suggestion table (for
    ``relevance_score``, which the table does not list under that name).
    """
    area = F.col("area")
    for name, target in (aliases or {}).items():
        area = F.when(area == name, target).otherwise(area)
    exploded = assessed.select(id_column, F.posexplode("weak_areas").alias("area_ix", "area"))
    dim = suggestions.withColumnRenamed("area", "_area")
    return (
        exploded.join(dim, area == F.col("_area"), "left")
        .withColumn(
            "suggestions", F.coalesce("suggestions", F.array().cast("array<string>"))
        )
        .drop("_area")
    )


def evaluate_ideas(
    responses: DataFrame,
    score_keys: list[tuple[str, str]],
    suggestions: dict[str, list[str]],
    threshold: float,
) -> DataFrame:
    """The whole verdict record in one narrow pass; the suggestion table rides as a literal map."""
    dim = F.create_map(
        *[
            part
            for area, items in suggestions.items()
            for part in (F.lit(area), F.array(*map(F.lit, items)))
        ]
    )
    nothing = F.array().cast("array<string>")
    assessed = assess(parse_evaluations(responses, score_keys), threshold)
    return assessed.withColumn(
        "suggestions",
        F.map_from_entries(
            F.transform(
                "weak_areas", lambda a: F.struct(a, F.coalesce(F.try_element_at(dim, a), nothing))
            )
        ),
    ).withColumn("next", next_step("verdict"))


def parse_summaries(responses: DataFrame) -> DataFrame:
    """Crawl summaries; an answer that is no JSON object becomes the summary text itself."""
    v = F.col("_v")
    given = F.coalesce("source_name", F.lit(UNKNOWN_SOURCE))
    return responses.withColumn("_v", parsing.parsed_object("response")).select(
        "page_id",
        F.when(v.isNull(), given)
        .otherwise(parsing.field(v, "source_name", "string"))
        .alias("source_name"),
        F.when(v.isNull(), F.col("porter_force"))
        .otherwise(parsing.field(v, "porter_force", "string"))
        .alias("porter_force"),
        F.when(v.isNull(), F.col("response"))
        .otherwise(parsing.field(v, "summary", "string"))
        .alias("summary"),
        F.coalesce(parsing.field(v, "key_metrics", "array<variant>"), F.array().cast("array<variant>")).alias(
            "key_metrics"
        ),
        F.coalesce(parsing.field(v, "data_points", "array<variant>"), F.array().cast("array<variant>")).alias(
            "data_points"
        ),
    )
