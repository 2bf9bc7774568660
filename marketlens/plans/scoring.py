"""Scoring queries: parse model answers, verdicts, suggestions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import parsing
from ..operators import scoring as ops
from ..sources.tables import derived
from . import dimensions as dim
from . import sql_text as q
from .registry import query

THRESHOLD = dim.PASS_THRESHOLD

_OBJECT = "case when json_valid(response) and json_type(response) = 'OBJECT' then response end"
_COLUMNS = {name: key for name, key in dim.SCORE_KEYS}


def _score_sql(key: str) -> str:
    return f"coalesce(try_cast(json_extract_string(obj, '$.{key}') as double), 0.0) as {key}"


EVAL_SQL = f"""
parsed as (select idea_id, idea, response, {_OBJECT} as obj from responses),
scored as (
  select idea_id, case when obj is null then 'error' else 'ok' end as status,
    case when obj is null then response end as raw,
    {", ".join(f"case when obj is not null then {_score_sql(k).rsplit(' as ', 1)[0]} end as {k}" for k in _COLUMNS.values())},
    case when obj is not null then coalesce(json_extract_string(obj, '$.reason'), '') end as reason
  from parsed),
long_scores as (
  {" union all ".join(f"select idea_id, {i} as area_ix, '{name}' as area, {key} as score from scored where status = 'ok'" for i, (name, key) in enumerate(dim.SCORE_KEYS))}),
weak as (select * from long_scores where score < {THRESHOLD}),
verdicts as (
  select s.idea_id, case when any_value(status) = 'ok'
      then coalesce(string_agg(w.area, '|' order by w.area_ix), '') end as weak_areas,
    case when any_value(status) <> 'ok' then null
      when count(w.area) = 0 then 'pass' else 'fail' end as verdict
  from scored s left join weak w using (idea_id) group by s.idea_id)
"""


def evaluations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.parse_evaluations(derived(spark, sf_dir, "responses"), dim.SCORE_KEYS)


def flat_scores(df: DataFrame) -> list:
    return [F.col("scores")[name].alias(key) for name, key in dim.SCORE_KEYS]


def assessed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All evaluations; the unreadable ones have neither weak areas nor a verdict."""
    return ops.assess(evaluations(spark, sf_dir), THRESHOLD)


@query(
    "response_normalize",
    f"""select idea_id, case when json_valid(response)
      then json(response)::varchar else {q.strip('response')} end as normalized
    from responses""",
    uses=("responses",),
)
def response_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived(spark, sf_dir, "responses").select(
        "idea_id", parsing.response_normalize("response").alias("normalized")
    )


@query(
    "summary_parse",
    f"""with parsed as (select *, {_OBJECT} as obj from summaries)
    select page_id,
      case when obj is null then coalesce(source_name, 'Unknown')
        else json_extract_string(obj, '$.source_name') end as source_name,
      case when obj is null then porter_force
        else json_extract_string(obj, '$.porter_force') end as porter_force,
      case when obj is null then response else json_extract_string(obj, '$.summary') end as summary,
      coalesce(json_array_length(obj, '$.key_metrics'), 0)::bigint as n_key_metrics,
      coalesce(json_array_length(obj, '$.data_points'), 0)::bigint as n_data_points
    from parsed""",
    uses=("summaries",),
)
def summary_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        ops.parse_summaries(derived(spark, sf_dir, "summaries"))
        .withColumn("n_key_metrics", F.size("key_metrics").cast("long"))
        .withColumn("n_data_points", F.size("data_points").cast("long"))
        .drop("key_metrics", "data_points")
    )


@query(
    "eval_parse",
    f"with {EVAL_SQL} select * from scored",
    uses=("responses",),
)
def eval_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = evaluations(spark, sf_dir)
    return e.select("idea_id", "status", "raw", *flat_scores(e), "reason")


@query(
    "filter_below_threshold",
    f"with {EVAL_SQL} select idea_id, area, score from weak",
    uses=("responses",),
)
def filter_below_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        evaluations(spark, sf_dir)
        .select("idea_id", F.inline(ops.below_threshold("scores", THRESHOLD)))
        .withColumnsRenamed({"key": "area", "value": "score"})
    )


@query(
    "eval_verdict",
    f"with {EVAL_SQL} select * from verdicts",
    uses=("responses",),
)
def eval_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assessed(spark, sf_dir).select(
        "idea_id", F.array_join("weak_areas", "|").alias("weak_areas"), "verdict"
    )


@query(
    "eval_next",
    f"""with {EVAL_SQL} select idea_id, verdict,
      case verdict when 'pass' then 'continue' when 'fail' then 'revise' end as next from verdicts""",
    uses=("responses",),
)
def eval_next(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assessed(spark, sf_dir).select("idea_id", "verdict", ops.next_step("verdict").alias("next"))


_SUGGESTIONS_SQL = dim.sql_values(
    [(a, "|".join(s)) for a, s in dim.SUGGESTIONS.items()], "dim", "area, suggestions"
)


@query(
    "suggest_fixes",
    f"""with {EVAL_SQL}, {_SUGGESTIONS_SQL}
    select idea_id, area, coalesce(dim.suggestions, '') as suggestions,
      coalesce(fixed.suggestions, '') as aliased_suggestions
    from weak left join dim using (area)
    left join dim as fixed on fixed.area =
      case when weak.area = 'relevance_score' then 'Relevance to FinTech' else weak.area end""",
    uses=("responses",),
)
def suggest_fixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    # The one score name the suggestion table lists under another name.
    alias = {"relevance_score": "Relevance to FinTech"}
    known = dim.suggestions(spark)
    plain = ops.suggest_fixes(assessed(spark, sf_dir), known, "idea_id")
    aliased = known.withColumnsRenamed({"area": "_area", "suggestions": "aliased"})
    target = F.col("area")
    for name, area in alias.items():
        target = F.when(F.col("area") == name, area).otherwise(target)
    return plain.join(aliased, target == F.col("_area"), "left").select(
        "idea_id",
        "area",
        F.array_join("suggestions", "|").alias("suggestions"),
        F.coalesce(F.array_join("aliased", "|"), F.lit("")).alias("aliased_suggestions"),
    )


@query(
    "evaluate_ideas",
    f"""with {EVAL_SQL}, {_SUGGESTIONS_SQL},
    advice as (
      select idea_id, string_agg(
        area || '=' || coalesce(suggestions, ''), ';' order by area_ix) as suggestions
      from weak left join dim using (area) group by idea_id)
    select s.*, v.weak_areas, v.verdict, coalesce(a.suggestions,
        case when s.status = 'ok' then '' end) as suggestions,
      case v.verdict when 'pass' then 'continue' when 'fail' then 'revise' end as next
    from scored s left join verdicts v using (idea_id) left join advice a using (idea_id)""",
    uses=("responses",),
)
def evaluate_ideas(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = ops.evaluate_ideas(
        derived(spark, sf_dir, "responses"), dim.SCORE_KEYS, dim.SUGGESTIONS, THRESHOLD
    )
    advice = F.transform(
        F.map_entries("suggestions"),
        lambda e: F.concat(e["key"], F.lit("="), F.array_join(e["value"], "|")),
    )
    return records.select(
        "idea_id",
        "status",
        "raw",
        *flat_scores(records),
        "reason",
        F.array_join("weak_areas", "|").alias("weak_areas"),
        "verdict",
        F.array_join(advice, ";").alias("suggestions"),
        "next",
    )
