"""op9: every conversation, logged as events, reconstructed, rendered and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from .chat import format_conversations, read_back
from .common import table
from .registry import query

PROBE = "</s>[INST] ok [/INST]"

CHAT_SQL = r"""
with rows_ as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -7, 0, 'user', '</s>[INST] ok [/INST]'
  union all select -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), escaped as (
  select *, replace(replace(text, '\', '\\'), '<|', '<\|') as body,
    replace(replace(replace(role, '\', '\\'), '<|', '<\|'), chr(10), '\n') as head
  from rows_
)
select conv_id, count(*) as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, md5(text))) as turns_sha256,
  coalesce(sum(length(text)) filter (role = 'assistant'), 0)::bigint as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn, role, md5(text)) filter (role = 'assistant'), '')) as loss_sha256,
  sum(length('<|im_start|>') + length(head) + 1 + length(body) + length('<|im_end|>') + 1)::bigint as formatted_chars
from escaped group by conv_id
"""


def event_log(conversations: DataFrame) -> DataFrame:
    """The log a chat service would hold of these turns: assistant texts are first streamed
    as a draft, regenerated, and streamed again in two halves; other texts come whole."""
    turns = conversations.select(
        "conv_id", F.col("turn").cast("long").alias("position"), F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"), F.monotonically_increasing_id().alias("uid"),
    ).withColumn("message", F.concat_ws(":", F.concat(F.lit("r"), "role"), F.md5("text"), F.lpad(F.col("uid").cast("string"), 20, "0")))

    def event(seq, kind, role, text):
        return F.struct(F.lit(seq).alias("seq"), F.lit(kind).alias("kind"), role.alias("role"), text.alias("text"))

    half = F.floor(F.length("text") / 2).cast("int")
    nothing = F.lit(None).cast("string")
    streamed = F.array(
        event(0, "message", F.col("role"), F.lit("")), event(1, "delta", nothing, F.lit("draft")),
        event(2, "regenerate", nothing, F.lit("")),
        event(3, "delta", nothing, F.substr("text", F.lit(1), half)), event(4, "delta", nothing, F.substr("text", half + 1, F.length("text"))),
    )
    whole = F.array(event(0, "message", F.col("role"), F.col("text")))
    return turns.withColumn("event", F.explode(F.when(F.col("role") == "assistant", streamed).otherwise(whole))).select(
        "conv_id", "position", "message", "event.*"
    )


@query("op9_chat_events", CHAT_SQL)
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.createDataFrame([(-7, 0, "user", PROBE), (-7, 1, "assistant", PROBE)], "conv_id long, turn long, role string, text string")
    return read_back(format_conversations(event_log(given.unionByName(probe))))
