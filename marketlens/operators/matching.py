"""Joining records that do not share a clean key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.text import let
from .metrics import MONEY_OR_PERCENT, amount_value


def _deletions(name: Column, edits: int) -> Column:
    """The name and everything left of it after deleting up to ``edits`` characters."""
    def shorter(s: Column) -> Column:
        cuts = F.when(F.length(s) > 0, F.sequence(F.lit(1), F.length(s)))
        return F.coalesce(
            F.transform(cuts, lambda i: F.concat(F.substr(s, F.lit(1), i - 1), F.substr(s, i + 1))),
            F.array().cast("array<string>"),
        )

    forms = F.array(name)
    for _ in range(edits):
        forms = let(
            forms, lambda f: F.array_distinct(F.concat(f, F.flatten(F.transform(f, shorter))))
        )
    return forms


def fuzzy_match(
    left: DataFrame, right: DataFrame, left_name: str, right_name: str, max_edits: int = 1
) -> DataFrame:
    """Pairs of distinct names within ``max_edits`` edits, scored by 1 - edits / length.

    Names at that distance share a form with at most ``max_edits`` characters
    deleted, so an equi-join on such forms finds every pair and no block of
    look-alikes is paired with itself. A name carried by many records is matched
    once and reports how many it stands for.
    """

    def names(df: DataFrame, column: str, side: str) -> DataFrame:
        return (
            df.filter(F.col(column).isNotNull())
            .groupBy(F.lower(F.trim(column)).alias(f"{side}_name"))
            .agg(F.count("*").alias(f"{side}_records"))
        )

    def forms(df: DataFrame, side: str) -> DataFrame:
        return df.select("*", F.explode(_deletions(F.col(f"{side}_name"), max_edits)).alias("_form"))

    # Forms are many times what Spark takes their size for: neither side may be broadcast.
    candidates = forms(names(left, left_name, "left"), "left").hint("merge").join(
        forms(names(right, right_name, "right"), "right"), "_form"
    )
    edits = F.levenshtein("left_name", "right_name", max_edits)
    longest = F.greatest(F.length("left_name"), F.length("right_name"), F.lit(1))
    return (
        candidates.withColumn("edits", edits)
        .filter("edits >= 0")
        .drop("_form")
        .distinct()
        .withColumn("score", F.round(1 - F.col("edits") / longest, 6))
    )


def fuse(
    internal: DataFrame,
    external: DataFrame,
    key: Column,
    ids: tuple[str, str],
    columns: list[str],
) -> DataFrame:
    """Internal records completed by external ones on a conformed key; internal values win.

    Every internal record joins the first external record of its key, taken as given; external
    records beyond the first, and those no internal record shares a key with, come out
    unmatched. Nothing is lost and no key pairs all with all: a crowded key is crowded on the
    internal side only. Records without a key go around the join.
    """
    left_id, right_id = ids

    def keyed(df: DataFrame, id_column: str, prefix: str) -> DataFrame:
        return df.select(
            key.alias("fused_key"), *[F.col(c).alias(f"{prefix}{c}") for c in [id_column, *columns]]
        )

    left, right = keyed(internal, left_id, "_i_"), keyed(external, right_id, "_e_")
    present = "fused_key is not null"
    in_key = Window.partitionBy("fused_key").orderBy(f"_e_{right_id}")
    ranked = right.filter(present).withColumn("_n", F.row_number().over(in_key))
    first, surplus = ranked.filter("_n = 1").drop("_n"), ranked.filter("_n > 1").drop("_n")
    unmatched = first.join(left.filter(present).select("fused_key").distinct(), "fused_key", "left_anti")
    both = left.filter(present).join(first, "fused_key", "left")
    for rest in (left.filter("fused_key is null"), unmatched, surplus, right.filter("fused_key is null")):
        both = both.unionByName(rest, allowMissingColumns=True)
    return both.select(
        "fused_key",
        F.col(f"_i_{left_id}").alias(left_id),
        F.col(f"_e_{right_id}").alias(right_id),
        *[F.coalesce(f"_i_{c}", f"_e_{c}").alias(c) for c in columns],
    )


def ungrounded_numbers(reports: DataFrame, evidence: DataFrame, *, by_value: bool = False) -> DataFrame:
    """Figures a report states that none of its entity's evidence contains.

    Figures are the same when their texts are, or ``by_value`` when their amounts are: `$5K` is
    `$5,000` then, but never a percentage.
    """

    def figures(df: DataFrame, *keys: str) -> DataFrame:
        found = F.regexp_extract_all("text", F.lit(MONEY_OR_PERCENT), F.lit(0))
        return df.select(*keys, F.explode(F.array_distinct(found)).alias("figure"))

    def valued(df: DataFrame) -> DataFrame:
        # Rounded, as 1.1 times a million is not exact.
        return df.withColumns({"_money": F.col("figure").startswith("$"), "_value": F.round(amount_value(F.col("figure")), 4)})

    stated = figures(reports, "report_id", "entity_id")
    known = figures(evidence, "entity_id")
    # A set per entity and figure, built in the map tasks first.
    if not by_value:
        return stated.join(known.distinct(), ["entity_id", "figure"], "left_anti")
    same = ["entity_id", "_money", "_value"]
    return valued(stated).join(valued(known).select(same).distinct(), same, "left_anti").drop("_money", "_value")
