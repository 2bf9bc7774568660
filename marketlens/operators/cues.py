"""Cue phrases in text: one regex pass per row, then small joins and combinable sums."""

from __future__ import annotations

import re
from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

Cue = tuple[str, str, float]


def term_pattern(terms: Iterable[str]) -> str:
    """Any of the terms as whole words, the longer of two where both fit.

    Shared beginnings are written once and first letters are looked at before
    word boundaries, so text that starts no term is passed over in one step. Any number
    of terms works; ``tag_entities`` is faster for vocabularies of many thousands.
    """
    distinct = set(terms)
    tree: dict = {}
    for term in distinct:
        node = tree
        for char in term:
            node = node.setdefault(char, {})
        node[""] = {}

    def write(node: dict) -> str:
        branches = [re.escape(c) + write(n) for c, n in sorted(node.items()) if c]
        if not branches:
            return ""
        body = branches[0] if len(branches) == 1 and "" not in node else f"(?:{'|'.join(branches)})"
        return body + "?" if "" in node else body

    first = "".join(re.escape(c) for c in sorted(tree))
    return rf"(?=[{first}])\b({write(tree)})\b"


def matches(text: Column | str, terms: Iterable[str]) -> Column:
    c = F.col(text) if isinstance(text, str) else text
    return F.regexp_extract_all(F.lower(c), F.lit(term_pattern(terms)), F.lit(1))


def count_matches(text: Column | str, terms: Iterable[str]) -> Column:
    return F.size(matches(text, terms))


def terms_of(cues: Iterable[Cue], *groups: str) -> list[str]:
    return [t for g, t, _ in cues if g in groups]


def cue_hits(rows: DataFrame, text_column: str, cues: list[Cue], keep: list[str]) -> DataFrame:
    """One row per cue found, with its groups and weights; words that are no cue never leave the row."""
    found = rows.select(*keep, F.explode(matches(text_column, [t for _, t, _ in cues])).alias("term"))
    groups, terms, weights = (list(c) for c in zip(*cues))
    vocabulary = rows.sparkSession.createDataFrame(
        pa.table({"cue_group": groups, "term": terms, "weight": weights})
    )
    return found.join(F.broadcast(vocabulary), "term")
