"""Quality rules by robust multivariate outliers, in columns and SQL functions only.

Each document becomes a vector of transformed text statistics. Per language and source the
minimum-covariance-determinant estimate is found by concentration steps: from robust
medians and spreads, keep the share of rows nearest by Mahalanobis distance, estimate mean
and covariance from them, and repeat. A document is rejected when its distance under the
last estimate is beyond the cut. A group with few rows is judged by the estimate over all
sources of its language, and a language with few rows by the one over all documents.

Statistics are kept as integers on a grid of 1/1024, so sums are exact and reruns agree.
A quantile is found from counts of grid values per group: no group is sorted or gathered.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import materialise, small, words_of

GRID = 1024
# Share of a group's rows the estimate rests on, and how often the rows are chosen anew.
SUPPORT = 0.75
STEPS = 3
# Squared distance beyond which a document is rejected, and the least spread of each statistic:
# what varies less than this is not told from noise.
CUT = 60.0
# Groups with fewer rows than this are judged by the estimate of a wider pool of rows.
LEAST_ROWS = 40
REPEAT_WINDOW = 8  # joined from pairs, fours and eights

# Statistics of the vector: name, least spread.
STATISTICS = (
    ("word_length", 0.10), ("symbols", 0.30), ("marks", 0.30), ("capitals", 0.30),
    ("dup_lines", 1.00), ("repeats", 1.00),
)
DIMENSIONS = len(STATISTICS)


def _chi2_even(x: float, k: int) -> float:
    """Chi-square distribution function for an even number of degrees."""
    half, term, total = x / 2, 1.0, 1.0
    for j in range(1, k // 2):
        term *= half / j
        total += term
    return 1 - math.exp(-half) * total


def consistency(support: float = SUPPORT, k: int = DIMENSIONS) -> float:
    """Factor that makes the covariance of the nearest share right for normal rows."""
    low, high = 0.0, 1000.0
    for _ in range(200):
        middle = (low + high) / 2
        low, high = (middle, high) if _chi2_even(middle, k) < support else (low, middle)
    return support / _chi2_even(low, k + 2)


def _less(text: Column, pattern: str) -> Column:
    """How many characters of a text match a one-character pattern."""
    return (F.length(text) - F.length(F.regexp_replace(text, pattern, ""))).cast("long")


def _with_window_hashes(split: DataFrame) -> DataFrame:
    """``windows``: a hash of every 8 consecutive words, built by joining halves.

    Each step is a projection of its own, so it is computed once.
    """
    out = split.withColumn("windows", F.transform("words", lambda w: F.xxhash64(w)))
    for step in (1, 2, 4):
        count = F.greatest(F.size("windows") - step, F.lit(0))
        out = out.withColumn(
            "windows",
            F.zip_with(
                F.slice("windows", 1, count), F.slice("windows", step + 1, count), lambda a, b: F.xxhash64(a, b)
            ),
        )
    return out


def text_statistics(documents: DataFrame, text: str = "text") -> DataFrame:
    """``row`` and the counts of each text: n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words, n_lines, n_marks, n_capitals. A null text counts as an empty one.

    Windows are compared by a 64-bit hash within one text; only texts with a repeated window
    are sorted by it, and the covered words are counted from the sorted places.
    """
    n = REPEAT_WINDOW
    body = F.coalesce(F.col(text), F.lit(""))
    split = documents.select(F.struct("*").alias("row"), body.alias("body"), words_of(body).alias("words"))
    lines = F.filter(F.split("body", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    hashed = _with_window_hashes(split).select(
        "row", "body", lines.alias("lines"),
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        "windows",
    )
    # hash and place of each window, in order of the hash, for texts that repeat one
    sorted_places = F.when(
        F.size(F.array_distinct("windows")) < F.size("windows"),
        F.sort_array(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i")))),
    )
    placed = hashed.withColumn("placed", sorted_places)
    count = F.size("placed")
    repeated = F.filter(
        F.transform(
            "placed",
            lambda x, k: F.when(
                ((k > 0) & (F.get("placed", k - 1)["h"] == x["h"]))
                | ((k < count - 1) & (F.get("placed", k + 1)["h"] == x["h"])),
                x["i"],
            ),
        ),
        lambda i: i.isNotNull(),
    )
    spots = placed.withColumn("spots", F.when(F.col("placed").isNotNull(), F.sort_array(repeated)))
    covered = F.aggregate(
        "spots",
        F.struct(F.lit(0).cast("long").alias("total"), F.lit(0).alias("end")),
        lambda acc, i: F.struct(
            (acc["total"] + (i + n) - F.greatest(acc["end"], i)).alias("total"), (i + n).alias("end")
        ),
        lambda acc: acc["total"],
    )
    return spots.select(
        "row", "n_words", "word_chars",
        _less(F.col("body"), r"[#*$%&|<>]").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"),
        F.size("lines").cast("long").alias("n_lines"),
        _less(F.col("body"), r"[^\w\s#*$%&|<>\u0080-￿]").alias("n_marks"),
        _less(F.col("body"), r"[A-Z]").alias("n_capitals"),
    )


def _vector() -> list[Column]:
    share = lambda part, whole: F.log1p(100.0 * F.col(part) / (F.col(whole) + 1))
    values = {
        "word_length": F.log(F.col("word_chars") + 1) - F.log(F.col("n_words") + 1),
        "symbols": share("n_symbols", "word_chars"),
        "marks": share("n_marks", "word_chars"),
        "capitals": share("n_capitals", "word_chars"),
        "dup_lines": share("n_dup_lines", "n_lines"),
        "repeats": share("n_repeat_words", "n_words"),
    }
    return [F.round(values[name] * GRID).cast("long").alias(f"x{k}") for k, (name, _) in enumerate(STATISTICS)]


def base_failed() -> Column:
    """Fewer than 20 words, or over 30 % of the words in repeated windows."""
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def _at_share(counts: DataFrame, keys: list[str], value: str, share: float, name: str) -> DataFrame:
    """Per key, the least value at or below which at least ``share`` of the counted rows lie."""
    order = Window.partitionBy(*keys).orderBy(value)
    whole = Window.partitionBy(*keys)
    return (
        counts.withColumn("below", F.sum("n").over(order))
        .withColumn("all", F.sum("n").over(whole))
        .where(F.col("below") >= F.ceil(F.col("all") * share))
        .groupBy(*keys)
        .agg(F.min(value).alias(name))
    )


def _start(rows: DataFrame, group: list[str]) -> DataFrame:
    """Medians and spreads (from the middle half) of every statistic per group."""
    long = rows.select(*group, F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.col(f"x{k}").alias("x")) for k in range(DIMENSIONS)])).alias("v"))
    counts = long.groupBy(*group, "v.k", "v.x").agg(F.count("*").alias("n"))
    keys = [*group, "k"]
    parts = [_at_share(counts, keys, "x", s, f"q{i}").withColumn("which", F.lit(i)).withColumnRenamed(f"q{i}", "q") for i, s in enumerate((0.25, 0.5, 0.75))]
    quantiles = reduce(DataFrame.unionByName, parts)
    aggregates = [F.first(F.when(F.col("which") == 0, F.lit(0))).alias("_")]
    for k, (_, least) in enumerate(STATISTICS):
        pick = lambda i, k=k: F.max(F.when((F.col("k") == k) & (F.col("which") == i), F.col("q")))
        aggregates.append(pick(1).cast("double").alias(f"m{k}"))
        aggregates.append(F.greatest((pick(2) - pick(0)) / F.lit(1.349), F.lit(least * GRID)).alias(f"l{k}_{k}"))
        aggregates += [F.lit(0.0).alias(f"l{k}_{j}") for j in range(k)]
    return quantiles.groupBy(*group).agg(*aggregates).drop("_")


def _distance(rows: DataFrame, params: DataFrame, group: list[str]) -> DataFrame:
    """``d2``: squared distance, by forward substitution in the Cholesky factor of the group."""
    condition = reduce(lambda a, b: a & b, [F.col(f"r.{g}").eqNullSafe(F.col(f"p.{g}")) for g in group])
    names = [c for c in rows.columns]
    joined = rows.alias("r").join(params.alias("p"), condition, "left").select(
        *[F.col(f"r.{c}") for c in names], *[F.col(f"p.{c}") for c in params.columns if c not in group]
    )
    for k in range(DIMENSIONS):
        inner = F.col(f"x{k}") - F.col(f"m{k}")
        for j in range(k):
            inner = inner - F.col(f"l{k}_{j}") * F.col(f"y{j}")
        joined = joined.withColumn(f"y{k}", inner / F.col(f"l{k}_{k}"))
    d2 = reduce(lambda a, b: a + b, [F.col(f"y{k}") * F.col(f"y{k}") for k in range(DIMENSIONS)])
    return joined.select(*names, d2.alias("d2"))


def _estimate(nearest: DataFrame, group: list[str], factor: float) -> DataFrame:
    """Mean and Cholesky factor of the scaled covariance, from exact integer sums."""
    sums = [F.count("*").alias("n")] + [F.sum(f"x{k}").alias(f"s{k}") for k in range(DIMENSIONS)]
    sums += [F.sum(F.col(f"x{i}") * F.col(f"x{j}")).alias(f"s{i}_{j}") for i in range(DIMENSIONS) for j in range(i + 1)]
    out = nearest.groupBy(*group).agg(*sums)
    for k in range(DIMENSIONS):
        out = out.withColumn(f"m{k}", F.col(f"s{k}") / F.col("n"))
    for i, (_, least) in enumerate(STATISTICS):
        for j in range(i + 1):
            value = (F.col(f"s{i}_{j}") / F.col("n") - F.col(f"m{i}") * F.col(f"m{j}")) * factor
            for k in range(j):
                value = value - F.col(f"l{i}_{k}") * F.col(f"l{j}_{k}")
            if i == j:
                out = out.withColumn(f"l{i}_{i}", F.sqrt(F.greatest(value, F.lit(0.0)) + (least * GRID) ** 2))
            else:
                out = out.withColumn(f"l{i}_{j}", value / F.col(f"l{j}_{j}"))
    keep = [f"m{k}" for k in range(DIMENSIONS)] + [f"l{i}_{j}" for i in range(DIMENSIONS) for j in range(i + 1)]
    return out.select(*group, *keep)


def estimates(rows: DataFrame, group: list[str], support: float = SUPPORT, steps: int = STEPS, least_rows: int = LEAST_ROWS) -> DataFrame:
    """Mean (m*) and Cholesky factor (l*) per group of ``rows(*group, x*)``, in grid units.

    Groups below ``least_rows`` are left out. Ties at the edge of the support all count.
    """
    condition = reduce(lambda a, b: a & b, [F.col(f"r.{g}").eqNullSafe(F.col(f"g.{g}")) for g in group])
    large = rows.groupBy(*group).agg(F.count("*").alias("n")).where(F.col("n") >= least_rows)
    params = _start(rows, group)
    params = materialise(
        params.alias("r").join(large.alias("g"), condition, "left_semi"), "mcd-start"
    )
    for _ in range(steps):
        near = _distance(rows, small(params), group).where(F.col("d2").isNotNull())
        # distances on a fine logarithmic grid, so the edge of the support comes from counts
        binned = near.withColumn("bin", F.floor(F.log(F.col("d2") + 1e-9) * 256).cast("long"))
        counts = binned.groupBy(*group, "bin").agg(F.count("*").alias("n"))
        edge = _at_share(counts, group, "bin", support, "edge")
        near_edge = reduce(lambda a, b: a & b, [F.col(f"b.{g}").eqNullSafe(F.col(f"e.{g}")) for g in group])
        inside = binned.alias("b").join(edge.alias("e"), near_edge & (F.col("b.bin") <= F.col("e.edge"))).select("b.*")
        params = materialise(_estimate(inside, group, consistency(support)), "mcd-step")
    return params


def _pools(rows: DataFrame, least_rows: int) -> DataFrame:
    """Per group the ``level`` of the rows that judge it: 0 its own, 1 its language's, 2 all;
    and the pools its rows belong to: ``own``, ``wide`` (the language), ``every``.

    The widest pool is used however few rows it has.
    """
    sizes = materialise(rows.groupBy("g0", "g1").agg(F.count(F.when(~F.col("failed"), 1)).alias("n")), "mcd-sizes")
    languages = sizes.groupBy("g0").agg(F.sum("n").alias("all"), F.max(F.col("n") < least_rows).alias("few"))
    level = F.when(F.col("n") >= least_rows, 0).when(F.col("all") >= least_rows, 1).otherwise(2)
    known = materialise(
        sizes.alias("s").join(languages.alias("a"), F.col("s.g0").eqNullSafe(F.col("a.g0"))).select(
            "s.g0", "s.g1", level.alias("level"), (F.col("n") >= least_rows).alias("own"),
            (F.col("few") & (F.col("all") >= least_rows)).alias("wide"),
        ),
        "mcd-pools",
    )
    return known.withColumn("every", F.lit(not known.where(F.col("level") == 2).isEmpty()))


def pooled_estimates(rows: DataFrame, support: float = SUPPORT, steps: int = STEPS, least_rows: int = LEAST_ROWS) -> DataFrame:
    """Estimates for every g0 and g1 of ``rows(g0, g1, failed, x*)``, from the narrowest pool with
    ``least_rows`` rows that pass, or else from all of them."""
    pools = _pools(rows, least_rows)
    values, nothing = [f"x{k}" for k in range(DIMENSIONS)], F.lit(None)
    same = lambda a, b, *names: reduce(lambda x, y: x & y, [F.col(f"{a}.{n}").eqNullSafe(F.col(f"{b}.{n}")) for n in names])
    pool = lambda k, g0, g1: F.struct(F.lit(k).alias("level"), g0.cast("string").alias("p0"), g1.cast("string").alias("p1"))
    g0, g1 = F.col("r.g0"), F.col("r.g1")
    member = F.array_compact(F.array(
        F.when(F.col("p.own"), pool(0, g0, g1)), F.when(F.col("p.wide"), pool(1, g0, nothing)), F.when(F.col("p.every"), pool(2, nothing, nothing))
    ))
    passed = rows.where(~F.col("failed")).select("g0", "g1", *values)
    members = passed.alias("r").join(small(pools).alias("p"), same("r", "p", "g0", "g1")).select(F.explode(member).alias("pool"), *values)
    params = estimates(members.select("pool.*", *values), ["level", "p0", "p1"], support, steps, 1)
    asked = pools.select(
        "g0", "g1", "level", F.when(F.col("level") < 2, F.col("g0").cast("string")).alias("p0"), F.when(F.col("level") < 1, F.col("g1").cast("string")).alias("p1")
    )
    found = asked.alias("a").join(params.alias("e"), same("a", "e", "level", "p0", "p1"))
    return materialise(found.select("a.g0", "a.g1", *[f"e.{c}" for c in params.columns if c not in ("level", "p0", "p1")]), "mcd-groups")


def judge(
    documents: DataFrame, text: str = "text", lang: str = "lang", source: str = "source",
    cut: float = CUT, support: float = SUPPORT, steps: int = STEPS, least_rows: int = LEAST_ROWS,
) -> DataFrame:
    """``row`` (the document), the counts of its text, base_failed, distance and kept.

    Documents that fail the base rules take no part in the estimates. Null languages and
    sources are groups of their own. Groups with fewer than ``least_rows`` rows are judged by
    their language's estimate or else by that over all documents. The distance is null only
    where no document passes the base rules. Repeated rows count as often as they occur.
    """
    counted = materialise(text_statistics(documents, text), "mcd-statistics")
    rows = counted.withColumn("failed", base_failed()).select(
        "*", F.col(f"row.{lang}").alias("g0"), F.col(f"row.{source}").alias("g1"), *_vector()
    )
    params = pooled_estimates(rows, support, steps, least_rows)
    far = _distance(rows, small(params), ["g0", "g1"])
    return far.select(
        "row", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        F.col("failed").alias("base_failed"), F.col("d2").alias("distance"),
        (~F.col("failed") & (F.coalesce("d2", F.lit(0.0)) <= cut)).alias("kept"),
    )
