"""Secret scans over an incremental ledger of content-addressed versions.

Every version of every path is addressed by the SHA-256 of its text. A blob is scanned
once per version of the rules: pairs the ledger holds already are skipped. Findings hang on
blobs and are joined back to all paths that ever held one. Columns and SQL functions only.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.utils import AnalysisException

from ..sources.scratch import scratch_path

# A rule: (kind, pattern, group or 0, least length of that group). Matches are leftmost and do
# not overlap within a kind; those that fall short are dropped after matching.
# Fixed values of the first rule version.
BASE_RULES = (
    ("assign", r"(?i:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 12),
    ("access", r"AKIA[A-Z0-9]+", 0, 18),
    ("hex", r"[0-9a-f]{16,}", 0, 16),
)
# The second version adds token shapes that name their issuer, and private-key headers.
ISSUER_RULES = (
    ("github", r"gh[pousr]_[A-Za-z0-9]+", 0, 40),
    ("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+", 0, 40),
    ("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 0),
)
RULES = {1: BASE_RULES, 2: ISSUER_RULES}

# Session setting: the folder of a ledger that outlives the run; unset, every run opens a new one.
LEDGER_SETTING = "spark.marketlens.secretLedger"
LEDGER_SCHEMA = "blob string, findings array<struct<kind:string,start:int,end:int>>, rule_version int"


def blob_address(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")), 256)


def _spans(text: Column, kind: str, pattern: str, group: int, least: int) -> Column:
    """Spans of one rule in code points, end exclusive: the text between matches gives their places."""
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    between = F.split(text, pattern, -1)
    counted = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else whole
    pieces = F.arrays_zip(
        F.transform(F.slice(between, 1, F.greatest(F.size(between) - 1, F.lit(0))), F.length).alias("gap"),
        F.transform(whole, F.length).alias("length"),
        F.transform(counted, F.length).alias("counted"),
    )
    start = F.struct(
        F.lit(0).alias("at"),
        F.array().cast("array<struct<kind:string,start:int,end:int>>").alias("found"),
    )

    def step(acc: Column, piece: Column) -> Column:
        begin = acc["at"] + piece["gap"]
        end = begin + piece["length"]
        hit = F.array(F.struct(F.lit(kind).alias("kind"), begin.alias("start"), end.alias("end")))
        return F.struct(
            end.alias("at"),
            F.when(piece["counted"] >= least, F.concat(acc["found"], hit)).otherwise(acc["found"]).alias("found"),
        )

    none = F.array().cast("array<struct<kind:string,start:int,end:int>>")
    return F.when(F.size(whole) > 0, F.aggregate(pieces, start, step, lambda acc: acc["found"])).otherwise(none)


def findings(text: Column, rules) -> Column:
    """All spans of a rule version in the order start, then rule as listed."""
    kinds = [r[0] for r in rules]
    return in_order(F.concat(*[_spans(text, *r) for r in rules]), kinds)


def in_order(spans: Column, kinds: list[str]) -> Column:
    rank = F.array(*[F.lit(k) for k in kinds])
    keyed = F.transform(
        spans, lambda s: F.struct(s["start"].alias("start"), F.array_position(rank, s["kind"]).alias("rank"), s["end"].alias("end"), s["kind"].alias("kind"))
    )
    return F.transform(
        F.sort_array(keyed),
        lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")),
    )


def ledger_path(spark: SparkSession) -> str:
    """Where queries and the pipeline keep their ledger: the folder that the session names, so that a
    later run scans only what is new, or else one of this run in the shared scratch folder."""
    return spark.conf.get(LEDGER_SETTING, None) or scratch_path(spark, "secret-ledger")


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """The ledger at ``path``; an empty one when nothing was written yet."""
    try:
        return spark.read.schema(LEDGER_SCHEMA).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], LEDGER_SCHEMA)


def scan_unseen(versions: DataFrame, ledger: DataFrame, text: str = "text", rules=RULES) -> DataFrame:
    """Ledger rows of the blobs in ``versions`` for every rule version the ledger lacks.

    One text per blob is kept before the exchange, so a blob with any number of copies is
    moved once per task and scanned once. A blob without findings gets a row as well: it has
    been seen. Null texts are the empty blob; empty input gives no rows.
    """
    seen = ledger.select("blob", "rule_version").distinct()
    blobs = versions.select(F.coalesce(F.col(text), F.lit("")).alias("text")).groupBy(blob_address(F.col("text")).alias("blob")).agg(
        F.min("text").alias("text")
    )
    known = seen.groupBy("blob").agg(F.collect_set("rule_version").alias("versions"))
    open_blobs = (
        blobs.join(known, "blob", "left")
        .withColumn("todo", F.array_except(F.array(*[F.lit(v) for v in rules]), F.coalesce("versions", F.array().cast("array<int>"))))
        .where(F.size("todo") > 0)
    )
    per_version = F.array(
        *[
            F.when(
                F.array_contains("todo", v),
                F.struct(findings(F.col("text"), r).alias("findings"), F.lit(v).alias("rule_version")),
            )
            for v, r in rules.items()
        ]
    )
    return (
        open_blobs.select("blob", F.explode(F.array_compact(per_version)).alias("scan"))
        .select("blob", "scan.findings", "scan.rule_version")
    )


def update_ledger(versions: DataFrame, path: str, text: str = "text", rules=RULES) -> DataFrame:
    """Scan what ``path`` has not seen, append it, and return the whole ledger."""
    spark = versions.sparkSession
    scan_unseen(versions, read_ledger(spark, path), text, rules).write.mode("append").parquet(path)
    return read_ledger(spark, path)


def blob_findings(ledger: DataFrame, rules=RULES) -> DataFrame:
    """(blob, spans): the findings of all rule versions together, for blobs that have any."""
    kinds = [r[0] for group in rules.values() for r in group]
    hit = ledger.where(F.size("findings") > 0).where(F.col("rule_version").isin(*rules))
    return hit.groupBy("blob").agg(in_order(F.array_distinct(F.flatten(F.collect_list("findings"))), kinds).alias("spans"))


def with_findings(versions: DataFrame, ledger: DataFrame, text: str = "text", rules=RULES) -> DataFrame:
    """``row`` (a version, all its columns) and ``spans``, empty where nothing was found."""
    keyed = versions.select(F.struct("*").alias("row"), blob_address(F.col(text)).alias("blob"))
    found = keyed.join(blob_findings(ledger, rules), "blob", "left")
    return found.select("row", F.coalesce("spans", F.array().cast("array<struct<kind:string,start:int,end:int>>")).alias("spans"))


def spans_text(spans: Column) -> Column:
    """kind:start:end, joined by commas."""
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ","
    )


def redacted(text: Column, spans: Column) -> Column:
    """The text with every span replaced by [kind]; overlapping spans are replaced as one."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        clean = F.substr(text, acc["at"] + 1, s["start"] - acc["at"])
        return F.when(
            s["start"] >= acc["at"],
            F.struct(s["end"].alias("at"), F.concat(acc["out"], F.array(clean, F.concat(F.lit("["), s["kind"], F.lit("]")))).alias("out")),
        ).otherwise(F.struct(F.greatest(acc["at"], s["end"]).alias("at"), acc["out"].alias("out")))

    folded = F.aggregate(
        spans, start, step,
        lambda acc: F.array_join(F.concat(acc["out"], F.array(F.substr(text, acc["at"] + 1, F.length(text)))), ""),
    )
    return F.when(F.size(spans) > 0, folded).otherwise(text)
