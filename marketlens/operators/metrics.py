"""Competition metrics. Every aggregate combines in the map tasks, so a hot group costs a row per task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from . import cues as cue_ops

MONEY_OR_PERCENT = r"\$[0-9][0-9,]*(?:\.[0-9]+)?[KMB]?|[0-9]+(?:\.[0-9]+)?%"
ISO_DATE = r"\b[0-9]{4}-[0-9]{2}-[0-9]{2}\b"


def scale_1_10(x: Column) -> Column:
    return F.greatest(F.lit(1), F.least(F.lit(10), (1 + F.floor(9 * x)).cast("int")))


def amount_value(raw: Column) -> Column:
    """``$1,200`` -> 1200; K, M and B scale; a percentage stays in points."""
    number = F.regexp_replace(raw, "[^0-9.]", "").try_cast("double")
    scale = F.create_map(*[F.lit(x) for x in ("K", 1e3, "M", 1e6, "B", 1e9)])
    return number * F.coalesce(scale[F.right(raw, F.lit(1))], F.lit(1.0))


def first_amount(text: Column | str, pattern: str) -> Column:
    """Value of the amount a pattern captures, NULL where it does not occur."""
    c = F.col(text) if isinstance(text, str) else text
    return amount_value(F.nullif(F.regexp_extract(c, pattern, 1), F.lit("")))


def money_percent_mentions(rows: DataFrame, id_column: str, text_column: str) -> DataFrame:
    found = F.regexp_extract_all(text_column, F.lit(MONEY_OR_PERCENT), F.lit(0))
    raw = F.col("mention")
    return rows.select(id_column, F.posexplode(found).alias("pos", "mention")).select(
        id_column,
        "pos",
        "mention",
        F.when(raw.startswith("$"), "money").otherwise("percent").alias("kind"),
        amount_value(raw).alias("amount"),
    )


def date_mentions(rows: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """Dates a text mentions; digits that are no calendar date are left out."""
    found = F.regexp_extract_all(text_column, F.lit(ISO_DATE), F.lit(0))
    return (
        rows.select(id_column, F.posexplode(found).alias("pos", "_raw"))
        .select(id_column, "pos", F.try_to_date("_raw", "yyyy-MM-dd").alias("mentioned_on"))
        .filter("mentioned_on is not null")
    )


def filter_recent(rows: DataFrame, ts_column: str, months: int) -> DataFrame:
    """Rows of the last months, counted back from the newest row rather than from today."""
    newest = rows.select(F.max(ts_column)).scalar()
    return rows.filter(F.col(ts_column) >= newest - F.make_interval(months=F.lit(months)))


def revenue_by(sales: DataFrame, keys: list[str], newest: Column) -> DataFrame:
    """Revenue ``r`` per key, and that of the newest year and the one before, from ``(revenue, year)``."""
    last = F.when(F.col("year") == newest, F.col("revenue"))
    before = F.when(F.col("year") == newest - 1, F.col("revenue"))
    return sales.groupBy(*keys).agg(
        F.sum("revenue").alias("r"), F.sum(last).alias("last"), F.sum(before).alias("before")
    )


def rivalry_concentration(revenues: DataFrame) -> DataFrame:
    """Concentration per market from sums ``(market, competitor, r, last, before)``.

    HHI is a ratio of two sums over competitors, so no market is ever gathered.
    """
    by_competitor = revenues.groupBy("market", "competitor").agg(
        *[F.sum(c).alias(c) for c in ("r", "last", "before")]
    )
    hhi = F.sum(F.col("r") * F.col("r")) / (F.sum("r") * F.sum("r"))
    growth = F.try_divide(F.sum("last"), F.sum("before")) - 1
    return by_competitor.groupBy("market").agg(
        F.count("*").alias("competitors"),
        F.round(hhi, 6).alias("hhi"),
        F.round(growth, 4).alias("growth"),
        scale_1_10(hhi).alias("concentration_score"),
    )


MARGIN = r"margin[^0-9%$.]{0,40}([0-9]+(?:\.[0-9]+)?)%"
GROWTH = r"revenue grew[^0-9%$.]{0,40}([0-9]+(?:\.[0-9]+)?)%"
INVESTMENT = r"funding[^0-9%$.]{0,40}(\$[0-9][0-9,]*(?:\.[0-9]+)?[KMB]?)"
BUDGET = r"budget of (\$[0-9][0-9,]*(?:\.[0-9]+)?[KMB]?)"
SPEND = r"Acquisition spend was (\$[0-9][0-9,]*(?:\.[0-9]+)?[KMB]?)"
NEW_CUSTOMERS = r"for ([0-9]+) new customers"
UNIT_COST = r"Unit cost (?:rose|fell) to (\$[0-9][0-9,]*(?:\.[0-9]+)?[KMB]?)"
TERM_MONTHS = r"([0-9]+) months?\b"


def financial_health(notes: DataFrame, by: str) -> DataFrame:
    return notes.groupBy(by).agg(
        F.round(F.avg(first_amount("text", MARGIN)), 4).alias("margin"),
        F.round(F.avg(first_amount("text", GROWTH)), 4).alias("revenue_growth"),
        F.round(F.sum(first_amount("text", INVESTMENT)), 2).alias("investment"),
    )


def acquisition_cost(notes: DataFrame, by: str) -> DataFrame:
    """Spend over customers won; NULL where no customer is reported."""
    spend = F.sum(first_amount("text", SPEND))
    won = F.sum(first_amount("text", NEW_CUSTOMERS))
    return notes.groupBy(by).agg(
        F.round(F.try_divide(spend, F.nullif(won, F.lit(0.0))), 4).alias("acquisition_cost")
    )


def contract_terms(notes: DataFrame, by: str) -> DataFrame:
    term = first_amount("text", TERM_MONTHS)
    return notes.groupBy(by).agg(
        F.count(term).alias("mentions"),
        F.round(F.avg(term), 4).alias("mean_months"),
        F.max(term).alias("longest_months"),
    )


def buyer_concentration(notes: DataFrame, customers: DataFrame, cues: list) -> DataFrame:
    """Top customer's share of a segment's spend, with switching and price cues.

    Orders are summed per customer before they meet the customer table, on the
    key the join uses.
    """
    per_customer = notes.groupBy("entity_id").agg(
        F.sum("amount").alias("spend"),
        F.sum(cue_ops.count_matches("text", cue_ops.terms_of(cues, "switching"))).alias("s"),
        F.sum(cue_ops.count_matches("text", cue_ops.terms_of(cues, "price"))).alias("p"),
    )
    share = F.max("spend") / F.sum("spend")
    return (
        per_customer.join(customers, per_customer["entity_id"] == customers["c_custkey"])
        .groupBy(F.col("c_mktsegment").alias("segment"))
        .agg(
            F.count("*").alias("customers"),
            F.round(share, 6).alias("top_share"),
            F.sum("s").alias("switching_cues"),
            F.sum("p").alias("price_cues"),
            scale_1_10(share).alias("concentration_score"),
        )
    )


def lead_scoring(notes: DataFrame, cues: list) -> DataFrame:
    """Intent and engagement terms, budget named, and their weighted sum per lead."""
    intent = F.sum(cue_ops.count_matches("text", cue_ops.terms_of(cues, "intent")))
    engagement = F.sum(cue_ops.count_matches("text", cue_ops.terms_of(cues, "engagement")))
    budget = F.coalesce(F.sum(first_amount("text", BUDGET)), F.lit(0.0))
    return notes.groupBy("entity_id").agg(
        intent.alias("intent"),
        engagement.alias("engagement"),
        F.round(budget, 2).alias("budget"),
        F.round(2 * intent + engagement + F.log10(1 + budget), 4).alias("lead_score"),
    )


def _ordered_parts(lines: DataFrame, per_note: DataFrame) -> DataFrame:
    """What notes on an order say, for each line of that order; notes without a finding are gone before."""
    return lines.select("l_orderkey", "l_partkey").join(per_note, F.col("l_orderkey") == F.col("doc_id"))


def supplier_criticality(lines: DataFrame, notes: DataFrame, cues: list) -> DataFrame:
    """Alternatives per part, and switching and dependency cues of notes on its order lines."""
    alternatives = F.count_distinct("l_suppkey")
    per_part = lines.groupBy("l_partkey").agg(
        alternatives.alias("alternatives"),
        scale_1_10(1 / alternatives).alias("criticality_score"),
    )
    per_note = notes.select(
        "doc_id",
        cue_ops.count_matches("text", cue_ops.terms_of(cues, "switching")).alias("s"),
        cue_ops.count_matches("text", cue_ops.terms_of(cues, "unique_technology")).alias("u"),
    ).filter("s + u > 0")
    said = _ordered_parts(lines, per_note).groupBy("l_partkey").agg(
        F.sum("s").alias("switching_cues"), F.sum("u").alias("unique_dependencies")
    )
    return per_part.join(said, "l_partkey", "left").na.fill(0, ["switching_cues", "unique_dependencies"])


def cost_volatility(lines: DataFrame, notes: DataFrame) -> DataFrame:
    """Unit cost per part and its relative spread, beside the unit costs notes state on its order lines."""
    unit = F.col("l_extendedprice") / F.col("l_quantity")
    per_part = lines.groupBy("l_partkey").agg(
        F.round(F.avg(unit), 4).alias("mean_unit_cost"),
        F.round(F.try_divide(F.stddev_samp(unit), F.avg(unit)), 4).alias("volatility"),
    )
    per_note = notes.select("doc_id", first_amount("text", UNIT_COST).alias("cost")).filter("cost is not null")
    said = _ordered_parts(lines, per_note).groupBy("l_partkey").agg(
        F.count("*").alias("stated"), F.round(F.avg("cost"), 4).alias("stated_unit_cost")
    )
    return per_part.join(said, "l_partkey", "left").na.fill(0, ["stated"])


def supplier_risk(lines: DataFrame) -> DataFrame:
    """Part-quarters a supplier alone delivered.

    One supplier means smallest and largest key agree, which needs no distinct count.
    """
    return (
        lines.groupBy("l_partkey", F.date_trunc("quarter", "l_shipdate").alias("quarter"))
        .agg(F.min("l_suppkey").alias("l_suppkey"), F.max("l_suppkey").alias("_last"))
        .filter("l_suppkey = _last")
        .groupBy("l_suppkey")
        .agg(
            F.count("*").alias("single_source_quarters"),
            F.min("quarter").cast("date").alias("first_quarter"),
        )
    )


def weighted_threat(
    notes: DataFrame, cues: list, groups: tuple[str, ...], by: str, name: str
) -> DataFrame:
    """Share of cue weight that falls on the given groups, on the 1-10 scale."""
    hits = cue_ops.cue_hits(notes, "text", cues, [by])
    own = F.coalesce(F.sum(F.when(F.col("cue_group").isin(*groups), F.col("weight"))), F.lit(0.0))
    share = own / F.sum("weight")
    return hits.groupBy(by).agg(
        F.count("*").alias("cue_hits"),
        F.round(share, 6).alias("cue_share"),
        scale_1_10(share).alias(name),
    )


def threat_matrix(
    notes: DataFrame, customers: DataFrame, cues: list, groups: tuple[str, ...]
) -> DataFrame:
    """Cue counts by industry and threat, with their movement; counted per customer before the join.

    ``alternative_growth`` compares mentions of alternatives in the newest year of the notes
    with the year before; ``preference_shift`` is the change in the share of cues that tell of
    changed behaviour or adoption.
    """
    chosen = [c for c in cues if c[0] in groups]
    newest = notes.select(F.year(F.max("ts"))).scalar()
    age = newest - F.year("ts")
    per_customer = (
        cue_ops.cue_hits(notes, "text", chosen, ["entity_id", "ts"])
        .groupBy("entity_id", "cue_group")
        .agg(F.count("*").alias("n"), F.count_if(age == 0).alias("last"), F.count_if(age == 1).alias("before"))
    )

    def total(column: str, *chosen_groups: str) -> Column:
        return F.coalesce(F.sum(F.when(F.col("cue_group").isin(*chosen_groups), F.col(column))), F.lit(0))

    def share(column: str) -> Column:
        return F.try_divide(total(column, "behaviour", "adoption"), F.sum(column))

    growth = F.try_divide(total("last", "alternative"), total("before", "alternative")) - 1
    return (
        per_customer.join(customers, per_customer["entity_id"] == customers["c_custkey"])
        .groupBy(F.col("c_mktsegment").alias("industry"))
        .agg(
            *[total("n", g).alias(g) for g in groups],
            F.round(growth, 4).alias("alternative_growth"),
            F.round(share("last") - share("before"), 4).alias("preference_shift"),
        )
    )


def entry_dashboard(notes: DataFrame, cues: list) -> DataFrame:
    def mentions(group: str) -> Column:
        return F.sum(cue_ops.count_matches("text", cue_ops.terms_of(cues, group)))

    return notes.groupBy(F.date_trunc("month", "ts").cast("date").alias("month")).agg(
        mentions("license").alias("licenses"),
        F.round(F.coalesce(F.sum(first_amount("text", INVESTMENT)), F.lit(0.0)), 2).alias(
            "capital_inflow"
        ),
        mentions("patent").alias("patents"),
    )


def cue_timeline(notes: DataFrame, cues: list, groups: tuple[str, ...]) -> DataFrame:
    chosen = [c for c in cues if c[0] in groups]
    return (
        cue_ops.cue_hits(notes, "text", chosen, ["ts"])
        .groupBy("cue_group", F.date_trunc("month", "ts").cast("date").alias("month"))
        .agg(F.count("*").alias("mentions"))
    )


def entrant_profile(notes: DataFrame, cues: list) -> DataFrame:
    """Who enters and how: entrant and vector terms of the same note, and when first seen."""

    def distinct(group: str) -> Column:
        return F.array_distinct(cue_ops.matches("text", cue_ops.terms_of(cues, group)))

    return (
        notes.select("ts", F.explode(distinct("entrant")).alias("entrant"), distinct("entry_vector").alias("_v"))
        .select("ts", "entrant", F.explode("_v").alias("entry_vector"))
        .groupBy("entrant", "entry_vector")
        .agg(F.count("*").alias("notes"), F.min("ts").cast("date").alias("first_seen"))
    )


def sentiment_by_source(notes: DataFrame, lexicon: list[tuple[str, float]]) -> DataFrame:
    cues = [("sentiment", term, polarity) for term, polarity in lexicon]
    return (
        cue_ops.cue_hits(notes, "text", cues, ["source", "force"])
        .groupBy("source", "force")
        .agg(
            F.count("*").alias("opinions"), F.round(F.avg("weight"), 6).alias("sentiment")
        )
    )


def observation_confidence(notes: DataFrame, cues: list) -> DataFrame:
    """Share of all sources that support a cue."""
    sources = notes.select(F.count_distinct("source")).scalar()
    terms = [("any", t, 1.0) for t in sorted({t for _, t, _ in cues})]
    return (
        cue_ops.cue_hits(notes, "text", terms, ["source"])
        .groupBy("term")
        .agg(
            F.count("*").alias("mentions"),
            F.round(F.count_distinct("source") / sources, 6).alias("confidence"),
        )
    )


def force_scores(notes: DataFrame, cues: list, by: str) -> DataFrame:
    """Mean cue weight per note for each force; notes without a cue count as zero."""
    # Weights of a term in several groups add up.
    weights: dict[str, float] = {}
    for _, term, weight in cues:
        weights[term] = weights.get(term, 0.0) + weight
    of = F.create_map(*[F.lit(x) for pair in sorted(weights.items()) for x in pair])
    weight = F.aggregate(
        cue_ops.matches("text", weights), F.lit(0.0), lambda acc, t: acc + of[t]
    )
    return notes.groupBy(by, "force").agg(F.round(F.avg(weight), 6).alias("score"))


def merge_forces(scores: DataFrame, by: str, force_names: list[str]) -> DataFrame:
    """The five per-force results side by side, one record per key."""
    return scores.groupBy(by).pivot("force", force_names).agg(F.first("score"))


def dashboard_rollup(notes: DataFrame) -> DataFrame:
    """Totals by force, source and year, with subtotals; ``level`` tells which columns are rolled up."""
    return (
        notes.select("force", "source", F.year("ts").alias("year"), "amount")
        .rollup("force", "source", "year")
        .agg(
            F.grouping_id().cast("int").alias("level"),
            F.count("*").alias("notes"),
            F.round(F.sum("amount"), 2).alias("amount"),
        )
    )


def report_structure(reports: DataFrame, sections: dict[str, list[str]]) -> DataFrame:
    """Required sections each report has and lacks; headings match in any case."""
    required = F.create_map(
        *[x for f, names in sections.items() for x in (F.lit(f), F.array(*map(F.lit, names)))]
    )[F.col("force")]
    missing = F.filter(required, lambda s: ~F.contains(F.lower("text"), F.lower(s)))
    return reports.select(
        "report_id",
        "force",
        F.size(required).alias("required"),
        (F.size(required) - F.size(missing)).alias("present"),
        F.array_join(missing, "|").alias("missing"),
    )


def top_entities(notes: DataFrame, customers: DataFrame, cues: list, n: int = 10) -> DataFrame:
    """The ten most relevant entities; metadata joins only the ten."""
    best = (
        cue_ops.cue_hits(notes, "text", cues, ["entity_id", "source"])
        .groupBy("entity_id")
        .agg(
            F.sum("weight").alias("relevance"),
            F.round(F.sum("weight") / (F.sum("weight") + 5), 4).alias("confidence"),
            F.array_join(F.sort_array(F.collect_set("cue_group")), ", ").alias("tags"),
        )
        .orderBy(F.desc("relevance"), "entity_id")
        .limit(n)
    )
    return customers.join(F.broadcast(best), customers["c_custkey"] == best["entity_id"]).select(
        "entity_id",
        F.col("c_name").alias("title"),
        F.col("c_mktsegment").alias("summary"),
        "tags",
        "relevance",
        "confidence",
    )


def trend_velocity(events: DataFrame, n: int = 3) -> DataFrame:
    """Daily counts of the strongest trends and their change from the day before.

    A day without events counts zero; the first day of a trend has no change.
    The window runs over one row per day, not over events.
    """
    daily = events.groupBy("event_type", F.date_trunc("day", "ts").cast("date").alias("day")).agg(
        F.count("*").alias("mentions")
    )
    strongest = (
        daily.groupBy("event_type")
        .agg(F.sum("mentions").alias("total"))
        .orderBy(F.desc("total"), "event_type")
        .limit(n)
    )
    order = Window.partitionBy("event_type").orderBy("day")
    before = F.lag("day").over(order)
    adjoining = F.when(F.date_add(before, 1) == F.col("day"), F.lag("mentions").over(order)).otherwise(0)
    return daily.join(F.broadcast(strongest), "event_type").withColumn(
        "velocity", F.when(before.isNotNull(), F.col("mentions") - adjoining)
    )


def rank_sources(hits: DataFrame) -> DataFrame:
    """Routed sources of each force by mean hit score.

    The routing table bounds how many sources a force has, so the ranking
    window sees only its few aggregated rows.
    """
    by_score = Window.partitionBy("porter_force").orderBy(F.desc("relevance"))
    return (
        hits.groupBy("porter_force", "source")
        .agg(F.count("*").alias("hits"), F.round(F.avg("score"), 6).alias("relevance"))
        .withColumn("source_rank", F.dense_rank().over(by_score))
    )
