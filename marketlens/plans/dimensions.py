"""Small fixed tables: forces, routing, suggestions, templates, cues.

They are local relations of known size, so a join against one is a broadcast
whatever the other side's size.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

# Canonical force, and the names used for it in analysis, routing and prompts.
FORCES = [
    ("rivalry", "Competitive Rivalry", "Industry Rivalry", "Rivalry"),
    ("buyer_power", "Buyer Power", "Buyer Power", "Buyer Power"),
    ("supplier_power", "Supplier Power", "Supplier Power", "Supplier Power"),
    ("substitutes", "Threat of Substitutes", "Substitute Products", "Substitutes"),
    ("new_entrants", "Threat of New Entrants", "New Entrants", "New Entrants"),
]
CANONICAL_FORCES = [f[0] for f in FORCES]

# Which sources serve which force.
ROUTES = {
    "Buyer Power": ["LinkedIn", "Glassdoor", "BuiltWith", "Clearbit", "Snov.io", "People Data Labs"],
    "Supplier Power": ["Alibaba", "OpenCorporates", "ImportYeti", "ProcurementIQ", "Supplier.io", "ThomasNet"],
    "New Entrants": ["Crunchbase", "Pitchbook", "AngelList", "CBInsights", "ProductHunt", "Y Combinator"],
    "Substitute Products": ["G2", "Capterra", "App Store", "Play Store", "GitHub Trends", "HuggingFace Spaces", "IndieHackers"],
    "Industry Rivalry": ["SEMrush", "SimilarWeb", "Ahrefs", "Craft.co", "SpyFu", "BuiltWith"],
}

# What to improve in a weak area.
SUGGESTIONS = {
    "Market Viability": [
        "Add specific target demographics",
        "Mention demand signals (e.g., search trends, user interviews)",
        "Cite real market gaps",
    ],
    "Competitive Edge": [
        "Define unique value proposition",
        "Benchmark against known competitors",
    ],
    "Revenue Model": [
        "Include revenue projections",
        "Describe pricing strategy",
        "Mention key partnerships",
    ],
    "Team Capability": [
        "Outline team background",
        "Describe technical skills or domain expertise",
    ],
    "Relevance to FinTech": [
        "Align with FinTech use cases like lending, payments, or compliance",
        "Mention specific financial technologies used",
    ],
}

# Score name in a verdict, and the response key it is read from.
SCORE_KEYS = [
    ("relevance_score", "relevance_score"),
    ("Market Viability", "market_viability"),
    ("Competitive Edge", "competitive_edge"),
    ("Revenue Model", "revenue_model"),
    ("Team Capability", "team_capability"),
]
PASS_THRESHOLD = 6

# Parts an analysis of each force must have.
SECTIONS = {
    "rivalry": ["Market Concentration Score", "Trend Analysis", "Financial Health Indicators"],
    "buyer_power": ["Customer Concentration Score", "Lead Scoring Model", "Financial Metrics"],
    "supplier_power": ["Supplier Criticality Score", "Cost Structure Analysis", "Risk Assessment"],
    "substitutes": ["SUBSTITUTION THREAT SCORE", "DISRUPTION ANALYSIS", "DASHBOARD METRICS"],
    "new_entrants": ["ENTRY THREAT SCORE", "ENTRANT PROFILING", "DASHBOARD METRICS"],
}

# Default prompts in our own words, one ``{context}`` slot each. Callers may pass their own table.
TEMPLATES = {
    force: f"Assess the force '{force}' from the evidence below.\n{{context}}\nReport these parts: "
    + "; ".join(SECTIONS[force])
    + "."
    for force in CANONICAL_FORCES
}
META_TEMPLATE = (
    "Plan a market crawl for the force {porter_force}.\n"
    "Business idea: {project_idea}\n"
    "Return ranked search queries, sources, ten entities with metadata, and observations "
    "with a confidence between 0 and 1, all about {porter_force}."
)

# Our cue vocabulary: (group, phrase, weight). Data, not rules.
CUES = [
    ("switching", "switching cost", 2.0),
    ("switching", "migration", 1.0),
    ("price", "price sensitive", 2.0),
    ("price", "discount", 1.0),
    ("price", "cheaper price", 2.0),
    ("intent", "demo", 1.0),
    ("intent", "trial", 1.0),
    ("intent", "pricing quote", 2.0),
    ("engagement", "asked", 1.0),
    ("engagement", "service", 1.0),
    ("engagement", "support", 1.0),
    ("regulation", "license", 1.0),
    ("regulation", "regulation", 2.0),
    ("scale", "economies of scale", 2.0),
    ("brand", "incumbent", 1.0),
    ("brand", "brand", 1.0),
    ("license", "license", 1.0),
    ("capital", "funding", 1.0),
    ("capital", "venture capital", 1.0),
    ("patent", "patent", 1.0),
    ("unique_technology", "proprietary", 1.0),
    ("unique_technology", "unique technology", 2.0),
    ("alternative", "substitute", 2.0),
    ("alternative", "alternative", 1.0),
    ("alternative", "blockchain", 1.0),
    ("parity", "feature parity", 2.0),
    ("adoption", "adoption", 1.0),
    ("behaviour", "consumers prefer", 2.0),
    ("behaviour", "mobile app", 1.0),
    ("entrant", "startup", 1.0),
    ("entrant", "bank", 1.0),
    ("entry_vector", "funding", 1.0),
    ("entry_vector", "acquisition", 1.0),
]
LEXICON = [
    ("excellent", 1.0),
    ("growing", 1.0),
    ("grew", 1.0),
    ("poor", -1.0),
    ("outage", -1.0),
    ("slow", -1.0),
    ("deter", -0.5),
]

# Search requests: a force and the keywords asked for.
SEARCHES = [
    (1, "Buyer Power", "the price of this and that"),
    (2, "Supplier Power", "la chaine de valeur des banques"),
    (3, "New Entrants", "der markt und die banken"),
    (4, "Substitute Products", "el pago en la tienda"),
    (5, "Industry Rivalry", "who is in it for the long run"),
]


def local_table(spark: SparkSession, columns: str, rows) -> DataFrame:
    """A local relation: Spark knows its size, so it is broadcast when joined."""
    names = columns.split()
    return spark.createDataFrame(pa.table({n: list(c) for n, c in zip(names, zip(*rows))}))


def forces(spark: SparkSession) -> DataFrame:
    """One row per name a force goes by: ``(alias, force)``."""
    rows = sorted({(alias.lower(), f[0]) for f in FORCES for alias in f})
    return local_table(spark, "alias force", rows)


def routes(spark: SparkSession) -> DataFrame:
    rows = [(f, s, i) for f, sources in ROUTES.items() for i, s in enumerate(sources)]
    return local_table(spark, "routing_force source source_rank", rows)


def suggestions(spark: SparkSession) -> DataFrame:
    return local_table(spark, "area suggestions", SUGGESTIONS.items())


def templates(spark: SparkSession) -> DataFrame:
    return local_table(spark, "force template", TEMPLATES.items())


def sections(spark: SparkSession) -> DataFrame:
    rows = [(f, s) for f, names in SECTIONS.items() for s in names]
    return local_table(spark, "force section", rows)


def cues(spark: SparkSession, *groups: str) -> DataFrame:
    rows = [c for c in CUES if not groups or c[0] in groups]
    return local_table(spark, "cue_group term weight", rows)


def sql_values(rows, name: str, columns: str) -> str:
    """The same rows as a CTE for checking SQL."""

    def lit(v) -> str:
        if isinstance(v, str):
            return "'" + v.replace("'", "''") + "'"
        return f"cast({v} as double)" if isinstance(v, float) else str(v)

    body = ", ".join("(" + ", ".join(lit(v) for v in r) + ")" for r in rows)
    return f"{name}({columns}) as (values {body})"
