"""Column-to-Column text functions. Everything here stays inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Whitespace as Python's ``str.strip`` and ``re`` see it. Java's and RE2's bare
# ``\s`` are ASCII only.
WS = r"[\s\p{Z}\x0b\x1c-\x1f\x85]"
# The same characters one by one, for trimming without a regular expression.
WHITESPACE = "".join(c for c in map(chr, range(0x3001)) if c.isspace())

# Patterns and enrichment constants that decide results.
EMAIL_PATTERN = r"^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}$"
URL_SCHEME_PATTERN = r"^[a-zA-Z]+://"
URL_PATTERN = r"^https?://([-\p{L}\p{N}_.]|%[0-9a-fA-F]{2})+"
KEPT_CHARACTERS = r"\p{L}\p{N}_\s.,\-@:/"
UNKNOWN_SOURCE = "Unknown"
FAILURE_PREFIX = "Failed to extract content: "
MAX_CONTENT_CHARS = 8000
MAX_QUERY_CHARS = 400
KEYWORD_JOINER = " OR "

WORD = r"[\p{L}\p{N}]+"
GAP = r"[^\p{L}\p{N}]+"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once, however often the body reads it."""
    return F.transform(F.array(value), body)[0]


def strip(c: Column | str) -> Column:
    """Remove leading and trailing whitespace of any kind (``trim`` drops spaces only)."""
    return F.btrim(_col(c), F.lit(WHITESPACE))


def blank_to_null(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def clean_str(c: Column | str) -> Column:
    """Collapse whitespace, then delete symbols; the order leaves double spaces behind."""
    squeezed = F.trim(F.regexp_replace(_col(c), f"{WS}+", " "))
    return blank_to_null(F.regexp_replace(squeezed, f"[^{KEPT_CHARACTERS}]", ""))


def normalize_email(c: Column | str) -> Column:
    email = strip(F.lower(_col(c)))
    return F.when(email.rlike(EMAIL_PATTERN), email)


def normalize_phone(c: Column | str) -> Column:
    """E.164 by shape: North American numbers by default, others with a leading plus."""
    phone = strip(c)
    digits = F.regexp_replace(phone, "[^0-9]", "")
    national = r"^1?[2-9][0-9]{2}[2-9][0-9]{6}$"
    international = phone.startswith("+") & ~digits.startswith("1")
    return (
        F.when(international & digits.rlike("^[0-9]{8,15}$"), F.concat(F.lit("+"), digits))
        .when(international, F.lit(None))
        .when(digits.rlike(national), F.concat(F.lit("+1"), F.right(digits, F.lit(10))))
    )


def normalize_url(c: Column | str) -> Column:
    """Default the scheme, then keep only what starts like an http(s) address."""
    raw = blank_to_null(_col(c))
    url = strip(raw)
    with_scheme = F.when(url.rlike(URL_SCHEME_PATTERN), url).otherwise(
        F.concat(F.lit("http://"), url)
    )
    return F.when(with_scheme.rlike(URL_PATTERN), with_scheme)


def title_case(c: Column | str) -> Column:
    """Upper-case every letter that follows a non-letter (``initcap`` follows spaces only)."""
    runs = F.regexp_extract_all(_col(c), F.lit(r"\p{L}+|\P{L}+"), F.lit(0))
    return F.array_join(F.transform(runs, F.initcap), "")


def first_name(cleaned: Column | str) -> Column:
    return title_case(blank_to_null(F.regexp_extract(_col(cleaned), "^ *([^ ]+)", 1)))


def last_name(cleaned: Column | str) -> Column:
    return title_case(blank_to_null(F.regexp_extract(_col(cleaned), "^ *[^ ]+ +([^ ].*)$", 1)))


def enriched_industry(company: Column | str, industry: Column | str) -> Column:
    c = _col(company)
    # Fixed values.
    return (
        F.when(c.contains("Tech") | c.contains("Software"), "IT & Software")
        .when(c.contains("Startup"), "Innovation & Technology")
        .otherwise(_col(industry))
    )


def enriched_company_size(company: Column | str, size: Column | str) -> Column:
    c = _col(company)
    # Fixed values.
    return (
        F.when(c.contains("Tech") | c.contains("Software"), "51-200 employees")
        .when(c.contains("Startup"), "11-50 employees")
        .otherwise(_col(size))
    )


def truncate(c: Column | str, n: int = MAX_CONTENT_CHARS) -> Column:
    return F.substring(_col(c), 1, n)


def extract_status(c: Column | str) -> Column:
    return F.when(_col(c).startswith(FAILURE_PREFIX), "failed").otherwise("ok")


def keyword_split(c: Column | str) -> Column:
    """Comma list to array: blanks go first, then quotes and spaces are peeled off."""
    parts = F.filter(F.split(_col(c), ","), lambda x: x.rlike(f"[^{WHITESPACE}]"))
    return F.transform(parts, lambda x: F.btrim(x, F.lit('" ')))


def keyword_pack(
    keywords: Column | str, fallback: Column | str, budget: int = MAX_QUERY_CHARS
) -> Column:
    """OR-join keywords while they fit; the first that does not fit ends the query.

    Only lengths are folded; the text is put together once. Empty keywords add
    no joiner while the query is still empty, so leading ones are skipped.
    """
    state = F.struct(*[F.lit(0).alias(n) for n in ("chars", "kept", "skipped", "full")])

    def step(acc: Column, word: Column) -> Column:
        empty = acc["chars"] == 0
        chars = acc["chars"] + F.length(word) + F.when(empty, 0).otherwise(len(KEYWORD_JOINER))
        fits = (acc["full"] == 0) & (chars <= budget)
        blank = empty & (word == "")
        return F.struct(
            F.when(fits, chars).otherwise(acc["chars"]).alias("chars"),
            (acc["kept"] + (fits & ~blank).cast("int")).alias("kept"),
            (acc["skipped"] + (fits & blank).cast("int")).alias("skipped"),
            F.when(fits, 0).otherwise(1).alias("full"),
        )

    def pack(words: Column) -> Column:
        return let(
            F.aggregate(words, state, step),
            lambda counts: F.array_join(F.slice(words, counts["skipped"] + 1, counts["kept"]), KEYWORD_JOINER),
        )

    return F.coalesce(let(let(_col(keywords), pack), blank_to_null), _col(fallback))


def search_query_text(force: Column | str, keywords: Column | str) -> Column:
    return F.concat_ws(" ", _col(force), _col(keywords))


def tokens(c: Column | str) -> Column:
    return F.regexp_extract_all(F.lower(_col(c)), F.lit(WORD), F.lit(0))


def spaced(c: Column | str) -> Column:
    """The tokens with one space between them."""
    return F.trim(F.regexp_replace(F.lower(_col(c)), GAP, " "))
