"""Snippets the checking SQL is written with. DuckDB dialect."""

from __future__ import annotations

from ..functions import text

WS = text.WS


def strip(c: str) -> str:
    return f"regexp_replace({c}, '^{WS}+|{WS}+$', '', 'g')"


def clean_str(c: str) -> str:
    squeezed = f"trim(regexp_replace({c}, '{WS}+', ' ', 'g'))"
    return f"nullif(regexp_replace({squeezed}, '[^{text.KEPT_CHARACTERS}]', '', 'g'), '')"


def email(c: str) -> str:
    e = strip(f"lower({c})")
    return f"case when regexp_matches({e}, '{text.EMAIL_PATTERN}') then {e} end"


def phone(c: str) -> str:
    p, d = strip(c), f"regexp_replace({strip(c)}, '[^0-9]', '', 'g')"
    abroad = f"{p} like '+%' and {d} not like '1%'"
    return (
        f"case when {abroad} then case when regexp_matches({d}, '^[0-9]{{8,15}}$') then '+' || {d} end"
        f" when regexp_matches({d}, '^1?[2-9][0-9]{{2}}[2-9][0-9]{{6}}$') then '+1' || right({d}, 10) end"
    )


def url(c: str) -> str:
    u = strip(f"nullif({c}, '')")
    full = f"(case when regexp_matches({u}, '{text.URL_SCHEME_PATTERN}') then {u} else 'http://' || {u} end)"
    return f"case when regexp_matches({full}, '{text.URL_PATTERN}') then {full} end"


def title_case(c: str) -> str:
    runs = rf"regexp_extract_all({c}, '\p{{L}}+|[^\p{{L}}]+')"
    return f"array_to_string(list_transform({runs}, lambda x: upper(x[1]) || lower(x[2:])), '')"


def first_name(c: str) -> str:
    return title_case(f"nullif(regexp_extract({c}, '^ *([^ ]+)', 1), '')")


def last_name(c: str) -> str:
    return title_case(f"nullif(regexp_extract({c}, '^ *[^ ]+ +([^ ].*)$', 1), '')")


def enriched(c: str, it: str, startup: str, otherwise: str) -> str:
    return (
        f"case when contains({c}, 'Tech') or contains({c}, 'Software') then '{it}'"
        f" when contains({c}, 'Startup') then '{startup}' else {otherwise} end"
    )


def tokens(c: str) -> str:
    return f"regexp_extract_all(lower({c}), '{text.WORD}')"
