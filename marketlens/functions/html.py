"""HTML to visible text, in the JVM."""

from __future__ import annotations

import json
from html.entities import html5, name2codepoint

from pyspark.sql import Column, functions as F

from .text import let, strip

# A single left-to-right pass, so a comment inside a script (or the reverse) is
# read the way a tokenizer reads it. An element left open runs to the end.
_HIDDEN = "|".join(rf"<{t}\b[^>]*>.*?(?:</{t}\s*>|\z)" for t in ("script", "style", "noscript"))
# Possessive, so any number of attributes is read without recursion.
_QUOTED_TAG = r"""</?[a-zA-Z][^>"']*+(?:(?:"[^"]*"|'[^']*')[^>"']*+)*+>"""
MARKUP = rf"(?is)<!--.*?(?:-->|\z)|{_HIDDEN}|{_QUOTED_TAG}|</?[a-zA-Z][^>]*>|<[!?][^>]*>"
BREAK = "\x01"

_REFERENCE = r"^(#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[^\t\n\f <&#;]{1,32};)"
# Names that count without a semicolon, whatever follows; the longest that fits.
_BARE = "|".join(sorted((n for n in html5 if not n.endswith(";")), key=lambda n: (-len(n), n)))
_MAX_POINT = 0x10FFFF


def _lookup(names: dict[str, str]) -> Column:
    """A constant map, given as one literal."""
    return F.from_json(F.lit(json.dumps(names)), "map<string,string>")


def _old_code_page() -> dict[str, str]:
    """Numbers 128 to 159 mean the characters of code page 1252 where it has one."""
    page = {}
    for i in range(0x80, 0xA0):
        try:
            page[str(i)] = bytes([i]).decode("cp1252")
        except UnicodeDecodeError:
            page[str(i)] = chr(i)
    return page


def unescape(c: Column) -> Column:
    """Decode named and numeric character references in one pass, as HTML5 reads them."""
    names = sorted((n for n in html5 if n.endswith(";")), key=lambda n: n[:-1] not in name2codepoint)
    named = _lookup({n: html5[n] for n in names})
    bare = _lookup({n: v for n, v in html5.items() if not n.endswith(";")})
    old = _lookup(_old_code_page())

    def number(ref: Column) -> Column:
        hexed = ref.rlike("^#[xX]")
        digits = F.ltrim(F.regexp_replace(ref, "^#[xX]?|;$", ""), F.lit("0"))
        value = F.when(hexed, F.conv(digits, 16, 10)).otherwise(digits).cast("long")
        return F.when(digits == "", 0).when(F.length(digits) > 7, _MAX_POINT + 1).otherwise(value)

    def point(n: Column) -> Column:
        gone = (
            n.between(0x1, 0x8) | (n == 0xB) | n.between(0xE, 0x1F) | (n == 0x7F)
            | n.between(0xFDD0, 0xFDEF) | (n % 0x10000 >= 0xFFFE)
        )
        return (
            F.when((n == 0) | n.between(0xD800, 0xDFFF) | (n > _MAX_POINT), F.lit("�"))
            .when(n.between(0x80, 0x9F), old[n.cast("string")])
            .when(gone, F.lit(""))
            .otherwise(F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32"))
        )

    def piece(p: Column) -> Column:
        def whole(ref: Column) -> Column:
            character = F.when(ref.startswith("#"), let(number(ref), point)).when(ref != "", named[ref])
            return F.concat(character, F.substr(p, F.length(ref) + F.lit(1)))

        def start(name: Column) -> Column:
            return F.when(name != "", F.concat(bare[name], F.substr(p, F.length(name) + F.lit(1))))

        return F.coalesce(
            let(F.regexp_extract(p, _REFERENCE, 1), whole),
            let(F.regexp_extract(p, f"^({_BARE})", 1), start),
            F.concat(F.lit("&"), p),
        )

    def decoded(text: Column) -> Column:
        return let(
            F.split(text, "&"),
            lambda parts: F.array_join(
                F.transform(parts, lambda p, i: F.when(i == 0, p).otherwise(piece(p))), ""
            ),
        )

    return F.when(c.contains("&"), decoded(c)).otherwise(c)


def html_to_text(c: Column | str) -> Column:
    """Strip each text node, drop empty ones, join with one space."""
    html = F.col(c) if isinstance(c, str) else c
    nodes = F.split(F.regexp_replace(html, MARKUP, BREAK), BREAK)
    visible = F.filter(F.transform(nodes, lambda n: strip(unescape(n))), lambda n: n != "")
    return F.array_join(visible, " ")
