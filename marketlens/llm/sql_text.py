"""Parts of the checking SQL that several queries of this subpackage share (DuckDB)."""

from __future__ import annotations

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# The 256 remainders of the CRC polynomial, one list.
CRC_TABLE = """
crc_table as (
  select list(r order by i) as crcs from (
    select i, list_reduce(list_prepend(i, range(8)), lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end) as r
    from (select unnest(range(256)) as i)))
"""


def lowered(column: str) -> str:
    return f"translate(coalesce({column}, ''), '{_UPPER}', '{_LOWER}')"


def alnum_words(column: str) -> str:
    """Runs of digits, lowered letters and everything beyond ASCII."""
    return rf"regexp_extract_all({lowered(column)}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


def crc32(column: str) -> str:
    """Unsigned CRC of a text's UTF-8 bytes; ``crcs`` of CRC_TABLE must be in reach."""
    hexes = f"hex(encode({column}))"
    values = f"list_transform(range(0, length({hexes}) // 2), lambda p: ('0x' || substring({hexes}, 2 * p + 1, 2))::bigint)"
    return f"xor(list_reduce(list_prepend(4294967295::bigint, {values}), lambda c, b: xor(c >> 8, crcs[(xor(c, b) & 255) + 1])), 4294967295::bigint)"
