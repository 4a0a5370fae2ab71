"""IP addresses and ranges as fixed-width hexadecimal text, in SQL expressions.

IPv4 becomes 8 digits and IPv6 32, so text order is address order, the width names
the family, and the first n bits of an address are its first digits with one
digit masked. An IPv6 form of an IPv4 address (``::ffff:a.b.c.d``) counts as IPv4.
"""

from __future__ import annotations

DIGITS = "0123456789abcdef"
_OCTET = "(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
_QUAD = rf"{_OCTET}(?:[.]{_OCTET}){{3}}"
MAPPED = "0" * 20 + "ffff"


def _quad_hex(text: str) -> str:
    return f"array_join(transform(split({text}, '[.]'), octet -> lpad(lower(hex(CAST(octet AS INT))), 2, '0')), '')"


def _groups(text: str) -> str:
    """The groups of one side of ``::``, none of an empty side."""
    return f"IF({text} = '', CAST(array() AS array<string>), split({text}, ':'))"


def address_steps(text: str, name: str) -> list[dict[str, str]]:
    """Columns to add one after another; the last, ``name``, is the address in hexadecimal.

    Null where the text is no address. Square brackets and an IPv6 zone are left
    off. Octets with leading zeros are refused, as they are read in two ways.
    """
    bare = rf"lower(regexp_replace(trim({text}), r'^\[|\]$|%[^\]]*', ''))"
    tail = rf"regexp_extract(_a_text, r'(?<=:){_QUAD}$', 0)"
    return [
        {"_a_text": bare},
        {"_a_quad": f"CASE WHEN _a_text RLIKE r'^{_QUAD}$' THEN _a_text ELSE {tail} END"},
        {"_a_hex": f"CASE WHEN _a_quad <> '' THEN {_quad_hex('_a_quad')} END"},
        {
            # the last four octets of an IPv6 address are two groups
            "_a_six": "CASE WHEN _a_text = _a_quad THEN NULL WHEN _a_quad <> '' THEN concat(left(_a_text,"
            " length(_a_text) - length(_a_quad)), left(_a_hex, 4), ':', right(_a_hex, 4)) ELSE _a_text END"
        },
        {
            "_a_left": _groups("get(split(_a_six, '::', 2), 0)"),
            "_a_right": _groups("get(split(_a_six, '::', 2), 1)"),
            "_a_gap": "instr(_a_six, '::') > 0",
        },
        {"_a_missing": "8 - size(_a_left) - IF(_a_gap, size(_a_right), 0)"},
        {
            "_a_long": "CASE WHEN forall(concat(_a_left, IF(_a_gap, _a_right, CAST(array() AS array<string>))),"
            " part -> part RLIKE '^[0-9a-f]{1,4}$') AND IF(_a_gap, _a_missing >= 1, _a_missing = 0)"
            " THEN array_join(transform(concat(_a_left, array_repeat('0', _a_missing),"
            " IF(_a_gap, _a_right, CAST(array() AS array<string>))), part -> lpad(part, 4, '0')), '') END"
        },
        {
            name: f"CASE WHEN _a_text = _a_quad THEN _a_hex WHEN startswith(_a_long, '{MAPPED}')"
            " THEN right(_a_long, 8) ELSE _a_long END"
        },
    ]


def prefix_sql(address: str, bits: int | str) -> str:
    """The first ``bits`` of an address in hexadecimal, as text that is equal for equal prefixes."""
    if isinstance(bits, int):
        whole, rest = divmod(bits, 4)
        if not rest:
            return f"left({address}, {whole})"
        mask = 0b1111 << 4 - rest & 0b1111
        return f"concat(left({address}, {whole}), {_masked(address, whole, mask)})"
    mask = f"(shiftleft(15, CAST(4 - {bits} % 4 AS INT)) & 15)"
    masked = _masked(address, f"CAST({bits} DIV 4 AS INT)", mask)
    return f"concat(left({address}, CAST({bits} DIV 4 AS INT)), IF({bits} % 4 = 0, '', {masked}))"


def _masked(address: str, place: int | str, mask: int | str) -> str:
    digit = f"instr('{DIGITS}', substring({address}, {place} + 1, 1)) - 1"
    return f"substring('{DIGITS}', (({digit}) & {mask}) + 1, 1)"
