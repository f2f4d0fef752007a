"""Which code page and which delimiter a delimited file was written with.

Code pages are compared by what they make of bytes outside ASCII: a page that yields controls, letters
of two scripts in one word, capitals inside words or rare ideographs is less likely than
one that yields ordinary words. Costs are sums over lines, so a file of any size can be split
among tasks. Delimiters are found by a state machine that knows quotes, from the number of fields.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Sequence
from functools import cache

import numpy as np

DELIMITERS = (",", ";", "\t", "|")
# fixed values: code pages tried for files that are no UTF-8, in order of preference on equal costs
PAGES = ("windows-1252", "windows-1251", "windows-1253", "KOI8-R", "Shift_JIS", "EUC-KR", "EUC-JP", "GB18030", "Big5")
_WIDE = frozenset(PAGES[4:])
# fixed values: the letters that make up most of a text in the languages of a page
_FREQUENT = {
    "windows-1251": frozenset("оеаинтсрвлкмдпуяыьгзб"),
    "KOI8-R": frozenset("оеаинтсрвлкмдпуяыьгзб"),
    "windows-1253": frozenset("αοιετσνρηπκμλυςάίέόή"),
}
# costs of what does not look like text
_BROKEN, _CONTROL, _MIXED, _FLIP, _INSIDE, _RARE, _ACCENTS, _CAPITAL, _SYMBOL = 12, 10, 3, 2, 2, 2, 1.5, 0.5, 0.3
_SELDOM = 0.3

_NONE, _LATIN, _ACCENTED, _OTHER = range(4)


@cache
def _kind(char: str) -> tuple[int, bool, float]:
    """Script of a letter, whether it is a capital, and the cost of the character by itself."""
    category = unicodedata.category(char)
    if category in ("Cc", "Cn", "Co", "Cs") and char != "\t":
        return _NONE, False, _CONTROL
    if category[0] not in "LM":
        return _NONE, False, 0.0 if char < "\x80" else _SYMBOL
    latin = "LATIN" in unicodedata.name(char, "")
    script = (_LATIN if char < "\x80" else _ACCENTED) if latin else _OTHER
    return script, category == "Lu", 0.0


def narrow_cost(text: str, frequent: frozenset[str] = frozenset()) -> float:
    """Cost of the characters outside ASCII of a text from a page of one byte a character.

    Letters of other scripts than Latin that are not ``frequent`` cost a little.
    """
    cost, before, small = 0.0, _NONE, False
    kinds = [_kind(c) for c in text]
    for i, char in enumerate(text):
        script, capital, own = kinds[i]
        if char >= "\x80" or before in (_ACCENTED, _OTHER):
            if char >= "\x80":
                cost += own
                if script == _OTHER and char.lower() not in frequent:
                    cost += _SELDOM
                after = kinds[i + 1][0] if i + 1 < len(text) else _NONE
                if script == _NONE and before != _NONE and after != _NONE and char not in "’­·":
                    cost += _INSIDE
            if script != _NONE and before != _NONE:
                if (script == _OTHER) != (before == _OTHER):
                    cost += _MIXED
                if script == _ACCENTED and before == _ACCENTED:
                    cost += _ACCENTS
                if capital:
                    cost += _FLIP if small else _CAPITAL
        before, small = script, script != _NONE and not capital
    return cost


def _common_pairs(page: str) -> np.ndarray:
    """Which two-byte codes of a page are everyday characters, from the plan of its national standard."""
    lead, trail = np.divmod(np.arange(65536), 256)
    if page == "Shift_JIS":  # signs, kana and the first level of kanji
        return (lead == 0x81) | ((lead == 0x82) & (trail >= 0x4F)) | (lead == 0x83) | ((lead >= 0x88) & (lead < 0x98))
    if page == "EUC-JP":
        return ((lead >= 0xA1) & (lead <= 0xA5)) | ((lead >= 0xB0) & (lead <= 0xCF))
    if page == "GB18030":
        return (trail >= 0xA1) & (((lead >= 0xA1) & (lead <= 0xA3)) | ((lead >= 0xB0) & (lead <= 0xD7)))
    if page == "EUC-KR":
        return (trail >= 0xA1) & (((lead >= 0xA1) & (lead <= 0xA3)) | ((lead >= 0xB0) & (lead <= 0xC8)))
    return ((lead >= 0xA1) & (lead <= 0xA3)) | ((lead >= 0xA4) & (lead <= 0xC6))  # Big5


@cache
def _common(page: str) -> np.ndarray:
    return _common_pairs(page)


def wide_cost(raw: bytes, page: str) -> float:
    """Cost of a line in a page with characters of several bytes."""
    try:
        text = raw.decode(page)
    except UnicodeDecodeError:
        return _BROKEN + 0.1 * sum(b >= 0x80 for b in raw)
    cost, common, before = 0.0, _common(page), ""
    for char in text:
        if char >= "\x80":
            code = char.encode(page)
            if len(code) != 2 or not common[code[0] * 256 + code[1]]:
                cost += _RARE
            elif page == "EUC-JP" and code[0] >= 0xB0:  # Japanese is not written without kana
                cost += _SELDOM
            # a pair whose second byte is ASCII, next to Latin letters, is rather an accented letter
            elif before.isascii() and before.isalpha():
                cost += _CAPITAL
        before = char
    return cost


def line_costs(raw: bytes) -> list[float]:
    """Cost of one line under every page of :data:`PAGES`."""
    out = []
    for page in PAGES:
        if page in _WIDE:
            out.append(wide_cost(raw, page))
        else:  # bytes without a meaning become a control
            out.append(narrow_cost(raw.decode(page, "replace").replace("�", "\x81"), _FREQUENT.get(page, frozenset())))
    return out


def field_counts(text: str, delimiter: str) -> list[int]:
    """Fields of each record; delimiters and line ends inside quotes do not count.

    A quote opens at the start of a field only, and a doubled one stays inside. A record that is cut off
    inside quotes is left out, unless it is the only one.
    """
    counts, fields, quoted, start, empty = [], 1, False, True, True
    for char in text:
        if quoted:
            quoted = char != '"'  # a doubled quote closes and opens again
        elif char == '"' and (start or last == '"'):
            quoted = True
        elif char == delimiter:
            fields += 1
        elif char == "\n":
            if not empty:
                counts.append(fields)
            fields, start, empty, last = 1, True, True, ""
            continue
        start, empty, last = char == delimiter and not quoted, False, char
    if not empty and (not quoted or not counts):
        counts.append(fields)
    return counts


def choose_delimiter(text: str, candidates: Sequence[str] = DELIMITERS) -> str:
    """The delimiter that splits the header, and as many records as possible into as many fields.

    Then more fields win, then the order of ``candidates``; a header of one field has a comma.
    """
    best, chosen = None, candidates[0]
    for i, delimiter in enumerate(candidates):
        counts = field_counts(text, delimiter)
        if not counts or counts[0] == 1:
            continue
        alike = sum(c == counts[0] for c in counts) / len(counts)
        if best is None or (alike, counts[0], -i) > best:
            best, chosen = (alike, counts[0], -i), delimiter
    return chosen
