"""normalise() for single Python strings: for vocabularies and SQL users. Tables use the Columns of functions.text."""

from __future__ import annotations

import re
from functools import reduce

from tallyvox.functions import text as T

WIDE = {0x3000: " "} | {c: chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)}
ROMAN_SIGNS = str.maketrans("ⅠⅡⅢⅣⅤⅥⅰⅱⅲⅳⅴⅵ", "123456123456")
ROMAN = re.compile(f"[IVX]{{1,4}}(?=[{T.ROMAN_BEFORE}])")
NUMERAL = re.compile("[" + "".join(T.DIGITS) + "".join(T.TENS) + "".join(T.MYRIADS) + "]+")
STRIPPED = re.compile(f"[{T.SPACES}{T.PUNCTUATION}]+")


def _numeral(run: str) -> str:
    if not any(c in T.TENS or c in T.MYRIADS for c in run):
        return "".join(str(T.DIGITS[c]) for c in run)

    def read(state: tuple[int, int, int], c: str) -> tuple[int, int, int]:
        total, section, digit = state
        if c in T.TENS:
            return total, section + (digit or 1) * T.TENS[c], 0
        if c in T.MYRIADS:
            return total + ((section + digit) or 1) * T.MYRIADS[c], 0, 0
        return total, section, T.DIGITS[c]

    return str(sum(reduce(read, run, (0, 0, 0))))


def normalised(text: str | None) -> str:
    text = (text or "").translate(WIDE)
    for pattern, to in T.UNITS:
        text = re.sub(pattern, to, text)
    text = ROMAN.sub(lambda m: str(T.ROMAN.get(m[0], m[0])), text.translate(ROMAN_SIGNS))
    return STRIPPED.sub("", NUMERAL.sub(lambda m: _numeral(m[0]), text)).lower()
