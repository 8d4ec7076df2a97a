"""Text normalisation and text metrics as Columns.

Written and recognised texts are projected into one space: half width, one spelling of
units, Arabic numerals, no punctuation, lower case. Null stays null, but for normalise(), where it is empty.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters of numerals and their worth, unit spellings, Roman numerals, punctuation.
DIGITS = {"零": 0, "〇": 0, "○": 0, "0": 0, "一": 1, "幺": 1, "么": 1, "壹": 1, "二": 2, "两": 2, "贰": 2, "三": 3, "叁": 3, "四": 4, "肆": 4, "五": 5, "伍": 5, "六": 6, "陆": 6, "七": 7, "柒": 7, "八": 8, "捌": 8, "九": 9, "玖": 9}
TENS = {"十": 10, "拾": 10, "百": 100, "佰": 100, "千": 1000, "仟": 1000}
MYRIADS = {"万": 10_000, "亿": 100_000_000}
UNITS = (("千伏安", "kva"), ("千伏", "kv"), ("[kK][vV]", "kv"), ("兆瓦", "mw"), ("[mM][wW]", "mw"), ("千瓦", "kw"), ("安培", "a"), ("伏特", "v"))
ROMAN = {"I": 1, "II": 2, "III": 3, "IV": 4, "V": 5, "VI": 6, "VII": 7, "VIII": 8, "IX": 9, "X": 10}
ROMAN_BEFORE = "段母号回组"
LATIN_SPACES, WIDE_SPACES = "\\t-\\r \\x1c-\\x1f\\x85\\xa0", "\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
WIDE_PUNCTUATION, LATIN_PUNCTUATION = "，。、；：？！“”‘’（）《》〈〉【】〔〕…—～", "·,.;:?!\"'()\\[\\]{}<>/\\\\|`~@#$%^&*_+=\\-"
SPACES, PUNCTUATION = LATIN_SPACES + WIDE_SPACES, WIDE_PUNCTUATION + LATIN_PUNCTUATION
KEYWORDS = "远方 就地 并列 解列 拉开 合上 电气 机械".split()
NUMBER_ERROR, WORD_ERROR, OTHER_ERROR, NO_DIGITS = "数字", "方向/动作词", "其它用字差异", "无"


def once(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value) with the value computed once, however often `then` names it."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def only_where(text: Column, pattern: str, change: Callable[[Column], Column]) -> Column:
    """change(text) for texts in which the pattern stands; others, which are most, cost one search."""
    return once(text, lambda t: F.when(t.rlike(pattern), change(t)).otherwise(t))


def half_width(text: Column) -> Column:
    wide = "".join(map(chr, range(0xFF01, 0xFF5F)))
    return F.translate(text, wide + "　", "".join(map(chr, range(0x21, 0x7F))) + " ")


def one_unit_spelling(text: Column) -> Column:
    for pattern, to in UNITS:
        text = F.regexp_replace(text, pattern, to)
    return text


def roman_to_arabic(text: Column) -> Column:
    """Roman numeral characters anywhere; capital letters only before the words that follow such numbers.

    Of a longer run of I, V and X only its last four letters count as the numeral; one that isn't known stays.
    """
    text = F.translate(text, "ⅠⅡⅢⅣⅤⅥⅰⅱⅲⅳⅴⅵ", "123456123456")
    for letters, value in sorted(ROMAN.items(), key=lambda x: -len(x[0])):
        alone = "" if len(letters) == 4 else "(?<![IVX])"
        text = F.regexp_replace(text, f"{alone}{letters}(?=[{ROMAN_BEFORE}])", str(value))
    return text


def numerals_to_arabic(text: Column) -> Column:
    """Each run of numeral characters: digit by digit without a place word, else by place value."""
    every = "".join(DIGITS) + "".join(TENS) + "".join(MYRIADS)
    worth = {**DIGITS, **TENS, **MYRIADS}
    number = lambda x: F.lit(x).cast("decimal(38,0)")
    value_of = F.create_map(*(F.lit(y) for k, v in worth.items() for y in (k, v)))
    zero = F.struct(number(0).alias("total"), number(0).alias("section"), number(0).alias("digit"))

    def step(s: Column, ch: Column) -> Column:
        v = F.element_at(value_of, ch).cast("decimal(38,0)")
        one = lambda x: F.when(x == 0, number(1)).otherwise(x)
        add = lambda total, section, digit: F.struct(total.cast("decimal(38,0)").alias("total"), section.cast("decimal(38,0)").alias("section"), digit.cast("decimal(38,0)").alias("digit"))
        placed = add(s["total"], s["section"] + (one(s["digit"]) * v).cast("decimal(38,0)"), number(0))
        closed = add(s["total"] + (one((s["section"] + s["digit"]).cast("decimal(38,0)")) * v).cast("decimal(38,0)"), number(0), number(0))
        return F.when(ch.isin(*TENS), placed).when(ch.isin(*MYRIADS), closed).otherwise(add(s["total"], s["section"], v))

    def run(part: Column) -> Column:
        plain = F.translate(part, "".join(DIGITS), "".join(map(str, DIGITS.values())))
        valued = F.aggregate(F.split(part, ""), zero, step, lambda s: (s["total"] + s["section"] + s["digit"]).cast("string"))
        placed = part.rlike(f"[{''.join(TENS)}{''.join(MYRIADS)}]")
        return F.when(part.rlike(f"^[{every}]"), F.when(placed, valued).otherwise(plain)).otherwise(part)

    parts = F.regexp_extract_all(text, F.lit(f"(?s)[{every}]+|[^{every}]+"), F.lit(0))
    return F.array_join(F.transform(parts, run), "")


def normalise(text: Column) -> Column:
    """The common space of written and recognised texts. Units go before numerals, since some share characters."""
    text = only_where(F.coalesce(text, F.lit("")), "[\uff01-\uff5e\u3000]", half_width)
    text = only_where(text, "|".join(pattern for pattern, _ in UNITS), one_unit_spelling)
    text = only_where(text, f"[Ⅰ-Ⅵⅰ-ⅵ]|[IVX][{ROMAN_BEFORE}]", roman_to_arabic)
    text = only_where(text, "[○〇一-龥]", numerals_to_arabic)  # all such characters but 0, which stays as it is
    # a class of Latin-1 characters alone is matched by one look-up a character
    text = only_where(text, "[\u1680\u2000-\u206f\u3000-\u303f\uff00-\uff5f]", lambda t: F.regexp_replace(t, f"[{WIDE_SPACES}{WIDE_PUNCTUATION}]+", ""))
    return F.lower(F.regexp_replace(text, f"[{LATIN_SPACES}{LATIN_PUNCTUATION}]+", ""))


def without_tags(text: Column) -> Column:
    """A recogniser's text without its <|tags|>, trimmed of white space."""
    return F.regexp_replace(F.regexp_replace(text, r"<\|[^|]*\|>", ""), f"^[{SPACES}]+|[{SPACES}]+$", "")


def digit_groups(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"\d+"), F.lit(0))


def digits(text: Column) -> Column:
    return F.array_join(digit_groups(text), "")


def skeleton(text: Column) -> Column:
    """A text without its digits."""
    return F.regexp_replace(text, r"\d+", "")


def error_rate(reference: Column, hypothesis: Column) -> Column:
    """Character error rate: edits by the reference's length, so it may exceed 1; for an empty reference 0 or 1."""
    empty = F.when(F.length(hypothesis) == 0, 0.0).otherwise(1.0)
    return F.when(F.length(reference) == 0, empty).otherwise(F.levenshtein(reference, hypothesis) / F.length(reference))


def error_kinds(reference: Column, hypothesis: Column, keywords=tuple(KEYWORDS)) -> Column:
    """What kinds of difference two unequal texts show: digits, each keyword that only one has, else other; empty for equal texts."""
    named = lambda x: F.coalesce(F.nullif(F.array_join(digit_groups(x), "/"), F.lit("")), F.lit(NO_DIGITS))
    found = [F.when(digit_groups(reference) != digit_groups(hypothesis), F.concat(F.lit(NUMBER_ERROR + "("), named(reference), F.lit(" -> "), named(hypothesis), F.lit(")")))]
    found += [F.when(reference.contains(k) != hypothesis.contains(k), F.lit(f"{WORD_ERROR}({k})")) for k in keywords]
    kinds = F.array_compact(F.array(*found))
    return F.when((F.size(kinds) == 0) & (reference != hypothesis), F.array(F.lit(OTHER_ERROR))).otherwise(kinds)


def escaped_cell(text: Column) -> Column:
    """A Markdown table cell."""
    return F.regexp_replace(F.replace(text, F.lit("|"), F.lit("\\|")), "\n", " ")


def clean_term(term: Column) -> Column:
    """A term with single spaces and without punctuation at its edges."""
    return F.btrim(F.regexp_replace(term, f"[{SPACES}]+", " "), F.lit(" ，,。；;、“”\"'"))


def canonical_voltage(value: Column) -> Column:
    return F.regexp_replace(F.btrim(value), f"[{SPACES}]*[kK][vV]$", "kV")


def sequence_number(key: Column, fallback: Column) -> Column:
    """A key as a number, else the fallback."""
    return F.coalesce(F.btrim(key).try_cast("int"), fallback)
