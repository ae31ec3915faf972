"""Printed note markers and numerals, as native columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import heading_stripped

#: Circled numbers 1 to 20, 21 to 35 and 36 to 50 lie in three ranges.
CIRCLED = "".join(chr(c) for lo, n in ((0x2460, 20), (0x3251, 15), (0x32B1, 15)) for c in range(lo, lo + n))
#: Superscript digits, and what they stand for.
SUPERSCRIPTS, DIGITS = "⁰¹²³⁴⁵⁶⁷⁸⁹", "0123456789"
ROMAN = r"m{0,3}(?:cm|cd|d?c{0,3})(?:xc|xl|l?x{0,3})(?:ix|iv|v?i{0,3})"


def roman_value(c: Column) -> Column:
    """Value of a Roman numeral in canonical form, 1 to 3999; null for others."""
    low = F.lower(F.trim(c))
    ones = F.create_map(*[F.lit(x) for kv in {"i": 1, "v": 5, "x": 10, "l": 50, "c": 100, "d": 500, "m": 1000}.items() for x in kv])
    values = F.transform(F.split(low, ""), lambda ch: F.element_at(ones, ch))
    signed = F.transform(values, lambda v, i: F.when(F.get(values, i + 1) > v, -v).otherwise(v))
    return F.when(low.rlike(f"^(?=.){ROMAN}$"), F.aggregate(F.filter(signed, lambda x: x.isNotNull()), F.lit(0), lambda a, x: a + x))


def numeral_label(c: Column) -> Column:
    """The number on a line that holds nothing else: Arabic, Roman or Chinese; else null."""
    text = F.trim(heading_stripped(c))
    page = F.regexp_extract(text, r"(?i)^(?:pdf\s+)?page\s*[:#-]?\s*(\d{1,5}|[ivxlcdm]{1,12})$", 1)
    bare = F.regexp_replace(text, r"^[ \t()（）\[\]【】、.．:：—–-]+|[ \t()（）\[\]【】、.．:：—–-]+$", "")
    number = bare.rlike(f"^(?:[0-9]{{1,5}}|[一二三四五六七八九十百千万零〇]+|[壹贰叁肆伍陆柒捌玖拾佰仟]+)$|(?i)^(?=.){ROMAN}$")
    return F.when(page != "", page).when(number, bare)


def numeric_label(c: Column) -> Column:
    """ASCII digits of a label of at most 4 digits, superscript or not; else null."""
    digits = F.translate(F.trim(F.coalesce(c, F.lit(""))), SUPERSCRIPTS, DIGITS)
    return F.when(digits.rlike(r"^[0-9]{1,4}$"), digits)


def marker(c: Column) -> Column:
    """(kind, label, key) of a printed marker; null if it isn't one."""
    v = F.trim(F.coalesce(c, F.lit("")))
    circled = F.when(F.char_length(v) == 1, F.instr(F.lit(CIRCLED), v))
    number = numeric_label(v)
    plain = F.create_map(*[F.lit(x) for kv in {"†": "fnm-dagger", "††": "fnm-dagger-2", "‡": "fnm-double-dagger", "‡‡": "fnm-double-dagger-2"}.items() for x in kv])

    def one(kind: str, key: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), v.alias("label"), key.alias("key"))

    return (
        F.when(circled > 0, one("numeric", circled.cast("string")))
        .when(number.isNotNull(), one("numeric", number))
        .when(v.rlike(r"^\*{1,4}$"), one("star", F.concat(F.lit("fnm-star-"), F.char_length(v).cast("string"))))
        .when(v.isin("†", "††"), one("dagger", F.element_at(plain, v)))
        .when(v.isin("‡", "‡‡"), one("double_dagger", F.element_at(plain, v)))
        .when(v.rlike(r"^[A-Za-z]$"), one("letter", F.concat(F.lit("fnm-letter-"), v)))
    )


def marker_label(key: Column) -> Column:
    """Printed label of a reserved key, repeats included; null for others."""
    v = F.regexp_replace(F.coalesce(key, F.lit("")), r"-o(?:[2-9]|[1-9][0-9]+)$", "")
    number = lambda p: F.regexp_extract(v, p, 1)
    circle, digits, stars, letter = number(r"^fnm-circle-([0-9]{1,2})$"), number(r"^fnm-number-([0-9]{1,4})$"), number(r"^fnm-star-([1-4])$"), number(r"^fnm-letter-([A-Za-z])$")
    plain = F.create_map(*[F.lit(x) for kv in {"fnm-dagger": "†", "fnm-dagger-2": "††", "fnm-double-dagger": "‡", "fnm-double-dagger-2": "‡‡"}.items() for x in kv])
    return (
        F.when(circle != "", F.when(circle.cast("int").between(1, len(CIRCLED)), F.substring(F.lit(CIRCLED), circle.cast("int"), F.lit(1))))
        .when(digits != "", digits)
        .when(stars != "", F.repeat(F.lit("*"), stars.cast("int")))
        .when(letter != "", letter)
        .otherwise(F.element_at(plain, v))
    )


def output_key(key: Column, label: Column, occurrence: Column) -> Column:
    """Key to write for the n-th occurrence of a marker."""
    circled = F.when(F.char_length(label) == 1, F.instr(F.lit(CIRCLED), label)).otherwise(0)
    base = F.when(circled > 0, F.concat(F.lit("fnm-circle-"), circled.cast("string"))).otherwise(key)
    again = F.concat(F.lit("-o"), occurrence.cast("string"))
    return (
        F.when(occurrence <= 1, base)
        .when(circled > 0, F.concat(base, again))
        .when(key.rlike(r"^[0-9]{1,4}$"), F.concat(F.lit("fnm-number-"), key, again))
        .when(marker_label(key).isNotNull(), F.concat(base, again))
        .otherwise(F.concat(base, F.lit("-"), occurrence.cast("string")))
    )


def leading_marker(c: Column) -> Column:
    """Marker at the start of a note's text, by the first pattern that fits: superscript,
    ``[^k]:``, bracketed or dotted number, symbol, circled number."""
    patterns = (
        r"^\s*<sup>\s*([^<\s]{1,4})\s*</sup>", r"^\s*\[\^([0-9]{1,4})\]:?", r"^\s*\[([0-9]{1,4})\]", r"^\s*([0-9]{1,4})[.)]\s", rf"^\s*([{SUPERSCRIPTS}]{{1,4}})",
        r"^\s*(\*{1,4}|††?|‡‡?)", rf"^\s*([{CIRCLED}])", r"^\s*([0-9]{1,4})\s+(?=\p{Lu})",
    )
    return F.coalesce(*[F.when(F.regexp_extract(c, p, 1) != "", marker(F.regexp_extract(c, p, 1))) for p in patterns])


def numbers(c: Column) -> Column:
    """Numbers of a text in order, with their inner separators."""
    return F.regexp_extract_all(c, F.lit(r"([0-9]+(?:[./:-][0-9]+)*)"), F.lit(1))
