"""Text as columns: normal form, numbers, wrapped labels and numbers."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space of any script, spelled out: Unicode character classes are several times slower.
SPACES = r"[\s\u0085   -     　]"
#: Radicals that stand for characters, and full-width digits and letters; Spark has no compatibility form, so they are translated.
RADICALS = [chr(c) for c in range(0x2F00, 0x2FD6)]
WIDE = [chr(c) for c in (*range(0xFF10, 0xFF1A), *range(0xFF21, 0xFF3B), *range(0xFF41, 0xFF5B))]
FROM = "".join(RADICALS + WIDE) + "（）：％"
TO = "".join(unicodedata.normalize("NFKC", c) for c in RADICALS + WIDE) + "():%"
SIGNED = r"[+-]?\d[\d,]*(?:\.\d+)?"


def normal_text(x: Column) -> Column:
    """NUL out, white space of any script to one space, radicals and full-width digits, letters and brackets to plain ones."""
    plain = F.regexp_replace(F.replace(x, F.lit("\x00"), F.lit("")), f"{SPACES}+", " ")
    # translation goes character by character, so it is left to texts that need it
    return F.when(plain.rlike("[\u2f00-\u2fd5\uff10-\uff19\uff21-\uff3a\uff41-\uff5a（）：％]"), F.translate(plain, FROM, TO)).otherwise(plain)


def number(x: Column) -> Column:
    """Digits with thousands commas, sign and decimals, as a double, also in scientific form (1.2×10^5, 1.2E5); null otherwise."""
    plain = F.regexp_replace(F.regexp_replace(x, r"[,\s]", ""), r"(?i)[×x*]10\^?([+-]?\d+)$", "E$1")
    return plain.try_cast("double")


def joined_numbers(x: Column) -> Column:
    """Numbers broken at a thousands comma or a decimal point by white space or a line break, in one piece again."""
    return F.regexp_replace(F.regexp_replace(x, rf"(\d,){SPACES}+(?=\d{{3}}(?!\d))", "$1"), rf"(\d\.){SPACES}+(?=\d)", "$1")


def joined_labels(x: Column) -> Column:
    """Chinese words that a line break splits, in one piece again."""
    return F.regexp_replace(x, r"(?<=[一-鿿])[ \t]*\n[ \t]*(?=[一-鿿])", "")
