"""Visually identical text with different characters (problem 6), and the word folding the other problems share.

Everything runs as SQL expressions. A value is first *mapped*: characters nobody sees go, odd spaces become the plain
one, full-width and joined forms become the letters they show, accents join their letter, and letters of another
script standing inside a Latin word become the Latin ones. The mapped values are then grouped under an accent-sensitive
Unicode collation, each class gets one deterministic member, and that member is joined back to every row.
"""

from __future__ import annotations

import json
import re
import sys
import unicodedata
from functools import cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexloom.functions.text import let
from lexloom.operators.skew import join_back
from lexloom.session import cut

# Letters of other scripts or alphabets that are drawn like a Latin letter.
LOOKALIKE = {
    # Cyrillic
    "а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "һ": "h", "і": "i", "ј": "j", "к": "k", "ӏ": "l", "м": "m",
    "о": "o", "р": "p", "ԛ": "q", "г": "r", "ѕ": "s", "т": "t", "ѵ": "v", "ԝ": "w", "х": "x", "у": "y", "п": "n",
    "А": "A", "В": "B", "С": "C", "Е": "E", "Н": "H", "І": "I", "Ј": "J", "К": "K", "Ӏ": "I", "М": "M", "О": "O",
    "Р": "P", "Ԛ": "Q", "Ѕ": "S", "Т": "T", "Ѵ": "V", "Ԝ": "W", "Х": "X", "У": "Y", "Ԁ": "D", "Һ": "H", "ё": "ë",
    "Ё": "Ë", "ї": "ï", "Ї": "Ï",
    # Greek
    "α": "a", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x",
    "γ": "y", "ω": "w", "ϲ": "c", "ϳ": "j", "σ": "o", "β": "b", "μ": "u", "ζ": "z",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P",
    "Τ": "T", "Υ": "Y", "Χ": "X", "Ϲ": "C", "Ϳ": "J",
    # Armenian and Cherokee
    "օ": "o", "ս": "u", "հ": "h", "ո": "n", "ց": "g", "Ꭺ": "A", "Ꭼ": "E", "Ꮋ": "H", "Ꮮ": "L", "Ꮲ": "P", "Ꭲ": "T",
}
# Letters of a phonetic or small-capital alphabet; Latin to Unicode, so they count in any word.
PHONETIC = {"ɡ": "g", "ɑ": "a", "ı": "i", "ɩ": "i", "ʏ": "y", "ᴄ": "c", "ᴏ": "o", "ᴠ": "v", "ᴡ": "w", "ᴢ": "z", "ꜱ": "s"}
# Joined letter forms.
JOINED = {"ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "ﬅ": "st", "ﬆ": "st", "ĳ": "ij", "Ĳ": "IJ", "ǉ": "lj", "ǌ": "nj", "ǆ": "dž", "ǳ": "dz"}

INVISIBLE = (
    "\\u00ad\\u034f\\u061c\\u115f\\u1160\\u17b4\\u17b5\\u180b-\\u180e\\u200b-\\u200f\\u202a-\\u202e\\u2060-\\u2064\\u2066-\\u206f"
    "\\ufe00-\\ufe0f\\ufeff\\ufff9-\\ufffb\\u0001-\\u0008\\u000e-\\u001f\\u007f"
)
ODD_SPACE = "\\u00a0\\u1680\\u2000-\\u200a\\u202f\\u205f\\u3000\\u0085\\u2028\\u2029"
OTHER_SCRIPT = r"\p{IsCyrillic}\p{IsGreek}\p{IsArmenian}\p{IsCherokee}"
#: The collation of the classes: accents and case count, as both can be seen.
COLLATION = "UNICODE"


@cache
def fullwidth_table() -> tuple[str, str]:
    """The full-width block, by rule: each stands 0xFEE0 above its plain form."""
    return "".join(chr(c + 0xFEE0) for c in range(0x21, 0x7F)), "".join(chr(c) for c in range(0x21, 0x7F))


@cache
def composition_table() -> dict[str, str]:
    """Letter-and-marks sequence to the one character that shows the same, by rule from the Unicode data."""
    out = {}
    for cp in range(0xC0, min(sys.maxunicode, 0xFFFF)):
        if 0xAC00 <= cp <= 0xD7A3 or 0xD800 <= cp <= 0xDFFF:
            continue
        c = chr(cp)
        d = unicodedata.normalize("NFD", c)
        if len(d) > 1 and unicodedata.normalize("NFC", d) == c and all(unicodedata.combining(x) for x in d[1:]):
            out[d] = c
    return out


def _map_literal(d: dict[str, str]) -> Column:
    return F.from_json(F.lit(json.dumps(d)), "map<string,string>")


def _compose(c: Column) -> Column:
    """NFC for a letter followed by its marks; a cluster without a composed form stays."""
    table = _map_literal(composition_table())
    clusters = F.regexp_extract_all(c, F.lit(r"(?s)(\P{M}\p{M}*|^\p{M}+)"), F.lit(1))
    joined = F.array_join(
        F.transform(clusters, lambda x: F.when(F.length(x) > 1, F.coalesce(F.element_at(table, x), x)).otherwise(x)), ""
    )
    return F.when(c.rlike(r"\p{M}"), joined).otherwise(c)


def _translate(c: Column, table: dict[str, str]) -> Column:
    return F.translate(c, "".join(table), "".join(table.values()))


def _join_letters(c: Column) -> Column:
    out = c
    for k, v in JOINED.items():
        out = F.replace(out, F.lit(k), F.lit(v))
    return F.when(c.rlike("[" + "".join(JOINED) + "]"), out).otherwise(c)


def _latin_inside(c: Column) -> Column:
    """Letters of another script become Latin, but only in words that also hold a Latin letter."""
    parts = F.regexp_extract_all(c, F.lit(r"(?s)([\p{L}\p{M}\p{N}]+|[^\p{L}\p{M}\p{N}]+)"), F.lit(1))
    mixed = F.transform(parts, lambda w: F.when(w.rlike(r"\p{IsLatin}") & w.rlike(f"[{OTHER_SCRIPT}]"), _translate(w, LOOKALIKE)).otherwise(w))
    return F.when(c.rlike(f"[{OTHER_SCRIPT}]") & c.rlike(r"\p{IsLatin}"), F.array_join(mixed, "")).otherwise(c)


def mapped_text(c: Column) -> Column:
    """The look-alike-mapped form of a value; case, plain spaces and spelling stay as they are. NULL stays NULL.

    Values of plain ASCII, nearly all of them, pass with one pattern test.
    """
    x = F.regexp_replace(F.regexp_replace(c, f"[{INVISIBLE}]", ""), f"[{ODD_SPACE}]", " ")
    # each step is bound once: written out, the steps would be repeated inside one another
    odd = let(F.translate(x, *fullwidth_table()), lambda a: let(_translate(_join_letters(a), PHONETIC), lambda b: let(_compose(b), _latin_inside)))
    return F.when(c.rlike(r"[^\x09\x0a\x0d\x20-\x7e]"), odd).otherwise(c)


def words_of(c: Column) -> Column:
    """The words of a value as they are compared: look-alikes mapped, lower case, no spacing, no punctuation."""
    return F.array_remove(F.split(F.lower(mapped_text(c)), r"[^\p{L}\p{M}\p{N}]+"), "")


def canonical_classes(mapped: DataFrame) -> DataFrame:
    """``class_key, canonical, class_rows`` of the mapped values, one row a class.

    Classes are the mapped values equal under the accent-sensitive collation ``UNICODE``; the member chosen is the
    smallest by code point, so every run picks the same. Rows are counted
    per distinct form before anything is grouped by collation, so a value that holds a third of all rows reaches that
    step as one row. NULL values form no class and are left out; the empty string is its own class.
    """
    forms = mapped.filter(F.col("mapped").isNotNull()).groupBy("mapped").agg(F.count(F.lit(1)).alias("n"))
    # the forms are distinct already: placed first, they are sorted and grouped in one step
    placed = forms.withColumn("class_key", F.collate("mapped", COLLATION)).repartition("class_key")
    return mapped.sparkSession.sql("select class_key, sum(n) as class_rows, min(mapped) as canonical from {forms} group by class_key", forms=placed)


def one_space(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, " {2,}", " "))


def consistent_form(df: DataFrame, id_col: str, text_col: str, only_odd: bool = False) -> DataFrame:
    """Every row's text in one consistent form: ``id, value, mapped, odd, canonical, class_rows``.

    ``odd`` is true where the stored text holds characters that only look right, that is, where mapping changes it.
    Classes are always made of all rows; ``only_odd`` joins them back to the odd rows alone. NULL text: mapped,
    canonical and class_rows are NULL and odd is false. Repeated rows and ids give one row each. Other columns of
    ``df`` are ignored, whatever their names.
    """
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("value"), mapped_text(F.col(text_col)).alias("mapped"))
    rows = rows.select("id", "value", one_space(F.col("mapped")).alias("mapped"), F.coalesce(F.col("mapped") != F.col("value"), F.lit(False)).alias("odd"))
    classes = cut(canonical_classes(rows))
    rows = rows.withColumn("class_key", F.collate("mapped", COLLATION))
    return join_back(rows.filter("odd") if only_odd else rows, classes, "class_key", "class_rows", df.count(), ["canonical", "class_rows"]).drop("class_key")


def odd_text(c: Column) -> Column:
    """True where a value holds characters that only look right."""
    return F.coalesce(mapped_text(c) != c, F.lit(False))


@cache
def _python_tables():
    fw = dict(zip(*fullwidth_table(), strict=True))
    return str.maketrans(fw | PHONETIC | JOINED), str.maketrans(LOOKALIKE), re.compile(f"[{INVISIBLE}]"), re.compile(f"[{ODD_SPACE}]")


def fold_python(s: str) -> str:
    """`mapped_text` for Python workers, and further: lower case and accents dropped."""
    if not s.isascii():
        plain, latin, gone, space = _python_tables()
        s = unicodedata.normalize("NFC", space.sub(" ", gone.sub("", s)).translate(plain))
        if not s.isascii():
            s = re.sub(r"\w+", lambda m: m[0].translate(latin) if re.search("[A-Za-zÀ-ÿ]", m[0]) else m[0], s)
            s = "".join(c for c in unicodedata.normalize("NFD", s) if not unicodedata.combining(c))
    return s.lower()
