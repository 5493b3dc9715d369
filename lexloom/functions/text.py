"""Scalar text functions and predicates, Column in and Column out; Arrow functions only where Spark has none."""

from __future__ import annotations

import difflib
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

PREFIX = "correct: "
# Function words that are never kept as catalogue terms.
STOPWORDS = (
    "the a an and or but of in on at for to from by with as is are was were be been being "
    "this that these those it its they them their there here where when what who how why "
    "i you he she we me my your his her our us do does did done doing have has had having "
    "not no yes so very just only also more most many much some any all each every both few"
).split()
# Words dropped outright.
BLOCKLIST = "tuatera herbaceously antediluvian amanuensis petrichor obsequious sesquipedalian pulchritudinous ennui vicissitude lugubrious perspicacious recalcitrant aberdeen albania yorkshire".split()


def rng(seed: int, row_id: Column, slot: str | Column) -> Column:
    """A reproducible non-negative integer below 2**32 for a row and a purpose; the same in any engine that has MD5."""
    text = F.concat_ws("|", F.lit(str(seed)), row_id.cast("string"), slot if isinstance(slot, Column) else F.lit(slot))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint")


def rng_below(n: Column | int, seed: int, row_id: Column, slot: str | Column) -> Column:
    n = n if isinstance(n, Column) else F.lit(n)
    return (rng(seed, row_id, slot) % n.cast("bigint")).cast("int")


def let(value: Column, use) -> Column:
    """``use(value)`` with the value written, and computed, once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def pick(values: list[str], seed: int, row_id: Column, slot: str) -> Column:
    """One of a short list of values."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), rng_below(len(values), seed, row_id, slot) + 1)


def strip(c: Column) -> Column:
    """All leading and trailing white space, Unicode spaces too."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def norm(c: Column) -> Column:
    return F.lower(strip(F.coalesce(c, F.lit(""))))


def same_text(a: Column, b: Column) -> Column:
    return norm(a) == norm(b)


def changed(before: Column, after: Column) -> Column:
    """Whether a correction changed more than case and outer space."""
    return norm(after) != norm(before)


def tokens(c: Column) -> Column:
    """Tokens between white space; none for an empty text."""
    return F.filter(F.split(c, r"(?U)\s+"), lambda w: w != "")


def token_spans(c: Column) -> Column:
    """``array<struct<text, start, end>>``: tokens with half-open code-point offsets."""
    runs = F.regexp_extract_all(c, F.lit(r"(?U)(\S+|\s+)"), F.lit(1))
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<text:string,start:int,end:int>>").alias("out"))

    def step(acc: Column, r: Column) -> Column:
        end = acc["at"] + F.length(r)
        one = F.array(F.struct(r.alias("text"), acc["at"].alias("start"), end.alias("end")))
        return F.struct(end.alias("at"), F.when(r.rlike(r"(?U)^\s"), acc["out"]).otherwise(F.concat(acc["out"], one)).alias("out"))

    return F.aggregate(runs, zero, step)["out"]


def strip_edges(c: Column) -> Column:
    """``struct<core, lead, trail>``: a token without non-alphanumeric edges, and how many characters each edge had."""
    lead = F.length(F.regexp_extract(c, r"^[^\p{L}\p{N}]*", 0))
    trail = F.when(lead == F.length(c), F.lit(0)).otherwise(F.length(F.regexp_extract(c, r"[^\p{L}\p{N}]*$", 0)))
    return F.struct(F.substring(c, lead + 1, F.length(c) - lead - trail).alias("core"), lead.alias("lead"), trail.alias("trail"))


def is_ascii(c: Column) -> Column:
    return c.rlike(r"^[\x00-\x7F]*$")


def domain_plausible(c: Column) -> Column:
    """A word a shop query could hold: no function word, 3 to 18 characters, no odd runs of vowels or consonants."""
    w = F.lower(F.trim(c))
    shape = w.rlike(r"^[a-z][a-z0-9'\-]+$") & F.length(w).between(3, 18)
    runs = ~w.rlike("[aeiou]{4,}") & ~w.rlike("[bcdfghjklmnpqrstvwxz]{5,}")
    return F.coalesce(shape & runs & ~w.isin(STOPWORDS + BLOCKLIST), F.lit(False))


def valid_pair(wrong: Column, right: Column) -> Column:
    """A typo pair worth keeping: both sides filled, short, of plain characters, different and at most five edits apart."""
    a, b = norm(wrong), norm(right)

    def side(x: Column) -> Column:
        return (x != "") & (F.length(x) <= 50) & x.rlike(r"^[a-z0-9\s\-./'&+]+$")

    return side(a) & side(b) & (a != b) & F.levenshtein(a, b, 5).between(1, 5)


def edit_share(a: Column, b: Column) -> Column:
    return F.levenshtein(a, b) / F.greatest(F.length(a), F.length(b), F.lit(1))


def positional_difference(a: Column, b: Column) -> Column:
    """Positions that differ within the shorter text, and the difference of lengths."""
    letters = lambda c: F.filter(F.split(c, ""), lambda v: v != "")
    zipped = F.zip_with(letters(a), letters(b), lambda x, y: F.when(x.isNotNull() & y.isNotNull() & (x != y), 1).otherwise(0))
    return F.aggregate(zipped, F.lit(0), lambda s, x: s + x) + F.abs(F.length(a) - F.length(b))


def external_gate(wrong: Column, right: Column) -> Column:
    limit = F.greatest(F.lit(3), F.floor(F.length(right) / 3).cast("int"))
    return F.levenshtein(wrong, right) <= limit


def query_length_gate(c: Column, below: int = 60) -> Column:
    return (F.length(c) > 2) & (F.length(c) < below) & F.size(tokens(c)).between(2, 8)


# Where a product title turns to packaging.
PACKAGING = r"\s*\b(pack of|set of|\d+\s*(pack|count|pcs|pieces))\b.*$"


def clean_title(c: Column) -> Column:
    """A query-like text from a product title; NULL where none is left."""
    x = F.regexp_replace(F.regexp_replace(c, r"\([^)]*\)", " "), r"\[[^\]]*\]", " ")
    x = F.trim(F.regexp_replace(F.lower(x), r"\s+", " "))
    x = F.trim(F.regexp_replace(x, PACKAGING, ""))
    words = F.filter(F.split(x, " "), lambda w: w != "")
    out = F.array_join(F.slice(words, 1, 7), " ")
    return F.when(is_ascii(c) & F.size(words).between(2, 15) & F.length(out).between(5, 80), out)


def digit_runs(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(r"\d+"), F.lit(0))


def model_numbers(c: Column) -> Column:
    return F.filter(F.regexp_extract_all(c, F.lit(r"\b([A-Z]{1,5}-?\d{2,5}[A-Za-z]*)\b"), F.lit(1)), lambda m: F.length(m) >= 3)


def replace_first(c: Column, old: Column, new: Column) -> Column:
    """The first occurrence replaced, as plain text."""
    at = F.position(old, c)
    return F.when(at > 0, F.concat(F.substring(c, F.lit(1), at - 1), new, F.substring(c, at + F.length(old), F.length(c)))).otherwise(c)


def template(pattern: str, **values: Column) -> Column:
    """A template filled in; NULL where a value is missing."""
    out = F.lit(pattern)
    for k, v in values.items():
        out = F.replace(out, F.lit("{" + k + "}"), v)
    return F.when(~out.contains("{"), out)


def without_prefix(c: Column) -> Column:
    return F.regexp_replace(c, "^correct: ", "")


def is_identity(input_text: Column, target_text: Column) -> Column:
    """An identity example by its text."""
    return F.trim(without_prefix(input_text)) == F.trim(target_text)


def is_identity_label(category: Column) -> Column:
    """An identity example by its category."""
    return F.coalesce(category.contains("identity"), F.lit(False))


def byte_ids(c: Column, most: int = 128) -> Column:
    """Byte-level token ids, cut at ``most``: each UTF-8 byte plus three, then the end token."""
    text = F.hex(F.encode(c, "UTF-8"))
    n = F.least((F.length(text) / 2).cast("int"), F.lit(most - 1))
    at = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    ids = F.transform(at, lambda i: F.conv(F.substring(text, i * 2 + 1, F.lit(2)), 16, 10).cast("int") + 3)
    return F.concat(ids, F.array(F.lit(1)))


def is_truncated(c: Column, most: int = 128) -> Column:
    return F.octet_length(c) + 1 > most


@F.pandas_udf(T.DoubleType())
def similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    """Share of matching characters in the sense of longest matching blocks; Spark has no such function."""
    return pd.Series([None if x is None or y is None else difflib.SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b, strict=True)])


@F.pandas_udf(T.StringType())
def compatibility_form(c: pd.Series) -> pd.Series:
    """Compatibility-composed, lower-case text with single spaces; Spark has no Unicode normalisation."""
    return c.map(lambda s: None if s is None else " ".join(unicodedata.normalize("NFKC", s).lower().split()))


def preprocessed(c: Column) -> Column:
    """`compatibility_form`, without a Python worker for texts of plain ASCII."""
    plain = F.trim(F.regexp_replace(F.lower(c), r"[\s\x1c-\x1f]+", " "))
    return F.when(is_ascii(c), plain).otherwise(compatibility_form(c))


def confidence(before: Column, after: Column) -> Column:
    """1 for an unchanged text, 0.4 for a suspiciously small change, else the similarity; three decimals."""
    r = similarity(F.lower(before), F.lower(after))
    return F.when(before == after, 1.0).when(r > 0.95, 0.4).otherwise(F.bround(r, 3))


def suggestion(c: Column) -> Column:
    return F.concat(F.lit("Did you mean '"), c, F.lit("'?"))


def without_marks(c: Column) -> Column:
    return F.regexp_replace(c, r"\s", "")


def vocabulary_gate(c: Column, least: int, most: int | None = None) -> Column:
    """A word of letters alone, of a length in bounds."""
    return c.rlike("^[A-Za-z]+$") & (F.length(c) >= least) & (F.length(c) <= most if most else F.lit(True))


def padded(c: Column, width: int) -> Column:
    """A whole number with leading zeros."""
    return F.lpad(c.cast("string"), width, "0")


def thousands(c: Column) -> Column:
    return F.format_number(c, 0)


def percent(share: Column, decimals: int) -> Column:
    """A share as a percentage, rounded half up before it is written."""
    return F.format_string(f"%.{decimals}f%%", F.round(share * 100, decimals))
