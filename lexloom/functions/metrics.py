"""Text metrics: row expressions, and the corpus aggregates over them. Five definitions of accuracy and error, by name."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lexloom.functions.text import let, tokens


def positional_matches(a: Column, b: Column) -> Column:
    hit = F.zip_with(tokens(a), tokens(b), lambda x, y: F.when(x.isNotNull() & y.isNotNull() & (x == y), 1).otherwise(0))
    return F.aggregate(hit, F.lit(0), lambda s, x: s + x)


def token_max(a: Column, b: Column) -> Column:
    return F.greatest(F.size(tokens(a)), F.size(tokens(b)))


def jaccard(a: Column, b: Column) -> Column:
    x, y = F.array_distinct(tokens(a)), F.array_distinct(tokens(b))
    both, either = F.size(F.array_intersect(x, y)), F.size(F.array_union(x, y))
    return F.when(either == 0, 1.0).otherwise(both / either)


def word_f1(a: Column, b: Column) -> Column:
    """F1 of the words counted as often as they occur; 0 where nothing is shared or a side is empty."""

    def times(words: Column, w: Column) -> Column:
        return F.size(F.filter(words, lambda v: v == w))

    def of(x: Column, y: Column) -> Column:
        shared = F.aggregate(F.array_distinct(x), F.lit(0), lambda s, w: s + F.least(times(x, w), times(y, w)))
        # 2pr / (p + r) with p and r the shares of either side
        return F.when(F.size(x) + F.size(y) == 0, 0.0).otherwise(2 * shared / (F.size(x) + F.size(y)))

    # both token lists are made once
    return let(tokens(a), lambda x: let(tokens(b), lambda y: of(x, y)))


def character_positions(a: Column, b: Column) -> Column:
    """Characters that differ position by position, plus the difference of lengths."""
    x = F.filter(F.split(a, ""), lambda v: v != "")
    y = F.filter(F.split(b, ""), lambda v: v != "")
    diff = F.zip_with(x, y, lambda u, v: F.when(u.isNotNull() & v.isNotNull() & (u != v), 1).otherwise(0))
    return F.aggregate(diff, F.lit(0), lambda s, v: s + v) + F.abs(F.size(x) - F.size(y))


def sentence_accuracy(a: Column, b: Column) -> Column:
    return F.coalesce(F.avg((a == b).cast("double")), F.lit(0.0))


def average_edits(a: Column, b: Column) -> Column:
    return F.coalesce(F.avg(F.levenshtein(a, b).cast("double")), F.lit(0.0))


def _ratio(up: Column, down: Column) -> Column:
    return F.when(F.sum(down) > 0, F.sum(up) / F.sum(down)).otherwise(F.lit(0.0))


def token_accuracy_max(a: Column, b: Column) -> Column:
    return _ratio(positional_matches(a, b), token_max(a, b))


def token_accuracy_label(a: Column, b: Column) -> Column:
    return _ratio(positional_matches(a, b), F.size(tokens(b)))


def mean_jaccard(a: Column, b: Column) -> Column:
    return F.coalesce(F.avg(jaccard(a, b)), F.lit(0.0))


def mean_word_f1(a: Column, b: Column) -> Column:
    return F.coalesce(F.avg(word_f1(a, b)), F.lit(0.0))


def cer_macro(a: Column, b: Column) -> Column:
    return F.coalesce(F.avg(F.levenshtein(a, b) / F.greatest(F.lit(1), F.length(b))), F.lit(0.0))


def cer_micro(a: Column, b: Column) -> Column:
    return _ratio(F.levenshtein(a, b), F.greatest(F.length(b), F.lit(1)))


def cer_positional(a: Column, b: Column) -> Column:
    """Counts shifted text as wrong throughout; kept because published numbers were made with it."""
    return _ratio(character_positions(a, b), F.greatest(F.length(b), F.lit(1)))


def exact_match(a: Column, b: Column) -> Column:
    return F.coalesce(F.avg((F.lower(F.trim(a)) == F.lower(F.trim(b))).cast("double")), F.lit(0.0))
