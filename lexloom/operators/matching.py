"""Dictionary matching: exact spans by a join on substrings, fuzzy words by a join on deletes, overlaps by a fold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SPAN = "array<struct<start:int,end:int,canonical:string>>"


def alias_table(catalog: DataFrame, deny: DataFrame) -> DataFrame:
    """``alias, canonical``: lower-case aliases; denied names and aliases out, a shared alias goes to the longest name."""
    rows = catalog.select("canonical", F.explode("exact_aliases").alias("a")).select("canonical", F.lower("a").alias("alias")).filter("alias <> ''")
    denied = deny.select(F.lower("word").alias("word")).distinct()
    rows = rows.join(denied, rows["alias"] == denied["word"], "left_anti").withColumn("low", F.lower("canonical"))
    rows = rows.join(denied, rows["low"] == denied["word"], "left_anti").drop("low")
    w = Window.partitionBy("alias").orderBy(F.desc(F.length("canonical")), "canonical")
    return rows.withColumn("r", F.row_number().over(w)).filter("r = 1").select("alias", "canonical")


def boundaries(text: Column) -> Column:
    """``array<struct<text, start, end>>`` of the runs of word and of other characters."""
    runs = F.regexp_extract_all(text, F.lit(r"([\p{L}\p{N}]+|[^\p{L}\p{N}]+)"), F.lit(1))
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<word:boolean,start:int,end:int>>").alias("out"))

    def step(acc: Column, r: Column) -> Column:
        end = acc["at"] + F.length(r)
        run = F.struct(r.rlike(r"^[\p{L}\p{N}]").alias("word"), acc["at"].alias("start"), end.alias("end"))
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(run)).alias("out"))

    return F.aggregate(runs, zero, step)["out"]


def exact_spans(texts: DataFrame, aliases: DataFrame, id_col: str, text_col: str, longest: int) -> DataFrame:
    """``id, start, end, canonical, matched_text``: every alias that stands in a text between word boundaries.

    Candidates are substrings between boundaries, no longer than the longest alias; an alias may also begin or end
    inside a run of other characters. They meet the aliases in a hash join, so nothing is compared pairwise.
    """
    t = texts.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).filter(F.col("text").isNotNull())
    t = t.withColumn("runs", boundaries(F.col("text")))
    other = F.filter("runs", lambda r: ~r["word"])
    inside = F.flatten(F.transform(other, lambda r: F.sequence(r["start"], r["end"])))
    starts = F.array_distinct(F.concat(F.transform(F.filter("runs", lambda r: r["word"]), lambda r: r["start"]), inside))
    ends = F.array_distinct(F.concat(F.transform(F.filter("runs", lambda r: r["word"]), lambda r: r["end"]), inside))
    spans = F.flatten(F.transform(starts, lambda s: F.transform(F.filter(ends, lambda e: (e > s) & (e - s <= longest)), lambda e: F.struct(s.alias("start"), e.alias("end")))))
    cand = t.select("id", "text", F.explode(spans).alias("s")).select("id", "s.start", "s.end", F.substring("text", F.col("s.start") + 1, F.col("s.end") - F.col("s.start")).alias("matched_text"))
    return cand.join(aliases, F.lower("matched_text") == F.col("alias")).select("id", "start", "end", "canonical", "matched_text")


def resolve(spans: Column) -> Column:
    """Longest first, then leftmost, without overlap; the result in order of start."""
    by_length = F.array_sort(
        spans,
        lambda a, b: F.when(a["end"] - a["start"] > b["end"] - b["start"], -1).when(a["end"] - a["start"] < b["end"] - b["start"], 1).when(a["start"] < b["start"], -1).when(a["start"] > b["start"], 1).otherwise(0),
    )
    kept = F.aggregate(
        by_length, F.array().cast(SPAN),
        lambda acc, s: F.when(F.exists(acc, lambda k: (k["start"] < s["end"]) & (s["start"] < k["end"])), acc).otherwise(F.concat(acc, F.array(s))),
    )
    return F.array_sort(kept, lambda a, b: F.when(a["start"] < b["start"], -1).when(a["start"] > b["start"], 1).otherwise(0))


def resolved_spans(spans: DataFrame) -> DataFrame:
    """``id, spans``: the non-overlapping spans of each text; a text's spans are bounded by its length."""
    return spans.groupBy("id").agg(F.collect_list(F.struct("start", "end", "canonical")).alias("all")).select("id", resolve(F.col("all")).alias("spans"))


def deletes(w: Column) -> Column:
    """A word and the word without each one letter."""
    n = F.length(w)
    cut = F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.concat(F.substring(w, F.lit(1), i - 1), F.substring(w, i + 1, n)))
    return F.array_distinct(F.concat(F.array(w), cut))


def within_one_edit(a: Column, b: Column) -> Column:
    """One letter wrong, missing or extra, or two neighbours exchanged; equal words too."""
    n = F.length(a)
    swapped = F.exists(
        F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))),
        lambda i: F.concat(F.substring(a, F.lit(1), i - 1), F.substring(a, i + 1, F.lit(1)), F.substring(a, i, F.lit(1)), F.substring(a, i + 2, n)) == b,
    )
    return F.levenshtein(a, b, 1).between(0, 1) | ((n == F.length(b)) & (n >= 2) & swapped)


def fuzzy_join(words: DataFrame, word: str, dictionary: DataFrame, key: str) -> DataFrame:
    """``word, key, distance`` of distinct words within one edit, by a hash join on what is left without one letter."""
    a = words.select(F.col(word).alias("word")).distinct().withColumn("d", F.explode(deletes(F.col("word"))))
    b = dictionary.select(F.col(key).alias("key")).distinct().withColumn("d", F.explode(deletes(F.col("key"))))
    pairs = a.join(b, "d").select("word", "key").distinct()
    return pairs.filter(within_one_edit(F.col("word"), F.col("key"))).withColumn("distance", F.when(F.col("word") == F.col("key"), 0).otherwise(1))


def fuzzy_keys(catalog: DataFrame, deny: DataFrame) -> DataFrame:
    """``key, canonical, min_match_length``: names that may be matched with an error; the first of equal keys wins."""
    rows = catalog.filter("symspell_eligible").withColumn("key", F.lower("canonical")).filter(F.col("key").rlike(r"^[\p{L} ]+$"))
    rows = rows.join(deny.select(F.lower("word").alias("key")).distinct(), "key", "left_anti")
    w = Window.partitionBy("key").orderBy("canonical")
    return rows.withColumn("r", F.row_number().over(w)).filter("r = 1").select("key", "canonical", "min_match_length")


def fuzzy_match(words: DataFrame, word: str, keys: DataFrame, deny: DataFrame, english: DataFrame) -> DataFrame:
    """``word, canonical, distance``: the guards first, then the join; an equal word is no fuzzy match."""
    w = words.select(F.lower(F.col(word)).alias("word")).distinct().filter(F.col("word").rlike(r"^\p{L}{4,}$"))
    w = w.join(deny.select(F.lower("word").alias("word")), "word", "left_anti").join(english.select(F.lower("word").alias("word")), "word", "left_anti")
    m = fuzzy_join(w, "word", keys, "key").join(keys, "key")
    ratio = F.length("word") / F.length("key")
    ok = (F.col("distance") == 1) & ratio.between(0.6, 1.6) & (F.length("word") >= F.col("min_match_length"))
    best = Window.partitionBy("word").orderBy("distance", "key")
    return m.filter(ok).withColumn("r", F.row_number().over(best)).filter("r = 1").select("word", "canonical", "distance")
