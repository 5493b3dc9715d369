"""Correction around a pluggable model: route, gate on confidence, merge, validate, build the response."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexloom.functions.text import changed, confidence, digit_runs, norm, preprocessed, similarity, suggestion, tokens

Model = Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]
_MODELS: dict[str, Model] = {}
DEFAULT_MODEL = "dictionary"


def register_model(name: str, model: Model) -> None:
    """A model takes and gives batches of ``id, text``; it is loaded once in each Python worker, on its first batch."""
    _MODELS[name] = model


def list_models() -> list[str]:
    return sorted({DEFAULT_MODEL, *_MODELS})


def resolve_model(name: Column, models: list[str] | None = None) -> Column:
    """A registered name, or one of ``models``; the default for an unknown or missing one."""
    return F.when(name.isin(list_models() if models is None else models), name).otherwise(F.lit(DEFAULT_MODEL))


def dictionary_model(df: DataFrame, mappings: DataFrame) -> DataFrame:
    """``corrected`` added to ``id, text``: each token looked up among typo mappings (``wrong, right``), by a join.

    Repeated mappings of one word: the first right word by name. Tokens keep their order; NULL texts stay NULL.
    """
    m = mappings.groupBy(F.lower("wrong").alias("wrong")).agg(F.min("right").alias("right"))
    t = df.select("id", F.posexplode(tokens(F.col("text"))).alias("i", "t")).withColumn("low", F.lower("t"))
    done = t.join(m, t["low"] == m["wrong"], "left").select("id", "i", F.coalesce("right", "t").alias("t"))
    text = done.groupBy("id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "t"))), lambda s: s["t"]), " ").alias("corrected"))
    return df.join(text, "id", "left").withColumn("corrected", F.coalesce("corrected", "text"))


def run_model(df: DataFrame, name: str) -> DataFrame:
    """``corrected`` from a registered model; only id and text travel to the workers."""
    out = df.select("id", "text").mapInPandas(_MODELS[name], f"id {dict(df.dtypes)['id']}, text string").withColumnRenamed("text", "corrected")
    return df.join(out, "id", "left")


def skips_masking(model: Column, healthy: bool) -> Column:
    return F.lit(not healthy) | F.coalesce(model.contains("v2.1"), F.lit(False))


def confident(before: Column, after: Column) -> Column:
    """Changed, similar enough, and about as many words."""
    a, b = norm(before), norm(after)
    return (a != b) & (similarity(a, b) >= 0.5) & (F.abs(F.size(tokens(a)) - F.size(tokens(b))) <= 1)


def merge_fallback(output: Column, original: Column, corrections: Column) -> Column:
    """The output's tokens; at a position whose original token has an automatic correction, that one.

    ``corrections`` is ``array<struct<original, corrected, action>>``.
    """
    used = F.filter(corrections, lambda c: c["action"] == "auto_correct")
    words = tokens(original)

    def at(t: Column, i: Column) -> Column:
        hit = F.try_element_at(F.filter(used, lambda c: F.lower(c["original"]) == F.lower(F.get(words, i))), F.lit(-1))
        return F.coalesce(hit["corrected"], t)

    return F.when(F.size(used) == 0, output).otherwise(F.array_join(F.transform(tokens(output), at), " "))


def postprocess(original: Column, output: Column, protected: Column) -> Column:
    """The output if it passes: words, protected positions, length and numbers, in this order; else the original."""
    a, b = tokens(original), tokens(output)
    kept = F.array_join(F.transform(b, lambda t, i: F.when(F.array_contains(protected, F.lower(F.get(a, i))), F.get(a, i)).otherwise(t)), " ")
    numbers = F.array_sort(digit_runs(original)) == F.array_sort(digit_runs(kept))
    bad = (F.abs(F.size(a) - F.size(b)) > 1) | (F.length(kept) > F.length(original) * 1.3) | ~numbers
    return F.when(bad, original).otherwise(kept)


def source_label(first: Column, second: Column) -> Column:
    """Which stages a response came from."""
    return F.when(second, F.lit("model+fallback")).when(first, F.lit("model")).otherwise(F.lit("none"))


def response(df: DataFrame, before: str, after: str, source: str, latency: str, suggestions: str) -> DataFrame:
    """The response columns of the four stages: where the correction came from, how sure it is, how long it took, and the
    fallback's suggestions (an array of texts, NULL for none). Unchanged texts are sure; else the similarity counts."""
    a, b = F.col(before), F.col(after)
    likeness = F.bround(similarity(F.lower(a), F.lower(b)), 3)
    return df.select(
        "id", a.alias("original_query"), b.alias("corrected_query"), changed(a, b).alias("changed"), F.col(source).alias("correction_source"),
        F.when(changed(a, b), likeness).otherwise(F.lit(1.0)).alias("confidence"), F.round(latency, 2).alias("latency_ms"),
        F.transform(F.coalesce(suggestions, F.array().cast("array<string>")), suggestion).alias("suggestions"),
    )


def response_v2(df: DataFrame, before: str, after: str, model: str) -> DataFrame:
    """The response columns of one model: changed, its careful confidence and the output as a suggestion."""
    a, b = F.col(before), F.col(after)
    return df.select(
        "id", a.alias("original_query"), b.alias("corrected_query"), changed(a, b).alias("changed"), F.col(model).alias("model_used"),
        F.when(changed(a, b), confidence(a, b)).otherwise(F.lit(1.0)).alias("confidence"),
        F.when(changed(a, b), F.array(suggestion(b))).otherwise(F.array().cast("array<string>")).alias("suggestions"),
    )


def four_stages(df: DataFrame, mappings: DataFrame, fallback: DataFrame, protected: Column) -> DataFrame:
    """``id, text, corrected, source``: preprocess, model, and only where it is not confident the fallback, then validate.

    Blank texts come back as they are. The fallback runs on the rows that need it and on no others.
    """
    t = df.select("id", F.col("text").alias("raw"), preprocessed(F.col("text")).alias("text"))
    blank = t.filter(F.coalesce(F.trim("raw"), F.lit("")) == "").select("id", "raw", F.col("raw").alias("corrected"), F.lit("none").alias("source"))
    first = dictionary_model(t.filter(F.trim("raw") != ""), mappings).withColumn("sure", confident(F.col("text"), F.col("corrected")))
    sure = first.filter("sure").select("id", "raw", postprocess(F.col("text"), F.col("corrected"), protected).alias("corrected"), F.lit("model").alias("source"))
    rest = first.filter(~F.col("sure")).select("id", "raw", "text", F.col("corrected").alias("m"))
    second = dictionary_model(rest.select("id", "raw", "m", "text"), fallback)
    merged = F.when(F.col("corrected") != F.col("text"), F.col("corrected")).otherwise(F.col("m"))
    final = postprocess(F.col("text"), merged, protected)
    done = second.select("id", "raw", final.alias("corrected"), F.when(changed(F.col("text"), final), F.lit("model+fallback")).otherwise(F.lit("none")).alias("source"))
    return sure.unionByName(done).unionByName(blank).withColumnRenamed("raw", "text")


def batch_statistics(df: DataFrame) -> DataFrame:
    """``n, total_ms, avg_ms`` of a batch of responses."""
    return df.agg(F.count(F.lit(1)).alias("n"), F.round(F.coalesce(F.sum("latency_ms"), F.lit(0.0)), 2).alias("total_ms"), F.round(F.coalesce(F.avg("latency_ms"), F.lit(0.0)), 2).alias("avg_ms"))
