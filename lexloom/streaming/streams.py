"""Structured Streaming forms of some operators; an extension, the batch operators are the same functions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.operators.masking import assemble, unmask_strict
from lexloom.operators.matching import SPAN, boundaries, resolve


def masked_stream(stream: DataFrame, text_col: str, aliases: dict[str, str]) -> DataFrame:
    """``masked, mask_map`` added to each row, without state: the aliases are a bounded map that travels with the plan."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    names = F.create_map(*[F.lit(x) for kv in (aliases or {"\u0000": ""}).items() for x in kv])
    words = F.filter(boundaries(text), lambda r: r["word"])
    longest = max(map(len, aliases), default=0)
    spans = F.flatten(F.transform(words, lambda a: F.transform(F.filter(words, lambda b: (b["end"] > a["start"]) & (b["end"] - a["start"] <= longest)), lambda b: F.struct(
        a["start"].alias("start"), b["end"].alias("end"), F.element_at(names, F.lower(F.substring(text, a["start"] + 1, b["end"] - a["start"]))).alias("canonical")))))
    hits = F.filter(spans.cast(SPAN), lambda s: s["canonical"].isNotNull())
    return stream.withColumn("_m", assemble(F.col(text_col), resolve(hits))).withColumns({"masked": F.col("_m.masked"), "mask_map": F.col("_m.mask_map")}).drop("_m")


def restored_stream(stream: DataFrame, text_col: str, map_col: str) -> DataFrame:
    return stream.withColumn("restored", unmask_strict(F.col(text_col), F.col(map_col)))


def first_pairs(stream: DataFrame, keys: list[str], event_time: str, late: str = "1 hour") -> DataFrame:
    """The first row of each key within the watermark; later copies are dropped, state older than it too."""
    return stream.withWatermark(event_time, late).dropDuplicatesWithinWatermark(keys)


def windowed_accuracy(stream: DataFrame, event_time: str, width: str = "1 day", late: str = "2 days") -> DataFrame:
    """``model, start, n, errors`` per window of event time, late rows within the watermark counted."""
    w = F.window(event_time, width)
    out = stream.withWatermark(event_time, late).groupBy("model", w.alias("w")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("error") != "").alias("errors"))
    return out.select("model", F.col("w.start").alias("start"), "n", "errors")
