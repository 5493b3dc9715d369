"""Evaluation texts leaking into training text (problem 8), by template canonicalisation.

Numbers, units and names become typed placeholders, windows of the templates are joined by hash, and the slots of a
joined pair are compared: equal slots are a verbatim passage, slots that map one to one are the same question with other
parameters. Both sides apply one function to the same words, so a verbatim window always meets its template.

Words are hashed once in the JVM; templates, rolling window hashes and a bitmap of the held-out templates are numpy work
on whole batches, so of a document only the windows that may meet an item leave the first step.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexloom.llm.lookalike import words_of
from lexloom.session import cut

#: Words of a window; a shorter quotation is no case.
WINDOW = 12
#: A held-out word is part of a template if at least this share of the items use it, and more than one does; else it is a
#: name. So there are at most ``1 / NAME_SHARE`` times as many template words as an item has words.
NAME_SHARE = 1 / 80
#: A window with fewer template words than this is joined by its own words.
LEAST_FIXED = 6
#: Held-out windows up to this number are broadcast (about 130 bytes each); more are joined by shuffle.
BROADCAST_WINDOWS = 500_000
#: The bitmap of held-out templates has 64 bits for each of them, but from 2**16 to 2**27 bits (16 MB).
BITMAP_BITS = (16, 27)
BASE = np.uint64(0x9E3779B97F4A7C15)
NUMBER, UNIT, NAME = (np.uint64(x) for x in (3, 5, 7))
# Unit words.
UNITS = ["mm", "cm", "m", "km", "inch", "inches", "ft", "g", "kg", "gram", "grams", "ml", "l", "litre", "litres", "w", "watt", "v", "gb", "tb", "hz", "second", "seconds", "minute", "minutes", "hour", "hours", "day", "days", "week", "weeks", "month", "months", "year", "years", "usd", "eur", "gbp"]


def word_code(w: Column) -> Column:
    """A word's hash; the lowest bit tells a number."""
    h = F.xxhash64(w)
    return F.when((w < ":") & w.rlike("^[0-9]+$"), h.bitwiseOR(F.lit(1))).otherwise(h.bitwiseAND(F.lit(-2)))


def template_words(items: DataFrame, text_col: str) -> list[str]:
    """Words of the templates: all that several held-out items share."""
    texts = items.select(F.array_distinct(words_of(F.col(text_col))).alias("w")).filter(F.col("w").isNotNull())
    least = F.greatest(F.lit(2), F.ceil(F.lit(NAME_SHARE) * F.lit(items.count())))
    counts = texts.select(F.explode("w").alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("n"))
    return [r["w"] for r in counts.filter(F.col("n") >= least).orderBy("w").collect()]


def _codes(items: DataFrame, words: list[str]) -> np.ndarray:
    df = items.sparkSession.createDataFrame([(w,) for w in words], "w string")
    return np.sort(np.array([r["c"] for r in df.select(word_code(F.col("w")).alias("c")).collect()], dtype="int64").view("uint64"))


def _among(x: np.ndarray, known: np.ndarray) -> np.ndarray:
    if not len(known):
        return np.zeros(len(x), bool)
    return known[np.minimum(np.searchsorted(known, x), len(known) - 1)] == x


def _rolled(x: np.ndarray) -> np.ndarray:
    """The hash of each window of a flat sequence."""
    out = np.zeros(max(len(x) - WINDOW + 1, 0), "uint64")
    for j in range(WINDOW):
        out = out * BASE + x[j : j + len(out)]
    return out ^ (out >> np.uint64(29))


def windows(df: DataFrame, id_col: str, text_col: str, fixed: np.ndarray, units: np.ndarray, wanted: Broadcast | None = None) -> DataFrame:
    """``id, pos, template, slot, words``: each window's template hash, its bit in the bitmap and its words' hashes.

    With ``wanted``, a bitmap of templates, only windows whose bit is set come out. Texts of fewer words give nothing.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bits = np.unpackbits(np.frombuffer(wanted.value, "uint8"), bitorder="little").astype(bool) if wanted else None
        shift = np.uint64(64 - (len(bits).bit_length() - 1 if wanted else BITMAP_BITS[1]))
        for pdf in batches:
            if pdf.empty:
                continue
            size = pdf["w"].map(len).to_numpy()
            x = np.concatenate(pdf["w"].to_numpy()).astype("int64").view("uint64")
            start = np.cumsum(size) - size
            template = np.where(x & np.uint64(1) == 1, NUMBER, np.where(_among(x, units), UNIT, np.where(_among(x, fixed), x, NAME)))
            named = np.concatenate([[0], np.cumsum(template < 8)])
            few = named[WINDOW:] - named[:-WINDOW] > WINDOW - LEAST_FIXED
            h = np.where(few, _rolled(x) + np.uint64(1), _rolled(template))
            doc = np.repeat(np.arange(len(pdf)), size)[: len(h)]
            at = np.flatnonzero(np.arange(len(h)) + WINDOW <= (start + size)[doc])
            slot = (h[at] * BASE) >> shift
            if wanted:
                hit = bits[slot.astype("int64")]
                at, slot = at[hit], slot[hit]
            words = list(np.lib.stride_tricks.sliding_window_view(x.view("int64"), WINDOW)[at]) if len(at) else []
            yield pd.DataFrame({"id": pdf["id"].to_numpy()[doc[at]], "pos": at - start[doc[at]], "template": h[at].view("int64"), "slot": slot.astype("int64"), "words": pd.Series(words, dtype=object)})

    rows = df.select(F.col(id_col).alias("id"), F.transform(words_of(F.coalesce(F.col(text_col), F.lit(""))), word_code).alias("w")).filter(F.size("w") >= WINDOW)
    return rows.mapInPandas(run, f"id {dict(rows.dtypes)['id']}, pos int, template bigint, slot bigint, words array<bigint>")


def _bitmap(held: DataFrame, n: int) -> bytes:
    """The held-out templates as a bitmap, put together in the cluster from parts of 4 KB."""
    low, high = BITMAP_BITS
    size = min(max(low, (64 * n).bit_length()), high)
    x = F.shiftright("slot", high - size) + 1  # the bitmap functions count from 1
    parts = held.groupBy(F.bitmap_bucket_number(x).alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(x)).alias("m")).collect()
    out = bytearray(2**size // 8)
    for r in parts:
        part = bytes(r["m"])[: len(out)]
        out[(r["b"] - 1) * len(part) : r["b"] * len(part)] = part
    return bytes(out)


def template_hits(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", item_id: str = "item_id", text_col: str = "text") -> DataFrame:
    """``doc_id, pos, item_id, item_pos, x, y``: document windows whose template is that of a held-out window, and both windows' words."""
    sc = items.sparkSession.sparkContext
    fixed, units = _codes(items, template_words(items, text_col)), _codes(items, UNITS)
    held = cut(windows(items, item_id, text_col, fixed, units))
    n = held.count()
    found = windows(docs, doc_id, text_col, fixed, units, sc.broadcast(_bitmap(held, n)))
    side = held.select(F.col("id").alias("item_id"), F.col("pos").alias("item_pos"), "template", F.col("words").alias("y"))
    met = found.join(F.broadcast(side) if n <= BROADCAST_WINDOWS else side, "template")
    return met.select(F.col("id").alias("doc_id"), "pos", "item_id", "item_pos", F.col("words").alias("x"), "y")


def leaked_items(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", item_id: str = "item_id", text_col: str = "text") -> DataFrame:
    """``doc_id, item_id, reason, windows``: each document and item whose template windows agree in their slots, once.

    ``reason`` is ``verbatim`` where a window of ``WINDOW`` words stands in both as it is, else ``reworded``: equal item
    words stand at equal document words and the other way round, so the question is the same with other parameters.
    ``windows`` counts the windows of that reason. Items and documents of fewer words, NULL and empty texts give
    nothing; repeated rows count as one document.
    """
    hits = template_hits(docs, items, doc_id, item_id, text_col)
    pairs = F.array_distinct(F.arrays_zip(F.col("x"), F.col("y")))
    one_to_one = (F.size(pairs) == F.size(F.array_distinct("x"))) & (F.size(pairs) == F.size(F.array_distinct("y")))
    told = hits.select("doc_id", "item_id", (F.col("x") == F.col("y")).alias("same"), one_to_one.alias("fits")).filter("fits")
    out = told.groupBy("doc_id", "item_id").agg(F.count_if("same").alias("same"), F.count(F.lit(1)).alias("all"))
    reason = F.when(F.col("same") > 0, F.lit("verbatim")).otherwise(F.lit("reworded"))
    return out.select("doc_id", "item_id", reason.alias("reason"), F.when(F.col("same") > 0, F.col("same")).otherwise(F.col("all")).alias("windows"))


def leaked_passages(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", item_id: str = "item_id", text_col: str = "text") -> DataFrame:
    """``doc_id, item_id``: documents that hold at least ``WINDOW`` consecutive words of an item, each pair once."""
    return leaked_items(docs, items, doc_id, item_id, text_col).filter("reason = 'verbatim'").select("doc_id", "item_id")


def reworded_questions(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", item_id: str = "item_id", text_col: str = "text") -> DataFrame:
    """``doc_id, item_id, windows``: documents with an item's template under other parameters and no verbatim window."""
    return leaked_items(docs, items, doc_id, item_id, text_col).filter("reason = 'reworded'").select("doc_id", "item_id", "windows")
