"""Entity masking and unmasking: spans become placeholders that a correction model leaves alone, and come back after."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexloom.functions.text import strip_edges, token_spans
from lexloom.operators.matching import SPAN, alias_table, exact_spans, fuzzy_keys, fuzzy_match, resolved_spans

# The placeholder as it is written, as models tend to damage it, and as anything shaped like it.
STRICT = r"<<M(\d+)>>"
LENIENT = r"<\s*<?\s*[Mm]\s*([0-9Oo]+)\s*>?\s*>"
SHAPE = r"<+\s*[A-Za-z]?\s*[0-9OoIlL]+\s*>+"
MAP = "array<struct<token:string,canonical:string>>"


def mask(index: Column) -> Column:
    return F.concat(F.lit("<<M"), index.cast("string"), F.lit(">>"))


def assemble(text: Column, spans: Column) -> Column:
    """``struct<masked, mask_map>``: spans in order of start replaced by numbered placeholders, left to right."""
    zero = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"), F.array().cast(MAP).alias("map"))

    def step(acc: Column, s: Column) -> Column:
        token = mask(F.size(acc["map"]))
        out = F.concat(acc["out"], F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), token)
        one = F.array(F.struct(token.alias("token"), s["canonical"].alias("canonical")))
        return F.struct(s["end"].alias("at"), out.alias("out"), F.concat(acc["map"], one).alias("map"))

    done = F.aggregate(F.coalesce(spans, F.array().cast(SPAN)), zero, step)
    return F.struct(F.concat(done["out"], F.substring(text, done["at"] + 1, F.length(text))).alias("masked"), done["map"].alias("mask_map"))


def gap_tokens(texts: DataFrame) -> DataFrame:
    """``id, word, start, end`` of tokens no span touches, without their edges, four characters or longer."""
    free = F.filter(token_spans(F.col("text")), lambda t: ~F.exists(F.col("spans"), lambda s: (s["start"] < t["end"]) & (t["start"] < s["end"])))
    t = texts.select("id", F.explode(free).alias("t")).withColumn("e", strip_edges(F.col("t.text"))).filter(F.length("e.core") >= 4)
    start = F.col("t.start") + F.col("e.lead")
    return t.select("id", F.col("e.core").alias("word"), start.alias("start"), (start + F.length("e.core")).alias("end"))


def mask_texts(texts: DataFrame, catalog: DataFrame, deny: DataFrame, english: DataFrame, id_col: str, text_col: str, longest: int = 60, fuzzy: bool = True) -> DataFrame:
    """``id, text, masked, mask_map``: exact mentions first, one-edit words in the gaps, one row for each text.

    NULL texts stay NULL with an empty map; an empty catalogue leaves every text as it is. ``longest`` bounds the
    candidate spans and must not be less than the longest alias. Ids must be unique.
    """
    t = texts.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    found = resolved_spans(exact_spans(t, alias_table(catalog, deny), "id", "text", longest))
    t = t.join(found, "id", "left").withColumn("spans", F.coalesce("spans", F.array().cast(SPAN)))
    if fuzzy:
        gaps = gap_tokens(t)
        hits = fuzzy_match(gaps, "word", fuzzy_keys(catalog, deny), deny, english)
        more = gaps.join(hits.withColumnRenamed("word", "low"), F.lower(gaps["word"]) == F.col("low"))
        more = more.groupBy("id").agg(F.collect_list(F.struct("start", "end", "canonical")).alias("extra"))
        t = t.join(more, "id", "left").withColumn("spans", F.array_sort(F.concat("spans", F.coalesce("extra", F.array().cast(SPAN)))))
    return t.withColumn("m", assemble(F.col("text"), F.col("spans"))).select("id", "text", "m.masked", "m.mask_map")


def unmask_strict(text: Column, mask_map: Column) -> Column:
    """Every placeholder of the map replaced wherever it stands."""
    return F.aggregate(mask_map, text, lambda out, m: F.replace(out, m["token"], m["canonical"]))


@F.pandas_udf(T.StructType().add("text", T.StringType()).add("unrestored", T.IntegerType()))
def unmask(text: pd.Series, tokens: pd.Series, canonicals: pd.Series) -> pd.DataFrame:
    """Three tiers: exact placeholders, damaged ones by their number, and as many shapes as are still missing by order."""
    out, missing = [], []
    for s, toks, names in zip(text, tokens, canonicals, strict=True):
        if s is None:
            out.append(None)
            missing.append(0)
            continue
        todo = dict(enumerate(names))
        for i, tok in enumerate(toks):
            if tok in s:
                s = s.replace(tok, names[i])
                todo.pop(i, None)
        if todo:
            for m in reversed(list(re.finditer(LENIENT, s))):
                i = int(m[1].translate(str.maketrans("Oo", "00")))
                if i < len(names):
                    s = s[: m.start()] + names[i] + s[m.end() :]
                    todo.pop(i, None)
        shapes = list(re.finditer(SHAPE, s))
        if todo and len(shapes) == len(todo):
            for m, i in reversed(list(zip(shapes, sorted(todo), strict=True))):
                s = s[: m.start()] + names[i] + s[m.end() :]
            todo = {}
        out.append(s)
        missing.append(len(todo))
    return pd.DataFrame({"text": out, "unrestored": missing})


def unmask_texts(df: DataFrame, text_col: str, map_col: str) -> DataFrame:
    """``restored, unrestored`` added; rows whose placeholders are all whole never see a Python worker."""
    tok, names = F.transform(map_col, lambda m: m["token"]), F.transform(map_col, lambda m: m["canonical"])
    whole = F.forall(map_col, lambda m: F.col(text_col).contains(m["token"]))
    easy = df.filter(F.coalesce(whole, F.lit(True))).withColumns({"restored": unmask_strict(F.col(text_col), F.col(map_col)), "unrestored": F.lit(0)})
    hard = df.filter(~whole).withColumn("u", unmask(F.col(text_col), tok, names)).withColumns({"restored": F.col("u.text"), "unrestored": F.col("u.unrestored")}).drop("u")
    return easy.unionByName(hard)
