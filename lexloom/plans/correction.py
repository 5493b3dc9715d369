"""Queries of protection, correction, validation and the four-stage pipeline."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexloom.functions.text import tokens
from lexloom.operators import correct, protect
from lexloom.plans.common import sql_norm, word_pairs
from lexloom.session import table

TEXTS = [
    (1, "buy 5 kg rice and 32gb ram"), (2, "laptop 16 gb under $5"), (3, "phone USD 50 case"), (4, "price $99.99 or 20 eur"), (5, "12 widgets 3 boxes"), (6, ""), (7, "samsung tv 4k"), (8, "10 ml and 10 ml"),
]
MERGES = [(1, "samsung tvv chep", "samsong tv cheap"), (2, "buy usb cabel", "buy usc cable now"), (3, "nike shoos", "one two three four five six"), (4, "sony hedphones black", "sony headphones"), (5, "adidas adidas2", "abidas abidas2")]
VALIDATE = [(1, "blak shoes 42", "black shoes 42"), (2, "blak shoes 42", "black shoes 43"), (3, "red tv", "red big nice tv"), (4, "lg tv", "lg television set"), (5, "lg chep tv", "lq cheap tv"), (6, "usb", "usb")]
PROTECTED = ["lg", "usb"]
ROUTED = ["corr-base", "corr-large-v3"]
FALLBACK = [("hedphones", "headphones"), ("cabel", "cable"), ("chep", "cheap")]


def _texts(s, rows, *names):
    return s.createDataFrame(rows, ", ".join(["id bigint", *[f"{n} string" for n in names]]))


def _fallbacks(s):
    return s.createDataFrame(FALLBACK, "wrong string, right string")


def _requests(s, d):
    return table(s, d, "correction_requests").select(F.col("request_id").alias("id"), F.col("query").alias("text"))


def _masked(s, d, mask):
    return _requests(s, d).withColumn("m", mask(F.col("text"))).select("id", "m.masked", F.array_join("m.values", ";").alias("vals"))


def _results(s, d):
    """``id, o, m``: what was asked and what a model made of it, failed calls included."""
    return table(s, d, "results").select(F.col("result_id").alias("id"), F.col("query").alias("o"), F.col("corrected").alias("m"))


def _responses(s, d):
    r = table(s, d, "results").filter("error = ''").withColumn("other", F.when(F.col("corrected") != F.col("expected"), F.array("expected")))
    return correct.response(r.drop("id").withColumnRenamed("result_id", "id"), "query", "corrected", "model_used", "latency_ms", "other")


def _labelled(s, d):
    return table(s, d, "eval_queries").select("id", F.col("query").alias("text"))


QUERIES = {
    "unit_mask": lambda s, d: _texts(s, TEXTS, "q").withColumn("m", protect.mask_units(F.col("q"))).select("id", "m.masked", F.array_join("m.values", ";").alias("vals")),
    "price_mask": lambda s, d: _texts(s, TEXTS, "q").withColumn("m", protect.mask_prices(F.col("q"))).select("id", "m.masked", F.array_join("m.values", ";").alias("vals")),
    "price_mask_v1": lambda s, d: _texts(s, TEXTS, "q").withColumn("m", protect.mask_prices_v1(F.col("q"))).select("id", "m.masked", F.array_join("m.values", ";").alias("vals")),
    "prefix_match": lambda s, d: _requests(s, d).select("id", F.posexplode(tokens(F.col("text"))).alias("i", "t")).withColumn("p", protect.protected_prefix(F.col("t"))).filter("p is not null").select("id", "i", "p.entity", "p.category", "p.rest"),
    "unit_mask_requests": lambda s, d: _masked(s, d, protect.mask_units),
    "price_mask_requests": lambda s, d: _masked(s, d, protect.mask_prices),
    "price_mask_v1_requests": lambda s, d: _masked(s, d, protect.mask_prices_v1),
    "merge_brand_results": lambda s, d: _results(s, d).select("id", protect.merge_corrections(F.col("o"), F.col("m")).alias("merged")),
    "postprocess_validate_results": lambda s, d: _results(s, d).select("id", correct.postprocess(F.col("o"), F.col("m"), F.array(*[F.lit(x) for x in PROTECTED])).alias("final")),
    "merge_fallback_results": lambda s, d: _results(s, d).select("id", correct.merge_fallback(F.col("m"), F.col("o"), F.array(*[F.struct(F.lit(a).alias("original"), F.lit(b).alias("corrected"), F.lit("auto_correct").alias("action")) for a, b in FALLBACK])).alias("merged")),
    "protect_query": lambda s, d: _requests(s, d).withColumn("p", protect.protect(F.col("text"))).select("id", "p.masked", F.size("p.spans").alias("n")),
    "merge_brand": lambda s, d: _texts(s, MERGES, "o", "m").select("id", protect.merge_corrections(F.col("o"), F.col("m")).alias("merged")),
    "postprocess_validate": lambda s, d: _texts(s, VALIDATE, "o", "m").select("id", correct.postprocess(F.col("o"), F.col("m"), F.array(*[F.lit(x) for x in PROTECTED])).alias("final")),
    "merge_fallback": lambda s, d: _texts(s, [(1, "chep hedphones", "cheap hedfones"), (2, "red tv", "red tv")], "o", "m").select("id", correct.merge_fallback(F.col("m"), F.col("o"), F.array(*[F.struct(F.lit(a).alias("original"), F.lit(b).alias("corrected"), F.lit("auto_correct").alias("action")) for a, b in FALLBACK])).alias("merged")),
    "confidence_gate": lambda s, d: table(s, d, "results").filter("error = ''").groupBy("model").agg(F.count_if(correct.confident(F.col("query"), F.col("corrected"))).alias("confident"), F.count(F.lit(1)).alias("n")),
    "model_stage": lambda s, d: correct.dictionary_model(_labelled(s, d), word_pairs(s, d)).select("id", "corrected"),
    "model_stage_requests": lambda s, d: correct.dictionary_model(_requests(s, d), word_pairs(s, d)).select("id", "corrected"),
    "v3_pipeline": lambda s, d: correct.four_stages(_requests(s, d), word_pairs(s, d), _fallbacks(s), F.array(*[F.lit(x) for x in PROTECTED])),
    "response_results": lambda s, d: _responses(s, d).select("id", "corrected_query", "changed", "correction_source", "latency_ms", F.array_join("suggestions", ";").alias("suggestions")),
    "response_confidence": lambda s, d: _responses(s, d).select("id", "confidence"),
    "response_rows": lambda s, d: correct.response_v2(correct.dictionary_model(_requests(s, d), word_pairs(s, d)).withColumn("m", F.lit("dictionary")), "text", "corrected", "m").select("id", "corrected_query", "changed", "confidence", F.array_join("suggestions", ";").alias("suggestions")),
    "model_routing": lambda s, d: table(s, d, "correction_requests").select("request_id", correct.resolve_model(F.col("model"), ROUTED).alias("model_used"), correct.skips_masking(F.col("model"), True).alias("skip")),
}

_TOK = "list_filter(regexp_split_to_array({0}, '[\\s\\p{{Z}}]+'), lambda w: w <> '')"


def _rows(rows, *names):
    return "(select * from (values " + ", ".join("(" + ", ".join(str(x) if isinstance(x, int) else "'" + x + "'" for x in r) + ")" for r in rows) + f") t({', '.join(names)}))"


SQL = {
    "unit_mask": "select * from " + _rows([(1, "buy [NUM_UNIT_0] rice and [NUM_UNIT_1] ram", "5 kg;32gb"), (2, "laptop [NUM_UNIT_0] under $5", "16 gb"), (3, "phone USD [NUM_UNIT_0]", "50 case"), (4, "price $99.99 or 20 eur", ""), (5, "12 widgets 3 boxes", ""), (6, "", ""), (7, "samsung tv 4k", ""), (8, "[NUM_UNIT_0] and [NUM_UNIT_1]", "10 ml;10 ml")], "id", "masked", "vals"),
    "price_mask": "select * from " + _rows([(1, "buy 5 kg rice and 32gb ram", ""), (2, "laptop 16 gb under [PRICE_0]", "$5"), (3, "phone [PRICE_0] case", "USD 50"), (4, "price [PRICE_0] or 20 eur", "$99.99"), (5, "12 widgets 3 boxes", ""), (6, "", ""), (7, "samsung tv 4k", ""), (8, "10 ml and 10 ml", "")], "id", "masked", "vals"),
    "price_mask_v1": "select * from " + _rows([(1, "buy 5 kg rice and 32gb ram", ""), (2, "laptop 16 gb under [PRICE_0]", "$5"), (3, "phone [PRICE_0] case", "USD 50"), (4, "price $99.99 or 20 eur", ""), (5, "12 widgets 3 boxes", ""), (6, "", ""), (7, "samsung tv 4k", ""), (8, "10 ml and 10 ml", "")], "id", "masked", "vals"),
    "postprocess_validate": "select * from " + _rows([(1, "black shoes 42"), (2, "blak shoes 42"), (3, "red tv"), (4, "lg tv"), (5, "lg cheap tv"), (6, "usb")], "id", "final"),
    "merge_brand": "select * from " + _rows([(1, "SAMSUNG tv cheap"), (2, "buy USB cable"), (3, "one two three four five six"), (4, "SONY headphones black"), (5, "ADIDAS adidas2")], "id", "merged"),
    "merge_fallback": "select * from " + _rows([(1, "cheap headphones"), (2, "red tv")], "id", "merged"),
    "model_stage": f"""
with t as (select {_TOK.format('query')} as a, {_TOK.format('expected')} as b from eval_queries),
p as (select unnest(list_transform(range(1, len(a) + 1), lambda i: {{'w': lower(a[i]), 'r': b[i]}})) as z from t where len(a) = len(b)),
m as (select z.w as w, min(z.r) as r from p where z.w <> lower(z.r) group by z.w),
q as (select id, unnest(list_transform({_TOK.format('query')}, lambda t, i: {{'t': t, 'i': i}})) as x from eval_queries)
select id, string_agg(coalesce(r, x.t), ' ' order by x.i) as corrected from q left join m on m.w = lower(x.t) group by id""",
    "response_results": f"select result_id as id, corrected as corrected_query, {sql_norm('corrected')} <> {sql_norm('query')} as changed, model_used as correction_source, round(latency_ms, 2) as latency_ms, case when corrected <> expected then concat('Did you mean ', chr(39), expected, chr(39), '?') else '' end as suggestions from results where error = ''",
    "model_routing": "select request_id, case when model in ('corr-base', 'corr-large-v3') then model else 'dictionary' end as model_used, coalesce(contains(model, 'v2.1'), false) as skip from correction_requests",
}
