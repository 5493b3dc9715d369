"""Queries of the pair readers, cleaning, balancing and splitting."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexloom.functions.text import is_identity_label, valid_pair
from lexloom.operators import cleaning
from lexloom.plans.common import SEED, SQL_PART, part_words
from lexloom.sources import readers, sinks
from lexloom.session import table

# Small files of the formats the readers take.
LINES = ["# words", "recieve -> receive", "teh=>the", "adress\taddress", "wierd|weird", "seperate,separate", "untill: until", "$keyboard", "keybord", "kayboard", "$mouse", "mose", "two words here", "shu shoe"]
BLOCKS = ["stray", "$monitor", "moniter", "monitr", "$printer", "prnter"]
ARROWS = ["abandonned->abandoned", "aberation->aberration, aberrations", "acheive (achieve, archive)"]
GROUPED = ["contented: contenpted contende", "poems: poims, pomes"]
MAPPINGS = ["# typos", "samsng,samsung", "iphnoe,iphone", "same,same", "empty,", "a,b,c"]


def _lines(spark, lines):
    return spark.createDataFrame([(v, "memory", i) for i, v in enumerate(lines)], "value string, file string, ord bigint")


def _examples(s, d):
    return table(s, d, "eval_v3").select(F.col("example_id").alias("ord"), "input_text", "target_text", "category")


def _identity():
    return is_identity_label(F.col("category"))


def _shared(s, d, operator, part, of):
    """The target in proportion to the table, as 2000 and 2900 are to the 3000 rows of sf0.01."""
    e = _examples(s, d)
    return operator(e, "ord", _identity(), e.count() * part // of, SEED).select("ord")


def _split(s, d):
    e = _examples(s, d)
    return cleaning.split_head(e, "ord", e.count() // 20, SEED)


QUERIES = {
    "pairs_parse_multi": lambda s, d: readers.external_pairs(_lines(s, LINES)).select("wrong", "right"),
    "pairs_birkbeck_fill": lambda s, d: readers.block_pairs(_lines(s, BLOCKS)),
    "pairs_arrow": lambda s, d: readers.arrow_pairs(_lines(s, ARROWS)),
    "pairs_grouped": lambda s, d: readers.grouped_pairs(_lines(s, GROUPED)),
    "typo_mappings": lambda s, d: readers.typo_mappings(_lines(s, MAPPINGS)),
    "typo_mappings_strict": lambda s, d: readers.typo_mappings(_lines(s, MAPPINGS), strict=True),
    "catalog_defaults": lambda s, d: readers.with_defaults(table(s, d, "brand_catalog")).select("canonical", "brand", "category", "symspell_eligible", "min_match_length", F.size("exact_aliases").cast("bigint").alias("n_aliases")),
    "pair_validator": lambda s, d: part_words(s, d).withColumn("t", F.concat(F.substring("w", 2, 100), F.lit("x"))).select("id", valid_pair(F.col("t"), F.col("w")).alias("ok")),
    "quality_filter_waterfall": lambda s, d: cleaning.waterfall(cleaning.label_pairs(_examples(s, d))),
    "quality_filter_keep": lambda s, d: cleaning.label_pairs(_examples(s, d), prefixed=False).filter("rule = 'keep'").select("ord"),
    "quality_filter_v30": lambda s, d: cleaning.quality_filter_v30(_examples(s, d)).select("ord"),
    "dedup_keep_first": lambda s, d: cleaning.keep_first(_examples(s, d), ["input_text", "target_text"], "ord").select("ord"),
    "conflict_keep_first": lambda s, d: cleaning.label_pairs(_examples(s, d)).filter("rule in ('duplicate', 'conflict')").select("ord", "rule"),
    "identity_ratio": lambda s, d: _examples(s, d).agg(F.count_if(_identity()).alias("identities"), F.count_if(~_identity()).alias("corrections"), F.round(F.avg(_identity().cast("double")), 4).alias("ratio")),
    "balance_identity": lambda s, d: cleaning.balance(_examples(s, d), "ord", _identity(), 2000, SEED).select("ord"),
    "trim_ratio": lambda s, d: cleaning.trim_identities(_examples(s, d), "ord", _identity(), 0.05, SEED).select("ord"),
    "trim_target": lambda s, d: cleaning.trim_to(_examples(s, d), "ord", _identity(), 2900, SEED).select("ord"),
    "balance_identity_share": lambda s, d: _shared(s, d, cleaning.balance, 2, 3),
    "trim_target_share": lambda s, d: _shared(s, d, cleaning.trim_to, 29, 30),
    "split_eval": lambda s, d: _split(s, d)[1].select("ord"),
    "train_minus_eval": lambda s, d: _split(s, d)[0].select("ord"),
    "split_leakage": lambda s, d: cleaning.leakage(*_split(s, d)),
    "train_subset": lambda s, d: cleaning.smallest_by_hash(_examples(s, d), "ord", 1000, SEED + 1).select("ord"),
    "source_of_pair": lambda s, d: cleaning.pair_registry(table(s, d, "eval_v3").select("example_id", F.col("input_text").alias("wrong"), F.col("target_text").alias("right"), "source"), "example_id").groupBy("source").agg(F.count(F.lit(1)).alias("n")),
    "embedded_roundtrip": lambda s, d: readers.embedded_examples(sinks.embedded(table(s, d, "eval_v3").select("input_text", "target_text")), "blob"),
}

_E = "(select example_id as ord, input_text, target_text, category from eval_v3)"
_ID = "coalesce(contains(category, 'identity'), false)"
_H = f"md5(concat_ws('|', '{SEED}', ord::varchar))"


def _labelled(prefixed: bool) -> str:
    c = "input_text" if prefixed else "regexp_replace(input_text, '^correct: ', '')"
    dist = f"levenshtein({c}, target_text) / greatest(length({c}), length(target_text), 1)"
    return f"""(with e as (select *, {c} as c from {_E}),
r as (select *, case when trim(coalesce(input_text, '')) = '' or trim(coalesce(target_text, '')) = '' then 'empty'
  when not regexp_full_match(input_text, '[\\x00-\\x7F]*') or not regexp_full_match(target_text, '[\\x00-\\x7F]*') then 'non_ascii'
  when not {_ID} and c = target_text then 'equal' when not {_ID} and {dist} > 0.5 then 'edit_share'
  when not {_ID} and least(length(c), length(target_text)) / greatest(length(c), length(target_text), 1) < 0.4 then 'length_ratio' end as rule from e),
n as (select *, row_number() over w as k, first_value(target_text) over w as f from r window w as (partition by input_text, rule is null order by ord))
select ord, coalesce(rule, case when k = 1 then 'keep' when target_text = f then 'duplicate' else 'conflict' end) as rule from n)"""


_HEAD = f"(select ord from (select ord, row_number() over (order by {_H}, ord) as r from {_E}) where r <= (select count(*) // 20 from eval_v3))"
_EV = f"(select e.* from {_E} e join {_HEAD} h using (ord))"
_TR = f"(select e.* from {_E} e anti join {_EV} v using (ord))"
_TRAIN = f"(select t.* from {_TR} t anti join {_EV} v on t.input_text = v.input_text and t.target_text = v.target_text)"


def _limited(n: str, where: str) -> str:
    return f"select ord from (select ord, row_number() over (order by {_H}, ord) as r from {_E} where {where}) where r <= {n}"


def _values(rows):
    return "select * from (values " + ", ".join("(" + ", ".join("'" + x + "'" for x in r) + ")" for r in rows) + ") t(wrong, \"right\")"


SQL = {
    "pairs_parse_multi": _values([("recieve", "receive"), ("teh", "the"), ("adress", "address"), ("wierd", "weird"), ("seperate", "separate"), ("untill", "until"), ("keybord", "keyboard"), ("kayboard", "keyboard"), ("mose", "mouse"), ("two words here", "mouse"), ("shu shoe", "mouse")]),
    "pairs_birkbeck_fill": _values([("moniter", "monitor"), ("monitr", "monitor"), ("prnter", "printer")]),
    "pairs_arrow": _values([("abandonned", "abandoned"), ("aberation", "aberration"), ("acheive", "achieve")]),
    "pairs_grouped": _values([("contenpted", "contented"), ("contende", "contented"), ("poims", "poems"), ("pomes", "poems")]),
    "typo_mappings": _values([("samsng", "samsung"), ("iphnoe", "iphone"), ("same", "same"), ("empty", ""), ("a", "b,c")]),
    "typo_mappings_strict": _values([("samsng", "samsung"), ("iphnoe", "iphone"), ("a", "b,c")]),
    "catalog_defaults": "select canonical, coalesce(brand, canonical) as brand, coalesce(category, 'general') as category, coalesce(symspell_eligible, false) as symspell_eligible, coalesce(min_match_length, greatest(4, length(canonical) - 1))::int as min_match_length, coalesce(len(exact_aliases), 1) as n_aliases from brand_catalog where canonical <> ''",
    "pair_validator": f"with p as (select id, w, substr(w, 2) || 'x' as t from {SQL_PART}) select id, regexp_full_match(lower(w), '[a-z0-9\\s\\-./''&+]+') and length(w) <= 50 and t <> w and levenshtein(lower(t), lower(w)) <= 5 as ok from p",
    "quality_filter_waterfall": f"select rule, count(*) as n from {_labelled(True)} group by rule",
    "quality_filter_keep": f"select ord from {_labelled(False)} where rule = 'keep'",
    "conflict_keep_first": f"select ord, rule from {_labelled(True)} where rule in ('duplicate', 'conflict')",
    "dedup_keep_first": f"select min(ord) as ord from {_E} group by input_text, target_text",
    "quality_filter_v30": f"""
with e as (select *, regexp_replace(input_text, '^correct: ', '') as c from {_E}),
k as (select * from e where trim(c) <> '' and trim(target_text) <> '' and len(list_filter(regexp_split_to_array(c, '[\\s\\p{{Z}}]+'), lambda w: w <> '')) <= 15
  and len(list_filter(regexp_split_to_array(target_text, '[\\s\\p{{Z}}]+'), lambda w: w <> '')) <= 15 and not (c <> target_text and lower(c) = lower(target_text))
  and not (len(list_filter(range(1, least(length(c), length(target_text)) + 1), lambda i: c[i] <> target_text[i])) + abs(length(c) - length(target_text)) > 0.6 * least(length(c), length(target_text))))
select min(ord) as ord from k group by input_text, target_text""",
    "identity_ratio": f"select count(*) filter ({_ID}) as identities, count(*) filter (not {_ID}) as corrections, round(avg(({_ID})::int), 4) as ratio from {_E}",
    "balance_identity": f"""
with c as (select count(*) as n, count(*) filter ({_ID}) as i from {_E}),
r as (select ord, {_ID} as same, row_number() over (partition by {_ID} order by {_H}, ord) as k from {_E})
select ord from r, c where n <= 2000 or i >= 2000 or same or k <= 2000 - i""",
    "trim_ratio": f"""
with c as (select count(*) as n, count(*) filter ({_ID}) as i from {_E}),
r as (select ord, {_ID} as same, row_number() over (partition by {_ID} order by {_H}, ord) as k from {_E})
select ord from r, c where i / n <= 0.08 or not same or k <= floor((n - i) * 0.05 / 0.95)""",
    "trim_target": f"""
with c as (select count(*) as n, count(*) filter ({_ID}) as i from {_E}),
r as (select ord, {_ID} as same, row_number() over (partition by {_ID} order by {_H}, ord) as k from {_E})
select ord from r, c where n <= 2900 or not same or k <= greatest(0, i - (n - 2900))""",
    "balance_identity_share": f"""
with c as (select count(*) as n, count(*) filter ({_ID}) as i, count(*) * 2 // 3 as t from {_E}),
r as (select ord, {_ID} as same, row_number() over (partition by {_ID} order by {_H}, ord) as k from {_E})
select ord from r, c where n <= t or i >= t or same or k <= t - i""",
    "trim_target_share": f"""
with c as (select count(*) as n, count(*) filter ({_ID}) as i, count(*) * 29 // 30 as t from {_E}),
r as (select ord, {_ID} as same, row_number() over (partition by {_ID} order by {_H}, ord) as k from {_E})
select ord from r, c where n <= t or not same or k <= greatest(0, i - (n - t))""",
    "split_eval": f"select ord from {_HEAD}",
    "train_minus_eval": f"select ord from {_TRAIN}",
    "split_leakage": f"select (select count(*) from {_EV} v semi join {_TRAIN} t on t.input_text = v.input_text and t.target_text = v.target_text) as pairs, (select count(*) from {_EV} v semi join {_TRAIN} t on t.target_text = v.target_text) as targets",
    "train_subset": f"select ord from (select ord, row_number() over (order by md5(concat_ws('|', '{SEED + 1}', ord::varchar)), ord) as r from {_E}) where r <= 1000",
    "source_of_pair": "with f as (select source, row_number() over (partition by input_text, target_text order by example_id) as r from eval_v3) select source, count(*) as n from f where r = 1 group by source",
    "embedded_roundtrip": "select input_text, target_text from eval_v3",
}
