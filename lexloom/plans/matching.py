"""Queries of dictionary matching, masking, similarity joins and plain joins and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexloom.functions import typos
from lexloom.functions.text import rng_below, tokens
from lexloom.operators import cleaning, generate, masking, matching, protect
from lexloom.plans.common import MODIFIERS, SEED, SQL_PART, part_words, sql_rng
from lexloom.plans.typo_plans import _sql
from lexloom.session import table
from lexloom.sources.readers import with_defaults

DENY = ["vibofuko", "panubrath"]
ENGLISH = ["keyboard", "mouse", "best", "apply", "wireless"]


def _words(spark, words):
    return spark.createDataFrame([(w,) for w in words], "word string")


def _catalog(s, d):
    return with_defaults(table(s, d, "brand_catalog"))


def _requests(s, d):
    """The requests; ASCII letters only, since lower case must keep every offset."""
    return table(s, d, "correction_requests").select("request_id", F.translate("query", "İ", "I").alias("query"))


def _longest(s, d):
    return matching.alias_table(_catalog(s, d), _words(s, DENY)).agg(F.max(F.length("alias")).alias("n")).first()["n"] or 1


def _spans(s, d):
    return matching.exact_spans(_requests(s, d), matching.alias_table(_catalog(s, d), _words(s, DENY)), "request_id", "query", _longest(s, d))


def _masked(s, d, fuzzy):
    return masking.mask_texts(_requests(s, d), _catalog(s, d), _words(s, DENY), _words(s, ENGLISH), "request_id", "query", _longest(s, d), fuzzy)


def _map_text(c):
    return F.array_join(F.transform(c, lambda m: F.concat(m["token"], F.lit("="), m["canonical"])), ";")


def _vocab(s, d):
    docs = table(s, d, "documents").filter("text is not null")
    v = cleaning.vocabulary(docs, F.col("text"), 2, "[a-z]+").filter(F.length("word") >= 3)
    return v.filter("n >= 50"), v.filter("n < 50")


def _fuzzy(s, d):
    known, unknown = _vocab(s, d)
    return matching.fuzzy_join(unknown, "word", known, "word")


def _band(s, d):
    known, unknown = _vocab(s, d)
    return cleaning.similarity_join(unknown, "word", known, "word").withColumn("distance", F.col("distance").cast("bigint"))


def _damaged(s, d):
    """Masked requests whose first placeholder a model damaged, in turn in four ways."""
    m = _masked(s, d, False).filter(F.size("mask_map") > 0)
    kind = rng_below(4, SEED, F.col("id"), "damage")
    first = F.lit("<<M0>>")
    broken = F.when(kind == 0, F.lit("<<m0>>")).when(kind == 1, F.lit("<< M O >>")).when(kind == 2, F.lit("<X0>")).otherwise(F.lit("gone"))
    return masking.unmask_texts(m.withColumn("out", F.replace("masked", first, broken)), "out", "mask_map")


def _fill(s, d):
    c, n, r = table(s, d, "customer"), table(s, d, "nation"), table(s, d, "region")
    del c
    names = n.join(r.filter("r_name <> 'ASIA'"), n["n_regionkey"] == r["r_regionkey"], "left")
    return names.select("n_name", F.coalesce("r_name", F.lit("other")).alias("category"))


QUERIES = {
    "alias_map": lambda s, d: matching.alias_table(_catalog(s, d), _words(s, DENY)),
    "exact_spans": lambda s, d: _spans(s, d).select("id", F.col("start").cast("bigint").alias("start"), F.col("end").cast("bigint").alias("end"), "canonical", "matched_text"),
    "overlap_resolve": lambda s, d: matching.resolved_spans(_spans(s, d)).select("id", F.array_join(F.transform("spans", lambda x: F.concat_ws(":", x["start"].cast("string"), x["end"].cast("string"), x["canonical"])), "|").alias("spans")),
    "mask_text": lambda s, d: _masked(s, d, False).select("id", "masked", _map_text(F.col("mask_map")).alias("map")),
    "mask_text_fuzzy": lambda s, d: _masked(s, d, True).select("id", "masked", _map_text(F.col("mask_map")).alias("map")),
    "gap_fuzzy": lambda s, d: matching.fuzzy_match(_requests(s, d).select(F.explode(tokens(F.col("query"))).alias("w")), "w", matching.fuzzy_keys(_catalog(s, d), _words(s, DENY)), _words(s, DENY), _words(s, ENGLISH)),
    "unmask_strict": lambda s, d: _masked(s, d, False).select("id", masking.unmask_strict(F.col("masked"), F.col("mask_map")).alias("text")),
    "unmask_damaged": lambda s, d: _damaged(s, d).select("id", "restored", "unrestored"),
    "fuzzy_lookup_ed1": lambda s, d: _fuzzy(s, d).select("word", "key", F.col("distance").cast("bigint").alias("distance")),
    "similarity_band_join": _band,
    "mine_typos": lambda s, d: cleaning.mine_typos(table(s, d, "documents").filter("text is not null"), F.col("text")).withColumn("distance", F.col("distance").cast("bigint")),
    "protect_lookup": lambda s, d: protect.lookup(table(s, d, "correction_requests").select(F.explode(tokens(F.col("query"))).alias("t")), "t", protect.entity_table(s)).withColumn("distance", F.col("distance").cast("bigint")),
    "protected_statistics": lambda s, d: protect.statistics(s),
    "lookup_default": _fill,
    "anti_seen": lambda s, d: table(s, d, "eval_queries").select("id").join(table(s, d, "results").filter("model = 'chat-2b'").select("id").distinct(), "id", "left_anti"),
    "semi_whitelist": lambda s, d: part_words(s, d).join(_words(s, ["red", "blue", "green", "small"]), F.col("w") == F.col("word"), "left_semi").select("id"),
    "cross_sampled": lambda s, d: generate.sampled_cross(part_words(s, d).select("id", "q"), _words(s, MODIFIERS), "word", 2, SEED, "id"),
    "union_vocab": lambda s, d: part_words(s, d).select(F.explode(F.split("q", " ")).alias("word")).unionByName(_words(s, ENGLISH)).distinct(),
    "multiset_intersect": lambda s, d: table(s, d, "results").select("result_id", F.aggregate(F.array_distinct(tokens(F.col("query"))), F.lit(0), lambda a, w: a + F.least(F.size(F.filter(tokens(F.col("query")), lambda v: v == w)), F.size(F.filter(tokens(F.col("corrected")), lambda v: v == w)))).cast("bigint").alias("shared")),
    "positional_join": lambda s, d: table(s, d, "results").select("result_id", F.posexplode(F.arrays_zip(tokens(F.col("expected")).alias("e"), tokens(F.col("corrected")).alias("c"))).alias("i", "z")).filter("z.e <> z.c").groupBy(F.col("z.e").alias("expected_word"), F.col("z.c").alias("got_word")).agg(F.count(F.lit(1)).alias("n")),
    "group_typos": lambda s, d: part_words(s, d).withColumn("t", typos.delete(F.col("w"), SEED, F.col("id"))).filter("t is not null").groupBy("w").agg(F.array_join(F.array_sort(F.collect_set("t")), ",").alias("typos")),
}

_DENY = "(" + ", ".join("'" + w + "'" for w in DENY) + ")"
_ENGL = "(" + ", ".join("'" + w + "'" for w in ENGLISH) + ")"
_ALIAS = f"""(select alias, canonical from (select alias, canonical, row_number() over (partition by alias order by length(canonical) desc, canonical) as r
  from (select canonical, lower(unnest(coalesce(exact_aliases, [canonical]))) as alias from brand_catalog where canonical <> '')
  where alias <> '' and alias not in {_DENY} and lower(canonical) not in {_DENY}) where r = 1)"""
# every start and end beside a word boundary, checked one by one: no index, no runs
_SPANS = f"""(with q as (select request_id as id, query as t from correction_requests where query is not null), l as (select max(length(alias)) as n from {_ALIAS}),
s as (select id, t, unnest(range(0, length(t))) as a from q), e as (select id, t, a, unnest(range(a + 1, least(length(t), a + (select n from l)) + 1)) as b from s
  where a = 0 or not regexp_matches(t[a], '[\\p{{L}}\\p{{N}}]') or not regexp_matches(t[a + 1], '[\\p{{L}}\\p{{N}}]')),
c as (select id, a, b, substr(t, a + 1, b - a) as m from e where (a = 0 or not regexp_matches(t[a], '[\\p{{L}}\\p{{N}}]')) and (b = length(t) or not regexp_matches(t[b + 1], '[\\p{{L}}\\p{{N}}]')))
select id, a::bigint as start, b::bigint as stop, canonical, m from c join {_ALIAS} x on lower(m) = x.alias)"""
_VOC = "(select word, count(*) as n from (select unnest(regexp_extract_all(lower(text), '[a-z]+')) as word from documents where text is not null) where length(word) >= 3 group by word having count(*) >= 2)"
_KEYS = f"(select key, min(canonical) as canonical, arg_min(m, canonical) as m from (select lower(canonical) as key, canonical, coalesce(min_match_length, greatest(4, length(canonical) - 1)) as m from brand_catalog where symspell_eligible and regexp_full_match(lower(canonical), '[\\p{{L}} ]+')) where key not in {_DENY} group by key)"
_NEAR = f"(select u.word as word, k.word as key, damerau_levenshtein(u.word, k.word) as d from {_VOC} u, {_VOC} k where u.n < 50 and k.n >= 50 and abs(length(u.word) - length(k.word)) <= 1 and damerau_levenshtein(u.word, k.word) <= 1)"
_BAND = f"(select u.word as \"left\", k.word as \"right\", levenshtein(u.word, k.word) as distance from {_VOC} u, {_VOC} k where u.n < 50 and k.n >= 50 and abs(length(u.word) - length(k.word)) <= 2 and levenshtein(u.word, k.word) between 1 and 2)"
_TOK = "list_filter(regexp_split_to_array({0}, '[\\s\\p{{Z}}]+'), lambda w: w <> '')"
_ENT = "(values " + ", ".join("('" + w.replace("'", "''") + "', '" + k + "')" for k, w in sorted({w: k for k in reversed(protect.ENTITIES) for w in protect.ENTITIES[k]}.items(), key=lambda x: x[1]) for w, k in [(k, w)]) + ")"



def _one_edit(a: str, b: str, swaps: bool = True) -> str:
    """One letter wrong, missing, extra or exchanged, by trying every place; DuckDB's own distances count bytes."""
    cut = lambda x: f"substr({x}, 1, i - 1) || substr({x}, i + 1)"
    some = lambda x, cond: f"len(list_filter(range(1, length({x}) + 1), lambda i: {cond})) > 0"
    swap = f"substr({a}, 1, i - 1) || substr({a}, i + 1, 1) || substr({a}, i, 1) || substr({a}, i + 2) = {b}"
    return f"({some(a, f'{cut(a)} = {b}')} or {some(b, f'{cut(b)} = {a}')} or (length({a}) = length({b}) and ({some(a, f'{cut(a)} = {cut(b)}')}{f' or {some(a, swap)}' if swaps else ''})))"


SQL = {
    "alias_map": f"select * from {_ALIAS}",
    "exact_spans": f"select id, start, stop as \"end\", canonical, m as matched_text from {_SPANS}",
    "overlap_resolve": f"""
with recursive s as (select id, list({{'s': start, 'e': stop, 'c': canonical}} order by stop - start desc, start) as todo from {_SPANS} group by id),
f as (select id, todo, [] ::struct(s bigint, e bigint, c varchar)[] as kept from s
  union all select id, todo[2:], case when len(list_filter(kept, lambda k: k.s < todo[1].e and todo[1].s < k.e)) > 0 then kept else list_append(kept, todo[1]) end from f where len(todo) > 0)
select id, array_to_string(list_transform(list_sort(kept), lambda k: k.s || ':' || k.e || ':' || k.c), '|') as spans from f where len(todo) = 0""",
    "unmask_strict": "select 1 where false",
    "fuzzy_lookup_ed1": f"select word, key, d::bigint as distance from {_NEAR}",
    "similarity_band_join": f"select * from {_BAND}",
    "mine_typos": f"select \"left\" as wrong, arg_min(\"right\", {{'d': distance, 'r': \"right\"}}) as \"right\", min(distance) as distance from {_BAND} group by \"left\"",
    "gap_fuzzy": f"""
with w as (select distinct lower(x) as word from (select unnest({_TOK.format('query')}) as x from correction_requests where query is not null) where regexp_full_match(lower(x), '\\p{{L}}{{4,}}')),
p as (select word, key, canonical from w, {_KEYS} k where word not in {_DENY} and word not in {_ENGL} and word <> key and abs(length(word) - length(key)) <= 1 and length(word) / length(key) between 0.6 and 1.6 and length(word) >= k.m),
m as (select * from p where {_one_edit('word', 'key')})
select word, arg_min(canonical, key) as canonical, 1 as distance from m group by word""",
    "protect_lookup": f"""
with t as (select distinct x as token, upper(x) as u from (select unnest({_TOK.format('query')}) as x from correction_requests where query is not null)),
e as (select * from {_ENT} v(entity, category)),
p as (select token, u, entity, category from t, e where u = entity or abs(length(u) - length(entity)) <= 1),
m as (select token, entity, category, case when u = entity then 0 else 1 end as d from p where u = entity or {_one_edit('u', 'entity', swaps=False)})
select token, arg_min(entity, {{'d': d, 'e': entity}}) as entity, arg_min(category, {{'d': d, 'e': entity}}) as category, min(d) as distance from m group by token""",
    "protected_statistics": "select * from (values " + ", ".join(f"('{k}', {len(set(v))})" for k, v in protect.ENTITIES.items()) + f", ('all', {len(set().union(*protect.ENTITIES.values()))})) t(category, n)",
    "lookup_default": "select n_name, coalesce(r_name, 'other') as category from nation left join (select * from region where r_name <> 'ASIA') on n_regionkey = r_regionkey",
    "anti_seen": "select id from eval_queries where id not in (select id from results where model = 'chat-2b')",
    "semi_whitelist": f"select id from {SQL_PART} where w in ('red', 'blue', 'green', 'small')",
    "cross_sampled": f"with m as (select list(w order by w) as a from (select unnest({MODIFIERS}) as w)) select distinct id, q, a[{sql_rng('partner', 'len(a)', chr(39) + chr(39) + ' || id || ' + chr(39) + ' ' + chr(39) + ' || k')} + 1] as word from {SQL_PART}, m, (values (1), (2)) t(k)",
    "union_vocab": f"select distinct unnest(string_split(q, ' ')) as word from {SQL_PART} union select unnest({ENGLISH})",
    "multiset_intersect": f"with t as (select result_id, {_TOK.format('query')} as a, {_TOK.format('corrected')} as b from results) select result_id, coalesce(list_sum(list_transform(list_distinct(a), lambda w: least(len(list_filter(a, lambda v: v = w)), len(list_filter(b, lambda v: v = w))))), 0)::bigint as shared from t",
    "positional_join": f"with t as (select {_TOK.format('expected')} as e, {_TOK.format('corrected')} as c from results), u as (select unnest(list_transform(range(1, least(len(e), len(c)) + 1), lambda i: {{'e': e[i], 'c': c[i]}})) as z from t) select z.e as expected_word, z.c as got_word, count(*) as n from u where z.e <> z.c group by all",
    "group_typos": f"select w, array_to_string(list_sort(list_distinct(list({_sql('delete', 'w')}))), ',') as typos from {SQL_PART} where length(w) >= 4 group by w",
}
_RES = SQL["overlap_resolve"].split("\nselect id, array_to_string")[0]
_MASKED = f"""{_RES},
k as (select id, list_sort(kept) as kept from f where len(todo) = 0),
q as (select request_id as id, query as t, coalesce(kept, []) as kept from correction_requests left join k on k.id = request_id),
m as (select id, t, kept, case when t is not null then coalesce(array_to_string(list_transform(kept, lambda x, i: substr(t, (case when i = 1 then 0 else kept[i - 1].e end + 1)::int, (x.s - case when i = 1 then 0 else kept[i - 1].e end)::int) || '<<M' || (i - 1) || '>>'), ''), '')
  || substr(t, (coalesce(kept[-1].e, 0) + 1)::int) end as masked from q)"""
SQL["mask_text"] = _MASKED + " select id, masked, coalesce(array_to_string(list_transform(kept, lambda x, i: '<<M' || (i - 1) || '>>=' || x.c), ';'), '') as map from m"
SQL["unmask_strict"] = _MASKED + " select id, case when t is not null then coalesce(array_to_string(list_transform(kept, lambda x, i: substr(t, (case when i = 1 then 0 else kept[i - 1].e end + 1)::int, (x.s - case when i = 1 then 0 else kept[i - 1].e end)::int) || x.c), ''), '') || substr(t, (coalesce(kept[-1].e, 0) + 1)::int) end as text from m"
