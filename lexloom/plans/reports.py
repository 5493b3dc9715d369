"""Queries of the harness, the summaries and reports, and the further generators and readers."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexloom.functions import text as T
from lexloom.operators import cleaning, evaluate, generate, harness
from lexloom.plans.common import SEED, SQL_PART, part_words, sql_norm, sql_rng, word_pairs
from lexloom.plans.texts import SQL as TEXTS_SQL
from lexloom.plans.typo_plans import QUOTAS, SQL as TYPO_SQL
from lexloom.session import table
from lexloom.sources import readers

CONTEXTS = ["{x} review", "best {x}", "buy {x}", "{x} online", "cheap {x}", "top {x}", "{x} near me"]
BRAND_FORMS = ["{x}", "{x} official", "buy {x}", "{x} store", "{x} products"]
FORM = "buy {w} of {q}"


def _echo(text: str) -> str:
    return text.upper()


def _broken(text: str) -> str:
    raise ValueError("no model")


def _eval(s, d):
    return table(s, d, "eval_v3")


def _results(s, d):
    return table(s, d, "results")


def _file(df, line):
    """Rows as the lines of one file in order of their number."""
    return df.select(line.alias("value"), F.lit("file").alias("file"), F.col("example_id").alias("ord"))


def _quoted(s, d):
    e = _eval(s, d).filter("input_text is not null and target_text is not null and not contains(input_text, '\"') and not contains(target_text, '\"')")
    return readers.quoted_pairs(_file(e, F.concat(F.lit('"'), "input_text", F.lit('","'), "target_text", F.lit('"'))))


def _arrows(s, d):
    e = _eval(s, d).filter("not contains(input_text, '->') and not contains(target_text, '->')")
    return readers.external_pairs(_file(e, F.concat_ws(" -> ", T.without_prefix(F.col("input_text")), "target_text"))).select("wrong", "right")


def _gates(s, d):
    words = cleaning.vocabulary(table(s, d, "documents").filter("text is not null"), F.col("text"), 1, r"[a-zA-Z0-9'\-]+").select("word")
    return words.agg(*[F.count_if(T.vocabulary_gate(F.col("word"), a, b)).alias(n) for n, a, b in (("strict", 4, 15), ("least", 4, None), ("loaded", 3, 18))])


def _harness(s, d):
    q = table(s, d, "eval_queries").select("id", "query")
    return harness.run_models(q, "query", {"echo": _echo, "broken": _broken}, pause=0.0).select("model", "id", "corrected", "changed", "error")


def _formatted(s, d):
    r = _results(s, d).groupBy("model").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("error") != "").alias("e"))
    return r.select("model", T.padded(F.col("e"), 8).alias("errors"), T.thousands(F.col("n")).alias("total"), T.percent(F.col("e") / F.col("n"), 2).alias("share"))


QUERIES = {
    "benchmark_summary": lambda s, d: evaluate.benchmark_summary(_results(s, d)),
    "top_categories": lambda s, d: evaluate.most_common(_eval(s, d), "category", 10),
    "difficulty_lengths": lambda s, d: table(s, d, "eval_queries").groupBy("difficulty", "length").agg(F.count(F.lit(1)).alias("n")),
    "corpus_counters": lambda s, d: evaluate.corpus_counters(_eval(s, d)),
    "budget_sum": lambda s, d: _eval(s, d).groupBy("source").agg(F.count(F.lit(1)).alias("n")).agg(F.sum(F.least("n", F.lit(500))).alias("rows")),
    "formatted_scores": _formatted,
    "first_replaced": lambda s, d: table(s, d, "correction_requests").filter("query is not null").select("request_id", T.replace_first(F.col("query"), F.lit("a"), F.lit("<a>")).alias("text")),
    "filled_template": lambda s, d: part_words(s, d).select("id", T.template(FORM, w=F.col("w"), q=F.col("q")).alias("full"), T.template(FORM, w=F.col("w")).alias("lacking")),
    "without_spaces": lambda s, d: table(s, d, "correction_requests").select("request_id", T.without_marks(F.col("query")).alias("text")),
    "vocab_gates": _gates,
    "quoted_pairs_rows": _quoted,
    "external_pairs_rows": _arrows,
    "gen_context": lambda s, d: generate.in_context(word_pairs(s, d), CONTEXTS),
    "gen_existing": lambda s, d: generate.existing_pairs(_eval(s, d).select(T.without_prefix(F.col("input_text")).alias("wrong"), F.col("target_text").alias("right"))),
    "gen_identity_brands": lambda s, d: generate.identity_variants(table(s, d, "brand_catalog").select(F.lower("brand").alias("b")).distinct(), "b", BRAND_FORMS, "identity_brand"),
    "gen_ecom": lambda s, d: generate.typos_by_quota(part_words(s, d).select("id", "q"), QUOTAS, SEED),
    "harness_rows": _harness,
    "no_harm_sample": lambda s, d: evaluate.no_harm(cleaning.smallest_by_hash(_results(s, d).filter("query = expected and error = ''"), "result_id", 2000, SEED)),
}

_TOK = "list_filter(regexp_split_to_array({0}, '[\\s\\p{{Z}}]+'), lambda w: w <> '')"
_WORDS = "(select distinct unnest(regexp_extract_all(lower(text), '[a-zA-Z0-9''\\-]+')) as word from documents where text is not null)"
_PLAIN = TEXTS_SQL["domain_plausible"].split("select word from w where ", 1)[1]
_OK = f"{sql_norm('corrected')} = {sql_norm('expected')}"
_PAIRS = f"""(with t as (select {_TOK.format('query')} as a, {_TOK.format('expected')} as b from eval_queries),
  p as (select distinct unnest(list_transform(range(1, len(a) + 1), lambda i: {{'w': lower(a[i]), 'r': lower(b[i])}})) as z from t where len(a) = len(b))
  select z.w as wrong, z.r as word from p where z.w <> z.r and z.w <> '')"""


def _in_forms(source: str, text: str, forms: list[str]) -> str:
    return f"select replace(t, '{{x}}', {text}) as x, * from {source}, (select unnest({forms}) as t)"


SQL = {
    "benchmark_summary": f"""
with r as (select model, category, ({_OK})::int as ok, case when {sql_norm('query')} = {sql_norm('expected')} then ({sql_norm('corrected')} = {sql_norm('query')})::int end as kept,
  {_TOK.format('corrected')} as a, {_TOK.format('expected')} as b, levenshtein(corrected, expected) / greatest(1, length(expected)) as cer, latency_ms from results where error = ''),
s as (select *, case when greatest(len(a), len(b)) = 0 then 0.0 else len(list_filter(range(1, least(len(a), len(b)) + 1), lambda i: a[i] = b[i])) / greatest(len(a), len(b)) end as tok from r)
select model, category, count(*) as n, round(100 * avg(ok), 4) as exact_pct, round(100 * avg(kept), 4) as no_harm_pct, round(avg(tok), 6) as token_acc, round(avg(cer), 6) as cer,
  round(avg(latency_ms), 4) as mean_ms, round(quantile_cont(latency_ms, 0.5), 4) as p50_ms, round(quantile_cont(latency_ms, 0.95), 4) as p95_ms from s group by grouping sets ((model), (model, category))""",
    "top_categories": "select category, count(*) as n from eval_v3 group by category order by n desc, category nulls first limit 10",
    "difficulty_lengths": "select difficulty, length, count(*) as n from eval_queries group by all",
    "corpus_counters": """
with e as (select *, lower(trim(split_name)) as s from eval_v3), t as (select * from e where s = 'train'), v as (select * from e where s <> 'train')
select (select count(*) from e) as rows, (select count(distinct target_text) from e) as targets, (select count(*) from (select distinct input_text, target_text from e where input_text is not null and target_text is not null)) as pairs,
  (select count(*) from e where not regexp_full_match(coalesce(input_text, '') || coalesce(target_text, ''), '[\\x00-\\x7F]*')) as non_ascii,
  (select count(distinct target_text) from v where target_text in (select target_text from t where target_text is not null)) as leaked_targets,
  (select count(*) from (select distinct input_text, target_text from v intersect select distinct input_text, target_text from t) where input_text is not null and target_text is not null) as leaked_pairs""",
    "budget_sum": "select sum(least(n, 500))::bigint as rows from (select count(*) as n from eval_v3 group by source)",
    "formatted_scores": "select model, lpad(e::varchar, 8, '0') as errors, format('{:,}', n) as total, printf('%.2f%%', round(100.0 * e / n, 2)) as share from (select model, count(*) as n, count(*) filter (error <> '') as e from results group by model)",
    "first_replaced": "select request_id, case when contains(query, 'a') then substr(query, 1, instr(query, 'a') - 1) || '<a>' || substr(query, instr(query, 'a') + 1) else query end as text from correction_requests where query is not null",
    "filled_template": f"select id, 'buy ' || w || ' of ' || q as full, null::varchar as lacking from {SQL_PART}",
    "without_spaces": "select request_id, regexp_replace(query, '\\s', '', 'g') as text from correction_requests",
    "vocab_gates": f"select count(*) filter (regexp_full_match(word, '[a-z]{{4,15}}')) as strict, count(*) filter (regexp_full_match(word, '[a-z]{{4,}}')) as least, count(*) filter (regexp_full_match(word, '[a-z]{{3,18}}')) as loaded from {_WORDS}",
    "quoted_pairs_rows": """
with e as (select lower(trim(input_text)) as wrong, lower(trim(target_text)) as "right", row_number() over (order by example_id) as r, lower(input_text || target_text) as l from eval_v3 where input_text is not null and target_text is not null and not contains(input_text, '"') and not contains(target_text, '"'))
select wrong, "right" from e where wrong <> '' and "right" <> '' and not (r = 1 and regexp_matches(l, 'noisy|clean'))""",
    "external_pairs_rows": """
with e as (select lower(trim(regexp_replace(input_text, '^correct: ', ''))) as wrong, lower(trim(target_text)) as "right" from eval_v3 where not contains(input_text, '->') and not contains(target_text, '->'))
select wrong, "right" from e where wrong <> '' and "right" <> '' and wrong <> "right" and wrong[1] not in ('#', '$')""",
    "gen_context": f"""
with p as (select wrong, word from {_PAIRS} where {_PLAIN} and levenshtein(wrong, word) <= greatest(3, length(word) // 3)), f as (select wrong, word, unnest({CONTEXTS}) as t from p)
select replace(t, '{{x}}', wrong) as input_text, replace(t, '{{x}}', word) as target_text, 'external_context' as category from f
union select replace(t, '{{x}}', word), replace(t, '{{x}}', word), 'identity_external' from f""",
    "gen_external": f"""
with p as (select wrong, word from {_PAIRS} where {_PLAIN} and levenshtein(wrong, word) <= greatest(3, length(word) // 3))
select wrong as input_text, word as target_text, 'external_word' as category from p union select word, word, 'identity_external' from p""",
    "gen_existing": f"""
with e as (select trim(regexp_replace(input_text, '^correct: ', '')) as a, trim(target_text) as b from eval_v3), n as (select *, len({_TOK.format('a')}) as x, len({_TOK.format('b')}) as y from e)
select distinct a as input_text, b as target_text, case when x = 1 and y = 1 then 'vocab_typo' else 'ecom_query_typo' end as category from n where x between 1 and 15 and y between 1 and 15 and lower(a) <> lower(b)""",
    "gen_identity_brands": f"select distinct replace(t, '{{x}}', b) as input_text, replace(t, '{{x}}', b) as target_text, 'identity_brand' as category from (select distinct lower(brand) as b from brand_catalog where brand is not null), (select unnest({BRAND_FORMS}) as t)",
    "gen_ecom": f"""
with t as ({TYPO_SQL['typo_single_simple']}), r as (select id, q, w, {sql_rng('quota', 100)} as r from {SQL_PART})
select r.id, typo || substr(q, length(w) + 1) as input_text, q as target_text, 'ecom_' || case when r < 40 then 'brand' when r < 65 then 'product' when r < 95 then 'query' else 'model' end || '_typo' as category
from r join t on t.id = r.id where typo is not null and typo <> w""",
    "harness_rows": f"""
select 'echo' as model, id, upper(coalesce(query, '')) as corrected, {sql_norm('upper(query)')} <> {sql_norm('query')} as changed, '' as error from eval_queries
union all select 'broken', id, '', false, 'ValueError: no model' from eval_queries""",
    "no_harm_sample": f"""
with s as (select * from results where query = expected and error = '' order by md5(concat_ws('|', '{SEED}', result_id::varchar)), result_id limit 2000)
select count(*) as n, round(avg(({sql_norm('corrected')} = {sql_norm('query')})::int), 6) as no_harm from s""",
}
