"""Queries of the text functions and predicates."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexloom.functions import text as T
from lexloom.operators import cleaning
from lexloom.plans.common import SQL_PART, part_words, sql_norm
from lexloom.session import table


def _docs(s, d):
    return table(s, d, "documents").select("doc_id", "text", "lang", "source").filter("text is not null")


def _titles(s, d):
    return table(s, d, "documents").filter("source = 'title_feed' and text is not null").select("doc_id", "text")


def _requests(s, d):
    return table(s, d, "correction_requests").select("request_id", "query").filter("query is not null")


def _words(s, d):
    return cleaning.vocabulary(_docs(s, d), F.col("text"), 1, r"[a-zA-Z0-9'\-]+").select("word")


QUERIES = {
    "tokenize_offsets": lambda s, d: _requests(s, d).select("request_id", F.explode(T.token_spans(F.col("query"))).alias("t")).select("request_id", "t.text", F.col("t.start").cast("bigint").alias("start"), F.col("t.end").cast("bigint").alias("end")),
    "strip_edges": lambda s, d: _requests(s, d).select("request_id", F.posexplode(T.tokens(F.col("query"))).alias("i", "t")).withColumn("e", T.strip_edges(F.col("t"))).select("request_id", F.col("i").cast("bigint").alias("i"), "e.core", F.col("e.lead").cast("bigint").alias("lead"), F.col("e.trail").cast("bigint").alias("trail")),
    "norm_changed": lambda s, d: table(s, d, "results").select("result_id", T.changed(F.col("query"), F.col("corrected")).alias("changed_text")),
    "ascii_gate": lambda s, d: _docs(s, d).groupBy("source").agg(F.count_if(T.is_ascii(F.col("text"))).alias("ascii"), F.count(F.lit(1)).alias("n")),
    "domain_plausible": lambda s, d: _words(s, d).filter(T.domain_plausible(F.col("word"))),
    "clean_title": lambda s, d: _titles(s, d).select("doc_id", T.clean_title(F.col("text")).alias("title")).filter("title is not null"),
    "digit_runs": lambda s, d: _requests(s, d).select("request_id", F.array_join(T.digit_runs(F.col("query")), " ").alias("runs")).filter("runs <> ''"),
    "model_numbers": lambda s, d: part_words(s, d).select("id", F.explode(T.model_numbers(F.concat_ws(" ", "q", F.concat(F.upper(F.substring("w", 1, 3)), F.lit("-"), F.col("id").cast("string"), F.lit("x")), F.lit("A1")))).alias("model")),
    "query_length_gate": lambda s, d: _requests(s, d).filter(T.query_length_gate(F.col("query"))).select("request_id"),
    "having_vocab": lambda s, d: cleaning.vocabulary(_docs(s, d), F.col("text"), 20),
    "first_terms": lambda s, d: cleaning.first_terms(_titles(s, d), F.col("text")).filter("n >= 2"),
    "longest_word": lambda s, d: _requests(s, d).select("request_id", F.aggregate(T.tokens(F.col("query")), F.lit(""), lambda a, w: F.when(F.length(w) > F.length(a), w).otherwise(a)).alias("word")),
    "prefix_strip": lambda s, d: table(s, d, "eval_v3").select("example_id", T.without_prefix(F.col("input_text")).alias("text")),
    "identity_by_text": lambda s, d: table(s, d, "eval_v3").groupBy(T.is_identity(F.col("input_text"), F.col("target_text")).alias("by_text"), T.is_identity_label(F.col("category")).alias("by_label")).agg(F.count(F.lit(1)).alias("n")),
    "byte_tokens": lambda s, d: table(s, d, "eval_v3").select("example_id", F.size(T.byte_ids(F.col("target_text"))).cast("bigint").alias("n_ids"), F.element_at(T.byte_ids(F.col("target_text")), 1).cast("bigint").alias("first_id")),
    "truncation_rate": lambda s, d: table(s, d, "eval_v3").agg(F.count_if(T.is_truncated(F.col("input_text"), 64)).alias("truncated"), F.count(F.lit(1)).alias("n")),
    "positional_gate": lambda s, d: table(s, d, "results").select("result_id", T.positional_difference(F.col("query"), F.col("corrected")).cast("bigint").alias("diff")),
    "nfkc_preprocess": lambda s, d: _requests(s, d).select("request_id", T.preprocessed(F.col("query")).alias("clean")),
    "confidence_score": lambda s, d: table(s, d, "results").filter("error = ''").select("result_id", T.confidence(F.col("query"), F.col("corrected")).alias("confidence")),
    "suggestions": lambda s, d: table(s, d, "results").filter("changed").select("result_id", T.suggestion(F.col("corrected")).alias("suggestion")),
    "error_counts_by_latency": lambda s, d: table(s, d, "results").groupBy("model", F.floor(F.col("latency_ms") / 100).cast("bigint").alias("bucket")).agg(F.count(F.lit(1)).alias("n")),
}

_STOP = ", ".join("'" + w + "'" for w in T.STOPWORDS + T.BLOCKLIST)
_TOK = "list_filter(regexp_split_to_array({0}, '[\\s\\p{{Z}}]+'), lambda w: w <> '')"
_Q = "(select request_id, query from correction_requests where query is not null)"

SQL = {
    "tokenize_offsets": f"""
with r as (select request_id, regexp_extract_all(query, '[^\\s\\p{{Z}}]+|[\\s\\p{{Z}}]+') as runs from {_Q}),
e as (select request_id, unnest(list_transform(runs, lambda x, i: {{'text': x, 'start': coalesce(list_sum(list_transform(runs[1:i - 1], lambda y: length(y))), 0)}})) as t from r)
select request_id, t.text as text, t.start::bigint as start, (t.start + length(t.text))::bigint as "end" from e where not regexp_matches(t.text, '^[\\s\\p{{Z}}]')""",
    "strip_edges": f"""
with t as (select request_id, unnest(list_transform({_TOK.format('query')}, lambda w, i: {{'t': w, 'i': i - 1}})) as x from {_Q}),
l as (select request_id, x.i as i, x.t as t, length(regexp_extract(x.t, '^[^\\p{{L}}\\p{{N}}]*')) as lead from t),
m as (select *, case when lead = length(t) then 0 else length(regexp_extract(t, '[^\\p{{L}}\\p{{N}}]*$')) end as trail from l)
select request_id, i::bigint as i, substr(t, lead + 1, length(t) - lead - trail) as core, lead::bigint as lead, trail::bigint as trail from m""",
    "norm_changed": f"select result_id, {sql_norm('corrected')} <> {sql_norm('query')} as changed_text from results",
    "ascii_gate": "select source, count(*) filter (regexp_full_match(text, '[\\x00-\\x7F]*')) as ascii, count(*) as n from documents where text is not null group by source",
    "domain_plausible": f"""
with w as (select distinct unnest(regexp_extract_all(lower(text), '[a-zA-Z0-9''\\-]+')) as word from documents where text is not null)
select word from w where regexp_matches(word, '^[a-z][a-z0-9''\\-]+$') and length(word) between 3 and 18 and not regexp_matches(word, '[aeiou]{{4,}}')
and not regexp_matches(word, '[bcdfghjklmnpqrstvwxz]{{5,}}') and word not in ({_STOP})""",
    "clean_title": f"""
with a as (select doc_id, text, trim(regexp_replace(trim(regexp_replace(lower(regexp_replace(regexp_replace(text, '\\([^)]*\\)', ' ', 'g'), '\\[[^\\]]*\\]', ' ', 'g')), '\\s+', ' ', 'g')), '\\s*\\b(pack of|set of|\\d+\\s*(pack|count|pcs|pieces))\\b.*$', '')) as x
  from documents where source = 'title_feed' and text is not null),
b as (select doc_id, text, list_filter(string_split(x, ' '), lambda w: w <> '') as w from a)
select doc_id, array_to_string(w[1:7], ' ') as title from b where regexp_full_match(text, '[\\x00-\\x7F]*') and len(w) between 2 and 15 and length(array_to_string(w[1:7], ' ')) between 5 and 80""",
    "digit_runs": f"select request_id, array_to_string(regexp_extract_all(query, '[0-9]+'), ' ') as runs from {_Q} where regexp_matches(query, '[0-9]')",
    "model_numbers": f"select id, model from (select id, unnest(regexp_extract_all(q || ' ' || upper(substr(w, 1, 3)) || '-' || id || 'x A1', '\\b([A-Z]{{1,5}}-?\\d{{2,5}}[A-Za-z]*)\\b', 1)) as model from {SQL_PART}) where length(model) >= 3",
    "query_length_gate": f"select request_id from {_Q} where length(query) > 2 and length(query) < 60 and len({_TOK.format('query')}) between 2 and 8",
    "having_vocab": "with w as (select unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) as word from documents where text is not null) select word, count(*) as n from w group by word having count(*) >= 20",
    "first_terms": f"""
with t as (select {_TOK.format('text')} as w from documents where source = 'title_feed' and text is not null),
x as (select unnest(list_distinct([w[1], concat_ws(' ', w[1], w[2])])) as term from t)
select term, count(*) as n from x where term <> '' group by term having count(*) >= 2""",
    "longest_word": f"select request_id, coalesce(list_reduce(list_prepend('', {_TOK.format('query')}), lambda a, w: case when length(w) > length(a) then w else a end), '') as word from {_Q}",
    "prefix_strip": "select example_id, regexp_replace(input_text, '^correct: ', '') as text from eval_v3",
    "identity_by_text": "select trim(regexp_replace(input_text, '^correct: ', '')) = trim(target_text) as by_text, coalesce(contains(category, 'identity'), false) as by_label, count(*) as n from eval_v3 group by all",
    "byte_tokens": "select example_id, least(strlen(target_text), 127) + 1 as n_ids, case when strlen(target_text) = 0 then 1 else ('0x' || substr(hex(encode(target_text)), 1, 2))::bigint + 3 end as first_id from eval_v3",
    "truncation_rate": "select count(*) filter (strlen(input_text) + 1 > 64) as truncated, count(*) as n from eval_v3",
    "positional_gate": "select result_id, (len(list_filter(range(1, least(length(query), length(corrected)) + 1), lambda i: query[i] <> corrected[i])) + abs(length(query) - length(corrected)))::bigint as diff from results",
    "suggestions": "select result_id, 'Did you mean ''' || corrected || '''?' as suggestion from results where changed",
    "error_counts_by_latency": "select model, floor(latency_ms / 100)::bigint as bucket, count(*) as n from results group by all",
}
