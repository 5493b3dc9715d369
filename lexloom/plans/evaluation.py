"""Queries of the evaluation layer."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lexloom.functions import metrics
from lexloom.functions.text import rng_below
from lexloom.operators import evaluate
from lexloom.plans.common import SEED, SQL_PRED, predictions, sql_norm, sql_rng
from lexloom.session import table
from lexloom.sources.readers import per_category_budget

MODELS = ["chat-2b", "corr-base", "corr-large-v3", "corr-small", "seq-large-v2"]
LEVELS = ["L1", "L2", "L3", "L4", "L5"]
_OK = f"{sql_norm('corrected')} = {sql_norm('expected')}"
_SHARE = "case when {1} > 0 then round(({0})::double / {1}, 6) else 0.0 end"


def _results(spark, sf_dir):
    return table(spark, sf_dir, "results")


def _events(spark, sf_dir):
    """The event log as training logs: one run a user, ordered by event."""
    return table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "ts", F.col("value").cast("double").alias("value"))


def _metric(fn):
    def run(spark, sf_dir):
        p = predictions(spark, sf_dir)
        return p.groupBy("model").agg(F.round(fn(F.col("pred"), F.col("label")), 6).alias("metric"))

    return run


def _widening(spark, sf_dir):
    w = Window.partitionBy("user_id").orderBy("event_id")
    e = _events(spark, sf_dir).withColumn("happens", (F.col("value") > F.lag("value").over(w)) & (F.col("value") > 10))
    return evaluate.streaks(e, "user_id", "event_id", F.col("happens"))


def _dropping(spark, sf_dir):
    w = Window.partitionBy("user_id").orderBy("event_id")
    e = _events(spark, sf_dir).withColumn("happens", F.col("value") < F.lag("value").over(w))
    s = evaluate.streaks(e, "user_id", "event_id", F.col("happens"))
    return s.groupBy("user_id").agg(F.max("streak").alias("longest"), (F.max("streak") >= 5).alias("stop"))


QUERIES = {
    "scores_by_group": lambda s, d: evaluate.accuracy_by_slice(_results(s, d)),
    "fp_hit_rates": lambda s, d: evaluate.rates(_results(s, d)),
    "latency_percentiles": lambda s, d: evaluate.latency(_results(s, d)),
    "accuracy_pivot": lambda s, d: evaluate.accuracy_pivot(_results(s, d), "difficulty", LEVELS),
    "model_disagreement": lambda s, d: evaluate.disagreement(_results(s, d)),
    "hardest_queries": lambda s, d: evaluate.hardest(_results(s, d)),
    "error_counts": lambda s, d: evaluate.error_counts(_results(s, d)),
    "side_by_side": lambda s, d: evaluate.side_by_side(_results(s, d), MODELS),
    "fastest_model": lambda s, d: evaluate.fastest(_results(s, d)),
    "category_distribution": lambda s, d: evaluate.distribution(table(s, d, "eval_v3"), "category"),
    "source_share": lambda s, d: evaluate.distribution(table(s, d, "documents"), "source"),
    "accuracy_tiers": lambda s, d: evaluate.tiers(evaluate.scored(_results(s, d).filter("error = ''")), "category", F.col("ok")),
    "failure_list": lambda s, d: evaluate.failures(_results(s, d), "category"),
    "no_harm_rate": lambda s, d: evaluate.no_harm(_results(s, d)),
    "identity_correction_accuracy": lambda s, d: (
        evaluate.scored(_results(s, d).filter("error = ''")).withColumn("bucket", F.when(F.lower("query") == F.lower("expected"), "identity").otherwise("correction"))
        .groupBy("model", "bucket").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.col("ok").cast("double")), 6).alias("acc"))
    ),
    "batch_stats": lambda s, d: _results(s, d).filter("latency_ms is not null").groupBy("run_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("latency_ms"), 2).alias("total_ms"), F.round(F.avg("latency_ms"), 2).alias("avg_ms")),
    "metric_sentence_acc": _metric(metrics.sentence_accuracy),
    "metric_lev_avg": _metric(metrics.average_edits),
    "metric_token_acc_max": _metric(metrics.token_accuracy_max),
    "metric_token_acc_label": _metric(metrics.token_accuracy_label),
    "metric_jaccard": _metric(metrics.mean_jaccard),
    "metric_word_f1": _metric(metrics.mean_word_f1),
    "metric_cer_macro": _metric(metrics.cer_macro),
    "metric_cer_micro": _metric(metrics.cer_micro),
    "metric_cer_positional": _metric(metrics.cer_positional),
    "metric_exact_match": _metric(metrics.exact_match),
    "ema": lambda s, d: evaluate.moving_average(_events(s, d), "user_id", "event_id", "value").withColumn("ema", F.round("ema", 6)),
    "running_best": lambda s, d: evaluate.running_best(_events(s, d), "user_id", "event_id", "value"),
    "widen_streak": _widening,
    "drop_streak": _dropping,
    "last_n_log": lambda s, d: evaluate.last_rows(_events(s, d), "event_type", ["ts", "event_id"], 120).select("event_type", "event_id"),
    "progress_ratio": lambda s, d: evaluate.progress(_events(s, d), "user_id", "event_id"),
    "budget_per_group": lambda s, d: (
        table(s, d, "documents").withColumn("k", rng_below(2**31, SEED, F.col("doc_id"), "budget")).transform(lambda x: per_category_budget(x, "source", F.struct("k", "doc_id"), 50)).select("source", "doc_id")
    ),
    "best_checkpoint": lambda s, d: _events(s, d).groupBy("user_id").agg(F.max_by("event_id", F.struct("value", "event_id")).alias("step"), F.max("value").alias("best")),
}

_TOK = "list_filter(regexp_split_to_array({0}, '[\\s\\p{{Z}}]+'), lambda w: w <> '')"
_A, _B = _TOK.format("pred"), _TOK.format("label")


def _m(expr: str) -> str:
    return f"with p as (select *, {_A} as a, {_B} as b from {SQL_PRED}) select model, round({expr}, 6) as metric from p group by model"


_MATCH = "len(list_filter(range(1, least(len(a), len(b)) + 1), lambda i: a[i] = b[i]))"
_SHARED = "coalesce(list_sum(list_transform(list_distinct(a), lambda w: least(len(list_filter(a, lambda v: v = w)), len(list_filter(b, lambda v: v = w))))), 0)"
_POS = "(len(list_filter(range(1, least(length(pred), length(label)) + 1), lambda i: pred[i] <> label[i])) + abs(length(pred) - length(label)))"
_FIRST = f"(select *, {_OK} as ok, row_number() over (partition by id, model order by result_id) as r from results where error = '')"

# DuckDB counts bytes: accented letters become single bytes first, so that a letter is one edit
_BYTES = "éèàñöüçáíóúäëïâêîôûÉÈÀÑÖÜ€"


def _lev(a: str, b: str) -> str:
    plain = "translate({0}, '" + _BYTES + "', '" + "".join(chr(1 + i) for i in range(len(_BYTES))) + "')"
    return f"levenshtein({plain.format(a)}, {plain.format(b)})"


SQL = {
    "scores_by_group": f"""
with r as (select model, difficulty, length, category, {_OK} as ok from results where error = ''),
u as (select model, 'all' as dimension, 'all' as bucket, ok from r union all select model, 'difficulty', difficulty, ok from r
      union all select model, 'length', length, ok from r union all select model, 'category', category, ok from r)
select model, dimension, bucket, count(*) filter (ok) as correct, count(*) as total, round(count(*) filter (ok) / count(*), 6) as acc from u group by all""",
    "fp_hit_rates": f"""
with r as (select model, difficulty = 'L1' as clean, {_OK} as ok from results where error = '')
select model, {_SHARE.format('count(*) filter (clean and not ok)', 'count(*) filter (clean)')} as fp_rate,
       {_SHARE.format('count(*) filter (not clean and ok)', 'count(*) filter (not clean)')} as hit_rate from r group by model""",
    "latency_percentiles": """
select model, round(avg(latency_ms), 4) as mean_ms, round(quantile_cont(latency_ms, 0.5), 4) as p50_ms, round(quantile_cont(latency_ms, 0.9), 4) as p90_ms,
       round(quantile_cont(latency_ms, 0.99), 4) as p99_ms from results where error = '' and latency_ms is not null group by model""",
    "accuracy_pivot": f"select model, {', '.join(f"round(avg(case when difficulty = '{x}' then ({_OK})::int end), 6) as {x}" for x in LEVELS)} from results where error = '' group by model",
    "model_disagreement": f"select id, max(difficulty) as difficulty, count(*) filter (ok) as models_right, count(*) as models from {_FIRST} where r = 1 group by id having bool_or(ok) and not bool_and(ok)",
    "hardest_queries": f"select id, max(difficulty) as difficulty, count(*) filter (ok) as models_right, count(*) as models from {_FIRST} where r = 1 group by id having bool_or(ok) and not bool_and(ok) order by max(difficulty) desc, id limit 60",
    "error_counts": "select model, count(*) filter (error <> '') as errors, count(*) as total from results group by model",
    "side_by_side": "with f as (select *, row_number() over (partition by id, model order by result_id) as r from results) select id, query, expected, " + ", ".join(f"max(case when model = '{m}' then corrected end) as \"{m}\"" for m in MODELS) + " from f where r = 1 group by id, query, expected",
    "fastest_model": "select model, count(*) as n, round(avg(latency_ms), 4) as avg_ms, min(latency_ms) as min_ms from results where error = '' and latency_ms is not null group by model",
    "category_distribution": "select category as value, count(*) as n, round(count(*) / (select count(*) from eval_v3), 6) as share from eval_v3 group by category",
    "source_share": "select source as value, count(*) as n, round(count(*) / (select count(*) from documents), 6) as share from documents group by source",
    "accuracy_tiers": f"with t as (select category, avg(({_OK})::int) as a from results where error = '' group by category) select category, round(a, 6) as acc, case when a >= 0.8 then 'PASS' when a >= 0.6 then 'WARN' else 'FAIL' end as tier from t",
    "failure_list": f"select category, result_id, query, expected, corrected, row_number() over (partition by category order by result_id) as no from results where error = '' and not ({_OK})",
    "no_harm_rate": f"select count(*) as n, round(avg(({sql_norm('corrected')} = {sql_norm('query')})::int), 6) as no_harm from results where error = '' and {sql_norm('query')} = {sql_norm('expected')}",
    "identity_correction_accuracy": f"select model, case when lower(query) = lower(expected) then 'identity' else 'correction' end as bucket, count(*) as n, round(avg(({_OK})::int), 6) as acc from results where error = '' group by all",
    "batch_stats": "select run_id, count(*) as n, round(sum(latency_ms), 2) as total_ms, round(avg(latency_ms), 2) as avg_ms from results where latency_ms is not null group by run_id",
    "metric_sentence_acc": _m("avg((pred = label)::int)"),
    "metric_lev_avg": _m(f"avg({_lev('pred', 'label')})"),
    "metric_cer_macro": _m(f"avg({_lev('pred', 'label')} / greatest(1, length(label)))"),
    "metric_cer_micro": _m(f"sum({_lev('pred', 'label')}) / sum(greatest(length(label), 1))"),
    "metric_token_acc_max": _m(f"sum({_MATCH}) / sum(greatest(len(a), len(b)))"),
    "metric_token_acc_label": _m(f"sum({_MATCH}) / sum(len(b))"),
    "metric_jaccard": _m("avg(case when len(list_distinct(list_concat(a, b))) = 0 then 1.0 else len(list_intersect(list_distinct(a), list_distinct(b))) / len(list_distinct(list_concat(a, b))) end)"),
    "metric_word_f1": _m(f"avg(case when {_SHARED} = 0 then 0.0 else 2.0 * ({_SHARED} / len(a)) * ({_SHARED} / len(b)) / ({_SHARED} / len(a) + {_SHARED} / len(b)) end)"),
    "metric_cer_positional": _m(f"sum({_POS}) / sum(greatest(length(label), 1))"),
    "metric_exact_match": _m("avg((lower(trim(pred)) = lower(trim(label)))::int)"),
    "ema": """
with recursive e as (select user_id, event_id, value::double as x, row_number() over (partition by user_id order by event_id) as r from events),
f as (select user_id, event_id, r, x as ema from e where r = 1 union all select e.user_id, e.event_id, e.r, f.ema * 0.9 + e.x * 0.1 from f join e on e.user_id = f.user_id and e.r = f.r + 1)
select user_id, event_id, round(ema, 6) as ema from f""",
    "running_best": "select user_id, event_id, max(value::double) over (partition by user_id order by event_id rows unbounded preceding) as best from events",
    "widen_streak": """
with e as (select user_id, event_id, coalesce(value > lag(value) over (partition by user_id order by event_id) and value > 10, false) as h from events),
i as (select *, sum(case when h then 0 else 1 end) over (partition by user_id order by event_id rows unbounded preceding) as island from e)
select user_id, event_id, sum(case when h then 1 else 0 end) over (partition by user_id, island order by event_id rows unbounded preceding)::bigint as streak from i""",
    "drop_streak": """
with e as (select user_id, event_id, coalesce(value < lag(value) over (partition by user_id order by event_id), false) as h from events),
i as (select *, sum(case when h then 0 else 1 end) over (partition by user_id order by event_id rows unbounded preceding) as island from e),
s as (select user_id, sum(case when h then 1 else 0 end) over (partition by user_id, island order by event_id rows unbounded preceding)::bigint as streak from i)
select user_id, max(streak) as longest, max(streak) >= 5 as stop from s group by user_id""",
    "last_n_log": "select event_type, event_id from (select *, row_number() over (partition by event_type order by ts desc, event_id desc) as r from events) where r <= 120",
    "progress_ratio": "select user_id, event_id, round(row_number() over (partition by user_id order by event_id) / count(*) over (partition by user_id), 6) as done from events",
    "budget_per_group": f"select source, doc_id from (select source, doc_id, row_number() over (partition by source order by {sql_rng('budget', 2**31, 'doc_id')}, doc_id) as r from documents) where r <= 50",
    "best_checkpoint": "select user_id, arg_max(event_id, {'v': value::double, 'e': event_id}) as step, max(value::double) as best from events group by user_id",
}
