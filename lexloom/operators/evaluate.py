"""Evaluation analytics: accuracy by slice, rates, percentiles, pivots, disagreement, and the analysis of training logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexloom.functions import metrics
from lexloom.functions.text import is_ascii, same_text


def scored(results: DataFrame) -> DataFrame:
    """``ok`` added: the corrected text is the expected one but for case and outer space."""
    return results.withColumn("ok", same_text(F.col("corrected"), F.col("expected")))


def _share(up: Column, n: Column) -> Column:
    return F.when(n > 0, F.round(up / n, 6)).otherwise(F.lit(0.0))


def accuracy_by_slice(results: DataFrame) -> DataFrame:
    """``model, dimension, bucket, correct, total, acc`` of all rows and per difficulty, length and category, in one pass."""
    rows = scored(results.filter("error = ''"))
    dims = ["difficulty", "length", "category"]
    out = rows.groupingSets([["model"], *[["model", d] for d in dims]], "model", *dims).agg(
        F.grouping_id().alias("g"), F.count_if("ok").alias("correct"), F.count(F.lit(1)).alias("total")
    )
    which = F.when(F.col("g") == 7, "all").when(F.col("g") == 3, "difficulty").when(F.col("g") == 5, "length").otherwise("category")
    bucket = F.when(F.col("g") == 7, F.lit("all")).otherwise(F.coalesce(*dims))
    return out.select("model", which.alias("dimension"), bucket.alias("bucket"), "correct", "total", _share(F.col("correct"), F.col("total")).alias("acc"))


def rates(results: DataFrame) -> DataFrame:
    """``model, fp_rate, hit_rate``: clean queries spoiled, and misspelled ones mended."""
    rows = scored(results.filter("error = ''"))
    clean = F.col("difficulty") == "L1"
    return rows.groupBy("model").agg(
        _share(F.count_if(clean & ~F.col("ok")), F.count_if(clean)).alias("fp_rate"), _share(F.count_if(~clean & F.col("ok")), F.count_if(~clean)).alias("hit_rate")
    )


def latency(results: DataFrame) -> DataFrame:
    """``model, mean_ms, p50_ms, p90_ms, p99_ms`` by linear interpolation."""
    p = F.percentile("latency_ms", F.array(F.lit(0.5), F.lit(0.9), F.lit(0.99)))
    out = results.filter("error = '' and latency_ms is not null").groupBy("model").agg(F.avg("latency_ms").alias("m"), p.alias("p"))
    return out.select("model", F.round("m", 4).alias("mean_ms"), *[F.round(F.col("p")[i], 4).alias(f"p{q}_ms") for i, q in enumerate((50, 90, 99))])


def error_counts(results: DataFrame) -> DataFrame:
    return results.groupBy("model").agg(F.count_if(F.col("error") != "").alias("errors"), F.count(F.lit(1)).alias("total"))


def accuracy_pivot(results: DataFrame, by: str, values: list[str]) -> DataFrame:
    """One row a model, one accuracy column a value of ``by``."""
    rows = scored(results.filter("error = ''"))
    return rows.groupBy("model").pivot(by, values).agg(F.round(F.avg(F.col("ok").cast("double")), 6))


def disagreement(results: DataFrame) -> DataFrame:
    """``id, difficulty, models_right, models``: queries some models get right and others wrong (a model's first result counts)."""
    w = Window.partitionBy("id", "model").orderBy("result_id")
    first = scored(results.filter("error = ''")).withColumn("r", F.row_number().over(w)).filter("r = 1")
    out = first.groupBy("id").agg(F.max("difficulty").alias("difficulty"), F.count_if("ok").alias("models_right"), F.count(F.lit(1)).alias("models"), F.bool_or("ok").alias("some"), F.bool_and("ok").alias("every"))
    return out.filter("some and not every").select("id", "difficulty", "models_right", "models")


def hardest(results: DataFrame, n: int = 60) -> DataFrame:
    return disagreement(results).orderBy(F.desc("difficulty"), "id").limit(n)


def side_by_side(results: DataFrame, models: list[str]) -> DataFrame:
    """One row a query, each model's first corrected text beside the others."""
    w = Window.partitionBy("id", "model").orderBy("result_id")
    first = results.withColumn("r", F.row_number().over(w)).filter("r = 1")
    return first.groupBy("id", "query", "expected").pivot("model", models).agg(F.first("corrected"))


def fastest(results: DataFrame) -> DataFrame:
    out = results.filter("error = '' and latency_ms is not null").groupBy("model").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("latency_ms"), 4).alias("avg_ms"), F.min("latency_ms").alias("min_ms"))
    return out


def distribution(df: DataFrame, column: str) -> DataFrame:
    """``value, n, share``, counted once; the total is the sum of the counts."""
    c = df.groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    total = c.agg(F.sum("n").alias("t"))
    return c.join(F.broadcast(total)).select("value", "n", F.round(F.col("n") / F.col("t"), 6).alias("share"))


def tiers(rows: DataFrame, by: str, ok: Column) -> DataFrame:
    """PASS from 80 %, WARN from 60 %, else FAIL."""
    out = rows.groupBy(by).agg(F.avg(ok.cast("double")).alias("acc"))
    return out.select(by, F.round("acc", 6).alias("acc"), F.when(F.col("acc") >= 0.8, "PASS").when(F.col("acc") >= 0.6, "WARN").otherwise("FAIL").alias("tier"))


def failures(results: DataFrame, by: str) -> DataFrame:
    """Wrong results as rows, with the failure's number within its slice."""
    w = Window.partitionBy(by).orderBy("result_id")
    return scored(results.filter("error = ''")).filter(~F.col("ok")).select(by, "result_id", "query", "expected", "corrected", F.row_number().over(w).alias("no"))


def no_harm(rows: DataFrame) -> DataFrame:
    """``n, no_harm``: identity rows left as they were."""
    same = same_text(F.col("query"), F.col("expected"))
    return rows.filter(same & (F.col("error") == "")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(same_text(F.col("corrected"), F.col("query")).cast("double")), 6).alias("no_harm"))


def moving_average(df: DataFrame, key: str, order: str, value: str, alpha: float = 0.1) -> DataFrame:
    """``key, order, ema``: exponential average, the first value as start, by a fold over each key's log.

    A key's log is folded in memory; it is meant for training logs, whose length is bounded by the steps of a run.
    """
    rows = df.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(value).alias("x")))).alias("a"))
    first = F.array(F.struct(F.get("a", F.lit(0))["o"].cast("bigint").alias("o"), F.get("a", F.lit(0))["x"].cast("double").alias("ema")))
    folded = F.aggregate(F.slice("a", F.lit(2), F.greatest(F.size("a"), F.lit(1))), first, lambda acc, r: F.concat(acc, F.array(F.struct(r["o"].cast("bigint").alias("o"), (F.element_at(acc, -1)["ema"] * (1 - alpha) + r["x"] * alpha).alias("ema")))))
    return rows.select(key, F.explode(folded).alias("e")).select(key, F.col("e.o").alias(order), "e.ema")


def running_best(df: DataFrame, key: str, order: str, value: str) -> DataFrame:
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return df.select(key, order, F.max(value).over(w).alias("best"))


def streaks(df: DataFrame, key: str, order: str, happens: Column) -> DataFrame:
    """``key, order, streak``: for how many rows in a row ``happens`` has held, by gaps and islands."""
    w = Window.partitionBy(key).orderBy(order)
    rows = df.select(key, order, F.coalesce(happens, F.lit(False)).alias("h"))
    rows = rows.withColumn("island", F.sum(F.when(F.col("h"), 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    in_island = Window.partitionBy(key, "island").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.select(key, order, F.sum(F.when(F.col("h"), 1).otherwise(0)).over(in_island).alias("streak"))


def last_rows(df: DataFrame, key: str, order: list[str], n: int) -> DataFrame:
    w = Window.partitionBy(key).orderBy(*[F.desc(o) for o in order])
    return df.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= n).drop("_r")


def progress(df: DataFrame, key: str, order: str) -> DataFrame:
    w = Window.partitionBy(key)
    return df.select(key, order, F.round(F.row_number().over(w.orderBy(order)) / F.count(F.lit(1)).over(w), 6).alias("done"))


def benchmark_summary(results: DataFrame) -> DataFrame:
    """Per model, and per model and category: exact matches, identities left alone, token accuracy, character error, latency.

    Overall rows have a NULL category. Failed calls are left out; a slice without identities has a NULL ``no_harm_pct``.
    """
    a, b = F.col("corrected"), F.col("expected")
    same = same_text(F.col("query"), b)
    most = metrics.token_max(a, b)
    rows = results.filter("error = ''").select(
        "model", "category", "latency_ms", same_text(a, b).cast("int").alias("ok"), F.when(same, same_text(a, F.col("query")).cast("int")).alias("kept"),
        F.when(most == 0, F.lit(0.0)).otherwise(metrics.positional_matches(a, b) / most).alias("tok"), (F.levenshtein(a, b) / F.greatest(F.lit(1), F.length(b))).alias("cer"),
    )
    out = rows.groupingSets([["model"], ["model", "category"]], "model", "category").agg(
        F.count(F.lit(1)).alias("n"), F.round(100 * F.avg("ok"), 4).alias("exact_pct"), F.round(100 * F.avg("kept"), 4).alias("no_harm_pct"), F.round(F.avg("tok"), 6).alias("token_acc"),
        F.round(F.avg("cer"), 6).alias("cer"), F.round(F.avg("latency_ms"), 4).alias("mean_ms"), F.percentile("latency_ms", F.array(F.lit(0.5), F.lit(0.95))).alias("p"),
    )
    return out.select("model", "category", "n", "exact_pct", "no_harm_pct", "token_acc", "cer", "mean_ms", F.round(F.col("p")[0], 4).alias("p50_ms"), F.round(F.col("p")[1], 4).alias("p95_ms"))


def most_common(df: DataFrame, column: str, n: int) -> DataFrame:
    """The ``n`` most common values, ties by name."""
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), column).limit(n)


def corpus_counters(examples: DataFrame) -> DataFrame:
    """``rows, targets, pairs, non_ascii, leaked_targets, leaked_pairs`` of a corpus whose rows name their split."""
    e = examples.withColumn("train", F.lower(F.trim("split_name")) == "train")
    text = F.concat(F.coalesce("input_text", F.lit("")), F.coalesce("target_text", F.lit("")))
    one = e.agg(F.count(F.lit(1)).alias("rows"), F.count_if(~is_ascii(text)).alias("non_ascii"))

    def both(keys: list[str], all_name: str, leaked_name: str) -> DataFrame:
        sides = e.dropna(subset=keys).groupBy(*keys).agg(F.bool_or("train").alias("t"), F.bool_or(~F.col("train")).alias("v"))
        return sides.agg(F.count(F.lit(1)).alias(all_name), F.count_if(F.col("t") & F.col("v")).alias(leaked_name))

    # one row each
    return one.crossJoin(both(["target_text"], "targets", "leaked_targets")).crossJoin(both(["input_text", "target_text"], "pairs", "leaked_pairs"))


def report(results: DataFrame, hardest_rows: int = 60) -> str:
    """A report in Markdown: the summary of each model, its accuracy by slice, and the hardest queries beside each other."""
    from lexloom.sources.sinks import markdown_table

    summary = benchmark_summary(results).filter("category is null").drop("category").orderBy("model")
    parts = ["# Evaluation", "", markdown_table(summary), "## Accuracy by slice", "", markdown_table(accuracy_by_slice(results)), "## Hardest queries", "", markdown_table(hardest(results, hardest_rows))]
    return "\n".join(parts)
