"""The queries of the operators for training data, over whole tables and with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.llm import canonical_map, group_split, leakage, lookalike, oracles, packing, qdigest, quota_sample, split_overlap, truncation
from lexloom.session import cut, table

QUANTILES = [0.5, 0.9, 0.99]


def _mapped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return canonical_map.map_to_canonical(table(spark, sf_dir, "correction_requests"), table(spark, sf_dir, "brand_catalog"), "request_id", "query")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mapped(spark, sf_dir).filter(F.col("canonical").isNotNull()).select(F.col("id").alias("request_id"), "canonical")


def p1_unmatched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The requests that name no entry, with their query."""
    return _mapped(spark, sf_dir).filter(F.col("canonical").isNull()).select(F.col("id").alias("request_id"), F.col("value").alias("query"))


def _split(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = group_split.target_key(F.col("target_text"))
    return group_split.grouped_split(table(spark, sf_dir, "eval_v3"), "example_id", [key], "category", table(spark, sf_dir, "split_plan"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _split(spark, sf_dir).filter("n_component > 1").select("example_id", "first_id")


def p2_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _split(spark, sf_dir)


def p2_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each group of rows of one target, with the number of splits its rows are in."""
    out = _split(spark, sf_dir).groupBy("first_id").agg(F.count(F.lit(1)).alias("rows"), F.first("n_component").alias("n_component"), F.count_distinct("split").alias("splits"))
    return out


def _sample(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return quota_sample.quota_sample(table(spark, sf_dir, "eval_v3"), "example_id", "category", table(spark, sf_dir, "category_plan"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sample(spark, sf_dir)[1].filter("short").select("category")


def p3_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sample(spark, sf_dir)[0]


def p3_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sample(spark, sf_dir)[1]


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = split_overlap.overlaps(table(spark, sf_dir, "eval_v3"))
    return pairs.select(F.least("train_id", "eval_id").alias("example_id_a"), F.greatest("train_id", "eval_id").alias("example_id_b"))


def p4_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split_overlap.coverage(table(spark, sf_dir, "eval_v3"))


def p4_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each evaluation row with its partners in train and the part of its words they cover."""
    rows = split_overlap.record_coverage(table(spark, sf_dir, "eval_v3"))
    return rows.select(F.col("id").alias("example_id"), "split", "source", "partners", F.round("coverage", 6).alias("coverage"))


def _run_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cut(qdigest.digests(table(spark, sf_dir, "results"), "latency_ms", ["model", "run_id"], F.col("error") == ""))


def _all_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The runs' digests, and per model the digest that the runs combine to (run_id NULL)."""
    runs = _run_digests(spark, sf_dir)
    whole = qdigest.merge(runs, ["model"]).select("model", F.lit(None).cast("string").alias("run_id"), "node", "count")
    return runs.unionByName(whole)


def p5_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The form in which days combine: counted nodes per model and run, and per model (run_id NULL)."""
    return _all_digests(spark, sf_dir)


def p5_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per model and run, and per model from the runs' digests (run_id NULL)."""
    out = qdigest.read_quantiles(_all_digests(spark, sf_dir), ["model", "run_id"], QUANTILES)
    return out.withColumns({"estimate": F.round("estimate", 6), "value_error": F.round("value_error", 6)})


def p5_within_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each model's merged estimate among all rows: ``below`` and ``upto`` count the rows under it and up to it, a value
    error on either side; the true rank is met where it lies between them, give or take the rank error."""
    est = qdigest.read_quantiles(qdigest.merge(_run_digests(spark, sf_dir), ["model"]), ["model"], QUANTILES)
    rows = table(spark, sf_dir, "results").filter((F.col("error") == "") & F.col("latency_ms").isNotNull() & ~F.isnan("latency_ms"))
    # three rows for each model, a closed list of names
    wide = est.withColumns({"lo": F.round(F.col("estimate") * (1 - 1.01 * F.col("value_error")), 6), "hi": F.round(F.col("estimate") * (1 + 1.01 * F.col("value_error")), 6)})
    v = F.col("latency_ms")
    ranks = rows.select(F.col("model").alias("m"), "latency_ms").join(F.broadcast(wide), F.col("m").eqNullSafe(F.col("model")))
    seen = ranks.groupBy("model", "q", "n", "rank_error").agg(F.count_if(v < F.col("lo")).alias("below"), F.count_if(v <= F.col("hi")).alias("upto"))
    rank = F.ceil(F.col("q") * F.col("n"))
    within = (F.col("below") < rank + F.col("rank_error")) & (F.col("upto") >= rank - F.col("rank_error"))
    return seen.select("model", "q", "n", "rank_error", "below", "upto", within.alias("within"))


TEXTS = [("correction_requests", "request_id", "query"), ("eval_v3", "example_id", "input_text")]


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both tables' texts as one, so that equal-looking texts of either compare equal."""
    parts = [table(spark, sf_dir, n).select(F.lit(n).alias("table_name"), F.col(i).alias("row_id"), F.col(t).alias("text")) for n, i, t in TEXTS]
    return parts[0].unionByName(parts[1]).withColumn("id", F.struct("table_name", "row_id"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows whose text is not the form its class agreed on, held exactly against the characters that make it odd."""
    rows = lookalike.consistent_form(_texts(spark, sf_dir), "id", "text", only_odd=True)
    differs = F.lower(lookalike.one_space(F.col("value"))) != F.lower("canonical")
    return rows.filter(differs & F.col("odd")).select("id.table_name", "id.row_id")


def p6_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row's consistent form."""
    return lookalike.consistent_form(_texts(spark, sf_dir), "id", "text").select("id.table_name", "id.row_id", "canonical", "class_rows")


def p7_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack_all(table(spark, sf_dir, "documents"), "doc_id", "text", table(spark, sf_dir, "containers"))
    return packed.withColumnRenamed("id", "doc_id")


def p7_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per container: texts, pieces and tokens placed, containers filled over their capacity and texts split without need."""
    packed = cut(p7_containers(spark, sf_dir).filter("bin is not null"))
    cap = table(spark, sf_dir, "containers").select("container", "capacity_tokens")
    over = packed.groupBy("container", "bin").agg(F.sum("size").alias("fill")).join(F.broadcast(cap), "container")
    over = over.groupBy("container").agg(F.count_if(F.col("fill") > F.col("capacity_tokens")).alias("overfull"))
    texts = packed.groupBy("container", "doc_id").agg(F.count(F.lit(1)).alias("pieces"), F.sum("size").alias("tokens")).join(F.broadcast(cap), "container")
    needless = F.count_if((F.col("pieces") > 1) & (F.col("tokens") <= F.col("capacity_tokens")))
    sums = texts.groupBy("container").agg(F.count(F.lit(1)).alias("texts"), F.sum("pieces").alias("pieces"), F.sum("tokens").alias("tokens"), needless.alias("split_needlessly"))
    return sums.join(over, "container")


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leakage.leaked_passages(table(spark, sf_dir, "documents"), table(spark, sf_dir, "heldout_passages"))


def p8_reworded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leakage.reworded_questions(table(spark, sf_dir, "documents"), table(spark, sf_dir, "heldout_passages"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    ends = truncation.scored_endings(table(spark, sf_dir, "documents"), "doc_id", "text", "source")
    return ends.filter("truncated").select(F.col("id").alias("doc_id"))


def p9_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return truncation.truncation_rates(table(spark, sf_dir, "documents"), "doc_id", "text", "source")


def p9_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lengths at which a source cuts its texts."""
    ends = truncation.endings(table(spark, sf_dir, "documents"), "doc_id", "text", "source")
    limits = truncation.length_hazards(cut(ends.select("source", "chars", "bytes"))).filter("significant")
    return limits.select("source", "unit", "length", "n", "at_risk", F.round("hazard", 6).alias("hazard"), F.round("surplus", 6).alias("surplus"))


def p9_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each truncated text with its reason: cut at a limit of its source, or broken off at any length."""
    ends = truncation.scored_endings(table(spark, sf_dir, "documents"), "doc_id", "text", "source")
    return ends.filter("truncated").select(F.col("id").alias("doc_id"), "source", "reason", F.when(F.col("place") != "", F.col("place")).alias("limit"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "p1_found": p1_found, "p1_unmatched": p1_unmatched,
        "p2_found": p2_found, "p2_split": p2_split, "p2_groups": p2_groups,
        "p3_found": p3_found, "p3_sample": p3_sample, "p3_report": p3_report,
        "p4_found": p4_found, "p4_coverage": p4_coverage, "p4_records": p4_records,
        "p5_digests": p5_digests, "p5_percentiles": p5_percentiles, "p5_within_bounds": p5_within_bounds,
        "p6_found": p6_found, "p6_forms": p6_forms,
        "p7_containers": p7_containers, "p7_fill": p7_fill,
        "p8_found": p8_found, "p8_reworded": p8_reworded,
        "p9_found": p9_found, "p9_rates": p9_rates, "p9_limits": p9_limits, "p9_reasons": p9_reasons,
    }


def oracle_sql() -> dict[str, str]:
    return {"p2_found": oracles.P2_FOUND, "p2_groups": oracles.P2_GROUPS, "p3_found": oracles.P3_FOUND, "p4_found": oracles.P4_FOUND, "p4_coverage": oracles.P4_COVERAGE, "p4_records": oracles.P4_RECORDS, "p5_digests": oracles.P5_DIGESTS, "p5_percentiles": oracles.P5_PERCENTILES, "p5_within_bounds": oracles.P5_WITHIN, "p6_found": oracles.P6_FOUND, "p6_forms": oracles.P6_FORMS, "p7_fill": oracles.P7_FILL, "p8_found": oracles.P8_FOUND, "p8_reworded": oracles.P8_REWORDED, "p9_limits": oracles.P9_LIMITS}
