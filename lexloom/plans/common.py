"""Pieces the query modules share: inputs made of the test tables, and their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.functions.text import tokens
from lexloom.session import table

SEED = 42
# Small dictionaries the queries join with.
TEMPLATES = ["{b} {p}", "buy {b} {p}", "best {p} {b}", "{b} {p} sale", "cheap {b} {p} online"]
MODIFIERS = ["wireless", "gaming", "new", "mini", "portable", "cheap"]


def sql_rng(slot: str, n: str | int, row: str = "id", seed: int = SEED) -> str:
    """`rng_below` in DuckDB."""
    return f"(('0x' || substr(md5(concat_ws('|', '{seed}', {row}, '{slot}')), 1, 8))::bigint % ({n}))"


SQL_NORM = "lower(regexp_replace(coalesce({0}, ''), '^[\\s\\p{{Z}}]+|[\\s\\p{{Z}}]+$', '', 'g'))"


def sql_norm(x: str) -> str:
    return SQL_NORM.format(x)


def part_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``id, w, q``: each part's first word and whole name."""
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.split("p_name", " ")[0].alias("w"), F.col("p_name").alias("q"))


SQL_PART = "(select p_partkey as id, string_split(p_name, ' ')[1] as w, p_name as q from part)"


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``pred, label`` of the evaluation results without failed calls."""
    return table(spark, sf_dir, "results").filter("error = '' and corrected is not null and expected is not null").select("result_id", "model", F.col("corrected").alias("pred"), F.col("expected").alias("label"), "query")


SQL_PRED = "(select result_id, model, corrected as pred, expected as label, query from results where error = '' and corrected is not null and expected is not null)"


def word_pairs(s, d):
    """Typo mappings learned from the labelled queries: words that differ at one place of texts of equal length."""
    q = table(s, d, "eval_queries").withColumn("z", F.arrays_zip(tokens(F.col("query")).alias("a"), tokens(F.col("expected")).alias("b")))
    q = q.filter(F.size(tokens(F.col("query"))) == F.size(tokens(F.col("expected"))))
    return q.select(F.explode("z").alias("z")).select(F.lower("z.a").alias("wrong"), F.col("z.b").alias("right")).filter("wrong <> lower(right)").distinct()
