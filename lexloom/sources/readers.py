"""Readers of the text formats. A missing file gives an empty table of the right shape; row order is explicit where it counts."""

from __future__ import annotations

import base64
import gzip

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

CATALOG = "canonical string, brand string, category string, exact_aliases array<string>, symspell_eligible boolean, min_match_length int"
EXAMPLES = "input_text string, target_text string, category string"
PAIRS = "wrong string, right string"


def _missing(e: Exception) -> bool:
    return "PATH_NOT_FOUND" in str(e) or "does not exist" in str(e)


def lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``value, file, ord``: the lines of one or more files; ``ord`` follows the order within a file."""
    try:
        df = spark.read.text(path if isinstance(path, list) else [path])
    except Exception as e:
        if not _missing(e):
            raise
        return spark.createDataFrame([], "value string, file string, ord bigint")
    return df.select("value", F.col("_metadata.file_path").alias("file"), (F.col("_metadata.file_block_start") * F.lit(2**20) + F.monotonically_increasing_id() % F.lit(2**33)).alias("ord"))


def with_defaults(catalog: DataFrame) -> DataFrame:
    """The catalogue's defaults for what an entry leaves out."""
    return catalog.filter(F.col("canonical").isNotNull() & (F.col("canonical") != "")).select(
        "canonical",
        F.coalesce("brand", "canonical").alias("brand"),
        F.coalesce("category", F.lit("general")).alias("category"),
        F.coalesce("exact_aliases", F.array("canonical")).alias("exact_aliases"),
        F.coalesce("symspell_eligible", F.lit(False)).alias("symspell_eligible"),
        F.coalesce("min_match_length", F.greatest(F.lit(4), F.length("canonical") - 1)).alias("min_match_length"),
    )


def read_catalog(spark: SparkSession, path: str) -> DataFrame:
    """A catalogue of JSON lines; blank and comment lines, malformed JSON and rows without a name are skipped."""
    raw = lines(spark, path).filter((F.trim("value") != "") & ~F.trim("value").startswith("#"))
    return with_defaults(raw.select(F.from_json("value", CATALOG).alias("r")).select("r.*"))


def word_list(spark: SparkSession, path: str, comments: bool = True, skip_rules: bool = False) -> DataFrame:
    """``word``: distinct lower-case lines. Comments start with #, rules with =; each is skipped on request."""
    w = lines(spark, path).select(F.lower(F.trim("value")).alias("word")).filter("word <> ''")
    if comments:
        w = w.filter(~F.col("word").startswith("#"))
    if skip_rules:
        w = w.filter(~F.col("word").startswith("="))
    return w.distinct()


def typo_mappings(raw: DataFrame, strict: bool = False, lower: bool = True) -> DataFrame:
    """``wrong, right`` from ``typo,correct`` lines split at the first comma; ``strict`` drops empty and equal sides."""
    v = F.trim("value")
    at = F.instr(v, ",")
    rows = raw.filter((v != "") & ~v.startswith("#") & (at > 0)).select(F.trim(F.substring(v, F.lit(1), at - 1)).alias("wrong"), F.trim(F.substring(v, at + 1, F.length(v))).alias("right"))
    if lower:
        rows = rows.select(F.lower("wrong").alias("wrong"), F.lower("right").alias("right"))
    return rows.filter("wrong <> '' and right <> '' and wrong <> right") if strict else rows


def csv_pairs(spark: SparkSession, path: str) -> DataFrame:
    """``wrong, right`` of a quoted CSV file with a header, both sides filled."""
    try:
        df = spark.read.csv(path, header=True, quote='"', escape='"')
    except Exception as e:
        if not _missing(e):
            raise
        return spark.createDataFrame([], PAIRS)
    a, b = df.columns[:2]
    return df.select(F.trim(df[a]).alias("wrong"), F.trim(df[b]).alias("right")).filter("wrong <> '' and right <> ''")


def quoted_pairs(raw: DataFrame) -> DataFrame:
    """``wrong, right`` in lower case of lines split at ``","``, else at the first comma. Only a file's first line can be
    its header, and is one if it says noisy or clean. A line with several ``","`` is split at its first comma."""
    v = F.trim("value")
    quoted = F.size(F.split(v, '","')) == 2
    a = F.when(quoted, F.regexp_extract(v, r'^"?(.*?)","', 1)).otherwise(F.regexp_extract(v, r"^([^,]*),", 1))
    b = F.when(quoted, F.regexp_extract(v, r'^"?.*?","(.*?)"?$', 1)).otherwise(F.regexp_extract(v, r"^[^,]*,(.*)$", 1))
    head = raw.groupBy("file").agg(F.min("ord").alias("_first"))
    header = (F.col("ord") == F.col("_first")) & F.lower(v).rlike("noisy|clean")
    rows = raw.join(F.broadcast(head), "file").filter((v != "") & v.contains(",") & ~header)
    bare = lambda c: F.lower(F.regexp_replace(F.trim(c), r'^"+|"+$', ""))
    return rows.select(bare(a).alias("wrong"), bare(b).alias("right")).filter("wrong <> '' and right <> ''")


SEPARATORS = ["->", "=>", "\t", "|", ",", ":"]


def _ahead(raw: DataFrame) -> DataFrame:
    """Each line with the last ``$word`` before it in its file."""
    w = Window.partitionBy("file").orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)
    return raw.withColumn("marker", F.last(F.when(F.trim("value").startswith("$"), F.trim(F.substr(F.trim("value"), F.lit(2)))), ignorenulls=True).over(w))


def external_pairs(raw: DataFrame) -> DataFrame:
    """``wrong, right, ord`` of lines in any of the usual forms.

    The first separator of ``SEPARATORS`` that occurs splits the line. A ``$word`` line names the right word of the bare
    lines after it; a line of exactly two words is a pair. A pair of equal sides is none.
    """
    v = F.trim("value")
    rows = _ahead(raw).filter((v != "") & ~v.startswith("#") & ~v.startswith("$"))
    sep = F.lit(None).cast("string")
    for s in reversed(SEPARATORS):
        sep = F.when(v.contains(s), F.lit(s)).otherwise(sep)
    at = F.position(sep, v)
    words = F.filter(F.split(v, r"\s+"), lambda w: w != "")
    wrong = F.when(sep.isNotNull(), F.substring(v, F.lit(1), at - 1)).when(F.col("marker").isNotNull(), v).when(F.size(words) == 2, words[0])
    right = F.when(sep.isNotNull(), F.substring(v, at + F.length(sep), F.length(v))).when(F.col("marker").isNotNull(), F.col("marker")).when(F.size(words) == 2, words[1])
    return rows.select(F.lower(F.trim(wrong)).alias("wrong"), F.lower(F.trim(right)).alias("right"), "ord").filter("wrong <> '' and right <> '' and wrong <> right")


def block_pairs(raw: DataFrame) -> DataFrame:
    """``wrong, right`` of blocks: a ``$correct`` line, then its misspellings."""
    rows = _ahead(raw).filter(~F.trim("value").startswith("$") & (F.trim("value") != "") & F.col("marker").isNotNull())
    return rows.select(F.lower(F.trim("value")).alias("wrong"), F.lower("marker").alias("right"))


def arrow_pairs(raw: DataFrame) -> DataFrame:
    """``wrong, right`` of ``wrong->right1, right2`` lines (first option) and of ``word (correct, ...)`` lines."""
    v = F.trim("value")
    a = F.split(v, "->", 2)
    arrow = v.contains("->")
    wrong = F.when(arrow, a[0]).otherwise(F.regexp_extract(v, r"^(\S+)\s*\(", 1))
    right = F.when(arrow, F.split(a[1], ",")[0]).otherwise(F.regexp_extract(v, r"\(([^,)]*)", 1))
    return raw.select(F.lower(F.trim(wrong)).alias("wrong"), F.lower(F.trim(right)).alias("right")).filter("wrong <> '' and right <> ''")


def grouped_pairs(raw: DataFrame) -> DataFrame:
    """``wrong, right`` of ``correct: w1 w2`` lines, commas allowed: one row a misspelling."""
    v = F.col("value")
    rows = raw.filter(v.contains(":")).select(F.lower(F.trim(F.split(v, ":", 2)[0])).alias("right"), F.explode(F.split(F.trim(F.split(v, ":", 2)[1]), r"[\s,]+")).alias("w"))
    return rows.select(F.lower("w").alias("wrong"), "right").filter("wrong <> '' and right <> ''")


def json_examples(spark: SparkSession, path: str | list[str], schema: str = EXAMPLES) -> DataFrame:
    return spark.read.schema(schema).json(path)


def real_pairs(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """``(identities, corrections)`` of JSON lines ``misspelled, correct, source``; malformed lines are skipped."""
    df = spark.read.schema("misspelled string, correct string, source string").json(path).filter("misspelled is not null and correct is not null")
    return df.filter("misspelled = correct"), df.filter("misspelled <> correct")


def sampled(df: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """``n`` rows, the same on every run: those with the smallest keyed hash."""
    return df.orderBy(F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(key).cast("string"))), key).limit(n)


def per_category_budget(df: DataFrame, category: str, order: Column, budget: int) -> DataFrame:
    w = Window.partitionBy(category).orderBy(order)
    return df.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= budget).drop("_r")


def search_log(df: DataFrame, locale: str = "us", label: str = "E") -> DataFrame:
    """Distinct queries of one locale whose product was an exact match."""
    return df.filter((F.col("product_locale") == locale) & (F.col("esci_label") == label)).select("query").distinct()


def corpora(spark: SparkSession, paths: list[str], own_outputs: list[str]) -> DataFrame:
    """Lines of the listed files, without the pipeline's own outputs."""
    raw = lines(spark, paths)
    return raw.filter(~F.element_at(F.split("file", "/"), -1).isin(own_outputs)) if own_outputs else raw


def embedded_examples(df: DataFrame, blob: str) -> DataFrame:
    """``input_text, target_text`` of gzipped, base64-encoded JSON lines, one blob a row."""

    @F.pandas_udf("array<string>")
    def unpack(c: pd.Series) -> pd.Series:
        return c.map(lambda b: gzip.decompress(base64.b64decode(b)).decode("utf-8").splitlines())

    rows = df.select(F.explode(unpack(F.col(blob))).alias("j"))
    return rows.select(F.from_json("j", "input_text string, target_text string").alias("r")).select("r.*").filter("input_text is not null")


def evaluation_rows(spark: SparkSession, path: str) -> DataFrame:
    """Labelled evaluation queries of a JSON array."""
    schema = "id string, query string, expected string, length string, difficulty string, category string, notes string"
    return spark.read.schema(schema).json(path, multiLine=True)


