"""Writers of the output formats."""

from __future__ import annotations

import base64
import gzip

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def json_lines(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def stats_document(counters: DataFrame, path: str) -> None:
    """One JSON document of a one-row table of counters."""
    counters.coalesce(1).write.mode("overwrite").json(path)


def pair_rows(pairs: DataFrame) -> DataFrame:
    """Pairs as they are written: once each, never with equal sides."""
    return pairs.filter("wrong <> right").dropDuplicates(["wrong", "right"])


def pairs_tsv(pairs: DataFrame, path: str, identities: bool = False) -> None:
    """Tab-separated pairs; with ``identities`` equal sides are kept, as an identity file needs."""
    rows = pairs.dropDuplicates(["wrong", "right"]) if identities else pair_rows(pairs)
    rows.select("wrong", "right").write.mode("overwrite").csv(path, sep="\t")


def results_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True)


def comparison_csv(pivot: DataFrame, path: str) -> None:
    pivot.coalesce(1).write.mode("overwrite").csv(path, header=True)


def combined_pairs(pairs: DataFrame, path: str) -> None:
    pairs.select(F.col("wrong").alias("misspelled"), F.col("right").alias("correct"), "source").write.mode("overwrite").json(path)


def append_results(new: DataFrame, path: str, keys: list[str]) -> None:
    """Append the results that are not there yet; a run that was broken off goes on where it stopped."""
    try:
        done = new.sparkSession.read.parquet(path).select(*keys)
        new = new.join(done, keys, "left_anti")
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
    new.write.mode("append").parquet(path)


def embedded(df: DataFrame) -> DataFrame:
    """``blob``: the rows as gzipped, base64-encoded JSON lines, one blob per partition."""
    lines = df.select(F.to_json(F.struct(*df.columns)).alias("j"))

    def run(batches):
        rows = [j for pdf in batches for j in pdf["j"]]
        if rows:
            yield pd.DataFrame({"blob": [base64.b64encode(gzip.compress("\n".join(rows).encode(), mtime=0)).decode()]})

    return lines.mapInPandas(run, "blob string")


def markdown_table(df: DataFrame, most: int = 1000) -> str:
    """A report table of a result of bounded size."""
    rows = df.limit(most).collect()
    head = "| " + " | ".join(df.columns) + " |\n|" + "---|" * len(df.columns) + "\n"
    return head + "".join("| " + " | ".join("" if v is None else str(v) for v in r) + " |\n" for r in rows)
