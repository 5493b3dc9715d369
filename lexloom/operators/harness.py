"""Running models over labelled queries: warm-up, retries, error rows, resumable by the sink that appends new results."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.functions.text import changed

WARM_UP_TRIES = 5
TRIES = 3
RESULT = "model string, {0}, corrected string, latency_ms double, error string"


def _called(model: Callable[[str], str], text: str, tries: int, pause: float) -> tuple[str, float, str]:
    """``(output, ms, error)``; waits longer after each failed try. After the last the output is empty and the error stays."""
    error = ""
    for k in range(tries):
        began = time.perf_counter()
        try:
            return model(text), round((time.perf_counter() - began) * 1000, 2), ""
        except Exception as e:
            error = f"{type(e).__name__}: {e}"
            if k + 1 < tries:
                time.sleep(pause * (k + 1))
    return "", 0.0, error


def run_models(queries: DataFrame, text_col: str, models: dict[str, Callable[[str], str]], pause: float = 0.5) -> DataFrame:
    """Every model over every query: ``model``, the columns of ``queries``, ``corrected, latency_ms, error, changed``.

    A model is warmed up once in each task, then each query has ``TRIES`` tries; a failed one becomes a row with its
    error. NULL texts are asked as empty ones. An empty table gives no rows; the rows are as many as models times queries.
    """
    names = queries.columns
    wide = queries.withColumn("model", F.explode(F.array(*[F.lit(m) for m in sorted(models)])))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        warm: set[str] = set()
        for pdf in batches:
            out = []
            for m, text in zip(pdf["model"], pdf[text_col], strict=True):
                if m not in warm:
                    warm.add(m)
                    _called(models[m], "warm up", WARM_UP_TRIES, 0.0)
                out.append(_called(models[m], text or "", TRIES, pause))
            made = pd.DataFrame(out, columns=["corrected", "latency_ms", "error"], index=pdf.index)
            yield pd.concat([pdf, made], axis=1)[["model", *names, "corrected", "latency_ms", "error"]]

    types = dict(queries.dtypes)
    rows = wide.mapInPandas(run, RESULT.format(", ".join(f"`{c}` {types[c]}" for c in names)))
    return rows.withColumn("changed", F.when(F.col("error") == "", changed(F.col(text_col), F.col("corrected"))).otherwise(F.lit(False)))
