"""Percentiles of very large numeric columns with a guaranteed rank error (problem 5): a quantile digest.

A value is quantised to one of ``2**BITS`` ordered cells (log-spaced, so the value error is relative and the universe
is bounded whatever the values are). A digest is a set of counted nodes of the binary tree over the cells; digests are
merged by adding nodes and compressed again. Leaf counting, the only step over all rows, is a hash aggregation.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The universe: 2**BITS cells from LOWEST up, each GAMMA times as wide as the one before.
BITS = 16
LOWEST = 1e-3
GAMMA = 1.0005
#: Rank error of one digest, as a share of its rows: BITS / COMPRESSION.
COMPRESSION = 16_000

DIGEST = "node bigint, count bigint"


def cell(value: Column) -> Column:
    """The value's cell. Values up to LOWEST, negative ones too, fall in cell 0; the last cell starts at about 1.7e11."""
    x = F.floor(F.log(value / F.lit(LOWEST)) / F.log(F.lit(GAMMA))) + F.lit(1)
    return F.when(value <= LOWEST, F.lit(0)).otherwise(F.least(x, F.lit(2**BITS - 1))).cast("bigint")


def cell_value(c: np.ndarray) -> np.ndarray:
    """The value in the middle of a cell; within GAMMA - 1 of every value of the cell."""
    return np.where(c <= 0, LOWEST, LOWEST * np.power(GAMMA, np.maximum(c, 1) - 0.5))


def compress(node: np.ndarray, count: np.ndarray, k: int = COMPRESSION) -> tuple[np.ndarray, np.ndarray]:
    """Push the counts of small families to their parent, leaves first. Nodes are numbered as a heap: root 1, leaves from 2**BITS.

    A family (two children and their parent) of at most ``floor(n / k)`` rows becomes the parent alone, so every node
    above the leaves holds at most that many and the digest has at most ``3 k`` nodes.
    """
    limit = int(count.sum()) // k
    levels: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    depth = np.frexp(node.astype("float64"))[1] - 1
    for d in range(BITS + 1):
        u, inv = np.unique(node[depth == d], return_inverse=True)
        levels[d] = (u, np.bincount(inv, weights=count[depth == d], minlength=len(u)).astype("int64"))
    for d in range(BITS, 0, -1):
        n, c = levels[d]
        if not len(n):
            continue
        up, uc = levels[d - 1]
        parents = np.union1d(n >> 1, up)
        fam = np.bincount(np.searchsorted(parents, n >> 1), weights=c, minlength=len(parents)).astype("int64")
        own = np.zeros(len(parents), "int64")
        own[np.searchsorted(parents, up)] = uc
        merge = (fam + own) <= limit
        own = np.where(merge, own + fam, own)
        stays = ~merge[np.searchsorted(parents, n >> 1)]
        levels[d] = (n[stays], c[stays])
        levels[d - 1] = (parents[own > 0], own[own > 0])
    return np.concatenate([v[0] for v in levels.values()]), np.concatenate([v[1] for v in levels.values()])


def quantile(node: np.ndarray, count: np.ndarray, q: float) -> float:
    """The cell at rank ``ceil(q n)``: nodes are added in the order of their largest cell, small nodes first."""
    depth = np.frexp(node.astype("float64"))[1] - 1
    high = ((node + 1) << (BITS - depth)) - 1 - 2**BITS
    order = np.lexsort((-depth, high))
    at = np.searchsorted(np.cumsum(count[order]), max(1, int(np.ceil(q * count.sum()))))
    return float(high[order][min(at, len(order) - 1)])


def digests(df: DataFrame, value_col: str, keys: list[str], where: Column, k: int = COMPRESSION) -> DataFrame:
    """One digest per group: ``*keys, node, count``. NULL and NaN values and rows outside ``where`` are left out.

    Leaves are counted before the shuffle; a group reaches its task as at most ``2**BITS`` counts, however many rows it
    has. NULL keys form a group of their own.
    """
    v = F.col(value_col)
    leaves = (
        df.filter(where & v.isNotNull() & ~F.isnan(v))
        .groupBy(*keys, (cell(v) + F.lit(2**BITS)).alias("node"))
        .agg(F.count(F.lit(1)).alias("count"))
    )
    return _compressed(leaves, keys, k)


def merge(parts: DataFrame, keys: list[str], k: int = COMPRESSION) -> DataFrame:
    """Digests of finer groups combined to those of ``keys``: nodes are added, then compressed again.

    A node above the leaves holds at most ``n_p // k`` rows of each part, together no more than ``n // k`` of the whole,
    so the bound on the rank error, ``BITS * (n // k)`` rows, holds for the merged digest as for one made at once.
    """
    return _compressed(parts.groupBy(*keys, "node").agg(F.sum("count").alias("count")), keys, k)


def _compressed(nodes: DataFrame, keys: list[str], k: int) -> DataFrame:
    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        n, c = compress(pdf["node"].to_numpy("int64"), pdf["count"].to_numpy("int64"), k)
        return pd.DataFrame({x: [pdf[x].iloc[0]] * len(n) for x in keys} | {"node": n, "count": c})

    types = dict(nodes.dtypes)
    schema = ", ".join(f"`{k}` {types[k]}" for k in keys) + ", " + DIGEST
    return nodes.groupBy(*keys).applyInPandas(one, schema)


def read_quantiles(parts: DataFrame, keys: list[str], probs: list[float]) -> DataFrame:
    """``*keys, n, q, estimate, rank_error, value_error``: rank error in rows, value error relative.

    In the lowest cell (values up to LOWEST, negative ones too) and in the highest the value error has no bound; it is
    NULL there. NULL and NaN values are in no digest; a group without values has no row.
    """
    types = dict(parts.dtypes)

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        node, count = pdf["node"].to_numpy("int64"), pdf["count"].to_numpy("int64")
        n = int(count.sum())
        bound = n // COMPRESSION * BITS
        at = np.array([quantile(node, count, q) for q in probs])
        error = np.where((at <= 0) | (at >= 2**BITS - 1), np.nan, GAMMA - 1)
        return pd.DataFrame({k: [pdf[k].iloc[0]] * len(probs) for k in keys} | {"n": n, "q": probs, "estimate": cell_value(at), "rank_error": bound, "value_error": error})

    schema = ", ".join(f"`{k}` {types[k]}" for k in keys) + ", n bigint, q double, estimate double, rank_error bigint, value_error double"
    return parts.groupBy(*keys).applyInPandas(one, schema)
