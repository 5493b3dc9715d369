"""Filling fixed-capacity containers with items (problem 7), by swap-based local search.

Items are dealt over tasks of a bounded number of items. Each task packs its items best fit, then searches among its
underfull bins: it moves an item, exchanges one for one or two for one, always the exchange that leaves least room,
whenever that increases the sum of squared fills, until none does; bins that run empty go. What is left underfull is
dealt again over fewer tasks, round after round until it fits into one, so the number of badly filled bins does not grow
with the number of tasks.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexloom.session import cut

#: Items of one task.
SHARD_ITEMS = 8_000
#: A bin filled to this share counts as full; only those below take part in the search and in the next round.
UNDERFULL = 0.985
PACKED = "container string, id {0}, piece int, size bigint, bin string, fill bigint"


def size_of(text: Column) -> Column:
    """Tokens of a text: its UTF-8 bytes and one end token. NULL for NULL."""
    return F.octet_length(text).cast("bigint") + F.lit(1)


def fill_first(sizes: np.ndarray, capacity: int) -> list[list[int]]:
    """Best fit, largest items first: each item goes where it leaves least room."""
    bins: list[list[int]] = []
    room: list[tuple[int, int]] = []
    for i in np.argsort(-sizes, kind="stable").tolist():
        s = int(sizes[i])
        at = bisect_left(room, (s, -1))
        if at < len(room):
            left, b = room.pop(at)
            bins[b].append(i)
        else:
            left, b = capacity, len(bins)
            bins.append([i])
        if left > s:
            insort(room, (left - s, b))
    return bins


class _Open:
    """The underfull bins of a search. Every exchange one of them could make with an item is a row of flat arrays: what it
    would give back (nothing, an item, or two) and which bin it is. A changed bin's rows die and new ones are added."""

    def __init__(self, bins: list[list[int]], sizes: np.ndarray, capacity: int):
        self.bins, self.size, self.capacity = dict(enumerate(bins)), sizes.tolist(), capacity
        self.fill = np.array([sum(self.size[i] for i in own) for own in bins], dtype="int64")
        self._build()

    def _rows(self, b: int) -> list[tuple[int, int, int, int]]:
        """Of items of one size only one counts, and of their pairs one for each two sizes: the capacity bounds them."""
        by_size: dict[int, list[int]] = {}
        for i in self.bins[b]:
            by_size.setdefault(self.size[i], []).append(i)
        order = sorted(by_size)
        out = [(0, b, -1, -1)] + [(s, b, by_size[s][0], -1) for s in order]
        out += [(x + y, b, by_size[x][0], by_size[y][0]) for k, x in enumerate(order) for y in order[k + 1 :]]
        return out + [(2 * x, b, own[0], own[1]) for x, own in by_size.items() if len(own) > 1]

    def _build(self) -> None:
        rows, self.span = [], {}
        for b in self.bins:
            self.span[b] = (len(rows), 0)
            rows += self._rows(b)
            self.span[b] = (self.span[b][0], len(rows))
        self.n = len(rows)
        self.flat = np.zeros((4, 2 * self.n + 4096), dtype="int64")
        self.flat[:, : self.n] = np.array(rows, dtype="int64").reshape(-1, 4).T

    def best(self, b: int, x: int) -> tuple[int, int, list[int]] | None:
        """``fill, bin, items back`` of the exchange of item ``x`` of bin ``b`` that leaves another bin least room, of all
        that increase the squared fills."""
        s = self.size[x]
        back, at = self.flat[0, : self.n], self.flat[1, : self.n]
        grown = self.fill[at] + (s - back)  # the other bin's fill afterwards
        grown[(back >= s) | (grown > self.capacity) | (at == b)] = -1
        k = int(grown.argmax())
        if grown[k] <= self.fill[b]:
            return None
        return int(grown[k]), int(at[k]), [int(i) for i in self.flat[2:, k] if i >= 0]

    def exchange(self, b: int, x: int, t: int, back: list[int]) -> None:
        self.bins[b].remove(x)
        self.bins[t].append(x)
        for y in back:
            self.bins[t].remove(y)
            self.bins[b].append(y)
        d = self.size[x] - sum(self.size[y] for y in back)
        self.fill[b] -= d
        self.fill[t] += d
        for k in (b, t):
            lo, hi = self.span[k]
            self.flat[0, lo:hi] = 2**40
            rows = self._rows(k)
            if self.n + len(rows) > self.flat.shape[1]:
                self._build()
                return
            self.flat[:, self.n : self.n + len(rows)] = np.array(rows, dtype="int64").T
            self.span[k] = (self.n, self.n + len(rows))
            self.n += len(rows)

    def close(self, b: int) -> list[int]:
        lo, hi = self.span.pop(b)
        self.flat[0, lo:hi] = 2**40
        return self.bins.pop(b)


def search(bins: list[list[int]], sizes: np.ndarray, capacity: int) -> list[list[int]]:
    """Local search over the underfull bins, from the emptiest on.

    Each item of a bin looks at every other underfull bin: to move there, to change places with one item, or with two
    that together are smaller. Weight moves only where the other bin ends fuller than this one was, which increases the
    sum of squared fills, so the search ends; it ends with a round over all bins in which no such step is left. Emptied
    bins are dropped, bins that became full take no further part.
    """
    done = [b for b in bins if sizes[b].sum() >= UNDERFULL * capacity]
    low = _Open([list(b) for b in bins if sizes[b].sum() < UNDERFULL * capacity], sizes, capacity)
    moved = True
    while moved:
        moved = False
        for b in sorted(low.bins, key=lambda k: (low.fill[k], k)):
            while b in low.bins:
                step = None
                for x in sorted(low.bins[b], key=lambda i: (-low.size[i], i)):
                    found = low.best(b, x)
                    if found and (step is None or found[0] > step[1][0]):
                        step = (x, found)
                        if found[0] == capacity:
                            break
                if step is None:
                    break
                moved = True
                x, (_, t, back) = step
                low.exchange(b, x, t, back)
                for k in (b, t):
                    if not low.bins[k]:
                        low.close(k)
                    elif low.fill[k] >= UNDERFULL * capacity:
                        done.append(low.close(k))
    return done + list(low.bins.values())


def _pack_shards(items: DataFrame, capacities: dict[str, int], counts: dict[str, int], tag: str) -> DataFrame:
    """Items of every container dealt over its tasks by a hash of the item, and packed."""
    kind = dict(items.dtypes)["id"]
    shards = {c: max(1, -(-counts.get(c, 0) // SHARD_ITEMS)) for c in capacities}

    def one(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        capacity = capacities[key[0]]
        pdf = pdf.sort_values(["size", "id", "piece"], ignore_index=True)
        sizes = pdf["size"].to_numpy("int64")
        name, fill = np.empty(len(pdf), dtype=object), np.zeros(len(pdf), "int64")
        for k, b in enumerate(search(fill_first(sizes, capacity), sizes, capacity)):
            name[b] = f"{key[0]}-{tag}-{key[1]}-{k}"
            fill[b] = sizes[b].sum()
        return pd.DataFrame({"container": key[0], "id": pdf["id"], "piece": pdf["piece"], "size": pdf["size"], "bin": name, "fill": fill})

    of = F.lit(1)
    for c, n in shards.items():
        of = F.when(F.col("container") == c, F.lit(n)).otherwise(of)
    dealt = items.withColumn("shard", F.pmod(F.xxhash64("id", "piece", "size"), of))
    # a stated number of partitions is not coalesced, so each task keeps about one shard
    placed = dealt.repartition(sum(shards.values()), "container", "shard")
    return placed.groupBy("container", "shard").applyInPandas(one, PACKED.format(kind))


def _counts(df: DataFrame) -> dict[str, int]:
    return {r["container"]: r["n"] for r in df.groupBy("container").agg(F.count(F.lit(1)).alias("n")).collect()}


def pack(items: DataFrame, id_col: str, size_col: str, capacities: dict[str, int]) -> DataFrame:
    """``container, id, piece, start, size, bin``: for each kind of container (a few, by name), that of every item, or of
    every piece of a larger one.

    Only an item larger than the capacity is split: into full containers and one rest, which is packed with the others;
    ``start`` is the piece's first token. Items of NULL size get no container (bin NULL), items of size 0 or less count
    as size 0 and go anywhere. Repeated ids are separate items. An empty table gives an empty result. The items are read
    once for all kinds.
    """
    if any(c < 1 for c in capacities.values()):
        raise ValueError("the capacity must be positive")
    rows = items.select(F.col(id_col).alias("id"), F.when(F.col(size_col).isNotNull(), F.greatest(F.col(size_col).cast("bigint"), F.lit(0))).alias("whole"))
    kinds = F.array(*[F.struct(F.lit(c).alias("container"), F.lit(n).cast("bigint").alias("cap")) for c, n in sorted(capacities.items())])
    rows = cut(rows).select("id", "whole", F.inline(kinds))
    pieces = F.greatest(F.ceil(F.col("whole") / F.col("cap")).cast("int"), F.lit(1))
    cut_up = rows.filter(F.col("whole").isNotNull()).withColumn("piece", F.explode(F.sequence(F.lit(0), pieces - 1)))
    cut_up = cut_up.withColumn("size", F.least(F.col("whole") - F.col("piece") * F.col("cap"), F.col("cap")))
    whole_bin = F.concat_ws("-", "container", F.lit("full"), F.col("id").cast("string"), "piece")
    out = cut_up.filter(F.col("size") == F.col("cap")).select("container", "id", "piece", "size", whole_bin.alias("bin"))
    loose = cut_up.filter(F.col("size") < F.col("cap")).select("container", "id", "piece", "size")
    most = F.lit(0).cast("bigint")
    for c, n in capacities.items():
        most = F.when(F.col("container") == c, F.lit(n).cast("bigint")).otherwise(most)
    counts, k = _counts(loose), 0
    while True:
        packed = cut(_pack_shards(loose, capacities, counts, str(k)))
        poor = packed.filter(F.col("fill") < UNDERFULL * most)
        before, counts, k = counts, _counts(poor), k + 1
        # kinds whose underfull items met in one task are done, and so are those that hardly shrink
        again = [c for c, n in counts.items() if before[c] > SHARD_ITEMS and n < 0.9 * before[c]]
        keep = (F.col("fill") >= UNDERFULL * most) | ~F.col("container").isin(again)
        out = out.unionByName(packed.filter(keep).select("container", "id", "piece", "size", "bin"))
        if not again:
            break
        loose = packed.filter(~keep).select("container", "id", "piece", "size")
        counts = {c: counts[c] for c in again}
    done = out.select("container", "id", "piece", (F.col("piece") * most).alias("start"), "size", "bin")
    none = rows.filter(F.col("whole").isNull()).select("container", "id", F.lit(0).alias("piece"), F.lit(0).cast("bigint").alias("start"), F.lit(None).cast("bigint").alias("size"), F.lit(None).cast("string").alias("bin"))
    return done.unionByName(none)


def pack_all(texts: DataFrame, id_col: str, text_col: str, containers: DataFrame) -> DataFrame:
    """The columns of `pack` for each row of a small table of containers."""
    sizes = texts.select(F.col(id_col).alias("id"), size_of(F.col(text_col)).alias("n"))
    kinds = {str(r["container"]): int(r["capacity_tokens"]) for r in containers.select("container", "capacity_tokens").collect()}
    return pack(sizes, "id", "n", kinds) if kinds else pack(sizes.limit(0), "id", "n", {"": 1})
