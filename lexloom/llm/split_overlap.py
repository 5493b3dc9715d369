"""Same or near-same records across splits (problem 4), by winnowing fingerprints.

Words are compared in any order, so each text becomes its sorted words, repeats numbered: equal and nearly equal records
then are equal and nearly equal sequences of distinct words. Two sequences of n words of which one word is exchanged,
added or missing share a run of at least ``ceil((n - 1) / 3)`` words. The length of the rolling hashes and the window of
the winnowing follow from that run, so at least one selected minimum is shared by every such pair and no pair is lost.

Selected minima are joined across the splits with their positions; the seeds of a pair are chained where they are
collinear, and the chain is extended by alignment to both ends. Records equal in both texts are one class; all work is
done on classes, and copies come back only in the results that list rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexloom.llm.lookalike import words_of
from lexloom.operators.skew import HOT_SHARE, join_back
from lexloom.session import cut

#: From so many words in all four texts on, one word of each may differ.
LEAST_WORDS = 5
#: A seed whose records would make more candidates than this across the splits is joined by seed and remaining words.
SEED_PAIRS = 256
#: Lists of seeds or candidates up to this many rows (at most 40 bytes each) are broadcast; longer ones are shuffled.
BROADCAST_ROWS = 500_000
MARKER = "correct"
EVALUATION = ["validation", "test"]
BASE = np.uint64(0x9E3779B97F4A7C15)
SEED = "seed bigint, pos int, cid binary, in_train boolean, in_eval boolean, ni int, nt int, mi bigint, mt bigint"


def numbered(words: Column) -> Column:
    """Sorted words made distinct: a word's later occurrences carry their number, so that repeats count."""
    s = F.array_sort(words)

    def one(w: Column, i: Column) -> Column:
        before = i + 1 - F.array_position(s, w)
        return F.when(before > 0, F.concat(w, F.lit("_"), before.cast("string"))).otherwise(w)

    return F.when(F.size(F.array_distinct(s)) == F.size(s), s).otherwise(F.array_sort(F.transform(s, one)))


def target_words(c: Column) -> Column:
    return words_of(F.coalesce(c, F.lit("")))


def input_words(c: Column) -> Column:
    """The words of an input without its leading marker."""
    w = target_words(c)
    return F.when(F.get(w, F.lit(0)) == MARKER, F.slice(w, 2, F.greatest(F.size(w), F.lit(1)))).otherwise(w)


def records(df: DataFrame, id_col: str, input_col: str, target_col: str, split_col: str, source_col: str) -> DataFrame:
    """``id, source, split, train, iw, tw, cid``: both texts as their sorted words, and the class of records equal in both.

    Rows of another split, or of none, take no part. A NULL text counts as one without words.
    """
    split = F.lower(F.trim(F.col(split_col)))
    rows = df.select(
        F.col(id_col).alias("id"), F.col(source_col).alias("source"), split.alias("split"), (split == "train").alias("train"),
        input_words(F.col(input_col)).alias("iw"), target_words(F.col(target_col)).alias("tw"),
    ).filter(F.col("split").isin("train", *EVALUATION))
    rows = rows.withColumns({c: F.array_join(numbered(F.col(c)), " ") for c in ("iw", "tw")})
    return rows.withColumn("cid", F.unhex(F.md5(F.concat_ws("\n", "iw", "tw"))))


def rolling(h: np.ndarray, k: int) -> np.ndarray:
    """The hashes of all runs of ``k`` words in each row, each from the one before: one word in, one word out."""
    n = h.shape[1]
    out, now = np.zeros((len(h), n - k + 1), "uint64"), np.zeros(len(h), "uint64")
    gone = np.cumprod(np.full(k, BASE))[-1]
    for j in range(n):
        now = now * BASE + h[:, j]
        if j >= k:
            now = now - h[:, j - k] * gone
        if j >= k - 1:
            out[:, j - k + 1] = now
    return out * np.uint64(2 * k + 1)


def winnowed(h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``row, position, hash`` of the selected minima of rows of equally many word hashes.

    With the shared run of ``t`` words: pairs of words up to 8 words, triples from 8 words on (8 words give both, as
    partners may have 7 or 9), and a window of ``t - k + 1`` hashes, of which the last minimum is selected.
    """
    n = h.shape[1]
    run = -(-(n - 1) // 3)
    got = []
    for k in [2] * (n <= 8) + [3] * (n >= 8):
        g, window = rolling(h, k), max(run - k + 1, 1)
        view = np.lib.stride_tricks.sliding_window_view(g, window, axis=1)
        at = np.arange(view.shape[1]) + window - 1 - view[:, :, ::-1].argmin(axis=2)
        chosen = np.zeros(g.shape, bool)
        np.put_along_axis(chosen, at, True, axis=1)
        r, p = np.nonzero(chosen)
        got.append((r, p, g[r, p]))
    return tuple(np.concatenate(x) for x in zip(*got, strict=True))


def remainders(h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``row, position, hash`` of each sequence as it is (position 0) and with each one word left out, from prefix hashes."""
    n = h.shape[1]
    prefix = np.zeros((len(h), n + 1), "uint64")
    for j in range(n):
        prefix[:, j + 1] = prefix[:, j] * BASE + h[:, j]
    power = np.concatenate([np.ones(1, "uint64"), np.cumprod(np.full(n, BASE))])
    after = power[n - 1 :: -1][None, :n]
    less = prefix[:, :n] * after + (prefix[:, n:] - prefix[:, 1:] * after)
    size = np.uint64(n)
    out = np.concatenate([prefix[:, n:] * np.uint64(5) + size, less * np.uint64(5) + size - np.uint64(1)], axis=1)
    r, p = np.divmod(np.arange(out.size), n + 1)
    return r, p, out.ravel()


def seeds_of(classes: DataFrame, how) -> DataFrame:
    """A row for each hash that ``how`` (`winnowed` or `remainders`) gives for the input words of a class.

    ``mi`` and ``mt`` are the input's and the target's words as 64 bits, one a word: one exchange changes two at most.
    """
    hashed = classes.select(
        "cid", (F.col("n_train") > 0).alias("in_train"), (F.col("n_eval") > 0).alias("in_eval"),
        *[F.transform(F.split(w, " "), lambda x: F.xxhash64(x)).alias(h) for w, h in (("iw", "ih"), ("tw", "th"))],
    )

    def bits(flat: np.ndarray, size: np.ndarray) -> np.ndarray:
        one = np.left_shift(np.uint64(1), flat & np.uint64(63))
        return np.bitwise_or.reduceat(one, np.concatenate([[0], np.cumsum(size)[:-1]])).view("int64")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if pdf.empty:
                continue
            flat = {h: np.concatenate(pdf[h].to_numpy()).astype("int64").view("uint64") for h in ("ih", "th")}
            size = {h: pdf[h].map(len).to_numpy() for h in ("ih", "th")}
            own = pdf[["cid", "in_train", "in_eval"]].assign(ni=size["ih"], nt=size["th"], mi=bits(flat["ih"], size["ih"]), mt=bits(flat["th"], size["th"]))
            start = np.cumsum(size["ih"]) - size["ih"]
            for n in np.unique(size["ih"]):
                rows = np.flatnonzero(size["ih"] == n)
                r, p, g = how(flat["ih"][start[rows][:, None] + np.arange(n)])
                yield own.iloc[rows[r]].assign(seed=g.view("int64"), pos=p)[["seed", "pos", "cid", "in_train", "in_eval", "ni", "nt", "mi", "mt"]]

    return hashed.mapInPandas(run, SEED)


def _met(seeds: DataFrame) -> DataFrame:
    """``cid_t, cid_e, seed, pos_t, pos_e``: meetings across the splits that one word's difference allows."""
    t = seeds.filter("in_train").select("seed", *[F.col(c).alias(f"{c}_t") for c in ("cid", "pos", "ni", "nt", "mi", "mt")])
    e = seeds.filter("in_eval").select("seed", *[F.col(c).alias(f"{c}_e") for c in ("cid", "pos", "ni", "nt", "mi", "mt")])
    near = [F.abs(F.col(f"n{x}_t") - F.col(f"n{x}_e")) <= 1 for x in "it"] + [F.bit_count(F.col(f"m{x}_t").bitwiseXOR(F.col(f"m{x}_e"))) <= 2 for x in "it"]
    met = t.join(e, "seed").filter((F.col("cid_t") != F.col("cid_e")) & near[0] & near[1] & near[2] & near[3])
    return met.select("cid_t", "cid_e", "seed", "pos_t", "pos_e")


def _kept(seeds: DataFrame, wanted: DataFrame, n: int) -> DataFrame:
    return seeds.join(F.broadcast(wanted) if n <= BROADCAST_ROWS else wanted, "seed", "left_semi")


def candidates(classes: DataFrame) -> DataFrame:
    """``cid_t, cid_e, seeds``: class pairs across the splits that share seeds, with the seeds' positions in both."""
    long = classes.filter((F.size(F.split("iw", " ")) >= LEAST_WORDS) & (F.size(F.split("tw", " ")) >= LEAST_WORDS))
    seeds = cut(seeds_of(long, winnowed))
    counts = seeds.groupBy("seed").agg(F.count_if("in_train").alias("t"), F.count_if("in_eval").alias("e"))
    # seeds of one side only go before anything is joined
    live = cut(counts.filter("t > 0 and e > 0").select("seed", (F.col("t") * F.col("e") > SEED_PAIRS).alias("often")))
    n = {r["often"]: r["n"] for r in live.groupBy("often").agg(F.count(F.lit(1)).alias("n")).collect()}
    met = _met(_kept(seeds, live.filter("not often").select("seed"), n.get(False, 0)))
    pairs = met.groupBy("cid_t", "cid_e").agg(F.collect_set(F.struct("pos_t", "pos_e")).alias("seeds"))
    if not n.get(True):
        return pairs
    # exact way for frequent seeds: nearly equal sequences also agree in what is left of them without one word
    often = cut(_kept(seeds, live.filter("often").select("seed"), n[True]).select("cid").distinct())
    left = seeds_of(long.join(F.broadcast(often) if often.count() <= BROADCAST_ROWS else often, "cid", "left_semi"), remainders)
    more = _met(left).select("cid_t", "cid_e").distinct().withColumn("seeds", F.array().cast("array<struct<pos_t:int,pos_e:int>>"))
    return pairs.unionByName(more).groupBy("cid_t", "cid_e").agg(F.flatten(F.collect_list("seeds")).alias("seeds"))


def chain(seeds: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest collinear chain: both positions rise from seed to seed."""
    best: list[tuple[int, int]] = []  # length of the chain that ends at a seed, the seed before it
    order = sorted(set(seeds))
    for i, (t, e) in enumerate(order):
        before = max(((best[j][0], -j) for j in range(i) if order[j][0] < t and order[j][1] < e), default=(0, 1))
        best.append((before[0] + 1, -before[1]))
    out, at = [], max(range(len(order)), key=lambda i: (best[i][0], -i), default=-1)
    while at >= 0:
        out.append(order[at])
        at = best[at][1]
    return out[::-1]


def aligned(a: list[str], b: list[str], seeds: list[tuple[int, int]]) -> int:
    """Words that stand in both sequences: seeds are chained, the chain is extended, and the gaps are aligned."""
    matched, i, j = 0, 0, 0
    sure = [(t, e) for t, e in seeds if t < len(a) and e < len(b) and a[t] == b[e]]
    for t, e in [*chain(sure), (len(a), len(b))]:
        if t < i or e < j:  # inside what the seed before was extended to
            continue
        while i < t and j < e:  # the gap: both sides are sorted
            if a[i] == b[j]:
                matched, i, j = matched + 1, i + 1, j + 1
            elif a[i] < b[j]:
                i += 1
            else:
                j += 1
        i, j = t, e
        while i < len(a) and j < len(b) and a[i] == b[j]:
            matched, i, j = matched + 1, i + 1, j + 1
    return matched


@F.pandas_udf(T.StructType([T.StructField("input", T.IntegerType()), T.StructField("target", T.IntegerType())]))
def _aligned(iw_t: pd.Series, iw_e: pd.Series, tw_t: pd.Series, tw_e: pd.Series, seeds: pd.Series) -> pd.DataFrame:
    at = [[(s["pos_t"], s["pos_e"]) for s in x] for x in seeds]
    return pd.DataFrame({
        "input": [aligned(a.split(" "), b.split(" "), s) for a, b, s in zip(iw_t, iw_e, at, strict=True)],
        "target": [aligned(a.split(" "), b.split(" "), []) for a, b in zip(tw_t, tw_e, strict=True)],
    })


def _words(c: str) -> Column:
    return F.when(F.col(c) == "", F.lit(0)).otherwise(F.size(F.split(c, " ")))


def class_links(classes: DataFrame) -> DataFrame:
    """``cid_t, cid_e, share``: classes of the training and an evaluation split that are the same or almost the same.

    ``share`` is the part of the evaluation record's words that the training record covers.
    """
    cand = cut(candidates(classes))
    few = cand.count() <= BROADCAST_ROWS
    left, right = (classes.select(*[F.col(c).alias(f"{c}_{side}") for c in ("cid", "iw", "tw")]) for side in "te")
    if few:  # the candidates go to the words, and only those of candidates are shuffled
        left, right = left.join(F.broadcast(cand), "cid_t"), right.join(F.broadcast(cand.select("cid_t", "cid_e")), "cid_e")
        both = left.join(right, ["cid_t", "cid_e"])
    else:
        both = cand.join(left, "cid_t").join(right, "cid_e")
    # an alignment is read three times: it is cut so that it is made once
    near = cut(both.select("cid_t", "cid_e", *[_words(f"{w}_{s}").alias(f"n{w}_{s}") for w in ("iw", "tw") for s in "te"], _aligned("iw_t", "iw_e", "tw_t", "tw_e", "seeds").alias("m")))
    one = [F.greatest(F.col(f"n{w}_t"), F.col(f"n{w}_e")) - F.col(f"m.{m}") <= 1 for w, m in (("iw", "input"), ("tw", "target"))]
    share = (F.col("m.input") + F.col("m.target")) / (F.col("niw_e") + F.col("ntw_e"))
    same = classes.filter("n_train > 0 and n_eval > 0").select(F.col("cid").alias("cid_t"), F.col("cid").alias("cid_e"), F.lit(1.0).alias("share"))
    return near.filter(one[0] & one[1]).select("cid_t", "cid_e", share.alias("share")).unionByName(same)


def _classes(rows: DataFrame) -> DataFrame:
    return cut(rows.groupBy("cid", "iw", "tw").agg(F.count_if("train").alias("n_train"), F.count_if(~F.col("train")).alias("n_eval")))


def _listed(pairs: DataFrame, members: DataFrame, key: str, hot: DataFrame) -> DataFrame:
    """``pairs`` with the rows of a class; the rows of a hot class are spread over its salts, to each of which its pairs go."""
    salts = F.coalesce("salts", F.lit(1))
    wide = pairs.join(F.broadcast(hot.withColumnRenamed("cid", key)), key, "left").withColumn("salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop("salts")
    own = members.join(F.broadcast(hot.withColumnRenamed("cid", key)), key, "left").withColumn("salt", F.pmod(F.xxhash64(*members.columns), salts).cast("int")).drop("salts")
    return wide.join(own, [key, "salt"]).drop("salt")


def overlaps(df: DataFrame, id_col: str = "example_id", input_col: str = "input_text", target_col: str = "target_text", split_col: str = "split_name", source_col: str = "source") -> DataFrame:
    """Every overlap of a training row with an evaluation row: ``train_id, eval_id, split, source, share``.

    ``split`` and ``source`` are the evaluation row's, ``share`` the part of its words that the training row covers. Each
    pair comes once. Texts of fewer than five words must agree in all words. Two rows without any word in either text
    agree. Copies are kept as classes until the last step, so the work does not grow with the copies of a record, only
    the result does; a class with many copies is spread over many tasks.
    """
    rows = cut(records(df, id_col, input_col, target_col, split_col, source_col))
    classes = _classes(rows)
    links = class_links(classes)
    least = max(1, rows.count() // HOT_SHARE)
    # at most HOT_SHARE classes hold so many rows
    n = F.col("n_train") + F.col("n_eval")
    hot = classes.filter(n > least).select("cid", F.ceil(n / least).cast("int").alias("salts"))
    train = rows.filter("train").select(F.col("cid").alias("cid_t"), F.col("id").alias("train_id"))
    held = rows.filter("not train").select(F.col("cid").alias("cid_e"), F.col("id").alias("eval_id"), "split", "source")
    return _listed(_listed(links, held, "cid_e", hot), train, "cid_t", hot).select("train_id", "eval_id", "split", "source", "share")


def record_coverage(df: DataFrame, id_col: str = "example_id", input_col: str = "input_text", target_col: str = "target_text", split_col: str = "split_name", source_col: str = "source") -> DataFrame:
    """``id, split, source, class_id, partners, coverage`` of every evaluation row.

    ``partners`` is the number of training rows that are the same or almost the same, ``coverage`` the largest part of the
    row's words that one of them covers (0 without a partner, 1 for a row without words that has one). Nothing is
    expanded into row pairs. ``class_id`` is equal for rows equal in both texts.
    """
    rows = cut(records(df, id_col, input_col, target_col, split_col, source_col))
    classes = _classes(rows)
    links = class_links(classes).join(classes.select(F.col("cid").alias("cid_t"), "n_train"), "cid_t")
    best = links.groupBy(F.col("cid_e").alias("cid")).agg(F.sum("n_train").alias("partners"), F.max("share").alias("coverage"))
    best = cut(classes.filter("n_eval > 0").select("cid", "n_eval").join(best, "cid", "left"))
    held = rows.filter("not train").select("id", "split", "source", "cid")
    out = join_back(held, best, "cid", "n_eval", held.count(), ["partners", "coverage"])
    return out.select("id", "split", "source", F.lower(F.hex("cid")).alias("class_id"), F.coalesce("partners", F.lit(0)).cast("bigint").alias("partners"), F.coalesce("coverage", F.lit(0.0)).alias("coverage"))


def coverage(df: DataFrame, **columns: str) -> DataFrame:
    """``split, source, rows, covered, share, words_covered``: how much of each evaluation split and source stands in train."""
    out = record_coverage(df, **columns).groupBy("split", "source").agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.col("partners") > 0).alias("covered"), F.round(F.avg("coverage"), 6).alias("words_covered"))
    return out.withColumn("share", F.round(F.col("covered") / F.col("rows"), 6))
