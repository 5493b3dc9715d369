"""Cleaning, mining, balancing and splitting of training pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexloom.functions.text import edit_share, is_ascii, is_identity_label, positional_difference, tokens, without_prefix


def keep_first(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The first row of each key."""
    w = Window.partitionBy(*keys).orderBy(order)
    return df.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")


def label_pairs(df: DataFrame, prefixed: bool = True) -> DataFrame:
    """``rule`` added to ``ord, input_text, target_text, category``: the first rule that drops a row, or ``keep``.

    Rules in order: empty, non_ascii, equal, edit_share, length_ratio, duplicate, conflict. With ``prefixed`` the edit
    share is taken with the marker in the input. Of one input the first target stands; the same target again is a
    duplicate, another one a conflict.
    """
    i, t = F.col("input_text"), F.col("target_text")
    compared = i if prefixed else without_prefix(i)
    ratio = F.least(F.length(compared), F.length(t)) / F.greatest(F.length(compared), F.length(t), F.lit(1))
    identity = is_identity_label(F.col("category"))
    row_rule = (
        F.when((F.coalesce(F.trim(i), F.lit("")) == "") | (F.coalesce(F.trim(t), F.lit("")) == ""), "empty")
        .when(~is_ascii(i) | ~is_ascii(t), "non_ascii")
        .when(~identity & (compared == t), "equal")
        .when(~identity & (edit_share(compared, t) > 0.5), "edit_share")
        .when(~identity & (ratio < 0.4), "length_ratio")
    )
    rows = df.withColumn("rule", row_rule)
    w = Window.partitionBy("input_text", F.col("rule").isNull()).orderBy("ord")
    first, n = F.first("target_text").over(w), F.row_number().over(w)
    return rows.withColumn("rule", F.coalesce("rule", F.when(n == 1, F.lit("keep")).when(t == first, F.lit("duplicate")).otherwise(F.lit("conflict"))))


def waterfall(labelled: DataFrame) -> DataFrame:
    return labelled.groupBy("rule").agg(F.count(F.lit(1)).alias("n"))


def quality_filter_v30(df: DataFrame) -> DataFrame:
    """The earlier filter: few words, not a mere change of case, not too many differing positions, each pair once."""
    i, t = without_prefix(F.col("input_text")), F.col("target_text")
    few = (F.size(tokens(i)) <= 15) & (F.size(tokens(t)) <= 15)
    cased = (i != t) & (F.lower(i) == F.lower(t))
    far = positional_difference(i, t) > 0.6 * F.least(F.length(i), F.length(t))
    rows = df.filter((F.trim(i) != "") & (F.trim(t) != "") & few & ~cased & ~far)
    return keep_first(rows, ["input_text", "target_text"], "ord")


def vocabulary(df: DataFrame, text: Column, least: int, pattern: str = r"[a-z0-9]+") -> DataFrame:
    """``word, n`` of the words that occur at least ``least`` times."""
    words = df.select(F.explode(F.regexp_extract_all(F.lower(text), F.lit(pattern), F.lit(0))).alias("word"))
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least)


def first_terms(df: DataFrame, text: Column) -> DataFrame:
    """``term, n``: first words and first two words of titles."""
    w = tokens(text)
    both = F.array_distinct(F.array(F.get(w, F.lit(0)), F.concat_ws(" ", F.get(w, F.lit(0)), F.get(w, F.lit(1)))))
    return df.select(F.explode(both).alias("term")).filter("term <> ''").groupBy("term").agg(F.count(F.lit(1)).alias("n"))


def similarity_join(left: DataFrame, left_key: str, right: DataFrame, right_key: str, edits: int = 2) -> DataFrame:
    """``left, right, distance`` of distinct values within ``edits`` edits and at least one.

    Values within ``edits`` differ in length by no more, and of ``edits + 1`` even pieces of the shorter length one
    stands unchanged near its place; the join is on length, piece and place, so a length holds no unbounded group.
    """
    a = left.select(F.col(left_key).alias("left")).distinct().filter("left <> ''")
    b = right.select(F.col(right_key).alias("right")).distinct().filter("right <> ''")
    k = edits + 1

    def piece(c: Column, n: Column, i: Column, shift: Column) -> Column:
        start, end = F.floor(n * i / k).cast("int"), F.floor(n * (i + 1) / k).cast("int")
        return F.substring(c, start + shift + 1, end - start)

    n = F.length("right")
    own = F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.struct(n.alias("n"), i.alias("i"), piece(F.col("right"), n, i, F.lit(0)).alias("p")))
    m = F.length("left")
    near = F.flatten(F.transform(F.sequence(F.greatest(m - edits, F.lit(1)), m + edits), lambda x: F.flatten(F.transform(
        F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.transform(F.sequence(F.lit(-edits), F.lit(edits)), lambda s: F.struct(x.alias("n"), i.alias("i"), piece(F.col("left"), x, i, s).alias("p")))))))
    pairs = a.withColumn("k", F.explode(F.array_distinct(near))).join(b.withColumn("k", F.explode(own)), "k").select("left", "right").distinct()
    return pairs.withColumn("distance", F.levenshtein("left", "right", edits)).filter(F.col("distance").between(1, edits))


def mine_typos(df: DataFrame, text: Column, known_at: int = 50, unknown_at: int = 2) -> DataFrame:
    """``wrong, right, distance``: rare words and the frequent word they most likely stand for."""
    v = vocabulary(df, text, unknown_at, r"[a-z]+").filter(F.length("word") >= 3)
    known, unknown = v.filter(F.col("n") >= known_at), v.filter(F.col("n") < known_at)
    m = similarity_join(unknown, "word", known, "word", 2)
    w = Window.partitionBy("left").orderBy("distance", "right")
    return m.withColumn("r", F.row_number().over(w)).filter("r = 1").select(F.col("left").alias("wrong"), F.col("right").alias("right"), "distance")


def hash_order(seed: int, *keys: str) -> Column:
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys]))


def smallest_by_hash(df: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """Exactly ``n`` rows (all, if fewer), the same on every run.

    The first eight hex digits of the hash are counted to find where the count is reached, so no single task orders all
    rows; rows at that place are ordered by the whole hash.
    """
    if n <= 0:
        return df.limit(0)
    rows = df.withColumn("_h", hash_order(seed, key)).withColumn("_b", F.substring("_h", 1, 4))
    counts = rows.groupBy("_b").agg(F.count(F.lit(1)).alias("c"))
    # at most 65536 counts
    upto = counts.withColumn("u", F.sum("c").over(Window.orderBy("_b")))
    edge = upto.filter(F.col("u") - F.col("c") < n).agg(F.max("_b").alias("edge"), F.max(F.when(F.col("u") <= n, F.col("u"))).alias("below"), F.max_by("u", "_b").alias("last"))
    edge = edge.withColumn("more", F.when(F.col("last") <= n, F.lit(n)).otherwise(n - F.coalesce("below", F.lit(0))))
    marked = rows.join(F.broadcast(edge.select("edge", "more")))
    at = marked.filter(F.col("_b") == F.col("edge")).withColumn("_r", F.row_number().over(Window.partitionBy("_b").orderBy("_h", key))).filter(F.col("_r") <= F.col("more")).drop("_r")
    return marked.filter(F.col("_b") < F.col("edge")).unionByName(at).drop("_h", "_b", "edge", "more")


def balance(df: DataFrame, key: str, identity: Column, target: int, seed: int) -> DataFrame:
    """All identities and as many corrections as the target leaves; all rows where it is not exceeded or identities fill it."""
    counts = df.agg(F.count(F.lit(1)).alias("n"), F.count_if(identity).alias("i")).first()
    if counts["n"] <= target or counts["i"] >= target:
        return df
    return df.filter(identity).unionByName(smallest_by_hash(df.filter(~identity), key, target - counts["i"], seed))


def trim_identities(df: DataFrame, key: str, identity: Column, ratio: float, seed: int, slack: float = 0.03) -> DataFrame:
    """Identities down to ``corrections * ratio / (1 - ratio)`` where their share exceeds ``ratio + slack``."""
    counts = df.agg(F.count(F.lit(1)).alias("n"), F.count_if(identity).alias("i")).first()
    n, i = counts["n"], counts["i"]
    if not n or i / n <= ratio + slack:
        return df
    return df.filter(~identity).unionByName(smallest_by_hash(df.filter(identity), key, int((n - i) * ratio / (1 - ratio)), seed))


def trim_to(df: DataFrame, key: str, identity: Column, target: int, seed: int) -> DataFrame:
    """Down to the target by dropping identities only."""
    counts = df.agg(F.count(F.lit(1)).alias("n"), F.count_if(identity).alias("i")).first()
    drop = counts["n"] - target
    if drop <= 0:
        return df
    return df.filter(~identity).unionByName(smallest_by_hash(df.filter(identity), key, max(0, counts["i"] - drop), seed))


def split_head(df: DataFrame, key: str, n_eval: int, seed: int) -> tuple[DataFrame, DataFrame]:
    """``(train, eval)``: the first rows by keyed hash are evaluation, and no evaluation pair stays in training."""
    ev = smallest_by_hash(df, key, n_eval, seed)
    return train_without(df.join(ev.select(key), key, "left_anti"), ev), ev


def train_without(train: DataFrame, ev: DataFrame) -> DataFrame:
    return train.join(ev.select("input_text", "target_text").distinct(), ["input_text", "target_text"], "left_anti")


def leakage(train: DataFrame, ev: DataFrame) -> DataFrame:
    """``pairs, targets``: evaluation pairs and targets that training also holds."""
    p = ev.join(train.select("input_text", "target_text").distinct(), ["input_text", "target_text"], "left_semi").agg(F.count(F.lit(1)).alias("pairs"))
    t = ev.join(train.select("target_text").distinct(), "target_text", "left_semi").agg(F.count(F.lit(1)).alias("targets"))
    return p.join(F.broadcast(t))


def oversample(df: DataFrame, category: str, times: dict[str, int]) -> DataFrame:
    """Rows of the named categories repeated."""
    n = F.lit(1)
    for name, k in times.items():
        n = F.when(F.col(category) == name, F.lit(k)).otherwise(n)
    return df.withColumn("_k", F.explode(F.sequence(F.lit(1), n))).drop("_k")


def pair_registry(pairs: DataFrame, order: str) -> DataFrame:
    """The first source of each pair."""
    return keep_first(pairs, ["wrong", "right"], order)


def seed_catalog(df: DataFrame, common: DataFrame) -> DataFrame:
    """Names fit for a catalogue: no numbers or common words; of equal names the one with most aliases."""
    rows = df.withColumn("key", F.lower(F.trim("canonical"))).filter(~F.col("key").rlike(r"^\d+$") & (F.col("key") != ""))
    rows = rows.join(common.select(F.lower("word").alias("key")).distinct(), "key", "left_anti")
    w = Window.partitionBy("key").orderBy(F.desc(F.size("exact_aliases")), "canonical")
    return rows.withColumn("r", F.row_number().over(w)).filter("r = 1").drop("r", "key")
