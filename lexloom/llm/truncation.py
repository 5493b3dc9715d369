"""Text cut off by field limits or broken transfers (problem 9).

Length hazards: per source, the share of texts that end at a length among those that reach it, in characters and in
bytes, each tested against the hazards of the neighbouring lengths with a false-discovery control per source. Lengths
whose hazard is too high are the field limits, and incomplete endings at them are flagged with the reason ``limit``.

Whether an ending is incomplete is told by a classifier that learned from the texts themselves: cut anywhere they are
incomplete, at their own line and sentence ends they are not. Its evidence meets the share of cut texts among those that
end at the same limit, which starts from the surplus of the hazard, is settled by expectation and maximisation and never
exceeds that surplus. So length alone never flags a text. Hazards cannot speak for broken transfers, which happen at any length: the texts that
end at no limit have a share of their own, per source, and incomplete endings among them get the reason ``broken``.
"""

from __future__ import annotations

import random
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexloom.operators.skew import join_back
from lexloom.session import cut

#: Neighbouring lengths on each side whose pooled hazard a length's hazard is held against: the larger of the two.
NEIGHBOURS = (4, 25)
#: False discoveries among the significant lengths of a source.
FALSE_DISCOVERY = 0.01
#: The hazard of a significant length is at least so many times that of its neighbours.
LEAST_RATIO = 2.0
#: Texts the classifier is fitted on, the same at every size of the table.
SAMPLE_TEXTS = 9_000
CUTS, ENDS = 8, 5
EPOCHS = 4
TAIL = 200
BITS = 18
#: Where expectation and maximisation begin for texts at no limit.
FIRST_SHARE = 0.1
ROUNDS = 60
#: Steps of evidence in which texts are counted for it.
STEP = 0.25
#: Tables of limits, shares and last words up to this many rows are broadcast; larger ones are joined by shuffle.
BROADCAST_ROWS = 200_000
#: Characters of an end in which marks and blanks are looked for first; a longer run of them is looked for in the whole text.
NEAR_END = 240
SIGNS = r"…|�|\.\.\.|\[\.\.\.\]|\[…\]|\[truncated\]"
BACK_SIGNS = r"…|�|\.\.\.|\]\.\.\.\[|\]…\[|\]detacnurt\["
TOKEN = re.compile(r"</?\w*>?|&\w+;|\w+|[^\w\s]")
SENTENCE_END = ".!?"
PAIRS = {"(": ")", "[": "]", "{": "}"}


def _end_run(text: Column, pattern: str) -> Column:
    """How many characters at the end of the text ``pattern`` tiles; it is written backwards and anchored, so it looks at the run alone."""
    of = lambda c: F.length(F.regexp_extract(F.reverse(c), rf"^(?:{pattern})*", 0))
    near = of(F.right(text, F.lit(NEAR_END)))
    return F.when(near < NEAR_END - 16, near).otherwise(of(text))


def endings(df: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """``id, source, chars, bytes, tail, line, mark, last``: what is looked at of each text, without marks put at its end.

    NULL, empty and blank texts are left out: they are no case. A NULL source is the source ``''``. ``last`` is the last
    word in lower case, ``''`` where the text does not end in letters.
    """
    t = F.col(text_col)
    unmarked, backwards = F.left(t, F.length(t) - _end_run(t, rf"\n|{BACK_SIGNS}")), F.reverse(F.right(t, F.lit(NEAR_END)))
    rows = df.select(
        F.col(id_col).alias("id"), F.coalesce(F.col(source_col), F.lit("")).alias("source"),
        F.length(unmarked).alias("chars"), F.octet_length(unmarked).alias("bytes"), F.left(t, F.length(t) - _end_run(t, rf"\s|{BACK_SIGNS}")).alias("bare"),
        F.reverse(F.regexp_extract(backwards, r"^\s*\]?(…|�|\.\.\.|\]detacnurt\[)", 1)).alias("mark"),
    ).filter(F.col("bare") != "")
    rows = rows.withColumn("tail", F.right("bare", F.lit(TAIL))).withColumn("line", F.left(F.substring_index("bare", "\n", -1), F.lit(24)))
    return rows.withColumn("last", F.lower(F.reverse(F.regexp_extract(F.reverse("tail"), r"^\p{L}+", 0)))).drop("bare")


def length_hazards(ends: DataFrame) -> DataFrame:
    """``source, unit, length, n, at_risk, hazard, beside, p, significant, surplus``, one row per length that occurs.

    ``hazard`` is ``n`` among the ``at_risk`` texts of at least this length, ``beside`` the pooled hazard of the
    neighbouring lengths: their texts among all that reached them, one text added so that none is never. ``p`` is
    Chernoff's bound on the tail of so many ends under the hazard beside it, so it is never too small; Benjamini and
    Hochberg's step-up rule runs within each source and unit. Rows are counted per length before any window.
    """
    units = F.explode(F.array(F.struct(F.lit("chars").alias("unit"), F.col("chars").alias("length")), F.struct(F.lit("bytes").alias("unit"), F.col("bytes").alias("length"))))
    counts = ends.select("source", units.alias("u")).groupBy("source", "u.unit", "u.length").agg(F.count(F.lit(1)).alias("n"))
    of = Window.partitionBy("source", "unit").orderBy("length")
    t = counts.withColumn("at_risk", F.sum("n").over(of.rangeBetween(0, Window.unboundedFollowing)))
    pooled = [(F.sum("n").over(of.rangeBetween(-k, k)) - F.col("n") + F.lit(1.0)) / (F.lit(2.0 * k) * F.avg("at_risk").over(of.rangeBetween(-k, k))) for k in NEIGHBOURS]
    t = t.withColumn("hazard", F.col("n") / F.col("at_risk")).withColumn("beside", F.least(F.greatest(*pooled), F.lit(1.0)))
    expected = F.col("beside") * F.col("at_risk")
    tail = F.exp(-(F.col("n") * F.log(F.col("n") / expected) - F.col("n") + expected))
    t = t.withColumn("p", F.when(F.col("hazard") > F.col("beside"), tail).otherwise(F.lit(1.0)))
    own = Window.partitionBy("source", "unit")
    by_p = own.orderBy("p", "length")
    t = t.withColumn("passed", F.when(F.col("p") <= F.row_number().over(by_p) * F.lit(FALSE_DISCOVERY) / F.count(F.lit(1)).over(own), F.col("p")))
    t = t.withColumn("significant", F.coalesce(F.col("p") <= F.max("passed").over(own), F.lit(False)) & (F.col("hazard") >= LEAST_RATIO * F.col("beside")))
    return t.withColumn("surplus", 1 - F.col("beside") / F.col("hazard")).drop("passed")


def _kind(tok: str) -> str:
    if tok.isdigit():
        return "0"
    if any(c.isdigit() for c in tok):
        return re.sub(r"\d", "0", re.sub(r"[^\W\d_]", "a", tok))
    return tok.lower()


def inside_words(df: DataFrame, text_col: str) -> DataFrame:
    """``w, inside``: in how many texts a lower-case word stands before the last word, counted over all texts."""
    words = F.filter(F.split(F.lower(F.col(text_col)), r"[^\p{L}]+"), lambda w: w != "")
    words = F.slice(words, F.lit(1), F.greatest(F.size(words) - 1, F.lit(0)))
    return df.filter(F.col(text_col).isNotNull()).select(F.explode(F.array_distinct(words)).alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("inside"))


#: How a last word is known: ``-`` no word, ``k`` more texts hold it inside than end with it, ``r`` fewer, ``u`` none.
KNOWN = ["-", "k", "r", "u"]


def known_as(last: Column, inside: Column, ends: Column) -> Column:
    """The position in ``KNOWN``. A ratio of two counts over all texts: it does not move with the size of the table."""
    n, e = F.coalesce(inside, F.lit(0)), F.coalesce(ends, F.lit(0))
    return F.when(last == "", F.lit(0)).when(n == 0, F.lit(3)).when(n >= e, F.lit(1)).otherwise(F.lit(2))


def _hash(name: str) -> int:
    return zlib.crc32(name.encode()) & ((1 << BITS) - 1)


def features(source: str, tail: str, line: str) -> tuple[list[int], str]:
    """Hashed features of an ending (its last words, alone and together, by source, and its place in line and sentence),
    and the context in which it counts whether the last word is known."""
    raw = TOKEN.findall(tail)
    if len(tail) >= TAIL and len(raw) > 1:
        raw = raw[1:]
    toks = ["^"] * 5 + [_kind(t) for t in raw[-5:]]
    e, d, c, b, a = toks[-5:]
    last = raw[-1] if raw else ""
    shape = "W" if last[:1].isupper() else "w" if last.isalpha() else "0" if last.isdigit() else "c" if last.isalnum() else last[:2]
    since = next((i for i, t in enumerate(reversed(raw)) if t in SENTENCE_END or t[:2] == "</" or t in PAIRS.values()), 99)
    row = tail.rpartition("\n")[2]
    first = TOKEN.match(line)
    head = first[0].lower() if first else ""
    opened = sum(row.count(x) - row.count(y) for x, y in PAIRS.items())
    tags = len(re.findall(r"<\w+>", row)) - len(re.findall(r"</\w+>", row)) + (head[:1] == "<" and len(row) >= TAIL) if head[:1] == "<" or "<" in row else 0
    place = f"{min(max(opened, 0), 2)},{min(max(tags, 0), 2)},{row.count(chr(34)) % 2},{head if not head.isalnum() else 'w'}"
    words = min(sum(t.isalnum() for t in raw), 18) if since > 90 else -1
    names = (
        f"1 {a}", f"2 {b} {a}", f"3 {c} {b} {a}", f"4 {b}", f"5 {c} {b}", f"6 {d} {c} {b}", f"7 {d} {c}", f"8 {e} {d} {a}",
        f"11 {source}", f"12 {source} {a}", f"13 {source} {b} {a}", f"14 {source} {shape}", f"15 {shape} {c} {b}",
        f"18 {source} {place} {shape}", f"19 {last[-3:].lower()} {min(len(last), 12)}", f"20 {source} {min(since, 30)}", f"21 {source} {words} {shape}", f"24 {source} {e} {d} {c} {shape}",
    )
    return [_hash(n) for n in names], f"{source}\t{shape}\t{b}\t{c}"


def known_features(context: str, known: int) -> list[int]:
    source, shape, b, c = context.split("\t")
    k = KNOWN[known]
    return [_hash(n) for n in (f"25 {k}", f"26 {source} {k} {shape}", f"27 {k} {b}", f"28 {source} {k} {c} {b}")]


def _examples(text: str, rng: random.Random) -> Iterator[tuple[int, str]]:
    """Endings made of one text: its own end and line and sentence ends are complete, cuts elsewhere are not."""
    yield 2, text.rstrip()
    plain = "<" not in text and "{" not in text
    stops = [m.end() for m in re.finditer(r"\n(?=.)", text)]
    ends = [m - 1 for m in stops if plain and len(stops) > 2 or not plain]
    if plain:
        for m in re.finditer(r"[.!?](?=\s)", text):
            ends += [m.start(), m.end()]
    rng.shuffle(ends)
    for k in ends[:ENDS]:
        if text[:k].strip():
            yield 0, text[:k].rstrip()
    whole = set(ends) | {len(text.rstrip())}
    bounds = [m.end() for m in re.finditer(r"\w+", text)]
    for i in range(CUTS):
        k = rng.choice(bounds) if i == 0 and bounds else rng.randint(1, max(1, len(text) - 1))
        bare = text[:k].rstrip()
        if len(bare) in whole or k in whole or not bare or (plain and bare[-1] in SENTENCE_END):
            continue
        if text[k : k + 1] == "\n" or text[:k].endswith("\n"):
            continue
        yield 1, bare


def _descend(x: np.ndarray, y: np.ndarray, weight: np.ndarray, seed: int) -> np.ndarray:
    rng, w, g2 = np.random.default_rng(seed), np.zeros(1 << BITS), np.full(1 << BITS, 1e-6)
    rows = np.flatnonzero(weight > 0)
    for _ in range(EPOCHS):
        for part in np.array_split(rng.permutation(rows), max(1, len(rows) // 2048)):
            err = (1 / (1 + np.exp(-np.clip(w[x[part]].sum(1), -30, 30))) - y[part]) * weight[part]
            touched, inv = np.unique(x[part].ravel(), return_inverse=True)
            g = np.bincount(inv, weights=np.repeat(err, x.shape[1]), minlength=len(touched)) / max(1, len(part)) + 1e-7 * w[touched]
            g2[touched] += g * g
            w[touched] -= 0.08 * g / np.sqrt(g2[touched])
    return w


def _weights(cut_here: np.ndarray, source: np.ndarray, keep: np.ndarray) -> np.ndarray:
    """Complete and cut endings of a source weigh the same."""
    out = np.zeros(len(source))
    for s in np.unique(source):
        here = keep & (source == s)
        for side in (False, True):
            own = here & (cut_here == side)
            out[own] = min(10.0, here.sum() / 2 / max(1, own.sum()))
    return out


def fit(x: np.ndarray, y: np.ndarray, source: np.ndarray, seed: int = 11) -> np.ndarray:
    """Logistic regression over hashed features.

    Some natural ends (label 2) are themselves cut. Each half of the endings is judged by a fit that has not seen its
    natural ends; those found incomplete are left out of the last fit. Equal endings fall in one half.
    """
    cut_here = y == 1
    half = (x.astype("uint64") * np.uint64(2654435761)).sum(1) >> np.uint64(7) & np.uint64(1)
    keep = np.ones(len(y), bool)
    for h in (0, 1):
        hidden = (y == 2) & (half == h)
        w = _descend(x, cut_here.astype(float), _weights(cut_here, source, ~hidden), seed)
        keep[hidden & (w[x].sum(1) > 0)] = False
    return _descend(x, cut_here.astype(float), _weights(cut_here, source, keep), seed).astype("float32")


def examples(df: DataFrame, id_col: str, text_col: str, source_col: str, limits: DataFrame) -> DataFrame:
    """``source, y, x, context, last`` of the endings made of ``SAMPLE_TEXTS`` texts, drawn by a hash of the id.

    Texts at a limit and texts with a mark at their end are not drawn.
    """
    order = F.pmod(F.xxhash64(F.lit("truncation"), F.col("id").cast("string")), F.lit(2**31))
    # rows are thinned by their hash first, so that no task orders more than a little over the sample
    below = int(2**31 * min(1.0, 2.0 * SAMPLE_TEXTS / max(1, df.count())))
    rows = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(source_col), F.lit("")).alias("source"), F.col(text_col).alias("text")).filter(order < below)
    usable = rows.filter(F.trim("text") != "").filter(~F.col("text").rlike(r"[…�]\s*$"))
    side = F.broadcast(limits) if limits.count() <= BROADCAST_ROWS else limits
    free = usable.join(side.filter("unit = 'chars'").select(F.col("source").alias("_s"), F.col("length").alias("_l")), (F.col("source") == F.col("_s")) & (F.length("text") == F.col("_l")), "left_anti")
    drawn = free.orderBy(order, "id", "text").limit(SAMPLE_TEXTS)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for i, s, t in zip(pdf["id"], pdf["source"], pdf["text"], strict=True):
                for y, bare in _examples(t, random.Random(zlib.crc32(f"{i} {t}".encode()))):
                    x, context = features(s, bare[-TAIL:], bare.rpartition("\n")[2][:24])
                    last = re.search(r"[^\W\d_]+$", bare)
                    out.append((s, y, x, context, last[0].lower() if last else ""))
            yield pd.DataFrame(out, columns=["source", "y", "x", "context", "last"])

    return drawn.repartition(df.sparkSession.sparkContext.defaultParallelism).mapInPandas(run, "source string, y int, x array<int>, context string, last string")


def learn(made: DataFrame) -> np.ndarray:
    """The classifier's weights, fitted in one task on the bounded sample's endings."""

    def train(pdf: pd.DataFrame) -> pd.DataFrame:
        x = np.array([[*x, *known_features(c, k)] for x, c, k in zip(pdf["x"], pdf["context"], pdf["known"], strict=True)], dtype="int64")
        order = np.lexsort((*x.T, pdf["y"].to_numpy()))
        return pd.DataFrame({"w": [fit(x[order], pdf["y"].to_numpy()[order], pdf["source"].to_numpy().astype(str)[order]).tobytes()]})

    got = made.withColumn("one", F.lit(1)).groupBy("one").applyInPandas(train, "w binary").collect()
    return np.frombuffer(bytes(got[0]["w"]), "float32") if got else np.zeros(1 << BITS, "float32")


def _looked_up(rows: DataFrame, side: DataFrame, key: str, n: int, columns: list[str]) -> DataFrame:
    """A table of one row a key joined to the rows: broadcast where it is counted small, else safe from hot keys."""
    if side.count() <= BROADCAST_ROWS:
        return rows.join(F.broadcast(side.select(F.col(key).alias("_k"), *columns)), F.col(key) == F.col("_k"), "left").drop("_k")
    return join_back(rows, side, key, "n", n, columns)


def _shares(hist: DataFrame, ratio: dict[str, float]) -> DataFrame:
    """``source, place, n, prior, mark, cut, whole``: each place's share of cut texts by expectation and maximisation, and
    the cut and whole texts it makes of each mark. A source reaches its task as counts of steps of evidence."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for place, g in pdf.groupby("place"):
            e = g["step"].to_numpy() * STEP + g["mark"].map(lambda m: ratio.get(m, 0.0)).to_numpy()
            # no more texts can be cut at a limit than end there beyond what the lengths beside it make expect
            n, most = g["n"].to_numpy("float64"), float(g["surplus"].iloc[0]) if place else 0.999
            prior = float(np.clip(g["surplus"].iloc[0], 0.01, 0.9))
            for _ in range(ROUNDS):
                r = 1 / (1 + np.exp(-np.clip(e + np.log(prior / (1 - prior)), -40, 40)))
                prior = float(np.clip((n * r).sum() / n.sum(), 1e-4, max(most, 1e-3)))
            for mark, k in g.assign(cut=n * r, whole=n * (1 - r)).groupby("mark")[["cut", "whole"]].sum().iterrows():
                out.append((pdf["source"].iloc[0], place, int(n.sum()), prior, mark, k["cut"], k["whole"]))
        return pd.DataFrame(out, columns=["source", "place", "n", "prior", "mark", "cut", "whole"])

    return hist.groupBy("source").applyInPandas(one, "source string, place string, n bigint, prior double, mark string, cut double, whole double")


def scored_endings(df: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """``id, source, length, place, prior, evidence, truncated, reason`` of every text that is not blank.

    ``place`` is the limit a text ends at (unit and length) or ``''``; ``reason`` is ``limit`` or ``broken`` where the
    text is truncated, else NULL. NULL, empty and blank texts are left out; repeated ids are separate texts; an empty
    table gives an empty result.
    """
    ends = cut(endings(df, id_col, text_col, source_col))
    total = ends.count()
    limits = cut(length_hazards(ends).filter("significant").select("source", "unit", "length", "n", "surplus"))
    made = cut(examples(df, id_col, text_col, source_col, limits))
    # counts of last words and of words inside, met on the words that are needed
    needed = ends.groupBy(F.col("last").alias("w")).agg(F.count(F.lit(1)).alias("n")).unionByName(made.groupBy(F.col("last").alias("w")).agg(F.lit(0).cast("bigint").alias("n")))
    needed = needed.filter("w <> ''").groupBy("w").agg(F.sum("n").alias("n"))
    vocabulary = cut(needed.join(inside_words(df, text_col), "w", "left").select(F.col("w").alias("last"), "n", known_as(F.col("w"), F.col("inside"), F.col("n")).alias("known")))
    weights = learn(_looked_up(made, vocabulary, "last", total, ["known"]).withColumn("known", F.coalesce("known", F.lit(0))))

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            got = [features(*r) for r in zip(pdf["source"], pdf["tail"], pdf["line"], strict=True)]
            x = np.array([g[0] for g in got], dtype="int64").reshape(len(pdf), -1)
            own = weights[x].sum(1).astype("float64") if len(pdf) else np.zeros(0)
            parts = {}
            for k in range(len(KNOWN)):  # the evidence is a sum, so each way of being known has its part
                parts[f"e{k}"] = own + np.array([weights[known_features(g[1], k)].sum() for g in got], dtype="float64")
            yield pdf[["id", "source", "chars", "bytes", "mark", "last"]].assign(**parts)

    kind = dict(ends.dtypes)["id"]
    columns = ", ".join(f"e{k} double" for k in range(len(KNOWN)))
    s = ends.select("id", "source", "chars", "bytes", "mark", "last", "tail", "line").mapInPandas(score, f"id {kind}, source string, chars int, bytes int, mark string, last string, {columns}")
    s = _looked_up(s, vocabulary, "last", total, ["known"])
    evidence = F.element_at(F.array(*[F.col(f"e{k}") for k in range(len(KNOWN))]), F.coalesce("known", F.lit(0)) + 1)
    s = s.select("id", "source", "chars", "bytes", "mark", evidence.alias("evidence"))
    for unit in ("chars", "bytes"):
        at = F.concat_ws("\n", "source", F.col(unit).cast("string"))
        side = limits.filter(F.col("unit") == unit).select(F.concat_ws("\n", "source", F.col("length").cast("string")).alias("at"), "n", F.col("surplus").alias(f"by_{unit}"))
        s = _looked_up(s.withColumn("at", at), side, "at", total, [f"by_{unit}"]).drop("at")
    by_chars = F.coalesce("by_chars", F.lit(0.0)) >= F.coalesce("by_bytes", F.lit(0.0))
    place = F.when(F.coalesce("by_chars", "by_bytes").isNull(), F.lit("")).when(by_chars, F.concat(F.lit("chars "), "chars")).otherwise(F.concat(F.lit("bytes "), "bytes"))
    s = cut(s.withColumn("place", place).withColumn("surplus", F.coalesce(F.greatest("by_chars", "by_bytes"), F.lit(FIRST_SHARE))).drop("by_chars", "by_bytes"))
    step = F.round(F.least(F.greatest(F.col("evidence"), F.lit(-30.0)), F.lit(30.0)) / STEP).cast("int")
    hist = cut(s.groupBy("source", "place", "mark", step.alias("step")).agg(F.count(F.lit(1)).alias("n"), F.max("surplus").alias("surplus")))
    # what a mark says is learned from the texts that are cut without asking it; a few kinds of marks, so a few rows
    marks = _shares(hist, {}).groupBy("mark").agg(F.sum("cut").alias("cut"), F.sum("whole").alias("whole")).collect()
    cuts, wholes = sum(m["cut"] for m in marks) + 1.0, sum(m["whole"] for m in marks) + 1.0
    ratio = {m["mark"]: float(np.log((m["cut"] + 0.5) / cuts) - np.log((m["whole"] + 0.5) / wholes)) for m in marks if m["mark"]}
    key = F.concat_ws("\n", "source", "place")
    priors = cut(_shares(hist, ratio).select(key.alias("key"), "n", "prior").distinct())
    s = _looked_up(s.withColumn("key", key), priors, "key", total, ["prior"])
    said = F.lit(0.0)
    for mark, plus in ratio.items():
        said = F.when(F.col("mark") == mark, F.lit(plus)).otherwise(said)
    truncated = F.col("evidence") + said + F.log(F.col("prior") / (1 - F.col("prior"))) > 0
    reason = F.when(truncated, F.when(F.col("place") == "", F.lit("broken")).otherwise(F.lit("limit")))
    return s.select("id", "source", F.col("chars").alias("length"), "place", "prior", "evidence", truncated.alias("truncated"), reason.alias("reason"))


def truncation_rates(df: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """``source, texts, truncated, at_limit, broken, share`` per source, over the texts that are not blank."""
    out = scored_endings(df, id_col, text_col, source_col).groupBy("source").agg(
        F.count(F.lit(1)).alias("texts"), F.count_if("truncated").alias("truncated"), F.count_if(F.col("reason") == "limit").alias("at_limit"), F.count_if(F.col("reason") == "broken").alias("broken")
    )
    return out.withColumn("share", F.round(F.col("truncated") / F.col("texts"), 6))
