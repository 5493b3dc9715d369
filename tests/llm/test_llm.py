"""The operators for training data: against DuckDB, brute force and round trips, and their edge cases."""

import itertools
import os
import random
import subprocess
import sys
from pathlib import Path

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lexloom.llm import canonical_map, group_split, leakage, lookalike, oracles, packing, qdigest, queries, quota_sample, split_overlap, truncation
from tests.oracle import connection, duck_rows, spark_rows

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
Q, SQL = queries.queries(), queries.oracle_sql()
needs_tables = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@needs_tables
@pytest.mark.parametrize("name", sorted(Q))
def test_query(spark, name):
    cols, got = spark_rows(Q[name](spark, SF))
    assert cols
    if name in SQL:
        want_cols, want = duck_rows(connection(SF), SQL[name])
        assert cols == want_cols
        assert got == want


# problem 1

CATALOG = [("Dovivomo", ["dovivomo", "dovivomo"]), ("Dovivomo Gloneplin", ["gloneplin"]), ("Dovivomo Gloneplin 5", ["gloneplin 5"]), ("Dovivomo Gloneplin 5 Pro", ["gloneplin 5 pro"]), ("Tistigine Zesegomo 120", ["zesegomo 120"]), ("Tistigine", None)]


@pytest.fixture(scope="module")
def index():
    return canonical_map.CanonicalIndex([(c, a or []) for c, a in CATALOG])


@pytest.mark.parametrize(
    ("query", "want"),
    [
        ("buy DOVIVOMO!", "Dovivomo"), ("dovi vomo shoes", "Dovivomo"), ("dovivomogloneplin 5", "Dovivomo Gloneplin 5"), ("gloneplin5 pro cheap", "Dovivomo Gloneplin 5 Pro"),
        ("5 gloneplin dovivomo", "Dovivomo Gloneplin 5"), ("gloneplin 55", "Dovivomo Gloneplin"), ("glomeplln 5", "Dovivomo Gloneplin 5"), ("dovviomo", "Dovivomo"), ("dövivomo", "Dovivomo"),
        ("ｄｏｖｉｖｏｍｏ", "Dovivomo"), ("dоvіvomo", "Dovivomo"), ("zesegomo 120 tistigine", "Tistigine Zesegomo 120"), ("tistigine under 120 eur", "Tistigine"), ("tistigine zesegomo", "Tistigine"),
        ("dovabc", None), ("red shoes", None), ("", None), ("   ", None), ("рюкзак", None), ("?!", None), ("x" * 5000, None),
    ],
)
def test_canonical(index, query, want):
    assert index.find(query)[0] == want


def test_a_list_in_parts_gives_the_same(spark, monkeypatch):
    cat = spark.createDataFrame(CATALOG, "canonical string, exact_aliases array<string>")
    asked = ["dovivomo", "gloneplin 5 pro", "dovivomo gloneplin", "zesegomo 120", "tistigin", None, "", "red", "dovivomo"]
    df = spark.createDataFrame(list(enumerate(asked)), "id int, q string")
    whole = sorted(canonical_map.map_to_canonical(df, cat, "id", "q").collect())
    monkeypatch.setattr(canonical_map, "PART_ENTRIES", 2)
    assert sorted(canonical_map.map_to_canonical(df, cat, "id", "q").collect()) == whole


def test_method_tells_how_the_name_was_found(index):
    assert index.find("gloneplin 5")[1] == "mention" and index.find("glomeplln dovivomo 5")[1] == "similar"


def test_edit_distance_is_brute_force():
    def brute(a, b):
        d = {(-1, -1): 0} | {(i, -1): i + 1 for i in range(len(a))} | {(-1, j): j + 1 for j in range(len(b))}
        for i, j in itertools.product(range(len(a)), range(len(b))):
            d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i] != b[j]))
            if i and j and a[i] == b[j - 1] and a[i - 1] == b[j]:
                d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
        return d[len(a) - 1, len(b) - 1]

    rng = random.Random(1)
    for _ in range(3000):
        a, b = ("".join(rng.choices("abc", k=rng.randint(1, 7))) for _ in range(2))
        assert canonical_map.osa(a, b) == min(brute(a, b), 3)


def test_word_lookup_misses_nothing(index):
    rng = random.Random(2)
    for w in sorted(index.fuzzy):
        for _ in range(200):
            s = list(w)
            for _ in range(2):
                k = rng.randrange(len(s))
                s[k : k + 1] = rng.choice([[], [s[k], "q"], ["q"]])
            assert index.closest("".join(s))[0] <= 2


def test_map_keeps_every_row_and_ignores_other_columns(spark):
    cat = spark.createDataFrame(CATALOG, "canonical string, exact_aliases array<string>").withColumn("value", F.lit("x"))
    df = spark.createDataFrame([(1, "dovivomo", "a"), (1, "dovivomo", "a"), (2, None, "b"), (None, "zzz", "c")], "id int, q string, canonical string")
    out = [(r["id"], r["canonical"]) for r in canonical_map.map_to_canonical(df, cat, "id", "q").collect()]
    assert sorted(out, key=str) == sorted([(1, "Dovivomo"), (1, "Dovivomo"), (2, None), (None, None)], key=str)
    assert canonical_map.map_to_canonical(df.limit(0), cat, "id", "q").count() == 0
    assert canonical_map.map_to_canonical(df, cat.limit(0), "id", "q").filter("canonical is not null").count() == 0


# problem 2


def _plan(spark):
    return spark.createDataFrame([("train", 0.8), ("validation", 0.1), ("test", 0.1)], "split_name string, target_share double")


def test_split_keeps_groups_and_shares(spark):
    rng = random.Random(3)
    rows = [(i, "hot one" if i % 3 == 0 else f"w{rng.randrange(1500)}", rng.choice(["a", "b", "c", None, "A "])) for i in range(6000)]
    df = spark.createDataFrame(rows, "example_id int, t string, category string").withColumn("key", F.lit(0)).withColumn("split", F.lit(""))
    out = group_split.grouped_split(df, "example_id", [group_split.target_key(F.col("t"))], "category", _plan(spark)).toPandas().merge(df.toPandas()[["example_id", "t", "category"]], on="example_id")
    assert len(out) == 6000
    assert out.groupby("t")["split"].nunique().max() == 1
    share = out["split"].value_counts(normalize=True)
    assert abs(share["train"] - 0.8) < 0.01 and abs(share["test"] - 0.1) < 0.01
    by_label = out.assign(c=out["category"].fillna("").str.strip().str.lower())
    for _, part in by_label.groupby("c"):
        assert abs((part["split"] == "test").mean() - 0.1) < 0.03


def test_split_edges(spark):
    df = spark.createDataFrame([(1, None, None), (2, None, "a"), (3, "", "a"), (4, "!!", "a"), (5, "A  b", "a"), (6, "a, B", "a"), (7, "ａ ｂ", "a"), (8, "ab", "a")], "example_id int, t string, category string")
    got = {r["example_id"]: r["first_id"] for r in group_split.grouped_split(df, "example_id", [group_split.target_key(F.col("t"))], "category", _plan(spark)).filter("n_component > 1").collect()}
    assert got == {5: 5, 6: 5, 7: 5}
    assert group_split.grouped_split(df, "example_id", [group_split.target_key(F.col("t"))], "category", _plan(spark)).count() == 8
    assert group_split.grouped_split(df.limit(0), "example_id", [group_split.target_key(F.col("t"))], "category", _plan(spark)).count() == 0


def test_components_over_several_keys(spark):
    rng = random.Random(12)
    rows = [(i, rng.choice([None, f"a{rng.randrange(90)}"]), rng.choice([None, f"s{rng.randrange(90)}"]), None if i % 7 else f"e{i // 40}", "x") for i in range(160)]
    rows += [(1000 + i, f"p{i}", f"p{i + 1}", None, "x") for i in range(40)] + [(2000 + i, "one", None, None, "y") for i in range(300)]
    rows += [(3000 + i, f"q{i}", f"r{i}", None, None) for i in range(30)] + [(3100 + i, f"q{i + 1}", f"r{i}", None, None) for i in range(29)]
    df = spark.createDataFrame(rows, "id int, author string, source string, entity string, label string").withColumns({"node": F.lit(1), "key": F.lit(1)})
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for r in rows:
        for k, v in enumerate(r[1:4]):
            if v is not None:
                parent[root((k, v))] = root(("row", r[0]))
        root(("row", r[0]))
    want = {}
    for r in rows:
        want.setdefault(root(("row", r[0])), set()).add(r[0])
    keys = [F.col(c).cast("binary") for c in ("author", "source", "entity")]
    got = {}
    for r in group_split.grouped_split(df, "id", keys, "label", _plan(spark)).collect():
        got.setdefault(r["first_id"], []).append((r["example_id"], r["split"], r["n_component"]))
    assert sorted(map(sorted, want.values())) == sorted(sorted(x[0] for x in g) for g in got.values())
    assert all(len({x[1] for x in g}) == 1 and g[0][2] == len(g) for g in got.values())


# problem 3


def test_swap_repair_is_the_best_count():
    available, share, floors = {"a": 30, "b": 5, "c": 40}, {"a": 0.5, "b": 0.3, "c": 0.2}, {"a": 2, "b": 2, "c": 8}
    best = min(
        (sum((t[k] - share[k] * 20) ** 2 for k in t) for t in ({"a": a, "b": b, "c": 20 - a - b} for a in range(2, 21) for b in range(2, 6)) if floors["c"] <= t["c"] <= 40),
    )
    for seed in range(10):
        rng = random.Random(seed)
        start = quota_sample.random_start(available, {k: rng.randrange(n // 3 + 1) for k, n in available.items()}, floors, 20)
        assert sum(start.values()) == 20 and all(floors[k] <= start[k] <= available[k] for k in start)
        take = quota_sample.swap_repair(start, available, share, floors, 20)
        assert sum(take.values()) == 20 and sum((take[k] - share[k] * 20) ** 2 for k in take) == pytest.approx(best)


def test_repair_over_signatures_of_several_categories():
    rng = random.Random(13)
    for _ in range(40):
        sigs = ["a", "b", "a\x1fb", "b\x1fc", ""]
        available = {s: rng.randrange(9) for s in sigs}
        size = sum(available.values()) // 2
        share, wish = {"a": 0.5, "b": 0.3, "c": 0.4}, {"a": 2, "b": 1, "c": 1}
        floors = quota_sample.feasible_floors(wish, available, size)
        take = quota_sample.swap_repair(quota_sample.random_start(available, available, floors, size), available, share, floors, size)
        count = lambda t, c: sum(k for s, k in t.items() if c in quota_sample.parts_of(s))
        off = lambda t: sum((count(t, c) - share[c] * size) ** 2 for c in share) + t[""] ** 2
        assert sum(take.values()) == size and all(0 <= take[s] <= available[s] for s in sigs)
        for a, b in itertools.permutations(sigs, 2):
            if take[a] and take[b] < available[b]:
                t = take | {a: take[a] - 1, b: take[b] + 1}
                assert off(t) >= off(take) - 1e-9 or any(count(t, c) < floors[c] for c in floors)


def test_sample_of_rows_with_several_categories(spark):
    df = spark.createDataFrame([(i, [["x"], ["X ", "y"], ["y", None], None, ["w"]][i % 5]) for i in range(1000)], "id int, category array<string>")
    plan = spark.createDataFrame([("x", 0.6, 1), ("y", 0.6, 1), ("z", 0.01, 700)], "category string, target_share double, min_rows int")
    sample, report = quota_sample.quota_sample(df, "id", "category", plan)
    got = sample.groupBy("category").count().collect()
    assert sample.count() == 200 and {r["category"] for r in got} <= {"x", "x | y", "y"}
    rep = {r["category"]: r for r in report.collect()}
    assert rep["x"]["taken"] == 120 and rep["y"]["taken"] == 120 and rep["z"]["short"] and not rep["x"]["short"]


def test_floors_beyond_the_sample_are_scaled(spark):
    df = spark.createDataFrame([(i, "xy"[i % 2]) for i in range(100)], "id int, category string")
    plan = spark.createDataFrame([("x", 0.5, 40), ("y", 0.5, 40)], "category string, target_share double, min_rows int")
    sample, report = quota_sample.quota_sample(df, "id", "category", plan)
    assert sample.count() == 20 and {r["taken"] for r in report.collect()} == {10}


def test_sample_size_floors_and_report(spark):
    rows = [(i, "big " if i % 20 else "rare" if i % 200 == 0 else None) for i in range(4000)]
    df = spark.createDataFrame(rows, "id int, category string").withColumn("sig", F.lit(1)).withColumn("h", F.lit(1))
    plan = spark.createDataFrame([("Big", 0.5, 1), ("rare", 0.3, 5), ("none", 0.2, 3)], "category string, target_share double, min_rows int")
    sample, report = quota_sample.quota_sample(df, "id", "category", plan)
    assert sample.count() == 800 and sample.select("example_id").distinct().count() == 800
    assert sample.filter("category is null").count() == 0
    got = {r["category"]: r for r in report.collect()}
    assert got["rare"]["taken"] == 20 and got["rare"]["short"] and got["none"]["short"] and not got["big"]["short"]
    empty, rep = quota_sample.quota_sample(df.limit(0), "id", "category", plan)
    assert empty.count() == 0 and rep.filter("short").count() == 3


# problem 4


def test_overlaps_are_brute_force(spark):
    rng = random.Random(4)
    vocab = [f"w{i}" for i in range(14)]
    rows = []
    for i in range(260):
        a, b = (rng.choices(vocab, k=rng.choice([3, 5, 6, 7, 8, 9, 11, 14])) for _ in range(2))
        for k in range(rng.choice([1, 1, 3])):
            x, y = list(a), list(b)
            for w in (x, y):
                for _ in range(rng.choice([0, 1, 1, 2]) if k else 0):
                    j = rng.randrange(len(w))
                    w[j : j + 1] = rng.choice([[], ["z"], [w[j], rng.choice(vocab)]])
                rng.shuffle(w)
            rows.append((len(rows), rng.choice(["correct: ", "Correct:", ""]) + " ".join(x), ", ".join(y).upper(), rng.choice(["train", "validation", "test", None]), "s"))
    rows += [(len(rows) + k, None if k % 2 else "", None, ["train", "test"][k // 2], None) for k in range(4)]
    df = spark.createDataFrame(rows, "example_id int, input_text string, target_text string, split_name string, source string")

    def bag(s):
        w = (s or "").lower().replace(",", " ").replace(":", " ").split()
        return w[1:] if w[:1] == ["correct"] else w

    def far(x, y):
        a, b = pd.Series(x, dtype=object).value_counts(), pd.Series(y, dtype=object).value_counts()
        return max(len(x), len(y)) - int(sum(min(n, b.get(w, 0)) for w, n in a.items()))

    want = set()
    for p, q in itertools.permutations(rows, 2):
        if p[3] == "train" and q[3] in ("validation", "test"):
            texts = [bag(p[1]), bag(q[1]), bag(p[2]), bag(q[2])]
            di, dt = far(*texts[:2]), far(*texts[2:])
            if di == dt == 0 or (min(map(len, texts)) >= 5 and di <= 1 and dt <= 1):
                want.add((p[0], q[0]))
    keep = split_overlap.SEED_PAIRS, split_overlap.BROADCAST_ROWS
    for limit in (keep, (0, keep[1]), (4, 0)):
        split_overlap.SEED_PAIRS, split_overlap.BROADCAST_ROWS = limit
        got = [(r["train_id"], r["eval_id"]) for r in split_overlap.overlaps(df).collect()]
        split_overlap.SEED_PAIRS, split_overlap.BROADCAST_ROWS = keep
        assert len(got) == len(set(got)) and set(got) == want and len(want) > 30
    assert split_overlap.overlaps(df.limit(0)).count() == 0
    texts = {r[0]: (bag(r[1]), bag(r[2])) for r in rows}

    def share(t, e):
        own = [max(len(x), len(y)) - far(x, y) for x, y in zip(texts[t], texts[e], strict=True)]
        return sum(own) / sum(map(len, texts[e])) if any(texts[e]) else 1.0

    for r in split_overlap.record_coverage(df).collect():
        with_it = [t for t, e in want if e == r["id"]]
        assert r["partners"] == len(with_it) and r["coverage"] == pytest.approx(max((share(t, r["id"]) for t in with_it), default=0))
    assert split_overlap.record_coverage(df.limit(0)).count() == 0


def test_one_class_of_many_copies_is_listed_whole(spark):
    rows = [(i, "correct: a b c d e", "a b c d e", "train" if i % 3 else "test", "s") for i in range(60)] + [(100, "a b c d x", "A b c d e", "test", "s")]
    df = spark.createDataFrame(rows, "example_id int, input_text string, target_text string, split_name string, source string").withColumns({"salt": F.lit(1), "cid": F.lit(1)})
    got = [(r["train_id"], r["eval_id"]) for r in split_overlap.overlaps(df).collect()]
    assert len(got) == len(set(got)) == 40 * 21


def test_winnowing_selects_a_shared_minimum():
    rng = np.random.default_rng(4)
    for n in range(5, 40):
        for _ in range(60):
            a = np.sort(rng.choice(10**6, n, replace=False)).astype("uint64")
            b = np.sort(np.append(np.delete(a, rng.integers(n)), rng.choice(10**6, rng.integers(0, 2)).astype("uint64")))
            if len(b) < 5:
                continue
            x, y = (split_overlap.winnowed(s[None] * np.uint64(0x2545F4914F6CDD1D)) for s in (a, b))
            assert set(x[2]) & set(y[2])
            x, y = (split_overlap.remainders(s[None] * np.uint64(0x2545F4914F6CDD1D)) for s in (a, b))
            assert set(x[2]) & set(y[2])


def test_chain_is_the_longest():
    rng = random.Random(4)
    for _ in range(300):
        seeds = [(rng.randrange(8), rng.randrange(8)) for _ in range(rng.randrange(7))]
        got = split_overlap.chain(seeds)
        assert all(a[0] < b[0] and a[1] < b[1] for a, b in itertools.pairwise(got)) and set(got) <= set(seeds)
        rising = lambda c: all(a[0] < b[0] and a[1] < b[1] for a, b in itertools.pairwise(c))
        assert len(got) == max(k for k in range(len(seeds) + 1) for c in itertools.combinations(sorted(set(seeds)), k) if rising(c))


# problem 5


def test_digest_error_and_merge():
    rng = np.random.default_rng(5)
    k = 200
    parts, everything = [], []
    for size in (10, 3000, 50_000):
        cells = np.clip(rng.lognormal(9, 0.6, size), 0, 2**qdigest.BITS - 1).astype("int64")
        node, count = np.unique(cells + 2**qdigest.BITS, return_counts=True)
        parts.append(qdigest.compress(node, count, k))
        everything.append(cells)
    cells = np.sort(np.concatenate(everything))
    nodes = pd.concat([pd.DataFrame({"n": n, "c": c}) for n, c in parts]).groupby("n")["c"].sum()
    node, count = qdigest.compress(nodes.index.to_numpy(), nodes.to_numpy(), k)
    assert count.sum() == len(cells) and len(node) <= 3 * k + 1
    for q in (0.01, 0.5, 0.9, 0.99, 1.0):
        est = qdigest.quantile(node, count, q)
        rank, bound = np.ceil(q * len(cells)), qdigest.BITS * (len(cells) // k)
        assert (cells < est).sum() < rank + bound and (cells <= est).sum() >= rank - bound


def test_value_error_is_open_in_the_outer_cells(spark):
    df = spark.createDataFrame([("a", -5.0), ("b", 7.0), ("c", 1e15)], "g string, v double")
    out = {r["g"]: r["value_error"] for r in qdigest.read_quantiles(qdigest.digests(df, "v", ["g"], F.lit(True)), ["g"], [0.5]).collect()}
    assert out["a"] is None and out["c"] is None and out["b"] == pytest.approx(qdigest.GAMMA - 1)


@needs_tables
def test_sql_twin_compresses_the_same(spark):
    rows = spark.read.parquet(f"{SF}/results.parquet")
    days = qdigest.digests(rows, "latency_ms", ["model", "run_id"], F.col("error") == "", 5)
    whole = qdigest.merge(days, ["model"], 150).select("model", F.lit(None).cast("string").alias("run_id"), "node", "count")
    assert days.agg(F.min("node")).first()[0] < 2**qdigest.BITS
    whole5 = qdigest.merge(days, ["model"], 5).select("model", F.lit(None).cast("string").alias("run_id"), "node", "count")
    assert spark_rows(days.unionByName(whole5)) == duck_rows(connection(SF), oracles.digests(5))
    assert whole.agg(F.sum("count")).first()[0] == days.agg(F.sum("count")).first()[0]


def test_cells_are_ordered_and_near(spark):
    x = [-5.0, 0.0, 0.0005, 0.001, 0.5, 1.0, 206.1, 1e6, 1e15]
    got = [r[0] for r in spark.createDataFrame([(v,) for v in x], "v double").select(qdigest.cell(F.col("v"))).collect()]
    assert got == sorted(got) and got[0] == 0 and got[-1] == 2**qdigest.BITS - 1
    assert np.allclose(qdigest.cell_value(np.array(got[4:8])), x[4:8], rtol=qdigest.GAMMA - 1)


def test_digest_edges(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", None), ("a", float("nan")), (None, 2.0), ("b", None)], "g string, v double").withColumns({"node": F.lit(1), "count": F.lit(1)})
    out = {r["g"]: r for r in qdigest.read_quantiles(qdigest.digests(df.select("g", "v"), "v", ["g"], F.lit(True)), ["g"], [0.5]).collect()}
    assert set(out) == {"a", None} and out["a"]["n"] == 1 and abs(out["a"]["estimate"] - 1) < 0.001
    assert qdigest.digests(df.limit(0).select("g", "v"), "v", ["g"], F.lit(True)).count() == 0


# problem 6


@pytest.mark.parametrize(
    ("text", "clean"),
    [
        ("plain text", "plain text"), ("café", "café"), ("café", "café"), ("ｆｕｌｌ", "full"), ("ofﬁce", "office"), ("a b c", "a b c"), ("zero​width﻿", "zerowidth"),
        ("so­ft", "soft"), ("vаcuum", "vacuum"), ("ɡlass", "glass"), ("рюкзак", "рюкзак"), ("5 €", "5 €"), ("φορ XL", "φορ XL"), ("", ""), (None, None),
    ],
)
def test_mapped(spark, text, clean):
    r = spark.createDataFrame([(text,)], "t string").select(lookalike.mapped_text(F.col("t")).alias("m"), lookalike.odd_text(F.col("t")).alias("o")).first()
    assert r["m"] == clean and r["o"] == (text != clean)


def test_equal_looking_texts_meet(spark):
    rows = [(1, "Café au lait"), (2, "café au lait"), (3, "ｃａｆé au lait"), (4, "cafe au lait"), (5, None), (6, ""), (7, "Café au lait"), (7, "Café au lait")]
    df = spark.createDataFrame(rows, "id int, t string").withColumn("canonical", F.lit(1)).withColumn("value", F.lit(1))
    out = lookalike.consistent_form(df, "id", "t").collect()
    assert len(out) == 8
    form = {r["id"]: r["canonical"] for r in out}
    assert form[1] == form[7] == "Café au lait" and form[2] == form[3] == "café au lait" and form[4] == "cafe au lait" and form[5] is None and form[6] == ""
    assert {r["id"] for r in out if r["odd"]} == {2, 3}
    assert lookalike.consistent_form(df.limit(0), "id", "t").count() == 0


# problem 7


def test_packing_is_whole_and_tight(spark):
    rng = random.Random(6)
    rows = [(i, rng.choice([1, 30, 200, 300, 511, 512, 513, 1700, 5000])) for i in range(1500)] + [(2000, None), (2001, 0), (2002, -3), (3, 40), (3, 40)]
    df = spark.createDataFrame(rows, "doc string, n int".replace("doc string", "doc int")).withColumns({"size": F.lit(1), "bin": F.lit(1), "id": F.lit(1)})
    out = packing.pack(df, "doc", "n", {"c": 512}).toPandas()
    placed = out[out["bin"].notna()]
    assert set(out[out["bin"].isna()]["id"]) == {2000}
    assert placed.groupby("bin")["size"].sum().max() <= 512
    total = sum(max(n or 0, 0) for _, n in rows)
    assert placed["size"].sum() == total
    assert (placed.groupby("id").size()[[i for i, n in rows[:1500] if n and n <= 512 and i != 3]] == 1).all()
    assert placed["bin"].nunique() <= 1.02 * -(-total // 512) + 1
    assert packing.pack(df.limit(0), "doc", "n", {"c": 512}).count() == 0


def test_underfull_bins_of_all_tasks_meet(spark, monkeypatch):
    monkeypatch.setattr(packing, "SHARD_ITEMS", 100)
    df = spark.createDataFrame([(i, 100 + 7 * (i * i % 31)) for i in range(1500)], "id int, n int")
    bins = packing.pack(df, "id", "n", {"a": 512, "b": 700}).groupBy("container").agg(F.count_distinct("bin").alias("bins")).collect()
    total = sum(100 + 7 * (i * i % 31) for i in range(1500))
    assert {r["container"]: r["bins"] <= 1.06 * -(-total // {"a": 512, "b": 700}[r["container"]]) for r in bins} == {"a": True, "b": True}


def test_search_only_improves():
    rng = np.random.default_rng(7)
    sizes = rng.integers(1, 100, 300)
    start = [list(b) for b in np.array_split(np.arange(300), 200)]
    start = [b for b in start if sizes[b].sum() <= 120]
    inside = sorted(i for b in start for i in b)
    before = sum(int(sizes[b].sum()) ** 2 for b in start)
    after = packing.search([list(b) for b in start], sizes, 120)
    assert sorted(i for b in after for i in b) == inside and all(sizes[b].sum() <= 120 for b in after)
    fills = sorted((int(sizes[b].sum()), b) for b in after if sizes[b].sum() < packing.UNDERFULL * 120)
    for f, b in fills:  # brute force: no step is left
        for g, t in fills:
            for x in b if b is not t else ():
                for back in [(), *[(y,) for y in t], *itertools.combinations(t, 2)]:
                    d = int(sizes[x] - sizes[list(back)].sum()) if back else int(sizes[x])
                    assert d <= 0 or g + d > 120 or g + d <= f
    assert len(after) < len(start) and sum(int(sizes[b].sum()) ** 2 for b in after) > before


# problem 8


def test_leaks_are_brute_force(spark):
    rng = random.Random(8)
    vocab = [f"v{i}" for i in range(60)] + ["12", "7", "cm"]
    items = [(i, " ".join(rng.choices(vocab, k=rng.choice([5, 12, 30, 60])))) for i in range(20)] + [(98, ""), (99, None)]
    docs = []
    for i in range(150):
        words = rng.choices(vocab, k=rng.randint(0, 40))
        src = (rng.choice(items[:20])[1]).split()
        a = rng.randrange(len(src))
        part = src[a : a + rng.choice([6, 11, 12, 13, 40])]
        docs.append((i, " ".join(words[:20]) + ",\n" + "  ".join(part).upper() + ". " + " ".join(words[20:])))
    docs += [(500, ""), (501, None), (502, items[3][1]), (502, items[3][1])]
    d, t = spark.createDataFrame(docs, "doc_id int, text string"), spark.createDataFrame(items, "item_id int, text string")
    grams = lambda s: {tuple(w[k : k + 12]) for w in [(s or "").lower().replace(",", " ").replace(".", " ").split()] for k in range(len(w) - 11)}
    want = {(i, j) for i, s in docs for j, u in items if grams(s) & grams(u)}
    got = [(r["doc_id"], r["item_id"]) for r in leakage.leaked_passages(d, t).collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 20
    keep, leakage.BROADCAST_WINDOWS = leakage.BROADCAST_WINDOWS, 0
    assert {(r["doc_id"], r["item_id"]) for r in leakage.leaked_passages(d, t).collect()} == want
    leakage.BROADCAST_WINDOWS = keep
    assert leakage.leaked_passages(d.limit(0), t).count() == 0 and leakage.leaked_passages(d, t.limit(0)).count() == 0


def test_reworded_question(spark):
    form = "a reviewer of {} queries tries {} times to show that {} rhymes with the {} label because nobody consults the index"
    items = [(i, form.format(a, n, b, "red")) for i, (a, n, b) in enumerate([("aa", 4, "bb"), ("cc", 5, "dd"), ("ee", 6, "ff"), ("gg", 7, "hh")])]
    docs = [(1, "so " + form.format("xx", 9, "yy", "red") + " indeed"), (2, items[0][1]), (3, "something else " * 10)]
    d, t = spark.createDataFrame(docs, "doc_id int, text string"), spark.createDataFrame(items, "item_id int, text string")
    assert {r["doc_id"] for r in leakage.leaked_passages(d, t).collect()} == {2}
    assert {(r["doc_id"], r["item_id"]) for r in leakage.reworded_questions(d, t).filter("doc_id = 1").collect()} == {(1, i) for i in range(4)}


# problem 9


def _texts(n, seed):
    rng = random.Random(seed)
    nouns, adj = ["cable", "strap", "hinge", "button", "sleeve", "kettle"], ["coral", "silver", "woollen", "sturdy"]
    forms = ["the {a} {n} rotates freely during the morning", "our family uses the {n} almost every weekend", "nobody complained about the {a} {n} before", "support answered in two days and shipped a {a} {n}"]
    out = []
    for _ in range(n):
        s = [rng.choice(forms).format(a=rng.choice(adj), n=rng.choice(nouns)) for _ in range(rng.randint(2, 9))]
        out.append(". ".join(x.capitalize() for x in s) + rng.choice([".", ".", "", "!"]))
    return out


def test_truncation_on_planted_cuts(spark):
    rng, rows, cut = random.Random(9), [], set()
    for i, t in enumerate(_texts(3000, 10)):
        if len(t) > 200 and rng.random() < 0.5:
            if t[:200].rstrip()[-1] not in ".!" and t[200:201] not in (".", "!", ""):  # a cut right behind a sentence is none
                cut.add(i)
            t = t[:200] + rng.choice(["", "", "…"])
        rows.append((i, t, "shop"))
    rows += [(9000, "", "shop"), (9001, None, "shop"), (9002, "  ", None)]
    df = spark.createDataFrame(rows, "doc int, t string, s string").withColumns({"id": F.lit(1), "chars": F.lit(1), "source": F.lit(1)})
    limits = truncation.length_hazards(truncation.endings(df, "doc", "t", "s")).filter("significant and unit = 'chars'")
    assert {r["length"] for r in limits.collect()} == {200}
    got = {r["id"] for r in truncation.scored_endings(df, "doc", "t", "s").filter("truncated").collect()}
    assert len(got & cut) / len(cut) > 0.95 and len(got & cut) / len(got) > 0.95
    assert not got & {9000, 9001, 9002}
    assert truncation.scored_endings(df.limit(0), "doc", "t", "s").count() == 0


def test_every_shared_word_is_a_template_word(spark):
    words = [f"w{i}x" for i in range(4500)]
    items = spark.createDataFrame([(i, " ".join(words)) for i in range(3)], "item_id int, text string")
    assert sorted(leakage.template_words(items, "text")) == sorted(words)
    docs = spark.createDataFrame([(1, " ".join([*words[4480:4490], "99", *words[4490:]]))], "doc_id int, text string")
    asked = spark.createDataFrame([(9, " ".join([*words[4480:4490], "7", *words[4490:]]))], "item_id int, text string")
    assert [(r["doc_id"], r["item_id"]) for r in leakage.reworded_questions(docs, items.union(asked)).collect()] == [(1, 9)]


def test_automaton_finds_every_name_without_other_packages():
    rng = random.Random(5)
    for _ in range(200):
        names = {"".join(rng.choices("abc", k=rng.randint(1, 4))) for _ in range(8)}
        t = "".join(rng.choices("abcd", k=30))
        a = canonical_map.Automaton()
        for n in names:
            a.add_word(n, n)
        a.make_automaton()
        assert sorted(a.iter(t)) == sorted((i + len(n) - 1, n) for n in names for i in range(len(t)) if t.startswith(n, i))
    code = "import sys; sys.modules['ahocorasick'] = None; import __spark_entry__ as e; assert 'p1_found' in e.queries()"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=Path(__file__).parents[2])
    broken = "import sys; sys.modules['lexloom.llm.packing'] = None; import __spark_entry__"
    assert subprocess.run([sys.executable, "-c", broken], capture_output=True, cwd=Path(__file__).parents[2]).returncode != 0
