"""Operators that SQL cannot check, and the edge cases of those it can."""

import difflib
import json

import duckdb
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lexloom.functions import text, typos
from lexloom.operators import cleaning, correct, evaluate, harness, masking, matching, protect
from lexloom.operators.skew import join_back
from lexloom.plans import correction as correction_plans
from lexloom.plans import matching as matching_plans
from lexloom.plans import pairs as pairs_plans
from lexloom.plans import reports
from lexloom.plans.pairs import _lines
from lexloom.sources import readers, sinks
from lexloom.streaming import streams


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values))
    return row.select(column.alias("x")).first()["x"]


CATALOG = [("iPhone", ["iphone"], True, 5), ("Samsung", ["samsung"], True, 6), ("Samsung Galaxy", ["samsung galaxy"], False, 10), ("Samsung Galaxy S24 Ultra", ["samsung galaxy s24 ultra"], False, 20), ("MacBook Pro", ["macbook pro"], True, 10), ("Razer", ["razer"], True, 4), ("Apple", ["apple"], True, 4), ("C++", ["c++"], False, 3)]


@pytest.fixture(scope="module")
def masked(spark):
    catalog = spark.createDataFrame([(c, a, e, m) for c, a, e, m in CATALOG], "canonical string, exact_aliases array<string>, symspell_eligible boolean, min_match_length int")
    deny = spark.createDataFrame([("apple",), ("shell",)], "word string")
    english = spark.createDataFrame([("apply",), ("razer",), ("mouse",)], "word string")
    cases = ["samsung galaxy s24 ultra", "samsungs", "(samsung)", "SamSung tv", "samsng tv", "samsugn", "macbookpro", "apply now", "razr mouse", "s24", "apple pie", "learn c++ now", "", None, "iphone and samsung"]
    rows = spark.createDataFrame(list(enumerate(cases)), "id int, t string")
    out = masking.mask_texts(rows, catalog, deny, english, "id", "t").collect()
    return {cases[r["id"]]: (r["masked"], [m["canonical"] for m in r["mask_map"]]) for r in out}


@pytest.mark.parametrize(
    ("case", "masked_text", "names"),
    [
        ("samsung galaxy s24 ultra", "<<M0>>", ["Samsung Galaxy S24 Ultra"]), ("samsungs", "<<M0>>", ["Samsung"]), ("(samsung)", "(<<M0>>)", ["Samsung"]), ("SamSung tv", "<<M0>> tv", ["Samsung"]),
        ("samsng tv", "<<M0>> tv", ["Samsung"]), ("samsugn", "<<M0>>", ["Samsung"]), ("macbookpro", "<<M0>>", ["MacBook Pro"]), ("apply now", "apply now", []), ("razr mouse", "<<M0>> mouse", ["Razer"]),
        ("s24", "s24", []), ("apple pie", "apple pie", []), ("learn c++ now", "learn <<M0>> now", ["C++"]), ("", "", []), (None, None, []), ("iphone and samsung", "<<M0>> and <<M1>>", ["iPhone", "Samsung"]),
    ],
)
def test_masking(masked, case, masked_text, names):
    assert masked[case] == (masked_text, names)


@pytest.mark.parametrize(
    ("out", "want", "left"),
    [("<<M0>> and <<M1>>", "A and B", 0), ("<<m0>> <<M1>>", "A B", 0), ("<< M O >> <<M1>>", "A B", 0), ("<M0> <<M1>>", "A B", 0), ("<X0> <<M1>>", "A B", 0), ("gone <<M1>>", "gone B", 1), ("", "", 2)],
)
def test_unmask(spark, out, want, left):
    df = spark.createDataFrame([(out, [("<<M0>>", "A"), ("<<M1>>", "B")])], "t string, m array<struct<token:string,canonical:string>>")
    r = masking.unmask_texts(df, "t", "m").first()
    assert (r["restored"], r["unrestored"]) == (want, left)


def test_resolve_is_the_greedy_loop(spark):
    spans = [(0, 3, "a"), (2, 9, "b"), (9, 12, "c"), (10, 12, "d"), (0, 2, "e")]
    df = spark.createDataFrame([(spans,)], "s array<struct<start:int,end:int,canonical:string>>")
    got = [x["canonical"] for x in df.select(matching.resolve(F.col("s")).alias("r")).first()["r"]]
    kept = []
    for s in sorted(spans, key=lambda s: (-(s[1] - s[0]), s[0])):
        if all(s[1] <= k[0] or k[1] <= s[0] for k in kept):
            kept.append(s)
    assert got == [k[2] for k in sorted(kept)]


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text("abcé", min_size=1, max_size=6), min_size=2, max_size=12))
def test_similarity_join_is_complete(spark, words):
    def lev(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            prev, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                prev, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, prev + (x != y))
        return row[-1]

    df = spark.createDataFrame([(w,) for w in words], "w string")
    got = {(r["left"], r["right"], r["distance"]) for r in cleaning.similarity_join(df, "w", df, "w").collect()}
    assert got == {(a, b, lev(a, b)) for a in set(words) for b in set(words) if 1 <= lev(a, b) <= 2}


def test_filter_rules_follow_the_loop(spark):
    pairs = [("a b c", "x"), ("a b c", "y"), ("a b c", "x"), ("a b c", "y"), ("", "z"), ("né", "ne")]
    df = spark.createDataFrame([(i, a, b, "identity_x") for i, (a, b) in enumerate(pairs)], "ord int, input_text string, target_text string, category string")
    got = [r["rule"] for r in cleaning.label_pairs(df).orderBy("ord").collect()]
    assert got == ["keep", "conflict", "duplicate", "conflict", "empty", "non_ascii"]


def test_marker_makes_short_pairs_look_far(spark):
    df = spark.createDataFrame([(1, "correct: keybord", "keyboard", "t"), (2, "correct: samsng galaxy", "samsung galaxy", "t")], "ord int, input_text string, target_text string, category string")
    assert [r["rule"] for r in cleaning.label_pairs(df).orderBy("ord").collect()] == ["edit_share", "keep"]
    assert [r["rule"] for r in cleaning.label_pairs(df, prefixed=False).orderBy("ord").collect()] == ["keep", "keep"]


def test_smallest_by_hash_takes_exactly(spark):
    df = spark.range(500).withColumnRenamed("id", "k")
    for n in (0, 1, 137, 500, 900):
        rows = [r["k"] for r in cleaning.smallest_by_hash(df, "k", n, 3).collect()]
        assert len(rows) == len(set(rows)) == min(n, 500)


def test_join_back_with_hot_and_null_keys(spark):
    rows = spark.createDataFrame([(i, None if i % 10 == 0 else "hot" if i % 3 else f"k{i}") for i in range(3000)], "id int, k string")
    groups = rows.filter("k is not null").groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first"))
    out = join_back(rows, groups, "k", "n", 3000, ["first"])
    assert out.count() == 3000
    assert out.filter("k is null and first is not null").count() == 0
    assert out.filter("k is not null and first is null").count() == 0
    assert {r["first"] for r in out.filter("k = 'hot'").select("first").distinct().collect()} == {1}


def test_similarity_and_confidence(spark):
    for a, b in [("samsng", "samsung"), ("", ""), ("ab", "ba")]:
        assert one(spark, text.similarity(F.col("a"), F.col("b")), a=a, b=b) == pytest.approx(difflib.SequenceMatcher(None, a, b).ratio())
    assert one(spark, text.confidence(F.col("a"), F.col("b")), a="x", b="x") == 1.0


def test_typos_repeat_and_decline(spark):
    df = spark.createDataFrame([(i, w) for i, w in enumerate(["keyboard", "mouse", "ab", "a", ""])], "id int, w string")
    for name, op in typos.OPERATORS.items():
        a = [r[0] for r in df.select(op(F.col("w"), 1, F.col("id")).alias("t")).collect()]
        assert a == [r[0] for r in df.repartition(3).orderBy("id").select(op(F.col("w"), 1, F.col("id")).alias("t")).collect()], name
        assert a[4] is None


def test_protected_prefix(spark):
    p = one(spark, protect.protected_prefix(F.col("t")), t="iphone")
    assert p is None or p["entity"] != "IPHONE"
    assert one(spark, protect.protected_prefix(F.col("t")), t="USB-C")["rest"] == "-C"
    assert one(spark, protect.protected_prefix(F.col("t"), fuzzy=True), t="qzx") is not None


def test_registered_model(spark):
    def shout(batches):
        for pdf in batches:
            yield pdf.assign(text=pdf["text"].str.upper())

    correct.register_model("shout", shout)
    df = spark.createDataFrame([(1, "a"), (2, None)], "id int, text string")
    assert {r["id"]: r["corrected"] for r in correct.run_model(df, "shout").collect()} == {1: "A", 2: None}
    assert "shout" in correct.list_models()


def test_pipeline_gives_every_row_once(spark):
    df = spark.createDataFrame([(1, "blak shoos"), (2, ""), (3, None), (4, "usb cabel"), (5, "  ")], "id int, text string")
    m = spark.createDataFrame([("blak", "black"), ("shoos", "shoes")], "wrong string, right string")
    f = spark.createDataFrame([("cabel", "cable")], "wrong string, right string")
    out = {r["id"]: (r["corrected"], r["source"]) for r in correct.four_stages(df, m, f, F.array(F.lit("usb"))).collect()}
    assert out == {1: ("black shoes", "model"), 2: ("", "none"), 3: (None, "none"), 4: ("usb cable", "model+fallback"), 5: ("  ", "none")}


def test_files(spark, tmp_path):
    (tmp_path / "c.jsonl").write_text('# c\n{"canonical": "LG"}\nbroken\n\n{"brand": "x"}\n' + json.dumps({"canonical": "Sony TV", "brand": "Sony", "exact_aliases": ["sony tv"]}) + "\n")
    got = {r["canonical"]: r for r in readers.read_catalog(spark, str(tmp_path / "c.jsonl")).collect()}
    assert set(got) == {"LG", "Sony TV"}
    assert got["LG"]["brand"] == "LG" and got["LG"]["min_match_length"] == 4 and got["LG"]["category"] == "general"
    assert readers.read_catalog(spark, str(tmp_path / "none")).count() == 0
    (tmp_path / "w.txt").write_text("Apple\n# no\n= rule\napple\n")
    assert {r["word"] for r in readers.word_list(spark, str(tmp_path / "w.txt"), skip_rules=True).collect()} == {"apple"}
    (tmp_path / "p.csv").write_text('noisy,clean\n"a, b",ab\nx,\n')
    assert [tuple(r) for r in readers.csv_pairs(spark, str(tmp_path / "p.csv")).collect()] == [("a, b", "ab")]
    pairs = spark.createDataFrame([("a", "b"), ("a", "b"), ("c", "c")], "wrong string, right string")
    sinks.pairs_tsv(pairs, str(tmp_path / "t"))
    assert spark.read.csv(str(tmp_path / "t"), sep="\t").count() == 1
    sinks.pairs_tsv(pairs, str(tmp_path / "u"), identities=True)
    assert spark.read.csv(str(tmp_path / "u"), sep="\t").count() == 2
    res = spark.createDataFrame([(1, "m"), (2, "m")], "id int, model string")
    sinks.append_results(res, str(tmp_path / "r"), ["id", "model"])
    sinks.append_results(res, str(tmp_path / "r"), ["id", "model"])
    assert spark.read.parquet(str(tmp_path / "r")).count() == 2
    assert readers.quoted_pairs(_lines(spark, ["noisy,clean", '"a","b"', "c,d"])).count() == 2
    later = [(r["wrong"], r["right"]) for r in readers.quoted_pairs(_lines(spark, ["Vacum,Vacuum", '"Clener","CLEANER"', "noisy,clean", '"a, b","c"'])).collect()]
    assert sorted(later) == [("a, b", "c"), ("clener", "cleaner"), ("noisy", "clean"), ("vacum", "vacuum")]
    long = "w" * 3000
    got = [(r["wrong"], r["right"]) for r in readers.external_pairs(_lines(spark, ["same -> same", "x => X", "a b", "b b", "$" + long, "bare", long])).collect()]
    assert got == [("a", "b"), ("bare", long)]


def test_harness_tries_again_and_keeps_errors(spark):
    state = {"calls": 0}

    def flaky(text):
        state["calls"] += 1
        if state["calls"] % 2:
            raise RuntimeError("busy")
        return text + "!"

    q = spark.createDataFrame([(1, "a"), (2, None)], "id int, query string").coalesce(1)
    out = {(r["model"], r["id"]): r for r in harness.run_models(q, "query", {"flaky": flaky, "dead": reports._broken}, pause=0.0).collect()}
    assert len(out) == 4 and out["flaky", 1]["corrected"] == "a!" and out["flaky", 2]["corrected"] == "!" and out["flaky", 1]["error"] == ""
    assert out["dead", 1]["error"] == "ValueError: no model" and out["dead", 1]["corrected"] == "" and not out["dead", 1]["changed"]
    assert harness.run_models(q.limit(0), "query", {"flaky": flaky}).count() == 0


def test_report_has_its_sections(spark):
    rows = [("m", "1", "a b", "a c", "short", "L2", "x", "a c", "", 5.0, 1), ("n", "1", "a b", "a c", "short", "L2", "x", "a b", "", 9.0, 2), ("n", "2", "q", "q", "short", "L1", "y", "", "boom", 0.0, 3)]
    df = spark.createDataFrame(rows, "model string, id string, query string, expected string, length string, difficulty string, category string, corrected string, error string, latency_ms double, result_id int")
    text = evaluate.report(df)
    assert text.count("\n## ") == 2 and "| m | 1 | 100.0 |" in text and "| n | 1 | 0.0 |" in text


def test_streams(spark, tmp_path):
    spark.createDataFrame([("a samsung tv",), ("samsung galaxy",), (None,)], "t string").write.parquet(str(tmp_path / "in"))
    s = spark.readStream.schema("t string").parquet(str(tmp_path / "in"))
    out = streams.restored_stream(streams.masked_stream(s, "t", {"samsung": "Samsung", "samsung galaxy": "Samsung Galaxy"}), "masked", "mask_map")
    q = out.writeStream.format("memory").queryName("masked_rows").trigger(availableNow=True).start()
    q.awaitTermination(60)
    got = {r["t"]: (r["masked"], r["restored"]) for r in spark.table("masked_rows").collect()}
    assert got == {"a samsung tv": ("a <<M0>> tv", "a Samsung tv"), "samsung galaxy": ("<<M0>>", "Samsung Galaxy"), None: (None, None)}


def test_protect_lookup_takes_every_token(spark, tmp_path):
    queries = ["€ €! €? 50 £", "NESTLÉ nestlé Nestle nestlée", "häagen-dazs HÄAGEN-DAZ", "ТВ usb İkea", "", None]
    spark.createDataFrame(list(enumerate(queries)), "request_id long, query string").write.parquet(str(tmp_path / "correction_requests.parquet"))

    def near(a, b):
        """At most one letter wrong, missing or extra: what is left when the equal start and end are taken off."""
        i = 0
        while i < min(len(a), len(b)) and a[i] == b[i]:
            i += 1
        return a[i:] == b[i:] or a[i + 1 :] == b[i:] or a[i:] == b[i + 1 :] or a[i + 1 :] == b[i + 1 :]

    kinds = {e: k for k in reversed(protect.ENTITIES) for e in protect.ENTITIES[k]}
    want = set()
    for t in {t for q in queries if q for t in q.split()}:
        found = sorted((int(t.upper() != e), e) for e in kinds if near(t.upper(), e))
        if found:
            want.add((t, found[0][1], kinds[found[0][1]], found[0][0]))
    got = {tuple(r) for r in matching_plans.QUERIES["protect_lookup"](spark, str(tmp_path)).select("token", "entity", "category", "distance").collect()}
    assert got == want
    assert {("€", "€", "currency", 0), ("nestlé", "NESTLÉ", "brand", 0), ("häagen-dazs", "HÄAGEN-DAZS", "brand", 0)} <= got


def test_correction_queries_take_what_was_typed(spark, tmp_path):
    labelled = [("q1", "blak shoos", "black shoes"), ("q2", "usb cabel", "usb cable")]
    spark.createDataFrame(labelled, "id string, query string, expected string").write.parquet(str(tmp_path / "eval_queries.parquet"))
    typed = [None, "", "  ", "Blak  shoos", "blak shoos", "купить чехол", "usb cabel", "ｂｌａｋ shoos"]
    spark.createDataFrame(list(enumerate(typed)), "request_id long, query string").write.parquet(str(tmp_path / "correction_requests.parquet"))

    def run(name):
        rows = correction_plans.QUERIES[name](spark, str(tmp_path)).collect()
        assert sorted(r["id"] for r in rows) == list(range(len(typed))), name
        return {r["id"]: r for r in rows}

    got = {i: (r["corrected"], r["source"]) for i, r in run("v3_pipeline").items()}
    assert got == {0: (None, "none"), 1: ("", "none"), 2: ("  ", "none"), 3: ("black shoes", "model"), 4: ("black shoes", "model"), 5: ("купить чехол", "none"), 6: ("usb cable", "model"), 7: ("black shoes", "model")}
    assert {i: r["corrected"] for i, r in run("model_stage_requests").items()} == {0: None, 1: "", 2: "  ", 3: "black shoes", 4: "black shoes", 5: "купить чехол", 6: "usb cable", 7: "ｂｌａｋ shoes"}
    assert {i for i, r in run("response_rows").items() if r["changed"]} == {3, 4, 6, 7}
    assert (run("protect_query")[6]["masked"], run("protect_query")[0]["masked"]) == ("[ABBREVIATION_0] cabel", None)


def test_whole_tables_are_masked_and_merged(spark, tmp_path):
    """The constant rows of the small queries as tables: the forms over whole tables give what the statements list."""
    typed = [*correction_plans.TEXTS, (90, None), (91, "nestlébar €50 h&mdress flat")]
    spark.createDataFrame(typed, "request_id long, query string").write.parquet(str(tmp_path / "correction_requests.parquet"))

    def rows(name):
        return {r["id"]: tuple(r)[1:] for r in correction_plans.QUERIES[name](spark, str(tmp_path)).collect()}

    con = duckdb.connect()
    for name in ("unit_mask", "price_mask", "price_mask_v1"):
        want = {r[0]: r[1:] for r in con.execute(correction_plans.SQL[name]).fetchall()}
        got = rows(name + "_requests")
        assert set(got) == {i for i, _ in typed} and {i: got[i] for i in want} == want, name
        assert got[90][0] is None
    assert rows("price_mask_requests")[91] == ("nestlébar [PRICE_0] h&mdress flat", "€50")
    for name, texts in (("merge_brand", correction_plans.MERGES), ("postprocess_validate", correction_plans.VALIDATE)):
        spark.createDataFrame(texts, "result_id long, query string, corrected string").write.mode("overwrite").parquet(str(tmp_path / "results.parquet"))
        assert rows(name + "_results") == {r[0]: r[1:] for r in con.execute(correction_plans.SQL[name]).fetchall()}
    spark.createDataFrame([(1, "chep hedphones", "cheap hedfones"), (2, "red tv", "red tv"), (3, "cabel", "")], "result_id long, query string, corrected string").write.mode("overwrite").parquet(str(tmp_path / "results.parquet"))
    assert rows("merge_fallback_results") == {1: ("cheap headphones",), 2: ("red tv",), 3: ("",)}

    kinds = {e: k for k in reversed(protect.ENTITIES) for e in protect.ENTITIES[k]}
    want = set()
    for i, q in typed:
        for k, t in enumerate((q or "").split()):
            n = next((n for n in range(len(t), 0, -1) if t[:n].upper() in kinds), 0)
            if n:
                want.add((i, k, t[:n].upper(), kinds[t[:n].upper()], t[n:]))
    got = {tuple(r) for r in correction_plans.QUERIES["prefix_match"](spark, str(tmp_path)).collect()}
    assert got == want and (91, 0, "NESTLÉ", "brand", "bar") in got


def test_targets_grow_with_the_table(spark, tmp_path):
    rows = spark.range(6000).selectExpr("id as example_id", "concat('a', id) as input_text", "concat('b', id) as target_text", "if(id < 2100, 'identity_x', 'typo') as category")
    rows.write.parquet(str(tmp_path / "eval_v3.parquet"))
    got = {n: [r["ord"] for r in pairs_plans.QUERIES[n](spark, str(tmp_path)).collect()] for n in ("balance_identity_share", "trim_target_share")}
    assert len(set(got["balance_identity_share"])) == len(got["balance_identity_share"]) == 4000
    assert set(range(2100)) <= set(got["balance_identity_share"])
    assert len(set(got["trim_target_share"])) == 5800 and set(range(2100, 6000)) <= set(got["trim_target_share"])
