"""Generators of synthetic training pairs. Every choice is a function of the seed and the row; earlier generators win."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.functions import typos
from lexloom.functions.text import external_gate, domain_plausible, pick, rng_below
from lexloom.operators.cleaning import keep_first, oversample

# Brand, the brand that really has the line, and the line.
CONFUSIONS = [
    ("nvidia", "asus", "tuf gaming"), ("nvidia", "asus", "rog"), ("intel", "amd", "ryzen 7"), ("intel", "amd", "radeon"), ("amd", "nvidia", "geforce"), ("amd", "nvidia", "rtx"),
    ("samsung", "apple", "airpods"), ("apple", "samsung", "galaxy"), ("sony", "microsoft", "xbox"), ("microsoft", "sony", "playstation"), ("hp", "dell", "alienware"), ("dell", "acer", "predator"),
    ("hp", "lenovo", "thinkpad"), ("dell", "lenovo", "thinkpad"), ("apple", "microsoft", "surface"), ("nike", "adidas", "yeezy"), ("adidas", "nike", "jordan"), ("keurig", "nespresso", "vertuo"),
]
# Currency codes, unit spellings and amounts.
CODES = ["USD", "EUR", "GBP"]
UNIT_FORMS = {"gb": "GB", "tb": "TB", "mb": "MB", "hz": "Hz", "mhz": "MHz", "ghz": "GHz", "w": "W", "mah": "mAh", "kg": "kg", "mm": "mm", "cm": "cm", "mp": "MP"}
AMOUNTS = [5, 12, 24, 32, 64, 100, 120, 144, 256, 500]


def _row_id(*cols: str) -> Column:
    return F.concat_ws(" ", *cols)


def _filled(templates: list[str], seed: int | None, row: Column, **values: Column) -> Column:
    out = pick(templates, seed, row, "template") if seed is not None else F.col("template")
    for k, v in values.items():
        out = F.replace(out, F.lit("{" + k + "}"), v)
    return out


def example(wrong: Column, right: Column, category: str) -> list[Column]:
    return [wrong.alias("input_text"), right.alias("target_text"), F.lit(category).alias("category")]


def brand_products(catalog: DataFrame, templates: list[str], seed: int, per_pair: int = 3) -> DataFrame:
    """Query typos of ``brand, product`` in a template, ``per_pair`` for each: one wrong word in 65 of 100, two in 28, three in 7."""
    rows = catalog.withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(per_pair)))).withColumn("row", _row_id("brand", "product", "k"))
    rows = rows.withColumn("clean", _filled(templates, seed, F.col("row"), b=F.col("brand"), p=F.col("product")))
    r = rng_below(100, seed, F.col("row"), "errors")
    n = F.when(r < 65, 1).when(r < 93, 2).otherwise(3)
    rows = rows.withColumn("wrong", typos.query(F.col("clean"), seed, F.col("row"), n)).filter("wrong is not null")
    return rows.select(*example(F.col("wrong"), F.col("clean"), "ecom_query_typo")).distinct()


def generic(queries: DataFrame, modifiers: list[str], seed: int) -> DataFrame:
    rows = queries.withColumn("clean", F.concat_ws(" ", pick(modifiers, seed, F.col("id"), "modifier"), F.col("q")))
    rows = rows.withColumn("wrong", typos.query(F.col("clean"), seed, F.col("id"))).filter("wrong is not null")
    return rows.select("id", *example(F.col("wrong"), F.col("clean"), "generic_product_typo"))


def vocabulary_typos(words: DataFrame, seed: int) -> DataFrame:
    rows = words.filter(F.col("word").rlike("^[a-z]{4,15}$")).withColumn("wrong", typos.single(F.col("word"), seed, F.col("word")))
    return rows.filter("wrong is not null").select(*example(F.col("wrong"), F.col("word"), "vocab_typo"))


def phonetic_typos(queries: DataFrame, seed: int) -> DataFrame:
    """The longest word of a query by its sound."""
    words = F.filter(F.split("q", " "), lambda w: w != "")
    longest = F.aggregate(words, F.lit(""), lambda a, w: F.when(F.length(w) > F.length(a), w).otherwise(a))
    rows = queries.withColumn("word", longest).withColumn("t", typos.phonetic(F.col("word"), seed, F.col("id"))).filter("t is not null and t <> word")
    return rows.select(*example(F.array_join(F.transform(F.split("q", " "), lambda w: F.when(w == F.col("word"), F.col("t")).otherwise(w)), " "), F.col("q"), "phonetic_typo"))


def space_errors(queries: DataFrame, seed: int) -> DataFrame:
    rows = queries.withColumn("wrong", typos.space(F.col("q"), seed, F.col("id"))).filter("wrong is not null and wrong <> q")
    return rows.select(*example(F.col("wrong"), F.col("q"), "space_error"))


def identities(catalog: DataFrame, templates: list[str]) -> DataFrame:
    """Every brand and product in every template as it should stay."""
    rows = catalog.withColumn("template", F.explode(F.array(*[F.lit(t) for t in templates])))
    clean = _filled(templates, None, F.lit(""), b=F.col("brand"), p=F.col("product"))
    return rows.select(*example(clean, clean, "identity_query")).distinct()


def curated(mappings: DataFrame, brands: DataFrame, seed: int) -> DataFrame:
    """Known typos alone and, for each, with one brand in front."""
    alone = mappings.select(*example(F.col("wrong"), F.col("right"), "vocab_typo"))
    listed = brands.agg(F.array_sort(F.collect_set("brand")).alias("b"))
    rows = mappings.join(F.broadcast(listed)).withColumn("brand", F.get("b", rng_below(F.greatest(F.size("b"), F.lit(1)), seed, F.col("wrong"), "brand")))
    return alone.unionByName(rows.filter("brand is not null").select(*example(F.concat_ws(" ", "brand", "wrong"), F.concat_ws(" ", "brand", "right"), "ecom_query_typo")))


def prices(catalog: DataFrame, seed: int) -> DataFrame:
    """Price phrases as they should be and one mangled form of each."""
    row = _row_id("brand", "product")
    p = (rng_below(1991, seed, row, "p") + 10).cast("string")
    code = pick(CODES, seed, row, "code")
    kinds = F.array(F.concat(F.lit("under $"), p), F.concat(p, F.lit(" "), code), F.concat(code, F.lit(" "), p), F.concat(F.lit("for $"), p, F.lit(".99")))
    clean = F.concat_ws(" ", "brand", "product", F.get(kinds, rng_below(4, seed, row, "kind")))
    rows = catalog.select(row.alias("row"), clean.alias("clean"), code.alias("code"))
    c = F.col("clean")
    with_code = F.position(F.col("code"), c) > 0
    options = F.filter(
        F.array(
            F.when(c.contains("$"), F.regexp_replace(c, r"\$", r"\$ ")), F.when(c.contains("$"), F.replace(c, F.lit("$"), F.lit("dolar "))),
            F.when(with_code, F.replace(c, F.col("code"), F.lower("code"))), F.when(with_code, F.replace(c, F.col("code"), F.lit("uds"))), F.when(c.contains("."), F.replace(c, F.lit("."), F.lit(" ."))),
        ), lambda x: x.isNotNull() & (F.length(x) <= 80),
    )
    broken = F.get(options, rng_below(F.greatest(F.size(options), F.lit(1)), seed, F.col("row"), "mangle"))
    same = rows.select(*example(c, c, "price_identity"))
    wrong = rows.withColumn("broken", broken).filter("broken is not null and broken <> clean").select(*example(F.col("broken"), c, "price_typo"))
    return same.unionByName(wrong).distinct()


def units(catalog: DataFrame, seed: int) -> DataFrame:
    """Measures as they should be and one mangled form of each."""
    row = _row_id("brand", "product")
    low = pick(list(UNIT_FORMS), seed, row, "unit")
    good = F.element_at(F.create_map(*[F.lit(x) for kv in UNIT_FORMS.items() for x in kv]), low)
    n = pick([str(a) for a in AMOUNTS], seed, row, "amount")
    rows = catalog.select(row.alias("row"), "brand", "product", low.alias("low"), good.alias("good"), n.alias("n"))
    head = F.concat_ws(" ", "brand", "product")
    clean = F.concat_ws(" ", head, "n", "good")
    forms = F.filter(F.array(F.concat_ws(" ", head, "n", "low"), F.concat_ws(" ", head, F.concat("n", "low")), F.concat_ws(" ", head, F.concat("n", "good"))), lambda x: x != clean)
    broken = F.get(forms, rng_below(F.greatest(F.size(forms), F.lit(1)), seed, F.col("row"), "mangle"))
    return rows.select(*example(clean, clean, "unit_identity")).unionByName(rows.select(*example(broken, clean, "unit_typo")).filter("input_text is not null")).distinct()


def mismatches(spark: SparkSession, products: DataFrame) -> DataFrame:
    """Lines under the wrong brand, and under the right one as identities."""
    c = spark.createDataFrame(CONFUSIONS, "wrong_brand string, right_brand string, line string")
    rows = products.join(F.broadcast(c)).select(F.concat_ws(" ", "wrong_brand", "line", "product").alias("w"), F.concat_ws(" ", "right_brand", "line", "product").alias("r")).filter(F.length("w") <= 80)
    return rows.select(*example(F.col("w"), F.col("r"), "brand_category_mismatch")).unionByName(rows.select(*example(F.col("r"), F.col("r"), "brand_category_identity"))).distinct()


def augment(words: DataFrame, seed: int) -> DataFrame:
    """``id, word, op, typo``: every operator's typo of every word that changes it."""
    made = [(k, typos.omit(F.col("word")) if k == "omit" else typos.OPERATORS[k](F.col("word"), seed, F.col("id"))) for k in ["keyboard", "delete", "swap", "insert", "double", "omit", "phonetic"]]
    ops = F.array(*[F.struct(F.lit(k).alias("op"), c.alias("typo")) for k, c in made])
    return words.select("id", "word", F.explode(ops).alias("o")).select("id", "word", "o.op", "o.typo").filter("typo is not null and typo <> word")


def everyday(words: DataFrame, templates: list[str], seed: int) -> DataFrame:
    """Typos of everyday words, two in five inside a template with ``{w}``."""
    rows = words.withColumn("t", typos.single(F.col("word"), seed, F.col("word"))).filter("t is not null")
    inside = rng_below(5, seed, F.col("word"), "inside") < 2
    form = pick(templates, seed, F.col("word"), "form")
    fill = lambda c: F.when(inside, F.replace(form, F.lit("{w}"), c)).otherwise(c)
    return rows.select(*example(fill(F.col("t")), fill(F.col("word")), "everyday_english"))


def external(pairs: DataFrame) -> DataFrame:
    """Outside pairs that could come from a shop: both words plausible, not too far apart; and their right words as identities."""
    ok = plausible_pairs(pairs)
    return ok.select(*example(F.col("wrong"), F.col("right"), "external_word")).unionByName(ok.select(*example(F.col("right"), F.col("right"), "identity_external"))).distinct()


def plausible_pairs(pairs: DataFrame) -> DataFrame:
    """Pairs of different words whose right word is plausible in a shop and not too far from the wrong one."""
    low = pairs.select(F.lower(F.trim("wrong")).alias("wrong"), F.lower(F.trim("right")).alias("right"))
    return low.filter((F.col("wrong") != "") & domain_plausible(F.col("right")) & external_gate(F.col("wrong"), F.col("right")) & (F.col("wrong") != F.col("right"))).distinct()


def in_context(pairs: DataFrame, templates: list[str]) -> DataFrame:
    """Outside pairs inside each template with ``{x}``, and their right words in it as identities."""
    rows = plausible_pairs(pairs).withColumn("t", F.explode(F.array(*[F.lit(t) for t in templates])))
    wrong, right = F.replace("t", F.lit("{x}"), F.col("wrong")), F.replace("t", F.lit("{x}"), F.col("right"))
    return rows.select(*example(wrong, right, "external_context")).unionByName(rows.select(*example(right, right, "identity_external"))).distinct()


def existing_pairs(pairs: DataFrame) -> DataFrame:
    """Known pairs as they are: at most 15 words on either side, different by more than case; one word alone is a vocabulary typo."""
    low = pairs.select(F.trim("wrong").alias("wrong"), F.trim("right").alias("right"))
    words = lambda c: F.size(F.filter(F.split(c, r"(?U)\s+"), lambda w: w != ""))
    ok = low.filter((words("wrong").between(1, 15)) & words("right").between(1, 15) & (F.lower("wrong") != F.lower("right")))
    kind = F.when((words("wrong") == 1) & (words("right") == 1), F.lit("vocab_typo")).otherwise(F.lit("ecom_query_typo"))
    return ok.select(F.col("wrong").alias("input_text"), F.col("right").alias("target_text"), kind.alias("category")).distinct()


def identity_variants(names: DataFrame, name: str, templates: list[str], category: str) -> DataFrame:
    """Each name of a list in each template with ``{x}``, as it should stay."""
    rows = names.filter(F.col(name).isNotNull()).withColumn("t", F.explode(F.array(*[F.lit(t) for t in templates])))
    text = F.replace("t", F.lit("{x}"), F.col(name))
    return rows.select(*example(text, text, category)).distinct()


def typos_by_quota(queries: DataFrame, quotas: dict[str, int], seed: int) -> DataFrame:
    """Query typos of the simpler mix of operators, dealt over kinds by percent: ``id, input_text, target_text, category``."""
    word = F.element_at(F.split("q", " "), 1)
    dealt = quota_split(queries, "id", quotas, seed).withColumn("w", word)
    wrong = F.concat(typos.single_simple(F.col("w"), seed, F.col("id")), F.substr("q", F.length("w") + 1))
    rows = dealt.withColumn("wrong", wrong).filter("wrong is not null and wrong <> q")
    return rows.select("id", F.col("wrong").alias("input_text"), F.col("q").alias("target_text"), F.concat(F.lit("ecom_"), "kind", F.lit("_typo")).alias("category"))


def oversampled(df: DataFrame, times: dict[str, int]) -> DataFrame:
    return oversample(df, "category", times)


def combined(parts: list[DataFrame]) -> DataFrame:
    """All generators' pairs; of equal pairs the one of the earliest generator."""
    out = None
    for i, p in enumerate(parts):
        p = p.select("input_text", "target_text", "category", F.lit(i).alias("generator"))
        out = p if out is None else out.unionByName(p)
    return keep_first(out, ["input_text", "target_text"], "generator")


def quota_split(df: DataFrame, key: str, quotas: dict[str, int], seed: int) -> DataFrame:
    """``kind`` added: rows dealt over kinds by percent."""
    r, out = rng_below(100, seed, F.col(key), "quota"), F.lit(None).cast("string")
    for kind in reversed(quotas):
        out = F.when(r < sum(v for k, v in list(quotas.items())[: list(quotas).index(kind) + 1]), F.lit(kind)).otherwise(out)
    return df.withColumn("kind", out)


def sampled_cross(left: DataFrame, right: DataFrame, right_key: str, per_left: int, seed: int, left_key: str) -> DataFrame:
    """A few partners for each left row out of a bounded list, picked by index and not by a cross product."""
    listed = right.agg(F.array_sort(F.collect_set(right_key)).alias("_all"))
    rows = left.join(F.broadcast(listed)).withColumn("_k", F.explode(F.sequence(F.lit(1), F.lit(per_left))))
    at = rng_below(F.greatest(F.size("_all"), F.lit(1)), seed, F.concat_ws(" ", F.col(left_key).cast("string"), F.col("_k").cast("string")), "partner")
    return rows.withColumn(right_key, F.get("_all", at)).drop("_all", "_k").distinct()
