"""Queries of the typo operators and the dataset generators."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexloom.functions import typos
from lexloom.operators import generate
from lexloom.plans.common import MODIFIERS, SEED, SQL_PART, TEMPLATES, part_words, sql_rng, word_pairs
from lexloom.session import table

EVERYDAY = ["where to buy {w}", "{w} near me", "best {w} today"]
QUOTAS = {"brand": 40, "product": 25, "query": 30, "model": 5}


def _word_typo(name):
    def run(s, d):
        p = part_words(s, d)
        fn = typos.OPERATORS[name]
        on = F.col("q") if name in ("space", "query") else F.col("w")
        return p.select("id", fn(on, SEED, F.col("id")).alias("typo"))

    return run


def _catalog(s, d):
    """``brand, product``: the catalogue's brands with their lines, a bounded reference list."""
    c = table(s, d, "brand_catalog").filter("canonical is not null")
    w = F.split("canonical", " ")
    return c.filter(F.size(w) >= 2).select(F.lower(F.get(w, F.lit(0))).alias("brand"), F.lower(F.get(w, F.lit(1))).alias("product")).distinct()


QUERIES = {f"typo_{k}": _word_typo(k) for k in ["keyboard", "delete", "swap", "insert", "double", "phonetic", "space", "single", "compound", "query", "keyboard_letters", "delete_doubled", "single_simple"]} | {
    "typo_omit": lambda s, d: part_words(s, d).select("id", typos.omit(F.col("w")).alias("typo")),
    "gen_brand_product": lambda s, d: generate.brand_products(_catalog(s, d), TEMPLATES, SEED),
    "gen_generic": lambda s, d: generate.generic(table(s, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("q")), MODIFIERS, SEED),
    "gen_price": lambda s, d: generate.prices(_catalog(s, d), SEED),
    "gen_units": lambda s, d: generate.units(_catalog(s, d), SEED),
    "gen_mismatch": lambda s, d: generate.mismatches(s, table(s, d, "part").select(F.col("p_name").alias("product")).distinct()),
    "gen_identity": lambda s, d: generate.identities(_catalog(s, d), TEMPLATES),
    "gen_aug": lambda s, d: generate.augment(part_words(s, d).select("id", F.col("w").alias("word")), SEED),
    "typo_keyboard_inner": lambda s, d: part_words(s, d).select("id", typos.keyboard_letters(F.col("w"), SEED, F.col("id"), inner=True).alias("typo")),
    "gen_space": lambda s, d: generate.space_errors(part_words(s, d), SEED),
    "gen_phonetic": lambda s, d: generate.phonetic_typos(part_words(s, d), SEED),
    "gen_vocab": lambda s, d: generate.vocabulary_typos(part_words(s, d).select(F.col("w").alias("word")).distinct(), SEED),
    "gen_curated": lambda s, d: generate.curated(word_pairs(s, d), _catalog(s, d), SEED),
    "gen_everyday": lambda s, d: generate.everyday(part_words(s, d).select(F.col("w").alias("word")).distinct(), EVERYDAY, SEED),
    "gen_external": lambda s, d: generate.external(word_pairs(s, d)),
    "gen_combined": lambda s, d: generate.combined([generate.identities(_catalog(s, d), TEMPLATES), generate.brand_products(_catalog(s, d), TEMPLATES, SEED), generate.prices(_catalog(s, d), SEED)]).groupBy("category").agg(F.count(F.lit(1)).alias("n")),
    "gen_quota": lambda s, d: generate.quota_split(part_words(s, d), "id", QUOTAS, SEED).groupBy("kind").agg(F.count(F.lit(1)).alias("n")),
    "grouped_products": lambda s, d: table(s, d, "brand_catalog").filter("canonical is not null").groupBy(F.coalesce("category", F.lit("other")).alias("category")).agg(F.countDistinct("canonical").alias("n"), F.min("canonical").alias("first")),
    "gen_oversample": lambda s, d: generate.oversampled(table(s, d, "eval_v3"), {"price_typo": 2, "unit_typo": 3, "hard_negative": 5}).groupBy("category").agg(F.count(F.lit(1)).alias("n")),
}


def _case(d: dict[str, str], ch: str) -> str:
    return f"case {ch} " + " ".join(f"when '{k}' then '{v}'" for k, v in d.items()) + " end"


_LETTERS = {k: "".join(c for c in v if c.isalpha()) for k, v in typos.KEYBOARD.items()}
_ONE = {k: "|".join(v) for k, v in typos.PHONETIC.items()}
_SINGLES = ", ".join("'" + k + "'" for k in typos.PHONETIC if len(k) == 1)
_DIGRAPHS = "[" + ", ".join("'" + k + "'" for k in typos.DIGRAPHS) + "]"


def _sql(name: str, w: str, seed: int = SEED) -> str:
    """A typo operator as a DuckDB expression over a column."""
    r = lambda slot, n: sql_rng(slot, n, seed=seed)
    n = f"length({w})"
    if name == "keyboard":
        ch = f"lower({w}[{r('k.at', f'greatest({n}, 1)')} + 1])"
        near = f"(case when regexp_full_match({w}, '[A-Za-z]+') then {_case(_LETTERS, ch)} else {_case(typos.KEYBOARD, ch)} end)"
        at = r("k.at", f"greatest({n}, 1)")
        return f"case when {n} >= 2 and length({near}) > 0 then substr({w}, 1, {at}) || {near}[{r('k.key', f'length({near})')} + 1] || substr({w}, {at} + 2) end"
    if name == "delete":
        at = f"({r('d.at', f'greatest({n} - 2, 1)')} + 1)"
        return f"case when {n} >= 4 then substr({w}, 1, {at}) || substr({w}, {at} + 2) end"
    if name == "swap":
        at = r("s.at", f"greatest({n} - 1, 1)")
        return f"case when {n} >= 3 then substr({w}, 1, {at}) || substr({w}, {at} + 2, 1) || substr({w}, {at} + 1, 1) || substr({w}, {at} + 3) end"
    if name == "insert":
        at = r("i.at", f"{n} + 1")
        return f"case when {n} >= 2 then substr({w}, 1, {at}) || chr((97 + {r('i.key', 26)})::int) || substr({w}, {at} + 1) end"
    if name == "double":
        at = r("2.at", f"greatest({n}, 1)")
        return f"case when {n} >= 3 then substr({w}, 1, {at} + 1) || substr({w}, {at} + 1) end"
    if name == "omit":
        at = f"list_filter(range(1, {n}), lambda i: {w}[i] = {w}[i + 1])[1]"
        return f"case when {n} >= 4 and {at} is not null then substr({w}, 1, {at}) || substr({w}, {at} + 2) end"
    if name == "phonetic":
        pairs = f"list_filter({_DIGRAPHS}, lambda d: contains(lower({w}), d))"
        pair = f"{pairs}[{r('p.pair', f'greatest(len({pairs}), 1)')} + 1]"
        opts = f"string_split({_case(_ONE, pair)}, '|')"
        by_pair = f"substr({w}, 1, instr(lower({w}), {pair}) - 1) || {opts}[{r('p.sound', f'greatest(len({opts}), 1)')} + 1] || substr({w}, instr(lower({w}), {pair}) + 2)"
        places = f"list_filter(range(1, {n} + 1), lambda i: lower({w})[i] in ({_SINGLES}))"
        i = f"{places}[{r('p.at', f'greatest(len({places}), 1)')} + 1]"
        one = f"string_split({_case(_ONE, f'lower({w})[{i}]')}, '|')"
        by_letter = f"substr({w}, 1, {i} - 1) || {one}[{r('p.sound', f'greatest(len({one}), 1)')} + 1] || substr({w}, {i} + 1)"
        return f"case when {n} < 3 then null when len({pairs}) > 0 then {by_pair} when len({places}) > 0 then {by_letter} end"
    raise KeyError(name)


def _single(w: str, source: str, seed: int = SEED) -> str:
    """The weighted single typo over a word column of a source with an id; gives ``id, q, w, typo``."""
    made = ", ".join(f"{_sql(k, 'w', seed)} as t_{k}" for k in typos.WEIGHTS)
    upto, arms = 0, []
    for k, v in typos.WEIGHTS.items():
        upto += v
        arms.append(f"when r < {upto} then t_{k}")
    draws = ", ".join(f"(select case {' '.join(arms)} end from (select {sql_rng(f'1.{k}', 100, seed=seed)} as r))" for k in range(7))
    return f"(with m as (select id, q, w, {made} from (select id, q, {w} as w from {source})) select id, q, w, list_filter([{draws}], lambda t: t is not null and t <> w and length(t) >= 2)[1] as typo from m)"


def _query(source: str, errors: str = "1") -> str:
    """The query typo over a source of ``id, q``; gives ``id, q, typo``."""
    return f"""
with t as (select id, q, {errors} as n, list_filter(string_split(q, ' '), lambda w: w <> '') as a from {source}),
u as (select id as qid, n, unnest(a) as w, generate_subscripts(a, 1) as i from t),
e as (select *, concat_ws('.', qid, i) as id from u where regexp_full_match(w, '[A-Za-z]{{3,}}')),
p as (select id, w as q, qid, i, w from (select *, row_number() over (partition by qid order by {sql_rng('q.word', 4294967296)}, i) as k from e) where k <= n),
one as (select id, w as q, w, typo as x from {_single('w', 'p')}),
two as (select id, typo as y from {_single('x', 'one', SEED + 1)}),
m as (select id, case when {sql_rng('q.twice', 4)} = 0 then case when length(w) >= 4 then coalesce(y, x) end else x end as new from one join two using (id)),
r as (select u.qid as id, string_agg(coalesce(m.new, u.w), ' ' order by u.i) as typo, count(p.id) as places from u left join p on p.qid = u.qid and p.i = u.i left join m on m.id = p.id group by u.qid)
select t.id, t.q, case when places > 0 and typo <> t.q then typo end as typo from t left join r on r.id = t.id"""


def _keys(edge: int) -> str:
    at = f"({sql_rng('k.at', f'greatest(length(w) - {2 * edge}, 1)')} + {edge})"
    near = _case(_LETTERS, f"lower(w[{at} + 1])")
    return f"case when length(w) >= {2 + edge} and length({near}) > 0 then substr(w, 1, {at}) || ({near})[{sql_rng('k.key', f'length({near})')} + 1] || substr(w, {at} + 2) end"


_GENERIC = f"(select id, ({MODIFIERS})[{sql_rng('modifier', len(MODIFIERS))} + 1] || ' ' || q as q from {SQL_PART})"
_BRANDED = f"""(with c as (select distinct lower(string_split(canonical, ' ')[1]) as b, lower(string_split(canonical, ' ')[2]) as p from brand_catalog where len(string_split(canonical, ' ')) >= 2),
  k as (select b, p, concat_ws(' ', b, p, k) as id from c, (values (1), (2), (3)) t(k)) select id, replace(replace(({TEMPLATES})[{sql_rng('template', len(TEMPLATES))} + 1], '{{b}}', b), '{{p}}', p) as q from k)"""
_ERRORS = f"(case when {sql_rng('errors', 100)} < 65 then 1 when {sql_rng('errors', 100)} < 93 then 2 else 3 end)"
_SPACE = f"""
with t as (select id, list_filter(string_split(q, ' '), lambda w: w <> '') as a from {SQL_PART}),
r as (select *, {sql_rng('b.mode', 2)} as mode, {sql_rng('b.join', 'greatest(len(a) - 1, 1)')} + 1 as i, list_filter(range(1, len(a) + 1), lambda k: length(a[k]) >= 6) as long from t),
u as (select *, long[{sql_rng('b.word', 'greatest(len(long), 1)')} + 1] as k from r),
v as (select *, a[k] as word, {sql_rng('b.cut', 'greatest(length(a[k]) - 3, 1)')} + 2 as pos from u)
select id, case when len(a) < 2 then null when mode = 0 then array_to_string(list_concat(a[1:i - 1], [a[i] || a[i + 1]], a[i + 2:]), ' ')
  when len(long) > 0 then array_to_string(list_concat(a[1:k - 1], [substr(word, 1, pos) || ' ' || substr(word, pos + 1)], a[k + 1:]), ' ') end as typo from v"""

SQL = {f"typo_{k}": f"select id, {_sql(k, 'w')} as typo from {SQL_PART}" for k in ["keyboard", "delete", "swap", "insert", "double", "omit", "phonetic"]} | {
    "typo_space": _SPACE,
    "typo_single": f"select id, typo from {_single('w', SQL_PART)}",
    "typo_compound": f"with f as (select id, w as q, typo as x from {_single('w', SQL_PART)}) select id, case when length(q) >= 4 then coalesce(typo, w) end as typo from {_single('x', 'f', SEED + 1)}",
    "typo_query": f"select id, typo from ({_query(SQL_PART)})",
    "gen_generic": f"select id, typo as input_text, q as target_text, 'generic_product_typo' as category from ({_query(_GENERIC)}) where typo is not null",
    "gen_brand_product": f"select distinct typo as input_text, q as target_text, 'ecom_query_typo' as category from ({_query(_BRANDED, _ERRORS)}) where typo is not null",
    "gen_space": f"select typo as input_text, q as target_text, 'space_error' as category from ({_SPACE}) join {SQL_PART} using (id) where typo is not null and typo <> q",
    "gen_vocab": f"select typo as input_text, w as target_text, 'vocab_typo' as category from {_single('w', "(select distinct w as id, w as q, w from " + SQL_PART + " where regexp_full_match(w, '[a-z]{4,15}'))")} where typo is not null",
    "gen_everyday": f"""
with t as (select id, w, typo, {sql_rng('inside', 5)} < 2 as inside, ({EVERYDAY})[{sql_rng('form', len(EVERYDAY))} + 1] as form from {_single('w', "(select distinct w as id, w as q, w from " + SQL_PART + ")")} where typo is not null)
select case when inside then replace(form, '{{w}}', typo) else typo end as input_text, case when inside then replace(form, '{{w}}', w) else w end as target_text, 'everyday_english' as category from t""",
    "gen_phonetic": f"""
with p as (select id, q, list_filter(string_split(q, ' '), lambda x: x <> '') as a from {SQL_PART}),
l as (select id, q, list_reduce(list_prepend('', a), lambda x, y: case when length(y) > length(x) then y else x end) as w from p),
t as (select id, q, w, {_sql('phonetic', 'w')} as t from l)
select array_to_string(list_transform(string_split(q, ' '), lambda x: case when x = w then t else x end), ' ') as input_text, q as target_text, 'phonetic_typo' as category from t where t is not null and t <> w""",
    "gen_quota": f"select case when r < 40 then 'brand' when r < 65 then 'product' when r < 95 then 'query' else 'model' end as kind, count(*) as n from (select {sql_rng('quota', 100)} as r from {SQL_PART}) group by kind",
    "grouped_products": "select coalesce(category, 'other') as category, count(distinct canonical) as n, min(canonical) as first from brand_catalog where canonical is not null group by 1",
    "typo_keyboard_letters": f"select id, {_keys(0)} as typo from {SQL_PART}",
    "typo_keyboard_inner": f"select id, {_keys(1)} as typo from {SQL_PART}",
    "typo_delete_doubled": f"select id, case when length(w) >= 4 then coalesce({_sql('omit', 'w')}, {_sql('delete', 'w')}) end as typo from {SQL_PART}",
    "typo_single_simple": f"select id, coalesce(case when r < 3 then {_keys(0)} when r < 5 then {_sql('swap', 'w')} when r < 7 then {_sql('delete', 'w')} when r < 8 then {_sql('double', 'w')} else {_sql('insert', 'w')} end, {_keys(0)}) as typo from (select *, {sql_rng('e', 9)} as r from {SQL_PART})",
    "gen_identity": "with c as (select distinct lower(string_split(canonical, ' ')[1]) as b, lower(string_split(canonical, ' ')[2]) as p from brand_catalog where len(string_split(canonical, ' ')) >= 2) "
    + " union ".join(f"select {x} as input_text, {x} as target_text, 'identity_query' as category from c" for x in [t.replace("{b}", "' || b || '").replace("{p}", "' || p || '").join("''") for t in TEMPLATES]),
    "gen_oversample": "select category, count(*) * case category when 'price_typo' then 2 when 'unit_typo' then 3 when 'hard_negative' then 5 else 1 end as n from eval_v3 group by category",
    "gen_mismatch": "with p as (select distinct p_name as product from part), c as (select unnest([" + ", ".join(f"{{'w': '{a}', 'r': '{b}', 'm': '{m}'}}" for a, b, m in generate.CONFUSIONS) + "]) as x) "
    "select x.w || ' ' || x.m || ' ' || product as input_text, x.r || ' ' || x.m || ' ' || product as target_text, 'brand_category_mismatch' as category from c, p where length(x.w || ' ' || x.m || ' ' || product) <= 80 "
    "union select x.r || ' ' || x.m || ' ' || product, x.r || ' ' || x.m || ' ' || product, 'brand_category_identity' from c, p where length(x.w || ' ' || x.m || ' ' || product) <= 80",
    "gen_aug": " union all ".join(f"select id, w as word, '{k}' as op, typo from (select id, w, {_sql(k, 'w')} as typo from {SQL_PART}) where typo is not null and typo <> w" for k in ["keyboard", "delete", "swap", "insert", "double", "omit", "phonetic"]),
}
