"""DuckDB statements that give the same rows as the operators' queries, over whole tables."""

from __future__ import annotations

from lexloom.llm import leakage, qdigest, truncation
from lexloom.llm.lookalike import INVISIBLE, JOINED, LOOKALIKE, ODD_SPACE, PHONETIC, composition_table, fullwidth_table


def _class(escaped: str) -> str:
    """A character class of the lookalike module, with its escapes as the characters themselves."""
    return escaped.encode("ascii").decode("unicode_escape")


def mapped(x: str) -> str:
    """`mapped_text` in DuckDB: the same steps in the same order."""
    q = lambda s: s.replace("'", "''")
    x = f"regexp_replace({x}, '[{_class(INVISIBLE)}]', '', 'g')"
    x = f"regexp_replace({x}, '[{_class(ODD_SPACE)}]', ' ', 'g')"
    a, b = fullwidth_table()
    x = f"translate({x}, '{q(a)}', '{q(b)}')"
    for k, v in JOINED.items():
        x = f"replace({x}, '{k}', '{v}')"
    x = f"nfc_normalize(translate({x}, '{''.join(PHONETIC)}', '{''.join(PHONETIC.values())}'))"
    other = r"[\p{Cyrillic}\p{Greek}\p{Armenian}\p{Cherokee}]"
    word = f"case when regexp_matches(w, '\\p{{Latin}}') and regexp_matches(w, '{other}') then translate(w, '{''.join(LOOKALIKE)}', '{''.join(LOOKALIKE.values())}') else w end"
    return f"list_aggregate(list_transform(regexp_extract_all({x}, '[\\p{{L}}\\p{{M}}\\p{{N}}]+|[^\\p{{L}}\\p{{M}}\\p{{N}}]+'), lambda w: {word}), 'string_agg', '')"


def words(x: str) -> str:
    return f"list_filter(regexp_split_to_array(lower(coalesce({mapped(x)}, '')), '[^\\p{{L}}\\p{{M}}\\p{{N}}]+'), lambda w: w <> '')"


P2_FOUND = f"""
with k as (select example_id, array_to_string({words('target_text')}, ' ') as key from eval_v3),
g as (select key, min(example_id) as first_id from k where key <> '' group by key having count(*) > 1)
select k.example_id, g.first_id from k join g using (key)
"""

P2_GROUPS = f"""
with k as (select example_id, array_to_string({words('target_text')}, ' ') as key from eval_v3)
select min(example_id) as first_id, count(*) as rows, count(*) as n_component, 1 as splits from k group by case when key = '' then 'alone ' || example_id else 'key ' || key end
"""

P3_FOUND = """
with size as (select floor(count(*) / 5.0) as s from eval_v3),
have as (select lower(trim(category)) as c, count(*) as n from eval_v3 group by 1)
select lower(trim(p.category)) as category
from category_plan p cross join size left join have h on h.c = lower(trim(p.category))
where coalesce(h.n, 0) < greatest(p.min_rows, p.target_share * size.s)
"""

def _compressed(name: str, nodes: str, k: int) -> str:
    """CTEs ``{name}``: the nodes of ``nodes`` (model, run_id, node, count) compressed, one level of the tree after the other."""
    bits = qdigest.BITS
    level = lambda d: f"node >= {2**d} and node < {2 ** (d + 1)}"
    out = [f"{name}_n as (select model, run_id, sum(count) // {k} as most from {nodes} group by all)", f"{name}_{bits} as (select model, run_id, node, count from {nodes} where {level(bits)})"]
    for d in range(bits, 0, -1):
        out.append(f"{name}_f{d} as (select model, run_id, node // 2 as node, sum(count) as fam from {name}_{d} group by all)")
        out.append(
            f"{name}_u{d} as (select model, run_id, node, coalesce(fam, 0) as fam, coalesce(count, 0) as own, fam is not null and coalesce(fam, 0) + coalesce(count, 0) <= most as merged "
            f"from {name}_f{d} f full join (select * from {nodes} where {level(d - 1)}) o using (model, run_id, node) join {name}_n using (model, run_id))"
        )
        out.append(f"{name}_k{d} as (select c.* from {name}_{d} c join {name}_u{d} u on u.model = c.model and u.run_id = c.run_id and u.node = c.node // 2 where not u.merged)")
        out.append(f"{name}_{d - 1} as (select model, run_id, node, own + case when merged then fam else 0 end as count from {name}_u{d} where own > 0 or merged)")
    kept = " union all ".join([f"select * from {name}_k{d}" for d in range(bits, 0, -1)] + [f"select model, run_id, node, count from {name}_0"])
    return ", ".join([*out, f"{name} as ({kept})"])


def _digests(k: int) -> str:
    return f"""
with v as (select model, coalesce(run_id, '') as run_id, latency_ms as x from results where error = '' and latency_ms is not null and not isnan(latency_ms)),
leaves as (select coalesce(model, '') as model, run_id, {2**qdigest.BITS} + case when x <= {qdigest.LOWEST} then 0
  else least(floor(ln(x / {qdigest.LOWEST}) / ln({qdigest.GAMMA})) + 1, {2**qdigest.BITS - 1}) end::bigint as node, count(*) as count from v group by all),
{_compressed("days", "leaves", k)},
added as (select model, '' as run_id, node, sum(count) as count from days group by all),
{_compressed("whole", "added", k)},
digest as (select model, run_id, node, count, false as merged from days union all select model, run_id, node, count, true from whole)
"""


def digests(k: int = qdigest.COMPRESSION) -> str:
    return _digests(k) + "select nullif(model, '') as model, case when not merged then nullif(run_id, '') end as run_id, node, count::bigint as count from digest"


P5_DIGESTS = digests()

_QUANTILES = _digests(qdigest.COMPRESSION) + f"""
, p as (select *, floor(log2(node))::bigint as depth from digest),
h as (select *, ((node + 1) << ({qdigest.BITS} - depth)) - 1 - {2**qdigest.BITS} as high from p),
c as (select *, sum(count) over (partition by model, run_id, merged order by high, depth desc rows unbounded preceding) as upto, sum(count) over (partition by model, run_id, merged) as n from h),
r as (select model, run_id, merged, n::bigint as n, q, min_by(high, upto) as cell from c, (select unnest([0.5::double, 0.9::double, 0.99::double]) as q) where upto >= greatest(1, ceil(q * n)) group by model, run_id, merged, n, q),
e as (select *, case when cell <= 0 then {qdigest.LOWEST} else {qdigest.LOWEST} * pow({qdigest.GAMMA}, cell - 0.5) end as estimate, (n // {qdigest.COMPRESSION} * {qdigest.BITS})::bigint as rank_error,
  case when cell > 0 and cell < {2**qdigest.BITS - 1} then {qdigest.GAMMA - 1}::double end as value_error from r)
"""

P5_PERCENTILES = _QUANTILES + "select nullif(model, '') as model, case when not merged then nullif(run_id, '') end as run_id, n, q, round(estimate, 6) as estimate, rank_error, round(value_error, 6) as value_error from e"

P5_WITHIN = _QUANTILES + """
, w as (select model, q, n, rank_error, ceil(q * n) as rank, round(estimate * (1 - 1.01 * value_error), 6) as lo, round(estimate * (1 + 1.01 * value_error), 6) as hi from e where merged),
s as (select w.model, q, n, rank_error, rank, count(*) filter (x < lo) as below, count(*) filter (x <= hi) as upto from w join v on coalesce(v.model, '') = w.model group by all)
select nullif(model, '') as model, q, n, rank_error, below, upto, below < rank + rank_error and upto >= rank - rank_error as within from s
"""

_FORM = lambda x: f"trim(regexp_replace({mapped(x)}, ' {{2,}}', ' ', 'g'))"
P6_FORMS = f"""
with t as (select 'correction_requests' as table_name, request_id as row_id, case when query = '' then '' else {_FORM('query')} end as canonical from correction_requests
  union all select 'eval_v3', example_id, case when input_text = '' then '' else {_FORM('input_text')} end from eval_v3)
select table_name, row_id, canonical, case when canonical is not null then count(*) over (partition by canonical) end as class_rows from t
"""

P6_FOUND = f"""
select 'correction_requests' as table_name, request_id as row_id from correction_requests
where query is not null and query <> '' and {mapped('query')} <> query
union all
select 'eval_v3', example_id from eval_v3
where input_text is not null and input_text <> '' and {mapped('input_text')} <> input_text
"""

_P4 = f"""
with r as (select example_id as id, source, lower(trim(split_name)) as split, {words('input_text')} as iw, list_sort({words('target_text')}) as tw from eval_v3
           where lower(trim(split_name)) in ('train', 'validation', 'test')),
s as (select id, split, source, list_sort(case when iw[1] = 'correct' then iw[2:] else iw end) as iw, tw from r),
n as (select id, split, source, list_transform(iw, lambda w, i: w || ' ' || (i - list_position(iw, w))) as iw, list_transform(tw, lambda w, i: w || ' ' || (i - list_position(tw, w))) as tw from s),
m as (select a.id as train_id, b.id as eval_id, greatest(len(a.iw), len(b.iw)) as li, greatest(len(a.tw), len(b.tw)) as lt, len(b.iw) + len(b.tw) as own,
        len(list_intersect(a.iw, b.iw)) as mi, len(list_intersect(a.tw, b.tw)) as mt, least(len(a.iw), len(b.iw), len(a.tw), len(b.tw)) as shortest
      from n a join n b on a.split = 'train' and b.split <> 'train' and abs(len(a.iw) - len(b.iw)) <= 1 and abs(len(a.tw) - len(b.tw)) <= 1),
p as (select *, case when own = 0 then 1.0 else (mi + mt)::double / own end as cover from m where (mi = li and mt = lt) or (shortest >= 5 and li - mi <= 1 and lt - mt <= 1)),
e as (select n.id as example_id, any_value(split) as split, any_value(source) as source, count(train_id) as partners, coalesce(max(cover), 0.0) as cover
      from n left join p on eval_id = n.id where split <> 'train' group by n.id)
"""

P4_FOUND = _P4 + "select least(train_id, eval_id) as example_id_a, greatest(train_id, eval_id) as example_id_b from p"

P4_RECORDS = _P4 + "select example_id, split, source, partners, round(cover, 6) as coverage from e"

P4_COVERAGE = _P4 + """select split, source, count(*) as rows, count(*) filter (partners > 0) as covered, round(avg(cover), 6) as words_covered,
  round(count(*) filter (partners > 0)::double / count(*), 6) as share from e group by split, source"""

P7_FILL = """
with s as (select c.container, c.capacity_tokens as cap, octet_length(encode(text)) + 1 as n from documents, containers c where text is not null)
select container, count(*) as texts, sum(greatest(1, ceil(n / cap)))::bigint as pieces, sum(n)::bigint as tokens, 0 as split_needlessly, 0 as overfull from s group by container
"""

P8_FOUND = f"""
with i as (select item_id, {words('text')} as w from heldout_passages),
iw as (select item_id, unnest(list_transform(range(1, len(w) - 10), lambda p: array_to_string(w[p:p + 11], ' '))) as g from i where len(w) >= 12),
d as (select doc_id, {words('text')} as w from documents),
dw as (select doc_id, unnest(list_transform(range(1, len(w) - 10), lambda p: array_to_string(w[p:p + 11], ' '))) as g from d where len(w) >= 12)
select distinct doc_id, item_id from dw join iw using (g)
"""

P9_LIMITS = f"""
with t as (select coalesce(source, '') as source, regexp_replace(text, '(?:\\s|{truncation.SIGNS})+\\z', '') as bare, regexp_replace(text, '(?:\\n|{truncation.SIGNS})+\\z', '') as unmarked from documents where text is not null),
u as (select source, 'chars' as unit, length(unmarked) as length from t where bare <> '' union all select source, 'bytes', octet_length(encode(unmarked)) from t where bare <> ''),
n as (select source, unit, length, count(*) as n from u group by all),
r as (select *, sum(n) over (partition by source, unit order by length rows between current row and unbounded following) as at_risk from n),
w as (select *, n::double / at_risk as hazard,
  least(1.0, greatest({', '.join(f"(sum(n) over (partition by source, unit order by length range between {k} preceding and {k} following) - n + 1.0) / ({2 * k}.0 * avg(at_risk) over (partition by source, unit order by length range between {k} preceding and {k} following))" for k in truncation.NEIGHBOURS)})) as beside from r),
p as (select *, case when hazard > beside then exp(-(n * ln(n / (beside * at_risk)) - n + beside * at_risk)) else 1.0 end as p from w),
k as (select *, case when p <= row_number() over (partition by source, unit order by p, length) * {truncation.FALSE_DISCOVERY} / count(*) over (partition by source, unit) then p end as passed from p),
s as (select *, max(passed) over (partition by source, unit) as most from k)
select source, unit, length, n, at_risk, round(hazard, 6) as hazard, round(1 - beside / hazard, 6) as surplus from s where p <= most and hazard >= {truncation.LEAST_RATIO} * beside
"""

_UNITS = ", ".join(f"'{u}'" for u in leakage.UNITS)
P8_REWORDED = f"""
with t as (select 0 as side, item_id as id, {words('text')} as w from heldout_passages union all select 1, doc_id, {words('text')} from documents),
f as (select w from (select id, unnest(list_distinct(w)) as w from t where side = 0) group by w having count(*) >= greatest(2, ceil({leakage.NAME_SHARE} * (select count(*) from heldout_passages)))),
u as (select side, id, unnest(w) as w, generate_subscripts(w, 1) as p from t where len(w) >= {leakage.WINDOW}),
l as (select side, id, list(u.w order by p) as w, list(case when regexp_matches(u.w, '^[0-9]+$') then '<num>' when u.w in ({_UNITS}) then '<unit>' when f.w is not null then u.w else '<name>' end order by p) as t
      from u left join f on f.w = u.w group by side, id),
s as (select side, id, w, t, unnest(range(1, len(w) - {leakage.WINDOW - 2})) as p from l),
n as (select side, id, w[p:p + {leakage.WINDOW - 1}] as w, t[p:p + {leakage.WINDOW - 1}] as t from s),
k as (select side, id, w, case when len(list_filter(t, lambda x: x[1] = '<')) > {leakage.WINDOW - leakage.LEAST_FIXED} then 'own ' || array_to_string(w, ' ') else array_to_string(t, ' ') end as k from n),
h as (select d.id as doc_id, i.id as item_id, d.w as x, i.w as y, list_distinct(list_transform(range(1, {leakage.WINDOW + 1}), lambda j: d.w[j] || '>' || i.w[j])) as z from k d join k i on d.side = 1 and i.side = 0 and d.k = i.k)
select doc_id, item_id, count(*) as windows from h where len(z) = len(list_distinct(x)) and len(z) = len(list_distinct(y))
group by doc_id, item_id having not bool_or(x = y)
"""
