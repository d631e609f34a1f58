"""DuckDB SQL with the results of the catalogue's queries."""

from __future__ import annotations

from weftlink.functions.keys import ADDRESS_STOP, HONORIFICS, LEGAL_WORDS, NAME_STOP
from weftlink.functions.text import LEGAL_FORMS, NAME_DOMAINS, STATE_CODES, STREET_WORDS

_WORD = r"[^\p{L}\p{N}_]"


def _listed(values) -> str:
    return ", ".join(f"'{v}'" for v in values)


def _case(x: str, table: dict[str, str]) -> str:
    return f"case {x} " + " ".join(f"when '{k}' then '{v}'" for k, v in table.items()) + f" else {x} end"


def _split(x: str) -> str:
    return rf"list_filter(regexp_split_to_array({x}, '\s+'), lambda t: t <> '')"


def _strip(x: str) -> str:
    return rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


def _address(x: str) -> str:
    """The address's words in canonical spelling."""
    return f"list_transform({_split(rf"lower(regexp_replace({x}, '[^\p{{L}}\p{{N}}\s]', ' ', 'g'))")}, lambda t: {_case('t', STREET_WORDS)})"


def _text(x: str) -> str:
    return f"array_to_string({_address(x)}, ' ')"


_DOMAINS = "|".join(d.replace(".", r"\.") for d in NAME_DOMAINS)
_NAME = rf"regexp_replace({_strip("coalesce(business_name, '')")}, '[\x{{00a0}}\x{{200b}}\x{{feff}}]', ' ', 'g')"
_NAME = rf"regexp_replace({_NAME}, '^[\s\-<>=*|#_~]+|[\s\-<>=*|#_~]+$', ' ', 'g')"
_NAME = rf"regexp_replace({_NAME}, 'https?://\S+|www\.\S+', ' ', 'gi')"
_NAME = rf"regexp_replace({_NAME}, '\.({_DOMAINS})({_WORD}|$)', ' \2', 'gi')"
_NAME = f"lower(regexp_replace({_NAME}, '[&+]', ' and ', 'g'))"
_NAME = rf"regexp_replace({_NAME}, '[^\p{{L}}\p{{N}}\p{{M}}\s]', ' ', 'g')"
_NAME = f"array_to_string(list_transform({_split(_NAME)}, lambda t: {_case('t', LEGAL_FORMS)}), ' ')"
_LANDMARK = rf"(^|{_WORD})((near|opp(osite)?|behind|beside|next\s+to|in\s+front\s+of|close\s+to)\s+[^,]+)"
_POSTAL = rf"(^|{_WORD})([1-9][0-9]{{5}}|[0-9]{{5}}(-[0-9]{{4}})?)({_WORD}|$)"
_STATES = _listed(STATE_CODES)

RAW = """
raw_e as (
  select concat('S', 1 + doc_id % 3, '-', doc_id) as entity_id, 1 + doc_id % 3 as source_no, doc_id as pos,
         substr(split_part(text, chr(10), 1), 1, 60) as business_name,
         substr(replace(text, chr(10), ', '), 61, 80) as business_address, lang as country
  from documents
)"""
ENTITIES = RAW + rf""", seg_e as (
  select *, {_strip("coalesce(business_address, '')")} as raw_a from raw_e
), cut_e as (
  select *, list_filter(list_transform(string_split(raw_a, ','), lambda x: {_strip("x")}), lambda x: x <> '') as seg from seg_e
), how_e as (
  select *, len(seg) as n_seg, lower(seg[-1]) as last_s, lower(seg[-2]) as second_last, ({_split("lower(seg[-1])")})[1] as code from cut_e
), pick_e as (
  select *,
    case when n_seg < 2 then null when code in ({_STATES}) then code when lower(seg[1]) in ({_STATES}) then lower(seg[1]) else last_s end as state_s,
    case when n_seg < 2 then null when code in ({_STATES}) then second_last when lower(seg[1]) in ({_STATES}) then lower(seg[2]) else second_last end as city_s,
    case when n_seg = 1 then seg[1] when n_seg < 1 then null
         when code not in ({_STATES}) and lower(seg[1]) in ({_STATES}) then case when n_seg > 2 then array_to_string(seg[3:], ', ') end
         when n_seg > 2 then array_to_string(seg[:n_seg - 2], ', ') else seg[1] end as street_s
  from how_e
), ent as (
  select entity_id, source_no, pos, {_NAME} as name_norm, lower({_strip("coalesce(country, '')")}) as country_norm,
    {_text("raw_a")} as clean_address, coalesce({_text("street_s")}, '') as street, nullif({_text("city_s")}, '') as city,
    nullif({_text("state_s")}, '') as state, nullif(regexp_extract(raw_a, '{_POSTAL}', 2), '') as postal_code,
    lower({_strip(f"coalesce(nullif(regexp_extract(raw_a, '{_LANDMARK}', 2, 'i'), ''), nullif(regexp_extract(raw_a, '([^,]+?\\s+(ke\\s+pas|ke\\s+samne|ke\\s+piche|ke\\s+najdeek))({_WORD}|$)', 1, 'i'), ''))")}) as raw_landmark
  from pick_e
)"""


def _key(kind: str, *values: str) -> str:
    return f"concat_ws(':', '{kind}', land, {', '.join(values)})"


def _one(test: str, key: str) -> str:
    return f"case when {test} then [{key}] else [] end"


def _words(x: str) -> str:
    return f"list_transform(list_filter({_split(x)}, lambda t: length(t) >= 3 and t not in ({_listed(NAME_STOP)}))[:4], lambda t: {_key('tok', 't')})"


_KEYS = [_one(f"length({c}) >= {n}", _key(f"cn_p{n}", f"substr({c}, 1, {n})")) for c in ("short", "whole") for n in (3, 4)]
_KEYS += [_words("name_norm"), _words("core")]
_KEYS += [
    rf"list_transform(list_filter({_split('clean_address')}, lambda t: length(t) >= 4 and not regexp_matches(t, '^\p{{Nd}}+$') and t not in ({_listed(ADDRESS_STOP)}))[:4], lambda t: {_key('addr_tok', 't')})",
    _one("length(post) >= 3 and post <> 'None' and length(short) >= 2", _key("post_p2", "post", "substr(short, 1, 2)")),
    _one("length(town) >= 3 and town <> 'None' and length(short) >= 2", _key("city_p2", "town", "substr(short, 1, 2)")),
    rf"case when length(town) >= 3 and town <> 'None' then list_transform(list_filter({_split('clean_address')}, lambda t: regexp_matches(t, '^\p{{Nd}}+$') and length(t) between 2 and 4)[:2], lambda t: {_key('city_num', 'town', 't')}) else [] end",
]
_OPENING = "|".join(HONORIFICS)
_LEGAL = "|".join(LEGAL_WORDS)
KEYED = ENTITIES + rf""", pre_k as (
  select *, coalesce(nullif(trim(country_norm), ''), 'unknown') as land, coalesce(postal_code, '') as post, coalesce(city, '') as town,
    regexp_replace(regexp_replace(name_norm, '^({_OPENING})', ''), '[^a-z0-9]', '', 'g') as short,
    regexp_replace(name_norm, '[^a-z0-9]', '', 'g') as whole,
    trim(regexp_replace(' ' || replace(name_norm, ' ', '  ') || ' ', ' ({_LEGAL.replace(" ", "  ")}) ', ' ', 'g')) as core
  from ent
), keyed as (
  select entity_id, source_no, pos, land, unnest(list_distinct(list_concat({", ".join(_KEYS)}))) as key from pre_k
)"""


CAPS = {"first": (300, 100), "skip": (1000, 0), "truncate": (1000, 1000)}


def _capped(mode: str = "first") -> str:
    cap, keep = CAPS[mode]
    return KEYED + f""", ranked_k as (
  select *, row_number() over (partition by key order by source_no, pos) as rn, count(*) over (partition by key) as df from keyed where source_no <> 1
), met as (
  select distinct a.entity_id as s1_entity_id, t.entity_id as target_entity_id, t.source_no as source_id, t.pos
  from keyed a join ranked_k t using (key) where a.source_no = 1 and (t.df <= {cap} or t.rn <= {keep})
)"""


LINKS = """, links as (
  select a.entity_id as s1_entity_id, t.entity_id as target_entity_id
  from raw_e a join raw_e t on a.business_name = t.business_name and a.source_no = 1 and t.source_no <> 1 and a.business_name <> ''
)"""


def _jaccard(a: str, b: str) -> str:
    return f"case when len({a}) > 0 and len({b}) > 0 then len(list_intersect({a}, {b}))::double / len(list_distinct(list_concat({a}, {b}))) else 0.0 end"


SCORED = _capped() + LINKS + f""", scored as (
  select m.*, round(100 * ({_jaccard(_split("a.name_norm"), _split("t.name_norm"))}), 6) as blocking_score
  from met m join ent a on a.entity_id = m.s1_entity_id join ent t on t.entity_id = m.target_entity_id
)"""


def _ranked(k: int, least: float) -> str:
    return SCORED + f""", best as (
  select * from (
    select *, row_number() over (partition by s1_entity_id order by blocking_score desc, source_id, pos, target_entity_id)::int as rank
    from scored where blocking_score >= {least}
  ) where rank <= {k}
)"""


def _lcs(asked: str, name: str) -> str:
    """CTEs up to ``name`` (a, b, n): common lengths of the strings (a, b) of ``asked``, a of 126 letters at most, by bit vectors."""
    every = "((1::uhugeint << length(a)::uhugeint) - 1::uhugeint)"
    return f""", {name}_k as (
  select a, map_from_entries(list({{'k': c, 'v': m}})) as masks from (
    select a, c, bit_or(1::uhugeint << (i - 1)::uhugeint) as m
    from (select a, unnest(string_split(a, '')) as c, generate_subscripts(string_split(a, ''), 1) as i from (select distinct a from {asked})) group by a, c
  ) group by a
), {name} as (
  select a, b, length(a) - bit_count((list_reduce(list_transform(string_split(b, ''), lambda c: coalesce(masks[c], 0::uhugeint)),
    lambda s, m: ((s + (s & m)) | (s - (s & m))) & {every}, {every}))::hugeint) as n
  from (select distinct a, b from {asked}) join {name}_k using (a)
)"""


def _joined_lcs(x: str, y: str, alias: str) -> str:
    return f"left join lcs {alias} on {alias}.a = case when length({x}) <= length({y}) then {x} else {y} end and {alias}.b = case when length({x}) <= length({y}) then {y} else {x} end"


def _ratio(x: str, y: str, alias: str) -> str:
    return f"case when length({x}) + length({y}) = 0 then 100::double else 200::double * coalesce({alias}.n, 0) / (length({x}) + length({y})) end"


def _measures(pairs: str) -> str:
    """CTEs up to ``names``, ``addresses`` and ``cities``: (x, y, r, ts, tset) of the texts of ``pairs`` (s1_entity_id, target_entity_id)."""
    out = f""", txt as (
  select m.s1_entity_id, m.target_entity_id, a.name_norm as an, t.name_norm as tn, a.clean_address as aa, t.clean_address as ta, coalesce(a.city, '') as ac, coalesce(t.city, '') as tc
  from {pairs} m join ent a on a.entity_id = m.s1_entity_id join ent t on t.entity_id = m.target_entity_id
)"""
    kinds = {"names": ("an", "tn"), "addresses": ("aa", "ta"), "cities": ("ac", "tc")}
    for k, (x, y) in kinds.items():
        out += f""", {k}_w as (
  select x, y, {_split("x")} as wx, {_split("y")} as wy from (select distinct {x} as x, {y} as y from txt)
), {k}_t as (
  select x, y, array_to_string(list_sort(wx), ' ') as sx, array_to_string(list_sort(wy), ' ') as sy, len(list_distinct(wx)) as nx, len(list_distinct(wy)) as ny,
    list_sort(list_intersect(wx, wy)) as sh, array_to_string(list_sort(list_distinct(list_filter(wx, lambda w: not list_contains(wy, w)))), ' ') as own,
    array_to_string(list_sort(list_distinct(list_filter(wy, lambda w: not list_contains(wx, w)))), ' ') as other
  from {k}_w
)"""
    sides = " union all ".join(f"select {p} as x, {q} as y from {k}_t" for k in kinds for p, q in (("x", "y"), ("sx", "sy"), ("own", "other")))
    out += f""", asked as (
  select distinct case when length(x) <= length(y) then x else y end as a, case when length(x) <= length(y) then y else x end as b from ({sides}) where x <> '' and y <> ''
)""" + _lcs("asked", "lcs")
    for k in kinds:
        out += f""", {k}_n as (
  select t.*, {_ratio("t.x", "t.y", "l1")} as r, {_ratio("sx", "sy", "l2")} as ts, coalesce(l3.n, 0) as common, length(array_to_string(sh, ' ')) as base, length(own) as n_own, length(other) as n_other
  from {k}_t t {_joined_lcs("t.x", "t.y", "l1")} {_joined_lcs("sx", "sy", "l2")} {_joined_lcs("own", "other", "l3")}
), {k}_g as (
  select *, case when base > 0 then 1 else 0 end as gap from {k}_n
), {k} as (
  select x, y, r, ts, case when nx = 0 or ny = 0 then 0::double when base > 0 and (len(sh) = nx or len(sh) = ny) then 100::double
    when base = 0 then 100::double - 100::double * (n_own + n_other - 2 * common) / (n_own + n_other)
    else greatest(100::double - 100::double * (n_own + n_other - 2 * common) / (2 * base + 2 * gap + n_own + n_other),
      100::double - 100::double * (gap + n_own) / (2 * base + gap + n_own), 100::double - 100::double * (gap + n_other) / (2 * base + gap + n_other)) end as tset
  from {k}_g
)"""
    return out


def _partial(pairs: str) -> str:
    """CTEs up to ``parts`` (x, y, best): the best window of the names (an, tn) of ``pairs``."""
    return f""", part_p as (
  select distinct an as x, tn as y from {pairs}
), part_s as (
  select x, y, x as s, y as l from part_p where length(x) <= length(y) and x <> '' union all select x, y, y, x from part_p where length(y) <= length(x) and y <> ''
), part_w as (
  select x, y, s as a, substr(l, greatest(0, e - length(s)) + 1, least(e, length(l)) - greatest(0, e - length(s))) as b
  from (select *, unnest(range(1, length(l) + length(s))) as e from part_s)
)""" + _lcs("part_w", "part_l") + """, parts as (
  select p.x, p.y, case when p.x = '' and p.y = '' then 100::double else coalesce(max(200::double * l.n / (length(w.a) + length(w.b))), 0) end as best
  from part_p p left join part_w w on w.x = p.x and w.y = p.y left join part_l l on l.a = w.a and l.b = w.b group by p.x, p.y
)"""


_LACKS = "(aa = '' or ta = '')"
_ADDRESS = f"(case when {_LACKS} then 0::double else a.tset end)"
_FULL = "greatest(n.r, n.ts, 0.92::double * n.tset)"
_STANDARD = f"""case when an = '' or tn = '' then 0::double when {_LACKS} then {_FULL} when {_FULL} >= 80 then 0.85::double * {_FULL} + 0.15::double * {_ADDRESS}
    when {_FULL} < 30 and {_ADDRESS} > 50 then {_ADDRESS} else 0.60::double * {_FULL} + 0.40::double * {_ADDRESS} end"""
MEASURED = _capped() + LINKS + _measures("met") + f""", scored as (
  select m.*, an, tn, n.r as name_r, n.ts as name_ts, n.tset as name_set, a.r as address_r, a.tset as address_set, c.r as city_r, {_STANDARD} as blocking_score
  from met m join txt using (s1_entity_id, target_entity_id) join names n on n.x = an and n.y = tn join addresses a on a.x = aa and a.y = ta join cities c on c.x = ac and c.y = tc
)"""


def _top(k: int, least: float) -> str:
    return MEASURED + f""", best as (
  select * from (
    select *, row_number() over (partition by s1_entity_id order by blocking_score desc, source_id, pos, target_entity_id)::int as rank from scored where blocking_score >= {least}
  ) where rank <= {k}
)"""


LISTS = """lists as (
  select 'S1-' || o_custkey as source1_entity_id,
    coalesce(string_agg(case when o_orderstatus = 'F' then 'S2-' || o_orderkey end, ',' order by o_orderkey), '') as truth,
    coalesce(string_agg(case when o_totalprice > 150000 then 'S2-' || o_orderkey end, ',' order by o_orderkey), '') as pred
  from orders group by o_custkey
)"""
SETS = LISTS + """, sets as (
  select source1_entity_id as id, case when truth = '' then []::varchar[] else string_split(truth, ',') end as t,
         case when pred = '' then []::varchar[] else string_split(pred, ',') end as p from lists
), hit as (
  select *, len(list_intersect(t, p)) as tp from sets
), ent_f as (
  select *, case when len(t) = 0 and len(p) = 0 then 1.0 when len(t) = 0 or len(p) = 0 or tp = 0 then 0.0
            else 1.25 * tp / (0.25 * len(t) + len(p)) end::double as f05 from hit
)"""
COUNTS = LISTS + """, counts as (
  select source1_entity_id, truth as matched_entity_ids, (case when truth = '' then 0 else len(string_split(truth, ',')) end)::int as match_count from lists
)"""
FAULTY = LISTS + """, base as (
  select source1_entity_id as id, case when pred = '' then []::varchar[] else string_split(pred, ',') end as ids,
         case when truth = '' then [''] else string_split(truth, ',') end as cand, substr(source1_entity_id, 4)::bigint as n from lists
), bad as (
  select id, n, case when n % 7 = 0 then list_concat(ids, ids[1:1]) when n % 11 = 0 then list_concat(ids, ['X-1'])
                     when n % 13 = 0 then list_concat(ids, [id]) else ids end as ids from base
), subm as (
  select id, ids from (select * from bad union all select * from bad where n % 17 = 0) where n % 19 <> 0
)"""


def _with(ctes: str, select: str) -> str:
    """Further CTEs may open ``select``."""
    return f"with {ctes.strip()}{'' if select.startswith(',') else chr(10)}{select}"


def _feature_sql(edits: bool = False) -> str:
    """The features of all joined pairs, or with those from edit distances of the best ones."""
    a, b = _split("a.name_norm"), _split("t.name_norm")
    ca, cb = _split("a.clean_address"), _split("t.clean_address")
    da, db = (rf"list_distinct(regexp_extract_all({x}.clean_address, '(\p{{Nd}}+)', 1))" for x in "at")
    both_n, both_a = "(a.name_norm <> '' and t.name_norm <> '')", "(a.clean_address <> '' and t.clean_address <> '')"
    flag = lambda x: f"case when {x} then 1.0 else 0.0 end::double"
    names = f"case when {both_n} then %s else 0.0 end::double"
    same = {k: f"(coalesce(a.{c}, '') <> '' and coalesce(a.{c}, '') = coalesce(t.{c}, ''))" for k, c in (("name", "name_norm"), ("city", "city"), ("postal", "postal_code"))}
    both = {k: f"(coalesce(a.{c}, '') <> '' and coalesce(t.{c}, '') <> '')" for k, c in (("city", "city"), ("postal", "postal_code"))}
    digits = f"case when not {both_a} or (len({da}) = 0 and len({db}) = 0) then 0.5 when len({da}) = 0 or len({db}) = 0 then 0.0 else %s end::double"
    land = "case when a.country_norm <> '' then a.country_norm else t.country_norm end"
    cols = {
        "name_len_diff": f"case when {both_n} then abs(length(a.name_norm) - length(t.name_norm)) else greatest(length(a.name_norm), length(t.name_norm)) end::double",
        "name_len_ratio": names % "round(least(length(a.name_norm), length(t.name_norm)) / greatest(length(a.name_norm), length(t.name_norm), 1)::double, 5)",
        "name_exact_match": flag(same["name"]),
        "name_prefix_match": names % flag("starts_with(a.name_norm, t.name_norm) or starts_with(t.name_norm, a.name_norm)"),
        "name_jaccard": names % f"round({_jaccard(a, b)}, 5)",
        "addr_s1_missing": flag("a.clean_address = ''"),
        "addr_t_missing": flag("t.clean_address = ''"),
        "addr_both_present": flag(both_a),
        "addr_jaccard": f"case when {both_a} then round({_jaccard(ca, cb)}, 5) else 0.0 end::double",
        "addr_digits_match": digits % flag(f"list_sort({da}) = list_sort({db})"),
        "addr_digits_jaccard": digits % f"round({_jaccard(da, db)}, 5)",
        "city_both_present": flag(both["city"]),
        "city_exact_match": flag(same["city"]),
        "postal_both_present": flag(both["postal"]),
        "postal_exact_match": flag(same["postal"]),
        "postal_p2_match": flag("length(coalesce(a.postal_code, '')) >= 2 and length(coalesce(t.postal_code, '')) >= 2 and substr(a.postal_code, 1, 2) = substr(t.postal_code, 1, 2)"),
        "is_source3": flag("m.source_id = 3"),
        "country_is_us": flag(f"{land} in ('us', 'usa', 'united states')"),
        "country_is_in": flag(f"{land} in ('india', 'in', 'ind')"),
        "country_is_fr": flag(f"{land} in ('france', 'fr', 'fra')"),
        "exact_name_and_city": flag(f"{same['name']} and {same['city']}"),
        "exact_name_and_postal": flag(f"{same['name']} and {same['postal']}"),
    }
    if edits:
        flagged = lambda x: f"round((case when {x} end)::float::double, 5)"
        set_n, set_a = f"(case when {both_n} then m.name_set / 100 else 0 end)", f"(case when {both_a} then m.address_set / 100 else 0 end)"
        cols |= {
            "name_ratio": flagged(f"{both_n} then m.name_r / 100 else 0"),
            "name_partial_ratio": flagged(f"{both_n} then p.best / 100 else 0"),
            "name_token_sort_ratio": flagged(f"{both_n} then m.name_ts / 100 else 0"),
            "name_token_set_ratio": flagged(f"{both_n} then m.name_set / 100 else 0"),
            "addr_ratio": flagged(f"{both_a} then m.address_r / 100 else 0"),
            "addr_token_set_ratio": flagged(f"{both_a} then m.address_set / 100 else 0"),
            "city_ratio": flagged(f"{both['city']} then m.city_r / 100 else 0"),
            "blocking_score": flagged("m.blocking_score > 1 then m.blocking_score / 100 else m.blocking_score"),
            "name_x_addr": flagged(f"{both_a} then {set_n} * {set_a} else {set_n} * 0.5"),
        }
        made = ",\n  ".join(f"{v} as {k}" for k, v in cols.items())
        rest = "from best m join ent a on a.entity_id = m.s1_entity_id join ent t on t.entity_id = m.target_entity_id join parts p on p.x = a.name_norm and p.y = t.name_norm"
        return _with(_top(15, 35) + _partial("best"), f"select m.s1_entity_id, m.target_entity_id, m.source_id,\n  {made}\n{rest}")
    picked = ",\n  ".join(f"{v} as {k}" for k, v in cols.items())
    return _with(_capped(), f"select m.s1_entity_id, m.target_entity_id,\n  {picked}\nfrom met m join ent a on a.entity_id = m.s1_entity_id join ent t on t.entity_id = m.target_entity_id")


def queries() -> dict[str, str]:
    out = {
        "f05_entity": _with(SETS, "select id, len(t)::int as n_truth, len(p)::int as n_found, round(f05, 6) as f05 from ent_f"),
        "f05_macro": _with(SETS, "select round(coalesce(avg(f05), 0), 6) as macro_f05 from ent_f"),
        "f05_macro_report": _with(
            SETS,
            """select round(avg(f05), 6) as macro_f05, count(*) as total_entities, count(*) filter (len(t) = 0) as singleton_count,
  count(*) filter (len(t) > 0) as non_singleton_count, round(coalesce(avg(f05) filter (len(t) = 0), 0), 6) as singleton_f05,
  round(coalesce(avg(f05) filter (len(t) > 0), 0), 6) as non_singleton_f05, sum(tp)::bigint as total_tp, sum(len(p) - tp)::bigint as total_fp,
  sum(len(t) - tp)::bigint as total_fn, round(sum(tp)::double / sum(len(p)), 6) as micro_precision, round(sum(tp)::double / sum(len(t)), 6) as micro_recall from ent_f""",
        ),
        "normalized_truth": _with(COUNTS, "select *, match_count = 0 as is_singleton from counts"),
        "match_topology": _with(
            COUNTS,
            """select count(*) as n_anchors, round(100.0 * count(*) filter (match_count = 0) / count(*), 6) as singleton_pct, min(match_count) as min_matches,
  max(match_count) as max_matches, round(avg(match_count), 6) as mean_matches, round(quantile_cont(match_count, 0.5), 6) as median_matches,
  round(quantile_cont(match_count, 0.95), 6) as p95_matches from counts""",
        ),
        "match_histogram": _with(COUNTS, "select match_count, count(*) as n, round(100.0 * count(*) / sum(count(*)) over (), 2)::double as pct from counts group by match_count"),
        "links_by_source": _with(RAW + LINKS, "select substr(target_entity_id, 2, 1)::int as source_id, count(*) as n_links, round(100.0 * count(*) / sum(count(*)) over (), 4)::double as pct from links group by 1"),
        "country_counts": _with(RAW, "select country, count(*) as n from raw_e group by country"),
        "empty_cells": _with(RAW, "select count(*) as n_rows, " + ", ".join(f"count(*) filter (coalesce({c}, '') = '') as {c}_empty" for c in ("business_name", "business_address", "country")) + " from raw_e"),
        "prefix_integrity": _with(RAW, "select bool_and(starts_with(entity_id, 'S1-')) as all_match, count(*) filter (not starts_with(entity_id, 'S1-')) as n_other from raw_e"),
        "normalize_name": _with(ENTITIES, "select entity_id, name_norm from ent"),
        "normalize_country": _with(ENTITIES, "select entity_id, country_norm from ent"),
        "normalize_address": _with(ENTITIES, "select entity_id, clean_address, street, city, state, postal_code, raw_landmark from ent"),
        "blocking_keys": _with(KEYED, "select entity_id, key from keyed"),
        "block_sizes": _with(KEYED, "select count(*) as n_keys, min(n) as min_size, max(n) as max_size, round(avg(n), 6) as avg_size from (select key, count(*) as n from keyed where source_no <> 1 group by key)"),
        "index_stats": _with(KEYED, "select land as country, count(distinct entity_id) as n_targets, count(distinct key) as n_keys from keyed where source_no <> 1 group by land"),
        "top_keys": _with(KEYED, "select key, count(*) as n from keyed where source_no <> 1 group by key order by n desc, key limit 10"),
        **{f"block_join_{n}": _with(_capped(m), "select s1_entity_id, target_entity_id from met") for n, m in (("capped", "first"), ("skip", "skip"), ("truncate", "truncate"))},
        "top_k_jaccard": _with(_ranked(5, 10), "select s1_entity_id, target_entity_id, blocking_score, rank from best"),
        "true_links": _with(RAW + LINKS, "select * from links"),
        "recall_at_k": _with(
            _top(30, 35),
            """select k, count(*) as n_true, count(*) filter (rank <= k) as n_covered, round(count(*) filter (rank <= k) / count(*)::double, 6) as recall
from (select distinct * from links) l left join best b using (s1_entity_id, target_entity_id), (values (5), (10), (15), (20), (25), (30)) ks(k) group by k""",
        ),
        "raw_coverage": _with(_capped() + LINKS, "select count(*) as n_true, count(m.source_id) as n_covered, round(count(m.source_id) / count(*)::double, 6) as recall from (select distinct * from links) l left join met m using (s1_entity_id, target_entity_id)"),
        "missed_at_k": _with(_top(30, 35), "select s1_entity_id, target_entity_id, coalesce(rank - 1, -1)::int as rank from (select distinct * from links) l left join best b using (s1_entity_id, target_entity_id) where coalesce(rank > 5, true)"),
        "candidate_count_stats": _with(
            _capped(),
            """, per as (select e.entity_id, count(m.s1_entity_id) as n from raw_e e left join met m on m.s1_entity_id = e.entity_id where e.source_no = 1 group by 1)
select round(avg(n), 6) as avg_candidates, (list_sort(list(n)))[len(list(n)) // 2 + 1] as median_candidates, max(n) as max_candidates from per""",
        ),
        "agreement_stats": _with(
            ENTITIES + LINKS,
            f"""select count(*) as n_pairs, count(*) filter (a.country_norm = t.country_norm) as same_country, count(*) filter (a.name_norm <> '' and a.name_norm = t.name_norm) as same_name,
  count(*) filter (a.name_norm <> '' and substr(a.name_norm, 1, 3) = substr(t.name_norm, 1, 3)) as same_prefix3, count(*) filter (a.name_norm <> '' and substr(a.name_norm, 1, 4) = substr(t.name_norm, 1, 4)) as same_prefix4,
  count(*) filter (a.name_norm <> '' and split_part(a.name_norm, ' ', 1) = split_part(t.name_norm, ' ', 1)) as same_first_token,
  count(*) filter (len(list_intersect({_split("a.name_norm")}, {_split("t.name_norm")})) > 0) as shared_token,
  count(*) filter (a.postal_code = t.postal_code) as same_postal, count(*) filter (a.city = t.city) as same_city
from links l join ent a on a.entity_id = l.s1_entity_id join ent t on t.entity_id = l.target_entity_id""",
        ),
        "key_recall": _with(
            KEYED + LINKS,
            """, gathered as (select entity_id, list(key) as ks from keyed group by 1)
select count(*) as n_true, count(*) filter (len(list_intersect(a.ks, t.ks)) > 0) as n_covered, round(count(*) filter (len(list_intersect(a.ks, t.ks)) > 0) / count(*)::double, 6) as recall
from links l left join gathered a on a.entity_id = l.s1_entity_id left join gathered t on t.entity_id = l.target_entity_id""",
        ),
        "label_join": _with(_capped() + LINKS, "select m.s1_entity_id, m.target_entity_id, case when l.s1_entity_id is null then 0 else 1 end as label from met m left join links l using (s1_entity_id, target_entity_id)"),
        "class_weight": _with(
            _capped() + LINKS,
            """, lab as (select case when l.s1_entity_id is null then 0 else 1 end as label from met m left join links l using (s1_entity_id, target_entity_id))
select count(*) as n_pairs, sum(label)::bigint as n_positive, round(greatest(1.0, (count(*) - sum(label)) / greatest(1, 4 * sum(label))::double), 6) as pos_weight from lab""",
        ),
        "threshold_sweep": _with(
            MEASURED,
            """, th as (select (40 + 5 * i)::double / 100 as threshold from range(11) r(i)), n_t as (
  select e.entity_id as id, count(l.s1_entity_id) as n_truth from raw_e e left join links l on l.s1_entity_id = e.entity_id where e.source_no = 1 group by 1
), p as (
  select s.s1_entity_id as id, s.blocking_score / 100 as prob, case when l.s1_entity_id is null then 0 else 1 end as label from scored s left join links l using (s1_entity_id, target_entity_id)
), g as (
  select th.threshold, n_t.id, n_truth, count(p.id) as n, coalesce(sum(label), 0) as hits from n_t cross join th left join p on p.id = n_t.id and p.prob >= th.threshold group by all
)
select threshold, round(avg(case when n_truth = 0 and n = 0 then 1.0 when n_truth = 0 or n = 0 then 0.0 else 1.25 * hits / (0.25 * n_truth + n) end::double), 6) as macro_f05,
  round(avg(case when n_truth = 0 and n = 0 then 1.0 when n_truth = 0 or n = 0 then 0.0 else 1.25 * least(n, n_truth) / (0.25 * n_truth + n) end::double), 6) as assumed_f05 from g group by threshold""",
        ),
        "simple_features": _feature_sql(),
        "digit_jaccard": _with(
            _capped(),
            rf""", d as (
  select s1_entity_id, target_entity_id, list_distinct(regexp_extract_all(a.clean_address, '(\p{{Nd}}+)', 1)) as x, list_distinct(regexp_extract_all(t.clean_address, '(\p{{Nd}}+)', 1)) as y
  from met m join ent a on a.entity_id = m.s1_entity_id join ent t on t.entity_id = m.target_entity_id
)
select s1_entity_id, target_entity_id, len(x)::int as n_a, len(y)::int as n_b, round({_jaccard("x", "y")}, 6)::double as digits_jaccard from d""",
        ),
        "top_k_candidates": _with(
            _top(15, 35),
            """select s1_entity_id, target_entity_id, source_id, round(blocking_score, 6) as blocking_score, rank,
  a.name_norm as s1_name, a.clean_address as s1_address, coalesce(a.city, '') as s1_city, coalesce(a.postal_code, '') as s1_postal, a.country_norm as s1_country,
  t.name_norm as target_name, t.clean_address as target_address, coalesce(t.city, '') as target_city, coalesce(t.postal_code, '') as target_postal, t.country_norm as target_country
from best b join ent a on a.entity_id = b.s1_entity_id join ent t on t.entity_id = b.target_entity_id""",
        ),
        "scored_pairs": _with(MEASURED, "select s1_entity_id, target_entity_id, source_id, round(blocking_score, 6) as blocking_score from scored"),
        "features_31": _feature_sql(edits=True),
        "flagship": _with(
            _top(15, 35),
            """select e.entity_id as source1_entity_id, coalesce(string_agg(target_entity_id, ',' order by rank) filter (blocking_score >= 70), '') as matched_entity_ids,
  coalesce(string_agg(target_entity_id, ',' order by rank), '') as candidate_entity_ids
from raw_e e left join best b on b.s1_entity_id = e.entity_id where e.source_no = 1 group by e.entity_id""",
        ),
        "pair_similarities": _with(
            _capped() + LINKS + ", either as (select s1_entity_id, target_entity_id from met union select s1_entity_id, target_entity_id from links)" + _measures("either") + _partial("txt"),
            """select s1_entity_id, target_entity_id, round(n.r, 6) as ratio, round(p.best, 6) as partial_ratio, round(n.ts, 6) as token_sort_ratio, round(n.tset, 6) as token_set_ratio
from txt join names n on n.x = an and n.y = tn join parts p on p.x = an and p.y = tn""",
        ),
        "score_strategies": _with(
            ENTITIES + LINKS + ", linked as (select distinct * from links)" + _measures("linked"),
            f"""select s1_entity_id, target_entity_id, round({_STANDARD}, 6) as standard,
  round(case when n.r < 30 and not {_LACKS} then greatest(n.r, 0.8::double * a.r) else n.r end, 6) as fallback,
  round(case when greatest(n.r, n.ts) < 30 and {_ADDRESS} > 60 then {_ADDRESS}
    else greatest(0.7::double * greatest(n.r, n.ts) + 0.3::double * {_ADDRESS}, 0.5::double * greatest(n.r, n.ts) + 0.5::double * {_ADDRESS}) end, 6) as weighted,
  round(case when greatest(n.r, n.ts, 0.9::double * n.tset) < 30 and {_ADDRESS} > 60 then {_ADDRESS} else 0.65::double * greatest(n.r, n.ts, 0.9::double * n.tset) + 0.35::double * {_ADDRESS} end
    + case when e.postal_code <> '' and e.postal_code = t.postal_code then 10::double else 0::double end, 6) as postal
from txt join names n on n.x = an and n.y = tn join addresses a on a.x = aa and a.y = ta
  join ent e on e.entity_id = s1_entity_id join ent t on t.entity_id = target_entity_id""",
        ),
        "result_lists_by_jaccard": _with(
            _ranked(5, 10),
            """select e.entity_id as source1_entity_id, coalesce(string_agg(target_entity_id, ',' order by rank) filter (blocking_score >= 60), '') as matched_entity_ids,
  coalesce(string_agg(target_entity_id, ',' order by rank), '') as candidate_entity_ids
from raw_e e left join best b on b.s1_entity_id = e.entity_id where e.source_no = 1 group by e.entity_id""",
        ),
        "inference_counters": _with(
            _top(15, 35),
            """, per as (
  select e.entity_id, count(target_entity_id) filter (blocking_score >= 70) as m, count(target_entity_id) as c
  from raw_e e left join best b on b.s1_entity_id = e.entity_id where e.source_no = 1 group by 1
)
select count(*) as n_anchors, count(*) filter (m > 0) as n_matched, count(*) filter (m = 0) as n_singletons, sum(c)::bigint as n_candidates, sum(m)::bigint as n_matches from per""",
        ),
        "validate_findings": _with(
            FAULTY,
            """, req as (select id from base where n % 23 <> 0), u as (select id, unnest(ids) as x from subm), g as (
  select s.id, list_distinct(flatten(list(s.ids))) as m from subm s group by 1
)
select 'duplicate_anchor' as rule, id from subm group by id having count(*) > 1
union all select distinct 'repeated_id', id from subm where len(ids) <> len(list_distinct(ids))
union all select distinct 'self_match', x from u where starts_with(x, 'S1-')
union all select distinct 'wrong_prefix', x from u where not regexp_matches(x, '^S[123]-')
union all select distinct 'unknown_target', x from u where regexp_matches(x, '^S[23]-') and x not in (select 'S2-' || o_orderkey from orders where o_orderkey % 29 <> 0)
union all select 'missing_anchor', id from req where id not in (select id from subm)
union all select distinct 'unexpected_anchor', id from subm where id not in (select id from req)
union all select 'not_candidate', g.id from g join base using (id) where len(list_filter(g.m, lambda x: not list_contains(base.cand, x))) > 0""",
        ),
        "validate_counts": _with(FAULTY, "select count(*) as n_rows, count(*) filter (len(ids) = 0) as n_empty, count(*) filter (len(ids) > 0) as n_filled from subm"),
    }
    return out | _file_queries()


def _draw(x: str, seed: int) -> str:
    return f"('0x' || substr(md5({x} || ':{seed}'), 1, 8))::bigint"


def _file_queries() -> dict[str, str]:
    clean = lambda c: f"regexp_replace(coalesce({c}, ''), '[\t\r\n]', ' ', 'g') as {c}"
    stated = lambda rows, names: f"select * from (values {', '.join(map(str, rows))}) v({names})"
    # A lost row is also a missing anchor; a second header is an unexpected anchor with a wrong prefix. All but one lack the second file.
    found = [("good", 0, 1), ("commas", 1, 1), ("no_tab", 1, 1), ("wrong_header", 1, 1), ("row_without_tab", 2, 1), ("header_twice", 2, 1), ("repeated_id", 1, 1), ("not_candidate", 0, 1), ("absent", 1, 1)]
    chosen = f"""own_t as (
  select entity_id from ent where source_no = 1 and country_norm in ('de', 'fr') order by {_draw("entity_id", 42)}, entity_id limit 100
)"""
    return {
        "io_entity_file": _with(RAW, "select " + ", ".join(clean(c) for c in ("entity_id", "business_name", "business_address", "country")) + " from raw_e"),
        "io_truth_file": _with(COUNTS, "select *, match_count = 0 as is_singleton from counts"),
        "io_row_limit": _with(RAW, "select least(100, count(*))::bigint as n_rows, least(100, count(*))::bigint as n_ids from raw_e"),
        "io_missing_inputs": stated([("file", "FileNotFoundError"), ("column", "KeyError")], "missing, error"),
        "io_parquet_replaced": _with(
            ENTITIES, "select e.entity_id, 'source1' as source, name_norm, clean_address, street, city, state, postal_code, country_norm, raw_landmark, coalesce(business_name, '') as raw_name, coalesce(business_address, '') as raw_address from ent e join raw_e r using (entity_id)"
        ),
        "io_parquet_report": "select count(*) as n_rows, true as measured from documents",
        "io_pruned_scan": _with(ENTITIES, "select count(*) as n_rows, count(*) as n_places, (2 * count(*))::bigint as sources, count(city) as n_cities, max(name_norm) as last_name from ent"),
        "io_result_files": _with(LISTS, "select 'matching' as file, true as has_tab, source1_entity_id as id, truth as ids from lists union all select 'candidate', true, source1_entity_id, pred from lists"),
        "io_id_sets": _with(RAW, "select 'text' as kind, entity_id as id from raw_e where source_no = 2 union all select 'parquet', entity_id from raw_e"),
        "io_match_targets": _with(RAW, "select entity_id as id from raw_e where source_no <> 1"),
        "io_inventory": stated([("test_source2.tsv",), ("test_source3.tsv",)], "name").replace("select *", "select name, true as discovered"),
        "io_scan_heads": _with(RAW, "select coalesce(country, '') as value, count(*) as n from raw_e group by 1 union all " + stated([("entity_id",), ("business_name",), ("business_address",), ("country",)], "value").replace("select *", "select value, -1")),
        "validate_files": stated(found, "name, n_errors, n_warnings"),
        "grouped_folds": _with(_capped(), f"select s1_entity_id, target_entity_id, ({_draw('s1_entity_id', 0)} % 4)::int as fold from met"),
        "training_rows": _with(
            MEASURED + f", {chosen}" + """, best as (
  select * from (select *, row_number() over (partition by s1_entity_id order by blocking_score desc, source_id, pos, target_entity_id) as rank from scored where blocking_score >= 30) where rank <= 20
)""",
            """select b.s1_entity_id, b.target_entity_id, source_id, case when l.s1_entity_id is null then 0 else 1 end as label, round((case when an <> '' and tn <> '' then name_r / 100 else 0 end)::float::double, 5) as name_ratio
from best b join own_t o on o.entity_id = b.s1_entity_id left join (select distinct * from links) l on l.s1_entity_id = b.s1_entity_id and l.target_entity_id = b.target_entity_id""",
        ),
        "unknown_countries": _with(
            KEYED.replace("from ent\n), keyed", "from (select * replace (case when pos % 5 = 0 then null when pos % 7 = 0 then '  ' else country_norm end as country_norm) from ent)\n), keyed"),
            "select land as country, count(distinct entity_id) as n_targets, count(distinct key) as n_keys from keyed group by land",
        ),
        "distinct_countries": _with(ENTITIES, "select distinct country_norm from ent where pos % 5 > 0 and country_norm is not null"),
        "exploded_links": _with(LISTS, "select source1_entity_id as s1_entity_id, unnest(string_split(truth, ',')) as target_entity_id from lists where truth <> ''"),
        "decided_pairs": _with(_top(15, 35), "select s1_entity_id, target_entity_id, round(blocking_score / 100, 6) as prob from best where round(blocking_score / 100, 6) >= 0.7"),
        "insertion_order": _with(ENTITIES, "select entity_id, country_norm, (row_number() over (partition by country_norm order by source_no, pos) - 1)::int as place from ent where source_no <> 1"),
        "reduction_ratio": _with(
            _capped(),
            """, c as (select (select count(*) from met) as n_candidates, (select count(*) from raw_e where source_no = 1) as n_anchors, (select count(*) from raw_e where source_no <> 1) as n_targets)
select *, round(1 - n_candidates / (n_anchors * n_targets)::double, 6) as ratio from c""",
        ),
        "first_misses": _with(
            _top(30, 35),
            "select s1_entity_id, target_entity_id, coalesce(rank - 1, -1)::int as rank from (select distinct * from links) l left join best b using (s1_entity_id, target_entity_id) where coalesce(rank > 5, true) order by 1, 2 limit 20",
        ),
        "sample_anchors": _with(RAW, f"select entity_id from raw_e order by {_draw('entity_id', 42)}, entity_id limit 100"),
        "sample_links": _with(
            LISTS,
            f"""select source1_entity_id as s1_entity_id, (string_split(truth, ','))[1 + {_draw("source1_entity_id", 43)} % len(string_split(truth, ','))] as target_entity_id
from (select * from lists where truth <> '' order by {_draw("source1_entity_id", 42)}, source1_entity_id limit 15)""",
        ),
    }
