"""DuckDB SQL for the contract queries that SQL can express."""

from __future__ import annotations

from furrow.llm.chat_format import ChatTemplate
from furrow.llm.queries import CONTROL_TEXT, URL_RULES


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _op1() -> str:
    t = ChatTemplate()

    def escaped(col: str) -> str:
        """The length of the escaped text: one more for each backslash and for each control string."""
        more = [f"(length({col}) - length(replace({col}, {_quoted(c)}, '')))::bigint // {len(c)}" for c in ("\\", *t.controls)]
        return f"length({col}) + " + " + ".join(more)

    marks = len(t.open) + len(t.middle) + len(t.close)
    allowed = ", ".join(f"({_quoted(a)}, {_quoted(b)})" for a, b in t.transitions)
    return f"""
with t as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -7, 0, 'user', {_quoted(CONTROL_TEXT)} union all select -7, 1, 'assistant', {_quoted(CONTROL_TEXT)}
), o as (
  select *, coalesce(lag(role) over (partition by conv_id order by turn nulls first, role, text), {_quoted(t.start)}) as before from t
)
select conv_id, count(*)::bigint as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, role, text)) as turns_sha256,
  coalesce(sum(length(text)) filter (where role = 'assistant'), 0)::bigint as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn nulls first, role, text) filter (where role = 'assistant'), '')) as loss_sha256,
  sum({marks} + {escaped("role")} + {escaped("text")})::bigint as formatted_chars,
  bool_and((before, role) in ({allowed})) as valid
from o group by conv_id"""


#: A-Z in lower case, and the runs of anything but separators.
_WORDS = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+')"


def _op6(n: int = 4, num: int = 85, den: int = 100) -> str:
    """Every pair of documents with a common shingle, then everything that links reach."""
    return f"""
with recursive d as (select doc_id, {_WORDS} as w from documents),
s as materialized (select distinct doc_id, unnest(case when len(w) = 0 then [] when len(w) < {n} then [array_to_string(w, ' ')]
  else list_transform(range(1, len(w) - {n} + 2), lambda i: array_to_string(w[i:i + {n - 1}], ' ')) end) as g from d),
size as (select doc_id, count(*)::bigint as n from s group by doc_id),
shared as (select a.doc_id as a, b.doc_id as b, count(*) as n from s a join s b on a.g = b.g and a.doc_id < b.doc_id group by all),
link as (select h.a, h.b from shared h join size x on x.doc_id = h.a join size y on y.doc_id = h.b where {den} * h.n >= {num} * (x.n + y.n - h.n)),
edge as materialized (select a, b from link union all select b, a from link),
reach(a, b) as (select doc_id, doc_id from d union select r.a, e.b from reach r join edge e on e.a = r.b)
select d.doc_id, coalesce(size.n, 0) as n_shingles, r.component_id from d left join size using (doc_id) join (select a as doc_id, min(b) as component_id from reach group by a) r using (doc_id)"""


def _crc32(text: str) -> str:
    """crc32 of a text of ASCII characters; CTE crc, one row, must be joined."""
    return f"xor(list_reduce([4294967295::bigint] || list_transform(string_split({text}, ''), lambda c: ascii(c)::bigint), lambda h, c: xor(h >> 8, crc.t[xor(h & 255, c) + 1])), 4294967295)"


_CRC = """crc as (select list_transform(range(256), lambda n: list_reduce([n::bigint] || list_transform(range(8), lambda k: 0::bigint),
  lambda h, k: case when h & 1 = 1 then xor(h >> 1, 3988292384) else h >> 1 end)) as t)"""


def _scores() -> str:
    """The bigram model from its definition."""

    def discounts(name: str, counts: str) -> str:
        n = [f"count_if(n = {k})" for k in (1, 2, 3, 4)]
        y = f"(case when {n[0]} > 0 then {n[0]}::double / ({n[0]} + 2 * {n[1]}) else 0.0::double end)"
        raw = [f"(case when {n[k - 1]} > 0 then {k}::double - {k + 1} * {y} * {n[k]} / {n[k - 1]} else {k} * {y} end)" for k in (1, 2, 3)]
        fixed = ", ".join(f"case when {v} > 0 then {v} else {f}::double end" for v, f in zip(raw, (0.5, 1.0, 1.5), strict=True))
        return f"{name} as materialized (select [{fixed}] as d from {counts})"

    return f"""
with {_CRC}, d as materialized (select doc_id, {_crc32("doc_id::varchar")} % 10 = 0 as held_out, {_WORDS} || [chr(10)] as w from documents, crc),
tok as materialized (select doc_id, held_out, unnest(w) as v, unnest(range(len(w))) as k from d),
pair as materialized (select a.doc_id, a.held_out, a.k, a.v, coalesce(b.v, chr(13)) as u from tok a left join tok b on b.doc_id = a.doc_id and b.k = a.k - 1),
uni as materialized (select v, count(*) as n from tok where not held_out group by v),
total as materialized (select sum(n)::bigint as n, count(*) as v from uni),
bi as materialized (select u, v, count(*) as n from pair where not held_out group by u, v),
ends as materialized (select v, count(*) as n from bi group by v),
{discounts("db", "bi")}, {discounts("de", "ends")},
context as materialized (select u, sum(n) as n, sum((select d from db)[least(n, 3)]) as rest from bi group by u),
low as materialized (select sum((select d from de)[least(n, 3)]) / (select count(*) from bi) as rest from ends),
alone as (select v, (n - (select d from de)[least(n, 3)]) / (select count(*) from bi) as p from ends),
scored as (select p.doc_id, p.k, uni.n is not null as known, log10((coalesce(uni.n, 0) + 0.1::double) / (total.n + 0.1::double * (total.v + 1))) as base,
  coalesce(alone.p, 0) + low.rest / (total.v + 1) as lower, context.n as c, context.rest as rest, coalesce(bi.n, 0) as n
  from pair p left join uni using (v) left join alone using (v) left join context on context.u = p.u left join bi on bi.u = p.u and bi.v = p.v, total, low)
select d.doc_id, any_value(d.held_out) as held_out, count(*)::bigint as n_tokens, count_if(known)::bigint as n_known, (select n from total) as train_tokens, round(sum(base), 6) as base_score,
  round(sum(log10(case when c is null then lower else (case when n > 0 then n - (select d from db)[least(n, 3)] else 0.0::double end) / c + rest / c * lower end)), 6) as score
from d join scored using (doc_id) group by d.doc_id"""


def _url_rules() -> str:
    rules = ", ".join(f"({_quoted(v)}, {_quoted(h)}, {_quoted(p)})" for v, h, p in URL_RULES)
    return f"""
with r as (select * from (values {rules}) as v(verdict, rule_host, rule_path)),
u as (select page_id, url, case when contains(url, '://') then url[position('://' in url) + 3:] else '' end as rest from pages),
h as (select page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path from u),
f as (select h.page_id, rule_host || rule_path as rule, verdict, row_number() over (partition by h.page_id order by length(rule_host || rule_path) desc, rule_host || rule_path) as k
  from h join r on (host = rule_host or ends_with(host, '.' || rule_host)) and starts_with(path, rule_path))
select h.page_id, host, path, rule, verdict from h left join f on f.page_id = h.page_id and k = 1"""


ORACLES: dict[str, str] = {
    "language_model_rounded": _scores(),
    "op6_ngram_join": _op6(),
    "near_duplicates": _op6(5, 80),
    "url_rules": _url_rules(),
    "op1_chat_format": _op1(),
    "op4_exact_dedup": """
with d as (select doc_id, coalesce(text, '') as text from documents),
g as (select text, max(doc_id) as keep_id, count(*)::bigint as group_size from d group by text)
select d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id as kept, sha256(d.text) as text_sha256 from d join g using (text)""",
}
