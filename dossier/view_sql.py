"""The tables of ``views`` in SQL for DuckDB, stated apart from the DataFrame code; only fixed values are shared."""

from __future__ import annotations

from dossier.operators.timestamps import LOCAL_OFFSETS, MONTH_OF, OFFSETS

STAGES = ("parse", "metadata", "entities", "chunk", "embed", "graph", "validate")

CASHTAG = r"\$([A-Z]{1,5})\b"
EXCHANGE_TAG = r"\((?:NYSE|NASDAQ|Nasdaq|AMEX|NYSE American|CBOE)[\s\p{Z}]*:[\s\p{Z}]*([A-Z][A-Z.\-]{0,5})\)"


def _map(pairs: dict[str, int]) -> str:
    return "map {" + ", ".join(f"'{k}': {v}" for k, v in pairs.items()) + "}"


_NAMES = "|".join(sorted(MONTH_OF, key=lambda n: (-len(n), n)))
_DASHES = "[-/.]"
_ZONE = r"( ?(z|[+-]\d{2}:?\d{2}))?"
_CLOCK = (
    r"^(,| ?t| à| um| at| a las| -)? ?(\d{1,2})[:h](\d{2})(:(\d{2})([.,](\d{1,9}))?)?( ?([ap])\.?m\.?)?( uhr)?"
    r"( ?(z|\p{L}{2,5}|(utc|gmt)?[+-]\d{1,2}(:?\d{2})?))?( ?\[[^\]]*\])?$"
)


def _instant(reading: str) -> str:
    """Microseconds of a local reading: by the offset in the value, else by the feed's zone, the earlier of two, NULL if the clocks skipped it."""
    return f"""case when zone <> '' then {reading} - shift * 60000000::bigint::bigint
    when time_zone is not null then (select case when timezone(time_zone, make_timestamptz(late - 3600000000)) = make_timestamp({reading}) then late - 3600000000
      when timezone(time_zone, make_timestamptz(late)) = make_timestamp({reading}) then late end from (select epoch_us(timezone(time_zone, make_timestamp({reading}))) late)) end"""


_PUBLISHED = rf"""rawtimes as (
  select 'documents' src_table, doc_id row_id, feed_id, published_at raw from documents
  union all select 'document_refs', ref_id, feed_id, published_at from document_refs),
rawtext as (
  select src_table, row_id, time_zone, locale, regexp_replace(lower(trim(regexp_replace(raw, '[\s\p{{Z}}\x{{200b}}]+', ' ', 'g'))), '^\p{{L}}+\.?, ?', '') t
  from rawtimes left join feeds using (feed_id)),
rawmonth as (
  select * exclude (t), {_map(MONTH_OF)}[regexp_extract(t, '(^|[^\p{{L}}])({_NAMES})([^\p{{L}}]|$)', 2)] named,
    case when named is null then t else regexp_replace(t, '(^|[^\p{{L}}])({_NAMES})([^\p{{L}}]|$)', '\1#\3') end t from rawtext),
rawdate as (
  select src_table, row_id, time_zone, locale, named, case
    when regexp_full_match(t, '\d{{10}}|\d{{13}}|\d{{16}}') then ['epoch', t, '', '', '']
    when regexp_matches(t, '^\d{{8}}$') then ['fixed', t[1:4], t[5:6], t[7:8], '']
    when regexp_matches(t, '^\d{{8}}t?\d{{6}}([.,]\d{{1,9}})?{_ZONE}$') then
      ['fixed', t[1:4], t[5:6], t[7:8], regexp_replace(t[9:], '^t?(\d\d)(\d\d)(\d\d)', '\1:\2:\3')]
    when regexp_matches(t, '^\d{{8}}t\d{{4}}{_ZONE}$') then ['fixed', t[1:4], t[5:6], t[7:8], regexp_replace(t[10:], '^(\d\d)(\d\d)', '\1:\2')]
    when regexp_matches(t, '^\d{{4}}(-\d{{1,2}}-|/\d{{1,2}}/|\.\d{{1,2}}\.)\d{{1,2}}(\D|$)') then
      ['fixed'] || regexp_extract_all(t, '\d+')[1:3] || [regexp_extract(t, '^\d+{_DASHES}\d+{_DASHES}\d+(.*)$', 1)]
    when regexp_matches(t, '^\d{{4}}年\d{{1,2}}月\d{{1,2}}日') then ['fixed'] || regexp_extract_all(t, '\d+')[1:3] || [regexp_extract(t, '日(.*)$', 1)]
    when regexp_matches(t, '^\d{{1,2}}(\.|st|nd|rd|th|er)?[ -](de )?#\.?,?[ -](del? )?(\d{{4}}|\d{{2}})(\D|$)') then
      ['fixed', regexp_extract(t, '#\.?,?[ -](del? )?(\d+)', 2), cast(named as varchar), regexp_extract(t, '^\d+'), regexp_extract(t, '#\.?,?[ -](del? )?\d+(.*)$', 2)]
    when regexp_matches(t, '^#\.? \d{{1,2}}(st|nd|rd|th)?,? \d{{4}}(\D|$)') then
      ['fixed', regexp_extract(t, '^#\.? \d+(st|nd|rd|th)?,? (\d+)', 2), cast(named as varchar), regexp_extract(t, '^#\.? (\d+)', 1), regexp_extract(t, '^#\.? \d+(st|nd|rd|th)?,? \d+(.*)$', 2)]
    when regexp_matches(t, '^\d{{1,2}}(-\d{{1,2}}-|/\d{{1,2}}/|\.\d{{1,2}}\.)(\d{{4}}|\d{{2}})(\D|$)') then
      [case when locale = 'en-US' then 'month' else 'day' end, regexp_extract_all(t, '\d+')[3], regexp_extract_all(t, '\d+')[1], regexp_extract_all(t, '\d+')[2], regexp_extract(t, '^\d+{_DASHES}\d+{_DASHES}\d+(.*)$', 1)]
    end d from rawmonth),
rawclock as (
  select *, regexp_extract(d[5], '{_CLOCK}', ['w', 'hour', 'minute', 's', 'second', 'f', 'fraction', 'h', 'half', 'u', 'z', 'zone', 'g', 'o', 'b']) c,
    d[5] = '' or regexp_matches(d[5], '{_CLOCK}') readable from rawdate where d is not null),
rawparts as (
  select src_table, row_id, time_zone, d[1] kind, d[2] first, try_cast(d[2] as integer) + case when length(d[2]) = 2 then 2000 else 0 end y,
    try_cast(d[case d[1] when 'day' then 4 else 3 end] as integer) m, try_cast(d[case d[1] when 'day' then 3 else 4 end] as integer) dd,
    case when d[5] = '' then 0 when c.half = '' then try_cast(c.hour as integer) when try_cast(c.hour as integer) between 1 and 12 then try_cast(c.hour as integer) % 12 + case c.half when 'p' then 12 else 0 end end hh,
    case when d[5] = '' then 0 else try_cast(c.minute as integer) end mi, case when c.second = '' then 0 else coalesce(try_cast(c.second as integer), 0) end ss,
    cast(rpad(c.fraction[1:6], 6, '0') as integer) us, trim(c.zone) zone from rawclock where readable),
rawlocal as (
  select *, case when hh <= 23 and mi <= 59 and ss <= 59 then epoch_us(cast(try(make_date(y, m, dd)) as timestamp)) + ((hh * 60 + mi) * 60 + ss) * 1000000::bigint + us end wall,
    case when regexp_matches(zone, '[+-]\d') then (case when contains(zone, '-') then -1 else 1 end)
        * nullif(least(try_cast(regexp_extract(zone, '[+-](\d{{1,2}})', 1) as integer) * 60 + coalesce(try_cast(regexp_extract(zone, '[+-]\d{{1,2}}:?(\d{{2}})$', 1) as integer), 0), 1081), 1081)
      else coalesce({_map({f"{name} {area}": v for (name, area), v in LOCAL_OFFSETS.items()})}[zone || ' ' || coalesce(time_zone, '')], {_map(OFFSETS)}[zone]) end shift
  from rawparts where kind <> 'epoch'),
instants as (
  select src_table, row_id, {_instant("wall")} published_us from rawlocal where wall is not null
  union all select src_table, row_id, try_cast(first as bigint) * case length(first) when 10 then 1000000 when 13 then 1000 else 1 end from rawparts where kind = 'epoch'),
usable as (select src_table, row_id, cast(published_us as bigint) published_us from instants where published_us is not null)"""

# Companies named in a text. Words and what stands between them are numbered with their places; a name may start at a
# word that equals its first one. Names are taken from left to right, the longest at a place, then tagged tickers outside of them.
_LINKS = rf"""surfaces as (
  select s surface, min(company_id) company_id, regexp_extract(s, '^[\p{{L}}\p{{N}}_]*') head
  from (select company_id, lower(trim(unnest(list_concat([name], coalesce(aliases, []))))) s from companies) where length(s) >= 4 group by s),
pieces as (
  select document_id, i, piece, sum(length(piece)) over (partition by document_id order by i) - length(piece) place
  from (select document_id, unnest(parts) piece, generate_subscripts(parts, 1) i
    from (select document_id, regexp_extract_all(text, '[\p{{L}}\p{{N}}_]+|[^\p{{L}}\p{{N}}_]+') parts from doc where text is not null))),
named as (
  select document_id, place a, max(length(surface)) long, max_by(company_id, length(surface)) company_id
  from pieces join surfaces on lower(piece) = head join (select document_id, lower(text) low from doc) using (document_id)
  where piece[1] <> lower(piece[1]) and substr(low, cast(place as bigint) + 1, length(surface)) = surface
    and not regexp_matches(substr(low, cast(place as bigint) + length(surface) + 1, 1), '[\p{{L}}\p{{N}}_]') group by 1, 2),
spans as (select document_id, a, a + long b, company_id, row_number() over (partition by document_id order by a) n from named),
taken as (
  select document_id, n, a, b, company_id, true used, b upto from spans where n = 1
  union all
  select s.document_id, s.n, s.a, s.b, s.company_id, s.a >= t.upto, case when s.a >= t.upto then s.b else t.upto end
  from taken t join spans s on s.document_id = t.document_id and s.n = t.n + 1),
tick as (select t ticker, min(company_id) company_id from (select company_id, unnest(tickers) t from companies) group by 1),
cash as (
  select w.document_id, w.place - 1 a, w.place + length(w.piece) b, w.piece ticker from pieces w join pieces p on p.document_id = w.document_id and p.i = w.i - 1
  where p.piece like '%$' and regexp_full_match(w.piece, '[A-Z]{{1,5}}')),
exchange as (
  select document_id, place - 1 a, place + length(regexp_extract(substr(text, cast(place as bigint)), tag)) - 1 b, regexp_extract(substr(text, cast(place as bigint)), tag, 1) ticker
  from (select document_id, text, piece, place, '^' || '{EXCHANGE_TAG.replace(chr(39), chr(39) * 2)}' tag from pieces join doc using (document_id) where piece in ('NYSE', 'NASDAQ', 'Nasdaq', 'AMEX', 'CBOE') and place > 0)
  where regexp_matches(substr(text, cast(place as bigint)), tag)),
tagged as (
  select document_id, a, b, company_id from (select * from cash union all select * from exchange) t join tick using (ticker)
  where not exists (select 1 from taken n where used and n.document_id = t.document_id and n.a < t.b and t.a < n.b)),
mention as (select document_id, company_id, a, b from taken where used union all select document_id, company_id, a, b from tagged),
dc as materialized (select distinct document_id, company_id from mention)"""

SQL = {
    "time": _PUBLISHED,
    "doc": """doc as (select * from documents qualify row_number() over (partition by document_id order by ingested_at, doc_id) = 1)""",
    "pub": """pub as (select document_id, make_timestamp(published_us) published, cast(make_timestamp(published_us) as date) published_day
  from doc join usable on src_table = 'documents' and row_id = doc_id)""",
    "chunk": """chunk as (select * exclude (deleted_at) from chunks qualify row_number() over (partition by chunk_id order by loaded_at desc) = 1)""",
    "ev": """ev as (select distinct * exclude (loaded_at) from evidence)""",
    "rep": """rep as (select * from reports qualify row_number() over (partition by report_id order by loaded_at) = 1)""",
    "plan": """plan as (select * from research_plans qualify row_number() over (partition by plan_id order by loaded_at) = 1)""",
    "dc": _LINKS,
    "run": f"""run as (select event_id run_id, ts moment, user_id document, ({list(STAGES)!r})[event_id % 7 + 1] stage,
  case event_type when 'error' then 'failure' when 'signup' then 'pending' else 'success' end status, event_id % 4 + 1 attempt, value duration_ms from events)""",
}


def with_views(names: str, query: str) -> str:
    """A query preceded by the named views."""
    return "with recursive " + ",\n".join(SQL[n] for n in names.split()) + ("" if query.lstrip().startswith(",") else "\n") + query
