"""Queries on capture times."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lumika.operators.instants import capture_instants, utc_text
from lumika.tables import table


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per photo with a known instant, as text in UTC."""
    found = capture_instants(table(spark, sf_dir, "photo"))
    return found.select("photo_id", utc_text(found["micros"]).alias("captured_utc"))


QUERIES = {"p7_found": p7_found}

_CLOCK = r"(\d{1,2}):(\d{2})(?::(\d{2})(?:[.,](\d+))?)?"
_PARTS = "y mo d h mi s f half rest".split()
#: Each notation with the names of its groups.
_SHAPES = (
    (r"^(\d{4})[-:/](\d{1,2})[-:/](\d{1,2})(?:[Tt]|\s+)" + _CLOCK + r"\s*(.*)$", "y mo d h mi s f rest"),
    (r"^(\d{4})(\d{2})(\d{2})[Tt](\d{2})(\d{2})(?:(\d{2})(?:[.,](\d+))?)?\s*(.*)$", "y mo d h mi s f rest"),
    (r"^(\d{1,2})\.(\d{1,2})\.(\d{4}),?\s+" + _CLOCK + r"\s*(.*)$", "d mo y h mi s f rest"),
    (r"^(\d{1,2})/(\d{1,2})/(\d{4}),?\s+" + _CLOCK + r"\s*([AaPp][Mm])?\s*(.*)$", "mo d y h mi s f half rest"),
    (r"^(?:[A-Za-z]{3,9},?\s+)?(\d{1,2})\s+([A-Za-z]{3,9})\.?\s+(\d{4})\s+" + _CLOCK + r"\s*(.*)$", "d mo y h mi s f rest"),
)


def _shaped() -> str:
    cases = []
    for shape, names in _SHAPES:
        found = f"regexp_extract(t, '{shape}', {names.split()})"
        cases.append(f"when regexp_matches(t, '{shape}') then {{{', '.join(f'{n}: ({found}).{n}' if n in names.split() else f'{n}: NULL::varchar' for n in _PARTS)}}}")
    return "case " + " ".join(cases) + " end"


_OFFSET = "^(?:(?:UTC|GMT|Z)|(?:UTC|GMT)?([+-])(\\d{1,2})(?::?(\\d{2}))?)(?:\\s*\\[.*\\])?$"


def _seconds(text: str) -> str:
    """Seconds east that a text states, or null."""
    part = f"regexp_extract(upper(trim({text})), '{_OFFSET}', ['g', 'h', 'm'])"
    number = f"(try_cast(({part}).h as int) * 3600 + coalesce(try_cast(({part}).m as int), 0) * 60)"
    return f"""case when regexp_matches(upper(trim({text})), '{_OFFSET}') then case ({part}).g when '' then 0 when '-' then -{number} else {number} end end"""


_ZONE = r"^\[?([A-Za-z_]+(?:/[A-Za-z0-9_+-]+)+)\]?$"
_BLANKS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_JUMPS = ", ".join(f"interval '{m} minutes'" for m in (-180, -120, -60, -30, 30, 60, 120, 180))
SQL: dict[str, str] = {
    "p7_found": f"""
        with p as (select distinct * from photo where id is not null), j as (select id, captured_at, case when json_valid(exif_json) and json_type(exif_json) = 'OBJECT' then exif_json end as e from p),
        x as (select id, captured_at, json_extract_string(e, '$."EXIF DateTimeOriginal"') as taken, json_extract_string(e, '$."EXIF OffsetTimeOriginal"') as off, json_extract_string(e, '$."EXIF TimeZone"') as zone from j),
        a as (select id, 1 as k, trim(captured_at, {_BLANKS}) as t from x union all select id, 2, trim(taken, {_BLANKS}) from x),
        b as (select id, k, t, {_shaped()} as q from a where t is not null),
        c as (select id, k, t, q, coalesce(trim(q.rest), '') as rest, try_cast(q.y as int) as y, try_cast(q.d as int) as d, try_cast(q.h as int) as h, try_cast(q.mi as int) as mi, coalesce(try_cast(nullif(q.s, '') as int), 0) as s,
            coalesce(list_position(['jan', 'feb', 'mar', 'apr', 'may', 'jun', 'jul', 'aug', 'sep', 'oct', 'nov', 'dec'], lower(q.mo[1:3])), try_cast(q.mo as int)) as mo, lower(coalesce(q.half, '')) as half from b),
        o as (select *, {_seconds("rest")} as own, nullif(regexp_extract(rest, '{_ZONE}', 1), '') as named from c),
        v as (select *, try_cast(lpad(y::varchar, 4, '0') || '-' || lpad(mo::varchar, 2, '0') || '-' || lpad(d::varchar, 2, '0') as date) as day, case when half = '' then h when half = 'pm' then h % 12 + 12 else h % 12 end as hour,
            mi <= 59 and s <= 59 and (case when half = '' then h <= 23 else h between 1 and 12 end) and (rest = '' or own is not null or named is not null) as possible from o),
        l as (select *, case when possible then day + to_microseconds((hour * 3600 + mi * 60 + s) * 1000000::bigint + rpad(coalesce(q.f, '')[1:6], 6, '0')::bigint) end as local, regexp_extract(t, '^([+-]?\\d{{1,16}})(?:\\.(\\d+))?$', ['whole', 'tail']) as n from v),
        u as (select *, try_cast(n.whole as bigint) as w from l),
        r as (select *, case when abs(w) < 100000000000 then 1000000 when abs(w) < 100000000000000 then 1000 else 1 end as scale from u),
        i as (select id, k, local, own, named, case when w is not null then w * scale + floor((case when starts_with(n.whole, '-') then -1 else 1 end) * rpad(n.tail[1:6], 6, '0')::bigint * scale / 1000000.0)::bigint end as micros from r),
        f as (select id, min(k) as k from i where local is not null or micros is not null group by id),
        g as (select i.*, x.off, x.zone, z.name as own_zone, y.name as other_zone from f join i on i.id = f.id and i.k = f.k join x on x.id = i.id
            left join pg_timezone_names() z on z.name = i.named left join pg_timezone_names() y on y.name = trim(x.zone, {_BLANKS})),
        h as (select id, micros, local, coalesce(own, case when own_zone is null then {_seconds("off")} end) as seconds, coalesce(own_zone, other_zone) as zone from g),
        e as (select id, micros, local, seconds, zone, case when micros is null and seconds is null and zone is not null then timezone(zone, local) end as moment from h),
        w as (select *, case when moment is not null then timezone(zone, moment) = local and len(list_filter([{_JUMPS}], lambda m: timezone(zone, moment + m) = local)) = 0 end as single from e),
        d as (select id, case when micros is not null then make_timestamp(micros) when seconds is not null then local - to_seconds(seconds) when single then timezone('UTC', moment) end as utc from w)
        select id as photo_id, strftime(utc, '%Y-%m-%dT%H:%M:%S.%fZ') as captured_utc from d where utc is not null""",
}
