"""Timestamps in mixed notations, precisions and zones as one instant in UTC.

A text is brought to one notation by expressions, split into a local wall-clock time and what it says of its zone, and
then resolved: numbers and stated offsets by arithmetic, named zones by an as-of join of the local time to that zone's
offset intervals. One matching interval gives the offset, two mean the clocks showed that time twice, none that they
skipped it; the last two have no single instant.
"""

from __future__ import annotations

import datetime as dt
import zoneinfo
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumika.session import Scratch, materialize

# The month names of mail dates.
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")
MICROS = 1_000_000
#: No zone's clocks were moved before the first of these years. After the second all zones follow a rule that a calendar
#: repeats every 400 years, to the weekday, so a later year has the intervals of that of the same place in the cycle.
STILL, RULED, CYCLE = 1800, 2499, 400
CYCLE_DAYS = 146_097

_CLOCK = r"(\d{1,2}):(\d{2})(?::(\d{2})(?:[.,](\d+))?)?"
_REST = r"\s*(.*?)"
#: Each notation, and the same parts in one order: year, month, day, hour, minute, second, fraction, AM/PM, rest.
NOTATIONS = (
    (rf"^(\d{{4}})[-:/](\d{{1,2}})[-:/](\d{{1,2}})(?:[Tt]|\s+){_CLOCK}{_REST}$", "1 2 3 4 5 6 7 - 8"),  # year first
    (rf"^(\d{{4}})(\d{{2}})(\d{{2}})[Tt](\d{{2}})(\d{{2}})(?:(\d{{2}})(?:[.,](\d+))?)?{_REST}$", "1 2 3 4 5 6 7 - 8"),  # compact
    (rf"^(\d{{1,2}})\.(\d{{1,2}})\.(\d{{4}}),?\s+{_CLOCK}{_REST}$", "3 2 1 4 5 6 7 - 8"),  # day first
    (rf"^(\d{{1,2}})/(\d{{1,2}})/(\d{{4}}),?\s+{_CLOCK}\s*([AaPp][Mm])?{_REST}$", "3 1 2 4 5 6 7 8 9"),  # month first
    (rf"^(?:[A-Za-z]{{3,9}},?\s+)?(\d{{1,2}})\s+([A-Za-z]{{3,9}})\.?\s+(\d{{4}})\s+{_CLOCK}{_REST}$", "3 2 1 4 5 6 7 - 8"),  # mail
)
_GAP = "\x01"
_NUMBER = r"^([+-]?\d{1,16})(?:\.(\d+))?$"
_OFFSET = r"^(?:(?:UTC|GMT|Z)|(?:UTC|GMT)?([+-])(\d{1,2})(?::?(\d{2}))?)(?:\s*\[.*\])?$"


def _strip(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def _number(text: Column) -> Column:
    return F.when(text != "", text.cast("int"))


def with_stated(df: DataFrame, text: str, out: str) -> DataFrame:
    """Add the struct `out`(utc, local, offset, zone) of the column `text`; null unless it states a possible date and time of day.

    utc: micros since 1970 of a bare number; local: micros of the wall clock; offset: stated seconds east; zone: a zone named with it.
    The steps are separate projections, so that each expression is evaluated once.
    """
    keep = [c for c in df.columns if c != out]
    s = F.col("__s")
    parts = F.regexp_replace(s, _GAP, "")
    for pattern, order in NOTATIONS:
        parts = F.regexp_replace(parts, pattern, _GAP.join("" if g == "-" else f"${g}" for g in order.split()))
    df = df.select("*", _strip(F.col(text)).alias("__s")).select("*", F.split(parts, _GAP, 9).alias("__p"))
    df = df.select("*", F.lower(F.substring(F.get("__p", F.lit(1)), 1, 3)).alias("__m"))
    month_of = F.create_map(*[x for i, name in enumerate(MONTHS, 1) for x in (F.lit(name), F.lit(i))])
    part = [F.get("__p", F.lit(i)) for i in range(9)]
    fields = [part[i].try_cast("int").alias(f"__{n}") for i, n in ((0, "y"), (2, "d"), (3, "h"), (4, "mi"), (5, "s2"))]
    fields.append(F.coalesce(month_of[F.col("__m")], F.col("__m").try_cast("int")).alias("__mo"))
    rest = _strip(part[8])
    zone = F.regexp_extract(rest, r"^\[?([A-Za-z_]+(?:/[A-Za-z0-9_+-]+)+)\]?$", 1)
    df = df.select("*", *fields, F.rpad(F.substring(part[6], 1, 6), 6, "0").try_cast("long").alias("__us"), F.lower(part[7]).alias("__half"), rest.alias("__rest"), offset_seconds(rest).alias("__o"), F.nullif(zone, F.lit("")).alias("__z"))
    y, mo, d, h, mi, half = (F.col(f"__{n}") for n in ("y", "mo", "d", "h", "mi", "half"))
    second = F.coalesce("__s2", F.lit(0))
    leap = ((y % 4 == 0) & (y % 100 != 0)) | (y % 400 == 0)
    last = F.when(mo == 2, F.when(leap, 29).otherwise(28)).when(mo.isin(4, 6, 9, 11), 30).otherwise(31)
    clock = F.when(half == "", h <= 23).otherwise((h >= 1) & (h <= 12))
    known = F.size("__p") == 9
    known &= F.col("__o").isNotNull() | F.col("__z").isNotNull() | (F.col("__rest") == "")
    possible = (y >= 1) & mo.between(1, 12) & (d >= 1) & (d <= last) & clock & (mi <= 59) & (second <= 59) & known
    hour = F.when(half == "", h).otherwise(h % 12 + F.when(half == "pm", 12).otherwise(0))
    df = df.select("*", F.when(possible, F.make_date(y, mo, d)).alias("__date"), (hour * 3600 + mi * 60 + second).cast("long").alias("__clock"))
    local = (F.unix_date("__date").cast("long") * 86400 + F.col("__clock")) * MICROS + F.col("__us")

    digits, fraction = F.regexp_extract(s, _NUMBER, 1), F.regexp_extract(s, _NUMBER, 2)
    df = df.select("*", F.when(s.rlike(_NUMBER), digits.cast("long")).alias("__whole"), F.rpad(F.substring(fraction, 1, 6), 6, "0").cast("long").alias("__tail"), digits.startswith("-").alias("__minus"))
    size = F.abs("__whole")
    scale = F.when(size < 100_000_000_000, MICROS).when(size < 100_000_000_000_000, 1000).otherwise(1).cast("long")
    # the fraction counts towards the sign of the number; finer digits are cut off downwards
    tail = F.col("__tail") * scale / MICROS
    utc = F.col("__whole") * scale + F.floor(F.when(F.col("__minus"), -tail).otherwise(tail)).cast("long")
    stated = F.struct(
        F.when(F.col("__whole").isNotNull(), utc).alias("utc"), F.when(F.col("__date").isNotNull(), local).alias("local"),
        F.col("__o").alias("offset"), F.col("__z").alias("zone"),
    )
    return df.select(*keep, F.when(F.col("__whole").isNotNull() | F.col("__date").isNotNull(), stated).alias(out))


def offset_seconds(text: Column) -> Column:
    """Seconds east of UTC that a text states (+02:00, -0400, +11, Z, UTC, GMT), or null."""
    s = F.upper(_strip(text))
    sign, hours, minutes = (F.regexp_extract(s, _OFFSET, g) for g in (1, 2, 3))
    seconds = _number(hours) * 3600 + F.coalesce(_number(minutes), F.lit(0)) * 60
    fine = (_number(hours) <= 18) & (F.coalesce(_number(minutes), F.lit(0)) <= 59)
    signed = F.when(sign == "-", -seconds).otherwise(seconds)
    return F.when(s.rlike(_OFFSET), F.when(sign == "", F.lit(0)).when(fine, signed)).cast("int")


def _intervals(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """For each (zone, year): the stretches of local time the zone's clocks show in that year, each with its offset."""
    utc, step = dt.timezone.utc, dt.timedelta(days=1)
    epoch = dt.datetime(1970, 1, 1, tzinfo=utc)
    for batch in batches:
        rows = []
        for zone, year in zip(batch["zone"], batch["year"]):
            info = zoneinfo.ZoneInfo(zone)

            def offset(at: dt.datetime) -> int:
                return int(at.astimezone(info).utcoffset().total_seconds())

            at, end = dt.datetime(year - 1, 12, 29, tzinfo=utc), dt.datetime(year + 1, 1, 4, tzinfo=utc)
            begin, now = None, offset(at)
            while at < end:
                then = at + step
                if offset(then) != now:
                    low, high = int((at - epoch).total_seconds()), int((then - epoch).total_seconds())
                    while high - low > 1:
                        middle = (low + high) // 2
                        low, high = (low, middle) if offset(epoch + dt.timedelta(seconds=middle)) != now else (middle, high)
                    rows.append((zone, year, begin, high + now, now))
                    now = offset(then)
                    begin = high + now
                at = then
            rows.append((zone, year, begin, None, now))
        yield pd.DataFrame(rows, columns=["zone", "year", "from_s", "to_s", "seconds"]).astype({"from_s": "Int64", "to_s": "Int64"})


def zone_intervals(needed: DataFrame) -> DataFrame:
    """Offset intervals of every (zone, year) in `needed`, which must name known zones; open ends are null.

    Years are those of the corpus, brought into STILL..RULED, so there are at most 600 zones times 700 years of them.
    """
    return needed.mapInPandas(_intervals, "zone string, year int, from_s long, to_s long, seconds int")


def instants(df: DataFrame, key: str, texts: list[str], offset: str, zone: str) -> DataFrame:
    """(key, micros): the instant of each row that has one, in micros since 1970 UTC.

    `texts` are tried in order; the first that states a possible date and time of day counts. What gives its offset is,
    in order: the offset stated with it, the zone named with it, `offset`, `zone`. Rows with none of these, and local
    times a named zone skipped or showed twice, have no instant and no row. Nulls and empty or odd texts count as
    absent, zone names the public zone database lacks count as not given. An empty table gives an empty result.
    """
    known = sorted(zoneinfo.available_timezones())
    own = F.when(F.col("t.zone").isin(known), F.col("t.zone"))
    other = F.when(F.col("z").isin(known), F.col("z"))
    rows = df.select(key, *texts, offset_seconds(F.col(offset)).alias("o"), _strip(F.col(zone)).alias("z"))
    names = [f"__t{i}" for i in range(len(texts))]
    for text, name in zip(texts, names):
        rows = with_stated(rows, text, name)
    # repeated rows end here; the aggregate also keeps later filters from being copied into the parsing expressions
    rows = rows.groupBy(key).agg(*[F.first(n).alias(n) for n in names], F.first("o").alias("o"), F.first("z").alias("z"))
    rows = rows.select(key, F.coalesce(*names).alias("t"), "o", "z")
    rows = rows.select(key, "t.utc", "t.local", F.col("t.offset").alias("offset"), own.alias("own"), "o", other.alias("other"))
    # a zone named with the time comes before an offset given elsewhere
    seconds = F.coalesce("offset", F.when(F.col("own").isNull(), F.col("o")))
    with Scratch() as made:
        return materialize(_resolved(made.table(rows.select(key, "utc", "local", seconds.alias("seconds"), F.coalesce("own", "other").alias("zone"))), key))


def _resolved(rows: DataFrame, key: str) -> DataFrame:
    """(key, micros) of `rows(key, utc, local, seconds, zone)`: numbers and stated offsets by arithmetic, zones by their intervals."""
    direct = rows.where("utc is not null or (local is not null and seconds is not null)").select(key, F.coalesce("utc", F.expr(f"local - seconds * {MICROS}L")).alias("micros"))

    local_year = F.year(F.date_add(F.lit("1970-01-01").cast("date"), F.floor(F.col("local") / (86400 * MICROS)).cast("int")))
    cycles = F.greatest(F.lit(0), F.ceil((local_year - RULED) / CYCLE)).cast("long")
    named = rows.where("utc is null and local is not null and seconds is null and zone is not null").select(key, "local", "zone", local_year.alias("y"), cycles.alias("cycles"))
    year = F.greatest(F.lit(STILL), F.col("y") - F.col("cycles") * CYCLE).cast("int")
    wall = F.floor(F.col("local") / MICROS) - F.col("cycles") * (CYCLE_DAYS * 86400)
    named = named.select(key, "local", "zone", year.alias("year"), wall.alias("wall"))
    table = zone_intervals(named.select("zone", "year").distinct())
    inside = (F.col("from_s").isNull() | (F.col("wall") >= F.col("from_s"))) & (F.col("to_s").isNull() | (F.col("wall") < F.col("to_s")))
    # at most 600 zones x 700 years x a few intervals: the interval side is bounded whatever the corpus
    matched = named.join(F.broadcast(table), ["zone", "year"]).where(inside)
    single = matched.groupBy(key).agg(F.count("*").alias("n"), F.min(F.expr(f"local - seconds * {MICROS}L")).alias("micros")).where("n = 1")
    return direct.unionByName(single.select(key, "micros"))


def utc_text(micros: Column) -> Column:
    """yyyy-MM-ddTHH:mm:ss.SSSSSSZ, whatever the session's time zone."""
    day = F.floor(micros / (86400 * MICROS))
    rest = micros - day * 86400 * MICROS
    date = F.date_add(F.lit("1970-01-01").cast("date"), day.cast("int")).cast("string")
    second = F.floor(rest / MICROS).cast("long")
    return F.format_string("%sT%02d:%02d:%02d.%06dZ", date, F.floor(second / 3600).cast("long"), F.floor(second / 60).cast("long") % 60, second % 60, rest % MICROS)


def exif_tags(exif: Column, tags: dict[str, str]) -> dict[str, Column]:
    """Tags of a JSON text, by our name; all null where the text is not one valid JSON object."""
    schema = ", ".join(f"`{tag}`: string" for tag in tags.values())
    parsed = F.from_json(exif, f"struct<{schema}>", {"mode": "PERMISSIVE", "allowSingleQuotes": "false"})
    # within brackets nothing may follow the object
    whole = F.when(F.try_parse_json(F.concat(F.lit("["), exif, F.lit("]"))).isNotNull(), parsed)
    return {name: whole[tag] for name, tag in tags.items()}


def capture_instants(photo: DataFrame) -> DataFrame:
    """(photo_id, micros) of every photo with a known capture instant: captured_at, or else EXIF DateTimeOriginal."""
    tags = exif_tags(F.col("exif_json"), {"taken": "EXIF DateTimeOriginal", "offset": "EXIF OffsetTimeOriginal", "zone": "EXIF TimeZone"})
    rows = photo.where(F.col("id").isNotNull()).select(F.col("id").alias("photo_id"), "captured_at", *[c.alias(n) for n, c in tags.items()])
    return instants(rows, "photo_id", ["captured_at", "taken"], "offset", "zone")
