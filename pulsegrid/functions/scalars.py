"""Column expressions: time, text coercion, geometry and the bands shown for readings. No Python runs on rows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_RADIUS_M = 6_371_000.0


def ntz(text: str) -> Column:
    return F.lit(text).cast("timestamp_ntz")


def midnight(ts: Column) -> Column:
    return F.date_trunc("day", ts).cast("timestamp_ntz")


def plus(ts: Column, *, days: int = 0, hours: int = 0, minutes: int = 0) -> Column:
    return ts + F.make_dt_interval(F.lit(days), F.lit(hours), F.lit(minutes))


def minutes_between(start: Column, end: Column) -> Column:
    return F.timestamp_diff("MICROSECOND", start, end) / 60_000_000.0


def percent_2dp(part: Column, total: Column) -> Column:
    """``100 * part / total`` of integers, rounded half up to 2 places exactly; 0 where the total is 0."""
    scaled = F.floor((part * 20000 + total) / F.nullif(total * 2, F.lit(0)))
    return F.coalesce(scaled / 100.0, F.lit(0.0))


def haversine_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance in metres; null if any argument is null."""
    half_lat, half_lon = F.radians(lat2 - lat1) / 2, F.radians(lon2 - lon1) / 2
    a = F.sin(half_lat) * F.sin(half_lat) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.sin(half_lon) * F.sin(half_lon)
    return F.atan2(F.sqrt(a), F.sqrt(1 - a)) * 2 * EARTH_RADIUS_M


# Text to values. None of these fails: what cannot be read is null.


def text_or_null(x: Column) -> Column:
    t = F.trim(x)
    return F.when((t == "") | (F.lower(t) == "nan"), None).otherwise(t)


def _number(x: Column) -> Column:
    n = x.try_cast("double")
    return F.when(F.isnan(n), None).otherwise(n)


def integer_or_null(x: Column) -> Column:
    """Read as a number, then cut towards zero."""
    return _number(F.trim(x)).try_cast("bigint")


def number_or_null(x: Column) -> Column:
    """A number with a point or a comma for decimals."""
    return F.coalesce(_number(F.trim(x)), _number(F.replace(F.trim(x), F.lit(","), F.lit("."))))


def decimal_or_null(x: Column) -> Column:
    return F.trim(x).try_cast("decimal(20,10)")


def device_text(x: Column) -> Column:
    """Identifier as text: a number loses its fraction, anything else is trimmed."""
    return F.coalesce(integer_or_null(x).cast("string"), F.nullif(F.trim(x), F.lit("")))


# The words of three vocabularies.
GPS_TRUE = ("TRUE", "1", "SI", "SÍ", "Y")
BATTERY_TRUE, BATTERY_FALSE = ("true", "1", "si", "sí", "s", "yes", "y"), ("false", "0", "no", "n")
IMPORT_TRUE, IMPORT_FALSE = ("true", "1", "si", "sí", "yes"), ("false", "0", "no")


def gps_boolean(x: Column) -> Column:
    """Null and unknown words are false."""
    return F.coalesce(F.upper(F.trim(x)).isin(*GPS_TRUE), F.lit(False))


def battery_boolean(x: Column) -> Column:
    t = F.lower(F.trim(x))
    return F.when(t.isin(*BATTERY_TRUE), True).when(t.isin(*BATTERY_FALSE), False)


def import_boolean(x: Column) -> Column:
    t = F.lower(F.trim(x))
    return F.when(t.isin(*IMPORT_TRUE), True).when(t.isin(*IMPORT_FALSE), False)


_DAY_FIRST = r"^([0-9]{1,2})[/.-]([0-9]{1,2})[/.-]([0-9]{4})(?:[T\x20]+([0-9].*))?$"
_YEAR_FIRST = r"^([0-9]{4})[/.-]([0-9]{1,2})[/.-]([0-9]{1,2})(?:[T\x20]+([0-9].*))?$"


def timestamp_or_null(x: Column) -> Column:
    """A date, day first or year first, with or without a time, seconds, a fraction or a zone (which is turned into the session's).

    A month above 12 beside a possible one is taken for the day.
    """
    t = F.trim(x)

    def read(pattern: str, year: int, month: int, day: int) -> Column:
        part = lambda i: F.regexp_extract(t, pattern, i)
        swapped = (F.length(part(month)) == 2) & (part(month) > "12")
        m, d = F.when(swapped, part(day)).otherwise(part(month)), F.when(swapped, part(month)).otherwise(part(day))
        return F.concat_ws(" ", F.concat_ws("-", part(year), m, d), F.nullif(part(4), F.lit("")))

    text = F.when(t.rlike(_DAY_FIRST), read(_DAY_FIRST, 3, 2, 1)).when(t.rlike(_YEAR_FIRST), read(_YEAR_FIRST, 1, 2, 3))
    return text.try_cast("timestamp").cast("timestamp_ntz")


def same_7dp(x: Column, y: Column) -> Column:
    """Equal at 7 decimals; two nulls are equal."""
    return F.bround(x, 7).eqNullSafe(F.bround(y, 7))


def version_of_file(name: Column) -> Column:
    found = F.regexp_extract(name, r"(?i)\bV\s*([0-9]+)\b", 1)
    return F.when(found != "", F.concat(F.lit("V"), found))


def holds_folded(x: Column, term: str) -> Column:
    """Whether a text holds a term, whatever case and accents of either."""
    return F.contains(F.collate(x, "UNICODE_CI_AI"), F.collate(F.lit(term), "UNICODE_CI_AI"))


def duration_text(start: Column, end: Column) -> Column:
    """Like ``2 h 30 min``; whole minutes, half to even, never negative."""
    total = F.greatest(F.bround(minutes_between(start, end)).cast("bigint"), F.lit(0))
    hours, rest = F.floor(total / 60), total % 60
    return F.when((hours > 0) & (rest > 0), F.concat(hours, F.lit(" h "), rest, F.lit(" min"))).when(hours > 0, F.concat(hours, F.lit(" h"))).otherwise(F.concat(rest, F.lit(" min")))


def slot_label(ts: Column) -> Column:
    """Nearest half hour of the same day as ``HH:MM``."""
    h, m = F.hour(ts), F.minute(ts)
    return F.when(m < 15, F.format_string("%02d:00", h)).when(m < 45, F.format_string("%02d:30", h)).when(h == 23, "23:30").otherwise(F.format_string("%02d:00", h + 1))


def battery_band(pct: Column) -> Column:
    return F.when(pct.isNull(), "no_data").when(pct >= 80, "high").when(pct >= 50, "medium").when(pct >= 20, "low").otherwise("critical")


def battery_card(pct: Column) -> Column:
    return F.when(pct.isNull(), "neutral").when(pct >= 80, "ok").when(pct >= 20, "warning").otherwise("error")


def status_band(last: Column, as_of: Column) -> Column:
    """``recent`` (today, an hour old at most), ``old`` (today) or ``none``."""
    return F.when(last.isNull() | (last < midnight(as_of)), "none").when(last < plus(as_of, hours=-1), "old").otherwise("recent")


def status_card(last: Column, as_of: Column) -> Column:
    """As on the battery panel: a day other than today, later ones too, counts as none."""
    return (
        F.when(last.isNull(), "no_data")
        .when(F.to_date(last) != F.to_date(as_of), "none_today")
        .when(minutes_between(last, as_of) <= 60, "updated")
        .otherwise("over_an_hour")
    )


def download_card(last: Column, as_of: Column) -> Column:
    return F.when(last.isNull(), "no_data").when(F.to_date(last) == F.to_date(as_of), "today").otherwise("not_today")


def error_band(errors: Column) -> Column:
    return F.when(errors == 0, "ok").when(errors <= 3, "warning").otherwise("alert")


def compliance_band(pct: Column) -> Column:
    return F.when(pct.isNull(), "").when(pct >= 90, "ok").when(pct >= 70, "warning").otherwise("alert")


def age_band(last: Column, as_of: Column) -> Column:
    age = minutes_between(last, as_of)
    return F.when(last.isNull(), "").when(age <= 60, "ok").when(age <= 180, "warning").otherwise("alert")


def alert_card(level: Column, drops: Column) -> Column:
    return F.when(level.isNull(), "neutral").when(level == "CRITICA", "error").when(level.isin("ALTA", "ADVERTENCIA"), "warning").when(drops > 0, "warning").otherwise("ok")
