"""Column helpers that pin down the reference's NULL / NaN / tie rules.

Each helper returns a ``Column`` so Catalyst keeps it inside whole-stage
codegen; none of them is a Python UDF.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

__all__ = [
    "n_distinct",
    "r_div",
    "strict_max",
    "strict_sum",
    "sum0",
    "asc_last",
    "desc_last",
    "squish",
    "remove_first",
    "parse_number",
    "month_label",
    "build_local_datetime",
    "null_dst_gap",
    "utc_clock",
    "to_utc",
    "from_utc",
    "time_of_day",
    "safe_date",
    "short_date",
    "row_sum",
    "col",
]

MONTH_ABB = ["Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec"]


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def n_distinct(c: str | Column) -> Column:
    """``n_distinct``: distinct count where NULL counts as one value (T2)."""
    c = col(c)
    return F.count_distinct(c) + F.max(F.when(c.isNull(), 1).otherwise(0))


def r_div(a: str | Column, b: str | Column) -> Column:
    """Division with R's zero rule (T6): 0/0 -> NULL (R's NaN), x/0 -> +/-Infinity.

    NULL stands in for NaN so that no NaN ever reaches a comparison (Spark
    orders NaN above every number, R makes the comparison NA).
    """
    a, b = col(a).cast("double"), col(b).cast("double")
    return (
        F.when(a.isNull() | b.isNull(), F.lit(None).cast("double"))
        .when((b == 0) & (a == 0), F.lit(None).cast("double"))
        .when((b == 0) & (a > 0), F.lit(float("inf")))
        .when(b == 0, F.lit(float("-inf")))
        .otherwise(a / b)
    )


def strict_max(c: str | Column) -> Column:
    """``max`` without ``na.rm``: one NULL in the group makes the result NULL (T4)."""
    c = col(c)
    return F.when(F.count_if(c.isNull()) > 0, F.lit(None)).otherwise(F.max(c))


def strict_sum(c: str | Column) -> Column:
    """``sum`` without ``na.rm`` (T5)."""
    c = col(c)
    return F.when(F.count_if(c.isNull()) > 0, F.lit(None)).otherwise(F.sum(c))


def sum0(c: str | Column) -> Column:
    """``sum(x, na.rm=TRUE)``: all-NULL group gives 0, not NULL (T3)."""
    return F.coalesce(F.sum(col(c)), F.lit(0).cast("double"))


def asc_last(c: str | Column) -> Column:
    """Ascending with NULL last, as ``arrange`` does (T8)."""
    return col(c).asc_nulls_last()


def desc_last(c: str | Column) -> Column:
    """Descending with NULL last, as ``arrange(desc())`` does (T8)."""
    return col(c).desc_nulls_last()


def squish(c: str | Column) -> Column:
    """``str_squish``: trim and collapse inner whitespace runs to one space."""
    return F.trim(F.regexp_replace(col(c), r"\s+", " "))


def remove_first(c: str | Column, pattern: str) -> Column:
    """``str_remove``: drop only the first match of ``pattern`` (T18)."""
    return F.regexp_replace(col(c), f"(?s)^(.*?){pattern}", "$1")


def parse_number(c: str | Column, x_as_one: bool = True) -> Column:
    """``parse_number`` on count text; ``"X"`` (present, not counted) -> 1.

    Takes the first number in the text, drops thousands separators; no number
    gives NULL.
    """
    c = col(c)
    num = F.regexp_extract(c, r"-?[0-9][0-9,]*(\.[0-9]+)?", 0)
    parsed = F.when(num == "", F.lit(None).cast("double")).otherwise(
        F.regexp_replace(num, ",", "").try_cast("double")
    )
    if x_as_one:
        return F.when(F.trim(c) == "X", F.lit(1.0)).otherwise(parsed)
    return parsed


def month_label(d: str | Column) -> Column:
    """``month(d, label=TRUE, abbr=TRUE)`` as text; sort on ``month(d)``, never the label."""
    # Guard the index: on Spark 4.1, element_at over a literal array returns the
    # last element for a NULL index instead of NULL.
    m = F.month(col(d))
    return F.when(m.isNotNull(), F.element_at(F.array(*[F.lit(x) for x in MONTH_ABB]), m))


def build_local_datetime(date: str | Column, time: str | Column, tz: str) -> Column:
    """``ymd_hms(str_c(date, time), tz)`` as a local ``TIMESTAMP_NTZ``.

    NULL or malformed time -> NULL (T9); wall-clock times inside the spring
    DST gap of ``tz`` -> NULL, as lubridate does (T10).
    """
    # Each input is named once: a filter on the result would evaluate it as often as it is named.
    valid = F.regexp_extract(F.trim(col(time)), r"^([01][0-9]|2[0-3]):[0-5][0-9](:[0-5][0-9])?$", 0)
    text = F.substring(F.concat(valid, F.lit(":00")), 1, 8)  # no match leaves ":00", which is no time
    return null_dst_gap(col(date).cast("date").cast("timestamp_ntz") + text.try_cast("interval hour to second"), tz, date)


def _exists(clock: Column, tz: str) -> Column:
    """Whether a wall clock time, given as the instant at which UTC clocks show it, exists in ``tz``.

    Instants are free of the session zone, and their zone conversions read the
    name of the zone once, not once per row as ``convert_timezone`` does.
    """
    return F.from_utc_timestamp(F.to_utc_timestamp(clock, tz), tz) == clock


def utc_clock(ts: str | Column) -> Column:
    """The instant at which UTC clocks show the wall clock time of a ``TIMESTAMP_NTZ``."""
    ts = col(ts)
    day = F.unix_date(ts.cast("date")).cast("long") * 86400 + F.hour(ts) * 3600 + F.minute(ts) * 60
    return F.timestamp_micros(day * 1000000 + (F.date_part(F.lit("SECOND"), ts) * 1000000).cast("long"))


def null_dst_gap(ts: str | Column, tz: str, date: str | Column | None = None) -> Column:
    """NULL for local wall-clock times that do not exist in ``tz``.

    Only days around which the offset of ``tz`` changes are looked at closer;
    ``date`` is the day of ``ts`` where that is known.
    """
    ts = col(ts)
    day = F.unix_date((ts if date is None else col(date)).cast("date")).cast("long")
    at = lambda days: F.to_utc_timestamp(F.timestamp_seconds((day + days) * 86400), tz)
    change = F.unix_seconds(at(2)) - F.unix_seconds(at(-1)) != 3 * 86400
    checked = F.get(F.filter(F.array(ts), lambda x: _exists(utc_clock(x), tz)), F.lit(0))
    return F.when(change, checked).otherwise(ts)


def to_utc(ts: str | Column, tz: str) -> Column:
    """Local ``TIMESTAMP_NTZ`` in ``tz`` -> UTC ``TIMESTAMP_NTZ`` (session-zone free)."""
    return F.convert_timezone(F.lit(tz), F.lit("UTC"), col(ts))


def from_utc(ts: str | Column, tz: str) -> Column:
    """UTC ``TIMESTAMP_NTZ`` -> local ``TIMESTAMP_NTZ`` in ``tz``."""
    return F.convert_timezone(F.lit("UTC"), F.lit(tz), col(ts))


def time_of_day(ts: str | Column) -> Column:
    """``as_hms``: time of day text ``HH:mm:ss``."""
    return F.date_format(col(ts), "HH:mm:ss")


def safe_date(text: str | Column, year: int | Column) -> Column:
    """``ydm(str_c(year, '-', x))`` for calendar safe dates like ``15-Apr`` or ``15-4``.

    Unparseable text gives NULL.
    """
    y = year if isinstance(year, Column) else F.lit(int(year))
    s = F.concat(y.cast("string"), F.lit("-"), F.trim(col(text)))
    return F.coalesce(
        F.when(s.rlike(r"^\d{4}-\d{1,2}-[A-Za-z]{3}$"), F.try_to_date(s, "yyyy-d-MMM")),
        F.when(s.rlike(r"^\d{4}-\d{1,2}-\d{1,2}$"), F.try_to_date(s, "yyyy-d-M")),
    )


def short_date(d: str | Column) -> Column:
    """``strftime('%b %e')``: month abbreviation and space-padded day."""
    d = col(d)
    return F.concat(F.date_format(d, "MMM"), F.lit(" "), F.lpad(F.dayofmonth(d).cast("string"), 2, " "))


def row_sum(*cols: str | Column) -> Column:
    """Row-wise ``sum(..., na.rm=TRUE)`` across columns (all NULL -> 0)."""
    out = F.lit(0.0)
    for c in cols:
        out = out + F.coalesce(col(c).cast("double"), F.lit(0.0))
    return out
