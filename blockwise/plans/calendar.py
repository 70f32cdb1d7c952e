"""Breeding calendar: build (C3) and view (C4).

The wide week table is kept long inside (species, week_index, week, code);
it is pivoted back to wide only for the view, with the fixed week list.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blockwise.functions.semantics import MONTH_ABB, remove_first, safe_date
from blockwise.operators.reshape import pivot_wider

# Fixed value: the 48 calendar week columns, four per month, in calendar order.
WEEKS = [f"{m} {i}" for m in MONTH_ABB for i in range(1, 5)]
SAFE_COLS = ["safe_date_probable_start", "safe_date_possible_start", "safe_date_possible_end", "safe_date_probable_end"]


def calendar_build(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """-> (calendar, safe_dates). Priority flag from ``*`` in the name; first ``*`` removed (T18)."""
    b = raw.withColumns(
        {
            "priority_species": F.col("common_name").contains("*"),
            "common_name": remove_first("common_name", r"\*"),
        }
    )
    safe = b.select("taxonomic_order", "common_name", *SAFE_COLS).distinct()
    cal = b.select("taxonomic_order", "common_name", "priority_species", *WEEKS).na.fill("", subset=WEEKS)
    return cal, safe


def safe_dates_view(safe: DataFrame, year: int) -> DataFrame:
    """Safe dates as dates of ``year`` (explicit, T23), ``safe_`` dropped from names, by probable start."""
    out = safe.select(
        "common_name",
        *[safe_date(c, year).alias(c.replace("safe_", "", 1)) for c in
          ["safe_date_probable_start", "safe_date_probable_end", "safe_date_possible_start", "safe_date_possible_end"]],
    )
    return out.orderBy(F.col("date_probable_start").asc_nulls_last())


def _weeks(cal: DataFrame) -> list[str]:
    """The week columns of a calendar, in the order in which it has them."""
    return [c for c in cal.columns if c not in ("taxonomic_order", "common_name", "priority_species")]


def calendar_long(cal: DataFrame) -> DataFrame:
    """(common_name, priority_species, week_index, week, breeding_calendar_code).

    The index numbers a species' weeks in the order in which the calendar has
    them (``row_number()`` per species in input order): a place in the row, no window.
    """
    cells = F.array(*[F.struct(F.lit(w).alias("week"), F.col(f"`{w}`").alias("breeding_calendar_code")) for w in _weeks(cal)])
    long = cal.select("common_name", "priority_species", F.posexplode(cells).alias("place", "cell"))
    return long.select("common_name", "priority_species", "cell.week", "cell.breeding_calendar_code", (F.col("place") + 1).alias("week_index"))


def calendar_view(cal: DataFrame, start_month: str | None, exclude_blank: bool, show_priority: bool) -> DataFrame:
    """Weeks from ``start_month`` on, wide; optionally drop species blank in the first shown week (T14)."""
    long = calendar_long(cal)
    weeks = _weeks(cal)
    if start_month is not None:
        first = weeks.index(f"{start_month} 1") + 1
        long = long.where(F.col("week_index") >= first)
        weeks = weeks[first - 1 :]
    ids = ["common_name", "priority_species"] if show_priority else ["common_name"]
    wide = pivot_wider(long, ids, "week", "breeding_calendar_code", weeks)
    wide = wide.select(*ids, *weeks)
    if exclude_blank:
        wide = wide.where(F.col(weeks[0]) != "")
    return wide
