"""Literal lookup tables of fixed, tiny size (always safe to broadcast)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from blockwise.functions.semantics import MONTH_ABB

# Breeding category code, description and rank (0-4).
BREEDING_LOOKUP = [
    ("0", "Not Observed", 0),
    ("C1", "Observed", 1),
    ("C2", "Possible", 2),
    ("C3", "Probable", 3),
    ("C4", "Confirmed", 4),
]
CODED_CLASSES = ["Observed", "Possible", "Probable", "Confirmed"]

# Overlapping seasons and their months.
SEASON_MONTHS = {
    "All seasons": MONTH_ABB,
    "Breeding": ["Apr", "May", "Jun", "Jul", "Aug"],
    "Winter": ["Dec", "Jan", "Feb"],
}
BREEDING = "Breeding"
ALL_SEASONS = "All seasons"

# Old -> new common names after the taxonomy update.
TAXONOMY_RENAMES = {
    "Yellow Warbler": "Northern Yellow Warbler",
    "Warbling Vireo": "Eastern Warbling Vireo",
    "Barn Owl": "American Barn Owl",
    "Herring Gull": "American Herring Gull",
    "Northern Goshawk": "American Goshawk",
    "House Wren": "Northern House Wren",
    "Western Cattle Egret": "Western Cattle-Egret",
}

# Calendar season codes.
CALENDAR_GLOSSARY = [
    ("B", "Breeding season only"),
    ("E", "Either migration or breeding"),
    ("M", "Migration"),
    ("N", "Non-breeding season"),
]


def breeding_lookup(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        BREEDING_LOOKUP, "breeding_category string, breeding_category_desc string, breeding_rank int"
    )


def seasons(spark: SparkSession) -> DataFrame:
    """(season, month, month_num): 12 + 5 + 3 = 20 rows, overlapping."""
    rows = [(s, m, MONTH_ABB.index(m) + 1) for s, ms in SEASON_MONTHS.items() for m in ms]
    return spark.createDataFrame(rows, "season string, month string, month_num int")


def season_filter(spark: SparkSession, season: str | None) -> DataFrame:
    s = seasons(spark)
    return s if season is None else s.where(F.col("season") == season)


def calendar_glossary(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(CALENDAR_GLOSSARY, "Season string, Description string")
