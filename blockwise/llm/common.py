"""Shared helpers of the llm operators."""

from __future__ import annotations

import ctypes
import gc
import sys
from collections.abc import Callable, Iterator
from types import ModuleType

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white-space class [\x20\x09-\x0D]; ``bytes.split()`` splits on exactly these bytes.
WS_RUN = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def by_value(module: str) -> None:
    """Ship a module's functions to the executors inside the pickled task.

    Executors then need no copy of this package on their import path.
    """
    cloudpickle.register_pickle_by_value(sys.modules[module])


by_value(__name__)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(text_col: str = "text") -> Column:
    return F.coalesce(F.col(text_col), F.lit(""))


def fixed(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared checkpoint folder and read it back (computed once, lineage cut)."""
    from blockwise.session import materialize

    return materialize(df, tag)


def frequent_keys(df: DataFrame, key: str, share: float = 0.001) -> list:
    """Every value of ``key`` in more than ``share`` of the rows, and at most ``1 / share`` values in all.

    The counter sketch is merged map-side; it has no false negatives, and a
    false positive only means that a key is treated as hot without need. The
    result's size is bounded by ``share`` alone, so it may be broadcast. Binary keys are counted as text: the sketch
    would take each array of bytes for a value of its own and return a key as often as it occurs.
    """
    binary = df.schema[key].dataType.simpleString() == "binary"
    row = df.select((F.hex(key) if binary else F.col(key)).alias(key)).stat.freqItems([key], share).first()
    found = [] if row is None else list(dict.fromkeys(row[0]))
    return [None if k is None else bytearray.fromhex(k) for k in found] if binary else found


def skew_left_join(big: DataFrame, small: DataFrame, key: str, share: float = 0.001) -> DataFrame:
    """Left join on ``key`` (unique in ``small``) where one key may hold any share of ``big``.

    Rows of the at most ``1 / share`` frequent keys meet their partners by a
    broadcast of those few rows; the rest, with at most ``share`` of the rows
    for a key, by a plain shuffled join.
    """
    hot = frequent_keys(big, key, share)
    if not hot:
        return big.join(small, key, "left")
    keys = F.broadcast(big.sparkSession.createDataFrame([(k,) for k in hot if k is not None], big.select(key).schema))
    few = F.broadcast(small.join(keys, key, "left_semi"))
    flagged = big.join(keys.withColumn("_hot", F.lit(True)), key, "left")
    hot_rows = flagged.where("_hot").drop("_hot").join(few, key, "left")
    rest = flagged.where("_hot is null").drop("_hot").join(small, key, "left")
    return hot_rows.unionByName(rest)


def perhaps_in(df: DataFrame, key: str, ids: DataFrame, bits: int = 24) -> DataFrame:
    """The rows of ``df`` whose ``key`` may be in ``ids`` (one column): all that are, and few others.

    A bitmap of ``2 ** bits`` hash places, combined map-side and at most 2 MB at the default, goes to every
    task. It spares a shuffle the rows that cannot match; a join on the key must follow.
    """
    place = F.pmod(F.xxhash64(F.col(ids.columns[0])), F.lit(1 << bits))
    words = ids.select(place.alias("p")).groupBy(F.floor(F.col("p") / 64).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p % 64 as int))")).alias("b"))
    filled = np.zeros((1 << bits) // 64, np.int64)
    rows = words.toPandas()  # at most 2 ** bits / 64 rows
    filled[rows["w"].to_numpy(np.int64)] = rows["b"].to_numpy(np.int64)
    shared = df.sparkSession.sparkContext.broadcast(filled.view(np.uint64))

    @F.pandas_udf("boolean")
    def there(p: pd.Series) -> pd.Series:
        p = p.to_numpy(np.int64)
        return pd.Series((shared.value[p >> 6] >> (p & 63).astype(np.uint64)) & np.uint64(1) == 1)

    return df.where(there(F.pmod(F.xxhash64(F.col(key)), F.lit(1 << bits))))


def text_chunks(texts: list[str | None], max_chars: int = 2_000_000) -> Iterator[tuple[int, int]]:
    """Consecutive index ranges of ``texts`` with about ``max_chars`` characters each (one text at least)."""
    start, n = 0, 0
    for i, t in enumerate(texts):
        n += len(t or "")
        if n >= max_chars:
            yield start, i + 1
            start, n = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def kept_by_worker(key: tuple, make: Callable[[], object]):
    """What ``make`` returns, kept by a Python worker from task to task (functions shipped by value have no lasting globals).

    A worker keeps one object: asking for another key lets the one before go.
    """
    store = sys.modules.setdefault("_blockwise_kept", ModuleType("_blockwise_kept")).__dict__.setdefault("store", {})
    if key not in store:
        if store:
            let_go()
        store[key] = make()
    return store[key]


def let_go() -> None:
    """Frees what this worker keeps for another stage, and gives the memory back to the system, Arrow's too, where the C library can."""
    sys.modules.setdefault("_blockwise_kept", ModuleType("_blockwise_kept")).__dict__.setdefault("store", {}).clear()
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass  # not this C library


class Generations:
    """What was worked out for a key, kept while it is asked for: a full young generation becomes the old one."""

    def __init__(self, make: Callable[[str], object], size: int):
        self.make, self.size, self.young, self.old = make, size, {}, {}

    def __getitem__(self, key: str):
        value = self.young.get(key, self)
        if value is self:
            value = self.old.get(key, self)
            self.put(key, value := self.make(key) if value is self else value)
        return value

    def put(self, key: str, value) -> None:
        if len(self.young) >= self.size:
            self.old, self.young = self.young, {}
        self.young[key] = value
