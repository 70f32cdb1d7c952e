"""Links between classes of texts that share a key: every link is verified, none is lost, no pairs are formed in vain.

Near-duplicate operators differ in their sketches and keys; from there on the work is the same. ``classes`` has a row for
each different set of shingles: ``node`` (a number), ``text_key`` (128 bits of one of its texts), ``shingles`` (size of the
set) and ``sketch`` (values as bytes). ``banded`` has ``key, node``: classes with a common key are candidates. ``sets`` has
the full sets (``node, set``: sorted shingle hashes as bytes) of the classes that are compared.

1. ``starred``: every class with the hub of each of its keys, the class that meets the most others. ``likely`` prunes by
   sizes and sketches, ``verified`` compares the full sets: a hub's candidates stream past the hub.
2. ``crossing``: where a key still holds several components of verified links, the members outside the hub's component are
   compared with all others, by an inverted index over shingles in cells of bounded size. A cell returns links that connect
   what it has found, not the pairs. Pairs inside a component are left out: they would change no component.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blockwise.llm.common import by_value, fixed, perhaps_in, skew_left_join
from blockwise.llm.shingles import shingle_hashes, utf8_blocks

by_value(__name__)

#: Members of a key in a cell; candidates of a hub that one task compares.
CELL, PIECE = 1_000, 200

#: ``likely(n, m, r, s)``: may sets of sizes n, m with sketches r, s (last axis) be linked? Leading axes broadcast.
Likely = Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray], np.ndarray]


def text_key(text_col: str = "text"):
    return F.unhex(F.md5(F.col(text_col).cast("binary")))


def degrees(banded: DataFrame) -> DataFrame:
    """``node, degree``: members of all keys of a class, counted by key."""
    sizes = banded.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return fixed(banded.join(sizes, "key").groupBy("node").agg(F.sum("n").alias("degree")), "degrees")


def hubs_of(banded: DataFrame, degree: DataFrame) -> DataFrame:
    """``key, hub``: the class of the highest degree (then the smallest) of each key that several classes have.

    Copies of a text that were edited apart may each be similar to it, but not to one another: it meets more of
    them under more keys than they do among themselves, so it becomes the hub and connects them all.
    """
    ranked = banded.join(degree, "node").groupBy("key").agg(F.max(F.struct("degree", (-F.col("node")).alias("n"))).alias("top"), F.count(F.lit(1)).alias("members"))
    return fixed(ranked.where("members > 1").select("key", (-F.col("top.n")).alias("hub")), "hubs")


def _rooted(roots: DataFrame, c: str) -> DataFrame:
    return roots.select(F.col("node").alias(c), F.col("root").alias(f"root_{c}"))


def starred(banded: DataFrame, hubs: DataFrame, classes: DataFrame, likely: Likely, kind: str, roots: DataFrame | None = None) -> DataFrame:
    """Likely pairs ``a, b`` of a key's hub with the key's other members; with ``roots``, of different components only.

    ``kind`` is the numpy type of the sketches' values.
    """

    @F.pandas_udf("boolean")
    def may(n: pd.Series, m: pd.Series, r: pd.Series, s: pd.Series) -> pd.Series:
        if not len(n):
            return pd.Series([], dtype=bool)
        r, s = (np.frombuffer(b"".join(x), kind).reshape(len(n), -1) for x in (r, s))
        return pd.Series(likely(n.to_numpy(np.int64), m.to_numpy(np.int64), r, s))

    pairs = banded.join(hubs, "key").where("node <> hub").select(F.col("hub").alias("a"), F.col("node").alias("b")).distinct()
    if roots is not None:
        pairs = pairs.join(_rooted(roots, "a"), "a", "left").join(_rooted(roots, "b"), "b", "left")
        pairs = pairs.where(F.coalesce("root_a", "a") != F.coalesce("root_b", "b")).select("a", "b")
    of = lambda c: classes.select(F.col("node").alias(c), F.col("shingles").alias(f"n_{c}"), F.col("sketch").alias(f"r_{c}"))
    return pairs.join(of("b"), "b").join(of("a"), "a").where(may("n_a", "n_b", "r_a", "r_b")).select("a", "b")


def nodes_of(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("node")).union(pairs.select("b"))


def sets_of(nodes: DataFrame, classes: DataFrame, docs: DataFrame) -> DataFrame:
    """``node, set`` of the classes in ``nodes`` (column ``node``), from ``docs`` (``text``, not null), as a stored table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in utf8_blocks(batch.column(1)):
                keys, begins = shingle_hashes(data, offsets)
                packed = pa.array([keys[x:y].tobytes() for x, y in zip(begins[:-1], begins[1:], strict=True)], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), packed], names=["node", "set"])

    wanted = fixed(nodes.distinct().join(classes.select("node", "text_key"), "node"), "wanted-classes")
    near = perhaps_in(docs.select("text", text_key().alias("text_key")), "text_key", wanted.select("text_key"))
    texts = near.join(wanted, "text_key").dropDuplicates(["node"]).select("node", "text")
    return fixed(texts.mapInArrow(run, "node long, set binary"), "class-sets")


def verified(pairs: DataFrame, sets: DataFrame, percent: int, piece: int = PIECE) -> DataFrame:
    """The pairs ``a, b`` (a stored table) of classes whose full sets reach the threshold."""
    pieces = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / F.lit(piece)).cast("int").alias("pieces"))
    dealt = fixed(skew_left_join(pairs, pieces, "a").select("a", F.pmod(F.xxhash64("b"), F.col("pieces")).cast("int").alias("piece"), "b"), "pairs-dealt")
    hubs = dealt.select("a", "piece").distinct().withColumn("b", F.lit(None).cast("long")).join(sets.withColumnRenamed("node", "a"), "a")
    members = dealt.join(sets.withColumnRenamed("node", "b"), "b")
    rows = hubs.select("a", "piece", "b", "set").unionByName(members.select("a", "piece", "b", "set"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hub = None
        for batch in batches:
            linked = []
            for a, b, packed in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                own = np.frombuffer(packed, np.uint64)
                if b is None:
                    hub = own
                    continue
                both = int((np.searchsorted(hub, own, side="right") - np.searchsorted(hub, own)).sum())
                if 100 * both >= percent * (len(hub) + len(own) - both):
                    linked.append((a, b))
            yield pa.RecordBatch.from_arrays([pa.array([p[i] for p in linked], pa.int64()) for i in (0, 1)], names=["a", "b"])

    order = ["a", "piece", F.asc_nulls_first("b")]
    by_hub = rows.repartition("a", "piece").sortWithinPartitions(*order).select("a", "b", "set")
    return fixed(by_hub.mapInArrow(run, "a long, b long"), "links-verified")


def common_members(index: list[np.ndarray], others: list[np.ndarray], most: int = 500_000) -> Iterator[tuple[int, np.ndarray]]:
    """(first of ``others``, how many members each of the following has in common with each set of ``index``).

    A matrix is as tall as ``most`` matching places allow, one row at least.
    """
    sizes = np.array([len(x) for x in index], np.int64)
    keys = np.concatenate(index) if index else np.zeros(0, np.uint64)
    owner = np.repeat(np.arange(len(index)), sizes)
    order = np.argsort(keys, kind="stable")
    keys, owner = keys[order], owner[order]
    at, n = 0, len(others)
    while at < n:
        lows, counts, rows, total = [], [], [], 0
        begin = at
        while at < n and (at == begin or (total + len(index) * len(others[at]) <= most)):
            low = np.searchsorted(keys, others[at])
            count = np.searchsorted(keys, others[at], side="right") - low
            lows.append(low[count > 0])
            counts.append(count[count > 0])
            rows.append(np.full(int(count.sum()), at - begin))
            total += len(rows[-1])
            at += 1
        low, count = np.concatenate(lows), np.concatenate(counts)
        place = np.repeat(low - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum()) if len(count) else np.zeros(0, np.int64)
        yield begin, np.bincount(np.concatenate(rows) * len(index) + owner[place], minlength=(at - begin) * len(index)).reshape(at - begin, len(index))


def smallest_reachable(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest index of each index's component."""
    low = np.arange(n)
    while len(a):
        new = low.copy()
        np.minimum.at(new, a, low[b])
        np.minimum.at(new, b, low[a])
        new = new[new]
        if (new == low).all():
            break
        low = new
    return low


def _cell_links(nodes: np.ndarray, roots: np.ndarray, minor: np.ndarray, sets: list[np.ndarray], percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect what is linked between the minors of a cell (``minor``) and its members, over different roots."""
    m, o = np.flatnonzero(minor), np.flatnonzero(~minor)
    size = np.array([len(x) for x in sets])
    a, b = [], []
    for begin, common in common_members([sets[i] for i in m], [sets[i] for i in o]):
        rows = o[begin : begin + len(common)]
        ok = 100 * common >= percent * (size[rows][:, None] + size[m][None, :] - common)
        x, y = np.nonzero(ok & (roots[rows][:, None] != roots[m][None, :]))
        a.append(rows[x])
        b.append(m[y])
    if not a or not sum(map(len, a)):
        return nodes[:0], nodes[:0]
    low = smallest_reachable(len(nodes), np.concatenate(a), np.concatenate(b))
    moved = np.flatnonzero(low != np.arange(len(nodes)))
    return nodes[moved], nodes[low[moved]]


def crossing(banded: DataFrame, hubs: DataFrame, sets: Callable[[DataFrame], DataFrame], roots: DataFrame, percent: int, cell: int = CELL) -> DataFrame:
    """Verified links ``a, b`` that connect components which share a key; hubs were compared with all members before.

    ``sets`` gives the full sets of the classes in a table of nodes. The members outside a hub's component
    (minors) are cut into pieces of about ``cell``, and all members likewise; each pair of pieces is a cell.
    """
    members = banded.join(hubs, "key").join(_rooted(roots, "node"), "node", "left").join(_rooted(roots, "hub"), "hub", "left")
    root, of_hub = F.coalesce("root_node", "node"), F.coalesce("root_hub", "hub")
    members = fixed(members.select("key", "node", root.alias("root"), (root != of_hub).alias("minor"), (F.col("node") == F.col("hub")).alias("is_hub")), "key-members")
    open_keys = members.groupBy("key").agg(F.count_if("minor").alias("minors"), F.count(F.lit(1)).alias("all")).where("minors > 0 and all > 2")
    sizes = open_keys.select("key", *[F.ceil(F.col(c) / F.lit(cell)).cast("int").alias(f"of_{c}") for c in ("minors", "all")])
    placed = fixed(members.where("not is_hub").join(sizes, "key"), "key-cells")
    placed = placed.join(sets(placed.select("node")), "node")
    at = lambda c: F.pmod(F.xxhash64("node"), F.col(c)).cast("int")
    cells = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    columns = ["node", "root", "set"]
    left = placed.where("minor").select("key", at("of_minors").alias("i"), cells("of_all").alias("j"), F.lit(0).alias("side"), *columns)
    right = placed.select("key", cells("of_minors").alias("i"), at("of_all").alias("j"), F.lit(1).alias("side"), *columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(rows):
            links = _cell_links(*(np.array(x) for x in list(zip(*rows, strict=True))[:3]), [r[3] for r in rows], percent)
            return pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in links], names=["a", "b"])

        here, rows = None, []
        for batch in batches:
            for key, i, j, side, node, root, packed in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if here != (key, i, j):
                    if rows:
                        yield out(rows)
                    here, rows = (key, i, j), []
                rows.append((node, root, side == 0, np.frombuffer(packed, np.uint64)))
        if rows:
            yield out(rows)

    order = ["key", "i", "j", "side"]
    return fixed(left.unionByName(right).repartition("key", "i", "j").sortWithinPartitions(*order).select(*order, *columns).mapInArrow(run, "a long, b long").distinct(), "links-crossing")
