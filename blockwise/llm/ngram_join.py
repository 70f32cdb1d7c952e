"""N-gram Jaccard self-join with an LSH forest.

Words shingles of five words; two documents are linked when the Jaccard
similarity of their shingle sets is at least ``percent`` / 100.

1. ``sketches``: each whole text gives a hash of its shingle set and a MinHash
   signature of ``trees`` times ``depth`` values. Texts with equal shingle sets
   are one class from here on (pre-aggregated map-side).
2. ``tries``: in each tree a class stands under its signature part, a path of
   ``depth`` values; a trie node is the key of a prefix.
3. The tries are walked from the full depth up. At each depth, classes that meet
   under one node and are not connected yet are candidates: the signatures prune
   them, whole shingle sets decide (module ``linking``), and verified links are
   closed to components. The prefix is shortened until a pair at the threshold
   meets in some tree with probability ``recall``; at that depth the components
   that still meet under a node are compared with each other. Similar texts are
   connected at full depth, so the short prefixes only cost what is left.
4. Links are counted inside the components of verified links, by an inverted index
   over the shingles. A component with more than ``cell`` classes is cut into
   pieces and every pair of pieces is a task, so no task holds more than twice
   ``cell`` texts. A task returns counts, never the pairs.

Defined results: a null text is empty; texts without words are one class of
equal texts; a text of fewer than five words has one shingle of all its words;
ASCII letters are folded to lower case; repeated rows are copies of each other;
rows that share an id but not the set each have the class of their own set;
``class_id`` is the smallest id of the connected class (null if all its rows have
a null id); an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blockwise.llm.common import by_value, fixed, let_go, skew_left_join
from blockwise.llm.components import components
from blockwise.llm.linking import common_members, crossing, degrees, hubs_of, sets_of, starred, text_key, verified
from blockwise.llm.shingles import mix64, shingle_hashes, utf8_blocks

by_value(__name__)

PERCENT = 80
TREES, DEPTH = 16, 8
RECALL = 0.98
#: Classes of a component that are compared in one piece.
CELL = 1_000
#: Standard deviations by which a signature may miss the threshold.
TOLERANCE = 5.0


def recall_at(prefix: int, trees: int = TREES, similarity: float = PERCENT / 100) -> float:
    """Probability that a pair of this similarity shares a prefix in some tree."""
    return 1 - (1 - similarity**prefix) ** trees


def prefix_length(trees: int = TREES, depth: int = DEPTH, similarity: float = PERCENT / 100, recall: float = RECALL) -> int:
    """Shorten the prefix from the full depth until the recall is reached."""
    length = depth
    while length > 1 and recall_at(length, trees, similarity) < recall:
        length -= 1
    return length


def signatures(keys: np.ndarray, begins: np.ndarray, size: int) -> np.ndarray:
    """MinHash values (texts x size, uint32) of shingle sets given by hashes and begins; without shingles all ones."""
    n = len(begins) - 1
    out = np.full((n, size), 0xFFFFFFFF, np.uint32)
    some = np.flatnonzero(np.diff(begins))
    if not len(some):
        return out
    at = begins[some]
    rng = np.random.Generator(np.random.PCG64(20240607))
    factors = rng.integers(0, 2**63, size, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    with np.errstate(over="ignore"):
        for k in range(size):
            x = keys * factors[k]
            x ^= x >> np.uint64(32)
            x *= factors[k]
            out[some, k] = np.minimum.reduceat((x >> np.uint64(32)).astype(np.uint32), at)
    return out


def _set_hashes(keys: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit hashes of each set (sums of mixed members)."""
    with np.errstate(over="ignore"):
        parts = [np.concatenate([[np.uint64(0)], np.cumsum(mix64(keys * np.uint64(f) + np.uint64(f)))]) for f in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)]
        return tuple((p[begins[1:]] - p[begins[:-1]]).view(np.int64) for p in parts)


def sketches(docs: DataFrame, trees: int = TREES, depth: int = DEPTH) -> DataFrame:
    """``doc_id, text_key, set_hash, shingles, sketch`` of each row of ``doc_id, text`` (texts not null)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()  # an earlier stage's stores
        for batch in batches:
            for a, b, data, offsets in utf8_blocks(batch.column(2)):
                keys, begins = shingle_hashes(data, offsets)
                h1, h2 = _set_hashes(keys, begins)
                packed = np.stack([h1, h2], axis=1).tobytes()
                sig = np.ascontiguousarray(signatures(keys, begins, trees * depth)).tobytes()
                w = 4 * trees * depth
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(a, b - a),
                        batch.column(1).slice(a, b - a),
                        pa.array([packed[16 * i : 16 * i + 16] for i in range(b - a)], pa.binary()),
                        pa.array(np.diff(begins).astype(np.int64)),
                        pa.array([sig[w * i : w * i + w] for i in range(b - a)], pa.binary()),
                    ],
                    names=["doc_id", "text_key", "set_hash", "shingles", "sketch"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", text_key().alias("text_key"), "text").mapInArrow(run, f"doc_id {kind}, text_key binary, set_hash binary, shingles long, sketch binary")


def tries(classes: DataFrame, shortest: int, trees: int = TREES, depth: int = DEPTH) -> DataFrame:
    """``node, k<shortest> .. k<depth>``: for each class and tree the keys of its prefixes."""
    lengths = range(shortest, depth + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint32).reshape(-1, trees, depth).astype(np.uint64)
            key = np.broadcast_to(np.arange(1, trees + 1, dtype=np.uint64), rows.shape[:2])
            keys = []
            with np.errstate(over="ignore"):
                for k in range(depth):
                    key = mix64(key * np.uint64(0x9E3779B97F4A7C15) + rows[:, :, k])
                    keys.append(key)
            node = batch.column(0).take(pa.array(np.repeat(np.arange(len(rows)), trees)))
            yield pa.RecordBatch.from_arrays([node, *[pa.array(keys[k - 1].view(np.int64).ravel()) for k in lengths]], names=["node", *[f"k{k}" for k in lengths]])

    return classes.select("node", "sketch").mapInArrow(run, "node long, " + ", ".join(f"k{k} long" for k in lengths))


def likely(n: np.ndarray, m: np.ndarray, r: np.ndarray, s: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """Whether pairs of sizes ``n, m`` with signatures ``r, s`` may reach the threshold; leading axes broadcast."""
    t = percent / 100
    near = (r == s).mean(axis=-1) >= t - TOLERANCE * math.sqrt(t * (1 - t) / r.shape[-1])
    return near & (100 * np.minimum(n, m) >= percent * np.maximum(n, m))


def _count(percent: int):
    def run(g: pd.DataFrame) -> pd.DataFrame:
        sets = [np.frombuffer(x, np.uint64) for x in g["set"]]
        size, copies, links = np.array([len(x) for x in sets]), g["copies"].to_numpy(), np.zeros(len(g), np.int64)
        mine = (g["piece"] == g["ci"]).to_numpy()
        within = g["ci"].iloc[0] == g["cj"].iloc[0]
        one, two = np.flatnonzero(mine), np.arange(len(g)) if within else np.flatnonzero(~mine)
        for begin, common in common_members([sets[i] for i in one], [sets[i] for i in two]):
            rows = two[begin : begin + len(common)]
            ok = (100 * common >= percent * (size[rows][:, None] + size[one][None, :] - common)) & (rows[:, None] != one[None, :])
            links[rows] += ok @ copies[one]
            if not within:
                links[one] += copies[rows] @ ok
        return pd.DataFrame({"node": g["node"].to_numpy(), "links": links})

    return run


def _cells(linked: DataFrame, cell: int) -> DataFrame:
    """Each class of a component with the cells (pairs of pieces of its component) in which it is compared."""
    sizes = linked.groupBy("root").agg(F.count(F.lit(1)).alias("n"))
    pieces = sizes.select("root", F.ceil(F.col("n") / F.lit(cell)).cast("int").alias("pieces"))
    placed = skew_left_join(linked, pieces, "root").withColumn("piece", F.pmod(F.xxhash64("node"), F.col("pieces")).cast("int"))
    pairs = F.transform(
        F.sequence(F.lit(0), F.col("pieces") - 1),
        lambda k: F.struct(F.least(k, F.col("piece")).alias("ci"), F.greatest(k, F.col("piece")).alias("cj")),
    )
    return placed.select("root", "node", "piece", F.explode(pairs).alias("c")).select("root", "node", "piece", "c.ci", "c.cj")


def _linked_rows(docs: DataFrame, percent: int, trees: int, depth: int, recall: float, cell: int) -> DataFrame:
    """``doc_id, text_key, class_id, n_links, copies, keeper`` of each row of ``doc_id, text``.

    ``keeper`` (null id?, id, text key) is the first of its component; rows with it stay when near copies go.
    """
    drawn = fixed(sketches(docs, trees, depth), "sketches")
    row = F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "text_key")
    classes = drawn.groupBy("set_hash").agg(
        F.min(row).alias("first"), F.min("doc_id").alias("low"), F.count(F.lit(1)).alias("copies"), F.first("shingles").alias("shingles"), F.first("sketch").alias("sketch")
    )
    classes = fixed(classes.select(F.monotonically_increasing_id().alias("node"), F.col("first.text_key").alias("text_key"), "*"), "set-classes")
    shortest, may = prefix_length(trees, depth, percent / 100, recall), partial(likely, percent=percent)
    trie = fixed(tries(classes.where("shingles > 0"), shortest, trees, depth), "tries")
    meeting = trie.select(F.col(f"k{shortest}").alias("key"), "node")
    degree = degrees(meeting)
    sets = sets_of(degree.select("node"), classes, docs)
    roots = None
    for length in range(depth, shortest - 1, -1):
        under = trie.select(F.col(f"k{length}").alias("key"), "node")
        hubs = hubs_of(under, degree)
        roots = components(verified(fixed(starred(under, hubs, classes, may, "uint32", roots), "pairs"), sets, percent), roots)
    roots = components(crossing(under, hubs, lambda nodes: sets, roots, percent, cell), roots)

    cells = _cells(roots, cell).join(classes.select("node", "copies"), "node")
    filled = fixed(cells, "cells").join(sets, "node")
    counted = filled.groupBy("root", "ci", "cj").applyInPandas(_count(percent), "node long, links long").groupBy("node").agg(F.sum("links").alias("links"))
    rooted = classes.drop("sketch", "text_key").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    firsts = rooted.groupBy("root").agg(F.min("first").alias("keeper"), F.min("low").alias("class_id"))
    of_class = skew_left_join(fixed(rooted.join(counted, "node", "left"), "class-links"), firsts, "root")
    of_class = of_class.select("set_hash", "class_id", "keeper", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "copies")
    return skew_left_join(drawn.select("doc_id", "text_key", "set_hash"), fixed(of_class, "set-links"), "set_hash")


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT, trees: int = TREES, depth: int = DEPTH, recall: float = RECALL, cell: int = CELL) -> DataFrame:
    """``doc_id, class_id, n_links, copies`` of each document.

    ``n_links``: documents whose shingle set has at least the threshold similarity with this one's (copies too);
    ``copies``: documents with the same shingle set, itself included.
    """
    rows = _linked_rows(_texts(docs, id_col, text_col), percent, trees, depth, recall, cell)
    return rows.select(F.col("doc_id").alias(id_col), "class_id", "n_links", "copies")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT, trees: int = TREES, depth: int = DEPTH, recall: float = RECALL, cell: int = CELL) -> DataFrame:
    """One row of ``docs`` for each class, with all columns: the one with the smallest id (null last), then text key.

    A row goes by its id and text together, so another text under the same id stays; rows that repeat the one
    that stays all stay (exact dedup settles those).
    """
    rows = _linked_rows(_texts(docs, id_col, text_col), percent, trees, depth, recall, cell)
    stays = F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "text_key").eqNullSafe(F.col("keeper"))
    gone = rows.where(~stays).select(F.col("doc_id").alias("_gone_id"), F.col("text_key").alias("_gone_key")).distinct()
    key = F.unhex(F.md5(F.coalesce(docs[text_col], F.lit("")).cast("binary")))
    return docs.join(gone, docs[id_col].eqNullSafe(gone["_gone_id"]) & (key == gone["_gone_key"]), "left_anti")
