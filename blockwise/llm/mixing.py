"""Mixing sources to target weights by the cube method.

``source_targets`` shares the total size among the sources by weight, at most
``cap`` times a source's own size. Every document of a source then has the same
expected number of copies, target / source size: the whole part is taken, the
fraction is an inclusion probability. The flight phase moves these
probabilities along the null space of two constraints (number of documents,
number of words) in deterministic blocks of each source until at most two
fractions a block are left; their survivors meet in the next level, again in
blocks, until one block a source is left. The landing phase rounds the last
one or two fractions of a source so that the words come nearest to the target.

Random choices come from a hash of the row, so reruns agree whatever the
partitioning. Blocks keep a source with a third of all rows in many tasks.

Defined results: a null text has size 0; a null source is a source of its own,
last in order; repeated rows are separate documents; sources without words have
target 0 and their documents are not taken; an empty table gives no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from blockwise.llm.common import WORD, by_value, fixed, text_or_empty

by_value(__name__)

#: Documents of a flight block: the size of a task's group, whatever the source's size.
BLOCK = 2_000
#: Largest table of sources that is broadcast; beyond it the targets are joined by a shuffle.
BROADCAST_SOURCES = 50_000
EPS = 1e-9


def word_count(text_col: str = "text") -> Column:
    return F.regexp_count(text_or_empty(text_col), F.lit(WORD)).cast("long")


def source_targets(sizes: list[tuple[str | None, int]], cap: float = 3.0, weights: tuple[int, ...] = (1, 2, 3)) -> dict[str | None, float]:
    """Target size of each source; ``sizes`` has one row a source."""
    names = sorted((s for s, _ in sizes if s is not None)) + [None] * any(s is None for s, _ in sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    size, total = dict(sizes), sum(n for _, n in sizes)
    target: dict[str | None, float] = {}
    free = list(names)
    while free:
        left, share = total - sum(target.values()), sum(weight[s] for s in free)
        over = [s for s in free if left * weight[s] / share > cap * size[s]]
        if not over:
            target |= {s: left * weight[s] / share for s in free}
            break
        target |= {s: float(cap * size[s]) for s in over}
        free = [s for s in free if s not in target]
    return target


def flight(prob: np.ndarray, size: np.ndarray, rnd: np.ndarray) -> np.ndarray:
    """Move ``prob`` with its sum and its product with ``size`` fixed until at most two fractions are left."""
    p, x = prob.tolist(), size.tolist()
    u = rnd.tolist()
    live: list[int] = []
    n, nxt, draw = len(p), 0, 0
    while True:
        while len(live) < 3 and nxt < n:
            if EPS < p[nxt] < 1 - EPS:
                live.append(nxt)
            nxt += 1
        if len(live) < 2:
            break
        if len(live) == 2:
            a, b = live
            if x[a] != x[b]:
                break
            move = ((a, 1.0), (b, -1.0))
        else:
            a, b, c = live
            va, vb, vc = x[b] - x[c], x[c] - x[a], x[a] - x[b]
            move = ((a, va), (b, vb), (c, vc)) if va or vb or vc else ((a, 1.0), (b, -1.0))
        up = min(((1 - p[i]) / v if v > 0 else -p[i] / v) for i, v in move if v)
        down = min((p[i] / v if v > 0 else (p[i] - 1) / v) for i, v in move if v)
        step = up if u[draw % n] * (up + down) < down else -down
        draw += 1
        for i, v in move:
            p[i] = p[i] + step * v
            if p[i] < EPS:
                p[i] = 0.0
            elif p[i] > 1 - EPS:
                p[i] = 1.0
        live = [i for i in live if EPS < p[i] < 1 - EPS]
    return np.array(p, dtype=float)


def _ordered(g: pd.DataFrame) -> pd.DataFrame:
    return g.sort_values(["h", "doc_id", "size"], kind="stable", ignore_index=True)


def _uniform(h: np.ndarray, seed: int) -> np.ndarray:
    z = h.astype(np.int64).view(np.uint64) + np.uint64(((seed * 2 + 1) * 0x9E3779B97F4A7C15) % 2**64)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return ((z ^ (z >> np.uint64(31))) >> np.uint64(11)).astype(float) / 2.0**53


def _fly(level: int):
    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = _ordered(g)
        g["p"] = flight(g["p"].to_numpy(float), g["size"].to_numpy(float), _uniform(g["h"].to_numpy(), level))
        return g

    return run


def _land(g: pd.DataFrame) -> pd.DataFrame:
    """Flight over the last block of a source, then the nearest rounding of what is left."""
    g = _ordered(g)
    p, x = flight(g["p"].to_numpy(float), g["size"].to_numpy(float), _uniform(g["h"].to_numpy(), 99)), g["size"].to_numpy(float)
    left = np.flatnonzero((p > EPS) & (p < 1 - EPS))
    want, docs = (p[left] * x[left]).sum(), p[left].sum()
    picks = [[(k >> i) & 1 for i in range(len(left))] for k in range(2 ** len(left))]
    if len(left):
        p[left] = min(picks, key=lambda t: (abs(np.dot(t, x[left]) - want), abs(sum(t) - docs), t))
    g["p"] = np.round(p)
    return g


def row_hash(docs: DataFrame) -> Column:
    """Hash of a whole row; only rows that are equal in every column share it."""
    return F.xxhash64(*[F.col(f"`{f.name}`") for f in docs.schema.fields if "map<" not in f.dataType.simpleString()])


def sized(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """``doc_id, source, size, h`` of each document, written once; all later steps read this."""
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        F.col(source_col).cast("string").alias("source"),
        word_count(text_col).alias("size"),
        row_hash(docs).alias("h"),
    )
    return fixed(rows, "mix-sizes")


def mix(units: DataFrame, cap: float = 3.0, weights: tuple[int, ...] = (1, 2, 3), block: int = BLOCK) -> DataFrame:
    """``doc_id, h, size, source_size, target, copies`` for the rows of ``sized``."""
    spark = units.sparkSession
    per_source = units.groupBy("source").agg(F.sum("size").alias("n"), F.count(F.lit(1)).alias("docs")).collect()
    target = source_targets([(r["source"], r["n"]) for r in per_source], cap, weights)
    plan = []
    for r in per_source:
        ratio = min(target[r["source"]] / r["n"], cap) if r["n"] else 0.0
        whole = int(math.floor(ratio + EPS))
        part = ratio - whole if ratio - whole > EPS else 0.0
        plan.append((r["source"], r["n"], target[r["source"]], whole, part, max(1, math.ceil(r["docs"] / block))))
    plan_df = spark.createDataFrame(plan, "_s string, source_size long, target double, whole int, p double, blocks int")
    if len(plan) <= BROADCAST_SOURCES:
        plan_df = F.broadcast(plan_df)
    rows = units.join(plan_df, F.col("source").eqNullSafe(F.col("_s")), "left").drop("_s")
    schema = "doc_id long, h long, size long, source string, source_size long, target double, whole int, p double, blocks int"
    names = [f.split()[0] for f in schema.split(", ")]
    rows = rows.select(*names)
    done, open_rows, most, level = [], rows, max([x[5] for x in plan], default=1), 0
    while most > 1:
        spread = open_rows.withColumn("_b", F.pmod(F.xxhash64("h", F.lit(level)), F.col("blocks")))
        flown = fixed(spread.groupBy("source", "_b").applyInPandas(_fly(level), schema + ", _b long").drop("_b"), f"mix-flight-{level}")
        fraction = (F.col("p") > EPS) & (F.col("p") < 1 - EPS)
        done.append(flown.where(~fraction))
        # at most two fractions a block go on
        open_rows = flown.where(fraction).withColumn("blocks", F.ceil(F.col("blocks") * 2 / F.lit(block)).cast("int"))
        most, level = math.ceil(most * 2 / block), level + 1
    out = open_rows.groupBy("source").applyInPandas(_land, schema)
    for d in done:
        out = out.unionByName(d)
    return out.select("doc_id", "h", "size", "source_size", "target", (F.col("whole") + F.round("p")).cast("long").alias("copies"))


def mix_documents(docs: DataFrame, cap: float = 3.0, weights: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """The mixed rows of ``docs`` with all their columns; a document taken n times is there n times."""
    taken = mix(sized(docs), cap, weights).groupBy("doc_id", "h").agg(F.sum("copies").alias("_copies"), F.count(F.lit(1)).alias("_rows"))
    taken = fixed(taken.where("_copies > 0"), "mix-copies")
    mine = taken.select(F.col("doc_id").alias("_id"), F.col("h").alias("_m"), "_copies")
    keyed = docs.withColumn("_h", row_hash(docs))
    if not taken.where("_rows > 1").isEmpty():  # equal rows share their copies
        keyed = keyed.dropDuplicates(["doc_id", "_h"])
    joined = keyed.join(mine, keyed["doc_id"].eqNullSafe(mine["_id"]) & (keyed["_h"] == mine["_m"]))
    return joined.select(*docs.columns, F.explode(F.array_repeat(F.lit(0), F.col("_copies").cast("int"))).alias("_n")).drop("_n")
