"""Near-duplicate components by HyperMinHash.

Documents are linked when the Jaccard similarity of their sets of word shingles is at least ``PERCENT`` / 100.

1. ``sketches``: a shingle's hash names one of 128 buckets; a bucket keeps the smallest hash in compressed form, the
   count of its leading zeros (6 bits) and the 10 bits after its first one (mantissa): a register of 16 bits.
   Documents with equal sets are one class from here on (pre-aggregated map-side).
2. ``bands``: 25 bands of 5 registers. An empty bucket borrows the register of the first filled one in an order of its
   own, so short texts band like long ones. A pair at the threshold shares a band with probability ``1 - 4e-7``.
3. Classes that share a band are candidates. ``likely`` prunes a pair by its sizes (without loss) and by the estimate
   ``(matches - expected accidental matches) / filled buckets``, with five standard deviations of tolerance.
4. The module ``linking`` verifies candidates on full shingle sets, each class with the hub of each of its bands first, then across the components that a band still holds.

Defined results: a null text is empty; an empty set is linked with nothing; a text of fewer than five words has one
shingle of all its words; only ASCII letters are folded; repeated rows and rows with equal sets are in one component;
rows that share an id but not the set each have the component of their own set; a row without an id takes no part (null
component, kept); an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blockwise.llm.common import by_value, fixed, let_go, skew_left_join
from blockwise.llm.components import components
from blockwise.llm.linking import CELL, PIECE, crossing, degrees, hubs_of, nodes_of, sets_of, starred, text_key, verified
from blockwise.llm.shingles import mix64, shingle_hashes, utf8_blocks

by_value(__name__)

PERCENT = 85
BUCKET_BITS, MANTISSA_BITS = 7, 10
BUCKETS = 1 << BUCKET_BITS
BANDS, ROWS = 25, 5
EMPTY = 0xFFFF
#: Standard deviations by which an estimate may miss the threshold.
TOLERANCE = 5.0


def registers(keys: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Registers (texts x buckets, uint16) of the sorted shingle hashes of each text."""
    n = len(begins) - 1
    out = np.full((n, BUCKETS), EMPTY, np.uint16)
    owner = np.repeat(np.arange(n), np.diff(begins))
    bucket = (keys >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)
    first = np.ones(len(keys), bool)
    first[1:] = (bucket[1:] != bucket[:-1]) | (owner[1:] != owner[:-1])
    owner, bucket, rest = owner[first], bucket[first], keys[first] << np.uint64(BUCKET_BITS)
    zeros = np.zeros(len(rest), np.uint16)
    for step in (32, 16, 8, 4, 2, 1):
        small = rest < (np.uint64(1) << np.uint64(64 - step))
        zeros[small] += step
        rest = np.where(small, rest << np.uint64(step), rest)
    mantissa = ((rest << np.uint64(1)) >> np.uint64(64 - MANTISSA_BITS)).astype(np.uint16)
    out[owner, bucket] = np.minimum(zeros, 62) << MANTISSA_BITS | mantissa
    return out


@lru_cache(maxsize=1)
def _donors() -> np.ndarray:
    """For each bucket the rank of every other bucket as its donor."""
    rng = np.random.Generator(np.random.PCG64(20250611))
    return np.stack([rng.permutation(BUCKETS) for _ in range(BUCKETS)])


def filled(regs: np.ndarray) -> np.ndarray:
    """Registers with borrowed ones in place of empty ones; a text without shingles stays empty."""
    out = regs.copy()
    ranks = _donors()
    empty = regs == EMPTY
    for i in np.flatnonzero(empty.any(axis=1) & ~empty.all(axis=1)):
        holes, whole = np.flatnonzero(empty[i]), np.flatnonzero(~empty[i])
        out[i, holes] = regs[i, whole[ranks[np.ix_(holes, whole)].argmin(axis=1)]]
    return out


def band_keys(regs: np.ndarray) -> np.ndarray:
    """A 64-bit key for each text and band."""
    parts = filled(regs)[:, : BANDS * ROWS].reshape(len(regs), BANDS, ROWS).astype(np.uint64)
    key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), (len(regs), BANDS))
    with np.errstate(over="ignore"):
        for k in range(ROWS):
            key = mix64(key * np.uint64(0x9E3779B97F4A7C15) + parts[:, :, k])
    return key.view(np.int64)


@lru_cache(maxsize=None)
def _accidental(a: int, b: int) -> float:
    """Expected matching registers of two sets of 2**a and 2**b shingles without a common one."""
    i, j = np.arange(1, 48)[:, None], np.arange(1 << MANTISSA_BITS)[None, :]
    unit = 2.0 ** -(i + BUCKET_BITS + MANTISSA_BITS)
    low, high = ((1 << MANTISSA_BITS) + j) * unit, ((1 << MANTISSA_BITS) + j + 1) * unit
    falls = [np.exp(2.0**n * np.log1p(-low)) - np.exp(2.0**n * np.log1p(-high)) for n in (a, b)]
    return float(BUCKETS * (falls[0] * falls[1]).sum())


def accidental(n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Expected accidental matches, at the sizes' nearest powers of two."""
    a, b = (np.rint(np.log2(np.maximum(x, 1))).astype(int) for x in np.broadcast_arrays(n, m))
    code = np.minimum(a, b) * 64 + np.maximum(a, b)
    found, back = np.unique(code, return_inverse=True)
    return np.array([_accidental(int(c) // 64, int(c) % 64) for c in found])[back].reshape(code.shape)


def likely(n: np.ndarray, m: np.ndarray, r: np.ndarray, s: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """Whether pairs of sizes ``n, m`` with registers ``r, s`` may reach the threshold; leading axes broadcast."""
    some = (r != EMPTY) | (s != EMPTY)
    used = np.maximum(some.sum(axis=-1), 1)
    matches = ((r == s) & some).sum(axis=-1)
    t = percent / 100
    estimate = (matches - accidental(n, m)) / used
    near = estimate >= t - TOLERANCE * np.sqrt(t * (1 - t) / used)
    return near & (100 * np.minimum(n, m) >= percent * np.maximum(n, m))


def sketches(docs: DataFrame) -> DataFrame:
    """``doc_id, text_key, set_hash, shingles, sketch`` (the registers) of each row of ``doc_id, text`` (texts not null)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()  # an earlier stage's stores
        for batch in batches:
            for a, b, data, offsets in utf8_blocks(batch.column(2)):
                keys, begins = shingle_hashes(data, offsets)
                regs = registers(keys, begins)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(a, b - a),
                        batch.column(1).slice(a, b - a),
                        pa.array(set_hashes(keys, begins), pa.binary()),
                        pa.array(np.diff(begins).astype(np.int64)),
                        pa.array([r.tobytes() for r in regs], pa.binary()),
                    ],
                    names=["doc_id", "text_key", "set_hash", "shingles", "sketch"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", text_key().alias("text_key"), "text").mapInArrow(run, f"doc_id {kind}, text_key binary, set_hash binary, shingles long, sketch binary")


def set_hashes(keys: np.ndarray, begins: np.ndarray) -> list[bytes]:
    """128 bits of each set: sums of differently mixed members."""
    with np.errstate(over="ignore"):
        sums = [np.concatenate([[np.uint64(0)], np.cumsum(mix64(keys ^ np.uint64(f)), dtype=np.uint64)]) for f in (0x8EBC6AF09C88C6E3, 0x589965CC75374CC3)]
        halves = np.stack([s[begins[1:]] - s[begins[:-1]] for s in sums], axis=1)
    return [h.tobytes() for h in halves]


def bands(classes: DataFrame) -> DataFrame:
    """``key, node``: the band keys of each class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                keys = band_keys(np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint16).reshape(-1, BUCKETS))
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), batch.column(0).take(pa.array(np.repeat(np.arange(len(keys)), BANDS)))], names=["key", "node"])

    return classes.select("node", "sketch").mapInArrow(run, "key long, node long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT, cell: int = CELL, piece: int = PIECE) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` of each row; ``component_id`` is the smallest id that links reach."""
    docs = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    drawn = fixed(sketches(docs), "hmh-sketches")
    known = drawn.where("doc_id is not null and shingles > 0")
    classes = known.groupBy("set_hash").agg(F.min(F.struct("doc_id", "text_key")).alias("rep"), F.first("shingles").alias("shingles"), F.first("sketch").alias("sketch"))
    classes = fixed(classes.select(F.monotonically_increasing_id().alias("node"), "set_hash", "rep.*", "shingles", "sketch"), "hmh-classes")
    banded = fixed(bands(classes), "hmh-bands")
    hubs, may = hubs_of(banded, degrees(banded)), partial(likely, percent=percent)
    near = fixed(starred(banded, hubs, classes, may, "uint16"), "pairs")
    links = verified(near, sets_of(nodes_of(near), classes, docs), percent, piece)
    linked = components(links)
    linked = components(crossing(banded, hubs, lambda nodes: sets_of(nodes, classes, docs), linked, percent, cell), linked)
    roots = classes.join(linked, "node", "left").select("set_hash", "doc_id", F.coalesce("root", "node").alias("root"))
    smallest = roots.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    component = fixed(skew_left_join(fixed(roots, "hmh-roots"), smallest, "root").select("set_hash", "component_id"), "hmh-components")
    out = skew_left_join(drawn.select("doc_id", "shingles", "set_hash"), component, "set_hash")
    found = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return out.select(F.col("doc_id").alias(id_col), F.col("shingles").alias("n_shingles"), found.alias("component_id"), F.coalesce(found == F.col("doc_id"), F.lit(True)).alias("kept"))
