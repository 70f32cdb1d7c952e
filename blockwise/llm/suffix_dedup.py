"""Removal of repeated byte strings by suffix sorting.

Every byte covered by a ``LENGTH``-byte string that also starts earlier (smaller
id, or earlier in the same text) is removed; strings are judged on the input.

1. ``anchors`` gives every string of a text its anchor, the 32-byte piece in it
   with the smallest hash. Equal strings have equal anchors, so only texts that
   meet in an anchor can share a string. Neighbouring strings with the same
   anchor form one chunk (up to 168 bytes). A task keeps the first of equal
   chunks only; the later ones are repeats already.
2. ``settle`` meets the chunks of an anchor: of equal chunks the first stays,
   and an anchor with several different chunks is contested.
3. ``two_stage_sort`` sorts the suffixes of contested chunks: suffixes smaller
   than their successors are sorted directly, the others are induced by one scan
   of the buckets in ascending order. Neighbours whose common prefix reaches
   ``LENGTH`` bytes are equal strings, and all but the earliest are repeats.
4. An anchor with more than ``HOT`` different chunks is split further: its
   strings are dealt out by their own hashes and settled like chunks.

Chunks travel as two independent 64-bit hashes; texts are shuffled only to read
contested chunks and to cut the repeats out.

Defined results: a null text is empty; matches never cross texts; a null id
comes before all others; of rows that share an id the one with the smaller text
comes first, so a repeated row is a repeat; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from blockwise.llm.common import by_value, fixed
from blockwise.llm.shingles import mix64, utf8_blocks

by_value(__name__)

LENGTH = 100
PIECE = 32
#: Bytes of a long text that are handled at a time, rows that a task holds before it combines them,
#: bytes of contested chunks that are sorted at a time, and chunks of an anchor that are sorted together.
BLOCK, COMBINE, SORT_BYTES, HOT = 1 << 20, 1_500_000, 1_000_000, 20_000
CHUNK, REPEAT, CONTEST, SPLIT = 0, 1, 2, 3
COLUMNS = ["kind", "k1", "k2", "doc", "sub", "start", "n"]
SCHEMA = "kind int, k1 long, k2 long, doc long, sub long, start long, n long"
FIRST_ID = -(2**63)


def _random_bytes_table(seed: int) -> np.ndarray:
    return np.random.Generator(np.random.PCG64(seed)).integers(0, 2**64, 256, dtype=np.uint64)


_T1, _T2 = _random_bytes_table(11), _random_bytes_table(12)


def _rolled(x: np.ndarray, width: int, seed: int) -> np.ndarray:
    """Hash of every ``width`` (a power of two) neighbouring values, by doubling."""
    w = 1
    while w < width:
        x = x[:-w] * np.uint64((0x9E3779B97F4A7C15 * (2 * w + seed) | 1) % 2**64) + x[w:]
        w *= 2
    return x


def _window_min(x: np.ndarray, width: int) -> np.ndarray:
    w = 1
    while 2 * w <= width:
        x = np.minimum(x[:-w], x[w:])
        w *= 2
    return np.minimum(x[: len(x) - (width - w)], x[width - w :]) if width > w else x


def chunks_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """(text, start, strings, anchor hash, chunk hash) of the chunks of several texts in one byte array."""
    none = np.zeros(0, np.int64)
    if len(data) < LENGTH:
        return none, none, none, none, none
    with np.errstate(over="ignore"):
        h = mix64(_rolled(_T1[data], PIECE, 1))
        low = np.uint64(2**24 - 1)
        key = _window_min((h & ~low) | np.arange(len(h), dtype=np.uint64), LENGTH - PIECE + 1)
        text = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[: len(key)]
        inside = np.flatnonzero(offsets[text + 1] - np.arange(len(key)) >= LENGTH)
        if not len(inside):
            return none, none, none, none, none
        anchor = (key[inside] & low).astype(np.int64)
        new = np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (inside[1:] != inside[:-1] + 1)])
        first = np.flatnonzero(new)
        start, n = inside[first], np.diff(np.concatenate([first, [len(inside)]]))
        y = _rolled(_T2[data], 64, 3)
        size = n + LENGTH - 1
        k2 = mix64(y[start] + mix64(y[start + (size - 64) // 2] + mix64(y[start + size - 64] + size.astype(np.uint64))))
        k1 = mix64(h[anchor[first]] ^ np.uint64(0x5851F42D4C957F2D))
    return text[start], start - offsets[text[start]], n, k1.view(np.int64), k2.view(np.int64)


def _batch(kind: int, k1, k2, doc, sub, start, n) -> pa.RecordBatch:
    size = len(doc)
    full = lambda x: x if x is not None else np.zeros(size, np.int64)
    cols = [pa.array(np.full(size, kind, np.int32)), *[pa.array(np.asarray(full(x), np.int64)) for x in (k1, k2, doc, sub, start, n)]]
    return pa.RecordBatch.from_arrays(cols, names=COLUMNS)


def merged(doc: np.ndarray, sub: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, ...]:
    """Maximal runs of the given byte ranges, per text."""
    if not len(doc):
        return doc, sub, start, end
    order = np.lexsort((end, start, sub, doc))
    doc, sub, start, end = doc[order], sub[order], start[order], end[order]
    text = np.concatenate([[0], np.cumsum((doc[1:] != doc[:-1]) | (sub[1:] != sub[:-1]))])
    # Ranges of later texts are shifted beyond all earlier ones, so one running maximum serves all texts.
    shift = text * (int(end.max()) + 2)
    reach = np.maximum.accumulate(end + shift)
    new = np.concatenate([[True], start[1:] + shift[1:] > reach[:-1]])
    first = np.flatnonzero(new)
    last = np.concatenate([first[1:], [len(doc)]]) - 1
    return doc[first], sub[first], start[first], reach[last] - shift[first]


def _repeats(doc, sub, start, n) -> pa.RecordBatch:
    """Rows of kind REPEAT; ``n`` is the end of the byte range there."""
    d, s, a, e = merged(doc, sub, start, start + n + LENGTH - 1)
    return _batch(REPEAT, None, None, d, s, a, e)


def combine(rows: list[np.ndarray], contested: bool) -> Iterator[pa.RecordBatch]:
    """Of equal chunks the first goes on, the others are repeats.

    ``contested``: the rows are all rows of their anchors, so firsts are settled unless their anchor has other chunks.
    """
    k1, k2, doc, sub, start, n = rows
    order = np.lexsort((start, sub, doc, k2, k1))
    k1, k2, doc, sub, start, n = (x[order] for x in rows)
    first = np.concatenate([[True], (k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1])]) if len(k1) else np.zeros(0, bool)
    later = ~first
    yield _repeats(doc[later], sub[later], start[later], n[later])
    at = np.flatnonzero(first)
    if not contested:
        yield _batch(CHUNK, *(x[at] for x in (k1, k2, doc, sub, start, n)))
        return
    _, group, size = np.unique(k1[at], return_inverse=True, return_counts=True)
    for kind, chosen in ((CONTEST, (size[group] > 1) & (size[group] <= HOT)), (SPLIT, size[group] > HOT)):
        if chosen.any():
            yield _batch(kind, *(x[at[chosen]] for x in (k1, k2, doc, sub, start, n)))


def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From ``doc, sub, text`` to the chunks of each text, equal ones combined per task."""
    held: list[tuple] = []
    rows = 0
    for batch in batches:
        doc, sub = (np.asarray(batch.column(i)) for i in (0, 1))
        for a, _, data, offsets in utf8_blocks(batch.column(2), BLOCK):
            for begin in range(0, max(1, len(data)), 8 * BLOCK):  # more than one turn only for one long text
                part = data[begin : begin + 8 * BLOCK + LENGTH - 1]
                bounds = offsets if len(part) == len(data) else np.array([0, len(part)])
                text, start, n, k1, k2 = chunks_of(part, bounds)
                held.append((k1, k2, doc[a + text], sub[a + text], start + begin, n))
                rows += len(n)
        if rows > COMBINE:
            yield from combine([np.concatenate(x) for x in zip(*held, strict=True)], False)
            held, rows = [], 0
    if rows:
        yield from combine([np.concatenate(x) for x in zip(*held, strict=True)], False)


def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All chunks of an anchor are in one partition; repeats pass through."""
    held = []
    for batch in batches:
        kind = np.asarray(batch.column(0))
        known = kind == REPEAT
        if known.any():
            yield batch.filter(pa.array(known))
        held.append([np.asarray(c)[~known] for c in batch.columns[1:]])
    if held:
        yield from combine([np.concatenate(x) for x in zip(*held, strict=True)], True)


# ------------------------------------------------------------ suffix sorting


def two_stage_sort(s: np.ndarray, depth: int = LENGTH + 4) -> np.ndarray:
    """Suffixes of the byte array ``s``, sorted by their first ``depth`` bytes at least."""
    n = len(s)
    step = np.sign(np.diff(s.astype(np.int16)))
    # Equal neighbours are ordered as the next unequal pair; the last suffix is larger than its (empty) successor.
    nxt = np.where(step != 0, np.arange(n - 1), n - 1)
    nxt = np.minimum.accumulate(nxt[::-1])[::-1] if n > 1 else nxt
    smaller = np.zeros(n, bool)
    smaller[:-1] = np.concatenate([step, [-1]])[nxt] > 0
    direct = np.flatnonzero(smaller)
    padded = np.concatenate([s, np.zeros(depth, np.uint8)])
    strings = np.lib.stride_tricks.sliding_window_view(padded, depth)[direct]
    direct = direct[np.argsort(np.ascontiguousarray(strings).view(f"S{depth}").ravel(), kind="stable")]
    bounds = np.searchsorted(s[direct], np.arange(257))
    induced: list[list[np.ndarray]] = [[] for _ in range(256)]
    induced[s[-1]].append(np.array([n - 1]))
    out = []
    for c in range(256):
        level = np.concatenate(induced[c]) if induced[c] else np.zeros(0, np.int64)
        bucket = [level]
        while len(level):
            before = level[level > 0] - 1
            level = before[s[before] == c]
            bucket.append(level)
        bucket = np.concatenate([*bucket, direct[bounds[c] : bounds[c + 1]]])
        if not len(bucket):
            continue
        out.append(bucket)
        before = bucket[bucket > 0] - 1
        before = before[s[before] > c]
        chars = s[before]
        before = before[np.argsort(chars, kind="stable")]
        chars = np.sort(chars)
        for v in np.unique(chars):
            lo, hi = np.searchsorted(chars, [v, v + 1]) if v < 255 else (np.searchsorted(chars, v), len(chars))
            induced[v].append(before[lo:hi])
    return np.concatenate(out)


def equal_strings(chunks: list[bytes], n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(chunk, offset, class) of the first ``n[i]`` strings of each chunk, by class."""
    sizes = np.array([len(c) for c in chunks])
    begins = np.concatenate([[0], np.cumsum(sizes + 1)])
    # A text byte plus one is never 0 (UTF-8 has no byte 255), so 0 can end a chunk.
    s = np.frombuffer(b"\xff".join(chunks) + b"\xff", np.uint8) + np.uint8(1)
    starts = np.zeros(len(s), bool)
    of = np.repeat(np.arange(len(chunks)), n)
    offset = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
    starts[begins[of] + offset] = True
    order = two_stage_sort(s)
    order = order[starts[order]]
    words = np.lib.stride_tricks.sliding_window_view(s, 8)
    words = np.ascontiguousarray(words).view(np.uint64).ravel()
    a, b = order[:-1], order[1:]
    same = np.ones(len(a), bool)
    for k in [*range(0, LENGTH - 8, 8), LENGTH - 8]:
        same &= words[a + k] == words[b + k]
    klass = np.concatenate([[0], np.cumsum(~same)])
    chunk = np.searchsorted(begins, order, side="right") - 1
    return chunk, order - begins[chunk], klass


def contests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows ``k1, doc, sub, start, n, chunk`` with all rows of an anchor in one partition, to repeats."""
    tables = [b for b in batches if b.num_rows]
    if not tables:
        return
    rows = pa.Table.from_batches(tables)
    k1, doc, sub, start, n = (rows.column(i).to_numpy() for i in range(5))
    chunk = rows.column(5)
    order = np.argsort(k1, kind="stable")
    borders = np.flatnonzero(np.concatenate([[True], k1[order][1:] != k1[order][:-1], [True]]))
    size = np.concatenate([[0], np.cumsum((n + LENGTH)[order])])
    begin = 0
    while begin < len(borders) - 1:
        end = begin + 1
        while end < len(borders) - 1 and size[borders[end + 1]] - size[borders[begin]] <= SORT_BYTES:
            end += 1
        at = order[borders[begin] : borders[end]]
        begin = end
        c, offset, klass = equal_strings(chunk.take(pa.array(at)).to_pylist(), n[at])
        row = at[c]
        place = np.lexsort((start[row] + offset, sub[row], doc[row], klass))
        k = klass[place]
        later = place[1:][k[1:] == k[:-1]]
        r = row[later]
        yield _repeats(doc[r], sub[r], start[r] + offset[later], np.ones(len(r), np.int64))


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``k1, kind, doc, sub, start, n, chunk`` of the listed chunks of each text."""
    for batch in batches:
        out: list[list] = [[] for _ in range(7)]
        for doc, sub, text, wanted in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
            raw = (text or "").encode()
            for w in wanted:
                for col, v in zip(out, (w["kind"], w["k1"], doc, sub, w["start"], w["n"], raw[w["start"] : w["start"] + w["n"] + LENGTH - 1]), strict=True):
                    col.append(v)
        yield pa.RecordBatch.from_arrays(
            [pa.array(out[0], pa.int32()), *[pa.array(x, pa.int64()) for x in out[1:6]], pa.array(out[6], pa.binary())],
            names=["kind", "k1", "doc", "sub", "start", "n", "chunk"],
        )


def _strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The strings of split chunks as rows of their own, keyed by two hashes of their bytes."""
    for batch in batches:
        doc, sub, start, n = (np.asarray(batch.column(i)) for i in range(2, 6))
        k1, k2 = [], []
        for raw, m in zip(batch.column(6).to_pylist(), n, strict=True):
            for j in range(m):
                digest = hashlib.blake2b(raw[j : j + LENGTH], digest_size=16).digest()
                k1.append(int.from_bytes(digest[:8], "little", signed=True))
                k2.append(int.from_bytes(digest[8:], "little", signed=True))
        offset = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        rows = [np.array(k1, np.int64), np.array(k2, np.int64), np.repeat(doc, n), np.repeat(sub, n), np.repeat(start, n) + offset, np.ones(n.sum(), np.int64)]
        yield from combine(rows, False)


def _remove(batches: Iterator[pa.RecordBatch], keep: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        cols: list[list] = [[] for _ in range(5)]
        for text, ranges in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            raw = (text or "").encode()
            kept, at, removed, spans = [], 0, 0, 0
            for a, b in sorted((r["start"], r["n"]) for r in ranges or ()):
                if a > at or not spans:
                    spans += 1
                    kept.append(raw[at:a])
                    at = a
                if b > at:
                    removed += b - at
                    at = b
            kept.append(raw[at:])
            rest = b"".join(kept)
            for col, v in zip(cols, (len(raw), removed, spans, hashlib.sha256(rest).hexdigest(), rest), strict=True):
                col.append(v)
        arrays = [batch.column(0), *[pa.array(c, pa.int64()) for c in cols[:3]], pa.array(cols[3], pa.string())]
        names = ["id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
        if keep:
            arrays, names = [*arrays, pa.array(cols[4], pa.binary())], [*names, "kept"]
        yield pa.RecordBatch.from_arrays(arrays, names=names)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep_bytes: bool = False) -> DataFrame:
    """id, ``n_bytes, n_removed, n_spans, kept_sha256`` and, if asked for, the ``kept`` bytes of each document."""
    kind = docs.schema[id_col].dataType.simpleString()
    doc = F.coalesce(F.col(id_col).cast("long"), F.lit(FIRST_ID))
    rows = docs.select(F.col(id_col).alias("id"), doc.alias("doc"), F.lit(0).cast("long").alias("sub"), F.col(text_col).alias("text"))
    if not rows.groupBy("doc").count().where("count > 1").isEmpty():
        order = Window.partitionBy("doc").orderBy(F.col("text").asc_nulls_first())
        rows = rows.withColumn("sub", (F.row_number().over(order) - 1).cast("long"))
    found = rows.select("doc", "sub", "text").mapInArrow(anchors, SCHEMA)
    where = F.when(F.col("kind") == REPEAT, F.col("doc")).otherwise(F.col("k1"))
    settled = fixed(found.withColumn("_at", where).repartition("_at").drop("_at").mapInArrow(settle, SCHEMA), "settled")

    def wanted(kinds: str) -> DataFrame:
        asked = settled.where(kinds).groupBy("doc", "sub").agg(F.collect_list(F.struct("kind", "k1", "start", "n")).alias("wanted"))
        texts = rows.select("doc", "sub", "text").join(asked, ["doc", "sub"])
        return texts.select("doc", "sub", "text", "wanted").mapInArrow(_cut, "kind int, k1 long, doc long, sub long, start long, n long, chunk binary")

    repeats = [settled.where(f"kind = {REPEAT}")]
    repeats.append(wanted(f"kind = {CONTEST}").select("k1", "doc", "sub", "start", "n", "chunk").repartition("k1").mapInArrow(contests, SCHEMA))
    if not settled.where(f"kind = {SPLIT}").isEmpty():
        strings = wanted(f"kind = {SPLIT}").mapInArrow(_strings, SCHEMA)
        at = F.when(F.col("kind") == REPEAT, F.col("doc")).otherwise(F.hash("k1", "k2").cast("long"))
        repeats.append(strings.withColumn("_at", at).repartition("_at").drop("_at").mapInArrow(settle, SCHEMA).where(f"kind = {REPEAT}"))
    every = repeats[0]
    for r in repeats[1:]:
        every = every.union(r)
    ranges = every.groupBy("doc", "sub").agg(F.collect_list(F.struct("start", "n")).alias("ranges"))
    joined = rows.join(ranges, ["doc", "sub"], "left").select("id", "text", "ranges")
    schema = f"id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * keep_bytes
    return joined.mapInArrow(lambda b: _remove(b, keep_bytes), schema).withColumnRenamed("id", id_col)
