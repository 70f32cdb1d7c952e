"""Quality rules: gradient-boosted trees over document statistics.

``statistics`` measures each whole text, ``fit_trees`` boosts small regression
trees on a bounded labelled sample, and the trees are flattened into node
arrays that score a batch of documents at once. Monotonic constraints hold for
chosen features: more symbols, repeated words or repeated lines can never raise
a score.

Defined results: a null or empty text has no words and fails the base rule;
without labels of both classes the verdict is the base rule alone; repeated rows
give equal results; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blockwise.llm.common import by_value

by_value(__name__)

WINDOW = 5
SYMBOLS = b"#*$%&|<>"
#: Labelled rows used to fit the trees: those with the smallest hash of their id.
FIT_ROWS = 20_000
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
FEATURES = [
    "log_words", "mean_word_chars", "symbols_per_word", "dup_line_share", "repeat_share", "log_lines", "words_per_line",
    "upper_share", "digit_share", "punct_share", "distinct_share", "shout_share", "bar_share", "other_byte_share",
]
#: -1: the score may only fall as the feature grows.
MONOTONE = {"symbols_per_word": -1, "dup_line_share": -1, "repeat_share": -1, "shout_share": -1, "bar_share": -1}


def repeat_words(hashes: np.ndarray, window: int = WINDOW) -> int:
    """Words that lie in a window found twice or more, first one included."""
    n = len(hashes) - window + 1
    if n < 2:
        return 0
    h = hashes.astype(np.uint64)
    key = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(window):
            key = key * np.uint64(0x9E3779B97F4A7C15) + (h[k : k + n] ^ (h[k : k + n] >> np.uint64(29)))
            key ^= key >> np.uint64(32)
    order = np.argsort(key, kind="stable")
    same = key[order[1:]] == key[order[:-1]]
    if not same.any():
        return 0
    twice = np.zeros(n, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    cover = np.zeros(n + window, np.int64)
    starts = np.flatnonzero(twice)
    cover[starts] += 1
    cover[starts + window] -= 1
    return int((np.cumsum(cover) > 0).sum())


def measure(text: str | None) -> tuple[list[int], list[float]]:
    """The base counts and the features of one whole text."""
    text = text or ""
    raw = text.encode()
    words = raw.split()
    n = len(words)
    in_words = sum(map(len, words))
    chars = len(text) - (len(raw) - in_words)
    symbols = sum(raw.count(bytes([c])) for c in SYMBOLS)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    dup_lines = len(lines) - len(set(lines))
    hashes = np.fromiter(map(hash, words), np.int64, n)
    repeats = repeat_words(hashes)
    per = 1.0 / n if n else 0.0
    data = np.frombuffer(raw, np.uint8)
    kinds = np.bincount(_CLASS[data], minlength=5) if len(data) else np.zeros(5, int)
    per_byte = 1.0 / max(1, in_words)
    features = [
        float(np.log1p(n)), chars * per, symbols * per, dup_lines / max(1, len(lines)), repeats * per, float(np.log1p(len(lines))), n / max(1, len(lines)),
        kinds[1] * per_byte, kinds[2] * per_byte, kinds[3] * per_byte, len(set(words)) * per, raw.count(b"!") * per, raw.count(b"|") * per, kinds[4] * per_byte,
    ]
    return [n, chars, symbols, dup_lines, repeats], features


def _byte_classes() -> np.ndarray:
    out = np.zeros(256, np.int64)
    for c in range(256):
        ch = chr(c)
        out[c] = 4 if c >= 128 else 1 if ch.isupper() else 2 if ch.isdigit() else 3 if c > 32 and not ch.isalpha() else 0
    return out


_CLASS = _byte_classes()


# ------------------------------------------------------------ trees


@dataclass
class Trees:
    """Nodes of all trees in flat arrays; a leaf is its own child. ``roots`` has the first node of each tree."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    depth: int
    bias: float

    def score(self, x: np.ndarray) -> np.ndarray:
        at = np.broadcast_to(self.roots, (len(x), len(self.roots))).copy()
        rows = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            goes_left = x[rows, self.feature[at]] <= self.threshold[at]
            at = np.where(goes_left, self.left[at], self.right[at])
        return 1 / (1 + np.exp(-(self.bias + self.value[at].sum(axis=1))))


def fit_trees(x: np.ndarray, y: np.ndarray, monotone: list[int], trees: int = 60, depth: int = 4, rate: float = 0.2, bins: int = 64, min_rows: int = 20, l2: float = 1.0) -> Trees | None:
    """Boosted trees with logistic loss; None unless both classes are there.

    A split of a constrained feature must order its children's values, and the
    children inherit the middle as a bound, so that the order holds below too.
    """
    if len(y) == 0 or y.min() == y.max():
        return None
    n, m = x.shape
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(m)]
    binned = np.stack([np.searchsorted(edges[j], x[:, j], side="left") for j in range(m)], axis=1)
    bias = float(np.log(y.mean() / (1 - y.mean())))
    raw = np.full(n, bias)
    feature, threshold, left, right, value, roots = [], [], [], [], [], []

    def add(v: float) -> int:
        k = len(feature)
        feature.append(0)
        threshold.append(np.inf)
        left.append(k)
        right.append(k)
        value.append(v)
        return k

    for _ in range(trees):
        p = 1 / (1 + np.exp(-raw))
        grad, hess = y - p, p * (1 - p)
        root = add(0.0)
        roots.append(root)
        todo = [(root, np.arange(n), -np.inf, np.inf, 0)]
        while todo:
            node, rows, low, high, level = todo.pop()
            g, h = grad[rows].sum(), hess[rows].sum()
            best = None
            if level < depth and len(rows) >= 2 * min_rows:
                for j in range(m):
                    k = len(edges[j]) + 1
                    if k < 2:
                        continue
                    b = binned[rows, j]
                    gl, hl, nl = (np.cumsum(np.bincount(b, w, k))[:-1] for w in (grad[rows], hess[rows], None))
                    vl, vr = np.clip(gl / (hl + l2), low, high), np.clip((g - gl) / (h - hl + l2), low, high)
                    gain = gl * vl - 0.5 * (hl + l2) * vl**2 + (g - gl) * vr - 0.5 * (h - hl + l2) * vr**2
                    ok = (nl >= min_rows) & (len(rows) - nl >= min_rows) & (monotone[j] * (vr - vl) >= 0)
                    gain = np.where(ok, gain, -np.inf)
                    at = int(np.argmax(gain))
                    if best is None or gain[at] > best[0]:
                        best = (gain[at], j, at, vl[at], vr[at])
            here = float(np.clip(g / (h + l2), low, high))
            if best is None or best[0] <= g * here - 0.5 * (h + l2) * here**2 + 1e-6:
                value[node] = rate * here
                raw[rows] += value[node]
                continue
            _, j, at, vl, vr = best
            goes_left = binned[rows, j] <= at
            feature[node], threshold[node] = j, float(edges[j][at])
            left[node], right[node] = add(0.0), add(0.0)
            middle = (vl + vr) / 2
            bounds = {0: ((low, high), (low, high)), 1: ((low, middle), (middle, high)), -1: ((middle, high), (low, middle))}[monotone[j]]
            todo.append((left[node], rows[goes_left], *bounds[0], level + 1))
            todo.append((right[node], rows[~goes_left], *bounds[1], level + 1))
    to = lambda a, t: np.array(a, dtype=t)
    return Trees(to(feature, np.int64), to(threshold, float), to(left, np.int64), to(right, np.int64), to(value, float), to(roots, np.int64), depth, bias)


# ------------------------------------------------------------ Spark


def statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: Trees | None = None) -> DataFrame:
    """id, the base counts, ``features`` and (with a model) ``score`` of each document."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [measure(t) for t in batch.column(1).to_pylist()]
            counts = np.array([c for c, _ in found], np.int64).reshape(-1, len(COUNTS))
            x = np.array([f for _, f in found], float).reshape(-1, len(FEATURES))
            score = model.score(x) if model is not None else np.full(len(x), np.nan)
            cols = [batch.column(0), *[pa.array(counts[:, i]) for i in range(len(COUNTS))], pa.array(x.tolist(), pa.list_(pa.float64())), pa.array(score)]
            yield pa.RecordBatch.from_arrays(cols, names=["id", *COUNTS, "features", "score"])

    schema = f"id {kind}, " + ", ".join(f"{c} long" for c in COUNTS) + ", features array<double>, score double"
    return docs.select(id_col, text_col).mapInArrow(run, schema).withColumnRenamed("id", id_col)


def fit_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality", fit_rows: int = FIT_ROWS) -> Trees | None:
    """Trees fitted on the at most ``fit_rows`` labelled rows with the smallest id hash."""
    chosen = (
        labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull())
        .groupBy(id_col)
        .agg(F.max(label_col).cast("int").alias("_y"))
        .orderBy(F.xxhash64(id_col), id_col)
        .limit(fit_rows)
    )
    rows = statistics(docs.join(F.broadcast(chosen), id_col), id_col).select(id_col, "features")
    rows = rows.join(F.broadcast(chosen), id_col).select("features", "_y").toPandas()
    if rows.empty:
        return None
    order = np.lexsort([*np.array(rows["features"].tolist()).T, rows["_y"].to_numpy()])
    x, y = np.array(rows["features"].tolist(), float)[order], rows["_y"].to_numpy(float)[order]
    return fit_trees(x, y, [MONOTONE.get(f, 0) for f in FEATURES])


def quality_rules(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", min_score: float = 0.5) -> DataFrame:
    """id, base counts, ``base_failed``, ``score`` and ``kept`` of each document."""
    model = fit_quality(docs, labels, id_col)
    out = statistics(docs, id_col, model=model)
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    verdict = F.col("score") >= min_score if model is not None else F.lit(True)
    return out.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & verdict).drop("features")
