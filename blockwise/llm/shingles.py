"""Word shingles of a batch of texts as sorted 64-bit hashes (numpy)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from blockwise.llm.common import by_value

by_value(__name__)

_ODD = 0xD1342543DE82EF95
_INVERSE = pow(_ODD, -1, 2**64)


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every bit of a 64-bit value."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


def _byte_map() -> np.ndarray:
    """ASCII lower case; white space as 0; no other byte is 0 (a null byte counts as byte 1)."""
    out = np.arange(256, dtype=np.uint64)
    out[ord("A") : ord("Z") + 1] += 32
    out[0] = 1
    for c in b" \t\n\r\x0b\x0c":
        out[c] = 0
    return out


_BYTES = _byte_map()


def shingle_hashes(data: np.ndarray, offsets: np.ndarray, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text and where each text's begin.

    ``data``: UTF-8 bytes of all texts, text i being ``data[offsets[i]:offsets[i + 1]]``. Words are split at
    white space, ASCII letters folded to lower case. A text of fewer words than ``width`` has one shingle of
    all its words, a text without words has none.
    """
    n_docs = len(offsets) - 1
    codes = _BYTES[data]
    space = codes == 0
    # Word ends: white space, or the end of a text.
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    starts = np.flatnonzero(~space & (np.concatenate([[True], space[:-1]]) | edge[:-1])) if len(data) else np.zeros(0, np.int64)
    ends = np.flatnonzero(~space & (np.concatenate([space[1:], [True]]) | edge[1:])) + 1 if len(data) else starts
    with np.errstate(over="ignore"):
        total = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((codes + np.uint64(7)) * _powers(_ODD, len(data)), out=total[1:])
        word = mix64((total[ends] - total[starts]) * _powers(_INVERSE, len(data) + 1)[starts] + (ends - starts).astype(np.uint64))
        doc = np.searchsorted(offsets, starts, side="right") - 1
        words = np.bincount(doc, minlength=n_docs)
        per = np.where(words >= width, words - width + 1, np.minimum(words, 1))
        of = np.repeat(np.arange(n_docs), per)
        first_word = np.concatenate([[0], np.cumsum(words)])[:-1]
        at = first_word[of] + (np.arange(len(of)) - np.repeat(np.cumsum(per) - per, per))
        length = np.minimum(words, width)[of]
        key = np.zeros(len(of), np.uint64)
        for k in range(width):
            there = length > k
            part = word[np.minimum(at + k, max(0, len(word) - 1))] if len(word) else key
            key = np.where(there, mix64(key * np.uint64(_ODD) + part + np.uint64(k + 1)), key)
    order = np.lexsort((key, of))
    key, of = key[order], of[order]
    if len(key):
        new = np.concatenate([[True], (key[1:] != key[:-1]) | (of[1:] != of[:-1])])
        key, of = key[new], of[new]
    return key, np.searchsorted(of, np.arange(n_docs + 1), side="left")


def utf8_blocks(column: pa.Array, max_bytes: int = 1_000_000):
    """(first row, end row, bytes, offsets) of a string column, in blocks of about ``max_bytes``; null is empty."""
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    if column.null_count:
        valid = np.asarray(column.is_valid())
        lengths = np.diff(offsets) * valid
        if (lengths != np.diff(offsets)).any():
            raise ValueError("a null string that owns bytes")
    row, n = 0, len(column)
    while row < n:
        end = int(np.searchsorted(offsets, offsets[row] + max_bytes, side="right")) - 1
        end = min(n, max(end, row + 1))
        yield row, end, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end
