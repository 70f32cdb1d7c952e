"""Sequence packing, shortest pack first over the length histogram.

Texts are tokenised, a closing id is added, and a document longer than a
sequence is cut into full sequences and a rest. From then on only lengths
matter: their histogram has at most ``max_len`` entries, whatever the number of
documents. ``pack_histogram`` places the lengths from the longest to the
shortest, always into the shortest open pack, and keeps how often each packing
pattern occurs. The patterns are joined back by rank: the r-th piece of a length
(counted in hash blocks, so that a length shared by a third of all documents is
spread over many tasks) takes the r-th slot for that length.

Size bound of the plan that is broadcast: each length changes at most the open
groups of patterns and opens two, so there are at most 3 * max_len patterns,
and a pattern has at most sqrt(2 * max_len) different lengths.

Defined results: a null text is empty and still has its closing id; repeated
rows are packed separately; an empty table gives no rows.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from blockwise.llm.common import by_value, fixed, kept_by_worker, text_chunks
from blockwise.llm.token_counts import LETTER, UNSURE, byte_of_char

by_value(__name__)

MAX_LEN = 4096
CLOSING_ID = 2
#: Pieces of one length that are ranked together.
RANK_BLOCK = 2_000
#: Largest table of block offsets that is broadcast.
BROADCAST_BLOCKS = 100_000
#: Words that a generation of a worker's store holds.
STORE = 250_000
WORDS = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{LETTER}]+|[0-9]|[^\s0-9{LETTER}]+")


class WordEncoder:
    """Ids of texts as little-endian bytes; the ids of a word are looked up once and kept."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        #: Bytes, as Latin-1 characters, in the vocabulary's alphabet; the line feed, which is in no word, stays.
        self.shown = {b: c for c, b in byte_of_char().items() if b != ord("\n")}
        self.special = re.compile("|".join(re.escape(t.content) for t in self.library.get_added_tokens_decoder().values()) or "(?!)")
        #: Ids of words; a full young store becomes the old one, from which words come back when they are met again.
        self.store: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def learn(self, words: list[str]) -> None:
        """Ids of several words, which need no normalising or splitting any more: the vocabulary's merges are all that is left."""
        ids, ends, merge = [], [], self.library.model.tokenize
        for w in "\n".join(words).encode().decode("latin-1").translate(self.shown).split("\n"):
            ids += [t.id for t in merge(w)]
            ends.append(4 * len(ids))
        raw, at = np.array(ids, dtype="<u4").tobytes(), 0
        for w, end in zip(words, ends, strict=True):
            self.store[w] = raw[at:end]
            at = end

    def encode(self, texts: list[str]) -> list[bytes]:
        odd = [bool(UNSURE.search(t) or self.special.search(t)) for t in texts]
        words = [[] if o else WORDS.findall(t.lower()) for t, o in zip(texts, odd, strict=True)]
        new = set().union(*words).difference(self.store)
        if len(self.store) + len(new) > STORE:
            self.old, self.store = self.store, {}
            new = set().union(*words)
        back = new & self.old.keys()
        self.store.update((w, self.old[w]) for w in back)
        new_words = list(new - back)
        for at in range(0, len(new_words), 10_000):
            self.learn(new_words[at : at + 10_000])
        out = [b"".join(map(self.store.__getitem__, w)) for w in words]
        for i, o in enumerate(odd):
            if o:
                out[i] = np.array(self.library.encode(texts[i], add_special_tokens=False).ids, dtype="<u4").tobytes()
        return out


def _pieces(path: str, max_len: int, closing_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, closing = kept_by_worker(("word encoder", path), lambda: WordEncoder(path)), np.array([closing_id], dtype="<u4").tobytes()
        for batch in batches:
            texts = ["" if t is None else t for t in batch.column(1).to_pylist()]
            row, start, length, crc, total = [], [], [], [], []
            for a, b in text_chunks(texts):
                for i, ids in enumerate(encoder.encode(texts[a:b]), a):
                    ids += closing
                    n = len(ids) // 4
                    for s in range(0, n, max_len):
                        part = ids[4 * s : 4 * (s + max_len)]
                        row.append(i)
                        start.append(s)
                        length.append(len(part) // 4)
                        crc.append(zlib.crc32(part))
                        total.append(n)
            ints = [pa.array(x, pa.int64()) for x in (start, length, crc, total)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row, pa.int64())), *ints], names=["id", "start", "length", "ids_crc32", "doc_tokens"])

    return run


def token_pieces(docs: DataFrame, tokenizer: str, max_len: int = MAX_LEN, closing_id: int = CLOSING_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: id, ``start, length, ids_crc32, doc_tokens``; pieces have at most ``max_len`` ids."""
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, start long, length long, ids_crc32 long, doc_tokens long"
    return docs.select(id_col, text_col).mapInArrow(_pieces(tokenizer, max_len, closing_id), schema).withColumnRenamed("id", id_col)


def pack_histogram(counts: dict[int, int], max_len: int = MAX_LEN) -> list[tuple[tuple[tuple[int, int], ...], int]]:
    """Patterns ((length, how often), ...) and how many packs have each."""
    open_by_space: dict[int, dict[tuple, int]] = {}
    largest = 0
    closed: dict[tuple, int] = {}

    def put(pattern: tuple, space: int, n: int) -> None:
        where = open_by_space.setdefault(space, {}) if space else closed
        where[pattern] = where.get(pattern, 0) + n

    def grown(pattern: tuple, length: int, k: int) -> tuple:
        if pattern and pattern[-1][0] == length:
            return (*pattern[:-1], (length, pattern[-1][1] + k))
        return (*pattern, (length, k))

    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            largest = max((s for s, g in open_by_space.items() if g), default=0)
            if largest < length:
                # No open pack has room: new packs, each filled while it is the shortest.
                per = max_len // length
                full, rest = divmod(left, per)
                for k, n in ((per, full), (rest, 1)):
                    if k and n:
                        put(((length, k),), max_len - k * length, n)
                left = 0
                continue
            group = open_by_space[largest]
            pattern = next(iter(group))
            n = min(left, group[pattern])
            group[pattern] -= n
            if not group[pattern]:
                del group[pattern]
            if not group:
                del open_by_space[largest]
            put(grown(pattern, length, 1), largest - length, n)
            left -= n
    for group in open_by_space.values():
        for pattern, n in group.items():
            closed[pattern] = closed.get(pattern, 0) + n
    return sorted(closed.items())


def slot_table(patterns: list[tuple[tuple[tuple[int, int], ...], int]]) -> pd.DataFrame:
    """Rows ``length, first_rank, times, sequence, offset``: from ``first_rank`` on, ranks fill packs from ``sequence`` on, ``times`` a pack."""
    rows, sequence, ranks = [], 0, {}
    for pattern, packs in patterns:
        offset = 0
        for length, times in pattern:
            first = ranks.get(length, 0)
            rows.append((length, first, times, sequence, offset))
            ranks[length] = first + packs * times
            offset += length * times
        sequence += packs
    return pd.DataFrame(rows, columns=["length", "first_rank", "times", "sequence", "offset"], dtype="int64").sort_values(["length", "first_rank"], ignore_index=True)


RANK_BITS = 48


def pack(pieces: DataFrame, max_len: int = MAX_LEN, id_col: str = "doc_id") -> DataFrame:
    """``pieces`` (a stored table) with ``sequence_id`` and ``offset``."""
    spark = pieces.sparkSession
    counts = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}  # at most max_len rows
    slots = slot_table(pack_histogram(counts, max_len))
    shared = spark.sparkContext.broadcast(slots)

    blocks = F.create_map(*[F.lit(x) for n, c in counts.items() if c > RANK_BLOCK for x in (n, -(-c // RANK_BLOCK))]) if max(counts.values(), default=0) > RANK_BLOCK else None
    many = F.coalesce(F.try_element_at(blocks, F.col("length")), F.lit(1)) if blocks is not None else F.lit(1)
    keyed = pieces.withColumn("_b", F.pmod(F.xxhash64(id_col, "start", "ids_crc32"), many).cast("int"))
    sizes = keyed.groupBy("length", "_b").count()
    before = Window.partitionBy("length").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("length", "_b", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_from"))
    if sum(-(-c // RANK_BLOCK) for c in counts.values()) <= BROADCAST_BLOCKS:
        offsets = F.broadcast(offsets)
    place = Window.partitionBy("length", "_b").orderBy(id_col, "start", "ids_crc32")
    ranked = keyed.withColumn("_n", F.row_number().over(place) - 1).join(offsets, ["length", "_b"])
    ranked = ranked.withColumn("_rank", (F.col("_from") + F.col("_n")).cast("long")).drop("_b", "_n", "_from")

    def fill(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        s = shared.value
        keys = (s["length"].to_numpy() << RANK_BITS) | s["first_rank"].to_numpy()
        first, times, sequence, offset = (s[c].to_numpy() for c in ("first_rank", "times", "sequence", "offset"))
        for f in frames:
            length, rank = f["length"].to_numpy(), f["_rank"].to_numpy()
            at = np.searchsorted(keys, (length << RANK_BITS) | rank, side="right") - 1
            nth = rank - first[at]
            f["sequence_id"] = sequence[at] + nth // times[at]
            f["offset"] = offset[at] + nth % times[at] * length
            yield f.drop(columns="_rank")

    names = pieces.columns
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema.fields)
    return ranked.select(*names, "_rank").mapInPandas(fill, schema + ", sequence_id long, offset long")


def pack_documents(docs: DataFrame, tokenizer: str, max_len: int = MAX_LEN, closing_id: int = CLOSING_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece of each document with its sequence and its place there."""
    pieces = fixed(token_pieces(docs, tokenizer, max_len, closing_id, id_col, text_col), "pack-pieces")
    return pack(pieces, max_len, id_col)
