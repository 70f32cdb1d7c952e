"""Token counts by prefix dynamic programming (byte-level BPE).

The vocabulary's pattern splits a text into pieces, and merges never cross a
piece. For one piece, let ``last[i]`` be the last token of the encoding of its
first i bytes. Exactly one vocabulary entry that ends at i fits: the one that
stays beside ``last`` of the place where it begins when the two are merged as
BPE merges. So one pass gives the exact count of every prefix,
``count[i] = count[begin] + 1``. Pieces are handled in sorted order and share
the states of their common prefix; the counts of a piece are stored and reused.

A prefix of a text is counted from the stored pieces without re-encoding:
``prefix_counts`` has an entry for every code point, ``token_counts`` answers
"how many", "over the limit" and "where to cut" for a whole table, and
``tokens_in`` / ``longest_prefix`` answer budget questions on stored counts.

Defined results: a null text is empty and has 0 tokens; a special string inside
a text counts as the library counts it, as one token; any other column is left
alone, repeated rows stay repeated, an empty table gives no rows.
"""

from __future__ import annotations

import json
import re
from array import array
from bisect import bisect_right
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from blockwise.llm.common import by_value, kept_by_worker, text_chunks

by_value(__name__)

LETTER = "A-Za-zªµºÀ-ÖØ-öø-ſ"
#: A text with one of these is split by the library itself: classes of Python's ``re`` may differ there.
UNSURE = re.compile("[\x1c-\x1f\x85\xa0²³¹¼-¾İƀ-\U0010ffff]")
PIECE = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{LETTER}]+| ?[0-9]+| ?[^\s0-9{LETTER}]+|\s+(?!\S)|\s+")
#: White space as the vocabulary's pattern has it: without the separators U+001C to U+001F, which Python counts in.
SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
LEADING = re.compile(f"[{SPACE}]*")
#: Contractions whose two-character prefix is two pieces.
CONTRACTION_STARTS = {"'re", "'ve", "'ll"}
#: Pieces kept by a task; the store is emptied when it is full.
STORE = 300_000


def byte_of_char() -> dict[str, int]:
    """Byte-level alphabet: printable Latin-1 characters stand for themselves, the other bytes follow from U+0100 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}


class PrefixCounter:
    """Counts of every prefix for one ``tokenizers`` file of a byte-level BPE."""

    def __init__(self, path: str):
        import ahocorasick
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        alphabet = byte_of_char()
        word = lambda s: bytes(alphabet[c] for c in s)
        self.special = [t["content"] for t in spec["added_tokens"] if t["special"]]
        pairs = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        self.vocab = [word(t) for t in spec["model"]["vocab"] if t not in self.special]
        number = {t: k for k, t in enumerate(self.vocab)}
        self.rank: dict[tuple[int, int], int] = {}
        self.made_of: dict[int, tuple[int, int]] = {}
        for i, (x, y) in enumerate(pairs):
            x, y = word(x), word(y)
            self.rank[number[x], number[y]] = i
            self.made_of.setdefault(number[x + y], (number[x], number[y]))
        self.sides: dict[tuple[int, int], list[tuple[int, float]]] = {}
        # Finds the entries that end at each byte, the longest first. Bytes are looked up as Latin-1 characters.
        self.ending = ahocorasick.Automaton()
        for k, t in enumerate(self.vocab):
            self.ending.add_word(t.decode("latin-1"), (len(t), k))
        self.ending.make_automaton()
        #: Pair of entry numbers (-1: nothing before) as one integer -> whether BPE leaves them side by side.
        self.beside: dict[int, bool] = {}
        self.library = Tokenizer.from_file(path)
        self.total: dict[str, int] = {}
        self.inner: dict[str, object] = {}

    def side(self, t: int, right: int) -> list[tuple[int, float]]:
        """Entries at the right (1) or left (0) edge of t while t is merged, each with the rank of the merge that uses it up."""
        if (t, right) not in self.sides:
            parts = self.made_of.get(t)
            inner = self.side(parts[right], right) if parts else []
            if parts:
                inner = [*inner[:-1], (inner[-1][0], self.rank[parts])]
            self.sides[t, right] = [*inner, (t, float("inf"))]
        return self.sides[t, right]

    def fits(self, a: int, b: int) -> bool:
        """Does BPE leave entries a and b side by side?

        Merges happen in the order of their ranks, so it is enough to follow what stands at the border:
        a merge across it must not come before the merge that uses up one of its two sides.
        """
        ok = True
        if a >= 0:
            left, right, i, j = self.side(a, 1), self.side(b, 0), 0, 0
            while True:
                (x, until_x), (y, until_y) = left[i], right[j]
                across = self.rank.get((x, y), float("inf"))
                if across < until_x and across <= until_y and across < float("inf"):
                    ok = False
                    break
                if until_x == until_y == float("inf"):
                    break
                if until_x <= until_y:
                    i += 1
                else:
                    j += 1
        if len(self.beside) > 500_000:
            self.beside.clear()
        self.beside[(a << 32) + b] = ok
        return ok

    def learn(self, pieces: list[str]) -> None:
        """Add ``pieces`` to the store; neighbours in sorted order share the states of their common prefix."""
        matches, beside, fits = self.ending.iter, self.beside, self.fits
        before, last, count = b"", [-1], [0]
        for piece in sorted(pieces):
            raw = piece.encode()
            same = 0
            for x, y in zip(before, raw, strict=False):
                if x != y:
                    break
                same += 1
            del last[same + 1 :], count[same + 1 :]
            found = same
            for end, (n, t) in matches(raw.decode("latin-1")):
                if end == found:
                    begin = end + 1 - n
                    a = last[begin]
                    ok = beside.get((a << 32) + t)
                    if ok or ok is None and fits(a, t):
                        last.append(t)
                        count.append(count[begin] + 1)
                        found += 1
            if found < len(raw):
                raise ValueError(f"no token of the vocabulary ends at byte {found + 1} of {piece!r}")
            before = raw
            self.total[piece] = count[len(raw)]
            if len(raw) == len(piece):
                chars = count[1 : len(raw) + 1]
            else:
                chars = [count[k + 1] for k in range(len(raw)) if k + 1 == len(raw) or raw[k + 1] & 0xC0 != 0x80]
            self.inner[piece] = bytes(chars) if len(chars) < 256 else array("I", chars)

    def pieces(self, text: str) -> list[str]:
        if UNSURE.search(text):
            return [text[a:b] for _, (a, b) in self.library.pre_tokenizer.pre_tokenize_str(text)]
        return PIECE.findall(text)

    def known(self, texts: list[list[str]]) -> None:
        """Make sure that the store has every piece of ``texts``; a full store is emptied first."""
        pieces = set().union(*texts)
        new = pieces.difference(self.total)
        if len(self.total) + len(new) > STORE:
            self.total.clear()
            self.inner.clear()
            new = pieces
        self.learn(list(new))

    def counts(self, piece: str):
        """Counts of the prefixes of one piece."""
        if piece not in self.inner:
            self.learn([piece])
        return self.inner[piece]

    def plain_prefix_counts(self, text: str) -> list[int]:
        """Counts of all prefixes (index: code points) of a text without special strings."""
        pieces = self.pieces(text)
        out, done, run_from, run_base = [0], 0, None, 0
        for piece in pieces:
            inner = self.counts(piece)
            lead = LEADING.match(piece).end()
            if lead:
                # A prefix that ends in white space has that whole run as its last piece.
                if run_from is None:
                    run_from, run_base = len(out) - 1, done
                start = len(out) - 1 - run_from
                run = self.counts(text[run_from : len(out) - 1 + lead])
                out += [run_base + run[start + k] for k in range(lead)]
            if lead < len(piece):
                run_from = None
                if piece in CONTRACTION_STARTS:
                    out += [done + 1, done + 2, done + inner[-1]]
                else:
                    out += [done + inner[k] for k in range(lead, len(piece))]
            done += inner[-1]
        return out

    def prefix_counts(self, text: str | None) -> list[int]:
        """``result[p]``: tokens of the first p code points."""
        text = text or ""
        at = [m.start() for s in self.special for m in re.finditer(re.escape(s), text)]
        if not at:
            return self.plain_prefix_counts(text)
        out, base, begin = [0], 0, 0
        for k in [*sorted(at), len(text)]:
            special = next((s for s in self.special if text.startswith(s, k)), "")
            part = text[begin : k + max(0, len(special) - 1)]
            counts = self.plain_prefix_counts(part)
            out += [base + c for c in counts[1:]]
            base += counts[k - begin]
            if special:
                base += 1
                out.append(base)
            begin = k + len(special)
        return out

    def cut(self, text: str, pieces: list[str], limit: int) -> int:
        """Code points of the longest prefix with at most ``limit`` tokens, for a text without special strings."""
        sums = list(accumulate(self.total[p] for p in pieces))
        over = bisect_right(sums, limit)
        if over == len(sums):
            return len(text)
        first = max(0, over - 3)
        while first and LEADING.fullmatch(pieces[first - 1][-1]):
            first -= 1
        start = sum(map(len, pieces[:first]))
        base = sums[first - 1] if first else 0
        end = start + sum(map(len, pieces[first : over + 3]))
        counts = self.plain_prefix_counts(text[start:end])
        return start + max(i for i, c in enumerate(counts) if base + c <= limit)


def _counting(path: str, limit: int, store_prefixes: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = kept_by_worker(("prefix counter", path), lambda: PrefixCounter(path))
        special = re.compile("|".join(map(re.escape, counter.special)) or "(?!)")
        for batch in batches:
            texts = ["" if t is None else t for t in batch.column(1).to_pylist()]
            tokens, cuts, prefixes = [], [], []
            for a, b in text_chunks(texts):
                split = [[] if special.search(t) else counter.pieces(t) for t in texts[a:b]]
                counter.known(split)
                for t, pieces in zip(texts[a:b], split, strict=True):
                    if t and not pieces:
                        counts = counter.prefix_counts(t)
                        n, at = counts[-1], max(i for i, c in enumerate(counts) if c <= limit)
                    else:
                        n = sum(map(counter.total.__getitem__, pieces))
                        at = counter.cut(t, pieces, limit) if n > limit else len(t)
                    tokens.append(n)
                    cuts.append(at)
                    if store_prefixes:
                        prefixes.append(counter.prefix_counts(t))
            out = [batch.column(0), pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array(tokens, pa.int64()), pa.array([n > limit for n in tokens], pa.bool_()), pa.array(cuts, pa.int64())]
            names = ["id", "n_bytes", "n_tokens", "over_limit", "cut_chars"]
            if store_prefixes:
                out, names = [*out, pa.array(prefixes, pa.list_(pa.int32()))], [*names, "prefix_counts"]
            yield pa.RecordBatch.from_arrays(out, names=names)

    return run


def token_counts(docs: DataFrame, tokenizer: str, limit: int = 1024, id_col: str = "doc_id", text_col: str = "text", store_prefixes: bool = False) -> DataFrame:
    """id, ``n_bytes, n_tokens, over_limit, cut_chars`` and, if asked for, ``prefix_counts`` of each document.

    ``cut_chars``: code points of the longest prefix that has at most ``limit`` tokens.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, n_bytes long, n_tokens long, over_limit boolean, cut_chars long" + ", prefix_counts array<int>" * store_prefixes
    return docs.select(id_col, text_col).mapInArrow(_counting(tokenizer, limit, store_prefixes), schema).withColumnRenamed("id", id_col)


def tokens_in(prefix_counts: Column, chars: Column) -> Column:
    """Tokens of the first ``chars`` code points, from stored counts."""
    return F.element_at(prefix_counts, (chars + 1).cast("int"))


def longest_prefix(prefix_counts: Column, budget: int) -> Column:
    """Code points of the longest prefix within ``budget`` tokens, from stored counts."""
    fits = F.transform(prefix_counts, lambda c, i: F.when(c <= budget, i))
    return F.array_max(fits)
