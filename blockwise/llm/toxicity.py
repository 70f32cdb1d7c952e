"""Toxicity: noisy-channel deobfuscation, then a score of the restored text.

1. ``letter_grams`` counts letter 4-grams over all whole texts; from them comes
   a character language model (each order backs off to the next lower one). The
   alphabet has 32 symbols, so the summed table has at most 32 ** 4 entries,
   whatever the corpus.
2. Places that may be obfuscated become character lattices: every token with a
   look-alike beside a letter or with separators inside, every run of two or more
   parts of at most ``SHORT`` letters whatever stands between them, every word
   with a doubled letter. A look-alike may stand for a letter or break the word, a
   separator may be dropped or kept, a repetition may be dropped. Viterbi search
   under the language model finds the restored text; places that it leaves as they
   are do not count as restored. Other words have one path only.
3. ``fit`` decodes the labelled rows once and stores their words. From that table
   it learns which words and word beginnings mark toxic texts (counts over
   distinct texts, lower bound of the log odds; only the strong marks come to the
   driver), and a logistic function of the strongest mark and the number of marks,
   fitted on rows that the counts did not use. ``score`` applies both to every whole
   text; a worker keeps what it knows of places and words from task to task, in
   two generations of bounded size.

The classifier is fitted on at most ``TOXIC_ROWS`` and ``CLEAN_ROWS`` labelled
rows, those with the smallest id hash; the language model and the scoring cover
all texts. Labels, language, source and ids are no inputs of a score.

Defined results: a null text is empty and scored like any text without marks;
without labels of both classes every score is 0; repeated rows give equal
results; a null id is not held out; an empty table gives no rows.
"""

from __future__ import annotations

import math
import re
from array import array
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from itertools import repeat
from operator import itemgetter
from uuid import uuid4

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from blockwise.llm.common import Generations, by_value, fixed, kept_by_worker, let_go
from blockwise.llm.shingles import utf8_blocks

by_value(__name__)

TOXIC_ROWS = 20_000
CLEAN_ROWS = 40_000
#: Least lower bound of a mark's log odds, and least share of the best mark's.
MIN_ODDS, STRONG = 1.0, 0.35
HELD_OUT = 2
#: Look-alikes and the letters that they may stand for.
LOOKS_LIKE = {
    "0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "il", "|": "il", "+": "t",
}
#: Costs of the channel (natural logarithms).
COST = {"look": 1.0, "break": 4.0, "drop_symbol": 2.5, "drop_separator": 0.5, "keep_separator": 0.5, "drop_blank": 3.0, "drop_second": 2.5, "drop_more": 0.3}
_LETTER = "a-zß-öø-ÿ"
_LOOK = "".join(re.escape(c) for c in LOOKS_LIKE)
#: Most letters of a part in a run of short parts.
SHORT = 3
_ANY = _LETTER + _LOOK
_INNER, _BETWEEN = rf"(?:[^\w\s{_LOOK}]|_)++", rf"(?:[^\w{_LOOK}]|_)++"
_PART = rf"[{_ANY}]{{1,{SHORT}}}+(?![^\W_]|[{_LOOK}])"
TOKEN = re.compile(rf"(?<![{_ANY}])(?:[{_LETTER}]++(?=[{_LOOK}]|{_INNER}[{_ANY}])|[{_LOOK}]++(?=[{_LETTER}]|{_INNER}[{_ANY}]))[{_ANY}]*+(?:{_INNER}[{_ANY}]++)*+")
PARTS = re.compile(rf"(?<![^\W_])(?<![{_LOOK}]){_PART}(?:{_BETWEEN}{_PART})++")
SAME = re.compile(r"(.)\1", re.DOTALL)
DOUBLED = re.compile(rf"([{_LETTER}])\1")
SEPARATORS = re.compile(_BETWEEN)
WORDS = re.compile(r"[^\W\d_]+")
#: What stands between separators, and the short ones of them.
BLOBS, SHORT_PART = re.compile(rf"(?:[^\W_]|[{_LOOK}])+"), re.compile(rf"[{_ANY}]{{1,{SHORT}}}")
#: Separators at the ends of a token that matter to nothing in it.
EDGES = ".,;:?\"'()"
#: Tokens, by kind, that may hold a run of parts, and the length from which such a piece is not kept as a whole.
#: The move at a place's end.
END = [(" ", 0, 0.0)]
SEGMENTS, LONG = re.compile("[ax](?:_*[ax])+|x"), 100
#: Places, words, tokens and tokens that are one plain word, which a generation of a worker's store holds.
STORE, WORD_STORE, TOKEN_STORE, PLAIN_STORE = 40_000, 20_000, 50_000, 100_000
#: Symbols of the language model: 0 ends a word, 1 to 26 are a to z, the rest are other letters.
ORDER, SYMBOLS = 4, 32


def _byte_symbols() -> np.ndarray:
    out = np.zeros(256, np.int8)
    for c in range(26):
        out[97 + c] = out[65 + c] = c + 1
    for c in range(0x80, 0xC0):
        out[c] = 27 + c % 5
    out[0xC0:] = -1  # the first byte of a longer character; its other bytes count
    return out


_SYMBOL = _byte_symbols()


@lru_cache(maxsize=4096)
def symbol(char: str) -> int:
    return 0 if char == " " else int(_SYMBOL[char.encode()[-1]])


class _Symbols(dict):
    """``symbol`` of each character met."""

    def __missing__(self, char: str) -> int:
        self[char] = out = symbol(char)
        return out


SYMBOL = _Symbols()


def letter_grams(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``gram, n``: letter 4-grams of all whole texts, as base-32 numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()  # an earlier stage's stores
        total = np.zeros(SYMBOLS**ORDER, np.int64)
        for batch in batches:
            for _, _, data, offsets in utf8_blocks(batch.column(0)):
                s = np.insert(_SYMBOL[data], offsets, 0)
                s = s[s >= 0]
                s = s[np.concatenate([[True], (s[1:] != 0) | (s[:-1] != 0)])]
                if len(s) >= ORDER:
                    s = s.astype(np.int32)
                    total += np.bincount(((s[:-3] * 32 + s[1:-2]) * 32 + s[2:-1]) * 32 + s[3:], minlength=len(total))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["gram", "n"])

    return docs.select(text_col).mapInArrow(run, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))


def language_model(grams: DataFrame) -> np.ndarray:
    """Log probabilities of a symbol after three others, each order smoothed by the next lower one."""
    rows = grams.toPandas()  # at most 32 ** 4 rows
    counts = np.zeros(SYMBOLS**ORDER)
    counts[rows["gram"].to_numpy(np.int64)] = rows["n"].to_numpy(float)
    counts = counts.reshape((SYMBOLS,) * ORDER)
    p = np.full(SYMBOLS, 1 / SYMBOLS)
    for axes in ((0, 1, 2), (0, 1), (0,), ()):
        c = counts.sum(axis=axes) if axes else counts
        p = (c + 5 * p) / (c.sum(axis=-1, keepdims=True) + 5)
    return np.log(p).reshape(-1, SYMBOLS).astype(np.float32)


class Restorer:
    """Viterbi decoding of obfuscated places; equal places, words and tokens are worked out once.

    A text is read by its tokens between white space, most of which are one plain word. Only a run of
    parts reaches across white space, so the other places are those of their tokens, and a run is looked
    for where tokens begin or end with short parts.
    """

    def __init__(self, model: np.ndarray, weights: dict[str, float] | None = None):
        self.model = array("f", np.ascontiguousarray(model, np.float32).tobytes())
        self.weights = weights or {}
        self.heads = {mark[:4] for mark in self.weights}
        self.moves: dict[tuple, list[tuple[str, int, float]]] = {}
        self.place, self.segment = Generations(self.restored, STORE), Generations(self.restored_places, STORE)
        self.word, self.token = Generations(self.word_value, WORD_STORE), Generations(self.token_value, TOKEN_STORE)
        #: Word of each token that is one without a mark, in two generations like the others.
        self.plain: dict[str, str] = {}
        self.plain_before: dict[str, str] = {}

    def places(self, low: str) -> list[str]:
        """Tokens and runs of parts that may be obfuscated; of two places, one inside the other, the outer one."""
        runs, found = [m.span() for m in PARTS.finditer(low)], []
        ends = [b for _, b in runs]
        for m in TOKEN.finditer(low):
            a, b = m.span()
            i = bisect_left(ends, b)
            if i < len(runs) and runs[i][0] <= a:
                continue  # inside a run of parts
            found.append(m.group())
            j = bisect_left(ends, a + 1)
            while j < len(runs) and runs[j][0] >= a and runs[j][1] <= b:
                runs[j], j = (a, a), j + 1  # a run of parts inside a token
        return found + [low[a:b] for a, b in runs if a < b]

    def restored(self, place: str) -> str | None:
        """The words of the restored place, with blanks between them; None if they are those written."""
        written = WORDS.findall(place)
        if not written:
            return None
        out = " ".join(self.decode(SEPARATORS.sub(_one_separator, place)).split())
        return None if out == " ".join(written) else out

    def restored_places(self, low: str) -> tuple[str, ...]:
        """What the places of a piece of text become, without those that stay as they are."""
        return tuple([out for p in self.places(low) if (out := self.restored(p) if p == low else self.place[p]) is not None])

    def word_value(self, word: str) -> float | tuple[float, str]:
        """A word's weight; with the restored words if a word with a doubled letter becomes others."""
        value = self.weight(word) if self.weights else 0.0
        m = DOUBLED.search(word)
        if m is not None:
            i = m.start() + 1
            only = SAME.search(word).start() == i - 1 and SAME.search(word, i) is None
            out = self.without(word, i) if only else self.decode(word)
            if out != word:
                return value, out
        return value

    def without(self, word: str, i: int) -> str:
        """``decode`` of a word whose only repeated letter is at ``i``: two ways, which part there and meet after three letters."""
        model, at, met = self.model, 0, word[i + 1 : i + 4]
        symbols = [SYMBOL[c] for c in met] + [0] * (len(met) < 3)
        for c in word[max(0, i - 3) : i]:
            at = (at * 32 + SYMBOL[c]) & 32767
        to = at * 32 + SYMBOL[word[i]]
        kept, dropped, other = model[to], -COST["drop_second"], to & 32767
        for k in symbols:
            to, here = other * 32 + k, at * 32 + k
            kept, dropped = kept + model[to], dropped + model[here]
            other, at = to & 32767, here & 32767
        return word[:i] + word[i + 1 :] if dropped > kept else word

    def token_value(self, token: str) -> str | tuple[str, tuple, dict, tuple, int]:
        """The word that a token between white space is, if it is one without a mark.

        Else its kind (``_``: separators only, ``a``: one short part, ``x``: short parts at an end, else ``n``),
        its words, the weights of the marked ones, what is restored inside it, and how many places that are.
        """
        core = token.strip(EDGES)
        plain = len(core) > SHORT and core.isalpha()
        if plain:
            value = self.word_value(core) if core == token else self.word[core]
            if not value:
                return core
        kind, words, out = "n", (core,) if plain else tuple(WORDS.findall(token)), ()
        if not plain:
            blobs = BLOBS.findall(token)
            if not blobs:
                kind = "_"
            elif SHORT_PART.fullmatch(blobs[0]) or SHORT_PART.fullmatch(blobs[-1]):
                kind = "a" if len(blobs) == 1 and not TOKEN.search(token) else "x"
            else:
                out = self.restored_places(token)
        n, marked = len(out), {}
        for w in words:
            value = self.word[w]
            if type(value) is tuple:
                value, restored = value
                out, n = (*out, restored), n + 1
            if value:
                marked[w] = value
        return kind, words, marked or None, out, n

    def keep_plain(self, token: str, word: str) -> None:
        if len(self.plain) >= PLAIN_STORE:
            self.plain_before, self.plain = self.plain, {}
        self.plain[token] = word

    def weight(self, word: str) -> float:
        """Weight of the strongest mark of a word; the first four letters of a mark are those of its words."""
        if word[:4] not in self.heads:
            return 0.0
        weight = self.weights
        value = weight.get(word, 0.0)
        for k in range(4, min(8, len(word))):
            value = max(value, weight.get(word[:k] + "-", 0.0))
        return value

    def read(self, text: str) -> tuple[set[str], dict[str, float], int]:
        """The words of the restored text, the weights of the marked ones, and how many places differ from what was written."""
        tokens = text.lower().split()
        met, marked, more, n = set(tokens), {}, [], 0
        rest = met.difference(self.plain)
        words = set(map(self.plain.__getitem__, met - rest))
        kinds, changed = {}, {}
        known, recent, add = self.token, self.token.young.get, words.add
        for t in rest:
            value = recent(t)
            if value is None:
                value = self.plain_before.get(t) or known.old.get(t) or self.token_value(t)
                if type(value) is str:
                    self.keep_plain(t, value)
                    add(value)
                    continue
                known.put(t, value)
                recent = known.young.get
            kind, own, weights, out, k = value
            words.update(own)
            if kind != "n":
                kinds[t] = kind
            if weights:
                marked.update(weights)
            if k:
                changed[t] = k
                more += out
        if len(changed) > 2:
            n += sum(map(changed.get, tokens, repeat(0)))
        else:
            for t, k in changed.items():
                n += k * tokens.count(t)
        if kinds:
            place, segment = self.place, self.segment
            for m in SEGMENTS.finditer("".join(map(kinds.get, tokens, repeat("n")))):
                piece = " ".join(tokens[m.start() : m.end()])
                out = segment[piece] if len(piece) <= LONG else [o for p in self.places(piece) if (o := place[p]) is not None]
                n += len(out)
                more += out
        for w in {w for out in more for w in out.split()} - words:
            words.add(w)
            value = self.word[w]
            value = value[0] if type(value) is tuple else value
            if value:
                marked[w] = value
        return words, marked, n

    def arcs(self, place: str, i: int) -> list[tuple[str, float]]:
        """What character i may have been (an empty string: nothing, a blank: the end of a word), with its cost."""
        c = place[i]
        if c in " .":
            # A blank between two parts of several letters is most often one.
            alone = place[max(i - 2, 0) : i - 1] in ("", " ", ".") and place[i + 2 : i + 3] in ("", " ", ".")
            return [("", COST["drop_separator" if c == "." or alone else "drop_blank"]), (" ", COST["keep_separator"])]
        out = [(x, COST["look"]) for x in LOOKS_LIKE.get(c, "")]
        out = [*out, (" ", COST["break"])] if out else [(c, 0.0)]
        if c in LOOKS_LIKE and not c.isdigit():
            out.append(("", COST["drop_symbol"]))
        if i and place[i - 1] == c:
            out.append(("", COST["drop_more"] if i > 1 and place[i - 2] == c else COST["drop_second"]))
        return out

    def decode(self, place: str) -> str:
        model, moves, n = self.model, self.moves, len(place)
        beam: dict[int, tuple] = {0: (0.0, None)}  # state -> score, (what was read, the one before)
        i, last = 0, ""
        while i <= n:
            j, symbols = i, []
            while j < n and (c := place[j]) != last and c.isalpha():
                symbols.append(SYMBOL[c])
                j, last = j + 1, c
            if j > i:  # letters that are what they are: one arc each, without cost
                cut = i + 3
                while True:
                    piece, nxt = place[i : min(cut, j)], {}
                    first = symbols[:3] if j > cut else symbols
                    for at, (s, way) in beam.items():
                        for k in first:
                            to = at * 32 + k
                            s += model[to]
                            at = to & 32767
                        if at not in nxt or s > nxt[at][0]:
                            nxt[at] = (s, (piece, way))
                    beam = nxt
                    if j <= cut:
                        break
                    i, cut, symbols = cut, j, symbols[3:]  # after three letters one entry is left
                i = j
            if i < n:
                c = place[i]
                key = (c, place[i - 2 : i - 1] if i > 1 else "", place[i + 2 : i + 3]) if c == " " else (c, last == c, i > 1 and last == c == place[i - 2])
                arcs = moves.get(key)
                if arcs is None:
                    arcs = [(x, symbol(x) if x else -1, cost) for x, cost in self.arcs(place, i)]
                    if len(moves) < 10_000:
                        moves[key] = arcs
                last = c
            else:
                arcs = END
            i, nxt = i + 1, {}
            for x, k, cost in arcs:
                for state, (s, way) in beam.items():
                    s -= cost
                    if k > 0 or (k == 0 and state & 31):
                        to = state * 32 + k
                        s += model[to]
                        state, way = to & 32767, (x, way)
                    if state not in nxt or s > nxt[state][0]:
                        nxt[state] = (s, way)
            beam = nxt  # one entry for each last three symbols, of which few are possible at a place
        _, way = max(beam.values(), key=_score_of)
        out = []
        while way is not None:
            x, way = way
            out.append(x)
        return "".join(out[::-1]).strip()


_score_of = itemgetter(0)


def _one_separator(m: re.Match) -> str:
    """A run of separators counts as one: a blank if it holds white space, else a dot."""
    run = m.group()
    return " " if run == " " or any(map(str.isspace, run)) else "."


def restored_words(text: str, restorer: Restorer) -> tuple[set[str], int]:
    """The words of the restored text, and how many places differ from what was written."""
    words, _, n = restorer.read(text)
    return words, n


# ------------------------------------------------------------ classifier


@dataclass
class Model:
    letters: np.ndarray
    weights: dict[str, float] = field(default_factory=dict)
    logistic: np.ndarray | None = None
    name: str = field(default_factory=lambda: uuid4().hex)

    @staticmethod
    def features(words: int, marked: dict[str, float]) -> list[float]:
        """Strongest mark, marked words by weight (their sum, and their share of all ``words``), constant."""
        if not marked:
            return [0.0, 0.0, 0.0, 1.0]
        total = math.fsum(marked.values())
        return [max(marked.values()), math.log1p(total), 10 * total / (words + 20), 1.0]

    def restorer(self) -> Restorer:
        """This worker's restorer for this model, kept from task to task."""
        return kept_by_worker(("restorer", self.name), lambda: Restorer(self.letters, self.weights))

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.logistic is None:
            return np.zeros(len(x))
        return 1 / (1 + np.exp(-np.clip(x @ self.logistic, -30, 30)))


def remainder(id_col: str) -> Column:
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 4


def training_rows(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str) -> DataFrame:
    """``id, y, part, text``: labelled rows that are not held out, one per distinct text; a bounded table, written once."""
    usable = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg(F.max(label_col).cast("int").alias("y"))
    usable = usable.withColumn("part", remainder("_id").cast("int")).where(F.col("part") != HELD_OUT)
    order = [F.xxhash64("_id"), F.col("_id")]
    chosen = usable.where("y = 1").orderBy(*order).limit(TOXIC_ROWS).union(usable.where("y = 0").orderBy(*order).limit(CLEAN_ROWS))
    chosen = F.broadcast(fixed(chosen, "toxic-sample"))
    text = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    first = text.join(chosen, "_id").groupBy(F.xxhash64("text").alias("_h"), "y").agg(F.min("_id").alias("_id"))
    kept = F.broadcast(first.select("_id").distinct())  # at most as many rows as were chosen
    return fixed(text.join(chosen, "_id").join(kept, "_id", "left_semi"), "toxic-train")


def _slices(batches: Iterator[pa.RecordBatch], rows: int = 500) -> Iterator[pa.RecordBatch]:
    """Batches of fewer rows: the words of a whole batch as Python strings would fill a worker's memory."""
    for batch in batches:
        for a in range(0, batch.num_rows, rows):
            yield batch.slice(a, rows)


def _word_slices(batches: Iterator[pa.RecordBatch], most: int = 1_000_000) -> Iterator[pa.RecordBatch]:
    """Batches of ``y, part, words`` with at most about ``most`` words, one row at least."""
    for batch in batches:
        ends = np.cumsum(pc.list_value_length(batch.column(2)).to_numpy(), dtype=np.int64)
        a = 0
        while a < batch.num_rows:
            b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + most, side="right")))
            yield batch.slice(a, b - a)
            a = b


def words_of(rows: DataFrame, model: Model) -> DataFrame:
    """``y, part, words``: the restored words of each row's text; every text is decoded once, here."""
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restorer = shared.value.restorer()
        for batch in _slices(batches):
            words = [sorted(restored_words(t, restorer)[0]) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(words, pa.list_(pa.string()))], names=["y", "part", "words"])

    return fixed(rows.select("y", "part", "text").mapInArrow(run, "y int, part int, words array<string>"), "toxic-words")


def mark_counts(rows: DataFrame) -> DataFrame:
    """``mark, fit_toxic, fit_clean, toxic, clean``: texts of each class that hold each mark, outside part 3 and in all."""
    names = ["fit_toxic", "fit_clean", "toxic", "clean"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _word_slices(batches):
            group = batch.column(0).to_numpy() + 2 * (batch.column(1).to_numpy(zero_copy_only=False) == 3)  # clean, toxic; the same in part 3
            lengths = pc.list_value_length(batch.column(2)).to_numpy()
            words = batch.column(2).flatten().dictionary_encode()
            known, code, row = words.dictionary, words.indices.to_numpy(), np.repeat(np.arange(len(lengths)), lengths)
            letters = pc.utf8_length(known).to_numpy()
            for k in (0, 4, 5, 6, 7):  # whole words, then the beginnings of longer ones
                long = np.flatnonzero(letters > k)
                marks = known.take(pa.array(long))
                if k:
                    marks = pc.binary_join_element_wise(pc.utf8_slice_codeunits(marks, 0, k), "-", "")
                marks = marks.dictionary_encode()
                of_word = np.full(len(known), -1)
                of_word[long] = marks.indices.to_numpy()
                mark = of_word[code]
                there = mark >= 0
                m = len(marks.dictionary)
                once = np.unique(row[there] * m + mark[there])  # a text holds a mark once
                n = np.bincount(once % max(m, 1) * 4 + group[once // max(m, 1)], minlength=4 * m).reshape(m, 4)
                counts = [n[:, 1], n[:, 0], n[:, 1] + n[:, 3], n[:, 0] + n[:, 2]]
                yield pa.RecordBatch.from_arrays([marks.dictionary, *[pa.array(c.astype(np.int64)) for c in counts]], names=["mark", *names])

    parts = rows.select("y", "part", "words").mapInArrow(run, "mark string, " + ", ".join(f"{n} long" for n in names))
    return parts.groupBy("mark").agg(*[F.sum(n).alias(n) for n in names])


def _logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (y - p) - 0.01 * w
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 0.01 * np.eye(len(w)), grad)
        w = w + np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    spark = docs.sparkSession
    model = Model(language_model(letter_grams(docs, text_col)))
    rows = training_rows(docs, labels, id_col, text_col, label_col)
    words = words_of(rows, model)
    size = {(r["y"], r["fit"]): r["n"] for r in words.groupBy("y", (F.col("part") != 3).alias("fit")).agg(F.count(F.lit(1)).alias("n")).collect()}
    toxic, clean = (sum(size.get((y, f), 0) for f in (True, False)) for y in (1, 0))
    if not toxic or not clean:
        return model
    # The logistic function is fitted on rows that the marks have not seen; then the marks are taken from all rows.
    apart = all(size.get((y, f)) for y in (0, 1) for f in (True, False))
    counts = fixed(mark_counts(words).where("toxic > 2"), "toxic-marks")
    weights = mark_weights(counts, size.get((1, True), 0), size.get((0, True), 0), "fit_") if apart else mark_weights(counts, toxic, clean)
    found = _features(words.where("part = 3") if apart else words, weights).toPandas()  # a row for each labelled row at most
    x, y = np.array(found["features"].tolist(), float), found["y"].to_numpy(float)
    order = np.lexsort([*x.T, y])
    logistic = _logistic(x[order], y[order])
    return Model(model.letters, mark_weights(counts, toxic, clean) if apart else weights, logistic)


def mark_weights(counts: DataFrame, n_toxic: int, n_clean: int, prefix: str = "") -> dict[str, float]:
    """Strong marks and the lower bounds of their log odds, from how many texts of each class hold them."""
    a, c = F.col(f"{prefix}toxic"), F.col(f"{prefix}clean")
    odds = F.ln((a + 0.5) / (n_toxic + 1)) - F.ln((c + 0.5) / (n_clean + 1)) - 2 * F.sqrt(1 / (a + 0.5) + 1 / (c + 0.5))
    marks = counts.where(a > 2).select("mark", odds.alias("odds")).where(F.col("odds") > MIN_ODDS)
    best = marks.agg(F.max("odds")).first()[0]
    # Weak marks are left out: over a long text, chance ones would add up.
    strong = marks.where(F.col("odds") >= STRONG * (best or 0.0)).orderBy(F.desc("odds"), "mark").toPandas()
    return dict(zip(strong["mark"], strong["odds"], strict=True))


def _features(rows: DataFrame, weights: dict[str, float]) -> DataFrame:
    """``y, features`` of ``words``."""
    shared = rows.sparkSession.sparkContext.broadcast(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weigh = Restorer(np.zeros(1, np.float32), shared.value)
        for batch in _slices(batches):
            x = []
            for words in batch.column(1).to_pylist():
                x.append(Model.features(len(words), {w: v for w in words if (v := weigh.weight(w))}))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(x, pa.list_(pa.float64()))], names=["y", "features"])

    return rows.select("y", "words").mapInArrow(run, "y int, features array<double>")


def _scored(rows: DataFrame, shared, id_type: str) -> DataFrame:
    """``id, score, restored`` of ``id, text``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        restorer = model.restorer()
        for batch in _slices(batches):
            x, restored = [], []
            for text in batch.column(1):
                words, marked, n = restorer.read(text.as_py() or "")
                x.append(model.features(len(words), marked))
                restored.append(n)
            score = model.score(np.array(x, float).reshape(-1, 4))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score), pa.array(restored, pa.int64())], names=["id", "score", "restored"])

    return rows.mapInArrow(run, f"id {id_type}, score double, restored long")


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """id, ``held_out, score, predicted, restored`` of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema[id_col].dataType.simpleString()
    out = _scored(docs.select(F.col(id_col).alias("id"), text_col), shared, kind)
    return out.select(
        F.col("id").alias(id_col),
        F.coalesce(remainder("id") == HELD_OUT, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
        "restored",
    )


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    return score(docs, fit(docs, labels, id_col, text_col), id_col, text_col, threshold)


def keep_below(docs: DataFrame, model: Model, threshold: float = 0.3, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that score below ``threshold``, with all their columns, in one pass without a join."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        restorer = model.restorer()
        for batch in _slices(batches):
            x = []
            for text in batch.column(at):
                words, marked, _ = restorer.read(text.as_py() or "")
                x.append(model.features(len(words), marked))
            yield batch.filter(pa.array(model.score(np.array(x, float).reshape(-1, 4)) < threshold))

    return docs.mapInArrow(run, docs.schema)
