"""Personal data (DataFrame operations only).

Regular expressions propose spans, validators confirm them (Luhn for cards,
mod-97 for IBANs, part and digit ranges), and words shortly before a span adjust
its score. ``email``, ``ip``, ``card`` and ``phone`` follow fixed rules and stay
whatever their score; ``iban`` and ``ssn`` are added when their score reaches
``min_score``.

Starts are found without a Python step: the text is split by the same pattern,
so the lengths of the parts and of the matches before a match give its place.
The patterns are written so that no start is tried inside a run that was already
tried: a long run of letters or digits costs its length, not its square.

Defined results: a null text is empty and has no spans; spans are in code
points, end exclusive; every row is handled on its own, so repeated rows give
equal results; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from blockwise.llm.common import text_or_empty

_LOCAL = "A-Za-z0-9._%+-"
_PART = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
#: Kind -> pattern. A run of a leading class is entered at its first character or where the last match ended (\G).
PATTERNS = {
    "email": rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?=(?:\x20?[A-Z0-9]){11})",  # the head only, see _ibans
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
}
#: The longest text that an IBAN's head can start; and the registered lengths without blanks.
IBAN = r"^[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}(?![A-Za-z0-9])"
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FO GL NL", 19: "MK SI", 20: "AT BA EE KZ LT LU XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA",
    23: "AE GI IL IQ TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HU LB PL SV",
    29: "BR EG PS QA UA", 30: "JO KW MU", 31: "MT SC", 32: "LC",
}
KINDS = list(PATTERNS)
BASE = KINDS[:4]
#: A text without a match of this cannot have the kind (cheap test before the pattern).
NEEDS = {"email": "@", "phone": "+"}
DIGIT_KINDS = ["ip", "card", "iban", "ssn"]
#: Score of a confirmed span without context, and the words that raise it.
SCORE = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.6, "iban": 0.9, "ssn": 0.3}
CONTEXT = {
    "email": r"e-?mail|contact|write|courriel|correo",
    "ip": r"\bip\b|address|host|server",
    "card": r"card|visa|credit|debit|karte|carte|tarjeta",
    "phone": r"phone|call|tel|mobile|fax|anruf",
    "iban": r"iban|account|bank|konto|compte|cuenta",
    "ssn": r"ssn|social|security|insured",
}
CONTEXT_CHARS = 40
CONTEXT_BONUS = 0.4
SPANS = "array<struct<start:int,end:int,kind:int,score:double>>"


def digits_of(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def luhn_ok(digits: Column) -> Column:
    doubled = F.array(*[F.lit(n) for n in (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)])
    values = F.transform(
        F.regexp_extract_all(F.reverse(digits), F.lit("."), F.lit(0)),
        lambda d, i: F.when(i % 2 == 1, F.element_at(doubled, d.cast("int") + 1)).otherwise(d.cast("int")),
    )
    return F.aggregate(values, F.lit(0), lambda a, v: a + v) % 10 == 0


def mod97_ok(x: Column) -> Column:
    """ISO 7064 mod 97-10: the first four characters go to the end, a letter stands for 10 to 35."""
    compact = F.replace(x, F.lit(" "), F.lit(""))
    moved = F.concat(F.substr(compact, F.lit(5)), F.substr(compact, F.lit(1), F.lit(4)))
    rest = F.aggregate(
        F.regexp_extract_all(moved, F.lit("."), F.lit(0)),
        F.lit(0),
        lambda a, c: F.when(c.between("0", "9"), (a * 10 + F.ascii(c) - 48) % 97).otherwise((a * 100 + F.ascii(c) - 55) % 97),
    )
    return rest == 1


def _valid(kind: str, hit: Column) -> Column:
    if kind == "ip":
        return hit.rlike(rf"^{_PART}(?:\.{_PART}){{3}}$")
    if kind == "card":
        digits = digits_of(hit)
        return F.when(F.length(digits).between(14, 19), luhn_ok(digits)).otherwise(F.lit(False))
    if kind == "phone":
        return F.length(digits_of(hit)).between(10, 15)
    return F.lit(True)


def _placed(hits: Column, gaps: Column, kind: str) -> Column:
    """(start, end, kind, hit) of every match, from the texts of the matches and of the parts between them."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int,hit:string>>").alias("out"))

    def step(acc: Column, pair: Column) -> Column:
        at = acc["at"] + F.char_length(pair["g"])
        end = at + F.char_length(pair["h"])
        one = F.array(F.struct(at.alias("start"), end.alias("end"), pair["h"].alias("hit")))
        return F.struct(end.alias("at"), F.concat(acc["out"], one).alias("out"))

    pairs = F.zip_with(hits, F.slice(gaps, F.lit(1), F.size(hits)), lambda h, g: F.struct(h.alias("h"), g.alias("g")))
    return F.aggregate(pairs, start, step, lambda acc: acc["out"])


def _iban_end(longest: Column) -> Column:
    """Length of the IBAN that ``longest`` starts with, null without one.

    An upper-case word or a number may follow it, so every end at a blank is tried with mod-97; of several that
    pass, the registered length of the country wins, then the longest.
    """
    lengths = F.create_map(*[F.lit(x) for n, codes in IBAN_LENGTHS.items() for code in codes.split() for x in (code, n)])
    size = F.length(longest)

    def passes(n: Column) -> Column:
        at_end = (n <= size) & ((n == size) | (F.substr(longest, n + 1, F.lit(1)) == " "))
        hit = F.substr(longest, F.lit(1), n)
        return F.when(at_end & (F.length(F.replace(hit, F.lit(" "), F.lit(""))) >= 15), mod97_ok(hit)).otherwise(F.lit(False))

    def rank(n: Column) -> Column:
        compact = F.length(F.replace(F.substr(longest, F.lit(1), n), F.lit(" "), F.lit("")))
        return F.struct(F.coalesce(compact == F.try_element_at(lengths, F.substr(longest, F.lit(1), F.lit(2))), F.lit(False)).alias("known"), n.alias("n"))

    return F.array_max(F.transform(F.filter(F.sequence(F.lit(15), F.greatest(size, F.lit(15))), passes), rank))["n"]


def _ibans(heads: Column, text: Column) -> Column:
    """(start, end, hit) of the IBANs among the places of heads; one that starts inside another is left out."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int,hit:string>>").alias("out"))
    whole = F.transform(heads, lambda s: F.struct(s["start"].alias("start"), F.regexp_extract(F.substr(text, s["start"] + 1, F.lit(65)), IBAN, 0).alias("longest")))
    ended = F.transform(whole, lambda s: F.struct(s["start"].alias("start"), (s["start"] + _iban_end(s["longest"])).alias("end"), s["longest"].alias("hit")))

    def step(acc: Column, s: Column) -> Column:
        return F.when(s["end"].isNotNull() & (s["start"] >= acc["at"]), F.struct(s["end"].alias("at"), F.concat(acc["out"], F.array(s)).alias("out"))).otherwise(acc)

    return F.aggregate(ended, start, step, lambda acc: acc["out"])


def _confirmed(placed: Column, kind: str, text: Column, min_score: float) -> Column:
    def near(s: Column) -> Column:
        begin = F.greatest(s["start"] - CONTEXT_CHARS, F.lit(0))
        return F.lower(F.substr(text, begin + 1, s["start"] - begin)).rlike(CONTEXT[kind])

    ok = _ibans(placed, text) if kind == "iban" else F.filter(placed, lambda s: _valid(kind, s["hit"]))
    scored = F.transform(
        ok,
        lambda s: F.struct(
            s["start"].alias("start"),
            s["end"].alias("end"),
            F.lit(KINDS.index(kind)).alias("kind"),
            F.least(F.lit(1.0), F.lit(SCORE[kind]) + F.when(near(s), F.lit(CONTEXT_BONUS)).otherwise(F.lit(0.0))).alias("score"),
        ),
    )
    return scored if kind in BASE else F.filter(scored, lambda s: s["score"] >= min_score)


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_score: float = 0.6) -> DataFrame:
    """id and ``spans``: (start, end, kind number, score) ordered by start, then kind."""
    df = docs.select(F.col(id_col), text_or_empty(text_col).alias("_t"))
    df = df.withColumn("_digit", F.col("_t").rlike("[0-9]"))
    none = F.array().cast("array<string>")
    for k in KINDS:
        maybe = F.col("_digit") if k in DIGIT_KINDS else F.col("_t").contains(NEEDS[k])
        df = df.withColumn(f"_h_{k}", F.when(maybe, F.regexp_extract_all("_t", F.lit(PATTERNS[k]), F.lit(0))).otherwise(none))
    empty = F.array().cast(SPANS)
    for k in KINDS:
        gaps = F.split("_t", PATTERNS[k], -1)
        found = _confirmed(_placed(F.col(f"_h_{k}"), gaps, k), k, F.col("_t"), min_score)
        df = df.withColumn(f"_s_{k}", F.when(F.size(f"_h_{k}") > 0, found.cast(SPANS)).otherwise(empty))
    every = F.concat(*[F.col(f"_s_{k}") for k in KINDS])
    by_place = F.transform(F.array_sort(F.transform(every, lambda s: F.struct(s["start"], s["kind"], s["end"], s["score"]))), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"), s["score"].alias("score")))
    return df.select(id_col, by_place.alias("spans"))


def written(spans: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])), ",")


def of_kind(spans: Column, kind: str) -> Column:
    return F.filter(spans, lambda s: s["kind"] == KINDS.index(kind))


def redact(text: Column, spans: Column) -> Column:
    """``text`` with every span replaced by its kind in brackets; of overlapping spans the first wins."""
    names = F.array(*[F.lit(f"[{k}]") for k in KINDS])
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        before = F.substr(text, acc["at"] + 1, F.greatest(s["start"] - acc["at"], F.lit(0)))
        taken = F.struct(s["end"].alias("at"), F.concat(acc["out"], before, F.element_at(names, s["kind"] + 1)).alias("out"))
        return F.when(s["start"] >= acc["at"], taken).otherwise(acc)

    return F.aggregate(spans, start, step, lambda acc: F.concat(acc["out"], F.substr(text, acc["at"] + 1)))
