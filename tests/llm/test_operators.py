"""Operators against brute force, on odd rows and on empty tables."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from blockwise.llm import chat_format, exact_dedup, mixing, ngram_join, packing, pii, quality_rules, queries, suffix_dedup, token_counts, toxicity
from blockwise.llm.common import skew_left_join
from tests.llm import brute

SF = "/root/testdata/sf0.001"
BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")


def texts(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


# ------------------------------------------------------------ 1 toxicity


def test_restores_obfuscated_words(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    r = toxicity.Restorer(toxicity.language_model(toxicity.letter_grams(docs)))
    for given, plain in {"i d i o t": "idiot", "m0r0n": "moron", "stuuuupid": "stupid", "$cum": "scum", "cl0wn": "clown"}.items():
        words, n = toxicity.restored_words(f"of the {given} and", r)
        assert plain in words and n == 1
    assert toxicity.restored_words("plain words of the text", r)[1] == 0


OBFUSCATED = {
    "a55": "ass", "id10+": "idiot", "idi07": "idiot", "hat3": "hate", "1053r": "loser", "$$$cum": "scum", "a s s": "ass", "d i e": "die",
    "i,d,i,o,t": "idiot", "i/d/i/o/t": "idiot", "i|d|i|o|t": "idiot", "i   d   i   o   t": "idiot", "i\nd\ni\no\nt": "idiot",
    "st.up.id": "stupid", "st up id": "stupid", "m-oron": "moron", "idioot": "idiot", "StuUupid": "stupid",
}


def test_every_obfuscated_form_is_proposed(spark):
    plain = "you are an idiot and a loser whom they hate , an ass that may die , scum of the town , a moron so stupid that we left"
    docs = spark.createDataFrame([(i, plain) for i in range(200)], "doc_id long, text string")
    r = toxicity.Restorer(toxicity.language_model(toxicity.letter_grams(docs)))
    for given, word in OBFUSCATED.items():
        words, n = toxicity.restored_words(f"they left {given} whom we", r)
        assert word in words and n == 1, given
    assert toxicity.restored_words(plain, r)[1] == 0
    long = " ".join(["a" * 3000, "a." * 3000, "a1" * 3000, "$" * 3000, "a" + "-" * 3000])
    assert toxicity.restored_words(long, r)[0]


def test_letter_grams_are_counted_over_everything(spark):
    docs = spark.createDataFrame([(1, "Aab"), (2, None), (3, "aab.")], "doc_id long, text string")
    got = {r.gram: r.n for r in toxicity.letter_grams(docs).collect()}
    gram = lambda *s: int(np.dot(s, [32**3, 32**2, 32, 1]))
    assert got[gram(0, 1, 1, 2)] == 2


def test_toxicity_holds_out_and_separates(spark):
    out = queries.op1_toxicity(spark, "/root/testdata/sf0.01").toPandas()
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").toPandas()
    assert (out.held_out == out.doc_id.map(lambda d: zlib.crc32(str(d).encode()) % 4 == 2)).all()
    m = out.merge(labels, on="doc_id")
    m = m[m.held_out]
    assert out.score.between(0, 1).all() and (m[m.toxic == 0].predicted == 0).mean() > 0.97
    assert (m[m.toxic == 1].predicted == 1).mean() > 0.5


def test_toxicity_odd_and_empty(odd_docs, no_docs, no_labels):
    rows = toxicity.toxicity(odd_docs, no_labels).collect()
    assert len(rows) == 12 and all(r.score == 0 and r.predicted == 0 for r in rows)
    assert toxicity.toxicity(no_docs, no_labels).count() == 0


# ------------------------------------------------------------ 2 token counts


def test_every_prefix_has_the_librarys_count():
    counter, library, rng = token_counts.PrefixCounter(BYTE), Tokenizer.from_file(BYTE), random.Random(1)
    parts = ["'s", "'", "re", "ll", " ", "  ", "\n", "a", "the", "é", "12", "!", "<|endoftext|>", "-", "日", "²", "\x1c"]
    for _ in range(150):
        t = "".join(rng.choice(parts) for _ in range(rng.randint(0, 12)))
        assert counter.prefix_counts(t) == [len(library.encode(t[:i], add_special_tokens=False).ids) for i in range(len(t) + 1)], t


def test_token_counts_odd_rows(odd_docs, no_docs):
    library = Tokenizer.from_file(BYTE)
    out = token_counts.token_counts(odd_docs, BYTE, limit=20, store_prefixes=True)
    given = Counter((d, len(library.encode(t or "", add_special_tokens=False).ids)) for d, t in texts(odd_docs))
    rows = out.select("*", token_counts.longest_prefix(out["prefix_counts"], 20).alias("cut")).collect()
    assert Counter((r.doc_id, r.n_tokens) for r in rows) == given
    assert all(r.cut_chars == r.cut and r.over_limit == (r.n_tokens > 20) for r in rows)
    assert token_counts.token_counts(no_docs, BYTE).count() == 0


# ------------------------------------------------------------ 3 packing


def check_packing(rows, given):
    library = Tokenizer.from_file(WORD)
    want = Counter()
    for d, t in given:
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 2]
        for s in range(0, len(ids), 4096):
            part = ids[s : s + 4096]
            want[d, s, len(part), zlib.crc32(np.array(part, "<u4").tobytes()), len(ids)] += 1
    assert Counter((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in rows) == want
    sequences = {}
    for r in sorted(rows, key=lambda r: r.offset):
        assert r.offset == sequences.get(r.sequence_id, 0)
        sequences[r.sequence_id] = r.offset + r.length
    assert all(n <= 4096 for n in sequences.values())
    return sum(4096 - n for n in sequences.values()) / max(1, 4096 * len(sequences))


def test_packing(spark, odd_docs, no_docs):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert check_packing(packing.pack_documents(docs, WORD).collect(), texts(docs)) < 0.05
    check_packing(packing.pack_documents(odd_docs, WORD).collect(), texts(odd_docs))
    assert packing.pack_documents(no_docs, WORD).count() == 0


def test_ranks_in_blocks_fill_every_slot_once(spark, monkeypatch):
    monkeypatch.setattr(packing, "RANK_BLOCK", 7)
    pieces = spark.createDataFrame([(i, 0, 1 + i % 3, i, 1) for i in range(200)], "doc_id long, start long, length long, ids_crc32 long, doc_tokens long")
    rows = packing.pack(pieces, max_len=10).collect()
    ends = Counter()
    for r in sorted(rows, key=lambda r: r.offset):
        assert r.offset == ends[r.sequence_id]
        ends[r.sequence_id] += r.length
    assert len(rows) == 200 and max(ends.values()) == 10


# ------------------------------------------------------------ 4 personal data


ODD_PII = [
    "a@b.c_d@e.f x..@y-z.q.w 1.2.3.4.5.6.7.8 256.1.1.1 0001.02.3.255", "a@b.c@d.e a@b.c.@x.y +1" + " " * 3000 + "2345678901",
    "+1 (234) 567-8901 +12 34 4111 1111 1111 1111 4111-1111-1111-1112", "é@x.de GB82 WEST 1234 5698 7654 32 ssn 123-45-6789 and 987-65-4321 @ +49",
    "a" * 50_000 + "@b.c" + ".d" * 20_000 + " " + "1 " * 20_000, "",
]


def test_pii_against_brute_force(spark, odd_docs, no_docs):
    docs = spark.createDataFrame(list(enumerate(ODD_PII)), "doc_id long, text string")
    docs = docs.union(odd_docs.select("doc_id", "text")).union(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text"))
    found = pii.find_pii(docs)
    names = [found.doc_id, *[queries.F.size(pii.of_kind(found.spans, k)).alias(k) for k in pii.BASE]]
    base = queries.F.filter(found.spans, lambda s: s["kind"] < len(pii.BASE))
    got = Counter((r.doc_id, r.email, r.ip, r.card, r.phone, r.h) for r in found.select(*names, queries.F.sha2(pii.written(base), 256).alias("h")).collect())
    want = Counter((d, *counts.values(), h) for d, t in texts(docs) for counts, h in [brute.base_pii(t)])
    assert got == want
    assert pii.find_pii(no_docs).count() == 0


def test_pii_checksums_and_context(spark):
    docs = spark.createDataFrame([(1, ODD_PII[3]), (2, "GB82 WEST 1234 5698 7654 33 id 987-65-4321")], "doc_id long, text string")
    out = {r.doc_id: r.w for r in pii.find_pii(docs).select("doc_id", pii.written(queries.F.col("spans")).alias("w")).collect()}
    assert out[1].startswith("iban:7:34,ssn:39:50") and out[2] == ""
    assert brute.mod97("GB82 WEST 1234 5698 7654 32")
    both = docs.join(pii.find_pii(docs), "doc_id").where("doc_id = 1")
    assert "[iban]" in both.select(pii.redact(queries.F.col("text"), queries.F.col("spans")).alias("r")).first().r


def test_iban_ends_before_a_word_or_a_number(spark):
    wide, narrow = "GB82 WEST 1234 5698 7654 32", "GB82WEST12345698765432"
    given = [f"{wide} BIC WESTGB2L", f"{narrow} USD 500", f"{narrow} 500", f"ID12 ORDER {wide} and", f"{wide} {narrow}", f"{wide}X", f"{wide[:-1]}3 BIC", "NO93 8601 1117 947 KR 100 NOK"]
    docs = spark.createDataFrame(list(enumerate(given)), "doc_id long, text string")
    out = pii.find_pii(docs).select("doc_id", pii.written(pii.of_kind(queries.F.col("spans"), "iban")).alias("w"))
    got = {r.doc_id: r.w for r in out.collect()}
    assert [got[i] for i in range(len(given))] == ["iban:0:27", "iban:0:22", "iban:0:22", "iban:11:38", "iban:0:27,iban:28:50", "", "", "iban:0:18"]


# ------------------------------------------------------------ 5 n-gram join


def near_texts(n=60, seed=5):
    rng, out = random.Random(seed), []
    for g in range(n):
        words = [f"w{rng.randint(0, 400)}" for _ in range(rng.randint(20, 120))]
        for _ in range(rng.choice([1, 1, 2, 5])):
            copy = list(words)
            for _ in range(rng.randint(0, 3)):
                copy[rng.randrange(len(copy))] = f"x{rng.randint(0, 9999)}"
            out.append(" ".join(copy))
    return [(i, t) for i, t in enumerate(out)]


def expected_classes(rows, links):
    sets, parent = {d: brute.shingles(t) for d, t in rows}, {d: d for d, _ in rows}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    first = {}
    pairs = [(first.setdefault(sets[d], d), d) for d, _ in sorted(rows)]
    for a, b in [*pairs, *links]:
        a, b = sorted((top(a), top(b)))
        parent[b] = a
    degree, size = Counter(x for p in links for x in p), Counter(sets.values())
    return {d: (top(d), degree[d] + size[sets[d]] - 1) for d, _ in rows}


@pytest.mark.parametrize("cell", [1000, 2])
def test_near_duplicates_against_brute_force(spark, cell):
    rows = [*near_texts(), (900, None), (901, ""), (902, "One two"), (903, "one  TWO")]
    out = ngram_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), cell=cell).collect()
    want = expected_classes(rows, brute.jaccard_links(rows))
    got = {r.doc_id: (r.class_id, r.n_links) for r in out}
    assert sum(got[d] == want[d] for d in want) >= 0.98 * len(want)
    assert sum(n for _, n in got.values()) >= 0.95 * sum(n for _, n in want.values()) and all(got[d][1] <= want[d][1] for d in want)


def test_prefix_is_shortened_until_the_recall():
    assert ngram_join.recall_at(ngram_join.prefix_length()) >= ngram_join.RECALL > ngram_join.recall_at(ngram_join.prefix_length() + 1)


def test_near_duplicates_odd_and_empty(odd_docs, no_docs):
    out = {r.doc_id: r for r in ngram_join.near_duplicates(odd_docs).collect()}
    assert out[None].class_id is None and out[1].class_id == out[2].class_id == 1 and out[3].class_id == out[5].class_id == 3
    assert out[6].class_id == out[7].class_id == 6 and out[8].n_links == 1
    kept = ngram_join.drop_near_duplicates(odd_docs)
    assert kept.columns == odd_docs.columns and sorted(str(r.doc_id) for r in kept.collect()) == sorted(["1", "3", "6", "8", "8", "9", "None", "10"])
    assert ngram_join.near_duplicates(no_docs).count() == 0


# ------------------------------------------------------------ 6 exact dedup


@pytest.mark.parametrize("share", [0.001, 1.0])
def test_exact_dedup(spark, odd_docs, no_docs, share):
    rows = [(i, random.Random(i % 7).choice(["a b", "ab", " a b ", "c", None, ""])) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    norm = lambda t: brute.re.sub("[\x20\x09-\x0d]", "", t or "")
    groups = {}
    for d, t in rows:
        groups.setdefault(norm(t), []).append((-len(t or ""), d))
    for r in exact_dedup.exact_dedup(docs, hot_share=share).collect():
        group = groups[norm(dict(rows)[r.doc_id])]
        assert (r.keep_id, r.group_size, r.kept) == (min(group)[1], len(group), r.doc_id == min(group)[1])
        assert r.text_sha256 == hashlib.sha256(norm(dict(rows)[r.doc_id]).encode()).hexdigest()
    kept = exact_dedup.drop_exact_duplicates(odd_docs, hot_share=share)
    assert kept.columns == odd_docs.columns and sorted(str(r.doc_id) for r in kept.collect()) == sorted(["2", "5", "6", "7", "8", "9", "None", "10"])
    assert exact_dedup.exact_dedup(no_docs).count() == 0


# ------------------------------------------------------------ 7 chat


def test_chat_round_trip(spark):
    rng = random.Random(2)
    bits = ["\\", "#", "<", "h", "l", "c", ":", "### ", "</turn>", " </turn>\n", "a", "\n", " ", "é"]
    rows = [(c, t, rng.choice(["user", "assistant", "a: b"]), "".join(rng.choice(bits) for _ in range(rng.randint(0, 12)))) for c in range(40) for t in range(rng.randint(1, 6))]
    rows += [(50, 0, None, None), (50, None, "user", "x"), (None, 0, "assistant", "y"), (51, 0, "user", "same"), (51, 0, "user", "same")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = chat_format.format_chat(turns)
    F = queries.F
    read = out.select("conv_id", chat_format.read_turns(F.col("formatted")).alias("t"), chat_format.loss_texts(F.col("formatted"), F.col("loss_mask")).alias("loss")).collect()
    want = {}
    for c, t, r, x in sorted(rows, key=lambda v: (str(v[0]), -1 if v[1] is None else v[1], v[2] or "", v[3] or "")):
        want.setdefault(c, []).append((r or "", x or ""))
    assert {r.conv_id: [tuple(t) for t in r.t] for r in read} == want
    assert {r.conv_id: r.loss for r in read} == {c: [x for r, x in v if r == "assistant"] for c, v in want.items()}


def test_layouts_by_fingerprint(spark):
    records = [
        (1, '{"messages":[{"role":"user","content":"q"},{"role":"assistant","content":"a"}]}'), (2, '{"conversations":[{"from":"human","value":"q"},{"from":"gpt","value":"a"}]}'),
        (3, '{"instruction":"q","input":"","output":"a"}'), (4, '{"completion":"a","prompt":"q"}'), (5, '{"other":1}'), (6, None), (7, '{"instruction":"q","input":"i","output":"a"}'),
    ]
    out = {}
    for r in chat_format.turns_from_json(spark.createDataFrame(records, "conv_id long, record string")).orderBy("conv_id", "turn").collect():
        out.setdefault(r.conv_id, []).append((r.role, r.text))
    plain = [("user", "q"), ("assistant", "a")]
    assert out[1] == out[2] == out[3] == out[4] == plain and out[7][0] == ("user", "q\n\ni")
    assert out[5] == [("unknown", '{"other":1}')] and out[6] == [("unknown", None)]
    table = spark.createDataFrame([(1, "q", "a", 5)], "conv_id long, prompt string, completion string, turn long")
    assert [(r.role, r.text) for r in chat_format.canonical_turns(table).orderBy("turn").collect()] == plain
    assert chat_format.format_chat(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def test_other_fields_do_not_hide_a_layout(spark):
    records = [
        (1, '{"id":7,"messages":[{"role":"user","content":"q","name":"n"},{"role":"assistant","content":"a"}]}'),
        (2, '{"instruction":"q","input":"i","output":"a","source":"s"}'), (3, '{"system":"s","prompt":"q","response":"a","id":1}'),
    ]
    out = {}
    for r in chat_format.turns_from_json(spark.createDataFrame(records, "conv_id long, record string")).orderBy("conv_id", "turn").collect():
        out.setdefault(r.conv_id, []).append((r.role, r.text))
    assert out == {1: [("user", "q"), ("assistant", "a")], 2: [("user", "q\n\ni"), ("assistant", "a")], 3: [("system", "s"), ("user", "q"), ("assistant", "a")]}
    for name, (paths, _) in chat_format.LAYOUTS.items():
        known = chat_format.fingerprint(queries.F.array(*[queries.F.lit(p) for p in paths]))
        assert spark.range(1).select(known.alias("f")).first().f == chat_format.FINGERPRINTS[name]


# ------------------------------------------------------------ 8 quality


def test_quality_counts_against_brute_force(spark, odd_docs, no_docs, no_labels):
    docs = odd_docs.select("doc_id", "text").union(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text"))
    out = quality_rules.statistics(docs).collect()
    assert Counter((r.doc_id, *[r[c] for c in quality_rules.COUNTS]) for r in out) == Counter((d, *brute.base_quality(t)) for d, t in texts(docs))
    ruled = quality_rules.quality_rules(odd_docs, no_labels).collect()
    assert all(r.kept != r.base_failed for r in ruled) and quality_rules.quality_rules(no_docs, no_labels).count() == 0


def test_trees_are_monotonic_and_flat():
    rng = np.random.default_rng(0)
    x = rng.random((2000, 3))
    y = ((x[:, 0] < 0.5) ^ (rng.random(2000) < 0.1)).astype(float)
    trees = quality_rules.fit_trees(x, y, [-1, 0, 0], trees=20)
    grid = np.stack([np.linspace(0, 1, 200), np.full(200, 0.3), np.full(200, 0.7)], axis=1)
    assert (np.diff(trees.score(grid)) <= 1e-12).all() and ((trees.score(x) > 0.5) == (x[:, 0] < 0.5)).mean() > 0.97
    assert quality_rules.fit_trees(x, np.ones(2000), [0, 0, 0]) is None


def test_quality_held_out(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    model = quality_rules.fit_quality(docs, labels.where("doc_id % 2 = 0"))
    rows = quality_rules.statistics(docs, model=model).join(labels.where("doc_id % 2 = 1"), "doc_id").toPandas()
    assert ((rows.score >= 0.5) == (rows.quality == 1)).mean() > 0.95


# ------------------------------------------------------------ 9 repeated strings


def test_two_stage_sort():
    rng = random.Random(3)
    for _ in range(40):
        s = np.array([rng.choice([0, 1, 2, 3]) for _ in range(rng.randint(1, 200))], np.uint8)
        order = suffix_dedup.two_stage_sort(s, 16)
        keys = [bytes(s)[i : i + 16] for i in order]
        assert sorted(order) == list(range(len(s))) and all(a <= b for a, b in zip(keys, keys[1:], strict=False))


@pytest.mark.parametrize("hot", [20_000, 2])
def test_repeats_against_brute_force(spark, monkeypatch, hot):
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    rng = random.Random(3)
    passages = ["".join(rng.choice("abcdefgh é\n") for _ in range(rng.randint(90, 300))) for _ in range(5)]
    rows = []
    for d in range(120):
        t = ""
        for _ in range(rng.randint(0, 4)):
            x, a = rng.choice(passages), rng.randint(0, 60)
            t += rng.choice([x, x[a:], x[: -a or None], "z" * rng.randint(0, 250), "".join(rng.choice("xyzw") for _ in range(rng.randint(0, 150)))])
        rows.append((d, t))
    rows += [(900, None), (901, ""), (902, "q" * 3000), (903, "ab" * 300)]
    out = suffix_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    gone = brute.removed_bytes([(d, (t or "").encode()) for d, t in rows])
    for r in out:
        raw, g = (dict(rows)[r.doc_id] or "").encode(), gone[r.doc_id]
        kept = bytes(b for b, x in zip(raw, g, strict=True) if not x)
        runs = sum(x and not (i and g[i - 1]) for i, x in enumerate(g))
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == (len(raw), sum(g), runs, hashlib.sha256(kept).hexdigest())
    assert len(out) == len(rows)


def test_repeats_odd_and_empty(odd_docs, no_docs):
    out = {r.doc_id: r for r in suffix_dedup.remove_repeats(odd_docs).collect()}
    assert len(out) == 11 and out[3].n_bytes == 0 and out[7].n_removed > 0.99 * (out[7].n_bytes - 4)
    assert suffix_dedup.remove_repeats(no_docs).count() == 0


# ------------------------------------------------------------ 10 mixing


def test_targets_reshare_the_excess():
    t = mixing.source_targets([("b", 100), ("a", 1000), (None, 10), ("c", 0)])
    assert t["b"] == pytest.approx(300) and t[None] == pytest.approx(30) and t["c"] == 0 and t["a"] == pytest.approx(780)
    assert mixing.source_targets([]) == {}


def test_flight_keeps_both_totals():
    rng = np.random.default_rng(1)
    p, size = np.full(500, 0.37), rng.integers(0, 900, 500).astype(float)
    out = mixing.flight(p, size, rng.random(500))
    assert ((out > 1e-9) & (out < 1 - 1e-9)).sum() <= 2 and out.sum() == pytest.approx(p.sum()) and (out * size).sum() == pytest.approx((p * size).sum())


def test_mix_is_near_its_targets_and_repeatable(spark, odd_docs, no_docs):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = mixing.mix(mixing.sized(docs), block=5).toPandas()
    again = mixing.mix(mixing.sized(docs.repartition(7)), block=5).toPandas()
    key = ["doc_id", "copies"]
    assert sorted(map(tuple, rows[key].to_numpy())) == sorted(map(tuple, again[key].to_numpy()))
    words = {d: len(brute.WORD.findall(t or "")) for d, t in texts(docs)}
    assert all(words[r.doc_id] == r.size for r in rows.itertuples()) and rows.copies.between(0, 3).all()
    rows["taken"] = rows["size"] * rows["copies"]
    for (_, target), g in rows.groupby(["source_size", "target"]):
        assert abs(g.taken.sum() - target) <= g["size"].max()
    mixed = mixing.mix_documents(odd_docs)
    assert mixed.columns == odd_docs.columns and mixing.mix_documents(no_docs).count() == 0
    copies = Counter(r.doc_id for r in mixed.collect())
    assert copies == Counter({r.doc_id: c for r, c in [(r, r.copies) for r in mixing.mix(mixing.sized(odd_docs)).groupBy("doc_id").agg(queries.F.sum("copies").alias("copies")).collect()] if c})


# ------------------------------------------------------------ shared


def test_skew_join_equals_plain_join(spark):
    big = spark.range(1000).selectExpr("id", "if(id % 3 = 0, 7, id) AS k")
    small = spark.range(0, 1000, 2).selectExpr("id AS k", "id * 2 AS v").union(spark.createDataFrame([(7, -1)], "k long, v long"))
    got = Counter(tuple(r) for r in skew_left_join(big, small, "k", 0.01).select("id", "k", "v").collect())
    assert got == Counter(tuple(r) for r in big.join(small, "k", "left").select("id", "k", "v").collect())
