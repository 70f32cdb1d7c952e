"""Prefix trie, HyperMinHash components and whitening against brute force, on odd rows and empty tables."""

import random
import tracemalloc

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from blockwise.llm import hyperminhash, linking, ngram_join, packing, pii, prefix_trie, queries, token_counts, toxicity, whitening
from blockwise.llm.common import Generations, frequent_keys
from blockwise.llm.shingles import shingle_hashes
from tests.llm import brute

SF01 = "/root/testdata/sf0.01"
WORD_FILE = public_tokenizers.path("word_bpe_49k.json")

# ------------------------------------------------------------ 11 prefix trie

NODE = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
CONVERSATIONS = "conv_id long, turn long, role string, text string"


def nodes(df):
    return sorted(tuple(r[c] for c in NODE) for r in df.collect())


def odd_conversations():
    rng, rows = random.Random(5), []
    for c in range(160):
        n = rng.choice([1, 2, 3, 9, 17, 40])
        rows += [(c, t, rng.choice("ua"), rng.choice(["x", "yy"]) if t < 6 else str(t % 3)) for t in range(n)]
    rows += [(c, t, "u", "same" * (t % 5)) for c in (500, 507, 533) for t in range(60)]  # equal and long: several blocks
    rows += [(None, 1, "u", "x"), (700, None, None, None), (700, None, "u", None), (700, 1, "u", "é日")]
    rows += [(701, 2, "b", "b"), (701, 2, "b", "b"), (701, 2, "a", "c"), (9001, 0, "u", "z")]  # ties, a repeated row, a turnless one
    return rows


@pytest.mark.parametrize("every, width, span", [(100, 8, 1024), (None, 8, 1024), (100, 2, 2)])
def test_trie_against_brute_force(spark, every, width, span):
    rows = odd_conversations()
    df = spark.createDataFrame(rows, CONVERSATIONS).repartition(7)
    df = df.selectExpr("*", "1 AS pos", "'k' AS id", "2 AS depth", "3 AS block", "4 AS t0")  # clashing names
    got = nodes(prefix_trie.prefix_trie(df, every, width=width, span=span))
    assert got == brute.prefix_trie(brute.rebuilt_turns(rows, every))


def test_one_conversation_over_many_partitions_and_long_texts(spark):
    rows = [(3, t, "u", str(t % 7) * (2000 if t == 5 else 1)) for t in range(3000)] + [(4, 0, "u", "0")]
    df = spark.createDataFrame(rows, CONVERSATIONS)
    turns = {(r.conv_id, r.pos): r.chars for r in prefix_trie.numbered(prefix_trie.turns_of(df)).collect()}
    assert turns == {(c, t): len(x) for c, t, _, x in rows}
    assert nodes(prefix_trie.prefix_trie(df, span=16)) == brute.prefix_trie(brute.rebuilt_turns(rows, None))


def test_ends_are_hashed_in_pieces(spark):
    import hashlib

    df = spark.range(0, 2500).selectExpr("id % 2 AS conv_id", "cast(7 as long) AS depth", "id AS end")
    got = {r.conv_id: r.ends_sha256 for r in prefix_trie.ends(df, piece=100).collect()}
    assert got == {k: hashlib.sha256(",".join(str(i) for i in range(k, 2500, 2)).encode()).hexdigest() for k in (0, 1)}


def test_trie_of_nothing(spark):
    assert prefix_trie.prefix_trie(spark.createDataFrame([], CONVERSATIONS), 100).count() == 0


# ------------------------------------------------------------ 12 HyperMinHash


def near_rows(seed=3):
    rng, rows = random.Random(seed), []
    words = [f"w{k}" for k in range(300)]
    for _ in range(30):
        n = rng.choice([3, 5, 6, 9, 12, 20, 60, 200])
        base = [rng.choice(words) for _ in range(n)]
        for _ in range(rng.choice([1, 2, 5, 30])):
            w = list(base)
            for _ in range(rng.choice([0, 1, 1, 2, 3])):
                w[rng.randrange(n)] = rng.choice(words)
            rows.append((len(rows), " ".join(w)))
    return rows


def as_rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.mark.parametrize("cell, piece", [(1000, 200), (3, 2)])
def test_components_against_brute_force(spark, cell, piece):
    rows = [*near_rows(), (900, None), (901, ""), (902, "One two"), (903, "one  TWO"), (904, "ONE two É"), (905, "one two é")]
    out = hyperminhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), cell=cell, piece=piece)
    assert as_rows(out) == sorted(brute.components(rows, 85), key=str)


def test_components_of_odd_rows(odd_docs, no_docs, spark):
    rows = [(r.doc_id, r.text) for r in odd_docs.collect()]
    assert as_rows(hyperminhash.near_duplicates(odd_docs)) == sorted(brute.components(rows, 85), key=str)
    assert hyperminhash.near_duplicates(no_docs).count() == 0
    # copies edited apart hang together by the text that they come from, which is not the smallest
    base = [f"b{i}" for i in range(200)]
    edited = [[*base[:k], f"x{k}", f"y{k}", *base[k + 2 :]] for k in range(3, 190, 6)]
    rows = [(i, " ".join(w)) for i, w in enumerate(edited)] + [(999, " ".join(base))]
    out = hyperminhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), percent=94)
    assert {r.component_id for r in out.collect()} == {0}


def test_registers_and_estimate():
    rng = np.random.default_rng(1)
    keys = np.sort(rng.integers(0, 2**63, 5000, dtype=np.uint64) * np.uint64(2) + np.uint64(1))
    regs = hyperminhash.registers(keys, np.array([0, 5000]))[0]
    for b in (0, 1, 77, 127):
        first = min(int(k) for k in keys if int(k) >> 57 == b) & ((1 << 57) - 1)
        zeros = 57 - first.bit_length()
        assert regs[b] >> 10 == zeros and regs[b] & 1023 == (first << (64 - first.bit_length()) >> 53) & 1023
    # sets without a common member match as often as expected
    sets = [np.sort(rng.integers(0, 2**64, 2000, dtype=np.uint64)) for _ in range(400)]
    regs = hyperminhash.registers(np.concatenate(sets), np.arange(0, 2000 * 401, 2000))
    matches = sum((regs[i] == regs[j]).sum() for i in range(400) for j in range(i)) / (400 * 399 / 2)
    expected = float(hyperminhash.accidental(np.array([2000]), np.array([2000]))[0])
    assert abs(matches - expected) < 0.25 * expected
    keys, begins = shingle_hashes(np.frombuffer(b"a b c", np.uint8), np.array([0, 5]))
    assert len(keys) == 1 and (hyperminhash.filled(hyperminhash.registers(keys, begins)) != hyperminhash.EMPTY).all()


def test_rows_under_one_id_are_linked_by_their_text(spark):
    a, u = " ".join(f"a{i}" for i in range(60)), " ".join(f"u{i}" for i in range(60))
    rows = [(1, a), (5, f"{a} x"), (5, u), (7, f"{u} y"), (None, f"n {a}"), (None, f"{u} q r"), (None, "z z z"), (8, "z z z"), (None, "k l m n o p"), (None, "k l m n o p")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    kept = sorted((str(r.doc_id), r.text) for r in ngram_join.drop_near_duplicates(df).collect())
    assert kept == sorted([("1", a), ("5", u), ("8", "z z z"), ("None", "k l m n o p"), ("None", "k l m n o p")])
    assert ngram_join.near_duplicates(df).count() == len(rows)  # equal rows repeat their row, as exact dedup settles them


def test_recall_of_the_forest_on_the_given_documents(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF01}/documents.parquet").collect()]
    out = queries.op5_ngram_jaccard(spark, SF01).collect()
    links = brute.jaccard_links(docs)
    of = {r.doc_id: r.class_id for r in out}
    assert len(out) == len(docs) and sum(of[a] == of[b] for a, b in links) >= 0.95 * len(links)


def test_frequent_binary_keys_are_counted_by_value(spark):
    df = spark.range(0, 3000).selectExpr("unhex(md5(cast(id % 3 as string))) AS k")
    assert len(frequent_keys(df, "k")) == 3


# ------------------------------------------------------------ 13 whitening


def reference_whitening(x, k=16):
    fit = np.unique(x, axis=0)
    n, s = len(fit), fit.sum(axis=0)
    centred = (n * fit - s) / n
    e, v = np.linalg.eigh(centred.T @ centred / n)
    e, v = e[::-1], v[:, ::-1]
    return n, [sum(int(z) ** 2 for z in row) for row in (n * x - s).tolist()], ((n * x - s) / n) @ v[:, :k] / np.sqrt(e[:k]), e / e.sum()


def test_whitening_against_eigh(spark):
    rng = np.random.default_rng(2)
    vectors = rng.normal(size=(400, 24)) @ rng.normal(size=(24, 24)) * np.geomspace(3, 0.05, 24)
    vectors = np.concatenate([vectors, vectors[:150], vectors[:1].repeat(100, axis=0)])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>").repartition(5)
    out = whitening.whitened(df).toPandas().sort_values(["vec_id", "component"])
    n, deviation, white, explained = reference_whitening(np.floor(64 * vectors).astype(np.int64) + 1_000_000)
    got = out.whitened.to_numpy().reshape(-1, 16)
    assert (out.n == n).all() and n == 400 and out.deviation.to_numpy().reshape(-1, 16)[:, 3].tolist() == deviation
    sign = np.sign((got * white).sum(axis=0))
    assert np.abs(got * sign - white).max() < 1e-8 and out.identity_error.max() < 1e-9
    assert np.abs(out.explained.to_numpy()[:16] / explained[:16] - 1).max() < 1e-9


def test_whitening_of_dependent_and_odd_vectors(spark):
    rng = np.random.default_rng(1)
    flat = np.round(rng.normal(size=(200, 3)) * 64) / 64 @ np.array([[1, 0, 1, 0], [0, 1, 1, 0], [0, 0, 0, 5]])
    df = spark.createDataFrame([(i, [*v, 2.0]) for i, v in enumerate(flat.tolist())], "vec_id long, embedding array<double>")
    out = whitening.whitened(df).toPandas()
    assert out.component.max() == 3 and out.identity_error.max() < 1e-9 and abs(out.explained[:3].sum() - 1) < 1e-9
    rows = [(1, [1.0, 2.0]), (2, [3.0, 2.0]), (2, [3.0, 2.0]), (None, [0.0, 2.0]), (3, None), (4, [1.0, None]), (5, [float("inf"), 1.0]), (6, [1.0]), (7, []), (8, [float("nan"), 1.0]), (9, [1e300, 0.0])]
    odd = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 AS x", "2 AS n")
    got = sorted(((r.vec_id, r.component, r.n, r.deviation) for r in whitening.whitened(odd).collect()), key=str)
    assert got == sorted([(1, 1, 3, 4096), (2, 1, 3, 102400), (2, 1, 3, 102400), (None, 1, 3, 65536)], key=str)
    assert whitening.whitened(odd.limit(0)).count() == 0 and whitening.whitened(odd.where("vec_id = 2")).count() == 0


def test_exact_deviations_beyond_a_long():
    x = np.array([[2**45, 0], [0, 2**45]])
    dev = whitening._deviations(x, 10**6, [5, 7])
    assert whitening._squares(dev) == [sum((10**6 * int(v) - s) ** 2 for v, s in zip(row, (5, 7), strict=True)) for row in x]


# ------------------------------------------------------------ changed helpers


def test_white_space_before_special_strings_counts_as_the_library():
    import public_tokenizers

    counter = token_counts.PrefixCounter(public_tokenizers.path("byte_bpe_50k.json"))
    for text in ("\n\n\x1c<|endoftext|>", "a \x1c<|endoftext|> \x1f b", "  \x1d x <|endoftext|> \x1e", "<|endoftext|>\x85 \x1c", "\x1c \x1d<|endoftext|>"):
        assert counter.prefix_counts(text)[-1] == len(counter.library.encode(text, add_special_tokens=False).ids)


def test_generations_keep_what_is_asked_for():
    made = []
    g = Generations(lambda k: made.append(k) or k.upper(), 3)
    for k in "abcadaeafagahai":
        assert g[k] == k.upper()
    assert made.count("a") == 1 and len(g.young) <= 3 and len(g.old) <= 3


def test_decoding_is_exact_without_a_beam():
    """Every way through a short place, by brute force."""
    rng = np.random.default_rng(3)
    r = toxicity.Restorer(np.log(rng.dirichlet(np.ones(32), 32**3)).astype(np.float32))

    def paths(place, i, state, score, out):
        if i == len(place):
            yield (score + (r.model[state * 32] if state & 31 else 0.0)), out.strip()
            return
        for x, cost in r.arcs(place, i):
            k = toxicity.symbol(x) if x else -1
            if k < 0 or (k == 0 and not state & 31):
                yield from paths(place, i + 1, state, score - cost, out)
            else:
                yield from paths(place, i + 1, ((state << 5) & 32767) + k, score - cost + r.model[state * 32 + k], out + x)

    for place in ("1d10t", "a55 ho", "m.o.r", "$cu!m", "b4a4d"):
        best = max(paths(place, 0, 0, 0.0, ""))[0]
        assert any(s > best - 1e-4 and out == r.decode(place) for s, out in paths(place, 0, 0, 0.0, ""))


def test_texts_read_by_tokens_are_read_whole():
    """Tokens and runs across white space against the places and words of the whole text, worked out one by one."""
    rng = np.random.default_rng(5)
    model = np.log(rng.dirichlet(np.ones(32) / 8, 32**3) + 1e-9).astype(np.float32)
    r, chars = toxicity.Restorer(model, {"aab": 1.5}), list("aab.e s5$ \n-_'éя!i|7 2t,\x1c ß")
    assert not r.token.young
    for _ in range(300):
        text = "".join(rng.choice(chars, rng.integers(0, 40)))
        written, plain = toxicity.WORDS.findall(text.lower()), toxicity.Restorer(model)
        outs = [o for p in plain.places(text.lower()) if (o := plain.restored(p)) is not None]
        outs += [o for w in written if toxicity.DOUBLED.search(w) and (o := " ".join(plain.decode(w).split())) != w]
        words = set(written).union(*(o.split() for o in outs))
        assert r.read(text) == (words, {w: 1.5 for w in words if w == "aab"}, len(outs)), text
    assert r.token.young


def test_marks_of_both_fits_are_counted_at_once(spark):
    rows = spark.createDataFrame([(1, 0, ["bad"]), (1, 3, ["bad"]), (0, 0, ["bad", "good"]), (0, 3, ["good"])], "y int, part int, words array<string>")
    got = {r.mark: (r.fit_toxic, r.fit_clean, r.toxic, r.clean) for r in toxicity.mark_counts(rows).collect()}
    assert got == {"bad": (1, 1, 2, 1), "good": (0, 1, 0, 2)}


def test_a_worker_lets_the_store_before_go(monkeypatch):
    from blockwise.llm import common

    gone = []
    let_go = common.let_go
    monkeypatch.setattr(common, "let_go", lambda: gone.append(1) or let_go())
    common.let_go()
    assert common.kept_by_worker(("a",), lambda: 1) == 1 and common.kept_by_worker(("b",), lambda: 2) == 2 == common.kept_by_worker(("b",), lambda: 3)
    assert len(gone) == 2
    let_go()


def test_words_are_learnt_by_merges_alone():
    """Plain words need no library pass: their ids are those that the whole library gives."""
    library = Tokenizer.from_file(WORD_FILE)
    rng = np.random.default_rng(11)
    letters = list("etaoinshrdlu' ,.!?0123456789\n\tABCÄÖüßéñçœŒªµ¡¿%&/#\"<>|")
    sample = ["".join(rng.choice(letters, 200)) for _ in range(50)] + ["", " \n", "x" * 300]
    want = [np.array(library.encode(t, add_special_tokens=False).ids, dtype="<u4").tobytes() for t in sample]
    encoder = packing.WordEncoder(WORD_FILE)

    class MergesOnly:
        model = encoder.library.model

    encoder.library = MergesOnly()
    assert encoder.encode(sample) == want


def test_plain_tokens_have_a_store_of_their_own(monkeypatch):
    monkeypatch.setattr(toxicity, "PLAIN_STORE", 3)
    model = np.log(np.full((32**3, 32), 1 / 32)).astype(np.float32)
    r = toxicity.Restorer(model, {"marked": 2.0, "zorg-": 1.5})
    for _ in range(3):
        assert r.read("Plain words repeat; zorgle, marked tokens dont") == ({"plain", "words", "repeat", "zorgle", "marked", "tokens", "dont"}, {"zorgle": 1.5, "marked": 2.0}, 0)
    assert set(r.token.young) == {"zorgle,", "marked"} and len(r.plain) <= 3 and len(r.plain_before) <= 3


def test_marks_are_counted_once_a_text_in_slices(spark, monkeypatch):
    monkeypatch.setattr(toxicity._word_slices, "__defaults__", (7,))
    rng = np.random.default_rng(12)
    vocabulary = ["bad", "badge", "badger", "badgers", "übermäßig", "übermut", "übermütig", "go", "gone"]
    rows = [(int(rng.integers(2)), int(rng.choice([0, 1, 3])), sorted(set(rng.choice(vocabulary, rng.integers(0, 9)).tolist()))) for _ in range(60)]
    want = {}
    for y, part, words in rows:
        for m in {*words, *(w[:k] + "-" for w in words for k in range(4, 8) if len(w) > k)}:
            n = want.setdefault(m, [0, 0, 0, 0])
            n[1 - y] += part != 3
            n[3 - y] += 1
    frame = spark.createDataFrame(rows, "y int, part int, words array<string>")
    assert {r.mark: [r.fit_toxic, r.fit_clean, r.toxic, r.clean] for r in toxicity.mark_counts(frame).collect()} == want


def test_comparing_near_copies_takes_little_memory():
    rng = np.random.default_rng(13)
    base = np.sort(rng.integers(0, 2**63, 400, dtype=np.uint64))
    sets = [base[rng.random(400) < 0.95] for _ in range(600)]
    tracemalloc.start()
    common = np.concatenate([c for _, c in linking.common_members(sets, sets[:100])])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 60e6
    for i, j in ((0, 0), (3, 500), (99, 7)):
        assert common[i, j] == len(np.intersect1d(sets[i], sets[j]))
