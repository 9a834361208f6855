"""Near duplicates, substring dedup, scoring and toxicity against brute force on small tables."""

import hashlib
import math
import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from oreflow.llm import blocks, hmm_lm, ngram_join, toxicity
from oreflow.llm.components import components
from oreflow.llm.ngram_join import ngram_components, one_of_each
from oreflow.llm.substring_dedup import kept_digest, substring_dedup
from oreflow.llm.words import texts_of, words

DOCS = "doc_id long, text string, tokens string, block int"  # clashes with inner names


def corpus(seed=0, n=60):
    """Random texts with exact and near copies, shared passages, nulls, empty, short and long ones."""
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)] + ["É", "naïve", "x" * 20, "The", "the"]
    texts = [" ".join(rng.choices(vocab, k=rng.randint(1, 120))) for _ in range(n)]
    for _ in range(n):
        w = rng.choice(texts).split()
        for _ in range(rng.choice([0, 1, 2, 5, 10])):
            w[rng.randrange(len(w))] = rng.choice(vocab)
        texts.append(rng.choice([" ", "\n", "\t "]).join(w))
    passage = " ".join(rng.choices(vocab, k=30))
    texts += [f"{t} {passage} tail{i}" for i, t in enumerate(texts[:15])]
    texts += ["", None, "  \n\t ", "one two", "One  TWO", "a", " ".join(rng.choices(vocab, k=6000)), "no\u00a0break space\u2003stays", "y" * 3000]
    return [(i, t, "extra", 7) for i, t in enumerate(texts)]


def byte_words(text, lower=False):
    b = (text or "").encode()
    return (b.lower() if lower else b).split()


def shingle_set(text, k=5):
    w = byte_words(text, lower=True)
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def brute_components(rows):
    sets = {r[0]: shingle_set(r[1]) for r in rows}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            shared = len(sets[a] & sets[b])
            if shared and 100 * shared >= 75 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


@pytest.mark.parametrize("seed", [0, 1])
def test_ngram_components_equal_brute_force(spark, seed):
    rows = corpus(seed)
    got = ngram_components(spark.createDataFrame(rows, DOCS)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute_components(rows)
    assert len(got) == len(rows)


def test_large_group_of_near_copies(spark):
    rng = random.Random(5)
    base = [f"b{i}" for i in range(80)]
    rows = []
    for i in range(120):
        w = list(base)
        for _ in range(rng.randint(0, 6)):
            w[rng.randrange(80)] = f"u{i}"
        rows.append((1000 - i, " ".join(w), "", 0))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_components(spark.createDataFrame(rows, DOCS)).collect()}
    assert got == brute_components(rows)


def test_ngram_components_edge_cases(spark):
    empty = ngram_components(spark.createDataFrame([], DOCS))
    assert empty.columns == ["doc_id", "n_shingles", "component_id"] and empty.count() == 0
    text = " ".join(f"t{i}" for i in range(40))
    rows = [(5, text, "", 0), (5, text, "", 0), (9, text, "", 0), (None, text, "", 0), (3, None, None, None)]
    got = sorted(ngram_components(spark.createDataFrame(rows, DOCS)).collect(), key=str)
    assert sorted((r.doc_id, r.component_id) for r in got if r.doc_id is not None) == [(3, 3), (5, 5), (5, 5), (9, 5)]
    assert [r.component_id for r in got if r.doc_id is None] == [None]
    left = one_of_each(spark.createDataFrame(rows, DOCS)).select("doc_id").collect()
    assert sorted(str(r.doc_id) for r in left) == ["3", "5", "5", "None"]


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (7, 7)], "a long, b long")
    got = {r.id: r.label for r in components(edges).collect()}
    assert got == {**dict.fromkeys(range(41), 0), 100: 100, 101: 100}


def brute_cut(rows, window=13):
    held = {}
    for i, t, *_ in sorted(rows, key=lambda r: r[0]):
        w = byte_words(t)
        for j in range(len(w) - window + 1):
            held.setdefault(tuple(w[j : j + window]), i)
    out = {}
    for i, t, *_ in rows:
        w = byte_words(t)
        gone = set()
        for j in range(len(w) - window + 1):
            if held[tuple(w[j : j + window])] < i:
                gone |= set(range(j, j + window))
        kept = b" ".join(x for k, x in enumerate(w) if k not in gone)
        out[i] = (len(w), len(gone), hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize("seed", [0, 3])
def test_substring_dedup_equals_brute_force(spark, seed):
    rows = corpus(seed)
    random.Random(seed).shuffle(rows)
    cut = substring_dedup(spark.createDataFrame(rows, DOCS), carry=("tokens",))
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in kept_digest(cut).collect()}
    assert got == brute_cut(rows)
    by_id = {r[0]: r[1] for r in rows}
    for r in cut.collect():
        assert r.tokens == "extra"
        covered = set()
        for s in r.spans:
            assert s.reference < r.doc_id and s.words >= 13
            covered |= set(range(s.start, s.start + s.words))
        assert len(covered) == r.n_removed
        if not r.n_removed:
            assert r.text == by_id[r.doc_id]


def test_substring_dedup_edge_cases(spark):
    assert substring_dedup(spark.createDataFrame([], DOCS)).count() == 0
    passage = " ".join(f"p{i}" for i in range(20))
    rows = [(1, passage, "", 0), (1, passage, "", 0), (None, passage, "", 0), (2, f"{passage} end", "", 0), (3, " ".join(passage.split()[:12]), "", 0)]
    got = sorted((str(r.doc_id), r.n_removed, r.text) for r in substring_dedup(spark.createDataFrame(rows, DOCS)).collect())
    assert got == [("1", 0, passage), ("1", 0, passage), ("2", 20, "end"), ("3", 0, " ".join(passage.split()[:12])), ("None", 20, "")]


def test_word_kernel_splits_as_bytes_do():
    texts = ["a b", " lead", "trail ", "", None, "x\x0by\x0cz\r\n", "é\u00a0ü \u2003 q", "long" * 9 + " " + "long" * 9, "A bC"]
    w = words(texts_of(pa.array(texts)), lower=True)
    raw = w.data.tobytes()
    got = [[raw[w.start[i] : w.end[i]] for i in range(w.first[d], w.first[d + 1])] for d in range(len(texts))]
    assert got == [byte_words(t, lower=True) for t in texts]
    h = w.hashes()
    flat = [x for d in got for x in d]
    assert len(set(h.tolist())) == len(set(flat))
    assert all((h[i] == h[j]) == (flat[i] == flat[j]) for i in range(len(flat)) for j in range(len(flat)))


def brute_likelihood(model, symbols):
    """Sum over all state paths."""
    a = model.start * model.emit[:, symbols[0]]
    for s in symbols[1:]:
        a = (a @ model.step) * model.emit[:, s]
    return math.log10(a.sum())


def test_forward_and_expected_counts_match_direct_sums():
    rng = np.random.default_rng(1)
    k, m = 3, hmm_lm.SYMBOLS + 1
    share = lambda x: x / x.sum(-1, keepdims=True)
    model = hmm_lm.Model(share(rng.random(k)), share(rng.random((k, k))), share(rng.random((k, m))))
    seqs = [rng.integers(0, m, size=n) for n in (1, 5, 2, 9)]
    first = np.concatenate([[0], np.cumsum([len(s) for s in seqs])])
    score = hmm_lm.forward(model, np.concatenate(seqs), first)
    assert np.allclose(score, [brute_likelihood(model, s) for s in seqs])
    got = hmm_lm.expected(model, np.concatenate(seqs), first)
    step, start = np.zeros((k, k)), np.zeros(k)
    for s in seqs:
        paths = np.array(np.meshgrid(*[range(k)] * len(s))).reshape(len(s), -1).T
        p = model.start[paths[:, 0]] * model.emit[paths[:, 0], s[0]]
        for t in range(1, len(s)):
            p = p * model.step[paths[:, t - 1], paths[:, t]] * model.emit[paths[:, t], s[t]]
        p = p / p.sum()
        np.add.at(start, paths[:, 0], p)
        for t in range(1, len(s)):
            np.add.at(step, (paths[:, t - 1], paths[:, t]), p)
    assert np.allclose(got.step, step) and np.allclose(got.start, start)
    assert np.isclose(got.emit.sum(), sum(map(len, seqs)))


def test_long_texts_are_walked_in_segments(monkeypatch):
    monkeypatch.setattr(hmm_lm, "SEGMENT", 7)
    rng = np.random.default_rng(2)
    k, m = 3, hmm_lm.SYMBOLS + 1
    share = lambda x: x / x.sum(-1, keepdims=True)
    model = hmm_lm.Model(share(rng.random(k)), share(rng.random((k, k))), share(rng.random((k, m))))
    for n in (1, 7, 8, 50):
        one = rng.integers(0, m, size=n)
        assert np.allclose(hmm_lm.expected_of_one(model, one).cells(), hmm_lm.expected(model, one, np.array([0, n])).cells())
    seqs = [rng.integers(0, m, size=n) for n in (5, 40, 3, 60, 1)]
    first = np.concatenate([[0], np.cumsum([len(s) for s in seqs])])
    want = hmm_lm.forward(model, np.concatenate(seqs), first)
    monkeypatch.setattr(hmm_lm, "LONG", 30)
    assert np.allclose(hmm_lm.forward(model, np.concatenate(seqs), first), want)


def brute_score(model, texts, trained, text):
    """The model's log10 probability of a text by its definition: state paths summed, word within its class by counts."""
    count, of_class = Counter(), defaultdict(Counter)
    symbol = lambda word: int(hmm_lm.symbols_of(words(texts_of(pa.array([word]))))[0])
    for t in trained:
        for x in byte_words(texts[t], lower=True):
            count[x] += 1
            of_class[symbol(x.decode())][x] += 1
    mine = [x.decode() for x in byte_words(text, lower=True)]
    latent = brute_likelihood(model, [*map(symbol, mine), hmm_lm.SYMBOLS])
    return latent + sum(math.log10((count[x.encode()] + 1) / (of_class[symbol(x)].total() + len(of_class[symbol(x)]) + 1)) for x in mine)


def test_hmm_score_equals_its_definition(spark, monkeypatch):
    texts = {i: t for i, t, *_ in corpus(6)[:40]} | {900: "unseen words only zzz", 901: None, 902: "the the The"}
    models = []
    monkeypatch.setattr(hmm_lm, "_converged", lambda *a, f=hmm_lm._converged: models.append(f(*a)) or models[-1])
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.doc_id: r.score for r in hmm_lm.hmm_scores(docs, F.col("doc_id") % 3 != 0, states=3).collect()}
    trained = [i for i in texts if i % 3 != 0]
    for i in (0, 1, 2, 3, 900, 901, 902):
        assert abs(got[i] - brute_score(models[0], texts, trained, texts[i])) < 1e-6 * (1 + abs(got[i]))


def test_hmm_scores_counts_and_base(spark):
    rows = corpus(2) + [(500, "the the The", "", 0), (500, "the the The", "", 0)]
    docs = spark.createDataFrame(rows, DOCS)
    got = hmm_lm.hmm_scores(docs, F.col("doc_id") % 3 != 0, states=2).collect()
    count = Counter()
    for i, t, *_ in rows:
        if i % 3 != 0:
            count.update(byte_words(t, lower=True))
            count[None] += 1
    n, v = sum(count.values()), len(count)
    by_id = {r[0]: r[1] for r in rows}
    assert len(got) == len(rows)
    for r in got:
        tokens = [*byte_words(by_id[r.doc_id], lower=True), None]
        base = sum(math.log10((count[x] + 1) / (n + v + 1)) for x in tokens)
        assert (r.train, r.n_tokens, r.n_known, r.train_tokens) == (r.doc_id % 3 != 0, len(tokens), sum(count[x] > 0 for x in tokens), n)
        assert abs(r.base_score - base) < 1e-6 and math.isfinite(r.score) and r.score < 0


def test_hmm_beats_the_base_on_held_out_text(spark, tiny):
    docs = spark.read.parquet(f"{tiny}/documents.parquet")
    r = hmm_lm.hmm_scores(docs, F.col("doc_id") % 4 != 0).filter("NOT train").agg(F.sum("score"), F.sum("base_score")).first()
    assert r[0] > r[1]


def test_hmm_training_converges_on_all_texts(spark):
    rng = random.Random(11)
    kinds = [[[f"{lang}{k}{''.join(rng.choices('abcdefghij', k=3))}" for _ in range(30)] for k in range(3)] for lang in "xyz"]
    text = lambda lang, n: " ".join(rng.choice(kinds[lang][t % 3]) for t in range(n))
    texts = [text(0, 12) for _ in range(2500)] + [text(1, 400) for _ in range(40)] + [text(2, 400) for _ in range(15)]
    model = hmm_lm.trained(spark.createDataFrame([(t,) for t in texts], "text string"))
    symbol, first = hmm_lm._symbol_sequences(pa.array(texts, pa.large_string()))
    mean = lambda m: hmm_lm.forward(m, symbol, first).sum() / len(symbol)
    assert mean(hmm_lm.maximised(hmm_lm.expected(model, symbol, first))) - mean(model) < 1e-4


def test_hmm_without_training_rows(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    got = hmm_lm.hmm_scores(docs, F.lit(False)).collect()
    assert all(r.n_known == 0 and r.train_tokens == 0 and math.isfinite(r.score) for r in got)
    assert hmm_lm.hmm_scores(docs.limit(0), F.lit(True)).count() == 0


def test_toxicity_learns_words_and_finds_the_sentence(spark):
    rng = random.Random(0)
    plain = [f"word{i}" for i in range(200)]
    rows, labels = [], []
    for i in range(300):
        sentences = [" ".join(rng.choices(plain, k=8)) + "." for _ in range(rng.randint(2, 8))]
        bad = i % 4 == 0
        if bad:
            sentences[rng.randrange(len(sentences))] = "you utter " + rng.choice(["fiend!", "fiend,", "fiendish", "rotter."])
        rows.append((i, " ".join(sentences), "x"))
        labels.append((i, int(bad), 5))
    rows += [(1000, "", None), (1001, None, None), (1002, "   ", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string")
    known = spark.createDataFrame([*labels, (7, None, 1), (None, 1, 1)], "doc_id long, toxic int, text int")
    model = toxicity.trained(docs, known.filter("doc_id % 5 <> 0 OR doc_id IS NULL"))
    got = {r.doc_id: r for r in toxicity.toxicity(docs, model).collect()}
    held = [i for i in range(0, 300, 5)]
    right = sum((got[i].score >= 0.5) == (i % 4 == 0) for i in held)
    assert right >= 0.95 * len(held)
    assert [got[i].score for i in (1000, 1001, 1002)] == [0.0, 0.0, 0.0]
    for i in held:
        for s in got[i].sentences:
            w = rows[i][1].split()[s.word : s.word + s.words]
            assert any(x.startswith(("fiend", "rotter")) for x in w)


def test_noisy_or_and_its_gradient():
    """Against direct products, and the fit's descent against differences of the loss."""
    z, doc = np.array([-1.0, 0.5, 2.0, -3.0]), np.array([0, 0, 1, 3])
    p = 1 - np.exp(-toxicity.noisy_or(z, doc, 4))
    one = 1 / (1 + np.exp(-z))
    assert np.allclose(p, [1 - (1 - one[0]) * (1 - one[1]), one[2], 0, one[3]])
    texts = [f"calm words here. {'vile thing.' if i % 3 == 0 else 'fine thing.'} more calm words." for i in range(60)] + ["vile. " + "calm words here. " * 40] * 3
    toxic = [int(i % 3 == 0) for i in range(60)] + [1] * 3
    model = toxicity.fit(texts, toxic)
    bag = toxicity.bags(words(texts_of(pa.array(texts)), lower=True))
    loss = lambda m: -np.mean([math.log(max(q if y else 1 - q, 1e-300)) for q, y in zip(1 - np.exp(-toxicity.noisy_or(m.sentences(bag), bag.doc, len(texts))), toxic)])
    start = toxicity.Model(np.zeros_like(model.weight), -6.0)
    assert loss(model) < 0.1 * loss(start)
    sure = 1 - np.exp(-toxicity.noisy_or(model.sentences(bag), bag.doc, len(texts)))
    assert [int(q >= 0.5) for q in sure] == toxic


def test_toxicity_sample_is_bounded_in_bytes(spark, monkeypatch):
    held = []
    monkeypatch.setattr(toxicity, "fit", lambda texts, toxic: held.append(texts) or toxicity.Model(np.zeros(toxicity.FEATURES + 1), -6.0))
    monkeypatch.setattr(toxicity, "TRAIN_BYTES", 64 * 100)
    docs = spark.createDataFrame([(i, "x" * (n := 40 + i % 70)) for i in range(500)] + [(1000, "y" * 101), (1001, None)], "doc_id long, text string")
    toxicity.trained(docs, docs.select("doc_id", F.lit(1).alias("toxic")))
    sizes = [len(t or "") for t in held[0]]
    assert 64 * 100 - 110 < sum(sizes) <= 64 * 100 and max(sizes) <= 100


def test_toxicity_without_labels(spark):
    docs = spark.createDataFrame([(1, "a b."), (2, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert all(0 <= r.score < 0.5 for r in toxicity.toxicity(docs, toxicity.trained(docs, none)).collect())


def test_blocks_pack_all_rows_in_bounded_blocks(spark):
    rows = [(i % 3, "same text" if i < 400 else "x" * (i % 7 * 100), i) for i in range(900)] + [(1, None, 5)] * 50 + [(2, "long " * 2000, 6)]
    made = blocks.in_blocks(spark.createDataFrame(rows, "doc_id long, text string, n int").repartition(2), ("n",), most=3000, fan=3)
    cells = made.table.collect()
    tables = [pa.ipc.open_stream(bytes(r.docs)).read_all() for r in cells]
    assert len({r.block for r in cells}) == len(cells) > 20 and made.fan**made.depth >= len(cells) and made.fan <= 3
    back = [tuple(r.values()) for t in tables for r in t.to_pylist()]
    assert Counter(back) == Counter(rows)
    assert all(t.num_rows == 1 or sum(len(x or "") + blocks.ROW_BYTES for x in t.column("text").to_pylist()) <= 3000 for t in tables)


@pytest.mark.parametrize("fan", [2, 3, 64])
def test_exchange_over_several_rounds(spark, fan):
    """Sums and what each block is told, however many rounds it takes; no unit has many senders."""
    rows = [(i, " ".join(f"w{random.Random(i * 31 + j).randrange(60)}" for j in range(20)) + " hot", "") for i in range(120)]
    made = blocks.in_blocks(spark.createDataFrame(rows, "doc_id long, text string, n string"), most=400, fan=fan)
    exchange = blocks.Exchange.over(made, blocks.FREQUENCY)
    assert fan == 64 or made.depth > 2

    def send(block, docs):
        h = words(texts_of(docs.column("text"))).hashes()
        return exchange.sent(block, h, np.ones(len(h), np.uint32))

    sent = made.each(send, blocks.ROWS)
    got = defaultdict(dict)
    for r in exchange.replies(sent).collect():
        keys, totals = blocks.replied(pa.table({"keys": [bytes(r.keys)], "vals": [bytes(r.vals)]}), blocks.FREQUENCY.value)
        got[r.block].update(zip(keys.tolist(), totals.tolist()))
    want, total = {}, Counter()
    for r in made.table.collect():
        want[r.block] = words(texts_of(pa.ipc.open_stream(bytes(r.docs)).read_all().column("text"))).hashes().tolist()
        total.update(want[r.block])
    assert dict(got) == {b: {k: total[k] for k in set(ks) if total[k] > 1} for b, ks in want.items()}
    senders = sent.groupBy("unit").agg(F.countDistinct("child").alias("n")).agg(F.max("n")).first()[0]
    assert senders <= 6 * made.fan


def test_ngram_components_over_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(blocks, "BLOCK_BYTES", 2000)
    monkeypatch.setattr(blocks, "FAN", 3)
    rows = corpus(4)
    got = ngram_components(spark.createDataFrame(rows, DOCS)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute_components(rows)


def test_suffix_parities_equal_direct_ones():
    rng = np.random.default_rng(0)
    sets = [np.sort(rng.integers(-(2**63), 2**63 - 1, size=n)) for n in (0, 1, 40, 300, 7, 1000)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(6), pa.int64()), pa.array([len(s) + 2 for s in sets], pa.int64()), pa.array([2] * 6, pa.int64()), pa.array([s.tolist() for s in sets], pa.list_(pa.int64()))], ["rep", "n", "n_own", "tokens"])
    for most in (50, 1 << 17):
        got = [r for b in ngram_join.prefix_posts(75, most)(iter([batch])) for r in b.to_pylist()]
        want = []
        for d, s in enumerate(sets):
            n = len(s) + 2
            for j in range(max(0, min(len(s), n - -(-75 * n // 100) + 1 - 2))):
                bits = Counter((int(t) % 2**64 >> 7) % 512 for t in s[j + 1 :])
                vector = [sum((bits[64 * w + b] & 1) << b for b in range(64)) for w in range(8)]
                want.append((int(s[j]), d, n, 2 + j, j, [v - (1 << 64) * (v >> 63) for v in vector]))
        assert [tuple(r.values()) for r in got] == want


def test_no_pair_is_verified_twice(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(ngram_join, "_verified", lambda pairs, sets, percent, f=ngram_join._verified: (seen.extend((r.a, r.b) for r in pairs.collect()), f(pairs, sets, percent))[1])
    rows = corpus(0)
    got = ngram_components(spark.createDataFrame(rows, DOCS)).collect()
    assert seen and len(seen) == len(set(seen))
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute_components(rows)


def test_different_texts_under_one_id_are_one_node(spark):
    a, b = (" ".join(f"{c}{i}" for i in range(40)) for c in "ab")
    rows = [(7, a, "", 0), (7, b, "", 0), (3, a, "", 0), (5, b, "", 0), (9, "other words", "", 0)]
    got = {r.doc_id: r.component_id for r in ngram_components(spark.createDataFrame(rows, DOCS)).collect()}
    assert got == {7: 3, 3: 3, 5: 3, 9: 9}


def brute_factors(texts, doc, window):
    """Left to right over words: at the first known window that no factor holds, of all ways on from it or from
    known windows around it the longest, each step checked against the reference's words."""
    first = {}
    for i in sorted(texts):
        for j in range(len(texts[i]) - window + 1):
            first.setdefault(tuple(texts[i][j : j + window]), (i, j))
    mine = texts[doc]
    known = {j: first[tuple(mine[j : j + window])] for j in range(len(mine) - window + 1) if first[tuple(mine[j : j + window])][0] < doc}
    out, done = [], 0
    for x in sorted(known):
        if out and x + window <= done:
            continue
        best = None
        for y, (d, r) in known.items():
            low = high = y  # windows of this reference and shift, without a word between
            steps = {j for j, (e, q) in known.items() if e == d and q - j == r - y}
            while any(0 < j - high <= window for j in steps):
                high = max(j for j in steps if 0 < j - high <= window)
            while any(0 < low - j <= window for j in steps):
                low = min(j for j in steps if 0 < low - j <= window)
            if low <= x <= high and (best is None or high + window > best[0]):
                best = high + window, d, r - y
        out.append((x, best[0] - x, best[1], x + best[2]))
        done = best[0]
    return out


@pytest.mark.parametrize("seed", range(4))
def test_factors_equal_a_word_by_word_parser(spark, seed):
    rng = random.Random(seed)
    texts = {}
    for i in range(30):
        w = []
        while len(w) < 60:
            if texts and rng.random() < 0.6:
                other = texts[rng.choice(list(texts))]
                a = rng.randrange(len(other))
                w += other[a : a + rng.choice([3, 5, 9, 30])]
            else:
                w += [f"w{rng.randrange(12)}" for _ in range(rng.randint(1, 4))]
        texts[i] = w
    rows = [(i, " ".join(w), "", 0) for i, w in texts.items()]
    for r in substring_dedup(spark.createDataFrame(rows, DOCS), window=4).collect():
        got = [(s.start, s.words, s.reference, s.reference_start) for s in r.spans]
        assert [(a, n) for a, n, *_ in got] == [(a, n) for a, n, *_ in brute_factors(texts, r.doc_id, 4)]
        for start, n, reference, place in got:
            assert reference < r.doc_id and texts[r.doc_id][start : start + n] == texts[reference][place : place + n]


def test_a_document_equal_to_an_earlier_one_is_one_factor(spark):
    second = [f"s{i}" for i in range(40)]
    first = ["x"] * 3 + second[10:25] + ["y"]
    rows = [(1, " ".join(first), "", 0), (2, " ".join(second), "", 0), (3, " ".join(second), "", 0), (4, " ".join(second[20:] + second), "", 0)]
    got = {r.doc_id: [(s.start, s.words, s.reference, s.reference_start) for s in r.spans] for r in substring_dedup(spark.createDataFrame(rows, DOCS)).collect()}
    assert got == {1: [], 2: [(10, 15, 1, 3)], 3: [(0, 40, 2, 0)], 4: [(0, 20, 2, 20), (20, 40, 2, 0)]}


def test_substring_dedup_over_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(blocks, "BLOCK_BYTES", 2000)
    monkeypatch.setattr(blocks, "FAN", 3)
    rows = corpus(5)
    cut = substring_dedup(spark.createDataFrame(rows, DOCS), carry=("tokens",))
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in kept_digest(cut).collect()} == brute_cut(rows)
