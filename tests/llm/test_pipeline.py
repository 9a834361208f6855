"""The pipeline's stages against brute force, and each registered query of the corpus operators, on small tables."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import pytest

import corpus_pipeline
from oreflow.llm import queries
from tests.llm.test_native_operators import brute_statistics, brute_targets
from tests.llm.test_text_operators import brute_components, brute_cut, byte_words

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def documents(seed=0):
    """Nulls, empty texts, repeated rows, near and exact copies, shared passages and lines, a benchmark leak."""
    rng = random.Random(seed)
    vocab = [f"word{i}" for i in range(3000)]
    text = lambda n: " ".join(rng.choices(vocab, k=n))
    rows = []
    for i in range(40):
        rows.append((10 + i, text(rng.randint(60, 120)), "en", rng.choice(["a", "b", "c", None])))
    passage = text(40)
    rows += [(100 + i, f"{text(50)} {passage} {text(30)}", "en", "a") for i in range(5)]
    rows += [(200 + i, f"terms of service\n{text(60)}\n{text(20)}", "de", "lines") for i in range(14)]
    for i in range(6):
        w = rows[i][1].split()
        w[rng.randrange(len(w))] = "changed"
        rows.append((300 + i, " ".join(w), "en", "b"))
    rows += [rows[3]] * 3 + [(400, None, "en", "a"), (401, "", None, "a"), (402, "few words", "en", "b"), (None, text(70), "en", "b"), (403, "dup dup " * 60, "en", "c")]
    rows += [(500, f"{text(40)} {ITEM} {text(40)}", "en", "c"), (501, "x " * 2 + text(20_000), "en", "c")]
    return [(*r, len(r[1]) if r[1] is not None else None) for r in rows]


ITEM = "if a train leaves the old station at 9 and travels 300 miles in 5 hours then how fast does the train go"


@pytest.fixture
def sf(spark, tmp_path):
    spark.createDataFrame(documents(), DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, ITEM.replace("300", "450")), (2, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return str(tmp_path)


def as_rows(df):
    return sorted((tuple(r[:5]) for r in df.collect()), key=str)


def stage(spark, name, rows, sf):
    out = dict(corpus_pipeline.STAGES)[name](spark, spark.createDataFrame([(*r, "clash", 7) for r in rows], f"{DOCS}, rows string, size int"), sf)
    assert out.columns[:5] == ["doc_id", "text", "lang", "source", "n_chars"]
    return out


def counted(doc_id, text, lang, source, *_):
    return doc_id, text, lang, source, len(text) if text is not None else None


def test_quality_stage_equals_brute_force(spark, sf):
    rows = documents()
    norm = lambda x: "".join(c.lower() if c.isascii() else c for c in x).translate(str.maketrans("123456789", "000000000")).strip(" \t\n\r\x0b\x0c")
    texts, holders = defaultdict(set), defaultdict(set)
    for _, t, _, s, _ in rows:
        texts[s].add(t)
        for line in (t or "").split("\n"):
            holders[s, norm(line)].add(t)
    want = []
    for r in rows:
        n = brute_statistics(r[1])
        often = lambda x: norm(x) != "" and len(holders[r[3], norm(x)]) > 10 and 100 * len(holders[r[3], norm(x)]) > 2 * len(texts[r[3]])  # noqa: B023, E731
        lines = (r[1] or "").split("\n")
        left = [x for x in lines if not often(x)]
        if n[0] >= 50 and 100 * n[4] <= 50 * n[0] and 100 * len(byte_words(" ".join(left))) >= 50 * n[0]:
            want.append(counted(r[0], "\n".join(left), *r[2:]))
    assert as_rows(stage(spark, "quality_rules", rows, sf)) == sorted(want, key=str)
    assert any(r[1].count("\n") == 1 for r in want) and len(want) < len(rows)


def test_near_duplicates_stage_equals_brute_force(spark, sf):
    rows = documents()
    group = {i: c for i, (_, c) in brute_components([r for r in rows if r[0] is not None]).items()}
    want = [r for r in rows if r[0] is None or group[r[0]] == r[0]]
    assert as_rows(stage(spark, "near_duplicates", rows, sf)) == sorted(want, key=str) and len(want) < len(rows)


def test_substring_stage_equals_brute_force(spark, sf):
    rows = [r for r in documents() if r[0] is not None]
    cut = brute_cut(rows)
    got = stage(spark, "substring_dedup", rows, sf).collect()
    want = Counter(r[0] for r in rows if cut[r[0]][1] == 0 or cut[r[0]][1] < cut[r[0]][0])
    assert Counter(r.doc_id for r in got) == want
    by_id = {r[0]: r[1] for r in rows}
    for r in got:
        assert hashlib.sha256(b" ".join(byte_words(r.text))).hexdigest() == cut[r.doc_id][2]
        assert cut[r.doc_id][1] or r.text == by_id[r.doc_id]
        assert r.n_chars == (len(r.text) if r.text is not None else None)


def test_decontamination_stage(spark, sf):
    rows = documents()
    want = [r for r in rows if r[0] != 500]
    assert as_rows(stage(spark, "decontamination", rows, sf)) == sorted(want, key=str)


def test_mixing_stage_takes_what_the_targets_say(spark, sf):
    rng = random.Random(5)
    rows = [r for r in documents() if r[0] != 501] + [(7, " ".join(["hot"] * 70), "en", "d", 279)] * 50 + [(8, f"{rng.random()} " * 30, "en", "d", 0) for _ in range(20)]
    rows += [(1000 + i, " ".join(["big"] * 300), "en", "e", 1199) for i in range(40)] + [(9, "many rows alike here", "en", "f", 20)] * 1500
    got = stage(spark, "mixing", rows, sf).collect()
    sizes = defaultdict(int)
    for r in rows:
        sizes[r[3]] += len(byte_words(r[1]))
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None]
    target = brute_targets(sizes, {s: (1, 2, 3)[i % 3] for i, s in enumerate(order)})
    taken, copies = defaultdict(int), Counter()
    for r in got:
        taken[r.source] += len(byte_words(r.text))
        copies[tuple(r[:5])] += 1
    for s in sizes:
        largest = max(len(byte_words(r[1])) for r in rows if r[3] == s)
        assert abs(taken[s] - target[s]) <= min(0.03 * target[s] + 20, largest + 20), s
    held = Counter(rows)
    assert all(n <= 3 * held[r] for r, n in copies.items())
    assert Counter(map(tuple, got)) == Counter(map(tuple, stage(spark, "mixing", rows, sf).collect()))


def test_stages_on_no_documents(spark, sf):
    for name, _ in corpus_pipeline.STAGES:
        assert stage(spark, name, [], sf).count() == 0


def test_run_is_its_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for _, f in corpus_pipeline.STAGES:
        docs = spark.createDataFrame(f(spark, docs, sf).collect(), DOCS + (", copy long" if f is corpus_pipeline.STAGES[-1][1] else ""))
    got = Counter(map(tuple, corpus_pipeline.run(spark, sf).collect()))
    assert got == Counter(map(tuple, docs.collect())) and got
    assert all(r[5] >= 1 for r in got)


# The registered queries: splits, digests and choices that they add to their operators


def rows_of(spark, tiny, name):
    return queries.queries()[name](spark, tiny).collect()


def remainder(i, by):
    return zlib.crc32(str(i).encode()) % by


def test_op2_split(spark, tiny):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{tiny}/documents.parquet").collect()}
    got = rows_of(spark, tiny, "op2_hmm_scoring")
    assert {r.doc_id: r.held_out for r in got} == {i: remainder(i, 7) == 2 for i in docs}
    low = lambda t: [w.lower() if w.isascii() else w.translate({c: c + 32 for c in range(65, 91)}) for w in (x.decode() for x in byte_words(t))]
    train = [t for i, t in docs.items() if remainder(i, 7) != 2]
    assert {r.train_tokens for r in got} == {sum(len(low(t)) + 1 for t in train)}
    seen = {w for t in train for w in low(t)}
    assert {r.doc_id: r.n_known for r in got} == {i: 1 + sum(w in seen for w in low(t)) for i, t in docs.items()}


def test_op6_split_and_labels(spark, tiny):
    docs = [r.doc_id for r in spark.read.parquet(f"{tiny}/documents.parquet").collect()]
    got = rows_of(spark, tiny, "op6_toxicity")
    assert {r.doc_id: r.held_out for r in got} == {i: remainder(i, 5) == 0 for i in docs}
    assert all(r.predicted == int(r.score >= 0.5) and 0 <= r.score <= 1 for r in got)


def test_op7_targets(spark, tiny):
    docs = spark.read.parquet(f"{tiny}/documents.parquet").collect()
    sizes = defaultdict(int)
    for r in docs:
        sizes[r.source] += len(byte_words(r.text))
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [s for s in sizes if s is None]
    want = brute_targets(sizes, {s: (1, 2, 3)[i % 3] for i, s in enumerate(order)})
    got = {r.doc_id: r for r in rows_of(spark, tiny, "op7_mixing")}
    assert set(got) == {r.doc_id for r in docs}
    for r in docs:
        g = got[r.doc_id]
        assert g["size"] == len(byte_words(r.text)) and g.source_size == sizes[r.source] and abs(g.target - want[r.source]) < 1e-6 * want[r.source] and g.taken <= 3 * g["size"]


def test_op5_finds_items_planted_in_documents(spark, tmp_path):
    rng = random.Random(3)
    item = lambda: " ".join("".join(rng.choices("abcdefghij", k=5)) for _ in range(30))
    items = [(i, item()) for i in range(20)]
    docs = [(i, f"{item()} {items[i % 20][1] if i % 3 == 0 else ''} {item()}") for i in range(60)]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {(r.doc_id, r.item_id) for r in rows_of(spark, str(tmp_path), "op5_decontamination")}
    assert got == {(i, i % 20) for i in range(0, 60, 3)}


def test_op9_has_the_added_conversation(spark, tiny):
    got = {r.conv_id: r for r in rows_of(spark, tiny, "op9_chat_format")}
    said = "</s>[INST] ok [/INST]"
    assert got[-7].n_turns == 2 and got[-7].loss_chars == len(said) and got[-7].valid
    assert got[-7].turns_sha256 == hashlib.sha256(f"user\n{said}\nassistant\n{said}\n".encode()).hexdigest() and got[-7].loss_sha256 == hashlib.sha256(said.encode()).hexdigest()


def test_op10_chooses_the_last_of_equal_payloads(spark, tmp_path):
    big, small = "b" * 1000, "s" * 999
    html = [(1, big), (2, small), (3, big), (4, small), (5, None), (6, ""), (7, big), (8, "é" * 500), (9, "é" * 500)]
    spark.createDataFrame([(i, f"http://h/{i}", h) for i, h in html], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = {r.page_id: (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in rows_of(spark, str(tmp_path), "op10_warc")}
    sha = lambda h: hashlib.sha1((h or "").encode()).hexdigest()
    want = {i: (len((h or "").encode()), sha(h), "response", None) for i, h in html}
    want |= {i: (1000, sha(h), "revisit", to) for i, h, to in ((1, big, 7), (3, big, 7), (8, "é" * 500, 9))}
    assert got == want
