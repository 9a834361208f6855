"""Quality rules, mixing, chat formatting, decontamination, URL filters and WARC on small tables."""

import hashlib
import io
import random
import re
import time
from collections import Counter, defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from oreflow.llm import chat_format, mixing, warc
from oreflow.llm import quality as quality_module
from oreflow.llm.decontaminate import clean, contaminated, short_items
from oreflow.llm.quality import Limits, quality
from oreflow.llm.scratch import new_path
from oreflow.llm.url_filter import Rule, Trie, url_verdicts

QUALITY = "doc_id long, text string, source string, n_words int, lost string"


def brute_statistics(text):
    t = text or ""
    w = t.encode().split()
    tri = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    count, covered = Counter(tri), set()
    for i, x in enumerate(tri):
        if count[x] > 1:
            covered |= {i, i + 1, i + 2}
    lines = [x for x in t.split("\n") if x.strip(" \t\n\r\x0b\x0c")]
    return len(w), sum(len(x.decode()) for x in w), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered)


def quality_rows():
    rng = random.Random(1)
    vocab = ["a", "b", "c", "é", "Ü|x", "#5", "word", "two", "three"] + [f"v{i}" for i in range(300)]
    rows = [(i, "\n".join(" ".join(rng.choices(vocab[: rng.choice([6, 309])], k=rng.randint(0, 12))) for _ in range(rng.randint(1, 14))), f"s{i % 2}", 0, "") for i in range(80)]
    texts = [None, "", " \n ", "a b c", "a b c a b c", "x y x y x y x y", "\r\n".join(["same line"] * 4), "\u2003 a \u00a0", "q " * 5000]
    return rows + [(100 + i, t, "s0", 1, None) for i, t in enumerate(texts)] + [(7, "repeat me " * 30, None, 1, None)] * 2


def test_quality_statistics_equal_brute_force(spark):
    rows = quality_rows()
    got = quality(spark.createDataFrame(rows, QUALITY), carry=("lost",)).collect()
    assert len(got) == len(rows)
    by_id = {r[0]: r[1] for r in rows}
    by_id[7] = rows[-1][1]
    for r in (x for x in got if x.doc_id != 7):
        n = brute_statistics(by_id[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == n, by_id[r.doc_id]
        assert r.base_failed == (n[0] < 50 or 100 * n[4] > 50 * n[0])
        assert not (r.base_failed and r.kept)


def test_repeated_windows_with_colliding_hashes(spark, monkeypatch):
    monkeypatch.setattr(quality_module, "_PLACE_BITS", 58)  # six bits of the hash are left
    rows = [r for r in quality_rows() if r[0] != 7]
    got = quality(spark.createDataFrame(rows, QUALITY)).collect()
    assert {r.doc_id: r.n_repeat_words for r in got} == {r[0]: brute_statistics(r[1])[4] for r in rows}


def test_frequent_lines_go_and_depleted_documents_too(spark):
    rng = random.Random(2)
    body = lambda: " ".join(f"u{rng.randrange(10**9)}" for _ in range(60))
    rows = [(i, f"All Rights reserved 20{i % 10}1\n{body()}", "h", 0, "") for i in range(40)]
    rows += [(100 + i, "all rights RESERVED 1999 \n" + "\n".join(["all rights reserved 2001"] * 30) + "\nmore", "h", 0, "") for i in range(3)]
    copy = body() + "\n" + body()
    rows += [(200 + i, copy, "h", 0, "") for i in range(60)]  # exact copies are one document
    rows += [(300 + i, f"All Rights reserved 2001\n{body()}", "other", 0, "") for i in range(3)]
    df = spark.createDataFrame(rows, QUALITY)
    got = {r.doc_id: r for r in quality(df, Limits(line_documents=10, line_percent=2)).collect()}
    assert all(got[i].kept and got[i].n_line_words == 4 and "\n" not in got[i].text for i in range(40))
    assert not any(got[100 + i].kept for i in range(3))
    assert all(got[200 + i].kept and got[200 + i].text == copy for i in range(60))
    assert all(got[300 + i].kept and got[300 + i].n_line_words == 0 for i in range(3))
    twice = quality(df.unionByName(df)).filter("doc_id = 3").collect()
    assert [r.n_line_words for r in twice] == [4, 4]
    # a filter on the verdict gives the same rows
    assert {r.doc_id for r in quality(df).filter("kept").select("doc_id", "text").collect()} == {i for i, r in got.items() if r.kept}
    assert quality(df.limit(0)).count() == 0


def brute_targets(sizes, weights, cap=3.0):
    total, clamped = sum(sizes.values()), set()
    while True:
        free = [s for s in sizes if s not in clamped]
        rest = total - sum(cap * sizes[s] for s in clamped)
        t = {s: cap * sizes[s] if s in clamped else rest * weights[s] / sum(weights[x] for x in free) for s in sizes}
        new = {s for s in free if t[s] > cap * sizes[s] * (1 + 1e-12)}
        if not new:
            return t
        clamped |= new


def test_mixing_targets_and_taken(spark):
    rng = random.Random(3)
    rows = [(i, rng.choice(["a", "b", "B", "é", None] + ["hot"] * 6), rng.choice([0, 1, 5, 50, 500, rng.randint(1, 4000)])) for i in range(6000)] + [(9, "tiny", 10)] + [(8, "hot", 77)] * 2
    docs = spark.createDataFrame(rows, "doc_id long, source string, size long").withColumn("ratio", F.lit("clash"))
    sources = mixing.source_table(docs)
    weights = mixing.cyclic_weights(sources)
    got = mixing.mixed(docs, weights, sources).collect()
    assert len(got) == len(rows)
    sizes = defaultdict(int)
    for _, s, n in rows:
        sizes[s] += n
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None]
    want = brute_targets(sizes, {s: (1, 2, 3)[i % 3] for i, s in enumerate(order)})
    taken = defaultdict(int)
    for r in got:
        assert 0 <= r.copies <= 3 and r.source_size == sizes[r.source]
        assert abs(r.target - want[r.source]) < 1e-6 * (1 + want[r.source])
        taken[r.source] += r.copies * r.size
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 0.02 * want[s] + 20
    again = mixing.mixed(docs.repartition(3), weights, sources).collect()
    assert Counter(got) == Counter(again)


def test_mixing_edge_cases(spark):
    empty = spark.createDataFrame([], "doc_id long, source string, size long")
    s = mixing.source_table(empty)
    assert mixing.mixed(empty, mixing.cyclic_weights(s), s).count() == 0
    zero = spark.createDataFrame([(1, "a", 0), (2, None, 0)], "doc_id long, source string, size long")
    s = mixing.source_table(zero)
    assert [r.copies for r in mixing.mixed(zero, mixing.cyclic_weights(s), s).collect()] == [0, 0]
    counts = spark.createDataFrame([(None,), ("",), (" a\u00a0b c\n",)], "t string").select(mixing.word_count(F.col("t")).alias("n")).collect()
    assert [r.n for r in counts] == [0, 0, 2]


def round_trip(spark, turns):
    rows = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    return {r.conv_id: [(x.role, x.text) for x in r.turns] for r in chat_format.read_back(chat_format.formatted(rows)).collect()}


def test_chat_round_trip_of_control_strings(spark):
    rng = random.Random(4)
    bits = ["<|im_start|>", "<|im_end|>", "<|im_sep|>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "\\", "\\\\", "<", "|", "<|", "im_end|>", "\n", "é", " ", "$0", "\\/"]
    turns, want = [], {}
    for c in range(200):
        want[c] = [(rng.choice(["user", "assistant", "we<|im_sep|>ird\\"]), "".join(rng.choices(bits, k=rng.randint(0, 9)))) for _ in range(rng.randint(1, 5))]
        turns += [(c, i, r, t) for i, (r, t) in enumerate(want[c])]
    rng.shuffle(turns)
    assert round_trip(spark, turns) == want
    rows = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    for r in chat_format.formatted(rows).collect():
        for s in (x.text for x in r.segments if x.kind == "text"):
            assert not any(c in s for c in chat_format.Template().controls)


def test_chat_digest_follows_the_flags(spark):
    turns = spark.createDataFrame([(1, 0, "user", "u"), (1, 1, "assistant", "</s> a\\"), (1, 2, "user", "v"), (1, 3, "assistant", "b")], "conv_id long, turn long, role string, text string")
    rows = chat_format.formatted(turns)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    plain = chat_format.digests(rows).first()
    assert (plain.loss_chars, plain.loss_sha256, plain.valid, plain.error_turn) == (8, sha("</s> a\\b"), True, None)
    flipped = rows.withColumn("segments", F.transform("segments", lambda x: x.withField("loss", ~x["loss"] & (x["kind"] == "text"))))
    assert (chat_format.digests(flipped).first().loss_sha256, chat_format.digests(flipped).first().turns_sha256) == (sha("uv"), plain.turns_sha256)
    assert "aggregate" in chat_format.digests(rows)._jdf.queryExecution().optimizedPlan().toString()


def test_chat_machine_and_loss(spark):
    turns = [(1, 0, "system", "s"), (1, 1, "user", "u"), (1, 2, "assistant", None), (2, 0, "user", "u"), (2, 1, "user", "v"), (3, 0, "user", "x"), (4, 5, None, "x"), (None, 0, "user", "a"), (None, 1, "assistant", "b")]
    got = {r.conv_id: r for r in chat_format.formatted(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")).collect()}
    assert {c: (r.valid, r.error_turn) for c, r in got.items()} == {1: (True, None), 2: (False, 1), 3: (False, 1), 4: (False, 0), None: (True, None)}
    assert [s.loss for s in got[1].segments] == [False] * 7 + [True, False]
    digest = chat_format.digests(chat_format.formatted(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string"))).filter("conv_id = 1").first()
    assert digest.turns_sha256 == hashlib.sha256(b"system\ns\nuser\nu\nassistant\n\n").hexdigest() and digest.loss_chars == 0
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat_format.digests(chat_format.formatted(none)).count() == 0


BENCH = [
    (1, "If Maria Gomez buys 12 apples for 3 dollars each, how many dollars does Maria Gomez pay in total at the little market?"),
    (2, "the cat and the dog went over the hill and then the cat and the dog came back from the hill again"),
    (3, "too short"), (4, None), (5, ""),
]


def test_decontamination(spark):
    filler = lambda seed: " ".join(f"f{random.Random(seed).randrange(10**9)}x{i}" for i in range(60))
    docs = [
        (1, f"{filler(1)} {BENCH[0][1]} {filler(2)}"),
        (2, f"{filler(3)}\nIF Maria Gomez buys 57 apples for 8 dollars each, how many dollars does Maria Gomez pay in total at the little market? {filler(4)}"),
        (3, f"If Tom Baker buys 9 apples for 4 euros each, how many euros does Tom Baker pay in total at the little market?"),
        (4, f"If Tom Baker buys 9 apples for 4 dollars each, how many dollars does Ann Clark pay in total at the little market?"),
        (5, filler(5)), (6, None), (7, ""), (8, BENCH[1][1].upper() + "!"), (9, "too short"), (None, BENCH[1][1]), (8, BENCH[1][1]),
        (10, "the cat and the dog " * 3 + filler(6)),
    ]
    d = spark.createDataFrame([(*x, "c", "s") for x in docs], "doc_id long, text string, hash string, slots string")
    b = spark.createDataFrame([(*x, 0) for x in BENCH], "item_id long, text string, at int")
    got = {(r.doc_id, r.item_id): r for r in contaminated(d, b).collect()}
    assert set(got) == {(1, 1), (2, 1), (3, 1), (8, 2), (None, 2)}
    assert got[1, 1].verbatim and got[8, 2].verbatim and not got[3, 1].verbatim
    assert sorted(str(r.doc_id) for r in clean(d, b).collect()) == ["10", "4", "5", "6", "7", "9", "None"]
    assert contaminated(d.limit(0), b).count() == 0 and contaminated(d, b.limit(0)).count() == 0


def test_decontamination_finds_part_of_an_item(spark):
    rng = random.Random(6)
    word = lambda: "".join(rng.choices("aeioulmnrst", k=rng.randint(2, 9)))
    item = [word() for _ in range(50)]
    docs = []
    for i in range(20):
        a = rng.randrange(20)
        n = rng.choice([6, 16, 25])
        docs.append((i, " ".join([word() for _ in range(30)] + item[a : a + n] + [word() for _ in range(30)]), n))
    b = spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")
    got = {r.doc_id for r in contaminated(spark.createDataFrame(docs, "doc_id long, text string, n int"), b).collect()}
    assert got == {i for i, _, n in docs if n >= 16}


def leaks(spark, docs, items):
    d = spark.createDataFrame(docs, "doc_id long, text string")
    return {(r.doc_id, r.item_id) for r in contaminated(d, spark.createDataFrame(items, "item_id long, text string")).collect()}


def test_decontamination_judges_each_occurrence(spark):
    item = "a farmer keeps 12 hens in the old barn and sells 12 eggs on the market every 3 weeks of the year"
    ask = lambda a, b, c="every": f"a farmer keeps {a} hens in the old barn and sells {a} eggs on the market {c} {b} weeks of the year"
    rest = " ".join(f"u{i}x" for i in range(40))
    split = ask(9, 2).replace("eggs", "big eggs")
    docs = [
        (1, f"{ask(9, 2)} {rest} {ask(4, 7)}"),  # twice, with other values
        (2, f"{ask(9, 2)} {ask(4, 7)} {ask(5, 5)}"),  # a worksheet
        (3, f"{ask(9, 2)} {rest} a farmer keeps 4 hens in the old"),  # a copy and a stray window
        (4, f"{split} {rest} {split.replace('9', '4')}"),  # copies with a word put in
        (5, f"{ask(9, 2).replace('sells 9', 'sells 8')} {rest}"), (6, f"{ask(9, 2).replace('sells 9', 'sells 8')} {ask(4, 7).replace('sells 4', 'sells 5')}"),
        (7, ask(9, 2)), (7, ask(4, 7)),  # different texts under one id
    ]
    assert leaks(spark, docs, [(1, item)]) == {(i, 1) for i in (1, 2, 3, 4, 7)}


def test_decontamination_of_items_dense_in_numbers(spark):
    rest = " ".join(f"u{i}x" for i in range(20))
    items = [(1, "Compute 12 + 7 - 3 * 45 / 9"), (2, "31 41 59 26 53 58 97 93"), (3, "11, 22, 33, 44, 55, 66 and 77 go to 1, 2, 3, 4, 5, 6 and 7")]
    docs = [
        (1, f"{rest}. Compute 12 + 7 - 3 * 45 / 9 {rest}"), (2, f"{rest}. Compute 5 + 8 - 2 * 10 / 4"), (3, f"{rest} 31 41 59 26 53 58 97 93 {rest}"),
        (4, "11, 22, 33, 44, 55, 66 and 77 go to 1, 2, 3, 4, 5, 6 and 7"), (5, f"{rest} 1 2 3 4 5 6 7 8 9 {rest}"), (6, f"{rest} 31 {rest}"),
    ]
    assert leaks(spark, docs, items) == {(1, 1), (2, 1), (3, 2), (4, 3)}


def test_decontamination_of_names_in_any_context(spark):
    rest = " ".join(f"u{i}x" for i in range(20))
    tale = "{0} has {1} apples. {0} gives {2} pears. {3} keeps {4} plums now."
    items = [(1, tale.format("Alice", 5, 2, "Alice", 3)), (2, "What is the best price"), (3, "the shop sells 4 caps to\nMaria for 20 cents")]
    docs = [
        (1, f"{rest}. {tale.format('Bob', 7, 4, 'Bob', 6)}"), (2, f"{rest} we asked What is the best price {rest}"), (3, "WHAT IS THE BEST PRICE?"), (4, "they said, what is the best price"),
        (5, 'the shop sells 9 caps to "Tom" for 30 cents'), (6, f"{rest}. The shop sells 9 caps to Tom for 30 cents"),
        (7, tale.format("Bob", 7, 4, "Carl", 6)), (8, f"{rest} Alice has {rest}"),
    ]
    assert leaks(spark, docs, items) == {(1, 1), (2, 2), (3, 2), (4, 2), (5, 3), (6, 3)}


def test_decontamination_of_ideographs_and_short_items(spark):
    items = [(1, "\u6211\u4eec\u5728\u5546\u5e97\u4e70\u4e8612\u4e2a\u82f9\u679c\u548c3\u4e2a\u68a8\u5171\u82b1\u4e86\u591a\u5c11\u94b1"), (2, "too short an item"), (3, None)]
    docs = [(1, "\u6628\u5929" + items[0][1] + "\u3002"), (2, items[0][1].replace("12", "7").replace("3", "5")), (3, items[0][1][:6] + "\u4e0d\u540c\u7684\u5185\u5bb9\u5728\u8fd9\u91cc"), (4, "too short an item")]
    assert leaks(spark, docs, items) == {(1, 1), (2, 1)}
    b = spark.createDataFrame(items, "item_id long, text string")
    assert {r.item_id: r.n_tokens for r in short_items(b).collect()} == {2: 4, 3: 0}


def brute_leaks(docs, items, window=8, covered=13, percent=60):
    """Pairs by comparing every window of words with every other, for items without capitals: numbers are slots."""
    slot = lambda w: "#" if w.isdigit() else w
    out = set()
    for d, doc in docs:
        w = doc.split()
        for i, item in items:
            v = item.split()
            size = min(window, len(v))
            hits = [(a, b) for a in range(len(v) - size + 1) for b in range(len(w) - size + 1) if [slot(x) for x in v[a : a + size]] == [slot(x) for x in w[b : b + size]]]
            for diagonal in {b - a for a, b in hits}:
                mine = [(a, b) for a, b in hits if b - a == diagonal]
                for picked, strict in ((mine, False), ([(a, b) for a, b in mine if all(x == y or not x.isdigit() for x, y in zip(v[a : a + size], w[b : b + size]))], True)):
                    tokens = {a + k for a, _ in picked for k in range(size)}
                    pairs = {(v[a + k], w[b + k]) for a, b in picked for k in range(size) if v[a + k].isdigit()}
                    enough = len(tokens) >= covered or 100 * len(tokens) >= percent * len(v)
                    if enough and (strict or len({p for p, _ in pairs}) == len(pairs)):
                        out.add((d, i))
    return out


@pytest.mark.parametrize("seed", range(3))
def test_decontamination_equals_a_window_matcher(spark, seed):
    """Random templates; an item stands at most once in a document, so that an occurrence is a diagonal."""
    rng = random.Random(seed)
    words = [f"{a}{b}o" for a in "bdfgk" for b in "aeiu"]
    text = lambda n: [str(rng.randint(1, 9)) if rng.random() < 0.25 else rng.choice(words) + rng.choice(words) for _ in range(n)]
    items, docs = [(i, text(rng.randint(6, 30))) for i in range(12)], []
    for d in range(60):
        v = list(rng.choice(items)[1])
        a = rng.randrange(len(v) // 2)
        part = v[a : a + rng.randint(3, len(v))]
        kind, change = rng.randrange(4), dict(zip("123456789", rng.sample("123456789", 9)))
        part = [change.get(x, x) if kind == 1 else rng.choice("123456789") if kind == 2 and x.isdigit() else x for x in part]
        if kind == 3:
            part[rng.randrange(len(part))] = "other"
        docs.append((d, text(12) + part + text(12)))
    items, docs = [[(k, " ".join(x)) for k, x in rows] for rows in (items, docs)]
    want = brute_leaks(docs, items)
    assert leaks(spark, docs, items) == want and 10 < len(want) < 60


RULES = [Rule.parse("allow", "org/"), Rule.parse("block", "example.org/es/"), Rule.parse("block", "example.org/en/1"), Rule.parse("allow", "com/fr/"), Rule.parse("block", "com/de/")]


def brute_verdict(host, path):
    fits = [r for r in RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    return max(fits, key=lambda r: (r.host.count("."), len(r.path)), default=None)


def test_url_verdicts(spark):
    urls = ["http://A.Example.ORG/en/123?q#f", "https://example.org/en/2", "x://example.org", "http://badexample.org/es/", "http://example.org/es/x", "http://x.com/fr/1", "http://com/de/", "http://x.com/de", "no scheme", None, "", "http:///p", "http://h?x/y", "http://a.net#://b", "ftp://É.ORG/ü/", "a://b://c/d"]
    rng = random.Random(7)
    urls += [f"http://{rng.choice(['', 'a.', 'b.c.'])}{rng.choice(['example.org', 'org', 'x.com', 'com', 'net'])}{rng.choice(['', '/', '/en/1', '/en/12/', '/es', '/es/', '/fr/', '/de/9'])}" for _ in range(200)]
    pages = spark.createDataFrame([(i, u, "host", "path") for i, u in enumerate(urls)], "page_id long, url string, host string, rule string")
    for r in url_verdicts(pages, RULES).collect():
        url = urls[r.page_id]
        m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url) if url and "://" in url else None
        host, path = (re.sub("[A-Z]", lambda x: x[0].lower(), m[1]), m[2]) if m else ("", "")
        best = brute_verdict(host, path)
        assert (r.host, r.path, r.rule, r.verdict) == (host, path, best and best.name, best.verdict if best else "allow")
    assert url_verdicts(pages.limit(0), RULES).count() == 0
    assert {r.verdict for r in url_verdicts(pages, [], default="block").collect()} == {"block"}


def test_long_url_segments_cost_a_few_lookups():
    trie = Trie([*RULES, Rule("block", "org", "/" + "a" * 50)])
    began = time.time()
    for tail in ("a" * 1_000_000, "a" * 49, "b" * 1_000_000, "a/" * 500_000):
        found = trie.match("x.org", "/" + tail)
        assert found[1].verdict == ("block" if tail.startswith("a" * 50) else "allow")
    assert time.time() - began < 2


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["allow", "block"]), st.sampled_from(["a", "b.a", "c.b.a"]), st.sampled_from(["/", "/x", "/x/", "/x/y", "/x/yz", "/xy/"])), max_size=6), st.sampled_from(["a", "b.a", "d.c.b.a", "z"]), st.sampled_from(["", "/", "/x", "/x/yz/w", "/xy/", "/q"]))
def test_trie_against_scan(rules, host, path):
    rules = [Rule(*r) for r in rules]
    fits = [r for r in rules if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    want = max(fits, key=lambda r: (r.host.count("."), len(r.path), r.verdict), default=None)
    got = Trie(rules).match(host, path)
    assert (got and (got[1].name, got[1].verdict)) == (want and (want.name, want.verdict))


RECORD = {"record_id": "urn:x:1", "record_type": "response", "target_uri": "http://a/\r\nb", "date": "2024-01-01T00:00:00Z", "refers_to": None, "payload_digest": hashlib.sha1(b"hi\r\n\r\nthere").hexdigest(), "payload_bytes": 11, "payload": b"hi\r\n\r\nthere"}


@pytest.mark.parametrize("pack", [lambda x: x, warc.gzip_member, lambda x: __import__("gzip").compress(x)], ids=["plain", "sl", "gzip"])
def test_warc_records_round_trip(pack):
    rng = random.Random(8)
    rows = []
    for i in range(30):
        body = rng.randbytes(rng.choice([0, 1, 1000, 70_000, 300_000]))
        again = i % 5 == 4
        rows.append({**RECORD, "record_id": f"urn:x:{i}", "record_type": "revisit" if again else "response", "refers_to": "urn:x:0" if again else None, "payload": None if again else body, "payload_bytes": len(body), "payload_digest": hashlib.sha1(body).hexdigest()})
    data = b"".join(pack(warc.encoded_record(r)) for r in rows)
    got = list(warc.records(io.BytesIO(data), len(data), [], True))
    assert [(r["record_id"], r["record_type"], r["payload"], r["payload_bytes"], r["payload_digest"], r["refers_to"]) for r in got] == [(r["record_id"], r["record_type"], r["payload"], r["payload_bytes"], r["payload_digest"], r["refers_to"]) for r in rows]
    assert got[0]["target_uri"] == "http://a/%0D%0Ab"
    only = list(warc.records(io.BytesIO(data), len(data), [warc.EqualTo(("record_type",), "revisit")], True))
    assert [r["record_id"] for r in only] == [f"urn:x:{i}" for i in range(4, 30, 5)]
    assert all(r["payload"] is None for r in warc.records(io.BytesIO(data), len(data), [], False))


class Counted(io.BytesIO):
    """Counts what is read."""

    taken = 0

    def read(self, n=-1):
        out = super().read(n)
        self.taken += len(out)
        return out


@pytest.mark.parametrize("pack", [lambda x: x, warc.gzip_member], ids=["plain", "sl"])
def test_warc_skips_without_reading_twice(pack):
    rng = random.Random(9)
    rows = [{**RECORD, "record_id": f"urn:x:{i}", "payload": rng.randbytes(rng.choice([10, 3000, 500_000])), "payload_bytes": 1} for i in range(400)]
    data = b"".join(pack(warc.encoded_record(r)) for r in rows)
    file = Counted(data)
    assert list(warc.records(file, len(data), [warc.EqualTo(("record_type",), "revisit")], True)) == []
    assert file.taken <= 1.05 * len(data)
    file = Counted(data)
    assert len(list(warc.records(file, len(data), [], True))) == 400 and file.taken <= 1.05 * len(data)


@pytest.mark.parametrize("pack", [lambda x: x, warc.gzip_member, lambda x: __import__("gzip").compress(x, 1)], ids=["plain", "sl", "gzip"])
def test_warc_long_payload(pack):
    body = random.Random(10).randbytes(1 << 20) * 50
    row = {**RECORD, "payload": body, "payload_bytes": len(body)}
    data = pack(warc.encoded_record(row)) + pack(warc.encoded_record(RECORD)) + b"\r\n" * 40_000
    got = list(warc.records(io.BytesIO(data), len(data), [], True))
    assert [r["payload_bytes"] for r in got] == [len(body), 11] and got[0]["payload"] == body and got[1]["payload"] == RECORD["payload"]
    with pytest.raises(ValueError):
        list(warc.records(io.BytesIO(b"no archive" * 10), 100, [], True))


def test_warc_overwrite_and_file_size(spark):
    warc.registered(spark)
    path = new_path(spark, "warc-over")
    rows = spark.createDataFrame([(f"urn:{i}", "response", None, "2024-01-01T00:00:00Z", None, None, 5, bytes(random.Random(i).randbytes(5000))) for i in range(40)], warc.SCHEMA).coalesce(1)
    for mode, n in (("append", 40), ("append", 80), ("overwrite", 40), ("overwrite", 40)):
        rows.write.format("warc").mode(mode).option("file_bytes", 50_000).save(path)
        assert spark.read.format("warc").load(path).count() == n
    import os

    names = [x for x in os.listdir(path.removeprefix("file://")) if x.endswith(".warc.gz")]
    assert len(names) == 4
    spark.conf.unset("spark.sql.python.filterPushdown.enabled")
    assert spark.read.format("warc").option("pushdown", "false").load(path).filter("record_id = 'urn:3'").count() == 1
    warc.registered(spark)


@pytest.mark.parametrize("compression", ["gzip", "none"])
def test_warc_data_source(spark, compression):
    spark.dataSource.register(warc.WarcDataSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    path = new_path(spark, "warc-test")
    rows = [(f"urn:{i}", "revisit" if i % 3 == 0 else "response", f"http://h/{i}", "2024-01-01T00:00:00Z", "urn:1" if i % 3 == 0 else None, hashlib.sha1(b"%d" % i).hexdigest(), len(str(i)), None if i % 3 == 0 else b"%d" % i) for i in range(50)]
    spark.createDataFrame(rows, warc.SCHEMA).repartition(3).write.format("warc").mode("append").option("compression", compression).save(path)
    back = spark.read.format("warc").load(path)
    assert sorted(tuple(r[:7]) + (r.payload and bytes(r.payload),) for r in back.collect()) == sorted(rows)
    assert back.filter("record_type = 'revisit' AND payload_bytes > 1").count() == sum(i % 3 == 0 and i > 9 for i in range(50))
    assert back.filter("target_uri LIKE 'http://h/4%'").count() == 11
    assert spark.read.format("warc").option("payload", "false").load(path).filter("payload IS NOT NULL").count() == 0


def test_warc_empty_table(spark):
    spark.dataSource.register(warc.WarcDataSource)
    path = new_path(spark, "warc-empty")
    spark.createDataFrame([], warc.SCHEMA).write.format("warc").mode("append").save(path)
    assert spark.read.format("warc").load(path).count() == 0


def test_mixing_of_rows_all_alike(spark):
    docs = spark.range(5000).select(F.lit(None).cast("long").alias("doc_id"), F.lit("a").alias("source"), F.lit(10).cast("long").alias("size")).unionByName(spark.createDataFrame([(1, "b", 30_000)], "doc_id long, source string, size long"))
    sources = mixing.source_table(docs)
    got = mixing.mixed(docs, mixing.cyclic_weights(sources), sources).filter("source = 'a'")
    r = got.agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("copies") * F.col("size")).alias("taken"), F.first("target").alias("target")).first()
    assert r.n == 5000 and abs(r.taken - r.target) <= 10
