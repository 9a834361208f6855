"""The registered queries of the library's own operators, and their SQL oracles.

Supports and thresholds are fixed or follow from the whole input; every query reads whole
tables.  A LIMIT stands only where the query is a top-n report.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from oreflow.functions import hashing
from oreflow.functions.hashing import LCG_ACCEPT, LCG_SLOT, linear_family
from oreflow.functions.storage import kept, new_path, settled
from oreflow.operators import cluster, graph, itemsets, recommend, relational, sampling, similarity, sketch, text
from oreflow.plans.datasets import SQL as VIEWS
from oreflow.plans.datasets import brand_baskets, businesses, reviews, table
from oreflow.sources import readers, writers
from oreflow.streaming import windows

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}

STOPWORDS = ["the", "of", "and", "in", "is", "de", "la", "der", "die", "el", "que", "le"]
YEAR, STATE, TOP = "1996", "NATION_3", 10
GRAPH_THRESHOLD = 7
SUPPORT_PER_MILLE = (9, 2)
"""Support as a fraction of the baskets: 9 / 2 per thousand."""
BFR_CHUNKS = 5
SQL_SIZES = 7
"""Largest itemsets that the SQL counts; the supports leave no larger ones in the tables tested.  The operators have no such bound."""


def query(oracle: str | None = None):
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if oracle:
            ORACLE[f.__name__] = oracle
        return f

    return register


def _with(*views: str, rest: str = "") -> str:
    parts = [f"{v} AS ({VIEWS[v]})" for v in views] + ([rest] if rest else [])
    return "WITH " + ("RECURSIVE " if "RECURSIVE" in rest else "") + ", ".join(parts).replace("RECURSIVE ", "") + " "


def _stopwords(spark: SparkSession) -> DataFrame:
    return readers.local_rows(spark, [(w,) for w in STOPWORDS], "word string")


_SW = ", ".join(f"'{w}'" for w in STOPWORDS)
_BLANKS = "' ' || chr(9) || chr(10) || chr(13) || chr(11) || chr(12)"
_TOKENS = f"tok AS (SELECT doc_id, trim(lower(t), {_BLANKS}) AS word FROM (SELECT doc_id, unnest(string_split(text, ' ')) AS t FROM documents)), words AS (SELECT doc_id, word FROM tok WHERE word NOT IN ('', '(', '[', ',', '.', '!', '?', ':', ';', ']', ')', {_SW}))"


# Exploration


@query(_with("reviews") + "SELECT count(*) AS n FROM reviews")
def review_count(spark, d):
    return relational.row_count(reviews(spark, d))


@query(_with("reviews") + f"SELECT count(*) AS n FROM reviews WHERE date LIKE '%{YEAR}%'")
def review_count_in_year(spark, d):
    return relational.count_containing(reviews(spark, d), YEAR)


@query(_with("reviews") + "SELECT count(*) AS n FROM (SELECT DISTINCT user_id FROM reviews)")
def distinct_users(spark, d):
    return relational.distinct_count(reviews(spark, d), "user_id")


@query(_with("reviews") + f"SELECT user_id, count(*) AS n FROM reviews GROUP BY user_id ORDER BY n DESC, user_id LIMIT {TOP}")
def top_users(spark, d):
    return relational.top_counts(reviews(spark, d), "user_id", TOP)


@query("WITH " + _TOKENS + f" SELECT word, count(*) AS n FROM words GROUP BY word ORDER BY n DESC, word LIMIT {TOP}")
def top_words(spark, d):
    return relational.top_words(table(spark, d, "documents"), _stopwords(spark), TOP)


@query(_with("reviews", "businesses") + f"SELECT category, sum(stars) / count(stars) AS avg_stars FROM (SELECT trim(c, {_BLANKS}) AS category, stars FROM (SELECT unnest(string_split(categories, ',')) AS c, stars FROM reviews JOIN businesses USING (business_id) WHERE stars IS NOT NULL)) GROUP BY category ORDER BY avg_stars DESC, category LIMIT {TOP}")
def category_avg_stars(spark, d):
    return relational.category_avg_stars(reviews(spark, d), businesses(spark, d), TOP)


@query(_with("reviews") + "SELECT business_id, count(*) AS n FROM reviews GROUP BY business_id HAVING count(*) > 40")
def business_count_having(spark, d):
    return relational.businesses_over(reviews(spark, d), 40)


@query(_with("reviews") + "SELECT count(*) AS n_rows, 20 AS n_partitions FROM reviews")
def partition_layout(spark, d):
    """The sizes of the partitions, added up, as which row lies where is the engine's own hash."""
    return relational.partition_layout(reviews(spark, d), "business_id", 20).agg(F.sum("n_items").alias("n_rows"), F.count_distinct("partition_id").cast("int").alias("n_partitions"))


@query(_with("supplier_reviews") + f"SELECT user_id, business_id FROM supplier_reviews JOIN supplier ON business_id = s_suppkey JOIN nation ON s_nationkey = n_nationkey WHERE n_name = '{STATE}'")
def state_filter_join(spark, d):
    places = table(spark, d, "supplier").join(table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_suppkey").alias("business_id"), F.col("n_name").alias("state"))
    return relational.user_business(places, reviews(spark, d, "l_suppkey"), STATE)


# Baskets and itemsets


@query(_with("brand_baskets") + "SELECT basket, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT basket, item FROM brand_baskets) GROUP BY basket")
def baskets_case1(spark, d):
    return itemsets.baskets(brand_baskets(spark, d), "basket", "item").select("basket", F.array_join("items", ",").alias("items"))


@query(_with("reviews") + "SELECT basket, CAST(count(*) AS BIGINT) AS n_items, CAST(min(item) AS BIGINT) AS low, CAST(max(item) AS BIGINT) AS high FROM (SELECT DISTINCT business_id AS basket, user_id AS item FROM reviews) GROUP BY basket HAVING count(*) > 25")
def baskets_case2(spark, d):
    b = itemsets.baskets(reviews(spark, d), "business_id", "user_id", more_than=25)
    return b.select("basket", F.size("items").cast("long").alias("n_items"), F.array_min("items").alias("low"), F.array_max("items").alias("high"))


def _baskets(spark, d) -> tuple[DataFrame, int]:
    b = kept(itemsets.baskets(brand_baskets(spark, d), "basket", "item"), "baskets")
    per, by = SUPPORT_PER_MILLE
    return b, max(1, -(-b.count() * per // (by * 1000)))


def _itemset_sql() -> str:
    per, by = SUPPORT_PER_MILLE
    sql = _with("brand_baskets") + f", b AS (SELECT DISTINCT basket, item FROM brand_baskets), s AS (SELECT (count(DISTINCT basket) * {per} + {by * 1000 - 1}) // {by * 1000} AS least FROM b), found AS ("
    parts = []
    for k in range(1, SQL_SIZES + 1):
        joins = " ".join(f"JOIN b b{i} ON b{i}.basket = b0.basket AND b{i}.item > b{i - 1}.item" for i in range(1, k))
        items = ", ".join(f"b{i}.item" for i in range(k))
        parts.append(f"SELECT concat_ws(',', {items}) AS itemset, {k} AS size, count(*) AS freq FROM b b0 {joins} GROUP BY {items} HAVING count(*) >= (SELECT least FROM s)")
    return sql + " UNION ALL ".join(parts) + ") "


def _joined(sets: DataFrame) -> DataFrame:
    return sets.select(F.array_join("itemset", ",").alias("itemset"), F.col("size").cast("int").alias("size"), "freq")


@query(_itemset_sql() + "SELECT itemset, CAST(size AS INT) AS size, freq FROM found")
def frequent_itemsets_apriori(spark, d):
    return _joined(itemsets.apriori(*_baskets(spark, d)))


@query(ORACLE["frequent_itemsets_apriori"])
def frequent_itemsets_fpgrowth(spark, d):
    return _joined(itemsets.fp_growth(*_baskets(spark, d)))


@query(_itemset_sql() + "SELECT label, (SELECT count(*) FROM found) AS n FROM (VALUES ('Task2'), ('Task3'), ('Intersection')) t(label)")
def itemset_comparison(spark, d):
    b, support = _baskets(spark, d)
    return itemsets.compare_itemsets(itemsets.apriori(b, support), itemsets.fp_growth(b, support))


@query(_itemset_sql() + "SELECT CAST(size AS INT) AS size, string_agg(s, ',' ORDER BY s) AS line FROM (SELECT size, '(''' || replace(itemset, ',', ''', ''') || ''')' AS s FROM found) GROUP BY size")
def itemset_report(spark, d):
    return itemsets.itemset_report(itemsets.apriori(*_baskets(spark, d)))


def _son_sql(parts: int) -> str:
    sql = _with("brand_baskets") + f", b AS (SELECT DISTINCT basket, item, basket % {parts} AS part FROM brand_baskets), s AS (SELECT (count(DISTINCT basket) * {SUPPORT_PER_MILLE[0]} + {SUPPORT_PER_MILLE[1] * 1000 - 1}) // {SUPPORT_PER_MILLE[1] * 1000} AS least, count(DISTINCT basket) AS total FROM b), z AS (SELECT part, count(DISTINCT basket) AS n FROM b GROUP BY part), found AS ("
    each = []
    for k in range(1, SQL_SIZES + 1):
        joins = " ".join(f"JOIN b b{i} ON b{i}.basket = b0.basket AND b{i}.item > b{i - 1}.item" for i in range(1, k))
        items = ", ".join(f"b{i}.item" for i in range(k))
        each.append(f"SELECT concat_ws(',', {items}) AS itemset, b0.part, count(*) AS freq FROM b b0 {joins} GROUP BY {items}, b0.part")
    return sql + " UNION ALL ".join(each) + ") SELECT itemset, count(*) AS n_parts FROM found JOIN z USING (part), s WHERE freq * total >= least * n GROUP BY itemset"


@query(_son_sql(4))
def son_candidates(spark, d):
    return itemsets.son_candidates(*_baskets(spark, d), part=F.pmod("basket", F.lit(4)).cast("int")).select(F.array_join("itemset", ",").alias("itemset"), "n_parts")


@query(ORACLE["frequent_itemsets_apriori"])
def son_itemsets(spark, d):
    return _joined(itemsets.son(*_baskets(spark, d)))


# Similarity


def _jaccard_sql(view: str, id_col: str, item: str) -> str:
    return f"m AS (SELECT DISTINCT {id_col} AS id, {item} AS item FROM {view}), c AS (SELECT a.id AS id1, b.id AS id2, count(*) AS shared FROM m a JOIN m b ON a.item = b.item AND a.id < b.id GROUP BY 1, 2), z AS (SELECT id, count(*) AS n FROM m GROUP BY id), j AS (SELECT id1, id2, shared / (x.n + y.n - shared) AS sim FROM c JOIN z x ON x.id = id1 JOIN z y ON y.id = id2)"


def _rounded(df: DataFrame, digits: int = 9) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c, t in df.dtypes if t == "double"})


@query(_with("reviews", rest=_jaccard_sql("reviews", "business_id", "user_id")) + "SELECT id1, id2, round(sim, 9) AS sim FROM j WHERE sim >= 0.05")
def jaccard_exact(spark, d):
    return _rounded(similarity.jaccard_exact(reviews(spark, d), "business_id", "user_id", 0.05))


def _minhash_sql(view: str, id_col: str, item: str, rows: int, seed: int) -> str:
    """Signatures; the modulus is the next prime above the number of items (over 500, so the parameters are known)."""
    params = linear_family(rows, 1_000_003, 500, 50_000, seed)
    mins = ", ".join(f"min(({a} * idx + {b}) % p) AS h{i}" for i, (a, b) in enumerate(params))
    return (
        f"i AS (SELECT item, row_number() OVER (ORDER BY item) - 1 AS idx FROM (SELECT DISTINCT {item} AS item FROM {view})), "
        "k AS (SELECT count(*) AS n FROM i), "
        "pr AS (SELECT min(p) AS p FROM (SELECT unnest(range((SELECT n + 1 FROM k), (SELECT n + 2000 FROM k))) AS p) q WHERE NOT EXISTS (SELECT 1 FROM range(2, 2000) r(x) WHERE x * x <= p AND p % x = 0)), "
        f"sig AS (SELECT id, {mins} FROM (SELECT DISTINCT {id_col} AS id, {item} AS item FROM {view}) JOIN i USING (item), pr GROUP BY id)"
    )


def _band_sql(rows: int) -> str:
    bands = " UNION ALL ".join(f"SELECT {b} AS band, id, h{b} AS h FROM sig" for b in range(rows))
    return f"bands AS ({bands}), cand AS (SELECT DISTINCT a.id AS id1, b.id AS id2 FROM bands a JOIN bands b ON a.band = b.band AND a.h = b.h AND a.id < b.id)"


MINHASH_ROWS, MINHASH_SEED, USER_SEED = 40, 7, 11


@query(_with("reviews", rest=_minhash_sql("reviews", "business_id", "user_id", MINHASH_ROWS, MINHASH_SEED)) + "SELECT id, concat_ws(',', " + ", ".join(f"h{i}" for i in range(MINHASH_ROWS)) + ") AS signature FROM sig")
def minhash_signature(spark, d):
    r = reviews(spark, d)
    sig = similarity.minhash_signatures(r, "business_id", "user_id", *similarity.family(r, "user_id", MINHASH_ROWS, MINHASH_SEED))
    return sig.select("id", F.concat_ws(",", *(F.col(f"h{i}").cast("string") for i in range(MINHASH_ROWS))).alias("signature"))


@query(_with("reviews", rest=_minhash_sql("reviews", "business_id", "user_id", MINHASH_ROWS, MINHASH_SEED) + ", " + _band_sql(MINHASH_ROWS) + ", " + _jaccard_sql("reviews", "business_id", "user_id")) + "SELECT id1, id2, round(sim, 9) AS sim FROM j JOIN cand USING (id1, id2) WHERE sim >= 0.05")
def minhash_lsh_pairs(spark, d):
    return _rounded(similarity.minhash_pairs(reviews(spark, d), "business_id", "user_id", MINHASH_ROWS, 1, 0.05, MINHASH_SEED))


# Text profiles

_NUMBER = r"[+-]?([0-9]+(_[0-9]+)*(\.([0-9]+(_[0-9]+)*)?)?|\.[0-9]+(_[0-9]+)*)(e[+-]?[0-9]+(_[0-9]+)*)?|[+-]?(nan|inf|infinity)|\pN"
_TFIDF = (
    "WITH " + _TOKENS + f", good AS (SELECT doc_id, word FROM words WHERE NOT regexp_full_match(word, '{_NUMBER}')), tf AS (SELECT doc_id, word, count(*) AS c FROM good GROUP BY ALL), "
    "f AS (SELECT word, count(*) AS df, sum(c) AS cf FROM tf GROUP BY word HAVING sum(c) >= 1e-6 * (SELECT sum(c) FROM tf)), "
    "sc AS (SELECT doc_id, word, round(c / max(c) OVER (PARTITION BY doc_id) * log10((SELECT count(DISTINCT doc_id) FROM documents) / df), 9) AS tfidf FROM tf JOIN f USING (word)), "
    "prof AS (SELECT doc_id AS business_id, word, tfidf, rank FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY tfidf DESC, word) AS rank FROM sc) WHERE rank <= 200), "
    "visits AS (SELECT DISTINCT source AS user_id, doc_id AS business_id FROM documents), users AS (SELECT DISTINCT user_id, word FROM visits JOIN prof USING (business_id)) "
)


def _profiles(spark, d) -> tuple[DataFrame, DataFrame]:
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("business_id"), "text", F.col("source").alias("user_id"))
    return text.tfidf_profiles(docs, _stopwords(spark)), docs.select("user_id", "business_id")


@query(_TFIDF + "SELECT business_id, word, tfidf, CAST(rank AS INT) AS rank FROM prof")
def tfidf_profile(spark, d):
    return _profiles(spark, d)[0]


@query(_TFIDF + "SELECT user_id, word FROM users")
def user_profile(spark, d):
    return text.user_profiles(*_profiles(spark, d))


@query(_TFIDF + ", nb AS (SELECT business_id, count(*) AS nb FROM prof GROUP BY 1), nu AS (SELECT user_id, count(*) AS nu FROM users GROUP BY 1), sh AS (SELECT user_id, business_id, count(*) AS shared FROM visits JOIN prof USING (business_id) JOIN users USING (user_id, word) GROUP BY 1, 2) SELECT user_id, business_id, round(shared / (sqrt(nb) * sqrt(nu)), 9) AS sim FROM sh JOIN nb USING (business_id) JOIN nu USING (user_id) WHERE shared / (sqrt(nb) * sqrt(nu)) >= 0.01")
def content_predict(spark, d):
    profiles, visits = _profiles(spark, d)
    profiles = kept(profiles, "profiles")
    return _rounded(text.content_predict(profiles, text.user_profiles(profiles, visits), visits))


# Recommenders


def _ratings_sql(view: str) -> str:
    return f"rt AS (SELECT user_id, business_id, avg(stars) AS stars FROM {view} GROUP BY 1, 2)"


def _pearson_sql(id_col: str, other: str, only: str = "") -> str:
    return f"model AS (SELECT id1, id2, sim FROM (SELECT a.{id_col} AS id1, b.{id_col} AS id2, round(coalesce(covar_pop(a.stars, b.stars) / nullif(stddev_pop(a.stars) * stddev_pop(b.stars), 0), 0), 9) AS sim FROM rt a JOIN rt b ON a.{other} = b.{other} AND a.{id_col} < b.{id_col} {only} GROUP BY 1, 2 HAVING count(*) >= 3) WHERE sim > 0)"


_ITEM_MODEL = _ratings_sql("supplier_reviews") + ", " + _pearson_sql("business_id", "user_id")
_USER_MODEL = (
    _minhash_sql("reviews", "user_id", "business_id", MINHASH_ROWS, USER_SEED) + ", " + _band_sql(MINHASH_ROWS) + ", " + _jaccard_sql("reviews", "user_id", "business_id")
    + ", near AS (SELECT id1, id2 FROM j JOIN cand USING (id1, id2) WHERE sim >= 0.01), " + _ratings_sql("reviews") + ", " + _pearson_sql("user_id", "business_id", "JOIN near ON id1 = a.user_id AND id2 = b.user_id")
)
_MEANS = ", um AS (SELECT user_id, avg(stars) AS user_mean FROM rt GROUP BY 1), im AS (SELECT business_id, avg(stars) AS item_mean FROM rt GROUP BY 1), both_ways AS (SELECT id1, id2, sim FROM model UNION ALL SELECT id2, id1, sim FROM model), pairs AS (SELECT DISTINCT user_id, business_id FROM rt)"
_GUESS = ", guess AS (SELECT user_id, business_id, sum(sim * s) / nullif(sum(abs(sim)), 0) AS guess FROM near_n WHERE k <= 5 GROUP BY 1, 2)"


@query(_with("supplier_reviews", rest=_ITEM_MODEL) + "SELECT id1, id2, sim FROM model")
def item_cf_model(spark, d):
    return recommend.cf_train(settled(recommend.ratings_of(reviews(spark, d, "l_suppkey")), "ratings"), "item")


@query(_with("reviews", rest=_USER_MODEL) + "SELECT id1, id2, sim FROM model")
def user_cf_model(spark, d):
    return recommend.cf_train(recommend.ratings_of(reviews(spark, d)), "user", seed=USER_SEED)


@query(_with("supplier_reviews", rest=_ITEM_MODEL + _MEANS + ", near_n AS (SELECT p.user_id, p.business_id, sim, r.stars AS s, row_number() OVER (PARTITION BY p.user_id, p.business_id ORDER BY sim DESC, id2) AS k FROM pairs p JOIN both_ways ON id1 = p.business_id JOIN rt r ON r.user_id = p.user_id AND r.business_id = id2)" + _GUESS) + "SELECT user_id, business_id, round(coalesce(guess, item_mean, user_mean), 6) AS stars FROM pairs LEFT JOIN um USING (user_id) LEFT JOIN im USING (business_id) LEFT JOIN guess USING (user_id, business_id)")
def item_cf_predict(spark, d):
    ratings = settled(recommend.ratings_of(reviews(spark, d, "l_suppkey")), "ratings")
    model = settled(recommend.cf_train(ratings, "item"), "model")
    return _rounded(recommend.cf_predict(ratings, model, ratings.select("user_id", "business_id"), "item"), 6)


@query(_with("reviews", rest=_USER_MODEL + _MEANS + ", near_n AS (SELECT p.user_id, p.business_id, sim, r.stars - um.user_mean AS s, row_number() OVER (PARTITION BY p.user_id, p.business_id ORDER BY sim DESC, id2) AS k FROM pairs p JOIN both_ways ON id1 = p.user_id JOIN rt r ON r.business_id = p.business_id AND r.user_id = id2 JOIN um ON um.user_id = id2)" + _GUESS) + "SELECT user_id, business_id, round(coalesce(user_mean + guess, user_mean, item_mean), 6) AS stars FROM pairs LEFT JOIN um USING (user_id) LEFT JOIN im USING (business_id) LEFT JOIN guess USING (user_id, business_id)")
def user_cf_predict(spark, d):
    ratings = settled(recommend.ratings_of(reviews(spark, d)), "ratings")
    model = settled(recommend.cf_train(ratings, "user", seed=USER_SEED), "model")
    return _rounded(recommend.cf_predict(ratings, model, ratings.select("user_id", "business_id"), "user"), 6)


# Sketches and samples


def _bytes_mod_sql(c: str, m: int) -> str:
    return f"(list_reduce(list_transform(string_split({c}, ''), lambda x: CAST(ascii(x) AS BIGINT)), lambda a, b: (a * 256 + b) % {m}) % {m})"


def _bits_sql(c: str) -> str:
    return "[" + ", ".join(f"({a} * {c} + {b}) % 10000" for a, b in sketch.bloom_params()) + "]"


@query(f"WITH bits AS (SELECT DISTINCT unnest({_bits_sql('x')}) AS bit FROM (SELECT {_bytes_mod_sql('n_name', 10000)} AS x FROM nation)), probe AS (SELECT s_name AS value FROM supplier UNION ALL SELECT n_name FROM nation) SELECT value, CAST(len(list_filter(list_transform({_bits_sql('x')}, lambda b: list_contains(filled, b)), lambda t: t)) = 3 AS INT) AS flag FROM (SELECT value, {_bytes_mod_sql('value', 10000)} AS x FROM probe), (SELECT list(bit) AS filled FROM bits)")
def bloom_probe(spark, d):
    nations = table(spark, d, "nation").select(F.col("n_name").alias("value"))
    probe = table(spark, d, "supplier").select(F.col("s_name").alias("value")).unionByName(nations)
    return sketch.bloom_probe(nations, probe, "value")


_HASH31 = "list_reduce(list_prepend(CAST(0 AS BIGINT), list_transform(string_split(n_name, ''), lambda x: CAST(ascii(x) AS BIGINT))), lambda a, b: (a * 31 + b) % 4294967296)"


@query(f"SELECT n_name, least(h, 4294967296 - h) AS code FROM (SELECT n_name, {_HASH31} AS h FROM nation)")
def string_hash(spark, d):
    return table(spark, d, "nation").select("n_name", hashing.string_hash(F.col("n_name")).alias("code"))


_UNSIGNED = _TOKENS.replace("string_split(text, ' ')", "string_split(regexp_replace(text, '[()|\\[\\]\",.!:;?]', '', 'g'), ' ')")


@query("WITH " + _UNSIGNED + " SELECT word, count(*) AS n FROM words GROUP BY word")
def word_counts_without_signs(spark, d):
    return relational.word_counts(table(spark, d, "documents"), _stopwords(spark), without_signs=True)


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)")
def exact_semi(spark, d):
    return table(spark, d, "customer").join(table(spark, d, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey", "c_name")


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def exact_anti(spark, d):
    return table(spark, d, "customer").join(table(spark, d, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey", "c_name")


def _lcg_sql(n: str, p: tuple[int, int, int]) -> str:
    m = 2147483647
    return f"(((({n} * {n}) % {m}) * {p[0]} + ({n} % {m}) * {p[1]} + {p[2]}) % {m})"


_RESERVOIR = (
    "WITH e AS (SELECT event_id, event_type, props, row_number() OVER (ORDER BY event_id) AS n FROM events), "
    f"s AS (SELECT *, CASE WHEN n <= 100 THEN n WHEN {_lcg_sql('n', LCG_ACCEPT)} * n <= 214748364700 THEN {_lcg_sql('n', LCG_SLOT)} * 100 // 2147483647 + 1 END AS slot FROM e), "
    "res AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY slot ORDER BY n DESC) AS k FROM s WHERE slot IS NOT NULL) WHERE k = 1) "
)


def _sample(spark, d) -> DataFrame:
    return sampling.reservoir(sampling.numbered(table(spark, d, "events").select("event_id", "event_type", "props"), "event_id"), "n")


@query(_RESERVOIR + "SELECT CAST(slot AS BIGINT) AS slot, event_id, event_type, n FROM res")
def reservoir_sample(spark, d):
    return _sample(spark, d).select("slot", "event_id", "event_type", "n")


@query(_RESERVOIR + ", tags AS (SELECT event_type AS tag FROM res UNION ALL SELECT 'k' || CAST(regexp_extract(props, '[0-9]+') AS INT) % 10 FROM res), f AS (SELECT tag, count(*) AS n FROM tags GROUP BY tag) SELECT tag, n FROM (SELECT tag, n, dense_rank() OVER (ORDER BY n DESC) AS r FROM f) WHERE r <= 3")
def top_hashtag_ranks(spark, d):
    tag = F.array("event_type", F.concat(F.lit("k"), (F.get_json_object("props", "$.k").cast("int") % 10).cast("string")))
    return sampling.top_levels(_sample(spark, d).select(F.explode(tag).alias("tag")))


LENGTH, SLIDE = "30 minutes", "10 minutes"
_WINDOWS = "w AS (SELECT time_bucket(INTERVAL 10 MINUTE, ts) - to_minutes(CAST(10 * k AS BIGINT)) AS window_start, CAST(user_id AS VARCHAR) AS v FROM events, range(3) t(k))"


def _fm_sql() -> str:
    params, m = sketch.fm_params()
    tails = []
    for a, b in params:
        h = f"bin(({a} * x + {b}) % {m})"
        tails.append(f"max(length({h}) - length(rtrim({h}, '0')))")
    means = ", ".join(f"list_avg(list_transform(t[{7 * g + 1}:{7 * g + 7}], lambda r: pow(2.0, r)))" for g in range(7))
    return f"WITH {_WINDOWS}, u AS (SELECT DISTINCT window_start, v FROM w), x AS (SELECT window_start, {_bytes_mod_sql('v', m)} AS x FROM u), g AS (SELECT window_start, count(*) AS truth, list_sort([{', '.join(tails)}]) AS t FROM x GROUP BY window_start) SELECT window_start, truth, CAST(floor(list_sort([{means}])[4]) AS BIGINT) AS estimate FROM g"


def _city_events(spark, d) -> DataFrame:
    return table(spark, d, "events").select("ts", F.col("user_id").cast("string").alias("v"))


@query(_fm_sql())
def fm_distinct_windows(spark, d):
    return sketch.fm_windows(_city_events(spark, d), "ts", "v", LENGTH, SLIDE)


@query(f"WITH {_WINDOWS} SELECT window_start, count(DISTINCT v) AS n FROM w GROUP BY window_start")
def distinct_windows_exact(spark, d):
    return sketch.distinct_windows(_city_events(spark, d), "ts", "v", LENGTH, SLIDE)


@query()
def hll_windows(spark, d):
    return sketch.distinct_windows(_city_events(spark, d), "ts", "v", LENGTH, SLIDE, approximate=True)


# Graphs

_EDGES = f"m AS (SELECT DISTINCT user_id AS id, business_id AS item FROM reviews), ed AS (SELECT a.id AS a, b.id AS b FROM m a JOIN m b ON a.item = b.item AND a.id < b.id GROUP BY 1, 2 HAVING count(*) >= {GRAPH_THRESHOLD}), s AS (SELECT a, b FROM ed UNION ALL SELECT b, a FROM ed)"


def _edges(spark, d) -> DataFrame:
    return kept(graph.cooccurrence_graph(reviews(spark, d), "user_id", "business_id", GRAPH_THRESHOLD), "edges")


@query(_with("reviews", rest=_EDGES) + "SELECT a, b FROM ed")
def cooccurrence_graph(spark, d):
    return graph.cooccurrence_graph(reviews(spark, d), "user_id", "business_id", GRAPH_THRESHOLD)


@query(_with("reviews", rest=_EDGES) + "SELECT a AS node, count(*) AS degree FROM s GROUP BY a")
def node_degree(spark, d):
    return graph.degrees(_edges(spark, d))


_REACH = "WITH RECURSIVE reviews AS (" + VIEWS["reviews"] + "), " + _EDGES + ", r AS (SELECT a AS node, a AS other FROM s UNION SELECT node, s.b FROM r JOIN s ON s.a = r.other), comp AS (SELECT node, min(other) AS component FROM r GROUP BY node)"


@query(_REACH + " SELECT node, component FROM comp")
def connected_components(spark, d):
    return graph.connected_components(_edges(spark, d))


def _label_sql() -> str:
    sql, last = _with("reviews", rest=_EDGES).rstrip() + ", l0 AS (SELECT DISTINCT a AS node, a AS label FROM s)", "l0"
    for i in range(1, 6):
        sql += f", l{i} AS (SELECT node, label FROM (SELECT s.a AS node, label, row_number() OVER (PARTITION BY s.a ORDER BY count(*) DESC, label) AS k FROM s JOIN {last} ON {last}.node = s.b GROUP BY s.a, label) WHERE k = 1)"
        last = f"l{i}"
    return sql + f" SELECT node, label FROM {last}"


@query(_label_sql())
def label_propagation(spark, d):
    return graph.label_propagation(_edges(spark, d))


@query(
    "WITH RECURSIVE reviews AS (" + VIEWS["reviews"] + "), " + _EDGES
    + ", walk AS (SELECT DISTINCT a AS s, a AS t, 0 AS len FROM s UNION SELECT w.s, e.b, len + 1 FROM walk w JOIN s e ON e.a = w.t WHERE len < 60), dist AS (SELECT s, t, min(len) AS len FROM walk GROUP BY 1, 2)"
    + ", paths AS (SELECT s, t, len FROM dist WHERE len = 0 UNION ALL SELECT p.s, e.b, d.len FROM paths p JOIN s e ON e.a = p.t JOIN dist d ON d.s = p.s AND d.t = e.b AND d.len = p.len + 1), sg AS (SELECT s, t, len, count(*) AS c FROM paths GROUP BY 1, 2, 3)"
    + " SELECT a, b, round(sum(x.c * y.c / z.c) / 2, 6) AS betweenness FROM (SELECT least(e.a, e.b) AS a, greatest(e.a, e.b) AS b, e.a AS u, e.b AS v FROM s e) e JOIN sg x ON x.t = u JOIN sg y ON y.s = v JOIN sg z ON z.s = x.s AND z.t = y.t AND z.len = x.len + 1 + y.len GROUP BY 1, 2"
)
def edge_betweenness(spark, d):
    return _rounded(graph.edge_betweenness(_edges(spark, d)), 6)


@query(_REACH + ", k AS (SELECT a AS node, count(*) AS k FROM s GROUP BY a), me AS (SELECT count(*) AS m FROM ed), p AS (SELECT x.node AS i, y.node AS j, kx.k AS ki, ky.k AS kj FROM comp x JOIN comp y ON x.component = y.component JOIN k kx ON kx.node = x.node JOIN k ky ON ky.node = y.node), q AS (SELECT i, j, ki, kj, CASE WHEN EXISTS (SELECT 1 FROM s WHERE s.a = i AND s.b = j) THEN 1 ELSE 0 END AS aij FROM p) SELECT round(sum(CASE WHEN i < j THEN aij - ki * kj / (2.0 * m) ELSE 0 END) / (2.0 * any_value(m)), 6) AS half_sum, round(sum(aij - ki * kj / (2.0 * m)) / (2.0 * any_value(m)), 6) AS modularity FROM q, me")
def modularity(spark, d):
    edges = _edges(spark, d)
    return _rounded(graph.modularity(edges, graph.connected_components(edges).select("node", "component")), 6)


@query()
def girvan_newman(spark, d):
    return graph.girvan_newman(_edges(spark, d))


# Clusters

K = 10
_POINTS = "pt AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS vec, label FROM embeddings)"
_STATS = "st AS (SELECT cluster, dim, count(*) AS n, sum(x) AS total, sum(x * x) AS sumsq FROM (SELECT label AS cluster, unnest(range(0, len(vec))) AS dim, unnest(vec) AS x FROM pt) GROUP BY 1, 2)"


def _points(spark, d) -> DataFrame:
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("vec"), "label")


@query(f"WITH {_POINTS}, c AS (SELECT CAST(row_number() OVER (ORDER BY id) - 1 AS INT) AS cluster, vec FROM pt ORDER BY id LIMIT {K}), ds AS (SELECT id, cluster, round(list_distance(pt.vec, c.vec), 9) AS dist FROM pt, c) SELECT id, cluster, round(dist, 6) AS dist FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY dist, cluster) AS k FROM ds) WHERE k = 1")
def kmeans_step(spark, d):
    points = _points(spark, d)
    first = [(i, r.vec) for i, r in enumerate(points.orderBy("id").limit(K).collect())]
    centres = readers.local_rows(spark, first, "cluster int, vec array<double>")
    return _rounded(cluster.nearest(points.select("id", "vec"), centres), 6)


@query(f"WITH {_POINTS}, {_STATS} SELECT cluster, CAST(dim AS INT) AS dim, n, round(total, 5) AS total, round(sumsq, 5) AS sumsq FROM st")
def cluster_stats(spark, d):
    p = _points(spark, d)
    return _rounded(cluster.cluster_stats(p.select("id", "vec"), p.select("id", F.col("label").alias("cluster"))), 5)


@query(f"WITH {_POINTS}, {_STATS}, e AS (SELECT id, unnest(range(0, len(vec))) AS dim, unnest(vec) AS x FROM pt), v AS (SELECT cluster, dim, total / n AS mean, sqrt(greatest(sumsq / n - (total / n) * (total / n), 0)) AS dev FROM st), ds AS (SELECT id, cluster, round(sqrt(sum(pow((x - mean) / CASE WHEN dev > 0 THEN dev ELSE 1 END, 2))), 6) AS dist FROM e JOIN v USING (dim) GROUP BY 1, 2) SELECT id, cluster, dist FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY dist, cluster) AS k FROM ds) WHERE k = 1")
def mahalanobis_assign(spark, d):
    p = _points(spark, d)
    stats = cluster.packed(cluster.cluster_stats(p.select("id", "vec"), p.select("id", F.col("label").alias("cluster"))))
    all_stats = stats.agg(F.collect_list(F.struct("*")).alias("cs"))
    dist = F.transform("cs", lambda c: F.struct(F.round(cluster.mahalanobis(F.col("vec"), c["n"], c["total"], c["sumsq"]), 6).alias("dist"), c["cluster"].alias("cluster")))
    return p.crossJoin(F.broadcast(all_stats)).select("id", F.array_min(dist).alias("m")).select("id", "m.cluster", "m.dist")


def _bfr(spark, d):
    points = _points(spark, d).select("id", "vec", F.pmod("id", F.lit(BFR_CHUNKS)).alias("chunk"))
    return cluster.bfr(points, "chunk", K)


@query()
def bfr_rounds(spark, d):
    return _bfr(spark, d)[0]


@query()
def bfr_membership(spark, d):
    return _bfr(spark, d)[1]


# Streams


def _event_stream(spark, d) -> DataFrame:
    return windows.file_stream(spark, d, "events.parquet", table(spark, d, "events").schema)


def _stream_name(base: str) -> str:
    import uuid

    return f"{base}_{uuid.uuid4().hex[:8]}"


@query(ORACLE["fm_distinct_windows"])
def stream_sliding_fm(spark, d):
    events = _event_stream(spark, d).select("ts", F.col("user_id").cast("string").alias("v"))
    return windows.run_to_end(windows.fm_stream(events, "ts", "v", LENGTH, SLIDE), _stream_name("fm"))


@query(ORACLE["reservoir_sample"])
def stream_counted_reservoir(spark, d):
    path, checkpoint = new_path(spark, "reservoir"), new_path(spark, "stream")
    stream = windows.counted_reservoir(_event_stream(spark, d).select("event_id", "event_type"), "event_id", path, checkpoint)
    stream.awaitTermination()
    return windows.reservoir_state(spark, path, stream.lastProgress["batchId"]).select("slot", "event_id", "event_type", "n")


@query(_RESERVOIR.replace("row_number() OVER (ORDER BY event_id) AS n FROM events", "event_id + 1 AS n FROM events") + "SELECT CAST(slot AS BIGINT) AS slot, event_id, event_type, n FROM res")
def stream_reservoir(spark, d):
    events = _event_stream(spark, d).select("event_id", "event_type", (F.col("event_id") + 1).alias("n"))
    return windows.run_to_end(windows.reservoir_stream(events, "n"), _stream_name("reservoir")).select("slot", "event_id", "event_type", "n")


@query(_RESERVOIR.split("), s AS")[0].replace("WITH e AS (", "WITH x AS (SELECT 1), e AS (") + ") SELECT event_id, event_type FROM e WHERE regexp_matches(event_type, '(?i)click|error')")
def keyword_filtered_events(spark, d):
    return sampling.keyword_filter(table(spark, d, "events"), "event_type", ["click", "ERROR"]).select("event_id", "event_type")


# Sources and sinks, each a round trip through files in the shared folder


@query(_with("reviews") + "SELECT user_id, business_id, stars, date, count(*) AS n FROM reviews GROUP BY ALL")
def source_json_lines(spark, d):
    path = new_path(spark, "json")
    writers.json_lines(reviews(spark, d), path)
    return readers.json_lines(spark, path, "user_id long, business_id long, stars double, date string").groupBy("user_id", "business_id", "stars", "date").agg(F.count(F.lit(1)).alias("n"))


@query(_with("reviews") + "SELECT user_id, business_id, count(*) AS n FROM reviews GROUP BY ALL")
def source_csv(spark, d):
    path = new_path(spark, "csv")
    writers.csv_with_header(reviews(spark, d).select("user_id", "business_id"), path)
    return readers.csv_with_header(spark, path, "user_id long, business_id long").groupBy("user_id", "business_id").agg(F.count(F.lit(1)).alias("n"))


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)
