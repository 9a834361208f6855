"""Benchmark decontamination by template windows.

Method: texts are canonicalised to templates in which numbers, names and units stand as
typed placeholders, so that a question whose parameters were changed keeps its template.
Windows of template tokens are hashed and hash-joined between documents and benchmark.  A
match must then be consistent: over all windows of an occurrence, each value in the
item's slots must stand for one value in the document's.  A document is contaminated by
an item if the matched windows of any occurrence cover enough of it (see ``_occurrences``).

A capitalised word may be a name or not, whatever stands before it.  A window of the benchmark
is indexed once for each choice of its capitalised words that are names; a window of a document
is looked up as context suggests, with all capitalised words as names, and with none.  What is
not seen: changed names in a window where the document also capitalises a word inside a sentence
that the item does not.

Every window of the benchmark is indexed.  On the documents' side only windows around an
*anchor* are hashed: for each benchmark window, its rarest literal token is an anchor (rare
in a sample of the documents, then in the benchmark, then long).  A document window equal to
a benchmark window holds that token, whichever it is, so nothing is missed, while most
positions of the corpus cost one set lookup.  A window without literals is matched by its
values, the rarest of which is its anchor.

Only DataFrame functions.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from oreflow.llm.scratch import kept

NUMBER, NAME, UNIT, CAPITAL = "\u0001", "\u0002", "\u0003", "\u0004"
"""Marks before a number, a name, a unit, and a capitalised word that may be a name; smaller than the first character of any other token."""
UNITS = "mm|cm|m|km|in|inch|inches|ft|feet|foot|yards?|miles?|mg|g|kg|lbs?|pounds?|ounces?|oz|tons?|ml|l|liters?|litres?|gallons?|s|sec|seconds?|min|minutes?|h|hours?|days?|weeks?|months?|years?|dollars?|cents?|euros?|usd|eur|percent|degrees?|meters?|metres?|grams?|kilograms?|kilometers?|kilometres?"
MAX_ANCHORS = 200_000
"""Bound of the anchor set that is sent to all tasks; a larger benchmark is matched in parts of this size."""
LEAST_TOKENS = 5
"""Shorter items are not matched, as any text may hold them; :func:`short_items` names them."""
SAMPLE = 2_000
"""Documents, about, that tell which tokens are rare; they decide on speed alone."""
_IDEOGRAPH = r"[\u3040-\u30FA\u3400-\u4DBF\u4E00-\u9FFF\uF900-\uFAFF\x{20000}-\x{2FA1F}]"
"""Han, Hiragana and Katakana by their code blocks: ranges are tested faster than scripts."""


def template_tokens(text: Column) -> Column:
    """Template tokens of a text: lower-cased literals, and raw values behind their mark.

    A capitalised word is a name by its context after a lower-case letter, comma or semicolon and one white
    space; elsewhere, as at the start of a sentence, it may be one.  A unit is a unit word right after a number.
    Han, Hiragana and Katakana, which stand without spaces, are a token a character.
    """
    s = F.regexp_replace(F.coalesce(text, F.lit("")), rf"[\x01-\x04]|({_IDEOGRAPH})", " $1 ")
    s = F.regexp_replace(s, r"\p{Lu}(?=\p{Ll})(?<![\p{L}\p{M}]\p{Lu})", f"{CAPITAL}$0")
    s = F.lower(F.regexp_replace(s, r"\x04(?<=[\p{Ll},;]\s\x04)", NAME))
    s = F.regexp_replace(s, r"[.,:](?=\d)(?<=\d[.,:])", "")
    s = F.regexp_replace(s, r"[^\p{L}\p{M}\d\x02\x04]+", " ")
    s = F.regexp_replace(s, r"\d+", f" {NUMBER}$0 ")
    s = F.regexp_replace(s, rf"(\x01\d+ +)\x04?(?=(?:{UNITS})(?: |$))", f"$1{UNIT}")
    return F.filter(F.split(s, " +"), lambda x: x != "")


def short_items(benchmark: DataFrame) -> DataFrame:
    """(item_id, n_tokens) of the items that are too short to be matched; null and empty ones have 0 tokens."""
    return benchmark.select("item_id", F.size(template_tokens(F.col("text"))).alias("n_tokens")).filter(F.col("n_tokens") < LEAST_TOKENS)


def _is_capital(x: Column) -> Column:
    return x.startswith(NAME) | x.startswith(CAPITAL)


def _bare(x: Column) -> Column:
    """The token without the mark of a name."""
    return F.when(_is_capital(x), F.substring(x, 2, 1_000_000)).otherwise(x)


def _in_context(window: Column) -> Column:
    """Names as their context suggests."""
    return F.transform(window, lambda x: F.when(x.startswith(CAPITAL), _bare(x)).otherwise(x))


def _all_names(window: Column) -> Column:
    return F.transform(window, lambda x: F.when(x.startswith(CAPITAL), F.concat(F.lit(NAME), _bare(x))).otherwise(x))


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with the value computed once."""
    return F.transform(F.array(value), body)[0]


def _is_slot(x: Column) -> Column:
    return x < "\u0004"


def _places(anchors: list[str]) -> Callable[[Column, Column], Column]:
    return lambda x, i: F.when(x.isin(anchors), i)


def _starts_around(last: Column, size: int) -> Callable[[Column], Column]:
    """Starts, up to ``last``, of the windows that hold position p."""

    def starts(p: Column) -> Column:
        low, high = F.greatest(p - size + 1, F.lit(0)), F.least(p, last)
        return F.when(high >= low, F.sequence(low, F.greatest(high, low))).otherwise(F.array().cast("array<int>"))

    return starts


def _shape(window: Column) -> Column:
    """The window with each slot's value left out; one of slots alone keeps them, as any row of numbers would equal it."""
    blank = F.transform(window, lambda x: F.when(_is_slot(x), F.substring(x, 1, 1)).otherwise(x))
    return F.when(F.exists(window, lambda x: ~_is_slot(x)), blank).otherwise(window)


def _windows_at(tokens: Column, size: int) -> Callable[[Column], Column]:
    """Start, hash, slot values of the window at a start, and whether its names are those by context; once for each form."""

    def window(at: Column) -> Column:
        form = lambda typed, in_context: _let(typed, lambda x: F.struct(at.alias("at"), F.xxhash64(F.lit(size), _shape(x)).alias("hash"), F.filter(x, _is_slot).alias("slots"), F.lit(in_context).alias("in_context")))
        bare = lambda raw: form(F.transform(raw, _bare), False)
        open_names = lambda raw: F.exists(raw, lambda x: x.startswith(CAPITAL))
        names = lambda raw: F.exists(raw, lambda x: x.startswith(NAME))
        forms = lambda raw: F.when(open_names(raw), F.array(form(_in_context(raw), True), form(_all_names(raw), False), bare(raw))).when(names(raw), F.array(form(raw, True), bare(raw))).otherwise(F.array(form(raw, True)))
        return _let(F.slice(tokens, at + 1, F.lit(size)), forms)

    return window


def _in_sample(docs: DataFrame, literals: DataFrame) -> DataFrame:
    """(token, seen): how often literals stand in a sample of the documents."""
    rows = docs.count()
    some = docs.select("text").sample(fraction=min(1.0, SAMPLE / max(rows, 1)), seed=0)
    tokens = some.select(F.explode(template_tokens(F.col("text"))).alias("x")).select(_bare(F.col("x")).alias("token"))
    return tokens.groupBy("token").agg(F.count(F.lit(1)).alias("seen")).join(literals.select("token"), "token", "left_semi")


def _benchmark_windows(items: DataFrame, docs: DataFrame, window: int) -> DataFrame:
    """(item_id, n_tokens, size, at, hash, slots, in_context, anchor) of every window, for each choice of names."""
    tok = items.select("item_id", template_tokens(F.col("text")).alias("t")).filter(F.size("t") >= LEAST_TOKENS)
    tok = tok.withColumn("n_tokens", F.size("t")).withColumn("size", F.least("n_tokens", F.lit(window)))
    spans = tok.withColumn("at", F.explode(F.sequence(F.lit(0), F.col("n_tokens") - F.col("size"))))
    spans = spans.withColumn("raw", F.slice("t", F.col("at") + 1, F.col("size"))).drop("t")
    spans = spans.withColumn("capitals", F.array_compact(F.transform("raw", lambda x, i: F.when(_is_capital(x), i))))
    spans = spans.withColumn("choice", F.explode(F.sequence(F.lit(0).cast("long"), F.pow(F.lit(2.0), F.size("capitals")).cast("long") - 1)))
    chosen = lambda i: F.getbit("choice", F.greatest(F.array_position("capitals", i) - 1, F.lit(0)).cast("int")) == 1
    spans = spans.withColumn("typed", F.transform("raw", lambda x, i: F.when(_is_capital(x) & chosen(i), F.concat(F.lit(NAME), _bare(x))).otherwise(_bare(x))))
    spans = spans.withColumns({"in_context": F.col("typed") == _in_context(F.col("raw")), "hash": F.xxhash64("size", _shape(F.col("typed"))), "slots": F.filter("typed", _is_slot), "literal": F.filter("typed", lambda x: ~_is_slot(x))})
    spans = spans.withColumn("literal", F.when(F.size("literal") > 0, F.col("literal")).otherwise(F.transform("slots", _bare)))
    often = spans.select("item_id", F.explode("literal").alias("token")).distinct().groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    spans, often = kept(spans, "benchmark-windows"), kept(often, "literals")
    often = often.join(_in_sample(docs, often), "token", "left").select("token", F.coalesce("seen", F.lit(0)).alias("seen"), "n")
    ranked = spans.select("size", "hash", F.explode("literal").alias("token")).distinct().join(often, "token").groupBy("size", "hash").agg(F.min(F.struct("seen", "n", (-F.length("token")).alias("l"), "token")).alias("best"))
    return spans.join(ranked, ["size", "hash"]).select("item_id", "n_tokens", "size", "at", "hash", "slots", "in_context", F.col("best.token").alias("anchor"))


def _covered(starts: Column, size: Column) -> Column:
    """Tokens under windows of one size at distinct starts."""
    fold = F.aggregate(F.sort_array(starts), F.struct(F.lit(0).alias("n"), F.lit(-1_000_000).alias("at")), lambda s, x: F.struct((s["n"] + F.least(x - s["at"], size)).alias("n"), x.alias("at")))
    return fold["n"]


def _occurrences(found: DataFrame) -> DataFrame:
    """The matches, once for each occurrence (kind, place, copy) of the item that they belong to.

    An item may stand in a document many times, with other values each time, so matches are judged in three
    ways: those of one diagonal (document's start less item's), which is a copy without insertions; those of
    one run, which goes on while the item's starts rise and no gap is longer than the item; and those of the
    whole document, as an item may be scattered over it.  Different texts under one id are copies of their own.
    """
    text = Window.partitionBy("doc_id", "copy", "item_id").orderBy("doc_at")
    spots = found.groupBy("doc_id", "copy", "item_id", "n_tokens", "doc_at").agg(F.min("at").alias("low"), F.max("at").alias("high"))
    # a window that stands several times in the item has several starts: back means back by the least and by the greatest
    back = (F.col("low") <= F.lag("low").over(text)) & (F.col("high") <= F.lag("high").over(text))
    gap = F.col("doc_at") - F.lag("doc_at").over(text) > F.col("n_tokens")
    runs = spots.withColumn("cut", F.coalesce((back | gap).cast("int"), F.lit(0))).withColumn("run", F.sum("cut").over(text)).select(F.col("doc_id").alias("d"), F.col("copy").alias("c"), F.col("item_id").alias("i"), F.col("doc_at").alias("a"), "run")
    same = F.col("doc_id").eqNullSafe(F.col("d")) & F.col("item_id").eqNullSafe(F.col("i")) & (F.col("copy") == F.col("c")) & (F.col("doc_at") == F.col("a"))
    place = lambda kind, at, copy: F.struct(F.lit(kind).alias("kind"), at.cast("long").alias("place"), copy.alias("copy"))
    places = F.array(place("document", F.lit(0), F.lit(0).cast("long")), place("diagonal", F.col("doc_at") - F.col("at"), F.col("copy")), place("run", F.col("run"), F.col("copy")))
    return found.join(runs, same).withColumn("in", F.explode(places)).drop("copy").select("*", "in.*").drop("in")


def contaminated(docs: DataFrame, benchmark: DataFrame, window: int = 8, least_covered: int = 13, least_percent: int = 60) -> DataFrame:
    """Pairs of a document and a benchmark item that it holds, verbatim or re-parameterised.

    ``docs``: (doc_id long, text string, ...), ``benchmark``: (item_id long, text string, ...).
    Returns doc_id, item_id, n_windows (distinct windows of the item that match), covered (the
    item's tokens under these), n_tokens (the item's) and verbatim (whether the windows with equal
    slots suffice alone).  A pair is returned if its windows cover ``least_covered`` tokens, or
    ``least_percent`` of the item, and either their slots are equal or the slots are consistent;
    the windows are those of any one occurrence, or of the whole document.

    Null or empty texts hold nothing; items under LEAST_TOKENS tokens are not matched (see :func:`short_items`); null ids are
    ids like any other; repeated documents under one id are one document, as are repeated items.
    An empty table on either side gives an empty result.  Documents are read whole.
    """
    spans = kept(_benchmark_windows(benchmark, docs, window), "anchored-windows")
    anchors = [r.anchor for r in spans.select("anchor").distinct().collect()]
    sizes = [r.size for r in spans.select("size").distinct().collect()]
    tok = docs.select("doc_id", F.xxhash64("text").alias("copy"), template_tokens(F.col("text")).alias("t"))
    found = None
    most = MAX_ANCHORS // 3
    for k in range(0, max(len(anchors), 1), most):
        part = anchors[k : k + most]
        hits = F.filter(F.transform("t", _places([mark + x for x in part for mark in ("", NAME, CAPITAL)])), lambda i: i.isNotNull())
        held = tok.withColumn("p", hits)
        index = spans.filter(F.col("anchor").isin(part)) if len(anchors) > most else spans
        for size in sizes:
            starts = F.array_distinct(F.flatten(F.transform("p", _starts_around(F.size("t") - size, size))))
            wins = held.select("doc_id", "copy", F.explode(F.flatten(F.transform(starts, _windows_at(F.col("t"), size)))).alias("w")).select("doc_id", "copy", F.col("w.at").alias("doc_at"), F.col("w.hash").alias("hash"), F.col("w.slots").alias("doc_slots"), F.col("w.in_context").alias("doc_in_context"))
            got = wins.join(index.filter(F.col("size") == size), "hash").withColumn("in_context", F.col("in_context") & F.col("doc_in_context"))
            found = got if found is None else found.unionByName(got)
    if found is None:
        return docs.sparkSession.createDataFrame([], "doc_id long, item_id long, n_windows long, covered int, n_tokens int, verbatim boolean")
    found = kept(found.drop("hash", "anchor", "doc_in_context"), "matches")
    # each occurrence counts for itself, by its names in context and by any names; slots pair up in order
    pairs = F.arrays_zip(F.col("slots").alias("item"), F.col("doc_slots").alias("doc"))
    by_form = _occurrences(found).withColumn("form", F.explode(F.when(F.col("in_context"), F.array(F.lit("context"), F.lit("any"))).otherwise(F.array(F.lit("any")))))
    by_place = by_form.groupBy("doc_id", "item_id", "n_tokens", "size", "kind", "place", "copy", "form").agg(
        F.collect_set("at").alias("starts"),
        F.collect_set(F.when(F.col("slots") == F.col("doc_slots"), F.col("at"))).alias("equal_starts"),
        F.array_distinct(F.flatten(F.collect_set(pairs))).alias("slots"),
    )
    consistent = F.size("slots") == F.size(F.array_distinct(F.col("slots.item")))
    enough = lambda c: (F.col(c) >= least_covered) | (100 * F.col(c) >= least_percent * F.col("n_tokens"))
    judged = by_place.withColumn("covered", _covered(F.col("starts"), F.col("size"))).withColumn("equal", _covered(F.col("equal_starts"), F.col("size"))).withColumn("verbatim", enough("equal"))
    judged = judged.withColumn("holds", F.col("verbatim") | (enough("covered") & consistent))
    # the greatest numbers are those of the whole document
    by_pair = judged.groupBy("doc_id", "item_id", "n_tokens").agg(F.max(F.size("starts")).cast("long").alias("n_windows"), F.max("covered").alias("covered"), F.max("verbatim").alias("verbatim"), F.max("holds").alias("holds"))
    return by_pair.filter("holds").select("doc_id", "item_id", "n_windows", "covered", "n_tokens", "verbatim")


def clean(docs: DataFrame, benchmark: DataFrame, **limits: int) -> DataFrame:
    """The documents, all columns, that no benchmark item contaminates; rows with a null doc_id stay."""
    return docs.join(contaminated(docs, benchmark, **limits).select("doc_id").distinct(), "doc_id", "left_anti")
