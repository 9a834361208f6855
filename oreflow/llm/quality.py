"""Quality rules: statistics of each text, and lines that too many documents of a host share.

Method: cross-document line frequency.  Lines are normalised (A-Z lower-cased, every digit
as ``0``, blanks at the ends cut) and hashed; the documents of a host that hold a line are
counted, and lines above the limits are removed.  A document is rejected if too little is
left of it.  Exact copies of a text count as one document, so a page that was crawled a
thousand times is not taken for boilerplate.

Only DataFrame functions.  A line that a third of all documents hold is one row per task
after the partial count, and a plain inner join key on the way back, which adaptive
execution splits.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
_BLANKS = " \t\n\x0b\x0c\r"
_FROM, _TO = "ABCDEFGHIJKLMNOPQRSTUVWXYZ123456789", "abcdefghijklmnopqrstuvwxyz000000000"
_PLACE_BITS = 28
"""Low bits of a sort key that hold a window's position; the others hold a part of its hash."""


@dataclass(frozen=True)
class Limits:
    """least_words, most_repeated_percent: the base rules.  A line is removed if more than
    line_documents documents of its host hold it and these are more than line_percent of the
    host's documents.  kept_percent of a document's words must stay."""

    least_words: int = 50
    most_repeated_percent: int = 50
    line_documents: int = 10
    line_percent: int = 2
    kept_percent: int = 50


def words_of(text: Column) -> Column:
    """The words of a text; none for null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda x: x != "")


def _line_hashes(text: Column) -> Column:
    plain = F.split(F.translate(F.coalesce(text, F.lit("")), _FROM, _TO), "\n")
    return F.transform(plain, lambda x: F.xxhash64(F.btrim(x, F.lit(_BLANKS))))


def _line_words(text: Column) -> Column:
    """Number of words of each line."""
    return F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: F.size(words_of(x)))


def _here(value: Column) -> Column:
    """The value, behind a guard that is always true but not deterministic.

    Without it a later filter on the value would be pushed below the columns it is made from, and
    these would be written out inside its lambda functions, to be computed again for every element.
    """
    return F.when(F.spark_partition_id() >= 0, value)


def statistics(docs: DataFrame) -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (all long) for the column text.

    For the repeated words, (36 bits of a three-word window's hash, its position) are sorted as
    plain longs, so equal windows become neighbours; neighbours are compared word by word; and
    each repeated window covers the words up to the next one's start, three at most.  If two
    different windows of a text share the 36 bits, that text's windows are sorted by all 64 bits.
    The steps are columns of their own so that each is computed once and the sort runs on a
    primitive array.  A null text counts as an empty one; rows are judged each for itself; a text
    has fewer than 2**28 words.
    """
    place = F.lit((1 << _PLACE_BITS) - 1)
    text = F.coalesce("text", F.lit(""))
    no = F.lit(None).cast("array<bigint>")
    w = F.col("_w")
    lines = F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(_BLANKS)) != "")
    code = lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2))
    key = lambda i: F.shiftleft(code(i), _PLACE_BITS).bitwiseOR(i.cast("long"))
    windows = F.sequence(F.lit(0), F.size("_w") - 3)
    next_to = lambda x: F.slice(x, 2, F.greatest(F.size(x), F.lit(1)))
    same = lambda a, b: F.shiftrightunsigned(a.bitwiseXOR(b), _PLACE_BITS) == 0
    at = lambda x: x.bitwiseAND(place).cast("int")
    equal = lambda p: (F.get(w, p["a"]) == F.get(w, p["b"])) & (F.get(w, p["a"] + 1) == F.get(w, p["b"] + 1)) & (F.get(w, p["a"] + 2) == F.get(w, p["b"] + 2))
    return (
        docs.withColumn("_w", words_of(F.col("text")))
        .withColumn("_l", lines)
        .withColumn("_k", F.sort_array(F.when(F.size("_w") >= 4, F.transform(windows, key)).otherwise(no)))
        .withColumn("_p", F.filter(F.zip_with("_k", next_to("_k"), lambda a, b: F.when(same(a, b), F.struct(at(a).alias("a"), at(b).alias("b")))), lambda p: p.isNotNull()))
        .withColumn("_x", F.when(F.exists("_p", lambda p: ~equal(p)), F.sort_array(F.transform(windows, lambda i: F.struct(code(i).alias("h"), i.alias("i"))))))
        .withColumn("_p", F.when(F.col("_x").isNull(), F.col("_p")).otherwise(F.filter(F.zip_with("_x", next_to("_x"), lambda a, b: F.when(a["h"] == b["h"], F.struct(a["i"].alias("a"), b["i"].alias("b")))), lambda p: p.isNotNull() & equal(p))))
        .withColumn("_p", F.sort_array(F.array_distinct(F.concat(F.transform("_p", lambda p: p["a"]), F.transform("_p", lambda p: p["b"])))))
        .withColumns({
            "n_words": F.size("_w").cast("long"),
            "word_chars": F.length(F.array_join("_w", "")).cast("long"),
            "n_symbols": F.length(F.regexp_replace(text, "[^" + "".join("\\" + c for c in SYMBOLS) + "]+", "")).cast("long"),
            "n_dup_lines": (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long"),
            "n_repeat_words": _here(F.coalesce(F.aggregate("_p", F.struct(F.lit(0).alias("n"), F.lit(-3).alias("at")), lambda s, x: F.struct((s["n"] + F.least(x - s["at"], F.lit(3))).alias("n"), x.alias("at")))["n"], F.lit(0)).cast("long")),
        })
        .drop("_w", "_l", "_k", "_p", "_x")
    )


def frequent_lines(docs: DataFrame, limits: Limits) -> DataFrame:
    """(host, line): hashes of lines with words that exceed the limits; ``docs``: (host, text, ...).

    A null host is a host; a null text has no lines; equal texts of a host count once; no rows, no lines.
    """
    fp = docs.select("host", "text", F.xxhash64("text").alias("fp"), F.octet_length("text").alias("size"))
    held = fp.select("host", "fp", "size", F.explode(F.array_distinct(_line_hashes(F.col("text")))).alias("line"))
    often = held.groupBy("host", "line").agg(F.count_distinct("fp", "size").alias("n")).filter(F.col("n") > limits.line_documents)
    of_host = fp.groupBy("host").agg(F.count_distinct("fp", "size").alias("host_documents"))
    empty = F.xxhash64(F.lit(""))
    many = often.alias("o").join(of_host.alias("h"), F.col("o.host").eqNullSafe(F.col("h.host"))).filter(100 * F.col("n") > limits.line_percent * F.col("host_documents"))
    return many.filter(F.col("line") != empty).select("o.host", "line")


def quality(docs: DataFrame, limits: Limits = Limits(), host: str = "source", carry: tuple[str, ...] = ()) -> DataFrame:
    """Judge every document.

    ``docs``: (doc_id long, text string, <host> string, ...); further columns are ignored.  Returns
    one row per input row: doc_id, text (without the removed lines; null stays null), n_words,
    word_chars, n_symbols, n_dup_lines, n_repeat_words, n_line_words (words in removed lines),
    base_failed, kept, and the columns named in ``carry``.

    A null text is an empty one and fails for its few words.  A null host is a host of its own.
    Repeated rows are judged each, alike, and count once for a line.  Empty tables give empty
    results; long texts are read whole.
    """
    rows = docs.select("doc_id", "text", F.col(host).alias("host"), F.struct(F.lit(0).alias("_"), *(F.col(c) for c in carry)).alias("_carry"))
    often = frequent_lines(rows, limits)
    zipped = F.arrays_zip(_line_hashes(F.col("text")).alias("line"), _line_words(F.col("text")).alias("words"))
    lines = rows.select("doc_id", "host", F.xxhash64("text").alias("fp"), F.posexplode(zipped)).select("doc_id", "host", "fp", "pos", "col.*").filter("words > 0")
    found = lines.alias("l").join(often.alias("o"), F.col("l.host").eqNullSafe(F.col("o.host")) & (F.col("l.line") == F.col("o.line")))
    # a set, as repeated rows give each line once more
    lost = (
        found.groupBy("doc_id", "l.host", "fp").agg(F.collect_set(F.struct("pos", "l.line", "words")).alias("x"))
        .select("doc_id", "host", "fp", F.array_distinct(F.col("x.line")).alias("lost"), F.aggregate("x.words", F.lit(0), lambda a, b: a + b).alias("lost_words"))
    )
    judged = statistics(rows.withColumn("fp", F.xxhash64("text")))
    twins = ["doc_id", "host", "fp"]
    same = F.lit(True)
    for c in twins:
        same = same & F.col(f"d.{c}").eqNullSafe(F.col(f"r.{c}"))
    joined = judged.alias("d").join(lost.alias("r"), same, "left").select("d.*", "lost", "lost_words")
    gone = F.coalesce("lost_words", F.lit(0)).cast("long")
    base = (F.col("n_words") < limits.least_words) | (100 * F.col("n_repeat_words") > limits.most_repeated_percent * F.col("n_words"))
    left = F.col("n_words") - F.col("n_line_words")
    depleted = 100 * left < limits.kept_percent * F.col("n_words")
    kept_lines = F.filter(F.split("text", "\n"), lambda x: ~F.array_contains("lost", F.xxhash64(F.btrim(F.translate(x, _FROM, _TO), F.lit(_BLANKS)))))
    return (
        joined.withColumn("n_line_words", gone).withColumn("base_failed", base).withColumn("kept", ~(base | depleted))
        .select("doc_id", F.when(F.col("lost").isNull(), F.col("text")).otherwise(F.array_join(kept_lines, "\n")).alias("text"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_line_words", "base_failed", "kept", *(F.col("_carry")[c].alias(c) for c in carry))
    )
