"""N-gram Jaccard join: exact near-duplicate components of whole texts.

Method: every document is a set of word n-grams.  N-grams are ordered rare first by
their document frequency over the whole corpus; only a prefix of each set is joined
(length, positional and suffix filters on the join), and each surviving pair is
verified once by intersecting the two sets.

* An n-gram of one document only can't be shared, so a document in which too few
  n-grams have a second holder leaves before the join, whatever its length.
* Documents with equal sets are one class; only its smallest id is joined.
* Groups of near copies are not expanded into all pairs: first each class is compared
  with the leader (smallest id) of each of its prefix n-grams, and then only pairs
  whose components still differ are compared, those that the leaders' round refuted
  left out.  No link between components is lost: every pair that passes the filters is
  either inside a component or verified, and none is verified twice.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from oreflow.llm import blocks as B
from oreflow.llm.components import components
from oreflow.llm.scratch import dropped, kept
from oreflow.llm.words import pieces, texts_of, words

PARITIES = 8
"""64-bit words of the suffix filter's parity vector, which tells for 512 classes of tokens whether an odd
number of those after a position are in it."""


def shingles(texts: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct k-word shingles of each text, sorted within it; and each text's first one.

    Words are lower-cased (A-Z).  A text of 1 to k-1 words has its whole sequence as its
    only shingle; a text without words has none.
    """
    w = words(texts, lower=True)
    h = w.hashes()
    gram, whole = w.grams(h, k)
    parts, owners = [gram[whole]], [w.doc_of_word()[whole]]
    for size in range(1, k):
        short = np.flatnonzero(w.counts == size)
        if len(short):
            parts.append(w.grams(h, size)[0][w.first[short]] + np.uint64(size))
            owners.append(short)
    gram, owner = np.concatenate(parts), np.concatenate(owners)
    if len(parts) > 1:
        order = np.argsort(owner, kind="stable")
        gram, owner = gram[order], owner[order]
    first = np.searchsorted(owner, np.arange(len(texts) + 1))
    for a, b in zip(first[:-1], first[1:]):
        gram[a:b].sort()
    if len(gram):
        fresh = np.concatenate([[True], (gram[1:] != gram[:-1]) | (owner[1:] != owner[:-1])])
        gram, owner = gram[fresh], owner[fresh]
    return gram, np.searchsorted(owner, np.arange(len(texts) + 1))


def _sender(k: int, exchange: B.Exchange):
    def send(block: int, docs: pa.Table) -> pa.Table:
        grams = np.concatenate([np.zeros(0, np.uint64), *(shingles(texts_of(p.column("text")), k)[0] for p in pieces(docs))])
        return exchange.sent(block, grams, np.ones(len(grams), np.uint32))

    return send


_SETS = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("n_own", pa.int64()), ("fp_a", pa.int64()), ("fp_b", pa.int64()), ("tokens", pa.list_(pa.int64()))])
_SETS_SQL = "doc_id long, n long, n_own long, fp_a long, fp_b long, tokens array<long>"


def _ranker(k: int, percent: int):
    def rank(block: int, docs: pa.Table, replies: pa.Table) -> pa.Table:
        known = B.Frequencies(replies)
        out = []
        for p in pieces(docs):
            gram, first = shingles(texts_of(p.column("text")), k)
            df = known.of(gram)
            size = np.diff(first)
            shared = np.add.reduceat(np.append((df >= 2).astype(np.int64), 0), np.minimum(first[:-1], len(df))) * (size > 0)
            picked = np.flatnonzero((size > 0) & (100 * shared >= percent * size))
            column = {"fp_a": [None] * len(size), "fp_b": [None] * len(size), "tokens": [None] * len(size)}
            for d in picked:
                one, f = gram[first[d] : first[d + 1]], df[first[d] : first[d + 1]]
                column["fp_a"][d], column["fp_b"][d] = np.frombuffer(hashlib.blake2b(one.tobytes(), digest_size=16).digest(), np.int64).tolist()
                keep = f >= 2
                column["tokens"][d] = one[keep][np.lexsort((one[keep], f[keep]))].view(np.int64)
            column |= {"doc_id": p.column("doc_id").combine_chunks().cast(pa.int64()), "n": size, "n_own": size - shared}
            out.append(pa.table({f.name: column[f.name] if isinstance(column[f.name], pa.ChunkedArray) else pa.array(column[f.name], f.type) for f in _SETS}, schema=_SETS))
        return pa.concat_tables(out) if out else _SETS.empty_table()

    return rank


def shingle_sets(docs: DataFrame, k: int = 5, percent: int = 75) -> DataFrame:
    """Per document: n (set size); and, where enough shingles have a second holder to reach
    the threshold at all, tokens (those shingles, rare first), n_own (the others' number, which
    come before them in the order) and a fingerprint of the whole set.  A table in the shared folder."""
    blocks = B.in_blocks(docs)
    exchange = B.Exchange.over(blocks, B.FREQUENCY)
    replies = exchange.replies(blocks.each(_sender(k, exchange), B.ROWS))
    sets = kept(blocks.with_replies(replies, _ranker(k, percent), _SETS_SQL), "shingle-sets")
    dropped(blocks.table)
    return sets


_POSTS = pa.schema([("token", pa.int64()), ("rep", pa.int64()), ("n", pa.int64()), ("pos", pa.int64()), ("before", pa.int64()), ("suffix", pa.list_(pa.int64()))])
_POSTS_SQL = "token long, rep long, n long, pos long, before long, suffix array<long>"


def _parity(bit: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """For each of n owners, which of the vector's bits it has an odd number of times."""
    width = 64 * PARITIES
    odd = (np.bincount(owner * width + bit, minlength=n * width) & 1).astype(np.uint8)
    return np.packbits(odd.reshape(n, width), axis=1, bitorder="little").view(np.uint64)


def _cut(sizes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of entries whose sizes come to ``most`` at most, one entry at least."""
    total, at = np.cumsum(sizes), 0
    while at < len(sizes):
        to = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + most, side="right")))
        yield at, to
        at = to


def prefix_posts(percent: int, most: int = 1 << 17) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Entries of each set's prefix: token, rep, n, pos (in the whole order), before (shared tokens before it),
    and the parity vector of the tokens after it.  ``most``: entries, or tokens, that are worked on at once."""

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, own = batch.column("n").to_numpy(), batch.column("n_own").to_numpy()
            rep, lists = batch.column("rep").to_numpy(), batch.column("tokens")
            off, tokens = lists.offsets.to_numpy().astype(np.int64), lists.values.to_numpy().view(np.uint64)
            bit = (tokens >> np.uint64(7)).astype(np.int64) % (64 * PARITIES)
            reach = np.clip(n + percent * n // -100 + 1 - own, 0, np.diff(off))
            for low, high in _cut(np.diff(off) + 64, most):
                whole = _parity(bit[off[low] : off[high]], np.repeat(np.arange(high - low), np.diff(off[low : high + 1])), high - low)
                doc = np.repeat(np.arange(low, high), reach[low:high])
                before = np.arange(len(doc)) - np.repeat(np.cumsum(reach[low:high]) - reach[low:high], reach[low:high])
                head = np.zeros(PARITIES, np.uint64)
                for a in range(0, len(doc), most):
                    d, j = doc[a : a + most], before[a : a + most]
                    at = off[d] + j
                    seen = np.zeros((len(d), PARITIES), np.uint64)
                    seen[np.arange(len(d)), bit[at] >> 6] = np.uint64(1) << (bit[at] & 63).astype(np.uint64)
                    seen = np.bitwise_xor.accumulate(seen, axis=0)
                    # what was seen before the document's first entry is not its own
                    start = np.flatnonzero(j == 0)
                    base = np.vstack([head[None, :], np.where(start[:, None] > 0, seen[np.maximum(start, 1) - 1], np.zeros(PARITIES, np.uint64))])
                    mine = base[np.cumsum(j == 0)]
                    suffix = whole[d - low] ^ seen ^ mine
                    head = mine[-1] ^ seen[-1]
                    flat = pa.ListArray.from_arrays(pa.array(np.arange(len(d) + 1) * PARITIES, pa.int32()), pa.array(suffix.ravel().view(np.int64)))
                    yield pa.RecordBatch.from_arrays([pa.array(tokens[at].view(np.int64)), pa.array(rep[d]), pa.array(n[d]), pa.array(own[d] + j), pa.array(j), flat], schema=_POSTS)

    return post


def _least_overlap(percent: int, a: Column, b: Column) -> Column:
    """Smallest overlap of sets of a and b elements whose Jaccard similarity reaches the threshold."""
    return F.ceil((percent * (a + b)).cast("decimal(20,0)") / F.lit(100 + percent)).cast("long")


def _may_link(x: str, y: str, percent: int) -> Column:
    """Length, prefix, positional and suffix filters for entries x and y of one posting list; x is the smaller set.

    Up to the token that is matched the sets share at most ``most`` tokens, so of what follows they must
    share the rest; the parities of what follows differ in no more bits than these tokens differ.
    """
    c = lambda side, name: F.col(f"{side}.{name}")
    nx, ny, least = c(x, "n"), c(y, "n"), _least_overlap(percent, c(x, "n"), c(y, "n"))
    most = F.least(c(x, "before"), c(y, "before")) + 1
    after_x, after_y = nx - c(x, "pos") - 1, ny - c(y, "pos") - 1
    length = 100 * nx >= percent * ny
    prefix = c(x, "pos") <= nx - _least_overlap(percent, nx, nx)
    position = most + F.least(after_x, after_y) >= least
    apart = sum((F.bit_count(c(x, "suffix")[i].bitwiseXOR(c(y, "suffix")[i])) for i in range(1, PARITIES)), F.bit_count(c(x, "suffix")[0].bitwiseXOR(c(y, "suffix")[0])))
    return length & prefix & position & (apart <= after_x + after_y - 2 * (least - most))


def _in_order(percent: int) -> Column:
    """The filters for entries a and b in either order of size."""
    smaller = F.struct("a.n", "a.rep") <= F.struct("b.n", "b.rep")
    return (smaller & _may_link("a", "b", percent)) | (~smaller & _may_link("b", "a", percent))


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets reach the threshold."""
    side = lambda s: sets.select(F.col("rep").alias(s), F.col("n").alias(f"n_{s}"), F.col("tokens").alias(f"t_{s}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    shared = F.size(F.array_intersect("t_a", "t_b")).cast("long")
    return both.filter(100 * shared >= percent * (F.col("n_a") + F.col("n_b") - shared)).select("a", "b")


def ngram_components(docs: DataFrame, k: int = 5, percent: int = 75) -> DataFrame:
    """Near-duplicate components under the n-gram Jaccard join.

    ``docs``: (doc_id long, text string, ...); other columns are ignored.  Two documents
    link when ``100 * intersection >= percent * union`` of their sets of k-word shingles.
    Returns one row per input row: doc_id, n_shingles, component_id (smallest doc_id
    reachable by links, itself included).

    Null or wordless texts have an empty set and link with nothing.  Rows with a null
    doc_id get a null component and link nothing.  Rows that repeat one doc_id are one
    node: what links to any of them links to all.  An empty input gives an empty result.
    Very long texts are processed whole.
    """
    every = shingle_sets(docs, k, percent)
    cand = every.filter(F.col("tokens").isNotNull() & F.col("doc_id").isNotNull())
    # both written as they are: then the join's sides are plain exchanges and nothing above it needs a
    # class's rows together, so adaptive execution can split a class that holds a third of all rows
    classes = kept(cand.groupBy("fp_a", "fp_b", "n").agg(F.min("doc_id").alias("rep")), "classes")
    member = kept(cand.select("doc_id", "fp_a", "fp_b", "n").join(classes, ["fp_a", "fp_b", "n"]).select("doc_id", "rep"), "members")
    # a representative whose set differs from others of its id keeps every such set
    sets = kept(cand.join(classes.withColumnRenamed("rep", "doc_id"), ["fp_a", "fp_b", "n", "doc_id"], "left_semi").select(F.col("doc_id").alias("rep"), "n", "n_own", "tokens").dropDuplicates(["rep", "tokens"]), "sets")
    posts = kept(sets.select("rep", "n", "n_own", "tokens").mapInArrow(prefix_posts(percent), _POSTS_SQL), "posts")
    # most tokens are in one prefix only; what is left is compared with the smallest id of its posting list
    lead = posts.groupBy("token").agg(F.min("rep").alias("lead"), F.count(F.lit(1)).alias("c")).filter("c > 1").select("token", "lead")
    shared = kept(posts.join(lead, "token"), "shared-posts")
    dropped(posts)
    first = shared.filter("rep > lead").alias("a").join(shared.filter("rep = lead").alias("b"), "token").filter(_in_order(percent)).select(F.col("b.rep").alias("a"), F.col("a.rep").alias("b")).distinct()
    first = kept(first, "first-pairs")
    links = kept(_verified(first, sets, percent), "links")
    label = kept(components(links), "labels")
    # what the leaders left apart
    tagged = shared.drop("lead").join(label.withColumnRenamed("id", "rep"), "rep", "left").withColumn("comp", F.coalesce("label", "rep")).drop("label")
    tagged = kept(tagged, "tagged")
    mixed = tagged.groupBy("token").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).filter("low < high").select("token", "low")
    # sizes that the length filter allows lie in one band of sizes or in neighbouring ones
    band = F.floor(F.ln(F.col("n")) / math.log(1.01 * 100 / percent)).cast("int")
    apart = kept(tagged.join(mixed, "token").withColumn("band", band), "apart")
    near = apart.withColumn("band", F.explode(F.array(F.col("band") - 1, F.col("band"), F.col("band") + 1)))
    rest = (
        apart.filter("comp <> low").alias("a").join(near.alias("b"), ["token", "band"])
        .filter((F.col("a.comp") != F.col("b.comp")) & ((F.col("b.comp") == F.col("b.low")) | (F.col("a.rep") < F.col("b.rep"))) & _in_order(percent))
        .select(F.least("a.rep", "b.rep").alias("a"), F.greatest("a.rep", "b.rep").alias("b")).distinct()
        .join(first, ["a", "b"], "left_anti")
    )
    to_label = lambda df, c: df.join(label.select(F.col("id").alias(c), F.col("label").alias(f"l_{c}")), c, "left").withColumn(c, F.coalesce(f"l_{c}", c)).drop(f"l_{c}")
    # different texts under one id are one node
    twin = member.groupBy("doc_id").agg(F.min("rep").alias("a"), F.max("rep").alias("z")).filter("a < z").select("doc_id", "a").join(member, "doc_id").select("a", F.col("rep").alias("b"))
    more = components(to_label(to_label(_verified(rest, sets, percent).unionByName(twin), "a"), "b").filter("a <> b").distinct())
    more = kept(more.select(F.col("id").alias("label"), F.col("label").alias("top")), "merged")
    for table in (shared, first, links, tagged, apart, sets):
        dropped(table)
    by_class = member.join(label.withColumnRenamed("id", "rep"), "rep", "left").select("doc_id", F.coalesce("label", "rep").alias("label"))
    by_class = by_class.join(more, "label", "left").groupBy("doc_id").agg(F.min(F.coalesce("top", "label")).alias("component_id"))
    return every.select("doc_id", F.col("n").alias("n_shingles")).join(by_class, "doc_id", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def one_of_each(docs: DataFrame, k: int = 5, percent: int = 75) -> DataFrame:
    """The documents, all columns, of which each near-duplicate component keeps its smallest id.

    Rows with a null doc_id are all kept; of rows that repeat a kept id, all stay.
    """
    go = ngram_components(docs, k, percent).filter("component_id <> doc_id").select("doc_id").distinct()
    return docs.join(go, "doc_id", "left_anti")
