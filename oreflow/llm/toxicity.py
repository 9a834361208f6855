"""Toxicity by multiple-instance learning.

A document is a bag of sentences.  Every sentence gets a probability from a logistic model
over its hashed words, and the document's is their noisy-or, ``1 - prod(1 - p)``: one
toxic sentence is enough, and harmless ones don't dilute it.  Only document labels train
the model; the gradient reaches the sentences through the noisy-or, so afterwards the
sentence probabilities locate the offending ones.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from oreflow.llm.scratch import kept
from oreflow.llm.words import Words, mix, pieces, texts_of, words

FEATURES = 1 << 18
PREFIXES = (4, 5, 6)
"""A word also counts as its first bytes, so inflected forms share what is learned of their stem."""
TRAIN_ROWS, TRAIN_BYTES = 5000, 64 << 20
"""Bounds of the labelled sample that the classifier is fitted on: rows, and UTF-8 bytes of their texts together."""
ROUNDS = 160
MIN_DOCS = 4
"""Features in fewer training documents carry no weight."""
_STOP = np.zeros(256, bool)
_STOP[[ord(c) for c in ".!?"]] = True
_MARK = np.zeros(256, bool)
_MARK[[c for c in range(0x21, 0x80) if not chr(c).isalnum()]] = True


@dataclass
class Bags:
    """Features of every word (a row for the word and for each prefix; FEATURES where it has none), sentence of
    every word, document of every sentence, first word of every sentence."""

    features: np.ndarray
    sentence: np.ndarray
    doc: np.ndarray
    first: np.ndarray


def bags(w: Words) -> Bags:
    """Sentences end after a word that ends in ``.``, ``!`` or ``?``, at a line end and at a text's end.

    Words lose up to four ASCII marks at either side before they are hashed.
    """
    n = len(w.start)
    stop = _STOP[w.data[w.end - 1]] if n else np.zeros(0, bool)
    lines = np.cumsum(w.data == 0x0A)
    line = lines[w.start] if n else np.zeros(0, np.int64)
    doc = w.doc_of_word()
    new = np.ones(n, bool)
    new[1:] = stop[:-1] | (line[1:] != line[:-1]) | (doc[1:] != doc[:-1])
    start, end = w.start.copy(), w.end.copy()
    for _ in range(4):
        start += _MARK[w.data[start]] & (end - start > 1) if n else 0
        end -= _MARK[w.data[end - 1]] & (end - start > 1) if n else 0
    rows = [(Words(w.data, start, end, w.first).hashes() % np.uint64(FEATURES)).astype(np.int32)]
    for size in PREFIXES:
        head = mix(Words(w.data, start, np.minimum(start + size, end), w.first).hashes() + np.uint64(size))
        rows.append(np.where(end - start > size, head % np.uint64(FEATURES), np.uint64(FEATURES)).astype(np.int32))
    first = np.flatnonzero(new)
    return Bags(np.stack(rows), (np.cumsum(new) - 1).astype(np.int32), doc[first], first)


@dataclass
class Model:
    weight: np.ndarray
    bias: float

    def sentences(self, b: Bags) -> np.ndarray:
        """Log-odds of every sentence."""
        return self.bias + sum(np.bincount(b.sentence, weights=self.weight[row], minlength=len(b.doc)) for row in b.features)


def noisy_or(z: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    """``-log(1 - P)`` of each document; 0 for one without sentences."""
    return np.bincount(doc, weights=np.logaddexp(0, z), minlength=n)


def fit(texts: list[str | None], toxic: list[int], sparsity: float = 3e-4, rate: float = 0.2) -> Model:
    """Full-batch Adam on the noisy-or's log loss, with weights from 0 up and an L1 penalty on them.

    Words can so only add toxicity, and a long document of rare words gathers none.
    """
    b, y = bags(words(texts_of(pa.array(texts, pa.string())), lower=True)), np.asarray(toxic, float)
    model = Model(np.zeros(FEATURES + 1), -6.0)
    if not b.features.size or y.min() == y.max():
        return model
    owner, n = b.doc[b.sentence], np.int64(len(y))
    holders = sum(np.bincount(np.unique(row * n + owner) // n, minlength=FEATURES + 1) for row in b.features)
    used = np.flatnonzero(holders[:FEATURES] >= MIN_DOCS)
    at = np.full(FEATURES + 1, -1, np.int32)
    at[used] = np.arange(len(used))
    feature = at[b.features]
    hit = feature >= 0
    feature, sentence = feature[hit], np.broadcast_to(b.sentence, hit.shape)[hit]
    del hit, owner
    theta, m, v = np.append(np.zeros(len(used)), model.bias), np.zeros(len(used) + 1), np.zeros(len(used) + 1)
    for t in range(1, ROUNDS + 1):
        z = theta[-1] + np.bincount(sentence, weights=theta[feature], minlength=len(b.doc))
        s = np.maximum(noisy_or(z, b.doc, len(y)), 1e-9)
        slope = np.where(y > 0, -1 / np.expm1(np.minimum(s, 500)), 1.0)
        g = slope[b.doc] / (1 + np.exp(-z)) / len(y)
        grad = np.append(np.bincount(feature, weights=g[sentence], minlength=len(used)), g.sum())
        grad[:-1] += sparsity
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        theta -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
        theta[:-1] = np.maximum(theta[:-1], 0)
    model.weight[used], model.bias = theta[:-1], float(theta[-1])
    return model


def trained(docs: DataFrame, labels: DataFrame) -> Model:
    """Fit on at most TRAIN_ROWS labelled documents and TRAIN_BYTES of text: those with the smallest hashes of
    their id, without texts of more than a 64th of these bytes.

    ``labels``: (doc_id, toxic, ...); null labels are left out, of contradicting ones the greater counts.  Rows
    that repeat a doc_id are documents each; without labels, or with one label alone, nothing is toxic.
    """
    known = labels.filter("toxic IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    sample = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(TRAIN_ROWS)
    texts = docs.select("doc_id", "text", F.coalesce(F.octet_length("text"), F.lit(0)).alias("size")).filter(F.col("size") <= TRAIN_BYTES // 64)
    order = [F.xxhash64("doc_id"), "doc_id", "text"]
    held = kept(texts.join(F.broadcast(sample), "doc_id").orderBy(*order).limit(TRAIN_ROWS), "labelled").orderBy(*order)
    total = np.cumsum([r["size"] for r in held.select("size").collect()])
    rows = held.limit(int(np.searchsorted(total, TRAIN_BYTES, side="right"))).collect()
    return fit([r.text for r in rows], [r.toxic for r in rows]) if rows else Model(np.zeros(FEATURES + 1), -6.0)


_SENTENCES = pa.list_(pa.struct([("word", pa.int64()), ("words", pa.int64()), ("score", pa.float64())]))
_SCORED = "doc_id long, score double, sentences array<struct<word: long, words: long, score: double>>"


def _scorer(model: Model, least: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for p in pieces(batch):
                w = words(texts_of(p.column("text")), lower=True)
                b = bags(w)
                z = model.sentences(b)
                score = -np.expm1(-noisy_or(z, b.doc, p.num_rows))
                found: list[list[dict]] = [[] for _ in range(p.num_rows)]
                ends = np.append(b.first[1:], len(w.start))
                one = 1 / (1 + np.exp(-z))
                for s in np.flatnonzero(one >= least):
                    d = b.doc[s]
                    found[d].append({"word": int(b.first[s] - w.first[d]), "words": int(ends[s] - b.first[s]), "score": float(one[s])})
                yield pa.RecordBatch.from_arrays([p.column("doc_id").cast(pa.int64()), pa.array(score), pa.array(found, _SENTENCES)], ["doc_id", "score", "sentences"])

    return run


def toxicity(docs: DataFrame, model: Model, least: float = 0.5) -> DataFrame:
    """Score every whole text: doc_id, score in 0 to 1, sentences (first word, words, score) that reach ``least``.

    Only the text is an input.  Null, empty and wordless texts have no sentence and score 0.
    Rows are scored each on its own, so repeated rows score alike; texts of any length are
    read whole; an empty table gives an empty result.
    """
    return docs.select("doc_id", "text").mapInArrow(_scorer(model, least), _SCORED)
