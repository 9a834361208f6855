"""Language-model scoring with a hidden Markov model over word classes.

Method: Baum-Welch.  A latent state emits a *symbol* (a class of words: a hash of the
word's last three bytes, so the alphabet is bounded and every word, seen or not, has
one), and the symbol emits the word by its training count.  The model is

    P(text) = sum over state paths of  prod_t A[s_t-1, s_t] * B[s_t, symbol_t] * q(word_t | symbol_t)
    q(word | symbol) = (count(word) + 1) / (count(symbol) + vocabulary(symbol) + 1)

with one end token per text, and the sum over paths is the scaled forward recursion over
the whole text, so the likelihood is exact for texts of any length.  With one state the
model is a unigram model; states can only add to it.

Training starts from seeded parameters that no data shapes, and every round covers every
training text, until a round gains less than TOLERANCE: expected counts are computed per
partition and summed by (state, symbol) cell before anything reaches the driver, which only
sees the model's own parameters.  The symbols of the texts are stored for the rounds.  Word
counts are exchanged between blocks of texts (see ``blocks``), under a key that holds the word's
symbol in its lowest bits; no vocabulary is broadcast.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from oreflow.llm import blocks as B
from oreflow.llm.scratch import dropped, kept
from oreflow.llm.words import Words, buffer_of, mix, pieces, texts_of, words

SYMBOLS = 4096
"""Word classes; one more symbol is the end token."""
TOLERANCE = 1e-4
"""Training ends when a round raises the mean log10 likelihood of a token by less."""
LONG = 1 << 19
"""A text of more tokens is walked for itself, in segments, so that its states are never held at once."""
SEGMENT = 1 << 16
PIECE = 3 << 20
"""Bytes of symbols (two each) whose state probabilities a worker holds at once."""


@dataclass
class Model:
    start: np.ndarray
    step: np.ndarray
    emit: np.ndarray

    @property
    def states(self) -> int:
        return len(self.start)


@dataclass
class Counts:
    start: np.ndarray
    step: np.ndarray
    emit: np.ndarray
    score: float = 0.0
    """Log10 likelihood of the texts under the model that gave the counts."""

    def cells(self) -> np.ndarray:
        return np.concatenate([self.start, self.step.ravel(), self.emit.ravel(), [self.score]])

    @staticmethod
    def of(cells: np.ndarray, k: int) -> Counts:
        return Counts(cells[:k], cells[k : k + k * k].reshape(k, k), cells[k + k * k : -1].reshape(k, -1), float(cells[-1]))


def maximised(c: Counts) -> Model:
    """The M step, with a little of the overall distribution mixed in so that no symbol is impossible."""
    overall = (c.emit.sum(0) + 1) / (c.emit.sum() + c.emit.shape[1])
    share = lambda x: x / x.sum(-1, keepdims=True)
    return Model(share(c.start + 1), share(c.step + 1), share(c.emit + 10 * overall))


def symbols_of(w: Words) -> np.ndarray:
    """Symbol of every word, with the end symbol after each text's words."""
    size = w.end - w.start
    code = w.data[w.end - 1].astype(np.uint64)
    for back in (2, 3):
        code |= np.where(size >= back, w.data[np.maximum(w.end - back, 0)], 0).astype(np.uint64) << np.uint64(8 * (back - 1))
    return (mix(code + np.uint64(1)) % np.uint64(SYMBOLS)).astype(np.int64)


def with_ends(symbol: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Symbols with an end symbol after each text; and each text's first position."""
    return np.insert(symbol, first[1:], SYMBOLS), first + np.arange(len(first))


def _in_time(symbol: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Texts by falling length; bounds of each t's symbols; and the symbols by t, then by text in this order."""
    size = np.diff(first)
    order = np.argsort(-size, kind="stable")
    alive = len(size) - np.searchsorted(np.sort(size), np.arange(size.max(initial=0)), side="right")
    bound = np.concatenate([[0], np.cumsum(alive)])
    t = np.repeat(np.arange(len(alive)), alive)
    return order, bound, symbol[first[:-1][order][np.arange(len(t)) - bound[t]] + t]


def _forward(m: Model, order: np.ndarray, bound: np.ndarray, symbol: np.ndarray, keep: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Log10 likelihood of each text in order; with keep, also scaled state probabilities and scales by t.

    States are scaled at every EVERY-th t, and at a text's end; in between a scale is 1.
    """
    emit, one = np.ascontiguousarray(m.emit.T), np.ones(m.states)
    total = np.zeros(len(order))
    alpha = np.empty((len(symbol), m.states)) if keep else np.empty((0, m.states))
    scale = np.ones(len(symbol)) if keep else np.empty(0)
    a = np.empty((0, m.states))
    ends = bound.tolist()
    for t, (low, high) in enumerate(zip(ends, ends[1:])):
        n = high - low
        e = alpha[low:high] if keep else np.empty((n, m.states))
        emit.take(symbol[low:high], axis=0, out=e, mode="clip")
        a = np.multiply(a[:n] @ m.step if t else m.start[None, :], e, out=e)
        first = _scaled_from(t, ends)
        if first < n:
            c = a[first:] @ one
            a[first:] /= c[:, None]
            total[first:n] += np.log10(c)
            if keep:
                scale[low + first : high] = c
    return total, alpha, scale


EVERY = 8
"""Steps between two scalings: the least probability of a symbol, some 1e-10, to this power is far above underflow."""


def _scaled_from(t: int, ends: list[int]) -> int:
    """The first of the texts at t that are scaled there: all at every EVERY-th t, else those that end."""
    if t % EVERY == EVERY - 1:
        return 0
    return ends[t + 2] - ends[t + 1] if t + 2 < len(ends) else 0


def _walk(m: Model, before: np.ndarray | None, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Scaled state probabilities and scales of a segment of one text; before: those of the token before it."""
    emit = np.ascontiguousarray(m.emit.T)[symbol]
    alpha, scale = np.empty((len(symbol), m.states)), np.empty(len(symbol))
    for t in range(len(symbol)):
        a = (m.start if before is None else before @ m.step) * emit[t]
        scale[t] = a.sum()
        before = alpha[t] = a / scale[t]
    return alpha, scale


def _likelihood_of_one(m: Model, symbol: np.ndarray) -> float:
    total, last = 0.0, None
    for low in range(0, len(symbol), SEGMENT):
        alpha, scale = _walk(m, last, symbol[low : low + SEGMENT])
        total, last = total + float(np.log10(scale).sum()), alpha[-1]
    return total


def expected_of_one(m: Model, symbol: np.ndarray) -> Counts:
    """The E step over one text of any length: forward once for the states at the segments' edges, then backward,
    each segment's states computed anew."""
    edges, last = [], None
    for low in range(0, len(symbol), SEGMENT):
        edges.append(last)
        last = _walk(m, last, symbol[low : low + SEGMENT])[0][-1]
    step, weight, b, score = np.zeros((m.states, m.states)), np.zeros((m.states, SYMBOLS + 1)), np.ones(m.states), 0.0
    emit = np.ascontiguousarray(m.emit.T)
    for i in range(len(edges) - 1, -1, -1):
        part = symbol[i * SEGMENT : (i + 1) * SEGMENT]
        alpha, scale = _walk(m, edges[i], part)
        gamma = np.empty_like(alpha)
        for t in range(len(part) - 1, -1, -1):
            gamma[t] = alpha[t] * b
            back = emit[part[t]] * b / scale[t]
            before = alpha[t - 1] if t else edges[i]
            if before is not None:
                step += np.outer(before, back)
            b = m.step @ back
        weight += np.stack([np.bincount(part, weights=gamma[:, s], minlength=SYMBOLS + 1) for s in range(m.states)])
        score += float(np.log10(scale).sum())
    return Counts(gamma[0], step * m.step, weight, score)


def forward(m: Model, symbol: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Log10 likelihood of each symbol sequence."""
    size, out = np.diff(first), np.empty(len(first) - 1)
    long = np.flatnonzero(size > LONG)
    for d in long:
        out[d] = _likelihood_of_one(m, symbol[first[d] : first[d + 1]])
    if len(long):
        short = size <= LONG
        symbol, first = symbol[np.repeat(short, size)], np.concatenate([[0], np.cumsum(size[short])])
    else:
        short = np.ones(len(size), bool)
    order, bound, by_time = _in_time(symbol, first)
    total = np.empty(len(order))
    total[order], _, _ = _forward(m, order, bound, by_time, False)
    out[short] = total
    return out


def expected(m: Model, symbol: np.ndarray, first: np.ndarray) -> Counts:
    """The E step over some whole texts."""
    order, bound, by_time = _in_time(symbol, first)
    total, gamma, scale = _forward(m, order, bound, by_time, True)
    emit, back_step = np.ascontiguousarray(m.emit.T), np.ascontiguousarray(m.step.T)
    step = np.zeros((m.states, m.states))
    b = np.ones((len(order), m.states))
    ends = bound.tolist()
    for t in range(len(ends) - 2, 0, -1):
        low, n = ends[t], ends[t + 1] - ends[t]
        back = emit.take(by_time[low : low + n], axis=0)
        back *= b[:n]
        from_ = _scaled_from(t, ends)
        if from_ < n:
            back[from_:] /= scale[low + from_ : low + n, None]
        before = gamma[ends[t - 1] : ends[t - 1] + n]
        step += before.T @ back
        np.matmul(back, back_step, out=b[:n])
        before *= b[:n]
    weight = np.stack([np.bincount(by_time, weights=gamma[:, s], minlength=SYMBOLS + 1) for s in range(m.states)])
    return Counts(gamma[: len(order)].sum(0), step * m.step, weight, float(total.sum()))


def _symbol_sequences(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    w = words(texts, lower=True)
    return with_ends(symbols_of(w), w.first)


def _starting_point(k: int, seed: int) -> Model:
    """Seeded parameters that depend on no data; states tend to stay."""
    emit = np.random.default_rng(seed).gamma(2.0, size=(k, SYMBOLS + 1))
    return Model(np.full(k, 1 / k), np.full((k, k), 0.1 / k) + 0.9 * np.eye(k), emit / emit.sum(1, keepdims=True))


def trained(train: DataFrame, states: int = 6, seed: int = 0) -> Model:
    """Baum-Welch over all texts of ``train`` (column text), all of them in every round, until a round gains less than TOLERANCE.

    Null and wordless texts are an end alone; without texts the seeded start is the model.
    """
    return _converged(kept(train.select("text").mapInArrow(_to_symbols, "symbols binary"), "symbols"), states, seed)


def _converged(sequences: DataFrame, states: int, seed: int) -> Model:
    model, last = _starting_point(states, seed), -np.inf
    while True:
        total = sequences.mapInArrow(_e_step(model), "cell int, value double").groupBy("cell").agg(F.sum("value").alias("value"))
        cells = np.zeros(len(Counts(model.start, model.step, model.emit).cells()))
        for r in total.collect():
            cells[r.cell] = r.value
        counts = Counts.of(cells, states)
        tokens = counts.emit.sum()
        if tokens == 0 or counts.score / tokens - last < TOLERANCE:
            return model
        model, last = maximised(counts), counts.score / tokens


def _to_symbols(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for p in pieces(batch):
            symbol, first = _symbol_sequences(texts_of(p.column("text")))
            packed = pa.Array.from_buffers(pa.binary(), p.num_rows, [None, pa.py_buffer((2 * first).astype(np.int32)), pa.py_buffer(symbol.astype(np.uint16))])
            yield pa.RecordBatch.from_arrays([packed], ["symbols"])


def _block_symbols(block: int, docs: pa.Table) -> pa.Table:
    """Symbol sequences of a block's training texts."""
    return pa.Table.from_batches(_to_symbols(docs.filter(docs.column("train")).to_batches()), schema=pa.schema([("symbols", pa.binary())]))


def _e_step(model: Model) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            # by length, so that few pieces have the many steps of a long text
            batch = batch.take(pc.sort_indices(pc.binary_length(batch.column("symbols"))))
            for p in pieces(batch, "symbols", PIECE):
                data, at = buffer_of(p.column("symbols").cast(pa.large_binary()))
                symbol = np.frombuffer(data.tobytes(), np.uint16).astype(np.int64)
                # sorted by length, so a text longer than a piece is one for itself
                got = (expected_of_one(model, symbol) if len(at) == 2 and len(symbol) > LONG else expected(model, symbol, at // 2)).cells()
                total = got if total is None else total + got
        if total is not None:
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at])], ["cell", "value"])

    return run


def _keys(w: Words) -> np.ndarray:
    """A word's key: 52 bits of its hash over the 12 bits of its symbol."""
    return w.hashes() & np.uint64(2**64 - SYMBOLS) | symbols_of(w).astype(np.uint64)


def _send_words(exchange: B.Exchange):
    """A block's words with their training counts; words that only stand in other texts are asked for with 0."""

    def send(block: int, docs: pa.Table) -> pa.Table:
        keys, counts = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)]
        for p in pieces(docs):
            w = words(texts_of(p.column("text")), lower=True)
            keys.append(_keys(w))
            counts.append(np.repeat(p.column("train").to_numpy().astype(np.uint64), w.counts))
        return exchange.sent(block, np.concatenate(keys), np.concatenate(counts))

    return send


_BY_SYMBOL = np.dtype([("vocab", "<u8"), ("total", "<u8")])


def _by_symbol(keys: np.ndarray, totals: np.ndarray) -> tuple[bytes, bytes]:
    """Of a range of the key space: symbols (uint16), and the distinct words and tokens seen of each."""
    symbol = (keys & np.uint64(SYMBOLS - 1)).astype(np.int64)
    vocab, seen = np.bincount(symbol[totals > 0], minlength=SYMBOLS), np.bincount(symbol, weights=totals, minlength=SYMBOLS)
    at = np.flatnonzero(seen)
    sums = np.empty(len(at), _BY_SYMBOL)
    sums["vocab"], sums["total"] = vocab[at], seen[at]
    return at.astype(np.uint16).tobytes(), sums.tobytes()


def _explode_symbols(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b in zip(batch.column("keys"), batch.column("vals")):
            sums = np.frombuffer(b.as_buffer(), _BY_SYMBOL)
            yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(a.as_buffer(), np.uint16).astype(np.int32)), pa.array(sums["vocab"].astype(np.int64)), pa.array(sums["total"].astype(np.int64))], ["symbol", "vocab", "total"])


_SCORES = pa.schema([("doc_id", pa.int64()), ("train", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])
_SCORES_SQL = "doc_id long, train boolean, n_tokens long, n_known long, base_score double, score double"


def _scorer(model: Model, log_share: np.ndarray, end_count: int, base: float):
    """log_share: of each symbol, log10 of the denominator of q.  base: log10 of the base model's denominator."""

    def score(block: int, docs: pa.Table, replies: pa.Table) -> pa.Table:
        key, total = B.replied(replies, B.TOTAL.value)
        log_count = np.log10(total + 1.0)
        out = []
        for p in pieces(docs):
            w = words(texts_of(p.column("text")), lower=True)
            place = np.searchsorted(key, _keys(w))
            symbol = symbols_of(w)
            owner = w.doc_of_word()
            by_doc = lambda x: np.bincount(owner, weights=x, minlength=p.num_rows)  # noqa: B023, E731
            counted, known = by_doc(log_count[place]), by_doc(total[place] > 0)
            shared = by_doc(log_share[symbol])
            latent = forward(model, *with_ends(symbol, w.first))
            n = w.counts + 1
            columns = [p.column("doc_id").combine_chunks().cast(pa.int64()), p.column("train").combine_chunks(), pa.array(n), pa.array(known.astype(np.int64) + (end_count > 0)), pa.array(counted + np.log10(end_count + 1.0) - n * base), pa.array(latent + counted - shared)]
            out.append(pa.table(columns, schema=_SCORES))
        return pa.concat_tables(out) if out else _SCORES.empty_table()

    return score


def hmm_scores(docs: DataFrame, is_train: Column, states: int = 6, seed: int = 0) -> DataFrame:
    """Score every whole text with a model trained on the rows where ``is_train``.

    ``docs``: (doc_id long, text string, ...); other columns are only seen by ``is_train``.
    Returns one row per input row: doc_id, train, n_tokens (words and one end), n_known
    (those with a training count), train_tokens, base_score (add-one unigram) and score
    (hidden Markov model), both as log10 probabilities of the text.

    A null or wordless text is an end token alone.  A null condition means training.
    Repeated rows count as often as they stand there.  Without training rows every count is
    zero and the states stay near their start.  Empty input, empty result.
    """
    flag = F.coalesce(is_train, F.lit(True))
    blocks = B.in_blocks(docs.select("doc_id", "text", flag.alias("train")), ("train",))
    exchange = B.Exchange.over(blocks, B.TOTAL)
    told = kept(exchange.replies(blocks.each(_send_words(exchange), B.ROWS), _by_symbol), "word-counts")
    sums = told.filter("block IS NULL").mapInArrow(_explode_symbols, "symbol int, vocab long, total long").groupBy("symbol").agg(F.sum("vocab").alias("vocab"), F.sum("total").alias("total")).collect()
    sequences = kept(blocks.each(_block_symbols, "symbols binary"), "symbols")
    ends = sequences.count()
    share = np.zeros(SYMBOLS)
    for r in sums:
        share[r.symbol] = r.vocab + r.total
    words_seen, vocab = sum(r.total for r in sums), sum(r.vocab for r in sums)
    tokens, types = words_seen + ends, vocab + (ends > 0)
    model = _converged(sequences, states, seed)
    dropped(sequences)
    scored = blocks.with_replies(told.filter("block IS NOT NULL"), _scorer(model, np.log10(share + 1), ends, float(np.log10(tokens + types + 1))), _SCORES_SQL)
    return scored.withColumn("train_tokens", F.lit(tokens).cast("long"))
