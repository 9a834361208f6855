"""Substring dedup: passages that an earlier document holds are cut out of later ones.

Method: relative Lempel-Ziv parsing.  The reference of a document is all documents
with a smaller id; it is indexed by its windows of ``window`` words, each under the
document and word position where it first stands, in ranges of the key space.  Every
document is factored greedily against the whole index: a factor begins at the first
window that the index knows and no factor before it holds, takes of the references
known there the one that goes on longest, and ends where that reference does.  That a
reference goes on is seen from positions: its next window is the one at the next word,
or one so near that the windows in hand leave no word between them (what lies there
may be known from a still earlier document).  Windows that straddle a factor's end are
looked up like all others, and where one is known the next factor begins with it; so
factors are at least a window long, may overlap at their ends, and cover every word that
a known window covers.  The words removed are those that factors cover.

Most windows are of one document only and never reach the index.  They are kept out
by their anchor: the smallest hash among a window's five-word grams.  Equal windows
have equal anchors, so a window whose anchor stands once in the corpus is unique; and
neighbouring windows mostly share an anchor, so anchors cost a fifth of the windows.

Windows are compared by a 64-bit hash of their words.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from oreflow.llm import blocks as B
from oreflow.llm.words import Words, pieces, texts_of, words

GRAM = 5
NO_ID = np.iinfo(np.int64).max
"""Stands for a null doc_id: greater than all others, so never a reference."""


def _windows(w: Words, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Positions where a window fits, and its hash and anchor there."""
    h = w.hashes()
    n = len(h) - window + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    key, whole = w.grams(h, window)
    size = min(GRAM, window)
    gram = w.grams(h, size)[0]
    anchor = gram[:n].copy()
    for j in range(1, window - size + 1):
        np.minimum(anchor, gram[j : n + j], out=anchor)
    at = np.flatnonzero(whole[:n])
    return at, key[at], anchor[at]


def _ids(table: pa.Table) -> np.ndarray:
    return table.column("doc_id").combine_chunks().cast(pa.int64()).fill_null(NO_ID).to_numpy(zero_copy_only=False)


def _send_anchors(window: int, exchange: B.Exchange):
    def send(block: int, docs: pa.Table) -> pa.Table:
        found = [np.zeros(0, np.uint64)]
        for p in pieces(docs):
            w = words(texts_of(p.column("text")))
            at, _, anchor = _windows(w, window)
            doc = w.doc_of_word()[at]
            fresh = np.ones(len(at), bool)
            fresh[1:] = (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1])
            found.append(anchor[fresh])
        anchors = np.concatenate(found)
        return exchange.sent(block, anchors, np.ones(len(anchors), np.uint32))

    return send


PLACE = np.dtype([("doc", "<i8"), ("at", "<i4")])
"""Where a window stands: document and word position."""


def _first_places(keys: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and the first place of each: of the smallest document the smallest position."""
    order = np.argsort(keys)
    keys, doc = keys[order], places["doc"][order]
    at = B.runs(keys)
    out = np.empty(len(at), PLACE)
    if len(at):
        out["doc"] = np.minimum.reduceat(doc, at)
        mine = doc == np.repeat(out["doc"], np.diff(np.append(at, len(keys))))
        out["at"] = np.minimum.reduceat(np.where(mine, places["at"][order], np.iinfo(np.int32).max), at)
    return keys[at], out


#: The first place of a window; a sender is told where an earlier document than its own holds it.
FIRST = B.Meaning(PLACE, _first_places, lambda own, best: best["doc"] < own["doc"])


def _places(w: Words, at: np.ndarray, ids: np.ndarray) -> np.ndarray:
    out = np.empty(len(at), PLACE)
    doc = w.doc_of_word()[at]
    out["doc"], out["at"] = ids[doc], at - w.first[doc]
    return out


def _send_windows(window: int, exchange: B.Exchange):
    def send(block: int, docs: pa.Table, replies: pa.Table) -> pa.Table:
        known = B.Frequencies(replies)
        keys, places = [np.zeros(0, np.uint64)], [np.zeros(0, PLACE)]
        for p in pieces(docs):
            w = words(texts_of(p.column("text")))
            at, key, anchor = _windows(w, window)
            shared = known.of(anchor) >= 2
            keys.append(key[shared])
            places.append(_places(w, at[shared], _ids(p)))
        return exchange.sent(block, np.concatenate(keys), np.concatenate(places))

    return send


_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("words", pa.int64()), ("reference", pa.int64()), ("reference_start", pa.int64())]))
_CUT = pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("spans", _SPANS)])
_CUT_SQL = "doc_id long, text string, n_words long, n_removed long, spans array<struct<start: long, words: long, reference: long, reference_start: long>>"


def factors(at: np.ndarray, doc: np.ndarray, ref: np.ndarray, window: int) -> list[tuple[int, int, int, int]]:
    """Greedy factors (start, words, reference, reference_start) of one document, from its known windows: where
    each begins (rising), and the document and word where it stands first."""
    cut = np.concatenate([[0], np.flatnonzero((np.diff(at) != 1) | (np.diff(doc) != 0) | (np.diff(ref) != 1)) + 1])
    low, high = at[cut].tolist(), (at[np.append(cut[1:], len(at)) - 1] + window).tolist()
    refs, shift = doc[cut].tolist(), (ref[cut] - at[cut]).tolist()
    # stretches [low, high) of one reference and one shift are one where no word lies between them
    stretches, last = [], {}
    for a, b, d, s in zip(low, high, refs, shift):
        held = last.get((d, s))
        if held is not None and a <= held[1]:
            held[1] = b
        else:
            last[d, s] = held = [a, b, d, s]
            stretches.append(held)
    # every run of known windows begins one stretch; those that hold a window are among those that began before it
    out, done, begun, k, live = [], -1, 0, 0, []
    while True:
        # the first known window that no factor holds
        k = int(np.searchsorted(at, done - window + 1)) if out else 0
        if k >= len(at):
            return out
        x = int(at[k])
        while begun < len(stretches) and stretches[begun][0] <= x:
            live.append(stretches[begun])
            begun += 1
        live = [t for t in live if t[1] >= x + window]
        a, b, d, s = max(live, key=lambda t: t[1])
        out.append((x, b - x, d, x + s))
        done = b


def _parse(window: int, carry: tuple[str, ...]):
    def parse(block: int, docs: pa.Table, replies: pa.Table) -> pa.Table:
        batches = []
        for p in pieces(docs):
            w = words(texts_of(p.column("text")))
            at, key, _ = _windows(w, window)
            batches.append((p, w, at, key))
        # a known window is one that was answered, or one that stands in the block twice; few of all are
        told, best = B.replied(replies, PLACE)
        every = np.sort(np.concatenate([np.zeros(0, np.uint64), *(b[3] for b in batches)]))
        asked = np.union1d(told, every[1:][every[1:] == every[:-1]])
        del every
        for i, (p, w, at, key) in enumerate(batches):
            there = np.zeros(len(key), bool)
            if len(asked):
                there = asked[np.minimum(np.searchsorted(asked, key), len(asked) - 1)] == key
            batches[i] = p, w, at[there], key[there], _places(w, at[there], _ids(p))
        known, first = _first_places(np.concatenate([told, *(b[3] for b in batches)]), np.concatenate([best, *(b[4] for b in batches)]))
        out = []
        for p, w, at, key, own in batches:
            source = first[np.searchsorted(known, key)] if len(key) else own
            hit = np.flatnonzero(source["doc"] < own["doc"])
            at, source = at[hit], source[hit]
            bounds = np.searchsorted(at, w.first)
            spans: list[list[dict]] = [[] for _ in range(p.num_rows)]
            gone = np.zeros(len(w.start) + 1, np.int64)
            for d in np.flatnonzero(np.diff(bounds)):
                part, base = slice(bounds[d], bounds[d + 1]), int(w.first[d])
                for start, size, reference, place in factors(at[part] - base, source["doc"][part], source["at"][part].astype(np.int64), window):
                    spans[d].append({"start": start, "words": size, "reference": reference, "reference_start": place})
                    gone[base + start] += 1
                    gone[base + start + size] -= 1
            gone = np.cumsum(gone)[:-1] > 0
            lost = np.diff(np.concatenate([[0], np.cumsum(gone)])[w.first])
            text = p.column("text").combine_chunks()
            if lost.any():
                text, raw = text.to_pylist(), w.data.tobytes()
                for d in np.flatnonzero(lost):
                    text[d] = _without(raw, w, int(w.first[d]), int(w.first[d + 1]), gone)
                text = pa.array(text, pa.string())
            ids = p.column("doc_id").combine_chunks().cast(pa.int64())
            columns = [ids, text.cast(pa.string()), pa.array(w.counts, pa.int64()), pa.array(lost, pa.int64()), pa.array(spans, _SPANS), *(p.column(c) for c in carry)]
            out.append(pa.table(columns, names=[*_CUT.names, *carry]))
        return pa.concat_tables(out)

    return parse


def _without(raw: bytes, w: Words, a: int, b: int, gone: np.ndarray) -> str:
    """The text of words a to b, as it stands, without the words that are gone and what follows each up to the next word."""
    edge = np.flatnonzero(np.diff(np.concatenate([[False], gone[a:b], [False]]).astype(np.int8)))
    keep, at = [], int(w.start[a])
    for i, j in zip(edge[::2], edge[1::2]):
        keep.append(raw[at : w.start[a + i]])
        at = int(w.start[a + j]) if a + j < b else int(w.end[b - 1])
    keep.append(raw[at : w.end[b - 1]])
    return b"".join(keep).decode("utf-8")


def substring_dedup(docs: DataFrame, window: int = 13, carry: tuple[str, ...] = ()) -> DataFrame:
    """Cut out every word that a window of ``window`` words covers which an earlier document holds.

    ``docs``: (doc_id long, text string, ...); other columns are ignored.  Windows are judged
    on the texts as given, case and all, not on what is left of them.  Returns one row per
    input row: doc_id, text (what is left; untouched texts are returned as they are), n_words,
    n_removed, spans (the factors in order: start word, words, reference doc_id and the word where
    it begins there), and the columns named in ``carry``.

    Null and wordless texts have no words and keep their value; a text of which all words go
    becomes empty.  A null doc_id counts as greater than all others and is never a reference;
    rows that repeat one doc_id don't cut each other, and are one reference.  Empty input, empty result.
    """
    blocks = B.in_blocks(docs, carry)
    of_anchors, of_windows = B.Exchange.over(blocks, B.FREQUENCY), B.Exchange.over(blocks, FIRST)
    anchors = of_anchors.replies(blocks.each(_send_anchors(window, of_anchors), B.ROWS))
    index = of_windows.replies(blocks.with_replies(anchors, _send_windows(window, of_windows), B.ROWS))
    return blocks.with_replies(index, _parse(window, carry), StructType([*StructType.fromDDL(_CUT_SQL), *(docs.schema[c] for c in carry)]))


def kept_digest(cut: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of :func:`substring_dedup`'s result."""
    plain = F.regexp_replace(F.btrim(F.coalesce("text", F.lit("")), F.lit(" \t\n\x0b\x0c\r")), r"[\x20\x09-\x0D]+", " ")
    return cut.select("doc_id", "n_words", "n_removed", F.sha2(F.encode(plain, "UTF-8"), 256).alias("kept_sha256"))
