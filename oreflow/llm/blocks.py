"""Documents in blocks, and a packed exchange of 64-bit keys between blocks.

Several operators ask one question about every n-gram of the corpus: which other
documents hold it?  A row per n-gram would cost a hundred bytes of JVM work each.
Here documents are packed, partition by partition, into *blocks* of a few megabytes,
one compressed row each, whatever their ids and however many are alike.  A block sends
its distinct keys, already combined, and gets back what it needs to know of each.

A block does not send to every range of the key space, as the number of such messages
would grow with the square of the corpus.  The exchange goes in rounds instead: blocks
have a number of ``depth`` digits to the base ``fan``, key ranges as well, and in each
round units that differ in one digit of the block's number combine what they hold of one
further digit of the key's.  So a unit has at most about ``fan`` senders and a block's
worth of distinct keys, at any corpus size; a key that a third of all documents hold is
one entry a sender; and the answers go back the same way.  One round does up to FAN blocks
or 32 GB of text, two do 130 TB.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from oreflow.llm.scratch import kept
from oreflow.llm.words import mix

BLOCK_BYTES = 8 << 20
"""Text per block."""
ROW_BYTES = 32
"""What a row counts beside its text, so that a block of empty texts is bounded too."""
FAN = 4096
"""Most senders of a unit, about; a message then has some hundred keys."""

_ONE_BLOCK = {"parquet.page.size.row.check.min": "1", "parquet.block.size.row.check.min": "1", "parquet.block.size": str(16 << 20)}
"""Rows are megabytes, so the writer looks at its buffers after each, and a reader gets a few at a time."""


def _flushed(held: list[pa.RecordBatch], block: int) -> pa.RecordBatch:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, held[0].schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", compression_level=3))) as out:
        for batch in held:
            out.write_batch(batch)
    data = sink.getvalue()
    cell = pa.Array.from_buffers(pa.binary(), 1, [None, pa.py_buffer(np.array([0, data.size], np.int32)), data])
    return pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), cell], ["block", "docs"])


def _packer(most: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        block, held, size = TaskContext.get().partitionId() << 32, [], 0
        for batch in batches:
            total = np.cumsum(pc.binary_length(batch.column("text")).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64) + ROW_BYTES)
            at = 0
            while at < batch.num_rows:
                base = total[at - 1] if at else 0
                # up to the block's end; a row that is larger than a block is a block of its own
                to = int(np.searchsorted(total, base + most - size, side="right"))
                if to == at and not held:
                    to = at + 1
                if to > at:
                    held.append(batch.slice(at, to - at))
                    size += int(total[to - 1] - base)
                    at = to
                if at < batch.num_rows:
                    yield _flushed(held, block)
                    block, held, size = block + 1, [], 0
        if held:
            yield _flushed(held, block)

    return pack


def unpacked(cell: pa.Scalar) -> pa.Table:
    """The documents of a block's cell ``docs``."""
    return pa.ipc.open_stream(cell.as_buffer()).read_all()


@dataclass(frozen=True)
class Blocks:
    """``table``: (block long, docs binary), in the shared folder.

    All steps of a query over blocks are grouped by block, so that they share one exchange of the packed texts,
    and a worker holds one block at a time.
    """

    table: DataFrame
    fan: int
    depth: int

    def each(self, run: Callable[[int, pa.Table], pa.Table], schema) -> DataFrame:
        """run(block, documents) for each block."""

        def one(docs: pa.Table) -> pa.Table:
            return run(docs.column("block")[0].as_py(), unpacked(docs.column("docs")[0]))

        return self.table.groupBy("block").applyInArrow(one, schema)

    def with_replies(self, replies: DataFrame, run: Callable[[int, pa.Table, pa.Table], pa.Table], schema) -> DataFrame:
        """run(block, documents, the block's replies) for each block."""

        def one(docs: pa.Table, mine: pa.Table) -> pa.Table:
            return run(docs.column("block")[0].as_py(), unpacked(docs.column("docs")[0]), mine)

        return self.table.groupBy("block").cogroup(replies.groupBy("block")).applyInArrow(one, schema)


def in_blocks(docs: DataFrame, carry: tuple = (), most: int | None = None, fan: int | None = None) -> Blocks:
    """The columns doc_id, text and those to carry along, in blocks; the text is read once."""
    packed = docs.select("doc_id", "text", *carry).mapInArrow(_packer(most or BLOCK_BYTES), "block long, docs binary")
    table = kept(packed, "blocks", **_ONE_BLOCK)
    n, widest, depth = max(table.count(), 1), fan or FAN, 1
    while widest**depth < n:
        depth += 1
    base = next(f for f in range(max(1, int(n ** (1 / depth)) - 1), widest + 1) if f**depth >= n)
    return Blocks(table, base, depth)


def runs(values: np.ndarray) -> np.ndarray:
    """Start of each run of equal neighbours."""
    if not len(values):
        return np.zeros(0, np.int64)
    return np.concatenate([[0], np.flatnonzero(values[1:] != values[:-1]) + 1])


@dataclass(frozen=True)
class Meaning:
    """What is exchanged about a key: the type of its value, how values of one key combine (sorted distinct
    keys and their values, of keys and values in any order), and who is told (of a sender's own values and
    the combined ones)."""

    value: np.dtype
    combine: Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]
    told: Callable[[np.ndarray, np.ndarray], np.ndarray]


def summed(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys)
    keys = keys[order]
    at = runs(keys)
    total = np.add.reduceat(values[order].astype(np.uint64), at) if len(at) else values.astype(np.uint64)
    return keys[at], np.minimum(total, np.uint64(np.iinfo(values.dtype).max)).astype(values.dtype)


#: How often a key occurs in all blocks; a sender is told where that is twice or more.
FREQUENCY = Meaning(np.dtype(np.uint32), summed, lambda own, total: total >= 2)
#: The same for sums of any size, zero too; every sender is told.
TOTAL = Meaning(np.dtype(np.uint64), summed, lambda own, total: np.ones(len(own), bool))

ROWS = "unit long, child long, keys binary, vals binary"
_ROWS = pa.schema([("unit", pa.int64()), ("child", pa.int64()), ("keys", pa.binary()), ("vals", pa.binary())])
REPLIES = "block long, keys binary, vals binary"
_REPLIES = pa.schema([("block", pa.int64()), ("keys", pa.binary()), ("vals", pa.binary())])


_CODEC = "lz4_raw"
_SIZE = np.dtype("<u4")


def value_bytes(values: np.ndarray) -> bytes:
    """Their number, and compressed all first bytes, all second bytes and so on: of small numbers the high bytes
    are alike."""
    planes = np.ascontiguousarray(values).view(np.uint8).reshape(len(values), values.dtype.itemsize).T
    return np.array(len(values), _SIZE).tobytes() + pa.compress(planes.tobytes(), codec=_CODEC, asbytes=True)


def values_of(cell: pa.Buffer, value: np.dtype) -> np.ndarray:
    n = int(np.frombuffer(cell, _SIZE, 1)[0])
    raw = pa.decompress(cell.slice(_SIZE.itemsize), n * value.itemsize, _CODEC)
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(value.itemsize, n).T).reshape(-1).view(value)


def key_bytes(keys: np.ndarray) -> bytes:
    """Sorted keys, as steps from one to the next."""
    return value_bytes(np.diff(keys, prepend=np.uint64(0)))


def keys_of(cell: pa.Buffer) -> np.ndarray:
    return np.cumsum(values_of(cell, np.dtype(np.uint64)), dtype=np.uint64)


def _cells(table: pa.Table, value: np.dtype) -> tuple[list[np.ndarray], list[np.ndarray]]:
    return [keys_of(x.as_buffer()) for x in table.column("keys")], [values_of(x.as_buffer(), value) for x in table.column("vals")]


def replied(table: pa.Table, value: np.dtype) -> tuple[np.ndarray, np.ndarray]:
    """All of a block's replies: keys in order, and their values."""
    keys, values = _cells(table, value)
    keys, values = np.concatenate([np.zeros(0, np.uint64), *keys]), np.concatenate([np.zeros(0, value), *values])
    order = np.argsort(keys)
    return keys[order], values[order]


@dataclass(frozen=True)
class Exchange:
    fan: int
    depth: int
    meaning: Meaning

    @staticmethod
    def over(blocks: Blocks, meaning: Meaning) -> Exchange:
        return Exchange(blocks.fan, blocks.depth, meaning)

    def _rows(self, level: int, prefix: int, child: int, keys: np.ndarray, values: np.ndarray) -> list[dict]:
        """A sender's distinct sorted keys, cut by the key's first ``level`` + 1 digits; prefix: the digits of
        the block's number that are left."""
        part = ((keys >> np.uint64(32)) * np.uint64(self.fan**self.depth) >> np.uint64(32)) // np.uint64(self.fan ** (self.depth - 1 - level))
        at = runs(part)
        base, out = prefix * self.fan ** (level + 1), []
        for a, b in zip(at, np.append(at[1:], len(keys))):
            out.append({"unit": base + int(part[a]), "child": child, "keys": key_bytes(keys[a:b]), "vals": value_bytes(values[a:b])})
        return out

    def sent(self, block: int, keys: np.ndarray, values: np.ndarray) -> pa.Table:
        """A block's rows for the first round, of keys and values in any order."""
        keys, values = self.meaning.combine(keys, values)
        place = int(mix(np.array([block], np.uint64))[0] % np.uint64(self.fan**self.depth))
        return pa.Table.from_pylist(self._rows(0, place // self.fan, block, keys, values), schema=_ROWS)

    def _combined(self, table: pa.Table) -> tuple[list, list, np.ndarray, np.ndarray]:
        keys, values = _cells(table, self.meaning.value)
        return keys, values, *self.meaning.combine(np.concatenate(keys), np.concatenate(values))

    def _up(self, level: int) -> Callable[[pa.Table], pa.Table]:
        def up(table: pa.Table) -> pa.Table:
            *_, known, total = self._combined(table)
            unit = table.column("unit")[0].as_py()
            return pa.Table.from_pylist(self._rows(level, unit // self.fan**level // self.fan, unit, known, total), schema=_ROWS)

        return up

    def _answers(self, table: pa.Table, keys: list, values: list, known: np.ndarray, total: np.ndarray) -> pa.Table:
        out_keys, out_values = [], []
        for key, own in zip(keys, values):
            best = total[np.searchsorted(known, key)]
            tell = self.meaning.told(own, best)
            out_keys.append(key_bytes(key[tell]))
            out_values.append(value_bytes(best[tell]))
        return pa.table([table.column("child"), pa.array(out_keys, pa.binary()), pa.array(out_values, pa.binary())], schema=_REPLIES)

    def _top(self, digest: Callable[[np.ndarray, np.ndarray], tuple[bytes, bytes]] | None) -> Callable[[pa.Table], pa.Table]:
        def top(table: pa.Table) -> pa.Table:
            keys, values, known, total = self._combined(table)
            answers = self._answers(table, keys, values, known, total)
            if digest is None:
                return answers
            a, b = digest(known, total)
            return pa.concat_tables([answers, pa.table([pa.array([None], pa.int64()), pa.array([a], pa.binary()), pa.array([b], pa.binary())], schema=_REPLIES)])

        return top

    def _down(self) -> Callable[[pa.Table, pa.Table], pa.Table]:
        def down(table: pa.Table, above: pa.Table) -> pa.Table:
            keys, values, known, total = self._combined(table)
            told, best = replied(above, self.meaning.value)
            total = total.copy()
            total[np.searchsorted(known, told)] = best
            return self._answers(table, keys, values, known, total)

        return down

    def replies(self, sent: DataFrame, digest: Callable[[np.ndarray, np.ndarray], tuple[bytes, bytes]] | None = None) -> DataFrame:
        """(block, keys, vals) for each block that sent; with ``digest``, also rows without a block: what it makes
        of the sorted distinct keys and combined values of each range of the key space."""
        levels = [sent]
        for i in range(1, self.depth):
            levels.append(levels[-1].groupBy("unit").applyInArrow(self._up(i), ROWS))
        back = levels[-1].groupBy("unit").applyInArrow(self._top(digest), REPLIES)
        digests = back.filter("block IS NULL") if digest and self.depth > 1 else None
        for i in range(self.depth - 2, -1, -1):
            back = levels[i].groupBy("unit").cogroup(back.filter("block IS NOT NULL").groupBy(F.col("block").alias("unit"))).applyInArrow(self._down(), REPLIES)
        return back if digests is None else back.unionByName(digests)


class Frequencies:
    """A block's lookup of the totals that a FREQUENCY exchange told it; 1 for any other key."""

    def __init__(self, replies: pa.Table):
        known, total = replied(replies, FREQUENCY.value)
        self.known, self.total = np.append(known, np.uint64(2**64 - 1)), np.append(total, np.uint32(1))

    def of(self, keys: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.known, keys)
        return np.where(self.known[at] == keys, self.total[at], 1)
