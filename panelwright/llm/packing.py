"""Cost-balanced packing of documents into fixed-length sequences.

The cost of a piece of n tokens is ``linear * n + quadratic * n**2``: the parts of a
transformer step that grow with the length and with its square. Pieces are assigned in
descending order, each to the sequence of lowest cost with room for it.

A document of a sequence's length or more gives full sequences of its own first. The
remainders of a block of documents are packed together, into as many sequences as
their tokens fill. A piece that fits nowhere whole is cut at the room that is left; so
all sequences of a block are full but the last, and the tokens of that one are put
into sequences whose lengths are powers of two, which are not padded.

Blocks are the documents of one task in the order read, at most ``block_tokens`` of
remainders. Nothing is shuffled, a block's memory is bounded, and a lost task is simply
run again with the same result.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelwright.llm.tokens import encoder, text_slices

_PIECE = pa.schema([(n, pa.int64()) for n in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")])


class Sequences:
    """Open sequences of one block: the lowest cost with enough room comes first."""

    def __init__(self, rooms: list[int], linear: float, quadratic: float):
        self.room = np.array(rooms, dtype=np.int64)
        self.cost = np.zeros(len(rooms))
        self.linear, self.quadratic = linear, quadratic
        self.filled = np.zeros(len(rooms), dtype=np.int64)

    def place(self, length: int) -> tuple[int, int, int]:
        """(sequence, offset, tokens placed): all of them where they fit, else what the roomiest sequence takes."""
        fits = self.room >= length
        if fits.any():
            k = int(np.argmin(np.where(fits, self.cost, np.inf)))
            take = length
        else:
            k = int(np.argmax(self.room))
            take = int(self.room[k])
        offset = int(self.filled[k])
        self.room[k] -= take
        self.filled[k] += take
        self.cost[k] += self.linear * take + self.quadratic * take * take
        return k, offset, take


def pack_lengths(lengths: list[int], capacity: int, linear: float, quadratic: float) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """([(piece, start in it, tokens, sequence, offset)], number of sequences) of one block's remainders."""
    total = sum(lengths)
    rooms = [capacity] * (total // capacity)
    rest = total % capacity
    rooms += [1 << k for k in range(rest.bit_length() - 1, -1, -1) if rest >> k & 1]
    if not rooms:
        return [], 0
    sequences = Sequences(rooms, linear, quadratic)
    queue = [(-n, i, 0) for i, n in enumerate(lengths) if n]
    heapq.heapify(queue)
    out = []
    while queue:
        n, i, start = heapq.heappop(queue)
        k, offset, take = sequences.place(-n)
        out.append((i, start, take, k, offset))
        if take < -n:
            heapq.heappush(queue, (n + take, i, start + take))
    return out, len(rooms)


def _pieces(path: str, end_id: int, capacity: int, linear: float, quadratic: float, block_tokens: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        sequence = (task.partitionId() if task else 0) << 40
        rest: list[tuple[int | None, np.ndarray, int, int]] = []  # doc_id, ids, start, doc_tokens
        held = 0
        done: list[tuple] = []

        def crc(ids: np.ndarray) -> int:
            return zlib.crc32(ids.astype("<u4").tobytes())

        def flush():
            nonlocal sequence, held
            placed, used = pack_lengths([len(x[1]) for x in rest], capacity, linear, quadratic)
            for i, start, take, k, offset in placed:
                doc, ids, before, total = rest[i]
                done.append((doc, before + start, take, crc(ids[start : start + take]), total, sequence + k, offset))
            sequence += used
            rest.clear()
            held = 0

        def batch_of(found: list[tuple]) -> pa.RecordBatch:
            columns = zip(*found, strict=True) if found else [[]] * len(_PIECE)
            return pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in columns], schema=_PIECE)

        encode = encoder(path).encode
        for batch in batches:
            docs, texts = batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()
            for a, b in text_slices(texts):
                for doc, ids in zip(docs[a:b], encode(texts[a:b]), strict=True):
                    ids = np.append(ids, np.int32(end_id))
                    whole = len(ids) // capacity * capacity
                    for start in range(0, whole, capacity):
                        done.append((doc, start, capacity, crc(ids[start : start + capacity]), len(ids), sequence, 0))
                        sequence += 1
                    if len(ids) > whole:
                        rest.append((doc, ids[whole:], whole, len(ids)))
                        held += len(ids) - whole
                    if held >= block_tokens:
                        flush()
                if len(done) >= 4096:
                    yield batch_of(done)
                    done = []
            del batch, docs, texts
        flush()
        yield batch_of(done)
        done.clear()
        encoder(path).rest()

    return rows


def pack(docs: DataFrame, path: str, end_id: int = 1, capacity: int = 2048, linear: float = 1.0, quadratic: float = 1 / 2048, block_tokens: int = 4_000_000) -> DataFrame:
    """Pack all documents into sequences of at most ``capacity`` tokens.

    docs needs ``doc_id`` and ``text``; ``path`` is a tokenizer file that every executor
    can read. A document is its ids and then ``end_id``. Returns one row a piece: doc_id,
    start (the document's ids before it), length, ids_crc32 (of the ids as little-endian
    unsigned 32-bit), doc_tokens, sequence_id and offset (place in the sequence, gapless
    from 0). A sequence is padded to ``capacity`` unless its length is a power of two.

    A null or empty text is the end id alone. Rows of null or equal doc_id are packed as
    documents of their own. Of sequences of equal cost the earlier one takes a piece, of
    equal pieces the one read first. Other columns play no part. An empty table gives an
    empty one.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    schema = ", ".join(f"{n} long" for n in _PIECE.names)
    return rows.mapInArrow(_pieces(path, end_id, capacity, linear, quadratic, block_tokens), schema)
