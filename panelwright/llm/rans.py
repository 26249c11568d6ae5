"""Token ids in files, coded by a static range asymmetric numeral system.

The ids of the whole table are counted first, and one frequency table, scaled to a
power of two, is shared by all blocks. A block holds whole documents and is coded on
its own by ``LANES`` interleaved coders: id i belongs to coder i % LANES. Each coder is
a 64-bit state that gives off 32-bit words; all coders of a block share one stream of
words, so encoding and decoding are vector steps over the coders.

A block row of the file is self-contained with the table: the final states are its
checkpoint, its documents' ids and lengths are its index, and a CRC-32 of its ids is
its checksum. Any block can be decoded alone, so readers work on blocks in parallel.
The container is Parquet, written by Spark: files appear only when a task commits, and
a lost executor leaves nothing half done. Rows come in ascending order of doc_id.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelwright.llm.shared import release, shared_folder
from panelwright.llm.tokens import encoder, text_slices

U64 = np.uint64
LANES = 1024
BLOCK_IDS = 1 << 18
_LOW = U64(1) << U64(31)
_WORD = U64(32)
_MASK = U64(0xFFFFFFFF)


class FrequencyTable:
    """Counts scaled to sum to 2**bits, every counted id at least 1."""

    def __init__(self, ids: np.ndarray, counts: np.ndarray):
        order = np.argsort(ids)
        self.ids, counts = ids[order].astype(np.int64), counts[order].astype(np.float64)
        self.bits = max(16, int(2 * max(1, len(ids))).bit_length() + 3)
        total = 1 << self.bits
        if len(ids):
            scaled = np.maximum(1, np.floor(counts / counts.sum() * (total - len(ids)))).astype(np.int64)
            scaled[int(np.argmax(scaled))] += total - int(scaled.sum())
        else:
            scaled = np.zeros(0, dtype=np.int64)
        self._scaled(scaled)

    def _scaled(self, scaled: np.ndarray) -> None:
        self.freq = scaled.astype(U64)
        self.start = (np.cumsum(scaled) - scaled).astype(U64)
        self.slot = np.repeat(np.arange(len(scaled)), scaled)
        self.place = np.zeros(int(self.ids[-1]) + 1 if len(self.ids) else 0, dtype=np.int64)
        self.place[self.ids] = np.arange(len(self.ids))

    def rank(self, ids: np.ndarray) -> np.ndarray:
        """Where counted ids lie in the table: read off, as a search of each id costs more than its coding."""
        return self.place[ids]

    def rows(self) -> list[tuple[int, int, int]]:
        return [(int(i), int(f), self.bits) for i, f in zip(self.ids, self.freq, strict=True)]

    @classmethod
    def of_rows(cls, rows) -> FrequencyTable:
        """The table as it was written: scaled frequencies stay as they are."""
        table = cls(np.zeros(0, np.int64), np.zeros(0))
        rows = sorted(rows)
        if rows:
            table.bits = rows[0][2]
            table.ids = np.array([r[0] for r in rows], dtype=np.int64)
            table._scaled(np.array([r[1] for r in rows], dtype=np.int64))
        return table


def encode_block(ids: np.ndarray, table: FrequencyTable) -> tuple[bytes, bytes]:
    """(states, words) of one block."""
    bits = U64(table.bits)
    rank = table.rank(ids)
    freq, start = table.freq[rank], table.start[rank]
    limit = (_LOW >> bits) << _WORD
    state = np.full(LANES, _LOW, dtype=U64)
    out: list[np.ndarray] = []
    steps = -(-len(ids) // LANES)
    for t in range(steps - 1, -1, -1):
        a, b = t * LANES, min((t + 1) * LANES, len(ids))
        f, x = freq[a:b], state[: b - a]
        over = x >= limit * f
        if over.any():
            out.append((x[over] & _MASK).astype("<u4"))
            x = np.where(over, x >> _WORD, x)
        q = x // f
        state[: b - a] = (q << bits) + (x - q * f) + start[a:b]
    words = np.concatenate(out[::-1]) if out else np.zeros(0, "<u4")
    return state.astype("<u8").tobytes(), words.tobytes()


def decode_block(n: int, states: bytes, words: bytes, table: FrequencyTable) -> np.ndarray:
    """The n ids of one block."""
    bits = U64(table.bits)
    mask = (U64(1) << bits) - U64(1)
    state = np.frombuffer(states, "<u8").astype(U64)
    stream = np.frombuffer(words, "<u4").astype(U64)
    out = np.empty(n, dtype=np.int64)
    at = 0
    for a in range(0, n, LANES):
        b = min(a + LANES, n)
        x = state[: b - a]
        low = x & mask
        rank = table.slot[low.astype(np.int64)]
        out[a:b] = rank
        x = table.freq[rank] * (x >> bits) + low - table.start[rank]
        under = np.flatnonzero(x < _LOW)
        if len(under):
            x[under] = (x[under] << _WORD) | stream[at : at + len(under)]
            at += len(under)
        state[: b - a] = x
    if at != len(stream):
        raise ValueError("a block's words do not end with its ids")
    return table.ids[out]


def _ids_of_texts(path: str, end_id: int, kind: str):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path).encode
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for a, b in text_slices(texts):
                raw = [np.append(x, np.int32(end_id)).astype(kind).tobytes() for x in encode(texts[a:b])]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), pa.array(raw, pa.binary())], names=["doc_id", "ids"])
            del batch, texts
        encoder(path).rest()

    return rows


def _counts(kind: str):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The task's ids and how often each came: as many rows as the vocabulary has, at most."""
        total = np.zeros(1 << 16, dtype=np.int64)
        for batch in batches:
            column = batch.column("ids")
            if not len(column):
                continue
            _, offsets, values = column.buffers()
            at = np.frombuffer(offsets, np.int32)[column.offset : column.offset + len(column) + 1]
            found = np.frombuffer(values, np.uint8)[at[0] : at[-1]].view(kind)
            seen = np.bincount(found, minlength=len(total))
            if len(seen) > len(total):
                total = np.concatenate([total, np.zeros(len(seen) - len(total), dtype=np.int64)])
            total += seen
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], names=["id", "n"])

    return rows


_BLOCK = pa.schema(
    [("part", pa.int32()), ("before", pa.int64()), ("n_ids", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("doc_lengths", pa.list_(pa.int64())), ("crc32", pa.int64()), ("states", pa.binary()), ("words", pa.binary())]
)
_BLOCK_DDL = "part int, before long, n_ids long, doc_ids array<long>, doc_lengths array<long>, crc32 long, states binary, words binary"


def _encode(shared, kind: str):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = FrequencyTable.of_rows(shared.value)
        docs: list[int | None] = []
        parts: list[np.ndarray] = []
        held = before = 0
        part = None

        def block() -> pa.RecordBatch:
            nonlocal held, before
            ids = np.concatenate(parts)
            states, words = encode_block(ids, table)
            row = [[part], [before], [len(ids)], [list(docs)], [[len(x) for x in parts]], [zlib.crc32(ids.astype("<u4").tobytes())], [states], [words]]
            before += len(ids)
            docs.clear()
            parts.clear()
            held = 0
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(row, _BLOCK, strict=True)], schema=_BLOCK)

        for batch in batches:
            for p, doc, x in zip(batch.column("part").to_pylist(), batch.column("doc_id").to_pylist(), batch.column("ids"), strict=True):
                if p != part:  # a task can read more than one part, one after another
                    if docs:
                        yield block()
                    part, before = p, 0
                docs.append(doc)
                parts.append(np.frombuffer(x.as_buffer(), kind).astype(np.int64))
                held += len(parts[-1])
                if held >= BLOCK_IDS:
                    yield block()
        if docs:
            yield block()

    return rows


def _decode(shared):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, offsets = None, shared.value[1]
        for batch in batches:
            for r in batch.to_pylist():
                table = table or FrequencyTable.of_rows(shared.value[0])
                ids = decode_block(r["n_ids"], r["states"], r["words"], table)
                raw = ids.astype("<u4")
                if zlib.crc32(raw.tobytes()) != r["crc32"]:
                    raise ValueError(f"checksum of block {r['part']}, {r['before']} differs")
                lengths = np.array(r["doc_lengths"], dtype=np.int64)
                at = np.r_[0, np.cumsum(lengths)]
                own = [raw[a:b].tobytes() for a, b in zip(at[:-1], at[1:], strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(r["doc_ids"], pa.int64()), pa.array(at[:-1] + r["before"] + offsets[r["part"]]), pa.array(lengths), pa.array(own, pa.binary())], names=["doc_id", "start", "n_tokens", "ids"]
                )

    return rows


def write_token_files(docs: DataFrame, path: str, out: str, end_id: int = 2) -> None:
    """Write the ids of all documents, in ascending order of doc_id, to the folder ``out``.

    docs needs ``doc_id`` and ``text``; ``path`` is a tokenizer file that every executor
    can read. A document is its ids and then ``end_id``. Null doc_ids come first, equal
    ones in the order of their ids' bytes. A null or empty text is the end id alone. An empty
    table gives files without blocks.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    kind = _id_type(path)
    rows.mapInArrow(_ids_of_texts(path, end_id, kind), "doc_id long, ids binary").write.option("compression", "zstd").parquet(f"{out}/ids")
    ids = spark.read.schema("doc_id long, ids binary").parquet(f"{out}/ids")
    found = ids.select("ids").mapInArrow(_counts(kind), "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()  # as many rows as the vocabulary has ids
    table = FrequencyTable(np.array([r.id for r in found], dtype=np.int64), np.array([r.n for r in found], dtype=np.int64))
    spark.createDataFrame(table.rows(), "id long, freq long, bits int").coalesce(1).write.parquet(f"{out}/table")
    shared = spark.sparkContext.broadcast(table.rows())
    ordered = ids.repartitionByRange(_parts(spark), "doc_id").sortWithinPartitions("doc_id", "ids").withColumn("part", F.spark_partition_id())
    ordered.mapInArrow(_encode(shared, kind), _BLOCK_DDL).write.option("compression", "uncompressed").parquet(f"{out}/blocks")
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{out}/ids")
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
    release(docs)


def _id_type(path: str) -> str:
    """Two bytes an id where the vocabulary fits, else four."""
    from tokenizers import Tokenizer

    return "<u2" if Tokenizer.from_file(path).get_vocab_size(with_added_tokens=True) <= 1 << 16 else "<u4"


def _parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def read_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids): documents of a folder of write_token_files, with the ids of all before them.

    Every block is decoded alone and its checksum compared. What the driver gathers is
    the frequency table (the vocabulary bounds it) and one total a part.
    """
    blocks = spark.read.schema(_BLOCK_DDL).parquet(f"{folder}/blocks")
    table = [tuple(r) for r in spark.read.schema("id long, freq long, bits int").parquet(f"{folder}/table").collect()]
    totals = dict(map(tuple, blocks.groupBy("part").agg(F.sum("n_ids")).collect()))
    offsets, before = {}, 0
    for part in sorted(totals):
        offsets[part] = before
        before += totals[part]
    shared = spark.sparkContext.broadcast((table, offsets))
    return blocks.mapInArrow(_decode(shared), "doc_id long, start long, n_tokens long, ids binary")


def token_folder(spark: SparkSession) -> str:
    """A new folder in the place that all executors share."""
    import uuid

    return f"{shared_folder(spark)}/tokens-{uuid.uuid4().hex}"
