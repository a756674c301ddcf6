"""Encoding the whole corpus: every distinct word of the corpus is encoded once, however often it occurs.

1. Documents are taken in blocks of some millions of characters. Each text is split into pre-tokens; a block becomes one row: its
   distinct words and, per document, the positions as indexes into them (byte planes, compressed). The blocks are written once to the
   shared folder, as what is in a block follows from the order in which rows come: a task that is run again after a loss must find the
   same blocks that the ids were made for.
2. The words of all blocks are exploded, shuffled and sorted by word; each distinct word is encoded once, where its run of
   (block, index) entries begins, and its ids are joined to the entries of the run. A word has one entry per block, not per occurrence, so a frequent word isn't a hot key.
3. The blocks are shuffled, the ids meet them again, and each document's ids are put together by position.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoweave.llm import vocab
from chronoweave.session import written

BLOCK_CHARS = 4_000_000
_CHUNK_CHARS = 1_000_000
_BLOCK = pa.schema([("block", pa.int64()), ("docs", pa.list_(pa.int64())), ("counts", pa.list_(pa.int32())), ("low", pa.binary()), ("high", pa.binary()), ("words", pa.list_(pa.string()))])
_BLOCK_DDL = "block long, docs array<long>, counts array<int>, low binary, high binary, words array<string>"


def _pack(at: np.ndarray) -> tuple[bytes, bytes]:
    """Indexes as their lowest bytes and the rest, each compressed by itself."""
    import zstandard

    z = zstandard.ZstdCompressor(level=3)
    at = at.astype("<u4")
    return z.compress((at & 255).astype("u1").tobytes()), z.compress((at >> 8).astype("<u2" if not len(at) or at.max() < 1 << 24 else "<u4").tobytes())


def _unpack(low: bytes, high: bytes, n: int) -> np.ndarray:
    import zstandard

    z = zstandard.ZstdDecompressor()
    rest = z.decompress(high)
    rest = np.frombuffer(rest, "<u2" if len(rest) == 2 * n else "<u4")
    return np.frombuffer(z.decompress(low), "u1").astype("<u4") | (rest.astype("<u4") << 8)


class _Block:
    def __init__(self) -> None:
        self.docs, self.counts, self.words, self.parts, self.waiting, self.chars = [], [], [], [], 0, 0

    def add(self, doc: int, found: list[str], chars: int) -> None:
        self.docs.append(doc)
        self.counts.append(len(found))
        self.words += found
        self.chars += chars
        self.waiting += chars
        if self.waiting >= _CHUNK_CHARS:
            self.settle()

    def settle(self) -> None:
        """Words as one Arrow array, so that no text object stays behind for each occurrence."""
        self.parts.append(pa.array(self.words, pa.large_string()).dictionary_encode())
        self.words, self.waiting = [], 0

    def row(self, block: int) -> pa.RecordBatch:
        self.settle()
        whole = pa.chunked_array(self.parts).unify_dictionaries()
        words = whole.chunk(0).dictionary
        at = np.concatenate([c.indices.to_numpy() for c in whole.chunks])
        often = pa.array(np.bincount(at, minlength=len(words)))
        order = pc.sort_indices(pa.table({"n": often, "w": words}), sort_keys=[("n", "descending"), ("w", "ascending")]).to_numpy()  # frequent words get small indexes, which pack well
        place = np.empty(len(words), np.int64)
        place[order] = np.arange(len(words))
        low, high = _pack(place[at] if len(at) else at)
        words = words.take(pa.array(order)).cast(pa.string())
        return pa.record_batch([pa.array([block]), pa.array([self.docs], _BLOCK.field("docs").type), pa.array([self.counts], _BLOCK.field("counts").type), pa.array([low], pa.binary()), pa.array([high], pa.binary()), pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), words)], schema=_BLOCK)


def _to_blocks(chars: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        split = regex.compile(vocab.PATTERN).findall
        first, n, block = TaskContext.get().partitionId() << 32, 0, _Block()
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                s = text.as_py()
                block.add(doc, split(s) if s else [], len(s or ""))
                if block.chars >= chars:
                    yield block.row(first + n)
                    n, block = n + 1, _Block()
        if block.docs:
            yield block.row(first + n)

    return run


def _to_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for block, words in zip(batch.column("block").to_pylist(), batch.column("words")):
            w = words.values
            yield pa.record_batch([w, pa.array(np.full(len(w), block)), pa.array(np.arange(len(w), dtype=np.int32))], names=["word", "block", "at"])


def _encode(content) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Entries in order of words to entries with ids: a word is encoded when its run of entries begins, and joined to all of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = vocab.encoder(content.value)
        last, last_ids = None, []
        for batch in batches:
            if not batch.num_rows:
                continue
            runs = batch.column("word").dictionary_encode()
            words = runs.dictionary.to_pylist()
            ids = [last_ids if w == last else enc.encode_ordinary(w) for w in words]
            last, last_ids = words[-1], ids[-1]
            yield pa.record_batch([batch.column("block"), batch.column("at"), pa.array(ids, pa.list_(pa.int32())).take(runs.indices)], names=["block", "at", "ids"])

    return run


def _together(blocks: pa.Table, coded: pa.Table) -> pa.Table:
    """One block's documents with their ids: for each position the ids of its word, end to end."""
    docs, counts = blocks["docs"][0].as_py(), np.array(blocks["counts"][0].as_py(), np.int64)
    at = _unpack(blocks["low"][0].as_py(), blocks["high"][0].as_py(), int(counts.sum()))
    coded = coded.sort_by("at").combine_chunks()
    ends = np.zeros(len(docs) + 1, np.int64)
    flat = np.zeros(0, np.int32)
    if len(at):
        ids = coded["ids"].combine_chunks()
        flat_ids, offsets = ids.flatten().to_numpy(), np.concatenate([[0], np.cumsum(pc.list_value_length(ids).to_numpy())])
        size = np.diff(offsets)[at]
        stop = np.cumsum(size)
        flat = flat_ids[np.repeat(offsets[at] - (stop - size), size) + np.arange(stop[-1])]
        ends[1:] = np.concatenate([[0], stop])[np.cumsum(counts)]
    return pa.table({"doc_id": pa.array(docs, pa.int64()), "ids": pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int32()))})


def encode_corpus(docs: DataFrame, path: str | None = None, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """doc_id and ids (array<int>) of each document by a byte-level public vocabulary, without special tokens.

    path names the rank file. The strings of special tokens are ordinary text. Null and empty texts get an empty list; a null
    doc_id stays null and repeated rows come out repeated. Whole texts are encoded, however long. Extra columns are ignored,
    an empty table gives an empty table. block_chars bounds what one task holds besides its longest text.
    """
    spark = docs.sparkSession
    content = spark.sparkContext.broadcast(vocab.vocabulary(path))
    blocks = written(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_to_blocks(block_chars), _BLOCK_DDL), "token-blocks")
    entries = blocks.mapInArrow(_to_words, "word string, block long, at int").repartition("word").sortWithinPartitions("word")
    back = entries.mapInArrow(_encode(content), "block long, at int, ids array<int>")
    return blocks.groupBy("block").cogroup(back.groupBy("block")).applyInArrow(_together, "doc_id long, ids array<int>")


def token_bytes(docs: DataFrame, path: str | None = None) -> DataFrame:
    """The token-byte table of a vocabulary: id, bytes (as many rows as the vocabulary has, 50,256 here)."""
    rows = sorted((i, bytearray(b)) for b, i in vocab.ranks(vocab.vocabulary(path)).items())
    return docs.sparkSession.createDataFrame(rows, "id int, bytes binary")


def decode_corpus(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id and text of doc_id and ids: each id is looked up in the token-byte table, the bytes put together by position.

    The table is that of the vocabulary, which doesn't grow with the data, so every executor holds it. No ids give an empty text,
    null ids a null text. Bytes that aren't UTF-8 become U+FFFD; an id outside the table raises an error.
    """
    content = encoded.sparkSession.sparkContext.broadcast(vocab.vocabulary(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = vocab.ranks(content.value)
        by_id = pa.array([b for b, _ in sorted(known.items(), key=lambda x: x[1])], pa.binary())
        for batch in batches:
            ids = batch.column(1)
            parts = by_id.take(ids.flatten())
            offsets = np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(ids), 0).to_numpy(zero_copy_only=False))])
            whole = pc.binary_join(pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), parts), b"")
            texts = [None if n else b.decode("utf-8", "replace") for b, n in zip(whole.to_pylist(), ids.is_null().to_pylist())]
            yield pa.record_batch([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select(F.col("doc_id").cast("long"), F.col("ids").cast("array<int>")).mapInArrow(run, "doc_id long, text string")
