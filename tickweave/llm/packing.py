"""Packing token sequences by power-of-two decomposition (operator 6).

A document's token count is written as full sequences plus the powers of two
of its remainder; each piece is a sequence of its own.  Sequences of equal
length form a bucket and are numbered in it, so batches of a bucket need no
padding and no sequence crosses documents.  Map-only: no shuffle.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_LENGTH = 1024
END_ID = 0
#: Chunks that a worker keeps between blocks; beyond that it forgets those that only one block has asked for.  Idle workers hold them beside other stages.
MAX_CACHED = 300_000
#: Bytes of text that are looked up together, and new chunks that are encoded in one call.
BLOCK_BYTES, BLOCK_CHUNKS = 2_000_000, 500
#: Set before a text's first chunk, which follows no blank.
_HEAD = "\0"
#: Pieces of a result batch.
MAX_PIECES = 20_000


def decompose(tokens: np.ndarray, longest: int = MAX_LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """Piece lengths of documents of so many tokens, document by document, and the number of pieces of each.

    As many ``longest`` as fit, then the powers of two of the rest, falling.
    """
    sizes = 1 << np.arange(longest.bit_length() - 1, -1, -1)
    times = (tokens[:, None] & sizes > 0).astype(np.int64)
    times[:, 0] = tokens // longest
    return np.repeat(np.tile(sizes, len(tokens)), times.ravel()), times.sum(axis=1)


class _Numbered(dict):
    """Chunks by the order in which they were first asked for; new ones are listed until they are encoded."""

    def __init__(self):
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, chunk: str) -> int:
        self[chunk] = number = len(self)
        self.new.append(chunk)
        return number


class CachedTokenizer:
    """Ids of whole texts, with the ids of blank-separated chunks kept between texts.

    The byte-level pre-tokenizer never joins characters across a blank that a
    non-blank follows, so a text's ids are those of its chunks, each with its
    leading blank.  Texts with a blank before white space or at their end, or
    with the mark of a first chunk, are encoded in one call.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        # byte-level: each character of a vocabulary entry stands for one byte, but for added tokens, which are plain text
        self.n_bytes = np.zeros(self.tokenizer.get_vocab_size(), np.int64)
        for token, i in self.tokenizer.get_vocab().items():
            self.n_bytes[i] = len(token)
        for i, added in self.tokenizer.get_added_tokens_decoder().items():
            self.n_bytes[i] = len(added.content.encode())
        self._clear()

    def _clear(self) -> None:
        self.known = _Numbered()
        self.lengths, self.starts, self.whole = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64), np.zeros(1 << 16, bool)
        self.uses = np.zeros(1 << 16, np.int64)
        self.flat, self.used = np.zeros(1 << 18, np.uint32), 0

    def _grow(self) -> None:
        while len(self.known) > len(self.lengths):
            self.lengths, self.starts, self.whole, self.uses = (np.concatenate((x, np.zeros_like(x))) for x in (self.lengths, self.starts, self.whole, self.uses))

    def _forget(self) -> None:
        """Keep chunks that more than one block has asked for, at most half of MAX_CACHED, the most asked for."""
        keep = np.flatnonzero(self.uses[: len(self.known)] > 1)
        if len(keep) > MAX_CACHED // 2:
            keep = np.sort(keep[np.argsort(-self.uses[keep], kind="stable")[: MAX_CACHED // 2]])
        mask = np.zeros(len(self.known), bool)
        mask[keep] = True
        chunks = list(compress(self.known, mask.tolist()))  # in the order of their numbers
        lengths, whole, uses = self.lengths[keep], self.whole[keep], self.uses[keep]
        ids = self._flat(self.starts[keep], lengths)
        self._clear()
        self.known.update(zip(chunks, range(len(chunks)), strict=True))
        self._grow()
        numbers = np.arange(len(chunks))
        self.whole[numbers], self.uses[numbers] = whole, (uses + 1) // 2
        self._add(numbers, lengths, ids)

    def _flat(self, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """The ids of chunks, one after the other."""
        ends = np.cumsum(lengths)
        return self.flat[np.arange(lengths.sum()) + np.repeat(starts - ends + lengths, lengths)]

    def _add(self, numbers: np.ndarray, lengths: np.ndarray, ids: np.ndarray) -> None:
        """Note ids of numbered chunks; arrays double when full, so each id is copied a bounded number of times."""
        while self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate((self.flat, np.zeros_like(self.flat)))
        self.lengths[numbers] = lengths
        self.starts[numbers] = self.used + np.cumsum(lengths) - lengths
        self.flat[self.used : self.used + len(ids)] = ids
        self.used += len(ids)

    def _learn(self) -> None:
        """Encode the new chunks, many that follow a blank in one text, parted again by their bytes."""
        new, self.known.new = self.known.new, []
        first = len(self.known) - len(new)
        self._grow()
        plain, apart = [], []
        for i, c in enumerate(new, first):
            if c[:1] == _HEAD or c[-1:].isspace():
                apart.append(i)
                self.whole[i] = c[0].isspace()
            elif not c or c[0].isspace():
                self.whole[i] = True
            else:
                plain.append(i)
        groups = [plain[a : a + BLOCK_CHUNKS] for a in range(0, len(plain), BLOCK_CHUNKS)]
        for numbers, ids in zip(groups, self._encode([" " + " ".join([new[i - first] for i in g]) for g in groups]), strict=True):
            ids = np.array(ids, np.uint32)
            ends = np.cumsum([1 + len(new[i - first].encode()) for i in numbers])
            upto = np.searchsorted(np.cumsum(self.n_bytes[ids]), ends) + 1
            self._add(np.array(numbers), np.diff(upto, prepend=0), ids)
        for i, ids in zip(apart, self._encode([c[1:] if c[:1] == _HEAD else " " + c for c in (new[i - first] for i in apart)]), strict=True):
            self._add(np.array([i]), np.array([len(ids)]), np.array(ids, np.uint32))

    def _encode(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def ids(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other and the number of each text's; null is empty."""
        if len(self.known) > MAX_CACHED:
            self._forget()
        if not len(texts):
            return np.empty(0, np.uint32), np.empty(0, np.int64)
        texts = pc.fill_null(texts, "")
        split = pc.split_pattern(pc.binary_join_element_wise(_HEAD, texts, ""), " ")
        chunks = split.flatten().dictionary_encode()
        numbers = np.fromiter(map(self.known.__getitem__, chunks.dictionary.to_numpy(zero_copy_only=False).tolist()), np.int64, len(chunks.dictionary))
        if self.known.new:
            self._learn()
        self.uses[numbers] += 1
        which = numbers[chunks.indices.to_numpy()]
        begin = np.concatenate(([0], np.cumsum(pc.list_value_length(split).to_numpy())))[:-1]
        n = self.lengths[which]
        found = self._flat(self.starts[which], n)
        lengths = np.add.reduceat(n, begin)
        whole = np.logical_or.reduceat(self.whole[which], begin) | pc.match_substring(texts, _HEAD).to_numpy(zero_copy_only=False)
        if whole.any():
            each, again = np.split(found, np.cumsum(lengths)[:-1]), np.flatnonzero(whole)
            for i, ids in zip(again, self._encode(texts.take(pa.array(again)).to_pylist()), strict=True):
                each[i], lengths[i] = np.array(ids, np.uint32), len(ids)
            found = np.concatenate(each)
        return found, lengths


_tokenizers: dict[str, CachedTokenizer] = {}


def _tokenizer(path: str) -> CachedTokenizer:
    """One for each Python worker, kept between its tasks."""
    if path not in _tokenizers:
        _tokenizers[path] = CachedTokenizer(path)
    return _tokenizers[path]


def pack(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", longest: int = MAX_LENGTH, end_id: int = END_ID) -> DataFrame:
    """One row per piece: doc_id, start, length, ids (little-endian uint32 bytes), doc_tokens, sequence_id, offset, bucket, bucket_sequence.

    bucket is the length that a sequence shares with all others of its bucket,
    bucket_sequence its number there (unique, with gaps between tasks).

    Null text is empty and gives one piece that holds the end id alone.  Whole
    texts are encoded whatever their length.  Repeated rows are packed once
    each, in sequences of their own.  An empty table gives no rows; other
    columns are ignored.  longest is a power of two.
    """
    assert longest > 0 and longest & (longest - 1) == 0

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = _tokenizer(tokenizer_path)
        seen = np.full(longest.bit_length(), TaskContext.get().partitionId() << 33, np.int64)
        for batch in batches:
            doc_ids, texts = batch.column(0), batch.column(1)
            block = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy().astype(np.int64)) // BLOCK_BYTES
            bounds = [0, *(np.flatnonzero(np.diff(block)) + 1), len(texts)]
            for a, b in zip(bounds[:-1], bounds[1:], strict=True):
                ids, counts = tokenizer.ids(texts.slice(a, b - a))
                data = np.full(len(ids) + b - a, end_id, "<u4")
                data[np.arange(len(ids)) + np.repeat(np.arange(b - a), counts)] = ids
                lengths, n_pieces = decompose(counts + 1, longest)
                ends = np.cumsum(lengths)
                owner = np.repeat(np.arange(b - a), n_pieces)
                numbers, bucket = np.empty(len(lengths), np.int64), np.log2(lengths).astype(np.int64)
                for x in np.unique(bucket):
                    own = np.flatnonzero(bucket == x)
                    numbers[own] = seen[x] + np.arange(len(own))
                    seen[x] += len(own)
                start = ends - lengths - (np.cumsum(counts + 1) - counts - 1)[owner]
                for c in range(0, len(lengths), MAX_PIECES):
                    part = slice(c, c + MAX_PIECES)
                    begin = int(ends[c] - lengths[c])
                    offsets = np.concatenate(([0], (ends[part] - begin) * 4)).astype(np.int32)
                    pieces = pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(data[begin : ends[part][-1]])])
                    columns = [doc_ids.slice(a, b - a).take(pa.array(owner[part])), pa.array(start[part]), pa.array(lengths[part]), pieces, pa.array((counts + 1)[owner[part]]), pa.array(numbers[part])]
                    yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "start", "length", "ids", "doc_tokens", "bucket_sequence"])
        pa.default_memory_pool().release_unused()  # the worker stays, idle beside other stages

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    pieces = rows.mapInArrow(packed, "doc_id long, start long, length long, ids binary, doc_tokens long, bucket_sequence long")
    # one sequence for each piece: numbers are unique in the job, and a task that runs again gives the same ones
    pieces = pieces.withColumn("sequence_id", F.monotonically_increasing_id()).withColumn("offset", F.lit(0).cast("long"))
    return pieces.select("doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset", F.col("length").cast("int").alias("bucket"), "bucket_sequence")


def write_buckets(pieces: DataFrame, path: str) -> None:
    """A folder for each length: what is read from one is a matrix of token ids without padding."""
    pieces.write.partitionBy("bucket").parquet(path)
