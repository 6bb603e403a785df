"""Alignment of two tokenizers by galloping intersection (operator 12).

Tokens of either tokenizer end at byte offsets.  The shorter list of ends
drives an exponential and then binary search into the longer one; offsets in
both cut the tokens into groups, and the differences of their ranks are the
ranges of tokens that overlap.  Every pair of a group's tokens is a link.

Spark encodes the texts once and writes blocks of aligned documents, each with
its distinct id pairs and how many of its documents hold them.  Counts are
added up over the blocks, joined back to the pairs of each block, and each
block meets its own counts; no table of pairs reaches the driver or a
broadcast.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickweave.llm.common import scratch_path
from tickweave.llm.packing import CachedTokenizer

#: Bytes of text of a block (or one longer text), and chunks of text that a worker keeps for each tokenizer.
BLOCK_BYTES, MAX_CACHED = 1_500_000, 400_000
#: A group with more links than this is counted by its distinct ids.
LARGE_GROUP = 4096
#: Stands for a blank in pieces.
_PIECE_BLANK = "▁"
_COUNTS = ["n_a", "n_b", "n_groups", "n_links"]
_BLOCK = "block long, doc_ids array<long>, has_id array<boolean>, " + ", ".join(f"{c} array<long>" for c in _COUNTS) + ", digests array<string>, sizes array<int>, links binary, pairs array<long>, holders array<long>"
_OUT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def _byte_level() -> dict[str, int]:
    """Byte of each character of a byte-level vocabulary: printable bytes stand for themselves, the others follow from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class ByteTokens(CachedTokenizer):
    """Byte-level BPE; strings of special tokens inside texts are plain text."""

    def __init__(self, path: str):
        super().__init__(path)
        self.tokenizer.encode_special_tokens = True
        byte_of = _byte_level()
        found = {i: bytes(byte_of[c] for c in t) if all(c in byte_of for c in t) else t.encode() for t, i in self.tokenizer.get_vocab().items()}
        self.token_bytes = [found.get(i, b"") for i in range(self.tokenizer.get_vocab_size())]


class PieceTokens(CachedTokenizer):
    """Sentence pieces with byte fallback, given texts with the blank in front that the model adds itself.

    No piece has a blank behind another character, so merges never cross
    chunks and the chunks of a text can be kept as those of a byte-level one.
    """

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        assert not any(re.search(f"[^{_PIECE_BLANK}]{_PIECE_BLANK}", p) for p in pieces)
        self.token_bytes = [bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else p.replace(_PIECE_BLANK, " ").encode() for i, p in enumerate(pieces)]
        self.n_bytes = np.array([len(t) for t in self.token_bytes], np.int64)
        self._clear()

    def _encode(self, texts: list[str]) -> list[list[int]]:
        return self.model.encode([t[1:] for t in texts], num_threads=1) if texts else []


class _Vocabulary:
    """A tokenizer with its token bytes in one array."""

    def __init__(self, tokenizer: CachedTokenizer):
        self.tokenizer = tokenizer
        self.lengths = np.array([len(t) for t in tokenizer.token_bytes], np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.flat = np.frombuffer(b"".join(tokenizer.token_bytes), np.uint8)

    def ids(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        if len(self.tokenizer.known) > MAX_CACHED:
            self.tokenizer._clear()
        found, counts = self.tokenizer.ids(texts)
        return found.astype(np.int64), counts

    def spelled(self, ids: np.ndarray) -> np.ndarray:
        """The joined bytes of tokens."""
        n = self.lengths[ids]
        ends = np.cumsum(n)
        return self.flat[np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.starts[ids] - ends + n, n)]


_vocabularies: dict[tuple[str, str], tuple[_Vocabulary, _Vocabulary]] = {}


def _pair_of(path_a: str, path_b: str) -> tuple[_Vocabulary, _Vocabulary]:
    """Kept by each Python worker between its tasks."""
    if (path_a, path_b) not in _vocabularies:
        _vocabularies[path_a, path_b] = (_Vocabulary(ByteTokens(path_a)), _Vocabulary(PieceTokens(path_b)))
    return _vocabularies[path_a, path_b]


def gallop(short: np.ndarray, long: np.ndarray, guess: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Least position in long[low:high] whose value is not below each of short; every one has such a position.

    From its guess each search moves right or left in steps that double until
    it has passed its value, then halves the bracket.  All searches go on
    together.
    """
    left, right = low - 1, guess.copy()  # long[left] < value <= long[right]
    ahead = np.flatnonzero(long[guess] < short)
    back = np.flatnonzero(long[guess] >= short)
    left[ahead] = guess[ahead]
    step = 1
    while len(ahead):
        right[ahead] = np.minimum(left[ahead] + step, high[ahead] - 1)
        ahead = ahead[long[right[ahead]] < short[ahead]]
        left[ahead] = right[ahead]
        step *= 2
    step = 1
    while len(back):
        at = right[back] - step
        inside = at >= low[back]
        back, at = back[inside], at[inside]
        passed = long[at] < short[back]
        left[back[passed]] = at[passed]
        right[back[~passed]] = at[~passed]
        back = back[~passed]
        step *= 2
    open_ = np.flatnonzero(right - left > 1)
    while len(open_):
        middle = (left[open_] + right[open_]) >> 1
        below = long[middle] < short[open_]
        left[open_[below]] = middle[below]
        right[open_[~below]] = middle[~below]
        open_ = open_[right[open_] - left[open_] > 1]
    return right


def common_ends(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ranks in a and in b of the ends that both have, in order.

    a and b list rising ends of consecutive texts, n_a and n_b of them in each
    text; the last end of a text is in both.  In each text the shorter list drives.
    """
    ranks = []
    for drives, short, long, n_short, n_long in ((n_a <= n_b, a, b, n_a, n_b), (n_a > n_b, b, a, n_b, n_a)):
        texts = np.flatnonzero(drives & (n_short > 0))
        n = n_short[texts]
        own = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        begin_short, begin_long = (np.cumsum(n_short) - n_short)[texts], (np.cumsum(n_long) - n_long)[texts]
        mine = own + np.repeat(begin_short, n)
        low = np.repeat(begin_long, n)
        high = low + np.repeat(n_long[texts], n)
        at = gallop(short[mine], long, low + own * np.repeat(n_long[texts], n) // np.repeat(np.maximum(n, 1), n), low, high)
        same = long[at] == short[mine]
        ranks.append((mine[same], at[same]) if short is a else (at[same], mine[same]))
    in_a, in_b = (np.concatenate(x) for x in zip(*ranks, strict=True))
    order = np.argsort(in_a, kind="stable")
    return in_a[order], in_b[order]


def _grouped_links(a: np.ndarray, b: np.ndarray, ends_a: np.ndarray, ends_b: np.ndarray, text_of: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, id pair, times) of all links, each pair once in a text; a pair is a << bits | b."""
    from_a, from_b = np.concatenate(([0], ends_a[:-1])), np.concatenate(([0], ends_b[:-1]))
    n_a, n_b = ends_a - from_a, ends_b - from_b
    n = n_a * n_b
    large = np.flatnonzero(n > LARGE_GROUP)
    small = np.where(n > LARGE_GROUP, 0, n)
    own = np.arange(small.sum()) - np.repeat(np.cumsum(small) - small, small)
    wide = np.repeat(np.maximum(n_b, 1), small)
    keys = [a[np.repeat(from_a, small) + own // wide] << bits | b[np.repeat(from_b, small) + own % wide]]
    texts, times = [np.repeat(text_of, small)], [np.ones(len(own), np.int64)]
    for g in large.tolist():
        (x, nx), (y, ny) = (np.unique(ids[f:e], return_counts=True) for ids, f, e in ((a, from_a[g], ends_a[g]), (b, from_b[g], ends_b[g])))
        keys.append((x[:, None] << bits | y[None, :]).ravel())
        times.append(np.outer(nx, ny).ravel())
        texts.append(np.full(len(x) * len(y), text_of[g]))
    key, text, many = (np.concatenate(x) for x in (keys, texts, times))
    order = np.lexsort((key, text)) if len(large) else np.argsort(text << 40 | key, kind="stable")
    key, text, many = key[order], text[order], many[order]
    first = np.flatnonzero(np.concatenate(([True], (key[1:] != key[:-1]) | (text[1:] != text[:-1])))) if len(key) else np.empty(0, np.int64)
    return text[first], key[first], np.add.reduceat(many, first) if len(first) else many


_SIGNS = (b",", b"|", b";")
_spelled: list[bytes] = []


def _decimals(upto: int) -> list[bytes]:
    """Decimal ids, each followed by each separator."""
    _spelled.extend(b"%d%s" % (i, s) for i in range(len(_spelled) // 3, upto) for s in _SIGNS)
    return _spelled


def _aligned(doc_ids: pa.Array, texts: pa.Array, block: int, pair: tuple[_Vocabulary, _Vocabulary]) -> dict:
    """The row of one block."""
    n = len(texts)
    # a piece's blank in a text would be read as a blank: its bytes differ
    usable = pc.and_(pc.fill_null(pc.greater(pc.binary_length(texts), 0), False), pc.invert(pc.fill_null(pc.match_substring(texts, _PIECE_BLANK), False)))
    which = np.flatnonzero(usable.to_numpy(zero_copy_only=False))
    given = pc.binary_join_element_wise(" ", texts.take(pa.array(which)), "")
    sizes = pc.binary_length(given).to_numpy().astype(np.int64)
    encoded = [v.ids(given) for v in pair]
    # texts whose joined bytes differ have no tokens: first by length, then byte by byte
    right = np.ones(len(which), bool)
    for v, (ids, counts) in zip(pair, encoded, strict=True):
        right &= np.bincount(np.repeat(np.arange(len(which)), counts), v.lengths[ids], len(which)).astype(np.int64) == sizes
    for narrowed in (False, True):
        encoded = [(ids[np.repeat(right, counts)], counts[right]) for ids, counts in encoded]
        which, sizes, given = which[right], sizes[right], given.filter(pa.array(right))
        if narrowed:
            break
        raw = np.frombuffer("".join(given.to_pylist()).encode(), np.uint8)
        owner = np.repeat(np.arange(len(which)), sizes)
        right = np.ones(len(which), bool)
        for v, (ids, _) in zip(pair, encoded, strict=True):
            right[owner[v.spelled(ids) != raw]] = False
    (a, n_a), (b, n_b) = encoded
    in_a, in_b = common_ends(np.cumsum(pair[0].lengths[a]), np.cumsum(pair[1].lengths[b]), n_a, n_b)
    ends_a, ends_b = in_a + 1, in_b + 1
    text_of = np.searchsorted(np.cumsum(n_a), ends_a)
    bits = (len(pair[1].lengths) - 1).bit_length()
    text, key, times = _grouped_links(a, b, ends_a, ends_b, text_of, bits)
    pairs, at = np.unique(key, return_inverse=True)
    groups = np.bincount(text_of, minlength=len(which))
    links = np.bincount(text, times, len(which)).astype(np.int64)
    # ids in written order: those of a group's first list, then those of its second
    group_a, group_b = np.searchsorted(ends_a, np.arange(len(a)), side="right"), np.searchsorted(ends_b, np.arange(len(b)), side="right")
    written = np.empty(len(a) + len(b), np.int64)
    written[np.arange(len(a)) + np.concatenate(([0], ends_b))[group_a]] = 3 * a + (np.arange(len(a)) == ends_a[group_a] - 1 if len(a) else 0)
    written[np.arange(len(b)) + ends_a[group_b]] = 3 * b + 2 * (np.arange(len(b)) == ends_b[group_b] - 1 if len(b) else 0)
    names = _decimals(max(len(pair[0].lengths), len(pair[1].lengths)))
    upto = np.cumsum(n_a + n_b)
    digests = [""] * n
    for i, begin, end in zip(which.tolist(), (upto - n_a - n_b).tolist(), upto.tolist(), strict=True):
        digests[i] = hashlib.sha256(b"".join(map(names.__getitem__, written[begin:end].tolist()))[:-1]).hexdigest()

    def spread(x: np.ndarray) -> np.ndarray:
        out = np.zeros(n, np.int64)
        out[which] = x
        return out

    per_text = spread(np.bincount(text, minlength=len(which)))
    step = np.diff(at, prepend=0)  # rising within a text: small steps
    stored = zstandard.compress(step.astype("<i4").tobytes() + times.astype("<i8").tobytes(), 1)
    counts = dict(zip(_COUNTS, map(spread, (n_a, n_b, groups, links)), strict=True))
    return {"block": block, "doc_ids": pc.fill_null(doc_ids, 0), "has_id": pc.is_valid(doc_ids), **counts, "digests": digests, "sizes": per_text.astype(np.int32), "links": stored, "pairs": pairs, "holders": np.bincount(at, minlength=len(pairs))}


def _summed(blocks: pd.DataFrame, counted: pd.DataFrame) -> pd.DataFrame:
    """Rows of one block's documents, from the corpus-wide counts of its pairs."""
    row = blocks.iloc[0]
    n_links = int(np.sum(row["sizes"]))
    data = zstandard.decompress(row["links"])
    at, times = np.cumsum(np.frombuffer(data, "<i4", n_links), dtype=np.int64), np.frombuffer(data, "<i8", n_links, 4 * n_links)
    counted = counted.sort_values("pair")
    n, best = counted["n"].to_numpy(np.int64)[at], counted["best"].to_numpy(bool)[at]
    begins = np.concatenate(([0], np.cumsum(row["sizes"])))
    upto = lambda x: np.diff(np.concatenate(([0], np.cumsum(x)))[begins])
    out = pd.DataFrame({"doc_id": pd.array(row["doc_ids"], "Int64"), **{c: row[c] for c in _COUNTS}})
    out.loc[~np.asarray(row["has_id"], bool), "doc_id"] = pd.NA
    return out.assign(n_best=upto(times * best), count_sum=upto(times * n), groups_sha256=row["digests"])


def align(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per document: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    path_a names a byte-level BPE file (tokenizers), path_b a model of pieces
    with byte fallback (sentencepiece).  Texts that are null or empty, or whose
    joined tokens are not a blank and the text, have no tokens: zeros and an
    empty digest.  Whole texts are aligned whatever their length.  Repeated
    rows count as documents of their own, also without an id.  n_best counts
    ties.  An empty table gives no rows; other columns are ignored.
    """
    spark = docs.sparkSession

    def aligned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, number = _pair_of(path_a, path_b), TaskContext.get().partitionId() << 32
        for batch in batches:
            at = np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy().astype(np.int64)) // block_bytes
            bounds = [0, *(np.flatnonzero(np.diff(at)) + 1).tolist(), len(batch)]
            for a, b in zip(bounds[:-1], bounds[1:], strict=True):
                if b > a:
                    row = _aligned(batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), number, pair)
                    number += 1
                    kinds = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.bool_()), *[pa.list_(pa.int64())] * 4, pa.list_(pa.string()), pa.list_(pa.int32()), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64())]
                    yield pa.RecordBatch.from_arrays([pa.array([v.to_pylist() if isinstance(v, pa.Array) else v], kind) for v, kind in zip(row.values(), kinds, strict=True)], names=list(row))

    path = scratch_path(spark, "alignment")
    docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(aligned, _BLOCK).write.parquet(path)
    blocks = spark.read.parquet(path)
    bits = (len(_pair_of(path_a, path_b)[1].lengths) - 1).bit_length()
    counts = blocks.select(F.explode(F.arrays_zip("pairs", "holders")).alias("x")).groupBy(F.col("x.pairs").alias("pair")).agg(F.sum("x.holders").alias("n"))
    counts.withColumn("a", F.shiftright("pair", bits)).write.parquet(f"{path}-counts")
    counts = spark.read.parquet(f"{path}-counts")
    top = counts.groupBy("a").agg(F.max("n").alias("top"))
    table = counts.join(top, "a").select("pair", "n", (F.col("n") == F.col("top")).alias("best"))
    counted = blocks.select("block", F.explode("pairs").alias("pair")).join(table, "pair")
    own = spark.read.parquet(path).drop("pairs", "holders")
    return own.groupBy("block").cogroup(counted.groupBy("block")).applyInPandas(_summed, _OUT)
