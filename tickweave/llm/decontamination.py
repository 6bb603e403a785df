"""Benchmark decontamination with one Aho-Corasick automaton (operator 13).

Benchmark questions and answers are normalised to lower-case words; every run
of WINDOW consecutive words of an item is a pattern (an item of fewer words is
one pattern).  Documents are normalised the same way and read once by the
automaton of all patterns.  Word positions lead each match back to the
original text, so hits are spans of code points there.

The patterns are collected only after their size has been checked.  Beyond
MAX_BYTES they are dealt to several automata of that size by hash, and the
documents pass through one after the other; what one finds is carried along.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickweave.llm.common import cut

WINDOW = 10
#: Bytes of patterns, with 8 for each item id, of one automaton: about 50 bytes of memory each.
MAX_BYTES = 4_000_000
#: Bytes of text that are read in one go.
BLOCK_BYTES = 4_000_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Upper case to lower case, separators to a blank; digits, letters and all bytes of other characters stay.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_END, _BLANK = 10, 32
_FOUND = "spans array<struct<start:long,stop:long,first_word:long,n_words:long>>, items array<string>"


def words(text: Column) -> Column:
    """Words of a text in order: runs of digits, letters and non-ASCII characters, A-Z lower-cased; null has none."""
    return F.regexp_extract_all(F.translate(F.coalesce(text.cast("string"), F.lit("")), _UPPER, _LOWER), F.lit(_WORD), F.lit(0))


def patterns(items: DataFrame, id_col: str = "item_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """item, pattern: the distinct word windows of every item, words parted by a blank; none of an item without words."""
    rows = items.select(F.col(id_col).cast("string").alias("item"), words(F.col(text_col)).alias("w")).filter(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("w") - (window - 1)))
    return rows.select("item", F.explode(F.transform(starts, lambda i: F.array_join(F.slice("w", i, window), " "))).alias("pattern")).distinct()


class _Automaton:
    """All patterns of a part, and the items that hold each."""

    def __init__(self, rows: list[tuple[str | None, str]]):
        self.items: list[list[str | None]] = []
        self.lengths: list[int] = []
        self.n_words: list[int] = []
        self.machine = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        number: dict[str, int] = {}
        for item, pattern in rows:
            if pattern not in number:
                number[pattern] = len(number)
                # characters of the automaton are bytes
                self.machine.add_word(key := f" {pattern} ".encode().decode("latin-1"), number[pattern])
                self.lengths.append(len(key))
                self.n_words.append(pattern.count(" ") + 1)
                self.items.append([])
            self.items[number[pattern]].append(item)
        if number:
            self.machine.make_automaton()

    def matches(self, hay: str) -> tuple[np.ndarray, np.ndarray]:
        """(position of the first word's first byte, number) of every match."""
        found = list(self.machine.iter(hay)) if self.lengths else []
        if not found:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        ends, numbers = np.array(found, np.int64).T
        return ends + 2 - np.array(self.lengths, np.int64)[numbers], numbers


_kept: dict[str, _Automaton] = {}


def _automaton(key: str, rows) -> _Automaton:
    """The one that a Python worker used last is kept between its tasks."""
    if key not in _kept:
        _kept.clear()
        _kept[key] = _Automaton(rows.value)
    return _kept[key]


def _scan(texts: list[bytes], automaton: _Automaton, before: list[tuple[list, list]] | None) -> tuple[np.ndarray, list[list[dict]], list[list[str]]]:
    """Number of words, spans and items of each text, with what was found before."""
    edge = b" \n "
    raw = np.frombuffer((edge + edge.join(texts) + edge).translate(_FOLD), np.uint8).copy()
    lengths = np.array([len(t) for t in texts], np.int64)
    begins = len(edge) + np.cumsum(lengths + len(edge)) - lengths - len(edge)  # of each text in raw
    raw[np.append(begins - 2, len(raw) - 2)] = _END
    word = raw > _BLANK
    after = np.concatenate(([False], word[:-1]))
    first_bytes = np.flatnonzero(word & ~after)
    first_word = np.searchsorted(first_bytes, begins)
    n_words = np.diff(np.append(first_word, len(first_bytes)))
    # one blank behind each word and each end of a text
    end = raw == _END
    kept = word | after | end | np.concatenate(([False], end[:-1]))
    hay = raw[kept]
    at, numbers = automaton.matches(hay.tobytes().decode("latin-1"))
    spans: list[list[dict]] = [[] for _ in texts]
    items: list[list[str]] = [[] for _ in texts]
    old = [(i, s) for i, (found, _) in enumerate(before or ()) for s in found]
    if not len(at) and not old and not any(names for _, names in before or ()):
        return n_words, spans, items
    hay_word = hay > _BLANK
    hay_first = np.flatnonzero(hay_word & ~np.concatenate(([False], hay_word[:-1])))
    begin = np.searchsorted(hay_first, at)
    stop = begin + np.array(automaton.n_words, np.int64)[numbers] if len(at) else begin
    if old:
        carried = np.array([(first_word[i] + s["first_word"], first_word[i] + s["first_word"] + s["n_words"]) for i, s in old], np.int64)
        begin, stop = np.append(begin, carried[:, 0]), np.append(stop, carried[:, 1])
    cover = np.zeros(len(first_bytes) + 1, np.int64)
    np.add.at(cover, begin, 1)
    np.add.at(cover, stop, -1)
    hit = np.cumsum(cover[:-1]) > 0
    # runs of hit words, parted where a text begins
    starts_text = np.zeros(len(hit) + 1, bool)
    starts_text[first_word] = True
    prior = np.concatenate(([False], hit[:-1]))
    run_from = np.flatnonzero(hit & (~prior | starts_text[:-1]))
    run_last = np.flatnonzero(hit & (~np.append(hit[1:], False) | starts_text[1:]))
    owner = np.searchsorted(first_word, run_from, side="right") - 1
    last_bytes = np.flatnonzero(word & ~np.append(word[1:], False))
    source, byte_of = -1, np.empty(0, np.int64)
    for i, a, b in zip(owner.tolist(), run_from.tolist(), run_last.tolist(), strict=True):
        if i != source:  # code points before each byte of this text
            byte_of = np.concatenate(([0], np.cumsum((np.frombuffer(texts[i], np.uint8) & 0xC0) != 0x80)))
            source = i
        start, end_at = first_bytes[a] - begins[i], last_bytes[b] + 1 - begins[i]
        spans[i].append({"start": int(byte_of[start]), "stop": int(byte_of[end_at]), "first_word": int(a - first_word[i]), "n_words": int(b - a + 1)})
    met: dict[int, set[str]] = {i: set(names) for i, (_, names) in enumerate(before or ()) if names}
    if len(at):
        owners = np.searchsorted(first_word, begin[: len(at)], side="right") - 1
        for i, number in np.unique(np.stack((owners, numbers), 1), axis=0).tolist():
            met.setdefault(i, set()).update(x for x in automaton.items[number] if x is not None)
    for i, names in met.items():
        items[i] = sorted(names)
    return n_words, spans, items


def _pass(rows: DataFrame, part: list[tuple[str | None, str]]) -> DataFrame:
    """rows with what one automaton finds in their texts, besides what they carry."""
    key, shared, carries = uuid.uuid4().hex, rows.sparkSession.sparkContext.broadcast(part), "spans" in rows.columns
    spans_type = pa.list_(pa.struct([(n, pa.int64()) for n in ("start", "stop", "first_word", "n_words")]))

    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = _automaton(key, shared)
        for batch in batches:
            block = np.cumsum(pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy().astype(np.int64)) // BLOCK_BYTES
            bounds = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), len(batch)]
            for a, b in zip(bounds[:-1], bounds[1:], strict=True):
                piece = batch.slice(a, b - a)
                if not len(piece):
                    continue
                before = list(zip(piece.column("spans").to_pylist(), piece.column("items").to_pylist(), strict=True)) if carries else None
                n_words, spans, items = _scan([t or b"" for t in piece.column("text").to_pylist()], automaton, before)
                found = [pa.array(n_words, pa.int64()), pa.array(spans, spans_type), pa.array(items, pa.list_(pa.string()))]
                yield pa.RecordBatch.from_arrays([piece.column("doc_id"), piece.column("text"), *found], names=["doc_id", "text", "n_doc_words", "spans", "items"])

    return rows.mapInArrow(scanned, f"doc_id long, text binary, n_doc_words long, {_FOUND}")


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, max_bytes: int = MAX_BYTES) -> DataFrame:
    """One row per document: doc_id, n_words, spans, items.

    spans: the runs of words inside any occurrence of a benchmark window, as
    start and stop (code points of the original text), first_word and n_words;
    items: ids of the items with an occurring window, as sorted strings.

    Null and empty texts have no words; whole texts are read whatever their
    length; windows never cross texts.  Repeated documents give repeated rows,
    repeated items count once; an item without an id hits words but isn't
    listed.  No documents give no rows, no items no spans.  Other columns are
    ignored.
    """
    found = cut(patterns(benchmark, item_col, item_text_col, window))
    size = found.agg(F.sum(F.octet_length("pattern") + 8)).first()[0] or 0
    n_parts = 1 if size <= max_bytes else -(-size * 5 // (4 * max_bytes))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").cast("binary").alias("text"))
    dealt = found.withColumn("part", F.pmod(F.xxhash64("pattern", "item"), F.lit(n_parts)))
    for part in range(n_parts):
        # of a checked size: about max_bytes at most
        own = [(r["item"], r["pattern"]) for r in dealt.filter(F.col("part") == part).collect()]
        rows = _pass(rows, own)
        if part < n_parts - 1:
            rows = cut(rows.drop("n_doc_words"))
    return rows.select("doc_id", F.col("n_doc_words").alias("n_words"), "spans", "items")


def report(found: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated of what contamination() found."""
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["n_words"])
    digest = F.sha2(F.array_join("items", ",").cast("binary"), 256)
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), digest.alias("items_sha256"), (n_hit > 0).alias("contaminated"))


def oracle_sql(window: int = WINDOW) -> str:
    """The same report for DuckDB: windows of documents joined with windows of items."""
    listed = rf"regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{_WORD}')"
    return f"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, {listed} AS w FROM documents),
i AS (SELECT item_id, {listed} AS w FROM benchmark),
win AS MATERIALIZED (
  SELECT DISTINCT item_id, k, array_to_string(w[s + 1 : s + k], ' ') AS win
  FROM (SELECT item_id, w, least(len(w), {window}) AS k, unnest(range(0, greatest(len(w) - {window - 1}, 1))) AS s FROM i WHERE len(w) > 0)),
each AS (SELECT r, unnest(w) AS word, generate_subscripts(w, 1) AS p FROM d),
ahead AS (SELECT r, p, list(word) OVER (PARTITION BY r ORDER BY p ROWS BETWEEN CURRENT ROW AND {window - 1} FOLLOWING) AS next FROM each),
occ AS MATERIALIZED (
  SELECT r, p, a.k, item_id
  FROM (SELECT r, p, k, array_to_string(next[1 : k], ' ') AS win FROM ahead, (SELECT DISTINCT k FROM win) WHERE len(next) >= k) a JOIN win USING (k, win)),
hit AS (SELECT r, count(DISTINCT pos) AS n_hit FROM (SELECT r, unnest(range(p, p + k)) AS pos FROM (SELECT DISTINCT r, p, k FROM occ)) GROUP BY r),
named AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item_id::VARCHAR AS item FROM occ WHERE item_id IS NOT NULL) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (r) LEFT JOIN named USING (r)
"""
