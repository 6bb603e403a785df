"""N-gram Jaccard self-join by a MinHash LSH forest (operator 8).

Texts with the same words form one class of copies and are joined once.  Each
distinct text gets a label per tree: eight 8-bit min-hashes, a path in a
prefix trie.  Prefixes are shortened to the first depth where
1 - (1 - t^depth)^trees reaches the target recall at the threshold t.  All
texts that share such a prefix meet: the pairs of small buckets are listed,
larger buckets are compared in blocks, which emit only links that connect
whatever likely pairs connect.

A pair is likely if its labels agree enough for the threshold.  What is
connected then is compared exactly, all texts against all in blocks of
bounded size, without emitting pairs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickweave.llm.common import as_given, cut, unused
from tickweave.llm.graph import components
from tickweave.llm.text import chunks, shingle_hashes, word_hashes

TREES, LEVELS = 24, 8
RECALL = 0.999
BLOCK_SHINGLES, BLOCK_TEXTS = 1_000_000, 2_000
#: Buckets up to SMALL_BUCKET texts emit their pairs; larger ones are compared in blocks of about BUCKET_TEXTS.
SMALL_BUCKET, BUCKET_TEXTS = 8, 4_000
_MULTIPLIERS = np.random.default_rng(5).integers(1, 2**31, TREES * LEVELS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_ADDENDS = np.random.default_rng(6).integers(0, 2**32, TREES * LEVELS, dtype=np.uint32)


def depth_for(threshold: float, recall: float = RECALL, trees: int = TREES, levels: int = LEVELS) -> int:
    """The longest prefix at which a pair at the threshold is met in some tree with the target probability."""
    return next((d for d in range(levels, 1, -1) if 1 - (1 - threshold**d) ** trees >= recall), 1)


def tree_labels(shingles: np.ndarray, owner: np.ndarray, n_texts: int) -> np.ndarray:
    """Labels (n_texts, TREES) as int64; texts without shingles get zeros.  owner is sorted."""
    out = np.zeros((n_texts, TREES), np.uint64)
    if not len(shingles):
        return out.view(np.int64)
    starts = np.flatnonzero(np.diff(owner, prepend=-1))
    texts = owner[starts]
    x = (shingles >> np.uint64(32)).astype(np.uint32) ^ shingles.astype(np.uint32)
    for t in range(TREES):
        label = np.zeros(len(starts), np.uint64)
        for level in range(LEVELS):
            k = t * LEVELS + level
            low = np.minimum.reduceat(x * _MULTIPLIERS[k] + _ADDENDS[k], starts)
            low = (low ^ (low >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
            label = (label << np.uint64(8)) | (low >> np.uint32(24)).astype(np.uint64)
        out[texts, t] = label
    return out.view(np.int64)


def sequence_keys(words: np.ndarray, owner: np.ndarray, n_texts: int) -> list[int | None]:
    """64-bit content hash of each text's word sequence; None without words."""
    ends = np.cumsum(np.bincount(owner, minlength=n_texts) if len(owner) else np.zeros(n_texts, np.int64))
    begins = np.concatenate(([0], ends[:-1]))
    return [int.from_bytes(hashlib.blake2b(words[a:b].tobytes(), digest_size=8).digest(), "little", signed=True) if b > a else None for a, b in zip(begins, ends, strict=True)]


def text_key(text: Column) -> Column:
    """sequence_keys of a text column."""

    def keyed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            texts, keys = batch.to_list(), []
            for part in chunks(texts):
                keys += sequence_keys(*word_hashes(texts[part]), part.stop - part.start)
            yield pd.Series(keys, dtype="Int64")

    keyed.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(keyed, "long")(text)


def _signatures(docs: DataFrame, size: int) -> DataFrame:
    """doc_id, key (64-bit content hash of the word sequence, null without words), n_shingles, labels."""

    def signed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            ids, texts = batch["doc_id"], batch["text"].to_list()
            for part in chunks(texts):
                n = part.stop - part.start
                words, owner = word_hashes(texts[part])
                shingles, of = shingle_hashes(words, owner, n, size)
                labels = tree_labels(shingles, of, n)
                counts = np.bincount(of, minlength=n) if len(of) else np.zeros(n, np.int64)
                keys = sequence_keys(words, owner, n)
                yield pd.DataFrame({"doc_id": ids.iloc[part].to_numpy(), "key": pd.array(keys, "Int64"), "n_shingles": counts.astype(np.int64), "labels": list(labels)}).astype({"doc_id": "Int64"})

    return docs.mapInPandas(signed, "doc_id long, key long, n_shingles long, labels array<long>")


def _buckets(texts: DataFrame, depth: int) -> DataFrame:
    """tree, label (the prefix of that depth), key, n of all texts that share their prefix with another one."""
    shift = 8 * (LEVELS - depth)
    rows = texts.select("key", F.posexplode("labels").alias("tree", "label")).select("tree", F.shiftright("label", shift).alias("label"), "key")
    met = rows.groupBy("tree", "label").agg(F.count("*").alias("n")).filter("n > 1")
    return cut(rows.join(met, ["tree", "label"]))


def _small_pairs(buckets: DataFrame) -> DataFrame:
    """Distinct pairs (a, b) of keys: all texts against all of buckets of at most SMALL_BUCKET texts."""
    listed = buckets.filter(F.col("n") <= SMALL_BUCKET).groupBy("tree", "label").agg(F.array_sort(F.collect_list("key")).alias("keys"))
    pairs = F.expr("flatten(transform(keys, (x, i) -> transform(slice(keys, i + 2, size(keys)), y -> struct(x AS a, y AS b))))")
    return listed.select(F.explode(pairs).alias("p")).select("p.a", "p.b").distinct()


def least_agreement(threshold: float) -> float:
    """Five deviations below the threshold: the least share of 192 min-hash bytes of a likely pair."""
    return threshold - 5 * (threshold * (1 - threshold) / (TREES * LEVELS)) ** 0.5


def likely_forest(labels: np.ndarray, sides: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Links (from, to) that connect whatever likely pairs connect: a spanning forest of all texts against all.

    labels: bytes (n, 192); sides: 0 or 1; only pairs of different sides count
    if both occur.  Every text meets all that no link has reached yet, so a
    group of near copies takes about one pass.
    """
    n, two = len(labels), sides.any() and not sides.all()
    need = int(np.ceil(least * labels.shape[1] - 1e-9))
    columns = np.ascontiguousarray(labels.T)
    open_ = np.ones(n, bool)
    tails, heads = [], []
    for start in range(n):
        if not open_[start]:
            continue
        open_[start] = False
        reached = np.array([start])
        while len(reached):
            following = []
            for side in (0, 1) if two else (None,):
                mine = reached if side is None else reached[sides[reached] == side]
                at = 0
                while at < len(mine):
                    rest = np.flatnonzero(open_ if side is None else open_ & (sides != side))
                    if not len(rest):
                        break
                    some = mine[at : at + max(1, 4_000_000 // len(rest))] if at else mine[:1]
                    at += len(some)
                    agree = np.zeros((len(some), len(rest)), np.uint8)
                    for column in columns:
                        agree += column[some][:, None] == column[rest][None, :]
                    likely = agree >= need
                    hit = likely.any(0)
                    tails.append(some[likely[:, hit].argmax(0)])
                    heads.append(rest[hit])
                    open_[rest[hit]] = False
                    following.append(rest[hit])
            reached = np.concatenate(following) if following else np.empty(0, int)
    return (np.concatenate(tails), np.concatenate(heads)) if tails else (np.empty(0, int), np.empty(0, int))


def _large_links(buckets: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """Links (a, b) of larger buckets, in blocks of bounded size: without emitting pairs."""
    least = least_agreement(threshold)
    blocks = F.ceil(F.col("n") / BUCKET_TEXTS).cast("int").alias("blocks")
    rows = buckets.filter(F.col("n") > SMALL_BUCKET).select("tree", "label", "key", blocks).join(texts.select("key", "labels"), "key")
    own = F.pmod(F.xxhash64("key", F.lit(3)), F.col("blocks")).cast("int")
    rows = rows.select("*", own.alias("own"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    rows = rows.withColumn("i", F.least("own", "other")).withColumn("j", F.greatest("own", "other")).withColumn("side", ((F.col("own") == F.col("j")) & (F.col("own") != F.col("other"))).cast("int"))

    def linked(pdf: pd.DataFrame) -> pd.DataFrame:
        keys, sides = pdf["key"].to_numpy(), pdf["side"].to_numpy()
        tails, heads = keys[:0], keys[:0]
        if pdf["i"].iloc[0] == pdf["j"].iloc[0] or (sides.any() and not sides.all()):
            a, b = likely_forest(np.stack(pdf["labels"].to_list()).view(np.uint8), sides, least)
            tails, heads = keys[a], keys[b]
        return pd.DataFrame({"a": np.minimum(tails, heads), "b": np.maximum(tails, heads)})

    return rows.groupBy("tree", "label", "i", "j").applyInPandas(linked, "a long, b long").distinct()


def _likely(pairs: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """Pairs whose 192 min-hash bytes agree within five deviations of the threshold."""
    least = least_agreement(threshold)

    def agreeing(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                x, y = (np.stack(batch[c].to_list()).view(np.uint8) for c in ("lx", "ly"))
                yield batch.loc[(x == y).mean(1) >= least, ["a", "b"]]

    side = texts.select("key", "labels")
    both = pairs.join(side.select(F.col("key").alias("a"), F.col("labels").alias("lx")), "a").join(side.select(F.col("key").alias("b"), F.col("labels").alias("ly")), "b")
    return both.mapInPandas(agreeing, "a long, b long")


def compare_block(sets: list[np.ndarray], sides: np.ndarray, copies: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """(linked documents of each text, least position linked directly or over others).

    sets: sorted distinct shingles; sides: 0 or 1; only pairs of different
    sides count if both occur, else all pairs.
    """
    n = len(sets)
    sizes = np.array([len(s) for s in sets], np.float64)
    flat = np.concatenate(sets)
    owner = np.repeat(np.arange(n), [len(s) for s in sets])
    _, column, freq = np.unique(flat, return_inverse=True, return_counts=True)
    common = np.zeros((n, n), np.float32)
    rare = (freq[column] > 1) & (freq[column] <= 16)
    if rare.any():
        order = np.argsort(column[rare], kind="stable")
        c, o = column[rare][order], owner[rare][order]
        for gap in range(1, 16):
            same = c[gap:] == c[:-gap]
            np.add.at(common, (o[:-gap][same], o[gap:][same]), 1)
            np.add.at(common, (o[gap:][same], o[:-gap][same]), 1)
    frequent = np.flatnonzero(freq > 16)
    place = np.full(len(freq), -1)
    place[frequent] = np.arange(len(frequent))
    at = place[column]
    width = max(64, 8_000_000 // n)
    for low in range(0, len(frequent), width):
        inside = (at >= low) & (at < low + width)
        dense = np.zeros((n, min(width, len(frequent) - low)), np.float32)
        dense[owner[inside], at[inside] - low] = 1
        common += dense @ dense.T
    linked = np.empty((n, n), bool)
    some = [slice(low, low + 256) for low in range(0, n, 256)]  # so that doubles of all pairs are never held at once
    for rows in some:
        linked[rows] = common[rows] >= threshold * (sizes[rows, None] + sizes[None, :] - common[rows]) - 1e-6
    np.fill_diagonal(linked, False)
    if sides.any() and not sides.all():
        linked &= sides[:, None] != sides[None, :]
    root = np.arange(n)
    while True:
        nearest = np.concatenate([np.where(linked[rows], root[None, :], n).min(1) for rows in some]) if n else root
        moved = np.minimum(root, nearest)
        moved = moved[moved]
        if (moved == root).all():
            return np.concatenate([linked[rows].astype(np.float64) @ copies for rows in some]) if n else copies, root
        root = moved


def _verified(docs: DataFrame, texts: DataFrame, groups: DataFrame, threshold: float, size: int) -> DataFrame:
    """key, links (documents with another text that are similar), root (a key it is linked to) for all texts of all blocks."""
    sized = groups.join(texts.select(F.col("key").alias("node"), "rep", "copies", "n_shingles"), "node")
    totals = cut(sized.groupBy("root").agg(F.sum("n_shingles").alias("all_"), F.count("*").alias("n")))
    # a block's arrays grow with its shingles and with the square of its texts
    blocks = F.greatest(F.ceil(F.col("all_") / BLOCK_SHINGLES), F.ceil(F.col("n") / BLOCK_TEXTS)).cast("int")
    sized = sized.join(totals, "root").select("node", "root", "rep", "copies", blocks.alias("blocks"))

    def shingled(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts_ = batch.pop("text").to_list()
            for part in chunks(texts_):
                n = part.stop - part.start
                words, owner = word_hashes(texts_[part])
                shingles, of = shingle_hashes(words, owner, n, size)
                ends = np.cumsum(np.bincount(of, minlength=n) if len(of) else np.zeros(n, np.int64))
                out = batch.iloc[part].copy()
                out["shingles"] = [np.unique(shingles[a:b]).tobytes() for a, b in zip(np.concatenate(([0], ends[:-1])), ends, strict=True)]
                yield out[out["node"].to_numpy() == np.array([k or 0 for k in sequence_keys(words, owner, n)])]  # rows of a repeated id with another text drop out

    columns = ["node", "root", "copies", "blocks", "text"]
    rows = docs.join(sized, docs["doc_id"] == sized["rep"]).select(*columns)
    if not texts.filter("rep is null").isEmpty():
        # texts that only rows without an id hold are found by their key
        without = docs.filter("doc_id is null").select(text_key(F.col("text")).alias("node"), "text").filter("node is not null").dropDuplicates(["node"])
        rows = rows.unionByName(without.join(sized.filter("rep is null"), "node").select(*columns))
    rows = rows.mapInPandas(shingled, "node long, root long, copies long, blocks int, shingles binary")
    own = F.pmod(F.xxhash64("node", F.lit(3)), F.col("blocks")).cast("int")
    rows = rows.select("*", own.alias("own"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    rows = rows.withColumn("i", F.least("own", "other")).withColumn("j", F.greatest("own", "other")).withColumn("side", (F.col("own") == F.col("j")).cast("int"))

    def compared(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.drop_duplicates("node").sort_values("node")
        one_block = pdf["i"].iloc[0] == pdf["j"].iloc[0]
        sides = np.zeros(len(pdf), int) if one_block else pdf["side"].to_numpy()
        keys = pdf["node"].to_numpy()
        if not one_block and (sides.all() or not sides.any()):
            return pd.DataFrame({"key": keys, "links": 0, "root": keys})
        links, root = compare_block([np.frombuffer(b, np.uint64) for b in pdf["shingles"]], sides, pdf["copies"].to_numpy(np.float64), threshold)
        return pd.DataFrame({"key": keys, "links": links.astype(np.int64), "root": keys[root]})

    return rows.select("root", "i", "j", "side", "node", "copies", "shingles").groupBy("root", "i", "j").applyInPandas(compared, "key long, links long, root long")


def _classified(docs: DataFrame, id_col: str, text_col: str, threshold: float, size: int, recall: float) -> DataFrame:
    """doc_id, key, root, class_id, n_links of every row; key and root are null without words."""
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    signed = cut(_signatures(base, size))
    texts = signed.filter("key is not null").groupBy("key").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"), F.max("n_shingles").alias("n_shingles"), F.min("labels").alias("labels"))
    texts = cut(texts)
    buckets = _buckets(texts, depth_for(threshold, recall))
    likely = _likely(_small_pairs(buckets), texts, threshold).unionByName(_large_links(buckets, texts, threshold))
    groups = components(likely)
    found = cut(_verified(base, texts, groups, threshold, size))
    classes = components(found.select(F.col("key").alias("a"), F.col("root").alias("b")))
    links = found.groupBy("key").agg(F.sum("links").alias("links"))
    known = texts.select("key", "rep", "copies").join(links, "key", "left").join(classes.select(F.col("node").alias("key"), "root"), "key", "left")
    known = cut(known.select("key", "rep", F.coalesce("root", "key").alias("root"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")))
    # written, so that the join reads plain shuffles: Spark can then split a class that holds many texts
    least = cut(known.groupBy("root").agg(F.min("rep").alias("class_id")))
    known = known.join(least, "root").select("key", "root", "class_id", "n_links")
    rows = signed.select("doc_id", "key").join(known, "key", "left")
    return rows.select("doc_id", "key", "root", F.when(F.col("key").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.8, size: int = 5, recall: float = RECALL) -> DataFrame:
    """One row per input row: doc_id, class_id, n_links.

    Two documents are linked if the Jaccard similarity of their sets of
    ``size``-word shingles is at least the threshold; a text of fewer words is
    one shingle.  class_id is the least doc_id reached over links, n_links the
    number of other documents linked directly, copies included.  Texts without
    words (null, empty, punctuation) have no links and are their own class;
    rows with a null id take part and get the least non-null id of their
    class, or null.  Repeated rows count as further documents.  Very long
    texts are compared whole.  An empty table gives no rows; other columns are
    ignored.
    """
    return _classified(docs, id_col, text_col, threshold, size, recall).select("doc_id", "class_id", "n_links")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.8, size: int = 5, recall: float = RECALL) -> DataFrame:
    """Documents of which one of each class of near duplicates stays: a row with the class's least id.

    Rows of one id with unlike texts are documents of their own.  Of the rows
    with a class's least id (or of a class without ids) those of the least
    content hash stay, one if they are copies.  Rows without words all stay.
    """
    rows = _classified(docs, id_col, text_col, threshold, size, recall).select("doc_id", "key", "root", "class_id")
    mine = F.col("doc_id").eqNullSafe(F.col("class_id"))
    rows = cut(rows)
    chosen = rows.filter("key is not null").filter(mine).groupBy("root").agg(F.min("key").alias("chosen"))
    stays = F.col("key").isNull() | (mine & (F.col("key") == F.col("chosen")))
    verdicts = cut(rows.join(chosen, "root", "left").select(F.col("doc_id").alias(id_col), "key", F.coalesce(stays, F.lit(False)).alias("stays")))
    by_id = verdicts.groupBy(id_col).agg(F.count_if("stays").alias("kept"), F.count_if(~F.col("stays")).alias("lost"), F.count_if(F.col("stays") & F.col("key").isNotNull()).alias("worded"))
    by_id = cut(by_id.filter("lost > 0 or worded > 1"))
    gone = by_id.filter(f"kept = 0 and {id_col} is not null").select(id_col)
    left = as_given(docs.join(gone, id_col, "left_anti"), docs)
    mixed_id, text, own, wanted_text = unused(docs, "mixed", "key", "id", "wanted")
    mixed = by_id.filter(f"kept > 0 or {id_col} is null").select(F.col(id_col).alias(mixed_id))
    if mixed.isEmpty():
        return left
    # ids with several rows, only some of which stay: told apart by their texts
    same = left[id_col].eqNullSafe(F.col(mixed_id))
    several = left.join(mixed, same, "left_semi").withColumn(text, text_key(F.col(text_col).cast("string")))
    wanted = verdicts.filter("stays and key is not null").select(F.col(id_col).alias(own), F.col("key").alias(wanted_text)).distinct()
    worded = several.join(wanted, several[id_col].eqNullSafe(F.col(own)) & (F.col(text) == F.col(wanted_text)), "left_semi").dropDuplicates([id_col, text])
    return left.join(mixed, same, "left_anti").unionByName(as_given(several.filter(F.col(text).isNull()).unionByName(worded), docs))
