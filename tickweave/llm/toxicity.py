"""Toxicity by class-conditional Kneser-Ney models (operator 10).

Two interpolated bigram models, one of toxic and one of ordinary labelled
documents, use absolute discounting: P(w|h) keeps what a count holds beyond
its discount and gives the rest to the class's word distribution, which in
turn backs off to one distribution that both classes share: in how many
distinct contexts a word occurs in the whole corpus.  Counts are documents,
not occurrences.  The discount of an expression is what both classes together
let expect of it, plus some deviations of that, and at least some documents; so
rare and evenly spread expressions have the shared backoff probability.

A document's two log-likelihoods are divided by its number of words; a
logistic curve fitted on labelled documents apart from the training ones turns
their difference into a probability.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickweave.llm.common import cut
from tickweave.llm.text import chunks, mix, word_hashes

#: Labelled documents of each class that are drawn for training and calibration, by a hash of their id, and their characters.
MAX_LABELLED, MAX_CHARS, SLICES = 12_000, 100_000_000, 1000
#: The least discount, reached from 144 training documents of the smaller class on; a third of their root below, at least 1.
MIN_DISCOUNT = 4.0
#: Deviations in the discount; calibration picks one.
DEVIATIONS = (2.0, 4.0, 6.0, 8.0)
#: Least Jaccard similarity of the distinct bigrams of near copies, which count once in their class.
COPY = 0.8
#: Bitmaps of a word's context sketch: 16 tell the number of distinct contexts to about 20 percent.
BITMAPS = 16
#: Expressions that a task groups before it hands them on.
ROWS_AT_ONCE = 1_500_000
_START = np.uint64(0x51ED270B35A1F0C3)
_OTHER = np.uint64(0)  # stands for every word outside the vocabulary


def fold(id_col: str) -> Column:
    """crc32 of the id as text, modulo 5; a null id counts as the text 'null'."""
    return F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("null")).cast("binary")), F.lit(5)).cast("int")


def expressions(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(previous word, word, text index) of every word; the first word follows a start mark."""
    words, owner = word_hashes(texts)
    previous = np.concatenate(([_START], words[:-1])) if len(words) else words
    if len(words):
        previous[np.flatnonzero(np.diff(owner, prepend=-1))] = _START
    return previous, words, owner


def bigram_key(previous: np.ndarray, words: np.ndarray) -> np.ndarray:
    return mix(previous * np.uint64(0xD6E8FEB86659FD93) + words)


def distinct_in_texts(keys: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Positions of one of each key in each text."""
    return np.unique(mix(keys + owner.astype(np.uint64) * np.uint64(0xA24BAED4963EE407)), return_index=True)[1]


def places(keys: np.ndarray, asked: np.ndarray) -> np.ndarray:
    """Position of each asked key in the sorted keys, len(keys) where absent."""
    if not len(keys) or not len(asked):
        return np.full(len(asked), len(keys))
    distinct, back = np.unique(asked, return_inverse=True)
    at = np.minimum(np.searchsorted(keys, distinct), len(keys) - 1)
    return np.where(keys[at] == distinct, at, len(keys))[back]


@dataclass
class Model:
    """Log-probabilities (ordinary, toxic): of words (last row: any other word), of leaving a context's own counts, and of bigrams."""

    words: np.ndarray
    word_log: np.ndarray
    contexts: np.ndarray
    context_log: np.ndarray
    bigrams: np.ndarray
    bigram_log: np.ndarray
    weights: tuple[float, ...] = (-30.0, 0.0, 0.0, 0.0)

    def log_likelihoods(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(ordinary and toxic log-likelihood per word of each text, number of words); zeros without words."""
        previous, words, owner = expressions(texts)
        counts = np.bincount(owner, minlength=len(texts)) if len(owner) else np.zeros(len(texts), np.int64)
        if not len(words):
            return np.zeros((len(texts), 2)), counts
        word_at, context_at = places(self.words, words), places(self.contexts, previous)
        each = self.word_log[word_at] + np.concatenate((self.context_log, np.zeros((1, 2))))[context_at]
        own = np.flatnonzero((word_at < len(self.words)) & (context_at < len(self.contexts)))
        at = places(self.bigrams, bigram_key(previous[own], words[own]))
        hit = at < len(self.bigrams)
        each[own[hit]] = self.bigram_log[at[hit]]
        total = np.stack([np.bincount(owner, weights=each[:, c], minlength=len(texts)) for c in (0, 1)], 1)
        return total / np.maximum(counts, 1)[:, None], counts

    def probability(self, per_word: np.ndarray, counts: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(_features(per_word, counts) @ np.array(self.weights), -30, 30)))


def _features(per_word: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """What calibration sees: the difference of the length-normalised log-likelihoods, also by length."""
    n = np.maximum(counts, 1)
    difference = per_word[:, 1] - per_word[:, 0]
    return np.stack([np.ones(len(n)), difference, difference * np.sqrt(n), np.log(n)], 1)


def _sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_id_col: str, toxic_col: str, max_labelled: int, max_chars: int) -> DataFrame:
    """doc_id, text, toxic, part (0 calibration, 1 training): a bounded sample outside the held-out fold."""
    flags = labels.select(F.col(label_id_col).cast("long").alias("doc_id"), F.col(toxic_col).cast("int").alias("toxic")).filter("toxic is not null and doc_id is not null")
    flags = flags.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).filter(fold("doc_id") != 0)
    order = F.xxhash64("doc_id", F.lit(17))
    drawn = [flags.filter(F.col("toxic") == c).orderBy(order, "doc_id").limit(max_labelled) for c in (0, 1)]
    chosen = drawn[0].unionByName(drawn[1])  # at most 2 * max_labelled ids: a bounded broadcast
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    rows = rows.join(F.broadcast(chosen), "doc_id").withColumn("part", (fold("doc_id") != 1).cast("int"))
    # the same draw, bounded in characters too: whole slices of the order while their running length stays below the bound
    rows = cut(rows.withColumn("slice", F.pmod(order, F.lit(SLICES)).cast("int")))
    lengths = rows.groupBy("toxic", "slice").agg(F.sum(F.coalesce(F.length("text"), F.lit(0))).alias("n")).toPandas().sort_values("slice")
    lengths["upto"] = lengths.groupby("toxic")["n"].cumsum()
    over = lengths[lengths["upto"] > max_chars].groupby("toxic")["slice"].min()
    return rows.filter(F.col("slice") < F.when(F.col("toxic") == 1, int(over.get(1, SLICES))).otherwise(int(over.get(0, SLICES)))).drop("slice")


def _digests(sample: DataFrame) -> DataFrame:
    """doc_id, toxic, content (mostly shared by near copies), whole (of all its distinct bigrams) of each training text with words."""

    def digested(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = batch["text"].to_list()
            for part in chunks(texts):
                previous, words, owner = expressions(texts[part])
                if not len(words):
                    continue
                keys = bigram_key(previous, words)
                first = distinct_in_texts(keys, owner)
                first = first[np.argsort(owner[first], kind="stable")]
                keys, owner = keys[first], owner[first]
                starts = np.flatnonzero(np.diff(owner, prepend=-1))
                own = batch.iloc[part].iloc[owner[starts]]
                content = np.minimum.reduceat(mix(keys ^ np.uint64(0x9E3779B9)), starts)
                yield pd.DataFrame({"doc_id": own["doc_id"], "toxic": own["toxic"], "content": content.view(np.int64), "whole": np.add.reduceat(mix(keys), starts).view(np.int64)})

    rows = sample.filter("part = 1").select("doc_id", "toxic", "text")
    return rows.mapInPandas(digested, "doc_id long, toxic int, content long, whole long")


def _tables(sample: DataFrame) -> DataFrame:
    """doc_id, toxic of each training document that is no near copy of an earlier one of its class.

    Copies are looked for among documents that share the least of one more
    hash of their bigrams, and verified.
    """
    digests = cut(_digests(sample).dropDuplicates(["doc_id"]))
    distinct = digests.groupBy("toxic", "content", "whole").agg(F.min("doc_id").alias("doc_id"))
    shared = distinct.groupBy("toxic", "content").count().filter("count > 1").select("toxic", "content")
    alone = distinct.join(shared, ["toxic", "content"], "left_anti").select("doc_id", "toxic")
    met = distinct.join(shared, ["toxic", "content"], "left_semi").select("doc_id", "content")

    def differing(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.drop_duplicates("doc_id").sort_values("doc_id")
        sets = []
        for text in pdf["text"]:
            previous, words, _ = expressions([text])
            sets.append(np.unique(bigram_key(previous, words)))
        return pdf.loc[first_of_copies(sets), ["doc_id", "toxic"]]

    texts = sample.filter("part = 1").select("doc_id", "toxic", "text").join(met, "doc_id")
    return alone.unionByName(texts.groupBy("toxic", "content").applyInPandas(differing, "doc_id long, toxic int"))


def first_of_copies(sets: list[np.ndarray]) -> np.ndarray:
    """True for sets of distinct keys whose Jaccard similarity to every earlier true one is below COPY."""
    columns = np.unique(np.concatenate(sets), return_inverse=True)[1]
    spots = np.split(columns, np.cumsum([len(s) for s in sets])[:-1])
    holders: dict[int, list[int]] = {}
    kept = np.zeros(len(sets), bool)
    sizes = np.array([len(s) for s in sets])
    for i, spot in enumerate(spots):
        met = np.bincount(np.concatenate([np.array(holders.get(c, ()), int) for c in spot.tolist()]), minlength=len(sets))
        kept[i] = not (met >= COPY * (sizes + sizes[i] - met) - 1e-9).any()
        if kept[i]:
            for c in spot.tolist():
                holders.setdefault(c, []).append(i)
    return kept


def _counts(training: DataFrame, vocabulary: np.ndarray | None) -> DataFrame:
    """h, w, c0, c1: documents of each class that hold an expression.

    Without a vocabulary single words (h is 0).  With one, bigrams behind its
    words or the start mark; other words count as _OTHER.
    """
    shared = training.sparkSession.sparkContext.broadcast(vocabulary)

    def grouped(parts: list[tuple]) -> pd.DataFrame:
        h, w, cls = (np.concatenate(x) for x in zip(*parts, strict=True))
        _, at, group, total = np.unique(bigram_key(h, w), return_index=True, return_inverse=True, return_counts=True)
        ones = np.bincount(group, weights=cls, minlength=len(at)).astype(np.int64)
        return pd.DataFrame({"h": h[at].view(np.int64), "w": w[at].view(np.int64), "c0": total - ones, "c1": ones})

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts, size = [], 0
        for batch in batches:
            texts, toxic = batch["text"].to_list(), batch["toxic"].to_numpy()
            for part in chunks(texts):
                previous, words, owner = expressions(texts[part])
                if shared.value is None:
                    previous = np.zeros_like(words)
                else:
                    inside = (places(shared.value, previous) < len(shared.value)) | (previous == _START)
                    previous, words, owner = previous[inside], words[inside], owner[inside]
                first = distinct_in_texts(bigram_key(previous, words), owner)
                h, w, cls = previous[first], words[first], toxic[part][owner[first]]
                if shared.value is not None:
                    w[places(shared.value, w) == len(shared.value)] = _OTHER
                parts.append((h, w, cls))
                size += len(h)
                if size > ROWS_AT_ONCE:
                    yield grouped(parts)
                    parts, size = [], 0
        if size:
            yield grouped(parts)

    rows = training.select("text", "toxic").mapInPandas(counted, "h long, w long, c0 long, c1 long")
    return rows.groupBy("h", "w").agg(F.sum("c0").cast("double").alias("c0"), F.sum("c1").cast("double").alias("c1"))


def context_sketches(docs: DataFrame, text_col: str, vocabulary: np.ndarray) -> DataFrame:
    """w, b0, b1, ...: bitmaps of the distinct words that stand before each word of the vocabulary (or before _OTHER), over all documents.

    A context's hash picks one of BITMAPS bitmaps and in it a bit, bit r with
    probability 2^-(r+1).  A task emits one row for each word; rows merge by OR.
    """
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def sketched(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        keys = shared.value
        maps = np.zeros((len(keys) + 1, BITMAPS), np.uint32)
        for batch in batches:
            texts = batch["text"].to_list()
            for part in chunks(texts):
                previous, words, _ = expressions(texts[part])
                g = mix(previous ^ np.uint64(0xA0761D6478BD642F))
                x = (g >> np.uint64(16)).astype(np.uint32) | np.uint32(1 << 31)
                np.bitwise_or.at(maps.reshape(-1), places(keys, words) * BITMAPS + (g & np.uint64(BITMAPS - 1)).astype(np.int64), x & (~x + np.uint32(1)))
        seen = np.flatnonzero(maps.any(1))
        if len(seen):
            names = np.append(keys, _OTHER).view(np.int64)[seen]
            yield pd.DataFrame({"w": names} | {f"b{j}": maps[seen].view(np.int64)[:, j] for j in range(BITMAPS // 2)})

    bits = [f"b{j}" for j in range(BITMAPS // 2)]
    rows = docs.select(F.col(text_col).cast("string").alias("text")).mapInPandas(sketched, "w long, " + ", ".join(f"{b} long" for b in bits))
    return rows.groupBy("w").agg(*[F.bit_or(b).alias(b) for b in bits])


def distinct_contexts(maps: np.ndarray) -> np.ndarray:
    """The number of distinct contexts that bitmaps (words, BITMAPS) of uint32 tell: by empty bitmaps as long as there are any."""
    empty = (maps == 0).sum(1)
    lowest_zero = ~maps & (maps + np.uint32(1))
    mean = np.log2(np.maximum(lowest_zero, 1).astype(np.float64)).mean(1)
    many = maps.shape[1] / 0.77351 * (2**mean - 2 ** (-1.75 * mean))
    return np.where(empty > 0, maps.shape[1] * np.log(maps.shape[1] / np.maximum(empty, 1)), many)


def discounted(counts: np.ndarray, expected: np.ndarray, deviations: float, least: float = MIN_DISCOUNT) -> np.ndarray:
    """What of each count the discount takes."""
    return np.minimum(counts, np.maximum(least, expected + deviations * np.sqrt(expected)))


def class_models(words: pd.DataFrame, sizes: np.ndarray, contexts: np.ndarray, bigrams: pd.DataFrame, deviations: float, least: float = MIN_DISCOUNT) -> Model:
    """The two models.

    words: key, c0, c1 (the vocabulary, sorted by key); sizes: all word counts
    of both classes; contexts: distinct contexts of the vocabulary's words and
    of all others together; bigrams: h, w, c0, c1, n0, n1 (all counts behind h)
    of those above the least discount.
    """
    keys = words["key"].to_numpy(np.uint64)
    shared = (contexts + 0.5) / (contexts + 0.5).sum()
    both = words["c0"].to_numpy() + words["c1"].to_numpy()
    h, w = bigrams["h"].to_numpy(np.int64).view(np.uint64), bigrams["w"].to_numpy(np.int64).view(np.uint64)
    names, which = np.unique(h, return_inverse=True)
    word_p, leave, joint, telling = [], [], [], np.zeros(len(h), bool)
    for c in (0, 1):
        count = words[f"c{c}"].to_numpy()
        excess = count - discounted(count, both * sizes[c] / sizes.sum(), deviations, least)
        p = np.append(excess / sizes[c], 0.0) + (1 - excess.sum() / sizes[c]) * shared
        word_p.append(p)
        count, behind = bigrams[f"c{c}"].to_numpy(), bigrams[f"n{c}"].to_numpy()
        expected = (bigrams["c0"] + bigrams["c1"]).to_numpy() * behind / np.maximum((bigrams["n0"] + bigrams["n1"]).to_numpy(), 1)
        more = (count - discounted(count, expected, deviations, least)) / np.maximum(behind, 1)
        left = 1 - np.bincount(which, weights=more, minlength=len(names))
        telling |= more > 0
        leave.append(left)
        joint.append(more + left[which] * p[places(keys, w)])
    moved = (leave[0] < 1) | (leave[1] < 1)
    bigram = bigram_key(h[telling], w[telling])
    order = np.argsort(bigram)
    logs = [np.log(np.maximum(np.stack(x, 1), 1e-300)) for x in (word_p, [x[moved] for x in leave], [x[telling] for x in joint])]
    return Model(keys, logs[0], names[moved], logs[1], bigram[order], logs[2][order])


def train(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_id_col: str = "doc_id", toxic_col: str = "toxic",
    max_labelled: int = MAX_LABELLED, max_chars: int = MAX_CHARS,
) -> Model | None:
    """The two calibrated models; None if a class has no labelled training document.

    Class counts come from at most max_labelled documents (and max_chars
    characters) of each class whose crc32(doc_id) mod 5 is neither 0 nor 1;
    those with remainder 1 fit the calibration.  The shared backoff counts
    cover all documents.  The vocabulary, words of more labelled documents
    than the least discount, and the bigrams above it have at most max_chars /
    MIN_DISCOUNT entries and reach the driver.
    """
    sample = cut(_sample(docs, labels, id_col, text_col, label_id_col, toxic_col, max_labelled, max_chars))
    kept = cut(_tables(sample))
    documents = {r["toxic"]: r["count"] for r in kept.groupBy("toxic").count().collect()}
    if not documents.get(0) or not documents.get(1):
        return None
    least = float(np.clip(min(documents.values()) ** 0.5 / 3, 1.0, MIN_DISCOUNT))
    training = sample.filter("part = 1").select("doc_id", "text", "toxic").join(F.broadcast(kept.select("doc_id")), "doc_id").dropDuplicates(["doc_id"])
    training = cut(training)
    singles = cut(_counts(training, None))
    sizes = np.array(singles.agg(F.sum("c0"), F.sum("c1")).head(), np.float64)
    words = singles.filter(F.col("c0") + F.col("c1") > least).select(F.col("w").alias("key"), "c0", "c1").toPandas()
    words["key"] = words["key"].to_numpy(np.int64).view(np.uint64)
    words = words.sort_values("key", ignore_index=True)
    vocabulary = words["key"].to_numpy(np.uint64)
    pairs = cut(_counts(training, vocabulary))
    behind = pairs.groupBy("h").agg(F.sum("c0").alias("n0"), F.sum("c1").alias("n1"))
    strong = pairs.filter(((F.col("c0") > least) | (F.col("c1") > least)) & (F.col("w") != 0)).join(behind, "h").select("h", "w", "c0", "c1", "n0", "n1").toPandas()
    sketches = context_sketches(docs, text_col, vocabulary).toPandas()
    maps = np.zeros((len(vocabulary) + 1, BITMAPS), np.uint32)
    at = places(vocabulary, sketches["w"].to_numpy(np.int64).view(np.uint64))
    maps[at] = np.ascontiguousarray(sketches[[f"b{j}" for j in range(BITMAPS // 2)]].to_numpy(np.int64)).view(np.uint32)
    contexts = distinct_contexts(maps)
    return _calibrated([class_models(words, sizes, contexts, strong, k, least) for k in DEVIATIONS], sample)


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.01, steps: int = 40) -> tuple[np.ndarray, float]:
    """(weights on the columns of x, the first constant; mean log loss) by Newton steps on standardised columns."""
    mean, sd = x.mean(0), np.maximum(x.std(0), 1e-12)
    mean[0], sd[0] = 0.0, 1.0
    z, b = (x - mean) / sd, np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ b, -30, 30)))
        slope = (z * np.maximum(p * (1 - p), 1e-9)[:, None]).T @ z + ridge * np.eye(len(b))
        b -= np.linalg.solve(slope, z.T @ (p - y) + ridge * b)
    p = np.clip(1 / (1 + np.exp(-np.clip(z @ b, -30, 30))), 1e-6, 1 - 1e-6)
    w = b / sd
    w[0] = b[0] - (b[1:] * mean[1:] / sd[1:]).sum()
    return w, float(-(y * np.log(p) + (1 - y) * np.log(1 - p)).mean())


def _calibrated(models: list[Model], sample: DataFrame) -> Model:
    """The model with the least log loss on calibration documents (all, if a class has none there), with its weights."""
    shared = sample.sparkSession.sparkContext.broadcast(models)

    def scored(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = batch["text"].to_list()
            for part in chunks(texts):
                out = batch.iloc[part][["toxic", "part"]].reset_index(drop=True)
                for i, model in enumerate(shared.value):
                    per_word, counts = model.log_likelihoods(texts[part])
                    out[f"o{i}"], out[f"t{i}"], out["n"] = per_word[:, 0], per_word[:, 1], counts
                yield out

    schema = "toxic int, part int, " + ", ".join(f"o{i} double, t{i} double" + (", n long" if i == 0 else "") for i in range(len(models)))
    seen = sample.select("text", "toxic", "part").mapInPandas(scored, schema).toPandas()
    held = seen[seen["part"] == 0]
    seen = held if held["toxic"].nunique() == 2 else seen
    y, n = seen["toxic"].to_numpy(np.float64), seen["n"].to_numpy()
    fits = [fit_logistic(_features(seen[[f"o{i}", f"t{i}"]].to_numpy(), n), y) for i in range(len(models))]
    best = min(range(len(models)), key=lambda i: fits[i][1])
    models[best].weights = tuple(fits[best][0])
    return models[best]


def scores(model: Model | None, text: Column) -> Column:
    """struct(score, ll_ordinary, ll_toxic) of a text column: probability and the two log-likelihoods per word; zeros without a model."""
    schema = "score double, ll_ordinary double, ll_toxic double"
    if model is None:
        return F.struct(*[F.lit(0.0).alias(x.split()[0]) for x in schema.split(", ")])

    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = batch.to_list()
            out = np.zeros((len(texts), 3))
            for part in chunks(texts):
                per_word, counts = model.log_likelihoods(texts[part])
                out[part] = np.column_stack([model.probability(per_word, counts), per_word])
            yield pd.DataFrame(out, columns=["score", "ll_ordinary", "ll_toxic"])

    scored.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.DataFrame]}
    return F.pandas_udf(scored, schema)(text)


def score(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, held_out, score (0 to 1), predicted (1 if score >= 0.5), ll_ordinary, ll_toxic.

    Whole texts; null or empty ones have log-likelihoods of 0 and the score of
    an even text of one word; without a model all scores are 0.  Repeated rows
    score alike; an empty table gives no rows; other columns are ignored.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), scores(model, F.col(text_col).cast("string")).alias("s"))
    return rows.select("doc_id", (fold("doc_id") == 0).alias("held_out"), "s.score", (F.col("s.score") >= 0.5).cast("int").alias("predicted"), "s.ll_ordinary", "s.ll_toxic")
