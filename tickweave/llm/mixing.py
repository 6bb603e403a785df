"""Source mixing by iterative proportional fitting (operator 2).

Token counts by (source, language, topic) are raked until their margins meet
target weights; the ratio of target to present tokens of a cell, scaled so
that no probability passes 1, is the inclusion probability of its documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickweave.llm.common import cut, text_or_empty, unused

MARGINS = ("source", "lang", "topic")
#: Target share of a margin's value: proportional to its tokens to this power.
SMOOTHING = 0.7
ROUNDS = 12
#: Turns after which the cell table is written, so that plans stay small in the driver.
ROUNDS_PER_JOB = 3
#: Shuffles of so few cells cost the driver more than the sums themselves: threads, plans and their updates.
CELLS_PER_TASK = 50_000
SEED = "mix-1"


def n_tokens(text_col: str = "text") -> Column:
    """Words between blanks, line ends and tabs; 0 for null or blank text."""
    words = F.trim(F.translate(text_or_empty(text_col), "\n\r\t", "   "))
    squeezed = F.length(F.regexp_replace(words, " +", " ")) - F.length(F.replace(words, F.lit(" "), F.lit("")))
    return F.when(words == "", F.lit(0)).otherwise(squeezed + 1).cast("long")


def topic(tokens: Column) -> Column:
    """Stand-in topic where the table has none: the text's length class."""
    return F.when(tokens < 150, "short").when(tokens < 600, "medium").otherwise("long")


def uniform(id_col: str, seed: str = SEED) -> Column:
    """A number in [0, 1) that depends on the id and the seed alone; null id counts as the text 'null'."""
    key = F.concat_ws(":", F.lit(seed), F.coalesce(F.col(id_col).cast("string"), F.lit("null")))
    return F.conv(F.substring(F.md5(key.cast("binary")), 1, 13), 16, 10).cast("long") / F.lit(float(16**13))


def smoothed_targets(cells: DataFrame, margins: list[str], power: float = SMOOTHING) -> DataFrame:
    """Cells with columns goal_<margin>: the share of all tokens that the cell's value of each margin shall get."""
    marked = cells
    for m in margins:
        by = Window.partitionBy(m)
        own = F.pow(F.sum("tokens").over(by).cast("double"), F.lit(power))
        # one representative row of each value counts towards the total
        first = F.row_number().over(by.orderBy(*MARGINS))
        marked = marked.withColumn(f"_own_{m}", own).withColumn(f"_first_{m}", F.when(first == 1, F.col(f"_own_{m}")).otherwise(0.0))
    marked = cut(marked)  # read twice
    totals = marked.agg(*[F.sum(f"_first_{m}").alias(f"_all_{m}") for m in margins])
    return marked.join(F.broadcast(totals)).select(*cells.columns, *[(F.col(f"_own_{m}") / F.col(f"_all_{m}")).alias(f"goal_{m}") for m in margins])


def rake(cells: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """Cells (source, lang, topic, tokens, goal_*) with column raked: the fitted share of each cell.

    Each step scales every value of one margin to its goal; after ``rounds``
    turns over the three margins the shares meet all goals that the non-empty
    cells allow.  Works on the cell table only, whose size is the number of
    distinct value combinations, not of documents.  Up to CELLS_PER_TASK cells
    stay in one partition, which no window shuffles again; more are dealt by
    each margin in turn.
    """
    out = cells.withColumn("raked", F.col("tokens").cast("double"))
    for k in range(rounds):
        if k and k % ROUNDS_PER_JOB == 0:
            out = _together(cut(out))
        for m in MARGINS:
            out = out.withColumn("raked", F.col("raked") * F.col(f"goal_{m}") / F.sum("raked").over(Window.partitionBy(m)))
    return out


def _together(cells: DataFrame) -> DataFrame:
    """A written cell table, in one partition if it is small."""
    return cells.coalesce(1) if cells.count() <= CELLS_PER_TASK else cells


def _drawn(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang", topic_expr: Column | None = None, goals: dict[str, dict[str, float]] | None = None, rounds: int = ROUNDS, seed: str = SEED) -> DataFrame:
    """What mix returns, with columns raw_source, raw_lang and text_hash of the row."""
    tokens = n_tokens(text_col)
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.coalesce(F.col(source_col).cast("string"), F.lit("(none)")).alias("source"),
        F.coalesce(F.col(lang_col).cast("string"), F.lit("(none)")).alias("lang"),
        tokens.alias("n_tokens"),
        F.col(source_col).cast("string").alias("raw_source"),
        F.col(lang_col).cast("string").alias("raw_lang"),
        F.xxhash64(F.col(text_col).cast("string")).alias("text_hash"),
        *([topic_expr.cast("string").alias("_topic")] if topic_expr is not None else []),
    )
    rows = cut(rows)  # the texts are read once; what stays is small
    rows = rows.withColumn("topic", F.coalesce(F.col("_topic"), F.lit("(none)")) if topic_expr is not None else topic(F.col("n_tokens"))).drop("_topic")
    cells = _together(cut(rows.filter("n_tokens > 0").groupBy(*MARGINS).agg(F.sum("n_tokens").alias("tokens"))))
    given = [m for m in MARGINS if goals and m in goals]
    for m in given:
        shares = F.create_map(*[F.lit(x) for pair in goals[m].items() for x in pair]) if goals[m] else F.lit(None)
        cells = cells.withColumn(f"goal_{m}", F.coalesce(F.try_element_at(shares, F.col(m)), F.lit(0.0)))
    if smoothed := [m for m in MARGINS if m not in given]:
        cells = _together(cut(smoothed_targets(cells, smoothed)))
    fitted = cut(rake(cells, rounds).withColumn("_ratio", F.try_divide(F.col("raked"), F.col("tokens").cast("double"))))
    top = fitted.agg(F.max("_ratio").alias("_top"))
    rates = fitted.join(F.broadcast(top)).select(*MARGINS, F.coalesce(F.try_divide(F.col("_ratio"), F.col("_top")), F.lit(0.0)).alias("_p"))
    out = rows.join(rates, list(MARGINS), "left")
    p = F.round(F.when(F.col("n_tokens") == 0, 1.0).otherwise(F.coalesce(F.col("_p"), F.lit(0.0))), 9)
    return out.select("doc_id", "source", "lang", "topic", "n_tokens", p.alias("probability"), (uniform("doc_id", seed) < p).alias("selected"), "raw_source", "raw_lang", "text_hash")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang", topic_expr: Column | None = None, goals: dict[str, dict[str, float]] | None = None, rounds: int = ROUNDS, seed: str = SEED) -> DataFrame:
    """One row per document: doc_id, source, lang, topic, n_tokens, probability, selected.

    goals: target share by margin ('source', 'lang', 'topic') and value; a
    margin left out gets tokens to the power 0.7, values left out of a given
    margin get 0.  Expected tokens of a cell are its raked share of one common
    total, the largest for which no probability passes 1.  Null source, lang or
    topic form the value '(none)'.  A document without tokens has probability 1
    (keeping it moves no weight).  The same id is drawn the same way in every
    run, so repeated rows are kept or left together.
    """
    return _drawn(docs, id_col, text_col, source_col, lang_col, topic_expr, goals, rounds, seed).drop("raw_source", "raw_lang", "text_hash")


def draw(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang", **options) -> DataFrame:
    """The rows of docs that mix selects, each by its own id, source, language and text."""
    left = _drawn(docs, id_col, text_col, source_col, lang_col, **options).filter("not selected")
    own, text, source, lang = unused(docs, "id", "text", "source", "lang")
    left = left.select(F.col("doc_id").alias(own), F.col("raw_source").alias(source), F.col("raw_lang").alias(lang), F.col("text_hash").alias(text)).distinct()
    same = docs[id_col].cast("long").eqNullSafe(F.col(own)) & docs[source_col].cast("string").eqNullSafe(F.col(source)) & docs[lang_col].cast("string").eqNullSafe(F.col(lang))
    return docs.join(left, same & (F.xxhash64(docs[text_col].cast("string")) == F.col(text)), "left_anti")


def oracle_sql(rounds: int = ROUNDS) -> str:
    """The same query for DuckDB, one materialised step for each scaling."""
    word = "trim(translate(coalesce(text, ''), chr(10) || chr(13) || chr(9), '   '))"
    steps = [
        f"""docs AS MATERIALIZED (
  SELECT doc_id, coalesce(source, '(none)') AS source, coalesce(lang, '(none)') AS lang,
    CASE WHEN {word} = '' THEN 0 ELSE length(regexp_replace({word}, ' +', ' ', 'g')) - length(replace({word}, ' ', '')) + 1 END AS n_tokens
  FROM documents)""",
        "rows_ AS MATERIALIZED (SELECT *, CASE WHEN n_tokens < 150 THEN 'short' WHEN n_tokens < 600 THEN 'medium' ELSE 'long' END AS topic FROM docs)",
        "cells AS MATERIALIZED (SELECT source, lang, topic, sum(n_tokens) AS tokens FROM rows_ WHERE n_tokens > 0 GROUP BY ALL)",
    ]
    for m in MARGINS:
        steps.append(f"g_{m} AS MATERIALIZED (SELECT {m}, w / sum(w) OVER () AS goal_{m} FROM (SELECT {m}, pow(sum(tokens)::DOUBLE, {SMOOTHING}) AS w FROM cells GROUP BY {m}))")
    steps.append("k0 AS MATERIALIZED (SELECT *, tokens::DOUBLE AS raked FROM cells JOIN g_source USING (source) JOIN g_lang USING (lang) JOIN g_topic USING (topic))")
    k = 0
    for _ in range(rounds):
        for m in MARGINS:
            steps.append(f"k{k + 1} AS MATERIALIZED (SELECT * REPLACE (raked * goal_{m} / sum(raked) OVER (PARTITION BY {m}) AS raked) FROM k{k})")
            k += 1
    steps.append(f"rates AS MATERIALIZED (SELECT source, lang, topic, (raked / tokens) / max(raked / tokens) OVER () AS p FROM k{k})")
    steps.append("out_ AS (SELECT doc_id, source, lang, topic, n_tokens, round(CASE WHEN n_tokens = 0 THEN 1.0 ELSE p END, 9) AS probability FROM rows_ LEFT JOIN rates USING (source, lang, topic))")
    return "WITH " + ",\n".join(steps) + f"\nSELECT *, ('0x' || substr(md5('{SEED}:' || coalesce(doc_id::VARCHAR, 'null')), 1, 13))::BIGINT / {16**13}.0 < probability AS selected FROM out_"
