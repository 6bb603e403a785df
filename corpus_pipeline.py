"""Corpus pipeline: toxicity, near duplicates, secrets, mixing, packing.

Every stage takes (spark, docs, sf_dir) and works on all documents that its
predecessor kept.  All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickweave.llm import mixing, ngram_join, packing, secrets, toxicity
from tickweave.llm.common import as_given, read, scratch_path, unused
from tickweave.llm.queries import TOKENIZER


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity models reject go; every row is judged by its own text."""
    model = toxicity.train(docs, read(spark, sf_dir, "labels"))
    (verdict,) = unused(docs, "verdict")
    return docs.withColumn(verdict, toxicity.scores(model, F.col("text"))).filter(F.col(verdict)["score"] < 0.5).drop(verdict)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every class of near duplicates the document with the least doc_id stays."""
    return ngram_join.keep_one(docs)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Found secrets are replaced in the texts; all documents stay, n_chars follows the new text."""
    kinds = [r.kind for r in secrets.BASE_RULES]
    findings, _ = secrets.scan_versions(docs, "doc_id", "text")
    # spans belong to the text, so its digest alone finds them, also for rows without an id
    blob, *found = unused(docs, "blob", *kinds)
    marked = findings.filter(F.greatest(*[F.size(k) for k in kinds]) > 0).select(F.col("blob").alias(blob), *[F.col(k).alias(f) for k, f in zip(kinds, found, strict=True)]).dropDuplicates([blob])
    rows = docs.withColumn(blob, F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256))
    joined = rows.join(marked, blob, "left")
    text = F.when(F.col(found[0]).isNull(), F.col("text")).otherwise(secrets.redact(F.col("text"), found))
    n_chars = F.when(F.col(found[0]).isNull(), F.col("n_chars")).otherwise(F.length(text)).cast("long")
    return as_given(joined.withColumn("n_chars", n_chars).withColumn("text", text), docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents drawn with the probabilities of the raked weights."""
    return mixing.draw(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row per piece of at most 1024 tokens; a null or empty text gives one piece that holds the end id."""
    pieces = packing.pack(docs, TOKENIZER)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_join", drop_near_duplicates),
    ("secret_scan", redact_secrets),
    ("source_mixing", mix_sources),
    ("packing", pack_sequences),
]

#: Models, signatures and token ids are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and reread by the next; no documents give no rows."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
