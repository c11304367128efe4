"""A corpus pipeline of five stages; each stage's result is written as Parquet and read again as the next one's documents."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldlark.llm import decontaminate, language_id, minhash_dedup, packing, pii_surrogates
from fieldlark.llm.common import delete, plain_names, secret_key, shared_dir, table, written

#: A document stays if its language's posterior is this many times that of a draw among the languages.
LEAST_LIFT = 1.25


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without letters and those whose language is as good as drawn by lot; learns from a bounded sample of the rows that have a language."""
    model = language_id.learn(docs)
    if not model.languages:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    found = language_id.identify(docs, model, names=("_lang_pred", "_score"))
    sure = F.col("_score") >= min(1.0, LEAST_LIFT / len(model.languages))
    return found.where((F.col("_lang_pred") != "und") & sure).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of each group that comes first in the table, at five words and a similarity of 0.8.

    Rows are told apart by a number of their own, so rows with null or repeated ids are compared like any other,
    of equal rows one stays, and two unlike texts under one doc_id are two documents.
    """
    rows, named = plain_names(docs)
    rows = written(rows.withColumn("number", F.monotonically_increasing_id()))
    gone = minhash_dedup.near_duplicates(rows, doc_id="number", text=named["text"]).where("not kept").select(F.col("doc_id").alias("number"))
    kept = rows.join(gone.hint("shuffle_hash"), "number", "left_anti")
    return kept.select(*[F.col(n).alias(c) for c, n in named.items()])


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item within its edit budget."""
    return decontaminate.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def replace_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Puts surrogates in place of personal data; the number of characters is made anew."""
    out = pii_surrogates.replace_entities(docs, pii_surrogates.Surrogates(secret_key(spark)))
    chars = F.when(F.col("n_entities") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return out.withColumn("n_chars", chars).select(*docs.columns) if "n_chars" in docs.columns else out.select(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences: the end product."""
    return packing.pack(docs)


STAGES = [
    ("language_id", identify_language),
    ("minhash_dedup", drop_near_duplicates),
    ("decontamination", drop_benchmark_leaks),
    ("pii", replace_personal_data),
    ("packing", pack_sequences),
]

#: SQL cannot express these stages; tests/llm hold each against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each stage's rows are written to the shared folder; a stage's input goes when its output is complete."""
    docs, root, held = table(spark, sf_dir, "documents"), f"{shared_dir(spark)}/pipeline/{uuid.uuid4().hex}", None
    for k, (name, stage) in enumerate(STAGES[:-1]):
        path = f"{root}/{k}_{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if held:
            delete(spark, held)
        held = path
    return STAGES[-1][1](spark, docs, sf_dir)
