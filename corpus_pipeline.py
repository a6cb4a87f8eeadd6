"""The corpus pipeline: five stages over ``documents``, each written and read again.

toxicity -> near-duplicates -> benchmark decontamination -> secrets -> packing.
Every stage works on all that its predecessor kept; all but the last return the
columns of ``documents``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernstone.llm import op02_toxicity, op03_decontamination, op05_secrets, op07_near_dedup, op10_packing
from quernstone.llm.common import cut, forget, forget_since, made, shared_dir, ship, table


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on labelled documents of this input, doesn't call toxic.

    Null and empty texts have the score of the bias; repeated rows stay or go
    alike; without labels of both kinds all stay unless toxic is the rule.
    """
    ship(spark)
    return op02_toxicity.filtered(docs, op02_toxicity.train(docs, table(spark, sf_dir, "labels")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one with the smallest id.

    Rows that repeat an id and its text are one document, of which the row whose
    other columns come first stays.  Rows of one id and different texts are
    documents of their own.  Rows without an id, null and empty texts are linked
    with nothing; all such rows stay but repeats of an id.
    """
    ship(spark)
    hashed = docs.select("doc_id", F.xxhash64("text").alias("h"))
    repeated = cut(hashed.groupBy("doc_id").agg(F.count("*").alias("n"), (F.min("h") != F.max("h")).alias("differ")).filter("n > 1 and doc_id is not null").select("doc_id", "differ"))
    if repeated.isEmpty():
        gone = op07_near_dedup.near_duplicates(docs).filter("not kept").select("doc_id").distinct()
        return docs.join(gone.hint("shuffle_hash"), "doc_id", "left_anti").select(docs.columns)
    marked = docs.join(repeated.hint("shuffle_hash"), "doc_id", "left")
    # a row of an ambiguous id is known by its text too
    keyed = cut(marked.withColumn("_key", F.when(F.col("differ"), F.xxhash64("doc_id", "text")).otherwise(F.col("doc_id").cast("long"))))
    gone = op07_near_dedup.near_duplicates(keyed, "_key").filter("not kept").select(F.col("doc_id").alias("_key")).distinct()
    kept = keyed.join(gone.hint("shuffle_hash"), "_key", "left_anti")
    once = kept.filter("differ is null").select(docs.columns)
    rest = [c for c in docs.columns if c not in ("doc_id", "text")]
    again = kept.filter("differ is not null").groupBy("doc_id", "text").agg(F.min(F.struct(*rest)).alias("_rest")) if rest else kept.filter("differ is not null").select("doc_id", "text").distinct()
    return once.unionByName(again.select(*[F.col(f"_rest.{c}").alias(c) if c in rest else F.col(c) for c in docs.columns]))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that copy no test item; null and empty texts copy none, repeated rows stay or go alike."""
    ship(spark)
    return op03_decontamination.filtered(docs, table(spark, sf_dir, "benchmark"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets replaced by a placeholder and n_chars renewed; null texts stay null, texts without a secret and their n_chars as they are."""
    ship(spark)
    return op05_secrets.redact(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in the training sequences; a null or empty text is its end token, each repeated row is packed."""
    ship(spark)
    return op10_packing.pack_documents(docs)


STAGES = [("toxicity", toxicity), ("near_dedup", near_dedup), ("decontamination", decontamination), ("secrets", secrets), ("packing", packing)]

#: Classifier, alignment and automata can't be expressed in SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage returns is written to the shared folder and read again.

    A stage's checkpoints and its predecessor's output go once its own output is
    written; what the last stage reads stays, as its result is not yet read.
    """
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    before = None
    for k, (name, stage) in enumerate(STAGES):
        mark = made()
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs.write.parquet(f"{folder}/{name}")
            docs = spark.read.parquet(f"{folder}/{name}")
            forget_since(spark, mark)
            if before:
                forget(spark, [before])
            before = f"{folder}/{name}"
    return docs


def queries() -> dict:
    return {"pipeline": run}


def oracle_sql() -> dict:
    return {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}
