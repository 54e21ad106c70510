"""The corpus pipeline: five stages over documents, each written as Parquet and read again.

Every stage but the last returns the columns of documents; the last returns the packed pieces.

Defined cases, of every stage: a null text is an empty one, which the quality rules reject as too short; if it comes to a
later stage it stays (one of all empty texts past near-dedup), holds no passage and no secret, and packs as the closing
token. Null ids are rows like others; of near-duplicates a null id is the least. Rows equal in id and text are one
document after near-dedup, and separate ones in the other stages. Ties in near-dedup go to the least id. Texts are taken
whole, however long. Empty tables give empty results, an empty benchmark flags nothing. Extra columns pass through every
stage but the last, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trailmill.llm import decontaminate, packing, quality_rules, secret_scan, simhash
from trailmill.llm.common import staged, table

#: Rows of a batch of whole texts. Spark's own bound is by bytes, 64 MB, and holds such a batch several times over.
ROWS_PER_BATCH = 1_000


def _texts(docs: DataFrame) -> DataFrame:
    """The documents, in a session whose batches for Python are smaller, unless it was given a number of its own."""
    conf, key = docs.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if conf.get(key) == "10000":
        conf.set(key, str(ROWS_PER_BATCH))
    return docs


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    judged, q = quality_rules.quality(_texts(docs))
    return judged.where(F.col(q)["kept"]).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: five-word shingles, similarity 0.8."""
    return simhash.distinct_documents(_texts(docs), width=5, similarity=0.8)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    marked, leaks = decontaminate.flagged(_texts(docs), table(spark, sf_dir, "benchmark"))
    return marked.where(~F.col(leaks)).select(*docs.columns)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by their kind; all documents stay."""
    clean = secret_scan.redacted(_texts(docs))
    if "n_chars" in docs.columns:
        clean = clean.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return clean.select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' pieces, packed into sequences."""
    return packing.digest(_texts(docs))


STAGES = [
    ("quality_rules", quality),
    ("simhash_near_dedup", near_duplicates),
    ("decontamination", decontamination),
    ("secret_scan", secrets),
    ("packing", packed),
]

#: SQL has neither the vocabulary nor the fingerprints; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
