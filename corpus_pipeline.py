"""A corpus pipeline: five stages over documents, each on all that the one before kept.

Language ID drops the documents it rejects; SimHash keeps the document with
the least id of each group of near-duplicates; decontamination drops the
documents that the contamination rule names and cuts passages of 13 words and
more from the others; personal data are replaced by their kind; the rest is
encoded. Every stage but the last returns the columns of documents. Rows go
through the operators as they are, so but for the near-duplicates no text is
shuffled. Run as a whole, each stage's rows are written to the shared checkpoint
folder and read again; a stage's rows are removed when the next one's are
written.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracemill.llm import byte_bpe, language_id, pii, simhash, suffix_automaton
from tracemill.llm.common import read, remove, shared_folder
from tracemill.llm.queries import PATTERN, RANKS

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


ROW = "__tracemill_document"  # a name that no input has


def _rows(docs: DataFrame) -> DataFrame:
    """The documents with their columns once more as one value, which operators take as the id and give back."""
    return docs.select(*COLUMNS, F.struct(*COLUMNS).alias(ROW))


def languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return language_id.identify(_rows(docs), id_col=ROW, fold_col="doc_id").filter(~F.col("rejected")).select(f"{ROW}.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_one(docs.select(*COLUMNS)).select(*COLUMNS)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    text = F.col("text")
    docs = docs.select(*COLUMNS).withColumn(ROW, F.length("text"))
    clean = suffix_automaton.cleaned(docs, read(spark, sf_dir, "benchmark"))
    return _counted(clean, F.length(text) != F.col(ROW))


def _counted(docs: DataFrame, changed: Column) -> DataFrame:
    """n_chars anew where the text has changed."""
    return docs.withColumn("n_chars", F.when(changed, F.length("text").cast("bigint")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = pii.detect(_rows(docs), id_col=ROW).select(f"{ROW}.*", "all_spans")
    clean = found.withColumn("text", F.when(F.size("all_spans") > 0, pii.redacted(F.col("text"), F.col("all_spans"))).otherwise(F.col("text")))
    return _counted(clean, F.size("all_spans") > 0)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return byte_bpe.encode_and_decode(docs, RANKS, PATTERN)


STAGES = [("language ID", languages), ("SimHash near-dedup", near_duplicates), ("benchmark decontamination", decontamination), ("PII", personal_data), ("byte-level BPE", encoding)]

#: No stage but the last two could be put into SQL; tests hold the pipeline against a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for i, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{i}")
        docs = spark.read.parquet(f"{folder}/{i}")
        if i:
            remove(spark, f"{folder}/{i - 1}")
    return docs
