"""The corpus pipeline: quality rules, near-duplicate removal, redaction of personal
data, mixing to source targets, packing into sequences.

``STAGES`` lists (name, function); each function takes (spark, docs, sf_dir) and returns
a DataFrame that is written as Parquet and read again as the next one's ``docs``. All but
the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkselect.llm import near_duplicates, packing, personal_data, quality_rules, source_mixing
from sparkselect.llm.common import table, written


#: Similarity of word shingles, in percent, from which the pipeline takes documents for copies.
#: The 85 of op8_minhash_near_dedup is that query's alone.
COPY_PERCENT = 80


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no rule of the current policy rejects."""
    return quality_rules.passing(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, by the operator's b-bit MinHash."""
    return near_duplicates.without_copies(docs, COPY_PERCENT)


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every found span replaced by its kind; n_chars follows the new text."""
    clean = personal_data.redact(docs, personal_data.fit(docs))
    if "n_chars" in docs.columns:
        clean = clean.withColumn("n_chars", F.length("text").cast("long"))
    return clean


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, so that sources come near their targets."""
    return source_mixing.mixed(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their sequence and offset."""
    return packing.pack(packing.pieces(docs))


STAGES = [
    ("quality_rules", keep_quality),
    ("minhash_near_dedup", drop_near_copies),
    ("personal_data", redact_personal_data),
    ("source_mixing", mix_sources),
    ("best_fit_packing", pack_sequences),
]

#: DuckDB SQL for run()'s rows; redaction, mixing and packing have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = written(docs, f"pipeline-{name}")
    return docs
