"""The training-data pipeline: each stage works on what its predecessor kept of the documents.

All stages but the last return the columns of documents; the last adds size, source_size, target and
taken. Stage inputs are whatever the caller reads (Parquet between stages); ``run`` writes them below
the shared folder. SQL cannot express these stages.

Odd rows, in every stage: a null text counts as an empty one and stays null where the row stays; texts of any
length are read whole; a null doc_id, lang, source or n_chars is a value like any other; further columns are carried,
whatever their names (but for those that the last stage adds, which replace the caller's); an empty table gives an empty
one. Rows that are equal, and ties, per stage:

- toxicity: equal texts get equal scores and go or stay together. A score of exactly one half goes. Empty texts
  have the score of the bias.
- near_dedup: one row of each group of texts with a similarity of PERCENT or more stays, that with the least id
  (an id beats null; of several texts of that id the one with the least hash). Texts without a word all stay.
- decontamination: equal texts go or stay together; empty ones stay.
- secrets: every row is redacted by itself; of overlapping findings the first, then the longest, gives its kind.
- mixing: equal rows are packed one after the other; which of them gets which share is no one's choice but is the
  same in every run.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.llm import decontam, mixing, neardup, secrets, toxicity
from quillgraph.llm.common import Scratch, table

#: Near copies share four fifths of their five-word shingles.
PERCENT = 80


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a score below one half; the model is trained on the labelled ones outside the held-out fifth."""
    found = toxicity.scored(spark, docs, table(spark, sf_dir, "labels"), "__toxicity")
    return found.where(F.col("__toxicity") < 0.5).select(docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, that with the smallest id."""
    return neardup.deduplicated(spark, docs, PERCENT)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item and are not most of one."""
    found = decontam.marked(spark, docs, table(spark, sf_dir, "benchmark"), "__contaminated", whole=True)
    return found.where(~F.col("__contaminated")).select(docs.columns)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets replaced by their kind."""
    return secrets.redact(spark, docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with the words that the mix takes of each (taken; 0 for those not drawn)."""
    return mixing.taken(spark, docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("secrets", redact_secrets),
    ("mixing", mix_sources),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch, docs = Scratch(spark, "pipeline"), table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = scratch.save(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
