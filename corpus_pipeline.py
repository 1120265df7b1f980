"""From documents to token ids: five stages, each written as Parquet and reread by the next.

Defined cases, for every stage: a null text counts as empty; an empty table gives an empty
one with the same columns; columns that a stage doesn't know are kept as they are, whatever
their names (the last stage returns its own); a null doc_id is kept and judged by its text;
rows that repeat are judged one by one, but for near-dedup, where one of them stays; a very
long text is one task's work. What the stages decide on ties stands with each.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from barloom.llm import decontaminate, pieces, quality, secrets, similar
from barloom.llm.common import shared_dir, spread, table

#: The stages train, group and match by algorithms that SQL can't express.
ORACLE_SQL = None


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line classifier rejects go (a score of exactly 0.5 stays; so does all without labels)."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of texts with a Jaccard similarity of 0.8 over five-word shingles the document with the smallest id stays.

    Texts without words are one group. Of rows with the same smallest id one stays. Candidates are texts with near
    SimHashes: within four bits all with all, and within 28 bits, as pairs at 0.8 need, in blocks of texts that share
    a min-wise key. They are compared exactly.
    """
    return similar.keep_one(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark passage go (none does without a benchmark)."""
    return decontaminate.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark, overlapping ones by one; every document stays, a null text stays null."""
    return secrets.redact(docs)


def tokens_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts become piece ids, with a digest of the text decoded from them; an empty text has no ids."""
    return pieces.encode(docs)


STAGES = [
    ("quality classifier", quality_stage),
    ("simhash near-dedup", near_dedup_stage),
    ("benchmark decontamination", decontamination_stage),
    ("secret scans", secrets_stage),
    ("sentencepiece encoding and decoding", tokens_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to the documents of ``sf_dir``."""
    docs = spread(table(spark, sf_dir, "documents"))
    for k, (_, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        path = f"{shared_dir(spark)}/pipeline-{k}-{uuid.uuid4().hex}"
        out.write.parquet(path)
        docs = spark.read.schema(out.schema).parquet(path)
    return docs
