"""From raw documents to encoded, deduplicated and mixed training text.

Each stage takes (spark, docs, sf_dir) and works on all rows that the one before kept; all but
the last return the columns of `docs`, with the values that they had, but for the cleaned text
and its length. Rows that share a doc_id are rows of their own.

Defined cases, of all stages: a null or empty text, or one of fewer than 50 words, is rejected by
the first; what follows still takes such rows, as equal to each other, and encodes them as no ids.
Repeated rows are copies, of which one stays. A long text is never cut. Users' columns may have
any names, as the operators keep theirs apart; only the last stage's own columns replace columns
of the same name. An empty table passes through all stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gridwright.llm import exact_dedup, mixing, quality_rules, sentencepieces, similar
from gridwright.llm.common import cut


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go; of the others, lines that fail go. Page furniture is looked for as whole words."""
    return quality_rules.cleaned_documents(docs, whole_phrases=True)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One of equal documents stays."""
    return exact_dedup.drop_copies(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays that pairs of a similarity of 0.8 link, by shingles of five words."""
    return similar.drop_similar(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources by weight: small ones repeat, up to four epochs, and the largest give a part."""
    return mixing.mixed_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their token ids."""
    import public_tokenizers

    return sentencepieces.encode(docs, public_tokenizers.path(sentencepieces.MODEL))


STAGES = [("quality rules", rules), ("exact dedup", exact), ("simhash near-dedup", near), ("mixing", mix), ("sentencepiece", encode)]

#: XXH64 and a piece model are beyond SQL; tests hold the rows against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = cut(docs, f"pipeline-{i}")
    return docs
