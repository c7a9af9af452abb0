"""Corpus preparation in five stages, each over all that its predecessor kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last
return the columns of ``documents``. ``run`` writes each stage's rows as Parquet
and reads them again for the next.

For all stages: a null or empty text is clean, has no passages and no personal data
and stays as it is; rows with null or repeated ids are judged by themselves; texts of
any length are taken whole; columns of any name and null values in them are carried
along; an empty table gives an empty one. What a stage adds to that is said there.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from hushdex.llm import bpe, fmindex, nearjoin, pii, toxicity
from hushdex.llm.common import read_table, saved, ship


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity scorer does not reject. Without labels of both kinds
    none is rejected."""
    return toxicity.without_toxic(docs, read_table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked texts: that with the smallest id, a null one
    last; of rows that agree in id and text one. Texts without words are in no group
    and all stay."""
    ship(spark)
    return nearjoin.one_of_each(docs)


def cut_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, benchmark passages cut out of their texts; n_chars follows, and is
    left alone where nothing was cut."""
    return fmindex.decontaminated(docs, read_table(spark, sf_dir, "benchmark"))


def redact_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by the names of their kinds; n_chars follows
    where something was replaced."""
    ship(spark)
    return pii.redacted(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, with digests of the ids and of the decoded text; no
    ids for a null or empty text."""
    ship(spark)
    # Shorter chunks than the operator's own: the workers have served four stages before.
    return bpe.bpe_roundtrip(docs, public_tokenizers.path("byte_bpe_50k.json"), keep_ids=True, chunk_chars=8_000_000)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", cut_benchmark),
    ("pii", redact_pii),
    ("bpe", encode),
]

#: The stages learn models and follow links; SQL does not express them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, from the table ``documents``."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
