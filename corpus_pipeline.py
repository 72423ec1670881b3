"""The training-data pipeline: five stages over ``documents``.

Each stage takes (spark, docs, sf_dir) and gives a DataFrame, which is written
and read again as the next one's docs. All but the last keep the columns of
``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quiverine.llm import langid, packing, pii, simhash, substring
from quiverine.llm.common import checkpoint, read, work_path
from quiverine.session import ship
from quiverine.sources.tables import remove


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told; those without a letter, or less like any language than held-out documents are, go."""
    ship(spark)
    return langid.keep_identified(docs, least=None)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: fingerprints at three bits, or 0.8 of the shingles of five words shared."""
    ship(spark)
    return simhash.near_dedup(docs, shingle=5, distance=3, similarity=0.8)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages of 35 words or more that stand elsewhere too."""
    ship(spark)
    return substring.substring_dedup(docs, length=35)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with personal data under pseudonyms."""
    ship(spark)
    return pii.mask_documents(docs, finds=None)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' pieces and their places in sequences of 1024 tokens."""
    ship(spark)
    return packing.pack_documents(docs, packing.vocabulary("byte_bpe_50k.json"))


STAGES = [
    ("language ID", language),
    ("SimHash near-dedup", near_duplicates),
    ("substring dedup", repeated_passages),
    ("PII", personal_data),
    ("best-fit packing", pack),
]

#: Kernel classifiers, fingerprints by XXH64 and tokenizers are beyond SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage gives is written to the shared folder, read again, and removed after its last reader.

    Packing, the last, works on pieces that it has written itself, so nothing
    of the stages before is left when it is done.
    """
    docs = read(spark, sf_dir, "documents")
    before: str | None = None
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            path = work_path(spark, f"stage-{k}")
            docs = checkpoint(docs, path=path)
        if before:
            remove(spark, before)
        before = path
    return docs
