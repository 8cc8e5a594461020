"""The corpus pipeline: quality, exact copies, near copies, mixing, packing.

Each stage takes (spark, docs, sf_dir) and works on all documents that the stage before it kept. Null texts count as
empty, null sources are one source, null doc_ids are the smallest; columns of any other name pass through, whatever
they are called; no documents give no rows.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from antecede.llm.common import settled, table
from antecede.llm.exact_dedup import without_copies
from antecede.llm.mixing import mixed_documents
from antecede.llm.packing import pack
from antecede.llm.quality import good_documents
from antecede.llm.queries import WORDS
from antecede.llm.similar import without_near_copies


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go. Equal texts fare alike; without labels of both kinds all stay."""
    return good_documents(docs, table(spark, sf_dir, "labels"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest doc_id stays; of rows equal in both, one."""
    return without_copies(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (similarity of five-word shingles of 0.8 or more) the row with the smallest doc_id stays."""
    return without_near_copies(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: never, once or twice. One without words has its source's whole copies and no other."""
    return mixed_documents(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The places of all pieces in sequences; a document that the mix repeats has as many copies of each."""
    return pack(docs, public_tokenizers.path(WORDS))


STAGES = [("quality", quality), ("exact", exact), ("near", near), ("mix", mix), ("pack", packed)]

#: The classifier is fitted, and tokens come from a library, so SQL can't say it; the tests hold each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        # A stage's own tables go when what it gives is written.
        docs = settled(spark, name, lambda stage=stage, docs=docs: stage(spark, docs, sf_dir))
    return docs
