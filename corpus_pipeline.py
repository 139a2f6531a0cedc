"""The training-data pipeline: five stages over ``documents``.

``STAGES`` lists (name, function); each function takes (spark, docs, sf_dir)
and works on all that the stage before kept. The first four return the
remaining documents with all their columns; the last returns the mix. ``run``
writes every stage as Parquet into the shared checkpoint folder and reads it
again as the input of the next.

1. toxicity: documents with a score of 0.5 or more go. The score learns from
   the labelled documents with crc32(doc_id) mod 5 != 0.
2. exact dedup: of equal texts (white space apart) the longest original stays.
3. n-gram Jaccard join: of each group linked by 5-word shingles at 0.8 or more
   the smallest doc_id (null last) stays, of equal ids one row.
4. benchmark decontamination: documents that hold ten consecutive words of a
   benchmark item (or a whole shorter item) go.
5. mixing: token budgets by domain, language and source; see
   ``remuneria.llm.mix_budget`` for the columns.

Every stage decides by row: rows that share a doc_id, or have none, are told
apart by their text. Nulls, blank texts, empty tables and extra columns are
handled as the operators' docstrings say.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from remuneria.llm import block_names, jaccard_orders, mix_budget, toxic_channel, winnow
from remuneria.llm.common import id_bucket, table
from remuneria.session import Scratch

SHINGLE_WORDS, SIMILARITY_PERCENT = 5, 80


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return docs.filter(toxic_channel.toxicity(docs, table(spark, sf_dir, "labels"), id_bucket(5) != 0) < 0.5)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return block_names.without_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard_orders.without_near_copies(docs, SHINGLE_WORDS, SIMILARITY_PERCENT)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return winnow.without_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mix_budget.mix_sources(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact dedup", drop_copies),
    ("n-gram Jaccard join", drop_near_copies),
    ("benchmark decontamination", drop_contaminated),
    ("mixing sources to target weights", mix),
]

#: The learned toxicity score can't be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = scratch.save(stage(spark, docs, sf_dir))
    return docs
