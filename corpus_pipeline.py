"""Documents to training sequences: quality rules, line and near de-duplication, mixing, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept. All but
the last return the columns of ``docs``:

* quality rules drop the documents that fail the base rule or a learned rule;
* line de-duplication shortens texts (and counts n_chars anew), rows stay;
* SimHash near-de-duplication keeps one document of each group connected by pairs whose
  five-word shingles have a Jaccard similarity of 0.8 or more, checked on the texts;
* mixing keeps every row and puts the rows into the order of the schedule;
* packing cuts the texts, in runs of that order, into sequences of at most 4096 tokens.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from shotline.llm import lines, mixing, packing, rules, simhash
from shotline.llm.common import stored, table

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return rules.kept_documents(docs, rules.fit(docs, table(spark, sf_dir, "labels")))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return lines.deduplicated_documents(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.representatives(docs, words=5, similarity=0.8)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_documents(docs)


def sequence_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs, TOKENIZER)


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("simhash near-dedup", near_dedup),
    ("source mixing", source_mixing),
    ("sequence packing", sequence_packing),
]

#: No stage can be said in SQL: learned rules, hash neighbourhoods, components, a schedule, a tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packed pieces of the documents, every stage written and read again."""
    docs = table(spark, sf_dir, "documents")
    for number, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES) - 1:
            docs = stored(docs, f"stage-{number}")
    return docs
