"""The corpus pipeline: documents in, token ids of the clean ones out.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
stage's docs. All but the last return the columns of documents, in their order, with whatever other columns docs has.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from pagewright.llm import bpe, decontaminate, jaccard, language, lines
from pagewright.llm.queries import table, vocabulary
from pagewright.session import delete_folder, ensure_checkpoint_dir

#: SQL has neither the language profiles nor the vocabulary's merges; the tests hold run() against brute force.
ORACLE_SQL = None


def identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is identified; the others go, among them null, empty and letterless texts. Rows are judged
    each by its own text, so equal rows stay or go together, and a null id or label changes nothing. Of languages that
    are equally near neither is identified. An empty table stays empty."""
    return language.keep_identified(docs)


def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that the corpus has too often; ones left without a line go. Null texts and texts that
    were empty before stay, rows of one id count as one document, null ids as one after all others; an empty table
    stays empty."""
    return lines.drop_repeated_lines(docs)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the least id, of each group of near duplicates. Null ids, null and wordless texts stay, all
    rows of an id stay or go; an empty table stays empty."""
    return jaccard.keep_one(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item. Null and empty texts stay; rows are judged each by its own text; an empty
    table stays empty."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and token_ids of every row: null ids for a null text, none for an empty one; null ids of
    documents and repeated rows are carried along; an empty table gives no rows."""
    return bpe.encode(docs, vocabulary())


STAGES = [
    ("language_id", identified),
    ("line_dedup", without_repeated_lines),
    ("near_duplicates", one_of_each_group),
    ("decontamination", decontaminated),
    ("bpe", encoded),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other; what goes between them is written to the shared folder, and deleted when the stage that
    reads it has been written (the last, which the result reads, stays)."""
    folder = f"{ensure_checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs.write.parquet(f"{folder}/{k}-{name}")
            docs = spark.read.parquet(f"{folder}/{k}-{name}")
            if k:
                delete_folder(spark, f"{folder}/{k - 1}-{STAGES[k - 1][0]}")
    return docs
