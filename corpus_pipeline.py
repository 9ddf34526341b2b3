"""The corpus pipeline: documents, judged, deduplicated, decontaminated, mixed and written as token ids.

Each stage reads what the stage before it wrote. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from grainflow.llm.common import read, workspace, written
from grainflow.llm.decontaminate import clean_documents
from grainflow.llm.mixing import Mix
from grainflow.llm.quality import Classifier
from grainflow.llm.simhash_dedup import near_distinct
from grainflow.llm.token_output import read_tokens, write_tokens

TOKENIZER, END_ID = "word_bpe_49k.json", 2


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject: a score of 0.3 or more, as in op9. A null text is an empty one; equal texts
    score alike; an empty table stays empty."""
    return Classifier(docs, read(spark, sf_dir, "labels")).kept(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: SimHash fingerprints of five-word shingles meet in tries, and the sets of shingles are alike to 0.8. The
    smallest doc_id stays, null ids last; of repeated rows one. Texts without words are one group."""
    return near_distinct(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item, not a re-parameterised one either. Null texts hold none; rows with the same doc_id, a null one too, go together."""
    return clean_documents(docs, read(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The words that the mix takes, a row for each document and round through its source's blocks. Texts without words give no rows, a null source is
    the last one, repeated rows are taken one by one."""
    return Mix(docs).texts(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids in byte planes; returned as read back from the files: doc_id, start, n_tokens, ids_crc32."""
    folder = workspace(spark, "pipeline_tokens")
    write_tokens(docs, folder, TOKENIZER, end_id=END_ID)
    return read_tokens(spark, folder)


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("mixing", mixing), ("tokens", tokens)]

#: SQL has neither the classifier nor the tokenizer; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each written and read again, over documents."""
    docs, folder = read(spark, sf_dir, "documents"), workspace(spark, "pipeline")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
