"""The corpus pipeline: toxicity, exact dedup, near dedup, mixing, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as
Parquet and read again as the next stage's docs.  All but the last return the columns
of their input, whatever other columns it has.  An empty table passes through all of
them; long texts are taken whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rillframe.llm import bpe, exact_dedup, mixing, near_dup, toxicity
from rillframe.llm.common import Workspace, read_table
from rillframe.llm.queries import tokenizer_path


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects (score of 0.5 or more) go; rows without an id or text are judged like any other."""
    labels = read_table(spark, sf_dir, "labels").select("doc_id", "toxic").where(~toxicity.held_out(F.col("doc_id")))
    return toxicity.reject(docs, toxicity.fit(docs, labels))


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts (a null one is empty) the row with the largest doc_id stays, one of repeated rows, and one without an id where none has one."""
    return exact_dedup.drop_copies(docs, keep="high")


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each near-duplicate group the document with the smallest doc_id stays.

    Rows of one id go or stay together; rows without an id take no part and stay.
    """
    gone = near_dup.near_duplicates(docs).where("doc_id <> component_id").select("doc_id")
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, in the order of the mix; rows without an id and repeated ids are ordered by the columns SMALL."""
    return mixing.interleave(docs, spread=SMALL)


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256, source, and slot and place of the mix.

    A table that is read in parallel loses the order of its files, so every token row
    carries its place: the mix of the same rows is the same again.  The encoded rows are
    written first, because the mix reads its rows more than once.
    """
    carried = {f"c_{c}": F.col(c) for c in SMALL}
    rows = Workspace(spark, "tokens").keep(bpe.bpe_encode(docs, tokenizer_path(), digests=True, carry=carried), "encoded")
    mixed, names = mixing.mix(rows, source_col="c_source", spread=list(carried))
    return mixed.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256", F.col("c_source").alias("source"), names["slot"], names["place"])


#: Columns of documents, without the text, that place a row of a null or repeated id in the mix.
SMALL = ["doc_id", "lang", "source", "n_chars"]

STAGES = [
    ("toxicity", toxicity_stage),
    ("exact_dedup", exact_stage),
    ("simhash", near_stage),
    ("mixing", mixing_stage),
    ("bpe", bpe_stage),
]

#: The classifier and the tokenizer have no SQL form; tests/llm/test_pipeline.py compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each but the last is written to the shared folder and read again."""
    ws = Workspace(spark, "pipeline")
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = ws.keep(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
