"""Corpus pipeline: stages over documents, each written as Parquet and reread by the next.

Quality rules and toxicity drop the documents they reject, near-duplicates keep the first
document of each group, secret scans replace live-looking secrets in the texts, and packing
cuts what is left into training sequences. All stages but the last return the columns of
documents, whatever their names. Rows are told apart by themselves, not by doc_id, so null
or repeated ids do no harm. An empty table gives an empty table at every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from thresher.llm.common import cut, drop_cut, packed, table
from thresher.llm.packing import pack
from thresher.llm.quality_rules import judge
from thresher.llm.secrets import redact
from thresher.llm.simhash import alike
from thresher.llm.toxicity import score, train

TOXIC = 0.3
#: Jaccard similarity of the sets of five-word shingles from which on texts are near-duplicates.
SIMILAR = 0.8


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that pass the base rule and that the label model finds good. A null text has no words and goes; repeated rows go or stay together."""
    return judge(packed(docs), id_col="row").where("kept").select("doc_id.*")


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that score below TOXIC. It learns from the labelled among docs; without usable labels nothing goes. A null text scores as an empty one."""
    weights = train(docs, table(spark, sf_dir, "labels"))
    return score(packed(docs), weights, id_col="row").where(F.col("score") < TOXIC).select("row.*")


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the first met, of each group of near-duplicates; repeated rows are such a group, and so are all texts without words."""
    numbered = cut(packed(docs).withColumn("uid", F.monotonically_increasing_id()), "dedup-docs")
    found = alike(numbered, id_col="uid", size=5, least=SIMILAR)
    # The ids that go are fewer than those that stay.
    gone = cut(found.where(F.col("node") != F.col("root")).select(F.col("node").alias("uid")), "dedup-gone")
    drop_cut(found)
    return numbered.join(gone, "uid", "left_anti").select("row.*")


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with live-looking secrets replaced and n_chars, where there is such a column, counted anew. A null text stays null, and so does its n_chars."""
    found = redact(docs)
    return found.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else found


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece of each document in its training sequence. A null text is empty and packs as the closing id alone."""
    return pack(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("toxicity", toxicity),
    ("simhash_near_dedup", simhash_near_dedup),
    ("secret_scans", secret_scans),
    ("packing", packing),
]
#: The posterior, the classifier and the tokenizer are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for number, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES) - 1:
            docs = cut(docs, name)
    return docs
