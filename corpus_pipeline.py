"""A corpus from raw documents to token files, one operator after another."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mendwell.llm import decontaminate, mixing, near_dups, token_files, toxicity
from mendwell.llm.common import stored, table
from mendwell.llm.queries import tokenizer_file


def detoxify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that aren't predicted toxic, learnt from the labels of those that aren't held out."""
    scorer = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.scored(docs, scorer).filter("predicted = 0").select(*docs.columns)


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: five-word shingles, similarity 0.8."""
    return near_dups.without_near_duplicates(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of the benchmark."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as a mix of the sources takes them, once for each time and with the words taken."""
    return mixing.Mix(docs).texts().withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of all documents, read back."""
    return token_files.read_token_files(token_files.write_token_files(docs, tokenizer_file()))


STAGES = [("toxicity", detoxify), ("near_dups", deduplicate), ("decontaminate", decontaminated), ("mixing", mix), ("token_files", encode)]

# Models, components and encodings have no SQL form; each stage is tested against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each reads what the one before it has written."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stored(docs, f"pipeline-{name}")
    return docs
