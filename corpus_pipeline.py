"""A training-corpus pipeline of the operators in ``quillstone.llm``.

Each stage takes (spark, docs, sf_dir) and gives a DataFrame; all but the last keep the columns of documents.

Cases, for every stage: an empty table gives an empty one; rows without an identifier, with null in any column, with an
empty or a very long text, repeated rows and further columns are taken as the stage's operator says, none of them fails;
tables of labels or benchmark items that are empty or hold nulls reject nothing by what they don't say.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillstone.llm import decontaminate, mixing, quality, simhash, tokens
from quillstone.llm.common import table, through_disk


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression classifier rejects go.  It learns from the labelled ones among its input; without
    labels of both kinds it knows the labelled share of good texts only, and keeps all or none by that (all without any)."""
    return quality.keep_good(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents alike by 0.8 or more in five-word shingles the one with the smallest identifier stays,
    once if it is repeated; documents without an identifier stay, those without a word are alike."""
    return simhash.keep_one(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go, also of one without an identifier; those without a word stay."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mixing_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are sampled so that the tokens of sources, languages and topics stand in the target proportions; null or
    unlisted values are sampled as one."""
    return mixing.mix(docs)


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left is tokenized and written as shards; a row tells of each document where its ids stand.  Documents without
    an identifier come first, null texts have the end id only."""
    return tokens.read_shards(tokens.write_shards(docs, tokens.tokenizer_path()))


STAGES = [
    ("quality classifier", quality_classifier),
    ("SimHash near-dedup", simhash_near_dedup),
    ("benchmark decontamination", benchmark_decontamination),
    ("mixing sources to target weights", mixing_sources),
    ("token-ID / binary output", token_output),
]

#: The classifier and the tokenizer can't be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each stage's rows written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = through_disk(stage(spark, docs, sf_dir), name.replace(" ", "-").replace("/", ""))
    return STAGES[-1][1](spark, docs, sf_dir)
