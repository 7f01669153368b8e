"""From raw documents to sharded training rows: five stages over the documents table.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; `run` writes each result as Parquet
to the shared folder and hands it, read again, to the next stage.  An empty table goes through all stages
empty; columns beyond those of documents pass.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from trussline.llm import decontaminate, mixing, quality, sharding, simhash
from trussline.llm.common import materialize, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or the boosted trees reject go.  Null, empty and short texts fail the base rules;
    without labels only these decide; repeated rows are judged alike."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five-word shingles, similarity 0.8) stays, that with the smallest
    doc_id.  Equal rows are copies, of which one stays; a null doc_id comes last; texts without words are one group."""
    return simhash.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which a benchmark window occurs go.  Null and wordless texts stay; so do all with an empty benchmark."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as its fitted rate says, none times included.  Wordless texts have rate 1; without labels
    all have; equal rows share the decision."""
    return mixing.mix(docs, table(spark, sf_dir, "labels"))


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row's shard and its slot in it, in place of columns of these names.  Null doc_ids and repeated rows are placed
    like others."""
    return sharding.shard_documents(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("SimHash near-dedup", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("mixing sources to target weights", mixture),
    ("sharding", shards),
]

#: The trees, fingerprints and fitted rates have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir))
    return docs
