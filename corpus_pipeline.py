"""From raw documents to packed training sequences.

Each stage takes (spark, docs, sf_dir) and works on all rows that the stage before kept. Toxic documents go first, then those
that fail the quality rules, then all but one document of each near-duplicate group; what stays is cut and packed.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colloquy.llm import packing, quality, simhash, similar, toxicity
from colloquy.llm.shared import components, written


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/labels.parquet")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression classifier scores below its threshold."""
    classifier = toxicity.fit(docs, labels(spark, sf_dir))
    return toxicity.score(docs, classifier).where(F.col("score") < toxicity.THRESHOLD).select(*docs.columns)


def drop_bad(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the isolation forest."""
    forest = quality.fit_forest(docs, labels(spark, sf_dir))
    return quality.judge_quality(docs, forest).where("kept").select(*docs.columns)


def groups(docs: DataFrame) -> DataFrame:
    """doc_id and component_id (the smallest doc_id reachable, itself included) for every document.

    Texts that share 0.8 or more of their five-word shingles are linked. Candidates come from Golay keys of SimHash fingerprints (within 3 bits, one
    document a fingerprint and group) and from keys of least hashes, since fingerprints alone find few of the pairs (figures in the README); the
    similarity is computed on the texts of both. A document without an id belongs to a group of the second kind.
    """
    found = written(similar.near_duplicates(docs).select("doc_id", "component_id"), "by_shingles")
    prints = simhash.with_fingerprints(docs.select("doc_id", "text")).where("doc_id is not null").select("doc_id", "fp")
    nodes = written(prints.join(found.distinct(), "doc_id").groupBy("fp", "component_id").agg(F.min("doc_id").alias("node")), "fingerprints")
    hubs = nodes.groupBy("fp").agg(F.min(F.struct("node", "component_id")).alias("hub")).select("fp", "hub.*")
    equal = nodes.join(hubs.select("fp", F.col("node").alias("a")), "fp").where("a <> node").select("a", F.col("node").alias("b"))
    ends = [hubs.select(F.col("fp").alias(x), F.col("node").alias(f"{x}_node"), F.col("component_id").alias(f"{x}_group")) for x in "ab"]
    near = simhash.links(hubs.select("fp")).join(ends[0], "a").join(ends[1], "b").where("a_group <> b_group").select(F.col("a_node").alias("a"), F.col("b_node").alias("b"))
    pairs = written(equal.unionByName(near).select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")), "candidates")
    asked = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    texts = docs.join(asked, docs["doc_id"] == asked["node"]).groupBy("node").agg(F.min("text").alias("text"))
    by_shingles = found.select(F.col("doc_id").cast("long").alias("a"), F.col("component_id").cast("long").alias("b"))
    roots = components(similar.verified(pairs, texts, similar.SHINGLE, similar.SIMILARITY).unionByName(by_shingles))
    return found.join(roots, F.col("doc_id") == F.col("node"), "left").select("doc_id", F.coalesce("root", "component_id").alias("component_id"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of texts that share 0.8 or more of their five-word shingles."""
    return simhash.one_of_each(docs, groups).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents and their places in sequences."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("toxicity", drop_toxic), ("quality_rules", drop_bad), ("near_dedup", drop_copies), ("packing", pack)]
#: The classifier, the forest, fingerprints and the linear program are beyond SQL; tests compare with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = written(docs, name)
    return docs
