"""From raw documents to a mixed, sharded training corpus: five stages over `documents`.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; its result is
written as Parquet and read again as the next one's docs. All but the last return
the columns of documents, extra ones of any name among them. An empty table gives an
empty result in every stage.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberloom.llm import decontam, mixing, neardup, shards, toxicity
from emberloom.llm.common import columns, free_name, remove, scratch_root, stage_path
from emberloom.llm.registry import TOXICITY_CHAIN

#: SQL cannot express trained classifiers, MinHash groups or file sizes; tests/llm/test_pipeline.py holds each stage to a plain version.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier chain rejects as toxic go. The chain learns from
    the labelled ones among docs. Null and empty texts have the score of the intercepts; rows
    without an id are judged like others, repeated rows alike; without labels nothing goes."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.clean(docs, toxicity.train_chain(docs, labels, TOXICITY_CHAIN))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays, that of the smallest id; of rows that
    repeat an id and its text one stays. Rows without an id are nobody's duplicate and all stay,
    as do null and empty texts."""
    groups = neardup.near_duplicates(docs, shingle_words=5)
    row, gone = free_name("row", docs.columns), free_name("gone", docs.columns)
    others = groups.filter(~F.col("kept")).select(F.col("doc_id").alias(gone)).distinct()
    left = docs.join(others, F.col("doc_id") == F.col(gone), "left_anti")
    left = left.withColumn(row, F.when(F.col("doc_id").isNull(), F.monotonically_increasing_id()))
    return left.dropDuplicates(["doc_id", "text", row]).drop(row)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, up to a quarter of its words edited, go. Null and
    empty texts hold none; null items and items without words are in no document."""
    return decontam.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Poisson copies by source, sources weighing their size to the power 0.7, in a global random
    order. Null is a source; null and empty texts are copied like others; rows without an id are
    told apart by their text."""
    return mixing.poisson_mix(docs).drop(*mixing.own_names(docs)).select(*columns(docs))


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Eight arrivals of small shards, compacted by size tiers; the rows as they are, nulls and
    repeated rows too, with their shard's number in the column shard (shard_2 and so on if
    documents has such a column)."""
    store = shards.ShardStore(spark, f"{scratch_root(spark)}/corpus-{uuid.uuid4().hex}", docs.schema)
    store.append_arrivals(docs, F.pmod(F.xxhash64("doc_id", "text"), F.lit(8)))
    store.compact()
    store.vacuum()
    return store.read(shard_col="shard")


STAGES = [("toxicity", drop_toxic), ("near_duplicates", drop_near_duplicates), ("decontamination", drop_benchmark_leaks), ("mixing", mix_sources), ("sharding", shard)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, a written table between each two, which goes once the next stage has written its own."""
    docs, held = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for k, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            path = stage_path(spark, f"pipeline-{name}")
            out.write.option("compression", "zstd").parquet(path)
            out = spark.read.schema(out.schema).parquet(path)
        else:
            path = None  # the rows of the last stage are in its store
        if held:
            remove(spark, held)
        docs, held = out, path
    return docs
