"""The queries of the training-data operators and, where SQL can express one, its SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, decontam, langid, licenses, mixing, oracles, toxicity, warc
from .common import free_name, scratch_root
from .neardup import near_duplicates
from .shards import ShardStore
from .substring import substring_dedup

#: The classifier chain's categories, in order, as SQL over `labels`.
TOXICITY_CHAIN = {"low_quality": "quality = 0", "toxic": "toxic = 1"}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup(_table(spark, sf_dir, "documents"), span_words=13, keep_text=False)
    return out.select("doc_id", "n_words", "n_removed", "kept_sha256")


def op2_poisson_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    copy, key = mixing.own_names(docs)  # other columns of documents may have these names
    return mixing.poisson_mix(docs).select("doc_id", "source", F.col(copy).alias("copy"), F.col(key).alias("shuffle_key"), F.md5("text").alias("text_md5"))


def op3_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = warc.resolve_revisits(warc.records_of_pages(_table(spark, sf_dir, "pages")))
    return out.withColumn("headers", F.expr("array_join(transform(headers, e -> concat(e.key, ': ', e.value)), '; ')"))


def op4_multiprobe_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest_neighbours(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op5_shard_compaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    store = ShardStore(spark, f"{scratch_root(spark)}/store-{uuid.uuid4().hex}", docs.schema)
    store.append_arrivals(docs, F.pmod(F.xxhash64("doc_id", "text"), F.lit(8)))
    store.compact()
    store.vacuum()
    shard = free_name("shard", docs.columns)
    return store.read(shard_col="shard").select("doc_id", F.col(shard).alias("shard"), "source", "lang", "n_chars", F.md5("text").alias("text_md5"))


def op6_benchmark_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.find_matches(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    net = langid.train(docs.filter(~langid.held_out()))
    out = langid.identify(docs, net)
    return out.select("doc_id", langid.held_out().alias("held_out"), "lang_pred", "score")


def op8_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_table(spark, sf_dir, "documents"), shingle_words=4)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    chain = toxicity.train_chain(docs, _table(spark, sf_dir, "labels"), TOXICITY_CHAIN)
    return toxicity.score(docs, chain).withColumnRenamed("rejected", "toxic")


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files of source trees: every tenth is a licence file, in turn at the
    top, in a package or in a module."""
    docs = _table(spark, sf_dir, "documents")
    top, package, module = "coalesce(source, 'none')", "concat('p', doc_id div 7 % 20)", "concat('m', doc_id div 11 % 10)"
    folder = f"CASE WHEN doc_id % 10 <> 0 OR doc_id div 10 % 3 = 2 THEN concat_ws('/', {top}, {package}, {module}) WHEN doc_id div 10 % 3 = 1 THEN concat_ws('/', {top}, {package}) ELSE {top} END"
    name = "if(doc_id % 10 = 0, concat('LICENSE-', doc_id), concat('f', doc_id, '.txt'))"
    out = licenses.scan_licenses(docs.withColumn("path", F.expr(f"concat({folder}, '/', {name})")), windows=True)
    return out.withColumn("score", F.round("score", 9))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    ops = (op1_substring_dedup, op2_poisson_mix, op3_revisits, op4_multiprobe_knn, op5_shard_compaction, op6_benchmark_matches, op7_language_id, op8_near_duplicates, op9_toxicity, op10_licenses)
    return {f.__name__: f for f in ops}


def oracle_sql() -> dict[str, str]:
    return {
        "op1_substring_dedup": oracles.SUBSTRING,
        "op2_poisson_mix": mixing.ORACLE,
        "op3_revisits": warc.ORACLE,
        "op8_near_duplicates": oracles.NEAR_DUPLICATES,
        "op10_licenses": oracles.LICENSES,
    }
