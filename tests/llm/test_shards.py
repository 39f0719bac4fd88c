import os

import pytest
from pyspark.sql import functions as F

from emberloom.llm import registry
from emberloom.llm.shards import CommitConflict, Shard, ShardStore


def store(spark, tmp_path, schema, **kw):
    return ShardStore(spark, f"file://{tmp_path}/store", schema, **kw)


def rows(df):
    return sorted(map(str, df.collect()))


def test_round_trip_and_versions(spark, tmp_path):
    df = spark.range(5000).selectExpr("id AS doc_id", "repeat(md5(string(id)), 20) AS text", "if(id % 7 = 0, NULL, id) AS extra").repartition(6)
    s = store(spark, tmp_path, df.schema, target_bytes=1 << 20, min_run=3)
    assert s.version() == 0 and s.read().collect() == []
    v = s.append_arrivals(df, F.col("doc_id") % 5)
    assert v == 5 and rows(s.read()) == rows(df)
    assert rows(s.read(version=1)) == rows(df.filter("doc_id % 5 = 0"))
    before = len(s.shards())
    after = s.compact()
    live = s.shards()
    assert after > v and len(live) < before and not s.plan(live)
    assert max(x.bytes for x in live) < 2 * s.target
    assert rows(s.read()) == rows(df)
    assert s.read(shard_col="shard").select("shard").distinct().count() == len(live)
    assert s.read(shard_col="shard").count() == 5000
    assert s.vacuum() > 0 and rows(s.read()) == rows(df) and s.version() == after


def test_commit_is_atomic(spark, tmp_path):
    df = spark.range(3).selectExpr("id AS doc_id")
    s, other = store(spark, tmp_path, df.schema), store(spark, tmp_path, df.schema)
    s.append(df)
    with pytest.raises(CommitConflict):
        other.commit(0, [Shard("nowhere", 1, 0)])
    assert s.version() == 1 and rows(s.read()) == rows(df)


def test_tiers_pack_similar_sizes(spark, tmp_path):
    s = store(spark, tmp_path, spark.range(1).schema, target_bytes=1000, ratio=4.0, min_run=3)
    assert [s.tier(x) for x in (2000, 500, 499, 125, 124, 1)] == [0, 0, 1, 1, 2, 5]
    packs = s.plan([Shard(f"a{i}", 200, 0) for i in range(7)] + [Shard("b", 700, 0), Shard("c", 30, 0)])
    assert [len(p) for p in packs] == [5, 2]


def test_edge_rows(spark, tmp_path):
    data = [(None, None, 1), (1, "", 2), (1, "", 2), (2, "x" * 500_000, None)]
    df = spark.createDataFrame(data, "doc_id long, text string, shard long")
    s = store(spark, tmp_path, df.schema, min_run=2)
    for _ in range(3):
        s.append(df.coalesce(1))
    s.append(df.limit(0))
    s.compact()
    assert rows(s.read()) == rows(df.union(df).union(df))
    assert s.read(shard_col="shard").columns == ["doc_id", "text", "shard", "shard_2"]


def test_null_arrivals_come_first(spark, tmp_path):
    df = spark.createDataFrame([(1, None), (2, 0), (3, None)], "doc_id long, at int")
    s = store(spark, tmp_path, df.schema)
    assert s.append_arrivals(df, df.at) == 2
    assert rows(s.read(version=1)) == rows(df.filter("at IS NULL")) and rows(s.read()) == rows(df)
    assert {x.arrival for x in s.shards()} == {-1, 0}


def test_many_shards_are_numbered_by_shuffle(spark, tmp_path):
    df = spark.range(100).selectExpr("id AS doc_id").repartition(5)
    s, wide = (store(spark, tmp_path, df.schema, broadcast_shards=n) for n in (0, 50))
    s.append(df)
    assert rows(s.read(shard_col="shard")) == rows(wide.read(shard_col="shard"))


def test_packs_are_a_task_each(spark, tmp_path):
    df = spark.range(20_000).selectExpr("id AS doc_id", "repeat(md5(string(id)), 20) AS text").repartition(24)
    s = store(spark, tmp_path, df.schema, target_bytes=1 << 16)
    s.append(df)
    live, packs = s.shards(), s.plan(s.shards())
    assert len(packs) > 4
    s.compact()
    made = [x for x in s.shards() if x not in live]
    assert len({x.path.rpartition("/")[0] for x in made}) == len(made) <= len(packs)  # one file a pack
    assert max(x.bytes for x in s.shards()) < 2 * s.target and rows(s.read()) == rows(df)
    s.remove()
    assert s.version() == 0


def test_query_returns_all_documents_in_shards(spark, sf, tmp_path):
    """The rows are those of documents, also beside columns of the query's own names."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    docs = docs.withColumn("shard", F.lit(-7)).withColumn("Shard_2", F.lit("x")).withColumn("text_md5", F.lit(-7))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = registry.op5_shard_compaction(spark, str(tmp_path))
    assert got.columns == ["doc_id", "shard", "source", "lang", "n_chars", "text_md5"]
    assert rows(got.drop("shard")) == rows(docs.select("doc_id", "source", "lang", "n_chars", F.md5("text").alias("text_md5")))
    assert got.filter("shard IS NULL OR shard < 0").count() == 0


def test_versions_sizes_and_tiers_by_plain_reckoning(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    s = store(spark, tmp_path, docs.schema, target_bytes=1 << 16, min_run=2)
    versions = [s.append(docs.filter(F.pmod(F.col("doc_id"), F.lit(4)) == k).coalesce(1), k) for k in range(4)]
    assert versions == [1, 2, 3, 4] and [len(s.shards(v)) for v in versions] == versions
    end = s.compact()
    assert all(x.bytes == os.path.getsize(x.path.removeprefix("file:")) for x in s.shards(end))
    tiers = [s.tier(x.bytes) for x in s.shards(end)]
    assert all(tiers.count(t) < 2 for t in set(tiers) - {0})
    assert rows(s.read(end)) == rows(docs) == rows(s.read(4))
