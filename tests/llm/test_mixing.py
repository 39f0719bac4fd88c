import duckdb
import pytest

from emberloom.llm.mixing import ORACLE, poisson_mix, source_rates


def test_same_as_sql(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = sorted(tuple(r) for r in poisson_mix(docs).selectExpr("doc_id", "source", "copy", "shuffle_key", "md5(text)").collect())
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    assert got == sorted(con.sql(ORACLE).fetchall())


def test_means_and_global_order(spark):
    df = spark.range(6000).selectExpr("id AS doc_id", "if(id % 3 = 0, 'a', 'b') AS source", "'t' AS text")
    out = poisson_mix(df, weights={"a": 1.0, "b": 1.0}, target_rows=400_000).collect()
    n = {s: sum(r.source == s for r in out) for s in "ab"}
    assert abs(n["a"] - 200_000) < 2500 and abs(n["b"] - 200_000) < 2500  # means 100 and 50: several parts
    keys = [r.shuffle_key for r in out]
    assert keys == sorted(keys)
    one, other = (poisson_mix(df, seed=k).groupBy("doc_id").agg({"copy": "max"}).collect() for k in (1, 2))
    assert sorted(one) != sorted(other)


def test_edge_rows(spark):
    rows = [(None, None, "x", 1), (1, None, None, 1), (2, "a", "", 2), (2, "a", "", 2), (3, "b", "y " * 50_000, 3)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string, copy long")
    out = poisson_mix(df, target_rows=5000)
    assert out.columns == ["doc_id", "source", "text", "copy", "copy_2", "shuffle_key"]
    by = {(r.doc_id, r.source): 0 for r in out.collect()}
    assert set(by) == {(None, None), (1, None), (2, "a"), (3, "b")}
    assert out.filter("doc_id = 2").groupBy("copy_2").count().filter("count <> 2").count() == 0
    assert poisson_mix(df, weights={"a": 1.0, "b": 0.0}).filter("source <> 'a' OR source IS NULL").count() == 0
    assert poisson_mix(spark.createDataFrame([], df.schema)).collect() == []


def test_rates_add_up_to_the_target(spark):
    df = spark.range(100).selectExpr("id AS doc_id", "if(id < 90, 'a', 'b') AS source")
    got = source_rates(df, temper=0.5, target_rows=1000).collect()
    assert sum(r.n * r.rate for r in got) == pytest.approx(1000)


def test_many_sources_are_shuffled_to_the_same_rows(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    cols = ["doc_id", "copy", "shuffle_key"]
    assert poisson_mix(docs, broadcast_sources=0).select(cols).collect() == poisson_mix(docs).select(cols).collect()


def test_null_ids_are_told_apart_by_text(spark):
    df = spark.createDataFrame([(None, "a", f"t{i}") for i in range(200)], "doc_id long, source string, text string")
    assert len({r.shuffle_key for r in poisson_mix(df).collect()}) > 100


def test_query_beside_columns_of_its_own_names(spark, sf, tmp_path):
    from pyspark.sql import functions as F

    from emberloom.llm import registry

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    docs.withColumns({c: F.lit(-7) for c in ("copy", "Shuffle_Key", "copy_2", "rate", "text_md5", "a.b")}).write.parquet(f"{tmp_path}/documents.parquet")
    got, want = registry.op2_poisson_mix(spark, str(tmp_path)), registry.op2_poisson_mix(spark, sf)
    assert got.columns == want.columns and got.collect() == want.collect()
