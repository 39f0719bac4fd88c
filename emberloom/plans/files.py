"""Queries that go through files: what a sink writes, a source reads back."""

from __future__ import annotations

import json

from pyspark.sql import functions as F
from pyspark.sql import types as S

from ..operators import names, serving
from ..sources import readers, writers
from ..streaming import cdc, queue
from .registry import query, table_of
from .scratch import fresh_folder


@query("SELECT n_nationkey, n_name FROM nation")
def json_document(spark, sf):
    rows, path = table_of(spark, sf, "nation").select("n_nationkey", "n_name"), fresh_folder(spark, "json")
    writers.write_json_document(rows, path, order="n_nationkey")
    return readers.json_entries(spark, path, rows.schema)


@query("SELECT r_regionkey::VARCHAR AS key, r_name FROM region")
def json_map(spark, sf):
    rows, path = table_of(spark, sf, "region"), fresh_folder(spark, "map")
    entries = F.map_from_entries(F.collect_list(F.struct(F.col("r_regionkey").cast("string"), F.struct("r_name"))))
    rows.agg(F.to_json(F.struct(entries.alias("clusters"))).alias("value")).write.text(path)
    return readers.json_map(spark, path, rows.select("r_name").schema)


@query("SELECT r_regionkey, r_name FROM region")
def source_chain(spark, sf):
    """The first source is missing and the second damaged."""
    rows, path = table_of(spark, sf, "region").select("r_regionkey", "r_name"), fresh_folder(spark, "chain")
    writers.put_bytes(spark, f"{path}/damaged.parquet", b"no table")
    writers.write_table(rows, f"{path}/whole.parquet")
    sources = [(f"{path}/{n}.parquet", spark.read.schema(rows.schema).parquet) for n in ("missing", "damaged", "whole")]
    return readers.first_of(spark, sources, rows.schema)


@query("SELECT s_suppkey, s_name, s_acctbal FROM supplier")
def csv_document(spark, sf):
    rows, path = table_of(spark, sf, "supplier").select("s_suppkey", "s_name", "s_acctbal"), fresh_folder(spark, "csv")
    writers.write_csv(rows, path)
    return readers.csv(spark, path, rows.schema)


@query("SELECT n_nationkey::VARCHAR AS id, n_name AS name, n_nationkey::DOUBLE AS topic, n_regionkey::DOUBLE AS place FROM nation")
def projected_tiers(spark, sf):
    """Vectors and their meta document, written and loaded by position; the JSON tier is not needed."""
    rows, path = table_of(spark, sf, "nation").orderBy("n_nationkey").collect(), fresh_folder(spark, "tiers")
    writers.put_bytes(spark, f"{path}/v.bin", writers.encode_vectors([[r.n_nationkey, r.n_regionkey] for r in rows]))
    meta = {"subspaceDim": 1, "entries": [{"id": str(r.n_nationkey), "name": r.n_name} for r in rows]}
    writers.put_bytes(spark, f"{path}/meta.json", json.dumps(meta).encode())
    out = readers.projected_of_tiers(spark, ["topic", "place"], (f"{path}/v.bin", f"{path}/meta.json"), f"{path}/missing.json")
    return out.select("id", "name", *[F.col(a)[0].cast("double").alias(a) for a in ("topic", "place")])


@query("SELECT n_nationkey::BIGINT AS row, (n_nationkey * 2)::DOUBLE AS a, n_regionkey::DOUBLE AS b FROM nation")
def matrix_tiers(spark, sf):
    """The binary matrix is damaged, the JSON document is read."""
    rows, path = table_of(spark, sf, "nation").orderBy("n_nationkey").collect(), fresh_folder(spark, "matrix")
    writers.put_bytes(spark, f"{path}/m.bin", b"short")
    doc = {"matrix": [[2 * r.n_nationkey, r.n_regionkey] for r in rows], "subspaceDim": 1, "axes": ["a", "b"]}
    writers.put_bytes(spark, f"{path}/m.json", json.dumps(doc).encode())
    m, _, _ = readers.matrix_of_tiers(spark, f"{path}/m.bin", f"{path}/m.json")
    writers.put_bytes(spark, f"{path}/again.bin", writers.encode_matrix(m, 1, 2))
    m, _, _ = readers.matrix_of_tiers(spark, f"{path}/again.bin")
    return spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(m)], "row long, a double, b double")


@query("SELECT r_name AS name, 'number ' || r_regionkey || chr(10) || 'end' AS body FROM region")
def text_files(spark, sf):
    path = fresh_folder(spark, "texts")
    for r in table_of(spark, sf, "region").collect():
        writers.put_bytes(spark, f"{path}/{r.r_regionkey}.txt", f"{r.r_name}\nnumber {r.r_regionkey}\nend\n".encode())
    return readers.text_records(spark, path).select("name", "body")


@query("SELECT n_nationkey, n_name FROM nation WHERE n_nationkey = 7")
def key_lookup(spark, sf):
    rows = table_of(spark, sf, "nation").select("n_nationkey", "n_name")
    return spark.createDataFrame([readers.lookup(rows, "n_nationkey", 7)], rows.schema)


@query("SELECT vec_id, label, round(list_sum(embedding::DOUBLE[]), 6) AS total FROM embeddings")
def vector_dump(spark, sf):
    rows, path = table_of(spark, sf, "embeddings"), fresh_folder(spark, "vectors")
    writers.write_table(rows.select("vec_id", "label", "embedding"), path)
    total = F.aggregate(F.col("embedding").cast("array<double>"), F.lit(0.0), lambda a, x: a + x)
    return readers.table(spark, path).select("vec_id", "label", F.round(total, 6).alias("total"))


@query("SELECT 'kept.bin' AS name, 3::BIGINT AS bytes")
def uploads(spark, sf):
    """Of two artefacts one is missing, which is passed over."""
    path = fresh_folder(spark, "uploads")
    writers.put_bytes(spark, f"{path}/from/a", b"abc")
    done = writers.upload(spark, {"kept.bin": f"{path}/from/a", "gone.bin": f"{path}/from/b"}, f"{path}/to")
    rows = [(n, spark.read.format("binaryFile").load(p).first().length) for n, p in done.items()]
    return spark.createDataFrame(rows, "name string, bytes long")


@query("SELECT c_custkey::VARCHAR AS id, c_name AS name FROM customer WHERE c_custkey % 3 <> 0")
def deleted_rows(spark, sf):
    log = f"{fresh_folder(spark, 'deletions')}/log"
    c = table_of(spark, sf, "customer").select(F.col("c_custkey").cast("string").alias("id"), F.col("c_name").alias("name"))
    writers.insert(c, log, ["name"], "id")
    writers.delete(c.filter("cast(id AS long) % 3 = 0"), log, "id")
    return cdc.list_view(spark.read.schema(cdc.LOG).parquet(log), None).select("id", F.col("payload")["name"].alias("name"))


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)")
def refetched_rows(spark, sf):
    signals = table_of(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return cdc.refetch(signals, table_of(spark, sf, "customer").select("c_custkey", "c_name"), "c_custkey")


@query("SELECT c_custkey::VARCHAR AS id, CASE c_custkey % 8 WHEN 0 THEN 3 ELSE 1 END AS retries, c_custkey % 8 = 0 AS discarded FROM customer WHERE c_custkey % 4 = 0")
def retry_queue(spark, sf):
    """Jobs of customers; every fourth fails always, half of these are tried four times, the others once."""
    q = queue.RetryQueue(spark, fresh_folder(spark, "retries"))
    c = table_of(spark, sf, "customer").select(F.col("c_custkey").cast("string").alias("id"), F.col("c_name").alias("job"))
    handle = lambda jobs: jobs.withColumn("ok", F.col("id").cast("long") % 4 != 0)
    q.enqueue(c.filter("cast(id AS long) % 8 = 0"))
    for _ in range(4):
        q.drain(handle)
    q.enqueue(c.filter("cast(id AS long) % 8 <> 0"))
    q.drain(handle)
    return q.waiting().withColumn("discarded", F.lit(False)).unionByName(q.discarded().withColumn("discarded", F.lit(True))).select("id", "retries", "discarded")


def _length(name: str) -> tuple[int, int]:
    if name == "BUILDING":
        raise LookupError(name)
    return len(name), 1


@query("SELECT DISTINCT c_mktsegment AS search_name, CASE WHEN c_mktsegment = 'BUILDING' THEN 0 ELSE length(c_mktsegment) END AS records, c_mktsegment = 'BUILDING' AS failed FROM customer WHERE c_mktsegment IS NOT NULL")
def cached_lookups(spark, sf):
    """Looked up in two flushes, then all from the cache."""
    c, path = table_of(spark, sf, "customer").select(F.col("c_mktsegment").alias("search_name")), fresh_folder(spark, "lookups")
    names.cached_lookups(c, path, _length, flush_every=3)

    def never(name: str) -> tuple[int, int]:
        raise AssertionError("asked twice")

    return names.cached_lookups(c, path, never).select("search_name", "records", F.col("error").isNotNull().alias("failed"))


@query("SELECT n_nationkey, n_nationkey >= 15 AS held FROM nation")
def result_cache(spark, sf):
    """First in, first out: reading the oldest entry does not keep it."""
    cache, rows = serving.ResultCache(capacity=10), table_of(spark, sf, "nation").select("n_nationkey").orderBy("n_nationkey").collect()
    for r in rows:
        cache.put(str(r.n_nationkey), r.n_nationkey)
        cache.get("0")
    schema = S.StructType([table_of(spark, sf, "nation").schema["n_nationkey"], S.StructField("held", S.BooleanType())])
    return spark.createDataFrame([(r.n_nationkey, cache.get(str(r.n_nationkey)) is not None) for r in rows], schema)
