"""Mixing sources to target weights by Poisson replication. Native: DataFrame functions only.

A source of n rows and weight w is to give target_rows * w / (sum of weights)
rows, a mean repetition of that over n. Each document's number of copies inverts
the Poisson distribution of that mean at a uniform number taken from the MD5 of
its id and the seed, so it depends on nothing else and can be computed again by
any executor. Means over `PART` are sums of independent parts of at most PART, which
keeps exp(-mean) far from underflow. The copies are exploded and put in the global
order of a second hash.

Without weights, sources weigh their row count to the power `temper`.

The global order is dealt out by the leading digits of that hash, which is spread
evenly, so no pass over the rows looks for the partitions' bounds.

Defined results: null is a source of its own; a source without a weight, or of
weight 0 or less, gives no rows; a null id hashes as the text, or as nothing if that
is null too; rows that repeat an id get the same number of copies; null and empty
texts are copied like any other; all columns of docs pass through, also those with
names of the operator's own: `copy` and `shuffle_key` are then numbered (copy_2);
an empty table gives an empty result.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column, free_name, stage_table

PART = 32
#: So many sources at most (some 10 MB) are broadcast with their rates; more are joined by shuffle.
BROADCAST_SOURCES = 10_000


def source_rates(docs: DataFrame, source_col: str = "source", weights: dict | None = None, temper: float = 0.7, target_rows: int | None = None) -> DataFrame:
    """(source, n, rate): the mean number of copies of a row of each source. docs is read once."""
    n = stage_table(docs.groupBy(column(source_col).alias("source")).agg(F.count("*").alias("n")), "mix-sources")
    if weights is None:
        n = n.withColumn("w", F.pow(F.col("n").cast("double"), F.lit(float(temper))))
    else:
        given = F.lit(0.0)
        for k, v in weights.items():
            given = F.when(F.col("source").eqNullSafe(F.lit(k)), F.lit(float(v))).otherwise(given)
        n = n.withColumn("w", F.greatest(given, F.lit(0.0)))
    sum_w, sum_n = n.agg(F.sum("w"), F.sum("n")).first()
    target = sum_n if target_rows is None else target_rows
    return n.select("source", "n", (F.col("w") / F.lit(sum_w or 1.0) * F.lit(target or 0) / F.col("n")).alias("rate"))


def own_names(docs: DataFrame) -> tuple[str, str]:
    """What the columns copy and shuffle_key are called beside those of docs."""
    return free_name("copy", docs.columns), free_name("shuffle_key", docs.columns)


def poisson_mix(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", weights: dict | None = None, temper: float = 0.7, target_rows: int | None = None, seed: int = 42, broadcast_sources: int = BROADCAST_SOURCES) -> DataFrame:
    """docs' columns, copy (from 1) and shuffle_key (see own_names), in the order of shuffle_key."""
    copy, key = own_names(docs)
    own = {x: f"{x}_{uuid.uuid4().hex}" for x in ("source", "parts", "cdf", "n", "at")}
    parts = F.ceil(F.col("rate") / PART).cast("int")
    rates = source_rates(docs, source_col, weights, temper, target_rows).filter("rate > 0").withColumn("parts", parts).withColumn("mean", F.col("rate") / F.col("parts"))
    # P(X <= k) for k = 0 .. PART + 12 * sqrt(PART) + 20; beyond it lies less than 2 ** -53.
    last = PART + int(12 * PART**0.5) + 20
    cdf = F.expr(f"aggregate(sequence(1, {last}), struct(exp(-mean) AS p, array(exp(-mean)) AS c), (a, k) -> struct(a.p * mean / k AS p, array_append(a.c, element_at(a.c, -1) + a.p * mean / k) AS c), a -> a.c)")
    rates = rates.select(F.col("source").alias(own["source"]), F.col("parts").alias(own["parts"]), cdf.alias(own["cdf"]))
    if rates.count() <= broadcast_sources:
        rates = F.broadcast(rates)
    text = f"cast(`{text_col}` AS string), " if text_col in docs.columns else ""
    name = f"coalesce(cast(`{id_col}` AS string), {text}'')"
    uniform = f"conv(substr(md5(concat({name}, '|', j, '|{seed}')), 1, 13), 16, 10) / 4503599627370496D"
    n = F.expr(f"aggregate(transform(sequence(1, {own['parts']}), j -> {uniform}), 0, (s, u) -> s + size(filter({own['cdf']}, c -> c <= u)))")
    out = docs.join(rates, column(source_col).eqNullSafe(F.col(own["source"]))).withColumn(own["n"], n).filter(F.col(own["n"]) > 0)
    out = out.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(own["n"]))))
    out = out.withColumn(key, F.expr(f"substr(md5(concat({name}, '#', {copy}, '#{seed}')), 1, 16)"))
    # The first 7 of the 16 digits, as a share of their range, name the partition.
    count = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    at = F.floor(F.conv(F.substring(key, 1, 7), 16, 10).cast("long") * count / (1 << 28)).cast("int")
    return out.withColumn(own["at"], at).repartitionById(count, own["at"]).drop(*own.values()).sortWithinPartitions(key)


#: The same for DuckDB over `documents`, with the default parameters.
ORACLE = f"""
WITH RECURSIVE n AS (SELECT source, count(*) AS n, pow(count(*)::DOUBLE, 0.7::DOUBLE) AS w FROM documents GROUP BY source),
t AS (SELECT sum(w) AS sw, sum(n) AS sn FROM n),
r AS (SELECT source, (w / sw * sn / n)::DOUBLE AS rate FROM n, t),
m AS (SELECT source, ceil(rate / {PART}) AS parts, rate / ceil(rate / {PART}) AS mean FROM r WHERE rate > 0),
c(source, parts, mean, k, p, cdf) AS (
  SELECT source, parts, mean, 0, exp(-mean), exp(-mean) FROM m
  UNION ALL SELECT source, parts, mean, k + 1, p * mean / (k + 1), cdf + p * mean / (k + 1) FROM c WHERE k < {PART + int(12 * PART**0.5) + 20}),
l AS (SELECT source, max(parts)::INT AS parts, list(cdf ORDER BY k) AS cdfs FROM c GROUP BY source),
d AS (
  SELECT d.doc_id, d.source, md5(d.text) AS text_md5, coalesce(d.doc_id::VARCHAR, d.text, '') AS name, list_sum(list_transform(range(1, l.parts + 1), lambda j:
    len(list_filter(l.cdfs, lambda x: x <= ('0x' || substr(md5(coalesce(d.doc_id::VARCHAR, d.text, '') || '|' || j || '|42'), 1, 13))::BIGINT / 4503599627370496::DOUBLE))))::INT AS copies
  FROM documents d JOIN l ON d.source IS NOT DISTINCT FROM l.source),
e AS (SELECT doc_id, source, text_md5, name, unnest(range(1, copies + 1))::INT AS "copy" FROM d WHERE copies > 0)
SELECT doc_id, source, "copy", substr(md5(name || '#' || "copy" || '#42'), 1, 16) AS shuffle_key, text_md5 FROM e
"""
