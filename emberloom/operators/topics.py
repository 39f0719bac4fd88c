"""Topic modelling: class-based TF-IDF, vocabularies, centroids, and clusters of mutual neighbours."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranking import top_per_group
from .search import neighbours


def vocabulary(docs: DataFrame, id_col: str, tokens: Column, max_features: int = 5000, min_df: int = 2, max_df: float = 0.95) -> DataFrame:
    """(token, total, df): tokens in min_df documents or more and at most the share max_df, the
    most frequent max_features (ties by name)."""
    n = docs.count()
    # Occurrences and first occurrences side by side, so that what is shuffled is the vocabulary.
    mark = lambda df: lambda x: F.struct(x.alias("token"), F.lit(1 - df).alias("tf"), F.lit(df).alias("df"))
    rows = docs.filter(F.col(id_col).isNotNull()).select(F.explode(F.concat(F.transform(tokens, mark(0)), F.transform(F.array_distinct(tokens), mark(1)))).alias("x")).select("x.*")
    stats = rows.groupBy("token").agg(F.sum("tf").alias("total"), F.sum("df").alias("df"))
    return stats.filter((F.col("df") >= min_df) & (F.col("df") <= max_df * n)).orderBy(F.desc("total"), "token").limit(max_features)


def class_tfidf(docs: DataFrame, topic: str, tokens: Column, k: int = 10, vocab: DataFrame | None = None) -> DataFrame:
    """(topic, token, weight, rank): tf of the token in the topic's text times ln(1 + A / f), A the
    mean number of words of a topic and f the token's count in all (Grootendorst 2022)."""
    rows = docs.select(F.col(topic).alias("topic"), F.explode(tokens).alias("token"))
    if vocab is not None:
        rows = rows.join(vocab.select("token"), "token", "left_semi")
    counts = rows.groupBy("topic", "token").agg(F.count("*").alias("tf")).checkpoint()  # read three times, the texts once
    totals = counts.groupBy("topic").agg(F.sum("tf").alias("words"))
    mean = totals.agg(F.avg("words")).first()[0] or 0.0
    freq = counts.groupBy("token").agg(F.sum("tf").alias("f"))
    w = counts.join(totals, "topic").join(freq, "token").select("topic", "token", (F.col("tf") / F.col("words") * F.log(1 + F.lit(float(mean)) / F.col("f"))).alias("weight"))
    n = F.row_number().over(Window.partitionBy("topic").orderBy(F.desc("weight"), "token"))
    return w.withColumn("rank", n).filter(F.col("rank") <= k)


def cluster_members(df: DataFrame, cluster: str, name: str, ordinal: str, first: int = 5) -> DataFrame:
    """(cluster, size, representatives): the first few members in ordinal order. The member list
    in long form is df itself, in the order of (cluster, ordinal)."""
    heads = top_per_group(df.select(cluster, name, ordinal), cluster, [ordinal], first)
    heads = heads.groupBy(cluster).agg(F.array_sort(F.collect_list(F.struct("rank", F.col(name).alias("name")))).alias("m"))
    sizes = df.groupBy(cluster).agg(F.count("*").alias("size"))
    return sizes.join(heads, sizes[cluster].eqNullSafe(heads[cluster])).select(sizes[cluster], "size", F.transform("m", lambda x: x["name"]).alias("representatives"))


def centroids(df: DataFrame, cluster: str, vec_col: str) -> DataFrame:
    """(cluster, i, x): the mean of each component, in long form."""
    return df.select(cluster, F.posexplode(F.col(vec_col).cast("array<double>")).alias("i", "x")).groupBy(cluster, "i").agg(F.avg("x").alias("x"))


def mutual_neighbour_clusters(df: DataFrame, id_col: str, vec_col: str, k: int = 5, least: int = 5) -> DataFrame:
    """(id, cluster_id, confidence), one row for each id: connected components of the graph of mutual k nearest
    neighbours; components of fewer than `least` rows are -1 with null confidence. A cluster is
    numbered by its smallest id; confidence is the mean similarity to the row's mutual neighbours.

    Minimum labels with pointer jumping over checkpointed tables; only a count is collected."""
    near = neighbours(df, k=k, id_col=id_col, vec_col=vec_col).select("query_id", "id", "score").checkpoint()
    back = near.select(F.col("id").alias("query_id"), F.col("query_id").alias("id"))
    edges = near.join(back, ["query_id", "id"])
    nodes = df.select(F.col(id_col).cast("long").alias("id")).filter("id IS NOT NULL").distinct()  # labels of an id that repeats would multiply in each round
    labels = nodes.withColumn("label", F.col("id")).checkpoint()
    while True:
        best = edges.join(labels, "id").groupBy("query_id").agg(F.min("label").alias("near"))
        hop = labels.select(F.col("id").alias("label"), F.col("label").alias("far"))
        step = labels.join(best.withColumnRenamed("query_id", "id"), "id", "left").join(hop, "label", "left")
        new = step.select("id", F.least("label", "near", "far").alias("label"), F.col("label").alias("old")).checkpoint()
        labels = new.select("id", "label")
        if not new.filter("label < old").limit(1).count():
            break
    sizes = labels.groupBy("label").agg(F.count("*").alias("size"))
    own = edges.groupBy(F.col("query_id").alias("id")).agg(F.avg("score").alias("confidence"))
    out = labels.join(sizes, "label").join(own, "id", "left")
    kept = F.col("size") >= least
    return out.select("id", F.when(kept, F.col("label")).otherwise(-1).alias("cluster_id"), F.when(kept, F.col("confidence")).alias("confidence"))
