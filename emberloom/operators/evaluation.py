"""Retrieval metrics, probing, bootstrap intervals and the sparse baseline."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .search import scored


def precision_at_k(near: DataFrame, labels: DataFrame, k: int = 5, id_col: str = "id", label_col: str = "label") -> DataFrame:
    """(query_id, precision) from neighbours (query_id, id): hits of the query's label over k,
    however many were found. A query without a label (null) is left out; rows without one
    stay candidates."""
    own = labels.filter(F.col(label_col).isNotNull()).select(F.col(id_col).alias("query_id"), F.col(label_col).alias("own"))
    other = labels.select(F.col(id_col).alias("id"), F.col(label_col).alias("other"))
    joined = near.join(own, "query_id").join(other, "id", "left")
    return joined.groupBy("query_id").agg((F.sum(F.when(F.col("own") == F.col("other"), 1).otherwise(0)) / F.lit(float(k))).alias("precision"))


def mean_precision(per_query: DataFrame) -> DataFrame:
    return per_query.agg(F.avg("precision").alias("precision"), F.count("*").alias("n"))


def mean_reciprocal_rank(ranking: DataFrame, labels: DataFrame, id_col: str = "id", label_col: str = "label") -> DataFrame:
    """(mrr, n) from a full ranking: the rank of the first row of the query's label, itself
    apart; 0 if there is none."""
    own = labels.select(F.col(id_col).alias("query_id"), F.col(label_col).alias("own"))
    other = labels.select(F.col(id_col).alias("id"), F.col(label_col).alias("other"))
    hit = ranking.filter("query_id <> id").join(own, "query_id").join(other, "id")
    w = Window.partitionBy("query_id").orderBy("rank")
    ranked = hit.withColumn("r", F.row_number().over(w))
    first = ranked.groupBy("query_id").agg(F.min(F.when(F.col("own") == F.col("other"), F.col("r"))).alias("r"))
    return first.agg(F.avg(F.coalesce(1 / F.col("r"), F.lit(0.0))).alias("mrr"), F.count("*").alias("n"))


def folds(df: DataFrame, label: str, id_col: str, k: int) -> DataFrame:
    """Stratified folds: rows of a class in order of id, dealt out in turn."""
    n = F.row_number().over(Window.partitionBy(label).orderBy(id_col))
    return df.withColumn("fold", (n - 1) % k)


def probe(df: DataFrame, vec_col: str, label: str, id_col: str = "id", most_folds: int = 5, c: float = 1.0) -> dict:
    """Stratified cross-validated accuracy of a multinomial logistic regression:
    {accuracy, std, n, classes, folds}; 0 with a note where it cannot be measured."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector

    rows = df.filter(F.col(label).isNotNull() & F.col(vec_col).isNotNull())
    counts = rows.groupBy(label).count().orderBy(label).collect()
    n = sum(r["count"] for r in counts)
    k = min([most_folds, *(r["count"] for r in counts)]) if counts else 0
    out = {"accuracy": 0.0, "std": 0.0, "n": n, "classes": len(counts), "folds": k}
    if len(counts) < 2 or k < 2:
        return out | {"note": "needs two classes of two rows"}
    number = F.create_map(*[F.lit(x) for i, r in enumerate(counts) for x in (r[label], float(i))])
    rows = folds(rows, label, id_col, k).select("fold", array_to_vector(F.col(vec_col).cast("array<double>")).alias("features"), number[F.col(label)].alias("y")).cache()
    scores = []
    for f in range(k):
        train = rows.filter(F.col("fold") != f)
        size = n - n // k
        model = LogisticRegression(labelCol="y", family="multinomial", regParam=1 / (c * size), standardization=False, maxIter=100).fit(train)
        scores.append(model.transform(rows.filter(F.col("fold") == f)).agg(F.avg((F.col("prediction") == F.col("y")).cast("double"))).first()[0])
    rows.unpersist()
    return out | {"accuracy": float(np.mean(scores)), "std": float(np.std(scores))}


def bootstrap_interval(values: DataFrame, value_col: str = "precision", id_col: str = "query_id", resamples: int = 1000, alpha: float = 0.025, seed: int = 42) -> DataFrame:
    """(mean, lo, hi, n): percentile interval of the mean. A resample gives each row a Poisson
    weight from a hash of its (integer) id, the resample and the seed, so all resamples are one
    pass: a partition gives one partial sum for each. lo and hi are the means of rank
    int(alpha * n) and int((1 - alpha) * n); a resample without any row has the mean NaN, which ranks
    last. Without rows all is null."""
    terms = np.exp(-1.0) / np.cumprod([1.0, *range(1, 12)])
    below, r = np.cumsum(terms), np.arange(resamples, dtype=np.int64)

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        vw, w, n = np.zeros(resamples), np.zeros(resamples), 0
        for pdf in batches:
            n += len(pdf)
            for a in range(0, len(pdf), 1024):
                ids, v = pdf["id"].to_numpy(np.int64)[a : a + 1024], pdf["v"].to_numpy(float)[a : a + 1024]
                own = np.searchsorted(below, _uniform(ids[:, None], r[None, :], seed), side="right")
                vw += v @ own
                w += own.sum(axis=0)
        if n:
            yield pd.DataFrame({"r": r, "vw": vw, "w": w})

    rows = values.filter(F.col(value_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(value_col).cast("double").alias("v"))
    means = rows.mapInPandas(sums, "r long, vw double, w double").groupBy("r").agg(F.coalesce(F.try_divide(F.sum("vw"), F.sum("w")), F.lit(float("nan"))).alias("m"))
    ordered = means.agg(F.array_sort(F.collect_list("m")).alias("ms"))  # `resamples` numbers
    at = lambda q: F.try_element_at("ms", F.lit(min(resamples, int(q * resamples) + 1)))
    whole = values.agg(F.avg(value_col).alias("mean"), F.count(value_col).alias("n"))
    return whole.join(ordered, F.lit(True)).select("mean", at(alpha).alias("lo"), at(1 - alpha).alias("hi"), "n")


def _uniform(ids: np.ndarray, r: np.ndarray, seed: int) -> np.ndarray:
    """Numbers in [0, 1) by integer arithmetic that any engine has: multipliers of linear congruences, modulo 2 ** 31.
    Remainders have the sign of the dividend, as in SQL, up to the first exclusive or, which is never negative."""
    m = 1 << 31
    x = np.fmod(np.fmod(ids, m) * 1_000_003 + r * 8191 + seed * 131, m)
    x = np.fmod(x * 1_103_515_245 + 12_345, m)
    x = x ^ (x >> 15)
    x = (x * 69_069 + 1) % m
    x = x ^ (x >> 13)
    return (x * 1_664_525 + 1_013_904_223) % m / m


def first_hit_ranks(corpus: DataFrame, queries: DataFrame, id_col: str = "id", vec_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(query_id, r): the rank, itself apart, of the first row of the query's label in a full
    ranking; null if there is none. Two aggregations, no ranking: the best hit of each query,
    then the rows above it."""
    carry = {"own": F.col(label_col)}
    hits = scored(corpus, queries, id_col, vec_col, carry, {"other": F.col(label_col)}).filter("query_id <> id")
    best = hits.groupBy("query_id").agg(F.max(F.when(F.col("own") == F.col("other"), F.struct("score", (-F.col("id")).alias("late")))).alias("best"))
    known = queries.join(best.select(F.col("query_id").alias(id_col), "best"), id_col)
    above = scored(corpus, known, id_col, vec_col, {"best": F.col("best")}, {}).filter("query_id <> id")
    above = above.groupBy("query_id").agg(F.count_if(F.struct("score", (-F.col("id")).alias("late")) > F.col("best")).alias("above"), F.first(F.col("best").isNotNull()).alias("found"))
    return above.select("query_id", F.when(F.col("found"), F.col("above") + 1).alias("r"))


def mean_reciprocal(ranks: DataFrame) -> DataFrame:
    """(mrr, n) of first_hit_ranks; 0 where there is no hit."""
    return ranks.agg(F.avg(F.coalesce(1 / F.col("r"), F.lit(0.0))).alias("mrr"), F.count("*").alias("n"))


def cross_probe(df: DataFrame, axes: list[str], labels: list[str], id_col: str = "id", **kw) -> list[dict]:
    """probe() of every axis against every label, its own and the others': {axis, label, accuracy, ...}."""
    return [{"axis": a, "label": x} | probe(df, a, x, id_col, **kw) for a in axes for x in labels]


def char_ngrams(text: Column, low: int = 2, high: int = 4) -> Column:
    """Character n-grams inside word boundaries: each word padded with a space on both sides,
    a word no longer than n given whole, once."""
    words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"\s+"), lambda w: w != "")
    padded = F.transform(words, lambda w: F.concat(F.lit(" "), w, F.lit(" ")))

    def cut(w: Column, n: int) -> Column:
        return F.transform(F.sequence(F.lit(1), F.greatest(F.length(w) - n + 1, F.lit(1))), lambda i: F.substr(w, i, F.lit(n)))

    def grams(w: Column) -> Column:
        runs = [cut(w, n) for n in range(low, high + 1)]
        # after the first n that takes in the whole word there is nothing more to cut
        return F.flatten(F.array(*[F.when((F.length(w) >= n) | F.lit(n == low), r).otherwise(F.array().cast("array<string>")) for n, r in zip(range(low, high + 1), runs, strict=True)]))

    return F.flatten(F.transform(padded, grams))


def tfidf(docs: DataFrame, id_col: str, grams: Column, max_features: int = 10_000) -> DataFrame:
    """(id, gram, w): sublinear term frequency, smooth idf, unit length; the max_features grams of
    largest count (ties by name)."""
    counts = docs.select(F.col(id_col).alias("id"), F.explode(grams).alias("gram")).groupBy("id", "gram").agg(F.count("*").alias("tf"))
    n = docs.count()
    stats = counts.groupBy("gram").agg(F.sum("tf").alias("total"), F.count("*").alias("df"))
    kept = stats.orderBy(F.desc("total"), "gram").limit(max_features).select("gram", (F.log((1.0 + n) / (1.0 + F.col("df"))) + 1.0).alias("idf"))
    w = counts.join(kept, "gram").select("id", "gram", ((1 + F.log("tf")) * F.col("idf")).alias("w"))
    norms = w.groupBy("id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return w.join(norms, "id").select("id", "gram", (F.col("w") / F.col("norm")).alias("w"))


#: Rows of a block of sparse vectors.
SPARSE_BLOCK = 1024


def sparse_neighbours(weights: DataFrame, k: int = 5) -> DataFrame:
    """(query_id, rank, id, score): cosine by products of shared grams, itself excluded, to nine
    decimals; ties by id. Rows that share no gram are no neighbours.

    Blocks of rows meet each other, as in search.neighbours(): no pair becomes a row and a
    frequent gram is no join key. Exact, and so quadratic in the rows."""
    kind = weights.schema["id"].dataType.simpleString()
    rows = weights.groupBy("id").agg(F.collect_list(F.struct("gram", "w")).alias("x")).checkpoint()  # read three times
    n = max(1, -(-rows.count() // SPARSE_BLOCK))

    def side(own: str, other: str) -> DataFrame:
        block = F.pmod(F.xxhash64("id"), F.lit(n))
        each = rows.select(F.col("id").alias("id"), F.col("x.gram").alias("gram"), F.col("x.w").alias("w"))
        return each.withColumn(own, block).withColumn(other, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))))

    def multiply(key, q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(q) and len(c):
            c = c.sort_values("id", ignore_index=True)
            known = {g: i for i, g in enumerate(dict.fromkeys(g for row in q["gram"] for g in row))}
            dense = np.zeros((len(known), len(q)))  # a gram's weights in all queries, side by side
            for i, (grams, w) in enumerate(zip(q["gram"], q["w"], strict=True)):
                dense[[known[g] for g in grams], i] = w
            scores = np.zeros((len(c), len(q)))
            for j, (grams, w) in enumerate(zip(c["gram"], c["w"], strict=True)):
                shared = [(known[g], x) for g, x in zip(grams, w, strict=True) if g in known]
                if shared:
                    at, x = zip(*shared, strict=True)
                    scores[j] = np.asarray(x) @ dense[list(at)]
            scores, ids = np.round(scores, 9), c["id"].tolist()
            for i, own in enumerate(q["id"].tolist()):
                column = scores[:, i]
                best = np.argsort(-column, kind="stable")[: k + 1]
                out += [(own, ids[j], float(column[j])) for j in best if column[j] > 0 and ids[j] != own][:k]
        return pd.DataFrame(out, columns=["query_id", "id", "score"]) if out else pd.DataFrame({"query_id": q["id"][:0], "id": q["id"][:0], "score": np.zeros(0)})

    best = side("qb", "cb").groupBy("qb", "cb").cogroup(side("cb", "qb").groupBy("qb", "cb")).applyInPandas(multiply, f"query_id {kind}, id {kind}, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return best.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "id", "score")


def pca_coordinates(df: DataFrame, id_col: str, vec_col: str, dims: int = 2) -> DataFrame:
    """(id, coordinates): principal components. The moments are sums over partitions; only a
    matrix of the vectors' dimension squared comes to the driver."""

    def moments(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, s, m = 0, 0.0, 0.0
        for pdf in batches:
            if len(pdf):
                x = np.stack(pdf["v"].to_numpy()).astype(np.float64)
                n, s, m = n + len(x), s + x.sum(axis=0), m + x.T @ x
        if n:
            yield pd.DataFrame({"n": [n], "s": [s.tolist()], "m": [m.ravel().tolist()]})

    src = df.filter(F.col(vec_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(vec_col).cast("array<double>").alias("v"))
    parts = src.select("v").mapInPandas(moments, "n long, s array<double>, m array<double>").collect()
    if not parts:
        return src.select("id", F.col("v").alias("coordinates"))
    n = sum(p.n for p in parts)
    mean = sum(np.array(p.s) for p in parts) / n
    cov = sum(np.array(p.m).reshape(len(mean), -1) for p in parts) / n - np.outer(mean, mean)
    values, vectors = np.linalg.eigh(cov)
    basis = vectors[:, np.argsort(-values)[:dims]]
    basis *= np.sign(basis[np.abs(basis).argmax(axis=0), np.arange(basis.shape[1])])

    def rotate(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                yield pd.DataFrame({"id": pdf["id"], "coordinates": list((np.stack(pdf["v"].to_numpy()) - mean) @ basis)})

    return src.mapInPandas(rotate, f"id {src.schema['id'].dataType.simpleString()}, coordinates array<double>")
