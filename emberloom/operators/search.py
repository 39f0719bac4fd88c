"""Exact vector search: one query by higher-order functions, many queries by blocked
linear algebra. Every ranking has an explicit tie-break, the row's ordinal."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vectors as V

#: Rows of a block, and queries of a block that are multiplied at once.
BLOCK, SLICE = 8192, 1024
#: Pairs whose scores are added up exactly at once.
PAIRS = 1 << 15
#: Queries of a full ranking, which returns all rows for each.
QUERY_BLOCK = 1000


def synthetic_projection(axes: int = 3, width: int = 8, dim: int = 64) -> list[list[float]]:
    """A projection by rule, for tests and demonstrations."""
    return [[((i * 31 + j * 17) % 13 - 6) / 13 for j in range(dim)] for i in range(axes * width)]


def _vector(values) -> Column:
    return F.array(*[F.lit(float(x)) for x in values])


def search_by_embedding(df: DataFrame, query: list[float], k: int = 3, id_col: str = "id", vec_col: str = "embedding", metric: str = "cosine") -> DataFrame:
    """The k rows most similar to one vector: df's columns and similarity (3 decimals).

    One scan; the k best of each partition meet in the last step (TakeOrderedAndProject)."""
    v = V.as_double(F.col(vec_col))
    q = _vector(query)
    qn = float(np.sqrt(np.sum(np.square(np.asarray(query, float)))))
    score = V.dot(v, q) if metric == "dot" else V.cosine(v, q, V.norm(v), F.lit(qn))
    top = df.withColumn("_score", score).orderBy(F.desc("_score"), id_col).limit(k)
    return top.withColumn("similarity", V.round_half_up(F.col("_score"))).drop("_score")


def project(df: DataFrame, matrix: list[list[float]], axes: list[str], vec_col: str = "embedding") -> DataFrame:
    """df with a unit vector for each axis: the rows of matrix are the axes' in turn. Sums are left
    folds, so that a row's bits do not depend on the batch it is in, as a matrix product's do."""
    width = len(matrix) // len(axes)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = np.asarray(matrix, np.float64).T
        for pdf in batches:
            if len(pdf):
                x = np.stack(pdf[vec_col].to_numpy()).astype(np.float64)
                p = np.zeros((len(x), m.shape[1]))
                for d in range(len(m)):
                    p += x[:, d : d + 1] * m[d]
                for k, axis in enumerate(axes):
                    own = p[:, k * width : (k + 1) * width]
                    n = np.sqrt(_fold(own * own))[:, None]
                    pdf[axis] = list(np.divide(own, n, out=own.copy(), where=n > 0))
                yield pdf

    fields = ", ".join(f"{a} array<double>" for a in axes)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields) + ", " + fields
    return df.mapInPandas(run, schema)


def project_vector(matrix: list[list[float]], axes: list[str], query: list[float]) -> dict[str, list[float]]:
    p = np.asarray(matrix, float) @ np.asarray(query, float)
    width, out = len(matrix) // len(axes), {}
    for k, axis in enumerate(axes):
        own = p[k * width : (k + 1) * width]
        n = np.linalg.norm(own)
        out[axis] = (own / n if n > 0 else own).tolist()
    return out


def search_by_aspects(projected: DataFrame, query_axes: dict[str, list[float]], k: int = 3, region: str | None = None, weights: dict[str, float] | None = None, id_col: str = "id") -> DataFrame:
    """The k rows of largest weighted mean similarity over the axes. A region that is not
    blank makes the location axis weigh 1.5; its value does not matter."""
    weights = weights or {a: 1.5 if a == "location" and region and region.strip() else 1.0 for a in query_axes}
    scores = {a: V.dot(F.col(a), _vector(q)) for a, q in query_axes.items()}
    rows = projected.select(id_col, *[s.alias(f"_{a}") for a, s in scores.items()])
    combined = sum(F.col(f"_{a}") * w for a, w in weights.items()) / sum(weights.values())
    top = rows.withColumn("_combined", combined).orderBy(F.desc("_combined"), id_col).limit(k)
    return top.select(id_col, *[V.round_half_up(F.col(f"_{a}")).alias(a) for a in query_axes], V.round_half_up(F.col("_combined")).alias("combined"))


def neighbours(corpus: DataFrame, queries: DataFrame | None = None, k: int = 5, id_col: str = "id", vec_col: str = "embedding", metric: str = "cosine", eps: float = 0.0) -> DataFrame:
    """(query_id, rank, id, score): the k most similar rows of corpus to each query, itself excluded.
    Null ids, null vectors and pairs whose score is not a number take no part; the cosine to a zero vector is 0.

    Queries (by default the corpus) meet the corpus in blocks of about BLOCK rows each: a
    task multiplies two blocks and passes on k rows a query, so neither side is ever whole
    in one place and no pair becomes a row. A matrix product's last bits depend on where a row
    lies, so it only rules out rows that rounding cannot make one of the k: the others' scores
    are left folds, as in a plain loop, and copies tie."""
    queries = corpus if queries is None else queries
    a, b = (max(1, -(-df.count() // BLOCK)) for df in (queries, corpus))
    kind = "array<float>" if all(df.schema[vec_col].dataType.simpleString() == "array<float>" for df in (queries, corpus)) else "array<double>"

    def side(df: DataFrame, own: str, n: int, other: str, m: int) -> DataFrame:
        rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast(kind).alias("vec")).filter("id IS NOT NULL AND vec IS NOT NULL")
        # Both keys are ints on both sides: cogroup() compares hashes and bytes, and those of an int and a long differ.
        rows = rows.withColumn(own, F.pmod(F.xxhash64("id"), F.lit(n)).cast("int"))
        return rows.withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(m - 1)))).select("qb", "cb", "id", "vec")

    def multiply(key, q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame({"query_id": np.zeros(0, np.int64), "id": np.zeros(0, np.int64), "score": np.zeros(0)})]
        if len(q) and len(c):
            c = c.sort_values("id", ignore_index=True)
            # Of equal vectors a query has the k of smallest id at most, besides rows of its own id.
            c = c[c.groupby(c["vec"].map(lambda v: v.tobytes())).cumcount() < k + c["id"].value_counts().max()]
            own, ids = q["id"].to_numpy(), c["id"].to_numpy()
            x, y = (np.stack(df["vec"].to_numpy()).astype(np.float64) for df in (q, c))
            for at in range(0, len(own), SLICE):
                i, j, score = _nearest(x[at : at + SLICE], y, own[at : at + SLICE, None] == ids, k, metric, eps)
                out.append(pd.DataFrame({"query_id": own[at + i], "id": ids[j], "score": score}))
        return pd.concat(out)

    left, right = side(queries, "qb", a, "cb", b), side(corpus, "cb", b, "qb", a)
    best = left.groupBy("qb", "cb").cogroup(right.groupBy("qb", "cb")).applyInPandas(multiply, "query_id long, id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return best.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "id", "score")


def _fold(products: np.ndarray) -> np.ndarray:
    """Row sums from left to right: the same bits for the same row, wherever it lies."""
    out = np.zeros(len(products))
    for d in range(products.shape[1]):
        out += products[:, d]
    return out


def _nearest(x: np.ndarray, y: np.ndarray, same: np.ndarray, k: int, metric: str, eps: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row of x, row of y and score of the k best rows of y for each of x, those marked in same
    excluded; of equal scores the first rows."""
    xx, yy = _fold(x * x), _fold(y * y)
    nx, ny = np.sqrt(xx) + eps, np.sqrt(yy) + eps
    bits = (4 * x.shape[1] + 64) * np.finfo(np.float64).eps  # rounding of both sums, generously
    with np.errstate(all="ignore"):
        if metric == "cosine":
            rough, slack = (x / np.where(nx > 0, nx, 1)[:, None]) @ (y / np.where(ny > 0, ny, 1)[:, None]).T, np.full(len(x), bits)
        else:
            rough, slack = x @ y.T, bits * nx * ny.max()
        if rough.shape[1] > k:
            low = np.where(same | np.isnan(rough), -np.inf, rough)
            low.partition(low.shape[1] - k, axis=1)
            same = same | (rough < (low[:, -k] - slack)[:, None])
        i, j = np.nonzero(~same)
        score = np.concatenate([np.zeros(0), *[_fold(x[i[a : a + PAIRS]] * y[j[a : a + PAIRS]]) for a in range(0, len(i), PAIRS)]])
        if metric == "cosine":
            size = np.sqrt(xx[i] * yy[j]) if eps == 0 else nx[i] * ny[j]
            score = np.where(size == 0, 0.0, np.clip(score / size, -1.0, 1.0))
    known = ~np.isnan(score)
    i, j, score = i[known], j[known], score[known]
    order = np.lexsort((j, -score, i))
    order = order[np.arange(len(order)) - np.searchsorted(i[order], i[order]) < k]
    return i[order], j[order], score[order]


def scored(corpus: DataFrame, queries: DataFrame, id_col: str, vec_col: str, of_query: dict | None = None, of_row: dict | None = None) -> DataFrame:
    """(query_id, id, score, extra columns) of all rows for all queries, themselves included. A block of
    QUERY_BLOCK queries is broadcast; of more blocks each meets its own copy of the corpus' rows."""
    n = max(1, -(-queries.count() // QUERY_BLOCK))
    q = queries.select(F.col(id_col).alias("query_id"), V.as_double(F.col(vec_col)).alias("qv"), *[c.alias(k) for k, c in (of_query or {}).items()]).withColumn("qn", V.norm(F.col("qv")))
    c = corpus.select(F.col(id_col).alias("id"), V.as_double(F.col(vec_col)).alias("cv"), *[c.alias(k) for k, c in (of_row or {}).items()]).withColumn("cn", V.norm(F.col("cv")))
    if n == 1:
        both = c.join(F.broadcast(q), F.lit(True))
    else:
        q = q.withColumn("_block", F.pmod(F.xxhash64("query_id"), F.lit(n)))
        both = c.withColumn("_block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1)))).join(q, "_block")
    score = V.cosine(F.col("qv"), F.col("cv"), F.col("qn"), F.col("cn")).alias("score")
    return both.select("query_id", "id", score, *(of_query or {}), *(of_row or {}))


def full_ranking(corpus: DataFrame, queries: DataFrame, id_col: str = "id", vec_col: str = "embedding") -> DataFrame:
    """(query_id, rank, id, score) of all rows for all queries, themselves included: as many rows as both sides multiplied."""
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return scored(corpus, queries, id_col, vec_col).withColumn("rank", rank)


def examples(near: DataFrame, vectors: DataFrame, parts: dict[str, str], labels: DataFrame, label_cols: list[str], id_col: str = "id") -> DataFrame:
    """near (query_id, rank, id, score) with the cosine of each part (name to vector column) and,
    for each label, whether the two rows agree in it (null: no label)."""
    cols = [c for c in dict.fromkeys(parts.values())]
    a = vectors.select(F.col(id_col).alias("query_id"), *[V.as_double(F.col(c)).alias(f"_a_{c}") for c in cols])
    b = vectors.select(F.col(id_col).alias("id"), *[V.as_double(F.col(c)).alias(f"_b_{c}") for c in cols])
    x = labels.select(F.col(id_col).alias("query_id"), *[F.col(c).alias(f"_x_{c}") for c in label_cols])
    y = labels.select(F.col(id_col).alias("id"), *[F.col(c).alias(f"_y_{c}") for c in label_cols])
    rows = near.join(a, "query_id").join(b, "id").join(x, "query_id").join(y, "id")
    cos = lambda c: V.cosine(F.col(f"_a_{c}"), F.col(f"_b_{c}"), V.norm(F.col(f"_a_{c}")), V.norm(F.col(f"_b_{c}")))
    return rows.select("query_id", "rank", "id", F.col("score").alias("combined"), *[cos(c).alias(name) for name, c in parts.items()], *[(F.col(f"_x_{c}") == F.col(f"_y_{c}")).alias(f"{c}_match") for c in label_cols])
