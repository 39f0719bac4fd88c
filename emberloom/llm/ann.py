"""Nearest neighbours by multiprobe p-stable hashing.

Each table has `projections` functions floor((a . v + b) / w) with Gaussian a;
outer slots are merged, so a table has slots ** projections buckets, a bounded
number. For a query, the chance that a neighbour at the distance r lies in a bucket
is the product, over the functions, of the normal probability that a . (v - q), of
deviation r, leads into the bucket's slot. r is the query's own: its k-th nearest
distance in the sample, so groups of copies make it small for their members only.
Occupied buckets are visited in order of that chance until their share of it reaches
`success` and they hold at least `least` candidates for each neighbour wanted.
Candidates of all tables are merged, each vector once, and ranked by exact Euclidean
distance in double precision.

`success` is fitted on the sample: the least of LEVELS at which the worse half of
PROBES sampled queries finds TARGET of its nearest in the sample (the tables' share
of it is all that a query visits: vectors in clusters need few buckets, vectors
without structure about half of them). The dimension and the scale of the projections
come from that sample too, at most SAMPLE vectors (those of smallest id hash); every
vector is indexed.

Queries are taken in blocks of at most `query_bytes`, each of that proven size sent to
all executors: their vectors, and for every bucket a bit a query that visits it. The
vectors stream past a block where they lie; nothing is shuffled but each task's k
nearest. So no bucket is a group, however many vectors it holds.

Defined results: vectors that are null, zero, hold null or non-finite components
or are not of the sample's most frequent length take no part, neither do rows
with a null id; a query's own id is never its neighbour, also in repeated rows;
equal distances go to the smaller id, and a repeated id counts once, with its nearest
vector; a query with fewer candidates than k gets all it found; extra columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import scratch_root, stage_table

SAMPLE, PROBES, TARGET, SEED = 2000, 100, 0.88, 11
LEVELS = (0.3, 0.5, 0.6, 0.7, 0.75, 0.8, 0.85, 0.88, 0.9, 0.92, 0.94, 0.95, 0.96, 0.965, 0.97, 0.975, 0.98, 0.985, 0.99, 0.995, 1.0)


def usable(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, vec array<double>) of the vectors that take part, of any length."""
    out = df.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("vec"))
    return out.filter("id IS NOT NULL AND vec IS NOT NULL AND forall(vec, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('infinity')) AND exists(vec, x -> x <> 0)")


class Tables:
    """The hash functions of all tables, fitted on a sample."""

    def __init__(self, sample: np.ndarray, tables: int, projections: int, slots: int, k: int, least: int):
        rng = np.random.default_rng(SEED)
        self.tables, self.slots, self.k, self.least, self.sample = tables, slots, k, least, sample
        self.cells = slots**projections
        self.a = rng.normal(size=(tables, projections, sample.shape[1]))
        p = sample @ self.a.reshape(-1, sample.shape[1]).T
        self.centre, spread = np.median(p, axis=0).reshape(tables, projections), p.std(axis=0).reshape(tables, projections)
        self.width = np.maximum(spread, 1e-12)
        self.weigh = slots ** np.arange(projections)[::-1]
        self.success = self._fit()

    def radius(self, q: np.ndarray) -> float:
        """The distance of a query's k-th nearest in the sample: at least that in all rows."""
        k = min(self.k, len(self.sample) - 1)  # one more, as the query may be in the sample
        return max(float(np.sqrt(np.partition(((self.sample - q) ** 2).sum(axis=1), k)[k])), 1e-9)

    def places(self, v: np.ndarray, t: int) -> np.ndarray:
        """Where vectors lie in units of slots, counted from the lowest slot."""
        return (v @ self.a[t].T - self.centre[t]) / self.width[t] + self.slots / 2

    def buckets(self, v: np.ndarray, t: int) -> np.ndarray:
        return np.clip(np.floor(self.places(v, t)), 0, self.slots - 1).astype(np.int64) @ self.weigh

    def order(self, q: np.ndarray, r: float, t: int, occupied: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The occupied buckets, most promising first, and the share of the chance reached with each."""
        edges = (np.arange(1, self.slots) - self.places(q[None, :], t)[0][:, None]) * (self.width[t] / (r * math.sqrt(2)))[:, None]
        cdf = 0.5 * (1 + np.vectorize(math.erf, otypes=[float])(edges))
        cdf = np.hstack((np.zeros((len(cdf), 1)), cdf, np.ones((len(cdf), 1))))  # outer slots are open
        score = np.zeros(1)
        for logs in np.log(np.maximum(np.diff(cdf, axis=1), 1e-300)):
            score = (score[:, None] + logs[None, :]).ravel()
        score = score[occupied]
        order = np.argsort(-score, kind="stable")
        share = np.cumsum(np.exp(score[order] - score[order[0]]))
        return order, share / share[-1]

    def visits(self, q: np.ndarray, r: float, t: int, occupied: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """The occupied buckets to visit for a query with neighbours at r, most promising first."""
        order, share = self.order(q, r, t, occupied)
        if self.success >= 1:
            return occupied[order]
        enough = (share >= self.success) & (np.cumsum(counts[order]) >= self.least * self.k)
        return occupied[order[: int(np.argmax(enough)) + 1 if enough.any() else len(order)]]

    def _fit(self) -> float:
        """The least level at which the worse half of sampled queries finds TARGET of its nearest in the sample."""
        v = np.unique(self.sample, axis=0)  # copies are found at any level
        if len(v) <= 2 * self.k:
            return 1.0
        picked = np.random.default_rng(SEED).permutation(len(v))[:PROBES]
        owned = [np.unique(self.buckets(v, t), return_inverse=True) for t in range(self.tables)]
        found = np.zeros((len(picked), len(LEVELS)))
        for i, q in enumerate(picked):
            d = np.sqrt(((v - v[q]) ** 2).sum(axis=1))
            d[q] = np.inf
            r = np.partition(d, self.k - 1)[self.k - 1]
            true = np.flatnonzero(d <= r)
            reached = np.ones(len(true))
            for t, (occupied, at) in enumerate(owned):
                order, share = self.order(v[q], max(r, 1e-9), t, occupied)
                before = np.empty(len(order))
                before[order] = np.concatenate(([0.0], share[:-1]))  # a bucket is visited unless the share was reached before it
                reached = np.minimum(reached, before[at[true]])
            found[i] = [(reached < level).mean() for level in LEVELS]
        worse = np.sort(found, axis=0)[: max(1, len(picked) // 2)].mean(axis=0)
        return LEVELS[int(np.argmax(worse >= TARGET))] if (worse >= TARGET).any() else 1.0


class _Best:
    """The k nearest of distinct ids seen so far."""

    def __init__(self, k: int):
        self.k, self.ids, self.d = k, np.empty(0, np.int64), np.empty(0)

    def add(self, ids: np.ndarray, d: np.ndarray) -> None:
        if len(self.d) == self.k:
            near = d <= self.d[-1]
            ids, d = ids[near], d[near]
        if not len(d):
            return
        ids, d = np.concatenate((self.ids, ids)), np.concatenate((self.d, d))
        order = np.lexsort((ids, d))
        ids, d = ids[order], d[order]
        first = np.sort(np.unique(ids, return_index=True)[1])[: self.k]  # each id at its nearest, then the cut
        self.ids, self.d = ids[first], d[first]


def _search(hashes: Tables, own: np.ndarray, asked: np.ndarray, bits: list[np.ndarray]):
    """Vectors that stream past a block of queries; bits[t][bucket] has a bit for each query that visits it."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best = [_Best(hashes.k) for _ in own]
        for pdf in batches:
            if not len(pdf):
                continue
            ids, v = pdf["id"].to_numpy(np.int64), np.stack(pdf["vec"].to_numpy())
            seen = bits[0][hashes.buckets(v, 0)]
            for t in range(1, hashes.tables):
                seen |= bits[t][hashes.buckets(v, t)]
            query, row = np.nonzero(np.unpackbits(seen, axis=1, count=len(own)).T)
            cuts = np.searchsorted(query, np.arange(len(own) + 1))
            for i in np.flatnonzero(np.diff(cuts)).tolist():
                at = row[cuts[i] : cuts[i + 1]]
                at = at[ids[at] != own[i]]
                best[i].add(ids[at], np.sqrt(((v[at] - asked[i]) ** 2).sum(axis=1)))
        yield pd.DataFrame({"query_id": np.repeat(own, [len(b.d) for b in best]), "vec_id": np.concatenate([b.ids for b in best]), "score": np.concatenate([b.d for b in best])})

    return run


def nearest_neighbours(df: DataFrame, is_query: Column, id_col: str = "vec_id", vec_col: str = "embedding", k: int = 10, tables: int = 2, projections: int = 14, slots: int = 2, least: int = 10, query_bytes: int = 16 << 20) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k nearest found, nearest first."""
    spark = df.sparkSession
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    base = usable(df, id_col, vec_col)
    rows = base.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).collect()
    if not rows:
        return empty
    dim = Counter(len(r.vec) for r in rows).most_common(1)[0][0]
    hashes = Tables(np.array([r.vec for r in rows if len(r.vec) == dim]), tables, projections, slots, k, least)
    base = base.filter(F.size("vec") == dim)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums = np.zeros((tables, hashes.cells), np.int64)
        for pdf in batches:
            for t in range(tables if len(pdf) else 0):
                sums[t] += np.bincount(hashes.buckets(np.stack(pdf["vec"].to_numpy()), t), minlength=hashes.cells)
        t, b = np.nonzero(sums)
        yield pd.DataFrame({"t": t, "bucket": b, "n": sums[t, b]})

    counted = base.mapInPandas(count, "t int, bucket long, n long").groupBy("t", "bucket").agg(F.sum("n").alias("n"))
    sizes = counted.toPandas()  # at most tables * slots ** projections rows
    own = [(part["bucket"].to_numpy(np.int64), part["n"].to_numpy(np.int64)) for part in (sizes[sizes["t"] == t] for t in range(tables))]

    def visit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            packed = []
            for v in pdf["vec"]:
                flags, r = np.zeros((tables, hashes.cells), bool), hashes.radius(v)
                for t in range(tables):
                    flags[t, hashes.visits(v, r, t, *own[t])] = True
                packed.append(np.packbits(flags).tobytes())
            yield pdf.assign(bits=packed)

    asks = usable(df.filter(is_query), id_col, vec_col).distinct().filter(F.size("vec") == dim)
    asks = stage_table(asks.mapInPandas(visit, "id long, vec array<double>, bits binary"), "ann-queries")
    blocks = max(1, math.ceil(2 * asks.count() * (8 * dim + tables * hashes.cells / 8) / query_bytes))
    folder = f"{scratch_root(spark)}/ann-found-{uuid.uuid4().hex}"
    schema = "query_id long, vec_id long, score double"
    spark.createDataFrame([], schema).write.parquet(folder)
    for b in range(blocks):
        rows = asks.filter(F.pmod(F.xxhash64("id", "vec"), F.lit(blocks)) == b).collect()
        if rows:
            flags = np.unpackbits(np.frombuffer(b"".join(bytes(r.bits) for r in rows), np.uint8)).reshape(len(rows), -1)[:, : tables * hashes.cells]
            bits = [np.packbits(np.ascontiguousarray(flags[:, t * hashes.cells : (t + 1) * hashes.cells].T), axis=1) for t in range(tables)]
            search = _search(hashes, np.array([r.id for r in rows]), np.array([r.vec for r in rows]), bits)
            base.mapInPandas(search, schema).write.mode("append").parquet(folder)
    found = spark.read.schema(schema).parquet(folder).groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
