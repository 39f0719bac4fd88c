import numpy as np
from pyspark.sql import functions as F

from emberloom.llm.ann import Tables, _Best, nearest_neighbours


def brute(rows, k=10):
    ok = sorted({(i, tuple(map(float, v))) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)})
    out = {}
    for q, v in ok:
        if q % 100 == 0:
            best = {}
            for i, w in ok:
                if i != q:
                    d = float(np.sqrt(((np.array(w) - np.array(v)) ** 2).sum()))
                    best[i] = min(d, best.get(i, d))
            out[q] = sorted((d, i) for i, d in best.items())[:k]
    return out


def test_recall_and_scores(spark, sf):
    df = spark.read.parquet(sf.replace("0.001", "0.1") + "/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in df.collect()]
    want = brute(rows)
    got = {}
    for r in nearest_neighbours(df, F.col("vec_id") % 100 == 0).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.score, r.vec_id))
    hit = 0
    for q, near in want.items():
        own = sorted(got[q])
        assert [x[0] for x in own] == list(range(1, 11)) and [x[1:] for x in own] == sorted(x[1:] for x in own)
        hit += len({i for _, i in near} & {x[2] for x in own})
    assert hit / (10 * len(want)) >= 0.9


def test_edge_rows_and_ties(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=4).tolist()) for i in range(1, 60)]
    rows += [(100 + i, [1.0, 2.0, 3.0, 4.0]) for i in range(30)] + [(100, [1.0, 2.0, 3.0, 4.0]), (200, None), (300, [0.0] * 4), (400, [None, 1.0, 1.0, 1.0]), (500, [float("nan"), 1.0, 1.0, 1.0]), (600, [float("inf"), 1.0, 1.0, 1.0]), (None, [1.0] * 4)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<double>, rank int")
    got = nearest_neighbours(df, F.col("vec_id") % 100 == 0).orderBy("query_id", "rank").collect()
    want = brute(rows)
    assert [(r.query_id, r.score, r.vec_id) for r in got] == [(q, d, i) for q in sorted(want) for d, i in want[q]]
    assert [r.vec_id for r in got] == list(range(101, 111))


def test_few_and_no_rows(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [3.0, 3.0])], "vec_id long, embedding array<double>")
    assert [(r["rank"], r.vec_id) for r in nearest_neighbours(df, F.col("vec_id") == 0).orderBy("rank").collect()] == [(1, 1), (2, 2)]
    assert nearest_neighbours(df.limit(0), F.col("vec_id") == 0).collect() == []


def test_recall_beside_large_groups_of_copies(spark):
    rng = np.random.default_rng(3)
    copies = rng.normal(size=(2, 32))
    rows = [(i, (copies[i // 100 % 10 // 3] if i // 100 % 10 < 6 else rng.normal(size=32)).tolist()) for i in range(4000)]
    want = brute(rows)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {}
    for r in nearest_neighbours(df, F.col("vec_id") % 100 == 0).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    outside = [q for q in want if q // 100 % 10 >= 6]
    assert sum(len({i for _, i in want[q]} & got[q]) for q in outside) / (10 * len(outside)) >= 0.9
    assert all({i for _, i in want[q]} == got[q] for q in want if q not in outside)


def test_repeated_ids_with_different_vectors(spark):
    rng = np.random.default_rng(5)
    rows = [(0, [0.0, 0.0, 1.0])] + [(1, (np.array([0.0, 0.0, 1.0]) + 0.01 * rng.normal(size=3)).tolist()) for _ in range(12)]
    rows += [(i, rng.normal(size=3).tolist()) for i in range(2, 20)] + [(0, [0.0, 0.1, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = nearest_neighbours(df, F.col("vec_id") == 0).orderBy("rank").collect()
    best = {}
    for i, v in rows[1:]:
        for q in (rows[0][1], rows[-1][1]):
            if i:
                d = float(np.sqrt(((np.array(v) - np.array(q)) ** 2).sum()))
                best[i] = min(d, best.get(i, d))
    assert [(r.score, r.vec_id) for r in got] == sorted((d, i) for i, d in best.items())[:10]


def test_best_is_cut_after_ids_are_unique():
    best = _Best(2)
    best.add(np.array([1, 1, 1]), np.array([0.1, 0.2, 0.3]))
    best.add(np.array([3, 2, 1]), np.array([0.4, 0.4, 0.05]))
    assert best.ids.tolist() == [1, 2] and best.d.tolist() == [0.05, 0.4]


def shares(vectors, queries, k=10):
    """(recall, share of all vectors that are looked at) over some queries, from the tables alone."""
    v = np.array(vectors)
    hashes = Tables(v[np.random.default_rng(2).permutation(len(v))[:2000]], 2, 14, 2, k, 10)
    codes = [hashes.buckets(v, t) for t in range(2)]
    own = [np.unique(c, return_counts=True) for c in codes]
    recall, seen = [], []
    for q in queries:
        d = ((v - v[q]) ** 2).sum(axis=1)
        d[q] = np.inf
        hit = np.zeros(len(v), bool)
        for t in range(2):
            hit |= np.isin(codes[t], hashes.visits(v[q], hashes.radius(v[q]), t, *own[t]))
        recall.append(hit[np.argsort(d, kind="stable")[:k]].mean())
        seen.append(hit.mean())
    return np.mean(recall), np.mean(seen)


def test_visited_share_and_recall_where_vectors_lie_in_clusters():
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(100, 64))
    recall, seen = shares(centres[rng.integers(0, 100, 10_000)] + 0.3 * rng.normal(size=(10_000, 64)), range(0, 10_000, 200))
    print("clusters", recall, seen)
    assert recall >= 0.9 and seen <= 1 / 3


def test_visited_share_and_recall_of_vectors_without_structure(spark, sf):
    rows = spark.read.parquet(sf.replace("0.001", "0.1") + "/embeddings.parquet").orderBy("vec_id").collect()
    recall, seen = shares([r.embedding for r in rows], range(0, len(rows), 40))
    print("random", recall, seen)
    assert recall >= 0.9 and seen <= 0.7


def test_blocks_of_queries_give_the_same(spark):
    rng = np.random.default_rng(6)
    df = spark.createDataFrame([(i, rng.normal(size=8).tolist()) for i in range(300)], "vec_id long, embedding array<double>")
    one, many = (nearest_neighbours(df, F.col("vec_id") % 10 == 0, query_bytes=b).orderBy("query_id", "rank").collect() for b in (16 << 20, 1 << 15))
    assert one == many and len(one) == 300
