import random

import numpy as np

from emberloom.llm.common import Hasher
from emberloom.llm.toxicity import clean, fit_chain, score, train_chain

CHAIN = {"low_quality": "quality = 0", "toxic": "toxic = 1"}


def corpus(n, seed):
    rng = random.Random(seed)
    docs, labels = [], []
    for i in range(n):
        words = [f"w{rng.randrange(3000)}" for _ in range(rng.randrange(20, 60))]
        toxic, junk = rng.random() < 0.2, rng.random() < 0.2
        if toxic:
            words += rng.choices(("vile", "nasty", "rotten"), k=2)
        if junk:
            words += ["zzz"] * 3
        rng.shuffle(words)
        docs.append((i, " ".join(words), 7))
        labels.append((i, int(not junk), int(toxic)))
    return docs, labels


def test_held_out_accuracy_and_clean(spark):
    docs, labels = corpus(1200, 1)
    df = spark.createDataFrame(docs, "doc_id long, text string, p_toxic long")
    chain = train_chain(df, spark.createDataFrame(labels[:800], "doc_id long, quality int, toxic int"), CHAIN)
    got = {r.doc_id: r.rejected for r in score(df, chain).collect()}
    right = sum(got[i] == bool(t) for i, _, t in labels[800:])
    assert right / 400 > 0.97
    assert {r.doc_id for r in clean(df, chain).collect()} == {i for i, bad in got.items() if not bad}


def test_chain_feeds_earlier_probability():
    rng = np.random.default_rng(0)
    words = np.sort(rng.integers(1, 1 << 60, 50).astype(np.uint64))
    first = rng.random(600) < 0.5
    sets = [np.unique(np.concatenate((rng.choice(words[1:], 5), words[:1] if f else words[:0]))) for f in first]
    labels = np.stack((first, first), axis=1).astype(int)
    chain = fit_chain(sets, labels, ["a", "b"])
    assert chain.links[1].earlier.shape == (1,) and chain.links[1].earlier[0] > 0


def test_edge_rows(spark):
    docs, labels = corpus(300, 2)
    rows = docs + [(None, "vile nasty", 1), (5000, None, 1), (5001, "", 1), (5002, "fine " * 50_000, 1), (5002, "fine " * 50_000, 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_chars long")
    marks = spark.createDataFrame(labels + [(5001, None, 1), (None, 1, 1)], "doc_id long, quality int, toxic int")
    chain = train_chain(df, marks, CHAIN)
    got = score(df, chain).collect()
    assert len(got) == len(rows) and [r.rejected for r in got if r.doc_id is None] == [True]
    assert clean(df, chain).filter("doc_id >= 5000").count() == 4
    none = spark.createDataFrame([], df.schema)
    assert score(none, chain).collect() == [] and clean(none, chain).collect() == []
    untaught = train_chain(df, spark.createDataFrame([], "doc_id long, quality int, toxic int"), CHAIN)
    assert clean(df, untaught).count() == len(rows)


def test_scores_do_not_depend_on_batches(spark):
    docs, labels = corpus(200, 3)
    df = spark.createDataFrame(docs, "doc_id long, text string, n_chars long")
    chain = train_chain(df, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), CHAIN)
    alone = [float(chain.probabilities(Hasher("alnum"), [t.encode()])[0, -1]) for _, t, _ in docs[:20]]
    together = {r.doc_id: r.p_toxic for r in score(df, chain).collect()}
    assert np.allclose(alone, [together[i] for i in range(20)])


def plain_newton(x, y, ridge):
    """Logistic regression to convergence by damped steps, the last column the intercept."""
    x = np.hstack((x, np.ones((len(x), 1))))
    r = np.array([ridge] * (x.shape[1] - 1) + [1e-6])
    w = np.zeros(x.shape[1])
    for _ in range(60):
        p = 1 / (1 + np.exp(-x @ w))
        step = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + np.diag(r), x.T @ (p - y) + r * w)
        w -= step * min(1, 1 / max(1e-9, np.abs(step).max()))
    return w


def test_query_same_as_a_plain_chain(spark, tmp_path):
    """op9 plainly: words as text, dense tables, the categories one after the other with out-of-fold feeding."""
    import hashlib
    import re

    from emberloom.llm.registry import op9_toxicity

    docs, labels = corpus(400, 5)
    docs += [(1000 + i, t, 7) for i, t, _ in docs[:40]]  # copies, not labelled
    spark.createDataFrame(docs, "doc_id long, text string, p_toxic long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    hasher = Hasher("alnum")
    texts = {i: set(re.findall("[a-z0-9]+", t.lower())) for i, t, _ in docs}
    code = {w: int(hasher.batch([w.encode()])[0][0]) for ws in texts.values() for w in ws}
    digest = lambda ws: hashlib.md5(np.sort(np.array([code[w] for w in ws], np.uint64)).tobytes()).hexdigest()
    once = {}
    for i, q, t in sorted(labels, reverse=True):
        once[digest(texts[i])] = (texts[i], int(q == 0), int(t == 1))
    rows = [once[d] for d in sorted(once)]
    n, earlier, chain = len(rows), np.zeros((len(rows), 0)), []
    for k in (1, 2):
        y = np.array([r[k] for r in rows], float)
        rate, chi = y.mean(), {}
        for w in set().union(*(r[0] for r in rows)):
            has = np.array([w in r[0] for r in rows])
            if has.sum() >= 5 and has.sum() < n:
                chi[w] = (y[has].sum() - has.sum() * rate) ** 2 / (has.sum() * rate * (1 - rate) * (1 - has.sum() / n))
        words = sorted(sorted((w for w in chi if chi[w] > 0), key=lambda w: (-chi[w], code[w]))[:128])
        x = np.hstack((np.array([[float(w in r[0]) for w in words] for r in rows]), earlier))
        oof = np.empty(n)
        for f in range(5):
            out = np.arange(n) % 5 == f
            w = plain_newton(x[~out], y[~out], 1.0)
            oof[out] = 1 / (1 + np.exp(-(x[out] @ w[:-1] + w[-1])))
        chain.append((words, plain_newton(x, y, 1.0)))
        earlier = np.hstack((earlier, oof[:, None]))
    for r in op9_toxicity(spark, str(tmp_path)).collect():
        ps = []
        for words, w in chain:
            v = np.array([float(x in texts[r.doc_id]) for x in words] + ps)
            ps.append(1 / (1 + np.exp(-(v @ w[:-1] + w[-1]))))
        assert np.allclose((r.p_low_quality, r.p_toxic), ps, atol=1e-3)
