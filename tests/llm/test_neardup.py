import itertools
import random

import pytest

from emberloom.llm.neardup import near_duplicates


def sets(text, width):
    words = (text or "").encode().lower().split()
    if len(words) < width:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + width]) for i in range(len(words) - width + 1)}


def brute(rows, width):
    own = {i: sets(t, width) for i, t in rows}
    comp = {i: i for i in own}

    def root(x):
        while comp[x] != x:
            x = comp[x]
        return x

    for a, b in itertools.combinations(sorted(own), 2):
        both = len(own[a] & own[b])
        if both and 100 * both >= 80 * (len(own[a]) + len(own[b]) - both):
            x, y = sorted((root(a), root(b)))
            comp[y] = x
    return {i: (len(own[i]), root(i)) for i in own}


def corpus(seed, n=120):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)]
    texts = []
    for _ in range(n):
        if texts and rng.random() < 0.6:
            words = rng.choice(texts[-30:]).split()
            for _ in range(rng.choice((0, 1, 1, 2, 5))):
                if words:
                    words[rng.randrange(len(words))] = rng.choice(vocab)
        else:
            words = rng.choices(vocab, k=rng.choice((1, 2, 3, 5, 40, 80)))
        texts.append(" ".join(words))
    return list(enumerate(texts))


@pytest.mark.parametrize("seed", [1, 2])
def test_same_as_brute_force(spark, seed):
    rows = corpus(seed)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates(df, shingle_words=4).collect()}
    assert got == brute(rows, 4)


def test_star_of_copies_that_differ_from_each_other(spark):
    rng = random.Random(5)
    base = [f"b{i}" for i in range(200)]
    rows = []
    for i in range(60):
        words = list(base)
        for _ in range(4):
            words[rng.randrange(200)] = f"x{i}_{rng.randrange(99)}"
        rows.append((i, " ".join(words)))
    rows.append((60, " ".join(base)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates(df, shingle_words=4).collect()}
    assert got == brute(rows, 4)


def test_edge_rows(spark):
    rows = [(1, None, 5), (2, "", 5), (3, " \t\n", 5), (4, "A b", 5), (9, "a B", 5), (None, "a b", 5), (6, "q", 5), (6, "q", 5), (7, "é È", 5), (8, "é è", 5), (10, "x " * 30_000, 5), (11, "x " * 40_000, 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, component_id long")
    got = sorted((r.doc_id or 0, r.n_shingles, r.component_id, r.kept) for r in near_duplicates(df, shingle_words=4).collect())
    assert got == sorted([(1, 0, 1, True), (2, 0, 2, True), (3, 0, 3, True), (4, 1, 4, True), (9, 1, 4, False), (0, 1, None, True), (6, 1, 6, True), (6, 1, 6, True), (7, 1, 7, True), (8, 1, 8, True), (10, 1, 10, True), (11, 1, 10, False)])


def test_empty_table(spark):
    assert near_duplicates(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_large_group_of_unlike_copies(spark, monkeypatch):
    from emberloom.llm import neardup

    rng = random.Random(8)
    base = [f"b{i}" for i in range(60)]
    rows = []
    for i in range(50):
        words = list(base)
        for _ in range(rng.randrange(8)):
            words[rng.randrange(60)] = f"x{rng.randrange(40)}"
        rows.append((i, " ".join(words)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute(rows, 4)
    monkeypatch.setattr(neardup, "PAIRS_PER_NODE", 0.02)
    monkeypatch.setattr(neardup, "TURNS", 1)
    monkeypatch.setattr(neardup, "BLOCK", 7)
    for looks in (10_000, 0):  # in blocks, by turns alone
        monkeypatch.setattr(neardup, "LOOKS_PER_PAIR", looks)
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates(df, shingle_words=4, tables=12).collect()}
        assert got == want
