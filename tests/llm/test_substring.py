import hashlib
import random

import pytest

from emberloom.llm.substring import SuffixAutomaton, substring_dedup


def brute(rows, span=13):
    low = {}
    for i, t in rows:
        words = (t or "").encode().split()
        for k in range(len(words) - span + 1) if i is not None else ():
            w = tuple(words[k : k + span])
            low[w] = min(low.get(w, i), i)
    out = []
    for i, t in rows:
        words = (t or "").encode().split()
        gone = set()
        for k in range(len(words) - span + 1) if i is not None else ():
            if low[tuple(words[k : k + span])] < i:
                gone.update(range(k, k + span))
        kept = b" ".join(w for k, w in enumerate(words) if k not in gone)
        out.append((i, len(words), len(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def run(df, **kw):
    return sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup(df, **kw).collect()), key=str)


@pytest.mark.parametrize(("hot", "broadcast"), [(2048, 0), (2, 0), (2048, 1 << 21)])
def test_same_as_brute_force(spark, hot, broadcast):
    rng = random.Random(3)
    vocab = [f"w{i}" for i in range(30)]
    passages = [rng.choices(vocab, k=rng.randrange(8, 60)) for _ in range(12)]
    rows = []
    for i in range(80):
        words = []
        for _ in range(rng.randrange(1, 6)):
            words += rng.choice(passages) if rng.random() < 0.5 else rng.choices(vocab, k=rng.randrange(30))
        rows.append((i, rng.choice((" ", "\n", "\x0b ")).join(words)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert run(df, hot_anchor=hot, shard_words=200, broadcast_bytes=broadcast) == brute(rows)


@pytest.mark.parametrize("broadcast", [0, 1 << 21])
def test_edge_rows(spark, broadcast):
    twenty = " ".join(f"é{i} x" for i in range(20))
    rows = [(3, twenty), (1, None), (2, ""), (4, twenty), (4, twenty), (4, twenty.replace("é3", "e3")), (None, twenty), (5, "a " * 30_000), (6, "a " * 20_000), (7, "short text"), (0, "\n\n")]
    df = spark.createDataFrame([(*r, "z") for r in rows], "doc_id long, text string, kept_text string")
    assert run(df, broadcast_bytes=broadcast) == brute(rows)


@pytest.mark.parametrize("broadcast", [-1, 0])
def test_empty_table(spark, broadcast):
    assert run(spark.createDataFrame([], "doc_id long, text string"), broadcast_bytes=broadcast) == []


def test_all_documents_by_either_way(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert run(docs, broadcast_bytes=0) == run(docs, broadcast_bytes=1 << 30) == brute([(r.doc_id, r.text) for r in docs.collect()])


def test_automaton_matches_by_length():
    auto = SuffixAutomaton()
    auto.add("a b c d e".split(), 1)
    auto.add("x b c d y".split(), 2)
    assert auto.first_documents("z b c d y".split(), 3) == [None, 1, 2]
    assert auto.first_documents("c d e a b".split(), 3) == [1, None, None]
