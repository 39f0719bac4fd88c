import random

from emberloom.llm.common import Hasher
from emberloom.llm.decontam import Index, drop_contaminated, find_matches
from emberloom.llm.registry import op6_benchmark_matches


def words(text):
    import re

    return re.findall(r"[\u3041-\u30ff\u3400-\u9fff]|[^\W_\u3041-\u30ff\u3400-\u9fff]+", (text or "").lower())


def distance(item, text):
    """Least edits that turn item into some stretch of text."""
    row = [0] * (len(text) + 1)
    for i, a in enumerate(item, 1):
        new = [i]
        for j, b in enumerate(text, 1):
            new.append(min(row[j - 1] + (a != b), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


def brute(docs, items, rate=0.25, least=5):
    out = set()
    for d, t in docs:
        for i, x in items:
            w = words(x)
            if w and (n := distance(w, words(t))) <= (int(rate * len(w)) if len(w) >= least else 0):
                out.add((d, i, n))
    return out


def corpus(seed):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(60)]
    items = [(i, " ".join(rng.choices(vocab, k=rng.randrange(1, 90)))) for i in range(25)]
    docs = []
    for d in range(150):
        text = rng.choices(vocab, k=rng.randrange(0, 120))
        if rng.random() < 0.6:
            own = rng.choice(items)[1].split()
            for _ in range(rng.randrange(0, 1 + len(own) // 3)):
                at = rng.randrange(len(own) + 1)
                own[at : at + rng.randrange(2)] = rng.choices(vocab, k=rng.randrange(2))
            at = rng.randrange(len(text) + 1)
            text[at:at] = own
        docs.append((d, ". ".join(w.upper() if rng.random() < 0.2 else w for w in text)))
    return docs, items


def test_same_as_brute_force(spark):
    docs, items = corpus(4)
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    b = spark.createDataFrame(items, "item_id long, text string")
    want = brute(docs, items)
    assert {(r.doc_id, r.item_id, r.distance) for r in find_matches(d, b).collect()} == want
    assert {(r.doc_id, r.item_id, r.distance) for r in find_matches(d, b, block_bytes=1500).collect()} == want
    assert {r.doc_id for r in drop_contaminated(d, b).collect()} == {i for i, _ in docs} - {x[0] for x in want}


def test_myers_end_and_distance():
    index = Index.of([(1, "a b c d e f g h")], 0.25, 5)
    got = index.matches(Hasher("alnum"), [b"x a b c z e f g h y", b"a b c", b"", b"a b c d e f g"])
    assert got == [[(1, 1, 9)], [], [], [(1, 1, 7)]]


def test_edge_rows(spark):
    passage = "one two three four five six seven eight"
    docs = [(None, passage, 1), (1, None, 1), (2, "", 1), (3, passage.upper(), 1), (3, passage.upper(), 1), (4, "pad " * 50_000 + passage, 2**60 + 1)]
    d = spark.createDataFrame(docs, "doc_id long, text string, item_id long")
    b = spark.createDataFrame([(1, passage), (2, None), (3, "one two"), (4, "two one"), (5, " -- "), (None, passage)], "item_id long, text string")
    got = sorted((r.doc_id or 0, r.item_id or 0, r.distance) for r in find_matches(d, b).collect())
    assert got == sorted((x, i, 0) for x in (0, 3, 3, 4) for i in (0, 1, 3))
    assert sorted(r.doc_id for r in drop_contaminated(d, b).collect()) == [1, 2]
    none = spark.createDataFrame([], d.schema)
    assert find_matches(none, b).collect() == [] and find_matches(d, b.limit(0)).collect() == []
    assert drop_contaminated(d, b.limit(0)).count() == len(docs)


def test_scripts_quotes_and_short_items(spark):
    docs = [(1, "Er sagte: \u201eDer Fluss fließt leise\u201c \u2014 und ging."), (2, "昔々あるところにおじいさんとおばあさんがいました。"), (3, "naïve\u00a0café"), (4, "昔々ある山に"), (5, "yes"), (6, "yesterday")]
    items = [(1, 'er sagte "der fluss fließt leise" und ging'), (2, "あるところにおじいさんと"), (3, "naïve café"), (4, "yes"), (5, "おじいさんとおばあさんかいました")]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id, r.distance) for r in find_matches(d, b).collect()}
    assert got == brute(docs, items) == {(1, 1, 0), (2, 2, 0), (3, 3, 0), (5, 4, 0), (2, 5, 1)}


def test_query_same_as_brute_force(spark, sf):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect() if len(r.text or "") < 20_000]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    got = {(r.doc_id, r.item_id, r.distance) for r in op6_benchmark_matches(spark, sf).collect()}
    found = {x[0] for x in got}
    some = [(d, t) for d, t in docs if d in found or d % 20 == 0]  # the plain distance is slow
    assert {x for x in got if x[0] in dict(some)} == brute(some, items)
