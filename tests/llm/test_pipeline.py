import hashlib
import math
import uuid
from collections import Counter

import pytest
import test_decontam
import test_neardup
from pyspark.sql import functions as F

import corpus_pipeline
from emberloom.llm import mixing, toxicity
from emberloom.llm.common import Hasher
from emberloom.llm.registry import TOXICITY_CHAIN

STAGE = dict(corpus_pipeline.STAGES)
PASSAGE = "one two three four five six seven eight nine ten eleven twelve thirteen"


@pytest.fixture(scope="module")
def tables(spark, sf, tmp_path_factory):
    """The small documents, and rows of every awkward kind, with columns that the operators use as names of their own."""
    folder = tmp_path_factory.mktemp("tables")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    odd = [(None, PASSAGE, "en", None), (None, PASSAGE, "en", None), (None, None, None, "a"), (None, None, None, "a"), (9001, None, "en", "a"), (9002, "", "en", "a"), (9003, " \n", "en", None)]
    odd += [(9004, PASSAGE + " x", "en", "a"), (9004, PASSAGE + " x", "en", "a"), (9005, PASSAGE, "en", "a"), (9006, PASSAGE, "en", "b"), (9007, "word " * 40_000, "en", "b"), (9004, "another text of that id", "en", "b")]
    rows = spark.createDataFrame([(*r, len(r[1] or "")) for r in odd], "doc_id long, text string, lang string, source string, n_chars long")
    taken = ["id", "n", "copy", "shard", "shard_2", "shuffle_key", "component_id", "kept", "rejected", "component", "node", "gone", "row", "rate", "a.b"]
    docs.unionByName(rows).withColumns({c: F.lit(-7) for c in taken}).write.parquet(f"{folder}/documents.parquet")
    bench = spark.read.parquet(f"{sf}/benchmark.parquet")
    bench.unionByName(spark.createDataFrame([(9001, None), (9002, "another text of that")], "item_id long, text string")).write.parquet(f"{folder}/benchmark.parquet")
    spark.read.parquet(f"{sf}/labels.parquet").write.parquet(f"{folder}/labels.parquet")
    return str(folder)


def key(r):
    return r.doc_id, r.text, r.source


def counted(df):
    return Counter(key(r) for r in df.collect())


def staged(spark, name, docs, folder, tmp_path):
    out = STAGE[name](spark, docs, folder)
    if name != "sharding":
        assert out.columns == docs.columns
    out.write.parquet(path := f"{tmp_path}/{uuid.uuid4().hex}")
    return spark.read.parquet(path)


def test_toxicity_stage(spark, tables, tmp_path):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    chain = toxicity.train_chain(docs, spark.read.parquet(f"{tables}/labels.parquet"), TOXICITY_CHAIN)
    hasher = Hasher("alnum")
    want = Counter(key(r) for r in docs.collect() if chain.probabilities(hasher, [(r.text or "").encode()])[0, -1] < chain.threshold)
    assert counted(staged(spark, "toxicity", docs, tables, tmp_path)) == want


def test_near_duplicate_stage(spark, tables, tmp_path):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    rows = docs.collect()
    comps = test_neardup.brute([(k, r.text) for k, r in enumerate(rows) if r.doc_id is not None], 5)  # by row, as an id may have two texts
    least = {}
    for k, (_, c) in comps.items():
        least[c] = min(least.get(c, rows[k].doc_id), rows[k].doc_id)
    joined = {rows[k].doc_id for k, (_, c) in comps.items() if least[c] < rows[k].doc_id}
    want = Counter({key(r)[:2]: 1 for r in rows if r.doc_id is not None and r.doc_id not in joined})
    want += Counter(key(r)[:2] for r in rows if r.doc_id is None)
    assert Counter(key(r)[:2] for r in staged(spark, "near_duplicates", docs, tables, tmp_path).collect()) == want


def test_decontamination_stage(spark, tables, tmp_path):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{tables}/benchmark.parquet").collect() if r.text]
    some = docs.filter("length(text) < 3000 OR text IS NULL")  # the plain distance is slow
    bad = {x[0] for x in test_decontam.brute([(k, r.text) for k, r in enumerate(some.collect())], items)}
    want = Counter(key(r) for k, r in enumerate(some.collect()) if k not in bad)
    assert bad and counted(staged(spark, "decontamination", some, tables, tmp_path)) == want


def test_mixing_stage(spark, tables, tmp_path):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    rows = docs.collect()
    n = Counter(r.source for r in rows)
    total = math.fsum(x**0.7 for x in n.values())
    want = Counter()
    for r in rows:
        mean, name = n[r.source] ** 0.7 / total * len(rows) / n[r.source], str(r.doc_id) if r.doc_id is not None else r.text or ""
        copies, parts = 0, math.ceil(mean / mixing.PART)
        for j in range(1, parts + 1):
            u, p, k = int(hashlib.md5(f"{name}|{j}|42".encode()).hexdigest()[:13], 16) / 2**52, math.exp(-mean / parts), 0
            below = p
            while below <= u:
                k += 1
                p *= mean / parts / k
                below += p
            copies += k
        want[key(r)] += copies
    got = staged(spark, "mixing", docs, tables, tmp_path)
    assert counted(got) == +want


def test_sharding_stage(spark, tables, tmp_path):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    got = staged(spark, "sharding", docs, tables, tmp_path)
    assert got.columns == [*docs.columns, "shard_3"] and got.filter("shard_3 IS NULL OR shard <> -7").count() == 0
    assert Counter(map(tuple, got.drop("shard_3").collect())) == Counter(map(tuple, docs.collect()))


def test_empty_tables(spark, tables, tmp_path):
    docs = spark.read.parquet(f"{tables}/documents.parquet").limit(0)
    for name, _ in corpus_pipeline.STAGES:
        assert staged(spark, name, docs, tables, tmp_path).count() == 0


def test_stages_one_after_the_other(spark, tables, tmp_path):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    for name, _ in corpus_pipeline.STAGES:
        docs = staged(spark, name, docs, tables, tmp_path)
    got = corpus_pipeline.run(spark, tables)
    assert counted(got) == counted(docs) and got.count() > 50
