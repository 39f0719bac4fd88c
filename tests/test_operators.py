import functools
import math
import random
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from emberloom.functions import vectors as V
from emberloom.operators import corpus, evaluation, names, ranking, search, serving, survey, training
from emberloom.operators.embedders import embed, hashing_embedder
from emberloom.sources import readers, writers


def test_rounding_rules(spark):
    df = spark.createDataFrame([(-0.0025, 0.0025, 0.0015)], "a double, b double, c double")
    r = df.select(V.round_half_up(F.col("a")), V.round_half_up(F.col("b")), V.round_half_even(F.col("c"))).first()
    assert tuple(r) == (-0.002, 0.003, 0.002)


def test_zero_vectors(spark):
    df = spark.createDataFrame([(1, [0.0, 0.0]), (2, [3.0, 4.0]), (3, [3.0, 4.0])], "id long, embedding array<double>")
    got = search.search_by_embedding(df, [6.0, 8.0], 3).collect()
    assert [(r.id, r.similarity) for r in got] == [(2, 1.0), (3, 1.0), (1, 0.0)]
    p = search.project(df, [[1.0, 0.0], [0.0, 1.0]], ["x"]).orderBy("id").collect()
    assert p[0].x == [0.0, 0.0] and p[1].x == pytest.approx([0.6, 0.8])


def test_region_weight():
    q = search.project_vector([[1.0, 0.0], [0.0, 1.0]], ["topic", "location"], [3.0, 0.0])
    assert q == {"topic": [1.0], "location": [0.0]}


def test_blocked_neighbours_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(search, "BLOCK", 30)
    rng = np.random.default_rng(0)
    rows = [(i, rng.normal(size=6).tolist()) for i in range(100)]
    df = spark.createDataFrame(rows, "id long, embedding array<double>")
    m = np.array([v for _, v in rows])
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    s = m @ m.T
    np.fill_diagonal(s, -9)
    got = {(r.query_id, r["rank"]): r.id for r in search.neighbours(df, k=4).collect()}
    assert got == {(i, k + 1): int(j) for i in range(100) for k, j in enumerate(np.argsort(-s[i])[:4])}


@pytest.fixture
def many_partitions(spark):
    """No task takes in the groups of several partitions, as in any large run."""
    name = "spark.sql.adaptive.coalescePartitions.enabled"
    old = spark.conf.get(name)
    spark.conf.set(name, "false")
    yield
    spark.conf.set(name, old)


@pytest.mark.parametrize("metric", ["cosine", "dot"])
def test_blocks_in_many_partitions_lose_no_neighbour(spark, monkeypatch, many_partitions, metric):
    monkeypatch.setattr(search, "BLOCK", 30)
    monkeypatch.setattr(search, "SLICE", 7)
    rng = np.random.default_rng(1)
    vectors = rng.integers(-3, 4, (100, 6)).astype(float) + 0.1
    rows = [(i, vectors[i % 37].tolist()) for i in range(100)] + [(100, None), (101, [0.0] * 6), (102, [float("nan")] * 6)]

    def score(a, b):
        d, m, n = (functools.reduce(lambda s, xy: s + xy[0] * xy[1], zip(u, v), 0.0) for u, v in ((a, b), (a, a), (b, b)))
        return d if metric == "dot" else d / math.sqrt(m * n) if m * n else 0.0

    known = [r for r in rows[:102] if r[1]]
    want = {i: [j for _, j in sorted((-score(a, b), j) for j, b in known if j != i)[:4]] for i, a in known}
    got = search.neighbours(spark.createDataFrame(rows, "id long, embedding array<double>").repartition(5), k=4, metric=metric).orderBy("query_id", "rank").collect()
    assert {i: [r.id for r in got if r.query_id == i] for i in {r.query_id for r in got}} == want


def test_rows_of_one_id_are_no_neighbours_of_each_other(spark):
    df = spark.createDataFrame([(i % 4, [1.0, 2.0]) for i in range(12)], "id long, embedding array<float>")
    got = sorted((r.query_id, r["rank"], r.id) for r in search.neighbours(df, df.filter("id = 0").limit(1), k=4).collect())
    assert got == [(0, 1, 1), (0, 2, 1), (0, 3, 1), (0, 4, 2)]


def test_copies_are_projected_to_the_same_bits_in_any_batch(spark):
    v = np.random.default_rng(0).normal(size=64).tolist()
    parts = [spark.createDataFrame([(i, v) for i in range(n)], "id long, embedding array<double>").coalesce(1) for n in (1, 2, 100)]
    rows = [r for df in parts for r in search.project(df, search.synthetic_projection(), ["a", "b", "c"]).collect()]
    assert len({tuple([*r.a, *r.b, *r.c]) for r in rows}) == 1


def test_first_duplicate_hides_later_ones(spark):
    raw = spark.createDataFrame([(0, "河童[1]", "\n\n　　　　　　　　　　　　"), (1, "天狗", "山にいる天狗の話である。"), (2, "天狗[2]", "ほかの天狗の長い長い話。"), (3, "鬼", "短い"), (4, "雪女", "[1]" * 12), (5, "雪女", "雪の夜に現れる女である。")], "ordinal long, name string, detail string")
    got = corpus.clean_corpus(raw, "s", "item").orderBy("id").collect()
    assert [(r.id, r.name) for r in got] == [("item-0001", "天狗")]


def test_pairs_sharing_two_regions_come_twice(spark):
    df = spark.createDataFrame([(1, "x"), (1, "y"), (2, "x"), (2, "y"), (3, "y")], "id long, g string")
    assert sorted((r.a, r.b) for r in corpus.group_pairs(df, "g").collect()) == [(1, 2), (1, 2), (1, 3), (2, 3)]


def test_drawn_pairs(spark):
    rows = [(f"{g}{i:03}", g) for g, n in (("x", 40), ("y", 3), ("z", 1), ("w", 25)) for i in range(n)] + [("n", None), (None, "x")]
    df = spark.createDataFrame(rows, "id string, g string")
    every = {(r.a, r.b) for r in corpus.group_pairs(df.dropna(), "g").collect()}
    assert len(every) == 780 + 3 + 300
    for cap in (1, 7, 500, 1082, 1083, 5000):
        got = [(r.a, r.b) for r in corpus.draw_pairs(df, "g", "t", cap).collect()]
        assert len(got) == len(set(got)) == min(cap, len(every)) and set(got) <= every
    other = {(r.a, r.b) for r in corpus.draw_pairs(df, "g", "t", 500, seed=7).collect()}
    assert other != {(r.a, r.b) for r in corpus.draw_pairs(df, "g", "t", 500).collect()}
    assert corpus.draw_pairs(df.limit(0), "g", "t").count() == 0
    twice = corpus.draw_pairs(df.union(df), "g", "t")
    assert sorted((r.a, r.b) for r in twice.collect()) == sorted(every)


def test_index_of_any_size(spark):
    df = spark.createDataFrame([(3, ["a", "b"]), (1, ["a"]), (2, ["a", "a"]), (4, None)], "id long, g array<string>")
    rows = corpus.index_rows(df, "g", multi=True)
    assert {r.key: (r.first_ids, r.n) for r in corpus.index_heads(rows, 2).collect()} == {"a": ([1, 2], 3), "b": ([3], 1)}
    assert {r.key: r.ids for r in corpus.inverted_index(df, "g", multi=True).collect()} == {"a": [1, 2, 3], "b": [3]}


def test_circular_slice_of_few_rows(spark):
    df = spark.range(3).select(F.col("id").alias("o"))
    got = ranking.circular_slice(df, "o", 3, F.lit(5)).orderBy("position").collect()
    assert [(r.position, r.o) for r in got] == [(0, 2), (1, 0), (2, 1), (3, 2)] or [r.o for r in got] == [2, 0, 1]


def test_shift_of_nothing_is_null(spark):
    df = spark.createDataFrame([], "pre string, post string")
    assert tuple(survey.shift_rate(df, "pre", "post").first()) == (0, 0, None)


def test_precision_counts_over_k(spark):
    near = spark.createDataFrame([(1, 2), (1, 3), (9, 1)], "query_id long, id long")
    labels = spark.createDataFrame([(1, 5), (2, 5), (3, None), (9, None)], "id long, label long")
    assert [tuple(r) for r in evaluation.precision_at_k(near, labels).collect()] == [(1, 0.2)]


def test_probe_needs_two_classes(spark):
    df = spark.createDataFrame([(i, [float(i)], "a") for i in range(5)], "id long, v array<double>, y string")
    assert "note" in evaluation.probe(df, "v", "y")


def test_probe_on_separable_classes(spark):
    rng = np.random.default_rng(1)
    rows = [(i, (rng.normal(size=3) + (4 if i % 2 else -4)).tolist(), i % 2) for i in range(60)]
    assert evaluation.probe(spark.createDataFrame(rows, "id long, v array<double>, y int"), "v", "y", most_folds=2)["accuracy"] > 0.95


def test_info_nce_gradient():
    rng = np.random.default_rng(0)
    a, b = (x / np.linalg.norm(x, axis=1, keepdims=True) for x in rng.normal(size=(2, 5, 4)))
    loss, ga, _ = training.info_nce(a, b)
    e = 1e-6 * rng.normal(size=a.shape)
    assert training.info_nce(a + e, b)[0] - loss == pytest.approx((ga * e).sum(), rel=1e-3)
    assert training.info_nce(a[:1], b[:1])[0] == 0


def test_orthogonality_gradient():
    rng = np.random.default_rng(0)
    xs = [rng.normal(size=(6, 3)) for _ in range(3)]
    loss, gs = training.orthogonality(xs)
    e = [1e-6 * rng.normal(size=(6, 3)) for _ in range(3)]
    assert training.orthogonality([x + d for x, d in zip(xs, e, strict=True)])[0] - loss == pytest.approx(sum((g * d).sum() for g, d in zip(gs, e, strict=True)), rel=1e-3)


def test_cache_is_first_in_first_out():
    now = [0.0]
    c = serving.ResultCache(capacity=2, ttl=10, clock=lambda: now[0])
    c.put("a", 1), c.put("b", 2)
    assert c.get("a") == 1
    c.put("c", 3)
    assert c.get("a") is None and c.get("b") == 2  # reading a did not save it
    now[0] = 10
    assert c.get("b") is None


def test_ladder_and_cooldown():
    now, asked = [0.0], []

    def embedder(text):
        asked.append(text)
        raise RuntimeError("quota")

    s = serving.SearchService(None, lambda v: "cosine", lambda key: "fallback", embedder, cooldown=serving.Cooldown(45, lambda: now[0]))
    assert s.search("k", "t") == "fallback" and s.search("k", "t") == "fallback" and len(asked) == 1
    now[0] = 46
    s.embed = lambda text: [1.0]
    assert s.search("k", "t") == "cosine" and s.cache.get("k") == "cosine"
    s.aspect = lambda v, region: "aspect"
    assert s.search("other", "t") == "aspect"


def test_retry_waits():
    waits, calls = [], []

    def call():
        calls.append(1)
        if len(calls) < 3:
            raise RuntimeError("rate limit")
        return "ok"

    assert serving.retry(call, sleep=waits.append, rng=random.Random(1)) == "ok"
    assert 0.375 <= waits[0] <= 0.625 and 0.75 <= waits[1] <= 1.25
    with pytest.raises(ValueError):
        serving.retry(lambda: (_ for _ in ()).throw(ValueError("no")), sleep=waits.append)


def test_json_sources(spark, tmp_path):
    (tmp_path / "e.json").write_text('{"entries":[{"id":"1","name":"n","summary":"s","location":"l","source":"x"},{"id":"2"}]}')
    got = readers.json_entries(spark, str(tmp_path / "e.json"), readers.RAW_ENTRY).collect()
    assert [(r.id, r.name) for r in got] == [("1", "n"), ("2", None)]
    (tmp_path / "m.json").write_text('{"clusters":{"-1":{"id":-1,"size":2,"allYokai":["a"],"label":"x"}}}')
    assert [(r.key, r.id, r.allYokai) for r in readers.json_map(spark, str(tmp_path / "m.json"), readers.CLUSTER_LABEL).collect()] == [("-1", -1, ["a"])]


def test_fallback_chain(spark, tmp_path):
    writers.write_table(spark.range(2), str(tmp_path / "b"))
    said = []
    df = readers.first_of(spark, [(str(tmp_path / "a"), spark.read.parquet), (str(tmp_path / "b"), spark.read.parquet)], spark.range(1).schema, said.append)
    assert df.count() == 2 and len(said) == 1
    assert readers.first_of(spark, [], spark.range(1).schema).count() == 0


def test_binary_artefacts(spark, tmp_path):
    m = np.arange(12, dtype=np.float32).reshape(4, 3)
    data = writers.encode_matrix(m, 2, 2)
    assert struct.unpack_from("<4I", data) == (4, 3, 2, 2)
    writers.put_bytes(spark, str(tmp_path / "m.bin"), data)
    got, width, axes = readers.binary_matrix(spark, str(tmp_path / "m.bin"))
    assert (got == m).all() and (width, axes) == (2, 2)
    assert readers.decode_matrix(writers.encode_matrix(m, 0, 2))[1] == 128
    writers.put_bytes(spark, str(tmp_path / "v.bin"), writers.encode_vectors(m))
    rows = readers.binary_vectors(spark, str(tmp_path / "v.bin"))
    meta = spark.createDataFrame([(i, None if i else "x") for i in range(4)], "ordinal long, name string")
    out = readers.projected_entries(rows, meta, ["t"], 2).orderBy("ordinal").collect()
    assert [(r.name, r.t) for r in out][:2] == [("x", [0.0, 1.0]), ("", [3.0, 4.0])]
    assert writers.upload(spark, {"m.bin": str(tmp_path / "m.bin"), "no": str(tmp_path / "no")}, str(tmp_path / "up")).keys() == {"m.bin"}


def test_csv_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("1", "line\nbreak \"q\"", ["A", "B"]), ("2", None, None)], "id string, pre_image string, post_selections array<string>")
    writers.write_csv(df, str(tmp_path / "c"))
    got = readers.csv(spark, str(tmp_path / "c"), readers.SURVEY).select("id", "pre_image", "post_selections", "texture").orderBy("id").collect()
    assert tuple(got[0]) == ("1", 'line\nbreak "q"', ["A", "B"], None) and got[1].pre_image is None


def test_text_records_and_lookup(spark, tmp_path):
    (tmp_path / "a.txt").write_text("河童\n川に\nいる\n")
    r = readers.text_records(spark, str(tmp_path / "a.txt")).first()
    assert (r.name, r.body) == ("河童", "川に\nいる")
    with pytest.raises(LookupError):
        readers.lookup(spark.range(3), "id", 7)
    assert readers.lookup(spark.range(3), "id", 2).id == 2


def test_json_document(spark, tmp_path):
    writers.write_json_document(spark.createDataFrame([(2, "b"), (1, "a")], "id long, name string"), str(tmp_path / "d"), order="id")
    assert [r.name for r in readers.json_entries(spark, str(tmp_path / "d"), spark.createDataFrame([], "id long, name string").schema).collect()] == ["a", "b"]


def test_embedder_is_deterministic(spark):
    df = spark.createDataFrame([(1, "河童の話"), (2, "河童の話"), (3, None)], "id long, text string")
    got = embed(df, "text", hashing_embedder(16)).orderBy("id").collect()
    assert got[0].embedding == got[1].embedding and np.linalg.norm(got[0].embedding) == pytest.approx(1, abs=1e-6)


def test_first_hit_ranks_agree_with_the_full_ranking_in_any_number_of_blocks(spark, monkeypatch):
    rng = np.random.default_rng(7)
    rows = [(i, rng.normal(size=6).tolist(), int(rng.integers(0, 4)) if i % 9 else None) for i in range(60)] + [(60, [1.0] * 6, 77)]
    e = spark.createDataFrame(rows, "id long, embedding array<double>, label int")
    q = e.filter("id % 4 = 0")
    ranked = search.full_ranking(e, q).collect()
    want = {}
    label = {i: x for i, _, x in rows}
    for own in {r.query_id for r in ranked}:
        others = [r.id for r in sorted((r for r in ranked if r.query_id == own), key=lambda r: r["rank"]) if r.id != own]
        want[own] = next((k for k, i in enumerate(others, 1) if label[i] is not None and label[i] == label[own]), None)
    for block in (1000, 5):
        monkeypatch.setattr(search, "QUERY_BLOCK", block)
        assert sorted(map(tuple, search.full_ranking(e, q).collect())) == sorted(map(tuple, ranked))
        got = evaluation.first_hit_ranks(e, q)
        assert {r.query_id: r.r for r in got.collect()} == want
        labels = e.select("id", "label")
        assert evaluation.mean_reciprocal(got).first().mrr == pytest.approx(evaluation.mean_reciprocal_rank(search.full_ranking(e, q), labels).first().mrr)


def test_cross_probe_has_every_axis_and_label(spark):
    rng = np.random.default_rng(3)
    rows = []
    for i in range(60):
        a, b = i % 2, i // 2 % 2
        rows.append((i, [a + 0.01 * rng.normal(), rng.normal()], [b + 0.01 * rng.normal(), rng.normal()], a, b))
    df = spark.createDataFrame(rows, "id long, x array<double>, y array<double>, kind int, place int")
    got = {(r["axis"], r["label"]): r["accuracy"] for r in evaluation.cross_probe(df, ["x", "y"], ["kind", "place"], most_folds=3)}
    assert set(got) == {(a, b) for a in "xy" for b in ("kind", "place")}
    assert got["x", "kind"] > 0.95 and got["y", "place"] > 0.95 and got["x", "place"] < 0.8 and got["y", "kind"] < 0.8


def test_filters_drop_rows_without_their_values(spark):
    df = spark.createDataFrame([(1, 0, True, "s" * 31, "a"), (2, -1, True, "s" * 40, None), (3, 2, False, "s" * 30, "b"), (4, 3, True, None, "")], "id long, cluster_id int, has_embedding boolean, summary string, name string")
    ids = lambda d: sorted(r.id for r in d.collect())
    assert ids(corpus.only_usable(df)) == [1, 4] and ids(corpus.describable(df)) == [1]
    assert ids(survey.named(df, "name")) == [1, 3, 4] and ids(corpus.fully_labelled(df, ["summary", "name"])) == [1, 3]


def test_inserted_rows_are_returned_as_stored(spark, tmp_path):
    df = spark.createDataFrame([("x",), ("y",)], "v string")
    got = writers.insert(df, f"{tmp_path}/log", ["v"])
    assert sorted(map(str, got.collect())) == sorted(map(str, spark.read.parquet(f"{tmp_path}/log").collect()))


def test_bootstrap_partitions_do_not_matter(spark):
    df = spark.range(500).selectExpr("id AS query_id", "id % 7 / 7 AS precision")
    one, many = (evaluation.bootstrap_interval(df.repartition(n)).first() for n in (1, 6))
    assert [one.lo, one.hi, one.n] == pytest.approx([many.lo, many.hi, many.n]) and one.lo < one.mean < one.hi
    none = evaluation.bootstrap_interval(df.limit(0)).first()
    assert none.n == 0 and none.lo is None


def test_lookups_are_cached_with_their_errors(spark, tmp_path):
    path, asked = str(tmp_path / "cache"), str(tmp_path / "asked")

    def fetch(name):
        with open(asked, "a") as f:
            f.write(name + "\n")
        if name == "bad":
            raise ValueError("no")
        return len(name), 1

    first = spark.createDataFrame([("aa",), ("bad",), ("aa",), (None,), *[(f"n{i}",) for i in range(10)]], "search_name string")
    got = {r.search_name: (r.records, r.error) for r in names.cached_lookups(first, path, fetch, flush_every=4).collect()}
    assert len(got) == 12 and got["aa"] == (2, None) and got["bad"] == (0, "ValueError: no")
    again = names.cached_lookups(spark.createDataFrame([("bad",), ("new",)], "search_name string"), path, fetch).collect()
    assert sorted(r.search_name for r in again) == ["bad", "new"]
    assert sorted(open(asked).read().split()) == sorted(["aa", "bad", "new", *[f"n{i}" for i in range(10)]])
    assert names.cached_lookups(first.limit(0), path, fetch).count() == 0


def test_load_tiers(spark, tmp_path):
    import json

    m = np.arange(8.0).reshape(4, 2)
    paths = {k: str(tmp_path / k) for k in ("m.bin", "m.json", "v.bin", "meta.json", "p.json")}
    said = []
    assert readers.matrix_of_tiers(spark, paths["m.bin"], paths["m.json"], log=said.append) is None and len(said) == 2
    writers.put_bytes(spark, paths["m.json"], json.dumps({"matrix": m.tolist(), "subspaceDim": 2, "axes": ["a", "b"]}).encode())
    writers.put_bytes(spark, paths["m.bin"], b"xx")  # damaged
    got, width, axes = readers.matrix_of_tiers(spark, paths["m.bin"], paths["m.json"], log=said.append)
    assert got.tolist() == m.tolist() and (width, axes) == (2, 2) and len(said) == 3
    remote = (tmp_path / "m.json").as_uri()
    assert readers.matrix_of_tiers(spark, remote_document=remote)[0].tolist() == m.tolist()

    entries = [{"id": str(i), "name": f"n{i}"} for i in range(3)]
    vectors = np.arange(12.0).reshape(3, 4)
    document = {"entries": [e | {"a": v[:2].tolist(), "b": v[2:].tolist()} for e, v in zip(entries, vectors)]}
    writers.put_bytes(spark, paths["p.json"], json.dumps(document).encode())
    writers.put_bytes(spark, paths["meta.json"], json.dumps({"subspaceDim": 2, "entries": entries}).encode())
    load = lambda: readers.projected_of_tiers(spark, ["a", "b"], (paths["v.bin"], paths["meta.json"]), paths["p.json"], log=said.append)
    want = [(str(i), f"n{i}", "", v[:2].tolist(), v[2:].tolist()) for i, v in enumerate(vectors)]
    for data in (None, writers.encode_vectors(vectors[:2]), writers.encode_vectors(vectors)):
        if data:
            writers.put_bytes(spark, paths["v.bin"], data)
        assert sorted((r.id, r.name, r.summary, r.a, r.b) for r in load().collect()) == want
    assert len(said) == 5  # no vectors, too few
    assert readers.projected_of_tiers(spark, ["a"]) is None


def test_sparse_blocks_equal_one_block(spark, monkeypatch):
    texts = ["red gear", "red gears", "blue bolt", "blue", "", None, "red gear", "xyz", "bolt gear ring"]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    w = evaluation.tfidf(df, "id", evaluation.char_ngrams(F.col("text")))
    whole = sorted(evaluation.sparse_neighbours(w, 3).collect())
    monkeypatch.setattr(evaluation, "SPARSE_BLOCK", 2)
    assert sorted(evaluation.sparse_neighbours(w, 3).collect()) == whole
    assert [(r.query_id, r.id, r.score) for r in whole if r.rank == 1 and r.query_id in (0, 6)] == [(0, 6, 1.0), (6, 0, 1.0)]
    assert {r.query_id for r in whole} == {0, 1, 2, 3, 6, 8}
    assert evaluation.sparse_neighbours(w.limit(0)).count() == 0
