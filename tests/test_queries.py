"""Every query against its SQL twin; queries without one must run and keep their invariants."""

import duckdb
import pytest

from emberloom.operators import search
from emberloom.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
#: Queries that are held to their SQL on copies of rows, too.
COPIED = ["allpairs_topk", "aspect_examples", "bootstrap_interval", "mutual_neighbour_clusters", "precision_at_5_cosine", "precision_at_5_dot"]


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    c.sql("SET timezone = 'UTC'")
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


def plain(rows):
    return sorted((tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in rows), key=str)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_same_as_sql(spark, con, sf, name):
    df = registry.queries()[name](spark, sf)
    want = con.sql(registry.oracle_sql()[name])
    assert sorted(df.columns) == sorted(want.columns)
    order = [want.columns.index(c) for c in df.columns]
    assert plain(df.collect()) == plain([tuple(r[i] for i in order) for r in want.fetchall()])


@pytest.fixture(scope="module")
def copies(sf, tmp_path_factory):
    """The embeddings three times over, with shifted keys."""
    path = tmp_path_factory.mktemp("copies")
    duckdb.sql(f"COPY (SELECT (vec_id + 1000 * k)::BIGINT AS vec_id, embedding, label FROM '{sf}/embeddings.parquet', range(3) t(k)) TO '{path}/embeddings.parquet'")
    return str(path)


@pytest.mark.parametrize("name", COPIED)
def test_same_as_sql_on_copies_in_blocks(spark, copies, monkeypatch, name):
    monkeypatch.setattr(search, "BLOCK", 400)
    c = duckdb.connect()
    c.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{copies}/embeddings.parquet'")
    want = c.sql(registry.oracle_sql()[name])
    coalesce = "spark.sql.adaptive.coalescePartitions.enabled"
    old = spark.conf.get(coalesce)
    spark.conf.set(coalesce, "false")
    try:
        df = registry.queries()[name](spark, copies)
        order = [want.columns.index(x) for x in df.columns]
        assert plain(df.collect()) == plain([tuple(r[i] for i in order) for r in want.fetchall()])
    finally:
        spark.conf.set(coalesce, old)


def same_as_sql_on(spark, path, name, rows):
    """name against its SQL on the embeddings that the SELECT rows gives."""
    duckdb.sql(f"COPY ({rows}) TO '{path}/embeddings.parquet'")
    c = duckdb.connect()
    c.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{path}/embeddings.parquet'")
    want = c.sql(registry.oracle_sql()[name])
    df = registry.queries()[name](spark, str(path))
    order = [want.columns.index(x) for x in df.columns]
    assert [*map(str, plain(df.collect()))] == [*map(str, plain([tuple(r[i] for i in order) for r in want.fetchall()]))]


def test_clusters_have_one_row_for_an_id_that_repeats(spark, sf, tmp_path):
    rows = f"SELECT vec_id, embedding, label FROM '{sf}/embeddings.parquet' WHERE vec_id < 60"
    other = "SELECT vec_id, list_transform(embedding, lambda x: (-x)::FLOAT) AS embedding, label"
    same_as_sql_on(spark, tmp_path, "mutual_neighbour_clusters", f"{rows} UNION ALL {rows} AND vec_id % 7 = 0 UNION ALL {other} FROM ({rows}) WHERE vec_id % 11 = 0")


@pytest.mark.parametrize("name", ["precision_at_5_cosine", "precision_at_5_dot"])
def test_rows_without_id_are_no_neighbours(spark, sf, tmp_path, name):
    rows = f"SELECT vec_id, embedding, label FROM '{sf}/embeddings.parquet'"
    same_as_sql_on(spark, tmp_path, name, f"{rows} UNION ALL SELECT NULL, embedding, label FROM ({rows}) WHERE vec_id % 3 = 0")


@pytest.mark.parametrize("rows", ["SELECT vec_id - 250 AS vec_id, embedding, label FROM '{}'", "SELECT * FROM '{}' WHERE label = 3 LIMIT 3", "SELECT * FROM '{}' LIMIT 1"])
def test_bootstrap_interval_of_negative_ids_and_few_rows(spark, sf, tmp_path, rows):
    same_as_sql_on(spark, tmp_path, "bootstrap_interval", rows.format(f"{sf}/embeddings.parquet"))


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_runs(spark, sf, name):
    assert registry.queries()[name](spark, sf).count() > 0


def test_bootstrap_interval_holds_the_mean(spark, sf):
    r = registry.queries()["bootstrap_interval"](spark, sf).first()
    assert 0 <= r.lo < r.mean < r.hi <= 1


def test_training_lowers_the_loss(spark, sf):
    rows = registry.queries()["train_projection"](spark, sf).orderBy("epoch").collect()
    assert rows[-1].total < rows[0].total


def test_clusters_are_large_enough(spark, sf):
    df = registry.queries()["mutual_neighbour_clusters"](spark, sf)
    assert df.filter("cluster_id >= 0").groupBy("cluster_id").count().filter("count < 5").count() == 0
    assert df.filter("cluster_id = -1 AND confidence IS NOT NULL").count() == 0


def test_every_cluster_is_described(spark, tmp_path):
    counts = {"A": (31, 9, 9), "B": (33, 40, 127), "C": (1, 1), "D": (5, 3), "E": (25, 15), "F": (156, 100, 540)}
    rows = [(b, f"t{i}") for b, ns in counts.items() for i, n in enumerate(ns) for _ in range(n)]
    spark.createDataFrame(rows, "p_brand string, p_type string").write.parquet(f"{tmp_path}/part.parquet")
    got = {r.p_brand: r.description for r in registry.queries()["describe_clusters"](spark, str(tmp_path)).collect()}
    want = {"A": "「t0」型 63%", "B": "「t2」型 64%；t1 20%", "C": "「t0」型 50%；t1 50%", "D": "「t0」型 62%；t1 38%", "E": "「t0」型 62%；t1 38%", "F": "「t2」型 68%"}
    assert got == want
    c = duckdb.connect()
    c.sql(f"CREATE VIEW part AS SELECT * FROM '{tmp_path}/part.parquet/*.parquet'")
    assert dict(c.sql(registry.oracle_sql()["describe_clusters"]).fetchall()) == want


def test_retries_count_every_attempt(spark, tmp_path):
    rows = [(i, 1, "error", 0.0) for i in range(1, 15)] + [(20, 2, "error", 0.0), (21, 2, "purchase", 100.0), (22, 3, "purchase", 99.0), (27, 3, "purchase", None), (23, 4, "view", 300.0)]
    spark.createDataFrame(rows, "event_id long, user_id long, event_type string, value double").write.parquet(f"{tmp_path}/events.parquet")
    got = sorted(tuple(r) for r in registry.queries()["print_retries"](spark, str(tmp_path)).collect())
    want = [(1, 14, 13, "dropped"), (2, 2, 0, "printed"), (3, 2, 1, "queued"), (4, 1, 0, "queued")]
    assert got == want
    c = duckdb.connect()
    c.sql(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    assert sorted(c.sql(registry.oracle_sql()["print_retries"]).fetchall()) == want


def test_pairs_up_to_the_cap_of_the_reference(spark, sf):
    assert registry.queries()["topic_pairs"](spark, sf.replace("0.001", "0.1")).count() == 5000


def test_training_queries_run_the_whole_job(spark, sf, monkeypatch):
    runs = []

    def train(data, width=128, epochs=100, weight_orthogonal=0.1, **kw):
        runs.append((len(data), width, epochs, weight_orthogonal))
        return registry.training.Projection({}, [dict.fromkeys([*registry.AXES, "orthogonality", "total"], 1.0)] * epochs)

    monkeypatch.setattr(registry.training, "train", train)
    assert registry.queries()["train_projection"](spark, sf).count() == 100
    assert registry.queries()["ablation"](spark, sf).count() == 10
    grid = [(2, 128, 80, 0.1), (3, 128, 80, 0.1)] + [(3, w, 80, 0.1) for w in (64, 128, 256)] + [(3, 128, 80, x) for x in (0.0, 0.01, 0.1, 0.5, 1.0)]
    assert runs == [(3, 128, 100, 0.1), *grid]


def test_probe_has_five_folds(spark, sf):
    assert registry.queries()["probe_accuracy"](spark, sf).first().folds == 5
