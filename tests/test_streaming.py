import json

from pyspark.sql import functions as F

from emberloom.streaming import cdc, queue

LOG = [
    ("INSERT", "a", 1, {"name": "", "x": "1"}),
    ("UPDATE", "a", 2, {"name": "n"}),
    ("UPDATE", "a", 3, {"name": ""}),
    ("UPDATE", "b", 4, {"name": "late"}),
    ("INSERT", "c", 5, {"name": "c"}),
    ("DELETE", "c", 6, None),
    ("UPDATE", "c", 7, {"x": "9"}),
    ("INSERT", "d", 8, {"x": "1"}),
]


def log(spark):
    return spark.createDataFrame(LOG, cdc.LOG)


def test_list_view_needs_an_insert(spark):
    got = cdc.list_view(log(spark)).collect()
    assert [(r.id, r.payload) for r in got] == [("d", {"x": "1"}), ("a", {"x": "1", "name": ""})]
    assert [r.id for r in cdc.list_view(log(spark), 1).collect()] == ["d"]


def test_gallery_keeps_named_rows(spark):
    got = {r.id: (r.shown_seq, r.payload) for r in cdc.gallery_view(log(spark)).collect()}
    assert got == {"a": (2, {"x": "1", "name": ""}), "b": (4, {"name": "late"})}


def test_streams_equal_batch(spark, tmp_path):
    source, stored = str(tmp_path / "in"), str(tmp_path / "log")
    for k in range(4):  # several micro-batches
        spark.createDataFrame(LOG[2 * k : 2 * k + 2], cdc.LOG).coalesce(1).write.mode("append").parquet(source)
    read = lambda: spark.readStream.schema(cdc.LOG).option("maxFilesPerTrigger", 1).parquet(source)
    cdc.store_log(read(), stored, str(tmp_path / "c1")).awaitTermination(120)
    again = spark.read.schema(cdc.LOG).parquet(stored)
    assert sorted(map(str, cdc.list_view(again).collect())) == sorted(map(str, cdc.list_view(log(spark)).collect()))

    seen = str(tmp_path / "seen")

    def keep(df, epoch):
        df.write.mode("overwrite").parquet(f"{seen}/epoch={epoch}")

    cdc.keep_state(read()).writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", str(tmp_path / "c2")).trigger(availableNow=True).start().awaitTermination(180)
    last = spark.read.parquet(seen).groupBy("id").agg(F.max_by(F.struct("shown", "payload_json"), "seq").alias("s")).filter("s.shown").select("id", "s.payload_json").collect()
    assert {r.id: json.loads(r.payload_json) for r in last} == {r.id: r.payload for r in cdc.gallery_view(log(spark)).collect()}


def test_queue_handles_each_key_once(spark, tmp_path):
    source, done = str(tmp_path / "in"), str(tmp_path / "done")
    states = [("a", True, False), ("b", True, True), ("c", False, False), ("a", True, False), ("d", True, False)]
    for k, s in enumerate(states):
        spark.createDataFrame([s], "id string, print_triggered boolean, printed boolean").coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema("id string, print_triggered boolean, printed boolean").option("maxFilesPerTrigger", 1).parquet(source)
    queue.drain(stream, lambda df: df.select("id", F.lit(True).alias("ok")), done, str(tmp_path / "c"), availableNow=True).awaitTermination(180)
    assert sorted(r.id for r in spark.read.parquet(done).collect()) == ["a", "d"]


def test_incremental_embedding_resumes(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    for part in ((1, 2), (2, 3)):
        spark.createDataFrame([(i, f"t{i}") for i in part], "id long, text string").coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema("id long, text string").parquet(source)
        queue.embed_incrementally(stream, lambda df: df.withColumn("embedding", F.array(F.lit(1.0))), out, str(tmp_path / "c")).awaitTermination(120)
    assert sorted(r.id for r in spark.read.parquet(out).collect()) == [1, 2, 3]


def test_retries_then_dropped(spark):
    rows = [("a", 1, True), *[("b", i, False) for i in range(5)], *[("c", i, False) for i in range(4)], ("d", 1, False), ("d", 2, True)]
    got = {r.id: (r.attempts, r.retries, r.outcome) for r in queue.retry_state(spark.createDataFrame(rows, "id string, seq long, ok boolean")).collect()}
    assert got == {"a": (1, 0, "printed"), "b": (5, 4, "dropped"), "c": (4, 3, "queued"), "d": (2, 0, "printed")}


def test_refetch(spark):
    store = spark.createDataFrame([("a", "full"), ("b", "row")], "id string, big string")
    assert [tuple(r) for r in cdc.refetch(log(spark).filter("id = 'a'"), store).collect()] == [("a", "full")]


def test_views_equal_a_fold_in_order(spark):
    import random

    rng = random.Random(5)
    rows, seqs = [], list(range(120))
    rng.shuffle(seqs)
    for seq in seqs:
        op = rng.choice(["INSERT", "UPDATE", "UPDATE", "UPDATE", "DELETE"])
        payload = {k: rng.choice(["", "x", None, "y"]) for k in rng.sample(["name", "p", "q"], rng.randint(0, 3))}
        rows.append((op, rng.choice([None, "a", "b", "c", "d", "e"]), seq, None if op == "DELETE" or rng.random() < 0.1 else payload))
    listed, shown = {}, {}
    for op, key, seq, payload in sorted(rows, key=lambda r: r[2]):
        payload = payload or {}
        if op == "DELETE":
            listed.pop(key, None)
            shown[key] = (None, {})
            continue
        if op == "INSERT":
            listed[key] = (seq, dict(payload))
        elif key in listed:
            listed[key][1].update(payload)
        since, fields = shown.get(key, (None, {}))
        since = seq if since is None and payload.get("name") else since
        shown[key] = (since, dict(payload) if op == "INSERT" else fields | payload)
    df = spark.createDataFrame(rows, cdc.LOG)
    assert {r.id: (r.created_seq, r.payload) for r in cdc.list_view(df, None).collect()} == listed
    assert {r.id: (r.shown_seq, r.payload) for r in cdc.gallery_view(df).collect()} == {k: v for k, v in shown.items() if v[0] is not None}


def test_retry_queue_survives_and_discards(spark, tmp_path):
    q = queue.RetryQueue(spark, str(tmp_path / "q"))
    q.drain(lambda df: df.withColumn("ok", F.lit(True)))  # nothing waits
    q.enqueue(spark.createDataFrame([("a", "1"), ("b", "2")], "id string, job string"))
    q = queue.RetryQueue(spark, str(tmp_path / "q"))  # a consumer that starts again
    only_a = lambda df: df.withColumn("ok", F.when(F.col("id") == "a", True))
    kept = []
    for _ in range(5):
        q.drain(only_a)
        kept.append([(r.id, r.retries) for r in q.waiting().collect()])
    assert kept == [[("b", 1)], [("b", 2)], [("b", 3)], [], []]
    assert [tuple(r) for r in q.discarded().collect()] == [("b", "2", 3)]
