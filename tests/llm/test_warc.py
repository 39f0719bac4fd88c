import random

import duckdb

from emberloom.llm.registry import op3_revisits
from emberloom.llm.warc import ORACLE, canonical_url, resolve_revisits

SCHEMA = "record_id long, url string, captured_at long, kind string, etag string, last_modified string, headers map<string,string>, digest string"


def test_same_as_sql(spark, sf):
    got = sorted((tuple(r) for r in op3_revisits(spark, sf).collect()), key=str)
    con = duckdb.connect()
    con.sql(f"CREATE VIEW pages AS SELECT * FROM '{sf}/pages.parquet'")
    assert got == sorted(con.sql(ORACLE).fetchall(), key=str)
    assert {"resolved", "validator_mismatch", "no_earlier_response", "response"} <= {r[3] for r in got}


def test_canonical_url(spark):
    urls = ["http://www.Ex.com:80/a/?b=2&a=1&utm_source=x#f", "https://ex.com/a?a=1&b=2", "ex.com/a/?ref=1", None, "", "https://u:p@ex.com"]
    df = spark.createDataFrame([(u,) for u in urls], "u string")
    assert [r[0] for r in df.select(canonical_url(df.u)).collect()] == ["ex.com/a?a=1&b=2"] * 2 + ["ex.com/a", None, "", "ex.com"]


def test_as_of_over_buckets(spark):
    rng = random.Random(2)
    rows = []
    for i in range(400):
        kind = rng.choice(("response", "revisit", "revisit", "metadata"))
        rows.append((i, f"http://h/{rng.randrange(4)}", rng.randrange(2000), kind, rng.choice(('"a"', 'W/"a"', '"b"', None)), rng.choice(("1", "2", None)), {"Date": str(i), "X": str(i)}, f"d{i}" if kind == "response" else None))
    rows += [(900, None, 5, "revisit", None, None, None, None), (901, "http://h/0", None, "response", None, None, None, "d"), (902, "http://h/0", 50, None, None, None, {}, None), (rows[0])]
    want = []
    for r in rows:
        found = max(((s[2], s[0], s) for s in rows if s[3] == "response" and s[1] == r[1] and None not in (s[2], r[2], r[1]) and s[2] < r[2]), default=None, key=lambda x: x[:2])
        if r[3] == "response":
            want.append((r[0], "response", r[0]))
        elif r[3] != "revisit":
            want.append((r[0], "other", None))
        elif not found:
            want.append((r[0], "no_earlier_response", None))
        else:
            f = found[2]
            pairs = [(x.replace("W/", ""), y.replace("W/", "")) for x, y in ((r[4], f[4]), (r[5], f[5])) if x and y]
            want.append((r[0], "no_validator", None) if not pairs else (r[0], "resolved", f[0]) if pairs[0][0] == pairs[0][1] else (r[0], "validator_mismatch", None))
    df = spark.createDataFrame(rows, SCHEMA).withColumn("bucket", F_lit())
    for seconds, hot in ((50, 100_000), (100_000, 100_000), (100_000, 2), (700, 20), (700, 0)):
        out = resolve_revisits(df, bucket_seconds=seconds, hot_rows=hot).collect()
        assert sorted(((r.record_id, r.outcome, r.resolved_id) for r in out), key=str) == sorted(want, key=str)
    one = next(r for r in out if r.outcome == "resolved")
    assert {e.key: e.value for e in one.headers} == {"date": str(one.record_id), "x": str(one.resolved_id)}
    assert resolve_revisits(df.limit(0)).collect() == []


def F_lit():
    from pyspark.sql import functions as F

    return F.lit(1)
