"""Resolution of not-modified revisits in web archives. Native: DataFrame functions only.

A revisit record says that a page had not changed, without its payload. It is
resolved to the latest full response of the same canonical URL that was captured
strictly earlier, by an as-of join, if the validators agree: entity tags (weak
comparison) where both records have one, else the last-modified values where both
have one. The resolved record has the stored headers, with those that a 304 may
update replaced by the revisit's own.

Times are cut into buckets: a response is sought in the revisit's bucket by a
window over (URL, bucket), and before it in the buckets' latest responses, one row
each. A URL with more than `hot_rows` records in a bucket has that bucket cut finer in
proportion, down to single seconds, within which nothing is earlier and no window is
needed. So a URL that holds a third of all records is many small groups.

Canonical URLs have no scheme, user name, leading www., default port, fragment,
tracking parameters or trailing slash; the host is in lower case and parameters
are sorted.

Defined results: a null URL or time resolves nothing (outcome no_earlier_response);
of responses of one URL and time the largest record_id counts; records of other
kinds are returned as they are; repeated rows are each resolved; null headers are
empty; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stage_table

# What a 304 response may carry to update a stored response (RFC 9110, 15.4.5).
PERMITTED = ["cache-control", "content-location", "date", "etag", "expires", "vary"]
# Parameters that only track visitors.
TRACKING = "^(utm_[a-z]+|gclid|fbclid|ref)(=.*)?$"


def canonical_url(url: Column) -> Column:
    plain = F.regexp_replace(F.trim(url), "#.*$", "")
    plain = F.regexp_replace(plain, "^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.lower(F.regexp_extract(plain, "^[^/?]*", 0))
    host = F.regexp_replace(F.regexp_replace(F.regexp_replace(host, "^.*@", ""), "^www\\.", ""), ":(80|443)$", "")
    rest = F.regexp_replace(plain, "^[^/?]*", "")
    path = F.regexp_replace(F.regexp_extract(rest, "^[^?]*", 0), "/+$", "")
    params = F.array_sort(F.filter(F.split(F.regexp_extract(rest, "\\?(.*)$", 1), "&"), lambda p: (p != "") & ~p.rlike(TRACKING)))
    return F.concat(host, path, F.when(F.size(params) > 0, F.concat(F.lit("?"), F.array_join(params, "&"))).otherwise(""))


def _entries(headers: str) -> Column:
    """A map of headers as a sorted array with lower-case names."""
    low = F.expr(f"transform(map_entries(coalesce({headers}, map())), e -> struct(lower(e.key) AS key, e.value AS value))")
    return F.array_sort(low)


def resolve_revisits(records: DataFrame, bucket_seconds: int = 86_400, hot_rows: int = 100_000) -> DataFrame:
    """records: record_id long, url, captured_at long (seconds), kind ('response', 'revisit'
    or other), etag, last_modified, headers map<string,string>, digest.

    One row per record: record_id, url_key, kind, outcome (response, resolved,
    validator_mismatch, no_validator, no_earlier_response or other), resolved_id (the
    response that gives the payload), digest of that payload, headers as an array."""
    rows = records.select(
        F.col("record_id").cast("long").alias("record_id"),
        canonical_url(F.col("url")).alias("url_key"),
        F.col("captured_at").cast("long").alias("at"),
        "kind",
        "etag",
        "last_modified",
        _entries("headers").alias("headers"),
        "digest",
    )
    full = F.struct("at", "record_id", "etag", "last_modified", "headers", "digest")
    rows = rows.withColumn("own", F.when((F.col("kind") == "response") & F.col("at").isNotNull() & F.col("url_key").isNotNull(), full))

    # A null URL or time meets nothing; such rows stay out of the windows, which they would fill.
    # The narrow records are read several times, the table that they come from once.
    rows = stage_table(rows.withColumn("span", F.floor(F.col("at") / bucket_seconds)), "revisits")
    timed = rows.filter("url_key IS NOT NULL AND at IS NOT NULL")
    counts = timed.groupBy("url_key", "span").agg(F.count("*").alias("n")).filter(F.col("n") > hot_rows)
    step = F.greatest(F.lit(1), F.floor(F.lit(bucket_seconds * hot_rows) / F.col("n")))
    fine = counts.select(F.col("url_key").alias("hot_url"), F.col("span").alias("hot_span"), step.alias("step"))
    timed = timed.join(fine, F.expr("url_key = hot_url AND span = hot_span"), "left").withColumn("step", F.coalesce("step", F.lit(bucket_seconds)))
    # A bucket is named by its first second, so that buckets of all lengths are in the order of time.
    begin = F.col("span") * bucket_seconds
    timed = timed.withColumn("bucket", begin + F.floor((F.col("at") - begin) / F.col("step")) * F.col("step"))
    rest = rows.filter("url_key IS NULL OR at IS NULL").withColumn("found", F.lit(None).cast(rows.schema["own"].dataType))

    within = Window.partitionBy("url_key", "bucket").orderBy("at").rangeBetween(Window.unboundedPreceding, -1)
    last = timed.filter("own IS NOT NULL").groupBy("url_key", "bucket").agg(F.max("own").alias("own"))
    heads = timed.select("url_key", "bucket").distinct().join(last, ["url_key", "bucket"], "left")
    before = Window.partitionBy("url_key").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    carried = heads.select("url_key", "bucket", F.max("own").over(before).alias("carried")).filter("carried IS NOT NULL")
    long = timed.filter("step > 1").withColumn("near", F.max("own").over(within))
    short = timed.filter("step = 1").withColumn("near", F.lit(None).cast(rows.schema["own"].dataType))
    near = long.unionByName(short).join(carried, ["url_key", "bucket"], "left")
    out = near.withColumn("found", F.coalesce("near", "carried")).select(*rest.columns).unionByName(rest)

    weak = lambda c: F.regexp_replace(c, "^W/", "")
    tags = F.col("etag").isNotNull() & F.col("found.etag").isNotNull()
    times = F.col("last_modified").isNotNull() & F.col("found.last_modified").isNotNull()
    agree = F.when(tags, weak(F.col("etag")) == weak(F.col("found.etag"))).when(times, F.col("last_modified") == F.col("found.last_modified"))
    outcome = (
        F.when(F.col("kind") == "response", "response")
        .when(F.coalesce(F.col("kind") != "revisit", F.lit(True)), "other")
        .when(F.col("found").isNull(), "no_earlier_response")
        .when(agree.isNull(), "no_validator")
        .when(agree, "resolved")
        .otherwise("validator_mismatch")
    )
    out = out.withColumn("outcome", outcome)
    resolved = F.col("outcome") == "resolved"
    permitted = F.array(*map(F.lit, PERMITTED))
    news = F.filter("headers", lambda e: F.array_contains(permitted, e["key"]))
    kept = F.expr("filter(found.headers, e -> NOT exists(news, n -> n.key = e.key))")
    merged = F.when(resolved, F.array_sort(F.concat(kept, F.col("news")))).otherwise(F.col("headers"))
    return out.withColumn("news", news).select(
        "record_id",
        "url_key",
        "kind",
        "outcome",
        F.when(resolved, F.col("found.record_id")).when(F.col("kind") == "response", F.col("record_id")).alias("resolved_id"),
        F.when(resolved, F.col("found.digest")).otherwise(F.col("digest")).alias("digest"),
        merged.alias("headers"),
    )


def records_of_pages(pages: DataFrame) -> DataFrame:
    """Two captures of every page: the response with its payload's digest, and later a
    revisit of the URL (with a fragment and a tracking parameter), one in five of them with
    another entity tag, one in seven without one."""
    digest = F.md5("html")
    shared = [F.col("page_id"), F.col("url"), digest.alias("digest")]
    response = pages.select(*shared).select(
        (F.col("page_id") * 2).alias("record_id"),
        "url",
        (F.col("page_id") * 600).alias("captured_at"),
        F.lit("response").alias("kind"),
        F.concat(F.lit('"'), "digest", F.lit('"')).alias("etag"),
        F.col("page_id").cast("string").alias("last_modified"),
        F.expr("map('Content-Type', 'text/html', 'ETag', concat('\"', digest, '\"'), 'Date', cast(page_id * 600 AS string), 'Server', 'a')").alias("headers"),
        "digest",
    )
    tag = F.expr("CASE WHEN page_id % 5 = 0 THEN '\"other\"' WHEN page_id % 7 = 0 THEN NULL ELSE concat('W/\"', digest, '\"') END")
    revisit = pages.select(*shared).select(
        (F.col("page_id") * 2 + 1).alias("record_id"),
        F.concat(F.regexp_replace("url", "#.*$", ""), F.when(F.col("url").contains("?"), "&utm_source=x#r").otherwise("?utm_source=x#r")).alias("url"),
        (F.col("page_id") * 600 + (F.col("page_id") % 3) * 86_400).alias("captured_at"),
        F.lit("revisit").alias("kind"),
        tag.alias("etag"),
        F.when(F.col("page_id") % 2 == 0, F.col("page_id").cast("string")).alias("last_modified"),
        F.expr("map('Date', cast(page_id * 600 + 1 AS string), 'Server', 'b', 'Vary', 'Accept')").alias("headers"),
        F.lit(None).cast("string").alias("digest"),
    )
    return response.unionByName(revisit)


#: The same for DuckDB over `pages`, headers as text.
ORACLE = """
WITH p AS (SELECT page_id, url, md5(html) AS digest FROM pages),
rec AS (
  SELECT page_id * 2 AS record_id, url, page_id * 600 AS at, 'response' AS kind, '"' || digest || '"' AS etag, page_id::VARCHAR AS lm,
    [['content-type', 'text/html'], ['date', (page_id * 600)::VARCHAR], ['etag', '"' || digest || '"'], ['server', 'a']] AS headers, digest FROM p
  UNION ALL
  SELECT page_id * 2 + 1, regexp_replace(url, '#.*$', '') || CASE WHEN contains(url, '?') THEN '&utm_source=x#r' ELSE '?utm_source=x#r' END,
    page_id * 600 + (page_id % 3) * 86400, 'revisit',
    CASE WHEN page_id % 5 = 0 THEN '"other"' WHEN page_id % 7 = 0 THEN NULL ELSE 'W/"' || digest || '"' END,
    CASE WHEN page_id % 2 = 0 THEN page_id::VARCHAR END,
    [['date', (page_id * 600 + 1)::VARCHAR], ['server', 'b'], ['vary', 'Accept']], NULL FROM p),
u AS (SELECT *, regexp_replace(regexp_replace(trim(url), '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://', '') AS plain FROM rec),
v AS (SELECT *, regexp_replace(regexp_replace(regexp_replace(lower(regexp_extract(plain, '^[^/?]*')), '^.*@', ''), '^www\\.', ''), ':(80|443)$', '') AS host,
  regexp_replace(plain, '^[^/?]*', '') AS rest FROM u),
w AS (SELECT *, regexp_replace(regexp_extract(rest, '^[^?]*'), '/+$', '') AS path,
  list_sort(list_filter(string_split(regexp_extract(rest, '\\?(.*)$', 1), '&'), lambda x: x <> '' AND NOT regexp_matches(x, '^(utm_[a-z]+|gclid|fbclid|ref)(=.*)?$'))) AS params FROM v),
k AS (SELECT *, host || path || CASE WHEN len(params) > 0 THEN '?' || array_to_string(params, '&') ELSE '' END AS url_key FROM w),
j AS (SELECT k.*, f.record_id AS fid, f.etag AS fetag, f.lm AS flm, f.headers AS fheaders, f.digest AS fdigest
  FROM k LEFT JOIN k f ON f.kind = 'response' AND f.url_key = k.url_key AND f.at < k.at
  QUALIFY row_number() OVER (PARTITION BY k.record_id ORDER BY f.at DESC NULLS LAST, f.record_id DESC) = 1),
o AS (SELECT *, CASE WHEN kind = 'response' THEN 'response' WHEN fid IS NULL THEN 'no_earlier_response'
  WHEN etag IS NOT NULL AND fetag IS NOT NULL THEN CASE WHEN regexp_replace(etag, '^W/', '') = regexp_replace(fetag, '^W/', '') THEN 'resolved' ELSE 'validator_mismatch' END
  WHEN lm IS NOT NULL AND flm IS NOT NULL THEN CASE WHEN lm = flm THEN 'resolved' ELSE 'validator_mismatch' END
  ELSE 'no_validator' END AS outcome FROM j)
SELECT record_id, url_key, kind, outcome,
  CASE WHEN outcome = 'resolved' THEN fid WHEN kind = 'response' THEN record_id END AS resolved_id,
  CASE WHEN outcome = 'resolved' THEN fdigest ELSE digest END AS digest,
  array_to_string(list_transform(CASE WHEN outcome = 'resolved' THEN
    list_sort(list_concat(list_filter(fheaders, lambda e: e[1] NOT IN ('date', 'vary')), list_filter(headers, lambda e: e[1] IN ('date', 'vary')))) ELSE headers END,
    lambda e: e[1] || ': ' || e[2]), '; ') AS headers
FROM o
"""
