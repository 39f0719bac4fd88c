"""The engine's queries on the fixture tables, each with its SQL twin where SQL can express it.

Reference roles and their carriers: embeddings stand for the embedded corpus (label as
cluster, 0 as outlier), documents for raw texts, labels for what is already done, parts
for names, each user's first and last event for a survey's two answers, events for the
change log.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import vocab
from ..functions import text as T
from ..functions import vectors as V
from ..operators import corpus, evaluation, names, ranking, search, serving, survey, topics, training
from ..streaming import cdc, queue
from .scratch import ensure_checkpoint_dir

AXES = ["topic", "location", "phenomenon"]
SUFFIXES = {"ring": "round", "bolt": "fastener", "widget": "device", "gear": "round"}
PREFIXES = {"small": "size", "large": "size", "red": "colour", "blue": "colour", "green": "colour"}
WORDS = ["the", "and", "des", "und", "los", "que"]

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from . import files  # noqa: F401  registers its own

    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    from . import files  # noqa: F401

    return dict(_SQL)


def table_of(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


_t = table_of


def _vector(df: DataFrame, vec_id: int) -> list[float]:
    row = df.filter(F.col("vec_id") == vec_id).select("embedding").first()
    return [float(x) for x in row.embedding] if row else [0.0] * 64


def _lit_list(values) -> str:
    return "[" + ", ".join("'" + v + "'" for v in values) + "]"


_MATRIX = "SELECT list_transform(range(24), lambda i: list_transform(range(64), lambda j: ((i * 31 + j * 17) % 13 - 6) / 13::DOUBLE)) AS m"
_PROJECTED = f"""m AS ({_MATRIX}),
p AS (SELECT vec_id, list_transform(m.m, lambda r: list_dot_product(r, embedding::DOUBLE[])) AS v FROM embeddings, m),
a AS (SELECT vec_id, v[1:8] AS t, v[9:16] AS l, v[17:24] AS ph, v FROM p)"""
_RANKED = """x AS (SELECT q.vec_id AS query_id, c.vec_id AS id, {score} AS score FROM embeddings q, embeddings c WHERE q.vec_id <> c.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id)::INT AS rank FROM x)"""
_COSINE = _RANKED.format(score="list_cosine_similarity(q.embedding::DOUBLE[], c.embedding::DOUBLE[])")
_DOT = _RANKED.format(score="list_dot_product(q.embedding::DOUBLE[], c.embedding::DOUBLE[])")
_STRIP = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"

# ---------------------------------------------------------------- vector search


@query("""WITH q AS (SELECT embedding::DOUBLE[] AS e FROM embeddings WHERE vec_id = 7)
SELECT vec_id, label, floor(list_cosine_similarity(embedding::DOUBLE[], q.e) * 1000 + 0.5) / 1000 AS similarity
FROM embeddings, q ORDER BY list_cosine_similarity(embedding::DOUBLE[], q.e) DESC, vec_id LIMIT 5""")
def cosine_topk(spark, sf):
    e = _t(spark, sf, "embeddings")
    return search.search_by_embedding(e, _vector(e, 7), 5, "vec_id").select("vec_id", "label", "similarity")


@query("""WITH q AS (SELECT embedding::DOUBLE[] AS e FROM embeddings WHERE vec_id = 7)
SELECT vec_id, floor(list_dot_product(embedding::DOUBLE[], q.e) * 1000 + 0.5) / 1000 AS similarity
FROM embeddings, q ORDER BY list_dot_product(embedding::DOUBLE[], q.e) DESC, vec_id LIMIT 5""")
def dot_topk(spark, sf):
    e = _t(spark, sf, "embeddings")
    return search.search_by_embedding(e, _vector(e, 7), 5, "vec_id", metric="dot").select("vec_id", "similarity")


@query("""WITH q AS (SELECT embedding::DOUBLE[] AS e FROM embeddings WHERE vec_id = 7),
top AS (SELECT vec_id, list_cosine_similarity(embedding::DOUBLE[], q.e) AS s FROM embeddings, q ORDER BY s DESC, vec_id LIMIT 5)
SELECT d.doc_id AS id, d.source AS kaii_name, substr(d.text, 1, 60) AS content, d.lang AS location, floor(top.s * 1000 + 0.5) / 1000 AS similarity
FROM top JOIN documents d ON d.doc_id = top.vec_id""")
def search_results(spark, sf):
    e = _t(spark, sf, "embeddings")
    top = search.search_by_embedding(e, _vector(e, 7), 5, "vec_id").select(F.col("vec_id").alias("doc_id"), "similarity")
    d = _t(spark, sf, "documents").join(F.broadcast(top), "doc_id")  # five rows
    return d.select(F.col("doc_id").alias("id"), F.col("source").alias("kaii_name"), T.excerpt(F.col("text"), 60).alias("content"), F.col("lang").alias("location"), "similarity")


@query(f"""WITH {_PROJECTED}, q AS (SELECT * FROM a WHERE vec_id = 7),
s AS (SELECT a.vec_id, list_cosine_similarity(a.t, q.t) AS t, list_cosine_similarity(a.l, q.l) AS l, list_cosine_similarity(a.ph, q.ph) AS p FROM a, q)
SELECT vec_id, floor(t * 1000 + 0.5) / 1000 AS topic, floor(l * 1000 + 0.5) / 1000 AS location, floor(p * 1000 + 0.5) / 1000 AS phenomenon,
floor((t + 1.5::DOUBLE * l + p) / 3.5::DOUBLE * 1000 + 0.5) / 1000 AS combined FROM s ORDER BY (t + 1.5::DOUBLE * l + p) / 3.5::DOUBLE DESC, vec_id LIMIT 5""")
def aspect_topk(spark, sf):
    e = _t(spark, sf, "embeddings")
    m = search.synthetic_projection()
    return search.search_by_aspects(search.project(e, m, AXES), search.project_vector(m, AXES, _vector(e, 7)), 5, "東北", id_col="vec_id")


@query(f"""WITH {_PROJECTED}, n AS (SELECT vec_id, t, l, ph, v, sqrt(list_dot_product(t, t)) AS nt, sqrt(list_dot_product(l, l)) AS nl, sqrt(list_dot_product(ph, ph)) AS np, sqrt(list_dot_product(v, v)) AS nv FROM a)
SELECT vec_id, round(t[1] / nt, 6) AS topic, round(l[1] / nl, 6) AS location, round(ph[1] / np, 6) AS phenomenon, round(v[1] / nv, 6) AS whole FROM n""")
def project_corpus(spark, sf):
    e = _t(spark, sf, "embeddings")
    m = search.synthetic_projection()
    p = search.project(search.project(e, m, AXES), m, ["whole"])
    return p.select("vec_id", *[F.round(F.col(a)[0], 6).alias(a) for a in [*AXES, "whole"]])


@query("""WITH q AS (SELECT embedding::DOUBLE[] AS e FROM embeddings WHERE vec_id = 7)
SELECT vec_id, round(sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])), 6) AS norm,
round(embedding[1]::DOUBLE / (sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) + 1e-8::DOUBLE), 6) AS safe_unit FROM embeddings, q""")
def vector_norms(spark, sf):
    v = V.as_double(F.col("embedding"))
    return _t(spark, sf, "embeddings").select("vec_id", F.round(V.norm(v), 6).alias("norm"), F.round(V.normalise(v, 1e-8)[0], 6).alias("safe_unit"))


@query(f"WITH {_COSINE} SELECT query_id, rank, id, round(score, 6) AS score FROM r WHERE rank <= 5")
def allpairs_topk(spark, sf):
    near = search.neighbours(_t(spark, sf, "embeddings"), k=5, id_col="vec_id")
    return near.withColumn("score", F.round("score", 6))


def _labels(spark, sf):
    e = _t(spark, sf, "embeddings")
    return e.select(F.col("vec_id").alias("id"), F.when(F.col("label") != 0, F.col("label")).alias("label"))


_PRECISION = """, h AS (SELECT query_id, sum(CASE WHEN a.label = b.label AND b.label <> 0 THEN 1 ELSE 0 END) / 5::DOUBLE AS p
FROM r JOIN embeddings a ON a.vec_id = query_id JOIN embeddings b ON b.vec_id = id WHERE rank <= 5 AND a.label <> 0 GROUP BY query_id)
SELECT round(avg(p), 9) AS precision, count(*) AS n FROM h"""


def _precision(spark, sf, metric):
    near = search.neighbours(_t(spark, sf, "embeddings"), k=5, id_col="vec_id", metric=metric)
    return evaluation.mean_precision(evaluation.precision_at_k(near, _labels(spark, sf))).withColumn("precision", F.round("precision", 9))


@query(f"WITH {_COSINE}{_PRECISION}")
def precision_at_5_cosine(spark, sf):
    return _precision(spark, sf, "cosine")


@query(f"WITH {_DOT}{_PRECISION}")
def precision_at_5_dot(spark, sf):
    return _precision(spark, sf, "dot")


@query("""WITH q AS (SELECT * FROM embeddings WHERE label <> 0 ORDER BY md5(vec_id || '|42'), vec_id LIMIT 100),
x AS (SELECT q.vec_id AS query_id, q.label AS own, c.label AS other, row_number() OVER (PARTITION BY q.vec_id ORDER BY list_cosine_similarity(q.embedding::DOUBLE[], c.embedding::DOUBLE[]) DESC, c.vec_id) AS r
  FROM q, embeddings c WHERE q.vec_id <> c.vec_id),
f AS (SELECT query_id, min(CASE WHEN own = other THEN r END) AS r FROM x GROUP BY query_id)
SELECT round(avg(coalesce(1::DOUBLE / r, 0)), 9) AS mrr, count(*) AS n FROM f""")
def reciprocal_rank(spark, sf):
    e = _t(spark, sf, "embeddings")
    q = ranking.hash_sample(e.filter("label <> 0"), ["vec_id"], 100)
    return evaluation.mean_reciprocal(evaluation.first_hit_ranks(e, q, "vec_id")).withColumn("mrr", F.round("mrr", 9))


@query(f"""WITH {_PROJECTED}, q AS (SELECT * FROM a ORDER BY md5(vec_id || '|42'), vec_id LIMIT 5),
x AS (SELECT q.vec_id AS query_id, c.vec_id AS id, list_cosine_similarity(q.t, c.t) AS t, list_cosine_similarity(q.l, c.l) AS l, list_cosine_similarity(q.ph, c.ph) AS p FROM q, a c WHERE q.vec_id <> c.vec_id),
r AS (SELECT *, (t + l + p) / 3 AS s, row_number() OVER (PARTITION BY query_id ORDER BY (t + l + p) / 3 DESC, id)::INT AS rank FROM x)
SELECT r.query_id, r.rank, r.id, round(s, 6) AS combined, round(t, 6) AS topic, round(l, 6) AS location, round(p, 6) AS phenomenon, round(list_cosine_similarity(e.embedding::DOUBLE[], f.embedding::DOUBLE[]), 6) AS original,
e.label = f.label AS cluster_match, e.vec_id % 5 = f.vec_id % 5 AS region_match, e.vec_id % 7 = f.vec_id % 7 AS kind_match FROM r JOIN embeddings e ON e.vec_id = r.query_id JOIN embeddings f ON f.vec_id = r.id WHERE rank <= 5""")
def aspect_examples(spark, sf):
    e = _t(spark, sf, "embeddings")
    p = search.project(e, search.synthetic_projection(), AXES).withColumn("all", F.concat(*AXES))
    near = search.neighbours(p, ranking.hash_sample(p, ["vec_id"], 5), 5, "vec_id", "all")
    labels = e.select("vec_id", F.col("label").alias("cluster"), (F.col("vec_id") % 5).alias("region"), (F.col("vec_id") % 7).alias("kind"))
    out = search.examples(near, p, {**{a: a for a in AXES}, "original": "embedding"}, labels, ["cluster", "region", "kind"], "vec_id")
    return out.withColumns({c: F.round(c, 6) for c in ("combined", *AXES, "original")})


# ---------------------------------------------------------------- corpus

_CLEAN = rf"""d AS (SELECT doc_id AS ordinal, regexp_extract(text, '^\S+ \S+') || '[12]' AS name, text AS detail FROM documents),
c AS (SELECT ordinal, {_STRIP.format("regexp_replace(name, '\\[\\d+\\]', '', 'g')")} AS name, detail FROM d WHERE length({_STRIP.format('detail')}) >= 10),
f AS (SELECT * FROM c WHERE name <> '' QUALIFY row_number() OVER (PARTITION BY name ORDER BY ordinal) = 1),
s AS (SELECT ordinal, name, detail, coalesce(list_filter(string_split(regexp_replace(detail, '\[\d+\]', '', 'g'), chr(10)), lambda x: {_STRIP.format('x')} <> '')[1], '') AS p FROM f),
t AS (SELECT *, {_STRIP.format("array_to_string(regexp_extract_all(p, '[^.!?]*[.!?]|[^.!?]+$')[1:3], '')")} AS u FROM s),
e AS (SELECT format('entry-{{:04d}}', ordinal) AS id, name, CASE WHEN length(u) > 200 THEN substr(u, 1, 200) || '…' ELSE u END AS summary,
  CASE WHEN len(list_filter({_lit_list(WORDS)}, lambda w: contains(detail, w))) > 0 THEN array_to_string(list_filter({_lit_list(WORDS)}, lambda w: contains(detail, w))[1:3], '、') ELSE '日本各地' END AS location FROM t WHERE u <> '')"""


def _entries(spark, sf):
    d = _t(spark, sf, "documents")
    raw = d.select(F.col("doc_id").alias("ordinal"), F.concat(F.regexp_extract("text", r"^\S+ \S+", 0), F.lit("[12]")).alias("name"), F.col("text").alias("detail"))
    return corpus.clean_corpus(raw, "documents", ends=".!?", places=WORDS)


@query(f"WITH {_CLEAN} SELECT id, name, summary, location, 'documents' AS source FROM e")
def corpus_clean(spark, sf):
    return _entries(spark, sf)


@query(f"WITH {_CLEAN} SELECT id, {_STRIP.format('''concat_ws(' ', name, summary, CASE WHEN location <> '日本各地' THEN '地域: ' || location END)''')} AS text, 'passage: ' || name || '。' || summary AS topic_text, name || ' ' || summary || ' ' || location AS sparse_text FROM e")
def embedding_texts(spark, sf):
    n, s, p = F.col("name"), F.col("summary"), F.col("location")
    return _entries(spark, sf).select("id", T.embedding_text(n, s, p).alias("text"), T.topic_document(n, s).alias("topic_text"), T.sparse_document(n, s, p).alias("sparse_text"))


@query("SELECT doc_id, lang FROM documents WHERE length(text) > 5 AND doc_id NOT IN (SELECT doc_id FROM labels)")
def incremental_todo(spark, sf):
    d = _t(spark, sf, "documents")
    return corpus.to_embed(d, _t(spark, sf, "labels"), "doc_id", "text").select("doc_id", "lang")


@query("""SELECT origin, count(*) AS n, count(DISTINCT doc_id) AS ids FROM (
SELECT doc_id, 'previous' AS origin FROM labels UNION ALL SELECT doc_id, 'new' FROM documents WHERE length(text) > 5 AND doc_id NOT IN (SELECT doc_id FROM labels)) GROUP BY origin""")
def append_results(spark, sf):
    done = _t(spark, sf, "labels").select("doc_id", F.lit("previous").alias("origin"))
    new = corpus.to_embed(_t(spark, sf, "documents"), done, "doc_id", "text").select("doc_id", F.lit("new").alias("origin"))
    return corpus.append_results(done, new).groupBy("origin").agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("ids"))


_PLACES = f"""l AS (SELECT {_lit_list(vocab.PREFECTURES)} AS p, {_lit_list(vocab.OLD_PROVINCES)} AS o),
x AS (SELECT p_partkey, l.p[p_partkey * 7 % 47 + 1] AS a, l.p[p_partkey % 47 + 1] AS b, l.o[p_partkey % 54 + 1] AS c, l.p || l.o AS every FROM part, l)"""


def _places(spark, sf):
    p, o = (F.array(*map(F.lit, v)) for v in (vocab.PREFECTURES, vocab.OLD_PROVINCES))
    k = F.col("p_partkey")
    pick = lambda a, i: F.element_at(a, (i + 1).cast("int"))
    return _t(spark, sf, "part").select("p_partkey", pick(p, k * 7 % 47).alias("a"), pick(p, k % 47).alias("b"), pick(o, k % 54).alias("c"))


@query(f"""WITH {_PLACES} SELECT p_partkey, array_to_string(list_filter(every, lambda w: contains(c || 'から' || a || 'の' || b, w))[1:3], '、') AS location FROM x""")
def extract_locations(spark, sf):
    return _places(spark, sf).select("p_partkey", T.extract_location(F.concat("c", F.lit("から"), "a", F.lit("の"), "b")).alias("location"))


_REGION_SQL = "CASE {} " + " ".join(f"WHEN '{p}' THEN '{r}'" for r, ps in vocab.REGIONS.items() for p in ps) + " END"


@query(f"""WITH {_PLACES}, g AS (SELECT p_partkey, {_REGION_SQL.format("a")} AS ra, {_REGION_SQL.format("b")} AS rb FROM x)
SELECT p_partkey, CASE WHEN ra = rb THEN ra ELSE ra || ',' || rb END AS regions, ra AS primary_region FROM g""")
def parse_regions(spark, sf):
    place = F.concat("c", F.lit("、 "), "a", F.lit("，"), "b")
    return _places(spark, sf).select("p_partkey", F.array_join(T.parse_regions(place), ",").alias("regions"), T.primary_region(place).alias("primary_region"))


_KEYWORDS = [w for ws in vocab.PHENOMENA.values() for w in ws]
_CLASSIFY = "CASE " + " ".join(f"WHEN regexp_matches(s, '{'|'.join(ws)}') THEN '{t}'" for t, ws in vocab.PHENOMENA.items()) + " END"


@query(f"""WITH k AS (SELECT {_lit_list(_KEYWORDS)} AS k), x AS (SELECT p_partkey, CASE WHEN p_partkey % 9 = 0 THEN 'なにもなし' WHEN p_partkey % 10 = 0 THEN '' ELSE k[p_partkey * 11 % {len(_KEYWORDS)} + 1] || 'が' || k[p_partkey * 5 % {len(_KEYWORDS)} + 1] END AS s FROM part, k)
SELECT p_partkey, {_CLASSIFY} AS phenomenon FROM x""")
def classify_phenomena(spark, sf):
    k, p = F.array(*map(F.lit, _KEYWORDS)), F.col("p_partkey")
    pick = lambda i: F.element_at(k, (i % len(_KEYWORDS) + 1).cast("int"))
    s = F.when(p % 9 == 0, "なにもなし").when(p % 10 == 0, "").otherwise(F.concat(pick(p * 11), F.lit("が"), pick(p * 5)))
    return _t(spark, sf, "part").select("p_partkey", T.classify(s).alias("phenomenon"))


# ---------------------------------------------------------------- pairs

# The twin numbers all pairs, which draw_pairs() never forms.
_PAIRS = """n AS (SELECT vec_id, label, row_number() OVER (PARTITION BY label ORDER BY md5(vec_id || '|42'), vec_id) - 1 AS at FROM embeddings WHERE label <> 0),
g AS (SELECT label, (count(*) * (count(*) - 1) // 2)::BIGINT AS pairs FROM n GROUP BY label), s AS (SELECT label, pairs, (sum(pairs) OVER (ORDER BY label) - pairs)::BIGINT AS low FROM g),
p AS (SELECT least(a.vec_id, b.vec_id) AS a, greatest(a.vec_id, b.vec_id) AS b, low + b.at * (b.at - 1) // 2 + a.at AS pos FROM n a JOIN n b ON a.label = b.label AND a.at < b.at JOIN s ON s.label = a.label),
c AS (SELECT sum(pairs)::BIGINT AS total, least(5000, sum(pairs))::BIGINT AS cap FROM g),
d AS (SELECT (t * total) // cap AS lo, ((t + 1) * total) // cap AS hi, ('0x' || substr(md5(t || '|42'), 1, 15))::BIGINT AS h FROM c, range(5000) r(t) WHERE t < cap),
y AS (SELECT p.a, p.b FROM d JOIN p ON p.pos = lo + h % (hi - lo))"""


def _topic_pairs(spark, sf):
    e = _t(spark, sf, "embeddings").filter("label <> 0").select(F.col("vec_id").alias("id"), "label")
    return corpus.draw_pairs(e, "label", "topic")


@query(f"WITH {_PAIRS} SELECT 'topic' AS axis, a, b FROM y")
def topic_pairs(spark, sf):
    return _topic_pairs(spark, sf)


@query("""WITH g AS (SELECT s_suppkey AS id, unnest([s_nationkey % 5, s_suppkey % 7]) AS region FROM supplier)
SELECT a.region, count(*) AS pairs, count(DISTINCT a.id) AS ids FROM g a JOIN g b ON a.region = b.region AND a.id < b.id GROUP BY a.region""")
def region_pairs(spark, sf):
    s = _t(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), F.explode(F.array(F.col("s_nationkey").cast("long") % 5, F.col("s_suppkey") % 7)).alias("region"))
    return corpus.group_pairs(s, "region").groupBy("region").agg(F.count("*").alias("pairs"), F.countDistinct("a").alias("ids"))


@query(f"WITH {_PAIRS} SELECT 'topic' AS axis, a, b FROM y WHERE a IN (SELECT doc_id FROM labels) AND b IN (SELECT doc_id FROM labels)")
def pairs_with_embeddings(spark, sf):
    have = _t(spark, sf, "labels").select(F.col("doc_id").alias("id"))
    return corpus.pairs_with_embeddings(_topic_pairs(spark, sf), have)


@query("SELECT d.doc_id AS id, CASE WHEN e.label IS NULL THEN -1 ELSE e.label END AS cluster_id, l.doc_id IS NOT NULL AS has_embedding FROM documents d LEFT JOIN embeddings e ON e.vec_id = d.doc_id LEFT JOIN labels l ON l.doc_id = d.doc_id")
def cluster_flags(spark, sf):
    d = _t(spark, sf, "documents").select(F.col("doc_id").alias("id")).join(_t(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").alias("cluster_id")), "id", "left")
    have = _t(spark, sf, "labels").select(F.col("doc_id").alias("id"), F.lit(1).alias("embedding"))
    return corpus.usable_entries(d, have).select("id", "cluster_id", "has_embedding")


@query("SELECT d.doc_id AS id, e.label AS cluster_id FROM documents d JOIN embeddings e ON e.vec_id = d.doc_id WHERE e.label <> -1 AND d.doc_id IN (SELECT doc_id FROM labels)")
def usable_only(spark, sf):
    return corpus.only_usable(cluster_flags(spark, sf)).select("id", "cluster_id")


@query("SELECT d.doc_id, d.lang, d.source, l.quality FROM documents d LEFT JOIN labels l USING (doc_id) WHERE d.lang IS NOT NULL AND d.source IS NOT NULL AND l.quality IS NOT NULL")
def fully_labelled(spark, sf):
    d = _t(spark, sf, "documents").join(_t(spark, sf, "labels"), "doc_id", "left")
    return corpus.fully_labelled(d, ["lang", "source", "quality"]).select("doc_id", "lang", "source", "quality")


@query(f"WITH {_CLEAN} SELECT e.id, e.name, m.label AS cluster_id FROM e JOIN embeddings m ON m.vec_id = substr(e.id, 7)::BIGINT WHERE m.label <> -1 AND length(e.summary) > 30")
def describable_entries(spark, sf):
    e = _t(spark, sf, "embeddings").select(F.col("vec_id").alias("ordinal"), F.col("label").alias("cluster_id"))
    entries = _entries(spark, sf).withColumn("ordinal", F.substring("id", 7, 20).cast("long")).join(e, "ordinal", "left").withColumn("cluster_id", F.coalesce("cluster_id", F.lit(-1)))
    return corpus.describable(entries).select("id", "name", "cluster_id")


@query("SELECT o_orderkey, CASE WHEN o_totalprice > 200000 THEN o_orderpriority END AS name FROM orders WHERE o_totalprice > 200000 AND o_orderpriority IS NOT NULL")
def named_rows(spark, sf):
    rows = _t(spark, sf, "orders").select("o_orderkey", F.when(F.col("o_totalprice") > 200000, F.col("o_orderpriority")).alias("name"))
    return survey.named(rows, "name")


@query("SELECT d.doc_id, d.lang, l.quality FROM documents d JOIN embeddings e ON e.vec_id = d.doc_id LEFT JOIN labels l ON l.doc_id = d.doc_id")
def labelled_join(spark, sf):
    d, e = _t(spark, sf, "documents"), _t(spark, sf, "embeddings")
    return d.join(e.select(F.col("vec_id").alias("doc_id")), "doc_id").join(_t(spark, sf, "labels"), "doc_id", "left").select("doc_id", "lang", "quality")


@query("SELECT label AS key, array_to_string(list_sort(list(vec_id))[1:5], ',') AS first_ids, count(*) AS n FROM embeddings GROUP BY label")
def cluster_index(spark, sf):
    index = corpus.index_heads(corpus.index_rows(_t(spark, sf, "embeddings"), "label", "vec_id"))
    return index.select("key", F.array_join("first_ids", ",").alias("first_ids"), "n")


@query("SELECT count(DISTINCT e.label) AS clusters, count(DISTINCT d.lang) AS regions, count(DISTINCT d.source) AS types FROM documents d LEFT JOIN embeddings e ON e.vec_id = d.doc_id")
def metadata_counts(spark, sf):
    d = _t(spark, sf, "documents").join(_t(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_id"), "label"), "doc_id", "left")
    return d.agg(F.countDistinct("label").alias("clusters"), F.countDistinct("lang").alias("regions"), F.countDistinct("source").alias("types"))


# ---------------------------------------------------------------- survey

_SURVEY = "s AS (SELECT user_id, arg_min(event_type, row(ts, event_id)) AS pre, arg_max(event_type, row(ts, event_id)) AS post, user_id % 5 AS age, min(event_id) AS ordinal FROM events GROUP BY user_id)"


def _survey(spark, sf):
    at = F.struct("ts", "event_id")
    return _t(spark, sf, "events").groupBy("user_id").agg(F.min_by("event_type", at).alias("pre"), F.max_by("event_type", at).alias("post"), F.min("event_id").alias("ordinal")).withColumn("age", F.col("user_id") % 5)


@query("SELECT event_type AS value, count(*) AS n FROM events WHERE event_type IS NOT NULL GROUP BY event_type")
def value_counts(spark, sf):
    return survey.value_counts(_t(spark, sf, "events"), "event_type")


@query(f"WITH {_SURVEY} SELECT CASE WHEN grouping(pre) = 1 THEN 'All' ELSE pre END AS pre, CASE WHEN grouping(post) = 1 THEN 'All' ELSE post END AS post, count(*) AS n FROM s GROUP BY CUBE (pre, post)")
def crosstab(spark, sf):
    return survey.crosstab(_survey(spark, sf), "pre", "post")


@query(f"""WITH {_SURVEY}, c AS (SELECT CASE WHEN grouping(pre) = 1 THEN 'All' ELSE pre END AS pre, CASE WHEN grouping(post) = 1 THEN 'All' ELSE post END AS post, count(*) AS n FROM s GROUP BY CUBE (pre, post))
SELECT pre, coalesce(max(n) FILTER (post = 'click'), 0) AS click, coalesce(max(n) FILTER (post = 'view'), 0) AS view, coalesce(max(n) FILTER (post = 'All'), 0) AS "All" FROM c GROUP BY pre""")
def crosstab_wide(spark, sf):
    return survey.crosstab_wide(_survey(spark, sf), "pre", "post", ["click", "view"])


@query(f"WITH {_SURVEY} SELECT count(*) AS n, sum((pre <> post)::BIGINT)::BIGINT AS shifted, round(sum((pre <> post)::BIGINT) * 100.0::DOUBLE / count(*), 1) AS rate FROM s")
def shift_rate(spark, sf):
    return survey.shift_rate(_survey(spark, sf), "pre", "post")


@query(f"WITH {_SURVEY} SELECT age, count(*) AS n, sum((pre <> post)::BIGINT)::BIGINT AS shifted, round(sum((pre <> post)::BIGINT) * 100.0::DOUBLE / count(*), 1) AS rate, min(ordinal) AS first_ordinal FROM s GROUP BY age")
def shift_by_group(spark, sf):
    return survey.shift_rate(_survey(spark, sf), "pre", "post", "age").orderBy("first_ordinal")


@query(f"WITH {_SURVEY} SELECT count(*) AS before, count(*) FILTER (post = 'purchase') AS after FROM s")
def before_after(spark, sf):
    return survey.before_after(_survey(spark, sf), F.col("post") == "purchase")


@query("""WITH l AS (SELECT * FROM events ORDER BY ts DESC, event_id DESC LIMIT 200)
SELECT count(*) AS total, count(*) FILTER (event_type = 'purchase') AS generated, count(*) FILTER (value > 10) AS printed, count(*) FILTER (event_type = 'signup') AS surveyed FROM l""")
def funnel(spark, sf):
    stages = {"generated": F.col("event_type") == "purchase", "printed": F.col("value") > 10, "surveyed": F.col("event_type") == "signup"}
    return survey.funnel(_t(spark, sf, "events"), stages, "ts", "event_id")


@query("""SELECT x AS option, CASE x WHEN 'A' THEN 'C1 (Character Consumption)' WHEN 'B' THEN 'C2 (Technology Focus)' WHEN 'C' THEN 'C3 (Cultural Anchoring)' WHEN 'D' THEN 'C2-variant (Tourism/PR)' WHEN 'E' THEN 'C4 (Anxiety Externalization)' WHEN 'F' THEN 'C5 (Ephemeral Reflection)' WHEN 'G' THEN 'Unclear' ELSE '?' END AS label, count(*) AS n
FROM (SELECT unnest([chr(65 + (p_partkey % 9)::INT), chr(65 + (p_size % 4)::INT)]) AS x FROM part) GROUP BY x""")
def multi_select_counts(spark, sf):
    text = F.format_string("['%s', '%s']", F.char(F.lit(65) + F.col("p_partkey") % 9), F.char(F.lit(65) + F.col("p_size") % 4))
    return survey.multi_select_counts(_t(spark, sf, "part").select(T.parse_multi_select(text).alias("s")), "s", vocab.SELECTION_LABELS)


@query("""SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'printed' WHEN o_orderstatus = 'O' THEN 'triggered' WHEN o_totalprice > 200000 THEN 'named' ELSE 'waiting' END AS status,
o_orderstatus = 'O' AS pending FROM orders""")
def survey_status(spark, sf):
    s = F.col("o_orderstatus")
    done = survey.status(s == "F", s == "O", F.col("o_totalprice") > 200000)
    return _t(spark, sf, "orders").select("o_orderkey", done.alias("status"), survey.pending_print((s == "O") | (s == "F"), s == "F").alias("pending"))


@query("SELECT d.doc_id, l.quality, l.toxic FROM documents d LEFT JOIN labels l USING (doc_id) WHERE l.quality IS NOT NULL AND l.toxic IS NOT NULL")
def qualitative_pairs(spark, sf):
    return survey.qualitative_pairs(_t(spark, sf, "documents").join(_t(spark, sf, "labels"), "doc_id", "left"), "doc_id", "quality", "toxic")


@query("""SELECT p_partkey, array_to_string(list_filter([CASE WHEN trim(n) = '' THEN 'n' END, CASE WHEN m IS NULL THEN 'm' END], lambda x: x IS NOT NULL), ',') AS missing, k > 2 AS too_many
FROM (SELECT p_partkey, CASE WHEN p_size % 6 = 0 THEN ' ' ELSE p_name END AS n, CASE WHEN p_size % 4 <> 0 THEN p_type END AS m, p_size % 5 AS k FROM part)""")
def quality_flags(spark, sf):
    p = _t(spark, sf, "part").select("p_partkey", F.when(F.col("p_size") % 6 == 0, " ").otherwise(F.col("p_name")).alias("n"), F.when(F.col("p_size") % 4 != 0, F.col("p_type")).alias("m"), F.slice(F.array(*map(F.lit, range(5))), 1, F.col("p_size") % 5).alias("s"))
    return survey.quality_flags(p, ["n", "m"], "s").select("p_partkey", F.array_join("missing", ",").alias("missing"), "too_many")


@query("SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN 'b' WHEN 1 THEN 'a,b' ELSE 'a,b' END AS selected FROM part")
def toggle_selection(spark, sf):
    start, click = F.array(F.lit("a"), F.lit("b")), F.element_at(F.array(F.lit("a"), F.lit("c"), F.lit("d")), F.col("p_size") % 3 + 1)
    return _t(spark, sf, "part").select("p_partkey", F.array_join(survey.toggle(start, click), ",").alias("selected"))


@query("""SELECT user_id, CASE event_type WHEN 'view' THEN 'V' WHEN 'click' THEN 'C' ELSE '?' END AS label FROM events WHERE value IS NOT NULL ORDER BY ts DESC, event_id DESC LIMIT 50""")
def newest_labelled(spark, sf):
    rows = ranking.newest(_t(spark, sf, "events").filter("value IS NOT NULL"), "ts", "event_id", 50)
    return rows.select("user_id", T.label_of(F.col("event_type"), {"view": "V", "click": "C"}, "?").alias("label"))


# ---------------------------------------------------------------- names



def _case(parts: dict[str, str], test: str, category: bool) -> str:
    ordered = sorted(parts.items(), key=lambda kv: -len(kv[0]))
    return "CASE " + " ".join(f"WHEN {test}(n, '{p}') AND length(n) > {len(p)} THEN '{c if category else p}'" for p, c in ordered) + " END"


_EMBEDDED = "[" + ", ".join(f"CASE WHEN instr(n, '{p}') - 1 > 0 AND instr(n, '{p}') - 1 < length(n) - {len(p)} THEN '{p}' || (instr(n, '{p}') - 1) END" for p, _ in sorted({**SUFFIXES, **PREFIXES}.items(), key=lambda kv: -len(kv[0]))) + "]"
_NAMES = f"""k AS (SELECT p_partkey, p_brand, {_STRIP.format("regexp_replace(split_part(split_part(p_name || CASE WHEN p_size % 5 = 0 THEN '、x' ELSE '[1], y' END, '、', 1), ',', 1), '\\[.*?\\]', '', 'g')")} AS n FROM part),
d AS (SELECT *, {_case(SUFFIXES, 'ends_with', False)} AS suffix, {_case(SUFFIXES, 'ends_with', True)} AS sc, {_case(PREFIXES, 'starts_with', False)} AS prefix, {_case(PREFIXES, 'starts_with', True)} AS pc FROM k),
g AS (SELECT *, CASE WHEN sc IS NULL AND pc IS NULL THEN '' ELSE concat_ws(' + ', '[' || pc || ']', '[BASE]', '[' || sc || ']') END AS slot FROM d)"""


def _names(spark, sf):
    p = _t(spark, sf, "part").withColumn("name", F.concat("p_name", F.when(F.col("p_size") % 5 == 0, "、x").otherwise("[1], y")))
    return names.decompose(p, "name", SUFFIXES, PREFIXES)


@query(f"WITH {_NAMES} SELECT p_partkey, n AS normalized, suffix, substr(n, 1, length(n) - length(suffix)) AS suffix_rest, prefix, pc AS prefix_category, array_to_string(list_filter({_EMBEDDED}, lambda x: x IS NOT NULL), ',') AS embedded, slot AS slot_pattern FROM g")
def name_components(spark, sf):
    inner = F.array_join(F.transform("embedded", lambda x: F.concat(x["component"], x["index"].cast("string"))), ",")
    return _names(spark, sf).select("p_partkey", "normalized", F.col("suffix.component").alias("suffix"), F.col("suffix.remaining").alias("suffix_rest"), F.col("prefix.component").alias("prefix"), F.col("prefix.category").alias("prefix_category"), inner.alias("embedded"), "slot_pattern")


@query(f"""WITH {_NAMES}, u AS (SELECT p_brand, 'suffix' AS kind, suffix AS value FROM g UNION ALL SELECT p_brand, 'prefix', prefix FROM g UNION ALL SELECT p_brand, 'suffix_category', sc FROM g UNION ALL SELECT p_brand, 'prefix_category', pc FROM g)
SELECT p_brand, kind, value, count(*) AS n FROM u WHERE value IS NOT NULL GROUP BY ALL""")
def component_counts(spark, sf):
    return names.component_counts(_names(spark, sf), "p_brand")


@query(f"""WITH {_NAMES} SELECT p_brand, suffix AS value, count(*) AS n, row_number() OVER (PARTITION BY p_brand ORDER BY count(*) DESC, min(p_partkey))::INT AS rank FROM g WHERE suffix IS NOT NULL GROUP BY p_brand, suffix QUALIFY rank <= 3""")
def top_suffixes(spark, sf):
    return names.top_components(_names(spark, sf), "p_brand", "p_partkey")


_HIST = f"{_NAMES}, h AS (SELECT p_brand, slot AS slot_pattern, count(*) AS n, row_number() OVER (PARTITION BY p_brand ORDER BY count(*) DESC, min(p_partkey))::INT AS rank FROM g WHERE slot <> '' GROUP BY p_brand, slot QUALIFY rank <= 5)"


@query(f"WITH {_HIST} SELECT * FROM h")
def slot_histogram(spark, sf):
    return names.slot_histogram(_names(spark, sf), "p_brand", "p_partkey")


@query(f"WITH {_HIST} SELECT slot_pattern, sum(n)::BIGINT AS n FROM h GROUP BY slot_pattern ORDER BY n DESC, slot_pattern LIMIT 15")
def global_patterns(spark, sf):
    return names.global_patterns(names.slot_histogram(_names(spark, sf), "p_brand", "p_partkey"))


_RATES = f"{_NAMES}, r AS (SELECT p_brand, count(*) AS n, count(*) FILTER (slot <> '') / greatest(count(*), 1)::DOUBLE AS rate FROM g GROUP BY p_brand)"


@query(f"WITH {_RATES} SELECT p_brand, n, round(rate, 9) AS rate FROM r")
def decomposition_rate(spark, sf):
    return names.decomposition_rate(_names(spark, sf), "p_brand").withColumn("rate", F.round("rate", 9))


@query(f"WITH {_RATES} SELECT sum(trunc(rate * n)::BIGINT)::BIGINT AS decomposed, sum(n)::BIGINT AS names, round(sum(trunc(rate * n)::BIGINT) / greatest(sum(n), 1)::DOUBLE, 9) AS rate, (SELECT string_agg(p_brand, ',' ORDER BY rate DESC, p_brand) FROM r WHERE rate >= 0.3) AS productive FROM r")
def global_rates(spark, sf):
    out = names.global_rates(names.decomposition_rate(_names(spark, sf), "p_brand"), "p_brand")
    return out.select("decomposed", "names", F.round("rate", 9).alias("rate"), F.array_join("productive", ",").alias("productive"))


@query("""SELECT p_partkey, array_to_string(CASE WHEN p_size % 3 = 0 THEN ['b:9'] WHEN p_size % 7 >= 2 THEN [p_name || ':' || p_size % 7, 'c:2'] ELSE ['c:2'] || CASE WHEN p_size % 7 > 0 THEN [p_name || ':' || p_size % 7] ELSE [] END END, ';') AS links
FROM part""")
def html_rows(spark, sf):
    p = _t(spark, sf, "part")
    html = F.when(F.col("p_size") % 3 == 0, '<a href="k.cgi?1">\n b (9)</a><a href="z">no (3)</a>').otherwise(F.concat(F.lit('<a href="k.cgi?2">'), "p_name", F.lit(" ("), (F.col("p_size") % 7).cast("string"), F.lit(')</A><a href="k.cgi?3">c (2)</a>')))
    links = names.parse_links(html, r'k\.cgi[^"]*"[^>]*>\s*([^\s<(][^<(]*?)\s*\((\d+)\)\s*</[Aa]>')
    return p.select("p_partkey", F.array_join(F.transform(links, lambda x: F.concat(x["name"], F.lit(":"), x["count"].cast("string"))), ";").alias("links"))


_BEST = """n AS (SELECT c_nationkey AS cluster, c_custkey AS o, c_mktsegment AS s FROM customer),
l AS (SELECT c_mktsegment AS s, count(*) AS records, count(DISTINCT c_nationkey) % 13 AS variants FROM customer WHERE c_mktsegment <> 'BUILDING' GROUP BY 1),
b AS (SELECT cluster, n.s AS search_name, records, variants FROM n LEFT JOIN l ON n.s = l.s QUALIFY row_number() OVER (PARTITION BY cluster ORDER BY coalesce(records, 0) DESC, o) = 1)"""


def _best(spark, sf):
    c = _t(spark, sf, "customer")
    n = c.select(F.col("c_nationkey").alias("cluster"), F.col("c_custkey").alias("o"), F.col("c_mktsegment").alias("search_name"))
    looked = c.filter("c_mktsegment <> 'BUILDING'").groupBy(F.col("c_mktsegment").alias("search_name")).agg(F.count("*").alias("records"), (F.countDistinct("c_nationkey") % 13).alias("variants"))
    return names.best_of_cluster(n, looked, "cluster", "o")


@query(f"WITH {_BEST} SELECT cluster, search_name, records, variants, coalesce(variants, 0) AS score FROM b")
def best_of_cluster(spark, sf):
    return _best(spark, sf)


@query(f"WITH {_BEST}, s AS (SELECT coalesce(variants, 0) AS score FROM b) SELECT count(*) FILTER (score >= 10) AS high, count(*) FILTER (score >= 3 AND score < 10) AS middle, count(*) FILTER (score >= 1 AND score < 3) AS low, count(*) FILTER (score = 0) AS none FROM s")
def generativity_tiers(spark, sf):
    return names.tier_counts(_best(spark, sf))


@query("SELECT DISTINCT c_mktsegment AS search_name FROM customer WHERE c_mktsegment NOT IN (SELECT DISTINCT c_mktsegment FROM customer WHERE c_nationkey = 0 AND c_custkey % 50 = 0)")
def lookup_misses(spark, sf):
    c = _t(spark, sf, "customer").withColumnRenamed("c_mktsegment", "search_name")
    return names.lookup_misses(c, c.filter("c_nationkey = 0 AND c_custkey % 50 = 0"))


def _percent(n: str, m: str) -> str:
    """n of m in whole percents, halves to even, on integers."""
    return f"(({n} * 200 + {m}) // (2 * {m}) - CASE WHEN ({n} * 200 + {m}) % (4 * {m}) = 2 * {m} THEN 1 ELSE 0 END)::INT"


@query(f"""WITH v AS (SELECT p_brand, p_type, count(*) AS n FROM part GROUP BY 1, 2), t AS (SELECT p_brand, sum(n)::BIGINT AS m, list(row(p_type, n) ORDER BY n DESC, p_type) AS s FROM v GROUP BY p_brand),
x AS (SELECT p_brand, m, s[1][1] AS v1, s[1][2] AS n1, list_filter(s, lambda z: z[2] / m >= 0.2::DOUBLE AND z[1] <> s[1][1]) AS more FROM t)
SELECT p_brand, concat_ws('；', '「' || v1 || '」型 ' || {_percent('n1', 'm')} || '%', CASE WHEN len(more) > 0 THEN array_to_string(list_transform(more, lambda z: z[1] || ' ' || {_percent('z[2]', 'm')} || '%'), '；') END) AS description FROM x""")
def describe_clusters(spark, sf):
    v = _t(spark, sf, "part").groupBy("p_brand", F.col("p_type").alias("value")).agg(F.count("*").alias("n"))
    listed = F.transform(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("o"), "value", "n"))), lambda x: F.struct(x["value"].alias("value"), x["n"].alias("n")))
    t = v.groupBy("p_brand").agg(F.sum("n").alias("m"), listed.alias("s"))
    return t.select("p_brand", names.describe(F.col("m"), F.col("s"), F.col("s")).alias("description"))


# ---------------------------------------------------------------- text and request functions

_ANSWERS = """x AS (SELECT conv_id, turn, replace(text, chr(13), '') AS text, CASE WHEN turn % 2 = 0 THEN role ELSE ' ' END AS perception, CASE WHEN turn % 3 = 0 THEN 'w' || turn ELSE '' END AS w, CASE WHEN turn % 5 <> 0 THEN 't' || turn ELSE '' END AS t, CASE WHEN conv_id % 2 = 0 THEN 'i' ELSE '' END AS i, CASE WHEN conv_id % 3 = 0 THEN 'n' ELSE '' END AS n FROM conversations),
y AS (SELECT *, CASE WHEN trim(perception) <> '' THEN perception ELSE '' END || CASE WHEN t <> '' THEN t || 'のころ、' ELSE '' END || CASE WHEN w <> '' THEN w || 'で' ELSE '' END || CASE WHEN i <> '' THEN 'その体験は' || i || '。' ELSE '' END || CASE WHEN n <> '' THEN 'それは' || n || '。' ELSE '' END AS c FROM x)"""


def _conversations(spark, sf):
    e = F.expr("map('perception', if(turn % 2 = 0, role, ' '), 'where', if(turn % 3 = 0, concat('w', turn), ''), 'when', if(turn % 5 <> 0, concat('t', turn), ''), 'impression', if(conv_id % 2 = 0, 'i', ''), 'nature', if(conv_id % 3 = 0, 'n', ''))")
    return _t(spark, sf, "conversations").withColumn("answers", e)


@query(f"WITH {_ANSWERS} SELECT conv_id, turn, md5(CASE WHEN instr(text, chr(10)) > 0 THEN substr(text, 1, instr(text, chr(10)) - 1) || substr(text, instr(text, chr(10)) + 1) ELSE text END || CASE WHEN c <> '' THEN '。' || c ELSE '' END || '。') AS query_md5 FROM y")
def search_queries(spark, sf):
    return _conversations(spark, sf).select("conv_id", "turn", F.md5(T.search_query(F.regexp_replace("text", "\r", ""), F.col("answers"))).alias("query_md5"))


@query(f"""WITH {_ANSWERS}, s AS (SELECT conv_id, turn, 'impression:' || i || '|nature:' || n || '|perception:' || perception || '|when:' || t || '|where:' || w AS s FROM x)
SELECT conv_id, turn, s AS signature, list_reduce(list_prepend(0, list_transform(string_split(s, ''), lambda c: ord(c))), lambda a, b: (a + b) % 9973)::INT AS seed, ((list_sum(list_transform(string_split(s, ''), lambda c: ord(c))) + turn) % 997)::BIGINT AS client_seed FROM s""")
def request_signatures(spark, sf):
    s = T.signature(F.col("answers"))
    return _conversations(spark, sf).select("conv_id", "turn", s.alias("signature"), T.rolling_hash(s).alias("seed"), T.client_seed(s, F.col("turn")).alias("client_seed"))


@query(f"""WITH {_ANSWERS}, p AS (SELECT *, concat_ws('. ', CASE WHEN w <> '' THEN 'Place: ' || w END, CASE WHEN t <> '' THEN 'Time: ' || t END, CASE WHEN trim(perception) <> '' THEN 'Felt: ' || perception END) AS sc FROM x)
SELECT conv_id, turn, 'Name: ' || role_ || CASE WHEN sc <> '' THEN chr(10) || sc || '.' ELSE '' END || chr(10) || chr(10) || 'End' AS prompt, 'Name: ' || role_ || CASE WHEN sc <> '' THEN chr(10) || sc || '.' ELSE '' END || chr(10) || 'End' AS compact FROM (SELECT p.*, c.role AS role_ FROM p JOIN conversations c USING (conv_id, turn))""")
def prompts(spark, sf):
    fields = {"name": F.col("role"), "scene": T.scene(F.col("answers"), {"where": "Place", "when": "Time", "perception": "Felt"})}
    lines = ["Name: {name}", "{scene}", "", "End"]
    return _conversations(spark, sf).select("conv_id", "turn", T.fill_template(lines, fields).alias("prompt"), T.fill_template(lines, fields, drop_blank=True).alias("compact"))


@query("""SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN c_name || '/p;名無し/unknown' WHEN 1 THEN c_name || '/place_action' END AS candidates FROM customer""")
def parse_replies(spark, sf):
    reply = F.expr("""CASE c_custkey % 4 WHEN 0 THEN concat('Sure: [{"name":"', c_name, '","type":"p"},{"name":""}] done') WHEN 1 THEN concat('```{"name":"', c_name, '"}```') WHEN 2 THEN 'nothing' ELSE '' END""")
    joined = F.array_join(F.transform(T.parse_reply(reply), lambda x: F.concat(x["name"], F.lit("/"), x["naming_type"])), ";")
    return _t(spark, sf, "customer").select("c_custkey", joined.alias("candidates"))


@query("""SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN (o_orderkey % 90)::DOUBLE * 1000 WHEN 1 THEN (o_orderkey % 90)::DOUBLE WHEN 2 THEN (o_orderkey % 90)::DOUBLE END AS delay_ms,
o_orderkey % 5 = 0 OR o_orderkey % 3 = 0 AS rate_limited, CASE WHEN o_orderkey % 2 = 0 THEN (o_orderkey % 600)::INT ELSE 7 END AS status FROM orders""")
def error_fields(spark, sf):
    k = F.col("o_orderkey")
    n = (k % 90).cast("string")
    delay = F.when(k % 4 == 0, F.concat(n, F.lit("s"))).when(k % 4 == 1, F.concat(n, F.lit("ms"))).when(k % 4 == 2, n).otherwise("soon")
    limited = T.is_rate_limited(F.when(k % 5 == 0, 429).otherwise(500), F.when(k % 3 == 0, "Quota used up").otherwise("other"))
    code = T.first_number(F.lit("none"), F.when(k % 2 == 0, F.concat((k % 600).cast("string"), F.lit(" x"))), F.lit("7"))
    return _t(spark, sf, "orders").select("o_orderkey", T.retry_delay_ms(delay).alias("delay_ms"), limited.alias("rate_limited"), code.alias("status"))


@query("""SELECT c_custkey, replace(replace(replace(c_name || ' /&+*', '#', '%23'), ' ', '%20'), '&+*', '%26%2B%2A') AS quoted, c_name AS decoded, substr(c_mktsegment, 1, 4) AS excerpt, c_mktsegment AS bare FROM customer""")
def encodings(spark, sf):
    uri = F.concat(F.lit("data:text/plain;base64,"), F.base64(F.encode("c_name", "UTF-8")))
    return _t(spark, sf, "customer").select("c_custkey", T.quote_url(F.concat("c_name", F.lit(" /&+*"))).alias("quoted"), F.decode(T.data_uri_bytes(uri), "UTF-8").alias("decoded"), T.excerpt(F.col("c_mktsegment"), 4).alias("excerpt"), T.strip_braces(F.concat(F.lit("{'"), "c_mktsegment", F.lit("' }"))).alias("bare"))


@query("""WITH n AS (SELECT count(*) AS n FROM documents), x AS (SELECT doc_id, unnest([doc_id, doc_id + n.n]) - 987654321 % n.n AS pos FROM documents, n)
SELECT doc_id, pos AS "position", floor((1::DOUBLE - 0.06::DOUBLE * pos) * 1000 + 0.5) / 1000 AS similarity FROM x WHERE pos BETWEEN 0 AND 4""")
def fallback_slice(spark, sf):
    d = _t(spark, sf, "documents").select("doc_id")
    return serving.fallback_results(d, "doc_id", d.count(), F.lit(987654321)).select("doc_id", "position", "similarity")


@query("SELECT n_nationkey, CASE WHEN n_nationkey % 2 = 0 THEN 'a0,a1,' || n_name ELSE 'a0,a1,spare' END AS names, CASE WHEN n_nationkey % 2 = 0 THEN n_name ELSE 'spare' END AS llm FROM nation")
def concept_assembly(spark, sf):
    one = lambda source, name: F.struct(F.lit(source).alias("source"), name.alias("name"), *[F.lit("").alias(c) for c in ("reading", "description", "label", "naming_type")])
    db = F.array(*[one("db", F.lit(f"a{i}")) for i in range(3)])
    llm = F.when(F.col("n_nationkey") % 2 == 0, F.array(one("llm", F.col("n_name"))))
    all_ = serving.assemble_concepts(db, llm, one("llm", F.lit("spare")))
    joined = lambda c: F.array_join(F.transform(c, lambda x: x["name"]), ",")
    return _t(spark, sf, "nation").select("n_nationkey", joined(all_).alias("names"), joined(serving.by_provenance(all_)).alias("llm"))


# ---------------------------------------------------------------- order

@query("""SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) = 1""")
def keep_first(spark, sf):
    o = _t(spark, sf, "orders").select("o_custkey", "o_orderkey", F.struct("o_orderdate", "o_orderkey").alias("at"))
    return ranking.keep_first(o, "o_custkey", "at").select("o_custkey", "o_orderkey")


@query("""WITH t AS (SELECT source FROM documents GROUP BY source ORDER BY count(*) DESC, source LIMIT 10) SELECT doc_id, source FROM documents WHERE source IN (SELECT source FROM t)""")
def top_labels(spark, sf):
    return ranking.top_labels(_t(spark, sf, "documents"), "source").select("doc_id", "source")


@query("SELECT lang, min(doc_id) AS first_seen FROM documents GROUP BY lang")
def first_seen_groups(spark, sf):
    return _t(spark, sf, "documents").groupBy("lang").agg(F.min("doc_id").alias("first_seen")).orderBy("first_seen")


@query("SELECT s_suppkey, s_name FROM supplier WHERE s_nationkey IS NOT NULL")
def projected_scan(spark, sf):
    from ..sources.readers import table

    return table(spark, f"{sf}/supplier.parquet", ["s_suppkey", "s_name", "s_nationkey"]).filter("s_nationkey IS NOT NULL").select("s_suppkey", "s_name")


# ---------------------------------------------------------------- topics and the sparse baseline

_TOKENS = r"t AS (SELECT doc_id, lang, unnest(list_filter(regexp_extract_all(lower(text), '[\p{L}\p{N}]+'), lambda w: length(w) >= 2)) AS token FROM documents)"


@query(f"""WITH {_TOKENS}, s AS (SELECT token, count(*) AS total, count(DISTINCT doc_id) AS df FROM t GROUP BY token)
SELECT token, total, df FROM s WHERE df >= 2 AND df <= 0.95 * (SELECT count(*) FROM documents) ORDER BY total DESC, token LIMIT 5000""")
def vocabulary(spark, sf):
    return topics.vocabulary(_t(spark, sf, "documents"), "doc_id", T.tokens(F.col("text")))


@query(f"""WITH {_TOKENS}, c AS (SELECT lang, token, count(*) AS tf FROM t GROUP BY 1, 2), w AS (SELECT lang, sum(tf) AS words FROM c GROUP BY 1), f AS (SELECT token, sum(tf) AS f FROM c GROUP BY 1),
x AS (SELECT c.lang AS topic, c.token, (tf / words * ln(1 + (SELECT avg(words) FROM w) / f))::DOUBLE AS weight FROM c JOIN w USING (lang) JOIN f USING (token))
SELECT topic, token, round(weight, 9) AS weight FROM x QUALIFY row_number() OVER (PARTITION BY topic ORDER BY weight DESC, token) <= 10""")
def topic_words(spark, sf):
    ensure_checkpoint_dir(spark)
    return topics.class_tfidf(_t(spark, sf, "documents"), "lang", T.tokens(F.col("text"))).select("topic", "token", F.round("weight", 9).alias("weight"))


@query("SELECT label, i, round(avg(x), 6) AS x FROM (SELECT label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1)::INT - 1 AS i FROM embeddings) GROUP BY ALL")
def topic_centroids(spark, sf):
    return topics.centroids(_t(spark, sf, "embeddings"), "label", "embedding").withColumn("x", F.round("x", 6))


@query("SELECT p_brand, count(*) AS size, array_to_string(list(p_name ORDER BY p_partkey)[1:5], ',') AS representatives FROM part GROUP BY p_brand")
def cluster_members(spark, sf):
    out = topics.cluster_members(_t(spark, sf, "part"), "p_brand", "p_name", "p_partkey")
    return out.select("p_brand", "size", F.array_join("representatives", ",").alias("representatives"))


_GRAMS = r"""w AS (SELECT item_id, unnest(list_filter(regexp_split_to_array(lower(text), '\s+'), lambda x: x <> '')) AS w FROM benchmark),
p AS (SELECT item_id, ' ' || w || ' ' AS w FROM w),
g AS (SELECT item_id, unnest(flatten(list_transform([2, 3, 4], lambda n: CASE WHEN length(w) >= n OR n = 2 THEN list_transform(range(1, greatest(length(w) - n + 1, 1) + 1), lambda i: substr(w, i, n)) ELSE [] END))) AS gram FROM p),
c AS (SELECT item_id, gram, count(*) AS tf FROM g GROUP BY ALL), n AS (SELECT count(*) AS n FROM benchmark),
k AS (SELECT gram, sum(tf) AS total, ln((1 + n.n) / (1 + count(*))::DOUBLE) + 1 AS idf FROM c, n GROUP BY gram, n.n ORDER BY total DESC, gram LIMIT 10000),
v AS (SELECT item_id, gram, (1 + ln(tf)) * idf AS w FROM c JOIN k USING (gram)), m AS (SELECT item_id, sqrt(sum(w * w)) AS m FROM v GROUP BY 1),
z AS (SELECT item_id, gram, w / m AS w FROM v JOIN m USING (item_id)),
s AS (SELECT a.item_id AS query_id, b.item_id AS id, sum(a.w * b.w) AS score FROM z a JOIN z b USING (gram) WHERE a.item_id <> b.item_id GROUP BY ALL)"""


@query(f"WITH {_GRAMS} SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id)::INT AS rank, id, round(score, 9) AS score FROM s QUALIFY rank <= 5")
def sparse_neighbours(spark, sf):
    ensure_checkpoint_dir(spark)
    w = evaluation.tfidf(_t(spark, sf, "benchmark"), "item_id", evaluation.char_ngrams(F.col("text")))
    return evaluation.sparse_neighbours(w)


@query(f"""WITH RECURSIVE {_COSINE}, near AS (SELECT query_id AS q, id, score AS s FROM r WHERE rank <= 10), e AS (SELECT a.q, a.id, a.s FROM near a JOIN near b ON a.q = b.id AND a.id = b.q),
w(node, reach) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT w.node, e.id FROM w JOIN e ON w.reach = e.q),
l AS (SELECT node, min(reach) AS label FROM w GROUP BY node), z AS (SELECT label, count(*) AS size FROM l GROUP BY label), c AS (SELECT q, avg(s) AS conf FROM e GROUP BY q)
SELECT node AS id, CASE WHEN size >= 5 THEN label ELSE -1 END AS cluster_id, CASE WHEN size >= 5 THEN round(conf, 6) END AS confidence FROM l JOIN z USING (label) LEFT JOIN c ON c.q = node""")
def mutual_neighbour_clusters(spark, sf):
    ensure_checkpoint_dir(spark)
    out = topics.mutual_neighbour_clusters(_t(spark, sf, "embeddings"), "vec_id", "embedding", k=10)
    return out.withColumn("confidence", F.round("confidence", 6))


@query()
def principal_coordinates(spark, sf):
    return evaluation.pca_coordinates(_t(spark, sf, "embeddings"), "vec_id", "embedding")


_POISSON = [sum(math.exp(-1) / math.factorial(j) for j in range(k + 1)) for k in range(12)]


@query(f"""WITH {_COSINE}, h AS (SELECT query_id, sum(CASE WHEN a.label = b.label AND b.label <> 0 THEN 1 ELSE 0 END) / 5::DOUBLE AS p
FROM r JOIN embeddings a ON a.vec_id = query_id JOIN embeddings b ON b.vec_id = id WHERE rank <= 5 AND a.label <> 0 GROUP BY query_id),
x0 AS (SELECT p, r, (query_id % 2147483648 * 1000003 + r * 8191 + 42 * 131) % 2147483648 AS x FROM h, range(1000) t(r)),
x1 AS (SELECT p, r, (x * 1103515245 + 12345) % 2147483648 AS x FROM x0), x2 AS (SELECT p, r, (xor(x, x >> 15) * 69069 + 1) % 2147483648 AS x FROM x1),
x3 AS (SELECT p, r, (xor(x, x >> 13) * 1664525 + 1013904223) % 2147483648 / 2147483648::DOUBLE AS u FROM x2),
x4 AS (SELECT p, r, len(list_filter({_POISSON!r}::DOUBLE[], lambda c: c <= u)) AS w FROM x3),
m AS (SELECT r, sum(p * w) / sum(w) AS m FROM x4 GROUP BY r), o AS (SELECT list_sort(list(m)) AS ms FROM m)
SELECT round((SELECT avg(p) FROM h), 9) AS mean, round(ms[26], 9) AS lo, round(ms[976], 9) AS hi, (SELECT count(*) FROM h) AS n FROM o""")
def bootstrap_interval(spark, sf):
    near = search.neighbours(_t(spark, sf, "embeddings"), k=5, id_col="vec_id")
    out = evaluation.bootstrap_interval(evaluation.precision_at_k(near, _labels(spark, sf)))
    return out.withColumns({c: F.round(c, 9) for c in ("mean", "lo", "hi")})


@query()
def probe_accuracy(spark, sf):
    got = evaluation.probe(_t(spark, sf, "embeddings"), "embedding", "label", "vec_id")
    return spark.createDataFrame([(float(got["accuracy"]), float(got["std"]), int(got["n"]), int(got["classes"]), int(got["folds"]))], "accuracy double, std double, n long, classes long, folds long")


def _training_data(spark, sf):
    e = _t(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), "embedding", "label")
    pairs = _topic_pairs(spark, sf)
    for axis, groups in (("location", 20), ("phenomenon", 13)):
        g = e.select("id", (F.col("id") % groups).alias("g"))
        pairs = pairs.unionByName(corpus.draw_pairs(g, "g", axis))
    data = training.collect_pairs(pairs, e)
    return {k: data[k] for k in AXES if k in data}


@query()
def train_projection(spark, sf):
    fitted = training.train(_training_data(spark, sf))
    rows = [(i, *(float(r[k]) for k in [*AXES, "orthogonality", "total"])) for i, r in enumerate(fitted.log)]
    return spark.createDataFrame(rows, "epoch int, topic double, location double, phenomenon double, orthogonality double, total double")


@query()
def ablation(spark, sf):
    rows = training.ablation(_training_data(spark, sf))
    return spark.createDataFrame([(r["factor"], r["value"], float(r["total"])) for r in rows], "factor string, value double, total double")


# ---------------------------------------------------------------- change log and queue

_LOG = "e AS (SELECT user_id, event_id AS seq, CASE event_type WHEN 'signup' THEN 'INSERT' WHEN 'error' THEN 'DELETE' ELSE 'UPDATE' END AS op, value FROM events)"


def _log(spark, sf):
    e = _t(spark, sf, "events")
    op = F.when(F.col("event_type") == "signup", "INSERT").when(F.col("event_type") == "error", "DELETE").otherwise("UPDATE")
    payload = F.create_map(F.lit("name"), F.when(F.col("event_type") == "purchase", "").otherwise("named"), F.lit("value"), F.col("value").cast("string"))
    return e.select(op.alias("op"), F.col("user_id").cast("string").alias("id"), F.col("event_id").alias("seq"), F.when(op != "DELETE", payload).alias("payload"))


@query(f"""WITH {_LOG}, s AS (SELECT user_id, max(seq) FILTER (op = 'INSERT') AS i, coalesce(max(seq) FILTER (op = 'DELETE'), -1) AS d, arg_max(value, seq) FILTER (op <> 'DELETE') AS v FROM e GROUP BY 1)
SELECT user_id::VARCHAR AS id, i AS created_seq, v AS value FROM s WHERE i > d ORDER BY i DESC LIMIT 200""")
def cdc_list(spark, sf):
    return cdc.list_view(_log(spark, sf)).select("id", "created_seq", F.col("payload")["value"].cast("double").alias("value"))


@query("""WITH d AS (SELECT user_id, coalesce(max(event_id) FILTER (event_type = 'error'), -1) AS d FROM events GROUP BY 1)
SELECT e.user_id::VARCHAR AS id, min(event_id) AS shown_seq FROM events e JOIN d ON e.user_id = d.user_id AND e.event_id > d.d WHERE event_type <> 'purchase' GROUP BY 1""")
def cdc_gallery(spark, sf):
    return cdc.gallery_view(_log(spark, sf)).select("id", "shown_seq")


@query(f"WITH {_LOG} SELECT user_id::VARCHAR AS id, arg_max(op, seq) AS op, max(seq) AS seq FROM e GROUP BY 1")
def cdc_latest(spark, sf):
    return cdc.latest_state(_log(spark, sf))


@query("""WITH e AS (SELECT user_id, event_type = 'purchase' AND coalesce(value, 0) >= 100 AS ok FROM events), a AS (SELECT user_id, count(*) AS n, count(*) FILTER (NOT ok) AS f, bool_or(ok) AS ok FROM e GROUP BY 1)
SELECT user_id AS id, n AS attempts, greatest(f - 1, 0) AS retries, CASE WHEN ok THEN 'printed' WHEN greatest(f - 1, 0) > 3 THEN 'dropped' ELSE 'queued' END AS outcome FROM a""")
def print_retries(spark, sf):
    a = _t(spark, sf, "events").select(F.col("user_id").alias("id"), F.col("event_id").alias("seq"), F.expr("event_type = 'purchase' AND coalesce(value, 0) >= 100").alias("ok"))
    return queue.retry_state(a)


@query("SELECT event_id AS seq, user_id AS id FROM events ORDER BY event_id DESC LIMIT 10")
def recent_jobs(spark, sf):
    return queue.recent_jobs(_t(spark, sf, "events").select(F.col("event_id").alias("seq"), F.col("user_id").alias("id")))


# ---------------------------------------------------------------- the same views from streams


def _stream(spark, df: DataFrame, name: str, files: int = 3):
    """df as a stream of a few files, a micro-batch each, and a folder for its output."""
    from .scratch import fresh_folder

    root = fresh_folder(spark, name)
    df.repartition(files).write.parquet(f"{root}/in")
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{root}/in"), root


@query(_SQL["cdc_list"])
def stream_cdc_list(spark, sf):
    stream, root = _stream(spark, _log(spark, sf), "cdc-list")
    cdc.store_log(stream, f"{root}/log", f"{root}/checkpoint").awaitTermination()
    log = spark.read.schema(cdc.LOG).parquet(f"{root}/log")
    return cdc.list_view(log).select("id", "created_seq", F.col("payload")["value"].cast("double").alias("value"))


@query("SELECT user_id::VARCHAR AS id, max(event_id) AS seq FROM events GROUP BY 1 HAVING arg_max(event_type, event_id) <> 'error'")
def stream_cdc_state(spark, sf):
    """Users whose last change is no deletion, from per-id state over a stream in order of seq."""
    named = _log(spark, sf).withColumn("payload", F.when(F.col("op") != "DELETE", F.create_map(F.lit("name"), F.lit("n"))))
    stream, root = _stream(spark, named.repartitionByRange(3, "seq"), "cdc-state", 1)

    def keep(df, epoch):
        df.write.mode("overwrite").parquet(f"{root}/out/epoch={epoch}")

    cdc.keep_state(stream).writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    out = spark.read.parquet(f"{root}/out").groupBy("id").agg(F.max_by(F.struct("shown", "seq"), "seq").alias("s"))
    return out.filter("s.shown").select("id", "s.seq")


@query("SELECT user_id::VARCHAR AS id, count(*) = 1 AS once FROM (SELECT DISTINCT user_id FROM events WHERE event_type = 'click') GROUP BY 1")
def stream_print_queue(spark, sf):
    e = _t(spark, sf, "events")
    states = e.select(F.col("user_id").cast("string").alias("id"), F.lit(True).alias("print_triggered"), (F.col("event_type") != "click").alias("printed"))
    stream, root = _stream(spark, states, "queue")
    queue.drain(stream, lambda df: df.select("id", F.lit(True).alias("ok")), f"{root}/log", f"{root}/checkpoint", availableNow=True).awaitTermination()
    return spark.read.parquet(f"{root}/log").groupBy("id").agg((F.count("*") == 1).alias("once"))


@query("SELECT doc_id AS id, length(text) AS n FROM documents")
def stream_incremental_embedding(spark, sf):
    d = _t(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text")
    stream, root = _stream(spark, d.union(d), "embed")
    queue.embed_incrementally(stream, lambda df: df.select("id", F.length("text").alias("n")), f"{root}/out", f"{root}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{root}/out").select("id", F.col("n").cast("long").alias("n"))


# ---------------------------------------------------------------- remaining small operators


@query("SELECT event_type, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std, min(n) AS least FROM events, (SELECT min(c) AS n FROM (SELECT count(*) AS c FROM events GROUP BY event_type)) GROUP BY event_type")
def fold_statistics(spark, sf):
    e = _t(spark, sf, "events")
    least = e.groupBy("event_type").count().agg(F.min("count").alias("least"))
    out = e.groupBy("event_type").agg(F.round(F.avg("value"), 6).alias("mean"), F.round(F.stddev_pop("value"), 6).alias("std"))
    return out.join(least, F.lit(True))  # one row


@query("SELECT event_id, floor(value * 100 + 0.5) / 100 AS half_up, 1 - 0.06::DOUBLE * (event_id % 5) AS ramp FROM events")
def score_rounding(spark, sf):
    e = _t(spark, sf, "events")
    return e.select("event_id", V.round_half_up(F.col("value"), 2).alias("half_up"), V.ramp(F.col("event_id") % 5).alias("ramp"))


@query("SELECT c_custkey, c_mktsegment AS style, CASE c_mktsegment WHEN 'MACHINERY' THEN 'steel' WHEN 'HOUSEHOLD' THEN 'ink' ELSE 'ink' END AS prompt, c_acctbal > 0 AND c_acctbal IS NOT NULL AS rated FROM customer")
def style_lookup(spark, sf):
    c = _t(spark, sf, "customer")
    return c.select("c_custkey", F.col("c_mktsegment").alias("style"), T.label_of(F.col("c_mktsegment"), {"MACHINERY": "steel", "HOUSEHOLD": "ink"}, "ink").alias("prompt"), (F.col("c_acctbal") > 0).alias("rated"))


@query("SELECT o_custkey AS id, max(o_orderkey) AS seq, count(*) AS changes FROM orders GROUP BY 1")
def upsert_log(spark, sf):
    """Inserts, updates and upserts of orders as changes of their customers' rows."""
    from ..sources import writers
    from .scratch import fresh_folder

    root = fresh_folder(spark, "upsert")
    o = _t(spark, sf, "orders").select("o_orderkey", F.col("o_custkey").cast("string").alias("id"), "o_orderstatus")
    writers.insert(o.filter("o_orderkey % 3 = 0"), f"{root}/log", ["o_orderkey"], "id")
    writers.update(o.filter("o_orderkey % 3 = 1"), f"{root}/log", ["o_orderkey"], "id")
    writers.upsert(o.filter("o_orderkey % 3 = 2"), f"{root}/log", ["o_orderkey"], "id")
    log = spark.read.schema(cdc.LOG).parquet(f"{root}/log")
    return log.groupBy(F.col("id").cast("long").alias("id")).agg(F.max(F.col("payload")["o_orderkey"].cast("long")).alias("seq"), F.count("*").alias("changes"))
