"""From a raw list of names and details to clean entries, pairs for training, and what is left to embed."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .ranking import keep_first, top_per_group


def clean_corpus(raw: DataFrame, source: str, prefix: str = "entry", ends: str = "。！？", places: list[str] | None = None, default_place: str = T.vocab.NOWHERE) -> DataFrame:
    """raw: ordinal, name, detail. Entries (id, name, summary, location, source): details of ten
    characters or more, the first of each cleaned name, non-empty summaries. The id counts the
    raw rows; a first entry with an empty summary still hides later ones of its name."""
    rows = raw.filter(F.length(T.strip(F.col("detail"))) >= 10).withColumn("name", T.clean_name(F.col("name"))).filter("name <> ''")
    first = keep_first(rows, "name", "ordinal")
    out = first.select(
        F.format_string(f"{prefix}-%04d", F.col("ordinal").cast("long")).alias("id"),
        "name",
        T.extract_summary(F.col("detail"), ends=ends).alias("summary"),
        T.extract_location(F.col("detail"), places, default_place).alias("location"),
        F.lit(source).alias("source"),
    )
    return out.filter("summary <> ''")


def to_embed(entries: DataFrame, done: DataFrame, id_col: str = "id", summary_col: str = "summary") -> DataFrame:
    """Entries with a summary of more than five characters that have not been embedded yet."""
    return entries.filter(F.length(summary_col) > 5).join(done.select(id_col), id_col, "left_anti")


def append_results(previous: DataFrame, new: DataFrame) -> DataFrame:
    return previous.unionByName(new)


def usable_entries(clusters: DataFrame, embeddings: DataFrame, id_col: str = "id", cluster_col: str = "cluster_id") -> DataFrame:
    """Clusters with has_embedding; missing cluster numbers become -1."""
    have = embeddings.filter("embedding IS NOT NULL").select(F.col(id_col)).distinct().withColumn("has_embedding", F.lit(True))
    return clusters.withColumn(cluster_col, F.coalesce(cluster_col, F.lit(-1))).join(have, id_col, "left").withColumn("has_embedding", F.coalesce("has_embedding", F.lit(False)))


def only_usable(entries: DataFrame, cluster_col: str = "cluster_id") -> DataFrame:
    """Entries of usable_entries() that have an embedding and a cluster."""
    return entries.filter(F.col("has_embedding") & (F.col(cluster_col) != -1))


def fully_labelled(df: DataFrame, labels: list[str]) -> DataFrame:
    """Rows that have all the labels."""
    return df.na.drop(subset=labels)


def describable(entries: DataFrame, cluster_col: str = "cluster_id", summary_col: str = "summary") -> DataFrame:
    """Entries of a cluster whose summary has more than 30 characters."""
    return entries.filter((F.col(cluster_col) != -1) & (F.length(summary_col) > 30))


def group_pairs(df: DataFrame, group: str, id_col: str = "id") -> DataFrame:
    """(group, a, b): unordered pairs of one group; a pair that shares two groups comes twice.

    Emits the square of a group's size, as the pairs are what is asked for; draw_pairs() gives
    a bounded number of them without the others."""
    left = df.select(F.col(group), F.col(id_col).alias("a"))
    right = df.select(F.col(group), F.col(id_col).alias("b"))
    return left.join(right, group).filter("a < b").select(group, "a", "b")


def draw_pairs(df: DataFrame, group: str, axis: str, cap: int = 5000, seed: int = 42, id_col: str = "id") -> DataFrame:
    """(axis, a, b): `cap` pairs of two rows of one group, all pairs if there are fewer, each
    as likely as any other. Rows without a group or an id have no pairs; an id that repeats in
    a group is one row of it.

    No pair is formed but those drawn. Rows of a group are numbered in the order of a hash; the
    pair of the rows i < j has the number j (j - 1) / 2 + i in its group, groups follow each
    other, and of `cap` equal parts of all numbers each gives one, by hash. The numbering is
    exact by counts of 256 parts of each group, so that a large group is no single task."""
    h = F.md5(F.concat_ws("|", F.col(id_col).cast("string"), F.lit(str(seed))))
    rows = df.select(F.col(group).alias("g"), F.col(id_col).alias("id"), h.alias("h")).filter("g IS NOT NULL AND id IS NOT NULL").distinct()
    rows = rows.withColumn("part", F.substring("h", 1, 2))
    parts = rows.groupBy("g", "part").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("g").orderBy("part")) - F.col("n")  # 256 rows a group
    offsets = parts.select("g", "part", before.alias("offset"))
    own = F.row_number().over(Window.partitionBy("g", "part").orderBy("h", "id")) - 1
    numbered = rows.withColumn("own", own).join(offsets, ["g", "part"]).select("g", "id", (F.col("own") + F.col("offset")).alias("at"))

    whole = "decimal(38,0)"
    sizes = parts.groupBy("g").agg(F.sum("n").alias("n")).select("g", F.expr("div(cast(n AS decimal(19,0)) * (n - 1), 2)").cast(whole).alias("pairs")).filter("pairs > 0")
    sizes = sizes.withColumn("high", F.sum("pairs").over(Window.orderBy("g")).cast(whole))  # one row a group
    total = sizes.agg(F.sum("pairs").cast(whole).alias("total"))
    spans = sizes.join(total, F.lit(True)).select("g", (F.col("high") - F.col("pairs")).cast(whole).alias("low"), "high", "total", F.least(F.lit(cap).cast(whole), "total").cast("long").alias("cap"))
    cut = lambda x: F.expr(f"cast(div(cast({x} AS decimal(28,0)) * cast(cap AS decimal(10,0)), total) AS long)")
    strata = spans.withColumn("t", F.explode(F.sequence(cut("low"), F.least(cut("high - 1") + 1, F.col("cap") - 1))))
    edge = lambda t: F.expr(f"cast(div(cast(total AS decimal(28,0)) * cast({t} AS decimal(10,0)), cap) AS decimal(28,0))")
    strata = strata.withColumns({"a": edge("t"), "b": edge("t + 1")})
    jitter = F.conv(F.substring(F.md5(F.concat_ws("|", F.col("t").cast("string"), F.lit(str(seed)))), 1, 15), 16, 10).cast("decimal(20,0)")
    drawn = strata.withColumn("pos", F.col("a") + jitter % (F.col("b") - F.col("a"))).filter("pos >= low AND pos < high")
    r = (F.col("pos") - F.col("low")).cast("decimal(28,0)")
    drawn = drawn.select("g", r.alias("r"), F.floor((F.sqrt(r.cast("double") * 8 + 1) + 1) / 2).cast("long").alias("j"))
    base = lambda j: f"cast(div(cast({j} AS decimal(14,0)) * cast({j} - 1 AS decimal(14,0)), 2) AS decimal(28,0))"
    j = F.expr(f"CASE WHEN {base('j')} > r THEN j - 1 WHEN {base('(j + 1)')} <= r THEN j + 1 ELSE j END")  # the root is rounded
    drawn = drawn.withColumn("j", j).select("g", F.expr(f"cast(r - {base('j')} AS long)").alias("i"), "j")
    first = numbered.select("g", F.col("at").alias("i"), F.col("id").alias("x"))
    second = numbered.select("g", F.col("at").alias("j"), F.col("id").alias("y"))
    out = drawn.join(first, ["g", "i"]).join(second, ["g", "j"])
    return out.select(F.lit(axis).alias("axis"), F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))


def pairs_with_embeddings(pairs: DataFrame, embeddings: DataFrame, id_col: str = "id") -> DataFrame:
    """Pairs of which both ends have an embedding. The pairs are the small side: their ends
    thin out the embeddings, not the other way round."""
    ends = pairs.select(F.explode(F.array("a", "b")).alias(id_col)).distinct()
    have = embeddings.select(id_col).join(ends, id_col, "left_semi")
    for end in ("a", "b"):
        pairs = pairs.join(have.select(F.col(id_col).alias(end)), end, "left_semi")
    return pairs.select("axis", "a", "b")


def index_rows(df: DataFrame, group: str, id_col: str = "id", multi: bool = False) -> DataFrame:
    """(key, id): the index in long form, each id of a key once; multi: the group column is an array."""
    rows = df.select(F.explode(group).alias("key") if multi else F.col(group).alias("key"), F.col(id_col).alias("id"))
    return rows.filter("key IS NOT NULL AND id IS NOT NULL").distinct()


def index_heads(rows: DataFrame, k: int = 5) -> DataFrame:
    """(key, first_ids, n) of index_rows(): the k smallest ids of each key and the number of all."""
    heads = top_per_group(rows, "key", ["id"], k).groupBy("key").agg(F.array_sort(F.collect_list("id")).alias("first_ids"))
    return heads.join(rows.groupBy("key").agg(F.count("*").alias("n")), "key")


def inverted_index(df: DataFrame, group: str, id_col: str = "id", multi: bool = False) -> DataFrame:
    """(key, ids): sorted ids of each group, for groups that fit into a row; index_rows() is for any."""
    return index_rows(df, group, id_col, multi).groupBy("key").agg(F.array_sort(F.collect_list("id")).alias("ids"))
