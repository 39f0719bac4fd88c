"""Name morphology by cluster, and the generativity of names in an outside index."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.readers import exists


def decompose(df: DataFrame, name_col: str = "name", suffixes: dict[str, str] | None = None, prefixes: dict[str, str] | None = None) -> DataFrame:
    """df with normalized, suffix, prefix, embedded and slot_pattern."""
    both = {**suffixes, **prefixes} if suffixes and prefixes else None
    out = df.withColumn("normalized", T.normalize_name(F.col(name_col)))
    n = F.col("normalized")
    out = out.withColumns({"suffix": T.detect_suffix(n, suffixes), "prefix": T.detect_prefix(n, prefixes), "embedded": T.detect_embedded(n, both)})
    return out.withColumn("slot_pattern", T.slot_pattern(F.col("prefix.category"), F.col("suffix.category")))


def component_counts(decomposed: DataFrame, cluster: str) -> DataFrame:
    """(cluster, kind, value, n): suffixes, prefixes and their categories by cluster."""
    kinds = F.array(*[F.struct(F.lit(k).alias("kind"), F.col(f"{k.split('_')[0]}.{'category' if '_' in k else 'component'}").alias("value")) for k in ("suffix", "prefix", "suffix_category", "prefix_category")])
    rows = decomposed.select(cluster, F.explode(kinds).alias("x")).select(cluster, "x.kind", "x.value").filter("value IS NOT NULL")
    return rows.groupBy(cluster, "kind", "value").agg(F.count("*").alias("n"))


def top_components(decomposed: DataFrame, cluster: str, ordinal: str, part: str = "suffix", k: int = 3) -> DataFrame:
    """(cluster, value, n, rank): the most common components; ties go to the first seen."""
    rows = decomposed.filter(F.col(part).isNotNull()).groupBy(cluster, F.col(f"{part}.component").alias("value")).agg(F.count("*").alias("n"), F.min(ordinal).alias("first"))
    rank = F.row_number().over(Window.partitionBy(cluster).orderBy(F.desc("n"), "first"))
    return rows.withColumn("rank", rank).filter(F.col("rank") <= k).drop("first")


def slot_histogram(decomposed: DataFrame, cluster: str, ordinal: str, k: int = 5) -> DataFrame:
    """(cluster, slot_pattern, n, rank): the k most common patterns of each cluster."""
    rows = decomposed.filter("slot_pattern <> ''").groupBy(cluster, "slot_pattern").agg(F.count("*").alias("n"), F.min(ordinal).alias("first"))
    rank = F.row_number().over(Window.partitionBy(cluster).orderBy(F.desc("n"), "first"))
    return rows.withColumn("rank", rank).filter(F.col("rank") <= k).drop("first")


def decomposition_rate(decomposed: DataFrame, cluster: str) -> DataFrame:
    """(cluster, n, rate): names with a pattern, over all (at least 1)."""
    return decomposed.groupBy(cluster).agg(F.count("*").alias("n"), (F.count_if(F.col("slot_pattern") != "") / F.greatest(F.count("*"), F.lit(1))).alias("rate"))


def global_patterns(histogram: DataFrame, k: int = 15) -> DataFrame:
    """(slot_pattern, n): sums over the clusters' own top lists only, the k largest."""
    return histogram.groupBy("slot_pattern").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "slot_pattern").limit(k)


def global_rates(rates: DataFrame, cluster: str, least: float = 0.3) -> DataFrame:
    """(decomposed, names, rate, productive): truncated counts of each cluster summed, and the
    clusters of rate `least` or more, most productive first."""
    whole = (F.col("rate") * F.col("n")).cast("long")
    some = F.array_sort(F.collect_list(F.when(F.col("rate") >= least, F.struct((-F.col("rate")).alias("r"), F.col(cluster).alias("c")))))
    out = rates.agg(F.sum(whole).alias("decomposed"), F.sum("n").alias("names"), some.alias("s"))
    return out.select("decomposed", "names", (F.col("decomposed") / F.greatest("names", F.lit(1))).alias("rate"), F.transform("s", lambda x: x["c"]).alias("productive"))


def describe(names: int | Column, suffixes: Column, categories: Column) -> Column:
    """One line on a cluster's names: the dominant suffix (15 % or more) and further categories
    (20 % or more) that are not its own; suffixes, categories: arrays of (value, n), largest first."""
    size = F.greatest(names if isinstance(names, Column) else F.lit(names), F.lit(1))
    percent = lambda x: F.format_string("%.0f", F.bround(x["n"] * 100.0 / size, 0))
    top = F.try_element_at(suffixes, F.lit(1))
    first = F.when(top["n"] / size >= 0.15, F.concat(F.lit("「"), top["value"], F.lit("」型 "), percent(top), F.lit("%")))
    more = F.transform(F.filter(categories, lambda x: (x["n"] / size >= 0.2) & (x["value"] != F.coalesce(top["value"], F.lit("")))), lambda x: F.concat(x["value"], F.lit(" "), percent(x), F.lit("%")))
    text = F.concat_ws("；", first, F.when(F.size(more) > 0, F.array_join(more, "；")))
    return F.when(text != "", text).otherwise("明確なパターンなし")


def parse_links(html: Column, pattern: str) -> Column:
    """Array of (name, count) from a page's links; pattern has two groups, name and count."""
    names, counts = (F.regexp_extract_all(html, F.lit(pattern), F.lit(i)) for i in (1, 2))
    rows = F.zip_with(names, counts, lambda n, c: F.struct(F.trim(n).alias("name"), F.try_to_number(c, F.lit("999999999999")).cast("long").alias("count")))
    kept = F.filter(rows, lambda x: (x["name"] != "") & (x["count"] > 0))
    # most records first, ties in page order
    return F.transform(F.array_sort(F.transform(kept, lambda x, i: F.struct((-x["count"]).alias("c"), i.alias("i"), x["name"].alias("name")))), lambda x: F.struct(x["name"].alias("name"), (-x["c"]).alias("count")))


def best_of_cluster(names: DataFrame, lookups: DataFrame, cluster: str, ordinal: str) -> DataFrame:
    """(cluster, search_name, records, variants, score): the name with most records in the index
    (the first of equals), and as the cluster's score that name's variants. names: cluster,
    ordinal, search_name; lookups: search_name, records, variants."""
    joined = names.join(lookups, "search_name", "left").filter(F.length("search_name") >= 2)
    best = F.max_by(F.struct("search_name", "records", "variants"), F.struct(F.coalesce("records", F.lit(0)).alias("r"), (-F.col(ordinal)).alias("o"))).alias("b")
    return joined.groupBy(cluster).agg(best).select(cluster, "b.*", F.coalesce("b.variants", F.lit(0)).alias("score"))


def tier_counts(scores: DataFrame, col: str = "score") -> DataFrame:
    c = F.col(col)
    return scores.agg(F.count_if(c >= 10).alias("high"), F.count_if((c >= 3) & (c < 10)).alias("middle"), F.count_if((c >= 1) & (c < 3)).alias("low"), F.count_if(c == 0).alias("none"))


def lookup_misses(names: DataFrame, cache: DataFrame, key: str = "search_name") -> DataFrame:
    """The distinct names that the cache does not hold, cached errors counting as held."""
    return names.select(key).distinct().join(cache.select(key), key, "left_anti")


def cached_lookups(names: DataFrame, path: str, fetch: Callable[[str], tuple[int, int]], key: str = "search_name", flush_every: int = 10) -> DataFrame:
    """(search_name, records, variants, error) of every distinct name, from a cache table at path
    and, for names it does not hold, from fetch(name) -> (records, variants). An error is cached
    like a result, so a name is asked for once. Every `flush_every` names are one append to the
    cache: an interrupted run goes on from the last. Null names are not looked up."""
    spark = names.sparkSession
    schema = "search_name string, records long, variants long, error string"
    held = spark.read.schema(schema).parquet(path) if exists(spark, path) else spark.createDataFrame([], schema)
    wanted = names.select(F.col(key).alias("search_name")).filter("search_name IS NOT NULL").distinct()

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for name in pdf["search_name"]:
                try:
                    records, variants = fetch(name)
                    rows.append((name, int(records), int(variants), None))
                except Exception as e:
                    rows.append((name, 0, 0, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=["search_name", "records", "variants", "error"])

    misses = lookup_misses(wanted, held, "search_name")
    parts = -(-misses.count() // flush_every)
    for part in range(parts):
        own = misses if parts == 1 else misses.filter(F.pmod(F.xxhash64("search_name"), F.lit(parts)) == part)
        own.mapInPandas(ask, schema).write.mode("append").parquet(path)
    now = spark.read.schema(schema).parquet(path) if parts else held
    return wanted.join(now, "search_name")
