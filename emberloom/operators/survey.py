"""Survey statistics: counts, crosstabs with margins, shifts, multi-select answers, status."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import label_of


def value_counts(df: DataFrame, col: str, k: int | None = None) -> DataFrame:
    """(value, n), most frequent first, nulls dropped."""
    out = df.filter(F.col(col).isNotNull()).groupBy(F.col(col).alias("value")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "value")
    return out if k is None else out.limit(k)


def crosstab(df: DataFrame, pre: str, post: str, total: str = "All") -> DataFrame:
    """(pre, post, n) of both answers given, with margins under `total`, in long form."""
    cube = df.na.drop(subset=[pre, post]).cube(pre, post).agg(F.count("*").alias("n"), F.grouping(pre).alias("a"), F.grouping(post).alias("b"))
    return cube.select(F.when(F.col("a") == 1, total).otherwise(F.col(pre)).alias("pre"), F.when(F.col("b") == 1, total).otherwise(F.col(post)).alias("post"), "n")


def crosstab_wide(df: DataFrame, pre: str, post: str, values: list[str], total: str = "All") -> DataFrame:
    return crosstab(df, pre, post, total).groupBy("pre").pivot("post", [*values, total]).agg(F.first("n")).na.fill(0, [*values, total])


def shift_rate(df: DataFrame, pre: str, post: str, by: str | None = None) -> DataFrame:
    """(n, shifted, rate): answers that changed, in percent with one decimal; null without answers.
    by: for each group, with the first ordinal of the group where df has `ordinal`."""
    rows = df.na.drop(subset=[pre, post, *([by] if by else [])])
    moved = F.sum((F.col(pre) != F.col(post)).cast("long"))
    aggs = [F.count("*").alias("n"), F.coalesce(moved, F.lit(0)).alias("shifted"), F.round(moved * 100.0 / F.count("*"), 1).alias("rate")]
    if not by:
        return rows.agg(*aggs)
    first = [F.min("ordinal").alias("first_ordinal")] if "ordinal" in df.columns else []
    return rows.groupBy(by).agg(*aggs, *first)


def multi_select_counts(df: DataFrame, col: str, labels: dict[str, str], default: str = "?") -> DataFrame:
    """(option, label, n): rows that chose each option of an array column."""
    rows = df.select(F.explode(col).alias("option")).filter("option IS NOT NULL")
    return rows.groupBy("option").agg(F.count("*").alias("n")).select("option", label_of(F.col("option"), labels, default).alias("label"), "n")


def completed(df: DataFrame, flag: str = "post_completed") -> DataFrame:
    return df.filter(F.col(flag) == F.lit(True))


def before_after(df: DataFrame, keep: Column) -> DataFrame:
    """(before, after): rows in all and rows that pass the filter, in one scan."""
    return df.agg(F.count("*").alias("before"), F.count_if(F.coalesce(keep, F.lit(False))).alias("after"))


def funnel(df: DataFrame, stages: dict[str, Column], time_col: str, id_col: str, latest: int = 200) -> DataFrame:
    """total and the count of each stage, over the latest rows only."""
    rows = df.orderBy(F.desc(time_col), F.desc(id_col)).limit(latest)
    return rows.agg(F.count("*").alias("total"), *[F.count_if(F.coalesce(c, F.lit(False))).alias(n) for n, c in stages.items()])


def status(printed: Column, triggered: Column, named: Column) -> Column:
    yes = lambda c: F.coalesce(c, F.lit(False))
    return F.when(yes(printed), "printed").when(yes(triggered), "triggered").when(yes(named), "named").otherwise("waiting")


def named(df: DataFrame, name_col: str) -> DataFrame:
    """Rows that have been given a name."""
    return df.filter(F.col(name_col).isNotNull())


def pending_print(triggered: Column, printed: Column) -> Column:
    return F.coalesce(triggered, F.lit(False)) & ~F.coalesce(printed, F.lit(False))


def qualitative_pairs(df: DataFrame, id_col: str, before: str, after: str) -> DataFrame:
    return df.select(id_col, before, after).na.drop()


def quality_flags(df: DataFrame, required: list[str], multi: str, most: int = 2) -> DataFrame:
    """df with missing (names of required fields not given) and too_many (of a multi-select)."""
    blank = lambda c: F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))) == ""
    missing = F.filter(F.array(*[F.when(blank(c), F.lit(c)) for c in required]), lambda x: x.isNotNull())
    return df.withColumn("missing", missing).withColumn("too_many", F.coalesce(F.size(multi) > most, F.lit(False)))


def toggle(selected: Column, option: Column, most: int = 2) -> Column:
    """The selection after a click: the option is taken out if in, put in if there is room."""
    return F.when(F.array_contains(selected, option), F.array_remove(selected, option)).when(F.size(selected) < most, F.array_append(selected, option)).otherwise(selected)
