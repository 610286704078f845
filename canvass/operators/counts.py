"""Counts over the catalogue: facets, sources, totals."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from canvass import config as C
from canvass.operators.facets import facet_values

COUNTABLE = [f for f in C.FACETS if f["kind"] in ("list", "scalar")]


def facet_pairs(records: DataFrame, facets=None, keep=()) -> DataFrame:
    """(facet, value) of every occurrence, all facets in one pass."""
    facets = facets or COUNTABLE
    per_facet = F.array(*[F.struct(F.lit(f["key"]).alias("facet"), facet_values(f).alias("held")) for f in facets])
    pairs = records.select(*keep, F.inline(per_facet)).select(*keep, "facet", F.explode("held").alias("value"))
    return pairs.where((F.col("value") != "") & F.col("value").isNotNull())


def facet_counts(records: DataFrame, facets=None) -> DataFrame:
    """Occurrences per facet value: one explode, one map-side combined shuffle."""
    return facet_pairs(records, facets).groupBy("facet", "value").agg(F.count(F.lit(1)).alias("n"))


def facet_counts_split(records: DataFrame, is_core, facets=None) -> DataFrame:
    """All and core counts of every value in the same pass."""
    return (
        facet_pairs(records.withColumn("_core", is_core), facets, keep=("_core",))
        .groupBy("facet", "value")
        .agg(F.count(F.lit(1)).alias("n"), F.count_if("_core").alias("n_core"))
    )


def facet_order(counts: DataFrame) -> DataFrame:
    """Most common first, then by value."""
    return counts.orderBy("facet", F.desc("n"), "value")


def facet_range_bounds(records: DataFrame, column: str) -> DataFrame:
    return records.agg(F.min(column).alias("low"), F.max(column).alias("high"))


def facet_groups(counts: DataFrame) -> DataFrame:
    """Area values split into faculty-wide and specific ones."""
    wide = F.col("value").contains(C.FACULTY_WIDE_SUFFIX) | (F.col("value") == C.OPEN_TO_ALL_AREA)
    return counts.where(F.col("facet") == "areas_of_study").select(
        F.when(wide, F.lit("Faculty-wide")).otherwise(F.lit("Specific programs")).alias("group_name"), "value", "n")


def facet_unique_values(records: DataFrame, key: str) -> DataFrame:
    facet = next(f for f in COUNTABLE if f["key"] == key)
    return facet_pairs(records, [facet]).select("value").distinct()


def active_facets(records: DataFrame, facets=None) -> DataFrame:
    """Facets that have any value: one aggregate over the table, then unpivoted."""
    facets = facets or C.FACETS
    aggs = []
    for f in facets:
        if f["kind"] in ("range", "bool"):
            present = F.col(f["key"]).isNotNull()
        else:
            present = F.exists(facet_values(f), lambda v: v.isNotNull() & (v != ""))
        aggs.append(F.count_if(present).alias(f["key"]))
    one = records.agg(*aggs)
    stacked = one.unpivot([], [f["key"] for f in facets], "facet", "n_stated")
    return stacked.withColumn("active", F.col("n_stated") > 0)


def source_health(table: DataFrame) -> DataFrame:
    return table.groupBy("source_id").agg(
        F.count(F.lit(1)).alias("total"),
        F.count("scraped_at").alias("scraped"),
        F.count("scrape_error").alias("errors"),
    )


def corpus_totals(health: DataFrame) -> DataFrame:
    return health.agg(*[F.sum(c).alias(c) for c in ("total", "scraped", "errors")])


def duplicate_keys(df: DataFrame, key: str = "award_uid", show: int = 10) -> DataFrame:
    """Keys seen more than once; the report shows the first few."""
    return (
        df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1").orderBy(key).limit(show)
    )


def overlap_total(rows: DataFrame, key: str) -> DataFrame:
    """Rows captured over all searches against the distinct records among them."""
    per_key = rows.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    return per_key.agg(F.sum("n").alias("captured"), F.count(F.lit(1)).alias("distinct_records"))


def adapter_run_stats(records: DataFrame) -> DataFrame:
    return records.groupBy("source_id").agg(
        F.count(F.lit(1)).alias("records"), F.count_if(F.col("detail_error").isNotNull()).alias("detail_errors"))


def name_counts(rows: DataFrame, name: str = "award_name") -> DataFrame:
    """Names used more than once."""
    return rows.groupBy(name).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def split_depth(rows: DataFrame, dims: list, cap: int = C.ROW_CAP) -> DataFrame:
    """Coarsest groups that stay under the row cap.

    A group is kept when its size is within the cap and its parent's is not; at
    the deepest level also groups still over it are kept, flagged incomplete.
    ``dims`` is a list of column lists, coarse to fine.  Sizes are rolled up from
    the finest counts, so the rows are shuffled once, combined map-side.
    """
    flat = [c for level in dims for c in level]
    current = rows.groupBy(*flat).agg(F.count(F.lit(1)).alias("n"))
    levels = [current]
    for depth in range(len(dims) - 1, 0, -1):
        keys = [c for level in dims[:depth] for c in level]
        current = current.groupBy(*keys).agg(F.sum("n").alias("n"))
        levels.insert(0, current)
    out = None
    for depth, level in enumerate(levels):
        keys = [c for lv in dims[: depth + 1] for c in lv]
        last = depth == len(levels) - 1
        kept = level if last else level.where(F.col("n") <= cap)
        if depth > 0:
            parents = [c for lv in dims[:depth] for c in lv]
            over = levels[depth - 1].where(F.col("n") > cap).select(*parents)
            match = [kept[p].eqNullSafe(over[p]) for p in parents]
            kept = kept.join(over, match, "left_semi")
        kept = kept.select(
            F.lit(depth + 1).alias("depth"),
            *[F.col(c) if c in keys else F.lit(None).cast("string").alias(c) for c in flat],
            F.col("n"), (F.col("n") > cap).alias("incomplete"))
        out = kept if out is None else out.unionByName(kept)
    return out
