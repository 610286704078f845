"""Ids and ranks inside groups that may be very large."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from canvass.functions.text import slugify
from canvass.session import cut_lineage

def numbered(df: DataFrame, keys: list, order: list, name: str = "rn", weight: Column | None = None) -> DataFrame:
    """row_number within groups, or the running sum of ``weight``, also when one group holds much of the table.

    Rows are range partitioned on key and order, numbered per partition, and shifted
    by the sizes of the partitions before; no task holds a whole group.  Without keys
    the table is one group.
    """
    ranged = df.repartitionByRange(*[F.col(k) for k in keys], *order).withColumn("_pid", F.spark_partition_id())
    ranged = cut_lineage(ranged)
    local = Window.partitionBy("_pid", *keys).orderBy(*order)
    sizes = ranged.groupBy("_pid", *keys).agg((F.count(F.lit(1)) if weight is None else F.sum(weight)).alias("_n"))
    # a group has at most one row per partition here
    before = Window.partitionBy(*(keys or [F.lit(0)])).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    running = F.row_number().over(local) if weight is None else F.sum(weight).over(
        local.rowsBetween(Window.unboundedPreceding, 0))
    numbered_ = ranged.withColumn("_rn", running)
    match = [numbered_["_pid"] == offsets["_pid"]] + [numbered_[k].eqNullSafe(offsets[k]) for k in keys]
    joined = numbered_.join(offsets, match)
    return joined.select(*[numbered_[c] for c in df.columns], (F.col("_rn") + F.col("_before")).cast("long").alias(name))


def stable_native_id(rows: DataFrame, name: str = "award_name", text: str = "award_description",
                     tie: str = "award_uid") -> DataFrame:
    """Slug of the name; copies of a slug are told apart by their description.

    Position on the page plays no part: the first by description keeps the bare
    slug, the rest get -2, -3, ...
    """
    keyed = rows.withColumn("slug", slugify(name)).withColumn("_text", F.coalesce(text, F.lit("")))
    ranked = numbered(keyed, ["slug"], [F.col("_text"), F.col(tie)], "rn")
    stable = F.when(F.col("rn") == 1, F.col("slug")).otherwise(F.concat_ws("-", "slug", F.col("rn").cast("string")))
    return ranked.withColumn("stable_id", stable).drop("_text")


def collision_suffix(cards: DataFrame, title: str, position: str) -> DataFrame:
    """A slug already seen earlier in the listing gets its position appended."""
    keyed = cards.withColumn("slug", slugify(title))
    first = keyed.groupBy("slug").agg(F.min(position).alias("_first"))
    joined = keyed.join(first, "slug")
    return joined.withColumn(
        "card_id",
        F.when(F.col(position) == F.col("_first"), F.col("slug")).otherwise(
            F.concat_ws("-", "slug", F.col(position).cast("string")))).drop("_first")
