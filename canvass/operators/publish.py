"""Gates, published datasets, vocabulary and manifest."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from canvass import config as C
from canvass.operators import counts, lookups
from canvass.operators.record import slim_projection
from canvass.session import shared_folder


class PublishRefused(RuntimeError):
    """A gate failed; nothing was replaced."""


def publish_gate(table: DataFrame, registry: DataFrame) -> DataFrame:
    """Every failure as a row (source_id, problem, total, scraped); no rows means publish."""
    health = counts.source_health(table)
    both = health.join(registry.withColumn("_known", F.lit(True)), "source_id", "full_outer")
    active, total = F.col("status") == "active", F.coalesce("total", F.lit(0))
    share = F.col("scraped") / F.col("total")
    floor = F.coalesce("min_scraped_fraction", F.lit(C.DEFAULT_MIN_SCRAPED))
    problems = F.array_compact(F.array(
        F.when(F.col("_known").isNull(), F.lit("unknown source")),
        F.when(active & (total == 0), F.lit("no rows")),
        F.when(active & (total > 0) & (total < F.col("min_awards")), F.lit("below floor")),
        F.when(active & (total > 0) & (share < floor), F.lit("too few scraped")),
        F.when((F.col("status") == "blocked") & (total > 0), F.lit("blocked with rows")),
    ))
    return both.select(
        "source_id", F.explode(problems).alias("problem"), total.alias("total"),
        F.coalesce("scraped", F.lit(0)).alias("scraped"))


def run_floor_gate(runs: DataFrame, registry: DataFrame) -> DataFrame:
    """Full runs that returned fewer records than the source's floor."""
    return runs.join(registry.select("source_id", "min_awards"), "source_id").where(
        ~F.col("limited") & (F.col("records") < F.col("min_awards"))).select("source_id", "records", "min_awards")


def uid_gate(records: DataFrame, is_core) -> DataFrame:
    """Counts behind the final checks, in one row."""
    per_uid = records.withColumn("_core", is_core).groupBy("award_uid").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("_core").alias("n_core"))
    missing = F.col("award_uid").isNull() | (F.col("award_uid") == "")
    one = per_uid.agg(
        F.sum("n").alias("records"),
        F.sum(F.when(missing, F.col("n")).otherwise(0)).alias("missing_uid"),
        F.count_if((F.col("n") > 1) & ~missing).alias("duplicated_uid"),
        F.sum("n_core").alias("core_records"))
    return one.withColumn("ok", (F.col("missing_uid") == 0) & (F.col("duplicated_uid") == 0) & (F.col("core_records") > 0))


def vocab_gate(facet_counts: DataFrame, required=None, limit: int = C.MAX_VOCAB_VALUES) -> DataFrame:
    """Facets that are empty or too large to serve as a vocabulary."""
    required = required or list(C.VOCAB_FACETS)
    tally = facet_counts.where(F.col("facet").isin(required)).groupBy("facet").agg(F.count(F.lit(1)).alias("n"))
    wanted = facet_counts.sparkSession.createDataFrame([(f,) for f in required], "facet string")
    found = wanted.join(tally, "facet", "left").withColumn("n_values", F.coalesce("n", F.lit(0)))
    return found.select(
        "facet", "n_values",
        F.when(F.col("n_values") == 0, "missing or empty").when(F.col("n_values") > limit, "too many values")
        .alias("problem")).where(F.col("problem").isNotNull())


def vocab_extract(split_counts: DataFrame) -> DataFrame:
    """(filter_key, value) from the core counts; without any core value, from all."""
    keys = F.element_at(F.create_map(*[F.lit(x) for kv in C.VOCAB_FACETS.items() for x in kv]), F.col("facet"))
    vocabulary = split_counts.where(F.col("facet").isin(list(C.VOCAB_FACETS)))
    any_core = F.coalesce(vocabulary.agg(F.max(F.col("n_core") > 0).alias("any")).scalar(), F.lit(False))
    chosen = vocabulary.where(~any_core | (F.col("n_core") > 0))
    return chosen.select(keys.alias("filter_key"), "value")


def vocab_version(vocabulary: DataFrame) -> DataFrame:
    """Short hash of the values alone, so counts do not move it.

    Values are few (the gate bounds them), so one row holds the canonical text.
    """
    per_key = vocabulary.groupBy("filter_key").agg(
        F.concat_ws(",", F.sort_array(F.collect_set("value"))).alias("text"))
    whole = per_key.agg(F.sort_array(F.collect_list(F.concat_ws(":", "filter_key", "text"))).alias("parts"))
    return whole.select(F.substring(F.sha2(F.concat_ws("|", "parts"), 256), 1, 12).alias("version"))


def publish_meta(table: DataFrame, registry: DataFrame) -> DataFrame:
    """Totals per source with its public address."""
    health = counts.source_health(table)
    return health.join(registry.select("source_id", "source_url"), "source_id", "left")


def publish_manifest(split_counts: DataFrame, meta: DataFrame, registry: DataFrame, lead: str = C.MANIFEST_LEAD) -> DataFrame:
    """The manifest in long form: (section, key, value, n)."""
    none = F.lit(None)
    all_facets = split_counts.select(
        F.lit("facets").alias("section"), F.col("facet").alias("key"), "value", "n")
    core_facets = split_counts.where("n_core > 0").select(
        F.lit("core_facets").alias("section"), F.col("facet").alias("key"), "value", F.col("n_core").alias("n"))
    sources = meta.select(
        F.lit("sources").alias("section"), F.col("source_id").alias("key"), F.col("source_url").alias("value"),
        F.col("total").alias("n"))
    total = meta.agg(F.sum("total").alias("n")).select(
        F.lit("total_awards").alias("section"), none.cast("string").alias("key"), none.cast("string").alias("value"), "n")
    texts = registry.where((F.col("status") == "active") & (F.coalesce("disclaimer", F.lit("")) != "")).agg(
        F.sort_array(F.collect_list(F.struct("source_id", F.trim("disclaimer").alias("d")))).alias("t"))
    disclaimer = texts.select(
        F.lit("disclaimer").alias("section"), none.cast("string").alias("key"),
        F.trim(F.concat(F.lit(lead + " "), F.array_join(F.transform("t", lambda x: x["d"]), " "))).alias("value"),
        none.cast("long").alias("n"))
    places = meta.sparkSession.createDataFrame(list(C.ENDPOINTS.items()), "key string, value string").select(
        F.lit("endpoints").alias("section"), "key", "value", none.cast("long").alias("n"))
    sharded = registry.where((F.col("status") == "active") & (F.col("delivery") == "shard")).select("source_id")
    shards = meta.join(sharded, "source_id").select(
        F.lit("shards").alias("section"), F.col("source_id").alias("key"),
        F.concat(F.lit(C.SHARD_PATH), "source_id").alias("value"), F.col("total").alias("n"))
    version = F.lit(2).cast("long")
    head = meta.sparkSession.range(1).select(
        F.lit("schema_version").alias("section"), none.cast("string").alias("key"), none.cast("string").alias("value"),
        version.alias("n"))
    head = head.unionByName(places).unionByName(shards)
    return head.unionByName(total).unionByName(sources).unionByName(disclaimer).unionByName(all_facets).unionByName(
        core_facets)


def stale_shards(published: DataFrame, records: DataFrame) -> DataFrame:
    """Published shard ids without any record now."""
    return published.join(records.select("source_id").distinct(), "source_id", "left_anti")


def write_core_and_shards(records: DataFrame, registry: DataFrame, path: str) -> str:
    """One dataset split by delivery and source; readers prune on both."""
    delivery = registry.where(F.col("status") == "active").select("source_id", "delivery")
    split = records.join(delivery, "source_id", "left").withColumn(
        "delivery", F.when(F.col("delivery") == "core", "core").otherwise("shard"))
    # rebalancing lets adaptive execution cut a hot source into many tasks and join small ones
    split.hint("rebalance", "delivery", "source_id").write.mode("overwrite").partitionBy("delivery", "source_id").parquet(path)
    return path


def _fs(spark, path: str):
    jvm = spark.sparkContext._jvm
    hadoop_path = jvm.org.apache.hadoop.fs.Path(path)
    return hadoop_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path


def staged_publish(outputs: dict, gates: list, root: str, version: str) -> str:
    """Write every output under a new version, check the gates, then move the pointer.

    ``outputs`` maps a name to a frame, or to a function that makes it from the output written
    just before, which then need not be worked out again.  ``gates`` are frames that must be empty.
    If one is not, the pointer stays on the last good version, and the failures are all
    written below ``refused``.
    """
    spark = next(iter(outputs.values())).sparkSession
    refused = []
    for nth, gate in enumerate(gates):
        folder = f"{root}/refused/{version}/{nth}"
        gate.write.mode("overwrite").parquet(folder)
        failed = spark.read.parquet(folder).count()
        if failed:
            refused.append(f"{failed} in {folder}")
    if refused:
        raise PublishRefused("; ".join(refused))
    base = f"{root}/versions/{version}"
    written = None
    for name, frame in outputs.items():
        (frame(written) if callable(frame) else frame).write.mode("errorifexists").parquet(f"{base}/{name}")
        written = spark.read.parquet(f"{base}/{name}")
    point_to(spark, root, version)
    return base


def point_to(spark, root: str, version: str) -> None:
    """Swap the pointer file by an overwriting rename: readers see the old or the new version."""
    fs, Path = _fs(spark, root)
    temp, final = Path(f"{root}/CURRENT.{version}"), Path(f"{root}/CURRENT")
    out = fs.create(temp, True)
    out.write(bytearray(version.encode()))
    out.close()
    sc = spark.sparkContext
    context = sc._jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), sc._jsc.hadoopConfiguration())
    rename = getattr(sc._jvm.org.apache.hadoop.fs, "Options$Rename")
    options = sc._gateway.new_array(rename, 1)
    options[0] = rename.OVERWRITE
    context.rename(fs.makeQualified(temp), fs.makeQualified(final), options)


def current_version(spark, root: str) -> str | None:
    fs, Path = _fs(spark, root)
    final = Path(f"{root}/CURRENT")
    if not fs.exists(final):
        return None
    return spark.read.text(f"{root}/CURRENT").first()[0]


def published(spark, root: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{root}/versions/{current_version(spark, root)}/{name}")


def staging_root(spark) -> str:
    return shared_folder(spark, "publish")


def slim_and_full(records: DataFrame) -> dict:
    return {"full": records, "slim": slim_projection}


