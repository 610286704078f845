"""Joins against the registry, the vocabulary and request tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from canvass import config as C
from canvass.functions.fields import host_of
from canvass.functions.text import as_col
from canvass.operators.eligibility import merge_defaults
from canvass.operators.ranking import numbered

def unknown_sources(table: DataFrame, registry: DataFrame) -> DataFrame:
    """Source ids with rows but without a registry entry."""
    return table.select("source_id").distinct().join(registry, "source_id", "left_anti")


def missing_sources(table: DataFrame, registry: DataFrame) -> DataFrame:
    """Active sources without any row."""
    active = registry.where(F.col("status") == "active").select("source_id")
    return active.join(table.select("source_id").distinct(), "source_id", "left_anti")


def blocked_with_rows(health: DataFrame, registry: DataFrame) -> DataFrame:
    blocked = registry.where(F.col("status") == "blocked").select("source_id")
    return health.join(blocked, "source_id").select("source_id", "total")


def registry_enrich(records: DataFrame, registry: DataFrame) -> DataFrame:
    """Attach url, delivery and defaults of the source."""
    picked = registry.select("source_id", F.col("source_url").alias("registry_url"), "delivery", "defaults")
    return records.join(picked, "source_id", "left")


def defaults_under_record(records: DataFrame, registry: DataFrame) -> DataFrame:
    """Eligibility with the source's defaults merged under it."""
    joined = records.join(registry.select("source_id", "defaults"), "source_id", "left")
    return joined.withColumn("eligibility", merge_defaults("eligibility", "defaults")).drop("defaults")


GRAM = 3


def grams(value: Column) -> Column:
    """All runs of up to three characters of a lower-cased text."""
    low = F.lower(value)
    places = F.sequence(F.lit(1), F.greatest(F.length(low), F.lit(1)))
    runs = F.flatten(F.transform(F.array(*[F.lit(n) for n in range(1, GRAM + 1)]), lambda n: F.transform(
        F.filter(places, lambda i: i + n - 1 <= F.length(low)), lambda i: low.substr(i, n))))
    return F.array_distinct(runs)


def longest_grams(value: Column) -> Column:
    """Those runs of a text that are as long as any: a text that contains it has them all."""
    size = F.least(F.length(value), F.lit(GRAM))
    return F.filter(grams(value), lambda g: F.length(g) == size)


def vocab_unknown(requests: DataFrame, counts: DataFrame) -> DataFrame:
    """Requested values the catalogue lacks, each with up to two near ones.

    requests: (facet, value).  Near values contain the request.  They are found by an
    equi-join on a run of characters, the one that fewest values of the facet hold;
    an empty request is near to the most frequent values.
    """
    asked = requests.distinct()
    missing = asked.join(counts.select("facet", "value"), ["facet", "value"], "left_anti")
    runs = counts.select("facet", F.col("value").alias("known"), "n", F.explode(grams(F.col("value"))).alias("gram"))
    spread = runs.groupBy("facet", "gram").agg(F.count(F.lit(1)).alias("_held"))
    wanted = missing.where("value <> ''").select("facet", "value", F.explode(longest_grams(F.col("value"))).alias("gram"))
    rarest = wanted.join(spread, ["facet", "gram"], "left").groupBy("facet", "value").agg(
        F.min(F.struct(F.coalesce("_held", F.lit(0)), "gram")).alias("_g")).select("facet", "value", F.col("_g.gram").alias("gram"))
    found = rarest.join(runs, ["facet", "gram"]).where(F.contains(F.lower("known"), F.lower("value"))).select(
        "facet", "value", "known", "n")
    top = F.row_number().over(Window.partitionBy("facet").orderBy(F.desc("n"), "value"))
    most = counts.withColumn("_nth", top).where("_nth <= 2").select("facet", F.col("value").alias("known"), "n")
    found = found.unionByName(missing.where("value = ''").join(most, "facet").select("facet", "value", "known", "n"))
    nth = F.row_number().over(Window.partitionBy("facet", "value").orderBy(F.desc("n"), "known"))
    two = found.withColumn("_nth", nth).where("_nth <= 2").groupBy("facet", "value").agg(
        F.array_sort(F.collect_list(F.struct("_nth", "known"))).alias("_two"))
    named = F.coalesce(F.array_join(F.col("_two.known"), ", "), F.lit(""))
    return missing.join(two, ["facet", "value"], "left").select("facet", "value", named.alias("near"))


def detail_lookup(ids: DataFrame, records: DataFrame) -> DataFrame:
    """(id) -> found / ambiguous / not found.

    A uid hit wins; else the bare id, which may name records of several
    sources.  Candidates of an ambiguous id come as rows, never as one list.
    """
    keyed = records.select("award_uid", "award_id")
    asked = ids.select("id").distinct()
    by_uid = asked.join(keyed, asked.id == keyed.award_uid).select("id", "award_uid")
    rest = asked.join(by_uid.select("id"), "id", "left_anti")
    by_id = rest.join(keyed, rest.id == keyed.award_id, "left").select("id", "award_uid")
    counted = by_id.groupBy("id").agg(F.count("award_uid").alias("n"))
    bare = by_id.join(counted, "id").select(
        "id", "award_uid",
        F.when(F.col("n") == 0, "not found").when(F.col("n") == 1, "found").otherwise("ambiguous").alias("status"))
    return by_uid.select("id", "award_uid", F.lit("found").alias("status")).unionByName(bare)


def permalink_lookup(ids: DataFrame, records: DataFrame) -> DataFrame:
    """(id) -> one uid: exact uid first, else the first record with that bare id."""
    keyed = records.select("award_uid", "award_id")
    asked = ids.select("id").distinct()
    by_uid = asked.join(keyed, asked.id == keyed.award_uid).select("id", "award_uid")
    rest = asked.join(by_uid.select("id"), "id", "left_anti")
    wanted = keyed.join(rest, keyed.award_id == rest.id, "left_semi")
    first = wanted.groupBy("award_id").agg(F.min("award_uid").alias("first_uid"))
    bare = rest.join(first, rest.id == first.award_id, "left").select("id", F.col("first_uid").alias("award_uid"))
    return by_uid.unionByName(bare)


def golden_keep_labels(sample: DataFrame, existing: DataFrame) -> DataFrame:
    """Re-sampling never touches finished work.

    Both: award_uid, sampled_for, labelled, labels.  Labelled entries stay
    verbatim, also when no longer sampled; the rest comes from the sample.
    """
    done = existing.where("labelled")
    fresh = sample.join(done.select("award_uid"), "award_uid", "left_anti").withColumn("kept", F.lit(False))
    return done.withColumn("kept", F.lit(True)).unionByName(fresh)


def crawl_policy_gate(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """Is each url allowed by the rules of its host?

    rules: host, rule_no, prefix, allow, readable.  The first rule whose prefix
    matches the path decides; no rules allow; unreadable rules deny.  A path is cut
    to the lengths that its host's prefixes have, and the cuts meet the rules in an
    equi-join, so a host may have any number of rules.
    """
    path = F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^#]*)", 1)
    there = urls.select("url").withColumn("host", host_of("url"))
    each = there.distinct().withColumn("path", F.when(path == "", F.lit("/")).otherwise(path))
    lengths = rules.select("host", F.length("prefix").alias("n")).distinct()
    cuts = each.join(lengths, "host").where("n <= length(path)").select(
        "url", "host", F.expr("substring(path, 1, n)").alias("prefix"))
    first = cuts.join(rules.select("host", "prefix", "rule_no", "allow"), ["host", "prefix"]).groupBy("url").agg(
        F.min(F.struct("rule_no", "prefix", "allow")).alias("first"))
    readable = rules.groupBy("host").agg(F.min("readable").alias("readable"))
    joined = there.join(readable, "host", "left").join(first, "url", "left")
    allowed = F.when(F.col("readable") == F.lit(False), F.lit(False)).otherwise(F.coalesce("first.allow", F.lit(True)))
    return joined.select("url", "host", allowed.alias("allowed"))


def load_corpus(core: DataFrame, shards: DataFrame, registry: DataFrame) -> DataFrame:
    """Core records plus the shards of active sources, one record per uid.

    The core copy wins.  Among shard copies the smallest content wins, so the
    choice does not depend on partitioning.
    """
    active = registry.where(F.col("status") == "active").select("source_id")
    extra = shards.join(active, "source_id", "left_semi")
    both = core.withColumn("_origin", F.lit(0)).unionByName(extra.withColumn("_origin", F.lit(1)))
    return first_per(both, ["award_uid"], F.col("_origin")).drop("_origin")


def first_per(df: DataFrame, keys: list, order: Column) -> DataFrame:
    """One row per key, smallest ``order`` first; an aggregate, so combined map-side."""
    rest = [c for c in df.columns if c not in keys]
    tie = F.xxhash64(*[f.name for f in df.schema if f.name not in keys and "map" not in f.dataType.simpleString()])
    best = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(order, tie)).alias("_r"))
    return best.select(*keys, "_r.*").select(*df.columns)


def nocase_order(records: DataFrame) -> DataFrame:
    """Every record with its place by name without regard to case, then uid."""
    keyed = records.withColumn("_low", F.lower("award_name"))
    return numbered(keyed, [], [F.col("_low"), F.col("award_uid")], "pos").drop("_low")


def merge_shard(have: DataFrame, incoming: DataFrame) -> DataFrame:
    """Add records not yet known; copies inside the batch count once."""
    fresh = incoming.where(F.col("award_uid").isNotNull()).join(have.select("award_uid"), "award_uid", "left_anti")
    once = first_per(fresh.select(*incoming.columns), ["award_uid"], F.lit(0))
    return have.withColumn("added", F.lit(False)).unionByName(once.withColumn("added", F.lit(True)))


def profiles_for_queries(queries: DataFrame, profiles: DataFrame) -> DataFrame:
    """Requests with their profile; without one the request stands alone."""
    return queries.join(profiles, "profile_id", "left")


def residency_union(tags: DataFrame, key: str, order: str, region: str = "region") -> DataFrame:
    """Regions over several pages, unioned, never intersected, in the order they first appear.

    Each region is reduced to its first place beforehand, so a key's list is as long as
    its distinct regions.
    """
    first = tags.where(F.col(region).isNotNull()).groupBy(key, region).agg(F.min(order).alias("_at"))
    listed = F.array_sort(F.collect_list(F.struct("_at", F.col(region).alias("r"))))
    return first.groupBy(key).agg(F.transform(listed, lambda x: x["r"]).alias("regions"))
