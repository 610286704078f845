"""Stratified samples for labelling, and audits of the labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from canvass import config as C
from canvass.functions.once import with_once
from canvass.functions.text import as_col

TOTAL_QUOTA = sum(q for _, q, _ in C.SAMPLE_PROBES)


def probe_hits(text, probes=None) -> Column:
    """Names of the concepts a text mentions."""
    text = F.coalesce(as_col(text), F.lit(""))
    tests = []
    for concept, *_, pattern in probes or C.SAMPLE_PROBES:
        hit = F.trim(text) != "" if pattern is None else text.rlike("(?i)" + pattern)
        tests.append(F.when(hit, F.lit(concept)))
    return F.array_compact(F.array(*tests))


def concept_rates(records: DataFrame, text: str, probes=None) -> DataFrame:
    """Share of records mentioning each concept: one aggregate, unpivoted."""
    probes = [p for p in (probes or C.SAMPLE_PROBES) if p[-1] is not None]
    body = F.col("_body")
    one = with_once(records, {"_body": F.coalesce(F.col(text), F.lit(""))}).agg(
        F.count(F.lit(1)).alias("n_records"),
        *[F.count_if(body.rlike("(?i)" + p[-1])).alias(p[0]) for p in probes])
    return one.unpivot(["n_records"], [p[0] for p in probes], "concept", "n_hits").withColumn(
        "rate", F.col("n_hits") / F.col("n_records"))


def draw_order(uid="award_uid", seed: int = C.SAMPLE_SEED) -> Column:
    """A reproducible shuffle: the hash of seed and key."""
    return F.md5(F.concat(F.lit(f"{seed}:"), as_col(uid)))


def stratified_sample(records: DataFrame, text: str, probes=None, seed: int = C.SAMPLE_SEED) -> DataFrame:
    """(concept, award_uid): quotas filled concept by concept, nobody drawn twice.

    Whatever earlier concepts take, a concept never needs more than the first
    ``sum of quotas`` of its own hits in draw order.  One pass keeps just those
    (ranks beyond are dropped map-side), and the taking in turn is resolved on
    that bounded remainder.
    """
    probes = probes or C.SAMPLE_PROBES
    bound = sum(q for _, q, _ in probes)
    read = with_once(records, {"_body": as_col(text)})
    hits = read.select("award_uid", F.explode(probe_hits("_body", probes)).alias("concept")).withColumn(
        "draw", draw_order("award_uid", seed))
    first = Window.partitionBy("concept").orderBy("draw", "award_uid")
    pool = hits.withColumn("rn", F.row_number().over(first)).where(F.col("rn") <= bound)
    per_concept = pool.groupBy("concept").agg(F.sort_array(F.collect_list(F.struct("draw", "award_uid"))).alias("pool"))
    row = per_concept.agg(F.map_from_entries(F.collect_list(F.struct("concept", "pool"))).alias("pools"))
    none = F.array().cast("array<string>")
    picked = row
    taken = none
    for concept, quota, _ in probes:
        uids = F.transform(F.coalesce(
            F.try_element_at("pools", F.lit(concept)), F.array().cast("array<struct<draw: string, award_uid: string>>")),
            lambda p: p["award_uid"])
        picked = picked.withColumn(f"c_{concept}", F.slice(F.array_except(uids, taken), 1, quota))
        picked = picked.withColumn("taken", F.concat(taken, F.col(f"c_{concept}")))
        taken = F.col("taken")
    named = lambda c: F.transform(
        f"c_{c}", lambda u: F.struct(F.lit(c).alias("concept"), u.alias("award_uid")))
    chosen = F.flatten(F.array(*[named(c) for c, _, _ in probes]))
    return picked.select(F.inline(chosen))


def sample_shortfall(sample: DataFrame, probes=None) -> DataFrame:
    """Concepts the catalogue could not fill."""
    probes = probes or C.SAMPLE_PROBES
    wanted = sample.sparkSession.createDataFrame([(c, q) for c, q, _ in probes], "concept string, quota long")
    got = sample.groupBy("concept").agg(F.count(F.lit(1)).alias("n"))
    return wanted.join(got, "concept", "left").select(
        "concept", "quota", F.coalesce("n", F.lit(0)).alias("drawn")).where(F.col("drawn") < F.col("quota"))


def label_audit(golden: DataFrame, text: str, labels: str, probes=None) -> DataFrame:
    """Labelled entries whose text names a constraint their labels lack.

    golden: award_uid, labelled, text, labels (array of labelled fields).  The
    few probes ride along as an array in the row; nothing is joined.
    """
    tests = []
    for field, pattern in probes or C.AUDIT_PROBES:
        at = F.regexp_instr(text, F.lit("(?i)" + pattern))
        tests.append(F.when(
            (at > 0) & ~F.coalesce(F.array_contains(labels, field), F.lit(False)),
            F.struct(F.lit(field).alias("field"), (at - 1).alias("at"))))
    found = golden.where("labelled").select("award_uid", text, F.inline(F.array_compact(F.array(*tests))))
    start = F.greatest(F.col("at") - C.AUDIT_BEFORE, F.lit(0))
    context = F.substr(F.col(text), start + 1, F.col("at") + C.AUDIT_AFTER - start)
    return found.select(
        "award_uid", "field", "at", F.trim(F.regexp_replace(context, r"\s+", " ")).alias("context"))


def label_progress(golden: DataFrame) -> DataFrame:
    """Labelled and total per concept, and the length of a ten-step bar."""
    return golden.groupBy("sampled_for").agg(
        F.count_if("labelled").alias("done"), F.count(F.lit(1)).alias("total")).withColumn(
        "bar", F.bround(F.lit(10.0) * F.col("done") / F.col("total")).cast("int")).withColumn(
        "share", F.col("done") / F.col("total"))
