"""From fetched pages to published datasets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from canvass.operators import counts, keyed, publish
from canvass.operators.record import build_record, slim_projection
from canvass.sources.adapters import ingest


def refresh(table: DataFrame, kind: str, fetched: DataFrame, run_ts) -> DataFrame:
    """The keyed table after one crawl of a source."""
    return keyed.upsert_full(table, ingest(kind, fetched).withColumn("run_ts", run_ts))


def publish_all(table: DataFrame, registry: DataFrame, root: str, version: str) -> str:
    """Gate the table, then publish full, slim, counts, vocabulary and meta under one version."""
    records = build_record(table)
    core = registry.where((F.col("status") == "active") & (F.col("delivery") == "core")).select("source_id")
    core_ids = [r["source_id"] for r in core.collect()]
    is_core = F.col("source_id").isin(core_ids)
    split = counts.facet_counts_split(records, is_core)
    meta = publish.publish_meta(table, registry)
    uid_check = publish.uid_gate(records, is_core).where(~F.col("ok"))
    return publish.staged_publish(
        {
            "records": records,
            "slim": slim_projection,
            "facets": split,
            "meta": meta,
            "manifest": publish.publish_manifest(split, meta, registry),
            "vocabulary": publish.vocab_extract(split),
        },
        [publish.publish_gate(table, registry), uid_check, publish.vocab_gate(split.select("facet", "value"))],
        root, version)
