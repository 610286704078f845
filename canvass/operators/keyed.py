"""Keyed-table maintenance: the table in, the next table out.

Incoming rows are first reduced to one per key (latest version, combined
map-side), so the join with the table is one-to-one whatever is hot upstream.
Every job returns the whole next table; a caller writes it to a new folder.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from canvass import config as C
from canvass.operators.record import raw_pack
from canvass.schema import ADAPTER_COLUMNS, KEY

INDEX_COLUMNS = ["award_name", "level", "career", "application_selection"]
DETAIL_COLUMNS = [c for c in C.FIELD_COLUMNS.values() if c != "award_name"]


class UnknownColumns(ValueError):
    """Incoming rows carry columns the table does not have."""


def latest_per_key(rows: DataFrame, version: str, keys=KEY) -> DataFrame:
    """The row with the highest version of every key; of tied versions the one with the greatest content.

    Contents are compared column by column, so the choice does not depend on the
    order of rows.  ``_first`` is the lowest version; rows that were reduced before
    bring theirs along.
    """
    rest = [c for c in rows.columns if c not in (*keys, "_first")]
    lowest = "_first" if "_first" in rows.columns else version
    best = rows.groupBy(*keys).agg(
        F.max_by(F.struct(*rest), F.struct(F.col(version).alias("_v"), *rest)).alias("_r"), F.min(lowest).alias("_first"))
    return best.select(*keys, "_r.*", "_first")


def _merge(table: DataFrame, incoming: DataFrame, how: str, version: str, stored: str) -> DataFrame:
    """Join with one row per key, ``_new``, which is null where the table's own row stays.

    It stays if its version is later, or the same with the greater content, so batches
    may come in any order.  ``_seen`` is the lowest incoming version.
    """
    fresh = incoming.select(*KEY, F.struct(*[c for c in incoming.columns if c not in (*KEY, "_first")]).alias("_new"),
                            F.col("_first").alias("_seen"))
    both = table.join(fresh, KEY, how)
    shared = [c for c in incoming.columns if c in table.columns and c not in (*KEY, version, stored)]
    mine = F.struct(F.col(stored).alias("_v"), *[F.col(c) for c in shared])
    other = F.struct(F.col("_new")[version].alias("_v"), *[F.col("_new")[c].alias(c) for c in shared])
    stays = F.col(stored).isNotNull() & F.col("_new").isNotNull() & (mine > other)
    return both.withColumn("_new", F.when(~F.coalesce(stays, F.lit(False)), F.col("_new")))


def upsert_index(table: DataFrame, rows: DataFrame, version: str = "indexed_at") -> DataFrame:
    """Insert or refresh the listing columns; detail columns stay as they are, and so do rows indexed later."""
    both = _merge(table, latest_per_key(rows.select(*KEY, *INDEX_COLUMNS, "indexed_at", *(
        [version] if version != "indexed_at" else [])), version), "full_outer", version, "indexed_at")
    hit = F.col("_new").isNotNull()
    taken = INDEX_COLUMNS + ["indexed_at"]
    return both.select(*[
        F.when(hit, F.col("_new")[c]).otherwise(F.col(c)).alias(c) if c in taken else F.col(c) for c in table.columns])


def fields_to_columns(field_map) -> list[Column]:
    """Named columns out of a page's field map; a missing field is null."""
    col = F.col(field_map) if isinstance(field_map, str) else field_map
    return [F.try_element_at(col, F.lit(f)).alias(c) for f, c in C.FIELD_COLUMNS.items()]


def update_detail(table: DataFrame, pages: DataFrame, version: str = "fetched_at") -> DataFrame:
    """Overwrite the detail columns of known keys.

    pages: key, ``fields`` map, version.  A field the page lacks becomes null,
    a key the table lacks is dropped, the error is cleared.  Rows scraped later than
    the page stay as they are.
    """
    read = pages.select(*KEY, *fields_to_columns("fields"), F.to_json("fields").alias("raw_fields_json"),
                        F.col(version).alias("scraped_at"))
    fresh = latest_per_key(read.drop("award_name"), "scraped_at")
    both = _merge(table, fresh, "left", "scraped_at", "scraped_at")
    hit = F.col("_new").isNotNull()
    out = []
    for c in table.columns:
        if c in DETAIL_COLUMNS or c in ("raw_fields_json", "scraped_at"):
            out.append(F.when(hit, F.col("_new")[c]).otherwise(F.col(c)).alias(c))
        elif c == "scrape_error":
            out.append(F.when(~hit, F.col(c)).alias(c))
        else:
            out.append(F.col(c))
    return both.select(*out)


def reject_unknown_columns(df: DataFrame, allowed=None) -> DataFrame:
    """The frame itself, or an error naming the columns nobody declared."""
    allowed = set(allowed or [*KEY, *ADAPTER_COLUMNS, "additional_instructions", "raw_fields", "run_ts"])
    unknown = sorted(set(df.columns) - allowed)
    if unknown:
        raise UnknownColumns(f"unknown column(s): {', '.join(unknown)}")
    return df


def newest_records(records: DataFrame, version: str = "run_ts") -> DataFrame:
    """Incoming whole records, ready to be merged: one per key, with its raw fields packed."""
    reject_unknown_columns(records)
    packed = records.withColumn(
        "raw_fields_json",
        raw_pack(
            "raw_fields" if "raw_fields" in records.columns else F.lit(None).cast("map<string,string>"),
            "additional_instructions" if "additional_instructions" in records.columns else F.lit(None).cast("string")))
    return latest_per_key(packed.drop("raw_fields", "additional_instructions"), version)


def upsert_full(table: DataFrame, records: DataFrame, version: str = "run_ts") -> DataFrame:
    """Insert or replace whole records.

    The time of first indexing is the earliest version seen; every written row gets a
    fresh scrape time and no error.  A row scraped later than the record stays, so
    batches may come in any order.
    """
    return merge_newest(table, newest_records(records, version), version)


def merge_newest(table: DataFrame, newest: DataFrame, version: str = "run_ts") -> DataFrame:
    """The keyed table with one ready record per key folded in; see ``upsert_full``."""
    both = _merge(table, newest, "full_outer", version, "scraped_at")
    hit = F.col("_new").isNotNull()
    written = set(newest.columns) - set(KEY) - {version, "_first"}
    out = []
    for c in table.columns:
        if c in KEY:
            out.append(F.col(c))
        elif c == "indexed_at":
            out.append(F.least(F.col(c), F.col("_seen")).alias(c))
        elif c == "scraped_at":
            out.append(F.when(hit, F.col("_new")[version]).otherwise(F.col(c)).alias(c))
        elif c == "scrape_error":
            out.append(F.when(~hit, F.col(c)).alias(c))
        elif c in written:
            out.append(F.when(hit, F.col("_new")[c]).otherwise(F.col(c)).alias(c))
        elif c in ADAPTER_COLUMNS:
            out.append(F.when(~hit, F.col(c)).alias(c))
        else:
            out.append(F.col(c))
    return both.select(*out)


def mark_error(table: DataFrame, errors: DataFrame) -> DataFrame:
    """Set the error of the given keys; one error per key is kept."""
    one = errors.groupBy(*KEY).agg(F.max("error").alias("_error"))
    return table.join(one, KEY, "left").select(*[
        F.coalesce("_error", c).alias(c) if c == "scrape_error" else F.col(c) for c in table.columns])


def pending_keys(table: DataFrame, source_id: str | None = None) -> DataFrame:
    """What is still to be fetched, in key order."""
    todo = table.where(F.col("scraped_at").isNull())
    if source_id is not None:
        todo = todo.where(F.col("source_id") == source_id)
    return todo.select(*KEY).orderBy(*KEY)


def count_rows(table: DataFrame, source_id: str | None = None, pending: bool = False) -> DataFrame:
    if source_id is not None:
        table = table.where(F.col("source_id") == source_id)
    if pending:
        table = table.where(F.col("scraped_at").isNull())
    return table.agg(F.count(F.lit(1)).alias("n"))


def schema_upgrade(old: DataFrame, source_id: str) -> DataFrame:
    """Single-source rows under the two-part key."""
    if "source_id" in old.columns:
        return old
    if "award_id" not in old.columns:
        raise ValueError("neither source_id nor award_id: refusing to guess the shape")
    carried = [c for c in old.columns if c != "award_id"]
    return old.select(F.lit(source_id).alias("source_id"), F.col("award_id").alias("native_id"), *carried)


def checked_upgrade(old: DataFrame, source_id: str) -> DataFrame:
    """Upgrade that refuses to lose rows."""
    new = schema_upgrade(old, source_id)
    before, after = old.count(), new.count()
    if before != after:
        raise ValueError(f"upgrade lost rows: {before} before, {after} after")
    return new


def add_missing_columns(df: DataFrame, spec: dict) -> tuple[DataFrame, list]:
    """Add absent nullable columns; also says which were added."""
    added = [c for c in spec if c not in df.columns]
    return df.select("*", *[F.lit(None).cast(spec[c]).alias(c) for c in added]), added
