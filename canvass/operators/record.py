"""From a keyed-table row to the published record."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from canvass import config as C
from canvass.functions import fields as fx
from canvass.functions import money
from canvass.functions.text import as_col, clean_scalar, split_multi

SCALARS = [
    "award_name", "career", "award_type", "award_description", "award_value_description",
    "eligibility_selection_criteria", "area_of_study", "application_details", "required_supporting_documents",
    "contact_detail", "affiliation", "level", "application_selection",
]
LATER_SCALARS = ["source_url", "deadline_raw", "deadline_date", "application_type", "application_status"]


def award_uid(source_id="source_id", native_id="native_id") -> Column:
    """Globally unique key of a record."""
    return F.concat_ws(":", as_col(source_id), as_col(native_id))


def parse_eligibility(col) -> Column:
    """Eligibility JSON as map<field, entry>; values land in the slot of their kind."""
    # entry by entry, so that one malformed entry does not take the others with it
    texts = F.from_json(as_col(col), "map<string, string>")
    read = F.transform_values(texts, lambda _, e: F.from_json(e, "struct<value: string, confidence: double, src: string>"))
    raw = F.map_filter(read, lambda _, e: e.isNotNull() & (e["value"].isNotNull() | e["confidence"].isNotNull() | e["src"].isNotNull()))

    def entry(_, e):
        value = e["value"]
        is_list = value.startswith("[")
        is_flag = value.isin("true", "false")
        return F.struct(
            F.when(is_list, F.from_json(value, "array<string>")).when(
                ~is_flag & value.try_cast("double").isNull(), F.array(value)).alias("values"),
            F.when(~is_list & ~is_flag, value.try_cast("double")).alias("num"),
            F.when(is_flag, value == "true").alias("flag"),
            e["confidence"].alias("confidence"),
            e["src"].alias("src"),
        )

    return F.transform_values(raw, entry)


def raw_pack(raw_map, additional) -> Column:
    """Raw field map as JSON, with the one field that has no column stored in it; empty is null."""
    raw = F.coalesce(as_col(raw_map), F.create_map().cast("map<string,string>"))
    extra = as_col(additional)
    packed = F.when(
        F.coalesce(extra, F.lit("")) != "",
        F.map_concat(F.map_filter(raw, lambda k, _: k != C.PROMOTED_FIELD), F.create_map(F.lit(C.PROMOTED_FIELD), extra)),
    ).otherwise(raw)
    return F.when(F.size(packed) > 0, F.to_json(packed))


def raw_promote(col) -> Column:
    """The stored field back as a value; broken JSON is ignored."""
    return clean_scalar(F.get_json_object(as_col(col), "$." + C.PROMOTED_FIELD))


def build_record(rows: DataFrame) -> DataFrame:
    """Published records: one projection over the keyed table, no shuffle."""
    scalars = {c: clean_scalar(c) for c in SCALARS}
    cleaned = rows.select(
        F.col("native_id").alias("award_id"),
        "source_id",
        award_uid().alias("award_uid"),
        *[expr.alias(c) for c, expr in scalars.items()],
        *[split_multi(text).alias(array) for text, array in C.MULTI_VALUE_COLUMNS.items()],
        raw_promote("raw_fields_json").alias("additional_instructions"),
        *[clean_scalar(c).alias(c) for c in LATER_SCALARS],
        "amount_min", "amount_max",
        clean_scalar("amount_raw").alias("amount_raw"),
        (F.col("renewable") != 0).alias("renewable"),
        parse_eligibility("eligibility_json").alias("eligibility"),
    )
    derived = money.derive_amounts(
        "amount_min", "amount_max", "amount_raw", "award_value_description", "award_description")
    # a plain projection: amounts nobody reads are pruned away, each by itself
    return cleaned.select(
        *[c for c in cleaned.columns if c not in derived], *[c.alias(n) for n, c in derived.items()])


def slim_projection(records: DataFrame) -> DataFrame:
    """The narrow published view: twelve renamed columns, no prose."""
    return records.select(*[F.col(full).alias(short) for full, short in C.SLIM_COLUMNS.items()])


def row_pack(record: DataFrame) -> DataFrame:
    """Ingested record to table row: raw map dropped, eligibility serialised or null."""
    packed = F.when(F.size("eligibility") > 0, F.to_json("eligibility"))
    return record.withColumn("eligibility_json", packed).drop("raw_fields", "eligibility")


def detail_precedence(listing: DataFrame, detail: DataFrame, overwrite: bool = False) -> DataFrame:
    """Fold detail-page text into listing records.

    listing: key, blurb, amount_cell; detail: key, body.  The body replaces the
    blurb.  Its figures fill the amounts only when the cell gave none, or, with
    ``overwrite``, whenever it names any.
    """
    both = listing.join(detail, "award_uid", "left")
    both = both.withColumn("cell", money.parse_amounts("amount_cell", False)).withColumn(
        "prose", money.parse_amounts("body", False))
    has_prose = F.col("prose.amount_min").isNotNull()
    use_prose = has_prose if overwrite else (F.col("cell.amount_max").isNull() & has_prose)
    pick = lambda f: F.when(use_prose, F.col("prose")[f]).otherwise(F.col("cell")[f])
    return both.select(
        "award_uid",
        F.coalesce("body", "blurb").alias("award_description"),
        F.col("body").alias("eligibility_selection_criteria"),
        *[pick(f).alias(f) for f in ("amount_min", "amount_max", "amount_raw")],
        F.when(use_prose, F.lit("detail")).when(F.col("cell.amount_max").isNotNull(), F.lit("cell"))
        .alias("amount_from"),
        F.when(F.col("body").isNull(), F.lit("no description recovered from detail page")).alias("detail_warning"),
    )


def provenance_tags(raw_map, **tags) -> Column:
    """Notes on how values came about, added to the raw map; null notes are left out."""
    names = [F.lit(k) for k in tags]
    pairs = F.map_from_arrays(F.array(*names), F.array(*[as_col(v) for v in tags.values()]))
    kept = F.map_filter(pairs, lambda _, v: v.isNotNull())
    base = F.coalesce(as_col(raw_map), F.create_map().cast("map<string,string>"))
    return F.map_concat(F.map_filter(base, lambda k, _: ~k.isin(list(tags))), kept)


def listing_record(rows: DataFrame) -> DataFrame:
    """Listing rows (cells already classified) as ingested records."""
    career = fx.infer_career("name", F.lit(None).cast("string"))
    return rows.withColumn("_a", money.parse_amounts("amount", False)).select(
        "source_id", "native_id",
        F.col("name").alias("award_name"),
        F.col("blurb").alias("award_description"),
        fx.canonical_category("category", False).alias("area_of_study"),
        career.alias("career"),
        F.col("_a.amount_min").alias("amount_min"),
        F.col("_a.amount_max").alias("amount_max"),
        F.col("_a.amount_raw").alias("amount_raw"),
        F.col("url").alias("source_url"),
        F.col("deadline").alias("deadline_raw"),
        fx.deadline_iso("deadline").alias("deadline_date"),
        F.lit("open").alias("application_type"),
        fx.normalize_status("status").alias("application_status"),
        provenance_tags(
            F.create_map().cast("map<string,string>"),
            career_inferred_from=F.when(career.isNotNull(), F.lit("title")),
            category=F.col("category"), deadline=F.col("deadline"), status=F.col("status"),
            amount=F.col("amount"), blurb=F.col("blurb"),
        ).alias("raw_fields"),
    )
