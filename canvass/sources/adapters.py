"""Ingestion contract: source id -> job from fetched pages to records.

A job takes (page_id, source_id, url, html) rows and returns records with the key
columns and any of the declared adapter columns; undeclared columns are refused.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from canvass.functions import fields as fx
from canvass.functions import money
from canvass.functions.text import clean_text, slugify
from canvass.operators import keyed, pages, record

Job = Callable[[DataFrame], DataFrame]
_JOBS: dict[str, Job] = {}


def adapter(kind: str) -> Callable[[Job], Job]:
    """Register an ingestion job under a kind."""

    def register(job: Job) -> Job:
        _JOBS[kind] = job
        return job

    return register


def kinds() -> list[str]:
    return sorted(_JOBS)


def ingest(kind: str, fetched: DataFrame) -> DataFrame:
    """Run a source's job and hold it to the contract."""
    return keyed.reject_unknown_columns(_JOBS[kind](fetched))


@adapter("listing")
def listing(fetched: DataFrame) -> DataFrame:
    """Paged listings with one table row per record, cells read by content."""
    rows = pages.listing_rows(pages.page_table_rows(fetched), r"^/opportunities/(\d+)$")
    origin = fetched.select(
        "page_id", "source_id", F.regexp_extract("url", r"^([A-Za-z]+://[^/]+)", 1).alias("base"))
    joined = rows.join(origin, "page_id").withColumn("url", F.concat("base", "link"))
    once = pages.listing_dedupe(joined, ["source_id"], "native_id", "page_id", "row_no")
    return record.listing_record(once)


@adapter("wide_table")
def wide_table(fetched: DataFrame) -> DataFrame:
    """One page of name / body / extra rows; ids come from names and bodies."""
    rows = pages.page_table_rows(fetched).join(fetched.select("page_id", "source_id", "url"), "page_id")
    name = clean_text(F.get("cells", F.lit(0)), False)
    named = rows.where(F.size("cells") >= 2).withColumn("award_name", name).where(F.col("award_name").isNotNull())
    body = F.coalesce(clean_text(F.get("cells", F.lit(1)), False), F.lit(""))
    read = (
        named.withColumn("award_description", fx.strip_name_prefix("award_name", body))
        .withColumn("_x", fx.classify_extra_cells(F.slice("cells", F.lit(3), F.greatest(F.size("cells") - 2, F.lit(0)))))
        .withColumn("award_uid", F.concat_ws(":", "source_id", F.col("page_id"), F.col("row_no"))))
    amounts = money.parse_amounts("award_description", False)
    from canvass.operators.ranking import stable_native_id

    ided = stable_native_id(read).withColumn("_a", amounts)
    return ided.select(
        "source_id", F.col("stable_id").alias("native_id"), "award_name", "award_description",
        F.col("award_description").alias("eligibility_selection_criteria"),
        F.col("_x.supporting_documents").alias("required_supporting_documents"),
        F.col("_x.deadline_raw").alias("deadline_raw"),
        F.col("_a.amount_min").alias("amount_min"), F.col("_a.amount_max").alias("amount_max"),
        F.col("_a.amount_raw").alias("amount_raw"), F.col("url").alias("source_url"))


@adapter("cards")
def cards(fetched: DataFrame) -> DataFrame:
    """Index pages of cards: a title, a group line and 'Label: value' blocks."""
    parts = pages.page_marked(fetched, ("scholarship-title", "scholarship-group"))
    is_title = F.col("name") == "scholarship-title"
    # a card opens with its title, so what follows up to the next title is its own
    so_far = Window.partitionBy("page_id").orderBy("pos")
    carded = parts.withColumn("card", F.last(F.when(is_title, F.col("pos")), ignorenulls=True).over(so_far))
    cards_ = carded.where("card is not null").groupBy("page_id", "card").agg(
        F.max(F.when(is_title, F.col("text"))).alias("award_name"),
        F.min_by("text", F.when(~is_title, F.col("pos"))).alias("group"))
    joined = cards_.join(fetched.select("page_id", "source_id", "url"), "page_id")
    return joined.select(
        "source_id", slugify("award_name").alias("native_id"), "award_name",
        fx.career_by_group("group").alias("career"), fx.level_by_group("group").alias("level"),
        F.col("url").alias("source_url"), F.lit("open").alias("application_type"))
