"""Catalogue browsing: text search, then filters, then the optional quick match."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from canvass.functions.text import str_array
from canvass.operators import facets, search


def search_then_filter(
    records: DataFrame, query: str = "", selection: dict | None = None, profile: dict | None = None,
) -> DataFrame:
    """Matching records with ``rank_score`` of the text search; filters keep that rank.

    Filters are plain predicates, so they run on the scan, before the text work.
    """
    kept = facets.structured_filters(records, selection or {})
    if profile:
        kept = kept.where(facets.quick_match(
            F.lit(profile.get("career")).cast("string"), F.lit(profile.get("level")).cast("string"),
            str_array(profile.get("areas") or [])))
    return search.fuzzy_search(kept, query)
