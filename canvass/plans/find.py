"""Ranked search for one person: request and profile in, best records out."""

from __future__ import annotations

from pyspark.sql import DataFrame

from canvass import config as C
from canvass.operators import facets, search


def wanted_areas(areas: list, faculties: list, expand: bool = True) -> list:
    """Area tags of a request, widened to faculty and to all programs."""
    out = list(dict.fromkeys([*areas, *[f"{f} {C.FACULTY_WIDE_SUFFIX}" for f in faculties]]))
    return out + [C.OPEN_TO_ALL_AREA] if out and expand and C.OPEN_TO_ALL_AREA not in out else out


def find(corpus: DataFrame, request: dict, profile: dict | None = None) -> dict[str, DataFrame]:
    """The stages of one search: filtered, scored, top."""
    merged = search.cli_profile_merge(request, profile)
    selection = {
        **{k: merged[k] for k in ("career", "level", "term", "awardType", "affiliation")},
        "areaOfStudy": wanted_areas(merged["areas"], merged["faculties"], not request.get("strict_area")),
        "applicationStatus": facets.default_status(request.get("include_closed", False)),
        "min_value": request.get("min_value"),
    }
    profile = profile or {}
    terms = search.query_terms([request.get("query", ""), *request.get("keywords", []), *profile.get("interests", [])])
    exclude = search.query_terms([*request.get("exclude_keywords", []), *profile.get("exclude_keywords", [])])
    filtered = facets.profile_filters(corpus, selection)
    scored = search.score_records(
        filtered, corpus, terms, exclude, profile or None, request.get("min_score", 0.0))
    return {"filtered": filtered, "scored": scored, "top": search.rank_topk(scored, request.get("limit", 25))}
