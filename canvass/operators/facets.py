"""Filters.  A facet entry becomes a Column predicate; Catalyst does the rest.

Unstated is unconstrained, except for ranges: a bound hides records that state
no figure.  ``mode`` changes only tag facets: browsing shows what carries the
tag, a profile also keeps what is open to everyone.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from canvass import config as C
from canvass.functions import money
from canvass.functions.once import with_once
from canvass.functions.text import as_col, str_array

BROWSE, PROFILE = "browse", "profile"
BY_KEY = {f["key"]: f for f in C.FACETS + C.ELIGIBILITY_FACETS}
BY_FILTER_KEY = {f["filter_key"]: f for f in C.FACETS + C.ELIGIBILITY_FACETS}


def facet_values(facet: dict) -> Column:
    """Value(s) of a facet, always as an array."""
    col = F.col(facet["key"])
    if facet["kind"] == "list":
        return F.coalesce(col, F.array().cast("array<string>"))
    return F.array_compact(F.array(col))


def pass_list(col, selected) -> Column:
    """No selection, nothing stated, or an overlap."""
    if not selected:
        return F.lit(True)
    values = F.coalesce(as_col(col), F.array().cast("array<string>"))
    return (F.size(values) == 0) | F.arrays_overlap(values, str_array(selected))


def pass_scalar(col, selected) -> Column:
    if not selected:
        return F.lit(True)
    return as_col(col).isNull() | as_col(col).isin(list(selected))


def pass_range(col, low=None, high=None) -> Column:
    """Inclusive bounds; once one is set, an unstated figure fails."""
    if low is None and high is None:
        return F.lit(True)
    checks = [as_col(col).isNotNull()]
    if low is not None:
        checks.append(as_col(col) >= low)
    if high is not None:
        checks.append(as_col(col) <= high)
    return reduce(lambda a, b: a & b, checks)


def pass_bool(col, selected) -> Column:
    """Null selection passes all; else the column's truthiness must equal it."""
    if selected is None:
        return F.lit(True)
    truthy = F.coalesce(F.typeof(as_col(col)) == "string", F.lit(False)) & (as_col(col).cast("string") != "")
    other = (F.typeof(as_col(col)) != "string") & ~as_col(col).cast("string").isin("false", "0", "0.0")
    truthy = F.coalesce(truthy | other, F.lit(False))
    return truthy if selected else ~truthy


def pass_tag(col, selected, mode: str = BROWSE) -> Column:
    if not selected:
        return F.lit(True)
    values = F.coalesce(as_col(col), F.array().cast("array<string>"))
    tagged = F.arrays_overlap(values, str_array(selected))
    return (F.size(values) == 0) | tagged if mode == PROFILE else tagged


def pass_gate(col, selected) -> Column:
    """Stated values restrict; a silent record is open, a silent reader hides nothing."""
    return pass_list(col, selected)


def bounds(selected) -> tuple:
    """{min, max} or a pair as (low, high)."""
    if isinstance(selected, dict):
        return selected.get("min"), selected.get("max")
    if isinstance(selected, (list, tuple)):
        return tuple(selected)
    return None, None


def predicate(facet: dict, selected, mode: str = BROWSE) -> Column:
    """The predicate of one facet under one selection."""
    key, kind = facet["key"], facet["kind"]
    if kind == "range":
        return pass_range(key, *bounds(selected))
    if kind == "bool":
        return pass_bool(key, selected)
    if facet["semantics"] == "tag":
        return pass_tag(key, selected, mode)
    if facet["semantics"] == "gate":
        return pass_gate(key, selected)
    return pass_list(key, selected) if kind == "list" else pass_scalar(key, selected)


def all_of(predicates) -> Column:
    return reduce(lambda a, b: a & b, predicates, F.lit(True))


def structured_filters(records: DataFrame, selection: dict, mode: str = BROWSE, spec=None) -> DataFrame:
    """AND over the facets, OR inside each: one filter on the scan.

    Ranges come last: amounts may have to be read from prose, which then happens for
    the survivors of the cheap facets only.
    """
    ordered = sorted(spec or C.FACETS, key=lambda f: f["kind"] == "range")
    return records.where(all_of([predicate(f, selection.get(f["filter_key"]), mode) for f in ordered]))


def default_status(include_closed: bool = False) -> list:
    """What application status is pre-selected."""
    return [] if include_closed else list(BY_FILTER_KEY["applicationStatus"]["default"])


def min_value(minimum) -> Column:
    if minimum is None:
        return F.lit(True)
    value = money.first_dollar("award_value_description", "award_description")
    return value.isNotNull() & (value >= minimum)


def profile_filters(records: DataFrame, request: dict) -> DataFrame:
    """'What can this person win?': seven facets in profile mode and a minimum value.

    Figures are read from prose for the survivors of the facets only, scalars first, and behind a
    generator: a plain predicate would be moved into the scan, which has few tasks.
    """
    keys = ["career", "applicationStatus", "level", "term", "awardType", "areaOfStudy", "affiliation"]
    left = records.where(all_of([predicate(BY_FILTER_KEY[k], request.get(k), PROFILE) for k in keys]))
    if request.get("min_value") is None:
        return left
    return with_once(left, {"_enough": min_value(request["min_value"])}).where("_enough").drop("_enough")


def effective_areas(areas, faculties, expand=True) -> Column:
    """Area tags that count as a match, for columns of programs and faculties."""
    none = F.array().cast("array<string>")
    areas, faculties = F.coalesce(as_col(areas), none), F.coalesce(as_col(faculties), none)
    wide = F.transform(faculties, lambda f: F.concat(f, F.lit(" " + C.FACULTY_WIDE_SUFFIX)))
    named = F.array_union(areas, wide)
    if not expand:
        return named
    return F.when(F.size(named) > 0, F.array_union(named, str_array([C.OPEN_TO_ALL_AREA]))).otherwise(named)


def expand_areas(areas, vocabulary: list) -> Column:
    """Widen validated areas; additions must be known values and survive the cap."""
    areas = F.coalesce(as_col(areas), F.array().cast("array<string>"))
    engineering = F.exists(areas, lambda a: a.endswith("Engineering"))
    additions = F.array_compact(F.array(
        F.lit(C.OPEN_TO_ALL_AREA),
        F.when(engineering, F.lit(C.ENGINEERING_AREA)),
    ))
    additions = F.array_intersect(F.array_except(additions, areas), str_array(vocabulary))
    room = F.greatest(F.lit(C.MAX_VALUES_PER_FILTER["areaOfStudy"]) - F.size(additions), F.lit(0))
    return F.when(
        (F.size(areas) > 0) & (F.size(additions) > 0), F.concat(F.slice(areas, F.lit(1), room), additions)
    ).otherwise(areas)


def quick_match(career, level, areas) -> Column:
    """Three-field match; a silent record or a silent profile passes.  Arguments are columns."""
    none = F.array().cast("array<string>")
    levels, have = F.coalesce(F.col("levels"), none), F.coalesce(F.col("areas_of_study"), none)
    want = F.coalesce(as_col(areas), none)
    ok_career = as_col(career).isNull() | F.col("career").isNull() | (F.col("career") == as_col(career))
    ok_level = as_col(level).isNull() | (F.size(levels) == 0) | F.array_contains(levels, as_col(level))
    ok_areas = (F.size(want) == 0) | (F.size(have) == 0) | F.arrays_overlap(have, want)
    return ok_career & ok_level & ok_areas


def needs_detail(all_details: bool = False) -> Column:
    """Detail pages are fetched unless the record is known to be closed."""
    return F.lit(True) if all_details else ~F.col("application_status").eqNullSafe("Ended")


def strict_filters(records: DataFrame, selection: dict) -> DataFrame:
    """The older reading, kept as a baseline: a record that states nothing never matches."""
    chosen = []
    for facet in C.FACETS:
        selected = selection.get(facet["filter_key"])
        values = facet_values(facet)
        if facet["semantics"] == "tag":
            chosen.append((F.size(values) == 0) | F.arrays_overlap(values, str_array(selected or [])))
        elif selected and facet["kind"] in ("list", "scalar"):
            chosen.append(F.arrays_overlap(values, str_array(selected)))
    return records.where(F.coalesce(all_of(chosen), F.lit(False)))
