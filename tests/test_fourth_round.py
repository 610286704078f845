"""find_for_profile: figures are not read in the scan, terms are looked for in place."""

from pyspark.sql import functions as F

from canvass.functions.text import str_array, words
from canvass.operators import facets, search

TEXTS = ["Women award, AWARD-x", "awards womén aẃard", "a_award women9", "", None, "award women un", "x9award award9 (women)"]


def records(spark):
    rows = [(t, *(TEXTS[(i + k) % 7] for k in range(1, len(search.FIELDS)))) for i, t in enumerate(TEXTS)]
    return spark.createDataFrame(rows, ", ".join(f"{f} string" for f in search.FIELDS))


def test_terms_are_found_as_among_all_tokens(spark):
    r = records(spark)
    for terms in (["award", "unseen", "women"], ["un", "award"], ["un"], ["wom-en", "women"]):
        want = F.array_sort(F.array_intersect(search.record_tokens(), str_array(terms)))
        got = F.array_sort(F.array_distinct(search.tokens_among(terms)))
        assert r.where(~got.eqNullSafe(want)).count() == 0
        hits = search.with_hits(r, terms)
        for f in search.FIELDS:
            want = F.array_sort(F.array_intersect(words(f), str_array(terms)))
            assert hits.where(~F.array_sort(F.array_distinct(f"_w_{f}")).eqNullSafe(want)).count() == 0


def test_figures_are_read_after_the_rows_are_dealt_out(spark):
    rows = spark.createDataFrame(
        [(i, "Undergraduate", "Open", f"Valued at ${i}", None) for i in range(200)],
        "k long, career string, application_status string, award_value_description string, award_description string")
    rows = rows.repartition(4, "k").withColumns(
        {c: F.array().cast("array<string>") for c in ("levels", "terms", "award_types", "areas_of_study", "affiliations")})
    left = facets.profile_filters(rows, {"career": ["Undergraduate"], "min_value": 100})
    plan = left._jdf.queryExecution().executedPlan().toString()
    assert "regexp_extract" not in plan[plan.index("Exchange"):]
    assert sorted(r.k for r in left.collect()) == list(range(100, 200)) and left.columns == rows.columns
