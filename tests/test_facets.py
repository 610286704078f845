import pytest
from pyspark.sql import functions as F

from canvass.operators import facets

SCHEMA = "career string, affiliations array<string>, areas_of_study array<string>, amount_max long, deadline_date string"


def passes(spark, record, predicate):
    base = {"career": None, "affiliations": [], "areas_of_study": [], "amount_max": None, "deadline_date": None}
    df = spark.createDataFrame([tuple({**base, **record}.values())], SCHEMA)
    return df.where(predicate).count() == 1


LIST = facets.BY_KEY["areas_of_study"]
TAG = facets.BY_KEY["affiliations"]


@pytest.mark.parametrize("record, facet, selected, mode, want", [
    ({"areas_of_study": []}, "areas_of_study", ["EE"], "browse", True),
    ({"areas_of_study": ["History"]}, "areas_of_study", ["EE"], "browse", False),
    ({"career": None}, "career", ["Undergraduate"], "browse", True),
    ({"career": "Graduate"}, "career", ["Undergraduate"], "browse", False),
    ({"affiliations": []}, "affiliations", ["Women"], "browse", False),
    ({"affiliations": ["Women"]}, "affiliations", ["Women"], "browse", True),
    ({"affiliations": []}, "affiliations", ["Women"], "profile", True),
    ({"affiliations": ["Indigenous"]}, "affiliations", ["Women"], "profile", False),
    ({"affiliations": ["Indigenous"]}, "affiliations", [], "browse", True),
    ({"amount_max": None}, "amount_max", None, "browse", True),
    ({"amount_max": None}, "amount_max", {"min": 10000}, "browse", False),
    ({"amount_max": 20000}, "amount_max", {"min": 10000}, "browse", True),
    ({"amount_max": 500}, "amount_max", (10000, None), "browse", False),
    ({"deadline_date": None}, "deadline_date", None, "browse", True),
    ({"deadline_date": None}, "deadline_date", True, "browse", False),
    ({"deadline_date": ""}, "deadline_date", False, "browse", True),
    ({"deadline_date": "2027-01-15"}, "deadline_date", True, "browse", True),
])
def test_truth_table(spark, record, facet, selected, mode, want):
    assert passes(spark, record, facets.predicate(facets.BY_KEY[facet], selected, mode)) is want


def test_gate(spark):
    assert passes(spark, {"affiliations": []}, facets.pass_gate("affiliations", ["Women"]))
    assert passes(spark, {"affiliations": ["Women"]}, facets.pass_gate("affiliations", []))
    assert not passes(spark, {"affiliations": ["Women"]}, facets.pass_gate("affiliations", ["Indigenous"]))


def test_effective_areas(spark):
    df = spark.createDataFrame([(["SE"], ["Engineering"]), ([], [])], "a array<string>, f array<string>")
    wide = [sorted(r[0]) for r in df.select(facets.effective_areas("a", "f")).collect()]
    assert wide == [["All Programs", "Engineering Faculty - All Programs", "SE"], []]
    strict = [sorted(r[0]) for r in df.select(facets.effective_areas("a", "f", expand=False)).collect()]
    assert strict == [["Engineering Faculty - All Programs", "SE"], []]


def test_expansion_respects_the_cap(spark):
    many = [f"P{i} Engineering" for i in range(30)]
    df = spark.createDataFrame([(many,)], "a array<string>")
    got = df.select(facets.expand_areas("a", ["All Programs", "Engineering Faculty - All Programs"])).first()[0]
    assert len(got) == 30 and got[-2:] == ["All Programs", "Engineering Faculty - All Programs"]
    assert df.select(F.size(facets.expand_areas("a", []))).first()[0] == 30
