import itertools
import json
import random

import pytest
from pyspark.sql import functions as F

from canvass import config as C
from canvass.operators import eligibility as el
from canvass.operators.record import parse_eligibility
from canvass.schema import PROFILE

FULL = {"citizenship": ["citizen"], "residency": ["AB"], "institution": ["north-college"], "program": ["software"], "year": [3],
        "level": ["undergraduate"], "identity": ["none"], "gpa": 78.0, "financial_need": False, "full_time": True}


def need(value, confidence=0.9, src="As stated."):
    return {"value": value, "confidence": confidence, "src": src}


def judge(spark, requirement, profile, application_type="open"):
    stored = json.dumps(requirement) if requirement is not None else None
    df = spark.createDataFrame([(stored, application_type)], "j string, application_type string")
    df = df.withColumn("eligibility", parse_eligibility("j"))
    return el.match_profile(df, profile).first()


@pytest.mark.parametrize("requirement, profile, verdict, field", [
    ({"residency": need(["ON"])}, FULL, "excluded", "residency"),
    ({"residency": need(["ON"], 0.5)}, FULL, "unknown", "residency"),
    ({"residency": need(["ON"], 0.75)}, FULL, "excluded", "residency"),
    ({"residency": need(["ON"], 0.74)}, FULL, "unknown", "residency"),
    ({"residency": need(["ON", "AB"])}, FULL, "eligible", None),
    ({"residency": need(["ON"])}, {"institution": ["north-college"]}, "unknown", "residency"),
    ({"residency": need([])}, FULL, "eligible", None),
    ({"program": need(["engineering", "software"]), "program_excluded": need(["software"])}, FULL, "excluded", "program_excluded"),
    ({"program": need(["any"])}, FULL, "eligible", None),
    ({"identity": need(["women"])}, FULL, "excluded", "identity"),
    ({"identity": need(["women"])}, {**FULL, "identity": []}, "unknown", "identity"),
    ({"institution": need(["any_eligible_canadian"])}, FULL, "eligible", None),
    ({"institution": need(["south-college"])}, FULL, "excluded", "institution"),
    ({"gpa_min": need(80)}, FULL, "excluded", "gpa_min"),
    ({"gpa_min": need(75)}, FULL, "eligible", None),
    ({"gpa_min": need("high")}, FULL, "unknown", "gpa_min"),
    ({"financial_need": need(True)}, FULL, "excluded", "financial_need"),
    ({"year": need([3, 4])}, FULL, "eligible", None),
    ({"year": need([1])}, FULL, "excluded", "year"),
    ({"residency": need(["ON"]), "gpa_min": need(90)}, {"gpa": 50.0}, "excluded", "gpa_min"),
    ({}, FULL, "unknown", None),
    (None, FULL, "unknown", None),
])
def test_verdicts(spark, requirement, profile, verdict, field):
    got = judge(spark, requirement, profile)
    assert got["verdict"] == verdict
    named = {"excluded": got["excluded_fields"], "unknown": got["unknown_fields"], "eligible": []}[verdict]
    assert named == ([field] if field else [])


def test_reasons(spark):
    got = judge(spark, {"residency": need(["QC", "ON"], src="Ontario or Quebec."), "year": need([1], 0.2)}, FULL)
    assert got["reasons"] == ["residency: requires ['ON', 'QC'], you have ['AB']. Ontario or Quebec.",
                              "year: requires [1], you have [3]. As stated."]
    silent = judge(spark, {"gpa_min": need(80)}, {})
    assert silent["reasons"] == ["gpa_min: award requires this; your profile does not say. As stated."]
    note = judge(spark, {"year": need([3])}, FULL, "institution_mediated")
    assert note["verdict"] == "eligible" and note["reasons"] == ["Not an open application: institution mediated."]


def test_empty_profile_is_never_excluded(spark):
    for name, kind, *_ in C.ELIGIBILITY_FIELDS:
        value = {"at_least": 90, "must_be": True}.get(kind, ["x"])
        assert judge(spark, {name: need(value, 1.0)}, {})["verdict"] == "unknown"


@pytest.mark.parametrize("stored, problem", [
    ({"colour": need(["red"])}, "unknown field"),
    ({"residency": need(["Alberta"])}, "value not in vocabulary"),
    ({"residency": {"value": ["AB"], "confidence": 0.9}}, "missing src"),
    ({"residency": need(["AB"], -0.1)}, "confidence outside 0..1"),
    ({"residency": need(["AB"], 1.5)}, "confidence outside 0..1"),
    ({"residency": need(["AB"], "high")}, "confidence outside 0..1"),
    ({"residency": need(["AB"], None)}, "confidence outside 0..1"),
    ({"gpa_min": need(400)}, "gpa_min not 0..100"),
    ({"year": need([7])}, "year not 0..6"),
    ({"identity": need(["people-of-colour"])}, "value not in vocabulary"),
    ({"residency": need(["AB"]), "year": need([0, 6]), "gpa_min": need(0)}, None),
])
def test_validator(spark, stored, problem):
    df = spark.createDataFrame([(1, json.dumps(stored))], "k int, j string")
    assert [r["problem"] for r in el.validate(df, "k", "j").collect()] == ([problem] if problem else [])


def test_cross_match_equals_brute_force(spark):
    """All profiles against all records, with most records sharing one requirement."""
    rng = random.Random(7)
    pick = lambda xs: rng.choice(xs)
    requirements = [{"residency": need(["ON"], 0.9)}] * 12 + [None, {}]
    for _ in range(20):
        r = {}
        if rng.random() < .5:
            r["residency"] = need(rng.sample(["ON", "AB", "QC"], 2), pick([0.5, 0.9]))
        if rng.random() < .4:
            r["institution"] = need([pick(["a", "b", "any_canadian"])], pick([0.5, 1.0]))
        if rng.random() < .4:
            r["gpa_min"] = need(pick([60, 70, 80]))
        if rng.random() < .3:
            r["identity"] = need(["women", "black"], 0.8)
        requirements.append(r)
    profiles = []
    for i in range(25):
        profiles.append({
            "profile_id": str(i), "citizenship": None, "residency": pick([None, [], ["ON"], ["AB", "QC"]]),
            "institution": pick([None, ["a"], ["c"]]), "program": None, "year": None, "level": None,
            "identity": pick([None, ["none"], ["women"], ["women", "black"]]), "gpa": pick([None, 65.0, 85.0]),
            "financial_need": None, "full_time": None})
    records = spark.createDataFrame(
        [(json.dumps(r) if r is not None else "{}",) for r in requirements], "j string").select(
        parse_eligibility("j").alias("eligibility"))
    got = {r["profile_id"]: tuple(r)[1:] for r in el.profile_cross_match(
        spark.createDataFrame(profiles, PROFILE), records).collect()}
    for p in profiles:
        answers = {k: v for k, v in p.items() if k != "profile_id"}
        tally = {r["verdict"]: r["n"] for r in el.verdict_groups(records, answers).collect()}
        assert got[p["profile_id"]] == tuple(tally.get(v, 0) for v in ("eligible", "unknown", "excluded"))


def test_cross_match_of_every_kind_of_field(spark):
    """Nulls in lists, bans, floors alone, flags and wildcards, against each pair judged by itself."""
    rng = random.Random(11)
    lists = {"citizenship": "cp", "residency": "xyz", "program": "efg", "year": "123", "level": "ug", "identity": "wk"}
    some = lambda xs, gaps: [rng.choice([*xs, None] if gaps else xs) for _ in range(rng.randint(0, 3))]
    requirements = ["{}", "{}"]
    for i in range(60):
        r = {f: need(some(lists[f], i % 3 == 0), rng.choice([0.5, 0.9])) for f in lists if rng.random() < .2}
        if rng.random() < .3:
            r["program_excluded"] = need(some("efg", i % 4 == 0), rng.choice([0.5, 0.9]))
        if rng.random() < .2:
            r["program"] = need(["any", "e"], 0.9)
        if rng.random() < .4:
            r["gpa_min"] = need(rng.choice([60, 70.5, 80, "high", "75"]), rng.choice([0.5, 0.9]))
        if rng.random() < .3:
            r["financial_need"] = need(rng.choice([True, False, 0, ["yes"]]), rng.choice([0.5, 0.9]))
        requirements.append(json.dumps(r))
    requirements += [json.dumps({"gpa_min": need(g, c)}) for g in (50, 65, 90) for c in (0.5, 0.9)]
    requirements += [json.dumps({"program_excluded": need(v, 0.9)}) for v in (["e"], ["e", None], [])]
    profiles = [{
        "profile_id": str(i % 50), **{f: rng.choice([None, some(lists[f], i % 5 == 0)]) for f in lists},
        "institution": None, "gpa": rng.choice([None, 59.0, 65.0, 70.5, 99.0]),
        "financial_need": rng.choice([None, True, False]), "full_time": None} for i in range(60)]
    records = spark.createDataFrame([(r,) for r in requirements], "j string").select(parse_eligibility("j").alias("eligibility"))
    people = spark.createDataFrame(profiles, PROFILE)
    pairs = people.withColumn("row", F.monotonically_increasing_id()).crossJoin(records)
    count = lambda v: F.count(F.when(F.col("verdict") == v, 1))
    want = el.with_verdict(pairs, "eligibility", el.column_answers()).groupBy("row", "profile_id").agg(
        count("eligible"), count("unknown"), count("excluded")).drop("row")
    got = el.profile_cross_match(people, records)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    empty = el.profile_cross_match(people, records.limit(0)).collect()
    assert len(empty) == 60 and all(tuple(r)[1:] == (0, 0, 0) for r in empty)


def test_category_union_is_order_free(spark):
    pages = ["efc-scholarships-for-ontario", "efc-scholarships-for-women", "efc-scholarships-for-quebec", "no-such-page"]
    seen = set()
    for order in itertools.permutations(pages):
        df = spark.createDataFrame([("x", p) for p in order], "slug string, page string")
        row = el.from_categories(df, "https://c.example.org/").first()
        seen.add((tuple(row["affiliations"]), tuple(row["eligibility"]["residency"]["values"]), row["eligibility"]["identity"]["src"]))
    assert seen == {(("Women",), ("ON", "QC"),
                     "Listed by Electro-Federation Canada under https://c.example.org/efc-scholarships-for-women/")}


def test_lean_verdict_agrees_with_reasons(spark):
    df = spark.createDataFrame([(json.dumps({"residency": need(["ON"], c), "gpa_min": need(g)}),) for c in (.1, .9) for g in (50, 99)],
                               "j string").withColumn("eligibility", parse_eligibility("j")).withColumn("application_type", F.lit(None).cast("string"))
    a = [r["verdict"] for r in el.match_profile(df, FULL).collect()]
    b = [r["verdict"] for r in el.with_verdict(df, "eligibility", el.literal_answers(FULL)).collect()]
    assert a == b == ["unknown", "excluded", "excluded", "excluded"]
