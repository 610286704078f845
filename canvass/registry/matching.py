"""Three-state eligibility."""

from canvass.operators import eligibility as el
from canvass.operators import lookups, pages, record
from canvass.registry.base import *  # noqa: F403
from canvass.registry.base import (C, F, REGISTRY_CTE, aj, q, query, records, registry, rows, sql_aj, standin, with_records)

PAIR_CTE = (standin.cte("rows", "profiles")
            + ", pairs as (select *, source_id || ':' || native_id as award_uid from rows_ join profiles on o_custkey = c_custkey)")
SETS = [("citizenship", "p_citizenship"), ("residency", "p_residency"), ("institution", "p_institution"),
        ("year", "p_year"), ("level", "p_level"), ("identity", "p_identity")]


def _field(name, answer):
    need = f"string_split(e_{name}, ',')"
    hit = f"list_contains({need}, {answer})" + (" or e_institution = 'any_canadian'" if name == "institution" else "")
    return (f"case when e_{name} is null then null when {answer} is null then 'unknown' when {hit} then 'eligible' "
            "when conf >= 0.75 then 'excluded' else 'unknown' end")


VERDICTS = {n: _field(n, p) for n, p in SETS}
VERDICTS["program_excluded"] = (
    "case when e_program_excluded is null then null when p_program is null then 'unknown' "
    "when not list_contains(string_split(e_program_excluded, ','), p_program) then 'eligible' "
    "when conf >= 0.75 then 'excluded' else 'unknown' end")
VERDICTS["gpa_min"] = ("case when e_gpa_min is null then null when p_gpa is null then 'unknown' when p_gpa >= e_gpa_min then 'eligible' "
                       "when conf >= 0.75 then 'excluded' else 'unknown' end")
VERDICTS["financial_need"] = (
    "case when e_financial_need is null then null when p_financial_need is null then 'unknown' "
    "when cast(e_financial_need as boolean) = p_financial_need then 'eligible' when conf >= 0.75 then 'excluded' else 'unknown' end")
ORDER = [f[0] for f in C.ELIGIBILITY_FIELDS if f[0] in VERDICTS]
FIELD_COLS = ", ".join(f"{VERDICTS[f]} as v_{f}" for f in ORDER)
ANY = lambda v: "(" + " or ".join(f"coalesce(v_{f} = '{v}', false)" for f in ORDER) + ")"
NOTHING = " and ".join(f"v_{f} is null" for f in ORDER)
VERDICT = (f"case when {NOTHING} then 'unknown' when {ANY('excluded')} then 'excluded' when {ANY('unknown')} then 'unknown' "
           "else 'eligible' end")
JUDGED = f"{PAIR_CTE}, judged as (select *, {FIELD_COLS} from pairs)"


def pairs(spark, sf):
    """Every record with the answer sheet of its own customer: an equi-join."""
    r = rows(spark, sf).select(
        "award_uid", "o_custkey", "application_type", record.parse_eligibility("eligibility_json").alias("eligibility"))
    return r.join(standin.profiles(spark, sf), F.col("o_custkey") == F.col("c_custkey"))


def entry(name):
    return F.try_element_at(F.col("eligibility"), F.lit(name))


def one_field(spark, sf, name):
    spec = next(f for f in C.ELIGIBILITY_FIELDS if f[0] == name)
    result = el.field_result(spec, entry(name), F.col(spec[2]))
    return pairs(spark, sf).select("award_uid", result["verdict"].alias("verdict")).where("verdict is not null")


def field_sql(name):
    return f"{JUDGED} select award_uid, v_{name} as verdict from judged where v_{name} is not null"


@query("elig_set_overlap", field_sql("residency"))
def elig_set_overlap(spark, sf):
    return one_field(spark, sf, "residency")


@query("elig_set_exclude", field_sql("program_excluded"))
def elig_set_exclude(spark, sf):
    return one_field(spark, sf, "program_excluded")


@query("elig_at_least", field_sql("gpa_min"))
def elig_at_least(spark, sf):
    return one_field(spark, sf, "gpa_min")


@query("elig_must_be", field_sql("financial_need"))
def elig_must_be(spark, sf):
    return one_field(spark, sf, "financial_need")


@query("elig_unstated", f"{PAIR_CTE} select award_uid, " + ", ".join(
    f"e_{f} is null as no_{f}" for f in ("residency", "gpa_min", "financial_need")) + " from pairs")
def elig_unstated(spark, sf):
    no = lambda f: (entry(f).isNull() | el.unstated(entry(f))).alias(f"no_{f}")
    return pairs(spark, sf).select("award_uid", no("residency"), no("gpa_min"), no("financial_need"))


@query("elig_unanswered", f"{PAIR_CTE} select award_uid, p_residency is null as residency, p_identity is null as identity, "
       "p_gpa is null as gpa from pairs")
def elig_unanswered(spark, sf):
    return pairs(spark, sf).select(
        "award_uid", el.unanswered(F.col("residency"), True).alias("residency"),
        el.unanswered(F.col("identity"), True).alias("identity"), el.unanswered(F.col("gpa"), False).alias("gpa"))


@query("elig_verdict", f"{JUDGED} select award_uid, {VERDICT} as verdict from judged")
def elig_verdict(spark, sf):
    return el.with_verdict(pairs(spark, sf), "eligibility", el.column_answers()).select("award_uid", "verdict")


def _listing(x, quoted=True):
    items = f"list_transform(list_sort(string_split({x}, ',')), lambda x: '''' || x || '''')" if quoted else (
        f"list_sort(string_split({x}, ','))")
    return f"'[' || array_to_string({items}, ', ') || ']'"


def _reason(f):
    answer = dict(SETS).get(f)
    silent = f"'{f}: award requires this; your profile does not say. Stated {f}.'"
    if answer:
        quoted = f != "year"
        none = f"when {answer} = 'none' then '{f}: requires ' || {_listing('e_' + f)} || '; you indicated none apply. Stated {f}.' " \
            if f == "identity" else ""
        text = (f"case {none}when true then '{f}: requires ' || {_listing('e_' + f, quoted)} || ', you have ' || "
                f"{_listing(answer, quoted)} || '. Stated {f}.' end")
    elif f == "program_excluded":
        answer, text = "p_program", f"'{f}: explicitly excludes ' || {_listing('p_program')} || '. Stated {f}.'"
    elif f == "gpa_min":
        answer = "p_gpa"
        text = (f"'{f}: requires ' || cast(e_gpa_min as varchar) || ', you have ' || cast(cast(p_gpa as bigint) as varchar) || "
                f"'. Stated {f}.'")
    else:
        answer = "p_financial_need"
        cap = lambda x: f"case when cast({x} as boolean) then 'True' else 'False' end"
        text = f"'{f}: requires ' || {cap('e_' + f)} || ', you have ' || {cap(answer)} || '. Stated {f}.'"
    return f"case when v_{f} is null or v_{f} = 'eligible' then null when {answer} is null then {silent} else {text} end"


NOTE = ("case when application_type <> 'open' then 'Not an open application: ' || replace(application_type, '_', ' ') || '.' end")
REASONS = (f"case when {NOTHING} then '{el.NO_DATA}' else concat_ws(' | ', " + ", ".join(_reason(f) for f in ORDER)
           + f", case when {VERDICT} = 'eligible' then {NOTE} end) end")
NAMES = lambda v: "concat_ws(',', " + ", ".join(f"case when v_{f} = '{v}' then '{f}' end" for f in ORDER) + ")"


@query("elig_reasons", f"{JUDGED} select award_uid, {REASONS} as reasons, {NAMES('unknown')} as unknown_fields, "
       f"{NAMES('excluded')} as excluded_fields from judged")
def elig_reasons(spark, sf):
    m = el.match(pairs(spark, sf), "eligibility", el.column_answers(), "application_type")
    return m.select("award_uid", F.array_join("reasons", " | ").alias("reasons"),
                    F.array_join("unknown_fields", ",").alias("unknown_fields"),
                    F.array_join("excluded_fields", ",").alias("excluded_fields"))


@query("nomination_note", f"{JUDGED} select award_uid, {NOTE} as note from judged where {VERDICT} = 'eligible' and application_type <> 'open'")
def nomination_note(spark, sf):
    m = el.match(pairs(spark, sf), "eligibility", el.column_answers())
    noted = m.withColumn("n", el.nomination_note(F.col("verdict"), F.col("application_type")))
    return noted.where(F.size("n") > 0).select("award_uid", F.element_at("n", 1).alias("note"))


# stored JSON with one slip per kind, by order key
BROKEN = {
    0: ('{"residency": {"value": ["Alberta"], "confidence": 0.9, "src": "x"}}', "residency", "value not in vocabulary"),
    1: ('{"favourite_colour": {"value": ["red"], "confidence": 1.0, "src": "x"}}', "favourite_colour", "unknown field"),
    2: ('{"year": {"value": [2, 9], "confidence": 1.0, "src": "x"}}', "year", "year not 0..6"),
    3: ('{"gpa_min": {"value": 400, "confidence": 1.0, "src": "x"}}', "gpa_min", "gpa_min not 0..100"),
    4: ('{"identity": {"value": ["women"], "confidence": "high", "src": "x"}}', "identity", "confidence outside 0..1"),
    5: ('{"level": {"value": ["graduate"], "confidence": 1.5, "src": "x"}}', "level", "confidence outside 0..1"),
    6: ('{"program": {"confidence": 0.5, "src": "x"}}', "program", "missing value"),
    7: ('{"program": {"value": ["arts"], "confidence": 0.5}}', "program", "missing src"),
    8: ('{"full_time": true}', "full_time", "not an object"),
    9: ('{"citizenship": {"value": ["citizen"], "confidence": 0.8, "src": "x"}, "year": {"value": [0], "confidence": 1, "src": "y"}}',
        None, None),
}


@query("elig_validate", "select o_orderkey, case o_orderkey % 10 " + " ".join(
    f"when {k} then {q(f)}" for k, (_, f, _p) in BROKEN.items() if f) + " end as field, case o_orderkey % 10 " + " ".join(
    f"when {k} then {q(p)}" for k, (_, _f, p) in BROKEN.items() if p) + " end as problem from orders where o_orderkey % 10 <> 9")
def elig_validate(spark, sf):
    chain = None
    for k, (text, _, _) in BROKEN.items():
        cond = F.col("o_orderkey") % 10 == k
        chain = F.when(cond, text) if chain is None else chain.when(cond, text)
    stored = standin.table(spark, sf, "orders").select("o_orderkey", chain.alias("j"))
    return el.validate(stored, "o_orderkey", "j")


PAGES = sorted(C.CATEGORY_PAGES)
PAGE_OF = "case l_suppkey % 9 " + " ".join(f"when {i} then '{p}'" for i, p in enumerate(PAGES)) + " else 'other-page' end"
BASE = "https://catalogue.example.org/lists/"
TAGS = f"tags as (select distinct l_orderkey as slug, {PAGE_OF} as page from lineitem), known as (select slug, list_sort(list(page)) as pages " \
       "from tags where page <> 'other-page' group by slug)"


def tags(spark, sf):
    return standin.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("slug"), F.expr(PAGE_OF).alias("page"))


def _sql_values(key):
    table = " ".join(f"when '{p}' then [{', '.join(q(v) for v in C.CATEGORY_PAGES[p].get(key, []))}]"
                     for p in PAGES if C.CATEGORY_PAGES[p].get(key))
    return f"list_sort(list_distinct(flatten(list_transform(pages, lambda p: case p {table} else [] end))))"


def _sql_src(words):
    return ("array_to_string(list_transform(list_filter(pages, lambda p: regexp_matches(p, '" + "|".join(words)
            + f"')), lambda p: '{BASE}' || p || '/'), ', ')")


@query("category_tags", f"with {TAGS} select slug, array_to_string(pages, ',') as pages from known")
def category_tags(spark, sf):
    return pages.category_tags(tags(spark, sf)).select("slug", F.array_join("pages", ",").alias("pages"))


@query("elig_from_categories",
       f"with {TAGS} select slug, array_to_string({_sql_values('residency')}, ',') as residency, "
       f"array_to_string({_sql_values('identity')}, ',') as identity, "
       f"case when len({_sql_values('residency')}) > 0 then 'Listed by Electro-Federation Canada under ' || {_sql_src(C.RESIDENCY_PAGE_WORDS)} end as residency_src, "
       f"case when len({_sql_values('identity')}) > 0 then cast(0.9 as double) end as identity_conf, "
       "array_to_string(list_sort(list_filter(list_transform(pages, lambda p: case p when 'efc-scholarships-for-women' then 'Women' "
       "when 'efc-scholarships-for-indigenous-students' then 'Indigenous' when 'efc-scholarships-for-people-of-colour' then 'People of colour' end), "
       "lambda a: a is not null)), ',') as affiliations from known")
def elig_from_categories(spark, sf):
    got = el.from_categories(tags(spark, sf), BASE)
    e = lambda f: F.try_element_at(F.col("eligibility"), F.lit(f))
    text = lambda f: F.coalesce(aj(e(f)["values"]), F.lit(""))
    return got.select("slug", text("residency").alias("residency"), text("identity").alias("identity"),
                      e("residency")["src"].alias("residency_src"), e("identity")["confidence"].alias("identity_conf"),
                      aj("affiliations").alias("affiliations"))


REGION_OF = "case l_suppkey % 6 when 0 then 'ON' when 1 then 'QC' when 2 then 'AB' when 3 then 'BC' when 4 then 'Nowhere' else 'SK' end"


@query("residency_union", f"with r as (select l_orderkey, l_linenumber as place, {REGION_OF} as region from lineitem) select l_orderkey, "
       "array_to_string(list(region order by place, region), ',') as regions from (select l_orderkey, region, min(place) as place from r group by all) group by 1")
def residency_union(spark, sf):
    t = standin.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.expr(REGION_OF).alias("region"))
    return lookups.residency_union(t, "l_orderkey", "l_linenumber").select("l_orderkey", F.array_join("regions", ",").alias("regions"))


@query("elig_flatten", f"{standin.cte('rows')} select o_orderkey, {sql_aj(chr(39).join(['string_split(e_residency, ', ',', ')']))} as residency, "
       f"{sql_aj(chr(39).join(['string_split(e_identity, ', ',', ')']))} as identity, cast(e_gpa_min as double) as gpa_min, "
       "cast(e_financial_need as boolean) as financial_need from rows_")
def elig_flatten(spark, sf):
    r = rows(spark, sf).select("o_orderkey", record.parse_eligibility("eligibility_json").alias("eligibility"))
    return el.flatten(r).select("o_orderkey", aj("residency").alias("residency"), aj("identity").alias("identity"), "gpa_min",
                                "financial_need")


def registry_with_defaults(spark):
    reg = registry(spark)
    home = F.from_json(F.concat(
        F.lit('{"institution": {"values": ["home-'), F.col("source_id"),
        F.lit('"], "confidence": 1.0, "src": "Implicit."}, "residency": {"values": ["ON"], "confidence": 0.5, "src": "Source."}}')),
        schema_of_defaults())
    return reg.withColumn("defaults", F.when(F.col("delivery") == "core", home))


def schema_of_defaults():
    from canvass.schema import ELIGIBILITY

    return ELIGIBILITY


@query("defaults_under_record",
       f"{standin.cte('rows')} select o_orderkey, coalesce(e_institution, case when source_id in ('s0', 's4') then 'home-' || source_id end) as institution, "
       "coalesce(e_residency, case when source_id in ('s0', 's4') then 'ON' end) as residency, "
       "case when e_residency is not null then conf when source_id in ('s0', 's4') then 0.5 end as residency_conf from rows_")
def defaults_under_record(spark, sf):
    r = rows(spark, sf).select("o_orderkey", "source_id", record.parse_eligibility("eligibility_json").alias("eligibility"))
    merged = lookups.defaults_under_record(r, registry_with_defaults(spark))
    values = lambda f: F.array_join(entry(f)["values"], ",")
    return merged.select("o_orderkey", values("institution").alias("institution"), values("residency").alias("residency"),
                         entry("residency")["confidence"].alias("residency_conf"))


PERSON = {"citizenship": ["citizen"], "residency": ["AB"], "institution": ["inst-2"], "program": ["engineering"], "year": [3],
          "level": ["undergraduate"], "identity": ["none"], "gpa": 78.0, "financial_need": False}
PERSON_SQL = ("select *, 'citizen' as p_citizenship, 'AB' as p_residency, 'inst-2' as p_institution, 'engineering' as p_program, "
              "'3' as p_year, 'undergraduate' as p_level, 'none' as p_identity, 78.0 as p_gpa, false as p_financial_need from rows_")


@query("verdict_groups", f"{standin.cte('rows')}, p as ({PERSON_SQL}), judged as (select *, {FIELD_COLS} from p) "
       f"select {VERDICT} as verdict, count(*) as n from judged group by 1")
def verdict_groups(spark, sf):
    r = rows(spark, sf).select(record.parse_eligibility("eligibility_json").alias("eligibility"))
    return el.verdict_groups(r, PERSON)


E_COLS = ", ".join(f"e_{f}" for f in ORDER)
P_COLS = "p_citizenship, p_residency, p_institution, p_program, p_year, p_level, p_identity, p_gpa, p_financial_need"


@query("profile_cross_match",
       f"{standin.cte('rows', 'profiles')}, s as (select conf, {E_COLS}, count(*) as n from rows_ group by all), "
       f"a as (select distinct {P_COLS} from profiles), j as (select *, {FIELD_COLS} from a, s), "
       f"v as (select {P_COLS}, {VERDICT} as verdict, sum(n) as n from j group by all), "
       f"t as (select {P_COLS}, coalesce(sum(n) filter (verdict = 'eligible'), 0) as n_eligible, "
       "coalesce(sum(n) filter (verdict = 'unknown'), 0) as n_unknown, coalesce(sum(n) filter (verdict = 'excluded'), 0) as n_excluded "
       "from v group by all) select profile_id, cast(n_eligible as bigint) as n_eligible, cast(n_unknown as bigint) as n_unknown, "
       "cast(n_excluded as bigint) as n_excluded from profiles p join t on "
       + " and ".join(f"p.{c} is not distinct from t.{c}" for c in P_COLS.split(", ")))
def profile_cross_match(spark, sf):
    r = rows(spark, sf).select(F.coalesce(
        record.parse_eligibility("eligibility_json"), F.from_json(F.lit("{}"), schema_of_defaults())).alias("eligibility"))
    return el.profile_cross_match(standin.profiles(spark, sf), r)
