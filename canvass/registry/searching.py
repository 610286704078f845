"""Ranked and fuzzy text search."""

from pyspark.sql import Window

from canvass.functions import text
from canvass.operators import facets, search
from canvass.plans import browse, find
from canvass.registry.base import *  # noqa: F403
from canvass.registry.base import C, F, aj, q, query, records, sql_aj, standin, with_records
from canvass.registry.filters import AREAS, AREAS_SQL, FIRST_SQL, REQUEST_SQL

ACC = "[À-ÅÇ-ÏÑ-ÖÙ-Ýà-åç-ïñ-öù-ýÿ]"


def sql_fold(x):
    return f"strip_accents(regexp_replace(lower(coalesce({x}, '')), '({ACC})', '\\1 ', 'g'))"


def sql_tokens(x):
    return f"list_filter(regexp_split_to_array({sql_fold(x)}, '[^a-z0-9]+'), lambda t: length(t) > 2)"


def sql_words(x):
    return f"list_distinct(regexp_split_to_array({sql_fold(x)}, '[^\\p{{L}}\\p{{N}}_]+'))"


FIELDS = list(C.FIELD_WEIGHTS)
D = standin.cte("docs")
TOKENS = f"{D}, tok as (select doc_id, list_distinct(list_concat({', '.join(sql_tokens(f) for f in FIELDS)})) as t from docs)"
DF = f"{TOKENS}, df as (select term, count(*) as df from tok, unnest(t) as u(term) group by 1)"
IDF = "greatest(0.1, least(3.0, ln((select count(*) from docs) / df)))"

TERMS = ["eau", "heit", "license", "the", "unseen", "und"]
EXCLUDE = ["avec", "token"]


@query("norm_text", f"{D} select doc_id, lower(regexp_replace(strip_accents(award_description), '[\\s\\p{{Z}}]+', ' ', 'g')) as norm from docs")
def norm_text(spark, sf):
    """The marks are dropped for the comparison: SQL can strip accents but not split them."""
    norm = text.norm_text("award_description", full=True)
    return standin.docs(spark, sf).select("doc_id", F.regexp_replace(norm, r"\p{M}", "").alias("norm"))


@query("tokenize", f"{D} select doc_id, array_to_string({sql_tokens('award_description')}, ' ') as tokens from docs")
def tokenize(spark, sf):
    return standin.docs(spark, sf).select("doc_id", F.array_join(text.tokenize("award_description"), " ").alias("tokens"))


@query("doc_frequency", f"{DF} select term, df from df")
def doc_frequency(spark, sf):
    return search.doc_frequency(standin.docs(spark, sf))


@query("idf", f"{DF} select term, round({IDF}, 6) as idf from df")
def idf(spark, sf):
    d = standin.docs(spark, sf)
    n = d.agg(F.count(F.lit(1)).alias("n")).scalar()
    return search.doc_frequency(d).select("term", F.round(search.idf("df", n), 6).alias("idf"))


WORDS = f"{DF}, w as (select *, {', '.join(f'{sql_words(f)} as w_{f}' for f in FIELDS)} from docs)"


def _idf_of(t):
    return f"coalesce((select {IDF} from df where term = '{t}'), 1.0)"


def _weight(t):
    return "(" + " + ".join(f"case when list_contains(w_{f}, '{t}') then {w} else 0 end" for f, w in C.FIELD_WEIGHTS.items()) + ")"


def _any(t):
    return "(" + " or ".join(f"list_contains(w_{f}, '{t}')" for f in FIELDS) + ")"


KEYWORD = " + ".join(f"{_weight(t)} * {_idf_of(t)}" for t in TERMS)
PENALTY = " + ".join(f"case when {_any(t)} then -1.5 else 0 end" for t in EXCLUDE)
MATCHED = "concat_ws(',', " + ", ".join(f"case when {_any(t)} then '{t}' end" for t in TERMS) + ")"
VALUE = f"case when {FIRST_SQL} > 0 then least(1.5, {FIRST_SQL} / 5000.0) else 0 end"


@query("keyword_score", f"{WORDS} select doc_id, round({KEYWORD}, 6) as score from w")
def keyword_score(spark, sf):
    d = standin.docs(spark, sf)
    return search.with_hits(d, TERMS).select(
        "doc_id", F.round(search.keyword_score(search.term_idf(d, TERMS), TERMS), 6).alias("score"))


@query("matched_terms", f"{WORDS} select doc_id, {MATCHED} as matched from w")
def matched_terms(spark, sf):
    return search.with_hits(standin.docs(spark, sf), TERMS).select(
        "doc_id", F.array_join(search.matched_terms(TERMS), ",").alias("matched"))


@query("exclude_penalty", f"{WORDS} select doc_id, round(cast({PENALTY} as double), 6) as penalty from w")
def exclude_penalty(spark, sf):
    return search.with_hits(standin.docs(spark, sf), EXCLUDE).select(
        "doc_id", F.round(search.exclude_penalty(EXCLUDE), 6).alias("penalty"))


SCORED = (f"{WORDS}, s as (select doc_id, award_uid, award_name, {FIRST_SQL} as value, "
          f"{KEYWORD} + {PENALTY} + {VALUE} as score, {MATCHED} as matched from w)")


@query("score_records", f"{SCORED} select doc_id, round(score, 6) as score, matched from s where score >= 0.5")
def score_records(spark, sf):
    d = standin.docs(spark, sf)
    s = search.score_records(d, d, TERMS, EXCLUDE, min_score=0.5)
    return s.select("doc_id", F.round("score", 6).alias("score"), F.array_join("matched", ",").alias("matched"))


@query("rank_topk", f"{SCORED} select award_uid, round(score, 6) as score, row_number() over (order by round(score, 9) desc, "
       "coalesce(value, 0) desc, coalesce(award_name, ''), award_uid) as pos from s where score >= 0 qualify pos <= 25")
def rank_topk(spark, sf):
    d = standin.docs(spark, sf)
    s = search.score_records(d, d, TERMS, EXCLUDE).withColumn("score", F.round("score", 9))
    w = Window.orderBy(F.desc("score"), F.desc(F.coalesce("value", F.lit(0))), F.coalesce("award_name", F.lit("")), "award_uid")
    return search.rank_topk(s).select("award_uid", F.round("score", 6).alias("score"), F.row_number().over(w).alias("pos"))


@query("rank_topk_per", f"{SCORED} select d.source_id, s.award_uid, row_number() over (partition by d.source_id order by round(score, 9) desc, "
       "coalesce(value, 0) desc, coalesce(s.award_name, ''), s.award_uid) as rank from s join docs d on s.award_uid = d.award_uid "
       "where score >= 0 qualify rank <= 3")
def rank_topk_per(spark, sf):
    d = standin.docs(spark, sf)
    s = search.score_records(d, d, TERMS, EXCLUDE).withColumn("score", F.round("score", 9))
    return search.rank_topk_per(s, "source_id", 3).select("source_id", "award_uid", "rank")


# --- bonuses, on the catalogue ----------------------------------------------------
PROFILE = {"career": "Undergraduate", "levels": ["UG Year 3", "UG Year 4"], "faculty": "Engineering",
           "programs": ["Brand 3 Engineering", "Brand 7 Studies"], "terms": ["Fall"], "financial_need": True,
           "affiliations": ["Women"], "interests": ["gizmo", "memory teacher"], "preferred_types": ["Entrepreneurial"],
           "exclude_keywords": ["committee"]}
R = with_records()
TIER_SQL = ("case when list_has_any(areas_of_study, ['Brand 3 Engineering', 'Brand 7 Studies']) then 'program' "
            "when list_contains(areas_of_study, 'Engineering Faculty - All Programs') then 'faculty' "
            "when list_contains(areas_of_study, 'All Programs') then 'all' else 'none' end")
BONUS_SQL = (f"case {TIER_SQL} when 'program' then 3.0 when 'faculty' then 1.0 when 'all' then 0.4 else 0 end "
             "+ case when list_contains(affiliations, 'Women') then 2 else 0 end "
             "+ case when list_contains(award_types, 'Entrepreneurial') then 2 else 0 end "
             "+ case when list_contains(award_types, 'Bursaries/Financial need') then 1.5 else 0 end "
             "- case when len(terms) > 0 and not list_contains(terms, 'Fall') then 2 else 0 end")


@query("area_match_tier", f"{R} select award_uid, {TIER_SQL} as tier from records")
def area_match_tier(spark, sf):
    return records(spark, sf).select("award_uid", search.area_match_tier(
        "areas_of_study", text.str_array(PROFILE["programs"]), text.str_array(["Engineering"])).alias("tier"))


@query("profile_bonus", f"{R} select award_uid, round(cast({BONUS_SQL} as double), 6) as bonus from records")
def profile_bonus(spark, sf):
    return records(spark, sf).select("award_uid", F.round(search.profile_bonus(PROFILE), 6).alias("bonus"))


@query("value_bonus", f"{R} select award_uid, round(cast({VALUE} as double), 6) as bonus from records")
def value_bonus(spark, sf):
    from canvass.functions import money

    v = money.first_dollar("award_value_description", "award_description")
    return records(spark, sf).select("award_uid", F.round(search.value_bonus(v), 6).alias("bonus"))


# --- a whole search: profile, filters, score, top ---------------------------------
ASK = {"query": "women award", "term": ["Winter"], "min_value": 100, "limit": 25}
FIND_FIELDS = {f: f for f in FIELDS}
CAND = ("(career is null or career = 'Undergraduate') and (len(levels) = 0 or list_has_any(levels, ['UG Year 3', 'UG Year 4'])) "
        "and (len(terms) = 0 or list_has_any(terms, ['Winter', 'Fall'])) and (len(areas_of_study) = 0 or list_has_any(areas_of_study, "
        "['Brand 3 Engineering', 'Brand 7 Studies', 'Engineering Faculty - All Programs', 'All Programs'])) "
        "and (len(affiliations) = 0 or list_contains(affiliations, 'Women')) and (application_status is null or application_status = 'Open') "
        f"and {FIRST_SQL} >= 100")
F_TERMS = ["award", "gizmo", "memory", "teacher", "women"]
F_TOK = (f"{R}, tok as (select list_distinct(list_concat({', '.join(sql_tokens(f) for f in FIELDS)})) as t from records), "
         "stat as (select count(*) as n, " + ", ".join(
             f"count(*) filter (list_contains(t, '{t}')) as d_{t}" for t in F_TERMS) + " from tok), "
         f"w as (select *, {', '.join(f'{sql_words(f)} as w_{f}' for f in FIELDS)} from records where {CAND})")
F_SCORE = " + ".join(
    f"{_weight(t)} * (select case when d_{t} = 0 then 1.0 else greatest(0.1, least(3.0, ln(n / d_{t}))) end from stat)" for t in F_TERMS)
FOUND = (f"{F_TOK}, s as (select award_uid, award_name, {FIRST_SQL} as value, {F_SCORE} + case when {_any('committee')} then -1.5 else 0 end "
         f"+ {BONUS_SQL} + {VALUE} as score from w)")


@query("find_for_profile", f"{FOUND} select award_uid, round(score, 6) as score, value, row_number() over (order by round(score, 9) desc, "
       "coalesce(value, 0) desc, coalesce(award_name, ''), award_uid) as pos from s where score >= 0 qualify pos <= 25")
def find_for_profile(spark, sf):
    stages = find.find(records(spark, sf), ASK, PROFILE)
    w = Window.orderBy(F.desc("score"), F.desc(F.coalesce("value", F.lit(0))), F.coalesce("award_name", F.lit("")), "award_uid")
    top = search.rank_topk(stages["scored"].withColumn("score", F.round("score", 9)))
    return top.select("award_uid", F.round("score", 6).alias("score"), "value", F.row_number().over(w).alias("pos"))


@query("filter_funnel", f"{FOUND} select (select count(*) from records) as total, (select count(*) from w) as after_filters, "
       "count(*) filter (score >= 0) as scored, least(count(*) filter (score >= 0), 25) as shown from s")
def filter_funnel(spark, sf):
    corpus = records(spark, sf)
    stages = find.find(corpus, ASK, PROFILE)
    return search.filter_funnel(corpus, stages["filtered"], stages["scored"], 25)


@query("query_terms",
       f"select conv_id, turn, array_to_string(list_sort(list_distinct(list_concat({sql_tokens('text')}, {sql_tokens('role')}))), ' ') as terms "
       "from conversations")
def query_terms(spark, sf):
    c = standin.table(spark, sf, "conversations")
    return c.select("conv_id", "turn", F.array_join(F.array_sort(search.terms_of("text", "role")), " ").alias("terms"))


@query("cli_profile_merge",
       f"{standin.cte('rows', 'profiles')} select o_orderkey, concat_ws(',', 'ON', p_residency) as regions, "
       "coalesce(case when o_orderkey % 2 = 0 then 'Graduate' end, p_level, '') as career from rows_ join profiles on o_custkey = c_custkey")
def cli_profile_merge(spark, sf):
    p = standin.profiles(spark, sf).select("c_custkey", "residency", F.element_at("level", 1).alias("lv"))
    asks = standin.table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    joined = asks.join(p, F.col("o_custkey") == F.col("c_custkey"))
    asked = F.when(F.col("o_orderkey") % 2 == 0, F.array(F.lit("Graduate")))
    return joined.select(
        "o_orderkey", F.array_join(search.merge_lists(F.array(F.lit("ON")), "residency"), ",").alias("regions"),
        F.array_join(search.merge_career(asked, "lv"), ",").alias("career"))


@query("profiles_scan",
       "select o_orderkey, c_mktsegment as segment, c_custkey is not null as profiled from orders left join customer "
       "on c_custkey = o_custkey and c_mktsegment <> 'MACHINERY'")
def profiles_scan(spark, sf):
    from canvass.operators import lookups

    asks = standin.table(spark, sf, "orders").select("o_orderkey", F.col("o_custkey").cast("string").alias("profile_id"))
    have = standin.table(spark, sf, "customer").where("c_mktsegment <> 'MACHINERY'").select(
        F.col("c_custkey").cast("string").alias("profile_id"), F.col("c_mktsegment").alias("segment"), F.lit(True).alias("hit"))
    joined = lookups.profiles_for_queries(asks, have)
    return joined.select("o_orderkey", "segment", F.coalesce("hit", F.lit(False)).alias("profiled"))


# --- fuzzy ------------------------------------------------------------------------
FUZZY = ["relesed", "licence"]


def _near(f, t):
    n = len(t)
    words = f"list_filter({sql_words(f)}, lambda w: w <> '' and abs(length(w) - {n}) <= 0.32 * greatest(length(w), {n}))"
    ratios = f"list_transform({words}, lambda w: levenshtein(w, '{t}') / greatest(length(w), {n}))"
    return f"coalesce(list_min(list_filter({ratios}, lambda r: r <= 0.32)), 1.0)"


def sql_fuzzy(terms, source):
    cols = ", ".join(f"({' + '.join(_near(f, t) for t in terms)}) / {len(terms)} as d_{f}" for f in C.FUZZY_WEIGHTS)
    score = " + ".join(f"{w} * (1.0 - d_{f})" for f, w in C.FUZZY_WEIGHTS.items())
    near = "least(" + ", ".join(f"d_{f}" for f in C.FUZZY_WEIGHTS) + ") <= 0.32"
    return f"fz as (select *, {cols} from {source}), hits as (select *, {score} as rank_score from fz where {near})"


@query("fuzzy_search", f"{D}, {sql_fuzzy(FUZZY, 'docs')} select doc_id, round(rank_score, 6) as rank_score from hits")
def fuzzy_search(spark, sf):
    return search.fuzzy_search(standin.docs(spark, sf), "Relesed, licence").select(
        "doc_id", F.round("rank_score", 6).alias("rank_score"))


@query("search_then_filter",
       f"{R}, c as (select * from records where (application_status is null or application_status = 'Open') "
       f"and (len(areas_of_study) = 0 or list_has_any(areas_of_study, {AREAS_SQL})) and (career is null or career = 'Undergraduate')), "
       f"{sql_fuzzy(['gizmoo', 'awrd'], 'c')} select award_uid, round(rank_score, 6) as rank_score from hits")
def search_then_filter(spark, sf):
    got = browse.search_then_filter(
        records(spark, sf), "gizmoo awrd", {"applicationStatus": facets.default_status(), "areaOfStudy": AREAS},
        {"career": "Undergraduate"})
    return got.select("award_uid", F.round("rank_score", 6).alias("rank_score"))
