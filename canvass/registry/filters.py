"""Filters and counts over the catalogue."""

from pyspark.sql import Window

from canvass.functions import money
from canvass.functions.text import str_array
from canvass.operators import counts, facets, lookups
from canvass.registry.base import *  # noqa: F403
from canvass.registry.base import C, F, aj, query, records, rows, sql_aj, with_records

R = with_records()
AREAS = ["Brand 3 Engineering", "Engineering Faculty - All Programs", "All Programs"]
AREAS_SQL = "['Brand 3 Engineering', 'Engineering Faculty - All Programs', 'All Programs']"


def _uids(df):
    return df.select("award_uid")


@query("facet_values", f"{R} select award_uid, {sql_aj('levels')} as levels, {sql_aj('affiliations')} as affiliations, "
       "coalesce(career, '') as career from records")
def facet_values(spark, sf):
    r = records(spark, sf)
    v = lambda k: aj(facets.facet_values(facets.BY_KEY[k])).alias(k)
    return r.select("award_uid", v("levels"), v("affiliations"), v("career"))


@query("facet_list", f"{R} select award_uid from records where len(areas_of_study) = 0 "
       f"or list_has_any(areas_of_study, {AREAS_SQL})")
def facet_list(spark, sf):
    return _uids(records(spark, sf).where(facets.pass_list("areas_of_study", AREAS)))


@query("facet_scalar", f"{R} select award_uid from records where career is null or career = 'Undergraduate'")
def facet_scalar(spark, sf):
    return _uids(records(spark, sf).where(facets.pass_scalar("career", ["Undergraduate"])))


@query("facet_range", f"{R} select award_uid, amount_max from records where amount_max >= 2000 and amount_max <= 9000")
def facet_range(spark, sf):
    return records(spark, sf).where(facets.predicate(facets.BY_KEY["amount_max"], {"min": 2000, "max": 9000})).select(
        "award_uid", "amount_max")


@query("facet_bool", f"{R} select award_uid from records where deadline_date is not null and deadline_date <> ''")
def facet_bool(spark, sf):
    return _uids(records(spark, sf).where(facets.pass_bool("deadline_date", True)))


@query("facet_tag_browse", f"{R} select award_uid from records where list_has_any(affiliations, ['Women', 'Black'])")
def facet_tag_browse(spark, sf):
    return _uids(records(spark, sf).where(facets.pass_tag("affiliations", ["Women", "Black"])))


@query("facet_tag_profile", f"{R} select award_uid from records where len(affiliations) = 0 "
       "or list_has_any(affiliations, ['Women', 'Black'])")
def facet_tag_profile(spark, sf):
    return _uids(records(spark, sf).where(facets.pass_tag("affiliations", ["Women", "Black"], facets.PROFILE)))


@query("facet_gate", f"{R} select award_uid from records where len(affiliations) = 0 "
       "or list_contains(affiliations, 'Indigenous')")
def facet_gate(spark, sf):
    return _uids(records(spark, sf).where(facets.pass_gate("affiliations", ["Indigenous"])))


SELECTION = {
    "career": ["Undergraduate"], "level": ["UG Year 2", "UG Year 3"], "areaOfStudy": AREAS,
    "awardType": ["Entrepreneurial"], "applicationStatus": ["Open"], "amount": {"min": 500}, "hasDeadline": True,
}
SELECTION_SQL = (
    "(career is null or career = 'Undergraduate') and (len(levels) = 0 or list_has_any(levels, ['UG Year 2', 'UG Year 3'])) "
    f"and (len(areas_of_study) = 0 or list_has_any(areas_of_study, {AREAS_SQL})) "
    "and (len(award_types) = 0 or list_contains(award_types, 'Entrepreneurial')) "
    "and (application_status is null or application_status = 'Open') and amount_max >= 500 and deadline_date is not null")


@query("structured_filters", f"{R} select award_uid, amount_max from records where {SELECTION_SQL}")
def structured_filters(spark, sf):
    return facets.structured_filters(records(spark, sf), SELECTION).select("award_uid", "amount_max")


FIRST_SQL = (
    "coalesce(try_cast(replace(regexp_extract(award_value_description, '\\$\\s?([\\d,]+)', 1), ',', '') as bigint), "
    "try_cast(replace(regexp_extract(award_description, '\\$\\s?([\\d,]+)', 1), ',', '') as bigint))")
REQUEST = {
    "career": ["Undergraduate"], "level": ["UG Year 1"], "term": ["Fall"], "affiliation": ["Women"],
    "areaOfStudy": AREAS, "applicationStatus": ["Open"], "min_value": 100,
}
REQUEST_SQL = (
    "(career is null or career = 'Undergraduate') and (len(levels) = 0 or list_contains(levels, 'UG Year 1')) "
    "and (len(terms) = 0 or list_contains(terms, 'Fall')) "
    f"and (len(areas_of_study) = 0 or list_has_any(areas_of_study, {AREAS_SQL})) "
    "and (len(affiliations) = 0 or list_contains(affiliations, 'Women')) "
    "and (application_status is null or application_status = 'Open')")


@query("profile_filters", f"{R} select award_uid from records where {REQUEST_SQL} and {FIRST_SQL} >= 100")
def profile_filters(spark, sf):
    return _uids(facets.profile_filters(records(spark, sf), REQUEST))


@query("min_value", f"{R} select award_uid, {FIRST_SQL} as value from records where {FIRST_SQL} >= 1000")
def min_value(spark, sf):
    return records(spark, sf).where(facets.min_value(1000)).select(
        "award_uid", money.first_dollar("award_value_description", "award_description").alias("value"))


@query("default_status", f"{R} select application_status, count(*) as n from records "
       "where application_status is null or application_status = 'Open' group by 1")
def default_status(spark, sf):
    chosen = facets.predicate(facets.BY_KEY["application_status"], facets.default_status())
    return records(spark, sf).where(chosen).groupBy("application_status").agg(F.count(F.lit(1)).alias("n"))


PROFILE_AREAS = ("case when c_mktsegment = 'AUTOMOBILE' then cast([] as varchar[]) else [c_mktsegment || ' Studies'] end")
PROFILE_FACS = ("case when c_custkey % 3 = 0 then ['Engineering'] else cast([] as varchar[]) end")


@query("effective_areas",
       f"with p as (select c_custkey, {PROFILE_AREAS} as a, {PROFILE_FACS} as f from customer), "
       "e as (select c_custkey, list_concat(a, list_transform(f, lambda x: x || ' Faculty - All Programs')) as l from p) "
       "select c_custkey, array_to_string(list_sort(case when len(l) > 0 then list_append(l, 'All Programs') else l end), ',')"
       " as areas from e")
def effective_areas(spark, sf):
    c = rows_customer(spark, sf)
    return c.select("c_custkey", aj(facets.effective_areas("areas", "faculties")).alias("areas"))


def rows_customer(spark, sf):
    from canvass.sources import standin

    none = F.array().cast("array<string>")
    return standin.table(spark, sf, "customer").select(
        "c_custkey",
        F.when(F.col("c_mktsegment") == "AUTOMOBILE", none).otherwise(F.array(F.concat("c_mktsegment", F.lit(" Studies"))))
        .alias("areas"),
        F.when(F.col("c_custkey") % 3 == 0, F.array(F.lit("Engineering"))).otherwise(none).alias("faculties"))


VOCAB = ["All Programs", "Engineering Faculty - All Programs", "Brand 3 Engineering"]


@query("expand_areas",
       f"{R}, a as (select award_uid, areas_of_study as l, "
       "list_concat(case when not list_contains(areas_of_study, 'All Programs') then ['All Programs'] else cast([] as varchar[]) end, "
       "case when len(list_filter(areas_of_study, lambda x: x like '%Engineering')) > 0 "
       "and not list_contains(areas_of_study, 'Engineering Faculty - All Programs') "
       "then ['Engineering Faculty - All Programs'] else cast([] as varchar[]) end) as more from records) "
       "select award_uid, array_to_string(case when len(l) = 0 or len(more) = 0 then l "
       "else list_concat(l[1:30 - len(more)], more) end, '|') as areas from a")
def expand_areas(spark, sf):
    return records(spark, sf).select(
        "award_uid", F.array_join(facets.expand_areas("areas_of_study", VOCAB), "|").alias("areas"))


@query("quick_match",
       f"{with_records('profiles')}, p as (select c_custkey, case p_level when 'undergraduate' then 'Undergraduate' "
       "when 'graduate' then 'Graduate' end as pc, case when p_year in ('1', '2', '3') then 'UG Year ' || p_year end as pl "
       "from profiles) select award_uid from records join p on o_custkey = c_custkey "
       "where (pc is null or career is null or pc = career) and (pl is null or len(levels) = 0 or list_contains(levels, pl))")
def quick_match(spark, sf):
    from canvass.sources import standin

    p = standin.profiles_raw(spark, sf).select(
        "c_custkey",
        F.when(F.col("p_level") == "undergraduate", "Undergraduate").when(F.col("p_level") == "graduate", "Graduate")
        .alias("pc"),
        F.when(F.col("p_year").isin("1", "2", "3"), F.concat(F.lit("UG Year "), "p_year")).alias("pl"))
    keys = rows(spark, sf).select("award_uid", "o_custkey")
    r = records(spark, sf).select("award_uid", "career", "levels", "areas_of_study")
    joined = r.join(keys, "award_uid").join(p, F.col("o_custkey") == F.col("c_custkey"))
    return _uids(joined.where(facets.quick_match("pc", "pl", F.array().cast("array<string>"))))


ACTIVE_SQL = " union all ".join(
    f"select '{f['key']}' as facet, "
    + (f"count(*) filter ({f['key']} is not null)" if f["kind"] != "list" else f"count(*) filter (len({f['key']}) > 0)")
    + " as n_stated from records" for f in C.FACETS)


@query("active_facets", f"{R}, a as ({ACTIVE_SQL}) select facet, n_stated, n_stated > 0 as active from a")
def active_facets(spark, sf):
    return counts.active_facets(records(spark, sf))


@query("needs_detail", f"{R} select award_uid from records where application_status is null or application_status <> 'Ended'")
def needs_detail(spark, sf):
    return _uids(records(spark, sf).where(facets.needs_detail()))


STRICT = {"career": ["Undergraduate"], "level": ["UG Year 3"], "term": ["Fall"], "areaOfStudy": AREAS}
STRICT_SQL = (
    "career = 'Undergraduate' and list_contains(levels, 'UG Year 3') and list_contains(terms, 'Fall') "
    f"and list_has_any(areas_of_study, {AREAS_SQL}) and len(affiliations) = 0")


@query("strict_filters", f"{R} select award_uid from records where {STRICT_SQL}")
def strict_filters(spark, sf):
    return _uids(facets.strict_filters(records(spark, sf), STRICT))


@query("no_record_lost",
       f"{R}, relaxed as (select award_uid from records where (career is null or career = 'Undergraduate') "
       "and (len(levels) = 0 or list_contains(levels, 'UG Year 3')) and (len(terms) = 0 or list_contains(terms, 'Fall')) "
       f"and (len(areas_of_study) = 0 or list_has_any(areas_of_study, {AREAS_SQL})) and len(affiliations) >= 0), "
       f"strict_ as (select award_uid from records where {STRICT_SQL}) "
       "select (select count(*) from strict_) as n_strict, (select count(*) from relaxed) as n_relaxed, "
       "(select count(*) from strict_ where award_uid not in (select award_uid from relaxed)) as n_lost")
def no_record_lost(spark, sf):
    """One pass: both predicates are evaluated on the same row."""
    r = records(spark, sf)
    relaxed = facets.all_of([
        facets.predicate(facets.BY_FILTER_KEY[k], v, facets.PROFILE) for k, v in STRICT.items()])
    strict = facets.strict_filters(r, STRICT)
    kept = r.where(relaxed)
    lost = strict.select("award_uid").exceptAll(kept.select("award_uid"))
    n = lambda df: df.agg(F.count(F.lit(1)).alias("n")).scalar()
    return spark.range(1).select(n(strict).alias("n_strict"), n(kept).alias("n_relaxed"), n(lost).alias("n_lost"))


# --- counts ---------------------------------------------------------------------
_LISTS = ["levels", "areas_of_study", "affiliations", "award_types", "terms"]
_SCALARS = ["career", "source_id", "application_status", "application_type"]
PAIRS_SQL = " union all ".join(
    [f"select '{f}' as facet, unnest({f}) as value, source_id from records" for f in _LISTS]
    + [f"select '{f}' as facet, {f} as value, source_id from records where {f} is not null" for f in _SCALARS])


@query("facet_counts", f"{R}, p as ({PAIRS_SQL}) select facet, value, count(*) as n from p group by 1, 2")
def facet_counts(spark, sf):
    return counts.facet_counts(records(spark, sf))


@query("facet_counts_core", f"{R}, p as ({PAIRS_SQL}) select facet, value, count(*) as n, "
       "count(*) filter (source_id in ('s0', 's4')) as n_core from p group by 1, 2")
def facet_counts_core(spark, sf):
    return counts.facet_counts_split(records(spark, sf), F.col("source_id").isin("s0", "s4"))


@query("facet_range_bounds", f"{R} select min(amount_max) as low, max(amount_max) as high from records")
def facet_range_bounds(spark, sf):
    return counts.facet_range_bounds(records(spark, sf), "amount_max")


@query("facet_groups", f"{R}, p as ({PAIRS_SQL}) select case when value like '%Faculty - All Programs%' or value = 'All Programs' "
       "then 'Faculty-wide' else 'Specific programs' end as group_name, value, count(*) as n from p "
       "where facet = 'areas_of_study' group by 1, 2")
def facet_groups(spark, sf):
    return counts.facet_groups(counts.facet_counts(records(spark, sf)))


@query("facet_unique_values", f"{R} select distinct unnest(areas_of_study) as value from records")
def facet_unique_values(spark, sf):
    return counts.facet_unique_values(records(spark, sf), "areas_of_study").orderBy("value")


@query("facet_order", f"{R}, p as ({PAIRS_SQL}), c as (select facet, value, count(*) as n from p group by 1, 2) "
       "select facet, value, n, row_number() over (partition by facet order by n desc, value) as pos from c")
def facet_order(spark, sf):
    counted = counts.facet_counts(records(spark, sf))
    # ranks over counted values: as many rows as the vocabulary has
    w = Window.partitionBy("facet").orderBy(F.desc("n"), "value")
    return counts.facet_order(counted).withColumn("pos", F.row_number().over(w))


HEALTH = ("health as (select source_id, count(*) as total, count(scraped_at) as scraped, count(scrape_error) as errors "
          "from rows_ group by 1)")


@query("source_health", f"{R}, {HEALTH} select * from health")
def source_health(spark, sf):
    return counts.source_health(rows(spark, sf))


@query("corpus_totals", f"{R}, {HEALTH} select cast(sum(total) as bigint) as total, cast(sum(scraped) as bigint) as scraped, "
       "cast(sum(errors) as bigint) as errors from health")
def corpus_totals(spark, sf):
    return counts.corpus_totals(counts.source_health(rows(spark, sf)))


@query("duplicate_keys", f"{R} select award_name, count(*) as n from records group by 1 having count(*) > 1 "
       "order by 1 limit 10")
def duplicate_keys(spark, sf):
    return counts.duplicate_keys(records(spark, sf), "award_name")


@query("slug_name_counts", f"{R} select award_name, count(*) as n from records group by 1 having count(*) > 1")
def slug_name_counts(spark, sf):
    return counts.name_counts(records(spark, sf))


@query("overlap_total", f"{R}, x as (select award_uid, unnest(levels) as level from records) "
       "select cast(count(*) as bigint) as captured, count(distinct award_uid) as distinct_records from x")
def overlap_total(spark, sf):
    captured = records(spark, sf).select("award_uid", F.explode("levels").alias("level"))
    return counts.overlap_total(captured, "award_uid")


@query("adapter_run_stats", f"{R} select source_id, count(*) as records, count(scrape_error) as detail_errors from rows_ group by 1")
def adapter_run_stats(spark, sf):
    return counts.adapter_run_stats(rows(spark, sf).withColumn("detail_error", F.col("scrape_error")))


@query("split_depth",
       f"{R}, x as (select coalesce(career, '-') as career, lv, tp, coalesce(application_type, '-') as process from records, "
       "unnest(case when len(levels) = 0 then ['-'] else levels end) as t1(lv), "
       "unnest(case when len(award_types) = 0 then ['-'] else award_types end) as t2(tp)), "
       "g1 as (select career, lv, count(*) as n from x group by all), "
       "g2 as (select career, lv, tp, count(*) as n from x group by all), "
       "g3 as (select career, lv, tp, process, count(*) as n from x group by all) "
       "select 1 as depth, career, lv, null as tp, null as process, n, false as incomplete from g1 where n <= 300 "
       "union all select 2, career, lv, tp, null, n, false from g2 where n <= 300 "
       "and (career, lv) in (select (career, lv) from g1 where n > 300) "
       "union all select 3, career, lv, tp, process, n, n > 300 from g3 "
       "where (career, lv, tp) in (select (career, lv, tp) from g2 where n > 300)")
def split_depth(spark, sf):
    some = lambda c: F.when(F.size(c) > 0, F.col(c)).otherwise(str_array(["-"]))
    captured = records(spark, sf).select(
        F.coalesce("career", F.lit("-")).alias("career"), F.explode(some("levels")).alias("lv"), "award_types",
        F.coalesce("application_type", F.lit("-")).alias("process"),
    ).withColumn("tp", F.explode(some("award_types")))
    return counts.split_depth(captured, [["career", "lv"], ["tp"], ["process"]])


@query("nocase_order", f"{R} select award_uid, row_number() over (order by lower(award_name) nulls first, award_uid) as pos from records")
def nocase_order(spark, sf):
    return lookups.nocase_order(records(spark, sf).select("award_uid", "award_name")).select("award_uid", "pos")
