"""Cleaning, parsing and derived columns."""

from pyspark.sql import Window  # noqa: F401

from canvass.functions import fields as fx
from canvass.functions import money, text
from canvass.operators import record
from canvass.registry.base import *  # noqa: F403
from canvass.registry.base import (BACKFILL, C, F, WS, aj, q, query, records, rows, sql_aj, sql_clean, sql_excerpt,
                                   sql_figures, sql_spans, sql_split, sql_strip, standin, with_records)
from canvass.registry.filters import FIRST_SQL

R = with_records()
ROWS = standin.cte("rows")


@query("award_uid", f"{ROWS} select source_id || ':' || native_id as award_uid, o_orderkey from rows_")
def award_uid(spark, sf):
    return rows(spark, sf).select(record.award_uid().alias("award_uid"), "o_orderkey")


@query("clean_scalar", f"{ROWS} select o_orderkey, {sql_clean('career')} as career, {sql_clean('affiliation')} as affiliation, "
       f"{sql_clean('award_value_description')} as value from rows_")
def clean_scalar(spark, sf):
    c = text.clean_scalar
    return rows(spark, sf).select("o_orderkey", c("career").alias("career"), c("affiliation").alias("affiliation"),
                                  c("award_value_description").alias("value"))


@query("split_multi", f"{ROWS} select o_orderkey, array_to_string({sql_split('affiliation')}, '|') as affiliations, "
       f"array_to_string({sql_split('area_of_study')}, '|') as areas from rows_")
def split_multi(spark, sf):
    s = lambda c: F.array_join(text.split_multi(c), "|")
    return rows(spark, sf).select("o_orderkey", s("affiliation").alias("affiliations"), s("area_of_study").alias("areas"))


REC_COLS = ["award_uid", "award_name", "career", "application_status", "application_type", "deadline_date", "amount_min",
            "amount_max", "amount_raw", "renewable", "additional_instructions", "eligibility_selection_criteria"]


@query("build_record", f"{R} select {', '.join(REC_COLS)}, {sql_aj('levels')} as levels, {sql_aj('terms')} as terms, "
       f"{sql_aj('areas_of_study')} as areas from records")
def build_record(spark, sf):
    return records(spark, sf).select(*REC_COLS, aj("levels").alias("levels"), aj("terms").alias("terms"),
                                     aj("areas_of_study").alias("areas"))


@query("slim_projection", f"{R} select award_id as id, award_uid as uid, source_id as src, award_name as name, career, "
       f"{sql_aj('levels')} as levels, {sql_aj('terms')} as terms, {sql_aj('award_types')} as types, "
       f"{sql_aj('affiliations')} as affiliations, {sql_aj('areas_of_study')} as areas, award_value_description as value, "
       "application_status as status from records")
def slim_projection(spark, sf):
    slim = record.slim_projection(records(spark, sf))
    lists = ["levels", "terms", "types", "affiliations", "areas"]
    return slim.select(*[aj(c).alias(c) if c in lists else F.col(c) for c in slim.columns])


# Prose in need of cleaning, made from whole documents: line ends, tabs, no-break
# spaces, lost bullets and blank runs are put in by rule.
NOBREAK, NARROW, LOST, LINE_SEP, VT = "\u00a0", "\u202f", "\ufffd", "\u2028", "\u000b"
DIRTY = ("replace(replace(replace(replace(text, '. ', '.' || chr(13) || chr(10) || chr(10) || chr(10) || chr(9) || ' '), "
         f"', ', ',{NOBREAK}{NARROW} '), ' the ', '{VT}{LOST} the  '), ' la ', '{LINE_SEP} la ')")


def sql_clean_text(x: str) -> str:
    t = f"nfc_normalize({x})"
    t = f"replace({t}, chr(65533), '')"
    t = f"translate({t}, chr(11) || chr(12) || chr(8232) || chr(8233), repeat(chr(10), 4))"
    t = f"replace(replace({t}, chr(13) || chr(10), chr(10)), chr(13), chr(10))"
    t = f"regexp_replace({t}, '[ \\t\\x{{A0}}\\x{{2007}}\\x{{202F}}]+', ' ', 'g')"
    t = f"array_to_string(list_transform(string_split({t}, chr(10)), lambda l: {sql_strip('l')}), chr(10))"
    t = f"regexp_replace({t}, '\\n{{3,}}', chr(10) || chr(10), 'g')"
    return f"nullif({sql_strip(t)}, '')"


@query("clean_text", f"with d as (select doc_id, {DIRTY} as t from documents) "
       f"select doc_id, {sql_clean_text('t')} as cleaned from d")
def clean_text(spark, sf):
    d = standin.table(spark, sf, "documents").select("doc_id", F.expr(DIRTY).alias("t"))
    return d.select("doc_id", text.clean_text("t").alias("cleaned"))


def sql_slug(x: str) -> str:
    s = f"regexp_replace(strip_accents(lower({x})), '[^\\x00-\\x7F]', '', 'g')"
    s = f"regexp_replace({s}, '[^a-z0-9]+', '-', 'g')"
    return f"coalesce(nullif(substr(regexp_replace({s}, '^-+|-+$', '', 'g'), 1, 80), ''), 'unknown')"


@query("slugify", f"{standin.cte('docs')} select doc_id, {sql_slug('award_name')} as slug from docs")
def slugify(spark, sf):
    return standin.docs(spark, sf).select("doc_id", text.slugify("award_name").alias("slug"))


INGEST_SQL = r"\$\s?(\d{1,3}(?:[,\s\x{A0}]\d{3})+(?:\.\d{1,2})?|\d+(?:\.\d{1,2})?)"


def sql_amounts(x: str) -> str:
    v = sql_figures(x, INGEST_SQL, 1)
    c = sql_clean_text(x)
    return (f"list_min({v}) as amount_min, list_max({v}) as amount_max, case when length({c}) <= 120 then {c} "
            f"when len({v}) > 0 then {sql_spans(x, INGEST_SQL)} end as amount_raw")


@query("parse_amounts", f"{ROWS} select o_orderkey, {sql_amounts('award_value_description')} from rows_")
def parse_amounts(spark, sf):
    return rows(spark, sf).select("o_orderkey", money.parse_amounts("award_value_description").alias("a")).select(
        "o_orderkey", "a.*")


@query("derive_amounts", f"{R} select award_uid, amount_min, amount_max, amount_raw from records")
def derive_amounts(spark, sf):
    d = money.derive_amounts("amount_min", "amount_max", "amount_raw", text.clean_scalar("award_value_description"),
                             text.clean_scalar("award_description"))
    return rows(spark, sf).select("award_uid", *[c.alias(n) for n, c in d.items()])


@query("money_excerpt", f"{ROWS} select o_orderkey, {sql_excerpt('award_value_description')} as value_excerpt, "
       f"{sql_excerpt('award_description')} as text_excerpt from rows_")
def money_excerpt(spark, sf):
    return rows(spark, sf).select(
        "o_orderkey", money.money_excerpt("award_value_description").alias("value_excerpt"),
        money.money_excerpt("award_description").alias("text_excerpt"))


@query("first_dollar", f"{R} select award_uid, {FIRST_SQL} as value from records")
def first_dollar(spark, sf):
    return records(spark, sf).select(
        "award_uid", money.first_dollar("award_value_description", "award_description").alias("value"))


@query("normalize_status", f"{ROWS} select o_orderkey, case lower(trim(status_word)) when 'open' then 'Open' when 'closed' then 'Ended' "
       "when 'archived' then 'Ended' when 'ended' then 'Ended' when 'upcoming' then 'Upcoming' end as status from rows_")
def normalize_status(spark, sf):
    return rows(spark, sf).select("o_orderkey", fx.normalize_status("status_word").alias("status"))


# Category cells from brand, type and key of a part.
CELL = ("case p_partkey % 8 when 0 then 'Faculty of Kinesiology, Sport, and Recreation, Faculty of ' || p_name "
        "when 1 then 'College of ' || p_name || ' or School of ' || p_type "
        "when 2 then 'Faculty of Medicine and Dentistry' when 3 then '$' || cast(p_size as string) || ' 000 minimum' "
        "when 4 then 'Faculty of Arts or ' || p_name when 5 then cast(p_size as string) || ',250.00' "
        "when 6 then 'Office of ' || p_name || ', Research' else 'Faculty of Agricultural, Life & Environmental Sciences' end")
UNIT_SQL = "(?i)\\b(faculty|facult[eé]|school|college|campus|department|institute|programme?s?)\\b"


def sql_units(x: str) -> str:
    """The fold as a running count of unit starts, then one text per unit."""
    frag = f"list_filter(list_transform(string_split({x}, ','), lambda f: trim(f)), lambda f: f <> '')"
    starts = f"regexp_matches(f, '{UNIT_SQL}')"
    fold = (f"list_reduce({frag}, lambda acc, f: case when acc <> '' and not {starts} then acc || ', ' || f "
            "when acc = '' then f else acc || chr(1) || f end, '')")
    parts = f"string_split({fold}, chr(1))"
    ors = (f"list_transform({parts}, lambda u: case when regexp_matches(u, '\\s+or\\s+') and "
           f"len(list_filter(regexp_split_to_array(u, '\\s+or\\s+'), lambda s: not regexp_matches(s, '{UNIT_SQL}'))) = 0 "
           "then array_to_string(list_transform(regexp_split_to_array(u, '\\s+or\\s+'), lambda s: trim(s)), chr(1)) else u end)")
    return f"string_split(array_to_string({ors}, chr(1)), chr(1))"


def sql_unit(u: str) -> str:
    key = f"trim(regexp_replace(regexp_replace(lower(replace({u}, '&', 'and')), ',\\s*and\\b', ' and', 'g'), '[\\s,]+', ' ', 'g'))"
    cases = " ".join(f"when {q(k)} then {q(v)}" for k, v in C.CANONICAL_FACULTY.items())
    display = f"trim(regexp_replace(regexp_replace({u}, ',\\s*and\\b', ' and', 'g'), '\\s*,\\s*', ' ', 'g'))"
    return f"case {key} {cases} else {display} end"


CELLS = f"with cells as (select p_partkey, {CELL} as cell from part) "


def cells(spark, sf):
    return standin.table(spark, sf, "part").select("p_partkey", F.expr(CELL).alias("cell"))


@query("split_units", f"{CELLS} select p_partkey, array_to_string({sql_units('cell')}, '|') as units from cells")
def split_units(spark, sf):
    return cells(spark, sf).select("p_partkey", F.array_join(fx.split_units("cell"), "|").alias("units"))


@query("split_or", f"{CELLS} select p_partkey, case when regexp_matches(cell, '\\s+or\\s+') and "
       f"len(list_filter(regexp_split_to_array(cell, '\\s+or\\s+'), lambda s: not regexp_matches(s, '{UNIT_SQL}'))) = 0 "
       "then array_to_string(regexp_split_to_array(cell, '\\s+or\\s+'), '|') else cell end as parts from cells")
def split_or(spark, sf):
    return cells(spark, sf).select("p_partkey", F.array_join(fx.split_or(F.col("cell")), "|").alias("parts"))


@query("canonical_unit", f"{CELLS} select p_partkey, {sql_unit('cell')} as unit from cells")
def canonical_unit(spark, sf):
    return cells(spark, sf).select("p_partkey", fx.canonical_unit(F.col("cell")).alias("unit"))


@query("canonical_category", f"{CELLS} select p_partkey, case when cell not like '%$%' "
       "and not regexp_matches(cell, '^\\$?\\s*[\\d,]+(\\.\\d{2})?\\s*$') then "
       f"array_to_string(list_transform({sql_units('cell')}, lambda u: {sql_unit('u')}), ', ') end as category from cells")
def canonical_category(spark, sf):
    return cells(spark, sf).select("p_partkey", fx.canonical_category("cell").alias("category"))


G, U, H = (q("(?i)" + p) for p in (C.GRADUATE_LEVEL, C.UNDERGRAD_LEVEL, C.UNDERGRAD_HINT))
TITLE = ("case o_orderkey % 7 when 0 then award_name || ' for Doctoral Study' when 1 then 'Undergraduate ' || award_name "
         "when 2 then award_name || ' Entrance' when 3 then 'Graduate and Undergraduate ' || award_name "
         "when 4 then 'Master''s Entrance ' || award_name else award_name end")


@query("infer_career", f"{ROWS}, t as (select o_orderkey, {TITLE} as title, award_description as body from rows_) "
       f"select o_orderkey, case when regexp_matches(title, {G}) and regexp_matches(title, {U}) then null "
       f"when regexp_matches(title, {G}) then 'Graduate' when regexp_matches(title, {U}) or regexp_matches(title, {H}) then 'Undergraduate' "
       f"when regexp_matches(body, {G}) and regexp_matches(body, {U}) then null when regexp_matches(body, {G}) then 'Graduate' "
       f"when regexp_matches(body, {U}) or regexp_matches(body, {H}) then 'Undergraduate' end as career from t")
def infer_career(spark, sf):
    t = rows(spark, sf).select("o_orderkey", F.expr(TITLE).alias("title"), "award_description")
    return t.select("o_orderkey", fx.infer_career("title", "award_description").alias("career"))


GROUP = ("case c_mktsegment when 'BUILDING' then 'Undergraduate students' when 'MACHINERY' then 'Graduate' "
         "when 'HOUSEHOLD' then 'High school students' else lower(c_mktsegment) end")


@query("career_level_by_group", f"with g as (select c_custkey, lower({GROUP}) as g from customer) select c_custkey, "
       "case g when 'undergraduate students' then 'Undergraduate' when 'graduate' then 'Graduate' "
       "when 'high school students' then 'Undergraduate' end as career, "
       "case g when 'high school students' then 'UG Entering Year 1' end as level from g")
def career_level_by_group(spark, sf):
    g = standin.table(spark, sf, "customer").select("c_custkey", F.expr(GROUP).alias("g"))
    return g.select("c_custkey", fx.career_by_group("g").alias("career"), fx.level_by_group("g").alias("level"))


@query("deadline_iso", f"{ROWS} select o_orderkey, trim(regexp_replace(deadline_raw, '^\\s*Deadline\\s*', '')) as raw, "
       "regexp_extract(deadline_raw, '(\\d{2})/(\\d{2})/(\\d{4})', 3) || '-' || regexp_extract(deadline_raw, '(\\d{2})/(\\d{2})/(\\d{4})', 1) "
       "|| '-' || regexp_extract(deadline_raw, '(\\d{2})/(\\d{2})/(\\d{4})', 2) as iso, "
       "cast(deadline_date as date) as day from rows_")
def deadline_iso(spark, sf):
    r = rows(spark, sf)
    iso = fx.deadline_iso("deadline_raw")
    return r.select("o_orderkey", fx.deadline_text("deadline_raw").alias("raw"), iso.alias("iso"),
                    fx.deadline_day(iso).alias("day"))


MONTH_CELL = ("case l_linenumber % 4 when 0 then upper(case when month(l_shipdate) = 9 then 'SEPTEMBER' when month(l_shipdate) = 1 "
              "then 'January' else 'MAY' end) || ' ' || cast(day(l_shipdate) as string) when 1 then 'MARCH ' "
              "when 2 then 'Essay required' else 'june 30' end")


@query("month_day_deadline", f"with c as (select l_orderkey, l_linenumber, l_partkey, {MONTH_CELL} as cell from lineitem) "
       f"select cell, count(*) as n from c where regexp_matches(cell, {q('(?i)' + C.MONTH_DAY)}) group by 1")
def month_day_deadline(spark, sf):
    c = standin.table(spark, sf, "lineitem").select(fx.month_day_deadline(F.expr(MONTH_CELL)).alias("cell"))
    return c.where("cell is not null").groupBy("cell").agg(F.count(F.lit(1)).alias("n"))


CELL_ARRAY = ["area_of_study", "status_word", "deadline_raw", "award_value_description", "award_type"]


@query("classify_cells",
       f"{ROWS} select o_orderkey, coalesce({sql_clean_text('area_of_study')}, "
       f"case when trim(status_word) = 'whatever' then 'whatever' end, "
       f"case when award_value_description not like '%$%' then trim(award_value_description) end, award_type) as category, "
       "case when trim(lower(status_word)) <> 'whatever' then trim(status_word) end as status, "
       "case when award_value_description like '%$%' then trim(award_value_description) end as amount, "
       "trim(replace(deadline_raw, 'Deadline', '')) as deadline from rows_")
def classify_cells(spark, sf):
    c = fx.classify_cells(F.array(*CELL_ARRAY))
    out = rows(spark, sf).select("o_orderkey", c.alias("c")).select("o_orderkey", "c.*")
    # an empty set of line items leaves '' cells, which cleaning drops
    return out


@query("classify_extra_cells",
       f"{ROWS} select o_orderkey, case when o_orderkey % 3 = 0 then 'SEPTEMBER 30' when o_orderkey % 5 = 0 then 'May 1' end as deadline_raw, "
       "case when required_supporting_documents = 'Essay' then 'Essay' end as supporting_documents from rows_")
def classify_extra_cells(spark, sf):
    cells_ = F.array(
        F.col("required_supporting_documents"),
        F.when(F.col("o_orderkey") % 5 == 0, F.lit("May 1")),
        F.when(F.col("o_orderkey") % 3 == 0, F.lit(" SEPTEMBER 30 ")))
    return rows(spark, sf).select("o_orderkey", fx.classify_extra_cells(cells_).alias("c")).select("o_orderkey", "c.*")


@query("strip_name_prefix", f"{standin.cte('docs')} select doc_id, nullif({sql_strip('substr(award_description, length(award_name) + 1)')}, '') "
       "as body from docs where award_name <> ''")
def strip_name_prefix(spark, sf):
    d = standin.docs(spark, sf).where("award_name <> ''")
    return d.select("doc_id", fx.strip_name_prefix("award_name", "award_description").alias("body"))


@query("is_offsite", "select page_id, lower(regexp_extract(url, '^[a-z]+://([^/?#]*)', 1)) <> 'thther.example.org' as offsite from pages")
def is_offsite(spark, sf):
    p = standin.table(spark, sf, "pages")
    return p.select("page_id", fx.is_offsite("url", "thther.example.org").alias("offsite"))


# listing card: blurb and amount cell of an order; detail page: the description of orders that need one
@query("detail_precedence",
       f"{ROWS}, x as (select source_id || ':' || native_id as award_uid, award_value_description as cell, application_details as blurb, "
       "case when application_status is null or application_status <> 'Ended' then award_description end as body from rows_), "
       f"y as (select *, {sql_figures('cell', INGEST_SQL, 1)} as f1, {sql_figures('body', INGEST_SQL, 1)} as f2 from x) "
       "select award_uid, coalesce(body, blurb) as award_description, "
       "case when len(f1) > 0 then list_max(f1) else list_max(f2) end as amount_max, "
       "case when len(f1) > 0 then 'cell' when len(f2) > 0 then 'detail' end as amount_from, "
       "case when body is null then 'no description recovered from detail page' end as detail_warning from y")
def detail_precedence(spark, sf):
    r = rows(spark, sf)
    listing = r.select("award_uid", F.col("application_details").alias("blurb"),
                       F.col("award_value_description").alias("amount_cell"))
    detail = r.where(~F.col("application_status").eqNullSafe("Ended")).select(
        "award_uid", F.col("award_description").alias("body"))
    return record.detail_precedence(listing, detail).select(
        "award_uid", "award_description", "amount_max", "amount_from", "detail_warning")


@query("provenance_tags",
       f"{ROWS} select o_orderkey, case when application_status = 'Ended' then 'detail_skipped=closed,' else '' end "
       "|| case when scrape_error is not null then 'error=timeout,' else '' end || 'group=' || trim(career) as tags from rows_")
def provenance_tags(spark, sf):
    base = F.create_map(F.lit("group"), F.trim("career"))
    tagged = record.provenance_tags(
        base, detail_skipped=F.when(F.col("application_status") == "Ended", F.lit("closed")), error=F.col("scrape_error"))
    pairs = F.array_sort(F.transform(F.map_entries(tagged), lambda e: F.concat_ws("=", e["key"], e["value"])))
    return rows(spark, sf).select("o_orderkey", F.array_join(pairs, ",").alias("tags"))


@query("review_flags",
       f"{R}, b as (select award_uid, coalesce(eligibility_selection_criteria, '') || ' ' || coalesce(award_description, '') as b from records) "
       f"select award_uid, concat_ws(',', case when regexp_matches(b, {q('(?i)' + C.CITIZENSHIP_FLAG)}) then '!cit' end, "
       f"case when regexp_matches(b, {q('(?i)' + C.GPA_FLAG)}) then '!gpa' end) as flags from b")
def review_flags(spark, sf):
    return records(spark, sf).select(
        "award_uid", fx.review_flags("eligibility_selection_criteria", "award_description").alias("flags"))


LABEL_FIELDS = ["eligibility_selection_criteria", "award_description", "award_value_description", "additional_instructions"]


@query("label_text",
       f"{R}, t as (select award_uid, concat_ws(chr(10), {', '.join(f'nullif({c}, chr(0))' for c in LABEL_FIELDS)}) as txt from records) "
       "select award_uid, txt, array_to_string(list_filter(list_transform(string_split(txt, chr(10)), lambda x: rtrim(x)), "
       "lambda x: x <> '')[1:40], '|') as lines from t")
def label_text(spark, sf):
    t = fx.label_text(*LABEL_FIELDS)
    return records(spark, sf).select("award_uid", t.alias("txt"), F.array_join(fx.label_lines(t), "|").alias("lines"))


# --- storage shapes ---------------------------------------------------------------
@query("raw_pack",
       f"{ROWS} select o_orderkey, case when o_orderkey % 2 = 0 and o_orderkey % 3 = 0 then 'OTHER=' || trim(career) || ',UW_AWARD_ADDNLINST=form' "
       "when o_orderkey % 2 = 0 then 'OTHER=' || trim(career) when o_orderkey % 3 = 0 then 'UW_AWARD_ADDNLINST=form' end as packed from rows_")
def raw_pack(spark, sf):
    raw = F.when(F.col("o_orderkey") % 2 == 0, F.create_map(F.lit("OTHER"), F.trim("career")))
    packed = record.raw_pack(raw, F.when(F.col("o_orderkey") % 3 == 0, F.lit("form")))
    back = F.from_json(packed, "map<string,string>")
    pairs = F.array_sort(F.transform(F.map_entries(back), lambda e: F.concat_ws("=", e["key"], e["value"])))
    return rows(spark, sf).select("o_orderkey", F.array_join(pairs, ",").alias("packed"))


@query("raw_promote", f"{R} select award_uid, additional_instructions as value from records")
def raw_promote(spark, sf):
    return rows(spark, sf).select("award_uid", record.raw_promote("raw_fields_json").alias("value"))


@query("row_pack",
       f"{ROWS} select o_orderkey, e_residency is not null or e_identity is not null or e_gpa_min is not null "
       "or e_citizenship is not null or e_institution is not null or e_program_excluded is not null or e_year is not null "
       "or e_level is not null or e_financial_need is not null as stored from rows_")
def row_pack(spark, sf):
    r = rows(spark, sf).withColumn("eligibility", F.coalesce(
        record.parse_eligibility("eligibility_json"), F.from_json(F.lit("{}"), record_schema())))
    packed = record.row_pack(r.drop("eligibility_json").withColumn("raw_fields", F.lit("x")))
    return packed.select("o_orderkey", F.col("eligibility_json").isNotNull().alias("stored"))


def record_schema():
    from canvass.schema import ELIGIBILITY

    return ELIGIBILITY
