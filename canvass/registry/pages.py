"""Page jobs, proposals and questions."""

from canvass.functions import fields as fx
from canvass.operators import counts, pages, proposals, publish
from canvass.registry.base import *  # noqa: F403
from canvass.registry.base import (C, CORE_SQL, F, WS, aj, q, query, records, rows, sql_aj, sql_strip, standin, with_records)
from canvass.registry.filters import PAIRS_SQL
from canvass.registry.tables import VOCAB, split

P = standin.cte("rows")
HOST_SQL = "lower(regexp_extract(url, '^[a-z]+://([^/?#]*)', 1))"


def raw_pages(spark, sf):
    return standin.table(spark, sf, "pages")


@query("page_text")
def page_text(spark, sf):
    return pages.page_text(raw_pages(spark, sf))


@query("page_block_text")
def page_block_text(spark, sf):
    return pages.page_block_text(raw_pages(spark, sf))


@query("page_links", "select page_id, unnest(list_distinct(regexp_extract_all(html, '<a href=\"/([^\"]+)\"', 1))) as link from pages")
def page_links(spark, sf):
    return pages.page_links(raw_pages(spark, sf), '<a href="/([^"]+)"')


@query("page_title", "select page_id, trim(regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '\\s+', ' ', 'g')) as title from pages")
def page_title(spark, sf):
    return raw_pages(spark, sf).select("page_id", pages.page_title("html").alias("title"))


# listing markup made from the records themselves: one row, one card, one form per record
TABLE_HTML = ("'<html><body><table><tr><td>Name</td></tr><tr><td> ' || coalesce(area_of_study, '') || '</td><th><a href=\"/opportunities/' || native_id || '\">' "
              "|| award_name || '</a><div>Given &amp; kept<br>yearly</div></th><td>' || coalesce(deadline_raw, '') || '<td>' || trim(status_word) "
              "|| '</td></tr></table><p>end'")
ROW_SQL = ("case when coalesce(area_of_study, '') <> '' then area_of_study end")


def html_of(spark, sf, text):
    return rows(spark, sf).select(F.col("o_orderkey").alias("page_id"), F.expr(text).alias("html"))


@query("page_table_rows",
       f"{P} select o_orderkey as page_id, native_id, award_name as name, 'Given & kept' || chr(10) || 'yearly' as blurb, "
       "coalesce(case when area_of_study <> '' then area_of_study end, case when trim(status_word) = 'whatever' then 'whatever' end) as category, "
       "trim(replace(deadline_raw, 'Deadline', '')) as deadline, case when trim(status_word) <> 'whatever' then trim(status_word) end as status from rows_")
def page_table_rows(spark, sf):
    got = pages.listing_rows(pages.page_table_rows(html_of(spark, sf, TABLE_HTML)), r"^/opportunities/(\d+)$")
    return got.select("page_id", "native_id", "name", "blurb", "category", "deadline", "status")


FORM_HTML = ("'<div><span id=\"fld-PAGEREC-UW_AWARD_TYPE-editor\">' || coalesce(award_type, '') || '</span><div class=\"x\" id=\"fld-PAGEREC-UW_AWARD_LDESCR-editor\">"
             "<p>Given by <b>' || award_name || '</b> fund</p><p>' || coalesce(eligibility_selection_criteria, '') || '</p></div>"
             "<div id=\"other\">no</div><span id=\"fld-PAGEREC--editor\">nameless</span></div>'")


@query("page_elements",
       f"{P} select o_orderkey as page_id, nullif(award_type, '') as award_type, 'Given by ' || award_name || ' fund' || "
       "coalesce(chr(10) || array_to_string(string_split(eligibility_selection_criteria, chr(10)), chr(10)), '') as award_description from rows_")
def page_elements(spark, sf):
    from canvass.operators import keyed

    fields = pages.field_map(pages.page_elements(
        html_of(spark, sf, FORM_HTML), id_prefix="fld-PAGEREC-", id_suffix="-editor"))
    return fields.select("page_id", *keyed.fields_to_columns("fields")).select("page_id", "award_type", "award_description")


CARD_HTML = ("'<div class=\"card scholarship\"><h3 class=\"scholarship-title\">' || award_name || '</h3><div class=\"p-1 m\"><b>Value:</b> ' "
             "|| coalesce(award_value_description, '') || '</div><div class=\"p-1\">Requirements: ' || trim(career) || '</div><div class=\"p-1\">loose</div></div>'")


@query("page_label_blocks",
       f"{P} select o_orderkey as page_id, 'value' as label, coalesce({sql_strip('award_value_description')}, '') as value from rows_ union all "
       "select o_orderkey, 'requirements', trim(career) from rows_")
def page_label_blocks(spark, sf):
    blocks = pages.page_elements(html_of(spark, sf, CARD_HTML), tag="div", classes=("p-1",))
    return blocks.withColumn("lv", pages.label_value("text")).where("lv is not null").select("page_id", "lv.label", "lv.value")


# --- sections and lines ---------------------------------------------------------------
LINES_SQL = ("l as (select doc_id, i, line from (select doc_id, unnest(list_filter(list_transform(string_split(text, chr(10)), "
             f"lambda x: {sql_strip('x')}), lambda x: x <> '')) as line, generate_subscripts(list_filter(list_transform(string_split(text, chr(10)), "
             f"lambda x: {sql_strip('x')}), lambda x: x <> ''), 1) as i from documents))")


def is_heading(x):
    return F.length(x) < 30


@query("page_sections",
       f"with {LINES_SQL}, s as (select *, length(line) < 30 as h, sum(case when length(line) < 30 then 1 else 0 end) over "
       "(partition by doc_id order by i) as sec from l), head as (select doc_id, sec, trim(regexp_replace(trim(lower(line)), ':+$', '')) as heading from s where h), "
       "body as (select doc_id, sec, string_agg(line, chr(10) order by i) as body from s where not h group by 1, 2), "
       "j as (select b.doc_id, b.sec, coalesce(heading, '') as heading, body from body b left join head using (doc_id, sec)) "
       "select doc_id, heading, string_agg(body, chr(10) order by sec) as body from j group by 1, 2")
def page_sections(spark, sf):
    from canvass.functions.text import lines

    d = standin.table(spark, sf, "documents")
    return d.select("doc_id", F.inline(pages.sections(lines("text"), is_heading)))


@query("section_merge",
       "with c as (select conv_id, turn, role, text from conversations where length(text) >= 40), "
       "l as (select conv_id, turn, unnest(string_split(text, chr(10))) as raw, generate_subscripts(string_split(text, chr(10)), 1) as i from c), "
       f"m as (select conv_id, turn, i, {sql_strip('raw')} as line from l), k as (select * from m where line <> ''), "
       "s as (select *, length(line) < 30 as h, sum(case when length(line) < 30 then 1 else 0 end) over (partition by conv_id, turn order by i) as sec from k), "
       "head as (select conv_id, turn, sec, trim(regexp_replace(trim(lower(line)), ':+$', '')) as heading from s where h), "
       "body as (select conv_id, turn, sec, string_agg(line, chr(10) order by i) as body from s where not h group by all), "
       "j as (select b.*, coalesce(heading, '') as heading from body b left join head using (conv_id, turn, sec)), "
       "per as (select conv_id, turn, heading, min(sec) as first_sec, string_agg(body, chr(10) order by sec) as body from j group by all) "
       "select conv_id, heading, string_agg(body, chr(10) order by turn, first_sec) as body from per group by 1, 2")
def section_merge(spark, sf):
    return pages.section_merge(standin.table(spark, sf, "conversations"), "conv_id", "turn", "text", is_heading)


LABELLED = ("'Title ' || native_id || chr(10) || case o_orderkey % 3 when 0 then 'Scholarship Value: $' || chr(10) || cast(o_orderkey as string) || ',500' "
            "when 1 then 'Scholarship Value: $' || cast(o_orderkey as string) else 'Scholarship Value:' || chr(10) || 'to be told' end || chr(10) || "
            "'Scholarships Available:' || chr(10) || case when o_orderkey % 4 = 0 then 'many' else cast(o_orderkey % 5 as string) end || chr(10) || award_description")


@query("label_value_lines",
       f"{P} select o_orderkey, case o_orderkey % 3 when 0 then cast(o_orderkey as varchar) || ',500' when 1 then '$' || cast(o_orderkey as varchar) end as value, "
       "case when o_orderkey % 4 <> 0 then cast(o_orderkey % 5 as varchar) end as available, 'Title ' || native_id || chr(10) || "
       "case when o_orderkey % 3 = 2 then 'to be told' || chr(10) else '' end || case when o_orderkey % 4 = 0 then 'many' || chr(10) else '' end || award_description as body from rows_")
def label_value_lines(spark, sf):
    from canvass.functions.text import lines

    t = rows(spark, sf).select("o_orderkey", F.expr(LABELLED).alias("t"))
    got = pages.label_value_lines(lines("t"), {"value": "scholarship value", "available": "scholarships available"})
    return t.select("o_orderkey", got.alias("g")).select("o_orderkey", "g.*")


DETAIL = ("'Skip to Content' || chr(10) || 'Sign In' || chr(10) || case when o_orderkey % 5 = 0 then '' else 'For: ' || award_name || chr(10) end || award_description "
          "|| chr(10) || 'Opportunities' || chr(10) || case when o_orderkey % 7 = 0 then 'Donor' || chr(10) || 'X' else 'Award' || chr(10) || 'Y' end")


@query("body_between", f"{P} select o_orderkey, award_description as body from rows_")
def body_between(spark, sf):
    from canvass.functions.text import lines

    t = rows(spark, sf).select("o_orderkey", "award_name", F.expr(DETAIL).alias("t"))
    return t.select("o_orderkey", pages.body_between(lines("t"), "award_name").alias("body"))


# --- listings -------------------------------------------------------------------------
def listing(spark, sf):
    li = standin.table(spark, sf, "lineitem")
    return li.select(F.col("l_suppkey").alias("tenant"), F.col("l_partkey").alias("item"), F.col("l_linenumber").alias("page"),
                     F.col("l_orderkey").alias("pos"))


@query("listing_dedupe", "select l_suppkey as tenant, l_partkey as item, l_linenumber as page, l_orderkey as pos from lineitem "
       "qualify row_number() over (partition by l_suppkey, l_partkey order by l_linenumber, l_orderkey) = 1")
def listing_dedupe(spark, sf):
    return pages.listing_dedupe(listing(spark, sf), ["tenant"], "item", "page", "pos")


@query("paging_end",
       "with f as (select l_suppkey, l_partkey, min(l_linenumber) as p from lineitem group by 1, 2), n as (select l_suppkey, p, count(*) as n_new from f group by 1, 2), "
       "r as (select l_suppkey, l_linenumber as p, count(*) as n_rows from lineitem group by 1, 2), "
       "j as (select r.l_suppkey, r.p, n_rows, coalesce(n_new, 0) as n_new from r left join n on r.l_suppkey = n.l_suppkey and r.p = n.p) "
       "select l_suppkey as tenant, coalesce(min(p) filter (n_new = 0 or n_rows < 80), max(p) + 1) as last_page, count(*) as pages from j group by 1")
def paging_end(spark, sf):
    return pages.paging_end(listing(spark, sf), ["tenant"], "item", "page", 80)


SEG_SQL = "regexp_extract(url, '^[a-z]+://[^/]+/([^?#]*)', 1)"


@query("distinct_per_host", f"with x as (select distinct {HOST_SQL} as host, {SEG_SQL} as item from pages) select host, count(*) as n_items from x group by 1 "
       "union all select null, count(*) from x")
def distinct_per_host(spark, sf):
    p = raw_pages(spark, sf).select(fx.host_of("url").alias("host"), F.regexp_extract("url", "^[a-z]+://[^/]+/([^?#]*)", 1).alias("item"))
    return pages.distinct_per_host(p, "host", "item")


PROBE = (f"probe as (select page_id, regexp_extract(url, '^[a-z]+://([^./]+)', 1) as first_label, {HOST_SQL} as host, "
         "regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1) as title, len(regexp_extract_all(html, '<a href=\"', 0)) as n_ids from pages), "
         "t as (select page_id, case when page_id % 5 = 0 then 'other' else first_label end as slug, host as final_host, "
         "case when page_id % 2 = 0 then 'Opportunities - ' || title else title end as title, n_ids, first_label = 'spam-farm' as is_control from probe)")
CLASSED = (f"with {PROBE}, c as (select page_id, slug, final_host, is_control, starts_with(final_host, slug || '.') and final_host <> 'blog.tionsh.example.net' as is_tenant, title, n_ids from t)")


def probes(spark, sf):
    p = raw_pages(spark, sf)
    label = F.regexp_extract("url", "^[a-z]+://([^./]+)", 1)
    title = F.regexp_extract("html", r"(?is)<title[^>]*>(.*?)</title>", 1)
    return p.select(
        "page_id", F.when(F.col("page_id") % 5 == 0, F.lit("other")).otherwise(label).alias("slug"), fx.host_of("url").alias("final_host"),
        F.when(F.col("page_id") % 2 == 0, F.concat(F.lit("Opportunities - "), title)).otherwise(title).alias("title"),
        F.size(F.regexp_extract_all("html", F.lit('<a href="'), F.lit(0))).alias("n_ids"), (label == "spam-farm").alias("is_control"))


@query("tenant_classify",
       f"{CLASSED} select slug, final_host, is_control, is_tenant, case when is_tenant then trim(title[length('Opportunities - ') + 1:]) else '' end as institution, "
       "case when not is_tenant then 'redirected off-host' when n_ids = 0 then 'no rows on page 1' else '' end as note from c where title like 'Opportunities - %' union all "
       "select slug, final_host, is_control, is_tenant, case when is_tenant then title else '' end, "
       "case when not is_tenant then 'redirected off-host' when n_ids = 0 then 'no rows on page 1' else '' end from c where title not like 'Opportunities - %'")
def tenant_classify(spark, sf):
    return pages.tenant_classify(probes(spark, sf), "blog.tionsh.example.net")


@query("discriminator_broken", f"{CLASSED} select coalesce(bool_or(is_control and is_tenant), false) as broken, "
       "count(*) filter (is_tenant and not is_control) as tenants from c")
def discriminator_broken(spark, sf):
    return pages.discriminator_broken(pages.tenant_classify(probes(spark, sf), "blog.tionsh.example.net"))


# --- questions ------------------------------------------------------------------------
ASKED = ("case turn % 4 when 0 then 'Please show me  ' || text || ' ?! ' when 1 then 'What scholarships are there for ' || text "
         "when 2 then 'I''m looking for find me ' || text || '...' else text end")
NORM_SQL = f"substr({sql_strip(f'''regexp_replace(nfc_normalize(t), '{WS}+', ' ', 'g')''')}, 1, 300)"
FILLER_SQL = C.FILLER_PREFIX.replace("'", "''")
KEY_SQL = f"{sql_strip(f'''regexp_replace(regexp_replace(lower(n), '{FILLER_SQL}', ''), '[?!.\\s]+$', '')''')}"
ASK = f"with a as (select conv_id, turn, {ASKED} as t from conversations), n as (select conv_id, turn, {NORM_SQL} as n from a)"


def questions(spark, sf):
    return standin.table(spark, sf, "conversations").select("conv_id", "turn", F.expr(ASKED).alias("t"))


@query("question_norm", f"{ASK} select conv_id, turn, n as question from n")
def question_norm(spark, sf):
    return questions(spark, sf).select("conv_id", "turn", proposals.question_norm("t").alias("question"))


@query("question_key_text", f"{ASK} select conv_id, turn, {KEY_SQL} as key_text from n")
def question_key_text(spark, sf):
    n = questions(spark, sf).withColumn("n", proposals.question_norm("t"))
    return n.select("conv_id", "turn", proposals.question_key_text("n").alias("key_text"))


@query("question_cache_key", f"{ASK} select conv_id, turn, sha256('v3|abc|' || {KEY_SQL}) as cache_key from n")
def question_cache_key(spark, sf):
    n = questions(spark, sf).withColumn("n", proposals.question_norm("t"))
    return n.select("conv_id", "turn", proposals.question_cache_key("n", "v3", "abc").alias("cache_key"))


@query("keywords_sanitize",
       "with k as (select doc_id, substr(trim(regexp_replace(regexp_replace(lower(text), '[^a-z0-9 +\\-'']', ' ', 'g'), '\\s+', ' ', 'g')), 1, 64) as s from documents) "
       "select doc_id, array_to_string(string_split(s, ' ')[1:5], ' ') as keywords from k")
def keywords_sanitize(spark, sf):
    return standin.table(spark, sf, "documents").select("doc_id", proposals.keywords_sanitize("text").alias("keywords"))


STEP = "{\"type\": \"model_output\", \"content\": [{\"type\": \"text\", \"text\": "
ANSWER = ("case o_orderkey % 7 when 0 then '{\"status\": \"incomplete\"}' when 1 then '{\"status\": \"completed\", \"steps\": []}' "
          f"when 2 then '{{\"status\": \"completed\", \"steps\": [{STEP}\"{{not json\"}}]}}]}}' "
          f"when 3 then '{{\"status\": \"completed\", \"steps\": [{STEP}\"42\"}}]}}]}}' when 4 then 'broken' when 5 then '{{\"steps\": []}}' "
          f"else '{{\"status\": \"completed\", \"steps\": [{{\"type\": \"thought\"}}, {STEP}\"{{}}\"}}]}}]}}' end")


@query("proposal_parse",
       "select o_orderkey, case o_orderkey % 7 when 0 then 'status_incomplete' when 1 then 'no_text_output' when 2 then 'unparseable_json' "
       "when 3 then 'not_an_object' when 4 then 'no_payload' when 5 then 'status_missing' end as reason, case when o_orderkey % 7 = 6 then '{}' end as payload from orders")
def proposal_parse(spark, sf):
    o = standin.table(spark, sf, "orders").select("o_orderkey", F.expr(ANSWER).alias("doc"))
    return o.select("o_orderkey", proposals.proposal_parse("doc").alias("p")).select("o_orderkey", "p.*")


PROPOSED = ("prop as (select award_uid, list_concat(levels, levels, ['UG Year 9']) as level, list_concat(areas_of_study, ['Alchemy']) as area, "
            "award_types as award_type from records)")


@query("proposal_validate",
       f"{VOCAB}, {PROPOSED}, k as (select list(value) filter (filter_key = 'level') as kl, list(value) filter (filter_key = 'areaOfStudy') as ka, "
       "list(value) filter (filter_key = 'awardType') as kt from v), ok as (select award_uid, list_filter(list_distinct(level), lambda x: list_contains(kl, x)) as level, "
       "list_filter(list_distinct(area), lambda x: list_contains(ka, x)) as area, list_filter(list_distinct(award_type), lambda x: list_contains(kt, x)) as award_type, "
       "len(prop.level) + len(prop.area) + len(prop.award_type) as asked from prop, k) "
       f"select award_uid, {sql_aj('level')} as level, {sql_aj('area')} as area, {sql_aj('award_type')} as award_type, "
       "asked - len(ok.level) - len(ok.area) - len(ok.award_type) as dropped from ok")
def proposal_validate(spark, sf):
    r = records(spark, sf)
    none = F.array().cast("array<string>")
    prop = r.select(
        "award_uid", none.alias("career"), F.concat("levels", "levels", F.array(F.lit("UG Year 9"))).alias("level"),
        F.col("award_types").alias("awardType"), none.alias("term"), none.alias("affiliation"),
        F.concat("areas_of_study", F.array(F.lit("Alchemy"))).alias("areaOfStudy"))
    out = proposals.proposal_validate(prop, publish.vocab_extract(split(spark, sf)))
    return out.select("award_uid", aj("level").alias("level"), aj("areaOfStudy").alias("area"), aj("awardType").alias("award_type"),
                      "dropped")


QUESTION = {
    "career": "case p_level when 'undergraduate' then 'Undergraduate' when 'graduate' then 'Graduate' end",
    "level": "case when p_year in ('1', '2', '3') then 'UG Year ' || p_year when p_year = '0' then 'UG Entering Year 1' end",
    "awardType": "case p_program when 'law' then 'Entrepreneurial' when 'engineering' then 'Varsity/Athletics' end",
    "term": "case when c_custkey % 2 = 0 then 'Fall' end",
    "affiliation": "case p_identity when 'women' then 'Women' when 'indigenous' then 'Nobody' end",
    "areaOfStudy": "case p_residency when 'ON' then 'Brand 3 Engineering' when 'AB' then 'All Programs' when 'QC' then 'Unheard Studies' "
                   "when 'BC' then 'Brand 14 Studies' end",
}
FACET = {"career": "career", "level": "levels", "awardType": "award_types", "term": "terms", "affiliation": "affiliations",
         "areaOfStudy": "areas_of_study"}


def _pass(k):
    if k == "career":
        return "(q_career is null or career is null or career = q_career)"
    silent = "false" if k == "affiliation" else f"len({FACET[k]}) = 0"
    return f"(q_{k} is null or {silent} or list_contains({FACET[k]}, q_{k}))"


_RANK = {k: " + ".join(f"case when q_{x} is null then 0 else 1 end" for x in C.RELAX_ORDER[: i + 1]) for i, k in enumerate(C.RELAX_ORDER)}
_NEED = "greatest(" + ", ".join(f"case when {_pass(k)} then 0 else {_RANK[k]} end" for k in C.RELAX_ORDER) + ")"
_ORDER = "list_filter([" + ", ".join(f"case when q_{k} is not null then '{k}' end" for k in C.RELAX_ORDER) + "], lambda x: x is not null)"


@query("relax_ladder",
       f"{with_records('profiles')}, asks as (select c_custkey as question_id, " + ", ".join(f"{e} as q_{k}" for k, e in QUESTION.items())
       + " from profiles), d as (select distinct " + ", ".join(f"q_{k}" for k in QUESTION) + " from asks), "
       "sig as (select career, levels, award_types, terms, affiliations, areas_of_study, count(*) as n from records group by all), "
       f"m as (select " + ", ".join(f"q_{k}" for k in QUESTION) + f", {_NEED} as step, sum(n) as n from d, sig where {_pass('career')} and {_pass('areaOfStudy')} group by all), "
       "b as (select *, row_number() over (partition by " + ", ".join(f"q_{k}" for k in QUESTION) + " order by step) as rn from m) "
       f"select question_id, array_to_string(({_ORDER.replace('q_', 'a.q_')})[1:coalesce(step, len({_ORDER.replace('q_', 'a.q_')}))], ',') as relaxed, cast(coalesce(n, 0) as bigint) as n_records "
       "from asks a left join b on rn = 1 and " + " and ".join(f"a.q_{k} is not distinct from b.q_{k}" for k in QUESTION))
def relax_ladder(spark, sf):
    p = standin.profiles_raw(spark, sf)
    asks = p.select(F.col("c_custkey").alias("question_id"), *[
        F.array_compact(F.array(F.expr(e))).alias(k) for k, e in QUESTION.items()])
    got = proposals.relax_ladder(asks, records(spark, sf), "question_id")
    return got.select("question_id", F.array_join("relaxed", ",").alias("relaxed"), "n_records")


@query("interpretation_contract",
       f"{standin.cte('profiles')}, a as (select c_custkey, " + ", ".join(f"{e} as q_{k}" for k, e in QUESTION.items()) + " from profiles) "
       "select c_custkey, 'career' as filter_key, 'equals' as rule, q_career is not null and q_career = 'Graduate' as ok from a union all "
       "select c_custkey, 'level', 'within', q_level is null or q_level in ('UG Year 1', 'UG Entering Year 1') from a union all "
       "select c_custkey, 'affiliation', 'empty', q_affiliation is null from a union all "
       "select c_custkey, 'areaOfStudy', 'contains', q_areaOfStudy is not null and q_areaOfStudy = 'All Programs' from a")
def interpretation_contract(spark, sf):
    p = standin.profiles_raw(spark, sf)
    got = p.select(F.col("c_custkey").alias("question"), *[
        F.array_compact(F.array(F.expr(e))).alias(k) for k, e in QUESTION.items()])
    rules = [("career", "equals", ["Graduate"]), ("level", "within", ["UG Year 1", "UG Entering Year 1"]), ("affiliation", "empty", []),
             ("areaOfStudy", "contains", ["All Programs"])]
    wanted = F.array(*[F.struct(F.lit(k).alias("filter_key"), F.lit(r).alias("rule"),
                                F.array(*[F.lit(v) for v in w]).cast("array<string>").alias("wanted")) for k, r, w in rules])
    expectations = p.select(F.col("c_custkey").alias("question"), F.inline(wanted))
    return proposals.interpretation_contract(got, expectations).select(
        F.col("question").alias("c_custkey"), "filter_key", "rule", "ok")
