"""Keyed-table maintenance, lookups, gates and publishing."""

from canvass.operators import counts, eligibility, keyed, lookups, publish, ranking, record
from canvass.functions.text import slugify
from canvass.registry.base import *  # noqa: F403
from canvass.registry.base import (C, CORE_SQL, F, REGISTRY_CTE, aj, q, query, records, registry, rows, sql_aj, standin,
                                   with_records)
from canvass.registry.filters import HEALTH, PAIRS_SQL
from canvass.registry.parsing import sql_slug
from canvass.schema import ADAPTER_COLUMNS, KEY
from canvass.session import shared_folder

R = with_records()
ROWS = standin.cte("rows")
RR = f"{R}, {REGISTRY_CTE}"

# The table holds settled orders; every line is an incoming version of its order, unless the order
# belongs to the keys that get no news.  Versions are quarters, so ties are common, and some are older than the table.
TABLE_COLS = [*KEY, *[c for c in ADAPTER_COLUMNS], "detail_level", "raw_fields_json", "indexed_at", "scraped_at", "scrape_error"]
INC = (f"{ROWS}, tab as (select * from rows_ where trim(career) <> '-'), "
       "lines as (select source_id, native_id, l_linenumber, l_partkey, l_quantity, "
       "cast(date_trunc('quarter', l_shipdate) as timestamp) - interval 20 day + interval 1 second as ts "
       "from lineitem join rows_ on l_orderkey = o_orderkey where o_orderkey % 5 <> 3), "
       "firsts as (select source_id, native_id, min(ts) as seen from lines group by all)")


PART_TEXT = "'Part ' || cast(l_partkey as varchar)"


def latest(stored: str, tie: str = "cast(l_quantity as bigint)") -> str:
    """The incoming versions that the table's own do not outrun."""
    return (", best as (select * from lines qualify row_number() over (partition by source_id, native_id "
            f"order by ts desc, l_linenumber desc, {tie} desc) = 1)"
            f", latest as (select n.* from best n left join tab t on t.source_id = n.source_id and t.native_id = n.native_id "
            f"where t.{stored} is null or t.{stored} <= n.ts)")


def table(spark, sf):
    r = rows(spark, sf).where(F.trim("career") != "-").withColumn("detail_level", F.lit(None).cast("string"))
    return r.select(*TABLE_COLS)


def lines(spark, sf):
    keys = standin.table(spark, sf, "orders").select(
        "o_orderkey", F.expr(standin.ROW["source_id"]).alias("source_id"), F.expr(standin.ROW["native_id"]).alias("native_id"))
    li = standin.table(spark, sf, "lineitem").where("l_orderkey % 5 <> 3")
    quarter = F.date_trunc("quarter", F.col("l_shipdate").cast("timestamp")) - F.expr("interval 20 days") + F.expr("interval 1 second")
    return li.join(keys, F.col("l_orderkey") == F.col("o_orderkey")).select(
        "source_id", "native_id", "l_linenumber", "l_partkey", "l_quantity", quarter.alias("ts"))


SEC = lambda c: F.unix_seconds(c).alias(c)
EPOCH = lambda c: f"cast(floor(epoch({c})) as bigint)"


@query("upsert_index",
       f"{INC}{latest('indexed_at')} select coalesce(t.source_id, n.source_id) as source_id, coalesce(t.native_id, n.native_id) as native_id, "
       "case when n.ts is not null then 'Line ' || cast(n.l_linenumber as varchar) else t.award_name end as award_name, "
       "case when n.ts is not null then 'UG Year 1' else t.level end as level, t.award_type, "
       f"case when n.ts is not null then {EPOCH('n.ts')} else {EPOCH('t.indexed_at')} end as indexed_at, {EPOCH('t.scraped_at')} as scraped_at "
       "from tab t full outer join latest n on t.source_id = n.source_id and t.native_id = n.native_id")
def upsert_index(spark, sf):
    inc = lines(spark, sf).select(
        *KEY, F.concat(F.lit("Line "), F.col("l_linenumber").cast("string")).alias("award_name"), F.lit("UG Year 1").alias("level"),
        F.lit("Graduate").alias("career"), F.lit("Fall").alias("application_selection"), F.col("ts").alias("indexed_at"))
    return keyed.upsert_index(table(spark, sf), inc).select(
        *KEY, "award_name", "level", "award_type", SEC("indexed_at"), SEC("scraped_at"))


@query("update_detail",
       f"{INC}{latest('scraped_at', PART_TEXT)} select t.source_id, t.native_id, t.award_name, case when n.ts is not null then 'Type ' || cast(n.l_linenumber as varchar) else t.award_type end as award_type, "
       "case when n.ts is not null then case when n.l_linenumber % 2 = 1 then 'Part ' || cast(n.l_partkey as varchar) end else t.award_description end as award_description, "
       "case when n.ts is null then t.affiliation end as affiliation, case when n.ts is null then t.scrape_error end as scrape_error, "
       f"coalesce({EPOCH('n.ts')}, {EPOCH('t.scraped_at')}) as scraped_at from tab t left join latest n on t.source_id = n.source_id and t.native_id = n.native_id")
def update_detail(spark, sf):
    f_type = F.concat(F.lit("Type "), F.col("l_linenumber").cast("string"))
    f_text = F.concat(F.lit("Part "), F.col("l_partkey").cast("string"))
    fields = F.map_filter(
        F.create_map(F.lit("UW_AWARD_TYPE"), f_type, F.lit("UW_AWARD_LDESCR"), F.when(F.col("l_linenumber") % 2 == 1, f_text)),
        lambda _, v: v.isNotNull())
    pages = lines(spark, sf).select(*KEY, fields.alias("fields"), F.col("ts").alias("fetched_at"))
    return keyed.update_detail(table(spark, sf), pages).select(
        *KEY, "award_name", "award_type", "award_description", "affiliation", "scrape_error", SEC("scraped_at"))


def full_records(spark, sf):
    return lines(spark, sf).select(
        *KEY, F.concat(F.lit("Line "), F.col("l_linenumber").cast("string")).alias("award_name"),
        F.lit("Open").alias("application_status"), F.col("l_quantity").cast("long").alias("amount_max"), F.col("ts").alias("run_ts"))


UPSERTED = (
    f"{INC}{latest('scraped_at')} select coalesce(t.source_id, n.source_id) as source_id, coalesce(t.native_id, n.native_id) as native_id, "
    "case when n.ts is not null then 'Line ' || cast(n.l_linenumber as varchar) else t.award_name end as award_name, "
    "case when n.ts is not null then cast(n.l_quantity as bigint) else t.amount_max end as amount_max, "
    "case when n.ts is null then t.level end as level, case when n.ts is not null then 'Open' else t.application_status end as application_status, "
    f"{EPOCH('least(t.indexed_at, f.seen)')} as indexed_at, coalesce({EPOCH('n.ts')}, {EPOCH('t.scraped_at')}) as scraped_at, "
    "case when n.ts is null then t.scrape_error end as scrape_error "
    "from tab t full outer join latest n on t.source_id = n.source_id and t.native_id = n.native_id "
    "left join firsts f on f.source_id = coalesce(t.source_id, n.source_id) and f.native_id = coalesce(t.native_id, n.native_id)")


def _upserted(df):
    return df.select(*KEY, "award_name", "amount_max", "level", "application_status", SEC("indexed_at"), SEC("scraped_at"), "scrape_error")


@query("upsert_full", UPSERTED)
def upsert_full(spark, sf):
    return _upserted(keyed.upsert_full(table(spark, sf), full_records(spark, sf)))


@query("mark_error",
       f"{INC}, e as (select source_id, native_id, max('qty ' || cast(cast(l_quantity as bigint) as varchar)) as error from lines group by all) "
       "select t.source_id, t.native_id, t.award_name, coalesce(e.error, t.scrape_error) as scrape_error from tab t left join e "
       "on t.source_id = e.source_id and t.native_id = e.native_id")
def mark_error(spark, sf):
    errs = lines(spark, sf).select(*KEY, F.concat(F.lit("qty "), F.col("l_quantity").cast("long").cast("string")).alias("error"))
    return keyed.mark_error(table(spark, sf), errs).select(*KEY, "award_name", "scrape_error")


@query("pending_keys", f"{ROWS} select source_id, native_id from rows_ where scraped_at is null")
def pending_keys(spark, sf):
    return keyed.pending_keys(rows(spark, sf))


@query("count_all", f"{ROWS} select count(*) as n from rows_")
def count_all(spark, sf):
    return keyed.count_rows(rows(spark, sf))


@query("count_pending", f"{ROWS} select count(*) as n from rows_ where scraped_at is null and source_id = 's1'")
def count_pending(spark, sf):
    return keyed.count_rows(rows(spark, sf), "s1", pending=True)


@query("fields_to_columns",
       "select o_orderkey, o_orderstatus as award_type, case when o_orderpriority <> '5-LOW' then o_orderpriority end as award_description, "
       "null::varchar as affiliation from orders")
def fields_to_columns(spark, sf):
    o = standin.table(spark, sf, "orders")
    fields = F.map_filter(
        F.create_map(F.lit("UW_AWARD_TYPE"), F.col("o_orderstatus"), F.lit("NOT_MAPPED"), F.col("o_orderstatus"),
                     F.lit("UW_AWARD_LDESCR"), F.when(F.col("o_orderpriority") != "5-LOW", F.col("o_orderpriority"))),
        lambda _, v: v.isNotNull())
    named = o.select("o_orderkey", *keyed.fields_to_columns(fields))
    return named.select("o_orderkey", "award_type", "award_description", "affiliation")


@query("schema_upgrade", "select 'old' as source_id, cast(o_orderkey as varchar) as native_id, o_orderstatus as career from orders")
def schema_upgrade(spark, sf):
    old = standin.table(spark, sf, "orders").select(F.col("o_orderkey").cast("string").alias("award_id"),
                                                    F.col("o_orderstatus").alias("career"))
    return keyed.checked_upgrade(old, "old")


@query("add_missing_columns", "select o_orderkey, null::varchar as application_status from orders")
def add_missing_columns(spark, sf):
    df, _ = keyed.add_missing_columns(standin.table(spark, sf, "orders").select("o_orderkey"),
                                      {"o_orderkey": "long", "application_status": "string"})
    return df


@query("reject_unknown_columns", f"{INC} select 'declared' as frame, count(*) as n, '' as refused from lines "
       "union all select 'with extras', 0, 'unknown column(s): l_tax, zeta'")
def reject_unknown_columns(spark, sf):
    declared = full_records(spark, sf)
    out = keyed.count_rows(keyed.reject_unknown_columns(declared)).select(
        F.lit("declared").alias("frame"), "n", F.lit("").alias("refused"))
    try:
        keyed.reject_unknown_columns(declared.withColumn("zeta", F.lit(1)).withColumn("l_tax", F.lit(1)))
    except keyed.UnknownColumns as refused:
        extra = keyed.count_rows(declared.where("false")).select(F.lit("with extras").alias("frame"), "n", F.lit(str(refused)).alias("refused"))
        return out.unionByName(extra)
    return out


# --- registry joins -----------------------------------------------------------------
@query("unknown_sources", f"{RR} select distinct source_id from rows_ where source_id not in (select source_id from registry)")
def unknown_sources(spark, sf):
    return lookups.unknown_sources(rows(spark, sf), registry(spark))


@query("missing_sources", f"{RR} select source_id from registry where status = 'active' and source_id not in (select source_id from rows_)")
def missing_sources(spark, sf):
    return lookups.missing_sources(rows(spark, sf), registry(spark))


@query("blocked_with_rows", f"{RR}, {HEALTH} select source_id, total from health join registry using (source_id) where status = 'blocked'")
def blocked_with_rows(spark, sf):
    return lookups.blocked_with_rows(counts.source_health(rows(spark, sf)), registry(spark))


@query("registry_enrich", f"{RR} select award_uid, registry.source_url as registry_url, delivery from records left join registry using (source_id)")
def registry_enrich(spark, sf):
    reg = registry(spark).withColumn("defaults", F.lit(None).cast("string"))
    return lookups.registry_enrich(records(spark, sf).select("award_uid", "source_id"), reg).select(
        "award_uid", "registry_url", "delivery")


@query("vocab_unknown",
       f"{R}, p as ({PAIRS_SQL}), c as (select facet, value, count(*) as n from p group by 1, 2), "
       "asked as (select distinct 'areas_of_study' as facet, replace(p_brand, '#', ' ') as value from part union "
       "select distinct 'award_types', lower(p_type) from part union select distinct 'areas_of_study', replace(p_brand, '#', ' ') || ' Studies' from part), "
       "miss as (select * from asked where (facet, value) not in (select (facet, value) from c)) "
       "select m.facet, m.value, coalesce((select array_to_string((list(c.value order by c.n desc, c.value))[1:2], ', ') from c "
       "where c.facet = m.facet and contains(lower(c.value), lower(m.value))), '') as near from miss m")
def vocab_unknown(spark, sf):
    p = standin.table(spark, sf, "part")
    brand = F.regexp_replace("p_brand", "#", " ")
    ask = lambda f, v: p.select(F.lit(f).alias("facet"), v.alias("value")).distinct()
    asked = ask("areas_of_study", brand).unionByName(ask("award_types", F.lower("p_type"))).unionByName(
        ask("areas_of_study", F.concat(brand, F.lit(" Studies"))))
    return lookups.vocab_unknown(asked, counts.facet_counts(records(spark, sf)))


PEOPLE = ("people as (select 'c:' || c_custkey as award_uid, cast(c_custkey as varchar) as award_id from customer "
          "union all select 's:' || s_suppkey, cast(s_suppkey as varchar) from supplier), "
          "ids as (select distinct cast(o_custkey as varchar) as id from orders union select distinct 'c:' || o_custkey from orders "
          "union select distinct 'x' || o_custkey from orders)")


def people(spark, sf):
    c = standin.table(spark, sf, "customer").select(
        F.concat(F.lit("c:"), "c_custkey").alias("award_uid"), F.col("c_custkey").cast("string").alias("award_id"))
    s = standin.table(spark, sf, "supplier").select(
        F.concat(F.lit("s:"), "s_suppkey").alias("award_uid"), F.col("s_suppkey").cast("string").alias("award_id"))
    k = standin.table(spark, sf, "orders").select(F.col("o_custkey").cast("string").alias("k"))
    ids = k.select(F.explode(F.array("k", F.concat(F.lit("c:"), "k"), F.concat(F.lit("x"), "k"))).alias("id"))
    return ids, c.unionByName(s)


@query("detail_lookup",
       f"with {PEOPLE}, u as (select id, award_uid from ids join people on id = award_uid), "
       "b as (select id, p.award_uid, count(p.award_uid) over (partition by id) as n from ids left join people p on id = award_id "
       "where id not in (select id from u)) select id, award_uid, 'found' as status from u union all "
       "select id, award_uid, case when n = 0 then 'not found' when n = 1 then 'found' else 'ambiguous' end from b")
def detail_lookup(spark, sf):
    return lookups.detail_lookup(*people(spark, sf))


@query("permalink_lookup",
       f"with {PEOPLE} select id, coalesce((select min(award_uid) from people where award_uid = id), "
       "(select min(award_uid) from people where award_id = id)) as award_uid from ids")
def permalink_lookup(spark, sf):
    return lookups.permalink_lookup(*people(spark, sf))


@query("crawl_policy_gate",
       "with u as (select url, lower(regexp_extract(url, '^[a-z]+://([^/?#]*)', 1)) as host from pages), h as (select distinct host from u), "
       "r as (select host, length(host) % 4 as k from h) select url, host, case when k = 0 then true when k = 1 then false "
       "when k = 2 then not starts_with(regexp_extract(url, '^[a-z]+://[^/?#]*([^#]*)', 1), '/de') "
       "else starts_with(regexp_extract(url, '^[a-z]+://[^/?#]*([^#]*)', 1), '/en') end as allowed from u join r using (host)")
def crawl_policy_gate(spark, sf):
    """Rules per host by the length of its name: none, unreadable, a bar on /de, only /en."""
    from canvass.functions.fields import host_of

    urls = standin.table(spark, sf, "pages").select("url")
    hosts = urls.select(host_of("url").alias("host")).distinct().withColumn("k", F.length("host") % 4)
    rule = lambda n, prefix, allow, ok: F.struct(
        F.lit(n).alias("rule_no"), F.lit(prefix).alias("prefix"), F.lit(allow).alias("allow"), F.lit(ok).alias("readable"))
    sets = F.when(F.col("k") == 1, F.array(rule(1, "/", True, False))).when(
        F.col("k") == 2, F.array(rule(1, "/de", False, True))).when(
        F.col("k") == 3, F.array(rule(1, "/en", True, True), rule(2, "/", False, True)))
    rules = hosts.where("k > 0").select("host", F.inline(sets))
    return lookups.crawl_policy_gate(urls, rules)


@query("load_corpus",
       f"{RR}, core_ as (select award_uid, award_name, 0 as o from records where {CORE_SQL}), "
       "shards as (select award_uid, 'shard ' || award_name as award_name, 1 as o from records join registry using (source_id) where status = 'active'), "
       "b as (select * from core_ union all select * from shards) select award_uid, award_name from b "
       "qualify row_number() over (partition by award_uid order by o) = 1")
def load_corpus(spark, sf):
    r = records(spark, sf).select("award_uid", "source_id", "award_name")
    core = r.where(F.col("source_id").isin("s0", "s4"))
    shards = r.withColumn("award_name", F.concat(F.lit("shard "), "award_name"))
    return lookups.load_corpus(core, shards, registry(spark)).select("award_uid", "award_name")


@query("merge_shard", f"{R} select award_uid, application_status is distinct from 'Open' as added from records")
def merge_shard(spark, sf):
    r = records(spark, sf).select("award_uid", "award_name", "application_status")
    have = r.where("application_status = 'Open'")
    return lookups.merge_shard(have, r.unionByName(r)).select("award_uid", "added")


@query("golden_keep_labels",
       "with existing as (select doc_id, quality = 1 as labelled from labels), done as (select doc_id from existing where labelled) "
       "select doc_id as award_uid, 'old' as sampled_for, true as kept from done union all select doc_id, lang, false from documents "
       "where doc_id not in (select doc_id from done)")
def golden_keep_labels(spark, sf):
    sample = standin.table(spark, sf, "documents").select(
        F.col("doc_id").alias("award_uid"), F.col("lang").alias("sampled_for"), F.lit(False).alias("labelled"))
    existing = standin.table(spark, sf, "labels").select(
        F.col("doc_id").alias("award_uid"), F.lit("old").alias("sampled_for"), (F.col("quality") == 1).alias("labelled"))
    return lookups.golden_keep_labels(sample, existing).select("award_uid", "sampled_for", "kept")


# --- ids ----------------------------------------------------------------------------
@query("stable_native_id",
       f"{R}, s as (select award_uid, {sql_slug('award_name')} as slug, coalesce(award_description, '') as d from records), "
       "n as (select *, row_number() over (partition by slug order by d, award_uid) as rn from s) "
       "select award_uid, case when rn = 1 then slug else slug || '-' || rn end as stable_id from n")
def stable_native_id(spark, sf):
    r = records(spark, sf).select("award_uid", "award_name", "award_description")
    return ranking.stable_native_id(r).select("award_uid", "stable_id")


@query("collision_suffix",
       f"with c as (select p_partkey, {sql_slug('p_name')} as slug from part) select p_partkey, "
       "case when p_partkey = min(p_partkey) over (partition by slug) then slug else slug || '-' || p_partkey end as card_id from c")
def collision_suffix(spark, sf):
    cards = standin.table(spark, sf, "part").select("p_partkey", "p_name")
    return ranking.collision_suffix(cards, "p_name", "p_partkey").select("p_partkey", "card_id")


# --- gates and publishing -------------------------------------------------------------
GATE = (f"{RR}, {HEALTH}, x as (select coalesce(h.source_id, r.source_id) as source_id, r.source_id is not null as known, r.status, "
        "r.min_awards, r.min_scraped_fraction, coalesce(total, 0) as total, coalesce(scraped, 0) as scraped from health h full outer join registry r "
        "on h.source_id = r.source_id) ")


@query("publish_gate", GATE + " union all ".join(
    f"select source_id, '{name}' as problem, total, scraped from x where {cond}" for name, cond in [
        ("unknown source", "not known"), ("no rows", "status = 'active' and total = 0"),
        ("below floor", "status = 'active' and total > 0 and total < min_awards"),
        ("too few scraped", "status = 'active' and total > 0 and scraped / total < coalesce(min_scraped_fraction, 0.95)"),
        ("blocked with rows", "status = 'blocked' and total > 0")]))
def publish_gate(spark, sf):
    return publish.publish_gate(rows(spark, sf), registry(spark))


@query("run_floor_gate", f"{RR}, {HEALTH} select source_id, total as records, min_awards from health join registry using (source_id) "
       "where delivery = 'shard' and total < min_awards")
def run_floor_gate(spark, sf):
    reg = registry(spark)
    runs = counts.source_health(rows(spark, sf)).join(reg.select("source_id", "delivery"), "source_id").select(
        "source_id", F.col("total").alias("records"), (F.col("delivery") == "core").alias("limited"))
    return publish.run_floor_gate(runs, reg)


@query("uid_gate", f"{R}, u as (select award_uid, count(*) as n, count(*) filter ({CORE_SQL}) as c from records group by 1) "
       "select cast(sum(n) as bigint) as records, cast(coalesce(sum(n) filter (award_uid is null or award_uid = ''), 0) as bigint) as missing_uid, "
       "count(*) filter (n > 1) as duplicated_uid, cast(sum(c) as bigint) as core_records, "
       "sum(c) > 0 and count(*) filter (n > 1) = 0 and count(*) filter (award_uid is null or award_uid = '') = 0 as ok from u")
def uid_gate(spark, sf):
    return publish.uid_gate(records(spark, sf), F.col("source_id").isin("s0", "s4"))


COUNTS = f"{R}, p as ({PAIRS_SQL}), c as (select facet, value, count(*) as n, count(*) filter ({CORE_SQL}) as n_core from p group by 1, 2)"
VOCAB_MAP = " ".join(f"when '{k}' then '{v}'" for k, v in C.VOCAB_FACETS.items())
VOCAB = f"{COUNTS}, v as (select case facet {VOCAB_MAP} end as filter_key, value from c where n_core > 0 and facet in ({', '.join(q(k) for k in C.VOCAB_FACETS)}))"


def split(spark, sf):
    return counts.facet_counts_split(records(spark, sf), F.col("source_id").isin("s0", "s4"))


@query("vocab_gate", f"{COUNTS} select facet, count(*) as n_values, 'too many values' as problem from c where facet in ("
       + ", ".join(q(k) for k in C.VOCAB_FACETS) + ") group by 1 having count(*) > 5 union all "
       "select 'interests', 0, 'missing or empty'")
def vocab_gate(spark, sf):
    return publish.vocab_gate(counts.facet_counts(records(spark, sf)), [*C.VOCAB_FACETS, "interests"], limit=5)


@query("vocab_extract", f"{VOCAB} select filter_key, value from v")
def vocab_extract(spark, sf):
    return publish.vocab_extract(split(spark, sf))


@query("vocab_version", f"{VOCAB}, k as (select filter_key || ':' || array_to_string(list_sort(list(value)), ',') as t from v group by filter_key) "
       "select substr(sha256(array_to_string(list_sort(list(t)), '|')), 1, 12) as version from k")
def vocab_version(spark, sf):
    return publish.vocab_version(publish.vocab_extract(split(spark, sf)))


@query("publish_meta", f"{RR}, {HEALTH} select source_id, total, scraped, errors, source_url from health left join registry using (source_id)")
def publish_meta(spark, sf):
    return publish.publish_meta(rows(spark, sf), registry(spark))


@query("publish_manifest",
       f"{RR}, {HEALTH}, p as ({PAIRS_SQL}), c as (select facet, value, count(*) as n, count(*) filter ({CORE_SQL}) as n_core from p group by 1, 2) "
       "select 'facets' as section, facet as key, value, n from c union all select 'core_facets', facet, value, n_core from c where n_core > 0 "
       "union all select 'sources', source_id, source_url, total from health left join registry using (source_id) "
       "union all select 'total_awards', null, null, cast(sum(total) as bigint) from health union all select 'schema_version', null, null, 2 "
       f"union all select 'disclaimer', null, {q(C.MANIFEST_LEAD)} || ' ' || (select array_to_string(list(trim(disclaimer) order by source_id), ' ') from registry "
       "where status = 'active' and coalesce(disclaimer, '') <> ''), null "
       "union all select 'endpoints', k, v, null from (values " + ", ".join(f"({q(k)}, {q(v)})" for k, v in C.ENDPOINTS.items()) + ") e(k, v) "
       f"union all select 'shards', source_id, {q(C.SHARD_PATH)} || source_id, total from health join registry using (source_id) "
       "where status = 'active' and delivery = 'shard'")
def publish_manifest(spark, sf):
    reg = registry(spark)
    return publish.publish_manifest(split(spark, sf), publish.publish_meta(rows(spark, sf), reg), reg)


@query("stale_shards", f"{RR} select source_id from registry where source_id not in (select source_id from records)")
def stale_shards(spark, sf):
    return publish.stale_shards(registry(spark).select("source_id"), records(spark, sf))


@query("write_core_and_shards", f"{RR} select case when delivery = 'core' and status = 'active' then 'core' else 'shard' end as delivery, source_id, count(*) as n "
       "from records left join registry using (source_id) group by 1, 2")
def write_core_and_shards(spark, sf):
    slim = records(spark, sf).select("award_uid", "source_id", "award_name", "amount_max")
    path = publish.write_core_and_shards(slim, registry(spark), shared_folder(spark, "shards"))
    return spark.read.parquet(path).groupBy("delivery", "source_id").agg(F.count(F.lit(1)).alias("n"))


@query("staged_publish", f"{R} select 'full' as output, count(*) as n from records union all select 'slim', count(*) from records")
def staged_publish(spark, sf):
    r = records(spark, sf)
    root = publish.staging_root(spark)
    clean = publish.uid_gate(r, F.col("source_id").isin("s0", "s4")).where(~F.col("ok"))
    publish.staged_publish(publish.slim_and_full(r), [clean], root, "v1")
    n = lambda name: publish.published(spark, root, name).agg(F.count(F.lit(1)).alias("n")).select(
        F.lit(name).alias("output"), "n")
    return n("full").unionByName(n("slim"))
