"""Sampling, audits, and request accounting."""

from canvass.functions import fields as fx
from canvass.operators import eligibility, sampling
from canvass.registry.base import *  # noqa: F403
from canvass.registry.base import C, F, aj, q, query, records, rows, standin, with_records
from canvass.registry.parsing import LABEL_FIELDS
from canvass.registry import tables
from canvass.session import shared_folder
from canvass.streaming import stateful, windows

R = with_records()
TXT = f"{R}, txt as (select award_uid, concat_ws(chr(10), {', '.join(LABEL_FIELDS)}) as t from records)"


def texts(spark, sf):
    return records(spark, sf).select("award_uid", fx.label_text(*LABEL_FIELDS).alias("t"))


def _hit(pattern):
    return "trim(t) <> ''" if pattern is None else f"regexp_matches(t, {q('(?i)' + pattern)})"


@query("concept_rates", f"{TXT} " + " union all ".join(
    f"select '{c}' as concept, count(*) as n_records, count(*) filter ({_hit(p)}) as n_hits, "
    f"round(count(*) filter ({_hit(p)}) / count(*), 6) as rate from txt" for c, _, p in C.SAMPLE_PROBES if p))
def concept_rates(spark, sf):
    return sampling.concept_rates(texts(spark, sf), "t").withColumn("rate", F.round("rate", 6))


_chain, _taken = [], []
for _c, _n, _p in C.SAMPLE_PROBES:
    _not = " and ".join(f"award_uid not in (select award_uid from s_{t})" for t in _taken)
    _chain.append(f"s_{_c} as (select award_uid from txt where {_hit(_p)}{' and ' + _not if _not else ''} "
                  f"order by md5('{C.SAMPLE_SEED}:' || award_uid), award_uid limit {_n})")
    _taken.append(_c)
DRAWN = f"{TXT}, " + ", ".join(_chain) + ", drawn as (" + " union all ".join(
    f"select '{c}' as concept, award_uid from s_{c}" for c in _taken) + ")"


@query("stratified_sample", f"{DRAWN} select concept, award_uid from drawn")
def stratified_sample(spark, sf):
    return sampling.stratified_sample(texts(spark, sf), "t")


@query("sample_shortfall", f"{DRAWN}, w as (select * from (values " + ", ".join(
    f"('{c}', {n})" for c, n, _ in C.SAMPLE_PROBES) + ") t(concept, quota)), g as (select concept, count(*) as n from drawn group by 1) "
       "select concept, quota, coalesce(n, 0) as drawn from w left join g using (concept) where coalesce(n, 0) < quota")
def sample_shortfall(spark, sf):
    return sampling.sample_shortfall(sampling.stratified_sample(texts(spark, sf), "t"))


LABELS = {"citizenship": "e_citizenship", "residency": "e_residency", "financial_need": "e_financial_need", "gpa_min": "e_gpa_min",
          "program_excluded": "e_program_excluded"}


def _audit(field, pattern):
    where = f"regexp_matches(t, {q('(?i)' + pattern)})"
    at = f"(length(regexp_extract(t, {q('(?is)^(.*?)(?:' + pattern + ')')}, 1)))"
    start = f"greatest({at} - 45, 0)"
    return (f"select award_uid, '{field}' as field, {at} as at, trim(regexp_replace(substr(t, {start} + 1, {at} + 75 - {start}), '\\s+', ' ', 'g')) as context "
            f"from g where labelled and {where} and not (has_{field} and conf >= 0.75)")


GOLD = (f"{TXT}, g as (select r.award_uid, coalesce(application_status = 'Open', false) as labelled, conf, replace(t, chr(10), ' ') as t, "
        + ", ".join(f"{e} is not null as has_{f}" for f, e in LABELS.items()) + " from records r join txt using (award_uid))")


@query("label_audit", f"{GOLD} " + " union all ".join(_audit(f, p) for f, p in C.AUDIT_PROBES))
def label_audit(spark, sf):
    meta = rows(spark, sf).select("award_uid", "conf", *LABELS.values(), "application_status")
    labels = F.array_compact(F.array(*[
        F.when(F.col(e).isNotNull() & (F.col("conf") >= 0.75), F.lit(f)) for f, e in LABELS.items()]))
    gold = texts(spark, sf).join(meta, "award_uid").select(
        "award_uid", F.coalesce(F.col("application_status") == "Open", F.lit(False)).alias("labelled"),
        F.regexp_replace("t", "\n", " ").alias("t"), labels.alias("labels"))
    return sampling.label_audit(gold, "t", "labels")


@query("label_progress",
       "with g as (select lang as sampled_for, coalesce(quality = 1, false) as labelled from documents left join labels using (doc_id)), "
       "c as (select sampled_for, count(*) filter (labelled) as done, count(*) as total from g group by 1) "
       "select sampled_for, done, total, cast(round_even(10.0 * done / total, 0) as integer) as bar, round(done / total, 6) as share from c")
def label_progress(spark, sf):
    gold = standin.table(spark, sf, "documents").join(standin.table(spark, sf, "labels"), "doc_id", "left").select(
        F.col("lang").alias("sampled_for"), F.coalesce(F.col("quality") == 1, F.lit(False)).alias("labelled"))
    return sampling.label_progress(gold).withColumn("share", F.round("share", 6))


@query("label_validate", f"{standin.cte('rows')} select o_orderkey, 'gpa_min' as field, 'gpa_min not 0..100' as problem from rows_ "
       "where e_gpa_min >= 60 and application_status = 'Open'")
def label_validate(spark, sf):
    """Labels of finished entries; a slip of unit puts every grade from 60 up out of range."""
    slipped = F.when(F.col("e_gpa_min") >= 60, F.concat(
        F.lit('{"gpa_min": {"value": '), (F.col("e_gpa_min") * 10).cast("string"), F.lit(', "confidence": 1.0, "src": "x"}}')))
    gold = rows(spark, sf).where("application_status = 'Open'").select("o_orderkey", slipped.alias("j"))
    return eligibility.validate(gold, "o_orderkey", "j")


# --- request accounting ---------------------------------------------------------------
def events(spark, sf):
    e = standin.table(spark, sf, "events")
    return e.withColumn("ts", F.col("ts").cast("timestamp")).withColumn("failed", F.col("event_type") == "error")


EV = "ev as (select user_id, event_id, epoch_us(ts) as t, event_type = 'error' as failed from events)"


def _chain_sql(name, source, width, strict=True):
    ahead = width + 1 if strict else width
    return (f"pts_{name} as (select distinct user_id, t from {source}), nx_{name} as (select user_id, t, min(t) over (partition by user_id order by t "
            f"range between {ahead} following and unbounded following) as nxt from pts_{name}), "
            f"op_{name}(user_id, t) as (select user_id, min(t) from pts_{name} group by 1 union select n.user_id, n.nxt from op_{name} o "
            f"join nx_{name} n on n.user_id = o.user_id and n.t = o.t where n.nxt is not null)")


DAY = 86_400_000_000
ADMIT = (f"with recursive {EV}, {_chain_sql('m', 'ev', 60_000_000)}, {_chain_sql('d', 'ev', DAY)}, "
         "am as (select ev.*, o.t as m0 from ev asof join op_m o on ev.user_id = o.user_id and ev.t >= o.t), "
         "ad as (select am.*, o.t as d0 from am asof join op_d o on am.user_id = o.user_id and am.t >= o.t), "
         "r as (select *, row_number() over (partition by user_id, m0 order by t, event_id) as rm, "
         "row_number() over (partition by user_id, d0 order by t, event_id) as rd from ad)")


@query("admit_per_key", f"{ADMIT} select event_id, rm <= 1 as minute_ok, rd <= 3 as day_ok, rm <= 1 and rd <= 3 as admitted from r")
def admit_per_key(spark, sf):
    got = windows.admit_per_key(events(spark, sf), per_minute=1, per_day=3)
    return got.select("event_id", "minute_ok", "day_ok", "admitted")


def event_stream(spark, sf):
    schema = standin.table(spark, sf, "events").schema
    s = spark.readStream.schema(schema).option("maxFilesPerTrigger", 64).parquet(f"{sf}/events.parquet*")
    return s.withColumn("ts", F.col("ts").cast("timestamp")).withColumn("failed", F.col("event_type") == "error")


@query("admit_per_key_stream", f"{ADMIT} select event_id, rm <= 1 and rd <= 3 as admitted from r")
def admit_per_key_stream(spark, sf):
    got = stateful.admit_per_key_stream(event_stream(spark, sf), per_minute=1, per_day=3)
    return stateful.run_to_table(got, "admit").select("event_id", "admitted")


@query("admit_global",
       f"with recursive {EV}, o as (select event_id, t, t - lag(t) over (order by t, event_id) as gap from ev), "
       "s as (select *, sum(case when gap >= 900000000 then 1 else 0 end) over (order by t, event_id) as span from o), "
       "n as (select *, row_number() over (partition by span order by t, event_id) as rn from s), "
       "w(span, rn, event_id, admitted, log) as (select span, rn, event_id, true, [t] from n where rn = 1 union all "
       "select n.span, n.rn, n.event_id, len(list_filter(w.log, lambda x: n.t - x < 900000000)) < 2, "
       "case when len(list_filter(w.log, lambda x: n.t - x < 900000000)) < 2 then list_append(list_filter(w.log, lambda x: n.t - x < 900000000), n.t) "
       "else list_filter(w.log, lambda x: n.t - x < 900000000) end from w join n on n.span = w.span and n.rn = w.rn + 1) select event_id, admitted from w")
def admit_global(spark, sf):
    return stateful.admit_global(events(spark, sf), limit=2, seconds=900)


@query("request_rate_windows", "select user_id, cast(epoch(date_trunc('minute', ts)) as bigint) as window_start, count(*) as n from events group by 1, 2")
def request_rate_windows(spark, sf):
    return windows.request_rate_windows(events(spark, sf)).select("user_id", F.unix_seconds("window_start").alias("window_start"), "n")


TTL = 3 * 86_400
CACHED = (f"with recursive {EV}, good as (select * from ev where not failed), {_chain_sql('c', 'good', TTL * 1_000_000, strict=False)}, "
          "a as (select ev.*, o.t as put from ev asof left join op_c o on ev.user_id = o.user_id and ev.t > o.t)")


@query("cache_attribution", f"{CACHED} select event_id, case when put is not null and t - put < {TTL * 1_000_000} then 'cache' else 'ai' end as source from a")
def cache_attribution(spark, sf):
    got = windows.cache_attribution(events(spark, sf), "user_id", "ts", "failed", TTL)
    return got.select("event_id", "source")


@query("cache_attribution_stream", "select user_id, count(*) > 0 as called from events where event_type <> 'error' group by 1")
def cache_attribution_stream(spark, sf):
    made = stateful.cache_attribution_stream(event_stream(spark, sf).where(~F.col("failed")).select("user_id", "ts"), "user_id", "ts", "60 days")
    return stateful.run_to_table(made, "cache").select("user_id", F.lit(True).alias("called"))


@query("breaker_spans",
       f"with recursive {EV}, n as (select *, row_number() over (partition by user_id order by t, event_id) as rn from ev), "
       "w(user_id, rn, event_id, outcome, cnt, until) as (select user_id, rn, event_id, case when failed then 'failed' else 'ok' end, "
       "case when failed then 1 else 0 end, cast(0 as bigint) from n where rn = 1 union all "
       "select n.user_id, n.rn, n.event_id, case when n.t < w.until then 'suppressed' when n.failed then 'failed' else 'ok' end, "
       "case when n.t < w.until then w.cnt when not n.failed then 0 when w.cnt >= 2 then 1 else w.cnt + 1 end, "
       "case when n.t < w.until then w.until when n.failed and (case when w.cnt >= 2 then 1 else w.cnt + 1 end) >= 2 then n.t + 43200000000 else w.until end "
       "from w join n on n.user_id = w.user_id and n.rn = w.rn + 1) select event_id, outcome from w")
def breaker_spans(spark, sf):
    got = stateful.breaker_spans_stream(event_stream(spark, sf), seconds=43_200)
    return stateful.run_to_table(got, "breaker").select("event_id", "outcome")


@query("incremental_upsert", tables.UPSERTED)
def incremental_upsert(spark, sf):
    """Incoming records land in a folder and are folded in as a stream."""
    root = shared_folder(spark, "upsert")
    tables.full_records(spark, sf).write.parquet(f"{root}/incoming")
    schema = spark.read.parquet(f"{root}/incoming").schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 4).parquet(f"{root}/incoming")
    return tables._upserted(stateful.incremental_upsert(stream, tables.table(spark, sf), f"{root}/table"))
