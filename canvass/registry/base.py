"""Where queries and their checks in SQL are declared, side by side."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from canvass import config as C
from canvass.operators.record import build_record
from canvass.sources import standin

QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, sql: str | None = None):
    """Register ``fn(spark, sf_dir)``; ``sql`` computes the same rows in another engine."""

    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def aj(col) -> Column:
    """An array as sorted text, so that engines compare equal."""
    return F.array_join(F.array_sort(F.col(col) if isinstance(col, str) else col), ",")


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return build_record(standin.award_rows(spark, sf_dir))


def rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return standin.award_rows(spark, sf_dir)


# --- SQL text of the shared views -------------------------------------------------
WS = r"[\s\p{Z}]"


def q(text: str) -> str:
    """A SQL string literal."""
    return "'" + text.replace("'", "''") + "'"


def sql_strip(x: str) -> str:
    return f"regexp_replace(regexp_replace({x}, '^{WS}+', ''), '{WS}+$', '')"


def sql_clean(x: str) -> str:
    return f"nullif(nullif(nullif({sql_strip(x)}, ''), '-'), '‑')"


def sql_split(x: str) -> str:
    return (
        f"coalesce(list_filter(list_transform(string_split({sql_clean(x)}, ','), lambda p: {sql_strip('p')}), "
        "lambda p: p <> ''), cast([] as varchar[]))")


def sql_aj(x: str) -> str:
    return f"array_to_string(list_sort({x}), ',')"


BACKFILL = r"\$\s?([\d,]+(?:\.\d{2})?)"


def sql_figures(x: str, pattern: str, floor: int) -> str:
    return (
        f"list_filter(list_transform(regexp_extract_all({x}, '{pattern}', 1), "
        f"lambda m: cast(floor(try_cast(regexp_replace(m, '[,\\s]', '', 'g') as double)) as bigint)), "
        f"lambda v: v >= {floor})")


def sql_spans(x: str, pattern: str) -> str:
    found = f"regexp_extract_all({x}, '{pattern}', 0)"
    # distinct in order of first appearance
    first = f"list_filter({found}, lambda s, i: list_position({found}, s) = i)"
    return f"substr(array_to_string(list_transform({first}, lambda s: trim(s)), '; '), 1, 120)"


def sql_excerpt(x: str) -> str:
    c = sql_clean(x)
    return f"case when length({c}) <= 120 then {c} else nullif({sql_spans(c, BACKFILL)}, '') end"


_SCALARS = ["award_name", "career", "award_type", "award_description", "award_value_description",
            "eligibility_selection_criteria", "area_of_study", "application_details",
            "required_supporting_documents", "affiliation", "level", "application_selection",
            "source_url", "deadline_raw", "deadline_date", "application_type", "application_status"]
RECORDS_CTE = (
    "clean_ as (select o_orderkey, o_custkey, conf, "
    + ", ".join(f"e_{f}" for f in [*standin.SET_FIELDS, "gpa_min", "financial_need"])
    + ", native_id as award_id, source_id, source_id || ':' || native_id as award_uid, "
    + ", ".join(f"{sql_clean(c)} as {c}" for c in _SCALARS) + ", "
    + ", ".join(f"{sql_split(t)} as {a}" for t, a in C.MULTI_VALUE_COLUMNS.items())
    + ", amount_min as in_min, amount_max as in_max, amount_raw as in_raw, cast(renewable as boolean) as renewable, "
    + "trim(regexp_extract(raw_fields_json, '\"UW_AWARD_ADDNLINST\": \"([^\"]*)\"', 1)) as addnl from rows_), "
    + "figures_ as (select *, " + sql_figures("award_value_description", BACKFILL, 50) + " as f1, "
    + sql_figures("award_description", BACKFILL, 50) + " as f2 from clean_), "
    + "records as (select * exclude (in_min, in_max, in_raw, f1, f2, addnl), nullif(addnl, '') as additional_instructions, "
    + "case when in_max is not null then in_min when len(f1) > 0 then list_min(f1) when len(f2) > 0 then list_min(f2) "
    + "else in_min end as amount_min, "
    + "case when in_max is not null then in_max when len(f1) > 0 then list_max(f1) when len(f2) > 0 then list_max(f2) "
    + "end as amount_max, "
    + "case when in_max is not null or coalesce(in_raw, '') <> '' then in_raw "
    + f"when len(f1) > 0 then {sql_excerpt('award_value_description')} "
    + f"when len(f2) > 0 then {sql_excerpt('award_description')} end as amount_raw from figures_)")


def with_records(*more: str) -> str:
    """``with`` text giving ``records`` (and further views)."""
    return ", ".join([standin.cte("rows", *[m for m in more if m in standin.CTE]), RECORDS_CTE])


def registry_values() -> list[tuple]:
    """A source registry over the stand-in's source ids: one missing, one blocked, floors that bite."""
    return [
        ("s0", "Source 0", "active", "core", "https://s0.example.org/", 1, 0.95, "Mirror of source 0."),
        ("s1", "Source 1", "active", "shard", "https://s1.example.org/", 1000000000, 0.9, " Mirror of source 1. "),
        ("s2", "Source 2", "active", "shard", "https://s2.example.org/", 1, 0.99, None),
        ("s3", "Source 3", "blocked", "shard", "https://s3.example.org/", 0, 0.0, "Not shown."),
        ("s4", "Source 4", "active", "core", "https://s4.example.org/", 1, None, None),
        ("s5", "Source 5", "planned", "shard", "https://s5.example.org/", 0, 0.0, None),
        ("s6", "Source 6", "active", "shard", "https://s6.example.org/", 1, 0.5, None),
        ("s9", "Source 9", "active", "shard", "https://s9.example.org/", 1, 0.95, ""),
    ]


REG_SCHEMA = ("source_id string, name string, status string, delivery string, source_url string, "
              "min_awards long, min_scraped_fraction double, disclaimer string")


def registry(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(registry_values(), REG_SCHEMA)


def _lit(v) -> str:
    return "null" if v is None else q(v) if isinstance(v, str) else str(v)


REGISTRY_CTE = (
    "registry as (select * from (values "
    + ", ".join("(" + ", ".join(_lit(v) for v in row) + ")" for row in registry_values())
    + ") t(source_id, name, status, delivery, source_url, min_awards, min_scraped_fraction, disclaimer))")
CORE_IDS = ["s0", "s4"]
CORE_SQL = "source_id in ('s0', 's4')"

__all__ = ["QUERIES", "ORACLES", "query", "aj", "records", "rows", "q", "sql_strip", "sql_clean", "sql_split", "sql_aj",
           "sql_figures", "sql_spans", "sql_excerpt", "with_records", "registry", "REGISTRY_CTE", "CORE_IDS",
           "CORE_SQL", "F", "T", "C", "standin", "WS", "BACKFILL", "RECORDS_CTE", "DataFrame", "SparkSession"]
