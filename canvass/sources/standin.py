"""Stand-in corpus: catalogue-shaped views over the given tables.

The given tables hold no award listings, so the shapes the jobs need are
derived from orders, line items, parts, customers, documents, pages and events.
Every derived column is one expression in the subset shared by Spark SQL and
ANSI engines, so that a check in another engine can start from the very same
rows (``cte`` gives its text).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from canvass.sources.readers import spread, spread_by

# --- expressions over lineitem join part --------------------------------------
LINE_SETS = {
    "level": "'UG Year ' || cast(p_size % 4 + 1 as string)",
    "application_selection":
        "case when month(l_shipdate) <= 4 then 'Winter' when month(l_shipdate) <= 8 then 'Spring' else 'Fall' end",
    "award_type":
        "case p_type when 'STANDARD' then 'Awards/Scholarships/Prizes' when 'ECONOMY' then 'Bursaries/Financial need' "
        "when 'PROMO' then 'Entrepreneurial' when 'LARGE' then 'Varsity/Athletics' "
        "when 'SMALL' then 'International experience' else 'Other experiential awards' end",
    "area_of_study":
        "case when p_brand in ('Brand#5', 'Brand#10', 'Brand#15') then 'Engineering Faculty - All Programs' "
        "when p_brand in ('Brand#1', 'Brand#2') then 'All Programs' "
        "when p_brand in ('Brand#3', 'Brand#6', 'Brand#9', 'Brand#12') then replace(p_brand, '#', ' ') || ' Engineering' "
        "else replace(p_brand, '#', ' ') || ' Studies' end",
}

BRANDS = range(1, 26)
LINE_VALUES = {
    "level": [f"UG Year {y}" for y in range(1, 5)],
    "application_selection": ["Fall", "Spring", "Winter"],
    "award_type": ["Awards/Scholarships/Prizes", "Bursaries/Financial need", "Entrepreneurial",
                   "International experience", "Other experiential awards", "Varsity/Athletics"],
    "area_of_study": sorted([
        "All Programs", "Engineering Faculty - All Programs", *[f"Brand {b} Engineering" for b in (3, 6, 9, 12)],
        *[f"Brand {b} Studies" for b in BRANDS if b not in (1, 2, 3, 5, 6, 9, 10, 12, 15)]]),
}

# --- expressions over orders left join the line sets ---------------------------
K = "o_orderkey"
N = "cast(floor(o_totalprice / 100) as bigint)"
DAY = "substr(cast(cast(o_orderdate as date) as string), 1, 10)"
PROVINCE = ("case {k} % 5 when 0 then 'ON' when 1 then 'AB' when 2 then 'QC' when 3 then 'BC' else 'SK' end")
CONF = "case when o_orderkey % 4 = 3 then 0.6 else 0.9 end"

ROW = {
    "source_id": "'s' || cast(o_custkey % 9 as string)",
    "native_id": f"cast({K} as string)",
    "award_name": f"coalesce('The ' || part_name || ' Award', 'Award ' || cast({K} % 50 as string))",
    "career": "case o_orderstatus when 'F' then 'Undergraduate' when 'O' then ' Graduate ' else ' - ' end",
    "level": f"case when {K} % 6 = 0 then '-' else level end",
    "application_selection": f"case when {K} % 7 = 0 then null else application_selection end",
    "award_type": "award_type",
    "affiliation": f"case {K} % 12 when 0 then 'Women' when 1 then 'Indigenous' when 2 then 'Women, Indigenous' "
                   f"when 3 then ' Black , ' when 4 then '‑' end",
    "area_of_study": f"case when {K} % 8 = 0 then null else area_of_study end",
    "award_value_description":
        f"case {K} % 5 when 0 then 'Valued at $' || cast({N} as string) "
        f"when 1 then 'Up to $' || cast({K} % 9 + 1 as string) || ' 250 per year' "
        f"when 2 then null "
        f"when 3 then 'Two prizes are given out of the gift of the founder, one of $' || cast({K} % 9 + 1 as string) "
        f"|| ',500 for the first place and one of $' || cast({N} as string) || '.75 for the second place of the year.' "
        f"else ' Varies ' end",
    "award_description":
        "concat_ws(chr(10), 'Given in memory of a teacher.', "
        f"case when {K} % 3 = 0 then 'Valued at $' || cast({K} % 90 + 10 as string) || ',000 from the fund.' end, "
        f"case when {K} % 13 = 0 then 'Open to all programs excluding Law.' end, "
        f"case when {K} % 11 = 0 then 'Applicants must be a Canadian citizen or permanent resident.' end, "
        f"case when {K} % 17 = 0 then 'Winners are selected by the committee; no application is required.' end, "
        f"case when {K} % 4 = 0 then 'Apply by the deadline of the term.' end, "
        f"case when {K} % 14 = 0 then 'For graduate and undergraduate students.' end, "
        f"case when {K} % 15 = 0 then 'For a doctoral candidate.' end)",
    "eligibility_selection_criteria":
        f"nullif(concat_ws(chr(10), case when {K} % 7 = 0 then 'Must be a resident of Ontario.' end, "
        f"case when {K} % 5 = 0 then 'For women in second year of study.' end, "
        f"case when {K} % 9 = 0 then 'A minimum average of 80% is needed.' end, "
        f"case when {K} % 10 = 0 then 'Demonstrated financial need.' end), '')",
    "application_details": f"case when {K} % 2 = 0 then 'Send the form to the office.' end",
    "required_supporting_documents": f"case when {K} % 16 = 0 then 'Essay' end",
    "contact_detail": "cast(null as string)",
    "source_url": f"'https://s' || cast(o_custkey % 9 as string) || '.example.org/opportunities/' || cast({K} as string)",
    "deadline_raw":
        f"case when {K} % 4 = 0 then null else 'Deadline ' || substr({DAY}, 6, 2) || '/' || substr({DAY}, 9, 2) || '/' "
        f"|| substr({DAY}, 1, 4) end",
    "deadline_date": f"case when {K} % 4 = 0 then null else {DAY} end",
    "amount_min": f"case when {K} % 10 = 0 then {N} end",
    "amount_max": f"case when {K} % 10 = 0 then {N} + 100 end",
    "amount_raw": f"case when {K} % 20 = 0 then 'as listed' end",
    "renewable": f"case {K} % 3 when 0 then 1 when 1 then 0 end",
    "application_type": "case o_custkey % 4 when 0 then 'open' when 1 then 'nomination' "
                        "when 2 then 'institution_mediated' end",
    "application_status": "case o_orderpriority when '1-URGENT' then 'Open' when '2-HIGH' then 'Open' "
                          "when '3-MEDIUM' then 'Ended' when '5-LOW' then 'Upcoming' end",
    "status_word": "case o_orderpriority when '1-URGENT' then ' OPEN ' when '2-HIGH' then 'closed' "
                   "when '3-MEDIUM' then 'Archived' when '5-LOW' then 'draft' else 'whatever' end",
    "raw_fields_json":
        f"case {K} % 6 when 0 then '{{\"UW_AWARD_ADDNLINST\": \" Bring form ' || cast({K} as string) || ' \"}}' "
        f"when 1 then '{{broken' when 2 then '{{\"OTHER\": \"x\"}}' end",
    "indexed_at": "cast(o_orderdate as timestamp)",
    "scraped_at": f"case when {K} % 19 = 0 then null else cast(o_orderdate as timestamp) end",
    "scrape_error": f"case when {K} % 23 = 0 then 'timeout' end",
    # requirement of each eligibility field, and how sure its reading is
    "conf": f"cast({CONF} as double)",
    "e_citizenship": f"case when {K} % 11 = 0 then 'citizen,pr' end",
    "e_residency": f"case when {K} % 3 = 0 then ({PROVINCE.format(k=K)}) || ',MB' end",
    "e_institution": f"case {K} % 8 when 1 then 'any_canadian' when 2 then 'inst-' || cast({K} % 5 as string) end",
    "e_program_excluded": f"case when {K} % 13 = 0 then 'law' end",
    "e_year": f"case when {K} % 6 = 5 then '2,3' end",
    "e_level": f"case when {K} % 10 = 1 then 'graduate' end",
    "e_identity": f"case {K} % 12 when 0 then 'women' when 1 then 'indigenous' when 2 then 'women,indigenous' end",
    "e_gpa_min": f"case when {K} % 9 = 0 then {K} % 40 + 50 end",
    "e_financial_need": f"case {K} % 20 when 0 then 'true' when 10 then 'false' end",
    "o_custkey": "o_custkey",
    "o_orderkey": K,
}

PROFILE = {
    "profile_id": "cast(c_custkey as string)",
    "c_custkey": "c_custkey",
    "p_citizenship": "case c_custkey % 4 when 0 then 'citizen' when 1 then 'international' when 2 then 'pr' end",
    "p_residency": f"case when c_nationkey % 6 = 5 then null else {PROVINCE.format(k='c_nationkey')} end",
    "p_institution": "case c_mktsegment when 'BUILDING' then 'inst-0' when 'MACHINERY' then 'inst-1' "
                     "when 'HOUSEHOLD' then 'inst-2' when 'FURNITURE' then 'inst-3' end",
    "p_program": "case c_mktsegment when 'BUILDING' then 'law' when 'MACHINERY' then 'engineering' else 'arts' end",
    "p_year": "case when c_custkey % 5 = 4 then null else cast(c_custkey % 5 as string) end",
    "p_level": "case c_custkey % 3 when 0 then 'undergraduate' when 1 then 'graduate' end",
    "p_identity": "case c_custkey % 5 when 0 then 'none' when 1 then 'women' when 2 then 'indigenous' end",
    "p_identity_empty": "c_custkey % 5 = 3",
    "p_gpa": "case when c_custkey % 7 = 6 then null else cast(50 + floor(abs(c_acctbal) / 250) as double) end",
    "p_financial_need": "case c_custkey % 3 when 0 then true when 1 then false end",
}

DOC = {
    "source_id": "source",
    "native_id": "cast(doc_id as string)",
    "award_uid": "source || ':' || cast(doc_id as string)",
    "award_name": "split_part(text, chr(10), 1)",
    "area_of_study": "lang",
    "eligibility_selection_criteria": "split_part(text, chr(10), 2)",
    "award_description": "text",
    "award_value_description": "source",
    "application_details": "split_part(text, chr(10), 3)",
    "affiliation": "cast(null as string)",
    "doc_id": "doc_id",
    "lang": "lang",
}

SET_FIELDS = ["citizenship", "residency", "institution", "program_excluded", "year", "level", "identity"]


SPREAD = {"orders", "documents", "pages"}  # tables whose rows feed costly expressions


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    scan = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(scan) if name in SPREAD else scan


def select_exprs(df: DataFrame, exprs: dict) -> DataFrame:
    return df.select(*[F.expr(text).alias(name) for name, text in exprs.items()])


def table_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keyed-table rows, one per order, with the requirement columns beside them."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", _bit("application_selection"))
    of_part = [n for n in LINE_SETS if n != "application_selection"]
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_name", *[_bit(n) for n in of_part])
    per_order = (
        lines.join(parts, lines.l_partkey == parts.p_partkey)
        .groupBy("l_orderkey")
        .agg(F.min("p_name").alias("part_name"), *[F.bit_or(n).alias(n) for n in LINE_SETS])
    )
    orders = spread_by(table(spark, sf_dir, "orders"), K)
    joined = orders.join(per_order, orders.o_orderkey == per_order.l_orderkey, "left")
    return select_exprs(joined.withColumns({n: _names(n) for n in LINE_SETS}), ROW)


def _bit(name: str):
    """The value of a line as one bit; sets of a few known values then add up as integers."""
    place = F.array_position(F.array(*[F.lit(v) for v in LINE_VALUES[name]]), F.expr(LINE_SETS[name]))
    return F.call_function("shiftleft", F.lit(1).cast("long"), (place - 1).cast("int")).alias(name)


def _names(name: str):
    """The bits of an order as comma-separated text, null without lines."""
    held = [F.when(F.col(name).bitwiseAND(F.lit(1 << i)) != 0, F.lit(v)) for i, v in enumerate(LINE_VALUES[name])]
    return F.when(F.col(name).isNotNull(), F.concat_ws(", ", *held))


def profiles_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select_exprs(table(spark, sf_dir, "customer"), PROFILE)


def profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One answer sheet per customer, in the matcher's shape."""
    one = lambda c: F.when(F.col(c).isNotNull(), F.array(F.col(c)))
    return profiles_raw(spark, sf_dir).select(
        "profile_id", "c_custkey",
        one("p_citizenship").alias("citizenship"),
        one("p_residency").alias("residency"),
        one("p_institution").alias("institution"),
        one("p_program").alias("program"),
        one("p_year").alias("year"),
        one("p_level").alias("level"),
        F.when(F.col("p_identity_empty"), F.array().cast("array<string>")).otherwise(one("p_identity"))
        .alias("identity"),
        F.col("p_gpa").alias("gpa"),
        F.col("p_financial_need").alias("financial_need"),
        F.lit(None).cast("boolean").alias("full_time"),
    )


def eligibility_json(row_prefix: str = "e_"):
    """The requirement columns as the JSON text an ingestion job would store."""
    src = lambda f: F.lit(f", \"src\": \"Stated {f}.\"}}")
    conf = F.concat(F.lit(', "confidence": '), F.col("conf").cast("string"))
    pieces = []
    for f in SET_FIELDS:
        quoted = F.concat(F.lit('["'), F.regexp_replace(F.col(row_prefix + f), ",", '", "'), F.lit('"]'))
        if f == "year":
            quoted = F.concat(F.lit("["), F.col(row_prefix + f), F.lit("]"))
        pieces.append(F.concat(F.lit(f'"{f}": {{"value": '), quoted, conf, src(f)))
    for f in ("gpa_min", "financial_need"):
        pieces.append(
            F.concat(F.lit(f'"{f}": {{"value": '), F.col(row_prefix + f).cast("string"), conf, src(f)))
    body = F.concat_ws(", ", *pieces)
    return F.when(body != "", F.concat(F.lit("{"), body, F.lit("}")))


def award_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keyed-table rows in the table's own columns."""
    return table_rows(spark, sf_dir).withColumn("eligibility_json", eligibility_json()).withColumn(
        "award_uid", F.concat_ws(":", "source_id", "native_id"))


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text records, one per document."""
    return select_exprs(table(spark, sf_dir, "documents"), DOC)


# --- the same rows as common table expressions ---------------------------------
def _select(exprs: dict) -> str:
    return ", ".join(f"{text} as {name}" for name, text in exprs.items())


def _lists() -> str:
    return ", ".join(
        f"array_to_string(list_sort(list(distinct {text})), ', ') as {name}" for name, text in LINE_SETS.items()
    )


CTE = {
    "per_order": "per_order as (select l_orderkey, min(p_name) as part_name, " + _lists()
                 + " from lineitem join part on l_partkey = p_partkey group by l_orderkey)",
    "rows": "rows_ as (select " + _select(ROW)
            + " from orders left join per_order on o_orderkey = l_orderkey)",
    "profiles": "profiles as (select " + _select(PROFILE) + " from customer)",
    "docs": "docs as (select " + _select(DOC) + " from documents)",
}


def cte(*names: str) -> str:
    """``with ...`` text for the named views; rows bring what they need."""
    wanted = []
    for n in names:
        if n == "rows" and "per_order" not in wanted:
            wanted.append("per_order")
        wanted.append(n)
    return "with recursive " + ", ".join(CTE[n] for n in wanted)
