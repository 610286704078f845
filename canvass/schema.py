"""Row shapes shared by the jobs."""

from pyspark.sql import types as T

ENTRY = T.StructType([
    T.StructField("values", T.ArrayType(T.StringType())),
    T.StructField("num", T.DoubleType()),
    T.StructField("flag", T.BooleanType()),
    T.StructField("confidence", T.DoubleType()),
    T.StructField("src", T.StringType()),
])
ELIGIBILITY = T.MapType(T.StringType(), ENTRY)

# Columns an ingestion job may write, besides the key.
ADAPTER_COLUMNS = [
    "award_name", "career", "level", "application_selection", "award_type", "award_description",
    "award_value_description", "eligibility_selection_criteria", "area_of_study", "application_details",
    "required_supporting_documents", "contact_detail", "affiliation", "source_url", "deadline_raw",
    "deadline_date", "amount_min", "amount_max", "amount_raw", "renewable", "application_type",
    "application_status", "eligibility_json",
]
KEY = ["source_id", "native_id"]
INTEGER_COLUMNS = {"amount_min": T.LongType(), "amount_max": T.LongType(), "renewable": T.IntegerType()}

# The keyed table: one row per (source_id, native_id).
TABLE = T.StructType(
    [T.StructField(k, T.StringType(), False) for k in KEY]
    + [T.StructField(c, INTEGER_COLUMNS.get(c, T.StringType())) for c in ADAPTER_COLUMNS]
    + [T.StructField("detail_level", T.StringType()),
       T.StructField("raw_fields_json", T.StringType()),
       T.StructField("indexed_at", T.TimestampType()),
       T.StructField("scraped_at", T.TimestampType()),
       T.StructField("scrape_error", T.StringType())]
)

PROFILE = T.StructType([
    T.StructField("profile_id", T.StringType(), False),
    T.StructField("citizenship", T.ArrayType(T.StringType())),
    T.StructField("residency", T.ArrayType(T.StringType())),
    T.StructField("institution", T.ArrayType(T.StringType())),
    T.StructField("program", T.ArrayType(T.StringType())),
    T.StructField("year", T.ArrayType(T.StringType())),
    T.StructField("level", T.ArrayType(T.StringType())),
    T.StructField("identity", T.ArrayType(T.StringType())),
    T.StructField("gpa", T.DoubleType()),
    T.StructField("financial_need", T.BooleanType()),
    T.StructField("full_time", T.BooleanType()),
])

REGISTRY = T.StructType([
    T.StructField("source_id", T.StringType(), False),
    T.StructField("name", T.StringType()),
    T.StructField("status", T.StringType()),
    T.StructField("delivery", T.StringType()),
    T.StructField("source_url", T.StringType()),
    T.StructField("min_awards", T.LongType()),
    T.StructField("min_scraped_fraction", T.DoubleType()),
    T.StructField("disclaimer", T.StringType()),
    T.StructField("defaults", ELIGIBILITY),
])
