"""Fixed values.

Everything in this module must equal the published rules for results to be
right: vocabularies, weights, thresholds, patterns and lookup tables.
"""

# --- facets -----------------------------------------------------------------
# One entry per filter.  kind: list | scalar | range | bool.
# semantics: facet (unstated is unconstrained) | gate | tag (browse narrows).
FACETS = [
    {"key": "career", "filter_key": "career", "kind": "scalar", "semantics": "facet", "group": "Study"},
    {"key": "levels", "filter_key": "level", "kind": "list", "semantics": "facet", "group": "Study"},
    {"key": "areas_of_study", "filter_key": "areaOfStudy", "kind": "list", "semantics": "facet", "group": "Study"},
    {"key": "affiliations", "filter_key": "affiliation", "kind": "list", "semantics": "tag", "group": "Eligibility"},
    {"key": "award_types", "filter_key": "awardType", "kind": "list", "semantics": "facet", "group": "Award"},
    {"key": "terms", "filter_key": "term", "kind": "list", "semantics": "facet", "group": "Award"},
    {"key": "source_id", "filter_key": "source", "kind": "scalar", "semantics": "facet", "group": "Award"},
    {"key": "application_status", "filter_key": "applicationStatus", "kind": "scalar", "semantics": "facet",
     "group": "Award", "default": ["Open"]},
    {"key": "application_type", "filter_key": "applicationType", "kind": "scalar", "semantics": "facet",
     "group": "Award"},
    {"key": "amount_max", "filter_key": "amount", "kind": "range", "semantics": "facet", "group": "Award"},
    {"key": "deadline_date", "filter_key": "hasDeadline", "kind": "bool", "semantics": "facet", "group": "Award"},
]
ELIGIBILITY_FACETS = [
    {"key": "residency", "filter_key": "province", "kind": "list", "semantics": "facet", "group": "Eligibility"},
    {"key": "citizenship", "filter_key": "citizenship", "kind": "list", "semantics": "facet", "group": "Eligibility"},
    {"key": "institution", "filter_key": "institution", "kind": "list", "semantics": "facet", "group": "Eligibility"},
    {"key": "identity", "filter_key": "identity", "kind": "list", "semantics": "tag", "group": "Eligibility"},
    {"key": "financial_need", "filter_key": "financialNeed", "kind": "bool", "semantics": "facet",
     "group": "Eligibility"},
    {"key": "gpa_min", "filter_key": "gpa", "kind": "range", "semantics": "facet", "group": "Eligibility"},
]

# Facets whose values enter the vocabulary, and the filter key of each.
VOCAB_FACETS = {
    "career": "career",
    "levels": "level",
    "award_types": "awardType",
    "terms": "term",
    "affiliations": "affiliation",
    "areas_of_study": "areaOfStudy",
}
MAX_VOCAB_VALUES = 400
MAX_VALUES_PER_FILTER = {
    "career": 2, "level": 7, "awardType": 6, "term": 4, "affiliation": 8, "areaOfStudy": 30,
}
RELAX_ORDER = ["term", "level", "affiliation", "awardType"]

FACULTY_WIDE_SUFFIX = "Faculty - All Programs"
OPEN_TO_ALL_AREA = "All Programs"
ENGINEERING_AREA = "Engineering Faculty - All Programs"
NEED_BASED_TYPE = "Bursaries/Financial need"

# --- ranked search ----------------------------------------------------------
FIELD_WEIGHTS = {
    "award_name": 3.0,
    "area_of_study": 2.0,
    "eligibility_selection_criteria": 1.5,
    "award_description": 1.0,
    "award_value_description": 0.5,
    "application_details": 0.25,
}
FUZZY_WEIGHTS = {
    "award_name": 0.4,
    "award_description": 0.2,
    "eligibility_selection_criteria": 0.2,
    "area_of_study": 0.15,
    "affiliation": 0.05,
}
FUZZY_THRESHOLD = 0.32

# --- eligibility ------------------------------------------------------------
EXCLUSION_CONFIDENCE = 0.75
# (field, kind, profile key, wildcards) in the order fields are reported.
ELIGIBILITY_FIELDS = [
    ("citizenship", "set_overlap", "citizenship", []),
    ("residency", "set_overlap", "residency", []),
    ("institution", "set_overlap", "institution", ["any_canadian", "any_eligible_canadian"]),
    ("program", "set_overlap", "program", ["any"]),
    ("program_excluded", "set_exclude", "program", []),
    ("institution_excluded", "set_exclude", "institution", []),
    ("year", "set_overlap", "year", []),
    ("level", "set_overlap", "level", []),
    ("identity", "set_overlap", "identity", []),
    ("gpa_min", "at_least", "gpa", []),
    ("financial_need", "must_be", "financial_need", []),
    ("full_time", "must_be", "full_time", []),
]
VALUE_DOMAINS = {
    "citizenship": ["citizen", "pr", "protected", "international"],
    "residency": ["AB", "BC", "MB", "NB", "NL", "NS", "NT", "NU", "ON", "PE", "QC", "SK", "YT"],
    "identity": ["women", "indigenous", "black", "disability", "first_generation", "refugee", "mature",
                 "lgbtq", "part_time"],
    "level": ["undergraduate", "graduate"],
}
NONE_DECLARED = "none"

# Themed listing pages: what being listed on one says about a record.
CATEGORY_PAGES = {
    "efc-scholarships-for-women": {"affiliation": "Women", "identity": ["women"]},
    "efc-scholarships-for-indigenous-students": {"affiliation": "Indigenous", "identity": ["indigenous"]},
    "efc-scholarships-for-people-of-colour": {"affiliation": "People of colour",
                                              "identity": ["people-of-colour"]},
    "efc-scholarships-for-ontario": {"residency": ["ON"]},
    "efc-scholarships-for-quebec": {"residency": ["QC"]},
    "efc-scholarships-for-atlantic-canada": {"residency": ["NB", "NS", "PE", "NL"]},
    "efc-scholarships-for-western-canada": {"residency": ["AB", "BC", "SK", "MB"]},
}
CATEGORY_CONFIDENCE = 0.9
RESIDENCY_PAGE_WORDS = ["canada", "ontario", "quebec"]
IDENTITY_PAGE_WORDS = ["women", "indigenous", "colour"]

# --- parsing ----------------------------------------------------------------
RAW_VERBATIM_LIMIT = 120
MIN_MEANINGFUL_AMOUNT = 1
MIN_BACKFILL_AMOUNT = 50
STATUS_MAP = {"open": "Open", "ended": "Ended", "closed": "Ended", "archived": "Ended", "upcoming": "Upcoming"}
STATUS_WORDS = ["open", "ended", "closed", "upcoming", "archived", "draft"]
CANONICAL_FACULTY = {
    "faculty of business": "Alberta School of Business",
    "alberta school of business": "Alberta School of Business",
    "faculty of medicine and dentistry": "Faculty of Medicine & Dentistry",
    "faculty of agricultural life and environmental sciences":
        "Faculty of Agricultural Life & Environmental Sciences",
    "faculty of kinesiology sport and recreation": "Faculty of Kinesiology Sport and Recreation",
}
GRADUATE_LEVEL = r"\b(graduate|doctoral|doctorate|ph\.?\s?d|master'?s|masters|postdoctoral|post-doctoral)\b"
UNDERGRAD_LEVEL = r"\b(undergraduate|bachelor'?s|baccalaureate)\b"
UNDERGRAD_HINT = r"\b(first[- ]year|second[- ]year|third[- ]year|fourth[- ]year|entrance|high school)\b"
UNIT_WORD = r"\b(faculty|facult[eé]|school|college|campus|department|institute|programme?s?)\b"
CURRENCY_ONLY = r"^\$?\s*[\d,]+(?:\.\d{2})?\s*$"
DEADLINE_DATE = r"\b(\d{2})/(\d{2})/(\d{4})\b"
MONTH_DAY = (r"^(JANUARY|FEBRUARY|MARCH|APRIL|MAY|JUNE|JULY|AUGUST|SEPTEMBER|OCTOBER|NOVEMBER|DECEMBER)"
             r"\s+\d{1,2}$")
CITIZENSHIP_FLAG = r"citizen|permanent resident|international student|domestic|study permit"
GPA_FLAG = r"\b\d{2}\s?%|minimum .{0,20}(average|CGPA|GPA)|overall average"
CAREER_BY_GROUP = {
    "undergraduate students": "Undergraduate",
    "graduate": "Graduate",
    "graduate students": "Graduate",
    "high school students": "Undergraduate",
}
LEVEL_BY_GROUP = {"high school students": "UG Entering Year 1"}

# Multi-value text column -> array column of the published record.
MULTI_VALUE_COLUMNS = {
    "level": "levels",
    "application_selection": "terms",
    "award_type": "award_types",
    "affiliation": "affiliations",
    "area_of_study": "areas_of_study",
}
# Published slim record: full column -> short column.
SLIM_COLUMNS = {
    "award_id": "id",
    "award_uid": "uid",
    "source_id": "src",
    "award_name": "name",
    "career": "career",
    "levels": "levels",
    "terms": "terms",
    "award_types": "types",
    "affiliations": "affiliations",
    "areas_of_study": "areas",
    "award_value_description": "value",
    "application_status": "status",
}
# Page field name -> table column.
FIELD_COLUMNS = {
    "UW_AWARD_DISPLAYNM": "award_name",
    "UW_AWARD_TYPE": "award_type",
    "UW_AWARD_LDESCR": "award_description",
    "UW_AWARD_VALDESCR": "award_value_description",
    "UW_AWARD_EGSL_CRIT": "eligibility_selection_criteria",
    "UW_AWARD_AS_SUM": "area_of_study",
    "UW_AWARD_LEVEL": "detail_level",
    "UW_AWARD_APPDETAIL": "application_details",
    "UW_AWARD_SPDOCDSCR": "required_supporting_documents",
    "UW_AWARD_CNTCTDETS": "contact_detail",
    "UW_AWARD_AFFLTNIND": "affiliation",
}
PROMOTED_FIELD = "UW_AWARD_ADDNLINST"
DEFAULT_MIN_SCRAPED = 0.95
MANIFEST_LEAD = "An unofficial collection of public listings; check anything that matters at its source."
#: What is published, by name and place below a version.
ENDPOINTS = {"records": "records", "slim": "slim", "facets": "facets", "meta": "meta", "manifest": "manifest",
             "vocabulary": "vocabulary"}
SHARD_PATH = "records/delivery=shard/source_id="
ROW_CAP = 300

# --- pages ------------------------------------------------------------------
OPAQUE_TAGS = ["script", "style", "noscript", "template"]
VOID_TAGS = ["area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"]
BLOCK_TAGS = ["p", "div", "li", "tr", "br", "h1", "h2", "h3", "h4", "h5", "h6", "blockquote", "pre", "section",
              "article", "td", "th", "dt", "dd"]
LINE_TAGS = ["p", "li", "h1", "h2", "h3", "h4", "h5", "h6", "blockquote", "pre", "tr"]
STOP_LABELS = ["Award", "Deadline", "Donor", "Donors", "Supplemental Questions"]
NAVIGATION_WORDS = ["Skip to Navigation", "Skip to Content", "Sign In", "Opportunities", "Scholarship", "Ours",
                    "Donors"]
CHROME_MARKERS = ["On this page:", "Need Help?", "Student Aid Journey", "© 2026 Government of Alberta"]
MIN_CONTAINER_CHARS = 40

# --- questions --------------------------------------------------------------
MAX_QUESTION_CHARS = 300
FILLER_PREFIX = (
    r"^(?:please\s+|can\s+you\s+|could\s+you\s+|i(?:'m| am)\s+looking\s+for\s+|show\s+me\s+|find\s+me\s+|find\s+"
    r"|give\s+me\s+|list\s+|search\s+for\s+"
    r"|what\s+(?:awards|scholarships|bursaries)\s+(?:are\s+there\s+)?(?:for\s+)?)+"
)
MAX_KEYWORD_CHARS = 64
MAX_KEYWORDS = 5

# --- request limits ---------------------------------------------------------
PER_KEY_PER_MINUTE = 20
PER_KEY_PER_DAY = 200
GLOBAL_PER_MINUTE = 12
CACHE_TTL_SECONDS = 60 * 60 * 24 * 30
BREAKER_FAILURES = 2
BREAKER_SECONDS = 60

# --- labelling sample -------------------------------------------------------
SAMPLE_SEED = 20260927
# (concept, quota, pattern); the last draws from any record that has text.
SAMPLE_PROBES = [
    ("program_exclusion", 14, r"\b(excluding|not open to|other than|except(ing)?|ineligible)\b"),
    ("residency", 14, r"\b(resident of|residency|Ontario resident|Alberta resident|resided in)\b"),
    ("citizenship", 14, r"\b(citizen|permanent resident|domestic student|international student|protected person"
                        r"|study permit)\b"),
    ("nomination", 12, r"\b(nominat|selected by the|no application is required|students are chosen)\b"),
    ("identity", 12, r"\b(women|female|Indigenous|Black|disabilit|first.generation|refugee|LGBTQ|mature student)\b"),
    ("year", 12, r"\b(first|second|third|fourth|1st|2nd|3rd|4th)[- ]year\b|\byear (one|two|three|four)\b"),
    ("gpa", 12, r"\b(\d{2}(\.\d)?%|minimum .{0,12}average|cumulative average|grade point)\b"),
    ("financial_need", 10, r"\b(financial need|demonstrated need|financial circumstances|OSAP)\b"),
    ("deadline", 10, r"\b(deadline|apply by|applications? (are )?(due|close)|no later than)\b"),
    ("baseline", 10, None),
]
AUDIT_PROBES = [
    ("residency", r"resid(ed|ent) in Ontario|Ontario resident|resident of Ontario|lived in Ontario"),
    ("citizenship", r"Canadian citizen|permanent resident|domestic (student|undergraduate)"
                    r"|international (student|tuition)|study permit|protected person"),
    ("financial_need", r"demonstrated? financial need|must demonstrate financial"),
    ("gpa_min", r"minimum (?:overall |cumulative |admission )?average of \d{2}|minimum \d{2}%"),
    ("program_excluded", r"excluding|not eligible|are not open to"),
]
AUDIT_BEFORE, AUDIT_AFTER = 45, 75
LABEL_LINES = 40
