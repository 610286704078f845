"""Ranked text search.  A query's terms are a handful of literals, so scoring is a
map over the records: each field is tokenised once and asked for every term.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from canvass import config as C
from canvass.functions import money
from canvass.functions.once import with_once
from canvass.functions.text import as_col, flat_text, str_array, tokenize, words

FIELDS = list(C.FIELD_WEIGHTS)


def query_terms(texts: list[str]) -> list[str]:
    """Distinct tokens of a few request strings."""
    import re
    import unicodedata

    terms = set()
    for text in texts:
        flat = unicodedata.normalize("NFKD", text or "").lower()
        terms.update(t for t in re.split(r"[^a-z0-9]+", flat) if len(t) > 2)
    return sorted(terms)


def terms_of(*columns) -> Column:
    """Distinct tokens over several text columns of a request table."""
    return F.array_distinct(F.concat(*[tokenize(c) for c in columns]))


def merge_lists(request, profile) -> Column:
    """List filters: what was asked plus what the profile holds."""
    none = F.array().cast("array<string>")
    return F.concat(F.coalesce(as_col(request), none), F.coalesce(as_col(profile), none))


def merge_career(request, profile) -> Column:
    """Career: what was asked, else what the profile holds."""
    none = F.array().cast("array<string>")
    asked = F.coalesce(as_col(request), none)
    return F.when(F.size(asked) > 0, asked).otherwise(F.array_compact(F.array(as_col(profile))))


def record_tokens(full: bool = False) -> Column:
    """Distinct tokens over all searched fields of a record."""
    return F.array_distinct(tokenize(F.concat_ws("\n", *FIELDS), full))


def tokens_among(terms: list[str]) -> Column:
    """Those of the terms that are tokens of a record: they alone are looked for, the rest is not cut up."""
    import re

    wanted = [t for t in terms if re.fullmatch("[a-z0-9]{3,}", t)]  # no other term can be a token
    if not wanted:
        return str_array([])
    flat = flat_text(F.concat_ws("\n", *FIELDS))
    return F.regexp_extract_all(flat, F.lit(f"(?<![a-z0-9])({'|'.join(wanted)})(?![a-z0-9])"), 1)


def doc_frequency(records: DataFrame) -> DataFrame:
    """Records containing each term; combined map-side before the one shuffle."""
    return (
        records.select(F.explode(record_tokens()).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df")))


def idf(df, n) -> Column:
    """Rarity of a term, clamped; a term the corpus lacks counts 1."""
    df, n = as_col(df), as_col(n)
    rarity = F.greatest(F.lit(0.1), F.least(F.lit(3.0), F.log(F.greatest(n, F.lit(1)) / df)))
    return F.when(F.coalesce(df, F.lit(0)) == 0, F.lit(1.0)).otherwise(rarity)


def term_idf(records: DataFrame, terms: list[str]) -> Column:
    """idf of each given term over ALL records, as one scalar-subquery array."""
    held = with_once(records.select(*FIELDS), {"t": tokens_among(terms)})
    counted = held.agg(
        F.count(F.lit(1)).alias("n"),
        *[F.count_if(F.array_contains("t", term)).alias(f"d{i}") for i, term in enumerate(terms)])
    return counted.select(F.array(*[idf(f"d{i}", "n") for i in range(len(terms))])).scalar()


def with_hits(records: DataFrame, terms: list[str], full: bool = False) -> DataFrame:
    """Add, for every searched field, which of the terms occur in it."""
    import re

    if all(re.fullmatch("[a-z0-9]+", t) for t in terms) and terms:  # looked for in place
        one = F.lit(r"(?<![\p{L}\p{N}_])(" + "|".join(terms) + r")(?![\p{L}\p{N}_])")
        return with_once(records, {f"_w_{f}": F.regexp_extract_all(flat_text(f, full), one, 1) for f in FIELDS})
    wanted = str_array(terms)
    return with_once(records, {f"_w_{f}": F.array_intersect(words(f, full), wanted) for f in FIELDS})


def _term_weight(term: str) -> Column:
    """Sum of the weights of the fields holding the term, once per field."""
    return reduce(
        lambda a, b: a + b,
        [F.when(F.array_contains(f"_w_{f}", term), F.lit(w)).otherwise(F.lit(0.0)) for f, w in C.FIELD_WEIGHTS.items()])


def _in_any_field(term: str) -> Column:
    return reduce(lambda a, b: a | b, [F.array_contains(f"_w_{f}", term) for f in FIELDS])


def keyword_score(idfs: Column, terms: list[str]) -> Column:
    parts = [_term_weight(t) * idfs[i] for i, t in enumerate(terms)]
    return reduce(lambda a, b: a + b, parts, F.lit(0.0))


def matched_terms(terms: list[str]) -> Column:
    return F.array_compact(F.array(*[F.when(_in_any_field(t), F.lit(t)) for t in terms])) if terms else str_array([])


def exclude_penalty(terms: list[str]) -> Column:
    return reduce(
        lambda a, b: a + b, [F.when(_in_any_field(t), F.lit(-1.5)).otherwise(F.lit(0.0)) for t in terms], F.lit(0.0))


def area_match_tier(areas, programs, faculties) -> Column:
    """How specific the area match is: program, faculty, all, none (columns or literals)."""
    empty = F.array().cast("array<string>")
    have = F.coalesce(as_col(areas), empty)
    wide = F.transform(F.coalesce(as_col(faculties), empty), lambda f: F.concat(f, F.lit(" " + C.FACULTY_WIDE_SUFFIX)))
    return (
        F.when(F.arrays_overlap(have, F.coalesce(as_col(programs), empty)), F.lit("program"))
        .when(F.arrays_overlap(have, wide), F.lit("faculty"))
        .when(F.array_contains(have, C.OPEN_TO_ALL_AREA), F.lit("all"))
        .otherwise(F.lit("none"))
    )


def profile_bonus(profile: dict) -> Column:
    """Reward targeted records over blanket ones; punish a term clash."""
    lit = lambda k: str_array(profile.get(k) or [])
    faculty = [profile["faculty"]] if profile.get("faculty") else []
    tier = area_match_tier("areas_of_study", lit("programs"), str_array(faculty))
    bonus = F.when(tier == "program", 3.0).when(tier == "faculty", 1.0).when(tier == "all", 0.4).otherwise(0.0)
    hit = lambda column, key: F.coalesce(F.arrays_overlap(F.col(column), lit(key)), F.lit(False))
    bonus = bonus + F.when(hit("affiliations", "affiliations"), 2.0).otherwise(0.0)
    bonus = bonus + F.when(hit("award_types", "preferred_types"), 2.0).otherwise(0.0)
    if profile.get("financial_need"):
        need = F.coalesce(F.array_contains("award_types", C.NEED_BASED_TYPE), F.lit(False))
        bonus = bonus + F.when(need, 1.5).otherwise(0.0)
    if profile.get("terms"):
        clash = (F.coalesce(F.size("terms"), F.lit(0)) > 0) & ~hit("terms", "terms")
        bonus = bonus - F.when(clash, 2.0).otherwise(0.0)
    return bonus


def value_bonus(value) -> Column:
    """Up to 1.5 for a stated figure; none or zero adds nothing."""
    value = as_col(value)
    return F.when(value > 0, F.least(F.lit(1.5), value / 5000.0)).otherwise(F.lit(0.0))


def score_records(
    candidates: DataFrame, corpus: DataFrame, terms: list[str], exclude: list[str] | None = None,
    profile: dict | None = None, min_score: float = 0.0,
) -> DataFrame:
    """Score filtered candidates with term statistics of the whole corpus."""
    idfs = term_idf(corpus, terms) if terms else F.array(F.lit(0.0))
    value = money.first_dollar("award_value_description", "award_description")
    total = keyword_score(idfs, terms) + exclude_penalty(exclude or [])
    if profile:
        total = total + profile_bonus(profile)
    held = with_hits(candidates.withColumn("value", value), [*terms, *(exclude or [])])
    scored = with_once(held, {"score": total + value_bonus("value"), "matched": matched_terms(terms)})
    return scored.drop(*[f"_w_{f}" for f in FIELDS]).where(F.col("score") >= min_score)


def rank_topk(scored: DataFrame, k: int = 25) -> DataFrame:
    """Best first, ties by value, name, uid: a distributed top-k, no full sort."""
    return scored.orderBy(
        F.desc("score"), F.desc(F.coalesce("value", F.lit(0))), F.coalesce("award_name", F.lit("")), "award_uid").limit(k)


def rank_topk_per(scored: DataFrame, group: str, k: int) -> DataFrame:
    """Top-k per group; ranks beyond k are dropped before the shuffle."""
    from pyspark.sql import Window

    order = Window.partitionBy(group).orderBy(
        F.desc("score"), F.desc(F.coalesce("value", F.lit(0))), F.coalesce("award_name", F.lit("")), "award_uid")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def fuzzy_distance(field: str, tokens: list[str]) -> Column:
    """Mean over the query words of the nearest field word's relative edit distance.

    A word further than the threshold counts as missing (1).  Words of a
    hopeless length are skipped before any distance is computed.
    """
    field_words = F.col(f"_t_{field}")

    def nearest(q: str) -> Column:
        longest = lambda w: F.greatest(F.length(w), F.lit(len(q)))
        near = F.filter(
            field_words,
            lambda w: (w != "") & (F.abs(F.length(w) - len(q)) <= F.lit(C.FUZZY_THRESHOLD) * longest(w)))
        ratios = F.transform(near, lambda w: F.levenshtein(w, F.lit(q)) / longest(w))
        best = F.array_min(F.filter(ratios, lambda r: r <= C.FUZZY_THRESHOLD))
        return F.coalesce(best, F.lit(1.0))

    parts = [nearest(q) for q in tokens]
    return reduce(lambda a, b: a + b, parts) / len(parts)


def fuzzy_search(records: DataFrame, query: str) -> DataFrame:
    """Records with a field near the query, best first by ``rank_score``; blank keeps all."""
    import re

    tokens = [t for t in re.split(r"[^\w]+", (query or "").strip().lower()) if t]
    if not tokens:
        return records.withColumn("rank_score", F.lit(0.0))
    records = with_once(records, {f"_t_{f}": F.array_distinct(words(f)) for f in C.FUZZY_WEIGHTS})
    distances = {f: fuzzy_distance(f, tokens) for f in C.FUZZY_WEIGHTS}
    held = with_once(records, {f"_d_{f}": d for f, d in distances.items()})
    score = reduce(
        lambda a, b: a + b, [F.lit(w) * (F.lit(1.0) - F.col(f"_d_{f}")) for f, w in C.FUZZY_WEIGHTS.items()])
    near = F.least(*[F.col(f"_d_{f}") for f in C.FUZZY_WEIGHTS]) <= C.FUZZY_THRESHOLD
    return held.where(near).withColumn("rank_score", score).drop(*[f"{p}_{f}" for f in C.FUZZY_WEIGHTS for p in ("_d", "_t")])


def filter_funnel(corpus: DataFrame, filtered: DataFrame, scored: DataFrame, k: int) -> DataFrame:
    """How many records are left after each stage."""
    total = corpus.agg(F.count(F.lit(1)).alias("total")).scalar()
    kept = filtered.agg(F.count(F.lit(1)).alias("after_filters")).scalar()
    return scored.agg(F.count(F.lit(1)).alias("scored")).select(
        total.alias("total"), kept.alias("after_filters"), "scored", F.least("scored", F.lit(k)).alias("shown"))


def cli_profile_merge(request: dict, profile: dict | None) -> dict:
    """Lists: request plus profile.  Career: request instead of profile."""
    profile = profile or {}
    plus = lambda r, p: list(request.get(r) or []) + list(profile.get(p) or [])
    return {
        "career": list(request.get("career") or []) or ([profile["career"]] if profile.get("career") else []),
        "level": plus("level", "levels"),
        "term": plus("term", "terms"),
        "awardType": list(request.get("awardType") or []),
        "affiliation": plus("affiliation", "affiliations"),
        "areas": plus("areas", "programs"),
        "faculties": list(request.get("faculties") or []) + ([profile["faculty"]] if profile.get("faculty") else []),
    }


