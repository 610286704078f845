"""Machine-proposed filters: validation, widening, relaxation, contract checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from canvass import config as C
from canvass.functions.once import with_once
from canvass.functions.text import SPACE, as_col, nfkc, strip, str_array

FILTER_KEYS = list(C.MAX_VALUES_PER_FILTER)
FACET_OF = {v: k for k, v in C.VOCAB_FACETS.items()}


def question_norm(col, compose: bool = True) -> Column:
    """Composed, white space collapsed, trimmed, cut."""
    text = nfkc(as_col(col)) if compose else as_col(col)
    return F.substring(strip(F.regexp_replace(text, f"{SPACE}+", " ")), 1, C.MAX_QUESTION_CHARS)


def question_key_text(col) -> Column:
    """The part of a question that decides its answer."""
    text = F.regexp_replace(F.lower(as_col(col)), "(?i)" + C.FILLER_PREFIX, "")
    return strip(F.regexp_replace(text, r"[?!.\s]+$", ""))


def question_cache_key(col, prompt_version: str, vocab_version) -> Column:
    version = F.lit(vocab_version) if isinstance(vocab_version, str) else vocab_version
    return F.sha2(F.concat_ws("|", F.lit(prompt_version), version, question_key_text(col)), 256)


def keywords_sanitize(col) -> Column:
    """Free words reduced to a plain charset, few and short."""
    text = F.regexp_replace(F.lower(F.coalesce(as_col(col), F.lit(""))), r"[^a-z0-9 +\-']", " ")
    text = F.substring(F.trim(F.regexp_replace(text, r"\s+", " ")), 1, C.MAX_KEYWORD_CHARS)
    return F.array_join(F.slice(F.split(text, " "), 1, C.MAX_KEYWORDS), " ")


def proposal_parse(col) -> Column:
    """struct(reason, payload): the first text of a completed answer, if it is a JSON object."""
    doc = as_col(col)
    status = F.get_json_object(doc, "$.status")
    steps = F.from_json(
        F.get_json_object(doc, "$.steps"), "array<struct<type: string, content: array<struct<type: string, text: string>>>>")
    outputs = F.flatten(F.transform(
        F.filter(steps, lambda s: s["type"] == "model_output"),
        lambda s: F.coalesce(s["content"], F.from_json(F.lit("[]"), "array<struct<type: string, text: string>>"))))
    texts = F.filter(outputs, lambda c: (c["type"] == "text") & c["text"].isNotNull())
    text = F.try_element_at(texts, F.lit(1))["text"]
    parsed = F.try_parse_json(text)
    # any JSON container counts: an array has no filter keys and proposes nothing
    is_container = F.coalesce(F.trim(text).startswith("{") | F.trim(text).startswith("["), F.lit(False))
    reason = (
        F.when(F.try_parse_json(doc).isNull(), F.lit("no_payload"))
        .when(F.coalesce(status, F.lit("")) != "completed", F.concat(F.lit("status_"), F.coalesce(status, F.lit("missing"))))
        .when(text.isNull(), F.lit("no_text_output"))
        .when(parsed.isNull(), F.lit("unparseable_json"))
        .when(~is_container, F.lit("not_an_object")))
    return F.struct(reason.alias("reason"), F.when(reason.isNull(), text).alias("payload"))


def proposed_values(payload: Column) -> list[Column]:
    """The lists of a payload; anything that is not a list is empty, and what is not text in a list is null."""
    out = []
    for key in FILTER_KEYS:
        raw = F.get_json_object(payload, f"$.{key}")
        read = F.transform(F.from_json(raw, "array<variant>"), lambda v: F.when(
            F.schema_of_variant(v) == "STRING", F.try_variant_get(v, "$", "string")))
        out.append(F.when(raw.startswith("["), read).alias(key))
    return out


def vocabulary_row(vocabulary: DataFrame) -> DataFrame:
    """The whole vocabulary as one row of arrays; the gate bounds its size."""
    return vocabulary.agg(*[
        F.collect_set(F.when(F.col("filter_key") == k, F.col("value"))).alias(k) for k in FILTER_KEYS])


def proposal_validate(proposals: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Keep known values once, capped per filter, and count what was dropped.

    The bounded vocabulary enters as one scalar subquery with an array per filter,
    so proposals are checked inside their rows without a join.
    """
    known_row = vocabulary_row(vocabulary).select(F.struct(*FILTER_KEYS).alias("known")).scalar()
    out, dropped = proposals, F.lit(0)
    none = F.array().cast("array<string>")
    for key in FILTER_KEYS:
        known = F.coalesce(known_row[key], none)
        raw = F.coalesce(F.col(key), none)
        valid = F.array_intersect(F.array_compact(raw), known)
        capped = F.slice(valid, 1, C.MAX_VALUES_PER_FILTER[key])
        out = out.withColumn(f"_{key}", capped)
        dropped = dropped + F.size(raw) - F.size(f"_{key}")
    out = out.withColumn("dropped", dropped)
    keep = [c for c in proposals.columns if c not in FILTER_KEYS]
    return out.select(*keep, *[F.col(f"_{k}").alias(k) for k in FILTER_KEYS], "dropped")


# --- relaxation -------------------------------------------------------------------
SIGNATURE = [FACET_OF[k] for k in FILTER_KEYS]


OTHER = "\x01"


def asked_values(questions: DataFrame) -> DataFrame:
    """One row: the values any question selects, per filter (a subset of the vocabulary)."""
    none = F.array().cast("array<string>")
    pairs = F.array(*[F.struct(F.lit(k).alias("k"), F.coalesce(F.col(k), none).alias("vs")) for k in FILTER_KEYS])
    flat = questions.select(F.inline(pairs)).select("k", F.explode("vs").alias("v")).distinct()
    return flat.agg(F.struct(*[
        F.collect_set(F.when(F.col("k") == k, F.col("v"))).alias(k) for k in FILTER_KEYS]).alias("asked"))


def record_signatures(records: DataFrame, asked: Column) -> DataFrame:
    """Distinct facet combinations as far as the questions can tell them apart.

    Values nobody asks for only matter as being there at all, so they fold into
    one marker; that keeps the combinations few however many records there are.
    """
    none = F.array().cast("array<string>")
    cols = []
    for key in FILTER_KEYS:
        facet = FACET_OF[key]
        values = F.array_compact(F.array(F.col(facet))) if facet == "career" else F.coalesce(F.col(facet), none)
        known = F.sort_array(F.array_intersect(values, F.coalesce(asked[key], none)))
        cols.append(F.when((F.size(values) > 0) & (F.size(known) == 0), str_array([OTHER])).otherwise(known).alias(facet))
    return records.select(*cols).groupBy(*SIGNATURE).agg(F.count(F.lit(1)).alias("n_records"))


def _passes(key: str) -> Column:
    """Does a signature pass one filter of a question?  Affiliation browses: silence fails."""
    selected, values = F.col(f"ask_{key}"), F.col(FACET_OF[key])
    hit = F.arrays_overlap(values, selected)
    silent_ok = F.lit(False) if key == "affiliation" else F.size(values) == 0
    return (F.size(selected) == 0) | silent_ok | hit


def question_tokens(selected: Column) -> Column:
    """Tokens of a selection; they meet ``record_tokens`` exactly when the two are compatible."""
    wanted = F.transform(selected, lambda v: F.concat(F.lit("="), v))
    return F.when(F.size(selected) == 0, str_array(["*"])).otherwise(F.concat(wanted, str_array(["?"])))


def record_tokens(stated: Column) -> Column:
    values = F.transform(stated, lambda v: F.concat(F.lit("="), v))
    return F.concat(F.when(F.size(stated) == 0, str_array(["?"])).otherwise(values), str_array(["*"]))


def relax_ladder(questions: DataFrame, records: DataFrame, key: str = "question_id") -> DataFrame:
    """Clear filters one by one until something matches.

    The identity filters (career, area) never relax, so questions meet records
    on the area, in an equi-join between distinct interpretations and distinct
    facet combinations; each meeting adds its record count to the first step of
    the ladder at which it passes.
    """
    none = F.array().cast("array<string>")
    asks_of = [f"ask_{k}" for k in FILTER_KEYS]
    asked = questions.select(key, *[F.sort_array(F.coalesce(F.col(k), none)).alias(f"ask_{k}") for k in FILTER_KEYS])
    asked = asked.withColumn("ask", F.to_json(F.struct(*asks_of)))
    asks = asked.groupBy("ask").agg(*[F.any_value(c).alias(c) for c in asks_of])
    asks = with_once(asks, {"q_tokens": question_tokens(F.col("ask_areaOfStudy"))})
    sigs = with_once(
        record_signatures(records, asked_values(questions).scalar()), {"r_tokens": record_tokens(F.col("areas_of_study"))})
    met = (
        asks.withColumn("token", F.explode("q_tokens"))
        .join(sigs.withColumn("token", F.explode("r_tokens")), "token")
        .where(F.col("token") == F.array_min(F.array_intersect("q_tokens", "r_tokens")))
        .where(_passes("career")))
    # the place of a filter in the ladder is how many non-empty filters come up to
    # and including it; a record joins in once its last failing filter is cleared
    steps, needed = F.lit(0), F.lit(0)
    for k in C.RELAX_ORDER:
        steps = steps + F.when(F.size(f"ask_{k}") > 0, 1).otherwise(0)
        needed = F.when(~_passes(k), steps).otherwise(needed)
    per_step = met.select("ask", needed.alias("step"), "n_records").groupBy("ask", "step").agg(
        F.sum("n_records").alias("n"))
    best = per_step.groupBy("ask").agg(F.min_by("n", "step").alias("n"), F.min("step").alias("step"))
    joined = asked.join(best, "ask", "left")
    order = F.array_compact(F.array(*[F.when(F.size(f"ask_{k}") > 0, F.lit(k)) for k in C.RELAX_ORDER]))
    step = F.coalesce("step", F.size(order))
    return joined.select(
        key, F.slice(order, F.lit(1), step).alias("relaxed"), F.coalesce("n", F.lit(0)).alias("n_records"))


# --- contract ---------------------------------------------------------------------
def interpretation_contract(interpretations: DataFrame, expectations: DataFrame) -> DataFrame:
    """Expectations against interpretations, one verdict each.

    expectations: question, filter_key, rule (equals | contains | within | empty), wanted.
    """
    pairs = F.array(*[F.struct(F.lit(k).alias("filter_key"), F.col(k).alias("got")) for k in FILTER_KEYS])
    long = interpretations.select("question", F.inline(pairs))
    joined = expectations.join(long, ["question", "filter_key"], "left").withColumn(
        "got", F.coalesce("got", F.array().cast("array<string>")))
    ok = (
        F.when(F.col("rule") == "equals", F.sort_array("got") == F.sort_array("wanted"))
        .when(F.col("rule") == "contains", F.size(F.array_except("wanted", "got")) == 0)
        .when(F.col("rule") == "within", F.size(F.array_except("got", "wanted")) == 0)
        .when(F.col("rule") == "empty", F.size("got") == 0))
    return joined.withColumn("ok", F.coalesce(ok, F.lit(False)))
