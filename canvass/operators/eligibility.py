"""Three-state eligibility: eligible, unknown, excluded.

Exclusion needs a high-confidence requirement that an answer contradicts;
anything softer is unknown, and a field nobody stated constrains nothing.  All
rules are Column expressions, so a match is one projection over its input.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from canvass import config as C
from canvass.functions.once import with_once
from canvass.functions.text import as_col, literal_map, str_array
from canvass.operators.ranking import numbered
from canvass.session import cut_lineage

ELIGIBLE, UNKNOWN, EXCLUDED = "eligible", "unknown", "excluded"
NO_DATA = "No structured eligibility has been extracted for this award yet."
PROFILE_LISTS = ["citizenship", "residency", "institution", "program", "year", "level", "identity"]
PROFILE_SCALARS = ["gpa", "financial_need", "full_time"]


def _none() -> Column:
    return F.array().cast("array<string>")


def _verdict(ok: Column, confidence: Column) -> Column:
    """Eligible, else excluded or unknown by how sure the requirement is."""
    sure = F.coalesce(confidence, F.lit(0.0)) >= C.EXCLUSION_CONFIDENCE
    return F.when(ok, F.lit(ELIGIBLE)).when(sure, F.lit(EXCLUDED)).otherwise(F.lit(UNKNOWN))


def requirement(entry: Column) -> Column:
    """Required values as strings; a lone number counts as one value."""
    return F.coalesce(
        entry["values"],
        F.when(entry["num"].isNotNull(), F.array(number_text(entry["num"]))),
        _none(),
    )


def number_text(col: Column) -> Column:
    """A number the way a reader writes it: 80 rather than 80.0."""
    return F.when(col == F.floor(col), F.floor(col).cast("bigint").cast("string")).otherwise(col.cast("string"))


def _listing(values: Column, quoted: bool) -> Column:
    ordered = F.sort_array(F.array_distinct(values))
    items = F.transform(ordered, lambda v: F.concat(F.lit("'"), v, F.lit("'"))) if quoted else ordered
    return F.concat(F.lit("["), F.array_join(items, ", "), F.lit("]"))


def set_overlap(entry: Column, have: Column, wildcards=()) -> Column:
    """Verdict of a list requirement against a list answer, both given and non-empty."""
    need = requirement(entry)
    overlap = F.arrays_overlap(need, have)
    if wildcards:
        overlap = overlap | F.arrays_overlap(need, str_array(wildcards))
    return _verdict(overlap, entry["confidence"])


def set_exclude(entry: Column, have: Column) -> Column:
    return _verdict(~F.arrays_overlap(requirement(entry), have), entry["confidence"])


def at_least(entry: Column, have: Column) -> Column:
    """Numeric floor; a requirement that is no number cannot be compared."""
    need = F.coalesce(entry["num"], F.element_at(requirement(entry), 1).try_cast("double"))
    have = as_col(have).try_cast("double")
    comparable = need.isNotNull() & have.isNotNull()
    return F.when(~comparable, F.lit(UNKNOWN)).otherwise(_verdict(have >= need, entry["confidence"]))


def must_be(entry: Column, have: Column) -> Column:
    need = F.coalesce(entry["flag"], entry["num"] != 0, F.size(requirement(entry)) > 0)
    return _verdict(need.eqNullSafe(as_col(have)), entry["confidence"])


def unstated(entry: Column) -> Column:
    """No requirement behind the entry."""
    return (F.size(requirement(entry)) == 0) & entry["num"].isNull() & entry["flag"].isNull()


def unanswered(have: Column, is_list: bool) -> Column:
    return (have.isNull() | (F.size(have) == 0)) if is_list else have.isNull()


def _with_src(text: Column, entry: Column) -> Column:
    return F.rtrim(F.concat(text, F.lit(". "), F.coalesce(entry["src"], F.lit(""))))


def field_result(spec, entry: Column, have: Column) -> Column:
    """struct(field, verdict, reason) of one field; null where the record has no entry."""
    name, kind, profile_key, wildcards = spec
    is_list = profile_key in PROFILE_LISTS
    need, quoted = requirement(entry), name != "year"
    silent = F.concat_ws(": ", F.lit(name), F.lit("award requires this; your profile does not say"))
    if kind == "set_overlap":
        verdict = set_overlap(entry, have, wildcards)
        only_none = F.size(F.array_except(have, str_array([C.NONE_DECLARED]))) == 0
        text = F.when(
            only_none, F.concat(F.lit(f"{name}: requires "), _listing(need, quoted), F.lit("; you indicated none apply"))
        ).otherwise(F.concat(
            F.lit(f"{name}: requires "), _listing(need, quoted), F.lit(", you have "), _listing(have, quoted)))
    elif kind == "set_exclude":
        verdict = set_exclude(entry, have)
        text = F.concat(F.lit(f"{name}: explicitly excludes "), _listing(F.array_intersect(need, have), quoted))
    elif kind == "at_least":
        verdict = at_least(entry, have)
        text = F.concat(F.lit(f"{name}: requires "), number_text(entry["num"]), F.lit(", you have "), number_text(have))
    else:
        verdict = must_be(entry, have)
        text = F.concat(
            F.lit(f"{name}: requires "), F.initcap(entry["flag"].cast("string")),
            F.lit(", you have "), F.initcap(have.cast("string")))
    no_need, no_answer = unstated(entry), unanswered(have, is_list)
    final = F.when(no_need, F.lit(ELIGIBLE)).when(no_answer, F.lit(UNKNOWN)).otherwise(verdict)
    reason = F.when(no_need, F.lit(None).cast("string")).when(no_answer, _with_src(silent, entry)).when(
        final != ELIGIBLE, _with_src(text, entry))
    if kind == "at_least":
        reason = F.when(
            ~no_need & ~no_answer & entry["num"].isNull(),
            F.concat(F.lit(f"{name}: could not compare "), number_text(have), F.lit(" to "), _listing(need, quoted)),
        ).otherwise(reason)
    return F.when(
        entry.isNotNull(), F.struct(F.lit(name).alias("field"), final.alias("verdict"), reason.alias("reason")))


def severity(entry: Column, spec, have: Column) -> Column:
    """2 eligible, 1 unknown, 0 excluded; a field the record lacks counts 2."""
    name, kind, profile_key, wildcards = spec
    rule = {"set_overlap": lambda: set_overlap(entry, have, wildcards), "set_exclude": lambda: set_exclude(entry, have),
            "at_least": lambda: at_least(entry, have), "must_be": lambda: must_be(entry, have)}[kind]()
    value = F.when(rule == ELIGIBLE, 2).when(rule == UNKNOWN, 1).otherwise(0)
    return (
        F.when(entry.isNull() | unstated(entry), 2)
        .when(unanswered(have, profile_key in PROFILE_LISTS), 1)
        .otherwise(value))


def verdict_of(entries: dict, answers: dict, empty: Column) -> Column:
    """The verdict alone, from one entry column per field: no reasons are built.

    ``empty``: nothing was extracted; a map of undeclared fields only is not empty.
    """
    worst = F.least(*[severity(entries[s[0]], s, answers[s[2]]) for s in C.ELIGIBILITY_FIELDS])
    return F.when(empty, UNKNOWN).when(worst == 0, EXCLUDED).when(worst == 1, UNKNOWN).otherwise(ELIGIBLE)


def merge_defaults(eligibility, defaults) -> Column:
    """Source defaults under the record's own fields; the record wins per field."""
    empty = F.create_map().cast(
        "map<string, struct<values: array<string>, num: double, flag: boolean, confidence: double, src: string>>")
    own, base = F.coalesce(as_col(eligibility), empty), F.coalesce(as_col(defaults), empty)
    return F.map_zip_with(own, base, lambda _, mine, theirs: F.coalesce(mine, theirs))


def field_results(eligibility: Column, answers: dict) -> Column:
    """Array of per-field results, in the fixed field order."""
    parts = [field_result(spec, F.try_element_at(eligibility, F.lit(spec[0])), answers[spec[2]])
             for spec in C.ELIGIBILITY_FIELDS]
    return F.array_compact(F.array(*parts))


def nothing_extracted(eligibility) -> Column:
    return F.coalesce(F.size(eligibility), F.lit(0)) <= 0


def match(df: DataFrame, eligibility: str, answers: dict, application_type: str | None = None) -> DataFrame:
    """Add verdict, reasons, unknown_fields, excluded_fields to every row.

    ``answers`` maps a profile key to the column (or literal) holding the answer.
    """
    held = with_once(df, {"_fields": field_results(F.col(eligibility), answers)})
    names = lambda v: F.transform(
        F.filter("_fields", lambda r: r["verdict"] == v), lambda r: r["field"])
    held = held.withColumn("unknown_fields", names(UNKNOWN)).withColumn("excluded_fields", names(EXCLUDED))
    empty = nothing_extracted(eligibility)
    verdict = (
        F.when(empty, F.lit(UNKNOWN))
        .when(F.size("excluded_fields") > 0, F.lit(EXCLUDED))
        .when(F.size("unknown_fields") > 0, F.lit(UNKNOWN))
        .otherwise(F.lit(ELIGIBLE))
    )
    held = held.withColumn("verdict", verdict)
    reasons = F.filter(F.transform("_fields", lambda r: r["reason"]), lambda r: r.isNotNull())
    reasons = F.when(empty, F.array(F.lit(NO_DATA))).otherwise(reasons)
    if application_type:
        reasons = F.concat(reasons, nomination_note(F.col("verdict"), F.col(application_type)))
    return held.withColumn("reasons", reasons).drop("_fields")


def with_verdict(df: DataFrame, eligibility: str, answers: dict) -> DataFrame:
    """Only the verdict of every row: the cheap form for counting and filtering."""
    names = [s[0] for s in C.ELIGIBILITY_FIELDS]
    held = with_once(df, {f"_r_{f}": F.try_element_at(F.col(eligibility), F.lit(f)) for f in names})
    verdict = verdict_of({f: F.col(f"_r_{f}") for f in names}, answers, nothing_extracted(eligibility))
    return held.withColumn("verdict", verdict).drop(*[f"_r_{f}" for f in names])


def verdict_groups(records: DataFrame, profile: dict) -> DataFrame:
    """Records per bucket for one profile."""
    judged = with_verdict(records, "eligibility", literal_answers(profile))
    return judged.groupBy("verdict").agg(F.count(F.lit(1)).alias("n"))


def nomination_note(verdict: Column, application_type: Column) -> Column:
    """One extra reason when a match cannot simply be applied for."""
    closed_route = (verdict == ELIGIBLE) & (application_type != "") & (application_type != "open")
    text = F.concat(F.lit("Not an open application: "), F.replace(application_type, F.lit("_"), F.lit(" ")), F.lit("."))
    return F.when(closed_route, F.array(text)).otherwise(_none())


def literal_answers(profile: dict) -> dict:
    """One answer sheet given as plain values."""
    out = {}
    for key in PROFILE_LISTS:
        value = profile.get(key)
        out[key] = F.lit(None).cast("array<string>") if value is None else str_array([str(v) for v in value])
    for key in PROFILE_SCALARS:
        value = profile.get(key)
        out[key] = F.lit(value).cast("double" if key == "gpa" else "boolean")
    return out


def column_answers(prefix: str = "") -> dict:
    return {k: F.col(prefix + k) for k in PROFILE_LISTS + PROFILE_SCALARS}


def match_profile(records: DataFrame, profile: dict) -> DataFrame:
    """One profile against every record: a map over the scan."""
    return match(records, "eligibility", literal_answers(profile), "application_type")


def flatten(records: DataFrame) -> DataFrame:
    """Eligibility entries as top-level facet columns."""
    out = records
    for f in C.ELIGIBILITY_FACETS:
        entry = F.try_element_at(F.col("eligibility"), F.lit(f["key"]))
        slot = {"list": "values", "range": "num", "bool": "flag"}[f["kind"]]
        out = out.withColumn(f["key"], entry[slot])
    return out


# --- many profiles against many records ---------------------------------------
LADDER = 40  # levels over the sorted floors: up to 2^40 of them


def requirement_signatures(records: DataFrame) -> DataFrame:
    """Distinct requirement sets with their record counts; wording is left out.

    The signature space is bounded by the controlled vocabularies, and the
    count is combined map-side, so a hot signature costs one row per task.
    """
    bare = F.transform_values("eligibility", lambda _, e: F.struct(
        F.sort_array(e["values"]).alias("values"), e["num"].alias("num"), e["flag"].alias("flag"),
        e["confidence"].alias("confidence"), F.lit(None).cast("string").alias("src")))
    keyed = with_once(records.select("eligibility"), {"needs": bare}).withColumn(
        "requirement", F.to_json(F.sort_array(F.map_entries("needs"))))
    return keyed.groupBy("requirement").agg(F.count(F.lit(1)).alias("n_records"), F.any_value("needs").alias("needs"))


def answer_signatures(profiles: DataFrame) -> DataFrame:
    """Profiles with the key of their answer sheet."""
    sheet = F.struct(*[F.sort_array(c).alias(c) for c in PROFILE_LISTS], *[F.col(c) for c in PROFILE_SCALARS])
    return profiles.withColumn("answer", F.to_json(sheet, {"ignoreNullFields": "false"}))


def _silent(key: str) -> str:
    return key + "?"


def _answered(key: str) -> str:
    return key + "!"


def _gap(key: str) -> str:
    return key + "~"  # a list answer with a null in it


def _tokens(values: Column, key: str) -> Column:
    return F.transform(F.filter(values, lambda v: v.isNotNull()), lambda v: F.concat(F.lit(key + "="), v))


def stated_fields(needs: Column) -> dict[str, Column]:
    """Per field what both goals read: values, whether anything is asked and how surely, number and flag."""
    out = {}
    for name, kind, _, wildcards in C.ELIGIBILITY_FIELDS:
        entry = F.try_element_at(needs, F.lit(name))
        values = requirement(entry)
        parts = {"values": values, "holds": entry.isNotNull() & ~unstated(entry),
                 "sure": F.coalesce(entry["confidence"], F.lit(0.0)) >= C.EXCLUSION_CONFIDENCE}
        if kind == "at_least":
            parts["need"] = F.coalesce(entry["num"], F.try_element_at(values, F.lit(1)).try_cast("double"))
        elif kind == "must_be":
            parts["need"] = F.coalesce(entry["flag"], entry["num"] != 0, F.size(values) > 0)
        elif kind == "set_exclude":
            parts["gap"] = F.exists(values, lambda v: v.isNull())
        else:
            parts["anyone"] = F.coalesce(F.arrays_overlap(values, str_array(wildcards)), F.lit(False))
        out["r_" + name] = F.struct(*[c.alias(n) for n, c in parts.items()])
    return out


def conditions(sure: bool) -> Column:
    """A requirement set, given by its ``stated_fields``, as struct(must, never, floor) over an answer sheet's tokens.

    ``sure`` gives what must hold lest the set excludes (silence is fine), otherwise
    what must hold for it to be met outright.  Every array of ``must`` needs one of
    its tokens, none of ``never`` may be there, and the average must reach ``floor``.
    """
    must, never, floor = [], [], F.lit(None).cast("double")
    for name, kind, key, wildcards in C.ELIGIBILITY_FIELDS:
        r = F.col("r_" + name)
        holds = (r["holds"] & r["sure"]) if sure else r["holds"]
        if kind == "at_least":
            floor = F.when(holds, r["need"])
            if not sure:  # what cannot be compared is never met
                must.append(F.when(holds & r["need"].isNull(), _none()))
        elif kind == "set_exclude":
            marks = [F.when(F.size(r["values"]) > 0, F.lit(_gap(key))), F.when(r["gap"], F.lit(_answered(key)))]
            marks += [] if sure else [F.lit(_silent(key))]
            hit = F.concat(_tokens(r["values"], key), F.array_compact(F.array(*marks)))
            never.append(F.when(holds, hit).otherwise(_none()))
        else:
            silent = str_array([_silent(key)]) if sure else _none()
            if kind == "must_be":
                asked = F.array(F.concat(F.lit(key + "="), r["need"].cast("string")))
            else:
                asked = _tokens(r["values"], key)
            if wildcards and sure:
                holds = holds & ~r["anyone"]
            elif wildcards:
                asked = F.when(r["anyone"], str_array([_answered(key)])).otherwise(asked)
            must.append(F.when(holds, F.array_sort(F.array_distinct(F.concat(asked, silent)))))
    return F.struct(
        F.array_sort(F.array_distinct(F.array_compact(F.array(*must)))).alias("must"),
        F.array_sort(F.array_distinct(F.concat(*never))).alias("never"), floor.alias("floor"))


def condition_sets(signatures: DataFrame) -> DataFrame:
    """Distinct conditions with their record counts, for both goals; what nobody can meet is left out."""
    goal = lambda name, sure, use: F.when(use, F.struct(F.lit(name).alias("goal"), conditions(sure).alias("c")))
    stated = with_once(signatures, stated_fields(F.col("needs")))
    both = F.array_compact(F.array(goal(ELIGIBLE, False, ~nothing_extracted("needs")), goal(UNKNOWN, True, F.lit(True))))
    each = stated.select("n_records", F.explode(both).alias("g")).select("n_records", "g.goal", "g.c.*")
    return each.where(~F.exists("must", lambda m: F.size(m) == 0)).groupBy("goal", "must", "never", "floor").agg(
        F.sum("n_records").alias("n_records"))


def answer_tokens() -> Column:
    """What an answer sheet holds: its values by field, and marks for silence, answers and nulls."""
    parts = []
    for key in sorted({f[2] for f in C.ELIGIBILITY_FIELDS if f[1] != "at_least"}):
        have = F.col(key)
        if key in PROFILE_LISTS:
            gap = F.when(F.exists(have, lambda v: v.isNull()), str_array([_gap(key)])).otherwise(_none())
            given = F.concat(_tokens(have, key), str_array([_answered(key)]), gap)
        else:
            given = F.array(F.concat(F.lit(key + "="), have.cast("string")))
        parts.append(F.when(unanswered(have, key in PROFILE_LISTS), str_array([_silent(key)])).otherwise(given))
    return F.array_distinct(F.concat(*parts))


def reached_floors(floors: DataFrame, averages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(floor, rank) and (gpa, reach): how many distinct floors lie at or below each, by one sorted table."""
    both = floors.select(F.col("floor").alias("at"), F.lit(0).alias("kind")).unionByName(
        averages.select(F.col("gpa").alias("at"), F.lit(1).alias("kind"))).where("at is not null").distinct()
    placed = numbered(both, [], [F.col("at"), F.col("kind")], "reach", weight=F.lit(1) - F.col("kind"))
    return (placed.where("kind = 0").select(F.col("at").alias("floor"), F.col("reach").alias("rank")),
            placed.where("kind = 1").select(F.col("at").alias("gpa"), "reach"))


def sheets_of(keyed: DataFrame, sets: DataFrame, reached: DataFrame) -> DataFrame:
    """(answer, sheet, have, reach): answers reduced to what the requirements can tell apart.

    Tokens that no set names go, met with the named ones as rows, and an average
    becomes the number of floors that it reaches.  So the number of different sheets
    is bounded by what is stated, not by the profiles.
    """
    answers = keyed.groupBy("answer").agg(F.any_value("tokens").alias("tokens"), F.any_value("gpa").alias("gpa"))
    named = sets.select(F.explode(F.concat(F.flatten("must"), "never")).alias("token")).distinct()
    have = answers.select("answer", F.explode("tokens").alias("token")).join(named, "token", "left_semi").groupBy(
        "answer").agg(F.array_sort(F.collect_set("token")).alias("have"))
    both = answers.select("answer", "gpa").join(have, "answer", "left").join(reached, "gpa", "left").select(
        "answer", F.coalesce("have", _none()).alias("have"), "reach")
    return both.withColumn("sheet", F.to_json(F.struct("have", "reach"), {"ignoreNullFields": "false"}))


def with_keys(sets: DataFrame, sheets: DataFrame, floor_key: str) -> DataFrame:
    """Sets with the tokens they are met by: those of the condition that the fewest sheets fulfil.

    A set with a floor alone is met by intervals of floors, of which exactly one
    covers it for every average that reaches it; one with ``never`` alone is met by
    whom it turns away.
    """
    found = sheets.select(F.explode("have").alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    each = sets.select("id", F.posexplode("must").alias("nth", "tokens")).select("id", "nth", F.explode("tokens").alias("token"))
    cost = each.join(found, "token", "left").groupBy("id", "nth").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"))
    best = cost.groupBy("id").agg(F.min(F.struct("n", "nth"))["nth"].alias("nth"))
    steps = F.expr(f"transform(sequence(0, {LADDER}), l -> concat('{floor_key}<', l, ':', shiftright(rank - 1, l)))")
    silent = F.when(F.col("goal") == UNKNOWN, str_array([_silent(floor_key)])).otherwise(_none())
    keys = F.when(F.size("must") > 0, F.get("must", F.col("nth"))).when(
        F.col("rank").isNotNull(), F.concat(steps, silent)).otherwise(F.col("never"))
    rest = F.filter("must", lambda _, i: ~i.eqNullSafe(F.col("nth")))
    return sets.join(best, "id", "left").select("goal", "n_records", "never", "rank", (F.size("must") > 0).alias("asks"),
                                                rest.alias("rest"), keys.alias("keys"))


def profile_cross_match(profiles: DataFrame, records: DataFrame) -> DataFrame:
    """Verdict counts over all records for every profile.

    Profile-record pairs are never formed.  Requirement sets become conditions, once
    for being met outright and once, by the sure fields alone, for not excluding; a set
    that asks nothing counts for all without a join.  The others meet the distinct
    answer sheets in an equi-join on the tokens of one condition.  A set that only
    turns some away counts for all, less those.
    """
    floor_key = next(f[2] for f in C.ELIGIBILITY_FIELDS if f[1] == "at_least")
    signatures = cut_lineage(requirement_signatures(records))  # small, and read several times
    sets = cut_lineage(condition_sets(signatures).withColumn("id", F.monotonically_increasing_id()))
    keyed = cut_lineage(answer_signatures(profiles).select(
        "profile_id", "answer", F.col(floor_key).cast("double").alias("gpa"), answer_tokens().alias("tokens")))
    ranks, reached = reached_floors(sets.select("floor"), keyed.select("gpa"))
    # sheets are small beside what they meet: they keep the session's number of partitions
    wide = int(records.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    of_answer = cut_lineage(sheets_of(keyed, sets, reached).repartition(wide, "sheet"))
    sheets = of_answer.groupBy("sheet").agg(F.any_value("have").alias("have"), F.any_value("reach").alias("reach"))
    needs = cut_lineage(with_keys(sets.join(ranks, "floor", "left"), sheets, floor_key))
    ladder = F.expr(f"transform(filter(sequence(0, {LADDER}), l -> (shiftright(reach, l) & 1) = 1), "
                    f"l -> concat('{floor_key}<', l, ':', shiftright(reach, l) - 1))")
    ladder = F.when(F.col("reach").isNull(), str_array([_silent(floor_key)])).otherwise(ladder)
    # a sheet meets a set once, by the first of its keys that it holds
    met = (
        sheets.withColumn("token", F.explode(F.concat("have", ladder)))
        .join(needs.select("*", F.posexplode("keys").alias("place", "token")), "token")
        .where(~F.arrays_overlap(F.slice("keys", F.lit(1), F.col("place")), "have")))
    enough = F.col("rank").isNull() | F.coalesce(F.col("reach") >= F.col("rank"), F.col("goal") == UNKNOWN)
    most = len([f for f in C.ELIGIBILITY_FIELDS if f[1] in ("set_overlap", "must_be")])
    fulfilled = ~F.arrays_overlap("never", "have") & enough
    for i in range(most - 1):
        one = F.get("rest", F.lit(i))
        fulfilled = fulfilled & (one.isNull() | F.arrays_overlap(one, "have"))
    turned = ~F.col("asks") & F.col("rank").isNull()
    n = F.when(turned, -F.col("n_records")).when(fulfilled, F.col("n_records")).otherwise(0)
    of_goal = lambda goal: F.sum(F.when(F.col("goal") == goal, n).otherwise(0)).alias(goal)
    counts = met.groupBy("sheet").agg(of_goal(ELIGIBLE), of_goal(UNKNOWN))
    open_to_all = (F.size("must") == 0) & F.col("floor").isNull()
    all_of = lambda goal: F.coalesce(sets.agg(F.sum(F.when(
        open_to_all & (F.col("goal") == goal), F.col("n_records")))).scalar(), F.lit(0))
    total = F.coalesce(signatures.agg(F.sum("n_records")).scalar(), F.lit(0))
    each = keyed.select("profile_id", "answer").join(of_answer.select("answer", "sheet"), "answer").join(counts, "sheet", "left")
    each = each.select("profile_id", (F.coalesce(F.col(ELIGIBLE), F.lit(0)) + all_of(ELIGIBLE)).alias("n_eligible"),
                       (F.coalesce(F.col(UNKNOWN), F.lit(0)) + all_of(UNKNOWN)).alias("n_possible"), total.alias("n"))
    return each.select("profile_id", "n_eligible", (F.col("n_possible") - F.col("n_eligible")).alias("n_unknown"),
                       (F.col("n") - F.col("n_possible")).alias("n_excluded"))


# --- checks on extracted eligibility --------------------------------------------
def validate(df: DataFrame, key: str, json_column: str) -> DataFrame:
    """One row per problem in stored eligibility JSON: (key, field, problem)."""
    fields = df.select(key, F.explode(F.from_json(json_column, "map<string,string>")).alias("field", "entry"))
    known = F.col("field").isin([f[0] for f in C.ELIGIBILITY_FIELDS])
    is_object = F.coalesce(F.trim("entry").startswith("{"), F.lit(False))
    checked = known & is_object
    value = F.get_json_object("entry", "$.value")
    values = F.when(value.startswith("["), F.from_json(value, "array<string>"))
    conf_text = F.get_json_object("entry", "$.confidence")
    quoted = F.col("entry").rlike(r'"confidence"\s*:\s*"')
    conf = F.when(~quoted, conf_text.try_cast("double"))
    domain = None
    for name, allowed in C.VALUE_DOMAINS.items():
        bad = F.size(F.array_except(values, str_array(allowed))) > 0
        domain = F.when(F.col("field") == name, bad) if domain is None else domain.when(F.col("field") == name, bad)
    year_ok = lambda v: F.coalesce(v.rlike(r"^\d+$") & v.try_cast("int").between(0, 6), F.lit(False))
    gpa = F.when(~F.col("entry").rlike(r'"value"\s*:\s*"'), value.try_cast("double"))
    no = lambda c: F.coalesce(c, F.lit(False))
    problems = F.array_compact(F.array(
        F.when(~known, F.lit("unknown field")),
        F.when(known & ~is_object, F.lit("not an object")),
        F.when(checked & ~no(F.array_contains(F.json_object_keys("entry"), "value")), F.lit("missing value")),
        F.when(checked & ~no(conf.between(0.0, 1.0)), F.lit("confidence outside 0..1")),
        F.when(checked & (F.coalesce(F.get_json_object("entry", "$.src"), F.lit("")) == ""), F.lit("missing src")),
        F.when(checked & no(domain), F.lit("value not in vocabulary")),
        F.when(checked & (F.col("field") == "year") & no(F.exists(values, lambda v: ~year_ok(v))),
               F.lit("year not 0..6")),
        F.when(checked & (F.col("field") == "gpa_min") & ~no(gpa.between(0, 100)), F.lit("gpa_min not 0..100")),
    ))
    return fields.select(key, "field", F.explode(problems).alias("problem"))


def from_categories(tags: DataFrame, base_url: str) -> DataFrame:
    """(slug, page) rows of themed listings -> eligibility and affiliations per slug.

    Only the few known pages count, so the set collected per slug is bounded.
    Values of several pages are unioned, in page order.
    """
    pages = sorted(C.CATEGORY_PAGES)
    per_slug = (
        tags.where(F.col("page").isin(pages)).groupBy("slug").agg(F.sort_array(F.collect_set("page")).alias("pages")))

    def union_of(key):
        table = {p: C.CATEGORY_PAGES[p].get(key, []) for p in pages}
        lookup = F.create_map(*[x for p, v in table.items() for x in (F.lit(p), str_array(v))])
        return F.array_distinct(F.flatten(F.transform("pages", lambda p: F.element_at(lookup, p))))

    def entry(values, page_words):
        urls = F.transform("pages", lambda p: F.concat(F.lit(base_url), p, F.lit("/")))
        urls = F.filter(urls, lambda u: u.rlike("|".join(page_words)))
        src = F.concat(F.lit("Listed by Electro-Federation Canada under "), F.array_join(urls, ", "))
        return F.when(F.size(values) > 0, F.struct(
            values.alias("values"), F.lit(None).cast("double").alias("num"), F.lit(None).cast("boolean").alias("flag"),
            F.lit(C.CATEGORY_CONFIDENCE).alias("confidence"), src.alias("src")))

    labels = literal_map({p: v["affiliation"] for p, v in C.CATEGORY_PAGES.items() if "affiliation" in v})
    affiliations = F.array_distinct(F.array_compact(F.transform("pages", lambda p: F.element_at(labels, p))))
    both = F.create_map(
        F.lit("residency"), entry(union_of("residency"), C.RESIDENCY_PAGE_WORDS),
        F.lit("identity"), entry(union_of("identity"), C.IDENTITY_PAGE_WORDS))
    return per_slug.select(
        "slug", "pages", affiliations.alias("affiliations"),
        F.map_filter(both, lambda _, e: e.isNotNull()).alias("eligibility"))
