"""Status, category, career, deadline and table-cell readings as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from canvass import config as C
from canvass.functions.once import bind
from canvass.functions.text import as_col, clean_text, literal_map, strip, tidy_text


def _has(col: Column, pattern: str) -> Column:
    return F.coalesce(col.rlike("(?iu)" + pattern), F.lit(False))


def normalize_status(col) -> Column:
    """Open, Ended, Upcoming; anything else is unknown (null)."""
    return F.element_at(literal_map(C.STATUS_MAP), F.lower(strip(col)))


def split_or(fragment: Column) -> Column:
    """'A or B' as two units when every side names a unit, else as it is."""
    parts = F.split(fragment, r"\s+or\s+")
    return F.when(
        (F.size(parts) > 1) & F.forall(parts, lambda p: _has(p, C.UNIT_WORD)), F.transform(parts, strip)
    ).otherwise(F.array(fragment))


def split_units(col) -> Column:
    """A comma-separated cell as whole unit names.

    A fragment without a unit word belongs to the one before it, so the fold
    either extends the last unit or appends new ones.
    """
    text = as_col(col)
    fragments = F.filter(F.transform(F.split(text, ","), strip), lambda f: f != "")
    empty = F.array().cast("array<string>")

    def step(units, fragment):
        joined = F.concat(
            F.slice(units, F.lit(1), F.greatest(F.size(units) - 1, F.lit(0))),
            F.array(F.concat(F.element_at(units, -1), F.lit(", "), fragment)),
        )
        continues = (F.size(units) > 0) & ~_has(fragment, C.UNIT_WORD)
        return F.when(continues, joined).otherwise(F.concat(units, split_or(fragment)))

    units = F.aggregate(fragments, empty, step)
    return F.when(F.size(units) > 0, units).otherwise(F.array(text))


def canonical_unit(unit: Column) -> Column:
    """One unit name: pinned spelling where known, never with a comma."""
    key = F.lower(F.replace(unit, F.lit("&"), F.lit("and")))
    key = strip(F.regexp_replace(F.regexp_replace(key, r",\s*and\b", " and"), r"[\s,]+", " "))
    display = F.regexp_replace(F.regexp_replace(unit, r",\s*and\b", " and"), r"\s*,\s*", " ")
    return F.coalesce(F.element_at(literal_map(C.CANONICAL_FACULTY), key), strip(display))


def canonical_category(col, compose: bool = True) -> Column:
    """The category cell as comma-joined unit names; money or blank is null."""
    text = clean_text(col, compose)
    usable = text.isNotNull() & ~text.rlike(C.CURRENCY_ONLY) & ~text.contains("$")
    return F.when(usable, F.array_join(F.transform(split_units(text), canonical_unit), ", "))


def infer_career(title, body) -> Column:
    """Undergraduate / Graduate / null; a text naming both levels ends the search."""
    chain = None
    for text in (as_col(title), as_col(body)):
        grad, under = _has(text, C.GRADUATE_LEVEL), _has(text, C.UNDERGRAD_LEVEL)
        for condition, value in (
            (grad & under, F.lit(None).cast("string")),
            (grad, F.lit("Graduate")),
            (under | _has(text, C.UNDERGRAD_HINT), F.lit("Undergraduate")),
        ):
            chain = F.when(condition, value) if chain is None else chain.when(condition, value)
    return chain


def career_by_group(col) -> Column:
    return F.element_at(literal_map(C.CAREER_BY_GROUP), F.lower(as_col(col)))


def level_by_group(col) -> Column:
    return F.element_at(literal_map(C.LEVEL_BY_GROUP), F.lower(as_col(col)))


def deadline_text(col) -> Column:
    """A deadline cell without its leading label."""
    return strip(F.regexp_replace(as_col(col), r"^\s*Deadline\s*", ""))


def deadline_iso(col) -> Column:
    """First MM/DD/YYYY as YYYY-MM-DD text; validity is not checked."""
    text = as_col(col)
    part = lambda group: F.regexp_extract(text, C.DEADLINE_DATE, group)
    return F.when(text.rlike(C.DEADLINE_DATE), F.concat_ws("-", part(3), part(1), part(2)))


def deadline_day(iso) -> Column:
    """Typed copy of the ISO text; an impossible day is null."""
    return F.try_to_date(as_col(iso), "yyyy-MM-dd")


def month_day_deadline(col) -> Column:
    """A yearless 'MONTH DD' cell, kept as it stands."""
    text = as_col(col)
    return F.when(text.rlike("(?i)" + C.MONTH_DAY), text)


def _cell_texts(cells) -> Column:
    """Tidied texts of the cells that hold any."""
    return F.filter(F.transform(as_col(cells), lambda c: tidy_text(c, False)), lambda c: c != "")


def classify_cells(cells) -> Column:
    """Read table cells by content: status word, money, date, else category.

    The last status, amount and deadline win; the first category does.  Every cell
    is tidied and told apart a single time.
    """
    def kind(c):
        return (
            F.when(F.lower(c).isin(C.STATUS_WORDS), "status")
            .when(c.contains("$") | c.rlike(C.CURRENCY_ONLY), "amount")
            .when(c.rlike(C.DEADLINE_DATE), "deadline")
            .otherwise("category"))

    read = F.transform(_cell_texts(cells), lambda c: F.struct(c.alias("text"), kind(c).alias("kind")))

    def build(v):
        pick = lambda name, place: F.try_element_at(
            F.filter(v["cells"], lambda c: c["kind"] == name), F.lit(place))["text"]
        return F.struct(
            pick("category", 1).alias("category"),
            pick("status", -1).alias("status"),
            pick("amount", -1).alias("amount"),
            deadline_text(pick("deadline", -1)).alias("deadline"),
        )

    return bind({"cells": read}, build)


def classify_extra_cells(cells) -> Column:
    """The cells after name and body: a yearless deadline, or a note on essays."""
    is_deadline = lambda c: c.rlike("(?i)" + C.MONTH_DAY)
    is_essay = lambda c: ~is_deadline(c) & F.upper(c).contains("ESSAY")

    def build(v):
        last = lambda pick: F.try_element_at(F.filter(v["texts"], pick), F.lit(-1))
        return F.struct(last(is_deadline).alias("deadline_raw"), last(is_essay).alias("supporting_documents"))

    return bind({"texts": _cell_texts(cells)}, build)


def strip_name_prefix(name, body) -> Column:
    """Body text without the title it opens with; nothing left is null."""
    name, body = as_col(name), as_col(body)
    rest = F.when(body.startswith(name), strip(F.substr(body, F.length(name) + 1))).otherwise(body)
    return F.when(rest != "", rest)


def host_of(url) -> Column:
    """Lower-case host of an absolute URL."""
    return F.lower(F.regexp_extract(as_col(url), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))


def is_offsite(url, index_host) -> Column:
    return host_of(url) != (F.lit(index_host) if isinstance(index_host, str) else index_host)


def review_flags(eligibility, description) -> Column:
    """Criteria a reader must check by hand: '!cit', '!gpa'."""
    blob = F.concat(F.coalesce(as_col(eligibility), F.lit("")), F.lit(" "), F.coalesce(as_col(description), F.lit("")))
    return F.array_join(
        F.array_compact(F.array(
            F.when(blob.rlike("(?i)" + C.CITIZENSHIP_FLAG), F.lit("!cit")),
            F.when(blob.rlike("(?i)" + C.GPA_FLAG), F.lit("!gpa")),
        )),
        ",",
    )


def label_text(*fields) -> Column:
    """The prose fields a labeller reads, empty ones left out."""
    kept = [F.when(as_col(f) != "", as_col(f)) for f in fields]
    return F.concat_ws("\n", *kept)


def label_lines(text) -> Column:
    """First non-blank lines, right-trimmed."""
    trimmed = F.transform(F.split(as_col(text), "\n"), lambda x: F.regexp_replace(x, r"\s+$", ""))
    return F.slice(F.filter(trimmed, lambda x: x != ""), 1, C.LABEL_LINES)
