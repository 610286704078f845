"""The three readings of money in prose.  They differ on purpose."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from canvass import config as C
from canvass.functions.once import bind
from canvass.functions.text import as_col, clean_scalar, clean_text, strip

# Ingestion: thousands by comma or space.  A figure without separators is read
# whole ($2500 is 2500).
INGEST = r"\$\s?(\d{1,3}(?:[,\s\x{A0}]\d{3})+(?:\.\d{1,2})?|\d+(?:\.\d{1,2})?)"
# Backfill at publishing: comma only.
BACKFILL = r"\$\s?([\d,]+(?:\.\d{2})?)"
# Ranking: first figure, no decimals.
FIRST = r"\$\s?([\d,]+)"


def _extract(col: Column, pattern: str, group: int) -> Column:
    return F.regexp_extract_all(col, F.lit(pattern), F.lit(group))


def _spans(col: Column, pattern: str) -> Column:
    found = F.array_distinct(F.transform(_extract(col, pattern, 0), strip))
    return F.substring(F.array_join(found, "; "), 1, C.RAW_VERBATIM_LIMIT)


def _figures(col: Column, pattern: str, floor: int) -> Column:
    whole = F.transform(
        _extract(col, pattern, 1),
        lambda m: F.floor(F.regexp_replace(m, "[,\\s\\x{A0}]", "").try_cast("double")).cast("bigint"),
    )
    return F.filter(whole, lambda v: v >= floor)


def parse_amounts(col, compose: bool = True) -> Column:
    """struct(amount_min, amount_max, amount_raw) of an amount cell or of prose."""
    text = as_col(col)
    found = {"values": _figures(text, INGEST, C.MIN_MEANINGFUL_AMOUNT), "cleaned": clean_text(text, compose)}

    def build(v):
        short = F.length(v["cleaned"]) <= C.RAW_VERBATIM_LIMIT
        raw = F.when(short, v["cleaned"]).when(F.size(v["values"]) > 0, _spans(text, INGEST))
        return F.struct(
            F.array_min(v["values"]).alias("amount_min"),
            F.array_max(v["values"]).alias("amount_max"),
            raw.alias("amount_raw"),
        )

    return bind(found, build)


def money_excerpt(col) -> Column:
    """Short text as it is; of longer text only the figures."""
    cleaned = clean_scalar(col)
    spans = _spans(cleaned, BACKFILL)
    return F.when(F.length(cleaned) <= C.RAW_VERBATIM_LIMIT, cleaned).otherwise(F.when(spans != "", spans))


def derive_amounts(amount_min, amount_max, amount_raw, value_text, description) -> dict:
    """Fill missing amounts from the value text, else from the description.

    One expression per column, so that a reader of one does not pay for the others;
    the description is only read where the value text holds no figure.
    """
    low, high, raw = as_col(amount_min), as_col(amount_max), as_col(amount_raw)
    value_text, description = as_col(value_text), as_col(description)
    figures = lambda t: F.when(high.isNull() & t.contains("$"), _figures(t, BACKFILL, C.MIN_BACKFILL_AMOUNT))

    def chosen(then) -> Column:
        """``then`` of the figures that count, null where there are none."""
        def second(v):
            later = bind({"f": figures(description)}, lambda w: F.when(F.size(w["f"]) > 0, then(w["f"])))
            return F.when(F.size(v["f"]) > 0, then(v["f"])).otherwise(later)

        return F.when(high.isNull(), bind({"f": figures(value_text)}, second))

    no_raw = raw.isNull() | (raw == "")

    def excerpt(v) -> Column:
        got = F.when(F.size(v["first"]) > 0, money_excerpt(value_text)).when(F.size(v["second"]) > 0, money_excerpt(description))
        any_ = (F.size(v["first"]) > 0) | (F.size(v["second"]) > 0)
        return F.when(any_ & no_raw, got).otherwise(raw)

    return {
        "amount_min": F.coalesce(chosen(F.array_min), low),
        "amount_max": F.coalesce(high, chosen(F.array_max)),
        "amount_raw": bind({"first": figures(value_text), "second": figures(description)}, excerpt),
    }


def first_dollar(value_text, description) -> Column:
    """First dollar figure of the value text, else of the description."""

    def figure(col):
        digits = F.regexp_replace(F.regexp_extract(as_col(col), FIRST, 1), ",", "")
        return digits.try_cast("bigint")

    return F.coalesce(figure(value_text), figure(description))
