"""Text cleaning and tokenising as Column expressions."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

SPACE = r"[\p{IsWhite_Space}\x1c-\x1f]"
SPACE_CHARS = "".join(chr(c) for c in range(0x3001) if chr(c).isspace())
LINE_SPACE = r"[\p{IsWhite_Space}\x1c-\x1f&&[^\n]]"


def as_col(value) -> Column:
    return F.col(value) if isinstance(value, str) else value


def strip(col) -> Column:
    """Trim every kind of white space at both ends."""
    return F.btrim(as_col(col), F.lit(SPACE_CHARS))


def clean_scalar(col) -> Column:
    """Trimmed text; blank, a lone hyphen or a lone non-breaking hyphen is null."""
    text = strip(col)
    return F.when(~text.isin("", "-", "\u2011"), text)


def split_multi(col) -> Column:
    """Comma-separated text as an array of trimmed, non-blank parts."""
    parts = F.transform(F.split(clean_scalar(col), ","), strip)
    return F.coalesce(F.filter(parts, lambda p: p != ""), F.array().cast("array<string>"))


@F.pandas_udf(T.StringType())
def nfc(text: pd.Series) -> pd.Series:
    """Canonical composition; Spark has no built-in for it."""
    return text.map(lambda t: None if t is None else unicodedata.normalize("NFC", t))


@F.pandas_udf(T.StringType())
def nfkd(text: pd.Series) -> pd.Series:
    """Compatibility decomposition over the whole of Unicode."""
    return text.map(lambda t: None if t is None else unicodedata.normalize("NFKD", t))


@F.pandas_udf(T.StringType())
def nfkc(text: pd.Series) -> pd.Series:
    """Compatibility composition."""
    return text.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


def tidy_text(col, compose: bool = True) -> Column:
    """Prose with its line structure kept and everything else tidied; it may be empty."""
    text = nfc(as_col(col)) if compose else as_col(col)
    text = F.replace(text, F.lit("\ufffd"), F.lit(""))
    text = F.translate(text, "\x0b\x0c\u2028\u2029", "\n\n\n\n")
    text = F.regexp_replace(text, "\r\n?", "\n")
    text = F.regexp_replace(text, "[ \t\u00a0\u2007\u202f]+", " ")
    text = F.regexp_replace(text, "(?md)^" + LINE_SPACE + "+|" + LINE_SPACE + "+$", "")
    text = F.regexp_replace(text, "\n{3,}", "\n\n")
    return strip(text)


def clean_text(col, compose: bool = True) -> Column:
    """Tidied prose; empty is null."""
    text = tidy_text(col, compose)
    return F.when(text != "", text)


# Letters that decompose into one ASCII letter plus marks, found by rule.
def _accent_table() -> tuple[str, str]:
    accented, base = [], []
    for code in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]:
        parts = unicodedata.normalize("NFKD", chr(code))
        if len(parts) > 1 and parts[0].isascii() and parts[0].isalpha() and all(
            unicodedata.combining(c) for c in parts[1:]
        ):
            accented.append(chr(code))
            base.append(parts[0])
    return "".join(accented), "".join(base)


ACCENTED, BASE = _accent_table()


def _ranges(chars: str) -> str:
    """A regex class body in which neighbouring letters are written as ranges."""
    out, run = [], [chars[0], chars[0]]
    for c in chars[1:]:
        if ord(c) == ord(run[1]) + 1:
            run[1] = c
        else:
            out.append(run)
            run = [c, c]
    out.append(run)
    return "".join(a if a == b else f"{a}-{b}" for a, b in out)


ACCENT_CLASS = f"[\\x{{C0}}-\\x{{1EFF}}&&[{_ranges(ACCENTED)}]]"


def fold(col) -> Column:
    """Decomposed text: each accented Latin letter becomes its base letter plus a mark.

    The mark written is always U+0301; tokenisers only need to see that one is
    there.  Stays in the JVM, two passes; text without any letter beyond ASCII,
    told by its length in bytes, is left alone.  ``nfkd`` covers all of Unicode.
    """
    text = as_col(col)
    marked = F.regexp_replace(text, f"({ACCENT_CLASS})", "$1\u0301")
    plain = F.octet_length(text) == F.char_length(text)
    return F.when(plain, text).otherwise(F.translate(marked, ACCENTED, BASE))


def norm_text(col, full: bool = False) -> Column:
    """Decomposed, white space collapsed, lower case; null counts as empty."""
    text = F.coalesce(as_col(col), F.lit(""))
    text = nfkd(text) if full else fold(text)
    return F.lower(F.regexp_replace(text, f"{SPACE}+", " "))


def flat_text(col, full: bool = False) -> Column:
    """Decomposed lower case; tokenisers need no white space collapsed first."""
    text = F.coalesce(as_col(col), F.lit(""))
    return F.lower(nfkd(text) if full else fold(text))


def tokenize(col, full: bool = False) -> Column:
    """ASCII word tokens longer than two characters; an accent ends a token."""
    return F.filter(F.split(flat_text(col, full), "[^a-z0-9]+"), lambda t: F.length(t) > 2)


def words(col, full: bool = False) -> Column:
    """Maximal runs of letters, digits and underscore.

    ``term`` (ASCII letters and digits) is among them exactly when it occurs in
    the text between word boundaries.
    """
    return F.split(flat_text(col, full), r"[^\p{L}\p{N}_]+")


def slugify(col, max_length: int = 80, full: bool = False) -> Column:
    """URL-safe id of a title; nothing usable gives 'unknown'."""
    text = F.coalesce(as_col(col), F.lit(""))
    ascii_only = F.regexp_replace(nfkd(text) if full else fold(text), "[^\\x00-\\x7f]", "")
    slug = F.regexp_replace(F.lower(ascii_only), "[^a-z0-9]+", "-")
    slug = F.substring(F.regexp_replace(slug, "^-+|-+$", ""), 1, max_length)
    return F.when(slug == "", F.lit("unknown")).otherwise(slug)


def lines(col) -> Column:
    """Trimmed, non-blank lines of a text."""
    return F.filter(F.transform(F.split(as_col(col), "\n"), strip), lambda x: x != "")


def literal_map(mapping: dict) -> Column:
    return F.create_map(*[F.lit(x) for pair in mapping.items() for x in pair])


def str_array(values) -> Column:
    """A literal array of strings, typed also when empty."""
    return F.array(*[F.lit(v) for v in values]).cast("array<string>")
