"""Secret scans with ownership frequency, in SQL functions only.

Patterns give candidate spans.  A value found with many owners or in many
repositories is an example that people copy; one that stays with a single owner
looks live.  The counts cover every document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from canvass.functions.once import with_once
from canvass.llm.common import stage

#: Kind, pattern (Java syntax), group of the value, least length of that group.
KINDS = [
    ("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", r"(AKIA[A-Z0-9]{16,})", 1, 20),
    ("hex", r"([0-9a-f]{24,})", 1, 24),
    # beyond the base kinds: tokens with a maker's prefix, and headers of private keys
    ("maker", r"((?:gh[pousr]_[A-Za-z0-9]{36,}|xox[abprs]-[A-Za-z0-9-]{10,}|-----BEGIN[A-Z ]{0,40}PRIVATE KEY-----))", 1, 15),
]
BASE = ("assign", "access", "hex")
MANY_OWNERS = 3  # a value of so many owners is a copied example
MANY_REPOSITORIES = 8
#: A whole private key: up to its END line, else the header and base64 lines that follow its BEGIN line.
KEY = (r"(-----BEGIN[A-Z0-9 ]{0,40}PRIVATE KEY(?: BLOCK)?-----(?:"
       r"[^-]*+(?:-(?!----)[^-]*+)*+-----END[A-Z0-9 ]{0,40}PRIVATE KEY(?: BLOCK)?-----"
       r"|(?:\s*+[A-Z][A-Za-z-]{1,20}: [^\n]*+)*+(?:(?:\s|\\[nrt])*+[A-Za-z0-9+/]{16,}+={0,2})*+"
       r"(?:(?:\r?\n|\\n)[A-Za-z0-9+/]{1,63}={0,2}(?=\s|\\n|\z))?+))")
#: What is masked: the kinds above, and private keys with their bodies. The SQL of op9_secrets holds the kinds above.
MASKED_KINDS = [*KINDS, ("key", KEY, 1, 15)]
SALT = 16
MATCHES_A_BLOCK = 128
MASK = "[secret]"
PLAIN = r"^(?:[A-Z]?[a-z]+|[A-Z]+|[0-9]+)[/_.=+-]*$"  # may stand in a text as a word or number of its own
#: Values of assignments that stand for a value, or are code that reads one.
PLACEHOLDER = (r"(?i)^(?:(?:your|my|the|some|enter|insert|change|replace|set)[_.-]?(?:me|this|here|it|own|new)?[_.-]?"
               r"(?:api)?[_.-]?(?:pass(?:word|wd)?|secret|token|key|value)?(?:[_.-]?here)?|pass(?:word|wd|phrase)|secret|token|"
               r"api_?key|example|sample|placeholder|default|dummy|redacted|removed|hidden|required|optional|string|str|"
               r"integer|number|boolean|value|values|undefined|nullptr|false|unknown|"
               r"(?:os|process|self|this|config|settings|args|env|environ|request|params|options|secrets|System)\.[a-z_.]+)[.]?$")


def bound(value: Column, use) -> Column:
    """``use(value)`` with the value worked out once, however often it is read."""
    return F.element_at(F.transform(F.array(value), use), 1)


def matches(text: Column, pattern: str, group: int, least: int) -> Column:
    """Spans ``(start, end, value)`` in code points, leftmost and not overlapping.

    Cutting the text at the matches gives what lies between them, and the lengths of
    both give the positions.  Matches are gone through in blocks, as an array that grows
    entry by entry is copied each time.
    """
    whole = F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(1))
    inner = F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(group + 1))
    gaps = F.split(text, pattern, -1)
    empty = F.array().cast("array<struct<start:int,end:int,value:string>>")

    def step(done, part):
        start = done["at"] + F.length(part["gap"])
        end = start + F.length(part["found"])
        span = F.struct(start.alias("start"), end.alias("end"), part["value"].alias("value"))
        keep = F.length(part["value"]) >= least
        return F.struct(end.alias("at"), F.when(keep, F.concat(done["spans"], F.array(span))).otherwise(done["spans"])
                        .alias("spans"))

    zipped = F.arrays_zip(F.slice(gaps, 1, F.size(whole)).alias("gap"), whole.alias("found"), inner.alias("value"))
    def in_blocks(parts):
        return F.transform(F.sequence(F.lit(0), F.floor((F.size(parts) - 1) / MATCHES_A_BLOCK).cast("int")),
                           lambda b: F.slice(parts, b * MATCHES_A_BLOCK + 1, MATCHES_A_BLOCK))

    def placed(blocks):
        lengths = F.transform(blocks, lambda block: F.aggregate(
            block, F.lit(0), lambda n, part: n + F.length(part["gap"]) + F.length(part["found"])))
        starts = F.aggregate(lengths, F.array(F.lit(0)), lambda at, n: F.concat(at, F.array(F.element_at(at, -1) + n)))
        return F.flatten(F.zip_with(blocks, F.slice(starts, 1, F.size(blocks)), lambda block, at: F.aggregate(
            block, F.struct(at.alias("at"), empty.alias("spans")), step, lambda s: s["spans"])))

    walked = bound(bound(zipped, in_blocks), placed)
    return F.when(F.regexp_like(text, F.lit(pattern)), walked).otherwise(empty)


def named(spans: Column, nth: int, kind: str) -> Column:
    return F.transform(spans, lambda s: F.struct(
        s["start"].alias("start"), F.lit(nth).alias("nth"), s["end"].alias("end"), F.lit(kind).alias("kind"),
        s["value"].alias("value")))


def scan(docs: DataFrame, text: str = "text", kinds=KINDS) -> DataFrame:
    """All columns and ``spans``, an array of (start, kind number, end, kind, value) in order."""
    value = F.coalesce(F.col(text), F.lit(""))
    found = [named(matches(value, pattern, group, least), n, kind)
             for n, (kind, pattern, group, least) in enumerate(kinds)]
    return with_once(docs, {"spans": F.array_sort(F.concat(*found))})


def ownership(candidates: DataFrame) -> DataFrame:
    """Per value: distinct owners and repositories, and documents.

    Rows are first reduced to one per value, owner and repository where they lie, so
    a value that fills the corpus is a few rows when it is shuffled.
    """
    each = candidates.groupBy("hash", "owner", "repository").agg(F.count(F.lit(1)).alias("n"))
    by_owner = each.groupBy("hash", "owner").agg(F.count(F.lit(1)).alias("repositories"), F.sum("n").alias("n"))
    return by_owner.groupBy("hash").agg(
        F.count(F.lit(1)).alias("owners"), F.sum("repositories").alias("repositories"), F.sum("n").alias("found"))


def live_looking(value: Column) -> Column:
    """Not a word or a run of one character: a digit and a letter, and six different characters or more."""
    return F.regexp_like(value, F.lit("[0-9]")) & F.regexp_like(value, F.lit("[A-Za-z]")) & (
        F.size(F.array_distinct(F.split(value, ""))) >= 6)


def live_by_form(s: Column) -> Column:
    """What may be live if it is not copied: the form tells for all kinds but assignments and runs of hex digits.

    An assigned value may be of letters or digits alone; only stand-ins and runs of one
    or two characters are none, the rest is up to ownership.
    """
    distinct = F.size(F.array_distinct(F.split(s["value"], "")))
    assigned = (distinct >= 3) & ~F.regexp_like(s["value"], F.lit(PLACEHOLDER))
    return F.when(s["kind"] == "assign", assigned).when(s["kind"] == "hex", live_looking(s["value"])).otherwise(True)


def live_by_sql(s: Column) -> Column:
    """As the SQL of op9_secrets has it: a digit and a letter for all but tokens with a maker's prefix."""
    return live_looking(s["value"]) | (s["kind"] == "maker")


def judged(spans: DataFrame, live=live_by_sql) -> DataFrame:
    """Explode spans of ``(row, owner, repository, spans)`` and mark each as example, live or weak."""
    each = spans.select("row", "owner", "repository", F.explode("spans").alias("s"))
    each = each.withColumn("hash", F.unhex(F.sha2("s.value", 256)))
    owned = ownership(each)
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))).alias("salt")
    copies = owned.select("hash", "owners", "repositories", salts)
    dealt = each.withColumn("salt", F.pmod(F.xxhash64("row"), F.lit(SALT)).cast("int"))
    both = dealt.join(copies, ["hash", "salt"])
    copied = (F.col("owners") >= MANY_OWNERS) | (F.col("repositories") >= MANY_REPOSITORIES)
    return both.select("row", "s", "owners", "repositories",
                       F.when(copied, "example").when(live(F.col("s")), "live").otherwise("weak").alias("verdict"))


def text_of(spans: Column, kinds=None) -> Column:
    chosen = F.filter(spans, lambda s: s["kind"].isin(*kinds)) if kinds else spans
    return F.array_join(F.transform(chosen, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"),
                                                                 s["end"].cast("string"))), ",")


def count(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def secrets(docs: DataFrame, owner: str = "source", repository: Column | None = None) -> DataFrame:
    """One row per document: spans of each kind, and how many are live, examples or weak.

    The repository defaults to owner and language.  A null text counts as empty;
    null owners are one owner; repeated rows count as one owner's; no rows, no results.
    """
    repo = repository if repository is not None else F.concat_ws("/", F.col(owner), F.col("lang"))
    rows = scan(docs.select("doc_id", F.col(owner).alias("owner"), repo.alias("repository"), "text"))
    rows = stage(rows.drop("text").withColumn("row", F.monotonically_increasing_id()), "spans")
    per_row = judged(rows.where(F.size("spans") > 0)).groupBy("row").agg(
        *[F.count(F.when(F.col("verdict") == v, 1)).alias(f"n_{v}") for v in ("live", "example", "weak")],
        F.max("owners").alias("most_owners"))
    return rows.join(per_row, "row", "left").na.fill(0, ["n_live", "n_example", "n_weak", "most_owners"]).drop("row")


def row_key(docs: DataFrame) -> Column:
    """What a row is met by again: its id, or the digest of its text where it has none."""
    return F.coalesce(F.concat(F.lit("i"), docs["doc_id"].cast("string")), F.concat(F.lit("t"), F.sha2(docs["text"], 256)))


def live_values(docs: DataFrame, owner: str = "source") -> DataFrame:
    """Spans of live-looking values by row, to be masked; ``row`` is the ``row_key``.

    A private key is one value, from its BEGIN line to its END line; the BEGIN line,
    which all keys of a type share, is no value of its own here.  ``whole`` is what is
    replaced and ``by`` what it gives way to: a value that may be a word or a number
    of the text goes with the name that it is assigned to only.
    """
    repo = F.concat_ws("/", F.col(owner), F.col("lang"))
    rows = scan(docs.select(row_key(docs).alias("row"), F.col(owner).alias("owner"), repo.alias("repository"), "text"),
                kinds=MASKED_KINDS)
    rows = rows.withColumn("spans", F.transform(
        F.filter("spans", lambda s: ~s["value"].startswith("-----BEGIN") | (s["kind"] == "key")), lambda s: s.withField(
            "whole", F.when((s["kind"] == "assign") & F.regexp_like(s["value"], F.lit(PLAIN)), F.substr(
                F.col("text"), s["start"] + 1, s["end"] - s["start"])).otherwise(s["value"]))))
    rows = stage(rows.where(F.size("spans") > 0).drop("text"), "spans")
    return judged(rows, live_by_form).where("verdict = 'live'").withColumns({
        "whole": F.col("s.whole"), "by": F.concat(F.substr(
            "s.whole", F.lit(1), F.length("s.whole") - F.length("s.value")), F.lit(MASK))})


def masked(text: Column, values: Column) -> Column:
    """The text with every one of the values ``(whole, by)`` replaced."""
    return F.aggregate(values, text, lambda t, v: F.replace(t, v["whole"], v["by"]))


def mask_live(docs: DataFrame, owner: str = "source") -> DataFrame:
    """The documents with live-looking values masked in their texts; all columns and rows stay.

    Longer values go first, so that one inside another leaves no rest.  Only documents
    that hold a live value meet the list; ``n_chars`` follows the text where it is there.
    Rows without an id are masked like all others.
    """
    live = live_values(docs, owner).groupBy(F.col("row").alias("_row")).agg(
        F.array_sort(F.collect_set(F.struct(-F.length("whole"), "whole", "by"))).alias("_live"))
    both = docs.join(live, row_key(docs) == live["_row"], "left")
    text = F.when(F.col("_live").isNull(), docs["text"]).otherwise(masked(docs["text"], F.col("_live")))
    out = {c: docs[c] for c in docs.columns} | {"text": text}
    if "n_chars" in out:
        out["n_chars"] = F.when(F.col("_live").isNull(), docs["n_chars"]).otherwise(
            F.length(text).cast(docs.schema["n_chars"].dataType))
    return both.select(*[c.alias(n) for n, c in out.items()])
